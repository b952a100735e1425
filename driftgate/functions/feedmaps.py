"""Feed value mappings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def catalog_lifecycle(status) -> Column:
    """Catalog status -> lifecycle; a missing status is the value 'unknown'."""
    s = F.lower(_c(status))
    return (F.when(s.isNull() | (s == ""), "unknown")
             .when(s == "deprecated", "deprecated")
             .when(s.isin("retired", "shutdown"), "retired")
             .when(s.isin("alpha", "beta", "active"), "active")
             .otherwise("unknown"))


def feed_lifecycle(status, shutdown_date) -> Column:
    """shutdown/retired -> retired, everything else in the feed is deprecated."""
    s = F.lower(_c(status))
    return F.when(s.isin("shutdown", "retired"), "retired").otherwise("deprecated")


def feed_retirement_date(shutdown_date, deprecation_date) -> Column:
    """Shutdown date, else deprecation date."""
    return F.coalesce(_c(shutdown_date), _c(deprecation_date))


def vision_flag(input_modalities, attachment) -> Column:
    """With a modality list, image/vision in it or an attachment flag; without one,
    the attachment flag itself (null stays null)."""
    mods, att = _c(input_modalities), _c(attachment)
    has_image = F.exists(mods, lambda m: m.isin("image", "vision"))
    return (F.when(mods.isNotNull(), F.coalesce(has_image, F.lit(False)) | F.coalesce(att == True, F.lit(False)))  # noqa: E712
             .otherwise(att))
