"""Scalar functions: Column -> Column, built-in Spark expressions only (no UDFs)."""

from driftgate.functions.identity import (  # noqa: F401
    identifier_kind, infer_provider, is_fixed_model_id, looks_like_model_id, model_key,
    normalize_provider, parse_model_key,
)
from driftgate.functions.confidence import (  # noqa: F401
    blocking_eligible, can_block, confidence_rank, days_until, pct_increase,
)
from driftgate.functions.text import (  # noqa: F401
    contains_secret, finding_line, sanitize_for_print, sanitize_line, scrub_secrets,
    snippet, url_allowed,
)
from driftgate.functions.feedmaps import (  # noqa: F401
    catalog_lifecycle, feed_lifecycle, feed_retirement_date, vision_flag,
)
