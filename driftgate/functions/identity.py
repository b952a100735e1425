"""Entity identity: provider normalization, key building, model-id tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftgate.schemas import FLOATING_ALIASES, MODEL_ID_PATTERN


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_provider(raw) -> Column:
    """Substring tests in a fixed order; anything else is 'unknown'."""
    p = F.lower(_c(raw))
    return (F.when(p.contains("openai"), "openai")
             .when(p.contains("anthropic") | p.contains("claude"), "anthropic")
             .when(p.contains("google") | p.contains("gemini") | p.contains("vertex"), "google")
             .when(p.contains("xai") | p.contains("grok"), "xai")
             .otherwise("unknown"))


def infer_provider(model_id) -> Column:
    """Provider from the model id prefix."""
    m = F.lower(_c(model_id))
    return (F.when(m.startswith("gpt-") | m.startswith("o1") | m.startswith("o3")
                   | m.startswith("o4") | m.startswith("text-embedding"), "openai")
             .when(m.startswith("claude-"), "anthropic")
             .when(m.startswith("gemini-"), "google")
             .when(m.startswith("grok-"), "xai")
             .otherwise("unknown"))


def is_fixed_model_id(model_id) -> Column:
    """Date-stamped or version-pinned ids are fixed."""
    m = _c(model_id)
    return (m.rlike(r"\d{4}-\d{2}-\d{2}") | m.rlike(r"-\d{8}$") | m.rlike(r"@\d")
            | m.rlike(r"-\d{4}$"))


def identifier_kind(model_id) -> Column:
    """'fixed' for pinned ids, every other id (aliases included) is 'floating'."""
    return F.when(is_fixed_model_id(model_id), "fixed").otherwise("floating")


def model_key(provider, model_id) -> Column:
    """X4: 'provider:model_id' (null when either part is null)."""
    return F.concat(_c(provider), F.lit(":"), _c(model_id))


def parse_model_key(key) -> Column:
    """Split at the first colon; a key without a non-empty provider part gives null."""
    k = _c(key)
    idx = F.instr(k, ":")
    return F.when(idx > 1, F.struct(F.substring_index(k, ":", 1).alias("provider"),
                                    k.substr(idx + 1, F.length(k)).alias("model_id")))


def contains_path_or_url(value) -> Column:
    v = _c(value)
    return (v.rlike(r"[\\/]") | v.rlike(r"(?i)^https?:")
            | (v.contains("@") & ~v.contains("gpt")))


def looks_like_model_id(value) -> Column:
    """3-120 chars, no path/URL, and an id pattern or a known alias."""
    v = _c(value)
    n = F.length(v)
    return ((n >= 3) & (n <= 120) & ~contains_path_or_url(v)
            & (v.rlike("(?i)" + MODEL_ID_PATTERN) | v.isin(FLOATING_ALIASES)))
