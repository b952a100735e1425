"""Approved-lock storage as JSON lines, one dependency per line.

Reading splits lines into ``good`` and ``rejects`` (secret present, not JSON, schema or
version wrong) instead of failing the whole job; writing scrubs secrets, writes keys in
sorted order and refuses when a secret is still present.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftgate.functions.jsontext import json_ok, sorted_struct
from driftgate.functions.scanners import redact_members
from driftgate.functions.text import SECRET_KEY_WORDS, contains_secret, holds_any, scrub_secrets
from driftgate.schemas import CONFIDENCE_ORDER, EVIDENCE, FACTS, GENERATOR_VERSION, PROVIDERS, REDACTED, SCHEMA_VERSION, SECRET_KEY_PATTERN
from driftgate.session import stored

# Lock line: header fields repeated per dependency, the dependency, and its approved facts.
LOCK_LINE = T.StructType(sorted([
    T.StructField("facts", FACTS),
    T.StructField("lockfileVersion", T.IntegerType()),
    T.StructField("generatedAt", T.StringType()),
    T.StructField("scope", T.StringType()),
    T.StructField("key", T.StringType()),
    T.StructField("provider", T.StringType()),
    T.StructField("modelId", T.StringType()),
    T.StructField("identifierKind", T.StringType()),
    T.StructField("discoveryConfidence", T.DoubleType()),
    T.StructField("lowConfidence", T.BooleanType()),
    T.StructField("path", T.StringType()),
    T.StructField("line", T.IntegerType()),
    T.StructField("generatorVersion", T.StringType()),
    T.StructField("configDigest", T.StringType()),
    T.StructField("registryDigest", T.StringType()),
    T.StructField("evidence", T.ArrayType(EVIDENCE)),
    T.StructField("nOccurrences", T.LongType()),
    T.StructField("occurrencesDigest", T.StringType()),
], key=lambda f: f.name))
REQUIRED = ["lockfileVersion", "scope", "key", "provider", "modelId", "identifierKind"]
# JSON types a member may have; members that are not required may be null, too.
_TEXT, _WHOLE = ["STRING"], ["BIGINT"]
LINE_TYPES = {"facts": ["OBJECT"], "generatedAt": _TEXT, "discoveryConfidence": ["BIGINT", "DECIMAL", "DOUBLE"], "lowConfidence": ["BOOLEAN"],
              "path": _TEXT, "line": _WHOLE, "generatorVersion": _TEXT, "configDigest": _TEXT, "registryDigest": _TEXT, "evidence": ["ARRAY"],
              "nOccurrences": _WHOLE, "occurrencesDigest": _TEXT}
#: Lines of a file of a lock, about 200 MB of text.
FILE_LINES = 1 << 15


def _types_ok(members: Column) -> Column:
    """A line as a map of variants: no optional member has a type it must not have."""
    ok = F.lit(True)
    for name, types in LINE_TYPES.items():
        kind = F.regexp_extract(F.schema_of_variant(F.try_element_at(members, F.lit(name))), r"^[A-Z]+", 0)
        ok = ok & (kind.isNull() | kind.isin([*types, "VOID"]))
    return ok


def read_lock(raw: DataFrame, text_col: str = "value") -> tuple[DataFrame, DataFrame]:
    """JSON lines -> (good rows, rejects(line, reason))."""
    t = F.col(text_col)
    j = lambda c: F.col(f"j.{c}")
    # Enums and ranges; a required value of a wrong JSON type parses to null and fails.
    confidences = F.filter(F.array(*[F.col(f"j.facts.{f.name}.confidence") for f in FACTS.fields]), lambda c: c.isNotNull())
    in_range = (j("identifierKind").isin("floating", "fixed") & j("provider").isin(PROVIDERS)
                & (j("discoveryConfidence").isNull() | j("discoveryConfidence").between(0, 1)) & (j("line").isNull() | (j("line") >= 1))
                & F.forall(confidences, lambda c: c.isin(CONFIDENCE_ORDER)))
    # Generated rows, one for each line: a filter on what follows is not merged into the parsing,
    # which would parse a line once for each member that is looked at.
    once = F.array(F.struct(F.from_json(t, LOCK_LINE).alias("j"), F.from_json(t, "map<string,variant>").alias("members")))
    parsed = raw.select(t.alias("raw"), F.inline_outer(once))
    reason = (F.when(contains_secret("raw"), "contains a secret")
               .when(~json_ok("raw"), "not valid JSON")
               .when(F.col("j.lockfileVersion") != SCHEMA_VERSION, "unsupported lockfileVersion")
               .when(~F.coalesce(F.array_min(F.array(*[F.col(f"j.{c}").isNotNull() for c in REQUIRED])), F.lit(False)),
                     "schema validation failed")
               .when(~F.coalesce(in_range & _types_ok(F.col("members")), F.lit(False)), "schema validation failed"))
    checked = parsed.withColumn("reason", reason)
    good = checked.filter(F.col("reason").isNull()).select("j.*")
    rejects = checked.filter(F.col("reason").isNotNull()).select(F.col("raw").alias("line"), "reason")
    return good, rejects


def lock_lines(records: DataFrame, generated_at: str, policy: DataFrame | None = None, registry_digest: str | None = None) -> DataFrame:
    """Lock records (``operators.lock.lock_records``: dependency columns, ``facts``, evidence,
    and what ``operators.occurrences.with_occurrences`` adds) -> lock line structs. ``policy``
    gives each scope's config digest. Columns that the records lack are null."""
    has = lambda c, kind: F.col(c) if c in records.columns else F.lit(None).cast(kind)
    if policy is not None:
        records = records.join(policy.select("scope", "config_digest"), "scope", "left")
    return records.select(F.struct(
        F.lit(SCHEMA_VERSION).alias("lockfileVersion"), F.lit(generated_at).alias("generatedAt"),
        F.lit(GENERATOR_VERSION).alias("generatorVersion"), (has("config_digest", "string") if policy is not None else F.lit(None).cast("string")).alias("configDigest"),
        F.lit(registry_digest).cast("string").alias("registryDigest"),
        F.col("scope"), F.col("entity_key").alias("key"), F.col("provider"), F.col("model_id").alias("modelId"),
        F.col("identifier_kind").alias("identifierKind"), F.col("discovery_confidence").alias("discoveryConfidence"),
        F.col("low_confidence").alias("lowConfidence"), F.col("path"), F.col("line"),
        has("facts", FACTS).cast(FACTS).alias("facts"), has("evidence", T.ArrayType(EVIDENCE)).cast(T.ArrayType(EVIDENCE)).alias("evidence"),
        has("n_occurrences", "long").cast("long").alias("nOccurrences"),
        has("occurrences_digest", "string").alias("occurrencesDigest")).alias("l")).select("l.*")


def lock_records_from_lines(good: DataFrame) -> DataFrame:
    """Validated lock lines back to lock records (the input of ``operators.lock.lock_long``)."""
    return good.select("scope", F.col("key").alias("entity_key"), "provider", F.col("modelId").alias("model_id"),
                       F.col("identifierKind").alias("identifier_kind"),
                       F.col("discoveryConfidence").alias("discovery_confidence"),
                       F.col("lowConfidence").alias("low_confidence"), "path", "line", "facts", "evidence",
                       F.col("nOccurrences").alias("n_occurrences"), F.col("occurrencesDigest").alias("occurrences_digest"))


def scrub_json_text(text) -> Column:
    """X12 on serialized JSON: every secret pattern in the text, and the whole value, of any
    type and however deeply nested, of every member whose key names a secret, become
    [REDACTED]. Members are found by one scan of the text with a count of its brackets."""

    def members(texts: pd.Series) -> pd.Series:  # made here, so that tasks get it by value
        return texts.map(lambda t: None if t is None else redact_members(t, SECRET_KEY_PATTERN, REDACTED))

    # Without a word of such a key, in any case, or an escape that could hide one, no member is
    # redacted; the scrub before puts none of them in.
    text = F.col(text) if isinstance(text, str) else text
    scrubbed, may = scrub_secrets(text), holds_any(text, SECRET_KEY_WORDS.split("|"))
    for part in ["\\", "\u017f", "\u0130", "\u0131", "\u212a"]:  # the last four are letters of them to a search that ignores case
        may = may | text.contains(part)
    return F.coalesce(F.pandas_udf(members, "string")(F.when(may, scrubbed)), scrubbed)


def write_lock(lines: DataFrame, path: str) -> int:
    """Serialize with keys sorted at every level, scrub, refuse if a secret survives;
    returns the number of lines written, as text files packed with gzip (a line is 6 KB of which
    little differs from the line before). Needs a checkpoint folder (``spark.checkpoint.dir``,
    see ``driftgate.session.ensure_checkpoint_dir``)."""
    canonical = [sorted_struct(F.col(f.name), f.dataType).alias(f.name)
                 for f in sorted(lines.schema.fields, key=lambda f: f.name)]
    # Stored once (shared checkpoint folder): the secret check, the write and the count then
    # read the serialized lines instead of recomputing the lock.
    text = lines.select(F.to_json(F.struct(*canonical)).alias("value"))
    text = stored(text.select(scrub_json_text(F.col("value")).alias("value")), "lock-lines", compression="zstd")
    if text.filter(contains_secret("value")).limit(1).count() > 0:
        raise ValueError("Refusing to write lockfile containing secrets")
    # A packed file is read by one task: FILE_LINES bound what it holds.
    text.write.mode("overwrite").options(compression="gzip", maxRecordsPerFile=FILE_LINES).text(path)
    return text.count()
