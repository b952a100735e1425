"""Feed normalizers: raw bodies -> observations.

Raw bodies arrive as a landing table ``(source_id, body, fetched_at)`` (one row per fetch;
no network access here). Each normalizer parses with an explicit schema via ``from_json``
and flattens with ``explode``; all of them produce the observation schema so they can be
``unionByName``-ed (S5). A body that does not parse gives no rows and a failed status (S4).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftgate.functions.feedmaps import catalog_lifecycle, feed_lifecycle, feed_retirement_date, vision_flag
from driftgate.functions.identity import identifier_kind, model_key, normalize_provider
from driftgate.functions.jsontext import json_ok
from driftgate.schemas import (
    LIFECYCLE_STATES, OBSERVATION, PARSER_VERSION, PARSER_VERSIONS, SOURCE_CATALOG, SOURCE_FEED, SOURCE_OFFICIAL,
    SOURCE_ORDER, SOURCE_URLS,
)

CATALOG_MODEL = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("status", T.StringType()), T.StructField("attachment", T.BooleanType()),
    T.StructField("tool_call", T.BooleanType()), T.StructField("structured_output", T.BooleanType()),
    T.StructField("cost", T.StructType([T.StructField("input", T.DoubleType()), T.StructField("output", T.DoubleType())])),
    T.StructField("limit", T.StructType([T.StructField("context", T.LongType()), T.StructField("output", T.LongType())])),
    T.StructField("modalities", T.StructType([T.StructField("input", T.ArrayType(T.StringType()))])),
])
# ``models`` is kept as raw JSON text: it is either an object keyed by id or an array.
CATALOG = T.MapType(T.StringType(), T.StructType([
    T.StructField("id", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("models", T.StringType()),
]))
FEED = T.StructType([
    T.StructField("version", T.StringType()),
    T.StructField("items", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()), T.StructField("title", T.StringType()),
        T.StructField("url", T.StringType()), T.StructField("date_published", T.StringType()),
        T.StructField("_deprecation", T.StructType([
            T.StructField("provider", T.StringType()), T.StructField("model_id", T.StringType()),
            T.StructField("shutdown_date", T.StringType()), T.StructField("deprecation_date", T.StringType()),
            T.StructField("status", T.StringType()),
        ])),
    ]))),
])
PACK_MODEL = T.StructType([
    T.StructField("provider", T.StringType()), T.StructField("modelId", T.StringType()),
    T.StructField("lifecycleStatus", T.StringType()), T.StructField("retirementDate", T.StringType()),
    T.StructField("inputPricePerMillion", T.DoubleType()), T.StructField("outputPricePerMillion", T.DoubleType()),
    T.StructField("contextLimit", T.DoubleType()), T.StructField("maxOutputLimit", T.DoubleType()),
    T.StructField("toolCalling", T.BooleanType()), T.StructField("structuredOutput", T.BooleanType()),
    T.StructField("vision", T.BooleanType()), T.StructField("identifierKind", T.StringType()),
    T.StructField("evidenceUrl", T.StringType()),
])
PACK = T.StructType([
    T.StructField("schemaVersion", T.IntegerType()), T.StructField("updatedAt", T.StringType()),
    T.StructField("models", T.ArrayType(PACK_MODEL)),
])


def body_status(landing: DataFrame) -> DataFrame:
    """Per fetched body: accepted or not, sha-256 of the raw text (of '' on failure),
    parser version and a warning for a failed source. A body is accepted if it is JSON and,
    for the official source, a valid pack."""
    good_json = json_ok("body")
    ok = good_json & ((F.col("source_id") != SOURCE_OFFICIAL) | pack_ok(F.col("body")))
    versions = F.create_map(*[x for sid, v in PARSER_VERSIONS.items() for x in (F.lit(sid), F.lit(v))])
    return landing.select(
        "*", ok.alias("ok"),
        F.when(ok, F.sha2("body", 256)).otherwise(F.sha2(F.lit(""), 256)).alias("source_digest"),
        F.coalesce(F.try_element_at(versions, F.col("source_id")), F.lit(PARSER_VERSION)).alias("parser_version"),
        F.when(~ok, F.concat(F.col("source_id"), F.when(good_json, " fetch failed: pack is not valid")
                             .otherwise(" fetch failed: body is not valid JSON"))).alias("warning"))


# Columns of a fetch that go with each of its observations. The body itself does not: it is
# hashed and parsed once, before anything is exploded: in a ``select`` of its own, as what stands
# beside an ``explode`` is computed for each of its rows.
FETCH = ["source_digest", "fetched_at"]


def _meta(source_id: str) -> list[Column]:
    return [F.lit(source_id).alias("source_id"), F.lit(SOURCE_ORDER.index(source_id)).alias("source_ord"),
            F.lit(SOURCE_URLS[source_id]).alias("source_url"),
            F.lit(PARSER_VERSIONS[source_id]).alias("parser_version")]


def _observation(df: DataFrame, extra: list[str] | None = None) -> DataFrame:
    cols = [F.col(f.name).cast(f.dataType).alias(f.name) for f in OBSERVATION.fields]
    return df.select(*cols, *(extra or []), "item_pos")


def _position(outer: str | None, inner: str) -> Column:
    """The item's place in its body, in reading order: a later item of a body wins (A1)."""
    p = F.col(inner).cast("long")
    return (p if outer is None else F.col(outer).cast("long") * F.lit(1 << 32) + p).alias("item_pos")


def parse_catalog(landing: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Catalog body {provider: {id, name, models}} -> one observation per model.

    Models as an object: id, else the map key. Models as an array: id, else name, else the
    position. Missing prices, limits and flags stay null; retirement date is always null."""
    keep = keep or []
    root = landing.filter(json_ok("body")).select(
        *keep, F.sha2("body", 256).alias("source_digest"), "fetched_at", F.map_entries(F.from_json("body", CATALOG)).alias("pes"))
    root = root.select(*keep, *FETCH, F.posexplode("pes").alias("ppos", "pe")).select(*keep, *FETCH, "ppos", F.col("pe.key").alias("pkey"), F.col("pe.value").alias("p"))
    root = root.filter(F.col("p").isNotNull() & F.col("p.models").isNotNull())
    prov = normalize_provider(F.coalesce(F.col("p.id"), F.col("p.name"), F.col("pkey")))
    is_array = F.ltrim(F.col("p.models")).startswith("[")
    as_map = F.from_json(F.col("p.models"), T.MapType(T.StringType(), CATALOG_MODEL))
    as_arr = F.from_json(F.col("p.models"), T.ArrayType(CATALOG_MODEL))
    entries = F.when(is_array, F.transform(as_arr, lambda m, i: F.struct(
        F.coalesce(m["id"], m["name"], i.cast("string")).alias("mkey"), m.alias("m")))) \
        .otherwise(F.transform(F.map_entries(as_map), lambda e: F.struct(
            F.coalesce(e["value"]["id"], e["key"]).alias("mkey"), e["value"].alias("m"))))
    m = root.select(*keep, *FETCH, "ppos", prov.alias("provider"), F.posexplode(entries).alias("mpos", "e"))
    m = m.filter(F.col("e.mkey").isNotNull() & (F.col("e.mkey") != ""))  # F9
    mm = F.col("e.m")
    out = m.select(
        *keep, *FETCH, _position("ppos", "mpos"), "provider", F.col("e.mkey").alias("model_id"),
        model_key(F.col("provider"), F.col("e.mkey")).alias("entity_key"),
        catalog_lifecycle(mm["status"]).alias("lifecycle_status"),
        F.lit(None).cast("string").alias("retirement_date"),
        mm["cost"]["input"].alias("input_price"), mm["cost"]["output"].alias("output_price"),
        mm["limit"]["context"].alias("context_limit"), mm["limit"]["output"].alias("max_output_limit"),
        mm["tool_call"].alias("tool_calling"), mm["structured_output"].alias("structured_output"),
        vision_flag(mm["modalities"]["input"], mm["attachment"]).alias("vision"),
        identifier_kind(F.col("e.mkey")).alias("identifier_kind"),
    ).select("*", *_meta(SOURCE_CATALOG))
    return _observation(out, keep)


def parse_feed(landing: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Deprecation feed items -> observations with only lifecycle and retirement."""
    keep = keep or []
    items = landing.filter(json_ok("body")).select(
        *keep, F.sha2("body", 256).alias("source_digest"), "fetched_at", F.from_json("body", FEED)["items"].alias("its"))
    items = items.select(*keep, *FETCH, F.posexplode("its").alias("mpos", "it"))
    dep = F.col("it._deprecation")
    items = items.filter(dep["model_id"].isNotNull() & (dep["model_id"] != ""))  # F9
    prov = normalize_provider(F.coalesce(dep["provider"], F.lit("unknown")))
    out = items.select(
        *keep, *FETCH, _position(None, "mpos"), prov.alias("provider"), dep["model_id"].alias("model_id"),
        model_key(prov, dep["model_id"]).alias("entity_key"),
        feed_lifecycle(dep["status"], dep["shutdown_date"]).alias("lifecycle_status"),
        feed_retirement_date(dep["shutdown_date"], dep["deprecation_date"]).alias("retirement_date"),
        *[F.lit(None).alias(c) for c in ("input_price", "output_price", "context_limit", "max_output_limit",
                                          "tool_calling", "structured_output", "vision", "identifier_kind")],
    ).select("*", *_meta(SOURCE_FEED))
    return _observation(out, keep)


def pack_model_valid(m: Column) -> Column:
    """S3 schema rule for one pack model: required strings, enum values, integer limits."""
    limits_ok = ((m["contextLimit"].isNull() | (m["contextLimit"] == F.floor(m["contextLimit"])))
                 & (m["maxOutputLimit"].isNull() | (m["maxOutputLimit"] == F.floor(m["maxOutputLimit"]))))
    return (m["provider"].isNotNull() & m["modelId"].isNotNull()
            & (m["lifecycleStatus"].isNull() | m["lifecycleStatus"].isin(LIFECYCLE_STATES))
            & (m["identifierKind"].isNull() | m["identifierKind"].isin("floating", "fixed"))
            & limits_ok)


# S3: the JSON types that each field of a pack model may have (null or absent where optional).
_TEXT, _NUMBER, _FLAG = ["STRING"], ["BIGINT", "DECIMAL", "DOUBLE"], ["BOOLEAN"]
PACK_TYPES = {"provider": _TEXT, "modelId": _TEXT, "lifecycleStatus": _TEXT, "retirementDate": _TEXT, "identifierKind": _TEXT,
              "evidenceUrl": _TEXT, "inputPricePerMillion": _NUMBER, "outputPricePerMillion": _NUMBER, "contextLimit": _NUMBER,
              "maxOutputLimit": _NUMBER, "toolCalling": _FLAG, "structuredOutput": _FLAG, "vision": _FLAG}
PACK_REQUIRED = ("provider", "modelId")


def pack_types_ok(m: Column) -> Column:
    """One pack model as map of variants: every field has a JSON type it may have."""
    ok = F.lit(True)
    for name, types in PACK_TYPES.items():
        kind = F.regexp_extract(F.schema_of_variant(F.try_element_at(m, F.lit(name))), r"^[A-Z]+", 0)
        allowed = kind.isin(types) if name in PACK_REQUIRED else (kind.isNull() | kind.isin([*types, "VOID"]))
        ok = ok & F.coalesce(allowed, F.lit(False))
    url = F.try_variant_get(F.try_element_at(m, F.lit("evidenceUrl")), "$", "string")
    return ok & (url.isNull() | url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:\S+$"))


def pack_ok(body: Column) -> Column:
    """S3: the body is a valid curated pack; one invalid record rejects the whole pack."""
    pk = F.from_json(body, PACK)
    raw = F.from_json(body, "struct<models:array<map<string,variant>>>")["models"]
    valid = (json_ok(body) & (pk["schemaVersion"] == 1) & pk["updatedAt"].isNotNull() & pk["models"].isNotNull()
             & F.forall(pk["models"], pack_model_valid) & raw.isNotNull() & F.forall(raw, pack_types_ok))
    return F.coalesce(valid, F.lit(False))


def parse_pack(landing: DataFrame, keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """S3: curated pack -> (observations, pack status). One invalid record rejects the
    whole pack (checked per body with ``forall``, no shuffle). Rows of ``body_status`` (column
    ``ok``) are not checked again."""
    keep = keep or []
    valid = F.coalesce(F.col("ok"), F.lit(False)) if "ok" in landing.columns else pack_ok(F.col("body"))
    p = landing.select(*keep, F.sha2("body", 256).alias("source_digest"), "fetched_at", F.from_json("body", PACK).alias("pk"),
                       valid.alias("pack_ok"))
    status = p.select(*keep, "pack_ok", F.coalesce(F.size("pk.models"), F.lit(0)).cast("long").alias("n_models"))
    m = p.filter("pack_ok").select(*keep, *FETCH, F.posexplode("pk.models").alias("mpos", "m"))
    mm = F.col("m")
    prov = normalize_provider(mm["provider"])
    out = m.select(
        *keep, *FETCH, _position(None, "mpos"), prov.alias("provider"), mm["modelId"].alias("model_id"),
        model_key(prov, mm["modelId"]).alias("entity_key"),
        mm["lifecycleStatus"].alias("lifecycle_status"), mm["retirementDate"].alias("retirement_date"),
        mm["inputPricePerMillion"].alias("input_price"), mm["outputPricePerMillion"].alias("output_price"),
        mm["contextLimit"].cast("long").alias("context_limit"), mm["maxOutputLimit"].cast("long").alias("max_output_limit"),
        mm["toolCalling"].alias("tool_calling"), mm["structuredOutput"].alias("structured_output"),
        mm["vision"].alias("vision"), mm["identifierKind"].alias("identifier_kind"),
    ).select("*", *_meta(SOURCE_OFFICIAL))
    return _observation(out, keep), status


# The extension point. A source id maps to a normalizer of its landing rows.
# Each normalizer takes (landing rows of its source, extra columns to carry through).
NORMALIZERS: dict[str, Callable[[DataFrame, list[str]], DataFrame]] = {
    SOURCE_CATALOG: parse_catalog,
    SOURCE_FEED: parse_feed,
    SOURCE_OFFICIAL: lambda df, keep: parse_pack(df, keep)[0],
}


def normalize(landing: DataFrame, normalizers: dict[str, Callable[[DataFrame, list[str]], DataFrame]] | None = None,
              seq_col: str | None = None) -> DataFrame:
    """Route each landing row to its source's normalizer and union the observations.
    ``obs_seq`` (input position for A1) is (fetch time, ``seq_col``, place in the body)."""
    normalizers = normalizers or NORMALIZERS
    keep = [seq_col] if seq_col else []
    out = None
    for sid, fn in normalizers.items():
        part = fn(landing.filter(F.col("source_id") == sid), keep)
        out = part if out is None else out.unionByName(part)
    seq = F.struct(F.col("fetched_at"), (F.col(seq_col) if seq_col else F.lit(0)).alias("body_seq"), F.col("item_pos"))
    return out.withColumn("obs_seq", seq).drop(*keep, "item_pos")
