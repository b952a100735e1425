"""Bindings of the engine's input tables to the shared test tables.

Each binding is a projection of a given table (no made-up rows), so every query's work
grows with the data. The DuckDB oracle SQL for the same bindings lives in
``driftgate.plans.oracle``; the two must describe the same rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgate.functions.identity import identifier_kind, model_key, normalize_provider
from driftgate.schemas import (
    PARSER_VERSIONS, SOURCE_CATALOG, SOURCE_FEED, SOURCE_OFFICIAL, SOURCE_URLS,
)

# Dates of the two snapshots compared by the drift queries, and the staleness window.
APPROVED_AS_OF = "2001-03-01 00:00:00"
CURRENT_AS_OF = "2001-11-05 00:00:00"
STALE_AFTER_DAYS = 300

# Raw provider names, chosen by part key modulo 5; they normalize to the five providers.
RAW_PROVIDERS = ["OpenAI", "Anthropic Claude", "Google Vertex AI", "xAI Grok", "Mistral"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A shared table, scanned as its files are split (``spark.sql.files.maxPartitionBytes``),
    unless these are too few to keep the task slots busy (``spread_few_splits``)."""
    return spread_few_splits(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


def spread_few_splits(df: DataFrame) -> DataFrame:
    """Deal the rows of a scan to all task slots if it has splits for fewer than half of them.
    Such an input is smaller than half the slots times a split, so what is moved is bounded by
    the cluster, not by the data; a large table is never touched."""
    spark = df.sparkSession
    slots = spark.sparkContext.defaultParallelism
    files = df.inputFiles()
    if 2 * len(files) >= slots:
        return df
    size = lambda f: (lambda p: p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).getLen())(
        spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.sparkContext._jvm.java.net.URI(f)))
    split = int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes")))
    splits = sum(max(1, -(-size(f) // split)) for f in files)
    return df.repartition(slots) if 2 * splits < slots else df


def _by_source(src: Column, catalog, feed, official) -> Column:
    return F.when(src == 1, catalog).when(src == 2, feed).otherwise(official)


def part_identity(partkey: Column) -> dict[str, Column]:
    """provider / model id / entity key of one part (one part = one entity)."""
    raw = F.element_at(F.array(*[F.lit(p) for p in RAW_PROVIDERS]), (partkey % 5 + 1).cast("int"))
    model_id = F.when(partkey % 3 == 0, F.concat(F.lit("m"), partkey.cast("string"), F.lit("-20240513"))) \
                .otherwise(F.concat(F.lit("m"), partkey.cast("string")))
    provider = normalize_provider(raw)
    return {"raw_provider": raw, "provider": provider, "model_id": model_id,
            "entity_key": model_key(provider, model_id)}


def observed(spark: SparkSession, sf_dir: str, upto: str | None = None,
             drop_mod: int | None = None) -> DataFrame:
    """B1: every lineitem row is one observation of part ``l_partkey`` by one of three
    sources (``l_suppkey % 3``), fetched at ``l_shipdate``: its key, its place, and the raw
    columns that ``described`` makes the rest of. ``drop_mod`` removes the parts
    with ``l_partkey % drop_mod = 0`` (entities that left every feed)."""
    li = table(spark, sf_dir, "lineitem")
    if drop_mod:
        li = li.filter(F.col("l_partkey") % drop_mod != 0)
    if upto is not None:
        # On the raw column, so the predicate reaches the parquet scan.
        li = li.filter(F.col("l_shipdate") <= F.lit(upto).cast("timestamp_ntz"))
    return _observed(li)


def _observed(li: DataFrame, *more: str) -> DataFrame:
    src = F.col("l_suppkey") % 3
    return li.select(
        *more,
        part_identity(F.col("l_partkey"))["entity_key"].alias("entity_key"),
        _by_source(src, F.lit(SOURCE_CATALOG), F.lit(SOURCE_FEED), F.lit(SOURCE_OFFICIAL)).alias("source_id"),
        F.col("l_shipdate").cast("timestamp").alias("fetched_at"),
        F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_suppkey").alias("obs_seq"),
        "l_partkey", "l_linestatus", "l_tax", "l_discount", "l_quantity", "l_returnflag",
    )


def described(obs: DataFrame) -> DataFrame:
    """``observed`` rows with all the columns of an observation. They follow from the row, so
    they can be made before or after the latest rows are chosen."""
    seq = F.col("obs_seq")
    src, ship, line = seq["l_suppkey"] % 3, seq["l_shipdate"], seq["l_linenumber"]
    feed = src == 2
    ident = part_identity(F.col("l_partkey"))
    retire = F.date_format(F.date_add(F.to_date(ship), (F.lit(120) + F.col("l_partkey") % 4 * 30).cast("int")), "yyyy-MM-dd")
    return obs.select(
        ident["provider"].alias("provider"),
        ident["model_id"].alias("model_id"),
        "entity_key",
        "source_id",
        _by_source(src, F.lit(0), F.lit(1), F.lit(2)).alias("source_ord"),
        _by_source(src, *[F.lit(SOURCE_URLS[s]) for s in (SOURCE_CATALOG, SOURCE_FEED, SOURCE_OFFICIAL)]).alias("source_url"),
        ship.cast("timestamp").alias("fetched_at"),
        F.sha2(F.concat("source_id", F.lit("@"), F.date_format(ship, "yyyy-MM-dd")), 256).alias("source_digest"),
        _by_source(src, *[F.lit(PARSER_VERSIONS[s]) for s in (SOURCE_CATALOG, SOURCE_FEED, SOURCE_OFFICIAL)]).alias("parser_version"),
        F.when(F.col("l_linestatus") == "F", "active").otherwise("deprecated").alias("lifecycle_status"),
        F.when((src != 1) & (F.col("l_linestatus") == "O"), retire).alias("retirement_date"),
        F.when(F.col("l_tax") < 0.04, None).when(F.col("l_discount") >= 0.09, 2.0).otherwise(1.0).cast("double").alias("input_price"),
        F.when(feed | (F.col("l_tax") < 0.02), None).when(F.col("l_quantity") >= 40, 8.0).otherwise(4.0).cast("double").alias("output_price"),
        F.when(feed, None).when(F.col("l_quantity") >= 45, 64000).otherwise(128000).cast("long").alias("context_limit"),
        F.when(feed | (F.col("l_discount") < 0.02), None).when(line >= 5, 4096).otherwise(8192).cast("long").alias("max_output_limit"),
        F.when(~feed, F.col("l_returnflag") != "R").alias("tool_calling"),
        F.when(~feed & (F.col("l_returnflag") != "N"), F.col("l_returnflag") == "A").alias("structured_output"),
        F.when(~feed, F.col("l_tax") >= 0.05).alias("vision"),
        F.when(~feed, identifier_kind(ident["model_id"])).alias("identifier_kind"),
        "obs_seq",
    )


def observations(spark: SparkSession, sf_dir: str, upto: str | None = None,
                 drop_mod: int | None = None) -> DataFrame:
    """B1 with all columns."""
    return described(observed(spark, sf_dir, upto, drop_mod))


def dependencies(spark: SparkSession, sf_dir: str, exclude_mod: int | None = None) -> DataFrame:
    """B2: the dependency list, one per part. Scope = tenant ``p_partkey % 20``. The scenario of
    an update has a previous list without the parts that ``exclude_mod=13`` divides (they are
    new) and a proposed one without those of ``exclude_mod=17`` (they left the feeds)."""
    p = table(spark, sf_dir, "part").select("p_partkey")
    if exclude_mod:
        p = p.filter(F.col("p_partkey") % exclude_mod != 0)
    k = F.col("p_partkey")
    ident = part_identity(k)
    return p.select(
        F.concat(F.lit("tenant-"), (k % 20).cast("string")).alias("scope"),
        ident["entity_key"].alias("entity_key"),
        ident["provider"].alias("provider"),
        ident["model_id"].alias("model_id"),
        identifier_kind(ident["model_id"]).alias("identifier_kind"),
        F.when(k % 11 == 0, 0.55).otherwise(0.9).alias("discovery_confidence"),
        (k % 11 == 0).alias("low_confidence"),
        F.concat(F.lit("svc"), (k % 20).cast("string"), F.lit("/app.py")).alias("path"),
        (k % 50 + 1).cast("int").alias("line"),
    )


def current_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2: the current side, to be ``described``; parts with ``l_partkey % 17 = 0`` have left the feeds."""
    return observed(spark, sf_dir, CURRENT_AS_OF, drop_mod=17)


def approved_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observed(spark, sf_dir, APPROVED_AS_OF)


def drift_observations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """B2: of ``approved_observations`` and ``current_observations``, the rows that their latest
    can be: each source's last of every part, found in one pass for both dates and written once."""
    from driftgate.operators.reconcile import latest_in_views
    from driftgate.session import stored
    li = _raw_lineitem(spark, sf_dir, max(APPROVED_AS_OF, CURRENT_AS_OF))
    views = [_shipped_by(APPROVED_AS_OF), _shipped_by(CURRENT_AS_OF) & (F.col("l_partkey") % 17 != 0)]
    last = stored(latest_in_views(li, views, "l_partkey", lambda df: _observed(df, "view")), "latest")
    approved, current = (last.filter(F.col("view") == i).drop("view") for i in range(2))
    return approved, current


def approved_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``approved_observations`` brought together by part in pieces of bounded size, as raw
    columns, which take half the room of those made of them."""
    return _observed(_raw_lineitem(spark, sf_dir, APPROVED_AS_OF).hint("rebalance", "l_partkey"))


def _shipped_by(at: str) -> Column:
    return F.col("l_shipdate") <= F.lit(at).cast("timestamp_ntz")


def _raw_lineitem(spark: SparkSession, sf_dir: str, upto: str) -> DataFrame:
    raw = ["l_partkey", "l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_linestatus", "l_tax", "l_discount",
           "l_quantity", "l_returnflag"]
    # Not spread: the scan only deals the rows out, the work on them follows.
    li = spark.read.parquet(f"{sf_dir.rstrip('/')}/lineitem.parquet").select(*raw)
    return li.filter(_shipped_by(upto))


# ---------------------------------------------------------------------------- B3 corpus
# Line templates by file type, chosen by o_orderkey % 8 (fixed test content).
PY_LINES = [
    "import openai",
    "from anthropic import Anthropic",
    'r = client.messages.create(model="claude-sonnet-4-20250514")',
    'model = "gpt-4o"',
    'cfg = {"model": "gemini-2.5-pro"}',
    'model_id="grok-3"',
    'model = "src/gpt-4o/x"',
    "x = 1",
]
TS_LINES = [
    'import OpenAI from "openai";',
    'import Anthropic, { HUMAN_PROMPT as hp } from "@anthropic-ai/sdk";',
    'const r = await Anthropic.messages.create({ model: "claude-sonnet-4-20250514", max_tokens: 64 });',
    'const cfg = { model: "gpt-4o" }; // run({ model: "gpt-4.1" })',
    'const c = OpenAI.chat.completions.create({ messages, response_format: { type: "json_schema", json_schema: { schema: { properties: '
    '{ city: { type: "string" }, tags: [{ of: [{ is: ["}"] }] }] } } } }, model: "gpt-4o-mini" });',
    "export const defaults = { fallbackModel: 'gemini-2.5-flash' };",
    'run({ model_id: "src/gpt-4o/x" }); pick(1, { a: { b: { c: { d: { e: 0 } } } }, modelId: "house-model" });',
    "let y = `run(${go({ tools: [], 'model': \"o3-mini\" })})`;",
]
# What those lines hold, by line: calls (id, root name of a member call, the literal), literals
# of properties (key, id, the literal), imports (name, provider).
TS_CALLS = [(2, "claude-sonnet-4-20250514", "Anthropic", '"claude-sonnet-4-20250514"'), (4, "gpt-4o-mini", "OpenAI", '"gpt-4o-mini"'),
            (6, "src/gpt-4o/x", None, '"src/gpt-4o/x"'), (6, "house-model", None, '"house-model"'), (7, "o3-mini", None, '"o3-mini"')]
TS_LITERALS = [(2, "model", "claude-sonnet-4-20250514", '"claude-sonnet-4-20250514"'), (3, "model", "gpt-4o", '"gpt-4o"'),
               (4, "model", "gpt-4o-mini", '"gpt-4o-mini"'), (5, "fallbackModel", "gemini-2.5-flash", "'gemini-2.5-flash'"),
               (7, "model", "o3-mini", '"o3-mini"')]
TS_IMPORTS = [(0, "OpenAI", "openai"), (1, "Anthropic", "anthropic"), (1, "hp", "anthropic")]
ENV_LINES = [
    "OPENAI_MODEL=gpt-4o",
    'ANTHROPIC_MODEL="claude-3-5-sonnet-latest"',
    "GEMINI_MODEL='gemini-2.5-pro'",
    "XAI_MODEL = grok-3",
    "OPENAI_API_KEY=sk-test",
    "GROK_MODEL=src/grok",
    "# comment",
    "CLAUDE_MODEL=claude-opus-4-0",
]
# Items of one list, so that a file of any of them in any order is valid; YAML_BROKEN is not.
YAML_LINES = [
    "- model: gpt-4.1",
    '- {name: a, llm: {model_id: "claude-3-haiku-20240307"}}',
    "- MODEL: 'gemini-1.5-flash'",
    "- name: service",
    "- llm: [{modelId: grok-2}]  # pinned",
    "- model: not-a-model",
    "- - {temperature: 0.2, note: 'model: gpt-4o'}",
    '- "model": o3-mini',
]
YAML_BROKEN = "- temperature: [0.2"
# Hits of those lines: line, key, id.
YAML_HITS = [(0, "model", "gpt-4.1"), (1, "model_id", "claude-3-haiku-20240307"), (2, "MODEL", "gemini-1.5-flash"), (4, "modelId", "grok-2"),
             (7, "model", "o3-mini")]
# Whole documents, chosen by o_orderkey, and their hits: document, key, id.
YAML_DOCS = [
    "services:\n  api:\n    llm:\n      model: gpt-4o   # main\n      retries: 2\n  jobs:\n  - model_id: 'o3-mini'\n    on: true\n",
    "model: gpt-4o\nlimits: {rpm: 5, inner: {MODEL: claude-3-opus-latest,\n  list: [1, {modelId: grok-3}]}}\n",
    "note: |\n  model: gpt-4o\n  text\nmodel: gemini-2.5-pro\n",
    "model: gpt-4o\n  model_id: o3\n",
    "model: gpt-4o\nmodel: o3\n",
    "a:\n\tmodel: gpt-4o\n",
    "---\n'model': \"gpt-4o-2024-08-06\"\nurl: http://x.example/#model\n",
    "model: gpt-4o\n---\nmodel: o3\n",
]
YAML_DOC_HITS = [(0, "model", "gpt-4o"), (0, "model_id", "o3-mini"), (1, "model", "gpt-4o"), (1, "MODEL", "claude-3-opus-latest"),
                 (1, "modelId", "grok-3"), (2, "model", "gemini-2.5-pro"), (6, "model", "gpt-4o-2024-08-06")]
FILE_EXTS = [".py", ".ts", ".env.example", ".yaml"]
JSON_KEYS = ["model", "model_id", "Model"]
JSON_IDS = ["gpt-4o", "claude-3-5-sonnet-20241022", "gemini-2.5-pro", "grok-3", "o3-mini",
            "text-embedding-3-small", "not a model", "gpt-4o-2024-08-06"]


def _pick(values: list[str], idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order is one line of its customer's file; the file type and the repository
    (scope) come from the customer key. Some files sit in skipped directories."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    kind = c % 4
    sub = F.when(c % 10 == 7, "node_modules/").when(c % 10 == 8, ".cache/").otherwise("")
    text = (F.when(kind == 0, _pick(PY_LINES, k % 8)).when(kind == 1, _pick(TS_LINES, k % 8))
             .when(kind == 2, _pick(ENV_LINES, k % 8)).when((c % 40 == 3) & (k % 8 == 6), YAML_BROKEN).otherwise(_pick(YAML_LINES, k % 8)))
    return o.select(F.concat(F.lit("repo-"), (c % 20).cast("string")).alias("scope"),
                    F.concat(F.lit("src/"), sub, F.lit("f"), c.cast("string"), _pick(FILE_EXTS, kind)).alias("path"),
                    k.alias("o_orderkey"), text.alias("text"))


def code_lines(spark: SparkSession, sf_dir: str, keep_skipped: bool = False) -> DataFrame:
    """B3 line table (scope, path, line, text); lines are numbered by order key within a
    file with a bounded-partition row number."""
    from driftgate.operators.discovery import path_kept
    from driftgate.operators.segmented import segmented_row_number
    f = code_files(spark, sf_dir)
    if not keep_skipped:
        f = f.filter(path_kept("path"))
    return segmented_row_number(f, ["scope", "path"], "o_orderkey", "line").select("scope", "path", "line", "text")


def json_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B3 JSON documents: one small config file per order; every ninth is truncated."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    body = F.concat(F.lit('{"service": "s'), k.cast("string"), F.lit('", "llm": {"'), _pick(JSON_KEYS, k % 3),
                    F.lit('": "'), _pick(JSON_IDS, k % 8), F.lit('"}, "retries": '), (k % 5).cast("string"))
    content = F.when(k % 9 == 0, body).otherwise(F.concat(body, F.lit("}")))
    return o.select(F.concat(F.lit("repo-"), (c % 20).cast("string")).alias("scope"),
                    F.concat(F.lit("conf/o"), k.cast("string"), F.lit(".json")).alias("path"),
                    content.alias("content"))


def yaml_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B3 YAML documents: one config file per order, nested or broken in different ways."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    k = F.col("o_orderkey")
    return o.select(F.concat(F.lit("repo-"), (F.col("o_custkey") % 20).cast("string")).alias("scope"),
                    F.concat(F.lit("conf/o"), k.cast("string"), F.lit(".yaml")).alias("path"), _pick(YAML_DOCS, k % len(YAML_DOCS)).alias("content"))


# ---------------------------------------------------------------------------- landing bodies
# Raw feed bodies rendered from the lineitem observations of each source: one body per
# fetch (row). Parsing them back must give the B1 values.

def _li_source(spark: SparkSession, sf_dir: str, src: int) -> DataFrame:
    return table(spark, sf_dir, "lineitem").filter(F.col("l_suppkey") % 3 == src)


def catalog_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog bodies: models as an object keyed by id (odd line numbers) or as an array."""
    li = _li_source(spark, sf_dir, 1)
    k = F.col("l_partkey")
    ident = part_identity(k)
    raw = ident["raw_provider"]
    status = F.when(F.col("l_returnflag") == "A", "beta").when(F.col("l_returnflag") == "R", "deprecated")
    mods = (F.when(F.col("l_tax") >= 0.05, F.struct(F.array(F.lit("text"), F.lit("image")).alias("input")))
             .when(F.col("l_tax") >= 0.02, F.struct(F.array(F.lit("text")).alias("input"))))
    base = [status.alias("status"), (F.col("l_discount") >= 0.05).alias("attachment"),
            (F.col("l_returnflag") != "R").alias("tool_call"),
            F.when(F.col("l_returnflag") != "N", F.col("l_returnflag") == "A").alias("structured_output"),
            F.struct(F.when(F.col("l_tax") < 0.04, None).when(F.col("l_discount") >= 0.09, 2.0).otherwise(1.0).cast("double").alias("input"),
                     F.when(F.col("l_tax") < 0.02, None).when(F.col("l_quantity") >= 40, 8.0).otherwise(4.0).cast("double").alias("output")).alias("cost"),
            F.struct(F.when(F.col("l_quantity") >= 45, 64000).otherwise(128000).cast("long").alias("context"),
                     F.when(F.col("l_discount") < 0.02, None).when(F.col("l_linenumber") >= 5, 4096).otherwise(8192).cast("long").alias("output")).alias("limit"),
            mods.alias("modalities")]
    mid = ident["model_id"]
    keyed = F.to_json(F.create_map(raw, F.struct(raw.alias("name"), F.create_map(mid, F.struct(
        F.when(F.col("l_linenumber") % 3 != 0, mid).alias("id"), *base)).alias("models"))))
    listed = F.to_json(F.create_map(raw, F.struct(raw.alias("name"), F.array(F.struct(
        mid.alias("name"), *base)).alias("models"))))
    body = F.when(F.col("l_linenumber") % 2 == 1, keyed).otherwise(listed)
    # Some have no identity: a model without a name, a provider without models, one that is no object.
    k53 = F.col("l_orderkey") % 53
    body = (F.when(k53 == 0, F.to_json(F.create_map(raw, F.struct(F.create_map(F.lit(""), F.struct(status.alias("status"))).alias("models")))))
            .when(k53 == 1, F.to_json(F.create_map(raw, F.struct(raw.alias("name")))))
            .when(k53 == 2, F.to_json(F.create_map(raw, mid))).otherwise(body))
    return li.select(F.lit(SOURCE_CATALOG).alias("source_id"), body.alias("body"),
                     F.col("l_shipdate").cast("timestamp").alias("fetched_at"), "l_orderkey", "l_linenumber")


def feed_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deprecation feed bodies: one item per fetch."""
    li = _li_source(spark, sf_dir, 2)
    k = F.col("l_partkey")
    ident = part_identity(k)
    ship = F.col("l_shipdate")
    retire = F.date_format(F.date_add(F.to_date(ship), (F.lit(120) + k % 4 * 30).cast("int")), "yyyy-MM-dd")
    named = F.when(F.col("l_orderkey") % 53 == 0, "").when(F.col("l_orderkey") % 53 != 1, ident["model_id"])  # some have no identity
    dep = F.struct(ident["raw_provider"].alias("provider"), named.alias("model_id"),
                   F.when(F.col("l_linestatus") == "O", retire).alias("shutdown_date"),
                   F.date_format(ship, "yyyy-MM-dd").alias("deprecation_date"),
                   F.when(F.col("l_returnflag") == "R", "retired").when(F.col("l_returnflag") == "A", "shutdown")
                    .otherwise("deprecated").alias("status"))
    item = F.struct(F.concat(F.lit("d"), F.col("l_orderkey").cast("string")).alias("id"),
                    F.lit("Model deprecation").alias("title"), dep.alias("_deprecation"))
    body = F.to_json(F.struct(F.lit("1").alias("version"), F.array(item).alias("items")))
    return li.select(F.lit(SOURCE_FEED).alias("source_id"), body.alias("body"),
                     ship.cast("timestamp").alias("fetched_at"), "l_orderkey", "l_linenumber")


def pack_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Official pack bodies; a record with an unknown lifecycle value ('sunset', on
    open lines returned as 'N') makes its whole pack invalid."""
    li = _li_source(spark, sf_dir, 0)
    k = F.col("l_partkey")
    ident = part_identity(k)
    ship = F.col("l_shipdate")
    life = (F.when((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "N"), "sunset")
             .when(F.col("l_linestatus") == "F", "active").otherwise("deprecated"))
    m = F.struct(ident["raw_provider"].alias("provider"), ident["model_id"].alias("modelId"), life.alias("lifecycleStatus"),
                 F.when(F.col("l_tax") < 0.04, None).when(F.col("l_discount") >= 0.09, 2.0).otherwise(1.0).cast("double").alias("inputPricePerMillion"),
                 F.when(F.col("l_quantity") >= 45, 64000).otherwise(128000).cast("long").alias("contextLimit"),
                 (F.col("l_returnflag") != "R").alias("toolCalling"))
    body = F.to_json(F.struct(F.lit(1).alias("schemaVersion"), F.date_format(ship, "yyyy-MM-dd").alias("updatedAt"),
                              F.array(m).alias("models")))
    return li.select(F.lit(SOURCE_OFFICIAL).alias("source_id"), body.alias("body"),
                     ship.cast("timestamp").alias("fetched_at"), "l_orderkey", "l_linenumber")


#: Parts in one page of a complete list.
PAGE = 500


def listing_landing(spark: SparkSession, sf_dir: str, at: str, drop_mod: int | None = None) -> DataFrame:
    """What a fetch of every source at time ``at`` brings: its complete list of parts (the
    last observation of each, without those that ``drop_mod`` divides), in pages of a range of
    part keys, one body for each page."""
    li = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit(at).cast("timestamp_ntz"))
    if drop_mod:
        li = li.filter(F.col("l_partkey") % drop_mod != 0)
    last = li.withColumn("src", F.col("l_suppkey") % 3).groupBy("l_partkey", "src").agg(F.max(F.struct(
        "l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_suppkey", "l_linestatus", "l_tax", "l_discount",
        "l_quantity", "l_returnflag")).alias("o")).select("l_partkey", "src", "o.*")
    k = F.col("l_partkey")
    ident = part_identity(k)
    retire = F.when(F.col("l_linestatus") == "O", F.date_format(
        F.date_add(F.to_date("l_shipdate"), (F.lit(120) + k % 4 * 30).cast("int")), "yyyy-MM-dd"))
    life = F.when(F.col("l_linestatus") == "F", "active").otherwise("deprecated")
    in_price = F.when(F.col("l_tax") < 0.04, None).when(F.col("l_discount") >= 0.09, 2.0).otherwise(1.0).cast("double")
    out_price = F.when(F.col("l_tax") < 0.02, None).when(F.col("l_quantity") >= 40, 8.0).otherwise(4.0).cast("double")
    context = F.when(F.col("l_quantity") >= 45, 64000).otherwise(128000).cast("long")
    longest = F.when(F.col("l_discount") < 0.02, None).when(F.col("l_linenumber") >= 5, 4096).otherwise(8192).cast("long")
    tools = F.col("l_returnflag") != "R"
    structured = F.when(F.col("l_returnflag") != "N", F.col("l_returnflag") == "A")
    sees = F.col("l_tax") >= 0.05
    page = [F.floor(k / PAGE).alias("page"), "src"]
    catalog = last.filter("src = 1").select(*page, ident["raw_provider"].alias("p"), F.struct(
        ident["model_id"].alias("id"), life.alias("status"), F.struct(in_price.alias("input"), out_price.alias("output")).alias("cost"),
        F.struct(context.alias("context"), longest.alias("output")).alias("limit"), tools.alias("tool_call"),
        structured.alias("structured_output"), sees.alias("attachment")).alias("m"))
    catalog = catalog.groupBy("page", "src", "p").agg(F.collect_list("m").alias("models")).groupBy("page", "src").agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("p", F.struct(F.col("p").alias("name"), "models"))))).alias("body"))
    feed = last.filter("src = 2").select(*page, F.struct(ident["model_id"].alias("id"), F.struct(
        ident["raw_provider"].alias("provider"), ident["model_id"].alias("model_id"), retire.alias("shutdown_date"),
        F.lit("deprecated").alias("status")).alias("_deprecation")).alias("m"))
    feed = feed.groupBy("page", "src").agg(F.to_json(F.struct(F.lit("1").alias("version"), F.collect_list("m").alias("items"))).alias("body"))
    pack = last.filter("src = 0").select(*page, F.struct(
        ident["raw_provider"].alias("provider"), ident["model_id"].alias("modelId"), life.alias("lifecycleStatus"), retire.alias("retirementDate"),
        in_price.alias("inputPricePerMillion"), out_price.alias("outputPricePerMillion"), context.alias("contextLimit"),
        longest.alias("maxOutputLimit"), tools.alias("toolCalling"), structured.alias("structuredOutput"), sees.alias("vision"),
        identifier_kind(ident["model_id"]).alias("identifierKind")).alias("m"))
    pack = pack.groupBy("page", "src").agg(F.to_json(F.struct(
        F.lit(1).alias("schemaVersion"), F.lit(at[:10]).alias("updatedAt"), F.collect_list("m").alias("models"))).alias("body"))
    source_id = _by_source(F.col("src"), F.lit(SOURCE_CATALOG), F.lit(SOURCE_FEED), F.lit(SOURCE_OFFICIAL))
    return catalog.unionByName(feed).unionByName(pack).select(
        source_id.alias("source_id"), "body", F.to_timestamp(F.lit(at)).alias("fetched_at"))


#: What is appended to a document's text, by doc_id modulo 13 (fixed test content); the first
#: half holds secrets, the rest comes close.
PLANTED = [" sk-" + "k" * 20, " Bearer " + "b" * 10 + "." + "B" * 10, " xai-" + "x" * 24, " AIza" + "Y" * 20, " API_KEY = 'v'", ' token: "s3cret"',
           " sk-" + "k" * 19, " Bearers " + "b" * 30, " apikey: v", " tokens = 5"]


def planted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, some with something that is, or nearly is, a secret at the end."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.select("doc_id", F.concat("text", F.coalesce(F.get(F.array(*[F.lit(p) for p in PLANTED]), (F.col("doc_id") % 13).cast("int")), F.lit(""))).alias("text"))


def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the pages' urls, some of them on the allowlist or nearly so."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    k, rest = F.col("page_id") % 9, F.regexp_extract("url", "://[^/]*(.*)$", 1)
    url = (F.when(k == 0, F.concat(F.lit("https://models.dev"), rest)).when(k == 1, F.concat(F.lit("HTTPS://WWW.Deprecations.INFO:443"), rest))
           .when(k == 2, F.concat(F.lit("http://models.dev"), rest)).when(k == 3, F.concat(F.lit("https://models.dev.example.com"), rest))
           .when(k == 4, "models.dev").when(k == 5, F.concat(F.lit("https://u@models.dev"), rest)).when(k != 6, F.col("url")))
    return p.select("page_id", url.alias("url"))


def event_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4 landing rows from events: each event's JSON props is one fetched body of source
    ``event_type``; events with ``event_id % 97 = 0`` arrive truncated (corrupt)."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", "props")
    body = F.when(F.col("event_id") % 97 == 0, F.expr("substring(props, 2)")).otherwise(F.col("props"))
    return e.select("event_id", F.col("event_type").alias("source_id"), body.alias("body"),
                    F.col("ts").cast("timestamp").alias("fetched_at"))


def policy_overrides(scopes: DataFrame) -> DataFrame:
    """S12 overrides per tenant, by a rule on the tenant number (so every branch of the
    rules is exercised): deny aliases and a 30-day window for 0-4, single-source blocking
    for 5-9, fail on warnings for 10-14, stale sources fail and vision removal counts for
    15+, aliases allowed for 18+, a 50% input price limit for odd tenants, context and
    structured-output rules off for tenants 7 and 8."""
    n = F.split(F.col("scope"), "-").getItem(1).cast("int")
    return scopes.select("scope").distinct().select(
        "scope",
        F.when(n < 5, "deny").when(n >= 18, "allow").otherwise("warn").alias("floating_aliases"),
        F.when(n < 5, 30).otherwise(90).alias("retirement_window_days"),
        F.when(n % 2 == 1, 50.0).otherwise(15.0).alias("max_input_price_increase_percent"),
        (n != 7).alias("fail_on_context_decrease"),
        (n != 8).alias("fail_on_structured_output_removal"),
        (n >= 15).alias("fail_on_vision_removal"),
        F.when(n >= 15, "fail").otherwise("warn").alias("stale_source_behavior"),
        F.when((n >= 5) & (n <= 9), "single-source").otherwise("official-verified").alias("min_blocking_confidence"),
        ((n >= 10) & (n <= 14)).alias("fail_on_warn"),
        (n == 3).alias("allow_network"),
        F.when(n == 4, 30).otherwise(7).alias("stale_after_days"),
        F.when(n < 2, 1024).otherwise(8 * 1024 * 1024).alias("max_bytes"),
    )


#: Files of a part of a tree (a file takes a block, 4 KB or so, however small), and parts that lie on
#: disk at a time. Files of a short life cost a disk little: most are removed before their blocks
#: are allocated, while to remove a million later took 115 s.
TREE_FILES, TREES = 1 << 16, 3


def tree_parts(spark: SparkSession, sf_dir: str, files: int | None = None) -> int:
    """In how many parts of about ``files`` files the tree of ``written_tree`` is written."""
    o = table(spark, sf_dir, "orders")
    n = o.agg(F.count(F.lit(1)) + F.countDistinct("o_custkey")).first()[0]
    return max(1, -(-n // (files or TREE_FILES)))


def tree_files(spark: SparkSession, sf_dir: str, parts: int) -> list[DataFrame]:
    """The code files and JSON documents of B3 as (path, content), made once and stored by part:
    every file belongs to one of ``parts``, by a hash of its path."""
    from driftgate.operators.segmented import segmented_row_number
    from driftgate.session import shared_dir
    lines = segmented_row_number(code_files(spark, sf_dir), ["scope", "path"], "o_orderkey", "line")
    ordered = F.array_sort(F.collect_list(F.struct("line", "text")))
    code = lines.groupBy("scope", "path").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("content"))
    files = code.unionByName(json_docs(spark, sf_dir)).select(F.concat("scope", F.lit("/"), "path").alias("path"), "content")
    part = F.pmod(F.xxhash64("path"), F.lit(parts)).cast("int")
    where = shared_dir(spark, f"tree-files-{uuid.uuid4().hex}")
    files.withColumn("part", part).hint("rebalance", "part").write.partitionBy("part").parquet(where)
    stored = spark.read.schema("path string, content string, part int").parquet(where)
    return [stored.filter(F.col("part") == i).select("path", "content") for i in range(parts)]


def written_tree(files: DataFrame, root: str) -> DataFrame:
    """``files`` (path, content) written as a source tree below ``root`` (one folder for each
    repository), each task writing its own files; returns their paths."""
    from driftgate.operators.discovery import write_files
    from driftgate.session import stored
    slots = files.sparkSession.sparkContext.defaultParallelism
    # Dealt by path: tasks that make files in the same folder wait for one another.
    return stored(files.repartitionByRange(2 * slots, "path").mapInPandas(write_files(root), "path string"), "written")
