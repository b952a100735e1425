"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame``, and the DuckDB SQL that
computes the same rows. Keys are ``<inventory id>_<name>``; every query reads the shared
tables (or data Spark derives from them) in full."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgate.operators.diff import model_diff
from driftgate.operators.reconcile import latest_per_source, to_long_facts, to_snapshot
from driftgate.plans import bindings as B
from driftgate.plans import drift
from driftgate.plans import oracle as O
from driftgate.session import ensure_checkpoint_dir, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
TS_FMT = "yyyy-MM-dd HH:mm:ss"


def register(name: str, sql: str | None = None):
    """Register a query; the callable first applies the session settings the engine
    relies on (UTC session time zone; a checkpoint folder only if the cluster set none)."""
    def deco(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            ensure_checkpoint_dir(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _fmt(c) -> F.Column:
    return F.date_format(F.col(c) if isinstance(c, str) else c, TS_FMT)


# --------------------------------------------------------------------------- reconcile

@register("a1_latest_per_source", f"""
SELECT entity_key, source_id, source_ord, strftime(fetched_at, '{O.FMT_TS}') AS fetched,
       lifecycle_status, input_price, retirement_date
FROM {O.a1_sql(B.CURRENT_AS_OF)} a""")
def a1_latest_per_source(spark, sf_dir):
    a1 = latest_per_source(B.observed(spark, sf_dir, B.CURRENT_AS_OF), describe=B.described)
    return a1.select("entity_key", "source_id", "source_ord", _fmt("fetched_at").alias("fetched"),
                     "lifecycle_status", "input_price", "retirement_date")


def _fact_view(fact: DataFrame) -> DataFrame:
    return fact.select(
        "entity_key", "field", "field_ord", "confidence", "str_value", "num_value", "bool_value",
        "source_id", _fmt("fetched_at").alias("fetched"),
        F.when(F.col("candidates").isNull(), F.lit(0)).otherwise(F.size("candidates")).cast("long").alias("n_candidates"))


@register("a2_fact_confidence", f"""
SELECT entity_key, field, field_ord, confidence, str_value, num_value, bool_value, source_id,
       strftime(fetched_at, '{O.FMT_TS}') AS fetched, n_candidates
FROM {O.fact_sql(B.CURRENT_AS_OF, B.STALE_AFTER_DAYS)} f""")
def a2_fact_confidence(spark, sf_dir):
    """The long fact table as of the current date."""
    from driftgate.operators.reconcile import reconcile
    return _fact_view(reconcile(B.observed(spark, sf_dir, B.CURRENT_AS_OF), B.CURRENT_AS_OF,
                                B.STALE_AFTER_DAYS, describe=B.described))


@register("a7_snapshot_record", f"""
WITH f AS {O.fact_sql(B.CURRENT_AS_OF, B.STALE_AFTER_DAYS)},
a1 AS {O.a1_sql(B.CURRENT_AS_OF)},
ev AS (SELECT entity_key, count(*) AS n_evidence, string_agg(source_id, ',' ORDER BY source_ord) AS evidence_sources
       FROM a1 GROUP BY entity_key)
SELECT f.entity_key, f.provider, f.model_id, ev.n_evidence, ev.evidence_sources,
  max(CASE WHEN field = 'provider' THEN confidence END) AS provider_confidence,
  max(CASE WHEN field = 'lifecycleStatus' THEN str_value END) AS lifecycle_status,
  max(CASE WHEN field = 'lifecycleStatus' THEN confidence END) AS lifecycle_confidence,
  max(CASE WHEN field = 'inputPricePerMillion' THEN num_value END) AS input_price,
  max(CASE WHEN field = 'inputPricePerMillion' THEN confidence END) AS input_price_confidence,
  max(CASE WHEN field = 'toolCalling' THEN bool_value END) AS tool_calling
FROM f JOIN ev ON f.entity_key = ev.entity_key
GROUP BY f.entity_key, f.provider, f.model_id, ev.n_evidence, ev.evidence_sources""")
def a7_snapshot_record(spark, sf_dir):
    """Wide snapshot records (12 envelopes + evidence), projected flat."""
    latest = latest_per_source(B.observed(spark, sf_dir, B.CURRENT_AS_OF), describe=B.described)
    snap = to_snapshot(latest, B.CURRENT_AS_OF, B.STALE_AFTER_DAYS)
    return snap.select(
        "entity_key", "provider", "model_id",
        F.size("evidence").cast("long").alias("n_evidence"),
        F.array_join(F.transform("evidence", lambda e: e["source_id"]), ",").alias("evidence_sources"),
        F.col("facts.provider.confidence").alias("provider_confidence"),
        F.col("facts.lifecycleStatus.str_value").alias("lifecycle_status"),
        F.col("facts.lifecycleStatus.confidence").alias("lifecycle_confidence"),
        F.col("facts.inputPricePerMillion.num_value").alias("input_price"),
        F.col("facts.inputPricePerMillion.confidence").alias("input_price_confidence"),
        F.col("facts.toolCalling.bool_value").alias("tool_calling"),
    )


# --------------------------------------------------------------------------- drift check

@register("c1_field_diff", f"""
SELECT scope, entity_key, field, kind, a_str, a_num, a_bool, c_str, c_num, c_bool, confidence, blocking_eligible
FROM {O.diff_sql()} d""")
def c1_field_diff(spark, sf_dir):
    """Approved lock vs current facts, field by field."""
    return drift.run(spark, sf_dir).fdiff.select(
        "scope", "entity_key", "field", "kind", "a_str", "a_num", "a_bool", "c_str", "c_num", "c_bool",
        "confidence", "blocking_eligible")


@register("a11_model_diff", f"""
SELECT scope, entity_key, CASE WHEN bool_or(kind <> 'unchanged') THEN 'changed' ELSE 'unchanged' END AS kind
FROM {O.diff_sql()} d GROUP BY scope, entity_key""")
def a11_model_diff(spark, sf_dir):
    return model_diff(drift.run(spark, sf_dir).fdiff)


FINDING_OUT = ["scope", "key", "field", "severity", "code", "message", "path", "line", "confidence"]


@register("p14_findings", f"SELECT {', '.join(FINDING_OUT)} FROM {O.findings_sql()} f")
def p14_findings(spark, sf_dir):
    """Every finding of every scope under the default policy."""
    return drift.run(spark, sf_dir).findings.select(*FINDING_OUT)


@register("a9_gate", f"""
WITH f AS {O.findings_sql()}, s AS (SELECT DISTINCT scope FROM {O.deps_sql()} d)
SELECT s.scope, CAST(count(f.code) FILTER (WHERE f.severity = 'fail') AS BIGINT) AS n_fail,
       CAST(count(f.code) FILTER (WHERE f.severity = 'warn') AS BIGINT) AS n_warn,
       CASE WHEN count(f.code) FILTER (WHERE f.severity = 'fail') > 0 THEN 1 ELSE 0 END AS exit_code
FROM s LEFT JOIN f ON f.scope = s.scope GROUP BY s.scope""")
def a9_gate(spark, sf_dir):
    """fail/warn counts and exit code per scope."""
    return drift.run(spark, sf_dir).gate


# --------------------------------------------------------------------------- discovery

from driftgate.operators import discovery as D  # noqa: E402

HIT_OUT = ["scope", "provider", "model_id", "path", "line", "column", "snippet", "confidence", "kind"]


def _typed(spark, sf_dir, kind: str):
    lines = B.code_lines(spark, sf_dir)
    return lines.filter(D.file_type("path") == kind)


@register("d2_python_hits", f"SELECT {O.HIT_OUT} FROM {O.python_hits_sql()} h")
def d2_python_hits(spark, sf_dir):
    """Python call-site patterns with import-hint carry-forward."""
    return D.scan_python(_typed(spark, sf_dir, "python")).select(*HIT_OUT)


@register("d4_js_hits", f"SELECT {O.HIT_OUT} FROM {O.js_hits_sql()} h")
def d4_js_hits(spark, sf_dir):
    """JS/TS call-site model keys (import aliases) and property literals."""
    return D.scan_js(_typed(spark, sf_dir, "code")).select(*HIT_OUT)


@register("d7_config_hits", f"SELECT {O.HIT_OUT} FROM {O.yaml_hits_sql()} a UNION ALL SELECT {O.HIT_OUT} FROM {O.json_hits_sql()} b "
          f"UNION ALL SELECT {O.HIT_OUT} FROM {O.yaml_doc_hits_sql()} c")
def d7_config_hits(spark, sf_dir):
    """Model keys at any depth of YAML files and JSON documents that parse."""
    yml = D.scan_yaml(D.files_of(_typed(spark, sf_dir, "data"), F.lit(True)))
    docs = D.scan_yaml(B.yaml_docs(spark, sf_dir))
    return yml.unionByName(docs).unionByName(D.scan_json(B.json_docs(spark, sf_dir))).select(*HIT_OUT)


@register("d8_env_hits", f"SELECT {O.HIT_OUT} FROM {O.env_hits_sql()} h")
def d8_env_hits(spark, sf_dir):
    """KEY=value model assignments in .env.example files."""
    return D.scan_env(_typed(spark, sf_dir, "env")).select(*HIT_OUT)


DEP_OUT = ["scope", "entity_key", "provider", "model_id", "identifier_kind", "confidence", "low_confidence",
           "n_occurrences", "path", "line"]


def _discovered(spark, sf_dir):
    return D.discover(B.code_lines(spark, sf_dir), B.json_docs(spark, sf_dir).unionByName(B.yaml_docs(spark, sf_dir)))


@register("d9_dependencies", f"SELECT {', '.join(DEP_OUT)} FROM {O.deps_from_hits_sql()} d")
def d9_dependencies(spark, sf_dir):
    """Every scanner's hits consolidated per (scope, provider, model id)."""
    return _discovered(spark, sf_dir).select(*DEP_OUT)


@register("d11_inventory", f"""
SELECT scope, entity_key AS key, identifier_kind, printf('%.2f', confidence) AS conf, low_confidence,
       path || ':' || line AS location
FROM {O.deps_from_hits_sql()} d""")
def d11_inventory(spark, sf_dir):
    """The scan inventory line per dependency."""
    return D.inventory(_discovered(spark, sf_dir))


@register("f8_low_confidence", f"SELECT scope, entity_key, confidence FROM {O.deps_from_hits_sql()} d WHERE low_confidence")
def f8_low_confidence(spark, sf_dir):
    """F8: dependencies whose best hit is below 0.6."""
    return D.low_confidence(_discovered(spark, sf_dir)).select("scope", "entity_key", "confidence")


@register("s11_corpus", f"""
SELECT scope || '/' || path AS path, CAST(line AS INTEGER) AS line, text FROM {O.code_lines_sql()} l
UNION ALL SELECT scope || '/' || path AS path, 1 AS line, content AS text FROM {O.json_docs_sql()} j""")
def s11_corpus(spark, sf_dir):
    """The derived source tree written as files, listed and read back, as
    numbered lines (skipped directories are not entered)."""
    from concurrent.futures import ThreadPoolExecutor

    from driftgate.sources.manifest import remove

    def written_and_read(files):
        root, lines = _run_dir(spark, "corpus"), _run_dir(spark, "lines")
        written = B.written_tree(files, root)
        D.to_lines(D.read_corpus(spark, root, "project")).select("path", "line", "text").write.parquet(lines)
        D.remove_files(written, root)
        remove(spark, root)
        return lines

    # A few parts' files lie on disk at a time: while one part is listed, another is written.
    with ThreadPoolExecutor(B.TREES) as trees:
        parts = [trees.submit(written_and_read, f) for f in B.tree_files(spark, sf_dir, B.tree_parts(spark, sf_dir))]
        try:
            lines = [part.result() for part in parts]
        finally:  # after a failure no further part is begun
            trees.shutdown(cancel_futures=True)
    return spark.read.schema("path string, line int, text string").parquet(*lines)


_F1_PATH = ("CASE o_custkey % 12 WHEN 0 THEN 'dist/' || path WHEN 1 THEN path || '/build' WHEN 2 THEN 'x/__pycache__/' || path WHEN 3 THEN path || '.min.js' "
            "WHEN 4 THEN 'a.min.css' WHEN 5 THEN 'mydist/' || path WHEN 6 THEN 'min.js/' || path WHEN 7 THEN 'x/coverage' WHEN 8 THEN 'venv2/' || path ELSE path END")


@register("f1_file_routing", f"""
WITH f AS (SELECT DISTINCT scope, {_F1_PATH} AS path FROM (SELECT f0.scope, f0.path, o_custkey FROM {O.code_files_sql()} f0 JOIN orders USING (o_orderkey)) y),
s AS (SELECT scope, path, string_split(path, '/') AS p FROM f)
SELECT scope, path,
  NOT list_has_any(p[1:len(p) - 1], ['node_modules', '.git', 'dist', 'build', '.venv', 'venv', '__pycache__', 'coverage'])
    AND len([x for x in p[1:len(p) - 1] if starts_with(x, '.') OR x IN ({", ".join(O._q(d) for d in D.SKIP_DIR_NAMES)})]) = 0 AS kept,
  NOT list_has_any(p, ['node_modules', '.git', 'dist', 'build', '.venv', 'venv', '__pycache__', 'coverage'])
    AND NOT ends_with(path, '.min.js') AND NOT ends_with(path, '.min.css') AS not_ignored,
  CASE WHEN lower(regexp_extract(path, '(\\.[^./]+)$', 1)) IN ('.js', '.jsx', '.mjs', '.cjs', '.ts', '.tsx', '.mts', '.cts') THEN 'code'
       WHEN lower(regexp_extract(path, '(\\.[^./]+)$', 1)) = '.py' THEN 'python'
       WHEN lower(regexp_extract(path, '(\\.[^./]+)$', 1)) IN ('.json', '.yaml', '.yml') THEN 'data'
       WHEN path LIKE '%.env.example' THEN 'env' END AS file_type
FROM s""")
def f1_file_routing(spark, sf_dir):
    """skipped directories, default ignore globs, and file-type routing."""
    from driftgate.schemas import DEFAULT_IGNORE_GLOBS
    f = B.code_files(spark, sf_dir).join(B.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    f = f.select("scope", F.expr(_F1_PATH).alias("path")).distinct()
    return f.select("scope", "path", D.path_kept("path").alias("kept"),
                    D.not_ignored("path", DEFAULT_IGNORE_GLOBS).alias("not_ignored"),
                    D.file_type("path").alias("file_type"))


# --------------------------------------------------------------------------- text safety

from driftgate.functions import text as X  # noqa: E402
from driftgate.functions.identity import (  # noqa: E402
    infer_provider, is_fixed_model_id, model_key, normalize_provider, parse_model_key,
)


def _secret_any_sql(col: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({col}, {O._q(X._as_group(p))})" for p in X.SECRET_PATTERNS) + ")"


_PLANTED_SQL = "(SELECT doc_id, text || CASE doc_id % 13 " + " ".join(f"WHEN {i} THEN {O._q(p)}" for i, p in enumerate(B.PLANTED)) + " ELSE '' END AS text FROM documents) planted"


@register("x11_secret_documents", f"""
SELECT doc_id, regexp_matches(text, 'sk-[A-Za-z0-9_-]{{20}}') OR regexp_matches(text, 'xai-[A-Za-z0-9_-]{{20}}') OR regexp_matches(text, 'AIza[A-Za-z0-9_-]{{20}}')
         OR regexp_matches(text, '[Bb][Ee][Aa][Rr][Ee][Rr][ \\t\\n\\v\\f\\r]+[A-Za-z0-9._~+/=-]{{20}}')
         OR regexp_matches(text, '[Aa][Pp][Ii][_-]?[Kk][Ee][Yy][ \\t\\n\\v\\f\\r]*[:=][ \\t\\n\\v\\f\\r]*[''"][^''"]+[''"]') AS has_secret,
       regexp_matches(lower(text), '(secret|password|token|apikey|api_key|authorization)[ \\t\\n\\v\\f\\r]*[:=][ \\t\\n\\v\\f\\r]*"[^"]*"') AS has_secret_assignment
FROM {_PLANTED_SQL}""")
def x11_secret_documents(spark, sf_dir):
    """X11: the six secret patterns, and secret key words assigned a quoted value."""
    d = B.planted_documents(spark, sf_dir)
    return d.select("doc_id", X.contains_secret("text").alias("has_secret"),
                    X.contains_secret_assignment("text").alias("has_secret_assignment"))


def _scrub_sql(col: str) -> str:
    out = col
    for p in X.SECRET_PATTERNS:
        out = f"regexp_replace({out}, {O._q(X._as_group(p))}, '[REDACTED]', 'g')"
    return (f"regexp_replace({out}, {O._q('(?i:(' + X.SECRET_KEY_WORDS + ')(' + chr(92) + 's*[:=]' + chr(92) + 's*)' + chr(34) + ')[^' + chr(34) + ']*' + chr(34))}, "
            f"'\\1\\2\"[REDACTED]\"', 'g')")


@register("x12_scrub_documents", f"""
SELECT doc_id, length(s) AS scrubbed_chars, sha256(s) AS scrubbed_sha256,
       CAST((length(s) - length(replace(s, '[REDACTED]', ''))) / 10 AS BIGINT) AS n_redacted
FROM (SELECT doc_id, {_scrub_sql('text')} AS s FROM {_PLANTED_SQL}) d""")
def x12_scrub_documents(spark, sf_dir):
    """Every document with all secret matches and assigned secret values redacted."""
    d = B.planted_documents(spark, sf_dir).select("doc_id", X.scrub_secrets(F.col("text")).alias("s"))
    return d.select("doc_id", F.length("s").cast("long").alias("scrubbed_chars"), F.sha2("s", 256).alias("scrubbed_sha256"),
                    ((F.length("s") - F.length(F.replace("s", F.lit("[REDACTED]"), F.lit("")))) / 10).cast("long").alias("n_redacted"))


def _sanitize_sql(col: str) -> str:
    s = f"regexp_replace({col}, '(?i)<script\\b[^>]*>[\\s\\S]*?</script>', '', 'g')"
    s = f"regexp_replace({s}, '(?i)<style\\b[^>]*>[\\s\\S]*?</style>', '', 'g')"
    s = f"regexp_replace({s}, '</?[a-zA-Z][^>]*>', '', 'g')"
    for ent, ch in X.ENTITIES:
        s = f"replace({s}, {O._q(ent)}, {O._q(ch)})"
    return f"regexp_replace({s}, '[\\x{{0000}}-\\x{{0008}}\\x{{000B}}\\x{{000C}}\\x{{000E}}-\\x{{001F}}\\x{{007F}}]', '', 'g')"


def _line_sql(col: str) -> str:
    return f"trim(regexp_replace({_sanitize_sql(col)}, {O._q(X.JS_WS + '+')}, ' ', 'g'))"


@register("x13_sanitize_pages", f"""
SELECT page_id, length(p) AS printable_chars, sha256(p) AS printable_sha256, contains(p, '<') AS has_lt,
       length(l) AS line_chars, sha256(l) AS line_sha256
FROM (SELECT page_id, {_sanitize_sql('html')} AS p, {_line_sql('html')} AS l FROM pages) x""")
def x13_sanitize_pages(spark, sf_dir):
    """Raw web pages made safe to print, as a block and as one line."""
    p = B.table(spark, sf_dir, "pages").select("page_id", X.sanitize_for_print(F.col("html")).alias("p"),
                                                X.sanitize_line(F.col("html")).alias("l"))
    return p.select("page_id", F.length("p").cast("long").alias("printable_chars"), F.sha2("p", 256).alias("printable_sha256"),
                    F.col("p").contains("<").alias("has_lt"), F.length("l").cast("long").alias("line_chars"),
                    F.sha2("l", 256).alias("line_sha256"))


def _url_sql(col: str) -> str:
    scheme = f"lower(regexp_extract({col}, {O._q(X.URL_SCHEME)}, 1))"
    host = f"lower(regexp_extract({col}, {O._q(X.URL_HOST)}, 1))"
    hosts = ", ".join(f"'{h}'" for h in X.ALLOWED_FETCH_HOSTS)
    invalid = f"({col} IS NULL OR {scheme} = '' OR ({scheme} IN ('http', 'https', 'ftp', 'ws', 'wss') AND {host} = ''))"
    return (f"CASE WHEN {invalid} THEN 'Invalid URL: ' || coalesce({col}, '') "
            f"WHEN {scheme} <> 'https' THEN 'Only HTTPS is allowed (got ' || {scheme} || ':)' "
            f"WHEN {host} NOT IN ({hosts}) THEN 'Hostname not on allowlist: ' || {host} END")


@register("f10_url_allowlist", f"""
SELECT page_id, url, r IS NULL AS ok, r AS reason FROM (SELECT page_id, url, {_url_sql('url')} AS r FROM (
  SELECT page_id, CASE page_id % 9 WHEN 0 THEN 'https://models.dev' || rest WHEN 1 THEN 'HTTPS://WWW.Deprecations.INFO:443' || rest
    WHEN 2 THEN 'http://models.dev' || rest WHEN 3 THEN 'https://models.dev.example.com' || rest WHEN 4 THEN 'models.dev'
    WHEN 5 THEN 'https://u@models.dev' || rest WHEN 6 THEN NULL ELSE url END AS url
  FROM (SELECT page_id, url, regexp_extract(url, '://[^/]*(.*)$', 1) AS rest FROM pages) a) b) p""")
def f10_url_allowlist(spark, sf_dir):
    """the fetch allowlist decision, with the refusal reason, for every page URL."""
    p = B.page_urls(spark, sf_dir)
    return p.select("page_id", "url", X.url_allowed(F.col("url")).alias("a")).select("page_id", "url", "a.ok", "a.reason")


@register("x19_snippets", f"""
SELECT conv_id, turn, substring({O._trim_sql('text')}, 1, 120) AS snippet FROM conversations""")
def x19_snippets(spark, sf_dir):
    """Trimmed, 120-character snippets of every conversation turn."""
    c = B.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return c.select("conv_id", "turn", X.snippet(F.col("text")).alias("snippet"))


def _finding_line_sql() -> str:
    conf = "CASE WHEN confidence IS NOT NULL THEN ' [' || confidence || ']' ELSE '' END"
    loc = ("CASE WHEN path IS NOT NULL AND path <> '' THEN ' @ ' || path || "
           "CASE WHEN line IS NOT NULL THEN ':' || line ELSE '' END ELSE '' END")
    raw = f"upper(severity) || ' ' || code || ' ' || key || '.' || field || {conf} || {loc} || ': ' || message"
    return _line_sql(raw)


@register("x20_finding_lines", f"SELECT scope, key, code, {_finding_line_sql()} AS text FROM {O.findings_sql()} f")
def x20_finding_lines(spark, sf_dir):
    """X20 (+X14): the printable line of every finding."""
    f = drift.run(spark, sf_dir).findings
    return f.select("scope", "key", "code", X.finding_line("severity", "code", "key", "field", "confidence", "path",
                                                           "line", "message").alias("text"))


@register("x1_identity_functions", f"""
SELECT p_partkey, provider, provider || ':' || model_id AS entity_key,
  CASE WHEN strpos(provider || ':' || model_id, ':') > 1 THEN split_part(provider || ':' || model_id, ':', 1) END AS parsed_provider,
  CASE WHEN strpos(provider || ':' || model_id, ':') > 1
       THEN substr(provider || ':' || model_id, strpos(provider || ':' || model_id, ':') + 1) END AS parsed_model_id,
  {O.infer_provider_sql('model_id')} AS inferred_provider, {O.fixed_sql('model_id')} AS is_fixed
FROM (SELECT p_partkey,
        {O.provider_sql(O.pick_sql(B.RAW_PROVIDERS, 'p_partkey % 5'))} AS provider,
        {O.pick_sql(B.JSON_IDS, 'p_partkey % 8')} || CASE WHEN p_partkey % 16 >= 8 THEN '-latest' ELSE '' END AS model_id
      FROM part) p""")
def x1_identity_functions(spark, sf_dir):
    """Provider normalization and inference, fixed-id test, key build and parse."""
    k = F.col("p_partkey")
    p = B.table(spark, sf_dir, "part").select(
        "p_partkey", normalize_provider(B._pick(B.RAW_PROVIDERS, k % 5)).alias("provider"),
        F.concat(B._pick(B.JSON_IDS, k % 8), F.when(k % 16 >= 8, "-latest").otherwise("")).alias("model_id"))
    key = model_key("provider", "model_id")
    parsed = parse_model_key(key)
    return p.select("p_partkey", "provider", key.alias("entity_key"), parsed["provider"].alias("parsed_provider"),
                    parsed["model_id"].alias("parsed_model_id"), infer_provider("model_id").alias("inferred_provider"),
                    is_fixed_model_id("model_id").alias("is_fixed"))


# --------------------------------------------------------------------------- sources

from driftgate.sources import feeds as S  # noqa: E402

_LI_KEYS = ["l_orderkey", "l_linenumber"]


def _li_src_sql(src: int) -> str:
    return f"(SELECT *, {O.part_identity_sql('l_partkey')} FROM lineitem WHERE l_suppkey % 3 = {src}) li"


@register("s1_catalog_feed", f"""
SELECT l_orderkey, l_linenumber, provider || ':' || model_id AS entity_key, model_id,
  CASE l_returnflag WHEN 'A' THEN 'active' WHEN 'R' THEN 'deprecated' ELSE 'unknown' END AS lifecycle_status,
  CAST(CASE WHEN l_tax < 0.04 THEN NULL WHEN l_discount >= 0.09 THEN 2.0 ELSE 1.0 END AS DOUBLE) AS input_price,
  CAST(CASE WHEN l_tax < 0.02 THEN NULL WHEN l_quantity >= 40 THEN 8.0 ELSE 4.0 END AS DOUBLE) AS output_price,
  CAST(CASE WHEN l_quantity >= 45 THEN 64000 ELSE 128000 END AS BIGINT) AS context_limit,
  CAST(CASE WHEN l_discount < 0.02 THEN NULL WHEN l_linenumber >= 5 THEN 4096 ELSE 8192 END AS BIGINT) AS max_output_limit,
  l_returnflag <> 'R' AS tool_calling,
  CASE WHEN l_returnflag <> 'N' THEN l_returnflag = 'A' END AS structured_output,
  CASE WHEN l_tax >= 0.02 THEN (l_tax >= 0.05 OR l_discount >= 0.05) ELSE l_discount >= 0.05 END AS vision,
  {O.kind_sql('model_id')} AS identifier_kind, strftime(l_shipdate, '{O.FMT_TS}') AS fetched
FROM {_li_src_sql(1)} WHERE l_orderkey % 53 > 2""")
def s1_catalog_feed(spark, sf_dir):
    """Catalog bodies (object and array forms) parsed back to observations."""
    o = S.parse_catalog(B.catalog_landing(spark, sf_dir), _LI_KEYS)
    return o.select(*_LI_KEYS, "entity_key", "model_id", "lifecycle_status", "input_price", "output_price",
                    "context_limit", "max_output_limit", "tool_calling", "structured_output", "vision",
                    "identifier_kind", _fmt("fetched_at").alias("fetched"))


@register("s2_deprecation_feed", f"""
SELECT l_orderkey, l_linenumber, provider || ':' || model_id AS entity_key,
  CASE WHEN l_returnflag IN ('R', 'A') THEN 'retired' ELSE 'deprecated' END AS lifecycle_status,
  coalesce(CASE WHEN l_linestatus = 'O'
                THEN strftime(CAST(l_shipdate AS DATE) + CAST(120 + (l_partkey % 4) * 30 AS INTEGER), '%Y-%m-%d') END,
           strftime(l_shipdate, '%Y-%m-%d')) AS retirement_date,
  strftime(l_shipdate, '{O.FMT_TS}') AS fetched
FROM {_li_src_sql(2)} WHERE l_orderkey % 53 > 1""")
def s2_deprecation_feed(spark, sf_dir):
    """Deprecation feed items parsed to lifecycle and retirement date."""
    o = S.parse_feed(B.feed_landing(spark, sf_dir), _LI_KEYS)
    return o.select(*_LI_KEYS, "entity_key", "lifecycle_status", "retirement_date", _fmt("fetched_at").alias("fetched"))


@register("s3_official_pack", f"""
SELECT l_orderkey, l_linenumber, provider || ':' || model_id AS entity_key,
  CASE WHEN l_linestatus = 'F' THEN 'active' ELSE 'deprecated' END AS lifecycle_status,
  CAST(CASE WHEN l_tax < 0.04 THEN NULL WHEN l_discount >= 0.09 THEN 2.0 ELSE 1.0 END AS DOUBLE) AS input_price,
  CAST(CASE WHEN l_quantity >= 45 THEN 64000 ELSE 128000 END AS BIGINT) AS context_limit,
  l_returnflag <> 'R' AS tool_calling
FROM {_li_src_sql(0)} WHERE NOT (l_linestatus = 'O' AND l_returnflag = 'N')""")
def s3_official_pack(spark, sf_dir):
    """S3: curated packs with schema enforcement; one bad record rejects its whole pack."""
    o, _ = S.parse_pack(B.pack_landing(spark, sf_dir), _LI_KEYS)
    return o.select(*_LI_KEYS, "entity_key", "lifecycle_status", "input_price", "context_limit", "tool_calling")


@register("s4_body_status", """
SELECT event_id, source_id, ok, CASE WHEN ok THEN sha256(body) ELSE sha256('') END AS source_digest,
       '1.0.0' AS parser_version,
       CASE WHEN NOT ok THEN source_id || ' fetch failed: body is not valid JSON' END AS warning
FROM (SELECT event_id, event_type AS source_id, body, coalesce(json_valid(body), false) AS ok
      FROM (SELECT *, CASE WHEN event_id % 97 = 0 THEN substring(props, 2) ELSE props END AS body FROM events) e) x""")
def s4_body_status(spark, sf_dir):
    """Per fetched body: valid JSON or not, digest of the raw text, warning."""
    return S.body_status(B.event_landing(spark, sf_dir)).select("event_id", "source_id", "ok", "source_digest",
                                                                "parser_version", "warning")


@register("a8_source_status", """
WITH b AS (SELECT event_id, event_type AS source_id, ts,
                  coalesce(json_valid(CASE WHEN event_id % 97 = 0 THEN substring(props, 2) ELSE props END), false) AS ok
           FROM events),
m AS (SELECT source_id, arg_max(ok, (ts, event_id)) AS ok FROM b GROUP BY source_id)
SELECT bool_or(ok) AS any_ok,
       CASE WHEN NOT bool_or(ok) THEN 'frozen' WHEN bool_and(ok) THEN 'fresh' ELSE 'partial' END AS mode,
       coalesce(string_agg(CASE WHEN NOT ok THEN source_id END, ',' ORDER BY source_id), '') AS failed
FROM m""")
def a8_source_status(spark, sf_dir):
    """The latest fetch of each source decides its status; one row: any source ok,
    the mode (fresh / partial / frozen) and the failed sources."""
    from driftgate.operators.reconcile import source_status
    b = S.body_status(B.event_landing(spark, sf_dir))
    meta = (b.groupBy("source_id").agg(F.max_by(F.struct("ok", "warning"), F.struct("fetched_at", "event_id")).alias("m"))
             .select("source_id", "m.ok", "m.warning"))
    return source_status(meta).select("any_ok", "mode", F.array_join("failed", ",").alias("failed"))


# --------------------------------------------------------------------------- policy variants

POLICY_OUT = ["scope", "floating_aliases", "retirement_window_days", "max_input_price_increase_percent",
              "max_output_price_increase_percent", "fail_on_context_decrease", "fail_on_max_output_decrease",
              "fail_on_tool_calling_removal", "fail_on_structured_output_removal", "fail_on_vision_removal",
              "stale_source_behavior", "min_blocking_confidence", "fail_on_warn", "allow_network", "stale_after_days",
              "timeout_ms", "max_bytes", "config_digest"]


def _override_run(spark, sf_dir):
    deps = B.dependencies(spark, sf_dir)
    return drift.run(spark, sf_dir, B.policy_overrides(deps))


@register("s12_effective_policy", f"SELECT {', '.join(POLICY_OUT)} FROM {O.policy_sql(True)} p")
def s12_effective_policy(spark, sf_dir):
    """Per-scope policy: overrides where given, defaults elsewhere."""
    from driftgate.operators.policy import effective_policy
    deps = B.dependencies(spark, sf_dir)
    return effective_policy(deps, B.policy_overrides(deps)).select(*POLICY_OUT)


@register("p14_findings_overrides", f"SELECT {', '.join(FINDING_OUT)} FROM {O.findings_sql(True)} f")
def p14_findings_overrides(spark, sf_dir):
    """P2-P13 under per-scope overrides (deny, allow, lower blocking floor, vision on...)."""
    return _override_run(spark, sf_dir).findings.select(*FINDING_OUT)


@register("a9_gate_overrides", f"""
WITH f AS {O.findings_sql(True)}, p AS {O.policy_sql(True)}
SELECT p.scope, CAST(count(f.code) FILTER (WHERE f.severity = 'fail') AS BIGINT) AS n_fail,
       CAST(count(f.code) FILTER (WHERE f.severity = 'warn') AS BIGINT) AS n_warn,
       CASE WHEN count(f.code) FILTER (WHERE f.severity = 'fail') > 0
              OR (bool_or(p.fail_on_warn) AND count(f.code) FILTER (WHERE f.severity = 'warn') > 0) THEN 1 ELSE 0 END AS exit_code
FROM p LEFT JOIN f ON f.scope = p.scope GROUP BY p.scope""")
def a9_gate_overrides(spark, sf_dir):
    """A9 with fail-on-warn scopes."""
    return _override_run(spark, sf_dir).gate


# --------------------------------------------------------------------------- publish

from driftgate.operators import documents as DOC  # noqa: E402
from driftgate.operators import publish as P  # noqa: E402
from driftgate.operators import reports as R  # noqa: E402


def _material_sql(f: str) -> str:
    values = ["entity_key", "field", "confidence", "str_value", "printf('%.14e', num_value)", "CAST(bool_value AS VARCHAR)"]
    text = " || ".join(f"coalesce(length({v}) || ':' || {v}, 'n')" for v in values)
    return f"SELECT sha256({text}) AS d, field FROM {f}"


# The two 60-bit halves of a row digest ``d``, as integers (the SQL side of A12).
_H1 = "CAST(('0x' || substr(d, 1, 15)) AS BIGINT)"
_H2 = "CAST(('0x' || substr(d, 16, 15)) AS BIGINT)"


@register("a12_table_digest", f"""
WITH r AS ({_material_sql(O.fact_sql(B.CURRENT_AS_OF, B.STALE_AFTER_DAYS) + ' f')})
SELECT count(*) AS n_rows,
       sha256(count(*) || ':' || CAST(coalesce(sum({_H1}), 0) AS VARCHAR) || ':' || CAST(coalesce(sum({_H2}), 0) AS VARCHAR)) AS digest
FROM r""")
def a12_table_digest(spark, sf_dir):
    """Order- and partition-independent digest of the current facts."""
    from driftgate.operators.reconcile import reconcile
    fact = reconcile(B.observed(spark, sf_dir, B.CURRENT_AS_OF), B.CURRENT_AS_OF, B.STALE_AFTER_DAYS, describe=B.described)
    return P.table_digest(fact)


@register("r2_publish_decision", f"""
WITH o AS ({_material_sql(O.fact_sql(B.APPROVED_AS_OF, B.STALE_AFTER_DAYS) + ' a')}),
n AS ({_material_sql(O.fact_sql(B.CURRENT_AS_OF, B.STALE_AFTER_DAYS, 17) + ' c')}),
so AS (SELECT count(*) AS c, count(*) FILTER (WHERE field = 'provider') AS m, coalesce(sum({_H1}), 0) AS s1,
              coalesce(sum({_H2}), 0) AS s2 FROM o),
sn AS (SELECT count(*) AS c, count(*) FILTER (WHERE field = 'provider') AS m, coalesce(sum({_H1}), 0) AS s1,
              coalesce(sum({_H2}), 0) AS s2 FROM n)
SELECT sha256(so.c || ':' || CAST(so.s1 AS VARCHAR) || ':' || CAST(so.s2 AS VARCHAR)) AS previous_digest,
       sha256(sn.c || ':' || CAST(sn.s1 AS VARCHAR) || ':' || CAST(sn.s2 AS VARCHAR)) AS new_digest,
       so.m AS old_models, sn.m AS new_models,
       sha256(so.c || ':' || CAST(so.s1 AS VARCHAR) || ':' || CAST(so.s2 AS VARCHAR))
         <> sha256(sn.c || ':' || CAST(sn.s1 AS VARCHAR) || ':' || CAST(sn.s2 AS VARCHAR)) AS publish,
       '(none)' AS warnings
FROM so, sn""")
def r2_publish_decision(spark, sf_dir):
    """Material digests of the previous and current snapshot, counts, publish flag."""
    return P.publish_decision(*[to_long_facts(wide) for wide in drift.both_wide(spark, sf_dir)])


@register("r4_last_known_good", f"""
WITH a AS {O.fact_sql(B.APPROVED_AS_OF, B.STALE_AFTER_DAYS)}, c AS {O.fact_sql(B.CURRENT_AS_OF, B.STALE_AFTER_DAYS, 17)}
SELECT entity_key, field, confidence, str_value, num_value, bool_value, 'current' AS origin FROM c
UNION ALL
SELECT entity_key, field, CASE WHEN confidence = 'unavailable' THEN 'unavailable' ELSE 'stale' END, str_value, num_value,
       bool_value, 'last-known-good' FROM a WHERE entity_key NOT IN (SELECT entity_key FROM c)""")
def r4_last_known_good(spark, sf_dir):
    """Entities lost by the current facts carried over from the previous ones as stale."""
    out = P.last_known_good(drift.approved_wide(spark, sf_dir), drift.current_wide(spark, sf_dir))
    return out.select("entity_key", "field", "confidence", "str_value", "num_value", "bool_value", "origin")


@register("r5_fact_invariants", f"""
WITH g AS (SELECT *, CAST(regexp_extract(model_id, '^m([0-9]+)', 1) AS BIGINT) % 97 AS m FROM {O.fact_sql(B.CURRENT_AS_OF, B.STALE_AFTER_DAYS)} f0),
f AS (SELECT * REPLACE (
    CASE WHEN m = 1 AND field = 'inputPricePerMillion' THEN -1.0 WHEN m = 2 AND field = 'contextLimit' THEN 0.5 WHEN m = 4 AND field = 'vision' THEN 3.0 ELSE num_value END AS num_value,
    CASE WHEN m = 3 AND field = 'toolCalling' THEN 'official-verified' WHEN m = 4 AND field = 'vision' THEN 'conflicting' ELSE confidence END AS confidence,
    CASE WHEN m = 5 AND field = 'lifecycleStatus' THEN 'sunset' ELSE str_value END AS str_value,
    CASE WHEN m = 6 AND field = 'retirementDate' THEN NULL ELSE source_id END AS source_id) FROM g),
a1 AS {O.a1_sql(B.CURRENT_AS_OF)},
off AS (SELECT entity_key, max(CASE WHEN source_id = 'official-provider' THEN 1 ELSE 0 END) AS has_official FROM a1 GROUP BY entity_key),
x AS (SELECT f.*, coalesce(off.has_official, 0) AS has_official FROM f LEFT JOIN off USING (entity_key))
SELECT c.check_name AS "check", CAST(count(x.entity_key) AS BIGINT) AS n_violations
FROM (VALUES ('price-negative'), ('limit-not-non-negative-integer'), ('official-without-official-evidence'),
             ('conflicting-with-value'), ('bad-enum'), ('missing-source-meta')) c(check_name)
LEFT JOIN x ON CASE c.check_name
  WHEN 'price-negative' THEN x.field IN ('inputPricePerMillion', 'outputPricePerMillion') AND x.num_value < 0
  WHEN 'limit-not-non-negative-integer' THEN x.field IN ('contextLimit', 'maxOutputLimit') AND (x.num_value < 0 OR x.num_value <> floor(x.num_value))
  WHEN 'official-without-official-evidence' THEN x.confidence = 'official-verified' AND x.has_official = 0
  WHEN 'conflicting-with-value' THEN x.confidence = 'conflicting' AND (x.str_value IS NOT NULL OR x.num_value IS NOT NULL OR x.bool_value IS NOT NULL)
  WHEN 'bad-enum' THEN (x.field = 'lifecycleStatus' AND x.str_value NOT IN ('active', 'deprecated', 'retired', 'unknown'))
       OR (x.field = 'provider' AND coalesce(x.str_value, '') NOT IN ('openai', 'anthropic', 'google', 'xai', 'unknown'))
       OR (x.field = 'identifierKind' AND x.str_value NOT IN ('floating', 'fixed'))
  ELSE x.source_id IS NULL OR x.fetched_at IS NULL END
GROUP BY c.check_name""")
def r5_fact_invariants(spark, sf_dir):
    """Snapshot invariants checked on every fact row; count per check."""
    latest = latest_per_source(B.observed(spark, sf_dir, B.CURRENT_AS_OF), describe=B.described)
    from driftgate.operators.reconcile import classify
    fact = classify(latest, B.CURRENT_AS_OF, B.STALE_AFTER_DAYS)
    m = F.regexp_extract("model_id", "^m([0-9]+)", 1).cast("long") % 97
    spoilt = lambda n, field: (m == n) & (F.col("field") == field)  # noqa: E731  one part in 97 breaks each rule
    fact = fact.withColumns({
        "num_value": F.when(spoilt(1, "inputPricePerMillion"), -1.0).when(spoilt(2, "contextLimit"), 0.5).when(spoilt(4, "vision"), 3.0).otherwise(F.col("num_value")),
        "confidence": F.when(spoilt(3, "toolCalling"), "official-verified").when(spoilt(4, "vision"), "conflicting").otherwise(F.col("confidence")),
        "str_value": F.when(spoilt(5, "lifecycleStatus"), "sunset").otherwise(F.col("str_value")),
        "source_id": F.when(~spoilt(6, "retirementDate"), F.col("source_id"))})
    return P.violation_counts(P.fact_violations(fact, latest))


@register("s8_snapshot_dates", """
SELECT snapshot_date, lag(snapshot_date) OVER (ORDER BY snapshot_date) AS previous_date
FROM (SELECT DISTINCT strftime(date_trunc('month', l_shipdate), '%Y-%m-%d') AS snapshot_date FROM lineitem) d""")
def s8_snapshot_dates(spark, sf_dir):
    """A snapshot published for every month that the observations begin, one of them twice;
    the published dates, each with the previous."""
    from driftgate.sources.snapshots import SnapshotMeta, list_snapshots, write_snapshot, write_snapshots
    path = _run_dir(spark, "snapshots")
    month = F.date_format(F.date_trunc("month", "fetched_at"), "yyyy-MM-dd").alias("snapshot_date")
    obs = B.observations(spark, sf_dir).select(month, "entity_key", "source_id")
    dates = [r["snapshot_date"] for r in obs.select("snapshot_date").distinct().orderBy("snapshot_date").collect()]  # one for each month
    write_snapshots(obs, path, [SnapshotMeta(d, d) for d in dates])
    for d in dates[:1]:
        write_snapshot(obs.filter(F.col("snapshot_date") == d).drop("snapshot_date"), path, SnapshotMeta(d, d))
    return list_snapshots(spark, path)


def _listed(at: str, drop_mod: int | None = None) -> str:
    return O.fact_sql(at, B.STALE_AFTER_DAYS, drop_mod, O.listing_a1_sql(at, drop_mod))


@register("r1_refresh_removals", f"""
SELECT scope, entity_key, field, kind, a_str, a_num, a_bool, c_str, c_num, c_bool, confidence, 'published' AS status
FROM {O.diff_sql(O.lock_sql(facts=_listed(B.APPROVED_AS_OF)), _listed(B.CURRENT_AS_OF, 17))} d""")
def r1_refresh_removals(spark, sf_dir):
    """Two refreshes over complete lists of all sources, the second
    without the parts that left; the lock approved after the first is compared with the
    snapshot after the second, where the departed are unknown."""
    from driftgate.operators.diff import field_diff
    from driftgate.operators.lock import lock_records
    from driftgate.schemas import SNAPSHOT
    from driftgate.sources.snapshots import read_snapshot, refresh
    path = _run_dir(spark, "registry")
    refresh(spark, B.listing_landing(spark, sf_dir, B.APPROVED_AS_OF), path, B.APPROVED_AS_OF[:10], B.APPROVED_AS_OF, B.STALE_AFTER_DAYS)
    approved, _ = read_snapshot(spark, path, SNAPSHOT)
    lock = lock_records(B.dependencies(spark, sf_dir), approved, B.APPROVED_AS_OF)
    done = refresh(spark, B.listing_landing(spark, sf_dir, B.CURRENT_AS_OF, drop_mod=17), path, B.CURRENT_AS_OF[:10], B.CURRENT_AS_OF,
                   B.STALE_AFTER_DAYS)
    current, _ = read_snapshot(spark, path, SNAPSHOT)
    return field_diff(lock, current).select("scope", "entity_key", "field", "kind", "a_str", "a_num", "a_bool", "c_str", "c_num", "c_bool",
                                            "confidence", F.lit(done.status).alias("status"))


# --------------------------------------------------------------------------- reports

@register("t2_sarif_results", f"""
SELECT scope, code AS rule_id, CASE severity WHEN 'fail' THEN 'error' WHEN 'warn' THEN 'warning' ELSE 'note' END AS level,
       {_line_sql('message')} AS message,
       CASE WHEN path IS NOT NULL AND path <> '' THEN replace(path, '\\', '/') END AS uri,
       CASE WHEN path IS NOT NULL AND path <> '' THEN coalesce(line, 1) END AS start_line
FROM {O.findings_sql()} f""")
def t2_sarif_results(spark, sf_dir):
    """SARIF results, flat."""
    return R.sarif_results(drift.run(spark, sf_dir).findings)


@register("a10_sarif_rules", f"""
SELECT scope, code AS rule_id, code AS short_description, {_line_sql('m')} AS full_description
FROM (SELECT scope, code, arg_min(message, (key, field_ord)) AS m FROM {O.findings_sql()} f GROUP BY scope, code) r""")
def a10_sarif_rules(spark, sf_dir):
    """A10: distinct rules per scope with the first message per code."""
    return R.sarif_rules(drift.run(spark, sf_dir).findings)


@register("u1_lock_key_changes", f"""
WITH p AS {O.deps_sql(13)}, n AS {O.deps_sql(17)}
SELECT scope, entity_key, 'added' AS change FROM n WHERE (scope, entity_key) NOT IN (SELECT (scope, entity_key) FROM p)
UNION ALL
SELECT scope, entity_key, 'removed' FROM p WHERE (scope, entity_key) NOT IN (SELECT (scope, entity_key) FROM n)""")
def u1_lock_key_changes(spark, sf_dir):
    """Keys added and removed between the approved and the proposed dependency list."""
    from driftgate.operators.lock import lock_keys_change
    return lock_keys_change(B.dependencies(spark, sf_dir, exclude_mod=13), B.dependencies(spark, sf_dir, exclude_mod=17))


@register("t3_change_summary", f"""
WITH p AS {O.deps_sql(13)}, n AS {O.deps_sql(17)},
f AS {O.findings_sql()},
pc AS (SELECT scope, count(*) AS n_previous FROM p GROUP BY scope),
nc AS (SELECT scope, count(*) AS n_proposed FROM n GROUP BY scope),
ad AS (SELECT scope, count(*) AS n_added FROM n WHERE (scope, entity_key) NOT IN (SELECT (scope, entity_key) FROM p) GROUP BY scope),
rm AS (SELECT scope, count(*) AS n_removed FROM p WHERE (scope, entity_key) NOT IN (SELECT (scope, entity_key) FROM n) GROUP BY scope),
g AS (SELECT scope, count(*) FILTER (WHERE severity = 'fail') AS n_fail, count(*) FILTER (WHERE severity = 'warn') AS n_warn
      FROM f GROUP BY scope)
SELECT coalesce(pc.scope, nc.scope) AS scope, coalesce(n_previous, 0) AS n_previous, coalesce(n_proposed, 0) AS n_proposed,
       coalesce(n_added, 0) AS n_added, coalesce(n_removed, 0) AS n_removed, coalesce(n_fail, 0) AS n_fail,
       coalesce(n_warn, 0) AS n_warn
FROM pc FULL JOIN nc ON pc.scope = nc.scope
LEFT JOIN ad ON ad.scope = coalesce(pc.scope, nc.scope) LEFT JOIN rm ON rm.scope = coalesce(pc.scope, nc.scope)
LEFT JOIN g ON g.scope = coalesce(pc.scope, nc.scope)""")
def t3_change_summary(spark, sf_dir):
    """T3 (+U1, A9): per scope: previous/proposed counts, added/removed keys, preview counts."""
    from driftgate.operators.lock import lock_keys_change
    prev, prop = B.dependencies(spark, sf_dir, exclude_mod=13), B.dependencies(spark, sf_dir, exclude_mod=17)
    run = drift.run(spark, sf_dir)
    return R.change_summary(prev, prop, lock_keys_change(prev, prop), run.gate)


EXPLAIN_KEY = "anthropic:m1"


@register("t4_explain", f"""
WITH d AS {O.diff_sql()}, f AS {O.findings_sql()},
c AS (SELECT scope, field, string_agg(code, ',' ORDER BY code) AS codes FROM f WHERE key = '{EXPLAIN_KEY}' GROUP BY scope, field)
SELECT d.scope, entity_key, d.field, kind, a_str, a_num, a_bool, c_str, c_num, c_bool, confidence, coalesce(c.codes, '') AS codes
FROM d LEFT JOIN c ON c.scope = d.scope AND c.field = d.field WHERE entity_key = '{EXPLAIN_KEY}'""")
def t4_explain(spark, sf_dir):
    """One key through diff and rules."""
    run = drift.run(spark, sf_dir, lazy=True)
    return R.explain(run.fdiff, run.findings, EXPLAIN_KEY)


_IN_ORDER = "row_number() OVER (PARTITION BY scope ORDER BY key COLLATE en, code COLLATE en, field_ord, field)"
_WARNED = "Partial source failure (deprecations.info); merged available sources and retained warnings"


@register("o1_report_order", f"SELECT scope, {_IN_ORDER} AS position, key, code, field FROM {O.findings_sql()} f")
def o1_report_order(spark, sf_dir):
    """O1: the position of every finding in its scope's report, by locale order."""
    findings = drift.run(spark, sf_dir).findings.select("scope", "key", "code", "field_ord", "field")
    return DOC.ordered_findings(findings).select("scope", "position", "key", "code", "field")


@register("o2_key_order", f"""
SELECT scope, row_number() OVER (PARTITION BY scope ORDER BY entity_key COLLATE en, field_ord) AS position, entity_key, field, kind
FROM {O.diff_sql()} d""")
def o2_key_order(spark, sf_dir):
    """O2: the position of every field diff in its scope, by key in locale order."""
    fdiff = drift.run(spark, sf_dir).fdiff.select("scope", "entity_key", "field_ord", "field", "kind")
    return DOC.ordered_by_key(fdiff, "entity_key", "field_ord").select("scope", "position", "entity_key", "field", "kind")


def _body(pieces: DataFrame, part: int, schema: str) -> DataFrame:
    """The entries of a document's part, parsed from its pieces."""
    text = F.concat(F.lit("["), F.regexp_replace("text", "^,", ""), F.lit("]"))
    return pieces.filter(F.col("part") == part).select("scope", "piece", F.posexplode(F.from_json(text, f"array<{schema}>")).alias("i", "e")) \
        .select("scope", (F.col("piece") * DOC.PIECE + F.col("i") + 1).alias("position"), "e.*")


@register("t2_sarif_document", f"""
SELECT scope, {_IN_ORDER} AS position, code AS rule_id, CASE severity WHEN 'fail' THEN 'error' WHEN 'warn' THEN 'warning' ELSE 'note' END AS level,
       {_line_sql('message')} AS message, replace(path, '\\', '/') AS uri, coalesce(line, 1) AS start_line
FROM {O.findings_sql()} f""")
def t2_sarif_document(spark, sf_dir):
    """One SARIF document a scope, written as ordered pieces; its results parsed back
    from the pieces' text."""
    run = drift.run(spark, sf_dir, once=True)
    doc = DOC.sarif_document(DOC.ordered_findings(run.findings), run.gate, "driftgate", "1.0.0")
    body = _body(doc, 1, "struct<ruleId:string,level:string,message:struct<text:string>,locations:array<struct<physicalLocation:"
                         "struct<artifactLocation:struct<uri:string>,region:struct<startLine:int>>>>>")
    place = F.get("locations", F.lit(0))["physicalLocation"]
    return body.select("scope", "position", F.col("ruleId").alias("rule_id"), "level", F.col("message.text").alias("message"),
                       place["artifactLocation"]["uri"].alias("uri"), place["region"]["startLine"].alias("start_line"))


@register("t1_json_report", f"""
WITH f AS {O.findings_sql()}, d AS {O.diff_sql()}, s AS (SELECT DISTINCT scope FROM {O.deps_sql()} d)
SELECT scope, 'finding' AS section, {_IN_ORDER} AS position, key, field, code AS name, message AS text FROM f
UNION ALL SELECT scope, 'diff', row_number() OVER (PARTITION BY scope ORDER BY entity_key COLLATE en, field_ord), entity_key, field, kind,
  confidence FROM d
UNION ALL SELECT scope, 'warning', 1, NULL, NULL, NULL, '{_WARNED}' FROM s
UNION ALL SELECT s.scope, 'exit', 1, NULL, NULL, NULL, CASE WHEN count(f.code) FILTER (WHERE severity = 'fail') > 0 THEN '1' ELSE '0' END
  FROM s LEFT JOIN f ON f.scope = s.scope GROUP BY s.scope""")
def t1_json_report(spark, sf_dir):
    """One JSON document a scope (exit code, findings, warnings, diffs), written as ordered
    pieces; all of it parsed back from the pieces' text."""
    run = drift.run(spark, sf_dir, once=True)
    fdiff = run.fdiff.select("scope", "entity_key", "field_ord", "field", "kind", "a_str", "a_num", "a_bool", "c_str", "c_num", "c_bool",
                             "confidence", "blocking_eligible")
    doc = stored(DOC.json_document(DOC.ordered_findings(run.findings), DOC.ordered_by_key(fdiff, "entity_key", "field_ord"), run.gate, [_WARNED]), "document")
    none = F.lit(None).cast("string")
    found = _body(doc, 1, "struct<key:string,field:string,code:string,message:string>").select(
        "scope", F.lit("finding").alias("section"), "position", "key", "field", F.col("code").alias("name"), F.col("message").alias("text"))
    diffs = _body(doc, 3, "struct<key:string,field:string,kind:string,confidence:string>").select(
        "scope", F.lit("diff").alias("section"), "position", "key", "field", F.col("kind").alias("name"), F.col("confidence").alias("text"))
    between = doc.filter("part = 2").select("scope", F.posexplode(F.from_json(F.regexp_extract("text", '"warnings":(.*),"diffs":', 1), "array<string>")).alias("i", "w"))
    said = between.select("scope", F.lit("warning").alias("section"), (F.col("i") + 1).cast("long").alias("position"), none.alias("key"), none.alias("field"),
                          none.alias("name"), F.col("w").alias("text"))
    code = doc.filter("part = 0").select("scope", F.lit("exit").alias("section"), F.lit(1).cast("long").alias("position"), none.alias("key"), none.alias("field"),
                                         none.alias("name"), F.get_json_object(F.concat("text", F.lit("]}")), "$.exitCode").alias("text"))
    return found.unionByName(diffs).unionByName(said).unionByName(code)


@register("t3_change_report", f"""
WITH p AS {O.deps_sql(13)}, n AS {O.deps_sql(17)}, f AS {O.findings_sql()},
c AS (SELECT scope, sum(o)::BIGINT AS old, sum(w)::BIGINT AS new FROM (SELECT scope, 1 AS o, 0 AS w FROM p UNION ALL SELECT scope, 0, 1 FROM n) GROUP BY scope),
a AS (SELECT scope, entity_key FROM n WHERE (scope, entity_key) NOT IN (SELECT (scope, entity_key) FROM p)),
r AS (SELECT scope, entity_key FROM p WHERE (scope, entity_key) NOT IN (SELECT (scope, entity_key) FROM n))
SELECT scope, '0-previous' AS section, 1 AS position, '- Previous: ' || old AS text FROM c
UNION ALL SELECT scope, '1-proposed', 1, '- Proposed: ' || new FROM c
UNION ALL SELECT scope, '2-added', row_number() OVER (PARTITION BY scope ORDER BY entity_key COLLATE en), '- Added: ' || entity_key FROM a
UNION ALL SELECT scope, '3-removed', row_number() OVER (PARTITION BY scope ORDER BY entity_key COLLATE en), '- Removed: ' || entity_key FROM r
UNION ALL SELECT scope, '4-findings', {_IN_ORDER}, '- **' || severity || '** `' || code || '` ' || key || ': ' || {_line_sql('message')} FROM f
UNION ALL SELECT scope, '5-warnings', 1, '- {_WARNED}' FROM c""")
def t3_change_report(spark, sf_dir):
    """The update report line by line: counts, every added and removed key, the findings in
    report order, the warnings."""
    from driftgate.operators.lock import lock_keys_change
    prev, prop = B.dependencies(spark, sf_dir, exclude_mod=13), B.dependencies(spark, sf_dir, exclude_mod=17)
    findings = DOC.ordered_findings(drift.run(spark, sf_dir).findings)
    return DOC.change_report(prev, prop, lock_keys_change(prev, prop), findings, [_WARNED])


@register("f7_excluded_keys", f"""
SELECT scope, entity_key FROM {O.deps_sql()} d WHERE (scope, entity_key) NOT IN (
  SELECT ('tenant-' || (p_partkey % 20), provider || ':' || model_id) FROM (SELECT p_partkey, {O.part_identity_sql('p_partkey')} FROM part WHERE p_partkey % 7 = 0) x)""")
def f7_excluded_keys(spark, sf_dir):
    """every tenant excludes the parts that seven divides, from its own list only."""
    from driftgate.operators.lock import exclude
    k = F.col("p_partkey")
    listed = B.table(spark, sf_dir, "part").filter(k % 7 == 0).select(
        F.concat(F.lit("tenant-"), (k % 20).cast("string")).alias("scope"), B.part_identity(k)["entity_key"].alias("entity_key"))
    return exclude(B.dependencies(spark, sf_dir), listed).select("scope", "entity_key")


@register("u2_merged_warnings", """
WITH w AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN ['a', event_type] WHEN 2 THEN [event_type, 'a', event_type] ELSE [] END AS x,
             CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN ['a', 'b'] ELSE [event_type] END AS y FROM events),
u AS (SELECT event_id, unnest(list_concat(coalesce(x, []), coalesce(y, []))) AS v,
        unnest(range(len(coalesce(x, [])) + len(coalesce(y, [])))) AS i FROM w),
f AS (SELECT event_id, v, min(i) AS i FROM u GROUP BY event_id, v),
l AS (SELECT event_id, string_agg(v, '|' ORDER BY i) AS merged FROM f GROUP BY event_id)
SELECT event_id, coalesce(merged, '') AS merged FROM w LEFT JOIN l USING (event_id)""")
def u2_merged_warnings(spark, sf_dir):
    """Two lists of warnings an event, either of which may be missing, merged without
    repeats in the order of first appearance."""
    from driftgate.operators.lock import merge_warnings
    e = B.table(spark, sf_dir, "events").select("event_id", "event_type")
    k, t, a = F.col("event_id"), F.col("event_type"), F.lit("a")
    x = F.when(k % 4 == 1, F.array(a, t)).when(k % 4 == 2, F.array(t, a, t)).when(k % 4 == 3, F.array().cast("array<string>"))
    y = F.when(k % 3 == 1, F.array(a, F.lit("b"))).when(k % 3 == 2, F.array(t))
    return e.select("event_id", F.array_join(merge_warnings(x, y), "|").alias("merged"))


@register("x9_canonical_json", """
SELECT p_partkey, sha256('{"brand":' || to_json(p_brand) || ',"key":' || p_partkey || ',"name":' || to_json(p_name) || ',"none":null}') AS digest FROM part""")
def x9_canonical_json(spark, sf_dir):
    """A row's canonical JSON (keys sorted, nulls kept) and its digest."""
    from driftgate.functions.jsontext import canonical_json, sha256
    p = B.table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("key"), F.lit(None).cast("string").alias("none"),
                                              F.col("p_brand").alias("brand"))
    return p.select(F.col("key").alias("p_partkey"), sha256(canonical_json("name", "key", "none", "brand")).alias("digest"))


@register("t5_lock_occurrences", f"""
SELECT scope, provider || ':' || model_id AS entity_key, path, line, "column", snippet, confidence, kind, 0 AS n_strangers
FROM {O.all_hits_sql()} h""")
def t5_lock_occurrences(spark, sf_dir):
    """The discovered dependencies written as lock lines with their header
    digests, their occurrences beside it, and both read back: every occurrence, and the number
    of lock entries whose digest does not fit."""
    from driftgate.operators.lock import lock_records
    from driftgate.operators.occurrences import flat_occurrences, occurrence_blocks, read_occurrences, with_occurrences, write_occurrences
    from driftgate.operators.policy import effective_policy
    from driftgate.sources.lockio import lock_lines, lock_records_from_lines, read_lock, write_lock
    path = _run_dir(spark, "lock")
    hits = D.scan_lines(B.code_lines(spark, sf_dir)).unionByName(D.scan_docs(B.json_docs(spark, sf_dir).unionByName(B.yaml_docs(spark, sf_dir))))
    hits = hits.checkpoint(eager=True)
    deps = D.consolidate(hits).withColumn("discovery_confidence", F.col("confidence"))
    blocks = occurrence_blocks(hits)
    records = with_occurrences(lock_records(deps, drift.approved_wide(spark, sf_dir), B.APPROVED_AS_OF), blocks)
    write_lock(lock_lines(records, B.APPROVED_AS_OF, effective_policy(deps), "registry-digest"), f"{path}/lines")
    good, _ = read_lock(spark.read.text(f"{path}/lines"))
    lock = lock_records_from_lines(good)
    write_occurrences(blocks, lock, path)
    back, strangers = read_occurrences(spark, lock, path)
    return flat_occurrences(back).select("scope", "entity_key", "path", "line", "column", "snippet", "confidence", "kind",
                                         F.lit(strangers.count()).alias("n_strangers"))


def _spoilt(k):
    """Which parts' rows break which rule (by part key modulo 97)."""
    return lambda n: k % 97 == n


_S13 = [("policy", "scope-missing", None), ("policy", "floating-aliases", 1), ("policy", "stale-source-behavior", 2), ("policy", "min-blocking-confidence", 3),
        ("policy", "retirement-window-days", 4), ("policy", "price-increase-percent", 5), ("policy", "source-limits", 6),
        ("lock", "identity-missing", 11), ("lock", "key-mismatch", 12), ("lock", "provider", 13), ("lock", "identifier-kind", 14),
        ("lock", "discovery-confidence", 15), ("lock", "line", 16), ("lock", "fact-confidence", 17),
        ("snapshot", "key-mismatch", 21), ("snapshot", "provider", 22), ("snapshot", "fact-confidence", 23), ("snapshot", "price-negative", 24),
        ("snapshot", "limit-not-non-negative-integer", 25), ("snapshot", "lifecycle", 26), ("snapshot", "conflicting-with-value", 27),
        ("snapshot", "official-without-official-evidence", 28),
        ("snapshot_meta", "schema-version", 31), ("snapshot_meta", "generated-at", 32), ("snapshot_meta", "freeze-reason", 33)]


def _s13_sql() -> str:
    rows = " UNION ALL ".join(f"SELECT '{i}' AS input, '{r}' AS reason, {'-1' if n is None else n} AS m" for i, r, n in _S13)
    # A lock row without model id has a key that does not fit it, too; a key or provider spoilt
    # in one way is counted where that shows.
    return f"""
WITH r AS ({rows}), p AS (SELECT p_partkey % 97 AS m, count(*) AS n FROM part GROUP BY ALL),
x AS (SELECT input, reason, coalesce(n, 0) AS n FROM r LEFT JOIN p USING (m)),
y AS (SELECT input, reason, (n + CASE WHEN input = 'lock' AND reason = 'key-mismatch' THEN coalesce((SELECT n FROM p WHERE m = 11), 0) ELSE 0 END)::BIGINT AS n_rows FROM x)
SELECT input, CASE WHEN sum(n_rows) OVER (PARTITION BY input) > 0 THEN 'invalid' ELSE 'OK' END AS status, reason, n_rows FROM y"""


@register("s13_input_validation", _s13_sql())
def s13_input_validation(spark, sf_dir):
    """Policy, lock, snapshot and its header with one row in 97 spoilt for each rule;
    the rows that break each rule, and the status of each input."""
    from driftgate.operators.lock import lock_records
    from driftgate.operators.policy import effective_policy
    from driftgate.operators.validate import input_status
    part = B.table(spark, sf_dir, "part").select("p_partkey")
    k = F.col("p_partkey")
    bad = _spoilt(k)
    pol = effective_policy(part.select(k.cast("string").alias("scope"))).withColumn("p_partkey", F.col("scope").cast("long"))
    pol = (pol.withColumn("floating_aliases", F.when(bad(1), "maybe").otherwise(F.col("floating_aliases")))
           .withColumn("stale_source_behavior", F.when(bad(2), F.lit(None)).otherwise(F.col("stale_source_behavior")))
           .withColumn("min_blocking_confidence", F.when(bad(3), "certain").otherwise(F.col("min_blocking_confidence")))
           .withColumn("retirement_window_days", F.when(bad(4), -1).otherwise(F.col("retirement_window_days")))
           .withColumn("max_output_price_increase_percent", F.when(bad(5), -0.5).otherwise(F.col("max_output_price_increase_percent")))
           .withColumn("timeout_ms", F.when(bad(6), 0).otherwise(F.col("timeout_ms"))))
    wide = drift.approved_wide(spark, sf_dir)
    number = F.regexp_extract("model_id", "^m([0-9]+)", 1).cast("long").alias("p_partkey")
    lock = lock_records(B.dependencies(spark, sf_dir), wide, B.APPROVED_AS_OF, []).select("*", number)
    lock = (lock.withColumn("model_id", F.when(bad(11), "").otherwise(F.col("model_id")))
            .withColumn("entity_key", F.when(bad(12), "x:y").when(bad(13), F.concat(F.lit("acme:"), "model_id")).otherwise(F.col("entity_key")))
            .withColumn("provider", F.when(bad(13), "acme").otherwise(F.col("provider")))
            .withColumn("identifier_kind", F.when(bad(14), "loose").otherwise(F.col("identifier_kind")))
            .withColumn("discovery_confidence", F.when(bad(15), 1.5).otherwise(F.col("discovery_confidence")))
            .withColumn("line", F.when(bad(16), 0).otherwise(F.col("line")))
            .withColumn("facts", F.when(bad(17), F.col("facts").withField("vision.confidence", F.lit("certain"))).otherwise(F.col("facts"))))
    # Every part is in the snapshot, with or without observations of its own; its kind is the lock's.
    whole = lock_records(B.dependencies(spark, sf_dir), wide, B.APPROVED_AS_OF, []).select(
        "entity_key", "provider", "model_id", F.col("facts").withField("identifierKind.confidence", F.lit("single-source")).alias("facts"), "evidence", number)
    put = lambda n, path, value: F.when(bad(n), F.col("facts").withField(path, value)).otherwise(F.col("facts"))
    price = F.struct(F.lit(-1.0).alias("n"))["n"]
    snap = (whole.withColumn("entity_key", F.when(bad(21), "x:y").when(bad(22), F.concat(F.lit("acme:"), "model_id")).otherwise(F.col("entity_key")))
            .withColumn("provider", F.when(bad(22), "acme").otherwise(F.col("provider"))))
    for n, path, value in ((23, "vision.confidence", F.lit("certain")), (24, "outputPricePerMillion.num_value", price), (25, "contextLimit.num_value", F.lit(0.5)),
                           (26, "lifecycleStatus.str_value", F.lit("sunset")), (28, "toolCalling.confidence", F.lit("official-verified"))):
        snap = snap.withColumn("facts", put(n, path, value))
        if not path.endswith(".confidence"):  # a spoilt value is no conflict, too
            snap = snap.withColumn("facts", put(n, path.split(".")[0] + ".confidence", F.lit("single-source")))
    snap = snap.withColumn("facts", F.when(bad(27), F.col("facts").withField("contextLimit.num_value", F.lit(1.0)).withField("contextLimit.confidence", F.lit("conflicting")))
                           .otherwise(F.col("facts"))).withColumn("evidence", F.when(bad(28), F.array().cast(snap.schema["evidence"].dataType)).otherwise(F.col("evidence")))
    # The row without official evidence has no other official fact.
    lone = F.col("facts")
    from driftgate.schemas import FACT_FIELDS
    for n, _ in FACT_FIELDS:
        if n != "toolCalling":
            lone = lone.withField(f"{n}.confidence", F.when(F.col(f"facts.{n}.confidence") == "official-verified", "single-source")
                                  .otherwise(F.col(f"facts.{n}.confidence")))
    snap = snap.withColumn("facts", F.when(bad(28), lone).otherwise(F.col("facts")))
    head = part.select(k.cast("string").alias("snapshot_date"), F.when(bad(31), 2).otherwise(1).alias("schema_version"),
                       F.when(bad(32), "soon").otherwise(B.APPROVED_AS_OF).alias("generated_at"), (bad(33) | (k % 2 == 0)).alias("frozen"),
                       F.when(~bad(33), "reason").alias("freeze_reason"))
    return input_status({"policy": pol, "lock": lock, "snapshot": snap, "snapshot_meta": head})


@register("t5_lock_build", f"""
SELECT scope, entity_key, field, str_value, num_value, bool_value, confidence, source_id, fetched,
       CAST(discovery_confidence AS DOUBLE) AS discovery_confidence, path, line
FROM {O.lock_sql(O.deps_with_includes_sql())} l""")
def t5_lock_build(spark, sf_dir):
    """The proposed lock: dependencies plus include keys (only where not
    present), each with all 12 facts from the snapshot or 'unavailable' facts."""
    from driftgate.operators.lock import build_lock, overrides
    deps = B.dependencies(spark, sf_dir, exclude_mod=13)
    k = F.col("p_partkey")
    ident = B.part_identity(k)
    includes = (B.table(spark, sf_dir, "part").filter(k % 13 == 0)
                .select(F.concat(F.lit("tenant-"), (k % 20).cast("string")).alias("scope"),
                        ident["entity_key"].alias("key")))
    pins = spark.createDataFrame([], "scope string, provider string, model_id string")
    lock = build_lock(overrides(deps, pins, includes), drift.approved_wide(spark, sf_dir), B.APPROVED_AS_OF)
    return lock.select("scope", "entity_key", "field", "str_value", "num_value", "bool_value", "confidence",
                       "source_id", _fmt("fetched_at").alias("fetched"), "discovery_confidence", "path", "line")


# --------------------------------------------------------------------------- storage round trips

def _run_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder for one run's written tables."""
    import uuid
    from driftgate.session import shared_dir
    return shared_dir(spark, f"{name}-{uuid.uuid4().hex}")


@register("s7_snapshot_roundtrip", f"""
SELECT entity_key, field, field_ord, confidence, str_value, num_value, bool_value, source_id,
       strftime(fetched_at, '{O.FMT_TS}') AS fetched, n_candidates
FROM {O.fact_sql(B.CURRENT_AS_OF, B.STALE_AFTER_DAYS)} f""")
def s7_snapshot_roundtrip(spark, sf_dir):
    """S7 then S6: the current wide snapshot written as a dated partition (plus an older
    one), then the latest read back with partition pruning, in long form."""
    from driftgate.operators.reconcile import from_snapshot, reconcile_wide
    from driftgate.sources.snapshots import SnapshotMeta, read_snapshot, write_snapshot
    path = _run_dir(spark, "snapshots")
    write_snapshot(drift.approved_wide(spark, sf_dir), path, SnapshotMeta("2001-03-01", B.APPROVED_AS_OF))
    current = reconcile_wide(B.observed(spark, sf_dir, B.CURRENT_AS_OF), B.CURRENT_AS_OF, B.STALE_AFTER_DAYS, describe=B.described)
    write_snapshot(current, path, SnapshotMeta("2001-11-05", B.CURRENT_AS_OF))
    latest, _ = read_snapshot(spark, path, current.schema)
    return _fact_view(from_snapshot(latest))


@register("s9_lock_roundtrip", f"""
SELECT scope, entity_key AS key, provider, model_id, identifier_kind,
       CAST(discovery_confidence AS DOUBLE) AS discovery_confidence, low_confidence, path, line
FROM {O.deps_sql()} d""")
def s9_lock_roundtrip(spark, sf_dir):
    """S10 then S9: the approved lock (dependencies with their 12 facts) written as lock
    lines (scrubbed, keys sorted at every level, refused if a secret is left) and read back
    through validation."""
    from driftgate.operators.lock import lock_records
    from driftgate.sources.lockio import lock_lines, read_lock, write_lock
    path = _run_dir(spark, "lock")
    records = lock_records(B.dependencies(spark, sf_dir), drift.approved_wide_once(spark, sf_dir), B.APPROVED_AS_OF)
    write_lock(lock_lines(records, B.APPROVED_AS_OF), path)
    good, _ = read_lock(spark.read.text(path))
    return good.select("scope", "key", "provider", F.col("modelId").alias("model_id"),
                       F.col("identifierKind").alias("identifier_kind"),
                       F.col("discoveryConfidence").alias("discovery_confidence"),
                       F.col("lowConfidence").alias("low_confidence"), "path", "line")


@register("s5_normalized_observations", f"""
SELECT entity_key, 'models.dev' AS source_id, lifecycle_status, input_price, CAST(NULL AS VARCHAR) AS retirement_date, fetched
FROM ({ORACLE["s1_catalog_feed"]}) a
UNION ALL
SELECT entity_key, 'deprecations.info', lifecycle_status, CAST(NULL AS DOUBLE), retirement_date, fetched
FROM ({ORACLE["s2_deprecation_feed"]}) b
UNION ALL
SELECT provider || ':' || model_id, 'official-provider', CASE WHEN l_linestatus = 'F' THEN 'active' ELSE 'deprecated' END,
       CAST(CASE WHEN l_tax < 0.04 THEN NULL WHEN l_discount >= 0.09 THEN 2.0 ELSE 1.0 END AS DOUBLE),
       CAST(NULL AS VARCHAR), strftime(l_shipdate, '{O.FMT_TS}')
FROM {_li_src_sql(0)} WHERE NOT (l_linestatus = 'O' AND l_returnflag = 'N')""")
def s5_normalized_observations(spark, sf_dir):
    """One landing table holding all three sources' bodies, routed to each source's
    normalizer by source id and unioned into one observation table."""
    landing = (B.catalog_landing(spark, sf_dir).unionByName(B.feed_landing(spark, sf_dir))
               .unionByName(B.pack_landing(spark, sf_dir)))
    o = S.normalize(landing, seq_col="l_orderkey")
    return o.select("entity_key", "source_id", "lifecycle_status", "input_price", "retirement_date",
                    _fmt("fetched_at").alias("fetched"))


@register("f4_minified_documents", """
WITH d AS (SELECT doc_id, source || '/d' || doc_id || CASE WHEN doc_id % 11 = 0 THEN '.min.txt' ELSE '.txt' END AS path,
             CASE doc_id % 3 WHEN 0 THEN repeat(replace(text, chr(10), ' '), 30) WHEN 1 THEN repeat(text || chr(10), 30) ELSE text END AS text FROM documents)
SELECT doc_id, path, CAST(length(text) AS BIGINT) AS n_chars, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines,
       contains(path, '.min.') OR (length(text) > 50000 AND len(string_split(text, chr(10))) < 5) AS minified
FROM d""")
def f4_minified_documents(spark, sf_dir):
    """the minified-file test over every document (as a file under its source), some named
    so, some made long on one line, some made long on many."""
    d = B.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    k = F.col("doc_id")
    path = F.concat("source", F.lit("/d"), k.cast("string"), F.when(k % 11 == 0, ".min.txt").otherwise(".txt"))
    text = F.when(k % 3 == 0, F.repeat(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit(30))) \
        .when(k % 3 == 1, F.repeat(F.concat("text", F.lit("\n")), F.lit(30))).otherwise(F.col("text"))
    d = d.select("doc_id", path.alias("path"), F.length(text).cast("long").alias("n_chars"), F.size(F.split(text, "\n", -1)).cast("long").alias("n_lines"))
    return d.select("*", D.minified("path", "n_chars", "n_lines").alias("minified"))


@register("p1_stale_source", f"""
WITH b AS (SELECT event_type AS source_id, ts, event_id,
                  coalesce(json_valid(CASE WHEN event_id % 97 = 0 THEN substring(props, 2) ELSE props END), false) AS ok
           FROM events),
m AS (SELECT source_id, arg_max(ok, (ts, event_id)) AS ok FROM b GROUP BY source_id),
s AS (SELECT bool_and(ok) AS all_ok FROM m),
p AS {O.policy_sql(True)}
SELECT scope, '*' AS key, 'registry' AS field, stale_source_behavior AS severity, 'stale-source' AS code,
       'Registry sources degraded; using last-known-good data' AS message, CAST(NULL AS VARCHAR) AS path,
       CAST(NULL AS INTEGER) AS line, 'stale' AS confidence
FROM p, s WHERE NOT s.all_ok AND stale_source_behavior IN ('warn', 'fail')""")
def p1_stale_source(spark, sf_dir):
    """P1 (+A8): when the latest fetch of any source failed, every scope gets a stale-source
    finding with its own behavior (warn / fail / ignore). The degraded status is a one-row
    summary read on the driver, as the refresh job does."""
    from driftgate.operators.policy import effective_policy, stale_findings
    from driftgate.operators.reconcile import source_status
    b = S.body_status(B.event_landing(spark, sf_dir))
    meta = (b.groupBy("source_id").agg(F.max_by(F.struct("ok", "warning"), F.struct("fetched_at", "event_id")).alias("m"))
             .select("source_id", "m.ok", "m.warning"))
    status = source_status(meta).collect()[0]  # one row
    deps = B.dependencies(spark, sf_dir)
    policy = effective_policy(deps, B.policy_overrides(deps))
    return stale_findings(policy, status["mode"] == "frozen", list(status["warnings"])).select(*FINDING_OUT)
