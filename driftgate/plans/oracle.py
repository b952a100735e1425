"""DuckDB SQL for the same bindings and queries, used as the correctness oracle.

Written in the plain "reference" style (windows, DISTINCT counts, arg_min) rather than the
Spark plan's single-pass aggregates, so the two are independent formulations.
"""

from __future__ import annotations

from driftgate.plans import bindings as B
from driftgate.schemas import FACT_FIELDS, FIELD_COLUMNS, FLOATING_ALIASES, MODEL_ID_PATTERN

FMT_TS = "%Y-%m-%d %H:%M:%S"


def provider_sql(raw: str) -> str:
    """X1 in SQL."""
    p = f"lower({raw})"
    return (f"CASE WHEN contains({p}, 'openai') THEN 'openai' "
            f"WHEN contains({p}, 'anthropic') OR contains({p}, 'claude') THEN 'anthropic' "
            f"WHEN contains({p}, 'google') OR contains({p}, 'gemini') OR contains({p}, 'vertex') THEN 'google' "
            f"WHEN contains({p}, 'xai') OR contains({p}, 'grok') THEN 'xai' ELSE 'unknown' END")


def fixed_sql(m: str) -> str:
    """X3 in SQL."""
    return (f"(regexp_matches({m}, '\\d{{4}}-\\d{{2}}-\\d{{2}}') OR regexp_matches({m}, '-\\d{{8}}$') "
            f"OR regexp_matches({m}, '@\\d') OR regexp_matches({m}, '-\\d{{4}}$'))")


def kind_sql(m: str) -> str:
    return f"CASE WHEN {fixed_sql(m)} THEN 'fixed' ELSE 'floating' END"


def infer_provider_sql(m: str) -> str:
    """X2 in SQL."""
    x = f"lower({m})"
    return (f"CASE WHEN starts_with({x}, 'gpt-') OR starts_with({x}, 'o1') OR starts_with({x}, 'o3') "
            f"OR starts_with({x}, 'o4') OR starts_with({x}, 'text-embedding') THEN 'openai' "
            f"WHEN starts_with({x}, 'claude-') THEN 'anthropic' WHEN starts_with({x}, 'gemini-') THEN 'google' "
            f"WHEN starts_with({x}, 'grok-') THEN 'xai' ELSE 'unknown' END")


def looks_like_sql(v: str) -> str:
    """F5 in SQL."""
    aliases = ", ".join(f"'{a}'" for a in FLOATING_ALIASES)
    return (f"(length({v}) BETWEEN 3 AND 120 AND NOT regexp_matches({v}, '[\\\\/]') "
            f"AND NOT regexp_matches({v}, '^[Hh][Tt][Tt][Pp][Ss]?:') "
            f"AND NOT (contains({v}, '@') AND NOT contains({v}, 'gpt')) "
            f"AND (regexp_matches({v}, '{MODEL_ID_PATTERN}', 'i') OR {v} IN ({aliases})))")


def part_identity_sql(k: str) -> str:
    raw = ("CASE {k} % 5 WHEN 0 THEN 'OpenAI' WHEN 1 THEN 'Anthropic Claude' WHEN 2 THEN 'Google Vertex AI' "
           "WHEN 3 THEN 'xAI Grok' ELSE 'Mistral' END").format(k=k)
    mid = f"CASE WHEN {k} % 3 = 0 THEN 'm' || {k} || '-20240513' ELSE 'm' || {k} END"
    return f"{provider_sql(raw)} AS provider, {mid} AS model_id"


def obs_sql(upto: str | None, drop_mod: int | None = None) -> str:
    """B1 observations as a subquery."""
    where = []
    if upto:
        where.append(f"l_shipdate <= TIMESTAMP '{upto}'")
    if drop_mod:
        where.append(f"l_partkey % {drop_mod} <> 0")
    w = ("WHERE " + " AND ".join(where)) if where else ""
    return f"""(
  SELECT provider, model_id, provider || ':' || model_id AS entity_key,
    CASE src WHEN 1 THEN 'models.dev' WHEN 2 THEN 'deprecations.info' ELSE 'official-provider' END AS source_id,
    CASE src WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS source_ord,
    CASE src WHEN 1 THEN 'https://models.dev/api.json' WHEN 2 THEN 'https://deprecations.info/v1/feed.json'
             ELSE 'file:data/official/providers.json' END AS source_url,
    l_shipdate AS fetched_at,
    sha256(CASE src WHEN 1 THEN 'models.dev' WHEN 2 THEN 'deprecations.info' ELSE 'official-provider' END
           || '@' || strftime(l_shipdate, '%Y-%m-%d')) AS source_digest,
    CASE src WHEN 1 THEN '1.0.0+models-dev.1' WHEN 2 THEN '1.0.0+deprecations.1' ELSE '1.0.0+official.1' END AS parser_version,
    CASE WHEN l_linestatus = 'F' THEN 'active' ELSE 'deprecated' END AS lifecycle_status,
    CASE WHEN src <> 1 AND l_linestatus = 'O'
         THEN strftime(CAST(l_shipdate AS DATE) + CAST(120 + (l_partkey % 4) * 30 AS INTEGER), '%Y-%m-%d') END AS retirement_date,
    CAST(CASE WHEN l_tax < 0.04 THEN NULL WHEN l_discount >= 0.09 THEN 2.0 ELSE 1.0 END AS DOUBLE) AS input_price,
    CAST(CASE WHEN src = 2 OR l_tax < 0.02 THEN NULL WHEN l_quantity >= 40 THEN 8.0 ELSE 4.0 END AS DOUBLE) AS output_price,
    CAST(CASE WHEN src = 2 THEN NULL WHEN l_quantity >= 45 THEN 64000 ELSE 128000 END AS BIGINT) AS context_limit,
    CAST(CASE WHEN src = 2 OR l_discount < 0.02 THEN NULL WHEN l_linenumber >= 5 THEN 4096 ELSE 8192 END AS BIGINT) AS max_output_limit,
    CASE WHEN src <> 2 THEN l_returnflag <> 'R' END AS tool_calling,
    CASE WHEN src <> 2 AND l_returnflag <> 'N' THEN l_returnflag = 'A' END AS structured_output,
    CASE WHEN src <> 2 THEN l_tax >= 0.05 END AS vision,
    CASE WHEN src <> 2 THEN {kind_sql('model_id')} END AS identifier_kind,
    l_shipdate, l_orderkey, l_linenumber, l_extendedprice, l_suppkey
  FROM (SELECT *, l_suppkey % 3 AS src, {part_identity_sql('l_partkey')} FROM lineitem {w}) li
)"""


def a1_sql(upto: str | None, drop_mod: int | None = None) -> str:
    """A1: last record per (entity, source)."""
    return f"""(
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY entity_key, source_id
      ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC, l_suppkey DESC) AS rn
    FROM {obs_sql(upto, drop_mod)} o) WHERE rn = 1
)"""


def _long_sql(a1: str) -> str:
    parts = []
    for i, (name, kind) in enumerate(FACT_FIELDS):
        col = {"provider": "provider", "requestedModelId": "model_id"}.get(name) or FIELD_COLUMNS[name]
        s = f"CAST({col} AS VARCHAR)" if kind == "str" else "CAST(NULL AS VARCHAR)"
        n = f"CAST({col} AS DOUBLE)" if kind == "num" else "CAST(NULL AS DOUBLE)"
        b = f"CAST({col} AS BOOLEAN)" if kind == "bool" else "CAST(NULL AS BOOLEAN)"
        parts.append(f"SELECT entity_key, provider, model_id, source_id, source_ord, source_url, fetched_at, "
                     f"source_digest, parser_version, '{name}' AS field, {i} AS field_ord, "
                     f"{s} AS str_value, {n} AS num_value, {b} AS bool_value FROM a1")
    return "\n    UNION ALL ".join(parts)


def listing_a1_sql(as_of: str, drop_mod: int | None = None) -> str:
    """What the sources list at a date: all of it fetched then; the deprecation feed knows
    lifecycle and retirement only."""
    feed = "source_id = 'deprecations.info'"
    return f"""(
  SELECT * REPLACE (TIMESTAMP '{as_of}' AS fetched_at, CASE WHEN {feed} THEN 'deprecated' ELSE lifecycle_status END AS lifecycle_status,
    CASE WHEN NOT {feed} THEN input_price END AS input_price)
  FROM {a1_sql(as_of, drop_mod)} x
)"""


def fact_sql(as_of: str, stale_days: int, drop_mod: int | None = None, a1: str | None = None) -> str:
    """A2-A4, A6 in the straightforward form: any-fresh window, pool, first by source order."""
    return f"""(
  WITH a1 AS {a1 or a1_sql(as_of, drop_mod)},
  lng AS ({_long_sql('a1')}),
  marked AS (
    SELECT *, (str_value IS NOT NULL OR num_value IS NOT NULL OR bool_value IS NOT NULL) AS present,
           fetched_at >= TIMESTAMP '{as_of}' - INTERVAL {stale_days} DAY AS fresh,
           coalesce(num_value, CAST(bool_value AS DOUBLE)) AS cmp
    FROM lng),
  w AS (SELECT *, max(CASE WHEN present AND fresh THEN 1 ELSE 0 END) OVER (PARTITION BY entity_key, field) AS any_fresh
        FROM marked),
  pool AS (SELECT *, first_value(cmp) OVER (PARTITION BY entity_key, field ORDER BY source_ord) AS first_cmp
           FROM w WHERE present AND (any_fresh = 0 OR fresh)),
  pstat AS (
    SELECT entity_key, field,
      max(abs(cmp - first_cmp)) AS spread, count(DISTINCT str_value) AS n_str,
      bool_or(source_id = 'official-provider') AS has_off, count(DISTINCT source_id) AS n_src,
      max(any_fresh) AS any_fresh,
      arg_min(str_value, source_ord) AS p_str, arg_min(num_value, source_ord) AS p_num,
      arg_min(bool_value, source_ord) AS p_bool, arg_min(source_id, source_ord) AS p_source_id,
      arg_min(fetched_at, source_ord) AS p_fetched_at
    FROM pool GROUP BY entity_key, field),
  astat AS (
    SELECT entity_key, field, field_ord, min(provider) AS provider, min(model_id) AS model_id, count(*) AS n_obs,
      count(*) FILTER (WHERE present) AS n_present,
      arg_min(str_value, source_ord) AS f_str, arg_min(source_id, source_ord) AS f_source_id,
      arg_min(fetched_at, source_ord) AS f_fetched_at
    FROM marked GROUP BY entity_key, field, field_ord),
  cls AS (
    SELECT a.*, p.* EXCLUDE (entity_key, field),
      CASE WHEN a.field = 'provider' THEN CASE WHEN n_obs >= 2 THEN 'multi-source-verified' ELSE 'single-source' END
           WHEN a.field = 'requestedModelId' THEN 'single-source'
           WHEN n_present = 0 THEN 'unavailable'
           WHEN coalesce(spread, 0) >= 1e-9 OR n_str > 1 THEN 'conflicting'
           WHEN any_fresh = 0 THEN 'stale'
           WHEN has_off THEN 'official-verified'
           WHEN n_src >= 2 THEN 'multi-source-verified'
           ELSE 'single-source' END AS confidence
    FROM astat a LEFT JOIN pstat p ON a.entity_key = p.entity_key AND a.field = p.field)
  SELECT entity_key, provider, model_id, field, field_ord, confidence,
    CASE WHEN field IN ('provider', 'requestedModelId') THEN f_str
         WHEN confidence IN ('unavailable', 'conflicting') THEN NULL ELSE p_str END AS str_value,
    CASE WHEN confidence IN ('unavailable', 'conflicting') THEN NULL ELSE p_num END AS num_value,
    CASE WHEN confidence IN ('unavailable', 'conflicting') THEN NULL ELSE p_bool END AS bool_value,
    CASE WHEN field IN ('provider', 'requestedModelId') OR n_present = 0 THEN f_source_id ELSE p_source_id END AS source_id,
    CASE WHEN field IN ('provider', 'requestedModelId') OR n_present = 0 THEN f_fetched_at ELSE p_fetched_at END AS fetched_at,
    CASE WHEN confidence = 'conflicting' THEN n_present ELSE 0 END AS n_candidates
  FROM cls
)"""


def deps_sql(exclude_mod: int | None = None) -> str:
    """B2 dependency list."""
    where = f"WHERE p_partkey % {exclude_mod} <> 0" if exclude_mod else ""
    return f"""(
  SELECT 'tenant-' || (p_partkey % 20) AS scope, provider || ':' || model_id AS entity_key, provider, model_id,
    {kind_sql('model_id')} AS identifier_kind,
    CASE WHEN p_partkey % 11 = 0 THEN 0.55 ELSE 0.9 END AS discovery_confidence,
    p_partkey % 11 = 0 AS low_confidence,
    'svc' || (p_partkey % 20) || '/app.py' AS path, CAST(p_partkey % 50 + 1 AS INTEGER) AS line
  FROM (SELECT p_partkey, {part_identity_sql('p_partkey')} FROM part {where}) p
)"""


def deps_with_includes_sql() -> str:
    """The approved list plus the new parts as include keys (confidence 1, override)."""
    return f"""(
  SELECT scope, entity_key, provider, model_id, identifier_kind, discovery_confidence, low_confidence, path, line FROM {deps_sql(13)} d
  UNION ALL
  SELECT 'tenant-' || (p_partkey % 20), provider || ':' || model_id, provider, model_id, {kind_sql('model_id')},
         1.0, false, '.llm-lock.yml', 1
  FROM (SELECT p_partkey, {part_identity_sql('p_partkey')} FROM part WHERE p_partkey % 13 = 0) p
)"""


def lock_sql(deps: str | None = None, facts: str | None = None) -> str:
    """J2 + T5 in SQL."""
    fields = " UNION ALL ".join(f"SELECT '{n}' AS field, {i} AS field_ord" for i, (n, _) in enumerate(FACT_FIELDS))
    return f"""(
  SELECT d.*, f.field, f.field_ord,
    CASE f.field WHEN 'provider' THEN d.provider WHEN 'requestedModelId' THEN d.model_id
                 WHEN 'identifierKind' THEN d.identifier_kind ELSE a.str_value END AS str_value,
    a.num_value, a.bool_value,
    CASE WHEN f.field = 'requestedModelId' THEN 'single-source'
         WHEN f.field IN ('provider', 'identifierKind') AND coalesce(a.confidence, 'unavailable') = 'unavailable'
           THEN 'single-source'
         ELSE coalesce(a.confidence, 'unavailable') END AS confidence,
    coalesce(a.source_id, 'unavailable') AS source_id,
    CASE WHEN a.confidence IS NULL THEN strftime(TIMESTAMP '{B.APPROVED_AS_OF}', '{FMT_TS}')
         ELSE strftime(a.fetched_at, '{FMT_TS}') END AS fetched
  FROM {deps or deps_sql()} d CROSS JOIN ({fields}) f
  LEFT JOIN {facts or fact_sql(B.APPROVED_AS_OF, B.STALE_AFTER_DAYS)} a
    ON a.entity_key = d.entity_key AND a.field = f.field
)"""


def diff_sql(lock: str | None = None, facts: str | None = None) -> str:
    """J1 + C1-C3 in SQL."""
    return f"""(
  SELECT l.scope, l.entity_key, l.model_id, l.identifier_kind, l.low_confidence, l.path, l.line,
    l.field, l.field_ord,
    CASE WHEN c.entity_key IS NULL THEN 'unknown'
         WHEN c.confidence = 'conflicting' THEN 'conflicting'
         WHEN l.str_value = c.str_value OR l.num_value = c.num_value OR l.bool_value = c.bool_value
              OR (l.str_value IS NULL AND l.num_value IS NULL AND l.bool_value IS NULL
                  AND c.str_value IS NULL AND c.num_value IS NULL AND c.bool_value IS NULL)
              OR abs(l.num_value - c.num_value) < 1e-9 THEN 'unchanged'
         ELSE 'changed' END AS kind,
    l.str_value AS a_str, l.num_value AS a_num, l.bool_value AS a_bool,
    CASE WHEN c.entity_key IS NULL OR c.confidence = 'conflicting' THEN NULL ELSE c.str_value END AS c_str,
    CASE WHEN c.entity_key IS NULL OR c.confidence = 'conflicting' THEN NULL ELSE c.num_value END AS c_num,
    CASE WHEN c.entity_key IS NULL OR c.confidence = 'conflicting' THEN NULL ELSE c.bool_value END AS c_bool,
    CASE WHEN c.entity_key IS NULL THEN 'unavailable' ELSE c.confidence END AS confidence,
    coalesce(c.entity_key IS NOT NULL AND c.confidence IN ('official-verified', 'multi-source-verified'), false)
      AS blocking_eligible
  FROM {lock or lock_sql()} l
  LEFT JOIN {facts or fact_sql(B.CURRENT_AS_OF, B.STALE_AFTER_DAYS, 17)} c
    ON c.entity_key = l.entity_key AND c.field = l.field
)"""


def _rank(c: str) -> str:
    return (f"CASE {c} WHEN 'unavailable' THEN 0 WHEN 'stale' THEN 1 WHEN 'conflicting' THEN 2 "
            f"WHEN 'single-source' THEN 3 WHEN 'multi-source-verified' THEN 4 WHEN 'official-verified' THEN 5 ELSE -1 END")


def policy_sql(overrides: bool = False) -> str:
    """One policy row per scope (defaults, or the override rule by tenant number)."""
    n = "CAST(split_part(scope, '-', 2) AS INTEGER)"
    if not overrides:
        cols = ("'warn' AS floating_aliases, 90 AS retirement_window_days, 15.0::DOUBLE AS max_input_price_increase_percent, "
                "15.0::DOUBLE AS max_output_price_increase_percent, true AS fail_on_context_decrease, "
                "true AS fail_on_max_output_decrease, true AS fail_on_tool_calling_removal, "
                "true AS fail_on_structured_output_removal, false AS fail_on_vision_removal, "
                "'warn' AS stale_source_behavior, 'official-verified' AS min_blocking_confidence, false AS fail_on_warn, "
                "false AS allow_network, 7 AS stale_after_days, 10000 AS timeout_ms, 8388608 AS max_bytes")
    else:
        cols = (f"CASE WHEN {n} < 5 THEN 'deny' WHEN {n} >= 18 THEN 'allow' ELSE 'warn' END AS floating_aliases, "
                f"CASE WHEN {n} < 5 THEN 30 ELSE 90 END AS retirement_window_days, "
                f"CASE WHEN {n} % 2 = 1 THEN 50.0 ELSE 15.0 END::DOUBLE AS max_input_price_increase_percent, "
                f"15.0::DOUBLE AS max_output_price_increase_percent, {n} <> 7 AS fail_on_context_decrease, "
                f"true AS fail_on_max_output_decrease, true AS fail_on_tool_calling_removal, "
                f"{n} <> 8 AS fail_on_structured_output_removal, {n} >= 15 AS fail_on_vision_removal, "
                f"CASE WHEN {n} >= 15 THEN 'fail' ELSE 'warn' END AS stale_source_behavior, "
                f"CASE WHEN {n} BETWEEN 5 AND 9 THEN 'single-source' ELSE 'official-verified' END AS min_blocking_confidence, "
                f"{n} BETWEEN 10 AND 14 AS fail_on_warn, {n} = 3 AS allow_network, CASE WHEN {n} = 4 THEN 30 ELSE 7 END AS stale_after_days, "
                f"10000 AS timeout_ms, CASE WHEN {n} < 2 THEN 1024 ELSE 8388608 END AS max_bytes")
    names = sorted(["floating_aliases", "retirement_window_days", "max_input_price_increase_percent",
                    "max_output_price_increase_percent", "fail_on_context_decrease", "fail_on_max_output_decrease",
                    "fail_on_tool_calling_removal", "fail_on_structured_output_removal", "fail_on_vision_removal",
                    "stale_source_behavior", "min_blocking_confidence", "fail_on_warn", "allow_network", "stale_after_days",
                    "timeout_ms", "max_bytes"])
    digest = "sha256(concat_ws('|', " + ", ".join(f"'{n}=' || CAST({n} AS VARCHAR)" for n in names) + "))"
    return (f"(SELECT *, {digest} AS config_digest FROM "
            f"(SELECT scope, {cols} FROM (SELECT DISTINCT scope FROM {deps_sql()} d) s) p0)")


def findings_sql(overrides: bool = False) -> str:
    """P2-P13 in SQL with each scope's policy row."""
    now = B.CURRENT_AS_OF
    block = (f"(confidence NOT IN ('conflicting', 'unavailable') AND {_rank('confidence')} >= {_rank('min_blocking_confidence')})")
    sev = f"CASE WHEN {block} THEN 'fail' ELSE 'warn' END"
    moving = "kind IN ('changed', 'unknown')"
    days = (f"CAST(ceil((epoch_ms(try_strptime(coalesce(a_str, c_str), '%Y-%m-%d')) - epoch_ms(TIMESTAMP '{now}'))"
            f" / 86400000.0) AS BIGINT)")
    pct = "CASE WHEN a_num = 0 THEN CASE WHEN c_num > 0 THEN 'Infinity' ELSE '0.0' END ELSE printf('%.1f', (c_num - a_num) / a_num * 100) END"
    pctv = "CASE WHEN a_num = 0 THEN CASE WHEN c_num > 0 THEN 1e308 ELSE 0 END ELSE (c_num - a_num) / a_num * 100 END"
    num = lambda x: f"CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END"
    rules = [
        ("identifierKind", "floating-alias",
         "field = 'identifierKind' AND identifier_kind = 'floating' AND floating_aliases IN ('deny', 'warn')",
         "CASE WHEN floating_aliases = 'deny' THEN 'fail' ELSE 'warn' END",
         "CASE WHEN floating_aliases = 'deny' THEN 'Floating model alias \"' || model_id || '\" is denied by policy' "
         "ELSE 'Floating model alias \"' || model_id || '\" detected' END", "NULL"),
        ("discovery", "low-confidence-discovery", "field = 'provider' AND low_confidence",
         "'warn'", "'Dependency ' || entity_key || ' was discovered with low confidence'", "NULL"),
        ("retirementDate", "retirement-window",
         f"field = 'retirementDate' AND coalesce(a_str, c_str) IS NOT NULL AND coalesce(a_str, c_str) <> '' "
         f"AND {days} IS NOT NULL AND {days} <= retirement_window_days",
         sev, f"'Model ' || entity_key || ' retires in ' || {days} || ' day(s) (window=' || retirement_window_days || ')'",
         "confidence"),
        (None, "conflicting-fact", "kind = 'conflicting'", "'warn'",
         "'Conflicting data for ' || entity_key || '.' || field || '; not blocking'", "'conflicting'"),
        (None, "input-price-increase",
         f"{moving} AND field = 'inputPricePerMillion' AND a_num IS NOT NULL AND c_num IS NOT NULL AND c_num > a_num "
         f"AND {pctv} > max_input_price_increase_percent",
         sev, f"'Input price increased ' || {pct} || '% (max ' || {num('max_input_price_increase_percent')} || '%)'", "confidence"),
        (None, "output-price-increase",
         f"{moving} AND field = 'outputPricePerMillion' AND a_num IS NOT NULL AND c_num IS NOT NULL AND c_num > a_num "
         f"AND {pctv} > max_output_price_increase_percent",
         sev, f"'Output price increased ' || {pct} || '% (max ' || {num('max_output_price_increase_percent')} || '%)'", "confidence"),
        (None, "context-decrease",
         f"{moving} AND fail_on_context_decrease AND field = 'contextLimit' AND a_num IS NOT NULL AND c_num IS NOT NULL AND c_num < a_num",
         sev, f"'Context limit decreased from ' || {num('a_num')} || ' to ' || {num('c_num')}", "confidence"),
        (None, "max-output-decrease",
         f"{moving} AND fail_on_max_output_decrease AND field = 'maxOutputLimit' AND a_num IS NOT NULL AND c_num IS NOT NULL AND c_num < a_num",
         sev, f"'Max output decreased from ' || {num('a_num')} || ' to ' || {num('c_num')}", "confidence"),
        (None, "tool-calling-removal",
         f"{moving} AND fail_on_tool_calling_removal AND field = 'toolCalling' AND a_bool = true AND c_bool = false",
         sev, "'Tool-calling support removed'", "confidence"),
        (None, "structured-output-removal",
         f"{moving} AND fail_on_structured_output_removal AND field = 'structuredOutput' AND a_bool = true AND c_bool = false",
         sev, "'Structured-output support removed'", "confidence"),
        (None, "vision-removal",
         f"{moving} AND fail_on_vision_removal AND field = 'vision' AND a_bool = true AND c_bool = false",
         sev, "'Vision support removed'", "confidence"),
        (None, "lifecycle-regression",
         f"{moving} AND field = 'lifecycleStatus' AND a_str = 'active' AND c_str IN ('deprecated', 'retired')",
         sev, "'Lifecycle changed from ' || a_str || ' to ' || c_str", "confidence"),
    ]
    sels = []
    for fld, code, cond, s_, msg, conf in rules:
        f = f"'{fld}'" if fld else "field"
        sels.append(f"SELECT scope, entity_key AS key, {f} AS field, field_ord, {s_} AS severity, '{code}' AS code, "
                    f"{msg} AS message, path, line, {conf} AS confidence FROM d WHERE {cond}")
    return (f"(WITH d AS (SELECT * FROM {diff_sql()} x JOIN {policy_sql(overrides)} p USING (scope))\n"
            + "\nUNION ALL ".join(sels) + ")")


# ----------------------------------------------------------------------------- discovery

def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def pick_sql(values: list[str], idx: str) -> str:
    return "CASE " + idx + " " + " ".join(f"WHEN {i} THEN {_q(v)}" for i, v in enumerate(values)) + " END"


def code_files_sql() -> str:
    k, c = "o_orderkey", "o_custkey"
    text = (f"CASE {c} % 4 WHEN 0 THEN {pick_sql(B.PY_LINES, k + ' % 8')} WHEN 1 THEN {pick_sql(B.TS_LINES, k + ' % 8')} "
            f"WHEN 2 THEN {pick_sql(B.ENV_LINES, k + ' % 8')} ELSE CASE WHEN {c} % 40 = 3 AND {k} % 8 = 6 THEN {_q(B.YAML_BROKEN)} "
            f"ELSE {pick_sql(B.YAML_LINES, k + ' % 8')} END END")
    sub = f"CASE WHEN {c} % 10 = 7 THEN 'node_modules/' WHEN {c} % 10 = 8 THEN '.cache/' ELSE '' END"
    return (f"(SELECT 'repo-' || ({c} % 20) AS scope, 'src/' || {sub} || 'f' || {c} || {pick_sql(B.FILE_EXTS, c + ' % 4')} AS path, "
            f"{k} AS o_orderkey, {text} AS text FROM orders)")


def code_lines_sql() -> str:
    from driftgate.operators.discovery import SKIP_DIR_RE
    return (f"(SELECT scope, path, CAST(row_number() OVER (PARTITION BY scope, path ORDER BY o_orderkey) AS INTEGER) AS line, text "
            f"FROM {code_files_sql()} f WHERE NOT regexp_matches(path, {_q(SKIP_DIR_RE)}))")


def json_docs_sql() -> str:
    k, c = "o_orderkey", "o_custkey"
    body = (f"'{{\"service\": \"s' || {k} || '\", \"llm\": {{\"' || {pick_sql(B.JSON_KEYS, k + ' % 3')} || '\": \"' || "
            f"{pick_sql(B.JSON_IDS, k + ' % 8')} || '\"}}, \"retries\": ' || ({k} % 5)")
    return (f"(SELECT 'repo-' || ({c} % 20) AS scope, 'conf/o' || {k} || '.json' AS path, "
            f"CASE WHEN {k} % 9 = 0 THEN {body} ELSE {body} || '}}' END AS content FROM orders)")


def _trim_sql(x: str) -> str:
    from driftgate.functions.text import JS_WS
    return f"regexp_replace({x}, {_q('^' + JS_WS + '+|' + JS_WS + '+$')}, '', 'g')"


def python_hits_sql() -> str:
    from driftgate.schemas import PYTHON_MODEL_PATTERNS, PYTHON_PROVIDER_HINTS
    hint = "CASE " + " ".join(f"WHEN regexp_matches(text, {_q(rx)}) THEN '{p}'"
                              for p, rx in reversed(PYTHON_PROVIDER_HINTS)) + " END"
    sels = []
    for i, rx in enumerate(PYTHON_MODEL_PATTERNS):
        mid = f"regexp_extract(text, {_q(rx)}, 1)"
        sels.append(
            f"SELECT scope, coalesce(carried, {infer_provider_sql(mid)}) AS provider, {mid} AS model_id, path, line, "
            f"CAST(NULL AS INTEGER) AS \"column\", substring({_trim_sql('text')}, 1, 120) AS snippet, "
            f"CASE WHEN regexp_matches(text, 'messages\\.create|chat\\.completions') THEN 0.9 ELSE 0.7 END::DOUBLE AS confidence, "
            f"'sdk' AS kind, {i} AS hit_ord FROM c WHERE {mid} <> '' AND {looks_like_sql(mid)}")
    return (f"(WITH l AS (SELECT * FROM {code_lines_sql()} x WHERE path LIKE '%.py'), "
            f"h AS (SELECT *, {hint} AS hint FROM l), "
            f"c AS (SELECT *, last_value(hint IGNORE NULLS) OVER (PARTITION BY scope, path ORDER BY line "
            f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM h) "
            + " UNION ALL ".join(sels) + ")")


def env_hits_sql() -> str:
    from driftgate.operators.discovery import ENV_LINE
    from driftgate.schemas import ENV_MODEL_KEYS
    keys = " UNION ALL ".join(f"SELECT '{k}' AS env_key, '{p}' AS env_provider" for k, p in ENV_MODEL_KEYS)
    val = f"regexp_replace({_trim_sql(f'regexp_extract(text, {_q(ENV_LINE)}, 2)')}, '^[\"'']|[\"'']$', '', 'g')"
    return (f"(SELECT scope, env_provider AS provider, value AS model_id, path, line, CAST(NULL AS INTEGER) AS \"column\", "
            f"env_key || '=' || value AS snippet, 0.85::DOUBLE AS confidence, 'env' AS kind, 0 AS hit_ord "
            f"FROM (SELECT scope, path, line, regexp_extract(text, {_q(ENV_LINE)}, 1) AS env_key, {val} AS value "
            f"      FROM {code_lines_sql()} l WHERE path LIKE '%.env.example' AND contains(text, '=')) e "
            f"JOIN ({keys}) k USING (env_key) WHERE {looks_like_sql('value')})")


def yaml_hits_sql() -> str:
    """Each YAML line template's hits, written out; a file with an unclosed list has none."""
    n, key, value = zip(*[(i, k, v) for i, k, v in B.YAML_HITS])
    hits = " UNION ALL ".join(f"SELECT {_q(B.YAML_LINES[i])} AS text, {_q(k)} AS key, {_q(v)} AS model_id" for i, k, v in zip(n, key, value))
    return (f"(WITH y AS (SELECT * FROM {code_lines_sql()} l WHERE path LIKE '%.yaml') "
            f"SELECT scope, {infer_provider_sql('model_id')} AS provider, model_id, path, 1 AS line, "
            f"CAST(NULL AS INTEGER) AS \"column\", key || ': ' || model_id AS snippet, 0.75::DOUBLE AS confidence, 'config' AS kind, "
            f"CAST(y.line AS INTEGER) AS hit_ord FROM y JOIN ({hits}) h USING (text) "
            f"WHERE (scope, path) NOT IN (SELECT (scope, path) FROM y WHERE text = {_q(B.YAML_BROKEN)}))")


def yaml_doc_hits_sql() -> str:
    """Each YAML document template's hits, written out."""
    hits = " UNION ALL ".join(f"SELECT {i} AS k, {_q(k)} AS key, {_q(v)} AS model_id" for i, k, v in B.YAML_DOC_HITS)
    return (f"(SELECT 'repo-' || (o_custkey % 20) AS scope, {infer_provider_sql('model_id')} AS provider, model_id, "
            f"'conf/o' || o_orderkey || '.yaml' AS path, 1 AS line, CAST(NULL AS INTEGER) AS \"column\", key || ': ' || model_id AS snippet, "
            f"0.75::DOUBLE AS confidence, 'config' AS kind, 0 AS hit_ord "
            f"FROM orders JOIN ({hits}) h ON h.k = o_orderkey % {len(B.YAML_DOCS)})")


def json_hits_sql() -> str:
    from driftgate.operators.discovery import JSON_KEY
    return (f"(SELECT scope, {infer_provider_sql('model_id')} AS provider, model_id, path, 1 AS line, "
            f"CAST(NULL AS INTEGER) AS \"column\", key || ': ' || model_id AS snippet, 0.75::DOUBLE AS confidence, "
            f"'config' AS kind, 0 AS hit_ord "
            f"FROM (SELECT scope, path, regexp_extract(m, {_q(JSON_KEY)}, 1) AS key, regexp_extract(m, {_q(JSON_KEY)}, 2) AS model_id "
            f"      FROM (SELECT scope, path, unnest(regexp_extract_all(content, {_q(JSON_KEY)}, 0)) AS m "
            f"            FROM {json_docs_sql()} d WHERE json_valid(content)) u) j "
            f"WHERE {looks_like_sql('model_id')})")


def js_hits_sql() -> str:
    """Each TS line template's hits, written out by hand (key, id, root name of a member call);
    the provider of a root name is that of its last import at or above the line."""
    sdk = " UNION ALL ".join(f"SELECT {_q(B.TS_LINES[i])} AS text, {_q(v)} AS model_id, {_q(root) if root else 'NULL'} AS root, {_q(lit)} AS literal"
                             for i, v, root, lit in B.TS_CALLS)
    lits = " UNION ALL ".join(f"SELECT {_q(B.TS_LINES[i])} AS text, {_q(k)} AS key, {_q(v)} AS model_id, {_q(lit)} AS literal"
                              for i, k, v, lit in B.TS_LITERALS)
    imports = " UNION ALL ".join(f"SELECT {_q(B.TS_LINES[i])} AS text, {_q(a)} AS root, {_q(p)} AS imp_provider" for i, a, p in B.TS_IMPORTS)
    return f"""(
  WITH l AS (SELECT * FROM {code_lines_sql()} x WHERE path LIKE '%.ts'),
  imp AS (SELECT scope, path, line AS imp_line, root, imp_provider FROM l JOIN ({imports}) i USING (text)),
  calls AS (SELECT l.scope, l.path, l.line, l.text, c.model_id, c.root, c.literal FROM l JOIN ({sdk}) c USING (text)),
  cj AS (SELECT c.scope, c.path, c.line, c.text, c.model_id, c.literal, max({{'l': i.imp_line, 'p': i.imp_provider}}) AS imp
         FROM calls c LEFT JOIN imp i ON i.scope = c.scope AND i.path = c.path AND i.root = c.root AND i.imp_line <= c.line
         GROUP BY c.scope, c.path, c.line, c.text, c.model_id, c.literal)
  SELECT scope, coalesce(imp.p, {infer_provider_sql('model_id')}) AS provider, model_id, path, line,
         CAST(strpos(text, literal) - 1 AS INTEGER) AS "column", 'model: "' || model_id || '"' AS snippet, 0.9::DOUBLE AS confidence, 'sdk' AS kind
  FROM cj
  UNION ALL
  SELECT scope, {infer_provider_sql('model_id')} AS provider, model_id, path, line,
         CAST(strpos(text, literal) - 1 AS INTEGER) AS "column", key || ': "' || model_id || '"' AS snippet, 0.55::DOUBLE AS confidence, 'literal' AS kind
  FROM l JOIN ({lits}) p USING (text)
)"""


HIT_OUT = "scope, provider, model_id, path, line, \"column\", snippet, confidence, kind"


def all_hits_sql() -> str:
    return (f"(SELECT {HIT_OUT} FROM {python_hits_sql()} a UNION ALL SELECT {HIT_OUT} FROM {js_hits_sql()} b "
            f"UNION ALL SELECT {HIT_OUT} FROM {env_hits_sql()} c UNION ALL SELECT {HIT_OUT} FROM {yaml_hits_sql()} d "
            f"UNION ALL SELECT {HIT_OUT} FROM {json_hits_sql()} e UNION ALL SELECT {HIT_OUT} FROM {yaml_doc_hits_sql()} f)")


def deps_from_hits_sql() -> str:
    return f"""(
  SELECT scope, provider || ':' || model_id AS entity_key, provider, model_id, {kind_sql('model_id')} AS identifier_kind,
         max(confidence) AS confidence, max(confidence) < 0.6 AS low_confidence, count(*) AS n_occurrences,
         arg_min(path, {{'p': path, 'l': line}}) AS path, arg_min(line, {{'p': path, 'l': line}}) AS line
  FROM {all_hits_sql()} h GROUP BY scope, provider, model_id
)"""
