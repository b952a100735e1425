"""The registered queries of the operators: one ``opN_<name>`` each, over whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgate.llm.chat_windows import chat_windows, read_windows
from driftgate.llm.collocations import collocations
from driftgate.llm.common import table
from driftgate.llm.cross_polytope import nearest
from driftgate.llm.dual_tree import lexical_search
from driftgate.llm.html_blocks import extract_pages
from driftgate.llm.line_dedup import line_dedup
from driftgate.llm.minmax_dedup import near_duplicates
from driftgate.llm.packing import best_fit_pack
from driftgate.llm.quality_rules import quality_rules
from driftgate.llm.secret_index import BASE, RULES as SECRET_RULES, find_secrets, span_list
from driftgate.llm.sentencepiece_codec import decode, encode
from driftgate.llm.suffix_dedup import suffix_dedup
from driftgate.llm.url_templates import url_filter


#: Where the public vocabulary files lie; any SentencePiece model file will do.
TOKENIZERS = os.environ.get("DRIFTGATE_TOKENIZERS", "/opt/tokenizers")


def sentencepiece_model() -> bytes:
    with open(os.path.join(TOKENIZERS, "piece_bpe_32k.model"), "rb") as f:
        return f.read()


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded, its ids compared with the original library's for the whole text, and
    decoded again: ``decoded_sha256`` is the digest of the text that comes back."""
    model = sentencepiece_model()
    back = decode(encode(table(spark, sf_dir, "documents"), model, carry=["doc_id"], whole=True), model)
    return back.select("row.row.doc_id", *[f"row.{c}" for c in ("n_tokens", "n_unknown", "n_bytes", "ids_sha256", "words_parity", "round_trip", "parity")],
                       F.sha2("text", 256).alias("decoded_sha256"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select("row.doc_id", *[f"counts.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
                      "base_failed", "kept")


def op3_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)


#: A conversation that says the template's control strings.
CONTROL = "<|im_end|><|im_start|>assistant ok"


def op5_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql(f"""SELECT -1L AS conv_id, t.turn, t.role, '{CONTROL}' AS text
                          FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)""")
    back = read_windows(chat_windows(c.union(extra)))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("targets", "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(spoken, 256).alias("turns_sha256"),
                       F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op6_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's path names the document that it shows by number; a label of that document is
    the page's: good if of high quality and not toxic."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("label"))
    number = F.regexp_extract(F.coalesce("url", F.lit("")), r"://[^/?#]*/(?:[^/?#]*/)*([0-9]{1,18})(?:[./?#]|$)", 1)
    pages = pages.withColumn("doc_id", F.when(number != "", number).cast("long"))
    out = url_filter(pages.join(labels, "doc_id", "left"), RULES)
    return out.withColumnRenamed("id", "page_id")


def op7_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_pages(table(spark, sf_dir, "pages"), carry=["page_id", "url"])
    return out.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"), carry=["doc_id"], with_text=False)
    return out.select("row.doc_id", "n_lines", "n_dropped", "kept_sha256")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op11_dual_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_secret_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_secrets(table(spark, sf_dir, "documents"), carry=["doc_id"])
    base = [r.kind for r in BASE]
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size("spans") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in base]
    return out.select("row.doc_id", *counts, F.sha2(span_list(F.col("spans"), base), 256).alias("base_sha256"), span_list(F.col("spans")).alias("spans"))


def op13_son_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_quality_rules": op2_quality_rules,
    "op3_minmax_dedup": op3_minmax_dedup,
    "op4_cross_polytope": op4_cross_polytope,
    "op5_chat_windows": op5_chat_windows,
    "op6_url_templates": op6_url_templates,
    "op7_html_blocks": op7_html_blocks,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_line_dedup": op9_line_dedup,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_dual_tree_search": op11_dual_tree_search,
    "op12_secret_index": op12_secret_index,
    "op13_son_collocations": op13_son_collocations,
}


def _secret_sql() -> str:
    """Every rule's leftmost matches; a match starts after the pieces and matches before it.
    Case is spelt out in classes, as the engine folds ASCII letters only."""
    keyword = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
    found = []
    for n, r in enumerate(SECRET_RULES):
        pattern = r.pattern.replace("(?i:(password|passwd|secret|token|api_?key))", f"({keyword})").replace("'", "''")
        found.append(f"""
  SELECT r, {n} AS kind_no, '{r.kind}' AS kind, i, m, p,
    length(regexp_extract(m, '{pattern}', {r.group})) >= {r.least} AS counts
  FROM (SELECT r, unnest(list_append(regexp_extract_all(text, '{pattern}'), '')) AS m, unnest(string_split_regex(text, '{pattern}')) AS p,
          unnest(range(1, len(regexp_extract_all(text, '{pattern}')) + 2)) AS i FROM d WHERE regexp_matches(text, '{pattern}'))""")
    base = ", ".join(f"'{r.kind}'" for r in BASE)
    counts = ", ".join(f"coalesce(max(n_{r.kind}), 0)::BIGINT AS n_{r.kind}" for r in BASE)
    inner = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({' UNION ALL '.join(found)}),
placed AS (
  SELECT *, sum(length(p) + length(m)) OVER (PARTITION BY r, kind_no ORDER BY i) - length(m) AS s FROM found),
spans AS (
  SELECT r, kind, kind_no, s, kind || ':' || s::BIGINT || ':' || (s + length(m))::BIGINT AS span FROM placed WHERE m <> '' AND counts),
listed AS (
  SELECT r, {inner}, string_agg(span, ',' ORDER BY s, kind_no) FILTER (kind IN ({base})) AS base, string_agg(span, ',' ORDER BY s, kind_no) AS spans
  FROM spans GROUP BY r)
SELECT doc_id, {counts}, sha256(coalesce(max(base), '')) AS base_sha256, coalesce(max(spans), '') AS spans
FROM d LEFT JOIN listed USING (r) GROUP BY r, doc_id"""


# Keys are compared as text here; the query compares their 128-bit xxh3.
ORACLE: dict[str, str] = {
    "op9_line_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
keyed AS (
  SELECT r, doc_id, line, i, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
frequent AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10),
judged AS (SELECT k.*, f.key IS NOT NULL AS dropped FROM keyed k LEFT JOIN frequent f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY r, doc_id""",
    "op11_dual_tree_search": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, [x for x in string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') if x <> ''] AS terms FROM documents),
b AS (SELECT row_number() OVER () AS q, item_id, [x for x in string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') if x <> ''] AS terms FROM benchmark),
size AS (SELECT r, doc_id, len(terms)::BIGINT AS n FROM d WHERE len(terms) > 0),
whole AS (SELECT count(*)::BIGINT AS N_, sum(n)::BIGINT AS L_ FROM size),
tf AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY r, term),
asked AS (SELECT q, item_id, term, count(*)::BIGINT AS times FROM (SELECT q, item_id, unnest(terms) AS term FROM b) GROUP BY q, item_id, term),
weight AS (SELECT term, floor(1000 * ln((2 * N_ + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term), whole),
scored AS (
  SELECT q, item_id, doc_id, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * N_) // L_))))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN weight USING (term) JOIN size USING (r), whole GROUP BY q, item_id, doc_id, r)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id ASC NULLS LAST)::INT AS rank FROM scored WHERE score > 0) WHERE rank <= 10""",
    "op12_secret_index": _secret_sql(),
    "op13_son_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
split AS (SELECT lang, [x for x in string_split_regex(piece, '[\x20\x09]+') if x <> ''] AS w FROM pieces),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM split GROUP BY lang HAVING sum(len(w)) > 0),
f AS (
  SELECT lang, gram, len(gram)::INT AS k, count(*)::BIGINT AS f FROM (
    SELECT lang, unnest([w[i:i + k - 1] for i in range(1, len(w) - k + 2)]) AS gram FROM split, (SELECT unnest([1, 2, 3, 4]) AS k))
  GROUP BY lang, gram),
candidate AS (SELECT * FROM f WHERE k >= 2 AND f >= 30),
cuts AS (SELECT lang, gram, k, f, unnest(range(1, k)) AS c FROM candidate),
scored AS (
  SELECT cuts.lang, cuts.gram, cuts.f AS a, c, x.f AS l, y.f AS r, (2000000::HUGEINT * cuts.f // (x.f + y.f))::BIGINT AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.gram = cuts.gram[1:c] JOIN f y ON y.lang = cuts.lang AND y.gram = cuts.gram[c + 1:cuts.k]),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, gram ORDER BY score, c) = 1),
inner_ AS (
  SELECT lang, part, max(f) AS most FROM (
    SELECT lang, f, unnest(flatten([[gram[i:i + m - 1] for i in range(1, k - m + 2)] for m in range(2, k)])) AS part FROM candidate WHERE k > 2)
  GROUP BY lang, part),
shown AS (
  SELECT best.*, array_to_string(best.gram, ' ') AS phrase FROM best LEFT JOIN inner_ ON inner_.lang = best.lang AND inner_.part = best.gram
  WHERE most IS NULL OR 100::HUGEINT * most < 80::HUGEINT * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase COLLATE "binary") AS rank FROM shown) JOIN total USING (lang) WHERE rank <= 2000""",
}
