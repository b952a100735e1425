"""The pipeline against its operators' brute-force versions, and the registered queries."""

from __future__ import annotations

import random

from cases import sentence, words
from test_dedup import brute_components, brute_lines

import __spark_entry__ as entry
import corpus_pipeline


def corpus(spark, tmp_dir, n=240):
    rng = random.Random(11)
    shared = sentence(rng, 90)
    rows = []
    for i in range(n):
        text = sentence(rng, rng.randint(60, 160)) + "\n" + sentence(rng, 40)
        if i % 12 == 0:
            text += "\nA line that  many share"
        if i % 40 == 1:
            text += "\n" + shared
        if i % 30 == 2:
            text = rows[i - 2][1] + " tail"
        rows.append((i, text if i % 50 != 7 else "short", "en", "s", len(text)))
    rows += [(1000, None, None, None, None), (1001, "", "en", "s", 0), rows[5]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_dir}/documents.parquet")
    return rows


def test_pipeline_stage_by_stage(spark, tmp_dir):
    rows = corpus(spark, tmp_dir)
    docs = spark.read.parquet(f"{tmp_dir}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        docs = stage(spark, docs, tmp_dir)
        if k < 4:
            assert docs.columns == columns, name
            docs.write.parquet(f"{tmp_dir}/{k}")
            docs = spark.read.parquet(f"{tmp_dir}/{k}")
        kept[name] = (before, docs.collect())
    before, after = kept["quality_rules"]
    assert {r.doc_id for r in after} == {r[0] for r in rows if len(words(r[1])) >= 50}
    before, after = kept["line_dedup"]
    expected = brute_lines([r.text for r in before], 10)
    assert sorted((r.doc_id, r.text, r.n_chars) for r in after) == sorted((r.doc_id, e[2], len(e[2])) for r, e in zip(before, expected))
    assert any(e[1] for e in expected)
    before, after = kept["near_duplicates"]
    component = brute_components([(r.doc_id, r.text) for r in before])[0]
    assert sorted(r.doc_id for r in after) == sorted(i for i, c in component.items() if i == c)
    assert len(after) < len({r.doc_id for r in before})
    before, after = kept["suffix_dedup"]
    cut = [r for r in after if r.n_chars < {b.doc_id: b.n_chars for b in before}[r.doc_id]]
    assert len(after) == len(before) and len(cut) == 6
    before, after = kept["best_fit_packing"]
    assert sum(r["size"] for r in after) == sum(len(words(r.text)) for r in before)
    total = corpus_pipeline.run(spark, tmp_dir)
    assert sorted(map(tuple, total.collect())) == sorted(map(tuple, after))


def test_every_operator_is_registered(spark):
    names = list(entry.queries())
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)


def test_queries_give_rows(spark):
    for name in ("op1_sentencepiece", "op6_url_templates", "op7_html_blocks", "op9_line_dedup", "op10_best_fit_packing"):
        assert entry.queries()[name](spark, "/root/testdata/sf0.001").limit(1).count() == 1
