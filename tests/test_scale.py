"""What keeps memory, disk and moved data bounded, and whole results beside it."""

import datetime as dt
import os

import pytest
from helpers import SF001
from test_plans import plan

from driftgate.plans import bindings as B
from driftgate.plans import drift
from driftgate.plans.catalog import QUERIES


def rows(df):
    return sorted(map(str, df.collect()))


def lineitem(spark, folder, days):
    schema = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
              "l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz")
    spark.createDataFrame([(i, i % 3, i, 1, 1.0, 1.0, 0.0, 0.0, "N", "O", dt.datetime.fromisoformat(d)) for i, d in enumerate(days)], schema) \
        .write.parquet(os.path.join(folder, "lineitem.parquet"))


def test_only_what_decides_moves_before_the_latest_is_chosen(spark):
    for facts in (drift.current_facts, drift.approved_facts):
        txt = plan(facts(spark, SF001)).splitlines()
        moved = [n for n, line in enumerate(txt) if "Exchange" in line and "REBALANCE" in line]
        assert len(moved) == 1  # in pieces of bounded size, whatever a scan's split holds
        below = "\n".join(txt[moved[0]:])
        assert "sha2" not in below and "deprecated" not in below
        assert "sha2" in "\n".join(txt[:moved[0]])


def test_described_after_is_described_before(spark):
    from driftgate.operators.reconcile import reconcile
    before = reconcile(B.observations(spark, SF001, B.CURRENT_AS_OF), B.CURRENT_AS_OF, B.STALE_AFTER_DAYS)
    after = reconcile(B.observed(spark, SF001, B.CURRENT_AS_OF), B.CURRENT_AS_OF, B.STALE_AFTER_DAYS, describe=B.described)
    assert before.schema == after.schema and rows(before) == rows(after)


def test_a_snapshot_for_every_month(spark, tmp_dir):
    lineitem(spark, tmp_dir, ["1995-01-31", "1995-02-01", "1995-02-28", "1995-12-31", "1996-01-01", "1995-01-02"])
    got = [tuple(r) for r in QUERIES["s8_snapshot_dates"](spark, tmp_dir).orderBy("snapshot_date").collect()]
    months = ["1995-01-01", "1995-02-01", "1995-12-01", "1996-01-01"]
    assert got == list(zip(months, [None, *months]))


def test_many_dates_in_one_pass(spark, tmp_dir):
    from driftgate.sources.manifest import vacuum
    from driftgate.sources.snapshots import SnapshotMeta, read_snapshot, write_snapshot, write_snapshots
    df = spark.createDataFrame([("2001-01-01", "a"), ("2001-02-01", "b"), ("2001-01-01", "c")], "d string, k string")
    path = tmp_dir + "/s"
    write_snapshots(df, path, [SnapshotMeta(d, d) for d in ("2001-01-01", "2001-02-01", "2001-03-01")], "d")
    read = lambda d: sorted(r["k"] for r in read_snapshot(spark, path, df.schema, d)[0].collect())
    assert [read(d) for d in ("2001-01-01", "2001-02-01", "2001-03-01")] == [["a", "c"], ["b"], []]
    write_snapshot(df.filter("k = 'c'"), path, SnapshotMeta("2001-01-01", "later"))
    assert read("2001-01-01") == ["c"] and vacuum(spark, path) == 1 and read("2001-02-01") == ["b"]


def test_tree_in_parts_is_the_whole_tree(spark, tmp_dir, monkeypatch):
    spark.createDataFrame([(i, i % 12) for i in range(40)], "o_orderkey long, o_custkey long").write.parquet(tmp_dir + "/orders.parquet")
    whole = rows(QUERIES["s11_corpus"](spark, tmp_dir))
    removed, sizes = [], []
    from driftgate.operators import discovery as D
    from driftgate.sources import manifest
    remove, read = manifest.remove, D.read_corpus
    monkeypatch.setattr(manifest, "remove", lambda s, p: (removed.append(p), remove(s, p)))
    monkeypatch.setattr(D, "read_corpus", lambda s, root, scope: (sizes.append(sum(len(f) for _, _, f in os.walk(root.removeprefix("file:")))), read(s, root, scope))[1])
    monkeypatch.setattr(B, "TREE_FILES", 10)
    parts = B.tree_parts(spark, tmp_dir)
    assert parts == 6  # 40 documents, 12 code files
    assert rows(QUERIES["s11_corpus"](spark, tmp_dir)) == whole
    assert len(removed) == parts and not any(os.path.exists(p) for p in removed)
    assert sum(sizes) == 52 and max(sizes) < 52


def test_last_known_good_of_records_is_that_of_rows(spark):
    from driftgate.operators.publish import last_known_good
    long = last_known_good(drift.approved_facts(spark, SF001), drift.current_facts(spark, SF001))
    wide = last_known_good(drift.approved_wide(spark, SF001), drift.current_wide(spark, SF001)).select(*long.columns)
    assert rows(wide) == rows(long) and wide.filter("origin = 'last-known-good'").count() > 0
    assert plan(QUERIES["r4_last_known_good"](spark, SF001)).count("REBALANCE") == 2  # each side once


@pytest.mark.parametrize("part", ["findings", "gate", "fdiff"])
def test_a_report_of_several_parts_diffs_once(spark, part):
    run = drift.run(spark, SF001, once=True)
    assert "lineitem" not in plan(getattr(run, part)) and "l_partkey" not in plan(getattr(run, part))
    assert rows(getattr(run, part)) == rows(getattr(drift.run(spark, SF001), part))


def test_both_dates_in_one_pass(spark, tmp_dir):
    # Rows of both dates, of the later only, a part that left (17), a key without rows before, equal times.
    days = ["2000-01-01", "2001-02-28", "2001-03-01", "2001-03-02", "2001-11-05", "2001-11-06", "2000-01-01"]
    schema = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
              "l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz")
    at = [(d, k, s) for d in days for k in (1, 3, 17, None) for s in (0, 1, 2, 4, None)] + [(None, 1, 1), ("2001-10-10", 5, 2)]
    spark.createDataFrame([(i, k, s, i % 7, float(i), 1.0, i % 3 / 20, i % 5 / 50, "NRA"[i % 3], "OF"[i % 2], d and dt.datetime.fromisoformat(d))
                           for i, (d, k, s) in enumerate(at)], schema).repartition(3).write.parquet(os.path.join(tmp_dir, "lineitem.parquet"))
    spark.createDataFrame([(k,) for k in (1, 2, 3, 5, 17)], "p_partkey long").write.parquet(os.path.join(tmp_dir, "part.parquet"))
    approved, current = drift.both_wide(spark, tmp_dir)
    assert rows(approved) == rows(drift.approved_wide(spark, tmp_dir)) and rows(current) == rows(drift.current_wide(spark, tmp_dir))
    one, each = drift.run(spark, tmp_dir), drift.run(spark, tmp_dir, lazy=True)
    assert "lineitem" not in plan(one.fdiff) and "l_orderkey" not in plan(one.findings)  # read once, before
    assert all(rows(getattr(one, part)) == rows(getattr(each, part)) for part in ("fdiff", "findings", "gate", "lock"))


def test_the_diff_needs_values_only(spark):
    from driftgate.operators.diff import field_diff
    from driftgate.operators.lock import VALUES, lock_records, values_only
    approved, current, deps = drift.approved_wide(spark, SF001), drift.current_wide(spark, SF001), B.dependencies(spark, SF001)
    slim = lock_records(deps, values_only(approved.filter("entity_key not like '%1'")), B.APPROVED_AS_OF, [])
    assert all(f.dataType.names == VALUES for f in slim.schema["facts"].dataType)
    whole = lock_records(deps, approved.filter("entity_key not like '%1'"), B.APPROVED_AS_OF, [])  # some are unavailable
    assert rows(field_diff(slim, current, [])) == rows(field_diff(whole, current, []))


def test_a_lock_line_is_parsed_once(spark, tmp_dir):
    from driftgate.sources.lockio import read_lock
    spark.createDataFrame([("{}",)], "value string").write.text(tmp_dir + "/t")
    txt = plan(read_lock(spark.read.text(tmp_dir + "/t"))[0])
    assert txt.count("from_json(") <= 2  # the line, its members


def test_plain_search_before_the_patterns_changes_nothing(spark):
    from pyspark.sql import functions as F
    from driftgate.functions.scanners import redact_members
    from driftgate.functions.text import SECRET_ANY, SECRET_KEY_WORDS, contains_secret, scrub_secrets
    from driftgate.schemas import REDACTED, SECRET_KEY_PATTERN, SECRET_PATTERNS
    from driftgate.sources.lockio import scrub_json_text
    said = [*[f"sk-{'a' * 20}", f"SK-{'a' * 20}", f"xai-{'b' * 20}", f"AIza{'c' * 20}", f"bEaReR {'d' * 20}", "Api_Key: 'v'", "API-KEY=\"w\"", "apikey='x'"],
            *[f'{w.upper()} = "v"' for w in SECRET_KEY_WORDS.split("|")], "sk-short", "plain", "", "api", "se\u212aret: \"v\"", None]
    keys = [*SECRET_KEY_WORDS.split("|"), "Password", "p\\u0061ssword", "\u017fecret", "to\u212aen", "author\u0131zation", "plain"]
    texts = [*said, *[f'{{"{k}": {{"a": [1, "v"]}}, "b": 1}}' for k in keys], *[f'{{"note": "{k}", "b": "x"}}' for k in keys]]
    df = spark.createDataFrame([(t,) for t in texts], "t string")

    out = F.col("t")
    for p in SECRET_PATTERNS:
        out = F.regexp_replace(out, p, REDACTED)
    out = F.regexp_replace(out, r'(?i:(' + SECRET_KEY_WORDS + r')(\s*[:=]\s*)")[^"]*"', "$1$2\"" + REDACTED + '"')
    for r in df.select("t", F.col("t").rlike(SECRET_ANY), contains_secret("t"), out, scrub_secrets("t"), scrub_json_text(F.col("t"))).collect():
        assert r[1] == r[2] and r[3] == r[4], r[0]
        assert r[5] == (None if r[3] is None else redact_members(r[3], SECRET_KEY_PATTERN, REDACTED)), r[0]


def test_small_files_travel_together(spark, tmp_dir, monkeypatch):
    import pandas as pd
    from driftgate.operators import discovery as D
    names = [f"d{i % 3}/f {i}%20#.py" for i in range(D.LISTED + 10)]  # taken as they are, not as parts of a URI
    list(D.write_files("file:" + tmp_dir)(iter([pd.DataFrame({"path": [*names, None], "content": [*map(str, range(len(names))), "x"]})])))
    asked = pd.DataFrame({"abs": [f"{tmp_dir}/{n}" for n in names], "path": names})
    got = list(D._read_files(iter([asked.head(5), asked.tail(len(names) - 5)])))
    assert [len(g) for g in got] == [D.LISTED, 10]
    assert pd.concat(got)["content"].tolist() == [*map(str, range(len(names)))]
    monkeypatch.setattr(D, "SENT_BYTES", 2)
    assert max(len(g) for g in D._read_files(iter([asked]))) == 2  # large ones do not wait for others
    written = spark.createDataFrame([(n,) for n in [*names, "gone.py"]], "path string")
    D.remove_files(written, tmp_dir)
    assert not [f for _, _, found in os.walk(tmp_dir) for f in found]


def test_folders_are_listed_by_many_tasks(spark, tmp_dir):
    from driftgate.operators import discovery as D
    for i in range(8):
        os.makedirs(f"{tmp_dir}/d{i}")
        open(f"{tmp_dir}/d{i}/a.py", "w").close()
    before = set(os.listdir(spark.sparkContext.getCheckpointDir().removeprefix("file:")))
    assert D.read_corpus(spark, tmp_dir, "r").count() == 8
    from driftgate.session import ensure_checkpoint_dir
    top = ensure_checkpoint_dir(spark).removeprefix("file:")
    new = [f"{top}/{n}" for n in set(os.listdir(top)) - before]
    assert {os.path.basename(n).split("-")[0] for n in new} == {"listing"}  # one root: its paths are unique
    assert max(sum(f.endswith(".parquet") for f in os.listdir(n)) for n in new) > 1


def test_a_lock_is_packed_in_bounded_files(spark, tmp_dir, monkeypatch):
    from pyspark.sql import functions as F
    from driftgate.operators.lock import lock_records
    from driftgate.sources import lockio
    facts = drift.approved_wide_once(spark, SF001)
    txt = plan(facts).splitlines()
    moved = [n for n, line in enumerate(txt) if "REBALANCE" in line]
    assert len(moved) == 1 and not any("entity_key" in line for line in txt[moved[0]:])  # raw columns only
    assert rows(facts) == rows(drift.approved_wide(spark, SF001))
    lines = lockio.lock_lines(lock_records(B.dependencies(spark, SF001), facts, B.APPROVED_AS_OF, []), B.APPROVED_AS_OF).limit(100).coalesce(1)
    monkeypatch.setattr(lockio, "FILE_LINES", 30)
    assert lockio.write_lock(lines, tmp_dir + "/lock") == 100
    text = spark.read.text(tmp_dir + "/lock")
    per_file = [r["count"] for r in text.groupBy(F.input_file_name()).count().collect()]
    assert len(per_file) >= 4 and max(per_file) <= 30 and sum(per_file) == 100
    on_disk = sum(os.path.getsize(f"{tmp_dir}/lock/{f}") for f in os.listdir(tmp_dir + "/lock"))
    assert on_disk * 4 < text.agg(F.sum(F.length("value"))).first()[0]
    assert lockio.read_lock(text)[0].count() == 100


def test_text_is_put_in_lower_case_once(spark):
    from driftgate.functions.text import contains_secret
    df = spark.createDataFrame([("Bearer " + "x" * 20,), ("plain",), (None,)], "t string")
    found = df.filter(contains_secret("t"))
    assert plan(found).count("lower(") <= 2 and found.count() == 1  # the plan names a filter's condition twice
