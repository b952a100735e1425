"""Reports in order, and whole documents as ordered pieces.

A report's order is a range-partitioned sort by scope and a collated key (the reference sorts
by locale; here the root collation), so a scope of any size is sorted by all tasks. Positions
are counted from the sorted partitions: rows before a partition, plus the row's place in it.

A document is never put together in one value. It is a table of pieces ``(scope, part, piece,
text)`` of at most ``PIECE`` entries; read in order and concatenated they are one valid JSON (or
Markdown) document for each scope.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftgate.functions.text import sanitize_line
from driftgate.session import stored

COLLATION = "UNICODE"
#: Entries of one piece of a document.
PIECE = 1000


def collated(c) -> Column:
    """A string in the order of the root collation."""
    return F.collate(F.col(c) if isinstance(c, str) else c, COLLATION)


def positions(df: DataFrame, *order, group: str = "scope") -> DataFrame:
    """``df`` with ``position`` (long, from 1): each row's place in its group by ``order``.
    Sorted by ranges and written below the checkpoint folder once; what is gathered is one count
    for each group and sorted partition. All columns are sorted and written: give those needed."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [f"_o{i}" for i in range(len(order))]
    keyed = df.select("*", *[(o if isinstance(o, Column) else F.col(o)).alias(x) for o, x in zip(order, names)])
    laid = keyed.repartitionByRange(n, group, *names).sortWithinPartitions(group, *names).drop(*names)
    laid = stored(laid.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "positions")
    counts = laid.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(group, "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # At most one row for each group and partition: as many as there are groups, or partitions.
    return laid.join(counts, [group, "_part"]).withColumn("position", (F.col("_before") + F.col("_at") - F.col("_first") + 1).cast("long")) \
        .drop("_part", "_at", "_first", "_before")


def ordered_findings(findings: DataFrame) -> DataFrame:
    """O1: findings with their position by key, then code; ties keep the order of emission."""
    return positions(findings, collated("key"), collated("code"), "field_ord", "field")


def ordered_by_key(df: DataFrame, key: str = "entity_key", *ties) -> DataFrame:
    """O2: entities, dependencies or diffs with their position by key."""
    return positions(df, collated(key), *ties)


def _pieces(entries: DataFrame, part: int, text: str = "json") -> DataFrame:
    """(scope, part, piece, text) of entries (scope, position, json): the entries of a piece
    joined by commas, and a comma before every piece but the first."""
    piece = F.floor((F.col("position") - 1) / PIECE).cast("long")
    g = entries.groupBy("scope", piece.alias("piece")).agg(F.array_sort(F.collect_list(F.struct("position", text))).alias("l"))
    joined = F.array_join(F.transform("l", lambda e: e[text]), ",")
    return g.select("scope", F.lit(part).alias("part"), "piece", F.concat(F.when(F.col("piece") > 0, ",").otherwise(""), joined).alias("text"))


def _fixed(scopes: DataFrame, part: int, text: Column | str) -> DataFrame:
    return scopes.select("scope", F.lit(part).alias("part"), F.lit(0).cast("long").alias("piece"), (F.lit(text) if isinstance(text, str) else text).alias("text"))


def sarif_document(findings: DataFrame, gate: DataFrame, tool: str, tool_version: str) -> DataFrame:
    """One SARIF 2.1.0 document for each scope of ``gate``, as pieces: the head with the
    tool's rules (at most one for each rule code), the results in report order, the foot.
    ``findings`` need a position (``ordered_findings``)."""
    first = findings.groupBy("scope", "code").agg(F.min(F.struct("position", "message")).alias("f"))
    rule = F.struct(F.col("code").alias("id"), F.struct(F.col("code").alias("text")).alias("shortDescription"),
                    F.struct(sanitize_line(F.col("f.message")).alias("text")).alias("fullDescription"))
    rules = first.groupBy("scope").agg(F.array_sort(F.collect_list(F.struct(F.col("f.position").alias("position"), F.to_json(rule).alias("json")))).alias("r"))
    head = gate.select("scope").join(rules, "scope", "left")
    listed = F.coalesce(F.array_join(F.transform("r", lambda r: r["json"]), ","), F.lit(""))
    driver = F.concat(F.lit('{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{"tool":{"driver":'),
                      F.lit("{"), F.lit(f'"name":"{tool}","version":"{tool_version}","rules":['), listed, F.lit(']}},"results":['))
    level = F.when(F.col("severity") == "fail", "error").when(F.col("severity") == "warn", "warning").otherwise("note")
    place = F.struct(F.struct(F.struct(F.regexp_replace("path", r"\\", "/").alias("uri")).alias("artifactLocation"),
                              F.struct(F.coalesce("line", F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation"))
    where = F.when(F.col("path").isNotNull() & (F.col("path") != ""), F.array(place)).otherwise(F.array().cast(
        "array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int>>>>"))
    result = F.struct(F.col("code").alias("ruleId"), level.alias("level"), F.struct(sanitize_line(F.col("message")).alias("text")).alias("message"),
                      where.alias("locations"))
    body = _pieces(findings.select("scope", "position", F.to_json(result).alias("json")), 1)
    return _fixed(head, 0, driver).unionByName(body).unionByName(_fixed(gate.select("scope"), 2, "]}]}"))


def json_document(findings: DataFrame, fdiff: DataFrame, gate: DataFrame, warnings: list[str] | None = None) -> DataFrame:
    """One JSON document for each scope of ``gate`` (exit code, findings, warnings, diffs)
    as pieces. ``findings`` and ``fdiff`` need a position."""
    whole = {"ignoreNullFields": "false"}
    f = F.to_json(F.struct("severity", "code", "key", "field", "message", "path", "line", "confidence"))
    d = F.to_json(F.struct(F.col("entity_key").alias("key"), "field", "kind",
                           F.coalesce("a_str", F.col("a_num").cast("string"), F.col("a_bool").cast("string")).alias("approved"),
                           F.coalesce("c_str", F.col("c_num").cast("string"), F.col("c_bool").cast("string")).alias("current"),
                           "confidence", F.col("blocking_eligible").alias("blockingEligible")), whole)
    said = F.to_json(F.array(*[F.lit(w) for w in warnings])) if warnings else F.lit("[]")
    scopes = gate.select("scope")
    return (_fixed(gate, 0, F.concat(F.lit('{"exitCode":'), F.col("exit_code").cast("string"), F.lit(',"findings":[')))
            .unionByName(_pieces(findings.select("scope", "position", f.alias("json")), 1))
            .unionByName(_fixed(scopes, 2, F.concat(F.lit('],"warnings":'), said, F.lit(',"diffs":['))))
            .unionByName(_pieces(fdiff.select("scope", "position", d.alias("json")), 3))
            .unionByName(_fixed(scopes, 4, "]}")))


def change_report(previous: DataFrame, proposed: DataFrame, changes: DataFrame, findings: DataFrame, warnings: list[str] | None = None) -> DataFrame:
    """The update report as lines (scope, section, position, text): the counts, every added
    and removed key, the findings in report order, the warnings. One row is one line, so a scope
    with any number of keys is no single value. ``findings`` need a position."""
    both = previous.select("scope", F.lit(1).alias("old"), F.lit(0).alias("new")).unionByName(
        proposed.select("scope", F.lit(0).alias("old"), F.lit(1).alias("new"))).groupBy("scope").agg(F.sum("old").alias("old"), F.sum("new").alias("new"))
    one = F.lit(1).cast("long").alias("position")
    line = lambda n, text: [F.lit(n).alias("section"), one, text.alias("text")]
    counts = both.select("scope", *line("0-previous", F.concat(F.lit("- Previous: "), F.col("old").cast("string")))).unionByName(
        both.select("scope", *line("1-proposed", F.concat(F.lit("- Proposed: "), F.col("new").cast("string")))))
    keys = positions(changes.withColumn("section", F.when(F.col("change") == "added", "2-added").otherwise("3-removed")), "section", collated("entity_key"))
    first = keys.groupBy("scope", "section").agg(F.min("position").alias("_first"))
    keys = keys.join(first, ["scope", "section"]).select(
        "scope", "section", (F.col("position") - F.col("_first") + 1).alias("position"),
        F.concat(F.when(F.col("change") == "added", "- Added: ").otherwise("- Removed: "), F.col("entity_key")).alias("text"))
    rows = findings.select("scope", F.lit("4-findings").alias("section"), "position", F.concat(
        F.lit("- **"), F.col("severity"), F.lit("** `"), F.col("code"), F.lit("` "), F.col("key"), F.lit(": "), sanitize_line(F.col("message"))).alias("text"))
    out = counts.unionByName(keys).unionByName(rows)
    for n, w in enumerate(warnings or []):
        out = out.unionByName(both.select("scope", F.lit("5-warnings").alias("section"), F.lit(n + 1).cast("long").alias("position"),
                                          F.concat(F.lit("- "), sanitize_line(F.lit(w))).alias("text")))
    return out
