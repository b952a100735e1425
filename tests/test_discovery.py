"""Discovery (S11, F1-F8, D1-D11) on source trees written to a temp folder."""

import os

from driftgate.operators import discovery as D
from driftgate.schemas import DEFAULT_IGNORE_GLOBS


def write(root, rel, text):
    p = os.path.join(root, rel)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "w") as fh:
        fh.write(text)


def discover_tree(spark, root):
    return {r["entity_key"]: r for r in D.discover_files(D.read_corpus(spark, root, "repo", DEFAULT_IGNORE_GLOBS)).collect()}


def test_one_reference_of_each_file_type(spark, tmp_dir):
    write(tmp_dir, "billing/jobs/summary.mjs", "// nightly\nimport { OpenAI as Client } from 'openai';\n\n\n"
          "const answer = Client.responses.create({\n  input: 'x',\n  model: 'o3-mini-2025-01-31',\n});\n")
    write(tmp_dir, "billing/jobs/rank.py", "import anthropic\n\nMODEL = 1\nmodel = \"claude-3-haiku-20240307\"\n")
    write(tmp_dir, "deploy/values.yml", "replicas: 2\nmodelId: gemini-1.5-flash\n")
    write(tmp_dir, "deploy/flags.json", '{"chat": {"model_id": "grok-2"}}')
    write(tmp_dir, "deploy/.env.example", "XAI_MODEL='grok-2'\nOTHER=1\n")
    deps = discover_tree(spark, tmp_dir)
    assert set(deps) == {"openai:o3-mini-2025-01-31", "anthropic:claude-3-haiku-20240307", "google:gemini-1.5-flash", "xai:grok-2"}
    call = deps["openai:o3-mini-2025-01-31"]
    assert (call["path"], call["line"], call["confidence"]) == ("billing/jobs/summary.mjs", 7, 0.9)  # where the literal stands
    assert deps["anthropic:claude-3-haiku-20240307"]["line"] == 4
    assert deps["xai:grok-2"]["confidence"] == 0.85 and deps["xai:grok-2"]["n_occurrences"] == 2


def test_corpus_reads_every_file_that_counts(spark, tmp_dir):
    """Names that begin with a dot or an underscore, upper-case extensions, and nothing of
    skipped directories, ignored, minified or other files."""
    kept = ["src/__init__.py", "src/_app.tsx", "__tests__/t.ts", ".eslintrc.json", "src/.prod.env.example", "src/UP.PY", "deploy/.env.example", "src/ok.py"]
    for rel in kept:
        write(tmp_dir, rel, "x = 1\n")
    for rel in ("node_modules/p/i.js", ".git/a.py", "src/.cache/b.py", "src/x.min.js", "README.md", "src/data.csv"):
        write(tmp_dir, rel, "x = 1\n")
    write(tmp_dir, "big.json", '["' + "x" * 50_001 + '"]')
    with open(os.path.join(tmp_dir, "src/latin.py"), "wb") as fh:
        fh.write(b"# caf\xe9\n")
    got = {r["path"]: r["content"] for r in D.read_corpus(spark, tmp_dir, "repo", DEFAULT_IGNORE_GLOBS).collect()}
    assert set(got) == {*kept, "src/latin.py"}
    assert got["src/latin.py"] == "# caf\ufffd\n"


def test_roots_overlap_and_share_names(spark, tmp_dir):
    write(tmp_dir, "a/main.py", "import anthropic\n")
    write(tmp_dir, "b/main.py", 'model = "gpt-4o"\n')
    for roots in (["a", "b", "a/sub", ""], ["a/", "./b"], [".", "b"]):
        files = D.read_corpora(spark, tmp_dir, roots, "repo")
        assert sorted(r["path"] for r in files.collect()) == ["a/main.py", "b/main.py"], roots
    assert [r["provider"] for r in D.discover_files(files).collect()] == ["openai"]


def test_calls_and_imports_over_several_lines(spark):
    text = """import {
  OpenAI as oa,
} from "openai";
oa.chat.create({ model: "claude-opus-4-0" });
oa.chat.create({ messages: [{ role: "user", parts: [{ t: "a, b" }] }], model: "gpt-4o" });
other.create(
  {
    tools: { a: { b: 1 } },
    'model': 'plain-name',
  });
import * as Z from "@anthropic-ai/sdk";
oa.chat.create({ note: "model: 'gpt-4.1'" });
Z.messages.create({ model: "gpt-4o" });"""
    lines = spark.createDataFrame([("r", "a.ts", i + 1, t) for i, t in enumerate(text.split("\n"))], "scope string, path string, line int, text string")
    hits = {(r["line"], r["model_id"]): r for r in D.scan_js(lines.repartition(4)).filter("kind = 'sdk'").collect()}
    assert set(hits) == {(4, "claude-opus-4-0"), (5, "gpt-4o"), (9, "plain-name"), (13, "gpt-4o")}
    assert [hits[k]["provider"] for k in ((4, "claude-opus-4-0"), (5, "gpt-4o"), (13, "gpt-4o"))] == ["openai", "openai", "anthropic"]
    assert hits[9, "plain-name"]["column"] == len("    'model': ")
    assert hits[4, "claude-opus-4-0"]["column"] == text.split("\n")[3].index('"claude')


def test_skips_path_like_strings(spark, tmp_dir):
    write(tmp_dir, "lib/where.ts", "export const where = { model: 'assets/gpt-4o/logo' };\n")
    assert discover_tree(spark, tmp_dir) == {}


def test_low_confidence_literal(spark, tmp_dir):
    write(tmp_dir, "loose.ts", 'const modelHint = { model: "gpt-4o" };\n')
    hit = discover_tree(spark, tmp_dir)["openai:gpt-4o"]
    assert 0 < hit["confidence"] < 0.6 and hit["low_confidence"]


def test_python_hint_precedence_and_sdk_confidence(spark):
    rows = [("r", "a.py", 1, "import openai"), ("r", "a.py", 2, 'x = client.chat.completions.create(model="my-model")'),
            ("r", "a.py", 3, "from anthropic import A; import xai"), ("r", "a.py", 4, 'model = "claude-3-opus-latest"'),
            ("r", "b.py", 1, 'model = "gpt-4.1"')]
    lines = spark.createDataFrame(rows, "scope string, path string, line int, text string")
    hits = {(r["path"], r["line"], r["model_id"]): r for r in D.scan_python(lines).collect()}
    # an id failing F5 is refused even on an SDK line
    assert ("a.py", 2, "my-model") not in hits
    assert hits[("a.py", 4, "claude-3-opus-latest")]["provider"] == "xai"  # last hint pushed wins
    assert hits[("b.py", 1, "gpt-4.1")]["provider"] == "openai"  # inferred, no hint in that file


def test_segmented_carry_forward_matches_plain_window(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    from driftgate.operators.segmented import segmented_last_non_null, segmented_row_number
    df = spark.range(0, 5000).select(F.lit("k").alias("k"), (F.col("id") * 3).alias("pos"),
                                     F.when(F.col("id") % 997 == 0, F.col("id").cast("string")).alias("v"))
    got = segmented_last_non_null(df, ["k"], "pos", "v", "c", bucket=64)
    w = Window.partitionBy("k").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    exp = df.withColumn("c", F.last("v", ignorenulls=True).over(w))
    assert sorted(got.collect()) == sorted(exp.collect())
    rn = segmented_row_number(df, ["k"], "pos", "rn", bucket=64)
    exp2 = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("pos")))
    assert sorted(rn.collect()) == sorted(exp2.collect())


def test_glob_shapes():
    import re
    cases = [("**/node_modules/**", "a/node_modules/b.js", True), ("**/node_modules/**", "a/node_modulesx/b", False),
             ("**/*.min.js", "x/y/app.min.js", True), ("**/*.min.js", "x/app.js", False),
             ("**/secret.txt", "a/secret.txt", True), ("src/*.ts", "src/a.ts", True), ("src/*.ts", "src/x/a.ts", False),
             ("src/**/*.ts", "src/x/y/a.ts", True), ("README.md", "docs/README.md", True)]
    for g, path, want in cases:
        assert bool(re.search(D.glob_to_regex(g), path)) == want, (g, path)


def test_pinned_hint_states_sf001(spark):
    """FIXTURES B3: the all-Python corpus from orders; 'model = "gpt-4o"' lines by the
    carried import hint: no hint / openai / anthropic = 682 / 604 / 589 at sf0.01."""
    from pyspark.sql import functions as F
    from driftgate.operators.segmented import segmented_row_number
    from driftgate.plans import bindings as B
    o = B.table(spark, "/root/testdata/sf0.01", "orders").select("o_orderkey", "o_custkey")
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    f = o.select(F.lit("r").alias("scope"),
                 F.concat(F.lit("svc"), (c % 20).cast("string"), F.lit("/f"), c.cast("string"), F.lit(".py")).alias("path"),
                 k.alias("o_orderkey"), B._pick(B.PY_LINES, k % 8).alias("text"))
    lines = segmented_row_number(f, ["scope", "path"], "o_orderkey", "line").select("scope", "path", "line", "text")
    hits = D.scan_python(lines).filter((F.col("model_id") == "gpt-4o") & (F.col("snippet") == 'model = "gpt-4o"'))
    got = {r["provider"]: r["count"] for r in hits.groupBy("provider").count().collect()}
    # no hint -> inferred openai
    assert got == {"openai": 682 + 604, "anthropic": 589}


def test_js_comments_are_ignored(spark):
    rows = [("r", "a.ts", 1, '// client.chat.completions.create({ model: "gpt-4o" })'),
            ("r", "a.ts", 2, ' * @example { model: "gpt-4.1" }'),
            ("r", "a.ts", 3, 'const u = "https://x.example/api"; /* { model: "o3" } */ const m = { model: "o3-mini" };')]
    lines = spark.createDataFrame(rows, "scope string, path string, line int, text string")
    got = {(r["line"], r["model_id"]) for r in D.scan_js(lines).collect()}
    assert got == {(3, "o3-mini")}


def _js(spark, text):
    lines = spark.createDataFrame([("r", "a.ts", i + 1, t) for i, t in enumerate(text.split("\n"))], "scope string, path string, line int, text string")
    return {(r["line"], r["column"], r["model_id"], r["kind"], r["provider"]) for r in D.scan_js(lines.repartition(3)).collect()}


def test_calls_at_any_depth(spark):
    deep = "{ a: " * 40 + "1" + " }" * 40
    text = "\n".join([
        "create({ response_format: { type: 'json_schema', json_schema: { schema: { type: 'object', properties: { city: { type: 'string' } } } } }, model: 'house' });",
        f"go({{ x: {deep}, modelId: 'deep-house' }});",
        "new Client({ model: 'not-called' }); a?.b({ model: 'optional' }); f({ model: 'a' + 'b' });",
        "outer(inner({ model: 'in-1' }), { model: 'out-1' }); const s = \"run({ model: 'text' })\", r = /[\"'{]/;",
        "t(`x ${ g({ model: 'in-template' }) } { model: 'words' }`);",
        "// run({ model: 'comment' })", "/* run({", "model: 'comment' }) */", "h({ 'model_id': 'last' });"])
    got = {(line, m) for line, _, m, kind, _ in _js(spark, text) if kind == "sdk"}
    assert got == {(1, "house"), (2, "deep-house"), (4, "in-1"), (4, "out-1"), (5, "in-template"), (9, "last")}
    column = {m: c for _, c, m, _, _ in _js(spark, text)}
    assert column["house"] == text.index("'house'") and column["last"] == text.split("\n")[8].index("'last'")


def test_unbalanced_code_does_not_stop_the_scan(spark):
    assert {m for _, _, m, _, _ in _js(spark, "}}}) ]\nx({ model: 'gpt-4o' });\n'open\nfoo(({ model: 'gpt-4o-mini' }\n`never closed ${ y({model: 'o3-mini'})")} == {"gpt-4o", "gpt-4o-mini", "o3-mini"}
    assert _js(spark, "") == set() == _js(spark, "model")


def test_yaml_nesting_and_validity():
    from driftgate.functions.scanners import yaml_strings
    assert yaml_strings("a:\n  b:\n  - c: {d: [1, {model: x}]}\n    model: 'y z'\n  e: |\n    model: no\nmodel: \"q\" # c\n") == [
        ("model", "x"), ("model", "y z"), ("model", "q")]
    assert yaml_strings("key: first\n  second\nmodel: v") == [("key", "first"), ("model", "v")]
    assert yaml_strings("k:\n- a\n- model: m\n  n: o\nz: {p: q,\n r: s}") == [("model", "m"), ("n", "o"), ("p", "q"), ("r", "s")]
    for bad in ("a: b\n  c: d", "a: b\na: c", "a: {b: c", "a: [1, 2}", "a:\n\tb: c", "a: 'b", "a: b: c", "a: 1\n---\nb: 2", "a:\n  b: c\n d: e", "- a\nb: c", "a: 'b' c"):
        assert yaml_strings(bad) is None, bad
    for none in ("", "# x\n", "text", "- 1\n- 2\n", "--- \n"):
        assert yaml_strings(none) == [], none
    assert len(yaml_strings("".join(f"{'  ' * i}k{i}:\n" for i in range(300)) + "  " * 300 + "model: m")) == 1


def test_a_huge_directory_is_listed_in_bounded_batches(spark, tmp_dir):
    import pandas as pd
    n = 100_000
    os.makedirs(os.path.join(tmp_dir, "big"))
    for i in range(n):
        os.close(os.open(os.path.join(tmp_dir, "big", f"f{i}.txt" if i % 1000 else f"f{i}.py"), os.O_CREAT))
    sizes = [len(b) for b in D._list_dirs(iter([pd.DataFrame({"dir": [tmp_dir + "/big"], "rel": ["big"]})]))]
    assert sum(sizes) == n and max(sizes) <= D.LISTED
    assert D.list_corpus(spark, tmp_dir, [""]).count() == n // 1000
    assert D.read_corpora(spark, tmp_dir, ["big"], "r").count() == n // 1000
