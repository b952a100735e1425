"""Discovery: find model references in source text.

Input is a line table ``(scope, path, line, text)`` (D1 turns file contents into it), plus
for JSON a document table ``(scope, path, content)``. Scanners are regex jobs over built-in
expressions, or, where nesting counts (JS/TS, YAML), a linear scan of each file, behind a cheap
``contains`` prefilter; all scanners emit the same hit schema and are unioned (D10), then consolidated per (scope, provider, model_id) with
partial aggregates only (D9): occurrences stay a table (the hits) instead of an array.
"""

from __future__ import annotations

import math
import re
import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from driftgate.functions.identity import identifier_kind, infer_provider, looks_like_model_id, model_key
from driftgate.functions.jsontext import json_ok
from driftgate.functions.scanners import js_imports, js_properties, yaml_strings
from driftgate.functions.text import js_trim, snippet
from driftgate.operators.segmented import segmented_last_non_null
from driftgate.schemas import (
    ACCEPT_ANY_ID_CONFIDENCE, CODE_EXTS, DATA_EXTS, ENV_MODEL_KEYS, LOW_CONFIDENCE_THRESHOLD,
    PROVIDER_PACKAGES, PYTHON_EXTS, PYTHON_MODEL_PATTERNS, PYTHON_PROVIDER_HINTS, SKIP_DIR_NAMES,
)

# Tasks get the functions below by value: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ----------------------------------------------------------------------------- paths

SKIP_DIR_RE = "(^|/)(" + "|".join(re.escape(d) for d in SKIP_DIR_NAMES) + r"|\.[^/]*)/"


def path_kept(path) -> Column:
    """no directory on the path is a skipped name or a dot-directory."""
    return ~_c(path).rlike(SKIP_DIR_RE)


def glob_to_regex(pattern: str) -> str:
    """an ignore glob as an anchored path regex (driver side, once per pattern).

    Shapes: ``**/x/**`` any segment equals x; ``**/x*`` basename glob or suffix;
    ``**/x`` equals, ends with or contains ``/x``; ``a*b`` anchored glob where ``**``
    crosses directories and ``*`` does not; a literal equals or ends with ``/lit``."""
    p = pattern.replace("\\", "/")
    if p.startswith("**/") and p.endswith("/**"):
        return "(^|/)" + re.escape(p[3:-3]) + "(/|$)"
    if p.startswith("**/"):
        rest = p[3:]
        if "*" in rest:
            base = "[^/]*".join(re.escape(x) for x in rest.split("*"))
            return "(^|/)" + base + "$|" + re.escape(rest.replace("*", "")) + "$"
        return "^" + re.escape(rest) + "$|/" + re.escape(rest)
    if "*" in p:
        parts = p.split("**")
        body = ".*".join("[^/]*".join(re.escape(x) for x in part.split("*")) for part in parts)
        return "^" + body + "$"
    return "(^|/)" + re.escape(p) + "$"


def not_ignored(path, globs: list[str]) -> Column:
    """F2 as one predicate: the path matches none of the ignore globs (files and dirs)."""
    cond = F.lit(True)
    for g in globs:
        rx = glob_to_regex(g)
        cond = cond & ~_c(path).rlike(rx)
    return cond


def file_type(path) -> Column:
    """'code', 'python', 'data' or 'env' by extension; null for anything else."""
    p = _c(path)
    ext = F.lower(F.regexp_extract(p, r"(\.[^./]+)$", 1))
    return (F.when(ext.isin(CODE_EXTS), "code")
             .when(ext.isin(PYTHON_EXTS), "python")
             .when(ext.isin(DATA_EXTS), "data")
             .when(p.endswith(".env.example"), "env"))


def minified(path, n_chars, n_lines) -> Column:
    """'.min.' in the path, or more than 50,000 characters on fewer than 5 lines."""
    return _c(path).contains(".min.") | ((_c(n_chars) > 50_000) & (_c(n_lines) < 5))


def accept_hit(model_id, confidence) -> Column:
    """a confident (>= 0.8) hit accepts any id; a weaker one needs F5."""
    return (_c(confidence) >= ACCEPT_ANY_ID_CONFIDENCE) | looks_like_model_id(model_id)


# ----------------------------------------------------------------------------- corpus

def open_fs(path: str):
    """(file system, path in it) of a plain path or a URI, on an executor."""
    import pyarrow.fs as pafs
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path)


#: Entries of a directory, or files, that leave a task at once; bytes of files dealt to a task, and
#: of contents after which they leave it.
LISTED, READ_BYTES, SENT_BYTES = 4096, 64 << 20, 4 << 20


def _in_folder(path: str, known: dict):
    """(file system, path in it) of a file. Its folder is opened once in a task, its name is taken
    as it is; ``known``: the folders opened, kept few."""
    folder, _, name = path.rpartition("/")
    if folder not in known:
        if len(known) >= LISTED:
            known.clear()
        known[folder] = open_fs(folder)
    fs, base = known[folder]
    return fs, f"{base}/{name}"


def _is_local(fs) -> bool:
    import pyarrow.fs as pafs
    return isinstance(fs, pafs.LocalFileSystem)


def write_files(root: str):
    """mapInPandas: (path, content) written below ``root``; yields the paths."""
    def write(batches):
        import os
        known, made = {}, {}
        for pdf in batches:
            pdf = pdf[pdf["path"].notna()]
            for path, content in zip(pdf["path"], pdf["content"]):
                fs, place = _in_folder(f"{root}/{path}", known)
                folder = place.rpartition("/")[0]
                if folder not in made:
                    if len(made) >= LISTED:
                        made.clear()
                    made[folder] = fs.create_dir(folder, recursive=True)
                if _is_local(fs):
                    # Bare calls: a stream costs more than a small file itself.
                    with open(os.open(place, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o666), "wb", 0) as out:
                        data = memoryview(content.encode())
                        while data:
                            data = data[out.write(data):]
                else:
                    with fs.open_output_stream(place) as out:
                        out.write(content.encode())
            yield pdf[["path"]]
    return write


def remove_files(written: DataFrame, root: str) -> None:
    """Remove the files ``written`` (path) below ``root`` in tasks; their folders stay. A file
    that is gone already is no error, so a task may run twice."""
    def gone(batches):
        import os
        known = {}
        for pdf in batches:
            for path in pdf["path"]:
                fs, place = _in_folder(f"{root}/{path}", known)
                try:
                    os.unlink(place) if _is_local(fs) else fs.delete_file(place)
                except FileNotFoundError:
                    pass
            yield pdf.head(0)

    written.select("path").mapInPandas(gone, "path string").count()


def _entries(directory: str):
    """(name, is a directory, size) of a directory's entries, one by one on a local disk."""
    import os

    import pyarrow.fs as pafs
    fs, base = open_fs(directory)
    if isinstance(fs, pafs.LocalFileSystem):
        if os.path.isdir(base):
            with os.scandir(base) as found:
                for e in found:
                    if e.is_dir() or e.is_file():
                        yield e.name, e.is_dir(), 0 if e.is_dir() else e.stat().st_size
        return
    for e in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)):
        yield e.base_name, e.type == pafs.FileType.Directory, e.size or 0


def _list_dirs(batches):
    """mapInPandas: the entries of each directory (any name: Spark's own listing hides names
    that begin with ``.`` or ``_``), in bounded batches however many there are."""
    import pandas as pd
    columns = ["abs", "path", "name", "is_dir", "size"]
    for pdf in batches:
        rows = []
        for d, rel in zip(pdf["dir"], pdf["rel"]):
            for name, is_dir, size in _entries(d):
                rows.append((d.rstrip("/") + "/" + name, (rel + "/" if rel else "") + name, name, is_dir, size))
                if len(rows) == LISTED:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
        yield pd.DataFrame(rows, columns=columns)


def _read_files(batches):
    """mapInPandas: the contents of each file; bytes that are not UTF-8 become replacement
    characters. Files leave together, however small, but no more than fit in little memory."""
    import pandas as pd
    known, paths, contents, held = {}, [], [], 0
    for pdf in batches:
        for a, path in zip(pdf["abs"], pdf["path"]):
            fs, place = _in_folder(a, known)
            with open(place, "rb", 0) if _is_local(fs) else fs.open_input_stream(place) as fh:
                content = fh.read()
            paths.append(path)
            contents.append(content.decode("utf-8", "replace"))
            held += len(content)
            if held >= SENT_BYTES or len(paths) == LISTED:
                yield pd.DataFrame({"path": paths, "content": contents})
                paths, contents, held = [], [], 0
    if paths:
        yield pd.DataFrame({"path": paths, "content": contents})


def list_corpus(spark: SparkSession, project: str, roots: list[str], ignore: list[str] | None = None) -> DataFrame:
    """The files to read below ``roots`` (paths inside ``project``; "" is all of it): abs, path
    (relative to the project, so it is unique), size.

    The tree is listed level by level on the executors; skipped directories (F1, F2) are not
    entered, and other files than F3's are left out before anything is read. A file below
    several roots comes once, whatever their order."""
    from driftgate.session import stored
    project = project.rstrip("/")
    roots = [r.strip("/").removeprefix("./").strip(".") if r.strip("/") in ("", ".") else r.strip("/").removeprefix("./") for r in roots]
    level = spark.createDataFrame([(f"{project}/{r}".rstrip("/"), r) for r in dict.fromkeys(roots)], "dir string, rel string")
    kept = F.lit(True) if not ignore else not_ignored("path", ignore)
    skipped = F.col("name").startswith(".") | F.col("name").isin(list(SKIP_DIR_NAMES))
    found, slots, dirs = None, spark.sparkContext.defaultParallelism, len(set(roots))
    while True:
        # Dealt evenly: by a key, folders whose rows are few bytes would meet in one task.
        entries = level.repartition(min(dirs, slots)).mapInPandas(_list_dirs, "abs string, path string, name string, is_dir boolean, size long")
        entries = entries.filter(kept & F.when(F.col("is_dir"), ~skipped).otherwise(file_type("path").isNotNull()))
        seen = Observation()  # counted as they are stored
        entries = stored(entries.observe(seen, F.count_if("is_dir").alias("dirs")), "listing")
        files = entries.filter(~F.col("is_dir")).select("abs", "path", "size")
        found = files if found is None else found.unionByName(files)
        level = entries.filter("is_dir").select(F.col("abs").alias("dir"), F.col("path").alias("rel"))
        dirs = seen.get["dirs"]
        if not dirs:
            return found if len(set(roots)) == 1 else found.dropDuplicates(["path"])


def read_corpora(spark: SparkSession, project: str, roots: list[str], scope: str, ignore: list[str] | None = None) -> DataFrame:
    """The files below ``roots`` of a project as (scope, path, content), minified ones
    (F4) left out, whatever their type."""
    from driftgate.session import stored
    files = list_corpus(spark, project, roots, ignore)
    if len(roots) > 1:  # else the stored listing itself
        files = stored(files, "files")
    # As many tasks as the bytes ask for; a file counts for 4 KB at least.
    size, n = files.agg(F.sum(F.col("size") + 4096), F.count(F.lit(1))).first()
    tasks = math.ceil((size or 0) / READ_BYTES) or 1
    tasks = max(tasks, min(files.sparkSession.sparkContext.defaultParallelism, n or 1))
    files = files.select("abs", "path").repartition(tasks, "path")
    out = files.mapInPandas(_read_files, "path string, content string")
    n_lines = F.size(F.split(F.col("content"), "\n", -1))
    return out.filter(~minified("path", F.length("content"), n_lines)).select(F.lit(scope).alias("scope"), "path", "content")


def read_corpus(spark: SparkSession, root: str, scope: str, ignore: list[str] | None = None) -> DataFrame:
    """S11 for a whole project."""
    return read_corpora(spark, root, [""], scope, ignore)


def to_lines(files: DataFrame) -> DataFrame:
    """D1 (+F4): contents -> numbered lines, minified files dropped."""
    n_lines = F.size(F.split(F.col("content"), "\n", -1))
    kept = files.filter(~minified(F.col("path"), F.length("content"), n_lines))
    return (kept.select("scope", "path", F.posexplode(F.split(F.col("content"), "\r?\n", -1)).alias("pos", "text"))
                .select("scope", "path", (F.col("pos") + 1).cast("int").alias("line"), "text"))


# ----------------------------------------------------------------------------- scanners

def _hit(provider, model_id, line, column, snip, conf, kind: str, ord_) -> Column:
    conf = conf if isinstance(conf, Column) else F.lit(conf)
    return F.struct(provider.alias("provider"), model_id.alias("model_id"), line.alias("line"),
                    column.alias("column"), snip.alias("snippet"), conf.cast("double").alias("confidence"),
                    F.lit(kind).alias("kind"), F.lit(ord_).alias("hit_ord"))


def _emit(df: DataFrame, hits: Column) -> DataFrame:
    return (df.select("scope", "path", F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h"))
              .select("scope", "h.provider", "h.model_id", "path", "h.line", "h.column", "h.snippet",
                      "h.confidence", "h.kind", "h.hit_ord"))


def python_hints(text) -> Column:
    """D3 (one line): provider hinted by an import; later tests win (xai > google >
    anthropic > openai)."""
    t = _c(text)
    out = F.lit(None).cast("string")
    for provider, rx in PYTHON_PROVIDER_HINTS:
        out = F.when(t.rlike(rx), F.lit(provider)).otherwise(out)
    return out


def scan_python(lines: DataFrame) -> DataFrame:
    """D2 + D3 (W1): five patterns per line, first match each; the provider is the last
    import hint at or above the line, else inferred from the id. 0.9 on SDK call lines."""
    d = lines.withColumn("hint", python_hints("text"))
    # Only import lines and lines that can hit matter; the others are never shuffled.
    d = d.filter(F.col("hint").isNotNull() | F.col("text").contains("model"))
    d = segmented_last_non_null(d, ["scope", "path"], "line", "hint", "carried")
    d = d.filter(F.col("text").contains("model"))
    t = F.col("text")
    conf = F.when(t.rlike(r"messages\.create|chat\.completions"), 0.9).otherwise(0.7)
    hits = []
    for i, rx in enumerate(PYTHON_MODEL_PATTERNS):
        mid = F.regexp_extract(t, rx, 1)
        prov = F.coalesce(F.col("carried"), infer_provider(mid))
        hits.append(F.when((mid != "") & looks_like_model_id(mid),
                           _hit(prov, mid, F.col("line"), F.lit(None).cast("int"), snippet(t), conf, "sdk", i)))
    return _emit(d, F.array(*hits))


ENV_LINE = r"^\s*([A-Z0-9_]+)\s*=\s*(.*)$"


def scan_env(lines: DataFrame) -> DataFrame:
    """KEY=value in .env.example files; key must name a model for a provider."""
    spark = lines.sparkSession
    keys = spark.createDataFrame(ENV_MODEL_KEYS, "env_key string, env_provider string")
    d = lines.filter(F.col("text").contains("="))
    key = F.regexp_extract("text", ENV_LINE, 1)
    raw = js_trim(F.regexp_extract("text", ENV_LINE, 2))
    value = F.regexp_replace(raw, r"^[\"']|[\"']$", "")
    d = d.select("scope", "path", "line", key.alias("env_key"), value.alias("value")).filter(F.col("env_key") != "")
    d = d.join(F.broadcast(keys), "env_key").filter(looks_like_model_id("value"))
    return d.select("scope", F.col("env_provider").alias("provider"), F.col("value").alias("model_id"), "path",
                    "line", F.lit(None).cast("int").alias("column"),
                    F.concat("env_key", F.lit("="), "value").alias("snippet"),
                    F.lit(0.85).alias("confidence"), F.lit("env").alias("kind"), F.lit(0).alias("hit_ord"))


JSON_KEY = r'"((?i:model|model_id|modelid))"\s*:\s*"([^"\\]*)"'
CONFIG_KEYS = ("model", "model_id", "modelid")


def scan_json(docs: DataFrame) -> DataFrame:
    """D7 (JSON): keys named model/model_id/modelId (any case) at any depth with a
    string value passing F5; only documents that parse. Line is always 1."""
    d = docs.filter(F.col("content").contains('"') & json_ok("content"))
    pairs = F.regexp_extract_all("content", F.lit(JSON_KEY), 0)
    d = d.select("scope", "path", F.posexplode(pairs).alias("k", "m"))
    key = F.regexp_extract("m", JSON_KEY, 1)
    val = F.regexp_extract("m", JSON_KEY, 2)
    d = d.select("scope", "path", "k", key.alias("key"), val.alias("model_id")).filter(looks_like_model_id("model_id"))
    return d.select("scope", infer_provider("model_id").alias("provider"), "model_id", "path",
                    F.lit(1).alias("line"), F.lit(None).cast("int").alias("column"),
                    F.concat("key", F.lit(": "), "model_id").alias("snippet"), F.lit(0.75).alias("confidence"),
                    F.lit("config").alias("kind"), F.col("k").cast("int").alias("hit_ord"))


def _yaml_hits(batches):
    """mapInPandas over (scope, path, content): the entries named as a model, of valid files."""
    import pandas as pd
    for pdf in batches:
        rows = []
        for scope, path, text in zip(pdf["scope"], pdf["path"], pdf["content"]):
            found = yaml_strings(text) or []
            rows += [(scope, path, key, value, k) for k, (key, value) in enumerate(found) if key.lower() in CONFIG_KEYS]
        yield pd.DataFrame(rows, columns=["scope", "path", "key", "model_id", "hit_ord"])


def scan_yaml(docs: DataFrame) -> DataFrame:
    """D7 (YAML): keys named model/model_id/modelId (any case) at any depth, in block or flow
    mappings, with a string value passing F5; only files that are one valid document (read with
    an indentation stack, ``functions.scanners``). Line is always 1."""
    d = docs.filter(F.lower("content").contains("model")).select("scope", "path", "content")
    d = d.mapInPandas(_yaml_hits, "scope string, path string, key string, model_id string, hit_ord int").filter(looks_like_model_id("model_id"))
    return d.select("scope", infer_provider("model_id").alias("provider"), "model_id", "path",
                    F.lit(1).alias("line"), F.lit(None).cast("int").alias("column"),
                    F.concat("key", F.lit(": "), "model_id").alias("snippet"), F.lit(0.75).alias("confidence"),
                    F.lit("config").alias("kind"), "hit_ord")


def files_of(lines: DataFrame, some: Column) -> DataFrame:
    """Lines put together again as (scope, path, base, content): one row for each file that has
    a line for which ``some`` holds. A file is the unit that was read, so it fits a row; base is
    its first line's number."""
    one = F.array_sort(F.collect_list(F.struct("line", "text")))
    files = lines.groupBy("scope", "path").agg(one.alias("l"), F.max(some).alias("some")).filter("some")
    return files.select("scope", "path", F.get("l", F.lit(0))["line"].alias("base"), F.array_join("l.text", "\n").alias("content"))


JS_CALL_KEYS = ("model", "modelId", "model_id")


def _js_hits(batches):
    """mapInPandas over (scope, path, base, content): one row for each property that names a
    model as an argument of a call ('sdk') and for each whose key has 'model' in it ('literal').
    The provider is that of the last import of the call's root name above it."""
    import bisect

    import pandas as pd
    packages = dict(PROVIDER_PACKAGES)
    for pdf in batches:
        rows = []
        for scope, path, base, text in zip(pdf["scope"], pdf["path"], pdf["base"], pdf["content"]):
            ends = [i for i, c in enumerate(text) if c == "\n"]
            line = lambda at, ends=ends: bisect.bisect_left(ends, at)
            known = [(line(at), name, packages[package]) for at, package, name in js_imports(text) if package in packages]
            for k, (key, value, at, callee) in enumerate(js_properties(text)):
                column = at - (ends[line(at) - 1] + 1 if line(at) else 0)
                if callee is not None and key in JS_CALL_KEYS:
                    above = [p for n, name, p in known if name == callee[1] and n <= line(callee[0])]
                    rows.append((scope, path, int(base) + line(at), column, key, value, "sdk", above[-1] if above else None, 2 * k))
                if "model" in key.lower():
                    rows.append((scope, path, int(base) + line(at), column, key, value, "literal", None, 2 * k + 1))
        yield pd.DataFrame(rows, columns=["scope", "path", "line", "column", "key", "model_id", "kind", "imported", "hit_ord"])


def scan_js(lines: DataFrame) -> DataFrame:
    """Call-site model keys (0.9, 'sdk'; provider from an imported SDK name when the
    callee is a member of one, else inferred) and property literals whose key contains
    'model' (0.55, 'literal', F5 required). Files are read token by token with a stack
    (``functions.scanners``), so objects may nest to any depth and spread over lines, and text
    in comments, strings and patterns counts for nothing."""
    files = files_of(lines, F.lower("text").contains("model"))
    d = files.mapInPandas(_js_hits, "scope string, path string, line int, column int, key string, model_id string, kind string, "
                                    "imported string, hit_ord int")
    sdk = F.col("kind") == "sdk"
    d = d.filter(F.when(sdk, accept_hit("model_id", F.lit(0.9))).otherwise(looks_like_model_id("model_id")))
    return d.select("scope", F.coalesce("imported", infer_provider("model_id")).alias("provider"), "model_id", "path", "line", "column",
                    F.concat(F.when(sdk, "model").otherwise(F.col("key")), F.lit(': "'), "model_id", F.lit('"')).alias("snippet"),
                    F.when(sdk, 0.9).otherwise(0.55).alias("confidence"), "kind", "hit_ord")


def scan_lines(lines: DataFrame) -> DataFrame:
    """Route each line by file type (F3) and union every scanner's hits."""
    t = file_type("path")
    typed = lines.withColumn("_type", t)
    py = scan_python(typed.filter(F.col("_type") == "python").drop("_type"))
    js = scan_js(typed.filter(F.col("_type") == "code").drop("_type"))
    env = scan_env(typed.filter(F.col("_type") == "env").drop("_type"))
    yml = typed.filter((F.col("_type") == "data") & ~F.lower("path").endswith(".json")).drop("_type")
    yml = scan_yaml(files_of(yml, F.lower("text").contains("model")))
    return py.unionByName(js).unionByName(env).unionByName(yml)


def scan_docs(docs: DataFrame) -> DataFrame:
    """D7 over whole documents: JSON by name, YAML else."""
    is_json = F.lower("path").endswith(".json")
    return scan_json(docs.filter(is_json)).unionByName(scan_yaml(docs.filter(~is_json)))


def discover(lines: DataFrame, docs: DataFrame) -> DataFrame:
    """D10 + D9: all hits of lines and of config documents, consolidated into dependencies."""
    return consolidate(scan_lines(lines).unionByName(scan_docs(docs)))


def discover_files(files: DataFrame) -> DataFrame:
    """D10 + D9 for a corpus (scope, path, content): config files as documents, all others as lines."""
    whole = F.coalesce(file_type("path") == "data", F.lit(False))
    return discover(to_lines(files.filter(~whole)), files.filter(whole))


def consolidate(hits: DataFrame) -> DataFrame:
    """D9 (+W2): per (scope, provider, model_id): max confidence, low flag (< 0.6),
    identifier kind, occurrence count and the first occurrence (path, line, emission
    order). Partial aggregates only, so a hot dependency is combined map-side."""
    occ = F.struct("path", "line", F.coalesce("column", F.lit(-1)).alias("col"), "hit_ord", "confidence",
                   "kind", "snippet")
    g = (hits.groupBy("scope", "provider", "model_id")
             .agg(F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("n_occurrences"),
                  F.min(occ).alias("first")))
    return g.select(
        "scope", model_key("provider", "model_id").alias("entity_key"), "provider", "model_id",
        identifier_kind(F.col("model_id")).alias("identifier_kind"), "confidence",
        (F.col("confidence") < LOW_CONFIDENCE_THRESHOLD).alias("low_confidence"), "n_occurrences",
        F.col("first.path").alias("path"), F.col("first.line").alias("line"), F.col("first.kind").alias("first_kind"))


def low_confidence(deps: DataFrame) -> DataFrame:
    """F8: dependencies whose best hit is below 0.6."""
    return deps.filter(F.col("low_confidence"))


def inventory(deps: DataFrame) -> DataFrame:
    """Key, kind, confidence to 2 places, low flag, first location."""
    return deps.select("scope", F.col("entity_key").alias("key"), "identifier_kind",
                       F.format_string("%.2f", F.col("confidence")).alias("conf"), "low_confidence",
                       F.concat("path", F.lit(":"), F.col("line").cast("string")).alias("location"))
