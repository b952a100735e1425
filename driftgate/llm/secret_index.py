"""Secret scan with a trigram inverted index.

Each rule is a regular expression. A Boolean query over trigrams that every match must hold
is derived from its parse tree: literals give the trigrams of the strings they can spell
(letters folded, as a rule may match in either case), a sequence is an AND, alternatives an
OR, and what cannot be enumerated is ANY. A segment (some megabytes of a task's documents)
gets an inverted index of the trigrams the rules ask for: sorted postings of its documents.
A rule's query is answered by intersecting and uniting postings; only the documents it leaves
are decoded and matched. A rule whose query is ANY has no mandatory trigrams: it scans all.

The index lives as long as its segment, so no text and no posting is shuffled; a task holds
one segment and one document at a time.
"""

from __future__ import annotations

import hashlib
import re
import re._constants as C
import re._parser as parser
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgate.llm.common import ship, spans, utf8
from driftgate.llm.tokens import FOLD

ship(__name__)

#: Bytes of a segment, and strings kept while a query is derived (beyond: ANY).
SEGMENT_BYTES, MAX_STRINGS = 1 << 22, 64


@dataclass(frozen=True)
class Rule:
    """Leftmost, non-overlapping matches of ``pattern`` (ASCII classes); a match counts if its
    ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: Fixed patterns: the three base kinds, then common token shapes.
BASE = [
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
]
MORE = [
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("repo_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("sk_key", r"sk-[A-Za-z0-9_-]{20,}"),
    Rule("url_login", r"://[A-Za-z0-9._~-]+:[A-Za-z0-9._~!$&*+=-]+@"),
]
RULES = BASE + MORE

# ---------------------------------------------------------------------------- queries
#: A query: ANY, ("tri", trigram), ("and", frozenset), ("or", frozenset).
ANY = ("any",)


def _join(op: str, parts) -> tuple:
    flat = set()
    for p in parts:
        if p == ANY:
            if op == "or":
                return ANY
        elif p[0] == op:
            flat |= p[1]
        else:
            flat.add(p)
    if not flat:
        return ANY
    return next(iter(flat)) if len(flat) == 1 else (op, frozenset(flat))


def _of_string(s: bytes) -> tuple:
    return _join("and", [("tri", s[i:i + 3]) for i in range(len(s) - 2)])


def _of_strings(strings: set[bytes]) -> tuple:
    return _join("or", [_of_string(s) for s in strings]) if strings else ANY


@dataclass
class _Info:
    """What a part of a pattern matches: exactly these strings (or None: too many), and if
    not, strings one of which each match begins and ends with, and a query that it fulfils."""

    exact: set[bytes] | None
    heads: set[bytes]
    tails: set[bytes]
    query: tuple


def _unknown(query: tuple = ANY) -> _Info:
    return _Info(None, {b""}, {b""}, query)


def _known(strings: set[bytes]) -> _Info:
    if len(strings) > MAX_STRINGS:
        return _unknown(_of_strings(strings))
    return _Info(strings, strings, strings, ANY)


def _short(strings: set[bytes], head: bool) -> set[bytes]:
    """Two characters at the edge are enough to join with a neighbour."""
    cut = {(s[:2] if head else s[-2:]) for s in strings}
    return cut if len(cut) <= MAX_STRINGS else {b""}


def _inexact(i: _Info) -> _Info:
    if i.exact is None:
        return i
    return _Info(None, _short(i.exact, True), _short(i.exact, False), _of_strings(i.exact))


def _follow(a: _Info, b: _Info) -> _Info:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= MAX_STRINGS:
        return _known({x + y for x in a.exact for y in b.exact})
    seam = {x + y for x in (a.exact if a.exact is not None else a.tails) for y in (b.exact if b.exact is not None else b.heads)}
    middle = _of_strings(seam) if len(seam) <= MAX_STRINGS else ANY
    heads = {x + y for x in a.exact for y in b.heads} if a.exact is not None else a.heads
    tails = {x + y for x in a.tails for y in b.exact} if b.exact is not None else b.tails
    qa, qb = _inexact(a).query, _inexact(b).query
    return _Info(None, _short(heads, True), _short(tails, False), _join("and", [qa, qb, middle]))


def _either(a: _Info, b: _Info) -> _Info:
    if a.exact is not None and b.exact is not None and len(a.exact | b.exact) <= MAX_STRINGS:
        return _known(a.exact | b.exact)
    a, b = _inexact(a), _inexact(b)
    return _Info(None, _short(a.heads | b.heads, True), _short(a.tails | b.tails, False), _join("or", [a.query, b.query]))


def _letters(items) -> set[bytes] | None:
    out: set[bytes] = set()
    for op, av in items:
        if op is C.LITERAL:
            codes = [av]
        elif op is C.RANGE and av[1] - av[0] < MAX_STRINGS:
            codes = range(av[0], av[1] + 1)
        else:  # a negated set, a category, a wide range
            return None
        out |= {chr(c).lower().encode() if c < 128 else chr(c).encode() for c in codes}
    return out


def _info(tree) -> _Info:
    out = _known({b""})
    for op, av in tree:
        if op is C.LITERAL:
            part = _known(_letters([(op, av)]))
        elif op is C.IN:
            found = _letters(av)
            part = _known(found) if found else _unknown()
        elif op is C.SUBPATTERN:
            part = _info(av[-1])
        elif op is C.BRANCH:
            branches = [_info(b) for b in av[1]]
            part = branches[0]
            for b in branches[1:]:
                part = _either(part, b)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            least, most, sub = av
            one = _info(sub)
            if (least, most) == (0, 1):
                part = _either(one, _known({b""}))
            elif least == 0:
                part = _unknown()
            else:
                part = one
                for _ in range(min(least, 3) - 1):
                    part = _follow(part, one)
                if most != least or least > 3:  # more may follow: the ends stay, what lies between is open
                    ends = _inexact(part)
                    part = _Info(None, ends.heads, ends.tails, ends.query)
        elif op is C.AT:
            part = _known({b""})
        else:
            part = _unknown()
        out = _follow(out, part)
    return out


def trigram_query(pattern: str) -> tuple:
    """A query that holds for every text (A-Z folded) in which ``pattern`` matches."""
    return _inexact(_info(parser.parse(pattern, re.ASCII))).query


def trigrams(query: tuple) -> set[bytes]:
    if query == ANY:
        return set()
    return {query[1]} if query[0] == "tri" else set().union(*[trigrams(q) for q in query[1]])


def code(trigram: bytes) -> int:
    return trigram[0] << 16 | trigram[1] << 8 | trigram[2]


# ---------------------------------------------------------------------------- the index
class Segment:
    """Postings of the wanted trigrams over some documents that lie one after another."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray):
        self.n = len(offsets) - 1
        self.postings: dict[int, np.ndarray] = {}
        if len(data) < 3:
            return
        low = FOLD[data].astype(np.int32)
        codes = low[:-2] << 16 | low[1:-1] << 8 | low[2:]
        at = np.flatnonzero(wanted[codes])
        doc = np.searchsorted(offsets, at, side="right") - 1
        at, doc = at[at + 3 <= offsets[doc + 1]], doc[at + 3 <= offsets[doc + 1]]
        pairs = np.unique(codes[at].astype(np.int64) * self.n + doc)
        tri, doc = pairs // self.n, pairs % self.n
        edge = np.flatnonzero(np.concatenate(([True], tri[1:] != tri[:-1]))) if len(tri) else np.zeros(0, np.int64)
        for a, b in zip(edge.tolist(), np.append(edge[1:], len(tri)).tolist()):
            self.postings[int(tri[a])] = doc[a:b]

    def answer(self, query: tuple) -> np.ndarray:
        """The documents, in order, that may hold a match."""
        if query == ANY:
            return np.arange(self.n)
        if query[0] == "tri":
            return self.postings.get(code(query[1]), np.zeros(0, np.int64))
        parts = sorted((self.answer(q) for q in query[1]), key=len)
        out = parts[0]
        for p in parts[1:]:
            if query[0] == "or":
                out = np.union1d(out, p)
            elif len(out):
                out = np.intersect1d(out, p, assume_unique=True)
        return out


def _spans_of(text: str, rule: Rule, compiled) -> list[tuple[int, int]]:
    return [m.span() for m in compiled.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def _scanner(rules: list[Rule]):
    queries = [trigram_query(r.pattern) for r in rules]

    def scan(batches):
        wanted = np.zeros(1 << 24, bool)
        for q in queries:
            wanted[[code(t) for t in trigrams(q)]] = True
        compiled = [re.compile(r.pattern, re.ASCII) for r in rules]
        for b in batches:
            data, offsets = utf8(b.column(1))
            for i, j in spans(offsets, SEGMENT_BYTES):
                own, piece = offsets[i:j + 1] - offsets[i], data[offsets[i]:offsets[j]]
                segment = Segment(piece, own, wanted)
                todo: list[list[int]] = [[] for _ in range(j - i)]
                for r, q in enumerate(queries):
                    for d in segment.answer(q).tolist():
                        todo[d].append(r)
                found = []
                for d, which in enumerate(todo):
                    text = piece[own[d]:own[d + 1]].tobytes().decode("utf-8", "replace") if which else ""
                    hits = [(s, r, e) for r in which for s, e in _spans_of(text, rules[r], compiled[r])]
                    found.append([{"kind": rules[r].kind, "start": s, "end": e} for s, r, e in sorted(hits)])
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(found, kind)], names=["row", "spans"])
    return scan


def find_secrets(docs: DataFrame, rules: list[Rule] = RULES, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per document: ``row`` (struct of the ``carry`` columns, default all but the
    text) and ``spans``, an array of (kind, start, end) in code points, end exclusive, by
    start and then by the order of the rules; rules match independently and may overlap.

    A null or empty text has no spans; repeated rows get equal results; an empty table gives
    none. Whole texts are matched, whatever their length.
    """
    carry = [c for c in docs.columns if c != text] if carry is None else carry
    base = docs.select(F.struct(*[F.col(c) for c in carry]).alias("row") if carry else F.struct(F.lit(None).alias("none")).alias("row"),
                       F.col(text).alias("text"))
    row = base.schema["row"].dataType.simpleString()
    return base.mapInArrow(_scanner(list(rules)), f"row {row}, spans array<struct<kind:string,start:long,end:long>>")


def span_list(spans, kinds: list[str] | None = None):
    """``kind:start:end`` joined by commas, of all kinds or some."""
    if kinds is not None:
        spans = F.filter(spans, lambda s: s["kind"].isin(kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, rules: list[Rule] = RULES, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span (overlapping ones as one) replaced by ``mark``; null stays null."""
    out = find_secrets(docs.select(F.struct(*docs.columns).alias("all"), F.col(text).alias("text")), rules, "text", ["all", "text"])
    # Overlapping spans are merged by a fold over the sorted list; text is put together once.
    state = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s, span):
        a, z = F.greatest(span["start"], s["at"]), span["end"]
        new = F.struct(F.greatest(z, s["at"]).alias("at"),
                       F.concat(s["out"], F.array(F.substring(F.col("row.text"), (s["at"] + 1).cast("int"), (a - s["at"]).cast("int")),
                                                  F.lit(mark))).alias("out"))
        touching = (span["start"] < s["at"]) & (F.size(s["out"]) > 0)
        return F.when(~touching, new).otherwise(F.struct(F.greatest(z, s["at"]).alias("at"), s["out"].alias("out")))

    parts = F.aggregate("spans", state, step, lambda s: F.concat(
        F.array_join(s["out"], ""), F.substring(F.col("row.text"), (s["at"] + 1).cast("int"), F.length("row.text"))))
    return out.select(*[(parts if c == text else F.col(f"row.all.`{c}`")).alias(c) for c in docs.columns])
