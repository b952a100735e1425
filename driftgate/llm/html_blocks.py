"""Main text of web pages by line-block distribution.

Markup is stripped block by block: each block element is a line, character references are
decoded and white space is collapsed. Elements that are never main text (menus, footers, forms,
scripts, hidden ones) are dropped; a container that only its class, id or role names so is
dropped, too, unless it holds most of the page's text. What is left is judged by its
distribution over the lines:

* A line weighs its characters outside links; one that is mostly links weighs nothing.
* The page's own threshold parts long lines from short ones: the split of the lines' weights,
  on a logarithmic scale, with the greatest variance between its sides (none, if the sides lie
  closer than a factor of four).
* Lines of prose elements (paragraphs, headings, quotations) weigh the threshold at least. If
  these hold the page's text, other lines are text between them only.
* Sums over sliding windows of lines give the distribution. Text begins at a surge, where the
  sum reaches the threshold, and ends at a dive, where it falls below; a stretch is trimmed to
  its first and last real line (of prose, or reaching the threshold itself), with the list that
  follows in the same container. A stretch that is mostly links, or headings without text,
  goes; all others are kept, and every line between surge and dive is kept whole.

On a page that marks its articles, everything left inside them is main text.
"""

from __future__ import annotations

import html as references
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgate.llm.common import ship

ship(__name__)

#: Lines in a window.
WINDOW = 3
#: A stretch is kept if more than this share of its characters is outside links.
DENSE = 0.5
#: A page whose prose elements hold this share of its text keeps its text there.
IN_PROSE = 0.4
#: Long and short lines differ by this factor at least (as a power of two).
APART = 2
#: A line is mostly links from this share of its characters.
LINKS = 0.6

# Elements that begin a block; that are dropped with their contents; whose
# contents are raw text; that have no contents.
BLOCK = set("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table
tbody td tfoot th thead title tr ul""".split())
DROPPED = set("""head nav footer aside form button select option textarea input iframe object embed dialog menu noscript
template svg math canvas audio video script style title""".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is prose, however short.
PROSE = set("p h1 h2 h3 h4 h5 h6 blockquote pre dd figcaption caption summary".split())
#: Names in a class, id or role that mark a container as no main text.
NOISE = set("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies
consent notice notices notification alert popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar
side aside complementary widget footer contentinfo header masthead topbar toolbar comment comments replies reply
discussion disqus share sharing social related recommended newsletter subscribe subscription signup login search
pagination pager tags toc form copyright legal disclaimer skip gdpr paywall responses response feedback remarks
guestbook reactions trackbacks""".split())
#: Names that say nothing of what they hold: the name before them counts.
GENERIC = set("""area bar block body box btn button buttons container content count group heading holder icon inner item items
label left link links list log main module outer panel posts right row section text this thread title top tree wrap wrapper
bottom entries entry area col column id""".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_UNENDED = re.compile(r"<[!/?a-zA-Z][^<>]*$", re.S)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_SPLIT = re.compile(r"[\s_-]+|(?<=[a-z])(?=[A-Z])")


def _named(value: str) -> set[str]:
    """What the words of a class, id or role name: of each, the last part that says something
    (``tags-intro`` is an intro, a ``comment-list`` holds comments)."""
    out = set()
    for word in value.split():
        parts = [p.lower() for p in _SPLIT.split(word) if p and not any(c.isdigit() for c in p)]
        while len(parts) > 1 and parts[-1] in GENERIC:
            parts.pop()
        out |= set(parts[-1:])
    return out


def _noise(name: str, attributes: str, in_article: bool) -> bool:
    """Whether an element is dropped."""
    if name in DROPPED or (name == "header" and not in_article):
        return True
    if not attributes or name in ("body", "html", "article", "main", "h1") and "comment" not in attributes:
        return False
    for key, value in _ATTRIBUTE.findall(attributes):
        key = key.lower()
        if key == "hidden" or key == "aria-hidden" and value.strip("\"'") == "true":
            return True
        if key in ("class", "id", "role"):
            names = _named(value.strip("\"'")) & NOISE
            if names - ({"header", "masthead", "title"} if in_article else set()):
                return True
        if key == "style" and _HIDDEN.search(value):
            return True
    return False


def _firm(name: str, attributes: str, in_article: bool) -> bool:
    """Whether a dropped element is dropped whatever it holds: by element (but forms) or hidden."""
    if name in DROPPED - {"form"} or (name == "header" and not in_article):
        return True
    return any(key == "hidden" or key == "aria-hidden" and value.strip("\"'") == "true" or key == "style" and _HIDDEN.search(value)
               for key, value in ((k.lower(), v) for k, v in _ATTRIBUTE.findall(attributes)))


def lines_of(page: str, kept: frozenset[int] = frozenset()) -> list[tuple[str, int, bool, str, int]]:
    """(text, characters in links, inside an article, element, its container's place) of each block. ``kept``: where the
    containers begin that are kept although their names mark them as no main text."""
    out: list[tuple[str, int, bool, str, int]] = []
    kind = "div"  # the block element that the text stands in
    words: list[str] = []
    linked = article = skip = links = 0
    total = held = firm = 0  # characters of the page, of them outside firmly dropped elements
    open_: list[tuple[str, bool, bool, bool, int, int]] = []  # element, dropped, article, firmly dropped, begin, held there
    named: list[tuple[int, int]] = []  # begin and held characters of the others that are dropped

    def flush():
        nonlocal linked
        text = " ".join(references.unescape("".join(words)).split())
        if text:
            out.append((text, linked, article > 0, kind, next((o[4] for o in reversed(open_) if o[0] not in ("ul", "ol", "li", "dl")), -1)))
        words.clear()
        linked = 0

    def close(depth: int):
        nonlocal skip, article, firm
        for _, dropped, is_article, firmly, begin, before in open_[depth:]:
            skip -= dropped
            article -= is_article
            firm -= firmly
            if dropped and not firmly:
                named.append((begin, held - before))
        del open_[depth:]

    def take(text: str):
        nonlocal linked, total, held
        chars = len(text.strip())
        total += chars
        held += 0 if firm else chars
        if text and not skip:
            words.append(text)
            if links:
                linked += len(text.strip())

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            rest = page[at:]
            cut = _UNENDED.search(rest)  # a tag that the end of the page cuts off
            take(rest[:cut.start()] if cut else rest)
            break
        take(page[at:m.start()])
        at = m.end()
        name = (m.group(2) or "").lower()
        if not name:
            continue
        if m.group(1):  # an end tag closes the innermost element of its name, and what is open in it
            depth = next((k for k in range(len(open_) - 1, -1, -1) if open_[k][0] == name), None)
            if name in BLOCK:
                flush()
                kind = "div"
            if name == "a":
                links = max(0, links - 1)
            if depth is not None:
                close(depth)
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if name == "br":
            take(" ")
            continue
        if name in BLOCK:
            flush()
            kind = name
            if open_ and open_[-1][0] == "p":  # a block ends an open paragraph
                close(len(open_) - 1)
        if name in VOID:
            continue
        if name == "a":
            links += 1
        elif name in BLOCK or name in DROPPED or "class" in m.group(3) or "id" in m.group(3) or "hidden" in m.group(3) or "style" in m.group(3):
            dropped = m.start() not in kept and _noise(name, m.group(3), article > 0)
            firmly = dropped and _firm(name, m.group(3), article > 0)
            if name in ("p", "li", "td", "tr", "dt", "dd") and not dropped:
                continue  # their end tags may be missing; nothing depends on them
            is_article = name in ("article", "main") and not dropped and not skip
            skip += dropped
            article += is_article
            firm += firmly
            open_.append((name, dropped, is_article, firmly, m.start(), held))
    flush()
    close(0)
    most = frozenset(begin for begin, chars in named if 2 * chars > total) - kept
    return lines_of(page, kept | most) if most and not kept else out


def threshold(weights: list[int]) -> float:
    """The weight from which a line is long, by the split of all weights above 0 that has the
    greatest variance between its sides on a logarithmic scale; 0 if they lie close together."""
    logs = sorted(math.log2(w) for w in weights if w > 0)
    best, at, total, left = 0.0, 0, sum(logs), 0.0
    for i in range(1, len(logs)):
        left += logs[i - 1]
        gap = (total - left) / (len(logs) - i) - left / i
        if gap >= APART and i * (len(logs) - i) * gap * gap > best:
            best, at = i * (len(logs) - i) * gap * gap, i
    return 2 ** ((logs[at - 1] + logs[at]) / 2) if at else 0.0


def main_text(page: str | None) -> str:
    """The lines between surges and dives, joined by newlines."""
    lines = lines_of(page or "")
    if any(inside for _, _, inside, _, _ in lines):
        return "\n".join(text for text, _, inside, _, _ in lines if inside)
    weight = [0 if linked >= LINKS * len(text) else len(text) for text, linked, _, _, _ in lines]
    if not any(weight):  # nothing but links: what stands in prose is text all the same
        weight = [len(text) if kind in PROSE else 0 for text, _, _, kind, _ in lines]
    long = threshold(weight)
    prose = [w > 0 and kind in PROSE for w, (_, _, _, kind, _) in zip(weight, lines)]
    # Where prose elements hold the text, what stands outside them counts between them only.
    inside = sum(w for w, p in zip(weight, prose) if p) >= IN_PROSE * sum(weight) > 0
    real = [p or (w > 0 and w >= long and not inside) for w, p in zip(weight, prose)]
    mass = [max(w, long) if p else w for w, p in zip(weight, prose)]
    sums = [sum(mass[i:i + WINDOW]) for i in range(len(mass))]
    stretches, start = [], None
    for i, s in enumerate(sums + [0]):
        surging = s > 0 and s >= long
        if start is None and surging:
            start = i
        elif start is not None and not surging:
            stretches.append((start, i))
            start = None
    kept = []
    for a, b in stretches:
        solid = [i for i in range(a, min(b + WINDOW - 1, len(lines))) if real[i] and (i < b or not sums[i] >= long)]
        solid = [i for i in solid if i < b] or solid
        if not solid:
            continue
        first, last = solid[0], solid[-1]
        while last + 1 < len(lines) and lines[last + 1][3] == "li" and weight[last + 1] and lines[last + 1][4] == lines[last][4]:
            last += 1
        own = lines[first:last + 1]
        if all(kind in ("h2", "h3", "h4", "h5", "h6") for _, _, _, kind, _ in own) and len(stretches) > 1:
            continue
        if sum(weight[first:last + 1]) and (sum(linked for _, linked, _, _, _ in own) < (1 - DENSE) * sum(len(text) for text, _, _, _, _ in own)
                                            or not any(linked < LINKS * len(text) for text, linked, _, _, _ in lines)):
            kept += [text for text, _, _, _, _ in own]
    return "\n".join(kept)


def _extract(batches):
    for b in batches:
        texts = [main_text(x) for x in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["row", "text"])


def extract_pages(pages: DataFrame, html: str = "html", carry: list[str] | None = None) -> DataFrame:
    """``row`` (struct of the ``carry`` columns, default all but the html) and ``text``: the
    main text of every whole page, empty if there is none.

    A null or empty page has an empty text. Pages may be cut off anywhere. Repeated rows give
    equal texts; an empty table gives no rows.
    """
    carry = [c for c in pages.columns if c != html] if carry is None else carry
    base = pages.select(F.struct(*[F.col(c) for c in carry]).alias("row"), F.col(html).alias("html"))
    return base.mapInArrow(_extract, f"row {base.schema['row'].dataType.simpleString()}, text string")
