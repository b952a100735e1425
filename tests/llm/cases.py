"""Small document tables with the awkward cases every operator must take."""

from __future__ import annotations

import random
import re

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, row string, id string, bin int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def texts(seed: int = 1) -> list[str | None]:
    rng = random.Random(seed)
    base = sentence(rng, 300)
    passage = sentence(rng, 120)
    near = base.split()
    near[150] = "CHANGED"
    out = [None, "", " ", "\n", "\n\n", "word", "two words", "a b c d", base, base, base.upper(), " ".join(near),
           sentence(rng, 200) + "\n" + passage, passage + " " + sentence(rng, 90), "é" * 500, "x" + "é" * 500, "aaaa " * 400,
           sentence(rng, 4000), "% # * " * 200, "same line\n" * 30, "Café Ünïcode 日本 🎉 " * 30]
    for k in range(14):  # a line that many share, and single lines
        out.append(f"  Shared LINE \n{sentence(rng, 60)}\nonly {k}\r\nshared line\n" + passage[: 100 + 40 * k])
    for k in range(6):  # near copies that drift away from the first
        near = base.split()
        for at in range(0, 10 * k, 5):
            near[at] = f"d{k}{at}"
        out.append(" ".join(near))
    return out


def documents(spark: SparkSession, more: list[str | None] = ()) -> DataFrame:
    """The cases, with a repeated row, nulls in every column and columns whose names the
    operators use themselves."""
    rows = [(i, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else f"s{i % 2}", None, i % 2 == 0, "r", f"i{i}", i)
            for i, t in enumerate([*texts(), *more])]
    rows.append(rows[8])
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def words(text: str | None, lower: bool = False) -> list[str]:
    return WORD.findall((text or "").translate(LOWER) if lower else (text or ""))
