"""Small inputs with every odd case, and brute-force counterparts."""

from __future__ import annotations

import random
import re

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _w int, v string, key double"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def odd_documents() -> list[tuple]:
    """Nulls in every column, empty and very long texts, white space, repeated rows and ids, columns with clashing names."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base = prose(120)
    near = base.split(" ")
    near[50] = "changed"
    rows = [
        (1, base, "en", "a", len(base)),
        (2, base, "en", "a", None),
        (3, " ".join(near), "en", "b", 1),
        (4, base.upper(), "de", None, 1),
        (5, None, None, None, None),
        (6, "", "en", "a", 0),
        (7, " \t\n\x0b ", "en", "a", 5),
        (8, "one two", "fr", "c", 7),
        (9, prose(9000) + "\n" + prose(60) + "\n" + prose(4000), "en", "a", 1),
        (None, prose(80), "en", "a", 1),
        (11, "line one is long enough to count\nshort\nline one is long enough to count\n\n" + prose(40), "en", "b", 1),
        (12, "Line one, is LONG enough to count!\n" + prose(30), "en", "b", 1),
        (13, "öäü ñandú 漢字 😀 " * 30, "es", "d", 1),
        (13, "öäü ñandú 漢字 😀 " * 30, "es", "d", 1),
    ]
    rows += [(20 + i, prose(rng.randint(15, 200)), rng.choice(["en", "de"]), rng.choice(["a", "b", "c"]), 1) for i in range(60)]
    return [(*r, 1, "x", 0.5) for r in rows]


def frame(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    return spark.createDataFrame(odd_documents() if rows is None else rows, SCHEMA)


def words(text: str | None) -> list[str]:
    return WORDS.findall(text or "")


def shingles(text: str | None, size: int) -> set[tuple[str, ...]]:
    w = words((text or "").translate(ASCII))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def groups(items: list, linked) -> dict[int, int]:
    """Smallest reachable item of each, trying all pairs."""
    root = {i: i for i in items}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(items):
        for b in items[k + 1 :]:
            if linked(a, b):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in items}
