import random
import re
import zlib
from collections import Counter

import helpers
import pytest

from zonalis.llm import variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def brute_counts(rows):
    seen = Counter()
    for i, text, *_ in rows:
        for run in RUN.findall(text or ""):
            w = run.translate(helpers.ASCII)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            seen[w] += 1
    return {w: n for w, n in seen.items() if len(w) >= 5 and n >= 3}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, p in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, q in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (p != q))
    return row[-1]


def brute(counts):
    near = {w: [u for u in counts if distance(u, w) == 1] for w in counts}
    form = {}
    for w, us in near.items():
        best = min(us, key=lambda u: (-counts[u], u), default=None)
        if best and counts[best] >= 2 * counts[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w, ""), root(w), n, len(near[w]), counts.get(form.get(w), 0)) for w, n in counts.items())


def plain(df):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or 0) for r in df.collect())


def prose(seed, n, alphabet="abcé", low=4, high=8):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(low, high))) for _ in range(n))


def test_report(spark):
    rows = [(i, prose(i % 6, 300) + " Straße ÀÉÎ×÷ WORTE Worte worte", "en", "a", 1, 1, "x", 0.5) for i in range(14)] + [(None, "Hello hello HELLO hallo", None, None, None, 1, "x", 0.5), (3, None, None, None, None, None, None, None), (4, "", "", "", 0, 1, "", 0.0), *helpers.odd_documents()]
    counts = brute_counts(rows)
    assert len(counts) > 300
    assert plain(variants.variant_report(helpers.frame(spark, rows))) == brute(counts)


@pytest.mark.parametrize("most", [2, 12, 10_000])
def test_pairs_at_any_bound(spark, most):
    """Words that share their halves, so that keys are split down to a code point."""
    rng = random.Random(4)
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(5, 9))) for _ in range(120)} | {f"prefix{chr(97 + i)}{chr(97 + j)}" for i in range(9) for j in range(9)} | {"prefix" + "é" * k for k in range(6)}
    df = spark.createDataFrame([(w, 3) for w in sorted(words)], "word string, n long")
    got = sorted((r["word"], r["near"]) for r in variants.near_words(df, most).collect())
    assert got == sorted((a, b) for a in words for b in words if distance(a, b) == 1)


def test_chains(spark):
    counts = {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24, "abbbb": 48, "bbbbb": 96, "zzzzz": 5, "zzzzy": 5, "zzzzx": 9}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert plain(variants.variant_groups(df)) == brute(counts)
    assert variants.variant_groups(df.limit(0)).count() == 0 and variants.variant_report(helpers.frame(spark, []).limit(0)).count() == 0


def test_differ_by_one():
    rng = random.Random(1)
    for _ in range(4000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 6))) for _ in range(2))
        assert variants.differ_by_one(a, b) == (distance(a, b) == 1)
