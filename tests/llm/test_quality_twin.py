"""The verdicts of quality rules from texts alone, in plain Python and numpy."""

import math
import random
from collections import Counter, defaultdict

import helpers
import numpy as np

from zonalis.llm import quality

LEAST = np.array(list(quality.FEATURES.values()))
RIDGE = np.diag(LEAST**2)


def statistics(text):
    w = helpers.words(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = Counter(windows)
    inside = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(inside)


def features(n, chars, symbols, repeats):
    more, padded = n + quality.PRIOR_WORDS, chars + 5 * quality.PRIOR_WORDS
    return [math.log1p(n), math.log(padded / more), math.sqrt(symbols / padded), math.sqrt(repeats / more)]


def at_rank(x, share):
    return sorted(x)[max(math.ceil(share * len(x)), 1) - 1]


def distances(x, mean, cov):
    return np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)


def robust(x):
    """(mean, covariance without the least variances, median distance) of the lower determinant of two starts."""
    quartiles = np.array([[at_rank(c, s) for s in (0.25, 0.5, 0.75)] for c in x.T])
    starts = [(quartiles[:, 1], np.diag(((quartiles[:, 2] - quartiles[:, 0]) / 1.349) ** 2) + RIDGE), (x.mean(0), np.cov(x.T, bias=True).reshape(4, 4) + RIDGE)]
    found = []
    for k, (mean, cov) in enumerate(starts):
        det = math.inf
        for _ in range(30):
            d = distances(x, mean, cov)
            near = x[d <= at_rank(d, 0.75) + 1e-12]
            new_mean, new_cov = near.mean(0), np.cov(near.T, bias=True).reshape(4, 4) + RIDGE
            new = np.linalg.slogdet(new_cov)[1]
            goes_on = new < det - 0.01
            if new < det:
                mean, cov, det = new_mean, new_cov, new
            if not goes_on:
                break
        found.append((det, k, mean, cov))
    _, _, mean, cov = min(found, key=lambda f: f[:2])
    return mean, cov - RIDGE, at_rank(distances(x, mean, cov), 0.5)


def verdicts(rows, cutoff=75.0):
    groups, out, where = defaultdict(list), [], []
    for r in rows:
        n, chars, symbols, repeats = statistics(r[1])
        failed = n < 10 or 100 * repeats > 20 * n
        out.append(not failed)
        where.append(None if failed else (r[2], r[3]))
        if not failed:
            for key in ((r[2], r[3]), (r[2],), ()):
                groups[key].append(features(n, chars, symbols, repeats))
    fits = {k: robust(np.array(v)) for k, v in groups.items()}

    def pulled(key):
        n, own = len(groups[key]), fits[key]
        above = pulled(key[:-1]) if key else (own[0], (quality.SPREAD**2 - 1) * RIDGE, own[2])
        return tuple((n * p + quality.PRIOR_ROWS * q) / (n + quality.PRIOR_ROWS) for p, q in zip(own, above, strict=True))

    for i, (r, key) in enumerate(zip(rows, where, strict=True)):
        if key:
            mean, cov, middle = pulled(key)
            x = np.array(groups[key])
            middle = (len(x) * at_rank(distances(x, mean, cov + RIDGE), 0.5) + quality.PRIOR_ROWS * middle) / (len(x) + quality.PRIOR_ROWS)
            d = distances(np.array([features(*statistics(r[1]))]), mean, cov + RIDGE)[0]
            out[i] = bool(d * quality.CHI2_MEDIAN / max(middle, 0.5) <= cutoff)
    return out


def junk(rng, n):
    return " ".join(rng.choice(["|", "##", "$$$", "a", "<>"]) for _ in range(n))


def some_documents():
    """Groups of one row to two hundred, clean texts and junk in each."""
    rng = random.Random(3)
    word = lambda low, high: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(low, high)))
    rows = []
    for g, size in enumerate([1, 1, 2, 3, 5, 9, 29, 30, 31, 60, 200]):
        for k in range(size):
            text = " ".join(word(2, 7 + g % 3) for _ in range(rng.randint(20, 400)))
            if k % 17 == 3 or size == 1 and g:
                text = junk(rng, 120)
            rows.append((len(rows), text, ["en", "de", None][g % 3], f"s{g}" if g % 4 else None, 1, 1, "x", 0.5))
    return rows


def compare(spark, rows):
    got = {r["doc_id"]: r["kept"] for r in quality.quality_report(helpers.frame(spark, rows)).collect()}
    want = dict(zip([r[0] for r in rows], verdicts(rows), strict=True))
    assert got == want, {k: (got[k], want[k]) for k in want if got[k] != want[k]}
    return want


def test_groups_of_any_size(spark):
    want = compare(spark, some_documents())
    rows = [r for r in some_documents() if helpers.words(r[1])]
    junked = [want[r[0]] for r in rows if "##" in r[1]]
    clean = [want[r[0]] for r in rows if "##" not in r[1]]
    assert not any(junked) and sum(clean) >= 0.98 * len(clean)  # word lengths differ by group, so a small one lies off its language


def test_odd_documents(spark):
    rows = [(i, *r[1:]) for i, r in enumerate(helpers.odd_documents())]
    compare(spark, rows)


def test_few_documents(spark):
    rows = [r for r in some_documents() if r[2] == "en"]
    for n in (1, 2, 4, 12):
        compare(spark, rows[:n])
