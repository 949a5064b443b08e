import random

import helpers

from zonalis.llm import fuzzy_lines


def changed(rng, line, kind):
    letters = "abcdefghijklmnopqrstuvwxyz"
    if kind == "letter":
        i = rng.randrange(len(line))
        return line[:i] + rng.choice("xyz") + line[i + 1 :]
    if kind == "word":
        w = line.split(" ")
        i = rng.choice([i for i in range(len(w)) if len(w[i]) <= 0.1 * len(line)] or [0])
        w[i] = "".join(rng.choice(letters) for _ in range(min(len(w[i]), max(1, len(line) // 10))))
        return " ".join(w)
    s = list(line)
    for i in rng.sample(range(len(s)), len(s) // 20):
        s[i] = rng.choice(letters)
    return "".join(s)


def test_recall_against_edit_similarity(spark):
    """Every pair of two documents is similar by edit distance alone; nearly all have to be found, whatever their length."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghik") for _ in range(rng.randint(2, 9)))
    rows, kinds = [], {}
    similar = fuzzy_lines._similar(0.9)
    for kind in ("letter", "word", "scattered"):
        for _ in range(150):
            a = " ".join(word() for _ in range(rng.choice([5, 6, 8, 12, 20, 40, 80])))
            b = changed(rng, a, kind)
            if a != b and similar(a, b) and len(b.split()) >= 5:
                kinds[len(rows) + 1] = kind
                rows += [(len(rows), a, "en", "a", 1, 1, "x", 0.5), (len(rows) + 1, b, "en", "a", 1, 1, "x", 0.5)]
    gone = {r["doc_id"] for r in fuzzy_lines.removed_lines(helpers.frame(spark, rows)).collect()}
    assert gone <= set(kinds)
    for kind, least in (("letter", 0.98), ("word", 0.97), ("scattered", 0.9)):
        own = [i for i in kinds if kinds[i] == kind]
        assert len(own) > 90 and sum(i in gone for i in own) >= least * len(own), (kind, len(own), sum(i in gone for i in own))
