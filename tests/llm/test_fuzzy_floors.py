"""The kinds of change that many links of op 7 are lost to: what it finds of them is measured here, so that it doesn't fall unseen. The README says how far they are below 0.9."""

import random

import helpers

from zonalis.llm import fuzzy_lines

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def with_letters_changed(rng, line, n):
    s = list(line)
    for i in rng.sample([i for i, c in enumerate(s) if c != " "], n):
        s[i] = rng.choice([c for c in LETTERS if c != s[i]])
    return "".join(s)


def test_floors(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghik") for _ in range(rng.randint(2, 9)))
    similar, rows, kinds = fuzzy_lines._similar(0.9), [], {}
    for kind, sizes in (("three letters, short", [5, 6, 7]), ("a tenth, short", [5, 8, 12]), ("a tenth, long", [20, 40, 80])):
        for _ in range(120):
            a = " ".join(word() for _ in range(rng.choice(sizes)))
            b = with_letters_changed(rng, a, 3 if kind.startswith("three") else len(a) // 10)
            if similar(a, b):
                kinds[len(rows) + 1] = kind
                rows += [(len(rows), a, "en", "a", 1, 1, "x", 0.5), (len(rows) + 1, b, "en", "a", 1, 1, "x", 0.5)]
    gone = {r["doc_id"] for r in fuzzy_lines.removed_lines(helpers.frame(spark, rows)).collect()}
    assert gone <= set(kinds)
    found = {k: (sum(i in gone for i in kinds if kinds[i] == k), sum(v == k for v in kinds.values())) for k in set(kinds.values())}
    print(found)
    for kind, least in (("three letters, short", 0.55), ("a tenth, short", 0.4), ("a tenth, long", 0.25)):
        assert found[kind][0] >= least * found[kind][1], found
