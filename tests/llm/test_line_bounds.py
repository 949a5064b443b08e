import random

import helpers

from zonalis.llm import fuzzy_lines


def test_similar_lines_share_a_kind_of_signature():
    """Signatures are bounded by characters, as similarity is, so wide characters don't part similar lines."""
    rng = random.Random(1)
    for n in range(10, 140):
        line = "".join(rng.choice("abcdefgh ") for _ in range(n)).replace("  ", "ab").strip() or "ab"
        wide = list(line)
        for k in rng.sample(range(len(line)), len(line) // 10):
            wide[k] = "\U0001F600"
        pair = [line, "".join(wide)]
        kinds = fuzzy_lines._marked(pair)[4:6]
        assert any(all(sig is not None for sig in kind) for kind in kinds), n


def test_wide_letters_at_the_bound(spark):
    rng = random.Random(7)
    found = 0
    for k in range(6):
        words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(30)]
        line = " ".join(words)[:79].strip()
        at = len(line) // 2
        wide = line[:at] + "\U0001F600" * 7 + line[at + 7 :]
        assert len(line.encode()) < 80 < 96 < len(wide.encode())
        docs = helpers.frame(spark, [(1, line, "en", "a", 1, 1, "x", 0.5), (2, wide, "en", "a", 1, 1, "x", 0.5)])
        found += fuzzy_lines.removed_lines(docs).count()
    assert found == 6
