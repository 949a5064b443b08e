import random

import numpy as np
import pandas as pd

from zonalis.llm import edits, fuzzy_lines
from zonalis.llm.nodes import links_within


class Rows:
    """Takes the function that links_within gives to Spark."""

    def repartition(self, *_):
        return self

    sortWithinPartitions = select = repartition  # noqa: N815

    def mapInPandas(self, link, _):  # noqa: N802
        return link


def joined(links: pd.DataFrame, n: int) -> list[int]:
    root = list(range(n))
    for a, b in links[["a", "b"]].to_numpy().tolist():
        low, high = sorted((root[a], root[b]))
        root = [low if x == high else x for x in root]
    return root


def test_one_pair_of_two_components_goes_first():
    """Of two components that a link joins, no further pair is judged; those that nothing joins are judged whole, wherever batches end."""
    value = np.repeat(np.arange(4), [30, 30, 30, 10])  # of each node; all that is even is alike
    c = np.concatenate([np.arange(90) // 30, np.arange(90, 100)])
    rows = pd.DataFrame({"node": np.repeat([5, 6], 100), "v": np.arange(200), "c": np.concatenate([c, c + 100]), "part": 0, "sig": [b"\1\0"] * 200, "text": [str(x) for x in np.tile(value, 2)]})
    for sure in (None, lambda made, one, two: np.zeros(len(one), bool)):
        asked = []

        def alike(made, one, two):
            asked.append(len(one))
            return [int(made[i]) % 2 == int(made[j]) % 2 for i, j in zip(one, two, strict=True)]

        link = links_within(Rows(), "text", lambda p, q: np.ones(len(p)), 1, list, alike, together=1 << 15, sure=sure)
        for at in (200, 137, 30):
            asked.clear()
            got = pd.concat(link(iter([rows.iloc[k : k + at] for k in range(0, 200, at)])))
            root = np.array(joined(pd.DataFrame({"a": rows["c"].to_numpy()[got["a"]], "b": rows["c"].to_numpy()[got["b"]]}), 200))[rows["c"]]
            same = root[:, None] == root[None, :]
            want = (rows["node"].to_numpy()[:, None] == rows["node"].to_numpy()) & (np.tile(value, 2)[:, None] % 2 == np.tile(value, 2) % 2)
            assert (same == want).all() and len(got) == 2 * 11
            assert sum(asked) < 2 * 3200  # of 2 * 3645 pairs of different components; the 900 between both even ones are one


def test_lines_of_unlike_length_are_judged_together(monkeypatch):
    """Few pairs of each length: none goes alone, and all distances are right."""
    draw = random.Random(4)
    lines, most = [], []
    for n in list(range(100, 400, 2)) + [3, 900]:
        a = [draw.choice("abcdé ") for _ in range(n)]
        b = list(a)
        for _ in range(draw.randrange(0, n // 6 + 2)):
            at = draw.randrange(len(b) + 1)
            b[at : at + draw.randrange(2)] = draw.choice(["", "x", "yz"])
        lines += ["".join(a), "".join(b)]
        most.append(n // 10)
    one, two = np.arange(len(lines)).reshape(-1, 2).T
    alone = []
    got = edits.all_within(lines, one, two, np.array(most), lambda a, b, t: alone.append(a) or fuzzy_lines.within_distance(a, b, t))
    assert got.tolist() == [fuzzy_lines.within_distance(lines[p], lines[q], t) for p, q, t in zip(one, two, most, strict=True)]
    assert 10 < got.sum() < len(got) - 10 and len(alone) <= 30
