"""Candidates of a node: every two rows of different components meet, however large the node; nodes are found whole; edit distances of many pairs at once are exact."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from zonalis.llm import edits, fuzzy_lines, nodes


def test_all_pairs_of_a_large_node_meet(spark):
    rows = spark.range(60).select(F.lit(8).cast("long").alias("node"), F.col("id").alias("v"), F.lit(1).alias("w"))
    labels = spark.range(60).where("id < 20").select(F.col("id").alias("v"), (F.col("id") % 2).alias("c"))
    own = {v: v % 2 if v < 20 else v for v in range(60)}
    for small in (4, 16, 45, 60):
        held = {}
        for r in nodes.leaves(rows, labels, small).collect():
            assert r["c"] == own[r["v"]]
            held.setdefault(r["node"], []).append((r["v"], r["part"]))
        one_part = lambda x: len({p for _, p in x}) == 1
        met = {tuple(sorted((a, b))) for x in held.values() for (a, p), (b, q) in combinations(x, 2) if one_part(x) or p != q}
        assert met >= {(a, b) for a, b in combinations(range(60), 2) if own[a] != own[b]}, small


def test_nodes_that_hold_more_than_one(spark):
    rows = spark.range(3000).repartition(5)

    def of(batch: pa.RecordBatch):
        v = batch.column(0).to_numpy()
        return np.concatenate([v % 1000, 5000 + v]), np.concatenate([v, v])

    got = sorted(map(tuple, nodes.met(rows, of, 7).collect()))
    assert got == sorted((v % 1000, v) for v in range(3000))


def test_distances_of_many_pairs():
    rng = random.Random(6)
    for letters, low, high, group in (("ab", 0, 40, 100), ("abcdefgh é世\U0001F600", 1, 150, 4096), ("abcdefghijkl ", 120, 330, 4096)):
        lines = []
        for _ in range(250):
            a = [rng.choice(letters) for _ in range(rng.randint(low, high))]
            b = list(a)
            for _ in range(rng.randint(0, max(1, len(a) // 6))):
                at = rng.randrange(len(b) + 1)
                b[at : at + rng.randint(0, 1)] = rng.choice(["", rng.choice(letters)])
            lines += ["".join(a), "".join(b)]
        one = np.tile(np.arange(0, len(lines), 2), 8)
        two = one + 1
        most = np.array([rng.randint(0, max(1, int(0.15 * max(len(lines[p]), len(lines[q]))))) for p, q in zip(one, two, strict=True)])
        asked = []
        got = edits.all_within(lines, one, two, most, lambda a, b, t: asked.append(1) or fuzzy_lines.within_distance(a, b, t))
        assert len(asked) < len(one)
        assert got.tolist() == [fuzzy_lines.within_distance(lines[p], lines[q], int(t)) for p, q, t in zip(one, two, most, strict=True)]
