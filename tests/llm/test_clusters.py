import hashlib
import math
import random

from zonalis.llm import lloyd

SCHEMA = "vec_id long, embedding array<double>, v string, cluster int, label int"


def kept(rows):
    out = []
    for i, e, *_ in rows:
        if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e):
            out.append((i, [max(-lloyd.MOST, min(lloyd.MOST, math.floor(min(max(x, -1e9), 1e9) * 1024))) for x in e]))
    return out


def brute(rows):
    own = kept(rows)
    order = sorted((i is None, hashlib.sha256(f"3:{i}".encode()).hexdigest(), [x.to_bytes(4, "little", signed=True) for x in v], v) for i, v in own)
    centroids = [v for *_, v in order[:8]]
    far = lambda v, c: sum((p - q) ** 2 for p, q in zip(v, c, strict=True))
    nearest = lambda v: min((far(v, c), k) for k, c in enumerate(centroids))
    for _ in range(10):
        groups = {}
        for _, v in own:
            groups.setdefault(nearest(v)[1], []).append(v)
        for k, vs in groups.items():
            centroids[k] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    got = [(i, *nearest(v)[::-1]) for i, v in own]
    total = lambda k: sum(d for _, c, d in got if k in (None, c))
    fits = lambda x: x if x < 1 << 63 else None
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, fits(total(c)), fits(total(None)), sha[c]) for i, c, d in got), key=str)


def vectors(n, seed=1, at=8):
    rng = random.Random(seed)
    middles = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(at)]
    return [(i, [x + rng.gauss(0, 0.3) for x in rng.choice(middles)], "x", 7, 1) for i in range(n)]


def report(spark, rows):
    return sorted((tuple(r) for r in lloyd.cluster_report(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)


def test_lloyd(spark):
    rows = vectors(120)
    assert report(spark, rows) == brute(rows)


def test_odd_vectors(spark):
    same = [0.5] * 64
    rows = vectors(30, 2, 3) + [(i, same, None, None, None) for i in range(40, 60)] + [(None, same, "", 0, 0), (None, [0.25] * 64, "", 0, 0), (7, [-0.0004] * 64, "", 1, 1), (7, [-0.0004] * 64, "", 1, 1)]
    rows += [(100, None, "", 1, 1), (101, [], "", 1, 1), (102, [1.0] * 63, "", 1, 1), (103, [1.0] * 65, "", 1, 1), (104, [float("nan")] + [0.0] * 63, "", 1, 1), (105, [0.0] * 63 + [float("-inf")], "", 1, 1), (106, [None] + [0.0] * 63, "", 1, 1)]
    assert report(spark, rows) == brute(rows)


def test_huge_components_and_few_vectors(spark):
    rows = [(1, [1e300] * 64, "", 1, 1), (2, [-1e308] * 64, "", 1, 1), (3, [0.0] * 64, "", 1, 1)]
    assert report(spark, rows) == brute(rows)
    assert lloyd.cluster_report(spark.createDataFrame(rows, SCHEMA).limit(0)).count() == 0


def test_partitions_make_no_difference(spark):
    df = spark.createDataFrame(vectors(200, 5), SCHEMA)
    one, many = lloyd.lloyd(lloyd.kept_vectors(df.repartition(1))), lloyd.lloyd(lloyd.kept_vectors(df.repartition(13)))
    assert (one == many).all()
