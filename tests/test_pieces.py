import random

from zonalis.operators import measure
from zonalis.plans import catalogue


def test_no_group_is_gathered(spark, sf):
    """Neither a user's history nor a label's values meet in one row or one map."""
    for name, bad in (("ema_fold", "collect_list(struct(ts"), ("contrast_percentiles", "percentile(")):
        plan = catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert bad not in plan, name


def test_average_and_percentiles_of_pieces(spark):
    rng = random.Random(2)
    rows = [(g, k, rng.choice([1.0, 2.5, rng.gauss(0, 9)])) for g in (1, 2, None) for k in range({1: 900, 2: 1, None: 40}[g])] + [(3, 0, None), (3, 1, 2.0)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g int, k int, x double")
    average = {r["g"]: r["average"] for r in measure.moving_average_of(df, "g", ["k"], "x", 0.9).collect()}
    shares = [0.05, 0.5, 0.95, 1.0]
    found = {r["g"]: r["p"] for r in measure.percentiles(df, "g", "x", shares).collect()}
    for g in (1, 2, None):
        x = [v for _, v in sorted((k, v) for h, k, v in rows if h == g)]
        a = x[0]
        for v in x[1:]:
            a = 0.9 * a + 0.1 * v
        assert abs(average[g] - a) < 1e-9
        x.sort()
        for q, p in zip(shares, found[g]):
            at = q * (len(x) - 1)
            low, high = x[int(at)], x[min(int(at) + 1, len(x) - 1)]
            assert abs(p - (low + (high - low) * (at - int(at)))) < 1e-9
    assert average[3] is None and found[3][0] == 2.0
