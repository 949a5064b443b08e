import numpy as np
from pyspark.sql import functions as F

from zonalis.llm import near_dup


def test_pairs_survive_branching(spark):
    """Pairs whose signatures agree in eight of ten places, below one large node: four levels on, most still share one."""
    draw = np.random.default_rng(4)
    rows = []
    for k in range(400):
        a = draw.integers(0, 1 << 32, near_dup.WIDTH, np.uint32)
        b = np.where(draw.random(near_dup.WIDTH) < 0.8, a, draw.integers(0, 1 << 32, near_dup.WIDTH, np.uint32)).astype(np.uint32)
        rows += [(2 * k, a.tobytes()), (2 * k + 1, b.tobytes())]
    reps = spark.createDataFrame(rows, "v long, sig binary").withColumn("w", F.lit(1)).cache()
    at = reps.select("v", F.lit(1).cast("long").alias("node"))
    for _ in range(4):
        at = near_dup._branches(at.select("v", "node").join(reps, "v"), [F.col("node")], near_dup.CHILDREN)
    pair = at.select(F.floor(F.col("v") / 2).alias("k"), "v", "node").groupBy("k", "node").agg(F.countDistinct("v").alias("n"))
    assert pair.where("n = 2").select("k").distinct().count() >= 0.7 * 400
