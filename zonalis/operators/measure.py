"""Grading readings against the truth: tallies, buckets, confusions, reconciliation, profiles and running rates, as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from zonalis.functions import kbest
from zonalis.functions.geometry import severity_bucket


def rate(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 of a timestamp without zone, whatever the session's zone."""
    since = ts - F.expr("timestamp_ntz'1970-01-01 00:00:00'")
    part = lambda unit: F.extract(F.lit(unit), since)
    return part("DAY") * 86400.0 + part("HOUR") * 3600.0 + part("MINUTE") * 60.0 + part("SECOND").cast("double")


def outcome(greedy_right: Column, decoded_right: Column) -> Column:
    return F.when(decoded_right & ~greedy_right, "repair").when(greedy_right & ~decoded_right, "regression").otherwise("unchanged")


def tally(df: DataFrame, *keys: str, got: tuple[str, str], want: tuple[str, str] = ("truth1", "truth2"), valid: str | None = None) -> DataFrame:
    """documents, line1, line2, both and validates: how many read right, per keys."""
    one, two = [F.col(g) == F.col(w) for g, w in zip(got, want, strict=True)]
    counts = [F.count(F.lit(1)).alias("documents"), F.count_if(one).alias("line1"), F.count_if(two).alias("line2"), F.count_if(one & two).alias("both")]
    return df.groupBy(*keys).agg(*counts, *([F.count_if(F.col(valid)).alias("validates")] if valid else []))


def tally_by_severity(df: DataFrame, got: tuple[str, str]) -> DataFrame:
    """Tallies of every severity bucket and of all, in one pass."""
    one, two = F.col(got[0]) == F.col("truth1"), F.col(got[1]) == F.col("truth2")
    out = df.withColumn("bucket", severity_bucket(F.col("severity"))).rollup("bucket")
    return out.agg(F.count(F.lit(1)).alias("documents"), F.count_if(one).alias("line1"), F.count_if(two).alias("line2"), F.count_if(one & two).alias("both")).withColumn("bucket", F.coalesce("bucket", F.lit("all")))


def comparison(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, documents, greedy, decoded, repairs, regressions, gain) of df (greedy2, decoded2, truth2): line 2 read right at once and after decoding, and the difference of the two rates."""
    one, two = F.col("greedy2") == F.col("truth2"), F.col("decoded2") == F.col("truth2")
    said = outcome(one, two)
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("documents"), F.count_if(one).alias("greedy"), F.count_if(two).alias("decoded"), F.count_if(said == "repair").alias("repairs"), F.count_if(said == "regression").alias("regressions"))
    return out.withColumn("gain", rate(F.col("decoded"), F.col("documents")) - rate(F.col("greedy"), F.col("documents")))


def accuracy(df: DataFrame, scores: str = "scores", labels: str = "labels") -> DataFrame:
    """One row (lines, char_accuracy, line_accuracy, loss): places whose first greatest score is the label's, lines of which all are, and the mean cross-entropy of a place; rates of no lines are 0, their loss is null."""
    right = F.zip_with(kbest.greedy(F.col(scores)), labels, lambda g, want: (g == want).cast("int"))
    loss = F.zip_with(scores, labels, lambda s, want: cross_entropy(kbest.log_softmax(s), want))
    total = lambda a, zero: F.aggregate(a, zero, lambda t, x: t + x)
    told = df.select(total(right, F.lit(0)).alias("right"), F.size(labels).alias("places"), total(loss, F.lit(0.0)).alias("loss"))
    out = told.agg(F.count(F.lit(1)).alias("lines"), F.sum("right").alias("r"), F.sum("places").alias("p"), F.count_if(F.col("right") == F.col("places")).alias("whole"), F.sum("loss").alias("l"))
    return out.select("lines", rate(F.col("r"), F.col("p")).alias("char_accuracy"), rate(F.col("whole"), F.col("lines")).alias("line_accuracy"), F.try_divide("l", "p").alias("loss"))


def char_pairs(df: DataFrame, got: str, want: str, *keys: str) -> DataFrame:
    """A row for each position of want: (keys, pos, want, got); got is a blank where the reading is shorter. Longer readings' tails are left out."""
    pairs = F.transform(F.split(want, ""), lambda c, i: F.struct(i.alias("pos"), c.alias("want"), F.substr(F.rpad(F.coalesce(F.col(got), F.lit("")), 44, " "), i + 1, F.lit(1)).alias("got")))
    return df.select(*keys, F.inline_outer(pairs))


def confusions(pairs: DataFrame, first: list[str], most: int | None = None) -> DataFrame:
    """(want, got, n) of wrong characters but blanks, the most frequent first, ties by first place."""
    out = pairs.where("want <> got AND got <> ' '").groupBy("want", "got").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*first)).alias("_first")).orderBy(F.desc("n"), "_first").drop("_first")
    return out.limit(most) if most else out


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side) of keys on one side only: left_only and right_only. Both must be empty for a complete set."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left_only")).union(b.join(a, key, "left_anti").withColumn("side", F.lit("right_only")))


def pair_lines(df: DataFrame, index: Column, keys: list[str], text: str) -> DataFrame:
    """(keys, document, line1, line2): rows 2d and 2d + 1 are the lines of document d."""
    document, line = F.floor(index / 2), F.pmod(index, F.lit(2))
    return df.groupBy(*keys, document.alias("document")).agg(F.max(F.when(line == 0, F.col(text))).alias("line1"), F.max(F.when(line == 1, F.col(text))).alias("line2"))


def runs(df: DataFrame, keys: list[str], pos: str, live: Column, least: int) -> DataFrame:
    """(keys, first, past) of stretches of at least `least` neighbouring live positions."""
    order = Window.partitionBy(*keys).orderBy(pos)
    island = df.where(live).withColumn("_island", F.col(pos) - F.row_number().over(order))
    return island.groupBy(*keys, "_island").agg(F.min(pos).alias("first"), (F.max(pos) + 1).alias("past")).where(F.col("past") - F.col("first") >= least).drop("_island")


def window_rate(df: DataFrame, keys: list[str], order: list[str], step: str, seconds: Column) -> DataFrame:
    """df with rate: steps a second since the row before, not since the start; null on the first row."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rate", (F.col(step) - F.lag(step).over(w)) / F.greatest(seconds - F.lag(seconds).over(w), F.lit(1e-9)))


def progress(df: DataFrame, keys: list[str], step: str, seconds: Column, total: Column) -> DataFrame:
    """df with rate (of the last window), elapsed seconds since the run's first row, and eta in seconds; the eta is null without a rate above 0."""
    out = window_rate(df, keys, [step], step, seconds)
    elapsed = seconds - F.min(seconds).over(Window.partitionBy(*keys))
    return out.withColumns({"elapsed": elapsed, "eta": F.when(F.col("rate") > 0, (total - F.col(step)) / F.col("rate"))})


def latest(df: DataFrame, keys: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """The newest row of every key, by partial maxima instead of a sort."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_row")).select(*keys, "_row.*")


def moving_average(values: Column, decay: float) -> Column:
    """Exponential moving average of an array in order, from its first value."""
    return F.aggregate(F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0))), F.get(values, F.lit(0)), lambda a, x: decay * a + (1 - decay) * x)


def moving_average_of(df: DataFrame, group: str, order: list[str], value: str, decay: float) -> DataFrame:
    """(group, average): moving_average of each group's values in order; null if one of them is null.

    Rows are dealt by ranges of (group, *order), so a group of any size is cut into runs. A run becomes its length and its weighted sum, and a group's few runs are combined.
    """
    dealt = df.select(F.col(group).alias("_g"), *order, F.col(value).alias("_x")).repartitionByRange(F.col("_g"), *order).withColumn("_run", F.spark_partition_id())
    after = F.row_number().over(Window.partitionBy("_g", "_run").orderBy(*[F.col(c).desc() for c in order])) - 1
    weighed = dealt.withColumn("_w", F.col("_x") * F.pow(F.lit(decay), after))
    first = F.min(F.struct(*order, F.col("_x").alias("x")))["x"]
    runs = weighed.groupBy("_g", "_run").agg(F.count(F.lit(1)).alias("n"), F.count("_x").alias("whole"), F.sum("_w").alias("sum"), first.alias("first"))
    listed = runs.groupBy("_g").agg(F.array_sort(F.collect_list(F.struct("_run", "n", "whole", "sum", "first"))).alias("r"))
    start = F.get("r", F.lit(0))["first"]
    total = F.aggregate("r", start, lambda a, x: F.when(x["whole"] == x["n"], a * F.pow(F.lit(decay), x["n"]) + (1 - decay) * x["sum"]))
    return listed.select(F.col("_g").alias(group), total.alias("average"))


def percentiles(df: DataFrame, group: str, value: str, shares: list[float], buckets: int = 4096) -> DataFrame:
    """(group, p): of each group the exact percentiles of its values that aren't null, between neighbours in proportion; null for a group without values.

    Equal ranges of a group's values are counted first. Only the ranges that hold a wanted rank are then ordered, as counts of distinct values.
    """
    rows = df.select(F.col(group).alias("_g"), F.col(value).cast("double").alias("_x"))
    spans = rows.groupBy("_g").agg(F.min("_x").alias("_low"), F.max("_x").alias("_high"), F.count("_x").alias("_n"))
    same = lambda a, b, *more: [F.col(f"{a}._g").eqNullSafe(F.col(f"{b}._g")), *[F.col(f"{a}.{c}") == F.col(f"{b}.{c}") for c in more]]
    place = F.when(F.col("_high") > F.col("_low"), F.least(F.lit(buckets - 1), F.floor((F.col("_x") - F.col("_low")) / (F.col("_high") - F.col("_low")) * buckets))).otherwise(0).cast("int")
    valued = rows.where("_x IS NOT NULL").groupBy("_g", "_x").agg(F.count(F.lit(1)).alias("_k"))
    placed = valued.alias("a").join(spans.alias("b"), same("a", "b")).select("a._g", "_x", "_k", "_n", place.alias("_b"))
    counts = placed.groupBy("_g", "_b", "_n").agg(F.sum("_k").alias("_in"))
    counts = counts.withColumn("_before", F.sum("_in").over(Window.partitionBy("_g").orderBy("_b")) - F.col("_in"))
    at = lambda q: F.lit(q) * (F.col("_n") - 1)
    ranks = F.array(*[F.struct(F.lit(i).alias("q"), F.lit(h).alias("h"), F.least(F.floor(at(q)) + h, F.col("_n") - 1).alias("r")) for i, q in enumerate(shares) for h in (0, 1)])
    wanted = counts.select("_g", "_b", "_before", "_in", F.explode(ranks).alias("w")).where("w.r >= _before AND w.r < _before + _in")
    held = placed.alias("a").join(wanted.select("_g", "_b", "_before").distinct().alias("b"), same("a", "b", "_b")).select("a._g", "a._b", "_x", "_k", "_before")
    held = held.withColumn("_past", F.col("_before") + F.sum("_k").over(Window.partitionBy("_g", "_b").orderBy("_x")))
    found = held.alias("a").join(wanted.select("_g", "_b", "w").alias("b"), same("a", "b", "_b")).where("w.r < _past AND w.r >= _past - _k")
    picked = found.groupBy("a._g").agg(*[F.max(F.when((F.col("w.q") == i) & (F.col("w.h") == h), F.col("_x"))).alias(f"_{i}_{h}") for i in range(len(shares)) for h in (0, 1)])
    both = spans.alias("a").join(picked.alias("b"), same("a", "b"), "left")
    part = lambda q: at(q) - F.floor(at(q))
    return both.select(F.col("a._g").alias(group), F.array(*[F.col(f"_{i}_0") + (F.col(f"_{i}_1") - F.col(f"_{i}_0")) * part(q) for i, q in enumerate(shares)]).alias("p"))


def cross_entropy(log_probs: Column, label: Column, smoothing: float = 0.0) -> Column:
    """-log p of the label, mixed with the mean over all classes if smoothed."""
    own = -F.get(log_probs, label)
    return own if not smoothing else (1 - smoothing) * own - smoothing * F.aggregate(log_probs, F.lit(0.0), lambda a, x: a + x) / F.size(log_probs)
