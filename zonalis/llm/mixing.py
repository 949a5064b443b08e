"""Mixing sources to target weights: exact quotas of permuted blocks, dealt to output shards by a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from zonalis.llm.shared import WORD, small_side, text_or_empty, written
from zonalis.llm.sharding import slots

ALL = 2**63 - 1


def _key(source: str) -> Column:
    """Sources as a key without null."""
    return F.when(F.col(source).isNull(), "n").otherwise(F.concat(F.lit("s"), F.col(source).cast("string")))


def in_order(df: DataFrame, column: str) -> DataFrame:
    """df, written, with _place: each row's place from 0 in the order of the column, nulls last. Ranges of the column are numbered apart and then shifted, so no task orders the whole table."""
    dealt = written(df.repartitionByRange(F.col(column).asc_nulls_last()).withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))  # a row for each range
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(F.col(column).asc_nulls_last())) - 1
    return dealt.withColumn("_place", inside).join(F.broadcast(shift), "_part").withColumn("_place", F.col("_place") + F.col("_before")).drop("_part", "_before")


def targets(sizes: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """(skey, source, source_size) with target: the total shared by weights that repeat over the sources in code point order, null last; no target above cap times its size, the excess reshared.

    Resharing is a loop of sums: what is left is shared by weight among the sources not yet at their cap; those that it would carry beyond it stop there, until none does.
    Its rounds are as many as there are steps of capping, and only two sums reach the driver in each.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = in_order(sizes, "source").withColumn("weight", F.get(cycle, F.pmod("_place", F.lit(len(weights))).cast("int"))).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    weighed = written(weighed.select("skey", "source", "source_size", "weight", "most"), "weighed")
    total = float(weighed.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        free = F.col("most") > F.lit(level) * F.col("weight")
        got = weighed.agg(F.sum(F.when(~free, F.col("most"))).alias("full"), F.sum(F.when(free, F.col("weight"))).alias("w")).first()
        share = (total - (got["full"] or 0.0)) / got["w"] if got["w"] else level
        if share <= level or not got["w"]:
            break
        level = share
    full = F.lit(level) * F.col("weight")
    return weighed.withColumn("target", F.least(full, F.col("most"))).select("skey", "source", "source_size", "target")


def _split_tree(draws: DataFrame, depth: int, seed: int) -> DataFrame:
    """Each block draw's shard. At every node a random order of its draws sends the first half left and the rest right, so the halves' source counts follow the multivariate hypergeometric law and every quota is kept exactly. The order is dealt into parts, which are numbered apart."""
    out = draws.withColumn("shard", F.lit(0))
    for level in range(depth):
        mixed = out.withColumn("_h", F.xxhash64(F.lit(seed), F.lit(level), "skey", "block", "turn"))
        half = mixed.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / 2).alias("_half"))  # 2**level rows
        placed = slots(mixed, "shard", F.xxhash64("_h", F.lit(9)), ["_h", "skey", "block", "turn"]).join(F.broadcast(half), "shard")
        out = written(placed.withColumn("shard", F.col("shard") * 2 + F.when(F.col("slot") >= F.col("_half"), 1).otherwise(0)).select("skey", "block", "turn", "shard"), f"split{level}")
    return out


def _columns(docs: DataFrame, blocks: int, seed: int, id_col: str, text_col: str, source_col: str) -> dict[str, Column]:
    """A document's size, source key, block and its place in the block's permutation; all follow from the row alone."""
    text = text_or_empty(text_col)
    place = F.xxhash64(F.lit(seed), F.col(id_col), text)
    return {"size": F.regexp_count(text, F.lit(WORD)).cast("long"), "skey": _key(source_col), "place": place, "block": F.pmod(F.xxhash64(F.lit(seed + 1), place), F.lit(blocks)).cast("int")}


def plan_mix(sized: DataFrame, weights: tuple[float, ...], cap: float, depth: int, seed: int) -> tuple[DataFrame, int]:
    """Per (skey, block): how often the whole block is drawn, up to which place it is drawn once more, and the shards of its draws; and the number of rows.

    A source's target is so many full passes and a rest. The rest takes whole blocks in permuted order; of the block it ends in, documents in
    order of place, found by sums over 256 ranges of places and then inside one range, so no task orders more than one range of one block.
    """
    per_block = written(sized.groupBy("skey", "block").agg(F.first("source").alias("source"), F.sum("size").alias("words")), "blocks")
    per_source = per_block.groupBy("skey").agg(F.first("source").alias("source"), F.sum("words").alias("source_size"))
    goal = written(targets(per_source, weights, cap), "targets")
    n = goal.count()
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goal = goal.withColumn("full", full.cast("int")).withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
    order = Window.partitionBy("skey").orderBy(F.xxhash64(F.lit(seed + 2), "skey", "block"), "block").rowsBetween(Window.unboundedPreceding, 0)
    blocks = per_block.drop("source").join(small_side(goal, n), "skey").withColumn("_to", F.sum("words").over(order))
    blocks = written(blocks.withColumn("need", F.col("rest") - (F.col("_to") - F.col("words"))), "quotas")
    ends = blocks.where((F.col("need") > 0) & (F.col("need") < F.col("words"))).select("skey", "block", "need")

    inside = sized.join(small_side(ends, n), ["skey", "block"]).withColumn("range", F.shiftright("place", 56))
    by_range = Window.partitionBy("skey", "block").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    ranges = inside.groupBy("skey", "block", "range", "need").agg(F.sum("size").alias("words")).withColumn("_to", F.sum("words").over(by_range))
    last = ranges.where((F.col("_to") >= F.col("need")) & (F.col("_to") - F.col("words") < F.col("need"))).withColumn("_before", F.col("_to") - F.col("words")).select("skey", "block", "range", "_before")
    by_place = Window.partitionBy("skey", "block").orderBy("place").rangeBetween(Window.unboundedPreceding, 0)
    near = inside.join(small_side(last, n), ["skey", "block", "range"]).withColumn("_to", F.col("_before") + F.sum("size").over(by_place))
    # the place at which the words drawn come nearest to the need; before the range's first document: the range's floor
    cut = near.groupBy("skey", "block", "range", "need", "_before").agg(F.min(F.struct(F.abs(F.col("_to") - F.col("need")).alias("off"), "place")).alias("best"))
    floor = F.shiftleft(F.col("range").cast("long"), 56) - 1
    cut = cut.select("skey", "block", F.when(F.col("best.off") <= F.col("need") - F.col("_before"), F.col("best.place")).when(F.col("range") == -128, F.lit(None)).otherwise(floor).alias("cut"))

    plan = blocks.join(cut, ["skey", "block"], "left").withColumn("upto", F.when((F.col("need") >= F.col("words")) & (F.col("rest") > 0), F.lit(ALL)).otherwise(F.col("cut")))
    plan = plan.select("skey", "block", "source_size", "target", "full", "upto")
    plan = written(plan, "plan")
    draws = plan.withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("full")))).where((F.col("turn") < F.col("full")) | F.col("upto").isNotNull()).select("skey", "block", "turn")
    shards = _split_tree(draws, depth, seed + 3).groupBy("skey", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "shard"))), lambda x: x["shard"]).alias("shards"))
    out = written(plan.join(shards, ["skey", "block"], "left"), "drawn")
    return out, out.count()


RESULT = ("_size", "_source_size", "_target", "_copies", "_shards")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3, depth: int = 4, blocks: int = 256, seed: int = 20, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with _size, _source_size, _target, _copies (how often the mix takes the document) and _shards (2**depth output shards, one for each copy); columns of those names that docs already has give way.

    Null and empty texts have size 0, a null source is a source of its own; sources without words get target 0. The same table gives the same mix.
    Equal rows (same id, text and source) share a place and are drawn together. An empty table gives an empty mix.
    """
    cols = _columns(docs, blocks, seed, id_col, text_col, source_col)
    sized = written(docs.select(F.col(source_col).cast("string").alias("source"), *[c.alias(k) for k, c in cols.items()]), "sized")
    plan, n = plan_mix(sized, weights, cap, depth, seed)
    keep = [c for c in docs.columns if c not in RESULT]
    told = docs.select(F.struct(F.lit(1).alias("_one"), *[F.col(f"`{c}`") for c in keep]).alias("row"), cols["size"].alias("_size"), cols["place"].alias("place"), cols["skey"].alias("skey"), cols["block"].alias("block"))
    joined = told.join(small_side(plan, n), ["skey", "block"])
    copies = (F.col("full") + F.when(F.col("place") <= F.col("upto"), 1).otherwise(0)).cast("int")
    joined = joined.withColumn("_copies", copies)
    out = joined.select(*[F.col(f"row.`{c}`").alias(c) for c in keep], "_size", F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), "_copies", F.when(F.col("_copies") > 0, F.slice("shards", 1, F.col("_copies"))).otherwise(F.array().cast("array<int>")).alias("_shards"))
    return out


def mixed_rows(mixed: DataFrame, seed: int = 20, id_col: str = "doc_id") -> DataFrame:
    """One row for each draw, with its shard, in a local random order inside each shard's files. Shards are written in pieces, so a task never holds a whole one. Documents that aren't drawn have none; an empty mix has none."""
    drawn = mixed.where("_copies > 0").select("*", F.posexplode("_shards").alias("_turn", "_shard"))
    shuffle = F.xxhash64(F.lit(seed + 4), F.col(id_col), F.col("_turn"))
    return drawn.withColumn("_order", shuffle).repartition(F.col("_shard"), F.pmod(F.col("_order"), F.lit(64))).sortWithinPartitions("_shard", "_order")


def mix_report(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, shards), a row for each row of docs: what the mix takes of it. Nulls, repeats and the empty table as mix_sources has them."""
    mixed = mix_sources(docs.select("doc_id", "text", "source"))
    return mixed.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"), F.col("_copies").alias("copies"), F.col("_shards").alias("shards"))
