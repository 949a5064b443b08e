"""Synthetic identities: every value follows from (seed, index) by hashing, so any split of the range gives the same rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalis.functions import codec
from zonalis.functions.alphabet import iso_states

#: Names are made of syllables, not listed.
SYLLABLES = ("KA", "LO", "MI", "RA", "SEN", "TOR", "VEL", "DI", "NO", "BER", "GA", "HU")
#: Number patterns, A for a letter and 9 for a digit: up to two letters, then digits to a length of 8 or 9.
PATTERNS = [("A" * letters).ljust(size, "9") for size in (8, 9) for letters in (0, 1, 2)]


@dataclass(frozen=True)
class IdentityConfig:
    reference_year: int = 2026
    other_nationality: float = 0.05
    long_name: float = 0.08
    one_given: float = 0.35
    expired: float = 0.15
    unstated_sex: float = 0.03
    no_optional: float = 0.45
    oldest: int = 90


def draw(index: Column, seed: int, what: str, most: int) -> Column:
    """A whole number from 0 to most - 1, by md5, so that other engines can make it too."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(what), index.cast("string"))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.lit(most)).cast("int")


def chance(index: Column, seed: int, what: str, share: float) -> Column:
    return draw(index, seed, what, 10_000) < F.lit(round(share * 10_000))


def _name(index: Column, seed: int, what: str) -> Column:
    table = F.array(*[F.lit(s) for s in SYLLABLES])
    return F.concat(*[F.get(table, draw(index, seed, f"{what}{k}", len(SYLLABLES))) for k in range(3)])


def _filled(pattern: Column, index: Column, seed: int) -> Column:
    """A pattern's letters and digits, from one hash a place."""
    code = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("number"), index.cast("string")))
    at = lambda i: F.conv(F.substr(code, 2 * i + 1, F.lit(2)), 16, 10).cast("int")
    return F.array_join(F.transform(F.split(pattern, ""), lambda c, i: F.when(c == "A", F.chr(65 + F.pmod(at(i), F.lit(26)))).otherwise(F.chr(48 + F.pmod(at(i), F.lit(10))))), "")


def _date(year: Column, month: Column, day: Column) -> Column:
    return F.concat(*[F.lpad(F.pmod(x, F.lit(100)).cast("string"), 2, "0") for x in (year, month, day)])


def random_identities(spark: SparkSession, n: int, seed: int = 1, config: IdentityConfig | None = None, states: list[str] | None = None, start: int = 0) -> DataFrame:
    """identities_of the numbers from start to start + n - 1."""
    return identities_of(spark.range(start, start + n).select(F.col("id").alias("index")), seed, config, states)


def identities_of(indexes: DataFrame, seed: int = 1, config: IdentityConfig | None = None, states: list[str] | None = None) -> DataFrame:
    """(index, the ten fields) of a table or stream of indexes. The expiry year is always after the birth year; expired documents ended at most 15 years ago, valid ones end within 10."""
    c = config or IdentityConfig()
    codes = states or iso_states(indexes.sparkSession)
    i = F.col("index")
    d = lambda what, most: draw(i, seed, what, most)
    maybe = lambda what, share: chance(i, seed, what, share)
    table = F.array(*[F.lit(s) for s in codes])
    ref = c.reference_year
    df = indexes.select("index")
    df = df.withColumns({"issuing_state": F.get(table, d("state", len(codes))), "_born": ref - d("age", c.oldest + 1), "_long": maybe("long", c.long_name), "_ended": maybe("expired", c.expired)})
    df = df.withColumn("_low", F.greatest(F.col("_born") + 1, F.when(F.col("_ended"), ref - 15).otherwise(ref)))
    df = df.withColumn("_high", F.greatest(F.col("_low"), F.when(F.col("_ended"), ref - 1).otherwise(ref + 10)))
    given = F.when(F.col("_long"), F.concat_ws(" ", *[_name(i, seed, f"given{k}") for k in "abc"])).when(maybe("one", c.one_given), _name(i, seed, "givena")).otherwise(F.concat_ws(" ", _name(i, seed, "givena"), _name(i, seed, "givenb")))
    extra = F.substr(F.upper(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("optional"), i.cast("string")))), F.lit(1), 1 + d("length", 14))
    return df.select(
        "index",
        F.lit("P<").alias("document_code"),
        "issuing_state",
        F.when(F.col("_long"), F.concat_ws("-", _name(i, seed, "surnamea"), _name(i, seed, "surnameb"))).otherwise(_name(i, seed, "surnamea")).alias("primary_name"),
        given.alias("secondary_name"),
        _filled(F.get(F.array(*[F.lit(p) for p in PATTERNS]), d("pattern", len(PATTERNS))), i, seed).alias("document_number"),
        F.when(maybe("moved", c.other_nationality), F.get(table, d("nation", len(codes)))).otherwise(F.col("issuing_state")).alias("nationality"),
        _date(F.col("_born"), 1 + d("bm", 12), 1 + d("bd", 28)).alias("birth_date"),
        F.when(maybe("unstated", c.unstated_sex), "<").otherwise(F.when(d("sex", 2) == 0, "M").otherwise("F")).alias("sex"),
        _date(F.col("_low") + F.pmod(d("ey", 1000), F.col("_high") - F.col("_low") + 1), 1 + d("em", 12), 1 + d("ed", 28)).alias("expiry_date"),
        F.when(maybe("bare", c.no_optional), "").otherwise(extra).alias("optional_data"),
    )


def samples_of(documents: DataFrame, seed: int = 1, lowest: float = 0.0, highest: float = 1.0, config: IdentityConfig | None = None, cuts: int = 1, most_weight: float = 0.0) -> DataFrame:
    """(index, document, line_index, severity, cut, ink_weight, text) of a table or stream of document numbers (index): samples 2d and 2d + 1 are the lines of document d, equally damaged.

    Severity is even between its bounds; the cut, one of so many, and the ink's weight, between -most_weight and most_weight, don't depend on it.
    """
    docs = identities_of(documents, seed, config)
    even = lambda what: draw(F.col("index"), seed, what, 10_000) / 10_000.0
    lines = codec.with_lines(docs, {k: F.col(k) for k in codec.FIELD_ORDER})
    lines = lines.select(F.col("index").alias("document"), (lowest + (highest - lowest) * even("severity")).alias("severity"), draw(F.col("index"), seed, "cut", cuts).alias("cut"), (most_weight * (2 * even("ink") - 1)).alias("ink_weight"), "line1", "line2")
    out = lines.select("document", "severity", "cut", "ink_weight", F.posexplode(F.array("line1", "line2")).alias("line_index", "text"))
    return out.select((F.col("document") * 2 + F.col("line_index")).alias("index"), "document", "line_index", "severity", "cut", "ink_weight", "text")


def line_samples(spark: SparkSession, n: int, seed: int = 1, epoch: int = 0, **options) -> DataFrame:
    """The first n samples of an epoch. Epochs hold different documents."""
    first = epoch * EPOCH
    docs = spark.range(first, first + -(-n // 2)).select(F.col("id").alias("index"))
    return samples_of(docs, seed, **options).where(F.col("index") < 2 * first + n)


def sample_stream(spark: SparkSession, documents_per_batch: int, seed: int = 1, start: int = 0, **options) -> DataFrame:
    """Samples without end: each trigger takes the next documents from `start` on. What a batch holds follows from its offset alone, so a restarted query goes on where it stopped with the same samples."""
    numbers = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", documents_per_batch).load()
    return samples_of(numbers.select((F.col("value") + start).alias("index")), seed, **options)


#: Documents between the first ones of two epochs.
EPOCH = 1 << 40


#: Stages of training as (name, lowest and highest severity, steps).
CURRICULUM = (("clean", 0.0, 0.05, 2000), ("light", 0.0, 0.35, 6000), ("moderate", 0.0, 0.65, 10000), ("heavy", 0.0, 1.0, 20000))


def curriculum(spark: SparkSession, stages=CURRICULUM, seed: int = 1) -> DataFrame:
    """(stage_index, stage, low, high, steps, first_step, past_step, seed)."""
    rows, at = [], 0
    for i, (name, low, high, steps) in enumerate(stages):
        rows.append((i, name, low, high, steps, at, at + steps, seed + 104729 * i))
        at += steps
    return spark.createDataFrame(rows, "stage_index int, stage string, low double, high double, steps long, first_step long, past_step long, seed long")


def stage_of(steps: DataFrame, stages: DataFrame, step: str = "step") -> DataFrame:
    """steps with stage_index and stage, by the range of steps that a stage holds; steps past the last stage are left out. stages: curriculum's few rows."""
    few = F.broadcast(stages.select("stage_index", "stage", "first_step", "past_step"))
    return steps.join(few, (F.col(step) >= F.col("first_step")) & (F.col(step) < F.col("past_step"))).drop("first_step", "past_step")


#: How many steps apart a run is logged, evaluated and measured on real pages.
CADENCE = {"logs": 100, "evaluates": 1000, "measures": 5000}


def with_cadence(steps: DataFrame, step: str = "step", cadence: dict[str, int] = CADENCE) -> DataFrame:
    """steps with a flag for each thing that is due at them."""
    return steps.withColumns({name: (F.col(step) > 0) & (F.pmod(step, F.lit(n)) == 0) for name, n in cadence.items()})
