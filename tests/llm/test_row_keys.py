import helpers
from pyspark.sql import functions as F

from zonalis.llm import fuzzy_lines, near_dup

ROWS = [
    (7, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "a", 1),
    (3, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "a", 1),
    (7, "one text that stands here alone and nowhere else at all", "en", "a", 1),
    (9, "both rows of this id are the same in every word they have", "en", "a", 1),
    (9, "both rows of this id are the same in every word they have", "en", "a", 1),
    (None, "copies without an id are copies as much as any others are", "en", "a", 1),
    (None, "copies without an id are copies as much as any others are", "en", "a", 1),
    (None, "yet what has no id and is said once only must be kept", "en", "a", 1),
]


def test_rows_of_one_id_are_told_apart(spark):
    docs = helpers.frame(spark, [(*r, 1, "x", 0.5) for r in ROWS]).select("doc_id", "text", "lang", "source", "n_chars")
    want = sorted({r[1] for r in ROWS})
    for stage in (near_dup.one_of_each_group, fuzzy_lines.without_repeated_lines):
        left = stage(docs).collect()
        assert sorted(r["text"] for r in left) == want, stage
        assert {r["doc_id"] for r in left if r["text"].startswith("alpha")} == {3}


def test_columns_of_any_name(spark):
    docs = helpers.frame(spark, [(*r, 1, "x", 0.5) for r in ROWS]).withColumn("_row", F.lit("mine")).withColumn("row", F.lit(4)).withColumn("_gone", F.lit(5)).withColumn("a.b", F.lit(6))
    for stage in (near_dup.one_of_each_group, fuzzy_lines.without_repeated_lines):
        left = stage(docs)
        assert left.columns == docs.columns
        assert {(r["_row"], r["row"], r["_gone"], r["a.b"]) for r in left.collect()} == {("mine", 4, 5, 6)}
