import random

from pyspark.sql import functions as F

from zonalis.functions import codec, dates
from zonalis.functions.alphabet import ALPHABET, known_states
from zonalis.functions.validate import issues, line1_issues, line2_issues

LINE1 = "P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<"
LINE2 = "L898902C36UTO7408122F1204159ZE184226B<<<<<10"
SPECIMEN = {
    "issuing_state": "UTO",
    "primary_name": "ERIKSSON",
    "secondary_name": "ANNA MARIA",
    "document_number": "L898902C3",
    "nationality": "UTO",
    "birth_date": "740812",
    "sex": "F",
    "expiry_date": "120415",
    "optional_data": "ZE184226B",
}


def fields_of(spark, pairs, year=2015):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    found = df.select("i", issues(F.col("a"), F.col("b"), year, known_states(spark)).alias("x")).collect()
    return [[x["field"] for x in r["x"]] for r in sorted(found, key=lambda r: r["i"])]


def test_specimen(spark):
    df = codec.with_lines(spark.createDataFrame([tuple(SPECIMEN.values())], ", ".join(f"{k} string" for k in SPECIMEN)), {k: F.col(k) for k in SPECIMEN})
    row = df.first()
    assert (row["line1"], row["line2"], row["error"]) == (LINE1, LINE2, None)
    assert fields_of(spark, [(LINE1, LINE2)], 2026) == [[]]
    parsed = df.select(codec.parse(F.col("line1"), F.col("line2")).alias("d")).first()["d"]
    assert all(parsed[k] == v for k, v in SPECIMEN.items())


def test_damage(spark):
    second = [LINE2, LINE2[:19] + "9" + LINE2[20:], LINE2[:20] + "M" + LINE2[21:], LINE2[:10] + "AUZ" + LINE2[13:], LINE2[:10] + "AUT" + LINE2[13:]]
    got = fields_of(spark, [*[(LINE1, x) for x in second], ("V" + LINE1[1:], LINE2), (LINE1, LINE2.replace("L8", "LB", 1))])
    assert got[:6] == [[], ["birth_date_cd", "composite_cd"], [], ["nationality"], [], ["document_code"]]
    assert "document_number_cd" in got[6]


def test_parts_add_up(spark):
    df = spark.createDataFrame([(LINE1, LINE2[:20] + "X" + LINE2[21:]), ("X<QQQ" + LINE1[5:], LINE2)], "a string, b string")
    states = known_states(spark)
    got = df.select(F.size(issues(F.col("a"), F.col("b"), 2015, states)).alias("n"), (F.size(line1_issues(F.col("a"), states)) + F.size(line2_issues(F.col("b"), 2015, states))).alias("m")).collect()
    assert [(r.n, r.m) for r in got] == [(1, 1), (2, 2)]


def test_states(spark):
    states = known_states(spark)
    assert len(states) == 249 + 16 and {"USA", "UTO", "D", "XXC"} <= set(states) and not {"QQQ", "AUZ", "US"} & set(states)


def test_dates(spark):
    df = spark.createDataFrame([(74, 1974), (15, 2015), (16, 1916), (0, 2000), (99, 1999)], "yy int, want int")
    assert df.where(dates.birth_year(F.col("yy"), 2015) != F.col("want")).isEmpty()
    texts = spark.createDataFrame([("7408",), ("7408123",), ("74081A",), ("<<<<<<",), ("740812\n",), (None,)], "t string")
    assert texts.where(dates.parse_yymmdd(F.col("t")).isNotNull()).isEmpty()
    assert spark.range(1).select(dates.iso_date(F.lit("740230"), 2015, True).alias("d")).first()["d"] is None


def test_errors_in_order(spark):
    base = dict(SPECIMEN)
    rows = [base | {"primary_name": "ÆØ", "sex": "Q"}, base | {"birth_date": "7408"}, base | {"sex": "Q"}, base | {"document_number": "ABCDEFGHIJ"}, base | {"sex": None}]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{k} string" for k in SPECIMEN))
    got = [r["error"] for r in codec.with_lines(df, {k: F.col(k) for k in SPECIMEN}).collect()]
    assert got == ["primary_name", "birth_date", "sex", "document_number", None]


def test_lines(spark):
    texts = [(f" {LINE1}\r\n\t{LINE2} ", None), (LINE1, "lines"), (f"{LINE1[:-1]}\n{LINE2}", "length1"), (f"{LINE1}\n{LINE2[:-1]}x", "charset2"), ("", "lines")]
    df = spark.createDataFrame(texts, "t string, want string")
    assert df.where(~codec.lines_error(codec.split_lines(F.col("t"))).eqNullSafe(F.col("want"))).isEmpty()


def test_labels_and_names(spark):
    rng = random.Random(3)
    lines = [("".join(rng.choice(ALPHABET) for _ in range(44)),) for _ in range(50)]
    df = spark.createDataFrame(lines, "t string")
    assert df.where(codec.decode_labels(codec.encode_labels(F.col("t"))) != F.col("t")).isEmpty()
    name = spark.range(1).select(codec.encode_name(F.lit("O-NEIL"), F.lit("a  b")).alias("f")).select("f", codec.decode_name(F.col("f")).alias("d")).first()
    assert name["f"].startswith("O<NEIL<<A<<B<") and (name["d"]["primary"], name["d"]["secondary"]) == ("O NEIL", "A  B")


def test_one_wrong_character_is_caught(spark):
    """Outside its blind class, a wrong character under a check digit is always caught."""
    rng = random.Random(5)
    rows = []
    for _ in range(100):
        at = rng.choice([*range(9), *range(13, 19), *range(21, 27), *range(28, 42)])
        value = lambda c: 0 if c == "<" else "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ".index(c)
        new = rng.choice([c for c in ALPHABET if value(c) % 10 != value(LINE2[at]) % 10])
        rows.append((LINE1, LINE2[:at] + new + LINE2[at + 1 :]))
    df = spark.createDataFrame(rows, "a string, b string")
    found = df.select(F.transform(issues(F.col("a"), F.col("b"), 2015, known_states(spark)), lambda x: x["field"]).alias("i"))
    assert found.where(~F.array_contains("i", "composite_cd")).isEmpty()
