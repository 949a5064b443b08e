"""Documents made from the driver's tables, as Spark columns and as the same in SQL."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalis.functions import codec
from zonalis.functions.alphabet import ALPHABET, COMPOSITE, LAYOUT, SPECIAL_STATES, VALUES
from zonalis.operators.dealing import spread

REFERENCE_YEAR = 2026
#: A state for each nation key; QQQ is none.
STATES = ("USA", "GBR", "DEU", "FRA", "ITA", "ESP", "JPN", "CHN", "IND", "BRA", "CAN", "AUS", "MEX", "ARG", "EGY", "NGA", "ZAF", "KEN", "SWE", "NOR", "POL", "UTO", "XXA", "QQQ", "D")
KNOWN = sorted({s for s in STATES if s != "QQQ"} | set(SPECIAL_STATES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share. Where that is unset, a temporary one in a local session, which goes at the end; on a cluster an error, since executors would not see it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="zonalis-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c_custkey, the ten fields): a document for every customer. Nations are 25 rows; orders are reduced to a row a customer before the join."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    last = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last"))
    key = F.col("c_custkey")
    odd = F.pmod(key, F.lit(2)) == 1
    two = lambda x: F.lpad(F.pmod(x, F.lit(100)).cast("string"), 2, "0")
    birth = F.date_add(F.lit("1940-01-01").cast("date"), F.pmod(key * 37, F.lit(25000)).cast("int"))
    day = lambda d, years: F.concat(two(F.year(d) + years), two(F.month(d)), two(F.dayofmonth(d)))
    df = customer.join(F.broadcast(nation), "c_nationkey").join(last, "c_custkey", "left")
    return df.select(
        "c_custkey",
        F.get(F.array(*[F.lit(s) for s in STATES]), F.col("c_nationkey")).alias("issuing_state"),
        F.concat("c_mktsegment", F.translate(F.lpad(key.cast("string"), 8, "0"), "0123456789", "ABCDEFGHIJ")).alias("primary_name"),
        F.regexp_replace(F.upper("n_name"), "[^A-Z]", "").alias("secondary_name"),
        F.concat(F.lit("C"), F.lpad(key.cast("string"), 8, "0")).alias("document_number"),
        F.get(F.array(*[F.lit(s) for s in STATES]), F.pmod(F.col("c_nationkey") + F.when(F.pmod(key, F.lit(19)) == 0, 1).otherwise(0), F.lit(25)).cast("int")).alias("nationality"),
        day(birth, 0).alias("birth_date"),
        F.when(F.pmod(key, F.lit(33)) == 0, "<").when(odd, "M").otherwise("F").alias("sex"),
        F.coalesce(day(F.col("last"), 10), F.lit("300630")).alias("expiry_date"),
        F.when(odd, F.col("c_mktsegment")).otherwise("").alias("optional_data"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c_custkey, line1, line2) serialised, and noisy2: line 2 with one character replaced. Identities are dealt by key over all cores before lines are worked out, since their join leaves them in few partitions."""
    ids = spread(identities(spark, sf_dir), "c_custkey")
    mrz = codec.with_lines(ids, {k: F.col(k) for k in codec.FIELD_ORDER if k != "document_code"})
    return mrz.select("c_custkey", "line1", "line2").withColumn("noisy2", noisy(F.col("line2"), F.col("c_custkey")))


def noisy(line: Column, key: Column) -> Column:
    """The line with the character at key * 7 mod 44 moved on in the alphabet, never to itself."""
    at = F.pmod(key * 7, F.lit(44)).cast("int")
    old = F.instr(F.lit(ALPHABET), F.substr(line, at + 1, F.lit(1)))
    new = F.substr(F.lit(ALPHABET), (F.pmod(old + F.pmod(key, F.lit(36)), F.lit(37)) + 1).cast("int"), F.lit(1))
    return F.concat(F.substr(line, F.lit(1), at), new, F.substr(line, at + 2))


def pseudo(what: str, *parts: Column) -> Column:
    """A whole number below 2**32 from md5, which SQL can make too."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(what), *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def sql_pseudo(what: str, *parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', '{what}', {', '.join(parts)})), 1, 8) AS BIGINT)"


def sql_cd(x: str) -> str:
    weight = "CASE (i - 1) % 3 WHEN 0 THEN 7 WHEN 1 THEN 3 ELSE 1 END"
    return f"CAST(coalesce(list_sum(list_transform(range(1, length({x}) + 1), lambda i: (greatest(instr('{VALUES}', substr({x}, i, 1)), 1) - 1) * {weight})), 0) % 10 AS VARCHAR)"


_STATE = "[" + ", ".join(f"'{s}'" for s in STATES) + "]"
_DAY = "lpad(CAST((year({d}) + {n}) % 100 AS VARCHAR), 2, '0') || lpad(CAST(month({d}) AS VARCHAR), 2, '0') || lpad(CAST(day({d}) AS VARCHAR), 2, '0')"
SQL_IDS = f"""base AS (
  SELECT c_custkey, c_nationkey, c_mktsegment, n_name, last, DATE '1940-01-01' + CAST(c_custkey * 37 % 25000 AS INTEGER) AS born
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey),
ids AS (
  SELECT c_custkey, {_STATE}[c_nationkey + 1] AS issuing_state,
    c_mktsegment || translate(lpad(CAST(c_custkey AS VARCHAR), 8, '0'), '0123456789', 'ABCDEFGHIJ') AS primary_name,
    regexp_replace(upper(n_name), '[^A-Z]', '', 'g') AS secondary_name,
    'C' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS document_number,
    {_STATE}[(c_nationkey + CASE WHEN c_custkey % 19 = 0 THEN 1 ELSE 0 END) % 25 + 1] AS nationality,
    {_DAY.format(d="born", n=0)} AS birth_date,
    CASE WHEN c_custkey % 33 = 0 THEN '<' WHEN c_custkey % 2 = 1 THEN 'M' ELSE 'F' END AS sex,
    coalesce({_DAY.format(d="last", n=10)}, '300630') AS expiry_date,
    CASE WHEN c_custkey % 2 = 1 THEN c_mktsegment ELSE '' END AS optional_data
  FROM base)"""
_NOISE = f"substr('{ALPHABET}', (instr('{ALPHABET}', substr(line2, c_custkey * 7 % 44 + 1, 1)) + c_custkey % 36) % 37 + 1, 1)"
SQL_LINES = f"""{SQL_IDS},
padded AS (
  SELECT *, rpad(document_number, 9, '<') AS num, rpad(optional_data, 14, '<') AS opt,
    'P<' || rpad(issuing_state, 3, '<') || rpad(substr(primary_name || '<<' || secondary_name, 1, 39), 39, '<') AS line1 FROM ids),
bodies AS (
  SELECT *, num || {sql_cd("num")} || rpad(nationality, 3, '<') || birth_date || {sql_cd("birth_date")} || sex || expiry_date || {sql_cd("expiry_date")} || opt
    || CASE WHEN optional_data = '' THEN '<' ELSE {sql_cd("opt")} END AS body FROM padded),
payloads AS (SELECT *, substr(body, 1, 10) || substr(body, 14, 7) || substr(body, 22, 22) AS payload FROM bodies),
serialized AS (SELECT *, body || {sql_cd("payload")} AS line2 FROM payloads),
lines AS (SELECT c_custkey, line1, line2, substr(line2, 1, c_custkey * 7 % 44) || {_NOISE} || substr(line2, c_custkey * 7 % 44 + 2) AS noisy2 FROM serialized)"""


def sql_field(name: str, line2: str = "line2") -> str:
    line, at, n = LAYOUT[name]
    return f"substr({line2 if line == 2 else 'line1'}, {at}, {n})"


def sql_issues(line2: str, known: list[str]) -> str:
    """CTEs from `lines` to `found` (c_custkey, line1, line2, fields): the fields of all issues in reporting order."""
    codes = ", ".join(f"'{s}'" for s in known)
    year = REFERENCE_YEAR
    real = lambda y, m, d: f"try_cast(lpad(CAST({y} AS VARCHAR), 4, '0') || '-' || {m} || '-' || {d} AS DATE) IS NOT NULL"
    payload = " || ".join(f"substr(l2, {at}, {n})" for at, n in COMPOSITE)
    parts = ", ".join(f"{sql_field(k, 'l2')} AS {k}" for k in LAYOUT if LAYOUT[k][0] == 2)
    bad_cd = lambda k: f"CASE WHEN {k}_cd <> {sql_cd(k)} THEN '{k}_cd' END"
    born = f"CASE WHEN byy > {year % 100} THEN byy + {year // 100 * 100 - 100} ELSE byy + {year // 100 * 100} END"
    return f"""parts AS (SELECT c_custkey, line1, {line2} AS l2, substr(line1, 3, 3) AS issuing_state, {parts.replace("l2,", f"{line2},")}, {payload.replace("l2", line2)} AS payload FROM lines),
dated AS (SELECT *, regexp_full_match(birth_date, '[0-9]{{6}}') AS b6, regexp_full_match(expiry_date, '[0-9]{{6}}') AS e6,
  try_cast(substr(birth_date, 1, 2) AS INTEGER) AS byy, try_cast(substr(expiry_date, 1, 2) AS INTEGER) + {year // 100 * 100} AS eyear FROM parts),
years AS (SELECT *, {born} AS byear FROM dated),
found AS (SELECT c_custkey, line1, l2 AS line2, list_filter([
  CASE WHEN NOT starts_with(line1, 'P') THEN 'document_code' END, {bad_cd("document_number")}, {bad_cd("birth_date")}, {bad_cd("expiry_date")},
  CASE WHEN NOT ((optional_data_cd = '<' AND replace(optional_data, '<', '') = '') OR optional_data_cd = {sql_cd("optional_data")}) THEN 'optional_data_cd' END,
  CASE WHEN composite_cd <> {sql_cd("payload")} THEN 'composite_cd' END,
  CASE WHEN sex NOT IN ('M', 'F', '<') THEN 'sex' END,
  CASE WHEN NOT b6 OR NOT {real("byear", "substr(birth_date, 3, 2)", "substr(birth_date, 5, 2)")} THEN 'birth_date' END,
  CASE WHEN NOT e6 OR NOT {real("eyear", "substr(expiry_date, 3, 2)", "substr(expiry_date, 5, 2)")} THEN 'expiry_date' END,
  CASE WHEN b6 AND e6 AND eyear * 10000 + try_cast(substr(expiry_date, 3, 4) AS INTEGER) < byear * 10000 + try_cast(substr(birth_date, 3, 4) AS INTEGER) THEN 'expiry_date' END,
  CASE WHEN rtrim(issuing_state, '<') NOT IN ({codes}) THEN 'issuing_state' END,
  CASE WHEN rtrim(nationality, '<') NOT IN ({codes}) THEN 'nationality' END], lambda x: x IS NOT NULL) AS fields FROM years)"""
