"""Queries over the text codec, dates, validation and candidates, with their SQL twins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalis.functions import codec, dates, kbest
from zonalis.functions.alphabet import ALPHABET, LAYOUT, SPECIAL_STATES, VALUES, blind_class, char_value, is_mrz_char, is_protected, is_state, iso_states
from zonalis.functions.validate import GUARDS, issues, line1_issues, line2_issues, trust
from zonalis.operators import payload
from zonalis.operators.dealing import spread
from zonalis.plans.inputs import KNOWN, REFERENCE_YEAR, SQL_IDS, SQL_LINES, identities, lines, pseudo, sql_cd, sql_field, sql_issues, sql_pseudo, table

QUERIES, ORACLE_SQL = {}, {}
LINE_FIELDS = ("document_number", "birth_date", "expiry_date", "optional_data")


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {SQL_IDS} SELECT c_custkey, document_number, {sql_cd('document_number')} AS cd FROM ids")
def check_digit(spark: SparkSession, sf: str) -> DataFrame:
    return identities(spark, sf).select("c_custkey", "document_number", codec.check_digit(F.col("document_number")).alias("cd"))


@query(f"""WITH {SQL_IDS}, tried AS (SELECT c_custkey, rpad(optional_data, 14, '<') AS v, CASE c_custkey % 3 WHEN 0 THEN '<' WHEN 1 THEN {sql_cd("rpad(optional_data, 14, '<')")} ELSE '5' END AS d FROM ids)
SELECT c_custkey, d = {sql_cd("v")} AS strict, (d = '<' AND replace(v, '<', '') = '') OR d = {sql_cd("v")} AS lenient FROM tried""")
def verify_check_digit(spark: SparkSession, sf: str) -> DataFrame:
    v = F.rpad("optional_data", 14, "<")
    turn = F.pmod("c_custkey", F.lit(3))
    d = F.when(turn == 0, "<").when(turn == 1, codec.check_digit(v)).otherwise("5")
    tried = identities(spark, sf).select("c_custkey", v.alias("v"), d.alias("d"))
    return tried.select("c_custkey", codec.verify_check_digit(F.col("v"), F.col("d")).alias("strict"), codec.verify_check_digit(F.col("v"), F.col("d"), True).alias("lenient"))


@query("""WITH n AS (SELECT p_partkey, translate(upper(p_name), ' -', '<<') AS plain, translate(upper(p_brand), ' -', '<<') AS b FROM part)
SELECT p_partkey, CASE WHEN regexp_full_match(plain, '[A-Z0-9<]*') THEN plain END AS name, CASE WHEN NOT regexp_full_match(b, '[A-Z0-9<]*') THEN NULL WHEN length(b) <= 9 THEN rpad(b, 9, '<') END AS brand FROM n""")
def normalize_pad(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", codec.normalize(F.col("p_name")).alias("name"), codec.pad(codec.normalize(F.col("p_brand")), 9).alias("brand"))


@query(f"WITH {SQL_IDS} SELECT c_custkey, rpad(substr(primary_name || CASE WHEN c_custkey % 7 = 0 THEN '' ELSE '<<' || secondary_name END, 1, 39), 39, '<') AS field FROM ids")
def encode_name(spark: SparkSession, sf: str) -> DataFrame:
    second = F.when(F.pmod("c_custkey", F.lit(7)) == 0, "").otherwise(F.col("secondary_name"))
    return identities(spark, sf).select("c_custkey", codec.encode_name(F.col("primary_name"), second).alias("field"))


@query(f"""WITH {SQL_LINES}, n AS (SELECT c_custkey, rtrim(substr(line1, 6, 39), '<') AS f FROM lines), cut AS (SELECT *, instr(f, '<<') AS p FROM n)
SELECT c_custkey, trim(replace(CASE WHEN p > 0 THEN substr(f, 1, p - 1) ELSE f END, '<', ' ')) AS primary_name, CASE WHEN p > 0 THEN trim(replace(substr(f, p + 2), '<', ' ')) ELSE '' END AS secondary_name FROM cut""")
def decode_name(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).select("c_custkey", codec.decode_name(codec.field(F.col("line1"), F.col("line2"), "name")).alias("n")).select("c_custkey", F.col("n.primary").alias("primary_name"), F.col("n.secondary").alias("secondary_name"))


@query(f"WITH {SQL_LINES} SELECT c_custkey, line1, line2 FROM lines")
def serialize_td3(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).drop("noisy2")


@query("""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, CAST(len(l) AS INTEGER) AS n_lines, CASE WHEN len(l) <> 2 THEN 'lines' WHEN length(l[1]) <> 44 THEN 'length1' WHEN NOT regexp_full_match(l[1], '[A-Z0-9<]*') THEN 'charset1' WHEN length(l[2]) <> 44 THEN 'length2' WHEN NOT regexp_full_match(l[2], '[A-Z0-9<]*') THEN 'charset2' END AS error FROM s""")
def split_lines_audit(spark: SparkSession, sf: str) -> DataFrame:
    split = table(spark, sf, "documents").select("doc_id", codec.split_lines(F.col("text")).alias("l"))
    return split.select("doc_id", F.size("l").alias("n_lines"), codec.lines_error(F.col("l")).alias("error"))


@query(f"""WITH {SQL_LINES} SELECT c_custkey, substr(line1, 1, 2) AS document_code, substr(line1, 3, 3) AS issuing_state, rtrim(substr(line2, 1, 9), '<') AS document_number, substr(line2, 11, 3) AS nationality,
substr(line2, 14, 6) AS birth_date, substr(line2, 21, 1) AS sex, substr(line2, 22, 6) AS expiry_date, rtrim(substr(line2, 29, 14), '<') AS optional_data, substr(line2, 44, 1) AS composite_cd, line1 || chr(10) || line2 AS mrz FROM lines""")
def parse_td3(spark: SparkSession, sf: str) -> DataFrame:
    doc = lines(spark, sf).select("c_custkey", codec.parse(F.col("line1"), F.col("line2")).alias("d"), F.concat_ws("\n", "line1", "line2").alias("mrz"))
    return doc.select("c_custkey", *[f"d.{k}" for k in ("document_code", "issuing_state", "document_number", "nationality", "birth_date", "sex", "expiry_date", "optional_data", "composite_cd")], "mrz")


@query(f"""WITH {SQL_LINES}, t AS (SELECT c_custkey, line2, list_transform(range(1, 45), lambda i: instr('{ALPHABET}', substr(line2, i, 1)) - 1) AS ix FROM lines)
SELECT c_custkey, CAST(list_sum(ix) AS BIGINT) AS total, CAST(ix[1] AS INTEGER) AS first, line2 AS text FROM t""")
def tokenize_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    ix = lines(spark, sf).select("c_custkey", codec.encode_labels(F.col("line2")).alias("ix"))
    return ix.select("c_custkey", F.aggregate("ix", F.lit(0), lambda a, x: a + x).cast("long").alias("total"), F.get("ix", F.lit(0)).alias("first"), codec.decode_labels(F.col("ix")).alias("text"))


@query(f"""WITH {SQL_LINES}, p AS (SELECT CAST(i AS INTEGER) AS place, substr(line2, CAST(i AS INTEGER) + 1, 1) AS c, count(*) AS n FROM lines, range(0, 44) t(i) GROUP BY ALL)
SELECT place, c, n, CAST(greatest(instr('{VALUES}', c), 1) - 1 AS INTEGER) AS value, CAST((greatest(instr('{VALUES}', c), 1) - 1) % 10 AS INTEGER) AS blind, place < 43 AND place NOT IN (10, 11, 12, 20) AS protected FROM p""")
def blind_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Which characters stand at each place of the customers' second lines, how often, with their values and blind classes, and whether a check digit covers the place."""
    seen = lines(spark, sf).select(F.posexplode(codec.characters(F.col("line2"))).alias("place", "c")).groupBy("place", "c").agg(F.count(F.lit(1)).alias("n"))
    return seen.select("place", "c", "n", char_value(F.col("c")).alias("value"), blind_class(F.col("c")).alias("blind"), is_protected(F.col("place")).alias("protected"))


@query(f"""WITH {SQL_LINES}, d AS (SELECT c_custkey, substr(noisy2, 14, 6) AS b, substr(noisy2, 22, 6) AS e FROM lines),
y AS (SELECT *, CASE WHEN regexp_full_match(b, '[0-9]{{6}}') THEN CAST(substr(b, 1, 2) AS INTEGER) END AS byy, CASE WHEN regexp_full_match(e, '[0-9]{{6}}') THEN CAST(substr(e, 1, 2) AS INTEGER) END AS eyy FROM d),
r AS (SELECT *, byy + CASE WHEN byy > 26 THEN 1900 ELSE 2000 END AS born, eyy + 2000 AS ends FROM y),
i AS (SELECT *, strftime(try_cast(born || '-' || substr(b, 3, 2) || '-' || substr(b, 5, 2) AS DATE), '%Y-%m-%d') AS birth_iso, strftime(try_cast(ends || '-' || substr(e, 3, 2) || '-' || substr(e, 5, 2) AS DATE), '%Y-%m-%d') AS expiry_iso FROM r)
SELECT c_custkey, born, ends, birth_iso, expiry_iso, coalesce(expiry_iso < '2026-01-01', false) AS expired FROM i""")
def date_resolution(spark: SparkSession, sf: str) -> DataFrame:
    d = lines(spark, sf).select("c_custkey", *[codec.field(F.col("line1"), F.col("noisy2"), k).alias(k) for k in ("birth_date", "expiry_date")])
    iso = d.withColumns({"birth_iso": dates.iso_date(F.col("birth_date"), REFERENCE_YEAR, True), "expiry_iso": dates.iso_date(F.col("expiry_date"), REFERENCE_YEAR, False)})
    born, ends = dates.birth_year(dates.parse_yymmdd(F.col("birth_date"))["yy"], REFERENCE_YEAR), dates.expiry_year(dates.parse_yymmdd(F.col("expiry_date"))["yy"], REFERENCE_YEAR)
    return iso.select("c_custkey", born.alias("born"), ends.alias("ends"), "birth_iso", "expiry_iso", dates.is_expired(F.col("expiry_iso"), REFERENCE_YEAR).alias("expired"))


def _found(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).select("c_custkey", "line1", F.col("noisy2").alias("line2")).withColumn("found", issues(F.col("line1"), F.col("line2"), REFERENCE_YEAR, KNOWN))


_FOUND = f"WITH {SQL_LINES}, {sql_issues('noisy2', KNOWN)}"


@query(f"{_FOUND} SELECT c_custkey, CAST(len(fields) AS INTEGER) AS n_issues, array_to_string(fields, ',') AS fields, len(fields) = 0 AS valid FROM found")
def td3_validate(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: documents made, damaged in one character, parsed and judged."""
    return _found(spark, sf).select("c_custkey", F.size("found").alias("n_issues"), F.array_join(F.transform("found", lambda x: x["field"]), ",").alias("fields"), (F.size("found") == 0).alias("valid"))


@query(f"{_FOUND} SELECT field, count(*) AS n FROM (SELECT unnest(fields) AS field FROM found) GROUP BY field")
def issue_histogram(spark: SparkSession, sf: str) -> DataFrame:
    # an outer explode, for an inner one's filter on the array would be pushed down and work every rule out again
    return _found(spark, sf).select(F.explode_outer("found").alias("i")).where("i IS NOT NULL").groupBy(F.col("i.field").alias("field")).agg(F.count(F.lit(1)).alias("n"))


_KNOWN = ", ".join(f"'{s}'" for s in KNOWN)


@query(f"WITH {SQL_IDS} SELECT c_custkey, nationality FROM ids WHERE nationality IN ({_KNOWN})")
def country_semi(spark: SparkSession, sf: str) -> DataFrame:
    return identities(spark, sf).select("c_custkey", "nationality").where(is_state(F.col("nationality"), KNOWN))


@query(f"WITH {SQL_IDS} SELECT c_custkey, nationality FROM ids WHERE nationality NOT IN ({_KNOWN})")
def country_anti(spark: SparkSession, sf: str) -> DataFrame:
    known = spark.createDataFrame([(s,) for s in KNOWN], "nationality string")
    return identities(spark, sf).select("c_custkey", "nationality").join(F.broadcast(known), "nationality", "left_anti").select("c_custkey", "nationality")


def _sql_trust(name: str) -> str:
    guard, condemning = GUARDS[name]
    failed = " OR ".join(f"list_contains(fields, '{c}')" for c in condemning) or "false"
    doubtful = {"none": "true", "checksum": "list_contains(fields, 'composite_cd')", "allowlist": "false"}[guard]
    return f"SELECT c_custkey, '{name}' AS key, CASE WHEN {failed} THEN 'failed' WHEN {doubtful} THEN 'unverified' ELSE 'verified' END AS status FROM found"


@query(f"{_FOUND} {' UNION ALL '.join(_sql_trust(k) for k in GUARDS)}")
def field_status(spark: SparkSession, sf: str) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(k).alias("key"), trust(k, F.col("found")).alias("status")) for k in GUARDS])
    return _found(spark, sf).select("c_custkey", F.inline_outer(rows))


_ISO = lambda raw, year: f"strftime(try_cast(CASE WHEN regexp_full_match({raw}, '[0-9]{{6}}') THEN ({year}) || '-' || substr({raw}, 3, 2) || '-' || substr({raw}, 5, 2) END AS DATE), '%Y-%m-%d')"
_YY = lambda raw: f"try_cast(substr({raw}, 1, 2) AS INTEGER)"
_SHOWN = lambda raw: f"trim(replace({raw}, '<', ' '))"
_NAME = "rtrim(substr(line1, 6, 39), '<')"
_VALUES = {
    **{k: _SHOWN(sql_field(k)) for k in GUARDS if k in LAYOUT},
    "primary_name": _SHOWN(f"CASE WHEN instr({_NAME}, '<<') > 0 THEN substr({_NAME}, 1, instr({_NAME}, '<<') - 1) ELSE {_NAME} END"),
    "secondary_name": f"CASE WHEN instr({_NAME}, '<<') > 0 THEN {_SHOWN(f'substr({_NAME}, instr({_NAME}, chr(60) || chr(60)) + 2)')} ELSE '' END",
}
_DATES = {"birth_date": _ISO(sql_field("birth_date"), f"{_YY(sql_field('birth_date'))} + CASE WHEN {_YY(sql_field('birth_date'))} > 26 THEN 1900 ELSE 2000 END"), "expiry_date": _ISO(sql_field("expiry_date"), f"{_YY(sql_field('expiry_date'))} + 2000")}


@query(f"""{_FOUND}, statuses AS ({' UNION ALL '.join(_sql_trust(k) for k in GUARDS)}),
vals AS ({' UNION ALL '.join(f"SELECT c_custkey, '{k}' AS key, {_VALUES[k]} AS raw, coalesce({_DATES.get(k, 'NULL')}, {_VALUES[k]}) AS value, '{GUARDS[k][0]}' AS guard FROM found" for k in GUARDS)})
SELECT c_custkey, key, raw, value, guard, status, len(fields) = 0 AS valid, CAST(len(fields) AS INTEGER) AS n_issues, NOT list_contains(fields, 'composite_cd') AS composite_ok, coalesce({_DATES['expiry_date']} < '2026-01-01', false) AS expired, line1 || line2 AS both_lines
FROM vals JOIN statuses USING (c_custkey, key) JOIN found USING (c_custkey)""")
def payload_json(spark: SparkSession, sf: str) -> DataFrame:
    """The JSON payload, read back: a row for each field, with what holds for the whole document."""
    made = payload.as_payload(lines(spark, sf).select("c_custkey", "line1", F.col("noisy2").alias("line2")), REFERENCE_YEAR, KNOWN)
    shape = "valid boolean, mrz struct<line1:string,line2:string>, fields array<struct<key:string,value:string,raw:string,guard:string,status:string>>, issues array<struct<field:string>>, composite_ok boolean, expired boolean"
    back = made.select("c_custkey", F.from_json("payload", shape).alias("p"))
    whole = [F.col("p.valid"), F.size("p.issues").alias("n_issues"), F.col("p.composite_ok"), F.col("p.expired"), F.concat("p.mrz.line1", "p.mrz.line2").alias("both_lines")]
    return back.select("c_custkey", *whole, F.inline_outer("p.fields"))


@query(f"""WITH s AS (SELECT c_custkey, pos, cls, {sql_pseudo("score", "c_custkey", "pos", "cls")} % 50 AS v FROM customer, range(0, 6) p(pos), range(0, 5) c(cls)),
b AS (SELECT c_custkey, pos, arg_min(cls, -v * 100 + cls) AS cls FROM s GROUP BY c_custkey, pos)
SELECT c_custkey, string_agg(substr('{ALPHABET}', CAST(cls AS INTEGER) + 1, 1), '' ORDER BY pos) AS text FROM b GROUP BY c_custkey""")
def greedy_line(spark: SparkSession, sf: str) -> DataFrame:
    scores = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda p: F.transform(F.sequence(F.lit(0), F.lit(4)), lambda c: F.pmod(pseudo("score", F.col("c_custkey"), p, c), F.lit(50))))
    return table(spark, sf, "customer").select("c_custkey", scores.alias("s")).select("c_custkey", kbest.text_of(kbest.greedy(F.col("s"))).alias("text"))


_COST = lambda p, c: f"{sql_pseudo('cost', 'c_custkey', str(p), c)} % 40"


@query(f"""WITH paths AS (SELECT c_custkey, {" + ".join(f"({_COST(p, f'c{p}')})" for p in range(4))} AS cost, {" || ',' || ".join(f"CAST(c{p} AS VARCHAR)" for p in range(4))} AS path FROM customer, {", ".join(f"range(0, 3) r{p}(c{p})" for p in range(4))}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY cost, path) AS rank FROM paths)
SELECT c_custkey, CAST(rank AS INTEGER) AS rank, cost, path FROM ranked WHERE rank <= 8""")
def kbest_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The eight cheapest of all choices at every position, by the fold."""
    costs = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda p: F.transform(F.sequence(F.lit(0), F.lit(2)), lambda c: F.pmod(pseudo("cost", F.col("c_custkey"), p, c), F.lit(40))))
    best = spread(table(spark, sf, "customer").select("c_custkey"), "c_custkey").select("c_custkey", costs.alias("s")).select("c_custkey", kbest.k_best(F.col("s"), 8, "long").alias("b"))
    return best.select("c_custkey", F.posexplode_outer("b").alias("rank", "b")).select("c_custkey", (F.col("rank") + 1).alias("rank"), "b.cost", F.array_join("b.path", ",").alias("path"))


@query(f"""{_FOUND}, clean AS (SELECT c_custkey, line1, line2 FROM lines), tried AS (
  SELECT f.c_custkey, 0 AS place, f.line2, len(list_filter(f.fields, lambda x: x NOT IN ('document_code', 'issuing_state'))) AS n FROM found f
  UNION ALL SELECT c.c_custkey, 1, c.line2, len(list_filter(g.fields, lambda x: x NOT IN ('document_code', 'issuing_state'))) FROM clean c JOIN clean_found g USING (c_custkey))
SELECT c_custkey, arg_min(line2, n * 10 + place) AS line2, CAST(min(n) AS INTEGER) AS n_issues FROM tried GROUP BY c_custkey""".replace("clean AS (", f"{sql_issues('line2', KNOWN).replace('parts AS', 'cparts AS').replace('FROM parts', 'FROM cparts').replace('dated AS', 'cdated AS').replace('FROM dated', 'FROM cdated').replace('years AS', 'cyears AS').replace('FROM years', 'FROM cyears').replace('found AS', 'clean_found AS')}, clean AS ("))
def best_reading(spark: SparkSession, sf: str) -> DataFrame:
    """Of two readings of line 2, the damaged one likelier, the one that breaks fewer rules."""
    both = lines(spark, sf).withColumn("c", F.array(*[F.struct(F.col(k).alias("text"), F.lit(-p).alias("log_prob")) for k, p in (("noisy2", 0.1), ("line2", 2.0))]))
    best = both.select("c_custkey", kbest.best_of(F.col("c"), lambda t: line2_issues(t, REFERENCE_YEAR, KNOWN)).alias("b"))
    return best.select("c_custkey", F.col("b.text").alias("line2"), "b.n_issues")


_OWN2 = "len(list_filter(fields, lambda x: x NOT IN ('document_code', 'issuing_state')))"
_CLEAN_FOUND = reduce(lambda sql, name: sql.replace(f"{name} AS (", f"c{name} AS (").replace(f"FROM {name})", f"FROM c{name})"), ("parts", "dated", "years", "found"), sql_issues("line2", KNOWN))


@query(f"""{_FOUND}, {_CLEAN_FOUND}, seconds AS (
  SELECT c_custkey, 0 AS place2, line2, {_OWN2} AS n2, 0.25 AS cost2 FROM found UNION ALL SELECT c_custkey, 1, line2, {_OWN2}, 2.0 FROM cfound UNION ALL SELECT c_custkey, 2, replace(line2, '<', ' '), 0, 3.0 FROM cfound),
firsts AS (SELECT c_custkey, place1, cost1, CASE place1 WHEN 0 THEN substr(line1, 1, 43) WHEN 1 THEN 'V' || substr(line1, 2) WHEN 2 THEN line1 ELSE lower(line1) END AS line1 FROM lines, (VALUES (0, 0.125), (1, 0.5), (2, 1.0), (3, 4.0)) t(place1, cost1)),
judged AS (SELECT *, CAST(NOT starts_with(line1, 'P') AS INTEGER) + CAST(rtrim(substr(line1, 3, 3), '<') NOT IN ({", ".join(f"'{s}'" for s in KNOWN)}) AS INTEGER) AS n1 FROM firsts WHERE regexp_full_match(line1, '[A-Z0-9<]{{44}}')),
paired AS (SELECT *, n1 + n2 AS n, cost1 + cost2 AS cost FROM judged JOIN seconds USING (c_custkey) WHERE regexp_full_match(line2, '[A-Z0-9<]{{44}}'))
SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY n, cost, place1, place2) AS INTEGER) AS rank, CAST(n AS INTEGER) AS n_issues, CAST(-cost AS DOUBLE) AS log_prob, line1, line2 FROM paired""")
def reading_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """All pairings of four readings of line 1, one torn and one in small letters, with three of line 2, one with blanks: what can't be parsed pairs with nothing."""
    told = lambda *c: F.array(*[F.struct(text.alias("text"), F.lit(p).alias("log_prob")) for text, p in c])
    l1, l2 = F.col("line1"), F.col("line2")
    first = told((F.substr(l1, F.lit(1), F.lit(43)), -0.125), (F.concat(F.lit("V"), F.substr(l1, F.lit(2))), -0.5), (l1, -1.0), (F.lower(l1), -4.0))
    second = told((F.col("noisy2"), -0.25), (l2, -2.0), (F.translate(l2, "<", " "), -3.0))
    both = spread(lines(spark, sf), "c_custkey").select("c_custkey", first.alias("one"), second.alias("two"))
    pairs = kbest.pairings(F.col("one"), F.col("two"), lambda t: line1_issues(t, KNOWN), lambda t: line2_issues(t, REFERENCE_YEAR, KNOWN))
    found = both.select("c_custkey", F.posexplode_outer(pairs).alias("rank", "p"))
    return found.select("c_custkey", (F.col("rank") + 1).alias("rank"), "p.n_issues", (-F.col("p.cost")).alias("log_prob"), "p.line1", "p.line2")


@query(f"{_FOUND} SELECT c_custkey, len(list_filter(fields, lambda x: x IN ('document_code', 'issuing_state'))) = 0 AS line1_fine FROM found")
def line1_fine(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).select("c_custkey", (F.size(line1_issues(F.col("line1"), KNOWN)) == 0).alias("line1_fine"))


_CLASS = lambda p: f"(instr('{ALPHABET}', substr(line2, {p} + 1, 1)) - 1)"


@query(f"""WITH {SQL_LINES}, live AS (SELECT c_custkey, line2, p, CASE WHEN {_CLASS('p')} = 36 THEN 0 ELSE {_CLASS('p')} + 1 END AS other, 1 + {sql_pseudo("gap", "c_custkey", "p")} % 900 AS gap FROM lines, (VALUES (3), (17), (25), (40)) t(p)),
paths AS (SELECT c_custkey, line2, m, sum(CASE WHEN (m >> i) & 1 = 1 THEN gap ELSE 0 END) AS cost, list(struct_pack(p := p, c := other) ORDER BY p) FILTER ((m >> i) & 1 = 1) AS changed
  FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY p) - 1 AS i FROM live), range(0, 16) r(m) GROUP BY c_custkey, line2, m),
texts AS (SELECT c_custkey, cost, list_reduce(list_prepend(line2, list_transform(coalesce(changed, []), lambda x: substr('{ALPHABET}', x.c + 1, 1) || CAST(x.p AS VARCHAR))), lambda t, x: substr(t, 1, CAST(substr(x, 2) AS INTEGER)) || substr(x, 1, 1) || substr(t, CAST(substr(x, 2) AS INTEGER) + 2)) AS text, line2 FROM paths),
ranked AS (SELECT c_custkey, cost, text, row_number() OVER (PARTITION BY c_custkey ORDER BY cost, list_transform(range(1, 45), lambda i: instr('{ALPHABET}', substr(text, i, 1)))) AS rank FROM texts)
SELECT c_custkey, CAST(rank AS INTEGER) AS rank, CAST(cost AS BIGINT) AS cost, text FROM ranked WHERE rank <= 8""")
def kbest_full(spark: SparkSession, sf: str) -> DataFrame:
    """The eight cheapest readings of line 2 at full width, 44 places of 37 classes: at four places another class is nearly as cheap as the right one, anywhere else all others are out of reach."""
    own = lambda p: F.instr(F.lit(ALPHABET), F.substr(F.col("line2"), p + 1, F.lit(1))) - 1
    far = F.array_repeat(F.lit(100_000).cast("long"), len(ALPHABET))
    put = lambda costs, at, value: F.concat(F.slice(costs, F.lit(1), at), F.array(value), F.slice(costs, at + 2, len(ALPHABET) - 1 - at))

    def costs(p):
        sure = lambda c: put(far, c, F.lit(0).cast("long"))
        gap = 1 + F.pmod(pseudo("gap", F.col("c_custkey"), p), F.lit(900))
        return kbest.bound(own(p), lambda c: F.when(p.isin(3, 17, 25, 40), put(sure(c), F.pmod(c + 1, F.lit(len(ALPHABET))).cast("int"), gap)).otherwise(sure(c)))

    scores = spread(lines(spark, sf), "c_custkey").select("c_custkey", F.transform(F.sequence(F.lit(0), F.lit(43)), costs).alias("s"))
    best = scores.select("c_custkey", F.posexplode(kbest.k_best_texts(F.col("s"), 8, "long")).alias("rank", "b"))
    return best.select("c_custkey", (F.col("rank") + 1).alias("rank"), "b.cost", "b.text")


@query("""WITH c AS (SELECT DISTINCT unnest(string_split(p_name || p_brand || upper(p_type) || '<', '')) AS c FROM part) SELECT c, regexp_full_match(c, '[A-Z0-9<]') AS known FROM c""")
def alphabet_test(spark: SparkSession, sf: str) -> DataFrame:
    """Every character of the parts' names, and whether it is in the alphabet."""
    text = F.concat("p_name", "p_brand", F.upper("p_type"), F.lit("<"))
    found = table(spark, sf, "part").select(F.explode_outer(codec.characters(text)).alias("c")).distinct()
    return found.select("c", is_mrz_char(F.col("c")).alias("known"))


_SPECIAL = ", ".join(f"'{s}'" for s in SPECIAL_STATES)


@query(f"""WITH {SQL_IDS}, c AS (SELECT unnest(['issuing_state', 'nationality']) AS field, unnest([issuing_state, nationality]) AS code FROM ids)
SELECT field, code, CASE WHEN code IN ({_SPECIAL}) THEN 'special' WHEN code = 'QQQ' THEN 'unknown' ELSE 'iso' END AS kind, code <> 'QQQ' AS accepted, count(*) AS n, CAST(249 AS BIGINT) AS iso, CAST(265 AS BIGINT) AS known FROM c GROUP BY ALL""")
def state_sets(spark: SparkSession, sf: str) -> DataFrame:
    """The codes of the customers' documents: whether each is of the standard, a special one or unknown, by joins with both sets, and whether it is accepted; and how many codes the standard and both sets hold."""
    kinds = spark.createDataFrame([(s, "iso") for s in iso_states(spark)] + [(s, "special") for s in SPECIAL_STATES], "code string, kind string")
    sizes = kinds.agg(F.count_if(F.col("kind") == "iso").alias("iso"), F.countDistinct("code").alias("known"), F.lit(1).alias("_one"))
    codes = identities(spark, sf).select(F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("code")) for c in ("issuing_state", "nationality")]))).groupBy("field", "code").agg(F.count(F.lit(1)).alias("n"))
    named = codes.join(F.broadcast(kinds), "code", "left").withColumn("_one", F.lit(1)).join(F.broadcast(sizes), "_one")
    return named.select("field", "code", F.coalesce("kind", F.lit("unknown")).alias("kind"), is_state(F.col("code"), [*iso_states(spark), *SPECIAL_STATES]).alias("accepted"), "n", "iso", "known")
