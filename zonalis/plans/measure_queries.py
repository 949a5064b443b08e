"""Queries over grading, reconciliation, profiles, geometry, generation and monitoring, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from zonalis.functions import codec, geometry, kbest
from zonalis.functions.alphabet import ALPHABET
from zonalis.functions.validate import issues
from zonalis.operators import measure, reading
from zonalis.plans.inputs import KNOWN, REFERENCE_YEAR, SQL_LINES, STATES, lines, pseudo, sql_field, sql_issues, sql_pseudo, table, work_folder
from zonalis.sources import identities as synthetic
from zonalis.sources import status
from zonalis.streaming import monitor

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def graded(spark: SparkSession, sf: str) -> DataFrame:
    """(c_custkey, severity, truth1, truth2, greedy1, greedy2, decoded1, decoded2): the greedy reading is the damaged line; decoding repairs every third document and spoils every eleventh."""
    df = lines(spark, sf)
    key = F.col("c_custkey")
    repaired = F.when(F.pmod(key, F.lit(3)) == 0, F.col("line2")).otherwise(F.col("noisy2"))
    spoiled1 = F.when(F.pmod(key, F.lit(11)) == 0, F.concat(F.lit("V"), F.substr("line1", F.lit(2)))).otherwise(F.col("line1"))
    greedy2 = F.when(F.pmod(key, F.lit(5)) == 0, F.col("line2")).otherwise(F.col("noisy2"))
    return df.select("c_custkey", (F.pmod(pseudo("severity", key), F.lit(1001)) / 1000.0).alias("severity"), F.col("line1").alias("truth1"), F.col("line2").alias("truth2"), F.col("line1").alias("greedy1"), greedy2.alias("greedy2"), spoiled1.alias("decoded1"), repaired.alias("decoded2"))


_GRADED = f"""WITH {SQL_LINES}, graded AS (SELECT c_custkey, ({sql_pseudo("severity", "c_custkey")} % 1001) / 1000.0 AS severity, line1 AS truth1, line2 AS truth2, line1 AS greedy1,
CASE WHEN c_custkey % 5 = 0 THEN line2 ELSE noisy2 END AS greedy2, CASE WHEN c_custkey % 11 = 0 THEN 'V' || substr(line1, 2) ELSE line1 END AS decoded1, CASE WHEN c_custkey % 3 = 0 THEN line2 ELSE noisy2 END AS decoded2 FROM lines)"""
_COUNTS = "count(*) AS documents, count(*) FILTER ({0}1 = truth1) AS line1, count(*) FILTER ({0}2 = truth2) AS line2, count(*) FILTER ({0}1 = truth1 AND {0}2 = truth2) AS \"both\""


@query(f"""{_GRADED}, v AS (SELECT CASE WHEN decoded1 = truth1 AND decoded2 = truth2 AND NOT (greedy1 = truth1 AND greedy2 = truth2) THEN 'repair' WHEN greedy1 = truth1 AND greedy2 = truth2 AND NOT (decoded1 = truth1 AND decoded2 = truth2) THEN 'regression' ELSE 'unchanged' END AS outcome, * FROM graded)
SELECT outcome, {_COUNTS.format("decoded")} FROM v GROUP BY outcome""")
def outcome_tally(spark: SparkSession, sf: str) -> DataFrame:
    right = lambda k: (F.col(f"{k}1") == F.col("truth1")) & (F.col(f"{k}2") == F.col("truth2"))
    df = graded(spark, sf).withColumn("outcome", measure.outcome(right("greedy"), right("decoded")))
    return measure.tally(df, "outcome", got=("decoded1", "decoded2"))


_BUCKET = "CASE WHEN severity < 0.25 THEN '0.00-0.25' WHEN severity < 0.5 THEN '0.25-0.50' WHEN severity < 0.75 THEN '0.50-0.75' ELSE '0.75-1.00' END"


@query(f"{_GRADED}, b AS (SELECT {_BUCKET} AS bucket, * FROM graded) SELECT bucket, {_COUNTS.format('greedy')} FROM b GROUP BY bucket UNION ALL SELECT 'all', {_COUNTS.format('greedy')} FROM b")
def severity_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return measure.tally_by_severity(graded(spark, sf), ("greedy1", "greedy2"))


@query(f"""{_GRADED}, c AS (SELECT c_custkey, i AS pos, substr(truth2, CAST(i AS INTEGER) + 1, 1) AS want, substr(greedy2, CAST(i AS INTEGER) + 1, 1) AS got FROM graded, range(0, 44) r(i)),
n AS (SELECT want, got, count(*) AS n, min(c_custkey * 100 + pos) AS f FROM c WHERE want <> got GROUP BY want, got) SELECT want, got, n FROM n ORDER BY n DESC, f LIMIT 8""")
def confusions_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The eight most frequent confusions: a report."""
    return measure.confusions(measure.char_pairs(graded(spark, sf), "greedy2", "truth2", "c_custkey"), ["c_custkey", "pos"], 8)


@query(f"""{_GRADED}, c AS (SELECT CAST(substr(truth2, CAST(i AS INTEGER) + 1, 1) = substr(rpad(substr(greedy2, 1, CAST(44 - c_custkey % 3 AS INTEGER)), 44, ' '), CAST(i AS INTEGER) + 1, 1) AS INTEGER) AS same FROM graded, range(0, 44) r(i)) SELECT count(*) AS chars, sum(same) AS chars_right, round(sum(same) / count(*), 6) AS rate FROM c""")
def char_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Readings up to two characters short: what is missing counts as wrong."""
    short = graded(spark, sf).withColumn("got_text", F.substr("greedy2", F.lit(1), (44 - F.pmod("c_custkey", F.lit(3))).cast("int")))
    out = measure.char_pairs(short, "got_text", "truth2", "c_custkey").agg(F.count(F.lit(1)).alias("chars"), F.count_if(F.col("want") == F.col("got")).alias("chars_right"))
    return out.withColumn("rate", F.round(measure.rate(F.col("chars_right"), F.col("chars")), 6))


_LSE = "ln(list_sum(list_transform({0}, lambda x: exp(CAST(x AS DOUBLE) - list_max({0})))))"


@query(f"SELECT vec_id, round(-(embedding[label % 64 + 1] - list_max(embedding) - {_LSE.format('embedding')}), 4) AS loss FROM (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS embedding FROM embeddings)")
def cross_entropy(spark: SparkSession, sf: str) -> DataFrame:
    logp = table(spark, sf, "embeddings").select("vec_id", "label", kbest.log_softmax(F.col("embedding").cast("array<double>")).alias("p"))
    return logp.select("vec_id", F.round(measure.cross_entropy(F.col("p"), F.pmod("label", F.lit(64))), 4).alias("loss"))


@query("SELECT doc_id, 'left_only' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT DISTINCT doc_id, 'right_only' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def reconcile_truth(spark: SparkSession, sf: str) -> DataFrame:
    return measure.reconcile(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query("SELECT conv_id, turn // 2 AS document, max(CASE WHEN turn % 2 = 0 THEN text END) AS line1, max(CASE WHEN turn % 2 = 1 THEN text END) AS line2 FROM conversations GROUP BY conv_id, turn // 2")
def pair_lines(spark: SparkSession, sf: str) -> DataFrame:
    return measure.pair_lines(table(spark, sf, "conversations"), F.col("turn"), ["conv_id"], "text")


@query(f"WITH {SQL_LINES}, c AS (SELECT substr(line1 || line2, CAST(i AS INTEGER), 1) AS c FROM lines, range(1, 89) r(i)) SELECT c, count(*) AS n FROM c GROUP BY c")
def charset_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).select(F.explode_outer(codec.characters(F.concat("line1", "line2"))).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SQL_LINES} SELECT c_custkey % 4 AS stage, count(DISTINCT line2) AS labels FROM lines GROUP BY c_custkey % 4")
def distinct_stage(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).groupBy(F.pmod("c_custkey", F.lit(4)).alias("stage")).agg(F.countDistinct("line2").alias("labels"))


@query("""WITH e AS (SELECT vec_id, i AS pos, CAST(embedding[i + 1] AS DOUBLE) AS v FROM embeddings, range(0, 64) r(i)), live AS (SELECT vec_id, pos FROM (SELECT *, max(v) OVER (PARTITION BY vec_id) AS m FROM e) WHERE v > 0.12 * m),
g AS (SELECT vec_id, pos, pos - row_number() OVER (PARTITION BY vec_id ORDER BY pos) AS island FROM live) SELECT vec_id, min(pos) AS first, max(pos) + 1 AS past FROM g GROUP BY vec_id, island HAVING max(pos) + 1 - min(pos) >= 3""")
def ink_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Stretches of three or more positions over 12 hundredths of the vector's maximum."""
    v = table(spark, sf, "embeddings").select("vec_id", F.array_max("embedding").cast("double").alias("m"), F.posexplode("embedding").alias("pos", "v"))
    return measure.runs(v.select("vec_id", F.col("pos").cast("long").alias("pos"), "v", "m"), ["vec_id"], "pos", F.col("v").cast("double") > 0.12 * F.col("m"), 3)


@query("""WITH e AS (SELECT vec_id, i AS pos, CAST(floor(CAST(embedding[i + 1] AS DOUBLE) * 10) AS BIGINT) AS y FROM embeddings, range(0, 64) r(i)),
h AS (SELECT vec_id, a AS angle, y + (pos * a) // 16 AS bin, count(*) AS n FROM e, range(0, 5) r(a) GROUP BY ALL), s AS (SELECT vec_id, angle, sum(n * n) AS sharp FROM h GROUP BY ALL)
SELECT vec_id, arg_min(angle, -sharp * 100 + angle) AS angle, CAST(max(sharp) AS BIGINT) AS sharp FROM s GROUP BY vec_id""")
def shear_sharpness(spark: SparkSession, sf: str) -> DataFrame:
    """The shear at which the row histogram is sharpest, the first of equals."""
    e = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v")).withColumn("angle", F.explode(F.sequence(F.lit(0), F.lit(4))))
    bins = e.groupBy("vec_id", "angle", (F.floor(F.col("v").cast("double") * 10) + F.floor(F.col("pos") * F.col("angle") / 16)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    sharp = bins.groupBy("vec_id", "angle").agg(F.sum(F.col("n") * F.col("n")).alias("sharp"))
    return sharp.groupBy("vec_id").agg(F.max_by("angle", F.struct("sharp", -F.col("angle"))).cast("long").alias("angle"), F.max("sharp").alias("sharp"))


@query("SELECT label, round(quantile_cont(v, 0.05), 6) AS low, round(quantile_cont(v, 0.95), 6) AS high FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) GROUP BY label")
def contrast_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings").select("label", F.explode("embedding").alias("v")).withColumn("v", F.col("v").cast("double"))
    p = measure.percentiles(v, "label", "v", [0.05, 0.95])
    return p.select("label", F.round(F.get("p", F.lit(0)), 6).alias("low"), F.round(F.get("p", F.lit(1)), 6).alias("high"))


@query("""WITH e AS (SELECT vec_id, g, list_transform(embedding[g * 8 + 1 : g * 8 + 8], lambda x: CAST(x AS DOUBLE) * 10) AS s FROM embeddings, range(0, 8) r(g)),
p AS (SELECT vec_id, 1 / list_sum(list_transform(s, lambda x: exp(x - list_max(s)))) AS top FROM e) SELECT vec_id, count(*) FILTER (round(top, 6) < 0.85) AS uncertain, round(median(top), 4) AS middle, round(min(top), 4) AS least FROM p GROUP BY vec_id""")
def uncertain_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Eight positions of eight classes a vector: those whose likeliest class is under 0.85."""
    e = table(spark, sf, "embeddings").select("vec_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda g: F.transform(F.slice("embedding", g * 8 + 1, F.lit(8)), lambda x: x.cast("double") * 10))).alias("s"))
    p = e.select("vec_id", F.exp(F.array_max(kbest.log_softmax(F.col("s")))).alias("top"))
    return p.groupBy("vec_id").agg(F.count_if(F.round("top", 6) < 0.85).alias("uncertain"), F.round(F.percentile("top", 0.5), 4).alias("middle"), F.round(F.min("top"), 4).alias("least"))


@query("""WITH b AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS l, CAST(p_size AS DOUBLE) / 2 AS t, p_size + 40.0 AS r, CAST(p_size AS DOUBLE) / 2 + 10 AS b FROM part), c AS (SELECT p_partkey, unnest([l, r, r, l]) AS x, unnest([t, t, b, b]) AS y FROM b),
m AS (SELECT p_partkey, (x + 0.125 * y + 3) / (0.0009765625 * x + 1) AS u, (0.25 * x + y - 2) / (0.0009765625 * x + 1) AS v FROM c) SELECT p_partkey, CAST(floor(min(u)) AS BIGINT) AS "left", CAST(floor(min(v)) AS BIGINT) AS top, CAST(ceil(max(u)) AS BIGINT) AS "right", CAST(ceil(max(v)) AS BIGINT) AS bottom FROM m GROUP BY p_partkey""")
def box_transform(spark: SparkSession, sf: str) -> DataFrame:
    m = F.array(*[F.lit(x) for x in (1.0, 0.125, 3.0, 0.25, 1.0, -2.0, 0.0009765625, 0.0, 1.0)])
    s = F.col("p_size").cast("double")
    return table(spark, sf, "part").select("p_partkey", geometry.transform_box(s, s / 2, s + 40.0, s / 2 + 10, m).alias("b")).select("p_partkey", "b.*")


@query("SELECT p_partkey, 0.0 AS x, CASE WHEN p_size * 20 > 500 THEN 0.0 ELSE 66.0 END AS y, p_size * 20.0 AS width, CASE WHEN p_size * 20 > 500 THEN 100.0 ELSE 34.0 END AS height FROM part")
def default_box(spark: SparkSession, sf: str) -> DataFrame:
    b = geometry.default_box(F.col("p_size") * 20, F.lit(100))
    return table(spark, sf, "part").select("p_partkey", b.alias("b")).select("p_partkey", "b.x", F.round("b.y", 6).alias("y"), "b.width", F.round("b.height", 6).alias("height"))


@query("""WITH b AS (SELECT p_partkey, CAST(least(greatest(round_even(p_size * 3.5 - 20, 0), 0), 120) AS INTEGER) AS l, CAST(least(greatest(round_even(p_size * 1.5, 0), 0), 60) AS INTEGER) AS t, CAST(least(greatest(round_even(p_size * 3.5 - 20 + 30.25, 0), 0), 120) AS INTEGER) AS r, CAST(least(greatest(round_even(p_size * 1.5 + 12.5, 0), 0), 60) AS INTEGER) AS m FROM part)
SELECT p_partkey, CASE WHEN ok THEN l END AS "left", CASE WHEN ok THEN t END AS top, CASE WHEN ok THEN r END AS "right", CASE WHEN ok THEN m END AS bottom FROM (SELECT *, r - l >= 8 AND m - t >= 8 AS ok FROM b)""")
def clamp_box(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("p_size").cast("double")
    b = geometry.clamp_box(s * 3.5 - 20, s * 1.5, F.lit(30.25), F.lit(12.5), F.lit(120), F.lit(60))
    return table(spark, sf, "part").select("p_partkey", b.alias("b")).select("p_partkey", "b.left", "b.top", "b.right", "b.bottom")


@query("SELECT p_partkey, round(111.76 * p_size * 10 / 25.4, 6) AS line_px, round(p_retailprice * 25.4 / (p_size * 10), 6) AS mm FROM part")
def page_geometry(spark: SparkSession, sf: str) -> DataFrame:
    dpi = F.col("p_size") * 10
    return table(spark, sf, "part").select("p_partkey", F.round(geometry.mm_to_px(F.lit(geometry.LINE_MM), dpi), 6).alias("line_px"), F.round(geometry.px_to_mm(F.col("p_retailprice"), dpi), 6).alias("mm"))


@query("SELECT event_id, round(CASE WHEN s < 100 THEN 0.001 * (s + 1) / 100.0 ELSE 0.0005 * (1 + cos(pi() * least((s - 100) / 900.0, 1.0))) END, 9) AS rate FROM (SELECT event_id, event_id % 1200 AS s FROM events)")
def lr_schedule(spark: SparkSession, sf: str) -> DataFrame:
    """Events as steps of runs of 1200: each step's learning rate by a schedule of 1000, which then stays at its end."""
    step = F.pmod("event_id", F.lit(1200))
    return table(spark, sf, "events").select("event_id", F.round(geometry.learning_rate(step, 1000, 0.001, 100), 9).alias("rate"))


_SECONDS = "(epoch_us(ts) / 1000000.0)"


@query(f"""SELECT event_id, round((event_id - lag(event_id) OVER w) / greatest({_SECONDS} - lag({_SECONDS}) OVER w, 1e-9), 6) AS rate FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def window_rate(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "user_id", "ts")
    rated = measure.window_rate(e, ["user_id"], ["ts", "event_id"], "event_id", measure.epoch_seconds(F.col("ts")))
    return rated.select("event_id", F.round("rate", 6).alias("rate"))


@query("SELECT user_id, round(list_reduce(list(CAST(value AS DOUBLE) ORDER BY ts, event_id), lambda a, x: 0.9 * a + 0.1 * x), 4) AS ema FROM events GROUP BY user_id")
def ema_fold(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", F.col("value").cast("double").alias("value"))
    return measure.moving_average_of(e, "user_id", ["ts", "event_id"], "value", 0.9).select("user_id", F.round("average", 4).alias("ema"))


@query("SELECT user_id, arg_max(event_type, struct_pack(ts := ts, id := event_id)) AS event_type, arg_max(event_id, struct_pack(ts := ts, id := event_id)) AS event_id FROM events GROUP BY user_id")
def latest_status(spark: SparkSession, sf: str) -> DataFrame:
    return measure.latest(table(spark, sf, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], ["event_type", "event_id"])


@query("""WITH l AS (SELECT user_id, max(ts) AS ts FROM events GROUP BY user_id) SELECT c_custkey, CASE WHEN ts IS NULL THEN 'waiting' WHEN date_diff('second', ts, (SELECT max(ts) FROM events)) > 86400 THEN 'stale' ELSE 'training' END AS state FROM customer LEFT JOIN l ON user_id = c_custkey""")
def stale_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as runs, their newest event as the last sign of life; a day of silence is stale."""
    events = table(spark, sf, "events")
    now = events.agg(F.max(F.floor(measure.epoch_seconds(F.col("ts"))))).first()[0]
    newest = monitor.newest(events.withColumn("state", F.lit("training")), "user_id", ["ts"], ["ts", "state"])
    joined = table(spark, sf, "customer").select("c_custkey").join(newest, F.col("c_custkey") == F.col("user_id"), "left")
    age = F.lit(now) - F.floor(measure.epoch_seconds(F.col("ts")))
    return joined.select("c_custkey", monitor.shown_state(F.col("state"), age, 86400).alias("state"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def status_json(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k int", {"mode": "PERMISSIVE"})["k"].alias("k"))


_D = lambda what, most: f"(CAST('0x' || substr(md5('1|{what}|' || i), 1, 8) AS BIGINT) % {most})"
_SYLLABLES = "[" + ", ".join(f"'{x}'" for x in synthetic.SYLLABLES) + "]"
_NAMED = lambda what: " || ".join(f"{_SYLLABLES}[{_D(f'{what}{k}', len(synthetic.SYLLABLES))} + 1]" for k in range(3))
_CODES = "[" + ", ".join(f"'{s}'" for s in STATES[:20]) + "]"


@query(f"""WITH g AS (SELECT c_custkey AS i FROM customer), d AS (SELECT i, {_CODES}[{_D('state', 20)} + 1] AS issuing_state, 2026 - {_D('age', 91)} AS born, {_D('expired', 10000)} < 1500 AS ended, {_D('bm', 12)} + 1 AS bm, {_D('bd', 28)} + 1 AS bd, {_D('ey', 1000)} AS ey, {_D('unstated', 10000)} < 300 AS u, {_D('sex', 2)} AS s, {_D('bare', 10000)} < 4500 AS bare, {_D('moved', 10000)} < 500 AS moved, {_D('nation', 20)} AS nation, {_D('long', 10000)} < 800 AS long, {_D('pattern', 6)} AS pattern, {_NAMED('surnamea')} AS surname, {_NAMED('surnameb')} AS second FROM g),
l AS (SELECT *, greatest(born + 1, CASE WHEN ended THEN 2011 ELSE 2026 END) AS low FROM d), h AS (SELECT *, greatest(low, CASE WHEN ended THEN 2025 ELSE 2036 END) AS high FROM l)
SELECT i AS index, issuing_state, lpad(CAST(born % 100 AS VARCHAR), 2, '0') || lpad(CAST(bm AS VARCHAR), 2, '0') || lpad(CAST(bd AS VARCHAR), 2, '0') AS birth_date, CASE WHEN u THEN '<' WHEN s = 0 THEN 'M' ELSE 'F' END AS sex, CAST(low + ey % (high - low + 1) AS INTEGER) % 100 AS expiry_yy, bare, CASE WHEN moved THEN {_CODES}[nation + 1] ELSE issuing_state END AS nationality, CASE WHEN long THEN surname || '-' || second ELSE surname END AS primary_name, CAST(pattern % 3 AS INTEGER) AS letters, CAST(8 + pattern // 3 AS INTEGER) AS size FROM h""")
def identity_generate(spark: SparkSession, sf: str) -> DataFrame:
    """As many identities as customers, whose keys number them."""
    n = table(spark, sf, "customer").agg(F.min("c_custkey"), F.max("c_custkey")).first()
    made = synthetic.random_identities(spark, n[1] - n[0] + 1, 1, states=list(STATES[:20]), start=n[0])
    number = [F.length(F.regexp_extract("document_number", r"\A([A-Z]*)[0-9]+\z", 1)).alias("letters"), F.length("document_number").alias("size")]
    return made.select("index", "issuing_state", "birth_date", "sex", F.substring("expiry_date", 1, 2).cast("int").alias("expiry_yy"), (F.col("optional_data") == "").alias("bare"), "nationality", "primary_name", *number)


_STAGES = "(VALUES (0, 'clean', 0.05, 0, 2000, 1), (1, 'light', 0.35, 2000, 8000, 104730), (2, 'moderate', 0.65, 8000, 18000, 209459), (3, 'heavy', 1.0, 18000, 38000, 314188)) t(stage_index, stage, high, first_step, past_step, seed)"


@query(f"SELECT stage_index, stage, high, first_step, past_step, seed, count(event_id) AS n_steps, min(event_id) AS first_event FROM {_STAGES} LEFT JOIN events ON event_id * 7 % 40000 >= first_step AND event_id * 7 % 40000 < past_step GROUP BY ALL")
def curriculum_plan(spark: SparkSession, sf: str) -> DataFrame:
    """The stages of a curriculum, and how many of the events' steps each of them has."""
    stages = synthetic.curriculum(spark).select("stage_index", "stage", "high", "first_step", "past_step", "seed")
    steps = table(spark, sf, "events").select("event_id", F.pmod(F.col("event_id") * 7, F.lit(40000)).alias("step"))
    own = synthetic.stage_of(steps, stages).groupBy("stage_index").agg(F.count(F.lit(1)).alias("n_steps"), F.min("event_id").alias("first_event"))
    return stages.join(own, "stage_index", "left").withColumn("n_steps", F.coalesce("n_steps", F.lit(0)))


@query(ORACLE_SQL["latest_status"])
def status_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The newest event of every user from the table read as a stream of files, until none is left."""
    source = table(spark, sf, "events")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/events.parquet*")
    newest = monitor.newest(stream, "user_id", ["ts", "event_id"], ["event_type", "event_id"])
    return spark.read.parquet(monitor.keep_snapshot(newest, work_folder(spark)))




_SHORT = "CASE WHEN c_custkey % 13 = 0 THEN '' ELSE substr({0}2, 1, CAST(44 - c_custkey % 3 AS INTEGER)) END"
_READ = f"""{_GRADED}, read AS (SELECT c_custkey, c_custkey % 4 AS cut, severity, truth1 AS line1, truth2 AS line2, CASE WHEN c_custkey % 13 = 0 THEN '' ELSE decoded1 END AS got1, {_SHORT.format('decoded')} AS got2, c_custkey % 13 <> 0 AND c_custkey % 7 <> 0 AS located FROM graded),
places AS (SELECT c_custkey, cut, CAST(i AS INTEGER) AS pos, substr(line1 || line2, CAST(i AS INTEGER) + 1, 1) AS want, substr(rpad(got1, 44, ' ') || rpad(got2, 44, ' '), CAST(i AS INTEGER) + 1, 1) AS got FROM read, range(0, 88) r(i)),
chars AS (SELECT c_custkey, count(*) FILTER (want = got) AS right_chars FROM places GROUP BY c_custkey)"""
_MEASURED = """count(*) AS documents, count(*) FILTER (got1 = line1 AND got2 = line2) AS documents_read, count(*) FILTER (got1 = line1) + count(*) FILTER (got2 = line2) AS lines_read, CAST(sum(right_chars) AS BIGINT) AS chars_read, count(*) * 88 AS chars_total, count(*) FILTER (NOT located) AS not_located"""


def readings(spark: SparkSession, sf: str) -> DataFrame:
    """Readings of the graded customers against the truth: every thirteenth wasn't read at all, some are cut short, some weren't located."""
    key = F.col("c_custkey")
    g = graded(spark, sf)
    truth = g.select("c_custkey", F.pmod(key, F.lit(4)).alias("cut"), "severity", F.col("truth1").alias("line1"), F.col("truth2").alias("line2"))
    read = g.where(F.pmod(key, F.lit(13)) != 0).select("c_custkey", F.col("decoded1").alias("line1"), F.substr("decoded2", F.lit(1), (44 - F.pmod(key, F.lit(3))).cast("int")).alias("line2"), (F.pmod(key, F.lit(7)) != 0).alias("banded"))
    return reading.against_truth(read, truth, "c_custkey")


@query(f"{_READ} SELECT {_MEASURED}, round(documents_read / documents, 9) AS document_rate, round(lines_read / (2 * documents), 9) AS line_rate, round(chars_read / chars_total, 9) AS char_rate FROM read JOIN chars USING (c_custkey)")
def measured_readings(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(reading.measured(readings(spark, sf)))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in ("document_rate", "line_rate", "char_rate")})


@query(f"{_READ} SELECT cut, {_MEASURED}, round(documents_read / documents, 9) AS document_rate, round(lines_read / (2 * documents), 9) AS line_rate, round(chars_read / chars_total, 9) AS char_rate FROM read JOIN chars USING (c_custkey) GROUP BY cut")
def cut_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """The same for each cut of type that documents are set in."""
    return _rounded(reading.measured(readings(spark, sf), "cut"))


@query(f"{_READ} SELECT c_custkey FROM read WHERE NOT (got1 = line1 AND got2 = line2) ORDER BY c_custkey")
def missed_documents(spark: SparkSession, sf: str) -> DataFrame:
    return reading.missed(readings(spark, sf), "c_custkey")


@query(f"""{_READ}, n AS (SELECT want, got, count(*) AS n, min(c_custkey * 100 + pos) AS f FROM places WHERE want <> got AND got <> ' ' GROUP BY want, got), top AS (SELECT want, got, n FROM n ORDER BY n DESC, f LIMIT 8),
whole AS (SELECT {_MEASURED} FROM read JOIN chars USING (c_custkey)) SELECT documents, documents_read, lines_read, not_located, round(chars_read / chars_total, 9) AS char_rate, round(documents_read / documents, 9) AS document_rate, want, got, n AS "count", false AS shows_text FROM whole, top""")
def withheld_payload(spark: SparkSession, sf: str) -> DataFrame:
    """What may be shown of a measurement, read back: counts and the eight most frequent confusions. shows_text: whether four letters or fillers in a row stand in it."""
    made = reading.withheld(readings(spark, sf), "c_custkey")
    shape = "documents long, documents_read long, lines_read long, not_located long, char_rate double, document_rate double, confusions array<struct<want:string,got:string,count:long>>"
    back = made.select(F.from_json("payload", shape).alias("p"), F.regexp_like("payload", F.lit("[A-Z<]{4}")).alias("shows_text")).select("p.*", "shows_text")
    out = back.withColumns({c: F.round(c, 9) for c in ("char_rate", "document_rate")})
    return out.select(*[c for c in out.columns if c != "confusions"], F.inline("confusions"))


_PERCENT = lambda x: f"printf('%.2f%%', 100.0 * ({x}))"


@query(f"""{_READ}, m AS (SELECT cut, {_MEASURED} FROM read JOIN chars USING (c_custkey) GROUP BY cut) SELECT cut, array_to_string(list_filter([CASE WHEN not_located > 0 THEN not_located || ' of ' || documents || ' not located, which tells nothing of the reader' END, 'documents ' || documents_read || '/' || documents, 'lines ' || lines_read || '/' || 2 * documents,
'characters ' || chars_read || '/' || chars_total || ' ' || {_PERCENT('chars_read / chars_total')}, CASE WHEN documents < 30 THEN documents || ' documents are too few for a percentage' END], lambda x: x IS NOT NULL), chr(10)) AS report FROM m""")
def reading_report(spark: SparkSession, sf: str) -> DataFrame:
    return reading.measured(readings(spark, sf), "cut").select("cut", reading.report().alias("report"))


@query(f"""{_GRADED}, b AS (SELECT {_BUCKET} AS bucket, greedy2 = truth2 AS g, decoded2 = truth2 AS d FROM graded) SELECT bucket, count(*) AS documents, count(*) FILTER (g) AS greedy, count(*) FILTER (d) AS decoded, count(*) FILTER (d AND NOT g) AS repairs, count(*) FILTER (g AND NOT d) AS regressions,
round(count(*) FILTER (d) / count(*) - count(*) FILTER (g) / count(*), 9) AS gain FROM b GROUP BY bucket""")
def decoding_gain(spark: SparkSession, sf: str) -> DataFrame:
    df = measure.comparison(graded(spark, sf).withColumn("bucket", geometry.severity_bucket(F.col("severity"))), "bucket")
    return df.withColumn("gain", F.round("gain", 9))


_FIELDS = ("issuing_state", "document_number", "birth_date", "expiry_date", "sex", "nationality")


@query(f"""{_GRADED}, b AS (SELECT {_BUCKET} AS bucket, {' + '.join(f"CAST(rtrim({sql_field(k).replace('line1', 'decoded1').replace('line2', 'decoded2')}, '<') = rtrim({sql_field(k).replace('line1', 'truth1').replace('line2', 'truth2')}, '<') AS INTEGER)" for k in _FIELDS)} AS hit FROM graded)
SELECT bucket, count(*) AS documents, CAST(sum(hit) AS BIGINT) AS hits, count(*) * 6 AS fields, round(sum(hit) / (count(*) * 6), 9) AS hit_rate FROM b GROUP BY bucket""")
def severity_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Fields read right, fillers at their end aside, by severity."""
    g = graded(spark, sf).withColumn("bucket", geometry.severity_bucket(F.col("severity")))
    pairs = {k: (codec.field(F.col("decoded1"), F.col("decoded2"), k), codec.field(F.col("truth1"), F.col("truth2"), k)) for k in _FIELDS}
    return reading.field_hits(g, pairs, "bucket").withColumn("hit_rate", F.round("hit_rate", 9))


@query(f"""WITH e AS (SELECT vec_id, g, list_transform(embedding[g * 8 + 1 : g * 8 + 8], lambda x: CAST(x AS DOUBLE)) AS s, (vec_id + g) % 8 AS want FROM embeddings, range(0, 8) r(g)),
p AS (SELECT vec_id, list_position(s, list_max(s)) - 1 = want AS ok, -(s[want + 1] - list_max(s) - {_LSE.format('s')}) AS loss FROM e), l AS (SELECT vec_id, bool_and(ok) AS whole, count(*) FILTER (ok) AS n, sum(loss) AS loss FROM p GROUP BY vec_id)
SELECT count(*) AS lines, round(sum(n) / (8 * count(*)), 9) AS char_accuracy, round(count(*) FILTER (whole) / count(*), 9) AS line_accuracy, round(sum(loss) / (8 * count(*)), 6) AS loss FROM l""")
def batch_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Eight places of eight classes a vector as a line."""
    places = F.sequence(F.lit(0), F.lit(7))
    df = table(spark, sf, "embeddings").select(F.transform(places, lambda g: F.slice(F.col("embedding").cast("array<double>"), g * 8 + 1, F.lit(8))).alias("scores"), F.transform(places, lambda g: F.pmod(F.col("vec_id") + g, F.lit(8)).cast("int")).alias("labels"))
    return measure.accuracy(df).select("lines", F.round("char_accuracy", 9).alias("char_accuracy"), F.round("line_accuracy", 9).alias("line_accuracy"), F.round("loss", 6).alias("loss"))


@query("""WITH e AS (SELECT vec_id, label, -(embedding[label % 64 + 1] - list_max(embedding) - """ + _LSE.format("embedding") + """) AS own, embedding, list_max(embedding) AS m FROM (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS embedding FROM embeddings))
SELECT vec_id, round(0.9 * own - 0.1 * (list_sum(embedding) / 64 - m - """ + _LSE.format("embedding") + """), 4) AS loss FROM e""")
def smoothed_cross_entropy(spark: SparkSession, sf: str) -> DataFrame:
    logp = table(spark, sf, "embeddings").select("vec_id", "label", kbest.log_softmax(F.col("embedding").cast("array<double>")).alias("p"))
    return logp.select("vec_id", F.round(measure.cross_entropy(F.col("p"), F.pmod("label", F.lit(64)), 0.1), 4).alias("loss"))


@query(f"WITH {SQL_LINES}, c AS (SELECT DISTINCT substr(line2, CAST(i AS INTEGER), 1) AS c FROM lines, range(1, 45) r(i)) SELECT a AS c FROM (SELECT unnest(string_split('{ALPHABET}', '')) AS a) WHERE a NOT IN (SELECT c FROM c)")
def charset_missing(spark: SparkSession, sf: str) -> DataFrame:
    """Characters of the alphabet that no line 2 holds."""
    seen = lines(spark, sf).select(F.explode_outer(codec.characters(F.col("line2"))).alias("c")).distinct()
    return spark.createDataFrame([(c,) for c in ALPHABET], "c string").join(seen, "c", "left_anti")


@query(f"""SELECT event_id, step, stage_index, stage, step > 0 AND step % 100 = 0 AS logs, step > 0 AND step % 1000 = 0 AS evaluates, step > 0 AND step % 5000 = 0 AS measures FROM (SELECT event_id, event_id * 25 % 40000 AS step FROM events) JOIN {_STAGES} ON step >= first_step AND step < past_step""")
def step_stage(spark: SparkSession, sf: str) -> DataFrame:
    """Events as steps of a run: the stage of each, and what is due at it."""
    steps = table(spark, sf, "events").select("event_id", F.pmod(F.col("event_id") * 25, F.lit(40000)).alias("step"))
    return synthetic.with_cadence(synthetic.stage_of(steps, synthetic.curriculum(spark)))


@query(f"""WITH p AS (SELECT event_id, user_id, {_SECONDS} AS s, (event_id - lag(event_id) OVER w) / greatest({_SECONDS} - lag({_SECONDS}) OVER w, 1e-9) AS rate, min({_SECONDS}) OVER (PARTITION BY user_id) AS began FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT event_id, round(rate, 6) AS rate, round(s - began, 6) AS elapsed, CASE WHEN rate > 0 THEN round((2000000 - event_id) / rate, 0) END AS eta FROM p""")
def run_progress(spark: SparkSession, sf: str) -> DataFrame:
    """Users as runs, their event numbers as steps of two million."""
    e = table(spark, sf, "events").select("event_id", "user_id", "ts")
    out = measure.progress(e, ["user_id"], "event_id", measure.epoch_seconds(F.col("ts")), F.lit(2_000_000))
    return out.select("event_id", F.round("rate", 6).alias("rate"), F.round("elapsed", 6).alias("elapsed"), F.round("eta", 0).alias("eta"))


@query(f"""WITH g AS (SELECT c_custkey AS i FROM customer), d AS (SELECT 2026 - {_D('age', 91)} AS born, {_D('expired', 10000)} < 1500 AS ended, {_D('unstated', 10000)} < 300 AS unstated, {_D('bare', 10000)} < 4500 AS bare, {_D('long', 10000)} < 800 AS long, {_D('one', 10000)} < 3500 AS one FROM g)
SELECT count(*) AS n, round(avg(CAST(bare AS INTEGER)), 6) AS bare, round(avg(CAST(unstated AS INTEGER)), 6) AS unstated, round(avg(CAST(NOT long AND one AS INTEGER)), 6) AS one_given, round(avg(CAST(long AS INTEGER)), 6) AS long_name FROM d""")
def event_rates(spark: SparkSession, sf: str) -> DataFrame:
    """How often what is drawn with a stated chance happens among identities that the customers' keys number."""
    made = synthetic.identities_of(table(spark, sf, "customer").select(F.col("c_custkey").alias("index")), 1, states=list(STATES[:20]))
    share = lambda c, name: F.round(F.avg(c.cast("int")), 6).alias(name)
    long, one = F.contains("primary_name", F.lit("-")), ~F.contains("secondary_name", F.lit(" "))
    return made.agg(F.count(F.lit(1)).alias("n"), share(F.col("optional_data") == "", "bare"), share(F.col("sex") == "<", "unstated"), share(one & ~long, "one_given"), share(long, "long_name"))


@query(f"""SELECT event_id, event_type = 'view' AS known, CAST(json_extract(props, '$.k') AS INTEGER) AS step FROM events""")
def status_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Events as statuses of runs: step from their properties; read with the fixed schema, in which other keys are left out."""
    made = table(spark, sf, "events").select("event_id", "event_type", F.regexp_replace("props", '"k"', '"step"').alias("raw"))
    read = made.select("event_id", "event_type", F.from_json("raw", status.SCHEMA, {"mode": "PERMISSIVE"}).alias("s"))
    return read.select("event_id", (F.col("event_type") == "view").alias("known"), F.col("s.step").alias("step"))


_JUDGED = f"""{_GRADED}, glines AS (SELECT c_custkey, decoded1 AS line1, decoded2 AS noisy2 FROM graded), {sql_issues('noisy2', KNOWN).replace('FROM lines', 'FROM glines')},
v AS (SELECT {_BUCKET} AS bucket, decoded1 = truth1 AS a, decoded2 = truth2 AS b, len(fields) = 0 AS ok FROM graded JOIN found USING (c_custkey)),
t AS (SELECT bucket, count(*) AS documents, count(*) FILTER (a) AS line1, count(*) FILTER (b) AS line2, count(*) FILTER (a AND b) AS "both", count(*) FILTER (ok) AS validates FROM v GROUP BY bucket)"""


@query(f"""{_JUDGED} SELECT *, 'line1 ' || {_PERCENT('line1 / documents')} || '  line2 ' || {_PERCENT('line2 / documents')} || '  document ' || {_PERCENT('"both" / documents')} || '  validates ' || {_PERCENT('validates / documents')} AS report FROM t""")
def tally_report(spark: SparkSession, sf: str) -> DataFrame:
    """Tallies by severity, how many readings keep the rules included, and as text."""
    g = graded(spark, sf).withColumn("bucket", geometry.severity_bucket(F.col("severity")))
    valid = F.size(issues(F.col("decoded1"), F.col("decoded2"), REFERENCE_YEAR, KNOWN)) == 0
    return measure.tally(g.withColumn("valid", valid), "bucket", got=("decoded1", "decoded2"), valid="valid").withColumn("report", reading.tally_text())


@query("""WITH r AS (SELECT event_type AS run, (day(ts) - 1) // 3 AS turn, count(*) AS n FROM events GROUP BY ALL), s AS (SELECT run, turn, sum(n) OVER (PARTITION BY run ORDER BY turn) AS step, sum(n) OVER (PARTITION BY run) AS total FROM r)
SELECT run, CAST(step AS INTEGER) AS step, CAST(total AS INTEGER) AS total_steps, CASE WHEN step = total THEN 'finished' ELSE 'training' END AS state, CAST(1 AS BIGINT) AS seen FROM s""")
def status_rewrites(spark: SparkSession, sf: str) -> DataFrame:
    """Kinds of events as runs, their events so far as steps: every three days each run writes its one status file anew, and a stream that follows the files sees every state once. What is written is as much as there are kinds and days."""
    e = table(spark, sf, "events")
    own = Window.partitionBy("run").orderBy("turn")
    counted = e.groupBy(F.col("event_type").alias("run"), F.floor((F.dayofmonth("ts") - 1) / 3).alias("turn")).agg(F.count(F.lit(1)).alias("n"))
    steps = counted.select("run", "turn", F.sum("n").over(own).cast("int").alias("step"), F.sum("n").over(Window.partitionBy("run")).cast("int").alias("total")).collect()
    folder = work_folder(spark)
    writers = {run: status.StatusWriter(f"{folder}/runs/{run}", spark) for run in {r["run"] for r in steps}}
    stream = status.stream_status(spark, f"{folder}/runs").select(F.element_at(F.split("path", "/"), -2).alias("run"), "step", "total_steps", "state")

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/seen/batch={batch}")

    follower = stream.writeStream.option("checkpointLocation", f"{folder}/progress").foreachBatch(keep).trigger(processingTime="0 seconds").start()
    try:
        for turn in sorted({r["turn"] for r in steps}):
            for r in steps:
                if r["turn"] == turn:
                    writers[r["run"]].update(float(turn), state="finished" if r["step"] == r["total"] else "training", step=r["step"], total_steps=r["total"])
            follower.processAllAvailable()
    finally:
        follower.stop()
    shape = "run string, step int, total_steps int, state string, batch int"
    seen = spark.read.schema(shape).parquet(f"{folder}/seen") if steps else spark.createDataFrame([], shape)
    return seen.groupBy("run", "step", "total_steps", "state").agg(F.count(F.lit(1)).alias("seen"))
