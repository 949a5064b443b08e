import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from zonalis.functions import kbest
from zonalis.functions.alphabet import known_states
from zonalis.functions.geometry import model_input
from zonalis.functions.validate import issues
from zonalis.functions.codec import FIELD_ORDER, with_lines
from zonalis.operators import measure, payload
from zonalis.sources import identities, measurement, status
from zonalis.streaming import monitor


def test_k_best_is_exact(spark):
    rng = random.Random(1)
    rows = [(i, [[float(rng.randint(0, 4)) for _ in range(3)] for _ in range(4)]) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, s array<array<double>>").select("id", kbest.k_best(F.col("s"), 6).alias("b"))
    for r in df.collect():
        s = rows[r["id"]][1]
        want = sorted((sum(s[p][c] for p, c in enumerate(path)), list(path)) for path in itertools.product(range(3), repeat=4))[:6]
        assert [(b["cost"], b["path"]) for b in r["b"]] == want


def test_identities_are_valid_and_stable(spark):
    ids = identities.random_identities(spark, 600, 7)
    lines = with_lines(ids, {k: F.col(k) for k in FIELD_ORDER})
    assert lines.where("error IS NOT NULL").isEmpty()
    assert lines.select(issues(F.col("line1"), F.col("line2"), 2026, known_states(spark)).alias("i")).where("size(i) > 0").isEmpty()
    part = identities.random_identities(spark, 100, 7, start=300).collect()
    assert part == ids.where("index >= 300 AND index < 400").orderBy("index").collect()
    rates = ids.selectExpr("avg(CAST(optional_data = '' AS INT)) AS bare").first()
    assert 0.35 < rates["bare"] < 0.55


def test_samples_pair_up(spark):
    s = identities.line_samples(spark, 41, 2)
    assert s.count() == 41 and s.where("length(text) <> 44 OR index <> document * 2 + line_index").isEmpty()


def test_measurement_set_is_strict(spark, tmp_path):
    good = "P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<"
    (tmp_path / "t.json").write_text(json.dumps({"a.png": {"line1": good, "line2": good[:-1]}}))
    truth = measurement.read_truth(spark, str(tmp_path / "t.json"))
    assert truth.select(measurement.line_problem(F.col("line2")).alias("p")).first()["p"] == "length"
    lone = measure.reconcile(truth.select("name"), spark.createDataFrame([("b.png",)], "name string"), "name").collect()
    assert sorted((r["name"], r["side"]) for r in lone) == [("a.png", "left_only"), ("b.png", "right_only")]


def test_status(spark, tmp_path):
    w = status.StatusWriter(str(tmp_path))
    w.update(10.0, state="training", step=3, fonts=["one"], real={"not_located": 2})
    with pytest.raises(KeyError):
        w.update(11.0, nonsense=1)
    (tmp_path / "broken.json").write_text('{"state": "trai')
    (tmp_path / "other.json").write_text('{"state": "finished", "unknown": 1}')
    rows = monitor.with_warnings(status.read_status(spark, str(tmp_path / "*.json"))).collect()
    assert sorted(r["state"] for r in rows) == ["finished", "training"]
    mine = next(r for r in rows if r["state"] == "training")
    assert mine["updated_at"] == 10.0 and mine["one_font"] and mine["not_located_first"]


def test_status_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"state": "training", "step": 5, "unknown": 1}\n{"state": "trai\n{"state": "finished", "step": 9}\n')
    q = status.stream_status(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("statuses").trigger(availableNow=True).start()
    q.awaitTermination(20)
    q.stop()
    assert sorted((r["state"], r["step"]) for r in spark.table("statuses").collect() if r["state"]) == [("finished", 9), ("training", 5)]


def test_shown_state(spark):
    df = spark.createDataFrame([("training", 200), ("training", 100), ("finished", 900), (None, None)], "s string, age int")
    assert [r[0] for r in df.select(monitor.shown_state(F.col("s"), F.col("age"))).collect()] == ["stale", "training", "finished", "waiting"]


def test_watch_stream(spark, tmp_path):
    rows = [("r1", "training", 1), ("r1", "finished", 2), ("r2", "training", 1)]
    spark.createDataFrame(rows, "run string, state string, at long").coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("run string, state string, at long").json(str(tmp_path / "in"))
    q = monitor.watch(stream, "run", "state", "at").writeStream.outputMode("append").format("memory").queryName("watched").trigger(availableNow=True).start()
    q.awaitTermination(10)
    q.stop()
    assert sorted(map(tuple, spark.table("watched").collect())) == [("r1", "finished"), ("r2", "training")]


def test_model_input():
    made = model_input(32, 704, (8, 8))
    assert (made["rows"], made["columns"], made["tokens"], made["px_per_char"], made["patches_per_char"], made["aspect"]) == (4, 88, 352, 16, 2, 22)
    for height, width, patch in ((30, 704, (8, 8)), (32, 700, (8, 7)), (32, 704, (8, 9))):
        with pytest.raises(ValueError):
            model_input(height, width, patch)


def test_failure_is_written_down(tmp_path):
    w = status.StatusWriter(str(tmp_path))
    with pytest.raises(ZeroDivisionError), w.running(lambda: 7.0):
        w.update(6.0, state="training", step=1)
        1 / 0
    assert json.loads((tmp_path / "status.json").read_text()) | {"error": ""} == {"state": "failed", "step": 1, "updated_at": 7.0, "error": ""}
    assert w.status["error"].startswith("ZeroDivisionError")


def test_samples_follow_from_their_number(spark, tmp_path):
    s = identities.line_samples(spark, 400, 2, cuts=3, most_weight=0.5, highest=0.3)
    told = s.selectExpr("count(DISTINCT cut) AS cuts", "min(ink_weight) AS low", "max(ink_weight) AS high", "max(severity) AS most").first()
    assert told["cuts"] == 3 and -0.5 <= told["low"] < -0.3 and 0.3 < told["high"] <= 0.5 and 0.2 < told["most"] <= 0.3
    later = identities.line_samples(spark, 400, 2, epoch=1)
    assert later.join(s, "text").count() < 20 and later.count() == 400
    stream = identities.sample_stream(spark, 8, 2, cuts=3, most_weight=0.5, highest=0.3)
    q = stream.writeStream.format("memory").queryName("samples").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="0 seconds").start()
    try:
        q.awaitTermination(8)
        got = spark.table("samples").where("index < 400").collect()
    finally:
        q.stop()
    want = {r["index"]: r for r in s.collect()}
    assert len(got) >= 16 and all(want[r["index"]] == r for r in got)


def test_polled(spark, tmp_path):
    spark.createDataFrame([("r", 1), ("r", 2)], "run string, at long").write.json(str(tmp_path / "in"))
    seen = []
    rows = monitor.newest(spark.readStream.schema("run string, at long").json(str(tmp_path / "in")), "run", ["at"], ["at"])
    q = monitor.polled(rows, lambda df, n: seen.extend(df.collect()), str(tmp_path / "work"), 0.2)
    q.processAllAvailable()
    q.stop()
    assert [(r["run"], r["at"]) for r in seen] == [("r", 2)] and monitor.POLL_SECONDS == 3


def test_field_of(spark):
    fields = F.array(F.struct(F.lit("a").alias("key"), F.lit(1).alias("value")))
    assert spark.range(1).select(payload.field_of(fields, "a")["value"].alias("v")).first()["v"] == 1
    with pytest.raises(Exception, match="no field b"):
        spark.range(1).select(payload.field_of(fields, "b")["value"]).collect()
