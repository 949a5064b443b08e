import json
import threading

from zonalis.sources import status
from zonalis.streaming import monitor


def follow(spark, folder, progress, seen):
    """One look of a stream that starts anew and goes on from its checkpoint."""
    rows = status.stream_status(spark, str(folder)).select("path", "state", "step")

    def keep(df, _):
        seen.extend((r["path"].rsplit("/", 2)[-2], r["state"], r["step"]) for r in df.collect())

    rows.writeStream.option("checkpointLocation", str(progress)).foreachBatch(keep).trigger(availableNow=True).start().awaitTermination(60)


def test_every_state_of_a_rewritten_file_once(spark, tmp_path):
    seen, folder = [], tmp_path / "runs"
    follow(spark, folder, tmp_path / "p", seen)  # there is no folder yet
    for name in ("a", "b"):
        (folder / name).mkdir(parents=True)
    a, b = status.StatusWriter(str(folder / "a")), status.StatusWriter(str(folder / "b"), spark)
    want = []
    for step in range(1, 5):
        a.update(float(step), state="training", step=step)
        want.append(("a", "training", step))
        if step % 2:
            b.update(float(step), state="finished", step=step)
            want.append(("b", "finished", step))
        follow(spark, folder, tmp_path / "p", seen)
        follow(spark, folder, tmp_path / "p", seen)  # nothing new: nothing is repeated
        assert sorted(seen) == sorted(want)
    (folder / "a" / "status.json").write_text('{"state": "trai')
    follow(spark, folder, tmp_path / "p", seen)
    assert len(seen) == len(want)
    a.update(9.0, state="failed", step=9, error="x")
    (folder / "b" / "status.json").unlink()
    follow(spark, folder, tmp_path / "p", seen)
    assert sorted(seen) == sorted([*want, ("a", "failed", 9)])


def test_a_running_stream_follows(spark, tmp_path):
    writer, got = status.StatusWriter(str(tmp_path)), []
    rows = status.stream_status(spark, str(tmp_path)).select("step")
    q = monitor.polled(rows.groupBy("step").count(), lambda df, _: got.extend(r["step"] for r in df.collect()), str(tmp_path / "work"), seconds=0)
    try:
        for step in (1, 2, 3):
            writer.update(float(step), state="training", step=step)
            q.processAllAvailable()
    finally:
        q.stop()
    assert got == [1, 2, 3]


def test_no_reader_sees_half_a_file(spark, tmp_path):
    writer, stop, broken = status.StatusWriter(f"file://{tmp_path}", spark), threading.Event(), []
    writer.update(0.0, step=0)

    def read():
        while not stop.is_set():
            try:
                json.loads((tmp_path / "status.json").read_text())
            except (ValueError, OSError) as e:
                broken.append(e)

    reader = threading.Thread(target=read)
    reader.start()
    for k in range(60):
        writer.update(float(k), step=k, error="x" * 20_000)
    stop.set()
    reader.join()
    assert not broken and json.loads((tmp_path / "status.json").read_text())["step"] == 59
    assert [p.name for p in tmp_path.iterdir() if p.suffix == ".tmp"] == []


def test_writing_never_stops_the_run(spark, tmp_path):
    (tmp_path / "file").write_text("")
    status.StatusWriter(str(tmp_path / "file")).update(1.0, step=1)
    status.StatusWriter(f"file://{tmp_path}/file/below", spark).update(1.0, step=1)
    status.StatusWriter("nosuch://host/folder", spark).update(1.0, step=1)
