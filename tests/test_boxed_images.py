"""Images meet their boxes without being moved, and many small files go into few tasks."""

import json

import numpy as np
import pytest

from zonalis.sources import measurement

LINE = "P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "images").mkdir()
    truth = {}
    for k in range(200):
        (tmp_path / "images" / f"{k}.png").write_bytes(measurement.png(np.full((6, 7), k, np.uint8)))
        truth[f"{k}.png"] = {"line1": LINE, "line2": LINE, "box": [0, 0, k, 9] if k % 3 == 0 else None}
    (tmp_path / "truth.json").write_text(json.dumps(truth))
    return str(tmp_path / "images"), str(tmp_path / "truth.json")


def test_every_image_has_its_box(spark, folder):
    got = {r["name"]: r for r in measurement.boxed_images(spark, *folder).collect()}
    want = {r["name"]: r for r in measurement.packed_measurement_set(spark, *folder).collect()}
    assert len(got) == 200 and set(got) == set(want)
    assert all(got[n]["box"] == want[n]["box"] and got[n]["data"] == want[n]["data"] for n in want)


@pytest.mark.parametrize("few", [0, 250_000])
def test_many_names_move_no_image_without_a_box(spark, folder, monkeypatch, few):
    images, truth = folder
    known = json.loads(open(truth).read())
    open(truth, "w").write(json.dumps({n: {**t, "box": None} for n, t in known.items()}))
    monkeypatch.setattr(measurement, "FEW_NAMES", few)
    df = measurement.boxed_images(spark, images, truth)
    rows = df.collect()
    assert len(rows) == 200 and all(r["box"] is None for r in rows)
    assert "Exchange hashpartitioning" not in df._jdf.queryExecution().executedPlan().toString()


def test_small_files_share_tasks(spark, folder):
    files = measurement._image_files(spark, folder[0])
    assert files.rdd.getNumPartitions() > 4
    spark_parts = 2 * spark.sparkContext.defaultParallelism
    assert measurement._dealt(files).rdd.getNumPartitions() <= max(spark_parts, 1) and measurement._dealt(files).count() == 200


def test_strict(spark, folder):
    open(folder[1], "w").write("{}")
    with pytest.raises(ValueError, match="without a counterpart"):
        measurement.boxed_images(spark, *folder)
