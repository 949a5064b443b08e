import struct
import zlib

import numpy as np
import pytest

from zonalis.operators import imaging
from zonalis.sources import measurement

LINE1 = "P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<"
LINE2 = "L898902C36UTO7408122F1204159ZE184226B<<<<<10"


def filtered(image: np.ndarray, kinds: list[int], ancillary: bytes = b"", parts: int = 1) -> bytes:
    """A PNG file of an image (height, width, channels) whose rows have these filters in turn, its pixels in so many chunks."""
    h, w, n = image.shape
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    x = np.zeros((h + 1, w + 1, n), np.int32)
    x[1:, 1:] = image
    left, above, corner, own = x[1:, :-1], x[:-1, 1:], x[:-1, :-1], x[1:, 1:]
    far = np.abs(np.stack([above - corner, left - corner, left + above - 2 * corner])).argmin(axis=0)
    guess = [np.zeros_like(own), left, above, (left + above) // 2, np.choose(far, [left, above, corner])]
    rows = b"".join(bytes([kinds[y % len(kinds)]]) + ((own - guess[kinds[y % len(kinds)]])[y] % 256).astype(np.uint8).tobytes() for y in range(h))
    packed = zlib.compress(rows)
    cuts = np.linspace(0, len(packed), parts + 1).astype(int).tolist()
    held = b"".join(chunk(b"IDAT", packed[a:b]) for a, b in zip(cuts, cuts[1:], strict=False))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2}[n], 0, 0, 0)) + ancillary + held + chunk(b"IEND", b"")


def test_plain_files_are_what_the_image_source_makes_of_them():
    rng = np.random.default_rng(1)
    for shape in ((1, 1), (9, 1), (1, 9), (40, 33)):
        page = rng.integers(0, 256, shape, np.uint8)
        for kinds in ([0], [1], [2], [3], [4], [4, 1, 3, 2, 0]):
            assert (measurement.unpacked_png(filtered(page[..., None], kinds, parts=3)) == page).all()
        assert (measurement.unpacked_png(measurement.png(page)) == page).all()
    with pytest.raises(Exception):
        measurement.unpacked_png(measurement.png(page)[:-40])


def test_plain_and_other_files_of_a_set(spark, tmp_path):
    rng = np.random.default_rng(2)
    (tmp_path / "images").mkdir()
    page, colours = rng.integers(0, 256, (20, 30, 1), np.uint8), rng.integers(0, 256, (20, 30, 3), np.uint8)
    text = struct.pack(">I", 3) + b"tEXt" + b"a\0b" + struct.pack(">I", zlib.crc32(b"tEXta\0b"))
    files = {"plain.png": filtered(page, [1, 2, 3, 4]), "said.png": filtered(page, [4], text), "colours 1+1%.png": filtered(colours, [0, 3]), "named wrong%20+.jpg": filtered(page, [2])}
    for name, content in files.items():
        (tmp_path / "images" / name).write_bytes(content)
    truth = spark.createDataFrame([({n: (LINE1, LINE2, None) for n in files},)], f"m {measurement.TRUTH}")
    truth.selectExpr("to_json(m) AS value").write.text(str(tmp_path / "truth"))
    folders = str(tmp_path / "images"), str(tmp_path / "truth")
    packed = measurement.packed_measurement_set(spark, *folders)
    plain = {r["name"] for r in packed.where("channels IS NULL").collect()}
    known = {r["name"]: r for r in measurement.load_measurement_set(spark, *folders).collect()}
    source = {r["name"]: r for r in measurement.read_images(spark, folders[0]).collect()}
    assert len(plain) == 2 and "plain.png" in plain and len(known) == len(source) == 4
    for name, r in source.items():
        assert [known[name][c] for c in ("height", "width", "channels", "data")] == [r[c] for c in ("height", "width", "channels", "data")]
    grey = {r["name"]: bytes(r["data"]) for r in packed.select("name", "height", "width", "channels", "data").mapInPandas(measurement.grey_files(["name"]), f"name string, {imaging.PAGE}").collect()}
    assert grey["plain.png"] == grey["said.png"] == page.tobytes() and len(grey["colours 1+1%.png"]) == 600


def test_names_beyond_a_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(measurement, "FEW_NAMES", 0)
    page = imaging.render(LINE1, LINE2)
    rows = [(f"{i}.png", *page.shape, np.roll(page, i).tobytes(), LINE1, LINE2) for i in range(5)]
    measurement.write_measurement_set(spark.createDataFrame(rows, "name string, height int, width int, data binary, line1 string, line2 string"), str(tmp_path))
    got = measurement.load_measurement_set(spark, f"{tmp_path}/images", f"{tmp_path}/truth").collect()
    assert sorted((r["name"], bytes(r["data"])) for r in got) == [(r[0], r[3]) for r in rows]


def test_an_unturned_page_stays():
    page = np.random.default_rng(3).integers(0, 256, (31, 50), np.uint8)
    assert (imaging.turned(page, -0.0, 25, 15.5) == page).all() and (imaging.turned(page, 1e-9, 25, 15.5) == page).all()
