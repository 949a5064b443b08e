"""A measurement set: images and the truth about them, joined strictly."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalis.operators import imaging
from zonalis.operators.measure import reconcile
from zonalis.sources.status_files import folder_of

TRUTH = "map<string,struct<line1:string,line2:string,box:array<double>>>"


def line_problem(text: Column) -> Column:
    """null, or missing, length, charset."""
    return F.when(text.isNull(), "missing").when(F.length(text) != 44, "length").when(~text.rlike(r"\A[A-Z0-9<]{44}\z"), "charset")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(name, line1, line2, box) from a file that holds one JSON object of names, or a folder of such files."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", TRUTH).alias("truth"))
    return raw.select(F.explode("truth").alias("name", "is")).select("name", "is.line1", "is.line2", "is.box")


IMAGES = "*.{jpg,jpeg,png}"


def _path(path: Column) -> Column:
    """A path without the host's empty place, which Spark's sources write or leave out."""
    return F.regexp_replace(path, "^([A-Za-z0-9+.-]+):/+", "$1:/")


def _decoded(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.format("image").option("pathGlobFilter", IMAGES).load(path).select("image.*")
    origin = F.url_decode(F.replace(F.col("origin"), F.lit("+"), F.lit("%2B")))  # this source alone encodes its paths
    name = F.element_at(F.split(origin, "/"), -1)
    data = F.when(F.col("height") > 0, F.col("data")).otherwise(F.raise_error(F.concat(F.lit("not an image: "), name)).cast("binary"))
    return df.select(name.alias("name"), "height", "width", F.col("nChannels").alias("channels"), data.alias("data"), _path(origin).alias("path"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(name, height, width, channels, data) of the JPEG and PNG files, decoded by Spark's image source; a file that can't be decoded is an error."""
    return _decoded(spark, path).drop("path")


#: Tables of so many rows at most are broadcast.
FEW_NAMES = 250_000


def _image_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, path, content, plain) of the JPEG and PNG files. plain: a grey PNG of a byte a pixel, not interlaced, whose pixels follow its header."""
    has = lambda at, hexes: F.substring("content", at, len(hexes) // 2) == F.unhex(F.lit(hexes))
    plain = has(1, "89504E470D0A1A0A") & has(25, "0800000000") & has(38, "49444154")
    files = spark.read.format("binaryFile").option("pathGlobFilter", IMAGES).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), _path(F.col("path")).alias("path"), "content", plain.alias("plain"))


def _small(df: DataFrame, n: int) -> DataFrame:
    """df, of n rows, as the side of a join that is broadcast or hashed: images are never sorted."""
    return F.broadcast(df) if n <= FEW_NAMES else df.hint("shuffle_hash")


#: Parts of a file source that go into one task: it deals about 32 files to a part, however small they are.
PARTS = 32


def _dealt(files: DataFrame) -> DataFrame:
    """The files in about as many tasks as there is work for."""
    parts = files.rdd.getNumPartitions()
    return files.coalesce(max(min(parts, 2 * files.sparkSession.sparkContext.defaultParallelism), parts // PARTS))


def packed_measurement_set(spark: SparkSession, images: str, truth: str) -> DataFrame:
    """load_measurement_set's rows, but that plain files have no channels and their content as data: `unpacked` makes images of them where they are needed. Only other files go through Spark's image source, which takes about four times as long (7.9 and 2.1 CPU ms a page), and if names are few, no image is moved."""
    known, pictures, n = _strict(spark, images, truth)
    return pictures.join(_small(known, n), "name")


def boxed_images(spark: SparkSession, images: str, truth: str) -> DataFrame:
    """(name, box, height, width, channels, data) of packed_measurement_set, checked as strictly: only boxes that are stated are joined, so without many of them no image is moved, however many names there are."""
    known, pictures, _ = _strict(spark, images, truth)
    boxes = known.where("box IS NOT NULL").select("name", "box")
    return pictures.join(_small(boxes, boxes.count()), "name", "left").select("name", "box", "height", "width", "channels", "data")


def _strict(spark: SparkSession, images: str, truth: str) -> tuple[DataFrame, DataFrame, int]:
    """The truth, the pictures (name, height, width, channels, data), and how many; raises if they don't belong together."""
    known, files = read_truth(spark, truth), _dealt(_image_files(spark, images))
    listed = files.select("name", "path", "plain").persist()
    try:
        lone = reconcile(listed.select("name"), known.select("name"), "name").limit(5).collect()
        if lone:
            raise ValueError("without a counterpart: " + ", ".join(f"{r['name']} ({r['side']})" for r in lone))
        bad = known.select("name", F.coalesce(line_problem(F.col("line1")), line_problem(F.col("line2"))).alias("problem")).where("problem IS NOT NULL").limit(5).collect()
        if bad:
            raise ValueError("wrong truth: " + ", ".join(f"{r['name']} ({r['problem']})" for r in bad))
        n, others = listed.count(), listed.where("NOT plain").count()
    finally:
        listed.unpersist()
    shape = [F.lit(None).cast("int").alias(c) for c in ("height", "width", "channels")]
    pictures = files.where("plain").select("name", *shape, F.col("content").alias("data"))
    if others:
        rest = _small(files.where("NOT plain").select("path"), others)
        pictures = pictures.union(_decoded(spark, images).join(rest, "path", "left_semi").drop("path"))
    return known, pictures, n


def unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of packed_measurement_set with every image in pixels, few at a time."""
    for x in imaging.few(batches):
        pages = [unpacked_png(data) if n is None or n != n else None for n, data in zip(x["channels"], x["data"], strict=True)]
        of = lambda c, own: [own(p) if p is not None else v for p, v in zip(pages, x[c], strict=True)]  # noqa: E731, B023
        yield x.assign(height=of("height", lambda p: p.shape[0]), width=of("width", lambda p: p.shape[1]), channels=of("channels", lambda p: 1), data=of("data", np.ndarray.tobytes))


def grey_files(keys: list[str]) -> imaging.Drawing:
    """Makes (keys, height, width, data) of rows of packed_measurement_set: a byte a pixel."""
    grey = imaging.greying(keys)
    return lambda batches: grey(unpacked(batches))


def load_measurement_set(spark: SparkSession, images: str, truth: str) -> DataFrame:
    """Images with their truth, by name. Raises if either side has names the other lacks, or if a line isn't 44 characters of the alphabet."""
    packed = packed_measurement_set(spark, images, truth)
    return packed.mapInPandas(unpacked, packed.schema)


def unpacked_png(content: bytes) -> np.ndarray:
    """The page of a plain PNG file (see _image_files)."""
    width, height = struct.unpack(">II", content[16:24])
    at, parts, kind = 33, [], b""
    while kind != b"IEND":
        size, kind = struct.unpack(">I4s", content[at : at + 8])  # a file that ends too early is an error
        if kind == b"IDAT":
            parts.append(content[at + 8 : at + 8 + size])
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, width + 1)
    return _unfiltered(rows[:, 0], rows[:, 1:]) if rows[:, 0].any() else rows[:, 1:]


def _unfiltered(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Rows of pixels of rows of differences: from the pixel before (1), above (2), the mean of both (3), or that of both and the one above on the left which is nearest to their plane (4)."""
    out, above = np.empty_like(rows), np.zeros(rows.shape[1], np.uint8)
    for y, (kind, row) in enumerate(zip(kinds.tolist(), rows, strict=True)):
        if kind > 4:
            raise ValueError(f"not an image: a row has filter {kind}")
        if kind in (0, 1, 2):
            out[y] = row if kind == 0 else np.cumsum(row, dtype=np.uint8) if kind == 1 else row + above
        else:
            left = corner = 0
            for x, (d, b) in enumerate(zip(row.tolist(), above.tolist(), strict=True)):
                if kind == 3:
                    near = left + b >> 1
                else:
                    p, q, r = abs(b - corner), abs(left - corner), abs(left + b - 2 * corner)
                    near = left if p <= q and p <= r else b if q <= r else corner
                out[y, x] = left = d + near & 255
                corner = b
        above = out[y]
    return out


def png(page: np.ndarray) -> bytes:
    """A grey page as a PNG file, packed at zlib's fastest level and by the frequency of shades alone: the default takes seven times as long, three times as long as drawing, and grainy paper hardly repeats itself."""
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    rows = np.zeros((page.shape[0], page.shape[1] + 1), np.uint8)  # every row begins with its filter, none
    rows[:, 1:] = page
    pack = zlib.compressobj(1, strategy=zlib.Z_HUFFMAN_ONLY)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", page.shape[1], page.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", pack.compress(rows) + pack.flush()) + chunk(b"IEND", b"")


def write_measurement_set(pages: DataFrame, folder: str, names_in_file: int = 1000, draw: imaging.Drawing | None = None) -> None:
    """Writes pages (name, height, width, data, line1, line2 and, if they have it, box) as a set that load_measurement_set reads from folder/images and folder/truth: a PNG file each, by the tasks that hold them, and the truth in files of about names_in_file names. The folder is one that all executors see. With draw, pages are rows of which it makes pages. Pages are made once."""

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = folder_of(f"{folder}/images")
        store.create_dir(path, recursive=True)
        for x in batches:
            for name, h, w, data in zip(x["name"], x["height"], x["width"], x["data"], strict=True):
                with store.open_output_stream(f"{path}/{name}") as f:
                    f.write(png(np.frombuffer(data, np.uint8).reshape(h, w)))
            yield x[kept]

    kept = ["name", "line1", "line2", *["box"] * ("box" in pages.columns)]
    done = imaging.over_pages(pages, [*kept, "height", "width", "data"], draw, put, ", ".join(f"{c} {'array<double>' if c == 'box' else 'string'}" for c in kept)).persist()
    n = done.count()
    box = F.col("box") if "box" in kept else F.lit(None).cast("array<double>")
    truth = done.select("name", F.struct("line1", "line2", box.alias("box")).alias("is"), F.pmod(F.xxhash64("name"), F.lit(max(1, -(-n // names_in_file)))).alias("part"))
    maps = truth.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("name", "is"))).alias("m"))
    maps.select(F.to_json("m").alias("value")).write.option("maxRecordsPerFile", 1).text(f"{folder}/truth")
    done.unpersist()
