"""Archive files bounded in bytes, spans looked up by halving, bins against a literal best-two-fit, null ids spread over parts."""

import gzip
import os
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from zonalis.llm import near_dup, packing, secrets, sharding, warc
from zonalis.llm.shared import work_folder


def test_archive_files_are_bounded(spark):
    """Small pages, then a run of large ones in the same partition: no file beyond the bound but one of a single record, and every record is there."""
    rows = [(i, "http://a", f"{i} " + "s" * 200) for i in range(3000)] + [(3000 + i, "http://b", f"{i} " + "l" * 150_000) for i in range(40)] + [(4000, "http://c", "x" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    path, file_bytes = work_folder(spark) + "/bounded", 200_000
    warc.write_archives(warc.resolve_revisits(pages), path, file_bytes=file_bytes)
    local, seen = path.removeprefix("file:"), 0
    for name in os.listdir(local):
        if name.endswith(".gz"):
            with gzip.open(os.path.join(local, name)) as f:
                sizes = [len(block) for _, block in warc.parse_records(f)]
            assert sum(sizes) <= warc.SPAN * file_bytes or len(sizes) == 1
            seen += len(sizes)
    assert seen == len(rows)


@pytest.mark.parametrize("sizes", [{}, {1: (5, 0)}, {10: (1000, 700_000), 24: (2, 30_000_000)}, {12: (10, 30_000), 20: (9, 8_000_000), 31: (1, 1 << 30)}])
def test_file_classes(sizes):
    classes = warc.file_classes(sizes, 1 << 24)
    assert all(sum(low <= b <= high for low, high, _ in classes) == 1 for b in sizes)
    assert classes and all(n == 1 or n << high <= 2 * warc.SPAN << 24 for _, high, n in classes)


def test_spans_by_halving(spark):
    rng = random.Random(4)
    rows = []
    for i in range(120):
        cuts = sorted(rng.sample(range(300), 2 * rng.choice([0, 1, 2, 3, 8, 31, 64])))
        spans = [{"start": a, "end": b} for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
        tokens = [{"start": a, "end": a + rng.randint(1, 12)} for a in range(0, 300, 5)]
        rows.append((i, spans, tokens))
    kind = "array<struct<start:int,end:int>>"
    df = spark.createDataFrame(rows, f"i int, spans {kind}, tokens {kind}")
    for r in df.select("spans", "tokens", F.transform("tokens", lambda x: secrets._meets(x, F.col("spans"))).alias("met")).collect():
        assert r["met"] == [any(s["start"] < t["end"] and t["start"] < s["end"] for s in r["spans"]) for t in r["tokens"]]


def test_tokens_among_very_many_spans(spark):
    """Thousands of base spans and tokens in one text: the method's tokens are those that no base span overlaps."""
    rng = random.Random(5)
    draw = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
    text = " ".join(f"secret={draw(20)} {draw(24)} deadbeef{k:032x}" for k in range(3000))
    table = secrets.train(secrets.random_samples(spark, 50))
    got = secrets.scan_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string"), table, least_ratio=-1e9).first()["spans"]
    base = [(s["start"], s["end"]) for s in got if s["kind"] != "markov"]
    covered = {p for a, b in base for p in range(a, b)}
    want = [(m.start(), m.end()) for m in re.finditer(secrets.TOKEN, text) if covered.isdisjoint(range(m.start(), m.end()))]
    assert [(s["start"], s["end"]) for s in got if s["kind"] == "markov"] == want and len(want) > 2000 and len(base) == 6000


def best_two_fit(pieces: list[int], room: int) -> Counter:
    """Piece by piece: a bin is filled greedily, then its smallest piece gives way to the two unpacked ones of the largest sum that fits, while that sum is larger than the piece."""
    left, bins = sorted(pieces, reverse=True), Counter()
    while left:
        own, gap = [], room
        while fit := next((x for x in left if x <= gap), 0):
            left.remove(fit)
            own.append(fit)
            gap -= fit
        while len(own) > 1 and gap:
            smallest = min(own)
            pairs = {(x + y, -min(x, y)) for i, x in enumerate(left) for y in left[i + 1 :] if smallest < x + y <= gap + smallest}
            if not pairs:
                break
            both, low = max(pairs)
            own.remove(smallest)
            for x in (-low, both + low):
                left.remove(x)
                own.append(x)
            left = sorted([*left, smallest], reverse=True)
            gap = room - sum(own)
        bins[tuple(sorted(own, reverse=True))] += 1
    return bins


@pytest.mark.parametrize("seed", range(40))
def test_bins_against_the_literal_method(seed):
    rng = random.Random(seed)
    room = rng.choice([20, 50, 100])
    pieces = [rng.choice([rng.randint(1, room), rng.randint(1, max(1, room // 4)), rng.randint(room // 3, room // 2)]) for _ in range(rng.randint(0, 90))]
    got = Counter()
    for own, times in packing.plan_bins(Counter(pieces), room):
        got[own] += times
    assert got == best_two_fit(pieces, room)


def test_null_ids_spread_over_parts(spark):
    """Documents without ids are numbered in many parts, gapless in each shard."""
    docs = spark.createDataFrame([(None, f"text {i}") for i in range(400)], "doc_id long, text string")
    got = sharding.shard_documents(docs, 4).collect()
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(got) == 400 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    parts = docs.select(F.pmod(F.xxhash64("doc_id", F.xxhash64("text"), F.lit(17)), F.lit(256))).distinct().count()
    assert parts > 150


def test_component_of_null_ids(spark):
    """A null id takes the component of its set's ids; where only null ids have the set, null."""
    one, two = "a b c d e f g h", "i j k l m n o p"
    docs = spark.createDataFrame([(3, one), (None, one), (7, one), (None, two), (None, two)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dup.linked_documents(docs).collect()), key=str)
    assert got == sorted([(3, 5, 3), (7, 5, 3), (None, 5, 3), (None, 5, None), (None, 5, None)], key=str)
