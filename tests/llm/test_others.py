import gzip
import hashlib
import io
import os
import random
import zlib
from collections import Counter, defaultdict

import helpers
import pytest
from pyspark.sql import functions as F

from zonalis.llm import components, fuzzy_lines, media_avi, near_dup, packing, warc
from zonalis.llm.shared import work_folder


def page_rows():
    long, other = "<p>" + "x" * 1200 + "\r\n\r\nWARC/1.1\r\n" + "é" * 50, "y" * 1500
    return [(1, "http://a/1", long), (2, "http://a/2\r\nX: y", long), (7, "http://a/7", long), (3, None, other), (4, "u", other), (5, "u", "short"), (6, "u", "short"), (8, None, None), (9, "u", ""), (None, "n", other), (10, "z", "z" * 999), (11, "z", "z" * 999), (12, "z", "q" * 1000), (13, "z", "q" * 1000)]


def test_warc(spark):
    pages = spark.createDataFrame([(*r, "x", 1) for r in page_rows()], "page_id long, url string, html string, digest string, payload int")
    got = {r["page_id"]: r for r in warc.revisit_report(pages).collect()}
    assert len(got) == len(page_rows())
    newest = defaultdict(lambda: -1)
    for i, _, html in page_rows():
        newest[html or ""] = max(newest[html or ""], -1 if i is None else i)
    for i, _, html in page_rows():
        raw, r = (html or "").encode(), got[i]
        again = len(raw) >= 1000 and newest[html or ""] != i
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", newest[html]) if again else ("response", None))
    assert warc.revisit_report(pages.limit(0)).count() == 0


def test_warc_files_hold_each_payload_once(spark):
    pages = spark.createDataFrame(page_rows(), "page_id long, url string, html string")
    path = work_folder(spark) + "/archive"
    warc.write_archives(warc.resolve_revisits(pages), path)
    kinds, bodies = Counter(), Counter()
    for name in os.listdir(path.removeprefix("file:")):
        if name.endswith(".gz"):
            raw = gzip.open(os.path.join(path.removeprefix("file:"), name)).read()
            for headers, block in warc.parse_records(io.BytesIO(raw)):
                kinds[headers["warc-type"]] += 1
                assert int(headers["content-length"]) == len(block) and headers["warc-record-id"].startswith("<urn:uuid:")
                bodies[block] += headers["warc-type"] == "response" and len(block) > 1500
    assert kinds == {"response": 9, "revisit": 5} and max(bodies.values()) == 1


def test_repeated_pages(spark):
    row = (1, "http://a", "r" * 2000)
    got = warc.revisit_report(spark.createDataFrame([row, row, (0, "http://b", "r" * 2000)], "page_id long, url string, html string")).collect()
    assert Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in got) == {(1, "response", None): 2, (0, "revisit", 1): 1}


@pytest.mark.parametrize("n", [64, 128, 960, 1024, 63 * 64, 63 * 16 * 3, 20000 - 20000 % 64])
def test_avi_round_trip(n):
    for payload in (os.urandom(n), b"\0" * n, b"\xff" * n):
        frames, seconds = media_avi.read_index(media_avi.encode_avi(payload))
        assert seconds == 0.04
        assert b"".join(media_avi.frame_bytes(c, k) for c, _, k in map(media_avi.decode_frame, frames)) == payload


def test_avi_report(spark):
    rows = helpers.odd_documents()
    got = {r["doc_id"]: r for r in media_avi.media_report(helpers.frame(spark)).collect()}
    for r in rows:
        raw = (r[1] or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        g = got[r[0]]
        assert (g["n_bytes"], g["payload_bytes"], g["payload_sha256"], g["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert g["media_sha256"] == hashlib.sha256(media_avi.encode_avi(payload)).hexdigest()
    assert (got[1]["media_sha256"], got[1]["feature"]) == (got[2]["media_sha256"], got[2]["feature"])
    assert media_avi.media_report(helpers.frame(spark, [])).count() == 0


def test_inverse_transform_and_shots():
    import numpy as np

    flat = np.zeros((1, 64), np.float32)
    flat[0, 0] = 80
    assert np.allclose(flat @ media_avi.INVERSE, 10, atol=1e-4)
    assert np.allclose(media_avi.INVERSE @ media_avi.INVERSE.T, np.eye(64), atol=1e-5)
    shares = np.zeros((12, 16))
    shares[:6, 2], shares[6:, 9] = 1, 1
    assert media_avi.shots(shares) == [(0, 6), (6, 12)]


def picture(spark, height, width, seed=3):
    """A smooth colour picture, and JPEG bytes of it from the Java runtime's own writer."""
    import numpy as np

    y, x = np.mgrid[:height, :width]
    rgb = np.stack([128 + 80 * np.sin((x + seed) / 9), 120 + 70 * np.cos(y / 11), 90 + 60 * np.sin((x + y) / 13)], axis=2).astype(np.uint8)
    jvm = spark.sparkContext._jvm
    image = jvm.java.awt.image.BufferedImage(width, height, 1)
    for j in range(height):
        for i in range(width):
            image.setRGB(i, j, int(rgb[j, i, 0]) << 16 | int(rgb[j, i, 1]) << 8 | int(rgb[j, i, 2]))
    out = jvm.java.io.ByteArrayOutputStream()
    assert jvm.javax.imageio.ImageIO.write(image, "jpg", out)
    return rgb, bytes(out.toByteArray())


def brightness(jpeg, height, width, unit):
    import numpy as np

    coefs, quant, _ = media_avi.decode_frame(jpeg)
    blocks = np.clip((coefs * quant).astype(np.float32) @ media_avi.INVERSE + 128, 0, 255).reshape(-1, 8, 8)
    across, down = -(-width // unit) * unit // 8, -(-height // unit) * unit // 8
    return blocks.reshape(down, across, 8, 8).transpose(0, 2, 1, 3).reshape(8 * down, 8 * across)[:height, :width]


def without(jpeg, marker):
    at = 2
    while jpeg[at + 1] != marker:
        at += 2 + int.from_bytes(jpeg[at + 2 : at + 4], "big")
    return jpeg[:at] + jpeg[at + 2 + int.from_bytes(jpeg[at + 2 : at + 4], "big") :]


def test_frames_of_another_writer(spark):
    """Three components of different sampling; with and without tables of codes, as motion JPEG has them."""
    import numpy as np

    rgb, jpeg = picture(spark, 40, 53)
    want = rgb @ np.array([0.299, 0.587, 0.114])
    at = jpeg.index(b"\xff\xc0")
    unit = 8 * max(jpeg[at + 11 + 3 * k] >> 4 for k in range(3))
    assert jpeg[at + 9] == 3
    got = brightness(jpeg, 40, 53, unit)
    assert np.abs(got - want).mean() < 4 and np.abs(got - want).max() < 30
    bare = jpeg
    while b"\xff\xc4" in bare[: bare.index(b"\xff\xda")]:
        bare = without(bare, 0xC4)
    assert len(bare) < len(jpeg) and np.array_equal(brightness(bare, 40, 53, unit), got)
    with pytest.raises(ValueError):
        media_avi.decode_frame(jpeg.replace(b"\xff\xc0", b"\xff\xc2", 1))


def test_bad_files_are_told(spark):
    good = media_avi.encode_avi(b"x" * 64)
    files = [good, None, b"", b"RIFF", good[:200], good.replace(b"idx1", b"idx2"), good.replace(b"\xff\xc0", b"\xff\xc2"), os.urandom(500)]
    df = spark.createDataFrame([(i, 64, f) for i, f in enumerate(files)], "doc_id long, n_bytes long, media binary")
    got = {r["doc_id"]: r for r in media_avi.read_media(df).collect()}
    assert got[0]["problem"] is None and got[0]["payload_bytes"] == 64
    assert all(got[i]["problem"] and got[i]["payload_sha256"] is None for i in range(1, len(files)))
    assert media_avi.read_media(df.limit(0)).count() == 0


def test_clip_rows(spark):
    """Eight frames of zeros, then eight of other bytes: two clips, whose times follow from the frames'."""
    size = media_avi.PER_FRAME
    payload = bytes([255]) * (8 * size) + b"".join(bytes((37 * k + j) % 256 for j in range(size)) for k in range(8))
    df = spark.createDataFrame([(5, len(payload), media_avi.encode_avi(payload)), (6, 0, b"no film")], "doc_id long, n_bytes long, media binary")
    clips = sorted(tuple(r) for r in media_avi.clip_rows(media_avi.read_media(df)).collect())
    assert clips[0] == (5, 0, 0, 8, 0.0, 0.32) and clips[1][:3] == (5, 1, 8) and clips[-1][3] == 16 and {c[0] for c in clips} == {5}


def test_encoder_is_the_tokenizer():
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    encode, whole = packing.Encoder(path, most=20), Tokenizer.from_file(path)
    texts = ["", "a", "don't I'll we've 12 345 x y…!!", "a  b", " a", "a ", "a\nb c\nd", "a\r\nb", "é ﬁ 𝒳 😀😀 a b", "<|endoftext|> x", "x <|endoftext|> y", "a<|endoftext|>", "<|endoftext|", "a b<|endoftext|><|endoftext|>\nc d", "x\x1cy z"] + [r[1] or "" for r in helpers.odd_documents()]
    for t in texts:
        assert np.frombuffer(encode(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t


def test_other_tokenizers_encode_whole():
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    encode, whole = packing.Encoder(path), Tokenizer.from_file(path)
    assert not encode.apart
    for t in ("Some words, here!", "don't <|endoftext|> x"):
        assert np.frombuffer(encode(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(6))
def test_bins(seed):
    rng = random.Random(seed)
    counts = Counter(rng.choice([rng.randint(1, 64), rng.randint(20, 40), 64]) for _ in range(400))
    plan = packing.plan_bins(counts, 64)
    used = Counter()
    for own, times in plan:
        assert sum(own) <= 64
        for k in own:
            used[k] += times
    assert used == counts
    assert sum(t for _, t in plan) <= -(-sum(k * n for k, n in counts.items()) // 64) * 1.08 + 2


def test_two_fit_better_than_one():
    assert packing.plan_bins({6: 1, 3: 1, 2: 2}, 10)[0] == ((6, 2, 2), 1)


def test_packing(spark):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = helpers.odd_documents()
    got = packing.pack_documents(helpers.frame(spark)).collect()
    texts = {r[0]: r[1] or "" for r in rows}
    many = Counter(r[0] for r in rows)
    pieces = defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
    assert set(pieces) == set(texts)
    for i, own in pieces.items():
        ids = whole.encode(texts[i], add_special_tokens=False).ids + [0]
        want = [(k, s, e) for k, s, e in zip(range(99), [0, *range((len(ids) - 1) % 2048 + 1, len(ids), 2048)], range((len(ids) - 1) % 2048 + 1, len(ids) + 1, 2048))]
        assert sorted((r["piece"], r["start"], r["start"] + r["length"]) for r in own) == sorted(want * many[i])
        assert all(r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for r in own)
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 2048
    assert len(bins) <= -(-sum(r["length"] for r in got) // 2048) + 1
    assert packing.pack_documents(helpers.frame(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(6)
    links = [(rng.randint(-60, 60), rng.randint(-60, 60)) for _ in range(70)] + [(k, k + 1) for k in range(100, 160)]
    got = {r["v"]: r["c"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    both = {frozenset(x) for x in links}
    want = helpers.groups(sorted({x for p in links for x in p}), lambda a, b: frozenset((a, b)) in both)
    assert got == want


def near_rows():
    """Chains of near copies about the threshold, a large group of near copies, and documents that share a passage only."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("klmnoprst") for _ in range(5))
    rows = []
    for _ in range(12):
        text = [word() for _ in range(rng.randint(30, 90))]
        for _ in range(5):
            rows.append(" ".join(text))
            text = list(text)
            for _ in range(rng.randint(0, 2)):
                text[rng.randrange(len(text))] = word()
    base = [word() for _ in range(100)]
    for _ in range(80):
        text = list(base)
        for _ in range(rng.randint(0, 3)):
            text[rng.randrange(100)] = word()
        rows.append(" ".join(text))
    shared = " ".join(word() for _ in range(60))
    rows += [shared + " " + " ".join(word() for _ in range(60)) for _ in range(40)]
    rng.shuffle(rows)
    return [(500 + i, t, "en", "a", 1, 1, "x", 0.5) for i, t in enumerate(rows)]


@pytest.mark.parametrize("small", [512, 16])
def test_near_duplicates(spark, small):
    rows = [r for r in helpers.odd_documents() if r[0] is not None] + near_rows()
    sets = {r[0]: helpers.shingles(r[1], 4) for r in rows}
    want = helpers.groups(sorted(sets), lambda a, b: bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    got = near_dup.linked_documents(helpers.frame(spark, rows + [r for r in helpers.odd_documents() if r[0] is None]), small=small).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]])


def test_near_duplicates_empty(spark):
    assert near_dup.near_dup_report(helpers.frame(spark, [])).count() == 0
    lone = near_dup.near_dup_report(helpers.frame(spark, helpers.odd_documents()[4:8])).collect()
    assert all(r["kept"] for r in lone)


def normal(line):
    raw = line.encode().translate(fuzzy_lines.NORMAL).decode()
    return " ".join(helpers.words(raw))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def line_rows():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghik") for _ in range(6))
    lines = [" ".join(word() for _ in range(rng.randint(5, 40))) for _ in range(60)]
    lines += [x.upper().replace(" ", ", ") + "!" for x in lines[:15]]
    for x in lines[15:30]:
        w = x.split(" ")
        w[rng.randrange(len(w))] += "z"
        lines.append(" ".join(w))
    lines += ["short line"] * 5 + [""] * 3
    rng.shuffle(lines)
    return [(200 + i, "\n".join(lines[4 * i : 4 * i + 4]), "en", "a", 1, 1, "x", 0.5) for i in range(len(lines) // 4)]


def similar_lines(rows):
    """(doc_id, line, text) of the lines with a word, in order, and whether two of them are to be linked: by edit similarity alone, knowing nothing of signatures or nodes."""
    lines = sorted({(r[0], k, normal(x)) for r in rows for k, x in enumerate((r[1] or "").split("\n")) if helpers.words(normal(x))}, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))

    def linked(i, j):
        a, b = lines[i][2], lines[j][2]
        most = int(0.1 * max(len(a), len(b)) + 1e-9)
        return a == b or abs(len(a) - len(b)) <= most and distance(a, b) <= most

    return lines, linked


def test_fuzzy_lines(spark):
    rows = helpers.odd_documents() + line_rows()
    lines, linked = similar_lines(rows)
    want = helpers.groups(list(range(len(lines))), linked)
    got = {(r["doc_id"], r["line"]) for r in fuzzy_lines.removed_lines(helpers.frame(spark, rows)).collect()}
    gone = {lines[i][:2] for i, c in want.items() if i != c}
    assert got <= gone and len(got) >= 0.97 * len(gone) and len(gone) > 30
    report = fuzzy_lines.line_report(helpers.frame(spark, rows)).collect()
    assert len(report) == len(rows) and fuzzy_lines.line_report(helpers.frame(spark, [])).count() == 0


@pytest.mark.parametrize("small", [4, 16])
def test_large_nodes_branch(spark, small):
    """Lines that share half of what they hold and are no copies, and near copies among them: nodes are large and branch, and the copies are found."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghik") for _ in range(7))
    shared = " ".join(word() for _ in range(12))
    rows, copies = [], set()
    for k in range(60):
        own = [word() for _ in range(12)]
        rows.append((2 * k, shared + " " + " ".join(own)))
        if k % 3 == 0:
            own[rng.randrange(12)] = word()
            rows.append((2 * k + 1, shared + " " + " ".join(own)))
            copies.add(2 * k + 1)
    docs = helpers.frame(spark, [(i, t, "en", "a", 1, 1, "x", 0.5) for i, t in rows])
    gone = {r["doc_id"] for r in fuzzy_lines.removed_lines(docs, small=small).collect()}
    assert gone <= copies and len(gone) >= 0.9 * len(copies)


def test_within_distance():
    rng = random.Random(5)
    for _ in range(400):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 30))) for _ in range(2))
        b = a[: rng.randint(0, len(a))] + b[:4] + a[rng.randint(0, len(a)) :] if rng.random() < 0.5 else b
        most = rng.randint(0, 12)
        assert fuzzy_lines.within_distance(a, b, most) == (distance(a, b) <= most), (a, b, most)


def test_every_line_kept_once(spark):
    docs = helpers.frame(spark, helpers.odd_documents() + line_rows()).select("doc_id", "text", "lang", "source", "n_chars")
    left = fuzzy_lines.without_repeated_lines(docs)
    assert left.columns == docs.columns
    texts = [r["text"] for r in left.collect() if r["doc_id"] not in (13,)]
    held = Counter(normal(x) for t in texts for x in (t or "").split("\n") if len(helpers.words(normal(x))) >= 5)
    assert max(held.values()) == 1  # equal lines are always found
    whole = {normal(x) for r in docs.collect() for x in (r["text"] or "").split("\n") if len(helpers.words(normal(x))) >= 5}
    assert len(whole) - len(held) <= 20


def test_one_of_each_group(spark):
    docs = helpers.frame(spark, [r for r in helpers.odd_documents() if r[0] != 13])
    kept = {r["doc_id"] for r in near_dup.one_of_each_group(docs, 5).select("doc_id").collect()}
    assert {1, 5, 6, 7, None} <= kept and not {2, 4} & kept


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = [r for r in helpers.odd_documents()] + near_rows()
    folder = str(tmp_path)
    helpers.frame(spark, rows).select(*corpus_pipeline.COLUMNS).write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        assert docs.columns == list(corpus_pipeline.COLUMNS)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "mixing", "packing"]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.select("doc_id").distinct().collect()}
    assert docs.where(F.size(F.split("text", " ")) < 10).isEmpty()


def test_stages_of_odd_and_empty_tables(spark, tmp_path):
    """Every stage over nulls, empty texts, repeats and clashing columns, and over no rows."""
    import corpus_pipeline

    odd = helpers.frame(spark, [*helpers.odd_documents(), *[(None, None, None, None, None, 1, "x", 0.5)] * 2]).withColumn("_row", F.lit("r")).withColumn("_gone", F.lit(1)).withColumn("place", F.lit(2))
    rows = odd.count()
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd, odd.limit(0)):
            out = stage(spark, docs, str(tmp_path))
            n = out.count()
            assert name == "packing" or out.columns == list(corpus_pipeline.COLUMNS), name
            assert n == 0 if docs is not odd else n > 0, name
            if docs is odd and name == "packing":
                assert out.where("piece = 0").count() == rows
            if docs is odd and name in ("line_dedup", "near_dedup"):
                assert out.where("text IS NULL").count() == 3, name


def test_run_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    helpers.frame(spark, []).select(*corpus_pipeline.COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
