"""Best-two-fit packing of tokenised documents into sequences of a fixed length."""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from zonalis.llm.shared import text_or_empty, written

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Pieces numbered by one task at most, about.
RUN = 100_000


#: White space but blank and line feed; a part that ends in common punctuation.
OTHER_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: The character that stands for each byte in the vocabulary's files; most stand for themselves.
SELF = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTES = {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - SELF))}
#: The settings of tokenizers whose parts can be encoded apart.
SPLITS = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
POINTED = re.compile(r"(.*[^\W_])([.,;:!?]+)", re.DOTALL)


def _plain(text: str) -> bool:
    """Whether all white space is single blanks and line feeds between other characters."""
    return not ("  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n" or OTHER_SPACE.search(text))


class Encoder:
    """Ids of a byte-level BPE as little-endian bytes.

    Where white space stands alone, such a tokenizer always begins a new part at a blank, which it keeps with what follows, and at a line feed;
    so those parts are encoded apart, and so is punctuation after a letter or digit, which it never keeps together. A part of letters alone
    needs no more splitting and goes to the tokenizer's model at once. What most parts gave is remembered, up to `most`. Other texts are encoded whole,
    and so are those that hold an added token's text, such as the end mark, which the tokenizer takes out first. A tokenizer that splits otherwise encodes every text whole.
    """

    def __init__(self, path: str, most: int = 600_000):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        made = json.loads(tokenizer.to_str())
        self.apart = made["normalizer"] is None and made["post_processor"] is None and {k: (made["pre_tokenizer"] or {}).get(k) for k in SPLITS} == SPLITS and made["model"]["type"] == "BPE"
        self.added = [t["content"] for t in made["added_tokens"]]
        self.whole = lambda text: np.asarray(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        whole, model = self.whole, tokenizer.model
        feed = whole("\n")

        def letters(text: str) -> bytes:
            got = model.tokenize(text.encode("utf-8").decode("latin-1").translate(BYTES))
            return struct.pack(f"<{len(got)}I", *[t.id for t in got])

        class Known(dict):
            def __missing__(self, part: str) -> bytes:
                if part.isalpha():
                    ids = letters(f" {part}")
                elif part[0] == "\n" and part[1:].isalpha():
                    ids = feed + letters(part[1:])
                elif pointed := POINTED.fullmatch(part):
                    ids = self[pointed[1]] + self[f"\n{pointed[2]}"][4:]
                else:
                    ids = whole(part if part[0] == "\n" else f" {part}")
                if len(self) < most:
                    self[part] = ids
                return ids

        self.known = Known()

    def __call__(self, text: str) -> bytes:
        if not text or not self.apart or any(x in text for x in self.added) or not _plain(text):
            return self.whole(text)
        first, *parts = text.replace("\n", " \n").split(" ")
        return self.whole(first) + b"".join(map(self.known.__getitem__, parts))


def token_pieces(docs: DataFrame, length: int = 2048, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """PIECE rows: each document's ids and a closing 0, cut into full pieces from the end if longer than `length`, so that its first piece may be shorter."""

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import public_tokenizers

        encode = Encoder(tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = encode(text) + b"\0\0\0\0"
                n = len(ids) // 4
                at = 0
                for k in range(-(-n // length)):
                    end = at + (length if k else (n - 1) % length + 1)
                    rows.append((doc, k, at, end - at, zlib.crc32(ids[4 * at : 4 * end])))
                    at = end
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInPandas(pieces, PIECE)


def plan_bins(counts: dict[int, int], room: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a bin, how many such bins) from the number of pieces of each length.

    A bin takes the longest piece left and then, again and again, the longest that fits. After that its smallest piece gives way to two unpacked
    ones whose sum fills the widened gap more tightly, while there are such. A bin is repeated as long as its lengths last, so the
    work depends on the number of lengths, not of pieces.
    """
    left = np.zeros(room + 1, np.int64)
    for k, n in counts.items():
        left[k] = n
    span = np.arange(room + 1)
    plan = []
    while left.any():
        free = left.copy()
        longest = lambda most: int(np.flatnonzero(free[: most + 1])[-1]) if most > 0 and free[: most + 1].any() else 0
        own, gap = [], room
        while fit := longest(gap):
            own.append(fit)
            free[fit] -= 1
            gap -= fit
        while len(own) > 1 and gap:
            wide = gap + own[-1]
            below = np.maximum.accumulate(np.where(free > 0, span, 0))
            a = np.flatnonzero(free[: wide // 2 + 1])
            b = below[wide - a]
            alone = (b == a) & (free[a] < 2)
            b = np.where(alone, 0, b)
            sums = np.where((a > 0) & (b > 0), a + b, 0)
            if not sums.size or sums.max() <= own[-1]:
                break
            best = int(sums.argmax())
            free[own.pop()] += 1
            for x in (int(b[best]), int(a[best])):
                own.append(x)
                free[x] -= 1
            own.sort(reverse=True)
            gap = room - sum(own)
        need = Counter(own)
        times = min(int(left[k]) // n for k, n in need.items())
        for k, n in need.items():
            left[k] -= n * times
        plan.append((tuple(own), times))
    return plan


def _places(plan: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """For each length and run of ranks within it: the first rank, the first sequence, pieces of that length in a sequence and their offsets."""
    rank: Counter[int] = Counter()
    rows, sequence = [], 0
    for own, times in plan:
        offsets: dict[int, list[int]] = {}
        at = 0
        for k in own:
            offsets.setdefault(k, []).append(at)
            at += k
        for k, places in offsets.items():
            rows.append((k, rank[k], sequence, len(places), places[0]))
            rank[k] += times * len(places)
        sequence += times
    return pd.DataFrame(rows, columns=["length", "first", "sequence", "each", "offset"]).sort_values(["length", "first"])


def pack(pieces: DataFrame, room: int = 2048) -> DataFrame:
    """pieces (PIECE) with sequence_id and offset. Only the counts by length, room of them, reach the driver. Pieces of one length are numbered in runs of about RUN rows, whose counts are joined in; equal rows are interchangeable."""
    histogram = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in histogram.collect()}
    places = _places(plan_bins(counts, room))
    spread = F.broadcast(histogram.select("length", F.ceil(F.col("n") / RUN).alias("_runs")))  # a row for each length: room rows at most
    placed = pieces.join(spread, "length").withColumn("_run", F.pmod(F.xxhash64("doc_id", "piece"), F.col("_runs")))
    runs = placed.groupBy("length", "_run").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("length", "_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("length", "_run").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    ranked = placed.withColumn("_rank", rank).join(runs, ["length", "_run"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    starts = places["length"].to_numpy() * 2**45 + places["first"].to_numpy()
    table = places.to_numpy()

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            length, nth = x["length"].to_numpy(), x["_rank"].to_numpy()
            at = np.searchsorted(starts, length * 2**45 + nth, "right") - 1
            _, first, sequence, each, offset = table[at].T
            turn = nth - first
            yield x.assign(sequence_id=sequence + turn // each, offset=offset + turn % each * length)[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]].astype({"doc_id": "Int64"})

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "_rank").mapInPandas(assign, PIECE + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, length: int = 2048) -> DataFrame:
    """Tokenises and packs all documents; ids are the tokenizer's own with add_special_tokens=False and no other setting, so an added token's text gives that token. A null text is an empty one, whose only id is the closing 0; null and repeated ids and equal rows keep a row for each piece; an empty table gives an empty result."""
    return pack(written(token_pieces(docs, length), "pieces"), length)
