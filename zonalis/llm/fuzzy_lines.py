"""Line dedup: minwise signatures over byte runs of normalised lines, nodes of lines that share some of it, edit similarity, one occurrence kept of each connected group."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonalis.llm.components import components
from zonalis.llm.edits import all_within
from zonalis.llm.nodes import leaves, links_within, met, with_partner
from zonalis.llm.shared import forget, numbered, small_side, text_or_empty, written
from zonalis.llm.shingles import mixed

LEAST_WORDS, LEAST_SIMILARITY, SMALL = 1, 0.9, 512
#: A signature holds WIDTH 16-bit minima over hashes of the byte runs of a line.
WIDTH = 24
#: Nodes of so many lines are counted at once, about 14 of each.
LINES = 1 << 15
#: So many pairs are told apart by edit distance at once.
TOGETHER = 1 << 15
#: Lines of up to OVERLAP[1] characters have a signature over runs of GRAMS[0] bytes, lines of OVERLAP[0] characters or more one over runs of GRAMS[1]: whichever two similar lines are, they have one in common, for their characters differ in number by a tenth at most.
GRAMS, OVERLAP = (6, 10), (80, 96)


def _picked(trees: int, step: int) -> np.ndarray:
    """Places of each tree, no two of which appear together twice."""
    draw, found, used = random.Random(7), [], set()
    while len(found) < trees:
        own = sorted(draw.sample(range(WIDTH), step))
        pairs = set(combinations(own, 2))
        if not pairs & used:
            used |= pairs
            found.append(own)
    return np.array(found)


#: Places that a node takes, of each tree: three for short runs, which unlike lines share more often, two for long ones.
PICKED = (_picked(20, 3), np.arange(WIDTH).reshape(-1, 2))
#: Lines that share a node are compared if their signatures agree in this many places.
LEAST_AGREEING = (7, 5)
#: Lines of up to TINY characters are also found by their halves: one edit leaves one of them whole.
TINY = 20

#: What normalising does to bytes: A-Z to a-z; ASCII that is neither letter nor digit to a blank, but for the line feed.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() or c == 10 else 32 for c in range(256))


def _runs(buf: np.ndarray, gram: int) -> np.ndarray:
    """32-bit hashes of all runs of `gram` bytes, by doubling: a run of n bytes is two shorter ones side by side."""
    made, power, at, out = {1: buf.astype(np.uint32)}, {1: np.uint32(0x9E3779B1)}, 1, None
    while 2 * at <= gram:
        made[2 * at] = made[at][:-at] * power[at] + made[at][at:]
        power[2 * at] = power[at] * power[at]
        at *= 2
    done = 0
    for n in sorted(made, reverse=True):
        if gram & n:
            part = made[n][done:]
            out = part if out is None else out[: len(part)] * power[n] + part
            done += n
    out = out[: len(buf) - gram + 1]
    out ^= out >> np.uint32(16)
    out *= np.uint32(0x7FEB352D)
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x846CA68B)
    return out ^ (out >> np.uint32(16))


def _each_lowest(runs: np.ndarray, size: np.ndarray, gram: int) -> np.ndarray:
    """Of each line, the lowest of its runs by WIDTH orders. For lines of few runs."""
    count = size - gram + 1
    first = np.cumsum(count) - count
    runs = runs[np.arange(count.sum()) + np.repeat(np.cumsum(size) - size - first, count)]
    draw = np.random.default_rng(0)
    out = np.empty((len(size), WIDTH), np.uint32)
    for k in range(WIDTH):
        x = (runs ^ draw.integers(0, 1 << 32, dtype=np.uint32)) * (draw.integers(0, 1 << 31, dtype=np.uint32) * np.uint32(2) + np.uint32(1))
        out[:, k] = np.minimum.reduceat((x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B), first)
    return out


def _dealt_lowest(runs: np.ndarray, size: np.ndarray, gram: int) -> np.ndarray:
    """Of each line, the lowest run in each of WIDTH parts into which one hash deals its runs; the largest value where a part is empty. For lines of many runs: it looks at each once."""
    runs = runs[: size.sum()].copy()
    at = np.repeat(np.arange(len(size)) * WIDTH, size) + ((runs >> np.uint32(16)) * np.uint32(WIDTH) >> np.uint32(16))
    runs *= np.uint32(0x2545F491)
    for k in range(1, gram):  # runs that reach into the next line
        runs[np.cumsum(size) - k] = 0xFFFFFFFF
    out = np.full(len(size) * WIDTH, 0xFFFFFFFF, np.uint32)
    np.minimum.at(out, at, runs)
    return out.reshape(-1, WIDTH)


def _signatures(lines: list[bytes], key: np.ndarray) -> tuple[list[bytes | None], list[bytes | None]]:
    """Of each line its signature over short runs and over long runs, None where it has none: 16-bit numbers for its kind and being tiny, for its length, and WIDTH minima. An empty part's minimum is what no other line has."""
    size = np.array([len(x) for x in lines])
    # a line has few characters if it has few bytes other than continuation ones
    chars = np.array([len(x) if x.isascii() else len(x.decode("utf-8")) for x in lines])
    found = []
    for kind, (gram, fits, lowest) in enumerate(((GRAMS[0], (size >= GRAMS[0]) & (chars <= OVERLAP[1]), _each_lowest), (GRAMS[1], chars >= OVERLAP[0], _dealt_lowest))):
        out: list[bytes | None] = [None] * len(lines)
        own = np.flatnonzero(fits)
        if len(own):
            buf = np.frombuffer(b"".join([lines[i] for i in own.tolist()]) + bytes(16), np.uint8)
            least = lowest(_runs(buf, gram), size[own], gram)
            lone = mixed(key[own].view(np.uint64)[:, None] + np.arange(1, WIDTH + 1, dtype=np.uint64)).astype(np.uint16)
            sig = np.empty((len(own), 2 + WIDTH), np.uint16)
            sig[:, 0], sig[:, 1] = kind * 2 + (chars[own] <= TINY), np.minimum(chars[own], 65535)
            sig[:, 2:] = np.where(least == 0xFFFFFFFF, lone, least * np.uint32(0x9E3779B1) >> np.uint32(16))
            for i, row in zip(own.tolist(), sig, strict=True):
                out[i] = row.tobytes()
        found.append(out)
    return found[0], found[1]


def _marked(texts: list[str]) -> tuple:
    """(text index, line number, words, key, both signatures, the line if it is tiny) of the lines of LEAST_WORDS words or more."""
    owner, number, count, held = [], [], [], []
    for i, t in enumerate(texts):
        for k, x in enumerate(t.encode("utf-8").translate(NORMAL).split(b"\n")):
            own = x.split()
            if len(own) >= LEAST_WORDS:
                owner.append(i)
                number.append(k)
                count.append(len(own))
                held.append(b" ".join(own))
    if not held:
        return (np.zeros(0, np.int64),) * 4 + ([],) * 3
    key = np.frombuffer(b"".join([hashlib.blake2b(x, digest_size=8).digest() for x in held]), "<i8")
    tiny = [x.decode("utf-8") if len(x) <= 4 * TINY else "" for x in held]
    return np.array(owner), np.array(number), np.array(count), key, *_signatures(held, key), [x if len(x) <= TINY else "" for x in tiny]


def line_marks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = 1 << 19, order_col: str | None = None) -> DataFrame:
    """(doc_id, rank, line, key, short, long, tiny): of every line (between line feeds, from 0) of LEAST_WORDS words or more, a 64-bit hash of its normalised words, its signatures over short and long runs, and itself if it is tiny."""

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, ranks, texts = batch["doc_id"].astype("Int64").array, batch["rank"].astype("Int64").array, batch["text"].tolist()
            at = 0
            while at < len(texts):
                end, held = at, 0
                while end < len(texts) and (held < chunk or end == at):
                    held += len(texts[end])
                    end += 1
                with np.errstate(over="ignore"):
                    owner, number, _, key, short, long, tiny = _marked(texts[at:end])
                yield pd.DataFrame({"doc_id": ids[at:end][owner], "rank": ranks[at:end][owner], "line": number.astype(np.int32), "key": key, "short": short, "long": long, "tiny": tiny})
                at = end

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(order_col or id_col).cast("long").alias("rank"), text_or_empty(text_col).alias("text")).mapInPandas(mark, "doc_id long, rank long, line int, key long, short binary, long binary, tiny string")


def _agreement(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """In how many places two lines' signatures agree, over how many are needed; 1 at least for two tiny lines, 0 for lines of too different length. Takes rows of bytes."""
    p, q = np.ascontiguousarray(one).view(np.uint16), np.ascontiguousarray(others).view(np.uint16)
    share = (p[..., 2:] == q[..., 2:]).sum(axis=-1) / np.where(p[..., 0] & 2, LEAST_AGREEING[1], LEAST_AGREEING[0])
    share = np.where(p[..., 0] & q[..., 0] & 1 == 1, np.maximum(share, 1.0), share)
    short, long = np.minimum(p[..., 1], q[..., 1]), np.maximum(p[..., 1], q[..., 1])
    return np.where(short >= LEAST_SIMILARITY * long - 1e-9, share, 0.0)


def _node_keys(sig: np.ndarray) -> np.ndarray:
    """Of rows of bytes, a number for each node that a signature enters."""
    x = np.ascontiguousarray(sig).view(np.uint16)
    out = np.zeros((len(x), max(map(len, PICKED))), np.uint64)
    for kind, places in enumerate(PICKED):
        own = x[:, 0] >> 1 == kind
        made = np.zeros((int(own.sum()), len(places)), np.uint64)
        for k in range(places.shape[1]):
            made = made << np.uint64(16) | x[own][:, 2 + places[:, k]]
        out[own, : len(places)] = made
        out[own, len(places) :] = np.flatnonzero(own).astype(np.uint64)[:, None]  # no number that two lines share
    return out


def _halves(line: str) -> list[int]:
    """Numbers of the halves of a tiny line; the longer of two that differ by one edit stands under its own length and under one less."""
    made = []
    for n in (len(line), len(line) - 1):
        half = n // 2
        made += [f"head {n} {line[:half]}", f"tail {n} {line[len(line) - (n - half) :]}"]
    return [int.from_bytes(hashlib.blake2b(x.encode("utf-8"), digest_size=8).digest(), "little", signed=True) & ~1 | 1 << 62 for x in made]


def _nodes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(node, v) of lines (v, short, long, tiny): even numbers for short runs and halves, odd ones for long runs. Of lines that are tiny, those of ten characters or more have nodes."""
    v = batch.column("v").to_numpy()
    tiny = batch.column("tiny").to_pylist()
    length = np.array([len(x) for x in tiny])
    found = [(np.array(_halves(tiny[i]), np.int64), np.full(4, v[i])) for i in np.flatnonzero(length >= 10).tolist()]
    for kind, (name, places) in enumerate(zip(("short", "long"), PICKED, strict=True)):
        sig = batch.column(name)
        own = np.flatnonzero(sig.is_valid().to_numpy(zero_copy_only=False) & ((length == 0) | (length >= 10) & (kind == 0)))
        if len(own):
            held = np.frombuffer(b"".join(sig.take(pa.array(own)).to_pylist()), np.uint8).reshape(len(own), -1)
            number = _node_keys(held)[:, : len(places)] << np.uint64(1) | np.arange(len(places), dtype=np.uint64) << np.uint64(50) | np.uint64(kind)
            found.append((number.reshape(-1).view(np.int64), np.repeat(v[own], len(places))))
    return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2


def _signature() -> Column:
    """Of a row (node, short, long), the signature that its node goes by."""
    return F.when(F.col("node").bitwiseAND(1) == 1, F.col("long")).otherwise(F.col("short")).alias("sig")


def _shared_head(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def within_distance(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is at most `most`. Shared ends are cut off; of the rest, a column of the distance table is kept as two whole numbers of one bit a row, for steps up and down."""
    if abs(len(a) - len(b)) > most:
        return False
    head = _shared_head(a, b)
    a, b = a[head:], b[head:]
    tail = _shared_head(a[::-1], b[::-1])
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not a or not b:
        return max(len(a), len(b)) <= most
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, distance, left = full, 0, len(a), len(b)
    for c in b:
        same = places.get(c, 0)
        across = (((same & up) + up) ^ up) | same
        rises, falls = (down | ~(across | up)) & full, up & across
        distance += (rises & top > 0) - (falls & top > 0)
        left -= 1
        if distance - left > most:
            return False
        rises, keep = (rises << 1 | 1) & full, same | down
        up, down = (falls << 1 | ~(keep | rises)) & full, rises & keep
    return distance <= most


def _as_many_words(a: str, b: str) -> int:
    """No less than the edit distance: words are exchanged one for one; without as many words, all characters."""
    p, q = a.split(" "), b.split(" ")
    if len(p) != len(q):
        return max(len(a), len(b))
    return sum(max(len(x), len(y)) for x, y in zip(p, q, strict=True) if x != y)


def _similar(least: float):
    """Whether the edit distance of two normalised lines is within 1 - least of the longer one's length."""

    def similar(a: str, b: str) -> bool:
        most = int((1 - least) * max(len(a), len(b)) + 1e-9)
        return abs(len(a) - len(b)) <= most and (_as_many_words(a, b) <= most or within_distance(a, b, most))

    return similar


def _most(lines: list[str], one: np.ndarray, two: np.ndarray, least: float) -> np.ndarray:
    """The edits that pairs of places in lines may differ by."""
    size = np.array([len(x) for x in lines])
    return ((1 - least) * np.maximum(size[one], size[two]) + 1e-9).astype(np.int64)


def _all_within(least: float):
    """Whether pairs of places in lines are within that similarity."""
    return lambda lines, one, two: all_within(lines, one, two, _most(lines, one, two, least), within_distance)


def _all_worded(least: float):
    """Pairs of places in lines that are so by exchanged words alone."""

    def worded(lines: list[str], one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return np.array([_as_many_words(lines[p], lines[q]) <= t for p, q, t in zip(one.tolist(), two.tolist(), _most(lines, one, two, least).tolist(), strict=True)], bool)

    return worded


def _all_similar(least: float):
    """The same of many pairs of places in lines."""
    worded, within = _all_worded(least), _all_within(least)

    def similar(lines: list[str], one: np.ndarray, two: np.ndarray) -> np.ndarray:
        found = worded(lines, one, two)
        found[~found] = within(lines, one[~found], two[~found])
        return found

    return similar


def _possible(least: float):
    """Of lines and pairs of places in them, which pairs hold nearly the same letters and nearly the same pairs of letters, whatever their order: an edit takes away and adds a letter and two pairs of them at most, so what differs by more can't be similar."""

    def possible(lines: list[str], one: np.ndarray, two: np.ndarray) -> np.ndarray:
        raw = [x.encode("utf-32-le") for x in lines]
        size = np.array([len(x) // 4 for x in raw])
        letters, owner = np.frombuffer(b"".join(raw), np.uint32), np.repeat(np.arange(len(lines)), size)
        out = np.ones(len(one), bool)
        for edit, bins in ((2, 64), (4, 1024)):
            kept, own = owner, letters
            if edit == 4:
                inside = owner[1:] == owner[:-1]
                kept, own = owner[1:][inside], (letters[:-1] * np.uint32(37) + letters[1:])[inside]
            count = np.minimum(np.bincount(kept * bins + own % bins, minlength=bins * len(lines)), 30000).astype(np.int16).reshape(-1, bins)
            left = np.flatnonzero(out)
            for at in range(0, len(left), 1024):
                x = left[at : at + 1024]
                p, q = one[x], two[x]
                most = ((1 - least) * np.maximum(size[p], size[q]) + 1e-9).astype(np.int64)
                out[x] = np.abs(count[p] - count[q]).sum(axis=1, dtype=np.int64) <= edit * most
        return out

    return possible


def _confirmed(pairs: DataFrame, lines: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of lines that may be linked, of pairs (a, b, kind); kind is 1 where they met over long runs."""

    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        similar, possible = _all_similar(least), _possible(least)
        for x in batches:
            if not len(x):
                continue
            row = lambda c: np.frombuffer(b"".join(x[c]), np.uint8).reshape(len(x), -1)  # noqa: E731, B023
            near = _agreement(row("sig_a"), row("sig_b")) >= 1
            for judge in (possible, similar):
                near[near] = judge([*x["line_a"][near], *x["line_b"][near]], *np.arange(2 * near.sum()).reshape(2, -1))
            yield x.loc[near, ["a", "b"]]

    side = lambda c: lines.select(F.col("v").alias(c), F.col("short").alias(f"short_{c}"), F.col("long").alias(f"long_{c}"), F.col("normal").alias(f"line_{c}"))
    own = [F.when(F.col("kind") == 1, F.col(f"long_{c}")).otherwise(F.col(f"short_{c}")).alias(f"sig_{c}") for c in "ab"]
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "line_a", "line_b", *own).mapInPandas(confirm, "a long, b long")


def removed_lines(docs: DataFrame, least: float = LEAST_SIMILARITY, small: int = SMALL, id_col: str = "doc_id", text_col: str = "text", order_col: str | None = None) -> DataFrame:
    """(doc_id, line) of the lines to remove: all but the first occurrence, by (order_col, id_col, line), of each connected group of similar lines.

    Lines whose normalised words are equal are one vertex. Each line is linked to the smallest one it shares a node with, where that holds;
    nodes that still hold several components are then compared exhaustively, large ones in pairs of blocks. Lines without a word
    are never removed. Null ids come first. id_col should tell rows apart (see numbered): rows of one id are one document, whose equal lines at one place count once. Null text has no lines.
    """
    marks = written(line_marks(docs, id_col, text_col, order_col=order_col), "lines")
    some = [F.min(c).alias(c) for c in ("short", "long", "tiny")]
    unique = written(marks.groupBy(F.col("key").alias("v")).agg(F.min(F.struct("rank", "doc_id", "line")).alias("first"), F.count(F.lit(1)).alias("n"), *some), "unique")
    sigs = unique.select("v", "short", "long")
    shared = met(unique.select("v", "short", "long", "tiny"), _nodes, max(64, unique.count() // LINES)).join(sigs, "v").select("node", "v", _signature())
    close = written(with_partner(shared, _agreement, 1), "close")
    members = written(close.join(close.groupBy("node").agg(F.min("v").alias("star")), "node"), "members")
    forget(close)

    involved = written(members.select("v").distinct().join(unique.select("v", "first"), "v").groupBy(F.col("first.doc_id").alias("_doc")).agg(F.collect_list(F.struct(F.col("first.line").alias("line"), "v")).alias("_lines")), "wanted")
    text = docs.select(F.col(id_col).cast("long").alias("_id"), F.split(text_or_empty(text_col), "\n").alias("_parts"))
    text = text.join(small_side(involved.select("_doc"), involved.count(), 250_000), F.col("_id").eqNullSafe(F.col("_doc")), "left_semi").join(involved, F.col("_id").eqNullSafe(F.col("_doc")))
    found = text.select(F.explode(F.transform("_lines", lambda x: F.struct(x["v"].alias("v"), F.get(F.col("_parts"), x["line"]).alias("line")))).alias("x")).select("x.*")
    normal = F.trim(F.regexp_replace(F.lower("line"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    lines = written(found.where("line IS NOT NULL").select("v", normal.alias("normal")).dropDuplicates(["v"]).join(sigs, "v"), "involved")

    star = members.groupBy(F.col("v").alias("b"), F.col("node").bitwiseAND(1).alias("kind")).agg(F.min("star").alias("a")).where("a < b")
    links = written(_confirmed(star, lines, least), "links")
    labels = components(links)
    leaf = leaves(members.select("node", "v", F.lit(1).alias("w")), labels, small)
    more = written(links_within(leaf.join(lines, "v").withColumn("sig", _signature()), "normal", _agreement, 1, list, _all_within(least), _node_keys, _possible(least), TOGETHER, _all_worded(least)), "more")
    if not more.isEmpty():
        labels = components(links.union(more))
    labels = written(labels, "labels")
    forget(members, involved, lines, links, more)

    grouped = unique.join(labels, "v", "left").where("c IS NOT NULL OR n > 1").withColumn("c", F.coalesce("c", "v"))  # other lines are alone
    groups = grouped.groupBy("c").agg(F.min("first").alias("kept"), F.sum("n").alias("lines")).where("lines > 1")
    decided = grouped.select("v", "c").join(groups, "c").select(F.col("v").alias("key"), "kept")
    gone = marks.select("rank", "doc_id", "line", "key").join(decided, "key").where(~F.struct("rank", "doc_id", "line").eqNullSafe(F.col("kept")))
    return gone.select("doc_id", "line").distinct()


def _gone(rows: DataFrame, collect) -> DataFrame:
    """(_row, _gone): of numbered rows, those that lose lines, and these."""
    removed = removed_lines(rows.select("_row", "doc_id", "text"), id_col="_row", order_col="doc_id")
    return removed.groupBy(F.col("doc_id").alias("_row")).agg(collect("line").alias("_gone"))


def line_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed), a row for each row of docs: its lines (an empty or null text has one) and the numbers of those that go; an empty table gives an empty result."""
    rows = numbered(docs.select("doc_id", "text"))
    counted = rows.select("_row", "doc_id", F.size(F.split(text_or_empty(), "\n")).cast("long").alias("n_lines"))
    out = counted.join(_gone(rows, F.collect_list), "_row", "left").withColumn("removed", F.coalesce(F.array_sort("_gone"), F.array().cast("array<int>")))
    return out.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed")


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs with the lines removed and n_chars, if it is there, set anew. A document all of whose lines with a word go is itself removed: every line of it stands elsewhere. Null and empty texts stay. Columns may have any names."""
    rows = numbered(docs.select("doc_id", "text", F.struct(F.lit(1).alias("_one"), *[F.col(f"`{c}`") for c in docs.columns]).alias("row")))
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("_gone", i)), "\n")
    out = rows.join(_gone(rows, F.collect_set), "_row", "left").withColumn("_text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(kept))
    out = out.where(F.col("_gone").isNull() | F.col("_text").rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.col("_text"), "n_chars": F.when(F.col("_gone").isNull(), F.col("row.n_chars")).otherwise(F.length("_text").cast("long"))}
    return out.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
