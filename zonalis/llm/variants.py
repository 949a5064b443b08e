"""Spelling variant grouping by Aho-Corasick halves: one edit leaves a half of a word whole, so every word's halves are held by automata, through which all words that may hold one are run; length and place are checked and the edit verified."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonalis.llm.shared import LOWER, UPPER, forget, small_side, text_or_empty, written

#: What words are made of; one word in DAMAGED of each document's loses a character; the least length and number of occurrences; how much more frequent a form is than its variants.
RUN = re.compile("[a-zÀ-ÿ]+")
DAMAGED, LEAST_LENGTH, LEAST_COUNT, TIMES = 97, 5, 3, 2
#: A key with more words than this is split into finer ones.
MOST = 96
#: Between the ends of a word where it is written round: suffix, RING, prefix. No word holds it.
RING = "\0"

_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words of docs that are long and frequent enough.

    Words are runs of letters, A-Z lower-cased; where DAMAGED divides the CRC-32 of `id:run`, the run loses the code point at crc % length. A null id counts as empty, a null or empty text has no words; texts are whole.
    Equal words of one Arrow batch are counted before they leave it, and again before they are shuffled.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            total: Counter[str] = Counter()
            for i, text in zip(x["id"], x["text"], strict=True):
                head = zlib.crc32(f"{i}:".encode())
                # bytes of A-Z stand for nothing else in UTF-8
                for run, n in Counter(RUN.findall(text.encode("utf-8").translate(_LOWER).decode("utf-8"))).items():
                    crc = zlib.crc32(run.encode("utf-8"), head)
                    if crc % DAMAGED == 0:
                        at = crc % len(run)
                        run = run[:at] + run[at + 1 :]  # noqa: PLW2901
                    if len(run) >= least_length:
                        total[run] += n
            yield pd.DataFrame({"word": list(total.keys()), "n": np.fromiter(total.values(), np.int64, len(total))})

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def differ_by_one(a: str, b: str) -> bool:
    """Whether exactly one code point is inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = 0
    for p, q in zip(a, b, strict=False):
        if p != q:
            break
        at += 1
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def _keyed(rows: DataFrame, windows: Column) -> DataFrame:
    """(key, word, n, size, head, tail) of rows (word, n, ...) and their array of windows (struct size, head, tail): what lies between a word's first `head` and last `tail` code points, for words of `size`. The key is of what lies outside. A row of its word's own size is a pattern, and every row a probe."""
    made = rows.select("word", "n", F.explode(windows).alias("x")).select("word", "n", "x.*").where(F.col("head") + F.col("tail") <= F.length("word"))
    outside = [F.substr("word", F.lit(1), F.col("head")), F.substr("word", F.length("word") - F.col("tail") + 1)]
    return made.select(F.xxhash64("size", "head", "tail", *outside).alias("key"), "word", "n", "size", "head", "tail")


def _window(size: Column, head: Column, tail: Column) -> Column:
    return F.struct(size.cast("int").alias("size"), head.cast("int").alias("head"), tail.cast("int").alias("tail"))


def _halves(words: DataFrame) -> DataFrame:
    """Rows of words (word, n) with either half as the window, for patterns of the word's length, one less and one more."""
    n, none = F.length("word"), F.lit(0)
    return _keyed(words, F.array(*[w for size in (n - 1, n, n + 1) for half in [F.floor(size / 2)] for w in (_window(size, half, none), _window(size, none, size - half))]))


def _finer(rows: DataFrame) -> DataFrame:
    """Rows whose window is halved, each half a window of its own. What one edit changes lies in one of them."""
    size, head, tail = F.col("size"), F.col("head"), F.col("tail")
    middle = head + F.floor((size - head - tail) / 2)
    return _keyed(rows, F.array(_window(size, head, size - middle), _window(size, middle, tail)))


def _found(x: pd.DataFrame) -> pd.DataFrame:
    """(word, near, near_n) of a shard, which is some keys' rows: an automaton of its patterns, their outsides written round (suffix, RING, prefix), through which its probes go, written round too; what is found at the ring has its place, then length and window are checked."""
    held = ahocorasick.Automaton()
    known: dict[str, dict[int, list[tuple[str, str, int]]]] = {}
    place: dict[str, tuple[int, int]] = {}
    for w, n, head, tail in x.loc[x["word"].str.len() == x["size"], ["word", "n", "head", "tail"]].itertuples(index=False, name=None):
        outside = w[len(w) - tail :] + RING + w[:head]
        place[outside] = (head, tail)
        known.setdefault(outside, {}).setdefault(len(w), []).append((w[head : len(w) - tail], w, n))
    out: list[tuple[str, str, int]] = []
    for outside in known:
        held.add_word(outside, outside)
    if known:
        held.make_automaton()
        for u in x["word"].unique().tolist():
            for _, outside in held.iter(u + RING + u):
                head, tail = place[outside]
                if head + tail <= len(u):
                    window, own = u[head : len(u) - tail], known[outside]
                    out += [(u, w, n) for size in (len(u) - 1, len(u), len(u) + 1) for inside, w, n in own.get(size, ()) if differ_by_one(window, inside)]
    return pd.DataFrame(out, columns=["word", "near", "near_n"]).drop_duplicates()


def near_words(words: DataFrame, most: int = MOST) -> DataFrame:
    """(word, near, near_n) of words (word, n), all different: every pair that one edit tells apart, in both directions.

    A word goes only to the shards that may hold a half of it, not to all. A key that more than `most` words share is not compared: its words get two keys with the window halved, and again,
    down to one code point, where few words can meet. So no key gathers an unbounded group, and no pair is lost.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            x = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if not len(x):
                continue
            last = (x["key"] == x["key"].iloc[-1]).to_numpy()
            rest = x[last]
            if not last.all():
                yield _found(x[~last])
        if rest is not None:
            yield _found(rest)

    rows, found, level = written(_halves(words), "halves"), [], 0
    while True:
        keys = rows.groupBy("key").agg(F.count(F.lit(1)).alias("_all"), F.count_if(F.length("word") == F.col("size")).alias("_patterns"), F.max(F.col("size") - F.col("head") - F.col("tail")).alias("_window"))
        hot = written(keys.where((F.col("_all") > most) & (F.col("_patterns") > 0) & (F.col("_window") > 1)).select("key"), f"hot{level}")
        n = hot.count()
        few = rows.join(small_side(hot, n), "key", "left_anti") if n else rows
        pairs = few.repartition("key").sortWithinPartitions("key").select("key", "word", "n", "size", "head", "tail").mapInPandas(scan, "word string, near string, near_n long")
        found.append(written(pairs, f"pairs{level}"))
        if not n:
            forget(rows, hot)
            break
        before, rows, level = rows, written(_finer(rows.join(small_side(hot, n), "key", "left_semi")), f"halves{level + 1}"), level + 1
        forget(before, hot)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.groupBy("word", "near").agg(F.min("near_n").alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form), which never lead round in a circle: the last of the forms that follow each other. Each round doubles how far it sees."""
    step = written(forms.select("word", F.col("form").alias("root")), "step")
    while True:
        on = step.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        after = written(step.join(small_side(on, step.count()), "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_went")), "step")
        forget(step)
        step = after.select("word", "root")
        if after.where("_went").isEmpty():
            return step


def variant_groups(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, n, n_near, form, form_n, root), a row for each of words (word, n): the near words, the most frequent of them (ties: the first in order of code points) if it is at least `times` as frequent, and the last of the forms that follow each other; the word itself where it has none. No words, no rows."""
    words = written(words, "words")
    near = near_words(words)
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    led = words.join(best, "word", "left").withColumn("_leads", F.coalesce(-F.col("best.less") >= times * F.col("n"), F.lit(False)))
    own = lambda c: F.when(F.col("_leads"), c)
    table = written(led.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), own(F.col("best.near")).alias("form"), own(-F.col("best.less")).alias("form_n")), "led")
    last = roots(table.where("form IS NOT NULL"))
    return table.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variant_report(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of docs; odd documents as word_counts has them."""
    return variant_groups(word_counts(docs)).select("word", "form", "root", "n", "n_near", "form_n")
