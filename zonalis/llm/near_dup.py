"""MinHash near-duplicates by chosen-path similarity join: trees that branch documents by selected minwise tokens, small nodes compared exhaustively, links confirmed on full shingle sets."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonalis.llm.components import components
from zonalis.llm.nodes import leaves, links_within
from zonalis.llm.shared import forget, numbered, text_or_empty, written
from zonalis.llm.shingles import MinHash, shingle_sets

#: Places of a signature; how many of them a branch takes; trees; weight of a small node; how deep a tree grows.
WIDTH, STEP, TREES, SMALL = 64, 3, 20, 2048
#: Children of a large node. A pair at similarity 0.8 enters each with a chance of 0.512, so with three it stays together in one or more with a chance that never falls under 0.78.
CHILDREN = 3
#: A document weighs one, and one more for each so many bytes of text, so that what a task holds of a node is bounded.
HEAVY = 1 << 15
#: Pairs whose signatures agree in fewer places are not confirmed: four deviations below a similarity of 0.8.
LEAST_AGREEING = 0.6


def profiles(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, w, mark, sig): set size, weight, 128-bit digest of the set as hex, signature (null for empty sets)."""

    def profile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        minhash = MinHash(WIDTH)
        for batch in batches:
            rows = [(len(s), hashlib.md5(s.tobytes()).hexdigest() if len(s) else None, minhash(s) if len(s) else None) for s in shingle_sets(batch["text"], size)]
            out = pd.DataFrame(rows, columns=["n_shingles", "mark", "sig"])
            out.insert(0, "w", [1 + len(t) // HEAVY for t in batch["text"]])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").array)
            yield out

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInPandas(profile, "doc_id long, w int, n_shingles long, mark string, sig binary")


def _token(sig: Column, place: Column) -> Column:
    return F.substr(sig, place * 4 + 1, F.lit(4))


def _branches(rows: DataFrame, above: list[Column], children: int) -> DataFrame:
    """(v, w, node) of the next level. A child is known by its parent and the tokens at STEP places that the parent's hash selects."""
    made = []
    for child in range(children):
        places = [F.pmod(F.xxhash64(*above, F.lit(child), F.lit(k)), F.lit(WIDTH)).cast("int") for k in range(STEP)]
        made.append(F.xxhash64(*above, F.lit(child), *[_token(F.col("sig"), p) for p in places]))
    return rows.select("v", "w", F.explode(F.array(*made)).alias("node"))


def _sizes(rows: DataFrame) -> DataFrame:
    """Nodes of two or more documents: n and first (the smallest document)."""
    return rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("first")).where("n > 1")


def _alike(p: np.ndarray, q: np.ndarray, share: tuple[int, int]) -> bool:
    if not len(p) or share[1] * min(len(p), len(q)) < share[0] * max(len(p), len(q)):
        return False
    common = len(np.intersect1d(p, q, assume_unique=True))
    return share[1] * common >= share[0] * (len(p) + len(q) - common)


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, share: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets satisfy share[1] * intersection >= share[0] * union."""

    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.iloc[at : at + 512]
                sets = {t: s for both in [list(set(part["text_a"]) | set(part["text_b"]))] for t, s in zip(both, shingle_sets(both, size), strict=True)}
                keep = []
                for x, y in zip(part["text_a"], part["text_b"], strict=True):
                    keep.append(_alike(sets[x], sets[y], share))
                yield part.loc[keep, ["a", "b"]]

    left = pairs.join(texts.select(F.col("v").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("v").alias("b"), F.col("text").alias("text_b")), "b")
    return both.mapInPandas(confirm, "a long, b long")


def _agreeing(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """pairs (a, b) whose signatures agree in enough places, with that share as `agree`."""

    def agree(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            read = lambda c: np.frombuffer(b"".join(x[c]), np.uint32).reshape(len(x), WIDTH)  # noqa: E731, B023
            share = (read("sig_a") == read("sig_b")).mean(axis=1)
            yield pd.DataFrame({"a": x["a"], "b": x["b"], "agree": share})[share >= LEAST_AGREEING]

    side = lambda c: reps.select(F.col("v").alias(c), F.col("sig").alias(f"sig_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(agree, "a long, b long, agree double")


def _same_places(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    return (np.ascontiguousarray(one).view(np.uint32) == np.ascontiguousarray(others).view(np.uint32)).mean(axis=1)


def linked_documents(docs: DataFrame, size: int = 4, share: tuple[int, int] = (80, 100), trees: int = TREES, small: int = SMALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each row of docs.

    Documents with equal sets are one vertex, named by their smallest id. Every tree's first nodes are found; each node's documents are linked to
    its smallest one where that holds, so that large groups of copies become one component with as many checks as documents. What nodes still hold
    different components is compared exhaustively, large nodes around their largest component or in pairs of blocks. A pair at similarity 0.8 shares a first node with a chance of 0.512 a tree.

    Null text, or one without words: an empty set, linked with nothing. A null id belongs to the component of the ids that share its set; where only null ids
    have a set, it is linked with nothing and its component is null.
    Rows of one id are one vertex. An empty table gives an empty result.
    """
    table = written(profiles(docs, size, id_col, text_col), "profiles")
    classes = written(table.where("mark IS NOT NULL").groupBy("mark").agg(F.min("doc_id").alias("v"), F.min_by("sig", "doc_id").alias("sig"), F.max("w").alias("w")).where("v IS NOT NULL"), "classes")
    reps = classes.select("v", "sig", "w")

    places = [random.Random(t).sample(range(WIDTH), STEP) for t in range(trees)]
    first = reps.select("v", "w", F.explode(F.array(*[F.xxhash64(F.lit(t), *[_token(F.col("sig"), F.lit(p)) for p in places[t]]) for t in range(trees)])).alias("node"))
    nodes = written(_sizes(first), "nodes")
    members = written(first.join(nodes.select("node", "first"), "node").select("node", "v", "w", "first"), "members")

    involved = members.select("v").distinct()
    named = docs.select(F.col(id_col).cast("long").alias("v"), text_or_empty(text_col).alias("text"))
    texts = written(named.join(involved, "v").dropDuplicates(["v", "text"]), "texts")

    star = members.where("v <> first").select(F.col("first").alias("a"), F.col("v").alias("b")).distinct()
    links = written(_confirmed(_agreeing(star, reps).select("a", "b"), texts, size, share), "links0")
    labels = components(links)

    leaf = leaves(members.select("node", "v", "w"), labels, small)
    held = leaf.join(reps.drop("w"), "v").join(texts, "v")
    new = written(links_within(held, "text", _same_places, LEAST_AGREEING, lambda t: list(shingle_sets(t, size)), lambda sets, one, two: [_alike(sets[i], sets[j], share) for i, j in zip(one, two, strict=True)]), "links1")
    if not new.isEmpty():
        labels = components(links.union(new))
    labels = written(labels, "labels")
    forget(nodes, members, texts, links, new)

    named = classes.select("mark", "v").join(labels, "v", "left").select("mark", F.coalesce("c", "v").alias("c"))
    out = table.select("doc_id", "n_shingles", "mark").join(named, "mark", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("c", "doc_id").alias("component_id"))


def near_dup_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of docs; nulls, repeats and the empty table as linked_documents has them."""
    return linked_documents(docs.select("doc_id", "text")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each_group(docs: DataFrame, size: int = 5) -> DataFrame:
    """docs without near-duplicates: of each component the row with the smallest id stays, null ids last, of rows of one id the first. Rows without words stay; an empty table gives an empty one. Columns may have any names."""
    rows = numbered(docs.select("doc_id", "text", F.struct(F.lit(1).alias("_one"), *[F.col(f"`{c}`") for c in docs.columns]).alias("row")))
    linked = linked_documents(rows.select("_row", "text"), size, id_col="_row").select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_c"))
    placed = written(rows.select("_row", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row").alias("_place")).join(linked, "_row"), "placed")
    stays = placed.groupBy("_c").agg(F.min("_place").alias("_kept")).select(F.col("_kept._row").alias("_row"))
    return rows.join(stays, "_row", "left_semi").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
