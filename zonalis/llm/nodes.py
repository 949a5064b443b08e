"""Groups of candidates, called nodes: which still hold several components, and comparing what they hold."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonalis.llm.shared import written
from zonalis.llm.shingles import mixed

#: Where many pairs are judged at once, nodes are taken together until they hold so many rows or so many characters.
ROWS, CHARS = 40_000, 1 << 24


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows (v, ...) with c, v's component; its own where labels (v, c) has none."""
    return rows.join(labels, "v", "left").withColumn("c", F.coalesce("c", "v"))


def mixed_nodes(rows: DataFrame) -> DataFrame:
    """(node, n): of rows (v, node, c, w), the nodes that hold more than one component, and the weight of what they hold; of nodes that hold the same, one."""
    nodes = rows.groupBy("node").agg(F.sum("w").alias("n"), F.bit_xor(F.xxhash64("v")).alias("same"), F.min("c").alias("_low"), F.max("c").alias("_high")).where("_low < _high")
    return nodes.groupBy("same", "n").agg(F.min("node").alias("node")).select("node", "n")


def below(*parts) -> Column:
    """The number of a node below `node`. It is odd if the node's is."""
    return F.xxhash64("node", *parts).bitwiseAND(-2).bitwiseOR(F.col("node").bitwiseAND(1))


def in_blocks(large: DataFrame, small: int) -> DataFrame:
    """(node, v, c, part): each node of large (node, n, v, c) dealt into blocks, and every block and every two blocks as a node of about `small` in weight at most, so that all its pairs meet; part is the row's block."""
    blocks = F.ceil(F.col("n") * 2 / small).cast("int")
    own = F.pmod(F.xxhash64("v", F.lit(3)), blocks).cast("int")
    paired = F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: below(F.least(own, o), F.greatest(own, o)))
    return large.select("v", "c", own.alias("part"), F.explode(paired).alias("node")).select("node", "v", "c", "part")


def around_largest(large: DataFrame, small: int) -> DataFrame:
    """(node, v, c, part) of nodes (node, v, c, heavy, weight) nearly all of which is one component, heavy, of that weight: it is dealt into blocks, the few other rows meet each block and each other. Pairs inside the component need no comparing, so this grows with the node's size only."""
    blocks = F.greatest(F.ceil(F.col("weight") / small), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("v", F.lit(3)), blocks).cast("int")
    inside = large.where("c = heavy").select(below(F.lit("block"), own).alias("node"), "v", "c", F.lit(0).alias("part"))
    met = F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.struct(below(F.lit("block"), o).alias("node"), F.lit(1).alias("part")))
    among = F.array(F.struct(below(F.lit("others")).alias("node"), F.lit(0).alias("part")))
    others = large.where("c <> heavy").select("v", "c", F.explode(F.concat(met, among)).alias("x")).select("x.node", "v", "c", "x.part")
    return inside.union(others)


def leaves(rows: DataFrame, labels: DataFrame, small: int) -> DataFrame:
    """(node, v, c, part) of the nodes to compare, from rows (node, v, w): those of a weight of at most `small` that hold several components.

    A larger node of which one component takes all but `small` is compared around that component; others are dealt into pairs of blocks. So any two rows of a node that are not of one
    component meet for certain, however large it is; nothing is drawn.
    """
    rows = labelled(rows, labels)
    kept = written(rows.join(mixed_nodes(rows), "node"), "mixed")
    out = kept.where(F.col("n") <= small).select("node", "v", "c", F.lit(0).alias("part"))
    large = kept.where(F.col("n") > small)
    if large.isEmpty():
        return out
    heaviest = large.groupBy("node", "c").agg(F.sum("w").alias("k")).groupBy("node").agg(F.max(F.struct("k", "c")).alias("m")).select("node", F.col("m.k").alias("weight"), F.col("m.c").alias("heavy"))
    large = written(large.join(heaviest, "node"), "large")
    one = F.col("n") - F.col("weight") <= small
    return out.union(around_largest(large.where(one), small)).union(in_blocks(large.where(~one), small))


def met(rows: DataFrame, nodes: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], buckets: int) -> DataFrame:
    """(node, v) of nodes that hold more than one vertex; `nodes` makes two arrays of them, each pair once, of a batch of rows. Pairs are dealt into buckets by their node and packed, a row for each batch and bucket, since most nodes
    hold one vertex and go nowhere. A task holds one bucket, so buckets should grow in number with the rows."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, v = nodes(batch)
            if not len(node):
                continue
            with np.errstate(over="ignore"):
                bucket = (mixed(node.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            bucket, pairs = bucket[order], np.stack([node[order], v[order]], axis=1)
            starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            packed = [pairs[x:y].tobytes() for x, y in zip(starts.tolist(), [*starts[1:].tolist(), len(pairs)], strict=True)]
            yield pa.record_batch([pa.array(bucket[starts]), pa.array(packed, pa.binary())], ["bucket", "pairs"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for bucket, pairs in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if bucket != now:
                    yield from of(held)
                    now, held = bucket, []
                held.append(pairs.as_buffer())
        yield from of(held)

    def of(held: list) -> Iterator[pa.RecordBatch]:
        if held:
            node, v = np.frombuffer(b"".join(held), np.int64).reshape(-1, 2).T
            order = np.argsort(node)
            node = node[order]
            same = np.concatenate([[False], node[1:] == node[:-1], [False]])
            more = same[1:] | same[:-1]
            found = np.flatnonzero(more)
            for at in range(0, len(found), 10_000):
                part = found[at : at + 10_000]
                yield pa.record_batch([pa.array(node[part]), pa.array(v[order[part]])], ["node", "v"])

    packed = rows.mapInArrow(dealt, "bucket int, pairs binary")
    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(shared, "node long, v long")


def with_partner(members: DataFrame, score: Callable[[np.ndarray, np.ndarray], np.ndarray], least: float, most: int = 2048) -> DataFrame:
    """(node, v): of members (node, v, sig), those that score `least` or more with another of their node; all of a node that a batch ends with and that has more than `most` so far."""

    def partner(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, whole = None, None
        for batch in batches:
            if whole is not None:  # more of a node all of which goes on
                more = (batch["node"] == whole).to_numpy()
                yield batch.loc[more, ["node", "v"]]
                batch = batch[~more]
            batch = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if not len(batch):
                continue
            last = (batch["node"] == batch["node"].iloc[-1]).to_numpy()
            yield of(batch[~last])
            held, whole = batch[last], None
            if len(held) > most:
                yield held[["node", "v"]]
                held, whole = None, held["node"].iloc[0]
        if held is not None:
            yield of(held)

    def of(x: pd.DataFrame) -> pd.DataFrame:
        if not len(x):
            return x[["node", "v"]]
        node, sig = x["node"].to_numpy(), np.frombuffer(b"".join(x["sig"]), np.uint8).reshape(len(x), -1)
        found = np.zeros(len(x), bool)
        for step in range(1, len(x)):
            at = np.flatnonzero(node[:-step] == node[step:])
            if not len(at):
                break
            at = at[~(found[at] & found[at + step])]
            near = at[score(sig[at], sig[at + step]) >= least]
            found[near] = found[near + step] = True
        return x.loc[found, ["node", "v"]]

    return members.select("node", "v", "sig").repartition("node").sortWithinPartitions("node").mapInPandas(partner, "node long, v long")


def links_within(members: DataFrame, payload: str, score: Callable[[np.ndarray, np.ndarray], np.ndarray], least: float, prepare: Callable[[pd.Series], list], alike: Callable[[list, np.ndarray, np.ndarray], Iterable[bool]], keys: Callable[[np.ndarray], np.ndarray] | None = None, possible: Callable[[list, np.ndarray, np.ndarray], np.ndarray] | None = None, together: int = 1, sure: Callable[[list, np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(a, b): of members (node, v, c, part, sig, payload), confirmed links of each node that join what were different components c.

    Every pair of different components whose signatures score `least` or more is confirmed by `alike`, on all that `prepare` makes of payloads and the pairs' places in it, the
    likeliest pairs first and `together` at once at most, but for those that links found before already join. So a node yields fewer links than it has members, however alike
    they are. Of any two components one pair goes first, then four, then all, so that few are judged in vain; sure, of the same, tells cheaply of some pairs that they are alike. Pairs within a part of a node of two parts are left to that part's own node. If nodes hold what shares one of the numbers that `keys` makes of sig,
    a pair that also shares a number before those which its whole node shares is left to the node of that number. possible, of the same,
    tells cheaply which pairs may be alike at all. score takes two matrices of rows of bytes. Nodes are bounded in weight and come sorted; a task holds
    one batch and the node that it ends in, or, where pairs go together, batches up to ROWS rows or CHARS characters.
    """

    def of_nodes(x: pd.DataFrame) -> pd.DataFrame:
        node, v, part, sig = x["node"].to_numpy(), x["v"].to_numpy(), x["part"].to_numpy(), np.frombuffer(b"".join(x["sig"]), np.uint8).reshape(len(x), -1)
        c = np.unique(x["c"].to_numpy(), return_inverse=True)[1]
        starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        size = np.diff(np.append(starts, len(node)))
        own = keys(sig) if keys else None
        whole = np.repeat(np.minimum.reduceat(part, starts) == np.maximum.reduceat(part, starts), size)
        first = np.repeat(np.logical_and.reduceat(own == own[np.repeat(starts, size)], starts, axis=0).argmax(axis=1), size) if keys else None
        tries = [np.zeros((3, 0))]
        at = np.arange(len(node))
        for step in range(1, int(size.max())):
            at = at[at + step < len(node)]
            at = at[node[at] == node[at + step]]
            i = at[(c[at] != c[at + step]) & (whole[at] | (part[at] != part[at + step]))]
            if keys and len(i):
                i = i[~((own[i] == own[i + step]) & (np.arange(own.shape[1]) < first[i, None])).any(axis=1)]
            if len(i):
                got = score(sig[i], sig[i + step])
                near = got >= least
                tries.append(np.stack([got[near], i[near], i[near] + step]))
        tried = np.concatenate(tries, axis=1)
        pairs = tried[1:, np.argsort(-tried[0], kind="stable")].astype(np.int32)
        if not pairs.shape[1]:
            return pd.DataFrame([], columns=["a", "b"], dtype="int64")
        # a vertex stands in several nodes of a batch; its pairs are tried once
        vertex = np.unique(v, return_inverse=True)[1]
        low, high = np.minimum(vertex[pairs[0]], vertex[pairs[1]]), np.maximum(vertex[pairs[0]], vertex[pairs[1]])
        pairs = pairs[:, np.sort(np.unique(low.astype(np.int64) * len(v) + high, return_index=True)[1])]
        used, place = np.unique(vertex[pairs], return_inverse=True)
        place = place.reshape(2, -1)
        one = np.full(len(v), -1)
        one[vertex[::-1]] = np.arange(len(v))[::-1]
        made = prepare(x[payload].iloc[one[used]])
        if possible:
            fine = possible(made, place[0], place[1])
            pairs, place = pairs[:, fine], place[:, fine]
        root = list(range(int(c.max()) + 1))

        def find(k: int) -> int:
            while root[k] != k:
                root[k] = k = root[root[k]]
            return k

        links = []

        def join(fine: np.ndarray) -> None:
            for i, j, p, q in zip(*c[pairs[:, fine]].tolist(), *place[:, fine].tolist(), strict=True):
                i, j = find(i), find(j)
                if i != j:
                    root[max(i, j)] = min(i, j)
                    links.append((p, q))

        left, several = np.arange(pairs.shape[1]), 1
        if sure:
            join(left[sure(made, *place)])
        for k in left.tolist() if together == 1 else []:
            i, j = c[pairs[:, k]].tolist()
            if find(i) != find(j):
                join(np.array([k])[np.fromiter(alike(made, *place[:, [k]]), bool, 1)])
        while together > 1 and len(left):
            low, high = np.sort(np.array([find(k) for k in range(len(root))])[c[pairs[:, left]]], axis=0)
            left, ends = left[low != high], (low.astype(np.int64) * len(root) + high)[low != high]
            if not len(left):
                break
            order = np.argsort(ends, kind="stable")
            starts = np.flatnonzero(np.concatenate([[True], np.diff(ends[order]) > 0]))
            nth = np.empty(len(left), np.int64)
            nth[order] = np.arange(len(left)) - np.repeat(starts, np.diff(np.append(starts, len(left))))
            now = np.flatnonzero(nth < several)[:together]
            join(left[now][np.fromiter(alike(made, *place[:, left[now]]), bool, len(now))])
            left, several = np.delete(left, now), several * (4 if several < 4 else len(v))
        found = v[one[used]][np.array(links, np.int64).reshape(-1, 2)]
        return pd.DataFrame(found, columns=["a", "b"])

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chars = lambda x: sum(map(len, x[payload]))
        held, rows, size = [], 0, 0
        for batch in batches:
            held.append(batch)
            rows, size = rows + len(batch), size + (chars(batch) if together > 1 else 0)
            if together == 1 or rows >= ROWS or size >= CHARS:
                batch = pd.concat(held, ignore_index=True) if len(held) > 1 else batch
                last = (batch["node"] == batch["node"].iloc[-1]).to_numpy() if len(batch) else np.zeros(0, bool)
                held = [batch[last]]
                rows, size = len(held[0]), chars(held[0]) if together > 1 else 0
                if not last.all():
                    yield of_nodes(batch[~last])
        if rows:
            yield of_nodes(pd.concat(held, ignore_index=True))

    return members.repartition("node").sortWithinPartitions("node").select("node", "v", "c", "part", "sig", payload).mapInPandas(link, "a long, b long")
