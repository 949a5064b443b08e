"""Secret scans: spans of known patterns, and tokens that a character Markov model of random strings explains better than one of ordinary identifiers."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalis.llm.shared import text_or_empty

#: The patterns asked for. A match of `assign` counts if its second group has 8 characters; the others are written with their least lengths, which finds the same runs.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = {"assign": ASSIGN, "access": "AKIA[A-Z0-9]{12,}", "hex": "[0-9a-f]{32,}"}
#: What the models judge: runs of such characters of at least this length.
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
WIDTH = 128
PIECE = 256


def _bound(value: Column, body) -> Column:
    """body of value, which is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _matches(text: Column, pattern: str, kind: str, order: int) -> Column:
    """Array of (start, order, kind, end, found). A pattern's matches and the pieces between them alternate, so their lengths add up to offsets, in code points."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.arrays_zip(F.slice(between, 1, F.size(found)).alias("gap"), found.alias("found"))
    spans = "array<struct<start:int,order:int,kind:string,end:int,found:string>>"
    empty = F.array().cast(spans)
    begin = lambda at, kind: F.struct(at.alias("at"), F.array().cast(kind).alias("out"))

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + F.length(x["gap"])
        end = start + F.length(x["found"])
        span = F.struct(start.alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), end.alias("end"), x["found"].alias("found"))
        return F.struct(end.alias("at"), F.concat(s["out"], F.array(span)).alias("out"))

    def piece(s: Column, k: Column) -> Column:
        # spans are gathered PIECE at a time, for an array that grows by one is copied each time
        got = F.aggregate(F.slice(pairs, k * PIECE + 1, F.lit(PIECE)), begin(s["at"], spans), step)
        return _bound(got, lambda g: F.struct(g["at"].alias("at"), F.concat(s["out"], F.array(g["out"])).alias("out")))

    many = F.aggregate(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / PIECE).cast("int")), begin(F.lit(0), f"array<{spans}>"), piece, lambda s: F.flatten(s["out"]))
    few = F.aggregate(pairs, begin(F.lit(0), spans), step, lambda s: s["out"])
    return F.when(~text.rlike(pattern), empty).when(F.size(found) <= PIECE, few).otherwise(many)


def _characters(token: Column) -> Column:
    """Codes of an ASCII token's characters, after a start mark."""
    return F.concat(F.array(F.lit(1)), F.transform(F.split(token, ""), lambda c: F.ascii(c)))


def train(samples: DataFrame, smooth: float = 0.5) -> list[float]:
    """Log-likelihood ratio (random over identifier) of each character pair, as a table of WIDTH * WIDTH, from samples (token, is_random).

    Spark counts the pairs; at most 2 * WIDTH * WIDTH counts reach the driver. Null, empty and non-ASCII tokens are left out.
    """
    codes = samples.where(F.col("token").rlike(r"\A[\x21-\x7E]+\z")).select("is_random", _characters(F.col("token")).alias("c"))
    pairs = codes.select("is_random", F.explode(F.arrays_zip(F.slice("c", F.lit(1), F.size("c") - 1).alias("a"), F.slice("c", F.lit(2), F.size("c")).alias("b"))).alias("p"))
    seen: dict[bool, dict[tuple[int, int], int]] = {True: {}, False: {}}
    for r in pairs.groupBy("is_random", "p.a", "p.b").count().collect():
        seen[r["is_random"]][r["a"], r["b"]] = r["count"]
    after = {k: {} for k in seen}
    for k, counts in seen.items():
        for (a, _), n in counts.items():
            after[k][a] = after[k].get(a, 0) + n
    chance = lambda k, a, b: (seen[k].get((a, b), 0) + smooth) / (after[k].get(a, 0) + smooth * 95)
    return [round(math.log(chance(True, a, b) / chance(False, a, b)), 4) if 32 < b < 127 else 0.0 for a in range(WIDTH) for b in range(WIDTH)]


def ratio(token: Column, table: Column) -> Column:
    """Log-likelihood ratio of a token, summed over its character pairs."""
    return F.aggregate(_characters(token), F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("last")), lambda s, c: F.struct((s["sum"] + F.when(s["last"] > 0, F.get(table, s["last"] * WIDTH + c)).otherwise(0.0)).alias("sum"), c.alias("last")), lambda s: s["sum"])


def random_samples(spark: SparkSession, n: int = 3000) -> DataFrame:
    """Labelled random strings: hashes of counters as base64, hexadecimal and upper-case alphanumerics."""
    digest = F.sha2(F.concat(F.lit("sample"), F.col("id")), 256)
    base64 = F.regexp_replace(F.base64(F.unhex(digest)), "=", "")
    forms = F.array(F.substr(base64, F.lit(1), F.lit(40)), F.substr(digest, F.lit(1), F.lit(40)), F.substr(F.regexp_replace(F.upper(base64), "[+/]", ""), F.lit(1), F.lit(32)))
    return spark.range(n).select(F.explode(forms).alias("token"), F.lit(True).alias("is_random"))


def identifier_samples(docs: DataFrame, labels: DataFrame, most_docs: int = 1000) -> DataFrame:
    """Labelled ordinary identifiers: words of at most most_docs labelled documents of quality 1 (those with the least id hash), and neighbours joined as programs and paths join them."""
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_docs)
    words = docs.join(F.broadcast(good), "doc_id").select(F.regexp_extract_all(F.col("text"), F.lit("[A-Za-z]{2,}"), F.lit(0)).alias("w"))
    pair = lambda sep: F.transform(F.slice("w", F.lit(1), F.size("w") - 1), lambda x, i: F.concat(F.lower(x), F.lit(sep), F.get(F.col("w"), i + 1)))
    return words.where(F.size("w") > 1).select(F.explode(F.concat("w", pair("_"), pair("-"), pair("/"), pair(""))).alias("token"), F.lit(False).alias("is_random"))


def _meets(x: Column, spans: Column) -> Column:
    """Whether x overlaps one of spans, which stand in order and don't overlap each other: the last one that starts before x's end has the largest end, and is found by halving."""
    low, high = F.lit(0), F.size(spans)

    def halve(s: Column, _: Column) -> Column:
        mid = ((s["low"] + s["high"] + 1) / 2).cast("int")
        before = F.get(spans, mid - 1)["start"] < x["end"]
        return F.struct(F.when(before, mid).otherwise(s["low"]).alias("low"), F.when(before, s["high"]).otherwise(mid - 1).alias("high"))

    rounds = F.sequence(F.lit(0), F.floor(F.log2(F.size(spans))).cast("int"))
    last = F.aggregate(rounds, F.struct(low.alias("low"), high.alias("high")), halve, lambda s: s["low"])
    return F.when(F.size(spans) > 0, F.coalesce(F.get(spans, last - 1)["end"] > x["start"], F.lit(False))).otherwise(False)


def scan_secrets(docs: DataFrame, table: list[float], least_ratio: float = 15.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): the base kinds' spans, and kind `markov` for tokens that no base span overlaps and whose log-likelihood ratio is at least least_ratio.

    spans: array of (start, order, kind, end, found), by start, then kind. Offsets are code points of the whole text, however long. Null or empty text: no spans. Null and
    repeated ids and equal rows keep a row each; an empty table gives an empty result; other columns aren't read.
    """
    text = text_or_empty(text_col)
    assign, access, hexes = [_matches(F.col("_text"), p, k, i) for i, (k, p) in enumerate(KINDS.items())]
    df = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text"))
    long = F.filter(assign, lambda x: F.length(F.regexp_extract(x["found"], ASSIGN, 2)) >= 8)
    df = df.withColumns({"_assign": long, "_access": access, "_hex": hexes}).withColumn("_base", F.array_sort(F.concat("_assign", "_access", "_hex")))
    df = df.withColumn("_tokens", _matches(F.col("_text"), TOKEN, "markov", len(KINDS)))
    llr = F.from_json(F.lit(json.dumps(table)), "array<double>")
    free = lambda x: ~(_meets(x, F.col("_assign")) | _meets(x, F.col("_access")) | _meets(x, F.col("_hex")))
    method = F.filter("_tokens", lambda x: free(x) & (ratio(x["found"], llr) >= least_ratio))
    return df.select("doc_id", "_base", F.array_sort(F.concat("_base", F.when(F.size("_tokens") > 0, method).otherwise(F.col("_tokens")))).alias("spans"))


def secret_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans), a row for each row of docs, by models trained from labels' documents of quality 1 (none: from random strings alone). Null or empty text, repeats and the empty table as scan_secrets has them."""
    table = train(random_samples(docs.sparkSession).union(identifier_samples(docs.select("doc_id", "text"), labels)))
    told = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    number = lambda kind: F.size(F.filter("_base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan_secrets(docs, table).select("doc_id", *[number(k) for k in KINDS], F.sha2(F.encode(told(F.col("_base")), "UTF-8"), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
