"""License scans by diagonal voting: a document's runs of words are joined to the places of the same runs in known notices; places that keep their distance lie on one diagonal, and neighbouring diagonals with enough votes are verified word by word."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from zonalis.llm.shared import numbered, small_side, text_or_empty, written

#: What separates words; the phrases asked for, with their labels.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Sentences by which texts state their license, as words, with their labels. Words in capitals tell a notice from those that are worded like it: a span without them isn't that notice.
NOTICES = (
    ("apache", "licensed under the APACHE license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www APACHE org licenses license 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "released under the BSD license"),
    ("cc-by-nc", "licensed under CC BY NC 4 0"),
    ("cc-by", "this work is licensed under a creative commons ATTRIBUTION 4 0 international license"),
    ("cc0", "to the extent possible under law the author has WAIVED all copyright and related or neighboring rights to this work"),
    ("gpl", "this work is licensed under the GNU GENERAL PUBLIC license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu GENERAL public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu LESSER general public license as published by the free software foundation"),
    ("mit", "released under the MIT license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "this source code form is subject to the terms of the MOZILLA public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the PUBLIC DOMAIN"),
)
#: Words in a run; diagonals at most so far apart are neighbours; the share of a notice's runs that must vote; the share of its words that a span must hold more of.
GRAM, BAND, VOTES, SHARE = 3, 3, 1 / 3, 0.8


def _with_words(df: DataFrame, text: Column, *keep: str) -> DataFrame:
    """df's columns `keep` and the text's words in lower case: plain, with blanks around them, and w, as an array. Of letters outside ASCII case is of no account to the words asked for, so that lower() serves, which is fast."""
    plain = df.select(*keep, F.trim(F.regexp_replace(F.lower(text), BETWEEN, " ")).alias("_plain"))
    return plain.select(*keep, F.concat(F.lit(" "), "_plain", F.lit(" ")).alias("plain"), F.when(F.length("_plain") > 0, F.split("_plain", " ")).otherwise(F.array().cast("array<string>")).alias("w"))


def _grams(df: DataFrame, *keep: str) -> DataFrame:
    """(keep, at, gram): a 64-bit hash of every run of GRAM words of w, and the run's first word's place. Each array is made in a projection of its own, so that none is made again for every element."""
    hashed = df.select(*keep, F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    h = F.col("h")
    runs = F.transform(F.slice("h", 1, F.greatest(F.size("h") - (GRAM - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, GRAM)]))
    return hashed.select(*keep, F.posexplode(runs).alias("at", "gram"))


def notice_places(spark: SparkSession, notices=NOTICES) -> DataFrame:
    """(gram, notice, place, least): where each run of words stands in the notices, and how many votes its notice needs. Its size is that of the given notices."""
    rows = [(k, text.lower(), max(1, -int(-VOTES * (len(text.split()) - GRAM + 1) // 1))) for k, (_, text) in enumerate(notices)]
    df = spark.createDataFrame(rows, "notice int, text string, least int")
    return _grams(_with_words(df, F.col("text"), "notice", "least"), "notice", "least").select("gram", "notice", F.col("at").alias("place"), "least")


def voted(docs: DataFrame, notices=NOTICES, id_col: str = "_row", text_col: str = "text") -> DataFrame:
    """(_row, notice, low, high, votes): stretches of neighbouring diagonals, from low to high, that have enough votes. A diagonal is a word's place in the text less that in the notice.

    All runs of words of all documents are joined to the notices' places; votes are counted by document, notice and diagonal before they are shuffled.
    The places are broadcast: they are as many as the given notices have words.
    """
    runs = _grams(_with_words(docs, text_or_empty(text_col), id_col), id_col)
    met = runs.join(F.broadcast(notice_places(docs.sparkSession, notices)), "gram")
    diagonals = met.groupBy(F.col(id_col).alias("_row"), "notice", (F.col("at") - F.col("place")).alias("d")).agg(F.count(F.lit(1)).alias("votes"), F.first("least").alias("least"))
    own = Window.partitionBy("_row", "notice").orderBy("d")
    apart = diagonals.withColumn("_new", F.coalesce((F.col("d") - F.lag("d").over(own) > BAND).cast("int"), F.lit(0)))
    stretch = apart.withColumn("_part", F.sum("_new").over(own)).groupBy("_row", "notice", "_part")
    return stretch.agg(F.min("d").alias("low"), F.max("d").alias("high"), F.sum("votes").alias("votes"), F.first("least").alias("_least")).where("votes >= _least").select("_row", "notice", "low", "high", "votes")


def _verified(w: str, stretches: str, notices) -> Column:
    """Array of (label, start, size, share): the notices verified along the stretches, by the words of column w. On each diagonal the notice's words are looked for, each at its place or up to BAND words on; of a stretch the first diagonal that holds the most of them counts."""
    told = [{"label": label, "words": text.lower().split(), "must": [x.lower() for x in text.split() if x.isupper() and x.isalpha()]} for label, text in notices]
    known = F.from_json(F.lit(json.dumps(told)), "array<struct<label:string,words:array<string>,must:array<string>>>")
    # a place before the text's first word holds none
    here = lambda d, p: F.slice(w, F.greatest(d + p + 1, F.lit(1)), F.greatest(F.lit(BAND + 1) + F.least(d + p, F.lit(0)), F.lit(0)))

    def of(s: Column) -> Column:
        notice = lambda body: F.get(F.transform(F.array(F.get(known, s["notice"])), body), F.lit(0))

        def at(d: Column, n: Column) -> Column:
            held = F.filter(n["words"], lambda x, p: F.array_contains(here(d, p), x))
            # of all diagonals the lowest that holds the most words comes first
            return F.struct((-F.size(held)).alias("less"), d.alias("d"), F.forall(n["must"], lambda m: F.array_contains(held, m)).alias("named"))

        best = lambda n: F.array_min(F.transform(F.sequence(s["low"], s["high"]), lambda d: at(d, n)))
        return notice(lambda n: F.get(F.transform(F.array(best(n)), lambda b: F.struct(n["label"].alias("label"), b["d"].alias("start"), F.size(n["words"]).alias("size"), (-b["less"] / F.size(n["words"])).alias("share"), b["named"].alias("named"))), F.lit(0)))

    return F.filter(F.transform(stretches, of), lambda x: x["named"] & (x["share"] > SHARE))


def scan_licenses(docs: DataFrame, notices=NOTICES, phrases=PHRASES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, places, spans), a row for each row of docs: places (array of struct start, label) of the phrases, spans (array of struct label, start, size, share, named) of the verified notices, both by word numbers from 0.

    Null and empty texts have no words and no places; texts are whole, however long; null and repeated ids and equal rows keep a row each; other columns aren't read; an empty table gives an empty result.
    A document in which notices repeat has a span for each.
    """
    rows = numbered(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    votes = voted(rows, notices).groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("notice", "low", "high"))).alias("_stretches"))
    votes = written(votes, "votes")
    joined = rows.join(small_side(votes, votes.count()), "_row", "left")
    df = _with_words(joined, text_or_empty("text"), "doc_id", "_stretches")

    def places(phrase: str, label: str) -> Column:
        own = phrase.split(" ")
        found = F.filter(F.transform("w", lambda x, i: F.when((x == own[0]) & (F.get(F.col("w"), i + 1) == own[1]) & (F.get(F.col("w"), i + len(own) - 1) == own[-1]), i)), lambda i: i.isNotNull())
        return F.when(F.contains("plain", F.lit(f" {phrase} ")), F.transform(found, lambda i: F.struct(i.alias("start"), F.lit(label).alias("label")))).otherwise(F.array().cast("array<struct<start:int,label:string>>"))

    spans = F.when(F.col("_stretches").isNotNull(), _verified("w", "_stretches", notices)).otherwise(F.array().cast("array<struct<label:string,start:int,size:int,share:double,named:boolean>>"))
    return df.select("doc_id", F.size("w").cast("long").alias("n_words"), F.array_sort(F.concat(*[places(p, c) for p, c in phrases.items()])).alias("places"), spans.alias("spans"))


def license_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), a row for each row of docs; odd ones as scan_licenses has them. score: the largest share of a notice that is there, 1 where a phrase stands, 0 where nothing does."""
    found = scan_licenses(docs)
    starts, base = F.transform("places", lambda x: x["start"].cast("long")), F.transform("places", lambda x: x["label"])
    text = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    share = F.array_max(F.concat(F.transform("spans", lambda x: x["share"]), F.when(F.size("places") > 0, F.array(F.lit(1.0))).otherwise(F.array(F.lit(0.0)))))
    return found.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), text(base).alias("base_labels"), text(F.concat(base, F.transform("spans", lambda x: x["label"]))).alias("labels"), share.alias("score"))
