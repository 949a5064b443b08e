import re

import helpers

from zonalis.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"


def base(text):
    w = WORD.findall((text or "").translate(helpers.ASCII))
    found = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in found]
    return len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def report(spark, rows):
    return {r["doc_id"]: r for r in licenses.license_report(helpers.frame(spark, rows)).collect()}


def doc(i, text):
    return (i, text, "en", "a", 1, 1, "x", 0.5)


def test_phrases_against_brute_force(spark):
    texts = ["CC BY, cc-by; all rights Reserved.", "all rights", "general\x00public\x7flicense general public license all rights reserved", "cc by cc by cc by", "ALL\nRIGHTS\tRESERVED", "all rights réserved é", "cc bye", "", None, "wörd " * 4000 + "cc by", "1 2 3"]
    rows = [doc(i, t) for i, t in enumerate(texts)]
    got = report(spark, rows)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base(t), t
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_odd_documents(spark):
    rows = helpers.odd_documents()
    out = licenses.license_report(helpers.frame(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_base"]) for r in out) == sorted((str(r[0]), *base(r[1])[:2]) for r in rows)
    assert licenses.license_report(helpers.frame(spark, []).limit(0)).count() == 0


def test_notices_with_edits(spark):
    words = MIT.split()
    cases = {
        1: ("x " * 50 + MIT + " y" * 50, "mit"),
        2: (" ".join([*words[:8], "extra", *words[8:]]), "mit"),  # the rest stands on the next diagonal
        3: (" ".join([*words[:8], *words[9:]]), "mit"),
        4: (" ".join(words[:8]), ""),  # too little of it
        5: ("Released under the Foo License.", ""),  # its own word is missing
        6: ("Released under the MIT License. " * 300, "mit"),
        7: ("released under the mit license " + "w " * 9000 + " redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd,mit"),
        8: ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc"),
        9: ("license mit the under released", ""),
    }
    got = report(spark, [doc(i, t) for i, (t, _) in cases.items()])
    assert {i: got[i]["labels"] for i in cases} == {i: want for i, (_, want) in cases.items()}
    assert got[1]["score"] == 1.0 and 0.9 < got[3]["score"] < 1.0 and got[4]["score"] == 0.0


def test_spans(spark):
    text = "a b released under the mit license c " * 3
    (r,) = licenses.scan_licenses(helpers.frame(spark, [doc(1, text)])).collect()
    assert [(s["label"], s["start"], s["size"], s["share"]) for s in r["spans"]] == [("mit", 2 + 8 * k, 5, 1.0) for k in range(3)]


def test_rows_of_one_id(spark):
    rows = [doc(1, "cc by"), doc(1, "released under the MIT license"), doc(None, "all rights reserved"), doc(None, None)]
    out = licenses.license_report(helpers.frame(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["labels"]) for r in out) == [("1", "cc-by"), ("1", "mit"), ("None", ""), ("None", "reserved")]
