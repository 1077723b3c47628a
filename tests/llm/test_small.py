"""The other operators on small frames with nulls, ties, repeated rows and odd columns."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cargolens.llm import decontaminate, licences, quality, sharding, simhash, toxicity, warc
from cargolens.llm.shared import text_bytes

NAMES = "the of and river stone light house garden winter morning paper window silver market bridge forest".split()


def prose(rng, n):
    return " ".join(rng.choice(NAMES) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"shard": F.lit("s"), "kept": F.lit(0)}).repartition(4)


def test_shards(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randint(0, 90))) for i in range(300)] + [(5, "same")] * 100 + [(None, None), (400, "")]
    got = sharding.balanced_shards(frame(spark, rows), 7, text_bytes(F.col("text")) + 8).collect()
    assert len(got) == len(rows)
    total, most = sum(r["size"] for r in got), max(r["size"] for r in got)
    for k in range(7):
        mine = sorted((r for r in got if r["shard"] == k), key=lambda r: r["slot"])
        assert [r["slot"] for r in mine] == list(range(len(mine)))
        assert abs(sum(r["size"] for r in mine) - total / 7) <= most
    ordered = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in ordered]
    assert ids == sorted(ids)
    assert sharding.balanced_shards(frame(spark, rows).limit(0), 7, F.lit(1)).count() == 0


def test_quality(spark):
    rng = random.Random(2)
    good = prose(rng, 4) + "\n" + " ".join(f"w{i}" for i in range(80))
    rows = [(1, good), (1, good), (2, None), (3, ""), (4, "a b c " * 40), (5, good + " ###" * 90), (6, "x\u00a0y " * 60)]
    plan = quality.plan_cascade(frame(spark, rows))
    assert {r.name for r in plan} == {r.name for r in quality.RULES}
    got = quality.judge(frame(spark, rows), plan, measures=quality.MEASURES).collect()
    assert sorted(r["doc_id"] for r in got if r["kept"]) == [1, 1]
    five = next(r for r in got if r["doc_id"] == 4)
    assert (five["n_words"], five["n_repeat_words"], five["word_chars"]) == (120, 120, 120)
    assert quality.keep_good(frame(spark, rows)).columns == ["doc_id", "text", "shard", "kept"]
    assert quality.keep_good(frame(spark, rows)).count() == 2
    assert quality.judge(frame(spark, rows).limit(0)).count() == 0
    with pytest.raises(ValueError):
        quality.judge(frame(spark, rows), keep=["kept"])


def test_rules_order():
    costs = np.array([[1.0, 1.0, 10.0]] * 4)
    rejects = np.array([[False, True, True], [False, True, True], [True, False, True], [False, False, False]])
    assert quality.order_rules(costs, rejects) == [1, 0, 2]


def test_simhash(spark):
    rng = random.Random(3)
    base = [prose(rng, 60) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, t + " end") for i, t in enumerate(base)]
    rows += [(300, None), (301, ""), (302, " \n"), (7, base[7]), (None, base[8]), (303, "one two"), (304, "ONE Two")]
    prints = [simhash.fingerprint(t, 4) for _, t in rows]
    parent = list(range(len(rows)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 4:
                parent[root(i)] = root(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    want = sorted((-1 if i is None else i, least[root(k)]) for k, (i, _) in enumerate(rows))
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["component_id"]) for r in got) == want
    kept = simhash.one_of_each(frame(spark, rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(least.values()))
    assert simhash.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_trees_find_all_near_pairs():
    rng = np.random.default_rng(4)
    values = rng.integers(0, 1 << 63, 3000, np.uint64)
    near = values[:600].copy()
    for k in range(600):
        for bit in rng.choice(64, rng.integers(1, 5), replace=False):
            near[k] ^= np.uint64(1) << np.uint64(bit)
    values = np.unique(np.concatenate([values, near]))
    masks, r = simhash.block_masks(4, 3)
    met = set()
    for k, mask in enumerate(masks):
        tree, leaves = simhash.fit(values[::3] & mask, 16, k)
        assert leaves > 4
        for _, at, home in simhash.route(tree, values & mask, np.ones(len(values), bool), r):
            for a, b in simhash.solve(values[at], home, mask, r, 4):
                met.add((int(a), int(b)))
    for a, b in zip(*np.nonzero(np.bitwise_count(values[:, None] ^ values[None]) <= 4), strict=True):
        if a < b:
            assert {(int(values[a]), int(values[b])), (int(values[b]), int(values[a]))} & met


def test_warc(spark):
    pages = [(1, "u", "<p>a</p>"), (2, "v", "<p>a</p>"), (0, "w", "\u00e9" * 999), (4, None, None), (5, "", ""), (2, "v", "<p>a</p>"), (None, "x", "q")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("body", F.lit(1))
    got = warc.read(warc.write(table)).collect()
    digests = sorted(base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode() for _, _, h in pages)
    assert sorted(r["payload_digest"] for r in got) == digests
    kinds = sorted((-1 if r["page_id"] is None else r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got)
    assert kinds == [(-1, "response", None, 1), (0, "response", None, 1998), (1, "response", None, 8), (2, "revisit", 1, 8),
                     (2, "revisit", 1, 8), (4, "response", None, 0), (5, "revisit", 4, 0)]
    assert warc.read(warc.write(table.limit(0))).count() == 0


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed):
    def one(i):
        data = warc.record(i, "u", b"text %d " % i * 50, warc.digest(b"x"), None, False)
        return data if packed else __import__("zlib").decompress(data, 31)

    records = [one(i) for i in range(6)]
    hurt = bytearray(records[2])
    hurt[len(hurt) // 2] ^= 255
    data = b"junk" + records[0] + records[1] + bytes(hurt) + records[3] + b"?" * 9 + records[4] + records[5][:-6]
    found = list(warc.salvage(io.BytesIO(data)))
    good = [r.header["x-page-id"] for r in found if isinstance(r, warc.Record)]
    assert good == ["0", "1", "3", "4"]
    gaps = [(g.begin, g.end) for g in found if isinstance(g, warc.Gap)]
    ends = np.cumsum([4, *map(len, records)])
    assert gaps == [(0, 4), (ends[2], ends[3]), (ends[4], ends[4] + 9), (ends[5] + 9, len(data))]
    assert list(warc.salvage(io.BytesIO(b""))) == []


def test_salvage_of_either_kind():
    def ids(data):
        found = list(warc.salvage(io.BytesIO(data)))
        return [r.header["x-page-id"] for r in found if isinstance(r, warc.Record)], [(g.begin, g.end) for g in found if isinstance(g, warc.Gap)]

    packed = [warc.record(i, "u", b"text %d " % i * 50, warc.digest(b"x"), None, False) for i in range(4)]
    plain = [gzip.decompress(p) for p in packed]
    hurt = plain[0].replace(b"WARC/1.1", b"WERC/1.1").replace(b"text 0 ", gzip.compress(b"page"), 1)
    assert ids(hurt + plain[1] + plain[2]) == (["1", "2"], [(0, len(hurt))])
    junk = b"?" * (warc.CHUNK + 9)
    assert ids(junk + plain[1] + plain[2]) == (["1", "2"], [(0, len(junk))])
    assert ids(junk + packed[1] + packed[2]) == (["1", "2"], [(0, len(junk))])
    assert ids(packed[0] + packed[1] + plain[2] + plain[3]) == (["0", "1", "2", "3"], [])
    assert ids(plain[0] + b"?" + packed[1] + plain[2]) == (["0", "1", "2"], [(len(plain[0]), len(plain[0]) + 1)])
    several = warc.member(b"".join(plain[:3]))
    assert ids(several + packed[3]) == (["0", "1", "2", "3"], [])
    partly = warc.member(plain[0] + plain[1].replace(b"text 1 text", b"text 1 test", 1) + plain[2])
    assert ids(partly + packed[3]) == (["0", "2", "3"], [(0, len(partly))])


def test_toxicity(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        text = prose(rng, 40) + (f" {rng.choice(['zorgling', 'z0rgl\u00efnk', 'blarf'])} " if bad else " blarf soup " if i % 4 == 1 else " ") + prose(rng, 5)
        rows.append((i, text))
        labels.append((i, int(bad)))
    rows += [(None, None), (900, ""), (901, "zorgl!"), (902, "ZORGLIN\u0413")]
    docs = frame(spark, rows)
    marks = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    lexicon = toxicity.learn(docs, marks, F.col("doc_id") % 3 != 1)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, lexicon).collect()}
    held = [i for i, _ in labels if i % 3 == 1]
    right = sum((scores[i] >= 0.7) == (i % 4 == 0) for i in held)
    assert right / len(held) > 0.9 and scores[None] < 0.5 and scores[900] < 0.5
    assert toxicity.score(docs.limit(0), lexicon).count() == 0
    assert toxicity.fold("P\u0430th3t\u00efc!  42") == " pathetic 42 "
    assert toxicity.learn(docs, marks.limit(0), F.lit(True)).weights == {}


def test_leaks(spark):
    items = [(1, "A train leaves Berlin at 9 and drives 120 km to reach the old harbour of Kiel before noon, how fast is it?"),
             (2, "The quick brown fox jumps over the lazy dog while the silver market bridge stays closed in winter"),
             (3, "too short"), (4, None), (5, "five plain words stand here")]
    first, second = items[0][1], items[1][1]
    docs = [
        (1, f"Intro words. {first} More."),
        (2, first.replace("Berlin", "Lyon").replace("120", "300").replace("km", "miles")),
        (3, "nothing of the kind in this text at all, just plain words in a row"),
        (4, second), (4, second), (None, second), (5, None), (6, ""),
        (7, second.replace("closed", "shut")),
        (8, "yes: five plain words stand here"),
        (9, first.replace("A train", "Its train").replace("leaves", "quits").replace("reach", "see").replace("noon", "dusk")),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("hash", F.lit(1))
    got = decontaminate.leaks(frame(spark, docs), bench).collect()
    pairs = {(r["doc_id"], r["item_id"]): r["kind"] for r in got}
    assert pairs[1, 1] == "same" and pairs[2, 1] == "other values" and pairs[4, 2] == "same" and pairs[None, 2] == "same"
    assert pairs[8, 5] == "same" and not {3, 5, 6, 9} & {d for d, _ in pairs}
    rest = decontaminate.without_leaks(frame(spark, docs), bench)
    assert {3, 5, 6, 9} <= {r["doc_id"] for r in rest.collect()} and rest.columns == ["doc_id", "text", "shard", "kept"]
    assert decontaminate.leaks(frame(spark, docs), bench.limit(0)).count() == 0
    assert decontaminate.leaks(frame(spark, docs).limit(0), bench).count() == 0


def test_leaks_in_other_case(spark):
    first = "A train leaves Berlin at 9 and drives 120 km. To reach the old harbour of Kiel before noon, How fast is it?"
    filler = "some more words"
    docs = [(1, f"{filler} {first.upper()} {filler}".upper()), (2, f"{filler} {first.lower()} {filler}"), (3, first.title()), (4, filler)]
    bench = spark.createDataFrame([(1, first)], "item_id long, text string")
    got = {r["doc_id"]: (r["coverage"], r["kind"]) for r in decontaminate.leaks(frame(spark, docs), bench).collect()}
    assert got == {1: (1.0, "same"), 2: (1.0, "same"), 3: (1.0, "same")}


def test_leaks_with_edits_and_longer_values(spark):
    item = "On Monday Anna Smith paid 80 euros for the green lamp and then gave it to her brother Paul"
    docs = [
        (1, "words before this " + item.replace("green", "small") + " words after this"),
        (2, item.replace("green lamp", "green old lamp")),
        (3, item.replace("Anna Smith", "Tom").replace("Paul", "Jean Luc Martin").replace("80", "1,250")),
        (4, item.replace("80", "3.5").replace("euros", "dollars")),
        (5, "Answer Tom met us and " + item.replace("Anna Smith", "Maria de Souza")),
        (6, "On Monday Anna Smith paid 80 euros for a big red car but kept all of it from our uncle Paul"),
    ]
    twice = "Tom has 5 pears and eats 3 of the 5 pears before Tom leaves"
    docs += [(7, "Question 2: " + twice), (8, "Hear: Anna has 7 pears and eats 2 of the 7 pears before Anna leaves")]
    docs += [(9, "Anna has 7 pears and eats 2 of the 8 pears before Bob leaves")]
    bench = spark.createDataFrame([(1, item), (2, twice)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["coverage"], r["kind"]) for r in decontaminate.leaks(frame(spark, docs), bench).collect()}
    assert {1, 2, 3, 4, 5} == {d for d, i in got if i == 1} and {7, 8} == {d for d, i in got if i == 2}
    assert got[1, 1] == (18 / 19, "same") and got[2, 1] == (1.0, "same") and got[3, 1] == got[4, 1] == (1.0, "other values")
    assert got[7, 2] == (1.0, "same") and got[8, 2] == (1.0, "other values")


def test_licences(spark):
    rng = random.Random(6)
    notices = {"mit": "Released under the MIT License.", "apache-2.0": "Licensed under the Apache License, Version 2.0.",
               "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.", "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0."}
    rows = [(i, "\n".join(prose(rng, 30) for _ in range(3))) for i in range(60)]
    rows += [(100 + k, f"{prose(rng, 20)}\n{text}") for k, text in enumerate(notices.values())]
    rows += [(200, None), (201, ""), (202, "This work is licensed under the Foo Bar Public License, version 7, by the Baz Foundation.")]
    docs = frame(spark, rows)
    got = {r["doc_id"]: r["licence"] for r in licences.scan(docs, licences.fit(docs)).collect()}
    assert [got[100 + k] for k in range(4)] == list(notices)
    assert all(got[i] == "none" for i in [*range(60), 200, 201])
    assert got[202] in ("unknown", "none")
    assert licences.scan(docs.limit(0), licences.calibrate(["the river is near the town"])).count() == 0


def test_wrapped_licences(spark):
    mit = ["Permission is hereby granted, free of charge, to any person obtaining a copy", "of this software and associated documentation files (the \"Software\"), to deal",
           "in the Software without restriction, including without limitation the rights", "to use, copy, modify, merge, publish, distribute copies of the Software."]
    bsd = ["Redistribution and use in source and binary forms, with or without", "modification, are permitted provided that the following conditions", "are met:"]
    gpl = ["This program is free software: you can redistribute it and/or modify", "it under the terms of the GNU General Public License as published by",
           "the Free Software Foundation, either version 3 of the License, or", "(at your option) any later version."]
    rng = random.Random(7)
    before, after = [prose(rng, 12) for _ in range(3)], [prose(rng, 12) for _ in range(3)]
    rows = [(i, "\n".join(prose(rng, 30) for _ in range(3))) for i in range(60)]
    rows += [(100, "\n".join(["Copyright (c) 2024", "", *mit])), (101, "\n".join(f"# {x}" for x in [*before, "", *bsd, "", *after])),
             (102, "/*\n" + "\n".join(f" * {x}" for x in gpl) + "\n */\n"), (103, "\n".join([*before, *gpl, *after]))]
    docs = frame(spark, rows)
    got = {r["doc_id"]: r for r in licences.scan(docs, licences.fit(docs)).collect()}
    assert [got[100 + k]["licence"] for k in range(4)] == ["mit", "bsd-3-clause", "gpl-3.0", "gpl-3.0"]
    assert [got[100 + k]["notices"][-1]["line"] for k in range(4)] == [2, 4, 1, 3]
    assert all(got[i]["licence"] == "none" for i in range(60))
