"""Token ids, their files and their packing against plain use of the tokenizer."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cargolens.llm import packing, simple8b, tokens
from cargolens.llm.queries import tokenizer
from cargolens.llm.tokens import Encoder

ODD = [
    "H̱ello H̱", "İstanbul İx. don't. can't, x.' \"a.\" a.” É. é. 3.5, A1! <|endoftext|>. ﬁ. ὈΔΥΣΣΕΎΣ. Straße; ", None, "",
    "a." * 3000, "Ångstrom. Ķ", "漢字。漢字. abc.漢", "x y. z w.", "..., !?", "''s 's't's.", "end.\x1cnext. \x85q.", " \t\n",
]


def plain(texts):
    t = Tokenizer.from_file(tokenizer())
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for x in texts]


def test_ids(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    assert Encoder(tokenizer())(ODD + texts, 1) == plain(ODD + texts)


def test_ids_of_any_text():
    signs = [*"aAbB'sT12.,!?-<|>éÉßǗ \t\n\x85\xa0\x1c½²中ǅİΣσ_€$%", "<|endoftext|>", "<|ENDOFTEXT|>", " don't", " A1-b2."]
    rng = random.Random(6)
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 20))) for _ in range(4000)]
    assert Encoder(tokenizer())(texts, 1) == plain(texts)


WORDS = ["the", "house,", "letters" * 3, "abcdefghijkl", "abcdefghijklm", "ação;", "x1-y", "A", "END.", "é"]


@pytest.mark.parametrize("room", [0, 3, 1000])
def test_ids_in_small_batches(monkeypatch, room):
    """Whatever is kept, and however texts are cut into batches and slices."""
    for name, value in {"CACHED_NUMBERS": room, "CACHED_WORDS": room, "ROWS": 3, "TEXT_BYTES": 60}.items():
        monkeypatch.setattr(tokens, name, value)
    rng = random.Random(3)
    texts = [None, "", *(" ".join(rng.choices(WORDS, k=rng.randint(0, 9))) for _ in range(200))]
    encoder = Encoder(tokenizer())
    assert encoder(texts, 1) == plain(texts)
    assert encoder.arrow(pa.array(texts).slice(50, 20), 1).to_pylist() == plain(texts[50:70])
    assert len(encoder._numbers) <= room and len(encoder._known) <= room


def test_a_word_is_encoded_once(monkeypatch):
    """Through many batches, with any closing marks, and in either case."""
    monkeypatch.setattr(tokens, "ROWS", 2)
    encoder, seen = Encoder(tokenizer()), []
    monkeypatch.setattr(encoder, "_encode", lambda words, real=encoder._encode: seen.extend(words) or real(words))
    texts = ["the house, the House. ação; ação", "house! HOUSE?! x1-y the", "Garden.", "garden x1-y, ação."] * 3
    assert encoder(texts, 1) == plain(texts)
    assert len(seen) == len(set(seen)) and not {b"house,", b"house."} & set(seen)


@pytest.mark.parametrize("top", [2, 1000, 1 << 16, 1 << 33, (1 << 64) - 1])
def test_code_round_trip(top):
    rng = random.Random(top)
    for n in (0, 1, 59, 60, 61, 4096, 5000):
        values = np.array([rng.randint(0, top) if rng.random() < 0.5 else rng.randint(0, 3) for _ in range(n)], np.uint64)
        words = simple8b.encode_block(values)
        assert (simple8b.decode_block(words, n) == values).all()


def test_damaged_file_is_refused():
    data = simple8b.dump([None, 4], [b"\1\0\0\0", b"\2\0\0\0\1\0\0\0"])
    keys, sizes, ids = simple8b.load(data)
    assert (keys, sizes.tolist(), ids.tolist()) == ([None, 4], [1, 2], [1, 2, 1])
    with pytest.raises(ValueError):
        simple8b.load(data[:70] + bytes([data[70] ^ 1]) + data[71:])


def documents(spark):
    rng = random.Random(2)
    rows = [(i * 3, " ".join(rng.choice(["the", "Räder,", "x1"]) for _ in range(rng.randint(0, 400))), "hot" if i % 3 else f"s{i % 4}") for i in range(60)]
    rows += [(None, "no id", None), (500, None, "s1"), (501, "", "tiny"), (7, "twice", "hot"), (7, "twice", "hot")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("start", F.lit("x")).repartition(4)


def test_files(spark):
    rows, docs = documents(spark)
    got = simple8b.read(simple8b.write(docs, tokenizer(), file_text_bytes=4000)).collect()
    want = sorted(((-1 if i is None else i, ids) for (i, _, _), ids in zip(rows, plain([t for _, t, _ in rows]), strict=True)), key=lambda x: x[0])
    got = sorted(got, key=lambda r: r["start"])
    at = 0
    for (key, ids), r in zip(want, got, strict=True):
        assert (-1 if r["doc_id"] is None else r["doc_id"], r["start"], r["n_tokens"], bytes(r["ids"])) == (key, at, len(ids) // 4, ids)
        at += len(ids) // 4
    assert simple8b.read(simple8b.write(docs.limit(0), tokenizer())).count() == 0


@pytest.mark.parametrize("least", [4, 16, 200])
def test_packing(spark, least):
    rows, docs = documents(spark)
    length = 128
    pieces = packing.pack(docs, tokenizer(), length, 1, least).collect()
    ids = {}
    for (i, _, _), data in zip(rows, plain([t for _, t, _ in rows]), strict=True):
        ids.setdefault(i, []).append(data)
    total = sum(len(d) // 4 for ds in ids.values() for d in ds)
    assert sum(p["length"] for p in pieces) == total
    assert packing.pack(docs.limit(0), tokenizer(), length).count() == 0
    windows, seen = {}, {}
    for p in pieces:
        data = ids[p["doc_id"]][0]
        assert p["doc_tokens"] == len(data) // 4
        assert p["ids_crc32"] == zlib.crc32(data[4 * p["start"] : 4 * (p["start"] + p["length"])])
        windows.setdefault(p["sequence_id"], []).append((p["offset"], p["length"], p["source"], p["source_share"]))
        seen.setdefault(p["doc_id"], []).append((p["start"], p["length"]))
    assert sorted(windows) == list(range(-(-total // length)))
    for number, parts in windows.items():
        parts.sort()
        at = 0
        for offset, size, _, _ in parts:
            assert offset == at
            at += size
        assert at == length or number == max(windows)
    for doc, parts in seen.items():
        at = sorted(parts)
        copies = len(ids[doc])
        assert sum(n for _, n in at) == copies * len(ids[doc][0]) // 4
    check_mixture(pieces, length, least, {})


def check_mixture(pieces, length, least, targets):
    """After every window each source has given what its target asks for, to within a quantum, while
    no source has run dry; afterwards the others go on by their targets."""
    totals, given = {}, {}
    for p in pieces:
        totals[p["source"]] = totals.get(p["source"], 0) + p["length"]
        key = (p["sequence_id"], p["source"])
        given[key] = given.get(key, 0) + p["length"]
    named = {s: t for s, t in targets.items() if s in totals}
    rest = sum(n for s, n in totals.items() if s not in named)
    shares = {s: named.get(s, (1 - sum(named.values())) * n / max(1, rest)) for s, n in totals.items()}
    time, sums, done = 0.0, dict.fromkeys(totals, 0), dict.fromkeys(totals, 0.0)
    windows = sorted({w for w, _ in given})
    for w in windows:
        # A plain loop over windows: every queue that is not dry is credited with its share.
        left = float(sum(given.get((w, s), 0) for s in totals))
        while left > 1e-6:
            active = {s: t for s, t in shares.items() if done[s] < totals[s] - 1e-6 and t > 0}
            if not active:  # what no target asks for comes last
                active = {s: totals[s] for s in totals if done[s] < totals[s] - 1e-6}
            if not active:
                break
            whole = sum(active.values())
            step = min(left, *((totals[s] - done[s]) * whole / t for s, t in active.items()))
            for s, t in active.items():
                done[s] += step * t / whole
            left -= step
        for s in totals:
            sums[s] += given.get((w, s), 0)
            room = least if totals[s] * length < least * sum(totals.values()) or named else 0
            assert abs(sums[s] - done[s]) <= room + 2, (w, s)


def sourced(spark, sizes, words=40):
    rng = random.Random(9)
    rows = [(k, " ".join(rng.choice(["the", "house", "x1", "garden"]) for _ in range(words)), s) for s, n in sizes.items() for k in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame([(i, t, s) for i, (_, t, s) in enumerate(rows)], "doc_id long, text string, source string").repartition(5)


def test_many_small_sources(spark):
    """300 equal sources: each is served in its turn, none within a shared heap."""
    docs = sourced(spark, {f"s{k:03d}": 4 for k in range(300)} | {"hot": 600})
    pieces = packing.pack(docs, tokenizer(), 512).collect()
    check_mixture(pieces, 512, 16, {})
    short = sum(p["length"] < 4 for p in pieces if p["source"] != "hot")
    assert short < len(pieces) / 10  # turns, not single ids
    assert len({p["source_share"] for p in pieces}) > 1 and max(p["source_share"] for p in pieces) < 0.5


@pytest.mark.parametrize(
    "targets",
    [{"big": 0.2, "small": 0.6}, {"small": 0.9}, {"big": 0.5, "small": 0.5}, {"none": 0.5, "mid": 0.3}, {"big": 0.0}],
)
def test_targets(spark, targets):
    """Targets unlike the natural shares: deficits grow and are paid, sources run dry, nothing is lost."""
    docs = sourced(spark, {"big": 300, "mid": 60, "small": 40, "tiny": 2})
    length = 256
    pieces = packing.pack(docs, tokenizer(), length, targets=targets).collect()
    total = sum(p["length"] for p in pieces)
    found = docs.collect()
    ids = {r["doc_id"]: data for r, data in zip(found, plain([r["text"] for r in found]), strict=True)}
    assert total == sum(len(d) // 4 for d in ids.values())
    cover = {}
    for p in pieces:
        data = ids[p["doc_id"]]
        assert p["ids_crc32"] == zlib.crc32(data[4 * p["start"] : 4 * (p["start"] + p["length"])])
        cover.setdefault(p["doc_id"], []).append((p["start"], p["length"]))
    for doc, parts in cover.items():
        at = 0
        for begin, size in sorted(parts):
            assert begin == at
            at += size
        assert at == len(ids[doc]) // 4
    windows = {}
    for p in pieces:
        windows.setdefault(p["sequence_id"], []).append((p["offset"], p["length"], p["source"]))
    for number, parts in windows.items():
        parts.sort()
        at = 0
        for offset, size, _ in parts:
            assert offset == at
            at += size
        assert at == length or number == max(windows)
    if targets == {"big": 0.2, "small": 0.6}:
        first = [sum(n for _, n, s in windows[w] if s == "small") / length for w in range(5)]
        assert all(abs(x - 0.6) < 0.02 for x in first)
    if targets == {"big": 0.0}:
        assert not any(s == "big" for _, _, s in windows[0])
    check_mixture(pieces, length, 16, targets)


def test_turns_over_sequences():
    """Plans alone, against a loop: every place of a queue once, in order."""
    assert packing.phases({"a": 10, "b": 30}, {"a": 0.5, "b": 0.5}, 0) == [({("a",): 10, ("b",): 10}, 20), ({("b",): 20}, 20)]
    assert packing.phases({"a": 10}, {"a": 0.0}, 5) == [({(): 5}, 5), ({("a",): 10}, 10)]
    assert packing.phases({}, {}, 7) == [({(): 7}, 7)] and packing.phases({}, {}, 0) == []
