"""The pair index against the tokenizers library, and against merging word by word."""

from __future__ import annotations

import hashlib
import json
import random
import time

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cargolens.llm import bpe
from cargolens.llm.queries import op12_pair_index_bpe, tokenizer

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
ODD = [
    "H̱ello H̱", "İstanbul İx. don't. can't, x.' \"a.\" a.” É. é. 3.5, A1! <|endoftext|>. ﬁ. ὈΔΥΣΣΕΎΣ. Straße; ", None, "",
    "a." * 3000, "aaaaaaaaaaaaa" * 50 + " aaaa", "Ångstrom. Ķ", "漢字。漢字. abc.漢", "x y. z w.", "..., !?", "''s 's't's.",
    "end.\x1cnext. \x85q.", " \t\n", "a<|startoftext|><|endoftext|>b <|ENDOFTEXT|> <|", "\u0000 \x7f a\u0000b", "été. été",
]


def plain(file, texts):
    t = Tokenizer.from_file(public_tokenizers.path(file))
    found = t.encode_batch([x or "" for x in texts], add_special_tokens=False)
    return [(np.array(e.ids, "<u4").tobytes(), t.decode(e.ids, skip_special_tokens=False)) for e in found]


def own(file, texts):
    codec = bpe.Codec(public_tokenizers.path(file))
    return [(ids, codec.decode(ids)) for ids in codec.encode(texts)]


@pytest.mark.parametrize("file", FILES)
def test_texts(spark, file):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = ODD + [r["text"] for r in docs.select("text").collect()]
    assert own(file, texts) == plain(file, texts)


@pytest.mark.parametrize("file", FILES)
def test_any_text(file):
    signs = [*"aAbB'sT12.,!?-<|>éÉßǗ \t\n\x85\xa0\x1c½²中ǅİΣσ_€$%", "<|endoftext|>", "<|ENDOFTEXT|>", " don't", " A1-b2."]
    rng = random.Random(7)
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 20))) for _ in range(3000)]
    assert own(file, texts) == plain(file, texts)


def by_lowest_pair(merges, piece):
    """The textbook way: again and again the leftmost pair of the lowest rank."""
    rank = {(a, b): (r, c) for r, (a, b, c) in enumerate(merges.parts)}
    symbols = [merges.vocab[c] for c in piece[:-1]] + [merges.vocab[piece[-1] + merges.suffix]]
    while True:
        best = min(((rank[p][0], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in rank), default=None)
        if best is None:
            return np.array(symbols, "<u4").tobytes()
        i = best[1]
        symbols[i : i + 2] = [rank[symbols[i], symbols[i + 1]][1]]


def test_pair_index():
    rng = random.Random(8)
    merges = bpe.Merges(json.load(open(tokenizer()))["model"])
    for letters in ("ab", "thein", "abcdefghijklmnopqrstuvwxyz"):
        pieces = ["".join(rng.choices(letters, k=rng.randint(1, 40))) for _ in range(200)]
        assert merges([p.encode() for p in pieces]) == [by_lowest_pair(merges, p) for p in pieces]
    assert merges([]) == []


def model(merges, **more):
    letters = sorted(bpe._byte_letters())
    names = [*letters, *dict.fromkeys("".join(m) for m in merges)]
    return {"type": "BPE", "vocab": {t: i for i, t in enumerate(names)}, "merges": [list(m) for m in merges], **more}


def test_other_vocabularies():
    assert len(bpe.Merges(model([("a", "b"), ("ab", "c")])).parts) == 2
    for bad in (
        model([("ab", "c"), ("a", "b")]),
        model([("a", "b"), ("b", "c"), ("ab", "c"), ("a", "bc")]),
        model([("a", "b")], dropout=0.1),
        model([("a", "b")], end_of_word_suffix="</w>"),
        model([("a", "b")]) | {"type": "Unigram"},
    ):
        with pytest.raises(bpe.UnsupportedVocabulary):
            bpe.Merges(bad)


def test_query(spark, tmp_path):
    """Real documents, nulls, empty texts, repeated rows, clashing columns, a word of 2 MB."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(-1 - k, t) for k, t in enumerate(ODD)] + [(None, "no id"), (-3, None), (-4, "twice"), (-4, "twice"), (-90, "ab" * 1_000_000)]
    docs = docs.union(spark.createDataFrame(rows, docs.schema)).withColumns({n: F.lit("x") for n in ("ids", "_text", "n_tokens")})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = [
        (key, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        for (key, _), (ids, text) in zip(texts, plain("word_bpe_49k.json", [t for _, t in texts]), strict=True)
    ]
    got = [tuple(r[c] for c in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) for r in op12_pair_index_bpe(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    apart = bpe.decode(bpe.encode(docs, tokenizer()), tokenizer())
    assert sorted(map(str, apart.collect())) == sorted(map(str, bpe.encode(docs, tokenizer(), decoded=True).collect()))
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert op12_pair_index_bpe(spark, f"{tmp_path}/none").count() == 0


def test_long_words():
    begun = time.monotonic()
    codec = bpe.Codec(tokenizer())
    [ids] = codec.encode(["a" * 3_000_000])
    assert "".join(codec.decode(ids).split()).replace("</w>", "") == "a" * 3_000_000
    assert not codec._known  # too long to be kept
    assert time.monotonic() - begun < 90
