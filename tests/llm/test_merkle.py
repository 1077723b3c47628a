"""The manifest against a tree built level by level from its definition."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from cargolens.llm import merkle
from cargolens.llm.queries import op11_merkle_witnesses


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(leaves):
    """Root and the siblings of each leaf, taken level by level."""
    siblings, below, nodes = [""] * len(leaves), [[i] for i in range(len(leaves))], list(leaves)
    steps = [[] for _ in leaves]
    while len(nodes) > 1:
        runs = [range(a, min(a + 8, len(nodes))) for a in range(0, len(nodes), 8)]
        for run in runs:
            for k in run:
                for leaf in below[k]:
                    siblings[leaf] += "".join(nodes[j] for j in run if j != k)
                    steps[leaf].append((k - run[0], len(run)))
        below = [[i for k in run for i in below[k]] for run in runs]
        nodes = [h("".join(nodes[k] for k in run)) for run in runs]
    return (nodes[0] if nodes else None), siblings, steps


def fold(leaf, siblings, steps):
    for place, size in steps:
        mine, siblings = siblings[: 64 * (size - 1)], siblings[64 * (size - 1) :]
        leaf = h(mine[: 64 * place] + leaf + mine[64 * place :])
    return leaf


def expected(rows):
    """By definition, for (tree, key, leaf, claim) rows."""
    def name(t):
        return (t is not None, (t or "").encode())

    trees = {}
    for t, *rest in rows:
        trees.setdefault(t, []).append(rest)
    names, out = sorted(trees, key=name), []
    for mine in trees.values():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    parts = {t: tree([r[1] for r in trees[t]]) for t in names}
    root, tops, top_steps = tree([parts[t][0] for t in names])
    for k, t in enumerate(names):
        subroot, siblings, steps = parts[t]
        for (key, leaf, claim), some, path in zip(trees[t], siblings, steps, strict=True):
            whole = some + tops[k]
            out.append((t, key, leaf, subroot, root, whole, fold(claim, whole, path + top_steps[k])))
    return sorted(out, key=repr)


def rows_for(seed, sizes):
    rng, rows = random.Random(seed), []
    for t, n in sizes.items():
        for key in rng.sample(range(-50, 10 * n + 10), n):
            leaf = h(f"{t}{key}")
            rows.append((t, key, leaf, leaf if rng.random() < 0.7 else h("other")))
    rows += rows[:3]  # repeated rows
    rows += [("a", None, h("x"), h("x")), ("a", 1, h("y"), h("y")), ("a", 1, h("z"), h("z"))]
    rng.shuffle(rows)
    return rows


SCHEMA = "tree string, key long, leaf string, claim string"


def got(manifest):
    found = merkle.verified(merkle.witnesses(manifest)).collect()
    return sorted(((r["tree"], r["key"], r["leaf"], r["subroot"], r["root"], r["siblings"], r["folded_root"]) for r in found), key=repr)


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_witnesses(spark, levels):
    rows = rows_for(levels, {"a": 700, "b": 1, None: 64, "ü": 65, "z": 9, "": 8})
    manifest = merkle.build(spark.createDataFrame(rows, SCHEMA).repartition(5), levels)
    assert got(manifest) == expected(rows)
    assert len(manifest.rounds) == {1: 4, 2: 2, 4: 1}[levels]


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 513}, {str(k): 1 + k % 3 for k in range(20)}])
def test_sizes(spark, sizes):
    rows = [r for r in rows_for(3, sizes) if r[1] is not None]
    assert got(merkle.build(spark.createDataFrame(rows, SCHEMA), 1)) == expected(rows)
    one = [("t", 5, h("5"), h("6"))]
    assert got(merkle.build(spark.createDataFrame(one, SCHEMA))) == [("t", 5, h("5"), h("5"), h("5"), "", h("6"))]


def test_append(spark):
    """Appended rows extend the witnesses of those before; full blocks are taken over."""
    rows = [("a" if k % 3 else None, k, h(str(k)), h(str(k))) for k in range(500)]
    manifest = merkle.build(spark.createDataFrame(rows[:300], SCHEMA), 2)
    assert got(manifest) == expected(rows[:300])
    longer = merkle.append(manifest, spark.createDataFrame([*rows[300:], ("new", 1, h("n"), h("n"))], SCHEMA))
    assert got(longer) == expected([*rows, ("new", 1, h("n"), h("n"))])
    assert got(manifest) == expected(rows[:300])
    full = F.col("members") == 64
    old = {(r["tree"], r["block"]): r["digest"] for r in manifest.rounds[0].where(full).collect()}
    new = {(r["tree"], r["block"]): r["digest"] for r in longer.rounds[0].where(full).collect()}
    assert old and old.items() <= new.items()


def test_empty(spark):
    manifest = merkle.build(spark.createDataFrame([], SCHEMA))
    assert merkle.witnesses(manifest).count() == 0
    one = spark.createDataFrame([("t", 5, h("5"), h("5"))], SCHEMA)
    assert got(merkle.append(manifest, one)) == expected([("t", 5, h("5"), h("5"))])


def lowered(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def sized(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def check_query(spark, docs, folder):
    path = str(folder)
    docs.write.parquet(f"{path}/documents.parquet")
    rows = []
    for r in docs.collect():
        head = "".join(sized(r[c]) for c in ("doc_id", "source", "lang", "n_chars"))
        leaf = h(head + sized(r["text"]))
        claim = h(head + sized(lowered(r["text"]))) if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 else leaf
        rows.append((r["lang"], r["doc_id"], leaf, claim))
    want = sorted(((key, leaf, sub, root, h(sib), folded, folded == root) for _, key, leaf, sub, root, sib, folded in expected(rows)), key=repr)
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    found = sorted((tuple(r[n] for n in names) for r in op11_merkle_witnesses(spark, path).collect()), key=repr)
    assert found == want
    return found


def test_query(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = check_query(spark, docs, tmp_path)
    assert {r[-1] for r in found} == {True, False}


def test_query_edges(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows, extra columns."""
    rows = [
        (1, None, "en", "s", 0), (2, "", "en", None, None), (3, "İSTANBUL Straße ÉA\u0000", None, "s", 5), (4, "A b " * 700_000, "de", "s", 1),
        (None, "No id", "en", "s", 5), (5, "Same", "fr", "s", 4), (5, "Same", "fr", "s", 4), (5, "Other", "fr", "s", 5),
        (-7, "Negative", "en", "s", 8), (6, "alone", "", "s", 5),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({"tree": F.lit(1), "key": F.lit("k"), "leaf": F.lit("l"), "claim": F.lit(0), "root": F.lit("r"), "block": F.lit(9)})
    check_query(spark, docs, tmp_path)
    assert op11_merkle_witnesses(spark, empty(docs, tmp_path)).count() == 0


def empty(docs, folder):
    docs.limit(0).write.parquet(f"{folder}/none/documents.parquet")
    return f"{folder}/none"
