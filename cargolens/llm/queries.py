"""The operators as queries on the given tables, with production parameters."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from functools import wraps

import public_tokenizers

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolens.llm import (
    bpe,
    decontaminate,
    licences,
    merkle,
    packing,
    quality,
    runs,
    sharding,
    simhash,
    simple8b,
    suffixes,
    toxicity,
    warc,
)
from cargolens.llm.shared import text_bytes
from cargolens.session import ship


def tokenizer() -> str:
    """The tokenizer file of the queries; it stays where it is."""
    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unsigned_crc(text: str) -> Column:
    return F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def op1_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    placed = sharding.balanced_shards(docs, 24, text_bytes(F.col("text")) + 8, carry={"text_crc32": unsigned_crc("text")})
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licences.scan(docs, licences.fit(docs))


def op3_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = quality.judge(docs, quality.plan_cascade(docs), measures=quality.MEASURES)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select("doc_id", *quality.MEASURES, failed.alias("base_failed"), (~failed & F.col("kept")).alias("kept"))


def op4_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer(), 2048, 1)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", hexed.alias("fingerprint"), "component_id")


def op6_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = simple8b.write(table(spark, sf_dir, "documents"), tokenizer(), 1)
    return simple8b.read(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.read(warc.write(table(spark, sf_dir, "pages"), least=0))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    third = F.crc32(F.col("doc_id").cast("string")) % 3
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"), third != 1)
    scored = toxicity.score(docs, lexicon)
    return scored.select("doc_id", (third == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(F.max("coverage").alias("coverage"), F.min("kind").alias("kind"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.digests(table(spark, sf_dir, "documents"), 50)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op11_merkle_witnesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    others = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaf = merkle.leaf_of(*others, F.col("text"))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    tampered = merkle.leaf_of(*others, F.translate("text", letters, letters.lower()))
    third = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    rows = docs.select(F.col("lang").alias("tree"), F.col("doc_id").alias("key"), leaf.alias("leaf"), F.when(third, tampered).otherwise(leaf).alias("claim"))
    found = merkle.verified(merkle.witnesses(merkle.build(rows)))
    return found.select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root", F.sha2("siblings", 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op12_pair_index_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encode(table(spark, sf_dir, "documents"), tokenizer(), decoded=True)
    n_tokens = F.expr("octet_length(ids) div 4").alias("n_tokens")
    return found.select("doc_id", n_tokens, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def planted_words(key: int | None, text: str | None) -> list[bytes]:
    """The words of a text; in one document of ten they repeat from some place on."""
    words = runs.split_words(key, text)
    h = 1 if key is None else zlib.crc32(str(key).encode())
    if h % 10 or not words:
        return words
    start = h // 10 % len(words)
    rest = len(words) - start
    period = 1 + rest // (3 + h // 10 % 8)
    return words[:start] + (words[start : start + period] * (rest // period + 1))[:rest]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(table(spark, sf_dir, "documents"), words_of=planted_words)
    lines = F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"]))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "strongest.*",
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def _with_package(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query whose Python workers can import this package."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: _with_package(f)
    for f in (
        op1_byte_shards,
        op2_licences,
        op3_quality_cascade,
        op4_mixture_packing,
        op5_simhash,
        op6_simple8b,
        op7_warc,
        op8_toxicity,
        op9_template_leaks,
        op10_suffix_dedup,
        op11_merkle_witnesses,
        op12_pair_index_bpe,
        op13_periodic_runs,
    )
}
