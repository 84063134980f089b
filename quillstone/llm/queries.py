"""The numbered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import decontamination, fingerprints, importance, language_id, licenses, mixing, near_duplicates, neighbour_graph, oracles, sharding, substrings, suffixes, token_files, whitening
from quillstone.llm.staging import read

#: Target weights of the mixing query; sources that are not named weigh 1.
MIX_WEIGHTS = {"src0": 3.0, "src1": 2.0, "src2": 0.5, "src3": 0.25}


def tokenizer_json(path: str | None = None) -> str:
    """The text of a tokenizer file; by default the public byte-level BPE of 50k entries."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(read(spark, sf_dir, "documents"), MIX_WEIGHTS)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identified(read(spark, sf_dir, "documents"))


def op3_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per passage of 50 words or more that a document of a smaller id holds too."""
    return suffixes.repeats(read(spark, sf_dir, "documents"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its class: class_id, class_size, and whether it is the one that stays."""
    return near_duplicates.classes(read(spark, sf_dir, "documents")).drop("digest")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicated(read(spark, sf_dir, "documents"))


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(read(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.marked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(read(spark, sf_dir, "documents"), tokenizer_json())


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(read(spark, sf_dir, "documents"))


def op10_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_graph.nearest(read(spark, sf_dir, "embeddings"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact deviations are decimals; as longs they hold up to 2**63, beyond which the cast fails."""
    return whitening.whitened(read(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


def op13_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.classes(read(spark, sf_dir, "documents")).drop("digest", "component")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mix_sources,
        op2_language_id,
        op3_suffix_repeats,
        op4_near_duplicates,
        op5_substring_dedup,
        op6_shards,
        op7_decontamination,
        op8_token_files,
        op9_license_scan,
        op10_nearest_vectors,
        op11_importance_resampling,
        op12_embedding_whitening,
        op13_simhash_near_duplicates,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op1_mix_sources": oracles.mixing(MIX_WEIGHTS),
    "op5_substring_dedup": oracles.substring_dedup(),
    "op7_decontamination": oracles.decontamination(),
    "op9_license_scan": licenses.oracle_sql(),
    "op11_importance_resampling": oracles.importance(importance.PERCENT, importance.LEAST_WORDS, importance.SEED, importance.BUCKETS),
}
