"""Named queries of this package with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir
from . import oracles
from .common import table
from .disclosure import personal_data, span_digests
from .licenses import licence_scan
from .line_dedup import dedup_lines
from .minhash import near_duplicates
from .pieces import encode_pieces, piece_digests
from .quality import line_quality
from .reply_trees import as_chain, conversation_digests, format_branches
from .search import search
from .splitters import shard_by_bytes
from .survival import filter_audit
from .tiling import decontaminate
from .toxicity import toxicity
from .warc import read_warc, write_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


def piece_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


@query("op1_line_dedup", oracles.LINE_DEDUP)
def op1(spark, sf_dir):
    return dedup_lines(table(spark, sf_dir, "documents"))


@query("op3_minhash_near_dedup", oracles.NEAR_DEDUP)
def op3(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op4_quality_rules", oracles.QUALITY)
def op4(spark, sf_dir):
    return line_quality(table(spark, sf_dir, "documents"))


@query("op7_benchmark_decontamination")
def op7(spark, sf_dir):
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op8_sentencepiece")
def op8(spark, sf_dir):
    return piece_digests(encode_pieces(table(spark, sf_dir, "documents"), piece_model()))


@query("op5_reply_trees", oracles.CHAT)
def op5(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    return conversation_digests(format_branches(as_chain(rows.union(extra))))


@query("op6_sampled_splitters", oracles.SHARDS)
def op6(spark, sf_dir):
    return shard_by_bytes(table(spark, sf_dir, "documents"))


@query("op9_warc_segments", oracles.WARC)
def op9(spark, sf_dir):
    path = scratch_dir(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    out = read_warc(spark, path)
    # A record that cannot be read is a fault of the writer, not a row.
    sound = F.assert_true(F.col("problem").isNull(), F.concat(F.lit("unreadable record: "), F.col("problem")))
    return out.withColumn("sound", sound).where("sound is null").drop("problem", "sound")


@query("op2_weak_toxicity")
def op2(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_disclosure", oracles.PII)
def op10(spark, sf_dir):
    return span_digests(personal_data(table(spark, sf_dir, "documents")))


@query("op11_license_rules", oracles.LICENCES)
def op11(spark, sf_dir):
    return licence_scan(table(spark, sf_dir, "documents"))


@query("op12_block_max_search", oracles.SEARCH)
def op12(spark, sf_dir):
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_survival_words", oracles.AUDIT)
def op13(spark, sf_dir):
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
