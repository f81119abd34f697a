"""From raw documents to token ids in five stages, each one operator of factloom.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.catalog import piece_model
from factloom.llm.common import small_side, table, with_key
from factloom.llm.line_dedup import LineDedup, dedup_lines
from factloom.llm.minhash import NearDup, near_duplicates
from factloom.llm.pieces import encode_pieces
from factloom.llm.quality import LineRules, clean_documents
from factloom.llm.tiling import leaked_texts
from factloom.session import cut_lineage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A list of at most so many rejected ids is sent to all executors; a longer one is shuffled.
BROADCAST_IDS = 500_000
#: A line in more than 1,000 distinct texts of a source is frequent, however large the source is.
RULES = LineRules(many=1000)
#: The near-dedup stage links at a similarity of 0.80, op3 at 0.85. 48 bands of 6 miss a pair at
#: 0.80 with probability (1 - 0.8**6)**48 = 5e-7; the sift is again far below the threshold.
NEAR = NearDup(percent=80, bands=48, sift=0.55)

#: The line-dedup stage compares every line that has a word, where op1 starts at 4 words, and
#: looks for neighbours from 4 words on, where op1 starts at 10.
LINES = LineDedup(min_words=1, near_words=4)


def without(docs: DataFrame, rejected: DataFrame, *keys: str) -> DataFrame:
    """``docs`` without the rows whose ``keys`` are in ``rejected``; nulls match nothing."""
    gone = cut_lineage(rejected.select(*keys).distinct(), "rejected")
    return docs.join(small_side(gone, BROADCAST_IDS), list(keys), "left_anti").select(*COLUMNS)


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a row number that sorts like doc_id and tells its texts apart: doc_id
    itself unless some doc_id has several texts. Null stays null."""
    several = docs.where("doc_id is not null").groupBy("doc_id").agg(
        F.min(F.xxhash64("text")).alias("x"), F.max(F.xxhash64("text")).alias("y")).where("x <> y")
    if several.isEmpty():
        return docs.withColumn("row", F.col("doc_id"))
    keyed = with_key(docs.select(*COLUMNS))
    names = keyed.where("doc_id is not null").select("doc_id", "k1", "k2").distinct().orderBy("doc_id", "k1", "k2")
    names = cut_lineage(names.withColumn("row", F.monotonically_increasing_id()), "numbers")
    return keyed.join(names, ["doc_id", "k1", "k2"], "left").select(*COLUMNS, "row")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are not depleted of lines of their own, without
    the lines that too many documents of their source hold."""
    return clean_documents(docs, rules=RULES, keep=("lang", "source")).withColumn(
        "n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines, of any length, and without lines of 4 words or more that
    are one word edit from an earlier one. A document of which only repeated lines were left has
    no text of its own and goes."""
    out = dedup_lines(docs, params=LINES, keep=("lang", "source"))
    emptied = (F.col("n_exact") + F.col("n_near") > 0) & ~F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    return out.where(~F.coalesce(emptied, F.lit(False))).withColumn(
        "n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near-duplicates: five-word
    shingle sets with a Jaccard similarity of 0.80 or more. Different texts of one doc_id
    are documents of their own; rows with a null doc_id stay."""
    rows = numbered(docs)
    return without(rows, near_duplicates(rows.select(F.col("row").alias("doc_id"), "text"), params=NEAR).where("not kept")
                   .select(F.col("doc_id").alias("row")), "row")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item, each judged by its own text."""
    return without(with_key(docs), leaked_texts(docs, table(spark, sf_dir, "benchmark")), "k1", "k2")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and the digest of the text they decode to."""
    return encode_pieces(docs, piece_model()).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality),
    ("line dedup", line_dedup),
    ("minhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("sentencepiece encoding", encoding),
]

#: Near-duplicate groups by sketches, tilings and token pieces cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
