"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: About 15 MB.
WORD_CACHE = 100_000
BATCH_OPTION = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under new names, so that other columns never clash."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def with_key(docs: DataFrame) -> DataFrame:
    """``docs`` with 128 bits of their text, k1 and k2."""
    return docs.withColumn("k1", F.xxhash64("text")).withColumn("k2", F.xxhash64(F.lit(1), "text"))


def in_batches(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow`` with batches of about ``BATCH_BYTES``, whatever the length of the texts. The
    option is the session's, as Spark reads it when the plan runs."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_OPTION) != f"{BATCH_BYTES}b":
        conf.set(BATCH_OPTION, f"{BATCH_BYTES}b")
    return df.mapInArrow(run, schema)


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint where at most ``rows`` rows were counted. A longer side is left to
    a shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def smallest(df: DataFrame, at: str, count: int) -> DataFrame:
    """The ``count`` rows with the smallest 64-bit hash ``at``. Every task would pass on its own ``count``
    smallest rows to one task, so a long table is first thinned to about twice the need, by the hash itself."""
    rows = df.count()
    if rows > 4 * count:
        thin = df.where(F.col(at) < F.lit(int((2 * count / rows) * 2.0**64) - (1 << 63)))
        if thin.count() >= count:
            df = thin
    return df.orderBy(at).limit(count)


def ascii_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8. ``bytes.split`` cuts at exactly these six
    characters; ``str.split`` would also cut at other Unicode spaces."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


class WordHashes(dict):
    """64-bit hash of a word, remembered. The memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mixing, so that every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def weights(count: int, seed: int) -> np.ndarray:
    """Fixed odd 64-bit multipliers."""
    return np.random.default_rng(seed).integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """One hash for each run of ``size`` words; a shorter text is one run; no words, none."""
    n = len(words)
    if n == 0:
        return words
    span = min(n, size)
    by = weights(size, 5)
    out = np.full(n - span + 1, span, np.uint64)
    for k in range(span):
        out += words[k:n - span + 1 + k] * by[k]
    return mixed(out)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def list_column(parts: list[np.ndarray], kind=None) -> pa.Array:
    """An Arrow list column from one numpy array per row."""
    ends = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=ends[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind or pa.int64()))


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about ``limit`` bytes of text, so that a batch of very
    long texts never holds all its results at once. A piece has one row at least. At the end the
    memory that Arrow keeps for reuse goes back to the system, as the worker process lives on."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.cumsum(np.nan_to_num(np.asarray(pa.compute.binary_length(column), dtype=float)))
        start = 0
        while start < batch.num_rows:
            base = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop
    pa.default_memory_pool().release_unused()
