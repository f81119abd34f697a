"""CSV members of ZIP archives: a listing of all members first, rules over the listing as
DataFrame expressions, then only what the rules keep is unpacked."""

from __future__ import annotations

import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LISTED = "archive string, ordinal int, raw string, packed boolean, declared bigint, readable boolean"
UNPACKED = "archive string, ordinal int, size bigint, content binary, broken string"

# Why an archive is refused.
UNREADABLE = "not a valid ZIP archive"
LOCKED = "encrypted members"
WITHOUT_CSV = "No CSV member"
OVER_COUNT = "more CSV members than allowed"
OVER_BYTES = "more bytes than allowed"
# end of fixed values
LOCK_BIT = 1


def listing(archives: DataFrame) -> DataFrame:
    """One row per member of (path, content), from the directory at the end of each
    archive; an archive that has none is one row that is not readable."""
    def run(batches):
        for batch in batches:
            rows = []
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content")):
                try:
                    with zipfile.ZipFile(pa.BufferReader(data.as_buffer())) as box:
                        entries = [e for e in box.infolist() if not e.is_dir()]
                    rows += [(path, k, e.filename, bool(e.flag_bits & LOCK_BIT), e.file_size, True) for k, e in enumerate(entries)]
                    if not entries:
                        rows.append((path, None, None, False, 0, True))
                except zipfile.BadZipFile:
                    rows.append((path, None, None, False, 0, False))
            kinds = [pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)],
                                             names=["archive", "ordinal", "raw", "packed", "declared", "readable"])

    return archives.select("path", "content").mapInArrow(run, LISTED)


def member_name(raw: Column) -> Column:
    """A name below the folder it is unpacked in: no drive letters, roots or steps upward."""
    steps = F.split(F.translate(raw, "\\", "/"), "/")
    return F.array_join(F.filter(steps, lambda s: ~s.isin("", ".", "..") & ~s.contains(":")), "/")


def is_data(name: Column) -> Column:
    """A CSV file that is neither hidden nor a system's by-product."""
    return name.rlike(r"(?i)\.csv$") & ~name.rlike(r"(^|/)(\.|__MACOSX(/|$))")


def verdicts(members: DataFrame, max_bytes: int | None, max_files: int | None) -> DataFrame:
    """(archive, wanted, error): per archive the ordinals to unpack, or why it is refused."""
    wanted = F.coalesce(F.col("wanted"), F.lit(False))
    per = members.withColumn("wanted", is_data(member_name(F.col("raw")))).groupBy("archive").agg(
        F.min("readable").alias("readable"), F.count_if(wanted).alias("files"), F.count_if(wanted & F.col("packed")).alias("locked"),
        F.coalesce(F.sum(F.when(wanted, F.col("declared"))), F.lit(0)).alias("bytes"), F.collect_list(F.when(wanted, F.col("ordinal"))).alias("wanted"))
    rules = [(~F.col("readable"), UNREADABLE), (F.col("locked") > 0, LOCKED), (F.col("files") == 0, WITHOUT_CSV)]
    if max_files is not None:
        rules.append((F.col("files") > max_files, f"{OVER_COUNT} (limit {max_files})"))
    if max_bytes is not None:
        rules.append((F.col("bytes") > max_bytes, f"{OVER_BYTES} (limit {max_bytes})"))
    return per.select("archive", "wanted", F.coalesce(*[F.when(when, F.lit(error)) for when, error in rules]).alias("error"))


def unpacked(archives: DataFrame) -> DataFrame:
    """The wanted members of (path, content, wanted). A member is read up to the size its
    directory states, so what comes out is what the rules have seen. An archive with a
    damaged member gives one row that says so."""
    def run(batches):
        for batch in batches:
            for path, data, wanted in zip(batch.column("path").to_pylist(), batch.column("content"), batch.column("wanted").to_pylist()):
                try:
                    with zipfile.ZipFile(pa.BufferReader(data.as_buffer())) as box:
                        entries = [e for e in box.infolist() if not e.is_dir()]
                        rows = [(path, k, entries[k].file_size, box.read(entries[k]), None) for k in sorted(wanted)]
                except (zipfile.BadZipFile, EOFError, OSError, RuntimeError, NotImplementedError) as wrong:
                    rows = [(path, None, None, None, str(wrong))]
                kinds = [pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)],
                                                 names=["archive", "ordinal", "size", "content", "broken"])

    return archives.select("path", "content", "wanted").mapInArrow(run, UNPACKED)


def expand(archives: DataFrame, max_bytes: int | None = None, max_files: int | None = None) -> DataFrame:
    """(path, content) rows -> (archive, ordinal, member, size, content, error): one row per
    CSV member, or one row with an error for an archive that is refused as a whole. There
    is no limit unless the caller sets one. Archives are split over tasks; one is read by
    one task, as its compression allows no other way. ``path`` must name an archive."""
    members = listing(archives)
    judged = verdicts(members, max_bytes, max_files)
    good = judged.where("error is null").select(F.col("archive").alias("path"), "wanted")
    parts = unpacked(archives.join(good, "path"))
    names = members.where("ordinal is not null").select("archive", "ordinal", member_name(F.col("raw")).alias("member"))
    place = F.row_number().over(Window.partitionBy("archive").orderBy("ordinal")) - 1
    read = parts.where("broken is null").join(names, ["archive", "ordinal"]).select(
        "archive", place.cast("int").alias("ordinal"), "member", "size", "content", F.lit(None).cast("string").alias("error"))
    broken = parts.where("broken is not null").select("archive", F.lit(UNREADABLE).alias("error"))
    refused = judged.where("error is not null").select("archive", "error").union(broken)
    return read.unionByName(refused, allowMissingColumns=True)


def expand_archives(spark: SparkSession, pattern: str, **limits) -> DataFrame:
    return expand(spark.read.format("binaryFile").load(pattern), **limits)


def member_lines(content: Column) -> Column:
    """Lines of a small text member; bad bytes are replaced."""
    return F.split(F.regexp_replace(F.decode(content, "UTF-8"), r"\r?\n$", ""), r"\r?\n")
