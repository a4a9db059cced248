"""Input files: listing, format dispatch, checksums and raw text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curveframe.functions.text import document_id, file_name, suffix

# Source format per file suffix.
FORMAT_OF_SUFFIX = {".las": "LAS", ".dlis": "DLIS", ".xml": "WITSML", ".epc": "WITSML"}
UNSUPPORTED = "Supported files are LAS, DLIS, WITSML XML/EPC, and packaged catalogs."


def source_format(name: str | Column) -> Column:
    ending = suffix(name)
    chosen = F.lit(None).cast("string")
    for known, label in FORMAT_OF_SUFFIX.items():
        chosen = F.when(ending == known, label).otherwise(chosen)
    return chosen


# Larger files are hashed in pieces of so many bytes; their content never is a row.
WHOLE_BYTES = 64 << 20
PIECE_BYTES = 1 << 20


def _hash_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    from pyarrow import fs

    for batch in batches:
        sums = []
        for path in batch.column("path").to_pylist():
            store, place = fs.FileSystem.from_uri(path)
            digest = hashlib.sha256()
            with store.open_input_stream(place) as stream:
                while piece := stream.read(PIECE_BYTES):
                    digest.update(piece)
            sums.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.string())], [*batch.schema.names, "sha256"])


def file_checksums(
    spark: SparkSession, folder: str, glob: str | None = None, whole_bytes: int = WHOLE_BYTES
) -> DataFrame:
    """(path, length, sha256) of every file that is not empty, whatever its size.

    Spark hashes files of moderate size, from any store it reads. Larger ones are listed
    without content, a task each, and streamed from a store that Arrow reads.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(folder).withColumn("path", F.col("_metadata.file_path"))
    small = files.where(F.col("length") <= whole_bytes).select("path", "length", F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > whole_bytes).select("path", "length")
    return small.unionByName(large.mapInArrow(_hash_files, "path string, length bigint, sha256 string"))


def read_registry(
    spark: SparkSession, folder: str, glob: str | None = None, whole_bytes: int = WHOLE_BYTES
) -> DataFrame:
    """One row per input file with size, checksum and format (null if unsupported)."""
    name = file_name("path")
    return file_checksums(spark, folder, glob, whole_bytes).select(
        document_id("path").alias("document_id"),
        name.alias("file_name"),
        source_format(name).alias("source_format"),
        F.col("length").alias("file_size_bytes"),
        "sha256",
    )


def unsupported_files(registry: DataFrame) -> DataFrame:
    return registry.where(F.col("source_format").isNull()).select(
        "document_id", F.lit(0).alias("ordinal"), F.lit(UNSUPPORTED).alias("message")
    )


def decoded(text: str | Column) -> Column:
    """Text as read from a file: UTF-8, and Latin-1 where the bytes are no UTF-8."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(F.is_valid_utf8(text), text).otherwise(F.decode(text.cast("binary"), "ISO-8859-1"))


def _text_files(spark: SparkSession, folder: str, glob: str, wanted: Column | None, whole: bool) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    files = reader.text(folder, wholetext=whole)
    return files if wanted is None else files.where(wanted)


def read_text_documents(spark: SparkSession, folder: str, glob: str, wanted: Column | None = None) -> DataFrame:
    """Whole text of each matching file: (document_id, file_name, file_size_bytes, content).

    ``wanted`` is a condition on ``_metadata``; files that fail it are not read.
    """
    return _text_files(spark, folder, glob, wanted, True).select(
        document_id(F.col("_metadata.file_path")).alias("document_id"),
        file_name(F.col("_metadata.file_path")).alias("file_name"),
        F.col("_metadata.file_size").alias("file_size_bytes"),
        decoded("value").alias("content"),
    )


def read_text_lines(spark: SparkSession, folder: str, glob: str, wanted: Column | None = None) -> DataFrame:
    """Lines of each matching file, which Spark reads in splits: (document_id, file_name, file_size_bytes, block, line_no, line).

    ``block`` is where the split starts in its file; ``line_no`` orders the lines of a split.
    """
    return _text_files(spark, folder, glob, wanted, False).select(
        document_id(F.col("_metadata.file_path")).alias("document_id"),
        file_name(F.col("_metadata.file_path")).alias("file_name"),
        F.col("_metadata.file_size").alias("file_size_bytes"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_no"),
        decoded("value").alias("line"),
    )


def read_package_files(
    spark: SparkSession, folder: str, document: str, whole_bytes: int = WHOLE_BYTES
) -> DataFrame:
    """Files of one published folder as (document_id, path, size_bytes, sha256), paths relative."""
    root = folder.rstrip("/") + "/"
    return file_checksums(spark, folder, whole_bytes=whole_bytes).select(
        F.lit(document).alias("document_id"),
        F.substring_index("path", root, -1).alias("path"),
        F.col("length").alias("size_bytes"),
        "sha256",
    )


# Rows of a file meet their offset in blocks of so many rows.
BLOCK_ROWS = 1 << 15


def row_ordinals(df: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``ordinal``: rows of the first file (by path) first, in file order, without gaps.

    Row order of foreign Parquet is the only order its curves have. A file's
    offset is the number of rows in the files before it; the offsets have one
    row per file, so their running sum is small where the rows are not. One plan
    serves any number of files, and no file name passes through the driver.
    Rows join by file and block, with an offset row for each block: by file alone
    all rows of a file would meet in one task.
    """
    file_path, position = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    block = lambda row: F.floor(row / F.lit(block_rows)).cast("bigint")
    sizes = (
        df.select(file_path.alias("file_path"), position.alias("position"))
        .groupBy("file_path")
        .agg(F.count("*").alias("rows"), F.max("position").alias("last"))
    )
    before = Window.orderBy("file_path").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col("file_path").alias("_offset_path"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("_offset"),
        F.sequence(F.lit(0).cast("bigint"), block(F.col("last"))).alias("blocks"),
    ).select("_offset_path", "_offset", F.explode("blocks").alias("_offset_block"))
    return (
        df.select("*", file_path.alias("_row_path"), position.alias("_row_position"))
        .withColumn("_row_block", block(F.col("_row_position")))
        .join(
            offsets,
            (F.col("_row_path") == F.col("_offset_path")) & (F.col("_row_block") == F.col("_offset_block")),
        )
        .withColumn("ordinal", F.col("_offset") + F.col("_row_position"))
        .drop("_row_path", "_row_position", "_row_block", "_offset_path", "_offset", "_offset_block")
    )
