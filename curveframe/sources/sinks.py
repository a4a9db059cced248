"""Writers for samples and catalogs, and reading them back."""

from __future__ import annotations

from collections.abc import Mapping
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curveframe.operators.catalog import latest_settings
from curveframe.schema import CATALOG_TABLES, CHANNEL_KEYS, DATASET_KEYS, PACKAGE_VERSION

# Rows per Parquet page and per row group check; groups stay near 65,536 rows.
ROW_GROUP_BYTES = 8 * 1024 * 1024


def write_samples(samples: DataFrame, path: str, partitions: int | None = None) -> None:
    """Samples as zstd Parquet, range-partitioned and sorted by curve and ordinal.

    Files and row groups then cover narrow index ranges, so a range filter reads
    only the groups it needs. Ranges are cut by rows, not by dataset: a large
    dataset simply spans more files.
    """
    order = [*CHANNEL_KEYS, "ordinal"]
    count = [partitions] if partitions else []
    (
        samples.repartitionByRange(*count, *order)
        .sortWithinPartitions(*order)
        .write.mode("overwrite")
        .option("compression", "zstd")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .parquet(path)
    )


def write_array_samples(array_samples: DataFrame, path: str) -> None:
    write_samples(array_samples, path)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def scan_channels(
    samples: DataFrame, document_id: str, dataset_id: str, curve_ids: list[str]
) -> DataFrame:
    """Samples of the requested curves of one dataset, filtered in the scan."""
    return samples.where(
        (F.col("document_id") == document_id)
        & (F.col("dataset_id") == dataset_id)
        & F.col("channel_id").isin(*curve_ids)
    )


def write_catalog(tables: Mapping[str, DataFrame], folder: str) -> str:
    """Write all catalog tables as one version and publish it last.

    Readers follow the newest publication row, so a run that dies half-way
    leaves the previous version in force.
    """
    unknown = set(tables) - set(CATALOG_TABLES)
    if unknown:
        raise ValueError(f"Unknown catalog tables: {', '.join(sorted(unknown))}")
    version = uuid4().hex
    spark = next(iter(tables.values())).sparkSession
    for name, ddl in CATALOG_TABLES.items():
        if name in tables:
            fields = spark.createDataFrame([], ddl).schema
            frame = tables[name].select(
                *[F.col(field.name).cast(field.dataType).alias(field.name) for field in fields]
            )
        else:
            frame = spark.createDataFrame([], ddl)
        frame.write.option("compression", "zstd").parquet(f"{folder}/versions/{version}/{name}")
    published = spark.range(1).select(
        F.lit(version).alias("version"),
        F.lit(PACKAGE_VERSION).alias("package_version"),
        F.current_timestamp().alias("published_at"),
    )
    published.write.mode("append").parquet(f"{folder}/published")
    return version


def read_catalog(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Tables of the newest published version; of two published at one instant, that with the greater name."""
    newest = (
        spark.read.parquet(f"{folder}/published").orderBy(F.desc("published_at"), F.desc("version")).limit(1).collect()
    )
    root = f"{folder}/versions/{newest[0].version}"
    return {name: spark.read.parquet(f"{root}/{name}") for name in CATALOG_TABLES}


def append_settings(updates: DataFrame, folder: str) -> None:
    """Add a batch of settings rows to the log of a catalog; nothing written before changes."""
    updates.withColumn("batch", F.lit(uuid4().hex)).write.mode("append").option("compression", "zstd").parquet(f"{folder}/settings_log")


def read_settings(spark: SparkSession, folder: str) -> DataFrame:
    """The newest settings row of each dataset in the log."""
    return latest_settings(spark.read.parquet(f"{folder}/settings_log").drop("batch"))


def compact_settings(spark: SparkSession, folder: str, target: str) -> None:
    """Write the log's newest rows as the log of another folder, from which later updates go on."""
    append_settings(read_settings(spark, folder), target)
