"""Asset manifests and their verification, over many packages at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curveframe.functions.numeric import column
from curveframe.functions.text import suffix
from curveframe.schema import PACKAGE_VERSION

CATALOG_FOLDER = "catalog"
MANIFEST_NAME = "manifest.json"
ASSET_KEYS = ["document_id", "path"]


def asset_kind(path: str | Column) -> Column:
    """Kind by suffix first, then by folder."""
    path = column(path)
    return (
        F.when(suffix(path) == ".parquet", "scalar")
        .when(F.rlike(F.lower(path), F.lit(r"(^|/)[^/]*\.zarr(/|$)")), "array")
        .when(F.rlike(path, F.lit(r"(^|/)catalog(\.[a-z]+)?(/|$)")), "catalog")
        .otherwise("metadata")
    )


def is_unsafe_path(path: str | Column) -> Column:
    """Empty, absolute, a folder, with a backslash or a parent step."""
    path = column(path)
    return (
        (path == "")
        | F.contains(path, F.lit("\\"))
        | F.startswith(path, F.lit("/"))
        | F.endswith(path, F.lit("/"))
        | F.rlike(path, F.lit(r"(^|/)\.\.(/|$)"))
    )


def with_checksums(files: DataFrame) -> DataFrame:
    """(document_id, path, size_bytes, sha256) of files whose content is a column."""
    return files.select(
        "document_id",
        "path",
        F.octet_length("content").cast("bigint").alias("size_bytes"),
        F.sha2("content", 256).alias("sha256"),
    )


def build_manifest(files: DataFrame) -> DataFrame:
    """Manifest rows of (document_id, path, size_bytes, sha256), ordered by path."""
    return files.select(
        "document_id", "path", asset_kind("path").alias("kind"), "size_bytes", "sha256"
    ).orderBy("document_id", "path")


def refresh_manifest(manifest: DataFrame, changed: DataFrame) -> DataFrame:
    """Replace the entries of changed assets; every other entry stays as it is.

    A changed asset the manifest does not declare is left out.
    """
    fresh = changed.select(
        *ASSET_KEYS,
        F.col("size_bytes").alias("new_size"),
        F.col("sha256").alias("new_sha256"),
    )
    return manifest.join(fresh, ASSET_KEYS, "left").select(
        *ASSET_KEYS,
        "kind",
        F.coalesce("new_size", "size_bytes").alias("size_bytes"),
        F.coalesce("new_sha256", "sha256").alias("sha256"),
    )


def verify_assets(
    manifest: DataFrame, actual: DataFrame, packages: DataFrame | None = None
) -> DataFrame:
    """Every integrity error, one row each: (document_id, path, error).

    ``actual`` has (document_id, path, size_bytes, sha256); ``packages`` has
    (document_id, package_version) where versions are to be checked.
    """
    declared = manifest.groupBy(*ASSET_KEYS).agg(
        F.count(F.lit(1)).alias("declared_times"),
        F.max("size_bytes").alias("declared_size"),
        F.max("sha256").alias("declared_sha256"),
    )
    present = (
        actual.where(F.col("path") != MANIFEST_NAME)
        .groupBy(*ASSET_KEYS)
        .agg(
            F.count(F.lit(1)).alias("present_times"),
            F.max("size_bytes").alias("present_size"),
            F.max("sha256").alias("present_sha256"),
        )
    )
    path = F.col("path")
    both = F.col("declared_times").isNotNull() & F.col("present_times").isNotNull()
    found = F.array_compact(
        F.array(
            F.when(
                is_unsafe_path("path") | (F.col("present_times") > 1),
                F.concat(F.lit("Unsafe or duplicate member: "), path),
            ),
            F.when(F.col("declared_times") > 1, F.concat(F.lit("duplicate asset path: "), path)),
            F.when(F.col("present_times").isNull(), F.concat(F.lit("missing asset: "), path)),
            F.when(F.col("declared_times").isNull(), F.concat(F.lit("undeclared asset: "), path)),
            F.when(
                both & (F.col("declared_size") != F.col("present_size")),
                F.concat(path, F.lit(": size mismatch")),
            ),
            F.when(
                both & (F.col("declared_sha256") != F.col("present_sha256")),
                F.concat(path, F.lit(": checksum mismatch")),
            ),
        )
    )
    errors = declared.join(present, ASSET_KEYS, "full").select(
        *ASSET_KEYS, F.explode(found).alias("error")
    )
    if packages is None:
        return errors
    old = packages.where(F.col("package_version") != PACKAGE_VERSION).select(
        "document_id",
        F.lit(None).cast("string").alias("path"),
        F.concat(F.lit("package version "), "package_version", F.lit(" is not supported")).alias(
            "error"
        ),
    )
    return errors.unionByName(old)


def verification(manifest: DataFrame, errors: DataFrame) -> DataFrame:
    """Validity, asset count and error count per document."""
    counted = manifest.groupBy("document_id").agg(F.count(F.lit(1)).alias("asset_count"))
    wrong = errors.groupBy("document_id").agg(F.count(F.lit(1)).alias("error_count"))
    return (
        counted.join(wrong, "document_id", "full")
        .fillna(0, ["asset_count", "error_count"])
        .withColumn("valid", F.col("error_count") == 0)
    )


def missing_assets(manifest: DataFrame, actual: DataFrame) -> DataFrame:
    return manifest.join(actual.select(*ASSET_KEYS), ASSET_KEYS, "left_anti").select(*ASSET_KEYS)


def undeclared_assets(manifest: DataFrame, actual: DataFrame) -> DataFrame:
    kept = actual.where(F.col("path") != MANIFEST_NAME)
    return kept.join(manifest.select(*ASSET_KEYS), ASSET_KEYS, "left_anti").select(*ASSET_KEYS)
