"""Canonical tables and fixed vocabularies.

Every operator takes and returns DataFrames over these tables. A *dataset* is a
set of curves that share one index axis and is addressed by ``DATASET_KEYS``.
"""

from __future__ import annotations

DATASET_KEYS = ["document_id", "dataset_id"]
CHANNEL_KEYS = [*DATASET_KEYS, "channel_id"]

SOURCES = (
    "document_id string, file_name string, source_format string, source_version string, "
    "file_size_bytes bigint, sha256 string, field_name string"
)
DATASETS = (
    "document_id string, dataset_id string, position int, name string, kind string, "
    "well_name string, wellbore_name string, row_count bigint, index_mnemonic string, "
    "index_unit string, index_kind string, index_minimum double, index_maximum double, "
    "native_metadata string"
)
CHANNELS = (
    "document_id string, dataset_id string, channel_id string, position int, mnemonic string, "
    "unit string, description string, minimum double, maximum double, sample_count bigint, "
    "null_count bigint, sample_shape array<int>, storage_kind string, data_type string, "
    "asset_path string, native_metadata string"
)
INDEX_AXIS = (
    "document_id string, dataset_id string, ordinal bigint, index double, "
    "index_source map<string,string>"
)
SAMPLES = (
    "document_id string, dataset_id string, channel_id string, ordinal bigint, "
    "index double, value double, text_value string"
)
ARRAY_SAMPLES = (
    "document_id string, dataset_id string, channel_id string, ordinal bigint, "
    "index double, shape array<int>, values array<double>"
)
PREVIEW_SAMPLES = (
    "document_id string, dataset_id string, channel_id string, ordinal int, "
    "index_value double, value double"
)
PRESERVED_OBJECTS = (
    "document_id string, id string, object_type string, native_id string, name string, "
    "parent_native_id string, metadata_path string, payload string"
)
RELATIONSHIPS = (
    "document_id string, source_object_id string, target_native_id string, "
    "relationship_type string"
)
VIEW_SETTINGS = (
    "document_id string, dataset_id string, time_display_mode string, time_zone string, "
    "manual_anchor_index double, manual_anchor_timestamp double, version bigint"
)
WARNINGS = "document_id string, ordinal int, message string"
ASSETS = "document_id string, path string, kind string, size_bytes bigint, sha256 string"

CATALOG_TABLES = {
    "sources": SOURCES,
    "datasets": DATASETS,
    "channels": CHANNELS,
    "preview_samples": PREVIEW_SAMPLES,
    "view_settings": VIEW_SETTINGS,
    "preserved_objects": PRESERVED_OBJECTS,
    "relationships": RELATIONSHIPS,
    "warnings": WARNINGS,
}

# The vocabularies and limits results must agree on.
PACKAGE_VERSION = "1.0"
RULE_VERSION = "1.0.0"
INDEX_KINDS = ("measured_depth", "true_vertical_depth", "time", "sample", "other")
STORAGE_KINDS = ("parquet", "zarr", "metadata_only")
TIME_REFERENCES = ("none", "elapsed", "absolute_utc")
TIME_DISPLAY_MODES = ("elapsed", "clock")
TIME_ZONES = ("utc", "local")
MAX_DETAIL_BYTES = 256 * 1024
DEFAULT_PREVIEW_POINTS = 800
DEFAULT_PAGE_CURVES = 16
NEAREST_ROWS = 32
