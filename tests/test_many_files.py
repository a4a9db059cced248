"""Row numbers and the queries on them do not depend on how a table is cut into files."""

from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from curveframe.sources.registry import row_ordinals

SOURCE = "/root/testdata/sf0.001"
ON_ORDINALS = ["range_filter", "curve_stats", "row_page", "qc_report", "sample_ordinals", "cursor_top_rows"]


def cut_table(folder, name, parts):
    rows = pq.read_table(f"{SOURCE}/{name}.parquet")
    target = folder / f"{name}.parquet"
    target.mkdir(parents=True)
    for other in Path(SOURCE).glob("*.parquet"):
        if other.stem != name:
            (folder / other.name).symlink_to(other)
    step = -(-rows.num_rows // parts)
    for part in range(parts):
        pq.write_table(rows.slice(part * step, step), target / f"part {part:03d}.parquet")
    return str(folder)


@pytest.mark.parametrize("parts", [1, 2, 3, 20])
def test_ordinals_follow_file_order(spark, tmp_path, parts):
    folder = cut_table(tmp_path / "with blank", "lineitem", parts)
    found = row_ordinals(spark.read.parquet(f"{folder}/lineitem.parquet")).orderBy("ordinal").collect()
    wanted = pq.read_table(f"{SOURCE}/lineitem.parquet").to_pylist()
    assert [row["ordinal"] for row in found] == list(range(len(wanted)))
    assert [row["l_extendedprice"] for row in found] == [row["l_extendedprice"] for row in wanted]


@pytest.mark.parametrize("name", ON_ORDINALS)
def test_queries_read_all_files(spark, tmp_path, name):
    whole = {tuple(map(str, row)) for row in queries()[name](spark, SOURCE).collect()}
    folder = cut_table(tmp_path, "lineitem", 3)
    parts = {tuple(map(str, row)) for row in queries()[name](spark, folder).collect()}
    assert parts == whole and parts


@pytest.fixture
def no_broadcast(spark):
    """Joins as on tables too large to be broadcast, their tasks not put together."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_rows_of_one_file_are_dealt_to_many_tasks(no_broadcast, tmp_path):
    no_broadcast.range(600_000).coalesce(1).write.parquet(str(tmp_path / "one"))
    numbered = row_ordinals(no_broadcast.read.parquet(str(tmp_path / "one")))
    assert numbered.where("ordinal = id").count() == 600_000
    held = numbered.groupBy(F.spark_partition_id()).count().collect()
    assert max(row["count"] for row in held) < 450_000


@pytest.mark.parametrize("block_rows", [1, 7, 100, 1 << 15])
def test_ordinals_in_blocks(no_broadcast, tmp_path, block_rows):
    for name, first, size in (("b", 0, 150), ("a", 500, 250), ("c", 900, 0), ("d", 1000, 1)):
        no_broadcast.range(first, first + size).coalesce(1).write.parquet(str(tmp_path / "parts" / f"part={name}"))
    found = row_ordinals(no_broadcast.read.parquet(str(tmp_path / "parts")), block_rows).orderBy("ordinal").collect()
    assert [row["ordinal"] for row in found] == list(range(401))
    assert [row["id"] for row in found] == [*range(500, 750), *range(150), 1000]
