"""LAS files beyond one row: lines of file splits to parts of whole data rows.

Spark reads a large file in splits, a line per row. Each split knows its own section
titles and cells; what the splits before it hold reaches it through tables with one row
per split, over which counts are summed up in file order. Lines move to their split
for the running counts, and cells to the part of the file that has their rows; a part is
bounded, and no row of any table grows with the file.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curveframe.sources import las

FILE = ["document_id", "file_name", "file_size_bytes"]
SPLIT = ["document_id", "block"]
TITLE = r"^[ \t]*~"


def _running(value: Column) -> Column:
    """Sum over the lines of a split up to this one."""
    return F.sum(value).over(
        Window.partitionBy(*SPLIT).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )


def _before_split(lines: DataFrame, value: Column, alias: str) -> DataFrame:
    """Sum over the splits of the same file before each split."""
    totals = lines.groupBy(*SPLIT).agg(F.sum(value).alias("total"))
    before = Window.partitionBy("document_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*SPLIT, F.coalesce(F.sum("total").over(before), F.lit(0)).alias(alias))


def _with_section(lines: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Lines of the first section of each letter, without titles; titles themselves keep no letter."""
    title = F.rlike("line", F.lit(TITLE))
    letter = F.when(title, F.upper(F.left(F.regexp_replace("line", TITLE, ""), F.lit(1))))
    marked = stage(
        lines.withColumn("title_letter", letter).withColumn("titles", _running(F.when(title, 1).otherwise(0)))
    )
    is_title = F.col("title_letter").isNotNull()
    before = _before_split(marked, F.when(is_title, 1).otherwise(0), "titles_before")
    numbered = marked.join(before, SPLIT).withColumn("section", F.col("titles_before") + F.col("titles"))
    first = (
        numbered.where(is_title)
        .groupBy("document_id", F.col("title_letter").alias("letter"))
        .agg(F.min("section").alias("section"))
    )
    return numbered.where(~is_title).join(first, ["document_id", "section"]).select(*FILE, "block", "line_no", "letter", "line")


def _headers(files: DataFrame, lines: DataFrame) -> DataFrame:
    """One row per file with its header; data lines are not looked at."""
    found = (
        lines.where(F.col("letter").isin(*las.SECTION_LINES))
        .groupBy("document_id")
        .agg(F.array_sort(F.collect_list(F.struct("letter", "block", "line_no", "line"))).alias("all_lines"))
    )

    def section(letter: str) -> Column:
        own = F.filter("all_lines", lambda item: item["letter"] == letter)
        return F.coalesce(F.transform(own, lambda item: item["line"]), F.array().cast("array<string>"))

    lists = {name: section(letter) for letter, name in las.SECTION_LINES.items()}
    return las.with_header(files.join(found, "document_id", "left").withColumns(lists).drop("all_lines"))


def _data_parts(lines: DataFrame, headers: DataFrame, stage: Callable[[DataFrame], DataFrame], part_cells: int) -> DataFrame:
    """(document, part, first_row, tokens): cells by the part that holds their rows."""
    sizes = headers.select(
        "document_id", "delimiter", F.greatest("curve_count", F.lit(1)).cast("bigint").alias("width")
    ).withColumn("rows", F.greatest(F.floor(F.lit(part_cells) / F.col("width")), F.lit(1)))
    data = lines.where((F.col("letter") == "A") & ~F.rlike("line", F.lit(las.BLANK_LINE))).drop(*FILE[1:], "letter")
    cells = data.join(sizes, "document_id").withColumn("cells", las.line_tokens(F.col("line"), "delimiter"))
    counted = stage(cells.drop("line", "delimiter").withColumn("through", _running(F.size("cells"))))
    before = _before_split(counted, F.size("cells"), "cells_before")
    first = F.col("cells_before") + F.col("through") - F.size("cells")
    part_size = F.col("width") * F.col("rows")
    # A line that ends one part and begins the next goes to both.
    placed = (
        counted.join(before, SPLIT)
        .withColumn("first", first)
        .withColumn(
            "part",
            F.explode(
                F.sequence(F.floor(F.col("first") / part_size), F.floor((F.col("first") + F.size("cells") - 1) / part_size))
            ),
        )
    )
    gathered = placed.groupBy("document_id", "part", "width", "rows").agg(
        F.array_sort(F.collect_list(F.struct("first", "cells"))).alias("lines")
    )
    skipped = (F.col("part") * part_size - F.get("lines", F.lit(0))["first"]).cast("int")
    flat = F.flatten(F.transform("lines", lambda item: item["cells"]))
    return gathered.withColumn("skipped", F.greatest(skipped, F.lit(0))).select(
        "document_id",
        "part",
        (F.col("part") * F.col("rows")).alias("first_row"),
        F.slice(flat, F.col("skipped") + 1, part_size.cast("int")).alias("tokens"),
    )


def _added_facts(parts: DataFrame) -> DataFrame:
    """Facts of all parts of a file as those of one: counts add up, and the step over each border counts, too."""
    each = parts.select("document_id", "part", F.explode("facts").alias("fact")).select(
        "document_id", "part", "fact.position", "fact.date_position", "fact.found.*"
    )
    column = Window.partitionBy("document_id", "position", "date_position").orderBy("part")
    last = F.last("last", True).over(column.rowsBetween(Window.unboundedPreceding, -1))
    bordered = each.withColumn("border", last)
    step = lambda condition: F.sum(F.when(condition, 1).otherwise(0))
    added = bordered.groupBy("document_id", "position", "date_position").agg(
        F.sum("rows").alias("rows"),
        F.sum("finite").alias("finite"),
        (F.sum("rising") + step(F.col("first") >= F.col("border"))).alias("rising"),
        (F.sum("falling") + step(F.col("first") <= F.col("border"))).alias("falling"),
        F.min_by("first", F.when(F.col("first").isNotNull(), F.col("part"))).alias("first"),
        F.max_by("last", F.when(F.col("last").isNotNull(), F.col("part"))).alias("last"),
    )
    found = F.struct("rows", "finite", "rising", "falling", "first", "last")
    return added.groupBy("document_id").agg(
        F.array_sort(F.collect_list(F.struct("position", "date_position", found.alias("found")))).alias("facts")
    )


def parts_of_lines(
    lines: DataFrame, stage: Callable[[DataFrame], DataFrame], part_cells: int = las.PART_CELLS
) -> DataFrame:
    """Parts of files that were read by line, with the facts of the whole file in each."""
    files = lines.groupBy(*FILE).agg(F.count(F.lit(1)).alias("lines")).drop("lines")
    sections = stage(_with_section(lines, stage))
    headers = stage(_headers(files, sections))
    data = stage(_data_parts(sections, headers, stage, part_cells))
    totals = data.groupBy("document_id").agg(F.sum(F.size("tokens")).alias("total"))
    checked = (
        headers.join(totals, "document_id", "left")
        .withColumn("total", F.coalesce("total", F.lit(0)))
        .withColumn("problem", las.file_problem(F.col("total")))
    )
    none = F.array().cast("array<string>")
    parts = checked.join(data, "document_id", "left").select(
        *checked.columns,
        F.coalesce("part", F.lit(0)).alias("part"),
        F.coalesce("first_row", F.lit(0)).alias("first_row"),
        F.coalesce("tokens", none).alias("tokens"),
    )
    own = stage(las.with_facts(parts))
    typed = own.groupBy("document_id").agg(
        F.array_distinct(F.flatten(F.collect_set("text_positions"))).alias("text_positions"),
        F.sum("row_count").alias("row_count"),
    )
    whole = typed.join(_added_facts(own), "document_id", "left")
    empty = F.col("facts").isNull()
    back = own.drop("text_positions", "row_count").withColumnRenamed("facts", "own_facts").join(whole, "document_id")
    return back.withColumn("facts", F.when(empty, F.col("own_facts")).otherwise(F.col("facts"))).drop("own_facts", "total")
