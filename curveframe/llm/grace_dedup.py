"""Exact deduplication as a Grace hash join of the corpus with itself.

1. Each map task folds equal texts of a bounded window of rows into one
   representative, with an open-addressing table that compares whole contents.
   A text that fills a third of the corpus thus leaves a task once per window.
2. Representatives are partitioned by leading bits of their content hash. Bucket
   sizes are known exactly; a bucket that would not fit the table is partitioned
   again by the next bits, and so on. The spill files are Spark's shuffle files,
   so a lost executor only repeats its own tasks.
3. Each bucket runs through an open-addressing table that compares whole
   contents, and its verdicts return to the rows of the windows.

Defined results: null text counts as empty; of rows with equal texts the one with
the largest id stays, a null id being smallest; of repeated rows with that id
exactly one stays; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curveframe.llm.common import neutral, restored, stage, without

WINDOW_BYTES = 24 << 20
WINDOW_ROWS = 50_000
TABLE_BYTES = 48 << 20
DIGIT = 8  # bits of the content hash that each further round of partitioning uses

EXTRA = T.StructType(
    [
        T.StructField("grace_rep", T.LongType()),
        T.StructField("grace_hash", T.LongType()),
        T.StructField("grace_sha", T.BinaryType()),
        T.StructField("grace_rows", T.LongType()),
        T.StructField("grace_bytes", T.LongType()),
        T.StructField("grace_lead", T.BooleanType()),
    ]
)
ADDED = ["keep_id", "group_size", "kept", "text_sha256"]
VERDICT = "grace_rep bigint, keep_id bigint, group_size bigint, grace_first bigint"


class ContentTable:
    """Open addressing with linear probing; equal hashes are settled by comparing contents."""

    def __init__(self) -> None:
        self.slots = [-1] * 1024
        self.hashes: list[int] = []
        self.contents: list[bytes] = []

    def entry(self, key: int, content: bytes) -> int:
        """Number of the content, which is added when it is new."""
        mask = len(self.slots) - 1
        place = key & mask
        while (at := self.slots[place]) >= 0:
            if self.hashes[at] == key and self.contents[at] == content:
                return at
            place = (place + 1) & mask
        self.slots[place] = len(self.contents)
        self.hashes.append(key)
        self.contents.append(content)
        if 2 * len(self.contents) > len(self.slots):
            self._grow()
        return len(self.contents) - 1

    def _grow(self) -> None:
        self.slots = [-1] * (2 * len(self.slots))
        mask = len(self.slots) - 1
        for at, key in enumerate(self.hashes):
            place = key & mask
            while self.slots[place] >= 0:
                place = (place + 1) & mask
            self.slots[place] = at


def _rank(identity: int | None) -> tuple[bool, int]:
    return identity is not None, identity or 0


def fold_windows(id_column: str, text_column: str, window_bytes: int, window_rows: int):
    """Map function: rows with the representative of their window; only representatives keep their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 40
        numbered = 0
        contents, rows, held = ContentTable(), [], []

        def flush(place: int) -> Iterator[pa.RecordBatch]:
            nonlocal contents, rows, held, numbered
            window = pa.Table.from_batches(held)
            identities = window.column(id_column).to_pylist()
            lead: list[int] = [-1] * len(contents.contents)
            count = [0] * len(lead)
            for row, at in enumerate(rows):
                count[at] += 1
                if lead[at] < 0 or _rank(identities[row]) > _rank(identities[lead[at]]):
                    lead[at] = row
            shas = [hashlib.sha256(content).digest() for content in contents.contents]
            extra = {
                "grace_rep": pa.array([base + numbered + at for at in rows], pa.int64()),
                "grace_hash": pa.array([_signed(contents.hashes[at]) for at in rows], pa.int64()),
                "grace_sha": pa.array([shas[at] for at in rows], pa.binary()),
                "grace_rows": pa.array([count[at] for at in rows], pa.int64()),
                "grace_bytes": pa.array([len(contents.contents[at]) for at in rows], pa.int64()),
                "grace_lead": pa.array([lead[at] == row for row, at in enumerate(rows)]),
            }
            kept = [contents.contents[at] if lead[at] == row else None for row, at in enumerate(rows)]
            window = window.add_column(place, text_column, pa.array(kept, pa.binary()).cast(pa.string()))
            for name, values in extra.items():
                window = window.append_column(name, values)
            numbered += len(contents.contents)
            contents, rows, held = ContentTable(), [], []
            yield from window.to_batches(max_chunksize=2_000)

        def rest(batch: pa.RecordBatch, start: int, stop: int) -> pa.RecordBatch:
            # Copied, so that a window does not hold on to texts the table has already folded.
            return batch.drop_columns([text_column]).take(pa.array(range(start, stop), pa.int64()))

        size = place = 0
        for batch in batches:
            place = batch.schema.names.index(text_column)
            start = 0
            for row, text in enumerate(batch.column(text_column)):
                content = (text.as_py() or "").encode()
                key = xxhash.xxh3_64_intdigest(content)
                before = len(contents.contents)
                rows.append(contents.entry(key, content))
                size += len(content) if len(contents.contents) > before else 0
                if size >= window_bytes or len(rows) >= window_rows:
                    held.append(rest(batch, start, row + 1))
                    start, size = row + 1, 0
                    yield from flush(place)
            if start < batch.num_rows:
                held.append(rest(batch, start, batch.num_rows))
        if rows:
            yield from flush(place)

    return run


def _signed(key: int) -> int:
    return key - (1 << 64) if key >> 63 else key


def leading(bits: int) -> Column:
    """The first ``bits`` bits of the content hash."""
    return F.shiftrightunsigned(F.col("grace_hash"), 64 - bits) if bits else F.lit(0).cast("bigint")


def bucket_key(reps: DataFrame, table_bytes: int) -> tuple[Column, int]:
    """The bucket of each representative, and how many first-round buckets there are.

    Only prefixes of overfull buckets reach the driver; there are fewer of them
    than the corpus has multiples of ``table_bytes``. A bucket whose hash bits are
    used up holds one hash value, and its table only grows with distinct contents.
    """
    total = reps.agg(F.sum("grace_bytes").alias("n")).first()["n"] or 0
    bits = min(24, max(0, (4 * total // table_bytes).bit_length()))
    key, full, depth = F.struct(F.lit(bits).alias("depth"), leading(bits).alias("prefix")), reps, bits
    while depth < 64:
        sizes = full.groupBy(leading(depth).alias("prefix")).agg(F.sum("grace_bytes").alias("n"))
        over = [row["prefix"] for row in sizes.where(F.col("n") > table_bytes).select("prefix").collect()]
        if not over:
            break
        inside = leading(depth).isin(over)
        if depth > bits:
            inside = inside & (key["depth"] == depth)
        depth = min(64, depth + DIGIT)
        key = F.when(inside, F.struct(F.lit(depth).alias("depth"), leading(depth).alias("prefix"))).otherwise(key)
        full = full.where(inside)
    return key, 1 << bits


def settle_buckets(text_column: str, id_column: str):
    """Map function over buckets in order: one verdict for each representative."""

    def verdicts(contents, members) -> Iterator[pa.RecordBatch]:
        best: list[tuple | None] = [None] * len(contents.contents)
        count = [0] * len(best)
        for at, rep, identity, rows in members:
            count[at] += rows
            rank = (_rank(identity), -rep)
            if best[at] is None or rank > best[at][0]:
                best[at] = (rank, identity, rep)
        out = [(rep, best[at][1], count[at], best[at][2]) for at, rep, _, _ in members]
        columns = list(zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays(
            [pa.array(column, pa.int64()) for column in columns],
            ["grace_rep", "keep_id", "group_size", "grace_first"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, contents, members = None, ContentTable(), []
        for batch in batches:
            columns = {name: batch.column(name) for name in batch.schema.names}
            keys = zip(columns["depth"].to_pylist(), columns["prefix"].to_pylist(), strict=True)
            for row, key in enumerate(keys):
                if key != bucket:
                    if members:
                        yield from verdicts(contents, members)
                    bucket, contents, members = key, ContentTable(), []
                content = (columns[text_column][row].as_py() or "").encode()
                at = contents.entry(columns["grace_hash"][row].as_py() & (2**64 - 1), content)
                members.append(
                    (at, columns["grace_rep"][row].as_py(), columns[id_column][row].as_py(), columns["grace_rows"][row].as_py())
                )
        if members:
            yield from verdicts(contents, members)

    return run


def classes(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    window_bytes: int = WINDOW_BYTES,
    window_rows: int = WINDOW_ROWS,
    table_bytes: int = TABLE_BYTES,
) -> DataFrame:
    """All columns of ``docs`` plus keep_id, group_size, kept and text_sha256.

    Rows that are not kept come back with a null text; columns of ``docs`` with
    one of those names are left out.
    """
    docs = without(docs, [*ADDED, *EXTRA.fieldNames()])
    schema = T.StructType(docs.schema.fields + EXTRA.fields)
    folded = stage(docs.mapInArrow(fold_windows(id_column, text_column, window_bytes, window_rows), schema), "grace")
    reps = folded.where("grace_lead")
    key, buckets = bucket_key(reps, table_bytes)
    ordered = (
        reps.select(F.col(id_column), F.col(text_column), "grace_rep", "grace_hash", "grace_rows", key.alias("grace_key"))
        .select("*", "grace_key.depth", "grace_key.prefix")
        .drop("grace_key")
        .repartition(max(1, buckets), "depth", "prefix")
        .sortWithinPartitions("depth", "prefix")
    )
    verdicts = ordered.mapInArrow(settle_buckets(text_column, id_column), VERDICT)
    kept = F.col("grace_lead") & (F.col("grace_rep") == F.col("grace_first"))
    return folded.join(verdicts, "grace_rep").select(
        *[F.col(name) for name in docs.columns if name != text_column],
        F.when(kept, F.coalesce(F.col(text_column), F.lit(""))).alias(text_column),
        "keep_id",
        "group_size",
        kept.alias("kept"),
        F.lower(F.hex("grace_sha")).alias("text_sha256"),
    )


def survivors(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns; a kept null text becomes empty."""
    plain, names = neutral(docs)
    return restored(classes(plain, names[id_column], names[text_column]).where("kept"), names)
