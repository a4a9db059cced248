"""Benchmark decontamination as a prefix-filtered set join.

A window is ``window`` consecutive item words, or the whole item when it is
shorter. For the full containment asked of a window, its prefix is one shingle:
the rarest of its ``shingle``-word runs by document frequency over the whole
corpus. Documents meet only windows whose prefix shingle they hold; the
position of the shingle bounds where the window starts and ends, windows that
would leave the document are skipped (length and positional bounds), and the
rest is verified word by word, first by hashes and then by the words' bytes.

Items are joined in blocks of at most ``BLOCK_BYTES`` of text, so what a task
holds of them is bounded however large the benchmark is; further blocks are
further scans of the corpus, and their hits are merged by row.

Defined results: null or wordless texts have no words and are never hit; items
without words have no windows; a null item id counts as an empty id, items with
one id are one item; repeated rows each get their hits; without items nothing is
hit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curveframe.llm.common import (
    content_hashes,
    lower_ascii,
    neutral,
    owners,
    pieces,
    restored,
    run_hashes,
    text_bytes,
    without,
    word_spans,
)

WINDOW = 13
SHINGLE = 4
BLOCK_BYTES = 4 << 20
PIECE_BYTES = 2 << 20

# Bytes that end a word of the contract; all others, digits, letters and non-ASCII, form words.
BREAKS = np.zeros(256, dtype=bool)
BREAKS[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

SPANS = "array<struct<start:int,end:int>>"
ADDED = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
        T.StructField("hit_items", T.ArrayType(T.StringType())),
    ]
)


@dataclass
class Words:
    """Words of all texts of a column: their bytes, places and hashes, and the n + 1 offsets of each text's words."""

    raw: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    firsts: np.ndarray

    def spelled(self, first: int, size: int) -> bytes:
        """A run of words as they are compared in the end, one blank apart."""
        places = zip(self.starts[first : first + size].tolist(), self.ends[first : first + size].tolist(), strict=True)
        return b" ".join([self.raw[start:end].tobytes() for start, end in places])


def words_of(column: pa.Array) -> Words:
    raw, offsets = text_bytes(column)
    raw = lower_ascii(raw)
    starts, ends, firsts = word_spans(raw, offsets, BREAKS)
    return Words(raw, starts, ends, content_hashes(raw, starts, ends)[0], firsts)


@dataclass
class Windows:
    """Distinct windows of one block of items, by size."""

    hashes: dict[int, np.ndarray]  # size -> word hashes, one row per window
    spelled: dict[int, list[bytes]]  # size -> the words themselves
    items: dict[int, list[list[str]]]  # size -> ids of the items with that window
    prefix: dict[int, np.ndarray]  # size -> sorted prefix shingles
    offset: dict[int, np.ndarray]  # size -> place of the shingle in its window, in prefix order
    order: dict[int, np.ndarray]  # size -> window of each prefix shingle
    shingles: dict[int, int]  # size -> words in a shingle


def item_windows(
    rows: list[tuple[str | None, str | None]], window: int
) -> tuple[dict[int, np.ndarray], dict[int, list[bytes]], dict[int, list[list[str]]]]:
    """Distinct windows by size: their word hashes, their words, and the items that have them."""
    words = words_of(pa.array([text for _, text in rows], pa.string()))
    held: dict[int, dict[bytes, tuple[bytes, set[str]]]] = {}
    for (item, _), start, end in zip(rows, words.firsts[:-1], words.firsts[1:], strict=True):
        size = min(window, int(end - start))
        if size == 0:
            continue
        for at in range(start, end - size + 1):
            found = held.setdefault(size, {}).setdefault(words.spelled(at, size), (words.hashes[at : at + size].tobytes(), set()))
            found[1].add(item or "")
    arrays = {
        size: np.frombuffer(b"".join(hashes for hashes, _ in found.values()), np.uint64).reshape(-1, size)
        for size, found in held.items()
    }
    spelled = {size: list(found) for size, found in held.items()}
    return arrays, spelled, {size: [sorted(ids) for _, ids in found.values()] for size, found in held.items()}


def shingle_rows(windows: np.ndarray, shingle: int) -> np.ndarray:
    """Hashes of the shingles of each window, one row per window."""
    n, size = windows.shape
    flat = run_hashes(np.ascontiguousarray(windows).reshape(-1), shingle)
    places = np.arange(n)[:, None] * size + np.arange(size - shingle + 1)[None, :]
    return flat[places]


def frequencies(docs: DataFrame, text_column: str, wanted: np.ndarray, shingle: int) -> dict[int, int]:
    """Number of documents with each of the ``wanted`` shingles, over the whole corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(len(wanted), dtype=np.int64)
        for piece in pieces(batches, text_column, PIECE_BYTES):
            words = words_of(piece.column(text_column))
            firsts, found = words.firsts, run_hashes(words.hashes, shingle)
            place = np.searchsorted(wanted, found)
            hit = np.flatnonzero(wanted[np.minimum(place, len(wanted) - 1)] == found)
            doc = owners(firsts)
            hit = hit[doc[hit] == doc[hit + shingle - 1]]
            pairs = np.unique(np.stack([doc[hit], place[hit]]), axis=1)
            np.add.at(count, pairs[1], 1)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(wanted[used].view(np.int64)), pa.array(count[used])], ["shingle", "n"])

    counted = docs.select(text_column).mapInArrow(run, "shingle bigint, n bigint")
    summed = counted.groupBy("shingle").agg(F.sum("n").alias("n")).toArrow()
    return dict(zip(summed.column("shingle").to_pylist(), summed.column("n").to_pylist(), strict=True))


def index_block(docs: DataFrame, text_column: str, rows: list[tuple[str | None, str | None]], window: int, shingle: int) -> Windows:
    arrays, spelled, items = item_windows(rows, window)
    shingles = {size: min(shingle, size) for size in arrays}
    tables = {size: shingle_rows(found, shingles[size]) for size, found in arrays.items()}
    # A window of one shingle has no choice of prefix and needs no frequencies.
    choosing = [found.reshape(-1) for size, found in tables.items() if found.shape[1] > 1]
    wanted = np.unique(np.concatenate(choosing)) if choosing else np.zeros(0, np.uint64)
    df = frequencies(docs, text_column, wanted, shingle) if len(wanted) else {}
    index = Windows(arrays, spelled, items, {}, {}, {}, shingles)
    for size, found in tables.items():
        counts = np.array([[df.get(value, 0) for value in row] for row in found.view(np.int64).tolist()])
        place = counts.argmin(axis=1)
        key = found[np.arange(len(found)), place]
        order = np.argsort(key, kind="stable")
        index.prefix[size], index.offset[size], index.order[size] = key[order], place[order], order
    return index


def find_hits(words: Words, index: Windows) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Starts and ends of all verified occurrences (in words of the batch), and their (size, window)."""
    hashes, firsts = words.hashes, words.firsts
    starts, ends, which = [], [], []
    doc_end = np.repeat(firsts[1:], np.diff(firsts))
    doc_start = np.repeat(firsts[:-1], np.diff(firsts))
    by_shingle: dict[int, np.ndarray] = {}
    for size, prefix in index.prefix.items():
        k = index.shingles[size]
        if k not in by_shingle:
            by_shingle[k] = run_hashes(hashes, k)
        found = by_shingle[k]
        low, high = np.searchsorted(prefix, found, "left"), np.searchsorted(prefix, found, "right")
        at = np.flatnonzero(high > low)
        if not len(at):
            continue
        width = (high - low)[at]
        place = np.repeat(at, width)
        entry = np.repeat(low[at], width) + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
        start = place - index.offset[size][entry]
        fits = (start >= doc_start[place]) & (start + size <= doc_end[place])
        start, window = start[fits], index.order[size][entry[fits]]
        for cut in range(0, len(start), 100_000):
            some, numbers = start[cut : cut + 100_000], window[cut : cut + 100_000]
            same = (hashes[some[:, None] + np.arange(size)] == index.hashes[size][numbers]).all(axis=1)
            for at in np.flatnonzero(same).tolist():
                same[at] = words.spelled(some[at], size) == index.spelled[size][numbers[at]]
            starts.append(some[same])
            ends.append(some[same] + size)
            which.extend((size, int(number)) for number in numbers[same])
    none = np.zeros(0, np.int64)
    return np.concatenate(starts or [none]), np.concatenate(ends or [none]), which


def join_block(text_column: str, index: Windows):
    """Map function: rows with n_words, the merged hit spans and the ids of the items hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text_column, PIECE_BYTES):
            words = words_of(piece.column(text_column))
            hashes, firsts = words.hashes, words.firsts
            starts, ends, which = find_hits(words, index)
            spans: list[list[dict]] = [[] for _ in range(piece.num_rows)]
            ids: list[set[str]] = [set() for _ in range(piece.num_rows)]
            if len(starts):
                doc = owners(firsts)[starts]
                change = np.zeros(len(hashes) + 1, np.int64)
                np.add.at(change, starts, 1)
                np.add.at(change, ends, -1)
                hit = np.cumsum(change[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
                owner = owners(firsts)
                for start, end in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                    while start < end:  # a run of hits may go on into the next text
                        row = int(owner[start])
                        stop = min(end, int(firsts[row + 1]))
                        spans[row].append({"start": start - int(firsts[row]), "end": stop - int(firsts[row])})
                        start = stop
                for row, (size, number) in set(zip(doc.tolist(), which, strict=True)):
                    ids[row].update(index.items[size][number])
            columns = [*piece.columns, pa.array(np.diff(firsts).astype(np.int64))]
            columns.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))))
            columns.append(pa.array([sorted(found) for found in ids], pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays(columns, [*piece.schema.names, *ADDED.fieldNames()])

    return run


def item_blocks(items: DataFrame, id_column: str, text_column: str, block_bytes: int) -> Iterator[list]:
    """Items in blocks of about ``block_bytes``: the block number is a hash, so no block waits for another."""
    total = items.agg(F.sum(F.octet_length(text_column)).alias("n")).first()["n"] or 0
    blocks = max(1, -(-2 * total // block_bytes)) if total > block_bytes else 1
    chosen = items.select(F.col(id_column).cast("string").alias("id"), F.col(text_column).alias("text"))
    number = F.pmod(F.xxhash64("id", "text"), F.lit(blocks))
    for block in range(blocks):
        yield [(row["id"], row["text"]) for row in chosen.where(number == block).distinct().collect()]


def annotate(
    docs: DataFrame,
    items: DataFrame,
    text_column: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    shingle: int = SHINGLE,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Rows of ``docs`` plus n_words, hit_spans (word positions, end exclusive) and hit_items.

    Columns of ``docs`` with one of those names are left out.
    """
    docs = without(docs, ADDED.fieldNames())
    schema = T.StructType([*docs.schema.fields, *ADDED.fields])
    parts = [
        docs.mapInArrow(join_block(text_column, index_block(docs, text_column, rows, window, shingle)), schema)
        for rows in item_blocks(items, item_column, item_text, block_bytes)
    ]
    if len(parts) == 1:
        return parts[0]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionAll(part)
    merged = union.groupBy(*docs.columns).agg(
        F.max("n_words").alias("n_words"),
        _merge_spans(F.flatten(F.collect_list("hit_spans"))).alias("hit_spans"),
        F.array_distinct(F.flatten(F.collect_list("hit_items"))).alias("hit_items"),
        (F.count("*") / len(parts)).cast("int").alias("copies"),
    )
    return merged.select(*docs.columns, *ADDED.fieldNames(), F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).drop("copy")


def _merge_spans(spans: Column) -> Column:
    """Union of possibly overlapping spans, in order."""
    return F.aggregate(
        F.sort_array(spans),
        F.array().cast(SPANS),
        lambda held, span: F.when(
            (F.size(held) > 0) & (F.element_at(held, -1)["end"] >= span["start"]),
            F.concat(
                F.slice(held, F.lit(1), F.size(held) - 1),
                F.array(F.struct(F.element_at(held, -1)["start"].alias("start"), F.greatest(F.element_at(held, -1)["end"], span["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(held, F.array(span))),
    )


def words_hit() -> Column:
    return F.aggregate("hit_spans", F.lit(0).cast("bigint"), lambda n, span: n + span["end"] - span["start"])


def contaminated() -> Column:
    """The contract's rule: some word is hit, and at least one in twenty."""
    return (words_hit() > 0) & (20 * words_hit() >= F.col("n_words"))


def clean(docs: DataFrame, items: DataFrame, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated."""
    plain, names = neutral(docs)
    return restored(annotate(plain, items, names[text_column]).where(~contaminated()), names)
