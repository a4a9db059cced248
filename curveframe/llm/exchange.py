"""Questions that packs of documents ask of the whole corpus.

Documents are gathered into packs of bounded size, written once to a table that
is bucketed by pack, so that later passes join answers to packs without moving
texts again. A pass derives sorted distinct keys from each pack, deals them to
ranges of the key space, lets each range judge the keys of all packs together,
and returns one bit per key in the pack's own order. Keys that one pack holds
many times travel once, so a text, line or passage that fills a third of the
corpus costs each pack a few bytes.

Key ranges hold about ``RANGE_KEYS`` keys each, whatever the size of the corpus.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curveframe.llm.common import stage, total_bytes
from curveframe.session import checkpoint_directory

PACK_BYTES = 2 << 20
PACK_ROWS = 20_000
RANGE_KEYS = 3_000_000
PACKS = "pack bigint, ids array<bigint>, sizes array<bigint>, body binary"


@dataclass
class Pack:
    """Texts of a pack as one byte array; ``offsets`` has n + 1 entries, ``ids`` may hold None."""

    number: int
    ids: list[int | None]
    offsets: np.ndarray
    raw: np.ndarray


def _gather(id_column: str, text_column: str, pack_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        ids, bodies, size = [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal number, ids, bodies, size
            columns = [
                pa.array([number], pa.int64()),
                pa.array([ids], pa.list_(pa.int64())),
                pa.array([[len(body) for body in bodies]], pa.list_(pa.int64())),
                pa.array([b"".join(bodies)], pa.binary()),
            ]
            number, ids, bodies, size = number + 1, [], [], 0
            return pa.RecordBatch.from_arrays(columns, ["pack", "ids", "sizes", "body"])

        for batch in batches:
            for identity, text in zip(batch.column(id_column), batch.column(text_column), strict=True):
                body = (text.as_py() or "").encode()
                if bodies and (size + len(body) > pack_bytes or len(ids) >= PACK_ROWS):
                    yield close()
                ids.append(identity.as_py())
                bodies.append(body)
                size += len(body)
        if ids:
            yield close()

    return run


def gather(docs: DataFrame, id_column: str, text_column: str, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """The texts of ``docs`` in packs, one row each, bucketed by pack."""
    spark = docs.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total_bytes(docs, text_column) // (16 * pack_bytes), 1)
    packs = docs.select(id_column, text_column).mapInArrow(_gather(id_column, text_column, pack_bytes), PACKS)
    name = f"packs_{uuid.uuid4().hex}"
    writer = packs.write.format("parquet").option("compression", "zstd").option("path", f"{checkpoint_directory(spark)}/{name}")
    writer.bucketBy(buckets, "pack").saveAsTable(name)
    table = spark.table(name)
    table.schema  # noqa: B018 - resolved before the name goes; the files stay
    spark.sql(f"DROP TABLE {name}")
    return table


def packs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Pack, dict]]:
    """Packs of a batch stream, each with the row's other columns."""
    for batch in batches:
        for row in range(batch.num_rows):
            sizes = batch.column("sizes")[row].values.to_numpy(zero_copy_only=False)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            raw = np.frombuffer(batch.column("body")[row].as_buffer(), dtype=np.uint8)
            others = {name: batch.column(name)[row].as_py() for name in batch.schema.names if name not in ("pack", "ids", "sizes", "body")}
            yield Pack(batch.column("pack")[row].as_py(), batch.column("ids")[row].as_py(), offsets, raw), others


@dataclass
class Keys:
    """Keys in ascending order with columns beside them; ``order`` says how equal keys are told apart."""

    key: np.ndarray
    beside: dict[str, np.ndarray] = field(default_factory=dict)


def ranges_of(key: np.ndarray, ranges: int) -> np.ndarray:
    """Start of each key range in ascending keys, and the end."""
    high = (key >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
    return np.searchsorted(high, np.arange(ranges + 1))


def _ask(make: Callable[[Pack, dict], Keys], ranges: int, wide: int, kinds: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack, others in packs_of(batches):
            keys = make(pack, others)
            bounds = ranges_of(keys.key, ranges)
            used = np.flatnonzero(np.diff(bounds))
            if not len(used):
                continue
            columns = {"key": keys.key.astype("<u4" if wide == 4 else "<u8")} | {name: keys.beside[name].astype(kind) for name, kind in kinds.items()}
            cut = [pa.array([column[bounds[at] : bounds[at + 1]].tobytes() for at in used], pa.binary()) for column in columns.values()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(used.astype(np.int32)), pa.array(np.full(len(used), pack.number)), *cut], ["place", "pack", *columns]
            )

    return run


def _judge(verdict: Callable[[dict[str, np.ndarray]], list[np.ndarray]], wide: int, kinds: dict[str, str]):
    types = {"key": "<u4" if wide == 4 else "<u8"} | kinds

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*[batch.column(name).to_pylist() for name in ("place", "pack", *types)], strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place, group in groupby(rows(batches), key=lambda row: row[0]):
            packs, parts = [], []
            for row in group:
                packs.append(row[1])
                parts.append([np.frombuffer(value, kind) for value, kind in zip(row[2:], types.values(), strict=True)])
            sizes = [len(part[0]) for part in parts]
            columns = {name: np.concatenate([part[at] for part in parts]) for at, name in enumerate(types)}
            masks = verdict(columns)
            cuts = np.cumsum(sizes)[:-1]
            bits = [[np.packbits(part).tobytes() for part in np.split(mask, cuts)] for mask in masks]
            for at in range(0, len(packs), 1_000):
                some = slice(at, at + 1_000)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(packs[some], pa.int64()),
                        pa.array([place] * len(packs[some]), pa.int32()),
                        pa.array(sizes[some], pa.int32()),
                        pa.array([list(found) for found in zip(*[bit[some] for bit in bits], strict=True)], pa.list_(pa.binary())),
                    ],
                    ["pack", "place", "n", "masks"],
                )

    return run


def ask(
    packs: DataFrame,
    answers: DataFrame | None,
    make: Callable[[Pack, dict], Keys],
    verdict: Callable[[dict[str, np.ndarray]], list[np.ndarray]],
    keys: int,
    name: str,
    wide: int = 8,
    kinds: dict[str, str] | None = None,
) -> tuple[DataFrame, int]:
    """Earlier ``answers`` plus a column ``name`` with the verdicts on each pack's keys, and the number of ranges.

    ``keys`` is about how many keys there are; ``kinds`` names the columns beside the key.
    """
    kinds = kinds or {}
    ranges = max(1, -(-keys // RANGE_KEYS), int(packs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    source = packs if answers is None else packs.join(answers, "pack", "left")
    schema = "place int, pack bigint, key binary" + "".join(f", {kind} binary" for kind in kinds)
    asked = source.mapInArrow(_ask(make, ranges, wide, kinds), schema)
    dealt = asked.repartition(ranges, "place").sortWithinPartitions("place")
    judged = dealt.mapInArrow(_judge(verdict, wide, kinds), "pack bigint, place int, n int, masks array<binary>")
    found = judged.groupBy("pack").agg(F.collect_list(F.struct("place", "n", "masks")).alias(name))
    if answers is not None:
        found = found.join(answers, "pack", "full")
    return stage(found, name), ranges


def masks_for(keys: Keys, answer: list[dict] | None, ranges: int, number: int) -> list[np.ndarray]:
    """The ``number`` verdict masks on keys that ``make`` gave, in their order."""
    bounds = ranges_of(keys.key, ranges)
    masks = [np.zeros(len(keys.key), dtype=bool) for _ in range(number)]
    for part in answer or []:
        start, end = bounds[part["place"]], bounds[part["place"] + 1]
        for mask, bits in zip(masks, part["masks"], strict=True):
            mask[start:end] = np.unpackbits(np.frombuffer(bits, np.uint8), count=end - start)
    return masks


def mask_in_order(answer: list[dict] | None) -> np.ndarray:
    """The only mask of an answer, in the order of the pack's keys: every range that has keys answers."""
    parts = sorted(answer or [], key=lambda part: part["place"])
    bits = [np.unpackbits(np.frombuffer(part["masks"][0], np.uint8), count=part["n"]) for part in parts]
    return np.concatenate([np.zeros(0, np.uint8), *bits]).astype(bool)


def with_answers(packs: DataFrame, answers: DataFrame) -> DataFrame:
    return packs.join(answers, "pack", "left")


def spread(order: np.ndarray, equal: np.ndarray, values: np.ndarray, reduce: np.ufunc) -> np.ndarray:
    """For rows in ``order`` whose groups start where ``equal`` is False: the reduced value of each row's group."""
    starts = np.flatnonzero(~equal)
    total = reduce.reduceat(values[order], starts)
    out = np.empty(len(order), dtype=total.dtype)
    out[order] = np.repeat(total, np.diff(np.append(starts, len(order))))
    return out


def same_as_before(*columns: np.ndarray) -> np.ndarray:
    """Whether each row equals the row before it in all columns."""
    same = np.ones(len(columns[0]), dtype=bool)
    if len(same):
        same[0] = False
    for column in columns:
        same[1:] &= column[1:] == column[:-1]
    return same
