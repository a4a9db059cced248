"""Helpers shared by the corpus operators: staging, byte classes and rolling hashes."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from curveframe.session import checkpoint_directory

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

# Odd 64-bit multipliers; powers of an odd number have inverses modulo 2^64.
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a frame once to the folder all executors share and read it back.

    Cuts lineage the way ``checkpoint()`` does, but compressed and with column
    pruning for later readers. The files stay until the folder is cleared.
    """
    return _written(df, f"{checkpoint_directory(df.sparkSession)}/{name}-{uuid.uuid4().hex}")


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def staged(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """``stage`` for a frame that is read inside the block only: its files are deleted at the block's end."""
    spark = df.sparkSession
    path = f"{checkpoint_directory(spark)}/{name}-{uuid.uuid4().hex}"
    try:
        yield _written(df, path)
    finally:
        files = spark._jvm.org.apache.hadoop.fs.Path(path)
        files.getFileSystem(spark._jsc.hadoopConfiguration()).delete(files, True)


def without(docs: DataFrame, names: list[str]) -> DataFrame:
    """``docs`` without columns that an operator is about to add: the operator's own win."""
    taken = {name.lower() for name in names}
    return docs.drop(*[name for name in docs.columns if name.lower() in taken])


def neutral(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with names that no operator uses, and those names by the old ones."""
    names = {name: f"in_{place}" for place, name in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def restored(docs: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns that ``neutral`` renamed, and only those, under their old names."""
    return docs.select(*names.values()).toDF(*names)


def with_results(
    docs: DataFrame,
    column: str,
    results: str,
    make: Callable[[pa.Array], list[pa.Array]],
    keep: bool = True,
    limit: int = 4 << 20,
) -> DataFrame:
    """``docs`` with the columns that ``results`` (a DDL list) names, made from arrays of ``column`` by tasks.

    An array holds ``limit`` bytes, or one longer value. The results win over columns of the same
    name; ``keep`` says whether ``column`` stays.
    """
    from pyspark.sql import types as T

    added = T.StructType.fromDDL(results)
    taken = [field.name for field in added.fields if field.name.lower() != column.lower()]
    named, names = neutral(without(docs, taken))
    source = names[next(name for name in names if name.lower() == column.lower())]
    stay = {old: new for old, new in names.items() if keep or new != source}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, source, limit):
            columns = [piece.column(new) for new in stay.values()]
            yield pa.RecordBatch.from_arrays([*columns, *make(piece.column(source))], [*stay.values(), *added.names])

    schema = T.StructType([*[named.schema[new] for new in stay.values()], *added.fields])
    return named.mapInArrow(run, schema).toDF(*stay, *added.names)


def total_bytes(df: DataFrame, column: str = "text") -> int:
    from pyspark.sql import functions as F

    return df.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the text of a piece stays near ``limit`` bytes; a row is never cut."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of an Arrow string column as one byte array and n + 1 offsets; null counts as empty."""
    import pyarrow.compute as pc

    if pa.types.is_dictionary(column.type):
        column = column.dictionary_decode()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    column = pa.concat_arrays([column])
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser that spreads a 64-bit value over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def worker_memory(name: str) -> dict:
    """A dictionary that lives as long as the Python process, over all its tasks."""
    return vars(sys.modules.setdefault(name, types.ModuleType(name)))


def forget(name: str) -> None:
    """Gives up what ``worker_memory`` holds under a name."""
    sys.modules.pop(name, None)


def powers(base: np.uint64, n: int) -> np.ndarray:
    """The first ``n`` powers; the longest row asked for so far is kept."""
    memory, key = worker_memory("curveframe_powers"), f"base_{int(base)}"
    if key not in memory or len(memory[key]) < n:
        out = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        out[0] = 1
        memory[key] = np.multiply.accumulate(out, dtype=np.uint64)
    return memory[key][:n]


# A random-looking value for each byte.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64))


def prefix_hash(values: np.ndarray, base: np.uint64 = BASE) -> np.ndarray:
    """Prefix sums of a polynomial modulo 2^64; ``span_hash`` turns two of them into a span's hash."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(base, len(values)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64 = BASE) -> np.ndarray:
    inverse = powers(np.uint64(pow(int(base), -1, 1 << 64)), len(prefix))
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_spans(raw: np.ndarray, offsets: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts: starts, ends (exclusive) and n + 1 offsets of each text's first word.

    ``breaks`` says for each byte value whether it separates words; a text border does too.
    """
    inside = ~breaks[raw]
    change = np.empty(len(raw) + 1, dtype=bool)
    change[0] = True
    change[-1] = True
    change[1:-1] = inside[1:] != inside[:-1]
    change[offsets] = True
    edges = np.flatnonzero(change)
    starts, ends = edges[:-1], edges[1:]
    keep = inside[starts] if len(starts) else np.zeros(0, bool)
    starts, ends = starts[keep], ends[keep]
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    return span_hash(prefix_hash(BYTE_VALUES[raw]), starts, ends)


def window_hashes(hashes: np.ndarray, size: int, base: np.uint64 = BASE) -> np.ndarray:
    """Hash of each run of ``size`` items; runs may cross text borders, callers mask those."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    prefix = prefix_hash(mix(hashes ^ base), base)
    starts = np.arange(n)
    return span_hash(prefix, starts, starts + size, base)


LANES = np.array([(1 << 8 * size) - 1 for size in range(9)], dtype=np.uint64)
# Odd 64-bit constants of the two chains and of joining them.
CHAINS = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)
LONG_WORD = 256


def content_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each word's bytes, for comparing words by content.

    Two chains take eight bytes at a time and are mixed after each step, so that no pattern
    of bytes cancels out, as it can in a polynomial; words beyond ``LONG_WORD`` bytes are
    hashed by BLAKE2.
    """
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    lanes = np.ndarray(len(raw) + 1, dtype="<u8", buffer=padded, strides=(1,))
    sizes = ends - starts
    one = mix(sizes.astype(np.uint64) * CHAINS[0])
    two = mix(one ^ CHAINS[1])
    rows, at = np.flatnonzero(sizes <= LONG_WORD), 0
    while len(rows):
        left = sizes[rows] - at
        if at:
            rows, left = rows[left > 0], left[left > 0]
        chunk = lanes[starts[rows] + at] & LANES[np.minimum(left, 8)]
        one[rows] = mix(one[rows] ^ chunk)
        two[rows] = mix((two[rows] + chunk) * CHAINS[2])
        at += 8
    for row in np.flatnonzero(sizes > LONG_WORD).tolist():
        digest = blake2b(raw[starts[row] : ends[row]].tobytes(), digest_size=16).digest()
        one[row], two[row] = np.frombuffer(digest, "<u8")
    return mix(one + (two << np.uint64(32) | two >> np.uint64(32))), mix(two * CHAINS[3] ^ one)


def _join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix((left ^ CHAINS[1]) * CHAINS[2] + mix(right ^ CHAINS[3]))


def run_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` items, joined from runs of powers of two; runs may cross text borders, callers mask those."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    power, width, found, covered = mix(hashes ^ CHAINS[0]), 1, None, 0
    while True:
        if size & width:
            found = power[:n] if found is None else _join(found, power[covered : covered + n])
            covered += width
        if covered == size:
            return found
        power = _join(power[:-width], power[width:])
        width *= 2


def owners(offsets: np.ndarray) -> np.ndarray:
    """Index of the text each item belongs to."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def signed(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)
