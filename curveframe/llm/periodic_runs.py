"""Periodic runs of words: stretches that repeat with a period, found by recursive splitting.

A run is a stretch of consecutive words with smallest period q that is at least
``max(LEAST_WORDS, LEAST_EXPONENT * q)`` words long and that no neighbouring word extends.

1. Every word of a run occurs in it ``LEAST_EXPONENT`` times or more. So a word that occurs less
   often within its segment (at first the whole text) belongs to no run of the segment and splits
   it. This is repeated on the parts, which makes other words rare, until nothing changes; parts
   shorter than ``LEAST_WORDS`` go.
2. The surviving segments are compared with themselves at each lag below ``SCANNED``: a maximal
   stretch of equal pairs at lag q is a run if it is long enough and no smaller lag gave the
   same stretch (a stretch of four periods q has a smaller period only if that divides q).
3. In long segments, only lags at which something repeats are scanned. For lags from 2^k to
   2^(k+1), blocks of 2^(k+1) words get exact names by doubling (a block is the pair of its
   halves). Within a run of period q such a block, not shorter than the period, recurs first
   after q words; so the run is a stretch of places whose block recurs at that lag.

Each step treats all segments of all texts of a batch at once, in time n log n of their words.

Defined results: null text counts as empty; words are parted by ASCII white space and compared
byte by byte; a text without runs is returned with its words joined by one space; repeated rows
are treated each; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from curveframe.llm.common import with_results

LEAST_WORDS = 6
LEAST_EXPONENT = 4
SCANNED = 32
CHUNK_BYTES = 1 << 20

SPACE = re.compile(rb"[\x20\x09-\x0D]")
RUNS = "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def words_of(body: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in lists of a bounded part of it."""
    start = 0
    while start < len(body):
        cut = SPACE.search(body, start + CHUNK_BYTES)
        end = cut.start() if cut else len(body)
        yield body[start:end].split()
        start = end


def _borders(place: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """Where a new segment starts among the words that are left."""
    fresh = np.ones(len(place), bool)
    fresh[1:] = (place[1:] != place[:-1] + 1) | (segment[1:] != segment[:-1])
    return fresh


def split_rare(words: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words that survive and the number of each one's segment.

    ``words`` are numbers of words from 0, ``texts`` numbers of the texts they stand in.
    """
    place, segment, kinds = np.arange(len(words)), texts, int(words.max(initial=0)) + 1
    while len(place):
        _, kind, count = np.unique(segment * kinds + words[place], return_inverse=True, return_counts=True)
        frequent = count[kind] >= LEAST_EXPONENT
        place, segment = place[frequent], segment[frequent]
        segment = np.cumsum(_borders(place, segment)) - 1
        long = np.bincount(segment, minlength=1)[segment] >= LEAST_WORDS
        if frequent.all() and long.all():
            break
        place, segment = place[long], segment[long]
    return place, segment


def _stretches(mask: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each stretch of true entries within one group."""
    at = np.flatnonzero(mask)
    fresh = _borders(at, group[at])
    first = at[fresh]
    return first, np.diff(np.append(np.flatnonzero(fresh), len(at)))


def _scan(word: np.ndarray, segment: np.ndarray, size: np.ndarray, lags: int) -> list[tuple[np.ndarray, ...]]:
    """Stretches of equal pairs at each lag below ``lags``; longer lags see only the segments long enough for them."""
    found = []
    rows = np.arange(len(word))
    for lag in range(1, lags):
        rows = rows[size[rows] >= max(LEAST_WORDS, LEAST_EXPONENT * lag)]
        if not len(rows):
            break
        now, part = word[rows], segment[rows]
        equal = np.zeros(len(rows), bool)
        equal[:-lag] = (now[lag:] == now[:-lag]) & (part[lag:] == part[:-lag])
        first, count = _stretches(equal, part)
        long = count + lag >= max(LEAST_WORDS, LEAST_EXPONENT * lag)
        found.append((rows[first[long]], count[long] + lag, np.full(int(long.sum()), lag)))
    return found


def _recur(word: np.ndarray, segment: np.ndarray, size: np.ndarray, scanned: int) -> list[tuple[np.ndarray, ...]]:
    """Runs of periods from ``scanned``, a power of two, by the first recurrence of named blocks."""
    found = []
    block, period = 1, 1
    rows, name = np.arange(len(word)), word
    while len(rows):
        # Blocks of twice the length: a pair of names, half a new block apart in the same segment.
        rows_of = np.full(len(word) + 1, -1)
        rows_of[rows] = np.arange(len(rows))
        other = rows_of[np.minimum(rows + block, len(word))]
        whole = (other >= 0) & (segment[np.minimum(rows + block, len(word) - 1)] == segment[rows])
        whole &= size[rows] >= LEAST_EXPONENT * period
        rows, first, second = rows[whole], name[whole], name[other[whole]]
        block *= 2
        _, name, count = np.unique(first * (int(name.max(initial=0)) + 1) + second, return_inverse=True, return_counts=True)
        # Every block of a run that is still to be found occurs in it twice or more.
        again = count[name] > 1
        rows, name = rows[again], name[again]
        if period >= scanned:
            order = np.lexsort((rows, name, segment[rows]))
            before, after = order[:-1], order[1:]
            same = (name[before] == name[after]) & (segment[rows[before]] == segment[rows[after]])
            gap = np.zeros(len(word), np.int64)
            gap[rows[before[same]]] = (rows[after] - rows[before])[same]
            near = (gap >= period) & (gap < 2 * period)
            # The last words of a segment start no block, so stretches end with their segment.
            start, count = _stretches(near, np.cumsum(np.diff(gap, prepend=0) != 0))
            length = count + gap[start] + block - 1
            long = length >= np.maximum(LEAST_WORDS, LEAST_EXPONENT * gap[start])
            found.append((start[long], length[long], gap[start[long]]))
        period *= 2
    return found


def find_runs(words: np.ndarray, texts: np.ndarray, scanned: int = SCANNED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start (place among all words), length and period of every run, by start and period."""
    place, segment = split_rare(words, texts)
    if not len(place):
        return (np.zeros(0, np.int64),) * 3
    word, size = words[place], np.bincount(segment)[segment]
    found = [*_scan(word, segment, size, scanned), *_recur(word, segment, size, scanned)]
    start, length, period = (np.concatenate(part) for part in zip(*found, strict=True))
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    smallest = np.ones(len(start), bool)
    smallest[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[smallest], length[smallest], period[smallest]
    order = np.lexsort((period, start))
    return place[start[order]], length[order], period[order]


def _collapse(body: bytes, dropped: np.ndarray) -> bytes:
    if not dropped.any():
        return b" ".join(b" ".join(words) for words in words_of(body) if words)
    kept, at = [], 0
    for words in words_of(body):
        gone = dropped[at : at + len(words)].tolist()
        at += len(words)
        kept.append(b" ".join([word for word, out in zip(words, gone, strict=True) if not out]))
    return b" ".join(part for part in kept if part)


def _runs_of(texts: pa.Array) -> list[pa.Array]:
    numbers: defaultdict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    bodies = [(text or "").encode() for text in texts.to_pylist()]
    parts, sizes = [], []
    for body in bodies:
        before = len(parts)
        parts += [np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)) for words in words_of(body)]
        sizes.append(sum(map(len, parts[before:])))
    words = np.concatenate([*parts, np.zeros(0, np.int64)])
    offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    start, length, period = find_runs(words, np.repeat(np.arange(len(bodies)), sizes))
    # A word is dropped where more runs have passed their first period than have ended.
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    dropped = np.cumsum(change)[:-1] > 0
    bounds = np.searchsorted(start, offsets)
    owner = np.repeat(np.arange(len(bodies)), np.diff(bounds))
    runs = pa.StructArray.from_arrays([pa.array(start - offsets[owner]), pa.array(length), pa.array(period)], ["start", "length", "period"])
    collapsed = [_collapse(body, dropped[offsets[at] : offsets[at + 1]]).decode() for at, body in enumerate(bodies)]
    return [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), runs), pa.array(collapsed, pa.string())]


def collapse_runs(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` with ``runs`` (word number, length and period, by start and period) and ``collapsed`` in place of the text.

    ``collapsed`` has the words, joined by one space, of which every run keeps its first period.
    """
    return with_results(docs, text_column, RUNS, _runs_of, keep=False)
