"""Repeated passages by fixed-block anchors.

Every document is cut into reference blocks of ``BLOCK`` words. A run of
``window`` words, wherever it starts, holds a whole block if ``window`` is at
least ``2 * BLOCK - 1``. All blocks are indexed, and every rolling window of
``BLOCK`` words of every document probes the index. Hits are extended: the
``window``-word runs around them are compared over the corpus, and neighbouring
runs that repeat merge to maximal repeats.

A run is removed when its words also start in a document with a smaller id.

Runs are compared by 96 bits of two independent hashes of their words' bytes, anchors by
fewer: a false anchor only costs work.

Defined results: null and wordless texts have no words; rows without an id count
as larger than all others, and keep what only they share; rows that share an id
are no smaller than each other; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from curveframe.llm.common import SPACE, content_hashes, owners, run_hashes, total_bytes, word_spans
from curveframe.llm.exchange import Keys, Pack, ask, gather, masks_for, packs_of, same_as_before, spread, with_answers

WINDOW = 50
BLOCK = 25
LAST = np.int64((1 << 63) - 1)


def words_of(pack: Pack) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, word ends, and n + 1 word offsets of the texts."""
    return word_spans(pack.raw, pack.offsets, SPACE)


def hashes_of(pack: Pack) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n + 1 word offsets of the texts, and two hashes of each word that do not depend on each other."""
    starts, ends, firsts = words_of(pack)
    return firsts, *content_hashes(pack.raw, starts, ends)


def _runs(hashes: np.ndarray, firsts: np.ndarray, size: int) -> np.ndarray:
    """Places where a run of ``size`` words starts that stays inside its text."""
    doc = owners(firsts)
    n = max(len(hashes) - size + 1, 0)
    return np.flatnonzero(doc[:n] == doc[size - 1 : size - 1 + n]) if n else np.zeros(0, np.int64)


def anchor_keys(block: int):
    """Distinct rolling windows of a pack, whether one of them is a reference block, whether two texts hold it."""

    def make(pack: Pack, _: dict) -> Keys:
        firsts, hashes, _ = hashes_of(pack)
        at = _runs(hashes, firsts, block)
        found = run_hashes(hashes, block)[at]
        doc = owners(firsts)[at]
        aligned = (at - firsts[doc]) % block == 0
        order = np.argsort(found, kind="stable")
        found, doc, aligned = found[order], doc[order], aligned[order]
        starts = np.flatnonzero(~same_as_before(found))
        if not len(starts):
            return Keys(found, {"flags": np.zeros(0, np.uint8)})
        several = np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts)
        flags = np.logical_or.reduceat(aligned, starts) + 2 * several
        return Keys(found[starts], {"flags": flags.astype(np.uint8)})

    return make


def judge_anchors(columns: dict[str, np.ndarray]) -> list[np.ndarray]:
    """A window counts when it is a reference block somewhere and at least two texts hold it."""
    key, flags = columns["key"], columns["flags"]
    order = np.argsort(key, kind="stable")
    equal = same_as_before(key[order])
    indexed = spread(order, equal, flags & 1, np.maximum)
    holders = spread(order, equal, 1 + (flags >> 1).astype(np.int64), np.add)
    return [(indexed > 0) & (holders > 1)]


def _windows(pack: Pack, anchors: list[dict] | None, ranges: int, window: int, block: int) -> tuple[np.ndarray, ...]:
    """Runs around anchor hits: place, text, key and second hash."""
    firsts, hashes, others = hashes_of(pack)
    keys = anchor_keys(block)(pack, {})
    hit_keys = keys.key[masks_for(keys, anchors, ranges, 1)[0]]
    at = _runs(hashes, firsts, window)
    if not len(hit_keys) or not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none.astype(np.uint32)
    rolling = run_hashes(hashes, block)
    place = np.minimum(np.searchsorted(hit_keys, rolling), len(hit_keys) - 1)
    hits = np.concatenate([[0], np.cumsum(hit_keys[place] == rolling)])
    at = at[hits[at + window - block + 1] > hits[at]]
    doc = owners(firsts)[at]
    second = run_hashes(others, window)[at] >> np.uint64(32)
    return at, doc, run_hashes(hashes, window)[at], second.astype(np.uint32)


def _ids(pack: Pack) -> np.ndarray:
    return np.array([LAST if identity is None else identity for identity in pack.ids], dtype=np.int64)


def _distinct(pack: Pack, doc: np.ndarray, key: np.ndarray, second: np.ndarray) -> tuple[Keys, np.ndarray]:
    """Distinct runs of a pack with the smallest id that holds each, and the run of each place."""
    low = _ids(pack)[doc]
    order = np.lexsort((low, second, key))
    new = ~same_as_before(key[order], second[order])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    first = order[new]
    return Keys(key[first], {"second": second[first], "low": low[first]}), which


def window_keys(ranges: int, window: int, block: int):
    def make(pack: Pack, others: dict) -> Keys:
        _, doc, key, second = _windows(pack, others["anchors"], ranges, window, block)
        return _distinct(pack, doc, key, second)[0]

    return make


def judge_windows(columns: dict[str, np.ndarray]) -> list[np.ndarray]:
    """Whether another pack holds the run under a smaller id."""
    key, second, low = columns["key"], columns["second"], columns["low"]
    order = np.lexsort((second, key))
    least = spread(order, same_as_before(key[order], second[order]), low, np.minimum)
    return [low > least]


def _remove(ranges: int, window_ranges: int, window: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack, others in packs_of(batches):
            starts, ends, firsts = words_of(pack)
            at, doc, key, second = _windows(pack, others["anchors"], ranges, window, block)
            gone = np.zeros(len(starts), dtype=bool)
            if len(at):
                keys, which = _distinct(pack, doc, key, second)
                elsewhere = masks_for(keys, others["windows"], window_ranges, 1)[0]
                repeated = at[elsewhere[which] | (_ids(pack)[doc] > keys.beside["low"][which])]
                change = np.zeros(len(starts) + 1, np.int64)
                np.add.at(change, repeated, 1)
                np.add.at(change, repeated + window, -1)
                gone = np.cumsum(change[:-1]) > 0
            raw = pack.raw.tobytes()
            rows: list[tuple] = []
            for number, identity in enumerate(pack.ids):
                first, last = int(firsts[number]), int(firsts[number + 1])
                own = gone[first:last]
                edges = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]]))).tolist()
                spans = [{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2], strict=True)]
                words = zip(starts[first:last][~own].tolist(), ends[first:last][~own].tolist(), strict=True)
                rows.append((identity, last - first, spans, b" ".join([raw[a:b] for a, b in words])))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(columns[0], pa.int64()),
                    pa.array(columns[1], pa.int64()),
                    pa.array(columns[2], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                    pa.array(columns[3], pa.binary()).cast(pa.string()),
                ],
                ["id", "n_words", "removed", "kept_text"],
            )

    return run


def remove_repeats(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW, block: int = BLOCK
) -> DataFrame:
    """One row per row of ``docs``: id, n_words, removed (word spans, end exclusive), kept_text (kept words, one blank apart)."""
    if window < 2 * block - 1:
        raise ValueError("A window must hold a whole block wherever it starts.")
    packs = gather(docs, id_column, text_column)
    # About one word in six bytes; these numbers only size the key ranges.
    words = total_bytes(docs, text_column) // 6
    answers, ranges = ask(packs, None, anchor_keys(block), judge_anchors, words, "anchors", wide=4, kinds={"flags": "u1"})
    answers, window_ranges = ask(
        packs, answers, window_keys(ranges, window, block), judge_windows, words // 3, "windows", kinds={"second": "<u4", "low": "<i8"}
    )
    schema = "id bigint, n_words bigint, removed array<struct<start:int,end:int>>, kept_text string"
    result = with_answers(packs, answers).mapInArrow(_remove(ranges, window_ranges, window, block), schema)
    return result.withColumnRenamed("id", id_column)
