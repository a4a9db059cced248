"""Repeated byte strings by suffix arrays.

Every ``LENGTH``-byte string that starts at two or more places of the corpus is
removed wherever it starts. Three questions to the corpus narrow the work:

1. A string's least ``GRAM``-byte hash depends on the string alone. Strings whose
   least gram occurs once cannot repeat; most of the corpus ends here.
2. Neighbouring strings with one least gram form a segment. A segment that occurs
   twice as a whole repeats from end to end and needs no sorting.
3. The other segments of grams that several segments share are sorted: each pack
   is a shard with its own suffix array (Larsson-Sadakane refinement), common
   prefixes of neighbours (Kasai) give the distinct strings of the shard. Across
   shards the order of suffixes is not used: hashes of distinct strings are dealt
   to ranges of the hash, and each range is sorted by hash to find equal ones.

Across shards segments are compared by a hash of their bytes and that of their least
gram, strings by 96 bits of hash; inside a shard by the bytes themselves.

Defined results: null text counts as empty; matches never cross texts; strings
are judged on the input; repeated rows repeat each other; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from curveframe.llm.common import BASE, BASE_INVERSE, BYTE_VALUES, content_hashes, mix, powers, prefix_hash, span_hash, stage, total_bytes
from curveframe.llm.exchange import Keys, Pack, ask, gather, mask_in_order, masks_for, packs_of, same_as_before, spread, with_answers

LENGTH = 400
GRAM = 256
SECOND = np.uint64(0xC2B2AE3D27D4EB4F)
PLACE_BITS = np.uint64(36)
SCAN = 128  # suffixes of a block of Kasai's scan


def suffix_array(values: np.ndarray) -> np.ndarray:
    """All suffixes in order.

    Larsson-Sadakane: ranks double the number of items they reflect; only suffixes
    whose group is not settled are sorted again. Small items start four to a key.
    """
    n = len(values)
    first, width = values.astype(np.int64), 1
    if n and first.max() < (1 << 15) - 1:
        padded = np.append(first + 1, np.zeros(3, np.int64))
        first, width = padded[:n] << 45 | padded[1 : n + 1] << 30 | padded[2 : n + 2] << 15 | padded[3:], 4
    order = np.argsort(first)
    new = np.ones(n, dtype=bool)
    new[1:] = first[order][1:] != first[order][:-1]
    rank = np.empty(n, dtype=np.int64)
    starts = np.flatnonzero(new)
    rank[order] = np.repeat(starts, np.diff(np.append(starts, n)))
    while width < n:
        sizes = np.diff(np.append(np.flatnonzero(new), n))
        open_ = np.flatnonzero(np.repeat(sizes, sizes) > 1)  # places in the order that groups of two or more hold
        if not len(open_):
            break
        suffixes = order[open_]
        ahead = suffixes + width
        next_rank = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], -1)
        both = rank[suffixes] * (n + 1) + next_rank + 1
        again = np.argsort(both)
        suffixes, both = suffixes[again], both[again]
        order[open_] = suffixes
        new[open_[1:]] |= both[1:] != both[:-1]
        starts = np.flatnonzero(new)
        rank[order] = np.repeat(starts, np.diff(np.append(starts, n)))
        width *= 2
    return order


def kasai(values: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of each suffix with the one before it in order, ``most`` at most.

    Kasai's scan, in which a suffix starts from one less than the suffix before it,
    runs over all blocks of ``SCAN`` suffixes in step, eight items a comparison.
    """
    n = len(values)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    # Eight low bytes from each place on, and where the items beyond a byte start: those are compared one by one.
    low = np.append((values & 255).astype(np.uint8), np.zeros(8, np.uint8))
    words = np.lib.stride_tricks.sliding_window_view(low, 8)[: n + 1].copy().view("<u8").ravel()
    wide = np.append(np.flatnonzero(values > 255), n)
    until = np.repeat(wide, np.diff(np.append(-1, wide)))[:n]
    common = np.zeros(n, dtype=np.int64)
    heads = np.arange(0, n, SCAN)
    held = np.zeros(len(heads), dtype=np.int64)
    for step in range(min(SCAN, n)):
        heads = heads[: np.searchsorted(heads, n - step)]
        suffix, other = heads + step, before[heads + step]
        held = np.where(other < 0, 0, np.maximum(held[: len(heads)] - 1, 0))
        active = np.flatnonzero(other >= 0)
        while len(active):
            a, b, at = suffix[active], other[active], held[active]
            end = np.minimum(np.minimum(n - a, n - b), most)
            inside = at < end
            active, a, b, at, end = active[inside], a[inside], b[inside], at[inside], end[inside]
            if not len(active):
                break
            a, b = a + at, b + at
            differ = words[a] ^ words[b]
            equal = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3
            room = np.minimum(until[a] - a, until[b] - b)
            one = (room == 0) & (values[a] == values[b])
            grown = np.where(one, 1, np.minimum(np.minimum(equal, room), end - at))
            held[active] = at + grown
            active = active[one | (grown == np.minimum(8, room)) & (grown > 0)]
        common[suffix] = held
    return common[order]


class Segments:
    """Runs of string starts of a pack whose strings share their least gram."""

    def __init__(self, pack: Pack, length: int, gram: int) -> None:
        self.length = length
        raw, n = pack.raw, len(pack.raw)
        self.prefix = prefix_hash(BYTE_VALUES[raw])
        none = np.zeros(0, dtype=np.int64)
        self.first, self.last, self.gram_place, self.gram_hash = none, none, none, none.astype(np.uint64)
        sizes = np.diff(pack.offsets)
        strings = max(n - length + 1, 0)
        if not strings:
            return
        places = np.arange(n - gram + 1, dtype=np.uint64)
        grams = mix((self.prefix[gram:] - self.prefix[:-gram]) * powers(BASE_INVERSE, n + 1)[: n - gram + 1] + np.uint64(gram))
        # The upper bits of a hash decide, then the leftmost place: content alone, either way.
        ranked = (grams >> PLACE_BITS << PLACE_BITS) | places
        span = length - gram + 1
        blocks = -(-len(ranked) // span)
        padded = np.full(blocks * span, np.iinfo(np.uint64).max, dtype=np.uint64)
        padded[: len(ranked)] = ranked
        padded = padded.reshape(blocks, span)
        ahead = np.minimum.accumulate(padded, axis=1).ravel()
        behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:strings], ahead[span - 1 : span - 1 + strings])
        ends = np.repeat(pack.offsets[1:], sizes)
        starts = np.flatnonzero(np.arange(length, length + strings) <= ends[:strings])
        at = (least[starts] & np.uint64((1 << 36) - 1)).astype(np.int64)
        if not len(starts):
            return
        cut = np.ones(len(starts), dtype=bool)
        cut[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
        self.first = starts[cut]
        self.last = starts[np.append(np.flatnonzero(cut)[1:] - 1, len(starts) - 1)]
        self.gram_hash = grams[at[cut]]
        self.gram_place = at[cut]

    def keep(self, chosen: np.ndarray) -> None:
        self.first, self.last = self.first[chosen], self.last[chosen]
        self.gram_place, self.gram_hash = self.gram_place[chosen], self.gram_hash[chosen]

    def hashes(self, raw: np.ndarray) -> np.ndarray:
        """Of each segment's bytes and of where its gram lies in them."""
        body, _ = content_hashes(raw, self.first, self.last + self.length)
        return mix(body + (self.gram_place - self.first).astype(np.uint64) * BASE)


def _distinct_grams(segments: Segments) -> tuple[Keys, np.ndarray]:
    """Distinct least grams, whether two places of the pack have one, and the gram of each segment."""
    places = np.stack([segments.gram_hash, segments.gram_place.astype(np.uint64)]) if len(segments.first) else np.zeros((2, 0), np.uint64)
    once = np.unique(places, axis=1)
    key, counts = np.unique(once[0], return_counts=True)
    return Keys(key, {"several": (counts > 1).astype(np.uint8)}), np.searchsorted(key, segments.gram_hash)


def gram_keys(length: int, gram: int):
    def make(pack: Pack, _: dict) -> Keys:
        return _distinct_grams(Segments(pack, length, gram))[0]

    return make


def judge_counts(columns: dict[str, np.ndarray]) -> list[np.ndarray]:
    """Whether a gram has two places or more."""
    order = np.argsort(columns["key"], kind="stable")
    equal = same_as_before(columns["key"][order])
    return [spread(order, equal, 1 + columns["several"].astype(np.int64), np.add) > 1]


def _distinct_segments(gram: np.ndarray, hashes: np.ndarray) -> tuple[Keys, np.ndarray]:
    """Distinct segments by gram, whether the pack has two of one, and the number of each segment."""
    order = np.lexsort((hashes, gram))
    new = ~same_as_before(gram[order], hashes[order])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    counts = np.bincount(which, minlength=int(new.sum()))
    first = order[new]
    return Keys(gram[first], {"segment": hashes[first], "several": (counts > 1).astype(np.uint8)}), which


def _row(pack: Pack, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """What a pass found in a pack, as a row of its own that holds no text."""
    none = pa.array([[]], pa.list_(pa.int64()))
    held = [pa.array([column.tobytes()], pa.binary()) for column in columns.values()]
    return pa.RecordBatch.from_arrays(
        [pa.array([pack.number], pa.int64()), none, none, pa.array([b""], pa.binary()), *held], ["pack", "ids", "sizes", "body", *columns]
    )


FOUND = "pack bigint, ids array<bigint>, sizes array<bigint>, body binary"
OPEN = f"{FOUND}, first binary, last binary, gram binary, segment binary"
SORTED = f"{FOUND}, whole binary, starts binary, counts binary, key binary, second binary"


def _open(ranges: int, length: int, gram: int):
    """Segments whose least gram has other places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack, others in packs_of(batches):
            segments = Segments(pack, length, gram)
            keys, which = _distinct_grams(segments)
            segments.keep(masks_for(keys, others["grams"], ranges, 1)[0][which])
            yield _row(
                pack,
                {
                    "first": segments.first.astype("<u4"),
                    "last": segments.last.astype("<u4"),
                    "gram": segments.gram_hash.astype("<u8"),
                    "segment": segments.hashes(pack.raw).astype("<u8"),
                },
            )

    return run


def _held_segments(others: dict) -> tuple[Keys, np.ndarray]:
    return _distinct_segments(np.frombuffer(others["gram"], "<u8"), np.frombuffer(others["segment"], "<u8"))


def judge_segments(columns: dict[str, np.ndarray]) -> list[np.ndarray]:
    """Whether a segment occurs twice, and whether its gram has other segments."""
    key, segment = columns["key"], columns["segment"]
    order = np.lexsort((segment, key))
    key_, segment_ = key[order], segment[order]
    of_gram, of_segment = same_as_before(key_), same_as_before(key_, segment_)
    twice = spread(order, of_segment, 1 + columns["several"].astype(np.int64), np.add) > 1
    firsts = np.empty(len(order), np.int64)
    firsts[order] = ~of_segment
    return [twice, spread(order, of_gram, firsts, np.add) > 1]


def _sorted_strings(pack: Pack, others: dict, ranges: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments that repeat as a whole (as spans), and of the strings left to sort: starts in the order
    of their keys, the number of starts of each distinct string, its key and its second key."""
    none = np.zeros(0, np.int64)
    if not others["first"]:
        return np.zeros((0, 2), np.int64), none, none, none, none
    firsts, lasts = (np.frombuffer(others[name], "<u4").astype(np.int64) for name in ("first", "last"))
    keys, which = _held_segments(others)
    twice, mixed = (mask[which] for mask in masks_for(keys, others["segments"], ranges, 2))
    whole = np.stack([firsts[twice], lasts[twice]], axis=1)
    # Of equal segments of one pack the first is sorted for all; those that occur
    # twice only stand there for other segments to be compared with.
    chosen = np.zeros(len(which), dtype=bool)
    chosen[np.unique(which, return_index=True)[1]] = True
    chosen &= mixed
    first, last = firsts[chosen], lasts[chosen] + length
    if not len(first):
        return whole, none, none, none, none
    # Segments that overlap or touch are sorted as one stretch; stretches end in items no other has.
    cut = np.ones(len(first), dtype=bool)
    cut[1:] = first[1:] > np.maximum.accumulate(last)[:-1]
    heads = first[cut]
    tails = np.maximum.accumulate(last)[np.append(np.flatnonzero(cut)[1:] - 1, len(first) - 1)]
    stretches = [np.arange(a, b) for a, b in zip(heads.tolist(), tails.tolist(), strict=True)]
    places = np.concatenate([np.append(stretch, -1) for stretch in stretches])
    values = np.where(places >= 0, pack.raw[np.maximum(places, 0)].astype(np.int64), 0)
    ends = np.flatnonzero(places < 0)
    values[ends] = 256 + np.arange(len(ends))
    order = suffix_array(values)
    common = kasai(values, order, length)
    wanted = np.zeros(len(pack.raw) + 1, dtype=bool)
    change = np.zeros(len(pack.raw) + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, last - length + 1, -1)
    wanted[:-1] = np.cumsum(change[:-1]) > 0
    string = np.cumsum(common < length) - 1  # neighbours with a whole string in common are one string
    real = (places[order] >= 0) & wanted[np.maximum(places[order], 0)]
    starts, string = places[order][real], string[real]
    # The same place may be told by two stretches only if they overlap, and those are one.
    cuts = np.flatnonzero(np.append(True, string[1:] != string[:-1])) if len(string) else none
    counts, head = np.diff(np.append(cuts, len(string))), starts[cuts]
    byte_values = BYTE_VALUES[pack.raw]
    key = span_hash(prefix_hash(byte_values), head, head + length)
    other = span_hash(prefix_hash(byte_values, SECOND), head, head + length, SECOND) >> np.uint64(32)
    by_key = np.argsort(key, kind="stable")
    rank = np.empty(len(by_key), np.int64)
    rank[by_key] = np.arange(len(by_key))
    starts = starts[np.argsort(np.repeat(rank, counts), kind="stable")]
    return whole, starts, counts[by_key], key[by_key], other[by_key]


def _sort(ranges: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack, others in packs_of(batches):
            whole, starts, counts, key, second = _sorted_strings(pack, others, ranges, length)
            yield _row(
                pack,
                {
                    "whole": whole.astype("<i8"),
                    "starts": starts.astype("<u4"),
                    "counts": counts.astype("<u4"),
                    "key": key.astype("<u8"),
                    "second": second.astype("<u4"),
                },
            )

    return run


def _held_strings(others: dict) -> Keys:
    several = (np.frombuffer(others["counts"], "<u4") > 1).astype(np.uint8)
    return Keys(np.frombuffer(others["key"], "<u8"), {"second": np.frombuffer(others["second"], "<u4"), "several": several})


def judge_strings(columns: dict[str, np.ndarray]) -> list[np.ndarray]:
    """Whether a string starts twice: in its own shard, or in another, by equal hashes in one range of the hash."""
    order = np.lexsort((columns["second"], columns["key"]))
    equal = same_as_before(columns["key"][order], columns["second"][order])
    return [spread(order, equal, 1 + columns["several"].astype(np.int64), np.add) > 1]


def _remove(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack, others in packs_of(batches):
            whole = np.frombuffer(others["whole"], "<i8").reshape(-1, 2)
            starts, counts = np.frombuffer(others["starts"], "<u4").astype(np.int64), np.frombuffer(others["counts"], "<u4")
            change = np.zeros(len(pack.raw) + 1, np.int64)
            np.add.at(change, whole[:, 0], 1)
            np.add.at(change, whole[:, 1] + length, -1)
            if len(starts):
                repeated = starts[np.repeat(mask_in_order(others["strings"]), counts)]
                np.add.at(change, repeated, 1)
                np.add.at(change, repeated + length, -1)
            gone = np.cumsum(change[:-1]) > 0
            rows = []
            for number, identity in enumerate(pack.ids):
                own = slice(pack.offsets[number], pack.offsets[number + 1])
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone[own].view(np.int8), [0]]))).tolist()
                spans = [{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2], strict=True)]
                rows.append((identity, own.stop - own.start, spans, pack.raw[own][~gone[own]].tobytes()))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(columns[0], pa.int64()),
                    pa.array(columns[1], pa.int64()),
                    pa.array(columns[2], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array(columns[3], pa.binary()),
                ],
                ["id", "n_bytes", "removed", "kept_bytes"],
            )

    return run


def remove_repeats(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH, gram: int = GRAM
) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, removed (byte spans, end exclusive), kept_bytes."""
    packs = gather(docs, id_column, text_column)
    # Numbers of keys only size the key ranges.
    size = total_bytes(docs, text_column)
    grams = 2 * size // (length - gram + 2)
    answers, n = ask(packs, None, gram_keys(length, gram), judge_counts, grams, "grams", kinds={"several": "u1"})
    # Each later pass writes what it found beside the packs, so nothing is searched twice.
    opened = stage(with_answers(packs, answers).mapInArrow(_open(n, length, gram), OPEN), "open")
    kinds = {"segment": "<u8", "several": "u1"}
    answers, n = ask(opened, None, lambda pack, others: _held_segments(others)[0], judge_segments, grams // 2, "segments", kinds=kinds)
    opened = opened.drop("ids", "sizes", "body").join(answers, "pack", "left")
    found = stage(with_answers(packs, opened).mapInArrow(_sort(n, length), SORTED), "sorted")
    kinds = {"second": "<u4", "several": "u1"}
    repeats, _ = ask(found, None, lambda pack, others: _held_strings(others), judge_strings, size // 10, "strings", kinds=kinds)
    held = with_answers(packs, found.select("pack", "whole", "starts", "counts").join(repeats, "pack", "left"))
    schema = "id bigint, n_bytes bigint, removed array<struct<start:bigint,end:bigint>>, kept_bytes binary"
    return held.mapInArrow(_remove(length), schema).withColumnRenamed("id", id_column)
