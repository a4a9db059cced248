"""Lexical retrieval packing of token sequences.

1. Texts are tokenised once, by tasks. Document frequencies and the mean length are
   counted over all documents (one number per id of the vocabulary).
2. Documents are dealt to shards of bounded size by their heaviest terms, so that
   neighbours meet: those with one heaviest term among the terms common enough to
   fill a shard form a group; groups beyond a shard are split by the heaviest of all
   terms, and what is still too large by a hash. Small groups share shards.
   Each shard builds a BM25 inverted index over token ids with the weights of the
   whole corpus. The document at the start of a window is its seed; its best-scoring
   unused neighbours, over all of its terms, fill the window.
3. A document that does not fit is cut, and its rest seeds the next window, so
   windows are full; the end of a shard is cut into powers of two, which need no
   padding.

Defined results: null text counts as empty and consists of the final id alone;
repeated rows are packed each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curveframe.llm.common import (
    SPACE,
    content_hashes,
    forget,
    lower_ascii,
    pieces,
    stage,
    staged,
    text_bytes,
    total_bytes,
    word_spans,
    worker_memory,
)

WINDOW = 2048
FINAL_ID = 1
SHARD_BYTES = 6 << 20  # of text in a shard, on average
DENSE = 8  # terms in more than one of so many documents of a shard are held as full rows
K1, B = 1.2, 0.75
CACHED = 1_000_000  # words that an encoder knows
COMPOSING = 0xC9  # no combining mark is written in UTF-8 with bytes below
PIECE_BYTES = 2 << 20
MATRIX = 1 << 20  # weights of common terms that are added up at once
BLOCK_TOKENS = 1 << 18  # whose terms are counted at once
ENCODERS = "curveframe_word_encoders"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(byte) if byte in plain else chr(next(spare)) for byte in range(256)]


# Bytes that a word's borders are read from; each digit is a word. Letters beyond ASCII are those of U+00C0 to U+017F.
KINDS = np.full(256, 3, np.uint8)
KINDS[SPACE], KINDS[[*b"0123456789"]] = 0, 2
KINDS[[byte for byte in range(256) if byte >= 0x80 or chr(byte).isalpha()]] = 1


class WordEncoder:
    """Ids of whole texts by way of a table of words.

    The vocabulary drops white space and splits at it, and words are runs of letters, single digits and runs of other
    signs, so a text's ids are those of its words in order. Words are told apart by 128 bits of hash and looked up
    many at a time. A chunk between white space counts as one odd word, which the tokenizer gets whole, if it holds
    an apostrophe, the start of a special token, a sign beyond ASCII that is no letter of U+00C0 to U+017F (so
    multiplication and division), or the one of these letters whose lower case has a mark.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.letters = _byte_letters()
        self._clear(CACHED)

    def _clear(self, room: int) -> None:
        """Empties the table; at least half of its slots stay free with ``room`` words."""
        slots = 1 << (2 * room - 1).bit_length()
        self.room, self.used, self.taken = room, 0, 0
        self.one, self.two = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64)
        self.entry = np.full(slots, -1, np.int32)
        self.starts, self.sizes = np.zeros(room, np.int64), np.zeros(room, np.int32)
        self.ids = np.zeros(4 * room, np.uint32)

    def _find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Entries of words, -1 where unknown."""
        mask = np.uint64(len(self.entry) - 1)
        slots = (one & mask).astype(np.int64)
        found = self.entry[slots]
        rows = np.flatnonzero((found >= 0) & ((self.one[slots] != one) | (self.two[slots] != two)))
        slots = slots[rows]
        while len(rows):
            slots = (slots + 1) & int(mask)
            found[rows] = self.entry[slots]
            other = (found[rows] >= 0) & ((self.one[slots] != one[rows]) | (self.two[slots] != two[rows]))
            rows, slots = rows[other], slots[other]
        return found

    def _learn(self, one: np.ndarray, two: np.ndarray, words: list[bytes], odd: np.ndarray) -> None:
        """Takes up words that differ from each other and from all known ones."""
        ids = list(self._ids(words, odd))
        sizes = np.array([len(some) for some in ids])
        flat = np.array([token for some in ids for token in some], np.uint32)
        if self.taken + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.taken], np.zeros(len(flat) + len(self.ids), np.uint32)])
        self.ids[self.taken : self.taken + len(flat)] = flat
        entries = np.arange(self.used, self.used + len(ids), dtype=np.int32)
        self.starts[entries], self.sizes[entries] = self.taken + np.cumsum(sizes) - sizes, sizes
        self.used, self.taken = self.used + len(ids), self.taken + len(flat)
        mask = len(self.entry) - 1
        rows, slots = np.arange(len(ids)), (one & np.uint64(mask)).astype(np.int64)
        while len(rows):
            free = self.entry[slots] < 0
            self.entry[slots[free]] = entries[rows[free]]
            placed = self.entry[slots] == entries[rows]  # of rows that meet in a slot, the last one has it
            self.one[slots[placed]], self.two[slots[placed]] = one[rows[placed]], two[rows[placed]]
            rows, slots = rows[~placed], (slots[~placed] + 1) & mask

    def _ids(self, words: list[bytes], odd: np.ndarray) -> Iterator[list[int]]:
        """Ids by the tokenizer, or by its model alone, which wants words in lower case and spelled in its letters."""
        model, letters = self.model.tokenize, self.letters
        for word, whole in zip(b"\n".join(words).decode().split("\n"), odd.tolist(), strict=True):
            if whole:
                yield self.whole.encode(word, add_special_tokens=False).ids
                continue
            plain = word.lower()
            if not (plain.isascii() and plain.isprintable()):
                plain = "".join([letters[byte] for byte in plain.encode()])
            yield [token.id for token in model(plain)]

    def _words(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words of all texts, n + 1 offsets of each text's first word, and which words are odd."""
        kinds, after = KINDS[raw], np.append(raw[1:], 0)
        odd = (raw == ord("'")) | (raw == 0xC2) | (raw >= 0xC6) | ((raw == ord("<")) & (after == ord("|")))
        odd |= ((raw == 0xC3) & ((after == 0x97) | (after == 0xB7))) | ((raw == 0xC4) & (after == 0xB0))
        if odd.any():
            starts, ends, _ = word_spans(raw, offsets, SPACE)
            whole = np.unique(np.searchsorted(starts, np.flatnonzero(odd), side="right") - 1)
            starts, sizes = starts[whole], (ends - starts)[whole]
            kinds[np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())] = 4
        change = np.ones(len(raw) + 1, dtype=bool)
        change[1:-1] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == 2)
        change[offsets] = True
        edges = np.flatnonzero(change)
        starts, ends = edges[:-1], edges[1:]
        held = kinds[starts] > 0
        starts, ends = starts[held], ends[held]
        return starts, ends, np.searchsorted(starts, offsets), kinds[starts] == 4

    def _entries(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, odd: np.ndarray) -> np.ndarray:
        """Entries of all words of a piece of text; unknown ones are learnt."""
        one, two = content_hashes(raw, starts, ends)
        found, fresh = self._find(one, two), 0
        unknown = np.flatnonzero(found < 0)
        while len(unknown):
            # Of different words that share the first hash, one is learnt in a round.
            new = unknown[np.unique(one[unknown], return_index=True)[1]]
            if self.used + len(new) > self.room:
                self._clear(max(CACHED, len(starts)) if self.used > fresh else 2 * self.room)
                unknown, fresh = np.arange(len(starts)), 0
                continue
            words = [raw[start:end].tobytes() for start, end in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]
            self._learn(one[new], two[new], words, odd[new])
            fresh += len(new)
            found[unknown] = self._find(one[unknown], two[unknown])
            unknown = unknown[found[unknown] < 0]
        return found

    def encode_all(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text, without special tokens; null counts as empty."""
        raw, offsets = text_bytes(texts)
        if not len(raw):
            return [np.zeros(0, np.uint32)] * len(texts)
        # Lower case joins words, but before the tokenizer it might compose with marks or spell a special token.
        kept = raw >= COMPOSING
        kept[:-1] |= (raw[:-1] == ord("<")) & (raw[1:] == ord("|"))
        texts_kept = np.bincount(np.searchsorted(offsets, np.flatnonzero(kept), side="right") - 1, minlength=len(texts)) > 0
        raw = np.where(np.repeat(texts_kept, np.diff(offsets)), raw, lower_ascii(raw))
        starts, ends, firsts, odd = self._words(raw, offsets)
        entries = self._entries(raw, starts, ends, odd)
        sizes = self.sizes[entries].astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        flat = self.ids[np.repeat(self.starts[entries] - bounds[:-1], sizes) + np.arange(bounds[-1])]
        cuts = bounds[firsts].tolist()
        return [flat[start:end] for start, end in zip(cuts, cuts[1:], strict=False)]

    def encode(self, text: str) -> bytes:
        """Ids as unsigned little-endian 32-bit numbers, without special tokens."""
        return self.encode_all(pa.array([text]))[0].astype("<u4").tobytes()


def _tokenise(id_column: str, text_column: str, path: str, final_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = worker_memory(ENCODERS)
        if path not in memory:
            memory[path] = WordEncoder(path)
        end = np.array([final_id], dtype="<u4")
        for piece in pieces(batches, text_column, PIECE_BYTES):
            # Halves the shuffle: no id of the vocabulary needs more than 16 bits, or all keep 32.
            ids = [np.append(some, end).astype("<u4") for some in memory[path].encode_all(piece.column(text_column))]
            small = [array.astype("<u2").tobytes() if array.max() < 1 << 16 else b"\0" + array.tobytes() for array in ids]
            yield pa.RecordBatch.from_arrays([piece.column(id_column).cast(pa.int64()), pa.array(small, pa.binary())], ["id", "ids"])

    return run


def _unpack(ids: bytes) -> np.ndarray:
    """Ids as written by ``_tokenise``: 16 bits each, or 32 after an odd byte."""
    return np.frombuffer(ids[1:], "<u4") if len(ids) % 2 else np.frombuffer(ids, "<u2").astype("<u4")


def _blocks(packed: list[bytes]) -> Iterator[list[np.ndarray]]:
    """Documents as written by ``_tokenise``, in order, ``BLOCK_TOKENS`` ids or one longer document at once."""
    block, held = [], 0
    for packed_ids in packed:
        block.append(_unpack(packed_ids))
        held += len(block[-1])
        if held >= BLOCK_TOKENS:
            yield block
            block, held = [], 0
    if block:
        yield block


def _terms(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, frequency) of all terms of all documents, in this order."""
    flat = np.concatenate(docs)
    bits = int(flat.max()).bit_length()
    kind = np.uint32 if len(docs) << bits < 1 << 32 else np.uint64
    key = np.repeat(np.arange(len(docs), dtype=kind) << kind(bits), [len(ids) for ids in docs]) | flat.astype(kind)
    key.sort()
    edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    held = key[edges]
    return (held >> kind(bits)).astype(np.int64), (held & kind((1 << bits) - 1)).astype(np.int64), np.diff(edges, append=len(key))


@dataclass
class Corpus:
    """Counts over all documents: their number, their mean length, and of each id the documents that hold it."""

    count: int
    mean: float
    spread: np.ndarray

    @staticmethod
    def of(docs: list[np.ndarray]) -> Corpus:
        return Corpus(len(docs), sum(map(len, docs)) / len(docs), np.bincount(_terms(docs)[1]))

    @cached_property
    def rarity(self) -> np.ndarray:
        return np.log1p((self.count - self.spread + 0.5) / (self.spread + 0.5))

    def weights(self, terms: np.ndarray, frequency: np.ndarray, sizes: np.ndarray | int) -> np.ndarray:
        """BM25 weights of terms in documents of the given sizes."""
        length = K1 * (1 - B + B * sizes / max(self.mean, 1))
        return self.rarity[terms] * frequency * (K1 + 1) / (frequency + length)


class Bm25Index:
    """Inverted index of one shard: for each term, its documents and their BM25 weights in the corpus."""

    def __init__(self, docs: list[np.ndarray], corpus: Corpus) -> None:
        self.count = len(docs)
        sizes = np.array([len(ids) for ids in docs])
        owner, held, frequency = _terms(docs)
        # By term; terms of 16 bits are sorted by radix.
        order = np.argsort(held.astype(np.uint16) if held.max() < 1 << 16 else held, kind="stable")
        self.doc, term = owner[order], held[order]
        firsts = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
        self.bounds = np.append(firsts, len(term))
        self.weight = corpus.weights(term, frequency[order], sizes[self.doc])
        place = np.repeat(np.arange(len(firsts)), np.diff(self.bounds))
        self.place = np.empty_like(place)
        self.place[order] = place
        self.doc_bounds = np.searchsorted(owner, np.arange(self.count + 1))
        # Terms of many documents as rows of a matrix: adding rows is much faster than adding at places.
        common = np.diff(self.bounds) * DENSE > self.count
        self.row = np.where(common, np.cumsum(common) - 1, -1)
        self.dense = np.zeros((int(common.sum()), self.count), np.float32)
        at = np.flatnonzero(common[place])
        self.dense[self.row[place[at]], self.doc[at]] = self.weight[at]

    def neighbours(self, seed: int, free: np.ndarray, most: int = 8) -> list[int]:
        """Free documents that share terms with the seed, best first; ties by position."""
        places = self.place[self.doc_bounds[seed] : self.doc_bounds[seed + 1]]
        rows = self.row[places]
        score = np.zeros(self.count)
        common = rows[rows >= 0]
        for some in range(0, self.count if len(common) else 0, step := max(1, MATRIX // max(1, len(common)))):
            # Row by row in double precision.
            score[some : some + step] = np.add.reduce(self.dense[common, some : some + step], axis=0, dtype=np.float64)
        rare = places[rows < 0]
        starts, lengths = self.bounds[rare], self.bounds[rare + 1] - self.bounds[rare]
        at = np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        score += np.bincount(self.doc[at], weights=self.weight[at], minlength=self.count)
        score[~free] = 0
        best = np.argpartition(-score, min(most, self.count - 1))[:most]
        best = best[score[best] > 0]
        return best[np.lexsort((best, -score[best]))].tolist()


def packing_order(docs: list[np.ndarray], window: int, corpus: Corpus | None = None) -> list[int]:
    """Documents in the order in which they fill windows; ``corpus`` counts more documents than these."""
    index = Bm25Index(docs, corpus or Corpus.of(docs))
    free = np.ones(len(docs), dtype=bool)
    order: list[int] = []
    upcoming, used, seed, near = 0, 0, -1, []
    while len(order) < len(docs):
        chosen = -1
        if used and seed >= 0:
            while near and not free[near[0]]:
                near.pop(0)
            if near:
                chosen = near.pop(0)
            else:
                near = index.neighbours(seed, free)
                chosen = near.pop(0) if near else -1
        if chosen < 0:
            while not free[upcoming]:
                upcoming += 1
            chosen = upcoming
        free[chosen] = False
        order.append(chosen)
        before, used = used, used + len(docs[chosen])
        if before == 0 or used > window:  # this document starts the window that is open now
            seed, near = chosen, []
        used %= window
    return order


def cut_pieces(sizes: np.ndarray, window: int) -> np.ndarray:
    """Rows (document, start, length, sequence, offset) of documents laid end to end into windows."""
    total = int(sizes.sum())
    tail = total % window
    steps = [1 << bit for bit in range(tail.bit_length() - 1, -1, -1) if tail >> bit & 1]
    lengths = np.array([window] * (total // window) + steps, dtype=np.int64)
    ends = np.cumsum(lengths)
    doc_ends = np.cumsum(sizes)
    cuts = np.unique(np.concatenate([[0], ends, doc_ends]))
    starts, stops = cuts[:-1], cuts[1:]
    doc = np.searchsorted(doc_ends, starts, side="right")
    sequence = np.searchsorted(ends, starts, side="right")
    return np.stack(
        [doc, starts - (doc_ends - sizes)[doc], stops - starts, sequence, starts - (ends - lengths)[sequence]], axis=1
    )


def _pack_shards(window: int, corpus: Corpus):
    names = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def packed(shard: int, ids: list[int | None], docs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        order = packing_order(docs, window, corpus)
        rows = cut_pieces(np.array([len(docs[at]) for at in order]), window)
        for some in range(0, len(rows), 4_000):
            part = rows[some : some + 4_000]
            at = [order[place] for place in part[:, 0].tolist()]
            cut = [docs[doc][start : start + length].tobytes() for doc, (_, start, length, _, _) in zip(at, part.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[doc] for doc in at], pa.int64()),
                    pa.array(part[:, 1]),
                    pa.array(part[:, 2]),
                    pa.array(cut, pa.binary()),
                    pa.array([len(docs[doc]) for doc in at], pa.int64()),
                    pa.array(part[:, 3] + (shard << 32)),
                    pa.array(part[:, 4]),
                ],
                names,
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, docs = None, [], []
        for batch in batches:
            rows = zip(batch.column("shard").to_pylist(), batch.column("id").to_pylist(), batch.column("ids").to_pylist(), strict=True)
            for number, identity, packed_ids in rows:
                if number != shard:
                    if docs:
                        yield from packed(shard, ids, docs)
                    shard, ids, docs = number, [], []
                ids.append(identity)
                docs.append(_unpack(packed_ids))
        if docs:
            yield from packed(shard, ids, docs)

    return run


DOCUMENTS, TOKENS = -1, -2  # rows of the counts that stand for no term


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # Texts are tokenised by now; an encoder and its words would stay in the worker, whatever runs there next.
    forget(ENCODERS)
    spread, documents, tokens = np.zeros(1 << 16, np.int64), 0, 0
    for batch in batches:
        for docs in _blocks(batch.column("ids").to_pylist()):
            found = np.bincount(_terms(docs)[1], minlength=len(spread))
            found[: len(spread)] += spread
            spread, documents, tokens = found, documents + len(docs), tokens + sum(map(len, docs))
    used = np.flatnonzero(spread)
    terms = np.concatenate([used, [DOCUMENTS, TOKENS]])
    yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(np.concatenate([spread[used], [documents, tokens]]))], ["term", "n"])


def count(tokens: DataFrame) -> Corpus:
    """Counts of the whole corpus. One row per id of the vocabulary reaches the driver."""
    found = tokens.select("ids").mapInArrow(_count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    counts = dict(zip(found.column("term").to_pylist(), found.column("n").to_pylist(), strict=True))
    documents, total = counts.pop(DOCUMENTS, 0), counts.pop(TOKENS, 0)
    spread = np.zeros(max(counts, default=0) + 1, np.int64)
    spread[list(counts)] = list(counts.values())
    return Corpus(documents, total / max(documents, 1), spread)


def _topics(corpus: Corpus, least: int):
    """Of each document the heaviest term that ``least`` documents hold, and the heaviest that any other holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            topics, rarest = [], []
            for docs in _blocks(batch.column("ids").to_pylist()):
                owner, terms, frequency = _terms(docs)
                firsts = np.searchsorted(owner, np.arange(len(docs)))
                weight, spread = corpus.weights(terms, frequency, np.array([len(ids) for ids in docs])[owner]), corpus.spread[terms]
                for few, out in ((least, topics), (2, rarest)):
                    shared = np.where(spread >= few, weight, -1)
                    best = np.maximum.reduceat(shared, firsts)
                    heaviest = np.flatnonzero(shared == best[owner])  # of equal ones the first
                    heaviest = heaviest[np.searchsorted(heaviest, firsts)]
                    out.append(np.where(best >= 0, terms[heaviest], -1))
            told = [pa.array(np.concatenate(out) if out else [], pa.int64()) for out in (topics, rarest)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *told], [*batch.schema.names, "topic", "term"])

    return run


def _deal(sizes: list[tuple], limit: int, first: int) -> tuple[list[tuple], int]:
    """(*key, first shard, shards) of groups (*key, size): large ones get shards of their own, small ones share."""
    out, held = [], 0
    for *key, size in sorted(sizes):
        if size > limit:
            parts = -(-size // limit)
            out.append((*key, first, parts))
            first += parts
    open_shard = first
    for *key, size in sorted(sizes):
        if size <= limit:
            if held and held + size > limit:
                open_shard, held = open_shard + 1, 0
            out.append((*key, open_shard, 1))
            held += size
    return out, open_shard + 1 if held else open_shard


def deal(tokens: DataFrame, corpus: Corpus, shards: int) -> tuple[DataFrame, int]:
    """``tokens`` with the shard of each document, by content, and the number of shards."""
    spark = tokens.sparkSession
    size = F.octet_length("ids").cast("bigint")
    total = tokens.agg(F.sum(size)).first()[0] or 0
    limit = max(1, -(-total // shards))
    names = "id bigint, ids binary, topic bigint, term bigint"
    told = stage(tokens.mapInArrow(_topics(corpus, max(2, corpus.count // shards)), names), "topics")
    # One row per id of the vocabulary at most.
    topics = [tuple(row) for row in told.groupBy("topic").agg(F.sum(size).alias("n")).collect()]
    large = [topic for topic, n in topics if n > limit]
    # Large parts of large groups: they hold an eighth of a shard or more each, so they are few.
    crowded = told.where(F.col("topic").isin(large)) if large else told.limit(0)
    parts = crowded.groupBy("topic", "term").agg(F.sum(size).alias("n")).where(F.col("n") > limit // 8)
    parts = [tuple(row) for row in parts.collect()]
    inside: dict[int, int] = {}
    for topic, _, n in parts:
        inside[topic] = inside.get(topic, 0) + n
    by_topic, used = _deal([(topic, n - inside.get(topic, 0)) for topic, n in topics], limit, 0)
    by_part, used = _deal(parts, limit, used)
    found = told.join(spark.createDataFrame(by_topic, "topic bigint, first int, parts int"), "topic", "left")
    found = found.join(spark.createDataFrame(by_part, "topic bigint, term bigint, own int, own_parts int"), ["topic", "term"], "left")
    spread = F.xxhash64("id", F.crc32("ids"))
    shard = F.when(F.col("own").isNotNull(), F.col("own") + F.pmod(spread, "own_parts")).otherwise(
        F.col("first") + F.pmod(F.xxhash64("term"), "parts")
    )
    return found.select("id", "ids", shard.cast("int").alias("shard")), max(used, 1)


def pack(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    window: int = WINDOW,
    tokenizer: str | None = None,
    final_id: int = FINAL_ID,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Pieces of all documents: id, start, length, ids (unsigned little-endian 32-bit), doc_tokens, sequence_id, offset."""
    shards = max(1, total_bytes(docs, text_column) // shard_bytes)
    tokens = docs.select(id_column, text_column).mapInArrow(
        _tokenise(id_column, text_column, tokenizer or tokenizer_path(), final_id), "id bigint, ids binary"
    )
    with staged(tokens, "tokens") as tokens:
        corpus = count(tokens)
        placed, shards = deal(tokens, corpus, shards)  # writes the tokens anew, beside their topics
    dealt = placed.repartition(shards, "shard").sortWithinPartitions("shard", "id", "ids")
    schema = "id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    return dealt.mapInArrow(_pack_shards(window, corpus), schema).withColumnRenamed("id", id_column)
