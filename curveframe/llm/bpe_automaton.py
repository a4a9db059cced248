"""Byte-pair encoding by a deterministic tokenization automaton, and its inverse.

Compilation. The automaton reads tokens. It starts as one state with a loop for each
byte, which accepts every spelling of every text. Each merge (u, v), in order of
priority, adds a gadget: the state that u enters is copied without its arc v, u is
redirected to the copy, and every state with an arc u gets an arc uv to where v led.
What is left after the last merge accepts exactly one token sequence for each text,
the one that byte-pair encoding makes. All arcs of one label enter one state, so the
automaton is held as the state each label enters and, for each state, the arcs its
copies have lost and when; an arc uv follows its left part u until the merge that made it.

Encoding. Texts are cut into words by the vocabulary's own pattern. The words that a task
has not met before run through the tables together, byte by byte: the longest tokens that
end at a byte (a suffix table over all tokens) are tried until the state that the token
before it entered has that arc. Every prefix of a word has exactly one such last token, so
reading back from the end of the word gives its path. Decoding emits the labels' bytes.

Defined results: null text counts as empty and has no ids; special tokens of the vocabulary
that occur in a text become their id, as the public library does, and decode to their name;
unknown ids are an error, null ids decode to an empty text; repeated rows are treated each;
an empty table gives an empty result. Texts of any length are encoded in bounded windows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cached_property
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from curveframe.llm.common import with_results, worker_memory

CACHED = 250_000  # words a task keeps the ids of
LONG_TEXT = 1 << 20  # a longer text is cut into words in windows of WINDOW_WORDS
WINDOW_WORDS = 100_000
LONG_WORD = 96  # bytes; longer words are read one by one
NEVER = np.int32(np.iinfo(np.int32).max)
DEAD = -1

# Fixed value: the word pattern of byte-level vocabularies.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Scripts in which all versions of Unicode agree on letters, numbers and white space; words of
# texts with other signs are cut by the vocabulary's own splitter.
SETTLED = r"[\x00-՗ -₎₠-₿℀-⯿　-ㄮ一-龥가-힣＀-￮]*"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_of_letter() -> dict[str, int]:
    """The byte for which each printable letter of a byte-level vocabulary stands."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return {chr(byte) if byte in plain else chr(next(spare)): byte for byte in range(256)}


class Automaton:
    """Tables of the tokenization automaton of a list of merges.

    ``labels`` has the bytes of each token, ``enter`` the state that its arcs enter;
    ``left`` is the left part of a merged token, ``made`` the number of its merge.
    ``lost_arc`` has state * size + token in ascending order, ``lost_at`` the merge at
    which that state lost the arc.
    """

    def __init__(self, labels: list[bytes], merges: list[tuple[int, int, int]]) -> None:
        self.labels = labels
        self.size = len(labels)
        self._build(merges)
        self._tabulate()
        self._index_suffixes()
        self.seen: dict[int, bool] = {}

    def _build(self, merges: list[tuple[int, int, int]]) -> None:
        size = self.size
        self.enter = np.zeros(size, np.int64)
        self.left = np.full(size, -1, np.int64)
        self.right = np.full(size, -1, np.int64)
        self.made = np.full(size, NEVER, np.int32)
        self.states = 1
        left, right, made, enter = [-1] * size, [-1] * size, [int(NEVER)] * size, [0] * size
        # Arcs that the copies made for a label have lost, by label. A state's losses are those of its
        # label, and before its label was made, those of the label's right part.
        lost: list[dict[int, int]] = [{} for _ in range(size)]

        def has_arc(label: int, token: int) -> bool:
            until = int(NEVER)
            while token >= 0:
                state, before = label, int(NEVER)
                while state >= 0:
                    when = lost[state].get(token)
                    if when is not None and when < before and when <= until:
                        return False
                    state, before = right[state], made[state]
                until, token = made[token], left[token]
            return True

        for number, (first, second, both) in enumerate(merges):
            if left[both] >= 0 or len(self.labels[both]) == 1:
                raise ValueError("A token must come from one merge.")
            left[both], right[both] = first, second
            if made[first] == DEAD or made[second] == DEAD or not has_arc(first, second):
                made[both] = DEAD  # the pair never meets, so no arc carries the new label
                continue
            made[both] = number
            enter[both] = enter[second]
            lost[first][second] = number
            enter[first] = self.states
            self.states += 1
        self.left[:], self.right[:], self.made[:], self.enter[:] = left, right, made, enter
        self._lost = lost

    def _tabulate(self) -> None:
        """Losses of each state that some label enters."""
        own = [(np.fromiter(part, np.int64, len(part)), np.fromiter(part.values(), np.int32, len(part))) for part in self._lost]
        _, entered = np.unique(self.enter, return_index=True)
        keys, times = [], []
        for label in entered.tolist():
            state, before = label, NEVER
            while state >= 0:
                tokens, when = own[state]
                count = int(np.searchsorted(when, before))  # a label loses arcs in the order of the merges
                if count:
                    keys.append(tokens[:count] + self.enter[label] * self.size)
                    times.append(when[:count])
                state, before = int(self.right[state]), self.made[state]
        key = np.concatenate([*keys, np.zeros(0, np.int64)])
        time = np.concatenate([*times, np.zeros(0, np.int32)])
        order = np.lexsort((time, key))
        key, time = key[order], time[order]
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        self.lost_arc = np.append(key[first], np.iinfo(np.int64).max)
        self.lost_at = np.append(time[first], NEVER)
        del self._lost

    def _index_suffixes(self) -> None:
        """For each byte string read so far, as a node: the next node by byte, and the longest token that ends it."""
        children: list[dict[int, int]] = [{}]
        token_of = [-1]
        usable = [b"" if self.made[token] == DEAD else label for token, label in enumerate(self.labels)]
        for token, label in enumerate(usable):
            node = 0
            for byte in label:
                if byte not in children[node]:
                    children[node][byte] = len(children)
                    children.append({})
                    token_of.append(-1)
                node = children[node][byte]
            if label:
                token_of[node] = token
        follow = np.zeros((len(children), 256), np.int32)
        longest = np.array(token_of, np.int64)
        self.shorter = np.full(self.size, -1, np.int64)
        fail = [0] * len(children)
        queue = [0]
        for node in queue:
            if node:
                follow[node] = follow[fail[node]]
            suffix = int(longest[fail[node]]) if node else -1
            if token_of[node] >= 0:
                self.shorter[token_of[node]] = suffix
            else:
                longest[node] = suffix
            for byte, child in children[node].items():
                fail[child] = int(follow[fail[node], byte]) if node else 0
                follow[node, byte] = child
                queue.append(child)
        self.follow = follow.reshape(-1)
        self.longest = longest
        self.width = np.array([len(label) for label in self.labels], np.int64)

    def arcs(self, states: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Whether each state has an arc for the token beside it."""
        found = np.ones(len(states), bool)
        rows, token, base = np.arange(len(states)), tokens, states * self.size
        until = np.full(len(states), NEVER, np.int32)
        while len(rows):
            key = base[rows] + token
            place = np.searchsorted(self.lost_arc, key)
            missing = (self.lost_arc[place] == key) & (self.lost_at[place] <= until)
            found[rows[missing]] = False
            on = ~missing & (self.left[token] >= 0)
            until, rows, token = self.made[token[on]], rows[on], self.left[token[on]]
        return found

    def arc(self, state: int, token: int) -> bool:
        key = state * self.size + token
        known = self.seen.get(key)
        if known is None:
            known = bool(self.arcs(np.array([state]), np.array([token]))[0])
            if len(self.seen) > CACHED:
                self.seen.clear()
            self.seen[key] = known
        return known

    def read(self, word: bytes) -> np.ndarray:
        """Ids of one word of any length."""
        last, node = np.zeros(len(word), np.int64), 0
        follow, longest, width, shorter, enter = self.follow, self.longest, self.width, self.shorter, self.enter
        for place, byte in enumerate(word):
            node = follow[node * 256 + byte]
            token = longest[node]
            while True:
                before = place - width[token]
                if before < 0 or self.arc(int(enter[last[before]]), int(token)):
                    break
                token = shorter[token]
            last[place] = token
        ids, place = [], len(word) - 1
        while place >= 0:
            ids.append(last[place])
            place -= width[last[place]]
        return np.array(ids[::-1], "<u4")

    def read_all(self, words: list[bytes]) -> list[bytes]:
        """Ids of short words, as unsigned little-endian 32-bit numbers, all words in step."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-lengths, kind="stable")
        starts = np.concatenate([[0], np.cumsum(lengths)])[:-1][order]
        lengths = lengths[order]
        raw = np.frombuffer(b"".join(words), np.uint8)
        last = np.zeros(len(raw), np.int64)
        node = np.zeros(len(words), np.int64)
        for place in range(int(lengths[0]) if len(words) else 0):
            active = int(np.searchsorted(-lengths, -place, side="left"))
            node = self.follow[node[:active] * 256 + raw[starts[:active] + place]].astype(np.int64)
            token = self.longest[node]
            rows = np.arange(active)
            while len(rows):
                before = place - self.width[token]
                inner = before >= 0
                good = ~inner
                spot = starts[rows[inner]] + before[inner]
                good[inner] = self.arcs(self.enter[last[spot]], token[inner])
                last[starts[rows[good]] + place] = token[good]
                rows, token = rows[~good], self.shorter[token[~good]]
        steps, rows, place = [], np.arange(len(words)), lengths - 1
        counts = np.zeros(len(words), np.int64)
        while len(rows):
            token = last[starts[rows] + place]
            steps.append((rows, token))
            counts[rows] += 1
            place = place - self.width[token]
            rows, place = rows[place >= 0], place[place >= 0]
        ends = np.cumsum(counts)
        flat = np.zeros(int(ends[-1]) if len(ends) else 0, "<u4")
        for step, (rows, token) in enumerate(steps):
            flat[ends[rows] - 1 - step] = token
        body, out = flat.tobytes(), [b""] * len(words)
        for row, end, count in zip(order.tolist(), (4 * ends).tolist(), (4 * counts).tolist(), strict=True):
            out[row] = body[end - count : end]
        return out


class Vocabulary:
    """A byte-level vocabulary file: its automaton, word pattern and special tokens."""

    def __init__(self, path: str) -> None:
        self.path = path
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        letters = byte_of_letter()
        ids = content["model"]["vocab"]
        self.special = {entry["content"]: entry["id"] for entry in content["added_tokens"]}
        self.labels = [b""] * (1 + max([*ids.values(), *self.special.values()]))
        for name, token in ids.items():
            self.labels[token] = bytes(letters[letter] for letter in name)
        merges = (tuple(merge.split(" ")) if isinstance(merge, str) else tuple(merge) for merge in content["model"]["merges"])
        self.merges = np.array([(ids[a], ids[b], ids[a + b]) for a, b in merges], np.int32).reshape(-1, 3)
        self.words = regex.compile(WORDS)
        self.settled = regex.compile(SETTLED)
        self.parting = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.known: dict[str, bytes] = {}
        for name, token in self.special.items():
            self.labels[token] = name.encode()

    @cached_property
    def automaton(self) -> Automaton:
        """Compiled where something is encoded; decoding needs the labels only."""
        special = set(self.special.values())
        labels = [b"" if token in special else label for token, label in enumerate(self.labels)]
        return Automaton(labels, self.merges.tolist())

    @cached_property
    def splitter(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path).pre_tokenizer

    def windows(self, text: str) -> Iterator[list[str]]:
        if not self.settled.fullmatch(text):
            yield [text[start:end] for _, (start, end) in self.splitter.pre_tokenize_str(text)]
        elif len(text) <= LONG_TEXT:
            yield self.words.findall(text)
        else:
            found = (match[0] for match in self.words.finditer(text))
            while window := list(islice(found, WINDOW_WORDS)):
                yield window

    def _learn(self, words: set[str]) -> None:
        if len(self.known) + len(words) > CACHED:
            self.known.clear()
        short = [(word, body) for word in words if len(body := word.encode()) <= LONG_WORD]
        ids = self.automaton.read_all([body for _, body in short])
        self.known.update(zip((word for word, _ in short), ids, strict=True))
        for word in words.difference(self.known):
            self.known[word] = self.automaton.read(word.encode()).tobytes()

    def _encode_windows(self, windows: list[list[str]]) -> list[bytes]:
        fresh = set().union(*windows).difference(self.known)
        if fresh:
            if len(self.known) + len(fresh) > CACHED:
                fresh = set().union(*windows)
            self._learn(fresh)
        ids = self.known.__getitem__
        return [b"".join(map(ids, window)) for window in windows]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as unsigned little-endian 32-bit numbers."""
        owners, windows, size = [], [], 0
        out: list[list[bytes]] = [[] for _ in texts]

        def flush() -> None:
            nonlocal owners, windows, size
            for owner, ids in zip(owners, self._encode_windows(windows), strict=True):
                out[owner].append(ids)
            owners, windows, size = [], [], 0

        for at, text in enumerate(texts):
            parts = self.parting.split(text) if self.parting and any(name in text for name in self.special) else [text]
            for part in parts:
                if part in self.special:
                    flush()
                    out[at].append(np.array([self.special[part]], "<u4").tobytes())
                    continue
                for window in self.windows(part):
                    owners.append(at)
                    windows.append(window)
                    size += len(window)
                    if size > 4 * WINDOW_WORDS:
                        flush()
        flush()
        return [b"".join(ids) for ids in out]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.labels.__getitem__, ids.tolist())).decode("utf-8", "replace")


def vocabulary(path: str) -> Vocabulary:
    """The compiled vocabulary; a Python process compiles it once."""
    memory = worker_memory("curveframe_vocabularies")
    if path not in memory:
        memory[path] = Vocabulary(path)
    return memory[path]


def encode(docs: DataFrame, text_column: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` with ``ids`` (binary, unsigned little-endian 32-bit) and ``n_tokens`` in place of the text."""
    path = path or vocabulary_path()

    def make(texts: pa.Array) -> list[pa.Array]:
        ids = vocabulary(path).encode([text or "" for text in texts.to_pylist()])
        return [pa.array(ids, pa.binary()), pa.array([len(value) // 4 for value in ids], pa.int64())]

    return with_results(docs, text_column, "ids binary, n_tokens bigint", make, keep=False)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` with ``decoded``, the text that the labels of its ``ids`` spell; special tokens are spelled too."""
    path = path or vocabulary_path()

    def make(ids: pa.Array) -> list[pa.Array]:
        read = vocabulary(path).decode
        return [pa.array([read(np.frombuffer(value or b"", "<u4")) for value in ids.to_pylist()], pa.string())]

    return with_results(encoded, "ids", "decoded string", make)
