"""Periodic runs, whitening and byte-pair encoding against brute force and the public library."""

import math
import random
import zlib

import numpy as np
import pytest
from helpers import awkward_texts, frame, prose, rows, sha, space_words
from pyspark.sql import functions as F

from curveframe.llm import bpe_automaton, periodic_runs, queries, whitening


def brute_runs(words):
    """Maximal stretches of equal pairs at each lag, each under its smallest lag."""
    found = {}
    for lag in range(1, len(words) // 4 + 1):
        at = 0
        while at < len(words) - lag:
            end = at
            while end < len(words) - lag and words[end] == words[end + lag]:
                end += 1
            if end - at + lag >= max(6, 4 * lag):
                found.setdefault((at, end - at + lag), lag)
            at = end + 1
    return sorted((start, length, lag) for (start, length), lag in found.items())


def brute_collapse(words):
    gone = {at for start, length, period in brute_runs(words) for at in range(start + period, start + length)}
    return " ".join(word for at, word in enumerate(words) if at not in gone)


def mixed(seed, alphabet):
    source = random.Random(seed)
    out = []
    for _ in range(source.randrange(6)):
        unit = [f"v{source.randrange(alphabet)}" for _ in range(source.randrange(1, 60))]
        out += (unit * source.choice([1, 1, 4, 5, 9]))[: source.randrange(1, 300)]
    return out


RUN_TEXTS = [
    "a a a a a",
    "a a a a a a",
    "a b a b a b a b",
    "x a b a b a b a y",
    "a b\ta b\na b a  b a b a b z z z z z z z",
    "a a a a a a b a a a a a a b " * 4,
    " ".join(f"u{at % 700}" for at in range(4000)),
    " ".join(f"u{at % 70}" for at in range(279)) + " end " + " ".join(f"u{at % 70}" for at in range(280)),
]


def test_runs(spark):
    texts = [*awkward_texts(), *RUN_TEXTS, RUN_TEXTS[2], *[" ".join(mixed(seed, 1 + seed % 6)) for seed in range(60)]]
    docs = frame(spark, rows(texts)).withColumn("runs", F.lit(1)).withColumn("Collapsed", F.lit("x"))
    found = periodic_runs.collapse_runs(docs)
    assert found.columns == ["doc_id", "lang", "n_words", "kept", "label", "runs", "collapsed"]
    for row in found.collect():
        words = space_words(texts[row["doc_id"]])
        assert [tuple(run) for run in row["runs"]] == brute_runs(words), row["doc_id"]
        assert row["collapsed"] == brute_collapse(words)
    assert periodic_runs.collapse_runs(docs.where("doc_id < 0")).count() == 0


@pytest.mark.parametrize("scanned", [1, 4, 4096])
def test_runs_by_scan_and_by_recurrence(scanned):
    for seed in range(200):
        texts = [mixed(seed * 3 + part, 1 + seed % 5) for part in range(3)]
        numbers = np.array([int(word[1:]) for text in texts for word in text], np.int64)
        owner = np.repeat(np.arange(3), [len(text) for text in texts])
        offset = np.cumsum([0, *[len(text) for text in texts]])
        wanted = [(start + offset[at], length, period) for at, text in enumerate(texts) for start, length, period in brute_runs(text)]
        assert list(zip(*map(np.ndarray.tolist, periodic_runs.find_runs(numbers, owner, scanned)), strict=True)) == sorted(
            wanted, key=lambda run: (run[0], run[2])
        )


def test_runs_of_a_very_long_text(spark):
    words = [f"w{at % 977}" for at in range(50_000)] + prose(300_000, 3, 89).split() + ["same"] * 200_000
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id bigint, text string")
    row = periodic_runs.collapse_runs(docs).first()
    assert [tuple(run) for run in row["runs"]] == [(0, 50_000, 977), (350_000, 200_000, 1)]
    assert row["collapsed"] == " ".join([*words[:977], *words[50_000:350_000], "same"])


def test_planted_runs(spark):
    texts = [*awkward_texts(), *[prose(20 + at, at) for at in range(60)]]
    data = [*rows(texts), (None, "a b c", None, 1, None, "x")]
    planted = queries.with_planted_runs(frame(spark, data).select("doc_id", "text")).collect()
    changed = 0
    for row in planted:
        words = space_words("a b c" if row["doc_id"] is None else texts[row["doc_id"]])
        h, n = zlib.crc32(str(row["doc_id"]).encode()), len(words)
        if row["doc_id"] is not None and h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
            changed += 1
        assert space_words(row["text"]) == words
    assert changed > 3


EMBEDDINGS = "vec_id bigint, embedding array<float>, n string, whitened int"


def brute_whitening(vectors, components=32):
    """Exact grid sums, and the library's own eigenvalue solver."""
    grid = [[math.floor(64 * float(c)) + 1_000_000 for c in vector] for vector in vectors]
    n, sums = len(grid), [sum(column) for column in zip(*grid, strict=True)]
    centred = np.array([[n * x - s for x, s in zip(row, sums, strict=True)] for row in grid], dtype=object)
    covariance = (centred.T @ centred).astype(float) / n**3
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    deviations = [sum(int(c) ** 2 for c in row) for row in centred]
    return deviations, (centred.astype(float) / n) @ axes / np.sqrt(values), values / np.trace(covariance)


def vectors_of(count, size, seed=0):
    source = np.random.default_rng(seed)
    mixing = source.normal(size=(size, size)) * np.linspace(3, 0.2, size)
    return (source.normal(size=(count, size)) @ mixing + source.normal(size=size) * 40).astype(np.float32).tolist()


def same_but_for_sign(found, wanted, tolerance):
    for component in range(wanted.shape[1]):
        a, b = found[:, component], wanted[:, component]
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < tolerance


@pytest.mark.parametrize(("count", "size"), [(300, 5), (500, 40), (9000, 33)])
def test_whitening(spark, count, size):
    vectors = vectors_of(count, size)
    vectors[7] = vectors[8]
    data = [(at, vector, "x", 1) for at, vector in enumerate(vectors)]
    spoilt = [None, [], [None] * size, [math.nan] * size, [1.0] * (size - 1) + [math.inf], [3e38] * size, [1.0] * (size + 1)]
    data += [(1000_000 + at, vector, None, None) for at, vector in enumerate(spoilt)]
    rows_ = spark.createDataFrame(data, EMBEDDINGS).repartition(5)
    found, model, error = whitening.whiten(rows_)
    got = sorted(found.collect(), key=lambda row: row["vec_id"])
    assert found.columns == ["vec_id", "n", "deviation", "whitened"]
    assert [row["vec_id"] for row in got] == list(range(count)) and {row["n"] for row in got} == {count}
    deviations, whitened, explained = brute_whitening(vectors)
    assert [row["deviation"] for row in got] == deviations
    assert model.explained == pytest.approx(explained.tolist(), rel=1e-9)
    same_but_for_sign(np.array([row["whitened"] for row in got]), whitened, 1e-6)
    assert error < 1e-9


def test_whitening_without_variance(spark):
    empty = spark.createDataFrame([], EMBEDDINGS)
    one = spark.createDataFrame([(1, [1.0, 2.0], "x", 1), (None, None, None, None)], EMBEDDINGS)
    for rows_ in (empty, one):
        found, model, _ = whitening.whiten(rows_)
        assert model is None and found.count() == 0 and found.columns == ["vec_id", "n", "deviation", "whitened"]
    # Three vectors on a line in four dimensions have one component.
    line = spark.createDataFrame([(at, [float(at), 2.0 * at, 5.0, -float(at)], "x", 1) for at in range(3)], EMBEDDINGS)
    found, model, error = whitening.whiten(line)
    assert model.explained == pytest.approx([1.0]) and error < 1e-12
    assert [abs(row["whitened"][0]) for row in found.orderBy("vec_id").collect()] == pytest.approx([1.5**0.5, 0, 1.5**0.5])


def test_exact_products():
    source = np.random.default_rng(1)
    for most in (10, 1 << 30, (1 << 52) - 1):
        grid = source.integers(-most, most, size=(200, 3))
        wanted = grid.astype(object).T @ grid.astype(object)
        assert (whitening.exact_products(grid) == wanted).all()


def test_factorisation():
    source = np.random.default_rng(2)
    for size, rank in [(1, 1), (6, 6), (20, 7), (65, 65)]:
        root = source.normal(size=(size, rank)) * np.logspace(0, 3, rank)
        matrix = root @ root.T
        factor, order = whitening.pivoted_cholesky(matrix)
        assert factor.shape == (size, rank) and np.allclose(factor, np.tril(factor))
        assert np.allclose(factor @ factor.T, matrix[np.ix_(order, order)], rtol=1e-9, atol=1e-9 * np.abs(matrix).max())
        values, axes = whitening.eigen(matrix)
        assert np.allclose(values, np.linalg.eigvalsh(matrix)[::-1][:rank], rtol=1e-8)
        assert np.allclose(axes.T @ axes, np.eye(rank), atol=1e-9)


def test_whitening_query(spark):
    found = queries.op12_embedding_whitening(spark, "/root/testdata/sf0.001")
    assert [f"{name} {kind}" for name, kind in found.dtypes] == [
        "vec_id bigint",
        "component int",
        "n bigint",
        "deviation bigint",
        "whitened double",
        "explained double",
        "identity_error double",
    ]
    got = found.orderBy("vec_id", "component").collect()
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").orderBy("vec_id").collect()
    deviations, whitened, explained = brute_whitening([row["embedding"] for row in vectors])
    assert [(row["vec_id"], row["component"]) for row in got] == [(row["vec_id"], at) for row in vectors for at in range(1, 33)]
    assert [row["deviation"] for row in got[::32]] == deviations
    assert [row["explained"] for row in got[:32]] == pytest.approx(explained.tolist(), rel=1e-9)
    same_but_for_sign(np.array([row["whitened"] for row in got]).reshape(-1, 32), whitened, 1e-6)
    assert {row["identity_error"] for row in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe_automaton.vocabulary_path())


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)


BPE_TEXTS = [
    "<|endoftext|>",
    "a<|endoftext|> b<|endoftext|><|endoftext|>",
    "it's we'll  \n\n x\t\ty   ",
    "1234567890 ½ ٣٤ 東京タワー กรุงเทพ Ωmega ԱԲ \U00010940",
    "ÃÂ" * 100 + "-" * 300 + " " * 200,
    "x" * 5000 + "ab" * 3000,
    "\x1c\x00\x85\xa0 ﻿😀👍🏽",
]


def test_bpe(spark, library):
    texts = [*awkward_texts(), *BPE_TEXTS, BPE_TEXTS[2]]
    docs = frame(spark, rows(texts)).withColumn("N_TOKENS", F.lit("x")).withColumn("decoded", F.lit(1)).withColumn("ids", F.lit(2))
    found = bpe_automaton.decode(bpe_automaton.encode(docs))
    assert found.columns == ["doc_id", "lang", "n_words", "kept", "label", "ids", "n_tokens", "decoded"]
    for row in found.collect():
        ids, decoded = expected(library, texts[row["doc_id"]])
        assert (bytes(row["ids"]), row["n_tokens"], row["decoded"]) == (ids, len(ids) // 4, decoded), row["doc_id"]
    assert bpe_automaton.decode(bpe_automaton.encode(docs.where("doc_id < 0"))).count() == 0


def test_bpe_of_random_texts(library):
    words = bpe_automaton.vocabulary(bpe_automaton.vocabulary_path())
    source = random.Random(5)
    texts = []
    for _ in range(400):
        letters = source.choice(["aeost'in \n", "0123 ,.;", "àéßñ Łó", "".join(chr(source.randrange(0xE000, 0x110000)) for _ in range(9))])
        texts.append("".join(source.choice(letters) for _ in range(source.randrange(200))))
        texts.append("".join(chr(source.choice([source.randrange(0xD800), source.randrange(0x250)])) for _ in range(60)))
    assert words.encode(texts) == [expected(library, text)[0] for text in texts]


def test_bpe_of_long_texts(library, monkeypatch):
    monkeypatch.setattr(bpe_automaton, "LONG_TEXT", 500)
    monkeypatch.setattr(bpe_automaton, "WINDOW_WORDS", 7)
    monkeypatch.setattr(bpe_automaton, "CACHED", 20)
    words = bpe_automaton.Vocabulary(bpe_automaton.vocabulary_path())
    texts = [prose(2000, 4), "  \n" * 500 + "it's" * 100 + "<|endoftext|>" + prose(300, 5), "q" * 300]
    assert words.encode(texts) == [expected(library, text)[0] for text in texts]


def brute_merge(body, ranks):
    parts = [bytes([byte]) for byte in body]
    while True:
        pairs = [(ranks[pair], at) for at, pair in enumerate(zip(parts, parts[1:], strict=False)) if pair in ranks]
        if not pairs:
            return parts
        best = min(pairs)[0]
        out, at = [], 0
        while at < len(parts):
            if at + 1 < len(parts) and ranks.get((parts[at], parts[at + 1])) == best:
                out.append(parts[at] + parts[at + 1])
                at += 2
            else:
                out.append(parts[at])
                at += 1
        parts = out


def test_automaton_of_small_vocabularies():
    """Merges of few letters, equal halves and dead pairs among them, against merging by rank."""
    source = random.Random(9)
    for _ in range(60):
        labels, merges = [b"a", b"b", b"c"], []
        for _ in range(source.randrange(1, 14)):
            first, second = source.randrange(len(labels)), source.randrange(len(labels))
            if labels[first] + labels[second] not in labels:
                merges.append((first, second, len(labels)))
                labels.append(labels[first] + labels[second])
        ranks = {(labels[a], labels[b]): at for at, (a, b, _) in enumerate(merges)}
        automaton = bpe_automaton.Automaton(labels, merges)
        texts = ["".join(source.choice("abc") for _ in range(source.randrange(1, 30))).encode() for _ in range(40)]
        short = [np.frombuffer(ids, "<u4").tolist() for ids in automaton.read_all(texts)]
        for text, ids in zip(texts, short, strict=True):
            assert [labels[token] for token in ids] == brute_merge(text, ranks)
            assert automaton.read(text).tolist() == ids


def test_bpe_query(spark, library):
    found = queries.op13_bpe_automaton(spark, "/root/testdata/sf0.001").collect()
    texts = {row["doc_id"]: row["text"] for row in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(found) == len(texts)
    for row in found:
        ids, decoded = expected(library, texts[row["doc_id"]])
        assert (row["n_tokens"], row["ids_sha256"], row["decoded_sha256"]) == (len(ids) // 4, sha(ids), sha(decoded))
