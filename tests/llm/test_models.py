"""Classifier, packing and transcripts: held-out accuracy, exact round trips, brute force."""

import collections
import random

import numpy as np
import pytest
from helpers import awkward_texts, frame, prose, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from curveframe.llm import packing, quality, transcripts

FOLDER = "/root/testdata/sf0.01"


def test_classifier_on_reviewed_rows_it_has_not_seen(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    found = quality.score(docs).join(labels, "doc_id").collect()
    good = [row for row in found if row["quality"] == 1]
    junk = [row for row in found if row["quality"] == 0]
    assert sum(row["p_quality"] >= 0.5 for row in good) >= 0.99 * len(good)
    assert sum(row["p_quality"] < 0.5 for row in junk) >= 0.85 * len(junk)
    civil = [row for row in found if row["toxic"] == 0]
    assert sum(row["p_civil"] >= 0.5 for row in civil) >= 0.99 * len(civil)


def test_abuse_in_each_language_on_reviewed_rows_it_has_not_seen(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    half = "pmod(hash(doc_id), 2) = 0"
    found = quality.score(docs.join(labels, "doc_id", "semi"), labels.where(half)).join(labels.where(f"NOT {half}"), "doc_id").collect()
    shares = {}
    for lang in ("en", "fr", "de", "es"):
        toxic = [row["p_civil"] < 0.5 for row in found if row["toxic"] == 1 and row["lang"] == lang]
        shares[lang] = sum(toxic) / len(toxic)
    assert shares["en"] >= 0.9 and min(shares.values()) >= 0.5, shares
    civil = [row["p_civil"] >= 0.5 for row in found if row["toxic"] == 0]
    assert sum(civil) >= 0.99 * len(civil)


def test_classifier_edges(spark):
    docs = frame(spark, rows() + rows()[:4])
    found = quality.score(docs)
    assert found.columns == [*docs.columns, "p_quality", "p_civil"]
    scores = collections.defaultdict(set)
    for row in found.collect():
        assert 0 <= row["p_quality"] <= 1 and 0 <= row["p_civil"] <= 1
        scores[row["text"]].add((row["p_quality"], row["p_civil"]))
    assert all(len(values) == 1 for values in scores.values())
    assert quality.score(spark.createDataFrame([], docs.schema)).collect() == []


def test_labellers_are_told_apart():
    """Symptoms that show on part of the bad rows each; one labeller is mere noise."""
    random.seed(3)
    truth = [random.random() < 0.8 for _ in range(6000)]
    shows, alarms = [0.7, 0.6, 0.5, 0.1], [0.01, 0.02, 0.02, 0.1]
    votes = np.array([[-1 if random.random() < (a if good else r) else 1 for r, a in zip(shows, alarms, strict=True)] for good in truth])
    codes, inverse, counts = np.unique(quality.pattern(votes), return_inverse=True, return_counts=True)
    posterior = quality.estimate(codes, counts.astype(float), 4)[inverse]
    assert np.mean((posterior >= 0.5) == truth) >= 0.94


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.tokenizer_path())


@pytest.fixture(scope="module")
def encoder():
    return packing.WordEncoder(packing.tokenizer_path())


def ids_of(tokenizer, text):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids, dtype="<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=st.characters(codec="utf-8"), max_size=60))
def test_encoder_equals_tokenizer(tokenizer, encoder, text):
    assert encoder.encode(text) == ids_of(tokenizer, text)


@pytest.mark.parametrize("text", ["don't WE'LL 's 'tis", "a<|endoftext|>b", "é ́x ﬁ ２ ½ ǅ", "A\x1cB\x85C　D", "...,!? 12345 a1b2"])
def test_encoder_cases(tokenizer, encoder, text):
    assert encoder.encode(text) == ids_of(tokenizer, text)


def check_pieces(pieces, texts, tokenizer, window):
    """Every id of every row in exactly one piece, sequences gapless, padding only where it must be."""
    ids = {at: ids_of(tokenizer, text) + np.array([1], "<u4").tobytes() for at, text in texts.items()}
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for piece in pieces:
        by_doc[piece["doc_id"]].append(piece)
        by_sequence[piece["sequence_id"]].append(piece)
    assert set(by_doc) == set(ids)
    for doc, own in by_doc.items():
        own.sort(key=lambda piece: piece["start"])
        assert b"".join(bytes(piece["ids"]) for piece in own) == ids[doc]
        assert all(piece["doc_tokens"] * 4 == len(ids[doc]) for piece in own)
    for own in by_sequence.values():
        own.sort(key=lambda piece: piece["offset"])
        assert [piece["offset"] for piece in own] == [sum(p["length"] for p in own[:at]) for at in range(len(own))]
        total = sum(piece["length"] for piece in own)
        assert total == window or (total < window and total & (total - 1) == 0)


@pytest.mark.parametrize("window, shard_bytes", [(2048, 1 << 22), (64, 4000)])
def test_packing_round_trip(spark, tokenizer, window, shard_bytes):
    texts = dict(enumerate([*awkward_texts(), *[prose(10 + n, n) for n in range(60)]]))
    docs = frame(spark, rows(list(texts.values())))
    check_pieces(packing.pack(docs, window=window, shard_bytes=shard_bytes).collect(), texts, tokenizer, window)


def test_packing_puts_like_beside_like():
    docs = [np.array([topic * 100 + at % 37 for at in range(20)], np.uint32) for _ in range(6) for topic in range(5)]
    order = packing.packing_order(docs, 120)
    topics = [docs[at][0] // 100 for at in order]
    assert sorted(order) == list(range(30))
    assert sum(a == b for a, b in zip(topics, topics[1:], strict=False)) >= 20


def test_packing_finds_neighbours_across_shards(spark):
    """Twelve topics in forty shards' worth of documents: nearly all documents follow one of their topic."""
    words = lambda topic, n: " ".join(f"{'bcdfghklmnpr'[topic]}{'aeiou'[(n * k + k) % 5]}{'zvtsx'[(n + k * k) % 5]}o" for k in range(40))
    texts = [words(n % 12, n // 12) for n in range(480)]
    found = packing.pack(frame(spark, rows(texts)), window=512, shard_bytes=2_000).collect()
    found.sort(key=lambda piece: (piece["sequence_id"], piece["offset"]))
    beside = [(a["doc_id"] % 12, b["doc_id"] % 12) for a, b in zip(found, found[1:], strict=False) if a["sequence_id"] == b["sequence_id"]]
    assert len({piece["sequence_id"] >> 32 for piece in found}) >= 20
    assert sum(a == b for a, b in beside) >= 0.7 * len(beside)


def test_packing_scores_with_all_terms_of_the_seed():
    # The seed's rare terms are its own; what it shares with its neighbour comes after them.
    seed, like, other = np.r_[1000:1030, 0:10], np.r_[2000:2030, 0:10], np.r_[3000:3040]
    docs = [part.astype(np.uint32) for part in (seed, other, like)] + [np.r_[n : n + 3, 5000 + 40 * n : 5037 + 40 * n].astype(np.uint32) for n in range(8)]
    index = packing.Bm25Index(docs, packing.Corpus.of(docs))
    assert index.neighbours(0, np.arange(len(docs)) > 0)[0] == 2


def test_packing_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_transcripts_recover_roles(spark):
    rows_ = spark.read.parquet(f"{FOLDER}/conversations.parquet")
    found = transcripts.turns(rows_).where("part = 0").select("conv_id", "turn", "role")
    joined = found.join(rows_.withColumnRenamed("role", "truth"), ["conv_id", "turn"]).collect()
    assert sum(row["role"] == row["truth"] for row in joined) >= 0.9 * len(joined)


CHAT = "conv_id bigint, turn bigint, role string, text string"


def test_transcripts_markers_and_edges(spark):
    known = spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = [
        (90001, 0, None, "System: be brief\nUser: what is it?\nplease\nAssistant: It is this.\n\n\n\nSo there."),
        (90002, 0, None, None),
        (90003, None, None, ""),
        (None, 0, None, "**Human:** hello\n### Assistant: hi"),
        (90001, 0, None, "System: be brief\nUser: what is it?\nplease\nAssistant: It is this.\n\n\n\nSo there."),
    ]
    found = transcripts.turns(known.unionAll(spark.createDataFrame(odd, CHAT))).where("conv_id IS NULL OR conv_id > 90000").collect()
    of = lambda conv: [(row["role"], row["rendered"]) for row in sorted(found, key=lambda r: r["part"]) if row["conv_id"] == conv]
    assert of(90001) == [
        ("system", "<|system|>\nbe brief\n<|end|>"),
        ("user", "<|user|>\nwhat is it?\nplease\n<|end|>"),
        ("assistant", "<|assistant|>\nIt is this.\n\nSo there.\n<|end|>"),
    ]
    assert [role for role, _ in of(None)] == ["user", "assistant"]
    assert len(of(90002)) == 1 and len(of(90003)) == 1


def test_transcripts_chunks_agree_with_one_pass(spark, monkeypatch):
    known = spark.read.parquet(f"{FOLDER}/conversations.parquet").where("role <> 'system'")
    turns = [(row["turn"], row["text"]) for row in known.orderBy("conv_id", "turn").limit(400).collect()]
    long = spark.createDataFrame([(1, at, None, text) for at, (_, text) in enumerate(turns)], CHAT)
    model = transcripts.train(known)
    whole = {}
    for chunk, group in ((1 << 20, 256), (8, 3)):
        monkeypatch.setattr(transcripts, "CHUNK", chunk)
        monkeypatch.setattr(transcripts, "GROUP", group)
        labelled = transcripts.label_lines(long, model).orderBy("turn", "line_no").collect()
        whole[chunk] = [(row["turn"], row["line_no"], row["role"], row["starts"]) for row in labelled]
    assert whole[8] == whole[1 << 20] and len(whole[8]) >= 400


@pytest.fixture
def many_tasks(spark):
    """Small inputs keep all tasks of a shuffle."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, "true")


def test_transcripts_chunks_are_bounded_whatever_the_turns(spark, monkeypatch, many_tasks):
    """Turns that are null or repeated, no conversation id, and a row of many lines."""
    rows_ = [(None, None if n % 2 else 0, ("user", "assistant")[n % 2], f"text {n:04d}") for n in range(600)]
    rows_ += [(7, 0, "user", "\n".join(f"line {n}" for n in range(300)))]
    docs = spark.createDataFrame(rows_, CHAT).repartition(5)
    model, staged, stage = transcripts.train(docs), {}, transcripts.stage

    def kept(df, name):
        staged[name] = stage(df, name)
        return staged[name]

    monkeypatch.setattr(transcripts, "CHUNK", 16)
    monkeypatch.setattr(transcripts, "stage", kept)
    assert transcripts.label_lines(docs, model).count() == 900
    sizes = [row["count"] for row in staged["lines"].groupBy("conv", "part").count().collect()]
    assert sum(sizes) == 900 and max(sizes) == 16
    numbers = sorted((row["conv"] or "", row["number"]) for row in staged["lines"].collect())
    assert numbers == [("", n) for n in range(600)] + [("7", n) for n in range(300)]
    assert staged["ordered"].select("task").distinct().count() > 2


def test_transcripts_transitions_are_one_a_row(spark, many_tasks):
    rows_ = [(1, 0, ("user", "assistant")[n % 2], f"text {n:04d}") for n in range(600)]
    found = transcripts.transitions(spark.createDataFrame(rows_, "conv bigint, turn bigint, role string, body string").repartition(5))
    assert {(row["before"], row["role"]): row["n"] for row in found.collect()} == {
        (None, "user"): 1, ("user", "assistant"): 300, ("assistant", "user"): 299
    }


def test_transcripts_empty(spark):
    assert transcripts.turns(spark.createDataFrame([], CHAT)).collect() == []
