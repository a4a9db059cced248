"""What operators leave behind: memory of Python workers and staged files."""

import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from helpers import frame, prose, rows
from tokenizers import Tokenizer

from curveframe.llm import packing, quality
from curveframe.llm.common import staged, worker_memory
from curveframe.session import checkpoint_directory


def _left(spark, name):
    return list(Path(checkpoint_directory(spark).removeprefix("file:")).glob(f"{name}-*"))


def test_features_of_a_large_batch_take_bounded_memory():
    batch = pa.RecordBatch.from_pydict({"text": [prose(2_000, n) for n in range(400)]})
    assert batch.nbytes > 3 << 20
    tracemalloc.start()
    found = list(quality._patterns("text")(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(sum(part.column("n").to_pylist()) for part in found) == 2 * 400
    assert peak < 48 << 20


def test_encoders_are_given_up_once_texts_are_tokenised():
    worker_memory(packing.ENCODERS)["some.json"] = "encoder"
    ids = [np.array(some, "<u2").tobytes() for some in ([5, 5, 1], [7, 1])]
    (counts,) = packing._count(iter([pa.RecordBatch.from_pydict({"ids": ids})]))
    assert dict(zip(*(counts.column(name).to_pylist() for name in ("term", "n")), strict=True)) == {1: 2, 5: 1, 7: 1, -1: 2, -2: 5}
    assert "some.json" not in worker_memory(packing.ENCODERS)


def test_packing_deletes_tokens_that_are_written_anew(spark):
    before = _left(spark, "tokens")
    packed = packing.pack(frame(spark, rows([prose(50, n) for n in range(40)])))
    assert _left(spark, "tokens") == before
    assert sum(row["length"] for row in packed.collect()) > 40 * 50


def test_staged_files_go_with_their_block(spark):
    before = _left(spark, "block")
    with staged(spark.range(10), "block") as held:
        assert held.count() == 10 and len(_left(spark, "block")) == len(before) + 1
    assert _left(spark, "block") == before
    with pytest.raises(ZeroDivisionError), staged(spark.range(10), "block"):
        raise ZeroDivisionError
    assert _left(spark, "block") == before


def test_encoder_asks_the_model_once_for_a_word():
    encoder = packing.WordEncoder(packing.tokenizer_path())
    asked = []

    class Model:
        def tokenize(self, word, model=encoder.model):
            asked.append(word)
            return model.tokenize(word)

    encoder.model = Model()
    texts = ["Alpha, beta. ALPHA; (beta) alpha!", None, "beta:alpha 77", "alpha, beta."]
    found = encoder.encode_all(pa.array(texts)) + encoder.encode_all(pa.array(texts[2:]))
    assert sorted(asked) == sorted(["alpha", "beta", ",", ".", ";", "(", ")", "!", ":", "7"])
    library = Tokenizer.from_file(packing.tokenizer_path())
    assert [ids.tolist() for ids in found] == [library.encode(text or "", add_special_tokens=False).ids for text in texts + texts[2:]]


def test_encoder_starts_anew_when_its_table_is_full(monkeypatch):
    monkeypatch.setattr(packing, "CACHED", 50)
    encoder = packing.WordEncoder(packing.tokenizer_path())
    library = Tokenizer.from_file(packing.tokenizer_path())
    for some in range(30):
        texts = [prose(5 + 20 * (some % 3), 10 * some + at) + f" word{some} x{at}y'z éÉ{some}" for at in range(3)]
        texts += ["".join(f" {chr(97 + n % 26)}{chr(97 + n // 26)}q" for n in range(300))] if some % 10 == 5 else []
        found = encoder.encode_all(pa.array(texts))
        assert [ids.tolist() for ids in found] == [library.encode(text, add_special_tokens=False).ids for text in texts]
        assert encoder.used <= encoder.room <= 1000
    assert encoder.room < 1000


def test_odd_words_go_to_the_tokenizer_whole():
    signs = "aAbÉßŒŉſÿKİıΣς'sStT12½²ª×÷—-!?.<|>\0\x1c\x7f\x85\xa0　 \ṉ́̌hHjJ中"
    texts = ["".join(signs[(at * at * 7 + n * (at + 3) * 11) % len(signs)] for n in range(1 + at % 12)) for at in range(3_000)]
    texts += ["<|EndOfText|>", "<|endoftext|>", "X<|ENDOFTEXT|>Y A", "H̱ ẖ", "'!'s '''s DON'T", "a-—b", ""]
    library = Tokenizer.from_file(packing.tokenizer_path())
    found = packing.WordEncoder(packing.tokenizer_path()).encode_all(pa.array(texts))
    assert [ids.tolist() for ids in found] == [library.encode(text, add_special_tokens=False).ids for text in texts]


def test_terms_of_many_documents_at_once(monkeypatch):
    random = np.random.default_rng(5)
    docs = [random.integers(0, 70_000 if at % 40 == 3 else 60, 1 + at % 50).astype("<u4") for at in range(200)]
    ids = [doc.astype("<u2").tobytes() if doc.max() < 1 << 16 else b"\0" + doc.tobytes() for doc in docs]
    batch = pa.RecordBatch.from_pydict({"ids": ids})
    monkeypatch.setattr(packing, "BLOCK_TOKENS", 100)
    (counts,) = packing._count(iter([batch]))
    spread = np.bincount(np.concatenate([np.unique(doc) for doc in docs]))
    expected = {term: n for term, n in enumerate(spread.tolist()) if n} | {-1: 200, -2: sum(map(len, docs))}
    assert dict(zip(*(counts.column(name).to_pylist() for name in ("term", "n")), strict=True)) == expected
    corpus = packing.Corpus(200, sum(map(len, docs)) / 200, spread)
    (told,) = packing._topics(corpus, 30)(iter([batch]))
    for doc, topic, term in zip(docs, *(told.column(name).to_pylist() for name in ("topic", "term")), strict=True):
        terms, frequency = np.unique(doc, return_counts=True)
        weight = corpus.weights(terms, frequency, len(doc))
        for few, found in ((30, topic), (2, term)):
            shared = np.where(spread[terms] >= few, weight, -1)
            assert found == (terms[shared.argmax()] if shared.max() >= 0 else -1)


def test_scores_do_not_depend_on_how_many_documents_are_added_up_at_once(monkeypatch):
    random = np.random.default_rng(6)
    docs = [random.integers(0, 80, 40).astype(np.uint32) for _ in range(150)]
    order = packing.packing_order(docs, 128)
    monkeypatch.setattr(packing, "MATRIX", 100)
    assert packing.packing_order(docs, 128) == order and sorted(order) == list(range(150))
