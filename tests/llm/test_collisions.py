"""Words that a polynomial modulo a power of two cannot tell apart, whatever its base."""

import numpy as np
from helpers import prose

from curveframe.llm import anchors, decontaminate, minhash_forest
from curveframe.llm.common import content_hashes, prefix_hash, run_hashes, span_hash, word_spans

EVEN = "".join("ab"[at.bit_count() % 2] for at in range(1024))
ODD = "".join("ba"[at.bit_count() % 2] for at in range(1024))


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def with_words(word, count=60):
    return " ".join(f"{word} {plain}" for plain in prose(count, 1).split())


def test_the_words_collide_in_a_polynomial():
    raw = np.frombuffer((EVEN + ODD).encode(), np.uint8).astype(np.uint64)
    prefix = prefix_hash(raw)
    found = span_hash(prefix, np.array([0, 1024]), np.array([1024, 2048]))
    assert found[0] == found[1]


def test_content_hashes_tell_words_apart():
    words = [b"", b"a", b"b", b"a\0", b"ab" * 128, b"ba" * 128, EVEN.encode(), ODD.encode(), *[b"x" * n for n in range(2, 300)]]
    words += [bytes([97 + at // 26, 97 + at % 26]) * repeat for at in range(676) for repeat in (1, 4, 5, 9)]
    words = sorted(set(words) - {b""})
    raw = np.frombuffer(b" ".join(words), np.uint8)
    breaks = np.zeros(256, bool)
    breaks[32] = True
    starts, ends, _ = word_spans(raw, np.array([0, len(raw)]), breaks)
    for found in content_hashes(raw, starts, ends):
        assert len(set(found.tolist())) == len(words) == len(starts)
    again = np.frombuffer(b"zz " + raw.tobytes(), np.uint8)
    starts, ends, _ = word_spans(again, np.array([0, len(again)]), breaks)
    assert all((a[1:] == b).all() for a, b in zip(content_hashes(again, starts, ends), content_hashes(raw, starts[1:] - 3, ends[1:] - 3), strict=True))


def test_run_hashes_follow_content():
    source = np.random.default_rng(3)
    items = source.integers(0, 3, 400).astype(np.uint64)
    for size in (1, 2, 3, 5, 13, 25, 50):
        found = run_hashes(items, size)
        content = [items[at : at + size].tobytes() for at in range(len(items) - size + 1)]
        assert len(found) == len(content) and len(set(content)) == len(set(found.tolist()))
        assert len(set(zip(content, found.tolist(), strict=True))) == len(set(content))


def test_decontaminate(spark):
    items = spark.createDataFrame([("even", with_words(EVEN)), ("plain", EVEN)], "item_id string, text string")
    rows = decontaminate.annotate(docs(spark, with_words(ODD), with_words(EVEN)), items).orderBy("doc_id").collect()
    assert rows[0]["hit_items"] == [] and rows[1]["hit_items"] == ["even", "plain"]


def test_substring_dedup(spark):
    rows = anchors.remove_repeats(docs(spark, with_words(EVEN), with_words(ODD), with_words(EVEN))).orderBy("doc_id").collect()
    assert [len(row["removed"]) for row in rows] == [0, 0, 1] and rows[1]["kept_text"] == with_words(ODD)


def test_near_duplicates(spark):
    rows = minhash_forest.near_duplicates(docs(spark, with_words(EVEN), with_words(ODD), with_words(EVEN))).orderBy("doc_id").collect()
    assert [row["component_id"] for row in rows] == [0, 1, 0]


def test_survivors_are_told_apart_by_text(spark):
    text, other = prose(80, 5), prose(80, 6)
    rows = [(0, text, 1), (1, text, 2), (1, other, 3), (2, other + " end", 4), (None, text, 5), (3, None, 6), (4, "", 7)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, digest int")
    left = minhash_forest.survivors(frame)
    assert left.columns == frame.columns
    assert sorted(row["digest"] for row in left.collect()) == [1, 3, 5, 6, 7]
