"""Exact, near and repeated-string deduplication against brute force."""

import collections
import random

import pytest
from helpers import awkward_texts, frame, lower, prose, rows, sha, space_words

from curveframe.llm import anchors, components, grace_dedup, minhash_forest, suffix_dedup


@pytest.mark.parametrize("sizes", [{}, {"window_bytes": 3000, "window_rows": 4, "table_bytes": 2000}])
def test_exact(spark, sizes):
    data = [*rows(), *rows(first=100), (None, "one", None, None, None, None), (7, awkward_texts()[7], None, None, None, None)]
    groups = collections.defaultdict(list)
    for identity, text, *_ in data:
        groups[text or ""].append(identity)
    docs = frame(spark, data)
    found = grace_dedup.classes(docs, **sizes).collect()
    assert len(found) == len(data)
    for row in found:
        group = next(ids for text, ids in groups.items() if sha(text) == row["text_sha256"])
        assert row["doc_id"] in group
        assert row["group_size"] == len(group)
        assert row["keep_id"] == max(identity for identity in group if identity is not None)
    kept = [row for row in found if row["kept"]]
    assert sorted(row["text"] for row in kept) == sorted(groups)
    assert all(row["doc_id"] == row["keep_id"] for row in kept)


def test_exact_hash_collisions_are_settled_by_content():
    table = grace_dedup.ContentTable()
    numbers = [table.entry(5, str(at % 700).encode()) for at in range(2100)]
    assert numbers == [at % 700 for at in range(2100)]


def test_exact_survivors_keep_columns(spark):
    docs = frame(spark, rows())
    kept = grace_dedup.survivors(docs)
    assert kept.columns == docs.columns
    assert {row["doc_id"]: row["lang"] for row in kept.collect()}.items() <= {r[0]: r[2] for r in rows()}.items()


@pytest.mark.parametrize(
    "operator", [grace_dedup.classes, minhash_forest.near_duplicates, anchors.remove_repeats, suffix_dedup.remove_repeats]
)
def test_empty_table(spark, operator):
    assert operator(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def shingles(text):
    words = space_words(lower(text))
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1 if words else 0))}


def brute_components(data):
    sets = {identity: shingles(text) for identity, text, *_ in data}
    label = {identity: identity for identity in sets}

    def root(node):
        while label[node] != node:
            node = label[node]
        return node

    ids = sorted(sets)
    for at, a in enumerate(ids):
        for b in ids[:at]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                low, high = sorted((root(a), root(b)))
                label[high] = low
    return {identity: (len(sets[identity]), root(identity)) for identity in sets}


def edited(words, places):
    out = list(words)
    for place in places:
        out[place] = f"edit{place}"
    return " ".join(out)


def test_near(spark):
    base = prose(400, 11).split()
    # A chain of growing edits, crowded regions, and unrelated texts.
    texts = [edited(base, range(3, 3 + 4 * n, 4)) for n in range(20)]
    texts += [edited(base, [n, 200 + n]) for n in range(40)]
    texts += [prose(80, 100 + n) for n in range(20)]
    data = [*rows(), *rows(texts, first=50)]
    found = {row["doc_id"]: row for row in minhash_forest.near_duplicates(frame(spark, data)).collect()}
    wanted = brute_components(data)
    assert {key: (row["n_shingles"], row["component_id"]) for key, row in found.items()} == wanted
    assert all(row["kept"] == (key == row["component_id"]) for key, row in found.items())


def test_near_links_in_a_crowd_that_bypass_its_hub(spark):
    base, chance = prose(400, 11).split(), random.Random(4)
    texts = [edited(base, [n, 200 + n]) for n in range(60)]
    for _ in range(80):
        places = chance.sample(range(3, 400, 9), 20)
        texts += [edited(base, places[:10]), edited(base, places)]
    data = rows(texts)
    found = {row["doc_id"]: row["component_id"] for row in minhash_forest.near_duplicates(frame(spark, data)).collect()}
    assert found == {key: component for key, (_, component) in brute_components(data).items()}


def test_near_regions_are_counted_over_batches_and_tasks(spark):
    """A region of eight whose last row is in a batch of its own: its first and last row may still meet."""
    size = minhash_forest.TREES * minhash_forest.DEPTH
    signatures = [b"root" * minhash_forest.ROOT + b"".join((1000 * n + at).to_bytes(4, "big") for at in range(size - 3)) for n in range(8)]
    classes = spark.createDataFrame(list(enumerate(map(bytearray, signatures))), "node bigint, signature binary")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, "7")
    try:
        joined = spark.createDataFrame([], "node bigint, component bigint")
        split = {row["node"]: row["apart"] for row in minhash_forest._split(minhash_forest._crowds(classes), joined).collect()}
    finally:
        spark.conf.unset(name)
    assert set(split) == set(range(8)) and sum(split.values()) == 7


def test_near_rows_without_id(spark):
    data = [(None, "a b c d e f", *[None] * 4), (None, "a b c d e f", *[None] * 4), (3, "a b c d e f", *[None] * 4)]
    found = minhash_forest.near_duplicates(frame(spark, data)).collect()
    assert [(row["component_id"], row["kept"]) for row in sorted(found, key=str)].count((None, True)) == 2


def test_components_of_long_chains_and_stars(spark):
    links = [(n, n + 1) for n in range(200)] + [(1000, n) for n in range(1001, 1100)] + [(5000, 5000)]
    frame_ = spark.createDataFrame(links, "a bigint, b bigint").repartition(7)
    found = {row["node"]: row["component"] for row in components.components(frame_).collect()}
    assert all(found[n] == 0 for n in range(201))
    assert all(found[n] == 1000 for n in range(1000, 1100))


def brute_passages(data, window=50):
    large = float("inf")
    words = [(large if identity is None else identity, space_words(text)) for identity, text, *_ in data]
    least = {}
    for identity, own in words:
        for i in range(len(own) - window + 1):
            key = tuple(own[i : i + window])
            least[key] = min(least.get(key, large), identity)
    out = []
    for (identity, own), (doc_id, *_) in zip(words, data, strict=True):
        gone = set()
        for i in range(len(own) - window + 1):
            if least[tuple(own[i : i + window])] < identity:
                gone.update(range(i, i + window))
        out.append((doc_id, len(own), len(gone), " ".join(w for i, w in enumerate(own) if i not in gone)))
    return sorted(out, key=str)


def test_anchors(spark):
    data = [*rows(), *rows(first=100), (None, prose(120, 3), *[None] * 4)]
    found = anchors.remove_repeats(frame(spark, data).drop("n_words", "kept")).collect()
    removed = [sum(span["end"] - span["start"] for span in row["removed"]) for row in found]
    got = [(row["doc_id"], row["n_words"], n, row["kept_text"]) for row, n in zip(found, removed, strict=True)]
    assert sorted(got, key=str) == brute_passages(data)


def brute_strings(data, length=400):
    counts, bodies = collections.Counter(), [(identity, (text or "").encode()) for identity, text, *_ in data]
    for _, body in bodies:
        counts.update(body[i : i + length] for i in range(len(body) - length + 1))
    out = []
    for identity, body in bodies:
        gone = bytearray(len(body))
        for i in range(len(body) - length + 1):
            if counts[body[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append((identity, len(body), sum(gone), bytes(b for b, g in zip(body, gone, strict=True) if not g)))
    return sorted(out, key=str)


def test_suffix_arrays(spark):
    data = [*rows(), *rows([*awkward_texts()[10:13], prose(200, 3)[7:], prose(90, 5) + "~" + prose(300, 5)[350:]], first=100)]
    found = suffix_dedup.remove_repeats(frame(spark, data)).collect()
    removed = [sum(span["end"] - span["start"] for span in row["removed"]) for row in found]
    got = [(row["doc_id"], row["n_bytes"], n, bytes(row["kept_bytes"])) for row, n in zip(found, removed, strict=True)]
    assert sorted(got, key=str) == brute_strings(data)


@pytest.mark.parametrize("size, letters", [(1, 2), (60, 1), (300, 2), (300, 5)])
def test_suffix_array_and_common_prefixes(size, letters):
    import numpy as np

    values = np.random.default_rng(size).integers(0, letters, size)
    order = suffix_dedup.suffix_array(values)
    suffixes = [tuple(values[at:]) for at in order]
    assert suffixes == sorted(suffixes)
    common = suffix_dedup.kasai(values, order, 12)
    for at in range(1, size):
        pairs = zip(suffixes[at - 1], suffixes[at], strict=False)
        wanted = 0
        for a, b in pairs:
            if a != b:
                break
            wanted += 1
        assert common[at] == min(wanted, 12)
