"""Near-duplicate detection with an LSH forest over MinHash signatures.

1. Each text becomes the set of its ``shingle``-word shingles and a signature of
   ``TREES * DEPTH`` minima. Texts with equal sets are one class from here on.
2. Each tree sorts the classes by its own ``DEPTH`` minima. Classes near each
   other that share ``ROOT`` minima or more are candidates: in a sparse region all
   of its classes meet; in a crowded one all meet the region's hub. The order ends
   with the id, so that a crowd is dealt over many tasks; the rows at the ends of
   tasks meet too.
3. Candidates are confirmed on full sets, in blocks of bounded size.
4. Crowds of one component have nothing left to find. In the others, classes outside
   the largest component meet all classes that can be like enough: an exact set join
   on the rarest shingles of each (prefixes), with bounds on sizes and positions.

Two sets of Jaccard similarity 0.75 share no region in any tree with a chance
of (1 - 0.75 ** ROOT) ** TREES, about 2e-5; all that share one are joined.

Defined results: null and wordless texts have no shingles and are linked with
nothing; rows without an id are linked with nothing and have no component;
repeated rows share a class; rows that share an id but not a text are kept or dropped
each by the class of its own text, and other texts are compared with one of theirs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curveframe.llm.common import (
    SPACE,
    content_hashes,
    lower_ascii,
    mix,
    neutral,
    owners,
    pieces,
    restored,
    run_hashes,
    stage,
    text_bytes,
    word_spans,
)
from curveframe.llm.components import Forest, components

SHINGLE = 5
SIMILARITY = 75  # per cent
TREES, DEPTH, ROOT = 20, 6, 3
NEAR = 6  # classes before it in the order that each class meets
BLOCK_PAIRS = 1_000
PIECE_BYTES = 1 << 20
LABEL = 4 * DEPTH
BUCKET_BITS = 20  # shingles are counted in 2 ** 20 buckets; a count only sets the order of prefixes
HOT_BITS = 12  # prefixes whose bucket holds 2 ** 13 sets or more are dealt over several groups
MOST_SALT_BITS = 8

_numbers = np.random.default_rng(20240501).integers(0, 1 << 63, (2, TREES * DEPTH), dtype=np.uint64)
FACTORS, SHIFTS = _numbers[0] | np.uint64(1), _numbers[1]


def shingle_sets(column: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each text, and their n + 1 offsets."""
    raw, offsets = text_bytes(column)
    raw = lower_ascii(raw)
    starts, ends, firsts = word_spans(raw, offsets, SPACE)
    words, _ = content_hashes(raw, starts, ends)
    doc = owners(firsts)
    runs = run_hashes(words, shingle)
    at = np.flatnonzero(doc[: len(runs)] == doc[shingle - 1 :][: len(runs)]) if len(runs) else np.zeros(0, np.int64)
    counts = np.diff(firsts)
    short = np.flatnonzero((counts > 0) & (counts < shingle))
    whole = np.zeros(len(short), np.uint64)
    for size in range(1, shingle):
        fit = counts[short] == size
        whole[fit] = run_hashes(words, size)[firsts[short[fit]]] if fit.any() else 0
    owner = np.concatenate([doc[at], short])
    hashes = np.concatenate([runs[at], whole])
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    owner, hashes = owner[new], hashes[new]
    return hashes, np.searchsorted(owner, np.arange(len(counts) + 1))


def signatures(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``TREES * DEPTH`` minima for each text; texts without shingles get zeros."""
    filled = np.flatnonzero(np.diff(offsets) > 0)
    out = np.zeros((len(offsets) - 1, TREES * DEPTH), dtype=">u4")
    if len(filled):
        for number in range(TREES * DEPTH):
            values = (hashes * FACTORS[number] + SHIFTS[number]) >> np.uint64(32)
            out[filled, number] = np.minimum.reduceat(values, offsets[filled])
    return out


def _describe(id_column: str, text_column: str, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text_column, PIECE_BYTES):
            hashes, offsets = shingle_sets(piece.column(text_column), shingle)
            sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes ^ np.uint64(salt)), dtype=np.uint64)]) for salt in (1, 2)]
            keys = [mix(total[offsets[1:]] - total[offsets[:-1]]).view(np.int64) for total in sums]
            signature = signatures(hashes, offsets)
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column(id_column).cast(pa.int64()),
                    pa.array(np.diff(offsets)),
                    pa.array(keys[0]),
                    pa.array(keys[1]),
                    pa.array([row.tobytes() for row in signature], pa.binary()),
                    piece.column("_digest"),
                ],
                ["id", "n_shingles", "key_a", "key_b", "signature", "digest"],
            )

    return run


def _pairs_near(roots: np.ndarray, nodes: np.ndarray, fresh: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidates of the last ``fresh`` rows with rows before them in regions of up to ``NEAR + 1``, and who lies in larger ones."""
    n = len(nodes)
    edge = np.flatnonzero(np.append(True, roots[1:] != roots[:-1]))
    size = np.repeat(np.diff(np.append(edge, n)), np.diff(np.append(edge, n)))
    crowd = size > NEAR + 1
    found = []
    for gap in range(1, NEAR + 1):
        at = np.arange(max(n - fresh, gap), n)
        at = at[(roots[at] == roots[at - gap]) & (nodes[at] != nodes[at - gap]) & ~crowd[at]]
        found.append(np.sort(np.stack([nodes[at], nodes[at - gap]], axis=1), axis=1))
    return np.concatenate(found), np.flatnonzero(crowd)


PAIR, BORDER, MEMBER = range(3)
FOUND = "kind int, tree int, label binary, a bigint, b bigint"


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted task: candidates (a, b), members of crowds, and the first and last rows, whose partners may lie elsewhere."""

    def rows_of(kind: int, rows: pa.Table) -> pa.RecordBatch:
        columns = [rows.column(name).combine_chunks() for name in ("tree", "label", "node")]
        kinds = pa.array(np.full(rows.num_rows, kind, np.int32))
        return pa.RecordBatch.from_arrays([kinds, *columns, pa.nulls(rows.num_rows, pa.int64())], ["kind", "tree", "label", "a", "b"])

    last: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        if last is None:
            yield rows_of(BORDER, rows.slice(0, NEAR))
        joined = (rows if last is None else pa.concat_tables([last, rows])).combine_chunks()
        labels = joined.column("label").to_pylist()
        roots = np.array([label[: 4 * ROOT] for label in labels], dtype=f"S{4 * ROOT}").view(f"V{4 * ROOT}")
        trees = joined.column("tree").to_numpy().astype(">i4").view("V4")
        key = np.rec.fromarrays([trees, roots]).view(f"V{4 * ROOT + 4}")
        pairs, members = _pairs_near(key, joined.column("node").to_numpy(), rows.num_rows)
        if len(pairs):
            nothing = [pa.nulls(len(pairs), pa.int32()), pa.nulls(len(pairs), pa.binary())]
            kinds = pa.array(np.full(len(pairs), PAIR, np.int32))
            columns = [kinds, *nothing, pa.array(pairs[:, 0]), pa.array(pairs[:, 1])]
            yield pa.RecordBatch.from_arrays(columns, ["kind", "tree", "label", "a", "b"])
        # Rows held over from the batch before count as members when they only now turn out to be in a crowd.
        if len(members):
            yield rows_of(MEMBER, joined.take(pa.array(members)))
        last = joined.slice(max(0, joined.num_rows - NEAR))
    if last is not None:
        yield rows_of(BORDER, last)


def _trees(classes: DataFrame) -> DataFrame:
    labels = F.transform(
        F.sequence(F.lit(0), F.lit(TREES - 1)),
        lambda tree: F.struct(tree.alias("tree"), F.substring("signature", tree * LABEL + 1, F.lit(LABEL)).alias("label")),
    )
    return classes.select("node", F.explode(labels).alias("at")).select("at.tree", "at.label", "node")


def forest(classes: DataFrame, tasks: int) -> DataFrame:
    """What the sorted orders of ``classes`` (node, signature) show: rows of the kinds above."""
    ordered = _trees(classes).repartitionByRange(tasks, "tree", "label", "node").sortWithinPartitions("tree", "label", "node")
    return stage(ordered.mapInArrow(_neighbours, FOUND), "forest")


def _crossing(found: DataFrame) -> DataFrame:
    """Candidates across the ends of tasks. A few rows per task are the only ones that one task sees together."""
    ends = Window.orderBy("tree", "label", "a")
    near = [
        F.struct(*[F.lag(name, gap).over(ends).alias(name) for name in ("a", "tree", "label")]) for gap in range(1, NEAR + 1)
    ]
    border = found.where(F.col("kind") == BORDER).select("tree", "label", "a").distinct()
    border = border.select("*", F.array(*near).alias("near"))
    met = border.select("tree", "label", "a", F.explode("near").alias("other")).where(
        (F.col("other.tree") == F.col("tree"))
        & (F.substring("other.label", 1, 4 * ROOT) == F.substring("label", 1, 4 * ROOT))
        & (F.col("other.a") != F.col("a"))
    )
    return met.select(F.least("a", "other.a").alias("a"), F.greatest("a", "other.a").alias("b"))


def _hubs(found: DataFrame) -> DataFrame:
    """Pairs of each member of a crowd with the crowd's hub.

    Copies of one text may be alike only by way of it. It has the commonest label of
    its region in nearly every tree, where a copy has it in some: the member that
    has the commonest label in most trees is the hub.
    """
    crowd = found.where(F.col("kind") == MEMBER).select("tree", F.substring("label", 1, 4 * ROOT).alias("root"), "label", F.col("a").alias("node")).distinct()
    labels = crowd.groupBy("tree", "root", "label").agg(F.count("*").alias("n"))
    common = labels.groupBy("tree", "root").agg(F.max(F.struct("n", "label")).alias("top")).select("tree", F.col("top.label").alias("label"))
    scores = crowd.join(common, ["tree", "label"]).groupBy("node").agg(F.count("*").alias("score"))
    scored = crowd.join(scores, "node", "left").select("tree", "root", "node", F.coalesce("score", F.lit(0)).alias("score"))
    hubs = scored.groupBy("tree", "root").agg(F.max(F.struct("score", (-F.col("node")).alias("low"))).alias("top"))
    hubs = hubs.select("tree", "root", (-F.col("top.low")).alias("hub"))
    pairs = crowd.join(hubs, ["tree", "root"]).where("node <> hub")
    return pairs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))


def _confirm(shingle: int, similarity: int):
    """Confirmed links of one block; pairs that links already join are not compared again."""

    def run(texts: pa.Table, pairs: pa.Table) -> pa.Table:
        sets: dict[int, np.ndarray] = {}
        for piece in pieces(iter(texts.to_batches()), "text", PIECE_BYTES):
            hashes, offsets = shingle_sets(piece.column("text"), shingle)
            for row, node in enumerate(piece.column("node").to_pylist()):
                sets[node] = hashes[offsets[row] : offsets[row + 1]]
        forest, links = Forest(), []
        for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), strict=True):
            if forest.root(a) == forest.root(b):
                continue
            small, large = sorted((sets[a], sets[b]), key=len)
            if 100 * len(small) < similarity * len(large):
                continue
            common = int(np.isin(small, large, assume_unique=True, kind="sort").sum())
            if 100 * common >= similarity * (len(small) + len(large) - common):
                forest.join(a, b)
                links.append((a, b))
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return run


def confirm(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: int) -> DataFrame:
    """The links among ``pairs`` (a, b), judged on the full sets of ``texts`` (node, text).

    Pairs with a common smaller neighbour share a block, so that each text of a small
    group travels once; a neighbour with very many pairs is spread over many blocks.
    """
    ends = pairs.select(F.col("a").alias("node"), F.col("a").alias("low")).unionAll(pairs.select(F.col("b").alias("node"), F.col("a").alias("low")))
    lows = ends.groupBy("node").agg(F.min("low").alias("low"))
    keyed = stage(pairs.join(lows.withColumnRenamed("node", "b"), "b").select("a", "b", "low"), "pairs")
    total = keyed.count()
    blocks = max(1, -(-total // BLOCK_PAIRS))
    crowd = keyed.groupBy("low").agg((F.count("*") / BLOCK_PAIRS).cast("int").alias("parts")).where("parts > 0")
    spread = keyed.join(crowd, "low", "left").select(
        "a",
        "b",
        F.pmod(
            F.xxhash64("low", F.pmod(F.xxhash64("a", "b"), F.coalesce("parts", F.lit(0)) + 1)), F.lit(blocks)
        ).alias("block"),
    )
    spread = stage(spread, "blocks")
    wanted = spread.select("block", F.explode(F.array("a", "b")).alias("node")).distinct()
    # Merged at every size: the texts that are wanted grow with the corpus.
    held = wanted.hint("merge").join(texts, "node").select(F.col("block").alias("place"), "node", "text")
    return held.groupBy("place").cogroup(spread.groupBy("block")).applyInArrow(_confirm(shingle, similarity), "a bigint, b bigint")


def _crowds(classes: DataFrame) -> DataFrame:
    """(tree, root, node) of all regions of more than ``NEAR + 1`` classes, whatever task or batch they lie in."""
    rooted = _trees(classes).select("tree", F.substring("label", 1, 4 * ROOT).alias("root"), "node")
    crowded = rooted.groupBy("tree", "root").agg(F.count("*").alias("n")).where(F.col("n") > NEAR + 1)
    return rooted.join(crowded.drop("n").hint("merge"), ["tree", "root"])


def _split(crowds: DataFrame, joined: DataFrame) -> DataFrame:
    """Members of crowds of several components: node, component, apart (not of the largest one of some crowd)."""
    members = crowds.join(joined.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    members = stage(members, "crowds")
    sizes = members.groupBy("tree", "root", "component").agg(F.count("*").alias("n"))
    most = sizes.groupBy("tree", "root").agg(F.max(F.struct("n", "component")).alias("top"), F.count("*").alias("parts"))
    most = most.where("parts > 1").select("tree", "root", F.col("top.component").alias("top"))
    split = members.join(most.hint("merge"), ["tree", "root"])
    return split.groupBy("node").agg(F.first("component").alias("component"), F.max(F.col("component") != F.col("top")).alias("apart"))


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _bucket_counts(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BUCKET_BITS, np.int64)
        for piece in pieces(batches, "text", PIECE_BYTES):
            np.add.at(counts, _buckets(shingle_sets(piece.column("text"), shingle)[0]), 1)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["bucket", "n"])

    return run


def _prefixes(ranks: np.ndarray, shingle: int, similarity: int):
    """The rarest shingles of each set: of two sets that are like enough, one at least is common to both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", PIECE_BYTES):
            hashes, offsets = shingle_sets(piece.column("text"), shingle)
            owner, sizes = owners(offsets), np.diff(offsets)
            rank = ranks[_buckets(hashes)]
            order = np.lexsort((hashes, rank, owner))
            place = np.arange(len(hashes)) - offsets[owner]
            kept = np.flatnonzero(place < (sizes + (-similarity * sizes) // 100 + 1)[owner])
            order, doc = order[kept], owner[kept]
            salt_bits = np.clip(rank[order].astype(np.int64) - HOT_BITS, 0, MOST_SALT_BITS)
            columns = [piece.column(name).take(pa.array(doc)) for name in ("node", "component", "apart")]
            columns += [pa.array(hashes[order].view(np.int64)), pa.array(1 << salt_bits), pa.array(place[kept]), pa.array(sizes[doc])]
            yield pa.RecordBatch.from_arrays(columns, ["node", "component", "apart", "hash", "salts", "place", "n"])

    return run


def _rest(held: DataFrame, shingle: int, similarity: int) -> DataFrame:
    """Pairs (a, b) of ``held`` (node, component, apart, text) that may be like enough, lie in two components, and one of which is apart."""
    counted = held.select("text").mapInArrow(_bucket_counts(shingle), "bucket bigint, n bigint")
    # At most 2 ** BUCKET_BITS rows of two numbers at any scale; a bucket met once keeps rank 0.
    counted = counted.groupBy("bucket").agg(F.sum("n").alias("n")).where("n > 1").toArrow()
    ranks = np.zeros(1 << BUCKET_BITS, np.uint8)
    ranks[counted.column("bucket").to_numpy()] = np.log2(counted.column("n").to_numpy()).astype(np.uint8)
    del counted
    schema = "node bigint, component bigint, apart boolean, hash bigint, salts bigint, place bigint, n bigint"
    prefixes = stage(held.mapInArrow(_prefixes(ranks, shingle, similarity), schema), "prefixes")
    few = prefixes.where("apart").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)))
    rest = prefixes.withColumn("salt", F.pmod(F.xxhash64("node"), "salts"))
    x = few.select("hash", "salt", *[F.col(name).alias(f"{name}_x") for name in ("node", "component", "place", "n")])
    y = rest.select("hash", "salt", *[F.col(name).alias(f"{name}_y") for name in ("node", "component", "place", "n", "apart")])
    # Common shingles that a pair needs, against those it can have when this one is its first.
    enough = (100 + similarity) * F.least(F.expr("n_x - place_x"), F.expr("n_y - place_y")) >= similarity * F.expr("n_x + n_y")
    once = ~F.col("apart_y") | (F.col("node_x") < F.col("node_y"))
    same = (F.col("k.hash") == F.col("l.hash")) & (F.col("k.salt") == F.col("l.salt"))
    pairs = x.alias("k").join(y.alias("l").hint("merge"), same & (F.col("component_x") != F.col("component_y")) & once & enough)
    return pairs.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()


def _classed(docs: DataFrame, id_column: str, text_column: str, shingle: int, similarity: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with the keys of their class, the classes, and the component of each class that has links."""
    described = stage(
        docs.select(id_column, text_column, F.md5(F.coalesce(text_column, F.lit(""))).alias("_digest")).mapInArrow(
            _describe(id_column, text_column, shingle), "id bigint, n_shingles bigint, key_a bigint, key_b bigint, signature binary, digest string"
        ),
        "signatures",
    )
    usable = described.where("n_shingles > 0 AND id IS NOT NULL")
    classes = usable.groupBy("key_a", "key_b").agg(F.min("id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    classes = stage(classes, "classes")
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, classes.count() // 10_000)
    texts = docs.select(F.col(id_column).cast("bigint").alias("node"), F.col(text_column).alias("text")).where(F.col(id_column).isNotNull())
    found = forest(classes, tasks)
    first = found.where(F.col("kind") == PAIR).select("a", "b").unionAll(_crossing(found)).unionAll(_hubs(found)).distinct()
    links = stage(confirm(first, texts, shingle, similarity), "links")
    joined = stage(components(links), "components")
    split = stage(_split(_crowds(classes), joined), "split")
    # Merged at every size, like the texts of candidates.
    held = stage(split.hint("merge").join(texts, "node"), "held")
    more = stage(confirm(_rest(held, shingle, similarity), held.select("node", "text"), shingle, similarity), "links")
    # The components found so far are stars; only links between them are new.
    stars = joined.where("node <> component").toDF("a", "b")
    found = components(stars.unionAll(more)) if more.count() else joined
    return described.drop("signature"), classes, found


def _judged(described: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (id, digest) with their class and component."""
    placed = classes.join(found, "node", "left").select("key_a", "key_b", F.col("node").alias("class_id"), F.coalesce("component", "node").alias("component"))
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return described.join(placed, ["key_a", "key_b"], "left").select(
        "id",
        "digest",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("class_id")).otherwise(F.col("id")).alias("class_id"),
        F.when(F.col("n_shingles") > 0, component).otherwise(F.col("id")).alias("component_id"),
    )


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    shingle: int = SHINGLE,
    similarity: int = SIMILARITY,
) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, class_id (smallest id of equal sets), component_id, kept."""
    found = _judged(*_classed(docs, id_column, text_column, shingle, similarity)).drop("digest")
    kept = F.coalesce(F.col("component_id") == F.col("id"), F.lit(True))
    return found.withColumn("kept", kept).withColumnRenamed("id", id_column)


def survivors(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their component.

    Rows are told apart by id and text: of rows that share an id, a dropped one does not come back with a kept one.
    """
    named, names = neutral(docs)
    key, text = names[id_column], names[text_column]
    described, classes, found = _classed(docs.select(id_column, text_column), id_column, text_column, SHINGLE, SIMILARITY)
    kept = _judged(described, classes, found).where(F.col("id").eqNullSafe(F.col("component_id"))).select("id", "digest").distinct()
    matched = F.col(key).eqNullSafe(F.col("id")) & (F.md5(F.coalesce(F.col(text), F.lit(""))) == F.col("digest"))
    return restored(named.join(kept, matched, "left_semi"), names)
