"""Quality classifier from weak labels.

1. Heuristic labellers look at surface features of each text and vote good (1),
   bad (-1) or nothing (0).
2. Expectation maximisation over the counts of vote patterns in the whole corpus
   estimates each labeller's accuracy and the share of good documents; the
   posterior of a pattern is its label. Patterns number ``3 ** labellers`` at most.
3. A hashed linear scorer is fitted to the posterior labels of a sample and
   scores every document. Where a table of reviewed rows is given, a reviewer is
   one more labeller, whose vote replaces the posterior and weighs ten times as
   much. Both samples, of texts
   and of reviewed rows, have ``sample_rows`` rows at most and are chosen by hash;
   they are the only bounded part. Texts stay in the tasks: those sum up in how
   many texts of each class a token occurs, and the driver gets the numbers of the
   telling tokens of each sampled text alone.

The same machinery runs for two targets: quality and freedom from abuse. A
document is kept when both scores are at least one half.

Defined results: null counts as empty; texts without words get no votes, the
pattern of silence gets the prior, and they are scored like others; repeated
rows get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curveframe.llm.common import SPACE, lower_ascii, mix, neutral, owners, pieces, restored, stage, text_bytes, without, word_hashes, word_spans

SAMPLE_ROWS = 4_000
HASHED = 1 << 18
BUCKETS = HASHED + 64  # and three for each labeller
SHIFT = np.uint64(64 - 18)
LEAST_Z = 5.0
OFTEN = 3
WEAK_WEIGHT = 0.1  # of a text that no reviewer has read, beside one that a reviewer has
STEMS = (4, 6)  # bytes of a word's beginning that are a token too: abuse is inflected and compounded
PENALTY = 1e-6
FULL_WORDS = 40  # texts of fewer words have shorter vectors: they show less
PIECE_BYTES = 1 << 18  # the features of a piece take up to ninety times its size
ROUNDS = 60

# Words of abuse in English, Spanish, French and German; public, everyday lists.
INSULTS = """idiot idiots moron morons stupid loser losers clown imbecile dumb jerk creep fool pathetic worthless retard
idiota idiotas imbécil imbéciles estúpido estúpida tonto pendejo gilipollas inútil payaso patético
idiote idiotes imbécile imbéciles stupide crétin crétins débile abruti connard connasse minable
dummkopf trottel vollidiot depp schwachkopf versager blödmann dumm erbärmlich""".split()
VULGAR = """crap bastard bitch asshole damn shit fuck fucking slut whore
mierda cabrón bastardo maldito maldita puta hijoputa
merde putain salaud salope enculé bâtard
arschloch scheiße scheisse wichser hurensohn schlampe mistkerl""".split()
CONTEMPT = """trash scum garbage filth vermin disgusting nazi
basura escoria asqueroso asquerosa
ordure ordures racaille vermine dégoûtant
abschaum dreck ungeziefer widerlich""".split()
ABUSE = (INSULTS, VULGAR, CONTEMPT)

SIGN = np.zeros(256, dtype=bool)
SIGN[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
PLAIN_SIGN = np.zeros(256, dtype=bool)
PLAIN_SIGN[[ord(sign) for sign in ".,;:'\"()-?"]] = True
UPPER = np.zeros(256, dtype=bool)
UPPER[65:91] = True
LOWER = np.zeros(256, dtype=bool)
LOWER[97:123] = True
LETTER = UPPER | LOWER
LETTER[128:] = True


@dataclass
class Features:
    """Surface measures of each text of a batch, and its hashed tokens."""

    n_words: np.ndarray
    upper: np.ndarray  # share of upper-case among ASCII letters
    sign: np.ndarray  # unusual signs per word
    shout: np.ndarray  # words ending with two or more signs, per word
    lone: np.ndarray  # words without any letter or digit, per word
    repeat: np.ndarray  # words equal to the word before, per word
    variety: np.ndarray  # distinct words per word
    length: np.ndarray  # mean word length in bytes
    abuse: np.ndarray  # words of each list of abuse, a row for each list
    words: tuple[np.ndarray, np.ndarray]  # owner and hash of each word and stem, signs and case ignored
    shapes: tuple[np.ndarray, np.ndarray]  # owner and hash of each word's shape


def _listed(words: list[str]) -> np.ndarray:
    raw, offsets = text_bytes(pa.array(words))
    return np.sort(word_hashes(raw, offsets[:-1], offsets[1:]))


def _sums(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[ends] - total[starts]


def features(column: pa.Array) -> Features:
    raw, offsets = text_bytes(column)
    starts, ends, firsts = word_spans(raw, offsets, SPACE)
    low = lower_ascii(raw)
    core_starts, core_ends, core_firsts = word_spans(low, offsets, ~(LETTER | ((np.arange(256) >= 48) & (np.arange(256) <= 57))))
    core = word_hashes(low, core_starts, core_ends)
    words, docs = np.diff(firsts), owners(firsts)
    per = np.maximum(words, 1)

    def by_text(flags: np.ndarray, places: np.ndarray = offsets) -> np.ndarray:
        return _sums(flags, places[:-1], places[1:])

    signs, letters = SIGN[raw], LETTER[raw]
    in_sign = _sums(signs, starts, ends)
    in_letter = _sums(letters, starts, ends)
    wide = ends - starts
    last_two = signs[np.maximum(ends - 1, 0)] & signs[np.maximum(ends - 2, 0)] & (wide > 2) if len(starts) else np.zeros(0, bool)
    lone = (in_letter == 0) & (in_sign == wide)
    core_docs = owners(core_firsts)
    same = np.zeros(len(core), bool)
    if len(core) > 1:
        same[1:] = (core[1:] == core[:-1]) & (core_docs[1:] == core_docs[:-1])
    order = np.lexsort((core, core_docs))
    first_seen = np.ones(len(core), bool)
    if len(core) > 1:
        first_seen[1:] = (core[order][1:] != core[order][:-1]) | (core_docs[order][1:] != core_docs[order][:-1])
    distinct = np.bincount(core_docs[order][first_seen], minlength=len(words)) if len(core) else np.zeros(len(words))
    n_core = np.diff(core_firsts)
    abuse = np.zeros((len(ABUSE), len(words)))
    for row, known in zip(abuse, map(_listed, ABUSE), strict=True):
        abusive = known[np.minimum(np.searchsorted(known, core), len(known) - 1)] == core
        row += np.bincount(core_docs[abusive], minlength=len(words))
    tokens = [(core_docs, core)]
    for size in STEMS:
        long = core_ends - core_starts > size
        stems = word_hashes(low, core_starts[long], core_starts[long] + size)
        tokens.append((core_docs[long], mix(stems + np.uint64(size))))
    ascii_letters = by_text(UPPER[raw] | LOWER[raw])
    # Tokens: the words, and of each word its shape (case, size, signs, whether it repeats).
    upper = _sums(UPPER[raw], starts, ends)
    final = raw[np.maximum(ends - 1, 0)] if len(raw) else np.zeros(0, np.uint8)
    shape = (
        np.minimum(upper, 3) * 64 + np.minimum(in_sign, 3) * 16 + np.where(SIGN[final], final, 0).astype(np.int64) * 256 + np.minimum(wide, 15)
    ).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    echo = (same + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    return Features(
        n_words=words,
        upper=by_text(UPPER[raw]) / np.maximum(ascii_letters, 1),
        sign=by_text(signs & ~PLAIN_SIGN[raw]) / per,
        shout=np.bincount(docs, weights=last_two, minlength=len(words)) / per if len(docs) else np.zeros(len(words)),
        lone=np.bincount(docs, weights=lone, minlength=len(words)) / per if len(docs) else np.zeros(len(words)),
        repeat=np.bincount(core_docs, weights=same, minlength=len(words)) / np.maximum(n_core, 1) if len(core) else np.zeros(len(words)),
        variety=distinct / np.maximum(n_core, 1),
        length=_sums(letters, offsets[:-1], offsets[1:]) / per,
        abuse=abuse,
        words=tuple(np.concatenate(column) for column in zip(*tokens, strict=True)),
        shapes=(np.concatenate([docs, core_docs]), np.concatenate([shape, echo])),
    )


def _vote(good: np.ndarray, bad: np.ndarray, speaks: np.ndarray) -> np.ndarray:
    return np.where(~speaks, 0, np.where(bad, -1, np.where(good, 1, 0))).astype(np.int8)


def quality_votes(f: Features) -> np.ndarray:
    """One column per labeller. Each looks at another symptom, several overlap on each kind of junk."""
    some, many = f.n_words >= 3, f.n_words >= 20
    return np.stack(
        [
            _vote(f.upper < 0.2, f.upper > 0.5, some),  # shouting in capitals
            _vote(f.shout < 0.05, f.shout > 0.25, some),  # words that end in runs of signs
            _vote(f.sign < 0.1, f.sign > 0.4, some),  # signs that prose hardly uses
            _vote(f.lone < 0.05, f.lone > 0.2, some),  # separators between words, tables
            _vote(f.repeat < 0.05, f.repeat > 0.25, some),  # the same word again and again
            _vote(f.variety > 0.3, f.variety < 0.12, many & (f.n_words < 2_000)),  # few distinct words
            _vote((f.length > 2) & (f.length < 12), (f.length > 25) | (f.length < 1), some),  # word length
        ],
        axis=1,
    )


def abuse_votes(f: Features) -> np.ndarray:
    """Three kinds of abuse, each with its own words in four languages, and the density of all."""
    some, density = f.n_words >= 1, f.abuse.sum(axis=0) / np.maximum(f.n_words, 1)
    kinds = [_vote(count == 0, count >= 1, some) for count in f.abuse]
    return np.stack([*kinds, _vote(density == 0, density > 0.002, some)], axis=1)


def pattern(votes: np.ndarray) -> np.ndarray:
    return (votes.astype(np.int64) + 1) @ (3 ** np.arange(votes.shape[1], dtype=np.int64))


def unpattern(codes: np.ndarray, labellers: int) -> np.ndarray:
    return codes[:, None] // 3 ** np.arange(labellers) % 3 - 1


def estimate(codes: np.ndarray, counts: np.ndarray, labellers: int, rounds: int = ROUNDS) -> np.ndarray:
    """Posterior of good for each vote pattern, by expectation maximisation from the majority vote.

    Each labeller that speaks has its own chance of voting good or bad for each
    class; silence says nothing. Counts of one half keep chances off 0 and 1.
    """
    votes = unpattern(codes, labellers)
    balance = votes.sum(axis=1)
    posterior = np.where(votes.min(axis=1) < 0, 0.1, np.where(balance > 0, 0.95, 0.7))
    for _ in range(rounds):
        prior = (np.sum(counts * posterior) + 1) / (np.sum(counts) + 2)
        log_odds = np.full(len(codes), np.log(prior) - np.log1p(-prior))
        for labeller in range(labellers):
            chance = np.ones((2, 3))
            for vote in (-1, 1):
                cast = votes[:, labeller] == vote
                chance[0, vote + 1] = np.sum(counts * (1 - posterior) * cast) + 0.5
                chance[1, vote + 1] = np.sum(counts * posterior * cast) + 0.5
            chance[:, [0, 2]] /= chance[:, [0, 2]].sum(axis=1, keepdims=True)
            at = votes[:, labeller] + 1
            log_odds += np.log(chance[1, at]) - np.log(chance[0, at])
        posterior = 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))
    return posterior


Vector = tuple[np.ndarray, np.ndarray, np.ndarray]


def _with_votes(vector: Vector, votes: np.ndarray) -> Vector:
    """Adds what each labeller voted; those buckets lie behind the hashed ones."""
    n, labellers = votes.shape
    doc = np.repeat(np.arange(n), labellers)
    bucket = HASHED + 3 * np.tile(np.arange(labellers), n) + votes.ravel() + 1
    columns = zip(vector, (doc, bucket, np.ones(n * labellers)), strict=True)
    doc, bucket, value = (np.concatenate(column) for column in columns)
    return doc.astype(np.int32), bucket.astype(np.int32), value.astype(np.float32)


def quality_vector(f: Features) -> Vector:
    """(text, bucket, value): dampened counts of word shapes, of unit length for all but short texts."""
    n, (owner, tokens) = len(f.n_words), f.shapes
    key, counts = np.unique(owner * HASHED + (mix(tokens) >> SHIFT).astype(np.int64), return_counts=True)
    doc = key // HASHED
    norm = np.sqrt(np.maximum(np.bincount(doc, weights=counts, minlength=n), 2 * FULL_WORDS))
    return _with_votes((doc, key % HASHED, np.sqrt(counts) / norm[doc]), quality_votes(f))


def word_vector(f: Features) -> Vector:
    """(text, bucket, value): presence of words and stems, once and ``OFTEN`` times. One word can decide, however long the text is."""
    owner, tokens = f.words
    key, counts = np.unique(owner * HASHED + (mix(tokens) >> SHIFT).astype(np.int64), return_counts=True)
    often = key[counts >= OFTEN]
    again = (mix((often % HASHED).astype(np.uint64)) >> SHIFT).astype(np.int64)
    key = np.unique(np.concatenate([key, often // HASHED * HASHED + again]))
    return _with_votes((key // HASHED, key % HASHED, np.ones(len(key))), abuse_votes(f))


TARGETS = (("quality", quality_votes, quality_vector), ("abuse", abuse_votes, word_vector))


def telling(counts: DataFrame, good: float, bad: float) -> DataFrame:
    """Buckets whose presence differs between the classes by ``LEAST_Z`` standard errors or more."""
    share = F.greatest(F.least((F.col("in_good") + F.col("in_bad")) / (good + bad), F.lit(1 - 1e-9)), F.lit(1e-9))
    error = F.sqrt(share * (1 - share) * (1 / good + 1 / bad))
    return counts.where(F.abs(F.col("in_good") / good - F.col("in_bad") / bad) >= LEAST_Z * error).select("bucket")


def fit(doc: np.ndarray, bucket: np.ndarray, value: np.ndarray, target: np.ndarray, weight: np.ndarray, rounds: int = 800) -> np.ndarray:
    """Logistic regression on soft labels over telling buckets. The last weight is the bias."""
    n = len(target)
    share = np.clip(np.average(target, weights=weight), 1e-3, 1 - 1e-3)
    weight = weight / weight.sum()
    weights = np.zeros(BUCKETS + 1)
    weights[-1] = np.log(share / (1 - share))
    names, place = np.unique(bucket, return_inverse=True)
    held, grown = np.append(np.zeros(len(names)), weights[-1]), np.full(len(names) + 1, 1e-8)
    for _ in range(rounds):
        score = np.bincount(doc, weights=value * held[place], minlength=n) + held[-1]
        error = (1 / (1 + np.exp(-np.clip(score, -40, 40))) - target) * weight
        slope = np.append(np.bincount(place, weights=value * error[doc], minlength=len(names)), error.sum())
        slope[:-1] += PENALTY * held[:-1]
        grown += slope**2
        held -= slope / np.sqrt(grown)
    weights[names], weights[-1] = held[:-1], held[-1]
    return weights


def _patterns(text_column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text_column, PIECE_BYTES):
            f = features(piece.column(text_column))
            codes = [pattern(votes(f)) for _, votes, _ in TARGETS]
            for target, code in enumerate(codes):
                values, counts = np.unique(code, return_counts=True)
                columns = [pa.array(np.full(len(values), target)), pa.array(values), pa.array(counts)]
                yield pa.RecordBatch.from_arrays(columns, ["target", "code", "n"])

    return run


def _scores(text_column: str, weights: list[np.ndarray]):
    # Few buckets have a weight, so the tasks get those alone.
    sparse = [(np.flatnonzero(w), w[np.flatnonzero(w)]) for w in weights]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = [np.zeros(BUCKETS + 1) for _ in sparse]
        for w, (places, values) in zip(full, sparse, strict=True):
            w[places] = values
        for piece in pieces(batches, text_column, PIECE_BYTES):
            f = features(piece.column(text_column))
            columns = list(piece.columns)
            for w, (_, _, vector) in zip(full, TARGETS, strict=True):
                doc, bucket, value = vector(f)
                score = np.bincount(doc, weights=value * w[bucket], minlength=piece.num_rows) + w[-1]
                columns.append(pa.array(1 / (1 + np.exp(-np.clip(score, -40, 40)))))
            yield pa.RecordBatch.from_arrays(columns, [*piece.schema.names, "p_quality", "p_civil"])

    return run


def _hash_share(column: str, rows: int, total: int):
    """Condition that about nine tenths of ``rows`` of ``total`` rows meet, or all if they are few."""
    if total <= rows:
        return F.lit(True)
    return F.pmod(F.xxhash64(column), F.lit(1 << 32)) < int((1 << 32) * 0.9 * rows / total)


def _sample(docs: DataFrame, text_column: str, total: int, labels: DataFrame | None, id_column: str, rows: int) -> DataFrame:
    """Texts with the reviewer's votes on quality and abuse, null where none has looked."""
    # Copies share their hash, so a group of copies takes one place whatever its size.
    chosen = docs.where(_hash_share(text_column, rows, total))
    unread = [F.lit(None).cast("double").alias(name) for name in ("quality", "abuse")]
    if labels is None:
        return chosen.select(text_column, *unread).distinct()
    votes = labels.where(F.col(id_column).isNotNull()).groupBy(id_column)
    votes = votes.agg(F.avg("quality").cast("double").alias("quality"), F.avg(1 - F.col("toxic")).cast("double").alias("abuse"))
    reviewed = votes.where(_hash_share(id_column, rows, votes.count())).limit(rows)
    # At most ``rows`` rows of three numbers: small enough to broadcast at any scale.
    reviewed = F.broadcast(reviewed)
    read = docs.select(id_column, text_column).join(reviewed, id_column).select(text_column, "quality", "abuse")
    # A reviewer's vote replaces the posterior, so texts that have one are not sampled beside it.
    sample = chosen.select(id_column, text_column).join(reviewed, id_column, "left_anti").select(text_column, *unread)
    return sample.distinct().unionAll(read.distinct())


def _vectors(text_column: str, posteriors: list[dict[int, float]]):
    """For each target a row per text: its label and that label's weight, its buckets and their values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text_column, PIECE_BYTES):
            f = features(piece.column(text_column))
            for number, (posterior, (name, votes, vector)) in enumerate(zip(posteriors, TARGETS, strict=True)):
                doc, bucket, value = vector(f)
                order = np.argsort(doc, kind="stable")
                offsets = pa.array(np.searchsorted(doc[order], np.arange(piece.num_rows + 1)).astype(np.int32))
                reviewer = piece.column(name).to_numpy(zero_copy_only=False)
                voted = np.array([posterior[code] for code in pattern(votes(f)).tolist()])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(piece.num_rows, number)),
                        pa.array(np.where(np.isnan(reviewer), voted, reviewer).astype(float)),
                        pa.array(np.where(np.isnan(reviewer), WEAK_WEIGHT, 1.0)),
                        pa.ListArray.from_arrays(offsets, pa.array(bucket[order], pa.int32())),
                        pa.ListArray.from_arrays(offsets, pa.array(value[order], pa.float32())),
                    ],
                    ["target", "label", "weight", "buckets", "values"],
                )

    return run


def _fitted(vectors: DataFrame) -> np.ndarray:
    """Weights from one target's vectors; only telling buckets reach the driver."""
    in_good, in_bad = F.sum(F.col("weight") * F.col("label")), F.sum(F.col("weight") * (1 - F.col("label")))
    sums = vectors.agg(in_good.alias("good"), in_bad.alias("bad")).first()
    if sums["good"] is None:
        return np.zeros(BUCKETS + 1)
    present = vectors.select("label", "weight", F.explode("buckets").alias("bucket")).groupBy("bucket")
    counts = present.agg(in_good.alias("in_good"), in_bad.alias("in_bad"))
    names = np.array([row["bucket"] for row in telling(counts, max(sums["good"], 1e-9), max(sums["bad"], 1e-9)).collect()], dtype=np.int64)

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BUCKETS, dtype=bool)
        bits[names] = True
        for batch in batches:
            lists = batch.column("buckets")
            bucket = lists.flatten().to_numpy()
            value = batch.column("values").flatten().to_numpy()
            doc = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            used = bits[bucket]
            offsets = pa.array(np.searchsorted(doc[used], np.arange(batch.num_rows + 1)).astype(np.int32))
            columns = [
                batch.column("label"),
                batch.column("weight"),
                pa.ListArray.from_arrays(offsets, pa.array(bucket[used], pa.int32())),
                pa.ListArray.from_arrays(offsets, pa.array(value[used], pa.float32())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["label", "weight", "buckets", "values"])

    held = vectors.mapInArrow(narrow, "label double, weight double, buckets array<int>, values array<float>").toArrow().combine_chunks()
    sizes = pc.list_value_length(held["buckets"]).to_numpy()
    bucket, value = (pc.list_flatten(held[name]).to_numpy() for name in ("buckets", "values"))
    return fit(np.repeat(np.arange(held.num_rows), sizes), bucket, value, held["label"].to_numpy(), held["weight"].to_numpy())


def train(
    docs: DataFrame,
    labels: DataFrame | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
    sample_rows: int = SAMPLE_ROWS,
) -> list[np.ndarray]:
    """Weights of the scorers for both targets."""
    counted = docs.select(text_column).mapInArrow(_patterns(text_column), "target bigint, code bigint, n bigint")
    rows = counted.groupBy("target", "code").agg(F.sum("n").alias("n")).collect()
    total = sum(row["n"] for row in rows if row["target"] == 0)
    if not total:
        return [np.zeros(BUCKETS + 1) for _ in TARGETS]
    posteriors = []
    for target, (_, votes, _) in enumerate(TARGETS):
        codes = np.array([row["code"] for row in rows if row["target"] == target])
        counts = np.array([row["n"] for row in rows if row["target"] == target], dtype=float)
        labellers = votes(features(pa.array([""]))).shape[1]
        posteriors.append(dict(zip(codes.tolist(), estimate(codes, counts, labellers).tolist(), strict=True)))
    schema = "target bigint, label double, weight double, buckets array<int>, values array<float>"
    sample = _sample(docs, text_column, total, labels, id_column, sample_rows)
    vectors = stage(sample.mapInArrow(_vectors(text_column, posteriors), schema), "vectors")
    weights = [_fitted(vectors.where(F.col("target") == target).drop("target")) for target in range(len(TARGETS))]
    # The driver lives on through later stages.
    gc.collect()
    pa.default_memory_pool().release_unused()
    return weights


def score(
    docs: DataFrame,
    labels: DataFrame | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """Rows of ``docs`` plus p_quality and p_civil, the chances of being good text and free of abuse.

    ``labels`` has the id column and the reviewers' marks quality and toxic, 0 or 1.
    Columns of ``docs`` with the new names are left out.
    """
    docs = without(docs, ["p_quality", "p_civil"])
    schema = T.StructType([*docs.schema.fields, T.StructField("p_quality", T.DoubleType()), T.StructField("p_civil", T.DoubleType())])
    weights = train(docs, labels, id_column, text_column, sample_rows)
    return docs.mapInArrow(_scores(text_column, weights), schema)


def kept():
    return (F.col("p_quality") >= 0.5) & (F.col("p_civil") >= 0.5)


def good(docs: DataFrame, labels: DataFrame | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier keeps."""
    plain, names = neutral(docs)
    marks = None if labels is None else labels.select(F.col(id_column).alias(names[id_column]), "quality", "toxic")
    return restored(score(plain, marks, names[id_column], names[text_column]).where(kept()), names)
