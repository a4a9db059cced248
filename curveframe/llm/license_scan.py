"""Licence scan: normalised text against licence templates by Dice coefficient over word bigrams.

Texts fall into sentences, which end at a line break or behind one of ``.!?;:`` and
a blank. Words are runs of letters and digits, so comment signs and blank lines
vanish. The units compared are runs of whole sentences: for a template of m words,
from each sentence on the longest run of at most and the shortest run of at least
3m/4, m and 4m/3 words (2m at most), so a notice is found inside code and prose and
with a part missing or added. Everything is done by DataFrame functions inside the
row, without a shuffle.

Pruning loses nothing: a text needs one of the words without which no template can
be reached, then one of the bigrams of a template's prefix in a fixed order, and a
block of it as many bigrams of a template as the threshold asks for; the size of a
run must lie within the template's size bounds. Long texts are scanned in blocks
that hold whatever a run that starts in them, or competes with it, can reach.

Of the runs that reach the threshold and start at one sentence the one with the
greatest weight counts (then the first licence by id, then the longer run). The
weight is the number of common bigrams less those missing and those added, so a
short template does not win over the longer text that begins with it. The run is a
finding unless one of more weight (then by licence, then the earlier) has more than
half of the words of the shorter of both in common with it.

Defined results: null and empty texts have no finding; of templates with equal
weights the first by id counts; repeated rows each get theirs. ``unit`` is ``line``,
or ``paragraph`` for a run over several lines; ``unit_no`` and ``last_no`` are the
numbers of its first and last line from 0, ``start`` and ``words`` its place in
words of the text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curveframe.llm.license_texts import TEMPLATES

THRESHOLD = 0.75
BLOCK_WORDS = 4096
SENTENCE_END = r"[.!?;:][ \t\r]+"
NO_WORD = r"[^0-9a-z\x{80}-\x{10FFFF}]+"

# Words too common to tell a notice from other text.
COMMON_WORDS = (
    "a all an and any are as at be been by can for from has have in is it its may no not of on one or other shall should "
    "such that the these this to under use was which will with without you your"
).split()


def _word_list(text: str) -> list[str]:
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower())


def _bigrams(text: str) -> list[str]:
    words = _word_list(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def template_rows(templates: dict[str, list[str]] = TEMPLATES) -> list[tuple[str, list[str], int]]:
    """(licence id, distinct bigrams, number of words) of every template text, by id."""
    return [
        (name, _bigrams(text), len(_word_list(text)))
        for name in sorted(templates)
        for text in templates[name]
        if len(_word_list(text)) > 1
    ]


def size_bounds(size: int, threshold: float) -> tuple[int, int]:
    """Sizes of sets whose Dice coefficient with a set of ``size`` can reach ``threshold``."""
    return math.ceil(threshold * size / (2 - threshold)), math.floor((2 - threshold) * size / threshold)


def targets(words: int) -> list[int]:
    """Lengths in words that runs compared with a template of ``words`` words aim at."""
    return [3 * words // 4, words, 4 * words // 3]


def prefix_bigrams(rows: list[tuple[str, list[str], int]], threshold: float) -> list[str]:
    """Bigrams of which a unit needs one to reach ``threshold`` with any template.

    The overlap with a template of n bigrams is threshold / (2 - threshold) * n at
    least, so one of any n - overlap + 1 of them is in the unit; those with the
    longest words, which are the rarest in running text, are taken.
    """
    shared = Counter(bigram for _, bigrams, _ in rows for bigram in set(bigrams))
    needed: set[str] = set()
    for _, bigrams, _ in rows:
        overlap = size_bounds(len(bigrams), threshold)[0]
        order = sorted(bigrams, key=lambda b: (-min(len(w) for w in b.split()), -len(b), shared[b], b))
        needed.update(order[: len(bigrams) - overlap + 1])
    return sorted(needed)


def needed_words(rows: list[tuple[str, list[str], int]], threshold: float) -> list[str]:
    """Words of which a text needs one to reach ``threshold`` with any template.

    Words are taken until more bigrams of a template hold one of them than a unit may
    lack; long words and those in many bigrams come first.
    """
    taken: set[str] = set()
    for _, bigrams, _ in rows:
        overlap = size_bounds(len(bigrams), threshold)[0]
        left = {bigram for bigram in bigrams if not set(bigram.split()) & taken}
        while len(left) >= overlap:
            held = Counter(word for bigram in left for word in set(bigram.split()))
            best = min(
                held, key=lambda w: (w in COMMON_WORDS or w.isdigit(), len(w) < 5, -held[w] * min(len(w), 8), w)
            )
            taken.add(best)
            left = {bigram for bigram in left if best not in bigram.split()}
    return sorted(taken)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _texts(values: list[str]) -> Column:
    """An array of texts without line breaks; one literal, which Spark splits once."""
    return F.split(F.lit("\n".join(values)), "\n")


def _may_hold(text: Column, words: list[str]) -> Column:
    """Whether a text holds one of the words: one pattern, tried where a word starts, first letter first."""
    rest: dict[str, list[str]] = {}
    for word in words:
        rest.setdefault(word[0], []).append(re.escape(word[1:]))
    choices = "|".join(f"{letter}(?:{'|'.join(ends)})" for letter, ends in sorted(rest.items()))
    return F.concat(F.lit(" "), F.lower(text)).rlike(f"[^0-9a-z](?:{choices})(?![0-9a-z])")


def _tokens(text: Column) -> Column:
    """Words of a text in order: word, whether a sentence starts with it, number of its line."""

    def sentence(body: Column, line: Column) -> Column:
        words = F.filter(F.split(body, NO_WORD), lambda word: word != "")
        return F.transform(words, lambda word, i: F.struct(word.alias("word"), (i == 0).alias("first"), line.alias("line")))

    def of_line(body: Column, line: Column) -> Column:
        return F.flatten(F.transform(F.split(body, SENTENCE_END), lambda part: sentence(part, line)))

    return F.flatten(F.transform(F.split(F.lower(text), "\n"), of_line))


def _pairs(tokens: Column) -> Column:
    n = F.size(tokens)
    return F.zip_with(
        F.slice(tokens, F.lit(1), F.greatest(n - 1, F.lit(0))),
        F.slice(tokens, F.lit(2), F.greatest(n - 1, F.lit(0))),
        lambda a, b: F.concat_ws(" ", a["word"], b["word"]),
    )


def _blocks(text: Column, needed: list[str], reach: int, block: int) -> Column:
    """Blocks of ``block`` words of a text that holds a needed bigram, with what lies ``reach`` before and twice that behind."""

    def of(tokens: Column, pairs: Column) -> Column:
        n = F.size(tokens)

        def cut(number: Column) -> Column:
            own = number * block
            first = F.greatest(own - reach, F.lit(0))
            last = F.least(own + block + 2 * reach, n)

            def of_held(held: Column) -> Column:
                flags = F.transform(held, lambda token, i: F.when(token["first"], i))
                return F.struct(
                    first.alias("at"),
                    (own - first).alias("own"),
                    F.least(own + block, n).alias("until"),
                    (last == n).alias("ends"),
                    F.transform(held, lambda token: token["line"]).alias("lines"),
                    F.filter(flags, lambda i: i.isNotNull()).alias("starts"),
                    F.slice(pairs, first + 1, F.greatest(last - first - 1, F.lit(0))).alias("pairs"),
                )

            return _let(F.slice(tokens, first + 1, last - first), of_held)

        numbers = F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int"))
        return F.when(F.arrays_overlap(pairs, _texts(needed)), F.transform(numbers, cut))

    return _let(_tokens(text), lambda tokens: _let(_pairs(tokens), lambda pairs: of(tokens, pairs)))


def findings(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    templates: dict[str, list[str]] = TEMPLATES,
    threshold: float = THRESHOLD,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per finding: id, unit, unit_no, last_no, start, words, license_id, dice."""
    rows = template_rows(templates)
    names = list(dict.fromkeys(name for name, _, _ in rows))
    reach = 2 * max(words for _, _, words in rows)
    blocks = docs.where(_may_hold(F.col(text_column), needed_words(rows, threshold))).select(
        F.col(id_column), F.explode(_blocks(F.col(text_column), prefix_bigrams(rows, threshold), reach, block_words)).alias("block")
    )
    found = blocks.select(id_column, "block.lines", "block.at", F.explode(_best(F.col("block"), rows, names, threshold)).alias("one"))
    first, last = F.get("lines", F.col("one.start")), F.get("lines", F.col("one.stop") - 1)
    license_id = F.element_at(_texts(names), (1 - F.col("one.rank.number")).cast("int"))
    return found.select(
        id_column,
        F.when(first == last, "line").otherwise("paragraph").alias("unit"),
        first.alias("unit_no"),
        last.alias("last_no"),
        (F.col("at") + F.col("one.start")).alias("start"),
        (F.col("one.stop") - F.col("one.start")).alias("words"),
        license_id.alias("license_id"),
        F.round("one.rank.dice", 6).alias("dice"),
    )


def _best(block: Column, rows: list[tuple[str, list[str], int]], names: list[str], threshold: float) -> Column:
    """Findings of a block that start in its own words: start, stop, rank."""
    known = F.array(
        *[
            F.struct(
                F.lit(-names.index(name)).alias("number"),
                _texts(bigrams).alias("bigrams"),
                F.lit(words).alias("words"),
                F.array(*map(F.lit, targets(words))).alias("targets"),
                *[F.lit(bound).alias(key) for key, bound in zip(("low", "high"), size_bounds(len(bigrams), threshold), strict=True)],
            )
            for name, bigrams, words in rows
        ]
    )
    pairs, starts = block["pairs"], block["starts"]
    cuts = F.when(block["ends"], F.concat(starts, F.array(F.size(block["lines"])))).otherwise(starts)

    def held(hits: Column) -> Column:
        return F.filter(known, lambda t: F.size(F.array_intersect(hits, t["bigrams"])) >= t["low"])

    def stops(start: Column, ahead: Column, t: Column) -> Column:
        def around(target: Column) -> Column:
            under = F.array_max(F.filter(ahead, lambda cut: cut <= start + target))
            over = F.array_min(F.filter(ahead, lambda cut: cut >= start + target))
            return F.array(under, over)

        both = F.array_distinct(F.flatten(F.transform(t["targets"], around)))
        return F.filter(both, lambda cut: cut.isNotNull())

    def score(start: Column, stop: Column, t: Column) -> Column:
        def of(run: Column) -> Column:
            common = F.size(F.array_intersect(run, t["bigrams"]))
            dice = 2.0 * common / (F.size(run) + F.size(t["bigrams"]))
            return F.when(
                F.size(run).between(t["low"], t["high"]),
                F.struct(
                    (3 * common - F.size(run) - F.size(t["bigrams"])).alias("weight"),
                    t["number"].alias("number"),
                    stop.alias("stop"),
                    dice.alias("dice"),
                ),
            )

        return _let(F.array_distinct(F.slice(pairs, start + 1, F.greatest(stop - start - 1, F.lit(0)))), of)

    def best_from(start: Column, cuts: Column, place: Column, templates: Column) -> Column:
        def of(t: Column) -> Column:
            ahead = F.filter(F.slice(cuts, place + 2, 2 * t["words"]), lambda cut: cut <= start + 2 * t["words"])
            return _let(ahead, lambda near: F.transform(stops(start, near, t), lambda stop: score(start, stop, t)))

        scores = F.filter(F.flatten(F.transform(templates, of)), lambda one: one["dice"] >= threshold)
        return F.struct(start.alias("start"), F.array_max(scores).alias("rank"))

    def better(a: Column, b: Column) -> Column:
        return (a["rank"]["weight"] > b["rank"]["weight"]) | (
            (a["rank"]["weight"] == b["rank"]["weight"])
            & (
                (a["rank"]["number"] > b["rank"]["number"])
                | ((a["rank"]["number"] == b["rank"]["number"]) & (a["start"] < b["start"]))
            )
        )

    def shares(a: Column, b: Column) -> Column:
        common = F.least(a["rank"]["stop"], b["rank"]["stop"]) - F.greatest(a["start"], b["start"])
        return 2 * common > F.least(a["rank"]["stop"] - a["start"], b["rank"]["stop"] - b["start"])

    def chosen(all_: Column) -> Column:
        own = F.filter(all_, lambda a: (a["start"] >= block["own"]) & (a["start"] < block["until"] - block["at"]))
        kept = F.filter(own, lambda a: ~F.exists(all_, lambda b: shares(a, b) & better(b, a)))
        return F.transform(
            kept, lambda a: F.struct(a["start"].alias("start"), a["rank"]["stop"].alias("stop"), a["rank"].alias("rank"))
        )

    def of(templates: Column, cuts: Column) -> Column:
        runs = F.transform(starts, lambda start, place: best_from(start, cuts, place, templates))
        return F.when(F.size(templates) > 0, _let(F.filter(runs, lambda run: run["rank"].isNotNull()), chosen))

    every = sorted({bigram for _, bigrams, _ in rows for bigram in bigrams})
    hits = F.array_intersect(pairs, _texts(every))
    return _let(_let(hits, held), lambda templates: _let(cuts, lambda cuts: of(templates, cuts)))
