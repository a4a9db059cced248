"""Secret scan with an incremental blob ledger, in DataFrame functions only.

Every version of every path is content-addressed by the SHA-256 of its text. A
ledger row says which spans one rule version found in one blob; only pairs of a
blob and a rule version that the ledger does not hold are scanned, each blob
once however many paths carry it. Findings join back to all paths.

Defined results: null text counts as empty; a blob without findings is entered
with an empty list, so it is not scanned again; offsets are code points, end
exclusive; repeated rows each get the findings; an empty table gives none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched leftmost without overlap; ``group`` must have ``least`` characters."""

    kind: str
    pattern: str
    group: int
    least: int
    version: int = 1


# The three base kinds of the contract, in its order.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    # Only whole runs can match, so the length can be part of the pattern.
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
# Further kinds, of public token formats.
RULES = (
    *BASE,
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 32),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 32),
)

LEDGER = "blob string, kind string, version int, spans array<struct<start:int,end:int>>"


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _matches(rule: Rule) -> Column:
    """Gap before each match and the lengths of match and group; null where nothing matches."""
    found = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))
    held = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.group))
    gaps = F.slice(F.split("text", rule.pattern, -1), F.lit(1), F.size(found))
    zipped = F.arrays_zip(gaps.alias("gap"), found.alias("found"), held.alias("held"))
    lengths = F.transform(
        zipped,
        lambda item: F.struct(
            F.length(item["gap"]).alias("gap"), F.length(item["found"]).alias("found"), F.length(item["held"]).alias("held")
        ),
    )
    return F.when(F.col("text").rlike(rule.pattern), lengths)


def scan(docs: DataFrame, ledger: DataFrame, text_column: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows: one for each blob of ``docs`` and rule version that ``ledger`` lacks."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    blobs = docs.select(blob_of(F.col(text_column)).alias("blob"), text.alias("text"))
    blobs = blobs.groupBy("blob").agg(F.first("text").alias("text"))
    seen = ledger.groupBy("blob").agg(F.collect_set(F.struct("kind", "version")).alias("seen"))
    unseen = blobs.join(seen, "blob", "left")
    wanted = [
        F.when(
            ~F.coalesce(
                F.array_contains("seen", F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"))),
                F.lit(False),
            ),
            F.struct(
                F.lit(rule.kind).alias("kind"),
                F.lit(rule.version).alias("version"),
                F.lit(rule.least).alias("least"),
                _matches(rule).alias("matches"),
            ),
        )
        for rule in rules
    ]
    pairs = unseen.select("blob", F.explode(F.filter(F.array(*wanted), lambda pair: pair.isNotNull())).alias("pair"))
    pairs = pairs.select("blob", "pair.kind", "pair.version", "pair.least", "pair.matches")
    none = F.array().cast("array<struct<gap:int,found:int,held:int>>")
    pairs = pairs.withColumn("matches", F.coalesce("matches", none))
    return _with_spans(pairs).select("blob", "kind", "version", "spans")


def _with_spans(pairs: DataFrame) -> DataFrame:
    """Adds ``spans``: offsets are running sums of gaps and matches.

    The sums are folded over chunks of matches and then shifted by the widths of
    the chunks before, which keeps the cost of a text with very many matches low.
    """
    chunk = 256
    last = F.floor((F.size("matches") - 1) / chunk).cast("int")
    state = F.struct(F.lit(0).alias("width"), F.array().cast("array<int>").alias("starts"))
    folded = F.transform(
        F.when(F.size("matches") > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>")),
        lambda i: F.aggregate(
            F.slice("matches", i * chunk + 1, F.lit(chunk)),
            state,
            lambda held, item: F.struct(
                (held["width"] + item["gap"] + item["found"]).alias("width"),
                F.concat(held["starts"], F.array(held["width"] + item["gap"])).alias("starts"),
            ),
        ),
    )
    shifts = F.transform(
        "folded", lambda _, i: F.aggregate(F.slice("folded", F.lit(1), i), F.lit(0), lambda sum_, part: sum_ + part["width"])
    )
    starts = F.flatten(
        F.zip_with("folded", "shifts", lambda part, shift: F.transform(part["starts"], lambda place: place + shift))
    )
    good = F.filter(
        F.arrays_zip(starts.alias("start"), F.col("matches").alias("match")),
        lambda item: item["match"]["held"] >= F.col("least"),
    )
    spans = F.transform(
        good, lambda item: F.struct(item["start"].alias("start"), (item["start"] + item["match"]["found"]).alias("end"))
    )
    return pairs.withColumn("folded", folded).withColumn("shifts", shifts).withColumn("spans", spans)


def findings(
    docs: DataFrame,
    ledger: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    rules: tuple[Rule, ...] = RULES,
) -> DataFrame:
    """One row per row of ``docs``: its blob and all spans of ``rules`` that the ledger holds for it.

    Findings of one blob are one row, so only the side of the paths can be skewed.
    """
    current = F.array(*[F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version")) for rule in rules])
    spans = (
        ledger.where(F.array_contains(current, F.struct("kind", "version")) & (F.size("spans") > 0))
        .groupBy("blob")
        .agg(F.flatten(F.collect_list(F.transform("spans", lambda span: F.struct(span["start"].alias("start"), _order(rules).alias("rank"), F.col("kind").alias("kind"), span["end"].alias("end"))))).alias("found"))
    )
    paths = docs.select(F.col(id_column), blob_of(F.col(text_column)).alias("blob"))
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    return paths.join(spans, "blob", "left").select(
        id_column, "blob", F.sort_array(F.coalesce("found", none)).alias("found")
    )


def _order(rules: tuple[Rule, ...]) -> Column:
    rank = F.lit(len(rules))
    for place, rule in reversed(list(enumerate(rules))):
        rank = F.when(F.col("kind") == rule.kind, F.lit(place)).otherwise(rank)
    return rank
