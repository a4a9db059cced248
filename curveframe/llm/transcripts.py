"""Transcript parsing with a hidden Markov model over speaker markers and line features.

Each line of a conversation is emitted by a role that starts or goes on speaking.
A row is a block whose first line starts a turn; speaker markers or the other
features may start further turns inside it. Chances come from counts over all
rows whose role is known; Viterbi recovers the roles from the texts alone, and
each recovered turn is rendered in one canonical form.

A conversation may hold any share of all rows, under any turn numbers. Rows are
sorted over all tasks and their lines numbered in that order (tasks, then offsets of
tasks), and each ``CHUNK`` numbers are a chunk; a chunk is reduced to the best scores between its border states (a max-plus
matrix), matrices are multiplied in groups, level by level, and the border states
come back down the same levels, so no task sees more than a chunk or a group.

Defined results: null text counts as empty and is one empty line; rows repeated in
all columns are read once; within one turn number rows are ordered by text; rows
without a turn come first, and roles follow each other in this order; rows without a conversation form one conversation; an
empty table gives an empty result. Unknown roles do not count for training.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curveframe.llm.common import stage

ROLES = ("system", "user", "assistant")
STATES = 2 * len(ROLES)  # a role starts (even) or goes on (odd)
CHUNK = 512  # lines in a chunk
GROUP = 256  # matrices that are multiplied at a time

# Names of speakers in public chat formats.
SPEAKERS = {
    "system": "system|instructions?|context",
    "user": "user|human|question|q|customer|prompt",
    "assistant": "assistant|bot|ai|answer|a|gpt|model|response",
}
OPEN, CLOSE = r"^[ \t]*(?:#{1,6} *|\*\*|\[|<\|?)?(?:", r")(?:\*\*)? *(?:\|?>|\]|:(?:\*\*)?)[ \t]*"
ANY_SPEAKER = "(?i)" + OPEN + "|".join(SPEAKERS.values()) + CLOSE


def lines_of(rows: DataFrame, conversation: str, turn: str, text: str) -> DataFrame:
    """Lines of all rows with their features: conv, turn, row_key, line_no, line, and one small number per feature.

    A line carries a hash and the length of its row's text, not the text.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lines = rows.select(
        F.col(conversation).alias("conv"),
        F.col(turn).cast("bigint").alias("turn"),
        F.xxhash64(body).alias("row_key"),
        F.length(body).alias("block"),
        *[F.col(name) for name in rows.columns if name in ("role", "first")],
        F.posexplode(F.split(body, "\r?\n")).alias("line_no", "line"),
    )
    marker = F.lit(0)
    for number, role in reversed(list(enumerate(ROLES, start=1))):
        marker = F.when(F.col("line").rlike("(?i)" + OPEN + SPEAKERS[role] + CLOSE), number).otherwise(marker)
    size = F.length("line")
    width = F.when(size == 0, 0).when(size < 24, 1).when(size < 60, 2).when(size < 120, 3).when(size < 240, 4).otherwise(5)
    block = F.col("block")
    weight = F.when(F.col("line_no") > 0, 5).when(block < 80, 0).when(block < 200, 1).when(block < 400, 2).when(block < 800, 3).otherwise(4)
    return lines.select(
        "*",
        (F.col("line_no") == 0).cast("int").alias("opens"),
        marker.alias("marker"),
        F.col("line").rlike(r"[?？]\s*$").cast("int").alias("asks"),
        width.alias("width"),
        F.when(F.col("line_no") == 0, F.when(F.col("turn") == 0, 1).otherwise(2)).otherwise(0).alias("place"),
        F.least(F.col("line_no"), F.lit(3)).alias("depth"),
        weight.alias("weight"),
    )


FEATURES = {"marker": 4, "asks": 2, "width": 6, "place": 3, "depth": 4, "weight": 6}
CODE = "marker + 4 * (asks + 2 * (width + 6 * (place + 3 * (depth + 4 * weight))))"
CODES = int(np.prod(list(FEATURES.values())))


@dataclass
class Model:
    """Log chances: of states after states (the last row is the start), and of each feature code in each state."""

    step: np.ndarray
    emit: np.ndarray  # codes x states


def decode(codes: np.ndarray) -> dict[str, np.ndarray]:
    out = {}
    for name, size in FEATURES.items():
        out[name], codes = codes % size, codes // size
    return out


def in_order(rows: DataFrame, *kept: str) -> DataFrame:
    """``kept`` columns of rows (conv, turn, body, ...) in the documented order: ``at`` grows with it, ``task`` is the sorted range.

    Any number of tasks may share a conversation, so its rows never meet in one.
    """
    names = ["conv", "turn", "body", *[name for name in rows.columns if name not in ("conv", "turn", "body")]]
    order = [F.col(name).asc_nulls_first() for name in names]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return stage(dealt.select(*kept, F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("at")), "ordered")


def _in_task():
    return Window.partitionBy("conv", "task").orderBy("at")


def _over_tasks():
    return Window.partitionBy("conv").orderBy("task")


def _with_carried(rows: DataFrame, carried: DataFrame) -> DataFrame:
    """``rows`` with what ``carried`` (conv, task, carried) hands on from earlier tasks; null where there are none."""
    other = carried.where("carried IS NOT NULL").toDF("conv_of", "task_of", "carried")
    return rows.join(other, F.col("conv").eqNullSafe(F.col("conv_of")) & (F.col("task") == F.col("task_of")), "left").drop("conv_of", "task_of")


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (conv, turn, body) with ``first``: the number of their first line within the conversation."""
    ordered = in_order(rows, "conv", "turn", "body").withColumn("size", F.size(F.split("body", "\r?\n")).cast("bigint"))
    before = _over_tasks().rowsBetween(Window.unboundedPreceding, -1)
    sums = ordered.groupBy("conv", "task").agg(F.sum("size").alias("size")).select("conv", "task", F.sum("size").over(before).alias("carried"))
    inside = ordered.withColumn("first", F.sum("size").over(_in_task().rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    return _with_carried(inside, sums).select("conv", "turn", "body", (F.col("first") + F.coalesce("carried", F.lit(0))).alias("first"))


def transitions(rows: DataFrame) -> DataFrame:
    """Counts n of known roles after the role before them (before, role); before is null at the start of a conversation."""
    ordered = in_order(rows, "conv", "role")
    lasts = ordered.groupBy("conv", "task").agg(F.max(F.struct("at", "role")).alias("last"))
    lasts = lasts.select("conv", "task", F.lag("last").over(_over_tasks()).alias("carried"))
    inside = ordered.withColumn("held", F.lag(F.struct("at", "role")).over(_in_task()))
    after = _with_carried(inside, lasts).withColumn("held", F.coalesce("held", "carried"))
    # A role after an unknown one says nothing.
    told = after.where(F.col("role").isin(*ROLES) & (F.col("held").isNull() | F.col("held.role").isin(*ROLES)))
    return told.groupBy(F.col("held.role").alias("before"), "role").agg(F.count("*").alias("n"))


def train(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Model:
    """Counts of transitions and features over all rows with a known role. Only the counts reach the driver."""
    known = rows.where(F.col(role).isin(*ROLES)).select(conversation, turn, F.col(role).alias("role"), text).distinct()
    lines = lines_of(known, conversation, turn, text)
    counted = lines.groupBy("role", "opens", F.expr(CODE).alias("code")).count().collect()
    seen = {name: np.full((size, STATES), 0.5) for name, size in FEATURES.items()}
    for row in counted:
        # Inside a known row all lines go on, unless a marker of its own says otherwise.
        state = 2 * ROLES.index(row["role"]) + (0 if row["opens"] else 1)
        for name, value in decode(np.array([row["code"]])).items():
            seen[name][value[0], state] += row["count"]
    # Lines inside a row that carry a marker start turns; none need be in the training rows.
    for number in range(len(ROLES)):
        seen["marker"][number + 1, 2 * number] += 0.2 * seen["marker"][:, 2 * number].sum()
    emit = np.zeros((CODES, STATES))
    for name, values in decode(np.arange(CODES)).items():
        # A value that a state has never shown is as unlikely for rare states as for common ones.
        chances = 0.98 * seen[name] / seen[name].sum(axis=0, keepdims=True) + 0.02 / len(seen[name])
        if name == "marker":
            chances[1:, 1::2] = 1e-8  # a line with a speaker's name seldom goes on
        if name in ("place", "depth"):
            # A turn may start anywhere once a marker opens it, so these tell roles apart on first lines only.
            chances[0 if name == "place" else slice(1, None)] = 1.0
        if name == "weight":
            chances[5] = 1.0  # the size of a block speaks once, on its first line
        emit += np.log(chances)[values]
    single = rows.select(F.col(conversation).alias("conv"), F.col(turn).cast("bigint").alias("turn"), F.coalesce(text, F.lit("")).alias("body"), F.col(role).alias("role"))
    speak = np.full((len(ROLES) + 1, len(ROLES)), 0.5)
    for row in transitions(single.distinct()).collect():
        speak[ROLES.index(row["before"]) if row["before"] else len(ROLES), ROLES.index(row["role"])] += row["n"]
    speak /= speak.sum(axis=1, keepdims=True)
    step = np.full((STATES + 1, STATES), -np.inf)
    for state in range(STATES):
        for number in range(len(ROLES)):
            step[state, 2 * number] = np.log(0.02 * speak[state // 2, number])
        step[state, 2 * (state // 2) + 1] = np.log(0.98)
    step[STATES, ::2] = np.log(speak[len(ROLES)])
    return Model(step, emit)


def _scores(model: Model, opens: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Emission scores of lines; the first line of a row must start a turn, others start one only with a marker."""
    scores = model.emit[codes].copy()
    scores[opens == 1, 1::2] = -np.inf
    marked = decode(codes)["marker"] > 0
    scores[np.ix_((opens == 0) & ~marked, range(0, STATES, 2))] = -np.inf
    # A start at the head of a row is certain, so the chance of starting does not count there.
    scores[opens == 1] -= np.log(0.02)
    return scores


def chunk_matrix(model: Model, scores: np.ndarray) -> np.ndarray:
    """Best score from each state before the lines (or the start) to each state at their end."""
    best = np.full((STATES + 1, STATES), -np.inf)
    for state in range(STATES + 1):
        held = model.step[state] + scores[0]
        for row in scores[1:]:
            held = (held[:, None] + model.step[:STATES]).max(axis=0) + row
        best[state] = held
    return best


def viterbi(model: Model, scores: np.ndarray, first: int, last: int | None) -> np.ndarray:
    """Best states of lines that follow state ``first`` and, unless None, end in state ``last``."""
    held, back = model.step[first] + scores[0], []
    for row in scores[1:]:
        paths = held[:, None] + model.step[:STATES]
        back.append(paths.argmax(axis=0))
        held = paths.max(axis=0) + row
    states = [int(held.argmax()) if last is None else last]
    for choice in reversed(back):
        states.append(int(choice[states[-1]]))
    return np.array(states[::-1])


def product(matrices: list[np.ndarray]) -> np.ndarray:
    total = matrices[0]
    for matrix in matrices[1:]:
        total = (total[:, :, None] + matrix[None, :STATES, :]).max(axis=1)
    return total


def border_states(matrices: list[np.ndarray], first: int, last: int | None) -> list[int]:
    """Best states at the ends of the parts that the matrices stand for."""
    held, back = matrices[0][first], []
    for matrix in matrices[1:]:
        paths = held[:, None] + matrix[:STATES]
        back.append(paths.argmax(axis=0))
        held = paths.max(axis=0)
    states = [int(held.argmax()) if last is None else last]
    for choice in reversed(back):
        states.append(int(choice[states[-1]]))
    return states[::-1]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _matrix(value: bytes) -> np.ndarray:
    return np.frombuffer(value).reshape(STATES + 1, STATES)


def _in_batches(rows: Iterator[dict], schema: pa.Schema, size: int = 2_000) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


PLACED = pa.schema([("conv", pa.string()), ("part", pa.int64()), ("matrix", pa.binary())])
BORDERS = pa.schema([("conv", pa.string()), ("part", pa.int64()), ("before", pa.int32()), ("after", pa.int32())])


def _reduce(model: Model):
    def run(batches):
        def rows():
            for (conv, part), lines in groupby(_rows(batches), key=lambda row: (row["conv"], row["part"])):
                lines = list(lines)
                scores = _scores(model, np.array([row["opens"] for row in lines]), np.array([row["code"] for row in lines]))
                yield {"conv": conv, "part": part, "matrix": chunk_matrix(model, scores).tobytes()}

        yield from _in_batches(rows(), PLACED)

    return run


def _multiply(batches):
    def rows():
        for (conv, part), group in groupby(_rows(batches), key=lambda row: (row["conv"], row["up"])):
            yield {"conv": conv, "part": part, "matrix": product([_matrix(row["matrix"]) for row in group]).tobytes()}

    yield from _in_batches(rows(), PLACED)


def _descend(batches):
    """Border states of the parts of each group, given those of the group."""

    def rows():
        for _, group in groupby(_rows(batches), key=lambda row: (row["conv"], row["up"])):
            group = list(group)
            before, after = group[0]["before"], group[0]["after"]
            ends = border_states([_matrix(row["matrix"]) for row in group], before, after)
            for row, start, end in zip(group, [before, *ends[:-1]], ends, strict=True):
                yield {"conv": row["conv"], "part": row["part"], "before": start, "after": end}

    yield from _in_batches(rows(), BORDERS)


def _label(model: Model):
    schema = pa.schema(
        [("conv", pa.string()), ("turn", pa.int64()), ("first", pa.int64()), ("row_key", pa.int64()), ("line_no", pa.int32()), ("line", pa.string()), ("role", pa.string()), ("starts", pa.bool_())]
    )

    def run(batches):
        def rows():
            for _, lines in groupby(_rows(batches), key=lambda row: (row["conv"], row["part"])):
                lines = list(lines)
                scores = _scores(model, np.array([row["opens"] for row in lines]), np.array([row["code"] for row in lines]))
                for row, state in zip(lines, viterbi(model, scores, lines[0]["before"], lines[0]["after"]).tolist(), strict=True):
                    kept = {name: row[name] for name in ("conv", "turn", "first", "row_key", "line_no", "line")}
                    yield kept | {"role": ROLES[state // 2], "starts": state % 2 == 0}

        yield from _in_batches(rows(), schema)

    return run


def label_lines(rows: DataFrame, model: Model, conversation: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """Every line with its recovered role and whether it starts a turn."""
    single = rows.select(F.col(conversation).cast("string").alias("conv"), F.col(turn).cast("bigint").alias("turn"), text).distinct()
    lines = lines_of(numbered(single.select("conv", "turn", F.coalesce(text, F.lit("")).alias("body"))), "conv", "turn", "body")
    number = F.col("first") + F.col("line_no")
    part = F.floor(number / CHUNK).cast("bigint")
    lines = stage(lines.select("conv", "turn", "first", "row_key", "line_no", "line", "opens", F.expr(CODE).alias("code"), part.alias("part"), number.alias("number")), "lines")
    dealt = lines.select("conv", "part", "number", "opens", "code")
    order = ["conv", "part", "number"]
    sorted_ = dealt.repartition("conv", "part").sortWithinPartitions(*order).select("conv", "part", "opens", "code")
    levels = [stage(sorted_.mapInArrow(_reduce(model), "conv string, part bigint, matrix binary"), "level")]
    up = F.floor(F.col("part") / GROUP).cast("bigint")
    while levels[-1].groupBy("conv").count().where("count > 1").limit(1).count():
        group = levels[-1].withColumn("up", up).repartition("conv", "up").sortWithinPartitions("conv", "up", "part")
        levels.append(stage(group.mapInArrow(_multiply, "conv string, part bigint, matrix binary"), "level"))
    borders = levels[-1].select("conv", "part", F.lit(STATES).alias("before"), F.lit(None).cast("int").alias("after"))
    for level in reversed(levels[:-1]):
        above = borders.select(F.col("conv").alias("conv_up"), F.col("part").alias("up"), "before", "after")
        joined = level.withColumn("up", up).join(above.withColumnRenamed("up", "part_up"), F.col("conv").eqNullSafe(F.col("conv_up")) & (F.col("up") == F.col("part_up")))
        joined = joined.repartition("conv", "up").sortWithinPartitions("conv", "up", "part").drop("conv_up", "part_up")
        borders = stage(joined.mapInArrow(_descend, "conv string, part bigint, before int, after int"), "borders")
    found = lines.join(
        borders.toDF("conv_up", "part_up", "before", "after"),
        F.col("conv").eqNullSafe(F.col("conv_up")) & (F.col("part") == F.col("part_up")),
    ).drop("conv_up", "part_up")
    found = found.repartition("conv", "part").sortWithinPartitions(*order)
    return found.mapInArrow(_label(model), "conv string, turn bigint, first bigint, row_key bigint, line_no int, line string, role string, starts boolean")


def render(role: Column, lines: Column) -> Column:
    """Canonical form of a turn: role tag, text without speaker marker and outer blanks, end tag."""
    first = F.regexp_replace(F.element_at(lines, 1), ANY_SPEAKER, "")
    text = F.trim(F.array_join(F.concat(F.array(first), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))), "\n"))
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), F.regexp_replace(text, r"\n{3,}", "\n\n"), F.lit("\n<|end|>"))


def turns(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", text: str = "text", role: str = "role") -> DataFrame:
    """Recovered turns: conversation, turn, row_key (hash of the row's text), part, role, n_lines, rendered."""
    labelled = label_lines(rows, train(rows, conversation, turn, role, text), conversation, turn, text)
    inside = Window.partitionBy("conv", "first").orderBy("line_no")
    numbered = labelled.withColumn("part", F.sum(F.col("starts").cast("int")).over(inside) - 1)
    kind = dict(rows.dtypes)[conversation]
    return (
        numbered.groupBy("conv", "turn", "first", "row_key", "part", "role")
        .agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("lines"))
        .select(
            F.col("conv").cast(kind).alias(conversation),
            F.col("turn").alias(turn),
            "row_key",
            F.col("part").cast("int").alias("part"),
            "role",
            F.size("lines").alias("n_lines"),
            render(F.col("role"), F.col("lines.line")).alias("rendered"),
        )
    )
