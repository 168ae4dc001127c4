"""Roles of transcript lines by a hidden Markov model, and canonical rendering of the turns.

A transcript is a conversation's rows in order; a row has a speaker label (which may be missing or unclear) and a
text of one or more lines, in which, where the label is missing or unknown, speaker markers can stand (``User: ...``,
``### Assistant``, ``<|system|>``, ``Q: ...``). The text of a row with a known label is kept whole: nothing in it
counts as a marker. The hidden states are the roles, each as the first line of a turn or a further line of
it. A line shows its marker (the row's label on the row's first line, or what stands before its text), whether a row
begins with it, its length class, whether it ends with a question mark, and whether it looks like a list or code.
How lines of a role look and how roles follow each other is counted over the whole table, with smoothing; how far
markers are to be trusted is fixed. Viterbi gives the most probable states; each turn is rendered as
``<|role|>`` and its lines, markers removed, and ``<|end|>``; ``parsed`` reads turns back.

Conversations of any length are decoded in parallel: rows are range-partitioned in their order and numbered, each
partition is cut into pieces of ``PIECE_ROWS`` rows, and of a conversation that spans several pieces each gives its
best score from every entering to every leaving state; these are chained to fix the states between pieces, and each is
then decoded on its own, with the same result as in one. A task holds the lines of one piece at a time, and of one
conversation 512 bytes for each of its pieces.

A null or empty text is one empty line. Rows with equal keys follow each other in the order of label and text; rows
without a conversation id are one conversation. An unknown label counts as no marker. Repeated rows are turns of
their own. An empty table gives no turns. Columns other than those named are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardledger.llm.batches import key_groups
from wardledger.session import Workspace

ROLES = ("system", "user", "assistant", "tool")
STATES = 2 * len(ROLES)  # role * 2 + (0 first line of a turn, 1 further line)
#: Labels and markers, lower-cased, by role.
NAMES = {
    "system": 0, "instruction": 0, "instructions": 0, "context": 0,
    "user": 1, "human": 1, "q": 1, "question": 1, "customer": 1, "prompter": 1,
    "assistant": 2, "ai": 2, "bot": 2, "a": 2, "answer": 2, "model": 2, "gpt": 2, "agent": 2,
    "tool": 3, "function": 3, "observation": 3,
}
_WORDS = "|".join(sorted(NAMES, key=len, reverse=True))
_MARKER = re.compile(rf"\s*(?:<\|({_WORDS})\|>\s*|#{{1,4}}\s*({_WORDS})\s*:?\s*$|[*\[]{{0,2}}({_WORDS})[*\]]{{0,2}}\s*[:>][*\]]{{0,2}}\s*)", re.I)
_LIST = re.compile(r"\s*(?:[-*+]\s|\d+[.)]\s|```|\||[{}])")
LENGTHS = (1, 40, 120, 400)
LOOKS = (len(LENGTHS) + 1) * 4
NO_MARKER = len(ROLES)
#: Rows that are decoded at once, at most.
PIECE_ROWS = 4096
_TRUST, _STRAY, _UNMARKED = 0.97, 1e-4, 0.02


class Line(NamedTuple):
    text: str
    marker: int  # a role or NO_MARKER
    opens_row: bool
    look: int


class Chances(NamedTuple):
    """Natural logarithms: of the first role, of the next turn's role by role, of a line's look by role."""

    first: np.ndarray
    following: np.ndarray
    look: np.ndarray


def row_lines(label: str | None, text: str | None) -> list[Line]:
    """The lines of a row. What stands before the lines of a row without a known label is their marker, which is taken
    off; where the label is known, it is the marker of the first line, and the text stays as it is."""
    lines = []
    role = NAMES.get((label or "").strip().lower(), NO_MARKER)
    for k, line in enumerate((text or "").split("\n")):
        found = _MARKER.match(line) if role == NO_MARKER else None
        marker = NO_MARKER
        if found:
            marker = NAMES[next(g for g in found.groups() if g).lower()]
            line = line[found.end() :]
        elif k == 0:
            marker = role
        length = sum(len(line) >= n for n in LENGTHS)
        look = length * 4 + 2 * line.rstrip().endswith("?") + bool(_LIST.match(line))
        lines.append(Line(line, marker, k == 0, look))
    return lines


def emissions(lines: list[Line], chances: Chances) -> np.ndarray:
    """log P(line | state), a row for each line."""
    marker = np.array([x.marker for x in lines])
    opens = np.array([x.opens_row for x in lines])
    looks = chances.look[:, np.array([x.look for x in lines])].T
    out = np.repeat(looks, 2, axis=1)
    begin = np.full((len(lines), len(ROLES)), (1 - _TRUST) / len(ROLES))
    begin[marker == NO_MARKER] = _UNMARKED
    known = np.flatnonzero(marker != NO_MARKER)
    begin[known, marker[known]] = _TRUST
    out[:, 0::2] += np.log(begin)
    out[:, 1::2] += np.log(np.where(marker == NO_MARKER, 1 - _UNMARKED, _STRAY))[:, None]
    out[opens, 1::2] = -np.inf  # a row begins a turn
    return out


def transitions(chances: Chances) -> np.ndarray:
    """log P(state | state before): a turn goes on with the same role or a new one begins."""
    out = np.full((STATES, STATES), -np.inf)
    for role in range(len(ROLES)):
        for place in (0, 1):
            out[2 * role + place, 2 * role + 1] = 0.0
            out[2 * role + place, 0::2] = chances.following[role]
    return out


def start_scores(chances: Chances) -> np.ndarray:
    out = np.full(STATES, -np.inf)
    out[0::2] = chances.first
    return out


def viterbi(emitted: np.ndarray, moves: np.ndarray, start: np.ndarray, last: int | None = None) -> tuple[list[int], float]:
    """The best states of a sequence whose first scores are ``start``, ending in ``last`` where that is given."""
    score = start + emitted[0]
    back = np.zeros((len(emitted), STATES), np.int8)
    for i in range(1, len(emitted)):
        ways = score[:, None] + moves
        back[i] = ways.argmax(axis=0)
        score = ways.max(axis=0) + emitted[i]
    state = int(score.argmax()) if last is None else last
    best, path = float(score[state]), [state]
    for i in range(len(emitted) - 1, 0, -1):
        state = int(back[i, state])
        path.append(state)
    return path[::-1], best


def passage(emitted: np.ndarray, moves: np.ndarray, start: np.ndarray | None) -> np.ndarray:
    """Best scores from every state before a part (rows) to every state at its end (columns).

    With ``start``, for the first part, all rows are equal.
    """
    score = (moves if start is None else np.repeat(start[None], STATES, axis=0)) + emitted[0]
    for row in emitted[1:]:
        score = (score[:, :, None] + moves[None]).max(axis=1) + row
    return score


def chain(parts: list[np.ndarray]) -> list[tuple[int, int]]:
    """The states before and at the end of each part on the best path; before the first it is -1."""
    score, back = parts[0][0], []
    for part in parts[1:]:
        ways = score[:, None] + part
        back.append(ways.argmax(axis=0))
        score = ways.max(axis=0)
    ends = [int(score.argmax())]
    for b in reversed(back):
        ends.append(int(b[ends[-1]]))
    ends.reverse()
    return list(zip([-1, *ends[:-1]], ends, strict=True))


def turns_of(rows: list[list[Line]], states: list[int]) -> list[list[tuple[str, str]]]:
    """For each row its turns: role and text."""
    out, at = [], 0
    for lines in rows:
        turns: list[tuple[str, list[str]]] = []
        for line in lines:
            if states[at] % 2 == 0 or not turns:
                turns.append((ROLES[states[at] // 2], []))
            turns[-1][1].append(line.text)
            at += 1
        out.append([(role, "\n".join(texts)) for role, texts in turns])
    return out


_CONTROL = re.compile(rf"<(\\*)\|(?=(?:{'|'.join(ROLES)}|end)\|>)")


def rendered(role: str, text: str) -> str:
    """The turn between its control tokens; those that the text itself holds get a backslash after their first sign."""
    return f"<|{role}|>\n{_CONTROL.sub(lambda m: f'<{m[1]}{chr(92)}|', text)}\n<|end|>\n"


def parsed(rendering: str) -> list[tuple[str, str]]:
    """The turns (role, text) of what ``rendered`` has written, one after the other."""
    turns = re.findall(rf"<\|({'|'.join(ROLES)})\|>\n(.*?)\n<\|end\|>\n", rendering, re.S)
    return [(role, _CONTROL.sub(lambda m: f"<{m[1][1:]}|", text)) for role, text in turns]


def learn_chances(rows: DataFrame) -> Chances:
    """Counts over all rows (``part``, ``seq``, ``conv``, ``label``, ``text``) with one of smoothing."""

    def looks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.zeros((len(ROLES), LOOKS), np.int64)
            for label, text in zip(*(batch.column(c).to_pylist() for c in ("label", "text")), strict=True):
                role = NAMES.get((label or "").strip().lower())
                if role is not None:
                    for line in row_lines(label, text):
                        counts[role, line.look] += 1
            role, look = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(role), pa.array(look), pa.array(counts[role, look])], ["role", "look", "n"])

    look = np.ones((len(ROLES), LOOKS))
    counted = rows.select("label", "text").mapInArrow(looks, "role long, look long, n long").groupBy("role", "look")
    for r in counted.agg(F.sum("n").alias("n")).collect():
        look[r["role"], r["look"]] += r["n"]

    names = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
    role = F.try_element_at(names, F.lower(F.trim(F.coalesce("label", F.lit("")))))
    known = rows.select("part", "seq", "conv", role.alias("role"))
    # The row before in the same part, or the last one of the part before: one row a part.
    before = known.select("part", (F.col("seq") + 1).alias("seq"), F.col("conv").alias("conv_before"), F.col("role").alias("role_before"))
    last = known.groupBy("part").agg(F.max(F.struct("seq", "conv", "role")).alias("x")).orderBy("part").collect()
    parts = [r["part"] for r in last]
    heads = [(p, 0, r["x"]["conv"], r["x"]["role"]) for p, r in zip(parts[1:], last, strict=False)]
    if heads:
        before = before.unionByName(rows.sparkSession.createDataFrame(heads, before.schema))
    pairs = known.join(before, ["part", "seq"], "left")
    same = F.col("conv").eqNullSafe(F.col("conv_before")) & (F.col("role_before").isNotNull() | F.col("conv_before").isNotNull())
    first, following = np.ones(len(ROLES)), np.ones((len(ROLES), len(ROLES)))
    counted = pairs.filter("role is not null").groupBy("role", F.when(same, F.coalesce("role_before", F.lit(-1))).alias("before"))
    for r in counted.count().collect():
        if r["before"] is None:
            first[r["role"]] += r["count"]
        elif r["before"] >= 0:
            following[r["before"], r["role"]] += r["count"]
    share = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
    return Chances(share(first), share(following), share(look))


def ordered_rows(rows: DataFrame, partitions: int) -> DataFrame:
    """``conv``, ``turn``, ``label``, ``text`` in order, with the ``part`` of the order, the place ``seq`` in it, and the
    ``piece`` of at most ``PIECE_ROWS`` rows, which rises in the order of all rows."""
    size = PIECE_ROWS

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            seq = np.arange(at, at + n)
            columns = [pa.array([part] * n, pa.int32()), pa.array(seq), pa.array((part << 40) + seq // size), *batch.columns]
            yield pa.RecordBatch.from_arrays(columns, ["part", "seq", "piece", *batch.schema.names])
            at += n

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    order = ["conv", "turn", "label", "text"]
    in_order = rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    return in_order.mapInArrow(number, f"part int, seq long, piece long, {fields}")


def recover_turns(
    rows: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    label: str = "role",
    text: str = "text",
    partitions: int | None = None,
) -> DataFrame:
    """One row per recovered turn: conversation, ``turn`` (of its row), ``part`` (within the row, from 0), ``role``,
    ``text`` and ``rendered``."""
    spark = rows.sparkSession
    space = Workspace(spark)
    named = rows.select(
        F.col(conversation).alias("conv"), F.col(turn).alias("turn"), F.col(label).cast("string").alias("label"), F.col(text).alias("text")
    )
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = space.keep(ordered_rows(named, partitions), "ordered")
    chances = learn_chances(ordered)
    moves, start = transitions(chances), start_scores(chances)

    spanning = ordered.groupBy("conv").agg(F.min("piece").alias("a"), F.max("piece").alias("b")).filter("a < b")
    spanning = spanning.select("conv", F.col("a").alias("first_piece"))
    conv_kind = named.schema["conv"].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in key_groups(batches, ("conv", "piece")):
            labels, texts = (group.column(c).to_pylist() for c in ("label", "text"))
            lines = [x for pair in zip(labels, texts, strict=True) for x in row_lines(*pair)]
            first = group.column("piece")[0].as_py() == group.column("first_piece")[0].as_py()
            matrix = passage(emissions(lines, chances), moves, start if first else None)
            columns = [group.column("conv").slice(0, 1), group.column("piece").slice(0, 1), pa.array([matrix.tobytes()])]
            yield pa.table(columns, ["conv", "piece", "matrix"]).combine_chunks().to_batches()[0]

    def join_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in key_groups(batches, ("conv",)):
            matrices = [np.frombuffer(m).reshape(STATES, STATES) for m in group.column("matrix").to_pylist()]
            states = chain(matrices)
            columns = [group.column("conv"), group.column("piece"), *(pa.array([s[i] for s in states], pa.int32()) for i in (0, 1))]
            yield pa.table(columns, ["conv", "piece", "before", "last"]).combine_chunks().to_batches()[0]

    same_conv = ordered["conv"].eqNullSafe(spanning["conv"])
    pieces = ordered.join(spanning, same_conv).select(ordered["*"], "first_piece")
    pieces = pieces.repartition("conv", "piece").sortWithinPartitions("conv", "piece", "seq")
    matrices = pieces.mapInArrow(measure, f"conv {conv_kind}, piece long, matrix binary")
    matrices = matrices.repartition("conv").sortWithinPartitions("conv", "piece")
    fixed = space.keep(matrices.mapInArrow(join_parts, f"conv {conv_kind}, piece long, before int, last int"), "fixed")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in key_groups(batches, ("conv", "piece")):
            labels, texts = (group.column(c).to_pylist() for c in ("label", "text"))
            lines = [row_lines(*pair) for pair in zip(labels, texts, strict=True)]
            before, last = (group.column(c)[0].as_py() for c in ("before", "last"))
            entering = start if before is None or before < 0 else moves[before]
            states, _ = viterbi(emissions([x for row in lines for x in row], chances), moves, entering, last)
            found = turns_of(lines, states)
            row = pa.array([i for i, turns in enumerate(found) for _ in turns], pa.int64())
            role, said = ([t[k] for turns in found for t in turns] for k in (0, 1))
            columns = [
                group.column("conv").take(row),
                group.column("turn").take(row),
                pa.array([k for turns in found for k in range(len(turns))], pa.int32()),
                pa.array(role, pa.string()),
                pa.array(said, pa.string()),
                pa.array([rendered(*pair) for pair in zip(role, said, strict=True)], pa.string()),
            ]
            yield pa.table(columns, ["conv", "turn", "part", "role", "text", "rendered"]).combine_chunks().to_batches()[0]

    f = fixed.select(F.col("conv").alias("fixed_conv"), F.col("piece").alias("fixed_piece"), "before", "last")
    both = ordered["conv"].eqNullSafe(f["fixed_conv"]) & (ordered["piece"] == f["fixed_piece"])
    segments = ordered.join(f, both, "left").select(ordered["*"], "before", "last")
    segments = segments.repartition("conv", "piece").sortWithinPartitions("conv", "piece", "seq")
    turn_kind = named.schema["turn"].dataType.simpleString()
    out = segments.mapInArrow(decode, f"conv {conv_kind}, turn {turn_kind}, part int, role string, text string, rendered string")
    return out.withColumnsRenamed({"conv": conversation, "turn": turn})


def transcript_report(conversations: DataFrame) -> DataFrame:
    return recover_turns(conversations).select("conv_id", "turn", "part", "role", "rendered")
