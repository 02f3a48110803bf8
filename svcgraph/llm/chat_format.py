"""Operator 1: chat formatting; roles of transcript lines by a hidden Markov model and Viterbi.

A transcript is the rows of one conversation in order of turn; a row's text is read line by line. Hidden
states are the roles, each as a turn's first line or a further line. A line is seen through
its features: a speaker marker (a prefix such as "User:", or the row's marker column on its
first line), whether it starts a row, is blank, asks, or is long. The most probable state path decides
where turns begin and whose they are; markers are stripped and each turn is rendered as
    <|role|>\\n<text>\\n<|end|>

The model is counted over all rows whose marker names a role: transitions between roles of following turns and
feature frequencies (both few numbers), with fixed noise for markers, so that a wrong or missing
marker can be outvoted.

Conversations may be of any length, so Viterbi runs in three passes of (max, +) products: every row
becomes a small matrix; sorted rows are packed into blocks; a conversation's parts in several
blocks are joined through one matrix for each part; then each block, and each row, is traced
back between its known borders. No task holds a conversation's texts.

Defined results: a null or empty text is one blank line and gives an empty turn; a null conversation id
is an id like others; null turns come first; equal (conv_id, turn) rows are ordered by text and keep a row
each; an unknown or null marker carries no information; an empty table gives no row; columns
beyond the named four are ignored. Turns lose white space at their ends, and "<|" in them becomes "< |", so that no text can pose as
a marker of the rendering. Very long texts are read whole, line by line. Ties between paths go to the state first in order.
"""

from __future__ import annotations

import json
import math
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, map_rows, materialize, text_of

ROLES = ["assistant", "system", "user"]
#: Speaker names and the roles they stand for.
SPEAKERS = {"assistant": "assistant", "ai": "assistant", "bot": "assistant", "gpt": "assistant", "model": "assistant", "answer": "assistant", "response": "assistant", "system": "system", "instruction": "system", "instructions": "system", "developer": "system", "user": "user", "human": "user", "customer": "user", "prompt": "user", "question": "user", "q": "user", "a": "assistant"}
MARKER = r"[\s>#*\[(<|]*(" + "|".join(sorted(SPEAKERS, key=len, reverse=True)) + r")[\])>|*]*\s*[:>]\s*[*]*\s*"
NOISE = 0.05
BLOCK_ROWS = 2048
STATES = 2 * len(ROLES)  # first line of a role's turn, then further lines
START = STATES  # before a conversation's first line
TURNS = "conv_id long, turn long, part int, role string, n_lines int, content string, rendered string"


def marker_role(name: str | None) -> str | None:
    return SPEAKERS.get(text_of(name).strip().lower())


def line_features(text: str | None, marker: str | None) -> tuple[list[tuple], list[str]]:
    """For each line (marker's role or None, starts the row, blank, asks, long), and the lines without markers."""
    found, contents = [], []
    for k, line in enumerate(text_of(text).split("\n")):
        m = re.match(MARKER, line, re.IGNORECASE)
        role = SPEAKERS[m[1].lower()] if m else marker_role(marker) if not k else None
        rest = line[m.end() :] if m else line
        found.append((role, not k, not rest.strip(), rest.rstrip().endswith("?"), len(rest) > 400))
        contents.append(rest)
    return found, contents


class TurnModel:
    """Log-probabilities; rows[i][j] of a matrix: from state i before to state j at its end."""

    def __init__(self, following: dict[tuple[str, str], int], first: dict[str, int], shapes: dict[tuple[str, bool, bool], int]) -> None:
        n = len(ROLES)
        step = np.full((n + 1, n), 1.0)
        for i, a in enumerate(ROLES):
            step[n, i] += first.get(a, 0)
            for j, b in enumerate(ROLES):
                step[i, j] += following.get((a, b), 0)
        step /= step.sum(1, keepdims=True)
        go_on = 0.5  # a further line of the same turn; the row-start feature says the rest
        self.transition = np.full((STATES + 1, STATES), -math.inf)
        for i in range(n):
            for kind in (0, n):
                self.transition[i + kind, :n] = np.log((1 - go_on) * step[i])
                self.transition[i + kind, n + i] = math.log(go_on)
        self.transition[START, :n] = np.log(step[n])
        self.shape = {}
        for i, role in enumerate(ROLES):
            cells = {(q, l): shapes.get((role, q, l), 0) + 1.0 for q in (False, True) for l in (False, True)}
            total = sum(cells.values())
            self.shape[i] = {k: math.log(v / total) for k, v in cells.items()}
        self.matrix = lru_cache(200_000)(self._matrix)
        self.step = lru_cache(10_000)(self._step)

    def _step(self, seen: tuple) -> np.ndarray:
        role, starts, blank, asks, long = seen
        emit = np.zeros(STATES)
        for i, own in enumerate(ROLES):
            for further in (0, 1):
                p = math.log(0.98 if starts != bool(further) else 0.02)
                if role is not None:  # a marker opens a turn, as a rule its own role's
                    p += math.log(0.9 if not further else 0.1) + math.log(1 - NOISE if role == own else NOISE / (len(ROLES) - 1))
                if not further and not blank:
                    p += self.shape[i][asks, long]
                emit[i + further * len(ROLES)] = p
        return self.transition + emit

    def _matrix(self, seen: tuple[tuple, ...]) -> np.ndarray:
        total = self.step(seen[0])
        for x in seen[1:]:
            total = product(total, self.step(x))
        return total

    def trace(self, seen: list[tuple], before: int, last: int) -> list[int]:
        """The best states of a row's lines between the state before it and its last line's."""
        scores, backs = [self.step(seen[0])[before]], []
        for x in seen[1:]:
            through = scores[-1][:, None] + self.step(x)[:STATES]
            backs.append(through.argmax(0))
            scores.append(through.max(0))
        path = [last]
        for back in reversed(backs):
            path.append(int(back[path[-1]]))
        return path[::-1]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(max, +) product of matrices whose first has a row more: (STATES + 1) x STATES."""
    return (a[:, :, None] + b[None, :STATES, :]).max(1)


def best_borders(matrices: list[np.ndarray], before: int | None = None, last: int | None = None) -> list[tuple[int, int]]:
    """For parts in order the (state before, state at the end) of the best path; before and last fix its ends."""
    scores, backs = [matrices[0][START if before is None else before]], []
    for m in matrices[1:]:
        through = scores[-1][:, None] + m[:STATES]
        backs.append(through.argmax(0))
        scores.append(through.max(0))
    ends = [int(scores[-1].argmax()) if last is None else last]
    for back in reversed(backs):
        ends.append(int(back[ends[-1]]))
    ends.reverse()
    return list(zip([START if before is None else before, *ends[:-1]], ends, strict=True))


def learn(turns: DataFrame) -> tuple:
    """TurnModel's arguments: counts over all rows (conv_id, turn, role, text) with a known role; all three tables are a few rows."""
    names = F.create_map(*[F.lit(x) for pair in SPEAKERS.items() for x in pair])
    known = turns.select("conv_id", "turn", F.element_at(names, F.lower(F.trim("role"))).alias("role"), "text").where("role IS NOT NULL")
    shapes = {(r["role"], r["q"], r["l"]): r["n"] for r in known.groupBy("role", F.coalesce(F.rtrim("text").endswith("?"), F.lit(False)).alias("q"), F.coalesce(F.length("text") > 400, F.lit(False)).alias("l")).agg(F.count("*").alias("n")).collect()}
    # One role for each place, so that repeated rows don't multiply in the join.
    places = known.where("conv_id IS NOT NULL AND turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    after = places.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("next"))
    following = {(r["role"], r["next"]): r["n"] for r in places.join(after, ["conv_id", "turn"]).groupBy("role", "next").agg(F.count("*").alias("n")).collect()}
    first = {r["role"]: r["n"] for r in places.where("turn = 0").groupBy("role").agg(F.count("*").alias("n")).collect()}
    return following, first, shapes


def _blocks(rows: DataFrame, model_args: tuple) -> DataFrame:
    """Rows in order of (conv_id, turn, uid), packed: uids, conversations and row matrices of a block."""
    import pyarrow as pa

    matrices = map_rows(rows.select("uid", "conv_id", "turn", "role", "text"), lambda: _matrix_fn(model_args), "uid long, conv_id long, turn long, matrix binary")
    schema = "block long, uids binary, convs string, matrices binary"

    def run(batches):
        from pyspark import TaskContext

        out, part, seq, gathered = arrow_schema(schema), TaskContext.get().partitionId(), 0, []

        def give(rows_: list) -> pa.RecordBatch:
            row = (part << 32 | seq, np.array([r[0] for r in rows_], "i8").tobytes(), json.dumps([r[1] for r in rows_]), b"".join([r[3] for r in rows_]))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, out.types, strict=True)], schema=out)

        for b in batches:
            gathered += zip(*(c.to_pylist() for c in b.columns), strict=True)
            while len(gathered) >= BLOCK_ROWS:
                yield give(gathered[:BLOCK_ROWS])
                gathered, seq = gathered[BLOCK_ROWS:], seq + 1
        if gathered:
            yield give(gathered)

    return matrices.repartitionByRange("conv_id", "turn", "uid").sortWithinPartitions("conv_id", "turn", "uid").mapInArrow(run, schema)


def _matrix_fn(model_args: tuple):
    model = TurnModel(*model_args)
    return lambda uids, convs, turns, roles, texts: (uids, convs, turns, [model.matrix(tuple(line_features(t, r)[0])).tobytes() for t, r in zip(texts, roles, strict=True)])


def _runs(convs: list, matrices: bytes) -> list[tuple[object, int, int, list[np.ndarray]]]:
    """A block's runs of one conversation: (conv_id, first row, after its last row, row matrices)."""
    m = np.frombuffer(matrices, "f8").reshape(len(convs), STATES + 1, STATES)
    out, a = [], 0
    for b in range(1, len(convs) + 1):
        if b == len(convs) or convs[b] != convs[a]:
            out.append((convs[a], a, b, list(m[a:b])))
            a = b
    return out


def format_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", marker_col: str = "role", text_col: str = "text") -> DataFrame:
    """TURNS: one row for each recovered turn; part numbers the turns found within a row."""
    import pyarrow as pa

    plain = conversations.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(marker_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    args = learn(plain)
    rows = materialize(plain.withColumn("uid", F.monotonically_increasing_id()), "transcripts")
    blocks = materialize(_blocks(rows, args), "blocks")

    def ends(block, convs, matrices):
        """The first and last run of each block: only these can go on elsewhere."""
        out = ([], [], [])
        for b, c, m in zip(block, convs, matrices, strict=True):
            runs = _runs(json.loads(c), m)
            for k in sorted({0, len(runs) - 1}):
                total = runs[k][3][0]
                for x in runs[k][3][1:]:
                    total = product(total, x)
                for column, value in zip(out, (json.dumps(runs[k][0]), b, total.tobytes()), strict=True):
                    column.append(value)
        return out

    parts = map_rows(blocks.select("block", "convs", "matrices"), lambda: ends, "conv string, block long, matrix binary")

    def join_parts(table: pa.Table) -> pa.Table:
        out = arrow_schema("conv string, block long, before int, last int")
        found = sorted(zip(table.column("block").to_pylist(), table.column("conv").to_pylist(), table.column("matrix").to_pylist(), strict=True), key=lambda x: x[0])
        borders = best_borders([np.frombuffer(x[2], "f8").reshape(STATES + 1, STATES) for x in found])
        cols = ([x[1] for x in found], [x[0] for x in found], [x[0] for x in borders], [x[1] for x in borders])
        return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(cols, out.types, strict=True)], schema=out)

    borders = parts.groupBy("conv").applyInArrow(join_parts, "conv string, block long, before int, last int")
    known = borders.groupBy("block").agg(F.to_json(F.collect_list(F.struct("conv", "before", "last"))).alias("known"))  # two a block at most

    def trace(convs, uids, matrices, fixed):
        out = ([], [], [])
        for c, u, m, k in zip(convs, uids, matrices, fixed, strict=True):
            at = {x["conv"]: (x["before"], x["last"]) for x in json.loads(k or "[]")}
            ids = np.frombuffer(u, "i8").tolist()
            for conv, a, b, own in _runs(json.loads(c), m):
                for i, (before, last) in zip(ids[a:b], best_borders(own, *at.get(json.dumps(conv), (None, None))), strict=True):
                    for column, value in zip(out, (i, before, last), strict=True):
                        column.append(value)
        return out

    states = map_rows(blocks.join(known, "block", "left").select("convs", "uids", "matrices", "known"), lambda: trace, "uid long, before int, last int")
    decoded = rows.join(states, "uid").select("conv_id", "turn", "role", "text", "before", "last")

    def make():
        own = TurnModel(*args)

        def fn(convs, turns, roles, texts, befores, lasts):
            out = ([], [], [], [], [], [], [])
            for conv, turn, marker, text, before, last in zip(convs, turns, roles, texts, befores, lasts, strict=True):
                seen, contents = line_features(text, marker)
                found: list[tuple[int, list[str]]] = []
                for state, line in zip(own.trace(seen, before, last), contents, strict=True):
                    if state < len(ROLES) or not found:
                        found.append((state % len(ROLES), []))
                    found[-1][1].append(line)
                for part, (role, lines) in enumerate(found):
                    content = "\n".join(lines).strip().replace("<|", "< |")
                    for column, value in zip(out, (conv, turn, part, ROLES[role], len(lines), content, f"<|{ROLES[role]}|>\n{content}\n<|end|>"), strict=True):
                        column.append(value)
            return out

        return fn

    return map_rows(decoded, make, TURNS)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
