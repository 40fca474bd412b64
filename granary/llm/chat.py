"""Transcript parsing by a hidden Markov model, and canonical rendering.

A transcript is lines in order.  The hidden states are a role and whether a line begins its turn; a line shows its speaker marker, whether a
blank line stands before it, its length, a question mark, and whether it is the transcript's first.  Start, move and emission tables are
smoothed counts over the labelled lines of all transcripts that the caller fits on.  Viterbi decodes the states.

A transcript may be longer than a task can hold.  All lines are put in order by a range partitioning, so that a long one lies in several tasks,
and cut into blocks of at most ``LINES`` lines or about ``BYTES`` bytes; prefix sums over the tasks number a transcript's blocks and lines.
Each block becomes the max-plus matrix of its best scores from state to state, blocks are composed ``FAN`` at a time into a tree, and the best
states at the blocks' borders flow down the tree again; the result is that of one scan over the whole transcript.  A turn that crosses a
block's border is rendered in pieces, of which the later ones say that they continue.

Turn numbers only order the turns: they may be negative, begin anywhere and have gaps.  Null and empty texts are turns of one line, the marker
alone.  Turns with a null conversation or turn number or an unknown role are left out; repeated rows of one turn count once (its smallest
text).  Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import stash

ROLES = ("user", "assistant", "system")
STATES = len(ROLES) * 2  # role * 2 + (0: begins the turn, 1: inside)
FAN = 256
LINES, BYTES = 512, 1 << 20  # of a block

#: Speaker markers of common transcript styles, by role (fixed values).
MARKERS = {"user": ("user", "human", "q", "customer", "you", "me"), "assistant": ("assistant", "ai", "a", "bot", "agent", "model"), "system": ("system", "system note", "instructions")}
#: How the query's raw transcripts write their speakers; the last style has blank lines between turns and no markers.
STYLES = (("User: ", "Assistant: ", "System: "), ("**Human:** ", "**AI:** ", "**System note:** "), ("Q: ", "A: ", "System: "), ("<|user|> ", "<|assistant|> ", "<|system|> "), ("", "", ""))
LENGTHS = (20, 80, 200, 500)
OBSERVATIONS = (len(ROLES) + 2) * 2 * (len(LENGTHS) + 1) * 2 * 2
_MARKER = r"(?i)^\s*(?:\*\*|<\|?|\[|#+\s*)?(NAMES)(?:\|?>|\]|\s*:)"


class Model(NamedTuple):
    """Log-probabilities: start by state, moves between states, observations by state."""

    start: np.ndarray
    moves: np.ndarray
    shows: np.ndarray


def marker(line: Column) -> Column:
    """0 without a marker, 1.. for a role's, and one more for another name before a colon."""
    out = F.when(line.rlike(r"^\s*[A-Za-z][\w ]{0,20}:(\s|$)"), F.lit(len(ROLES) + 1)).otherwise(F.lit(0))
    for k, role in enumerate(ROLES):
        out = F.when(line.rlike(_MARKER.replace("NAMES", "|".join(MARKERS[role]))), F.lit(k + 1)).otherwise(out)
    return out


def observation(line: Column, blank_before: Column, first: Column) -> Column:
    """The line's features as one number."""
    size = sum((F.when(F.length(line) > n, 1).otherwise(0) for n in LENGTHS), F.lit(0))
    code = marker(line)
    for part, n in ((blank_before.cast("int"), 2), (size, len(LENGTHS) + 1), (F.when(F.instr(line, "?") > 0, 1).otherwise(0), 2), (first.cast("int"), 2)):
        code = code * n + part
    return code.cast("int")


def raw_lines(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv, turn, k, line, blank_before, state``: labelled turns written as raw transcripts in a style that depends on the conversation.

    Lines that are empty are dropped and mark the next one; ``state`` is the true one.  Repeated rows count once; different texts under one turn
    number all stay, in order of text and role.
    """
    known = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = known.where(F.col("conv").isNotNull() & F.col("turn").isNotNull() & F.col("role").isin(*ROLES)).select("conv", "turn", F.col("role").alias("speaker"), "text").distinct()
    known = known.withColumn("other", F.row_number().over(Window.partitionBy("conv", "turn").orderBy("text", "speaker")) - 1)
    style = F.pmod(F.xxhash64("conv"), F.lit(len(STYLES))).cast("int")
    number = F.array_position(F.array(*map(F.lit, ROLES)), F.col("speaker")).cast("int") - 1
    prefix = F.array(*[F.array(*map(F.lit, s)) for s in STYLES])[style][number]
    split = F.split(F.concat(prefix, "text"), "\n")
    marked = F.transform(split, lambda x, k: F.struct(x.alias("line"), F.when(k > 0, F.trim(split[F.greatest(k - 1, F.lit(0))]) == "").otherwise(False).alias("gap")))
    lines = known.select("conv", "turn", number.alias("role"), style.alias("style"), "other", F.posexplode(marked).alias("k", "x")).select("conv", "turn", "role", "style", "other", "k", "x.line", "x.gap")
    blank = ((F.col("style") == len(STYLES) - 1) & (F.col("k") == 0)) | F.col("gap")
    lines = lines.where((F.trim("line") != "") | (F.col("k") == 0))
    return lines.select("conv", "turn", (F.col("other") * F.lit(1 << 32) + F.col("k")).alias("k"), "line", blank.alias("blank_before"), (F.col("role") * 2 + F.when(F.col("k") == 0, 0).otherwise(1)).alias("state"))


def blocked(lines: DataFrame) -> DataFrame:
    """``conv, block, at, lines``: the blocks of each transcript from 0, the number of their first line, and their lines (line, observed, state).

    ``lines`` has conv, turn, k (which order them), line, blank_before, and the true state or null.
    """
    spark, kind = lines.sparkSession, lines.schema["conv"].dataType.simpleString()
    tasks = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = lines.select("conv", "turn", "k", "line", observation(F.col("line"), F.col("blank_before"), F.lit(False)).alias("observed"), F.col("state").cast("int").alias("state"))
    row = pa.list_(pa.struct([("line", pa.string()), ("observed", pa.int32()), ("state", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, seq, at, size = TaskContext.get().partitionId(), 0, 0, 0, 0
        names, kinds = ["conv", "part", "run", "block", "at", "lines"], None
        held: list[dict] = []
        out: list[tuple] = []
        conv = None

        def sent() -> pa.RecordBatch:
            columns = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

        for batch in batches:
            kinds = [batch.column(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), row]
            for key, line, observed, state in zip(*(batch.column(k).to_pylist() for k in (0, 3, 4, 5))):
                if held and (key != conv or len(held) == LINES or size > BYTES):
                    out.append((conv, part, number, seq, at, held))
                    seq, at, held, size = seq + 1, at + len(held), [], 0
                    if sum(len(x[-1]) for x in out) >= LINES:
                        yield sent()
                if key != conv:
                    number, seq, at, conv = number + (conv is not None), 0, 0, key
                held.append({"line": line, "observed": observed, "state": state})
                size += len(line)
        if held:
            out.append((conv, part, number, seq, at, held))
        if out:
            yield sent()

    order = rows.repartitionByRange(tasks, "conv", "turn", "k").sortWithinPartitions("conv", "turn", "k")
    found = stash(order.mapInArrow(run, f"conv {kind}, part int, run long, block long, at long, lines array<struct<line:string,observed:int,state:int>>"), "blocks")
    counted = found.groupBy("part", "run", "conv").agg(F.count("*").alias("blocks"), F.sum(F.size("lines")).alias("lines"))
    told = F.struct("run", "conv", "blocks", "lines")
    before, bases = (None, 0, 0), []
    for part, first, last in sorted(counted.groupBy("part").agg(F.min(told), F.max(told)).collect()):  # one row a task
        base = before[1:] if before[0] == first.conv else (0, 0)
        bases.append((part, *base))
        before = (last.conv, last.blocks, last.lines) if last.run else (last.conv, last.blocks + base[0], last.lines + base[1])
    base = F.broadcast(spark.createDataFrame(bases, "part int, blocks long, before long"))
    whole = found.join(base, "part").select("conv", (F.col("block") + F.when(F.col("run") == 0, F.col("blocks")).otherwise(0)).alias("block"), (F.col("at") + F.when(F.col("run") == 0, F.col("before")).otherwise(0)).alias("at"), "lines")
    first = lambda k: F.when((F.col("at") == 0) & (k == 0), 1).otherwise(0)
    return stash(whole.withColumn("lines", F.transform("lines", lambda x, k: F.struct(x["line"].alias("line"), (x["observed"] + first(k)).alias("observed"), x["state"].alias("state")))), "numbered")


def _in_blocks(lines: DataFrame) -> DataFrame:
    return lines if "block" in lines.columns else blocked(lines)


def fit(lines: DataFrame) -> Model:
    """Smoothed tables from labelled lines or their blocks; moves are counted inside blocks, and between neighbours by a join."""
    blocks = _in_blocks(lines)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shows, moves = np.zeros((STATES, OBSERVATIONS), np.int64), np.zeros((STATES, STATES), np.int64)
        for batch in batches:
            for found in batch.column(0).to_pylist():
                state, observed = (np.array([x[name] for x in found]) for name in ("state", "observed"))
                np.add.at(shows, (state, observed), 1)
                np.add.at(moves, (state[:-1], state[1:]), 1)
        for kind, table in enumerate((shows, moves)):
            a, b = np.nonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind)), pa.array(a), pa.array(b), pa.array(table[a, b])], ["kind", "a", "b", "n"])

    known = blocks.where(~F.exists("lines", lambda x: x["state"].isNull()))
    counted = known.select("lines").mapInArrow(run, "kind long, a long, b long, n long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).collect()  # at most STATES * (OBSERVATIONS + STATES) rows
    ends = known.select("conv", "block", F.col("lines.state")[0].alias("b"), F.element_at("lines.state", -1).alias("a"))
    between = ends.select("conv", (F.col("block") + 1).alias("block"), "a").join(ends.select("conv", "block", "b"), ["conv", "block"]).groupBy("a", "b").agg(F.count("*").alias("n")).collect()
    begun = ends.where("block = 0").groupBy("b").agg(F.count("*").alias("n")).collect()
    start, moves, shows = np.full(STATES, 0.1), np.full((STATES, STATES), 0.1), np.full((STATES, OBSERVATIONS), 0.01)
    for state in range(STATES):
        if state % 2:
            start[state] = 1e-3
        for other in range(1, STATES, 2):
            if other // 2 != state // 2:
                moves[state, other] = 1e-6  # a turn keeps its role
    for r in begun:
        start[r.b] += r.n
    for r in between:
        moves[r.a, r.b] += r.n
    for r in counted:
        (moves if r.kind else shows)[r.a, r.b] += r.n
    return Model(np.log(start / start.sum()), np.log(moves / moves.sum(axis=1, keepdims=True)), np.log(shows / shows.sum(axis=1, keepdims=True)))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def block_matrix(observed: list[int], model: Model) -> np.ndarray:
    """Best score from the state before a block to its last line's state."""
    out = np.full((STATES, STATES), -np.inf)
    np.fill_diagonal(out, 0.0)
    for o in observed:
        out = _product(out, model.moves + model.shows[:, o][None, :])
    return out


def best_path(observed: list[int], model: Model, before: int, last: int) -> list[int]:
    """The best states of a block's lines, given the state before it (``STATES`` for none) and its last state (-1 for the best one)."""
    scores, back = (model.start if before == STATES else model.moves[before]) + model.shows[:, observed[0]], []
    for o in observed[1:]:
        through = scores[:, None] + model.moves
        back.append(through.argmax(axis=0))
        scores = through.max(axis=0) + model.shows[:, o]
    states = [last if last >= 0 else int(scores.argmax())]
    for step in reversed(back):
        states.append(int(step[states[-1]]))
    return states[::-1]


def _pieces(matrices: list[np.ndarray], before: int, last: int) -> list[tuple[int, int]]:
    """States before and at the end of each of a row of matrices, on the best path between two states."""
    scores, back = matrices[0][before], []
    for m in matrices[1:]:
        through = scores[:, None] + m[:STATES]
        back.append(through.argmax(axis=0))
        scores = through.max(axis=0)
    ends = [last]
    for step in reversed(back):
        ends.append(int(step[ends[-1]]))
    ends.reverse()
    return list(zip([before, *ends[:-1]], ends))


_NODE = "conv {0}, block long, matrix array<double>"


def _composed(nodes: DataFrame, kind: str) -> DataFrame:
    """One level up: the max-plus products of up to ``FAN`` neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for children in batch.column(2).to_pylist():
                m = np.array(children[0]["matrix"]).reshape(STATES + 1, STATES)
                for c in children[1:]:
                    m = _product(m, np.array(c["matrix"]).reshape(STATES + 1, STATES)[:STATES])
                out.append(m.ravel().tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.float64()))], ["conv", "block", "matrix"])

    grouped = nodes.groupBy("conv", F.floor(F.col("block") / FAN).alias("block")).agg(F.array_sort(F.collect_list(F.struct("block", "matrix"))).alias("children"))
    return stash(grouped.mapInArrow(run, _NODE.format(kind)), "level")


def _spread(nodes: DataFrame, above: DataFrame, kind: str) -> DataFrame:
    """One level down: ``conv, block, before, last`` of each node from those of its parent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            conv, block, ends = [], [], []
            for key, children, before, last in zip(batch.column(0), *(batch.column(k).to_pylist() for k in (1, 2, 3))):
                matrices = [np.array(c["matrix"]).reshape(STATES + 1, STATES) for c in children]
                conv += [key.as_py()] * len(children)
                block += [c["block"] for c in children]
                ends += _pieces(matrices, before, last)
            yield pa.RecordBatch.from_arrays([pa.array(conv, batch.column(0).type), pa.array(block, pa.int64()), pa.array([e[0] for e in ends], pa.int32()), pa.array([e[1] for e in ends], pa.int32())], ["conv", "block", "before", "last"])

    grouped = nodes.groupBy("conv", F.floor(F.col("block") / FAN).alias("up")).agg(F.array_sort(F.collect_list(F.struct("block", "matrix"))).alias("children"))
    joined = grouped.join(above.select(F.col("conv").alias("c"), F.col("block").alias("b"), "before", "last"), (F.col("conv") == F.col("c")) & (F.col("up") == F.col("b")))
    return stash(joined.select("conv", "children", "before", "last").mapInArrow(run, f"conv {kind}, block long, before int, last int"), "ends")


def decode(lines: DataFrame, model: Model) -> DataFrame:
    """``conv, block, at, lines`` with each block's lines (line, state) in order, from lines or their blocks; true states aren't read."""
    blocks = _in_blocks(lines).select("conv", "block", "at", F.transform("lines", lambda x: F.struct(x["line"].alias("line"), x["observed"].alias("observed"))).alias("lines"))
    kind = blocks.schema["conv"].dataType.simpleString()
    shipped = lines.sparkSession.sparkContext.broadcast(tuple(model))

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shipped.value)
        for batch in batches:
            out = []
            for seen in batch.column(2).to_pylist():
                rest = block_matrix(seen[1:], own)
                first = np.concatenate([own.moves, own.start[None, :]]) + own.shows[:, seen[0]][None, :]
                out.append((first[:, :, None] + rest[None, :, :]).max(axis=1).ravel().tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.float64()))], ["conv", "block", "matrix"])

    long = blocks.join(blocks.where("block = 1").select("conv"), "conv", "left_semi")  # transcripts of one block need no matrix
    levels = [stash(long.select("conv", "block", F.col("lines.observed").alias("seen")).mapInArrow(matrices, _NODE.format(kind)), "level")]
    while levels[-1].agg(F.max("block")).first()[0]:
        levels.append(_composed(levels[-1], kind))

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = [int(np.array(m)[-STATES:].argmax()) for m in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([STATES] * len(last), pa.int32()), pa.array(last, pa.int32())], ["conv", "block", "before", "last"])

    ends = levels[-1].mapInArrow(top, f"conv {kind}, block long, before int, last int")
    for level in reversed(levels[:-1]):
        ends = _spread(level, ends, kind)

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shipped.value)
        row = pa.list_(pa.struct([("line", pa.string()), ("state", pa.int32())]))
        for batch in batches:
            out = []
            for found, before, last in zip(*(batch.column(k).to_pylist() for k in (3, 4, 5))):
                states = best_path([x["observed"] for x in found], own, before, last)
                out.append([{"line": x["line"], "state": s} for x, s in zip(found, states)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, row)], ["conv", "block", "at", "lines"])

    joined = blocks.join(ends, ["conv", "block"], "left").select("conv", "block", "at", "lines", F.coalesce("before", F.lit(STATES)).alias("before"), F.coalesce("last", F.lit(-1)).alias("last"))
    return joined.mapInArrow(paths, f"conv {kind}, block long, at long, lines array<struct<line:string,state:int>>")


_BARE = re.compile(_MARKER.replace("NAMES", "|".join(n for role in ROLES for n in MARKERS[role])) + r"(?:\*\*)?\s*", re.ASCII)


def _turns(found: list[dict], at: int, more: bool) -> Iterator[tuple]:
    """Place, role, whether it continues a turn, lines, text and canonical form of each turn or piece of one in some lines; ``more``: the last goes on behind them."""
    starts = [k for k, x in enumerate(found) if k == 0 or x["state"] % 2 == 0]
    for a, b in zip(starts, [*starts[1:], len(found)]):
        inside, role = found[a]["state"] % 2 == 1 and at + a > 0, ROLES[found[a]["state"] // 2]
        text = "\n".join([found[a]["line"] if inside else _BARE.sub("", found[a]["line"], count=1), *(x["line"] for x in found[a + 1 : b])])
        yield at + a, role, inside, b - a, text, ("" if inside else f"<|{role}|>\n") + text + ("" if more and b == len(found) else "\n<|end|>")


def _pages(decoded: DataFrame) -> DataFrame:
    """``conv, at, lines, more``: transcripts cut at every ``LINES``-th line, wherever blocks ended, and whether the next cut's first line goes on with the turn."""
    long = decoded.where("block > 0").select("conv").distinct()
    short = decoded.join(long, "conv", "left_anti").select("conv", "at", "lines", F.lit(False).alias("more"))  # one block has LINES lines at most
    rows = decoded.join(long, "conv", "left_semi")
    first, last = F.expr(f"at div {LINES}"), F.expr(f"(at + size(lines) - 1) div {LINES}")
    rows = rows.select("conv", "at", "lines", F.explode(F.sequence(first, last)).alias("page"))
    begin = F.greatest(F.col("at"), F.col("page") * LINES)
    part = F.slice("lines", (begin - F.col("at") + 1).cast("int"), ((F.col("page") + 1) * LINES - begin).cast("int"))
    pages = rows.select("conv", "page", begin.alias("at"), part.alias("lines")).groupBy("conv", "page").agg(F.array_sort(F.collect_list(F.struct("at", "lines"))).alias("parts"))
    pages = stash(pages.select("conv", "page", F.flatten("parts.lines").alias("lines")), "pages")
    goes_on = pages.select("conv", (F.col("page") - 1).alias("page"), (F.col("lines")[0]["state"] % 2 == 1).alias("more"))
    whole = pages.join(goes_on, ["conv", "page"], "left").select("conv", (F.col("page") * LINES).alias("at"), "lines", F.coalesce("more", F.lit(False)).alias("more"))
    return short.unionByName(whole)


def rendered(decoded: DataFrame) -> DataFrame:
    """One row a turn: ``conv, place, role, continues, n_lines, text, rendered``; the place is its first line's number.

    The text is the turn's lines without the marker of the first; the canonical form is ``<|role|>``, the text and ``<|end|>``.  A turn that
    crosses a ``LINES``-th line of its transcript comes as several rows, cut there: only the first has the role's sign and only the last the end,
    so that rows written one after the other are the canonical transcript.  Where tasks or blocks end changes nothing.
    """
    kind = decoded.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            for k, (at, found, more) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)))):
                columns = list(zip(*_turns(found, at, more)))
                key = batch.column(0).take(pa.array([k] * len(columns[0])))
                yield pa.RecordBatch.from_arrays([key, *(pa.array(c, t) for c, t in zip(columns, kinds))], ["conv", "place", "role", "continues", "n_lines", "text", "rendered"])

    return _pages(decoded).mapInArrow(run, f"conv {kind}, place long, role string, continues boolean, n_lines long, text string, rendered string")
