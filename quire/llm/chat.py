"""Chat formatting: roles of transcript lines by a hidden Markov model, then canonical turns.

States are the roles; a line's observation is its speaker marker (if any), whether it asks, its length, and for a
message's first line the role that the table gives. Transition and emission chances are counted from messages whose
role is given, those of markers too: how often each role's messages begin with no marker, their own or another's.
Viterbi runs in three steps, so that a conversation of any length is spread over tasks: each block of messages becomes
a max-plus matrix from the state before it to its last state; the matrices of a conversation are chained to find each
block's entry and exit; each block is then decoded between those two. Blocks are cut from the sorted messages by the
number of lines, so many messages of one turn are spread as well; a message's lines, which are one value of the input,
stay together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.native_words import count_words
from quire.llm.scratch import bounded, cut
from quire.llm.words import tidied

ROLES = ("system", "user", "assistant")
SPEAKERS = {"system": 0, "user": 1, "human": 1, "assistant": 2, "ai": 2, "bot": 2}
MARKER = r"(?i)^\s*[\[<*#|]*\s*(" + "|".join(SPEAKERS) + r")\s*[\]*|]*\s*[:>]\s*"
#: Messages whose first lines are among so many are decoded together.
BLOCK_LINES = 1024
LENGTHS = (8, 40, 160)
#: Counted beforehand for lines that keep their message's role.
STAY = 100
#: The chance that the table gives another role than a message's, and counted beforehand for a marker that does.
WRONG = 1e-4
START = len(ROLES)


def transcript_lines(messages: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv as text, block, turn, pos, state, k, line, marker, asks, long): the lines of each message.

    state is the index of the message's role, marker that of the role that a line's speaker marker names, -1 without one.
    Messages are sorted by conversation, turn and a hash, and their lines numbered in that order; pos is the number of a
    message's first line, and those of a conversation that share the quotient of pos by ``BLOCK_LINES`` are a block.
    Null texts are one empty line; null turns come first.
    """
    name = F.lower(F.trim(F.col(role)))
    rows = messages.select(F.col(conv).cast("string").alias("conv"), F.col(turn).alias("turn"), _speaker(name).alias("state"), F.coalesce(F.col(text), F.lit("")).alias("full"), F.xxhash64(F.col(role), F.col(text)).alias("msg"), F.monotonically_increasing_id().alias("copy"))
    # ranges end between any two messages, as copy tells all apart; numbers go up with the range and within it
    order = ["conv", "turn", "msg", "copy"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.select("conv", "turn", "state", F.posexplode(F.split("full", "\n", -1)).alias("k", "line"))
    rows = rows.withColumn("pos", F.monotonically_increasing_id() - F.col("k"))
    words = count_words(F.col("line"))
    long = sum((words > n).cast("int") for n in LENGTHS)
    marker = _speaker(F.lower(F.regexp_extract("line", MARKER, 1)))
    block = F.shiftright("pos", BLOCK_LINES.bit_length() - 1)
    return rows.select("conv", block.alias("block"), "turn", "pos", "state", "k", "line", marker.alias("marker"), F.col("line").rlike(r"\?\s*$").cast("int").alias("asks"), long.alias("long"))


def _speaker(name: Column) -> Column:
    """The index of a role by a lower-cased name of it, else -1."""
    state = F.lit(-1)
    for word, s in SPEAKERS.items():
        state = F.when(name == word, s).otherwise(state)
    return state


def transitions(lines: DataFrame) -> DataFrame:
    """(before, state, n): messages by their known role and that of the message before them, START for a conversation's first.

    A message after one whose role isn't known is left out. Within blocks the message before is the row before; then
    the last messages of blocks meet the first ones of the next.
    """
    heads = lines.where("k = 0").select("conv", "block", "pos", "state")
    inside = heads.withColumn("before", F.lag("state").over(Window.partitionBy("conv", "block").orderBy("pos")))
    edges = cut(heads.groupBy("conv", "block").agg(F.min_by("state", "pos").alias("state"), F.max_by("state", "pos").alias("last")), "chat-edges")
    edges = edges.withColumn("before", F.lag("last", 1, START).over(Window.partitionBy("conv").orderBy("block")))
    both = inside.where("before IS NOT NULL").select("before", "state").unionByName(edges.select("before", "state"))
    return both.where("before >= 0 AND state >= 0").groupBy("before", "state").agg(F.count("*").alias("n"))


def estimate(lines: DataFrame) -> tuple[np.ndarray, list[np.ndarray]]:
    """Log chances: steps (within a message or to the next x states and start x states), and the features: marker (within a
    message or at its start x states x values), question and length (states x values), given role (states x values).

    All are counted from messages whose role is given: at a message's first line its role, the marker that it begins
    with, whether it asks and its length; within it the markers, each of which begins a stretch of the role that it
    names. Counts start at one, those of staying within a message and of lines within it without a marker at ``STAY``,
    those of markers that name another role at ``WRONG``, which is also the chance that a given role is wrong. Only sums over roles come to the driver.
    """
    n = len(ROLES)
    steps = np.ones((2, n + 1, n))
    steps[0] += STAY * np.eye(n + 1, n)
    for row in transitions(lines).collect():
        steps[1, row["before"], row["state"]] += row["n"]
    features = [np.ones(shape) for shape in ((2, n, n + 1), (n, 2), (n, len(LENGTHS) + 1))]
    features[0][:, :, :n] = np.where(np.eye(n) > 0, 1, WRONG)
    features[0][0, :, n] = STAY
    known = lines.where("state >= 0")
    for row in known.where("k = 0").groupBy("state", "marker", "asks", "long").agg(F.count("*").alias("n")).collect():
        s = row["state"]
        features[0][1, s, row["marker"] if row["marker"] >= 0 else n] += row["n"]
        features[1][s, row["asks"]] += row["n"]
        features[2][s, row["long"]] += row["n"]
    for row in known.where("k > 0").groupBy("state", "marker").agg(F.count("*").alias("n")).collect():
        s, m = row["state"], row["marker"]
        now = s if m < 0 else m
        features[0][0, now, n if m < 0 else m] += row["n"]
        steps[0, s, now] += row["n"]
    log = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
    given = np.append(np.where(np.eye(n) > 0, 1 - WRONG, WRONG / (n - 1)), np.ones((n, 1)), axis=1)
    return log(steps), [*(log(f) for f in features), np.log(given)]


def emissions(lines: dict[str, np.ndarray], features: list[np.ndarray]) -> np.ndarray:
    """Lines x states."""
    fresh = _fresh(lines)
    marker = np.where(lines["marker"] < 0, len(ROLES), lines["marker"])
    given = np.where((lines["state"] < 0) | (fresh == 0), len(ROLES), lines["state"])
    return features[0][fresh, :, marker] + features[1].T[lines["asks"]] + features[2].T[lines["long"]] + features[3].T[given]


def block_matrix(e: np.ndarray, fresh: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Best log chance from each state before the lines (or the start) to each state of the last line.

    fresh is 1 for a line that begins a message, else 0.
    """
    m = steps[fresh[0]] + e[0]
    for row, f in zip(e[1:], fresh[1:], strict=True):
        m = (m[:, :, None] + steps[f, None, :START]).max(axis=1) + row
    return m


def decode(e: np.ndarray, fresh: np.ndarray, steps: np.ndarray, enter: int, leave: int) -> np.ndarray:
    """The best states of the lines between a given state before them and a given last one."""
    best, back = steps[fresh[0], enter] + e[0], np.zeros(e.shape, np.int64)
    for i in range(1, len(e)):
        way = best[:, None] + steps[fresh[i], :START]
        back[i] = way.argmax(axis=0)
        best = way.max(axis=0) + e[i]
    out = np.empty(len(e), np.int64)
    out[-1] = leave
    for i in range(len(e) - 1, 0, -1):
        out[i - 1] = back[i][out[i]]
    return out


def _fresh(lines: dict[str, np.ndarray]) -> np.ndarray:
    return (lines["k"] == 0).astype(np.int64)


def changes(column: np.ndarray) -> np.ndarray:
    """Where a column differs from the row before (the first row does); nulls are equal."""
    new = column[1:] != column[:-1]
    if column.dtype.kind == "f":
        new &= ~(np.isnan(column[1:]) & np.isnan(column[:-1]))
    return np.concatenate((np.ones(min(len(column), 1), bool), new))


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[dict[str, np.ndarray], list[tuple[int, int]]]]:
    """(columns, (from, to) of each group) from a sorted stream of batches, every group whole; never without groups."""
    held: list[pd.DataFrame] = []

    def groups(pdf: pd.DataFrame) -> tuple[dict[str, np.ndarray], np.ndarray]:
        columns = {c: pdf[c].to_numpy() for c in pdf.columns}
        new = np.logical_or.reduce([changes(columns[k]) for k in keys])
        return columns, np.append(np.flatnonzero(new), len(pdf))

    for pdf in batches:
        if len(pdf) == 0:
            continue
        # where its last group begins; before it, if that goes on from what is held. What is held is joined once
        _, cuts = groups(pd.concat([held[-1].iloc[-1:], pdf], ignore_index=True) if held else pdf)
        last = int(cuts[-2]) - bool(held)
        if last < 0:
            held.append(pdf)
            continue
        whole = pd.concat([*held, pdf.iloc[:last]], ignore_index=True)
        if len(whole):
            columns, cuts = groups(whole)
            yield columns, list(zip(cuts[:-1], cuts[1:], strict=True))
        held = [pdf.iloc[last:]]
    if held:
        columns, cuts = groups(pd.concat(held, ignore_index=True))
        yield columns, list(zip(cuts[:-1], cuts[1:], strict=True))


def parse_chats(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, part, role, n_lines, rendered): the canonical turns of each conversation.

    A message is cut where the recovered role changes or a line carries a marker; part counts the pieces of the messages of
    a turn. Markers are taken off, and a piece is rendered as <|role|>, a newline, its lines, a newline and <|end|>. Messages with an
    unknown or null role are given one by their lines and neighbours. Null texts are one empty line; null ids and
    turns are a conversation and a turn of their own. Repeated messages of a turn stay side by side. Where the given role
    and a line's own marker disagree, the likelier by the counts wins.
    """
    kinds = dict(messages.dtypes)
    lines = cut(transcript_lines(messages, conv, turn, role, text), "chat-lines")
    steps, features = estimate(lines)
    dealt = lines.repartition("conv", "block").sortWithinPartitions("conv", "block", "pos", "k")

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for lines, groups in whole_groups(batches, ["conv", "block"]):
            e, fresh = emissions(lines, features), _fresh(lines)
            at = [i for i, _ in groups]
            yield pd.DataFrame({"conv": lines["conv"][at], "block": lines["block"][at], "m": [block_matrix(e[i:j], fresh[i:j], steps).ravel() for i, j in groups]})

    made = dealt.select("conv", "block", "k", "state", "marker", "asks", "long").mapInPandas(tidied(matrices), "conv string, block long, m array<double>")

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for blocks, groups in whole_groups(batches, ["conv"]):
            enter, leave = (np.zeros(len(blocks["conv"]), np.int32) for _ in range(2))
            for i, j in groups:
                best, back = np.full(START + 1, -np.inf), []
                best[START] = 0.0
                for m in blocks["m"][i:j]:
                    way = best[:, None] + m.reshape(START + 1, START)
                    back.append(way.argmax(axis=0))
                    best = np.append(way.max(axis=0), -np.inf)
                states = [int(best.argmax())]
                for b in back[::-1]:
                    states.append(int(b[states[-1]]))
                enter[i:j], leave[i:j] = states[:0:-1], states[-2::-1]
            yield pd.DataFrame({"conv": blocks["conv"], "block": blocks["block"], "enter": enter, "leave": leave})

    chained = cut(made, "chat-matrices").repartition("conv").sortWithinPartitions("conv", "block")
    ends = cut(chained.mapInPandas(tidied(chain), "conv string, block long, enter int, leave int"), "chat-ends").withColumnsRenamed({"conv": "__conv", "block": "__block"})
    # one row for each block joins its lines
    both = lines.join(ends, lines["conv"].eqNullSafe(ends["__conv"]) & (lines["block"] == ends["__block"])).drop("__conv", "__block")
    both = both.repartition("conv", "block").sortWithinPartitions("conv", "block", "pos", "k")

    def render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        marker = re.compile(MARKER)
        for lines, groups in whole_groups(batches, ["conv", "block"]):
            e, fresh = emissions(lines, features), _fresh(lines)
            turns, marked, text = changes(lines["turn"]), lines["marker"] >= 0, lines["line"]
            rows = []
            for i, j in groups:
                states = decode(e[i:j], fresh[i:j], steps, int(lines["enter"][i]), int(lines["leave"][i]))
                begins = changes(states) | turns[i:j] | marked[i:j] | fresh[i:j].astype(bool)
                cuts = np.append(np.flatnonzero(begins), j - i) + i
                part = 0
                new = np.flatnonzero(turns[i + 1 : j]) + i + 1
                second, last = (new[0], new[-1]) if len(new) else (j, i)
                for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                    part = 0 if x == i or turns[x] else part + 1
                    name = ROLES[states[x - i]]
                    said = [marker.sub("", t, count=1) if m else t for t, m in zip(text[x:y], marked[x:y], strict=True)]
                    rows.append((lines["conv"][x], lines["block"][x], x < second, x < second or x >= last, lines["turn"][x], part, name, y - x, f"<|{name}|>\n" + "\n".join(said) + "\n<|end|>"))
            yield pd.DataFrame(rows, columns=["conv", "block", "head", "edge", "turn", "part", "role", "n_lines", "rendered"])

    schema = f"conv string, block long, head boolean, edge boolean, turn {kinds[turn]}, part int, role string, n_lines long, rendered string"
    made = cut(both.mapInPandas(tidied(render), schema), "chat-pieces")
    # head: a piece of its block's first turn, which may go on from the blocks before; edge: of the first or last turn
    pieces = made.where("edge").groupBy("conv", "turn", "block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv", "turn").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = pieces.select(F.col("conv").alias("__conv"), F.col("block").alias("__block"), before.cast("int").alias("__before")).where("__before > 0")
    made = made.join(bounded(cut(offsets, "chat-offsets")), F.col("head") & F.col("conv").eqNullSafe(F.col("__conv")) & (F.col("block") == F.col("__block")), "left")
    part = (F.col("part") + F.coalesce("__before", F.lit(0))).alias("part")
    return made.select(F.col("conv").cast(kinds[conv]).alias(conv), F.col("turn").alias(turn), part, "role", "n_lines", "rendered")
