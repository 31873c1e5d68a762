"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant in turn, the assistant last. The automaton's states are
the role of the turn written last (none at the start). Each turn that is read is written under its role or another (a relabel),
as a new turn or merged into the turn before of the same role, after empty turns where the automaton needs them. Dynamic
programming chooses the cheapest way: a merge costs 1, an empty turn 2, a relabel 3; of equal ways the one that comes first in
``_moves`` is taken.

A conversation may be longer than a task should hold. The turns are sorted over the whole table in ranges, so a range holds
whole conversations and parts of at most two. Costs compose as min-plus products of 4 x 4 matrices: each range reports the
matrices of its parts, the driver joins those (two a range) and hands back the states at the edges, and each range then repairs
and renders its turns by itself. A row is written for each turn read; its ``rendered`` holds the markup up to and with this turn's
text, so that a conversation is the concatenation of its rows in order.

Order is by turn, then role, text and place in the input; nulls come first. A null conv_id is one conversation, a null or unknown role is relabelled,
a null text is empty. Repeated rows are turns of their own and so are merged. Marks of the markup inside a text are escaped
(``escaped``, undone by ``unescaped``), so that no text can open or close a turn.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ROLES = ("system", "user", "assistant")
START = 3
#: From which states a new turn of a role may follow.
FOLLOWS = {0: (START,), 1: (START, 0, 2), 2: (1,)}
MERGE, INSERT, RELABEL = 1.0, 2.0, 3.0
END = 2
INF = float("inf")
OPEN, CLOSE = "<|{}|>\n", "\n<|end|>\n"
MERGED = "\n"
_MARK, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|(system|user|assistant)\|>\n(.*?)\n<\|end\|>\n", re.S)

#: role written, merged, empty turns before it
Move = tuple[int, bool, tuple[int, ...]]


def _ways(state: int) -> dict[int, tuple[int, ...]]:
    """For each state that empty turns reach from here, the fewest of them."""
    found: dict[int, tuple[int, ...]] = {state: ()}
    todo = [state]
    while todo:
        s = todo.pop(0)
        for q in (1, 2):
            if s in FOLLOWS[q] and q not in found:
                found[q] = (*found[s], q)
                todo.append(q)
    return found


@lru_cache(maxsize=None)
def _moves(role: int) -> tuple[np.ndarray, dict[tuple[int, int], Move]]:
    """Of a turn of this role (-1: unknown): costs from state to state, and the move that has it."""
    cost = np.full((4, 4), INF)
    best: dict[tuple[int, int], Move] = {}
    for s in range(4):
        for q in range(3):
            changed = 0.0 if q == role else RELABEL
            options: list[tuple[float, Move]] = [(MERGE, (q, True, ()))] if s == q else []
            options += [(INSERT * len(way), (q, False, way)) for p, way in _ways(s).items() if p in FOLLOWS[q]]
            for c, move in options:
                if c + changed < cost[s, q]:
                    cost[s, q], best[s, q] = c + changed, move
    return cost, best


def _end_cost() -> np.ndarray:
    return np.array([INSERT * len(_ways(s)[END]) if END in _ways(s) else INF for s in range(4)])


def role_number(role: str | None) -> int:
    return ROLES.index(role) if role in ROLES else -1


def matrix(roles: list[int]) -> np.ndarray:
    """Least costs from each state to each over these turns."""
    m = np.where(np.eye(4, dtype=bool), 0.0, INF)
    for r in roles:
        m = (m[:, :, None] + _moves(r)[0][None]).min(axis=1)
    return m


def repair(roles: list[int], entry: int = START, leave: int | None = None) -> tuple[list[tuple[int, int, Move]], tuple[int, ...], float]:
    """The cheapest moves as (state before, state after, move), the empty turns at the end and the cost; leave: the state to end in where more turns follow."""
    cost = np.full(4, INF)
    cost[entry] = 0.0
    back = np.zeros((len(roles), 4), np.int64)
    for i, r in enumerate(roles):
        through = cost[:, None] + _moves(r)[0]
        back[i] = through.argmin(axis=0)
        cost = through.min(axis=0)
    total = cost + _end_cost()
    state = int(total.argmin()) if leave is None else leave
    out = []
    end = state
    for i in range(len(roles) - 1, -1, -1):
        before = int(back[i, state])
        out.append((before, state, _moves(roles[i])[1][before, state]))
        state = before
    return out[::-1], _ways(end)[END] if leave is None else (), float(total[end] if leave is None else cost[end])


def escaped(text: str) -> str:
    """One more backslash inside each "<|", however many it has already."""
    return _MARK.sub(r"<\\\1|", text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def parse(rendered: str) -> list[tuple[str, str]]:
    """The roles and texts of a rendered conversation; merged turns are one text."""
    return [(role, unescaped(text)) for role, text in _TURN.findall(rendered)]


def _empty(roles: tuple[int, ...], state: int) -> tuple[str, int]:
    text = ""
    for q in roles:
        text += (CLOSE if state != START else "") + OPEN.format(ROLES[q])
        state = q
    return text, state


def render(texts: list[str], moves: list[tuple[int, int, Move]], after: tuple[int, ...] | None) -> list[str]:
    """A string for each turn; after: the empty turns at the end, None where the conversation goes on."""
    out = []
    for text, (state, _, (role, merged, way)) in zip(texts, moves):
        text = escaped(text)
        if merged:
            out.append(MERGED + text)
            continue
        head, state = _empty(way, state)
        out.append(head + (CLOSE if state != START else "") + OPEN.format(ROLES[role]) + text)
    if after is not None and out:
        out[-1] += _empty(after, moves[-1][1])[0] + CLOSE
    return out


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, bool, bool]]:
    """The conversations of a range in order: rows, whether first, whether last."""
    held: pa.Table | None = None
    first = True
    for t in _by_conversation(batches):
        if held is not None:
            yield held, first, False
            first = False
        held = t
    if held is not None:
        yield held, first, True


def _by_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held: list[pa.Table] = []
    key: object = None
    for batch in batches:
        keys = batch.column(batch.schema.get_field_index("conv_id")).to_pylist()
        a = 0
        while a < len(keys):
            b = a + 1
            while b < len(keys) and keys[b] == keys[a]:
                b += 1
            if held and keys[a] != key:
                yield pa.concat_tables(held)
                held = []
            key = keys[a]
            held.append(pa.Table.from_batches([batch.slice(a, b - a)]))
            a = b
    if held:
        yield pa.concat_tables(held)


def _edges(found: list[tuple[int, object, bool, bool, np.ndarray]]) -> dict[int, tuple[int, int | None]]:
    """found: (range, conversation, first, last, matrix) of the outer conversations of each range, in order. For each range: the state in which its first conversation goes on, and the state to leave its last one in (None: it ends there)."""
    out: dict[int, list] = {r: [START, None] for r, *_ in found}
    chains: list[list[tuple[int, object, bool, bool, np.ndarray]]] = []
    for x in found:
        if chains and chains[-1][-1][1] == x[1] and chains[-1][-1][0] != x[0]:
            chains[-1].append(x)
        else:
            chains.append([x])
    for chain in chains:
        if len(chain) == 1:
            continue
        cost = np.full(4, INF)
        cost[START] = 0.0
        back = []
        for x in chain:
            through = cost[:, None] + x[4]
            back.append(through.argmin(axis=0))
            cost = through.min(axis=0)
        state = int((cost + _end_cost()).argmin())
        for i in range(len(chain) - 1, -1, -1):
            if i < len(chain) - 1:
                out[chain[i][0]][1] = state
            state = int(back[i][state])
            if i:
                out[chain[i][0]][0] = state
    return {r: (a, b) for r, (a, b) in out.items()}


def formatted(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """A row for each turn: conv_id, turn, role, new_role, action, n_empty (empty turns written with it), cost, rendered."""
    spark = turns.sparkSession
    rows = turns.select(F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), F.col(f"`{role_col}`").alias("role"), F.col(f"`{text_col}`").alias("text"), F.monotonically_increasing_id().alias("place"))
    order = ["conv_id", "turn", "role", "text", "place"]
    sorted_ = rows.repartitionByRange(ranges or common.shuffle_width(spark), *order).sortWithinPartitions(*order)
    rows = common.checkpointed(sorted_.withColumn("range", F.spark_partition_id()))

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, first, last in _parts(batches):
            if first or last:
                m = matrix([role_number(x) for x in t.column("role").to_pylist()])
                yield pa.RecordBatch.from_arrays([t.column("range").slice(0, 1).combine_chunks(), t.column("conv_id").slice(0, 1).combine_chunks(), pa.array([first]), pa.array([last]), pa.array([m.ravel().tolist()])], names=["range", "conv_id", "first", "last", "m"])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}
    outer = rows.select("range", "conv_id", "role").mapInArrow(report, f"range int, conv_id {kinds['conv_id']}, first boolean, last boolean, m array<double>").collect()
    found = [(r["range"], r["conv_id"], r["first"], r["last"], np.array(r["m"]).reshape(4, 4)) for r in sorted(outer, key=lambda r: (r["range"], not r["first"]))]
    edges = _edges(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, first, last in _parts(batches):
            entry, leave = edges[t.column("range")[0].as_py()]
            entry, leave = entry if first else START, leave if last else None
            roles = [role_number(x) for x in t.column("role").to_pylist()]
            moves, after, _ = repair(roles, entry, leave)
            said = render([x or "" for x in t.column("text").to_pylist()], moves, after if leave is None else None)
            action = [("relabel " if q != r else "") + ("merge" if merged else "keep") for r, (_, _, (q, merged, _)) in zip(roles, moves)]
            empty = np.array([len(m[2][2]) for m in moves], np.int64)
            cost = np.array([_moves(r)[0][a, b] for r, (a, b, _) in zip(roles, moves)])
            empty[-1] += len(after)
            cost[-1] += INSERT * len(after)
            yield pa.RecordBatch.from_arrays([t.column("conv_id").combine_chunks(), t.column("turn").combine_chunks(), t.column("role").combine_chunks(), pa.array([ROLES[m[2][0]] for m in moves]), pa.array(action), pa.array(empty), pa.array(cost), pa.array(said, pa.string())], names=["conv_id", "turn", "role", "new_role", "action", "n_empty", "cost", "rendered"])

    return rows.mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, new_role string, action string, n_empty long, cost double, rendered string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatted(common.table(spark, sf_dir, "conversations"))


QUERIES = {"op4_chat": query}
ORACLES: dict[str, str] = {}
