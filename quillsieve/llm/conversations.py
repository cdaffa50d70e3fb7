"""Conversation structure repair by depth-first branch and bound.

A conversation is in order if the initials of its roles read ``(s?(ua)+)?``. Edits are Keep (0), Rerole to the role that
must follow (3), Delete (4, the only choice for blank and repeated messages) and Insert of an empty message (3); a message
that breaks off and is not deleted costs 3 more. The cheapest edits are wanted; of those with equal cost the ones whose
initials (D, I, K, R) come first in ASCII.

The search keeps an explicit stack of partial repairs. A lower bound of what the rest must still cost (for each position and
grammar state) orders the children and cuts those that cannot beat the incumbent ``(cost, audit)``; a dominance table keeps
the best prefix of each (position, state) node. Two prefixes of the same node and cost are never prefixes of each other, so
the lesser one stays the lesser with any ending, which makes both cuts exact. The stack running empty is the proof.

A conversation of any length is spread over tasks: rows are sorted by range, runs of a conversation that one task holds
whole are solved there, and conversations at the edges of a range or longer than ``BLOCK`` rows are cut into blocks. A block
is solved for every pair of grammar states at its ends; the blocks of a conversation are then joined in order, which needs
only their costs, audits and a running hash for each state.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillsieve.session import pin

#: Rows of a conversation that are solved at once.
BLOCK = 1024
#: Shapes of short conversations whose repair a task remembers, and the longest of them.
MEMO_SHAPES, MEMO_ROWS = 50_000, 16
RESULT_ROWS = 5_000

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Grammar states: nothing yet, after a system message, after a user message, after an assistant message.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
ENDS = (START, ASSISTANT)
FOLLOWS = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
#: What an inserted or reroled message becomes in each state, as role and next state.
EXPECTED = {s: ("assistant", ASSISTANT) if s == USER else ("user", USER) for s in STATES}
LEGAL = {"su", "ua", "au"}
OK, BLANK, DUPLICATE, BROKEN = range(4)
_INFINITE = 1 << 60
_SPACE = "\x20\t\n\x0b\x0c\r"
_BROKEN = re.compile(f"[^.!?][{_SPACE}]*\\Z")

Cell = tuple[str, int]
Repair = tuple[int, str]


def row_moves(state: int, cell: Cell) -> list[tuple[str, int, int]]:
    """What may be done with a row in ``state``: letter, cost and next state, in ASCII order."""
    initial, fault = cell
    moves = [("D", DELETE, state)]
    if fault in (BLANK, DUPLICATE):
        return moves
    extra = TRUNCATED if fault == BROKEN else 0
    kept = FOLLOWS[state].get(initial)
    if kept is not None:
        moves.append(("K", extra, kept))
    moves.append(("R", REROLE + extra, EXPECTED[state][1]))
    return moves


def suffix_bounds(cells: Sequence[Cell], ends: Iterable[int]) -> list[tuple[int, ...]]:
    """For each position and state, what the rest must cost at least to stop in one of ``ends``."""

    def with_inserts(own: list[int]) -> tuple[int, ...]:
        user, assistant = own[USER], own[ASSISTANT]
        own[USER] = min(user, INSERT + assistant)
        own[ASSISTANT] = min(assistant, INSERT + user)
        for state in (START, SYSTEM):
            own[state] = min(own[state], INSERT + own[USER])
        return tuple(own)

    bounds = [with_inserts([0 if s in ends else _INFINITE for s in STATES])]
    for cell in reversed(cells):
        after = bounds[-1]
        bounds.append(with_inserts([min(cost + after[to] for _, cost, to in row_moves(s, cell)) for s in STATES]))
    bounds.reverse()
    return bounds


def cheapest(cells: Sequence[Cell], start: int = START, ends: Iterable[int] = ENDS) -> Repair | None:
    """The cheapest repair of ``cells`` from state ``start`` to one of ``ends`` as (cost, audit); ties ASCII-least."""
    ends = tuple(ends)
    bounds, n = suffix_bounds(cells, ends), len(cells)
    best: Repair | None = None
    dominant: dict[tuple[int, int], Repair] = {}
    stack: list[tuple[int, int, int, str]] = [(0, start, 0, "")] if bounds[0][start] < _INFINITE else []
    while stack:
        at, state, cost, audit = stack.pop()
        least = cost + bounds[at][state]
        if best is not None and (least > best[0] or (least == best[0] and audit > best[1][: len(audit)])):
            continue
        known = dominant.get((at, state))
        if known is not None and known < (cost, audit):
            continue
        dominant[at, state] = (cost, audit)
        if at == n and state in ends and (best is None or (cost, audit) < best):
            best = (cost, audit)
        role_state = EXPECTED[state][1]
        children = [(cost + INSERT + bounds[at][role_state], "I", at, role_state, cost + INSERT)]
        if at < n:
            after = bounds[at + 1]
            children += [(cost + c + after[to], k, at + 1, to, cost + c) for k, c, to in row_moves(state, cells[at])]
        children = [c for c in children if c[0] < _INFINITE and (best is None or c[0] <= best[0])]
        for _, letter, to_at, to, spent in sorted(children, reverse=True):
            stack.append((to_at, to, spent, audit + letter))
    return best


def apply(audit: str, rows: Sequence[tuple[str, str]], state: int = START) -> Iterator[tuple[str, str]]:
    """Messages (role, text) that the edits of ``audit`` leave of ``rows``."""
    at = 0
    for letter in audit:
        if letter == "D":
            at += 1
            continue
        role, to = EXPECTED[state]
        if letter == "I":
            text = ""
        else:
            own, text = rows[at]
            at += 1
            if letter == "K":
                role, to = own, FOLLOWS[state][own[:1]]
        yield role, text
        state = to


class _Rows:
    """Messages of one conversation in order, or of a part of it, with what is counted about them."""

    def __init__(self):
        self.rows: list[tuple[str, str]] = []
        self.cells: list[Cell] = []
        self.turns: list[int | None] = []

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        self.rows.append((role, text))
        initial = role[:1]
        self.cells.append((initial if initial in "sua" else "", fault))
        self.turns.append(turn)

    def faults(self) -> list[int]:
        found = [0, 0, 0, 0]
        for _, fault in self.cells:
            found[fault] += 1
        return found[1:]

    def illegal(self) -> int:
        return sum(a[0] + b[0] not in LEGAL for a, b in zip(self.cells, self.cells[1:]))

    def gaps(self) -> tuple[int, int, int] | None:
        """Least, greatest and number of different turns."""
        known = {t for t in self.turns if t is not None}
        return (min(known), max(known), len(known)) if known else None


def first_fault(role: str, text: str, seen: set) -> int:
    key = (role, text)
    repeated = key in seen
    seen.add(key)
    if not text.strip(_SPACE):
        return BLANK
    return DUPLICATE if repeated else BROKEN if _BROKEN.search(text) else OK


def _solver() -> Callable[[list[Cell]], Repair]:
    memo: dict[tuple, Repair] = {}

    def solve(cells: list[Cell]) -> Repair:
        shape = tuple(cells)
        found = memo.get(shape)
        if found is None:
            found = cheapest(cells)
            if len(cells) <= MEMO_ROWS:
                if len(memo) >= MEMO_SHAPES:
                    memo.clear()
                memo[shape] = found
        return found

    return solve


#: Columns of a result beside the conversation's id.
_RESULT = {
    "gaps": "bigint", "blank": "bigint", "duplicate": "bigint", "truncated": "bigint", "illegal": "bigint",
    "cost": "bigint", "audit": "string", "repaired_sha256": "string", "repaired": "string",
}
_ARROW = {"bigint": pa.int64(), "string": pa.string(), "int": pa.int32()}


def _schema(conv: str, kind: str, columns: dict[str, str]) -> str:
    return ", ".join([f"`{conv}` {kind}", *[f"`{c}` {t}" for c, t in columns.items()]])


def _line(role: str, text: str) -> str:
    return f"{role}:{text}"


def _batch(conv: str, conv_type: pa.DataType, columns: dict[str, str], rows: list[dict]) -> pa.RecordBatch:
    types = {conv: conv_type} | {c: _ARROW.get(t) or pa.list_(_ARROW[t[6:-1]]) for c, t in columns.items()}
    return pa.RecordBatch.from_pydict({c: pa.array([r.get(c) for r in rows], t) for c, t in types.items()})


def _edges(conv: str, kind: str, with_text: bool, block: int):
    """Solves the conversations that a sorted partition holds whole; hands on the rows of all others in blocks."""
    columns = {"open": "int", "part": "int", "chunk": "int", "place": "int", "turn": "bigint", "role": "string",
               "text": "string", "fault": "int"} | _RESULT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, solve = TaskContext.get().partitionId(), _solver()
        out: list[dict] = []
        own, seen, held, chunk, conv_type = object(), set(), _Rows(), 0, None
        first = True

        def hand_on() -> None:
            nonlocal held, seen, chunk
            # a part without messages still names its conversation
            named = {conv: own, "open": 1, "part": part, "chunk": chunk}
            rows = zip(held.rows, held.cells, held.turns, strict=True)
            out.extend(
                named | {"place": i, "role": role, "text": text, "fault": cell[1], "turn": turn}
                for i, ((role, text), cell, turn) in enumerate(rows)
            )
            if not held.rows and not chunk:
                out.append(named | {"place": -1})
            held, seen, chunk = _Rows(), set(), chunk + 1

        def close() -> None:
            cost, audit = solve(held.cells)
            blank, duplicate, truncated = held.faults()
            text = "\n".join(_line(*m) for m in apply(audit, held.rows))
            turns = held.gaps()
            row = {
                conv: own, "open": 0, "gaps": turns[1] - turns[0] + 1 - turns[2] if turns else 0, "blank": blank,
                "duplicate": duplicate, "truncated": truncated, "illegal": held.illegal(), "cost": cost, "audit": audit,
                "repaired_sha256": hashlib.sha256(text.encode()).hexdigest(), "repaired": text if with_text else None,
            }
            out.append(row)

        for batch in batches:
            conv_type = batch.schema.types[0]
            for name, turn, role, text, missing in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own is not name and own != name:
                    if type(own) is not object:
                        if first or chunk:
                            hand_on()
                        else:
                            close()
                        first = False
                    own, seen, held, chunk = name, set(), _Rows(), 0
                if not missing:
                    if len(held.rows) == block:
                        hand_on()
                    held.add(turn, role, text, first_fault(role, text, seen))
                if len(out) >= RESULT_ROWS:
                    yield _batch(conv, conv_type, columns, out)
                    out.clear()
        if conv_type is not None:
            hand_on()  # the last conversation may go on in the next range
            yield _batch(conv, conv_type, columns, out)

    return run, _schema(conv, kind, columns)


def _blocks(conv: str, kind: str):
    """One row for each block: its counts, its messages and its repairs between all pairs of states."""
    columns = {
        "part": "int", "chunk": "int", "blank": "bigint", "duplicate": "bigint", "truncated": "bigint", "illegal": "bigint",
        "least": "bigint", "greatest": "bigint", "turns": "bigint", "cost": "array<bigint>", "audit": "array<string>",
        "role": "array<string>", "text": "array<string>",
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, conv_type = None, _Rows(), None

        def close() -> pa.RecordBatch:
            blank, duplicate, truncated = held.faults()
            turns = held.gaps() or (None, None, 0)
            repairs = [cheapest(held.cells, s, (e,)) for s in STATES for e in STATES]
            row = {
                conv: key[0], "part": key[1], "chunk": key[2], "blank": blank, "duplicate": duplicate, "truncated": truncated,
                "illegal": held.illegal(), "least": turns[0], "greatest": turns[1], "turns": turns[2],
                "cost": [r and r[0] for r in repairs], "audit": [r and r[1] for r in repairs],
                "role": [r for r, _ in held.rows], "text": [t for _, t in held.rows],
            }
            return _batch(conv, conv_type, columns, [row])

        for batch in batches:
            conv_type = batch.schema.types[0]
            for name, part, chunk, place, turn, role, text, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (name, part, chunk):
                    if key is not None:
                        yield close()
                    key, held = (name, part, chunk), _Rows()
                if place >= 0:
                    held.add(turn, role, text, fault)
        if key is not None:
            yield close()

    return run, _schema(conv, kind, columns)


def _joined(conv: str, kind: str, with_text: bool):
    """Joins the blocks of a conversation in order; for each state the best prefix, with its hash, is carried on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, conv_type = object(), None
        counts, turns, last, prefix = {}, None, None, {}

        def begin() -> None:
            nonlocal counts, turns, last, prefix
            counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
            turns, last, prefix = None, None, {START: (0, "", hashlib.sha256(), [], True)}

        def close() -> pa.RecordBatch:
            cost, audit, hashed, text, _ = min((prefix[s] for s in ENDS if s in prefix), key=lambda p: p[:2])
            row = {conv: own, "gaps": turns[1] - turns[0] + 1 - turns[2] if turns else 0} | counts
            row |= {"cost": cost, "audit": audit, "repaired_sha256": hashed.hexdigest()}
            row["repaired"] = "\n".join(text) if with_text else None
            return _batch(conv, conv_type, _RESULT, [row])

        def follow(block: dict) -> None:
            nonlocal turns, last, prefix
            for name in ("blank", "duplicate", "truncated", "illegal"):
                counts[name] += block[name]
            if block["turns"]:
                if turns is None:
                    turns = (block["least"], block["greatest"], block["turns"])
                else:  # blocks follow each other by turn
                    turns = (turns[0], block["greatest"], turns[2] + block["turns"] - (turns[1] == block["least"]))
            rows = list(zip(block["role"], block["text"], strict=True))
            if not rows:
                return
            if last is not None:
                counts["illegal"] += last + rows[0][0][:1] not in LEGAL
            last = rows[-1][0][:1]
            after = {}
            for state, (cost, audit, *_) in prefix.items():
                for end in STATES:
                    own_cost, own_audit = block["cost"][4 * state + end], block["audit"][4 * state + end]
                    if own_cost is not None:
                        found = (cost + own_cost, audit + own_audit, state, own_audit)
                        if end not in after or found[:2] < after[end][:2]:
                            after[end] = found
            carried = {}
            for end, (cost, audit, state, own_audit) in after.items():
                _, _, hashed, text, empty = prefix[state]
                hashed, text = hashed.copy(), list(text) if with_text else text
                for message in apply(own_audit, rows, state):
                    line = _line(*message)
                    hashed.update((line if empty else "\n" + line).encode())
                    empty = False
                    if with_text:
                        text.append(line)
                carried[end] = (cost, audit, hashed, text, empty)
            prefix = carried

        for batch in batches:
            conv_type = batch.schema.types[0]
            for block in batch.to_pylist():
                if own is not block[conv] and own != block[conv]:
                    if type(own) is not object:
                        yield close()
                    own = block[conv]
                    begin()
                follow(block)
        if type(own) is not object:
            yield close()

    return run, _schema(conv, kind, _RESULT)


def repair_conversations(
    df: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    missing: Column | None = None,
    with_text: bool = False,
    block: int = BLOCK,
) -> DataFrame:
    """One row for each conversation: its faults, the cheapest repair and the hash of the repaired messages.

    Columns: the conversation's id, ``gaps`` (turns without a message between the first and the last), ``blank``,
    ``duplicate``, ``truncated`` (messages by their first fault), ``illegal`` (neighbours whose roles may not follow each
    other), ``cost``, ``audit``, ``repaired_sha256`` and, with ``with_text``, ``repaired`` (``role:text`` lines).

    Messages are ordered by turn (null first), then by role and the text's MD5. A null role or text counts as one space.
    A null id is a conversation of its own. Rows for which ``missing`` holds only name their conversation; one without
    messages has zeros, an empty audit and the hash of the empty text. An empty table gives an empty one. Other columns are
    not read.
    """
    space = F.lit(" ")
    kind = df.schema[conv_col].dataType.simpleString()
    gone = F.coalesce(missing, F.lit(False)) if missing is not None else F.lit(False)
    rows = df.select(
        F.col(conv_col).alias("__conv"),
        F.col(turn_col).cast("bigint").alias("__turn"),
        F.coalesce(F.col(role_col), space).alias("__role"),
        F.coalesce(F.col(text_col), space).alias("__text"),
        gone.alias("__gone"),
        F.md5(F.coalesce(F.col(text_col), space)).alias("__key"),
    )
    order = ["__conv", "__turn", "__role", "__key"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("__key")
    run, schema = _edges("__conv", kind, with_text, block)
    first = pin(ranged.mapInArrow(run, schema))
    solved = first.where("open = 0").select("__conv", *_RESULT)

    # within a block repeats are known; between blocks a message has at most one row a block
    opened = first.where("open = 1")
    fresh = (F.col("place") >= 0) & (F.col("fault") != DUPLICATE)
    candidate = F.when(fresh, F.md5(F.concat_ws("\0", "role", "text"))).otherwise(
        F.concat_ws(":", "part", "chunk", "place")
    )
    earlier = F.row_number().over(W.partitionBy("__conv", "role", "__same").orderBy("part", "chunk", "place")) > 1
    flagged = opened.withColumn("__same", candidate).withColumn(
        "fault", F.when(fresh & earlier & (F.col("fault") != BLANK), F.lit(DUPLICATE)).otherwise(F.col("fault"))
    )
    keys = ["__conv", "part", "chunk"]
    run, schema = _blocks("__conv", kind)
    blocks = (
        flagged.select(*keys, "place", "turn", "role", "text", "fault")
        .repartition(*keys)
        .sortWithinPartitions(*keys, "place")
        .mapInArrow(run, schema)
    )
    run, schema = _joined("__conv", kind, with_text)
    stitched = blocks.repartition("__conv").sortWithinPartitions(*keys).mapInArrow(run, schema)
    found = solved.unionByName(stitched).withColumnRenamed("__conv", conv_col)
    return found if with_text else found.drop("repaired")


def damage(df: DataFrame) -> DataFrame:
    """Rows of conversations with seeded faults, and ``missing`` for those that are dropped.

    By the checksum of id and turn, one row in twenty each is dropped, emptied, loses its ``.!?``, is given twice, or
    becomes a user's. A null counts as one space.
    """

    def spaced(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    fate = F.crc32(F.concat_ws(":", spaced("conv_id"), spaced("turn")).cast("binary")) % 20
    text = spaced("text")
    return df.select(
        "conv_id",
        "turn",
        F.when(fate == 4, F.lit("user")).otherwise(spaced("role")).alias("role"),
        F.when(fate == 1, F.lit("")).when(fate == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (fate == 0).alias("missing"),
        F.explode(F.when(fate == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")
