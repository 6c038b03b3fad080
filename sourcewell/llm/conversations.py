"""Conversations made well-formed by the cheapest edits: an optional system row, then user and assistant in turn.

A row is kept (K, 0), given another role (R, 2) or deleted (D, 3; what is blank or said before must go), and rows without
text are inserted (I, 2); a truncated row that stays costs 1. Four states (nothing yet, after system, user, assistant) are
all that counts of what stands before a row, so the least cost from a row on is a vector of four numbers. Such vectors are
computed backwards and kept at checkpoints only, one for each square root of the rows; walking forward, the rows between
two checkpoints are computed again, and in every state the ASCII-least edit that keeps the least cost is taken.

Rows are dealt over tasks by ranges of conversation, turn, role and text. A task repairs each conversation that lies
inside its range. The first and the last one may go on in other tasks: their rows pass on, and what such a part does to
any vector behind it is a four by four matrix, so all parts work at once and a scan over the parts gives every part the
vector at its end, another checkpoint. A last pass walks the parts in order, one part in memory. What it adds to a digest
is bound to that order by SHA-256 itself, so one conversation's digest is one task's work, however long it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from math import isqrt

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt_join, releasing, stored

#: What may stand at the end of a word or between words.
SPACE = " \t\n\v\f\r"
#: Equal rows of a conversation are dealt over so many ranges.
SALT = 64
#: Rows of results that leave a task at a time.
TOGETHER = 1 << 10
KINDS = "sua"
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Costs behind the last row: what is open must be closed by inserted rows.
END = (0, 4, 2, 0)
FAR = 1 << 50

Vector = tuple[int, int, int, int]


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with the faults that crc32(conv_id:turn) % 20 names; `gone` marks dropped ones, which still name their conversation."""
    filled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    rows = conversations.select("conv_id", "turn", filled[2].alias("role"), filled[3].alias("text"), (F.crc32(F.concat(filled[0], F.lit(":"), filled[1])) % 20).alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), copies.alias("copy")).drop("copy")


def _before(symbol: int, after: Vector) -> Vector:
    """Least costs before a row, by the state there, from those after it. symbol: kind, 4 if the row must go, 8 if truncated."""
    start, system, user, assistant = after
    c0, cs, cu, ca = start + 3, system + 3, user + 3, assistant + 3
    if not symbol & 4:
        kind, cut = symbol & 3, symbol >> 3
        to_user, to_assistant = 2 + cut + user, 2 + cut + assistant
        if kind == USER:
            to_user -= 2
        elif kind == ASSISTANT:
            to_assistant -= 2
        elif kind == SYSTEM:
            c0 = min(c0, cut + system)
        c0, cs, ca, cu = min(c0, to_user), min(cs, to_user), min(ca, to_user), min(cu, to_assistant)
    bu, ba = min(cu, 2 + ca), min(ca, 2 + cu)
    return min(c0, 2 + bu), min(cs, 2 + bu), bu, ba


def costs(symbols: bytes, tail: Vector) -> Vector:
    """Least costs before all rows, given those behind them."""
    for symbol in reversed(symbols):
        tail = _before(symbol, tail)
    return tail


def edits(symbols: bytes, tail: Vector, state: int, last: bool = True) -> Iterator[tuple[int, str, int]]:
    """Row (-1 for an inserted one), edit and state after it, of the ASCII-least of the cheapest edits from a state on."""
    n = len(symbols)
    size = isqrt(n) + 1
    marks, vector = {n: tail}, tail
    for i in range(n - 1, 0, -1):
        vector = _before(symbols[i], vector)
        if i % size == 0:
            marks[i] = vector
    for begin in range(0, n, size):
        end = min(begin + size, n)
        vectors = [marks.pop(end)]
        for i in range(end - 1, begin - 1, -1):
            vectors.append(_before(symbols[i], vectors[-1]))
        for i in range(begin, end):
            after, now = vectors[end - i - 1], vectors[end - i]
            kind, gone, cut = symbols[i] & 3, symbols[i] & 4, symbols[i] >> 3
            while True:
                to = NEXT[state]
                if now[state] == 3 + after[state]:
                    yield i, "D", state
                elif now[state] == 2 + now[to]:
                    state = to
                    yield -1, "I", state
                    continue
                elif not gone and (kind == to or kind == SYSTEM and state == START) and now[state] == cut + after[kind]:
                    state = kind
                    yield i, "K", state
                else:
                    state = to
                    yield i, "R", state
                break
    while last and tail[state]:
        state = NEXT[state]
        yield -1, "I", state


def _parts(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch, bool]]:
    """Runs of rows with equal keys, in pieces: keys, piece, whether the piece begins a run."""
    now = None
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in keys]
        start = 0
        for i in range(batch.num_rows + 1):
            key = tuple(c[i] for c in columns) if i < batch.num_rows else None
            if i == batch.num_rows or i and key != tuple(c[i - 1] for c in columns):
                if i > start:
                    own = tuple(c[start] for c in columns)
                    yield own, batch.slice(start, i - start), own != now
                    now, start = own, i


class _Rows:
    """What the rows of one part come to: symbols for the walk, counts of faults, turns."""

    def __init__(self):
        self.symbols, self.seen, self.faults, self.illegal = bytearray(), set(), [0, 0, 0], 0
        self.first = self.initial = None
        self.least = self.most = None
        self.turns = 0

    def add(self, piece: pa.RecordBatch) -> None:
        columns = [piece.column(c).to_pylist() for c in ("turn", "initial", "end", "said", "gone")]
        columns.append(piece.column("earlier").to_pylist() if "earlier" in piece.schema.names else [False] * piece.num_rows)
        for turn, initial, end, said, gone, earlier in zip(*columns, strict=True):
            if gone:
                continue
            fault = 0 if not end else 1 if earlier or said in self.seen else 2 if end not in ".!?" else 3
            self.seen.add(said)
            if fault < 3:
                self.faults[fault] += 1
            self.symbols.append(KINDS.find(initial) + 1 if initial else 0)
            self.symbols[-1] |= 4 * (fault < 2) + 8 * (fault == 2)
            if self.first is None:
                self.first = initial
            else:
                self.illegal += self.initial + initial not in ("su", "ua", "au")
            self.initial = initial
            if turn is not None and turn != self.most:  # rows come by turn
                self.least = turn if self.least is None else self.least
                self.most, self.turns = turn, self.turns + 1

    def gaps(self) -> int:
        return 0 if self.turns == 0 else self.most - self.least + 1 - self.turns


class _Walk:
    """Edits and digest of a conversation whose parts come one after the other."""

    def __init__(self):
        self.state, self.audit, self.sha, self.place = START, [], hashlib.sha256(), 0

    def part(self, pieces: list[pa.RecordBatch], symbols: bytes, tail: Vector, last: bool) -> list[tuple]:
        """The part's rows with their edits: place, edit, turn, role, text; inserted and deleted ones too."""
        held = [x for p in pieces for x in zip(*(p.column(c).to_pylist() for c in ("gone", "turn", "role", "text")), strict=True) if not x[0]]
        out = []
        for row, edit, self.state in edits(symbols, tail, self.state, last):
            _, turn, role, text = held[row] if row >= 0 else (False, None, None, "")
            if edit in "IR":
                role = ROLES[self.state]
            if edit != "D":
                self.sha.update(("\n" if self.place else "").encode() + f"{role}:{text}".encode())
                self.place += 1
            self.audit.append(edit)
            out.append((len(self.audit) - 1, edit, turn, role, text))
        return out


_SUMMARY = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
_NAMES = [c.split()[0] for c in _SUMMARY.split(", ")]
_EDITS = ["place", "edit", "turn", "role", "text"]


def _whole(pieces: list[pa.RecordBatch]) -> tuple[list, list[tuple]]:
    """Summary and rows of a conversation that is in one part."""
    rows, walk = _Rows(), _Walk()
    for piece in pieces:
        rows.add(piece)
    symbols = bytes(rows.symbols)
    out = walk.part(pieces, symbols, END, True)
    return [rows.gaps(), *rows.faults, rows.illegal, costs(symbols, END)[START], "".join(walk.audit), walk.sha.hexdigest()], out


def _prepared(conversations: DataFrame) -> DataFrame:
    """Rows with what the walk needs to know of them, dealt by ranges and sorted."""
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in conversations.columns else F.lit(False)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), gone.alias("gone"), F.pmod(F.monotonically_increasing_id(), F.lit(SALT)).alias("salt"))
    order = ["conv_id", "turn", "role", "text", "salt"]
    last = F.substring(F.rtrim("text", F.lit(SPACE)), -1, 1)
    said = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "gone", F.substring("role", 1, 1).alias("initial"), last.alias("end"), said.alias("said"))


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def _first_pass(rows: DataFrame, as_rows: bool) -> DataFrame:
    """Conversations inside a task's range repaired (`whole`), rows of its first and last one as they are, with block and place."""
    kind = dict(rows.dtypes)
    result = f"turn {kind['turn']}, role string, text string, edit string" if as_rows else _SUMMARY + f", turn {kind['turn']}, role string, text string"
    schema = f"conv_id {kind['conv_id']}, whole boolean, block int, place bigint, gone boolean, initial string, end string, said string, {result}"
    arrow = _arrow(schema)

    def batch(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if isinstance(columns.get(f.name), pa.Array) else pa.array(columns.get(f.name, [None] * n), f.type) for f in arrow], schema=arrow)

    def passed(piece: pa.RecordBatch, block: int, place: int) -> pa.RecordBatch:
        n = piece.num_rows
        return batch(n, whole=[False] * n, block=[block] * n, place=list(range(place, place + n)), **{c: piece.column(c) for c in piece.schema.names})

    def repaired(done: list[tuple]) -> pa.RecordBatch:
        return batch(len(done), whole=[True] * len(done), **dict(zip(["conv_id", *(_EDITS if as_rows else _NAMES)], zip(*done, strict=True), strict=True)))

    def run(batches):
        block, place, runs, pieces, of, done = TaskContext.get().partitionId(), 0, 0, [], None, []
        for (key,), piece, begins in _parts(batches, ["conv_id"]):
            if begins:
                if runs > 1:
                    summary, out = _whole(pieces)
                    done += [(of, *x) for x in out] if as_rows else [(of, *summary)]
                if len(done) >= TOGETHER:
                    yield repaired(done)
                    done = []
                runs, pieces, of = runs + 1, [], key
            if runs == 1:
                yield passed(piece, block, place)
                place += piece.num_rows
            else:
                pieces.append(piece)
        if done:
            yield repaired(done)
        for piece in pieces:
            yield passed(piece, block, place)
            place += piece.num_rows

    return rows.mapInArrow(releasing(run), schema)


def _flagged(parts: DataFrame) -> DataFrame:
    """Passed-on rows; `earlier` marks those whose role and text are in an earlier block of their conversation."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit(":"), F.col("conv_id").isNull().cast("string"), F.lit(":"), "said")
    rows = parts.withColumn("same", key)
    firsts = rows.groupBy("same").agg(F.min(F.when(~F.col("gone"), F.col("block"))).alias("since"))
    return dealt_join(rows, firsts, "same", "place").withColumn("earlier", F.coalesce(F.col("block") > F.col("since"), F.lit(False))).drop("same", "since")


def _tails(rows: DataFrame) -> DataFrame:
    """conv_id, block, tail (the cost vector behind the block), last, and the conversation's counts without its walk."""
    kind = dict(rows.dtypes)
    schema = f"conv_id {kind['conv_id']}, block int, matrix array<bigint>, counts array<bigint>, first string, initial string, least {kind['turn']}, most {kind['turn']}"
    arrow = _arrow(schema)

    def summary(key, part: _Rows) -> list:
        unit = [tuple(0 if s == t else FAR for s in range(4)) for t in range(4)]
        columns = [costs(bytes(part.symbols), u) for u in unit]
        matrix = [min(columns[t][s], FAR) for s in range(4) for t in range(4)]
        return [*key, matrix, [*part.faults, part.illegal, part.turns], part.first, part.initial, part.least, part.most]

    def run(batches):
        part, of = None, None
        for key, piece, begins in _parts(batches, ["conv_id", "block"]):
            if begins:
                if part:
                    yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(summary(of, part), arrow, strict=True)], schema=arrow)
                part, of = _Rows(), key
            part.add(piece)
        if part:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(summary(of, part), arrow, strict=True)], schema=arrow)

    own = rows.select("conv_id", "block", "place", "turn", "gone", "initial", "end", "said", "earlier")
    parts = own.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "place").mapInArrow(releasing(run), schema)
    scanned = f"conv_id {kind['conv_id']}, block int, tail array<bigint>, last boolean, counts array<bigint>"
    fields = _arrow(scanned)

    def scan(table: pa.Table) -> pa.Table:
        own = sorted(table.to_pylist(), key=lambda r: r["block"])
        total, turn, before = [0] * 5, None, None
        for r in own:
            total = [a + b for a, b in zip(total, r["counts"], strict=True)]
            if r["first"] is not None:
                total[3] += before is not None and before + r["first"] not in ("su", "ua", "au")
                before = r["initial"]
            if r["least"] is not None:
                total[4] -= r["least"] == turn  # a turn that goes on in the next block
                turn = r["most"]
        turns = [r["least"] for r in own if r["least"] is not None]
        gaps = turn - turns[0] + 1 - total[4] if turns else 0
        tail, out = END, []
        for r in reversed(own):
            out.append([r["conv_id"], r["block"], list(tail), r is own[-1], None])
            tail = tuple(min(FAR, *(r["matrix"][4 * s + t] + tail[t] for t in range(4))) for s in range(4))
        for row in out:
            row[4] = [gaps, *total[:4], tail[START]]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), fields, strict=True)], schema=fields)

    return parts.groupBy("conv_id").applyInArrow(scan, scanned)


def _last_pass(rows: DataFrame, as_rows: bool) -> DataFrame:
    """The passed-on conversations, walked block after block."""
    tails = _tails(rows).withColumnsRenamed({"conv_id": "of", "block": "at"})
    kind = dict(rows.dtypes)
    both = rows.join(tails, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("block") == F.col("at")))
    schema = f"conv_id {kind['conv_id']}, " + (f"place bigint, edit string, turn {kind['turn']}, role string, text string" if as_rows else _SUMMARY)
    arrow = _arrow(schema)

    def run(batches):
        walk, pieces, part, info = None, [], None, None

        def end():
            tail, last, counts = (info.column(c)[0].as_py() for c in ("tail", "last", "counts"))
            out = walk.part(pieces, bytes(part.symbols), tuple(tail), last)
            key = info.column("conv_id")[0].as_py()
            if as_rows:
                data = list(zip(*[(key, *x) for x in out], strict=True)) or [[]] * len(arrow)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(data, arrow, strict=True)], schema=arrow)
            elif last:
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip([key, *counts, "".join(walk.audit), walk.sha.hexdigest()], arrow, strict=True)], schema=arrow)

        of = None
        for key, piece, begins in _parts(batches, ["conv_id", "block"]):
            if begins:
                if pieces:
                    yield from end()
                if walk is None or of[0] != key[0]:
                    walk = _Walk()
                pieces, part, info, of = [], _Rows(), piece, key
            pieces.append(piece)
            part.add(piece)
        if pieces:
            yield from end()

    own = both.select("conv_id", "block", "place", "turn", "role", "text", "gone", "initial", "end", "said", "earlier", "tail", "last", "counts")
    return own.repartition("conv_id").sortWithinPartitions("conv_id", "block", "place").mapInArrow(releasing(run), schema)


def _repaired(conversations: DataFrame, as_rows: bool) -> DataFrame:
    done = stored(_first_pass(_prepared(conversations), as_rows))
    parts = stored(_flagged(done.where("not whole").select("conv_id", "block", "place", "turn", "role", "text", "gone", "initial", "end", "said")))
    last = _last_pass(parts, as_rows)
    return done.where("whole").select(*last.columns).unionByName(last)


def repair(conversations: DataFrame) -> DataFrame:
    """One row for each conv_id of conversations (conv_id, turn, role, text, and gone where rows only name a conversation).

    gaps in its turns; its rows that are blank, duplicate or truncated (the first of these counts); illegal neighbours;
    cost and audit of the edits; repaired_sha256 of the repaired rows. Rows are taken by turn (null first), equal turns by
    role and text; repeated rows are duplicates. Null roles and texts are one space; null ids are one conversation. Texts of
    any length are read whole; an empty table gives no rows.
    """
    return _repaired(conversations, False)


def repaired_rows(conversations: DataFrame) -> DataFrame:
    """All rows with their edits: conv_id, place, edit, turn, role, text. Without D they are the repaired conversations."""
    return _repaired(conversations, True)
