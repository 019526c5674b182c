"""Conversation structure repair: the cheapest edits that make a conversation's roles alternate.

A node of the search graph is (turns passed, state of the role pattern); edges keep, rerole or delete
a turn, or insert one. The weight of a way through the graph is one big integer: its high digits are
the cost, its low digits, of fixed width, spell the edits' letters from the first one on, and positions
behind the last letter are zero. The least integer is then the cheapest way and, among equally cheap
ones, the one whose letters come first in ASCII order; nothing else decides.

A conversation may be longer than one task should hold. Its turns lie in order over range partitions;
every partition reduces its part to the sixteen least integers from state to state, and these are
composed in groups of eight tasks until one is left. Of equally dear ways over the same turns none
spells the beginning of another (it would lack an insertion, which costs), so the parts' least integers
make the whole's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalspark.llm.shared import landed

SPACE = " \t\n\x0b\x0c\r"
#: What edits cost, and what a truncated turn that stays costs besides.
KEEP, REROLE, DELETE, INSERT, OPEN_END = 0, 3, 4, 3, 3
#: Letters by digit; 0 is the padding. Their order is that of ASCII.
LETTERS = "\0DIKR"
_D, _I, _K, _R = 1, 2, 3, 4
_BITS = 3
#: States of the pattern (s?(ua)+)?: nothing yet, after s, after u, after a. The first and last may end it.
STATES, FINAL = 4, (0, 3)
_STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
_GIVEN = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
_FAN = 8
_CHUNK = 512


def fault(text: str, seen: bool) -> int:
    """The first fault of a turn; seen: the same role and text stand earlier in the conversation."""
    body = text.rstrip(SPACE)
    if not body:
        return BLANK
    return DUPLICATE if seen else FINE if body[-1] in ".!?" else TRUNCATED


def least(turns: list[tuple[str, int]], ends: Iterable[int]) -> tuple[int, list[int | None]]:
    """Width in letters, and for each state the least integer of a way from it over all turns.

    turns: role initial and fault of each; ends: the states in which a way may end.
    """
    width = 3 * len(turns) + 2  # two insertions at most before each turn and at the end
    high, top = _BITS * width, _BITS * (width - 1)
    low = (1 << high) - 1

    def edge(cost: int, letter: int, rest: int | None) -> int | None:
        if rest is None:
            return None
        return (((rest >> high) + cost) << high) | (letter << top) | ((rest & low) >> _BITS)

    def smaller(a, b):
        return b if a is None else a if b is None else min(a, b)

    def inserted(base):
        once = [smaller(base[q], edge(INSERT, _I, base[_GIVEN[q][1]])) for q in range(STATES)]
        return [smaller(base[q], edge(INSERT, _I, once[_GIVEN[q][1]])) for q in range(STATES)]

    best = inserted([0 if q in ends else None for q in range(STATES)])
    for initial, wrong in reversed(turns):
        base = []
        for q in range(STATES):
            way = edge(DELETE, _D, best[q])
            if wrong in (FINE, TRUNCATED):
                extra = OPEN_END if wrong == TRUNCATED else 0
                way = smaller(way, edge(REROLE + extra, _R, best[_GIVEN[q][1]]))
                if (q, initial) in _STEP:
                    way = smaller(way, edge(KEEP + extra, _K, best[_STEP[q, initial]]))
            base.append(way)
        best = inserted(base)
    return width, best


def table(turns: list[tuple[str, int]]) -> tuple[int, list[int | None]]:
    """Width, and the least integers from each state to each state, row by row."""
    columns = [least(turns, (end,)) for end in range(STATES)]
    return columns[0][0], [columns[end][1][q] for q in range(STATES) for end in range(STATES)]


def _joined(x: int, wide_x: int, y: int, wide_y: int) -> int:
    """The integer of one way after another."""
    part = x & ((1 << _BITS * wide_x) - 1)
    used = wide_x - ((part & -part).bit_length() - 1) // _BITS if part else 0
    cost = (x >> _BITS * wide_x) + (y >> _BITS * wide_y)
    rest = (y & ((1 << _BITS * wide_y) - 1)) << _BITS * (wide_x - used)
    return (cost << _BITS * (wide_x + wide_y)) | (part << _BITS * wide_y) | rest


def composed(left: tuple[int, list[int | None]], right: tuple[int, list[int | None]]) -> tuple[int, list[int | None]]:
    """The table of two parts that follow each other."""
    (wide_x, a), (wide_y, b) = left, right
    out = []
    for q in range(STATES):
        for end in range(STATES):
            ways = ((a[q * STATES + m], b[m * STATES + end]) for m in range(STATES))
            found = [_joined(x, wide_x, y, wide_y) for x, y in ways if x is not None and y is not None]
            out.append(min(found) if found else None)
    return wide_x + wide_y, out


def decoded(width: int, way: int) -> tuple[int, str]:
    """Cost and letters of an integer."""
    low = way & ((1 << _BITS * width) - 1)
    digits = f"{low:0{width}o}" if low else ""
    return way >> _BITS * width, "".join(LETTERS[int(d)] for d in digits.rstrip("0"))


class _Part:
    """What is known of some turns of a conversation that follow each other."""

    def __init__(self):
        self.turns: list[tuple[str, int]] = []
        self.stack: list[tuple[int, tuple]] = []
        self.faults = [0, 0, 0, 0]
        self.n = self.illegal = self.distinct = 0
        self.first = self.last = self.low = self.high = None

    def add(self, role: str, text: str, turn: int | None, seen: bool) -> None:
        wrong, initial = fault(text, seen), role[:1]
        self.faults[wrong] += 1
        self.illegal += self.n > 0 and self.last + initial not in ("su", "ua", "au")
        self.first = initial if not self.n else self.first
        self.last = initial
        self.n += 1
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.distinct += turn != self.high
            self.high = turn
        self.turns.append((initial, wrong))
        if len(self.turns) == _CHUNK:
            self._fold()

    def _fold(self) -> None:
        """Reduce the turns gathered so far; tables of like size are composed, so long ones are seldom."""
        size, made = 1, table(self.turns)
        self.turns = []
        while self.stack and self.stack[-1][0] == size:
            made = composed(self.stack.pop()[1], made)
            size *= 2
        self.stack.append((size, made))

    def answer(self) -> tuple[int, str]:
        """Cost and letters, where the part is the whole conversation."""
        if not self.stack:
            width, best = least(self.turns, FINAL)
            return decoded(width, best[0])
        return ending(*self.whole())

    def whole(self) -> tuple[int, list[int | None]]:
        if self.turns:
            self._fold()
        if not self.stack:
            return table([])
        made = self.stack[-1][1]
        for _, before in reversed(self.stack[:-1]):
            made = composed(before, made)
        return made


def ending(width: int, ways: list[int | None]) -> tuple[int, str]:
    """Cost and letters of the least way from the first state to one that may end the pattern."""
    return decoded(width, min(ways[end] for end in FINAL if ways[end] is not None))


_PARTS = (
    "task bigint, whole boolean, n bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint,"
    " first string, last string, low bigint, high bigint, n_turns bigint, width bigint, ways array<binary>,"
    " cost bigint, audit string"
)


def _frame(names: list[str], rows: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.types, strict=True)], schema=kinds)


def _schema(conv: pa.DataType) -> pa.Schema:
    long, text, yes = pa.int64(), pa.string(), pa.bool_()
    kinds = [conv, long, yes, *[long] * 5, text, text, *[long] * 4, pa.list_(pa.binary()), long, text]
    names = ["conv", *(f.split()[0] for f in _PARTS.split(","))]
    return pa.schema(list(zip(names, kinds, strict=True)))


def _packed(ways: list[int | None]) -> list[bytes | None]:
    return [None if w is None else w.to_bytes((w.bit_length() + 7) // 8, "big") for w in ways]


def _unpacked(ways: list[bytes | None]) -> list[int | None]:
    return [None if w is None else int.from_bytes(w, "big") for w in ways]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation of a sorted partition; ``whole`` where it begins and ends in it."""
    task, part, conv, begun, kinds = TaskContext.get().partitionId(), None, None, False, None

    def row(part, whole):
        counts = (part.n, part.faults[BLANK], part.faults[DUPLICATE], part.faults[TRUNCATED], part.illegal)
        ends = (part.first, part.last, part.low, part.high, part.distinct)
        if whole:
            return (conv, task, True, *counts, *ends, None, None, *part.answer())
        width, ways = part.whole()
        return (conv, task, False, *counts, *ends, width, _packed(ways), None, None)

    for batch in batches:
        kinds, out = _schema(batch.schema.field(0).type), []
        for new, header, turn, role, text, copies, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if part is None or new != conv:
                if part is not None:
                    out.append(row(part, begun))
                part, conv, begun = _Part(), new, header
            if not header:
                for i in range(copies):
                    part.add(role, text, turn, i > 0 or not first)
        if out:
            yield _frame(kinds.names, out, kinds)
    if part is not None:
        yield _frame(kinds.names, [row(part, False)], kinds)


def _compose(rows: pa.Table) -> pa.Table:
    """The parts of one conversation in the order of their tasks, as one part."""
    found = sorted(rows.to_pylist(), key=lambda r: r["task"])
    one, made = dict(found[0]), (found[0]["width"], _unpacked(found[0]["ways"]))
    for r in found[1:]:
        made = composed(made, (r["width"], _unpacked(r["ways"])))
        if one["n"] and r["n"]:
            one["illegal"] += one["last"] + r["first"] not in ("su", "ua", "au")
        if r["n"]:
            one["first"] = one["first"] if one["n"] else r["first"]
            one["last"] = r["last"]
        one["n_turns"] += r["n_turns"] - (one["high"] is not None and one["high"] == r["low"])
        one["low"] = r["low"] if one["low"] is None else one["low"]
        one["high"] = one["high"] if r["high"] is None else r["high"]
        for name in ("n", "blank", "duplicate", "truncated", "illegal"):
            one[name] += r[name]
    one["width"], one["ways"] = made[0], _packed(made[1])
    return pa.Table.from_pylist([one], rows.schema)


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        for r in rows:
            r["cost"], r["audit"] = ending(r["width"], _unpacked(r["ways"]))
            r["whole"], r["ways"] = True, None
        yield pa.RecordBatch.from_pylist(rows, batch.schema)


def damage(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations with faults put in by crc32 of ``conv:turn``, modulo 20: 0 drops the turn, 1 empties
    its text, 2 removes ``.!?`` from it, 3 repeats it, 4 makes the role user. Nulls count as one space;
    null ids and turns stay null in the result."""

    def known(name: str) -> Column:
        return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(" "))

    kind = F.crc32(F.concat_ws(":", known(conv), known(turn)).cast("binary")) % 20
    body = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(known(text), "[.!?]", "")).otherwise(known(text))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    rows = turns.select(
        F.col(f"`{conv}`").alias(conv), F.col(f"`{turn}`").cast("bigint").alias(turn),
        F.when(kind == 4, "user").otherwise(known(role)).alias(role), body.alias(text),
        F.explode(F.array_repeat(F.lit(0), copies)).alias("copy"),
    )
    return rows.drop("copy")


def _stream(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """conv, header, turn, role, text, copies, first: a header for each conversation and its distinct turns.

    first: no earlier turn of the conversation has this role and text. Equal turns are one row, so that
    any number of copies is summed up before the shuffle.
    """
    rows = turns.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("copies"))
    rows = landed(rows, "distinct-turns")
    at = F.struct(F.col("turn").isNotNull().alias("some"), "turn")
    firsts = rows.groupBy("conv", "role", "text").agg(F.min(at).alias("first")).alias("f")
    r = rows.alias("r")
    same = F.col("r.conv").eqNullSafe(F.col("f.conv")) & (F.col("r.role") == F.col("f.role"))
    r = r.join(firsts, same & (F.col("r.text") == F.col("f.text")))
    here = F.struct(F.col("r.turn").isNotNull().alias("some"), F.col("r.turn").alias("turn"))
    r = r.select("r.conv", F.lit(False).alias("header"), "r.turn", "r.role", "r.text", "copies", (here == F.col("first")).alias("first"))
    none = F.lit(None)
    heads = ids.select(
        "conv", F.lit(True).alias("header"), none.cast("bigint").alias("turn"), none.cast("string").alias("role"),
        none.cast("string").alias("text"), F.lit(0).cast("bigint").alias("copies"), F.lit(False).alias("first"),
    )
    return r.unionAll(heads.distinct())


def _order() -> list[Column]:
    return [F.col("conv").asc_nulls_first(), F.col("header").desc(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def _report(rows: DataFrame) -> DataFrame:
    """Per conversation: its counts, cost and audit."""
    order = _order()
    kind = rows.schema["conv"].dataType.simpleString()
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = landed(sorted_rows.mapInArrow(_parts, f"conv {kind}, {_PARTS}"), "conversation-parts")
    split = parts.where("NOT whole")
    span = (split.agg(F.max("task")).first()[0] or 0) + 1  # how many tasks there are: one number
    size = 1
    while size < span:
        size *= _FAN
        split = split.groupBy("conv", F.expr(f"task div {size}")).applyInArrow(_compose, f"conv {kind}, {_PARTS}")
    return parts.where("whole").unionAll(split.mapInArrow(_close, f"conv {kind}, {_PARTS}"))


def _edited(role: str, state: int, letter: str) -> tuple[str, int]:
    """The role of a kept, reroled or inserted turn, and the state behind it."""
    return (role, _STEP[state, role[:1]]) if letter == "K" else _GIVEN[state]


class _Editor:
    """Applies a conversation's letters to its turns as these come by."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def inserts(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            role, self.state = _edited("", self.state, "I")
            self.at += 1
            yield role, "", "I"

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter != "D":
            role, self.state = _edited(role, self.state, letter)
            yield role, text, letter


def _edits(batches: Iterator[pa.RecordBatch]):
    """(conversation, report, edited turn or None at its beginning and its end) of sorted rows."""
    conv, report, editor = None, None, None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            new, header, role, text, copies, found = row
            if header:
                if editor is not None:
                    for turn in editor.inserts():
                        yield conv, report, turn
                    yield conv, report, None
                conv, report, editor = new, found, _Editor(found["audit"])
            else:
                for _ in range(copies):
                    for turn in editor.turn(role, text):
                        yield conv, report, turn
    if editor is not None:
        for turn in editor.inserts():
            yield conv, report, turn
        yield conv, report, None


def _with_reports(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """Each conversation's report and then its turns, in order and in one partition.

    A digest over one text is made from its beginning to its end; turns pass by one after another, and
    only the letters of one conversation are held.
    """
    found = F.struct("blank", "duplicate", "truncated", "illegal", "cost", "audit", "low", "high", "n_turns")
    none = F.lit(None)
    heads = reports.select(
        "conv", F.lit(True).alias("header"), none.cast("bigint").alias("turn"), none.cast("string").alias("role"),
        none.cast("string").alias("text"), F.lit(0).cast("bigint").alias("copies"), found.alias("found"),
    )
    kind = heads.schema["found"].dataType
    turns = rows.where("NOT header").select(*heads.columns[:-1], none.cast(kind).alias("found"))
    order = _order()
    both = heads.unionAll(turns).repartition("conv").sortWithinPartitions(*order)
    return both.select("conv", "header", "role", "text", "copies", "found")


def _prepared(turns: DataFrame, ids: DataFrame | None, conv: str, turn: str, role: str, text: str) -> DataFrame:
    def known(name: str) -> Column:
        return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(" ")).alias(name)

    ids = turns if ids is None else ids
    rows = turns.select(
        F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").cast("bigint").alias("turn"),
        known(role).alias("role"), known(text).alias("text"),
    )
    return landed(_stream(rows, ids.select(F.col(f"`{conv}`").alias("conv"))), "conversation-turns")


def repair(
    turns: DataFrame, ids: DataFrame | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Per conversation: ``conv``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``,
    ``audit`` and ``repaired_sha256`` of the repaired ``role:text``, joined by newlines.

    ids: a frame whose conversations are all reported, those without turns with zeros and an empty
    text's hash; default: ``turns``. Turns are taken by number, null ones first, then by role and text;
    equal ones are repeats. A null role or text is one space; a null conversation is one of its own.
    A turn's faults are, in this order: blank, duplicate (role and text seen earlier), truncated (the last
    character is none of ``.!?``). Keeping costs 0, reroling 3, deleting 4 (blank and duplicate turns must
    go), inserting an empty turn 3, and a truncated turn that stays 3 more. The role initials of what is
    left match ``(s?(ua)+)?``. gaps: numbers missing between the least and the greatest turn. An empty
    table gives no rows; other columns are not looked at.
    """
    rows = _prepared(turns, ids, conv, turn, role, text)
    both = _with_reports(rows, landed(_report(rows), "conversation-reports"))
    kind = rows.schema["conv"].dataType.simpleString()
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    def run(batches):
        held, schema = [], None

        def kinds(first):
            return pa.schema([("conv", first), *((n, pa.int64()) for n in names), ("audit", pa.string()), ("repaired_sha256", pa.string())])

        def watched():
            nonlocal schema
            for batch in batches:
                schema = schema or kinds(batch.schema.field(0).type)
                yield batch

        digest, n = hashlib.sha256(), 0
        for which, report, edit in _edits(watched()):
            if edit is not None:
                digest.update(f"{'\n' if n else ''}{edit[0]}:{edit[1]}".encode())
                n += 1
                continue
            gaps = 0 if report["low"] is None else report["high"] - report["low"] + 1 - report["n_turns"]
            held.append((which, gaps, *(report[x] for x in names[1:]), report["audit"], digest.hexdigest()))
            digest, n = hashlib.sha256(), 0
            if len(held) >= 2000:
                yield _frame(schema.names, held, schema)
                held = []
        if held:
            yield _frame(schema.names, held, schema)

    made = both.mapInArrow(run, f"conv {kind}, {', '.join(f'{n} bigint' for n in names)}, audit string, repaired_sha256 string")
    return made.withColumnRenamed("conv", conv)


def repaired_turns(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """The repaired conversations: ``conv``, ``position`` from 0, ``role``, ``text`` and ``edit`` (K, R or I).

    The rules are those of ``repair``; conversations of which nothing is left have no rows.
    """
    rows = _prepared(turns, None, conv, turn, role, text)
    both = _with_reports(rows, landed(_report(rows), "conversation-reports"))
    kind = rows.schema["conv"].dataType.simpleString()

    def run(batches):
        held, schema, position = [], None, 0

        def watched():
            nonlocal schema
            for batch in batches:
                first = batch.schema.field(0).type
                schema = schema or pa.schema([("conv", first), ("position", pa.int64()), *((n, pa.string()) for n in ("role", "text", "edit"))])
                yield batch

        for which, _, edit in _edits(watched()):
            if edit is None:
                position = 0
                continue
            held.append((which, position, *edit))
            position += 1
            if len(held) >= 2000:
                yield _frame(schema.names, held, schema)
                held = []
        if held:
            yield _frame(schema.names, held, schema)

    made = both.mapInArrow(run, f"conv {kind}, position bigint, role string, text string, edit string")
    return made.select(F.col("conv").alias(conv), "position", F.col("role").alias(role), F.col("text").alias(text), "edit")
