"""Repair of the turns of a conversation by the cheapest edits.

A conversation should read ``(s?(ua)+)?``: an optional system turn, then user
and assistant in turn.  The edit lattice has a node for every row that is
still to come and every state of that pattern; keeping, re-roling and deleting
a row lead to the next row, inserting a turn stays at it.  Two Dijkstra
searches, forward from the start and backward from the end, take the cheaper
heap in turn.  They go on until no crossing can be as cheap as the best one, so
all crossings of that cost are met, and the least audit of them is the result.

An audit names the edits in order.  From a given state it fixes every role, so
equal audits are equal repairs; and two audits of equal cost over the same rows
never begin with one another, as the longer one would have more inserts.
Therefore the least audit is put together from the least parts, which both
searches use at a crossing, and long conversations at the edges of blocks.

Conversations of up to ``MAX_ROWS`` rows are repaired each in one go, while
their rows stream by.  Longer ones are numbered by a range sort and cut into
blocks; the cheapest way through a block is found from each state to each
state, and the tables of neighbouring blocks are folded, ``FAN`` at a time,
until one is left, from which the choice is handed down again.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.ranking import global_row_number
from ..stage import Stage
from .common import batches, broadcast_if_small

#: Rows of a conversation that one task repairs in one go, and of a block of a longer one.
MAX_ROWS = 1024
#: Neighbouring blocks that are folded into one.
FAN = 64
RETYPE, DELETE, INSERT, LEFT_TRUNCATED = 3, 4, 3, 3

# States of the pattern: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: The state after a turn that an edit makes up, and the states before such a turn.
MADE = (USER, USER, ASSISTANT, USER)
BEFORE = ((), (), (START, SYSTEM, ASSISTANT), (USER,))
#: The state after a kept row, by the state before it and the initial of its role.
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: What completes a conversation that its rows leave in a state.
TAIL = ("", "II", "I", "")
#: Faults of a row, as one letter each; the first two must be deleted.
BLANK, DUPLICATE, TRUNCATED, SOUND = "bdt."


# --- the lattice ------------------------------------------------------------------


def _steps(initials: str, faults: str, last_insert: int):
    """Edges of the lattice out of a node and into a node, as ``(cost, letter, node)``."""
    n = len(initials)
    more = [LEFT_TRUNCATED if f == TRUNCATED else 0 for f in faults]
    must_go = [f in (BLANK, DUPLICATE) for f in faults]

    def out(i: int, q: int):
        if i <= last_insert:
            yield INSERT, "I", (i, MADE[q])
        if i < n:
            yield DELETE, "D", (i + 1, q)
            if not must_go[i]:
                yield RETYPE + more[i], "R", (i + 1, MADE[q])
                after = KEPT.get((q, initials[i]))
                if after is not None:
                    yield more[i], "K", (i + 1, after)

    def into(i: int, q: int):
        if i <= last_insert:
            for p in BEFORE[q]:
                yield INSERT, "I", (i, p)
        if i > 0:
            yield DELETE, "D", (i - 1, q)
            if not must_go[i - 1]:
                for p in BEFORE[q]:
                    yield RETYPE + more[i - 1], "R", (i - 1, p)
                for p in STATES:
                    if KEPT.get((p, initials[i - 1])) == q:
                        yield more[i - 1], "K", (i - 1, p)

    return out, into


def cheapest(initials: str, faults: str, start: int, ends: tuple[int, ...], tail: bool) -> tuple[int, str] | None:
    """Cost and audit of the cheapest repair from a state to one of ``ends``, ties by the least audit; None if there is none.

    ``initials`` has one character a row, ``faults`` one letter.  ``tail`` allows inserts after the last row.
    """
    n = len(initials)
    out, into = _steps(initials, faults, n if tail else n - 1)
    # Edges without cost lead to a later row; so with ties by row, nothing cheaper or smaller reaches a settled node.
    ahead, behind = [(0, 0, "", start)], [(0, -n, "", q) for q in ends]
    heapq.heapify(behind)
    settled_ahead: dict[tuple[int, int], tuple[int, str]] = {}
    settled_behind: dict[tuple[int, int], tuple[int, str]] = {}
    best = (math.inf, "")
    while ahead or behind:
        low, high = (heap[0][0] if heap else math.inf for heap in (ahead, behind))
        reach = low + high if ahead and behind else min(low, high)
        if reach > best[0]:
            break
        if low <= high:
            cost, i, audit, q = heapq.heappop(ahead)
            if (i, q) in settled_ahead:
                continue
            settled_ahead[i, q] = cost, audit
            if (other := settled_behind.get((i, q))) is not None:
                best = min(best, (cost + other[0], audit + other[1]))
            for step, letter, node in out(i, q):
                if (other := settled_behind.get(node)) is not None:
                    best = min(best, (cost + step + other[0], audit + letter + other[1]))
                if node not in settled_ahead:
                    heapq.heappush(ahead, (cost + step, node[0], audit + letter, node[1]))
        else:
            cost, i, audit, q = heapq.heappop(behind)
            i = -i
            if (i, q) in settled_behind:
                continue
            settled_behind[i, q] = cost, audit
            if (other := settled_ahead.get((i, q))) is not None:
                best = min(best, (other[0] + cost, other[1] + audit))
            for step, letter, node in into(i, q):
                if (other := settled_ahead.get(node)) is not None:
                    best = min(best, (other[0] + step + cost, other[1] + letter + audit))
                if node not in settled_behind:
                    heapq.heappush(behind, (cost + step, -node[0], letter + audit, node[1]))
    return None if best[0] == math.inf else best


@functools.lru_cache(maxsize=65_536)
def repair_of(initials: str, faults: str) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    return cheapest(initials, faults, START, (START, ASSISTANT), True)


def edited(audit: str, initials: str, state: int = START) -> Iterator[tuple[int, int, str, str | None]]:
    """``row, sub, edit, role`` of every turn that an audit leaves; the role of a kept row is None.

    ``sub`` is 0 or 1 for what is inserted before the row and 2 for the row.
    """
    row, sub = 0, 0
    for edit in audit:
        if edit == "I":
            state = MADE[state]
            yield row, sub, edit, ROLE[state]
            sub += 1
            continue
        if edit == "K":
            state = KEPT[state, initials[row]]
            yield row, 2, edit, None
        elif edit == "R":
            state = MADE[state]
            yield row, 2, edit, ROLE[state]
        row, sub = row + 1, 0


# --- rows, and their faults ---------------------------------------------------------

_SPACE = "' \\t\\n\\u000B\\f\\r'"


def damage(conversations: DataFrame) -> DataFrame:
    """Rows damaged by the hash of ``conv_id:turn``, nulls as one blank.

    A hash of 0 modulo 20 drops a row, 1 empties its text, 2 takes ``.!?`` out,
    3 repeats it, 4 makes it a user's.  A dropped row stays as a row with
    ``present`` false, so that every conversation is still there.
    """
    text = lambda name: f"coalesce(cast({name} as string), ' ')"
    rows = conversations.selectExpr(
        "conv_id",
        "cast(turn as long) as turn",
        f"{text('role')} as role",
        f"{text('text')} as text",
        f"crc32(cast(concat({text('conv_id')}, ':', {text('turn')}) as binary)) % 20 as _d",
    )
    return rows.selectExpr(
        "conv_id",
        "turn",
        "if(_d = 4, 'user', role) as role",
        "case _d when 0 then '' when 1 then '' when 2 then regexp_replace(text, '[.!?]', '') else text end as text",
        "_d <> 0 as present",
        "explode(if(_d = 3, array(0, 1), array(0))) as _copy",
    ).drop("_copy")


def undamaged(conversations: DataFrame) -> DataFrame:
    """Rows as :func:`repair` takes them, nulls as one blank."""
    return conversations.selectExpr(
        "conv_id", "cast(turn as long) as turn", "coalesce(cast(role as string), ' ') as role",
        "coalesce(cast(text as string), ' ') as text", "true as present",
    )


def _marked(rows: DataFrame) -> DataFrame:
    """Add ``initial`` and ``fault``, as far as the row itself shows it."""
    bare = f"trim(trailing {_SPACE} from text)"
    return rows.selectExpr(
        "*",
        "if(role = '', ' ', substring(role, 1, 1)) as initial",
        f"case when {bare} = '' then '{BLANK}' when right({bare}, 1) in ('.', '!', '?') then '{SOUND}' else '{TRUNCATED}' end as fault",
    )


def _illegal(initials: str) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))


_REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_TURN = "place long, sub int, turn long, edit string, role string, text string"


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(T.DataType.fromDDL(ddl))


def _schemas(conv_type: str) -> tuple[str, pa.Schema]:
    ddl = f"conv_id {conv_type}, is_turn boolean, {_TURN}, {_REPORT}"
    return ddl, _arrow(ddl)


def _gaps(least: int | None, most: int | None, distinct: int) -> int:
    return 0 if least is None else most - least + 1 - distinct


def _whole(rows: DataFrame, conv_type: str) -> DataFrame:
    """Repair conversations that come sorted and each in one piece: their turns, and a report of each."""
    ddl, schema = _schemas(conv_type)

    def conversation(conv_id, held: list[tuple]) -> Iterator[tuple]:
        seen, faults = set(), []
        for _, role, text, _, fault in held:
            faults.append(DUPLICATE if (role, text) in seen and fault != BLANK else fault)
            seen.add((role, text))
        initials, faults = "".join(r[3] for r in held), "".join(faults)
        cost, audit = repair_of(initials, faults)
        turns = [r[0] for r in held if r[0] is not None]
        gaps = _gaps(min(turns, default=None), max(turns, default=None), len(set(turns)))
        counts = [faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)]
        yield conv_id, False, None, None, None, None, None, None, gaps, *counts, _illegal(initials), cost, audit
        for place, sub, edit, role in edited(audit, initials):
            turn, own, text = held[place][:3] if sub == 2 else (None, None, "")
            yield conv_id, True, place, sub, turn, edit, role or own, text, *[None] * 7

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            current, held, first = None, [], True
            for part in parts:
                for start in range(0, part.num_rows, 1024):
                    columns = [part.slice(start, 1024).column(i).to_pylist() for i in range(7)]
                    for conv_id, turn, role, text, present, initial, fault in zip(*columns, strict=True):
                        if first or conv_id != current:
                            if not first:
                                yield from conversation(current, held)
                            current, held, first = conv_id, [], False
                        if present:
                            held.append((turn, role, text, initial, fault))
            if not first:
                yield from conversation(current, held)

        yield from batches(schema, rows())

    return rows.select("conv_id", "turn", "role", "text", "present", "initial", "fault").mapInArrow(run, ddl)


# --- conversations longer than a block -------------------------------------------------

_PIECE = (
    "block long, first long, n long, blank long, duplicate long, truncated long, illegal long, initials string, "
    "least long, most long, distinct long, early long, late long, costs array<long>, ranks array<int>, ways array<string>"
)
#: costs, ranks and ways have 16 entries: the cheapest way from each state to each state, its place among those
#: from the same state in order of their audits, and the audit (of a block) or the states after each part (of a fold).


def _pieces(rows: DataFrame, conv_type: str, block: int) -> DataFrame:
    """One row for each conversation in each block of ``conv_id, pos, turn, initial, fault``."""
    ddl = f"conv_id {conv_type}, {_PIECE}"
    schema = _arrow(ddl)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        columns = [table[c].to_pylist() for c in ("conv_id", "pos", "turn", "initial", "fault")]
        out = []
        for conv_id, group in itertools.groupby(zip(*columns, strict=True), key=lambda r: r[0]):
            held = list(group)
            initials, faults = "".join(r[3] for r in held), "".join(r[4] for r in held)
            ways = [cheapest(initials, faults, p, (q,), False) for p in STATES for q in STATES]
            turns = [r[2] for r in held if r[2] is not None]
            out.append(
                (
                    conv_id, held[0][1] // block, held[0][1], len(held), *(faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)),
                    _illegal(initials), initials, min(turns, default=None), max(turns, default=None), len(set(turns)),
                    turns[0] if turns else None, turns[-1] if turns else None,
                    [w and w[0] for w in ways], _ranks([w and w[1] for w in ways]), [w and w[1] for w in ways],
                )
            )
        return pa.Table.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema=schema)

    return rows.groupBy(F.floor(F.col("pos") / block)).applyInArrow(run, ddl)


def _ranks(ways: list) -> list[int | None]:
    """The place of each way among those from the same state."""
    ranks: list[int | None] = [None] * 16
    for p in STATES:
        order = sorted((ways[4 * p + q], q) for q in STATES if ways[4 * p + q] is not None)
        for rank, (_, q) in enumerate(order):
            ranks[4 * p + q] = rank
    return ranks


def _fold(pieces: DataFrame, conv_type: str, fan: int) -> DataFrame:
    """Neighbouring pieces of a conversation as one; ``ways`` has the states after each of them."""
    ddl = f"conv_id {conv_type}, {_PIECE}"
    schema = _arrow(ddl)

    def run(table: pa.Table) -> pa.Table:
        parts = table.sort_by("block").to_pylist()
        costs, ranks, ways = [None] * 16, [None] * 16, [None] * 16
        for p in STATES:
            best = {p: (0, (), "")}  # cost, places of the parts, states after the parts
            for part in parts:
                after = {}
                for q, (cost, places, states) in best.items():
                    for r in STATES:
                        if (step := part["costs"][4 * q + r]) is not None:
                            way = (cost + step, (*places, part["ranks"][4 * q + r]), states + str(r))
                            after[r] = min(after.get(r, way), way)
                best = after
            for rank, q in enumerate(sorted(best, key=lambda q: best[q][1])):
                ranks[4 * p + q] = rank
            for q, (cost, _, states) in best.items():
                costs[4 * p + q], ways[4 * p + q] = cost, states
        total = {c: sum(part[c] for part in parts) for c in ("n", "blank", "duplicate", "truncated", "illegal", "distinct")}
        for one, two in itertools.pairwise(parts):
            total["illegal"] += _illegal(one["initials"][-1] + two["initials"][0])
        timed = [part for part in parts if part["least"] is not None]
        total["distinct"] -= sum(one["late"] == two["early"] for one, two in itertools.pairwise(timed))
        row = total | {
            "conv_id": parts[0]["conv_id"], "block": parts[0]["block"] // fan, "first": parts[0]["block"],
            "initials": parts[0]["initials"][0] + parts[-1]["initials"][-1],
            "least": min((t["least"] for t in timed), default=None), "most": max((t["most"] for t in timed), default=None),
            "early": timed[0]["early"] if timed else None, "late": timed[-1]["late"] if timed else None,
            "costs": costs, "ranks": ranks, "ways": ways,
        }
        return pa.Table.from_pylist([row], schema=schema)

    return pieces.groupBy("conv_id", F.floor(F.col("block") / fan)).applyInArrow(run, ddl)


def _long(rows: DataFrame, ids: DataFrame, conv_type: str, block: int, fan: int, stage: Stage) -> list[DataFrame]:
    """Turns and reports of the conversations ``ids``, whatever their length."""
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text", "_tie"]
    # The last key tells equal rows apart, so that they too are spread over the sort.
    tied = rows.where("present").withColumn("_tie", F.monotonically_increasing_id())
    ranked = stage.write(global_row_number(tied, order, "pos", stage).drop("_tie"), "ranked")
    said = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    firsts = ranked.groupBy("conv_id", said.alias("said")).agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("is_first"))
    slim = ranked.select("conv_id", "pos", "turn", "initial", "fault").join(firsts, "pos", "left")
    slim = slim.selectExpr(
        "conv_id", "pos", "turn", "initial", f"if(is_first is null and fault <> '{BLANK}', '{DUPLICATE}', fault) as fault"
    )
    levels = [stage.write(_pieces(slim, conv_type, block), "pieces_0")]
    n_ids = ids.count()
    while levels[-1].count() > n_ids:
        levels.append(stage.write(_fold(levels[-1], conv_type, fan), f"pieces_{len(levels)}"))

    # From the one piece that is left, the cheapest way to the end, then its parts down to the blocks.
    tails = F.expr(f"array({', '.join(str(INSERT * len(t)) + 'L' for t in TAIL)})")
    reached = "transform(sequence(0, 3), q -> struct(get(costs, q) + get(tails, q) as cost, get(ranks, q) as rank, q as q))"
    ends = levels[-1].withColumn("tails", tails).selectExpr("*", f"array_min(filter({reached}, e -> e.cost is not null)) as end")
    ends = stage.write(ends, "ends")
    reports = ids.join(ends, ids.conv_id.eqNullSafe(ends.conv_id), "left").select(
        ids.conv_id, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")],
        F.expr("coalesce(most - least + 1 - distinct, 0)").alias("gaps"), F.coalesce("end.cost", F.lit(0)).alias("cost"),
    )
    chosen = ends.selectExpr("conv_id", "block", "0 as p", "end.q as q", "true as is_last")
    for level in range(len(levels) - 1, 0, -1):
        above = levels[level].select("conv_id", "block", "first", "ways")
        picked = chosen.join(above, chosen.conv_id.eqNullSafe(above.conv_id) & (chosen.block == above.block))
        picked = picked.select(chosen.conv_id, "first", "p", "is_last", F.expr("get(ways, 4 * p + q)").alias("states"))
        parts = picked.selectExpr("*", "posexplode(filter(split(states, ''), s -> s <> '')) as (k, s)")
        chosen = stage.write(
            parts.selectExpr(
                "conv_id", "first + k as block", "if(k = 0, p, int(substring(states, k, 1))) as p", "int(s) as q",
                "is_last and k = length(states) - 1 as is_last",
            ),
            f"chosen_{level}",
        )
    below = levels[0].select("conv_id", "block", "first", "n", "initials", "ways")
    blocks = chosen.join(below, chosen.conv_id.eqNullSafe(below.conv_id) & (chosen.block == below.block)).select(
        below.conv_id, "first", "n", "p", "initials",
        F.concat(F.expr("get(ways, 4 * p + q)"), F.when(F.col("is_last"), F.get(F.array(*map(F.lit, TAIL)), F.col("q"))).otherwise("")).alias("audit"),
    )
    blocks = stage.write(blocks, "blocks")
    edit_ddl = f"conv_id {conv_type}, place long, sub int, edit string, made string"
    edit_schema = _arrow(edit_ddl)

    def spelt(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for part in parts:
                for i in range(part.num_rows):
                    conv_id, first, p, initials, audit = (part.column(c)[i].as_py() for c in range(5))
                    for row, sub, edit, role in edited(audit, initials, p):
                        yield conv_id, first + row, sub, edit, role

        yield from batches(edit_schema, rows())

    edits = blocks.select("conv_id", "first", "p", "initials", "audit").mapInArrow(spelt, edit_ddl)
    held = ranked.select(F.col("pos").alias("place"), "turn", "role", "text").withColumn("sub", F.lit(2))
    turns = edits.join(held, ["place", "sub"], "left").select(
        "conv_id", F.lit(True).alias("is_turn"), "place", "sub", "turn", "edit", F.coalesce("made", "role").alias("role"),
        F.coalesce("text", F.lit("")).alias("text"), *_nulls(_REPORT),
    )
    # The audit of a conversation is one value, so its parts meet in one task, which joins them as they come.
    audit_ddl = f"conv_id {conv_type}, audit string"
    audits = _streamed(blocks, "conv_id", ["first"], ["audit"], audit_ddl, lambda values: "".join(v[0] for v in values))
    reports = reports.join(audits, reports.conv_id.eqNullSafe(audits.conv_id), "left").select(
        reports.conv_id, F.lit(False).alias("is_turn"), *_nulls(_TURN),
        "gaps", "blank", "duplicate", "truncated", "illegal", "cost", F.coalesce("audit", F.lit("")).alias("audit"),
    )
    return [turns, reports]


def _nulls(ddl: str) -> list:
    return [F.lit(None).cast(f.dataType).alias(f.name) for f in T.DataType.fromDDL(ddl).fields]


def _streamed(df: DataFrame, key: str, order: list[str], columns: list[str], ddl: str, value) -> DataFrame:
    """``value`` of an iterator over the sorted rows of each key; rows are read once and none are held."""
    schema = _arrow(ddl)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for part in parts:
                for start in range(0, part.num_rows, 1024):
                    piece = part.slice(start, 1024)
                    yield from zip(*(piece.column(i).to_pylist() for i in range(piece.num_columns)), strict=True)

        yield from batches(schema, ((k, value(r[1:] for r in group)) for k, group in itertools.groupby(rows(), key=lambda r: r[0])))

    ordered = df.repartition(key).sortWithinPartitions(key, *order)
    return ordered.select(key, *columns).mapInArrow(run, ddl)


# --- the operator -----------------------------------------------------------------------


def repair(rows: DataFrame, max_rows: int = MAX_ROWS, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """Reports and repaired turns of ``conv_id, turn, role, text, present`` (see :func:`damage` and :func:`undamaged`).

    The rows of a conversation are taken by turn (nulls first), rows of one
    turn by role and text.  A row without anything but white space is blank, one
    whose role and text came before is a duplicate, and one that does not end in
    ``.``, ``!`` or ``?`` is truncated; the first of these counts.

    * reports: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost,
      audit``, one row for every conversation; zeros and an empty audit where no
      row is present.
    * turns: ``conv_id, place, sub, turn, edit, role, text`` of what is kept,
      re-roled or inserted (``turn`` null), in order of ``place, sub``.

    A null ``conv_id`` is one more conversation.  Other columns are not read,
    and an empty table gives no rows.
    """
    stage = Stage(rows.sparkSession)
    conv_type = rows.schema["conv_id"].dataType.simpleString()
    rows = _marked(rows.select("conv_id", "turn", "role", "text", "present"))
    counted = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    large = stage.write(counted.where(F.col("n") > max_rows).select("conv_id"), "large")
    parts, small = [], rows
    if large.count():
        keys = broadcast_if_small(large)
        same = rows.conv_id.eqNullSafe(keys.conv_id)
        small = rows.join(keys, same, "left_anti")
        parts = _long(rows.join(keys, same, "left_semi"), large, conv_type, max_rows, fan, stage)
    small = small.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    found = _whole(small, conv_type)
    for part in parts:
        found = found.unionByName(part)
    found = stage.write(found, "repaired")
    for name in ("ranked", "ranged_pos", "ends", "blocks", *(f"{n}_{k}" for n in ("pieces", "chosen") for k in range(8))):
        stage.drop(name)
    reports = found.where("not is_turn").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    turns = found.where("is_turn").select("conv_id", "place", "sub", "turn", "edit", "role", "text")
    return reports, turns


def digests(reports: DataFrame, turns: DataFrame) -> DataFrame:
    """The reports with ``repaired_sha256``, of the lines ``role:text`` of each conversation in order."""

    def sha(values) -> str:
        state = hashlib.sha256()
        for k, (role, text) in enumerate(values):
            state.update((("\n" if k else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        return state.hexdigest()

    conv_type = turns.schema["conv_id"].dataType.simpleString()
    hashed = _streamed(turns, "conv_id", ["place", "sub"], ["role", "text"], f"conv_id {conv_type}, repaired_sha256 string", sha)
    empty = F.lit(hashlib.sha256().hexdigest())
    joined = reports.join(hashed, reports.conv_id.eqNullSafe(hashed.conv_id), "left").drop(hashed.conv_id)
    return joined.withColumn("repaired_sha256", F.coalesce("repaired_sha256", empty))


def oracle_sql() -> str:
    """The query in DuckDB: the best way to every row and state, one row after the other."""
    made = {"0": "U", "S": "U", "U": "A", "A": "U"}
    kept = {("0", "s"): "S", ("0", "u"): "U", ("S", "u"): "U", ("A", "u"): "U", ("U", "a"): "A"}
    moves = []
    for q in "0SUA":
        at = q
        for k in range(3):  # so many inserts before the row
            moves += [(q, f"'{c}'", "I" * k + "K", b, 3 * k, 0) for (a, c), b in kept.items() if a == at]
            moves += [(q, "null", "I" * k + "R", made[at], 3 * k + 3, 0), (q, "null", "I" * k + "D", at, 3 * k + 4, 1)]
            at = made[at]
    table = ", ".join(f"('{q}', {c}, '{x}', '{b}', {n}, {d})" for q, c, x, b, n, d in moves)
    white = r"\x20\x09-\x0D"
    return rf"""with recursive k as (select conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') text,
        xor(list_reduce([4294967295]::bigint[] || list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':'
        || coalesce(turn::varchar, ' '), ''), lambda x: ascii(x)::bigint), lambda c, b: list_reduce([xor(c, b), 1, 1, 1, 1, 1, 1, 1, 1],
        lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 d from conversations),
        r as (select conv_id, turn, if(d = 4, 'user', role) role, case d when 1 then '' when 2
              then regexp_replace(text, '[.!?]', '', 'g') else text end text
              from k, (select unnest([0, 1]) c) where d <> 0 and (c = 0 or d = 3)),
        o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) i from r),
        s as (select *, substr(role, 1, 1) c,
              row_number() over (partition by conv_id, role, text order by i) again,
              regexp_extract(text, '([^{white}])[{white}]*$', 1) fin from o),
        f as (select *, case when fin = '' then 'b' when again > 1 then 'd' when fin not in ('.', '!', '?') then 't' else '.' end f,
              lag(c) over (partition by conv_id order by i) before from s),
        g as (select distinct conv_id from conversations),
        stat as (select g.conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps,
              count(*) filter (f = 'b') blank, count(*) filter (f = 'd') duplicate, count(*) filter (f = 't') truncated,
              count(*) filter (before is not null and before || c not in ('su', 'ua', 'au')) illegal
              from g left join f on g.conv_id is not distinct from f.conv_id group by 1),
        m(q, c, x, b, n, gone) as (values {table}),
        w(conv_id, i, q, cost, audit) as (select conv_id, 0::bigint, '0', 0::bigint, '' from g union all
              select conv_id, i, q, cost, audit from (
              select w.conv_id, f.i, m.b q, w.cost + m.n + if(f.f = 't' and m.gone = 0, 3, 0) cost, w.audit || m.x audit,
              row_number() over (partition by w.conv_id, f.i, m.b order by w.cost + m.n + if(f.f = 't' and m.gone = 0, 3, 0), w.audit || m.x) p
              from w join f on w.conv_id is not distinct from f.conv_id and f.i = w.i + 1
              join m on m.q = w.q and (m.c is null or m.c = f.c) and (m.gone = 1 or f.f not in ('b', 'd'))) where p = 1),
        z as (select conv_id, cost + case q when 'U' then 3 when 'S' then 6 else 0 end cost,
              audit || case q when 'U' then 'I' when 'S' then 'II' else '' end audit,
              i, max(i) over (partition by conv_id) n from w),
        best as (select conv_id, cost, audit, n from z where i = n
              qualify row_number() over (partition by conv_id order by cost, audit) = 1),
        t as (select b.conv_id, p, substr(audit, p::int, 1) e,
              len(replace(substr(audit, 1, p::int), 'I', '')) + if(substr(audit, p::int, 1) = 'I', 1, 0) i
              from best b, (select unnest(range(1, 20000)) p) where p <= len(audit)),
        e as (select t.*, f.role, f.text from t left join f on f.conv_id is not distinct from t.conv_id and f.i = t.i and t.e <> 'I'
              where t.e <> 'D'),
        v as (select *, row_number() over (partition by conv_id order by p) - count(*) filter (e = 'K' and role[1] = 's')
              over (partition by conv_id) as place from e),
        h as (select conv_id, sha256(string_agg(case when e = 'K' then role when place % 2 = 1 then 'user' else 'assistant' end
              || ':' || if(e = 'I', '', text), chr(10) order by p)) h from v group by 1)
        select stat.conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, coalesce(h, sha256('')) repaired_sha256
        from stat join best on stat.conv_id is not distinct from best.conv_id
        left join h on h.conv_id is not distinct from stat.conv_id"""
