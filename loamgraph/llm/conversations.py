"""Conversation structure repair: the cheapest edits of every conversation, by a bidirectional shortest-path graph over its turns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from .common import stored

#: A piece of a conversation has at most so many rows, and about so many bytes of text.
PIECE_ROWS, PIECE_BYTES = 1 << 16, 1 << 24
#: What the edits cost; leaving a truncated row costs as much as inserting one.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
FAR = 1 << 60

# The states of the accepted sequence `(s?(ua)+)?`: nothing yet, after the s, after a u, after an a. The first and the last may end it.
NEXT = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
#: The role that a state expects of an inserted or reroled row, and where that leads.
ASKS = [("user", 2), ("user", 2), ("assistant", 3), ("user", 2)]

#: A row's code is a letter for its role's initial (or none of s, u, a) and its fault (none, truncated, blank, duplicate).
INITIALS, FAULTS = "sua-", ["", "truncated", "blank", "duplicate"]
CODES = "abcdefghijklmnop"
FINE, CUT, BLANK, AGAIN = range(4)

Vector = tuple[int, int, int, int]
START: Vector = (0, FAR, FAR, FAR)
#: The cost from each state to an accepted end by insertions alone.
END: Vector = (0, 2 * INSERT, INSERT, 0)


@lru_cache(maxsize=None)
def row_arcs(code: str, state: int) -> tuple[tuple[str, int, int], ...]:
    """(edit's initial, cost, next state) of each way past a row."""
    initial, fault = INITIALS[CODES.index(code) // 4], CODES.index(code) % 4
    arcs = [("D", DELETE, state)]
    if fault in (FINE, CUT):
        extra = TRUNCATED if fault == CUT else 0
        if (initial, state) in NEXT:
            arcs.append(("K", extra, NEXT[initial, state]))
        arcs.append(("R", REROLE + extra, ASKS[state][1]))
    return tuple(arcs)


def inserted(costs: Vector) -> Vector:
    """Least costs up to each state when rows may be inserted; two in a row are enough, a third leads back."""
    at = list(costs)
    for _ in range(2):
        for q in range(4):
            at[ASKS[q][1]] = min(at[ASKS[q][1]], at[q] + INSERT)
    return tuple(min(c, FAR) for c in at)


def forward(code: str, first: Vector = START) -> list[Vector]:
    """Least costs up to each place between rows and each state there, from those at the first place."""
    out = [inserted(first)]
    for c in code:
        past = [FAR] * 4
        for q in range(4):
            for _, cost, to in row_arcs(c, q):
                past[to] = min(past[to], out[-1][q] + cost)
        out.append(inserted(past))
    return out


def backward(code: str, last: Vector = END) -> list[Vector]:
    """Least costs from each place and state to the end, from those at the last place, insertions there included."""
    out = [last]
    for c in reversed(code):
        rest = [min(cost + out[-1][to] for _, cost, to in row_arcs(c, q)) for q in range(4)]
        for _ in range(2):
            rest = [min(rest[q], INSERT + rest[ASKS[q][1]]) for q in range(4)]
        out.append(tuple(min(c, FAR) for c in rest))
    return out[::-1]


def optimal_edits(code: str, ahead: list[Vector], behind: list[Vector], total: int, start: int, last: bool) -> tuple[str, int]:
    """(edits' initials, final state): of all cheapest paths from `start` the one whose edits come first in ASCII.

    An arc is tight when the least cost up to it, its own and the least cost after it add up to the total. The frontier holds the states that the
    chosen letters may have led to; each step takes the least letter of a tight arc that leaves it. A piece that is not the
    conversation's last ends with its last row; insertions there belong to the next piece.
    """
    frontier, letters, i = {start}, [], 0
    while True:
        if i == len(code):
            ended = [q for q in frontier if not last or behind[i][q] == 0]
            if ended:
                return "".join(letters), ended[0]
        tight: dict[str, set[int]] = {}
        for q in frontier:
            for letter, cost, to in (*(row_arcs(code[i], q) if i < len(code) else ()), ("I", INSERT, ASKS[q][1])):
                if ahead[i][q] + cost + behind[i + (letter != "I")][to] == total:
                    tight.setdefault(letter, set()).add(to)
        letter = min(tight)
        frontier = tight[letter]
        letters.append(letter)
        i += letter != "I"


def solve(code: str) -> tuple[int, str]:
    """(cost, edits) of a whole conversation."""
    behind = backward(code)
    total = behind[0][0]
    return total, optimal_edits(code, forward(code), behind, total, 0, True)[0]


#: Longer conversations are not remembered by a worker.
SHORT = 64
_solve_short = lru_cache(maxsize=1 << 16)(solve)


def apply_edits(code: str, edits: str, state: int, roles: list[str], texts: list[str]) -> tuple[list[str], list[str]]:
    """Roles and texts after the edits. roles and texts are those of the rows that are neither blank nor duplicate, in order."""
    out_roles, out_texts = [], []
    row = held = 0
    for letter in edits:
        if letter == "I":
            role, state = ASKS[state]
            out_roles.append(role)
            out_texts.append("")
            continue
        own = CODES.index(code[row]) % 4 in (FINE, CUT)
        if letter == "K":
            out_roles.append(roles[held])
            out_texts.append(texts[held])
            state = NEXT[INITIALS[CODES.index(code[row]) // 4], state]
        elif letter == "R":
            role, state = ASKS[state]
            out_roles.append(role)
            out_texts.append(texts[held])
        held += own
        row += 1
    return out_roles, out_texts


def faults(code: str) -> tuple[int, int, int, int]:
    """(blank, duplicate, truncated, illegal neighbours) of rows."""
    places = [CODES.index(c) for c in code]
    each = [p % 4 for p in places]
    first = "".join(INITIALS[p // 4] for p in places)
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
    return each.count(BLANK), each.count(AGAIN), each.count(CUT), illegal


def _spaced(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


#: Columns of rows inside this module; the caller's own columns are left behind first.
ROW = ["conv_id", "turn", "role", "text", "lost"]


def plain_rows(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """ROW of conversations: null roles and texts are one space, nothing is lost."""
    return rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), _spaced(role_col).alias("role"), _spaced(text_col).alias("text"), F.lit(False).alias("lost"))


def damaged_rows(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """ROW of conversations damaged by crc32(`conv_id:turn`) modulo 20: 0 loses the row, 1 empties its text, 2 takes its `[.!?]` away, 3 repeats it, 4 makes its role user.

    A lost row stays as a row that only names its conversation.
    """
    kind = F.crc32(F.concat(_spaced(conv_col), F.lit(":"), _spaced(turn_col)).cast("binary")) % 20
    own = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), _spaced(role_col).alias("role"), _spaced(text_col).alias("text"), kind.alias("kind"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    once = own.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("lost"), "kind")
    return once.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))).select(ROW)


#: The order of a conversation's rows: null turns first, ties by role, then by the text's SHA-256. Equal rows are one run.
ORDER = ["conv_id", "lost", "late", "turn", "role", "digest"]


def _runs(rows: DataFrame) -> DataFrame:
    """ORDER, n, text, initial, fault: the runs of equal rows of a conversation, and the fault of a run's first row; its others are duplicates, or blank.

    The first place of each role and text is found on digests, so texts move once here; equal rows combine before they move.
    """
    lost = lambda value, c: F.when(F.col("lost"), F.lit(value)).otherwise(F.col(c)).alias(c)
    own = rows.select("conv_id", "lost", lost(None, "turn"), lost("", "role"), lost("", "text"))
    own = own.select("conv_id", "lost", F.col("turn").isNotNull().alias("late"), "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), "text")
    first = own.where("not lost").groupBy("conv_id", "role", "digest").agg(F.min(F.struct("late", "turn")).alias("at"))
    first = first.select("conv_id", F.lit(False).alias("lost"), "at.late", "at.turn", "role", "digest", F.lit(None).cast("string").alias("text"), F.lit(0).alias("n"), F.lit(True).alias("first"))
    both = own.withColumns({"n": F.when(F.col("lost"), 0).otherwise(1), "first": F.lit(False)}).unionByName(first)
    runs = both.groupBy(*ORDER).agg(F.sum("n").alias("n"), F.max("first").alias("first"), F.max("text").alias("text"))
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    fault = F.when(blank, BLANK).when(~F.col("first"), AGAIN).when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), CUT).otherwise(FINE)
    initial = F.instr(F.lit(INITIALS[:3]), F.substring("role", 1, 1)) - 1
    # An empty role is found at place 1 of any text.
    initial = F.when((F.col("role") == "") | (initial < 0), 3).otherwise(initial)
    return runs.select(*ORDER, "n", initial.cast("int").alias("initial"), fault.cast("int").alias("fault"), F.when(fault.isin(BLANK, AGAIN), "").otherwise(F.col("text")).alias("text"))


#: What is said of a conversation as a whole.
REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

#: A piece: where it is, whether it is a whole conversation, its codes and turns, then of a whole one the report, the roles and texts after its edits and these; of others a matrix of costs, and the roles and texts that may stay.
PIECE = [("part", "int"), ("no", "int"), ("whole", "boolean"), ("code", "string"), ("lo", "long"), ("hi", "long"), ("turns", "long"), ("matrix", "array<long>"), *((c, "long") for c in REPORT), ("roles", "array<string>"), ("texts", "array<string>"), ("edits", "string")]


class _Open:
    """The piece of a conversation that a task is reading."""

    def __init__(self, conv):
        self.conv = conv
        self.clear()

    def clear(self) -> None:
        self.code: list[str] = []
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.size, self.lo, self.hi, self.turns = 0, None, None, 0

    def row(self, part: int, no: int, whole: bool) -> tuple:
        code = "".join(self.code)
        if whole:
            cost, edits = _solve_short(code) if len(code) <= SHORT else solve(code)
            gaps = self.hi - self.lo + 1 - self.turns if self.lo is not None else 0
            roles, texts = apply_edits(code, edits, 0, self.roles, self.texts)
            return self.conv, part, no, True, code, self.lo, self.hi, self.turns, None, gaps, *faults(code), cost, roles, texts, edits
        matrix = [c for q in range(4) for c in forward(code, tuple(0 if i == q else FAR for i in range(4)))[-1]]
        return self.conv, part, no, False, code, self.lo, self.hi, self.turns, matrix, *[None] * len(REPORT), self.roles, self.texts, None


def _pieces(rows: DataFrame, piece_rows: int) -> DataFrame:
    """conv_id and PIECE of conversations whose rows are sorted over all partitions.

    A conversation that begins and ends inside one partition, and fits a piece, is whole and solved at once. The others (the first and last of a
    partition, and any that is longer) come as pieces in the order (part, no), with a matrix of the least costs from each state to each.
    """
    runs = _runs(rows)
    kind = runs.schema["conv_id"].dataType
    order = [F.col(c).asc_nulls_first() for c in ORDER]
    dealt = runs.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "n", "initial", "fault", F.spark_partition_id().alias("part"))
    schema = StructType([StructField("conv_id", kind), *StructType.fromDDL(", ".join(f"{name} {type_}" for name, type_ in PIECE)).fields])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Open | None = None
        part = no = cuts = seen = 0
        out, size = [], 0

        def closed(last: bool) -> None:
            nonlocal no, size
            size += now.size
            out.append(now.row(part, no, cuts == 0 and seen > 1 and not last))
            no += 1

        def batch_out() -> pa.RecordBatch:
            nonlocal out, size
            columns = list(zip(*out, strict=True)) if out else [()] * len(arrow)
            out, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for batch in batches:
            for conv, turn, role, text, n, initial, fault, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):  # noqa: B007
                if now is None or conv != now.conv:
                    if now is not None:
                        closed(False)
                    now, cuts, seen = _Open(conv), 0, seen + 1
                for i in range(n):
                    if len(now.code) >= piece_rows or now.size >= PIECE_BYTES:
                        cuts += 1
                        closed(False)
                        now.clear()
                    own = fault if i == 0 or fault == BLANK else AGAIN
                    now.code.append(CODES[4 * initial + own])
                    if turn is not None and turn != now.hi:
                        now.turns += 1
                        now.lo, now.hi = turn if now.lo is None else now.lo, turn
                    if own in (FINE, CUT):
                        now.roles.append(role)
                        now.texts.append(text)
                        now.size += len(text)
                if len(out) >= 1024 or size >= PIECE_BYTES:
                    yield batch_out()
        if now is not None:
            closed(True)
        yield batch_out()

    return dealt.mapInArrow(run, schema)


def _sweep(table: pa.Table) -> pa.Table:
    """Of one conversation's pieces, by their summaries: the costs up to and after each, and the conversation's REPORT."""
    table = table.sort_by([("part", "ascending"), ("no", "ascending")])
    rows = table.to_pylist()
    ahead, behind = [START], [END]
    for r in rows:
        m = np.array(r["matrix"]).reshape(4, 4)
        ahead.append(tuple(int(min(c, FAR)) for c in (np.array(ahead[-1])[:, None] + m).min(axis=0)))
    for r in reversed(rows):
        m = np.array(r["matrix"]).reshape(4, 4)
        behind.append(tuple(int(min(c, FAR)) for c in (m + np.array(behind[-1])[None]).min(axis=1)))
    behind = behind[::-1]
    sums = [sum(r[c] for r in rows) for c in ("blank", "duplicate", "truncated", "illegal")]
    first, last, turns, before = None, None, 0, None
    for r in rows:
        if r["first"] and before:
            sums[3] += before + r["first"] not in ("su", "ua", "au")
        before = r["last"] or before
        if r["lo"] is not None:
            first = r["lo"] if first is None else first
            turns += r["turns"] - (r["lo"] == last)
            last = r["hi"]
    report = [last - first + 1 - turns if first is not None else 0, *sums, behind[0][0]]
    n = len(rows)
    longs = pa.list_(pa.int64())
    return pa.table(
        {
            "part": table.column("part"),
            "no": table.column("no"),
            "ahead": pa.array(ahead[:n], longs),
            "behind": pa.array(behind[1:], longs),
            "final": pa.array([i == n - 1 for i in range(n)]),
            **{c: pa.array([v] * n, pa.int64()) for c, v in zip(REPORT, report, strict=True)},
        }
    )


def _paths(code: str, ahead: list[int], behind: list[int], cost: int, final: bool, start: int) -> tuple[str, int]:
    before, after = forward(code, tuple(ahead)), backward(code, tuple(behind))
    return optimal_edits(code, before, after, cost, start, final)


def _join_pieces(open_: DataFrame) -> DataFrame:
    """Pieces of conversations that are not whole, solved across pieces: matrices give the costs at each piece's ends, then each piece tells where each state would lead, then the pieces' paths are chained."""
    counts = ["blank", "duplicate", "truncated", "illegal"]

    def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column("code").to_pylist()
            found = [faults(c) for c in codes]
            ends = [(INITIALS[CODES.index(c[0]) // 4], INITIALS[CODES.index(c[-1]) // 4]) if c else ("", "") for c in codes]
            columns = [pa.array([r[i] for r in found], pa.int64()) for i in range(4)] + [pa.array([e[i] for e in ends], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "part", "no", "lo", "hi", "turns", "matrix")), *columns], ["conv_id", "part", "no", "lo", "hi", "turns", "matrix", *counts, "first", "last"])

    kind = open_.schema["conv_id"].dataType.simpleString()
    light = open_.select("conv_id", "part", "no", "code", "lo", "hi", "turns", "matrix")
    summaries = light.mapInArrow(summarize, f"conv_id {kind}, part int, no int, lo long, hi long, turns long, matrix array<long>, {', '.join(f'{c} long' for c in counts)}, first string, last string")
    ends = stored(summaries.groupBy("conv_id").applyInArrow(_sweep, "part int, no int, ahead array<long>, behind array<long>, final boolean, " + ", ".join(f"{c} long" for c in REPORT)))

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for code, ahead, behind, cost, final in zip(*(batch.column(c).to_pylist() for c in ("code", "ahead", "behind", "cost", "final")), strict=True):
                at = backward(code, tuple(behind))[0]
                out.append([_paths(code, ahead, behind, cost, final, q)[1] if ahead[q] + at[q] == cost else -1 for q in range(4)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "part", "no")), pa.array(out, pa.list_(pa.int32()))], ["conv_id", "part", "no", "leads"])

    def chain(table: pa.Table) -> pa.Table:
        table = table.sort_by([("part", "ascending"), ("no", "ascending")])
        state, starts = 0, []
        for leads in table.column("leads").to_pylist():
            starts.append(state)
            state = leads[state]
        return pa.table({"part": table.column("part"), "no": table.column("no"), "start": pa.array(starts, pa.int32())})

    told = open_.drop("edits", *REPORT).join(ends, ["part", "no"])
    leads = told.select("conv_id", "part", "no", "code", "ahead", "behind", "cost", "final").mapInArrow(lead, f"conv_id {kind}, part int, no int, leads array<int>")
    starts = leads.groupBy("conv_id").applyInArrow(chain, "part int, no int, start int")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for code, ahead, behind, cost, final, start, roles, texts in zip(*(batch.column(c).to_pylist() for c in ("code", "ahead", "behind", "cost", "final", "start", "roles", "texts")), strict=True):
                edits = _paths(code, ahead, behind, cost, final, start)[0]
                out.append((*apply_edits(code, edits, start, roles, texts), edits))
            columns = list(zip(*out, strict=True)) if out else [()] * 3
            strings = pa.list_(pa.string())
            kept = [batch.column(c) for c in ("conv_id", "part", "no", "whole", *REPORT)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(columns[0], strings), pa.array(columns[1], strings), pa.array(columns[2], pa.string())], ["conv_id", "part", "no", "whole", *REPORT, "roles", "texts", "edits"])

    longs = ", ".join(f"{c} long" for c in REPORT)
    return told.join(starts, ["part", "no"]).mapInArrow(finish, f"conv_id {kind}, part int, no int, whole boolean, {longs}, roles array<string>, texts array<string>, edits string")


def repair(rows: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """The pieces of every repaired conversation: conv_id, part, no (their order), whole, gaps, blank, duplicate, truncated, illegal, cost (the conversation's), roles, texts, edits (the piece's).

    rows: as plain_rows() gives them. A conversation's rows are taken by turn, null turns first, ties by role and the text's SHA-256. A row's
    first fault counts: blank (no character but white space), duplicate (an earlier row has its role and text), truncated (its last such
    character is none of `.!?`). gaps: turns missing between the smallest and the largest. illegal: neighbours whose roles' initials are not su, ua or au.

    Edits: Keep 0, Rerole to user or assistant 1, Delete 2 (blank and duplicate rows must go), Insert an empty row of user or assistant 5; a truncated row
    that stays adds 5. They give role initials `(s?(ua)+)?` at the least cost, and of all such the edits whose initials come first in ASCII. A row whose
    role is empty or has another initial can't be kept as it is.

    Rows are sorted over all partitions, so a conversation of any length is spread; its pieces meet as matrices of costs only. Runs of equal rows are one row
    with a count before they are sorted. A null id is a conversation of its own; lost rows only name theirs, which
    then has zeros and no edits. An empty table gives no rows.
    """
    pieces = stored(_pieces(rows, piece_rows))
    whole = pieces.where("whole").select("conv_id", "part", "no", "whole", *REPORT, "roles", "texts", "edits")
    return whole.unionByName(_join_pieces(pieces.where("not whole")))


def repaired_turns(pieces: DataFrame) -> DataFrame:
    """conv_id, turn (from 0), role, text of repaired conversations."""
    before = Window.partitionBy("conv_id").orderBy("part", "no").rowsBetween(Window.unboundedPreceding, -1)
    from_ = pieces.withColumn("from", F.coalesce(F.sum(F.size("roles")).over(before), F.lit(0)))
    each = from_.select("conv_id", "from", F.posexplode(F.arrays_zip("roles", "texts")).alias("i", "row"))
    return each.select("conv_id", (F.col("from") + F.col("i")).cast("long").alias("turn"), F.col("row.roles").alias("role"), F.col("row.texts").alias("text"))


def repair_report(rows: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """One row per conversation of repair(): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit (the edits' initials), repaired_sha256 (of `role:text` lines).

    The digest of a conversation in several pieces is taken over them in order, a piece at a time; its audit is one text, as asked.
    """
    pieces = stored(repair(rows, piece_rows))
    lines = F.concat_ws("\n", F.transform(F.arrays_zip("roles", "texts"), lambda r: F.concat(r["roles"], F.lit(":"), r["texts"])))
    columns = ["conv_id", *REPORT, F.col("edits").alias("audit")]
    whole = pieces.where("whole").select(*columns, F.sha2(lines, 256).alias("repaired_sha256"))
    rest = pieces.where("not whole").select("conv_id", "part", "no", *REPORT, "edits", F.when(F.size("roles") > 0, lines).alias("lines"))
    kind = rows.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, audit, blank = None, None, [], True

        def out() -> pa.RecordBatch:
            values = [now[0], *now[1], "".join(audit), digest.hexdigest()]
            kinds = [to_arrow_type(kind), *[pa.int64()] * len(REPORT), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["conv_id", *REPORT, "audit", "repaired_sha256"])

        for batch in batches:
            for r in batch.to_pylist():
                if now is None or r["conv_id"] != now[0]:
                    if now is not None:
                        yield out()
                    now, digest, audit, blank = (r["conv_id"], [r[c] for c in REPORT]), hashlib.sha256(), [], True
                audit.append(r["edits"])
                if r["lines"] is not None:
                    digest.update((r["lines"] if blank else "\n" + r["lines"]).encode())
                    blank = False
        if now is not None:
            yield out()

    joined = rest.repartition("conv_id").sortWithinPartitions("conv_id", "part", "no")
    return whole.unionByName(joined.mapInArrow(run, whole.schema))
