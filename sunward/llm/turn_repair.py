"""Conversation structure repair by divide and conquer (operator 11).

A conversation is edited at least cost until its roles read as an optional system turn and then
pairs of user and assistant. Four states say what a prefix of the result may end with: nothing,
system, user, assistant. Which letter of the audit is next and which state it leaves decide the
state it leads to, so an audit fixes its result, and no optimal audit is the beginning of another.

A cut in the middle of a stretch is crossed in one of the four states. A vector of costs from the
left and one from the right meet there; of the states on an optimal path the one whose left audit
is least in ASCII order is taken (vectors carry the ranks of these audits, not the audits), and
both halves go on by themselves. Only vectors of four are ever held.

The same holds for stretches of any size, so a conversation is cut into chunks of fixed size
whose 4 x 4 tables of costs and ranks are combined in levels, without a bound on one
conversation's rows. Only its hash and its audit, which are one value, need all its rows in a row:
they are streamed through one task, sorted by Spark.
"""

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import union
from .shared import arrow_pass, release, stored

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEVER = 1 << 60
#: Costs of edits, and what an undeleted truncated row adds.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Where an inserted or re-roled turn leads to from each state.
NEXT = (USER, USER, ASSISTANT, USER)
#: Edits up to and with one row, in ASCII order; more than two insertions in a row never pay.
EDITS = ("D", "ID", "IID", "IIK", "IIR", "IK", "IR", "K", "R")
#: Insertions that end a conversation left in each state.
ENDINGS = ("", "II", "I", "")
#: A row's code: its role's initial (s, u, a or another) and whether it is sound, truncated or has to go.
SOUND, CUT, GONE = range(3)
INITIALS = ("s", "u", "a")
#: Rows of a chunk, and nodes that one node of the next level holds, as powers of two.
CHUNK_BITS, FAN_BITS = 12, 10


def keep_to(initial: int, state: int):
    """Where keeping a row leads to, or None."""
    if initial == 0:
        return SYSTEM if state == NOTHING else None
    if initial == 1:
        return None if state == USER else USER
    return ASSISTANT if initial == 2 and state == USER else None


def row_table(code: int) -> tuple:
    """For each state before and after a row: the least cost and, of its edits, the place in EDITS."""
    initial, fault = divmod(code, 3)
    table = [[(NEVER, 0)] * 4 for _ in range(4)]
    for start in range(4):
        for place, edit in enumerate(EDITS):
            state, cost = start, INSERT * edit.count("I")
            for _ in range(edit.count("I")):
                state = NEXT[state]
            if edit[-1] == "D":
                cost += DELETE
            elif fault == GONE:
                continue
            elif edit[-1] == "K":
                state, cost = keep_to(initial, state), cost + KEEP + TRUNCATED * (fault == CUT)
            else:
                state, cost = NEXT[state], cost + REROLE + TRUNCATED * (fault == CUT)
            if state is not None and cost < table[start][state][0]:
                table[start][state] = (cost, place)
    return tuple(map(tuple, table))


ROW_TABLES = tuple(row_table(code) for code in range(12))


def forward(steps, start: int) -> list:
    """For each state after ``steps``: least cost from ``start`` and the rank of its least audit."""
    at = [(0 if s == start else NEVER, 0) for s in range(4)]
    for table in steps:
        best = [min((at[p][0] + table[p][q][0], at[p][1], table[p][q][1]) for p in range(4)) for q in range(4)]
        order = sorted(range(4), key=lambda q: best[q][1:] if best[q][0] < NEVER else (NEVER,))
        at = [(min(best[q][0], NEVER), order.index(q)) for q in range(4)]
    return at


def backward(steps, end: int) -> list:
    """For each state before ``steps``: the least cost to ``end``."""
    to = [0 if s == end else NEVER for s in range(4)]
    for table in reversed(steps):
        to = [min(NEVER, min(table[p][q][0] + to[q] for q in range(4))) for p in range(4)]
    return to


def combined(steps) -> tuple:
    """The table of all ``steps`` together."""
    return tuple(tuple(forward(steps, p)) for p in range(4))


def crossings(steps, start: int, end: int) -> list[int]:
    """The states after each step on the audit-least of the cheapest ways from ``start`` to ``end``."""
    out, open_ = [end] * len(steps), [(0, len(steps), start, end)]
    while open_:
        i, j, p, q = open_.pop()
        if j - i < 2:
            continue
        middle = (i + j) // 2
        left, right = forward(steps[i:middle], p), backward(steps[middle:j], q)
        state = min(range(4), key=lambda s: (left[s][0] + right[s], left[s][1]))
        out[middle - 1] = state
        open_ += [(i, middle, p, state), (middle, j, state, q)]
    return out


def best_end(table) -> int:
    """The state a whole conversation with this table is left in before the insertions that end it."""
    return min(range(4), key=lambda q: (table[NOTHING][q][0] + INSERT * len(ENDINGS[q]), table[NOTHING][q][1]))


def edits(codes: bytes, start: int, end: int | None) -> list[int]:
    """For each row the place of its edits in EDITS."""
    steps = [ROW_TABLES[c] for c in codes]
    if end is None:
        end = best_end((forward(steps, NOTHING),))
    states = [start, *crossings(steps, start, end)]
    return [table[p][q][1] for table, p, q in zip(steps, states, states[1:])]


@lru_cache(1 << 14)
def short_edits(codes: bytes, start: int, end: int | None) -> list[int]:
    """Most conversations are short and of few shapes."""
    return edits(codes, start, end)


def flat(table) -> list[int]:
    return [x for row in table for cell in row for x in cell]


def unflat(numbers) -> tuple:
    return tuple(tuple((numbers[8 * p + 2 * q], numbers[8 * p + 2 * q + 1]) for q in range(4)) for p in range(4))


def in_order(rows: DataFrame) -> DataFrame:
    """Stored: conv, turn, role, text, id (ascending in a conversation's order), code without duplicates, print.

    Rows of one conversation come by turn (NULL first), role and text; equal rows in any order.
    Range partitions split conversations of any size, equal rows too.
    """
    role, text = F.coalesce(F.col("role"), F.lit(" ")), F.coalesce(F.col("text"), F.lit(" "))
    plain = rows.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.monotonically_increasing_id().alias("tie"))
    order = ("conv", "turn", "role", "text", "tie")
    last = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    fault = F.when(last == "", GONE).when(last.isin(".", "!", "?"), SOUND).otherwise(CUT)
    initial = F.substring("role", 1, 1)
    code = F.coalesce(*[F.when(initial == x, i) for i, x in enumerate(INITIALS)], F.lit(3)) * 3 + fault
    # a length before the role keeps role and text apart
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    sorted_rows = plain.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(sorted_rows.select("conv", "turn", "role", "text", F.monotonically_increasing_id().alias("id"), code.cast("int").alias("code"), digest.alias("print")), "turns")


def chunks_of(ordered: DataFrame) -> DataFrame:
    """Stored: conv, key, rows (id, code, fault in order); a chunk has at most 2^CHUNK_BITS rows."""
    # the first row of each message, by its unique id, so that no join has a heavy key
    first = ordered.groupBy("conv", "print").agg(F.min("id").alias("id")).select("id", F.lit(True).alias("first"))
    known = ordered.select("conv", "id", "code").join(first, "id", "left")
    gone = F.col("first").isNull() & (F.col("code") % 3 != GONE)
    fault = F.when(F.col("code") % 3 == GONE, "blank").when(gone, "duplicate").when(F.col("code") % 3 == CUT, "truncated")
    code = F.when(gone, F.col("code") - F.col("code") % 3 + GONE).otherwise(F.col("code"))
    row = F.struct("id", code.cast("int").alias("code"), fault.alias("fault"))
    out = known.groupBy("conv", F.shiftright("id", CHUNK_BITS).alias("key")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    return stored(out, "turn-chunks")


def tables_of(nodes: DataFrame, children: str, conv: str) -> DataFrame:
    """conv, key, table of each node: of its rows' codes, or of the tables below it."""
    def scan(batches):
        for batch in batches:
            steps = [[ROW_TABLES[c["code"]] for c in own] if children == "rows" else [unflat(c["table"]) for c in own] for own in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([flat(combined(s)) for s in steps], pa.list_(pa.int64()))], ["conv", "key", "table"])

    return arrow_pass(nodes.select("conv", "key", children), scan, f"conv {conv}, key long, table array<long>")


def bounds_below(nodes: DataFrame, conv: str) -> DataFrame:
    """The states before and after each child of ``nodes`` (conv, children, start, end; end NULL: a whole conversation)."""
    def scan(batches):
        for batch in batches:
            convs, keys, starts, ends = [], [], [], []
            for c, own, start, end in zip(batch.column(0), *(batch.column(i).to_pylist() for i in (1, 2, 3))):
                steps = [unflat(x["table"]) for x in own]
                states = crossings(steps, start, best_end((forward(steps, start),)) if end is None else end)
                convs += [c] * len(own)
                keys += [x["key"] for x in own]
                starts += [start, *states[:-1]]
                ends += states
            yield pa.RecordBatch.from_arrays([pa.array([c.as_py() for c in convs], batch.column(0).type), pa.array(keys, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["conv", "key", "start", "end"])

    return arrow_pass(nodes.select("conv", "children", "start", "end"), scan, f"conv {conv}, key long, start int, end int")


def same_conv(left: DataFrame, right: DataFrame, how: str, key=False) -> DataFrame:
    """Join by conversation (NULL is one) and, if asked, by node."""
    names = ["conv"] + ["key"] * key
    other = right.select(*[F.col(c).alias(f"{c}_below") if c in names else F.col(c) for c in right.columns])
    match = F.col("conv").eqNullSafe(F.col("conv_below"))
    return left.join(other, match & (F.col("key") == F.col("key_below")) if key else match, how).drop("conv_below", "key_below")


def chunk_bounds(chunks: DataFrame, conv: str) -> DataFrame | None:
    """conv, key, start, end of the chunks of conversations that have several; None if none has."""
    several = lambda nodes: nodes.groupBy("conv").agg(F.count(F.lit(1)).alias("nodes")).filter("nodes > 1").select("conv")
    multi = stored(several(chunks), "turn-multi")
    if multi.isEmpty():
        release(multi)
        return None
    below, levels = tables_of(same_conv(chunks, multi, "left_semi"), "rows", conv), []
    while True:
        child = F.struct("key", "table")
        nodes = below.groupBy("conv", F.shiftright("key", FAN_BITS).alias("key")).agg(F.sort_array(F.collect_list(child)).alias("children"))
        levels.append(stored(nodes, "turn-level"))
        if several(levels[-1]).isEmpty():
            break
        below = tables_of(levels[-1], "children", conv)
    bounds = None
    for nodes in reversed(levels):
        if bounds is None:
            above = nodes.select("conv", "children", F.lit(NOTHING).alias("start"), F.lit(None).cast("int").alias("end"))
        else:
            above = same_conv(nodes, bounds, "inner", key=True)
        bounds = bounds_below(above, conv)
    out = stored(bounds, "turn-bounds")
    release(multi, *levels)
    return out


def row_edits(chunks: DataFrame, bounds: DataFrame | None, conv: str) -> DataFrame:
    """conv, id, edits, fault of every row."""
    if bounds is None:
        placed = chunks.select("conv", "rows", F.lit(NOTHING).alias("start"), F.lit(None).cast("int").alias("end"))
    else:
        placed = same_conv(chunks, bounds, "left", key=True).select("conv", "rows", F.coalesce("start", F.lit(NOTHING)).alias("start"), "end")

    def scan(batches):
        for batch in batches:
            convs, ids, letters, faults = [], [], [], []
            for c, own, start, end in zip(*(batch.column(i).to_pylist() for i in range(4))):
                codes = bytes(x["code"] for x in own)
                convs += [c] * len(own)
                ids += [x["id"] for x in own]
                letters += [EDITS[e] for e in (short_edits if len(codes) <= 16 else edits)(codes, start, end)]
                faults += [x["fault"] for x in own]
            yield pa.RecordBatch.from_arrays([pa.array(convs, batch.column(0).type), pa.array(ids, pa.int64()), pa.array(letters), pa.array(faults, pa.string())], ["conv", "id", "edits", "fault"])

    return arrow_pass(placed, scan, f"conv {conv}, id long, edits string, fault string")


class Report:
    """What is told of one conversation, row by row."""

    def __init__(self, conv):
        self.conv, self.turns, self.first, self.last = conv, 0, None, None
        self.faults = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.illegal, self.before = 0, None
        self.cost, self.audit, self.state = 0, [], NOTHING
        self.hash, self.some = hashlib.sha256(), False

    def say(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.some else "") + role + ":").encode())
        self.hash.update(text.encode())
        self.some = True

    def insert(self, times: int) -> None:
        for _ in range(times):
            self.state = NEXT[self.state]
            self.cost += INSERT
            self.say("user" if self.state == USER else "assistant", "")

    def add(self, turn, role, text, letters, fault) -> None:
        if turn is not None and turn != self.last:
            self.turns += 1
            self.first, self.last = turn if self.first is None else self.first, turn
        if fault is not None:
            self.faults[fault] += 1
        initial = role[:1]
        self.illegal += self.before is not None and self.before + initial not in ("su", "ua", "au")
        self.before = initial
        self.audit.append(letters)
        self.insert(len(letters) - 1)
        if letters[-1] == "D":
            self.cost += DELETE
            return
        self.cost += (REROLE if letters[-1] == "R" else KEEP) + TRUNCATED * (fault == "truncated")
        if letters[-1] == "R":
            self.state = NEXT[self.state]
            role = "user" if self.state == USER else "assistant"
        else:
            self.state = keep_to(INITIALS.index(initial), self.state)
        self.say(role, text)

    def row(self) -> tuple:
        self.audit.append(ENDINGS[self.state])
        self.insert(len(ENDINGS[self.state]))
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return self.conv, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


def repaired(rows: DataFrame) -> DataFrame:
    """Per conv_id of ``rows`` (conv_id, turn, role, text): gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    NULL ids are one conversation, NULL turns come first and are in no gap, NULL roles and texts are
    one space. Rows of one turn come by role, then text; repeated rows are duplicates of the first.
    A role that begins with none of s, u, a (an empty one too) can't be kept. Long texts and long
    conversations are streamed; other columns are not looked at; an empty table gives no rows.
    """
    conv = rows.schema["conv_id"].dataType.simpleString()
    ordered = in_order(rows)
    chunks = chunks_of(ordered)
    bounds = chunk_bounds(chunks, conv)
    letters = stored(row_edits(chunks, bounds, conv), "turn-edits")
    release(chunks, *([] if bounds is None else [bounds]))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    # edits come just before the row they are of, so texts move once and are joined with nothing
    told = letters.select("conv", "id", F.lit(0).alias("part"), none("long", "turn"), F.col("fault").alias("role"), F.col("edits").alias("text"))
    both = union([told, ordered.select("conv", "id", F.lit(1).alias("part"), "turn", "role", "text")])
    both = both.repartition("conv").sortWithinPartitions("conv", "id", "part")

    def scan(batches):
        now, edit, done = None, None, []
        for batch in batches:
            for c, part, turn, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5))):
                if now is None or c != now.conv:
                    if now is not None:
                        done.append(now.row())
                    now = Report(c)
                if part == 0:
                    edit = (text, role)
                else:
                    now.add(turn, role, text, *edit)
            if done:
                yield report_batch(done, kind)
                done = []
        if now is not None:
            yield report_batch([now.row()], kind)

    kind = pa.int64() if conv == "bigint" else pa.int32() if conv == "int" else pa.string()
    return arrow_pass(both, scan, f"conv_id {conv}, {', '.join(f'{c} long' for c in COUNTS)}, audit string, repaired_sha256 string")


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def report_batch(done: list, kind) -> pa.RecordBatch:
    columns = list(zip(*done))
    types = [kind, *[pa.int64()] * len(COUNTS), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["conv_id", *COUNTS, "audit", "repaired_sha256"])


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with faults drawn from crc32 of conv_id:turn, by its rest by 20: 0 dropped, 1 emptied, 2 without ends of sentences, 3 twice, 4 made the user's. NULLs are one space (conv_id and turn stay NULL)."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(draw == 1, "").when(draw == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    role = F.when(draw == 4, "user").otherwise(space("role"))
    kept = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), draw.alias("draw")).filter("draw <> 0")
    return kept.withColumn("copy", F.explode(F.when(F.col("draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("copy", "draw")
