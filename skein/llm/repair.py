"""Cheapest repair of conversations whose turns are damaged.

A conversation's roles must read ``(s?(ua)+)?``. Edits: keep a turn (0), give it the role user or assistant (2), delete it
(3; blank and repeated turns must go), insert an empty turn of user or assistant (2); a truncated turn that stays adds 1.
Costs to go are found backwards over turns and the four states of that grammar; a forward walk then takes, among the edits
that keep to the least cost, the one of least letter, which gives the least audit string since a state and a letter fix
the next state.

Turns are put in order by a range partitioning of keys alone (conversation, turn, fingerprint of role and text) and packed
into blocks of at most ``BLOCK`` turns. A block is a four by four matrix of least costs, a conversation a product of them:
one pass over blocks from the last to the first gives the costs at every border, another from the first to the last the
states there, and all rows of a long conversation are worked on side by side. Texts travel once, to the pass that hashes
the repaired turns; it holds one turn and one block's edits at a time.

Defined results: null roles and texts are one space, a null conversation is one of its own, null turns come first; turns of
one number stand in the order of their fingerprints; repeated rows are duplicates after the first; an empty role has no
initial and cannot stay; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

BLOCK = 1024
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
FAR = 1 << 60
#: States: nothing yet, after the system turn, after a user turn, after an assistant turn. Which of user and assistant
#: can follow each, and the state it leads to.
NEXT = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
STEPS = {(s, role[0]): to for s, (role, to) in enumerate(NEXT)} | {(0, "s"): 1}
STATES = range(len(NEXT))
#: The cost from each state at the end: user alone needs an answer, system alone both turns.
END = (0, 2 * INSERT, INSERT, 0)
WORDLY = "[^\\x20\\x09-\\x0D]"
WHITE = " \t\n\x0b\x0c\r"


def damage(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, copies): turns with planted faults, by the checksum of their conversation and number."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(blank(conv), F.lit(":"), blank(turn)).cast("binary")) % 20
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), blank(role).alias("role"), blank(text).alias("text"), fault.alias("fault")).filter("fault <> 0")
    return rows.select(
        "conv", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("fault") == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def fingerprint() -> Column:
    return F.unhex(F.sha2(F.concat_ws("\n", F.octet_length("role").cast("string"), "role", "text"), 256))


def judged(rows: DataFrame) -> DataFrame:
    """(conv, turn, print, initial, first, copies, fault): one row for each distinct turn of a conversation, with how many
    copies stand there, whether it is the first of its role and text, and its own fault."""
    last = F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1))
    fault = F.when(~F.col("text").rlike(WORDLY), "blank").when(~last.isin(".", "!", "?"), "truncated")
    own = rows.select("conv", "turn", fingerprint().alias("print"), F.substring("role", 1, 1).alias("initial"), fault.alias("fault"), "copies")
    keys = own.groupBy("conv", "turn", "print").agg(F.first("initial").alias("initial"), F.first("fault").alias("fault"), F.sum("copies").alias("copies"))
    # Null turns come first: the place of a turn is (whether there is one, its number).
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))
    again = keys.groupBy("conv", "print").agg(F.min(place).alias("place"), F.count("*").alias("n")).filter("n > 1").select(F.col("conv").alias("c"), F.col("print").alias("p"), F.col("place").alias("earliest"))
    both = keys.join(again, F.col("conv").eqNullSafe(F.col("c")) & (F.col("print") == F.col("p")), "left")
    return both.select("conv", "turn", "print", "initial", (F.col("earliest").isNull() | (place == F.col("earliest"))).alias("first"), "copies", "fault")


#: What a block keeps of its turns; ``codes`` has one letter a turn: F (must go), T (truncated) or W.
BLOCKS = "known boolean, turn {turn}, print binary, initials array<string>, codes string, copies array<long>, turns long, lowest {turn}, highest {turn}, blank long, duplicate long, truncated long, illegal long"


def packed(keys: DataFrame, block: int) -> DataFrame:
    """(conv, part, place, ...): consecutive turns of a conversation, at most ``block`` of them. ``part`` and ``place``
    put a conversation's blocks in order."""
    kinds = {f.name: f.dataType.simpleString() for f in keys.schema}
    order = [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), F.asc("print")]
    in_order = keys.repartitionByRange(*order).sortWithinPartitions(*order)
    body = BLOCKS.format(turn=kinds["turn"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        types: list[pa.DataType] = []

        def close() -> pa.RecordBatch:
            nonlocal place
            numbers = [x[1] for x in held if x[1] is not None]
            codes, illegal, before = [], 0, None
            for _, _, _, initial, first, copies, fault in held:
                codes.append("F" if fault == "blank" or not first else "T" if fault else "W")
                illegal += (before is not None and before + initial not in ("su", "ua", "au")) + (copies - 1) * (initial * 2 not in ("su", "ua", "au"))
                before = initial
            blank = sum(x[5] for x in held if x[6] == "blank")
            duplicate = sum(x[5] - bool(x[4]) for x in held if x[6] != "blank")
            row = [
                held[0][0], part, place, held[0][1] is not None, held[0][1], held[0][2], [x[3] for x in held], "".join(codes), [x[5] for x in held], len(set(numbers)),
                min(numbers, default=None), max(numbers, default=None), blank, duplicate, codes.count("T"), illegal,
            ]
            place += 1
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=["conv", "part", "place", *(x.split()[0] for x in body.split(", "))])

        ready: list[pa.RecordBatch] = []
        for batch in batches:
            if not types:
                conv, number = batch.schema.field(0).type, batch.schema.field(1).type
                types = [conv, pa.int32(), pa.int64(), pa.bool_(), number, pa.binary(), pa.list_(pa.string()), pa.string(), pa.list_(pa.int64()), pa.int64(), number, number, *[pa.int64()] * 4]
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (held[0][0] != row[0] or len(held) >= block):
                    ready.append(close())
                held.append(row)
            if len(ready) >= 256:
                yield from pa.Table.from_batches(ready).combine_chunks().to_batches()
                ready = []
        if held:
            ready.append(close())
        if ready:
            yield from pa.Table.from_batches(ready).combine_chunks().to_batches()

    return in_order.mapInArrow(run, f"conv {kinds['conv']}, part int, place long, {body}")


def options(initial: str, code: str, state: int, after: list[int]) -> list[tuple[int, str, int]]:
    """(cost, letter, next state) of the edits that take a turn, in order of letters; ``after``: costs to go behind it."""
    out = [(DELETE + after[state], "D", state)]
    if code != "F":
        cut = CUT * (code == "T")
        kept = STEPS.get((state, initial))
        if kept is not None:
            out.append((KEEP + cut + after[kept], "K", kept))
        to = NEXT[state][1]
        out.append((REROLE + cut + after[to], "R", to))
    return out


def settle(costs: list[int]) -> list[int]:
    """Costs to go when turns may be inserted first; two insertions come back to where they began."""
    for _ in range(2):
        costs = [min(costs[s], INSERT + costs[NEXT[s][1]]) for s in STATES]
    return costs


def to_go(initials: list[str], codes: str, copies: list[int], end: list[int]) -> list[list[int]]:
    """Costs to go in front of every turn and, last, at the end of the block, where ``end`` holds."""
    out = [list(end)]
    for initial, code, n in zip(reversed(initials), reversed(codes), reversed(copies), strict=True):
        after = [DELETE * (n - 1) + x for x in out[-1]]  # copies behind the first must go
        out.append(settle([min(o[0] for o in options(initial, code, s, after)) for s in STATES]))
    return out[::-1]


def walk(initials: list[str], codes: str, copies: list[int], costs: list[list[int]], state: int) -> tuple[str, int]:
    """(audit, last state) from a state in front of the block, by the least letter that keeps to the least cost."""
    out: list[str] = []
    for i, (initial, code, n) in enumerate(zip(initials, codes, copies, strict=True)):
        after = [DELETE * (n - 1) + x for x in costs[i + 1]]
        while True:
            best = [(letter, to) for cost, letter, to in options(initial, code, state, after) if cost == costs[i][state]]
            if INSERT + costs[i][NEXT[state][1]] == costs[i][state] and not any(letter < "I" for letter, _ in best):
                out.append("I")
                state = NEXT[state][1]
                continue
            letter, state = min(best)
            out.append(letter + "D" * (n - 1))
            break
    return "".join(out), state


def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, part, place, least): least costs of a block from each state to each, the matrix row by row."""
    for batch in (whole.slice(at, 64) for whole in batches for at in range(0, whole.num_rows, 64)):
        rows = []
        for initials, codes, copies in zip(*(batch.column(i).to_pylist() for i in (3, 4, 5)), strict=True):
            columns = [to_go(initials, codes, copies, [0 if s == t else FAR for s in STATES])[0] for t in STATES]
            rows.append([min(FAR, columns[t][s]) for s in STATES for t in STATES])
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(rows, pa.list_(pa.int64()))], names=["conv", "part", "place", "least"])


def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, part, place, end): the costs to go at the end of every block, from blocks in descending order."""
    conv, costs, begun = None, list(END), False
    for batch in batches:
        ends = []
        for c, least in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if not begun or c != conv:
                conv, costs, begun = c, list(END), True
            ends.append(costs)
            costs = settle([min(least[4 * s + t] + costs[t] for t in STATES) for s in STATES])
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ends, pa.list_(pa.int64()))], names=["conv", "part", "place", "end"])


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class Repaired:
    """The walk through one conversation: blocks and texts come in order."""

    def __init__(self) -> None:
        self.state, self.cost, self.audit, self.hash, self.any = 0, None, [], hashlib.sha256(), False
        self.counts = [0, 0, 0, 0]
        self.before, self.turns, self.low, self.high, self.letters, self.at, self.copies, self.i = None, 0, None, None, "", 0, [], 0

    def block(self, initials: list[str], codes: str, copies: list[int], end: list[int], turns: int, low: object, high: object, counts: list[int]) -> None:
        costs = to_go(initials, codes, copies, end)
        if self.cost is None:
            self.cost = costs[0][0]
        self.letters, self.state_at = "", self.state
        self.letters, self.state = walk(initials, codes, copies, costs, self.state)
        self.audit.append(self.letters)
        self.at, self.copies, self.i = 0, copies, 0
        self.counts = [a + b for a, b in zip(self.counts, counts, strict=True)]
        self.counts[3] += self.before is not None and self.before + initials[0] not in ("su", "ua", "au")
        self.before = initials[-1]
        self.turns += turns - (low is not None and low == self.high)
        self.low, self.high = low if self.low is None else self.low, self.high if high is None else high

    def line(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.any else "") + f"{role}:{text}").encode())
        self.any = True

    def insert(self) -> None:
        role, self.state_at = NEXT[self.state_at]
        self.line(role, "")

    def text(self, role: str, text: str) -> None:
        """The edits up to and with those of the next turn."""
        while self.letters[self.at] == "I":
            self.insert()
            self.at += 1
        letter = self.letters[self.at]
        if letter == "K":
            self.state_at = STEPS[self.state_at, role[0]]
            self.line(role, text)
        elif letter == "R":
            role, self.state_at = NEXT[self.state_at]
            self.line(role, text)
        self.at += self.copies[self.i]
        self.i += 1

    def row(self) -> tuple:
        tail = 0
        self.state_at = self.state
        while END[self.state_at]:
            tail += 1
            self.insert()
        blank, duplicate, truncated, illegal = self.counts
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, blank, duplicate, truncated, illegal, self.cost or 0, "".join(self.audit) + "I" * tail, self.hash.hexdigest()


def repair(turns: DataFrame, rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv, RESULT) of every conversation of ``turns`` (conv); its turns as they are now: ``rows`` (conv, turn, role,
    text, copies)."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    scratch = Scratch(rows.sparkSession)
    blocks = scratch.keep("blocks", packed(judged(rows), block))
    least = blocks.select("conv", "part", "place", "initials", "codes", "copies").mapInArrow(matrices, f"conv {kinds['conv']}, part int, place long, least array<long>")
    down = least.repartition("conv").sortWithinPartitions(F.asc_nulls_first("conv"), F.desc("part"), F.desc("place"))
    ends = down.mapInArrow(borders, f"conv {kinds['conv']}, part int, place long, end array<long>").drop("conv")
    # Every conversation, then each block in front of the texts of its turns.
    kept = ("initials", "codes", "turns", "lowest", "highest", "blank", "duplicate", "truncated", "illegal")
    empty = {"initials": "array<string>", "codes": "string", "turns": "long", "lowest": kinds["turn"], "highest": kinds["turn"], "blank": "long", "duplicate": "long", "truncated": "long", "illegal": "long"}
    nothing = [F.lit(None).cast(empty[c]).alias(c) for c in kept]
    no_lists = [F.lit(None).cast("array<long>").alias(c) for c in ("copies", "end")]
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    heads = turns.select("conv").distinct().select("conv", F.lit(False).alias("known"), none("turn", kinds["turn"]), none("print", "binary"), F.lit(0).alias("kind"), none("role", "string"), none("text", "string"), *no_lists, *nothing)
    starts = blocks.join(ends, ["part", "place"]).select("conv", "known", "turn", "print", F.lit(1).alias("kind"), none("role", "string"), none("text", "string"), "copies", "end", *kept)
    texts = rows.select("conv", F.col("turn").isNotNull().alias("known"), "turn", fingerprint().alias("print"), F.lit(2).alias("kind"), "role", "text", *no_lists, *nothing)
    # The head sorts before everything of its conversation by its print, a null; a block before the text of its first turn.
    every = heads.unionByName(starts).unionByName(texts).withColumn("head", F.col("kind") != 0)
    every = every.repartition("conv").sortWithinPartitions(F.asc_nulls_first("conv"), "head", "known", F.asc_nulls_first("turn"), "print", "kind")
    names = ["conv", *(x.split()[0] for x in RESULT.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, conv, kind_of_conv, out, weight, before = None, None, None, [], 0, None

        def emit() -> pa.RecordBatch:
            types = [kind_of_conv, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

        for batch in batches:
            kind_of_conv = batch.schema.field(0).type
            for at in range(0, batch.num_rows, 256):
                columns = [batch.column(i).slice(at, 256).to_pylist() for i in (0, 2, 3, 4, 5, 6, 7, 8, *range(9, 18))]
                for c, turn, mark, kind, role, text, copies, end, initials, codes, n, low, high, *counts in zip(*columns, strict=True):
                    if kind == 0:
                        if now is not None:
                            out.append((conv, *now.row()))
                            weight += len(out[-1][7])
                        now, conv, before = Repaired(), c, None
                    elif kind == 1:
                        now.block(initials, codes, copies, end, n, low, high, counts)
                    elif before != (turn, mark):  # rows alike are copies of one turn
                        before = (turn, mark)
                        now.text(role, text)
                if len(out) >= 4096 or weight > 1 << 20:
                    yield emit()
                    out, weight = [], 0
        if now is not None:
            out.append((conv, *now.row()))
        if out:
            yield emit()

    return every.select("conv", "known", "turn", "print", "kind", "role", "text", "copies", "end", *kept).mapInArrow(run, f"conv {kinds['conv']}, {RESULT}")


def repair_damaged(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, RESULT): every conversation of ``turns`` (conv_id, turn, role, text), damaged and repaired."""
    found = repair(turns.select(F.col("conv_id").alias("conv")), damage(turns), block)
    return found.withColumnRenamed("conv", "conv_id")
