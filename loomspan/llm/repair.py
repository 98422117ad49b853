"""Conversations repaired by the cheapest edits, found by a checkpointed dynamic programme.

A repaired conversation is empty, or has an optional system turn and then pairs of a user's and
an assistant's turn. Each turn is kept (cost 0), given the role user or assistant (2) or deleted
(3; blank and repeated turns must be), empty turns of either role may be inserted anywhere (2),
and a truncated turn that stays costs 1. Among the cheapest edits those win whose initials
(D, I, K, R) come first in ASCII order.

Of a turn the programme needs its kind only: a letter for its role, upper case if truncated, or
``x`` if it must go. Turns are ordered over the whole table, not conversation by conversation,
and cut into blocks of ``BLOCK`` kinds. Tasks work the blocks out apart from each other, each to
the least cost from any state before it to any state after it. From these small matrices a scan
from the last block of a conversation to its first gets the vector of costs after each block:
the checkpoints, and all of the backward pass that is stored. The walk forward takes a block at
a time, stores vectors at every square root of its length, recomputes those in between, and
follows tight edits. Vectors are kept without their common part, so that few differ and a step
is worked out once. No step holds a conversation; the walk reads its texts as a stream, in
order, as whoever takes a digest of all of it must.

Defined cases: turns are ordered by number (nulls first), then role, then text; nulls in role
and text count as one space, a null conversation is one of its own; repeated rows are adjacent
turns, all but the first of them duplicates; roles other than system, user and assistant go by
their initial, and an empty one or another initial fits nowhere; blank is what holds no
character but space and U+0009 to U+000D. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.shared import table

#: Turns of a block, the square of those between checkpoints within it.
BLOCK = 4096
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States: nothing yet, after system, after user, after assistant. Those that may end, the one
#: that a user's or assistant's turn (whichever fits) leads to, and those that kept turns do.
START, ENDS, NEXT = 0, (0, 3), (2, 2, 3, 2)
KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
NEVER = 1 << 50
LEGAL = {"su", "ua", "au"}
WORDS = r"[^\x20\x09-\x0D]"
ENDED = r"[.!?][\x20\x09-\x0D]*\z"


def fits(state: int) -> str:
    """The role of a turn that is given or inserted in a state."""
    return "assistant" if state == 2 else "user"


def _relaxed(costs: list[int]) -> list[int]:
    """Costs when turns may be inserted first; two inserts lead from after-user back to it."""
    s, u, a = costs[1], costs[2], costs[3]
    u, a = min(u, INSERT + a), min(a, INSERT + u)
    return [min(costs[0], INSERT + u), min(s, INSERT + u), u, a]


#: Costs at the end of a conversation.
LAST = tuple(_relaxed([0 if s in ENDS else NEVER for s in range(4)]))


def _without_common(costs) -> tuple[tuple[int, ...], int]:
    least = min(costs)
    return tuple(NEVER if c >= NEVER // 2 else c - least for c in costs), least


def _edits(after: tuple, kind: str, state: int) -> Iterator[tuple[str, int, int]]:
    """(initial, cost to the end, next state) of the edits that use up a turn, in ASCII order."""
    yield "D", DELETE + after[state], state
    if kind != "x":
        more = TRUNCATED if kind.isupper() else 0
        to = KEPT.get(kind.lower(), {}).get(state)
        if to is not None:
            yield "K", KEEP + more + after[to], to
        yield "R", REROLE + more + after[NEXT[state]], NEXT[state]


@lru_cache(1 << 16)
def _before(after: tuple, kind: str) -> tuple[tuple[int, ...], int]:
    """The vector before a turn, without its common part, and that part."""
    return _without_common(_relaxed([min(cost for _, cost, _ in _edits(after, kind, s)) for s in range(4)]))


@lru_cache(1 << 16)
def _tight(after: tuple, kind: str, state: int) -> tuple[tuple[tuple[str, str], ...], int]:
    """The edits ((initial, role or nothing) each) up to the one that uses up a turn; the state then."""
    costs = _relaxed([min(cost for _, cost, _ in _edits(after, kind, s)) for s in range(4)])
    out = []
    while True:
        options = list(_edits(after, kind, state)) + [("I", INSERT + costs[NEXT[state]], NEXT[state])]
        initial, _, to = min(o for o in options if o[1] == costs[state])
        out.append((initial, fits(state) if initial in "IR" else ""))
        state = to
        if initial != "I":
            return tuple(out), state


def matrix(kinds: str) -> list[int]:
    """Least costs from each state before a block to each after it, row by row."""
    columns = []
    for end in range(4):
        v, total = tuple(0 if s == end else NEVER for s in range(4)), 0
        for kind in reversed(kinds):
            v, more = _before(v, kind)
            total += more
        columns.append([min(NEVER, c + total) for c in v])
    return [columns[t][s] for s in range(4) for t in range(4)]


def walk(kinds: str, after: tuple, state: int) -> Iterator[tuple[tuple[tuple[str, str], ...], int]]:
    """The edits for each turn of a block and the state after it; ``after``: the costs behind the block."""
    step = math.isqrt(len(kinds)) + 1
    marks, v = {}, _without_common(after)[0]
    for i in range(len(kinds), 0, -1):
        if i % step == 0 or i == len(kinds):
            marks[i] = v
        v = _before(v, kinds[i - 1])[0]
    for first in range(0, len(kinds), step):
        end = min(first + step, len(kinds))
        behind = [marks[end]]
        for i in range(end - 1, first, -1):
            behind.append(_before(behind[-1], kinds[i])[0])
        for i in range(first, end):
            edits, state = _tight(behind.pop(), kinds[i], state)
            yield edits, state


# the three passes

_BLOCKS = "place long, skip long, kinds string, costs array<long>, blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long, first_role string, last_role string"
_FACTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _record(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


class _Block:
    """Turns of one conversation as they come; ``place`` and ``skip`` order blocks."""

    def __init__(self, conv, place: int, skip: int):
        self.out = {"conv_id": conv, "place": place, "skip": skip, "illegal": 0, "turns": 0, "first_turn": None, "last_turn": None, "first_role": None, "last_role": ""}
        self.out |= dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.kinds: list[str] = []

    def add(self, turn: int | None, role: str, fault: str) -> None:
        out = self.out
        if fault:
            out[fault] += 1
        if turn is not None and turn != out["last_turn"]:
            out["turns"] += 1
            out["first_turn"] = turn if out["first_turn"] is None else out["first_turn"]
            out["last_turn"] = turn
        out["illegal"] += bool(self.kinds) and out["last_role"] + role not in LEGAL
        out["first_role"] = role if out["first_role"] is None else out["first_role"]
        out["last_role"] = role
        self.kinds.append("x" if fault in ("blank", "duplicate") else role.upper() if fault else role)

    def closed(self) -> dict:
        kinds = "".join(self.kinds)
        return self.out | {"kinds": kinds, "costs": matrix(kinds)}


def _blocks(schema: pa.Schema, size: int):
    """Blocks of ordered turns (conv_id, place, turn, role, fault, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, done = None, []
        for batch in batches:
            for r in batch.to_pylist():
                for copy in range(r["n"]):
                    if block is None or block.out["conv_id"] != r["conv_id"] or len(block.kinds) >= size:
                        done += [block.closed()] if block else []
                        block = _Block(r["conv_id"], r["place"], copy)
                    block.add(r["turn"], r["role"], r["fault"] if copy == 0 or r["fault"] == "blank" else "duplicate")
                    if len(done) >= 256:
                        yield _record(done, schema)
                        done = []
        done += [block.closed()] if block else []
        if done:
            yield _record(done, schema)

    return run


def _checkpoints(schema: pa.Schema):
    """Blocks from a conversation's last to its first, with the costs behind each; its first has its facts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        facts, out, later = {}, [], None

        def first_of_all(row: dict) -> None:
            row |= {k: facts[k] for k in _FACTS if k in facts}
            row |= {"first": True, "cost": facts["after"][START], "gaps": facts["high"] - later["first_turn"] + 1 - facts["turns"] if facts["turns"] else 0}

        for batch in batches:
            for r in batch.to_pylist():
                if later is None or later["conv_id"] != r["conv_id"]:
                    if later is not None:
                        first_of_all(out[-1])
                    facts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0) | {"after": LAST, "high": r["last_turn"]}
                else:
                    facts["illegal"] += r["last_role"] + later["first_role"] not in LEGAL
                    facts["turns"] -= r["last_turn"] is not None and r["last_turn"] == later["first_turn"]
                    if r["first_turn"] is None:  # numbers come after nulls
                        r["first_turn"] = later["first_turn"]
                for k in ("blank", "duplicate", "truncated", "illegal", "turns"):
                    facts[k] += r[k]
                if len(out) > 1024:
                    yield _record(out[:-1], schema)
                    out = out[-1:]
                out.append({"conv_id": r["conv_id"], "place": r["place"], "skip": r["skip"], "kinds": r["kinds"], "after": list(facts["after"]), "first": False})
                costs = r["costs"]
                facts["after"] = tuple(min(costs[4 * s + t] + facts["after"][t] for t in range(4)) for s in range(4))
                later = r
        if later is not None:
            first_of_all(out[-1])
            yield _record(out, schema)

    return run


def _applied(schema: pa.Schema):
    """Edits in order, from a stream in which a block's row goes before those of its turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        steps: Iterator = iter(())
        conv, state, left, turn, begun = None, START, 0, None, False

        def ending() -> None:
            """What is inserted after the last turn."""
            at = state
            while begun and at not in ENDS:
                out.append({"conv_id": conv, "edit": "I", "role": fits(at), "text": "", "turn": None})
                at = NEXT[at]

        for batch in batches:
            for r in batch.to_pylist():
                if not begun or r["conv_id"] != conv:
                    ending()
                    conv, state, left, begun = r["conv_id"], START, 0, True
                if r["kinds"] is not None:
                    steps = walk(r["kinds"], tuple(r["after"]), state)
                else:
                    turn, left = r, r["n"]
                while left:  # copies of a turn may go on in the next block
                    edits, to = next(steps, (None, None))
                    if edits is None:
                        break
                    state, left = to, left - 1
                    for initial, role in edits:
                        own = {"role": "", "text": ""} if initial == "I" else {"role": turn["role"], "text": turn["text"], "turn": turn["turn"]}
                        out.append({"conv_id": conv, "edit": initial} | own | ({"role": role} if role else {}))
                if len(out) >= 2048:
                    yield _record(out, schema)
                    out = []
        ending()
        if out:
            yield _record(out, schema)

    return run


def _arrow(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _lazily(make, schema, *more):
    """``make(Arrow schema)`` within the task, where that is built."""
    return lambda batches: make(_arrow(schema), *more)(batches)


def repaired(rows: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Edits and facts of conversations' turns (conv_id, turn, role, text).

    Edits (conv_id, edit, role, text, turn): deleted turns as they were, all others as they are
    now; a partition holds its conversations whole and in order. Facts, a row for each
    conversation: gaps in the turns' numbers, turns by fault, illegal neighbours, cost.
    """
    spark, conv = rows.sparkSession, rows.schema["conv_id"].dataType.simpleString()
    space = F.lit(" ")
    turns = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    turns = turns.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    turns = table(turns.orderBy("conv_id", "turn", "role", "text").withColumn("place", F.monotonically_increasing_id()), "turns")

    name = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-"))
    same = F.sha2(F.concat(F.char_length(name), space, name, F.char_length("role"), space, "role", "text"), 256)
    blank, cut = ~F.col("text").rlike(WORDS), ~F.col("text").rlike(ENDED)
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    facts = turns.select("conv_id", "place", "turn", "n", initial.alias("role"), same.alias("same"), blank.alias("blank"), cut.alias("cut"))
    earliest = facts.groupBy("same").agg(F.min("place").alias("earliest"))
    fault = F.when(F.col("blank"), "blank").when(F.col("place") > F.col("earliest"), "duplicate").when(F.col("cut"), "truncated").otherwise("")
    facts = facts.join(earliest, "same").select("conv_id", "place", "turn", "role", fault.alias("fault"), "n")

    schema_of = lambda ddl: spark.createDataFrame([], f"conv_id {conv}, {ddl}").schema
    kind = schema_of(_BLOCKS)
    blocks = table(facts.orderBy("place").mapInArrow(_lazily(_blocks, kind, block), kind), "blocks")
    kind = schema_of("place long, skip long, kinds string, after array<long>, first boolean, " + ", ".join(f"{f} long" for f in _FACTS))
    backward = blocks.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("place"), F.desc("skip"))
    checkpoints = table(backward.mapInArrow(_lazily(_checkpoints, kind), kind), "checkpoints")

    # a block comes before its first turn, or after it if it goes on with copies of that
    rank = F.when(F.col("skip") == 0, F.lit(0)).otherwise(F.col("skip") + 1)
    marks = checkpoints.select("conv_id", "place", rank.cast("long").alias("rank"), "kinds", "after")
    whole = turns.select("conv_id", "place", F.lit(1).cast("long").alias("rank"), "turn", "role", "text", "n").unionByName(marks, allowMissingColumns=True)
    forward = whole.repartition("conv_id").sortWithinPartitions("conv_id", "place", "rank").drop("place", "rank")
    kind = schema_of("edit string, role string, text string, turn long")
    return forward.mapInArrow(_lazily(_applied, kind), kind), checkpoints.where("first").select("conv_id", *_FACTS)


def digested(edits: DataFrame) -> DataFrame:
    """(conv_id, audit, repaired_sha256) of edits as ``repaired`` gives them."""
    kind = edits.sparkSession.createDataFrame([], f"conv_id {edits.schema['conv_id'].dataType.simpleString()}, audit string, repaired_sha256 string").schema

    def make(schema: pa.Schema):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, conv, audit, digest, lines = [], None, [], None, 0
            close = lambda: {"conv_id": conv, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}
            for batch in batches:
                for r in batch.to_pylist():
                    if digest is None or r["conv_id"] != conv:
                        out += [close()] if digest else []
                        conv, audit, digest, lines = r["conv_id"], [], hashlib.sha256(), 0
                    audit.append(r["edit"])
                    if r["edit"] != "D":
                        digest.update(f"{chr(10) if lines else ''}{r['role']}:{r['text']}".encode())
                        lines += 1
                if out:
                    yield _record(out, schema)
                    out = []
            if digest:
                yield _record([close()], schema)

        return run

    return edits.mapInArrow(_lazily(make, kind), kind)


def damaged(rows: DataFrame) -> DataFrame:
    """Turns of which a checksum of conversation and number drops, empties, strips, repeats or renames some."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    rows = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), what.alias("what")).where("what <> 0")
    body: Column = F.when(F.col("what") == 1, "").when(F.col("what") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("what") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("what") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), body.alias("text"), copies.alias("copy")).drop("copy")


def op12_checkpointed_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repairs of all ``conversations`` after damage, as audits and digests."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    edits, facts = repaired(damaged(rows))
    every = rows.select(F.col("conv_id").alias("id")).distinct()
    digests = digested(edits).withColumnRenamed("conv_id", "digest_of")
    facts = facts.withColumnRenamed("conv_id", "facts_of")
    out = every.join(facts, F.col("id").eqNullSafe(F.col("facts_of")), "left").join(digests, F.col("id").eqNullSafe(F.col("digest_of")), "left")
    number = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _FACTS]
    empty = hashlib.sha256().hexdigest()
    return out.select(F.col("id").alias("conv_id"), *number, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
