"""Conversation repair against plain recursion, in blocks of few turns and as SQL."""

import functools
import hashlib
import random
import re
import zlib

import duckdb
import pytest

from loomspan.llm import repair as R
from loomspan.llm.queries import oracle_sql

SCHEMA = "conv_id long, turn long, role string, text string"
PATTERN = re.compile("(s?(ua)+)?")


def spoilt(rows):
    out = []
    for conv, turn, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        what = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
        out += [(conv, turn, "user" if what == 4 else role, text)] * (0 if what == 0 else 2 if what == 3 else 1)
    return out


def brute(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha) of a conversation's turns."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, seen = [], set()
    for _, role, text in rows:
        solid = re.sub("[\x20\x09-\x0d]", "", text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [role[:1] for _, role, _ in rows]

    def follows(so_far, x):
        """Whether a role initial may come next, judged by the pattern alone."""
        return any(PATTERN.fullmatch(so_far + x + tail) for tail in ("", "a", "ua"))

    @functools.lru_cache(None)
    def best(i, last, inserts):
        """(cost, audit, roles of kept turns) for what is left, after a turn ``last``."""
        so_far, found = {"": "", "s": "s", "u": "u", "a": "ua"}[last], []
        if i == len(rows) and PATTERN.fullmatch(so_far):
            found.append((0, "", ()))
        if inserts < 3:
            for x in "ua":
                if follows(so_far, x):
                    found.append(join(2, "I", ((-1, x),), best(i, x, inserts + 1)))
        if i < len(rows):
            found.append(join(3, "D", (), best(i + 1, last, 0)))
            if faults[i] not in ("blank", "duplicate"):
                more = faults[i] == "truncated"
                if initials[i] in ("s", "u", "a") and follows(so_far, initials[i]):
                    found.append(join(more, "K", ((i, ""),), best(i + 1, initials[i], 0)))
                for x in "ua":
                    if follows(so_far, x):
                        found.append(join(2 + more, "R", ((i, x),), best(i + 1, x, 0)))
        return min(found) if found else (10**9, "", ())

    def join(cost, letter, line, rest):
        return (cost + rest[0], letter + rest[1], line + rest[2])

    cost, audit, lines = best(0, "", 0)
    name = {"u": "user", "a": "assistant"}
    text = "\n".join(f"{name.get(x) or rows[i][1]}:{'' if i < 0 else rows[i][2]}" for i, x in lines)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, int(cost), audit, hashlib.sha256(text.encode()).hexdigest())


def conversations(n, seed):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(n), None]:
        for turn in range(rng.randrange(9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "aunt"])
            text = rng.choice(["Well.", "Good!\n", "no end", "", " \t\n", None, " ", "Yes?  ", f"Turn {turn}.", "two\nlines."])
            rows.append((conv, rng.choice([turn, turn, 2 * turn, None]), role, text))
    return rows + rows[:5]


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_repairs_equal_plain_recursion_at_any_block(spark, block):
    rows = conversations(40, 3)
    rows += [(77, t // 3, ("user", "assistant", "assistant", "system")[t % 4], "Again." if t % 5 else f"T {t}") for t in range(60)]  # a long one
    rows += [(78, None, "user", "Same.")] * 9
    edits, facts = R.repaired(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "conv_id AS place", "text AS kinds").repartition(3), block)
    digests = {r.conv_id: r for r in R.digested(edits).collect()}
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, digests[r.conv_id].audit, digests[r.conv_id].repaired_sha256) for r in facts.collect()}
    plain = lambda x: " " if x is None else x
    want = {c: brute([(t, plain(r), plain(x)) for d, t, r, x in rows if d == c]) for c in {r[0] for r in rows}}
    assert got == want


def test_the_query_equals_plain_recursion_and_sql(spark, tmp_path):
    rows = conversations(60, 8)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    cols = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = {r.conv_id: tuple(r[c] for c in cols[1:]) for r in R.op12_checkpointed_repair(spark, str(tmp_path)).collect()}
    left = spoilt(rows)
    assert got == {c: brute([x[1:] for x in left if x[0] == c]) for c in {r[0] for r in rows}}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    found = con.execute(f"SELECT {', '.join(cols)} FROM ({oracle_sql()['op12_checkpointed_repair']})").fetchall()
    assert got == {r[0]: r[1:] for r in found}


def test_a_conversation_that_damage_drops_stays_as_an_empty_one(spark, tmp_path):
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    spark.createDataFrame([(lost, 0, "user", "Hello.")], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    (row,) = R.op12_checkpointed_repair(spark, str(tmp_path)).collect()
    assert tuple(row) == (lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def test_an_empty_table_gives_no_rows(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert R.op12_checkpointed_repair(spark, str(tmp_path)).collect() == []


def test_a_block_stores_a_vector_every_square_root_and_recomputes_the_rest():
    kinds = "".join(random.Random(1).choices("suaoSUAOx", k=2000))
    state, edits = R.START, []
    for step, state in R.walk(kinds, R.LAST, state):
        edits += step
    costs = R.matrix(kinds)
    price = {"K": 0, "R": 2, "D": 3, "I": 2}
    used = [k for k, e in zip(kinds, [e for e, _ in edits if e != "I"]) if e in "KR" and k.isupper()]
    end = 0
    while state not in R.ENDS:
        state, end = R.NEXT[state], end + 2
    assert sum(price[e] for e, _ in edits) + len(used) + end == min(costs[t] + R.LAST[t] for t in range(4))
