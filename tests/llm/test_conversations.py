import hashlib
import itertools
import random
import re

import duckdb
import pyarrow as pa
import pytest

from attestry.llm import conversations, queries

from ..comparing import spark_rows, sql_rows
from .helpers import NASTY, set_in_tasks

SCHEMA = "conv_id long, turn long, role string, text string, cost long, audit array<int>, part string"
TEXTS = ["Hello.", "Hi!", "And then", "", " \n", "Why? ", None, "ok.\r\n", "é…", *NASTY]


def _rows(rng, conversations_, most):
    for c in conversations_:
        for t in range(rng.randrange(most + 1)):
            turn = rng.choice([t, t, t, t + 3, None, 1])
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "upper", "S"])
            yield c, turn, role, rng.choice(TEXTS[:4] * 4 + TEXTS) if rng.random() < 0.4 else f"text {rng.random()}{rng.choice(['.', '!', '', ' ?'])}"


def _frame(spark, rows):
    return spark.createDataFrame([(*r, 1, [1], "x") for r in rows], SCHEMA)


@pytest.mark.parametrize("size", [1 << 17, 3])
def test_query_is_as_in_sql(spark, tmp_path, size):
    """Null ids, turns, roles and texts, rows that repeat, ties; also with conversations that are cut at every few rows."""
    rng = random.Random(size)
    rows = list(_rows(rng, [None, *range(-2, 70)], 12)) + list(_rows(rng, [900], 700)) + [(901, 5, "user", "same.")] * 60 + [(902, None, None, None)] * 3
    _frame(spark, rows).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    columns = list(zip(*rows, strict=True))
    con.register("conversations", pa.table({n: pa.array(c, k) for n, c, k in zip(("conv_id", "turn", "role", "text"), columns, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)}))
    with set_in_tasks(conversations, ROWS=size):
        out = queries.op12_conversations(spark, str(tmp_path))
        cols, want = sql_rows(con, queries.SQL["op12_conversations"])
        assert sorted(out.columns) == cols
        assert spark_rows(out) == want
    assert any(int(r[cols.index("illegal")]) > 3 for r in want)


def _cheapest(rows):
    """By trying all edits: what happens to each row, and up to two rows inserted before each and at the end."""
    best = None
    first = {}
    for i, (_, _, role, text) in enumerate(rows):
        first.setdefault((role, text), i)
    inserts = [x for n in range(3) for x in itertools.product("ua", repeat=n)]
    ways = []
    for i, (_, _, role, text) in enumerate(rows):
        shown = text.strip(" \t\n\x0b\x0c\r")
        free = bool(shown) and first[role, text] == i
        more = 5 if free and shown[-1] not in ".!?" else 0
        ways.append([("D", "", 2, None), *([("K", role[:1], more, f"{role}:{text}"), ("R", "u", 1 + more, f"user:{text}"), ("R", "a", 1 + more, f"assistant:{text}")] if free else [])])
    for edits in itertools.product(*ways):
        for new in itertools.product(inserts, repeat=len(rows) + 1):
            if sum(map(len, new)) > 2:
                continue
            roles, audit, cost, lines = "", "", 0, []
            for k, own in enumerate(new):
                for x in own:
                    roles, audit, cost = roles + x, audit + "I", cost + 5
                    lines.append({"u": "user:", "a": "assistant:"}[x])
                if k < len(edits):
                    letter, role, price, line = edits[k]
                    roles, audit, cost = roles + role, audit + letter, cost + price
                    lines += [line] if line is not None else []
            if re.fullmatch("(s?(ua)+)?", roles) and len(roles) == len(lines) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return best


def test_against_all_edits(spark):
    rng = random.Random(2)
    cases = {}
    for c in range(60):
        rows = [(c, t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["Hi.", "Hi.", "no end", "", "What?", "So!"])) for t in range(rng.randrange(1, 4))]
        cases[c] = rows
    df = _frame(spark, [r for rows in cases.values() for r in rows])
    with set_in_tasks(conversations, ROWS=2):
        got = {r["conv_id"]: (r["cost"], r["audit"], r["repaired_sha256"]) for r in conversations.digest(df, conversations.repair(df)).collect()}
    assert got == {c: _cheapest(rows) for c, rows in cases.items()}


def test_rows_of_the_repair(spark):
    df = _frame(spark, [(1, 0, "system", "Be nice."), (1, 1, "user", "One."), (1, 2, "user", "Two."), (1, 3, "assistant", "Three."), (1, 4, "assistant", "Three."), (1, 5, "user", "Four.")])
    found = conversations.repair(df)
    (r,) = found.report.collect()
    assert (r["cost"], r["audit"], r["duplicate"], r["illegal"], r["gaps"]) == (5, "KKRRDR", 1, 2, 0)
    rows = [(x["role"], x["text"]) for x in found.rows.orderBy("conv_id", "part", "place").collect()]
    assert re.fullmatch("s?(ua)+", "".join(role[0] for role, _ in rows))


def test_one_long_conversation(spark):
    """Cut in many segments, equal rows among them; the audit has a letter for each row and each inserted one."""
    rows = [(7, t // 2, "user" if t % 3 else "assistant", "again." if t % 5 == 0 else f"{t}.") for t in range(3000)]
    df = _frame(spark, rows)
    (whole,) = conversations.digest(df, conversations.repair(df)).collect()
    with set_in_tasks(conversations, ROWS=150):
        (cut,) = conversations.digest(df, conversations.repair(df)).collect()
    assert whole == cut
    assert len(whole["audit"].replace("I", "")) == 3000


def test_no_rows(spark):
    none = _frame(spark, [(1, 1, "user", "x.")]).limit(0)
    assert conversations.digest(none, conversations.repair(none)).collect() == []
    (r,) = conversations.digest(_frame(spark, [(1, 1, "user", "x.")]), conversations.repair(none)).collect()
    assert tuple(r) == (1, 0, 0, 0, 0, 0, 0, "", conversations.NOTHING)
