"""Operator 11 against a search over edits: costs, least audits, repaired rows; hot conversations in segments; odd rows."""

import hashlib
import heapq
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from conftest import SMALL

from tidewalk.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string"
INITIAL = {"s": 0, "u": 1, "a": 2}


def said(v):
    return " " if v is None else str(v)


def damage(rows):
    """{conv_id: rows after damage in order}; plain reading of the contract."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        fate = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        own = out[conv]
        role, text = said(role), said(text)
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        own += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in out.items()}


def search(rows, faults):
    """Cheapest edits with the least letters: a search by cost and letters over places and what has been said so far."""
    ok = re.compile(r"(s?(ua)*u?)?")
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, shape, lines = heapq.heappop(heap)
        if (i, shape) in done:
            continue
        done.add((i, shape))
        if i == len(rows) and (shape == "" or re.fullmatch(r"s?(ua)+", shape)):
            return cost, audit, "\n".join(lines)
        cut = lambda x: x if len(x) < 4 else x[:1].replace("u", "") + "ua" * 1 + ("u" if x.endswith("u") else "")
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, shape, lines))
            if faults[i] not in ("blank", "duplicate"):
                more = faults[i] == "truncated"
                if role[:1] and ok.fullmatch(shape + role[:1]):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, cut(shape + role[:1]), (*lines, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    if ok.fullmatch(shape + new[0]):
                        heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, cut(shape + new[0]), (*lines, f"{new}:{text}")))
        for new in ("user", "assistant"):
            if ok.fullmatch(shape + new[0]) and cost < 3 * len(rows) + 1:
                heapq.heappush(heap, (cost + 2, audit + "I", i, cut(shape + new[0]), (*lines, f"{new}:")))
    raise AssertionError


def plain(rows):
    """NAMES of one conversation."""
    faults, seen = [], set()
    for _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = {t for t, _, _ in rows if t is not None}
    cost, audit, text = search(rows, faults)
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(x) for x in ("blank", "duplicate", "truncated")),
        sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False)), cost, audit, hashlib.sha256(text.encode()).hexdigest(),
    )


def result(df):
    rows = df.collect()
    out = {r["conv_id"]: tuple(r[c] for c in conversations.NAMES) for r in rows}
    assert len(out) == len(rows)
    return out


def made(rng, conv, n):
    """Rows with ties, repeats, nulls, odd roles and texts."""
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "unknown"]
    texts = ["Yes.", "No", "", None, " \t", "Well!", "é ü?", "Yes.", "x. ", "y ", "tail. "]
    return [(conv, None if rng.random() < 0.1 else int(rng.integers(0, n)), roles[int(rng.integers(len(roles)))], texts[int(rng.integers(len(texts)))]) for _ in range(n)]


ODD = [
    (None, 0, "user", "Hi."), (None, None, None, None), (7, None, "user", "A."), (7, None, "assistant", "B."), (8, 1, "", ""), (9, 5, "system", "Only."), (9, 5, "system", "Only."), (10, 3, "assistant", "Late."), (10, 1, "user", "Early."),
    (11, 0, "user", "long. " * 40_000), (11, 1, "assistant", "word " * 40_000 + "."),
]


def test_tables_equal_the_search(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = result(conversations.op11_conversation_repair(spark, SMALL))
    want = {c: plain(r) for c, r in damage(rows).items()}
    assert got == want and len(want) > 10


def test_made_up_rows_equal_the_search(spark):
    rng = np.random.default_rng(3)
    rows = ODD + [r for c in range(100, 400) for r in made(rng, c, int(rng.integers(1, 9)))]
    got = result(conversations.repaired(conversations.damaged(spark.createDataFrame(rows, SCHEMA).withColumnRenamed("text", "said").selectExpr("*", "said AS cid", "turn AS gone", "said AS name"), text="said")))
    assert got == {c: plain(r) for c, r in damage(rows).items()}


def test_segments_equal_whole_conversations(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = ODD + [r for c in range(100, 112) for r in made(rng, c, int(rng.integers(1, 40)))] + [(500, i, "user", "Same.") for i in range(300)] + [(501, 4, "user", "Equal.")] * 90
    table = conversations.damaged(spark.createDataFrame(rows, SCHEMA))
    want = result(conversations.whole(table, 3))
    present = {c for c, r in damage(rows).items() if r}
    got = result(conversations.segments(table.where("not gone"), 5))
    assert got == {c: v for c, v in want.items() if c in present}
    monkeypatch.setattr(conversations, "HOT_BYTES", 1 << 12)
    assert result(conversations.repaired(table)) == want


def test_rows_that_need_nothing_stay(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Hello."), (2, 0, "user", "Why?"), (2, 1, "assistant", "So.")]
    got = result(conversations.repaired(conversations.kept_rows(spark.createDataFrame(rows, SCHEMA))))
    assert got[1][:7] == (0, 0, 0, 0, 0, 0, "KKK") and got[2][:7] == (0, 0, 0, 0, 0, 0, "KK")
    assert got[2][7] == hashlib.sha256(b"user:Why?\nassistant:So.").hexdigest()


def test_dropped_conversations_have_a_row(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = result(conversations.repaired(conversations.damaged(spark.createDataFrame([(conv, 0, "user", "Hi.")], SCHEMA))))
    assert got == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_table_of_the_automaton_stays_small():
    automaton = conversations.Automaton()
    rng = np.random.default_rng(1)
    kinds = rng.integers(0, conversations.KINDS, 200_000)
    automaton.scan(kinds, np.arange(0, len(kinds) + 1, 50))
    assert len(automaton.vectors) < 200


def test_empty_table(spark):
    assert conversations.repaired(conversations.damaged(spark.createDataFrame([], SCHEMA))).count() == 0


@pytest.mark.parametrize("kind", ["string", "int", "decimal(20,0)"])
def test_ids_of_other_types(spark, kind):
    rows = spark.createDataFrame([(1, 0, "user", "Hi."), (None, 0, "user", "Hi.")], SCHEMA)
    out = conversations.repaired(conversations.kept_rows(rows.selectExpr(f"cast(conv_id AS {kind}) AS conv_id", "turn", "role", "text")))
    assert out.schema["conv_id"].dataType.simpleString() == kind and out.count() == 2
