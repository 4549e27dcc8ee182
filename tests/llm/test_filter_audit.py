"""Operator 12: the audit against a plain one, copies by id, odd rows."""

from collections import Counter
from itertools import permutations

import pytest
from conftest import SMALL

from tidewalk.llm import filter_audit

SCHEMA = "doc_id long, text string, source string, mask string"
GOOD = " ".join(f"word{i}" for i in range(60))
ROWS = [
    (5, GOOD, "a", "m"), (3, GOOD, "b", "m"), (3, GOOD, "b", "m"), (9, GOOD, None, "m"), (1, None, "a", "m"), (2, "", "", "m"), (None, GOOD, "a", "m"), (None, GOOD, "a", "m"), (4, "ALL CAPS # " * 3000, "a", None),
    (6, "same " * 70, "b", "m"), (7, "same " * 70, "b", "m"), (8, GOOD.replace(" ", " "), "c", "m"), (10, GOOD + "\x1f" + "tail", "c", "m"), (11, " \n", "c", "m"),
]
LABELS = [(3, 1, 0), (3, None, 1), (5, 1, 1), (9, 0, 1), (None, 1, 1), (7, 1, None), (99, 1, 1)]


def blank_cut(text):
    for b in "\t\n\x0b\x0c\r":
        text = text.replace(b, " ")
    return [w for w in text.split(" ") if w]


def plain(rows, labels):
    """Rows of the audit, one order and step after the other over lists of documents."""
    good, toxic = ({i for i, *f in labels if i is not None and f[k] == 1} for k in (0, 1))
    docs = []
    for i, text, part, *_ in rows:
        text = text or ""
        words = blank_cut(text)
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), "D": any(c in "#$%&*|" for c in text),
            "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, *_ in rows),
        }
        docs.append((i, part or "", fails))
    out = []
    for part in {p for _, p, _ in docs}:
        own = [(i, f) for i, p, f in docs if p == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone = [d for d in left if d[1][x]]
                left = [d for d in left if not d[1][x]]
                shapley[x] += len(gone)
                fails = [f for _, f in own if f[x]]
                out.append(["".join(order), x, part, step, len(left), len(gone), len(fails) - len(gone), sum(sum(f.values()) == 1 for f in fails), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)])
        out = [[*r, shapley[r[1]]] if r[2] == part else r for r in out]
    return Counter((r[2], r[0], *r[3:]) for r in out)


def got(df):
    return Counter((r["part"], r["filter_order"], r["step"], *(r[c] for c in filter_audit.NAMES)) for r in df.collect())


@pytest.mark.parametrize("held", [filter_audit.HELD_BYTES, 0])
def test_odd_rows_equal_the_plain_audit(spark, monkeypatch, held):
    monkeypatch.setattr(filter_audit, "HELD_BYTES", held)
    docs, labels = spark.createDataFrame(ROWS, SCHEMA), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    rows = got(filter_audit.audit(docs, labels))
    assert rows == plain(ROWS, LABELS) and len({r[0] for r in rows}) == 4 and sum(rows.values()) == 2400


def test_copies_are_the_larger_ids(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    least = docs.selectExpr("doc_id", "min(doc_id) OVER (PARTITION BY text) AS least").where("doc_id > least").collect()
    assert Counter(filter_audit.copies(docs).collect()) == Counter(r["doc_id"] for r in least)
    assert Counter(filter_audit.copies(spark.createDataFrame(ROWS, SCHEMA)).collect()) == Counter([5, 9, 7, 2])


def test_texts_with_one_fingerprint_stay_apart(spark, monkeypatch):
    chains = filter_audit.Chains()
    lost = [x for i, t in enumerate([b"one", b"two", b"one", b"two", b"three"]) for x in chains.admit(1, t, 9 - i, 0, {"a": 1})]
    assert [x[0] for x in lost] == [9, 8] and len(chains.by_print[1]) == 3
    assert [x[1][1] for x in chains.entries()] == [7, 6, 5] and not chains.by_print


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, labels).count() == 0
    assert got(filter_audit.audit(spark.createDataFrame(ROWS, SCHEMA), labels)) == plain(ROWS, [])
