"""Structure repair of conversations by a lazily determinised weighted automaton.

A conversation's role initials are to spell `(s?(ua)+)?`, an automaton of four states (nothing yet, after s, after u, after a). Edits are its weighted arcs:
keep a row, give it another role, delete it, or insert a row without text. For each place in a conversation there is a vector: what the rest costs from each
of the states. A vector less its minimum is one of a few dozen, and these are the states of a deterministic automaton, made when they are first
met and kept in a transition table with the minimum as the arc's weight. Scanning the rows through the table, for all conversations of a batch at once,
gives the costs. The scan runs from the last row to the first, and the trace against it, from the first row on, takes arcs that are tight, that is, whose
weight is the difference of the vectors' entries; of the tight arcs it takes the one with the least letter. Each letter leads to one state, so the trace
reads off the cheapest edits with the least letters. What the trace does at a place depends on the two states and the row's kind alone, and is
kept in a table as well.

Rows are dealt out by conversation and sorted; a task holds one conversation at a time, and of its batch the conversations' kinds of rows. Conversations of
more than a quarter of a partition's share (and at least HOT_BYTES), of which there can be but a few for each partition, are cut into segments
instead: equal rows are counted and dealt out by order, each segment is a matrix of costs from state to state, the matrices of a conversation, one for
each partition at most, give the vectors between segments, and the segments are traced side by side. In the end one task passes over a conversation's
repaired text, for a hash and the audit string can't be had otherwise, holding one segment's at a time.

Defined results: a null role or text is one space, and so are nulls in the key of the damage; rows of a null conversation are one conversation; rows of one turn are in order of
role and text; a null turn comes first and doesn't count for gaps; roles are told by their first character; an empty role has none and can't be kept; an empty
table gives no rows; repeated rows are rows of their own; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

INITIALS, BLANKS = "sua", "".join(common.BLANKS)
#: States: nothing yet, after s, after u, after a. The state that a row of the other role leads to, and that of a kept row by its initial.
NEXT, KEPT, FINAL = (2, 2, 3, 2), ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}), (0, 3)
ROLES = (None, None, "user", "assistant")
REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
#: Kinds of rows: 0 must go, else 1 + 2 * (initial's place in INITIALS, 3 for any other) + (truncated).
GO, KINDS = 0, 9
FAR = 1 << 40
HOT_BYTES = 4 << 20
LEGAL = ("su", "ua", "au")
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
NAMES = [*COUNTS, "audit", "repaired_sha256"]


def closed(vector) -> tuple[int, ...]:
    """The vector after any number of insertions."""
    out = list(vector)
    for _ in range(len(out)):
        out = [min(x, INSERT + out[NEXT[q]]) for q, x in enumerate(out)]
    return tuple(min(x, FAR) for x in out)


def arcs(q: int, kind: int) -> Iterator[tuple[str, int, int]]:
    """(letter, cost, next state) of what can be done with a row, by letter."""
    yield "D", DELETE, q
    if kind != GO:
        initial, cut_off = divmod(kind - 1, 2)
        to = KEPT[q].get(INITIALS[initial]) if initial < len(INITIALS) else None
        if to is not None:
            yield "K", CUT_OFF * cut_off, to
        yield "R", REROLE + CUT_OFF * cut_off, NEXT[q]


END = closed(0 if q in FINAL else FAR for q in range(4))


class Automaton:
    """Determinised costs-to-go, its states and arcs made as they are met."""

    def __init__(self, end: tuple[int, ...] = END):
        self.vectors: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        self.to, self.weight = np.full((16, KINDS), -1, np.int32), np.zeros((16, KINDS), np.int64)
        self.steps: dict[tuple[int, int, int], tuple[str, int]] = {}
        self.first, self.base = self.state(end)

    def state(self, vector: tuple[int, ...]) -> tuple[int, int]:
        """Number of the normalised vector, and what was taken off."""
        least = min(vector)
        vector = tuple(x - least if x < FAR else FAR for x in vector)
        at = self.number.setdefault(vector, len(self.vectors))
        if at == len(self.vectors):
            self.vectors.append(vector)
            if at == len(self.to):
                self.to, self.weight = np.concatenate([self.to, np.full_like(self.to, -1)]), np.concatenate([self.weight, np.zeros_like(self.weight)])
        return at, least

    def make(self, state: int, kind: int) -> None:
        after = self.vectors[state]
        before = closed(min(cost + after[to] for _, cost, to in arcs(q, kind)) for q in range(4))
        to, weight = self.state(before)
        self.to[state, kind], self.weight[state, kind] = to, weight

    def scan(self, kinds: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each row the state after it, for each conversation (starts has one entry more) the state before its first row and the weights' sum."""
        sizes = np.diff(starts)
        state, total = np.full(len(sizes), self.first, np.int32), np.full(len(sizes), self.base, np.int64)
        after = np.zeros(len(kinds), np.int32)
        by_size = np.argsort(-sizes, kind="stable")
        for back in range(1, int(sizes.max(initial=0)) + 1):
            live = by_size[: np.searchsorted(-sizes[by_size], -back, "right")]
            at = starts[live + 1] - back
            now, kind = state[live], kinds[at]
            after[at] = now
            new = self.to[now, kind] < 0
            if new.any():
                for s, k in np.unique(np.stack([now[new], kind[new]]), axis=1).T.tolist():
                    self.make(s, k)
            state[live] = self.to[now, kind]
            total[live] += self.weight[now, kind]
        return after, state, total

    def step(self, after: int, kind: int, q: int) -> tuple[str, int]:
        """Letters up to and with the row's own, along tight arcs from state q before the row, and the state after it."""
        found = self.steps.get((after, kind, q))
        if found is None:
            here, there = self.vectors[int(self.to[after, kind])], self.vectors[after]
            weight, at, letters = int(self.weight[after, kind]), q, ""
            while found is None:
                tight = [(letter, to) for letter, cost, to in arcs(at, kind) if here[at] + weight == cost + there[to]]
                if here[at] == INSERT + here[NEXT[at]]:
                    tight.append(("I", NEXT[at]))
                letter, at = min(tight)
                letters += letter
                if letter != "I":
                    found = self.steps[after, kind, q] = letters, at
        return found

    def trace(self, kinds: list[int], after: list[int], q: int = 0) -> tuple[list[str], int]:
        """Each row's letters, and the state at the end."""
        out = []
        for kind, state in zip(kinds, after, strict=True):
            letters, q = self.step(state, kind, q)
            out.append(letters)
        return out, q


def last_letters(q: int) -> str:
    """What has to be inserted after the last row."""
    out = ""
    while q not in FINAL:
        out, q = out + "I", NEXT[q]
    return out


def lines(letters: str, q: int, role: str = "", text: str = "") -> tuple[list[str], int]:
    """The repaired lines that a row's letters give from state q, and the state after them."""
    out = []
    for letter in letters:
        if letter == "K":
            out, q = [*out, f"{role}:{text}"], KEPT[q][role[:1]]
        elif letter != "D":
            q = NEXT[q]
            out = [*out, f"{ROLES[q]}:{text if letter == 'R' else ''}"]
    return out, q


def kind_of(role: str, truncated: bool) -> int:
    return 1 + 2 * (INITIALS.find(role[0]) % 4 if role else 3) + truncated


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text of the damaged rows; one more row, with gone set, for each row that was dropped."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(said(conv), F.lit(":"), said(turn))) % 20
    out = rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), said(role).alias("role"), said(text).alias("text"), fate.alias("fate"))
    text = F.when(F.col("fate").isin(0, 1), "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    twice = F.explode(F.when(F.col("fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return out.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("fate") == 0).alias("gone"), twice.alias("copy")).drop("copy")


def kept_rows(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows as they are, in the form that `repaired` takes."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), said(role).alias("role"), said(text).alias("text"), F.lit(False).alias("gone"))


# --- conversations in one task each ---------------------------------------------------------------


def looked_at(rows: list[tuple]) -> tuple[list[int], list[int]]:
    """Kinds of a conversation's rows (turn, role, text) in order, and gaps, blank, duplicate, truncated, illegal."""
    kinds, seen, blank, copies, cut_off, illegal, before = [], set(), 0, 0, 0, 0, None
    for _, role, text in rows:
        solid = text.strip(BLANKS)
        kind = GO
        if not solid:
            blank += 1
        elif (role, text) in seen:
            copies += 1
        else:
            truncated = solid[-1] not in ".!?"
            cut_off += truncated
            kind = kind_of(role, truncated)
        seen.add((role, text))
        illegal += before is not None and before + role[:1] not in LEGAL
        before = role[:1]
        kinds.append(kind)
    turns = {t for t, _, _ in rows if t is not None}
    return kinds, [max(turns) - min(turns) + 1 - len(turns) if turns else 0, blank, copies, cut_off, illegal]


def solved(held: list[tuple[object, list[tuple]]], automaton: Automaton) -> list[list]:
    """conv_id and NAMES of whole conversations."""
    looks = [looked_at(rows) for _, rows in held]
    starts = np.concatenate([[0], np.cumsum([len(k) for k, _ in looks], dtype=np.int64)])
    flat = [k for kinds, _ in looks for k in kinds]
    after, state, total = automaton.scan(np.array(flat, np.int64), starts)
    after, out = after.tolist(), []
    for i, ((conv, rows), (kinds, counts)) in enumerate(zip(held, looks, strict=True)):
        letters, _ = automaton.trace(kinds, after[starts[i] : starts[i + 1]])
        said, q = [], 0
        for own, (_, role, text) in zip(letters, rows, strict=True):
            more, q = lines(own, q, role, text)
            said += more
        letters.append(last_letters(q))
        said += lines(letters[-1], q)[0]
        cost = int(total[i]) + automaton.vectors[int(state[i])][0]
        out.append([conv, *counts, cost, "".join(letters), hashlib.sha256("\n".join(said).encode("utf-8", "surrogatepass")).hexdigest()])
    return out


def _schema(rows: DataFrame) -> str:
    return f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"


def whole(rows: DataFrame, parts: int) -> DataFrame:
    """Conversations that a task can hold."""
    kind = rows.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, conv, open_, begun = Automaton(), None, [], False
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(5)]
            held = []
            for own, turn, role, text, gone in zip(*columns, strict=True):
                if not begun or own != conv:
                    if begun:
                        held.append((conv, open_))
                    conv, open_, begun = own, [], True
                if not gone:
                    open_.append((turn, role, text))
            if held:
                yield batched(held, automaton, batch.schema.field(0).type)
        if begun:
            yield batched([(conv, open_)], automaton, None)

    def batched(held, automaton, arrow) -> pa.RecordBatch:
        columns = list(zip(*solved(held, automaton), strict=True))
        arrow = arrow or _arrow(kind)
        return pa.RecordBatch.from_arrays([pa.array(columns[0], arrow), *[pa.array(c, pa.int64()) for c in columns[1:-2]], *[pa.array(c, pa.string()) for c in columns[-2:]]], ["conv_id", *NAMES])

    dealt = rows.select("conv_id", "turn", "role", "text", "gone").repartition(parts, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(run, _schema(rows))


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


# --- conversations in segments --------------------------------------------------------------------


def run_kinds(pdf: pd.DataFrame) -> tuple[list[int], np.ndarray]:
    """Kinds of a segment's distinct rows, and how many rows that must go follow each."""
    kinds = [GO if go else kind_of(role, cut) for go, role, cut in zip(pdf["go"], pdf["role"], pdf["cut"], strict=True)]
    return kinds, pdf["n"].to_numpy() - 1


def ordered(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.assign(known=pdf["turn"].notna()).sort_values(["known", "turn", "role", "text"], ignore_index=True)


def matrix(pdf: pd.DataFrame) -> np.ndarray:
    """Costs of a segment from each state before it to each after it, insertions within it included."""
    kinds, more = run_kinds(pdf)
    columns = []
    for to in range(4):
        automaton = Automaton(tuple(0 if q == to else FAR for q in range(4)))
        _, state, total = automaton.scan(np.array(kinds, np.int64), np.array([0, len(kinds)]))
        columns.append([min(FAR, int(total[0]) + DELETE * int(more.sum()) + x) if x < FAR else FAR for x in automaton.vectors[int(state[0])]])
    return np.array(columns).T


def segments(rows: DataFrame, parts: int) -> DataFrame:
    """conv_id, NAMES of conversations of any size."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    at = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    cid = F.to_json(F.struct("conv_id"))
    same = rows.withColumn("cid", cid).groupBy("cid", "conv_id", "turn", "role", "text").agg(F.count("*").alias("n")).withColumn("name", F.sha2("text", 256))
    first = same.groupBy("cid", "role", "name").agg(F.min(at).alias("first"))
    solid = F.btrim("text", F.lit(BLANKS))
    same = same.join(first, ["cid", "role", "name"]).withColumn("blank", solid == "").withColumn("seen", at > F.col("first"))
    same = same.withColumn("go", F.col("blank") | F.col("seen")).withColumn("cut", ~F.right(solid, F.lit(1)).isin(".", "!", "?"))
    # equal rows are one now, so order deals them out evenly
    dealt = same.repartitionByRange(parts, "cid", "turn", "role", F.substring("text", 1, 64)).withColumn("seg", F.spark_partition_id().cast("long"))
    cut = common.written(dealt.select("cid", "seg", "turn", "role", "text", "n", "go", "cut"), "segments")
    turns = same.groupBy("cid", "turn").agg(F.first("conv_id").alias("conv_id"), *_sums()).groupBy("cid").agg(
        F.first("conv_id").alias("conv_id"), F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")],
    )

    def summed(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = ordered(pdf)
        initials = [r[:1] for r in pdf["role"]]
        illegal = sum(int(n - 1) for r, n in zip(initials, pdf["n"], strict=True) if r + r not in LEGAL) + sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
        return pd.DataFrame([(*key, matrix(pdf).ravel().tolist(), illegal, initials[0], initials[-1])], columns=["cid", "seg", "costs", "illegal", "head", "tail"])

    parts_of = common.written(cut.groupBy("cid", "seg").applyInPandas(summed, "cid string, seg long, costs array<long>, illegal long, head string, tail string"), "matrices")

    def between(key, pdf: pd.DataFrame) -> pd.DataFrame:
        """The vectors after each segment, from the last on: a row for each partition at most."""
        pdf = pdf.sort_values("seg", ignore_index=True)
        vector, vectors = np.array(END), []
        for costs in reversed(pdf["costs"].tolist()):
            vectors.append(vector.tolist())
            vector = (np.array(costs).reshape(4, 4) + vector).min(axis=1)
        stitched = sum(a + b not in LEGAL for a, b in zip(pdf["tail"], pdf["head"][1:], strict=False))
        return pd.DataFrame({"cid": key[0], "seg": pdf["seg"], "after": vectors[::-1], "illegal": int(pdf["illegal"].sum()) + stitched, "cost": int(vector[0])})

    vectors = common.written(parts_of.groupBy("cid").applyInPandas(between, "cid string, seg long, after array<long>, illegal long, cost long"), "vectors")
    placed = cut.join(F.broadcast(vectors.select("cid", "seg", "after")), ["cid", "seg"])

    def traced(pdf: pd.DataFrame) -> tuple[Automaton, list[int], list[int], np.ndarray]:
        kinds, more = run_kinds(pdf)
        automaton = Automaton(tuple(int(x) for x in pdf["after"].iloc[0]))
        after, _, _ = automaton.scan(np.array(kinds, np.int64), np.array([0, len(kinds)]))
        return automaton, kinds, after.tolist(), more

    def led(key, pdf: pd.DataFrame) -> pd.DataFrame:
        automaton, kinds, after, _ = traced(ordered(pdf))
        return pd.DataFrame([(*key, [automaton.trace(kinds, after, q)[1] for q in range(4)])], columns=["cid", "seg", "leads"])

    leads = placed.groupBy("cid", "seg").applyInPandas(led, "cid string, seg long, leads array<long>")

    def entered(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, q, states = pdf.sort_values("seg", ignore_index=True), 0, []
        for leads in pdf["leads"]:
            states.append(q)
            q = int(leads[q])
        return pd.DataFrame({"cid": key[0], "seg": pdf["seg"], "enter": states, "last": pdf["seg"] == pdf["seg"].max()})

    enter = common.written(leads.groupBy("cid").applyInPandas(entered, "cid string, seg long, enter long, last boolean"), "entered")

    def repaired_piece(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = ordered(pdf)
        automaton, kinds, after, more = traced(pdf)
        q, letters, said = int(pdf["enter"].iloc[0]), [], []
        for own, role, text, n in zip(automaton.trace(kinds, after, q)[0], pdf["role"], pdf["text"], more.tolist(), strict=True):
            new, q = lines(own, q, role, text)
            said += new
            letters += [own, "D" * n]
        if pdf["last"].iloc[0]:
            letters.append(last_letters(q))
            said += lines(letters[-1], q)[0]
        return pd.DataFrame([(*key, "".join(letters), "\n".join(said) if said else None)], columns=["cid", "seg", "audit", "said"])

    pieces = placed.join(F.broadcast(enter), ["cid", "seg"]).groupBy("cid", "seg").applyInPandas(repaired_piece, "cid string, seg long, audit string, said string")

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True))
        for cid, own in groupby(rows, key=lambda r: r[0]):
            digest, audit, begun = hashlib.sha256(), [], False
            for _, letters, said in own:
                audit.append(letters)
                if said is not None:
                    digest.update((("\n" if begun else "") + said).encode("utf-8", "surrogatepass"))
                    begun = True
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (cid, "".join(audit), digest.hexdigest())], ["cid", "audit", "repaired_sha256"])

    joined = pieces.repartition(parts, "cid").sortWithinPartitions("cid", "seg").mapInArrow(together, "cid string, audit string, repaired_sha256 string")
    out = turns.join(vectors.select("cid", "illegal", "cost").distinct(), "cid").join(joined, "cid").select("conv_id", *NAMES)
    out = common.written(out, "long")
    common.dropped(cut, parts_of, vectors, enter)
    return out.select(F.col("conv_id").cast(kind).alias("conv_id"), *NAMES)


def _sums() -> list[Column]:
    """First faults of counted rows: the first of equal rows may be sound, the others are duplicates."""
    blank, seen, n = F.col("blank"), F.col("seen"), F.col("n")
    return [
        F.sum(F.when(blank, n).otherwise(0)).alias("blank"), F.sum(F.when(blank, 0).when(seen, n).otherwise(n - 1)).alias("duplicate"),
        F.sum(F.when(~blank & ~seen & F.col("cut"), 1).otherwise(0)).alias("truncated"),
    ]


def repaired(rows: DataFrame) -> DataFrame:
    """Per conversation: conv_id and NAMES. rows as `damaged` or `kept_rows` give them."""
    spark, parts = rows.sparkSession, common.shuffle_partitions(rows.sparkSession)
    weight = F.when(F.col("gone"), 0).otherwise(F.octet_length("text") + 64).cast("long")
    sizes = rows.groupBy("conv_id").agg(F.sum(weight).alias("bytes"), F.sum(F.col("gone").cast("long")).alias("n_gone"))
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    parts = max(parts, -(-total // (4 * HOT_BYTES)))
    # each holds over a quarter of a partition's share, so there are fewer than 4 * parts
    hot = [(r[0],) for r in sizes.where(F.col("bytes") > max(HOT_BYTES, total // (4 * parts))).select("conv_id").collect()]
    if not hot:
        return whole(rows, parts)
    large = F.broadcast(spark.createDataFrame(hot, rows.select("conv_id").schema).withColumnRenamed("conv_id", "large"))
    is_large = F.col("conv_id").eqNullSafe(F.col("large"))
    return whole(rows.join(large, is_large, "left_anti"), parts).unionByName(segments(rows.join(large, is_large, "left_semi").where("not gone"), parts))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(damaged(common.table(spark, sf_dir, "conversations")))


def _least(*some: str) -> str:
    return f"list_sort([{', '.join(some)}])[1]"


def _edit(state: str, cost: str, letter: str, line: str = "") -> str:
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'r': {state}.r" + (f" || chr(10) || {line}" if line else "") + "}"


def _kept(state: str, initial: str) -> str:
    return _edit(state, f"(CASE WHEN NOT go AND left(role, 1) = '{initial}' THEN cut ELSE 1000000000 END)", "K", "role || ':' || text")


def _reroled(state: str, role: str) -> str:
    return _edit(state, f"(CASE WHEN go THEN 1000000000 ELSE {REROLE} + cut END)", "R", f"'{role}:' || text")


def _inserted(state: str, role: str) -> str:
    return _edit(state, str(INSERT), "I", f"'{role}:'")


_DELETED = {q: _edit(f"s{q}", str(DELETE), "D") for q in range(4)}

#: The plain recursion over rows: for each state the cheapest edits so far, of equal costs the least letters.
ORACLE_SQL = rf"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda n: list_reduce([n] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
said AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
fated AS (
  SELECT conv_id, turn, role, text, xor(4294967295, list_reduce([4294967295] || list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 20 AS fate
  FROM said, crc
),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM fated, range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)
),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
looked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen, regexp_replace(text, '[\x20\x09-\x0D]', '', 'g') AS solid, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM placed
),
judged AS (SELECT *, solid = '' OR seen AS go, (right(solid, 1) NOT IN ('.', '!', '?'))::INT AS cut FROM looked),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, {{'c': 0, 'a': '', 'r': ''}} AS s0, {{'c': 1000000000, 'a': '', 'r': ''}} AS s1, {{'c': 2, 'a': 'I', 'r': chr(10) || 'user:'}} AS s2,
         {{'c': 4, 'a': 'II', 'r': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS s3
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, s0, s1, s2, {_least("s3", _inserted("s2", "assistant"))} FROM (
    SELECT conv_id, i, n0 AS s0, n1 AS s1, {_least("n2", _inserted("n0", "user"), _inserted("n1", "user"), _inserted("n3", "user"))} AS s2, n3 AS s3 FROM (
      SELECT w.conv_id, j.i, {_DELETED[0]} AS n0, {_least(_DELETED[1], _kept("s0", "s"))} AS n1,
             {_least(_DELETED[2], *[f(f"s{q}", x) for q in (0, 1, 3) for f, x in ((_kept, "u"), (_reroled, "user"))])} AS n2,
             {_least(_DELETED[3], _kept("s2", "a"), _reroled("s2", "assistant"))} AS n3
      FROM walk w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.i = w.i + 1))
),
ends AS (SELECT conv_id, {_least("s0", "s3")} AS best FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (solid = '') AS blank, count(*) FILTER (solid <> '' AND seen) AS duplicate,
         count(*) FILTER (NOT go AND cut = 1) AS truncated, count(*) FILTER (before IS NOT NULL AND before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id
)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       best.c::BIGINT AS cost, best.a AS audit, sha256(best.r[2:]) AS repaired_sha256
FROM ends e LEFT JOIN counts c ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""
