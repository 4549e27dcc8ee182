"""N-gram Jaccard join with set-relation skipping.

A document's set is that of its word 5-grams (64-bit hashes). Equal sets are one set from the start; each set is known by a 64-bit
signature. Sets that share a signature but differ in 64 further bits get names of their own before anything is joined, so sets are told apart by 128 bits.

1. Grams are ordered by rarity, counted over all documents in a sketch of fixed size (rarer first, then by hash), so that only
   grams of very similar sets have long lists. Two sets with Jaccard 0.75 or more share a gram among
   each one's first |s| - ceil(0.75 |s|) + 1 grams (its prefix).
2. Prefix grams are dealt out in packed lists by hash. In a list (all sets with the same prefix gram) entries stand in
   blocks of equal size and position, each with one header. Headers are compared, not entries: a block whose size or position bounds
   can't reach the threshold is skipped as a whole.
   In short lists every pair of the blocks that are left is a candidate. In long ones each set is paired with its hub (the first set of the list whose
   size fits) and with its neighbour only. Shared prefix grams are counted for each pair; a pair whose count and last shared place
   can't reach the threshold is dropped.
3. Candidates are verified by the whole sets, made anew from the texts. Sets that verified links already connect need no answer of their own.
4. Where a long list's members are still in several components, members that the bounds allow to be linked
   make groups (again header by header); in a group, the members outside its largest component are held against all members, block by block, each
   block's sets once. There answers are derived: what a set shares with each other set is what a highly similar set, its hub, shares with it, less the
   grams that only the hub has, plus those that only the set has; just these few grams are looked up. Thus every pair that the bounds
   allow is either compared or already connected, and components are exact.

No list is expanded to its pairs as rows, and no task holds more than a block of a thousand sets against another, or lists' names.

Defined results: null, empty and blank texts have the empty set, link with nothing and are their own component; a text of fewer than five
words has its whole word sequence as its only gram; a null doc_id is never the smallest; rows that share a doc_id are nodes of their own;
repeated rows have one and the same set and component; an empty table gives no rows; other columns are ignored, whatever their names.
Words are hashed place by place, so only chance (2^-64 for a pair of words or grams) makes different ones equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, links

GRAM = 5
#: A link: LINK[1] * intersection >= LINK[0] * union.
LINK = (3, 4)
SKETCH_BITS = 16
SKETCH_PARTS = 64
#: Lists of at most so many sets give all their pairs at once.
SHORT_LIST = 32
#: Sets of one block of a group.
BLOCK = 1000
#: Hubs of a block whose answers are kept to derive others from.
HUBS = 4
#: Bits of a set's signature (fewer only in tests), and signatures at most that several sets may share: chance gives n^2 / 2^65 among n sets, 11 among 2e10.
NAME_BITS, MOST_SHARED = 64, 10_000
#: Prefix grams that a worker holds before it sends them on.
HELD = 2_000_000


def needed(a, b):
    """Least intersection of linked sets of the sizes a and b."""
    top, bottom = LINK
    return -(-(top * (a + b)) // (top + bottom))


def prefix_length(n):
    top, bottom = LINK
    return n - -(-(top * n) // bottom) + 1


def sets_of(data: np.ndarray, offsets: np.ndarray, k: int = GRAM) -> list[np.ndarray]:
    """The set of each text, sorted."""
    words, first = common.word_hashes(data, offsets, common.SOLID)
    grams = common.gram_hashes(words, k)
    out = []
    for i in range(len(offsets) - 1):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:  # fewer words: their sequence as a whole, told apart from grams by its length
            out.append(common.mixed(common.gram_hashes(words[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(s: np.ndarray) -> int:
    """64-bit name of a set."""
    salted = common.mixed(s ^ common.MIX2)
    both = salted.sum(dtype=np.uint64, keepdims=True) * common.PRIME + np.bitwise_xor.reduce(salted, keepdims=True) + np.uint64(len(s))
    return int(common.mixed(both).view(np.int64)[0])


def further(s: np.ndarray) -> int:
    """64 more bits of a set, made from other values than its signature."""
    salted = common.mixed(s ^ common.PRIME)
    both = salted.sum(dtype=np.uint64, keepdims=True) * common.MIX1 + np.bitwise_xor.reduce(salted, keepdims=True) + np.uint64(len(s))
    return int(common.mixed(both).view(np.int64)[0])


class Names:
    """Names of sets: the signature, or the name that stands for signature and further bits where several sets share a signature."""

    def __init__(self, bits: int, others: dict[int, dict[int, int]]):
        self.bits, self.others = bits, others

    def __call__(self, s: np.ndarray) -> int:
        sid = signature(s) >> (64 - self.bits)
        return self.others[sid].get(further(s), sid) if sid in self.others else sid


def shared(rows: DataFrame) -> dict[int, dict[int, int]]:
    """Names of sets by signature and further bits, where a signature is that of several sets. rows: sid, further. Hardly ever any, so they go to the driver."""
    twice = rows.groupBy("sid").agg(F.min("further").alias("low"), F.max("further").alias("high")).where("low <> high")
    signatures = [r["sid"] for r in twice.select("sid").limit(MOST_SHARED + 1).collect()]
    if len(signatures) > MOST_SHARED:
        raise RuntimeError(f"more than {MOST_SHARED} signatures are shared by different sets")
    out: dict[int, dict[int, int]] = {}
    if signatures:
        for r in rows.where(F.col("sid").isin(signatures)).distinct().collect():
            pair = np.array([r["sid"], r["further"]], np.int64).view(np.uint64)
            out.setdefault(r["sid"], {})[r["further"]] = int(common.mixed(common.mixed(pair[:1]) + pair[1:]).view(np.int64)[0])
    return out


def batch_sets(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray]]:
    for first, _, data, offsets in common.text_slices(batch.column(column)):
        yield from enumerate(sets_of(data, offsets), first)


def described(docs: DataFrame, text: str, id_col: str) -> tuple[DataFrame, np.ndarray, Names]:
    """Table of rows (doc_id, n, sid), the sketch of gram counts over all rows, 2 ** SKETCH_BITS numbers, and the names of sets."""
    plain = Names(NAME_BITS, {})
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType
    ids = pa.int32() if kind.simpleString() == "int" else pa.string() if kind.simpleString() == "string" else pa.int64()

    columns = ["doc_id", "n", "sid", "further", "part", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(1 << SKETCH_BITS, np.int64), set()
        for batch in batches:
            n, sid, more = np.zeros((3, batch.num_rows), np.int64)
            for i, s in batch_sets(batch, 1):
                n[i], sid[i], more[i] = len(s), plain(s), further(s)
                if len(s) and sid[i] not in seen:
                    seen.add(sid[i])
                    np.add.at(counts, (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
            none = pa.nulls(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(ids), pa.array(n), pa.array(sid), pa.array(more), none.cast(pa.int64()), none.cast(pa.binary())], columns)
        parts = counts.reshape(SKETCH_PARTS, -1)
        none = pa.nulls(SKETCH_PARTS)
        worker = np.full(SKETCH_PARTS, TaskContext.get().partitionId())
        yield pa.RecordBatch.from_arrays([none.cast(ids), pa.array(worker), none.cast(pa.int64()), none.cast(pa.int64()), pa.array(np.arange(SKETCH_PARTS)), pa.array([p.tobytes() for p in parts], pa.binary())], columns)

    both = common.written(rows.mapInArrow(run, f"doc_id {kind.simpleString()}, n long, sid long, further long, part long, counts binary"), "sets")

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, np.int64) for c in pdf["counts"])
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "counts": [total.tobytes()]})

    tree = both.where("part is not null").select("part", F.expr("n div 256").alias("branch"), "counts")
    tree = tree.groupBy("part", "branch").applyInPandas(added, "part long, counts binary").groupBy("part").applyInPandas(added, "part long, counts binary")
    sketch = np.zeros((SKETCH_PARTS, (1 << SKETCH_BITS) // SKETCH_PARTS), np.int64)
    for part, counts in tree.collect():  # always SKETCH_PARTS rows
        sketch[part] = np.frombuffer(counts, np.int64)
    found = both.where("part is null").select("doc_id", "n", "sid", "further")
    names = Names(NAME_BITS, shared(found.where("n > 0").select("sid", "further")))
    if names.others:
        given = [(sid, more, name) for sid, others in names.others.items() for more, name in others.items()]
        given = docs.sparkSession.createDataFrame(given, "sid long, further long, name long")  # a few for each of MOST_SHARED signatures
        found = found.join(F.broadcast(given), ["sid", "further"], "left").withColumn("sid", F.coalesce("name", "sid"))
    return found.select("doc_id", "n", "sid"), sketch.ravel(), names


def prefixes(docs: DataFrame, text: str, sketch: np.ndarray, names: Names, buckets: int) -> DataFrame:
    """Prefix grams in blocks by bucket: bucket, grams, sids, sizes, places (packed arrays)."""
    order = sketch.astype(np.uint32)

    def packed(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        grams, sids, sizes, places = (np.concatenate(x) for x in zip(*held, strict=True))
        bucket = (common.mixed(grams) % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
        rows = [(b, *[x[by[cuts[b] : cuts[b + 1]]].tobytes() for x in (grams, sids, sizes, places)]) for b in range(buckets) if cuts[b] < cuts[b + 1]]
        for at in range(0, len(rows), 64):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i == 0 else pa.binary()) for i, c in enumerate(zip(*rows[at : at + 64], strict=True))], ["bucket", "grams", "sids", "sizes", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, seen = [], 0, set()
        for batch in batches:
            for _, s in batch_sets(batch, 0):
                if not len(s) or (sid := names(s)) in seen:
                    continue
                seen.add(sid)
                rank = np.argsort(order[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")
                first = s[rank[: prefix_length(len(s))]]
                held.append((first, np.full(len(first), sid, np.int64), np.full(len(first), len(s), np.uint32), np.arange(len(first), dtype=np.uint32)))
                total += len(first)
                if total >= HELD:
                    yield from packed(held)
                    held, total = [], 0
        if held:
            yield from packed(held)

    return docs.select(text).mapInArrow(run, "bucket long, grams binary, sids binary, sizes binary, places binary")


def fits(size_a, place_a, size_b, place_b) -> np.ndarray:
    """Whether sets of such sizes that share a gram at such places of their prefixes can be linked."""
    top, bottom = LINK
    small, large = np.minimum(size_a, size_b), np.maximum(size_a, size_b)
    most = np.minimum(place_a, place_b) + 1 + np.minimum(size_a - place_a, size_b - place_b) - 1
    return (bottom * small >= top * large) & (most >= needed(size_a, size_b))


def block_pairs(gram: np.ndarray, size: np.ndarray, place: np.ndarray, wanted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of entries of one list, of those blocks (equal gram, size and place) whose headers can be linked."""
    if not len(gram):
        return
    start = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (size[1:] != size[:-1]) | (place[1:] != place[:-1])]))
    count = np.diff(np.concatenate([start, [len(gram)]]))
    gram, size, place, wanted = gram[start], size[start], place[start], wanted[start]
    for step in range(min(SHORT_LIST, len(start))):
        a = np.arange(len(start) - step)
        a = a[wanted[a] & (gram[a] == gram[a + step])]
        a = a[fits(size[a], place[a], size[a + step], place[a + step])]
        if step == 0:
            a = a[count[a] > 1]
        pairs = count[a] * count[a + step]
        nth = np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        wide = np.repeat(count[a + step], pairs)
        x, y = np.repeat(start[a], pairs) + nth // wide, np.repeat(start[a + step], pairs) + nth % wide
        yield (x[x < y], y[x < y]) if step == 0 else (x, y)


def listed(pdf: pd.DataFrame) -> pd.DataFrame:
    """Candidate pairs (list null) and members of long lists (list given) of one bucket."""
    gram, sid, size, place = (np.concatenate([np.frombuffer(x, t) for x in pdf[c]]) for c, t in (("grams", np.uint64), ("sids", np.int64), ("sizes", np.uint32), ("places", np.uint32)))
    by = np.argsort(gram, kind="stable")
    same = gram[by[1:]] == gram[by[:-1]]
    by = by[np.concatenate([same, [False]]) | np.concatenate([[False], same])]  # a gram that only one set has links nothing
    gram, sid, size, place = gram[by], sid[by], size[by].astype(np.int64), place[by].astype(np.int64)
    by = np.lexsort((sid, place, size, gram))  # blocks of equal size and place
    gram, sid, size, place = gram[by], sid[by], size[by], place[by]
    if len(gram):  # equal sets from several workers
        new = np.concatenate([[True], (gram[1:] != gram[:-1]) | (sid[1:] != sid[:-1])])
        gram, sid, size, place = gram[new], sid[new], size[new], place[new]
    starts = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.zeros(0, np.int64)
    counts = np.diff(np.concatenate([starts, [len(gram)]]))
    short = np.repeat(counts <= SHORT_LIST, counts)
    pairs = [(np.zeros((0, 6), np.int64), 0)]  # with the number of grams that each row stands for

    def offer(a: np.ndarray, b: np.ndarray, grams: int) -> None:
        ok = fits(size[a], place[a], size[b], place[b]) & (sid[a] != sid[b])
        a, b = a[ok], b[ok]
        a, b = np.where(sid[a] < sid[b], a, b), np.where(sid[a] < sid[b], b, a)
        pairs.append((np.stack([sid[a], sid[b], size[a], size[b], place[a], place[b]], 1), grams))

    for a, b in block_pairs(gram, size, place, short):
        offer(a, b, 1)
    lists, known = [], set()
    for start, count in zip(starts[counts > SHORT_LIST].tolist(), counts[counts > SHORT_LIST].tolist(), strict=True):
        members = slice(start, start + count)
        name = (count, int(common.mixed(sid[members].view(np.uint64)).sum(dtype=np.uint64)))
        if name in known:  # another gram with the same list has no new pairs
            continue
        known.add(name)
        a = np.arange(start, start + count)
        hub = start + np.searchsorted(size[members], -(-LINK[0] * size[members] // LINK[1]))
        offer(hub, a, 0)
        offer(a[:-1], a[1:], 0)
        lists.append((np.full(count, gram[start].view(np.int64)), sid[members], size[members], place[members]))
    rows = np.concatenate([np.column_stack([p, np.full(len(p), grams)]) for p, grams in pairs])
    rows = rows[np.lexsort(rows[:, 1::-1].T)]
    new = np.flatnonzero(np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(1)])) if len(rows) else np.zeros(0, np.int64)
    shared, last = (np.add.reduceat(rows[:, 6], new), np.maximum.reduceat(rows[:, 4:6], new)) if len(new) else (new, np.zeros((0, 2), np.int64))
    none = lambda n: pd.array([pd.NA] * n, "Int64")
    kept_sid, kept_at = np.unique(sid, return_inverse=True)
    in_long = np.bincount(kept_at[~short], minlength=len(kept_sid))
    out = [pd.DataFrame({"list": none(len(new)), "a": rows[new, 0], "b": pd.array(rows[new, 1], "Int64"), "na": rows[new, 2], "nb": rows[new, 3], "pa": last[:, 0], "pb": last[:, 1], "grams": shared})]
    out.append(pd.DataFrame({"list": none(len(kept_sid)), "a": kept_sid, "b": none(len(kept_sid)), "na": 0, "nb": 0, "pa": 0, "pb": 0, "grams": in_long}))
    out += [pd.DataFrame({"list": pd.array(name, "Int64"), "a": s, "b": none(len(s)), "na": n, "nb": 0, "pa": p, "pb": 0, "grams": 0}) for name, s, n, p in lists]
    return pd.concat(out, ignore_index=True)


def reachable(shared, size_a, size_b, place_a, place_b):
    """Whether two sets can be linked that share at most `shared` prefix grams, one of them at the given places.

    Beyond that place, and beyond the prefix that ends first, they share no more than what is left of either set.
    """
    top, bottom = LINK
    after_place = np.minimum(size_a - place_a, size_b - place_b) - 1
    after_prefix = -(-top * np.maximum(size_a, size_b) // bottom) - 1
    return (shared + np.minimum(after_place, after_prefix)) * (top + bottom) >= top * (size_a + size_b)


def forest(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of the pairs of each long list that the bounds allow, as many as hold its members together.

    Pairs that share a gram of a short list have been decided before, so only grams of long lists count here. The bounds see only size, place and
    the number of such grams, so members that agree in these are one block: headers are compared, and a block's members hang on its first.
    """
    pdf = pdf.sort_values(["list", "size", "place", "far", "sid"])
    name, sid, size, place, far = (pdf[c].to_numpy(np.int64) for c in ("list", "sid", "size", "place", "far"))  # far: prefix grams in long lists
    new = np.concatenate([[True], (np.diff(name) != 0) | (np.diff(size) != 0) | (np.diff(place) != 0) | (np.diff(far) != 0)]) if len(name) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    block = np.cumsum(new) - 1
    name, size, place, far = (c[first] for c in (name, size, place, far))
    many = np.bincount(block, minlength=len(first)) > 1 if len(first) else np.zeros(0, bool)
    top, bottom = LINK

    def near(x, others: np.ndarray) -> np.ndarray:
        close = bottom * np.minimum(size[x], size[others]) >= top * np.maximum(size[x], size[others])
        return close & reachable(np.minimum(far[x], far[others]), size[x], size[others], place[x], place[others])

    every = np.arange(len(first))
    joined_ = many & near(every, every) if len(first) else many
    out = []
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(name)) + 1, [len(name)]]).tolist()
    for start, end in zip(cuts[:-1], cuts[1:], strict=True):
        left = np.arange(start, end)
        while len(left):
            todo, left = [int(left[0])], left[1:]
            while todo and len(left):
                x = todo.pop()
                ok = near(x, left)
                if ok.any():
                    todo += left[ok].tolist()
                    joined_[x] = True
                    joined_[left[ok]] = True
                    out.append(np.stack([np.full(ok.sum(), sid[first[x]]), sid[first[left[ok]]]], 1))
                    left = left[~ok]
    if len(first):
        inside = joined_[block] & ~new
        out.append(np.stack([sid[first[block[inside]]], sid[inside]], 1))
    pairs = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)
    return pd.DataFrame(pairs, columns=["a", "b"])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sets are linked; texts (sid, text) holds one text of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = (None, None)
        for batch in batches:
            a, b, keep = batch.column(0), batch.column(1), np.zeros(batch.num_rows, bool)
            ta, tb = batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                if last[0] != a[i]:
                    last = (a[i], one_set(ta[i].as_py()))
                x, y = last[1], one_set(tb[i].as_py())
                keep[i] = len(np.intersect1d(x, y, assume_unique=True)) >= needed(len(x), len(y))
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(keep))

    first = texts.select(F.col("sid").alias("a"), F.col("text").alias("ta"))
    second = texts.select(F.col("sid").alias("b"), F.col("text").alias("tb"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def one_set(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return sets_of(data, np.array([0, len(data)]))[0]


def named_texts(docs: DataFrame, text: str, names: Names) -> DataFrame:
    """sid, text: once for each set and worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            keep, sids = [], []
            for i, s in batch_sets(batch, 0):
                if len(s) and (sid := names(s)) not in seen:
                    seen.add(sid)
                    keep.append(i)
                    sids.append(sid)
            yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), batch.column(0).take(pa.array(keep, pa.int64()))], ["sid", "text"])

    return docs.select(text).mapInArrow(run, "sid long, text string")


class Answers:
    """What sets share with each of some members, by lists of the members' grams."""

    def __init__(self, members: list[np.ndarray]):
        gram = np.concatenate(members)
        by = np.argsort(gram, kind="stable")
        self.owner = np.repeat(np.arange(len(members)), [len(s) for s in members])[by]
        self.gram, self.first = np.unique(gram[by], return_index=True)
        self.count = np.diff(np.concatenate([self.first, [len(gram)]]))
        self.members = len(members)
        self.hubs: list[tuple[np.ndarray, np.ndarray]] = []

    def looked_up(self, grams: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.gram, grams), len(self.gram) - 1)
        at = at[self.gram[at] == grams]
        counts = self.count[at]
        entries = np.repeat(self.first[at] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        return np.bincount(self.owner[entries], minlength=self.members)

    def __call__(self, s: np.ndarray) -> np.ndarray:
        """Overlaps of s with all members, derived from the nearest hub's where that has most of its grams."""
        best, rest = None, len(s) // 2
        for hub, answer in self.hubs:
            common_ = np.isin(s, hub, assume_unique=True)
            extra = len(s) + len(hub) - 2 * int(common_.sum())
            if extra <= rest:
                best, rest = (hub, answer, common_), extra
        if best is None:
            out = self.looked_up(s)
            self.hubs = [*self.hubs[-HUBS + 1 :], (s, out)]
            return out
        hub, answer, common_ = best
        return answer - self.looked_up(hub[~np.isin(hub, s, assume_unique=True)]) + self.looked_up(s[~common_])


def block_links(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links between the open members (side 0) and the members (side 1) of two blocks, one for each pair of components.

    A member that is open and whose group is one block comes once, as side 2.
    """
    sets = [one_set(t) for t in pdf["text"]]
    side, sid, root = pdf["side"].to_numpy(), pdf["sid"].to_numpy(), pdf["root"].to_numpy()
    rows, cols = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    out = [np.zeros((0, 4), np.int64)]
    if len(rows) and len(cols):
        answers, n = Answers([sets[i] for i in cols]), np.array([len(sets[i]) for i in cols])
        for i in rows[np.argsort(root[rows], kind="stable")].tolist():  # a component's sets are alike
            linked = np.flatnonzero((answers(sets[i]) >= needed(len(sets[i]), n)) & (root[cols] != root[i]))
            found = cols[linked]
            out.append(np.column_stack([np.full(len(found), sid[i]), sid[found], np.full(len(found), root[i]), root[found]]))
    pairs = pd.DataFrame(np.concatenate(out), columns=["a", "b", "ra", "rb"])
    return pairs.drop_duplicates(["ra", "rb"])[["a", "b"]]


def joined(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, n, sid; links between sets: a, b that connect all linked sets)."""
    spark = docs.sparkSession
    common.shipped(spark)
    rows, sketch, names = described(docs, text, id_col)
    blocks = prefixes(docs, text, sketch, names, 4 * common.shuffle_partitions(spark))
    found = common.written(blocks.groupBy("bucket").applyInPandas(listed, "list long, a long, b long, na long, nb long, pa long, pb long, grams long"), "lists")
    lists = found.where("list is not null").select("list", F.col("a").alias("sid"), F.col("na").alias("size"), F.col("pa").alias("place"))
    # grams in long lists aren't counted for each pair; a pair shares at most as many as either set has
    far = common.written(found.where("list is null and b is null").groupBy("a").agg(F.sum("grams").alias("far")).where("far > 0"), "far")
    counted = found.where("list is null and b is not null").groupBy("a", "b", "na", "nb").agg(F.sum("grams").alias("grams"), F.max("pa").alias("pa"), F.max("pb").alias("pb"))
    counted = counted.join(far.select("a", F.col("far").alias("fa")), "a", "left").join(far.select(F.col("a").alias("b"), F.col("far").alias("fb")), "b", "left")
    top, bottom = LINK
    after = f"least(na - pa - 1, nb - pb - 1, ({top} * greatest(na, nb) + {bottom - 1}) div {bottom} - 1)"
    pairs = counted.where(f"(grams + least(coalesce(fa, 0), coalesce(fb, 0)) + {after}) * {top + bottom} >= {top} * (na + nb)")
    pairs = common.written(pairs.select("a", "b"), "pairs")
    texts = texts_of(docs, text, names, pairs.select(F.explode(F.array("a", "b")).alias("sid")).unionByName(lists.select("sid")))
    sure = common.written(verified(pairs, texts), "links")
    if lists.isEmpty():
        return rows, sure
    roots = links.components(sure)
    members = lists.join(roots, lists["sid"] == roots["node"], "left").select("list", "sid", "size", "place", F.coalesce("root", "sid").alias("root"))
    members = common.written(members.join(far.select(F.col("a").alias("sid"), "far"), "sid"), "members")
    still = members.groupBy("list").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("list")
    held = members.join(still, "list").withColumn("part", F.pmod("list", F.lit(4 * common.shuffle_partitions(spark)))).groupBy("part").applyInPandas(forest, "a long, b long")
    groups = links.components(held)
    inside = common.written(members.select("sid", "root").distinct().join(groups, F.col("sid") == F.col("node")).select("sid", groups["root"].alias("group"), members["root"].alias("root")), "inside")
    sizes = inside.groupBy("group", "root").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("group").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("members"))
    sizes = sizes.select("group", F.col("top.root").alias("main"), F.ceil(F.col("members") / BLOCK).alias("blocks"), F.ceil((F.col("members") - F.col("top.n")) / BLOCK).alias("open_blocks")).where("open_blocks > 0")
    inside = inside.join(sizes, "group")
    place = lambda n: F.pmod(F.xxhash64("sid"), F.col(n))
    other = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    single = F.col("blocks") == 1
    one = inside.where(single).select("sid", "root", "group", F.when(F.col("root") != F.col("main"), 2).otherwise(1).alias("side"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"))
    open_ = inside.where(~single & (F.col("root") != F.col("main"))).select("sid", "root", "group", F.lit(0).alias("side"), place("open_blocks").alias("x"), other("blocks").alias("y"))
    every = inside.where(~single).select("sid", "root", "group", F.lit(1).alias("side"), other("open_blocks").alias("x"), place("blocks").alias("y"))
    blocks = common.written(one.unionByName(open_).unionByName(every), "blocks")
    if blocks.isEmpty():
        return rows, sure
    more = blocks.join(texts, "sid").groupBy("group", "x", "y").applyInPandas(block_links, "a long, b long")
    return rows, sure.unionByName(common.written(more, "links"))


def texts_of(docs: DataFrame, text: str, names: Names, wanted: DataFrame) -> DataFrame:
    """sid, text of the wanted sets."""
    return common.written(named_texts(docs, text, names).join(wanted.distinct(), "sid", "left_semi").groupBy("sid").agg(F.min("text").alias("text")), "texts")


def classes(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id."""
    rows, sure = joined(docs, text, id_col)
    roots = links.components(sure)
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    least = rows.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("least"))
    least = common.written(least.join(roots, least["sid"] == roots["node"], "left").select("sid", "least", "root"), "least")
    linked = least.where("root is not null")
    top = linked.groupBy(F.col("root").alias("u")).agg(F.min("least").alias("m"))
    named = links.with_least(linked.select(F.col("root").alias("u"), F.col("sid").alias("v")), top).select(F.col("v").alias("sid"), F.col("m").alias("component_id"))
    named = named.unionByName(least.where("root is null").select("sid", F.col("least").alias("component_id")))
    out = rows.join(named, "sid", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def kept(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Of each component's rows the one with the smallest id (null after all others; of equal ids any one), with all columns; docs is a table as read.

    Rows without words are no one's copies and stay.
    """
    rows, number = common.numbered(docs)
    found = classes(rows, text, number).select(F.col("doc_id").alias("number"), "component_id")
    ids = rows.select(F.col(number).alias("number"), F.col(id_col).alias("id"))
    least = found.join(ids, "number").groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "number")).alias("least"))
    return rows.join(least.select(F.col("least.number").alias(number)), number, "left_semi").select(*[rows[c] for c in docs.columns])


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(common.table(spark, sf_dir, "documents"))


ORACLE_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
g AS MATERIALIZED (
  SELECT DISTINCT r, array_to_string(w[p:p + {GRAM - 1}], ' ') AS t
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - {GRAM - 1}, 1) + 1)) AS p FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM g GROUP BY r),
o AS (SELECT a.r AS x, b.r AS y, count(*) AS o FROM g a JOIN g b ON a.t = b.t AND a.r < b.r GROUP BY a.r, b.r),
l AS MATERIALIZED (
  SELECT x, y FROM o JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE 100 * o >= 75 * (a.n + b.n - o)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
c AS (SELECT r, r AS s FROM w UNION SELECT c.r, e.y FROM c JOIN e ON e.x = c.s)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, k.component_id
FROM w LEFT JOIN n USING (r) JOIN (SELECT c.r, min(d.doc_id) AS component_id FROM c JOIN w d ON d.r = c.s GROUP BY c.r) k USING (r)
"""
