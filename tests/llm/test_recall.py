"""Near-duplicate passages against brute force: pairs by length and number of edits, hubs, frequent lines, long texts; hashes of words."""

from collections import defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

from tidewalk.llm import common, jaccard_join, links, passages


def noise(rng, n):
    return [f"n{int(x)}" for x in rng.integers(0, 1 << 40, n)]


def shingles(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def similarity(p, q):
    a, b = shingles(p), shingles(q)
    return len(a & b) / len(a | b)


def edited(rng, words, edits):
    out = list(words)
    for place in rng.choice(len(words), edits, replace=False):
        out[place] = f"changed{int(rng.integers(0, 1 << 40))}"
    return out


@pytest.fixture(scope="module")
def planted(spark):
    """(cells of pairs, ids of a hub's documents, ids of pairs around a frequent line, ids without any passage, class of each id)."""
    rng = np.random.default_rng(5)
    texts, cells = [], defaultdict(list)
    around = lambda p: texts.append(" ".join(noise(rng, int(rng.integers(20, 50))) + list(p) + noise(rng, int(rng.integers(20, 50)))))
    for n in (50, 60, 80, 100, 150, 200):
        for edits in range(6):
            for _ in range(60):
                p = noise(rng, n)
                q = edited(rng, p, edits)
                if len(cells[n, edits]) < 12 and similarity(p, q) >= 0.75:
                    cells[n, edits].append(len(texts))
                    around(p), around(q)
    hub, start = noise(rng, 60), len(texts)
    for i in range(400):
        around(edited(rng, hub, 1 if i % 3 else 0))
    hub_ids = range(start, len(texts))
    line, pairs = noise(rng, 12), []
    for _ in range(100):
        p = noise(rng, 24) + line + noise(rng, 24)
        pairs.append(len(texts))
        around(p), around(edited(rng, p, 1))
    start = len(texts)
    for _ in range(50):
        around(line)
    order = rng.permutation(len(texts)).tolist()
    docs = spark.createDataFrame([(order[i], t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(6)
    rows = {r["doc_id"]: r for r in passages.classes(docs).collect()}
    return cells, hub_ids, pairs, range(start, len(texts)), [rows[order[i]] for i in range(len(texts))]


def test_edited_pairs_are_found_in_every_cell(planted):
    cells, _, _, _, rows = planted
    assert sum(len(c) > 0 for c in cells.values()) >= 24
    for cell, firsts in cells.items():
        if firsts:
            assert np.mean([rows[i]["class_id"] == rows[i + 1]["class_id"] for i in firsts]) >= 0.9, cell


def test_a_hub_is_one_class(planted):
    _, hub, _, _, rows = planted
    assert len({rows[i]["class_id"] for i in hub}) == 1 and all(rows[i]["n_passages"] > 0 for i in hub)


def test_a_frequent_line_hides_no_pair_and_links_nothing(planted):
    _, _, pairs, clean, rows = planted
    assert np.mean([rows[i]["class_id"] == rows[i + 1]["class_id"] for i in pairs]) >= 0.95
    assert all(rows[i]["n_passages"] == 0 and rows[i]["n_links"] == 0 for i in clean)
    assert len({rows[i]["class_id"] for i in pairs}) == len(pairs)


def test_windows_of_segments_are_those_of_the_whole(monkeypatch):
    grams = common.mixed(np.arange(5000, dtype=np.uint64) % np.uint64(3001))
    whole = [(w, set(zip(at.tolist(), key.tolist(), strict=True))) for w, at, _, _, key in passages.compact_windows(grams, np.array([0, len(grams)]))]
    monkeypatch.setattr(passages, "SEGMENT", 700)
    parts = defaultdict(set)
    for w, at, _, _, key in passages.every_window(grams, np.array([0, len(grams)])):
        parts[w] |= set(zip(at.tolist(), key.tolist(), strict=True))
    for w, windows in whole:
        assert windows <= parts[w]


def test_words_of_a_known_collision_stay_apart(spark):
    """Two words that any polynomial hash modulo 2^64 takes for one."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    one, two = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    docs = spark.createDataFrame([(1, one), (2, two), (3, " ".join([one] * 8)), (4, " ".join([two] * 8))], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in jaccard_join.classes(docs).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
    data = np.frombuffer(f"{one} {two} {one}".encode(), np.uint8)
    hashes, _ = common.word_hashes(data, np.array([0, len(data)]), common.SOLID)
    assert hashes[0] == hashes[2] != hashes[1]


@pytest.mark.parametrize("n,line,documents", [(50, 25, 200), (50, 35, 200), (50, 30, 2000)])
def test_identical_passages_around_a_frequent_line_are_found(spark, n, line, documents):
    """Every document has the line; each pair has it within a passage of its own."""
    rng = np.random.default_rng(n + line)
    common_line, texts = noise(rng, line), []
    for _ in range(documents // 2):
        before = int(rng.integers(3, n - line - 2))
        own = noise(rng, before) + common_line + noise(rng, n - line - before)
        for _ in range(2):
            texts.append(" ".join(noise(rng, int(rng.integers(20, 50))) + own + noise(rng, int(rng.integers(20, 50)))))
    order = rng.permutation(documents).tolist()
    docs = spark.createDataFrame([(order[i], t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    rows = {r["doc_id"]: r for r in passages.classes(docs).collect()}
    pairs = [(rows[order[i]], rows[order[i + 1]]) for i in range(0, documents, 2)]
    assert np.mean([a["class_id"] == b["class_id"] for a, b in pairs]) >= 0.9
    sizes = np.unique([r["class_id"] for r in rows.values()], return_counts=True)[1]
    assert sizes.max() <= 2  # the line alone links nothing
    found = [a for a, b in pairs if a["class_id"] == b["class_id"]]
    assert np.mean([n <= r["n_repeated_words"] <= n + 2 * line for r in found]) >= 0.95


def test_links_and_roots_never_go_through_the_driver(spark):
    """Small compressed files may hold millions of links: none of these tables is broadcast, however small Spark takes it for."""
    edges = spark.range(1, 200).select(F.col("id").alias("u"), (F.col("id") - 1).alias("v"))
    met = links.with_least(edges, edges.groupBy("u").agg(F.min("v").alias("m")))
    passage = " ".join(noise(np.random.default_rng(8), 80))
    found = passages.classes(spark.createDataFrame([(1, passage), (2, f"more {passage}"), (3, "none")], "doc_id long, text string"))
    assert met.count() == 199 and {r["doc_id"]: r["class_id"] for r in found.collect()} == {1: 1, 2: 1, 3: 3}
    for df in (met, found):
        df.collect()
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
