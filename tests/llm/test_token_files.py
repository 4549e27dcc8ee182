"""Operator 13: files of ids, written and read back."""

import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewalk.llm import token_files


def plain_ids(texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for t in texts]


def plain(rows):
    """(doc_id, start, n_tokens, ids_crc32) of rows in order of their ids, as the contract says."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0]))
    out, start = [], 0
    for (i, _), ids in zip(rows, plain_ids([t for _, t in rows]), strict=True):
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def got(df):
    return sorted((tuple(r[c] for c in ("doc_id", "start", "n_tokens", "ids_crc32")) for r in df.collect()), key=lambda r: r[1])


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 32), st.integers(0, 3), st.data())
def test_bits_go_both_ways(width, blocks, data):
    ids = np.array(data.draw(st.lists(st.integers(0, 2**width - 1), min_size=8 * blocks, max_size=8 * blocks + 7)), "<u4")
    raw = token_files.packed(ids, width)
    assert len(raw) == -(-len(ids) * width // 8)
    assert token_files.unpacked(raw, len(ids), width).tolist() == ids.tolist()
    assert sum(int(x) << (i * width) for i, x in enumerate(ids.tolist())) == int.from_bytes(raw, "little")


def test_width_is_the_least():
    assert [token_files.width_of(n) for n in (1, 2, 3, 256, 257, 50257, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]
    with pytest.raises(ValueError, match="fit"):
        token_files.packed(np.array([8], "<u4"), 3)


def test_tables_go_round(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert got(token_files.op13_token_files(spark, SMALL)) == plain(rows)


ODD = [(7, "seven"), (None, "no id"), (3, None), (3, None), (-2, ""), (5, "x" * 200_000), (8, "the end <|endoftext|> é\x00 "), (2**62, "far"), (9, "word " * 30_000)]


def test_odd_rows_and_random_access(spark, tmp_path):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").selectExpr("*", "text AS shard", "doc_id AS row", "text AS path").repartition(3)
    folder = str(tmp_path / "files")
    manifest = token_files.write(docs, folder, block=64).orderBy("shard").collect()
    assert got(token_files.digests(spark, folder)) == plain(ODD)
    assert [m["first"] for m in manifest] == np.cumsum([0] + [m["n_ids"] for m in manifest[:-1]]).tolist()
    want = {r[0]: ids.tolist() for r, ids in zip(ODD, plain_ids([t for _, t in ODD]), strict=True)}
    rng = np.random.default_rng(2)
    for m in manifest:
        shard = token_files.Shard(m["path"])
        assert shard.width == 16 and os.path.getsize(m["path"]) == m["bytes"]
        for i, doc in enumerate(shard.doc_ids.to_pylist()):
            assert shard.document(i).tolist() == want[doc]
        every = shard.ids(0, shard.n_ids)
        for a, b in np.sort(rng.integers(0, shard.n_ids + 1, (20, 2)), axis=1).tolist():
            assert shard.ids(a, b).tolist() == every[a:b].tolist()


def test_files_of_lost_attempts_are_not_read(spark, tmp_path):
    folder = str(tmp_path / "files")
    token_files.write(spark.createDataFrame(ODD, "doc_id long, text string"), folder)
    with open(f"{folder}/shard-000000-lost.bits", "wb") as out:
        out.write(b"half a file")
    assert got(token_files.digests(spark, folder)) == plain(ODD)
    with pytest.raises(ValueError, match="whole file"):
        token_files.Shard(f"{folder}/shard-000000-lost.bits" if os.path.getsize(f"{folder}/shard-000000-lost.bits") > 64 else _longer(tmp_path))


def _longer(folder):
    (folder / "other.bits").write_bytes(b"x" * 200)
    return str(folder / "other.bits")


@pytest.mark.parametrize("kind", ["string", "int"])
def test_ids_of_other_types(spark, tmp_path, kind):
    docs = spark.createDataFrame([(2, "b"), (1, "a"), (None, "c")], "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    token_files.write(docs, str(tmp_path / "files"))
    rows = token_files.digests(spark, str(tmp_path / "files"), kind).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == ([None, "1", "2"] if kind == "string" else [None, 1, 2])


def test_empty_table(spark, tmp_path):
    token_files.write(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "files"))
    assert token_files.digests(spark, str(tmp_path / "files")).count() == 0
