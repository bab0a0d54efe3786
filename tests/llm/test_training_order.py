import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagegraph.llm import training_order as to
from pagegraph.llm.common import row_key
from pagegraph.session import stage_path

from .conftest import data


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutation_and_inverse(n):
    y = to.feistel(np.arange(n), n)
    assert sorted(y.tolist()) == list(range(n))
    assert (to.feistel(y, n, back=True) == np.arange(n)).all()
    assert n < 64 or (to.feistel(np.arange(n), n, key=1) != y).any()


def network(x, half, key):
    """Six rounds, bit by bit as the docstrings say."""
    a, b, mask = x >> half, x % 2**half, 2**64 - 1
    for r in range(6):
        h = b ^ (key * 0x9E3779B97F4A7C15 + r * 0xD6E8FEB86659FD93) & mask
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & mask
        h = (h ^ h >> 27) * 0x94D049BB133111EB & mask
        a, b = b, a ^ (h ^ h >> 31) % 2**half
    return a << half | b


def plain_slot(x, n, key=to.KEY):
    half = 1
    while 4**half < n:
        half += 1
    while True:
        x = network(x, half, key)
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 7, 16, 17, 1000, 70000])
def test_permutation_against_a_plain_one(n):
    some = range(0, n, max(1, n // 50))
    assert to.feistel(np.array(some), n).tolist() == [plain_slot(x, n) for x in some]


def test_scattering_against_a_plain_one():
    r = random.Random(1)
    x = [r.getrandbits(64) for _ in range(200)]
    p = to.scattered(np.array(x, np.uint64))
    assert p.tolist() == [network(v, 32, to.KEY) for v in x]
    assert to.shard_of(p, 7).tolist() == [(v >> 32) * 7 >> 32 for v in p.tolist()]


def shard_paths(at):
    return sorted(Path(at.removeprefix("file:")).glob("shards/part-*"))


def wanted(spark, docs, length, shards):
    """Every record in the order of slots, by the docstring, from rows and their hashes."""
    rows = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("rk"), "doc_id", "text").collect()
    parts = [[] for _ in range(shards)]
    for rk, i, t in rows:
        raw = (t or "").encode()
        for seq, k in enumerate(range(0, len(raw), length)):
            p = network((rk + seq * 0x9E3779B97F4A7C15) % 2**64, 32, to.KEY)
            parts[(p >> 32) * shards >> 32].append((p, raw[k : k + length], (i, seq, len(raw[k : k + length]))))
    out = []
    for part in parts:
        part.sort(key=lambda x: (x[0], x[1]))
        placed = {plain_slot(x, len(part)): (load.ljust(length, b"\0"), facts) for x, (_, load, facts) in enumerate(part)}
        out.append([placed[x] for x in range(len(part))])
    return out


def test_records_lie_at_fixed_offsets_in_shard_files(spark, docs):
    """Each slot is found by a seek alone and holds the sequence that the plain networks put there."""
    at = stage_path(spark, "test-shards")
    shards = to.materialise(docs, at, length=16, per_shard=50).collect()
    want = wanted(spark, docs, 16, 1 + max(r["shard"] for r in shards))
    flat = [x for part in want for x in part]
    assert [r["records"] for r in shards] == [len(x) for x in want if x] and len(shards) > 3
    assert {r["path"].rpartition("/")[2] for r in shards} <= {f.name for f in shard_paths(at)}
    assert sum(f.stat().st_size for f in shard_paths(at)) == len(flat) * shards[0]["stride"]
    for slot, x in enumerate(flat):
        k, record = to.locate(shards, slot)
        with open(shards[k]["path"].removeprefix("file:"), "rb") as f:
            assert to.read_record(f, record, shards[k]) == x


def test_shards_are_of_even_size(spark, docs):
    shards = to.materialise(docs, stage_path(spark, "test-shards"), length=16, per_shard=50).collect()
    assert max(r["records"] for r in shards) < 2 * 50 and sum(r["records"] for r in shards) / len(shards) > 20


def test_resume_from_a_slot(spark, docs):
    at = stage_path(spark, "test-shards")
    shards = to.materialise(docs, at, length=16, per_shard=50).collect()
    n = sum(r["records"] for r in shards)
    whole = {r["slot"]: r for r in to.resume(spark, at).collect()}
    assert sorted(whole) == list(range(n))
    for slot in (0, 1, 123, shards[1]["start"], n - 1, n):
        rest = to.resume(spark, at, slot).collect()
        assert sorted(r["slot"] for r in rest) == list(range(slot, n)) and all(whole[r["slot"]] == r for r in rest)
    assert all(r["record"] == r["slot"] - shards[to.locate(shards, r["slot"])[0]]["start"] for r in whole.values())


def test_equal_bytes_however_the_input_lies(spark, docs):
    """Other files, tasks, orders of rows and shuffle partitions give the same shards."""
    at = [stage_path(spark, "test-shards") for _ in range(3)]
    to.materialise(docs, at[0], length=16, per_shard=50)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    to.materialise(docs.repartition(7), at[1], length=16, per_shard=50)
    spark.conf.set("spark.sql.shuffle.partitions", before)
    to.materialise(docs.orderBy(F.desc("text")).coalesce(1), at[2], length=16, per_shard=50)
    a, b, c = ([f.read_bytes() for f in shard_paths(x)] for x in at)
    assert a == b == c and sum(map(len, a)) > 0


def test_other_encoders_and_edges(spark, docs, clashing, empty):
    words = lambda t: np.arange(len(t.split()), dtype=np.uint16)
    at = stage_path(spark, "test-shards")
    to.materialise(docs, at, 8, encode=words)
    read = to.resume(spark, at).collect()
    assert all(len(r["payload"]) == 16 for r in read) and sum(r["n_tokens"] for r in read) == sum(len((r["text"] or "").split()) for r in docs.collect())
    assert all(np.frombuffer(r["payload"], np.uint16)[: r["n_tokens"]].tolist() == list(range(8 * r["seq"], 8 * r["seq"] + r["n_tokens"])) for r in read)
    assert any(r["doc_id"] is None for r in read)
    assert data(to.order_of(empty)) == []
    assert to.order_of(clashing).count() == to.order_of(docs).count()


def test_copies_of_one_row_go_to_all_shards(spark):
    rows = [(7, "the same row again and again")] * 3000 + [(i, f"row {i} has its own text") for i in range(100, 600)] + [(None, "few copies")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    at = [stage_path(spark, "test-shards") for _ in range(2)]
    shards = to.materialise(docs, at[0], length=16, per_shard=400).collect()
    n = [r["records"] for r in shards]
    assert sum(n) == sum(-(-len(t) // 16) for _, t in rows) and max(n) < 2 * sorted(n)[len(n) // 2]
    to.materialise(docs.coalesce(1), at[1], length=16, per_shard=400)
    a, b = ([f.read_bytes() for f in shard_paths(x)] for x in at)
    assert a == b
    got = to.resume(spark, at[0]).groupBy("doc_id", "seq").count().where("doc_id = 7").collect()
    assert sorted((r["seq"], r["count"]) for r in got) == [(0, 3000), (1, 3000)]


def test_ids_that_are_no_integers_are_an_error_at_once(spark):
    docs = spark.createDataFrame([("a", "text")], "doc_id string, text string")
    with pytest.raises(TypeError, match="has to be an integer"):
        to.materialise(docs, stage_path(spark, "test-shards"))


def test_registered_query_holds_vocabulary_ids(spark, small):
    import hashlib

    from pagegraph.llm import queries
    from pagegraph.llm.token_counts import encoder

    enc, _ = encoder(open(queries.BYTE_RANKS, "rb").read(), queries.public_tokenizers.PATTERN)
    want = []
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        ids = np.array(enc.encode_ordinary(r["text"] or ""), np.uint16)
        for k in range(0, len(ids), to.LENGTH):
            part = ids[k : k + to.LENGTH]
            want.append((r["doc_id"], k // to.LENGTH, len(part), hashlib.sha256(part.tobytes().ljust(2 * to.LENGTH, b"\0")).hexdigest()))
    got = queries.op8_training_order(spark, small).select("doc_id", "seq", "n_tokens", "payload_sha256")
    assert sorted(data(got)) == sorted(want)
