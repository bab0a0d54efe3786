import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pagegraph.llm import merkle, queries

from .conftest import data, same


def sha(s):
    return hashlib.sha256(s.encode("utf-8")).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def up(row):
    return row if len(row) < 2 else [sha("".join(row[i : i + 3])) for i in range(0, len(row), 3)]


def levels(row):
    out = [row]
    while len(out[-1]) > 1:
        out.append(up(out[-1]))
    return out


def brute(rows, forge):
    """rows(doc_id, source, lang, n_chars, text): the whole trees, built level by level."""
    of = defaultdict(list)
    for r in rows:
        of[r[1]].append(r)
    groups = sorted(of, key=lambda s: (s is not None, (s or "").encode()))
    for g in groups:
        of[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, bytes.fromhex(leaf(r))))
    trees = {g: levels([leaf(r) for r in of[g]]) for g in groups}
    top = levels([trees[g][-1][0] for g in groups])
    out = []
    for k, g in enumerate(groups):
        for i, r in enumerate(of[g]):
            now, proof, path = leaf(forge(r)), "", []
            for tree, at in ((trees[g], i), (top, k)):
                for row in tree[:-1]:
                    run = range(at // 3 * 3, min(at // 3 * 3 + 3, len(row)))
                    path.append(("".join(row[j] for j in run if j < at), "".join(row[j] for j in run if j > at)))
                    at //= 3
            for a, z in path:
                now, proof = sha(a + now + z), proof + a + z
            out.append((r[0], g, leaf(r), trees[g][-1][0], top[-1][0], sha(proof), now, now == top[-1][0]))
    return out


def forged(r):
    return (*r[:4], r[4].replace("\n", "")) if r[4] and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("sizes", [[1], [2], [3], [4, 1], [9, 1, 1, 10], [1] * 40, [200, 3, 1, 1, 1, 77, 28], [0, 5]])
def test_equals_whole_trees(spark, sizes, monkeypatch):
    monkeypatch.setattr(merkle, "LEAVES", 7)
    monkeypatch.setattr(merkle, "FAN", 3)
    rnd = random.Random(len(sizes))
    rows = [(i * 7 + g, None if g == 1 else f"sé{g}", None, i, f"a\n{i}") for g, n in enumerate(sizes) for i in range(n)]
    rnd.shuffle(rows)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = merkle.attest(docs, queries.without_line_ends())
    assert same(data(got), brute(rows, forged))


def test_fixture_with_nulls_repeats_and_more_columns(spark, docs, rows, clashing):
    plain = [(r[0], r[3], r[2], r[4], r[1]) for r in rows]
    extra = clashing.withColumns({n: F.lit("x") for n in ("part", "tree", "idx", "n", "leaf", "claimed", "tag", "level", "digest", "c", "before", "rank", "nth")})
    for table in (docs, extra):
        got = data(merkle.attest(table, queries.without_line_ends()))
        assert same(got, brute(plain, forged))
        assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_one_group_of_all_rows_that_repeat(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEAVES", 50)
    rows = [(5, "s", "en", 1, "x")] * 400
    got = merkle.attest(spark.createDataFrame(rows, SCHEMA))
    assert same(data(got), brute(rows, lambda r: r))
    assert data(got.select("verified").distinct()) == [(True,)]


def test_merging_is_associative_and_commutative():
    rnd = random.Random(3)
    for trial in range(200):
        sizes = [rnd.randint(1, 40) for _ in range(rnd.randint(1, 6))]
        n = dict(enumerate(sizes)) | {merkle.TOP: len(sizes)}
        leaves = {(t, 0, i): bytes([t, i]) * 16 for t, k in enumerate(sizes) for i in range(k)}
        parts = [{} for _ in range(5)]
        for k, v in leaves.items():
            rnd.choice(parts)[k] = v
        whole = merkle.settled(leaves, n, {})
        assert len(whole) == 1
        parts = [merkle.settled(p, n, {}) for p in parts]
        rnd.shuffle(parts)
        while len(parts) > 1:
            a, b = parts.pop(rnd.randrange(len(parts))), parts.pop(rnd.randrange(len(parts)))
            parts.append(merkle.settled(a | b, n, {}))
        assert parts[0] == whole


def test_edges_are_few(spark):
    for n in (1, 2, 3, 100, 10**11):
        for lo, hi in ((0, n - 1), (n // 3, n // 2), (n - 1, n - 1)):
            assert len(list(merkle.edges(lo, hi, n))) <= 4 * merkle.height(n)
    assert not list(merkle.edges(0, 99, 100))


def test_manifest_names_the_groups_that_changed(spark, docs):
    a = merkle.manifest(docs)
    b = merkle.manifest(docs.withColumn("text", F.when(F.col("doc_id") == 9, "other").otherwise(F.col("text"))))
    old, new = ({r["source"]: (r["n"], r["subroot"]) for r in t.collect()} for t in (a, b))
    assert old.keys() == new.keys() == {"s", "t"} and old["s"] != new["s"] and old["t"] == new["t"]
    assert a.first()["root"] != b.first()["root"]


def test_empty_table(empty):
    got = merkle.attest(empty)
    assert data(got) == [] and got.columns == ["doc_id", "source", *merkle.PROVEN]
