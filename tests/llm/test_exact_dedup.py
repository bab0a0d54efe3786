import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pagegraph.llm import exact_dedup

from .conftest import data, same


def brute(rows, normal=lambda t: t):
    """(doc_id, keep_id, group_size, text_sha256) of each row; ids are told apart in the test of ``kept``."""
    of = defaultdict(list)
    for r in rows:
        of[normal(r[1] or "")].append(r[0])
    top = lambda ids: max((i for i in ids if i is not None), default=None)
    return [(r[0], top(of[t := normal(r[1] or "")]), len(of[t]), hashlib.sha256(t.encode()).hexdigest()) for r in rows]


@pytest.mark.parametrize("how", [{}, {"hot": 0, "shares": 3}, {"digest_bytes": 0}, {"digest_bytes": 0, "hot": 1}])
def test_equals_brute_force(docs, rows, how):
    got = exact_dedup.groups(docs, **how)
    assert same(data(got.drop("kept")), brute(rows))
    kept = got.where("kept")
    assert kept.where("not (doc_id <=> keep_id)").count() == 0
    assert kept.count() == kept.select("text_sha256").distinct().count() == len({r[1] or "" for r in rows})


def test_normalised(docs, rows):
    got = exact_dedup.groups(docs, normalise=lambda c: F.regexp_replace(F.trim(c), "^one.*$", "one"))
    assert same(data(got.drop("kept")), brute(rows, lambda t: "one" if t.strip(" ").startswith("one") and "\n" not in t else t.strip(" ")))


def test_one_row_of_each_text_stays_whole(docs, rows, clashing):
    extra = clashing.withColumns({n: F.lit("mine") for n in ("sha", "sha_", "body", "digest", "tag", "share", "pg_id", "pg_sha", "keep_id", "n", "top", "often")})
    left = exact_dedup.keep_one(extra)
    assert left.columns == extra.columns
    assert left.where("sha <> 'mine' or tag <> 'mine' or pg_id <> 'mine' or kept <> 'x'").count() == 0
    texts = [r["text"] or "" for r in left.select("text").collect()]
    assert sorted(texts) == sorted({r[1] or "" for r in rows})
    assert same(data(exact_dedup.groups(extra).drop("kept")), brute(rows))


def test_a_hot_text_is_dealt_to_shares(spark):
    rows = spark.range(0, 6000, 1, 12).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same words").otherwise(F.concat(F.lit("w"), "id")).alias("text"))
    got = exact_dedup.groups(rows, hot=100, shares=5)
    assert got.where("kept").count() == 4001
    assert data(got.where("group_size > 1").select("keep_id", "group_size").distinct()) == [(5997, 2000)]


def test_empty_table_and_ids_that_are_text(spark, empty):
    assert data(exact_dedup.groups(empty)) == data(exact_dedup.keep_one(empty)) == []
    rows = spark.createDataFrame([("b", "x"), ("a", "x"), (None, "x"), (None, None), (None, "")], "doc_id string, text string")
    got = exact_dedup.groups(rows)
    assert same(data(got.select("doc_id", "keep_id", "group_size")), [("b", "b", 3), ("a", "b", 3), (None, "b", 3), (None, None, 2), (None, None, 2)])
    assert got.where("kept").count() == exact_dedup.keep_one(rows).count() == 2


def test_no_python_in_the_plan(docs):
    plan = exact_dedup.groups(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
