import math
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from pagegraph.llm import quality_rules as q

from .conftest import data, same


def plain(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    at = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    hit = {k for i, x in enumerate(at) if at.count(x) > 1 for k in range(i, i + 5)}
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for x in lines:
        dup += x in seen and bool(re.search(r"[^\x20\x09-\x0D]", x))
        seen.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


@pytest.mark.parametrize("t", [None, "", " \n", "a b c d e", "a b c d e f g a b c d e x", "x\nx\n\n\ny\nx", "## $5 |é <ü>\n## $5 |é <ü>", "a " * 30, "p q r\x1cs\x85 t"])
def test_base_figures(t):
    assert q.base_figures(t) == plain(t)


def labels(spark, n=400):
    return spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(n)] + [(None, 1, 0), (3, None, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def corpus(spark):
    good = lambda i: " ".join(f"word{(i * 7 + k * k) % 90}" for k in range(60))
    bad = lambda i: " ".join(f"JUNK{(i + k * k) % 70}!!" for k in range(60))
    rows = [(i, good(i) if i % 4 else bad(i)) for i in range(800)] + [(None, good(1)), (9000, None), (9001, ""), (1, good(1)), (9002, "few words")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache(), rows


def test_verdicts_match_definition(spark, corpus):
    docs, rows = corpus
    m = q.fit(docs, labels(spark))
    out = data(q.judge(docs, m))
    raw = np.zeros(q.BUCKETS)
    for _, t in rows:
        raw += np.bincount(q.ngram_buckets(q.word_hashes((t or "").encode())), minlength=q.BUCKETS)
    ids = {r["t_id"] for r in q._samples(labels(spark))[0].collect()}
    good = np.zeros(q.BUCKETS)
    for i, t in rows:
        if i in ids:
            good += np.bincount(q.ngram_buckets(q.word_hashes((t or "").encode())), minlength=q.BUCKETS)
    ratio = (np.log((good + 1) / (good.sum() + q.BUCKETS)) - np.log((raw + 1) / (raw.sum() + q.BUCKETS))).astype(np.float32)
    assert np.allclose(m["ratio"], ratio)

    def want(i, t):
        five = plain(t)
        failed = five[0] < 10 or 100 * five[4] > 20 * five[0]
        s = q.score(q.word_hashes((t or "").encode()), ratio)
        return i, *five, failed, round(s, 9), not failed and s >= m["threshold"]

    assert same([(*r[:7], round(r[7], 9), r[8]) for r in out], [want(*r) for r in rows])
    kept = {r[0]: r[8] for r in out}
    assert all(kept[i] == (i % 4 != 0) for i in range(800))


M64, MULTIPLIER, SECOND = 2**64 - 1, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def plain_buckets(text):
    """Buckets of unigrams and bigrams, word by word."""
    h = [xxhash.xxh64_intdigest(w.encode()) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return [(x * SECOND & M64) >> 48 for x in h] + [((x * MULTIPLIER & M64 ^ y) * SECOND & M64) >> 48 for x, y in zip(h, h[1:], strict=False)]


def spark_hash(spark, ids):
    return {r[0]: r[1] for r in spark.createDataFrame([(i,) for i in ids], "doc_id long").selectExpr("doc_id", "xxhash64(doc_id, 'trusted')").collect()}


def plain_fit(spark, rows, labelled):
    """(ratio by bucket, threshold) from rows and labels, by the module's docstring alone."""
    quality = {}
    for i, k, _ in labelled:
        if i is not None and k is not None:
            quality[i] = min(quality.get(i, k), k)
    h = spark_hash(spark, quality)
    trusted = {i for i in quality if quality[i] == 1 and h[i] % 2 == 0}
    judges = {i: quality[i] for i in quality if h[i] % 2 == 1}
    raw, good = Counter(), Counter()
    for i, t in rows:
        raw.update(plain_buckets(t))
        if i in trusted:
            good.update(plain_buckets(t))
    a, b = sum(good.values()) + 65536, sum(raw.values()) + 65536
    ratio = lambda k: math.log((good[k] + 1) / a) - math.log((raw[k] + 1) / b)
    scored = []
    for i, t in rows:
        five = plain(t)
        if i in judges and five[0] >= 10 and 100 * five[4] <= 20 * five[0]:
            k = plain_buckets(t)
            scored.append((sum(map(ratio, k)) / len(k), judges[i]))
    n_good, n_bad = sum(k for _, k in scored), sum(1 - k for _, k in scored)
    best, at = -1, None
    for cut in range(q.BINS):  # the lowest of the best
        t = q.LOW + cut * (q.HIGH - q.LOW) / q.BINS
        lost = sum(k for s, k in scored if s < t) / n_good
        gain = sum(1 - k for s, k in scored if s < t) / max(1, n_bad) - lost
        if lost <= q.MAX_LOSS and gain > best + 1e-12:
            best, at = gain, t
    return ratio, at


def test_threshold_and_scores_against_brute_force(spark, corpus):
    docs, rows = corpus
    lab = labels(spark)
    m = q.fit(docs, lab)
    ratio, threshold = plain_fit(spark, rows, [tuple(r) for r in lab.collect()])
    assert m["threshold"] == pytest.approx(threshold, abs=1e-9)
    for i, t in rows[::37]:
        k = plain_buckets(t)
        assert q.score(q.word_hashes((t or "").encode()), m["ratio"]) == pytest.approx(sum(map(ratio, k)) / len(k) if k else 0, abs=1e-5)
    verdicts = {(r["doc_id"], r["n_words"]): r["kept"] for r in q.judge(docs, m).collect()}
    for i, t in rows:
        five, k = plain(t), plain_buckets(t)
        s = sum(map(ratio, k)) / len(k) if k else 0
        if abs(s - threshold) > 1e-4:
            assert verdicts[i, five[0]] == (five[0] >= 10 and 100 * five[4] <= 20 * five[0] and s >= threshold)


def test_stage_keeps_what_the_query_keeps(spark, corpus):
    docs, _ = corpus
    lab = labels(spark)
    kept = sorted(str(r["doc_id"]) for r in q.judge(docs, q.fit(docs, lab)).collect() if r["kept"])
    assert sorted(str(r["doc_id"]) for r in q.keep_good(docs, lab).collect()) == kept


def test_no_labels_reject_nothing_by_score(spark, corpus):
    docs, _ = corpus
    m = q.fit(docs, labels(spark).where("false"))
    assert all(r["kept"] == (not r["base_failed"]) for r in q.judge(docs, m).collect())


def test_stage_keeps_columns(spark, docs, clashing, empty):
    out = q.keep_good(docs, labels(spark))
    assert out.columns == docs.columns and out.schema == docs.schema
    assert q.keep_good(clashing, labels(spark)).columns == clashing.columns
    assert data(q.keep_good(empty, labels(spark))) == []
    assert data(q.judge(empty, q.fit(empty, labels(spark)))) == []


def test_cut_prefers_the_lowest_of_equal_cuts():
    n = np.zeros((2, q.BINS), int)
    n[0, 100], n[1, 300] = 50, 1000
    assert q._cut(n) == pytest.approx(q.LOW + 101 * (q.HIGH - q.LOW) / q.BINS)


def test_whole_labelled_table(spark, small):
    docs, lab = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    out = q.judge(docs, q.fit(docs, lab)).join(lab, "doc_id").where("not base_failed")
    good = out.where("quality = 1")
    assert good.where("kept").count() >= 0.97 * good.count()


def test_every_labelled_row_counts(spark):
    """Beyond 20,000 good rows on the trusted side and 10,000 of either kind on the judges'."""
    lab = spark.range(90_000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    h = spark_hash(spark, range(90_000))
    trusted, judges = q._samples(lab)
    assert {r["t_id"] for r in trusted.collect()} == {i for i in h if i % 2 and h[i] % 2 == 0}
    assert {(r["t_id"], r["quality"]) for r in judges.collect()} == {(i, i % 2) for i in h if h[i] % 2}
