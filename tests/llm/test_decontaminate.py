import hashlib
import re
from collections import defaultdict

import pytest

from pagegraph.llm import decontaminate as d

from .conftest import data, same, sentence, untouched


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x80" else c for c in t or ""))


def plain(rows, items):
    win = defaultdict(set)
    for i, t in items:
        w = words(t)
        for s in range(max(1, len(w) - 9) if w else 0):
            win[tuple(w[s : s + 10])].add(i)
    out = []
    for r in rows:
        w, hit, got = words(r[1]), set(), set()
        for n in {len(x) for x in win}:
            for s in range(len(w) - n + 1):
                if (x := tuple(w[s : s + n])) in win:
                    hit |= set(range(s, s + n))
                    got |= win[x]
        names = sorted(str(i) for i in got if i is not None)
        out.append((r[0], len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return out


@pytest.fixture(scope="module")
def items(spark):
    a, b = sentence(1, 120).split(), sentence(9, 70).split()
    rows = [(1, " ".join(a[40:60])), (2, " ".join(b[20:45]).upper()), (10, "one"), (11, "never there at all in any of these texts here now"), (12, None), (13, ""), (20, " ".join(a[40:60])), (3, "--- ..."), (21, "one two"), (22, " ".join(["echo"] * 14)), (None, sentence(13, 12)), (23, " ".join(sentence(7, 9).split() * 2)), (24, "Ünïcode straße " + sentence(3, 8))]
    return spark.createDataFrame(rows, "item_id long, text string"), rows


def test_report(docs, rows, items):
    df, it = items
    assert same(data(d.report(docs, df)), plain(rows, it))


def test_wide_words_and_repeats(spark, items):
    df, it = items
    rows = [(1, "echo " * 40), (2, "ECHO " * 14 + "x" + " echo" * 13), (3, "one-two,one;TWO"), (4, "x" * 5000), (5, None)]
    assert same(data(d.report(spark.createDataFrame(rows, "doc_id long, text string"), df)), plain(rows, it))


def test_a_term_that_is_frequent_everywhere(spark, monkeypatch):
    """The rarest terms of a window may be the corpus' most frequent ones; by broadcast and by shuffle."""
    it = [(k, " ".join(["the"] * (9 + k) + ["of"] * k)) for k in range(4)] + [(9, "of the")]
    rows = [(i, "the " * (i % 13) + "of " * (i % 4) + "x the of the " * (i % 7)) for i in range(150)]
    df, items = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(it, "item_id long, text string")
    assert same(data(d.report(df, items)), plain(rows, it))
    monkeypatch.setattr(d, "BROADCAST_BYTES", -1)
    assert same(data(d.report(df, items)), plain(rows, it))


def test_joins_by_shuffle_give_the_same(docs, rows, items, monkeypatch):
    monkeypatch.setattr(d, "BROADCAST_ROWS", -1)
    assert same(data(d.report(docs, items[0])), plain(rows, items[1]))


def test_keep_clean(docs, rows, items, clashing):
    out = d.keep_clean(docs, items[0])
    assert out.columns == docs.columns
    clean = [r[0] for r in plain(rows, items[1]) if not r[-1]]
    assert sorted(map(str, (r["doc_id"] for r in out.collect()))) == sorted(map(str, clean))
    assert untouched(d.keep_clean(clashing, items[0]), clashing)


def test_empty_tables(docs, rows, items, empty, spark):
    assert data(d.report(empty, items[0])) == []
    none = items[0].where("false")
    assert same(data(d.report(docs, none)), plain(rows, []))


def test_proximity(spark):
    rows = [(1, "cat x x dog y y y y y y y y y y cat"), (2, "dog " + "z " * 30 + "cat"), (3, "cat dog"), (4, None)]
    q = spark.createDataFrame([(7, "Dog cat"), (8, "bird")], "query_id long, text string")
    got = {(r["doc_id"], r["query_id"]) for r in d.proximity(spark.createDataFrame(rows, "doc_id long, text string"), q, 5).collect()}
    assert got == {(1, 7), (3, 7)}


def test_main_path_is_native(docs, items):
    plan = d.report(docs, items[0])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
