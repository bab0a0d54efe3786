import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pagegraph.llm import katz

from .conftest import data


def toks(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c < "\x80" else c for c in t or "")) + ["\n"]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


class Plain:
    """The model by dictionaries, from its definition."""

    def __init__(self, rows, contexts=katz.CONTEXTS):
        train = [toks(r[1]) for r in rows if not held(r[0])]
        self.c = Counter(w for t in train for w in t)
        self.N, self.V = sum(self.c.values()), len(self.c)
        self.top = {w for w, _ in Counter({w: n for w, n in self.c.items() if w != "\n"}).most_common(contexts - 1)}
        self.big = defaultdict(Counter)
        for t in train:
            for u, v in zip(["<s>", *t], t, strict=False):
                self.big[self.ctx(u)][v] += 1
        n = np.bincount([min(r, 6 + 1) for r in self.c.values()], minlength=8)[:7].astype(float)
        self.d1 = katz.turing(np.r_[0, n[1:7]])
        self.left = 1 - sum(self.d1[min(r, 6)] * r for r in self.c.values()) / (self.N + 1)
        self.types = max(1, math.ceil(n[1] ** 2 / (2 * n[2]) if n[2] else n[1] * (n[1] - 1) / 2))
        m = np.bincount([min(r, 7) for x in self.big.values() for r in x.values()], minlength=8)[:7].astype(float)
        self.d2 = katz.turing(np.r_[0, m[1:7]])

    def ctx(self, u):
        return u if u == "<s>" or u in self.top else "<other>"

    def p1(self, w):
        r = self.c[w]
        return self.d1[min(r, 6)] * r / (self.N + 1) if r else self.left / self.types

    def p(self, u, w):
        x = self.big[self.ctx(u)]
        T = sum(x.values())
        if x[w]:
            return self.d2[min(x[w], 6)] * x[w] / (T + 1)
        left = 1 - sum(self.d2[min(r, 6)] * r for r in x.values()) / (T + 1)
        return left / (1 - sum(self.p1(v) for v, r in x.items() if r)) * self.p1(w)

    def row(self, r):
        t = toks(r[1])
        base = sum(math.log10((self.c[w] + 0.5) / (self.N + 0.5 * (self.V + 1))) for w in t)
        return r[0], held(r[0]), len(t), sum(self.c[w] > 0 for w in t), self.N, base, sum(math.log10(self.p(u, w)) for u, w in zip(["<s>", *t], t, strict=False))


def close(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [x for r in got for x in r[5:]] == pytest.approx([x for r in want for x in r[5:]], rel=1e-11)


def test_scores_match_definition(docs, rows):
    close(data(katz.score(docs)), [Plain(rows).row(r) for r in rows])


def test_few_contexts_blocks_and_parts(docs, rows, monkeypatch):
    monkeypatch.setattr(katz, "CONTEXTS", 12)
    monkeypatch.setattr(katz, "BLOCK_TOKENS", 300)
    monkeypatch.setattr(katz, "PART_TOKENS", 400)
    close(data(katz.score(docs)), [Plain(rows, 10**9).row(r) for r in rows])


@pytest.mark.parametrize(("contexts", "part"), [(1, 2_000_000), (12, 400), (200, 100)])
def test_every_word_is_its_own_context(docs, rows, monkeypatch, contexts, part):
    monkeypatch.setattr(katz, "CONTEXTS", contexts)
    monkeypatch.setattr(katz, "BLOCK_TOKENS", 300)
    monkeypatch.setattr(katz, "PART_TOKENS", part)
    close(data(katz.score(docs)), [Plain(rows, 10**9).row(r) for r in rows])


@pytest.mark.parametrize("hot", [0, 3, 10_000])
def test_hot_pairs_change_nothing(spark, monkeypatch, hot):
    monkeypatch.setattr(katz, "HOT_PAIRS", hot)
    monkeypatch.setattr(katz, "BLOCK_TOKENS", 500)
    rows = [(i, " ".join(f"w{(k * k + i) % 7} x{k % 3}" for k in range(60 + i % 5)) + f" rare{i}") for i in range(60)] + [(60, "the the the the the the the the"), (61, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    close(data(katz.score(df)), [Plain(rows).row(r) for r in rows])


def test_every_context_adds_up_to_one(rows):
    m = Plain(rows)
    seen = list(m.c)
    for u in ["<s>", "\x00none", *seen[:40]]:
        total = sum(m.p(u, w) for w in seen) + m.types * m.p(u, "\x00unseen")
        assert total == pytest.approx(1, abs=1e-9)


def test_pack_round_trip():
    a = [np.arange(5, dtype=np.uint64), np.zeros(0, np.uint16), np.array([1.5])]
    assert all((x == y).all() and x.dtype == y.dtype for x, y in zip(a, katz.unpack(katz.pack(*a)), strict=True))


def test_model_beats_base_on_held_out_text(spark, small):
    r = katz.score(spark.read.parquet(f"{small}/documents.parquet")).where("held_out").groupBy().sum("score", "base_score").first()
    assert r[0] > r[1]


def test_empty_and_clashing(empty, clashing):
    assert data(katz.score(empty)) == []
    assert katz.score(clashing).count() == clashing.count()
