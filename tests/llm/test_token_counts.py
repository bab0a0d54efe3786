import numpy as np
import public_tokenizers
import pytest

from pagegraph.llm import token_counts as tc

from .conftest import data

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def plain(start, end, s, e):
    at = []
    for a, b in zip(start, end, strict=True):
        share = [max(0, min(b, y) - max(a, x)) for x, y in zip(s, e, strict=True)]
        at.append(int(np.argmax(share)) if share and max(share) else -1)
    return at


def test_long_runs_of_white_space():
    """As the library does where it can, and without a crash where it can't."""
    enc, _ = tc.encoder(open(RANKS, "rb").read(), PATTERN)
    for run in (" " * 2500, "\t" * 2500, " " * 1999 + "\n" + " " * 700, "\u3000 " * 1300, "\n" * 2500):
        for t in (run, run + "word", "a" + run, "a" + run + "b" + run + "\x1c c", "x " + run[:1999] + "y"):
            assert tc.ids_of(enc, t) == enc.encode_ordinary(t)
    for t in ("a" + " " * 1_000_000 + "b", "\n" * 1_000_000, "ab" * 500_000):
        assert enc.decode(tc.ids_of(enc, t)) == t


@pytest.mark.parametrize("seed", range(30))
def test_allocation_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    end = np.cumsum(rng.integers(1, 7, 40))
    start = np.r_[0, end[:-1]]
    cuts = np.unique(rng.integers(0, end[-1], 12))
    s, e = cuts[:-1], np.maximum(cuts[:-1], cuts[1:] - rng.integers(0, 2, len(cuts) - 1))
    at, crossing = tc.allocate(start, end, s, e)
    assert at.tolist() == plain(start, end, s, e)
    assert all(crossing == [k >= 0 and not (s[k] <= a and b <= e[k]) for a, b, k in zip(start, end, at, strict=True)])


def test_lines(docs, rows, clashing, empty):
    out = tc.by_line(docs, RANKS, PATTERN).collect()
    enc, size = tc.encoder(open(RANKS, "rb").read(), PATTERN)
    want = []
    for i, t, *_ in rows:
        ids = enc.encode_ordinary(t or "")
        raw, at, sections = (t or "").encode(), 0, []
        for line in (t or "").splitlines(keepends=True) if t and not set("\x0b\x0c\x1c\x1d\x1e\x85  \r") & set(t) else [x for x in (t or "").replace("\n", "\n\0\0").split("\0\0") if x]:
            sections.append((at, at + len(line.encode())))
            at += len(line.encode())
        assert at == len(raw)
        end = np.cumsum(size[ids]) if ids else np.zeros(0, int)
        got = plain(np.r_[0, end[:-1]] if ids else [], end, [x for x, _ in sections], [y for _, y in sections])
        for k, (a, b) in enumerate(sections):
            want.append((i, k, len(raw[:a].decode()), len(raw[:b].decode()), got.count(k), len(ids)))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r["doc_id"], r["section"], r["start"], r["end"], r["n_tokens"], r["doc_tokens"]) for r in out), key=key) == sorted(want, key=key)
    assert tc.by_line(clashing, RANKS, PATTERN).count() == len(out)
    assert data(tc.by_line(empty, RANKS, PATTERN)) == []


def test_spans_of_a_table(spark):
    docs = spark.createDataFrame([(1, "Üben macht den Meister, sagt man."), (2, None), (3, "no sections")], "doc_id long, text string")
    sec = spark.createDataFrame([(1, "a", 0, 4), (1, "b", 4, 22), (1, "c", 24, 400), (9, "z", 0, 5)], "doc_id long, section string, start long, end long")
    out = tc.by_span(docs, sec, RANKS, PATTERN).collect()
    enc, _ = tc.encoder(open(RANKS, "rb").read(), PATTERN)
    for i, t in ((1, "Üben macht den Meister, sagt man."), (3, "no sections")):
        assert sum(r["n_tokens"] for r in out if r["doc_id"] == i) == len(enc.encode_ordinary(t))
    assert {r["section"] for r in out if r["doc_id"] == 1} == {"a", "b", "c", None}
    assert [r["n_tokens"] for r in out if r["doc_id"] == 2] == [0]
