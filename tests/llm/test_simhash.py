import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from .conftest import data, same, untouched

from pagegraph.llm import simhash


def plain_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_classes(rows):
    """Brute force over all pairs."""
    fp = [plain_print(r[1]) for r in rows]
    top = list(range(len(rows)))
    for _ in rows:
        for i, j in combinations(range(len(rows)), 2):
            if (fp[i] ^ fp[j]).bit_count() <= 3:
                top[i] = top[j] = min(top[i], top[j])
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if top[j] == top[i] and rows[j][0] is not None]
        out.append((r[0], f"{fp[i]:016x}", min(ids, default=None)))
    return out


def test_golay_code_is_perfect():
    n = np.bincount(simhash.golay_index(np.arange(1 << 23)))
    assert len(n) == 4096 and (n == 2048).all()


def test_keys_meet_within_three_bits():
    rng = random.Random(5)
    x = np.array([rng.getrandbits(64) for _ in range(3000)], np.uint64)
    y = np.array([int(v) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for v in x], np.uint64)
    a, b = (set(zip(*(z.tolist() for z in simhash.fuzzy_keys(v)), strict=True)) for v in (x, y))
    assert {r for r, _ in a & b} == set(range(3000))


def test_links_of_large_group_match_brute_force():
    rng = np.random.default_rng(1)
    x = np.unique(np.uint64(12345) ^ (np.uint64(1) << rng.integers(0, 20, (600, 4)).astype(np.uint64)).sum(1).astype(np.uint64))
    want = simhash.links_within(x)
    assert (simhash.links_within(x, block=64, strip=16) == want).all()
    y = np.unique(rng.integers(0, 2**63, 300, np.uint64))
    assert (simhash.links_within(y) == np.arange(len(y))).all()


def test_fingerprints_and_classes(docs, rows):
    assert same(data(simhash.near_duplicates(docs)), plain_classes(rows))


def plain_components(fps):
    top = {x: x for x in fps}
    for _ in fps:
        before = dict(top)
        for x, y in combinations(fps, 2):
            if (x ^ y).bit_count() <= 3:
                top[x] = top[y] = min(top[x], top[y])
        if top == before:
            break
    return top


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def by_class(spark, fps):
    """Sets of fingerprints that classes() puts together."""
    df = spark.createDataFrame([(i, signed(x)) for i, x in enumerate(fps)], "doc_id long, fp long").repartition(3)
    out = {}
    for r in simhash.classes(df).collect():
        out.setdefault(r["component_id"], set()).add(r["fp"] % 2**64)
    assert all(fps[least] in group and min(map(fps.index, group)) == least for least, group in out.items())
    return sorted(map(sorted, out.values()))


def grouped_by(top):
    out = {}
    for x, t in top.items():
        out.setdefault(t, []).append(x)
    return sorted(map(sorted, out.values()))


def test_chains_of_three_bit_links(spark):
    """Chains of many hops, each of exactly 3 bits, and strangers 4 bits away."""
    rng = random.Random(9)
    fps = []
    for _ in range(4):
        x = rng.getrandbits(64)
        for _ in range(30):
            fps.append(x)
            x ^= sum(1 << b for b in rng.sample(range(64), 3))
        fps.append(fps[-1] ^ sum(1 << b for b in rng.sample(range(64), 4)))
    fps = list(dict.fromkeys(fps))
    want = grouped_by(plain_components(fps))
    assert by_class(spark, fps) == want and max(map(len, want)) >= 30


@pytest.mark.parametrize("block", [32, 8])
def test_groups_beyond_a_block_through_the_operator(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "STRIP", 8)
    rng = random.Random(3)
    base = rng.getrandbits(64)
    fps = list({base ^ sum(1 << b for b in rng.sample(range(21), rng.randint(0, 9))) for _ in range(260)})
    rounds, found = [], simhash._found
    monkeypatch.setattr(simhash, "_found", lambda *a: rounds.append(a) or found(*a))
    assert by_class(spark, fps) == grouped_by(plain_components(fps)) and len(rounds) >= (3 if block == 8 else 2)


def test_parts_of_the_varying_bits_keep_every_link():
    import pyarrow as pa

    rng = random.Random(8)
    for _ in range(40):
        vary = sum(1 << b for b in rng.sample(range(64), rng.randint(5, 40)))
        bits = [b for b in range(64) if vary >> b & 1]
        base = rng.getrandbits(64)
        x = base ^ sum(1 << b for b in rng.sample(bits, 3))
        y = x ^ sum(1 << b for b in rng.sample(bits, rng.randint(1, 3)))
        batch = pa.RecordBatch.from_arrays([pa.array([5, 5], pa.int64()), pa.array([signed(x), signed(y)], pa.int64()), pa.array([signed(vary)] * 2, pa.int64())], ["k", "fp", "vary"])
        keys = [tuple(b.column(0).to_pylist()) for b in simhash._emit_parts(iter([batch]))]
        assert len(keys) == 4 and any(a == b for a, b in keys)


def test_links_within_against_brute_force():
    rng = random.Random(6)
    for block, strip, n in ((4096, 256, 300), (64, 16, 300), (32, 8, 90), (4, 2, 700)):
        fps = sorted({sum(1 << b for b in rng.sample(range(12), rng.randint(0, 6))) | rng.getrandbits(2) << 40 for _ in range(n)})
        top = plain_components(fps)
        assert [fps[i] for i in simhash.links_within(np.array(fps, np.uint64), 3, block, strip)] == [top[x] for x in fps]


def test_keep_one(docs, rows, clashing):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    want = {c for _, _, c in plain_classes(rows)}
    assert sorted(i for i in ids if i is not None) == sorted([*(i for i in want if i is not None), 14])
    assert untouched(simhash.keep_one(clashing), clashing)


def test_empty(empty):
    assert data(simhash.near_duplicates(empty)) == []
    assert data(simhash.keep_one(empty)) == []
