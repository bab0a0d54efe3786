import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from pagegraph.llm import paragraph_dedup as p

from .conftest import data, same, sentence, untouched


def shingles(line):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c < "\x80" else c for c in line))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def low(x):
    return "".join(c.lower() if c < "\x80" else c for c in x)


def plain_paragraphs(text):
    """(first word, words, equality key) by the rule of the docstring, a plain restatement."""
    h = lambda x: xxhash.xxh64_intdigest(low(x).encode())
    lines, at = [], 0
    for line in (text or "").split("\n"):
        lines.append((at, words_of(line), line))
        at += len(lines[-1][1])
    out, block = [], []
    for first, w, line in [*lines, (at, ["end"] * p.MIN_WORDS, None)]:
        if len(w) < p.MIN_WORDS:
            if w:
                block = block or [first]
                block += w
                if len(block) - 1 >= 51 and (len(block) - 1 >= 100 or h(" ".join(w)) % 2 == 0):
                    out.append((block[0], len(block) - 1, " ".join(block[1:])))
                    block = []
            continue
        if len(block) - 1 >= 51:
            out.append((block[0], len(block) - 1, " ".join(block[1:])))
        block = []
        if line is None:
            break
        if len(w) <= 100:
            out.append((first, len(w), line))
            continue
        s = 0
        while len(w) - s >= 102:
            ends = [e for e in range(s + 51, min(s + 100, len(w) - 51)) if h(w[e - 1]) % 16 == 0]
            e = ends[0] if ends else min(s + 100, len(w) - 51)
            out.append((first + s, e - s, " ".join(w[s:e])))
            s = e
        out.append((first + s, len(w) - s, " ".join(w[s:])))
    return out


def plain_without(text, gone):
    """The text without some words; of the white space around a cut the side with more line ends stays."""
    parts = re.split(r"([^\x20\x09-\x0D]+)", text)  # white, word, white, ...
    out, n, k = parts[0], len(parts) // 2, 0
    if 0 in gone:
        out = ""
    while k < n:
        if k not in gone:
            out += parts[2 * k + 1]
            nxt = k + 1
            while nxt in gone:
                nxt += 1
            if nxt == k + 1:
                out += parts[2 * k + 2]
            elif nxt < n:
                out += max(parts[2 * k + 2], parts[2 * nxt], key=lambda x: x.count("\n"))
            k = nxt
        else:
            k += 1
    return out


def plain(rows):
    """Cut every paragraph of a class but its first, classes by exact Jaccard over all pairs; then every window that
    occurs earlier."""
    occ, uniq = [], {}
    for i, r in enumerate(rows):
        for n, size, line in plain_paragraphs(r[1]):
            occ.append((i, n, size, line))
            uniq.setdefault(line, len(uniq))
    sets = [shingles(x) for x in uniq]
    top = list(range(len(sets)))
    links = [(i, j) for i, j in combinations(range(len(sets)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for _ in top:
        for i, j in links:
            top[i] = top[j] = min(top[i], top[j])
    first = {}
    place = lambda i, n: (rows[i][0] is None, rows[i][0] or 0, n)
    for i, n, _, line in occ:
        k = top[uniq[line]]
        first[k] = min(first.get(k, place(i, n)), place(i, n))
    gone = {}
    for i, n, size, line in occ:
        if place(i, n) != first[top[uniq[line]]]:
            gone.setdefault(i, set()).update(range(n, n + size))
    texts = [r[1] if r[1] is None or i not in gone else plain_without(r[1], gone[i]) for i, r in enumerate(rows)]
    seen, out = {}, list(texts)
    for i in sorted(range(len(rows)), key=lambda i: (place(i, 0), texts[i] or "")):
        w, cut = [low(x) for x in words_of(texts[i])], set()
        for k in range(len(w) - 50):
            j, at = seen.setdefault(tuple(w[k : k + 51]), (rows[i][:2], k))
            if j != rows[i][:2] or k >= at + 51:
                cut |= set(range(k, k + 51))
        if cut:
            out[i] = plain_without(texts[i], cut)
    return [(r[0], t) for r, t in zip(rows, out, strict=True)]


def test_rows_against_brute_force(docs, rows):
    got = [(r["doc_id"], r["text"]) for r in p.removals(docs).collect()]
    # doc 14 has two texts and 0 is given twice: rows that share id and text are one
    assert same(got, plain(rows))


def test_near_copies_of_a_passage(spark):
    r = random.Random(2)
    base = sentence(21, 100).split()
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(r.randint(0, 2)):
            w[r.randrange(100)] = f"new{r.randrange(50)}"
        rows.append((i, sentence(100 + i, 30) + "\n" + " ".join(w) + "\nend " + str(i)))
    got = data(p.removals(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "text"))
    assert same(got, plain(rows))


def test_blocks_compare_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(p, "BLOCK", 7)
    base = sentence(31, 80).split()
    rows = []
    for i in range(50):
        w = list(base)
        w[i] = "other"
        rows.append((i, " ".join(w)))
    got = data(p.removals(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).select("doc_id", "text"))
    assert same(got, plain(rows))


def test_band_recall():
    rng = np.random.default_rng(3)
    pairs, met = 400, 0
    for _ in range(pairs):
        common = rng.integers(0, 2**63, 80, np.uint64)
        a, b = (np.unique(np.r_[common, rng.integers(0, 2**63, 10, np.uint64)]) for _ in range(2))  # Jaccard 0.8
        k = p.band_keys([a, b])
        met += bool((k[0] == k[1]).any())
    assert met >= 0.985 * pairs
    assert 1 - (1 - 0.8**p.ROWS) ** p.BANDS > 0.999


@pytest.mark.parametrize("n", [2, 9])
def test_jaccard_links(n):
    rng = np.random.default_rng(n)
    sets = [np.unique(rng.integers(0, 12, 10, np.uint64)) for _ in range(n)]
    top = list(range(n))
    for _ in top:
        for i, j in combinations(range(n), 2):
            a, b = set(sets[i].tolist()), set(sets[j].tolist())
            if len(a & b) >= 0.8 * len(a | b):
                top[i] = top[j] = min(top[i], top[j])
    assert p.jaccard_links(sets).tolist() == top


def test_columns_and_lengths(docs, clashing, empty):
    out = p.cut_repeats(docs)
    assert out.schema == docs.schema and out.count() == docs.count()
    assert untouched(p.cut_repeats(clashing), clashing)
    assert p.cut_repeats(clashing).count() == clashing.count()
    assert data(p.cut_repeats(empty)) == [] and data(p.removals(empty)) == []
    changed = {r["doc_id"]: r for r in out.collect() if r["doc_id"] in (1, 11)}
    assert all(r["n_chars"] == len(r["text"]) for r in changed.values())


def wrapped(words, n):
    return "\n".join(" ".join(words[i : i + n]) for i in range(0, len(words), n))


def test_passages_of_short_lines_and_within_lines(spark):
    passage = [f"p{i}" for i in range(60)]
    own = lambda k, n: [f"d{k}w{i}" for i in range(n)]
    rows = [
        (1, wrapped(own(1, 30) + passage, 9)),
        (2, wrapped(own(2, 30) + passage + own(3, 30), 7)),  # short lines, other line ends
        (3, " ".join(own(4, 200) + passage + own(5, 200))),  # within a long line
        (4, " ".join(own(6, 40) + passage[:50] + own(7, 40))),  # 50 words stay
        (5, " ".join(own(8, 40) + [w.upper() for w in passage[3:54]])),  # 51 go
        (6, " ".join(["again"] * 70)),  # overlaps its first one up to word 51
    ]
    got = {r["doc_id"]: (r["text"] or "").split() for r in p.removals(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got[1] == rows[0][1].split() and got[4] == rows[3][1].split()
    assert got[2] == own(2, 30) + own(3, 30)
    assert got[3] == own(4, 200) + own(5, 200)
    assert got[5] == own(8, 40)
    assert 51 <= len(got[6]) <= 70


def test_windows_against_brute_force(spark):
    r = random.Random(5)
    pieces = [[f"q{k}x{i}" for i in range(r.choice([30, 55, 80]))] for k in range(6)]
    rows = []
    for i in range(30):
        words = []
        for _ in range(4):
            words += [f"o{i}n{r.randrange(10**6)}" for _ in range(r.randrange(25))] + r.choice(pieces)
        rows.append((i, "\n".join(" ".join(words[k : k + 11]) for k in range(0, len(words), 11))))
    got = data(p.removals(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).select("doc_id", "text"))
    assert same(got, plain(rows))


def test_paragraphs_against_the_rule():
    r = random.Random(8)
    for _ in range(200):
        lines = [" ".join(f"w{r.randrange(500)}" for _ in range(r.choice([0, 3, 9, 19, 20, 60, 100, 101, 102, 240, 700]))) for _ in range(r.randrange(14))]
        text = "\n".join(lines)
        assert [(n, size, t.decode()) for n, size, t in p.paragraphs(text)] == plain_paragraphs(text)


def test_planted_passages_are_found_and_clean_documents_left(spark):
    """Passages of 51 to 200 words in the middle of lines, at their ends and over short lines."""
    r = random.Random(11)
    own = lambda n: [f"u{r.randrange(10**9)}" for _ in range(n)]
    wrap = lambda w, n: "\n".join(" ".join(w[i : i + n]) for i in range(0, len(w), n))
    rows, planted = [], {}
    for k in range(40):
        passage = own(r.randint(51, 200))
        for j in range(2):
            before, after, i = own(r.randrange(200)), own(r.randrange(200)), 2 * k + j
            forms = [" ".join(before + passage + after), wrap(before + passage + after, r.randint(5, 15)), " ".join(before + passage) + "\n" + " ".join(after), wrap(before, 30) + "\n" + " ".join(passage + after)]
            rows.append((i, r.choice(forms)))
            planted[i] = passage
    rows += [(100 + i, r.choice([" ".join(own(300)), wrap(own(300), 9)])) for i in range(40)]
    out = {x["doc_id"]: x for x in p.removals(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    texts = dict(rows)
    assert all(out[i]["has_passage"] and out[i]["n_repeated_words"] >= 51 for i in planted)
    assert all(not out[i]["has_passage"] and out[i]["n_cut"] == out[i]["n_repeated_words"] == 0 and out[i]["text"] == texts[i] for i in range(100, 140))
    left = [i for i in planted if i % 2 and any(" ".join(planted[i][k : k + 51]) in " ".join(out[i]["text"].split()) for k in range(len(planted[i]) - 50))]
    assert not left and all(out[i]["text"] == texts[i] for i in planted if i % 2 == 0)
    # no two documents share a run of 51 words any more
    seen = {}
    for i, x in out.items():
        w = x["text"].split()
        for k in range(len(w) - 50):
            assert seen.setdefault(tuple(w[k : k + 51]), i) == i


def test_large_bucket_with_members_far_from_the_pivot(spark, monkeypatch):
    """Chains within one bucket: some links are not with the pivot."""
    monkeypatch.setattr(p, "BLOCK", 4)
    monkeypatch.setattr(p, "_bands", lambda batches: _one_bucket(batches))
    calls, large = [], p._large_links
    monkeypatch.setattr(p, "_large_links", lambda *a: calls.append(a) or large(*a))
    r, rows = random.Random(4), []
    for g in range(3):
        base = sentence(40 + g, 90).split()
        for i in range(14):
            w = list(base)
            for k in range(i):  # the further, the less like the first; like the one before
                w[5 * k : 5 * k + 1] = [f"x{g}n{k}"]
            rows.append((100 * g + i, " ".join(w)))
    r.shuffle(rows)
    got = data(p.removals(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).select("doc_id", "text"))
    assert same(got, plain(rows))
    assert 0 < sum(bool(t) for _, t in got) < len(rows)
    assert calls  # the bucket did go by its pivot


def _one_bucket(batches):
    import pyarrow as pa

    for b in batches:
        lines = [xxhash.xxh64_intdigest(x, 42) for t in b.column(0).to_pylist() for _, _, x in p.paragraphs(t)]
        if lines:
            yield pa.RecordBatch.from_arrays([pa.array([7] * len(lines)), p._signed(lines)], ["k", "line"])


def test_buckets_hold_no_more_than_a_block():
    import pyarrow as pa

    r = random.Random(1)
    for _ in range(50):
        rows = sorted((k, r.randrange(40)) for k in range(r.randrange(1, 6)) for _ in range(r.choice([1, 2, 3, 6, 30])))
        cuts = sorted(r.randrange(len(rows) + 1) for _ in range(3))
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
        batches = [pa.RecordBatch.from_arrays([pa.array([x[0] for x in b], pa.int64()), pa.array([x[1] for x in b], pa.int64())], ["k", "line"]) for b in parts]
        small, large = {}, {}
        for b in p._buckets(iter(batches), 5):
            for kind, bucket, line in zip(*(c.to_pylist() for c in b.columns), strict=True):
                (large if kind == p.LARGE else small).setdefault(bucket, set()).add(line)
        want = {}
        for k, x in rows:
            want.setdefault(k, set()).add(x)
        assert large == {k: v for k, v in want.items() if len(v) > 5}
        assert sorted(map(sorted, small.values())) == sorted({tuple(sorted(v)): sorted(v) for v in want.values() if 1 < len(v) <= 5}.values())


def test_keys_of_many_lines_are_those_of_each():
    lines = [sentence(k, n).encode() for k, n in enumerate((20, 5, 33, 7, 100, 21))] + [b"a b c d e " * 9]
    one = np.concatenate([p.band_keys([p.shingle_set(x)]) for x in lines])
    assert (p.shingle_bands([x.lower().split() for x in lines]) == one).all()


def test_windows_that_repeat_in_a_document_have_a_mark_that_says_so():
    r = random.Random(13)
    for _ in range(60):
        own = lambda n: [f"u{r.randrange(10**9)}" for _ in range(n)]
        x = r.choice([own(51), own(70), ["a"] * 60, own(7) * 9, own(30) * 2])
        w = p._words(" ".join(own(r.randrange(60)) + x + own(r.randrange(60)) + x + own(r.randrange(60))))
        mark, again = p._own_marks(w)
        said, least, key = set(mark[again].tolist()), p._marks(w)[1], p._doubled(w, p.PASSAGE, p._mix).tolist()
        at = {}
        for i, k in enumerate(key):
            if i - at.setdefault(k, i) >= p.PASSAGE:
                assert int(least[i]) in said


def test_white_space_around_a_cut():
    w = " ".join(f"w{i}" for i in range(51))
    assert p.without_words(f"a b\n\n{w} c", [(2, 51)]) == "a b\n\nc"
    assert p.without_words(f" {w}\nc d", [(0, 51)]) == "c d"
    assert p.without_words(f"a {w} ", [(1, 51)]) == "a"
    assert p.without_words("a\nb c\nd", [(1, 1), (2, 1)]) == "a\nd"
