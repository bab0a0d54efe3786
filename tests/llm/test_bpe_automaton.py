import hashlib
import json
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer as Library

from pagegraph.llm import bpe_automaton as bpe

from .conftest import LONG, data, same

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tok():
    return bpe.tokenizer(open(PATH, encoding="utf-8").read())


@pytest.fixture(scope="module")
def library():
    return Library.from_file(PATH)


def test_any_text_is_encoded_as_by_the_library(tok, library):
    r = random.Random(3)
    letters = "abcdeéàüßñΣσİIı'stre mld\n\t\x1c\x85  !?,.-<|endoftext|>0123٣中文日本é̀😀👍🏽ﬁ½Ǆ  "
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(4000)]
    texts += ["".join(r.choice("aehost") for _ in range(r.randint(1, 30))) for _ in range(3000)]
    texts += ["a<|endoftext|>b", "<|startoftext|>", "aaaaaaa", "x" * 3000, LONG, "don't we've", "", "   "]
    for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        n, ids_hex, text_hex, ids = tok.digests(t)
        assert ids == e.ids == tok.encode(t), t
        assert n == len(ids)
        assert ids_hex == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert text_hex == hashlib.sha256(library.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()


def plain_merge(word, ranks):
    parts = list(word)
    while True:
        pairs = [(ranks[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in ranks]
        if not pairs:
            return parts
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_small_automata_against_repeated_merging():
    r = random.Random(1)
    for _ in range(60):
        live = list("abc")
        merges = []
        for _ in range(r.randint(1, 14)):
            p = (r.choice(live), r.choice(live))
            if p[0] + p[1] not in live:
                merges.append(p)
                live.append(p[0] + p[1])
        ranks = {p: i for i, p in enumerate(merges)}
        a = bpe.Automaton({t: i for i, t in enumerate(live)}, merges)
        for _ in range(150):
            w = "".join(r.choice("abc") for _ in range(r.randint(1, 14)))
            assert [a.labels[i] for i in a.encode(w)] == plain_merge(w, ranks), (w, merges)


class Gadgets:
    """The automaton state by state and arc by arc, each gadget as the paper's rule has it."""

    def __init__(self, symbols, merges):
        self.arcs = [dict.fromkeys(symbols, 0)]  # of each state: label -> state
        for u, v in merges:
            behind = next((a[u] for a in self.arcs if u in a), None)
            if behind is None or v not in self.arcs[behind]:
                continue
            to = self.arcs[behind][v]
            self.arcs.append({t: s for t, s in self.arcs[behind].items() if t != v})
            copy = len(self.arcs) - 1
            for a in self.arcs:
                if u in a:
                    a[u] = copy
            for a in self.arcs:
                if u in a:
                    a[u + v] = to

    def behind(self, label):
        states = {a[label] for a in self.arcs if label in a}
        assert len(states) <= 1  # arcs with one label lead to one state
        return states.pop() if states else None


def test_states_and_arcs_against_the_gadgets_one_by_one():
    r = random.Random(4)
    for _ in range(150):
        live, merges = list("abcd"), []
        for _ in range(r.randint(1, 16)):
            p = (r.choice(live), r.choice(live))
            if p[0] + p[1] not in live:
                merges.append(p)
                live.append(p[0] + p[1])
        a, g = bpe.Automaton({t: i for i, t in enumerate(live)}, merges), Gadgets("abcd", merges)
        for s in live:
            at = g.behind(s)
            assert (s in a.live) == (at is not None)
            for t in live if at is not None else ():
                if t in a.live:
                    assert a.has_arc(a.live[s], a.live[t]) == (t in g.arcs[at]), (s, t, merges)


def test_every_prefix_has_one_path():
    """At each place just one label's arc leaves the state of the prefix before it."""
    r = random.Random(6)
    for _ in range(60):
        live, merges = list("ab"), []
        for _ in range(10):
            p = (r.choice(live), r.choice(live))
            if p[0] + p[1] not in live:
                merges.append(p)
                live.append(p[0] + p[1])
        a = bpe.Automaton({t: i for i, t in enumerate(live)}, merges)
        w = "".join(r.choice("ab") for _ in range(20))
        path = [[]]
        for j in range(1, len(w) + 1):
            ways = [path[i] + [a.live[w[i:j]]] for i in range(j) if w[i:j] in a.live and (not i or a.has_arc(path[i][-1], a.live[w[i:j]]))]
            assert len(ways) == 1
            path.append(ways[0])
            assert a.encode(w[:j]) == ways[0]


def test_added_tokens_and_normalizers_come_from_the_file():
    spec = {"added_tokens": [{"content": "[X]", "id": 7}], "normalizer": {"type": "Lowercase"}, "pre_tokenizer": {"pretokenizers": [{"pattern": {"Regex": "[a-z]|[A-Z]"}}]}, "model": {"vocab": {"a": 0, "b": 1, "ab": 2}, "merges": ["a b"]}}
    assert bpe.Tokenizer(json.dumps(spec)).encode("aB[X]b") == [0, 1, 7, 1]
    spec["normalizer"] = {"type": "Strip"}
    with pytest.raises(ValueError, match="Strip"):
        bpe.Tokenizer(json.dumps(spec))


def test_merge_that_never_applies_is_left_out():
    merges = [("a", "b"), ("b", "a"), ("ab", "a"), ("a", "ba")]
    a = bpe.Automaton({t: i for i, t in enumerate(["a", "b", "ab", "ba", "aba"])}, merges)
    for w in ("aba", "baba", "abab", "aaba", "bab"):
        assert [a.labels[i] for i in a.encode(w)] == plain_merge(w, {p: i for i, p in enumerate(merges)})


def test_unknown_symbol():
    with pytest.raises(ValueError, match="no path"):
        bpe.Automaton({"a": 0}, []).encode("ab")


def test_query_rows(docs, rows, library):
    def want(r):
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        return r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    assert same(data(bpe.digests(docs, PATH)), [want(r) for r in rows])


def test_columns_stay(clashing, docs):
    out = bpe.encode(docs, PATH)
    assert out.columns == [*docs.columns, "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    assert all(len(r["ids"]) == r["n_tokens"] for r in out.collect())
    assert bpe.digests(clashing, PATH).count() == clashing.count()


def test_empty(empty):
    assert data(bpe.digests(empty, PATH)) == []
