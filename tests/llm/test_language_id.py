import math
import random
import zlib
from itertools import combinations

import numpy as np
import pytest

from pagegraph.llm import language_id as lid

from .conftest import data


@pytest.mark.parametrize("n", [1, 2, 4, 7, 12, 40])
def test_codewords_are_apart(n):
    c = lid.codewords(n)
    assert c.shape[0] == n and set(np.unique(c)) <= {-1, 1}
    d = [(c[i] != c[j]).sum() for i in range(n) for j in range(i)]
    assert n == 1 or min(d) >= max(1, c.shape[1] // 4)


def test_features_of_words():
    assert lid.features(None) is None and lid.features("") is None and lid.features("12 #! 9") is None
    a, b = lid.features("Abc  abc"), lid.features("abc 1 ABC!")
    assert (a == b).all() and a.sum() > 0
    assert lid.features("äöü").sum() == 3 + 4 + 3  # letters, pairs and triples with word ends


def test_accuracy_on_held_out_rows(spark, small):
    docs = spark.read.parquet(small.replace("0.001", "0.01") + "/documents.parquet")
    out = lid.predict(docs, lid.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang_pred <> 'und'")
    assert out.where("lang = lang_pred").count() >= 0.97 * out.count()
    assert out.where("score < 0 or score > 1").count() == 0


def test_edges(docs, rows, clashing, empty):
    m = lid.fit(docs)
    out = lid.predict(docs, m).collect()
    assert len(out) == len(rows)
    assert m["langs"] == ["de", "en"]
    by = {r["doc_id"]: r for r in out}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (3, 4, 7))
    assert by[None]["held_out"] is False
    assert {r["lang_pred"] for r in out} <= {"de", "en", "und"}
    assert lid.predict(clashing, m).count() == len(rows)
    assert data(lid.predict(empty, m)) == []
    none = lid.fit(empty)
    assert {r["lang_pred"] for r in lid.predict(docs, none).collect()} == {"und"}


def test_more_labels_than_languages_are_an_error(spark, docs, monkeypatch):
    monkeypatch.setattr(lid, "MOST_LANGUAGES", 2)
    assert lid.fit(docs)["langs"] == ["de", "en"]
    dirty = spark.createDataFrame([(i, "some words", f"tag{i}") for i in range(60)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="more than 2 values"):
        lid.fit(dirty)


def plain_counts(text):
    """Hashed n-grams of a text, character by character."""
    m32 = 2**32 - 1
    spaced, word = " ", False
    for ch in (text or "").lower():
        if ch.isalpha():
            spaced, word = spaced + ch, True
        elif word:
            spaced, word = spaced + " ", False
    spaced += "" if spaced.endswith(" ") and len(spaced) > 1 else " "
    c = [ord(x) for x in spaced]
    if len(c) < 3:
        return None
    one = [x * 0x9E3779B1 & m32 for x in c]
    two = [((a ^ a >> 15) * 0x85EBCA6B + b) * 0xC2B2AE35 & m32 for a, b in zip(one, c[1:], strict=False)]
    three = [(((a ^ a >> 13) * 0x85EBCA6B + b) & m32) * 0xC2B2AE35 & m32 for a, b in zip(two, c[2:], strict=False)]
    out = [0] * lid.DIMS
    for x in [h for h, k in zip(one, c, strict=True) if k != 32] + two + three:
        out[((x ^ x >> 16) * 0x9E3779B1 & m32) >> 18] += 1
    return out


def plain_model(rows):
    """Languages, codewords, bit classifiers and their weights, by the docstring."""
    total = {}
    for i, t, la, *_ in rows:
        v = plain_counts(t) if t is not None and la is not None and i is not None and zlib.crc32(str(i).encode()) % 5 != 0 else None
        if v is not None:
            total[la] = [a + b for a, b in zip(total.get(la, [0] * lid.DIMS), v, strict=True)]
    langs = sorted(total)
    p = [[(x + 0.5) / (sum(total[la]) + 0.5 * lid.DIMS) for x in total[la]] for la in langs]
    splits = [{0, *s} for k in range(len(langs) - 1) for s in combinations(range(1, len(langs)), k)]  # all splits in two
    bits, weight = [], []
    for on in splits:
        x = [sum(p[k][d] for k in on) / len(on) for d in range(lid.DIMS)]
        off = [k for k in range(len(langs)) if k not in on]
        y = [sum(p[k][d] for k in off) / len(off) for d in range(lid.DIMS)]
        bits.append([math.log(a / b) for a, b in zip(x, y, strict=True)])
        weight.append(sum((a - b) * w for a, b, w in zip(x, y, bits[-1], strict=True)) / 2)
    return langs, splits, bits, [w / sum(weight) for w in weight]


def plain_answer(text, model):
    langs, splits, bits, weight = model
    v = plain_counts(text)
    if v is None:
        return "und", 0.0
    at = [(d, x) for d, x in enumerate(v) if x]
    s = [sum(x * w[d] for d, x in at) / math.sqrt(sum(v)) for w in bits]
    loss = [sum(wt * math.log1p(math.exp(-abs(z))) + wt * max(0.0, -z) for z, wt in ((sb if k in on else -sb, wt) for sb, on, wt in zip(s, splits, weight, strict=True))) for k in range(len(langs))]
    e = [math.exp(-(x - min(loss)) * len(splits)) for x in loss]
    return langs[loss.index(min(loss))], max(e) / sum(e)


@pytest.mark.parametrize("n", [2, 3, 4])
def test_bits_weights_and_decoding_against_a_plain_restatement(spark, n):
    r = random.Random(n)
    words = {f"l{k}": ["".join(r.choice("abcdefgäöüß"[k : k + 6]) for _ in range(r.randint(2, 7))) for _ in range(30)] for k in range(n)}
    rows = [(i, " ".join(r.choice(words[la]) for _ in range(r.randint(1, 25))) + r.choice(["", " 12!", "\nAb"]), la) for i, la in enumerate(r.choice(sorted(words)) for _ in range(120))]
    rows += [(500, None, "l0"), (501, "", "l1"), (502, "12 34", "l0"), (503, "abc", None), (None, "abc def", "l0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = plain_model(rows)
    got = {(x["doc_id"]): x for x in lid.predict(docs, lid.fit(docs)).collect()}
    for i, t, _ in rows:
        la, score = plain_answer(t, model)
        assert got[i]["lang_pred"] == la and got[i]["score"] == pytest.approx(score, abs=2e-4), i


def test_ambiguous_text_is_flagged():
    w = np.zeros((lid.DIMS, 1), np.float32)
    m = {"langs": ["a", "b"], "code": np.array([[1], [-1]]), "w": w, "weight": np.ones(1)}
    assert lid.decode(lid.features("any text"), m) == ("a", 0.5, True)


def test_more_than_200_languages(spark):
    rows = [(i, chr(0x4E00 + i // 4) * 8, f"l{i // 4}") for i in range(820)]
    m = lid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(m["langs"]) == 205
