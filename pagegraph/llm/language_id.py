"""Language identification by error-correcting output codes.

Every language has a codeword of bits. A binary classifier of character n-grams (1 to 3 letters with word
ends, lower-cased, hashed into ``DIMS`` features) predicts each bit: naive Bayes between the languages whose
codeword has the bit and the others. Decoding adds, for every codeword, the logistic losses of its bits,
weighted by how well each bit's two sides are told apart, and takes the codeword of the least loss.

Up to seven languages the code is exhaustive (all splits in two); beyond, it is the best of ``TRIALS`` seeded
random codes by least distance. ``ambiguous`` flags rows whose two best codewords are less than ``GAP`` apart
in score or where the predicted bits are nearer to another codeword.

Learning reads all rows with a text and a non-null lang outside the held-out fold; what comes to the driver
is one count vector per language, for every language of the table. Null text, or text
without a letter, is ``und`` with score 0; so is everything if nothing was learned. Equal scores go to the
language that sorts first; repeated rows get equal answers.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import arrow_map, fold

DIMS, SMOOTH, TRIALS, GAP = 1 << 14, 0.5, 200, 0.1
MOST_LANGUAGES = 512
_LETTER: list[np.ndarray] = []
_A, _B, _C = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def features(text: str | None) -> np.ndarray | None:
    """Count vector of the text's n-grams; null if it has no letter."""
    if not text:
        return None
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    on = _letters()[c]
    if not on.any():
        return None
    keep = on.copy()
    keep[1:] |= on[:-1]  # one space after each word
    c = np.where(on, c, np.uint32(32))[keep]
    c = c[:-1] if c[-1] == 32 else c
    c = np.concatenate([np.array([32], np.uint32), c, np.array([32], np.uint32)])
    shift = np.uint32(32 - DIMS.bit_length() + 1)
    one = c * _A
    two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * _B + c[1:]
    two = two * _C
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * _B + c[2:]
    every = np.concatenate([one[c != 32], two, three * _C])
    return np.bincount(((every ^ (every >> np.uint32(16))) * _A) >> shift, minlength=DIMS)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """(n, bits) of +1 and -1, no two columns equal or opposite, all with both signs."""
    if n < 2:
        return np.ones((n, 1), int)
    if n <= 7:
        rest = range(1, n)
        cols = [[1 if i == 0 or i in s else -1 for i in range(n)] for k in range(n - 1) for s in combinations(rest, k)]
        return np.array(cols).T
    rng, best, far = np.random.default_rng(seed), None, -1
    bits = int(np.ceil(10 * np.log2(n)))
    for _ in range(TRIALS):
        code = rng.choice([-1, 1], (n, bits))
        if (np.abs(code.sum(0)) == n).any():
            continue
        d = (bits - code @ code.T) // 2
        least = int((d + bits * np.eye(n, dtype=int)).min())
        if least > far:
            best, far = code, least
    return best


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> dict:
    """The model: bits of codewords as weights of DIMS features. The driver gets at most DIMS counts for each of
    ``MOST_LANGUAGES`` languages; more values of ``lang`` are an error, as they are no languages."""
    ship(docs.sparkSession)
    some = docs.where((fold(F.col(doc_id)) != 0) & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    named = [r["lang"] for r in some.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect()]
    if len(named) > MOST_LANGUAGES:
        raise ValueError(f"{lang} has more than {MOST_LANGUAGES} values: clean the labels or raise MOST_LANGUAGES")

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for b in (w.slice(i, 256) for w in batches for i in range(0, w.num_rows, 256)):
            for t, la in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                v = features(t) if la in known else None
                if v is not None:
                    total[la] = total.get(la, 0) + v
        for la, v in total.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([la] * len(at), pa.string()), pa.array(at), pa.array(v[at])], ["lang", "dim", "n"])

    known = frozenset(named)
    counts = some.transform(arrow_map, count, "lang string, dim long, n long").groupBy("lang", "dim").agg(F.sum("n").alias("n")).toArrow()
    langs, at = np.unique(counts["lang"].to_numpy(), return_inverse=True) if counts.num_rows else ([], None)
    langs = list(langs)
    if not langs:
        return {"langs": [], "code": None, "w": None, "bias": None, "weight": None}
    n = np.zeros((len(langs), DIMS))
    n[at, counts["dim"].to_numpy()] = counts["n"].to_numpy()
    p = (n + SMOOTH) / (n.sum(1, keepdims=True) + SMOOTH * DIMS)  # every language weighs the same
    code = codewords(len(langs))
    w, weight = np.zeros((DIMS, code.shape[1]), np.float32), np.ones(code.shape[1])
    for b in range(code.shape[1]):
        on, off = code[:, b] > 0, code[:, b] < 0
        if on.any() and off.any():
            x, y = p[on].mean(0), p[off].mean(0)
            w[:, b] = np.log(x / y)
            weight[b] = 0.5 * ((x - y) * np.log(x / y)).sum()  # symmetric divergence of the two sides
    return {"langs": langs, "code": code, "w": w, "weight": weight / weight.sum()}


def decode(v: np.ndarray, m: dict) -> tuple[str, float, bool]:
    """(language, score, ambiguous) of a count vector."""
    code, n = m["code"], v.sum()
    s = (v @ m["w"]) / np.sqrt(n)
    loss = (np.logaddexp(0, -code * s) * m["weight"]).sum(1)
    e = np.exp(-(loss - loss.min()) * code.shape[1])
    e /= e.sum()
    best = int(np.argmin(loss))
    if len(e) == 1:
        return m["langs"][0], 1.0, False
    bits = np.where(s >= 0, 1, -1)
    near = int(np.argmin((code != bits).sum(1)))
    two = np.sort(e)[-2]
    return m["langs"][best], float(e[best]), bool(e[best] - two < GAP or ((code[near] != bits).sum() < (code[best] != bits).sum()))


def predict(docs: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous for every row of docs."""
    ship(docs.sparkSession)
    said = docs.sparkSession.sparkContext.broadcast(model)  # DIMS x bits floats
    some = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(fold(F.col(doc_id)) == 0, F.lit(False)).alias("held_out"), F.col(text).alias("text"))

    def one(t, m):
        v = features(t) if m["langs"] else None
        return ("und", 0.0, False) if v is None else decode(v, m)

    def f(batches):
        m = said.value
        for b in (w.slice(i, 256) for w in batches for i in range(0, w.num_rows, 256)):
            a, s, u = zip(*[one(t, m) for t in b.column(2).to_pylist()], strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(a, pa.string()), pa.array(s, pa.float64()), pa.array(u, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    return some.transform(arrow_map, f, f"doc_id {some.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, ambiguous boolean")
