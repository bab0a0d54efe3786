"""Quality rules: log-likelihood ratio of hashed n-grams between trusted and raw text.

Words of each text, as they stand, give hashed unigrams and bigrams in ``BUCKETS`` buckets. Two multinomials
with add-``SMOOTH`` smoothing: *raw*, from every document, and *trusted*, from documents that labels call
good. A document's score is the mean over its n-grams of log p_trusted - log p_raw. A document below the
threshold is rejected.

The hash of doc_id deals all labelled rows to two sides, without a bound on either. The trusted side is a
classifier's training set: all good rows with an even hash. The threshold comes from all labelled rows with
an odd one (good and bad, not used for the multinomials): of all cuts between bins of score that reject no
more than ``MAX_LOSS`` of the good ones, the one that tells good from bad best, the lowest on a tie. Counts
of the raw corpus and the verdicts cover all rows. Only the bucket counts (a fixed number) and histograms
reach the driver. Labelled texts are joined with their labels once and staged.

Edges: null or empty text has no words, so base_failed is true. Without labels of the good kind the score is
0 and nothing is rejected by it; without bad ones the cut is where MAX_LOSS of the good would go. Null
doc_ids are scored like others; labels that repeat count once; repeated rows get equal verdicts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship, stage
from .common import arrow_map, release

BUCKETS, SMOOTH = 1 << 16, 1.0
MAX_LOSS = 0.002
BINS, LOW, HIGH = 4000, -10.0, 10.0
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
SYMBOLS, WHITE = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def word_hashes(raw: bytes) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.array([h(w) for w in raw.split()], np.uint64)


def ngram_buckets(h: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of all unigrams and bigrams of a text."""
    shift = np.uint64(64 - buckets.bit_length() + 1)
    two = (h[:-1] * _A ^ h[1:]) * _B if len(h) > 1 else h[:0]
    return (np.concatenate([h * _B, two]) >> shift).astype(np.int64)


def base_figures(text: str | None, h: np.ndarray | None = None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if h is None:
        h = word_hashes(raw)
    n = len(h)
    chars = len(text or "") - (len(raw) - len(raw.translate(None, WHITE)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = raw.split(b"\n")
    if len(lines) > 1 and len(set(lines)) < len(lines):
        seen, dup = set(), 0
        for x in lines:
            if x in seen:
                dup += bool(x.split())
            else:
                seen.add(x)
    else:
        dup = 0
    repeat = 0
    if n > WINDOW:
        w = h[: n - WINDOW + 1].copy()
        for k in range(1, WINDOW):
            w = (w * _A) ^ (w >> np.uint64(31)) ^ h[k : n - WINDOW + 1 + k] * _B
        order = np.argsort(w, kind="stable")
        s = w[order]
        same = s[1:] == s[:-1]
        if same.any():
            again = np.zeros(len(s), bool)
            again[1:] |= same
            again[:-1] |= same
            cover = np.zeros(n + 1, np.int64)
            at = order[again]
            np.add.at(cover, at, 1)
            np.add.at(cover, at + WINDOW, -1)
            repeat = int((np.cumsum(cover[:n]) > 0).sum())
    return n, chars, symbols, dup, repeat


def base_fails(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


def _samples(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(trusted ids, judges with their quality): all labelled rows on either side of the hash, without common ids."""
    one = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    one = one.withColumn("odd", F.pmod(F.xxhash64("doc_id", F.lit("trusted")), F.lit(2)) == 1).withColumnRenamed("doc_id", "t_id")
    return one.where("not odd and quality = 1").select("t_id"), one.where("odd and quality in (0, 1)").select("t_id", "quality")


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> dict:
    """{"ratio": float32 for each bucket, "threshold": float}."""
    spark = docs.sparkSession
    ship(spark)
    trusted, judges = _samples(labels)
    known = stage(trusted.select("t_id", F.lit(None).cast("int").alias("quality")).union(judges.select("t_id", F.col("quality").cast("int"))), "quality-labels", of=labels)
    # ids grow with the labels: which side is told to all tasks is left to Spark's size statistics
    some = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    labelled = stage(some.join(known, F.col("doc_id") == F.col("t_id")).select("text", "quality"), "quality-texts")

    def count(batches):
        n = np.zeros(BUCKETS, np.int64)
        for b in (w.slice(i, 256) for w in batches for i in range(0, w.num_rows, 256)):
            for t in b.column(0).to_pylist():
                if t:
                    n += np.bincount(ngram_buckets(word_hashes(t.encode("utf-8", "surrogatepass"))), minlength=BUCKETS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["bucket", "n"])

    def counts(texts):
        rows = texts.transform(arrow_map, count, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).toArrow()
        n = np.zeros(BUCKETS)
        n[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
        return n

    good = counts(labelled.where("quality is null").select("text"))
    if not good.sum():
        return {"ratio": np.zeros(BUCKETS, np.float32), "threshold": -np.inf}
    raw = counts(some.select("text"))
    ratio = np.log((good + SMOOTH) / (good.sum() + SMOOTH * BUCKETS)) - np.log((raw + SMOOTH) / (raw.sum() + SMOOTH * BUCKETS))
    ratio = ratio.astype(np.float32)
    judged = labelled.where("quality is not null")

    def bins(batches):
        n = np.zeros((2, BINS), np.int64)
        for b in batches:
            for t, q in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h = word_hashes((t or "").encode("utf-8", "surrogatepass"))
                if not base_fails(len(h), base_figures(t, h)[-1]):
                    n[int(q == 1), _bin(score(h, ratio))] += 1
        q, at = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(at), pa.array(n[q, at])], ["q", "bin", "n"])

    rows = judged.transform(arrow_map, bins, "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    n = np.zeros((2, BINS), np.int64)
    for q, at, x in zip(rows["q"], rows["bin"], rows["n"], strict=True):
        n[q, at] = x
    return {"ratio": ratio, "threshold": _cut(n)}


def _bin(s: float) -> int:
    return int(min(BINS - 1, max(0, (s - LOW) * BINS / (HIGH - LOW))))


def _cut(n: np.ndarray) -> float:
    """Bins below the cut are rejected; n: counts of bad (0) and good (1) judges by bin."""
    if not n[1].sum():
        return -np.inf
    lost = np.r_[0, np.cumsum(n[1])] / n[1].sum()
    caught = np.r_[0, np.cumsum(n[0])] / max(1, n[0].sum())
    may = lost <= MAX_LOSS
    at = int(np.flatnonzero(may)[-1]) if not n[0].sum() else int(np.argmax(np.where(may, caught - lost, -1)))
    return LOW + at * (HIGH - LOW) / BINS


def score(h: np.ndarray, ratio: np.ndarray) -> float:
    return float(ratio[ngram_buckets(h)].mean(dtype=np.float64)) if len(h) else 0.0


FIGURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"


def _verdicts(texts: list, ratio: np.ndarray, threshold: float) -> list[tuple]:
    out = []
    for t in texts:
        h = word_hashes((t or "").encode("utf-8", "surrogatepass"))
        five = base_figures(t, h)
        failed, s = base_fails(five[0], five[4]), score(h, ratio)
        out.append((*five, failed, s, not failed and s >= threshold))
    return out


def judge(docs: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the figures of every document."""
    ship(docs.sparkSession)
    said = docs.sparkSession.sparkContext.broadcast((model["ratio"], model["threshold"]))  # 256 KB
    names = ["doc_id", *(x.split()[0] for x in FIGURES.split(", "))]

    def f(batches):
        for b in (w.slice(i, 256) for w in batches for i in range(0, w.num_rows, 256)):
            cols = list(zip(*_verdicts(b.column(1).to_pylist(), *said.value), strict=True)) or [[]] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    some = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return some.transform(arrow_map, f, f"doc_id {some.schema['doc_id'].dataType.simpleString()}, {FIGURES}")


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that are kept, with its columns."""
    model = fit(docs, labels, doc_id, text)
    said = docs.sparkSession.sparkContext.broadcast((model["ratio"], model["threshold"]))

    @F.arrow_udf("boolean")
    def kept(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for whole in batches:
            said_of = [_verdicts(whole.slice(i, 256).to_pylist(), *said.value) for i in range(0, len(whole), 256)]
            yield pa.array([v[-1] for part in said_of for v in part], pa.bool_())
        release()

    return docs.where(kept(F.col(text)))  # texts go to Python and only verdicts come back
