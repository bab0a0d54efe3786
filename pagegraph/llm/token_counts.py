"""Token counts by section, from one encoding of the whole document.

A document is encoded once with a byte-level BPE, whose tokens tile its UTF-8 bytes, so a running sum of
token lengths gives every token's span. Spans of tokens and of sections, both in order, are joined by
bisection. Rule for a token that crosses a boundary: it goes to the section that holds most of its bytes, the
earlier one on a tie; a token that touches no section goes to none and is counted apart as ``outside``.

Sections are the lines of a text (each with its newline), or rows of a table of character spans. Null or
empty text has no sections and no tokens. Sections that overlap are cut at the start of the next; empty or
inverted ones get no tokens. Repeated rows give repeated rows; texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import re
from hashlib import md5
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import arrow_map, row_key

#: White space as the split patterns know it, in runs that their engine's stack may not hold.
LONG_WHITE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{2000,}")
_KEPT: dict[str, tuple] = {}


def vocabulary_key(ranks_text: bytes, pattern: str) -> str:
    return md5(ranks_text + pattern.encode()).hexdigest()


def encoder(ranks_text: bytes, pattern: str, key: str | None = None):
    """(tiktoken encoding, byte length of each id), made once a worker; key: ``vocabulary_key``, if it is known."""
    key = key or vocabulary_key(ranks_text, pattern)
    if key not in _KEPT:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_text.splitlines())}
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        for t, i in ranks.items():
            size[i] = len(t)
        _KEPT.clear()
        _KEPT[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), size
    return _KEPT[key]


def ids_of(enc, text: str) -> list[int]:
    """The ids of a whole text. A run of white space too long for the split pattern's engine is given to the merges as
    the piece that the pattern makes of it: the run, without its last character if a word follows."""
    if not LONG_WHITE.search(text):
        return enc.encode_ordinary(text)
    out, at = [], 0
    for m in LONG_WHITE.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        out += enc.encode_ordinary(text[at : m.start()])
        out += enc._encode_single_piece(text[m.start() : end])
        at = end
    return out + enc.encode_ordinary(text[at:])


def spans(ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans (start, end) of tokens that tile a text."""
    end = np.cumsum(size[ids])
    return end - size[ids], end


def allocate(start: np.ndarray, end: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(section of each token or -1, whether the token crosses a boundary), by most bytes, earlier on a tie.

    Sections [s, e) are in order of s and do not overlap.
    """
    at, most = np.full(len(start), -1), np.zeros(len(start), np.int64)
    if not len(s):
        return at, np.zeros(len(start), bool)
    first = np.searchsorted(e, start, side="right")  # the first section that ends after the token starts
    last = np.searchsorted(s, end, side="left")  # sections from here on start at its end or later
    for k in range(int((last - first).max(initial=0))):
        j = np.minimum(first + k, len(s) - 1)
        share = np.where(first + k < last, np.minimum(end, e[j]) - np.maximum(start, s[j]), 0)
        better = share > most
        at[better], most[better] = j[better], share[better]
    return at, (at >= 0) & (most < end - start)


def _lines(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    cut = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    s = np.r_[0, cut]
    e = np.r_[cut, len(raw)]
    return (s, e) if s[-1] < len(raw) else (s[:-1], e[:-1])


OUT = ["doc_id", "section", "start", "end", "n_tokens", "n_crossing", "doc_tokens"]


def by_line(docs: DataFrame, ranks: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, section, start, end, n_tokens, n_crossing, doc_tokens): a row per line, spans in characters."""
    spark = docs.sparkSession
    ship(spark)
    said = spark.sparkContext.broadcast(Path(ranks).read_bytes())  # a vocabulary file of fixed size
    some = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def f(batches):
        enc, size = encoder(said.value, pattern)
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                b = whole.slice(i, 256)
                rows, cols = [], [[] for _ in range(6)]
                for r, t in enumerate(b.column(1).to_pylist()):
                    if not t:
                        continue
                    raw = t.encode()
                    ids = np.array(ids_of(enc, t), np.int64)
                    s, e = _lines(raw)
                    at, crossing = allocate(*spans(ids, size), s, e)
                    chars = np.r_[0, np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)]
                    n = len(s)
                    for c, v in zip(cols, (np.arange(n), chars[s], chars[e], np.bincount(at, minlength=n), np.bincount(at[crossing], minlength=n), np.full(n, len(ids))), strict=True):
                        c.append(v)
                    rows += [r] * n
                if rows:
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), *(pa.array(np.concatenate(c).astype(np.int64)) for c in cols)], OUT)

    kind = some.schema["doc_id"].dataType.simpleString()
    return some.transform(arrow_map, f, f"doc_id {kind}, section long, start long, end long, n_tokens long, n_crossing long, doc_tokens long")


def by_span(docs: DataFrame, sections: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """sections(doc_id, section, start, end in characters) of docs(doc_id, text) -> sections' columns,
    n_tokens and n_crossing; a row with section null and the outside tokens for each document.

    Sections of a document travel as one array; documents and sections meet in one join by doc_id.
    """
    spark = docs.sparkSession
    ship(spark)
    said = spark.sparkContext.broadcast(Path(ranks).read_bytes())
    each = sections.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "section"))).alias("parts")).withColumnRenamed("doc_id", "__id")
    some = docs.select("doc_id", "text", row_key(F.col("doc_id"), F.col("text")).alias("rk"))
    part = lambda k, kind: F.coalesce(F.transform("parts", lambda p: p[k].cast(kind)), F.array().cast(f"array<{kind}>")).alias(k)
    joined = some.join(each, F.col("doc_id") == F.col("__id"), "left").select("doc_id", "text", part("start", "bigint"), part("end", "bigint"), part("section", "string"))

    def f(batches):
        enc, size = encoder(said.value, pattern)
        for b in batches:
            rows, names, starts, ends, counts, crosses = [], [], [], [], [], []
            for r, (t, s, e, n) in enumerate(zip(*(b.column(k).to_pylist() for k in range(1, 5)), strict=True)):
                raw = (t or "").encode()
                ids = np.array(ids_of(enc, t or ""), np.int64)
                begin = np.r_[np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80), len(raw)]
                most = len(begin) - 1
                a = np.clip(np.array(s, np.int64), 0, most)
                z = np.clip(np.array(e, np.int64), 0, most)
                z = np.maximum(a, np.minimum(z, np.r_[a[1:], most])) if len(a) else z
                at, crossing = allocate(*spans(ids, size), begin[a], begin[z])
                rows += [r] * (len(a) + 1)
                names += [*n, None]
                starts += [*s, None]
                ends += [*e, None]
                counts += [*np.bincount(at[at >= 0], minlength=len(a)).tolist(), int((at < 0).sum())]
                crosses += [*np.bincount(at[crossing], minlength=len(a)).tolist(), 0]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(names, pa.string()), *(pa.array(x, pa.int64()) for x in (starts, ends, counts, crosses))], OUT[:6])

    kind = some.schema["doc_id"].dataType.simpleString()
    return joined.transform(arrow_map, f, f"doc_id {kind}, section string, start long, end long, n_tokens long, n_crossing long")
