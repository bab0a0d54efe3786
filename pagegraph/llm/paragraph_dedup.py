"""Substring dedup by paragraph MinHash banding.

Paragraphs are lines of ``MIN_WORDS`` words or more, as far as they have ``LONG`` words at most. Longer lines
are cut into pieces, and lines with fewer words are joined to blocks, of more than 50 words each, at ends that
follow from the words alone, so that what precedes a piece doesn't shift it for long. Equal paragraphs are one
text from the start. Distinct texts get MinHash values of their 5-word shingles (A-Z lower-cased), ``BANDS``
bands of ``ROWS`` values each: at the similarity of 0.8 a pair meets in some band with probability
1 - (1 - 0.8^ROWS)^BANDS, 0.9992 here, and more above. Texts that meet are compared by exact Jaccard
similarity of their shingle sets. Verified pairs form components; of each component the first paragraph (by
doc_id, then position) stays and the others are cut out of their documents. Equality is by 64 bits for the joins
and 128 bits for the cut: a paragraph whose 64 bits belong to two texts is left alone.

Colliding buckets of up to ``BLOCK`` texts are compared as wholes and give a spanning forest of verified links.
A larger bucket is not gathered: its members are compared with one of them, the pivot, each in its own row.
Jaccard distance is a metric, so a member within 0.2 of the pivot needs no comparison but with members that lie
between 0.2 and 0.4 from it, and only members beyond 0.2 are dealt out again, as pairs of blocks.

Then passages: in the texts that are left, every run of ``PASSAGE`` words (A-Z lower-cased, any white space
between them) that occurs earlier, by doc_id, then position, is cut, wherever lines end. Only an occurrence in the
same document that overlaps the first one stays. This is MinHash too, of similarity 1: of each window of PASSAGE
words the least hash of its runs of ``MARK`` words is its only band, so two documents that share a window share
it. Windows whose mark occurs once in all are not looked at again; the others are compared by 128 bits.

Texts are dealt out by row key once, into a bucketed table that serves the later joins without a shuffle; small
tables in many partitions, of less than 1 MB a bucket, are staged in a few files and dealt out again.

Edges: null text stays null; an empty or short document stays as it is; null doc_ids come after others; a
document all of whose paragraphs go keeps its row with an empty text; rows that repeat a doc_id and text are
one document, and their text is kept in each; n_chars, where present, is set anew for changed texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship, stage, stage_bucketed
from .common import arrow_map, bounded_groups, grouped, own_prefix, release, row_key, spread, union_min
from .components import connected_components

MIN_WORDS, LONG, SHINGLE, SIMILAR = 20, 100, 5, 0.8
PASSAGE, MARK = 51, 26
PIECE, PIECE_MOST, BLOCK_END, PIECE_END = 51, 100, 2, 16
BANDS, ROWS, BLOCK = 10, 3, 512
_RNG = np.random.default_rng(20)
_MUL = _RNG.integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, BANDS * ROWS, np.uint64)
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _raw(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _pieces(words: list[bytes]) -> Iterator[tuple[int, int]]:
    """(first word, number of words) of the pieces of a long line; each ends after a word whose hash is a multiple
    of PIECE_END, or at PIECE_MOST words; a rest under PIECE words belongs to the piece before it."""
    h, at, n = xxhash.xxh64_intdigest, 0, len(words)
    while n - at >= 2 * PIECE:
        end = at + PIECE
        most = min(at + PIECE_MOST, n - PIECE)
        while end < most and h(words[end - 1].lower()) % PIECE_END:
            end += 1
        yield at, end - at
        at = end
    yield at, n - at


def paragraphs(text: str | None) -> list[tuple[int, int, bytes]]:
    """(first word, number of words, text) of the paragraphs that take part, in order."""
    if not text:
        return []
    h, out, at, block, size = xxhash.xxh64_intdigest, [], 0, [], 0
    for line in [*_raw(text).split(b"\n"), None]:
        words = line.split() if line is not None else []
        if 0 < len(words) < MIN_WORDS:
            block += words
            size += 1
            if len(block) >= PIECE and (len(block) >= PIECE_MOST or h(b" ".join(words).lower()) % BLOCK_END == 0):
                out.append((at + len(words) - len(block), len(block), b" ".join(block)))
                block = []
        elif words or line is None:
            if len(block) >= PIECE:
                out.append((at - len(block), len(block), b" ".join(block)))
            block = []
            if 0 < len(words) <= LONG:
                out.append((at, len(words), line))
            elif words:
                out += [(at + k, n, b" ".join(words[k : k + n])) for k, n in _pieces(words)]
        at += len(words)
    return out


def _hashes(words: list[bytes]) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.array([h(x) for x in words], np.uint64)


def shingle_set(line: bytes, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the line's shingles; a shorter line is one shingle."""
    w = _hashes(line.lower().split())
    return np.unique(_roll(w, min(n, len(w)))) if len(w) else w


def _roll(w: np.ndarray, n: int) -> np.ndarray:
    m = len(w) - n + 1
    s = w[:m] * _P
    for k in range(1, n):
        s = (s ^ (s >> np.uint64(31))) * _Q ^ w[k : m + k]
    return s


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """(len(sets), BANDS) keys; sets are not empty."""
    return _band_keys(np.concatenate(sets), np.r_[0, np.cumsum([len(s) for s in sets])[:-1]])


def _band_keys(every: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Keys of the sets that start at these places; what repeats in a set doesn't matter."""
    key = np.empty((len(at), BANDS), np.uint64)
    for b in range(BANDS):
        k = np.full(len(at), b + 1, np.uint64) * _P
        for r in range(ROWS):
            i = b * ROWS + r
            x = every * _MUL[i]
            x += _ADD[i]
            x ^= x >> np.uint64(32)
            x *= _P
            k = (k ^ np.minimum.reduceat(x, at)) * _Q
            k ^= k >> np.uint64(29)
        key[:, b] = k
    return key


def shingle_bands(lines: list[list[bytes]]) -> np.ndarray:
    """Band keys of lines of SHINGLE words or more, given as lower-cased words: one array of shingles for all."""
    size = np.array([len(x) for x in lines])
    w = _hashes([x for line in lines for x in line])
    ends = np.cumsum(size)
    whole = np.ones(len(w), bool)  # places where a shingle starts that lies in one line
    for k in range(1, SHINGLE):
        whole[ends - k] = False
    return _band_keys(_roll(w, SHINGLE)[whole[: len(w) - SHINGLE + 1]], np.r_[0, np.cumsum(size - SHINGLE + 1)[:-1]])


def _signed(x) -> pa.Array:
    return pa.array(np.array(x, np.uint64).view(np.int64))


class _Seen(set):
    """Keys that a task has met; of bounded size: what is met again after it was forgotten costs a row more."""

    def new(self, key: int) -> bool:
        if key in self:
            return False
        if len(self) >= 300_000:
            self.clear()
        self.add(key)
        return True


def _bands(batches):
    h, seen = xxhash.xxh64_intdigest, _Seen()
    for whole in batches:
        for i in range(0, whole.num_rows, 128):
            lines, ids = [], []
            for t in whole.column(0).slice(i, 128).to_pylist():
                for _, _, line in paragraphs(t):
                    key = h(line, 42)
                    if seen.new(key):
                        lines.append(line.lower().split())
                        ids.append(key)
            if ids:
                k = shingle_bands(lines).reshape(-1)
                yield pa.RecordBatch.from_arrays([_signed(k), _signed(np.repeat(np.array(ids, np.uint64), BANDS))], ["k", "line"])


def _emit_texts(batches):
    h, seen = xxhash.xxh64_intdigest, _Seen()
    for whole in batches:
        for i in range(0, whole.num_rows, 256):
            ids, texts = [], []
            for t in whole.column(0).slice(i, 256).to_pylist():
                for _, _, line in paragraphs(t):
                    key = h(line, 42)
                    if seen.new(key):
                        ids.append(key)
                        texts.append(line)
            if ids:
                yield pa.RecordBatch.from_arrays([_signed(ids), pa.array(texts, pa.binary())], ["line2", "t"])


def _emit_places(batches):
    """rows (rk, doc_id, text) -> a row for each paragraph."""
    h = xxhash.xxh64_intdigest
    for whole in batches:
        for i in range(0, whole.num_rows, 256):
            b = whole.slice(i, 256)
            rows, line, check, at, size = [], [], [], [], []
            for r, t in enumerate(b.column(2).to_pylist()):
                for k, n, x in paragraphs(t):
                    rows.append(r)
                    line.append(h(x, 42))
                    check.append(h(x, 43))
                    at.append(k)
                    size.append(n)
            if rows:
                of = pa.array(rows)
                yield pa.RecordBatch.from_arrays([_signed(line), _signed(check), b.column(0).take(of), b.column(1).take(of), pa.array(at, pa.int32()), pa.array(size, pa.int32())], ["line", "check", "rk", "doc_id", "n", "size"])


SMALL, LARGE = 0, 1


def _buckets(batches, block: int):
    """Rows (k, line), sorted by k -> (kind, bucket, line) of buckets of two texts or more.

    Small buckets go under their own hash, so that equal ones are one. Rows of a bucket beyond ``block`` go on one by
    one, under k.
    """

    def rows(kind: int, bucket, line) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(line), kind, np.int32)), pa.array(np.asarray(bucket).view(np.int64)), pa.array(line)], ["kind", "bucket", "line"])

    for large, keys, lines in bounded_groups(batches, block):
        if large:
            yield rows(LARGE, keys, lines)
            continue
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        size = np.diff(np.r_[starts, len(keys)])
        two = starts[size == 2]
        a, b = np.minimum(lines[two], lines[two + 1]), np.maximum(lines[two], lines[two + 1])
        a, b = a[a != b], b[a != b]
        bucket, line = [np.repeat((a.view(np.uint64) * _P ^ b.view(np.uint64)) * _Q, 2)], [np.stack([a, b], 1).reshape(-1)]
        for s, n in zip(starts[size > 2], size[size > 2], strict=True):
            g = np.unique(lines[s : s + n])
            if len(g) > block:
                yield rows(LARGE, np.full(len(g), keys[s], np.int64), g)
            elif len(g) > 1:
                bucket.append(np.full(len(g), xxhash.xxh64_intdigest(g.tobytes()), np.uint64))
                line.append(g)
        yield rows(SMALL, np.concatenate(bucket), np.concatenate(line))


def jaccard_links(sets: list[np.ndarray], least: float = SIMILAR) -> np.ndarray:
    """Smallest index linked to each of the sets at this Jaccard similarity or more."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([0, 0]) if both >= least * (size.sum() - both) else np.arange(2)
    _, term = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), size)
    has = np.zeros((n, int(term.max(initial=-1)) + 1), np.float32)
    has[owner, term] = 1
    both = has @ has.T
    a, b = np.nonzero(np.triu(both >= least * (size[:, None] + size - both) - 1e-6, 1))
    return union_min(n, a, b)


def _verify(batches):
    for starts, (_, lines, texts) in grouped(batches):
        x = lines.to_numpy()
        ends = np.r_[starts[1:], len(x)]
        a, b = [], []
        for s, e in zip(starts, ends, strict=True):
            g, first = np.unique(x[s:e], return_index=True)
            if len(g) < 2:
                continue
            lab = jaccard_links([shingle_set(texts[int(s + i)].as_py()) for i in first])
            i = np.flatnonzero(lab != np.arange(len(g)))
            a.append(g[lab[i]])
            b.append(g[i])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])


@F.arrow_udf(T.DoubleType())
def _similarity(x: pa.Array, y: pa.Array) -> pa.Array:
    out = []
    for a, b in zip(x.to_pylist(), y.to_pylist(), strict=True):
        a, b = shingle_set(a), shingle_set(b)
        both = len(np.intersect1d(a, b, assume_unique=True))
        out.append(both / (len(a) + len(b) - both))
    return pa.array(out, pa.float64())


def _large_links(large: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links with the pivots, (bucket, line) of blocks to compare) of buckets beyond BLOCK; texts(line2, t)."""
    pivot = large.groupBy(F.col("bucket").alias("of")).agg(F.min("line").alias("pivot"), F.count("*").alias("size"))
    pivot = pivot.join(texts, F.col("pivot") == F.col("line2")).select("of", "pivot", "size", F.col("t").alias("pt"))
    near = large.join(texts, F.col("line") == F.col("line2")).join(pivot, F.col("bucket") == F.col("of"))
    near = near.select("bucket", "line", "pivot", "size", _similarity("t", "pt").alias("s"))
    near = stage(near, "paragraph-pivots", of=texts)
    links = near.where(F.col("line") != F.col("pivot")).where(F.col("s") >= SIMILAR - 1e-9).select(F.col("pivot").alias("a"), F.col("line").alias("b"))
    # 0: linked to the pivot, 1: may be linked to such a member, 2: to none of them
    far = F.when(F.col("s") >= SIMILAR - 1e-9, 0).when(F.col("s") >= 2 * SIMILAR - 1 - 1e-9, 1).otherwise(2)
    dealt = near.withColumn("far", far)
    size = dealt.groupBy(F.col("bucket").alias("of")).agg(*(F.count_if(F.col("far") == k).alias(f"n{k}") for k in range(3))).where("n1 + n2 > 0")
    dealt = dealt.join(size, F.col("bucket") == F.col("of")).where("far > 0 or n1 > 0")
    blocks = [F.ceil(F.col(f"n{k}") / (BLOCK // 2)).cast("int") for k in range(3)]
    own = F.pmod(F.xxhash64("line", F.lit(9)), F.greatest(F.lit(1), F.element_at(F.array(*blocks), F.col("far") + 1)))

    def span(kind: int) -> Column:
        """(kind, number) of each block of a kind."""
        return F.when(blocks[kind] > 0, F.transform(F.sequence(F.lit(0), blocks[kind] - 1), lambda i: F.struct(F.lit(kind).alias("kind"), i.cast("long").alias("i")))).otherwise(F.array().cast("array<struct<kind:int,i:bigint>>"))

    # of two kinds that need comparing, a block of each: 0 with 1, 1 with 1 and 2, 2 with 2
    partners = F.when(F.col("far") == 0, span(1)).when(F.col("far") == 1, F.concat(span(0), span(1), span(2))).otherwise(F.concat(span(1), span(2)))
    each = dealt.select("bucket", "line", F.struct(F.col("far").alias("kind"), own.alias("i")).alias("own"), F.explode(partners).alias("other"))
    pair = F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other"))
    return links, each.select(pair.alias("bucket"), "line").distinct()


def repeated(docs: DataFrame) -> DataFrame:
    """docs(rk, doc_id, text) -> (rk, cuts: (first word, words) of paragraphs to cut, n_repeated, n_words of
    paragraphs with a copy elsewhere), documents with such paragraphs only."""
    spark = docs.sparkSession
    ship(spark)
    some = docs.select("rk", "doc_id", "text")
    keyed = some.select("text").transform(arrow_map, _bands, "k long, line long")
    dealt = spread(keyed, "k").sortWithinPartitions("k")
    buckets = dealt.transform(arrow_map, lambda batches, block=BLOCK: _buckets(batches, block), "kind int, bucket long, line long")
    buckets = stage(buckets.distinct(), "paragraph-buckets", of=docs)
    # both sides of the joins with text grow with the corpus: the same plan at every size
    ids = buckets.select(F.col("line").alias("line3")).distinct()
    texts = some.select("text").transform(arrow_map, _emit_texts, "line2 long, t binary").join(ids.hint("merge"), F.col("line2") == F.col("line3"), "left_semi")
    texts = stage(texts.dropDuplicates(["line2"]), "paragraph-texts", 8 * buckets.count())
    small = buckets.where(F.col("kind") == SMALL).select("bucket", "line")
    large = buckets.where(F.col("kind") == LARGE).select("bucket", "line")
    links = None
    if large.limit(1).count():
        links, more = _large_links(large, texts)
        small = small.union(more)
    with_text = small.join(texts, F.col("line") == F.col("line2")).select("bucket", "line", "t")
    found = spread(with_text, "bucket").sortWithinPartitions("bucket").transform(arrow_map, _verify, "a long, b long")
    comp = connected_components(found if links is None else found.union(links), of=docs)
    doc_kind = some.schema["doc_id"].dataType.simpleString()
    places = stage(some.transform(arrow_map, _emit_places, f"line long, check long, rk long, doc_id {doc_kind}, n int, size int"), "paragraph-places", of=docs)
    at = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rk", "n")
    one = places.groupBy("line").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.min("check").alias("lo"), F.max("check").alias("hi"))
    one = one.join(comp, F.col("line") == F.col("node"), "left").where("lo = hi and (first <> last or component is not null)")
    one = stage(one.select("line", "first", F.coalesce("component", "line").alias("top")), "paragraph-classes", places.count())
    least = one.groupBy(F.col("top").alias("top2")).agg(F.min("first").alias("least"))
    keep = one.join(least, F.col("top") == F.col("top2")).select(F.col("line").alias("line2"), F.col("least.rk").alias("rk2"), F.col("least.n").alias("n2"))
    twice = places.join(keep, F.col("line") == F.col("line2"))
    cut = F.when((F.col("rk") != F.col("rk2")) | (F.col("n") != F.col("n2")), F.struct("n", "size"))
    every = F.collect_set(F.struct("n", "size"))
    words = F.aggregate(every, F.lit(0).cast("long"), lambda x, p: x + p["size"])
    return twice.groupBy("rk").agg(F.collect_set(cut).alias("cuts"), F.size(every).alias("n_repeated"), words.alias("n_words"))


def _words(text: str | None) -> np.ndarray:
    return _hashes(_raw(text).lower().split()) if text else np.zeros(0, np.uint64)


def _doubled(x: np.ndarray, n: int, join) -> np.ndarray:
    """join over each run of n values, by runs of doubled length; the last two may overlap."""
    k = 1
    while k < n:
        step = min(k, n - k)
        x = join(x[: max(0, len(x) - step)], x[step:])
        k += step
    return x


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * _P ^ (a >> np.uint64(29))) * _Q + b
    return (x ^ x >> np.uint64(32)) * _P


def _marks(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of MARK words, least of them in each window of PASSAGE words)."""
    runs = _doubled(w, MARK, _mix)
    return runs, _doubled(runs, PASSAGE - MARK + 1, np.minimum)


def _own_marks(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The marks of a text, and of each whether it may mark two windows that don't overlap.

    Windows that share a mark by one place are neighbours, as many as a mark fits in at most; windows that don't overlap
    are not, unless the mark repeats all the way.
    """
    least = _marks(w)[1]
    first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    long = np.diff(np.r_[first, len(least)]) > PASSAGE - MARK + 1
    mark, at, times = np.unique(least[first], return_inverse=True, return_counts=True)
    again = times > 1
    again[at[long]] = True
    return mark, again


def _emit_marks(batches):
    """rows (rk, text) -> the marks of each text."""
    for whole in batches:
        for i in range(0, whole.num_rows, 256):
            b = whole.slice(i, 256)
            rk, mark, again = [], [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = _words(t)
                if len(w) >= PASSAGE:
                    m, twice = _own_marks(w)
                    mark.append(m)
                    again.append(twice)
                    rk.append(np.full(len(m), k, np.int64))
            if rk:
                yield pa.RecordBatch.from_arrays([_signed(np.concatenate(mark)), pa.array(np.concatenate(rk)), pa.array(np.concatenate(again))], ["mark", "rk", "again"])


def _emit_windows(batches):
    """rows (rk, doc_id, text, marks) -> (two hashes, rk, doc_id, at) of the windows with one of the marks."""
    for whole in batches:
        for i in range(0, whole.num_rows, 64):
            b = whole.slice(i, 64)
            rows, key, check, at = [], [], [], []
            for r, (t, m) in enumerate(zip(b.column(2).to_pylist(), b.column(3), strict=True)):
                w = _words(t)
                on = np.flatnonzero(np.isin(_marks(w)[1], m.values.to_numpy().view(np.uint64)))
                key.append(_doubled(w, PASSAGE, _mix)[on])
                check.append(_doubled(w * _Q ^ w >> np.uint64(31), PASSAGE, _mix)[on])
                at.append(on)
                rows.append(np.full(len(on), r))
            if rows:
                of = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([_signed(np.concatenate(key)), _signed(np.concatenate(check)), b.column(0).take(of), b.column(1).take(of), pa.array(np.concatenate(at).astype(np.int32))], ["window", "check", "rk", "doc_id", "at"])


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def without_words(text: str, cuts: list[tuple[int, int]]) -> str:
    """text without the words of each (first word, number of words); of the white space around a cut the side
    with more line ends stays, none at the ends of the text."""
    raw = _raw(text)
    spans = [m.span() for m in _WORD.finditer(raw)]
    start, size = np.array(cuts, np.int64).reshape(-1, 2).T
    gone = np.zeros(len(spans) + 1, np.int64)
    np.add.at(gone, start, 1)
    np.add.at(gone, start + size, -1)
    gone = np.r_[0, np.cumsum(gone)[:-1] > 0, 0]
    out, end = [], 0
    for a, z in zip(np.flatnonzero(np.diff(gone) == 1), np.flatnonzero(np.diff(gone) == -1), strict=True):
        left = raw[end if a == 0 else spans[a - 1][1] : spans[a][0]]
        right = raw[spans[z - 1][1] : spans[z][0] if z < len(spans) else len(raw)]
        out.append(raw[end : spans[a][0] - len(left)])
        if a > 0 and z < len(spans):
            out.append(max(left, right, key=lambda x: x.count(b"\n")))
        end = spans[z - 1][1] + len(right)
    return b"".join([*out, raw[end:]]).decode("utf-8", "surrogatepass")


@F.arrow_udf(T.StringType())
def _without(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, cuts in batches:
        both = zip(texts.to_pylist(), cuts.to_pylist(), strict=True)
        yield pa.array([None if t is None or c is None else without_words(t, [(x["n"], x["size"]) for x in c]) for t, c in both], pa.string())
    release()


def _left(text: Column, cuts: Column) -> Column:
    """text without the cuts; only texts with cuts travel to Python."""
    some = F.size(cuts) > 0
    return F.when(some, _without(F.when(some, text), F.when(some, cuts))).otherwise(text)


def passages(docs: DataFrame) -> DataFrame:
    """docs(rk, doc_id, text), dealt out by rk -> (rk, cuts: windows that occur earlier, every: all that occur
    elsewhere), of documents with such windows."""
    ship(docs.sparkSession)
    marks = stage(docs.select("rk", "text").transform(arrow_map, _emit_marks, "mark long, rk long, again boolean"), "passage-marks", of=docs)
    twice = marks.groupBy(F.col("mark").alias("mark2")).agg(F.min("rk").alias("lo"), F.max("rk").alias("hi"), F.max("again").alias("again")).where("lo <> hi or again").select("mark2")
    mine = marks.join(twice.hint("merge"), F.col("mark") == F.col("mark2"), "left_semi").groupBy(F.col("rk").alias("rk2")).agg(F.collect_set("mark").alias("marks"))
    texts = docs.select("rk", "doc_id", "text").join(mine.hint("merge"), F.col("rk") == F.col("rk2")).select("rk", "doc_id", "text", "marks")
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = stage(texts.transform(arrow_map, _emit_windows, f"window long, check long, rk long, doc_id {kind}, at int"), "passage-windows", of=docs)
    at = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rk", "at")
    one = found.groupBy(F.col("window").alias("window2"), F.col("check").alias("check2")).agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first <> last")
    one = one.select("window2", "check2", "first")
    later = (F.col("rk") != F.col("first.rk")) | (F.col("at") >= F.col("first.at") + PASSAGE)
    both = found.join(one, (F.col("window") == F.col("window2")) & (F.col("check") == F.col("check2")))
    window = F.struct(F.col("at").alias("n"), F.lit(PASSAGE).alias("size"))
    return both.groupBy("rk").agg(F.collect_set(F.when(later, window)).alias("cuts"), F.collect_set(window).alias("every"))


def _covered(spans: Column) -> tuple[Column, Column]:
    """(words covered by spans, runs of them that touch each other)."""
    zero = F.struct(F.lit(-1).alias("end"), F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("runs"))

    def step(x: Column, p: Column) -> Column:
        end = p["n"] + p["size"]
        more = (end - F.greatest(x["end"], p["n"])).cast("long")
        return F.struct(F.greatest(x["end"], end).alias("end"), (x["words"] + F.greatest(F.lit(0), more)).alias("words"), (x["runs"] + (p["n"] > x["end"]).cast("long")).alias("runs"))

    total = F.aggregate(F.array_sort(spans), zero, step)
    return total["words"], total["runs"]


def _cut(docs: DataFrame, doc_id: str, text: str, own: str) -> DataFrame:
    """docs with columns whose names begin with ``own``: gone (paragraphs cut), repeated and words (those with a copy),
    starts (windows cut), every (windows that occur elsewhere) and new, the text left."""
    key = row_key(F.col(doc_id), F.col(text))
    gone = repeated(docs.select(key.alias("rk"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    gone = gone.select(F.col("rk").alias(f"{own}rk2"), F.col("cuts").alias(f"{own}gone"), F.col("n_repeated").alias(f"{own}repeated"), F.col("n_words").alias(f"{own}words"))
    keyed = docs.withColumn(f"{own}rk", key).join(gone.hint("merge"), F.col(f"{own}rk") == F.col(f"{own}rk2"), "left").drop(f"{own}rk2")
    left = stage_bucketed(keyed.withColumn(f"{own}new", _left(F.col(text), F.col(f"{own}gone"))), "paragraph-left", f"{own}rk", of=docs)
    starts = passages(left.select(F.col(f"{own}rk").alias("rk"), F.col(doc_id).alias("doc_id"), F.col(f"{own}new").alias("text")))
    starts = starts.select(F.col("rk").alias(f"{own}rk3"), F.col("cuts").alias(f"{own}starts"), F.col("every").alias(f"{own}every"))
    out = left.join(starts.hint("merge"), F.col(f"{own}rk") == F.col(f"{own}rk3"), "left")
    return out.withColumn(f"{own}new", _left(F.col(f"{own}new"), F.col(f"{own}starts")))


def cut_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with repeated paragraphs and passages cut out of ``text``; other columns stay, n_chars follows a
    changed text."""
    own = own_prefix(docs)
    out = _cut(docs, doc_id, text, own)
    changed = (F.size(f"{own}gone") > 0) | (F.size(f"{own}starts") > 0)

    def col(c: str):
        if c == text:
            return F.col(f"{own}new").alias(c)
        if c == "n_chars":
            return F.when(changed, F.length(f"{own}new").cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c)
        return F.col(c)

    return out.select(*map(col, docs.columns))


def removals(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """has_passage, n_repeated_words, n_repeated, n_cut (long) and the text left, for every row of docs.

    n_repeated_words: words of the document that occur elsewhere, in paragraphs with a copy or near copy or in verbatim
    passages of more than 50 words, kept ones included; has_passage: there are more than 50 of them. n_repeated counts
    the paragraphs with a copy or near copy, kept ones included, n_cut the paragraphs and passages that are cut.
    """
    cut = _cut(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id", "text", "pg_")
    none = F.lit(0).cast("long")
    words = F.coalesce("pg_words", none) + F.coalesce(_covered(F.col("pg_every"))[0], none)
    n_cut = F.coalesce(F.size("pg_gone").cast("long"), none) + F.coalesce(_covered(F.col("pg_starts"))[1], none)
    n_repeated = F.coalesce(F.col("pg_repeated").cast("long"), none)
    return cut.select("doc_id", (words >= PASSAGE).alias("has_passage"), words.alias("n_repeated_words"), n_repeated.alias("n_repeated"), n_cut.alias("n_cut"), F.col("pg_new").alias("text"))
