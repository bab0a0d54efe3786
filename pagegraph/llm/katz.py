"""Katz backoff language model of words, with bigrams and unigrams.

Tokens of a text: its words (A-Z lower-cased), then one end. Training texts give counts.

Unigrams. Counts r up to ``TURING`` are discounted by Good-Turing, d_r r / N; where the counts of counts give
no discount in (0, 1], d_r is 1. One more event is put beside the N, so mass is left in any case; this mass
is spread evenly over the unseen words, whose number is estimated from the words seen once and twice.

Bigrams. The context of a token is the word before it, or the start; every word is a context of its own. P(w | u) =
d_r r / (T(u) + 1) if the pair was seen r times, else
a(u) P(w), with T(u) the training tokens in context u and a(u) the mass left over the unigram mass of words
not seen in u: for each context the probabilities add up to exactly 1.

Plan. Word counts are summed by word, pre-aggregated (table *unigrams*), then counts of pairs of frequent
words (table *pairs*), of which the ``HOT_PAIRS`` most frequent, if seen more than TURING times, are told to
all and need no more traffic, however often they occur. Then all texts are read once more: each block of
documents sends, for each partition of the n-grams, its packed (word, context, document, times) entries of
all other pairs. A partition is keyed by the word, and for frequent words, whose counts are known to all, by word and
context, so that no word meets in one task; an entry counts a document once, however often it repeats a pair.
A partition sums its bigram counts (table *bigrams*), gives its share of every frequent context's count classes
and seen mass (table *contexts*), and for each document what does not depend on the discounts: sums of log r, how
many seen tokens have r = 1..5, the unseen ones with their context. Frequent contexts come to the driver, CONTEXTS + 2
rows at most, discounts and their backoff weights go out, and each block adds up its documents.

``CONTEXTS`` only says which words are told to all tasks; it changes no score. T(u) of any other word is its own
count, which the partition of the word knows: there each of its tokens pays log (T(u) + 1) for the token after it.
Its seen pairs and the unseen tokens after it travel on to a partition keyed by the context, where its backoff
weight is made and given to the documents.

Edges: null or empty text is the end alone; null doc_ids belong to training; repeated rows count and are
scored each; without training tokens all words are unseen and equally likely (one word assumed).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship, stage
from .common import arrow_map, fold, grouped

CONTEXTS, TURING, HOT_PAIRS = 65_000, 5, 1_000_000
BLOCK_TOKENS, PART_TOKENS = 3_000_000, 2_000_000
END = np.uint64(xxhash.xxh64_intdigest(b"\n", 1))  # no word holds a newline
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def tokens(text: str | None) -> np.ndarray:
    """Hashes of a text's tokens."""
    h = xxhash.xxh64_intdigest
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = [h(w) for w in words]
    out[-1] = END
    return out


def pack(*arrays: np.ndarray) -> bytes:
    head = struct.pack("<I", len(arrays)) + b"".join(struct.pack("<2sQ", a.dtype.str[1:].encode(), len(a)) for a in arrays)
    return zstandard.compress(head + b"".join(a.tobytes() for a in arrays), 1)


def unpack(b: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(b)
    n = struct.unpack_from("<I", raw)[0]
    at, out = 4 + 10 * n, []
    for i in range(n):
        kind, size = struct.unpack_from("<2sQ", raw, 4 + 10 * i)
        a = np.frombuffer(raw, np.dtype("<" + kind.decode()), size, at)
        out.append(a)
        at += a.nbytes
    return out


def small(a: np.ndarray) -> np.ndarray:
    """Counts in the smallest unsigned type that holds them."""
    return a.astype(np.min_scalar_type(int(a.max(initial=0))))


def turing(n: np.ndarray) -> np.ndarray:
    """Discounts d[0..TURING + 1] (d[0] unused, the last for all greater counts) from n[1..TURING + 1]."""
    d = np.ones(TURING + 2)
    if n[1] > 0:
        far = (TURING + 1) * n[TURING + 1] / n[1]
        for r in range(1, TURING + 1):
            if n[r] > 0 and far < 1:
                x = ((r + 1) * n[r + 1] / (r * n[r]) - far) / (1 - far)
                if 0 < x <= 1:
                    d[r] = x
    return d


class Unigrams:
    """P(w) as a function of the training count of w."""

    def __init__(self, n: np.ndarray, total: int, types: int):
        self.total, self.types = total, types
        self.d = turing(n)
        r = np.arange(1, TURING + 1)
        small = (r * n[1 : TURING + 1]).sum()
        kept = (self.d[1 : TURING + 1] * r * n[1 : TURING + 1]).sum() + total - small
        left = 1 - kept / (total + 1)
        unseen = n[1] ** 2 / (2 * n[2]) if n[2] else n[1] * (n[1] - 1) / 2
        self.p0 = left / max(1.0, np.ceil(unseen))

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.d[np.minimum(c, TURING + 1)] * c / (self.total + 1), self.p0)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.total + 0.5 * (self.types + 1)))


def word_counts(docs: DataFrame) -> DataFrame:
    """docs(held, text) -> (h, c): count of every word hash in training texts."""
    block = BLOCK_TOKENS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, size = [], 0

        def out():
            h, c = np.unique(np.concatenate(some), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["h", "c"])

        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                b = whole.slice(i, 512)
                for held, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if not held:
                        some.append(tokens(t))
                        size += len(some[-1])
                if size >= block:
                    yield out()
                    some, size = [], 0
        if some:
            yield out()

    return docs.transform(arrow_map, count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


class _Known:
    """What every task is told: frequent words (sorted by hash) with their counts, and the unigram figures."""

    def __init__(self, h: np.ndarray, c: np.ndarray, uni: Unigrams):
        order = np.argsort(h)
        self.h, self.c, self.uni = h[order], c[order], uni
        own = self.h != END
        n = len(h)
        self.total = np.zeros(n + 2)  # training tokens of each frequent context, 0 for all others, of the start
        self.total[:n] = np.where(own, self.c, 0)
        starts = float(self.c[~own].sum())
        self.total[n + 1] = starts
        self.pair, self.times = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # hot pairs, sorted, and their counts

    def index(self, h: np.ndarray) -> np.ndarray:
        """Number of each word among the frequent ones; theirs and all others' together is len(h)."""
        if not len(self.h):
            return np.zeros(len(h), np.int64)
        i = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return np.where(self.h[i] == h, i, len(self.h))


    def contexts(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(tokens, their number among the frequent words, contexts, starts of documents).

        A context is its number if it is frequent, len(h) + 1 for the start, else its hash.
        """
        v = np.concatenate(docs)
        first = np.r_[0, np.cumsum([len(d) for d in docs])[:-1]]
        own = self.index(v)
        u = np.empty(len(v), np.uint64)
        u[1:] = np.where(own < len(self.h), own.astype(np.uint64), v)[:-1]
        u[first] = len(self.h) + 1
        return v, own, u, first

    def number(self, u: np.ndarray) -> np.ndarray:
        """Number of each context; of those that are not frequent, len(h)."""
        n = len(self.h)
        return np.where(u > n + 1, n, u).astype(np.int64)

    def full(self, number: np.ndarray, far: np.ndarray) -> np.ndarray:
        """Contexts from their numbers and the hashes of those that are not frequent."""
        u = number.astype(np.uint64)
        u[number == len(self.h)] = far
        return u

    def hot(self, u: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Training count of each hot pair, 0 for others."""
        out = np.zeros(len(u), np.int64)
        if len(self.pair):
            at = np.flatnonzero((own < len(self.h)) & (u <= len(self.h) + 1))
            key = pair_key(u[at], own[at])
            i = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            out[at] = np.where(self.pair[i] == key, self.times[i], 0)
        return out


def pair_key(u: np.ndarray, own: np.ndarray) -> np.ndarray:
    return u.astype(np.uint64) << np.uint64(32) | own.astype(np.uint64)


def pair_counts(docs: DataFrame, said, parts: int) -> DataFrame:
    """docs(held, text) -> (pair, c): training counts above TURING of frequent words after a frequent word or the start."""
    block = BLOCK_TOKENS

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, some, size = said.value, [], 0

        def out():
            _, own, u, _ = known.contexts(some)
            on = (own < len(known.h)) & (u <= len(known.h) + 1)
            key, c = np.unique(pair_key(u[on], own[on]), return_counts=True)
            part = (key.astype(np.uint64) * _A >> np.uint64(40)) % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            cut = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
            rows = []
            for p in np.flatnonzero(np.diff(cut)):
                mine = order[cut[p] : cut[p + 1]]
                rows.append((int(p), pack(small(np.diff(key[mine], prepend=np.uint64(0))), small(c[mine]))))  # keys as steps
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "load"])

        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                b = whole.slice(i, 512)
                for held, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if not held:
                        some.append(tokens(t))
                        size += len(some[-1])
                if size >= block:
                    yield out()
                    some, size = [], 0
        if some:
            yield out()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for starts, (_, loads) in grouped(batches):
            for s, e in zip(starts, np.r_[starts[1:], len(loads)], strict=True):
                both = [unpack(loads[int(i)].as_py()) for i in range(s, e)]
                key = np.concatenate([np.cumsum(k.astype(np.int64)) for k, _ in both])
                key, at = np.unique(key, return_inverse=True)
                c = np.bincount(at, weights=np.concatenate([c for _, c in both])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key[c > TURING]), pa.array(c[c > TURING])], ["pair", "c"])

    sent = docs.transform(arrow_map, emit, "part int, load binary").repartitionById(parts, F.col("part"))
    return sent.sortWithinPartitions("part").transform(arrow_map, add, "pair long, c long")


def hot_pairs(pairs: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of the greatest counts, at most ``most``: as many whole classes of counts as fit.

    Counts beyond 2^16 are classed by their length in bits, so the histogram has a fixed size.
    """
    level = F.when(F.col("c") < 65536, F.col("c")).otherwise(65536 + F.floor(F.log2("c")))
    rows = pairs.groupBy(level.cast("long").alias("level")).count().orderBy(F.desc("level")).collect()
    least, n = None, 0
    for r in rows:
        n += r["count"]
        if n > most:
            break
        least = r["level"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    t = pairs.where(level >= least).toArrow()
    pair, c = t.column(0).to_numpy(), t.column(1).to_numpy()
    order = np.argsort(pair)
    return pair[order].astype(np.uint64), c[order].astype(np.int64)


# What a block of documents (a chunk) sends to a partition of the n-grams. Loads are packed arrays:
#   TOKENS  words; contexts of each word; number of each context, hashes of those that are not frequent; documents of each
#           context; document, times of each entry; number of training documents, which come first
#   DOCS    one Arrow table: doc_id, held, tokens, and sums over what the block knows itself
ROW = "part int, kind int, chunk long, load binary"
NAMES = ["part", "kind", "chunk", "load"]
TOKENS, DOCS = 0, 1


def _entries(known: _Known, parts: int, docs: list[tuple], kind) -> Iterator[tuple]:
    """Rows of a block of documents (doc_id, held, tokens), training documents first."""
    docs.sort(key=lambda d: d[1])
    size = np.array([len(d[2]) for d in docs])
    doc = np.repeat(np.arange(len(docs), dtype=np.uint32), size)
    v, own, u, first = known.contexts([d[2] for d in docs])
    n = len(known.h)
    hot = known.hot(u, own)
    context = np.add.reduceat(np.log10(known.total[known.number(u)] + 1) - np.log10(np.maximum(hot, 1)), first)
    frequent = own < n
    base = np.add.reduceat(np.where(frequent, known.uni.base(known.c[np.minimum(own, n - 1)] if n else own), 0), first)
    sure = np.add.reduceat(frequent.astype(np.int64), first)
    cold = hot == 0
    v, own, u, doc, frequent = v[cold], own[cold], u[cold], doc[cold], frequent[cold]
    part = np.where(frequent, (v * _A ^ u * _B) * _A >> np.uint64(11), v * _B >> np.uint64(11)) % np.uint64(parts)
    order = np.lexsort((u, v, part))  # stable: documents stay in order
    v, u, doc, part = v[order], u[order], doc[order], part[order]
    new_v = np.r_[True, (v[1:] != v[:-1]) | (part[1:] != part[:-1])][: len(v)]
    new_u = new_v | np.r_[True, u[1:] != u[:-1]][: len(v)]
    new = new_u | np.r_[True, doc[1:] != doc[:-1]][: len(v)]
    at = np.flatnonzero(new)
    times = np.diff(np.r_[at, len(v)]).astype(np.uint32)
    v, u, doc, part, new_v, new_u = v[at], u[at], doc[at], part[at], new_v[at], new_u[at]
    cut = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
    trained = sum(not d[1] for d in docs)
    for p in np.flatnonzero(np.diff(cut)):
        s = slice(cut[p], cut[p + 1])
        nv, nu = new_v[s], new_u[s]
        nu_at = np.flatnonzero(nu)
        nv_of_u = np.diff(np.r_[np.flatnonzero(nv[nu_at]), len(nu_at)]).astype(np.uint32)
        each = u[s][nu]
        contexts = small(known.number(each)), each[each > n + 1]
        entries = small(np.diff(np.r_[nu_at, len(nu)])), doc[s], small(times[s])
        yield int(p), TOKENS, pack(v[s][nv], small(nv_of_u), *contexts, *entries, np.array([trained], np.uint32))
    ids = pa.array([d[0] for d in docs], kind)
    sink = pa.BufferOutputStream()
    cols = [ids, pa.array([bool(d[1]) for d in docs]), pa.array(size.astype(np.int64)), pa.array(context), pa.array(base), pa.array(sure)]
    t = pa.RecordBatch.from_arrays(cols, ["doc_id", "held", "n", "context", "base", "known"])
    with pa.ipc.new_stream(sink, t.schema) as w:
        w.write_batch(t)
    yield int(docs[0][2][0] % np.uint64(parts)), DOCS, zstandard.compress(sink.getvalue().to_pybytes(), 1)


def _emit(said, parts: int, block: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, task, done, docs, size, kind = said.value, TaskContext.get().partitionId(), 0, [], 0, None

        def out():
            chunk = task << 24 | done
            rows = list(_entries(known, parts, docs, kind))
            part, kinds, loads = zip(*rows, strict=True)
            cols = [pa.array(part, pa.int32()), pa.array(kinds, pa.int32()), pa.array([chunk] * len(rows), pa.int64()), pa.array(loads, pa.binary())]
            return pa.RecordBatch.from_arrays(cols, NAMES)

        for whole in batches:
            kind = whole.column(2).type
            for i in range(0, whole.num_rows, 256):
                b = whole.slice(i, 256)
                for held, t, d in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                    docs.append((d, held, tokens(t)))
                    size += len(docs[-1][2])
                if size >= block:
                    yield out()
                    docs, size, done = [], 0, done + 1
        if docs:
            yield out()

    return f


# What a partition of the n-grams gives:
#   CONTEXT    u, m: its share of a frequent context's count classes, tokens and seen mass
#   SUMS       for a chunk: documents (steps), sums for score and base_score, known tokens, tokens seen 1..TURING times;
#              and document, context, times of unseen tokens in frequent contexts
#   TABLE      its bigrams: words, contexts, counts, pairs of each word
#   DOC_TABLE  a chunk's DOCS, as they came
#   FAR        for a partition of the other contexts: seen pairs (context, times, count of the word), unseen tokens
#              (context, chunk, document, times); its answer is BACK: documents of a chunk and their backoff weights
SHARE = "kind int, u int, m array<double>, chunk long, load binary"
SHARE_NAMES = ["kind", "u", "m", "chunk", "load"]
CONTEXT, SUMS, TABLE, DOC_TABLE, FAR, BACK = 0, 1, 2, 3, 4, 5


def _context_rows(u: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
    n = len(u)
    cols = [pa.array(np.full(n, CONTEXT, np.int32)), pa.array(u.astype(np.int32)), pa.array(list(m), pa.list_(pa.float64()))]
    return pa.RecordBatch.from_arrays([*cols, pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], SHARE_NAMES)


def _load_row(kind: int, chunk: int, load: bytes) -> pa.RecordBatch:
    cols = [pa.array([kind], pa.int32()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.list_(pa.float64()))]
    return pa.RecordBatch.from_arrays([*cols, pa.array([chunk], pa.int64()), pa.array([load], pa.binary())], SHARE_NAMES)


def _partition(said, far_parts: int):
    """Bigram counts of a partition; its share of contexts and of documents' sums."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: _Known = said.value
        n = len(known.h)
        for starts, (_, kinds, chunks, loads) in grouped(batches):
            for s, e in zip(starts, np.r_[starts[1:], len(loads)], strict=True):
                blocks = []
                for i in range(s, e):
                    load = loads[int(i)].as_py()
                    if kinds[int(i)].as_py() == DOCS:
                        yield _load_row(DOC_TABLE, chunks[int(i)].as_py(), load)
                    else:
                        blocks.append((chunks[int(i)].as_py(), unpack(load)))
                if blocks:
                    yield from _evaluate(known, n, blocks, far_parts)

    return f


def _evaluate(known: _Known, n: int, blocks: list, far_parts: int) -> Iterator[pa.RecordBatch]:
    pv, pu, pr = [], [], []  # pairs of each block with their training times
    for _, (v, nv, u, far, nu, doc, times, trained) in blocks:
        pv.append(np.repeat(v, nv))
        pu.append(known.full(u, far))
        pr.append(np.add.reduceat(np.where(doc < trained[0], times, 0).astype(np.int64), np.r_[0, np.cumsum(nu)[:-1]].astype(np.int64)))
    v, u, r = np.concatenate(pv), np.concatenate(pu), np.concatenate(pr)
    order = np.lexsort((u, v))
    v, u, r = v[order], u[order], r[order]
    new_v = np.r_[True, v[1:] != v[:-1]]
    new = new_v | np.r_[True, u[1:] != u[:-1]]
    at = np.flatnonzero(new)
    pair = np.empty(len(order), np.int64)
    pair[order] = np.cumsum(new) - 1
    v, u, r = v[at], u[at], np.add.reduceat(r, at)
    vat = np.flatnonzero(new_v[at])
    own = known.index(v[vat])
    here = np.add.reduceat(r, vat)
    c = np.where(own < n, known.c[np.minimum(own, n - 1)] if n else 0, here)  # frequent words are counted elsewhere too
    each = np.diff(np.r_[vat, len(v)])
    c, rare = np.repeat(c, each), np.repeat(own >= n, each)  # base and known of frequent words are with the documents
    seen = r > 0
    each_word = np.add.reduceat(seen.astype(np.int64), vat)[here > 0]
    table = pack(v[vat][here > 0], small(known.number(u[seen])), u[seen & (u > n + 1)], small(r[seen]), small(each_word))
    yield _load_row(TABLE, 0, table)
    p1, base = known.uni.p(c), np.where(rare, known.uni.base(c), 0)
    after = np.where(rare, np.log10(c + 1), 0)  # log (T + 1) of the context that the word is for the next token
    far, full, u = u > n + 1, u, known.number(u)
    shares = np.zeros((TURING + 3, n + 2))
    for k in range(1, TURING + 2):
        shares[k - 1] = np.bincount(u[r == k], minlength=n + 2)
    shares[TURING + 1] = np.bincount(u[seen], weights=r[seen] * (r[seen] > TURING), minlength=n + 2)
    shares[TURING + 2] = np.bincount(u[seen], weights=p1[seen], minlength=n + 2)
    has = np.flatnonzero(shares[-1])
    if len(has):
        yield _context_rows(has, shares[:, has].T)
    log_r, log_p = np.log10(np.maximum(r, 1)), np.log10(p1)
    end, asked = 0, []
    for chunk, (_, _, bu, _, nu, doc, times, _) in blocks:
        mine = np.repeat(pair[end : end + len(bu)], nu)
        end += len(bu)
        ids, at = np.unique(doc, return_inverse=True)
        k, w = r[mine], times.astype(np.float64)
        add = lambda x: np.bincount(at, weights=x * w, minlength=len(ids))  # noqa: E731, B023
        by_r = [small(add(k == j)) for j in range(1, TURING + 1)]
        unseen, other = (k == 0) & ~far[mine], (k == 0) & far[mine]
        asked.append((full[mine][other], np.full(int(other.sum()), chunk), doc[other], times[other]))
        sums = add(log_r[mine] - after[mine] + np.where(k == 0, log_p[mine], 0)), add(base[mine]), small(add(rare[mine] & (c[mine] > 0)))
        yield _load_row(SUMS, chunk, pack(small(np.diff(ids, prepend=0)), *sums, *by_r, doc[unseen], small(u[mine][unseen]), times[unseen]))
    yield from _far_rows((full[far & seen], r[far & seen], c[far & seen]), [np.concatenate(x) for x in zip(*asked, strict=True)], far_parts)


def _far_rows(pairs: tuple, asked: list, parts: int) -> Iterator[pa.RecordBatch]:
    """For each partition of contexts that are not frequent: (context, times, count of the word) of seen pairs and
    (context, chunk, document, times) of unseen tokens."""

    def dealt(cols):
        part = (cols[0] * _B >> np.uint64(13)) % np.uint64(parts)
        order = np.lexsort((cols[0], part))
        return [x[order] for x in cols], np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))

    (pairs, p), (asked, a) = dealt(pairs), dealt(asked)
    for i in range(parts):
        s, t = slice(p[i], p[i + 1]), slice(a[i], a[i + 1])
        if p[i] < p[i + 1] or a[i] < a[i + 1]:
            u, r, c = (x[s] for x in pairs)
            au, chunk, doc, times = (x[t] for x in asked)
            yield _load_row(FAR, i, pack(u, small(r), small(c), au, chunk, doc, small(times)))


def _far(said):
    """FAR rows of a partition -> for each chunk of documents the backoff weights of its unseen tokens (BACK)."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uni, d = said.value
        for starts, (_, loads) in grouped(batches):
            for s, e in zip(starts, np.r_[starts[1:], len(loads)], strict=True):
                u, r, c, asked, chunk, doc, times = map(np.concatenate, zip(*(unpack(loads[int(i)].as_py()) for i in range(s, e)), strict=True))
                if not len(asked):
                    continue
                on = np.isin(u, asked)
                u, at = np.unique(u[on], return_inverse=True)
                r, c = r[on].astype(np.int64), c[on].astype(np.int64)
                add = lambda x: np.bincount(at, weights=x, minlength=len(u))  # noqa: E731, B023
                total = add(r)
                back = weight(total, add(np.where(r <= TURING, d[np.minimum(r, TURING)] * r, r)), add(uni.p(c)))
                i = np.searchsorted(u, asked)
                known = i < len(u)
                known[known] = u[i[known]] == asked[known]  # a context without training tokens leaves all to the unigrams
                if not known.any():
                    continue
                chunk, doc, gain = chunk[known], doc[known], back[i[known]] * times[known]
                order = np.argsort(chunk, kind="stable")
                chunk, doc, gain = chunk[order], doc[order], gain[order]
                cut = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]])
                for x, y in zip(cut, np.r_[cut[1:], len(chunk)], strict=True):
                    ids, at = np.unique(doc[x:y], return_inverse=True)
                    load = pack(ids, np.bincount(at, weights=gain[x:y]))
                    cols = [pa.array([chunk[x]], pa.int64()), pa.array([BACK], pa.int32()), pa.array([load], pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, ["chunk", "kind", "load"])

    return f


def _finish(said):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_d, back, total = said.value
        for starts, (_, kinds, loads) in grouped(batches):
            for s, e in zip(starts, np.r_[starts[1:], len(loads)], strict=True):
                table = next((i for i in range(s, e) if kinds[int(i)].as_py() == DOC_TABLE), None)
                t = pa.ipc.open_stream(zstandard.decompress(loads[int(table)].as_py())).read_next_batch()
                n = t.num_rows
                score = -t.column(3).to_numpy()
                base, known = t.column(4).to_numpy().copy(), t.column(5).to_numpy().copy()
                for i in range(s, e):
                    if i == table:
                        continue
                    if kinds[int(i)].as_py() == BACK:
                        doc, gain = unpack(loads[int(i)].as_py())
                        score[doc] += gain
                        continue
                    step, lr, b, k, *rest = unpack(loads[int(i)].as_py())
                    ids = np.cumsum(step.astype(np.int64))
                    by_r, (doc, u, times) = rest[:TURING], rest[TURING:]
                    score[ids] += lr + sum(x * y for x, y in zip(by_r, log_d, strict=True))
                    base[ids] += b
                    known[ids] += k
                    np.add.at(score, doc, back[u] * times)
                cols = [t.column(0), t.column(1), t.column(2), *map(pa.array, (known, np.full(n, total), base, score))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return f


def backoff(known: _Known, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(d_0..d_TURING + 1, log10 of a(u) (T(u) + 1) for each frequent context) from the contexts' shares.

    m: for each context the pairs seen 1..TURING + 1 times, the tokens of pairs seen more than TURING times,
    and the unigram mass of its words; row len(h) has the sums of all contexts that are not frequent, which count
    for the discounts and have no weight.
    """
    d = turing(np.r_[0, m[:, : TURING + 1].sum(0)])
    r = np.arange(1, TURING + 1)
    kept = m[:, :TURING] @ (d[1 : TURING + 1] * r) + m[:, TURING + 1]
    n = len(known.h)
    kept[n] = m[n, TURING + 2] = 0
    return d, weight(known.total, kept, m[:, TURING + 2])


def weight(total: np.ndarray, kept: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """log10 of a(u) (T(u) + 1) from T(u), the discounted counts of its pairs and the unigram mass of its words."""
    return np.log10((1 - kept / (total + 1)) / (1 - mass)) + np.log10(total + 1)


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs."""
    spark = docs.sparkSession
    ship(spark)
    some = docs.select(F.coalesce(fold(F.col(doc_id)) == 1, F.lit(False)).alias("held"), F.col(text).alias("text"), F.col(doc_id).alias("doc_id"))
    uni = stage(word_counts(some.select("held", "text")), "katz-unigrams")
    counts = [F.count_if(F.col("c") == r).alias(f"n{r}") for r in range(1, TURING + 2)]
    row = uni.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("total"), F.count("*").alias("types"), *counts).first()
    figures = Unigrams(np.array([0, *(row[f"n{r}"] for r in range(1, TURING + 2))], float), row["total"], row["types"])
    end = F.col("h") == int(END.astype(np.int64))
    top = uni.orderBy(end.desc(), F.desc("c"), "h").limit(CONTEXTS).toArrow()
    known = _Known(top.column(0).to_numpy().view(np.uint64), top.column(1).to_numpy(), figures)
    parts = max(1, -(-row["total"] // PART_TOKENS))
    pairs = stage(pair_counts(some.select("held", "text"), spark.sparkContext.broadcast(known), parts), "katz-pairs")
    known.pair, known.times = hot_pairs(pairs, HOT_PAIRS)
    said = spark.sparkContext.broadcast(known)  # 16 bytes for each of CONTEXTS words and of HOT_PAIRS pairs
    parts = max(1, -(-(row["total"] - int(known.times.sum())) * 5 // 4 // PART_TOKENS))
    far_parts = max(1, -(-(row["total"] - int(known.c.sum())) // PART_TOKENS))
    sent = some.transform(arrow_map, _emit(said, parts, BLOCK_TOKENS), ROW).repartitionById(parts, F.col("part")).sortWithinPartitions("part")
    shares = stage(sent.transform(arrow_map, _partition(said, far_parts), SHARE), "katz-tables")
    sums = [F.sum(F.col("m")[k]).alias(f"m{k}") for k in range(TURING + 3)]
    m = np.zeros((len(known.h) + 2, TURING + 3))
    t = shares.where(F.col("kind") == CONTEXT).groupBy("u").agg(*sums).toArrow()
    for k in range(TURING + 3):
        m[t.column(0).to_numpy(), k] = t.column(k + 1).to_numpy()
    u, own = (x.astype(np.int64) for x in (known.pair >> np.uint64(32), known.pair & np.uint64(2**32 - 1)))
    n = len(m)
    m[:, TURING] += np.bincount(u[known.times == TURING + 1], minlength=n)
    m[:, TURING + 1] += np.bincount(u, weights=known.times, minlength=n)
    m[:, TURING + 2] += np.bincount(u, weights=known.uni.p(known.c[own]), minlength=n) if len(u) else 0
    d, back = backoff(known, m)
    told = spark.sparkContext.broadcast((np.log10(d[1 : TURING + 1]), back, row["total"]))
    far = shares.where(F.col("kind") == FAR).select(F.col("chunk").cast("int").alias("part"), "load").repartitionById(far_parts, F.col("part"))
    far = far.sortWithinPartitions("part").transform(arrow_map, _far(spark.sparkContext.broadcast((figures, d))), "chunk long, kind int, load binary")
    rows = shares.where(F.col("kind").isin(SUMS, DOC_TABLE)).select("chunk", "kind", "load").union(far)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = some.schema["doc_id"].dataType.simpleString()
    by_chunk = rows.repartition(max(n, 2 * parts // 3), "chunk").sortWithinPartitions("chunk")
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return by_chunk.transform(arrow_map, _finish(told), schema)
