"""SimHash near-duplicates, linked by Golay-code fuzzy hashing.

Fingerprint: 64 bits from XXH64 (seed 42) of 3-word shingles, repeats counted; a bit is set if it is set
in over half of the hashes. No words: zero. Two fingerprints link at 3 or fewer differing bits.

Candidates. The 64 bits are cut into segments of 22, 21 and 21 bits, each padded to a word of the perfect
(23, 12, 7) Golay code, in which every word lies within 3 bits of one codeword. Two words one bit apart
differ in parity; the even one emits the indices of all codewords that words one bit away decode to (one,
or six at the covering radius), the odd one its own index, so they always share an index. Three errors in
three segments leave, by pigeonhole,
  * two segments without error: key of both segments as they are, or
  * one segment without error and one with just one error: key of the first and an index of the second, or
  * just one error in each: key of one index of each, under the pattern of parities.
So every link within 3 bits shares a key of 34 bits or more, and chance candidates stay few at any size.

Texts with equal fingerprints are one class from the start; only distinct fingerprints get keys. Inside a
key's group all members are compared, exactly; what leaves the group is a spanning forest of its links, at
most one row a member. A group beyond ``BLOCK`` members is not gathered: its rows are dealt out anew, by four parts of the
bits that vary in it, of which a link leaves one equal.

Edges: null or empty text is fingerprint zero; null doc_id rows take part, and count last for the smallest
doc_id (a class of null ids alone has a null component_id); repeated rows share a class.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship, stage
from .common import arrow_map, bounded_groups, own_prefix, row_key, spread, union_min, words_of
from .components import connected_components

SHINGLE, SEED, MAX_BITS, BLOCK, STRIP = 3, 42, 3, 4096, 256
SEGMENTS = ((0, 22), (22, 21), (43, 21))
GOLAY = 0xC75  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1


def shingle_hashes(words: list[bytes], n: int = SHINGLE) -> list[int]:
    h = xxhash.xxh64_intdigest
    if not words:
        return []
    if len(words) <= n:
        return [h(b" ".join(words), SEED)]
    text, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[: len(words) - n])]
    return [h(text[s:e], SEED) for s, e in zip(starts, ends[n - 1 :], strict=True)]


def fingerprint(text: str | None, n: int = SHINGLE) -> int:
    hs = shingle_hashes([w for w in words_of(text and text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))], n)
    if not hs:
        return 0
    bits = np.unpackbits(np.array(hs, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int.from_bytes(np.packbits(2 * bits.sum(0, dtype=np.int64) > len(hs), bitorder="little").tobytes(), "little")


def _fingerprints(texts: list, n: int) -> np.ndarray:
    out = np.zeros(len(texts), np.uint64)
    for i, t in enumerate(texts):
        hs = shingle_hashes(t.encode("utf-8", "surrogatepass").lower().split(), n) if t else None
        if hs:
            bits = np.unpackbits(np.array(hs, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            out[i] = np.packbits(2 * bits.sum(0, dtype=np.int32) > len(hs), bitorder="little").view(np.uint64)[0]
    return out


def with_fingerprints(docs: DataFrame, text: str = "text", name: str = "fp", n: int = SHINGLE) -> DataFrame:
    """All columns of docs and ``name``: the fingerprint as a signed long."""
    ship(docs.sparkSession)
    at = docs.columns.index(text)

    def f(batches):
        for b in (w.slice(i, 256) for w in batches for i in range(0, w.num_rows, 256)):
            fp = pa.array(_fingerprints(b.column(at).to_pylist(), n).view(np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns, fp], [*b.schema.names, name])

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])
    return docs.transform(arrow_map, f, schema)


def _syndromes() -> tuple[np.ndarray, np.ndarray]:
    """Remainder of each of the 23 bits, and the error pattern of each remainder."""
    rem = np.zeros(23, np.int64)
    for i in range(23):
        r = 1 << i
        for k in range(22, 10, -1):
            if r >> k & 1:
                r ^= GOLAY << (k - 11)
        rem[i] = r
    err = np.zeros(1 << 11, np.int64)
    for w in (1, 2, 3):
        for c in combinations(range(23), w):
            s = 0
            for i in c:
                s ^= int(rem[i])
            err[s] = sum(1 << i for i in c)
    return rem, err


_REM, _ERR = _syndromes()
_BYTE = [np.array([np.bitwise_xor.reduce([0, *(_REM[8 * k + i] for i in range(8) if v >> i & 1 and 8 * k + i < 23)]) for v in range(256)], np.int64) for k in range(3)]


def golay_index(x: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the one codeword within 3 bits of each 23-bit word."""
    s = _BYTE[0][x & 255] ^ _BYTE[1][x >> 8 & 255] ^ _BYTE[2][x >> 16]
    return (x ^ _ERR[s]) >> 11


def _near(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) of every codeword that a word at most one bit from x decodes to, each once."""
    every = np.concatenate([golay_index(x)[:, None], golay_index(x[:, None] ^ (1 << np.arange(bits)))], axis=1)
    every.sort(axis=1)
    new = np.ones(every.shape, bool)
    new[:, 1:] = every[:, 1:] != every[:, :-1]
    row, col = np.nonzero(new)
    return row, every[row, col]


def _mix(kind: int, *parts: np.ndarray) -> np.ndarray:
    h = np.full(len(parts[0]), 0x9E3779B97F4A7C15 * (kind + 1) % 2**64, np.uint64)
    for p in parts:
        h = (h ^ p.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h * np.uint64(0x94D049BB133111EB) ^ h >> np.uint64(32)


def fuzzy_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all keys of uint64 fingerprints."""
    seg = [(fp >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    odd = [(np.bitwise_count(s) & 1).astype(bool) for s in seg]
    emit = []  # of each segment: rows (sorted) and indices
    for s, o, (_, n) in zip(seg, odd, SEGMENTS, strict=True):
        r, k = _near(s, n)
        own = o[r] & (k != golay_index(s)[r])
        emit.append((r[~own], k[~own]))
    rows, keys = [], []
    for t, (i, j) in enumerate(combinations(range(3), 2)):
        rows.append(np.arange(len(fp)))
        keys.append(_mix(t, seg[i], seg[j]))
    for i in range(3):
        for j in range(3):
            if i != j:
                r, k = emit[j]
                rows.append(r)
                keys.append(_mix(10 + 3 * i + j, seg[i][r], k))
    r, k = emit[0]
    idx = k
    for r2, k2 in emit[1:]:  # product within each row
        n2 = np.bincount(r2, minlength=len(fp))
        first = np.r_[0, np.cumsum(n2)[:-1]]
        times = n2[r]
        into = np.repeat(np.arange(len(r)), times)
        off = np.arange(len(into)) - np.repeat(np.cumsum(times) - times, times)
        r, idx = r[into], idx[into] << 12 | k2[first[r[into]] + off]
    pat = odd[0].astype(np.int64) * 4 + odd[1] * 2 + odd[2]
    rows.append(r)
    keys.append(_mix(30, idx, np.minimum(pat, 7 - pat)[r]))
    return np.concatenate(rows), np.concatenate(keys)


def links_within(x: np.ndarray, most: int = MAX_BITS, block: int = BLOCK, strip: int = STRIP) -> np.ndarray:
    """Smallest index linked to each of the distinct fingerprints x at ``most`` or fewer bits apart.

    Memory is a strip of distances and one label each: pairs whose ends are connected already are not listed.
    """
    n = len(x)
    if n <= strip:
        a, b = np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x) <= most, 1))
        return union_min(n, a, b)
    lab = np.arange(n)

    def add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return union_min(n, np.r_[np.arange(n), a], np.r_[lab, b]) if len(a) else lab

    if n > block:
        differ = int(np.bitwise_or.reduce(x ^ x[0]))
        bits = [1 << i for i in range(64) if differ >> i & 1]
        masks = [sum(c) for w in range(1, most + 1) for c in combinations(bits, w)]
        if len(masks) < n // 2:
            order = np.argsort(x)
            xs = x[order]
            for m in masks:
                y = x ^ np.uint64(m)
                at = np.minimum(np.searchsorted(xs, y), n - 1)
                hit = np.flatnonzero((xs[at] == y) & (lab != lab[order[at]]))
                lab = add(hit, order[at[hit]])
            return lab
    for i in range(0, n, strip):
        for j in range(i, n, block):
            near = np.bitwise_count(x[i : i + strip, None] ^ x[j : j + block]) <= most
            near &= lab[i : i + strip, None] != lab[j : j + block]
            a, b = np.nonzero(near)
            lab = add(a + i, b + j)
    return lab


def _emit_keys(batches):
    for b in batches:
        fp = b.column(0).to_numpy().view(np.uint64)
        for i in range(0, len(fp), 4096):
            r, k = fuzzy_keys(fp[i : i + 4096])
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(fp[i : i + 4096][r].view(np.int64))], ["k", "fp"])


LINK, LARGE = 0, 1


def _pairs(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["kind", "a", "b"])


def _forest(g: np.ndarray, block: int, strip: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links of distinct fingerprints."""
    lab = links_within(g, MAX_BITS, block, strip)
    i = np.flatnonzero(lab != np.arange(len(g)))
    return g[lab[i]], g[i]


def _link_groups(batches, block: int, strip: int):
    """Rows (key, fingerprint), sorted by key -> links, and the rows of groups beyond ``block`` as they are."""
    for large, keys, fps in bounded_groups(batches, block):
        if large:
            yield _pairs(LARGE, keys, fps)
            continue
        x = fps.view(np.uint64)
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        size = np.diff(np.r_[starts, len(x)])
        two = starts[size == 2]
        a, b = x[two], x[two + 1]
        on = (np.bitwise_count(a ^ b) <= MAX_BITS) & (a != b)
        out = [(a[on], b[on])]
        for s, n in zip(starts[size > 2], size[size > 2], strict=True):
            g = np.unique(x[s : s + n])
            if len(g) > block:
                yield _pairs(LARGE, np.full(len(g), keys[s], np.int64), g)
            else:
                out.append(_forest(g, block, strip))
        a, b = (np.concatenate(z) for z in zip(*out, strict=True))
        yield _pairs(LINK, a, b)


def _emit_parts(batches):
    """Rows (k, fp, vary) -> four keys each: those of the group that agree in a fourth of the bits that vary in it."""
    for b in batches:
        k, fp, vary = (c.to_numpy().view(np.uint64) for c in b.columns)
        kinds, at = np.unique(vary, return_inverse=True)
        for part in range(MAX_BITS + 1):
            masks = np.array([sum(1 << x for n, x in enumerate(i for i in range(64) if int(v) >> i & 1) if n % (MAX_BITS + 1) == part) for v in kinds], np.uint64)
            key = _mix(40 + part, k, fp & masks[at])
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b.column(1)], ["k", "fp"])


def _large_links(large: DataFrame, block: int, strip: int, of: DataFrame) -> DataFrame:
    """Links of groups (k, fp) beyond a block. At most three bits differ, so of four parts of the bits that vary in a
    group at all one is equal: the group is dealt out anew by each part, over many tasks. A part that is still beyond
    a block is dealt out once more. Its texts agree in a bit at least that varied before, so this ends: texts that differ
    in three bits at most are eight, which is no more than a block."""
    links = None
    while True:
        vary = large.groupBy(F.col("k").alias("of")).agg((F.bit_or("fp").bitwiseXOR(F.bit_and("fp"))).alias("vary"))
        parts = large.join(vary, F.col("k") == F.col("of")).select("k", "fp", "vary").transform(arrow_map, _emit_parts, "k long, fp long")
        found = _found(parts, block, strip, of)
        own = found.where(F.col("kind") == LINK)
        links = own if links is None else links.union(own)
        large = _beyond(found)
        if not large.limit(1).count():
            return links


def _found(keyed: DataFrame, block: int, strip: int, of: DataFrame) -> DataFrame:
    """(kind, a, b): links in the groups (k, fp), and the members of those beyond a block; a staged table."""
    block = max(block, 1 << MAX_BITS)
    dealt = spread(keyed, "k").sortWithinPartitions("k")
    return stage(dealt.transform(arrow_map, lambda batches: _link_groups(batches, block, strip), "kind int, a long, b long"), "simhash-links", of=of)


def _beyond(found: DataFrame) -> DataFrame:
    return found.where(F.col("kind") == LARGE).select(F.col("a").alias("k"), F.col("b").alias("fp")).distinct()


def classes(prints: DataFrame) -> DataFrame:
    """prints(doc_id, fp), a staged table -> (fp, component_id, class_fp), a row for each distinct fingerprint."""
    ship(prints.sparkSession)
    reps = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-reps", prints.count())
    n = reps.count()
    keyed = reps.select("fp").transform(arrow_map, _emit_keys, "k long, fp long")
    found = _found(keyed, BLOCK, STRIP, prints)
    links = found.where(F.col("kind") == LINK).select("a", "b")
    large = _beyond(found)
    if large.limit(1).count():
        links = links.union(_large_links(large, BLOCK, STRIP, prints).select("a", "b"))
    comp = connected_components(links, of=prints)
    tops = reps.join(comp, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("class_fp"))
    tops = stage(tops, "simhash-tops", n)
    least = tops.groupBy("class_fp").agg(F.min("least").alias("component_id"))
    return stage(tops.select("fp", "class_fp").join(least, "class_fp").select("fp", "component_id", "class_fp"), "simhash-classes", n)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs."""
    prints = stage(with_fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).select("doc_id", "fp"), "simhash-prints", of=docs)
    of = classes(prints).select(F.col("fp").alias("fp2"), "component_id")
    return prints.join(of, F.col("fp") == F.col("fp2")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The row with the smallest doc_id of each group, with the columns of docs.

    Of rows that repeat this doc_id within a group one stays; null doc_ids come after all others. The join
    back to the texts is by row, so no group's texts ever meet in one task.
    """
    key = row_key(F.col(doc_id), F.col(text))
    prints = with_fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), key.alias("rk")))
    prints = stage(prints.select("doc_id", "rk", "fp"), "simhash-prints", of=docs)
    of = classes(prints.select("doc_id", "fp")).select(F.col("fp").alias("fp2"), "component_id", "class_fp")
    win = prints.join(of, F.col("fp") == F.col("fp2")).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    own = own_prefix(docs)
    rk, kept = f"{own}rk", f"{own}kept"
    win = win.groupBy("doc_id", "class_fp").agg(F.min("rk").alias(kept)).select(kept)
    # the join's partitioning by row key serves the last step too: texts are dealt out once
    one = docs.withColumn(rk, key).join(win, F.col(rk) == F.col(kept))
    return one.dropDuplicates([rk, doc_id]).select(*docs.columns)
