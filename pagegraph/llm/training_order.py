"""Training-order materialisation: every sequence gets a global slot from keyed permutations.

Documents are cut into sequences of ``LENGTH`` token ids of a fixed width, the last one padded with zeros. The
registered query takes the ids of a BPE vocabulary; without an encoder they are the UTF-8 bytes of the text.

A sequence's identity, the hash of its row and its number in the row, goes through a keyed Feistel network over 64 bits,
and the range of 64 bits is cut into as many equal parts as there are shards: so sequences are dealt out evenly and at
random in one shuffle, without a count of them before. In its shard a sequence has an ordinal, its rank by permuted
identity; a balanced Feistel network over the smallest even number of bits that holds the shard's n records permutes
the ordinals, values of n or more walking on along their cycle until they fall below n. Slot = records in the shards
before + this value. Both networks take the same key. Nothing here depends on files, tasks or cores: equal rows give equal
shards, byte by byte, on any cluster.

A task writes one shard, as one file of records of ``stride`` bytes: the ids, then doc_id, the sequence's number and
its tokens (TRAILER), then a newline, by Spark's text writer, which commits files by renaming and so leaves none of a
lost executor. So a reader finds a slot by its shard's first slot (in the manifest) and an offset alone, goes on from
any slot, and reads in training order without a seek. A shard is made in a task's memory, some 17 MB by the defaults.

Null or empty text has no sequence. Repeated rows are sequences of their own, of equal bytes; of a few rows that repeat
the sequences share an identity and lie in one shard, of many, which are counted before, each copy has its own, so
that no shard gets them all. No row is dropped. doc_id is an integer or null; another type is an error at once.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from hashlib import sha256
from pathlib import Path
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import STAGED_AS, ship, stage, stage_path
from .common import arrow_map, row_key, spread
from .decontaminate import sized
from .token_counts import encoder, ids_of, vocabulary_key

LENGTH, PER_SHARD, ROUNDS, KEY = 512, 16_384, 6, 0x5EED
#: Rows that repeat more often than this, and than this part of a shard's records, get numbers and so identities.
COPIES = 64
#: A guess that only sets the number of shards: bytes of text to a token.
BYTES_A_TOKEN = 2.5
TRAILER = "<qiib"  # doc_id (0 if null), seq, n_tokens, whether doc_id is null
RAW_FILES = {k: v for k, v in STAGED_AS.items() if k != "compression"}
MANIFEST = "shard int, path string, start long, records long, length int, itemsize int, stride int"
INDEX = "slot long, shard int, record int, doc_id long, seq long, n_tokens long"


def _round(x: np.ndarray, key: int, r: int, half: int) -> np.ndarray:
    h = x ^ np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD6E8FEB86659FD93) % 2**64)
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return (h ^ h >> np.uint64(31)) & np.uint64((1 << half) - 1)


def feistel(x: np.ndarray, n: int, key: int = KEY, back: bool = False) -> np.ndarray:
    """The keyed permutation of 0..n-1, or its inverse, of each x."""
    half = max(1, -(-max(1, (n - 1).bit_length()) // 2))
    mask, by = np.uint64((1 << half) - 1), np.uint64(half)
    x = np.asarray(x).astype(np.uint64)
    todo = np.ones(len(x), bool)
    while todo.any():
        y = x[todo]
        a, b = y >> by, y & mask
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            a, b = (b ^ _round(a, key, r, half), a) if back else (b, a ^ _round(b, key, r, half))
        x[todo] = a << by | b
        todo = x >= np.uint64(n)
    return x.astype(np.int64)


def scattered(x: np.ndarray, key: int = KEY) -> np.ndarray:
    """The keyed permutation of the 64-bit numbers."""
    half, mask = np.uint64(32), np.uint64(2**32 - 1)
    a, b = x >> half, x & mask
    for r in range(ROUNDS):
        a, b = b, a ^ _round(b, key, r, 32)
    return a << half | b


def shard_of(p: np.ndarray, shards: int) -> np.ndarray:
    """Which of the equal parts of the range of 64 bits a number lies in."""
    return ((p >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)


def byte_ids(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)


def bpe_ids(spark: SparkSession, ranks: str, pattern: str):
    """An encoder to ids of a byte-level BPE vocabulary, uint16 where they fit, else uint32."""
    raw = Path(ranks).read_bytes()
    said = spark.sparkContext.broadcast(raw)  # a vocabulary file of fixed size
    most = max(int(x.split()[1]) for x in raw.splitlines() if x)
    kind, key = np.uint16 if most < 2**16 else np.uint32, vocabulary_key(raw, pattern)

    def encode(text: str) -> np.ndarray:
        return np.array(ids_of(encoder(said.value, pattern, key)[0], text), kind)

    return encode


def copies(docs: DataFrame, most: int) -> DataFrame:
    """docs(rk, doc_id, text) -> the same with (first, count): rows that more than ``most`` rows equal are replaced by
    rows that stand for ``count`` copies each, numbered from ``first`` on; any other row stands for itself, number 0.

    Equal rows are told apart by nothing, so one of them and their number say all; the copies' chunks go to many tasks.
    """
    n = docs.groupBy(F.col("rk").alias("rk2")).agg(F.count("*").alias("n")).where(F.col("n") > most)
    n = stage(n, "order-copies")
    if not n.limit(1).count():
        return docs.select("*", F.lit(0).cast("long").alias("first"), F.lit(1).cast("long").alias("count"))
    often = sized(n)
    alone = docs.join(often, F.col("rk") == F.col("rk2"), "left_anti").select("*", F.lit(0).cast("long").alias("first"), F.lit(1).cast("long").alias("count"))
    one = docs.join(often, F.col("rk") == F.col("rk2")).groupBy("rk", "doc_id", "text").agg(F.count("*").alias("n"))
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(most).cast("long")))
    chunks = one.select("rk", "doc_id", "text", "n", first.alias("first"))
    chunks = spread(chunks, "rk", "first").select("rk", "doc_id", "text", "first", F.least(F.lit(most).cast("long"), F.col("n") - F.col("first")).alias("count"))
    return alone.union(chunks)


def sequences(docs: DataFrame, shards: int, length: int, key: int, encode) -> DataFrame:
    """docs(rk, doc_id, text, first, count) -> (shard, at, record): a record without padding for every sequence of every
    copy, trailer first."""

    def made(ids: list[int], loads: list[bytes]) -> pa.RecordBatch:
        p = scattered(np.array(ids, np.uint64), key)
        return pa.RecordBatch.from_arrays([pa.array(shard_of(p, shards)), pa.array(p.view(np.int64)), pa.array(loads, pa.binary())], ["shard", "at", "record"])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 128):
                ids, loads = [], []
                for rk, d, t, first, count in zip(*(c.to_pylist() for c in whole.slice(i, 128).columns), strict=True):
                    v = encode(t) if t else ()
                    own = [struct.pack(TRAILER, d or 0, seq, len(v[k : k + length]), d is None) + v[k : k + length].tobytes() for seq, k in enumerate(range(0, len(v), length))]
                    for copy in range(first, first + count):
                        ids += [(rk + seq * 0x9E3779B97F4A7C15 + copy * 0xD6E8FEB86659FD93) % 2**64 for seq in range(len(own))]
                        loads += own
                        if len(ids) >= 4096:
                            yield made(ids, loads)
                            ids, loads = [], []
                if ids:
                    yield made(ids, loads)

    return docs.transform(arrow_map, f, "shard int, at long, record binary")


def _in_order(size: int, key: int):
    """The records of a shard, which are all rows of a partition -> the same, padded, in the order of their slots."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, loads = [], []
        for b in batches:
            at.append(b.column(1).to_numpy().view(np.uint64))
            loads += b.column(2).to_pylist()
        if not loads:
            return
        ranked = sorted(zip(np.concatenate(at).tolist(), loads, strict=True))
        n, trailer = len(ranked), struct.calcsize(TRAILER)
        order = np.argsort(feistel(np.arange(n), n, key))
        for i in range(0, n, 1024):
            rows = [ranked[k][1] for k in order[i : i + 1024].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[trailer:].ljust(size, b"\0") + x[:trailer] for x in rows], pa.binary())], ["record"])

    return f


def materialise(docs: DataFrame, at: str, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY, encode=byte_ids, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the shards, of ``per_shard`` records or so, and the manifest under ``at``; return the manifest."""
    spark = docs.sparkSession
    ship(spark)
    if not isinstance(docs.schema[doc_id].dataType, T.IntegralType | T.NullType):
        raise TypeError(f"{doc_id} has to be an integer: records hold it in eight bytes")
    some = docs.select(row_key(F.col(doc_id), F.col(text)).alias("rk"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    about = docs.agg(F.sum(F.octet_length(text)).alias("bytes"), F.count_if(F.octet_length(text) > 0).alias("n")).first()
    itemsize = encode("a").itemsize
    size = length * itemsize
    whole = (about["bytes"] or 0) / (BYTES_A_TOKEN if itemsize > 1 else 1) / length
    shards = max(1, round((whole + about["n"] / 2) / per_shard))
    each = copies(some, max(COPIES, per_shard // COPIES))
    dealt = sequences(each, shards, length, key, encode).repartitionById(shards, F.col("shard"))
    # the text writer writes a string's bytes as they are and the separator after each
    raw = dealt.transform(arrow_map, _in_order(size, key), "record binary").select(F.col("record").cast("string").alias("record"))
    raw.write.options(**RAW_FILES, lineSep="\n").text(f"{at}/shards")
    stride = size + struct.calcsize(TRAILER) + 1
    files = spark.read.format("binaryFile").load(f"{at}/shards").select("path", "length") if about["n"] else None
    rows = sorted((_shard(r["path"]), r["path"], r["length"] // stride) for r in files.collect()) if files is not None else []  # a row a shard
    starts = np.r_[0, np.cumsum([r[2] for r in rows])].tolist()
    made = spark.createDataFrame([(k, path, int(s), n, length, itemsize, stride) for (k, path, n), s in zip(rows, starts, strict=False)], MANIFEST)
    made.coalesce(1).write.options(**STAGED_AS).parquet(f"{at}/manifest")
    return manifest(spark, at)


def _shard(path: str) -> int:
    """The number of the partition that wrote a file."""
    return int(path.rpartition("/part-")[2].partition("-")[0])


def manifest(spark: SparkSession, at: str) -> DataFrame:
    """A row for each shard that has records: its file, first slot and number of records; length, itemsize, stride."""
    return spark.read.schema(MANIFEST).parquet(f"{at}/manifest").orderBy("shard")


def locate(shards: list, slot: int) -> tuple[int, int]:
    """(place in the manifest's rows, record) of a slot."""
    k = int(np.searchsorted([r["start"] for r in shards], slot, side="right")) - 1
    return k, slot - shards[k]["start"]


def read_record(file: BinaryIO, record: int, shard) -> tuple[bytes, tuple[int | None, int, int]]:
    """(ids, (doc_id, seq, n_tokens)) of a record of a shard's file, by one seek; shard: its row in the manifest."""
    file.seek(record * shard["stride"])
    return _parsed(file.read(shard["stride"] - 1), shard["length"] * shard["itemsize"])


def _parsed(raw: bytes, size: int) -> tuple[bytes, tuple[int | None, int, int]]:
    d, seq, n, none = struct.unpack_from(TRAILER, raw, size)
    return raw[:size], (None if none else d, seq, n)


def resume(spark: SparkSession, at: str, slot: int = 0, digest: bool = False) -> DataFrame:
    """Records from a slot on: INDEX and payload (digest: payload_sha256). Only the slot's shard and later ones are
    read, each by one task, in order."""
    shards = manifest(spark, at).where(F.col("start") + F.col("records") > slot).collect()  # a row a shard
    last = f"payload{'_sha256 string' if digest else ' binary'}"
    if not shards:
        return spark.createDataFrame([], f"{INDEX}, {last}")
    size, stride = shards[0]["length"] * shards[0]["itemsize"], shards[0]["stride"]
    said = spark.sparkContext.broadcast({r["shard"]: r["start"] for r in shards})  # two numbers for each shard
    files = spark.read.format("binaryFile").load([r["path"] for r in shards]).select("path", "content")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                shard, raw = _shard(path), raw.as_buffer().to_pybytes()
                start = said.value[shard]
                for i in range(max(0, slot - start), len(raw) // stride, 2048):
                    rows = range(i, min(i + 2048, len(raw) // stride))
                    loads, facts = zip(*(_parsed(raw[k * stride : (k + 1) * stride - 1], size) for k in rows), strict=True)
                    ids, seq, n = zip(*facts, strict=True)
                    cols = [pa.array([start + k for k in rows], pa.int64()), pa.array([shard] * len(rows), pa.int32()), pa.array(list(rows), pa.int32()), *(pa.array(x, pa.int64()) for x in (ids, seq, n))]
                    cols.append(pa.array([sha256(x).hexdigest() for x in loads], pa.string()) if digest else pa.array(loads, pa.binary()))
                    yield pa.RecordBatch.from_arrays(cols, ["slot", "shard", "record", "doc_id", "seq", "n_tokens", last.split()[0]])

    return files.transform(arrow_map, f, f"{INDEX}, {last}")


def order_of(docs: DataFrame, encode=byte_ids, length: int = LENGTH, per_shard: int = PER_SHARD) -> DataFrame:
    """Materialise in the shared folder -> slot, shard, record, doc_id, seq, n_tokens, payload_sha256 as read back
    from the shards."""
    at = stage_path(docs.sparkSession, "shards")
    materialise(docs, at, length, per_shard, encode=encode)
    return resume(docs.sparkSession, at, digest=True)
