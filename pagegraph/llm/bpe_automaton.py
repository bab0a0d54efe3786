"""BPE by a tokenization automaton.

The automaton reads tokens; its paths are just the token sequences that byte-pair encoding gives. It is
compiled merge by merge. At first one state has an arc back to itself for each symbol. The gadget of merge
(u, v), at time m: let p be the state that u leads to, where p has an arc v. u now leads to a copy of p
without the arc v, and wherever an arc u leaves, an arc uv is added that goes where v leads at that time.
All arcs with one label lead to one state, so a state is known by the label that led to it, and there are as many
states as tokens, and the start. The transition table is compiled once, as arrays of differences: ``cut[u, v] = m`` says
that from time m on the state behind u lacks v; a state inherits what the state behind its right part lacked before the
token was made, and an arc uv leaves where an arc u did when it was made. An entry of the table is found by these
two chains of parts, a few steps, and rows of the table that a text needs are then kept as they are.

Encoding reads a word from left to right. All its prefixes have one path each, so at every place just one token ends
the path: of the labels that end there, the one whose arc leaves the state in which the path of the prefix before it
ended. Each place is settled by table steps once and for all; nothing is tried again. Decoding emits the labels of
the arcs.

``text`` null or empty: no tokens, empty decoded text. Words of any length are encoded whole; words up to
``WORD_CACHE`` characters are kept in a table of bounded size. Repeated rows give repeated rows.
"""

from __future__ import annotations

import json
import unicodedata
from hashlib import md5, sha256
from operator import itemgetter
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .common import arrow_map

CACHED_WORDS, WORD_CACHE, CACHED_ARCS, HEAD = 160_000, 48, 300_000, 5
SHORT = (2, 1)
SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_KEPT: dict[str, "Tokenizer"] = {}


def byte_symbols() -> list[str]:
    """A printable character for each byte: itself if printable Latin-1, else the next one from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    shift = iter(range(256, 512))
    return [chr(b if b in plain else next(shift)) for b in range(256)]


class Automaton:
    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self.suffix = suffix
        self.labels = [""] * (max(vocab.values(), default=-1) + 1)
        for t, i in vocab.items():
            self.labels[i] = t
        n = len(self.labels)
        self.left, self.right, self.made = [-1] * n, [-1] * n, [0] * n
        self.cut: dict[int, int] = {}
        self.arcs: dict[int, bool] = {}
        made = {u + v for u, v in merges}
        live = {t: i for t, i in vocab.items() if t not in made}
        for m, (u, v) in enumerate(merges, 1):
            if u not in live or v not in live:
                continue  # a part that is never made: the merge never applies
            a, b = live[u], live[v]
            if not self._walk(a, b):
                continue  # the state behind u lacks v already
            if u + v in live:
                raise ValueError(f"two merges make {u + v!r}; a label must have one history")
            self.cut[a << 24 | b] = m
            uv = vocab[u + v]
            self.left[uv], self.right[uv], self.made[uv] = a, b, m
            live[u + v] = uv
        self.live = live
        ends: dict[str, set[int]] = {}
        for t in live:
            if len(t) > 2:
                ends.setdefault(t[-3:], set()).add(len(t))
        #: Sizes of the labels that end with three symbols, the longest first; shorter labels are tried besides.
        self.ends = {k: (*sorted(v, reverse=True), 2, 1) for k, v in ends.items()}
        self.starts: dict[str, tuple] = {}  # paths of the prefixes of HEAD symbols, kept like arcs

    def _walk(self, s: int, t: int) -> bool:
        """Whether the state behind token s has an arc t."""
        cut, left, right, made = self.cut, self.left, self.right, self.made
        until_s = 1 << 60
        while s >= 0:
            b, until_t = t, 1 << 60
            while b >= 0:
                m = cut.get(s << 24 | b)
                if m is not None and m < until_s and m <= until_t:
                    return False
                until_t, b = made[b], left[b]
            until_s, s = made[s], right[s]
        return True

    def has_arc(self, s: int, t: int) -> bool:
        key = s << 24 | t
        on = self.arcs.get(key)
        if on is None:
            if len(self.arcs) >= CACHED_ARCS:
                self.arcs.clear()
            on = self.arcs[key] = self._walk(s, t)
        return on

    def _settle(self, x: str, extra: int, begin: int, stop: int, last: list[int], sizes: list[int]) -> None:
        """Append, for each place from begin to stop, the one token that ends the path there (-1: none) and its size.

        ``extra`` symbols at the end of x belong to the last place's label.
        """
        get, ends, arcs, has_arc = self.live.get, self.ends.get, self.arcs.get, self.has_arc
        for j in range(begin, stop + 1):
            end = j + extra
            for size in ends(x[end - 3 : end], SHORT) if end > 2 else SHORT:
                i = end - size
                if i < 0 or i >= j:
                    continue
                t = get(x[i:end])
                if t is None:
                    continue
                if i:
                    s = last[i]
                    if s < 0:
                        continue
                    on = arcs(s << 24 | t)
                    if not (has_arc(s, t) if on is None else on):
                        continue
                last.append(t)
                sizes.append(j - i)
                break
            else:
                last.append(-1)
                sizes.append(0)

    def encode(self, word: str) -> list[int]:
        """Token ids of one pre-split word, given in byte symbols; the last symbol bears the suffix."""
        n, extra = len(word), len(self.suffix)
        if not n:
            return []
        whole = word + self.suffix
        t = self.live.get(whole)
        if t is not None:
            return [t]  # an arc from the start spans the word: its one path
        last, sizes, begin = [-1], [0], 1
        if n > HEAD:
            head = self.starts.get(word[:HEAD])
            if head is None:
                self._settle(word, 0, 1, HEAD, last, sizes)
                if len(self.starts) >= CACHED_ARCS // 3:
                    self.starts.clear()
                self.starts[word[:HEAD]] = last[:], sizes[:]
            else:
                last, sizes = head[0][:], head[1][:]
            begin = HEAD + 1
        self._settle(word, 0, begin, n - 1, last, sizes)
        self._settle(whole, extra, n, n, last, sizes)
        if last[n] < 0:
            raise ValueError(f"no path for {word!r}: a symbol is not in the vocabulary")
        out, j = [], n
        while j:
            out.append(last[j])
            j -= sizes[j]
        return out[::-1]

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.labels.__getitem__, ids))


def _nfc(s: str) -> str:
    return s if s.isascii() else unicodedata.normalize("NFC", s)


def _lower(s: str) -> str:
    """Letter by letter: no other form of a sigma at the end of a word."""
    return (s.replace("Σ", "σ") if "Σ" in s else s).lower()


def _normalizers(spec: dict | None) -> list:
    """Functions of text for a normalizer of the file; a kind that isn't known is an error, not a guess."""
    if spec is None:
        return []
    if spec["type"] == "Sequence":
        return [f for x in spec["normalizers"] for f in _normalizers(x)]
    if spec["type"] == "Replace" and spec["pattern"] == {"Regex": "\\s+"} and spec["content"] == " ":
        return []  # white space only parts pieces: which one doesn't matter
    known = {"NFC": _nfc, "Lowercase": _lower}
    if spec["type"] not in known:
        raise ValueError(f"no such normalizer: {spec['type']}")
    return [known[spec["type"]]]


class _Pieces(dict):
    """Pre-split word -> (its ids as text, the labels of its arcs as text).

    Of bounded size, in two generations: what was not asked for while one filled up is forgotten.
    """

    def __init__(self, automaton: Automaton, symbols: list[str]):
        self.automaton, self.symbols, self.older = automaton, symbols, {}

    def __missing__(self, p: str) -> tuple[str, str]:
        entry = self.older.get(p)
        if entry is None:
            a = self.automaton
            plain = p.isascii() and p.isprintable()  # such bytes are their own symbols
            ids = a.encode(p if plain else "".join(map(self.symbols.__getitem__, p.encode("utf-8"))))
            entry = (" ".join(map(str, ids)), a.decode(ids))
        if len(p) <= WORD_CACHE:
            if len(self) >= CACHED_WORDS:
                self.older = dict(self)
                self.clear()
            self[p] = entry
        return entry

    def forget(self) -> None:
        """Give the memory back: the worker goes on to other tasks."""
        self.clear()
        self.older = {}


class Tokenizer:
    """What the JSON file of a word-level BPE tokenizer says: added tokens, NFC, lower case, split, merges."""

    def __init__(self, spec: str):
        j = json.loads(spec)
        m = j["model"]
        merges = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in m["merges"]]
        self.automaton = Automaton(m["vocab"], merges, m.get("end_of_word_suffix") or "")
        self.added = {t["content"]: t["id"] for t in j["added_tokens"]}
        a = self.automaton
        a.labels += [""] * (max([len(a.labels) - 1, *self.added.values()]) + 1 - len(a.labels))
        for t, i in self.added.items():
            a.labels[i] = t
        self.steps = _normalizers(j.get("normalizer"))
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        pieces = j["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(pieces.replace("\\s", SPACE))
        self.pieces = _Pieces(a, byte_symbols())

    def entries(self, text: str) -> list[tuple[str, str]]:
        """(ids, labels) as text of each piece, in order."""
        out: list[tuple[str, str]] = []
        for k, part in enumerate(self.special.split(text) if self.special else [text]):
            if k % 2:
                out.append((str(self.added[part]), part))
                continue
            for step in self.steps:
                part = step(part)
            out += map(self.pieces.__getitem__, self.split.findall(part))
        return out

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for e in self.entries(text or "") for i in e[0].split(" ")]

    def digests(self, text: str | None, with_ids: bool = True) -> tuple:
        """Number of tokens, hashes of the ids and of the decoded text, and the ids (None if not asked for)."""
        found = self.entries(text or "")
        said, decoded = " ".join(map(itemgetter(0), found)), " ".join(map(itemgetter(1), found))
        ids = list(map(int, said.split())) if with_ids else None
        return said.count(" ") + 1 if found else 0, sha256(said.encode()).hexdigest(), sha256(decoded.encode()).hexdigest(), ids


def tokenizer(spec: str) -> Tokenizer:
    """The compiled tokenizer of a worker, compiled once."""
    key = md5(spec.encode()).hexdigest()
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Tokenizer(spec)
    return _KEPT[key]


def encode(docs: DataFrame, path: str, text: str = "text", with_ids: bool = True, prefix: str = "") -> DataFrame:
    """All columns of docs and n_tokens, ids_sha256, decoded_sha256 and (with_ids) ids, named with ``prefix``.

    The tokenizer file, of fixed size, is read here and broadcast.
    """
    spark = docs.sparkSession
    ship(spark)
    spec = spark.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields])
    for name, kind in (("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType()), *((("ids", T.ArrayType(T.IntegerType())),) if with_ids else ())):
        schema = schema.add(prefix + name, kind)
    names = schema.names

    def f(batches):
        tok = tokenizer(spec.value)
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                b = whole.slice(i, 256)
                n, ids_hex, text_hex, ids = zip(*[tok.digests(t, with_ids) for t in b.column(at).to_pylist()], strict=True)
                more = [pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())]
                yield pa.RecordBatch.from_arrays([*b.columns, *more, *([pa.array(ids, pa.list_(pa.int32()))] if with_ids else [])], names)
        tok.pieces.forget()

    return docs.transform(arrow_map, f, schema)


def digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    some = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return encode(some, path, with_ids=False).drop("text")
