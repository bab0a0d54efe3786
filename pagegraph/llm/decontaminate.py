"""Benchmark decontamination with a distributed positional inverted index. DataFrame functions only.

1. Terms of the test items are counted over the whole corpus; each window of an item (``WINDOW`` consecutive
   words, or all of a shorter item) is represented by its ``RAREST`` rarest term positions.
2. The index stores postings (term, row, position) of those terms.
3. A posting at p of a term at item position i lies on the diagonal p - i. Lists of one row, item and
   diagonal are intersected: an aggregation whose groups hold one entry a term position of the item.
   A diagonal survives if all rarest positions of some window are in it.
4. Surviving diagonals are laid on the words of their rows and yield exact phrase matches.

Terms and anchors join by broadcast only up to ``BROADCAST_ROWS`` and ``BROADCAST_BYTES``, both counted, else by
shuffle. Groups are
of one row and item, so no frequent term, passage or item meets in one task.

Edges: null or empty text and texts without words have n_words 0 and no hits; null item text gives no
window; repeated items match under each of their ids, repeated rows are all reported; null item_ids match
but cannot be named, so they count as hits and not as items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .common import LOWER, own_prefix, row_key, UPPER

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # what lies between words, after lower-casing
WINDOW, RAREST, BROADCAST_ROWS, BROADCAST_BYTES = 10, 2, 500_000, 64 << 20


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z; pure ASCII text takes the short way."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def words(text: Column) -> Column:
    """Words in order. Splitting at what lies between them is several times faster than matching them."""
    return F.coalesce(F.array_remove(F.split(lower_ascii(text), BETWEEN), ""), F.array().cast("array<string>"))


def sized(df: DataFrame) -> DataFrame:
    """Broadcast a staged table if its rows and bytes are counted small, leave the choice of join to the planner if not."""
    if df.count() > BROADCAST_ROWS:
        return df
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def item_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, ipos, term, n): a row for each word of each item; equal texts are one item."""
    one = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    one = one.select(F.xxhash64("w").alias("item"), "w").dropDuplicates(["item", "w"])
    return one.select("item", F.size("w").alias("n"), F.posexplode("w").alias("ipos", "term"))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The index: (term, rk, pos) of the given terms; docs(rk, text)."""
    every = docs.select("rk", F.posexplode(words(F.col("text"))).alias("pos", "t"))
    return every.join(terms.select(F.col("term")), F.col("t") == F.col("term")).select("term", "rk", "pos")


def anchors(docs: DataFrame, terms: DataFrame, window: int = WINDOW, rarest: int = RAREST) -> DataFrame:
    """(item, start, len, ipos, term): the rarest positions of every window; terms: a staged table."""
    n = terms.count()
    vocab = sized(stage(terms.select("term").distinct(), "decon-vocab", n))
    seen = docs.select(F.explode(words(F.col("text"))).alias("t")).join(vocab, F.col("t") == F.col("term"), "left_semi").groupBy("t").count()
    seen = stage(seen, "decon-counts", n)
    size = F.least(F.lit(window), F.col("n"))
    each = terms.join(seen, F.col("term") == F.col("t"), "left").select("item", "ipos", "term", size.alias("len"), F.coalesce("count", F.lit(0)).alias("c"), F.explode(F.sequence(F.greatest(F.lit(0), F.col("ipos") - size + 1), F.least(F.col("ipos"), F.col("n") - size))).alias("start"))
    rank = F.row_number().over(Window.partitionBy("item", "start").orderBy("c", "ipos"))
    return each.withColumn("r", rank).where(F.col("r") <= rarest).select("item", "start", "len", "ipos", "term")


def phrase_rows(docs: DataFrame, items: DataFrame, window: int = WINDOW, rarest: int = RAREST, all_rows: bool = True) -> DataFrame:
    """docs(rk, ...), items(item_id, text) -> docs' columns, n_words and hits: array of (start, len, item).

    A hit says that the words from ``start`` on are a window of the item. all_rows: also those without candidates.
    """
    terms = stage(item_terms(items), "decon-terms", of=items)
    some = docs.select("rk", "text")
    marks = stage(anchors(some, terms, window, rarest), "decon-anchors", rarest * terms.count())
    n = marks.count()
    index = stage(postings(some, sized(stage(marks.select("term").distinct(), "decon-rare", n))), "decon-index", of=docs)
    at = sized(stage(marks.select("term", "item", "ipos").distinct(), "decon-places", n))
    lists = index.join(at, "term").groupBy("rk", "item", (F.col("pos") - F.col("ipos")).alias("diag")).agg(F.collect_set("ipos").alias("have"))
    need = marks.groupBy("item", "start").agg(F.collect_set("ipos").alias("need"))
    need = sized(stage(need.groupBy("item").agg(F.collect_set("need").alias("needs")), "decon-needs", n))
    met = lists.join(need, "item").where(F.exists("needs", lambda x: F.size(F.array_except(x, "have")) == 0))
    body = sized(stage(terms.groupBy("item").agg(F.transform(F.array_sort(F.collect_list(F.struct("ipos", "term"))), lambda x: x["term"]).alias("iw")), "decon-items", terms.count()))
    met = met.select("rk", "item", "diag").join(body, "item").groupBy(F.col("rk").alias("rk2")).agg(F.collect_list(F.struct("item", "diag", "iw")).alias("met"))
    met = stage(met, "decon-met", of=docs)
    own_n = f"{own_prefix(docs)}n"
    both = docs.withColumn(own_n, F.size(words(F.col("text"))).cast("long")).join(met, F.col("rk") == F.col("rk2"), "left" if all_rows else "inner")

    def starts(c: Column, text: Column) -> Column:
        size = F.least(F.lit(window), F.size(c["iw"]))
        none = F.struct(F.lit(0).alias("run"), F.array().cast("array<int>").alias("at"))

        def step(acc: Column, i: Column) -> Column:
            run = F.when(F.get(text, c["diag"] + i).eqNullSafe(F.get(c["iw"], i)), acc["run"] + 1).otherwise(0)
            found = F.when(run >= size, F.array_append(acc["at"], (c["diag"] + i - size + 1).cast("int"))).otherwise(acc["at"])
            return F.struct(run.alias("run"), found.alias("at"))

        runs = F.aggregate(F.sequence(F.lit(0), F.size(c["iw"]) - 1), none, step)["at"]
        return F.transform(runs, lambda s: F.struct(s.alias("start"), size.alias("len"), c["item"].alias("item")))

    # words again, of rows with candidates only, so that no join carries them; an array of one binds them to a name
    laid = F.transform(F.array(words(F.col("text"))), lambda w: F.flatten(F.transform("met", lambda c: starts(c, w))))
    hits = F.when(F.col("met").isNotNull(), F.get(laid, F.lit(0)))
    return both.select(*docs.columns, F.col(own_n).alias("n_words"), hits.alias("hits"))


def covered(hits: Column) -> Column:
    """Words covered by the union of spans (start, len, ...)."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, h: Column) -> Column:
        end = h["start"] + h["len"]
        more = F.greatest(F.lit(0), end - F.greatest(acc["end"], h["start"]))
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + more).alias("n"))

    return F.coalesce(F.aggregate(F.array_sort(hits), zero, step)["n"], F.lit(0).cast("long"))


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs(doc_id, text)."""
    items = items.select(F.col("item_id"), F.col("text"))
    some = docs.select(F.col("doc_id"), F.col("text"), row_key(F.col("doc_id"), F.col("text")).alias("rk"))
    rows = phrase_rows(some, items, window).drop("text")
    rows = stage(rows, "decon-rows", of=docs)
    ids = items.select("item_id", words(F.col("text")).alias("w")).where("size(w) > 0 and item_id is not null")
    ids = sized(stage(ids.select(F.xxhash64("w").alias("item"), F.col("item_id").cast("string").alias("id")).distinct(), "decon-ids", items.count()))
    named = rows.where("size(hits) > 0").select("rk", F.explode(F.array_distinct(F.transform("hits", lambda h: h["item"]))).alias("item")).join(ids, "item")
    named = named.groupBy(F.col("rk").alias("rk2")).agg(F.array_sort(F.collect_set("id")).alias("names"))
    out = rows.join(named, F.col("rk") == F.col("rk2"), "left")
    n_hit = covered(F.col("hits"))
    names = F.coalesce("names", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def keep_clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs in which no window of an item occurs, with the columns of docs."""
    key = row_key(F.col(doc_id), F.col(text))
    hit = phrase_rows(docs.select(key.alias("rk"), F.col(text).alias("text")), items.select("item_id", "text"), all_rows=False).where("size(hits) > 0")
    own = own_prefix(docs)
    hit = stage(hit.select(F.col("rk").alias(f"{own}hit")).distinct(), "decon-hit", of=docs)
    return docs.withColumn(f"{own}rk", key).join(hit, F.col(f"{own}rk") == F.col(f"{own}hit"), "left_anti").select(*docs.columns)


def proximity(docs: DataFrame, queries: DataFrame, span: int = 20) -> DataFrame:
    """docs(doc_id, text), queries(query_id, text) -> (doc_id, query_id, pos): positions of a query's rarest
    term from which all of its distinct terms are found at most ``span`` words away."""
    some = docs.select("doc_id", "text", row_key(F.col("doc_id"), F.col("text")).alias("rk"))
    terms = stage(queries.select("query_id", F.explode(F.array_distinct(words(F.col("text")))).alias("term")).distinct(), "near-terms")
    index = stage(postings(some, sized(stage(terms.select("term").distinct(), "near-vocab"))), "near-index")
    seen = index.groupBy("term").count()
    rare = terms.join(seen, "term", "left").groupBy("query_id").agg(F.min(F.struct(F.coalesce("count", F.lit(0)), "term"))["term"].alias("rare"), F.count("*").alias("n"))
    at = index.join(sized(stage(terms.join(rare, "query_id"), "near-rare")), "term")
    near = Window.partitionBy("rk", "query_id").orderBy("pos").rangeBetween(-span, span)
    hit = at.withColumn("got", F.size(F.collect_set("term").over(near))).where("term = rare and got = n").select(F.col("rk").alias("rk2"), "query_id", "pos")
    return some.select("doc_id", "rk").distinct().join(hit, F.col("rk") == F.col("rk2")).select("doc_id", "query_id", "pos")
