"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations only.

The index stores a posting (row key, term, position) for each corpus word that any benchmark item uses, and one that
ends each text. A benchmark item is cut into windows of consecutive words. A window's two rarest terms (by postings
over the whole corpus) choose its first lists; shifted by their offsets, the lists meet where the window may start. While
more than LONG places are left, the lists of the third and later terms meet them too; what is left is verified word
by word on the text. `proximity`, which no query uses, lets the two rarest lists meet within a slop instead.

Nothing is capped: a window of frequent words has long lists, which are joined like any other. Tables made from the
benchmark are broadcast only while they are measured to be small, and are shuffled beyond that. Texts have no limit of
length: they are verified in pieces of PIECE words, so that no row gathers the places of a whole text.

Words are the runs of characters outside \\x00-\\x2F, \\x3A-\\x60 and \\x7B-\\x7F once A-Z are lower case; null or empty
texts have none and are clean. Rows are told apart by two 64-bit hashes of doc_id and text, so repeated rows get equal
answers and a repeated or null doc_id does no harm; terms and windows are joined as they are and numbered. Items without words have no window. Items without an
id have windows like any other and count as one item together in n_items; items_sha256 leaves them out. An empty table
of documents gives an empty result, an empty benchmark clean documents. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm._cluster import Scratch, free, own, small

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Ends each text in the index, so that its position is the number of words.
END = "end"
#: Places beyond which another list meets them before texts are read; words of a text that are verified together.
LONG, PIECE = 2_000_000, 1000
KEY = ["key", "key2"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_and_end(text: Column) -> Column:
    """The words of a text and END; an empty string comes first if the text starts with a separator or is empty."""
    return F.split(F.concat(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(" " + END)), SEPARATORS)


def words(text: Column) -> Column:
    w = words_and_end(text)
    return F.slice(F.filter(w, lambda x: x != ""), 1, F.size(F.filter(w, lambda x: x != "")) - 1)


def _keys() -> list[Column]:
    return [F.xxhash64("doc_id", "text"), F.xxhash64(F.lit("key2"), "text", "doc_id")]


class Index:
    """Postings of the corpus for the terms of the benchmark, and the windows of the benchmark."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, window: int = 10):
        if window < 1:
            raise ValueError("window is 1 or more")
        self.window = window
        self.scratch = s = Scratch(docs.sparkSession, "decontaminate")
        self.rows = docs.select("doc_id", "text", *(k.alias(n) for k, n in zip(_keys(), KEY, strict=True)))
        items = benchmark.select("item_id", words(F.col("text")).alias("w")).where("size(w) > 0")
        n = F.least(F.lit(window), F.size("w"))
        starts = items.withColumn("at", F.explode(F.sequence(F.lit(1), F.size("w") - n + 1)))
        cut = s.table(starts.select("item_id", F.slice("w", F.col("at"), n).alias("words")).distinct())
        self.windows = s.table(cut.select("words").distinct().withColumn("wid", F.monotonically_increasing_id()))
        self.items = s.table(cut.join(small(self.windows), "words").select("item_id", "wid"))
        terms = self.windows.select(F.explode("words").alias("term")).distinct()
        end = docs.sparkSession.range(1).select(F.lit(END).alias("term"))
        self.terms = s.table(terms.unionByName(end).distinct().withColumn("tid", F.when(F.col("term") == END, F.lit(-1)).otherwise(F.monotonically_increasing_id())))
        split = self.rows.select(*KEY, words_and_end(F.col("text")).alias("w")).withColumn("skip", (F.col("w")[0] == "").cast("int"))
        tokens = split.select(*KEY, "skip", F.posexplode("w").alias("at", "term"))
        self.postings = s.table(tokens.join(small(self.terms), "term").select(*KEY, "tid", (F.col("at") - F.col("skip")).alias("pos")))
        counts = small(s.table(self.postings.groupBy("tid").agg(F.count("*").alias("df"))))
        each = self.windows.select("wid", F.size("words").alias("size"), F.posexplode("words").alias("off", "term")).join(small(self.terms), "term").join(counts, "tid")
        first = each.groupBy("wid", "size", "tid").agg(F.min("df").alias("df"), F.min("off").alias("off"), F.count("*").alias("n"))
        found = first.groupBy("wid", "size").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "tid", "off"))).alias("rare"))
        # a window with a word that the corpus lacks can't occur
        self.rarest = s.table(found.where("n = size").select("wid", "rare"))

    def counts(self) -> DataFrame:
        """(key, key2, n_words) for each row of the corpus."""
        return self.postings.where("tid = -1").groupBy(*KEY).agg(F.max("pos").cast("long").alias("n_words"))

    def _list(self, k: int) -> DataFrame:
        """(wid, key, key2, start): the postings of each window's k-th rarest term, from 0, shifted by its offset."""
        chosen = self.rarest.where(F.size("rare") > k).select("wid", F.col("rare")[k]["tid"].alias("tid"), F.col("rare")[k]["off"].alias("off"))
        return self.postings.join(small(self.scratch.table(chosen)), "tid").select("wid", *KEY, (F.col("pos") - F.col("off")).alias("start")).where("start >= 0").distinct()

    def exact(self) -> DataFrame:
        """(key, key2, wid, start, n): every occurrence of a window in the corpus."""
        s = self.scratch
        places = None
        for k in range(1, self.window):
            first = self._list(0) if places is None else places
            short = self.rarest.where(F.size("rare") <= k).select("wid")  # a window of as many terms has met all its lists
            met = first.join(self._list(k), ["wid", *KEY, "start"])
            last, places = places, s.table(met.unionByName(first.join(small(s.table(short)), "wid", "left_semi")))
            if last is not None:
                s.drop(last)
            if places.count() <= LONG:
                break
        if places is None:
            places = s.table(self._list(0))
        piece = (F.col("start") / PIECE).cast("long").alias("piece")
        listed = places.join(small(self.windows, 100_000), "wid").groupBy(*KEY, piece).agg(F.collect_list(F.struct("wid", "start", "words")).alias("places"))
        found = small(s.table(places.select(*KEY).distinct()))
        texts = self.rows.join(found, KEY, "left_semi").select(*KEY, "text").dropDuplicates(KEY).withColumn("w", words(F.col("text")))
        pieces = texts.select(*KEY, "w", F.explode(F.sequence(F.lit(0), (F.size("w") / PIECE).cast("long"))).alias("piece"))
        pieces = pieces.select(*KEY, "piece", F.slice("w", (F.col("piece") * PIECE + 1).cast("int"), F.lit(PIECE + self.window)).alias("w"))
        held = F.filter("places", lambda p: F.slice(F.col("w"), (p["start"] - F.col("piece") * PIECE + 1).cast("int"), F.size(p["words"])) == p["words"])
        whole = pieces.join(listed, [*KEY, "piece"])
        return s.table(whole.select(*KEY, F.explode(held).alias("p")).select(*KEY, "p.wid", "p.start", F.size("p.words").alias("n")))

    def proximity(self, slop: int) -> DataFrame:
        """(key, key2, wid, start): places where a window's two rarest terms stand as far apart as in the window, give or take slop words."""
        a, b = self._list(0), self._list(1).withColumnRenamed("start", "start2")
        near = a.join(b, ["wid", *KEY]).where(F.abs(F.col("start") - F.col("start2")) <= slop)
        return near.groupBy(*KEY, "wid").agg(F.min("start").alias("start"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """For each row of docs: doc_id, n_words, n_hit (words inside an occurrence of a window), n_items and items_sha256."""
    index = Index(docs, benchmark, window)
    found = index.exact()
    by = Window.partitionBy(*KEY).orderBy("start", "n")
    before = F.max(F.col("start") + F.col("n")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    places = found.select(*KEY, "start", "n").distinct().withColumn("before", F.coalesce(before, F.lit(0)))
    hit = places.groupBy(*KEY).agg(F.sum(F.greatest(F.lit(0), F.col("start") + F.col("n") - F.greatest("start", "before"))).cast("long").alias("n_hit"))
    items = found.select(*KEY, "wid").distinct().join(small(index.items), "wid").groupBy(*KEY).agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"), F.max(F.col("item_id").isNull().cast("int")).alias("nameless"))
    hits = small(index.scratch.table(hit.join(items, KEY, "left")))
    index.scratch.keep(index.postings, hits)
    facts = index.counts().join(hits, KEY, "left")
    names = F.coalesce("items", F.array().cast("array<string>"))
    return index.rows.select("doc_id", *KEY).join(facts, KEY).select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), (F.size(names) + F.coalesce("nameless", F.lit(0))).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of docs in which no window of a benchmark item occurs."""
    index = Index(docs, benchmark, window)
    names = free(docs, *KEY)
    hit = index.scratch.table(index.exact().select(*(F.col(k).alias(n) for k, n in zip(KEY, names, strict=True))).distinct())
    index.scratch.keep(hit)
    return docs.select("*", *(k.alias(n) for k, n in zip(_keys(), names, strict=True))).join(small(hit), names, "left_anti").select(own(docs))
