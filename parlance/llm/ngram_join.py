"""N-gram Jaccard join by grouped prefixes.

A document is the set of its distinct n-word shingles, each a 64-bit hash. Shingles have one global order: those
seen in many documents come last (a table of bounded size, counted over all documents; any order gives right
results, this one gives few candidates), the rest by hash. Two sets of Jaccard similarity t or more share one of
their first size - ceil(t * size) + 1 shingles, so only those prefixes are joined.

1. Equal sets become one class, whose id is its least doc_id.
2. Classes of one size and one prefix become one group; groups meet in the lists of their prefix shingles.
3. Each list is first compared with one group of each size band (a star, so as many pairs as rows): the one with the
   fewest rarer shingles, which is the text that near copies vary. What these verified links connect needs no further
   comparison: a list of a thousand near copies costs a thousand pairs.
4. Every pair of groups that share a list and are still in different components is filtered by size and position,
   expanded to member classes and verified on whole sets. Lists longer than CELL are met in salted cells of that many
   rows. No pair that could be linked is left out.

Before a pair is verified, the parity sketches of its sets are compared: shingles are dealt to as many bits as the set
has shingles, each of which turns its bit. Sets that differ in k shingles have sketches that differ in k bits at most,
so a pair whose sketches differ in more bits than the similarity allows is no link. What is left is verified star by
star: the text of a centre goes once to every STAR of its partners, each partner's text once, and their whole sets
are compared there.

Shingles are told apart by 64-bit hashes and equal sets by two 64-bit sums over them; up to a chance of collision that
this leaves, the components are exact.

Null or empty texts have no shingles and link with nothing. Rows that share a doc_id count as one node, which has the
links of all their texts; a row whose doc_id is null is returned unlinked. An empty table gives an empty result. Texts
have no limit of length: words are hashed a chunk at a time, and one text with its set is what a task holds at least.
Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import _bytes as B
from parlance.llm._cluster import Scratch, components, one_row_each, own, small, tidy

#: Size of the table of frequent shingles: what each task may report, and what is broadcast (16 bytes an entry).
TASK_FREQUENT, FREQUENT = 1 << 15, 1 << 17
#: Shingles that a task counts at a time.
TALLY = 1 << 22
#: Partners whom the text of a centre reaches at a time; rows of a list that meet all others of it in one cell.
STAR, CELL = 64, 2048

SETS = "doc_id long, n int, sig1 long, sig2 long, token long, seen long"
PREFIXES = "doc_id long, n int, sig1 long, sig2 long, prefix_hash long, prefix array<long>, sketch array<long>"
SKETCH_BITS = 256


def _sets(batch: pa.RecordBatch, words: int):
    """(row, sorted shingles) for each row of a batch with doc_id and text."""
    for first, hashes, offsets in B.batch_words(batch.column(1), B.SPACE):
        for k in range(len(offsets) - 1):
            yield first + k, B.shingles(hashes[offsets[k] : offsets[k + 1]], words)


def _signature(tokens: np.ndarray) -> tuple[int, int]:
    total = tokens.sum(dtype=np.uint64)
    turned = (tokens * np.uint64(0xD6E8FEB86659FD93) ^ (tokens >> np.uint64(29))).sum(dtype=np.uint64)
    return int(total.view(np.int64)), int(turned.view(np.int64))


def _sketch(tokens: np.ndarray) -> np.ndarray:
    """The parity of the shingles of each of 2 ** k bits, at least as many as there are shingles, as 64-bit words."""
    size = max(SKETCH_BITS, 1 << (len(tokens) - 1).bit_length())
    odd = np.bincount((tokens & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _differ(x: Column, y: Column) -> Column:
    """In how many bits two sketches differ, the larger one folded to the size of the other; null where one fold is not enough."""
    size = F.least(F.size(x), F.size(y))
    xor = lambda a, b: a.bitwiseXOR(b)
    fold = lambda v: F.when(F.size(v) == size * 2, F.zip_with(F.slice(v, F.lit(1), size), F.slice(v, size + 1, size), xor)).when(F.size(v) == size, v)
    return F.aggregate(F.zip_with(fold(x), fold(y), lambda a, b: F.bit_count(xor(a, b))), F.lit(0), lambda total, k: total + k)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(flat))


def _describe(words: int):
    def run(batches):
        found: dict[str, list] = {"t": [], "c": []}
        seen, fresh, size = set(), [], 0

        def tally(fresh):
            t, c = np.unique(np.concatenate(fresh), return_counts=True)
            found["t"].append(t[c > 2])
            found["c"].append(c[c > 2])

        for batch in batches:
            n, s1, s2 = (np.zeros(batch.num_rows, t) for t in (np.int32, np.int64, np.int64))
            for row, tokens in _sets(batch, words):
                n[row] = len(tokens)
                if len(tokens):
                    s1[row], s2[row] = key = _signature(tokens)
                    if key not in seen:
                        seen.add(key)
                        fresh.append(tokens)
                        size += len(tokens)
                        if size > TALLY:
                            tally(fresh)
                            seen, fresh, size = set(), [], 0
            no = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(s1), pa.array(s2), no, no], ["doc_id", "n", "sig1", "sig2", "token", "seen"])
        if fresh:
            tally(fresh)
        if found["t"]:
            t, at = np.unique(np.concatenate(found["t"]), return_inverse=True)
            c = np.bincount(at, np.concatenate(found["c"]), len(t)).astype(np.int64)
            top = np.argsort(-c, kind="stable")[:TASK_FREQUENT]
            no = pa.nulls(len(top), pa.int64())
            yield pa.RecordBatch.from_arrays([no, pa.nulls(len(top), pa.int32()), no, no, pa.array(t[top].view(np.int64)), pa.array(c[top])], ["doc_id", "n", "sig1", "sig2", "token", "seen"])

    return run


def _prefixes(words: int, num: int, den: int, frequent):
    def run(batches):
        often, counts = frequent.value
        bits = np.zeros(1 << 20, bool)
        bits[(often >> np.uint64(44)).astype(np.int64)] = True
        for batch in batches:
            keep, n, s1, s2, ph, out, sketches = [], [], [], [], [], [], []
            for row, tokens in _sets(batch, words):
                if not len(tokens):
                    continue
                most = len(tokens) - (num * len(tokens) + den - 1) // den + 1
                maybe = np.flatnonzero(bits[(tokens >> np.uint64(44)).astype(np.int64)])
                if len(maybe) and len(often):
                    at = np.minimum(np.searchsorted(often, tokens[maybe]), len(often) - 1)
                    hit = often[at] == tokens[maybe]
                    maybe, at = maybe[hit], at[hit]
                if len(maybe):
                    rare = np.ones(len(tokens), bool)
                    rare[maybe] = False
                    prefix = tokens[rare][:most]
                    if len(prefix) < most:
                        order = np.lexsort((tokens[maybe], counts[at]))
                        prefix = np.concatenate([prefix, tokens[maybe][order][: most - len(prefix)]])
                else:
                    prefix = tokens[:most]
                keep.append(row)
                n.append(len(tokens))
                ph.append(int(B.mix(prefix * np.uint64(0x9FB21C651E98DF25) + np.arange(len(prefix), dtype=np.uint64)).sum(dtype=np.uint64).view(np.int64)))
                one, two = _signature(tokens)
                s1.append(one)
                s2.append(two)
                out.append(prefix.view(np.int64))
                sketches.append(_sketch(tokens))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep, pa.int64())), pa.array(n, pa.int32()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(ph, pa.int64()), _lists(out), _lists(sketches)],
                ["doc_id", "n", "sig1", "sig2", "prefix_hash", "prefix", "sketch"],
            )

    return run


def _linked(words: int, num: int, den: int):
    """The pairs (a, b) that are similar enough; rows (a, cell, member, id, text) come with the centre of each cell first."""

    def run(batches):
        key, centres = None, []
        for batch in batches:
            a, cell, member, ids = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            left, right = [], []
            for row, tokens in _sets(batch.select([3, 4]), words):
                if (a[row], cell[row]) != key:
                    key, centres = (a[row], cell[row]), []
                if not member[row]:
                    centres.append(tokens)  # more than one where rows share its doc_id
                    continue
                for centre in centres:
                    if len(centre) and len(tokens):
                        at = np.minimum(np.searchsorted(centre, tokens), len(centre) - 1)
                        if np.count_nonzero(centre[at] == tokens) * (num + den) >= (len(centre) + len(tokens)) * num:
                            left.append(a[row])
                            right.append(ids[row])
                            break
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return run


class Join:
    """The join over one table."""

    def __init__(self, docs: DataFrame, words: int = 5, num: int = 80, den: int = 100):
        if words < 1 or not 0 < num <= den:
            raise ValueError("words is 1 or more and num / den in (0, 1]")
        self.spark: SparkSession = docs.sparkSession
        self.words, self.num, self.den = words, num, den
        self.scratch = s = Scratch(self.spark, "ngram_join")
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        described = s.table(self.docs.mapInArrow(tidy(_describe(words)), SETS))
        self.rows = described.where("n is not null").select("doc_id", "n", "sig1", "sig2")
        top = described.where("token is not null").groupBy("token").agg(F.sum("seen").alias("seen")).orderBy(F.desc("seen"), "token").limit(FREQUENT).toArrow()
        token, seen = top["token"].to_numpy().view(np.uint64), top["seen"].to_numpy()
        order = np.argsort(token)
        self.frequent = self.spark.sparkContext.broadcast((token[order], seen[order]))
        self.docs = one_row_each(s, self.docs.where("doc_id is not null"), self.rows)
        equal = self.rows.where("n > 0 and doc_id is not null").groupBy("n", "sig1", "sig2")
        self.classes = s.table(equal.agg(F.min("doc_id").alias("cid"), F.count("*").alias("k")).where("k > 1").drop("k"))

    def _fits(self, a: str, b: str) -> Column:
        """Sizes and positions at a shared shingle that leave the overlap possible."""
        na, nb, pa_, pb = (F.col(f"{s}.{c}").cast("long") for c in ("n", "pos") for s in (a, b))
        need = F.ceil((na + nb) * self.num / F.lit(float(self.num + self.den)) - 1e-9)
        return (na * self.den >= nb * self.num) & (nb * self.den >= na * self.num) & (F.least(na - pa_, nb - pb) >= need)

    def _alike(self, pairs: DataFrame, sketches: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sketches leave a link possible."""
        side = lambda c: sketches.select(F.col("cid").alias(c), F.col("n").cast("long").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}"))
        room = (F.col("n_a") + F.col("n_b")) * (self.den - self.num)
        differ = F.coalesce(_differ(F.col("sketch_a"), F.col("sketch_b")), F.lit(0))
        return pairs.join(side("a"), "a").join(side("b"), "b").where(differ * (self.num + self.den) <= room).select("a", "b").distinct()

    def _verify(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of classes whose whole sets are similar enough; many b may share an a."""
        s = self.scratch
        cells = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).alias("cells"))
        dealt = s.table(pairs.join(cells, "a").select("a", F.pmod(F.xxhash64("b"), F.col("cells")).alias("cell"), F.lit(1).alias("member"), F.col("b").alias("id")))
        wanted = dealt.unionByName(dealt.select("a", "cell", F.lit(0).alias("member"), F.col("a").alias("id")).distinct())
        texts = self.docs.join(small(s.table(wanted)), F.col("doc_id") == F.col("id")).select("a", "cell", "member", "id", "text")
        return s.table(texts.repartition("a", "cell").sortWithinPartitions("a", "cell", "member").mapInArrow(tidy(_linked(self.words, self.num, self.den)), "a long, b long").distinct())

    def components(self) -> DataFrame:
        """(id, component) of the classes that link with another one."""
        s = self.scratch
        more = self.rows.join(small(self.classes), ["n", "sig1", "sig2"]).where("doc_id <> cid").select("doc_id", "sig1", "sig2")
        more = small(s.table(more.distinct()))
        prefixes = self.docs.mapInArrow(tidy(_prefixes(self.words, self.num, self.den, self.frequent)), PREFIXES).join(more, ["doc_id", "sig1", "sig2"], "left_anti")
        prefixes = s.table(prefixes.drop("sig1", "sig2"))
        self.frequent.unpersist()
        groups = prefixes.groupBy("n", "prefix_hash").agg(F.min("doc_id").alias("gid"))
        members = s.table(prefixes.select(F.col("doc_id").alias("cid"), "n", "prefix_hash", "sketch").join(groups, ["n", "prefix_hash"]).select("gid", "cid", "n", "sketch"))
        lists = prefixes.join(members.where("gid = cid").select(F.col("gid").alias("doc_id"), "n"), ["doc_id", "n"], "left_semi").select(F.posexplode("prefix").alias("pos", "token"), F.col("doc_id").alias("gid"), "n")
        shared = lists.groupBy("token").agg(F.count("*").alias("m")).where("m > 1").select("token")
        lists = s.table(lists.join(shared, "token"))
        band = F.floor(F.log(F.col("n").cast("double")) / math.log(self.den / self.num + 1e-12)).cast("int") if self.num < self.den else F.col("n")
        banded = lists.withColumn("band", band)
        heads = banded.groupBy("token", "band").agg(F.min(F.struct("pos", "gid", "n")).alias("h")).select("token", "band", "h.*")
        near = heads.unionByName(heads.withColumn("band", F.col("band") + 1))
        stars = banded.alias("x").join(near.alias("y"), ["token", "band"]).where("x.gid <> y.gid").where(self._fits("x", "y")).select(F.col("y.gid").alias("ga"), F.col("x.gid").alias("gb")).distinct()
        s.drop(prefixes)
        crowded = members.groupBy("gid").agg(F.count("*").alias("m")).where("m > 1").select("gid")
        inner = members.join(crowded, "gid", "left_semi")
        ends = members.select(F.col("gid").alias("gb"), F.col("cid").alias("b"))
        pairs = stars.join(ends, "gb").select(F.col("ga").alias("a"), "b").unionByName(inner.where("gid <> cid").select(F.col("gid").alias("a"), F.col("cid").alias("b")))
        once = pairs.groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.min("a").alias("a"))
        pairs = s.table(self._alike(once.select("a", F.when(F.col("a") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("b")), members))
        links = self._verify(pairs)
        found = s.table(components(s, links))
        # what the stars have not joined
        state = s.table(members.join(found.withColumnRenamed("id", "cid"), "cid", "left").select("gid", "cid", F.coalesce("component", "cid").alias("component")))
        sides = state.groupBy("gid").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
        rest = lists.join(sides, "gid")
        mixed = rest.groupBy("token").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("m")).where("lo <> hi and m > 1")
        mixed = mixed.select("token", F.ceil(F.col("m") / CELL).cast("int").alias("cells"))
        rest = s.table(rest.join(mixed, "token").withColumn("band", band))
        s.drop(lists)
        x = rest.withColumn("cell", F.pmod(F.xxhash64("gid"), F.col("cells")).cast("int")).alias("x")
        both = rest.withColumn("same", F.lit(True)).unionByName(rest.select(*[c for c in rest.columns if c != "band"], (F.col("band") - 1).alias("band"), F.lit(False).alias("same")))
        y = both.withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))).alias("y")
        apart = x.join(y, ["token", "band", "cell"]).where("(x.gid < y.gid or not y.same) and not (x.lo = x.hi and y.lo = y.hi and x.lo = y.lo)").where(self._fits("x", "y"))
        apart = apart.select(F.least("x.gid", "y.gid").alias("ga"), F.greatest("x.gid", "y.gid").alias("gb")).distinct()
        split = sides.where("lo <> hi").select(F.col("gid").alias("ga"), F.col("gid").alias("gb"))
        left = state.select(F.col("gid").alias("ga"), F.col("cid").alias("a"), F.col("component").alias("ca"))
        right = state.select(F.col("gid").alias("gb"), F.col("cid").alias("b"), F.col("component").alias("cb"))
        more = apart.unionByName(split).join(left, "ga").join(right, "gb").where("ca <> cb and a <> b")
        more = more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        done = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        more = s.table(self._alike(more.join(done, ["a", "b"], "left_anti"), members))
        added = self._verify(more)
        star = found.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))
        return s.table(components(s, star.unionByName(added)))

    def members(self) -> DataFrame:
        """(doc_id, n_shingles, class_id, component_id) for every row of the table."""
        s = self.scratch
        found = self.components()
        by = self.classes.join(found, F.col("cid") == F.col("id"), "left").select("n", "sig1", "sig2", "cid", F.coalesce("component", "cid").alias("class_component"))
        by = small(s.table(by))
        s.keep(self.rows, by, found)
        named = self.rows.where("doc_id is not null")
        out = named.join(by, ["n", "sig1", "sig2"], "left").join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left").select(
            "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("cid", "doc_id").alias("class_id"), F.coalesce("class_component", "component", "doc_id").alias("component_id"),
        )
        none = F.lit(None).cast("long")
        return out.unionByName(self.rows.where("doc_id is null").select("doc_id", F.col("n").cast("long").alias("n_shingles"), none.alias("class_id"), none.alias("component_id")))


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Every row of docs by doc_id with the class of its shingle set and its component of linked documents."""
    return Join(docs, words, num, den).members()


def keep_one(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs that are the least doc_id of their component.

    Rows without a doc_id stay; of rows that share one, that whose columns come first as JSON stays.
    """
    join = Join(docs, words, num, den)
    s = join.scratch
    found = s.table(join.members().where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count("*").alias("n")))
    lost = small(s.table(found.where("doc_id <> component_id").select("doc_id")))
    twice = s.table(found.where("doc_id = component_id and n > 1").select("doc_id"))
    s.keep(lost, twice)
    once = docs.join(lost, "doc_id", "left_anti")
    if twice.isEmpty():
        return once.select(own(docs))
    row = F.struct(*own(docs))
    first = docs.join(small(twice), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.to_json(row)).alias("row"))
    first = first.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
    return once.join(small(twice), "doc_id", "left_anti").unionByName(first).select(own(docs))
