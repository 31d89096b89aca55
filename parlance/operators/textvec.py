"""Vectors of texts: TF-IDF weights under a sparse random projection.

A term of MIN_DF documents or more weighs (1 + ln tf) * (1 + ln((1 + n) / (1 + df))) and is added, with a sign, to EACH of DIMS
components that md5 of the term draws, so that inner products of vectors, scaled to length 1, estimate the cosines of the
TF-IDF vectors. The texts of an index are summed shard by shard, which get the weights of their own terms; other texts by their terms: The projection is drawn once a term of the vocabulary, not once an occurrence. Postings meet their terms by a
shuffle; the terms of very many documents, whose number the count of all postings bounds, are broadcast, so that no word is a hot key.
Texts without a known term have no vector.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.functions.dialect import SPARK
from parlance.session import ship

DIMS, EACH, MIN_DF = 64, 4, 2
#: Documents from which a term counts as frequent, and how many such terms there can be at most.
HOT, MOST_HOT = 10_000, 100_000


def drawn(d, term: str, k: str) -> tuple[str, str]:
    """(component, sign times 1 / sqrt(EACH)) of a term's k-th draw, in a dialect."""
    h = d.hex32(f"concat({term}, '-', {d.text(k)})")
    return f"({h}) % {DIMS}", f"CASE WHEN ({h}) % {2 * DIMS} < {DIMS} THEN {EACH**-0.5} ELSE {-(EACH**-0.5)} END"


def _sums(counts: DataFrame, terms: DataFrame, n: int) -> DataFrame:
    at, x = drawn(SPARK, "term", "k")
    idf = F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1
    known = terms.where(F.col("df") >= MIN_DF).select("term", "df", idf.alias("idf"), F.expr(f"transform(sequence(0, {EACH - 1}), k -> struct({at} AS dim, {x} AS x))").alias("draws"))
    least = max(HOT, counts.count() // MOST_HOT)
    rows = counts.select("id", "term", "tf")
    frequent = F.broadcast(known.where(F.col("df") > least))
    met = rows.join(frequent, "term").unionByName(rows.join(F.broadcast(known.where(F.col("df") > least).select("term")), "term", "left_anti").join(known.where(F.col("df") <= least), "term"))
    weight = (1 + F.log(F.col("tf").cast("double"))) * F.col("idf")
    sums = met.select("id", weight.alias("w"), F.explode("draws").alias("p")).groupBy("id", F.col("p.dim").cast("int").alias("dim")).agg(F.sum(F.col("w") * F.col("p.x")).alias("x"))
    return sums.groupBy("id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("length"), F.collect_list(F.struct("dim", "x")).alias("parts")).where("length > 0")  # DIMS parts at most


def projected(counts: DataFrame, terms: DataFrame, n: int) -> DataFrame:
    """(id, dim, x): components other than zero of the texts of counts(id, term, tf) by terms(term, df) of n documents; of length 1 a text."""
    return _sums(counts, terms, n).select("id", "length", F.explode("parts").alias("p")).select("id", F.col("p.dim").alias("dim"), (F.col("p.x") / F.col("length")).alias("x"))


def vectors(counts: DataFrame, terms: DataFrame, n: int) -> DataFrame:
    """(id, embedding) of the texts of counts, DIMS components each."""
    parts = _sums(counts, terms, n).select("id", "length", F.map_from_entries("parts").alias("m"))
    return parts.select("id", F.transform(F.sequence(F.lit(0), F.lit(DIMS - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.col("length")).alias("embedding"))


def _summed(shard: pa.Table, known: pa.Table) -> pa.Table:
    ids = shard.column("ids").combine_chunks()
    at = pc.fill_null(pc.index_in(shard.column("term"), value_set=known.column("name").combine_chunks()), -1).to_numpy()
    term = np.repeat(at, pc.list_value_length(ids).to_numpy())
    names, doc = np.unique(ids.flatten().to_numpy(), return_inverse=True)
    tf = shard.column("tfs").combine_chunks().flatten().to_numpy()
    have = term >= 0
    term, doc, w = term[have], doc[have], 1.0 + np.log(tf[have])
    x = np.zeros(len(names) * DIMS)
    if len(term):
        w = w * known.column("idf").to_numpy()[term]
        drawn_ = known.column("draws").combine_chunks().flatten().to_numpy().reshape(-1, EACH)
        for k in range(EACH):
            d = drawn_[term, k]
            x += np.bincount(doc * DIMS + d % DIMS, weights=np.where(d < DIMS, w, -w) * EACH**-0.5, minlength=len(x))
    x = x.reshape(-1, DIMS)
    length = np.sqrt((x * x).sum(1))
    names, x = names[length > 0], (x[length > 0] / length[length > 0, None]).ravel()
    return pa.table({"id": names, "embedding": pa.ListArray.from_arrays(np.arange(len(names) + 1, dtype=np.int32) * DIMS, pa.array(x))})


def of_index(inverted: DataFrame, terms: DataFrame, n: int) -> DataFrame:
    """(id, embedding) of the documents of inverted(shard, term, block, ids, tfs), each in one shard. A shard gets its own terms' weights and draws, so a posting moves once and a term once a shard."""
    ship(inverted.sparkSession)
    at, _ = drawn(SPARK, "term", "k")
    draw = at.removesuffix(f"% {DIMS}") + f"% {2 * DIMS}"  # the component, and DIMS more where the sign is minus
    known = terms.where(F.col("df") >= MIN_DF).select("term", (F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1).alias("idf"), F.expr(f"transform(sequence(0, {EACH - 1}), k -> CAST({draw} AS INT))").alias("draws"))
    own = inverted.where("block = 0").select(F.col("shard").alias("part"), F.col("term").alias("name")).join(known.withColumnRenamed("term", "name"), "name").select("part", "name", "idf", "draws")
    return inverted.select("shard", "term", "ids", "tfs").groupBy("shard").cogroup(own.groupBy("part")).applyInArrow(_summed, "id long, embedding array<double>")


def counted(texts: DataFrame) -> DataFrame:
    """(id, term, tf) of texts(id, text)."""
    rows = texts.toDF("id", "text").where("id is not null").select(F.col("id").cast("long").alias("id"), F.explode(F.expr(T.terms(SPARK, "text"))).alias("term"))
    return rows.groupBy("id", "term").agg(F.count("*").alias("tf"))
