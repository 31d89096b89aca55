"""Sharding by balanced label propagation, in DataFrame operations only.

Documents with equal texts are linked. Every document starts in a shard given by a hash. Sets of more than 1 / HEAVY of
a quota, of which there are a few for each shard at most, settle first: one after another from the largest on, each in
the shard with room where most of its members are. In each round after that, every smaller set of linked documents that is not yet together proposes to move to the shard where most of its members are, among the
shards with room for all of it; a shard takes proposals in order of size until its quota of rows is full, and what
it takes has settled. Proposals that meet a full shard try again with the room that is left. Sets larger than a
quota are first split into blocks of a quota each, which settle as sets do. Documents without links have no cut edges
to mind: they and what is left after the last round fill the shards up to sizes that are at most one row apart. The
rows of a set that is left follow each other there, at every size of input.

No shard's rows meet in one task: acceptance sums demand in a histogram of some 16,000 classes of size and hash a shard, and ranks (slots
within a shard, places of the fillers) add the rank within one of many hash buckets to the sizes of those before it.

Null texts are linked with each other but not with empty ones; rows that repeat, doc_id included, are rows of
their own. A null doc_id is a row like any other. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm._cluster import Scratch, small

ROUNDS, BUCKET_ROWS, HEAVY = 6, 20_000, 16


def ranked(df: DataFrame, by: list[str], order: list[str], name: str, rows: int) -> DataFrame:
    """df with a gapless 0-based rank within each group, however large: by hash bucket first, then by order within it."""
    buckets = max(1, -(-rows // BUCKET_ROWS))
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sizes = df.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*by, "_bucket").orderBy(*order)
    out = df.withColumn("_rank", F.row_number().over(within) - 1)
    keys = [*by, "_bucket"]
    return out.join(offsets, keys).withColumn(name, (F.col("_before") + F.col("_rank")).cast("long")).drop("_bucket", "_before", "_rank")


def ranked_sets(df: DataFrame, name: str, rows: int) -> DataFrame:
    """df with a gapless 0-based rank in which the rows of a set follow each other; sets of more than BUCKET_ROWS rows have buckets of their own."""
    buckets = max(1, -(-rows // BUCKET_ROWS))
    many = df.groupBy("set").agg(F.count("*").alias("_n")).where(F.col("_n") > BUCKET_ROWS).select("set", F.ceil(F.col("_n") / BUCKET_ROWS).alias("_parts"))
    own = F.col("_parts").isNotNull()
    df = df.join(F.broadcast(many), "set", "left").withColumns({  # many has 1 / BUCKET_ROWS of the rows at most
        "_own": F.when(own, F.col("set")).otherwise(F.lit("")), "_bucket": F.when(own, F.pmod(F.xxhash64("row"), F.col("_parts"))).otherwise(F.pmod(F.xxhash64("set"), F.lit(buckets))), "_all": F.lit(0),
    }).drop("_parts")
    keys = ["_own", "_bucket"]
    before = Window.partitionBy("_all").orderBy(F.desc("_own"), "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = df.groupBy("_all", *keys).agg(F.count("*").alias("_n")).select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    out = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("set", "row")) - 1).join(offsets, keys)
    return out.withColumn(name, (F.col("_before") + F.col("_rank")).cast("long")).drop(*keys, "_all", "_before", "_rank")


def _heavy(nodes: DataFrame, room: list[int]) -> list[tuple[int, int]]:
    """(hub, shard) of the sets of more than 1 / HEAVY of a quota, the largest first; takes their rows off room."""
    shards, quota = len(room), max(room)
    heavy = nodes.groupBy("hub").agg(F.count("*").alias("n")).where(F.col("n") * HEAVY > quota)
    votes: dict[tuple[int, int], dict[int, int]] = {}
    for r in nodes.join(F.broadcast(heavy), "hub").groupBy("hub", "n", "shard").agg(F.count("*").alias("votes")).collect():
        votes.setdefault((-r["n"], r["hub"]), {})[r["shard"]] = r["votes"]
    out = []
    for (less, hub), of in sorted(votes.items()):
        fits = [k for k in range(shards) if room[k] >= -less]
        if fits:
            home = max(fits, key=lambda k: (of.get(k, 0), room[k], -k))
            room[home] += less
            out.append((hub, home))
    return out


def _pick(values: list[int], shard: Column) -> Column:
    return F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in values]), (shard + 1).cast("int"))


def assign(docs: DataFrame, shards: int = 40, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for each row of docs; shards have sizes at most one row apart."""
    s = Scratch(docs.sparkSession, "sharding")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.when(F.col("text").isNull(), F.lit("null")).otherwise(F.md5("text")).alias("set"),
    ).withColumn("row", F.monotonically_increasing_id())
    rows = s.table(rows)
    total = rows.count()
    quota, extra = divmod(total, shards)
    targets = [quota + (k < extra) for k in range(shards)]
    linked = s.table(rows.groupBy("set").agg(F.count("*").alias("n")).where("n > 1"))
    label = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")
    nodes = rows.select("row", "set").join(small(linked, 100_000), "set").withColumn("shard", label)
    large = nodes.where(F.col("n") > max(quota, 1))
    block = (F.col("place") / F.lit(max(quota, 1))).cast("long")
    split = ranked(large, ["set"], ["row"], "place", total).withColumn("block", block).drop("place")
    nodes = s.table(nodes.where(F.col("n") <= max(quota, 1)).withColumn("block", F.lit(0).cast("long")).unionByName(split).select("row", F.xxhash64("set", "block").alias("hub"), "shard"))
    settled = None
    room = [quota] * shards
    first = _heavy(nodes, room) if quota and rounds else []
    if first:
        each = F.explode(F.array(*[F.struct(F.lit(hub).cast("long").alias("hub"), F.lit(home).cast("int").alias("home")) for hub, home in first])).alias("x")
        settled = s.table(docs.sparkSession.range(1).select(each).select("x.*"))
    for _ in range(rounds if quota else 0):
        open_nodes = nodes if settled is None else nodes.join(settled, "hub", "left_anti")
        votes = open_nodes.groupBy("hub", "shard").agg(F.count("*").alias("votes"))
        sizes = Window.partitionBy("hub")
        choice = votes.withColumns({"n": F.sum("votes").over(sizes), "room": _pick(room, F.col("shard"))})
        # a set without a member in a shard with room for it looks further along the ring of shards
        hop = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda k: F.when(F.element_at(F.array(*map(F.lit, room)), (F.pmod(F.col("hub") + k, F.lit(shards)) + 1).cast("int")) >= F.col("n"), F.lit(shards) - k)))
        best = choice.groupBy("hub", "n").agg(F.max(F.when(F.col("room") >= F.col("n"), F.struct("votes", F.xxhash64("hub", "shard").alias("tie"), "shard"))).alias("top"))
        target = F.coalesce(F.col("top.shard"), F.pmod(F.col("hub") + (F.lit(shards) - hop), F.lit(shards)).cast("int"))
        wish = best.select("hub", "n", target.alias("to")).where("to is not null")
        # larger sets first: by the logarithm of their size, and by hash among those alike
        scale = F.lit(16.0) * (F.lit(31.0) - F.least(F.lit(31.0), F.log2(F.col("n").cast("double"))))
        wish = wish.withColumn("priority", F.floor(scale).cast("int") * 32 + F.pmod(F.xxhash64("hub"), F.lit(32)).cast("int"))
        demand = wish.groupBy("to", "priority").agg(F.sum("n").alias("asked"))
        before = Window.partitionBy("to").orderBy("priority")
        taken = demand.withColumn("filled", F.sum("asked").over(before)).where(F.col("filled") <= _pick(room, F.col("to"))).select("to", "priority")
        accepted = s.table(wish.join(F.broadcast(taken), ["to", "priority"]).select("hub", F.col("to").alias("home"), "n"))
        used = {r["home"]: r["n"] for r in accepted.groupBy("home").agg(F.sum("n").alias("n")).collect()}
        if not used:
            break
        room = [r - used.get(k, 0) for k, r in enumerate(room)]
        settled = accepted.select("hub", "home") if settled is None else settled.unionByName(accepted.select("hub", "home"))
    if settled is None:
        homes = nodes.select("row", "hub").limit(0).withColumn("home", F.lit(0))
    else:
        homes = nodes.join(settled, "hub").select("row", "hub", "home")
    homes = s.table(homes)
    placed = rows.join(homes.select("row", "home"), "row", "left")
    free = [t - (quota - r) for t, r in zip(targets, room, strict=True)]
    bounds = [sum(free[: k + 1]) for k in range(shards)]
    fill = ranked_sets(placed.where("home is null"), "place", total)
    shard = reduce(lambda a, b: a + b, [(F.col("place") >= F.lit(b)).cast("int") for b in bounds[:-1]], F.lit(0))
    whole = placed.where("home is not null").withColumn("shard", F.col("home").cast("int")).unionByName(fill.withColumn("shard", shard).drop("place"))
    whole = s.table(whole.select("row", "doc_id", "size", "text_crc32", "shard"))
    return ranked(whole, ["shard"], ["row"], "slot", total).select("doc_id", "size", "text_crc32", "shard", "slot")


def cut_sets(sharded: DataFrame, by: str = "text_crc32") -> DataFrame:
    """(sets, cut): how many sets of linked rows there are, and how many of them lie in more than one shard."""
    one = sharded.groupBy(by).agg(F.count("*").alias("n"), F.countDistinct("shard").alias("k")).where("n > 1")
    return one.agg(F.count("*").alias("sets"), F.count_if(F.col("k") > 1).alias("cut"))
