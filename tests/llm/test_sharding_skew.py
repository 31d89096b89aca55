"""Sharding of tables with a very common text, and beyond one bucket of rows."""

from parlance.llm import sharding
from tests.llm.common import docs


def placed(spark, rows, **kw):
    where, sizes = {}, {}
    for r in sharding.assign(docs(spark, list(enumerate(rows))), **kw).collect():
        of = where.setdefault(rows[r.doc_id], {})
        of[r.shard] = of.get(r.shard, 0) + 1
        sizes[r.shard] = sizes.get(r.shard, 0) + 1
    assert max(sizes.values()) - min(sizes.values()) <= 1 and sum(sizes.values()) == len(rows)
    return where


def test_quota_blocks_settle_before_smaller_sets(spark):
    rows = ["hot"] * 2000 + [f"small {k // 7}" for k in range(4000)]
    where = placed(spark, rows, shards=40)  # 150 rows a shard: 13 blocks and 50 rows
    assert sorted(where["hot"].values()) == [50] + [150] * 13
    assert sum(len(of) > 1 for t, of in where.items() if t != "hot") <= 40  # the last rows of a shard


def test_left_sets_touch_few_shards_beyond_one_bucket(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 100)
    rows = ["hot"] * 900 + [f"set {k // 30}" for k in range(1500)] + [f"own {k}" for k in range(600)]
    where = placed(spark, rows, shards=20, rounds=0)  # all rows are left: 150 rows a shard
    assert len(where["hot"]) <= 7 and all(len(of) <= 2 for t, of in where.items() if t != "hot")
    where = placed(spark, rows, shards=20)
    assert len(where["hot"]) == 6 and all(len(of) == 1 for t, of in where.items() if t != "hot")


def test_fewer_sets_are_cut_than_by_hash_and_hardly_more_than_must_be(spark):
    rows = ["hot"] * 700 + [f"group {k // 9}" for k in range(900)] + [f"pair {k // 2}" for k in range(300)] + [f"own {k}" for k in range(500)]
    table = docs(spark, list(enumerate(rows)))
    mine = sharding.cut_sets(sharding.assign(table, shards=24)).first()  # 100 rows a shard
    hashed = table.selectExpr("crc32(encode(text, 'utf-8')) AS text_crc32", "pmod(xxhash64(doc_id), 24) AS shard")
    other = sharding.cut_sets(hashed).first()
    assert mine.sets == other.sets == 251 and other.cut > 200
    must = 1  # the hot text alone holds more rows than a shard
    assert must <= mine.cut <= must + 24  # at most one set at the end of each shard
