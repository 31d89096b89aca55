"""CSV records with line breaks, in any split, against Python's csv module; torn quotes, short lines, headers that differ."""

import csv
import io
import random

import pytest

from parlance.sources import files
from parlance.sources.records import Header, read_records

HEAD = "tweet_id,author_id,inbound,created_at,text,response_tweet_id,in_response_to_tweet_id"


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield spark
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def record(i, text):
    out = io.StringIO()
    csv.writer(out, lineterminator="").writerow([i, "u", "True", "Tue Oct 31 22:10:47 +0000 2017", text, "", i - 1])
    return out.getvalue()


def test_many_splits_of_one_file(small_splits, tmp_path):
    r = random.Random(5)
    texts = ["".join(r.choice(['a', 'b', ' ', ',', '"', "\n", "\n\n", "é", "7,u,True,"]) for _ in range(r.randrange(40))) for _ in range(400)]
    (tmp_path / "t.csv").write_text(HEAD + "\n" + "\n".join(record(i, t) for i, t in enumerate(texts)) + "\n")
    rows, bad = files.tweets_and_bad(small_splits, str(tmp_path / "t.csv"))
    assert {int(x.tweet_id): x.text for x in rows.collect()} == dict(enumerate(texts)) and rows.count() == 400
    assert bad.count() == 0
    assert small_splits.read.text(str(tmp_path / "t.csv")).rdd.getNumPartitions() > 10


def test_bad_records_are_kept_apart(small_splits, tmp_path):
    good = [record(i, f"line {i}\nand more") for i in range(100)]
    lines = [HEAD, *good[:50], '900,u,True,now,"torn here', "and goes on", *good[50:], "901,u,False", "", "902,u,True,now,x,,1,extra,fields", record(903, "fine")]
    (tmp_path / "t.csv").write_text("\n".join(lines) + "\n")
    rows, bad = files.tweets_and_bad(small_splits, str(tmp_path / "t.csv"))
    got = {int(x.tweet_id): x for x in rows.collect()}
    assert set(got) == {*range(100), 901, 903} and got[99].text == "line 99\nand more" and got[901].text == "" and got[901].inbound == "False"
    assert sorted((x.reason, x.line, x.record[:3]) for x in bad.collect()) == [("short", 204, "901"), ("too many fields", 206, "902"), ("torn quote", 102, "900")]


def test_headers_of_many_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text('﻿y,"x",z\r\n20,10,0\r\n')
    (tmp_path / "c.csv").write_text("")
    rows, bad = read_records(spark, str(tmp_path), ("x", "y"))
    assert sorted(map(tuple, rows.collect())) == [("1", "2"), ("10", "20")] and bad.count() == 0
    (tmp_path / "d.csv").write_text("y,z\n1,2\n")
    with pytest.raises(Header, match="d.csv: missing columns: x$"):
        read_records(spark, str(tmp_path), ("x", "y"))


def test_files_without_records(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n")
    assert [df.count() for df in read_records(spark, str(tmp_path / "a.csv"), ("x", "y"))] == [0, 0]
    (tmp_path / "e.csv").write_text("")
    assert [df.count() for df in read_records(spark, str(tmp_path / "e.csv"), ("x", "y"))] == [0, 0]
