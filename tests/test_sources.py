import pytest
from pyspark.sql import functions as F

from parlance import catalog
from parlance.functions.patterns import INTENTS
from parlance.sources import files
from parlance.streaming import messages

SF = "/root/testdata/sf0.001"


def test_tweets(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text('tweet_id,author_id,inbound,created_at,text,response_tweet_id,in_response_to_tweet_id\n1,u,True,Tue Oct 31 22:10:47 +0000 2017,"two\nlines, ""q""",2.0,\n2,b,False,bad,,,1\n')
    got = files.read_tweets(spark, str(p)).orderBy("tweet_id").collect()
    assert got[0].text == 'two\nlines, "q"' and got[0].in_response_to_tweet_id == "" and got[1].text == ""
    assert files.read_tweets(spark, str(p), 1).count() == 1
    ts = files.read_tweets(spark, str(p)).select(files.parse_timestamp().alias("t"), "tweet_id").orderBy("tweet_id").collect()
    assert ts[0].t.year == 2017 and ts[1].t is None
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="missing columns"):
        files.read_tweets(spark, str(tmp_path / "bad.csv"))


def test_json_and_codebook(spark, tmp_path):
    df = spark.createDataFrame([("1", "x", "dev"), ("2", "y", "test")], "id string, text string, split string")
    files.write_splits(df, str(tmp_path / "out"))
    assert files.read_jsonl(spark, str(tmp_path / "out/split=dev"), "id string, text string").collect() == [("1", "x")]
    (tmp_path / "c.md").write_text('# Book\n\n## `other`\nAnything else.\n\n- "one"\n- "two"\n- "three"\n- "four"\n\n## `praise_or_chitchat`\nKind words.\n')
    book = {r.intent: r for r in files.read_codebook(spark, str(tmp_path / "c.md")).collect()}
    assert book["other"].positives == ["one", "two", "three"] and book["praise_or_chitchat"].definition == "Kind words."
    assert files.missing_intents(files.read_codebook(spark, str(tmp_path / "c.md")), INTENTS).count() == len(INTENTS) - 2


def test_synthetic_pairs(spark):
    assert files.synthetic_pairs(spark, 100).where(F.col("text").contains("SYNTHETIC")).count() == 100


def test_stream(spark, tmp_path):
    rows = [(1, "2020-01-01 00:00:00", "please help me I was charged twice"), (2, "2020-01-01 00:01:00", "Please help me, I was charged twice!"), (3, "2020-01-01 00:02:00", "the app is not working for me")]
    spark.createDataFrame(rows, "id int, ts string, text string").selectExpr("id", "timestamp(ts) AS ts", "text").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, ts timestamp, text string").parquet(str(tmp_path / "in"))
    out = messages.routed(messages.first_seen(messages.cleaned(stream), "ts"))
    q = out.writeStream.format("memory").queryName("routed").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("routed").collect()
    assert len(got) == 2 and {r.route for r in got} == {"auto", "escalate"}


@pytest.mark.parametrize("name", ["embed_hash", "agent_decide"])
def test_models(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 1
