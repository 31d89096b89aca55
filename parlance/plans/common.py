"""What the query builders share: registration in both dialects and the relations that the tables stand for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parlance.catalog import query
from parlance.functions.dialect import DUCK, SPARK
from parlance.session import TABLES

#: Support sentences put before the invented prose of documents, so that every rule family has hits.
PHRASES = [
    "@brandcare my account was hacked and someone changed my email without asking me", "I was charged twice this month, please refund me", "Can you DM us your account details so we can help",
    "Try clearing your cache and then restart the app, make sure it is updated", "Sorry to hear about that", "hey there", "love you guys!!!! thank you so much",
    "The app keeps closing and crashes when I open it????", "why don't you bring back the old layout, i wish it was there", "this is not working and also the car bluetooth is broken",
    "I can't log in and I am locked out, password reset fails", "I will speak to my lawyer about data protection", "took money from my account 9.99 again, want a refund",
    "I already tried everything and still not working", "cancel my subscription now, I am done with you", "You can change your plan in settings, it takes up to 3 days ^JT",
    "We've fixed this for you, all good now /KM", "vote for the idea here https://t.co/abc123 and add your vote", "See support.spotify pages at www.example.com for the steps",
    "great job breaking the thing, apparently nobody tests", "Nothing here", "My number is +44 20 7946 0958, mail me at jo.doe@example.org", "order 123456789 was lost &amp; never came",
    "head over to our dms", "We're on it", "the reason is that refunds are processed within 5 business days", "what time is it there", "premium isn't active on my student discount",
    "why isn't that album on spotify", "offline mode does not load and skips songs", "I want to die, this is too much", "rock &lt;b&gt; roll,,,,, baby", "your feedback has been noted by @someone_else",
    "our team is aware and looking into this", "someone else is using my card, suspicious login", "ok", "no sound on the xbox, it cuts out", "unauthorized charge of $12 yesterday",
    "please add a family plan option", "it is what it is",
]


def brand(d) -> str:
    return d.array(*[d.lit(p) for p in PHRASES])


def messages(d) -> str:
    """m(id, text, lang, reply): an ASCII message per document, of a phrase and its whole text, and as reply the phrase of another one."""
    n = len(PHRASES)
    fold = d.replace("text", r"[^\x00-\x7F]", " ")
    return f"""m AS (
  SELECT doc_id AS id, concat({d.at(brand(d), f'doc_id % {n} + 1')}, ' ', {fold}) AS text, lang,
    {d.at(brand(d), f'(doc_id * 7 + 3) % {n} + 1')} AS reply, doc_id % 4 = 1 AS has_context, {d.at(brand(d), f'(doc_id * 11 + 5) % {n} + 1')} AS context
  FROM documents WHERE doc_id IS NOT NULL)"""


def tweets(d) -> str:
    """t(tweet_id, author_id, inbound, parent, created_at, text): conversations as flat messages, a third of them plain
    chains, a third with their last turn moved up, a third with a strand for either side."""
    tid = lambda x: d.text(x)
    return f"""t AS (
  SELECT {tid('conv_id * 1000 + turn')} AS tweet_id, CASE WHEN role = 'assistant' THEN 'brand' ELSE concat('u', {tid('conv_id')}) END AS author_id, role = 'user' AS inbound,
    coalesce(CASE WHEN turn = 0 THEN '' WHEN conv_id % 3 = 0 THEN {tid('conv_id * 1000 + turn - 1')}
      WHEN conv_id % 3 = 1 AND turn >= 2 AND turn = max(turn) OVER (PARTITION BY conv_id) THEN {tid('conv_id * 1000 + turn - 2')}
      WHEN conv_id % 3 = 2 AND turn >= 2 THEN {tid('conv_id * 1000 + turn - 2')} ELSE {tid('conv_id * 1000 + turn - 1')} END, '') AS parent,
    conv_id * 1000 + turn AS created_at, text, conv_id, turn FROM conversations)"""


def edges(d) -> str:
    """e(parent, child): links between messages that are both there, without loops, each once."""
    return "e AS (SELECT DISTINCT t.parent, t.tweet_id AS child FROM t JOIN t p ON t.parent = p.tweet_id WHERE t.parent <> t.tweet_id)"


def examples(d) -> str:
    """x(id, system, gold, pred, confidence, gold_esc, pred_esc, is_hard, reply, sim): one evaluated message per document and system."""
    from parlance.functions.patterns import INTENTS

    intents = d.array(*[d.lit(i) for i in INTENTS])
    return f"""x AS (
  SELECT doc_id AS id, s AS system, {d.at(intents, 'doc_id % 11 + 1')} AS gold,
    {d.at(intents, 'CASE WHEN (doc_id * 13 + s * 5) % 10 < 5 + s THEN doc_id % 11 ELSE (doc_id * 3 + s) % 11 END + 1')} AS pred,
    CAST((doc_id * 7919 + s * 104729) % 1001 AS DOUBLE) / 1000 AS confidence, doc_id % 6 = 0 AS gold_esc,
    CASE WHEN (doc_id * 17 + s) % 10 < 6 + s THEN doc_id % 6 = 0 ELSE doc_id % 4 = 0 END AS pred_esc, doc_id % 5 = 0 AS is_hard,
    CASE WHEN doc_id % 9 = 0 THEN '' ELSE text END AS reply, CAST((doc_id * 31) % 997 AS DOUBLE) / 997 AS sim
  FROM documents, (SELECT {d.explode(d.array('0', '1', '2', '3'))} AS s) systems WHERE doc_id IS NOT NULL)"""


def views(spark: SparkSession, sf_dir: str, sql: str) -> None:
    for name in TABLES:
        if name in sql:
            spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").createOrReplaceTempView(name)


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    views(spark, sf_dir, sql)
    return spark.sql(sql)


def both(name: str, own=SPARK):
    """Register a function of a dialect that returns SQL, for the engine and for the oracle; own is ASCII where it looks at texts of messages alone."""

    def add(f: Callable):
        query(name, f(DUCK))(lambda spark, sf_dir: run_sql(spark, sf_dir, f(own)))
        return f

    return add
