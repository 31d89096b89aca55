"""Scans, joins, windows and set operations over the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.catalog import query
from parlance.functions import patterns as P
from parlance.functions import text as T
from parlance.functions.dialect import DUCK, SPARK
from parlance.operators.budget import decided
from parlance.operators.ordering import numbered
from parlance.plans.common import both, messages, run_sql
from parlance.plans.metrics import D, N


@both("scan_all_string")
def _(d):
    cols = ", ".join(f"coalesce({d.text(c)}, '') AS {c}" for c in ("conv_id", "turn", "role", "text"))
    return f"SELECT {cols} FROM conversations"


@both("scan_limit")
def _(d):
    return "SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 100"


@both("latest_wins")
def _(d):
    return "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) e WHERE r = 1"


@both("ledger_rollup")
def _(d):
    return f"SELECT event_type AS tag, count(*) AS calls, round(sum(value), 4) AS usd, round(avg(value), 6) AS mean FROM events GROUP BY event_type"


@both("ledger_tail")
def _(d):
    return "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 2000"


@both("tag_size_rollup")
def _(d):
    return f"SELECT event_type AS tag, event_id % 3 <> 0 AS keep, count(*) AS n, sum(length(props)) AS bytes FROM events GROUP BY event_type, event_id % 3 <> 0"


@both("cache_stats")
def _(d):
    return "SELECT count(*) AS entries, sum(length(props)) AS bytes FROM events"


@both("token_price")
def _(d):
    rows = " UNION ALL ".join(f"SELECT '{m}' AS model, {D(a)} AS p_in, {D(b)} AS p_out" for m, (a, b) in P.PRICES.items())
    names = d.array(*[f"'{m}'" for m in [*P.PRICES, "unknown"]])
    return f"WITH p AS ({rows}), c AS (SELECT event_id, {d.at(names, 'event_id % 5 + 1')} AS model, event_id % 4000 AS pt, event_id % 700 AS ct FROM events) SELECT c.event_id, round(coalesce((c.pt * p.p_in + c.ct * p.p_out) / 1e6, 0), 9) AS usd FROM c LEFT JOIN p ON c.model = p.model"


@both("budget_running")
def _(d):
    return f"""WITH e AS (SELECT event_id, event_type, ts, date_trunc('hour', ts) AS h, {D('event_id % 97')} / 10000 AS usd FROM events), t AS (SELECT event_type, h, sum(usd) AS usd FROM e GROUP BY event_type, h),
b AS (SELECT event_type, h, sum(usd) OVER (PARTITION BY event_type ORDER BY h ROWS UNBOUNDED PRECEDING) - usd AS before FROM t), s AS (SELECT e.event_id, b.before + sum(e.usd) OVER (PARTITION BY e.event_type, e.h ORDER BY e.ts, e.event_id ROWS UNBOUNDED PRECEDING) + 1e-7 AS spent
  FROM e JOIN b ON e.event_type = b.event_type AND e.h = b.h) SELECT event_id, spent >= 25 AS over, spent >= 20 AS near FROM s"""


MODELS = [*P.PRICES, "unknown"]
CAP_NANO = 1_000_000_000


def _calls(d) -> str:
    return f"SELECT {d.text('event_id')} AS call_id, ts, {d.at(d.array(*[f'{chr(39)}{m}{chr(39)}' for m in MODELS]), 'event_id % 5 + 1')} AS model, event_id % 4000 AS prompt_tokens, length(props) AS completion_tokens FROM events WHERE event_id IS NOT NULL"


def _stops(d) -> str:
    cost = lambda m: "prompt_tokens * CASE " + " ".join(f"WHEN {m} = '{k}' THEN {round(a * 1000)}" for k, (a, _) in P.PRICES.items()) + " ELSE 0 END + completion_tokens * CASE " + " ".join(f"WHEN {m} = '{k}' THEN {round(b * 1000)}" for k, (_, b) in P.PRICES.items()) + " ELSE 0 END"
    before = lambda x: f"coalesce(sum({x}) OVER (ORDER BY ts, call_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    return f"""WITH c AS ({_calls(d)}), o AS (SELECT *, {cost('model')} AS own, {cost("'lite'")} AS cheap FROM c), w AS (SELECT *, {before('own')} * 100 >= {CAP_NANO * 80} AND model <> 'lite' AS late FROM o),
t AS (SELECT *, CASE WHEN late THEN cheap ELSE own END AS cost FROM w), b AS (SELECT *, {before('cost')} AS spent FROM t)
SELECT call_id, model, CASE WHEN spent >= {CAP_NANO} THEN NULL WHEN late THEN 'lite' ELSE model END AS used, CASE WHEN spent >= {CAP_NANO} THEN 'refused' WHEN late THEN 'downgraded' ELSE 'made' END AS status,
  CAST(CASE WHEN spent >= {CAP_NANO} THEN 0 ELSE cost END AS BIGINT) AS nano_usd, CAST(CASE WHEN spent < {CAP_NANO} THEN spent END AS BIGINT) AS before_nano FROM b"""


@query("budget_stops", _stops(DUCK))
def budget_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decisions of one spending limit over all calls: made, made by the cheapest model, or refused."""
    return decided(run_sql(spark, sf_dir, _calls(SPARK)), P.PRICES, "lite", CAP_NANO)


@both("recency")
def _(d):
    return f"SELECT event_id, round(coalesce(({d.seconds('lo', 'ts')}) / nullif({d.seconds('lo', 'hi')}, 0), 0.5), 6) AS recency FROM events, (SELECT min(ts) AS lo, max(ts) AS hi FROM events) m"


SPLIT = "CASE WHEN r <= floor(n * 0.70) THEN 'corpus' WHEN r <= floor(n * 0.85) THEN 'dev' ELSE 'test' END AS split"
SPLITS = f"SELECT event_id, {SPLIT} FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS r, count(*) OVER () AS n FROM events) e"


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, split) by place in the order of time."""
    rows, n = numbered(spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet").select("event_id", "ts"), "ts", "event_id", "r")
    return rows.withColumn("n", F.lit(n)).selectExpr("event_id", SPLIT)


@query("time_split", SPLITS)
def _(spark, sf_dir):
    return splits(spark, sf_dir)


@query("split_ranges", f"SELECT split, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM ({SPLITS}) s GROUP BY split")
def _(spark, sf_dir):
    return splits(spark, sf_dir).groupBy("split").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@both("iso_timestamp")
def _(d):
    iso = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ssxx\")" if d.name == "spark" else "strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+0000'"
    return f"SELECT event_id, {iso} AS iso FROM events"


@both("sorted_by_intent_and_size")
def _(d):
    return "SELECT intent, source, size, row_number() OVER (ORDER BY intent, size DESC, source) AS place FROM (SELECT lang AS intent, source, count(*) AS size FROM documents GROUP BY lang, source) g"


@both("bad_ts")
def _(d):
    raw = d.array("'Tue Oct 31 22:10:47 +0000 2017'", "'not a date'", "''", "'Wed Feb 01 01:02:03 +0000 2012'")
    parse = "try_to_timestamp(substr(raw, 5), 'MMM dd HH:mm:ss Z yyyy')" if d.name == "spark" else "try_strptime(replace(substr(raw, 5), ' +0000', ''), '%b %d %H:%M:%S %Y')"
    return f"WITH r AS (SELECT event_id, {d.at(raw, 'event_id % 4 + 1')} AS raw FROM events), t AS (SELECT {parse} AS ts FROM r) SELECT count(*) AS n, {N('ts IS NULL')} AS bad, {d.text('max(year(ts))')} AS last_year FROM t"


def funnel(d) -> str:
    """Rows left after each step, rows dropped for each reason, and the rows of bad quality among them."""
    return f"""WITH {messages(d)}, r AS (SELECT {T.quality_reason(d, 'text')} AS reason FROM m)
SELECT 'stage: documents' AS step, count(*) AS n, NULL AS first_ts, NULL AS last_ts FROM documents UNION ALL SELECT 'stage: labelled', count(*), NULL, NULL FROM labels UNION ALL SELECT 'stage: good', count(*), NULL, NULL FROM labels WHERE quality = 1
UNION ALL SELECT 'stage: clean', count(*), NULL, NULL FROM labels WHERE quality = 1 AND toxic = 0 UNION ALL SELECT concat('reason: ', coalesce(reason, 'none')), count(*), NULL, NULL FROM r GROUP BY reason"""


@query("data_funnel", f"{funnel(DUCK)} UNION ALL SELECT concat('split: ', split), count(*), strftime(min(ts), '%Y-%m-%d'), strftime(max(ts), '%Y-%m-%d') FROM ({SPLITS}) s JOIN events e ON s.event_id = e.event_id GROUP BY split")
def _(spark, sf_dir):
    rows = splits(spark, sf_dir).join(spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet").select("event_id", "ts"), "event_id")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    parts = rows.groupBy(F.concat(F.lit("split: "), "split").alias("step")).agg(F.count("*").alias("n"), day(F.min("ts")).alias("first_ts"), day(F.max("ts")).alias("last_ts"))
    return run_sql(spark, sf_dir, funnel(SPARK)).unionByName(parts)


@both("left_lookup")
def _(d):
    return "SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, -1) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"


@both("semi_join")
def _(d):
    return "SELECT doc_id, lang FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)"


@both("anti_join")
def _(d):
    return "SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"


@both("set_union")
def _(d):
    return "SELECT doc_id FROM documents WHERE lang = 'en' UNION SELECT doc_id FROM labels"


@both("set_except")
def _(d):
    return "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels"


@both("set_intersect")
def _(d):
    return "SELECT doc_id FROM documents WHERE lang <> 'en' INTERSECT SELECT doc_id FROM labels"


@both("bag_append")
def _(d):
    return "SELECT src, count(*) AS n FROM (SELECT 'documents' AS src, doc_id FROM documents UNION ALL SELECT 'labels', doc_id FROM labels) u GROUP BY src"


@both("schema_check")
def _(d):
    return f"SELECT {N('doc_id IS NULL')} AS null_ids, {N('text IS NULL')} AS null_texts, count(*) - count(DISTINCT doc_id) AS repeated_ids FROM documents"


@both("cost_by_nation")
def _(d):
    return "SELECT n.n_name, count(*) AS orders, round(sum(o.o_totalprice), 2) AS total FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name"


@both("line_rollup")
def _(d):
    return "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY l_returnflag, l_linestatus"
