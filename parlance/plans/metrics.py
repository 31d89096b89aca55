"""Evaluation metrics, calibration, bootstrap and rater agreement as grouped aggregates."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.catalog import query
from parlance.functions import patterns as P
from parlance.functions import text as T
from parlance.functions.dialect import DUCK, SPARK
from parlance.operators.guards import side_by_side
from parlance.operators.resample import intervals
from parlance.operators.tables import written
from parlance.plans.common import PHRASES, both, brand, examples, messages, run_sql
from parlance.session import ship

D = lambda x: f"CAST({x} AS DOUBLE)"
N = lambda cond: f"CAST(sum(CAST({cond} AS INT)) AS BIGINT)"
#: Pairs of the position probe, messages of the self-preference probe.
PAIRS, TWICE = 40, 30


def prf(d) -> str:
    """prf(system, label, support, precision, recall, f1)"""
    return f"""c AS (SELECT system, label, sum(tp) AS tp, sum(g) AS g, sum(p) AS p FROM (
    SELECT system, gold AS label, CAST(gold = pred AS INT) AS tp, 1 AS g, 0 AS p FROM x UNION ALL SELECT system, pred, 0, 0, 1 FROM x) u GROUP BY system, label),
prf AS (SELECT system, label, CAST(g AS BIGINT) AS support, coalesce({D('tp')} / nullif(p, 0), 0) AS precision, coalesce({D('tp')} / nullif(g, 0), 0) AS recall, coalesce(2 * {D('tp')} / nullif(p + g, 0), 0) AS f1 FROM c)"""


@both("confusion_matrix")
def _(d):
    return f"WITH {examples(d)} SELECT system, gold, pred, count(*) AS n FROM x GROUP BY system, gold, pred"


@both("confusion_norm")
def _(d):
    return f"WITH {examples(d)}, c AS (SELECT system, gold, pred, count(*) AS n FROM x GROUP BY system, gold, pred) SELECT system, gold, pred, round({D('n')} / greatest(sum(n) OVER (PARTITION BY system, gold), 1), 6) AS share FROM c"


@both("per_class_prf")
def _(d):
    return f"WITH {examples(d)}, {prf(d)} SELECT system, label, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM prf"


@both("macro_f1")
def _(d):
    return f"WITH {examples(d)}, {prf(d)} SELECT system, round(avg(f1), 6) AS macro_f1, round(avg(round(f1, 4)), 6) AS macro_f1_r4 FROM prf WHERE support > 0 GROUP BY system"


@both("accuracy")
def _(d):
    return f"WITH {examples(d)} SELECT system, round(coalesce(avg({D('CAST(gold = pred AS INT)')}), 0), 6) AS accuracy FROM x GROUP BY system"


ROUTING = f"""r AS (SELECT system, {D(N('gold_esc AND pred_esc'))} AS tp, {D(N('NOT gold_esc AND pred_esc'))} AS fp, {D(N('gold_esc AND NOT pred_esc'))} AS fn, {D(N('NOT gold_esc AND NOT pred_esc'))} AS tn, {D('count(*)')} AS n FROM x GROUP BY system)"""


@both("routing_metrics")
def _(d):
    return f"""WITH {examples(d)}, {ROUTING} SELECT system, tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(fn / n, 6) AS false_auto_rate, round((tn + fn) / n, 6) AS deflection FROM r"""


@both("expected_cost")
def _(d):
    return f"WITH {examples(d)}, {ROUTING} SELECT system, round(({P.COST_MISSED} * fn + {P.COST_NEEDLESS} * fp) / n * 100, 6) AS cost_per_100 FROM r"


@both("cost_sensitivity")
def _(d):
    return f"WITH {examples(d)}, {ROUTING} SELECT system, ratio, round((ratio * fn + fp) / n * 100, 6) AS cost_per_100 FROM r, (SELECT {d.explode(d.array('1', '2', '5', '10', '20', '50'))} AS ratio) q"


def bins(d) -> str:
    return f"""b AS (SELECT system, CASE WHEN confidence = 0 THEN 0 ELSE CAST(ceil(confidence * 10) AS INT) - 1 END AS bin, confidence, {D('CAST(gold = pred AS INT)')} AS ok FROM x),
g AS (SELECT system, bin, count(*) AS n, avg(ok) AS acc, avg(confidence) AS conf FROM b GROUP BY system, bin)"""


@both("ece")
def _(d):
    return f"WITH {examples(d)}, {bins(d)} SELECT system, round(sum({D('n')} * abs(acc - conf)) / sum(n), 6) AS ece FROM g GROUP BY system"


@both("reliability_bins")
def _(d):
    return f"""WITH {examples(d)}, {bins(d)}, a AS (SELECT s AS system, k AS bin FROM (SELECT {d.explode(d.array('0', '1', '2', '3'))} AS s) p, (SELECT {d.explode(d.array(*map(str, range(10))))} AS k) q)
SELECT a.system, a.bin, coalesce(n, 0) AS n, round(acc, 6) AS accuracy, round(conf, 6) AS confidence FROM a LEFT JOIN g ON a.system = g.system AND a.bin = g.bin"""


def cells(d, value: str, source: str = "x") -> str:
    """k(system, v, w, hi, n): each value of a system with its count, the count of all up to it and that of the system; f(system, mean, n)."""
    return f"""c AS (SELECT system, v, count(*) AS w FROM (SELECT system, {value} AS v FROM {source}) s GROUP BY system, v),
k AS (SELECT system, v, w, sum(w) OVER (PARTITION BY system ORDER BY v) AS hi, sum(w) OVER (PARTITION BY system) AS n FROM c), f AS (SELECT system, sum(v * w) / sum(w) AS mean, max(n) AS n FROM k GROUP BY system)"""


def resampled(d, draws: str, few: str = "") -> str:
    """b(system, replicate, mean) over resamples with replacement: a draw of draws(n, replicate, u) is the example at place u of its system in order of value, so it meets a value's range and no row."""
    return f"b AS (SELECT {few} k.system, q.replicate, avg(k.v) AS mean FROM {draws} q JOIN k ON q.n = k.n AND q.u >= k.hi - k.w AND q.u < k.hi GROUP BY k.system, q.replicate)"


REPLICATES = 1000
#: Draws that a task makes at a time.
DRAWS = 1 << 16


def _drawn(d, replicate: str, j: str, n: str) -> str:
    return f"{d.hex32('concat(' + d.text(replicate) + ", '-', " + d.text(j) + ", '-20260909')")} % {n}"


SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]


def md5_heads(before: str, j: np.ndarray, after: str) -> np.ndarray:
    """The first four bytes of md5(before, j, after) as numbers, for many j of as many digits each; the three have 55 bytes at most."""
    digits = len(str(int(j[0])))
    size = len(before) + digits + len(after)
    plain = (before + "0" * digits + after).encode() + b"\x80"
    word = [np.uint32(x) for x in np.frombuffer(plain.ljust(56, b"\0") + (8 * size).to_bytes(8, "little"), "<u4")]
    for i in range(digits):
        at = len(before) + i
        word[at // 4] = word[at // 4] + (j // 10 ** (digits - 1 - i) % 10).astype(np.uint32) * np.uint32(1 << 8 * (at % 4))
    a, b, c, d = (np.full(len(j), x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    for i in range(64):
        r, k = divmod(i, 16)
        f = d ^ (b & (c ^ d)) if r == 0 else c ^ (d & (b ^ c)) if r == 1 else b ^ c ^ d if r == 2 else c ^ (b | ~d)
        f += a
        f += np.uint32(SINES[i])
        f += word[(k, 5 * k + 1, 3 * k + 5, 7 * k)[r] % 16]
        turn = TURNS[r][k % 4]
        a, d, c, b = d, c, b, b + (f << np.uint32(turn) | f >> np.uint32(32 - turn))
    return (a + np.uint32(0x67452301)).byteswap().astype(np.int64)


def _counted(edges: dict):
    """(n, replicate, hi, w): how many of the draws a to b of a replicate fall between the edge before and hi; they are the draws of _drawn()."""

    def run(batches):
        for batch in batches:
            out = []
            for n, replicate, a, b in batch.itertuples(index=False, name=None):
                cuts = [a, *(10**k for k in range(1, 19) if a < 10**k < b), b]  # as many digits in each part
                u = np.concatenate([md5_heads(f"{replicate}-", np.arange(x, y), "-20260909") for x, y in zip(cuts, cuts[1:], strict=False)]) % n
                w = np.bincount(np.searchsorted(edges[n], u, "right"), minlength=len(edges[n]))
                out.append(pd.DataFrame({"n": n, "replicate": replicate, "hi": edges[n], "w": w}))
            if out:
                yield pd.concat(out)

    return run


def bootstrapped(name: str, relations, value, answer, source: str = "x") -> None:
    """Register a query over resamples. relations(d) holds source, value(d) is what is averaged and answer(d) reads f and b.

    The engine reads the rows once, for the few distinct values and their counts; draws are numbers made in parallel and counted where they are made, by the ends of the values' ranges."""
    own = "(SELECT f.n, r.replicate, " + _drawn(DUCK, "r.replicate", "j.j", "f.n") + " AS u FROM (SELECT DISTINCT n FROM f) f, (SELECT unnest(range(0, " + str(REPLICATES) + ")) AS replicate) r, (SELECT unnest(range(0, (SELECT max(n)::BIGINT FROM f))) AS j) j WHERE j.j < f.n)"
    oracle = f"WITH {relations(DUCK)}, {cells(DUCK, value(DUCK), source)}, {resampled(DUCK, own)} {answer(DUCK)}"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = run_sql(spark, sf_dir, f"WITH {relations(SPARK)}, {cells(SPARK, value(SPARK), source)} SELECT * FROM k").toPandas()  # distinct values of each system
        if len(found) > 100_000:
            raise ValueError(f"{name} resamples values of which there are few; use operators.resample for others")
        kind = "string" if len(found) and isinstance(found.system[0], str) else "int"
        spark.createDataFrame(list(found.itertuples(index=False, name=None)), f"system {kind}, v double, w long, hi long, n long").createOrReplaceTempView("resampled_cells")
        edges = {int(n): np.unique(g.hi.to_numpy().astype(np.int64)) for n, g in found.groupby("n")}  # where a value of any system ends
        blocks = [(n, r, j, min(n, j + DRAWS)) for n in edges for r in range(REPLICATES) for j in range(0, n, DRAWS)]
        ship(spark)
        tasks = max(spark.sparkContext.defaultParallelism, -(-sum(b - a for _, _, a, b in blocks) // (DRAWS * 64)), 1)
        drawn = spark.createDataFrame(blocks, "n long, replicate long, a long, b long").repartition(tasks).mapInPandas(_counted(edges), "n long, replicate long, hi long, w long")
        drawn.groupBy("n", "replicate", "hi").agg(F.sum("w").alias("w")).createOrReplaceTempView("resampled_draws")
        k = "k AS (SELECT * FROM resampled_cells), f AS (SELECT system, sum(v * w) / sum(w) AS mean, max(n) AS n FROM k GROUP BY system)"
        means = "b AS (SELECT /*+ BROADCAST(k) */ k.system, q.replicate, sum(k.v * q.w) / sum(q.w) AS mean FROM resampled_draws q JOIN k ON q.n = k.n AND q.hi > k.hi - k.w AND q.hi <= k.hi GROUP BY k.system, q.replicate)"
        return spark.sql(f"WITH {k}, {means} {answer(SPARK)}")

    query(name, oracle)(run)


def _interval(d) -> str:
    return f"SELECT system, round({d.quantile('mean', 0.025)}, 6) AS lo, round({d.quantile('mean', 0.975)}, 6) AS hi, round(avg({D('CAST(mean < 0 AS INT)')}), 6) AS helps FROM b GROUP BY system"


HIT = D("CAST(gold = pred AS INT)")
bootstrapped("bootstrap_ci", examples, lambda d: HIT, lambda d: f"SELECT f.system, round(f.mean, 6) AS point, c.lo, c.hi FROM f JOIN ({_interval(d)}) c ON f.system = c.system")


def f1_states(classes: list[str]) -> tuple[dict[str, str], str]:
    """What an example of (gold, pred) adds to each class, and macro-F1 over the classes that occur in gold as an expression over the sums."""
    states, parts, present = {}, [], []
    for k, c in enumerate(classes):
        states |= {f"t{k}": f"CAST(gold = '{c}' AND pred = '{c}' AS INT)", f"g{k}": f"CAST(gold = '{c}' AS INT)", f"p{k}": f"CAST(pred = '{c}' AS INT)"}
        parts.append(f"CASE WHEN g{k} > 0 THEN 2 * t{k} / (g{k} + p{k}) ELSE 0 END")
        present.append(f"CAST(g{k} > 0 AS INT)")
    return states, f"({' + '.join(parts)}) / greatest({' + '.join(present)}, 1)"


@query("bootstrap_metrics")
def bootstrap_metrics(spark, sf_dir):
    """Macro-F1, accuracy, cost of 100 examples and its difference from the last system, of every system on all examples, with intervals from 1000 resamples."""
    states, macro = f1_states(P.INTENTS)
    states |= {"one": "1", "hit": "CAST(gold = pred AS INT)", "cost": f"CASE WHEN gold_esc AND NOT pred_esc THEN {P.COST_MISSED} WHEN pred_esc AND NOT gold_esc THEN {P.COST_NEEDLESS} ELSE 0 END"}
    rows = run_sql(spark, sf_dir, f"WITH {examples(SPARK)} SELECT CAST(system AS STRING) AS grp, {', '.join(f'{e} AS {n}' for n, e in states.items())} FROM x")
    found = intervals(rows, list(states), {"macro_f1": macro, "accuracy": "hit / one", "cost_per_100": "100 * cost / one"})
    cost = rows_of_costs(spark, sf_dir)
    gap = intervals(cost, ["one", "gap"], {"cost_gap": "gap / one"})
    out = found.unionByName(gap)
    return out.select(F.col("grp").cast("int").alias("system"), "statistic", *(F.round(c, 6).alias(c) for c in ("point", "lo", "hi", "half_width")))


def rows_of_costs(spark, sf_dir):
    """(grp, one, gap): by how much the last system costs more than each of the others, an example each."""
    cost = f"CASE WHEN gold_esc AND NOT pred_esc THEN {P.COST_MISSED} WHEN pred_esc AND NOT gold_esc THEN {P.COST_NEEDLESS} ELSE 0 END"
    y = f"y AS (SELECT id, max(CASE WHEN system = 3 THEN {cost} END) AS last, max(CASE WHEN system = 0 THEN {cost} END) AS c0, max(CASE WHEN system = 1 THEN {cost} END) AS c1, max(CASE WHEN system = 2 THEN {cost} END) AS c2 FROM x GROUP BY id)"
    return run_sql(spark, sf_dir, f"WITH {examples(SPARK)}, {y} SELECT CAST(s AS STRING) AS grp, 1 AS one, last - c AS gap FROM (SELECT last, stack(3, 0, c0, 1, c1, 2, c2) AS (s, c) FROM y) z")


def _cost_gaps(d) -> str:
    cost = "CASE WHEN gold_esc AND NOT pred_esc THEN 10.0 WHEN pred_esc AND NOT gold_esc THEN 1.0 ELSE 0.0 END"
    return f"{examples(d)}, y AS (SELECT id, system, {D(cost)} AS cost FROM x), diff AS (SELECT a.id, b.system, a.cost - b.cost AS gap FROM y a JOIN y b ON a.id = b.id AND a.system = 3 AND b.system < 3)"


bootstrapped(
    "paired_bootstrap", _cost_gaps, lambda d: "gap", lambda d: f"SELECT f.system, round(f.mean, 6) AS mean_diff, c.lo, c.hi, c.helps, c.hi < 0 AS meaningful FROM f JOIN ({_interval(d)}) c ON f.system = c.system", "diff"
)


@both("system_pairs")
def _(d):
    return f"WITH {examples(d)}, a AS (SELECT system, avg({D('CAST(gold = pred AS INT)')}) AS m FROM x GROUP BY system) SELECT p.system AS a, q.system AS b, round(p.m - q.m, 6) AS gap FROM a p JOIN a q ON p.system < q.system"


bootstrapped(
    "meaningful_gap", examples, lambda d: HIT,
    lambda d: f"SELECT p.system AS a, q.system AS b, p.lo > q.hi OR q.lo > p.hi AS meaningful FROM (SELECT system, {d.quantile('mean', 0.025)} AS lo, {d.quantile('mean', 0.975)} AS hi FROM b GROUP BY system) p JOIN (SELECT system, {d.quantile('mean', 0.025)} AS lo, {d.quantile('mean', 0.975)} AS hi FROM b GROUP BY system) q ON p.system < q.system",
)


@both("slice_hard_easy")
def _(d):
    return f"WITH {examples(d)} SELECT system, is_hard, count(*) AS n, round(avg({D('CAST(gold = pred AS INT)')}), 6) AS accuracy, {N('gold_esc AND NOT pred_esc')} AS missed FROM x GROUP BY system, is_hard"


@both("error_rows")
def _(d):
    return f"WITH {examples(d)} SELECT id, system, gold, pred, gold_esc, pred_esc FROM x WHERE gold <> pred OR gold_esc <> pred_esc"


@both("reply_checks")
def _(d):
    """Mean length, empty replies, grounded ones, and those that say three fifths or more of what they must not."""
    said = f"{D(d.size(d.filter('nw', 'w', d.has('rw', 'w'))))} / nullif({d.size('nw')}, 0)"
    never = d.at(brand(d), f"(id * 3 + system) % {len(PHRASES)} + 1")
    return f"""WITH {examples(d)}, w AS (SELECT system, reply, sim, {T.content_words(d, 'reply')} AS rw, {T.content_words(d, never)} AS nw FROM x)
SELECT system, round(avg({D('length(reply)')}), 6) AS mean_chars, {N(T.trim(d, 'reply') + ' = ' + chr(39) * 2)} AS empties, round(avg({D('CAST(sim >= 0.3 AS INT)')}), 6) AS grounded, {N(f'coalesce({said} >= 0.6, false)')} AS violations FROM w GROUP BY system"""


@both("pipeline_reliability")
def _(d):
    known = ", ".join(f"'{i}'" for i in P.INTENTS[:10])
    return f"WITH {examples(d)} SELECT system, round(avg({D('CAST(confidence = 0 AS INT)')}), 6) AS parse_failures, round(avg({D('CAST(length(reply) > 280 AS INT)')}), 6) AS over_length, round(avg({D(f'CAST(pred NOT IN ({known}) AS INT)')}), 6) AS other_intent FROM x GROUP BY system"


@both("majority_class")
def _(d):
    return f"WITH {examples(d)}, c AS (SELECT gold, count(*) AS n, min(id) AS first_id FROM x WHERE system = 0 GROUP BY gold) SELECT gold, n FROM c ORDER BY n DESC, first_id LIMIT 1"


@both("group_count_share")
def _(d):
    return f"WITH {examples(d)}, c AS (SELECT pred, count(*) AS n FROM x GROUP BY pred) SELECT pred, n, round({D('n')} / sum(n) OVER (), 6) AS share FROM c"


@both("headline_table")
def _(d):
    return f"WITH {examples(d)}, {ROUTING} SELECT concat('system ', {d.text('system')}, ': missed ', {d.text('CAST(fn AS BIGINT)')}, ' of ', {d.text('CAST(n AS BIGINT)')}) AS line FROM r"


def raters(d) -> str:
    """p(id, a, b): two ratings from 1 to 5 of labelled documents."""
    return "p AS (SELECT doc_id AS id, CAST(1 + (doc_id * 7 + quality * 2 + toxic) % 5 AS INT) AS a, CAST(1 + (doc_id * 7 + quality * 2 + CASE WHEN doc_id % 3 = 0 THEN doc_id % 2 ELSE toxic END) % 5 AS INT) AS b FROM labels WHERE doc_id IS NOT NULL)"


@both("cohens_kappa")
def _(d):
    return f"""WITH {raters(d)}, n AS (SELECT {D('count(*)')} AS n, {D(N('a = b'))} AS same FROM p), m AS (SELECT v, {D('sum(ka)')} AS ka, {D('sum(kb)')} AS kb FROM (SELECT a AS v, 1 AS ka, 0 AS kb FROM p UNION ALL SELECT b, 0, 1 FROM p) u GROUP BY v),
e AS (SELECT max(n.same) / max(n.n) AS po, sum(ka * kb) / max(n.n * n.n) AS pe FROM m, n) SELECT round(CASE WHEN pe = 1 THEN 1 ELSE (po - pe) / (1 - pe) END, 6) AS kappa FROM e"""


def ranks(name: str, source: str, c: str) -> str:
    """name(v, r): the average rank of each distinct value; only distinct values are ordered."""
    return f"{name} AS (SELECT v, {D('sum(n) OVER (ORDER BY v) - n + 1')} + (n - 1) / {D('2')} AS r FROM (SELECT {c} AS v, count(*) AS n FROM {source} GROUP BY {c}) {name}_n)"


def spearman(source: str, x: str, y: str) -> str:
    """z(n, cov, vx, vy, rho) of average ranks."""
    return f"""{ranks('rx', source, x)}, {ranks('ry', source, y)}, k AS (SELECT rx.r AS rx, ry.r AS ry FROM {source} s JOIN rx ON s.{x} = rx.v JOIN ry ON s.{y} = ry.v),
m AS (SELECT {D('count(*)')} AS n, avg(rx * ry) - avg(rx) * avg(ry) AS cov, avg(rx * rx) - avg(rx) * avg(rx) AS vx, avg(ry * ry) - avg(ry) * avg(ry) AS vy FROM k),
z AS (SELECT CAST(n AS BIGINT) AS n, round(CASE WHEN n < 2 OR vx <= 1e-9 OR vy <= 1e-9 THEN 0 ELSE cov / sqrt(CASE WHEN vx * vy > 0 THEN vx * vy ELSE 1 END) END, 6) AS rho FROM m)"""


@both("average_rank")
def _(d):
    return f"WITH {raters(d)}, {ranks('r', 'p', 'a')} SELECT p.id, r.r AS average_rank FROM p JOIN r ON p.a = r.v"


@both("spearman_rho")
def _(d):
    return f"WITH {raters(d)}, {spearman('p', 'a', 'b')} SELECT n, rho FROM z"


@both("length_bias")
def _(d):
    words = f"{d.size(T.terms(d, 'd.text'))}"
    return f"WITH l AS (SELECT {words} AS words, l.quality * 2 + l.toxic AS score FROM documents d JOIN labels l ON d.doc_id = l.doc_id), {spearman('l', 'words', 'score')} SELECT n, CASE WHEN n >= 10 THEN rho END AS rho, CASE WHEN n >= 10 THEN abs(rho) > 0.4 END AS biased, CASE WHEN n < 10 THEN 'too few' END AS note FROM z"


@both("full_pass_on_sample")
def _(d):
    return f"WITH {examples(d)} SELECT l.doc_id, x.pred, x.confidence, l.quality FROM labels l JOIN x ON x.id = l.doc_id AND x.system = 3"


@both("krippendorff_alpha")
def _(d):
    return f"""WITH {raters(d)}, v AS (SELECT {D('a')} AS v FROM p UNION ALL SELECT {D('b')} FROM p), s AS (SELECT {D('count(*)')} AS n, sum(v) AS s1, sum(v * v) AS s2 FROM v),
o AS (SELECT avg({D('(a - b) * (a - b)')}) AS d_o FROM p), e AS (SELECT (2 * n * s2 - 2 * s1 * s1) / (n * (n - 1)) AS d_e FROM s) SELECT round(CASE WHEN d_e = 0 THEN 0 ELSE 1 - d_o / d_e END, 6) AS alpha FROM o, e"""


@both("rater_agreement")
def _(d):
    return f"WITH {raters(d)} SELECT count(*) AS n, round(avg({D('CAST(a = b AS INT)')}), 6) AS exact, round(avg({D('CAST(abs(a - b) <= 1 AS INT)')}), 6) AS within_1, round(avg({D('a - b')}), 6) AS shift FROM p"


@both("rater_pairs")
def _(d):
    return f"WITH {raters(d)} SELECT p.id, p.a, q.b FROM p JOIN (SELECT id, CASE WHEN id % 4 <> 0 THEN b END AS b FROM p) q ON p.id = q.id WHERE q.b IS NOT NULL"


def _axes(d) -> str:
    """Scored axes and, as one more, whether a reply may go out unedited; a rating in ten is missing."""
    axes = d.array("'groundedness'", "'actionability'", "'brand_fit'", "'safety'")
    return f"""{raters(d)}, w AS (SELECT {d.at(axes, 'id % 4 + 1')} AS system, CASE WHEN id % 10 <> 0 THEN {D('a')} END AS score FROM p UNION ALL SELECT 'send_unedited', {D('CAST(b >= 4 AS INT)')} FROM p), x AS (SELECT * FROM w WHERE score IS NOT NULL)"""


bootstrapped("judge_means", _axes, lambda d: "score", lambda d: f"SELECT f.system AS axis, CAST(f.n AS BIGINT) AS n, round(f.mean, 6) AS mean, c.lo, c.hi FROM f JOIN ({_interval(d)}) c ON f.system = c.system")


@both("judge_clamp")
def _(d):
    even = "bround(raw, 0)" if d.name == "spark" else "round_even(raw, 0)"
    return f"WITH r AS (SELECT doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE {D('(doc_id % 29) - 4')} / 4 END AS raw FROM documents) SELECT id, CAST(greatest(1, least(5, {even})) AS INT) AS score FROM r WHERE raw IS NOT NULL"


@both("compliance")
def _(d):
    return f"""WITH {raters(d)}, c AS (SELECT id, least(a, 4) AS n, {d.array('a > 1', 'b > 2', 'a = b', 'id % 2 = 0', 'TRUE')} AS met FROM p), m AS (SELECT id, n, {d.size(d.filter('slice(met, 1, n)' if d.name == 'spark' else 'met[1:n]', 'v', 'v'))} AS k FROM c)
SELECT round({D('sum(k)')} / sum(n), 6) AS rate, {N('k = n')} AS full_count FROM m"""


@both("flip_rate")
def _(d):
    """Seeded pairs of answered messages, judged in both orders; a pair is consistent if the letter of the winner flips with the order."""
    seed = d.hex32(f"concat({d.text('x.id')}, '-20260909')")
    return f"""WITH {examples(d)}, {raters(d)}, s AS (SELECT x.id, p.a, p.b, {seed} AS h FROM x JOIN p ON x.id = p.id WHERE x.system = 3 AND {T.trim(d, 'x.reply')} <> '' ORDER BY h, x.id LIMIT {2 * PAIRS}),
o AS (SELECT *, row_number() OVER (ORDER BY h, id) - 1 AS k FROM s), v AS (SELECT CASE WHEN l.a >= r.a THEN 'A' ELSE 'B' END AS first, CASE WHEN r.b >= l.b THEN 'A' ELSE 'B' END AS swapped FROM o l JOIN o r ON l.k + 1 = r.k AND l.k % 2 = 0)
SELECT count(*) AS n_pairs, coalesce({N('first = swapped')}, 0) AS inconsistent_pairs, round(avg({D('CAST(first = swapped AS INT)')}), 4) AS flip_rate FROM v"""


@both("self_preference")
def _(d):
    """Mean scores of two generators' replies to the same seeded messages, over the axes that were scored, and their difference."""
    seed = d.hex32(f"concat({d.text('id')}, '-20260909')")
    score = lambda c, k: f"CASE WHEN (id + {k}) % 7 <> 0 THEN {D(f'1 + ({c} + {k} * id) % 5')} END"
    mean = lambda c: " + ".join(f"coalesce({score(c, k)}, 0)" for k in range(4))
    n = " + ".join(f"CAST({score('a', k)} IS NOT NULL AS INT)" for k in range(4))
    return f"""WITH {raters(d)}, s AS (SELECT id, a, b, {seed} AS h FROM p ORDER BY h, id LIMIT {TWICE}), m AS (SELECT ({mean('a')}) / nullif({n}, 0) AS own, ({mean('b')}) / nullif({n}, 0) AS other FROM s)
SELECT count(own) AS n, round(avg(own), 6) AS own, round(avg(other), 6) AS other, round(avg(own) - avg(other), 6) AS delta FROM m"""


@both("verdict_band")
def _(d):
    return f"""WITH r AS (SELECT doc_id AS id, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE {D('doc_id % 100')} / 100 END AS rho FROM documents)
SELECT id, CASE WHEN rho IS NULL THEN 'unmeasured' WHEN rho >= 0.7 THEN 'usable' WHEN rho >= 0.6 THEN 'acceptable' ELSE 'weak' END AS verdict FROM r"""


def passes(d) -> str:
    """v(id, a, b, c, ea, eb, ec): three labelling passes."""
    i = d.array(*[f"'{x}'" for x in P.INTENTS[:5]])
    return f"v AS (SELECT doc_id AS id, {d.at(i, 'doc_id % 5 + 1')} AS a, {d.at(i, '(doc_id + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END) % 5 + 1')} AS b, {d.at(i, '(doc_id + CASE WHEN doc_id % 6 = 0 THEN 1 WHEN doc_id % 7 = 0 THEN 2 ELSE 0 END) % 5 + 1')} AS c, doc_id % 4 = 0 AS ea, doc_id % 8 = 0 AS eb, doc_id % 4 = 0 AS ec FROM documents WHERE doc_id IS NOT NULL)"


VOTE = "CASE WHEN a = b OR a = c THEN a WHEN b = c THEN b END AS intent, CASE WHEN ea = eb OR ea = ec THEN ea WHEN eb = ec THEN eb END AS escalate"


@both("majority_vote")
def _(d):
    return f"WITH {passes(d)} SELECT id, {VOTE} FROM v"


@both("agreement_counts")
def _(d):
    return f"WITH {passes(d)} SELECT {N('a = b AND b = c')} AS unanimous, {N('(a = b OR a = c OR b = c)')} AS majority, {N('a <> b AND a <> c AND b <> c')} AS split FROM v"


@both("top_confusions")
def _(d):
    return f"WITH {passes(d)} SELECT a, b, count(*) AS n FROM v WHERE a <> b GROUP BY a, b ORDER BY n DESC, a, b LIMIT 8"


def _aligned(d) -> str:
    return f"WITH {passes(d)}, l AS (SELECT id, a FROM v), r AS (SELECT id, b FROM v) SELECT count(*) AS n, {N('l.a = r.b')} AS same, count(*) = (SELECT count(*) FROM v) AS aligned FROM l JOIN r ON l.id = r.id"


@query("aligned_passes", _aligned(DUCK))
def aligned_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two passes, each in its own files, joined by place; rows that are not side by side stop the job."""
    v = written(run_sql(spark, sf_dir, f"WITH {passes(SPARK)} SELECT id, a, b FROM v"), "passes")
    left, right = (written(v.select("id", c).orderBy("id"), f"pass_{c}") for c in ("a", "b"))
    pairs = side_by_side(left, right)
    return pairs.agg(F.count("*").alias("n"), F.count_if(F.col("left.a") == F.col("right.b")).alias("same"), (F.coalesce(F.max("place") + 1, F.lit(0)) == F.count("*")).alias("aligned"))


@both("review_queue")
def _(d):
    return f"WITH {passes(d)} SELECT id, 'disagreement' AS why FROM v WHERE a <> b OR ea <> eb UNION ALL SELECT id, 'spot check' FROM (SELECT id, {d.hex32('concat(' + d.text('id') + ', ' + chr(39) + '-review' + chr(39) + ')')} % 5 AS k FROM v WHERE a = b AND ea = eb) s WHERE k = 0"


def ordinal(code: str, codes: list[str]) -> str:
    return f"{code} IN ({', '.join(f'{chr(39)}{c}{chr(39)}' for c in codes)})"


@both("normalise_reason")
def _(d):
    raw = d.array(*[f"'{c}'" for c in [*P.ESCALATION_CODES[:6], *P.AUTO_CODES, "content_removal_complex", ""]])
    ok = lambda c: f"CASE WHEN (e AND {ordinal(c, P.ESCALATION_CODES)}) OR (NOT e AND {ordinal(c, P.AUTO_CODES)}) THEN {c} END"
    return f"""WITH r AS (SELECT doc_id AS id, doc_id % 2 = 0 AS e, {d.at(raw, 'doc_id % 11 + 1')} AS a, {d.at(raw, '(doc_id * 3 + 1) % 11 + 1')} AS b, {d.at(raw, '(doc_id * 5 + 2) % 11 + 1')} AS c FROM documents)
SELECT id, e, coalesce({ok('a')}, {ok('b')}, {ok('c')}, '') AS reason FROM r"""


@both("coerce_intent")
def _(d):
    raw = d.array(*[f"'{c}'" for c in [*P.INTENTS[:4], "unknown_thing", ""]])
    conf = d.array("'0.5'", "'1.7'", "'-2'", "'high'", "NULL")
    return f"""WITH r AS (SELECT doc_id AS id, {d.at(raw, 'doc_id % 6 + 1')} AS raw, {d.at(conf, 'doc_id % 5 + 1')} AS conf, text FROM documents)
SELECT id, CASE WHEN {ordinal('raw', P.INTENTS)} THEN raw ELSE 'other' END AS intent, greatest({D('0')}, least({D('1')}, coalesce({d.number('conf')}, 0))) AS confidence, substr(text, 1, 120) AS rationale FROM r"""


@both("provisional_status")
def _(d):
    return f"WITH {passes(d)} SELECT {N('id % 9 <> 0')} AS provisional, {N('id % 9 = 0')} AS human, concat({d.text(N('id % 9 <> 0'))}, ' of ', {d.text('count(*)')}, ' labels are provisional') AS banner FROM v"


@both("assemble_golden")
def _(d):
    return f"""WITH {passes(d)}, m AS (SELECT *, {VOTE} FROM v), h AS (SELECT id, 'other' AS intent, true AS escalate FROM v WHERE id % 9 = 0)
SELECT m.id, coalesce(h.intent, m.intent, m.a) AS intent, coalesce(h.escalate, m.escalate, m.ea) AS escalate, CASE WHEN h.id IS NOT NULL THEN 'human' WHEN m.intent IS NOT NULL THEN 'majority' ELSE 'pass_a' END AS labeler, h.id IS NULL AS provisional,
  CASE WHEN coalesce(h.escalate, m.escalate, m.ea) = m.ea THEN 'a' WHEN coalesce(h.escalate, m.escalate, m.ea) = m.eb THEN 'b' ELSE 'c' END AS source FROM m LEFT JOIN h ON m.id = h.id"""


@both("validate_rows")
def _(d):
    thin = f"(SELECT count(*) FROM (SELECT {d.explode(d.array(*[f'{chr(39)}{i}{chr(39)}' for i in P.INTENTS]))} AS intent) i LEFT JOIN (SELECT intent, count(*) AS n FROM r GROUP BY intent) k ON i.intent = k.intent WHERE coalesce(k.n, 0) < {P.FLOOR})"
    return f"""WITH {passes(d)}, r AS (SELECT v.id, CASE WHEN v.id % 17 = 0 THEN 'unheard_of' ELSE a END AS intent, CASE WHEN v.id % 13 = 0 THEN 'odd' ELSE 'easy' END AS difficulty, ea AS escalate,
  CASE WHEN v.id % 10 = 0 THEN 'informational_answer' WHEN v.id % 19 = 0 THEN 'no_such_code' ELSE 'refund_request' END AS reason, CASE WHEN v.id % 23 = 0 THEN 'nobody' ELSE 'majority' END AS labeler, t.text FROM v JOIN documents t ON v.id = t.doc_id)
SELECT count(*) AS n, count(*) - count(DISTINCT id) AS duplicates, {N('NOT ' + ordinal('intent', P.INTENTS))} AS bad_intent, {N('difficulty NOT IN (' + "'easy', 'medium', 'hard'" + ')')} AS bad_difficulty,
  {N('NOT ' + ordinal('reason', P.ESCALATION_CODES + P.AUTO_CODES))} AS bad_reason, {N("labeler NOT IN ('human', 'majority', 'pass_a')")} AS bad_labeler, {N(f"coalesce({T.trim(d, 'text')}, '') = ''")} AS empty_text,
  {N('escalate AND ' + ordinal('reason', P.AUTO_CODES))} AS inconsistent, count(*) BETWEEN 150 AND 250 AS in_band, max({thin}) AS thin_intents FROM r"""


def allocation(d) -> str:
    """al(intent, pool, short, take): the floor for every intent, the rest in proportion, then single places off the largest surplus or onto the largest deficit until the target is met or the pool is empty."""
    places = {i: k for k, i in enumerate(P.INTENTS)}
    place = "CASE intent " + " ".join(f"WHEN '{i}' THEN {k}" for i, k in places.items()) + " END"
    even = "bround" if d.name == "spark" else "round_even"
    return f"""c AS (SELECT gold AS intent, count(*) AS pool FROM x WHERE system = 0 GROUP BY gold), f AS (SELECT intent, pool, {place} AS place, least({P.FLOOR}, pool) AS floor_n FROM c),
l AS (SELECT *, {P.TARGET} - sum(floor_n) OVER () AS remaining, sum(pool - floor_n) OVER () AS total_left FROM f),
e AS (SELECT intent, pool, place, CAST(least(pool, floor_n + CASE WHEN remaining > 0 AND total_left > 0 THEN CAST({even}({D('remaining')} * (pool - floor_n) / nullif(total_left, 0), 0) AS BIGINT) ELSE 0 END) AS BIGINT) AS n FROM l),
s AS (SELECT sum(n) - {P.TARGET} AS over FROM e), u AS (SELECT intent, pool, place, n, over, k FROM e CROSS JOIN s CROSS JOIN (SELECT {d.explode(d.range('0', str(P.TARGET)))} AS k) z),
one AS (SELECT intent, over, row_number() OVER (ORDER BY CASE WHEN over > 0 THEN n - k ELSE pool - n - k END DESC, place) AS r FROM u WHERE CASE WHEN over > 0 THEN n - k > 0 ELSE pool - n - k > 0 END),
move AS (SELECT intent, sum(CASE WHEN r <= over THEN -1 WHEN r <= -over THEN 1 ELSE 0 END) AS by FROM one GROUP BY intent),
al AS (SELECT e.intent, e.pool, e.pool < {P.FLOOR} AS short, CAST(e.n + coalesce(move.by, 0) AS BIGINT) AS take FROM e LEFT JOIN move ON e.intent = move.intent)"""


@both("stratified_alloc")
def _(d):
    return f"WITH {examples(d)}, {allocation(d)} SELECT intent, pool, short, take FROM al"


@both("quota_pick")
def _(d):
    """Of each intent as many as its allocation says, in seeded order: hard ones up to the quota, at least one, then easy ones, then more hard ones."""
    even = "bround" if d.name == "spark" else "round_even"
    seed = d.hex32(f"concat({d.text('id')}, '-20260909')")
    return f"""WITH {examples(d)}, {allocation(d)}, r AS (SELECT * FROM (SELECT id, gold, is_hard, row_number() OVER (PARTITION BY gold, is_hard ORDER BY {seed}, id) AS k FROM x WHERE system = 0) z WHERE k <= {P.TARGET}),
p AS (SELECT r.*, al.take, CASE WHEN is_hard AND k <= greatest(1, {even}({D('al.take')} * {P.HARD_QUOTA}, 0)) THEN 0 WHEN NOT is_hard THEN 1 ELSE 2 END AS tier FROM r JOIN al ON r.gold = al.intent),
o AS (SELECT *, row_number() OVER (PARTITION BY gold ORDER BY tier, k) AS pick FROM p) SELECT gold, id, is_hard FROM o WHERE pick <= take"""


@both("label_pass")
def _(d):
    """A labelling pass over all documents from replayed answers: the intents in an order shuffled for each one, answers coerced to the lists, notes cut."""
    intents = d.array(*[f"'{i}'" for i in P.INTENTS])
    raw = d.array(*[f"'{c}'" for c in [*P.INTENTS[:4], "unknown_thing", ""]])
    codes = d.array(*[f"'{c}'" for c in [*P.ESCALATION_CODES[:3], "made_up"]])
    level = d.array("'easy'", "'hard'", "NULL", "'extreme'")
    seed = d.hex32(f"concat({d.text('id')}, '-', i)")
    return f"""WITH t AS (SELECT doc_id AS id, {d.at(raw, 'doc_id % 6 + 1')} AS raw, doc_id % 4 = 0 AS e, {d.at(codes, 'doc_id % 4 + 1')} AS code, {d.at(level, 'doc_id % 4 + 1')} AS level, text FROM documents WHERE doc_id IS NOT NULL),
o AS (SELECT id, {d.explode(intents)} AS i FROM (SELECT DISTINCT id FROM t) q), s AS (SELECT id, {d.join(d.collect('i', f"concat(lpad({d.text(seed)}, 10, '0'), i)"), ',')} AS options FROM o GROUP BY id)
SELECT t.id, s.options, CASE WHEN {ordinal('raw', P.INTENTS)} THEN raw ELSE 'other' END AS intent, NOT {ordinal('raw', P.INTENTS)} AS failed, coalesce(e, false) AS escalate, CASE WHEN {ordinal('code', P.ESCALATION_CODES + P.AUTO_CODES)} THEN code ELSE '' END AS reason,
  coalesce(level, 'medium') AS difficulty, substr(coalesce(text, ''), 1, 160) AS notes FROM t JOIN s ON t.id = s.id"""


@both("taxonomy_gate")
def _(d):
    return f"WITH i AS (SELECT {d.explode(d.array(*[f'{chr(39)}{x}{chr(39)}' for x in P.INTENTS]))} AS intent) SELECT count(*) AS n, count(*) BETWEEN 9 AND 13 AS in_band, {N(chr(39).join(['intent = ', 'other', '']))} = 1 AS has_other FROM i"


@both("topup")
def _(d):
    return f"""WITH {passes(d)}, n AS (SELECT a AS intent, count(*) AS have FROM v WHERE id % 50 = 0 GROUP BY a), k AS (SELECT v.id, n.intent, n.have, row_number() OVER (PARTITION BY n.intent ORDER BY {d.hex32(d.text('v.id'))}, v.id) AS r
  FROM v JOIN n ON CAST(v.a = n.intent AS INT) + CAST(v.b = n.intent AS INT) + CAST(v.c = n.intent AS INT) >= 2 WHERE v.id % 50 <> 0) SELECT intent, id FROM k WHERE r <= greatest(0, {P.FLOOR} - have)"""


@both("seeded_sample")
def _(d):
    return f"SELECT doc_id AS id FROM documents WHERE doc_id IS NOT NULL ORDER BY md5(concat({d.text('doc_id')}, '-20260909')), doc_id LIMIT 100"


def sweep(d) -> str:
    grid = lambda n, k: f"(SELECT {D('k')} / {n} AS v FROM (SELECT {d.explode(d.array(*map(str, range(k))))} AS k) u)"
    late = "(x.pred_esc OR x.confidence < t.v OR x.sim < s.v)"
    return f"""{examples(d)}, g AS (SELECT t.v AS tau, s.v AS sigma, (10 * {D(N(f'x.gold_esc AND NOT {late}'))} + {D(N(f'NOT x.gold_esc AND {late}'))}) / count(*) * 100 AS cost
  FROM (SELECT * FROM x WHERE system = 3) x, {grid(12, 12)} t, {grid(10, 9)} s GROUP BY t.v, s.v)"""


@both("threshold_sweep")
def _(d):
    return f"WITH {sweep(d)} SELECT tau, sigma, round(cost, 6) AS cost FROM g"


@both("threshold_best")
def _(d):
    return f"WITH {sweep(d)} SELECT tau, sigma, round(cost, 6) AS cost FROM g ORDER BY round(cost, 6), tau, sigma LIMIT 1"


@both("cluster_map")
def _(d):
    names = d.array(*[f"'{k}'" for k in [*P.CLUSTER_INTENT, "unheard_of"]])
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.CLUSTER_INTENT.items())
    return f"WITH c AS (SELECT doc_id AS id, {d.at(names, f'doc_id % {len(P.CLUSTER_INTENT) + 1} + 1')} AS cluster FROM documents) SELECT id, cluster, CASE cluster {cases} ELSE 'other' END AS intent FROM c"
