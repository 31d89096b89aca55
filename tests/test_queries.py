"""Every query that has an oracle, held against DuckDB, and a few expected values of text functions."""

import math
import os

import duckdb
import pandas as pd
import pytest

from parlance import catalog
from parlance.functions import patterns as P
from parlance.functions import text as T
from parlance.functions.dialect import ANY, ASCII, DUCK, END, SPARK, one_of, spelled
from parlance.plans.common import PHRASES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 5)
    return v.item() if hasattr(v, "item") else v


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(plain(v) for v in r) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(n for n in catalog.queries() if n in catalog.oracles()))
def test_against_the_oracle(spark, duck, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    want = duck.execute(catalog.oracles()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


CASES = [
    (T.normalise, "help!!!!!!", "help!!"), (T.normalise, "rock &amp; roll", "rock & roll"), (T.normalise, "a   b\n\nc", "a b c"), (T.token_count, "hey <USER> check <URL>", 2),
    (T.norm_id, "123.0", "123"), (T.norm_id, "nan", ""), (T.norm_id, "  456 ", "456"), (T.scrub_pii, "mail jo@example.org now", "mail  <EMAIL>  now"),
    (T.signature, "See you ^JT", "JT"), (T.signature, "All good -Thanks", ""), (T.is_english, "please help me with my account", True), (T.is_english, "min sy mau beli spotify pakai kartu", False),
    (T.strip_mention, "@BrandCare hello", "  hello"), (T.truncate_reply, "short", "short"), (T.quality_reason, "the app is", "too_short"),
]


@pytest.mark.parametrize(("f", "text", "want"), CASES)
def test_text_functions(spark, duck, f, text, want):
    quoted = DUCK.lit(text).replace("\n", "' || chr(10) || '") if "\n" in text else DUCK.lit(text)
    assert duck.execute(f"SELECT {f(DUCK, 'x')} FROM (SELECT {quoted} AS x)").fetchall()[0][0] == want
    df = spark.createDataFrame([(text,)], "x string")
    assert df.selectExpr(f"{f(SPARK, 'x')} AS y").first()["y"] == want


def test_scrubbing_twice_changes_nothing(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").selectExpr(f"{T.clean_customer(SPARK, 'text')} AS x")
    assert df.where(f"{T.clean_customer(SPARK, 'x')} <> x").count() == 0


def test_nfkc(spark):
    from parlance.functions.unicode import nfkc
    from parlance.session import ship

    ship(spark)
    df = spark.createDataFrame([("ﬁne ①",), (None,), ("plain",)], "x string")
    assert [r[0] for r in df.select(nfkc(df.x)).collect()] == ["fine 1", None, "plain"]


def test_the_rest_works_without_the_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.join(os.path.dirname(__file__), "..")
    shutil.copytree(os.path.join(root, "parlance"), tmp_path / "parlance", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q) and not [n for n in q if n.startswith('op') or n == 'pipeline']"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_broken_modules_of_the_subpackage_are_errors(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.join(os.path.dirname(__file__), "..")
    shutil.copytree(os.path.join(root, "parlance"), tmp_path / "parlance", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    (tmp_path / "parlance" / "llm").mkdir()
    (tmp_path / "parlance" / "llm" / "__init__.py").write_text("")
    (tmp_path / "parlance" / "llm" / "registry.py").write_text("import no_such_module")
    assert subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, timeout=120).returncode != 0


def both_engines(spark, duck, sql, **tables):
    """Rows of a query over small tables, the same in both engines."""
    out = []
    for name, df in tables.items():
        spark.createDataFrame(df).createOrReplaceTempView(name)
        duck.register(name, df)
    for d, run in ((SPARK, lambda q: spark.sql(q).toPandas()), (DUCK, lambda q: duck.execute(q).df())):
        out.append(run(sql(d)))
    assert rows(out[0]) == rows(out[1])
    return out[0]


def test_scores_of_classes_by_hand(spark, duck):
    from parlance.plans.metrics import prf

    x = pd.DataFrame({"system": 0, "gold": list("aabbc"), "pred": list("abbba")})
    got = both_engines(spark, duck, lambda d: f"WITH {prf(d)} SELECT * FROM prf", x=x).set_index("label")
    assert [round(v, 4) for v in got.loc["a", ["precision", "recall", "f1"]]] == [0.5, 0.5, 0.5] and got.loc["a", "support"] == 2
    assert [round(v, 4) for v in got.loc["b", ["precision", "recall"]]] == [0.6667, 1] and got.loc["c", "f1"] == 0 and got.loc["c", "support"] == 1


def test_ranks_by_hand(spark, duck):
    from parlance.plans.metrics import spearman

    for a, b, rho in (([1, 1, 2, 2], [3, 3, 5, 5], 1), ([1, 2, 3, 4], [4, 3, 2, 1], -1), ([1, 1, 1], [1, 2, 3], 0)):
        assert both_engines(spark, duck, lambda d: f"WITH {spearman('rated', 'a', 'b')} SELECT n, rho FROM z", rated=pd.DataFrame({"a": a, "b": b})).rho[0] == rho


def test_routing_by_hand(spark, duck):
    from parlance.plans.metrics import ROUTING

    x = pd.DataFrame({"system": [0] * 4 + [1] * 10 + [2] * 10, "gold_esc": [True, True, False, False] + [True] + [False] * 19, "pred_esc": [True, False, True, False] + [False] * 10 + [True] + [False] * 9})
    got = both_engines(spark, duck, lambda d: f"WITH {ROUTING} SELECT system, CAST(fn AS DOUBLE) AS fn, CAST(fp AS DOUBLE) AS fp, CAST(n AS DOUBLE) AS n, CAST((10 * fn + fp) AS DOUBLE) / n * 100 AS cost FROM r", x=x).set_index("system")
    assert list(got.loc[0, ["fn", "fp", "n"]]) == [1, 1, 4] and got.loc[1, "cost"] == 100 and got.loc[2, "cost"] == 10


def test_whole_texts_in_nfkc(spark):
    import unicodedata

    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.id: r.normalised for r in catalog.queries()["normalise_unicode"](spark, SF).collect()}
    assert got.keys() == text.keys()
    squeezed = lambda t: "".join(t.split())
    plain_ones = [i for i, t in text.items() if t is not None and not any(c in t for c in "&!?.,")]
    assert all(unicodedata.is_normalized("NFKC", t) for t in got.values() if t is not None)
    assert all(squeezed(got[i]) == squeezed(unicodedata.normalize("NFKC", text[i])) for i in plain_ones)


def test_texts_are_not_searched_letter_by_letter(spark):
    from parlance.functions import patterns as P
    from parlance.functions.dialect import ASCII, held

    assert "regexp_count" not in T.is_english(SPARK, "x").split(" ELSE false END")[1] and "[^a-z0-9 ]" not in T.dedupe_key(SPARK, "x") and "[^ " not in T.token_count(SPARK, "x")
    assert [held(p) for p in (r"\btry(ing)?\b", r"\b(dis|en)abl(e|ing)\b", r"a|b", r"https?://\S+", r"ab*c?x{0,2}", "[xyz]")] == ["try", "abl", "", "http", "a", ""]
    texts = ["", "RETRYING to Log out", "TRY now, re-install!", "it takes up to 3 days\x0bx", " \t a \n", "abcdefg", "A1b2c3d4 e.f'g h", "x'" * 300 + " the end", "Is' it", "a s", "ИЛИ это the письмо", "abc " * 120 + "thes", None]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    every = [p for v in (P.TROUBLESHOOT, P.HANDOFF, P.ACK_ONLY, P.STRONG_LINK, P.WEAK_LINK, P.FEATURE, P.POLICY, P.ACTION) for p in v] + [P.NEGATION, P.SARCASM, P.MULTI_INTENT, P.TRIGGER, *P.PROBES.values()]
    for r in df.where("octet_length(x) = length(x)").selectExpr("x", *[f"({ASCII.like('x', p)}) <=> ({SPARK.like('x', p)}) AS p{i}" for i, p in enumerate(every)]).collect():
        assert all(r[1:]), r
    con = duckdb.connect()
    for r in df.where("x is not null").selectExpr("x", f"{T.is_english(SPARK, 'x')} AS e", f"{T.dedupe_key(SPARK, 'x')} AS k", f"{T.trim(ASCII, 'x')} <=> {T.trim(SPARK, 'x')} AS t").collect():
        assert (r.e, r.k, r.t) == (*con.execute(f"SELECT {T.is_english(DUCK, 'x')}, {T.dedupe_key(DUCK, 'x')} FROM (SELECT ? AS x)", [r.x]).fetchone(), True), r


def test_words_that_a_match_must_hold(spark):
    """Replies are searched for patterns only where they hold a word of them; what each pattern spells, and texts close to it, are found as by the pattern alone."""
    assert one_of(r"\bre-?add(ing|ed)?\b") == ["add", "added", "adding", "readd", "readded", "readding"]
    assert one_of(r"\b(this|that) (is|was) (now )?fixed\b", ["this", "that"]) == ["fixed"] and one_of(r"\bonce (you|your)\b.{0,50}\bwill\b", ["will", "you"]) == ["once", "your"]
    assert one_of(r"https?://\S+") == one_of(r"\w+fixed\b") == one_of(r"\bfix\w*") == one_of(r"\b(now )?") == one_of(r"(?i)\bfixed\b") == []
    patterns = [p for family in P.REPLY_FAMILIES for p in family]
    said = {t.replace(END, edge).replace(ANY, mid) for p in patterns for t in spelled(p)[:40] for edge, mid in ((" ", " "), ("-", "9"), ("'", ""), ("_", " 9 "), ("\n", "."))}
    texts = sorted(said | {t.upper() for t in said} | {f"{t}s 7" for t in said} | {*PHRASES, ""})
    rows = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4).selectExpr("t", f"{ASCII.among('t', patterns, P.FUNCTION_WORDS)} AS said").localCheckpoint()
    for k in range(0, len(patterns), 11):
        some = patterns[k : k + 11]
        got = rows.selectExpr(*[f"count_if({ASCII.said('said', 't', p, P.FUNCTION_WORDS)}) AS a{i}" for i, p in enumerate(some)], *[f"count_if(regexp_like(t, {ASCII.lit('(?i)' + p)})) AS b{i}" for i, p in enumerate(some)]).first()
        assert all(got[f"a{i}"] == got[f"b{i}"] > 0 for i in range(len(some))), [(p, got[f"a{i}"], got[f"b{i}"]) for i, p in enumerate(some)]
    assert T.score_reply(ASCII, "text", "m", "id").count("contains(") < 12  # others look at the words of a text, which are split once
