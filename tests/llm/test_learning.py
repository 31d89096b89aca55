import random

from pyspark.sql import functions as F

import corpus_pipeline
from parlance.llm import html_text, langid, toxicity
from tests.llm.common import DOCS, ODD, docs

SF = "/root/testdata/sf0.01"


def test_toxic_texts_are_found(spark):
    r = random.Random(3)
    clean = lambda: " ".join(f"w{r.randrange(400)}" for _ in range(60))
    rows, marks = [], []
    for i in range(600):
        bad = i % 8 == 0
        rows.append((i, clean() + (" vileword nastyterm " if bad else " ") + clean()))
        if i % 3:
            marks.append((i, int(bad)))
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    got = toxicity.scores(docs(spark, rows + ODD), labels).collect()
    assert len(got) == len(rows) + len(ODD) and all(0 <= r.score <= 1 for r in got)
    told = [(r.score >= 0.3, r.doc_id % 8 == 0) for r in got if r.doc_id is not None and r.doc_id > 20]
    assert sum(p for p, bad in told if bad) >= 0.97 * sum(bad for _, bad in told)
    assert sum(p for p, bad in told if not bad) <= 0.05 * len(told)
    assert toxicity.scores(docs(spark, rows[:5]), labels.limit(0)).where("score <> 0").count() == 0
    assert toxicity.scores(docs(spark, []), labels).count() == 0
    odd = docs(spark, rows + ODD).withColumnRenamed("lang", "score").withColumnRenamed("source", "toxic").withColumnRenamed("n_chars", "a.b")
    kept = toxicity.keep_civil(odd, labels)
    assert kept.columns == odd.columns and toxicity.keep_civil(odd.limit(0), labels).count() == 0
    left = kept.collect()
    assert sum(r.doc_id is None for r in left) == 1 and sum(r.doc_id == 4 for r in left) == 2 + (rows[4][1] in [r.text for r in left])
    assert not any("vileword" in (r.text or "") for r in left)


def test_toxic_texts_of_the_tables_are_found_in_every_language(spark):
    """The held-out fold, whose labels are not learnt from."""
    sf = "/root/testdata/sf0.1"
    table, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    told = toxicity.scores(table, labels).join(labels.where(toxicity.held_out()), "doc_id").join(table.select("doc_id", "lang"), "doc_id").collect()
    for lang in {r.lang for r in told}:
        bad = [r.score >= 0.3 for r in told if r.lang == lang and r.toxic == 1]
        good = [r.score >= 0.3 for r in told if r.lang == lang and r.toxic == 0]
        assert sum(bad) >= 0.85 * len(bad) and sum(good) <= 0.02 * len(good), lang


def test_languages_are_told_apart(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.identify(table).join(table.select("doc_id", "lang"), "doc_id").where(langid.held_out())
    assert got.where("lang = lang_pred").count() >= 0.97 * got.count()
    odd = langid.identify(docs(spark, [*ODD, (77, "1234 ... !!"), (78, "🙂 ¿¡")])).collect()
    assert {r.lang_pred for r in odd if r.doc_id in (1, 2, 3, 77, 78)} == {"und"} and len(odd) == len(ODD) + 2
    assert langid.identify(docs(spark, [])).count() == 0


def test_letters_rare_languages_and_repeated_ids(spark):
    r = random.Random(7)
    word = lambda letters: "".join(r.choice(letters) for _ in range(r.randint(2, 7)))
    text = lambda letters: " ".join(word(letters) for _ in range(40))
    rows = [(i, text("abcdeno"), "aa", "s", 1) for i in range(3000)] + [(5000 + i, text("жшщыэя"), "bb", "s", 1) for i in range(8)]
    rows += [(1, text("abcdeno"), "aa", "s", 1)] * 3000 + [(None, text("жшщыэя"), None, None, None), (9000, "½ ² Ⅷ ① 12", "aa", "s", 1), (9001, "_ \u0301", None, "s", 1), (9002, "Ⅷ жшщыэя жшщ", None, "s", 1)]
    table = spark.createDataFrame(rows, DOCS).withColumnRenamed("source", "lang_pred").withColumnRenamed("n_chars", "score").repartition(3)
    got = langid.identify(table).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 for x in got)
    by = {x.doc_id: x.lang_pred for x in got}
    assert by[9000] == by[9001] == "und" and by[9002] == by[None] == "bb" and all(by[5000 + i] == "bb" for i in range(8)) and by[17] == "aa"
    one = langid.identify(table.where("lang = 'aa'")).select("lang_pred").distinct().collect()
    assert {x.lang_pred for x in one} == {"aa", "und"}


def test_main_text_of_made_up_pages_of_every_shape():
    r, m = random.Random(99), html_text.trained()
    for shape in html_text.SHAPES:
        right = total = 0
        for _ in range(150):
            tree, want = html_text.known(html_text.labelled_page(r, shape))
            p, _ = m.marginals(tree)
            blocks = [k for k in range(len(want)) if tree.text[k] is not None]
            right += sum((p[k] >= 0.5) == bool(want[k]) for k in blocks)
            total += len(blocks)
        assert right >= 0.95 * total, shape


def test_articles_without_telling_names():
    m = html_text.trained()
    sign = '<div class="newsletter-signup"><p>Sign up for our newsletter today</p></div>'
    assert m.text(f"<body><article><p>Main words of the story are written here at length.</p>{sign}<p>The end of story.</p></article></body>") == "Main words of the story are written here at length.\nThe end of story."
    assert m.text("<article><p>One paragraph alone is here.</p></article>") == "One paragraph alone is here."
    first, second = "The first paragraph has words. " * 8, "The second one has others. " * 8
    assert m.text(f"<body><div>{first}</div><div>{second}</div><ul><li><a href=x>Home</a><li><a href=y>About us</a></ul></body>") == f"{first.strip()}\n{second.strip()}"
    assert m.text('<div class="menu"><a href=x>Home</a></div>just bare text in a body that is not in any tag.<section class=comments><article class=comment><p>Nice post, thanks.</p></article></section>') == "just bare text in a body that is not in any tag."


def test_pages_are_read_in_linear_time():
    import time

    m = html_text.trained()
    for part in ("<div", '<div a="', "<a b='", "<", "</script", "<b>", "<div></p>", "<script>", "<!--", "&", "<p x=y z "):
        began = time.process_time()
        m.text(part * 100_000)
        assert time.process_time() - began < 5, part


def test_tables_of_pages(spark):
    """Every page of the tables against the text of its article element, cut out by hand."""
    import re

    for r in html_text.extract(spark.read.parquet(f"{SF}/pages.parquet")).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inside = re.search(r"<article\b[^>]*>(.*)</article>", r.html, re.S)[1]
        assert r.text == "\n".join(t for t in html_text.parse(inside).text if t)


def test_marginals_are_exact():
    """Message passing against the sum over all joint states of a small tree."""
    from itertools import product
    from math import exp

    m, tree = html_text.trained(), html_text.parse("<div class=ad><p>one two</p></div><article>three <h1>four</h1></article>")
    n = len(tree.parent)
    total, on = 0.0, [0.0] * n
    for s in product((0, 1), repeat=n):
        w = exp(sum(sum(m.w[a] for a in tree.active[k]) * s[k] for k in range(n)) + sum(m.pair[int(tree.text[k] is not None), s[tree.parent[k]], s[k]] for k in range(1, n)))
        total += w
        for k in range(n):
            on[k] += w * s[k]
    p, _ = m.marginals(tree)
    assert all(abs(a - b / total) < 1e-9 for a, b in zip(p, on, strict=True))


def test_pages(spark):
    pages = [
        (1, "u", "<html><body><nav><a href=x>Menu</a></nav><article><h1>A &amp; B</h1><p>First  line<br>goes\non.<p>Second &lt;b&gt;.</article><footer>&copy; x</footer>"),
        (2, "u", None), (3, "u", ""), (4, None, "<article>" + "<p>long paragraph text here.</p>" * 3000 + "</article>"), (5, "u", "<div" * 50), (6, "u", "<div>" * 3000 + "deep"),
        (7, "u", "<article><p>no-break\u2003\u00a0\x0bspaces\u3000fold &nbsp; here</p></article>"), (None, "u", "<article><p>A page without an id.</p></article>"), (7, "u", ""),
    ]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "url AS text", "url AS n_chars")
    assert html_text.extract(table).count() == len(pages) and html_text.extract(table.limit(0)).count() == 0
    got = {r.page_id: r for r in html_text.extract(table.where("not (page_id = 7 and html = '') or page_id is null")).collect()}
    assert got[7].text == "no-break spaces fold here" and got[None].text == "A page without an id."
    assert got[1].text == "A & B\nFirst line goes on.\nSecond <b>." and got[1].n_chars == len(got[1].text)
    assert got[2].text == got[3].text == "" and got[4].text.count("\n") == 2999 and len(got) == 8


def test_every_stage_takes_odd_rows_and_empty_tables(spark):
    """Null ids and texts, empty and long texts, repeated rows and columns of the operators' own names, in each stage by itself."""
    for rows in (ODD, []):
        table = docs(spark, rows).withColumnRenamed("source", "key").withColumn("_did", F.lit(1)).withColumn("component_id", F.lit("x")).withColumn("n_pieces", F.lit(0.5))
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, SF)
            got = out.collect()
            if name != "sentencepiece":
                assert out.columns == table.columns, name
            kept = {None, 1, 2, 3, 4, 5, 6, 7, 8, 9, -3} if rows else set()
            assert {r.doc_id for r in got} == kept, name
            if name in ("toxicity", "decontamination", "sentencepiece"):
                assert len(got) == len(rows), name


def brute_pipeline(rows, vile, item):
    """The pipeline in plain Python: rows (doc_id, text); a text with a vile word is toxic."""
    from tests.llm.test_pairs import components, lower
    from tests.llm.test_substring_dedup import brute_lines

    import re

    rows = [(i, t) for i, t in rows if vile not in t]
    rows = [(i, t) for i, t in rows if (str(i), str(i)) in {(a, c) for a, _, c in components(rows, 5, 80, 100)}]
    gone = {i: n for i, _, n in brute_lines(rows, 20, 100)}
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    grams = {tuple(words(item)[k : k + 10]) for k in range(len(words(item)) - 9)}
    return {i: gone[i] for i, t in rows if not any(tuple(words(t)[k : k + 10]) in grams for k in range(len(words(t)) - 9))}


def test_pipeline(spark, tmp_path):
    passage = " ".join(f"Shared part {k} of a passage." for k in range(12))
    item = " ".join(f"question{k}" for k in range(15))
    own = lambda c: " ".join(f"{c}{k}" for k in range(60)) + ". "  # noqa: E731  long enough that the two are no near duplicates
    rows = [(i, f"Document {i} has its own words w{i * 7} x{i * 11} y{i * 13} and so on. " + " ".join(f"z{i * 31 + k}" for k in range(40)) + ".", "en", "s", 1) for i in range(40)]
    rows += [(100, rows[3][1], "en", "s", 1), (101, rows[4][1] + " more", "en", "s", 1), (102, own("a") + passage, "en", "s", 1), (103, own("b") + passage, "en", "s", 1), (104, "leak " + item, "en", "s", 1)]
    rows += [(200 + k, f"vileword nastyterm {k} " + " ".join(f"q{k * 17 + j}" for j in range(20)), "en", "s", 1) for k in range(12)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 200)) for i in [*range(40), *range(200, 212)]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in out) == [*range(40), 102, 103]
    want = brute_pipeline([(i, t) for i, t, *_ in rows], "vileword", item)
    assert sorted(want) == [*range(40), 102, 103] and {i for i, n in want.items() if n} == {103}
    assert all(r.decodes and r.n_pieces == len(r.piece_ids) for r in out)
    assert {r.doc_id: r.n_pieces for r in out}[103] < {r.doc_id: r.n_pieces for r in out}[102] * 0.8
