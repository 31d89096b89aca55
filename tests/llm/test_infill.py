import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import infill
from tests.llm.common import ODD, docs


def brute(doc, text, seed=1, share=90, spm=20):
    text = text or ""
    h = None if doc is None else [int(hashlib.sha256(f"{seed}:{doc}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or h is None or any(m in text for m in infill.MARKERS) or h[2] % 100 >= share:
        return len(text), "plain", None, None, text
    a, b = sorted((h[0] % (len(text) + 1), h[1] % (len(text) + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    form = "spm" if h[3] % 100 < spm else "psm"
    return len(text), form, a, b - a, f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


TEXTS = ["a", "ab", "é combining", "漢字かな🙂🙂 mixed", "<P", "P><S", "<<<<", "has <M> inside", "<S>", "tabs\tand\nlines\r\n", "\u0000 nul", "🙂", "<" * 50 + "S" * 50, "   ", "x" * 200_000]


def test_against_a_plain_version(spark):
    rows = ODD + [(100 + i, t) for i, t in enumerate(TEXTS * 12)]
    odd = docs(spark, rows).withColumnRenamed("lang", "form").withColumnRenamed("source", "output").withColumnRenamed("n_chars", "a.b")
    got = infill.transform(odd).withColumn("again", infill.restored()).collect()
    assert sorted([(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got], key=repr) == sorted([(i, *brute(i, t)) for i, t in rows], key=repr)
    by = {i: t or "" for i, t in rows if i not in (4, 9)}
    assert all(r.again == by[r.doc_id] for r in got if r.doc_id in by) and {r.form for r in got} == {"plain", "psm", "spm"}
    assert infill.transform(docs(spark, [])).count() == 0


def test_bounds_of_units():
    text = infill.points("ab  c\n\nd é".encode())
    assert infill.bounds(text, "char").tolist() == list(range(11)) and infill.bounds(infill.points(b""), "line").tolist() == [0]
    assert infill.bounds(text, "word").tolist() == [0, 2, 4, 5, 7, 8, 9, 10]
    assert infill.bounds(text, "line").tolist() == [0, 6, 7, 10] and infill.bounds(infill.points(b"a\n"), "line").tolist() == [0, 2]


@pytest.mark.parametrize("unit", ["word", "line"])
def test_cuts_lie_between_units(spark, unit):
    rows = [(i, f"some words {i}\n\nand  more\tof them 漢字\nlast {i * 7}") for i in range(200)]
    got = infill.transform(docs(spark, rows), seed=5, unit=unit, share=100, spm=50, markers=("§p§"[:2], "§s§"[:2], "§m§"[:2])).withColumn("again", infill.restored(markers=("§p", "§s", "§m"))).collect()
    by = dict(rows)
    for r in got:
        edges = set(infill.bounds(infill.points(by[r.doc_id].encode()), unit).tolist())
        assert r.again == by[r.doc_id] and r.form != "plain" and {r.prefix_chars, r.prefix_chars + r.middle_chars} <= edges
    assert len({(r.prefix_chars, r.middle_chars) for r in got}) > 3


def test_pieces_that_look_like_markers_are_told_apart(spark):
    r = np.random.default_rng(8)
    rows = [(i, "".join(r.choice(list("<>PSM"), 12))) for i in range(3000)]
    got = infill.transform(docs(spark, rows), share=100).withColumn("again", infill.restored()).collect()
    by = dict(rows)
    assert all(x.again == by[x.doc_id] for x in got) and sum(x.form != "plain" for x in got) > 2000


def test_bytes_that_are_no_text_come_back(spark):
    raw = spark.createDataFrame([(i, bytearray(b"ab\xff\xfecd \xc3 ef")) for i in range(20)], "doc_id long, text binary").withColumn("text", F.col("text").cast("string"))
    got = infill.transform(raw, share=100).select("n", F.hex(infill.restored().cast("binary")).alias("h")).collect()
    assert {(r.n, r.h) for r in got} == {(11, b"ab\xff\xfecd \xc3 ef".hex().upper())}


def test_wrong_parameters(spark):
    for wrong in ({"unit": "page"}, {"markers": ("<P>", "<P>", "<M>")}, {"markers": ("<a<", "<b", "<c")}, {"markers": ("<a", "<ab", "<c")}, {"markers": ("<a", "[b", "<c")}):
        with pytest.raises(ValueError):
            infill.transform(docs(spark, [(1, "x")]), **wrong)
