import re

from parlance.llm import substring_dedup
from tests.llm.common import ODD, docs

PASSAGE = "Alpha beta gamma delta. One two three four five six seven. Short. Again we have some more words here, all in a row! And the end of it."


def units(text):
    """(start, end, normalised words) of each unit, in code points."""
    out, now, last = [], [], None
    for m in re.finditer(r"[^\x20\x09-\x0D]+", text):
        word = m[0]
        if now and ("\n" in text[last : m.start()] or closes):
            out.append(now)
            now = []
        now.append(m)
        last = m.end()
        tail = re.search(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]*$", word)[0]
        closes = bool(re.search(r"[.!?]", tail))
    return out + [now] if now else out


def brute(rows, least):
    key = lambda u: tuple("".join(c.lower() if c.isascii() else c for c in m[0]) for m in u)
    first = {}
    rank = lambda i: (i is None, i or 0)
    for i, t in sorted(((i, t) for i, t in rows if t), key=lambda x: (rank(x[0]), x[1])):
        for n, u in enumerate(units(t)):
            if key(u) not in first:
                first[key(u)] = (i, n)
            elif first[key(u)][0] == i and n < first[key(u)][1]:
                first[key(u)] = (i, n)
    out = []
    for i, t in rows:
        gone = 0
        us = units(t or "")
        run = []
        for n, u in [*enumerate(us), (None, None)]:
            if u is not None and first[key(u)] != (i, n):
                run.append(u)
                continue
            if sum(map(len, run)) >= least:
                gone += len(run)
            run = []
        out.append((i, len(us), gone))
    return out


def check(spark, rows, least):
    got = substring_dedup.dedup(docs(spark, rows), least).collect()
    assert sorted((str(r.doc_id), r.n_units, r.n_removed) for r in got) == sorted((str(i), n, g) for i, n, g in brute(rows, least))
    return {r.doc_id: r for r in got}


def test_passages(spark):
    rows = [
        (1, "My own start. " + PASSAGE), (2, "Another text\n" + PASSAGE + "\nwith an end"), (3, PASSAGE.upper()), (4, "unfinished start " + PASSAGE + " More."),
        (5, "Clean text. Short. Nothing repeats, but a word."), (6, "One line that is here twice\n" * 6 + "tail"),
    ]
    got = check(spark, rows, 20)
    assert got[1].text == rows[0][1] and not got[1].removed_spans
    assert got[2].text == "Another text\nwith an end"
    assert got[3].text == ""
    assert "seven" not in got[4].text and got[4].text.startswith("unfinished start Alpha")
    assert got[5].text == rows[4][1]
    assert got[6].text == "One line that is here twice\ntail"
    for i, t in rows:
        r = got[i]
        keep, at = "", 0
        for s in r.removed_spans:
            keep, at = keep + t[at : s["start"]], s["end"]
        assert keep + t[at:] == r.text


def test_odd_rows(spark):
    check(spark, [*ODD, (10, "long " * 3000), (11, "five words are in here")], 3)


def test_tables(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    check(spark, rows, 20)


def test_empty(spark):
    assert substring_dedup.dedup(docs(spark, [])).count() == 0


def test_keeps_other_columns(spark):
    df = docs(spark, [(1, PASSAGE), (2, PASSAGE)]).withColumnRenamed("lang", "_repeats_").withColumnRenamed("source", "h1")
    out = substring_dedup.strip_repeats(df)
    assert out.columns[: len(df.columns)] == df.columns and out.count() == 2


def lines(text):
    """Numbers of the units of each line."""
    out, last = [], None
    for n, u in enumerate(units(text)):
        if last is None or "\n" in text[last : u[0].start()]:
            out.append([])
        out[-1].append(n)
        last = u[-1].end()
    return out


def brute_lines(rows, least, chars):
    """As brute(), for distinct doc_ids that are not null, with whole lines removed whatever their length."""
    key = lambda us: tuple("".join(c.lower() if c.isascii() else c for c in m[0]) for u in us for m in u)
    first, seen = {}, set()
    out = []
    for i, t in sorted((i, t or "") for i, t in rows):
        us, whole, part = units(t), set(), set()
        for line in lines(t):
            k = key([us[n] for n in line])
            if len(line) > 1 and k in seen:
                whole.update(line)
            seen.add(k)
        for n, u in enumerate(us):
            if first.setdefault(key([u]), (i, n)) != (i, n):
                part.add(n)
        whole.update(line[0] for line in lines(t) if len(line) == 1 and line[0] in part)
        gone, run = set(whole), []
        for n in [*range(len(us)), None]:
            if n is not None and n in part | whole:
                run.append(n)
                continue
            if run and (sum(len(us[x]) for x in run) >= least or us[run[-1]][-1].end() - us[run[0]][0].start() >= chars):
                gone.update(run)
            run = []
        out.append((i, len(us), len(gone)))
    return out


def test_every_repeated_line_goes(spark):
    licence, chinese = "Licensed under the terms of the file.", "这是一个没有空格的段落，它出现了两次。"
    rows = [
        (1, f"Own words\n{licence}\nmore own"), (2, f"{licence}\nOther words here"), (3, f"Third\n{chinese}"), (4, f"{chinese}\nFourth"), (5, "a. b. c"), (6, "x a. b."),
        (7, "b. a."), (8, f"q. {chinese * 6}."), (9, f"r. {chinese * 6}. s."), (10, "Yes. No.\nend"), (11, "start\nYES.  no."),
    ]
    got = {r.doc_id: r for r in substring_dedup.dedup(docs(spark, rows), 20, every_line=True, least_chars=100).collect()}
    assert [(i, got[i].n_units, got[i].n_removed) for i, _ in rows] == brute_lines(rows, 20, 100)
    assert got[2].text == "Other words here" and got[4].text == "Fourth" and got[11].text == "start"
    assert got[6].text == "x a. b." and got[7].text == "b. a."  # its sentences occurred, but only apart
    assert got[9].text == "r. s."


def test_query_on_tables(spark):
    from parlance.llm import queries

    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = queries.op3_substring_dedup(spark, "/root/testdata/sf0.001").collect()
    assert sorted((r.doc_id, r.n_units, r.n_removed) for r in got) == brute_lines(rows, 20, 100)
    assert sum(r.n_removed for r in got) > sum(n for _, _, n in brute(rows, 20))


def test_rows_without_an_id_are_told_apart(spark):
    """Texts of equal crc32 and no doc_id, one of them shorter than the other."""
    import random
    import zlib

    seen, pair, r = {}, None, random.Random(1)
    for _ in range(400_000):
        t = f"w{r.getrandbits(60):x} and more" + " then one more" * r.randrange(2)
        if pair is None and (crc := zlib.crc32(t.encode())) in seen:
            pair = seen[crc], t
        seen[crc] = t
    a, b = pair
    line = "A line that is in many rows."
    rows = [(None, a), (None, b), (1, f"own\n{line}"), (None, f"{line}\n{a}")]
    got = sorted((str(r.doc_id), r.text) for r in substring_dedup.dedup(docs(spark, rows), 20, every_line=True).collect())
    assert len(got) == 4 and ("None", b) in got and ("1", rows[2][1]) in got
    assert sum(t.count(a) for _, t in got) == 1 and sum(t.count(line) for _, t in got) == 1


def test_one_id_with_two_texts_and_repeated_rows(spark):
    line = "A line that both texts hold."
    rows = [(5, f"first\n{line}"), (5, f"second\n{line}"), (6, line), (6, line), (7, None), (None, None), (None, "")]
    got = [(r.doc_id, r.text) for r in substring_dedup.dedup(docs(spark, rows), 20, every_line=True).collect()]
    assert len(got) == len(rows) and sorted(t for i, t in got if i == 6) == ["", ""]
    assert sum(line in t for i, t in got if i == 5) == 1 and (7, None) in got and (None, None) in got


def test_columns_that_clash(spark):
    df = docs(spark, [(1, PASSAGE), (2, PASSAGE)])
    for a, b in (("lang", "_did"), ("source", "_removed"), ("n_chars", "_spans")):
        df = df.withColumnRenamed(a, b)
    df = df.withColumn("_tid", df.doc_id).withColumn("a.b", df.doc_id)
    out = substring_dedup.keep_rest(df)
    assert out.columns == df.columns and sorted(r.text for r in out.collect()) == ["", PASSAGE]
