import public_tokenizers as P
from pyspark.sql import functions as F

from parlance.llm import token_count, unigram
from tests.llm.common import ODD, docs

HARD = [
    "", " ", "  ", "\n", "a  b", "a   b", "a \n b", "a\n\n b  ", "end \t", "it's we'll I'd  'tis", "x" * 70, "ab" * 900, " <|endoftext|> a<|endoftext|><|endoftext|>b ", "<|endoftext",
    "\x1c\x1d a\x1fb !\x1c!", "\x85\xa0 \u2003x\u3000y", "漢字かな 🙂🙃 ½ ² ١٢ é\u0301", "a\x00b \x7f", "....!!!??  ##", "1234 56.78", "Thhaen " * 50, "▁ ▁▁ a▁b", "<0x41> <s> </s> <unk>", "\t\tif x:\n\t\t    return", "ﬁ ① 𝔘 \ufffd",
]


def texts(spark):
    return HARD + [t for _, t in ODD if t] + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]


def varint(b, i):
    n = s = 0
    while True:
        n |= (b[i] & 127) << s
        s, i = s + 7, i + 1
        if b[i - 1] < 128:
            return n, i


def fields(b):
    i = 0
    while i < len(b):
        start = i
        key, i = varint(b, i)
        if key & 7 == 2:
            n, i = varint(b, i)
            i += n
        elif key & 7 == 0:
            _, i = varint(b, i)
        else:
            i += 4 if key & 7 == 5 else 8
        yield key >> 3, start, i


def as_unigram(path):
    """The same pieces and scores in a model that the library reads as a unigram one."""
    import sentencepiece

    b = open(path, "rb").read()
    out = b""
    for number, start, end in fields(b):
        part = b[start:end]
        if number == 2:
            _, at = varint(part, 0)
            n, at = varint(part, at)
            inner = part[at:]
            inner = b"".join(b"\x18\x01" if k == 3 else inner[x:y] for k, x, y in fields(inner))
            assert len(inner) == n
            part = part[:at] + inner
        out += part
    return sentencepiece.SentencePieceProcessor(model_proto=out)


def test_whole_tokens_are_proven():
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    v = token_count.Vocabulary(path)
    t = Tokenizer.from_file(path)
    assert len(v.whole) > 40_000
    for s in sorted(v.whole)[::97]:
        assert v.merged(s) == v._merged_long(s) == 1
    for s in [b" transformation", b"zzqqxx", b"aaaaaaaaaa" * 5, "Ünïcödé".encode()]:
        assert v.merged(s) == v._merged_long(s) == len(t.encode(s.decode(), add_special_tokens=False).ids)


def test_counts_match_the_library(spark):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    all_texts = texts(spark)
    got = token_count.count_tokens(docs(spark, list(enumerate(all_texts))), path).collect()
    for r in got:
        n = len(t.encode(all_texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(all_texts[r.doc_id].encode()), n > 512), all_texts[r.doc_id][:80]


def test_counts_of_odd_rows(spark):
    got = token_count.count_tokens(docs(spark, ODD), P.path("byte_bpe_50k.json"))
    assert got.count() == len(ODD) and got.where("doc_id = 1 and n_tokens = 0 and n_bytes = 0 and not over_limit").count() == 1
    assert token_count.count_tokens(docs(spark, []), P.path("byte_bpe_50k.json")).count() == 0


def test_long_text():
    c = token_count.Counter(token_count.Vocabulary(P.path("byte_bpe_50k.json")))
    text = "several words of a long text. " * 40_000
    assert c.count(text) == 40_000 * c.count(" several words of a long text.") - c.count(" several words of a long text.") + c.count("several words of a long text.") + 1


def plain_viterbi(text, scores, longest, unknown):
    """Pieces (or single unknown characters) of the greatest total score over the whole text, without cuts or a trie."""
    t = "▁" + text.replace(" ", "▁") if text else ""
    best, back = [0.0] + [float("-inf")] * len(t), [0] * (len(t) + 1)
    for i in range(len(t)):
        for j in range(i + 1, min(len(t), i + longest) + 1):
            s = scores.get(t[i:j], unknown if j == i + 1 else None)
            if s is not None and best[i] + s > best[j]:
                best[j], back[j] = best[i] + s, i
    out, j = [], len(t)
    while j:
        out.append(t[back[j] : j])
        j = back[j]
    return out[::-1]


def test_pieces_match_plain_viterbi(spark):
    path = P.path("piece_bpe_32k.model")
    m = unigram.Model(path)
    scores = {r.decode(): m.scores[i] for i, r in enumerate(m.raw) if r and i not in set(m.byte_ids.tolist())}
    ids = {r.decode(): i for i, r in enumerate(m.raw) if r and i not in set(m.byte_ids.tolist())}
    all_texts = [t[:6000] for t in texts(spark)]
    got = unigram.encode(docs(spark, list(enumerate(all_texts))), path).collect()
    assert len(got) == len(all_texts)
    for r in got:
        t = all_texts[r.doc_id]
        want = []
        for piece in plain_viterbi(t, scores, 16, m.unknown):
            want += [ids[piece]] if piece in ids else [int(m.byte_ids[b]) for b in piece.encode()]
        assert list(r.piece_ids) == want, t[:80]
        assert r.n_pieces == len(want) and (r.decodes or "▁" in t)


def test_scores_match_a_unigram_model(spark):
    """The library's lattice over the same pieces and scores finds no better spelling."""
    path = P.path("piece_bpe_32k.model")
    sp, m = as_unigram(path), unigram.Model(path)
    words = sorted({w for t in texts(spark)[len(HARD) :] for w in t.split(" ") if w and w.isalpha()})[::40]
    assert len(words) > 100
    for w, ids in zip(words, unigram.Encoder(m).encode(words), strict=True):
        theirs = sp.nbest_encode(w, nbest_size=2)[0]
        assert sum(m.scores[ids]) == sum(m.scores[theirs]), w


def test_round_trip_and_odd_rows(spark):
    path = P.path("piece_bpe_32k.model")
    df = docs(spark, ODD).withColumnRenamed("lang", "pieces")
    out = unigram.decode(unigram.encode(df, path), path)
    assert out.where(F.col("decoded") != F.coalesce("text", F.lit(""))).count() == 0
    assert out.where("not decodes").count() == 0 and out.count() == len(ODD)
    assert unigram.encode(docs(spark, []), path).count() == 0
    named = unigram.encode(docs(spark, ODD).withColumnRenamed("lang", "piece_ids").withColumnRenamed("source", "a.b"), path)  # the new columns make way
    assert named.columns == ["doc_id", "text", "piece_ids", "a.b", "n_chars", "_piece_ids", "n_pieces", "decodes"] and named.where("not decodes").count() == 0


def test_double_array():
    words = {b"a": 1, b"ab": 2, b"abc": 3, b"b": 4, "é".encode(): 5, b"\xff\x00": 6}
    t = unigram.DoubleArray(words)

    def find(w):
        s = 0
        for c in w:
            n = t.base[s] + c
            if t.base[s] == 0 or t.check[n] != s:
                return -1
            s = n
        return t.value[s]

    for w, k in words.items():
        assert find(w) == k
    assert find(b"ac") == find(b"c") == find(b"abcd") == -1
