"""Language identification by a byte convolutional network, trained and applied in numpy.

Bytes (A-Z lower case) are embedded in EMBED dimensions; filters of several widths pass over a window of WINDOW bytes,
each keeps its largest response, and softmax over these gives the languages. Training takes PIECES
windows of each of some DOCS texts: as many texts of each language, and at least LEAST, those of the least hash of doc_id
(one for each doc_id and language, the least of those that share it). Every language there is is learnt, so both the sample and
the softmax layer grow with the number of languages alone. Prediction cuts the whole text, of any length, into
windows, padded with blanks at its end, and averages their probabilities weighted by the letters in them.

Only text and lang of usable rows are learnt from; lang, source and doc_id never enter a prediction. A text that is
null or has no letters (Unicode category L: numerals such as ½ or Ⅷ are none) is `und` with score 0, and so is every
text when there is nothing to learn from. Ties go to the language first by name. Rows stand alone: repeated rows, null
ids and further columns make no difference; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm import _bytes as B
from parlance.llm._cluster import Scratch, small, tidy

WINDOW, EMBED, FILTERS, WIDTHS = 128, 8, 16, (2, 3, 4)
DOCS, LEAST, PIECES, EPOCHS, BATCH = 4000, 4, 3, 6, 128
#: Steps of the training a language at least, so that many languages are learnt too.
STEPS = 6
_LETTER = B.table([*range(65, 91), *range(97, 123), *range(128, 256)])


class Network:
    """Embedding, filters of each width, and the softmax layer."""

    def __init__(self, classes: int, seed: int = 5):
        r = np.random.Generator(np.random.PCG64(seed))
        draw = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        self.p = {"embed": draw(256, EMBED, scale=0.5), "out": draw(len(WIDTHS) * FILTERS, classes, scale=0.1), "bias": np.zeros(classes, np.float32)}
        for w in WIDTHS:
            self.p[f"w{w}"], self.p[f"b{w}"] = draw(w * EMBED, FILTERS, scale=(w * EMBED) ** -0.5), np.zeros(FILTERS, np.float32)

    def pooled(self, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """The largest response of each filter in each window; keep gets what gradients need."""
        n, length = x.shape
        if keep is None:  # places first: quicker to take the largest of
            e, out = self.p["embed"][np.ascontiguousarray(x.T)], []
            for w in WIDTHS:
                m = length - w + 1
                z = np.concatenate([e[k : k + m] for k in range(w)], 2).reshape(m * n, w * EMBED) @ self.p[f"w{w}"]
                out.append(np.maximum(z.reshape(m, n * FILTERS).max(0).reshape(n, FILTERS) + self.p[f"b{w}"], 0))
            return np.concatenate(out, 1)
        e = self.p["embed"][x]
        out = []
        for w in WIDTHS:
            m = length - w + 1
            seen = np.concatenate([e[:, k : k + m] for k in range(w)], 2).reshape(n * m, w * EMBED)
            z = (seen @ self.p[f"w{w}"]).reshape(n, m, FILTERS)
            top = z.max(1) + self.p[f"b{w}"]
            keep[w] = (seen.reshape(n, m, -1), z.argmax(1))
            out.append(np.maximum(top, 0))
        return np.concatenate(out, 1)

    def probabilities(self, x: np.ndarray, keep: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        h = self.pooled(x, keep)
        z = h @ self.p["out"] + self.p["bias"]
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        return p / p.sum(1, keepdims=True), h

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        keep: dict = {}
        p, h = self.probabilities(x, keep)
        n = len(x)
        p[np.arange(n), y] -= 1
        p /= n
        g = {"out": h.T @ p, "bias": p.sum(0), "embed": np.zeros_like(self.p["embed"])}
        dh = (p @ self.p["out"].T) * (h > 0)
        for k, w in enumerate(WIDTHS):
            seen, at = keep[w]
            d = dh[:, k * FILTERS : (k + 1) * FILTERS]
            best = np.take_along_axis(seen, at[:, :, None], 1)  # window, filter, inputs
            g[f"w{w}"] = np.einsum("nfi,nf->if", best, d)
            g[f"b{w}"] = d.sum(0)
            back = d[:, :, None] * self.p[f"w{w}"].T[None]
            for j in range(w):
                np.add.at(g["embed"], np.take_along_axis(x, at + j, 1), back[:, :, j * EMBED : (j + 1) * EMBED])
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 3e-3, seed: int = 7):
        r = np.random.Generator(np.random.PCG64(seed))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(a) for k, a in self.p.items()}
        t, steps = 0, max(1, epochs * -(-len(x) // BATCH))
        for _ in range(epochs):
            order = r.permutation(len(x))
            for a in range(0, len(x), BATCH):
                t += 1
                part = order[a : a + BATCH]
                now = rate * (1 - t / (steps + 1))
                for k, g in self.gradients(x[part], y[part]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = (self.p[k] - now * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self


def _windows(raw: np.ndarray) -> np.ndarray:
    n = -(-len(raw) // WINDOW)
    out = np.full(n * WINDOW, 32, np.uint8)
    out[: len(raw)] = B.LOWER[raw]
    return out.reshape(n, WINDOW)


def _samples(batches):
    for batch in batches:
        data, offsets = B.texts(batch.column(1))
        names, out = [], []
        for k, lang in enumerate(batch.column(0).to_pylist()):
            w = _windows(data[offsets[k] : offsets[k + 1]])
            w = w[_LETTER[w].any(1)]
            for row in w[np.unique(np.linspace(0, len(w) - 1, min(PIECES, len(w))).astype(int))] if len(w) else ():
                names.append(lang)
                out.append(row.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(out, pa.binary())], ["lang", "piece"])


def train(docs: DataFrame, usable: Column, most: int = DOCS):
    """(languages, network) from at most so many usable rows, or None if there are none."""
    s = Scratch(docs.sparkSession, "langid")
    rows = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    ids = s.table(rows.select("lang", F.col("doc_id").cast("long").alias("doc_id")).distinct())
    sizes = s.table(ids.groupBy("lang").agg(F.count("*").alias("n")))
    each = max(LEAST, most // max(1, sizes.count()))
    place = F.xxhash64("doc_id")
    # only the least hashes meet in one task: several times as many as are wanted, whatever the language's share of the corpus
    near = ids.join(small(sizes), "lang").where(F.pmod(place, F.lit(1 << 30)) < F.lit(16 * each + 64) / F.col("n") * (1 << 30))
    order = Window.partitionBy("lang").orderBy(F.pmod(place, F.lit(1 << 30)), "doc_id")
    chosen = s.table(near.withColumn("k", F.row_number().over(order)).where(F.col("k") <= each).select("lang", "doc_id"))
    chosen = small(chosen)
    texts = rows.select("lang", "doc_id", "text").join(chosen, ["lang", "doc_id"]).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    found = texts.select("lang", "text").mapInArrow(tidy(_samples), "lang string, piece binary").toArrow()
    if not found.num_rows:
        return None
    names = np.array(found["lang"].to_pylist())
    x = np.frombuffer(b"".join(found["piece"].to_pylist()), np.uint8).reshape(-1, WINDOW)
    order = np.lexsort((*x.T[:8], names))  # whatever order the rows came in
    langs, y = np.unique(names[order], return_inverse=True)
    counts = np.bincount(y)
    often = np.repeat(np.arange(len(y)), -(-counts.max() // (4 * counts))[y])  # so that rare languages are seen a quarter as often as the most frequent one
    s.keep()
    steps = -(-len(often) // BATCH)
    return langs.tolist(), Network(len(langs)).fit(x[order][often].astype(np.int64), y[often], max(EPOCHS, -(-STEPS * len(langs) // steps)))


def _predict(model, most: int = 32):
    def run(batches):
        langs, net = model.value
        step = max(1, (1 << 22) // len(langs))  # rows whose probabilities are held at a time
        for batch in (b.slice(a, step) for b in batches for a in range(0, max(1, b.num_rows), step)):
            n = batch.num_rows
            data, offsets = B.texts(batch.column(1))
            total, weight = np.zeros((n, len(langs))), np.zeros(n)
            held: list[np.ndarray] = []
            owners: list[np.ndarray] = []
            size = 0

            def flush(held, owners, total, weight):
                x, row = np.concatenate(held), np.concatenate(owners)
                for a in range(0, len(x), most):
                    part, own = x[a : a + most], row[a : a + most]
                    share = _LETTER[part].sum(1).astype(np.float64)
                    p, _ = net.probabilities(part)
                    np.add.at(total, own, p * share[:, None])
                    np.add.at(weight, own, share)

            for k in range(n):
                raw = data[offsets[k] : offsets[k + 1]]
                for a in range(0, len(raw), WINDOW << 12):
                    w = _windows(raw[a : a + (WINDOW << 12)])
                    held.append(w)
                    owners.append(np.full(len(w), k))
                    size += len(w)
                    if size >= 1 << 13:
                        flush(held, owners, total, weight)
                        held, owners, size = [], [], 0
            if held:
                flush(held, owners, total, weight)
            blank = weight == 0
            for k in np.flatnonzero(~blank):
                raw = data[offsets[k] : offsets[k + 1]]
                if not (_LETTER[raw] & (raw < 128)).any() and not any(map(str.isalpha, raw.tobytes().decode())):
                    blank[k] = True
            share = total / np.maximum(weight, 1)[:, None]
            best = share.argmax(1)
            names = ["und" if b else langs[k] for b, k in zip(blank, best, strict=True)]
            score = np.where(blank, 0.0, np.clip(share[np.arange(n), best], 0, 1)) if n else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return run


def held_out() -> Column:
    """The fold that is never learnt from: crc32 of doc_id as text leaves 0 modulo 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of docs."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = train(docs, F.col("doc_id").isNotNull() & ~held_out())
    if model is None:
        return ids.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    return ids.mapInArrow(tidy(_predict(docs.sparkSession.sparkContext.broadcast(model))), "doc_id long, lang_pred string, score double")
