"""Fill-in-middle transformation: a text is cut in two places and its pieces change places, so that a left-to-right model learns to fill gaps.

A text becomes an array of code points (UTF-32). Each code point has a class, neighbours of different classes are the
bounds of units, and two bounds chosen by rank, that before the first unit and that after the last one included, cut
the text into prefix, middle and suffix. Units are single code points (`char`), runs of white space or of anything else
(`word`) or lines with their end (`line`). Pieces are slices of the array, encoded again and joined by markers: `psm` is
prefix, suffix, middle; `spm` suffix, prefix, middle. A text that holds a marker, a share of the others, and empty texts
stay as they are (`plain`). As no marker can begin inside another one or run into it from a piece, restored() finds the
text again from output and form alone.

Ranks and form depend on doc_id and seed only: h1 to h4 are the first four groups of eight digits of the hex sha256 of
`seed:doc_id`; the cuts lie at h1 and h2 modulo units + 1, the text is plain if h3 modulo 100 is `share` or more, and spm
if h4 modulo 100 is less than `spm`. Rows stand alone and no row is moved: repeated rows give equal results, a row without a
doc_id has no hash and is plain, a null text counts as empty and is returned as an empty one. Texts of any length are cut
whole, one at a time. Bytes that are not UTF-8 count as a code point each and come back as they were. An empty table gives
an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm._cluster import tidy
from parlance.session import ship

MARKERS = ("<P>", "<S>", "<M>")
#: White space by code point: blanks, controls such as tab and newline, and Unicode's other spaces.
SPACES = np.array([9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)
UNITS = ("char", "word", "line")


def points(raw: bytes) -> np.ndarray:
    """The code points of UTF-8 text."""
    return np.frombuffer(raw.decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32)


def encoded(part: np.ndarray) -> bytes:
    """UTF-8 of code points."""
    return part.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogateescape")


def classes(text: np.ndarray, unit: str) -> np.ndarray:
    """A class for each code point; where it differs from the one before, a unit begins."""
    if unit == "char":
        return np.resize(np.array([0, 1], np.uint8), len(text))
    if unit == "word":
        return np.isin(text, SPACES)
    ended = np.zeros(len(text), np.int64)
    ended[1:] = np.cumsum(text[:-1] == 10)
    return ended


def bounds(text: np.ndarray, unit: str) -> np.ndarray:
    """Where units begin, and the end of the text; one bound, 0, for an empty text."""
    kind = classes(text, unit)
    inner = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    return np.concatenate([[0], inner, [len(text)]]) if len(text) else np.zeros(1, np.int64)


def _cut(unit: str, share: int, spm: int, markers: tuple[str, str, str]):
    p, s, m = (x.encode() for x in markers)

    def run(batches):
        for batch in batches:
            rows = []
            for doc, text, h in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                raw, h = text.as_py() or b"", h.as_py()
                units = points(raw)
                plain = not raw or h is None or h[2] % 100 >= share or any(x in raw for x in (p, s, m))
                if plain:
                    rows.append((doc.as_py(), len(units), "plain", None, None, raw))
                    continue
                at = bounds(units, unit)
                first, last = sorted((at[h[0] % len(at)], at[h[1] % len(at)]))
                before, middle, after = encoded(units[:first]), encoded(units[first:last]), encoded(units[last:])
                form = "spm" if h[3] % 100 < spm else "psm"
                out = s + after + p + before + m + middle if form == "spm" else p + before + s + after + m + middle
                rows.append((doc.as_py(), len(units), form, int(first), int(last - first), out))
                del units, at
            kinds = pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def transform(docs: DataFrame, seed: int = 1, unit: str = "char", share: int = 90, spm: int = 20, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """(doc_id, n code points, form, prefix_chars, middle_chars, output) for every row of docs."""
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    if any(len(x) < 2 or x[0] in x[1:] or x[0] != markers[0][0] for x in markers) or len(set(markers)) < 3 or any(a != b and b.startswith(a) for a in markers for b in markers):
        raise ValueError("markers must begin with one character, which none holds again, and none may begin another")
    ship(docs.sparkSession)
    doc = F.col("doc_id").cast("long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), doc.cast("string")), 256)
    h = F.when(doc.isNotNull(), F.array(*(F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4))))
    rows = docs.select(doc.alias("doc_id"), F.col("text").cast("binary").alias("text"), h.alias("h"))
    out = rows.mapInArrow(tidy(_cut(unit, share, spm, markers)), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")
    return out.withColumn("output", F.col("output").cast("string"))


def restored(output: str | Column = "output", form: str | Column = "form", markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text before the transformation, from output and form."""
    out, kind = (F.col(x) if isinstance(x, str) else x for x in (output, form))
    p, s, m = markers

    def between(a: str, b: str) -> Column:
        return F.substring_index(F.substring_index(out, b, 1), a, -1)

    middle = F.substring_index(out, m, -1)
    return F.when(kind == "psm", F.concat(between(p, s), middle, between(s, m))).when(kind == "spm", F.concat(between(p, m), middle, between(s, p))).otherwise(out)
