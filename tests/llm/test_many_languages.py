import random

from parlance.llm import langid
from tests.llm.common import DOCS


def test_more_languages_than_any_fixed_number_are_learnt(spark):
    """Each with a few letters of its own out of some ten thousand."""
    r = random.Random(11)
    letters = [chr(c) for c in [*range(0x4E00, 0x9000), *range(0xAC00, 0xD000), *range(0x0400, 0x0500), *range(0x0531, 0x0557), *range(0x10A0, 0x10C6)]]
    rows = []
    for k in range(230):
        own = r.sample(letters, 12)
        text = lambda own=own: " ".join("".join(r.choice(own) for _ in range(r.randint(2, 5))) for _ in range(60))
        rows += [(k * 10 + i, text(), f"l{k:03}", "s", 1) for i in range(6)]
    table = spark.createDataFrame(rows, DOCS).repartition(3)
    got = langid.identify(table).join(table.select("doc_id", "lang"), "doc_id").collect()
    assert sum(x.lang == x.lang_pred for x in got) >= 0.95 * len(got)
    held = [x for x in got if langid_fold(x.doc_id)]
    assert len({x.lang_pred for x in got}) >= 225 and sum(x.lang == x.lang_pred for x in held) >= 0.9 * len(held) > 100


def langid_fold(doc_id):
    import zlib

    return zlib.crc32(str(doc_id).encode()) % 5 == 0
