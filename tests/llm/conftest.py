from __future__ import annotations

import pytest

LONG = "word " * 60_000
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "id string, fp string, k1 string, h string, slot string, shard string, tokens string, domain string, rows string, copies string, text_hash string, language string"
)
#: (doc_id, text, lang, source)
ODD = [
    (1, "the quick brown fox jumps over the lazy dog and then it runs far away from here", "en", "src0"),
    (2, "the quick brown fox jumps over the lazy dog and then it runs far away from here", "en", "src0"),
    (2, "the quick brown fox jumps over the lazy dog and then it runs far away from here", "en", "src0"),
    (3, None, None, None),
    (4, "", "en", "src1"),
    (None, "a text without an id", "en", "src1"),
    (None, None, "de", None),
    (5, LONG, "en", "src2"),
    (6, "12345 67890 !!!", "en", "src2"),
    (7, "ein kurzer Text über die Straße und das Haus", "de", "src3"),
    (8, "\n\n \t\n", "de", "src3"),
    (9, "naïve 😀 𝔘nicode Ünïcode ß", None, "odd"),
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, lang, s, len(t) if t else None, *["x"] * 12) for i, t, lang, s in ODD]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
