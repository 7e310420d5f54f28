"""Small tables with every odd case, and extra columns whose names operators use themselves."""

from __future__ import annotations

EXTRA = ["fp", "key", "bin", "score", "kept", "taken", "slot", "component", "ids", "x.y"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)
WORDS = "the and of house river stone green walks under bright morning people bring water from old".split()


def prose(n: int, seed: int) -> str:
    return " ".join(WORDS[(i * i * 7 + i * seed + seed * seed) % len(WORDS)] + str((i * 31 + seed * 17) % 97) for i in range(n))


def odd_documents(spark):
    long = prose(60_000, 5)
    rows = [
        (1, prose(80, 1), "en", "a"), (1, prose(80, 1), "en", "a"), (2, prose(80, 1).upper(), "en", "b"), (3, prose(90, 2), "en", "a"),
        (4, "", "en", "a"), (5, None, "de", "b"), (6, " \t\n ", None, None), (7, long, "en", "a"), (8, long + " end", "en", None),
        (9, "das ist ein haus und der fluss", "de", "b"), (10, "日本語 テキスト", None, "b"), (11, "### 123 !!!", "en", "c"), (None, prose(70, 3), "en", "a"), (None, None, None, None),
        (12, "one", "en", "c"), (13, "a\nb\na\nb", "en", "c"), (14, "word " * 5000, "en", "c"),
    ]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *EXTRA) for r in rows], SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows=((1, 1, 0), (3, 1, 0), (7, 1, 0), (8, 0, 0), (None, 1, 0))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")
