"""Small tables with the awkward rows that every operator must stand."""

import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG_LINE = "this line is long enough to be looked at by the key rule"
#: Columns whose names clash with what operators use inside or return.
EXTRA = "score double, token string, n string, key string, sid string, label string, group string"
EDGE = [
    (1, "The quick brown fox jumps over the lazy dog today.", "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, "a"),
    (4, " \t\n ", "en", None),
    (5, "Der schnelle braune Fuchs springt über den faulen Hund. ÄÖÜ ß", "de", "b"),
    (6, "a" * 20_000, "en", "b"),
    (7, "word " * 8_000, "en", "b"),
    (8, "The quick brown fox jumps over the lazy dog today.", "en", "b"),
    (8, "The quick brown fox jumps over the lazy dog today.", "en", "b"),
    (9, "12345 !!! ??? \U0001F600 日本語 \x1c <|endoftext|>", "fr", "b"),
    (None, "no id at all", "en", "b"),
    (None, None, None, None),
    (10, "\n".join([LONG_LINE, "x", LONG_LINE.upper()]), "en", "c"),
]
DDL = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, extra=True):
    full = [(*r, None if r[1] is None else len(r[1])) for r in rows]
    df = spark.createDataFrame(full, DDL)
    return df.selectExpr("*", *[f"cast(null as {x.split()[1]}) as {x.split()[0]}" for x in EXTRA.split(", ")]) if extra else df


def edge(spark):
    return frame(spark, EDGE)


def empty(spark):
    return frame(spark, [])


def remainder(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def sorted_rows(df):
    return sorted(map(tuple, df.collect()), key=repr)
