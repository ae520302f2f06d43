import hashlib
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as tx

TEXTS = ["", "  a b \n c\t", "Don't stop — CAFÉ naïve", "x_1 y2, ß ﬁ", " mid\x1csep\u0085end ", "line one\n\n  line two  \nthree", "“quoted” 12 a bb ccc", "a" * 100]


def strip_marks(t):
    return "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))


CASES = {
    "tokenize_words": (tx.tokenize_words, lambda t: [w.lower() for w in re.findall("[A-Za-z']+", t)]),
    "tfidf_terms": (tx.tfidf_terms, lambda t: re.findall(r"(?u)\b\w\w+\b", t.lower())),
    "collapse": (tx.collapse_whitespace, lambda t: " ".join(t.split())),
    "strip": (tx.strip, str.strip),
    "word_count": (tx.word_count, lambda t: len(t.split())),
    "for_id": (tx.normalize_for_id, lambda t: " ".join(strip_marks(t).lower().split())),
    "for_dedupe": (tx.normalize_for_dedupe, lambda t: " ".join(re.sub(r"[^\w\s]", " ", strip_marks(t).lower()).split())),
    "preview": (tx.preview, lambda t: t[:80]),
    "truncate": (lambda c: tx.truncate(c, 10), lambda t: t if len(t) <= 10 else t[:9].rstrip(" ") + "…"),
}


@pytest.mark.parametrize("name", CASES)
def test_against_python(spark, name):
    column, plain = CASES[name]
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    got = {r.i: r.v for r in df.select("i", column(F.col("t")).alias("v")).collect()}
    assert got == {i: plain(t) for i, t in enumerate(TEXTS)}


@pytest.mark.parametrize("name", CASES)
def test_null_stays_null(spark, name):
    df = spark.createDataFrame([(None,)], "t string")
    assert df.select(CASES[name][0](F.col("t")).alias("v")).first().v in (None, -1)


def test_song_id(spark):
    df = spark.createDataFrame([(" BJÖRK ", "Jóga  x"), ("bjork", "joga x"), (None, None)], "a string, t string")
    ids = [r.v for r in df.select(tx.make_song_id(F.col("a"), F.col("t")).alias("v")).collect()]
    assert ids[0] == ids[1] == hashlib.sha1(b"bjork|joga x").hexdigest()[:16]
    assert ids[2] == hashlib.sha1(b"|").hexdigest()[:16]


def test_normalising_twice_changes_nothing(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for f in (tx.normalize_for_id, tx.normalize_for_dedupe, tx.collapse_whitespace):
        once = f(F.col("t"))
        assert df.where(f(once) != once).count() == 0


def test_snippet_and_block(spark):
    t = "\n\n" + "\n".join(f"line {i}" for i in range(12))
    df = spark.createDataFrame([(t,), ("a" * 100 + "\nb",), (" \n ",)], "t string")
    got = [tuple(r) for r in df.select(tx.snippet(F.col("t")), tx.lyrics_block(F.col("t"))).collect()]
    assert got[0] == ("line 0 / line 1", "\n".join(f"line {i}" for i in range(8)) + "\n… 4 more lines")
    assert got[1][0] == "a" * 89 + "… / b" and got[2] == ("", "")


@pytest.mark.parametrize(
    "raw,mode",
    [
        ('{"paraphrase": "p", "description": "d"}', "strict"),
        ('Sure:\n```json\n{"paraphrase": "p", "description": "d"}\n```', "fenced"),
        ('{"paraphrase": "p"}', "missing_field"),
        ("nothing here", "unparseable"),
        ("{broken", "unparseable"),
        ("", "unparseable"),
    ],
)
def test_replies(spark, raw, mode):
    obj, m = tx.parse_reply(F.col("r"))
    row = spark.createDataFrame([(raw,)], "r string").select(m.alias("m"), obj["paraphrase"].alias("p")).first()
    assert row.m == mode and row.p == ("p" if mode in ("strict", "fenced") else None)


def test_chunk_key(spark):
    df = spark.createDataFrame([("a:b:12",), ("x:0",), ("none",)], "c string")
    assert [r.v for r in df.select(tx.song_of_chunk(F.col("c")).alias("v")).collect()] == ["a:b", "x", "none"]
