"""Text normalisation, tokenising and display, as column expressions.

White space means what it means for Unicode text (NBSP, the separators
U+001C to U+001F and so on), not only the blank.  Null stays null unless
stated otherwise.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

SPACE = r"[\s\x1c-\x1f]"
#: Lexical tokens of BM25 and word vectors: ASCII letters and apostrophes.
WORD_PATTERN = "[A-Za-z']+"
#: Terms of tf-idf and of the leak gate: runs of two word characters or more.
TERM_PATTERN = r"(?U)\b\w\w+\b"


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def collapse_whitespace(c: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(c, rf"(?U){SPACE}+", " "))


def tokenize_words(c: Column) -> Column:
    """Lexical tokens in lower case; the case changes after matching."""
    return F.transform(F.regexp_extract_all(c, F.lit(WORD_PATTERN), F.lit(0)), F.lower)


def tfidf_terms(c: Column) -> Column:
    """Terms of the tf-idf analyser; the case changes before matching."""
    return F.regexp_extract_all(F.lower(c), F.lit(TERM_PATTERN), F.lit(0))


def split_words(c: Column) -> Column:
    """Parts between white space."""
    return F.filter(F.split(c, rf"(?U){SPACE}+"), lambda x: x != "")


def word_count(c: Column) -> Column:
    return F.size(split_words(c))


@pandas_udf(T.StringType())
def fold_marks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility decomposition without combining marks (Spark has no such function)."""
    for texts in batches:
        yield texts.map(lambda t: t if t is None or t.isascii() else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


def normalize_for_id(c: Column) -> Column:
    """As ids compare text: no marks, lower case, single blanks; punctuation stays."""
    return collapse_whitespace(F.lower(fold_marks(c)))


def make_song_id(artist: Column, title: Column) -> Column:
    """First 16 hex digits of the SHA-1 of ``artist|title``; null parts count as empty."""
    part = lambda c: normalize_for_id(F.coalesce(c, F.lit("")))
    return F.substring(F.sha1(F.concat(part(artist), F.lit("|"), part(title))), 1, 16)


def normalize_for_dedupe(c: Column) -> Column:
    """As blocks compare: as ids, and everything but word characters becomes a blank."""
    return collapse_whitespace(F.regexp_replace(F.lower(fold_marks(c)), r"[^\p{L}\p{N}_\s]", " "))


def hash_block(c: Column) -> Column:
    return F.sha1(normalize_for_dedupe(c))


def preview(c: Column, width: int = 80) -> Column:
    return F.substring(c, 1, width)


def one_line_preview(c: Column, width: int = 80) -> Column:
    """The first characters with line breaks as blanks, as result lists show them."""
    return F.translate(F.substring(c, 1, width), "\n", " ")


def truncate(c: Column, width: int) -> Column:
    """Cut to ``width`` with an ellipsis in place of what is cut."""
    return F.when(F.length(c) <= width, c).otherwise(F.concat(F.rtrim(F.substring(c, 1, width - 1)), F.lit("…")))


def snippet(c: Column, *, max_lines: int = 2, max_chars: int = 90) -> Column:
    """The first lines that are not blank, each truncated, joined by slashes."""
    lines = F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != "")
    return F.array_join(F.transform(F.slice(lines, 1, max_lines), lambda x: truncate(x, max_chars)), " / ")


def lyrics_block(c: Column, *, shown: int = 8) -> Column:
    """The first lines without leading blank ones, and how many more there are."""
    lines = F.transform(F.split(c, "\n"), lambda x: F.regexp_replace(x, rf"(?U){SPACE}+$", ""))
    first = F.array_position(F.transform(lines, lambda x: x != ""), True)
    body = F.when(first > 0, F.slice(lines, first.cast("int"), F.size(lines))).otherwise(F.array().cast("array<string>"))
    more = F.size(body) - shown
    head = F.array_join(F.slice(body, 1, shown), "\n")
    return F.when(more > 0, F.concat(head, F.lit("\n… "), more.cast("string"), F.lit(" more lines"))).otherwise(head)


def song_of_chunk(chunk_id: Column) -> Column:
    """The part of a chunk id before its last colon."""
    return F.regexp_replace(chunk_id, ":[^:]*$", "")


def fold_key(c: Column, layout_from: str, layout_to: str) -> Column:
    """A key press in lower case, mapped from another keyboard layout."""
    return F.translate(F.lower(c), layout_from, layout_to)


REPLY = T.StructType([T.StructField("paraphrase", T.StringType()), T.StructField("description", T.StringType())])


def parse_reply(raw: Column) -> tuple[Column, Column]:
    """(object, mode) of a model's reply: strict JSON, JSON in a code fence, else what is wrong."""
    fence = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    strict = F.from_json(F.when(strip(raw).startswith("{"), raw), REPLY, {"mode": "PERMISSIVE"})
    fenced = F.from_json(F.when(fence != "", fence), REPLY, {"mode": "PERMISSIVE"})
    known = lambda c: c["paraphrase"].isNotNull() | c["description"].isNotNull()
    whole = lambda c: c["paraphrase"].isNotNull() & c["description"].isNotNull()
    mode = (
        F.when(whole(strict), "strict")
        .when(whole(fenced), "fenced")
        .when(known(strict) | known(fenced), "missing_field")
        .otherwise("unparseable")
    )
    return F.when(mode == "strict", strict).when(mode == "fenced", fenced), mode
