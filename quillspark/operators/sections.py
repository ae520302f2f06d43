"""Section detection and chunking, as one narrow chain of expressions.

A text runs through four levels: bracket tags, plain label lines, blank
lines, and packing by length.  The first two mark their boundaries in the text
with two control characters and one split turns the marks into segments, so
that a song is scanned a fixed number of times and never leaves the JVM.
Input that holds these control characters loses them.

A label line inside a tag of several lines is a boundary: what is left of the
tag behind it belongs to the label's body, what stands before it to nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

# Section names, and what of the text names them.
SINGLE_NAMES = {
    "verse": "Verse",
    "chorus": "Chorus",
    "bridge": "Bridge",
    "hook": "Hook",
    "outro": "Outro",
    "intro": "Intro",
    "refrain": "Refrain",
    "interlude": "Interlude",
    "instrumental": "Instrumental",
}
PAIR_NAMES = {"pre chorus": "Pre-Chorus", "post chorus": "Post-Chorus"}
TARGET_WORDS = 80
CEILING_WORDS = 120

_OPEN, _SHUT = "\x01", "\x02"
_SEGMENT = "array<struct<text:string,section:string,split_by:string>>"
_CHUNK = "array<struct<text:string,section:string,split_by:string,force_split:boolean>>"


def _named(key: Column, names: dict[str, str]) -> Column:
    return reduce(lambda chain, kv: chain.when(key == kv[0], kv[1]), list(names.items())[1:], F.when(key == next(iter(names)), next(iter(names.values()))))


def _alpha(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit("[A-Za-z]+"), F.lit(0)), F.lower)


def _pair(tokens: Column) -> Column:
    return _named(F.concat_ws(" ", F.get(tokens, F.lit(0)), F.get(tokens, F.lit(1))), PAIR_NAMES)


def bracket_section(content: Column) -> Column:
    """The section a bracket tag names; null for credits and noise.

    The tag's leading word names it, or its first two words do; a tag whose
    first character is no letter names nothing.
    """
    stripped = tx.strip(content)
    leading = F.lower(F.regexp_extract(stripped, "^[A-Za-z]+", 0))
    return F.when(leading != "", F.coalesce(_named(leading, SINGLE_NAMES), _pair(_alpha(stripped))))


def bracket_kind(content: Column) -> Column:
    """canonical, credits or (without any ASCII letter) noise."""
    return F.when(~content.rlike("[A-Za-z]"), "noise").when(bracket_section(content).isNotNull(), "canonical").otherwise("credits")


def label_section(line: Column) -> Column:
    """The section a line of one or two words names by itself; null for other lines."""
    raw = tx.strip(line)
    tokens = _alpha(raw)
    first = F.coalesce(_named(F.get(tokens, F.lit(0)), SINGLE_NAMES), _named(F.get(tokens, F.lit(1)), SINGLE_NAMES))
    two = F.when(F.size(tokens) == 2, _pair(tokens))
    return F.when(F.size(tokens).between(1, 2) & ~raw.rlike(r"[\[\]]"), F.coalesce(two, first))


def outer_segments(text: Column) -> Column:
    """Levels one and two: the bodies between tags and label lines, in order.

    What stands before the first boundary has no section and split_by 'none',
    and so has a text without any boundary.  Empty bodies are left out.
    """
    plain = F.translate(text, _OPEN + _SHUT, "")
    no_noise = F.regexp_replace(plain, r"\[[^\]A-Za-z]*\]", "")
    lines = F.transform(
        F.split(no_noise, "\n", -1),
        # only short lines can be labels; the pattern spares the others the work
        lambda x: F.when(x.rlike(r"^[^A-Za-z\[\]]*[A-Za-z]+[^A-Za-z\[\]]*([A-Za-z]+[^A-Za-z\[\]]*)?$"), F.coalesce(F.concat(F.lit(_OPEN + "P"), label_section(x), F.lit(_SHUT)), x)).otherwise(x),
    )
    joined = F.array_join(lines, "\n")
    # a tag that a label cuts: its beginning is a boundary without a body, its end is text
    cut = F.regexp_replace(joined, rf"\[([^\]{_OPEN}]*)({_OPEN}P[^\]]*\])", _OPEN + "B$1$2")
    marked = F.regexp_replace(cut, rf"\[([^\]{_OPEN}]*)\]", _OPEN + "B$1" + _SHUT)
    parts = F.split(marked, _OPEN, -1)

    def segment(part: Column, i: Column) -> Column:
        head = F.substring_index(part, _SHUT, 1)
        body = tx.strip(F.substr(part, F.length(head) + F.lit(2)))
        section = F.when(head.startswith("P"), F.substr(head, F.lit(2))).otherwise(bracket_section(F.substr(head, F.lit(2))))
        split_by = F.when(head.startswith("P"), "plain_label").otherwise("bracket_tag")
        lead = F.struct(tx.strip(part).alias("text"), F.lit(None).cast("string").alias("section"), F.lit("none").alias("split_by"))
        return F.when(i == 0, lead).otherwise(F.struct(body.alias("text"), section.alias("section"), split_by.alias("split_by")))

    return F.filter(F.transform(parts, segment), lambda s: s["text"] != "").cast(_SEGMENT)


def refine_by_blank_lines(segments: Column) -> Column:
    """Level three: a segment of several paragraphs becomes one segment each."""

    def refined(s: Column) -> Column:
        parts = F.filter(F.transform(F.split(s["text"], rf"(?U)\n{tx.SPACE}*\n"), tx.strip), lambda p: p != "")
        cut = F.transform(parts, lambda p: F.struct(p.alias("text"), s["section"].alias("section"), F.lit("blank_line").alias("split_by")))
        return F.when(F.size(parts) > 1, cut).otherwise(F.array(s))

    return F.flatten(F.transform(segments, refined)).cast(_SEGMENT)


def split_long_line(line: Column, ceiling: int) -> Column:
    """A line above the ceiling by its sentences, or in groups of words if it is one sentence."""
    sentences = F.split(line, rf"(?U)(?<=[.!?]){tx.SPACE}+")
    words = tx.split_words(line)
    n = F.ceil(F.size(words) / F.lit(ceiling)).cast("int")
    groups = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.array_join(F.slice(words, i * ceiling + 1, F.lit(ceiling)), " "))
    return F.when(F.size(sentences) == 1, groups).otherwise(F.filter(sentences, lambda x: tx.strip(x) != ""))


def pack_by_length(text: Column, target: int = TARGET_WORDS, ceiling: int = CEILING_WORDS) -> Column:
    """Lines packed greedily to the target, never above the ceiling but for single sentences."""
    lines = F.filter(F.split(text, "\n"), lambda x: tx.strip(x) != "")
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("done"), F.lit("").alias("cur"), F.lit(0).alias("n"))

    def flushed(done: Column, cur: Column) -> Column:
        return F.when(cur != "", F.concat(done, F.array(cur))).otherwise(done)

    def state(done: Column, cur: Column, n: Column) -> Column:
        return F.struct(done.alias("done"), cur.alias("cur"), n.cast("int").alias("n"))

    def step(s: Column, line: Column) -> Column:
        w = tx.word_count(line)
        over = s["n"] + w > ceiling
        cur = F.when(over | (s["cur"] == ""), line).otherwise(F.concat(s["cur"], F.lit("\n"), line))
        n = F.when(over, w).otherwise(s["n"] + w)
        done = F.when(over, flushed(s["done"], s["cur"])).otherwise(s["done"])
        return (
            F.when(w > ceiling, state(F.concat(flushed(s["done"], s["cur"]), split_long_line(line, ceiling)), F.lit(""), F.lit(0)))
            .when(n >= target, state(F.concat(done, F.array(cur)), F.lit(""), F.lit(0)))
            .otherwise(state(done, cur, n))
        )

    return F.aggregate(lines, start, step, lambda s: flushed(s["done"], s["cur"]))


def pack_segments(segments: Column, target: int = TARGET_WORDS, ceiling: int = CEILING_WORDS) -> Column:
    """Level four: segments above the ceiling in pieces with single blanks, the others untouched."""

    def packed(s: Column) -> Column:
        piece = lambda p, forced: F.struct(p.alias("text"), s["section"].alias("section"), s["split_by"].alias("split_by"), F.lit(forced).alias("force_split"))
        pieces = F.filter(F.transform(pack_by_length(s["text"], target, ceiling), tx.collapse_whitespace), lambda p: p != "")
        return F.when(tx.word_count(s["text"]) > ceiling, F.transform(pieces, lambda p: piece(p, True))).otherwise(F.array(piece(s["text"], False)))

    return F.flatten(F.transform(segments, packed)).cast(_CHUNK)


def by_sections(text: Column) -> Column:
    return pack_segments(refine_by_blank_lines(outer_segments(text)))


def whole_song(text: Column) -> Column:
    """One segment of all bodies without their tags; none for an empty song."""
    body = tx.strip(F.array_join(F.transform(outer_segments(text), lambda s: s["text"]), "\n"))
    whole = F.struct(body.alias("text"), F.lit(None).cast("string").alias("section"), F.lit("none").alias("split_by"), F.lit(False).alias("force_split"))
    return F.when(body != "", F.array(whole)).otherwise(F.array().cast(_CHUNK)).cast(_CHUNK)


STRATEGIES = {"sections": by_sections, "whole_song": whole_song}


def chunk_songs(songs: DataFrame, strategy: str = "sections") -> DataFrame:
    """chunk_id, song_id, section, text, position, split_by, force_split; null text has no chunks."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown chunking strategy {strategy!r}; expected one of {', '.join(STRATEGIES)}")
    pieces = songs.select("song_id", F.posexplode(STRATEGIES[strategy](F.col("text_raw"))).alias("position", "c"))
    return pieces.select(
        F.concat_ws(":", "song_id", "position").alias("chunk_id"), "song_id", "c.section", "c.text", "position", "c.split_by", "c.force_split"
    )


def oversized_segments(songs: DataFrame, ceiling: int = CEILING_WORDS) -> DataFrame:
    """(song_id, n_oversized): segments that level four has to cut, one row per song that has any."""
    big = F.filter(refine_by_blank_lines(outer_segments(F.col("text_raw"))), lambda s: tx.word_count(s["text"]) > ceiling)
    return songs.select("song_id", F.size(big).alias("n_oversized")).where("n_oversized > 0")


def untagged_paragraphs(text: Column) -> Column:
    """The plain chunker: tags away, paragraphs apart, blank ones out."""
    return F.filter(F.transform(F.split(F.regexp_replace(text, r"\[.*?\]", ""), rf"(?U)\n{tx.SPACE}*\n"), tx.strip), lambda p: p != "")
