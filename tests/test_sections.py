"""The section cascade against a plain restatement of its rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.operators import sections as sec

NAMES = sec.SINGLE_NAMES
PAIRS = sec.PAIR_NAMES


def of_tag(content):
    s = content.strip()
    lead = re.match("[A-Za-z]+", s)
    if not lead:
        return None
    words = [w.lower() for w in re.findall("[A-Za-z]+", s)]
    return NAMES.get(words[0]) or PAIRS.get(" ".join(words[:2]))


def of_label(line):
    words = [w.lower() for w in re.findall("[A-Za-z]+", line)]
    if not 1 <= len(words) <= 2 or "[" in line or "]" in line:
        return None
    if len(words) == 2 and " ".join(words) in PAIRS:
        return PAIRS[" ".join(words)]
    return next((NAMES[w] for w in words if w in NAMES), None)


def outer(text):
    """Walks through the text line by line and tag by tag."""
    text = re.sub(r"\[[^\]A-Za-z]*\]", "", text)
    marks = [(m.start(), m.end(), of_tag(m[1]), "bracket_tag") for m in re.finditer(r"\[([^\]]*)\]", text)]
    at = 0
    for line in text.split("\n"):
        if of_label(line):
            marks.append((at, at + len(line), of_label(line), "plain_label"))
        at += len(line) + 1
    marks = [(0, 0, None, "none"), *sorted(marks), (len(text), len(text), None, None)]
    found = [(text[a[1] : b[0]].strip(), a[2], a[3]) for a, b in zip(marks, marks[1:])]
    return [f for f in found if f[0]]


def refined(text):
    for body, section, how in outer(text):
        parts = [p.strip() for p in re.split(r"\n\s*\n", body) if p.strip()]
        yield from ((p, section, "blank_line") for p in parts) if len(parts) > 1 else [(body, section, how)]


def pieces_of(text, target, ceiling):
    groups, open_ = [], []
    words = lambda ls: sum(len(x.split()) for x in ls)
    for line in filter(str.strip, text.split("\n")):
        if len(line.split()) > ceiling:
            groups += [open_, *([x] for x in long_line(line, ceiling))]
            open_ = []
            continue
        if words(open_) + len(line.split()) > ceiling:
            groups.append(open_)
            open_ = []
        open_.append(line)
        if words(open_) >= target:
            groups.append(open_)
            open_ = []
    return [" ".join(" ".join(g).split()) for g in [*groups, open_] if g]


def long_line(line, ceiling):
    sentences = re.split(r"(?<=[.!?])\s+", line)
    if len(sentences) > 1:
        return [x for x in sentences if x.strip()]
    w = line.split()
    return [" ".join(w[i : i + ceiling]) for i in range(0, len(w), ceiling)]


def cascade(text):
    out = []
    for body, section, how in refined(text):
        if len(body.split()) <= 120:
            out.append((body, section, how, False))
        else:
            out += [(p, section, how, True) for p in pieces_of(body, 80, 120) if p]
    return out


def random_text(rng):
    parts = ["[Verse 1]", "[Chorus: X & Y]", "[?]", "[ ]", "[Produced by Z]", "[pre-chorus]", "[2x Hook]", "Chorus:", "Verse 2", "Post Chorus", "hook line", "bridge over water here", "word", "la la", "\n", "\n", "\n\n", "\n \n", " ", "end. Go!", "é x"]
    text = "".join(rng.choice(parts) + rng.choice(["", "\n", " "]) for _ in range(rng.randint(0, 25)))
    if rng.random() < 0.3:
        text += "\n".join(" ".join("w" * rng.randint(1, 3) + rng.choice(["", ".", "!"]) for _ in range(rng.randint(1, 160))) for _ in range(rng.randint(1, 8)))
    return text


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    fixed = ["", " \n ", "plain text", "[Verse]", "[Verse]\n\n[Chorus]\nla", "lead\n[?]\n[Outro]\nbye", "Intro\nhm", " ".join(["w"] * 121), "\n".join(["a b c d"] * 40), "One. " * 130]
    return fixed + [random_text(rng) for _ in range(800)]


def test_cascade_equals_the_rules(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: [tuple(x) for x in r.v] for r in df.select("i", sec.by_sections(F.col("t")).alias("v")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == cascade(t), t


def test_outer_and_whole(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.select("i", sec.outer_segments(F.col("t")).alias("o"), sec.whole_song(F.col("t")).alias("w")).collect()
    for r in rows:
        want = outer(texts[r.i])
        assert [tuple(x) for x in r.o] == want
        body = "\n".join(x[0] for x in want).strip()
        assert [x.text for x in r.w] == ([body] if body else [])


def test_chunking_a_chunk_changes_nothing(spark, texts):
    df = spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(texts)], "song_id string, text_raw string")
    chunks = sec.chunk_songs(df).where("not force_split").collect()
    plain = [c.text for c in chunks if not any(of_label(x) for x in c.text.split("\n"))]
    again = spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(plain)], "song_id string, text_raw string")
    assert {r.song_id: r.text for r in sec.chunk_songs(again).collect()} == {f"c{i}": t for i, t in enumerate(plain)}


def test_ids_and_positions(spark):
    df = spark.createDataFrame([("a", "[Verse]\nx y\n\n[Chorus]\nz"), ("n", None), ("e", "")], "song_id string, text_raw string")
    assert [(r.chunk_id, r.position, r.section) for r in sec.chunk_songs(df).orderBy("position").collect()] == [("a:0", 0, "Verse"), ("a:1", 1, "Chorus")]


def test_unknown_strategy(spark):
    with pytest.raises(ValueError, match="sections"):
        sec.chunk_songs(spark.createDataFrame([], "song_id string, text_raw string"), "verses")


@pytest.mark.parametrize("content,kind,section", [("Verse 1: X", "canonical", "Verse"), ("PRE-CHORUS", "canonical", "Pre-Chorus"), ("?", "noise", None), ("", "noise", None), ("12 Verse", "credits", None), ("Produced by A", "credits", None), (" Hook ", "canonical", "Hook")])
def test_brackets(spark, content, kind, section):
    df = spark.createDataFrame([(content,)], "c string").select(sec.bracket_kind(F.col("c")).alias("k"), sec.bracket_section(F.col("c")).alias("s"))
    assert tuple(df.first()) == (kind, section)


def test_label_lines_inside_a_tag(spark):
    texts = ["[Intro\nVerse\nby me] la la", "one [a\nChorus\nb\nBridge\nc]\nd", "[x [y\nHook\nz] w\n[Outro] v", "[open\nVerse\nno end", "Verse\n] la [Chorus]\nlo"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: [(s.text, s.section, s.split_by) for s in r.s] for r in df.select("i", sec.outer_segments(F.col("t")).alias("s")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == outer(t), t
