import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import splitting as s

CHUNKS = "chunk_id string, song_id string, section string, text string, position int, split_by string, force_split boolean, piece int, n_words int"


def run(spark, rows, **how):
    full = [(i, "s", "Verse", t, 0, "none", None, 7, 7) for i, t in rows]
    out = {}
    for x in s.split_oversized(spark.createDataFrame(full, CHUNKS), **how).collect():
        out.setdefault(x.chunk_id, []).append(x)
    return {k: sorted(v, key=lambda x: x.piece) for k, v in out.items()}


def cut_at(text, limit=120):
    plain = text.replace("\r\n", "\n").replace("\r", "\n")
    for name, pattern in (("paragraph", r"\n\s*\n"), ("line", r"\n"), ("sentence", r"\n|(?<=[.!?])\s+")):
        if all(len(x.split()) <= limit for x in re.split(pattern, plain)):
            return name
    return "word"


def greedy(level, k0, limit, overlap):
    """Cuts one after the other, without tables."""
    n, at, cuts = len(level), 0, [0]
    while at < n:
        reach = min(n, at + (limit if at == 0 else limit - overlap))
        for k in range(k0, 4):
            far = max([b for b in range(at + 1, reach + 1) if b == n or level[b] <= k], default=None)
            if far is not None:
                break
        cuts.append(at := far)
    return cuts


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=50), min_size=1, max_size=4), st.integers(4, 9), st.integers(0, 3))
def test_squaring_gives_the_greedy_cuts(levels, limit, overlap):
    levels = [np.array([0, *x[1:]]) for x in levels]
    start = s.coarsest_levels(levels, limit)
    for x, k in zip(levels, start):
        fits = [np.diff([*np.flatnonzero(x <= j), len(x)]).max() <= limit for j in range(4)]
        assert k == (fits.index(True) if True in fits else 3)
    got = s.all_cuts([s.successors(x, k, limit, overlap) for x, k in zip(levels, start)])
    assert [list(g) for g in got] == [greedy(x, k, limit, overlap) for x, k in zip(levels, start)]


def test_pieces_cover_the_text(spark):
    texts = {
        "word": " ".join(f"w{i}" for i in range(1000)),
        "line": "\n".join(" ".join(f"a{i}x{j}" for j in range(50)) for i in range(9)),
        "crlf": "\r\n \r\n".join(" ".join(f"p{i}x{j}" for j in range(110)) for i in range(4)),
        "sentence": " ".join("one two three four five." for _ in range(80)),
        "mixed": "x " * 119 + "\n\n" + "y " * 130,
        "exact": "z " * 120,
        "odd": "\t\n" + "q\xa0r " * 90 + "\x85",
    }
    got = run(spark, texts.items())
    assert set(got) == set(texts) - {"exact"}
    for name, pieces in got.items():
        words = texts[name].split()
        assert all(p.cut_at == cut_at(texts[name]) and p.force_split and p.section == "Verse" and p.n_pieces == len(pieces) for p in pieces)
        joined = pieces[0].text.split()
        for p in pieces[1:]:
            w = p.text.split()
            assert w[:15] == joined[-15:] and len(w) <= 120 and p.n_words == len(w)
            joined += w[15:]
        assert joined == words


def test_first_cut_before_the_overlap(spark):
    w = [f"w{i}" for i in range(123)]
    w[64] += "."
    texts = {
        "line": " ".join(w[:5]) + "\n" + " ".join(w[5:]),
        "paragraph": " ".join(w[:14]) + "\n\n" + " ".join(w[14:]),
        "sentence": w[0] + ". " + " ".join(w[1:64] + w[65:]),
        "twice": " ".join(w[:4]) + "\n" + " ".join(w[4:9]) + "\n" + " ".join(w[9:]) + "\n" + " ".join(w[:112]),
    }
    got = run(spark, texts.items())
    assert set(got) == set(texts)
    for name, pieces in got.items():
        words, at = texts[name].split(), 0
        for i, p in enumerate(pieces):
            own = p.text.split()
            repeated = min(15, at)
            assert 0 < len(own) == p.n_words <= 120 and own == words[at - repeated : at - repeated + len(own)], (name, i)
            at += len(own) - repeated
        assert at == len(words) and len(pieces) > 1


def test_edge_rows(spark):
    rows = [("null", None), ("empty", ""), ("blank", " \n" * 500), ("short", "a b"), (None, "w " * 200), ("twice", "w " * 130), ("twice", "w " * 130)]
    got = run(spark, rows)
    assert set(got) == {"twice"} and len(got["twice"]) == 2
    assert run(spark, []) == {}


def test_very_long_text(spark):
    got = run(spark, [("long", "word " * 300_000)])
    assert len(got["long"]) == 1 + -(-(300_000 - 120) // 105)


def test_overlap_must_fit(spark):
    with pytest.raises(ValueError):
        run(spark, [], limit=10, overlap=10)
