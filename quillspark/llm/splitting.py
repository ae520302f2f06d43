"""Cutting oversized texts at natural boundaries, with overlap.

Method: pointer doubling.  Every boundary of a text is joined to its farthest
legal successor (the piece between them, overlap included, stays within the
limit); the successor tables are then squared, and each squaring doubles the
cuts that are known, so that all greedy cuts come out in log2(cuts) steps for
all texts of a batch in parallel.  The level at which a text is cut comes out
of the same doubling: each level has a table of its own, without overlap, and
the coarsest whose steps lead from the start to the end is taken.

A successor never leaves its text, so the tables of an Arrow batch are one
flat array: joining is a binary search and squaring is one gather.  Nothing is
shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 120
OVERLAP = 15
#: Word places of the texts that are doubled together, unless one text alone has more.
WORDS_AT_ONCE = 500_000
LEVELS = ("paragraph", "line", "sentence", "word")

_WORD = re.compile(r"\S+")
_BREAK = re.compile("\r\n|[\n\r\x0b\x0c\x85  ]")
SCHEMA = "chunk_id string, song_id string, section string, split_by string, force_split boolean, cut_at string, piece int, n_pieces int, n_words int, text string"


def _finest_level(gap: str, before: str) -> int:
    """How coarse a boundary the white space ``gap`` after the word ``before`` is: index into LEVELS."""
    breaks = len(_BREAK.findall(gap))
    if breaks >= 2:
        return 0
    if breaks == 1:
        return 1
    return 2 if before[-1] in ".!?" else 3


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the level of the boundary before each word (before the first: 0)."""
    spans = [m.span() for m in _WORD.finditer(text)]
    level = np.full(len(spans), 3, dtype=np.int8)
    if spans:
        level[0] = 0
    for i in range(1, len(spans)):
        (_, end), (start, _) = spans[i - 1], spans[i]
        if start - end > 1 or text[end] != " " or text[end - 1] in ".!?":
            level[i] = _finest_level(text[end:start], text[end - 1 : end])
    at = np.array(spans, dtype=np.int64).reshape(-1, 2)
    return at[:, 0], at[:, 1], level


def level_steps(level: np.ndarray, k: int, limit: int) -> np.ndarray:
    """Farthest boundary of level ``k`` or coarser within ``limit`` words of every word place 0..n; a place that has none is its own."""
    n = len(level)
    here = np.arange(n + 1)
    cuts = np.append(np.flatnonzero(level <= k), n)
    far = cuts[np.maximum(np.searchsorted(cuts, np.minimum(here + limit, n), side="right") - 1, 0)]
    return np.maximum(far, here)


def coarsest_levels(levels: list[np.ndarray], limit: int) -> list[int]:
    """For every text the coarsest level whose steps, doubled until nothing moves, lead from its start to its end.

    They do so just where cutting at all boundaries of the level leaves no part above ``limit`` words.
    """
    found = [3] * len(levels)
    open_ = list(range(len(levels)))
    for k in range(3):
        if not open_:
            break
        tables = [level_steps(levels[i], k, limit) for i in open_]
        jump, base = _joint(tables)
        at = base.copy()
        while True:
            further = jump[at]
            if (further == at).all():
                break
            at, jump = further, jump[jump]
        ended = at == base + [len(levels[i]) for i in open_]
        for i, done in zip(open_, ended):
            if done:
                found[i] = k
        open_ = [i for i, done in zip(open_, ended) if not done]
    return found


def successors(level: np.ndarray, start_level: int, limit: int, overlap: int) -> np.ndarray:
    """Farthest legal successor of every word place 0..n as a boundary; n is its own.

    Legal is a boundary at most ``limit`` words on from the text's start, else
    ``limit - overlap``.  The farthest at the text's level is taken; where
    that level has none in reach, at the next finer one.
    """
    n = len(level)
    here = np.arange(n + 1)
    reach = np.minimum(here + np.where(here == 0, limit, limit - overlap), n)
    out = np.full(n + 1, -1)
    for k in range(start_level, 4):
        cuts = np.append(np.flatnonzero(level <= k), n)
        far = cuts[np.maximum(np.searchsorted(cuts, reach, side="right") - 1, 0)]
        out = np.where((out < 0) & (far > here), far, out)
    out[n] = n
    return out


def _joint(tables: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(one table of all, where each begins)."""
    sizes = np.array([len(t) for t in tables], dtype=np.int64)
    base = np.cumsum(sizes) - sizes
    return np.concatenate([t + b for t, b in zip(tables, base)]) if tables else np.empty(0, dtype=np.int64), base


def all_cuts(tables: list[np.ndarray]) -> list[np.ndarray]:
    """The greedy cuts of every text from its successor table, by squaring the joint table."""
    jump, base = _joint(tables)
    reached = base.copy()  # each text's start
    while True:
        # with the table of 2^k steps, the first 2^k cuts give the next 2^k
        more = np.union1d(reached, jump[reached])
        if len(more) == len(reached):
            break
        reached = more
        jump = jump[jump]
    where = np.searchsorted(reached, base)
    return [part - b for part, b in zip(np.split(reached, where[1:]), base)]


def _cut(kept: list[tuple], limit: int, overlap: int) -> pd.DataFrame:
    """The pieces of some texts, given as (row, starts, ends, level)."""
    levels = coarsest_levels([level for *_, level in kept], limit)
    tables = [successors(level, k, limit, overlap) for (*_, level), k in zip(kept, levels)]
    out = []
    for (row, starts, ends, _), k, cuts in zip(kept, levels, all_cuts(tables)):
        for i in range(len(cuts) - 1):
            first = max(0, cuts[i] - overlap)
            text = row.text[starts[first] : ends[cuts[i + 1] - 1]]
            out.append((row.chunk_id, row.song_id, row.section, row.split_by, True, LEVELS[k], i, len(cuts) - 1, int(cuts[i + 1] - first), text))
    return pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])


def _pieces(batches: Iterator[pd.DataFrame], limit: int, overlap: int) -> Iterator[pd.DataFrame]:
    for rows in batches:
        kept, held = [], 0
        for row in rows.itertuples(index=False):
            starts, ends, level = boundaries(row.text)
            if len(starts) > limit:
                kept.append((row, starts, ends, level))
                held += len(starts)
            if held >= WORDS_AT_ONCE:
                yield _cut(kept, limit, overlap)
                kept, held = [], 0
        yield _cut(kept, limit, overlap)


def split_oversized(chunks: DataFrame, *, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of the chunks of more than ``limit`` words (parts between white space).

    One row per piece: chunk_id, song_id, section, split_by, force_split
    (true), cut_at (the coarsest level at which cutting everywhere fits),
    piece (from 0), n_pieces, n_words and the text, with its own white space.
    Each piece after the first starts with the last ``overlap`` words before
    its cut, or all of them where the cut has fewer before it; they count
    within ``limit``.  Repeated rows of a chunk_id count
    once (the largest row); null, blank and short texts have no pieces.
    Needs ``0 <= overlap < limit``.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    # limit + 1 words need that many characters and the white space between; only long texts leave the scan
    long = chunks.where(F.length("text") > 2 * limit)
    row = F.max(F.struct("text", "song_id", "section", "split_by"))
    once = long.where(F.col("chunk_id").isNotNull()).groupBy("chunk_id").agg(row.alias("m")).select("chunk_id", "m.*")
    return once.mapInPandas(lambda batches: _pieces(batches, limit, overlap), SCHEMA)
