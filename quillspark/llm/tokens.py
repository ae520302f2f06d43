"""Token ids of a byte-level BPE vocabulary, by prefix-sharing traversal.

Method: the last token of the encoding of a prefix is decided by the last
token of a shorter prefix: it is the one token that ends there and may follow.
The distinct words of a batch are put in order, which is the depth-first order
of their trie, and the last-token states are carried along the path, so a
prefix that words share is worked out once.  A word's ids are read back along
the states.

The vocabulary is that of a public tokenizer (a rank file).  A text is first
parted by the tokenizer's own pattern; no merge crosses a word.  Where the
pattern never puts white space after something else into one word, a text can
be cut before every run of white space first, which is cheap, and the pattern
is applied to each distinct stretch once.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k"
#: Words kept per Python worker before their encodings are forgotten.
MEMO_WORDS = 400_000
#: Characters of a word or stretch that is kept at most.
_KEPT = 64
_BATCH = 500
# Fixed value: the pattern of byte-level vocabularies of which no word has white space after something else.
SPACE_LED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_INF = 1 << 60


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the installed public tokenizers keep the rank file."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.tiktoken")


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class TrieEncoder:
    """Encodes words by last-token states along their trie."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.token = dict(map(reversed, self.rank.items()))
        #: The length of the longest token by its last two bytes.
        self.longest: dict[bytes, int] = {}
        for t in self.rank:
            self.longest[t[-2:]] = max(len(t), self.longest.get(t[-2:], 1))
        self.find = regex.compile(pattern).findall
        self.memo: dict[str, bytes] = {}  # ids as 32-bit numbers, so that texts are joined without touching single ids
        self.stretch = None
        if pattern == SPACE_LED:
            blank = regex.compile(r"\s").match
            space = "".join(re.escape(c) for c in map(chr, range(0x3001)) if blank(c))
            self.stretch = re.compile(f"[{space}]*[^{space}]+|[{space}]+").findall
        self.stretches: dict[str, bytes] = {}
        self._fresh: set[str] = set()
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._right: dict[int, list[int]] = {}
        self._left: dict[int, list[int]] = {}
        self._follows: dict[tuple[int, int], bool] = {}

    def halves(self, t: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``t``; None for a byte."""
        if t not in self._halves:
            parts = [bytes([x]) for x in self.token[t]]
            while len(parts) > 2:
                # merges below t's own rank, lowest first, leftmost of equals
                ranks = [self.rank.get(a + b, _INF) for a, b in zip(parts, parts[1:])]
                i = min(range(len(ranks)), key=ranks.__getitem__)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self._halves[t] = (self.rank[parts[0]], self.rank[parts[1]]) if len(parts) == 2 else None
        return self._halves[t]

    def spine(self, t: int, side: int) -> list[int]:
        """The tokens at one edge (0 left, 1 right) of ``t`` as it is built, from byte to ``t``."""
        known = (self._left, self._right)[side]
        if t not in known:
            up = [t]
            while (h := self.halves(up[-1])) is not None:
                up.append(h[side])
            known[t] = up[::-1]
        return known[t]

    def may_follow(self, a: int, b: int) -> bool:
        """Whether encoding the bytes of ``a`` and ``b`` together gives just these two tokens.

        Ranks rise along a spine, so the tokens beside the boundary change in
        order of rank; the pair stands if no merge across the boundary comes
        first at any time.
        """
        key = (a, b)
        if key not in self._follows:
            left, right = self.spine(a, 1), self.spine(b, 0)
            i = j = 0
            fine = True
            while True:
                next_left = left[i + 1] if i + 1 < len(left) else _INF
                next_right = right[j + 1] if j + 1 < len(right) else _INF
                across = self.rank.get(self.token[left[i]] + self.token[right[j]], _INF)
                # among equal ranks the leftmost merge comes first
                if across < next_left and across <= next_right and across < _INF:
                    fine = False
                    break
                if next_left == next_right == _INF:
                    break
                if next_left <= next_right:
                    i += 1
                else:
                    j += 1
            self._follows[key] = fine
        return self._follows[key]

    def learn(self, words: set[str]) -> None:
        """Encode words that are new, in the depth-first order of their trie."""
        rank, longest, may_follow, length = self.rank, self.longest.get, self.may_follow, {}
        last: list[int] = [-1]  # last[d]: last token of the first d bytes of the path
        path = b""
        for word, b in sorted(((w, w.encode()) for w in words), key=lambda x: x[1]):
            shared, most = 0, min(len(path), len(b))
            while shared < most and path[shared] == b[shared]:
                shared += 1
            del last[shared + 1 :]
            for d in range(shared + 1, len(b) + 1):
                for start in range(max(0, d - longest(b[max(0, d - 2) : d], 1)), d):
                    t = rank.get(b[start:d])
                    if t is not None and (start == 0 or may_follow(last[start], t)):
                        break
                last.append(t)
            path = b
            ids, d = [], len(b)
            while d:
                t = last[d]
                ids.append(t)
                size = length.get(t)
                if size is None:
                    size = length[t] = len(self.token[t])
                d -= size
            self.memo[word] = array("i", ids[::-1]).tobytes()

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of the texts; null and empty texts have no ids."""
        if len(self.memo) > MEMO_WORDS or len(self.stretches) > MEMO_WORDS:
            self.memo.clear()
            self.stretches.clear()
        if self.stretch is None:
            words, known, new = [self.find(t) if t else [] for t in texts], self.memo, []
            self._learn_new(words)
        else:
            words, known = [self.stretch(t) if t else [] for t in texts], self.stretches
            new = list(set().union(*words).difference(known))
            parted = [self.find(x) for x in new]
            self._learn_new(parted)
            for x, parts in zip(new, parted):
                known[x] = b"".join(map(self.memo.__getitem__, parts))
        get = known.__getitem__
        ids = [b"".join(map(get, w)) for w in words]
        offsets = np.zeros(len(ids) + 1, dtype=np.int32)
        np.cumsum([len(i) // 4 for i in ids], out=offsets[1:])
        # what is long is seldom seen again: it is forgotten at once, so that a memo stays small whatever the texts
        for memo, seen in ((self.memo, self._fresh), (self.stretches, new)):
            for x in seen:
                if len(x) > _KEPT:
                    del memo[x]
        return offsets, np.frombuffer(b"".join(ids), dtype=np.int32)

    def _learn_new(self, words: list[list[str]]) -> None:
        self._fresh = set().union(*words).difference(self.memo)
        if self._fresh:
            self.learn(self._fresh)


_ENCODERS: dict[tuple[str, str], TrieEncoder] = {}


def encoder(path: str, pattern: str) -> TrieEncoder:
    """One encoder per Python worker, kept between tasks."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = TrieEncoder(path, pattern)
    return _ENCODERS[path, pattern]


def token_ids(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", *, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>), one row per row of ``documents``, no special tokens.

    A null and an empty text both give an empty list; the names of special
    tokens are ordinary text.  Nothing is shuffled.
    """
    where, pat = path or vocabulary_path(), pattern or split_pattern()
    kind = documents.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, offsets, ids in _encoded(batches, where, pat):
            yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], ["doc_id", "ids"])

    return documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def token_pieces(documents: DataFrame, size: int, doc_id: str = "doc_id", text: str = "text", *, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, piece, start_token, n_tokens, ids): the ids cut into pieces of ``size``, the last one shorter.

    A text without ids is one empty piece; a whole number of sizes leaves no
    empty piece.  The cuts are made where the ids are, so a very long text is
    never carried along once for each of its pieces.
    """
    where, pat = path or vocabulary_path(), pattern or split_pattern()
    kind = documents.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, offsets, ids in _encoded(batches, where, pat):
            n = np.diff(offsets)
            count = np.maximum(1, -(-n // size))
            owner = np.repeat(np.arange(len(n)), count)
            piece = (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)).astype(np.int32)
            start = piece * size
            length = np.minimum(size, n[owner] - start).astype(np.int32)
            cuts = np.append(offsets[:-1][owner] + start, offsets[-1]).astype(np.int32)
            columns = [keys.take(pa.array(owner)), pa.array(piece), pa.array(start.astype(np.int32)), pa.array(length), pa.ListArray.from_arrays(pa.array(cuts), pa.array(ids))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start_token", "n_tokens", "ids"])

    schema = f"doc_id {kind}, piece int, start_token int, n_tokens int, ids array<int>"
    return documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def _encoded(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    enc = encoder(path, pattern)
    for batch in batches:
        for at in range(0, batch.num_rows, _BATCH):
            part = batch.slice(at, _BATCH)
            yield part.column(0), *enc.encode_batch(part.column(1).to_pylist())
