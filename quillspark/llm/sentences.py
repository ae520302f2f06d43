"""Sentence units of texts in many languages, with their places.

Method: a pushdown automaton reads the structural characters of a paragraph.
Its stack holds open quotations and brackets, a mark of the list level is read
where a line starts a list item, terminators are those of the scripts, and a
full stop is looked up in a trie of abbreviations, read backwards from the
stop.  What follows the mark decides the rest.

Rules.  A blank line ends a unit.  A single line break is white space, unless
it starts an item of a list.  Inside a quotation or bracket that is closed in
its paragraph nothing ends; at its closing mark a terminator that stood before
it counts.  A quotation ending in ! or ? goes on into the words that say who
spoke: a name and a verb, or another subject and a verb of speech, up to the
next mark; and over a bracket after it if the sentence goes on behind that.
Thai units are parted by white space.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Abbreviations by what they do to the stop after them, without their last stop, in lower case.
# never the end of a sentence
ALWAYS = (
    "mr mrs ms dr prof st mme mlle hr fr sr sra srta dra d.ª rev gen col capt lt hon mt ft "
    "vs e.g i.e cf viz incl z u bzw bspw sog ggf ee vgl st.-nr p.ex p.ej "
    "ім вул просп пл ст обл м див напр проф акад ред д د أ डॉ श्री प्रो".split()
)
# before a number
NUMERIC = (
    "no nos nr núm num vol vols p pp pág págs fig figs s sec ch art bd ca approx aprox env circa с стор буд кв рис прибл т h op "
    "jan feb mar apr jun jul aug sept sep oct nov dec".split()
)
# may end a sentence: a capital or a script without case after them does it
SOMETIMES = (
    "a.m p.m etc jr bros co inc ltd corp uu usw u.k u.s u.s.a "
    "min sek std грн р рр тис млн".split()
)
# German words before an ordinal number
BEFORE_ORDINAL = "am der die das den dem des vom zum zur im beim ab bis seit und ein eine einem einen jeder jede jedes".split()
# verbs of speech, as they stand after a subject that is no name
SPEECH = (
    "said says asked asks shouted shouts cried called replied answered whispered added laughed yelled murmured muttered "
    "explained insisted sang screamed continued rief sagte fragte schrie antwortete flüsterte cria dit demanda répondit "
    "murmura lança gritó dijo preguntó respondió exclamó contestó вигукнув вигукнула сказав сказала спитав спитала відповів".split()
)
# words that begin sentences and are no names
OPENERS = (
    "the a an this that these those he she it they we you i his her its their our my your one some many most all no each every both "
    "another such what who which when where why how if as while although though because since until after before during in on at by "
    "for from with without to into of over under and or but nor so yet then there here now later soon once only even just still never "
    "always again meanwhile however instead perhaps maybe nobody everybody everyone someone nothing everything something anyone "
    "der die das den dem ein eine einen er sie es wir ihr ich man niemand jemand alle alles viele wer was wo wann warum wie ohne mit "
    "nach vor bei aus auf an im am zum zur und aber oder denn dann da hier jetzt nur noch nie immer "
    "le la les un une il elle ils elles on nous vous je ce cette ces son sa ses mon ma mes personne tout tous chacun qui que quand où "
    "et mais ou donc puis dans sur avec sans pour "
    "el los las una uno unos ella ellos ellas yo nadie todo todos todas alguien este esta ese esa su sus mi mis quién cuando dónde y "
    "pero o entonces en con sin para por "
    "він вона воно вони ми ви я ти це цей ця ці той та те хто що коли де чому як якщо і й але або потім тут там ніхто усі всі у в на з без".split()
)
# words that come before the verb of a clause only where it says something else than who spoke
OTHERWISE = (
    "is was are were be been being am has have had do does did will would can could shall should may might must of in on at by for "
    "from with to into onto over under after before through during since until and or but nor so because although though while when "
    "where who which that whose not no also however then ist war sind waren hat hatte haben und oder est était sont a avait et es era "
    "son fue ha había y є був була були і та".split()
)

_TERMINATORS = ".!?…。！？｡．।॥؟۔"
_FULL_WIDTH = set("。！？｡．।॥؟۔")
_ASKING = set("!?！？؟")
_PAIRS = {"“": "”", "„": "“”", "«": "»", "»": "«", "(": ")", "[": "]", "{": "}", "「": "」", "『": "』", "（": "）", "【": "】", "《": "》", "〈": "〉", '"': '"'}
_CLOSERS = set("”“»«)]}」』）】》〉\"’'")
_DASHES = set("—–―-")
_GO_ON = set(",;:،؛、，；：)")
_INVISIBLE = "﻿​‎‏⁠"
_SPACE = rf"[\s{_INVISIBLE}]"
_BLANK_LINE = re.compile(r"(?:\r\n|[\n\r\x0b\x0c\x85  ])[^\S\n\r\x0b\x0c\x85  ]*(?:\r\n|[\n\r\x0b\x0c\x85  ])\s*")
_ITEM = re.compile(r"(?:(?P<bullet>[-*•‣▪])|\(?(?P<number>\d{1,3})(?P<after>[.)])|\(?(?P<letter>[a-z])\))[ \t]+(?=\S)")
_LINE = re.compile(r"(?:\r\n|[\n\r\x0b\x0c\x85  ])[ \t]*")
_STRUCTURE = re.compile(rf"[{re.escape(_TERMINATORS)}]+|[“”„«»()\[\]{{}}「」『』（）【】《》〈〉\"]|(?<=[ก-๛])\s+")
_NAMED = re.compile(r"[^\W\d_]+\s+&\s+\w")
_NEXT_WORDS = re.compile(r"[^\W\d_][\w'’-]*")
_CLAUSE = re.compile(rf"[^{re.escape(_TERMINATORS)},;:“”„«»\"()\[\]]*")
_UNSPACED = re.compile(r"[々-ヿ㐀-鿿豈-﫿ｦ-ﾟ」』）”》〉\U00020000-\U0003ffff]")
_ACRONYM = re.compile(r"(?:[^\W\d_]\.)+[^\W\d_]")


def _trie() -> dict:
    root: dict = {}
    for kind, listed in (("always", ALWAYS), ("numeric", NUMERIC), ("sometimes", SOMETIMES)):
        for word in listed:
            node = root
            for c in reversed(word):
                node = node.setdefault(c, {})
            node[""] = kind
    return root


_ABBREVIATIONS = _trie()


def abbreviation(text: str, stop: int, start: int) -> tuple[str | None, int]:
    """(kind, where it starts) of the longest abbreviation that ends before ``stop`` at a word's edge."""
    node, kind, at = _ABBREVIATIONS, None, stop
    i = stop
    while i > start:
        node = node.get(text[i - 1].lower())
        if node is None:
            break
        i -= 1
        if "" in node and (i == start or not (text[i - 1].isalnum() or text[i - 1] in "._" or unicodedata.category(text[i - 1])[0] == "M")):
            kind, at = node[""], i
    return kind, at


def _matches(marks: list[tuple[int, str]]) -> dict[int, int]:
    """Places of opening marks and their closing marks within a paragraph; marks without a partner are left out."""
    stack: list[tuple[int, str]] = []
    pairs: dict[int, int] = {}
    waiting: Counter[str] = Counter()  # closing marks that some open mark waits for
    for at, c in marks:
        if waiting[c]:
            # the nearest open mark that this one closes; those opened inside it were none
            while stack:
                opened, o = stack.pop()
                waiting.subtract(_PAIRS[o])
                if c in _PAIRS[o]:
                    pairs[opened] = at
                    break
        elif c in _PAIRS:
            stack.append((at, c))
            waiting.update(_PAIRS[c])
    return pairs


class Automaton:
    """Units of one paragraph ``text[start:end]``."""

    def __init__(self, text: str, start: int, end: int) -> None:
        self.text, self.start, self.end = text, start, end

    def units(self) -> list[tuple[int, int]]:
        text, end = self.text, self.end
        tokens = [(m.start(), m.end()) for m in _STRUCTURE.finditer(text, self.start, end)]
        pairs = _matches([(a, text[a]) for a, b in tokens if b == a + 1 and (text[a] in _PAIRS or text[a] in _CLOSERS)])
        closing = set(pairs.values())
        self.pairs = pairs
        items = self._items()
        out: list[tuple[int, int]] = []
        stack: list[int] = []  # closing places of what is open
        opened = self.start  # where the outermost open mark stands
        unit = self.start
        pending: tuple[int, int] | None = None  # a terminator inside what is open
        done = self.start
        for a, b in tokens:
            if a < done:
                continue
            while items and items[0][0] <= a:  # a list item starts a unit of its own
                if items[0][0] > unit:
                    out.append((unit, items[0][0]))
                    unit = items[0][0]
                stack.clear()
                pending = None
                done = max(done, items.pop(0)[1])
            if a < done:
                continue
            c = text[a]
            if c.isspace():
                if not stack:
                    out.append((unit, a))
                    unit = b
            elif c in _TERMINATORS:
                if stack:
                    pending = (a, b)
                else:
                    e = self._closed(b, closing)
                    if self._ends(a, b, e, unit, e > b, False):
                        out.append((unit, e))
                        unit = done = e
            elif a in pairs:
                if not stack:
                    opened = a
                stack.append(pairs[a])
                pending = None
            elif stack and stack[-1] == a:  # pairs are nested
                stack.pop()
                if stack or pending is None:
                    continue
                if text[pending[1] : a].strip(" \t\r\n\xa0 " + "".join(_CLOSERS)):
                    pending = None
                    continue
                e = self._closed(b, closing)
                whole = c in ")]}）】" and self._blank(unit, opened)
                if self._ends(*pending, e, unit, c not in ")]}）】", whole):
                    out.append((unit, e))
                    unit = done = e
                pending = None
        for at, _ in items:
            if at > unit:
                out.append((unit, at))
                unit = at
        out.append((unit, end))
        return out

    def _items(self) -> list[tuple[int, int]]:
        """Places of list items, where the paragraph is a list from its first line on: (start, end of the mark).

        A stack holds the open levels as (style, count).  A line opens an item
        if its mark goes on with the count of an open level, which closes the
        levels inside it, or starts a new level at one; so a wrapped line that
        begins with some number is no item.
        """
        at = [self.start, *(m.end() for m in _LINE.finditer(self.text, self.start, self.end))]
        levels: list[tuple[str, int]] = []
        found = []
        for place in at:
            m = _ITEM.match(self.text, place)
            if not m:
                if not found:
                    break
                continue
            if m["bullet"]:
                style, count, next_ = m["bullet"], 1, 1
            else:
                style = m["after"] or "a"
                count = int(m["number"]) if m["number"] else ord(m["letter"]) - 96
                next_ = count - 1
            depth = next((k for k in range(len(levels) - 1, -1, -1) if levels[k] == (style, next_)), None)
            if depth is not None:
                levels[depth:] = [(style, count)]
            elif count == 1 or not found:
                levels.append((style, count))
            else:
                continue
            found.append(m.span())
        return found

    def _blank(self, start: int, end: int) -> bool:
        while start < end and self.text[start].isspace():
            start += 1
        return start >= end

    def _closed(self, at: int, closing: set[int]) -> int:
        """After the closing marks that stand right at ``at`` and close nothing that is still open."""
        while at < self.end and self.text[at] in _CLOSERS and at not in closing and self.text[at] not in _PAIRS:
            at += 1
        return at

    def _ends(self, a: int, b: int, e: int, unit: int, quoted: bool, whole: bool) -> bool:
        """Whether the terminator ``text[a:b]``, with closing marks up to ``e``, ends the unit."""
        text, end = self.text, self.end
        s = e
        while s < end and (text[s].isspace() or text[s] in _INVISIBLE):
            s += 1
        if s >= end:
            return True
        mark = text[a:b]
        c = text[s]
        # scripts without spaces need none after the mark
        wide = bool(_FULL_WIDTH.intersection(mark)) or (mark[-1] == "…" and bool(_UNSPACED.match(text[a - 1 : a]) or _UNSPACED.match(c)))
        if s == e and not wide:
            return False
        if c in _GO_ON:
            return False
        if c in _DASHES:
            d = s + 1
            while d < end and text[d].isspace():
                d += 1
            return not (d < end and text[d].islower())
        small = c.islower()
        if small and _NAMED.match(text, s):  # a name written small
            small = False
            named = True
        else:
            named = False
        asking = bool(_ASKING.intersection(mark))
        if quoted and asking:
            if small:
                return False
            if unicodedata.category(c) == "Lo":
                if text[e - 1] in "」』":
                    return not text.startswith(("と", "って"), s)
                return False
            if c.isupper() and not named:
                return not self._says_who(s)
            if s in self.pairs:  # a bracket: what stands behind it decides
                after = self.pairs[s] + 1
                while after < end and text[after].isspace():
                    after += 1
                return after >= end or not (text[after].islower() or text[after] in _GO_ON)
            return True
        if whole:
            return True
        if mark == "." and not quoted:
            return self._stop_ends(a, s, unit, small, named)
        return not small

    def _says_who(self, s: int) -> bool:
        """Whether the clause that starts with a capital at ``s`` says who spoke."""
        named = None
        for m in _NEXT_WORDS.finditer(self.text, s, _CLAUSE.match(self.text, s, self.end).end()):
            word = m.group()
            if named is None:
                named = word.lower() not in OPENERS
            elif word.lower() in SPEECH:
                return True
            elif word in OTHERWISE:
                return False
            elif named and word[0].islower():
                return True
        return False

    def _stop_ends(self, a: int, s: int, unit: int, small: bool, named: bool) -> bool:
        """Whether a single full stop at ``a`` ends the unit; the next thing stands at ``s``."""
        text, c = self.text, self.text[s]
        if small:
            return False
        kind, _ = abbreviation(text, a, unit)
        if kind == "always":
            return False
        if kind == "numeric" and (c.isdigit() or c in "#№"):
            return False
        w = a
        while w > unit and (text[w - 1].isalnum() or text[w - 1] in "._-"):
            w -= 1
        word = text[w:a]
        if len(word) == 1 and word.isalpha():
            if word.isupper() and not named and c.isalpha():
                return False  # an initial
            if word.islower() and kind is None and s + 1 < self.end and text[s + 1] == ".":
                return False  # letters that belong together
        if kind == "sometimes" or _ACRONYM.fullmatch(word):
            return True
        if word.isdigit():
            if self._blank(unit, w):
                return False  # the number of a list item
            e = w
            while e > unit and text[e - 1].isspace():
                e -= 1
            b = e
            while b > unit and text[b - 1].isalpha():
                b -= 1
            if b < e < w and text[b:e].lower() in BEFORE_ORDINAL and c.isupper():
                return False
        return True


def units(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of the sentence units in code points, without white space around them."""
    if not text:
        return []
    out = []
    at = 0
    cuts = [m.span() for m in _BLANK_LINE.finditer(text)]
    for a, b in [*cuts, (len(text), len(text))]:
        start, end = at, a
        at = b
        while start < end and (text[start].isspace() or text[start] in _INVISIBLE):
            start += 1
        if start == end:
            continue
        for s, e in Automaton(text, start, end).units():
            while s < e and (text[s].isspace() or text[s] in _INVISIBLE):
                s += 1
            while e > s and (text[e - 1].isspace() or text[e - 1] in _INVISIBLE):
                e -= 1
            if s < e:
                out.append((s, e))
    return out


def sentence_units(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, sentence, start_pos, end_pos, unit), one row per sentence unit, in order from 0.

    Positions count code points; end_pos is after the closing marks.  Null,
    empty and blank texts have no rows; a text without any mark is one unit a
    paragraph.  Repeated rows are split each.  Nothing is shuffled.
    """
    kind = documents.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc_id", "sentence", "start_pos", "end_pos", "unit"]
        for rows in batches:
            for at in range(0, len(rows), 1000):
                part = rows.iloc[at : at + 1000]
                yield pd.DataFrame([(i, k, s, e, t[s:e]) for i, t in zip(part.doc_id, part.text) for k, (s, e) in enumerate(units(t))], columns=names)

    return documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInPandas(
        run, f"doc_id {kind}, sentence int, start_pos bigint, end_pos bigint, unit string"
    )
