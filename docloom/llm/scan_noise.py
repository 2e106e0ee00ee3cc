"""Problem 7: noise in text from scanned pages, by a noisy channel over corpus n-grams."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from docloom.llm.bitmap import bitmap, key_bits
from docloom.session import cut

#: Misreadings: what the scan shows, what stood there, log probability (fixed values of the channel).
CONFUSIONS = tuple(
    (seen, true, math.log(p))
    for seen, true, p in (
        ("0", "o", 0.02), ("1", "l", 0.02), ("1", "i", 0.01), ("!", "i", 0.02), ("!", "l", 0.01), ("|", "l", 0.02), ("|", "i", 0.01), ("5", "s", 0.02), ("$", "s", 0.01), ("6", "b", 0.02), ("8", "b", 0.01),
        ("9", "g", 0.02), ("9", "q", 0.002), ("+", "t", 0.02), ("7", "t", 0.005), ("3", "e", 0.005), ("4", "a", 0.005), ("c", "e", 0.01), ("rn", "m", 0.01), ("cl", "d", 0.01), ("li", "h", 0.01), ("ii", "u", 0.01), ("m", "in", 0.01),
        ("l", "i", 0.003), ("i", "l", 0.003), ("f", "t", 0.003), ("t", "f", 0.003), ("v", "u", 0.003), ("u", "v", 0.002), ("u", "n", 0.003), ("n", "u", 0.002), ("c", "o", 0.002), ("o", "c", 0.002), ("o", "e", 0.002), ("in", "m", 0.005),
        ("vv", "w", 0.01), ("ﬁ", "fi", 0.02), ("ﬂ", "fl", 0.02), ("h", "li", 0.001), ("d", "cl", 0.001), ("m", "rn", 0.001),
    )
)
_HUMP = re.compile("[a-z][A-Z]")
_MARKED = re.compile(r"[0-9!|$+ﬁﬂ]")
#: Glyphs that may be read as others, brought to the same sequence of strokes: whatever misreadings happened to a word,
#: and however many, its key stays the same. Fixed by the confusions above.
_PARTS = (("ﬁ", "fi"), ("ﬂ", "fl"), ("d", "cl"), ("h", "li"), ("m", "iii"), ("w", "vv"), ("u", "ii"), ("v", "ii"), ("n", "ii"))
_STROKES = ("01!|i5$689q+7f34cro", "ellllssbbggttteaele")
TOKEN = re.compile(r"[!+|$]?[^\W_]+(?:[!+|$]+[^\W_]+)*[+$]?")
_LETTER = re.compile(r"[^\W\d_]")
_HYPHENS = "-‐­¬"
_LINE_END = re.compile(rf"([^\W\d_][\w!+|$]*)([{_HYPHENS}])$")
_MAY_SPLIT = re.compile(rf"[{_HYPHENS}][ \t\r]*\n")
_LINE_START = re.compile(r"[\w!+|$]*[^\W\d_][\w!+|$]*")
_NUM = r"[\dlIO]{0,3}\d[\dlIO]{0,3}|[lIO]{1,4}"
_PAGE = re.compile(rf"(?:(?P<plain>\d[\dlIO]{{0,3}}|[lI]\d{{1,3}})|[-–—]\s*(?:{_NUM})\s*[-–—]|\[\s*(?:{_NUM})\s*\]|(?:p\.|pg\.?|page|seite|s\.|página|pág\.)\s*(?:{_NUM})(?:\s*(?:of|von|de|sur|/)\s*(?:{_NUM}))?)", re.I)
_PAGE_STARTS, _ROMAN_STARTS = frozenset("0123456789lIO-–—[pPsS"), frozenset("ivxlcdmIVXLCDM1|!")
_HEADER_NUMBER = re.compile(rf"^(?:{_NUM})\s{{2,}}|\s{{2,}}(?:{_NUM})$")
_ROMAN = re.compile(r"m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})")
_DATE = re.compile(r"\d{1,2}\.?\s+[^\W\d_]+\.?\s+\d{4}$")
_FIGURES = str.maketrans("lIOo", "1100")
_ITEM = re.compile(r"^\s*(?:[-*•]|\d+[.)])\s")
def plain(text: str) -> str:
    """The text in lower case at the same length, addresses of the net and encoded data blank."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    for mark in ("@", "://"):
        at = low.find(mark)
        while at >= 0:
            a, b = at, at + len(mark)
            while a and not low[a - 1].isspace():
                a -= 1
            while b < len(low) and not low[b].isspace():
                b += 1
            low = low[:a] + " " * (b - a) + low[b:]
            at = low.find(mark, b)
    last = 0
    for m in _HUMP.finditer(text):
        # a run that changes from small to capital letters again and again is no word but encoded data
        a, b = m.start(), m.end()
        if a < last:
            continue
        while a and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        last = b
        if sum(1 for _ in _HUMP.finditer(text, a, b)) > 2:
            low = low[:a] + " " * (b - a) + low[b:]
    return low


def tokens(line: str) -> list[tuple[int, int, str]]:
    """(start, end, token) of the words of a line."""
    return [(m.start(), m.end(), m[0]) for m in TOKEN.finditer(plain(line)) if len(m[0]) > 1]


def strokes(text: str) -> str:
    """Key that a (lower-case) text shares with everything it can be misread as."""
    for seen, true in _PARTS:
        text = text.replace(seen, true)
    return text.translate(_STROKE_TABLE)


_STROKE_TABLE = str.maketrans(*_STROKES)


def strokes_of(word: Column) -> Column:
    """``strokes`` of a column."""
    for seen, true in _PARTS:
        word = F.replace(word, F.lit(seen), F.lit(true))
    return F.translate(word, *_STROKES)


def channel(token: str, word: str) -> float | None:
    """Log probability that ``word`` on a damaged page is read as ``token``; None where no misreadings explain it."""
    n, m = len(token), len(word)
    best: list[dict[int, float]] = [{} for _ in range(n + 1)]
    best[0][0] = 0.0
    for i in range(n):
        for j, p in best[i].items():
            if j < m and token[i] == word[j] and p > best[i + 1].get(j + 1, -1e9):
                best[i + 1][j + 1] = p
            for seen, true, q in _BY_FIRST.get(token[i], ()):
                if token.startswith(seen, i) and word.startswith(true, j) and p + q > best[i + len(seen)].get(j + len(true), -1e9):
                    best[i + len(seen)][j + len(true)] = p + q
    return best[n].get(m)


_BY_FIRST: dict[str, list[tuple[str, str, float]]] = {}
for _c in CONFUSIONS:
    _BY_FIRST.setdefault(_c[0][0], []).append(_c)


def chances(word: str) -> float:
    """Expected number of misreadings in ``word`` on a damaged page that put a figure or sign in it."""
    return sum(word.count(true) * math.exp(q) for seen, true, q in CONFUSIONS if _MARKED.search(seen))


def fold(line: str) -> str:
    """Form in which a running header is the same on each page, whatever its case, page number and misreadings."""
    return re.sub(r"[\W_]+", "", strokes(_HEADER_NUMBER.sub("", line.strip()).lower()))


def roman(text: str) -> int:
    """Value of a Roman numeral in lower or upper case (an l or figure may stand for an i), 0 where it is none."""
    if not text or len(text) > 15 or not (text.islower() or text.isupper() or text.isdigit()):
        return 0
    low = text.lower()
    for form in (low, low.translate(_ONES)):
        if _ROMAN.fullmatch(form):
            worth = [_WORTH[c] for c in form]
            return sum(-a if a < b else a for a, b in zip(worth, [*worth[1:], 0]))
    return 0


_ONES = str.maketrans("1l|!", "iiii")
_WORTH = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}


def _title(line: str) -> bool:
    """The line has the form of a title: no sentence, no item of a list, no cell."""
    if line[-1] in ".!?;,:…" or line[0].islower():
        return False
    text = _HEADER_NUMBER.sub("", line)
    if not text or text[-1] in ".!?;,:…" or not text[0].isalnum() or text[0].islower() or "|" in text or "@" in text:
        return False
    if _ITEM.match(text) or _DATE.search(text) or re.search(r"[.!?;]\s(?!\d)", text):
        return False
    words = re.findall(r"[^\W\d_][^\s:()/]*", text)
    return len(words) > 0 and sum(w[0].isupper() for w in words) >= 0.6 * len(words)


class Layout:
    """The lines of a text told apart: running headers, page numbers, blank and body lines.

    A running header is a title that comes back at least three lines later, whatever its page number and misreadings,
    where pages begin or end: at the border of the text, at a form feed, beside a page number (or with one in it), or
    between two lines of one sentence. That must hold for half of its two places, or for one of more. A title with a page
    number set apart in it at such a place is a header even if it is the only one.
    """

    def __init__(self, text: str):
        self.lines = text.split("\n")
        bare = [x.replace("\f", " ").strip() for x in self.lines]
        self.blank = [not x for x in bare]
        pages = [_PAGE.fullmatch(x) if x and x[0] in _PAGE_STARTS else None for x in bare]
        numerals = {i: v for i, x in enumerate(bare) if x and x[0] in _ROMAN_STARTS and pages[i] is None and (v := roman(x))}
        filled = [i for i, b in enumerate(self.blank) if not b]
        order = {i: k for k, i in enumerate(filled)}
        groups: dict[str, list[int]] = {}
        for i in filled:
            if pages[i] is None and i not in numerals and _title(bare[i]):
                groups.setdefault(fold(bare[i]), []).append(i)
        self.header = [False] * len(self.lines)
        for form, at in groups.items():
            numbered = [_HEADER_NUMBER.search(bare[i]) is not None for i in at]
            if len(at) > 1 and form and min(b - a for a, b in zip(at, at[1:])) >= 3:
                edge = sum(n or self._page_edge(bare, filled, order[i], pages, numerals) for i, n in zip(at, numbered))
                if 2 * edge >= len(at) or edge and len(at) > 2:
                    for i in at:
                        self.header[i] = True
            elif form and len(at) == 1 and numbered[0] and len(form) > 3 and self._page_edge(bare, filled, order[at[0]], pages, numerals):
                self.header[at[0]] = True
        plain = {i: int(bare[i].translate(_FIGURES) or 0) for i, p in enumerate(pages) if p and p["plain"]} | numerals
        near = {j for i, h in enumerate(self.header) if h for j in range(i - 2, i + 3)}
        rising = self._rising(plain)
        # a number alone may be a cell or a figure: it counts beside a header, in a rising row, or between whole sentences
        self.page = [
            p is not None and not p["plain"] or i in plain and (i in near or i in rising or i not in numerals and self._between(bare, i)) for i, p in enumerate(pages)
        ]
        self.body = [not (b or h or p) for b, h, p in zip(self.blank, self.header, self.page)]

    def _page_edge(self, bare: list[str], filled: list[int], k: int, pages: list, numerals: dict[int, int]) -> bool:
        i = filled[k]
        if k in (0, len(filled) - 1) or "\f" in self.lines[i] or "\f" in self.lines[i - 1][-2:]:
            return True
        before, after = filled[k - 1], filled[k + 1]
        if pages[before] or pages[after] or before in numerals or after in numerals:
            return True
        return "\f" in self.lines[after][:2] or bare[before][-1] not in ".!?:;…" or bare[after][0].islower()

    @staticmethod
    def _between(bare: list[str], i: int) -> bool:
        before = next((x for x in reversed(bare[:i]) if x), ".")
        after = next((x for x in bare[i + 1 :] if x), "A")
        return len(bare) > 3 and len(bare[i]) <= 3 and bare[i][0] != "0" and before[-1] in ".!?;…" and not after[0].islower()

    @staticmethod
    def _rising(values: dict[int, int]) -> set[int]:
        out, at = set(), sorted(values)
        for a, b in zip(at, at[1:]):
            if 0 < values[b] - values[a] <= 3 and b - a > 2:
                out |= {a, b}
        return out

    def next_body(self, i: int) -> int:
        j = i + 1
        while j < len(self.lines) and not self.body[j]:
            j += 1
        return j if j < len(self.lines) else -1

    def splits(self) -> Iterator[tuple[int, int, str, str, str]]:
        """(line, next body line, left part, hyphen, right part) of each word that may go on in the next body line."""
        for i, line in enumerate(self.lines):
            end = line.rstrip()
            if self.body[i] and end[-1] in _HYPHENS and (m := _LINE_END.search(end, _word_start(end))):
                j = self.next_body(i)
                if j < 0:
                    continue
                start = self.lines[j].replace("\f", " ")
                n = _LINE_START.match(start, len(start) - len(start.lstrip()))
                if n:
                    yield i, j, m[1], m[2], n[0].rstrip("!|")


def _word_start(line: str) -> int:
    """Where the last run without white space begins."""
    at = len(line)
    while at and not line[at - 1].isspace():
        at -= 1
    return at


def _partial_counts(batches: Iterator[pd.DataFrame], flush: int = 300_000) -> Iterator[pd.DataFrame]:
    words: Counter = Counter()
    for pdf in batches:
        for text in pdf["_text"]:
            words.update(TOKEN.findall(plain(text)))
        if len(words) > flush:
            yield pd.DataFrame(list(words.items()), columns=["word", "n"])
            words.clear()
    yield pd.DataFrame(list(words.items()), columns=["word", "n"])


class Listed:
    """Which of some words are in a bitmap; remembers what it was asked, within a bound."""

    def __init__(self, bits: bytes, most: int = 500_000):
        self.bits, self.most, self.seen, self.hits = bits, most, set(), set()

    def __call__(self, tokens: set[str]) -> set[str]:
        if len(self.seen) >= self.most:
            self.seen.clear()
            self.hits.clear()
        for token in tokens - self.seen:
            at = zlib.crc32(token.encode()) % (8 * len(self.bits))
            if self.bits[at >> 3] >> (at & 7) & 1:
                self.hits.add(token)
            self.seen.add(token)
        return tokens & self.hits


def _needs(doubted: bytes, readings: bytes):
    columns = ["_key", "token", "kind", "before", "after", "n"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        in_doubt, is_reading = Listed(doubted), Listed(readings)
        pairs: Counter = Counter()

        def flush() -> pd.DataFrame:
            near = is_reading({t for pair in pairs for t in pair})
            out = [(None, a, "pair", b, "", n) for (a, b), n in pairs.items() if a in near or b in near]
            pairs.clear()
            return pd.DataFrame(out, columns=columns)

        for pdf in batches:
            rows = set()
            for key, text in zip(pdf["_key"], pdf["_text"]):
                found = TOKEN.findall(plain(text))
                pairs.update(zip(found, found[1:]))
                if asked := in_doubt(set(found)):
                    same = zlib.crc32(text.encode("utf-8", "replace"))
                    for k, t in enumerate(found):
                        if t in asked:
                            rows.add((key, t, "word", found[k - 1] if k else "", found[k + 1] if k + 1 < len(found) else "", same))
                if _MAY_SPLIT.search(text):
                    for _, _, left, _, right in Layout(text).splits():
                        for t in (left + right, left, right):
                            rows.add((key, t.lower(), "part", "", "", 1))
                if len(pairs) > 200_000:
                    yield flush()
            yield pd.DataFrame(list(rows), columns=columns)
        yield flush()

    return run


class Decoder:
    """Decides on the words of one text.

    ``cands`` has the readings (word, log channel probability, count) of each token in doubt, the token itself among them; ``pairs``
    the count of a pair of words and of its first word; ``total`` the words of the collection. A token that stays as it is has the
    channel probability ``real``: the share of rare tokens confusable with a common word that are words of their own.
    """

    def __init__(self, cands: dict[str, list[tuple[str, float, int]]], pairs: dict[tuple[str, str], tuple[int, int]], hot: frozenset[str], least: int, total: int, real: float = 1 / 256, weight: float = 0.5):
        self.cands, self.pairs, self.hot, self.least, self.total, self.real, self.weight = cands, pairs, hot, least, max(total, 1), math.log(real), weight

    def count(self, word: str) -> int:
        if word in self.hot:
            return 1 << 30
        return next((n for w, _, n in self.cands.get(word, ()) if w == word), 0)

    def options(self, token: str) -> list[tuple[str, float, int]]:
        """Readings of a token, always itself among them."""
        found = self.cands.get(token, ())
        if token in self.hot or not found:
            return [(token, 0.0, max(self.count(token), 1))]
        others = [(w, p, n) for w, p, n in found if w != token]
        return [(token, self.real if others else 0.0, max(self.count(token), 1)), *others]

    def best(self, token: str) -> str:
        """The likeliest reading without neighbours."""
        own = self.count(token)
        options = [(w, p, n) for w, p, n in self.options(token) if w != token or own]
        return max(options, key=lambda o: o[1] + math.log(o[2]), default=(token,))[0]

    def line(self, found: list[str]) -> list[str]:
        """The most likely words of a line: Viterbi over channel and interpolated word-pair probabilities."""
        best: dict[str, tuple[float, tuple]] = {"": (0.0, ())}
        for token in found:
            step: dict[str, tuple[float, tuple]] = {}
            for word, channel, n in self.options(token):
                for before, (score, path) in best.items():
                    both, first = self.pairs.get((before, word), (1, 1))
                    s = score + channel + math.log(self.weight * (both - 1) / first + (1 - self.weight) * n / self.total)
                    if word not in step or s > step[word][0]:
                        step[word] = (s, (path, word))
            best = step
        _, path = max(best.values(), key=lambda x: x[0])
        out = []
        while path:
            path, word = path
            out.append(word)
        return out[::-1]

    def is_split(self, left: str, hyphen: str, right: str) -> bool:
        if hyphen != "-":
            return True
        joined = (left + right).lower()
        if self.count(joined) >= 2 or self.best(joined) != joined:
            return True
        if self.count(left.lower()) >= self.least and self.count(right.lower()) >= self.least:
            return False
        return right[0].islower() and self.count(right.lower()) < self.least


def _restore(word: str, true: str) -> str:
    """``true`` in the case of ``word``."""
    letters = [c for c in word if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return true.upper()
    return true[0].upper() + true[1:] if word[0].isupper() or (not word[0].isalpha() and len(letters) > 1 and letters[0].isupper()) else true


def repair(text: str, decoder: Decoder) -> tuple[str, list[tuple[int, str]]]:
    """The text in continuous paragraphs, and (line number from 1, noise) of each trace of the pages.

    A text without any trace stays as it is.
    """
    layout = Layout(text)
    noise = [(i + 1, "header") for i, h in enumerate(layout.header) if h] + [(i + 1, "page_number") for i, p in enumerate(layout.page) if p]
    joins: dict[int, tuple[int, str, str]] = {}
    for i, j, left, hyphen, right in layout.splits():
        if decoder.is_split(left, hyphen, right):
            joins[i] = (j, left, right)
            noise.append((i + 1, "hyphen"))
    starts = {j: right for j, _, right in joins.values()}
    lines = list(layout.lines)
    for i, line in enumerate(layout.lines) if len(decoder.cands) else ():
        if not layout.body[i]:
            continue
        found = tokens(line)
        words = [t for _, _, t in found]
        if not any(t in decoder.cands for t in words):
            continue
        changed = False
        for (a, b, t), true in reversed(list(zip(found, decoder.line(words)))):
            part = i in joins and b >= len(line.rstrip()) - 1 or i in starts and line[:a].strip() == ""
            if true != t and not part:
                lines[i] = lines[i][:a] + _restore(line[a:b], true) + lines[i][b:]
                changed = True
        if changed:
            noise.append((i + 1, "chars"))
    fixed: dict[int, str] = {}
    for i, (j, left, right) in joins.items():
        joined = left + right
        true = decoder.best(joined.lower())
        if true != joined.lower():
            fixed[i] = _restore(joined, true)
            # the line that holds the misreading: the part that differs from the word's own beginning or end
            noise.append(((i if not true.startswith(left.lower()) else j) + 1, "chars"))
    if not noise:
        return text, []
    return _flow(layout, lines, joins, fixed), sorted(set(noise))


def _flow(layout: Layout, lines: list[str], joins: dict[int, tuple[int, str, str]], fixed: dict[int, str]) -> str:
    out: list[str] = []
    paragraph: list[str] = []
    carry: tuple[str, str, str] | None = None  # line so far without the left part, the word, the right part in the next line

    def close() -> None:
        if paragraph:
            out.append(" ".join(paragraph))
            paragraph.clear()

    gap = False
    for i, line in enumerate(lines):
        if layout.blank[i]:
            gap = gap or not carry
            continue
        if not layout.body[i]:
            continue
        text = line.replace("\f", " ").strip()
        if carry:
            head, word, right = carry
            rest = text[len(right) :] if text.startswith(right) else text[max(0, len(right)) :]
            text, carry = (head + word + rest).strip(), None
        else:
            after_noise = i > 0 and (layout.header[i - 1] or layout.page[i - 1])
            runs_on = after_noise and paragraph and paragraph[-1][-1:] not in ".!?:;…"
            if (gap and not runs_on) or _ITEM.match(text):
                close()
        gap = False
        if i in joins:
            _, left, right = joins[i]
            cut_at = len(text) - len(left) - 1
            carry = (text[:cut_at] if cut_at > 0 else "", fixed.get(i, left + right), right)
            continue
        paragraph.append(text)
    if carry:
        paragraph.append(carry[0] + carry[1])
    close()
    return "\n\n".join(out)


def _final(hot: frozenset[str], key: str, least: int, total: int, real: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, text, cands, pairs in zip(pdf["_key"], pdf["_text"], pdf["cands"], pdf["pairs"]):
                if not isinstance(text, str):
                    rows.append((k, None, []))
                    continue
                found = {} if cands is None else {c["token"]: [(o["word"], o["p"], int(o["n"])) for o in c["options"]] for c in cands}
                near = {} if pairs is None else {(p["a"], p["b"]): (int(p["n"]), int(p["first"])) for p in pairs}
                fixed, noise = repair(text, Decoder(found, near, hot, least, total, real))
                rows.append((k, fixed, [{"line_no": i, "noise": n} for i, n in noise]))
            yield pd.DataFrame(rows, columns=[key, "repaired", "noise"])

    return run


def _bitmap(tokens: DataFrame) -> bytes:
    return bitmap(tokens, F.crc32(F.encode("token", "UTF-8")), key_bits(tokens.count()))


@F.pandas_udf(DoubleType())
def _channel(token: pd.Series, word: pd.Series) -> pd.Series:
    return pd.Series([channel(t, w) for t, w in zip(token, word)], dtype="float64")


@F.pandas_udf(DoubleType())
def _chances(word: pd.Series) -> pd.Series:
    return word.map(chances).astype("float64")


def repair_scans(df: DataFrame, key: str = "extract_id", text: str = "text", least: int = 5, real: float = 1 / 256, sure: float = 64.0) -> DataFrame:
    """(key, repaired, noise): each text in continuous paragraphs and its (line_no, noise) list.

    A noisy channel: the readings of a token are the words of the whole collection, ``least`` times in it at least, that
    character confusions turn into it, however many. A word and its misreadings share a key of strokes, so readings
    are found by one join by key. The confusion probabilities hold for damaged pages; the share of damaged words in the
    collection is measured by the misreadings that put figures and signs into words. A token stays among its own readings with the
    probability ``real``. Viterbi chooses the readings of a line by channel and interpolated word-pair probabilities; pairs are
    counted around the readings of those tokens whose odds without neighbours are within a factor of ``sure`` of even, and tokens
    whose odds are above that factor against every reading are not in doubt. The pairs of a token in doubt are counted
    once for each different text, without the one at hand.
    Page numbers, running headers and line-end hyphens are told by the layout of the text, hyphens
    also by whether the joined word occurs in the collection.

    Counts cover all rows and are added up in each task before they are shuffled. Words so frequent that no reading
    can be likelier (at most 12 / share of the most frequent word) and two bitmaps of 16 MB at the most, which say what words
    may be in doubt, are all that is sent to the tasks. All other look-ups are joins, so that no vocabulary is held.

    Rows without traces keep their text. A null text stays null with an empty list, an empty one stays empty.
    Repeated keys are repaired each for itself with the look-ups of all their rows; a row without a key gets no look-ups,
    so only its headers and page numbers are told. Other columns are left out.
    """
    kind = df.schema[key].dataType.simpleString()
    # keys travel as text: pandas would make floats of numbers beside a null
    rows = df.select(F.col(key).cast("string").alias("_key"), F.col(text).alias("_text"))
    full = rows.where(F.col("_text").rlike(r"\S") & F.col("_key").isNotNull())
    words = cut(full.select("_text").mapInPandas(_partial_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("word").rlike(r"\p{L}")))
    sums = words.agg(F.max("n"), F.sum("n")).first()
    most, total = sums[0] or 0, sums[1] or 0
    targets = words.where(F.col("n") >= least).select(strokes_of(F.col("word")).alias("k"), "word", "n")
    highest = max(math.exp(q) for _, _, q in CONFUSIONS)

    def read(tokens: DataFrame) -> DataFrame:
        """(token, own, word, n, p) of every reading of (token, own)."""
        both = tokens.withColumn("k", strokes_of(F.col("token"))).join(targets, "k").where(F.col("token") != F.col("word"))
        # the most likely misreading bounds the odds of all
        both = both.where(F.col("n") * highest * sure >= real * F.col("own"))
        return both.select("token", "own", "word", "n", _channel("token", "word").alias("p")).where("p IS NOT NULL")

    readings = cut(read(words.select(F.col("word").alias("token"), F.col("n").alias("own"))))
    marked = readings.where(F.col("token").rlike(_MARKED.pattern) & ~F.col("word").rlike(_MARKED.pattern)).groupBy("token").agg(F.first("own").alias("own"))
    seen = marked.agg(F.sum("own")).first()[0] or 0
    due = targets.where(~F.col("word").rlike(_MARKED.pattern)).agg(F.sum(F.col("n") * _chances("word"))).first()[0] or 0
    damaged = min(1.0, max(seen, 1) / max(due, 1.0))
    odds = F.exp("p") * F.lit(damaged) * F.col("n") / (F.lit(real) * F.greatest("own", F.lit(1)))
    hot_from = max(most / 12, most * highest * damaged * sure / real, least)
    hot = frozenset(r[0] for r in words.where(F.col("n") > hot_from).select("word").collect())

    def options(found: DataFrame) -> DataFrame:
        """(token, options, unsure): the readings that may be right, the token itself among them."""
        found = found.withColumn("odds", odds).where(F.col("odds") * sure >= 1)
        each = F.struct("word", (F.col("p") + math.log(damaged)).alias("p"), "n")
        top, own = F.max("odds"), F.struct(F.col("token").alias("word"), F.lit(0.0).alias("p"), F.first("own").alias("n"))
        close = F.array_size(F.filter(F.collect_list("odds"), lambda o: o * sure >= F.lit(1)))
        grouped = found.groupBy("token").agg(F.collect_list(each).alias("found"), own.alias("self"), ((top <= sure) | (close > 1)).alias("unsure"))
        return grouped.select("token", F.concat("found", F.array("self")).alias("options"), "unsure")

    doubted = cut(options(readings.where(~F.col("token").isin(*hot) if hot else F.lit(True))))
    # a word that its neighbours must decide on: pairs are counted around its readings
    several = doubted.where("unsure").select("token", F.explode("options.word").alias("word")).where("token <> word").select(F.col("word").alias("token")).distinct()
    bits = [_bitmap(doubted.select("token")), _bitmap(several)]
    needs = cut(full.mapInPandas(_needs(*bits), "_key string, token string, kind string, before string, after string, n long"))
    parts = needs.where("kind = 'part'").select("_key", "token").distinct()
    known = parts.select("token").distinct().join(words.select(F.col("word").alias("token"), F.col("n").alias("own")), "token", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    own_only = known.where("own > 0").select("token", F.array(F.struct(F.col("token").alias("word"), F.lit(0.0).alias("p"), F.col("own").alias("n"))).alias("alone"))
    part_options = own_only.join(options(read(known)), "token", "full").select("token", F.coalesce("options", "alone").alias("options"))
    sent = needs.where("kind = 'word'").select("_key", "token").distinct().join(doubted.select("token", "options"), "token")
    sent = sent.unionAll(parts.join(part_options, "token").select("token", "_key", "options"))
    by_key = sent.groupBy("_key").agg(F.collect_list(F.struct("token", "options")).alias("cands"))
    counts = needs.where("kind = 'pair'").groupBy(F.col("token").alias("a"), F.col("before").alias("b")).agg(F.sum("n").alias("n"))
    # a token speaks for itself once for each different text around it: copies of a damaged text are no evidence
    alone = needs.where("kind = 'word'").select("token", "before", "after", F.col("n").alias("text"))
    alone = alone.select("text", F.explode(F.array(F.struct(F.col("before").alias("a"), F.col("token").alias("b")), F.struct(F.col("token").alias("a"), F.col("after").alias("b")))).alias("x"))
    alone = alone.select("text", "x.*").where("a <> '' AND b <> ''").distinct().groupBy("a", "b").agg(F.count(F.lit(1)).alias("texts"))
    counts = counts.join(alone, ["a", "b"], "full").select("a", "b", F.coalesce("texts", "n").alias("n"))
    near = needs.where("kind = 'word'").join(doubted.where("unsure"), "token").select("_key", "before", "after", F.explode("options.word").alias("word"))
    asked_pairs = near.select("_key", F.col("before").alias("a"), F.col("word").alias("b")).unionAll(near.select("_key", F.col("word").alias("a"), F.col("after").alias("b")))
    asked_pairs = asked_pairs.where("a <> '' AND b <> ''").distinct()
    pairs = asked_pairs.join(counts, ["a", "b"]).join(words.select(F.col("word").alias("a"), F.col("n").alias("first")), "a", "left").withColumn("first", F.coalesce("first", "n"))
    pairs = pairs.groupBy("_key").agg(F.collect_list(F.struct("a", "b", "n", "first")).alias("pairs"))
    joined = rows.join(by_key, "_key", "left").join(pairs, "_key", "left").select("_key", "_text", "cands", "pairs")
    out = joined.mapInPandas(_final(hot, key, least, total, real), f"`{key}` string, repaired string, noise array<struct<line_no:int,noise:string>>")
    return out.withColumn(key, F.col(key).cast(kind))
