"""Problem 3: personal information inside free text, found on a normalised copy and replaced in the source."""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import cut

_STREETS = "street|st|avenue|ave|road|rd|drive|dr|lane|ln|court|ct|close|boulevard|blvd|place|pl|terrace|way|crescent|square|sq|highway|hwy|parkway|pkwy"
_NOT_STREET = "the|a|an|and|or|of|for|in|on|at|to|by|from|with|no|new|this|that|was|were|has|had|have|is|are|it|way|per|each|entries|copies|times|chairs|lot|form|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
_W = r"[^\W\d_][\w'’]*"
_I = re.IGNORECASE

_EMAIL_LEFT = re.compile(r"[^\W_](?:[\w.+%'-]*[\w+%-])?")
_EMAIL_RIGHT = re.compile(r"(?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W\d_]{2,24}(?![\w-])")
#: Disguises of an address: a bracketed or spoken "at", bracketed or spoken "dot"s on both sides.
_DOT_FORM = r"\s*[\[({<]\s*(?:dot|\.)\s*[\])}>]\s*|\s+dot\s+"
_AT_FORM = r"\s*[\[({<]\s*(?:at|@)\s*[\])}>]\s*|\s+at\s+"
_DISGUISED = re.compile(rf"(?<![\w.+-])[^\W_][\w.+%-]*(?:(?:{_DOT_FORM})[\w+%-][\w.+%-]*)*(?:{_AT_FORM})[\w-]+(?:(?:{_DOT_FORM}|\.)[\w-]+)+", _I)
_AT = re.compile(_AT_FORM, _I)
_DOT = re.compile(_DOT_FORM, _I)
_BRACKET_AT = re.compile(r"[\[({<]\s*(?:at|@)\s*[\])}>]", _I)
_SPELLED = {w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine".split())} | {"oh": "0"}
_SPELLED_RUN = re.compile(r"\b(?:{0})(?:[\s,-]+(?:{0})){{6,}}\b".format("|".join(_SPELLED)), _I)
_SPELLED_HINT = re.compile(r"\b(?:{0})[\s,-]+(?:{0})[\s,-]+(?:{0})\b".format("|".join(_SPELLED)))
#: Look-alikes of other scripts and full-width forms, each one character for one (fixed values).
HOMOGLYPHS = str.maketrans("АВЕКМНОРСТХаеорсухіѕјԁոΑΒΕΖΗΙΚΜΝΟΡΤΥΧορ", "ABEKMHOPCTXaeopcyxisjdnABEZHIKMNOPTYXop") | {0xFF01 + i: 0x21 + i for i in range(94)}
_FOREIGN = re.compile("[Ͱ-ԯ！-～]")

#: As below, what may not stand before is checked afterwards.
_PHONE = re.compile(
    r"(?:"
    r"(?:\+?1[\s.-]?)?(?:\([2-9]\d\d\)[\s.-]?|[2-9]\d\d[\s.-])\d{3}[\s.-]\d{4}"
    r"|\+1[2-9]\d{9}|[2-9]\d{2}[2-9]\d{6}"
    r"|(?:\+|00(?=[1-9]\d?[\s./-]))(?!1\b)[1-9]\d{0,2}(?:[\s.-]?\(0\))?(?:[\s./-]?\(?\d{1,5}\)?){2,6}"
    r"|0\d{1,4}(?:[\s./-]\d{2,6}){2,4}"
    r")(?:,?\s*(?:ext\.?|extension|x|durchwahl|poste)\s*\d{1,6})?(?![\w-])",
    _I,
)
_ID_WORDS = r"(?:ssn|ss\s?#|ss\s?no\.?|soc(?:ial|\.)\s+sec(?:urity|\.)|(?:taxpayer|tax)\s+(?:id|number)|itin|tin|steuer-?\s*id(?:nr)?\.?|id-?nr\.?|identifikationsnummer|nir|n°\s+de\s+s[ée]curit[ée]\s+sociale|num[ée]ro\s+de\s+s[ée]curit[ée]\s+sociale|dni|nie|nif|passport|reisepass(?:nummer)?|passeport|pasaporte|driver['’]?s\s+licen[sc]e|driving\s+licen[sc]e|dl|national\s+insurance|personalausweis)"
#: Searched in a lower-case copy; that no word character stands before is checked afterwards, so that the search can skip by first letters.
_ID_ANNOUNCED = re.compile(
    rf"{_ID_WORDS}(?:\s+(?:no\.?|nr\.?|number|num\.?|id|n°))?[\s:=#.]{{0,4}}"
    r"([0-37-8]\s?\d{2}\s?\d{2}\s?\d[\dab]\s?\d{3}\s?\d{3}\s?\d{2}|\d{2}\s\d{3}\s\d{3}\s\d{3}|\d{3}[\s-]\d{2}[\s-]\d{4}|[a-z]?\d[\d-]{5,18}\d[a-z]?|[a-z]{1,2}\d{6,9}[a-z]?)(?![\w-])"
)
_ID_DIGITS = re.compile(r"(?:\d{3}-\d{2}-\d{4}|\d{8}-?[A-HJ-NP-TV-Z]|[0-37-8]\s\d{2}\s\d{2}\s\d[\dAB]\s\d{3}\s\d{3}\s\d{2})(?![\w-])(?!\s\d)")
_ID_LETTER = re.compile(r"[A-Z]\d(?:\d{6}[A-HJ-NP-TV-Z]|\d{2}-\d{4}-\d{4})(?![\w-])")
#: Where a number may begin: not going on from a word or number before it.
_NUMBER_START = re.compile(r"(?<![\w+.(/-])(?<!\d )[+(\d]")
_CITY_ZIP = rf"(?:,\s+{_W}(?:[\s-]{_W}){{0,2}},\s+[A-Za-z]{{2}}\s+\d{{5}}(?:-\d{{4}})?|,\s+(?!(?:{_NOT_STREET})\b){_W})"
_UNIT = r"(?:,?\s+(?:apt|apartment|unit|suite|ste|floor|fl|room)\.?\s*\#?\w{1,5}|,?\s+\#\s?\w{1,5})"
_ADDRESS = re.compile(
    rf"[1-9]\d{{0,4}}[A-Za-z]?\s+(?:[NSEW]{{1,2}}\.?\s+)?(?!(?:{_NOT_STREET})\b)[^\W\d_][\w'’-]*(?:\s+(?!(?:{_NOT_STREET})\b)[^\W\d_][\w'’-]*)?\s+(?:{_STREETS})\b\.?(?!\s+(?:points?|bill|site)\b){_UNIT}?{_CITY_ZIP}?",
    _I,
)
_BOX = re.compile(rf"P\.?\s*O\.?\s+Box\s+\d{{1,6}}{_CITY_ZIP}?", _I)
_HAS_STREET = re.compile(rf"\d[A-Za-z]?\s+(?:[^\W\d_]['’.\w-]*\s+){{1,3}}(?:{_STREETS})\b", _I)
_PLACE = rf",\s+\d{{5}}\s+{_W}(?:-{_W})?"
_HOUSE = rf"\s+\d{{1,4}}[a-z]?(?:,\s+\d{{5}}\s+{_W})?(?!\w)"
#: German streets end in their kind; the word before it is taken in afterwards, so that the search can go by the kinds.
_GERMAN_ADDRESS = re.compile(rf"(?:straße|strasse|str\.|weg|allee|gasse|platz|ufer|damm){_HOUSE}", _I)
_GERMAN_KINDS = ("straße", "strasse", "str.", "weg", "allee", "gasse", "platz", "ufer", "damm")
#: Patterns and the words of which one stands in everything they match.
_FOREIGN_ADDRESSES = (
    re.compile(rf"(?<![\w./-])\d{{1,4}}(?:\s+(?:bis|ter))?,?\s+(?:rue|avenue|boulevard|chemin|impasse|quai|place|allée)\s+(?:(?:des|de\s+la|de\s+l['’]|du|de|d['’])\s*)?{_W}(?:[-\s]{_W}){{0,2}}{_PLACE}", _I),
    ("rue", "avenue", "boulevard", "chemin", "impasse", "quai", "place", "allée"),
    re.compile(rf"(?<!\w)(?:calle|avenida|avda\.|plaza|paseo|camino)\s+(?:(?:de\s+las|de\s+los|de\s+la|del|de)\s+)?{_W}(?:\s+{_W}){{0,2}}{_HOUSE}", _I),
    ("calle", "avenida", "avda.", "plaza", "paseo", "camino"),
    re.compile(r"(?<!\w)(?:Postfach|Apartado(?:\s+de\s+Correos)?|BP)\s+\d{2,6}(?!\w)", _I),
    ("postfach", "apartado", "bp"),
)

_N = r"[^\W\d_](?:[^\W\d_]|['’](?=[^\W\d_]))+(?:-[^\W\d_]{2,})*"
_PARTICLE = r"(?:(?:van\s+der|van\s+den|van|von|de\s+la|de|der|del|di|da|bin|al|le|la)\s+)?"
_FULL = rf"(?:{_N}|[^\W\d_]\.)(?:\s+[^\W\d_]\.)?\s+{_PARTICLE}{_N}"
_FULL_LINE = _FULL.replace(r"\s+", "[ \\t]+")
_SURNAME_FIRST = rf"{_PARTICLE}{_N},\s+{_N}(?:\s+[^\W\d_]\.)?(?!\w)"
_TITLE = r"(?:mrs?|ms|miss|dr|prof|coach|sir|herr|frau|mme|mlle|monsieur|madame|mademoiselle|sra?|srta|señora?|don|doña)\b\.?"
#: Words that announce a name (any case of the name counts after a label with a colon).
_LABEL = re.compile(r"(recipient|attendee|attn|attention|b?cc|signé|firmado|gezeichnet|unterzeichnet|name|signature|employee|patient|owner|author|sender|from|empfänger|absender|destinataire|expéditeur|destinatario|remitente|nom|nombre)\s?$")
_PHRASES = {
    key: re.compile(key + rest + r"\s+")
    for key, rest in (
        ("dear", ""), ("spoke", r"\s+(?:with|to)"), ("signed", r"(?:\s+by)?"), ("approved", r"\s+by"), ("contact", "(?:er)?"), ("vu", r"\s+avec"), ("visto", r"\s+con"), ("bitte", r"\s+an"), ("mit", ""),
        ("preguntar", r"\s+a"), ("owner", ""), ("liebe", "r?"), ("cher", ""), ("chère", ""), ("estimad", "[oa]"), ("atte", r"\."), ("regards", ","), ("--", ""), ("ask", ""), ("call", ""), ("tell", ""), ("meet", ""), ("attn", r"\.?"),
    )
}
#: Announcing words that common words may follow too: these need a name that looks like one.
_WEAK = frozenset("mit bitte contact name from owner preguntar -- ask call tell meet attn".split())
#: What follows a name at the head of a contact line, or who does something; the name before it is matched up to that place.
_CONTACT = re.compile(r"\|\s*[+(\d]")
_DOINGS = ("will", "wrote", "called", "said", "asked", "signed", "joined", "resigned", "retired")
#: A person named beside a calling: "our caretaker, Ada Moss, left".
_APPOSITION = re.compile(rf",\s+({_FULL}),\s+(?=[a-z])")
_AFTER = re.compile(rf"(?<![\w.@-])(?:{_TITLE}\s+)?({_SURNAME_FIRST}|{_FULL}|{_N})$", _I)
_INITIALS = re.compile(rf"(?<![\w.@-])((?:[^\W\d_]\.\s+){{1,2}}{_PARTICLE}{_N})$", _I)
_TITLED = re.compile(rf"(?:Mrs?|MRS?|Ms|MS|Miss|Dr|DR|Prof|Coach|COACH|Herr|HERR|Frau|FRAU|Mme|MME|Mlle|Monsieur|MONSIEUR|Madame|Sra?|SRA?|Srta|Señora?)\b\.?\s+({_FULL_LINE}|{_PARTICLE}{_N})")
_NAMED = re.compile(rf"({_SURNAME_FIRST})|({_FULL})|({_N})", _I)
#: A cell that holds a name alone.
_CELL = re.compile(rf"\s*({_SURNAME_FIRST}|{_FULL})(?:\s*\([^()]*\))?\s*", _I)
_AFTER_TITLE = re.compile(rf"{_TITLE}\s+({_FULL_LINE}|{_PARTICLE}{_N})", _I)
_FRENCH_M = re.compile(rf"M\.\s+({_N})")
_STOP = frozenset(
    """about the and will on for by at in to of before after with from is was were are has had have a an as it its this that if or not no be
    desk team office all sir madam everyone colleagues friday monday tuesday wednesday thursday saturday sunday der die das dem den des und
    besprochen por la el los las le les avant apres après vendredi herr frau mr mrs ms miss dr prof coach mme mlle monsieur madame sr sra srta
    page copy second first list box key forms handover recipient attendee cc dear contact spoke approved signed home tel phone fax call cell
    reach write send ship deliver mailing reply questions over since twice every please ask our we you she he they there keep see item price
    nobody whoever why use signé firmado gezeichnet unterzeichnet rückfragen preguntar contacter visto""".split()
)
_SENTENCE_EDGE = frozenset(["", *"\n\r|.!?;:-)>…"])
_NO_NAME_AFTER = frozenset("@.+-_") | frozenset(map(chr, range(48, 58))) | frozenset(map(chr, range(65, 91))) | frozenset(map(chr, range(97, 123)))
_CAP = r"[A-ZÀ-ÖØ-ÞŠŽ]"
_PARTICLES = frozenset("van von de der den del di da la le bin al".split())
_CAPITAL = re.compile(rf"(?<![\w@]){_CAP}(?:[^\W\d_]|['’](?=[^\W\d_]))+")
_UPPER = rf"{_CAP}(?:[^\W\d_]|['’](?=[^\W\d_]))+(?:-{_CAP}[^\W\d_]+)?(?!-\w)"
_BETWEEN = "(?:van der|van|von|de la|de|der|del|di|da|VAN|VON|DE)"
_GIVEN_FIRST = re.compile(rf"{_UPPER}(?![\w@+])(?:\s+{_CAP}\.)?\s+(?:{_BETWEEN}\s+)?{_UPPER}(?![\w@])")
_GIVEN_LAST = re.compile(rf"{_UPPER}(?:\s+{_CAP}\.(?=\W))?(?![\w@+-])")
_BEFORE_COMMA = re.compile(rf"(?<![\w@.+-])(?:{_BETWEEN}\s+)?{_UPPER}$")


class Lexicon(NamedTuple):
    """What a collection tells about its capitalised words (lower case): given names, and words that are seldom part of a name."""

    given: frozenset[str] = frozenset()
    others: frozenset[str] = frozenset()


class Finder:
    """Finds personal values in a text; ``lexicon`` may come from ``learn_names``, without one names are told by titles, labels, phrases and shape."""

    kinds = ("email", "phone", "id_number", "address", "name")

    def __init__(self, lexicon: Lexicon = Lexicon()):
        self.given, self.others = lexicon

    def is_name(self, value: str, strong: bool) -> bool:
        """The words may be a name: none stops one, and one is a given name or the context is ``strong``; else their shape and rarity decide."""
        words = re.findall(r"[^\W\d_]+", value.lower())
        if not words or any(w in _STOP for w in words if len(w) > 1):
            return False
        known = any(w in self.given for w in words) or re.match(rf"{_CAP}\.\s+{_CAP}", value) is not None
        full = [w for w in words if len(w) > 1 and w not in _PARTICLES]
        if len(full) < 2 and not re.match(r"[^\W\d_]\.\s", value):
            return False
        cased = all(w[0].isupper() or w in _PARTICLES for w in re.findall(r"[^\W\d_]+", value))
        return known or (cased and (strong or self.unheard(full)))

    def unheard(self, words: list[str]) -> bool:
        """None of the words is one of those that are seldom part of a name (without any lexicon nothing is known of them)."""
        return bool(self.others) and not any(w in self.others for w in words)

    def __call__(self, source: str) -> list[tuple[int, int, str]]:
        """(start, end, kind) in ``source``, in order and without overlaps."""
        text, back = normalise(source)
        spans: list[tuple[int, int, int, str]] = []
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        has_digit = any(d in text for d in "0123456789")
        for at in _find_all(text, "@"):
            from_ = _run_start(text, at, lambda c: c.isalnum() or c in "_.+%'-")
            while from_ < at and not text[from_].isalnum():
                from_ += 1
            if from_ < at and _EMAIL_LEFT.fullmatch(text, from_, at) and (right := _EMAIL_RIGHT.match(text, at + 1)):
                spans.append((0, from_, right.end(), "email"))
        if has_digit:
            starts = [m.start() for m in _NUMBER_START.finditer(text)]
            spans += [(1, m.start(1), m.end(1), "id_number") for m in _ID_ANNOUNCED.finditer(low) if 7 <= sum(c.isdigit() for c in m[1]) <= 15 and _free(text, m.start())]
            spans += [(1, *m.span(), "id_number") for m in _numbers(_ID_DIGITS, text, starts)]
            spans += [(1, *m.span(), "id_number") for m in _ID_LETTER.finditer(text) if _free(text, m.start())]
            for hint in _HAS_STREET.finditer(text):
                at = hint.start()
                while at and text[at - 1].isdigit():
                    at -= 1
                if (at == 0 or not (text[at - 1].isalnum() or text[at - 1] in "_./-")) and (m := _ADDRESS.match(text, at)):
                    spans.append((2, m.start(), m.end() - m[0].endswith("."), "address"))
            if "box" in low:
                spans += [(2, *m.span(), "address") for m in _BOX.finditer(text) if _free(text, m.start())]
            for m in _GERMAN_ADDRESS.finditer(text) if any(w in low for w in _GERMAN_KINDS) else ():
                at = _run_start(text, m.start(), lambda c: c.isalnum() or c in "_-")
                while at < m.start() and not text[at].isalpha():
                    at += 1
                if at < m.start():
                    spans.append((2, at, m.end(), "address"))
            for pattern, words in zip(_FOREIGN_ADDRESSES[::2], _FOREIGN_ADDRESSES[1::2]):
                if any(w in low for w in words):
                    spans += [(2, *m.span(), "address") for m in pattern.finditer(text)]
            for m in _numbers(_PHONE, text, starts):
                main = re.split(r"(?i),?\s*(?:ext|x|durchwahl|poste)", m[0])[0]
                if 9 <= sum(c.isdigit() for c in main) <= 15:
                    spans.append((3, *m.span(), "phone"))
        spans += [(4, a, b, "name") for a, b in self.names(text, low)]
        spans.sort(key=lambda s: (s[0], s[1], -s[2]))
        taken: list[tuple[int, int, str]] = []
        used: list[tuple[int, int]] = []
        for _, a, b, kind in spans:
            if not any(a < y and x < b for x, y in used):
                used.append((a, b))
                taken.append((back(a), back(b - 1, True), kind))
        return sorted(taken)

    def names(self, text: str, low: str) -> list[tuple[int, int]]:
        out = []
        for m in self.known(text, low):
            out += self.free(text, m)
        out += [s for s, _ in self.told(text, low)]
        if (m := _CELL.fullmatch(text)) and self.is_name(m[1], True):
            out.append(m.span(1))
        for at in _find_all(text, ","):
            if text[at - 1 : at].islower() and (m := _APPOSITION.match(text, at)) and self.is_name(m[1], False):
                out.append(m.span(1))
        for end in self.tails(text, low):
            line = max(text.rfind("\n", 0, end), text.rfind("|", 0, end)) + 1
            # the words of a name at most; a line that holds one word of it goes on from the one before
            from_ = _words_back(text, end, 6)
            if line > from_ and " " in text[line:end].strip():
                from_ = line
            m = _AFTER.search(text[from_:end])
            short = _INITIALS.search(text[from_:end])
            if m and short and short.start(1) > m.start(1) and text[from_ + m.start(1) : from_ + short.start(1)].strip().lower() not in self.given:
                m = short
            if m:
                a, b = self.clean(text, from_ + m.start(1), from_ + m.end(1))
                # in the middle of a sentence only a known given name is enough
                first = text[max(0, a - 12) : a].rstrip(" \t")[-1:] in _SENTENCE_EDGE and "|" in text[end : end + 4]
                if self.is_name(text[a:b], first):
                    out.append((a, b))
        return [s for s in out if s[1] > s[0]]

    def known(self, text: str, low: str) -> Iterator[re.Match]:
        """The given names in the text."""
        if len(self.given) > 150:
            if self.given & {w.lower() for w in _CAPITAL.findall(text)}:
                yield from (m for m in _CAPITAL.finditer(text) if m[0].lower() in self.given)
            return
        for name in self.given:
            for at in _find_all(low, name):
                if (m := _CAPITAL.match(text, at)) and m.end() == at + len(name):
                    yield m

    @staticmethod
    def tails(text: str, low: str) -> set[int]:
        """Where a name may end that a contact or a doing follows."""
        out = set()
        for at in _find_all(text, "|"):
            if _CONTACT.match(text, at):
                out.add(len(text[:at].rstrip()) if text[at - 1 : at].isspace() else at)
        for word in _DOINGS:
            for at in _find_all(low, word):
                end = at + len(word)
                if at > 1 and text[at - 1].isspace() and text[end : end + 1].isspace() and text[end + 1 : end + 2].islower():
                    out.add(_run_start(text, at, str.isspace))
        return out

    def free(self, text: str, m: re.Match) -> list[tuple[int, int]]:
        """A given name with a surname after it, or before it and a comma."""
        at = m.start()
        out = []
        if text[at - 1 : at] not in _NO_NAME_AFTER and (n := _GIVEN_FIRST.match(text, at)) and self.is_name(n[0], False):
            out.append(n.span())
        if (comma := text[:at].rstrip()) and comma[-1] == "," and at > len(comma) and (g := _GIVEN_LAST.match(text, at)):
            from_ = _words_back(text, len(comma) - 1, 3)
            if (n := _BEFORE_COMMA.search(text[from_ : len(comma) - 1])) and self.is_name(n[0] + text[len(comma) - 1 : g.end()], False):
                out.append((from_ + n.start(), g.end()))
        return out

    def told(self, text: str, low: str) -> list[tuple[tuple[int, int], bool]]:
        """Names after a title, a label or an announcing phrase; the second value says whether the context alone makes it one."""
        out = []
        for m in _TITLED.finditer(text):
            if _free(text, m.start()):
                out.append((self.clean(text, *m.span(1)), True))
        for at, word, labelled in self.announced(text, low):
            if t := _AFTER_TITLE.match(text, at):
                out.append((self.clean(text, *t.span(1)), True))
            elif word in ("signé", "vu", "contact") and (t := _FRENCH_M.match(text, at)) and (word != "contact" or low[:at].rstrip().endswith("er")):
                out.append((t.span(1), True))
            elif n := _NAMED.match(text, at):
                a, b = self.clean(text, *n.span())
                sure = labelled or word not in _WEAK
                if self.is_name(text[a:b], sure):
                    out.append(((a, b), sure))
        return out

    @staticmethod
    def announced(text: str, low: str) -> Iterator[tuple[int, str, bool]]:
        """(offset of what follows, announcing word, whether it is a label with a colon)."""
        for at in _find_all(text, ":"):
            if m := _LABEL.search(low, max(0, at - 16), at):
                if _free(text, m.start()):
                    end = at + 1
                    while end < len(text) and text[end].isspace():
                        end += 1
                    yield end, m[1], True
        for key, pattern in _PHRASES.items():
            for at in _find_all(low, key):
                if (_free(text, at) if key != "--" else text[at - 1 : at] != "-") and (m := pattern.match(low, at)):
                    yield m.end(), key, False

    @staticmethod
    def clean(text: str, a: int, b: int) -> tuple[int, int]:
        """Cut trailing words that are no part of a name (a following sentence, say)."""
        words = [(m.start() + a, m.end() + a, m[0].lower()) for m in re.finditer(r"[^\W\d_]+", text[a:b])]
        while words and words[0][2] in _STOP and len(words[0][2]) > 1 and words[0][2] not in ("la", "le", "de", "der"):
            words.pop(0)
        for i, (x, y, w) in enumerate(words):
            if i and w in _STOP and w not in ("la", "le", "der", "del") and len(w) > 1:
                words = words[:i]
                break
        if not words:
            return a, a
        end = words[-1][1]
        if end < b and text[end : end + 1] == "." and len(words[-1][2]) == 1:
            end += 1
        return words[0][0], end


def _run_start(text: str, at: int, part) -> int:
    """Where the run of characters that are ``part`` begins which ends at ``at``."""
    while at and part(text[at - 1]):
        at -= 1
    return at


def _free(text: str, at: int) -> bool:
    """No word character stands before ``at``."""
    return at == 0 or not (text[at - 1].isalnum() or text[at - 1] == "_")


def _words_back(text: str, at: int, most: int) -> int:
    """Where the ``most``-th word before ``at`` begins."""
    for _ in range(most):
        at = _run_start(text, at, str.isspace)
        at = _run_start(text, at, lambda c: not c.isspace())
    return at


def _numbers(pattern: re.Pattern, text: str, starts: list[int]) -> Iterator[re.Match]:
    """Matches at the places where numbers begin, one after another."""
    end = 0
    for at in starts:
        if at >= end and (m := pattern.match(text, at)):
            yield m
            end = m.end()


def _find_all(text: str, what: str) -> Iterator[int]:
    at = text.find(what)
    while at >= 0:
        yield at
        at = text.find(what, at + 1)


def normalise(source: str):
    """The text with look-alikes, disguised addresses and spelled-out numbers resolved, and the way back.

    The second value maps the offset of a character in the normalised text to where it starts in the source, or with
    True to where it ends. Where nothing is replaced by a text of another length the mapping is the identity.
    """
    text = source.translate(HOMOGLYPHS) if not source.isascii() and _FOREIGN.search(source) else source
    edits: list[tuple[int, int, str]] = []
    low = text.lower()
    if "dot" in low or _BRACKET_AT.search(text):
        for m in _DISGUISED.finditer(text):
            whole = m[0]
            at = _AT.search(whole)
            if at is None or not (_DOT.search(whole, at.end()) or at[0].strip()[:1] in "[({<"):
                continue
            edits.append((m.start() + at.start(), m.start() + at.end(), "@"))
            edits += [(m.start() + d.start(), m.start() + d.end(), ".") for d in _DOT.finditer(whole) if d.end() <= at.start() or d.start() >= at.end()]
    if sum(map(low.count, _SPELLED)) > 6 and _SPELLED_HINT.search(low):
        for m in _SPELLED_RUN.finditer(text):
            for w in re.finditer(r"[A-Za-z]+", m[0]):
                edits.append((m.start() + w.start(), m.start() + w.end(), _SPELLED[w[0].lower()]))
            edits += [(m.start() + g.start(), m.start() + g.end(), "") for g in re.finditer(r"[\s,-]+", m[0])]
    if not edits:
        return text, lambda i, end=False: i + end
    edits.sort()
    parts, marks, at, new = [], [(0, 0, False)], 0, 0
    for a, b, by in edits:
        parts += [text[at:a], by]
        new += a - at
        marks.append((new, a, True))
        new += len(by)
        marks.append((new, b, False))
        at = b
    parts.append(text[at:])
    starts = [m[0] for m in marks]

    def back(i: int, end: bool = False) -> int:
        k = bisect.bisect_right(starts, i) - 1
        start, origin, edited = marks[k]
        if edited:
            return marks[k + 1][1] if end else origin
        return origin + i - start + end

    return "".join(parts), back


PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}
_FINDERS: dict[Lexicon, Finder] = {}


def finder(lexicon: Lexicon = Lexicon()) -> Finder:
    if lexicon not in _FINDERS:
        _FINDERS.clear()
        _FINDERS[lexicon] = Finder(lexicon)
    return _FINDERS[lexicon]


def name_counts(text: str, given: Counter, person: Counter, total: Counter) -> None:
    """Add the capitalised words of a text, and those that stand in names by their context alone."""
    total.update(w.lower() for w in _CAPITAL.findall(text))
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    for (a, b), sure in Finder().told(text, low):
        value = text[a:b]
        words = re.findall(r"[^\W\d_]+", value.lower())
        if sure and len(words) > 1:
            person.update(words)
            first = re.findall(r"[^\W\d_]+", value.split(",", 1)[1].lower())[:1] if "," in value else words[:1]
            given.update(w for w in first if len(w) > 1 and w not in _PARTICLES)


def learn_names(texts: DataFrame, text: str = "text", least: int = 3, share: float = 0.1, common: int = 20, min_share: float = 1e-5) -> Lexicon:
    """Given names and other capitalised words of a collection, by the contexts they stand in.

    A word that ``least`` times, and in ``share`` of its capitalised uses, opens a full name which a title, a label or an
    announcing phrase makes a name, is a given name. One of ``common`` capitalised uses, of which less than a
    fiftieth lie in such names, is none of a name's. Both must also be ``min_share`` of all such uses, so neither list has
    more than 1 / min_share words, whatever the collection's size. All texts are counted, each task adds up its own first.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        given, person, total = Counter(), Counter(), Counter()

        def flush() -> pd.DataFrame:
            out = pd.DataFrame([(w, given[w], person[w], n) for w, n in (total | person).items()], columns=["word", "given", "person", "total"])
            for c in (given, person, total):
                c.clear()
            return out

        for pdf in batches:
            for t in pdf["_text"]:
                name_counts(t, given, person, total)
            if len(total) > 300_000:
                yield flush()
        yield flush()

    each = texts.where(F.col(text).isNotNull()).select(F.col(text).alias("_text")).mapInPandas(count, "word string, given long, person long, total long")
    words = cut(each.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("given", "person", "total")]))
    sums = words.agg(F.sum("given"), F.sum("total")).first()
    given = words.where((F.col("given") >= max(least, (sums[0] or 0) * min_share)) & (F.col("given") >= share * F.col("total")))
    others = words.where((F.col("total") >= max(common, (sums[1] or 0) * min_share)) & (50 * F.col("person") < F.col("total")))
    return Lexicon(*[frozenset(r[0] for r in some.select("word").collect()) for some in (given, others)])


def redact(text: str, find: Finder) -> tuple[str, list[tuple[str, str]]]:
    """The text with placeholders, and the (kind, value) found, each run of white space in a value made one space."""
    spans = find(text)
    if not spans:
        return text, []
    parts, values, at = [], [], 0
    for a, b, kind in spans:
        parts += [text[at:a], PLACEHOLDERS[kind]]
        values.append((kind, " ".join(text[a:b].split())))
        at = b
    return "".join([*parts, text[at:]]), values


def redact_texts(df: DataFrame, key: str, text: str, lexicon: Lexicon = Lexicon()) -> DataFrame:
    """(key, redacted, found): each text with typed placeholders, and the (kind, value) pairs in text order.

    Map-only. All characters outside the values stay as they were. Null stays null with an empty list; an empty text
    stays empty; very long texts are searched whole. Repeated rows are treated each for itself; other columns, and
    columns of the same names as the new ones, are left out.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = finder(lexicon)
        for pdf in batches:
            done = [redact(t, find) if isinstance(t, str) else (None, []) for t in pdf["_text"]]
            found = [[{"kind": k, "value": v} for k, v in f] for _, f in done]
            yield pd.DataFrame({key: pdf["_key"], "redacted": [r for r, _ in done], "found": found})

    # keys travel as text: pandas would make floats of numbers beside a null
    source = df.select(F.col(key).cast("string").alias("_key"), F.col(text).alias("_text"))
    return source.mapInPandas(run, f"`{key}` string, redacted string, found array<struct<kind:string,value:string>>").withColumn(key, F.col(key).cast(kind))


def find_values(df: DataFrame, key: str, text: str, lexicon: Lexicon = Lexicon()) -> DataFrame:
    """(row_key, kind, found_value): each distinct value of each row that holds one. Map-only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = finder(lexicon)
        for pdf in batches:
            rows = []
            for k, t in zip(pdf["row_key"], pdf["text"]):
                if isinstance(t, str):
                    rows += [(k, kind, v) for kind, v in dict.fromkeys((kind, " ".join(t[a:b].split())) for a, b, kind in find(t))]
            yield pd.DataFrame(rows, columns=["row_key", "kind", "found_value"])

    source = df.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("string").alias("row_key"), F.col(text).alias("text"))
    return source.mapInPandas(run, "row_key string, kind string, found_value string")


def redact_samples(ledger: DataFrame, lexicon: Lexicon = Lexicon()) -> DataFrame:
    """``ledger`` with priors whose samples are redacted; counts, kinds and the order of samples stay.

    Distinct samples are searched by every worker once for each batch. Null maps, null structs and null samples stay.
    """
    kind = "map<string,struct<count:int,redacted_samples:array<string>>>"

    @F.pandas_udf("array<struct<key:string,value:struct<count:int,redacted_samples:array<string>>>>")
    def run(entries: pd.Series) -> pd.Series:
        find, seen = finder(lexicon), {}

        def one(s):
            if s is None:
                return None
            if s not in seen:
                seen[s] = redact(s, find)[0]
            return seen[s]

        def row(items):
            if items is None:
                return None
            return [
                {"key": e["key"], "value": None if e["value"] is None else {"count": e["value"]["count"], "redacted_samples": None if e["value"]["redacted_samples"] is None else [one(s) for s in e["value"]["redacted_samples"]]}}
                for e in items
            ]

        return entries.map(row)

    return ledger.withColumn("priors", F.map_from_entries(run(F.map_entries("priors"))).cast(kind))
