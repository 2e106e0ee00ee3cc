"""Problem 5: mapping free-entered values to a canonical list."""

from __future__ import annotations

import re
import unicodedata
from collections import OrderedDict

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.terms import form_k

#: Words that say nothing about the entry meant: left out before the similarity is taken.
FILLERS = frozenset("copy of my the a and co misc folder final old new temp north south east west annex z re x stuff draft version vol".split())
_LEET = str.maketrans("0134578@$", "oieastbas")
_LEET_L = str.maketrans("0134578@$", "oleastbas")
_VOWELS = re.compile("[aeiou]")
_ORDINAL = re.compile(r"\d+(?:st|nd|rd|th)")


def _plain(value: str) -> str:
    """Lower case without accents, digits inside words read as the letters they stand for, other characters one space."""
    text = "".join(c for c in unicodedata.normalize("NFKD", value.lower()) if not unicodedata.combining(c)).replace("ß", "ss")
    return " ".join(re.sub(r"[^a-z0-9&]+", " ", text).split())


def _unleet(text: str, table: dict) -> str:
    return " ".join(t.translate(table) if re.search("[a-z]", t) and not re.fullmatch(r"\d+(?:st|nd|rd|th)", t) else t for t in text.split())


class _Name:
    """A form of an entry, prepared for bit-parallel edit distances."""

    def __init__(self, text: str):
        self.text, self.size, self.tokens = text, len(text), ()
        self.masks: dict[str, int] = {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def distance(self, other: str) -> int:
        """Edit distance with swaps of neighbours, one column of the table at a time as bits of an integer."""
        if not self.size:
            return len(other)
        every, top, get = (1 << self.size) - 1, 1 << self.size - 1, self.masks.get
        plus, minus, zero, before, score = every, 0, 0, 0, self.size
        for c in other:
            here = get(c, 0)
            swap = (~zero & here) << 1 & before
            zero = (((here & plus) + plus ^ plus) | here | minus | swap) & every
            up, down = minus | ~(zero | plus) & every, zero & plus
            score += 1 if up & top else -1 if down & top else 0
            up, down = up << 1 & every | 1, down << 1 & every
            plus, minus, before = (down | ~(zero | up)) & every, up & zero, here
        return score

    def close(self, other: str) -> float:
        """1 - distance / longer length, 0 where more than 0.4 of the longer one differs."""
        longer = max(self.size, len(other))
        if abs(self.size - len(other)) > 0.4 * longer:
            return 0.0
        d = self.distance(other)
        return 1 - d / longer if d <= max(1, int(0.4 * longer)) else 0.0


def _grams(text: str) -> set[str]:
    padded = f"^{text}$"
    return {padded[i : i + 2] for i in range(len(padded) - 1)}


class CanonicalMatcher:
    """Maps a value to the id of the entry meant, or 0.

    An automaton over all names, titles and aliases finds embedded mentions on word boundaries; the longest
    non-overlapping mentions win, and the entry of the mentions that cover most of the value is taken. Values
    without a mention go to a token-set similarity whose tokens are compared by edit distance; shortened prefixes
    and consonant skeletons are looked up before. Only names that share letter pairs with the value are compared, in
    the order of the best score these pairs allow, until no other can reach the second place.

    ``aliases`` has (entry id, alias); an alias that two entries claim, or that is an entry's own form, is left out.
    """

    def __init__(self, entries: list[tuple[int, str, str]], aliases: list[tuple[int, str]] = (), least: float = 0.62, remembered: int = 200_000, fillers: frozenset[str] = FILLERS):
        self.least, self.remembered = least, remembered
        self.cache: OrderedDict[str, int] = OrderedDict()
        self.exact: dict[str, int] = {}
        self.names: dict[str, int] = {}
        for plan_id, name, title in entries:
            for form in (name, title):
                self.exact.setdefault(_plain(form), plan_id)
            self.names.setdefault(_plain(name), plan_id)
        self.fillers = fillers - {w for k in self.exact for w in k.split()}
        self.joined = {k.replace(" ", ""): v for k, v in self.names.items()}
        self.skeletons: dict[str, int] = {}
        for k, v in self.names.items():
            s = self._skeleton(k)
            self.skeletons[s] = 0 if s in self.skeletons and self.skeletons[s] != v else v
        self.forms = [_Name(k.replace(" ", "")) for k in self.names]
        self.tokens = [tuple(_Name(t) for t in k.split()) for k in self.names]
        self.ids = list(self.names.values())
        self.postings: dict[str, list[int]] = {}
        for i, f in enumerate(self.forms):
            for g in _grams(f.text):
                self.postings.setdefault(g, []).append(i)
        claimed: dict[str, int] = {}
        for plan_id, alias in aliases:
            if (form := _plain(alias)) and form not in self.exact:
                claimed[form] = 0 if claimed.get(form, plan_id) != plan_id else plan_id
        # a slip of an entry's own name needs no alias
        own = {f: self.resolve(f, False) for f in claimed}
        self.exact.update({f: v for f, v in claimed.items() if v and own[f] != v})
        self.sets = {frozenset(k.split()): v for k, v in self.exact.items()}
        self.automaton = self._build()

    automaton = None
    sets: dict = {}

    def _build(self) -> ahocorasick.Automaton | None:
        out = ahocorasick.Automaton()
        for k, v in self.exact.items():
            if k:
                out.add_word(k, (len(k), v))
        if not len(out):
            return None
        out.make_automaton()
        return out

    @staticmethod
    def _skeleton(text: str) -> str:
        return " ".join(w[:1] + _VOWELS.sub("", w[1:]) if w[:1] not in "aeiou" else _VOWELS.sub("", w) for w in text.split())

    def mention(self, text: str) -> int:
        found = []
        for end, (n, plan_id) in self.automaton.iter(text) if self.automaton else ():
            a, b = end - n + 1, end + 1
            if (a == 0 or text[a - 1] == " ") and (b == len(text) or text[b] == " "):
                found.append((-n, a, b, plan_id))
        taken: list[tuple[int, int, int]] = []
        for n, a, b, plan_id in sorted(found):
            if all(b <= x or a >= y for x, y, _ in taken):
                taken.append((a, b, plan_id))
        if not taken:
            return 0
        # a short mention inside a text of other words is no answer
        rest = self._words(text[: taken[0][0]] + " " + text[taken[0][1] :])
        covered = {p for _, _, p in taken}
        if len(covered) == 1 and (not rest or taken[0][1] - taken[0][0] >= len(" ".join(rest))):
            return taken[0][2]
        return taken[0][2] if len(covered) > 1 and taken[0][1] - taken[0][0] >= 5 else 0

    def _words(self, text: str) -> list[str]:
        return [w for w in text.split() if w not in self.fillers and not w.isdigit() and not _ORDINAL.fullmatch(w)]

    def similar(self, text: str, dotted: bool) -> int:
        words = self._words(text)
        if not words:
            return 0
        core = " ".join(words)
        flat = core.replace(" ", "")
        if (hit := self.exact.get(core)) or (hit := self.sets.get(frozenset(words))) or (hit := self.joined.get(flat)):
            return hit
        if dotted and len(core) >= 4:
            starts = {v for k, v in self.names.items() if k.startswith(core)}
            if len(starts) == 1:
                return starts.pop()
        if len(flat) >= 3 and not _VOWELS.search(flat[1:]):
            if hit := self.skeletons.get(self._skeleton(core)):
                return hit
        shared: dict[int, int] = {}
        for g in {g for w in words for g in _grams(w)} | _grams(flat):
            for i in self.postings.get(g, ()):
                shared[i] = shared.get(i, 0) + 1
        # an edit touches at most three letter pairs, so the pairs that are missing bound the score from above;
        # words in another order lose pairs at their borders only
        many = len(words) > 1
        ranked = sorted(((self._most(self.forms[i], len(flat), n) if not many or len(self.tokens[i]) < 2 else 1.0, n, i) for i, n in shared.items()), reverse=True)
        best, second, answer = 0.0, 0.0, 0
        for most, _, i in ranked:
            if most < self.least or most <= second:
                break
            score = self.forms[i].close(flat)
            if many:
                score = max(score, self._tokens(words, self.tokens[i]))
            if score > best:
                if self.ids[i] != answer:
                    second = best
                best, answer = score, self.ids[i]
            elif score > second and self.ids[i] != answer:
                second = score
        return answer if best >= self.least and best > second else 0

    @staticmethod
    def _most(form: _Name, size: int, shared: int) -> float:
        longer = max(form.size, size)
        return 1 - max(abs(form.size - size), -(-(longer + 1 - shared - _repeats(form.text)) // 3)) / longer

    @staticmethod
    def _tokens(words: list[str], name: tuple[_Name, ...]) -> float:
        """Soft token-set similarity: the share of the letters of both sets that stand in tokens close to one of the other set."""
        free, total = list(words), 0.0
        for t in name:
            scored = [(t.close(w), w) for w in free]
            s, w = max(scored, default=(0.0, ""))
            if s >= 0.5:
                free.remove(w)
                total += s * (t.size + len(w))
        return total / (sum(t.size for t in name) + sum(map(len, words)))

    def resolve(self, text: str, dotted: bool) -> int:
        return self.exact.get(text, 0) or self.mention(text) or self.similar(text, dotted)

    def __call__(self, value: str) -> int:
        if value in self.cache:
            return self.cache[value]
        text = _plain(value)
        dotted = value.rstrip().endswith(".")
        hit = self.resolve(text, dotted)
        for table in () if hit else (_LEET, _LEET_L):
            other = _unleet(text, table)
            if not hit and other != text:
                hit = self.resolve(other, dotted)
        if len(self.cache) >= self.remembered:
            self.cache.popitem(last=False)
        self.cache[value] = hit
        return hit


def _repeats(text: str) -> int:
    """Letter pairs of a form beyond their first occurrence: a set of pairs shows them once."""
    return len(text) + 1 - len(_grams(text))


def learn_aliases(paths: DataFrame, plan: DataFrame, home: str = "home", main: str = "main", least: int = 3, min_share: float = 0.001, purity: float = 0.8) -> DataFrame:
    """(plan_id, alias): values that other words of the same rows show to mean an entry.

    A row of ``paths`` has a path ``home`` (broad to narrow) and a label ``main`` for its first step. Where the value
    after it in the path is exactly an entry, a value speaks for that entry's parent; a first step whose label is
    exactly an entry, and a label whose first step or second step's parent is one, speak for that entry. A value
    becomes an alias of the entry that at least ``purity`` of its votes name if it has ``least`` votes, at least half
    of its occurrences vote (or, counting only values with another one after them, half of these do), and its votes are
    ``min_share`` of all votes for that entry. So the number of aliases is at most entries / min_share, whatever the
    size of ``paths``. A word for an entry without children that only stands at the end of paths is not learned.

    Votes are counted in the JVM over all rows and added up before they are shuffled; nulls and blanks don't vote.
    """
    named = plan.where(F.col("plan_name").isNotNull()).select("plan_id", "parent_id", form_k(F.col("plan_name")).alias("k")).dropDuplicates(["k"])
    steps = F.coalesce(F.col(home), F.array().cast("array<string>"))
    each = F.transform(
        steps,
        lambda v, i: F.struct(v.alias("v"), form_k(F.get(steps, i + 1)).alias("below"), F.when(i == 0, form_k(F.col(main))).alias("same")),
    )
    label = F.array(F.struct(F.col(main).alias("v"), form_k(F.get(steps, F.lit(1))).alias("below"), form_k(F.get(steps, F.lit(0))).alias("same")))
    votes = paths.select(F.explode(F.concat(each, label)).alias("x")).select(F.lower(F.trim(F.regexp_replace("x.v", r"\s+", " "))).alias("alias"), "x.below", "x.same")
    votes = votes.where("alias <> ''").groupBy("alias", "below", "same").agg(F.count(F.lit(1)).alias("n"))
    votes = votes.join(named.select(F.col("k").alias("below"), F.col("parent_id").alias("p")), "below", "left")
    votes = votes.join(named.select(F.col("k").alias("same"), F.col("plan_id").alias("s"), F.col("parent_id").alias("sp")), "same", "left")
    # the label of a first step names a broadest entry; the child speaks louder than the label
    votes = votes.select("alias", "n", "p", F.coalesce("p", F.when(F.col("sp").isNull(), F.col("s"))).alias("plan_id"), F.col("below").isNotNull().alias("has_below"))
    per = votes.groupBy("alias", "plan_id").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("p").isNotNull(), F.col("n")).otherwise(0)).alias("c"), F.sum(F.when(F.col("has_below"), F.col("n")).otherwise(0)).alias("b"))
    known = F.col("plan_id").isNotNull()
    by = per.groupBy("alias").agg(
        F.sum("n").alias("all"),
        F.sum("b").alias("all_below"),
        F.sum(F.when(known, F.col("n"))).alias("voted"),
        F.max(F.when(known, F.struct("n", "plan_id"))).alias("best"),
        F.sum("c").alias("voted_below"),
        F.max(F.when(known, F.struct(F.col("c").alias("n"), F.col("plan_id")))).alias("best_below"),
    )
    sizes = per.where(known).groupBy("plan_id").agg(F.sum("n").alias("total"))
    sure = lambda best, voted, every: (F.col(f"{best}.n") >= least) & (F.col(f"{best}.n") >= purity * F.col(voted)) & (2 * F.col(voted) >= F.col(every))
    best = F.when(sure("best", "voted", "all"), F.col("best")).when(sure("best_below", "voted_below", "all_below") & (2 * F.col("best_below.n") >= F.col("voted")), F.col("best_below"))
    good = by.select("alias", best.alias("best")).where("best IS NOT NULL").select(F.col("best.plan_id").alias("plan_id"), "alias", F.col("best.n").alias("n")).join(sizes, "plan_id")
    return good.where(F.col("n") >= min_share * F.col("total")).select("plan_id", "alias")


def map_to_canonical(values: DataFrame, column: str, plan: DataFrame, aliases: DataFrame | None = None, into: str = "plan_id") -> DataFrame:
    """Add ``into``: the id of the plan entry that each value of ``column`` means, 0 where it means none.

    ``plan`` (plan_id, plan_name, title) is the fixed reference list and ``aliases`` (plan_id, alias) other words for
    its entries, a table of one's own or what ``learn_aliases`` finds; their automaton is built once in each worker,
    so both are bounded by what one worker holds. The mapping is map-only: a value typed in a third of all
    rows costs no shuffle, and each worker remembers the values it has seen. Null and blank values map to null; a
    value that is some entry's exact name maps to that entry. Ties of two entries count as unmatched.
    """
    entries = [(int(r[0]), r[1], r[2] or r[1]) for r in plan.where("plan_id IS NOT NULL AND plan_name IS NOT NULL").select("plan_id", "plan_name", "title").collect()]
    known = sorted((int(r[0]), r[1]) for r in aliases.select("plan_id", "alias").collect()) if aliases is not None else []
    held: list[CanonicalMatcher] = []

    @F.pandas_udf("int")
    def match(s: pd.Series) -> pd.Series:
        if not held:
            held.append(CanonicalMatcher(entries, known))
        codes, distinct = pd.factorize(s)
        ids = [held[0](v) if v.strip() else None for v in distinct]
        return pd.Series([ids[c] if c >= 0 else None for c in codes], dtype="Int32")

    return values.withColumn(into, match(F.col(column)))
