"""Values proposed for folders, brought into a closed domain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.terms import UNMAPPED, is_banned_head, is_vague, kebab
from docloom.functions.textops import strip_all

# Phrases of an answer or text that say the text has nothing to file, and how short is nothing.
EMPTY_PHRASES = ("no content", "no text", "empty document", "cannot determine", "blank page", "unreadable")
SHORTEST = 40


def closed_main(raw: Column, allowed: list[str], aliases: dict[str, str] | None = None) -> Column:
    """The kebab form if it is allowed, else its alias, else ''; banned heads are ''."""
    slug = kebab(raw)
    named = F.create_map(*[F.lit(x) for p in {**{a: a for a in allowed}, **{k: v for k, v in (aliases or {}).items() if v in allowed}}.items() for x in p])
    return F.when((slug == "") | (slug == UNMAPPED) | is_banned_head(slug), "").otherwise(F.coalesce(F.try_element_at(named, slug), F.lit("")))


def layers(main: Column, sub: Column, detail: Column) -> Column:
    """Up to three folder names: a banned sub takes the detail with it, a banned detail goes alone, repeats collapse; empty without a main."""
    s, d = kebab(sub), kebab(detail)
    s_ok = (s == "") | ~is_banned_head(s)
    parts = F.array(kebab(main), F.when(s_ok, s).otherwise(""), F.when(s_ok & ~is_banned_head(d), d).otherwise(""))
    some = F.filter(parts, lambda x: x != "")
    kept = F.filter(some, lambda x, i: (i == 0) | (x != F.try_element_at(some, F.greatest(i, F.lit(1)))))
    return F.when(kebab(main) == "", F.array().cast("array<string>")).otherwise(kept)


def valid_folder(name: Column, taken: list[str]) -> Column:
    """A folder name that may be invented: not empty, not one of ``taken``, no channel, year or vague word."""
    slug = kebab(name)
    return (slug != "") & ~slug.isin(*taken, UNMAPPED) & ~is_banned_head(slug) & ~is_vague(slug)


def looks_empty(text: Column, reason: Column | None = None, phrases: tuple[str, ...] = EMPTY_PHRASES, shortest: int = SHORTEST) -> Column:
    """Too short once white space is collapsed, or text or reason holds a phrase that says so."""
    body = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    blob = F.lower(F.concat_ws(" ", reason, body) if reason is not None else body)
    said = F.lit(False)
    for p in phrases:
        said = said | blob.contains(p)
    return (F.char_length(body) < shortest) | said


def main_choice(main: Column, reason: Column, text: Column, allowed: list[str]) -> Column:
    """A proposed main folder as (main, reason), made safe.

    Without a text there is none ('extract missing'). 'unmapped' stands only where the text looks empty; there, and for what is
    no allowed main, an empty main asks for another try.
    """
    slug, blank = kebab(main), strip_all(F.coalesce(text, F.lit(""))) == ""
    out = lambda m, r: F.struct(m.alias("main"), r.alias("reason"))
    said = F.coalesce(reason, F.lit(""))
    none = F.lit("")
    return (
        F.when(blank, out(none, F.lit("extract missing")))
        .when((slug == UNMAPPED) & looks_empty(text, said), out(F.lit(UNMAPPED), said))
        .when(slug.isin(*allowed), out(slug, said))
        .otherwise(out(none, none))
    )


def child_choice(action: Column, name: Column, merge: Column, siblings: Column, taken: list[str]) -> Column:
    """A proposed step under a folder as (action, name, merge), made safe.

    combine needs two existing siblings and a valid name; reuse of what is no sibling becomes an invention where the
    name is valid; all else is empty.
    """
    slug = kebab(name)
    known = F.array_intersect(F.coalesce(merge, F.array().cast("array<string>")), siblings)
    out = lambda a, n, m: F.struct(F.lit(a).alias("action"), n.alias("name"), m.alias("merge"))
    none = F.array().cast("array<string>")
    free = valid_folder(slug, taken)
    act = F.lower(F.coalesce(action, F.lit("")))
    return (
        F.when((act == "combine") & (F.size(known) >= 2) & free, out("combine", slug, known))
        .when(act.isin("reuse", "invent", "") & F.array_contains(siblings, slug), out("reuse", slug, none))
        .when(act.isin("reuse", "invent", "") & free, out("invent", slug, none))
        .otherwise(out("empty", F.lit(""), none))
    )


def wanted_files(asked: Column, listed: Column, most: int = 8) -> Column:
    """Distinct listed files among those asked for, without leading dots and slashes, at most ``most``."""
    return F.slice(F.array_intersect(F.transform(asked, lambda p: F.regexp_replace(p, r"^[./]+", "")), listed), 1, most)


def short_label(term: Column, most: int = 26) -> Column:
    """A label for a narrow place: dates and years off, words capitalised, cut at a word."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.translate(term, "-_", "  "), r"\b(?:19|20)\d\d\b", " "), r"\s+", " "))
    title = F.initcap(bare)
    cut = F.regexp_extract(title, rf"^(.{{1,{most}}})(?:\s|$)", 1)
    return F.when(F.char_length(title) <= most, title).otherwise(F.when(cut != "", cut).otherwise(F.left(title, F.lit(most))))


#: Beginnings of names that say nothing in a ring of a chart (a parameter).
RING_PREFIXES = ("copy of", "draft of", "re:", "fw:", "fwd:", "scan of", "the", "a", "an", "my")


def ring_label(term: Column, most: int = 26, prefixes: tuple[str, ...] = RING_PREFIXES) -> Column:
    """A label for a ring: empty beginnings off however many there are, then as ``short_label``, words in capitals kept."""
    start = "|".join(p.replace(" ", r"\s+") for p in prefixes)
    bare = F.regexp_replace(F.trim(F.translate(term, "-_", "  ")), rf"^(?i:(?:(?:{start})(?:\s+|$))+)", "")
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(bare, r"\b(?:19|20)\d\d(?:\s+\d{1,2}){0,2}\b", " "), r"\s+", " ")), " ")
    shown = F.array_join(F.transform(words, lambda w: F.when(w.rlike(r"^[A-Z]{2,5}$"), w).otherwise(F.initcap(w))), " ")
    cut = F.regexp_extract(shown, rf"^(.{{1,{most}}})(?:\s|$)", 1)
    return F.when(F.char_length(shown) <= most, shown).otherwise(F.when(cut != "", cut).otherwise(F.left(shown, F.lit(most))))


def short_count(n: Column) -> Column:
    """A count as 950, 1.2k, 3.4M."""
    return F.when(n < 1000, n.cast("long").cast("string")).when(n < 1_000_000, F.format_string("%.1fk", n / 1000)).otherwise(F.format_string("%.1fM", n / 1_000_000))


def bar(done: Column, whole: Column, width: int = 20) -> Column:
    """Progress as a row of marks."""
    full = F.least(F.lit(width), F.greatest(F.lit(0), F.floor(done * width / F.greatest(whole, F.lit(1))))).cast("int")
    return F.concat(F.repeat(F.lit("#"), full), F.repeat(F.lit("-"), width - full))


def age(seconds: Column) -> Column:
    """How long ago: 5s, 3m, 2h, 4d."""
    s = F.greatest(seconds.cast("long"), F.lit(0))
    unit = lambda n, u: F.concat(F.floor(s / n).cast("string"), F.lit(u))
    return F.when(s < 60, unit(1, "s")).when(s < 3600, unit(60, "m")).when(s < 86400, unit(3600, "h")).otherwise(unit(86400, "d"))


def clock(seconds: Column) -> Column:
    """Seconds as 1h02m03s, 2m03s or 3s."""
    s = F.greatest(seconds.cast("long"), F.lit(0))
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.when(h > 0, F.format_string("%dh%02dm%02ds", h, m, s % 60)).when(m > 0, F.format_string("%dm%02ds", m, s % 60)).otherwise(F.format_string("%ds", s))
