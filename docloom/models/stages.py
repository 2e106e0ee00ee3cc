"""The model stages of a review: what each asks, what answers it takes, and rules that answer offline.

A prompt is one JSON object, so that a model gets every input by name and a rule can read it back. An answer is read as
JSON whatever surrounds it and brought into the stage's closed domain; one that can't be read is asked for once more, then counts as none.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from docloom.functions.coercion import layers, valid_folder, wanted_files
from docloom.functions.modelio import capped_terms, clamp, closed_terms, parse_model_json
from docloom.functions.terms import UNMAPPED, kebab
from docloom.models.step import ModelFn, run_model
from docloom.operators.fold import merge_groups

Rule = Callable[[dict], dict]
LEVELS = ("low", "medium", "high")


@dataclass(frozen=True)
class Stage:
    """A stage: its name, its instruction, the fields of an answer (name -> type), and the rule that answers without a model."""

    name: str
    instruction: str
    fields: dict[str, str]
    rule: Rule


def rule_model(stage: Stage) -> ModelFn:
    """The stage's rule as a model: prompts in, JSON out."""

    def answer(prompts: pd.Series) -> pd.Series:
        return prompts.map(lambda p: json.dumps(stage.rule(json.loads(p)), ensure_ascii=False))

    return answer


def prompt_of(stage: Stage, **inputs: Column) -> Column:
    return F.to_json(F.struct(F.lit(stage.name).alias("stage"), F.lit(stage.instruction).alias("task"), *[c.alias(k) for k, c in inputs.items()]), {"ignoreNullFields": "false"})


def ask(df: DataFrame, key: str, stage: Stage, model: ModelFn | None = None, **inputs: Column) -> DataFrame:
    """(key, readable, one column for each field): the stage's answers; unreadable ones are asked for a second time."""
    model = model or rule_model(stage)
    asked = df.select(key, prompt_of(stage, **inputs).alias("prompt"))
    found = lambda rows: run_model(rows, key, "prompt", model).withColumn("v", parse_model_json(F.col("answer")))
    good = lambda rows: rows.where("v IS NOT NULL AND try_variant_get(v, '$.error', 'string') IS NULL")
    first = found(asked)
    rest = asked.join(good(first).select(key), key, "left_anti")
    answers = good(first).select(key, "v")
    if not rest.isEmpty():
        answers = answers.unionByName(good(found(rest)).select(key, "v"))
    read = [F.try_variant_get("v", F.lit(f"$.{f}"), kind).alias(f) for f, kind in stage.fields.items()]
    return df.select(key).join(answers, key, "left").select(key, F.col("v").isNotNull().alias("readable"), *read)


_WORD = re.compile(r"[^\W\d_]{4,}")
#: Words of three languages that say little about a text (a parameter of the rules).
COMMON = frozenset("that this with from have been will were they their there which about after before please should would could your into over near when where what also some more than then them only goes keep next week copy".split())


def telling(text: str, most: int) -> list[str]:
    """The most frequent longer words of a text, ties by first place."""
    counts = Counter(w for w in _WORD.findall((text or "").lower()) if w not in COMMON)
    return [w for w, _ in counts.most_common(most)]


def _named(text: str, choices: list[str]) -> list[str]:
    """Choices whose words all stand in the text, most mentioned first."""
    low = f" {re.sub(r'[^a-z0-9]+', ' ', (text or '').lower())} "
    hits = [(min(low.count(f" {w} ") for w in c.split("-")), c) for c in choices if c]
    return [c for n, c in sorted(((n, c) for n, c in hits if n), key=lambda x: (-x[0], x[1]))]


def _first_pass(p: dict) -> dict:
    tags = telling(p.get("text", ""), 5)
    private = bool(re.search(r"\b(?:my|family|home|holiday|recipe)\b", p.get("text") or "", re.I))
    return {"tags": tags, "primary_tag": tags[0] if tags else "", "custody": "unclear" if not tags else "personal" if private else "work", "confidence": LEVELS[min(2, len(tags) // 2)], "summary": (p.get("text") or "")[:200]}


def _second_pass(p: dict) -> dict:
    return {"custody": p.get("custody") or "unclear", "recommendation": "keep" if p.get("custody") == "work" else "review", "confidence": p.get("confidence") or "low", "rationale": f"first pass: {p.get('primary_tag') or 'none'}"}


def _placement(p: dict) -> dict:
    out = {facet: _named(p.get("text", ""), terms)[:2] for facet, terms in (p.get("vocabulary") or {}).items()}
    hits = sum(bool(v) for v in out.values())
    return out | {"confidence": hits / max(1, len(out)), "rationale": "terms named in the text" if hits else ""}


def _rich(p: dict) -> dict:
    text = p.get("text") or ""
    names = re.findall(r"(?<=[a-z,;] )[A-ZÀ-Þ][\w'-]+(?: [A-ZÀ-Þ][\w'-]+)+", text)
    return {"tags": telling(text, 30), "entities": names, "audiences": [], "artifact_types": [], "years": re.findall(r"\b(?:19|20)\d\d\b", text), "summary": text[:2000], "confidence": min(1.0, len(text) / 2000), "needs_review": False}


def _stitch(p: dict) -> dict:
    heads: dict[str, list[str]] = {}
    for tag in p.get("tags") or []:
        head = re.split(r"[^a-z0-9]+", tag.lower().strip())[0]
        if head:
            heads.setdefault(head, []).append(tag)
    return {"regions": [{"id": h, "label": h.title(), "tags": tags, "children": []} for h, tags in sorted(heads.items()) if len(tags) > 1]}


def _clerk(p: dict) -> dict:
    hits = _named(p.get("text", ""), p.get("homes") or [])
    return {"home": hits[0] if hits else "", "reason": "named in the text" if hits else "nothing on the plan is named"}


def _layers(p: dict) -> dict:
    words = telling(p.get("text", ""), 3)
    hits = _named(p.get("text", ""), p.get("mains") or [])
    main = hits[0] if hits else (words[0] if words else "")
    rest = [w for w in words if w != main]
    return {"main": main, "sub": rest[0] if rest else "", "detail": rest[1] if len(rest) > 1 else "", "summary": (p.get("text") or "")[:200], "reasoning": "words of the text"}


def _combine(p: dict) -> dict:
    """Names with a common first word belong together, under that word."""
    heads: dict[str, list[str]] = {}
    for name in p.get("names") or []:
        heads.setdefault(name.split("-")[0], []).append(name)
    return {"groups": [{"merge": names, "into": head} for head, names in sorted(heads.items()) if len(names) > 1]}


def _walk(p: dict) -> dict:
    wanted, siblings = p.get("wanted") or "", p.get("siblings") or []
    if wanted in siblings:
        return {"action": "reuse", "name": wanted}
    near = [s for s in siblings if set(wanted.split("-")) & set(s.split("-"))] if wanted else []
    return {"action": "reuse", "name": near[0]} if near else {"action": "invent" if wanted else "empty", "name": wanted}


def _audit(p: dict) -> dict:
    region = set(re.split(r"[^a-z0-9]+", (p.get("region") or "").lower())) - {""}
    out = []
    for f in p.get("files") or []:
        words = set(re.split(r"[^a-z0-9]+", " ".join([f.get("rel_path") or "", *(f.get("tags") or [])]).lower()))
        better = next((h for h in p.get("homes") or [] if h != p.get("region") and set(h.split("-")) <= words), None)
        out.append({"rel_path": f.get("rel_path"), "verdict": "wrong-parent" if better and not region & words else "confirm", "better_home": better})
    return {"verdicts": out}


def _revise(p: dict) -> dict:
    n = len(p.get("members") or [])
    return {"action": "dissolve" if n < 2 else "keep", "label": p.get("label") or "", "parts": []}


_GROUPS = "array<struct<merge:array<string>,into:string>>"
STAGES = {
    s.name: s
    for s in (
        Stage("first-pass", "Tag this part of a document.", {"tags": "array<string>", "primary_tag": "string", "custody": "string", "confidence": "string", "summary": "string"}, _first_pass),
        Stage("second-pass", "Say whose the document is and what should become of it.", {"custody": "string", "recommendation": "string", "confidence": "string", "rationale": "string"}, _second_pass),
        Stage("placement", "Choose at most two terms of each facet.", {"program": "array<string>", "function": "array<string>", "confidence": "double", "rationale": "string"}, _placement),
        Stage("rich-tags", "Describe the document by tags.", {"tags": "array<string>", "entities": "array<string>", "audiences": "array<string>", "artifact_types": "array<string>", "years": "array<string>", "summary": "string", "confidence": "double", "needs_review": "boolean"}, _rich),
        Stage("stitch", "Arrange these tags as a tree of regions.", {"regions": "variant"}, _stitch),
        Stage("clerk", "File the document in one of these homes.", {"home": "string", "reason": "string"}, _clerk),
        Stage("layers", "Name a main, sub and detail folder.", {"main": "string", "sub": "string", "detail": "string", "summary": "string", "reasoning": "string"}, _layers),
        Stage("roll-up", "Combine main folders that are one subject.", {"groups": _GROUPS}, _combine),
        Stage("walk", "Choose the next folder for the document.", {"action": "string", "name": "string"}, _walk),
        Stage("maintain", "Combine child folders that are one subject.", {"groups": _GROUPS}, _combine),
        Stage("census", "Combine the names of this level that are one subject.", {"groups": _GROUPS, "need_files": "array<string>"}, _combine),
        Stage("spike", "Name the drawers for the document, from those there are or new ones.", {"main": "string", "sub": "string", "detail": "string"}, _layers),
        Stage("audit", "Say of each file whether it belongs in the region.", {"verdicts": "array<struct<rel_path:string,verdict:string,better_home:string>>"}, _audit),
        Stage("revise", "Keep, rename, split or dissolve the region.", {"action": "string", "label": "string", "parts": "array<string>"}, _revise),
    )
}


def _one_of(value: Column, allowed: tuple[str, ...], otherwise: str) -> Column:
    low = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(low.isin(*allowed), low).otherwise(otherwise)


def first_pass(chunks: DataFrame, key: str, model: ModelFn | None = None) -> DataFrame:
    """(key, readable, tags, primary_tag, custody, confidence, summary) of chunks (key, rel_path, hints, text)."""
    a = ask(chunks, key, STAGES["first-pass"], model, path=F.col("rel_path"), hints=F.col("hints"), text=F.col("text"))
    tags = capped_terms(F.transform("tags", kebab), 12)
    return a.select(key, "readable", tags.alias("tags"), kebab("primary_tag").alias("primary_tag"), _one_of(F.col("custody"), ("work", "personal"), "unclear").alias("custody"), _one_of(F.col("confidence"), LEVELS, "low").alias("confidence"), F.left(F.coalesce("summary", F.lit("")), F.lit(800)).alias("summary"))


def merge_first_pass(answers: DataFrame, key: str, order: str) -> DataFrame:
    """One first pass for each document from those of its chunks: all tags in order, the strongest custody, the lowest confidence, the first primary tag."""
    parts = answers.where("readable").groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "tags", "primary_tag", "custody", "confidence", "summary"))).alias("p"))
    any_is = lambda c: F.exists("p", lambda x: x["custody"] == c)
    lowest = F.array_min(F.transform("p", lambda x: F.array_position(F.array(*map(F.lit, LEVELS)), x["confidence"])))
    tags = F.array_distinct(F.flatten(F.transform("p", lambda x: x["tags"])))
    return parts.select(
        key,
        F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit("unknown"))).alias("tags"),
        F.element_at("p", 1)["primary_tag"].alias("primary_tag"),
        F.when(any_is("personal"), "personal").when(any_is("work"), "work").otherwise("unclear").alias("custody"),
        F.element_at(F.array(*map(F.lit, LEVELS)), lowest.cast("int")).alias("confidence"),
        F.left(F.array_join(F.transform("p", lambda x: x["summary"]), " "), F.lit(800)).alias("summary"),
        F.size("p").cast("long").alias("chunk_count"),
    )


def second_pass(docs: DataFrame, key: str, model: ModelFn | None = None, shown: int = 10_000) -> DataFrame:
    """(key, readable, custody, recommendation, confidence, rationale) of documents (key, primary_tag, custody, confidence, kinds, text)."""
    a = ask(docs, key, STAGES["second-pass"], model, **{c: F.col(c) for c in ("primary_tag", "custody", "confidence", "kinds")}, text=F.left("text", F.lit(shown)))
    return a.select(key, "readable", _one_of(F.col("custody"), ("work", "personal"), "unclear").alias("custody"), _one_of(F.col("recommendation"), ("keep", "delete_candidate"), "review").alias("recommendation"), _one_of(F.col("confidence"), LEVELS, "low").alias("confidence"), F.coalesce("rationale", F.lit("")).alias("rationale"))


def placements(docs: DataFrame, key: str, facets: dict[str, list[str]], model: ModelFn | None = None, shown: int = 10_000) -> DataFrame:
    """(key, one array for each facet, confidence, needs_review): terms of a closed vocabulary, unmapped where none fits."""
    stage = STAGES["placement"]
    stage = Stage(stage.name, stage.instruction, {**{f: "array<string>" for f in facets}, "confidence": "double", "rationale": "string"}, stage.rule)
    vocabulary = F.struct(*[F.array(*map(F.lit, terms)).alias(f) for f, terms in facets.items()])
    a = ask(docs, key, stage, model, vocabulary=vocabulary, text=F.left("text", F.lit(shown)))
    named = {f: closed_terms(F.coalesce(F.col(f), F.array().cast("array<string>")), F.array(*map(F.lit, terms))) for f, terms in facets.items()}
    sure = clamp(F.nanvl("confidence", F.lit(None).cast("double")))
    lost = [F.element_at(named[f], 1) == UNMAPPED for f in list(facets)[:2]]
    review = (sure < 0.45) | (F.trim(F.coalesce("rationale", F.lit(""))) == "")
    for x in lost:
        review = review | x
    return a.select(key, *[c.alias(f) for f, c in named.items()], sure.alias("confidence"), review.alias("needs_review"))


def rich_tags(docs: DataFrame, key: str, model: ModelFn | None = None, shown: int = 12_000) -> DataFrame:
    """(key, tags, entities, audiences, artifact_types, years, summary, confidence, needs_review), each list within its cap."""
    a = ask(docs, key, STAGES["rich-tags"], model, text=F.left("text", F.lit(shown)))
    caps = {"tags": 30, "entities": 20, "audiences": 12, "artifact_types": 12, "years": 8}
    lists = {c: capped_terms(F.col(c), n) for c, n in caps.items()}
    sure, summary = clamp(F.nanvl("confidence", F.lit(None).cast("double"))), F.left(F.coalesce("summary", F.lit("")), F.lit(2000))
    review = F.coalesce("needs_review", F.lit(False)) | (sure < 0.4) | (F.size(lists["tags"]) < 6) | (F.trim(summary) == "")
    return a.select(key, *[c.alias(f) for f, c in lists.items()], summary.alias("summary"), sure.alias("confidence"), review.alias("needs_review"))


def stitched(inventory: DataFrame, model: ModelFn | None = None, most: int = 180) -> DataFrame:
    """(tree) one JSON tree for each region the model makes of the ``most`` frequent tags (tag, docs) of two documents or more; read it by ``flatten_trees``."""
    top = inventory.where("docs > 1").orderBy(F.desc("docs"), "tag").limit(most)  # the prompt's size is the feature
    one = top.agg(F.array_sort(F.collect_list("tag")).alias("tags")).select(F.lit("stitch").alias("id"), "tags")
    a = ask(one, "id", STAGES["stitch"], model, tags=F.col("tags"))
    return a.select(F.explode(F.try_variant_get("regions", F.lit("$"), "array<variant>")).alias("r")).select(F.to_json("r").alias("tree"))


def clerk_homes(docs: DataFrame, key: str, homes: list[tuple[str, str]], model: ModelFn | None = None, shown: int = 80_000) -> DataFrame:
    """(key, home): an id of ``homes`` (id, label), by its id, else by its label, else unmapped."""
    a = ask(docs, key, STAGES["clerk"], model, homes=F.array(*[F.lit(h) for h, _ in homes]), text=F.left("text", F.lit(shown)))
    ids = F.array(*[F.lit(h) for h, _ in homes])
    labels = F.create_map(*[F.lit(x) for h, label in homes for x in (label.lower(), h)])
    slug = kebab("home")
    home = F.when(F.array_contains(ids, slug), slug).otherwise(F.coalesce(F.try_element_at(labels, F.lower(F.trim(F.coalesce("home", F.lit(""))))), F.lit(UNMAPPED)))
    return a.select(key, home.alias("home"))


def layer_names(docs: DataFrame, key: str, mains: list[str], model: ModelFn | None = None, stage: str = "layers", shown: int = 80_000) -> DataFrame:
    """(key, path, summary): up to three folder names of each document; none where the main may not stand."""
    a = ask(docs, key, STAGES[stage], model, mains=F.array(*map(F.lit, mains)).cast("array<string>"), text=F.left("text", F.lit(shown)))
    ok = valid_folder(F.col("main"), []) | kebab("main").isin(*mains)
    path = F.when(ok, layers(F.col("main"), F.col("sub"), F.col("detail"))).otherwise(F.array().cast("array<string>"))
    return a.select(key, path.alias("path"), *([F.coalesce("summary", F.lit("")).alias("summary")] if stage == "layers" else []))


GROUPS = ArrayType(StructType([StructField("merge", ArrayType(StringType())), StructField("into", StringType())]))


def combined(levels: DataFrame, key: str, stage: str, model: ModelFn | None = None, leave_one: bool = True) -> DataFrame:
    """(key, name, into): names of each level (key, names, counts) that go into another, made safe in the order of the groups.

    Works for main folders (roll-up), children of a folder (maintain), and a census of mains or subs. A group's target must be a
    valid folder name; names are claimed once, and with ``leave_one`` some name of the level stays as it is.
    """
    a = ask(levels, key, STAGES[stage], model, names=F.col("names"), counts=F.col("counts"))

    @F.pandas_udf(GROUPS)
    def safe(groups: pd.Series, names: pd.Series) -> pd.Series:
        def one(found, listed):
            asked = [([*(g["merge"] if g["merge"] is not None else [])], g["into"] or "") for g in (found if found is not None else [])]
            return [{"merge": m, "into": i} for m, i in merge_groups(asked, [*listed], leave_one)]

        return pd.Series([one(g, n) for g, n in zip(groups, names)])

    rows = a.join(levels.select(key, "names"), key).select(key, F.explode(safe("groups", "names")).alias("g"))
    rows = rows.where(valid_folder(F.col("g.into"), []))
    return rows.select(key, F.explode("g.merge").alias("name"), kebab("g.into").alias("into")).where("name <> into")


def wanted(levels: DataFrame, key: str, listed: str, model: ModelFn | None = None) -> DataFrame:
    """(key, files): the files a census asks to see, of those ``listed``."""
    a = ask(levels, key, STAGES["census"], model, names=F.col("names"), counts=F.col("counts"), files=F.col(listed))
    return a.join(levels.select(key, listed), key).select(key, wanted_files(F.coalesce("need_files", F.array().cast("array<string>")), F.col(listed)).alias("files"))


def chunk_verdicts(chunks: DataFrame, homes: list[str], model: ModelFn | None = None) -> DataFrame:
    """(chunk_id, rel_path, verdict, better_home) as the model gives them for chunks (chunk_id, region, files of rel_path and tags); see ``whole_verdicts``."""
    a = ask(chunks, "chunk_id", STAGES["audit"], model, region=F.col("region"), files=F.col("files"), homes=F.array(*map(F.lit, homes)).cast("array<string>"))
    return a.select("chunk_id", F.explode("verdicts").alias("v")).select("chunk_id", "v.rel_path", "v.verdict", "v.better_home")


def revisions(groups: DataFrame, key: str, model: ModelFn | None = None, shown: int = 40) -> DataFrame:
    """(key, action, label, parts) for groups (key, label, members): keep, rename, split or dissolve, else keep."""
    a = ask(groups, key, STAGES["revise"], model, label=F.col("label"), members=F.slice("members", 1, shown))
    return a.select(key, _one_of(F.col("action"), ("rename", "split", "dissolve"), "keep").alias("action"), F.coalesce("label", F.lit("")).alias("label"), capped_terms(F.transform("parts", kebab), 12).alias("parts"))
