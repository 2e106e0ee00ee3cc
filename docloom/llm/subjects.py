"""Problem 6: subject areas of each text, by one-versus-rest linear classifiers on hashed word n-grams."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.terms import form_k
from docloom.operators.versions import current_rows
from docloom.session import cut

BITS = 17
_R = 0x9E3779B97F4A7C15
_K = np.uint64(0xC2B2AE3D27D4EB4F)
_POW: list[np.ndarray] = []
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[97:123] = True
_WORD[128:] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".!?;"]] = True
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0, 9, 10, 11, 12, 13, 32, 46]] = True

#: A few of the most common words of each language (a parameter): words are compared within a language, so that a
#: subject that happens to have more texts in one language doesn't take that language for its own.
LANGUAGES = (
    "the and of to in for is was that with on by at be has had been this",
    "der die das und ist nicht ein eine den dem mit von wurde bleibt vor nach",
    "le la les des du et est une dans pour que sans sur avant après depuis il été au aux",
    "el la los las del al es una para que con sin por tras desde antes hay se está su",
)


def languages(feats: np.ndarray, first: np.ndarray, doc: np.ndarray, docs: int, lists: tuple[str, ...] = LANGUAGES) -> np.ndarray:
    """Number of the language of each document by its common words; 0 where none is seen."""
    sent = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(feats))))
    seen = np.stack([np.bincount(doc[sent], weights=np.isin(feats[:, 0], features([text], 1)[0][:, 0]), minlength=docs) for text in lists], axis=1)
    return seen.argmax(axis=1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POW or len(_POW[0]) < n:
        size = max(1 << 20, 1 << (n - 1).bit_length())
        _POW.clear()
        for base in (_R, pow(_R, -1, 1 << 64)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POW.append(np.multiply.accumulate(steps))
    return _POW[0][:n], _POW[1][:n]


def features(texts: list[str], least_words: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed words and word pairs of all sentences of ``texts``.

    Returns the buckets (n, 2: word and the pair with the word before it, or -1), where each sentence starts in them,
    and the text of each sentence. Sentences end at a full stop, mark or semicolon before white space, at a bar, at an
    empty line and before a list item; those of fewer than ``least_words`` words (headings, labels) are left out.
    """
    empty = np.empty((0, 2), dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    raw = ("\0".join(t.replace("\0", " ") for t in texts) + "\0").encode("utf-8", "replace")
    buf = _LOWER[np.frombuffer(raw, dtype=np.uint8)]
    word = _WORD[buf]
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(start) == 0:
        return empty
    r, inv = _powers(len(buf) + 1)
    total = np.empty(len(buf) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(buf * r[:-1], out=total[1:])
    h = (total[end] - total[start]) * inv[start]
    h ^= h >> np.uint64(32)
    h *= _K
    after = np.append(buf[1:], 0).astype(np.uint8)
    ends = (_STOP[buf] & _SPACE[after]) | (buf == 124) | (buf == 0) | ((buf == 10) & ((after == 10) | (after == 13) | (after == 45)))
    sentence = np.cumsum(ends)[start]
    text = np.cumsum(buf == 0)[start]
    first = np.flatnonzero(np.diff(sentence, prepend=-1))
    size = np.diff(np.append(first, len(start)))
    pair = np.empty(len(h), dtype=np.uint64)
    pair[0] = 0
    pair[1:] = h[:-1] * np.uint64(3) + h[1:]
    pair ^= pair >> np.uint64(29)
    pair *= _K
    shift = np.uint64(64 - BITS)
    out = np.stack([(h >> shift).astype(np.int64), (pair >> shift).astype(np.int64) + (1 << BITS)], axis=1)
    out[first, 1] = -1
    keep = size >= least_words
    rows = np.repeat(keep, size)
    size = size[keep]
    return out[rows], np.cumsum(size) - size, text[first[keep]]


class Model:
    """Weights of the buckets for each subject, intercepts, and the share of sentences from which a text has the subject."""

    def __init__(self, names: list[str], weights: np.ndarray, bias: np.ndarray, threshold: np.ndarray):
        self.names, self.weights, self.bias, self.threshold = names, weights, bias, threshold

    def shares(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Share of the sentences of each text that are of each subject, and the number of sentences."""
        out, counts = np.zeros((len(texts), len(self.names))), np.zeros(len(texts), dtype=np.int64)
        at = 0
        while at < len(texts):
            upto, size = at, 0
            while upto < len(texts) and (upto == at or size + len(texts[upto]) < 1 << 21):
                size += len(texts[upto])
                upto += 1
            feats, first, text = features(texts[at:upto])
            if len(first):
                hit = self.sentences(feats, first)
                n = np.bincount(text, minlength=upto - at)
                counts[at:upto] = n
                for c in range(len(self.names)):
                    out[at:upto, c] = np.bincount(text, weights=hit[:, c], minlength=upto - at) / np.maximum(n, 1)
            at = upto
        return out, counts

    def sentences(self, feats: np.ndarray, first: np.ndarray) -> np.ndarray:
        scores = np.add.reduceat(self.weights[feats[:, 0]] + self.weights[feats[:, 1]], first, axis=0) + self.bias
        best = scores.argmax(axis=1)
        return (np.arange(scores.shape[1]) == best[:, None]) & (scores > 0)


def store_model(spark: SparkSession, model: Model, path: str) -> None:
    """Write a model to a folder that all executors share, so that it is fitted once for many runs."""
    kinds = {"weights": np.float32, "bias": np.float32, "threshold": np.float64}
    row = [model.names, *[np.ascontiguousarray(getattr(model, k), dtype=t).tobytes() for k, t in kinds.items()]]
    spark.createDataFrame([tuple(row)], "names array<string>, weights binary, bias binary, threshold binary").coalesce(1).write.mode("overwrite").parquet(path)


def stored_model(spark: SparkSession, path: str) -> Model:
    r = spark.read.parquet(path).first()
    c = len(r["names"])
    return Model(list(r["names"]), np.frombuffer(r["weights"], dtype=np.float32).reshape(-1, c), np.frombuffer(r["bias"], dtype=np.float32), np.frombuffer(r["threshold"], dtype=np.float64).copy())


#: Shares of the sentences that are tried as thresholds.
GRID = np.arange(0.1, 0.301, 0.01)


def _threshold(hits: np.ndarray, both: np.ndarray, known: float, otherwise: float) -> float:
    """The middle of the thresholds of best F1, drawn to another value by how little is known."""
    f1 = 2 * hits / np.maximum(1, both)
    return known * GRID[f1 >= f1.max() - 0.005].mean() + (1 - known) * otherwise


def fit(feats: np.ndarray, first: np.ndarray, doc: np.ndarray, prior: np.ndarray, truth: dict[int, set[int]], names: list[str], held: frozenset[int] = frozenset(), group: np.ndarray | None = None, rounds: int = 10, steps: int = 60, slack: float = 0.35) -> Model:
    """Fit the classifiers on sentences of documents with unsure labels.

    ``prior`` has for each document the probability of each subject and, last, of none for any of its sentences.
    Labels hold for documents, not sentences, so they are first brought down to sentences by expectation
    maximisation over the words more frequent in a subject than everywhere; the one-versus-rest logistic classifiers learn these.
    After each round the documents of a ``group`` (a filed main; -1: none) without hand labels are drawn to what the round found in
    the group, so that labels of a few mains teach the others. Documents in ``held`` take no part in that. Each subject's threshold is the share of sentences that reaches its best F1 on the
    ``truth`` (hand labels) of these, drawn to a common one, and that to a fifth, the fewer they are.
    """
    c = len(names)
    whole = feats, first, doc
    if held:
        keep = ~np.isin(doc, np.fromiter(held, dtype=np.int64))
        rows = np.repeat(keep, np.diff(np.append(first, len(feats))))
        size = np.diff(np.append(first, len(feats)))[keep]
        feats, first, doc = feats[rows], np.cumsum(size) - size, doc[keep]
    n_sent = len(first)
    size = np.diff(np.append(first, len(feats)))
    sent = np.repeat(np.arange(n_sent), size)
    words = feats[:, 0]
    post = prior[doc].copy()
    log_prior = np.log(prior[doc] + 1e-12)
    mine = np.full(n_sent, -1) if group is None else group[doc]
    grouped = mine >= 0
    lang = languages(feats, first, doc, len(prior))[doc][sent]
    words = words + (lang << BITS)
    size_l = len(LANGUAGES)
    flat = np.bincount(words, minlength=size_l << BITS).reshape(size_l, -1)
    background = (flat / np.maximum(1, flat.sum(axis=1, keepdims=True)))[:, :, None]
    for _ in range(rounds):
        counts = np.stack([np.bincount(words, weights=post[sent, k], minlength=size_l << BITS) for k in range(c)], axis=1).reshape(size_l, -1, c)
        # how much more often than everywhere in the language; words that lean to a subject by chance say nothing
        ratio = np.log((counts + 1) / (background * counts.sum(axis=1, keepdims=True) + 1))
        ratio = np.maximum(0, ratio - slack).reshape(-1, c)
        score = log_prior.copy()
        score[:, :c] += np.add.reduceat(ratio[words].astype(np.float32), first, axis=0)
        score -= score.max(axis=1, keepdims=True)
        post = np.exp(score)
        post /= post.sum(axis=1, keepdims=True)
        if grouped.any():
            mass = np.stack([np.bincount(mine[grouped], weights=post[grouped, k]) for k in range(c + 1)], axis=1)
            flat_mass = prior[doc[grouped]].mean(axis=0)
            mass = (mass + 40 * flat_mass) / (mass.sum(axis=1, keepdims=True) + 40)
            log_prior[grouped] = np.log(0.5 * prior[doc[grouped]] + 0.5 * mass[mine[grouped]] + 1e-12)
    target = post[:, :c]
    # one column for each bucket that occurs
    used, column = np.unique(np.where(feats < 0, 2 << BITS, feats).ravel(), return_inverse=True)
    column = column.reshape(feats.shape)
    real = feats.ravel() >= 0
    rows, cols = np.repeat(sent, 2)[real], column.ravel()[real]
    w, bias = np.zeros((len(used), c), dtype=np.float32), np.full(c, -2.0, dtype=np.float32)
    speed, speed_bias = np.full((len(used), c), 1e-9), np.full(c, 1e-9)
    has_pair = (feats[:, 1] >= 0)[:, None].astype(np.float32)
    for _ in range(steps):
        margin = np.add.reduceat(w[column[:, 0]] + w[column[:, 1]] * has_pair, first, axis=0) + bias
        error = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - target
        grad = np.stack([np.bincount(cols, weights=error[rows, k], minlength=len(used)) for k in range(c)], axis=1) / n_sent + 1e-6 * w
        speed += grad**2
        w -= (0.1 * grad / np.sqrt(speed)).astype(np.float32)
        g = error.mean(axis=0)
        speed_bias += g**2
        bias -= (0.05 * g / np.sqrt(speed_bias)).astype(np.float32)
    weights = np.zeros(((2 << BITS) + 1, c), dtype=np.float32)
    weights[used] = w
    weights[-1] = 0  # index -1: no pair
    model = Model(names, weights, bias.astype(np.float32), np.full(c, 0.2))
    feats, first, doc = whole
    docs = np.array(sorted(held or truth), dtype=np.int64)
    docs = docs[[d in truth for d in docs.tolist()]] if len(docs) else docs
    if len(docs) and len(first):
        hit = model.sentences(feats, first)
        n = np.bincount(doc, minlength=len(prior))
        share = np.stack([np.bincount(doc, weights=hit[:, k], minlength=len(prior)) for k in range(c)], axis=1) / np.maximum(n, 1)[:, None]
        yes = np.array([[k in truth[d] for k in range(c)] for d in docs])
        said = share[docs][None] >= GRID[:, None, None]
        hits, both = (said & yes).sum(axis=1), said.sum(axis=1) + yes.sum(axis=0)
        common = _threshold(hits.sum(axis=1), both.sum(axis=1), len(docs) / (len(docs) + 100), 0.2)
        for k in range(c):
            model.threshold[k] = _threshold(hits[:, k], both[:, k], yes[:, k].sum() / (yes[:, k].sum() + 50), common)
    return model


def train_subjects(texts: DataFrame, labels: DataFrame, layers: DataFrame, areas: DataFrame, labelled_rows: int = 3_000, hinted_rows: int = 3_000, sentences: int = 48, held_share: float = 0.25, kept_rows: int = 200) -> Model:
    """Fit on a bounded sample: at most ``labelled_rows`` rows with hand labels and ``hinted_rows`` with a filed
    main, chosen by a hash of their keys, and at most ``sentences`` sentences of each, chosen by a seed.

    A main is a hint for the subject that the hand labels of its documents show at least half of the time, and twice at least; what other
    mains stand for is found while fitting. ``held_share`` of the rows with hand labels, by hash, are kept out of the fit and set the thresholds. Labels of unknown
    subjects are left out.
    """
    names = [r[0] for r in areas.where("subject IS NOT NULL").select("subject", "subject_id").distinct().orderBy("subject_id", "subject").collect()]  # the reference list
    index = {n: i for i, n in enumerate(names)}
    subject = form_k(F.col("subject"))
    mains = current_rows(layers, ["main"]).select("doc_id", form_k(F.col("main")).alias("main")).where("main <> ''")
    hand = labels.where(subject.isin([form for form in index])).groupBy("extract_id").agg(F.collect_set(subject).alias("subjects"))
    hand = cut(hand.orderBy(F.xxhash64("extract_id"), "extract_id").limit(labelled_rows))
    base = texts.where(F.col("text").isNotNull() & F.col("extract_id").isNotNull()).select("extract_id", "doc_id", "text")
    # what mains the labelled documents have: at most labelled_rows mains
    shown = base.select("extract_id", "doc_id").join(F.broadcast(hand), "extract_id").select("doc_id", "subjects").join(mains, "doc_id")
    seen: dict[str, np.ndarray] = {}
    for r in shown.select("main", F.explode("subjects").alias("s"), (1 / F.size("subjects")).alias("w")).groupBy("main", "s").agg(F.sum("w").alias("w")).collect():
        seen.setdefault(r["main"], np.zeros(len(names)))[index[r["s"]]] = r["w"]
    hints = {m: int(v.argmax()) for m, v in seen.items() if v.max() >= 1.5 and v.max() >= 0.5 * v.sum()}
    by_hash = lambda df, *keys: df.orderBy(F.xxhash64(*keys), *keys)
    # both samples are bounded, so they are broadcast; the bounds are on rows, and each sample has its own
    hinted = base.select("extract_id", "doc_id").join(mains.withColumnRenamed("main", "hint"), "doc_id")
    hinted = by_hash(hinted.join(F.broadcast(hand.select("extract_id")), "extract_id", "left_anti"), "extract_id", "doc_id").limit(hinted_rows).distinct()
    with_hand = by_hash(base.join(F.broadcast(hand), "extract_id"), "extract_id", "doc_id", "text").limit(labelled_rows)
    with_hint = by_hash(base.join(F.broadcast(hinted), ["extract_id", "doc_id"]), "extract_id", "doc_id", "text").limit(hinted_rows)
    sample = with_hand.withColumn("hint", F.lit(None).cast("string")).unionByName(with_hint.withColumn("subjects", F.lit(None).cast("array<string>")))
    # a limit leaves one partition
    sample = sample.repartition(texts.sparkSession.sparkContext.defaultParallelism, "extract_id")

    def sentences_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for t in pdf.itertuples(index=False):
                feats, first, _ = features([t.text])
                parts = np.split(feats, first[1:]) if len(first) else []
                if len(parts) > sentences:
                    pick = np.sort(np.random.default_rng(int(t.extract_id) & 0xFFFFFFFF).choice(len(parts), sentences, replace=False))
                    parts = [parts[i] for i in pick]
                flat = np.concatenate(parts) if parts else np.empty((0, 2), dtype=np.int64)
                packed = [np.asarray(x, dtype=np.int32).tobytes() for x in ([len(p) for p in parts], flat[:, 0], flat[:, 1])]
                rows.append((t.extract_id, t.doc_id, t.subjects, t.hint, *packed))
            yield pd.DataFrame(rows, columns=["extract_id", "doc_id", "subjects", "hint", "sizes", "words", "pairs"])

    schema = "extract_id long, doc_id string, subjects array<string>, hint string, sizes binary, words binary, pairs binary"
    some = sample.mapInPandas(sentences_of, schema).toPandas().sort_values("extract_id", ignore_index=True)
    truth = {i: {index[s] for s in r.subjects if s in index} for i, r in enumerate(some.itertuples(index=False)) if r.subjects is not None and len(r.subjects)}
    # the hash that orders the sample is not used again, so that its first rows aren't the held ones
    order = sorted(truth, key=lambda i: (zlib.crc32(f"held {some['extract_id'].iat[i]}".encode()), i))
    held = frozenset(order[: int(held_share * max(0, len(order) - kept_rows))])
    c = len(names)
    prior = np.full((len(some), c + 1), 0.5 / max(c, 1))
    prior[:, c] = 0.5
    for i, r in enumerate(some.itertuples(index=False)):
        if i in truth:
            prior[i, :c] = 0.03 / c
            prior[i, sorted(truth[i])] = 0.47 / len(truth[i])
        elif r.hint in hints:
            prior[i, :c] = 0.15 / c
            prior[i, hints[r.hint]] = 0.35
    prior /= prior.sum(axis=1, keepdims=True)
    group = pd.factorize(some["hint"])[0]
    sizes = [np.frombuffer(s, dtype=np.int32) for s in some["sizes"]]
    flat = np.concatenate(sizes).astype(np.int64) if sizes else np.empty(0, dtype=np.int64)
    if not len(flat):
        return Model(names, np.zeros(((2 << BITS) + 1, c), dtype=np.float32), np.full(c, -1, dtype=np.float32), np.full(c, 0.2))
    feats = np.stack([np.frombuffer(b"".join(some[k]), dtype=np.int32) for k in ("words", "pairs")], axis=1)
    doc = np.repeat(np.arange(len(some)), [len(s) for s in sizes])
    return fit(feats, np.cumsum(flat) - flat, doc, prior, truth, names, held, group)


def assign_subjects(texts: DataFrame, model: Model) -> DataFrame:
    """(extract_id, subject, share, sentences): the subjects whose share of the sentences reaches their threshold.

    Map-only; whole texts are scored, sentence by sentence. Null, empty and subjectless texts give no rows; repeated
    rows are scored each for itself; other columns are left out. Ties between subjects of a sentence go to the first.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            share, n = model.shares(pdf["text"].tolist())
            row, col = np.nonzero((share >= model.threshold) & (n[:, None] > 0))
            ids = pdf["extract_id"].to_numpy(dtype=object)
            if not len(row):
                continue
            yield pd.DataFrame({"extract_id": ids[row], "subject": [model.names[k] for k in col], "share": share[row, col], "sentences": n[row]})

    # keys travel as text: pandas would make floats of numbers beside a null
    source = texts.where(F.col("text").isNotNull()).select(F.col("extract_id").cast("string").alias("extract_id"), "text")
    out = source.mapInPandas(run, "extract_id string, subject string, share double, sentences long")
    return out.withColumn("extract_id", F.col("extract_id").cast(texts.schema["extract_id"].dataType))


def subject_makeup(assigned: DataFrame, texts: DataFrame) -> DataFrame:
    """(subject, texts, share_of_texts) of the collection; subject null: texts of none."""
    each = assigned.select(F.col("extract_id").alias("_id"), "subject").distinct()
    rows = texts.select("extract_id").join(each, F.col("extract_id").eqNullSafe(F.col("_id")), "left")
    total = texts.agg(F.count(F.lit(1))).first()[0]
    return rows.groupBy("subject").agg(F.count(F.lit(1)).alias("texts")).withColumn("share_of_texts", F.col("texts") / F.lit(max(total, 1)))
