"""Problem 10: long exact spans shared between records, by anchors of fixed length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm.bitmap import bitmap, key_bits
from docloom.session import cut

_R = np.uint64(0x9E3779B97F4A7C15)
_RINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POS_BITS = 26
#: Contexts of one anchor that one task compares with each other; anchors in more texts are spread over several.
HOT = 200
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["r"]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for name, base in (("r", _R), ("inv", _RINV)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["r"][:n], _POWERS["inv"][:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def window_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every window of ``k`` code points: the same window has the same hash wherever it stands."""
    n = len(codes)
    if n < k:
        return np.empty(0, dtype=np.uint64)
    r, inv = _powers(n + 1)
    total = np.empty(n + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * r[:n], out=total[1:])
    return _mix((total[k:] - total[:-k]) * inv[: n - k + 1])


#: Moduli and bases of the second hash (fixed values): primes, so that no text is built to defeat it as powers of two can be.
_PRIMES = ((2147483647, 1103515245), (2147483629, 742938285))


def prime_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Like ``window_hashes``: two polynomials modulo primes, 62 bits in all."""
    n = len(codes)
    if n < k:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n - k + 1, dtype=np.uint64)
    for prime, base in _PRIMES:
        p, powers = np.uint64(prime), np.empty(n, dtype=np.uint64)
        inverse, back = pow(base, -1, prime), np.empty(n, dtype=np.uint64)
        powers[0] = back[0] = 1
        size = 1
        while size < n:  # doubling: the powers so far times the next one
            m = min(size, n - size)
            powers[size : size + m] = powers[:m] * np.uint64(pow(base, size, prime)) % p
            back[size : size + m] = back[:m] * np.uint64(pow(inverse, size, prime)) % p
            size += m
        total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers % p)])
        out = out << np.uint64(31) | (total[k:] - total[:-k]) % p * back[: n - k + 1] % p
    return out


def anchors(text: str, k: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of ``text``: in each run of span - k + 1 windows of length k the one of least hash.

    Two texts with an identical run of ``span`` characters have at least one anchor in that run in common, as the
    choice within the run depends on the run alone.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    w = span - k + 1
    # positions have _POS_BITS bits in a block; blocks overlap by a run, so that each run lies in one of them
    step = (1 << _POS_BITS) - w
    found = [_anchors(window_hashes(codes[at : at + step + w - 1 + k - 1], k), w, at) for at in range(0, max(1, len(codes) - span + 1), step)]
    pos, first = np.unique(np.concatenate([p for p, _ in found]), return_index=True)
    return pos, np.concatenate([h for _, h in found])[first]


def _anchors(h: np.ndarray, w: int, at: int) -> tuple[np.ndarray, np.ndarray]:
    if len(h) < w:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    key = h & ~np.uint64((1 << _POS_BITS) - 1) | np.arange(len(h), dtype=np.uint64)
    least, done = key, 1
    while done < w:
        shift = min(done, w - done)
        least = np.minimum(least[:-shift], least[shift:])
        done += shift
    changed = np.empty(len(least), dtype=bool)
    changed[0] = True
    np.not_equal(least[1:], least[:-1], out=changed[1:])
    pos = np.unique((least[changed] & np.uint64((1 << _POS_BITS) - 1)).astype(np.int64))
    return pos + at, h[pos]


_ANCHORS = pa.schema([("rep", pa.int64()), ("pos", pa.int32()), ("h", pa.int64())])
_CONTEXTS = pa.schema([("rep", pa.int64()), ("pos", pa.int32()), ("h", pa.int64()), ("n", pa.int64()), ("prev", pa.int32()), ("left", pa.string()), ("mid", pa.string()), ("right", pa.string())])


def distinct_texts(docs: DataFrame, key: str, text: str, span: int) -> tuple[DataFrame, DataFrame]:
    """(rep, text) with one row for each distinct text of at least ``span`` characters, and (rep, key) of all its records.

    Whole copies share all of their text; they are one row from here on, so that a group of copies that holds a
    third of all records costs no more than one record.
    """
    long = docs.where((F.char_length(F.col(text)) >= span) & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    hashed = long.select("key", F.sha2("text", 256).alias("digest"))
    members = cut(hashed.join(hashed.groupBy("digest").agg(F.min("key").alias("rep")), "digest").select("rep", "key"))
    reps = members.select("rep").where(F.col("rep") == F.col("key"))
    # a key that stands on several rows has each of its texts
    texts = long.withColumnRenamed("key", "rep").join(reps.distinct(), "rep", "left_semi")
    return texts, members


def _map_anchors(k: int, span: int, bits: bytes | None = None):
    """Anchors of each text; with a bitmap only those that may stand in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = None if bits is None else np.frombuffer(bits, dtype=np.uint8)
        for batch in batches:
            reps, pos, hashes = [], [], []
            for rep, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                p, h = anchors(text, k, span)
                if listed is not None:
                    at = h & np.uint64(8 * len(listed) - 1)
                    keep = (listed[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                    p, h = p[keep], h[keep]
                reps.append(np.full(len(p), rep, dtype=np.int64))
                pos.append(p.astype(np.int32))
                hashes.append(h.view(np.int64))
            if reps:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (reps, pos, hashes)], schema=_ANCHORS)

    return run


def _map_contexts(k: int, span: int):
    reach = span - k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in _CONTEXTS]
            for rep, text, at in zip(*(batch.column(i).to_pylist() for i in range(3))):
                before = None
                for one in sorted(at, key=lambda x: x["pos"]):
                    p = one["pos"]
                    prev = p - before if before is not None and p - before <= reach else None
                    before = p
                    for column, value in zip(rows, (rep, p, one["h"], one["n"], prev, text[max(0, p - reach) : p][::-1], text[p : p + k], text[p + k : p + k + reach])):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(rows, _CONTEXTS)], schema=_CONTEXTS)

    return run


def shared_contexts(docs: DataFrame, text: str, texts: DataFrame, span: int, k: int) -> DataFrame:
    """(rep, pos, h, places of h, distance to the anchor before, left reversed, mid, right) of every anchor whose hash stands in more than one distinct text."""
    # anchors are found twice: that takes less than to store one row for each fiftieth character; the second time only those
    # that a bitmap of bounded size says may be shared are shuffled
    find = lambda rows, bits: rows.mapInArrow(_map_anchors(k, span, bits), "rep long, pos int, h long")
    # a digest stands for each text here, so that copies count once and no text has to be moved
    digests = docs.where(F.char_length(F.col(text)) >= span).select(F.xxhash64(text).alias("rep"), F.col(text).alias("text"))
    several = find(digests, None).groupBy("h").agg(F.min("rep").alias("a"), F.max("rep").alias("b"), F.count(F.lit(1)).alias("n")).where(F.col("a") < F.col("b")).select("h", "n")
    several = cut(several)
    # a power of two: the low bits of a hash are its bit, whatever its sign
    bits = key_bits(several.count())
    found = find(texts.select("rep", "text"), bitmap(several, F.col("h").bitwiseAND(F.lit(bits - 1)), bits))
    hits = found.join(several, "h").groupBy("rep").agg(F.collect_list(F.struct("pos", "h", "n")).alias("at"))
    return texts.join(hits, "rep").select("rep", "text", "at").mapInArrow(
        _map_contexts(k, span), "rep long, pos int, h long, n long, prev int, left string, mid string, right string"
    )


_PAIRS = pa.schema([("rep_a", pa.int64()), ("rep_b", pa.int64())])


def _prefix(a: str, b: str) -> int:
    if a == b:
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _verify(span: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, left, left_b, right, right_b = (batch.column(i) for i in range(6))
            keep = left.is_null().to_numpy(zero_copy_only=False).copy()  # those that the JVM is sure of
            open_ = np.flatnonzero(~keep)
            some = [c.take(pa.array(open_)).to_pylist() for c in (left, left_b, right, right_b)]
            for i, x, x_b, y, y_b in zip(open_, *some):
                keep[i] = _prefix(x, x_b) + k + _prefix(y, y_b) >= span
            yield pa.RecordBatch.from_arrays([a.filter(pa.array(keep)), b.filter(pa.array(keep))], schema=_PAIRS)

    return run


def _hit_pairs(contexts: DataFrame, span: int, k: int) -> DataFrame:
    """(rep_a, rep_b) of every two texts with an identical run around a common anchor.

    Of the span - k characters that a run needs besides the anchor at least half stand on one side, so contexts that
    differ on both sides within that half are no hit, and those that agree in it on both sides are one; the JVM
    decides these, and the rest is compared character by character. A run that holds several anchors is counted at the first:
    where two contexts have the same anchor before this one, with the same text between, the pair is found there. So an
    anchor whose contexts all have the same one before it is left out. The contexts of an anchor in more than ``HOT``
    places are spread by a salt on one side and repeated for each salt on the other.
    """
    names = ("rep", "prev", "left", "mid", "right")
    behind = F.when(F.col("prev").isNotNull(), F.xxhash64("prev", F.substring("left", F.lit(1), F.col("prev"))))
    firsts = contexts.select("h", behind.alias("g")).groupBy("h").agg(F.min("g").alias("a"), F.max("g").alias("b"), F.count_if(F.col("g").isNull()).alias("none"))
    contexts = contexts.join(firsts.where("none > 0 OR a < b").select("h"), "h", "left_semi")
    other = [F.col(c).alias(f"{c}_b") for c in names]
    cold, hot = contexts.where(F.col("n") <= HOT), contexts.where(F.col("n") > HOT)
    salts = F.ceil(F.col("n") / HOT).cast("int")
    # few bytes make many pairs here, so the number of tasks is given: by size they would be put together
    tasks = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = hot.select("h", F.pmod(F.xxhash64("rep", "pos"), salts).cast("int").alias("s"), *other).repartition(tasks, "h", "s")
    every = hot.select("h", *names, F.explode(F.sequence(F.lit(0), salts - 1)).alias("s")).repartition(tasks, "h", "s")
    columns = [*names, *(f"{c}_b" for c in names)]
    both = cold.select("h", *names).join(cold.select("h", *other), "h").select(*columns).unionAll(every.join(spread, ["h", "s"]).select(*columns))
    half = (span - k) // 2 + (span - k) % 2
    same = lambda c: F.substring(c, 1, half) == F.substring(f"{c}_b", 1, half)
    # a context at the border of its text is shorter than half
    sure = same("left") & same("right") & (F.char_length("left") >= half) & (F.char_length("right") >= half)
    both = both.where((F.col("rep") < F.col("rep_b")) & (F.col("mid") == F.col("mid_b"))).withColumn("_sure", sure)
    one_side = F.least(F.lit(half), F.lit(span - k - half))
    near = lambda c: F.substring(c, 1, one_side) == F.substring(f"{c}_b", 1, one_side)
    found_before = (F.col("prev") == F.col("prev_b")) & (F.substring("left", F.lit(1), F.col("prev")) == F.substring("left_b", F.lit(1), F.col("prev")))
    both = both.where((near("left") | near("right")) & ~F.coalesce(found_before, F.lit(False)))
    strings = [F.when(~F.col("_sure"), F.col(c)).alias(c) for c in ("left", "left_b", "right", "right_b")]
    return both.select("rep", "rep_b", *strings).mapInArrow(_verify(span, k), "rep_a long, rep_b long").distinct()


def shared_span_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = 200, k: int = 100) -> DataFrame:
    """(doc_a, doc_b) of every two records whose texts have an identical run of at least ``span`` code points.

    Blocks of ``k`` characters anchor the search; each hit is extended to both sides and counts if the identical
    run reaches ``span`` characters, compared character by character. Of the rolling windows only those of least
    hash in each run of span - k + 1 windows are anchors: probing with every window would shuffle one row for each
    character of the collection, some seventy times its size. The guarantee is the same: no shared run is missed.

    Texts that are null or shorter than ``span`` have no pairs. Copies of a text are compared once and their pairs
    are listed from the membership. A key on several rows is one record; a pair has doc_a < doc_b and appears once.
    An empty table gives no rows; other columns are ignored.
    """
    texts, members = distinct_texts(docs, key, text, span)
    contexts = cut(shared_contexts(docs, text, texts, span, k))
    pairs = _hit_pairs(contexts, span, k)
    repeated = members.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("rep")
    both = pairs.unionAll(repeated.select(F.col("rep").alias("rep_a"), F.col("rep").alias("rep_b")))
    # the members of a large group of copies are spread over several keys, so that no task lists all of its pairs
    sizes = members.groupBy("rep").agg(F.ceil(F.count(F.lit(1)) / 2_000).cast("int").alias("k"))
    a = members.select(F.col("rep").alias("rep_a"), F.col("key").alias("x"))
    b = members.join(sizes, "rep").select(F.col("rep").alias("rep_b"), F.col("key").alias("y"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("s"))
    left = both.join(sizes.withColumnRenamed("rep", "rep_b"), "rep_b").join(a, "rep_a").withColumn("s", F.pmod(F.xxhash64("x"), "k").cast("int"))
    wide = left.join(b, ["rep_b", "s"]).where(F.col("x") != F.col("y")).where((F.col("rep_a") != F.col("rep_b")) | (F.col("x") < F.col("y")))
    return wide.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).distinct()


_WINDOWS = pa.schema([("rep", pa.int64()), ("start", pa.int32()), ("w", pa.int64()), ("v", pa.int64())])


def _map_windows(span: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[list] = [[], [], [], []]
            for rep, pos, left, mid, right in zip(*(batch.column(i).to_pylist() for i in range(5))):
                codes = np.frombuffer((left[::-1] + mid + right).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                h = window_hashes(codes, span)
                start = np.arange(len(h), dtype=np.int32) + np.int32(pos - len(left))
                for part, column in zip(parts, (np.full(len(h), rep, dtype=np.int64), start, h.view(np.int64), prime_hashes(codes, span).view(np.int64))):
                    part.append(column)
            if parts[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in parts], schema=_WINDOWS)

    return run


def shared_share(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = 200, k: int = 100) -> DataFrame:
    """(doc_id, n_chars, copies, shared_chars, shared_share, spans) of every record.

    shared_chars counts the characters that lie in a run of at least ``span`` code points which stands in another
    record too, spans the maximal stretches of such characters. A record with a whole copy (copies > 0) of at least
    ``span`` characters is shared as a whole. No pairs are formed: each window of ``span`` characters around an
    anchor that stands in several texts is hashed, and a window is shared if its hash stands in two distinct texts,
    so a passage found in a third of all records costs a row for each of them. Windows are equal if two hashes of together
    126 bits are, 62 of them of polynomials modulo primes; their characters are not compared.

    Null and short texts have 0; every row of ``docs`` gives one row. An empty table gives no rows.
    """
    texts, members = distinct_texts(docs, key, text, span)
    contexts = shared_contexts(docs, text, texts, span, k)
    windows = cut(contexts.select("rep", "pos", "left", "mid", "right").mapInArrow(_map_windows(span, k), "rep long, start int, w long, v long").distinct())
    shared = windows.groupBy("w", "v").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select("w", "v")
    starts = windows.join(shared, ["w", "v"], "left_semi").select("rep", "start").distinct()
    after = F.lead("start").over(Window.partitionBy("rep").orderBy("start"))
    gaps = starts.select("rep", F.coalesce(after - F.col("start"), F.lit(span)).alias("step"), after.isNull().alias("last"))
    covered = gaps.groupBy("rep").agg(
        F.sum(F.least("step", F.lit(span))).alias("covered"), F.sum(F.when(F.col("last") | (F.col("step") > span), 1).otherwise(0)).alias("spans")
    )
    counts = members.groupBy("rep").agg((F.count(F.lit(1)) - 1).alias("copies"))
    # the digest makes the membership of a row, as a key may stand on several rows
    sizes = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.char_length(F.col(text)), F.lit(0)).alias("n_chars"))
    by_key = members.join(counts, "rep").join(covered, "rep", "left").groupBy("key").agg(
        F.max("copies").alias("copies"), F.sum("covered").alias("covered"), F.sum("spans").alias("n_spans")
    )
    joined = sizes.join(by_key, F.col("doc_id") == F.col("key"), "left")
    whole = F.col("copies") > 0
    chars = F.when(whole, F.col("n_chars")).otherwise(F.coalesce("covered", F.lit(0))).cast("long")
    return joined.select(
        "doc_id",
        "n_chars",
        F.coalesce("copies", F.lit(0)).alias("copies"),
        chars.alias("shared_chars"),
        F.when(F.col("n_chars") > 0, chars / F.col("n_chars")).otherwise(0.0).alias("shared_share"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("spans"),
    )
