"""Problem 9: mixing sources to target shares, by Sainte-Laguë apportionment of token blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions.terms import form_k
from docloom.llm.tokens import VOCABULARY, token_sizes
from docloom.session import cut


def sainte_lague(weights: dict[str, float], seats: int) -> dict[str, int]:
    """Seats by highest quotients weight / (2 i + 1); ties go to the lexically first name.

    The bulk is given by rounding at a common divisor, then single seats by quotients, so billions of seats cost no
    more than a few.
    """
    total = sum(weights.values())
    names = sorted(n for n, w in weights.items() if w > 0)
    if not names or seats <= 0:
        return {n: 0 for n in weights}
    # a little less than every source's fair number is always due to it
    out = {n: max(0, int(weights[n] / total * seats) - len(names)) for n in names}
    for _ in range(seats - sum(out.values())):
        best = max(names, key=lambda n: (weights[n] / (2 * out[n] + 1), [-ord(c) for c in n]))
        out[best] += 1
    return {n: out.get(n, 0) for n in weights}


def mix_sources(
    docs: DataFrame,
    targets: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    block_tokens: int = 256,
    shard_tokens: int = 1 << 21,
    seed: int = 17,
    path: str = VOCABULARY,
    total_tokens: int | None = None,
) -> DataFrame:
    """(source, doc_id, n_tokens, uses): the texts of the mixture and how often each is used.

    Sources are compared in form K. The mixture is as large as the caps allow: the least of tokens * max_repeats /
    target_share over the sources (or ``total_tokens``, if that is less). It is divided into equal blocks of
    ``block_tokens`` tokens, and Sainte-Laguë's highest quotients give each source its integer number of blocks.
    Each source's texts are spread over shards of about ``shard_tokens`` tokens by a seeded hash; each shard gets
    its integer quota of blocks by highest quotients of its tokens. The blocks of a shard lie on the line of its texts in seeded order;
    all are selected as often as the quota holds them whole, and of the rest the first ones: texts stay whole, and one is used if at
    least half of it lies in selected blocks. So no text is used more than max_repeats times, and a
    shard misses its quota by half a text at the most.

    Texts without tokens, of a null source or of a source without a target (or a target of 0) are not used. A source
    that has a target but no text makes the mixture empty of that source; the others are mixed to their own shares.
    """
    wanted = {r["s"]: (r["share"], r["most"]) for r in _targets(targets).collect()}
    sizes = token_sizes(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), form_k(F.col(source)).alias("source")), path=path, keep=("source",))
    sizes = cut(sizes.where("n_tokens > 0 AND source IS NOT NULL").where(F.col("source").isin([*wanted])))
    have = {r["source"]: r["t"] for r in sizes.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    share = {s: wanted[s][0] for s in have if wanted[s][0] > 0 and wanted[s][1] > 0}
    largest = min((have[s] * wanted[s][1] * sum(share.values()) / share[s] for s in share), default=0)
    largest = min(largest, total_tokens) if total_tokens is not None else largest
    quota = sainte_lague(share, int(largest // block_tokens))
    spark = docs.sparkSession
    shards = {s: max(1, round(have[s] / shard_tokens)) for s in share}
    # one row for each source: bounded by the list of targets
    plan = spark.createDataFrame([(s, shards[s], quota[s]) for s in share] or [("", 1, 0)], "source string, shards int, blocks long")
    placed = sizes.join(F.broadcast(plan), "source").withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(seed)), "shards").cast("int"))
    per = placed.groupBy("source", "shard", "blocks").agg(F.sum("n_tokens").alias("held"))
    per = shard_seats(per).select("source", "shard", "held", (F.col("seats") * block_tokens).alias("quota"))
    per = per.join(F.broadcast(_targets(targets).select(F.col("s").alias("source"), "most")), "source")
    per = per.withColumn("quota", F.least("quota", F.col("held") * F.col("most")))
    joined = placed.select("source", "shard", "doc_id", "n_tokens").join(per, ["source", "shard"])
    rounds = F.floor(F.col("quota") / F.col("held"))
    rest = F.col("quota") - rounds * F.col("held")
    order = Window.partitionBy("source", "shard").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    until = F.sum("n_tokens").over(order)
    used = joined.select("source", "doc_id", "n_tokens", rounds.alias("rounds"), rest.alias("rest"), until.alias("until"))
    extra = F.when(F.col("until") - F.col("n_tokens") / 2 <= F.col("rest"), 1).otherwise(0)
    uses = (F.col("rounds") + F.when(F.col("rest") > 0, extra).otherwise(0)).cast("int")
    return used.select("source", "doc_id", "n_tokens", uses.alias("uses")).where("uses > 0")


def _targets(targets: DataFrame) -> DataFrame:
    """(s, share, most): one row for each source in form K; rows without a source are left out."""
    each = targets.where(F.col("source").isNotNull()).groupBy(form_k(F.col("source")).alias("s"))
    return each.agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("most"))


def shard_seats(per: DataFrame) -> DataFrame:
    """(source, shard, held, seats): the blocks of each source over its shards (source, shard, blocks, held), by highest quotients.

    Rounding at the common divisor held / blocks gives all but a few seats; those over or missing are taken from the lowest or
    given to the highest quotients. So a source's shards are never in one task, however many there are, and its seats add up to its blocks. Ties go
    to the lower shard.
    """
    spark = per.sparkSession
    whole = per.groupBy("source").agg(F.sum("held").alias("_whole"))
    fair = F.col("held") * F.col("blocks") / F.col("_whole")
    rows = cut(per.join(F.broadcast(whole), "source").select("source", "shard", "held", "blocks", F.floor(fair + 0.5).alias("seats")))
    moves = spark.createDataFrame([], f"source string, shard {per.schema['shard'].dataType.simpleString()}, more long")
    for r in rows.groupBy("source").agg(F.first("blocks").alias("blocks"), F.sum("seats").alias("given")).collect():  # a row for each source
        d = r["blocks"] - r["given"]
        if d == 0:
            continue
        one = rows.where(F.col("source") == r["source"])
        most = F.ceil(2 * F.col("seats") * abs(d) / max(r["blocks"], 1)).cast("int") + 1
        if d > 0:
            tried = one.select("source", "shard", "held", "seats", F.explode(F.sequence(F.lit(0), most)).alias("j"))
            order = [F.desc(F.col("held") / (2 * (F.col("seats") + F.col("j")) + 1)), F.col("shard"), F.col("j")]
        else:
            tried = one.where("seats > 0").select("source", "shard", "held", "seats", F.explode(F.sequence(F.lit(0), F.least(most, (F.col("seats") - 1).cast("int")))).alias("j"))
            order = [F.asc(F.col("held") / (2 * (F.col("seats") - F.col("j")) - 1)), F.desc("shard"), F.col("j")]
        moved = tried.orderBy(*order).limit(abs(d)).groupBy("source", "shard").agg((F.count(F.lit(1)) * (1 if d > 0 else -1)).alias("more"))
        moves = moves.unionByName(moved)
    out = rows.join(moves, ["source", "shard"], "left")
    return out.select("source", "shard", "held", (F.col("seats") + F.coalesce("more", F.lit(0))).alias("seats"))


def mix_report(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """One row for each target: source, target_share, max_repeats, texts, tokens, actual_share, most_uses."""
    by = mixture.groupBy("source").agg(
        F.count(F.lit(1)).alias("texts"), F.sum(F.col("n_tokens").cast("long") * F.col("uses")).alias("tokens"), F.max("uses").alias("most_uses")
    )
    by = by.withColumn("total", F.sum("tokens").over(Window.partitionBy(F.lit(1))))  # a row for each source
    named = _targets(targets).select(F.col("s").alias("source"), F.col("share").alias("target_share"), F.col("most").alias("max_repeats"))
    joined = named.join(F.broadcast(by), "source", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return joined.select("source", "target_share", "max_repeats", zero("texts"), zero("tokens"), zero("most_uses"), F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)).alias("actual_share"))
