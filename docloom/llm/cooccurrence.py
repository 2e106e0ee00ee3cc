"""Problem 4: items that appear together, by basket collapsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.terms import form_k
from docloom.session import cut

#: Bits of the filter of each field that keeps rare items out of the pairs; what gets by it is dropped by the counts of the items.
BITS = 1 << 17


def term_baskets(records: DataFrame, record: str, fields: dict[str, Column]) -> DataFrame:
    """(field, record, basket): the sorted distinct terms, in form K, of each array in ``fields``; empty baskets are left out.

    ``records`` has one row for each record, so that no row has to be grouped.
    """
    basket = lambda c: F.array_sort(F.array_distinct(F.filter(F.transform(c, form_k), lambda t: t.isNotNull() & (t != ""))))
    each = F.array(*[F.struct(F.lit(f).alias("field"), basket(c).alias("basket")) for f, c in fields.items()])
    return records.select(F.col(record).alias("record"), F.explode(each).alias("x")).select("x.field", "record", "x.basket").where(F.size("basket") > 0)


def basket_pairs(baskets: DataFrame, min_count: int = 5, min_share: float = 0.001) -> DataFrame:
    """Pairs of items with their joint count, lift and conviction.

    ``baskets`` has field, record and basket (sorted distinct items), one row for each record of a field. The result has field,
    item_a < item_b, n, a, b, ab, lift and conviction for every pair with ab >= min_count and ab >= min_share * n.

    Identical baskets are collapsed to one row with a weight, and items, records and pairs are all counted from the
    collapsed baskets: a group of copies that holds a third of all records costs one basket. No pair can reach the support
    with an item below it, so such items leave the baskets before pairs are listed, by a bitmap of fixed size; at most
    mean-basket-size / min_share items of a field have the support, which bounds what is sent to the tasks and the
    pairs of one basket.

    Null baskets are ignored; an empty table gives no rows; other columns are ignored.
    Conviction P(a) P(not b) / P(a and not b) is null where item_b is in every record of item_a.
    """
    clean = baskets.where((F.size("basket") > 0) & F.col("record").isNotNull())
    weighted = cut(clean.groupBy("field", "basket").agg(F.count(F.lit(1)).alias("weight")))
    totals = F.broadcast(weighted.groupBy("field").agg(F.sum("weight").alias("n")))  # a row for each field
    counts = weighted.select("field", "weight", F.explode("basket").alias("term")).groupBy("field", "term").agg(F.sum("weight").alias("c"))
    counts = counts.where(F.col("c") >= min_count).join(totals, "field").where(F.col("c") >= F.col("n") * min_share)
    frequent = cut(counts)
    bit = lambda term: F.pmod(F.xxhash64(term), F.lit(BITS))
    at = bit(F.col("term"))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))
    words: dict[str, list[int]] = {}
    for r in frequent.select("field", F.floor(at / 64).alias("w"), mask.alias("m")).groupBy("field", "w").agg(F.bit_or("m").alias("m")).collect():
        words.setdefault(r["field"], [0] * (BITS // 64))[r["w"]] = r["m"]
    bits = F.broadcast(baskets.sparkSession.createDataFrame([*words.items()], "field string, _bits array<long>"))
    in_bits = lambda t: F.getbit(F.get("_bits", F.floor(bit(t) / 64).cast("int")), F.pmod(bit(t), F.lit(64)).cast("int")) == 1
    small = weighted.join(bits, "field").select("field", "weight", F.filter("basket", in_bits).alias("basket"))
    firsts = small.where(F.size("basket") > 1).select("field", "basket", "weight", F.posexplode("basket").alias("_pos", "item_a"))
    pairs = (
        firsts.select("field", "weight", "item_a", F.explode(F.slice("basket", F.col("_pos") + 2, F.size("basket"))).alias("item_b"))
        .groupBy("field", "item_a", "item_b")
        .agg(F.sum("weight").alias("ab"))
    )
    side = lambda x: frequent.select("field", F.col("term").alias(f"item_{x}"), F.col("c").alias(x))
    joined = (
        pairs.where(F.col("ab") >= min_count)
        .join(totals, "field")
        .where(F.col("ab") >= F.col("n") * min_share)
        .join(F.broadcast(side("a")), ["field", "item_a"])
        .join(F.broadcast(side("b")), ["field", "item_b"])
    )
    lift = F.col("ab") * F.col("n") / (F.col("a") * F.col("b"))
    conviction = F.when(F.col("a") > F.col("ab"), F.col("a") * (F.col("n") - F.col("b")) / (F.col("n") * (F.col("a") - F.col("ab"))))
    return joined.select("field", "item_a", "item_b", "n", "a", "b", "ab", lift.alias("lift"), conviction.alias("conviction"))


def frequent_pairs(items: DataFrame, min_count: int = 5, min_share: float = 0.001) -> DataFrame:
    """``basket_pairs`` of rows (field, record, term), repeated ones allowed: they are grouped to baskets first.

    Null records and null or empty terms are ignored.
    """
    clean = items.where(F.col("record").isNotNull() & F.col("term").isNotNull() & (F.col("term") != ""))
    baskets = clean.groupBy("field", "record").agg(F.array_sort(F.collect_set("term")).alias("basket"))
    return basket_pairs(baskets, min_count, min_share)
