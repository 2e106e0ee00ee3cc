"""Audit of placements: verdicts made whole, applied, and measured."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The verdicts an audit may give.
VERDICTS = ("confirm", "wrong-parent", "split", "merge", "cannot-tell")


def whole_verdicts(plan: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(chunk_id, rel_path, verdict, better_home): one verdict for each planned file.

    Verdicts on files that are not in the chunk are dropped, unknown words and missing files are 'cannot-tell'. Of
    several verdicts on a file the one that sorts first counts.
    """
    named = F.when(F.col("verdict").isin(*VERDICTS), F.col("verdict")).otherwise("cannot-tell")
    one = verdicts.select("chunk_id", "rel_path", named.alias("verdict"), "better_home").groupBy("chunk_id", "rel_path").agg(F.min_by(F.struct("verdict", "better_home"), F.struct("verdict", "better_home")).alias("v"))
    joined = plan.select("chunk_id", "rel_path").join(one, ["chunk_id", "rel_path"], "left")
    return joined.select("chunk_id", "rel_path", F.coalesce("v.verdict", F.lit("cannot-tell")).alias("verdict"), F.col("v.better_home").alias("better_home"))


def flag_rates(verdicts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., files, flags, rate): share of verdicts that don't confirm."""
    grouped = verdicts.groupBy(*(by or []))
    flags = F.count_if(F.col("verdict") != "confirm")
    return grouped.agg(F.count(F.lit(1)).alias("files"), flags.alias("flags"), (flags / F.count(F.lit(1))).alias("rate"))


def apply_verdicts(assignments: DataFrame, verdicts: DataFrame, homes: DataFrame) -> DataFrame:
    """(rel_path, region_ids, applied): assignments with the better homes of 'wrong-parent' verdicts put first.

    A better home that is no node is not applied (applied 'invalid-home'). The old homes stay behind the new one.
    """
    wrong = verdicts.where("verdict = 'wrong-parent'").groupBy("rel_path").agg(F.min("better_home").alias("better"))
    known = homes.select(F.col("id").alias("better"), F.lit(True).alias("_known")).distinct()
    judged = wrong.join(known, "better", "left")
    joined = assignments.join(judged, "rel_path", "left")
    ok = F.coalesce("_known", F.lit(False))
    moved = F.when(ok, F.concat(F.array("better"), F.array_remove("region_ids", F.col("better")))).otherwise(F.col("region_ids"))
    applied = F.when(ok, "moved").when(F.col("better").isNotNull(), "invalid-home").otherwise("kept")
    return joined.select("rel_path", moved.alias("region_ids"), applied.alias("applied"))


def mixed_groups(verdicts: DataFrame, bins: list[str], least: int = 1) -> DataFrame:
    """(region, wrong): regions, bins apart, with at least ``least`` files under the wrong parent."""
    region = F.split_part("chunk_id", F.lit("#"), F.lit(1))
    wrong = verdicts.where("verdict = 'wrong-parent'").groupBy(region.alias("region")).agg(F.count(F.lit(1)).alias("wrong"))
    return wrong.where((F.col("wrong") >= least) & ~F.col("region").isin(*bins))


def stop_reason(rates: list[float], applied: int, rounds: int, most: int = 3, enough: float = 0.15) -> str | None:
    """Why an audit loop ends after these flag rates: they rose, rounds are used up, nothing was applied, few flags are left."""
    if len(rates) > 1 and rates[-1] > rates[-2]:
        return "flags-rose"
    if rounds >= most:
        return "max-rounds"
    if applied == 0:
        return "no-applies"
    return "flag-rate" if rates and rates[-1] < enough else None


def audit_loop(assignments: DataFrame, nodes: DataFrame, judge, most: int = 3, enough: float = 0.15) -> tuple[DataFrame, list[dict]]:
    """Audit, apply and audit again until there is reason to stop: the last assignments and a log of the rounds.

    ``judge`` takes (rel_path, region_ids) and gives (chunk_id, rel_path, verdict, better_home). Each round is written
    once before the next, so the lineage doesn't grow. A round whose flags rose is not applied.
    """
    from docloom.session import cut

    rates: list[float] = []
    log: list[dict] = []
    current = cut(assignments.select("rel_path", "region_ids"))
    for number in range(1, most + 1):
        verdicts = cut(judge(current))
        rate = flag_rates(verdicts).first()["rate"] or 0.0
        rates.append(rate)
        if stop_reason(rates, 1, 0, most, enough) == "flags-rose":
            log.append({"round": number, "rate": rate, "applied": 0, "stop": "flags-rose"})
            break
        done = cut(apply_verdicts(current, verdicts, nodes))
        applied = done.where("applied = 'moved'").count()
        current = done.select("rel_path", "region_ids")
        reason = stop_reason(rates, applied, number, most, enough)
        log.append({"round": number, "rate": rate, "applied": applied, "stop": reason})
        if reason:
            break
    return current, log
