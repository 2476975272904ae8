"""Mixing sources to target weights by temperature.

A source's weight is its share of all tokens raised to an exponent, normalised. The exponent is
found by bisection: the flattest mix that repeats no document more often than allowed, or the
mix whose entropy is as asked. Sources are only ever summed in Spark, so they may be many.
The weights are realised as budgeted permutations: every epoch runs through a source in an
order dealt by a hash, the last one as far as the budget goes, and all sources fill a row of
blocks at one pace, so that every block holds the weights. What decides about a document is its
hash and a row per source and bucket; texts are not shuffled for it.
"""

from __future__ import annotations

from math import log

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, text_of

#: A source is cut by bucket of the hash first, then inside one bucket.
BUCKET_BITS = 10
BLOCKS = 64
MAX_REPEATS = 2.0
SEED = 7
#: Exponents tried in one job of the bisection, and such jobs.
GRID = 16
GRID_ROUNDS = 8


def exponent(
    totals: DataFrame, wanted: float, entropy: bool = False, budget: float | None = None
) -> float:
    """The least exponent in 0..1 whose entropy or largest repetition is at most ``wanted``.

    Both fall as the exponent rises; 1 is returned if none is low enough. ``totals`` has a row
    per source with its ``share`` of all tokens. ``budget`` is in units of all tokens; without
    it the budget is such that the source repeated least runs through once.
    """
    low, high = 0.0, 1.0
    for _ in range(GRID_ROUNDS):
        tried = [low + (high - low) * k / GRID for k in range(GRID + 1)]
        asked = [F.max("share").alias("most")]
        for k, t in enumerate(tried):
            raised = F.pow("share", F.lit(t))
            asked += [
                F.sum(raised).alias(f"sum{k}"),
                F.sum(raised * F.log("share")).alias(f"log{k}"),
                F.max(raised / F.col("share")).alias(f"ratio{k}"),
            ]
        row = totals.where("share > 0").agg(*asked).first()
        if row["most"] is None:
            return 1.0
        found = None
        for k, t in enumerate(tried):
            total = row[f"sum{k}"]
            if entropy:
                value = log(total) - t * row[f"log{k}"] / total
            elif budget is None:
                value = row[f"ratio{k}"] / row["most"] ** (t - 1)
            else:
                value = budget * row[f"ratio{k}"] / total
            if value <= wanted * (1 + 1e-12):
                found = k
                break
        if found is None:
            return 1.0
        if found == 0:
            return tried[0]
        low, high = tried[found - 1], tried[found]
    return high


def _dealt(docs: DataFrame, id_col: str, source_col: str, text_col: str, seed: int) -> DataFrame:
    """``docs`` with what the mix goes by: source, tokens (words), deal and bucket."""
    deal = F.xxhash64(F.lit(seed), F.col(id_col))
    return docs.withColumns(
        {
            "__source": F.col(source_col).cast("string"),
            "__tokens": F.regexp_count(
                text_of(text_col), F.lit(r"[^\x20\x09-\x0D]+")
            ).cast("long"),
            "__deal": deal,
            "__bucket": F.shiftrightunsigned(deal, 64 - BUCKET_BITS).cast("int"),
        }
    )


def schedule(
    dealt: DataFrame,
    max_repeats: float = MAX_REPEATS,
    target_entropy: float | None = None,
    budget_tokens: int | None = None,
) -> DataFrame:
    """A row per source and bucket: weight, repeats, how many whole epochs, where the last ends.

    ``place`` is the part of the source before the bucket; ``last_deal`` is the largest hash in
    the bucket that is still in the last, partial epoch (null: none; 2**63 - 1: all).
    """
    buckets = stage(
        dealt.groupBy("__source", "__bucket").agg(F.sum("__tokens").alias("tokens")), "buckets"
    )
    totals = buckets.groupBy(F.col("__source").alias("source")).agg(
        F.sum("tokens").alias("source_tokens")
    )
    everything = totals.agg(F.sum("source_tokens").alias("n")).first()["n"] or 0
    totals = stage(
        totals.withColumn("share", F.col("source_tokens") / F.lit(float(max(everything, 1)))),
        "sources",
    )
    budget = budget_tokens / max(everything, 1) if budget_tokens is not None else None
    by_entropy = target_entropy is not None
    alpha = exponent(totals, target_entropy if by_entropy else max_repeats, by_entropy, budget)
    raised = F.pow("share", F.lit(alpha))
    sums = totals.where("share > 0").agg(F.sum(raised).alias("z"), F.max("share").alias("m")).first()
    z, most = (sums["z"] or 1.0), (sums["m"] or 1.0)
    if budget is None:
        budget = most * z / most**alpha
    # A source without tokens has no weight; its documents run through once.
    weights = totals.select(
        "source",
        "source_tokens",
        F.lit(alpha).alias("exponent"),
        F.when(F.col("share") > 0, raised / z).otherwise(0.0).alias("weight"),
        # Rounded so that a source that is to run through once is not cut by the last digit.
        F.when(F.col("share") > 0, F.round(raised / z * budget / F.col("share"), 9))
        .otherwise(1.0)
        .alias("repeats"),
    ).withColumns(
        {
            "whole": F.floor("repeats").cast("int"),
            "cut_tokens": (F.col("repeats") - F.floor("repeats")) * F.col("source_tokens"),
        }
    )
    weights = stage(weights, "weights")
    in_order = Window.partitionBy("__source").orderBy("__bucket")
    placed = buckets.withColumn("upto", F.sum("tokens").over(in_order))
    placed = placed.join(weights, F.col("__source").eqNullSafe(F.col("source"))).withColumn(
        "before", F.col("upto") - F.col("tokens")
    )
    placed = stage(placed.drop("__source"), "placed")

    # One bucket of a source is cut inside: the documents of it alone are put in order.
    cut = placed.where("before < cut_tokens AND upto > cut_tokens").select(
        F.col("source").alias("cut_source"),
        F.col("__bucket").alias("cut_bucket"),
        (F.col("cut_tokens") - F.col("before")).alias("room"),
    )
    inside = dealt.select("__source", "__bucket", "__deal", "__tokens").join(
        cut,
        F.col("__source").eqNullSafe(F.col("cut_source"))
        & (F.col("__bucket") == F.col("cut_bucket")),
    )
    by_deal = inside.groupBy("cut_source", "cut_bucket", "room", "__deal").agg(
        F.sum("__tokens").alias("n")
    )
    running = Window.partitionBy("cut_source", "cut_bucket").orderBy("__deal")
    ends = (
        by_deal.withColumn("total", F.sum("n").over(running))
        .where("total <= room")
        .groupBy("cut_source", "cut_bucket")
        .agg(F.max("__deal").alias("end_deal"))
    )
    same = placed["source"].eqNullSafe(ends["cut_source"]) & (
        placed["__bucket"] == ends["cut_bucket"]
    )
    last = F.when(F.col("upto") <= F.col("cut_tokens"), F.lit((1 << 63) - 1)).otherwise(
        F.col("end_deal")
    )
    return stage(
        placed.join(ends, same, "left").select(
            "source",
            F.col("__bucket").alias("bucket"),
            "exponent",
            "weight",
            "repeats",
            "whole",
            F.when(F.col("cut_tokens") > 0, last).alias("last_deal"),
            (F.col("before") / F.greatest("source_tokens", F.lit(1))).alias("place"),
        ),
        "schedule",
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    max_repeats: float = MAX_REPEATS,
    target_entropy: float | None = None,
    budget_tokens: int | None = None,
    blocks: int = BLOCKS,
    seed: int = SEED,
) -> DataFrame:
    """The rows of ``docs`` as often as the mix has them, with how they are dealt.

    Adds mix_weight, mix_repeats, mix_epoch (from 0), mix_block (0 to ``blocks`` - 1) and
    mix_order (the order inside a block). Without ``budget_tokens`` the budget is the least at
    which no source loses a document. A null source is a source; a null text counts as empty;
    repeated rows are dealt alike. An empty table gives no rows.
    """
    dealt = _dealt(docs, id_col, source_col, text_col, seed)
    plan = schedule(dealt, max_repeats, target_entropy, budget_tokens)
    plan = plan.select([F.col(c).alias(f"__mix_{c}") for c in plan.columns])
    mixed = dealt.join(
        plan,
        F.col("__source").eqNullSafe(F.col("__mix_source"))
        & (F.col("__bucket") == F.col("__mix_bucket")),
    )
    partial = F.coalesce(F.col("__deal") <= F.col("__mix_last_deal"), F.lit(False)).cast("int")
    mixed = mixed.withColumn("__copies", F.col("__mix_whole") + partial).where("__copies > 0")
    mixed = mixed.withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1)))
    pace = (F.col("mix_epoch") + F.col("__mix_place")) / F.col("__mix_repeats")
    added = {
        "mix_weight": F.col("__mix_weight"),
        "mix_repeats": F.col("__mix_repeats"),
        "mix_epoch": F.col("mix_epoch"),
        "mix_block": F.least(F.floor(pace * blocks), F.lit(blocks - 1)).cast("int"),
        "mix_order": F.xxhash64(F.lit(seed), F.col("mix_epoch"), F.col(id_col)),
    }
    return mixed.select(
        *[mixed[c] for c in docs.columns], *[c.alias(n) for n, c in added.items()]
    )
