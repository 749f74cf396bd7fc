"""Orders inside groups: latest, best, sampled, interleaved, budgeted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import or_else
from gleaner.operators.facets import top_n_per_group
from gleaner.operators.prefix import attach, running_rank, running_total
from gleaner.operators.records import seeded_order


PART = 100_000      # numbers that one task ranks at most


def latest_attempt(attempts: DataFrame) -> DataFrame:
    """Last row per (arm, record) by (at, seq), as a partial aggregate rather than a sort."""
    rest = [c for c in attempts.columns if c not in ("arm", "record_id")]
    return (attempts.groupBy("arm", "record_id")
            .agg(F.max_by(F.struct(*rest), F.struct("at", "seq")).alias("_last"))
            .select("arm", "record_id", *[f"_last.{c}" for c in rest]))


def best_hit_per_record(hits: DataFrame) -> DataFrame:
    """Best-ranked hit of every (question, record)."""
    return top_n_per_group(hits, ["question_id", "record_id"], ["rank"], 1, "_rn").drop("_rn")


def strata_quotas(sizes: DataFrame, n: int) -> DataFrame:
    """sizes(genre, size) -> (genre, quota): the seeded sample's quota per stratum.

    Half-even share of n, at least 1, at most the stratum; while the quotas sum to
    more than n the largest stratum (ties: greatest name) gives one back. Taking one
    from the largest until the sum fits is a water-level cut: number the slots of each
    stratum, drop the surplus slots with the highest number. The slot table has at
    most n + (number of genres) rows.
    """
    total = sizes.agg(F.sum("size")).scalar()
    share = F.bround(F.lit(n) * F.col("size") / total, 0).cast("int")
    quota = F.least(F.greatest(F.lit(1), share), F.col("size").cast("int"))
    slots = sizes.select("genre", F.explode(F.sequence(F.lit(1), quota)).alias("slot"))
    picked = slots.orderBy("slot", "genre").limit(n)
    return picked.groupBy("genre").agg(F.count(F.lit(1)).alias("quota"))


def stratified_sample(records: DataFrame, n: int = 30, seed: int = 0) -> DataFrame:
    """(genre, id): seeded draw per genre. Same seed and corpus, same ids; never above n."""
    pool = records.select(or_else("genre", "other").alias("genre"), "id")
    sizes = pool.groupBy("genre").agg(F.count(F.lit(1)).alias("size"))
    quotas = strata_quotas(sizes, n)
    drawn = top_n_per_group(pool, ["genre"], [seeded_order("id", seed), "id"], n)
    return drawn.join(quotas, "genre").filter(F.col("rank") <= F.col("quota")).select("genre", "id")


def round_robin(examples: DataFrame, limit: int, group: str = "arm", order: str = "id") -> DataFrame:
    """One example of each group per round until `limit`; groups in the order they first appear."""
    ranked = top_n_per_group(examples, [group], [order], limit, "round")
    starts = examples.groupBy(group).agg(F.min(order).alias("_start"))
    return (ranked.join(starts, group)
            .orderBy("round", "_start", group).limit(limit).drop("_start"))


def unique_names(sources: DataFrame, block: list[str], taken: DataFrame | None = None) -> DataFrame:
    """sources(arrival, url, base) -> one row per url with a unique `name`.

    A repeated url keeps its first row. The first arrival of a base keeps it bare, later ones get
    -2, -3, …; names in the registry (`taken(name)`) or spelled out as another base are skipped.
    """
    once = top_n_per_group(sources, ["url"], ["arrival"], 1, "_rn").drop("_rn")
    ranked = running_rank(once, ["base"], block, ["arrival"], "nth")
    owned = once.select(F.col("base").alias("name"))
    bare = F.lit(False)
    if taken is not None:
        owned = owned.unionByName(taken.select("name"))
        ranked = ranked.join(taken.select(F.col("name").alias("base"), F.lit(True).alias("_bare")), "base", "left")
        bare = F.coalesce("_bare", F.lit(False))
    # With the owned suffixes k1 < k2 < … of a base, its m-th free suffix is m + the number of j for which kj - j < m.
    numbered = r"^(.*)-([1-9][0-9]*)\z"
    suffixes = (owned.filter(F.col("name").rlike(numbered))
                .select(F.regexp_extract("name", numbered, 1).alias("base"), F.regexp_extract("name", numbered, 2).cast("bigint").alias("k"))
                .filter("k >= 2").distinct().withColumn("_part", F.expr(f"k div {PART}")))
    below = running_rank(suffixes, ["base"], ["_part"], ["k"], "j").select(
        "base", (F.col("k") - F.col("j")).alias("at"), F.lit(1).alias("owned"), F.lit(None).cast("string").alias("url"))
    asked = ranked.withColumn("m", F.col("nth") + F.when(bare, 1).otherwise(0))
    wanted = asked.select("base", F.col("m").alias("at"), F.lit(0).alias("owned"), "url")
    both = wanted.unionByName(below).withColumn("_part", F.expr(f"at div {PART}"))
    passed = running_total(both, ["base"], ["_part"], ["at", "owned", "url"], F.col("owned"), "passed").filter("owned = 0")
    return (asked.join(passed.select("url", "passed"), "url")
            .withColumn("name", F.when((F.col("nth") == 1) & ~bare, F.col("base"))
                        .otherwise(F.concat(F.col("base"), F.lit("-"), (F.col("m") + F.col("passed")).cast("string"))))
            .drop("_bare", "m", "passed"))


def grouped_listing(listing: DataFrame, keys: list[Column]) -> DataFrame:
    """Rows by genre: biggest group first, uncategorized last, `keys` inside a group."""
    shown = listing.withColumn("section", or_else("genre", "uncategorized"))
    sized = attach(shown, shown.groupBy("section").agg(F.count(F.lit(1)).alias("section_size")), ["section"])
    return sized.orderBy((F.col("section") == "uncategorized").asc(), F.desc("section_size"), "section", *keys)


def budget_cutoff(rows: DataFrame, keys: list[str], block: list[str], order: list[str],
                  cost: str, budget) -> DataFrame:
    """Rows taken while what was spent before them is under budget; `spent` includes the row."""
    spent = running_total(rows, keys, block, order, F.col(cost), "spent")
    return spent.filter(F.col("spent") - F.col(cost) < budget)


def even_subsample(rows: DataFrame, keys: list[str], block: list[str], order: list[str], cap: int) -> DataFrame:
    """Groups above `cap` keep the indexes int(k·n/cap); smaller groups are whole.

    The wanted places are worked out from the sizes of the blocks; only blocks that hold one are sorted.
    """
    names = [*keys, *block]
    sizes = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*keys).orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0))).withColumn(
        "_size", F.sum("_n").over(Window.partitionBy(*keys)))
    step, end = F.col("_size") / F.lit(float(cap)), F.col("_before") + F.col("_n")
    turns = F.sequence(F.greatest(F.floor(F.col("_before") / step) - 1, F.lit(0)), F.least(F.ceil(end / step) + 1, F.lit(cap - 1)))
    spots = F.transform(F.filter(turns, lambda k: (k >= 0) & (k < cap)), lambda k: F.floor(k * step))
    wanted = F.when(F.col("_size") > cap, F.filter(spots, lambda i: (i >= F.col("_before")) & (i < end)))
    few = placed.select(*[F.col(n).alias(f"_w_{n}") for n in names], "_before", wanted.alias("_wanted")).filter(
        "_wanted IS NULL OR size(_wanted) > 0")
    same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"_w_{n}")) for n in names])
    kept = rows.join(few, same).drop(*[f"_w_{n}" for n in names])
    idx = F.row_number().over(Window.partitionBy(*names).orderBy(*order)) - 1 + F.col("_before")
    return kept.withColumn("idx", idx).filter("_wanted IS NULL OR array_contains(_wanted, idx)").drop("_before", "_wanted")
