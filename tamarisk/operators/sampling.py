"""Deterministic samples, splits and quotas. Order is by sha-256 where it stands for chance."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarisk.operators.graph import components
from tamarisk.plans.lineage import cut


def chance(key: str, seed: int | str) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)


def prefix_sums(frame: DataFrame, by: list[str], order: list[str], value: str | None = None) -> DataFrame:
    """``frame`` with ``_before`` (rows, or the sum of ``value``, ahead of a row in its group) and ``_total`` of the group.

    Rows are dealt by ranges of group and order, so a group of any size spans tasks; only sums a range and group are put
    in one order, and a window within a range has a range's rows.
    """
    v = F.lit(1).cast("long") if value is None else F.col(value)
    dealt = cut(frame.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()))
    sums = dealt.groupBy(*by, "_range").agg(F.sum(v).alias("_sum"))
    group = Window.partitionBy(*by)
    ahead = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], F.col("_range").alias("_r"), F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_base"), F.sum("_sum").over(group).alias("_total"))
    within = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = dealt.withColumn("_within", F.coalesce(F.sum(v).over(within), F.lit(0)))
    same = F.col("_range") == F.col("_r")
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return rows.join(sums, same).select(*frame.columns, (F.col("_base") + F.col("_within")).alias("_before"), "_total")


def hash_top(frame: DataFrame, key: str, n: int, seed: int | str) -> DataFrame:
    """The n rows whose seeded digest is least: a sampling operator, so its limit is the feature."""
    return frame.orderBy(chance(key, seed), key).limit(n)


def even_sample(frame: DataFrame, by: list[str], key: str, m: int) -> DataFrame:
    """Of each group of n > m rows in key order those at places floor(i (n - 1) / (m - 1)); smaller groups whole."""
    rows = prefix_sums(frame, by, [key])
    if m == 1:
        return rows.where("_before = 0").drop("_before", "_total")
    near = F.ceil(F.col("_before") * (m - 1) / (F.col("_total") - 1))
    chosen = (F.floor(near * (F.col("_total") - 1) / (m - 1)) == F.col("_before")) & (near <= m - 1)
    return rows.where((F.col("_total") <= m) | chosen).drop("_before", "_total")


def round_robin(frame: DataFrame, bucket: str, key: str, n: int, seed: int | str) -> DataFrame:
    """n rows, one of each bucket a round, buckets in order; ``round`` and ``place`` tell when."""
    order = Window.partitionBy(bucket).orderBy(chance(key, seed), key)
    rows = frame.withColumn("round", F.row_number().over(order)).where(F.col("round") <= n)
    picked = rows.orderBy("round", bucket).limit(n)
    return picked.withColumn("place", F.row_number().over(Window.orderBy("round", bucket)))


def quotas(frame: DataFrame, group: str, total: int) -> DataFrame:
    """``group, available, quota``: floor shares of ``total`` by availability, the rest by largest remainder then name."""
    sizes = frame.groupBy(group).agg(F.count("*").alias("available"))
    whole = Window.partitionBy()
    exact = F.lit(total) * F.col("available") / F.sum("available").over(whole)
    rows = sizes.withColumn("_e", exact).withColumn("_f", F.floor("_e"))
    rows = rows.withColumn("_left", F.lit(total) - F.sum("_f").over(whole))
    rank = F.row_number().over(Window.orderBy(F.desc(F.round(F.col("_e") - F.col("_f"), 9)), group))
    quota = F.least(F.col("_f") + (F.col("_rank") <= F.col("_left")).cast("long"), F.col("available"))
    return rows.withColumn("_rank", rank).select(group, "available", quota.alias("quota"))


def interleaved(frame: DataFrame, group: str, key: str) -> DataFrame:
    """Rows with ``share``: ordering by it and the group takes from each group in proportion to its size."""
    rows = prefix_sums(frame, [group], [key])
    return rows.select(*frame.columns, F.round(F.col("_before") / F.col("_total"), 9).alias("share"))


def hash_split(frame: DataFrame, category: str, key: str, share: float = 0.7) -> DataFrame:
    """``split`` dev or holdout: in each category the first max(1, min(n - 1, round(share n))) by digest are dev.

    Rounding is half to even. A category of one row is dev. Rows are counted by the digest's first letters; only those
    that share the last dev row's letters are ranked, so no category has to be put in one order.
    """
    rows = frame.withColumn("_h", F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 8)).withColumn("_p", F.substring("_h", 1, 3))
    counts = rows.groupBy(category, "_p").agg(F.count("*").alias("c"))
    whole = Window.partitionBy(category)
    n = F.sum("c").over(whole)
    last = F.greatest(F.lit(1), F.least(n - 1, F.bround(n * share).cast("long")))
    before = F.coalesce(F.sum("c").over(whole.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = counts.withColumn("last", last).withColumn("before", before).where("before < last and before + c >= last")
    edge = edge.select(F.col(category).alias("_c"), F.col("_p").alias("_edge"), (F.col("last") - F.col("before")).alias("_left"))
    rows = rows.join(edge, F.col(category).eqNullSafe(F.col("_c")))
    near = F.row_number().over(Window.partitionBy(category, "_p").orderBy("_h", key))
    ranked = rows.where("_p = _edge").withColumn("split", F.when(near <= F.col("_left"), "dev").otherwise("holdout"))
    others = rows.where("_p != _edge").withColumn("split", F.when(F.col("_p") < F.col("_edge"), "dev").otherwise("holdout"))
    return ranked.unionByName(others).select(*frame.columns, "split")


def length_bins(frame: DataFrame, column: str) -> DataFrame:
    """``bin`` short, medium or long by the nearest-rank terciles of a column."""
    cuts = frame.agg(F.expr(f"percentile_disc(1/3D) within group (order by {column})").alias("a"), F.expr(f"percentile_disc(2/3D) within group (order by {column})").alias("b"))
    return frame.crossJoin(F.broadcast(cuts)).withColumn("bin", F.when(F.col(column) <= F.col("a"), "short").when(F.col(column) <= F.col("b"), "medium").otherwise("long")).drop("a", "b")


#: Bits of the sets of sums that ``chosen_sizes`` may hold.
MOST_BITS = 1 << 33


def chosen_sizes(counts: dict[int, int], target: int) -> dict[int, int]:
    """How many of each size to take so that their sum is as near to ``target`` as any choice gets; of two as near, the lower.

    Sizes in ascending order add to every sum up to their total as long as each is at most one more than the total of those before it; what
    lies in such a run is taken greedily. Only sums of the greater sizes are searched, as a bitset that each size (by powers of two of its
    count) shifts onto itself; what each step reached first leads back to a choice. Memory goes with the number of those steps times the target.
    """
    run, sizes = 0, sorted(s for s, c in counts.items() if s > 0 and c > 0)
    small = []
    while sizes and sizes[0] <= run + 1:
        small.append(sizes.pop(0))
        run += small[-1] * counts[small[-1]]
    reach, steps = 1, []
    if target > run:
        limit = (1 << (2 * target + 1)) - 1
        for size in sizes:
            left, times = counts[size], 1
            while left > 0:
                times = min(times, left)
                new = (reach << (size * times)) & limit & ~reach
                steps.append((size, times, new))
                if len(steps) * 2 * target > MOST_BITS:
                    raise ValueError("too many sizes that nothing smaller adds up to")
                reach |= new
                left, times = left - times, times * 2
    below = (reach & ((1 << (target + 1)) - 1)).bit_length() - 1
    above = reach >> (target + 1)
    totals = [min(target, below + run)] + ([target + (above & -above).bit_length()] if above else [])
    best = min(totals, key=lambda t: (abs(t - target), t))
    great = below if best <= target else best
    rest, out = best - great, {}
    for size, times, new in reversed(steps):
        if new >> great & 1:
            out[size] = out.get(size, 0) + times
            great -= size * times
    for size in reversed(small):
        take = min(counts[size], rest // size)
        rest -= take * size
        if take:
            out[size] = take
    return out


def component_split(edges: DataFrame, share: float = 1 / 3) -> DataFrame:
    """``id, component, split``: whole components are ``test``, with as near to ``share`` of the vertices as components can add up to; the rest are ``train``.

    What is chosen from is the histogram of sizes, of which n vertices have at most about the root of 2 n; of one size the components
    of least digest are taken.
    """
    members = cut(components(edges))
    sizes = cut(members.groupBy("component").agg(F.count("*").alias("n")))
    histogram = {r["n"]: r["c"] for r in sizes.groupBy("n").agg(F.count("*").alias("c")).collect()}
    target = int(Decimal(sum(n * c for n, c in histogram.items()) * share).to_integral_value())
    chosen = list(chosen_sizes(histogram, target).items())
    take = F.broadcast(sizes.sparkSession.createDataFrame(chosen, "n long, take long"))
    placed = prefix_sums(sizes.withColumn("h", F.sha2(F.col("component").cast("string"), 256)), ["n"], ["h", "component"])
    test = placed.join(take, "n").where("_before < take").select("component", F.lit("test").alias("split"))
    return members.join(test, "component", "left").select("id", "component", F.coalesce("split", F.lit("train")).alias("split"))


def first_per_group(frame: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """All rows of the n least keys of each group; groups with fewer keys have ``short`` true.

    Keys are collapsed before they are ranked, so a group's rows don't meet in one task.
    """
    keys = prefix_sums(frame.select(group, key).distinct(), [group], [key])
    chosen = keys.where(F.col("_before") < n).select(F.col(group).alias("_g"), F.col(key).alias("_k"), (F.col("_total") < n).alias("short"))
    return frame.join(chosen, F.col(group).eqNullSafe(F.col("_g")) & F.col(key).eqNullSafe(F.col("_k"))).drop("_g", "_k")


def challenge(frame: DataFrame, key: str, variants: dict[str, Column], total: int, seed: int | str) -> DataFrame:
    """``phenomenon, key, query, place``: of each way of disturbing a text, its share of ``total`` rows to which it applies.

    Shares are equal, the first ways take the remainder; rows are chosen by seeded digest: a sampling operator.
    """
    least, extra = divmod(total, len(variants))
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(name).alias("phenomenon"), F.lit(least + (i < extra)).alias("quota"), query.alias("query")) for i, (name, query) in enumerate(variants.items())])
    rows = frame.select(F.col(key).alias("key"), F.explode(each).alias("v")).select("key", "v.*").where("query is not null")
    order = F.sha2(F.concat_ws(":", F.lit(str(seed)), "phenomenon", F.col("key").cast("string")), 256)
    places = prefix_sums(rows.withColumn("_h", order), ["i", "phenomenon"], ["_h", "key"])
    return places.where("_before < quota").select("phenomenon", "key", "query", F.col("_before").cast("int").alias("place"))


def draft_pool(opportunities: DataFrame, category: str, source: str, document: str, targets: dict[str, int]) -> DataFrame:
    """The opportunities that are drafted, with ``place`` from 1: of each category its target, sources in proportion, and no document twice.

    Categories that come first in ``targets`` go first; those it doesn't name draw nothing. In each round every category proposes the best of what it may still have, up to its target;
    a document holds on to the proposal of the first category and is closed to all later ones. It never falls back, so what it closes stays closed, and there are at most as many rounds as categories.
    Of several opportunities of a document in a category one counts (the least of all its columns). A category with too few documents draws what there is.
    """
    rank = F.create_map(*[F.lit(x) for i, name in enumerate(targets) for x in (name, i)])[F.col(category)]
    wanted = F.create_map(*[F.lit(x) for name, n in targets.items() for x in (name, n)])[F.col(category)]
    one = opportunities.where(F.col(category).isin(*targets)).groupBy(category, document).agg(F.min(F.struct(source, *[c for c in opportunities.columns if c not in (category, document, source)])).alias("_o"))
    rows = one.select(category, document, "_o.*").withColumn("_group", F.concat_ws("\x1f", category, source))
    shared = interleaved(rows, "_group", document).drop("_group")
    left = cut(shared.withColumn("_first", rank).withColumn("_wanted", wanted))
    order = Window.partitionBy(category).orderBy("share", source, document)
    for _ in targets:
        proposed = cut(left.withColumn("place", F.row_number().over(order)).where(F.col("place") <= max(targets.values())).where("place <= _wanted"))
        held = proposed.groupBy(F.col(document).alias("_d")).agg(F.min("_first").alias("_by"))
        closed = left.join(held, F.col(document).eqNullSafe(F.col("_d"))).where("_first > _by").select(F.col(category).alias("_c"), "_d")
        if closed.isEmpty():
            break
        left = cut(left.join(closed, (F.col(category) == F.col("_c")) & F.col(document).eqNullSafe(F.col("_d")), "left_anti"))
    else:
        proposed = left.withColumn("place", F.row_number().over(order)).where(F.col("place") <= max(targets.values())).where("place <= _wanted")
    return proposed.select(*opportunities.columns, "place")
