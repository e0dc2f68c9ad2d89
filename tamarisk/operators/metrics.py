"""Measures of rankings against graded judgements, and paired statistics.

Rankings are ``query_id, doc_id, rank``; judgements ``query_id, doc_id, grade``, at most one a pair (the greatest counts).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tamarisk.operators.sampling import prefix_sums


def judged(rankings: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """One row a judged query: its hits within k and its ideal, as sums. A query without ranking has none."""
    key = ["query_id", "doc_id"]
    best = qrels.groupBy(*key).agg(F.max("grade").alias("grade")).where("grade > 0")
    hits = _hits(rankings.where(F.col("rank") <= k).join(best, key))
    asked = qrels.select("query_id").distinct()
    return asked.join(_ideals(best, "query_id", k), "query_id", "left").join(hits, "query_id", "left").fillna(0)


def _gain() -> Column:
    return F.pow(F.lit(2.0), F.col("grade")) - 1


def _ideals(best: DataFrame, by: str, k: int) -> DataFrame:
    """``by, relevant, idcg, binary_idcg``: only how many have each grade counts, so no list of a query's documents is put in order."""
    counts = best.groupBy(by, "grade").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(by).orderBy(F.desc("grade")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counts = counts.withColumn("last", F.least(upto, F.lit(k))).withColumn("before", upto - F.col("n"))
    shares = F.aggregate(F.sequence(F.col("before") + 1, F.col("last")), F.lit(0.0), lambda a, place: a + 1 / F.log2(place + 1.0))
    counts = counts.withColumn("shares", F.when(F.col("before") < F.col("last"), shares).otherwise(0.0))
    return counts.groupBy(by).agg(F.sum("n").alias("relevant"), F.sum(_gain() * F.col("shares")).alias("idcg"), F.sum("shares").alias("binary_idcg"))


def _hits(found: DataFrame) -> DataFrame:
    return found.groupBy("query_id").agg(
        F.count("*").alias("hits"), F.min("rank").alias("first"),
        F.sum(_gain() / F.log2(F.col("rank") + 1.0)).alias("dcg"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("binary_dcg"),
    )


def judged_by_group(rankings: DataFrame, asked: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """``judged`` where all documents of a query's group are its judgements: ``asked`` has ``query_id, group``, ``members`` ``group, doc_id, grade``.

    Pairs of queries and documents aren't listed: ideals are a group's, and only ranked documents are looked up. Queries whose group has no member have no row.
    """
    best = members.where("group is not null").groupBy("group", "doc_id").agg(F.max("grade").alias("grade"))
    norm = _ideals(best.where("grade > 0"), "group", k)
    known = asked.join(best.select("group").distinct(), "group").distinct()
    hits = _hits(rankings.where(F.col("rank") <= k).join(known, "query_id").join(best.where("grade > 0"), ["group", "doc_id"]))
    return known.join(norm, "group", "left").join(hits, "query_id", "left").drop("group").fillna(0)


def query_metrics(rankings: DataFrame, qrels: DataFrame, k: int = 10, digits: int = 8) -> DataFrame:
    """``query_id, recall, precision, mrr, ndcg, binary_ndcg`` at k; zeros where nothing is relevant or retrieved."""
    return measures(judged(rankings, qrels, k), k, digits)


def measures(sums: DataFrame, k: int = 10, digits: int = 8) -> DataFrame:
    """The measures of ``judged`` sums."""
    safe = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), digits)).otherwise(0.0)
    return sums.select(
        "query_id", safe("hits", "relevant").alias("recall"), F.round(F.col("hits") / k, digits).alias("precision"),
        F.when(F.col("first") > 0, F.round(1 / F.col("first"), digits)).otherwise(0.0).alias("mrr"),
        safe("dcg", "idcg").alias("ndcg"), safe("binary_dcg", "binary_idcg").alias("binary_ndcg"),
    )


def complete_evidence(rankings: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """``query_id, complete``: 1 if each of a query's groups (``query_id, group_id, doc_id``) has a hit within k."""
    found = rankings.where(F.col("rank") <= k).select("query_id", "doc_id", F.lit(1).alias("hit"))
    each = groups.join(found, ["query_id", "doc_id"], "left").groupBy("query_id", "group_id").agg(F.coalesce(F.max("hit"), F.lit(0)).alias("hit"))
    return each.groupBy("query_id").agg(F.min("hit").alias("complete"))


def complete_by_group(rankings: DataFrame, asked: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """``complete_evidence`` where a query (``query_id, group``) needs a hit in each part of its group (``group, group_id, doc_id``), without listing pairs."""
    parts = members.where("group is not null").groupBy("group").agg(F.count_distinct("group_id").alias("parts"))
    found = rankings.where(F.col("rank") <= k).join(asked, "query_id").join(members, ["group", "doc_id"])
    found = found.groupBy("query_id").agg(F.count_distinct("group_id").alias("found"))
    return asked.join(parts, "group").join(found, "query_id", "left").select("query_id", (F.coalesce("found", F.lit(0)) == F.col("parts")).cast("int").alias("complete"))


def slice_means(rows: DataFrame, dimensions: list[str], value: str, digits: int = 8) -> DataFrame:
    """``dimension, label, n, mean`` of each dimension by itself, in one pass of grouping sets."""
    sets = [[d] for d in dimensions]
    out = rows.groupingSets([[F.col(d) for d in s] for s in sets], *[F.col(d) for d in dimensions]).agg(
        F.count("*").alias("n"), F.round(F.avg(value), digits).alias("mean"), *[F.grouping(d).alias(f"g_{d}") for d in dimensions]
    )
    name = F.coalesce(*[F.when(F.col(f"g_{d}") == 0, F.lit(d)) for d in dimensions])
    label = F.coalesce(*[F.when(F.col(f"g_{d}") == 0, F.col(d).cast("string")) for d in dimensions])
    return out.select(name.alias("dimension"), label.alias("label"), "n", "mean")


def wins_ties_losses(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """One row: wins, ties, losses of left over right, the mean difference and the rank-biserial (wins - losses) / n."""
    wins, losses = F.count_if(F.col(left) > F.col(right)), F.count_if(F.col(left) < F.col(right))
    return pairs.agg(
        wins.alias("wins"), F.count_if(F.col(left) == F.col(right)).alias("ties"), losses.alias("losses"),
        F.round(F.avg(F.col(left) - F.col(right)), 8).alias("delta"), F.round((wins - losses) / F.count("*"), 8).alias("rank_biserial"),
    )


def cohens_kappa(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """One row: n, observed, expected and unweighted kappa (1 or 0 where chance alone agrees always)."""
    cells = pairs.where(f"{left} is not null and {right} is not null").groupBy(left, right).agg(F.count("*").alias("c"))
    n = cells.agg(F.sum("c").alias("n"), F.coalesce(F.sum(F.when(F.col(left) == F.col(right), F.col("c"))), F.lit(0)).alias("same"))
    a = cells.groupBy(F.col(left).alias("v")).agg(F.sum("c").alias("a"))
    b = cells.groupBy(F.col(right).alias("v")).agg(F.sum("c").alias("b"))
    chance = a.join(b, "v").agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("ab"))
    po, pe = F.col("same") / F.col("n"), F.col("ab") / (F.col("n") * F.col("n"))
    kappa = F.when(pe == 1, F.when(po == 1, 1.0).otherwise(0.0)).otherwise((po - pe) / (1 - pe))
    return n.crossJoin(chance).select("n", F.round(po, 8).alias("observed"), F.round(pe, 8).alias("expected"), F.round(kappa, 8).alias("kappa"))


def risk_difference(pairs: DataFrame, before: str, after: str) -> DataFrame:
    """One row for two binary columns: rates, after - before, and how many changed each way."""
    rate = lambda c: F.avg(F.col(c).cast("double"))
    return pairs.agg(
        F.count("*").alias("n"), F.round(rate(before), 8).alias("before_rate"), F.round(rate(after), 8).alias("after_rate"),
        F.round(rate(after) - rate(before), 8).alias("difference"),
        F.count_if((F.col(before) == 1) & (F.col(after) == 0)).alias("only_before"), F.count_if((F.col(before) == 0) & (F.col(after) == 1)).alias("only_after"),
    )


RULES = ("ceil", "floor", "linear")
#: Resampling weights are Poisson of mean 1: how often a number is below these is the chance of 0, of at most 1, and so on.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(18)])
#: Rows whose weights a task holds at a time.
WEIGHT_ROWS = 256


def poisson_weights(rows: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """Of each row's 64-bit hash and each replicate how often it is drawn: the same wherever and whenever it is worked out."""
    with np.errstate(over="ignore"):
        each = (np.arange(1, replicates + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1_000_003)) * np.uint64(0x9E3779B97F4A7C15)
        x = rows.astype(np.uint64)[:, None] ^ each[None, :]
        for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(odd)
        x ^= x >> np.uint64(31)
    return np.searchsorted(_POISSON, (x >> np.uint64(11)) * 2.0**-53, side="right")


def bootstrap(pairs: DataFrame, group: str, left: str, right: str, rule: str = "ceil", replicates: int = 2000, confidence: float = 0.95, seed: int = 17, key: str | None = None) -> DataFrame:
    """``group, n, delta, low, high``: percentile intervals of the mean paired difference of each group.

    A replicate takes each pair as often as a Poisson number of mean 1 says, made of a hash of its ``key`` (or of all its columns), so sums of weights and of weighted
    differences merge over tasks: no group meets in one, whatever its size, and what is shuffled is a sum a task, group and replicate. Its interval is
    that of drawing n pairs with replacement up to a share of about 1/n of its width and the noise of the replicates. Replicates that take no pair are left out; pairs with a null on
    either side don't count. Equal keys are drawn together, so give one that tells pairs apart.

    Rules of the interval's ends among the R sorted means: ``ceil`` takes places ceil(a R) - 1 and ceil((1 - a) R) - 1,
    ``floor`` int(a (R - 1)) and int((1 - a) (R - 1)), ``linear`` interpolates.
    """
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule!r}")
    value = F.col(left).cast("double") - F.col(right).cast("double")
    rows = pairs.select(F.col(group).alias("g"), value.alias("d"), F.xxhash64(*([key] if key else pairs.columns)).alias("h")).where("d is not null")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[Any, np.ndarray] = {}
        for batch in batches:
            groups, d, h = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            names = {g: i for i, g in enumerate(dict.fromkeys(groups))}
            of = np.array([names[g] for g in groups])
            for g, i in names.items():
                own = np.flatnonzero(of == i)
                total = sums.setdefault(g, np.zeros((2, replicates)))
                for a in range(0, len(own), WEIGHT_ROWS):
                    some = own[a : a + WEIGHT_ROWS]
                    w = poisson_weights(h[some], replicates, seed)
                    total += w.sum(0), d[some] @ w
            if len(sums) > 256:
                yield from flushed(sums)
        yield from flushed(sums)

    def flushed(sums: dict[Any, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for g, total in sums.items():
            columns = [pa.array([g] * replicates, kind), pa.array(np.arange(replicates)), pa.array(total[0]), pa.array(total[1])]
            yield pa.RecordBatch.from_arrays(columns, ["g", "r", "w", "s"])
        sums.clear()

    spec, kind = pairs.schema[group].dataType, to_arrow_type(pairs.schema[group].dataType)
    schema = StructType([StructField("g", spec), StructField("r", LongType()), StructField("w", DoubleType()), StructField("s", DoubleType())])
    means = rows.mapInArrow(run, schema).groupBy("g", "r").agg(F.sum("w").alias("w"), F.sum("s").alias("s")).where("w > 0")
    means = means.groupBy("g").agg(F.sort_array(F.collect_list(F.col("s") / F.col("w"))).alias("m"))
    size, tail = F.size("m"), (1 - confidence) / 2
    at = lambda place: F.get("m", F.greatest(place, F.lit(0)).cast("int"))
    if rule == "ceil":
        low, high = at(F.ceil(size * tail) - 1), at(F.ceil(size * (1 - tail)) - 1)
    elif rule == "floor":
        low, high = at(F.floor((size - 1) * tail)), at(F.floor((size - 1) * (1 - tail)))
    else:
        def between(p: float) -> Column:
            place = (size - 1) * p
            return at(F.floor(place)) + (at(F.ceil(place)) - at(F.floor(place))) * (place - F.floor(place))

        low, high = between(tail), between(1 - tail)
    ends = means.select(F.col("g").alias("_g"), low.alias("low"), high.alias("high"))
    figures = rows.groupBy("g").agg(F.count("*").alias("n"), F.avg("d").alias("delta"))
    return figures.join(ends, F.col("g").eqNullSafe(F.col("_g"))).select(F.col("g").alias(group), "n", "delta", "low", "high")


def percentile_nearest(column: str, p: float) -> Column:
    """sorted[ceil(p n) - 1]."""
    return F.expr(f"percentile_disc({p}) within group (order by `{column}`)")


def percentile_floor(frame: DataFrame, by: list[str], column: str, ps: dict[str, float], place: Callable[[Column, float], Column]) -> DataFrame:
    """Percentiles by place in the sorted values: ``place(n, p)`` gives it, from 0. Values are ranked by ranges, not collected."""
    rows = prefix_sums(frame.where(F.col(column).isNotNull()).select(*by, column), by, [column])
    return rows.groupBy(*by).agg(*[F.max(F.when(F.col("_before") == place(F.col("_total"), p), F.col(column))).alias(name) for name, p in ps.items()])


def word_errors(pairs: DataFrame, reference: str, candidate: str) -> DataFrame:
    """``cer`` and ``wer``: edit distances over characters and over words, each by the reference's length (1 at least)."""
    @F.pandas_udf("long")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            p, q = (x or "").split(), (y or "").split()
            ids = {w: i for i, w in enumerate(dict.fromkeys(p + q))}
            q_ids = np.array([ids[w] for w in q], np.int64)
            row, steps = np.arange(len(q) + 1), np.arange(len(q) + 1)
            for i, w in enumerate(p, 1):
                new = np.empty_like(row)
                new[0] = i
                new[1:] = np.minimum(row[1:] + 1, row[:-1] + (q_ids != ids[w]))
                row = np.minimum.accumulate(new - steps) + steps
            out.append(int(row[-1]))
        return pd.Series(out, dtype="int64")

    n_words = F.size(F.filter(F.split(F.coalesce(reference, F.lit("")), r"\s+"), lambda w: w != ""))
    return pairs.select(
        "*", F.round(F.levenshtein(reference, candidate) / F.greatest(F.lit(1), F.length(reference)), 8).alias("cer"),
        F.round(distance(reference, candidate) / F.greatest(F.lit(1), n_words), 8).alias("wer"),
    )


def span_scores(gold: DataFrame, predicted: DataFrame, key: list[str]) -> DataFrame:
    """One row: true and false positives and negatives of two sets of spans, precision, recall and F1 (0 where empty)."""
    g = gold.select(*key).distinct().withColumn("g", F.lit(True))
    p = predicted.select(*key).distinct().withColumn("p", F.lit(True))
    both = g.join(p, key, "full_outer").agg(
        F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn")
    )
    safe = lambda a, b: F.when(b > 0, F.round(a / b, 8)).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return both.select("*", safe(tp, tp + fp).alias("precision"), safe(tp, tp + fn).alias("recall"), safe(2 * tp, 2 * tp + fp + fn).alias("f1"))
