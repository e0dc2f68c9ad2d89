"""A lexical index that is built once and asked often: stored postings by term and segment, read with skipping.

A build tokenises the corpus once. Documents are numbered in order of length, so those of a segment (``SEGMENT`` numbers in a row) weigh a term
alike; a block holds one term's postings in one segment with each posting's BM25 weight and the greatest of them. Blocks are dealt by a hash of
the term and by zones of numbers, so the postings of a term that every document has span tasks, and lie in folders by that hash, of which a
search reads those of its terms.

A search has one way for all sizes. The blocks of its terms meet by groups of segments; the sums of their greatest weights bound what a query can find in a
segment. The most promising segment of each group is scored first, and the k-th best score of each query over all groups is its floor. Of the other segments only those whose
bound reaches the floor are looked into, heavy terms first (light ones have greatest weights that together are less than a share of the floor); what a
document has from those and the light blocks' greatest weights besides leaves few candidates, and light blocks are read only in their segments. So no
document that can be among the k best is left out. Queries are asked in sets of ``MOST_QUERIES`` and ``MOST_TERMS`` terms at most, which is what a task and the driver hold.

Each row of a corpus is a document, with identifiers of any type; a null identifier comes first among equal scores. Null texts have no tokens and count among the documents. Rows of
one ``query_id`` are one query; those without one are left out. A query without a known token has no row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamarisk.functions import text as T
from tamarisk.plans.lineage import cut, rewritten

DIGITS = 8
BITS = 5
SEGMENT = 1 << BITS
#: Segments of a group, as a power of two.
GROUP_BITS = 4
#: Documents of a zone, as a power of two: a term's postings of more than one zone meet nowhere.
ZONE_BITS = 20
#: Tokens for each folder of blocks, and the most folders.
PER_BUCKET, MOST_BUCKETS = 20_000_000, 512
#: Shares of the floor that part heavy terms from light ones.
SHARES = (1.0, 0.8, 0.6, 0.4, 0.2, 0.0)
#: Queries and terms that are asked together, and scores that a task holds at a time.
MOST_QUERIES, MOST_TERMS, SCORES = 2_000, 200_000, 2_000_000
#: Below the last place of a score, and above what sums of doubles differ by.
MARGIN = 1e-7
#: Stands for no token: its blocks hold the documents' numbers of distinct tokens.
SIZES = ""
#: The term whose blocks hold the documents that may be returned.
ALLOWED = -2


@dataclass(frozen=True)
class Index:
    """``documents`` (``number, doc_id, length, distinct, toks``), ``terms`` (``bucket, token, df, most``), ``blocks``
    (``bucket, token, segment, most, postings``) and figures of the corpus."""

    path: str
    documents: DataFrame
    terms: DataFrame
    blocks: DataFrame
    count: int
    buckets: int


def build(corpus: DataFrame, path: str, k1: float = 1.2, b: float = 0.75, tokenize=T.tokens) -> Index:
    """The index of ``doc_id, text``, written to ``path``."""
    if not (k1 > 0 and 0 <= b <= 1):
        raise ValueError("k1 must be positive and b between 0 and 1")
    spark = corpus.sparkSession
    dealt = corpus.select("doc_id", "text", F.coalesce(F.length("text"), F.lit(0)).alias("_size"))
    dealt = dealt.repartitionByRange("_size", "doc_id").sortWithinPartitions("_size", "doc_id")
    rows = dealt.select(F.monotonically_increasing_id().alias("number"), "doc_id", tokenize(F.col("text")).alias("toks"))
    rows = rows.select("number", "doc_id", T.once(F.greatest(F.size("toks"), F.lit(0))).alias("length"), T.once(F.greatest(F.size(F.array_distinct("toks")), F.lit(0))).alias("distinct"), "toks")
    rows.write.parquet(f"{path}/documents")
    documents = spark.read.parquet(f"{path}/documents")
    figures = documents.agg(F.count("*").alias("n"), F.sum("length").alias("tokens")).first()
    average = max((figures["tokens"] or 0) / max(figures["n"], 1), 1.0)
    buckets = max(8, min(MOST_BUCKETS, (figures["tokens"] or 0) // PER_BUCKET))
    each = documents.select("number", "length", F.explode("toks").alias("token")).groupBy("number", "token").agg(F.count("*").alias("tf"), F.first("length").alias("length"))
    each = each.select("number", "token", (F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / average))).alias("weight"))
    each = each.unionByName(documents.select("number", F.lit(SIZES).alias("token"), F.col("distinct").cast("double").alias("weight")))
    each = each.select(_bucket(buckets).alias("bucket"), F.shiftright("number", ZONE_BITS).alias("zone"), F.shiftright("number", BITS).alias("segment"), "token",
                       F.struct(F.col("number").bitwiseAND(SEGMENT - 1).cast("byte").alias("place"), "weight").alias("p"))
    dealt = each.repartition("bucket", "zone")
    blocks = dealt.groupBy("bucket", "zone", "token", "segment").agg(F.max("p.weight").alias("most"), F.collect_list("p").alias("postings"))
    blocks.drop("zone").sortWithinPartitions("bucket", "token", "segment").write.partitionBy("bucket").parquet(f"{path}/blocks")
    _blocks(spark, path).where(F.col("token") != SIZES).groupBy("bucket", "token").agg(F.sum(F.size("postings")).alias("df"), F.max("most").alias("most")).write.parquet(f"{path}/terms")
    spark.createDataFrame([(figures["n"], buckets)], "count long, buckets int").coalesce(1).write.parquet(f"{path}/figures")
    return opened(spark, path)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int")


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("token string, segment long, most double, postings array<struct<place:byte,weight:double>>, bucket int").parquet(f"{path}/blocks")


def opened(spark: SparkSession, path: str) -> Index:
    figures = spark.read.parquet(f"{path}/figures").first()
    return Index(path, spark.read.parquet(f"{path}/documents"), spark.read.parquet(f"{path}/terms"), _blocks(spark, path), figures["count"], figures["buckets"])


@dataclass(frozen=True)
class Asked:
    """The known terms of some queries: of each term its number, queries, their factors and ``lighter`` (what the query's lighter terms and it weigh at
    most); of each query its number of distinct tokens, known or not."""

    queries: list
    tokens: list[str]
    folders: list[int]
    ends: np.ndarray
    which: np.ndarray
    factors: np.ndarray
    lighter: np.ndarray
    sizes: np.ndarray


def _sets(index: Index, queries: DataFrame, tokenize, factor: Column, cap: Column) -> list[Asked]:
    """The queries in sets of bounded size; ``factor`` is of ``qtf`` and ``df``, ``cap`` what a posting counts at most."""
    rows = queries.where("query_id is not null").select("query_id", F.explode(tokenize(F.col("text"))).alias("token"))
    rows = cut(rows.groupBy("query_id", "token").agg(F.count("*").alias("qtf")))
    n, asked = rows.agg(F.count("*"), F.count_distinct("query_id")).first()
    # sets are dealt by hash; half of what fits leaves room for uneven ones
    parts = 1 if n <= MOST_TERMS and asked <= MOST_QUERIES else max(-(-2 * n // MOST_TERMS), -(-2 * asked // MOST_QUERIES))
    rows = rows.withColumn("nq", F.count("*").over(Window.partitionBy("query_id"))).withColumn("bucket", _bucket(index.buckets))
    found = (F.broadcast(rows) if n <= MOST_TERMS else rows).join(index.terms, ["bucket", "token"])
    lighter = Window.partitionBy("query_id").orderBy("cap", F.desc("df"), "token").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = found.withColumn("factor", factor).withColumn("cap", F.col("factor") * cap).withColumn("lighter", F.sum("cap").over(lighter))
    found = found.select("query_id", "token", "bucket", "nq", "factor", "lighter", F.pmod(F.xxhash64("query_id"), F.lit(parts)).alias("part"))
    found = cut(found) if parts > 1 else found
    return [a for a in (_asked(found.where(F.col("part") == i).collect(), index) for i in range(parts)) if a.queries]


def _asked(rows: list, index: Index) -> Asked:
    size = {r["query_id"]: r["nq"] for r in rows}
    place = {q: i for i, q in enumerate(sorted(size))}
    of = {t: i for i, t in enumerate(sorted({r["token"] for r in rows}))}
    terms = sorted((of[r["token"]], place[r["query_id"]], r["factor"], r["lighter"]) for r in rows)
    number, which, factors, lighter = (np.array(x) for x in zip(*terms)) if terms else (np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0))
    ends = np.searchsorted(number, np.arange(len(of) + 1))
    return Asked(list(place), list(of), sorted({r["bucket"] for r in rows}), ends, which, factors.astype(float), lighter, np.array([size[q] for q in place], float))


def _hits(index: Index, asked: Asked, sizes: bool) -> DataFrame:
    """``segment, term, most, postings`` of the asked terms' blocks, and with ``sizes`` the blocks of sizes as term -1."""
    spark = index.blocks.sparkSession
    rows = [(t, i) for i, t in enumerate(asked.tokens)] + [(SIZES, -1)] * sizes
    numbers = F.broadcast(spark.createDataFrame(rows, "token string, term int"))
    folders = F.col("bucket").isin(asked.folders)
    return index.blocks.where((folders | (F.col("token") == SIZES)) if sizes else folders).join(numbers, "token").select("segment", "term", "most", "postings")


@dataclass(frozen=True)
class Measure:
    """Scores from sums: ``finish(sums, documents' sizes, queries' sizes)``, never less for a greater sum, and ``need(floors, queries' sizes)``, the least sum
    that can score a floor. With ``flat`` a posting counts as 1, and sums are at most a document's size."""

    flat: bool
    finish: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
    need: Callable[[np.ndarray, np.ndarray], np.ndarray]


def _best(blocks: DataFrame, asked: Asked, k: int, floors: np.ndarray | None, measure: Measure, read=None, masked: bool = False) -> DataFrame:
    """``query, number, score`` of each task's k best documents of every query, by its place in ``asked``: of the most promising segment of each group where
    there are no floors yet, or else of the others. ``read`` counts the blocks scored for a query. With ``masked`` only documents in blocks of the term
    ``ALLOWED`` are found, and segments without one are passed over.
    """
    flat = measure.flat
    width = len(asked.queries)
    at_once = max(1, SCORES // max(1, width * SEGMENT << GROUP_BITS))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = np.full(width, -np.inf) if floors is None else floors.copy()
        kept = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]

        def compact() -> None:
            order = np.lexsort((kept[1], -kept[2], kept[0]))
            q, d, s = (x[order] for x in kept)
            place = np.arange(len(q)) - np.searchsorted(q, q)
            # those that equal the k-th best stay: identifiers decide
            kth = np.full(width, -np.inf)
            kth[q[place == k - 1]] = s[place == k - 1]
            np.maximum(floor, kth - MARGIN, out=floor)
            stay = (place < k) | (s >= kth[q])
            kept[:] = q[stay], d[stay], s[stay]

        def take(rows: pa.Table) -> None:
            segments, terms, most = (rows.column(i).to_numpy() for i in range(3))
            lists = rows.column(3).combine_chunks()
            size = np.diff(lists.offsets.to_numpy())
            places, weights = lists.flatten().field(0).to_numpy().astype(np.int64), lists.flatten().field(1).to_numpy()
            starts = np.cumsum(size) - size
            ids, at = np.unique(segments, return_inverse=True)
            extent, extra = np.zeros((2, len(ids))), np.zeros(len(ids) * SEGMENT)
            mask = np.full(len(ids) * SEGMENT, not masked)
            for b in np.flatnonzero(terms == ALLOWED):
                mask[at[b] * SEGMENT + places[starts[b] : starts[b] + size[b]]] = True
            some = mask.reshape(-1, SEGMENT).any(1)
            for b in np.flatnonzero(terms == -1):
                own = weights[starts[b] : starts[b] + size[b]]
                extent[:, at[b]] = own.min(), own.max()
                extra[at[b] * SEGMENT + places[starts[b] : starts[b] + size[b]]] = own
            real = np.flatnonzero((terms >= 0) & some[at])
            count = asked.ends[terms[real] + 1] - asked.ends[terms[real]]
            block = np.repeat(real, count)
            entry = np.arange(len(block)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(asked.ends[terms[real]], count)
            query, factor, lighter = asked.which[entry], asked.factors[entry], asked.lighter[entry]
            cell = at[block] * width + query
            most_of = factor * (1.0 if flat else most[block])
            shape = (len(ids), width)
            total = lambda pairs: np.bincount(cell[pairs], most_of[pairs], len(ids) * width).reshape(shape)

            def sums_of(pairs: np.ndarray) -> np.ndarray:
                if read is not None:
                    read.add(len(pairs))
                n = size[block[pairs]]
                each = np.repeat(pairs, n)
                p = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[block[pairs]], n)
                doc = at[block[each]] * SEGMENT + places[p]
                return np.bincount(doc * width + query[each], factor[each] * (1.0 if flat else weights[p]), len(ids) * SEGMENT * width).reshape(-1, width)

            def could_be(sums: np.ndarray, rest: np.ndarray) -> np.ndarray:
                """The scores of documents if all that wasn't read were in them."""
                best = (sums.reshape(len(ids), SEGMENT, width) + rest[:, None, :]).reshape(-1, width)
                return measure.finish(np.minimum(best, extra[:, None]) if flat else best, extra, asked.sizes)

            def put(scores: np.ndarray, which: np.ndarray) -> None:
                d, q = np.nonzero(which)
                kept[:] = (np.concatenate(x) for x in zip(kept, (q, ids[d // SEGMENT] * SEGMENT + d % SEGMENT, scores[d, q])))
                compact()

            every = np.arange(len(block))
            top = total(every)
            at_most = np.minimum(top, extent[1][:, None]) if flat else top
            limit = np.where(top > 0, measure.finish(at_most, np.maximum(extent[0], at_most.min(1)) if flat else extent[0], asked.sizes), -np.inf)
            group = ids >> GROUP_BITS
            begins = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            early = (limit > -np.inf) & (limit >= np.repeat(np.maximum.reduceat(limit, begins), np.diff(begins, append=len(ids)), axis=0))
            if floors is None:
                sums = sums_of(every[early.ravel()[cell]])
                scores = np.round(measure.finish(sums, extra, asked.sizes), DIGITS)
                put(scores, (sums > 0) & (scores >= floor) & mask[:, None])
                return
            late = (limit >= floor) & (limit > -np.inf) & ~early
            pairs = every[late.ravel()[cell]]
            open_ = np.repeat(late, SEGMENT, axis=0) & mask[:, None]
            sums, need = np.zeros((len(ids) * SEGMENT, width)), measure.need(np.maximum(floor, 0.0), asked.sizes)
            for share in SHARES:
                now = lighter[pairs] >= share * need[query[pairs]]
                sums += sums_of(pairs[now])
                pairs = pairs[~now]
                scores = could_be(sums, total(pairs))
                open_ &= scores >= floor
                pairs = pairs[open_.reshape(len(ids), SEGMENT, width).any(1).ravel()[cell[pairs]]]
            put(np.round(scores, DIGITS), open_ & (sums > 0))

        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            seen = held.column(0).to_numpy() >> GROUP_BITS
            new = np.flatnonzero(seen[1:] != seen[:-1]) + 1
            while len(new) >= at_once:
                take(held.slice(0, new[at_once - 1]))
                held, new = held.slice(new[at_once - 1]), new[at_once:] - new[at_once - 1]
        if held is not None and held.num_rows:
            take(held)
        yield pa.RecordBatch.from_arrays([pa.array(kept[0].astype(np.int32)), pa.array(kept[1]), pa.array(kept[2])], ["query", "number", "score"])

    dealt = blocks.repartition(F.shiftright("segment", GROUP_BITS)).sortWithinPartitions("segment", "term")
    return dealt.mapInArrow(run, "query int, number long, score double")


def _floors(best: DataFrame, k: int, width: int) -> np.ndarray:
    """The k-th best score of each query, less a margin; nothing where it has fewer."""
    order = Window.partitionBy("query").orderBy(F.desc("score"))
    out = np.full(width, -np.inf)
    for r in best.withColumn("n", F.row_number().over(order)).where(F.col("n") == k).collect():
        out[r["query"]] = r["score"] - MARGIN
    return out


def _named(index: Index, best: DataFrame, asked: Asked, k: int, kind: str) -> DataFrame:
    """``query_id, doc_id, score, rank`` of the k best."""
    spark = best.sparkSession
    # of each task's best only those that equal the k-th or better: a few rows a query
    kth = Window.partitionBy("query").orderBy(F.desc("score"))
    best = best.withColumn("r", F.rank().over(kth)).where(F.col("r") <= k)
    names = F.broadcast(spark.createDataFrame(list(enumerate(asked.queries)), f"query int, query_id {kind}"))
    rows = best.join(index.documents.select("number", "doc_id"), "number").join(names, "query")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc_id"), "number")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "doc_id", "score", "rank")


def _search(index: Index, queries: DataFrame, k: int, tokenize, factor: Column, measure: Measure, eligible: DataFrame | None, counts: dict | None) -> DataFrame:
    if k < 1:
        raise ValueError("k must be positive")
    spark, kind, out = index.blocks.sparkSession, queries.schema["query_id"].dataType.simpleString(), []
    allowed = None
    if eligible is not None:
        wanted = eligible.select(F.col("doc_id").alias("_e")).distinct()
        allowed = index.documents.select("number", "doc_id").join(wanted, F.col("doc_id").eqNullSafe(F.col("_e")), "left_semi")
        place = F.struct(F.col("number").bitwiseAND(SEGMENT - 1).cast("byte").alias("place"), F.lit(0.0).alias("weight"))
        allowed = allowed.groupBy(F.shiftright("number", BITS).alias("segment")).agg(F.collect_list(place).alias("postings"))
        allowed = cut(allowed.select("segment", F.lit(ALLOWED).alias("term"), F.lit(0.0).alias("most"), "postings"))
    for asked in _sets(index, queries, tokenize, factor, F.lit(1.0) if measure.flat else F.col("most")):
        hits = _hits(index, asked, measure.flat)
        if allowed is not None:
            # they go the way of the segments' blocks, as a mask beside them: no join
            hits = hits.unionByName(allowed)
        read = None
        if counts is not None:
            read = spark.sparkContext.accumulator(0)
            pairs = hits.where("term >= 0").groupBy("term").agg(F.count("*").alias("n")).collect()
            counts["blocks"] = counts.get("blocks", 0) + sum(r["n"] * int(asked.ends[r["term"] + 1] - asked.ends[r["term"]]) for r in pairs)
        masked = allowed is not None
        first = cut(_best(hits, asked, k, None, measure, read, masked))
        both = first.unionByName(_best(hits, asked, k, _floors(first, k, len(asked.queries)), measure, read, masked))
        if counts is not None:
            both = cut(both)
            counts["read"] = counts.get("read", 0) + read.value
        # k rows a query, whatever the corpus has: written, so that who uses them often searches once, and joins know how few they are
        out.append(rewritten(_named(index, both, asked, k, kind)))
    if not out:
        return spark.createDataFrame([], f"query_id {kind}, doc_id {index.documents.schema['doc_id'].dataType.simpleString()}, score double, rank int")
    return reduce(DataFrame.unionByName, out)


def bm25_top_k(index: Index, queries: DataFrame, k: int, tokenize=T.tokens, eligible: DataFrame | None = None, counts: dict | None = None) -> DataFrame:
    """``query_id, doc_id, score, rank`` of the k best documents of each query.

    ``eligible`` (``doc_id``) restricts what is returned, not the statistics. ``counts`` is filled with how many blocks the queries' terms have and how many were scored.
    """
    idf = F.log(1 + (F.lit(float(index.count)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    measure = Measure(False, lambda sums, _, __: sums, lambda floors, _: floors)
    return _search(index, queries, k, tokenize, idf * F.col("qtf"), measure, eligible, counts)


def jaccard_top_k(index: Index, queries: DataFrame, k: int, tokenize=T.tokens, counts: dict | None = None) -> DataFrame:
    """``query_id, doc_id, score, rank`` of the k documents most alike as sets of tokens."""
    # of sets that share s tokens none is alike by more than s over the query's size
    measure = Measure(True, lambda sums, size, asked: sums / (np.maximum(size, 1)[:, None] + asked[None, :] - sums), lambda floors, asked: floors * asked)
    return _search(index, queries, k, tokenize, F.lit(1.0), measure, None, counts)
