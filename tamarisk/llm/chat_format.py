"""Preference formatting: what two conversations share is rendered once as prompt, the rest as masked completions.

A turn is common when both sides have the same roles and texts under its number; the prompt is all turns before the
first that isn't common. ``preference_rows`` gives one row a rendered turn (``part``: prompt, chosen or rejected;
``trained`` marks the assistant's turns of a completion), ``placed`` adds where it begins in its part's text, and
``paired`` puts prompt, both completions and their masks side by side: one row a pair, and where a part is longer than
``SEGMENT`` code points, further rows with what follows, so no conversation, however long, has to fit one row. Equal sides
leave both completions empty.

Null texts and roles are rendered as empty text and as ``user``; a null turn number comes before all others; repeated
rows of a side count once; turns of one number are all kept, in order of role and text; a long turn is rendered whole. A null
``pair_id`` is a pair like any other. Empty tables give no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Code points of a part after which the next segment begins, and turns whose lengths are summed before a pair's are.
SEGMENT, BLOCK = 1_000_000, 1024

OPEN, CLOSE = "<|{}|>\n", "<|end|>\n"


def rendered(role: Column, text: Column) -> Column:
    before, after = OPEN.split("{}")
    return F.concat(F.lit(before), role, F.lit(after), text, F.lit(CLOSE))


def preference_rows(sides: DataFrame) -> DataFrame:
    """From ``pair_id, side ('chosen' or 'rejected'), turn, role, text``: ``pair_id, part, turn, role, piece, trained``."""
    key = ["pair_id", "turn", "role", "text"]
    rows = sides.select("pair_id", "side", F.coalesce("turn", F.lit(-1)).alias("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    has = lambda side: F.max((F.col("side") == side).cast("int")) == 1
    turns = rows.groupBy(*key).agg(has("chosen").alias("c"), has("rejected").alias("r"))
    first = turns.where("c != r").groupBy(F.col("pair_id").alias("p")).agg(F.min("turn").alias("first"))
    marked = turns.join(first, F.col("pair_id").eqNullSafe(F.col("p")), "left")
    common = F.col("first").isNull() | (F.col("turn") < F.col("first"))
    own = F.filter(F.array(F.when(F.col("c"), F.lit("chosen")), F.when(F.col("r"), F.lit("rejected"))), lambda x: x.isNotNull())
    parts = marked.select(*key, F.explode(F.when(common, F.array(F.lit("prompt"))).otherwise(own)).alias("part"))
    trained = (F.col("part") != "prompt") & (F.col("role") == "assistant")
    return parts.select("pair_id", "part", "turn", "role", rendered(F.col("role"), F.col("text")).alias("piece"), trained.alias("trained"))


def placed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``start``, a turn's place in its part's text.

    Lengths are summed by blocks of turns first, so the window over a whole pair has a row a block.
    """
    key = ["pair_id", "part", "block"]
    sized = rows.withColumn("block", F.expr(f"turn div {BLOCK}")).withColumn("size", F.length("piece").cast("long"))
    blocks = sized.groupBy(*key).agg(F.sum("size").alias("size"))
    before = Window.partitionBy("pair_id", "part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*[F.col(c).alias(f"b_{c}") for c in key], F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy(*key).orderBy("turn", "role", "piece").rowsBetween(Window.unboundedPreceding, -1)
    sized = sized.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    both = sized.join(blocks, F.col("pair_id").eqNullSafe(F.col("b_pair_id")) & (F.col("part") == F.col("b_part")) & (F.col("block") == F.col("b_block")))
    return both.select(*rows.columns, (F.col("base") + F.col("within")).alias("start"))


def paired(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """``pair_id, segment, prompt, chosen, chosen_mask, rejected, rejected_mask`` from ``preference_rows``.

    A mask lists the trained stretches of its text as ``start-end``, in code points, joined by commas.
    """
    cut = placed(rows).withColumn("segment", F.expr(f"start div {segment}"))
    turn = F.struct("start", "piece", "trained")
    put = [F.sort_array(F.collect_list(F.when(F.col("part") == p, turn))).alias(f"_{p}") for p in ("prompt", "chosen", "rejected")]
    pairs = cut.groupBy("pair_id", "segment").agg(*put)
    text = lambda p: F.array_join(F.transform(f"_{p}", lambda x: x["piece"]), "").alias(p)

    def mask(p: str) -> Column:
        at = lambda x: x["start"] - F.get(f"_{p}", F.lit(0))["start"]
        trained = F.filter(f"_{p}", lambda x: x["trained"])
        spans = F.transform(trained, lambda x: F.concat_ws("-", at(x).cast("string"), (at(x) + F.length(x["piece"])).cast("string")))
        return F.array_join(spans, ",").alias(f"{p}_mask")

    return pairs.select("pair_id", "segment", text("prompt"), text("chosen"), mask("chosen"), text("rejected"), mask("rejected"))


def reply_swapped(conversations: DataFrame) -> DataFrame:
    """Sides made from a table of conversations: each is chosen over itself with its last reply exchanged for the
    last reply of its neighbour (``conv_id`` xor 1), or for an empty one if the neighbour has none.

    Of several last replies under one number the least text counts as the neighbour's.
    """
    rows = conversations.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    spoken = rows.where("role = 'assistant'").groupBy("pair_id").agg(F.max("turn").alias("last"))
    last = rows.where("role = 'assistant'").join(spoken, "pair_id").where("turn = last")
    reply = last.groupBy("pair_id").agg(F.min("text").alias("reply"))
    to = spoken.join(reply.select(F.col("pair_id").bitwiseXOR(F.lit(1)).alias("pair_id"), "reply"), "pair_id", "left")
    chosen = rows.withColumn("side", F.lit("chosen"))
    changed = rows.join(to.withColumnRenamed("pair_id", "p"), F.col("pair_id") == F.col("p"), "left")
    text = F.when((F.col("role") == "assistant") & (F.col("turn") == F.col("last")), F.coalesce("reply", F.lit(""))).otherwise(F.col("text"))
    return chosen.unionByName(changed.select("pair_id", "turn", "role", text.alias("text"), F.lit("rejected").alias("side")))
