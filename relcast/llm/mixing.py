"""Mixing sources to target weights (DataFrame operations only).

Each source's documents, in a hashed order, are one stream of words that is packed into blocks of fixed length. Every
source has as many slots of the mix as its target asks for, and a hash deals each slot to an output shard: the counts of a source
in the shards are one multinomial draw that adds up to its target, and those of a shard, given its size, are a draw by the target
weights. (Draws of all slots by weight would miss the target of a source of n slots by a share of about 1 / sqrt(n).) Slot j of
a source takes block perm(j mod blocks) of epoch j div blocks, where perm is a pseudorandom permutation of the source's block
indices ("swap or not" rounds, which work on any number of blocks). Blocks are joined by index with the documents that lie in them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

#: Documents of a source are dealt to so many parts, whose word counts are summed first: no source is summed in one task.
PARTS = 4096


@dataclass(frozen=True)
class MixParams:
    weights: tuple[float, ...] = (5.0, 2.0, 1.0)  # of the sources by code point, null last, repeating
    max_epochs: int = 3  # no source gives more than so many times its words
    block_words: int = 64
    shard_slots: int = 4096  # on average
    rounds: int = 24  # of the permutation
    task_slots: int = 50_000  # slots that a task permutes
    seed: int = 20240607


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def source_targets(sized: DataFrame, params: MixParams) -> DataFrame:
    """(skey, sidx, source_size, weight, target) of the sources in ``sized`` (source, skey, size).

    Targets share the words of all sources by weight; those above ``max_epochs`` times their source's size stop there
    and the excess is shared again, in closed form: with sources sorted by cap over weight, the first ones are capped
    up to the point where the level of the rest is under the next cap. The windows run over one row for each source.
    """
    sums = sized.groupBy("source", "skey").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weights = F.array(*[F.lit(float(w)) for w in params.weights])
    ranked = sums.withColumn("sidx", F.row_number().over(by_name) - 1).withColumn("weight", F.element_at(weights, F.col("sidx") % len(params.weights) + 1))
    ranked = ranked.withColumn("cap", F.col("source_size") * float(params.max_epochs))
    before = Window.orderBy(F.col("cap") / F.col("weight"), "sidx").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    still = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levels = ranked.withColumn("level", left / still)  # as if all before this source were capped, and none from it on
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "sidx", "level"))).over(everything)["level"]
    return levels.withColumn("final", level).select("skey", "sidx", "source_size", "weight", F.coalesce(F.least(F.col("cap"), F.col("final") * F.col("weight")), F.col("cap")).alias("target"))


def round_keys(key: Column, size: Column, rounds: int) -> Column:
    """Numbers below ``size``, one for each round of a permutation that ``key`` (a bigint) chooses."""
    return F.array(*[F.pmod(F.xxhash64(key, F.lit(r)), size) for r in range(rounds)])


def permuted(index: Column, size: Column, keys: Column) -> Column:
    """The place of ``index`` in a pseudorandom permutation of 0 to ``size`` - 1: in each round it may swap with its mirror."""

    def step(x: Column, key: Column) -> Column:
        mirror = F.pmod(key - x, size)
        return F.when(F.xxhash64(key, F.greatest(x, mirror)).bitwiseAND(F.lit(1).cast("bigint")) == 0, x).otherwise(mirror)

    return F.aggregate(keys, index, step)


def draw_slots(sources: DataFrame, params: MixParams) -> DataFrame:
    """(shard, sidx, epoch, block): what each slot of the mix takes.

    ``sources`` has sidx, source_size and target, a row for each source; the driver learns the number of slots only. Few
    rows become many slots, so runs of slots are dealt out first.
    """
    wish = sources.where("source_size > 0 AND target > 0").withColumn("blocks", F.ceil(F.col("source_size") / params.block_words))
    count = F.least(F.round(F.col("blocks") * F.col("target") / F.col("source_size")).cast("bigint"), params.max_epochs * F.col("blocks"))
    wish = wish.select("sidx", "blocks", count.alias("n")).where("n > 0")
    slots = wish.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = -(-slots // params.shard_slots)
    epochs = wish.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr("(n - 1) div blocks"))))
    epochs = epochs.withColumn("m", F.least(F.col("blocks"), F.col("n") - F.col("epoch") * F.col("blocks")))
    runs = epochs.withColumn("from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1, F.lit(params.shard_slots).cast("bigint"))))
    runs = runs.repartition(1 + slots // params.task_slots, "sidx", "epoch", "from")
    runs = runs.withColumn("key", F.xxhash64(F.lit(params.seed), "sidx", "epoch")).withColumn("keys", round_keys(F.col("key"), F.col("blocks"), params.rounds))
    dealt = runs.select("sidx", "epoch", "blocks", "key", "keys", F.explode(F.sequence("from", F.least(F.col("from") + params.shard_slots, F.col("m")) - 1)).alias("j"))
    shard = F.pmod(F.xxhash64(F.lit(params.seed + 2), "key", "j"), F.lit(max(1, shards)))
    return dealt.select(shard.alias("shard"), "sidx", "epoch", permuted(F.col("j"), F.col("blocks"), F.col("keys")).alias("block"))


def mix_documents(docs: DataFrame, params: MixParams = MixParams(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each document: id, size, source_size, target and taken (words the mix takes, repeats counted).

    A null or empty text has size 0 and nothing is taken of it; null sources are one source, the last. Repeated rows are
    documents of their own. Other columns are left out, so their names can't clash. An empty table gives an empty
    result. Reruns agree: places come from hashes of the rows. Nothing is taken more than ``max_epochs`` times. The
    sizes are counted once and written; a large source is summed in parts, and equal rows are placed as one run.
    """
    text = F.col(text_col)
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"), F.xxhash64(F.lit(params.seed), F.col(id_col), text).alias("h"))
    sized = sized.groupBy("id", "source", "size", "h").agg(F.count("*").alias("copies"), (F.count("*") * F.col("size")).alias("words"))
    sized = cut(sized.withColumn("skey", source_key(F.col("source"))).withColumn("part", F.pmod("h", F.lit(PARTS))))
    sources = cut(source_targets(sized.select("source", "skey", F.col("words").alias("size")), params))
    sums = sized.groupBy("skey", "part").agg(F.sum("words").alias("all"))
    starts = sums.select("skey", "part", (F.sum("all").over(Window.partitionBy("skey").orderBy("part")) - F.col("all")).alias("start")).join(sources, "skey")
    order = Window.partitionBy("skey", "part").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = sized.withColumn("before", F.sum("words").over(order) - F.col("words")).join(starts, ["skey", "part"])
    placed = placed.select("id", "size", "sidx", "source_size", "target", (F.col("start") + F.col("before")).alias("first"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)).alias("copy"))
    placed = placed.select("id", "size", "sidx", "source_size", "target", (F.col("first") + F.col("copy") * F.col("size")).alias("at"))
    width = F.lit(params.block_words)
    inside = placed.where("size > 0").select("sidx", "at", "size", F.explode(F.sequence(F.floor(F.col("at") / width).cast("bigint"), F.floor((F.col("at") + F.col("size") - 1) / width).cast("bigint"))).alias("block"))
    inside = inside.withColumn("words", F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * width) - F.greatest(F.col("at"), F.col("block") * width))
    # few sources become very many blocks, which the planner takes to be as few and would send to the driver, so both sides are shuffled
    times = draw_slots(sources, params).groupBy("sidx", "block").agg(F.count("*").alias("times")).hint("merge")
    took = inside.join(times, ["sidx", "block"]).groupBy("sidx", "at").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    # a source's non-empty documents have places of their own, so (sidx, at) names one row; empty ones take nothing
    full = placed.where("size > 0").join(took, ["sidx", "at"], "left").select("id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))
    rest = placed.where("size = 0").select("id", "size", "source_size", "target", F.lit(0).cast("bigint").alias("taken"))
    return full.unionByName(rest).withColumnRenamed("id", id_col)
