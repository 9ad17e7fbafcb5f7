"""Frequency ranks, vocabularies and out-of-vocabulary curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlattice.operators.joins import broadcast_head, fits_broadcast, lookup_join, spread_join
from adlattice.operators.ordered import group_rank
from adlattice.operators.tokens import FIELD_KEY, token_counts
from adlattice.session import durable

# Head sizes of the curves and the thresholds of the advice.
HEAD_SIZES = [1_000, 5_000, 20_000, 100_000, 200_000]
UNSEEN_RANK = 999_999_999
ROW_RATE_GOOD = 0.02
ROW_RATE_OK = 0.05
NEW_VALUE_GOOD = 0.05
VOCAB_LIMIT = 50_000


def frequency_ranks(counts: DataFrame, partitions: int | None = None) -> DataFrame:
    """0-based rank per (field, src): most frequent first, ties by fid.

    A field may hold a large part of all distinct fids, so the ranking is cut over range partitions.
    """
    return group_rank(counts, FIELD_KEY, [F.desc("cnt"), "fid"], "rank", partitions)


def train_frequency(tokens: DataFrame) -> DataFrame:
    """(field, src, fid, cnt, rnk) of all fids, ranks from 1."""
    ranked = frequency_ranks(token_counts(tokens))
    return ranked.select(*FIELD_KEY, "fid", "cnt", (F.col("rank") + 1).alias("rnk"))


def vocab_table(ranks: DataFrame, spec: DataFrame) -> DataFrame:
    """The fids that own a vocabulary row, per feature with a vocabulary head."""
    heads = spec.where("encoding IN ('vocab', 'hybrid')").select("src", "field", "vocab_tokens")
    return (
        ranks.join(F.broadcast(heads), FIELD_KEY)
        .where(F.col("rank") < F.col("vocab_tokens"))
        .select("src", "field", "fid", "rank")
    )


def look_up_ranks(tokens: DataFrame, ranks: DataFrame) -> DataFrame:
    """Tokens with the rank of their fid, NULL when unseen.

    A small rank table is broadcast. Of a larger one the most frequent fids of every field are; only tokens without any of those, in
    fields that have more, are moved to the other ranks, frequent ones among them over many tasks.
    """
    on = [*FIELD_KEY, "fid"]
    kept = durable(ranks.select(*on, "rank"))
    if fits_broadcast(kept):
        return tokens.join(F.broadcast(kept), on, "left")
    head = broadcast_head(kept, "rank")
    if not head:
        return spread_join(tokens, kept, on, "left")
    others = kept.where(F.col("rank") >= head)
    # Each of these fields has ``head`` lines in the broadcast, so there are fewer of them.
    more = F.broadcast(durable(others.select(*FIELD_KEY).distinct().withColumn("_more", F.lit(True))))
    marked = tokens.join(more, FIELD_KEY, "left").join(F.broadcast(kept.where(F.col("rank") < head)), on, "left")
    columns = [*on, *[c for c in tokens.columns if c not in on], "rank"]
    left = F.col("rank").isNull() & F.col("_more").isNotNull()
    found = marked.where(~left).select(*columns)
    return found.unionByName(spread_join(marked.where(left).drop("rank", "_more"), others, on, "left").select(*columns))


def ranked_tokens(tokens: DataFrame, frequency: DataFrame) -> DataFrame:
    """Tokens with the training rank of their fid; unseen fids get a rank beyond every head."""
    joined = lookup_join(tokens, frequency.select(*FIELD_KEY, "fid", "rnk"), [*FIELD_KEY, "fid"])
    return joined.withColumn("rnk", F.coalesce("rnk", F.lit(UNSEEN_RANK)))


def _heads_passed(rnk: Column, heads: list[int]) -> Column:
    """How many of the ascending head sizes are too small for the rank."""
    return F.size(F.filter(F.array(*[F.lit(n) for n in heads]), lambda n: rnk > n))


def _curve(levels: DataFrame, weight: Column, heads: list[int], out: str) -> DataFrame:
    """Weighted share of lines beyond each head, from (field, src, beyond) lines."""
    sums = levels.groupBy(*FIELD_KEY).agg(
        F.sum(weight).alias("all"),
        F.array(*[F.sum(F.when(F.col("beyond") > i, weight).otherwise(0)) for i in range(len(heads))]).alias("out"),
    )
    lines = F.arrays_zip(F.array(*[F.lit(n) for n in heads]).alias("n"), F.col("out").alias("o"))
    return sums.select(*FIELD_KEY, "all", F.explode(lines).alias("h")).select(
        *FIELD_KEY, F.col("h.n").alias("head_size"), (F.col("h.o") / F.col("all")).alias(out)
    )


def fid_levels(valid: DataFrame, frequency: DataFrame, heads: list[int] = HEAD_SIZES) -> DataFrame:
    """Distinct valid fids with their count and the number of heads that miss them."""
    table = frequency.select(*FIELD_KEY, "fid", "rnk")
    joined = token_counts(valid).join(table, [*FIELD_KEY, "fid"], "left")
    return joined.select(
        *FIELD_KEY, "fid", "cnt", _heads_passed(F.coalesce("rnk", F.lit(UNSEEN_RANK)), heads).alias("beyond")
    )


def oov_token_curve(valid: DataFrame, frequency: DataFrame, heads: list[int] = HEAD_SIZES) -> DataFrame:
    """Share of tokens outside the head; tokens are counted per fid before the join."""
    return _curve(fid_levels(valid, frequency, heads), F.col("cnt"), heads, "oov_token_rate")


def new_value_curve(valid: DataFrame, frequency: DataFrame, heads: list[int] = HEAD_SIZES) -> DataFrame:
    """Share of distinct fids outside the head."""
    return _curve(fid_levels(valid, frequency, heads), F.lit(1), heads, "new_value_rate")


def oov_row_curve(valid: DataFrame, frequency: DataFrame, heads: list[int] = HEAD_SIZES) -> DataFrame:
    """Share of rows whose worst token lies outside the head."""
    beyond = _heads_passed(F.col("rnk"), heads)
    rows = (
        ranked_tokens(valid.select("row_id", *FIELD_KEY, "fid"), frequency)
        .groupBy(*FIELD_KEY, "row_id")
        .agg(F.max(beyond).alias("beyond"))
    )
    return _curve(rows, F.lit(1), heads, "oov_row_rate")


def oov_curves(valid: DataFrame, frequency: DataFrame, heads: list[int] = HEAD_SIZES) -> DataFrame:
    """The three curves side by side per (field, src, head_size)."""
    levels = fid_levels(valid, frequency, heads)
    on = [*FIELD_KEY, "head_size"]
    return (
        _curve(levels, F.col("cnt"), heads, "oov_token_rate")
        .join(oov_row_curve(valid, frequency, heads), on, "left")
        .join(_curve(levels, F.lit(1), heads, "new_value_rate"), on, "left")
    )


def encoding_advice(curves: DataFrame) -> DataFrame:
    """Smallest head that keeps unseen rows and values rare, and the encoding it suggests."""
    n, row, new = F.col("head_size"), F.col("oov_row_rate"), F.col("new_value_rate")
    picked = curves.groupBy(*FIELD_KEY).agg(
        F.min(F.when((row <= ROW_RATE_GOOD) & (new <= NEW_VALUE_GOOD), n)).alias("good"),
        F.min(F.when(row <= ROW_RATE_OK, n)).alias("ok"),
    )
    return picked.select(
        *FIELD_KEY,
        F.coalesce("good", "ok").cast("long").alias("recommended_head_size"),
        F.when(F.col("good") <= VOCAB_LIMIT, F.lit("vocab"))
        .when(F.coalesce("good", "ok").isNotNull(), F.lit("hybrid"))
        .otherwise(F.lit("hash"))
        .alias("recommended_encoding"),
    )
