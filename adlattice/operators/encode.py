"""Token selection, id mapping and the wide encoded table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from adlattice.functions.hashing import token_bucket, token_bucket_blake2b
from adlattice.operators.tokens import default_src, guard_values
from adlattice.operators.vocab import look_up_ranks
from adlattice.session import by_rows, placed_by
from adlattice.spec import HASH_OFFSET, HASH_SEED, MISSING_ID, OOV_ID, UNKNOWN_RANK, Feature, FeatureMap

BAG = ["row_id", "src", "field"]
LABELS = ["y_ctr", "y_cvr", "y_ctcvr", "click_mask", "row_id", "entity_id"]


def derive_labels(samples: DataFrame) -> DataFrame:
    """Label and id columns of the encoded table."""
    extra = [c for c in ("split",) if c in samples.columns]
    return samples.select(
        F.col("y1").cast("byte").alias("y_ctr"),
        F.col("y2").cast("byte").alias("y_cvr"),
        (F.col("y1") * F.col("y2")).cast("byte").alias("y_ctcvr"),
        F.col("y1").cast("byte").alias("click_mask"),
        "row_id",
        "entity_id",
        *extra,
    )


def prepare_bags(tokens: DataFrame, spec: DataFrame, ranks: DataFrame) -> DataFrame:
    """Clean, ranked, duplicate-free tokens of the features in ``spec``.

    The rank lookup comes first; after it the tokens are partitioned by row_id once, unless they lie so, and
    merging, selection, pivot and the join to the samples all work inside that partitioning.
    """
    keys = F.broadcast(spec.select("src", "field"))
    wanted = guard_values(default_src(tokens)).join(keys, ["src", "field"], "left_semi")
    ranked = placed_by(by_rows(look_up_ranks(wanted, ranks), ["row_id"]), ["row_id"])
    return ranked.groupBy(*BAG, "fid").agg(
        F.max("val").alias("val"),
        F.min("rank").alias("rank"),
        F.count(F.lit(1)).alias("copies"),
        F.count_if("bad_value").alias("bad"),
    )


def select_tokens(bags: DataFrame, spec: DataFrame) -> DataFrame:
    """The kept tokens of every bag with their position, the rule that was used and bag totals.

    Two orderings of a bag serve all rules: by value, and the final one, in which a token comes
    either by its place in the value order (``_first`` = 0) or after those, by frequency.
    """
    settings = spec.select(
        "src", "field", "multi_hot", "k", "strategy", "default_strategy", "non_one_ratio", "value_std", "mix_value_share"
    )
    bag = Window.partitionBy(*BAG)
    known = F.coalesce("rank", F.lit(UNKNOWN_RANK))
    by_value = Window.partitionBy(*BAG).orderBy(F.desc("val"), "fid")
    measured = (
        bags.withColumn("_pv", F.row_number().over(by_value))
        .withColumn("distinct_tokens", F.count(F.lit(1)).over(bag))
        .withColumn("raw_tokens", F.sum("copies").over(bag))
        .withColumn("bad_tokens", F.sum("bad").over(bag))
        .withColumn("_non_one", F.avg((F.col("val") != 1.0).cast("double")).over(bag))
        .withColumn("_std", F.stddev_pop("val").over(bag))
    )
    informative = (F.col("_non_one") >= F.col("non_one_ratio")) | (F.col("_std") >= F.col("value_std"))
    rule = (
        F.when(~F.col("multi_hot"), F.lit("single"))
        .when(F.col("strategy") != "auto", F.col("strategy"))
        .when(informative & F.col("default_strategy").isin("auto_mix", "topk_by_value"), F.col("default_strategy"))
        .otherwise(F.lit("topk_by_freq"))
    )
    by_value_first = F.ceil(F.col("_k").cast("double") * F.col("mix_value_share"))
    first = (
        F.when(F.col("rule") == "topk_by_freq", 1)
        .when(F.col("rule") == "auto_mix", (F.col("_pv") > by_value_first).cast("int"))
        .otherwise(0)
    )
    # Equal largest values of a single-hot bag are told apart by rank, not by fid alone.
    place = F.when(F.col("_first") == 1, F.lit(0.0)).when(F.col("rule") == "single", -F.col("val")).otherwise(F.col("_pv"))
    final = Window.partitionBy(*BAG).orderBy("_first", "_place", known, "fid")
    ruled = (
        measured.join(F.broadcast(settings), ["src", "field"])
        .select(
            *bags.columns, "_pv", "distinct_tokens", "raw_tokens", "bad_tokens",
            F.coalesce("k", "distinct_tokens").alias("_k"), rule.alias("rule"), "mix_value_share",
        )
        .withColumn("_first", first)
        .withColumn("_place", place.cast("double"))
    )
    kept = ruled.withColumn("pos", F.row_number().over(final)).where(F.col("pos") <= F.col("_k"))
    return kept.select(
        *bags.columns,
        F.col("pos").cast("int").alias("pos"),
        "rule",
        "distinct_tokens",
        "raw_tokens",
        "bad_tokens",
        (F.least("distinct_tokens", "_k") / F.col("distinct_tokens")).alias("retained_frac"),
    )

def in_vocabulary() -> Column:
    return F.coalesce(F.col("rank") < F.col("vocab_tokens"), F.lit(False))


def map_ids(selected: DataFrame, spec: DataFrame, seed: int = HASH_SEED, blake2b: bool = False) -> DataFrame:
    """Embedding row of every kept token, with the out-of-vocabulary and tail flags."""
    ids = spec.select("src", "field", "name", "encoding", "vocab_tokens", "vocab_offset", "head_rows", "hash_bucket", "total_rows")
    selected = selected.join(F.broadcast(ids), ["src", "field"])
    hashed = (token_bucket_blake2b if blake2b else token_bucket)(
        F.col("src"), F.col("field"), F.col("fid"), F.coalesce("hash_bucket", F.lit(1)), seed
    )
    head = F.col("vocab_offset") + F.col("rank")
    vocab, hybrid = F.col("encoding") == "vocab", F.col("encoding") == "hybrid"
    idx = (
        F.when(F.col("encoding") == "hash", F.lit(HASH_OFFSET) + hashed)
        .when(in_vocabulary(), head)
        .when(hybrid, F.col("head_rows") + hashed)
        .otherwise(F.lit(OOV_ID))
    )
    return selected.withColumns(
        {
            "idx": idx.cast("long"),
            "is_oov": vocab & ~in_vocabulary(),
            "is_tail": hybrid & ~in_vocabulary(),
        }
    )


def encode_tokens(tokens: DataFrame, spec: DataFrame, ranks: DataFrame, blake2b: bool = False) -> DataFrame:
    """Long encoded table: one line per kept token."""
    return map_ids(select_tokens(prepare_bags(tokens, spec, ranks), spec), spec, blake2b=blake2b)


def check_bounds(encoded: DataFrame) -> DataFrame:
    """Fails the job at run time when an id lies outside its embedding table."""
    message = F.concat(F.col("name"), F.lit(": id "), F.col("idx").cast("string"), F.lit(" is out of range"))
    broken = F.col("idx") >= F.col("total_rows")
    return encoded.withColumn("idx", F.when(broken, F.raise_error(message).cast("long")).otherwise(F.col("idx")))


def column_names(features: FeatureMap) -> list[str]:
    """Generated feature columns in sorted order."""
    names = []
    for f in features.by_name():
        names.append(f"{f.name}_idx")
        if f.use_value:
            names.append(f"{f.name}_val")
    return names


def _feature_columns(f: Feature) -> list[Column]:
    mine = F.col("name") == f.name
    if f.multi_hot:
        return [F.array_sort(F.collect_list(F.when(mine, F.struct("pos", "idx", "val")))).alias(f.name)]
    return [F.max(F.when(mine, F.struct("idx", "val"))).alias(f.name)]


def _filled(f: Feature) -> list[Column]:
    got = F.col(f.name)
    if f.multi_hot:
        empty = got.isNull() | (F.size(got) == 0)
        idx = F.when(empty, F.array(F.lit(MISSING_ID).cast("long"))).otherwise(F.transform(got, lambda t: t["idx"]))
        val = F.when(empty, F.array(F.lit(1.0).cast("float"))).otherwise(
            F.transform(got, lambda t: t["val"].cast("float"))
        )
    else:
        idx = F.coalesce(got["idx"], F.lit(MISSING_ID).cast("long"))
        val = F.coalesce(got["val"].cast("float"), F.lit(1.0).cast("float"))
    return [idx.alias(f"{f.name}_idx")] + ([val.alias(f"{f.name}_val")] if f.use_value else [])


def assemble(samples: DataFrame, encoded: DataFrame, features: FeatureMap) -> DataFrame:
    """One row per sample with all feature columns; absent features get the missing id.

    One conditional aggregation per row instead of a join per feature; bags are already cut to k.
    """
    wide = encoded.groupBy("row_id").agg(*[c for f in features for c in _feature_columns(f)])
    labelled = derive_labels(samples).join(wide, "row_id", "left")
    extra = [c for c in ("split",) if c in samples.columns]
    filled = labelled.select(*LABELS, *extra, *[c for f in features for c in _filled(f)])
    return filled.select(*LABELS, *extra, *column_names(features))


def encoding_stats(encoded: DataFrame, spec: DataFrame, n_rows: DataFrame) -> DataFrame:
    """Per feature: rows with and without tokens, misses, tails, bad values, lengths, largest id."""
    first = F.col("pos") == 1
    agg = encoded.groupBy("src", "field").agg(
        F.count_if(first).alias("token_rows"),
        F.count_if("is_oov").alias("oov"),
        F.count_if("is_tail").alias("tail_fallback"),
        F.sum(F.when(first, F.col("raw_tokens")).otherwise(0)).alias("total_tokens"),
        F.sum(F.when(first, F.col("bad_tokens")).otherwise(0)).alias("nan_inf_tokens"),
        F.count(F.lit(1)).alias("kept"),
        F.max("idx").alias("max_kept"),
        F.sum(F.when(first, F.col("retained_frac"))).alias("retained_sum"),
        F.count_if(first & (F.col("rule") == "auto_mix")).alias("by_auto_mix"),
        F.count_if(first & (F.col("rule") == "topk_by_freq")).alias("by_freq"),
        F.count_if(first & (F.col("rule") == "topk_by_value")).alias("by_value"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    joined = spec.select("src", "field", "name", "multi_hot", "total_rows").join(agg, ["src", "field"], "left")
    missing = n_rows.scalar() - F.coalesce("token_rows", F.lit(0))
    return joined.select(
        "name",
        "multi_hot",
        "total_rows",
        n_rows.scalar().alias("rows"),
        zero("token_rows"),
        missing.alias("missing"),
        zero("oov"),
        zero("tail_fallback"),
        zero("total_tokens"),
        zero("nan_inf_tokens"),
        (F.coalesce("kept", F.lit(0)) + missing).alias("len_sum"),
        F.greatest(F.coalesce("max_kept", F.lit(0)), F.when(missing > 0, F.lit(MISSING_ID)).otherwise(0)).alias("max_idx"),
        F.coalesce("retained_sum", F.lit(0.0)).alias("retained_sum"),
        zero("by_auto_mix"),
        zero("by_freq"),
        zero("by_value"),
    )


def encoding_rates(stats: DataFrame) -> DataFrame:
    """Ratios of the per-feature stats; the rule shares and retained share concern bags only."""
    over = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return stats.select(
        "name",
        over("nan_inf_tokens", "total_tokens").alias("nan_inf_rate"),
        over("tail_fallback", "total_tokens").alias("tail_fallback_rate"),
        over("by_auto_mix", "token_rows").alias("auto_mix_rate"),
        over("by_freq", "token_rows").alias("topk_by_freq_rate"),
        over("by_value", "token_rows").alias("topk_by_value_rate"),
        F.when(F.col("multi_hot"), F.try_divide("retained_sum", "token_rows")).alias("avg_retained_frac"),
        "max_idx",
    )
