"""The stages from raw log to evaluation, each reading and writing tables.

A stage reads the Parquet output of the one before, so a lost executor costs no more than the
current stage, and existing output is kept unless ``overwrite`` is set.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlattice.operators import encode, metrics, quality, shape, vocab
from adlattice.operators import profile as pf
from adlattice.operators import split as sp
from adlattice.operators import tokens as tk
from adlattice.session import durable, partitions_for, placed_by, read_colocated
from adlattice.sources import raw, sinks
from adlattice.spec import FeatureMap


@dataclass(frozen=True)
class Layout:
    """Folders of one data set below a root."""

    root: str

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"


def _write(df: DataFrame, path: str, overwrite: bool) -> DataFrame:
    df.write.mode(sinks.save_mode(overwrite)).parquet(path)
    return df.sparkSession.read.parquet(path)


def _rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def canonical(
    spark: SparkSession, skeleton: str, common: str, out: Layout, nrows: int | None = None, overwrite: bool = False
) -> DataFrame:
    """Raw CSVs to samples and tokens; returns the one-row manifest."""
    splits = durable(raw.split_table(spark, skeleton))
    numbered = raw.with_row_ids(spark, skeleton, nrows, splits)
    strings = raw.read_common(spark, common)
    fresh = overwrite or not sinks.exists(spark, out.path("samples"))
    sinks.write_samples(raw.samples_of(numbered), out.path("samples"), overwrite)
    if fresh:
        raw.require_all_rows(spark.read.parquet(out.path("samples")), splits, nrows)
    joined = tk.attach_common(numbered, strings)
    sinks.write_tokens(tk.all_tokens(joined), out.path("tokens"), overwrite=overwrite)
    samples, tokens = spark.read.parquet(out.path("samples")), spark.read.parquet(out.path("tokens"))
    summary = tk.canonical_summary(samples, strings, tokens, tk.all_parse_errors(joined))
    return _write(summary, out.path("manifest"), overwrite)


def split(spark: SparkSession, out: Layout, ratios: Mapping[str, float], seed: int, overwrite: bool = False) -> DataFrame:
    """Samples and tokens by entity-disjoint split; returns the token reconciliation."""
    assigned = sp.assign_split(spark.read.parquet(out.path("samples")), ratios, seed)
    tokens = spark.read.parquet(out.path("tokens"))
    parts = partitions_for(tokens) or int(spark.conf.get("spark.sql.shuffle.partitions"))
    samples = sinks.write_colocated(assigned, out.path("split_samples"), parts, ("split",), overwrite)
    _write(sp.split_stats(samples), out.path("split_stats"), overwrite)
    # The tokens move once, into the buckets that the samples lie in; later stages move neither.
    placed = sp.split_tokens(placed_by(tokens, ["row_id"], parts), samples)
    sinks.write_colocated(placed, out.path("split_tokens"), parts, ("split",), overwrite)
    return _write(sp.reconcile_split(tokens, spark.read.parquet(out.path("split_tokens"))), out.path("split_tokens_manifest"), overwrite)


def _side(spark: SparkSession, out: Layout, name: str, which: str) -> DataFrame:
    """One split of a partitioned table; the filter prunes the folders of the others."""
    return read_colocated(spark, out.path(name)).where(F.col("split") == which).drop("split")


def _buckets(spark: SparkSession, out: Layout, name: str) -> int:
    return spark.read.json(f"{out.path(name)}.layout").first()["parts"]


def explore(spark: SparkSession, out: Layout, top_k: int = 200, min_support: int = 20, overwrite: bool = False) -> None:
    """Profiles, top fids, lift and drift of the split tables."""
    samples = {s: _side(spark, out, "split_samples", s) for s in ("train", "valid")}
    tokens = {s: _side(spark, out, "split_tokens", s) for s in ("train", "valid")}
    sp.require_disjoint(samples["train"], samples["valid"])
    for s in samples:
        _write(pf.samples_profile(samples[s]), out.path(f"profile_{s}"), overwrite)
        _write(pf.entity_frequency(samples[s]), out.path(f"entity_frequency_{s}"), overwrite)
        _write(pf.row_length_histogram(tokens[s]), out.path(f"row_lengths_{s}"), overwrite)
    _write(pf.field_stats(tokens["train"], _rows(samples["train"])), out.path("field_stats"), overwrite)
    counts = _write(tk.token_counts(tokens["train"]), out.path("token_counts"), overwrite)
    top = _write(pf.field_top_k(counts, top_k), out.path("field_top_k"), overwrite)
    labelled = pf.labelled_top_tokens(tokens["train"], top, samples["train"])
    _write(pf.fid_lift(labelled, samples["train"], min_support), out.path("fid_lift"), overwrite)
    coverage = pf.coverage_drift(tokens["train"], tokens["valid"], _rows(samples["train"]), _rows(samples["valid"]))
    jaccard = pf.top_jaccard(pf.field_top_k(counts, 100), pf.field_top_k(tk.token_counts(tokens["valid"]), 100))
    _write(pf.drift_summary(coverage, jaccard), out.path("drift"), overwrite)
    whole = spark.read.parquet(out.path("split_tokens"))
    _write(pf.sanity_report(spark.read.parquet(out.path("split_samples")), spark.read.parquet(out.path("tokens")), whole), out.path("sanity"), overwrite)


def advise(spark: SparkSession, out: Layout, existing: FeatureMap, overwrite: bool = False) -> DataFrame:
    """Unseen-value, length, collision and value-drift curves, and the recommended features."""
    train, valid = (_side(spark, out, "split_tokens", s) for s in ("train", "valid"))
    n_train = _rows(_side(spark, out, "split_samples", "train"))
    stats = spark.read.parquet(out.path("field_stats"))
    ranked = vocab.frequency_ranks(spark.read.parquet(out.path("token_counts")))
    frequency = _write(ranked.select("field", "src", "fid", "cnt", (F.col("rank") + 1).alias("rnk")), out.path("train_frequency"), overwrite)
    curves = _write(vocab.oov_curves(valid, frequency), out.path("oov_curves"), overwrite)
    hints = _write(vocab.encoding_advice(curves), out.path("encoding_advice"), overwrite)
    lengths = _write(shape.bag_lengths(train, shape.multi_hot_fields(stats)), out.path("bag_lengths"), overwrite)
    quantiles = _write(shape.length_quantiles(lengths, n_train), out.path("length_quantiles"), overwrite)
    truncation = _write(shape.truncation_curve(lengths), out.path("truncation_curve"), overwrite)
    collisions = _write(shape.collision_curve(stats), out.path("hash_collisions"), overwrite)
    shares = shape.token_share(stats)
    buckets = _write(shape.bucket_advice(shares, collisions), out.path("bucket_advice"), overwrite)
    cube = shape.value_cube(read_colocated(spark, out.path("split_tokens")))
    fields = shape.cube_fields(cube)
    edges = _write(shape.cube_edges(cube, fields), out.path("value_edges"), overwrite)
    bins = _write(shape.cube_histogram(cube, edges), out.path("value_histogram"), overwrite)
    _write(shape.psi(bins), out.path("value_psi"), overwrite)
    _write(shape.cube_profile(cube, fields), out.path("value_profile"), overwrite)
    longest = shape.max_len_advice(shares, truncation, quantiles)
    advice = shape.feature_advice(stats, hints, buckets, longest, existing.table(spark))
    return _write(advice, out.path("feature_advice"), overwrite)


def process(spark: SparkSession, out: Layout, features: FeatureMap, blake2b: bool = False, overwrite: bool = False) -> DataFrame:
    """Encoded wide table of both splits with the training vocabulary; returns its feature report."""
    samples = read_colocated(spark, out.path("split_samples"))
    tokens = read_colocated(spark, out.path("split_tokens")).drop("split")
    spec = features.table(spark)
    train = _side(spark, out, "split_tokens", "train")
    counts = tk.token_counts(train.join(F.broadcast(spec.select("src", "field")), ["src", "field"], "left_semi"))
    ranks = _write(vocab.frequency_ranks(counts), out.path("ranks"), overwrite)
    lines = encode.check_bounds(encode.encode_tokens(tokens, spec, ranks, blake2b))
    encoded = sinks.write_colocated(lines, out.path("encoded"), _buckets(spark, out, "split_samples"), overwrite=overwrite)
    _write(encode.encoding_rates(encode.encoding_stats(encoded, spec, _rows(samples))), out.path("encoding_rates"), overwrite)
    sinks.write_processed(encode.assemble(samples, encoded, features), out.path("processed"), overwrite)
    processed = spark.read.parquet(out.path("processed"))
    quality.require_same_rows(processed, samples)
    return _write(quality.feature_report(processed, features), out.path("feature_report"), overwrite)


def evaluate(scored: DataFrame, out: Layout, keep_prob: float = 1.0, overwrite: bool = False) -> DataFrame:
    """Summary, reliability bins and funnel gaps of a scored table."""
    predicted = metrics.predictions(scored)
    sinks.write_predictions(predicted, out.path("predictions"), overwrite)
    tasks = metrics.score_tasks(scored, keep_prob)
    _write(metrics.reliability(tasks, keys=["task"]), out.path("reliability"), overwrite)
    _write(metrics.funnel_consistency(predicted), out.path("funnel"), overwrite)
    return _write(metrics.evaluation_summary(scored, keep_prob=keep_prob), out.path("evaluation"), overwrite)
