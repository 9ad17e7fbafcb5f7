"""Click-log views over the star-schema test tables, in Spark.

``sql_views`` holds the same definitions as SQL text for the independent check.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlattice.operators import split as sp
from adlattice.operators import vocab
from adlattice.operators.encode import assemble, check_bounds, encode_tokens
from adlattice.operators.tokens import token_counts
from adlattice.session import by_rows, durable
from adlattice.spec import Feature, FeatureMap

SEED = 42
RATIOS = {"train": 0.8, "valid": 0.2}

# Small heads and bags, so that unseen ids, hashed tails and truncation all occur in the test tables.
FEATURES = FeatureMap(
    (
        Feature("205", 0, "hash", hash_bucket=8388608),
        Feature("853", 0, "hybrid", multi_hot=True, max_len=3, use_value=True, pooling="weighted_sum_sqrtn", vocab_tokens=40, hash_bucket=64),
        Feature("508", 0, "vocab", use_value=True, vocab_tokens=4),
        Feature("301", 0, "vocab", multi_hot=True, max_len=2, pooling="sum_sqrtn", vocab_tokens=5),
        Feature("121", 1, "vocab", vocab_tokens=3),
        Feature("129", 1, "hybrid", use_value=True, vocab_tokens=10, hash_bucket=16),
    )
)


def lit_token(field: str, fid, val, src: int = 0):
    return F.struct(
        F.lit(src).cast("byte").alias("src"),
        F.lit(field).alias("field"),
        fid.cast("string").alias("fid"),
        val.cast("float").alias("val"),
    )


class Views:
    """Lazy frames over one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._kept: dict[str, DataFrame] = {}

    def once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A small intermediate that is written to the shared folder on first use."""
        if name not in self._kept:
            self._kept[name] = durable(build())
        return self._kept[name]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def samples(self) -> DataFrame:
        click = F.col("o_orderstatus") == "F"
        buy = (F.col("o_orderpriority") == "1-URGENT") & (click | (F.col("o_orderkey") % 97 == 0))
        return self.table("orders").select(
            F.col("o_orderkey").alias("row_id"),
            F.when(click, 1).otherwise(0).cast("byte").alias("y1"),
            F.when(buy, 1).otherwise(0).cast("byte").alias("y2"),
            F.lpad(F.col("o_custkey").cast("string"), 16, "0").alias("entity_id"),
            (F.col("o_custkey") % 7).cast("int").alias("c4"),
            (F.col("o_orderkey") + 100000).alias("c0"),
        )

    @cached_property
    def tokens(self) -> DataFrame:
        lines = self.table("lineitem").select(
            F.col("l_orderkey").alias("row_id"),
            F.inline(
                F.array(
                    lit_token("205", F.col("l_partkey"), F.lit(1)),
                    lit_token("853", F.col("l_suppkey"), F.col("l_quantity") / 10),
                    lit_token("508", F.concat("l_returnflag", "l_linestatus"), F.col("l_discount")),
                )
            ),
        )
        orders = self.table("orders").join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
        head = orders.select(
            F.col("o_orderkey").alias("row_id"),
            F.inline(
                F.array(
                    lit_token("121", F.col("c_mktsegment"), F.lit(1), 1),
                    lit_token("129", F.col("c_nationkey"), F.col("c_acctbal") / 1000, 1),
                )
            ),
        )
        priority = self.table("orders").select(
            F.col("o_orderkey").alias("row_id"), F.inline(F.array(lit_token("301", F.col("o_orderpriority"), F.lit(1))))
        )
        return lines.unionByName(head).unionByName(priority)

    @cached_property
    def split_samples(self) -> DataFrame:
        return sp.assign_split(self.samples, RATIOS, SEED)

    def samples_of(self, split: str) -> DataFrame:
        return self.split_samples.where(F.col("split") == split)

    def tokens_of(self, split: str) -> DataFrame:
        return sp.tokens_of_split(self.tokens, self.split_samples, split)

    def side(self, split: str) -> DataFrame:
        """``tokens_of(split)`` for queries that read several splits, or one more than once: the tokens are moved and written once for all."""
        marks = self.split_samples.select("row_id", "split").distinct()
        both = self.once("split_tokens", lambda: by_rows(self.tokens, ["row_id"]).join(marks, "row_id"))
        return both.where(F.col("split") == split).drop("split")

    def rows(self, df: DataFrame) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n"))

    @cached_property
    def words(self) -> DataFrame:
        """Word tokens of whole documents; the value is the number of occurrences."""
        word = F.explode(F.split("text", " ")).alias("fid")
        return (
            self.table("documents")
            .select(F.col("doc_id").alias("row_id"), F.col("lang").alias("field"), word)
            .where("fid <> ''")
            .groupBy("row_id", "field", "fid")
            .agg(F.count(F.lit(1)).cast("float").alias("val"))
            .withColumn("src", F.lit(0).cast("byte"))
        )

    def words_of(self, split: str) -> DataFrame:
        docs = self.table("documents").select(F.col("doc_id").alias("row_id"), F.col("doc_id").cast("string").alias("entity_id"))
        return sp.tokens_of_split(self.words, sp.assign_split(docs, RATIOS, SEED), split)

    @cached_property
    def scored(self) -> DataFrame:
        joined = self.table("orders").join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
        logits = joined.select(
            F.col("o_orderkey").alias("row_id"),
            ((F.col("o_totalprice") - 150000) / 100000).alias("ctr_logit"),
            ((F.col("c_acctbal") - 4500) / 4000).alias("cvr_logit"),
        )
        labels = self.samples.select(
            "row_id", "entity_id",
            F.col("y1").alias("y_ctr"), F.col("y2").alias("y_cvr"),
            (F.col("y1") * F.col("y2")).cast("byte").alias("y_ctcvr"), F.col("y1").alias("click_mask"),
        )
        return labels.join(logits, "row_id")

    @cached_property
    def evals(self) -> DataFrame:
        """Evaluation log: one run per user, one evaluation per event."""
        return self.table("events").select(
            F.col("user_id").alias("run_id"),
            F.col("event_id").alias("step"),
            (F.lit(0.60) + F.col("value") / 2000).alias("auc_ctcvr"),
            (F.lit(0.65) + (F.col("event_id") % 50) / F.lit(1000.0)).alias("auc_ctr"),
            (F.lit(0.60) + (F.col("event_id") % 30) / F.lit(1000.0)).alias("auc_cvr"),
            (F.col("value") / 100 - 0.5).alias("cos_all"),
            F.when(F.col("event_id") % 5 != 0, (F.col("event_id") % 21 - 10) / F.lit(10.0)).alias("cos_dense"),
            F.when(F.col("event_id") % 3 != 0, F.col("value") / 200 - 0.2).alias("cos_sparse"),
            (F.lit(1.0) + F.col("event_id") % 7).alias("norm_1"),
            F.when(F.col("event_type") != "error", F.lit(0.5) + F.col("event_id") % 11).alias("norm_2"),
            "event_type",
        )

    @cached_property
    def gates(self) -> DataFrame:
        """Gate weights of four experts for two tasks, normalised; an expert adds up every fourth entry."""
        share = lambda e: F.aggregate(F.filter("embedding", lambda x, j: j % 4 == e), F.lit(0.0), lambda a, x: a + F.exp(x.cast("double") * 8))
        raw = F.array(*[share(e) for e in range(4)])
        total = F.aggregate("w_raw", F.lit(0.0), lambda a, x: a + x)
        return (
            self.table("embeddings")
            .select(
                F.col("vec_id").alias("row_id"),
                F.when(F.col("label") % 2 == 0, "ctr").otherwise("cvr").alias("task"),
                raw.alias("w_raw"),
            )
            .select("row_id", "task", F.transform("w_raw", lambda x: x / total).alias("w"))
        )

    @cached_property
    def ranks(self) -> DataFrame:
        """Training ranks of the configured fields."""
        keys = F.broadcast(self.spec.select("src", "field"))
        counts = token_counts(self.tokens_of("train").join(keys, ["src", "field"], "left_semi"))
        return vocab.frequency_ranks(counts)

    @cached_property
    def spec(self) -> DataFrame:
        return FEATURES.table(self.spark)

    @cached_property
    def encoded(self) -> DataFrame:
        return check_bounds(encode_tokens(self.tokens, self.spec, self.ranks))

    @cached_property
    def processed(self) -> DataFrame:
        return assemble(self.split_samples, self.encoded, FEATURES)
