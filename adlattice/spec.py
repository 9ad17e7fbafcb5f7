"""Feature map: how each (src, field) is encoded. Small driver-side configuration."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field as dc_field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

# Reserved ids and hash seed.
PAD_ID = 0
MISSING_ID = 1
OOV_ID = 2
VOCAB_OFFSET = 3
HASH_OFFSET = 2
HASH_SEED = 17
# Token selection defaults.
NON_ONE_RATIO = 0.05
VALUE_STD = 1e-3
MIX_VALUE_SHARE = 2 / 3
UNKNOWN_RANK = 1_000_000_000

STRATEGIES = ("topk_by_freq", "topk_by_value", "auto_mix", "auto")

# The 23 features of the data set.
# field, src, encoding, embedding_dim, multi_hot, max_len, use_value, pooling, vocab_tokens, hash_bucket
DEFAULT_FEATURES = [
    ("508", 0, "vocab", 8, False, None, True, "none", 20000, None),
    ("301", 0, "vocab", 8, False, None, False, "none", 5, None),
    ("205", 0, "hash", 4, False, None, False, "none", None, 8388608),
    ("121", 1, "vocab", 8, False, None, False, "none", 101, None),
    ("129", 1, "vocab", 8, False, None, False, "none", 6, None),
    ("110_14", 1, "hash", 4, True, 60, True, "weighted_sum_sqrtn", None, 8388608),
    ("210", 0, "hybrid", 8, True, 20, False, "sum_sqrtn", 100000, 8192),
    ("206", 0, "vocab", 8, False, None, False, "none", 20000, None),
    ("127", 1, "vocab", 8, False, None, False, "none", 5, None),
    ("127_14", 1, "hash", 4, True, 60, True, "weighted_sum_sqrtn", None, 4194304),
    ("509", 0, "hash", 4, False, None, True, "none", None, 4194304),
    ("124", 1, "vocab", 8, False, None, False, "none", 4, None),
    ("150_14", 1, "hybrid", 8, True, 80, True, "weighted_sum_sqrtn", 100000, 262144),
    ("109_14", 1, "vocab", 8, True, 80, True, "weighted_sum_sqrtn", 20000, None),
    ("216", 0, "hybrid", 8, False, None, False, "none", 200000, 524288),
    ("207", 0, "hash", 4, False, None, False, "none", None, 4194304),
    ("702", 0, "hybrid", 8, False, None, True, "none", 200000, 32768),
    ("126", 1, "vocab", 8, False, None, False, "none", 5, None),
    ("101", 1, "hash", 4, False, None, False, "none", None, 4194304),
    ("125", 1, "vocab", 8, False, None, False, "none", 9, None),
    ("128", 1, "vocab", 8, False, None, False, "none", 4, None),
    ("122", 1, "vocab", 8, False, None, False, "none", 17, None),
    ("853", 0, "hybrid", 8, True, 10, True, "weighted_sum_sqrtn", 100000, 8192),
]


@dataclass(frozen=True)
class Selection:
    """Which tokens of a bag are kept."""

    strategy: str = "auto"
    default: str = "auto_mix"
    k: int | None = None
    non_one_ratio: float = NON_ONE_RATIO
    value_std: float = VALUE_STD
    mix_value_share: float = MIX_VALUE_SHARE


@dataclass(frozen=True)
class Feature:
    field: str
    src: int
    encoding: str
    embedding_dim: int = 8
    multi_hot: bool = False
    max_len: int | None = None
    use_value: bool = False
    pooling: str = "none"
    vocab_tokens: int | None = None
    hash_bucket: int | None = None
    vocab_offset: int = VOCAB_OFFSET
    selection: Selection | None = None

    def __post_init__(self) -> None:
        where = f"feature {self.src}/{self.field}"
        if self.encoding not in ("vocab", "hash", "hybrid"):
            raise ValueError(f"{where}: unknown encoding {self.encoding}")
        if self.has_vocab and not self.vocab_tokens:
            raise ValueError(f"{where}: a vocab head needs vocab_tokens")
        if self.has_hash and not (self.hash_bucket and self.hash_bucket > 0):
            raise ValueError(f"{where}: hashing needs a positive hash_bucket")
        if self.multi_hot and (not self.max_len or self.max_len <= 0 or self.pooling == "none"):
            raise ValueError(f"{where}: multi-hot needs max_len and a pooling")
        if not self.multi_hot and (self.max_len is not None or self.pooling != "none"):
            raise ValueError(f"{where}: single-hot takes neither max_len nor pooling")
        if self.selection and self.selection.strategy not in STRATEGIES:
            raise ValueError(f"{where}: unknown strategy {self.selection.strategy}")

    @property
    def name(self) -> str:
        return f"f{self.src}_{self.field}"

    @property
    def has_vocab(self) -> bool:
        return self.encoding in ("vocab", "hybrid")

    @property
    def has_hash(self) -> bool:
        return self.encoding in ("hash", "hybrid")

    @property
    def head_rows(self) -> int:
        """Embedding rows of the vocabulary head."""
        return self.vocab_offset + self.vocab_tokens if self.has_vocab else 0

    @property
    def total_rows(self) -> int:
        """Embedding rows the feature can point to."""
        if self.encoding == "hash":
            return HASH_OFFSET + self.hash_bucket
        return self.head_rows + (self.hash_bucket if self.encoding == "hybrid" else 0)

    @property
    def chosen(self) -> Selection:
        if self.selection is not None:
            return self.selection
        return Selection(default="auto_mix" if self.use_value else "topk_by_freq", k=self.max_len)


@dataclass(frozen=True)
class FeatureMap:
    features: tuple[Feature, ...] = dc_field(default_factory=tuple)

    def __post_init__(self) -> None:
        keys = [(f.src, f.field) for f in self.features]
        if len(set(keys)) != len(keys):
            raise ValueError("a (src, field) pair occurs twice in the feature map")

    def __iter__(self):
        return iter(self.features)

    def by_name(self) -> list[Feature]:
        return sorted(self.features, key=lambda f: f"{f.name}_idx")

    def table(self, spark: SparkSession) -> DataFrame:
        """One row per feature; at most a few dozen rows."""
        rows = []
        for f in self.features:
            s = f.chosen
            k = (s.k or f.max_len) if f.multi_hot else 1
            rows.append(
                (f.src, f.field, f.name, f.encoding, f.multi_hot, f.use_value, f.vocab_tokens, f.hash_bucket)
                + (f.vocab_offset, f.head_rows, f.total_rows, k, s.strategy, s.default)
                + (s.non_one_ratio, s.value_std, s.mix_value_share)
                + (f.embedding_dim, f.pooling, f.max_len)
            )
        schema = (
            "src tinyint, field string, name string, encoding string, multi_hot boolean, use_value boolean, "
            "vocab_tokens long, hash_bucket long, vocab_offset long, head_rows long, total_rows long, k long, "
            "strategy string, default_strategy string, non_one_ratio double, value_std double, mix_value_share double, "
            "embedding_dim int, pooling string, max_len int"
        )
        return spark.createDataFrame(rows, schema)


def default_feature_map() -> FeatureMap:
    names = (
        "field", "src", "encoding", "embedding_dim", "multi_hot",
        "max_len", "use_value", "pooling", "vocab_tokens", "hash_bucket",
    )
    return FeatureMap(tuple(Feature(**dict(zip(names, row))) for row in DEFAULT_FEATURES))


def feature_map_from(config: Mapping[str, Any]) -> FeatureMap:
    """A feature map from a parsed YAML or JSON document with ``defaults`` and ``features``."""
    defaults = config.get("defaults", {})
    vocab_policy = config.get("token_policy", {}).get("vocab", {})
    features: list[Feature] = []
    for entry in config.get("features", []):
        merged = {**defaults, **entry}
        chosen = entry.get("token_select")
        selection = None
        if chosen is not None:
            rule = chosen.get("auto_rule", {})
            selection = Selection(
                strategy=chosen.get("strategy", "auto"),
                default=chosen.get("default", "auto_mix"),
                k=chosen.get("k", entry.get("max_len")),
                non_one_ratio=rule.get("non_one_ratio_gte", NON_ONE_RATIO),
                value_std=rule.get("value_std_gte", VALUE_STD),
                mix_value_share=chosen.get("mix", {}).get("value_frac", MIX_VALUE_SHARE),
            )
        offset = merged.get("special_base_offset", vocab_policy.get("special_base_offset", VOCAB_OFFSET))
        made = Feature(
            field=str(merged["field"]),
            src=int(merged.get("src", 0)),
            encoding=str(merged["encoding"]),
            embedding_dim=int(merged.get("embedding_dim", 8)),
            multi_hot=bool(merged.get("is_multi_hot", False)),
            max_len=merged.get("max_len"),
            use_value=bool(merged.get("use_value", False)),
            pooling=merged.get("pooling") or "none",
            vocab_tokens=merged.get("vocab_num_tokens"),
            hash_bucket=merged.get("hash_bucket"),
            vocab_offset=int(offset),
            selection=selection,
        )
        declared = merged.get("vocab_num_embeddings")
        if made.has_vocab and declared is not None and int(declared) != made.head_rows:
            raise ValueError(f"feature {made.src}/{made.field}: {declared} embeddings, expected {made.head_rows}")
        features.append(made)
    return FeatureMap(tuple(features))


def load_feature_map(path: str | Path) -> FeatureMap:
    """Read a feature map from a YAML or JSON file on the driver."""
    text = Path(path).read_text(encoding="utf-8")
    if str(path).endswith(".json"):
        import json

        return feature_map_from(json.loads(text))
    import yaml

    return feature_map_from(yaml.safe_load(text))

