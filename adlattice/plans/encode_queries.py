"""Token selection, id mapping, encoded table, checks, sampling and batch packing queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlattice.functions.arrays import as_text, scaled_text, truncate
from adlattice.functions.hashing import token_bucket
from adlattice.operators import encode, packing, quality, sampling
from adlattice.plans.registry import Query
from adlattice.plans.source_queries import ODD_SQL, odd_values
from adlattice.plans.views import FEATURES, Views
from adlattice.spec import FeatureMap, Selection

BATCH = 256


def with_rule(strategy: str, default: str = "auto_mix") -> FeatureMap:
    """All bag features under another selection rule; those without values fall back to frequency."""
    rule = lambda f: Selection(strategy=strategy, default=default if f.use_value else "topk_by_freq", k=f.max_len)
    return FeatureMap(tuple(replace(f, selection=rule(f)) for f in FEATURES if f.multi_hot))


def selected(v: Views, features: FeatureMap) -> DataFrame:
    spec = features.table(v.spark)
    return encode.select_tokens(encode.prepare_bags(v.tokens, spec, v.ranks), spec)


def kept(v: Views, strategy: str, default: str = "auto_mix") -> DataFrame:
    return selected(v, with_rule(strategy, default))


def q_informative(v: Views) -> DataFrame:
    """Rule picked by the value test for every bag, by counts."""
    auto = kept(v, "auto").where("pos = 1")
    return auto.groupBy("rule").agg(F.count(F.lit(1)).alias("bags"), F.sum("distinct_tokens").alias("tokens"))


def q_single(v: Views) -> DataFrame:
    return selected(v, FeatureMap(tuple(f for f in FEATURES if not f.multi_hot)))


def ids_of(v: Views, encoding: str) -> DataFrame:
    return v.encoded.where(F.col("encoding") == encoding)


def q_token_hash(v: Views) -> DataFrame:
    """Bucket of every distinct token, also under another source and seed."""
    fids = v.tokens.select("src", "field", "fid").distinct()
    src, field, fid, m = F.col("src"), F.col("field"), F.col("fid"), F.lit(1000)
    return fids.select(
        "src", "field", "fid",
        token_bucket(src, field, fid, m).alias("bucket"),
        token_bucket(F.lit(1) - src, field, fid, m).alias("other_src"),
        token_bucket(src, field, fid, m, seed=5).alias("other_seed"),
    )


def wide_text(v: Views) -> DataFrame:
    """The encoded table with arrays as text."""
    p = v.processed
    return p.select(
        *quality.MANDATORY, "split",
        "f0_205_idx", "f0_508_idx", "f0_508_val", "f1_121_idx", "f1_129_idx", "f1_129_val",
        as_text(F.col("f0_301_idx")).alias("f0_301_idx"),
        as_text(F.col("f0_853_idx")).alias("f0_853_idx"),
        scaled_text(F.col("f0_853_val"), 1000).alias("f0_853_val"),
    )


def thinned_processed(v: Views) -> DataFrame:
    """The encoded table of tokens with whole fields missing on some rows."""
    gone = (F.col("row_id") % 3 == 0) & F.col("field").isin("853", "121", "129")
    encoded = encode.check_bounds(encode.encode_tokens(v.tokens.where(~gone), v.spec, v.ranks))
    return encode.assemble(v.split_samples, encoded, FEATURES)


def q_missing_fill(v: Views) -> DataFrame:
    p = thinned_processed(v)
    return p.select(
        "row_id", "f1_121_idx", "f1_129_idx", "f1_129_val",
        as_text(F.col("f0_853_idx")).alias("f0_853_idx"), scaled_text(F.col("f0_853_val"), 1000).alias("f0_853_val"),
    )


def encoding_stats(v: Views) -> DataFrame:
    encoded = encode.encode_tokens(odd_values(v), v.spec, v.ranks)
    return encode.encoding_stats(encoded, v.spec, v.rows(v.samples))


def q_bound_check(v: Views) -> DataFrame:
    return v.encoded.groupBy("name").agg(F.max("idx").alias("max_idx"), F.max("total_rows").alias("total_rows"), F.count_if(F.col("idx") >= F.col("total_rows")).alias("out_of_range"))


def q_truncate(v: Views) -> DataFrame:
    return v.processed.select(
        "row_id", *[as_text(truncate(F.col(f"{f.name}_idx"), f.max_len - 1)).alias(f.name) for f in FEATURES if f.multi_hot]
    )


def q_pad(v: Views) -> DataFrame:
    p = packing.pad_batches(v.processed, FEATURES, BATCH)
    return p.select("batch", "pos", "field", as_text(F.col("ids")).alias("ids"), scaled_text(F.col("weights"), 1000).alias("weights"), "length")


def q_offsets(v: Views) -> DataFrame:
    return packing.bag_offsets(v.processed, FEATURES, BATCH).withColumnRenamed("offset", "bag_offset")


def q_pack(v: Views) -> DataFrame:
    p = packing.pack_bags(v.processed, FEATURES, BATCH)
    return p.select("batch", "field", as_text(F.col("indices")).alias("indices"), as_text(F.col("offsets")).alias("offsets"), scaled_text(F.col("weights"), 1000).alias("weights"))


def report(v: Views) -> DataFrame:
    return quality.feature_report(v.processed, FEATURES)


def labels(v: Views) -> DataFrame:
    return encode.derive_labels(v.split_samples)


KEPT_COLS = "row_id:i src:i field:t fid:t pos:i"
WITH_POS = """SELECT * FROM (SELECT *, {pos} AS pos FROM informed_fx WHERE multi_hot) WHERE pos <= k"""
MIX_POS = "CASE WHEN pv <= 2 THEN pv ELSE 2 + row_number() OVER (PARTITION BY row_id, src, field, pv <= 2 ORDER BY coalesce(rank, 1000000000), fid) END"
HASH = "CAST('0x' || substr(md5({seed} || ':' || {src} || ':' || field || ':' || fid), 1, 15) AS BIGINT) % 1000"
SCALED = "array_to_string(list_transform({a}, lambda x: CAST(floor(x * 1000.0 + 0.5) AS BIGINT)), ',')"
LISTS = """SELECT row_id, name, list(idx ORDER BY pos) AS ids, list(CAST(CAST(val AS FLOAT) AS DOUBLE) ORDER BY pos) AS vals FROM encoded_fx GROUP BY row_id, name"""


WIDE_SQL = f"""
    WITH l AS ({LISTS}),
    p AS (SELECT row_id,
      max(idx) FILTER (name = 'f0_205') AS f0_205_idx, max(idx) FILTER (name = 'f0_508') AS f0_508_idx, max(CAST(val AS FLOAT)) FILTER (name = 'f0_508') AS f0_508_val,
      max(idx) FILTER (name = 'f1_121') AS f1_121_idx, max(idx) FILTER (name = 'f1_129') AS f1_129_idx, max(CAST(val AS FLOAT)) FILTER (name = 'f1_129') AS f1_129_val
      FROM encoded_fx GROUP BY row_id)
    SELECT s.row_id, s.entity_id, s.split, s.y1 AS y_ctr, s.y2 AS y_cvr, s.y1 * s.y2 AS y_ctcvr, s.y1 AS click_mask,
      coalesce(f0_205_idx, 1) AS f0_205_idx, coalesce(f0_508_idx, 1) AS f0_508_idx, coalesce(f0_508_val, 1) AS f0_508_val,
      coalesce(f1_121_idx, 1) AS f1_121_idx, coalesce(f1_129_idx, 1) AS f1_129_idx, coalesce(f1_129_val, 1) AS f1_129_val,
      coalesce(a.ids, [1]) AS f0_301_ids, coalesce(b.ids, [1]) AS f0_853_ids, coalesce(b.vals, [1.0]) AS f0_853_vals
    FROM split_fx s LEFT JOIN p ON p.row_id = s.row_id LEFT JOIN l a ON a.row_id = s.row_id AND a.name = 'f0_301' LEFT JOIN l b ON b.row_id = s.row_id AND b.name = 'f0_853'"""
WIDE_TEXT_SQL = f"""SELECT *, array_to_string(f0_301_ids, ',') AS f0_301_idx, array_to_string(f0_853_ids, ',') AS f0_853_idx, {SCALED.format(a='f0_853_vals')} AS f0_853_val FROM ({WIDE_SQL})"""
WIDE_COLS = """row_id:i entity_id:t split:t y_ctr:i y_cvr:i y_ctcvr:i click_mask:i f0_205_idx:i f0_508_idx:i f0_508_val:r f1_121_idx:i f1_129_idx:i f1_129_val:r
    f0_301_idx:t f0_853_idx:t f0_853_val:t"""

# Bags per (row, feature) in batches of 256 consecutive rows; every weight given, since two features use values.
BAG_SQL = f"""
    SELECT CAST(floor(pos / {BATCH}) AS BIGINT) AS batch, w.pos, w.row_id, w.split, w.y_ctr, w.y_cvr, v.* FROM (SELECT *, row_number() OVER (ORDER BY row_id) - 1 AS pos FROM ({WIDE_SQL})) w, LATERAL (
      SELECT 'f0_205' AS field, [f0_205_idx] AS ids, [CAST(1 AS DOUBLE)] AS weights
      UNION ALL SELECT 'f0_853', f0_853_ids, f0_853_vals
      UNION ALL SELECT 'f0_508', [f0_508_idx], [CAST(f0_508_val AS DOUBLE)]
      UNION ALL SELECT 'f0_301', f0_301_ids, list_transform(f0_301_ids, lambda x: CAST(1 AS DOUBLE))
      UNION ALL SELECT 'f1_121', [f1_121_idx], [CAST(1 AS DOUBLE)]
      UNION ALL SELECT 'f1_129', [f1_129_idx], [CAST(f1_129_val AS DOUBLE)]) v"""
OFFSET_SQL = "coalesce(sum(len(ids)) OVER (PARTITION BY batch, field ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
PACK_SQL = f"""
    SELECT batch, field, array_to_string(flatten(list(ids ORDER BY pos)), ',') AS indices, array_to_string(list(CAST(off AS BIGINT) ORDER BY pos), ',') AS offsets,
      {SCALED.format(a='flatten(list(weights ORDER BY pos))')} AS weights
    FROM (SELECT *, {OFFSET_SQL} AS off FROM ({BAG_SQL}) WHERE NOT (y_ctr = 0 AND y_cvr = 1)) GROUP BY batch, field"""
PAD_SQL = f"""
    SELECT batch, pos, field, len(ids) AS length, array_to_string(list_concat(ids, list_transform(range(0, width - len(ids)), lambda x: 0)), ',') AS ids,
      {SCALED.format(a='list_concat(weights, list_transform(range(0, width - len(ids)), lambda x: CAST(0 AS DOUBLE)))')} AS weights
    FROM (SELECT *, max(len(ids)) OVER (PARTITION BY batch, field) AS width FROM ({BAG_SQL}) WHERE field IN ('f0_853', 'f0_301'))"""

# Field totals of the encoding, from bags with the special values of the odd-value tokens.


def _on_odd_tokens(body: str) -> str:
    """``body`` with the encoding views rebuilt on the odd-value tokens."""
    from adlattice.plans.sql_views import VIEWS

    chain = ["bags_fx", "informed_fx", "selected_fx", "encoded_fx"]
    parts = [f"odd AS ({ODD_SQL})"]
    for name in chain:
        text = VIEWS[name].strip()
        text = text.replace("tokens_fx t LEFT JOIN", "odd t LEFT JOIN")
        text = text.replace("max(CAST(t.val AS DOUBLE)) AS val", "max(CASE WHEN isfinite(t.val) THEN t.val ELSE 0 END) AS val, count(*) FILTER (NOT isfinite(t.val)) AS bad")
        text = text.replace("sum(copies) OVER w AS raw_tokens", "sum(copies) OVER w AS raw_tokens, sum(bad) OVER w AS bad_tokens")
        for other in chain:
            text = text.replace(other, "odd_" + other.removesuffix("_fx"))
        parts.append(f"odd_{name.removesuffix('_fx')} AS ({text})")
    return "WITH " + ", ".join(parts) + " " + body.replace("encoded_fx", "odd_encoded")


STATS_SQL = _on_odd_tokens("""
    SELECT s.name, s.multi_hot, (SELECT count(*) FROM samples_fx) AS rows, coalesce(token_rows, 0) AS token_rows, (SELECT count(*) FROM samples_fx) - coalesce(token_rows, 0) AS missing,
      oov, tail_fallback, total_tokens, nan_inf_tokens, kept + (SELECT count(*) FROM samples_fx) - token_rows AS len_sum, max_idx, retained_sum, by_auto_mix, by_freq, 0 AS by_value
    FROM spec_fx s LEFT JOIN (SELECT name, count(*) FILTER (pos = 1) AS token_rows, count(*) FILTER (is_oov) AS oov, count(*) FILTER (is_tail) AS tail_fallback,
        sum(raw_tokens) FILTER (pos = 1) AS total_tokens, sum(bad_tokens) FILTER (pos = 1) AS nan_inf_tokens, count(*) AS kept, max(idx) AS max_idx,
        sum(least(distinct_tokens, k) / distinct_tokens) FILTER (pos = 1) AS retained_sum,
        count(*) FILTER (pos = 1 AND rule = 'auto_mix') AS by_auto_mix, count(*) FILTER (pos = 1 AND rule = 'topk_by_freq') AS by_freq
      FROM encoded_fx GROUP BY name) e ON s.name = e.name""")
STATS_COLS = "name:t rows:i token_rows:i missing:i oov:i tail_fallback:i total_tokens:i nan_inf_tokens:i len_sum:i max_idx:i retained_sum:r by_auto_mix:i by_freq:i by_value:i"
RATES_SQL = f"""SELECT name, nan_inf_tokens / total_tokens AS nan_inf_rate, tail_fallback / total_tokens AS tail_fallback_rate, by_auto_mix / token_rows AS auto_mix_rate,
    by_freq / token_rows AS topk_by_freq_rate, 0 AS topk_by_value_rate, CASE WHEN multi_hot THEN retained_sum / token_rows END AS avg_retained_frac, max_idx FROM (SELECT * FROM ({STATS_SQL}))"""

# All ids of the encoded table: the kept tokens, and one missing id per sample without any.
FILLED_SQL = """
    SELECT name, encoding, use_value, idx, CAST(CAST(val AS FLOAT) AS DOUBLE) AS v FROM encoded_fx
    UNION ALL SELECT p.name, p.encoding, p.use_value, 1, CAST(1 AS DOUBLE) FROM spec_fx p CROSS JOIN samples_fx s
    WHERE NOT EXISTS (SELECT 1 FROM encoded_fx e WHERE e.name = p.name AND e.row_id = s.row_id)"""

DRAW = "CAST(CAST('0x' || substr(md5('{seed}:' || row_id), 1, 15) AS BIGINT) AS DOUBLE) / CAST(1152921504606846976 AS DOUBLE)"
LABEL_SQL = "SELECT row_id, split, y1 AS y_ctr, y2 AS y_cvr FROM split_fx"

QUERIES = [
    Query("select_by_frequency", "E3", KEPT_COLS, lambda v: kept(v, "topk_by_freq"), WITH_POS.format(pos="pf")),
    Query("select_by_value", "E4", KEPT_COLS, lambda v: kept(v, "topk_by_value"), WITH_POS.format(pos="pv")),
    Query("value_rule", "E5", "rule:t bags:i tokens:i", q_informative,
          "SELECT rule, count(*) AS bags, sum(distinct_tokens) AS tokens FROM informed_fx WHERE multi_hot AND pv = 1 GROUP BY rule"),
    Query("select_auto_mix", "E6", KEPT_COLS, lambda v: kept(v, "auto_mix"), WITH_POS.format(pos=MIX_POS)),
    Query("select_auto", "E7", KEPT_COLS + " rule:t retained_frac:r", lambda v: kept(v, "auto", "topk_by_value"),
          """SELECT row_id, src, field, fid, pos, rule, least(distinct_tokens, k) / distinct_tokens AS retained_frac FROM (
               SELECT * EXCLUDE (rule), CASE rule WHEN 'auto_mix' THEN 'topk_by_value' ELSE rule END AS rule, CASE rule WHEN 'auto_mix' THEN pv ELSE pf END AS pos FROM informed_fx WHERE multi_hot) WHERE pos <= k"""),
    Query("single_hot_pick", "E8", "row_id:i src:i field:t fid:t val:r", q_single, "SELECT row_id, src, field, fid, val FROM informed_fx WHERE NOT multi_hot AND ps = 1"),
    Query("token_hash", "H3", "src:i field:t fid:t bucket:i other_src:i other_seed:i", q_token_hash,
          f"SELECT src, field, fid, {HASH.format(seed=17, src='src')} AS bucket, {HASH.format(seed=17, src='(1 - src)')} AS other_src, {HASH.format(seed=5, src='src')} AS other_seed FROM (SELECT DISTINCT src, field, fid FROM tokens_fx)"),
    Query("vocab_ids", "H4", "row_id:i name:t pos:i idx:i is_oov:b", lambda v: ids_of(v, "vocab"), "SELECT * FROM encoded_fx WHERE encoding = 'vocab'"),
    Query("hash_ids", "H5", "row_id:i name:t pos:i idx:i is_oov:b", lambda v: ids_of(v, "hash"), "SELECT * FROM encoded_fx WHERE encoding = 'hash'"),
    Query("hybrid_ids", "H6", "row_id:i name:t pos:i idx:i is_tail:b", lambda v: ids_of(v, "hybrid"), "SELECT * FROM encoded_fx WHERE encoding = 'hybrid'"),
    Query("missing_fill", "H7", "row_id:i f1_121_idx:i f1_129_idx:i f1_129_val:r f0_853_idx:t f0_853_val:t", q_missing_fill,
          f"""SELECT row_id, CASE WHEN row_id % 3 = 0 THEN 1 ELSE f1_121_idx END AS f1_121_idx, CASE WHEN row_id % 3 = 0 THEN 1 ELSE f1_129_idx END AS f1_129_idx,
               CASE WHEN row_id % 3 = 0 THEN 1.0 ELSE f1_129_val END AS f1_129_val, CASE WHEN row_id % 3 = 0 THEN '1' ELSE f0_853_idx END AS f0_853_idx,
               CASE WHEN row_id % 3 = 0 THEN '1000' ELSE f0_853_val END AS f0_853_val FROM ({WIDE_TEXT_SQL})"""),
    Query("id_bounds", "H8", "name:t max_idx:i total_rows:i out_of_range:i", q_bound_check,
          "SELECT name, max(idx) AS max_idx, max(total_rows) AS total_rows, 0 AS out_of_range FROM encoded_fx GROUP BY name"),
    Query("processed_rows", "H18 B13", WIDE_COLS, wide_text, WIDE_TEXT_SQL),
    Query("encoding_stats", "D32", STATS_COLS, encoding_stats, STATS_SQL),
    Query("encoding_rates", "D33", "name:t nan_inf_rate:r tail_fallback_rate:r auto_mix_rate:r topk_by_freq_rate:r topk_by_value_rate:r avg_retained_frac:r max_idx:i", lambda v: encode.encoding_rates(encoding_stats(v)), RATES_SQL),
    Query("array_truncate", "H12", "row_id:i f0_853:t f0_301:t", q_truncate,
          f"SELECT row_id, array_to_string(f0_853_ids[1:2], ',') AS f0_853, array_to_string(f0_301_ids[1:1], ',') AS f0_301 FROM ({WIDE_SQL})"),
    Query("padded_batches", "H13 R2", "batch:i pos:i field:t ids:t weights:t length:i", q_pad, PAD_SQL),
    Query("bag_offsets", "E9", "batch:i pos:i field:t bag_offset:i", q_offsets, f'SELECT batch, pos, field, {OFFSET_SQL} AS bag_offset FROM ({BAG_SQL})'),
    Query("packed_bags", "R1", "batch:i field:t indices:t offsets:t weights:t", q_pack, PACK_SQL),
    Query("oov_check", "Q2", "name:t oov_rate:r failed:b", lambda v: quality.oov_check(report(v)),
          f"""SELECT name, avg(CASE WHEN idx = 2 THEN 1.0 ELSE 0.0 END) AS oov_rate, avg(CASE WHEN idx = 2 THEN 1.0 ELSE 0.0 END) > 0.95 AS failed FROM ({FILLED_SQL}) WHERE encoding <> 'hash' GROUP BY name"""),
    Query("value_check", "Q3", "name:t ids:i non_one:i failed:b", lambda v: quality.value_check(report(v)),
          f"SELECT name, count(*) AS ids, count(*) FILTER (abs(v - 1) > 1e-6) AS non_one, count(*) FILTER (abs(v - 1) > 1e-6) = 0 AS failed FROM ({FILLED_SQL}) WHERE use_value GROUP BY name"),
    Query("overflow_check", "Q4", "name:t max_idx:i total_rows:i failed:b", lambda v: quality.overflow_check(report(v)),
          "SELECT name, max(idx) AS max_idx, max(total_rows) AS total_rows, max(idx) >= max(total_rows) AS failed FROM encoded_fx GROUP BY name"),
    Query("row_reconciliation", "Q5", "processed_rows:i samples_rows:i matches:b", lambda v: quality.row_reconciliation(v.processed, v.samples),
          "SELECT count(*) AS processed_rows, count(*) AS samples_rows, true AS matches FROM samples_fx"),
    Query("contract_check", "Q6", "rule:t violations:i passed:b",
          lambda v: quality.contract_check(v.processed.withColumn("y_cvr", F.when(F.col("row_id") % 100 == 0, 2).otherwise(F.col("y_cvr")))),
          """SELECT 'columns present' AS rule, 0 AS violations, true AS passed UNION ALL SELECT 'y_ctr in {0,1}', 0, true UNION ALL SELECT 'y_ctcvr in {0,1}', 0, true UNION ALL SELECT 'click_mask in {0,1}', 0, true
             UNION ALL SELECT 'row_id unique', 0, true UNION ALL SELECT 'y_cvr in {0,1}', count(*) FILTER (row_id % 100 = 0), false FROM samples_fx"""),
    Query("negative_sampling", "L1", "row_id:i split:t y_ctr:i", lambda v: sampling.keep_negatives(labels(v), 0.3, 11),
          f"SELECT * FROM ({LABEL_SQL}) WHERE split <> 'train' OR y_ctr > 0 OR {DRAW.format(seed=11)} <= CAST(0.3 AS DOUBLE)"),
    Query("ratio_subset", "L2", "row_id:i split:t", lambda v: sampling.ratio_subset(labels(v).where("split = 'valid'"), 0.25),
          f"SELECT * FROM ({LABEL_SQL}) WHERE split = 'valid' AND {DRAW.format(seed=2026)} <= CAST(0.25 AS DOUBLE)"),
    Query("max_samples", "L3", "row_id:i", lambda v: sampling.first_samples(sampling.ratio_subset(labels(v), 0.5), 500),
          f"SELECT row_id FROM ({LABEL_SQL}) WHERE {DRAW.format(seed=2026)} <= CAST(0.5 AS DOUBLE) ORDER BY row_id LIMIT 500"),
]
