"""Profiles, drift, vocabulary, shape and feature advice queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlattice.functions.arrays import scaled_text
from adlattice.operators import profile as pf
from adlattice.operators import shape, vocab
from adlattice.operators.split import split_tokens
from adlattice.operators.tokens import FIELD_KEY, token_counts
from adlattice.plans.registry import Query
from adlattice.plans.source_queries import ODD_SQL, odd_values
from adlattice.plans.views import Views
from adlattice.spec import default_feature_map

WORD_HEADS = [10, 100, 1_000, 5_000, 20_000]
MIN_SUPPORT = 20


def stats(v: Views) -> DataFrame:
    """Training field stats: a handful of lines that several steps read, so written once."""
    return v.once("stats", lambda: pf.field_stats(v.tokens_of("train"), v.rows(v.samples_of("train"))))


def top(v: Views, split: str, k: int) -> DataFrame:
    return pf.field_top_k(token_counts(v.tokens_of(split)), k)


def q_lift(v: Views) -> DataFrame:
    tokens, samples = v.tokens_of("train"), v.samples_of("train")
    best = pf.field_top_k(token_counts(tokens), 200)
    return pf.fid_lift(pf.labelled_top_tokens(tokens, best, samples), samples, MIN_SUPPORT)


def q_labelled(v: Views) -> DataFrame:
    tokens, samples = v.tokens_of("valid"), v.samples_of("valid")
    best = pf.field_top_k(token_counts(tokens), 5)
    return pf.labelled_top_tokens(tokens, best, samples)


def drift(v: Views) -> DataFrame:
    """Drift where field 301 is cut from the valid side, so that one key is missing there."""
    train, valid = v.side("train"), v.side("valid").where("field <> '301'")
    coverage = pf.coverage_drift(train, valid, v.rows(v.samples_of("train")), v.rows(v.samples_of("valid")))
    jaccard = pf.top_jaccard(pf.field_top_k(token_counts(train), 100), pf.field_top_k(token_counts(valid), 100))
    return pf.drift_summary(coverage, jaccard)


def q_key_sets(v: Views) -> DataFrame:
    a = pf.field_top_k(token_counts(v.words_of("train")), 100)
    b = pf.field_top_k(token_counts(v.words_of("valid")), 100)
    return pf.key_sets(a, b)


def word_frequency(v: Views) -> DataFrame:
    return vocab.train_frequency(v.words_of("train"))


def oov(v: Views) -> DataFrame:
    return vocab.oov_curves(v.words_of("valid"), word_frequency(v), WORD_HEADS)


def q_rank_join(v: Views) -> DataFrame:
    joined = vocab.ranked_tokens(v.words_of("valid"), word_frequency(v))
    return joined.select("row_id", "field", "src", "fid", "rnk")


def lengths(v: Views) -> DataFrame:
    return shape.bag_lengths(v.tokens_of("train"), shape.multi_hot_fields(stats(v)))


def length_quantiles(v: Views) -> DataFrame:
    return shape.length_quantiles(lengths(v), v.rows(v.samples_of("train")))


def value_fields(v: Views) -> DataFrame:
    return shape.informative_fields(stats(v))


def cube(v: Views) -> DataFrame:
    return v.once("cube", lambda: shape.value_cube(split_tokens(v.tokens, v.split_samples)))


def edges(v: Views) -> DataFrame:
    return v.once("edges", lambda: shape.cube_edges(cube(v), shape.cube_fields(cube(v))))


def histogram(v: Views) -> DataFrame:
    return shape.cube_histogram(cube(v), edges(v))


def q_value_profile(v: Views) -> DataFrame:
    """Both sides of tokens with NaN and infinite values."""
    odd = shape.value_cube(split_tokens(odd_values(v), v.split_samples))
    return shape.cube_profile(odd, shape.cube_fields(odd))


def word_stats(v: Views) -> DataFrame:
    return v.once("word_stats", lambda: pf.field_stats(v.words, v.rows(v.table("documents"))))


def bucket_advice(v: Views) -> DataFrame:
    base = word_stats(v)
    return shape.bucket_advice(shape.token_share(base), shape.collision_curve(base))


def max_len(v: Views) -> DataFrame:
    bags = lengths(v)
    quantiles = shape.length_quantiles(bags, v.rows(v.samples_of("train")))
    return shape.max_len_advice(shape.token_share(stats(v)), shape.truncation_curve(bags), quantiles)


def q_advice(v: Views) -> DataFrame:
    base = stats(v)
    frequency = vocab.train_frequency(v.side("train"))
    hints = vocab.encoding_advice(vocab.oov_curves(v.side("valid"), frequency))
    buckets = shape.bucket_advice(shape.token_share(base), shape.collision_curve(base))
    known = default_feature_map().table(v.spark).where("field <> '129'")
    return shape.feature_advice(base, hints, buckets, max_len(v), known)


def q_metric_frame(v: Views) -> DataFrame:
    """Token, row and distinct-fid totals of the valid side merged on (field, src)."""
    valid = v.words_of("valid")
    counts = token_counts(valid).groupBy(*FIELD_KEY).agg(F.sum("cnt").alias("total_tokens"), F.count(F.lit(1)).alias("total_distinct"))
    rows = pf.row_coverage(valid).withColumnRenamed("row_coverage", "total_rows")
    return counts.join(rows, FIELD_KEY, "left")


def q_sanity(v: Views) -> DataFrame:
    from adlattice.operators import split as sp

    return pf.sanity_report(v.split_samples, v.tokens, sp.split_tokens(v.tokens, v.split_samples))


STATS_SQL = """
    SELECT field, src, count(*) AS token_rows, count(DISTINCT row_id) AS row_coverage,
      count(DISTINCT row_id) / (SELECT count(*) FROM split_fx WHERE split = 'train') AS coverage_rate,
      count(*) / count(DISTINCT row_id) AS avg_nnz_per_covered_row, count(DISTINCT fid) AS fid_distinct,
      avg(CASE WHEN val <> 1 THEN 1.0 ELSE 0.0 END) AS val_non1_ratio, min(val) AS val_min, max(val) AS val_max,
      avg(CAST(val AS DOUBLE)) AS val_mean, 1 - count(DISTINCT (row_id, fid)) / count(*) AS dup_rate
    FROM split_tokens_fx WHERE split = 'train' GROUP BY field, src"""
TOP_SQL = """
    SELECT field, src, fid, cnt, rn, cnt / sum_cnt AS topk_coverage FROM (
      SELECT field, src, fid, count(*) AS cnt, row_number() OVER (PARTITION BY field, src ORDER BY count(*) DESC, fid) AS rn,
        sum(count(*)) OVER (PARTITION BY field, src) AS sum_cnt
      FROM {source} GROUP BY field, src, fid) WHERE rn <= {k}"""
LABELLED_SQL = """
    SELECT DISTINCT t.row_id, t.field, t.src, t.fid, s.y1, s.y2 FROM split_tokens_fx t
    JOIN ({top}) k ON t.field = k.field AND t.src = k.src AND t.fid = k.fid JOIN samples_fx s ON t.row_id = s.row_id WHERE t.split = '{split}'"""


def _top(split: str, k: int, table: str = "split_tokens_fx") -> str:
    return TOP_SQL.format(source=f"(SELECT * FROM {table} WHERE split = '{split}')", k=k)


DRIFT_SQL = f"""
    SELECT field, src, coalesce(a.r, 0) AS coverage_train, coalesce(b.r, 0) AS coverage_valid,
      coalesce(a.r, 0) - coalesce(b.r, 0) AS coverage_diff, coalesce(j.jac, 1) AS topk_jaccard
    FROM (SELECT field, src, count(DISTINCT row_id) / (SELECT count(*) FROM split_fx WHERE split = 'train') AS r FROM split_tokens_fx WHERE split = 'train' GROUP BY field, src) a
    FULL OUTER JOIN (SELECT field, src, count(DISTINCT row_id) / (SELECT count(*) FROM split_fx WHERE split = 'valid') AS r FROM split_tokens_fx WHERE split = 'valid' AND field <> '301' GROUP BY field, src) b USING (field, src)
    LEFT JOIN (SELECT field, src, count(*) FILTER (x.fid IS NOT NULL AND y.fid IS NOT NULL) / count(*) AS jac
      FROM ({_top('train', 100)}) x FULL OUTER JOIN (SELECT * FROM ({_top('valid', 100)}) WHERE field <> '301') y USING (field, src, fid) GROUP BY field, src) j USING (field, src)"""

WORD_RANK_SQL = """
    SELECT field, src, fid, row_number() OVER (PARTITION BY field, src ORDER BY count(*) DESC, fid) AS rnk
    FROM split_words_fx WHERE split = 'train' GROUP BY field, src, fid"""
WORD_JOIN_SQL = f"""
    SELECT w.row_id, w.field, w.src, w.fid, coalesce(r.rnk, 999999999) AS rnk FROM split_words_fx w
    LEFT JOIN ({WORD_RANK_SQL}) r ON w.field = r.field AND w.src = r.src AND w.fid = r.fid WHERE w.split = 'valid'"""


def _curve_sql(lines: str, level: str, out: str, heads: list[int]) -> str:
    values = ", ".join(f"({n})" for n in heads)
    return f"""SELECT field, src, n AS head_size, avg(CASE WHEN {level} > n THEN 1.0 ELSE 0.0 END) AS {out}
        FROM ({lines}) CROSS JOIN (VALUES {values}) h(n) GROUP BY field, src, n"""


def _curves_sql(joined: str, heads: list[int]) -> str:
    by_row = f"SELECT field, src, row_id, max(rnk) AS worst FROM ({joined}) GROUP BY field, src, row_id"
    by_fid = f"SELECT field, src, fid, min(rnk) AS best FROM ({joined}) GROUP BY field, src, fid"
    return f"""SELECT * FROM ({_curve_sql(joined, 'rnk', 'oov_token_rate', heads)})
        JOIN ({_curve_sql(by_row, 'worst', 'oov_row_rate', heads)}) USING (field, src, head_size)
        JOIN ({_curve_sql(by_fid, 'best', 'new_value_rate', heads)}) USING (field, src, head_size)"""


ADVICE_OF_CURVES = """
    SELECT field, src, coalesce(good, ok) AS recommended_head_size,
      CASE WHEN good <= 50000 THEN 'vocab' WHEN coalesce(good, ok) IS NOT NULL THEN 'hybrid' ELSE 'hash' END AS recommended_encoding
    FROM (SELECT field, src, min(head_size) FILTER (oov_row_rate <= 0.02 AND new_value_rate <= 0.05) AS good, min(head_size) FILTER (oov_row_rate <= 0.05) AS ok
      FROM ({curves}) GROUP BY field, src)"""

LENGTH_SQL = f"""
    SELECT row_id, field, src, count(*) AS l FROM split_tokens_fx
    WHERE split = 'train' AND (field, src) IN (SELECT (field, src) FROM ({STATS_SQL}) WHERE avg_nnz_per_covered_row > 1.5) GROUP BY row_id, field, src"""
TRUNC_SQL = f"""
    SELECT field, src, k, sum(least(l, k)) / sum(l) AS retained_token_frac, avg(CASE WHEN l <= k THEN 1.0 ELSE 0.0 END) AS retained_row_full_frac
    FROM ({LENGTH_SQL}) CROSS JOIN (VALUES (10), (20), (30), (40), (60), (80), (120), (200)) v(k) GROUP BY field, src, k"""
WORD_STATS_SQL = """
    SELECT field, src, count(*) AS token_rows, count(DISTINCT fid) AS fid_distinct, count(*) / (SELECT count(*) FROM words_fx) AS token_share FROM words_fx GROUP BY field, src"""
BUCKETS_SQL = "(VALUES (8192), (16384), (32768), (65536), (131072), (262144), (524288), (1048576), (2097152), (4194304)) m(bucket)"


def _collision_sql(source: str) -> str:
    n, m = "CAST(fid_distinct AS DOUBLE)", "CAST(bucket AS DOUBLE)"
    occupied = f"{m} * (1 - exp(-{n} / {m}))"
    return f"""SELECT field, src, fid_distinct, bucket, token_share, {occupied} AS expected_occupied, greatest(0, {n} - {occupied}) AS expected_collision,
        greatest(0, {n} - {occupied}) / {n} AS collision_rate FROM ({source}) CROSS JOIN {BUCKETS_SQL}"""


def _bucket_sql(source: str) -> str:
    local = "CASE WHEN token_share >= 0.2 THEN 0.02 WHEN token_share >= 0.05 THEN 0.05 ELSE 0.10 END"
    online = "CASE WHEN token_share >= 0.2 THEN 0.01 WHEN token_share >= 0.05 THEN 0.02 ELSE 0.05 END"
    return f"""SELECT field, src, fid_distinct, token_share, {local} AS threshold_local, {online} AS threshold_online,
        coalesce(min(bucket) FILTER (collision_rate < {local}), max(bucket)) AS bucket_local,
        coalesce(min(bucket) FILTER (collision_rate < {online}), max(bucket)) AS bucket_online
        FROM ({_collision_sql(source)}) GROUP BY field, src, fid_distinct, token_share"""


SHARE_SQL = f"SELECT *, token_rows / sum(token_rows) OVER () AS token_share FROM ({STATS_SQL})"
VALUE_FIELDS = f"(field, src) IN (SELECT (field, src) FROM ({STATS_SQL}) WHERE val_non1_ratio > 0)"
EDGES_SQL = f"""
    SELECT field, src, list_sort(list_distinct(quantile_cont(CAST(val AS DOUBLE), [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))) AS edges
    FROM split_tokens_fx WHERE split = 'train' AND {VALUE_FIELDS} GROUP BY field, src"""
HIST_SQL = f"""
    WITH e AS ({EDGES_SQL}),
    binned AS (SELECT t.field, t.src, t.split, len(list_filter(e.edges, lambda x: x <= CAST(t.val AS DOUBLE))) AS bin
      FROM split_tokens_fx t JOIN e ON t.field = e.field AND t.src = e.src),
    counted AS (SELECT field, src, bin, count(*) FILTER (split = 'train') AS a, count(*) FILTER (split = 'valid') AS b FROM binned GROUP BY field, src, bin),
    totals AS (SELECT field, src, sum(a) AS na, sum(b) AS nb FROM counted GROUP BY field, src),
    bins AS (SELECT field, src, unnest(generate_series(0, len(edges))) AS bin FROM e)
    SELECT bins.field, bins.src, bins.bin, coalesce(a, 0) / na AS train_frac, coalesce(b, 0) / nb AS valid_frac
    FROM bins JOIN totals ON bins.field = totals.field AND bins.src = totals.src
    LEFT JOIN counted ON bins.field = counted.field AND bins.src = counted.src AND bins.bin = counted.bin"""
QUANT_SQL = f"""
    SELECT field, src, count(*) AS covered_rows, count(*) / (SELECT count(*) FROM split_fx WHERE split = 'train') AS coverage_rate, avg(l) AS mean_len,
      quantile_cont(l, 0.5) AS p50, quantile_cont(l, 0.9) AS p90, quantile_cont(l, 0.95) AS p95, quantile_cont(l, 0.99) AS p99 FROM ({LENGTH_SQL}) GROUP BY field, src"""
MAX_LEN_SQL = f"""
    SELECT field, src, coalesce(min(k) FILTER (k <= cap AND retained_token_frac >= 0.995 AND retained_row_full_frac >= 0.95),
        min(k) FILTER (k <= cap AND pos = 1)) AS max_len FROM (
      SELECT t.*, CASE WHEN token_share >= 0.2 THEN 60 ELSE 80 END AS cap,
        row_number() OVER (PARTITION BY t.field, t.src, k <= CASE WHEN token_share >= 0.2 THEN 60 ELSE 80 END ORDER BY retained_token_frac DESC, retained_row_full_frac DESC, k) AS pos
      FROM ({TRUNC_SQL}) t JOIN ({SHARE_SQL}) s ON t.field = s.field AND t.src = s.src) GROUP BY field, src"""
PROFILE_PART = """
    count(*) FILTER (split = '{s}') AS {s}_total, avg(CASE WHEN val = 0 THEN 1.0 ELSE 0.0 END) FILTER (split = '{s}') AS {s}_zero_ratio,
    avg(CASE WHEN val < 0 THEN 1.0 ELSE 0.0 END) FILTER (split = '{s}') AS {s}_neg_ratio,
    avg(CASE WHEN isnan(val) THEN 1.0 ELSE 0.0 END) FILTER (split = '{s}') AS {s}_nan_ratio, avg(CASE WHEN isinf(val) THEN 1.0 ELSE 0.0 END) FILTER (split = '{s}') AS {s}_inf_ratio,
    max(val) FILTER (split = '{s}' AND isfinite(val)) AS {s}_max, quantile_cont(val, 0.5) FILTER (split = '{s}' AND isfinite(val)) AS {s}_p50,
    quantile_cont(val, 0.9) FILTER (split = '{s}' AND isfinite(val)) AS {s}_p90, quantile_cont(val, 0.99) FILTER (split = '{s}' AND isfinite(val)) AS {s}_p99"""
OLD_SQL = """(VALUES ('508', 0, false, true, NULL, 'none', 8), ('301', 0, false, false, NULL, 'none', 8), ('205', 0, false, false, NULL, 'none', 4),
      ('121', 1, false, false, NULL, 'none', 8), ('853', 0, true, true, 10, 'weighted_sum_sqrtn', 8)) o(field, src, old_multi, old_value, old_len, old_pooling, old_dim)"""
TOKEN_RANK_JOIN = """
    SELECT w.row_id, w.field, w.src, w.fid, coalesce(r.rnk, 999999999) AS rnk FROM split_tokens_fx w LEFT JOIN (
      SELECT field, src, fid, row_number() OVER (PARTITION BY field, src ORDER BY count(*) DESC, fid) AS rnk FROM split_tokens_fx WHERE split = 'train' GROUP BY field, src, fid) r
    ON w.field = r.field AND w.src = r.src AND w.fid = r.fid WHERE w.split = 'valid'"""
DEFAULT_HEADS = [1000, 5000, 20000, 100000, 200000]
ADVICE_SQL = f"""
    SELECT field, src, encoding, CASE WHEN pos <= 3 THEN least(dim, 8) ELSE dim END AS embedding_dim, len IS NOT NULL AS is_multi_hot, len AS max_len, val AS use_value,
      CASE WHEN len IS NOT NULL AND val AND pooling NOT LIKE '%weighted%' THEN 'weighted_sum_sqrtn' ELSE pooling END AS pooling,
      CASE WHEN encoding <> 'hash' THEN recommended_head_size END AS vocab_num_tokens, CASE WHEN encoding <> 'vocab' THEN bucket_local END AS hash_bucket
    FROM (SELECT s.field, s.src, h.recommended_encoding AS encoding, h.recommended_head_size, b.bucket_local, coalesce(o.old_dim, 16) AS dim,
        row_number() OVER (ORDER BY s.token_share DESC, s.field, s.src) AS pos,
        CASE WHEN coalesce(o.old_multi, false) OR s.avg_nnz_per_covered_row > 1.5 THEN coalesce(m.max_len, least(CASE WHEN s.token_share >= 0.2 THEN 60 ELSE 80 END, o.old_len)) END AS len,
        coalesce(o.old_value, s.val_non1_ratio > 0) AS val, coalesce(o.old_pooling, 'sum_sqrtn') AS pooling
      FROM ({SHARE_SQL}) s
      LEFT JOIN ({ADVICE_OF_CURVES.format(curves=_curves_sql(TOKEN_RANK_JOIN, DEFAULT_HEADS))}) h ON s.field = h.field AND s.src = h.src
      LEFT JOIN ({_bucket_sql(SHARE_SQL)}) b ON s.field = b.field AND s.src = b.src
      LEFT JOIN ({MAX_LEN_SQL}) m ON s.field = m.field AND s.src = m.src
      LEFT JOIN {OLD_SQL} ON s.field = o.field AND s.src = o.src)"""
FREQ_SQL = "SELECT entity_id, count(*) AS cnt FROM samples_fx GROUP BY entity_id"
NNZ_SQL = "SELECT row_id, count(*) AS nnz FROM tokens_fx GROUP BY row_id"
EDGE_ROWS = """(VALUES (0, 10), (10, 20), (20, 50), (50, 100), (100, 200), (200, 500), (500, 1000), (1000, 2000), (2000, 5000), (5000, 10000), (10000, 20000), (20000, NULL)) e(bin_left, bin_right)"""

STAT_COLS = "field:t src:i token_rows:i row_coverage:i coverage_rate:r avg_nnz_per_covered_row:r fid_distinct:i val_non1_ratio:r val_min:r val_max:r val_mean:r dup_rate:r"
PROFILE_COLS = " ".join(f"{s}_{n}:{k}" for s in ("train", "valid") for n, k in (
    ("total", "i"), ("zero_ratio", "r"), ("neg_ratio", "r"), ("nan_ratio", "r"), ("inf_ratio", "r"), ("max", "r"), ("p50", "r"), ("p90", "r"), ("p99", "r")))

QUERIES = [
    Query("samples_profile", "D2", "rows:i ctr:r cvr:r cvr_click:r funnel_anomaly:i unique_entity:i", lambda v: pf.samples_profile(v.samples),
          """SELECT count(*) AS rows, avg(y1) AS ctr, avg(y2) AS cvr, sum(y1 * y2) / sum(y1) AS cvr_click, count(*) FILTER (y2 = 1 AND y1 = 0) AS funnel_anomaly,
             count(DISTINCT entity_id) AS unique_entity FROM samples_fx"""),
    Query("entity_frequency", "D3", "entity_id:t cnt:i coverage:r", lambda v: pf.entity_frequency(v.samples),
          "SELECT entity_id, count(*) AS cnt, count(*) / (SELECT count(*) FROM samples_fx) AS coverage FROM samples_fx GROUP BY entity_id"),
    Query("entity_frequency_quantiles", "D4", "p50:r p90:r p99:r", lambda v: pf.entity_frequency_quantiles(v.samples),
          f"SELECT quantile_cont(cnt, 0.5) AS p50, quantile_cont(cnt, 0.9) AS p90, quantile_cont(cnt, 0.99) AS p99 FROM ({FREQ_SQL})"),
    Query("top_entity_coverage", "D5", "unique_entity:i top_entities:i top_coverage:r", lambda v: pf.top_share_coverage(v.samples),
          f"""SELECT max(n) AS unique_entity, max(top) AS top_entities, sum(cnt) FILTER (rn <= top) / sum(cnt) AS top_coverage FROM (
                SELECT cnt, row_number() OVER (ORDER BY cnt DESC) AS rn, count(*) OVER () AS n, greatest(1, ceil(count(*) OVER () * 0.01)) AS top FROM ({FREQ_SQL}))"""),
    Query("row_length_quantiles", "D6", "p50:r p90:r p99:r", lambda v: pf.row_length_quantiles(v.tokens),
          f"SELECT quantile_cont(nnz, 0.5) AS p50, quantile_cont(nnz, 0.9) AS p90, quantile_cont(nnz, 0.99) AS p99 FROM ({NNZ_SQL})"),
    Query("row_length_histogram", "D7", "bin_left:r bin_right:r count_rows:i ratio_rows:r", lambda v: pf.row_length_histogram(v.tokens),
          f"""SELECT bin_left, bin_right, count(nnz) AS count_rows, count(nnz) / (SELECT count(*) FROM ({NNZ_SQL})) AS ratio_rows
              FROM {EDGE_ROWS} LEFT JOIN ({NNZ_SQL}) n ON nnz >= bin_left AND (bin_right IS NULL OR nnz < bin_right) GROUP BY bin_left, bin_right"""),
    Query("word_length_histogram", "D7", "bin_left:r bin_right:r count_rows:i ratio_rows:r", lambda v: pf.row_length_histogram(v.words),
          f"""SELECT bin_left, bin_right, count(nnz) AS count_rows, count(nnz) / (SELECT count(DISTINCT row_id) FROM words_fx) AS ratio_rows
              FROM {EDGE_ROWS} LEFT JOIN (SELECT row_id, count(*) AS nnz FROM words_fx GROUP BY row_id) n ON nnz >= bin_left AND (bin_right IS NULL OR nnz < bin_right) GROUP BY bin_left, bin_right"""),
    Query("field_stats", "D8", STAT_COLS, stats, STATS_SQL),
    Query("multi_hot_fields", "B11", "field:t src:i", lambda v: shape.multi_hot_fields(stats(v)), f"SELECT field, src FROM ({STATS_SQL}) WHERE avg_nnz_per_covered_row > 1.5"),
    Query("informative_fields", "B12", "field:t src:i", value_fields, f"SELECT field, src FROM ({STATS_SQL}) WHERE val_non1_ratio > 0"),
    Query("field_top_k", "D9", "field:t src:i fid:t cnt:i rn:i topk_coverage:r", lambda v: top(v, "train", 200), _top("train", 200)),
    Query("word_top_k", "D9", "field:t src:i fid:t cnt:i rn:i topk_coverage:r", lambda v: pf.field_top_k(token_counts(v.words), 50), TOP_SQL.format(source="words_fx", k=50)),
    Query("labelled_top_tokens", "C8 G1", "row_id:i field:t src:i fid:t y1:i y2:i", q_labelled, LABELLED_SQL.format(top=_top("valid", 5), split="valid")),
    Query("fid_lift", "D10", "field:t src:i fid:t cnt_rows:i ctr_fid:r cvr_fid:r lift_ctr:r lift_cvr:r", q_lift,
          f"""SELECT field, src, fid, count(*) AS cnt_rows, avg(y1) AS ctr_fid, avg(y2) AS cvr_fid,
                avg(y1) / (SELECT avg(y1) FROM split_fx WHERE split = 'train') AS lift_ctr, avg(y2) / (SELECT avg(y2) FROM split_fx WHERE split = 'train') AS lift_cvr
              FROM ({LABELLED_SQL.format(top=_top("train", 200), split="train")}) GROUP BY field, src, fid HAVING count(*) >= {MIN_SUPPORT}"""),
    Query("coverage_drift", "D11 C12", "field:t src:i coverage_train:r coverage_valid:r coverage_diff:r topk_jaccard:r", drift, DRIFT_SQL),
    Query("top_jaccard", "D12 G2", "field:t src:i union_size:i inter_size:i", q_key_sets,
          f"""SELECT field, src, count(*) AS union_size, count(*) FILTER (x.fid IS NOT NULL AND y.fid IS NOT NULL) AS inter_size
              FROM ({_top('train', 100, 'split_words_fx')}) x FULL OUTER JOIN ({_top('valid', 100, 'split_words_fx')}) y USING (field, src, fid) GROUP BY field, src"""),
    Query("largest_coverage_gaps", "E10", "field:t src:i coverage_diff:r", lambda v: pf.largest_gaps(drift(v), 3),
          f"SELECT field, src, coverage_diff FROM ({DRIFT_SQL}) ORDER BY abs(coverage_diff) DESC, field, src LIMIT 3"),
    Query("lowest_top_overlap", "E10", "field:t src:i topk_jaccard:r", lambda v: pf.lowest_overlap(drift(v), 3),
          f"SELECT field, src, topk_jaccard FROM ({DRIFT_SQL}) ORDER BY topk_jaccard, field, src LIMIT 3"),
    Query("sanity_report", "D13", "n_train_samples:i n_valid_samples:i train_ctr:r valid_ctr:r train_cvr:r valid_cvr:r funnel_bad_train:i funnel_bad_valid:i entity_overlap_count:i tokens_train_rows:i tokens_valid_rows:i expected_total:i tokens_diff:i", q_sanity,
          """SELECT count(*) FILTER (split = 'train') AS n_train_samples, count(*) FILTER (split = 'valid') AS n_valid_samples,
               avg(y1) FILTER (split = 'train') AS train_ctr, avg(y1) FILTER (split = 'valid') AS valid_ctr, avg(y2) FILTER (split = 'train') AS train_cvr, avg(y2) FILTER (split = 'valid') AS valid_cvr,
               count(*) FILTER (split = 'train' AND y2 = 1 AND y1 = 0) AS funnel_bad_train, count(*) FILTER (split = 'valid' AND y2 = 1 AND y1 = 0) AS funnel_bad_valid,
               0 AS entity_overlap_count, (SELECT count(*) FROM split_tokens_fx WHERE split = 'train') AS tokens_train_rows, (SELECT count(*) FROM split_tokens_fx WHERE split = 'valid') AS tokens_valid_rows,
               (SELECT count(*) FROM tokens_fx) AS expected_total, (SELECT count(*) FROM split_tokens_fx) - (SELECT count(*) FROM tokens_fx) AS tokens_diff FROM split_fx"""),
    Query("train_frequency", "D14", "field:t src:i fid:t cnt:i rnk:i", word_frequency,
          "SELECT field, src, fid, count(*) AS cnt, row_number() OVER (PARTITION BY field, src ORDER BY count(*) DESC, fid) AS rnk FROM split_words_fx WHERE split = 'train' GROUP BY field, src, fid"),
    Query("frequency_rank", "E1 D35", "field:t src:i fid:t rank:i", lambda v: vocab.frequency_ranks(token_counts(v.words)),
          "SELECT field, src, fid, row_number() OVER (PARTITION BY field, src ORDER BY count(*) DESC, fid) - 1 AS rank FROM words_fx GROUP BY field, src, fid"),
    Query("vocab_table", "E2", "field:t src:i fid:t rank:i", lambda v: vocab.vocab_table(v.ranks, v.spec),
          "SELECT r.field, r.src, r.fid, r.rank FROM ranks_fx r JOIN spec_fx s ON r.field = s.field AND r.src = s.src WHERE s.encoding <> 'hash' AND r.rank < s.vocab_tokens"),
    Query("rank_join", "C9", "row_id:i field:t src:i fid:t rnk:i", q_rank_join, WORD_JOIN_SQL),
    Query("dictionary_lookup", "C13", "field:t src:i found:i missed:i rank_sum:i",
          lambda v: vocab.look_up_ranks(v.tokens, v.ranks).groupBy("field", "src").agg(
              F.count("rank").alias("found"), F.count_if(F.col("rank").isNull()).alias("missed"), F.sum("rank").alias("rank_sum")),
          """SELECT t.field, t.src, count(r.rank) AS found, count(*) FILTER (r.rank IS NULL) AS missed, sum(r.rank) AS rank_sum
             FROM tokens_fx t LEFT JOIN ranks_fx r ON t.src = r.src AND t.field = r.field AND t.fid = r.fid GROUP BY t.field, t.src"""),
    Query("oov_token_curve", "D15", "field:t src:i head_size:i oov_token_rate:r", lambda v: vocab.oov_token_curve(v.words_of("valid"), word_frequency(v), WORD_HEADS),
          _curve_sql(WORD_JOIN_SQL, "rnk", "oov_token_rate", WORD_HEADS)),
    Query("oov_row_curve", "D16", "field:t src:i head_size:i oov_row_rate:r", lambda v: vocab.oov_row_curve(v.words_of("valid"), word_frequency(v), WORD_HEADS),
          _curve_sql(f"SELECT field, src, row_id, max(rnk) AS worst FROM ({WORD_JOIN_SQL}) GROUP BY field, src, row_id", "worst", "oov_row_rate", WORD_HEADS)),
    Query("new_value_curve", "D17", "field:t src:i head_size:i new_value_rate:r", lambda v: vocab.new_value_curve(v.words_of("valid"), word_frequency(v), WORD_HEADS),
          _curve_sql(f"SELECT field, src, fid, min(rnk) AS best FROM ({WORD_JOIN_SQL}) GROUP BY field, src, fid", "best", "new_value_rate", WORD_HEADS)),
    Query("oov_metric_frame", "C14", "field:t src:i total_tokens:i total_rows:i total_distinct:i", q_metric_frame,
          "SELECT field, src, count(*) AS total_tokens, count(DISTINCT row_id) AS total_rows, count(DISTINCT fid) AS total_distinct FROM split_words_fx WHERE split = 'valid' GROUP BY field, src"),
    Query("encoding_advice", "D18", "field:t src:i recommended_head_size:i recommended_encoding:t", lambda v: vocab.encoding_advice(
          vocab.oov_curves(v.side("valid"), vocab.train_frequency(v.side("train")))),
          ADVICE_OF_CURVES.format(curves=_curves_sql(TOKEN_RANK_JOIN, DEFAULT_HEADS))),
    Query("word_encoding_advice", "D18", "field:t src:i recommended_head_size:i recommended_encoding:t", lambda v: vocab.encoding_advice(oov(v)),
          ADVICE_OF_CURVES.format(curves=_curves_sql(WORD_JOIN_SQL, WORD_HEADS))),
    Query("bag_lengths", "C10", "row_id:i field:t src:i l:i", lengths, LENGTH_SQL),
    Query("length_quantiles", "D19", "field:t src:i covered_rows:i coverage_rate:r mean_len:r p50:r p90:r p95:r p99:r", length_quantiles, QUANT_SQL),
    Query("truncation_curve", "D20 C11", "field:t src:i k:i retained_token_frac:r retained_row_full_frac:r", lambda v: shape.truncation_curve(lengths(v)), TRUNC_SQL),
    Query("word_truncation_curve", "D20 C11", "field:t src:i k:i retained_token_frac:r retained_row_full_frac:r",
          lambda v: shape.truncation_curve(shape.bag_lengths(v.words, shape.multi_hot_fields(word_stats(v)))),
          """SELECT field, src, k, sum(least(l, k)) / sum(l) AS retained_token_frac, avg(CASE WHEN l <= k THEN 1.0 ELSE 0.0 END) AS retained_row_full_frac
             FROM (SELECT row_id, field, src, count(*) AS l FROM words_fx GROUP BY row_id, field, src) CROSS JOIN (VALUES (10), (20), (30), (40), (60), (80), (120), (200)) v(k) GROUP BY field, src, k"""),
    Query("hash_collision_curve", "D21", "field:t src:i fid_distinct:i bucket:i expected_occupied:r expected_collision:r collision_rate:r", lambda v: shape.collision_curve(word_stats(v)), _collision_sql(WORD_STATS_SQL)),
    Query("bucket_advice", "D22", "field:t src:i fid_distinct:i token_share:r threshold_local:r threshold_online:r bucket_local:i bucket_online:i", bucket_advice, _bucket_sql(WORD_STATS_SQL)),
    Query("token_share", "D23", "field:t src:i token_share:r", lambda v: shape.token_share(stats(v)), SHARE_SQL),
    Query("decile_edges", "D24", "field:t src:i edges:t", lambda v: edges(v).withColumn("edges", scaled_text(F.col("edges"), 10000)),
          f"SELECT field, src, array_to_string(list_transform(edges, lambda x: CAST(floor(x * 10000.0 + 0.5) AS BIGINT)), ',') AS edges FROM ({EDGES_SQL})"),
    Query("value_histogram", "D25", "field:t src:i bin:i train_frac:r valid_frac:r", histogram, HIST_SQL),
    Query("value_psi", "D26", "field:t src:i psi:r", lambda v: shape.psi(histogram(v)),
          f"SELECT field, src, sum((p - q) * ln(p / q)) AS psi FROM (SELECT field, src, greatest(train_frac, 1e-6) AS p, greatest(valid_frac, 1e-6) AS q FROM ({HIST_SQL})) GROUP BY field, src"),
    Query("value_profile", "D27", f"field:t src:i {PROFILE_COLS}", q_value_profile,
          f"""WITH odd AS ({ODD_SQL}), sided AS (SELECT o.field, o.src, CAST(CAST(o.val AS FLOAT) AS DOUBLE) AS val, s.split FROM odd o JOIN split_fx s ON o.row_id = s.row_id)
             SELECT field, src, {PROFILE_PART.format(s='train')}, {PROFILE_PART.format(s='valid')} FROM sided
             WHERE (field, src) IN (SELECT (field, src) FROM sided WHERE split = 'train' AND val <> 1) GROUP BY field, src"""),
    Query("max_len_advice", "D28", "field:t src:i max_len:i", max_len, MAX_LEN_SQL),
    Query("feature_advice", "D29", "field:t src:i encoding:t embedding_dim:i is_multi_hot:b max_len:i use_value:b pooling:t vocab_num_tokens:i hash_bucket:i", q_advice, ADVICE_SQL),
    Query("top_fields", "F3", "field:t src:i token_share:r", lambda v: shape.top_fields(shape.token_share(word_stats(v)), 3),
          f"SELECT field, src, token_share FROM ({WORD_STATS_SQL}) ORDER BY token_share DESC, field, src LIMIT 3"),
]
