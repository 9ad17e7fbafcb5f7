"""Raw log, token table, layout and split queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from adlattice.functions.parsing import FIELD_SEP, TOKEN_SEP, VALUE_SEP
from adlattice.operators import metrics, quality
from adlattice.operators import split as sp
from adlattice.operators import tokens as tk
from adlattice.plans.registry import Query
from adlattice.plans.views import Views
from adlattice.session import fresh_path
from adlattice.sources import logs, raw, sinks


def _token_text(field: str, fid, val):
    return F.concat(F.lit(field + FIELD_SEP), fid.cast("string"), F.lit(VALUE_SEP), val.cast("string"))


def raw_skeleton(v: Views) -> DataFrame:
    """Feature strings per order, with malformed tokens on some orders."""
    lines = v.table("lineitem").select(
        F.col("l_orderkey").alias("row_id"),
        F.explode(
            F.array(
                _token_text("205", F.col("l_partkey"), F.lit(1)),
                _token_text("853", F.col("l_suppkey"), F.col("l_quantity") / 10),
                _token_text("508", F.concat("l_returnflag", "l_linestatus"), F.col("l_discount")),
            )
        ).alias("token"),
    )
    key = F.col("o_orderkey")
    orders = v.table("orders").select(
        key.alias("row_id"),
        F.explode(
            F.array_compact(
                F.array(
                    _token_text("301", F.col("o_orderpriority"), F.lit(1)),
                    F.when(key % 10 == 0, F.lit("broken")),
                    F.when(key % 15 == 0, F.lit(f"999{FIELD_SEP}nofid")),
                    F.when(key % 20 == 0, F.lit(f"999{FIELD_SEP}x{VALUE_SEP}1.0f")),
                    F.when(key % 25 == 0, F.lit("")),
                )
            )
        ).alias("token"),
    )
    strings = (
        lines.unionByName(orders)
        .groupBy("row_id")
        .agg(F.concat_ws(TOKEN_SEP, F.array_sort(F.collect_list("token"))).alias("feat_str"))
    )
    return v.samples.join(strings, "row_id")


def raw_common(v: Views) -> DataFrame:
    """A stale and a current feature string per customer; some customers have none."""
    customer = v.table("customer").where(F.col("c_custkey") % 11 != 0)
    entity = F.lpad(F.col("c_custkey").cast("string"), 16, "0").alias("entity_id")
    current = F.concat_ws(
        TOKEN_SEP,
        _token_text("121", F.col("c_mktsegment"), F.lit(1)),
        _token_text("129", F.col("c_nationkey"), F.col("c_acctbal") / 1000),
    )
    stale = customer.select(F.lit(0).alias("pass"), entity, F.lit(1).alias("nnz"), F.lit(f"121{FIELD_SEP}OLD{VALUE_SEP}1").alias("feat_str"))
    return stale.unionByName(customer.select(F.lit(1).alias("pass"), entity, F.lit(2).alias("nnz"), current.alias("feat_str")))


def skeleton_path(v: Views) -> str:
    """The raw log as headerless CSV files in row order."""
    path = fresh_path(v.spark, "skeleton")
    ordered = raw_skeleton(v).repartitionByRange("row_id").sortWithinPartitions("row_id")
    ordered.select("c0", "y1", "y2", "entity_id", "c4", "feat_str").write.csv(path)
    return path


def common_path(v: Views) -> str:
    path = fresh_path(v.spark, "common")
    ordered = raw_common(v).repartitionByRange("pass", "entity_id").sortWithinPartitions("pass", "entity_id")
    ordered.select("entity_id", "nnz", "feat_str").write.csv(path)
    return path


def canonical(v: Views) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Numbered skeleton rows, common strings, and the tokens of both."""
    numbered = raw.with_row_ids(v.spark, skeleton_path(v))
    common = raw.read_common(v.spark, common_path(v))
    return numbered, common, tk.all_tokens(tk.attach_common(numbered, common))


def _errors(numbered: DataFrame, common: DataFrame) -> DataFrame:
    return tk.all_parse_errors(tk.attach_common(numbered, common))


def q_canonical_manifest(v: Views) -> DataFrame:
    numbered, common, tokens = canonical(v)
    return tk.canonical_summary(numbered, common, tokens, _errors(numbered, common))


def q_samples_sink(v: Views) -> DataFrame:
    path = fresh_path(v.spark, "samples")
    sinks.write_samples(v.samples, path)
    return v.spark.read.parquet(path)


def q_write_if_absent(v: Views) -> DataFrame:
    path = fresh_path(v.spark, "absent")
    sinks.write_samples(v.samples, path)
    sinks.write_samples(v.samples.where("y1 = 1"), path)
    kept = v.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows_kept"))
    rows_kept = kept.first()["rows_kept"]
    sinks.write_samples(v.samples.where("y1 = 1"), path, overwrite=True)
    return v.spark.read.parquet(path).agg(
        F.lit(rows_kept).alias("rows_kept"), F.count(F.lit(1)).alias("rows_overwritten")
    )


def token_path(v: Views, parts: int, max_rows: int = 3_000_000) -> str:
    path = fresh_path(v.spark, "tokens")
    sinks.write_tokens(v.tokens, path, parts=parts, max_rows_per_file=max_rows)
    return path


def q_token_layout(v: Views) -> DataFrame:
    """Whole-layout facts: rows, range, files that reach into the range of the file before."""
    manifest = sinks.part_manifest(v.spark, token_path(v, 6))
    before = Window.orderBy("row_id_min", "file").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("reach", F.max("row_id_max").over(before)).agg(
        F.sum("token_rows").alias("token_rows"),
        F.min("row_id_min").alias("row_id_min"),
        F.max("row_id_max").alias("row_id_max"),
        F.count_if(F.col("row_id_min") <= F.col("reach")).alias("overlapping_parts"),
    )


def q_part_manifest(v: Views) -> DataFrame:
    manifest = sinks.part_manifest(v.spark, token_path(v, 4, 50_000))
    return manifest.agg(
        F.sum("token_rows").alias("token_rows"),
        (F.max("token_rows") <= 50_000).alias("within_limit"),
        F.min("row_id_min").alias("row_id_min"),
        F.max("row_id_max").alias("row_id_max"),
    )


def q_compaction(v: Views) -> DataFrame:
    source, target = token_path(v, 24), fresh_path(v.spark, "compact")
    manifest = sinks.compact_tokens(v.spark, source, target, target_parts=3)
    tokens = v.spark.read.parquet(target)
    most = sinks.fitting_parts(v.spark.read.parquet(source), 3)
    shape = manifest.agg(F.struct((F.count(F.lit(1)) <= most).alias("few")).alias("s"))
    return tokens.groupBy("field", "src").agg(
        F.count(F.lit(1)).alias("token_rows"), F.sum("row_id").alias("row_id_sum"), F.max(shape.scalar()["few"]).alias("few_parts")
    )


def q_merge_verified(v: Views) -> DataFrame:
    source, target = token_path(v, 16), fresh_path(v.spark, "merged")
    rows = sinks.merge_parquet(v.spark, source, target, 2)
    return v.spark.read.parquet(target).agg(F.count(F.lit(1)).alias("token_rows"), F.lit(rows).alias("verified_rows"))


def q_processed_sink(v: Views) -> DataFrame:
    path = fresh_path(v.spark, "processed")
    sinks.write_processed(v.processed, path)
    return v.spark.read.parquet(path).groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("f1_121_idx").alias("idx_sum"), F.sum(F.size("f0_853_idx")).alias("bag_ids")
    )


def q_predictions_sink(v: Views) -> DataFrame:
    path = fresh_path(v.spark, "predictions")
    sinks.write_predictions(metrics.predictions(v.scored), path)
    got = v.spark.read.parquet(path)
    return got.select(
        "entity_id", "row_id", "y_ctr", "y_cvr", "click_mask", "y_ctcvr",
        *[F.round(F.col(c).cast("double"), 4).alias(c) for c in ("pred_ctr", "pred_cvr", "pred_ctcvr")],
    )


def log_path(v: Views) -> str:
    """Training log of one run per user as JSON lines, every 50th line broken."""
    path = fresh_path(v.spark, "log")
    split = F.when(F.col("event_type").isin("view", "click"), "valid").when(F.col("event_type") == "signup", "valid_decision").otherwise("train")
    record = v.evals.withColumn("split", split).select(
        "step",
        F.to_json(
            F.struct(
                F.col("run_id").cast("string").alias("run_id"),
                "split",
                F.col("step").alias("global_step"),
                (F.col("auc_ctcvr") > 0.65).alias("should_update"),
                "auc_ctr", "auc_cvr", "auc_ctcvr",
                (F.col("auc_ctcvr") + F.col("auc_ctr") * 0.2 + F.col("auc_cvr") * 0.2).alias("auc_primary"),
                (F.lit(1.0) - F.col("auc_ctr")).alias("loss_ctr"),
            )
        ).alias("line"),
    )
    broken = F.when(F.col("step") % 50 == 49, F.concat(F.lit("{oops "), "line")).otherwise(F.col("line"))
    record.select(broken.alias("value")).write.text(path)
    return path


LOG_SQL = """
    SELECT CAST(run_id AS VARCHAR) AS run_id, CASE WHEN event_type IN ('view', 'click') THEN 'valid' WHEN event_type = 'signup' THEN 'valid_decision' ELSE 'train' END AS split,
      step AS global_step, auc_ctcvr > CAST(0.65 AS DOUBLE) AS should_update, auc_ctr, auc_cvr, auc_ctcvr,
      auc_ctcvr + auc_ctr * CAST(0.2 AS DOUBLE) + auc_cvr * CAST(0.2 AS DOUBLE) AS auc_primary, 1 - auc_ctr AS loss_ctr
    FROM evals_fx WHERE step % 50 <> 49"""


def q_metrics_log(v: Views) -> DataFrame:
    log = logs.read_metrics_log(v.spark, log_path(v))
    parts = [
        part.groupBy("run_id").agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("records"), F.max("global_step").alias("last_step"), F.avg("auc_ctr").alias("auc_ctr"))
        for name, part in (("valid", logs.valid_records(log)), ("decision", logs.decision_records(log)))
    ]
    return parts[0].unionByName(parts[1])


def q_summary_sinks(v: Views) -> DataFrame:
    path = fresh_path(v.spark, "summary")
    summary = v.evals.groupBy("run_id").agg(F.count(F.lit(1)).alias("evals"), F.max("auc_ctcvr").alias("best"))
    sinks.write_summary(summary, path)
    schema = "run_id long, evals long, best double"
    csv = v.spark.read.schema(schema).option("header", "true").csv(f"{path}/csv").withColumn("form", F.lit("csv"))
    return csv.unionByName(v.spark.read.schema(schema).json(f"{path}/json").withColumn("form", F.lit("json")))


def q_parse_errors(v: Views) -> DataFrame:
    numbered = raw.with_row_ids(v.spark, skeleton_path(v))
    return _errors(numbered, raw.read_common(v.spark, common_path(v)))


def q_first_rows(v: Views) -> DataFrame:
    numbered = raw.with_row_ids(v.spark, skeleton_path(v), nrows=1000)
    tokens = tk.parse_tokens(numbered)
    per_row = tokens.groupBy("row_id").agg(F.count(F.lit(1)).alias("token_rows"))
    return raw.samples_of(numbered).join(per_row, "row_id", "left")


def odd_values(v: Views) -> DataFrame:
    """Tokens with NaN and infinite values on some rows."""
    return v.tokens.withColumn(
        "val",
        F.when((F.col("field") == "853") & (F.col("row_id") % 13 == 0), F.lit(float("nan")))
        .when((F.col("field") == "853") & (F.col("row_id") % 17 == 0), F.lit(float("inf")))
        .when((F.col("field") == "129") & (F.col("row_id") % 19 == 0), F.lit(float("-inf")))
        .otherwise(F.col("val"))
        .cast("float"),
    )


ODD_SQL = """SELECT row_id, src, field, fid, CAST(CASE WHEN field = '853' AND row_id % 13 = 0 THEN 'nan'::DOUBLE
      WHEN field = '853' AND row_id % 17 = 0 THEN 'inf'::DOUBLE WHEN field = '129' AND row_id % 19 = 0 THEN '-inf'::DOUBLE ELSE val END AS DOUBLE) AS val FROM tokens_fx"""


def q_nonfinite_guard(v: Views) -> DataFrame:
    return tk.guard_values(odd_values(v)).groupBy("field", "src").agg(
        F.count_if("bad_value").alias("bad_values"), F.sum("val").alias("val_sum"), F.max("val").alias("val_max")
    )


def q_missing_src(v: Views) -> DataFrame:
    with_nulls = v.tokens.withColumn("src", F.when(F.col("src") == 0, F.col("src")))
    a = tk.default_src(with_nulls).withColumn("form", F.lit("null"))
    b = tk.default_src(v.tokens.drop("src")).withColumn("form", F.lit("absent"))
    return a.unionByName(b).groupBy("form", "src", "field").agg(F.count(F.lit(1)).alias("token_rows"))


def q_row_range(v: Views) -> DataFrame:
    path = token_path(v, 8)
    return tk.tokens_in_range(v.spark.read.parquet(path), 200, 2200)


def duplicated(v: Views) -> DataFrame:
    """Every token twice, the second copy later and with another value."""
    first = v.tokens.withColumn("ord", F.lit(0))
    again = v.tokens.withColumn("val", (F.col("val") * 2 - 1).cast("float")).withColumn("ord", F.lit(1))
    return first.unionByName(again).withColumn("val", F.col("val").cast("double"))


def q_duplicates(v: Views) -> DataFrame:
    # The joins that put the three rules side by side before met no token without a key.
    rows = tk.merge_duplicates(duplicated(v), ["last", "max", "sum"], ["ord", "val"]).dropna(subset=tk.TOKEN_KEY)
    return rows.groupBy("field", "src").agg(
        F.count(F.lit(1)).alias("tokens"), F.sum("max_val").alias("max_sum"), F.sum("sum_val").alias("sum_sum"), F.sum("last_val").alias("last_sum")
    )


def q_split_tokens(v: Views) -> DataFrame:
    return sp.split_tokens(v.tokens, v.split_samples)


def q_split_reconciliation(v: Views) -> DataFrame:
    return sp.reconcile_split(v.tokens, sp.split_tokens(v.tokens, v.split_samples))


def q_batch_tokens(v: Views) -> DataFrame:
    wanted = v.samples_of("valid").where("y1 = 1")
    return tk.tokens_of_rows(v.tokens, wanted)


def q_entity_overlap(v: Views) -> DataFrame:
    good = sp.entity_overlap(v.samples_of("train"), v.samples_of("valid")).withColumn("checked", F.lit("split"))
    bad = sp.entity_overlap(v.samples.where("row_id % 2 = 0"), v.samples.where("row_id % 2 = 1")).withColumn("checked", F.lit("by row"))
    return good.unionByName(bad)


def q_concat_parts(v: Views) -> DataFrame:
    path = token_path(v, 5)
    whole = v.spark.read.parquet(path)
    train = sp.tokens_of_split(whole, v.split_samples, "train")
    valid = sp.tokens_of_split(whole, v.split_samples, "valid")
    return train.unionByName(valid).groupBy("field", "src").agg(
        F.count(F.lit(1)).alias("token_rows"), F.sum("row_id").alias("row_id_sum")
    )


def q_three_way_split(v: Views) -> DataFrame:
    return sp.assign_split(v.samples, {"train": 8, "valid": 1, "test": 1}, 7).groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("entity_id").alias("entities")
    )


def q_entity_draw(v: Views) -> DataFrame:
    from adlattice.functions.hashing import unit_hash

    return v.samples.select("entity_id").distinct().select("entity_id", unit_hash(F.col("entity_id"), 42).alias("draw"))


def labels(v: Views) -> DataFrame:
    from adlattice.operators.encode import derive_labels

    return derive_labels(v.samples)


CANONICAL_SQL = "SELECT t.* FROM tokens_fx t JOIN samples_fx s ON t.row_id = s.row_id WHERE NOT (t.src = 1 AND CAST(s.entity_id AS BIGINT) % 11 = 0)"
BROKEN_SQL = "count(*) FILTER (row_id % 10 = 0) + count(*) FILTER (row_id % 15 = 0) + count(*) FILTER (row_id % 20 = 0)"
SAMPLE_COLS = "row_id:i y1:i y2:i entity_id:t c4:i c0:i"
DRAW42 = "CAST(CAST('0x' || substr(md5('42:' || entity_id), 1, 15) AS BIGINT) AS DOUBLE) / CAST(1152921504606846976 AS DOUBLE)"
DRAW7 = DRAW42.replace("'42:'", "'7:'")

QUERIES = [
    Query("skeleton_scan", "A1", "c0:i y1:i y2:i entity_id:t c4:i tokens:i",
          lambda v: raw.read_skeleton(v.spark, skeleton_path(v)).withColumn("tokens", F.size(tk.raw_tokens(F.col("feat_str")))),
          """SELECT c0, y1, y2, entity_id, c4, n + CASE WHEN row_id % 10 = 0 THEN 1 ELSE 0 END + CASE WHEN row_id % 15 = 0 THEN 1 ELSE 0 END + CASE WHEN row_id % 20 = 0 THEN 1 ELSE 0 END AS tokens
             FROM samples_fx JOIN (SELECT row_id, count(*) AS n FROM tokens_fx WHERE src = 0 GROUP BY row_id) USING (row_id)"""),
    Query("common_last_wins", "A2", "entity_id:t segment:t tokens:i",
          lambda v: raw.read_common(v.spark, common_path(v)).select(
              "entity_id", F.regexp_extract("feat_str", f"121{FIELD_SEP}([^{VALUE_SEP}]*)", 1).alias("segment"), F.size(tk.raw_tokens(F.col("feat_str"))).alias("tokens")),
          "SELECT lpad(CAST(c_custkey AS VARCHAR), 16, '0') AS entity_id, c_mktsegment AS segment, 2 AS tokens FROM customer WHERE c_custkey % 11 <> 0"),
    Query("dense_row_ids", "A3", SAMPLE_COLS, lambda v: raw.samples_of(raw.with_row_ids(v.spark, skeleton_path(v))), "SELECT * FROM samples_fx"),
    Query("first_rows", "A4", SAMPLE_COLS + " token_rows:i", q_first_rows,
          "SELECT s.*, n AS token_rows FROM samples_fx s LEFT JOIN (SELECT row_id, count(*) AS n FROM tokens_fx WHERE src = 0 GROUP BY row_id) USING (row_id) WHERE row_id < 1000"),
    Query("samples_sink", "A5", SAMPLE_COLS, q_samples_sink, "SELECT * FROM samples_fx"),
    Query("token_sink_layout", "A6 F1", "token_rows:i row_id_min:i row_id_max:i overlapping_parts:i", q_token_layout,
          "SELECT count(*) AS token_rows, min(row_id) AS row_id_min, max(row_id) AS row_id_max, 0 AS overlapping_parts FROM tokens_fx"),
    Query("part_manifest", "A7", "token_rows:i within_limit:b row_id_min:i row_id_max:i", q_part_manifest,
          "SELECT count(*) AS token_rows, true AS within_limit, min(row_id) AS row_id_min, max(row_id) AS row_id_max FROM tokens_fx"),
    Query("canonical_manifest", "A8", "samples_rows:i samples_unique_entities:i join_hit_ratio:r tokens_total_rows:i parse_error_tokens:i", q_canonical_manifest,
          f"""SELECT (SELECT count(*) FROM samples_fx) AS samples_rows, (SELECT count(DISTINCT entity_id) FROM samples_fx) AS samples_unique_entities,
              (SELECT avg(CASE WHEN CAST(entity_id AS BIGINT) % 11 = 0 THEN 0.0 ELSE 1.0 END) FROM samples_fx) AS join_hit_ratio,
              (SELECT count(*) FROM ({CANONICAL_SQL})) AS tokens_total_rows, (SELECT {BROKEN_SQL} FROM samples_fx) AS parse_error_tokens"""),
    Query("token_compaction", "A9", "field:t src:i token_rows:i row_id_sum:i few_parts:b", q_compaction,
          "SELECT field, src, count(*) AS token_rows, sum(row_id) AS row_id_sum, true AS few_parts FROM tokens_fx GROUP BY field, src"),
    Query("merge_verified", "A10", "token_rows:i verified_rows:i", q_merge_verified,
          "SELECT count(*) AS token_rows, count(*) AS verified_rows FROM tokens_fx"),
    Query("write_if_absent", "A11", "rows_kept:i rows_overwritten:i", q_write_if_absent,
          "SELECT count(*) AS rows_kept, count(*) FILTER (y1 = 1) AS rows_overwritten FROM samples_fx"),
    Query("processed_sink", "A12", "split:t rows:i idx_sum:i bag_ids:i", q_processed_sink,
          """SELECT s.split, count(*) AS rows, sum(coalesce(a.idx, 1)) AS idx_sum, sum(coalesce(b.n, 1)) AS bag_ids FROM split_fx s
             LEFT JOIN (SELECT row_id, idx FROM encoded_fx WHERE name = 'f1_121') a ON s.row_id = a.row_id
             LEFT JOIN (SELECT row_id, count(*) AS n FROM encoded_fx WHERE name = 'f0_853' GROUP BY row_id) b ON s.row_id = b.row_id GROUP BY s.split"""),
    Query("predictions_sink", "A13", "entity_id:t row_id:i y_ctr:i y_cvr:i click_mask:i y_ctcvr:i pred_ctr:r pred_cvr:r pred_ctcvr:r", q_predictions_sink,
          """SELECT entity_id, row_id, y_ctr, y_cvr, click_mask, y_ctcvr, round(CAST(CAST(a AS FLOAT) AS DOUBLE), 4) AS pred_ctr,
               round(CAST(CAST(b AS FLOAT) AS DOUBLE), 4) AS pred_cvr, round(CAST(CAST(a * b AS FLOAT) AS DOUBLE), 4) AS pred_ctcvr
             FROM (SELECT *, 1 / (1 + exp(-ctr_logit)) AS a, 1 / (1 + exp(-cvr_logit)) AS b FROM scored_fx)"""),
    Query("metrics_log", "A14", "run_id:t part:t records:i last_step:i auc_ctr:r", q_metrics_log,
          f"""SELECT run_id, CASE split WHEN 'valid' THEN 'valid' ELSE 'decision' END AS part, count(*) AS records, max(global_step) AS last_step, avg(auc_ctr) AS auc_ctr
              FROM ({LOG_SQL}) WHERE split <> 'train' GROUP BY 1, 2"""),
    Query("summary_sinks", "A15", "form:t run_id:i evals:i best:r", q_summary_sinks,
          "SELECT form, run_id, count(*) AS evals, max(auc_ctcvr) AS best FROM evals_fx CROSS JOIN (VALUES ('csv'), ('json')) f(form) GROUP BY form, run_id"),
    Query("parsed_tokens", "B1", "row_id:i src:i field:t fid:t val:r",
          lambda v: tk.parse_tokens(raw.with_row_ids(v.spark, skeleton_path(v))), "SELECT * FROM tokens_fx WHERE src = 0"),
    Query("parse_errors", "B2", "src:i tokens_seen:i parse_errors:i", q_parse_errors,
          f"""SELECT 0 AS src, (SELECT count(*) FROM tokens_fx WHERE src = 0) + ({BROKEN_SQL}) AS tokens_seen, {BROKEN_SQL} AS parse_errors FROM samples_fx
              UNION ALL SELECT 1, (SELECT count(*) FROM ({CANONICAL_SQL}) WHERE src = 1), 0"""),
    Query("canonical_tokens", "B3 C1", "row_id:i src:i field:t fid:t val:r", lambda v: canonical(v)[2], CANONICAL_SQL),
    Query("label_derivation", "B4", "row_id:i entity_id:t y_ctr:i y_cvr:i y_ctcvr:i click_mask:i", labels,
          "SELECT row_id, entity_id, y1 AS y_ctr, y2 AS y_cvr, y1 * y2 AS y_ctcvr, y1 AS click_mask FROM samples_fx"),
    Query("funnel_coercion", "B5", "row_id:i y_ctr:i y_cvr:i y_ctcvr:i click_mask:i funnel_bad:b", lambda v: quality.coerce_funnel(labels(v)),
          "SELECT row_id, y1 AS y_ctr, CASE WHEN y1 = 0 THEN 0 ELSE y2 END AS y_cvr, y1 * y2 AS y_ctcvr, y1 AS click_mask, y1 = 0 AND y2 = 1 AS funnel_bad FROM samples_fx"),
    Query("funnel_drop", "B6", "row_id:i y_ctr:i y_cvr:i", lambda v: quality.drop_broken_funnel(labels(v)),
          "SELECT row_id, y1 AS y_ctr, y2 AS y_cvr FROM samples_fx WHERE NOT (y1 = 0 AND y2 = 1)"),
    Query("clicked_rows", "B7", "row_id:i y_cvr:i", lambda v: metrics.clicked(labels(v)), "SELECT row_id, y2 AS y_cvr FROM samples_fx WHERE y1 = 1"),
    Query("nonfinite_guard", "B8", "field:t src:i bad_values:i val_sum:r val_max:r", q_nonfinite_guard,
          f"""SELECT field, src, count(*) FILTER (NOT isfinite(val)) AS bad_values, sum(CASE WHEN isfinite(val) THEN val ELSE 0 END) AS val_sum,
              max(CASE WHEN isfinite(val) THEN val ELSE 0 END) AS val_max FROM ({ODD_SQL}) GROUP BY field, src"""),
    Query("missing_src_default", "B9", "form:t src:i field:t token_rows:i", q_missing_src,
          "SELECT form, 0 AS src, field, count(*) AS token_rows FROM tokens_fx CROSS JOIN (VALUES ('null'), ('absent')) f(form) GROUP BY form, field"),
    Query("row_range_scan", "B10", "row_id:i src:i field:t fid:t val:r", q_row_range, "SELECT * FROM tokens_fx WHERE row_id BETWEEN 200 AND 2200"),
    Query("common_hit_ratio", "C3", "rows:i hit_rows:i hit_ratio:r",
          lambda v: tk.hit_ratio(raw.read_skeleton(v.spark, skeleton_path(v)), raw.read_common(v.spark, common_path(v))),
          "SELECT count(*) AS rows, sum(h) AS hit_rows, avg(CAST(h AS DOUBLE)) AS hit_ratio FROM (SELECT CASE WHEN CAST(entity_id AS BIGINT) % 11 = 0 THEN 0 ELSE 1 END AS h FROM samples_fx)"),
    Query("split_tokens", "C4", "row_id:i src:i field:t fid:t val:r split:t", q_split_tokens, "SELECT * FROM split_tokens_fx"),
    Query("split_reconciliation", "C5", "train_token_rows:i valid_token_rows:i expected_rows:i observed_rows:i diff:i", q_split_reconciliation,
          """SELECT count(*) FILTER (split = 'train') AS train_token_rows, count(*) FILTER (split = 'valid') AS valid_token_rows,
             (SELECT count(*) FROM tokens_fx) AS expected_rows, count(*) AS observed_rows, count(*) - (SELECT count(*) FROM tokens_fx) AS diff FROM split_tokens_fx"""),
    Query("batch_tokens", "C6 F2", "row_id:i src:i field:t fid:t val:r", q_batch_tokens,
          "SELECT t.* FROM tokens_fx t JOIN split_fx s ON t.row_id = s.row_id WHERE s.split = 'valid' AND s.y1 = 1"),
    Query("entity_overlap", "C7", "checked:t overlap:i", q_entity_overlap,
          """SELECT 'split' AS checked, count(*) AS overlap FROM (SELECT entity_id FROM split_fx WHERE split = 'train' INTERSECT SELECT entity_id FROM split_fx WHERE split = 'valid')
             UNION ALL SELECT 'by row', count(*) FROM (SELECT entity_id FROM samples_fx WHERE row_id % 2 = 0 INTERSECT SELECT entity_id FROM samples_fx WHERE row_id % 2 = 1)"""),
    Query("duplicate_merge", "D31", "field:t src:i tokens:i max_sum:r sum_sum:r last_sum:r", q_duplicates,
          """SELECT field, src, count(*) AS tokens, sum(greatest(a, b)) AS max_sum, sum(s) AS sum_sum, sum(b) AS last_sum FROM (
               SELECT row_id, src, field, fid, max(CAST(val AS DOUBLE)) AS a, max(CAST(CAST(val * 2 - 1 AS FLOAT) AS DOUBLE)) AS b,
                 sum(CAST(val AS DOUBLE) + CAST(CAST(val * 2 - 1 AS FLOAT) AS DOUBLE)) AS s FROM tokens_fx GROUP BY row_id, src, field, fid) GROUP BY field, src"""),
    Query("concat_parts", "G3", "field:t src:i token_rows:i row_id_sum:i", q_concat_parts,
          "SELECT field, src, count(*) AS token_rows, sum(row_id) AS row_id_sum FROM tokens_fx GROUP BY field, src"),
    Query("split_stats", "D1", "split:t rows:i unique_entity:i ctr:r cvr:r cvr_click:r funnel_anomaly:i", lambda v: sp.split_stats(v.split_samples),
          """SELECT split, count(*) AS rows, count(DISTINCT entity_id) AS unique_entity, avg(y1) AS ctr, avg(y2) AS cvr, sum(y1 * y2) / sum(y1) AS cvr_click,
             count(*) FILTER (y2 = 1 AND y1 = 0) AS funnel_anomaly FROM split_fx GROUP BY split"""),
    Query("label_priors", "D34", "ctr:r cvr:r", lambda v: sp.label_priors(v.split_samples),
          "SELECT avg(y1) AS ctr, avg(y2) AS cvr FROM split_fx WHERE split = 'train'"),
    Query("entity_draw", "H1", "entity_id:t draw:r", q_entity_draw, f"SELECT DISTINCT entity_id, {DRAW42} AS draw FROM samples_fx"),
    Query("three_way_split", "H2", "split:t rows:i entities:i", q_three_way_split,
          f"""SELECT CASE WHEN u < CAST(0.8 AS DOUBLE) THEN 'train' WHEN u < CAST(0.9 AS DOUBLE) THEN 'valid' ELSE 'test' END AS split, count(*) AS rows, count(DISTINCT entity_id) AS entities
              FROM (SELECT *, {DRAW7} AS u FROM samples_fx) GROUP BY 1"""),
]
