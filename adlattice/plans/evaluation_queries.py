"""Metrics, losses, health and run-log queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlattice.functions import scalars
from adlattice.operators import health, losses, metrics, runs, scorers
from adlattice.plans.encode_queries import BAG_SQL
from adlattice.plans.registry import Query
from adlattice.plans.source_queries import LOG_SQL, log_path
from adlattice.plans.views import FEATURES, Views
from adlattice.sources.logs import read_metrics_log

KEEP_PROB = 0.25
EXPERTS = ["mlp_0", "cross_1", "identity_2", "tower_3"]
EXPERT_NAMES = ["mlp_0[SHARE]", "crossnet_1[SHARE]", "identity_2[SHARE]", "tower_3"]
WIDTH = 16
GATE = runs.GateRule(tol_primary=0.002, tol_aux={"auc_ctr": 0.003, "auc_cvr": 0.008}, confirm_times=2, cooldown=2, window=3)


def tasks(v: Views) -> DataFrame:
    return metrics.score_tasks(v.scored)


def q_component_stats(v: Views) -> DataFrame:
    parts = v.scored.withColumn("total_logit", F.col("ctr_logit") + F.col("cvr_logit"))
    return metrics.component_stats(parts, ["ctr_logit", "cvr_logit"], "total_logit")


def q_funnel(v: Views) -> DataFrame:
    p = v.scored.withColumns({"pred_ctr": scalars.sigmoid(F.col("ctr_logit")), "pred_cvr": scalars.sigmoid(F.col("cvr_logit"))})
    p = p.withColumn("pred_joint", (F.col("pred_ctr") + F.col("pred_cvr")) / 2)
    by_label = metrics.funnel_consistency(p).withColumn("target", F.lit("label"))
    by_head = metrics.funnel_consistency(p, head="pred_joint").withColumn("target", F.lit("head"))
    alone = metrics.funnel_consistency(p, label=None).withColumn("target", F.lit("none"))
    return by_label.unionByName(by_head).unionByName(alone)


def q_sigmoid(v: Views) -> DataFrame:
    wide = v.scored.select("row_id", (F.col("ctr_logit") * 500).alias("x"))
    return wide.select("row_id", scalars.sigmoid(F.col("x")).alias("p"))


def q_joint_logit(v: Views) -> DataFrame:
    return v.scored.select("row_id", scalars.joint_logit(F.col("ctr_logit"), F.col("cvr_logit")).alias("joint"))


def q_correction(v: Views) -> DataFrame:
    shift, exact = scalars.sampling_correction(KEEP_PROB), scalars.sampling_correction(KEEP_PROB, exact=True)
    return v.scored.select("row_id", (F.col("ctr_logit") - shift).alias("corrected"), (F.col("ctr_logit") - exact).alias("exact"))


def q_log_p(v: Views) -> DataFrame:
    log_p = scalars.log_sigmoid(F.col("ctr_logit")) + scalars.log_sigmoid(F.col("cvr_logit"))
    return v.scored.select("row_id", scalars.log1mexp(log_p).alias("log_1m_p"), scalars.bce_from_log_p(log_p, F.col("y_ctcvr").cast("double")).alias("bce"))


def run_metrics(v: Views) -> DataFrame:
    """AUC and ECE style numbers per run with a missing one here and there."""
    return v.evals.groupBy("run_id").agg(
        F.avg("auc_ctr").alias("auc_ctr"),
        F.avg("auc_cvr").alias("auc_cvr"),
        F.when(F.col("run_id") % 4 != 0, F.max("auc_ctcvr")).alias("auc_ctcvr"),
        (1 - F.avg("auc_ctr")).alias("loss_ctr"),
        F.stddev_pop("auc_cvr").alias("ece_cvr"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def q_auc_primary(v: Views) -> DataFrame:
    return run_metrics(v).select(
        "run_id", metrics.auc_primary(F.col("auc_ctcvr"), F.col("auc_ctr"), F.when(F.col("run_id") % 6 != 0, F.col("auc_cvr"))).alias("auc_primary")
    )


def named_usage(v: Views) -> DataFrame:
    names = F.array(*[F.lit(n) for n in EXPERT_NAMES])
    return health.utilisation(v.gates).withColumn("expert_name", names[F.col("expert")])


def expert_rows(v: Views) -> DataFrame:
    parts = [F.slice("embedding", i * WIDTH + 1, WIDTH).alias(name) for i, name in enumerate(EXPERTS)]
    return v.table("embeddings").select(F.col("vec_id").alias("row_id"), *parts)


def q_output_stats(v: Views) -> DataFrame:
    long = v.table("embeddings").select(F.posexplode("embedding").alias("pos", "v"))
    return health.output_stats(long.select(F.floor(F.col("pos") / WIDTH).alias("expert"), F.round(F.col("v").cast("double"), 2).alias("v")))


def q_running_best(v: Views) -> DataFrame:
    got = runs.running_best(v.evals, "run_id", "step", "auc_ctcvr")
    return got.groupBy("run_id").agg(F.count_if("should_update").alias("updates"), F.max(F.when(F.col("should_update"), F.col("step"))).alias("best_step"))


def log(v: Views) -> DataFrame:
    return read_metrics_log(v.spark, log_path(v))


def best(v: Views) -> DataFrame:
    """Best records where every fifth run has a known best step."""
    entries = log(v)
    known = (
        entries.where("split = 'valid' AND CAST(run_id AS INT) % 5 = 0").groupBy("run_id").agg(F.min("global_step").alias("best_step"))
    )
    return runs.best_records(entries, known)


def q_run_summary(v: Views) -> DataFrame:
    meta = v.table("customer").select(F.col("c_custkey").cast("string").alias("run_id"), F.col("c_mktsegment").alias("description"))
    return runs.run_summary(best(v), meta)


def q_deltas(v: Views) -> DataFrame:
    runs_of = v.evals.select("run_id").distinct()
    pairs = runs_of.select(
        F.concat(F.lit("next of "), F.col("run_id").cast("string")).alias("label"),
        (F.col("run_id") + 1).cast("string").alias("run_new"),
        F.col("run_id").cast("string").alias("run_base"),
        F.when(F.col("run_id") % 2 == 0, "auc_ctcvr").otherwise("loss_cvr").alias("metric"),
    )
    return runs.metric_deltas(best(v), pairs)


def q_given_weights(v: Views) -> DataFrame:
    """Scores under weights that follow from the ids, so that the arithmetic can be checked."""
    valued = v.spec.select("name", "use_value")
    weight = F.when(F.col("use_value"), F.col("val").cast("double")).otherwise(F.lit(1.0)).alias("weight")
    # The weights and the scores read the lines, so they are encoded once.
    lines = v.once("weighted_lines", lambda: v.encoded.drop("use_value").join(F.broadcast(valued), "name").select("row_id", "name", "idx", weight))
    i = F.col("idx")
    weights = lines.select("name", "idx").distinct().withColumns(
        {"w": (i % 101 - 50) / F.lit(100.0), "v": F.array((i * 7 % 23 - 11) / F.lit(50.0), (i * 3 % 19 - 9) / F.lit(50.0))}
    )
    return scorers.given_scores(lines, weights, 2, len(list(FEATURES)))


def scorer_sql(factors: int, passes: int = 2, batches: int = 2, rate: float = 0.1, reg: float = 1e-4) -> str:
    """Both tasks fitted and scored step by step: one table of parameters for each step."""
    ks, fields = range(factors), len(list(FEATURES))
    each = lambda text: "".join(text.format(k=k) for k in ks)
    init = "CASE WHEN name = '' THEN CAST(0 AS DOUBLE) ELSE (CAST(CAST('0x' || substr(md5('17:' || name || ':' || idx || ':{k}'), 1, 15) AS BIGINT) AS DOUBLE) / CAST(1152921504606846976 AS DOUBLE) - CAST(0.5 AS DOUBLE)) * CAST(0.2 AS DOUBLE) END"

    def forward(lines: str, model: str) -> str:
        fields_of = f"""SELECT l.row_id, l.name, l.idx, l.share, l.label, l.batch, coalesce(l.share * p.w, 0) AS a{each(", coalesce(l.share * p.v{k}, 0) AS o{k}")}
            FROM {lines} l LEFT JOIN {model} p ON l.name = p.name AND l.idx = p.idx"""
        sums = each(", sum(o{k}) OVER (PARTITION BY row_id) AS t{k}, sum(o{k}) OVER (PARTITION BY row_id, name) AS e{k}")
        second = " + ".join([f"t{k} * t{k} - sum(o{k} * e{k}) OVER (PARTITION BY row_id)" for k in ks]) or "0"
        return f"""SELECT *, first_order + ({second}) / 2 / CAST({fields} AS DOUBLE) AS logit FROM (
            SELECT *, sum(a) OVER (PARTITION BY row_id) AS first_order{sums} FROM ({fields_of}))"""

    parts = [
        f"lines_all AS MATERIALIZED (SELECT row_id, split, y_ctr, y_cvr, field AS name, unnest(ids) AS idx, CAST(unnest(weights) AS DOUBLE) / len(ids) AS share, 0 AS label, row_id % {batches} AS batch "
        f"FROM ({BAG_SQL}) UNION ALL SELECT row_id, split, y1, y2, '', 0, CAST(1 AS DOUBLE), 0, row_id % {batches} FROM split_fx)"
    ]
    for task, where in (("ctr", "split = 'train'"), ("cvr", "split = 'train' AND y_ctr = 1")):
        parts.append(f"{task} AS MATERIALIZED (SELECT * REPLACE (CAST(y_{task} AS DOUBLE) AS label) FROM lines_all WHERE {where})")
        zeros = each(", " + init + " AS v{k}, CAST(0 AS DOUBLE) AS sv{k}")
        parts.append(f"{task}_p0 AS MATERIALIZED (SELECT name, idx, CAST(0 AS DOUBLE) AS w, CAST(0 AS DOUBLE) AS sw{zeros} FROM (SELECT DISTINCT name, idx FROM {task}))")
        for step in range(passes * batches):
            b, old, new = step % batches, f"{task}_p{step}", f"{task}_p{step + 1}"
            err = "(1 / (1 + exp(-logit)) - label) * share"
            grads = each(", sum(CASE WHEN name = '' THEN 0 ELSE " + err + " * (t{k} - e{k}) / " + str(fields) + " END) AS g{k}")
            parts.append(f"{task}_g{step} AS MATERIALIZED (SELECT name, idx, sum({err}) AS gw{grads} FROM ({forward(f'(SELECT * FROM {task} WHERE batch = {b})', old)}) GROUP BY name, idx)")
            n = f"(SELECT count(DISTINCT row_id) FROM {task} WHERE batch = {b})"
            full = f"SELECT p.*, g.gw IS NOT NULL AS hit, g.gw / {n} + {reg} * w AS dw" + each(", g.g{k} / " + n + " + " + str(reg) + " * v{k} AS d{k}")
            go = lambda at, s, d: f"CASE WHEN hit THEN {at} - {rate} * {d} / (sqrt({s} + {d} * {d}) + CAST(1e-8 AS DOUBLE)) ELSE {at} END AS {at}, CASE WHEN hit THEN {s} + {d} * {d} ELSE {s} END AS {s}"
            moved = ", ".join([go("w", "sw", "dw"), *[go(f"v{k}", f"sv{k}", f"d{k}") for k in ks]])
            parts.append(f"{new} AS MATERIALIZED (SELECT name, idx, {moved} FROM ({full} FROM {old} p LEFT JOIN {task}_g{step} g ON p.name = g.name AND p.idx = g.idx))")
        parts.append(f"{task}_out AS (SELECT row_id, any_value(logit) AS {task}_logit FROM ({forward('lines_all', f'{task}_p{passes * batches}')}) GROUP BY row_id)")
    return f"WITH {', '.join(parts)} SELECT s.row_id, s.entity_id, s.split, s.y1 AS y_ctr, s.y2 AS y_cvr, ctr_logit, cvr_logit FROM split_fx s JOIN ctr_out USING (row_id) JOIN cvr_out USING (row_id)"


P = "1 / (1 + exp(-{x}))"
TASK_SQL = f"""
    SELECT *, {P.format(x='logit')} AS p FROM (
      SELECT 'ctr' AS task, CAST(y_ctr AS DOUBLE) AS y, ctr_logit AS logit FROM scored_fx
      UNION ALL SELECT 'cvr', y_cvr, cvr_logit FROM scored_fx WHERE click_mask = 1
      UNION ALL SELECT 'ctcvr', y_ctcvr, ln(j / (1 - j)) FROM (SELECT y_ctcvr, greatest(1e-8, least(1 - 1e-8, {P.format(x='ctr_logit')} * {P.format(x='cvr_logit')})) AS j FROM scored_fx))"""
LOGLOSS = "avg(-(y * ln(greatest(1e-12, least(1 - 1e-12, p))) + (1 - y) * ln(1 - greatest(1e-12, least(1 - 1e-12, p)))))"
AUC_SQL = f"""
    SELECT task, (sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) AS auc
    FROM (SELECT task, y, (rank() OVER (PARTITION BY task ORDER BY p)) + (count(*) OVER (PARTITION BY task, p) - 1) / 2.0 AS rk FROM ({TASK_SQL})) GROUP BY task"""
METRIC_SQL = f"SELECT a.*, b.auc FROM (SELECT task, {LOGLOSS} AS logloss, avg(y) AS pos_rate, avg(p) AS pred_mean, count(*) AS n FROM ({TASK_SQL}) GROUP BY task) a JOIN ({AUC_SQL}) b ON a.task = b.task"
EDGES = "(SELECT i, CAST(0.05 AS DOUBLE) * i AS bin_left, CASE WHEN i = 19 THEN CAST(1 AS DOUBLE) ELSE CAST(0.05 AS DOUBLE) * (i + 1) END AS bin_right FROM range(20) r(i))"
BIN_SQL = f"""
    SELECT k.task, bin_left, bin_right, count(p) AS n, avg(p) AS avg_pred, avg(y) AS avg_label, abs(avg(p) - avg(y)) AS abs_gap
    FROM (VALUES ('ctr'), ('cvr'), ('ctcvr')) k(task) CROSS JOIN {EDGES} e LEFT JOIN ({TASK_SQL}) t ON t.task = k.task AND p >= bin_left AND (p < bin_right OR i = 19)
    GROUP BY k.task, bin_left, bin_right"""
ECE_SQL = f"SELECT task, sum(n * coalesce(abs_gap, 0)) / sum(n) AS ece FROM ({BIN_SQL}) GROUP BY task"


def _funnel_sql(target: str, name: str) -> str:
    return f"""SELECT '{name}' AS target, count(*) AS n, avg(a * b) AS mean_pred_ctcvr, avg({target}) AS mean_y_ctcvr, avg(a * b - {target}) AS gap_mean,
        quantile_cont(a * b - {target}, 0.5) AS gap_p50, quantile_cont(a * b - {target}, 0.9) AS gap_p90, quantile_cont(a * b - {target}, 0.99) AS gap_p99
        FROM (SELECT *, {P.format(x='ctr_logit')} AS a, {P.format(x='cvr_logit')} AS b FROM scored_fx)"""


def _component_sql(c: str) -> str:
    return f"""SELECT '{c}' AS component, avg({c}) AS mean, stddev_pop({c}) AS std, min({c}) AS "min", max({c}) AS "max", var_pop({c}) / var_pop(total_logit) AS var_ratio, corr({c}, total_logit) AS corr_with_total
        FROM (SELECT *, ctr_logit + cvr_logit AS total_logit FROM scored_fx)"""


SOFTPLUS = "(greatest({x}, 0) + ln(1 + exp(-abs({x}))))"
LOG_P = f"(-{SOFTPLUS.format(x='(-ctr_logit)')} - {SOFTPLUS.format(x='(-cvr_logit)')})"
CAPPED = f"least({LOG_P}, -1e-7)"


def _bce(x: str, y: str, w: str) -> str:
    pos, neg = SOFTPLUS.format(x=f"(-{x})"), SOFTPLUS.format(x=x)
    return f"({w} * {y} * {pos} + (1 - {y}) * {neg})"


GATE_SQL = """
    SELECT task, i - 1 AS expert, avg(w[i]) AS gate_mean, avg(CASE WHEN list_position(w, list_max(w)) = i THEN 1.0 ELSE 0.0 END) AS top1_share,
      avg(-list_sum(list_transform(w, lambda x: greatest(x, 1e-12) * ln(greatest(x, 1e-12))))) AS entropy_mean, count(*) AS n
    FROM gates_fx CROSS JOIN range(1, 5) r(i) GROUP BY task, i"""
UTIL_SQL = f"""
    SELECT *, top1_share < 0.01 AS is_dead, top1_share > 0.8 AS is_monopoly, gini > 0.5 AS load_imbalance FROM (
      SELECT task, expert, gate_mean AS mean_weight, share AS top1_share, greatest(0, least(1,
          2 * sum(rn * share) OVER (PARTITION BY task) / (4 * sum(share) OVER (PARTITION BY task)) - 5 / 4.0)) AS gini
      FROM (SELECT *, top1_share * n / (n + 1e-8) AS share, row_number() OVER (PARTITION BY task ORDER BY top1_share) AS rn FROM ({GATE_SQL})))"""
NAMED_SQL = f"SELECT *, ['mlp_0[SHARE]', 'crossnet_1[SHARE]', 'identity_2[SHARE]', 'tower_3'][expert + 1] AS expert_name FROM ({UTIL_SQL})"


def _similarity_sql() -> str:
    pairs = []
    for i, a in enumerate(EXPERTS):
        for j in range(i + 1, len(EXPERTS)):
            cut = lambda k: f"list_transform(embedding[{k * WIDTH + 1}:{(k + 1) * WIDTH}], lambda x: CAST(x AS DOUBLE))"
            dots = lambda p, q: f"sum(list_inner_product({cut(p)}, {cut(q)}))"
            pairs.append(f"SELECT '{a}' AS expert_i, '{EXPERTS[j]}' AS expert_j, {dots(i, j)} / ((sqrt({dots(i, i)}) + 1e-8) * (sqrt({dots(j, j)}) + 1e-8)) AS similarity FROM embeddings")
    return " UNION ALL ".join(pairs)


SIM_SQL = _similarity_sql()
EMA_SQL = """
    SELECT run_id, sum(CASE WHEN i = 0 THEN 1 ELSE CAST(0.1 AS DOUBLE) END * pow(CAST(0.9 AS DOUBLE), n - 1 - i) * x) AS conflict_rate_ema FROM (
      SELECT run_id, CASE WHEN cos_all < 0 THEN 1 ELSE 0 END AS x, row_number() OVER (PARTITION BY run_id ORDER BY step) - 1 AS i, count(*) OVER (PARTITION BY run_id) AS n
      FROM evals_fx WHERE {where}) GROUP BY run_id"""
PART_SQL = "".join(
    f"avg({c}) FILTER (norm_2 > 0) AS cosine_{p}_mean, "
    + "".join(f"quantile_cont({c}, {q / 100}) FILTER (norm_2 > 0) AS cosine_{p}_p{q}, " for q in (10, 50, 90))
    for p, c in (("dense", "cos_dense"), ("sparse", "cos_sparse"))
)
CONFLICT_SQL = f"""
    SELECT a.*, conflict_rate_ema FROM (
      SELECT run_id, count(*) FILTER (norm_2 > 0) AS collected, count(*) FILTER (norm_2 IS NULL) AS skipped_no_grad, avg(norm_1) FILTER (norm_2 > 0) AS norm_1_mean,
        avg(norm_2) AS norm_2_mean, avg(norm_2 / norm_1) AS norm_ratio_mean, avg(cos_all) FILTER (norm_2 > 0) AS cosine_mean,
        {PART_SQL}
        avg(CASE WHEN cos_all < 0 THEN 1.0 ELSE 0.0 END) FILTER (norm_2 > 0) AS conflict_rate, avg(cos_all) FILTER (norm_2 > 0 AND cos_all < 0) AS neg_conflict_strength,
        quantile_cont(cos_all, 0.1) FILTER (norm_2 > 0) AS cosine_p10, quantile_cont(cos_all, 0.5) FILTER (norm_2 > 0) AS cosine_p50, quantile_cont(cos_all, 0.9) FILTER (norm_2 > 0) AS cosine_p90,
        quantile_cont(norm_2 / norm_1, 0.5) AS norm_ratio_p50, quantile_cont(norm_2 / norm_1, 0.9) AS norm_ratio_p90
      FROM evals_fx GROUP BY run_id) a LEFT JOIN ({EMA_SQL.format(where='norm_2 > 0')}) e ON a.run_id = e.run_id"""
BEST_BEFORE = "max(auc_ctcvr) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
RUN_SQL = """
    SELECT run_id, avg(auc_ctr) AS auc_ctr, avg(auc_cvr) AS auc_cvr, CASE WHEN run_id % 4 <> 0 THEN max(auc_ctcvr) END AS auc_ctcvr, 1 - avg(auc_ctr) AS loss_ctr,
      stddev_pop(auc_cvr) AS ece_cvr, count(*) AS n_rows FROM evals_fx GROUP BY run_id"""
BEST_SQL = f"""
    SELECT run_id, CASE pr WHEN 3 THEN 'known' WHEN 2 THEN 'decision' ELSE 'last' END AS source, global_step AS best_step, auc_ctr, auc_cvr, auc_ctcvr, auc_primary, loss_ctr
    FROM (SELECT l.*, pr, row_number() OVER (PARTITION BY l.run_id ORDER BY pr DESC, global_step DESC) AS rn FROM (
      SELECT l.*, CASE WHEN CAST(l.run_id AS INTEGER) % 5 = 0 AND global_step = k.known THEN 3 WHEN global_step = d.decided THEN 2 ELSE 1 END AS pr
      FROM (SELECT * FROM ({LOG_SQL}) WHERE split = 'valid') l
      LEFT JOIN (SELECT run_id, min(global_step) AS known FROM ({LOG_SQL}) WHERE split = 'valid' GROUP BY run_id) k ON l.run_id = k.run_id
      LEFT JOIN (SELECT run_id, max(global_step) AS decided FROM ({LOG_SQL}) WHERE split = 'valid_decision' AND should_update GROUP BY run_id) d ON l.run_id = d.run_id) l) WHERE rn = 1"""
BOARD_LONG = f"""
    SELECT run_id, metric, value, CASE WHEN metric LIKE 'auc%' THEN -value ELSE value END AS cost FROM (
      SELECT run_id, 'auc_ctr' AS metric, auc_ctr AS value FROM ({RUN_SQL}) UNION ALL SELECT run_id, 'auc_cvr', auc_cvr FROM ({RUN_SQL}) UNION ALL SELECT run_id, 'auc_ctcvr', auc_ctcvr FROM ({RUN_SQL})
      UNION ALL SELECT run_id, 'loss_ctr', loss_ctr FROM ({RUN_SQL}) UNION ALL SELECT run_id, 'ece_cvr', ece_cvr FROM ({RUN_SQL})) WHERE value IS NOT NULL"""

# The gate as a recursion over the evaluations of all runs at once.
GATE_STEP_SQL = """
    WITH RECURSIVE seq AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step) AS i FROM evals_fx),
    st AS (
      SELECT run_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS step, CAST('-inf' AS DOUBLE) AS best, CAST('-inf' AS DOUBLE) AS best_ctr, CAST('-inf' AS DOUBLE) AS best_cvr,
        CAST([] AS DOUBLE[]) AS recent, 0 AS confirmed, 0 AS resting, false AS should_update, '' AS reason, CAST(NULL AS DOUBLE) AS primary_value FROM (SELECT DISTINCT run_id FROM seq)
      UNION ALL
      SELECT run_id, i, step, CASE WHEN upd THEN v ELSE best END, CASE WHEN upd THEN ctr ELSE best_ctr END, CASE WHEN upd THEN cvr ELSE best_cvr END, recent,
        CASE WHEN cool THEN confirmed WHEN upd OR NOT p_ok OR NOT a_ok THEN 0 ELSE confirmed + 1 END, CASE WHEN cool THEN resting - 1 WHEN upd THEN 2 ELSE 0 END, upd,
        CASE WHEN cool THEN 'cooldown' WHEN NOT p_ok THEN 'primary too small' WHEN NOT a_ok THEN 'aux degraded' WHEN upd THEN 'updated' ELSE 'to be confirmed' END, v
      FROM (SELECT *, NOT cool AND p_ok AND a_ok AND confirmed + 1 >= 2 AS upd FROM (
        SELECT *, coalesce(v - best >= CAST(0.002 AS DOUBLE), false) AS p_ok, ctr - best_ctr >= CAST(-0.003 AS DOUBLE) AND cvr - best_cvr >= CAST(-0.008 AS DOUBLE) AS a_ok FROM (
          SELECT * EXCLUDE (recent), h AS recent, CASE WHEN cool THEN NULL ELSE list_sum(h) / len(h) END AS v FROM (
            SELECT seq.run_id, seq.i, seq.step, seq.auc_ctr AS ctr, seq.auc_cvr AS cvr, st.best, st.best_ctr, st.best_cvr, st.recent, st.confirmed, st.resting, st.resting > 0 AS cool,
              CASE WHEN st.resting > 0 THEN st.recent ELSE list_append(st.recent, seq.auc_ctcvr)[-3:] END AS h
            FROM st JOIN seq ON seq.run_id = st.run_id AND seq.i = st.i + 1)))))
    SELECT run_id, step, should_update, reason, primary_value FROM st WHERE i > 0"""

METRIC_COLS = "task:t logloss:r auc:r pos_rate:r pred_mean:r n:i"
BIN_COLS = "bin_left:r bin_right:r n:i avg_pred:r avg_label:r abs_gap:r"
SUMMARY = "ctr_auc:r cvr_auc_masked:r ctcvr_auc:r ctr_logloss:r cvr_logloss_masked:r ctcvr_logloss:r ece_ctr:r ece_cvr_masked:r n:i n_masked:i " \
    "ctr_pos_rate:r cvr_masked_pos_rate:r ctcvr_pos_rate:r ctr_pred_mean:r cvr_masked_pred_mean:r ctcvr_pred_mean:r funnel_gap_mean:r funnel_gap_p50:r funnel_gap_p90:r funnel_gap_p99:r"
BEST_COLS = "run_id:t source:t best_step:i auc_ctr:r auc_cvr:r auc_ctcvr:r auc_primary:r loss_ctr:r"

QUERIES = [
    Query("logloss", "I1", "task:t logloss:r", lambda v: metrics.basic_metrics(tasks(v), ["task"]), f"SELECT task, {LOGLOSS} AS logloss FROM ({TASK_SQL}) GROUP BY task"),
    Query("roc_auc", "I2", "task:t auc:r", lambda v: metrics.auc(tasks(v), "y", "p", ["task"]), AUC_SQL),
    Query("tied_auc", "I2", "auc:r", lambda v: metrics.auc(v.scored.withColumn("s", F.round("ctr_logit", 1)), "y_ctr", "s"),
          AUC_SQL.replace(TASK_SQL, "SELECT 'ctr' AS task, y_ctr AS y, round(ctr_logit, 1) AS p FROM scored_fx")),
    Query("binary_metrics", "I3", METRIC_COLS, lambda v: metrics.binary_metrics(tasks(v), ["task"]), METRIC_SQL),
    Query("reliability_bins", "I4", "task:t " + BIN_COLS, lambda v: metrics.reliability(tasks(v), keys=["task"]), BIN_SQL),
    Query("calibration_error", "I4", "task:t ece:r", lambda v: metrics.ece(metrics.reliability(tasks(v), keys=["task"]), ["task"]), ECE_SQL),
    Query("masked_calibration", "I5", BIN_COLS,
          lambda v: metrics.reliability(metrics.clicked(v.scored).select(F.col("y_cvr").alias("y"), scalars.sigmoid(F.col("cvr_logit")).alias("p"))),
          f"SELECT * FROM ({BIN_SQL}) WHERE task = 'cvr'"),
    Query("funnel_consistency", "I6", "target:t n:i mean_pred_ctcvr:r mean_y_ctcvr:r gap_mean:r gap_p50:r gap_p90:r gap_p99:r", q_funnel,
          f"""{_funnel_sql('CAST(y_ctcvr AS DOUBLE)', 'label')} UNION ALL {_funnel_sql('(a + b) / 2', 'head')}
              UNION ALL SELECT 'none', count(*), avg({P.format(x='ctr_logit')} * {P.format(x='cvr_logit')}), NULL, NULL, NULL, NULL, NULL FROM scored_fx"""),
    Query("evaluation_summary", "I7", SUMMARY, lambda v: metrics.evaluation_summary(v.scored),
          f"""SELECT max(auc) FILTER (task = 'ctr') AS ctr_auc, max(auc) FILTER (task = 'cvr') AS cvr_auc_masked, max(auc) FILTER (task = 'ctcvr') AS ctcvr_auc, max(logloss) FILTER (task = 'ctr') AS ctr_logloss,
               max(logloss) FILTER (task = 'cvr') AS cvr_logloss_masked, max(logloss) FILTER (task = 'ctcvr') AS ctcvr_logloss, max(ece) FILTER (task = 'ctr') AS ece_ctr, max(ece) FILTER (task = 'cvr') AS ece_cvr_masked,
               max(m.n) FILTER (task = 'ctr') AS n, max(m.n) FILTER (task = 'cvr') AS n_masked,
               max(pos_rate) FILTER (task = 'ctr') AS ctr_pos_rate, max(pos_rate) FILTER (task = 'cvr') AS cvr_masked_pos_rate, max(pos_rate) FILTER (task = 'ctcvr') AS ctcvr_pos_rate,
               max(pred_mean) FILTER (task = 'ctr') AS ctr_pred_mean, max(pred_mean) FILTER (task = 'cvr') AS cvr_masked_pred_mean, max(pred_mean) FILTER (task = 'ctcvr') AS ctcvr_pred_mean,
               max(gap_mean) AS funnel_gap_mean, max(gap_p50) AS funnel_gap_p50, max(gap_p90) AS funnel_gap_p90, max(gap_p99) AS funnel_gap_p99
               FROM ({METRIC_SQL}) m JOIN ({ECE_SQL}) e USING (task) CROSS JOIN ({_funnel_sql('CAST(y_ctcvr AS DOUBLE)', 'label')}) f"""),
    Query("component_stats", "I8", "component:t mean:r std:r min:r max:r var_ratio:r corr_with_total:r", q_component_stats,
          " UNION ALL ".join(_component_sql(c) for c in ("ctr_logit", "cvr_logit", "total_logit"))),
    Query("label_counts", "I9", "ctr_pos:i ctr_pos_rate:r cvr_pos_masked:i cvr_pos_rate_masked:r ctcvr_pos:i ctcvr_pos_rate:r masked_n:i cvr_metric_reliable:b ctcvr_metric_reliable:b", lambda v: metrics.label_counts(v.scored),
          """SELECT sum(y_ctr) AS ctr_pos, avg(y_ctr) AS ctr_pos_rate, sum(y_cvr * click_mask) AS cvr_pos_masked, sum(y_cvr * click_mask) / sum(click_mask) AS cvr_pos_rate_masked, sum(y_ctcvr) AS ctcvr_pos,
               avg(y_ctcvr) AS ctcvr_pos_rate, sum(click_mask) AS masked_n, sum(y_cvr * click_mask) >= 100 AS cvr_metric_reliable, sum(y_ctcvr) >= 100 AS ctcvr_metric_reliable FROM scored_fx"""),
    Query("logit_stats", "I10", "task:t mean:r std:r min:r max:r p01:r p99:r", lambda v: metrics.logit_stats(tasks(v), "logit", ["task"]),
          f'SELECT task, avg(logit) AS mean, stddev_samp(logit) AS std, min(logit) AS "min", max(logit) AS "max", quantile_cont(logit, 0.01) AS p01, quantile_cont(logit, 0.99) AS p99 FROM ({TASK_SQL}) GROUP BY task'),
    Query("probability_stats", "I11", "task:t mean:r p01:r p99:r", lambda v: metrics.prob_stats(tasks(v), "p", ["task"]),
          f"SELECT task, avg(p) AS mean, quantile_cont(p, 0.01) AS p01, quantile_cont(p, 0.99) AS p99 FROM ({TASK_SQL}) GROUP BY task"),
    Query("auc_primary", "I12", "run_id:i auc_primary:r", q_auc_primary,
          f"""SELECT run_id, CASE WHEN auc_ctcvr IS NOT NULL AND run_id % 6 <> 0 THEN auc_ctcvr + CAST(0.2 AS DOUBLE) * auc_ctr + CAST(0.2 AS DOUBLE) * auc_cvr
               WHEN run_id % 6 <> 0 THEN (auc_ctr + auc_cvr) / 2 ELSE auc_ctr END AS auc_primary FROM ({RUN_SQL})"""),
    Query("metric_aliases", "I13", "run_id:i auc_cvr:r auc_cvr_click:r n_rows:i n_exposure:i", lambda v: metrics.with_aliases(run_metrics(v)),
          f"SELECT *, auc_cvr AS auc_cvr_click, n_rows AS n_exposure FROM ({RUN_SQL})"),
    Query("weighted_bce", "I14", "pos_weight_ctr:r pos_weight_cvr:r loss_ctr:r loss_cvr:r mask_sum:r", lambda v: losses.weighted_bce(v.scored, clip_ctr=1.5),
          f"""SELECT max(w1) AS pos_weight_ctr, max(w2) AS pos_weight_cvr, avg({_bce('ctr_logit', 'y_ctr', 'w1')}) AS loss_ctr, sum(click_mask * {_bce('cvr_logit', 'y_cvr', 'w2')}) / (sum(click_mask) + 1e-6) AS loss_cvr, sum(click_mask) AS mask_sum
              FROM scored_fx, (SELECT least(1.5, sum(1 - y_ctr) / sum(y_ctr)) AS w1, sum((1 - y_cvr) * click_mask) / sum(y_cvr * click_mask) AS w2 FROM scored_fx)"""),
    Query("joint_loss", "I15", "loss_ctcvr:r", lambda v: losses.joint_loss(v.scored, pos_weight=20.0, clip=8.0),
          f"SELECT avg(CASE WHEN y_ctcvr = 1 THEN -8 * {CAPPED} ELSE -ln(1 - exp({CAPPED})) END) AS loss_ctcvr FROM scored_fx"),
    Query("focal_loss", "I16", "kind:t focal_loss:r",
          lambda v: losses.focal_metric(v.scored, "ctr_logit", "y_ctr").withColumn("kind", F.lit("plain")).unionByName(
              losses.focal_metric(v.scored, "ctr_logit", "y_ctr", 1.0, 0.25).withColumn("kind", F.lit("alpha"))),
          f"""SELECT 'plain' AS kind, avg(pow(1 - CASE WHEN y_ctr = 1 THEN p ELSE 1 - p END, 2) * {_bce('ctr_logit', 'y_ctr', '1')}) AS focal_loss FROM (SELECT *, {P.format(x='ctr_logit')} AS p FROM scored_fx)
              UNION ALL SELECT 'alpha', avg(CASE WHEN y_ctr = 1 THEN 0.25 ELSE 0.75 END * (1 - CASE WHEN y_ctr = 1 THEN p ELSE 1 - p END) * {_bce('ctr_logit', 'y_ctr', '1')}) FROM (SELECT *, {P.format(x='ctr_logit')} AS p FROM scored_fx)"""),
    Query("sigmoid", "H14", "row_id:i p:r", q_sigmoid, "SELECT row_id, 1 / (1 + exp(-(ctr_logit * 500))) AS p FROM scored_fx"),
    Query("joint_logit", "H15", "row_id:i joint:r", q_joint_logit,
          f"SELECT row_id, ln(j / (1 - j)) AS joint FROM (SELECT row_id, greatest(1e-8, least(1 - 1e-8, {P.format(x='ctr_logit')} * {P.format(x='cvr_logit')})) AS j FROM scored_fx)"),
    Query("logit_correction", "H16", "row_id:i corrected:r exact:r", q_correction, f"SELECT row_id, ctr_logit - ln((1 - {KEEP_PROB}) / {KEEP_PROB}) AS corrected, ctr_logit + ln({KEEP_PROB}) AS exact FROM scored_fx"),
    Query("log1mexp", "H17", "row_id:i log_1m_p:r bce:r", q_log_p,
          f"SELECT row_id, ln(1 - exp({LOG_P})) AS log_1m_p, CASE WHEN y_ctcvr = 1 THEN -{CAPPED} ELSE -ln(1 - exp({CAPPED})) END AS bce FROM scored_fx"),
    Query("gate_summary", "I17", "task:t expert:i gate_mean:r top1_share:r entropy_mean:r", lambda v: health.gate_summary(v.gates), GATE_SQL),
    Query("expert_utilisation", "I18", "task:t expert:i top1_share:r mean_weight:r is_dead:b is_monopoly:b gini:r load_imbalance:b", lambda v: health.utilisation(v.gates), UTIL_SQL),
    Query("spend_gini", "I19", "c4:i gini:r",
          lambda v: health.gini(v.samples.join(v.table("orders"), F.col("row_id") == F.col("o_orderkey")), ["c4"], "o_totalprice"),
          """SELECT c4, 2 * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1) / count(*) AS gini FROM (
               SELECT CAST(o_custkey % 7 AS INTEGER) AS c4, o_totalprice AS x, row_number() OVER (PARTITION BY o_custkey % 7 ORDER BY o_totalprice) AS i FROM orders) GROUP BY c4"""),
    Query("expert_type_usage", "I20", "task:t expert_type:t avg_top1_share:r avg_mean_weight:r expert_count:i", lambda v: health.type_usage(named_usage(v)),
          f"""SELECT task, CASE WHEN expert_name LIKE 'mlp%' THEN 'mlp' WHEN expert_name LIKE 'cross%' THEN 'crossnet' WHEN expert_name LIKE 'identity%' THEN 'identity' ELSE 'other' END AS expert_type,
               avg(top1_share) AS avg_top1_share, avg(mean_weight) AS avg_mean_weight, count(*) AS expert_count FROM ({NAMED_SQL}) GROUP BY 1, 2"""),
    Query("cross_task_use", "I20", "expert_name:t first_share:r second_share:r specialization_score:r", lambda v: health.cross_task(named_usage(v), "ctr", "cvr"),
          f"""SELECT expert_name, a AS first_share, b AS second_share, abs(a - b) AS specialization_score FROM (
               SELECT expert_name, max(top1_share) FILTER (task = 'ctr') AS a, max(top1_share) FILTER (task = 'cvr') AS b FROM ({NAMED_SQL}) WHERE expert_name LIKE '%[SHARE]' GROUP BY expert_name)"""),
    Query("expert_output_stats", "I21", "expert:i mean:r std:r sparsity:r abs_max:r", q_output_stats,
          f"""SELECT (pos - 1) // {WIDTH} AS expert, avg(x) AS mean, stddev_samp(x) AS std, avg(CASE WHEN abs(x) < 1e-5 THEN 1.0 ELSE 0.0 END) AS sparsity, max(abs(x)) AS abs_max
              FROM (SELECT generate_subscripts(embedding, 1) AS pos, round(CAST(unnest(embedding) AS DOUBLE), 2) AS x FROM embeddings) GROUP BY 1"""),
    Query("expert_similarity", "I22", "expert_i:t expert_j:t similarity:r alert:b", lambda v: health.output_similarity(expert_rows(v), EXPERTS), f"SELECT *, similarity > 0.95 AS alert FROM ({SIM_SQL})"),
    Query("similarity_summary", "I22", "similarity_mean:r similarity_max:r similarity_min:r collapse_alert:b", lambda v: health.similarity_summary(health.output_similarity(expert_rows(v), EXPERTS)),
          f"SELECT avg(similarity) AS similarity_mean, max(similarity) AS similarity_max, min(similarity) AS similarity_min, max(similarity) > 0.95 AS collapse_alert FROM ({SIM_SQL})"),
    Query("conflict_summary", "I23", "run_id:i collected:i skipped_no_grad:i norm_1_mean:r norm_2_mean:r norm_ratio_mean:r cosine_mean:r conflict_rate:r neg_conflict_strength:r cosine_p10:r cosine_p50:r cosine_p90:r norm_ratio_p50:r norm_ratio_p90:r conflict_rate_ema:r cosine_dense_mean:r cosine_dense_p10:r cosine_dense_p50:r cosine_dense_p90:r cosine_sparse_mean:r cosine_sparse_p10:r cosine_sparse_p50:r cosine_sparse_p90:r",
          lambda v: health.conflict_summary(v.evals, ["run_id"], ["step"]), CONFLICT_SQL),
    Query("conflict_ema", "E14", "run_id:i conflict_rate_ema:r",
          lambda v: health.ema(v.evals.withColumn("hit", (F.col("cos_all") < 0).cast("int")), ["run_id"], ["step"], "hit", out="conflict_rate_ema"), EMA_SQL.format(where="true")),
    Query("running_best", "E11", "run_id:i updates:i best_step:i", q_running_best,
          f"SELECT run_id, count(*) AS updates, max(step) AS best_step FROM (SELECT *, {BEST_BEFORE} AS b FROM evals_fx) WHERE b IS NULL OR auc_ctcvr > b GROUP BY run_id"),
    Query("trailing_average", "E12", "run_id:i step:i metric_ma:r", lambda v: runs.smoothed(v.evals, "run_id", "step", "auc_ctcvr", 3),
          "SELECT run_id, step, avg(auc_ctcvr) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS metric_ma FROM evals_fx"),
    Query("gated_best", "E13", "run_id:i step:i should_update:b reason:t primary_value:r", lambda v: runs.gated_best(v.evals, "run_id", "step", GATE), GATE_STEP_SQL),
    Query("best_records", "K1", BEST_COLS, best, BEST_SQL),
    Query("run_summary", "K2", "run_id:t description:t status:t best_step:i auc_ctcvr:r", q_run_summary,
          f"""SELECT m.run_id, m.description, CASE WHEN best_step IS NULL THEN 'no valid records' ELSE 'ok' END AS status, best_step, auc_ctcvr
              FROM (SELECT CAST(c_custkey AS VARCHAR) AS run_id, c_mktsegment AS description FROM customer) m LEFT JOIN ({BEST_SQL}) b ON m.run_id = b.run_id"""),
    Query("metric_deltas", "K3", "label:t run_new:t run_base:t metric:t value_new:r value_base:r delta:r delta_pct:r missing:b", q_deltas,
          f"""SELECT *, n - o AS delta, (n - o) / o * 100 AS delta_pct, n IS NULL OR o IS NULL AS missing, n AS value_new, o AS value_base FROM (
               SELECT 'next of ' || r.run_id AS label, CAST(r.run_id + 1 AS VARCHAR) AS run_new, CAST(r.run_id AS VARCHAR) AS run_base, CASE WHEN r.run_id % 2 = 0 THEN 'auc_ctcvr' ELSE 'loss_cvr' END AS metric,
                 CASE WHEN r.run_id % 2 = 0 THEN x.auc_ctcvr END AS n, CASE WHEN r.run_id % 2 = 0 THEN y.auc_ctcvr END AS o
               FROM (SELECT DISTINCT run_id FROM evals_fx) r LEFT JOIN ({BEST_SQL}) x ON x.run_id = CAST(r.run_id + 1 AS VARCHAR) LEFT JOIN ({BEST_SQL}) y ON y.run_id = CAST(r.run_id AS VARCHAR))"""),
    Query("leaderboard", "K4", "run_id:i metric:t value:r is_best:b is_overall_best:b", lambda v: runs.leaderboard(run_metrics(v)),
          f"""SELECT run_id, metric, value, row_number() OVER (PARTITION BY metric ORDER BY cost, run_id) = 1 AS is_best,
               run_id = (SELECT run_id FROM ({BOARD_LONG}) WHERE metric = 'auc_ctcvr' ORDER BY cost, run_id LIMIT 1) AS is_overall_best FROM ({BOARD_LONG})"""),
    Query("given_weight_scores", "R3 R4", "row_id:i first_order:r second_order:r", q_given_weights,
          """SELECT row_id, sum(s * (idx % 101 - 50) / 100.0) AS first_order,
               (pow(sum(s * a), 2) - sum(s * a * ea) + pow(sum(s * b), 2) - sum(s * b * eb)) / 2 / 6 AS second_order
             FROM (SELECT *, sum(s * a) OVER (PARTITION BY row_id, name) AS ea, sum(s * b) OVER (PARTITION BY row_id, name) AS eb FROM (SELECT row_id, name, idx, CASE WHEN use_value THEN val ELSE CAST(1 AS DOUBLE) END / count(*) OVER (PARTITION BY row_id, name) AS s,
               (idx * 7 % 23 - 11) / CAST(50 AS DOUBLE) AS a, (idx * 3 % 19 - 9) / CAST(50 AS DOUBLE) AS b FROM encoded_fx)) GROUP BY row_id"""),
    Query("linear_scorer", "R3", "row_id:i entity_id:t split:t y_ctr:i y_cvr:i ctr_logit:r cvr_logit:r", lambda v: scorers.linear_scores(v.processed, FEATURES), scorer_sql(0)),
    Query("factorisation_scorer", "R4", "row_id:i entity_id:t split:t y_ctr:i y_cvr:i ctr_logit:r cvr_logit:r", lambda v: scorers.factorisation_scores(v.processed, FEATURES, factors=2), scorer_sql(2)),
]
