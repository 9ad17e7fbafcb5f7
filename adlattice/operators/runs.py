"""Model selection over evaluation logs and comparison of runs."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from adlattice.operators.joins import lookup_join
from adlattice.operators.ordered import group_rank, ordered_prefix, trailing_mean
from adlattice.session import durable
from adlattice.sources.logs import METRIC_COLUMNS, decision_records, valid_records

# Metrics of the leaderboard, +1 where larger is better.
LEADERBOARD = {
    "auc_ctr": 1, "auc_cvr": 1, "auc_ctcvr": 1, "auc_primary": 1,
    "loss_ctr": -1, "loss_cvr": -1, "loss_ctcvr": -1, "loss_total": -1,
    "ece_ctr": -1, "ece_cvr": -1, "ece_ctcvr": -1,
}


#: Evaluations of a run that one task decides.
SEGMENT = 100_000


def running_best(evals: DataFrame, run: str, step: str, metric: str, partitions: int | None = None) -> DataFrame:
    """``should_update`` where the metric beats every earlier evaluation of the run.

    A missing metric never updates.
    """
    before = ordered_prefix(evals, [run], [step], {"best_before": ("max", metric)}, partitions=partitions)
    better = F.col(metric).isNotNull() & (F.col("best_before").isNull() | (F.col(metric) > F.col("best_before")))
    return before.withColumn("should_update", better)


def smoothed(evals: DataFrame, run: str, step: str, metric: str, window: int, **layout) -> DataFrame:
    """Mean of the last ``window`` evaluations of the run."""
    return trailing_mean(evals, [run], [step], metric, window, "metric_ma", **layout)


@dataclass(frozen=True)
class GateRule:
    """When a run's best model is replaced."""

    primary: str = "auc_ctcvr"
    aux: tuple[str, ...] = ("auc_ctr", "auc_cvr")
    tol_primary: float = 0.0
    tol_aux: Mapping[str, float] = field(default_factory=dict)
    confirm_times: int = 1
    cooldown: int = 0
    window: int | None = None


class _Gate:
    """State of one run: a few numbers, whatever the length of the log."""

    def __init__(self, rule: GateRule, state: list[float] | None = None) -> None:
        self.rule = rule
        n = len(rule.aux)
        state = [float("-inf")] * (1 + n) + [0.0, 0.0] if state is None else list(state)
        self.best, self.best_aux = state[0], dict(zip(rule.aux, state[1 : 1 + n]))
        self.confirmed, self.resting = int(state[1 + n]), int(state[2 + n])
        self.recent: deque[float] = deque(state[3 + n :], maxlen=rule.window or 1)

    def state(self) -> list[float]:
        return [self.best, *self.best_aux.values(), float(self.confirmed), float(self.resting), *self.recent]

    def step(self, primary: float | None, aux: Mapping[str, float | None]) -> tuple[bool, str, float | None]:
        if self.resting:
            self.resting -= 1
            return False, "cooldown", None
        if primary is None:
            return False, "no primary", None
        self.recent.append(primary)
        value = sum(self.recent) / len(self.recent)
        if value - self.best < self.rule.tol_primary:
            self.confirmed = 0
            return False, "primary too small", value
        kept = all(
            v is not None and v - self.best_aux[k] >= -self.rule.tol_aux.get(k, 0.0) for k, v in aux.items()
        )
        if not kept:
            self.confirmed = 0
            return False, "aux degraded", value
        self.confirmed += 1
        if self.confirmed < self.rule.confirm_times:
            return False, "to be confirmed", value
        self.best, self.best_aux = value, dict(aux)
        self.confirmed, self.resting = 0, self.rule.cooldown
        return True, "updated", value


def _walk(rows: DataFrame, run: str, step: str, rule: GateRule, decisions: bool) -> DataFrame:
    """Every segment from its entry state, in step order: its decisions, or its exit state.

    A task holds one Arrow batch and a constant state, never a segment.
    """
    columns = [run, "_segment", "_entry", step, rule.primary, *rule.aux]
    number = lambda v: None if pd.isna(v) else float(v)

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, gate = None, None
        for batch in batches:
            out, left = [], []
            for key, segment, entry, _, primary, *aux in batch[columns].itertuples(index=False, name=None):
                if gate is None or (key, segment) != current:
                    if gate is not None:
                        left.append((*current, gate.state()))
                    current, gate = (key, segment), _Gate(rule, None if entry is None else [float(x) for x in entry])
                out.append(gate.step(number(primary), {k: number(v) for k, v in zip(rule.aux, aux)}))
            if decisions:
                made = pd.DataFrame(out, columns=["should_update", "reason", "primary_value"], index=batch.index)
                yield pd.concat([batch[[run, step]], made], axis=1)
            elif left:
                yield pd.DataFrame(left, columns=[run, "_segment", "_exit"])
        if gate is not None and not decisions:
            yield pd.DataFrame([(*current, gate.state())], columns=[run, "_segment", "_exit"])

    types = dict(rows.dtypes)
    schema = f"{run} {types[run]}, _segment long, _exit array<double>"
    if decisions:
        schema = f"{run} {types[run]}, {step} {types[step]}, should_update boolean, reason string, primary_value double"
    ordered = rows.select(*columns).repartition(run, "_segment").sortWithinPartitions(run, "_segment", step)
    return ordered.mapInPandas(go, schema)


def _entries(states: DataFrame, run: str) -> DataFrame:
    """(run, _segment, _entry) from the exit states: that of the segment before; null for a run's first."""
    order = Window.partitionBy(run).orderBy("_segment")
    return states.select(run, "_segment", F.lag("_exit").over(order).alias("_entry"))


def _guessed(states: DataFrame, run: str) -> DataFrame:
    """Entry states from exits of segments that each began anew: the best of all segments before, the rest from the last one.

    A run's best changes at accepted updates alone, which grow rare, so most of these are right.
    """
    before = Window.partitionBy(run).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    best = F.max(F.struct(F.col("_exit")[0].alias("best"), F.col("_exit").alias("of"))).over(before)["of"]
    last = F.last("_exit").over(before)
    return states.select(run, "_segment", best.alias("_b"), last.alias("_l"))


def gated_best(evals: DataFrame, run: str, step: str, rule: GateRule, segment: int = SEGMENT) -> DataFrame:
    """Per evaluation: the gate's decision, its reason and the (smoothed) primary value.

    Each decision depends on the one before. A run longer than ``segment`` evaluations is cut into segments that are walked at the same
    time from guessed entry states; a segment whose entry turns out to be another is walked again from the right one, until all
    agree. Then every segment's decisions are made at once. A step of a run is one evaluation; further ones of the step come in the order of their values.
    """
    columns = [run, step, rule.primary, *rule.aux]
    none = F.lit(None).cast("array<double>")
    plain = evals.select(*columns)
    longest = plain.groupBy(run).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    if longest <= segment:
        return _walk(plain.withColumns({"_segment": F.lit(0).cast("long"), "_entry": none}), run, step, rule, True)
    placed = group_rank(plain, [run], [step, *columns[2:]], "_at")
    rows = durable(placed.withColumn("_segment", F.floor(F.col("_at") / F.lit(segment)).cast("long")).drop("_at"))
    key = [run, "_segment"]
    exits = durable(_walk(rows.withColumn("_entry", none), run, step, rule, False))
    head = 1 + len(rule.aux)
    guess = F.when(F.col("_b").isNotNull(), F.concat(F.slice("_b", 1, head), F.slice("_l", head + 1, 2 + (rule.window or 1))))
    used = durable(_guessed(exits, run).select(*key, guess.alias("_entry")))
    exits = durable(_walk(lookup_join(rows, used, key, "inner", [step]), run, step, rule, False))
    while True:
        right = durable(_entries(exits, run))
        wrong = right.join(used.withColumnRenamed("_entry", "_used"), key).where(~F.col("_entry").eqNullSafe(F.col("_used")))
        wrong = durable(wrong.select(*key, "_entry"))
        if wrong.isEmpty():
            break
        again = _walk(lookup_join(rows, wrong, key, "inner", [step]), run, step, rule, False)
        exits = durable(exits.join(wrong, key, "left_anti").unionByName(again))
        used = right
    return _walk(lookup_join(rows, used, key, "inner", [step]), run, step, rule, True)


def best_records(log: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The record that stands for each run.

    The evaluation at the known best step; else the one at the last accepted decision; else the
    last one, that of the largest step. ``known`` has (run_id, best_step). Where a step is logged
    twice (a resumed run), the first record stands for a known or accepted step, the last one for the
    last evaluation; logs without ``position`` must not repeat a step. One aggregation, no ordering
    of a run.
    """
    if "position" not in log.columns:
        log = log.withColumn("position", F.lit(0))
    decided = (
        decision_records(log).where(F.col("should_update")).groupBy("run_id").agg(F.max("global_step").alias("decided"))
    )
    evals = lookup_join(valid_records(log), decided, ["run_id"], "left", spread_by=["global_step"])
    if known is not None:
        steps = known.select("run_id", F.col("best_step").alias("known"))
        evals = lookup_join(evals, steps, ["run_id"], "left", spread_by=["global_step"])
    else:
        evals = evals.withColumn("known", F.lit(None).cast("long"))
    rank = (
        F.when(F.col("global_step") == F.col("known"), 3).when(F.col("global_step") == F.col("decided"), 2).otherwise(1)
    )
    record = F.struct(F.col("global_step").alias("best_step"), *METRIC_COLUMNS)
    source = F.element_at(F.array(F.lit("last"), F.lit("decision"), F.lit("known")), F.col("r"))
    best = F.when(F.col("r") == 1, F.col("last")).otherwise(F.col("first"))
    return (
        evals.withColumn("_rank", rank)
        .groupBy("run_id")
        .agg(
            F.max_by(record, F.struct("_rank", "global_step", "position")).alias("last"),
            F.min_by(record, F.struct(-F.col("_rank"), F.col("position"))).alias("first"),
            F.max("_rank").alias("r"),
        )
        .select("run_id", source.alias("source"), best.alias("b"))
        .select("run_id", "source", "b.*")
    )


def run_summary(best: DataFrame, runs: DataFrame) -> DataFrame:
    """One line per run of the metadata table, with its best record when there is one."""
    return runs.join(best, "run_id", "left").withColumn(
        "status", F.when(F.col("best_step").isNull(), "no valid records").otherwise("ok")
    )


def metric_deltas(best: DataFrame, pairs: DataFrame) -> DataFrame:
    """Difference of a metric between a run and its baseline; ``pairs`` has (label, run_new, run_base, metric)."""
    long = best.select(
        "run_id", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in METRIC_COLUMNS]))
    )
    new = long.select(F.col("run_id").alias("run_new"), "metric", F.col("v").alias("value_new"))
    base = long.select(F.col("run_id").alias("run_base"), "metric", F.col("v").alias("value_base"))
    delta = F.col("value_new") - F.col("value_base")
    return (
        pairs.join(new, ["run_new", "metric"], "left")
        .join(base, ["run_base", "metric"], "left")
        .select(
            "label", "run_new", "run_base", "metric", "value_new", "value_base",
            delta.alias("delta"),
            F.when(F.col("value_base") != 0, delta / F.col("value_base") * 100)
            .when(delta.isNotNull(), F.lit(0.0))
            .alias("delta_pct"),
            delta.isNull().alias("missing"),
        )
    )


def leaderboard(runs: DataFrame, metrics: Mapping[str, int] = LEADERBOARD) -> DataFrame:
    """Long table (run_id, metric, value, is_best, is_overall_best); ties go to the first run id.

    The overall best run is that of auc_primary, or of auc_ctcvr when no run has the former.
    """
    present = {m: d for m, d in metrics.items() if m in runs.columns}
    lines = runs.select(
        "run_id",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), (F.lit(-d) * F.col(m)).alias("cost"))
                    for m, d in present.items()
                ]
            )
        ),
    ).where(F.col("value").isNotNull())
    winners = lines.groupBy("metric").agg(F.min(F.struct("cost", "run_id")).alias("w"))
    lead = {"auc_primary": 1, "auc_ctcvr": 2}
    overall = winners.where(F.col("metric").isin(*lead)).agg(
        F.min_by(F.col("w.run_id"), F.when(F.col("metric") == "auc_primary", 1).otherwise(2)).alias("run_id")
    )
    # One winner per metric of the list above.
    return lines.join(F.broadcast(winners), "metric").select(
        "run_id",
        "metric",
        "value",
        (F.col("run_id") == F.col("w.run_id")).alias("is_best"),
        (F.col("run_id") == overall.scalar()).alias("is_overall_best"),
    )
