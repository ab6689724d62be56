"""Statistics over runs, steps, sessions and calls: all groups of a table in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latchline.functions.stats import by_index, clamped, slope, sorted_values, spread
from latchline.operators.ordered import with_running

# Weights of share, anomaly and trend in the score, and the trend labels' bound in ms per run.
SHARE, ANOMALY, TREND, MOST_Z, RISING = 0.5, 0.3, 0.2, 5.0, 10.0
# A call is a regression from this ratio on, and critical from that; least rows and duration.
WARNING, CRITICAL, LEAST_ROWS, LEAST_MS = 1.5, 2.5, 3, 50


def step_history(runs: DataFrame, steps: DataFrame, last_n: int) -> DataFrame:
    """The last ``last_n`` timings of each (repository, step) that the last ``last_n`` runs contain, with ``idx`` 0, 1, ... oldest first.

    The filter on the rank is a group limit, applied before the shuffle, so a step of any history sends ``last_n`` rows per task.
    """
    r = runs.select(F.col("id").alias("run_id"), "repository_id", "created_at")
    newest = Window.partitionBy("repository_id").orderBy(F.desc("created_at"), F.desc("run_id"))
    recent = r.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= last_n)
    s = steps.select(F.col("pipeline_run_id").alias("run_id"), "step_name", F.col("id").alias("step_id"), "duration_ms").filter("duration_ms is not null and step_name is not null")
    named = recent.join(s, "run_id").select("repository_id", "step_name").distinct()
    rows = r.join(s, "run_id")
    per = Window.partitionBy("repository_id", "step_name").orderBy(F.desc("created_at"), F.desc("run_id"), F.desc("step_id"))
    kept = rows.withColumn("_r", F.row_number().over(per)).filter(F.col("_r") <= last_n)
    kept = kept.join(named, ["repository_id", "step_name"], "left_semi")
    return kept.withColumn("idx", F.count(F.lit(1)).over(Window.partitionBy("repository_id", "step_name")) - F.col("_r")).drop("_r")


def step_statistics(runs: DataFrame, steps: DataFrame, last_n: int = 50) -> DataFrame:
    """Count, mean, percentiles, spread, slope and latest value per (repository, step)."""
    d = F.col("duration_ms")
    grouped = step_history(runs, steps, last_n).groupBy("repository_id", "step_name")
    out = grouped.agg(
        F.count(d).alias("n"), F.avg(d).alias("mean_ms"), spread(d).alias("std_ms"), slope(d, F.col("idx")).alias("trend_slope"),
        F.max_by("duration_ms", "idx").alias("latest_ms"), sorted_values(d).alias("_v"),
    )
    return out.withColumn("p50_ms", by_index(F.col("_v"), 0.5)).withColumn("p95_ms", by_index(F.col("_v"), 0.95)).drop("_v")


def bottleneck_ranking(runs: DataFrame, steps: DataFrame, last_n: int = 50, top_n: int = 3) -> DataFrame:
    """The ``top_n`` steps of each repository by share of time, deviation of the latest run and trend.

    Ties of the rounded score go by step name.
    """
    s = step_statistics(runs, steps, last_n)
    repo = Window.partitionBy("repository_id")
    total = F.sum("mean_ms").over(repo)
    s = s.withColumn("_share", F.when(total > 0, F.col("mean_ms") / total).otherwise(0.0))
    z = F.when((F.col("std_ms") > 0) & (F.col("n") >= 2), clamped((F.col("latest_ms") - F.col("mean_ms")) / F.col("std_ms"), 0.0, MOST_Z)).otherwise(0.0)
    s = s.withColumn("_z", z)
    score = SHARE * F.col("_share") + ANOMALY * F.col("_z") / MOST_Z + F.when(F.col("trend_slope") > 0, TREND).otherwise(0.0)
    s = s.withColumn("score", F.bround(score, 4))
    rank = Window.partitionBy("repository_id").orderBy(F.desc("score"), "step_name")
    trend = F.when(F.col("trend_slope") > RISING, "increasing").when(F.col("trend_slope") < -RISING, "decreasing").otherwise("stable")
    ranked = s.withColumn("rank_no", F.row_number().over(rank)).filter(F.col("rank_no") <= top_n)
    return ranked.select(
        "repository_id", "rank_no", "step_name", "score", "n", F.bround(F.col("_share") * 100, 1).alias("pct_of_total"), F.bround("mean_ms", 1).alias("mean_ms"),
        "p50_ms", "p95_ms", F.bround("_z", 2).alias("anomaly"), trend.alias("trend"), "latest_ms",
    )


def call_baselines(calls: DataFrame, sessions: DataFrame) -> DataFrame:
    """For each (app, function, session) the count, and by value the counts of calls, needed to leave one session out."""
    s = sessions.select(F.col("id").alias("session_id"), "app_name")
    c = calls.select(F.col("id").alias("call_id"), "session_id", "function_name", "duration_ms").filter("duration_ms is not null")
    return c.join(s, "session_id")


def regressions(calls: DataFrame, sessions: DataFrame) -> DataFrame:
    """Calls slower than the function's baseline in the app's other sessions; one per (session, function), the first by id.

    The baseline is the upper median of all calls of other sessions, at least three.
    It is found without pairing sessions: values are counted per (app, function, value) and, apart,
    per session; the median of the others is where the running count of all minus the session's
    own passes half.  A session only meets the values it has itself, and, of the rest, their sums.
    """
    rows = call_baselines(calls, sessions).filter("function_name is not null")
    key = ["app_name", "function_name"]
    by_value = rows.groupBy(*key, "duration_ms").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(*key).orderBy("duration_ms")
    by_value = by_value.withColumn("_upto", F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    totals = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_all"))
    slow = rows.filter(F.col("duration_ms") >= LEAST_MS).groupBy(*key, "session_id").agg(F.count(F.lit(1)).alias("_slow"))
    own = rows.groupBy(*key, "session_id").agg(F.count(F.lit(1)).alias("_own"))
    # The removed session shifts the place in the full order by at most its own size: look at that stretch only.
    place = own.join(slow.drop("_slow"), [*key, "session_id"], "left_semi").join(totals, key).withColumn("_rest", F.col("_all") - F.col("_own")).filter(F.col("_rest") >= LEAST_ROWS)
    place = place.withColumn("_half", F.floor(F.col("_rest") / 2))
    mine = rows.groupBy(*key, "session_id", "duration_ms").agg(F.count(F.lit(1)).alias("_m"))
    spots = by_value.join(place, key).filter((F.col("_upto") > F.col("_half")) & (F.col("_upto") - F.col("_n") <= F.col("_half") + F.col("_own")))
    spots = spots.join(mine.select(*key, "session_id", F.col("duration_ms").alias("_d"), "_m"), [*key, "session_id"])
    left = spots.groupBy(*key, "session_id", "duration_ms", "_upto", "_half").agg(F.sum(F.when(F.col("_d") <= F.col("duration_ms"), F.col("_m")).otherwise(0)).alias("_gone"))
    base = left.filter(F.col("_upto") - F.col("_gone") > F.col("_half")).groupBy(*key, "session_id").agg(F.min("duration_ms").alias("_base"))
    met = rows.filter(F.col("duration_ms") >= LEAST_MS).join(base, [*key, "session_id"]).filter("_base > 0")
    ratio = F.col("duration_ms") / F.col("_base")
    hit = met.filter(ratio >= WARNING)
    first = hit.groupBy("app_name", "session_id", "function_name").agg(F.min_by(F.struct("call_id", "duration_ms", "_base"), "call_id").alias("_h"))
    ratio = F.col("_h.duration_ms") / F.col("_h._base")
    return first.select(
        "session_id", "app_name", "function_name", F.col("_h.call_id").alias("call_id"), F.col("_h.duration_ms").alias("current_ms"),
        F.col("_h._base").cast("double").alias("baseline_ms"), F.bround(ratio, 2).alias("ratio"), F.when(ratio >= CRITICAL, "critical").otherwise("warning").alias("severity"),
    )


def session_fleet(sessions: DataFrame) -> DataFrame:
    """Apps compared by mean session time: rank, mid-rank percentile and the fleet's interpolated percentiles."""
    done = sessions.filter("status = 'completed' and total_duration_ms > 0 and app_name is not null")
    apps = done.groupBy("app_name").agg(F.avg("total_duration_ms").alias("avg_ms"), F.count(F.lit(1)).alias("sessions"), F.avg("total_calls").alias("avg_calls"))
    # Equal means are counted first and ranked in chunks, so there may be any number of apps.
    values = apps.groupBy("avg_ms").agg(F.count(F.lit(1)).alias("_tied")).withColumn("_all", F.lit(0)).withColumn("_c", F.floor(F.log2("avg_ms") * 64))
    placed = with_running(values, ["_all"], "_c", ["avg_ms"], F.col("_tied"), "_upto").select("avg_ms", "_tied", "_upto")
    quantile = ", ".join(f"bround(percentile(avg_ms, {q / 100}, _tied), 1) as fleet_p{q}_ms" for q in (50, 90))
    return apps.sparkSession.sql(
        f"""select app_name, cast(_upto - _tied + 1 as int) as rank_no, sessions, bround(avg_ms, 1) as avg_ms, bround(avg_calls, 1) as avg_calls,
        bround((_upto - _tied + 0.5 * _tied) / (select sum(_tied) from {{placed}}) * 100, 0) as percentile,
        (select fleet_p50_ms from {{whole}}) as fleet_p50_ms, (select fleet_p90_ms from {{whole}}) as fleet_p90_ms from {{met}}""",
        met=apps.join(placed, "avg_ms"), placed=placed, whole=apps.sparkSession.sql(f"select {quantile} from {{placed}}", placed=placed),
    )


def pipeline_fleet(runs: DataFrame) -> DataFrame:
    """Repositories compared by mean run time: competition rank and the share at most as slow (null with one repository).

    Equal means are counted first; running counts over chunks of the means give rank and
    share, so there may be any number of repositories.
    """
    repos = runs.filter("total_duration_ms is not null and total_duration_ms > 0").groupBy("repository_id").agg(F.avg("total_duration_ms").alias("_avg"), F.count(F.lit(1)).alias("runs"))
    values = repos.groupBy("_avg").agg(F.count(F.lit(1)).alias("_n")).withColumn("_all", F.lit(0)).withColumn("_c", F.floor(F.log2("_avg") * 64))
    placed = with_running(values, ["_all"], "_c", ["_avg"], F.col("_n"), "_upto").select("_avg", "_n", "_upto")
    met = repos.join(placed, "_avg")
    return repos.sparkSession.sql(
        """select repository_id, runs, bround(_avg, 1) as avg_ms, cast(_upto - _n + 1 as int) as rank_no,
        case when (select sum(_n) from {values}) >= 2 then bround(_upto / (select sum(_n) from {values}) * 100, 1) end as percentile from {met}""",
        met=met,
        values=values.select("_n"),
    )


def function_totals(calls: DataFrame, top_calls: int = 50, top: int = 10) -> DataFrame:
    """Per session the functions among its slowest calls: count, total, longest, mean (whole ms) and share."""
    slowest = Window.partitionBy("session_id").orderBy(F.desc("duration_ms"), "id")
    kept = calls.select("session_id", "id", "function_name", "duration_ms").filter("duration_ms is not null and session_id is not null")
    kept = kept.withColumn("_r", F.row_number().over(slowest)).filter(F.col("_r") <= top_calls)
    g = kept.groupBy("session_id", "function_name").agg(F.count(F.lit(1)).alias("calls"), F.sum("duration_ms").alias("total_ms"), F.max("duration_ms").alias("max_ms"))
    g = g.withColumn("avg_ms", F.expr("total_ms div calls"))
    all_ms = F.sum("total_ms").over(Window.partitionBy("session_id"))
    g = g.withColumn("pct", F.when(all_ms > 0, F.bround(F.col("total_ms") / all_ms * 100, 1)).otherwise(0.0))
    best = Window.partitionBy("session_id").orderBy(F.desc("total_ms"), "function_name")
    return g.withColumn("rank_no", F.row_number().over(best)).filter(F.col("rank_no") <= top)


def line_model(rows: DataFrame, x: str, y: str, k: float = 3.0) -> DataFrame:
    """Least-squares line of ``y`` on ``x`` and the rows more than ``k`` population deviations off: adds ``expected, residual, is_anomaly``."""
    kept = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    # Constant x has no slope: the line is then the mean.
    fit = kept.agg(F.coalesce(F.regr_slope(y, x), F.lit(0.0)).alias("_b"), F.avg(y).alias("_my"), F.avg(x).alias("_mx"), F.var_pop(y).alias("_vy"), F.var_pop(x).alias("_vx"))
    fit = fit.withColumn("_a", F.col("_my") - F.col("_b") * F.col("_mx"))
    # Residual variance from the moments, so the table is read once for the line and once for the answer.
    fit = fit.withColumn("_s", F.sqrt(F.greatest(F.col("_vy") - F.col("_b") * F.col("_b") * F.col("_vx"), F.lit(0.0))))
    out = rows.sparkSession.sql(
        f"""select k.*, (select _a from {{fit}}) + (select _b from {{fit}}) * `{x}` as expected, `{y}` - ((select _a from {{fit}}) + (select _b from {{fit}}) * `{x}`) as residual,
        abs(`{y}` - ((select _a from {{fit}}) + (select _b from {{fit}}) * `{x}`)) > {k} * (select _s from {{fit}}) as is_anomaly from {{kept}} k""",
        kept=kept,
        fit=fit,
    )
    return out
