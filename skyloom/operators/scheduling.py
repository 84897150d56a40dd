"""The observing scheduler over status reports: frames accounted to targets, and the step that each report calls for.

A report is a row with the scope, its target, the job's id and its counters of
captured and failed frames, and the share of the target's failed frames that
triage finds usable.  Counters start over with each job.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: A share of usable ones from which failed frames are no reason to leave.
RESCUED = 0.5
ACCOUNT = ("fresh_failed", "accepted", "credit", "streak")


def account(reports: DataFrame, scope: str, order: Sequence[str]) -> DataFrame:
    """Each report with its new frames (``fresh_failed, accepted, credit``) and the failed ones in a row (``streak``).

    A new job counts from zero; a new target on the same job counts from where the
    job stands, as its frames are the old target's.  Windows over one partitioning.
    """
    w = Window.partitionBy(scope).orderBy(*order)
    was = lambda c: F.lag(c).over(w)
    r = reports.select("*", was("target").alias("_t"), was("captured").alias("_c"), was("failed").alias("_f"), was("job").alias("_j"), F.row_number().over(w).alias("_n"))
    began = (F.col("captured") < F.coalesce("_c", F.lit(0))) | F.coalesce(F.col("job") != F.col("_j"), F.lit(False))
    switched = F.col("_t").isNotNull() & ~F.col("_t").eqNullSafe(F.col("target"))
    since = lambda now, last: F.when(began, 0).when(switched, F.col(now)).otherwise(F.coalesce(last, F.lit(0)))
    r = r.withColumn("fresh_failed", F.col("failed") - since("failed", "_f")).withColumn("accepted", F.col("captured") - since("captured", "_c") - F.col("fresh_failed"))
    rescued = F.bround(F.col("fresh_failed") * F.col("share")).cast("long")
    r = r.withColumn("credit", F.greatest(F.lit(0), F.col("accepted") + rescued))
    r = r.withColumn("_over", (F.col("accepted") > 0) | ((F.col("fresh_failed") > 0) & (F.col("share") >= RESCUED))).withColumn("_cut", switched)
    run = F.sum((F.col("_cut") | F.coalesce(F.lag("_over").over(w), F.lit(False))).cast("int")).over(w)
    inner = Window.partitionBy(scope, "_run").orderBy("_n")
    r = r.withColumn("_run", run).withColumn("streak", F.when(F.col("_over"), 0).otherwise(F.sum("fresh_failed").over(inner)))
    return r.select(*reports.columns, *(F.col(c).cast("long").alias(c) for c in ACCOUNT))


def decide(reports: DataFrame, fail_streak: int = 10) -> DataFrame:
    """Accounted reports with the ``step`` they call for.

    Columns ``in_window, busy, job_failed, capturing, usable, done`` say how things
    stand; the first rule that fits decides, as a tick of the scheduler does.
    """
    bad = (F.col("streak") >= fail_streak) | F.col("done") | ~F.col("usable")
    step = (
        F.when(F.col("busy"), "wait").when(~F.col("in_window"), F.when(F.col("capturing"), "stop").otherwise("park")).when(F.col("job_failed"), "stop")
        .when(F.col("capturing"), F.when(bad, "leave").otherwise("capture")).otherwise("pick")
    )
    return reports.withColumn("step", step)


def account_stream(reports: DataFrame, scope: str, order: Sequence[str], kind: str) -> DataFrame:
    """:func:`account` over a stream: a scope's state is its last report and its streak.

    ``kind`` is the schema of ``reports``.
    """

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        target, job, captured, failed, streak = state.get if state.exists else (None, None, 0, 0, 0)
        rows = pd.concat(list(pdfs)).sort_values(list(order))
        out = []
        for r in rows.itertuples(index=False):
            other = target is not None and r.target != target
            began = r.captured < captured or (job is not None and r.job != job)
            base = (0, 0) if began else (r.captured, r.failed) if other else (captured, failed)
            lost = r.failed - base[1]
            won = r.captured - base[0] - lost
            streak = 0 if won > 0 or (lost > 0 and r.share >= RESCUED) else (0 if other else streak) + lost
            out.append((lost, won, max(0, won + round(lost * r.share)), streak))
            target, job, captured, failed = r.target, r.job, r.captured, r.failed
        state.update((target, int(job), int(captured), int(failed), int(streak)))
        yield rows.reset_index(drop=True).join(pd.DataFrame(out, columns=list(ACCOUNT)))

    out = kind + "".join(f", {c} long" for c in ACCOUNT)
    return reports.groupBy(scope).applyInPandasWithState(run, out, "target string, job long, captured long, failed long, streak long", "append", GroupStateTimeout.NoTimeout)
