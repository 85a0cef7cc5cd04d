"""Aggregates by event time that late records correct until a period is closed by the watermarks of its sources."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged

US = 1_000_000
TOTALS = ("n_published", "sum_published", "n_closed", "sum_closed", "n_corrected", "n_dropped")


@dataclass(frozen=True)
class Lateness:
    """When periods are published and closed.

    ``keys`` name the columns of the aggregates; ``source`` the one whose low watermark counts; ``scope`` those of the keys
    whose sources must all have passed a bound, by default the source alone. A source that has been silent for ``idle_s``
    isn't waited for.
    """

    keys: tuple[str, ...]
    source: str
    scope: tuple[str, ...] | None = None
    period_s: int = 86400
    publish_s: int = 2 * 3600
    close_s: int = 72 * 3600
    idle_s: int = 6 * 3600

    @property
    def within(self) -> tuple[str, ...]:
        return (self.source,) if self.scope is None else self.scope

    def bound(self, after_s: int) -> Column:
        """Microseconds at which a period may be published or closed."""
        return (F.col("_period") + 1) * F.lit(self.period_s * US) + F.lit(after_s * US)


def placed(df: DataFrame, rule: Lateness, at: str, arrived: str, value: str, kept: tuple[str, ...] = ()) -> DataFrame:
    """The rows with an event time: the keys, ``_period``, ``_arrived``, ``_latest`` (the same), ``_value``, ``_n`` (1) and ``kept``."""
    number = F.when(F.isnan(F.col(value).cast("double")), None).otherwise(F.col(value).cast("double"))
    names = [F.col(c) for c in dict.fromkeys((*rule.keys, rule.source, *rule.within, *kept))]
    period = F.floor(F.col(at) / F.lit(rule.period_s)).alias("_period")
    came = F.col(arrived).cast("bigint")
    return df.where(F.col(at).isNotNull()).select(*names, period, came.alias("_arrived"), came.alias("_latest"), number.alias("_value"), F.lit(1).cast("bigint").alias("_n"))


def _passed(rule: Lateness, after: Column) -> Column:
    """The period whose bound an arrival passed last; a bound itself isn't passed."""
    span, since = F.lit(rule.period_s * US), F.col("_arrived") - after * F.lit(US)
    return ((since + F.pmod(-since, span)) / span).cast("bigint") - 2


def condensed(rows: DataFrame, rule: Lateness) -> DataFrame:
    """Rows of ``placed`` added up as far as no judgement can tell them apart: ``_n``, ``_value``, first and latest arrival.

    If a period waits for its own source alone, every late row arrived at or after the punctuation, so rows of the same
    keys and period between the same two bounds are judged alike. The sums are bounded by the calendar and are written, as
    several steps read them. Where other sources are waited for, rows stay as they are.
    """
    if rule.within != (rule.source,):
        return rows
    names = list(dict.fromkeys((*rule.keys, rule.source)))
    cells = [_passed(rule, F.lit(s).cast("bigint")).alias(n) for s, n in ((rule.publish_s, "_p"), (rule.close_s, "_c"))]
    sums = rows.withColumns({"_p": cells[0], "_c": cells[1]}).groupBy(*names, "_period", "_p", "_c")
    return staged(sums.agg(F.min("_arrived").alias("_arrived"), F.max("_latest").alias("_latest"), F.sum("_value").alias("_value"), F.sum("_n").alias("_n")).drop("_p", "_c"))


def marked(rows: DataFrame, rule: Lateness) -> DataFrame:
    """The watermarks of sources as far as they decide anything: source, ``_after`` (publish_s or close_s), ``_passed``,
    ``_first`` and ``_last``.

    Between two successive bounds only a source's first and last arrival matter; ``_passed`` is the period whose bound was
    passed last. It is added up before the shuffle and bounded by the calendar.
    """
    afters = F.array(F.lit(rule.publish_s).cast("bigint"), F.lit(rule.close_s).cast("bigint"))
    arrivals = rows.where("_arrived is not null").select(rule.source, "_arrived", "_latest", F.explode(F.array_distinct(afters)).alias("_after"))
    cells = arrivals.select(rule.source, "_after", _passed(rule, F.col("_after")).alias("_passed"), "_arrived", "_latest")
    return cells.groupBy(rule.source, "_after", "_passed").agg(F.min("_arrived").alias("_first"), F.max("_latest").alias("_last"))


def merged(a: DataFrame, b: DataFrame, rule: Lateness) -> DataFrame:
    """Watermarks of earlier and later arrivals as those of all."""
    return a.unionByName(b).groupBy(rule.source, "_after", "_passed").agg(F.min("_first").alias("_first"), F.max("_last").alias("_last"))


def punctuated(marks: DataFrame, wanted: DataFrame, rule: Lateness) -> DataFrame:
    """When periods are published and closed: the scope, ``_period``, ``published_us`` and ``closed_us``.

    ``wanted`` holds scope, source and ``_period``. A source passes a bound with its first arrival after it or, if it falls
    silent, when it has been idle for ``idle_s`` since its last arrival before; one that was never heard before the bound
    isn't waited for. A period is closed when the last of its sources passes.
    """
    scope = [c for c in rule.within if c != rule.source]
    afters = F.array_distinct(F.array(F.lit(rule.publish_s).cast("bigint"), F.lit(rule.close_s).cast("bigint")))
    asked = wanted.select(*scope, rule.source, "_period", F.explode(afters).alias("_after"), F.lit(True).alias("_asked"))
    none = F.lit(None).cast("bigint")
    known = marks.select(rule.source, F.col("_passed").alias("_period"), "_after", "_first", "_last", F.lit(False).alias("_asked"))
    both = asked.select("*", none.alias("_first"), none.alias("_last")).unionByName(known, allowMissingColumns=True)
    of_source = Window.partitionBy(rule.source, "_after")
    after = F.min("_first").over(of_source.orderBy(F.desc("_period")).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    before = F.max("_last").over(of_source.orderBy("_period").rangeBetween(Window.unboundedPreceding, -1))
    seen = both.select(*scope, rule.source, "_period", "_after", "_asked", after.alias("_next"), before.alias("_before")).where("_asked")
    bound = (F.col("_period") + 1) * F.lit(rule.period_s * US) + F.col("_after") * F.lit(US)
    idle = F.greatest(bound, F.coalesce(F.col("_before") + F.lit(rule.idle_s * US), bound))
    passes = F.least(F.coalesce("_next", idle), idle)
    group = list(dict.fromkeys((*rule.within, "_period")))
    return seen.groupBy(*group).agg(
        F.max(F.when(F.col("_after") == rule.publish_s, passes)).alias("published_us"),
        F.max(F.when(F.col("_after") == rule.close_s, passes)).alias("closed_us"),
    )


def of_scopes(rows: DataFrame, rule: Lateness) -> tuple[DataFrame, DataFrame]:
    """The periods and the sources of each scope."""
    return rows.select(*rule.within, "_period").distinct(), rows.select(*dict.fromkeys((*rule.within, rule.source))).distinct()


def asked_for(periods: DataFrame, members: DataFrame, rule: Lateness) -> DataFrame:
    """Every source of each scope with every period of the scope."""
    if rule.source in rule.within:
        return periods
    names = {c: f"_w{i}" for i, c in enumerate(rule.within)}
    right = members.select(F.lit(0).alias("_one"), *[F.col(c).alias(n) for c, n in names.items()], rule.source)
    on = [F.col("_any") == F.col("_one"), *[F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]]
    return periods.withColumn("_any", F.lit(0)).join(right, on).select(*rule.within, rule.source, "_period")


def after_publication(rows: DataFrame, rule: Lateness) -> DataFrame:
    """Rows that arrived after the bound of their period's publication; only these can correct or be dropped."""
    return rows.where(F.col("_arrived") > rule.bound(rule.publish_s))


def judged(late: DataFrame, times: DataFrame, rule: Lateness) -> DataFrame:
    """Rows of ``after_publication`` with ``_corrects`` and ``_dropped``."""
    group = list(rule.within)
    names = {c: f"_j{i}" for i, c in enumerate([*group, "_period"])}
    right = times.select(*[F.col(c).alias(n) for c, n in names.items()], "published_us", "closed_us")
    met = late.join(right, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()], "left")
    dropped = (F.col("_arrived") > rule.bound(rule.close_s)) & (F.col("_arrived") >= F.col("closed_us"))
    return met.withColumns({"_dropped": dropped, "_corrects": ~dropped & (F.col("_arrived") >= F.col("published_us"))}).drop(*names.values())


def summed(rows: DataFrame, late: DataFrame, rule: Lateness) -> DataFrame:
    """Counts and sums per keys and period; each row is added up before it is shuffled."""
    early = rows.where(F.coalesce(F.col("_arrived") <= rule.bound(rule.publish_s), F.lit(True)))
    no = F.lit(False)
    names = [*rule.keys, "_period", "_value", "_n"]
    flat = early.select(*names, no.alias("_corrects"), no.alias("_dropped")).unionByName(late.select(*names, "_corrects", "_dropped"))
    first, kept = ~F.col("_corrects") & ~F.col("_dropped"), ~F.col("_dropped")

    def counted(which: Column) -> Column:
        return F.sum(F.when(which, F.col("_n")).otherwise(0))

    return flat.groupBy(*rule.keys, "_period").agg(
        counted(first).alias("n_published"),
        F.sum(F.when(first, F.col("_value"))).alias("sum_published"),
        counted(kept).alias("n_closed"),
        F.sum(F.when(kept, F.col("_value"))).alias("sum_closed"),
        counted(F.col("_corrects")).alias("n_corrected"),
        counted(F.col("_dropped")).alias("n_dropped"),
    )


def finished(sums: DataFrame, times: DataFrame, rule: Lateness) -> DataFrame:
    """Sums with the moments of publication and closing."""
    names = {c: f"_f{i}" for i, c in enumerate([*rule.within, "_period"])}
    right = times.select(*[F.col(c).alias(n) for c, n in names.items()], "published_us", "closed_us")
    full = sums.join(right, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()], "left")
    start = (F.col("_period") * F.lit(rule.period_s)).alias("period_start")
    return full.select(*rule.keys, start, *TOTALS, "published_us", "closed_us")


def late_rows(rows: DataFrame, rule: Lateness) -> DataFrame:
    """Late rows judged; punctuations are worked out only for periods that have late rows."""
    late = after_publication(rows, rule)
    asked = asked_for(of_scopes(late, rule)[0], of_scopes(rows, rule)[1], rule)
    return judged(late, punctuated(marked(rows, rule), asked, rule), rule)


def period_sums(df: DataFrame, rule: Lateness, at: str, arrived: str, value: str) -> DataFrame:
    """``period_outcomes`` without the moments of publication and closing, which need every period's punctuations."""
    rows = condensed(placed(df, rule, at, arrived, value), rule)
    start = (F.col("_period") * F.lit(rule.period_s)).alias("period_start")
    return summed(rows, late_rows(rows, rule), rule).select(*rule.keys, start, *TOTALS)


def period_outcomes(df: DataFrame, rule: Lateness, at: str, arrived: str, value: str) -> DataFrame:
    """Aggregates of each period as published, as corrected and as closed, and what came too late.

    ``at`` is the event time in integer seconds, ``arrived`` the arrival in microseconds on the receiver's clock; ``df``
    holds each record once. Columns: the keys, ``period_start`` (seconds), ``n_published`` and ``sum_published`` (before
    the publication), ``n_closed`` and ``sum_closed`` (before the closing), ``n_corrected`` (between the two),
    ``n_dropped`` (after the closing, diverted from the aggregates; see ``diverted``), ``published_us`` and ``closed_us``.

    Method: every source has a low watermark, its latest arrival on the receiver's clock. A period of a scope is published
    (closed) by a punctuation when every source of the scope has passed the bound, ``publish_s`` (``close_s``) after the
    period's end: with an arrival after the bound, or by timeout after ``idle_s`` of silence. The arrival that passes the
    bound is already late itself. Arrivals before a bound are never late, so only the others are compared with the
    punctuations. ``streaming.late`` keeps the same watermarks and uses the same functions batch by batch.

    Exactly at a bound is in time. A null arrival counts as in time; rows without event time are left out; a null key is a
    key of its own; null and NaN values count as records but not in sums. Sources of a scope with a third of all rows are
    added up before the shuffle; watermarks are bounded by the calendar. Empty tables give none; other columns are ignored.
    """
    rows = condensed(placed(df, rule, at, arrived, value), rule)
    times = punctuated(marked(rows, rule), asked_for(*of_scopes(rows, rule), rule), rule)
    return finished(summed(rows, judged(after_publication(rows, rule), times, rule), rule), times, rule)


def diverted(df: DataFrame, rule: Lateness, at: str, arrived: str, value: str, kept: tuple[str, ...] = ()) -> DataFrame:
    """The records that came after their period's closing: the keys, ``kept``, ``period_start``, arrival, value, ``closed_us``."""
    rows = placed(df, rule, at, arrived, value, kept)
    late = after_publication(rows, rule)
    asked = asked_for(of_scopes(late, rule)[0], of_scopes(rows, rule)[1], rule)
    late = judged(late, punctuated(marked(rows, rule), asked, rule), rule).where("_dropped")
    start = (F.col("_period") * F.lit(rule.period_s)).alias("period_start")
    names = list(dict.fromkeys((*rule.keys, *kept)))
    return late.select(*names, start, F.col("_arrived").alias(arrived), F.col("_value").alias(value), "closed_us")
