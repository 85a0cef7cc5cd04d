"""Queries of the general problems over the receiver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import day_number, day_text, micros, stamp_seconds
from ..operators.anomalies import judged
from ..operators.arrivals import once
from ..operators.changes import apply_changes, current_samples, element_changes
from ..operators.grid import regular_grid
from ..operators.intervals import gaps, periods
from ..operators.late import Lateness, diverted, period_outcomes, period_sums
from ..operators.rolling import trailing_totals
from ..operators.stamps import normalised
from ..sources.tables import filter_in, table, types_of_shape


def _samples(spark: SparkSession, sf_dir: str, *shapes: str) -> DataFrame:
    return filter_in(table(spark, sf_dir, "samples"), "sample_type", types_of_shape(spark, sf_dir, *shapes))


def p1_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and averages over 7 and 30 days for each source, accumulated type and local day."""
    rows = _samples(spark, sf_dir, "accumulated").select(
        "uuid", "source", "sample_type", F.substring("start_time", 1, 10).try_cast("date").alias("local_day"), "value_num"
    )
    rows = once(rows, "uuid", rows.columns)
    return trailing_totals(rows, ["source", "sample_type"], "local_day", "value_num", (7, 30), 20)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on which the week's daily average is under half that of the 30 days."""
    low = p1_totals(spark, sf_dir).where(60 * F.col("t7") < 7 * F.col("t30"))
    return low.select("source", "sample_type", F.col("local_day").cast("string").alias("local_day"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples that exist after all changes, with the place of their last change."""
    state = apply_changes(element_changes(table(spark, sf_dir, "batch_elements")))
    return state.select(F.col("key").alias("uuid"), "batch_seq", "pos")


def p2_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples that exist after all changes, in their last version."""
    return current_samples(table(spark, sf_dir, "batch_elements"))


def _sleep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "samples").where("sample_type = 'sleepAnalysis'")
    return rows.select("source", stamp_seconds("start_time").alias("start_s"), stamp_seconds("end_time").alias("end_s"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps under 12 hours between successive sleep periods of a source."""
    found = gaps(_sleep(spark, sf_dir), "source", "start_s", "end_s").where("gap_end - gap_start < 43200")
    return found.select("source", F.col("gap_start").alias("gap_start_s"), F.col("gap_end").alias("gap_end_s"))


def p3_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuous sleep periods of each source."""
    found = periods(_sleep(spark, sf_dir), "source", "start_s", "end_s")
    return found.select("source", F.col("period_start").alias("period_start_s"), F.col("period_end").alias("period_end_s"))


#: Seconds of the beginnings of 2020 and 2027: all instants of the records lie between them.
BETWEEN = (1_577_836_800, 1_798_761_600)


def p4_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both stamps of every import record as instants, with the status of each."""
    return normalised(table(spark, sf_dir, "import_records"), numbers=BETWEEN)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import records of which both stamps denote exactly one instant."""
    return p4_instants(spark, sf_dir).where("start_us is not null and end_us is not null").select("import_id", "start_us", "end_us")


#: A day of a source is published and closed by that source alone.
DAYS = Lateness(keys=("source", "sample_type"), source="source")


def _arrived(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _samples(spark, sf_dir, "sampled", "daily", "accumulated")
    rows = rows.select(
        "uuid", "source", "sample_type", stamp_seconds("start_time").alias("at_s"), "value_num", micros(rows, "received_at").alias("arrived_us")
    )
    return once(rows, "uuid", ["source", "sample_type", "at_s", "value_num"], "arrived_us")


def p5_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregates per source, type and UTC day as published, corrected and closed."""
    return period_outcomes(_arrived(spark, sf_dir), DAYS, "at_s", "arrived_us", "value_num")


def p5_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcomes with sums to six places, which don't depend on the order of adding."""
    sums = [F.round(c, 6).alias(c) for c in ("sum_published", "sum_closed")]
    return p5_outcomes(spark, sf_dir).select("source", "sample_type", "period_start", "n_published", "n_closed", "n_corrected", "n_dropped", *sums, "published_us", "closed_us")


def p5_diverted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples that came after the closing of their day."""
    return diverted(_arrived(spark, sf_dir), DAYS, "at_s", "arrived_us", "value_num", ("uuid",)).select("uuid", "source", "sample_type", "period_start", "arrived_us")


def p5_joint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of a type that close when every source of the type has passed: corrected and dropped samples of each."""
    joint = Lateness(keys=("sample_type",), source="source", scope=("sample_type",))
    return period_outcomes(_arrived(spark, sf_dir), joint, "at_s", "arrived_us", "value_num").select("sample_type", "period_start", "n_closed", "n_dropped", "closed_us")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that late samples corrected, and days that dropped samples; a day can be both."""
    kinds = F.array_compact(
        F.array(F.when(F.col("n_corrected") > 0, F.lit("corrected")), F.when(F.col("n_dropped") > 0, F.lit("dropped")))
    )
    day = day_text(day_number(F.col("period_start"))).alias("event_day")
    sums = period_sums(_arrived(spark, sf_dir), DAYS, "at_s", "arrived_us", "value_num")
    return sums.select("source", "sample_type", day, F.explode(kinds).alias("outcome"))


#: What no living body or real room gives, as (lowest, highest) that is still possible, by type and unit.
POSSIBLE = {
    "heartRate": (10.0, 300.0),
    "respiratoryRate": (0.5, 100.0),
    "oxygenSaturation": (40.0, 100.0),
    "heartRateVariabilitySDNN": (0.1, 600.0),
    "environmentalAudioExposure": (0.0, 194.0),
    "bodyMass": (1.0, 650.0),
}


def _judged(spark: SparkSession, sf_dir: str, screened: bool) -> DataFrame:
    rows = _samples(spark, sf_dir, "sampled", "daily")
    rows = rows.select("uuid", "source", "sample_type", stamp_seconds("start_time").alias("at_s"), "value_num").where("value_num is not null")
    return judged(rows, "uuid", "source", "sample_type", "at_s", "value_num", POSSIBLE, screened=screened)


def p6_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reading of sampled and daily types with its flags and verdict."""
    return _judged(spark, sf_dir, False)


def p6_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many readings of each type each flag and each verdict has."""
    flags = [F.count_if(c).alias(f"n_{c}") for c in ("beyond_limit", "outside_fence", "steep", "flat")]
    return p6_verdicts(spark, sf_dir).groupBy("sample_type", "verdict").agg(F.count(F.lit(1)).alias("n"), *flags)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings that are not credible."""
    return _judged(spark, sf_dir, True).where("verdict <> 'credible'").select("uuid")


def p6_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of each type, and those beyond the limits of the type."""
    return p6_flags(spark, sf_dir).groupBy("sample_type").agg(F.sum("n").alias("n"), F.sum("n_beyond_limit").alias("n_beyond_limit"))


def p6_stuck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of ten or more successive equal values."""
    return p6_verdicts(spark, sf_dir).where("flat").select("uuid")


def p7_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly series with means to six places, which don't depend on the order of adding."""
    rounded = [F.round(c, 6).alias(c) for c in ("mean", "filled")]
    return p7_grid(spark, sf_dir).select("source", "sample_type", "step_start", "n", *rounded, "state")


def p7_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly series of each source and sampled type, missing hours marked."""
    rows = _samples(spark, sf_dir, "sampled").select("uuid", "source", "sample_type", stamp_seconds("start_time").alias("at_s"), "value_num")
    rows = once(rows.where("value_num is not null"), "uuid", rows.columns)
    return regular_grid(rows, ["source", "sample_type"], "at_s", "value_num")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing hours in runs of fewer than 48 between two hours with readings."""
    return p7_grid(spark, sf_dir).where("n = 0").select("source", "sample_type", F.col("step_start").alias("hour_start_s"))


QUERIES = {
    "p1_found": p1_found, "p1_totals": p1_totals, "p2_found": p2_found, "p2_state": p2_state, "p3_found": p3_found,
    "p3_periods": p3_periods, "p4_found": p4_found, "p4_instants": p4_instants, "p5_found": p5_found,
    "p5_outcomes": p5_outcomes, "p5_totals": p5_totals, "p5_diverted": p5_diverted, "p5_joint": p5_joint, "p6_found": p6_found, "p6_verdicts": p6_verdicts, "p6_flags": p6_flags, "p6_limits": p6_limits, "p6_stuck": p6_stuck, "p7_found": p7_found, "p7_grid": p7_grid, "p7_steps": p7_steps,
}
