"""Equipment effectiveness from shifts, and machine health from sensor readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.policy import work_priority
from ..operators.aggregates import ratio_of_sums, robust_baseline
from ..operators.context import assemble_pages
from ..operators.filters import dimension
from ..operators.hotkeys import HOT_ROWS, Hot, attach, hot_keys
from ..operators.joins import nearest_mark
from ..operators.windows import islands, run_lengths, threads
from ..streaming.ordered import run_lengths_stream

ORDER = ["ts"]
MACHINE = ["machine_id"]
MAD_TO_SIGMA = 1.4826


def _dimensions() -> dict[str, Column]:
    return {"Line": F.col("line"), "Machine": F.col("machine_id"), "Day": F.to_date("shift_start")}


def _recent(shifts: DataFrame, machines: DataFrame, now: Column, days: int) -> DataFrame:
    rows = shifts.where(F.col("shift_start") >= now - F.expr(f"INTERVAL {int(days)} DAYS"))
    return rows.join(machines.select("machine_id", "line", "ideal_cycle_s"), "machine_id")


def oee(shifts: DataFrame, machines: DataFrame, by: str, now: Column, days: int = 30) -> DataFrame:
    """Availability, performance, quality and OEE by line, machine or day, from summed minutes and units."""
    ideal = F.col("ideal_cycle_s")
    run = F.col("planned_min") - F.col("downtime_min")
    good = (F.col("total_units") - F.col("scrap_units")) * ideal
    made = F.col("total_units") * ideal
    planned = F.col("planned_min")
    rows = _recent(shifts, machines, now, days)
    return rows.groupBy(dimension(by, _dimensions()).alias("dim")).agg(
        F.sum(planned).alias("planned_min"),
        F.sum("downtime_min").alias("downtime_min"),
        ratio_of_sums(run, planned).alias("availability_pct"),
        ratio_of_sums(made, run * 60).alias("performance_pct"),
        ratio_of_sums(good, made).alias("quality_pct"),
        ratio_of_sums(good, planned * 60).alias("oee_pct"),
    )


def oee_losses(shifts: DataFrame, machines: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Minutes of planned time by where they went; the five parts add up to it."""
    ideal_min = F.col("ideal_cycle_s") / 60
    down = F.col("downtime_min")
    broken = F.col("downtime_reason") == "Breakdown"
    return _recent(shifts, machines, now, days).agg(
        F.round(F.sum(F.when(broken, down).otherwise(0))).alias("breakdowns"),
        F.round(F.sum(F.when(~broken, down).otherwise(0))).alias("other_downtime"),
        F.round(F.sum(F.col("planned_min") - down - F.col("total_units") * ideal_min)).alias("slow_cycles"),
        F.round(F.sum(F.col("scrap_units") * ideal_min)).alias("scrap"),
        F.round(F.sum((F.col("total_units") - F.col("scrap_units")) * ideal_min)).alias("productive"),
    )


def loss_shares(losses: DataFrame, planned_min: Column) -> DataFrame:
    """Plant OEE and losses as percentages of planned time."""
    def pct(minutes: Column, name: str) -> Column:
        return F.round(F.lit(100) * F.try_divide(minutes, planned_min), 1).alias(name)

    return losses.select(
        pct(F.col("productive"), "oee_pct"),
        pct(F.col("breakdowns") + F.col("other_downtime"), "availability_loss_pct"),
        pct(F.col("slow_cycles"), "performance_loss_pct"),
        pct(F.col("scrap"), "quality_loss_pct"),
    )


def vibration_scored(
    readings: DataFrame, baseline_days: int = 14, alert_z: float = 4.0, alert_rows: int = 12, watch_z: float = 2.5,
    watch_rows: int = 6, hot: Hot = HOT_ROWS,
) -> DataFrame:
    """Readings with their machine's baseline, robust z-score, and alert and watch flags.

    The baseline covers the days after the first reading of the whole table. An alert needs
    `alert_rows` hot rows in a row; a constant baseline (zero deviation) gives no z and no alert.
    Machines without baseline rows are left out.
    """
    known = hot_keys(readings, MACHINE, hot)
    base = vibration_baseline(readings, baseline_days, known)
    scored = attach(readings, base, MACHINE, known).withColumn("z", _z()).drop("mad")
    flags = {"__hot": F.col("z") > alert_z, "__warm": F.col("z") > watch_z}
    counted = run_lengths(scored, MACHINE, ORDER, flags, known)
    return counted.withColumns(
        {"alert_hour": F.col("__hot") >= alert_rows, "watch_hour": F.col("__warm") >= watch_rows}
    ).drop("__hot", "__warm")


def vibration_baseline(readings: DataFrame, baseline_days: int = 14, hot: Hot = HOT_ROWS) -> DataFrame:
    """(machine_id, baseline, mad) over the days after the first reading of the whole table."""
    start = readings.agg(F.min("ts").alias("t0")).scalar()
    early = F.col("ts") < start + F.expr(f"INTERVAL {int(baseline_days)} DAYS")
    return robust_baseline(readings, MACHINE, "vibration_rms", early, hot)


def _z() -> Column:
    return F.try_divide(F.col("vibration_rms") - F.col("baseline"), F.lit(MAD_TO_SIGMA) * F.col("mad"))


def vibration_scored_stream(
    readings: DataFrame, baseline: DataFrame, lateness: str, alert_z: float = 4.0, alert_rows: int = 12, watch_z: float = 2.5, watch_rows: int = 6
) -> DataFrame:
    """Streaming form of `vibration_scored` against a finished `vibration_baseline`: every reading once, when it is final.

    Readings may come in any order within `lateness`. The state per machine is the waiting readings and two run lengths.
    """
    scored = readings.join(baseline, "machine_id", "left").withColumn("z", _z())
    scored = scored.where(F.col("baseline").isNotNull() | F.col("machine_id").isNull())
    flags = {"hot_rows": F.col("z") > alert_z, "warm_rows": F.col("z") > watch_z}
    counted = run_lengths_stream(scored, MACHINE, "ts", flags, ["vibration_rms", "temperature_c", "baseline", "z"], lateness)
    return counted.withColumns({"alert_hour": F.col("hot_rows") >= alert_rows, "watch_hour": F.col("warm_rows") >= watch_rows}).drop("hot_rows", "warm_rows")


def alert_episodes(scored: DataFrame, max_gap: str | None = None, hot: Hot = HOT_ROWS) -> DataFrame:
    """Runs of consecutive alert rows: started_at, last_seen_at, hours."""
    aggs = [F.min("ts").alias("started_at"), F.max("ts").alias("last_seen_at"), F.count(F.lit(1)).alias("hours")]
    return islands(scored, MACHINE, ORDER, F.col("alert_hour"), aggs, max_gap=max_gap, hot=hot)


def machine_status(scored: DataFrame, machines: DataFrame, hours: int = 24, hot: Hot = HOT_ROWS) -> DataFrame:
    """ALERT, WATCH or OK over each machine's own latest hours, with recent averages."""
    newest = scored.groupBy("machine_id").agg(F.max("ts").alias("last_ts"))
    recent = attach(scored, newest, MACHINE, hot_keys(scored, MACHINE, hot)).where(F.col("ts") > F.col("last_ts") - F.expr(f"INTERVAL {int(hours)} HOURS"))
    summary = recent.groupBy("machine_id").agg(
        F.when(F.bool_or("alert_hour"), "ALERT").when(F.bool_or("watch_hour"), "WATCH").otherwise("OK").alias("status"),
        F.round(F.try_divide(F.avg("vibration_rms"), F.max("baseline")), 2).alias("vibration_x_baseline"),
        F.round(F.avg("temperature_c"), 1).alias("temperature_c"),
        F.max("ts").alias("last_reading"),
    )
    names = machines.select("machine_id", "line", "machine_type")
    return names.join(summary, "machine_id")


def lead_times(episodes: DataFrame, maintenance: DataFrame, hot: Hot = HOT_ROWS) -> DataFrame:
    """Per episode the first corrective repair after its start, and the warning time in days."""
    fixes = maintenance.where(F.col("type") == "CORRECTIVE").select("machine_id", "ts")
    starts = episodes.withColumnRenamed("started_at", "ts")
    matched = nearest_mark(starts, fixes, MACHINE, "ts", "repaired_at", forward=True, strict=True, hot=hot)
    micros = F.unix_micros(F.col("repaired_at").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    return (
        matched.where(F.col("repaired_at").isNotNull())
        .withColumn("lead_days", F.round(micros / 86_400_000_000, 1))
        .withColumnRenamed("ts", "started_at")
    )


def work_order_context(
    status: DataFrame, episodes: DataFrame, maintenance: DataFrame, manuals: DataFrame, page_rows: int = 10_000, hot: Hot = HOT_ROWS
) -> DataFrame:
    """Text for a work-order draft per machine: status, alert history, maintenance, manual sections.

    A history beyond `page_rows` lines continues on further pages.
    """
    alerts = F.format_string("Sustained high vibration from %s for %d h", F.col("started_at").cast("string"), "hours")
    fixed = F.format_string("%s %s: %s", F.col("ts").cast("string"), "type", "note")
    manual = F.format_string("[%s] %s: %s", "section_id", "title", "content")
    head = F.format_string("## Machine %s (%s, line %s)", F.col("machine_id").cast("string"), "machine_type", "line")
    state = F.format_string(
        "Current status %s: vibration %sx its baseline over the last 24 h, temperature %s C.",
        "status", F.col("vibration_x_baseline").cast("string"), F.col("temperature_c").cast("string"),
    )
    # Manuals belong to machine types: the text is made once per type, then given to its machines.
    per_type = threads(manuals, ["machine_type"], ["section_id"], manual, "text", page_rows=page_rows, hot=hot if isinstance(hot, int) else HOT_ROWS)
    for_machine = status.select("machine_id", "machine_type").join(per_type, "machine_type").drop("machine_type")
    parts = [
        ("## Alert history", "none", threads(episodes, MACHINE, ["started_at"], alerts, "text", page_rows=page_rows, hot=hot)),
        ("## Maintenance history", "none", threads(maintenance, MACHINE, ["ts", "type", "note"], fixed, "text", page_rows=page_rows, hot=hot)),
        ("## Manual sections", "", for_machine),
    ]
    out = assemble_pages(status, [head, state], parts, MACHINE)
    return out.join(status.select("machine_id", work_priority(F.col("status")).alias("priority")), "machine_id")
