"""Dates and patient timelines. Per-patient choices are aggregates, so a patient of any size is merged map-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carnet import constants as K


def swap_day_month(c: Column) -> Column:
    """Day and month exchanged when that is a date (time of day dropped), else unchanged."""
    swapped = F.make_date(F.year(c), F.dayofmonth(c), F.month(c)).cast("timestamp_ntz")
    return F.when(F.dayofmonth(c) <= 12, swapped).otherwise(c)


def same_or_swapped(a: Column, b: Column) -> Column:
    return (F.to_date(a) == F.to_date(b)) | (F.to_date(a) == F.to_date(swap_day_month(b)))


def has_time(c: Column) -> Column:
    return (F.hour(c) != 0) & (F.minute(c) != 0) & (F.second(c) != 0)


def correct_dates(cells: DataFrame, row: str, ordinal: str, ts: str) -> DataFrame:
    """Within a row, dates without a time of day that equal the row's first date (as is or swapped) take its value."""
    first = cells.where(F.col(ts).isNotNull()).groupBy(row).agg(F.min(F.struct(ordinal, ts)).alias("__f"))
    joined = cells.join(first, row, "left")
    later = F.col(ordinal) > F.col(f"__f.{ordinal}")
    aligned = later & ~has_time(F.col(ts)) & same_or_swapped(F.col(f"__f.{ts}"), F.col(ts))
    return joined.withColumn(ts, F.when(aligned, F.col(f"__f.{ts}")).otherwise(F.col(ts))).drop("__f")


def row_dates(cells: DataFrame, row: str, ordinal: str, ts: str, nature: str) -> DataFrame:
    """First date of each row with the section it was found in."""
    first = cells.where(F.col(ts).isNotNull()).groupBy(row).agg(F.min(F.struct(ordinal, ts, nature)).alias("f"))
    return first.select(row, F.to_date(f"f.{ts}").alias("note_date"), F.col(f"f.{nature}").alias("nature"))


DATE_TEXT = r"^\d\d[/.]\d\d[-/.]\d\d\d\d \d\d:\d\d:\d\d"


def build_notes(cells: DataFrame, row: str, patient: str, ordinal: str, ts: str, nature: str, value: str) -> DataFrame:
    """One note per source row: its text cells joined by ', ' in column order, dated by the row's first date.
    Rows without a date or without text give no note. A group is one source row, bounded by the sheet's width."""
    usable = F.when((F.col(value) != F.col(patient)) & ~F.col(value).rlike(DATE_TEXT), F.struct(ordinal, value))
    text = F.transform(F.array_sort(F.collect_list(usable)), lambda s: s[value])
    dated = F.when(F.col(ts).isNotNull(), F.struct(ordinal, ts, nature))
    rows = cells.groupBy(row, patient).agg(F.min(dated).alias("d"), text.alias("parts"))
    kept = rows.where(F.col("d").isNotNull() & (F.size("parts") > 0))
    return kept.select(row, patient, F.to_date(f"d.{ts}").alias("note_date"), F.col(f"d.{nature}").alias("nature"), F.array_join("parts", ", ").alias("text"))


def days_between(a: Column, b: Column) -> Column:
    return F.datediff(F.to_date(a), F.to_date(b))


def closest_dates(events: DataFrame, patient: str, ts: str, anchors: DataFrame, anchor: str, mode: str = "nearest") -> DataFrame:
    """Date of each patient nearest to the anchor date (ties: the earlier one); ``mode='earliest'`` gives the first date."""
    joined = events.join(anchors.select(patient, anchor), patient)
    gap = F.abs(days_between(F.col(ts), F.col(anchor)))
    key = F.struct(gap.alias("gap"), F.to_date(ts).alias("d")) if mode == "nearest" else F.struct(F.lit(0).alias("gap"), F.to_date(ts).alias("d"))
    return joined.groupBy(patient).agg(F.min(key).alias("k")).select(patient, F.col("k.d").alias("closest"))


def first_events(events: DataFrame, patient: str, ts: str) -> DataFrame:
    return events.groupBy(patient).agg(F.min(ts).alias("first_event"))


def truncate_timeline(notes: DataFrame, patient: str, ts: str, note_id: str, anchors: DataFrame, anchor: str) -> DataFrame:
    """Notes of a patient up to the note nearest to the patient's anchor date; patients without an anchor keep all."""
    gap = F.abs(days_between(F.col(ts), F.col(anchor)))
    near = notes.join(anchors.select(patient, anchor), patient).groupBy(patient).agg(
        F.min(F.struct(gap.alias("gap"), F.to_date(ts).alias("day"), F.col(ts).alias("at"), F.col(note_id).alias("id"))).alias("__n"))
    joined = notes.join(near, patient, "left")
    keep = F.col("__n").isNull() | (F.col(ts) < F.col("__n.at")) | ((F.col(ts) == F.col("__n.at")) & (F.col(note_id) <= F.col("__n.id")))
    return joined.where(keep).drop("__n")


def leaks(c: Column, vocabulary: tuple[str, ...] = K.LEAK_VOCABULARY) -> Column:
    """Does the text name the outcome?"""
    low = F.lower(c)
    found = F.lit(False)
    for word in vocabulary:
        found = found | low.contains(word)
    return found


def drop_leaking_notes(notes: DataFrame, text: str, nature: str, planned: str = K.PLANNED_SURGERY, vocabulary: tuple[str, ...] = K.LEAK_VOCABULARY,
                       only_planned: bool = False) -> DataFrame:
    """Drop notes holding outcome words: those of the planned section first, then (unless ``only_planned``) all."""
    bad = leaks(F.col(text), vocabulary)
    return notes.where(~(bad & (F.col(nature) == planned))) if only_planned else notes.where(~bad)
