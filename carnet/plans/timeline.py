"""Date and timeline queries."""

from pyspark.sql import functions as F

from carnet.operators import timeline as L
from carnet.registry import query, table

SQL_SWAP = "CASE WHEN day({c}) <= 12 THEN make_timestamp(year({c}), day({c}), month({c}), 0, 0, 0) ELSE {c} END"


@query("date_swap", f"SELECT o_orderkey, {SQL_SWAP.format(c='o_orderdate')} AS swapped FROM orders")
def date_swap(spark, d):
    return table(spark, d, "orders").select("o_orderkey", L.swap_day_month(F.col("o_orderdate")).alias("swapped"))


@query("date_same_or_swapped", f"""
    SELECT l_orderkey, l_linenumber, l_partkey, o_orderdate::DATE = l_shipdate::DATE OR o_orderdate::DATE = ({SQL_SWAP.format(c='l_shipdate')})::DATE AS same
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def date_same_or_swapped(spark, d):
    joined = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select("l_orderkey", "l_linenumber", "l_partkey", L.same_or_swapped(F.col("o_orderdate"), F.col("l_shipdate")).alias("same"))


@query("date_has_time", "SELECT event_id, hour(ts) <> 0 AND minute(ts) <> 0 AND second(ts) <> 0 AS has_time FROM events")
def date_has_time(spark, d):
    return table(spark, d, "events").select("event_id", L.has_time(F.col("ts")).alias("has_time"))


SQL_CELLS = f"""
    cells AS (SELECT event_id, 1 AS ordinal, CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts END AS ts, 'Consultation' AS nature, event_type AS value, user_id::VARCHAR AS patient FROM events
        UNION ALL SELECT event_id, 2, {SQL_SWAP.format(c="date_trunc('day', ts)")}, 'Imagerie', user_id::VARCHAR, user_id::VARCHAR FROM events
        UNION ALL SELECT event_id, 3, date_trunc('day', ts) + INTERVAL 3 DAY, 'Bilan', CASE WHEN event_id % 5 = 0 THEN NULL ELSE props END, user_id::VARCHAR FROM events)"""


def cells(spark, d):
    """Three dated cells per event: the event, its day with day and month swapped, and a later day."""
    events = table(spark, d, "events").withColumn("patient", F.col("user_id").cast("string"))
    day = F.date_trunc("day", F.col("ts")).cast("timestamp_ntz")
    parts = [
        (1, F.when(F.col("event_id") % 3 != 0, F.col("ts")), "Consultation", F.col("event_type")),
        (2, L.swap_day_month(day), "Imagerie", F.col("patient")),
        (3, (F.to_date("ts") + F.expr("INTERVAL 3 DAY")).cast("timestamp_ntz"), "Bilan", F.when(F.col("event_id") % 5 != 0, F.col("props"))),
    ]
    packed = F.array(*[F.struct(F.lit(o).alias("ordinal"), ts.alias("ts"), F.lit(nature).alias("nature"), value.alias("value")) for o, ts, nature, value in parts])
    return events.select("event_id", "patient", F.explode(packed).alias("c")).select("event_id", "patient", "c.*")


@query("date_correct", f"""WITH {SQL_CELLS},
    f AS (SELECT event_id, min(ordinal) AS fo FROM cells WHERE ts IS NOT NULL GROUP BY event_id), r AS (SELECT event_id, fo, ts AS fts FROM f JOIN cells USING (event_id) WHERE ordinal = fo)
    SELECT event_id, ordinal, CASE WHEN ordinal > fo AND NOT (hour(ts) <> 0 AND minute(ts) <> 0 AND second(ts) <> 0)
        AND (fts::DATE = ts::DATE OR fts::DATE = ({SQL_SWAP.format(c='ts')})::DATE) THEN fts ELSE ts END AS ts FROM cells JOIN r USING (event_id)""")
def date_correct(spark, d):
    return L.correct_dates(cells(spark, d), "event_id", "ordinal", "ts").select("event_id", "ordinal", "ts")


SQL_FIRST = """
    f AS (SELECT event_id, ts, nature, row_number() OVER (PARTITION BY event_id ORDER BY ordinal) AS r FROM cells WHERE ts IS NOT NULL)"""


@query("row_date", f"WITH {SQL_CELLS}, {SQL_FIRST} SELECT event_id, strftime(ts, '%Y-%m-%d') AS note_date, nature FROM f WHERE r = 1")
def row_date(spark, d):
    return L.row_dates(cells(spark, d), "event_id", "ordinal", "ts", "nature").withColumn("note_date", F.col("note_date").cast("string"))


@query("note_build", f"""WITH {SQL_CELLS}, {SQL_FIRST},
    t AS (SELECT event_id, patient, string_agg(value, ', ' ORDER BY ordinal) AS text FROM cells WHERE value <> patient GROUP BY event_id, patient)
    SELECT event_id, patient, strftime(ts, '%Y-%m-%d') AS note_date, nature, text FROM t JOIN f USING (event_id) WHERE r = 1""")
def note_build(spark, d):
    built = L.build_notes(cells(spark, d), "event_id", "patient", "ordinal", "ts", "nature", "value")
    return built.withColumn("note_date", F.col("note_date").cast("string"))


@query("days_between", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(date_diff('day', o_orderdate::DATE, l_shipdate::DATE) AS INT) AS days FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def days_between(spark, d):
    joined = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select("l_orderkey", "l_linenumber", "l_partkey", L.days_between(F.col("l_shipdate"), F.col("o_orderdate")).alias("days"))


SQL_ANCHOR = "a AS (SELECT user_id, min(ts) AS anchor FROM events WHERE event_type = 'error' AND value > 30 GROUP BY user_id)"


def anchors(spark, d):
    """First costly error of each user."""
    events = table(spark, d, "events").where((F.col("event_type") == "error") & (F.col("value") > 30))
    return L.first_events(events, "user_id", "ts").withColumnRenamed("first_event", "anchor")


@query("closest_date", f"""WITH {SQL_ANCHOR}
    SELECT user_id, strftime(day, '%Y-%m-%d') AS closest FROM (SELECT e.user_id, ts::DATE AS day,
        row_number() OVER (PARTITION BY e.user_id ORDER BY abs(date_diff('day', anchor::DATE, ts::DATE)), ts::DATE) AS r
        FROM events e JOIN a USING (user_id) WHERE event_type = 'purchase') WHERE r = 1""")
def closest_date(spark, d):
    purchases = table(spark, d, "events").where(F.col("event_type") == "purchase")
    found = L.closest_dates(purchases, "user_id", "ts", anchors(spark, d), "anchor")
    return found.withColumn("closest", F.col("closest").cast("string"))


@query("event_first", "SELECT user_id, min(ts) AS first_event FROM events WHERE event_type = 'error' GROUP BY user_id")
def event_first(spark, d):
    return L.first_events(table(spark, d, "events").where(F.col("event_type") == "error"), "user_id", "ts")


@query("timeline_truncate", f"""WITH {SQL_ANCHOR},
    n AS (SELECT * FROM (SELECT e.user_id, ts AS at_ts, event_id AS id, row_number() OVER (PARTITION BY e.user_id ORDER BY abs(date_diff('day', anchor::DATE, ts::DATE)), ts::DATE, ts, event_id) AS r
          FROM events e JOIN a USING (user_id) WHERE event_type <> 'click') WHERE r = 1)
    SELECT e.event_id, e.user_id, e.ts FROM events e LEFT JOIN n USING (user_id)
    WHERE event_type <> 'click' AND (at_ts IS NULL OR ts < at_ts OR (ts = at_ts AND event_id <= id))""")
def timeline_truncate(spark, d):
    notes = table(spark, d, "events").where(F.col("event_type") != "click").select("event_id", "user_id", "ts")
    return L.truncate_timeline(notes, "user_id", "ts", "event_id", anchors(spark, d), "anchor")


@query("leak_filter", """
    SELECT doc_id, source FROM documents WHERE NOT (contains(lower(text), 'auxeau') OR contains(lower(text), 'thth') OR contains(lower(text), 'endométriose'))""")
def leak_filter(spark, d):
    """Planned-section notes with outcome words go first, then every note with one."""
    docs, words = table(spark, d, "documents"), ("auxeau", "thth", "endométriose")
    first = L.drop_leaking_notes(docs, "text", "source", planned="src1", vocabulary=words, only_planned=True)
    return L.drop_leaking_notes(first, "text", "source", vocabulary=words).select("doc_id", "source")
