"""Queries on reading events."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioloom.operators import events as ev

from .stand_ins import EVENT_NOW, READINGS, books, reading_events, table

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(make):
        QUERIES[name] = make
        if sql:
            ORACLE_SQL[name] = sql
        return make

    return keep


ROLLUP = """rollups AS (
  SELECT CAST(date_trunc('month', created_at) AS DATE) AS period_start, CAST(date_trunc('month', created_at) + INTERVAL 1 MONTH AS DATE) AS period_end,
         book_id, event_type, count(*) AS event_count, count(DISTINCT coalesce(user_id, anonymous_id)) AS unique_readers
  FROM readings GROUP BY ALL
)"""


@query("rollup_monthly_events", f"WITH {READINGS}, {ROLLUP} SELECT * FROM rollups")
def rollup_monthly_events(spark, d):
    return ev.rollup(reading_events(spark, d))


@query(
    "rollup_titles",
    f"""WITH {READINGS}, {ROLLUP} SELECT r.*, CASE WHEN r.book_id IS NULL THEN 'All books' ELSE coalesce('Book ' || o_orderkey, 'Deleted book') END AS book_title
    FROM rollups r LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 4 <> 0) ON o_orderkey = book_id""",
)
def rollup_titles(spark, d):
    return ev.rollup_titles(ev.rollup(reading_events(spark, d)), books(spark, d).where("id % 4 <> 0"))


@query("rollup_event_totals", f"WITH {READINGS}, {ROLLUP} SELECT event_type, CAST(sum(event_count) AS BIGINT) AS event_count FROM rollups GROUP BY 1")
def rollup_event_totals(spark, d):
    return ev.event_totals(ev.rollup(reading_events(spark, d)))


@query("rollup_one_period", f"WITH {READINGS}, {ROLLUP} SELECT * FROM rollups WHERE period_start = DATE '2024-01-01'")
def rollup_one_period(spark, d):
    return ev.rollup_period(reading_events(spark, d), "2024-01-01", "2024-02-01")


@query(
    "kpi_last_7_days",
    f"""WITH {READINGS} SELECT count(*) FILTER (event_type = 'book_view') AS views, count(*) FILTER (event_type = 'offline_download') AS downloads,
    count(*) FILTER (event_type = 'chapter_complete' AND chapter_number = 1) AS first_chapter_completions,
    count(*) FILTER (event_type = 'chapter_start' AND chapter_number = 3) AS third_chapter_starts
    FROM readings WHERE created_at >= TIMESTAMP '{EVENT_NOW}' - INTERVAL 7 DAYS AND created_at <= TIMESTAMP '{EVENT_NOW}'""",
)
def kpi_last_7_days(spark, d):
    return ev.indicators(reading_events(spark, d), EVENT_NOW)


@query("readers_per_day", f"WITH {READINGS} SELECT CAST(created_at AS DATE) AS day, count(DISTINCT nullif(coalesce(user_id, anonymous_id), '')) AS readers FROM readings GROUP BY 1")
def readers_per_day(spark, d):
    return ev.readers_per_day(reading_events(spark, d))


@query(
    "first_checkpoints",
    f"WITH {READINGS} SELECT coalesce(user_id, anonymous_id) AS actor, CAST(created_at AS DATE) AS day, event_type, min(created_at) AS first_at FROM readings GROUP BY 1, 2, 3",
)
def first_checkpoints(spark, d):
    return ev.checkpoints(reading_events(spark, d))


@query(
    "chapter_funnel",
    f"""WITH {READINGS}, each AS (
      SELECT coalesce(user_id, anonymous_id) AS actor, CAST(created_at AS DATE) AS day, min(created_at) FILTER (event_type = 'book_view') AS v,
             min(created_at) FILTER (event_type = 'chapter_start') AS s, min(created_at) FILTER (event_type = 'chapter_complete') AS c FROM readings GROUP BY 1, 2)
    SELECT day, count(v) AS viewed, count(*) FILTER (s >= v) AS started, count(*) FILTER (s >= v AND c >= s) AS completed FROM each GROUP BY 1""",
)
def chapter_funnel(spark, d):
    return ev.funnel(reading_events(spark, d))


@query(
    "actor_identity",
    f"""WITH {READINGS} SELECT event_id, coalesce(user_id, anonymous_id) AS actor, nullif(coalesce(user_id, anonymous_id), '') AS known_actor FROM readings""",
)
def actor_identity(spark, d):
    return reading_events(spark, d).select("event_id", ev.actor().alias("actor"), ev.known_actor().alias("known_actor"))


@query(
    "retention_purge_counts",
    f"""WITH {READINGS} SELECT count(*) FILTER (created_at < TIMESTAMP '2024-01-16') AS purged, count(*) FILTER (created_at >= TIMESTAMP '2024-01-16') AS kept,
    CAST(TIMESTAMP '{EVENT_NOW}' - INTERVAL 90 DAYS AS DATE) AS default_cutoff FROM readings""",
)
def retention_purge_counts(spark, d):
    stays = F.col("created_at") >= F.lit("2024-01-16").cast("timestamp")
    return reading_events(spark, d).agg(F.count_if(~stays).alias("purged"), F.count_if(stays).alias("kept"), F.first(F.date_sub(F.lit(EVENT_NOW).cast("timestamp").cast("date"), 90)).alias("default_cutoff"))


@query(
    "minute_rate_window",
    f"""WITH {READINGS} SELECT event_id, coalesce(user_id, anonymous_id) AS actor,
    count(*) OVER (PARTITION BY coalesce(user_id, anonymous_id) ORDER BY created_at RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND CURRENT ROW) AS recent FROM readings""",
)
def minute_rate_window(spark, d):
    return ev.recent_counts(reading_events(spark, d), 6 * 3600)


GREEDY_SQL = f"""WITH RECURSIVE {READINGS}, keyed AS (
  SELECT event_id, CASE WHEN user_id IS NOT NULL THEN 'user:' || user_id ELSE 'anonymous:' || coalesce(anonymous_id, '') END AS actor, created_at FROM readings
), numbered AS (SELECT *, row_number() OVER (PARTITION BY actor ORDER BY created_at, event_id) AS k FROM keyed
), steps AS (
  SELECT event_id, actor, k, TRUE AS accepted, [created_at] AS held FROM numbered WHERE k = 1
  UNION ALL
  SELECT n.event_id, n.actor, n.k, len(list_filter(s.held, lambda t: t >= n.created_at - INTERVAL 6 HOURS)) < 2,
         CASE WHEN len(list_filter(s.held, lambda t: t >= n.created_at - INTERVAL 6 HOURS)) < 2
              THEN list_append(list_filter(s.held, lambda t: t >= n.created_at - INTERVAL 6 HOURS), n.created_at)
              ELSE list_filter(s.held, lambda t: t >= n.created_at - INTERVAL 6 HOURS) END
  FROM steps s JOIN numbered n ON n.actor = s.actor AND n.k = s.k + 1
) SELECT event_id, actor, accepted FROM steps"""


@query("greedy_rate_limit", GREEDY_SQL)
def greedy_rate_limit(spark, d):
    return ev.admit(reading_events(spark, d), quota=2, seconds=6 * 3600)


@query(
    "latest_progress",
    f"""WITH {READINGS} SELECT coalesce(user_id, anonymous_id) AS actor, book_id, max(struct_pack(a := created_at, b := event_id)).a AS created_at,
    max(struct_pack(a := created_at, b := event_id)).b AS event_id FROM readings WHERE book_id IS NOT NULL GROUP BY 1, 2""",
)
def latest_progress(spark, d):
    rows = reading_events(spark, d).where("book_id is not null").select(ev.actor().alias("actor"), "book_id", "created_at", "event_id")
    return ev.latest(rows, ["actor", "book_id"], ["created_at", "event_id"])


@query("bookshelf_set", f"WITH {READINGS} SELECT DISTINCT user_id, book_id FROM readings WHERE event_type = 'bookshelf_add' AND user_id IS NOT NULL AND book_id IS NOT NULL")
def bookshelf_set(spark, d):
    return reading_events(spark, d).where("event_type = 'bookshelf_add' and user_id is not null and book_id is not null").select("user_id", "book_id").distinct()


UUID_SQL = "'(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$'"


@query(
    "event_validation",
    f"""WITH shaped AS (
      SELECT event_id, CASE event_id % 11 WHEN 0 THEN 'book_view' WHEN 1 THEN 'chapter_start' WHEN 2 THEN 'chapter_25' WHEN 3 THEN 'chapter_50' WHEN 4 THEN 'chapter_75' WHEN 5 THEN 'chapter_complete'
               WHEN 6 THEN 'bookshelf_add' WHEN 7 THEN 'offline_download' WHEN 8 THEN 'chapter_progress' WHEN 9 THEN 'share' ELSE 'search' END AS event_type,
             CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 19 = 0 THEN 'book-' || user_id ELSE '00000000-0000-4000-8000-' || lpad(CAST(user_id AS VARCHAR), 12, '0') END AS book_id,
             CASE WHEN event_id % 13 = 0 THEN '' WHEN event_id % 23 = 0 THEN 'x' ELSE '00000000-0000-1000-a000-' || lpad(CAST(user_id AS VARCHAR), 12, '0') END AS chapter_id,
             CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS user_id,
             CASE WHEN event_id % 29 = 0 THEN 'anon-' || user_id ELSE 'AAAAAAAA-AAAA-5AAA-BAAA-' || lpad(CAST(user_id AS VARCHAR), 12, '0') END AS anonymous_id,
             CASE WHEN event_id % 31 = 0 THEN NULL WHEN event_id % 37 = 0 THEN 1.5 ELSE round(value * 1000) END AS reading_seconds FROM events)
    SELECT event_id, CASE WHEN event_type NOT IN ('book_view', 'chapter_start', 'chapter_25', 'chapter_50', 'chapter_75', 'chapter_complete', 'bookshelf_add', 'offline_download') THEN 'unknown event type'
           WHEN book_id IS NULL THEN 'book required' WHEN NOT regexp_matches(book_id, {UUID_SQL}) THEN 'book is no UUID'
           WHEN chapter_id <> '' AND NOT regexp_matches(chapter_id, {UUID_SQL}) THEN 'chapter is no UUID'
           WHEN event_type NOT IN ('book_view', 'bookshelf_add') AND chapter_id = '' THEN 'chapter required'
           WHEN reading_seconds < 0 OR reading_seconds > 86400 OR reading_seconds <> floor(reading_seconds) THEN 'seconds out of range'
           WHEN user_id IS NULL AND NOT regexp_matches(anonymous_id, {UUID_SQL}) THEN 'reader required' END AS rejection FROM shaped""",
)
def event_validation(spark, d):
    k, user = F.col("event_id"), F.col("user_id").cast("string")
    kinds = F.array(*[F.lit(x) for x in ("book_view", "chapter_start", "chapter_25", "chapter_50", "chapter_75", "chapter_complete", "bookshelf_add", "offline_download", "chapter_progress", "share", "search")])
    told = lambda head: F.concat(F.lit(head), F.lpad(user, 12, "0"))
    rows = table(spark, d, "events").select(
        "event_id",
        F.get(kinds, (k % 11).cast("int")).alias("event_type"),
        F.when(k % 17 == 0, None).when(k % 19 == 0, F.concat(F.lit("book-"), user)).otherwise(told("00000000-0000-4000-8000-")).alias("book_id"),
        F.when(k % 13 == 0, "").when(k % 23 == 0, "x").otherwise(told("00000000-0000-1000-a000-")).alias("chapter_id"),
        F.when(k % 3 != 0, user).alias("user_id"),
        F.when(k % 29 == 0, F.concat(F.lit("anon-"), user)).otherwise(told("AAAAAAAA-AAAA-5AAA-BAAA-")).alias("anonymous_id"),
        F.when(k % 31 == 0, None).when(k % 37 == 0, 1.5).otherwise(F.round(F.col("value") * 1000)).alias("reading_seconds"),
    )
    return ev.rejections(rows).select("event_id", "rejection")


SCROLLS = "scrolls AS (SELECT user_id AS session_id, CAST(event_id * 7 % 101 AS INTEGER) AS percent, ts AS created_at, event_id FROM events)"


def scrolls(spark, d):
    rows = table(spark, d, "events")
    return rows.select(F.col("user_id").alias("session_id"), (F.col("event_id") * 7 % 101).cast("int").alias("percent"), F.col("ts").cast("timestamp").alias("created_at"), "event_id")


@query(
    "scroll_checkpoints",
    f"""WITH {SCROLLS} SELECT session_id, event_type, min(created_at) AS first_at FROM scrolls, (VALUES (25, 'chapter_25'), (50, 'chapter_50'), (75, 'chapter_75'), (98, 'chapter_complete')) AS v(share, event_type) WHERE percent >= share GROUP BY 1, 2""",
)
def scroll_checkpoints(spark, d):
    return ev.scroll_checkpoints(scrolls(spark, d))


@query("reading_time", "SELECT event_id, CAST(greatest(1, floor(CAST(round(value * 100) AS BIGINT) / 1000.0 + 0.5)) AS BIGINT) AS seconds FROM events")
def reading_time(spark, d):
    opened = F.col("ts").cast("timestamp")
    closed = F.timestamp_millis(F.unix_millis(opened) + F.round(F.col("value") * 100).cast("long"))
    return table(spark, d, "events").select("event_id", ev.reading_seconds(opened, closed).alias("seconds"))


@query(
    "debounced_progress",
    f"""WITH {SCROLLS} SELECT event_id FROM (SELECT event_id, epoch_ms(lead(created_at) OVER (PARTITION BY session_id ORDER BY created_at, event_id)) - epoch_ms(created_at) AS waits FROM scrolls) WHERE waits IS NULL OR waits >= 7200000""",
)
def debounced_progress(spark, d):
    return ev.debounced(scrolls(spark, d), "session_id", millis=7_200_000).select("event_id")


@query(
    "throttled_progress",
    """WITH RECURSIVE rows AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    steps AS (SELECT user_id, event_id, k, ts AS kept_at, TRUE AS kept FROM rows WHERE k = 1
      UNION ALL SELECT n.user_id, n.event_id, n.k, CASE WHEN n.ts > s.kept_at + INTERVAL 6 HOURS THEN n.ts ELSE s.kept_at END, n.ts > s.kept_at + INTERVAL 6 HOURS FROM steps s JOIN rows n ON n.user_id = s.user_id AND n.k = s.k + 1)
    SELECT event_id, 'user:' || user_id AS actor FROM steps WHERE kept""",
)
def throttled_progress(spark, d):
    rows = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("created_at"), F.col("user_id").cast("string").alias("user_id"), F.lit(None).cast("string").alias("anonymous_id"))
    return ev.throttled(rows, 6 * 3600)


@query("purge_after_report", f"WITH {READINGS} SELECT count(*) FILTER (created_at >= TIMESTAMP '2024-01-16') AS kept, count(*) FILTER (created_at < TIMESTAMP '2024-01-16') AS going FROM readings")
def purge_after_report(spark, d):
    kept, going = ev.purge(reading_events(spark, d), "2024-01-16 00:00:00", "sent")
    return kept.agg(F.count("*").alias("kept"), F.lit(going).cast("long").alias("going"))


@query(
    "report_table",
    f"""WITH {READINGS}, {ROLLUP} SELECT '<tr><td>' || CASE WHEN book_id IS NULL THEN 'All books' WHEN book_id % 4 = 0 THEN 'Deleted book' ELSE coalesce('A &amp; B &lt;' || o_orderkey || '&gt;', 'Deleted book') END || '</td><td>' || event_type || '</td><td>'
    || format('{{:,}}', event_count) || '</td><td>' || format('{{:,}}', unique_readers) || '</td></tr>' AS html FROM rollups LEFT JOIN orders ON o_orderkey = book_id""",
)
def report_table(spark, d):
    named = books(spark, d).where("id % 4 <> 0").withColumn("title", F.concat(F.lit("A & B <"), F.col("id").cast("string"), F.lit(">")))
    return ev.report_rows(ev.rollup_titles(ev.rollup(reading_events(spark, d)), named))


@query("json_props", "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def json_props(spark, d):
    return reading_events(spark, d).groupBy(F.from_json("props", "k long")["k"].alias("k")).agg(F.count("*").alias("n"))
