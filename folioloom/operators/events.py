"""Reading-event analytics: rollups, indicators, funnels, retention and admission."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioloom.functions import text

#: The event types, those that need a chapter, and the limits of a request.
EVENT_TYPES = ("book_view", "chapter_start", "chapter_25", "chapter_50", "chapter_75", "chapter_complete", "bookshelf_add", "offline_download")
CHAPTER_EVENTS = ("chapter_start", "chapter_25", "chapter_50", "chapter_75", "chapter_complete", "offline_download")
MAX_SECONDS, MAX_BODY_BYTES = 86_400, 4096
UUID = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"


def actor() -> Column:
    """A reader's identity: the user, else the anonymous id."""
    return F.coalesce(F.col("user_id"), F.col("anonymous_id"))


def known_actor() -> Column:
    """As actor, an empty one being none."""
    return F.nullif(actor(), F.lit(""))


def reader_key() -> Column:
    """Who a limit applies to: the account, else the anonymous id; null if there is neither."""
    return F.when(F.col("user_id").isNotNull(), F.concat(F.lit("user:"), "user_id")).otherwise(F.concat(F.lit("anonymous:"), F.nullif(F.col("anonymous_id"), F.lit(""))))


def rollup(events: DataFrame) -> DataFrame:
    """Events and distinct readers by month, book and type."""
    month = F.date_trunc("month", "created_at")
    return events.groupBy(month.cast("date").alias("period_start"), F.add_months(month, 1).cast("date").alias("period_end"), "book_id", "event_type").agg(
        F.count("*").alias("event_count"), F.countDistinct(actor()).alias("unique_readers")
    )


def rollup_period(events: DataFrame, start: str, end: str) -> DataFrame:
    """The rollup of ``[start, end)`` alone."""
    return rollup(events.where((F.col("created_at") >= F.lit(start).cast("timestamp")) & (F.col("created_at") < F.lit(end).cast("timestamp"))))


def write_rollup(rollups: DataFrame, path: str) -> None:
    """Replace the periods that ``rollups`` holds; a repeated run leaves the same rows."""
    rollups.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period_start").parquet(path)


def rollup_titles(rollups: DataFrame, books: DataFrame) -> DataFrame:
    titles = books.select(F.col("id").alias("book_id"), F.col("title").alias("_title"))
    label = F.when(F.col("book_id").isNull(), "All books").otherwise(F.coalesce("_title", F.lit("Deleted book")))
    return rollups.join(titles, "book_id", "left").withColumn("book_title", label).drop("_title")


def event_totals(rollups: DataFrame) -> DataFrame:
    return rollups.groupBy("event_type").agg(F.sum("event_count").alias("event_count"))


def indicators(events: DataFrame, now: str) -> DataFrame:
    """One row: views, downloads, first-chapter completions and third-chapter starts of seven days."""
    recent = (F.col("created_at") >= F.lit(now).cast("timestamp") - F.expr("INTERVAL 7 DAYS")) & (F.col("created_at") <= F.lit(now).cast("timestamp"))
    is_a = lambda kind: F.col("event_type") == kind
    return events.where(recent).agg(
        F.count_if(is_a("book_view")).alias("views"),
        F.count_if(is_a("offline_download")).alias("downloads"),
        F.count_if(is_a("chapter_complete") & (F.col("chapter_number") == 1)).alias("first_chapter_completions"),
        F.count_if(is_a("chapter_start") & (F.col("chapter_number") == 3)).alias("third_chapter_starts"),
    )


def dashboard(events: DataFrame, books: DataFrame, now: str) -> DataFrame:
    """One row: the indicators of seven days, the readers of today and the published books. Events are read once."""
    at = F.lit(now).cast("timestamp")
    recent = (F.col("created_at") >= at - F.expr("INTERVAL 7 DAYS")) & (F.col("created_at") <= at)
    today = (F.col("created_at") >= F.date_trunc("day", at)) & (F.col("created_at") <= at)
    is_a = lambda kind: recent & (F.col("event_type") == kind)
    # two counts of one kind of aggregate: distinct readers, and plain ones by reader first, so that none is expanded
    each = events.where(recent | today).groupBy(known_actor().alias("actor")).agg(
        F.count_if(is_a("book_view")).alias("views"),
        F.count_if(is_a("offline_download")).alias("downloads"),
        F.count_if(is_a("chapter_complete") & (F.col("chapter_number") == 1)).alias("first_chapter_completions"),
        F.count_if(is_a("chapter_start") & (F.col("chapter_number") == 3)).alias("third_chapter_starts"),
        F.max(today).alias("_today"),
    )
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("views", "downloads", "first_chapter_completions", "third_chapter_starts")]
    row = each.agg(*sums, F.count_if(F.col("_today") & F.col("actor").isNotNull()).alias("readers_today"))
    return row.join(F.broadcast(books.agg(F.count_if(F.col("status") == "published").alias("published"))))  # single rows


def readers_per_day(events: DataFrame) -> DataFrame:
    return events.groupBy(F.col("created_at").cast("date").alias("day")).agg(F.countDistinct(known_actor()).alias("readers"))


def checkpoints(events: DataFrame) -> DataFrame:
    """The first event of each type by reader and day."""
    return events.groupBy(actor().alias("actor"), F.col("created_at").cast("date").alias("day"), "event_type").agg(F.min("created_at").alias("first_at"))


def funnel(events: DataFrame) -> DataFrame:
    """By day, the readers with a view, a start after it, and a completion after that."""
    first = lambda kind: F.min(F.when(F.col("event_type") == kind, F.col("created_at")))
    each = events.groupBy(actor().alias("actor"), F.col("created_at").cast("date").alias("day")).agg(first("book_view").alias("v"), first("chapter_start").alias("s"), first("chapter_complete").alias("c"))
    return each.groupBy("day").agg(F.count("v").alias("viewed"), F.count_if(F.col("s") >= F.col("v")).alias("started"), F.count_if((F.col("s") >= F.col("v")) & (F.col("c") >= F.col("s"))).alias("completed"))


def retention(events: DataFrame, cutoff: str) -> DataFrame:
    """Events that stay after a purge."""
    return events.where(F.col("created_at") >= F.lit(cutoff).cast("timestamp"))


def purge(events: DataFrame, cutoff: str, run_status: str) -> tuple[DataFrame, int]:
    """What stays and how many go; refused unless the month's report was sent."""
    if run_status != "sent":
        raise ValueError("events can be purged only after the report was sent")
    going = events.where(F.col("created_at") < F.lit(cutoff).cast("timestamp")).count()
    return retention(events, cutoff), going


def recent_counts(events: DataFrame, seconds: int = 60) -> DataFrame:
    """For each event how many of its reader's lie in the trailing window, itself included."""
    window = Window.partitionBy(actor()).orderBy(F.unix_micros("created_at")).rangeBetween(-seconds * 1_000_000, 0)
    return events.select("event_id", actor().alias("actor"), F.count("*").over(window).alias("recent"))


def admit(events: DataFrame, quota: int = 120, seconds: int = 60) -> DataFrame:
    """Greedy admission: an event is accepted if fewer than ``quota`` accepted ones of its reader lie
    in the trailing window. Rejected events use no quota, so no window count can express it.

    Rows stream in order within each reader; only the accepted times of one window are held.
    """
    key = F.when(F.col("user_id").isNotNull(), F.concat(F.lit("user:"), "user_id")).otherwise(F.concat(F.lit("anonymous:"), F.coalesce("anonymous_id", F.lit(""))))
    rows = events.select("event_id", key.alias("actor"), F.unix_micros("created_at").alias("_at"))
    width = seconds * 1_000_000

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, deque()
        for frame in frames:
            accepted = []
            for who, at in zip(frame["actor"], frame["_at"], strict=True):
                if who != now:
                    now, held = who, deque()
                while held and held[0] < at - width:
                    held.popleft()
                accepted.append(len(held) < quota)
                if accepted[-1]:
                    held.append(at)
            yield frame.assign(accepted=accepted)[["event_id", "actor", "accepted"]]

    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "actor").sortWithinPartitions("actor", "_at", "event_id").mapInPandas(run, "event_id long, actor string, accepted boolean")


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, by ``order``; partial maxima meet, no key is gathered."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, "_row.*")


def is_uuid(c: Column) -> Column:
    return F.coalesce(c.rlike(UUID), F.lit(False))


def rejections(events: DataFrame) -> DataFrame:
    """Events with the first rule that they break as ``rejection``, null if none.

    The chapter is ``chapter_id`` where there is one, else ``chapter_number``. Ids that are texts must be
    UUIDs; a reader without an account must have an anonymous UUID.
    """
    chapter = "chapter_id" if "chapter_id" in events.columns else "chapter_number"
    told = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    wrong = lambda c: told(c).isNotNull() & ~is_uuid(F.col(c)) if dict(events.dtypes)[c] == "string" else F.lit(False)
    seconds = F.col("reading_seconds").cast("double")
    rule = (
        F.when(F.col("event_type").isNull() | ~F.col("event_type").isin(*EVENT_TYPES), "unknown event type")
        .when(told("book_id").isNull(), "book required")
        .when(wrong("book_id"), "book is no UUID")
        .when(wrong(chapter), "chapter is no UUID")
        .when(F.col("event_type").isin(*CHAPTER_EVENTS) & told(chapter).isNull(), "chapter required")
        .when(seconds.isNotNull() & ~(seconds.between(0, MAX_SECONDS) & (seconds == F.floor(seconds))), "seconds out of range")
        .when(F.col("user_id").isNull() & ~is_uuid(F.trim("anonymous_id")), "reader required")
    )
    return events.withColumn("rejection", rule)


def strict_json(c: Column) -> Column:
    """A JSON text as a variant; null if anything stands behind its value, which the parser alone lets pass.

    What follows the value would have to go on both an object and an array.
    """
    alone = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"v":'), c, F.lit("}"))).isNotNull()
    return F.when(alone, F.try_parse_json(c))


def request_outcomes(requests: DataFrame, body: str = "body") -> DataFrame:
    """Requests (``body``, user_id) with ``outcome``: why a request is refused, null if its event is recorded.

    A body is a JSON object of at most MAX_BODY_BYTES bytes. Values of another JSON type count as wrong.
    """
    names = ("eventType", "bookId", "chapterId", "readingSeconds", "anonymousId")

    def fields(value: Column) -> Column:
        """Each field's kind and string, read once."""

        def read(name: str) -> Column:
            got = lambda v: F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
            return text.bound(F.try_variant_get(value, f"$.{name}", "variant"), lambda v: F.struct(got(v).alias("kind"), F.when(got(v) == "STRING", F.try_variant_get(v, "$", "string")).alias("string"))).alias(name)

        return F.struct(*[read(name) for name in names], F.try_variant_get(value, "$.readingSeconds", "double").alias("seconds"))

    def fault(f: Column) -> Column:
        kind, string = lambda name: f[name]["kind"], lambda name: f[name]["string"]
        empty = lambda name: (kind(name) == "VOID") | F.coalesce(string(name) == "", F.lit(False))
        event, seconds = F.coalesce(string("eventType"), F.lit("")), f["seconds"]
        whole = kind("readingSeconds").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)") & F.coalesce(seconds.between(0, MAX_SECONDS) & (seconds == F.floor(seconds)), F.lit(False))
        chapter = empty("chapterId") | is_uuid(string("chapterId"))
        good = event.isin(*EVENT_TYPES) & is_uuid(string("bookId")) & chapter & (~event.isin(*CHAPTER_EVENTS) | ~empty("chapterId")) & ((kind("readingSeconds") == "VOID") | whole)
        return F.when(~good, "invalid event").when(F.col("user_id").isNull() & ~is_uuid(F.trim(string("anonymousId"))), "invalid reader")

    def judged(value: Column) -> Column:
        an_object = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
        return F.when(value.isNull(), "not JSON").when(~an_object, "invalid event").otherwise(text.bound(fields(value), fault))

    # a body is parsed once
    outcome = F.when(F.octet_length(body) > MAX_BODY_BYTES, "too large").otherwise(text.bound(strict_json(F.col(body).cast("string")), judged))
    return requests.withColumn("outcome", outcome)


def month_window(now: str | Column) -> tuple[Column, Column]:
    """The month before that of ``now``, as [start, end) dates."""
    this = F.date_trunc("month", (F.lit(now) if isinstance(now, str) else now).cast("timestamp")).cast("date")
    return F.add_months(this, -1), this


def report_rows(rollups: DataFrame) -> DataFrame:
    """HTML table rows of titled rollups, the largest first."""
    from folioloom.functions.text import html_escape

    cells = [html_escape(F.col("book_title")), html_escape(F.col("event_type")), F.format_number("event_count", 0), F.format_number("unique_readers", 0)]
    row = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cells], F.lit("</tr>"))
    return rollups.orderBy(F.desc("event_count"), "book_title", "event_type").select(row.alias("html"))


def throttled(events: DataFrame, seconds: int = 12) -> DataFrame:
    """Of each reader the events at least ``seconds`` after the last one kept."""
    return admit(events, quota=1, seconds=seconds).where("accepted").select("event_id", "actor")


def reading_seconds(opened: Column, closed: Column) -> Column:
    """Seconds between two times, whole and at least one."""
    return F.greatest(F.lit(1), F.floor((F.unix_millis(closed) - F.unix_millis(opened)) / 1000 + 0.5)).cast("long")


def scroll_percent(offset: Column, reach: Column) -> Column:
    """How far a page is scrolled, 0 to 100; a page that cannot be scrolled is read whole."""
    share = F.floor(offset / F.when(reach > 0, reach) * 100 + 0.5)
    return F.when(reach > 0, F.greatest(F.lit(0), F.least(F.lit(100), share))).otherwise(100).cast("int")


#: Shares of a chapter at which an event is sent.
CHECKPOINTS = {25: "chapter_25", 50: "chapter_50", 75: "chapter_75", 98: "chapter_complete"}


def scroll_checkpoints(scrolls: DataFrame, session: str = "session_id", percent: str = "percent", at: str = "created_at") -> DataFrame:
    """(session, event_type, first_at): the first time that a session reaches each share, once however often it does."""
    reached = F.array_compact(F.array(*[F.when(F.col(percent) >= share, name) for share, name in CHECKPOINTS.items()]))
    return scrolls.select(session, at, F.explode(reached).alias("event_type")).groupBy(session, "event_type").agg(F.min(at).alias("first_at"))


def debounced(events: DataFrame, key: str, at: str = "created_at", millis: int = 500) -> DataFrame:
    """Events after which none of the same key follows within ``millis``: what a debounced sender sends. Of one time the
    event of the largest id is the last, and one without an id after it."""
    following = F.lead(at).over(Window.partitionBy(key).orderBy(F.asc_nulls_last(at), F.asc_nulls_last("event_id")))
    waits = F.unix_millis(following) - F.unix_millis(at)
    return events.withColumn("_waits", waits).where(F.col("_waits").isNull() | (F.col("_waits") >= millis)).drop("_waits")
