"""Queries over conversations, token streams and timed events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import text as T
from ..operators import history, layout
from ..sources import views as V
from ..streaming import replies, sessions, timers
from .registry import query

#: Canned answers; the first three are given once.
LINES = ("Good day.", "You write well.", "Say more.", "I thought so.", "Nobody is listening.", "You came back.")
FIRST, LATER = "This is the first page. Answer it.", "This is the {} page of this sitting. Answer it."

_VALID = "role IN ('user', 'assistant') AND regexp_matches(text, '\\S')"


def _tail_sql(n: int) -> str:
    return f"SELECT conv_id, turn, role, text[1:4000] AS text FROM conversations WHERE {_VALID} QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= {n}"


@query(sql=_tail_sql(40))
def history_tail40(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.tail(V.history(spark, sf_dir), 40)


@query(sql=_tail_sql(3))
def history_tail3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.tail(V.history(spark, sf_dir), 3)


@query(sql="SELECT conv_id, count(*) FILTER (role = 'user') + 1 AS turn_number FROM conversations GROUP BY conv_id")
def turn_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.turn_numbers(V.history(spark, sf_dir))


@query(
    sql="""SELECT conv_id, n + 1 AS n_messages, CASE WHEN t = 1 THEN 'This is the first page. Answer it.' ELSE 'This is the ' || t || CASE WHEN t % 100 BETWEEN 11 AND 13 THEN 'th' WHEN t % 10 = 1 THEN 'st' WHEN t % 10 = 2 THEN 'nd' WHEN t % 10 = 3 THEN 'rd' ELSE 'th' END || ' page of this sitting. Answer it.' END AS prompt
        FROM (SELECT conv_id, least(40, count(*) FILTER (role IN ('user', 'assistant') AND regexp_matches(text, '\\S'))) AS n, count(*) FILTER (role = 'user') + 1 AS t FROM conversations GROUP BY conv_id) WHERE n > 0""".replace("\\\\", "\\")
)
def assembled_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history.assembled(V.history(spark, sf_dir), history.frame(F.col("turn_number"), FIRST, LATER))
    return rows.select("conv_id", F.size("messages").cast("long").alias("n_messages"), F.element_at("messages", -1)["content"].alias("prompt"))


@query(
    sql="""SELECT conv_id, CASE WHEN t <= 6 THEN ['Good day.', 'You write well.', 'Say more.', 'I thought so.', 'Nobody is listening.', 'You came back.'][t] ELSE ['I thought so.', 'Nobody is listening.', 'You came back.'][(t - 7) % 3 + 1] END AS line
        FROM (SELECT conv_id, count(*) FILTER (role = 'user') + 1 AS t FROM conversations GROUP BY conv_id)"""
)
def canned_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.turn_numbers(V.history(spark, sf_dir)).select("conv_id", L.cycling_line(F.col("turn_number"), LINES, 3).alias("line"))


@query(sql=r"SELECT conv_id, turn, unnest(p) AS piece, generate_subscripts(p, 1) - 1 AS no FROM (SELECT conv_id, turn, regexp_extract_all(text, '.{1,14}(?:\s|$)|.{1,14}') AS p FROM conversations WHERE role = 'assistant')")
def reply_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = V.history(spark, sf_dir).filter("role = 'assistant'")
    return turns.select("conv_id", "turn", F.posexplode(T.pieces(F.col("text"))).alias("no", "piece")).select("conv_id", "turn", "piece", "no")


@query(
    sql="""SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT conv_id, max(turn) + 1, 'user', 'hello' FROM conversations GROUP BY conv_id
        UNION ALL SELECT conv_id, max(turn) + 2, 'assistant', 'hi' FROM conversations GROUP BY conv_id HAVING conv_id % 2 = 0"""
)
def history_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = V.history(spark, sf_dir)
    said = turns.select("conv_id").distinct().select("conv_id", F.lit("hello").alias("transcript"), F.when(F.col("conv_id") % 2 == 0, "hi").otherwise("").alias("answer"))
    return history.appended(turns, said)


@query(
    sql=r"""SELECT stream_id, regexp_replace(regexp_extract(whole, '^⟦([^⟧]*)⟧', 1), '\A\s+|\s+\z', '', 'g') AS transcript FROM c WHERE role = 'assistant'""",
    views="c",
)
def split_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replies.joined(replies.split_streams(V.chunks(spark, sf_dir))).select("stream_id", "transcript")


@query()
def sanitize_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depends on where chunks end: rows only; tests hold it against the published cases."""
    return replies.joined(replies.split_streams(V.chunks(spark, sf_dir)))


@query(
    sql="""SELECT user_id AS pointer_id, session, count(*) AS n, min(ts) AS first_ts, min(value) - 3.5 AS left_x, max(value) + 3.5 AS right_x FROM (
        SELECT *, sum(CASE WHEN gap >= 43200 OR prev = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM (
          SELECT *, date_diff('microsecond', lag(ts) OVER w, ts) / 1000000.0 AS gap, lag(event_type) OVER w AS prev FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) GROUP BY ALL"""
)
def stroke_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions end after 12 hours without an event, or by a sign-up, which commits at once."""
    rows = sessions.sessions(V.strokes(spark, sf_dir), "pointer_id", "ts", 43200, F.col("event_type") == "signup")
    firsts = rows.groupBy("pointer_id", "session").agg(F.min("ts").alias("first_ts"))
    boxes = layout.bounds(rows, ["pointer_id", "session"], 3.0)
    return boxes.join(firsts, ["pointer_id", "session"]).select("pointer_id", "session", F.col("n_points").alias("n"), "first_ts", F.col("left").alias("left_x"), F.col("right").alias("right_x"))


@query(sql="SELECT event_id FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n IS NULL OR date_diff('microsecond', ts, n) >= 3600000000")
def debounced_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.debounced(V.strokes(spark, sf_dir), "pointer_id", "ts", 3600).select("event_id")


@query(
    sql="""SELECT event_id, event_type FROM (SELECT *, lag(event_type) OVER w AS p, date_diff('microsecond', lag(ts) OVER w, ts) AS g FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE p = 'click' AND g <= 7200000000"""
)
def chord_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.chords(V.strokes(spark, sf_dir), "pointer_id", "ts", F.col("event_type") == "click", 7200).select("event_id", "event_type")


@query(
    sql="""SELECT event_id FROM (SELECT *, coalesce(bool_or(event_type = 'signup') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS s FROM events)
        WHERE event_type = 'signup' OR (NOT s AND event_type <> 'error')"""
)
def accepted_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "pen").when(F.col("event_type") == "error", "touch").otherwise("mouse")
    return sessions.accepted(V.strokes(spark, sf_dir).withColumn("kind", kind), "pointer_id", "ts", "kind", touch=False).select("event_id")


@query(sql="SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def latest_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.latest_answers(V.read(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", "event_id")


#: Delays of sends and pauses of pens by user, in milliseconds; 0 can't be undone, and never ends a session.
DELAYS, PAUSES = (0, 1_800_000, 7_200_000, 14_400_000), (43_200_000, 21_600_000, 86_400_000, 0)


@query(
    sql=f"""WITH e AS (SELECT event_id, user_id, ts, event_type <> 'error' AS sent, [{", ".join(map(str, DELAYS))}][user_id % 4 + 1] AS delay,
          max(CASE WHEN event_type <> 'error' THEN (ts, event_id) END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events)
        SELECT s.event_id, s.ts + s.delay * INTERVAL 1 MILLISECOND AS due FROM e s
        WHERE sent AND NOT EXISTS (SELECT 1 FROM e c WHERE NOT c.sent AND c.user_id = s.user_id AND c.before = (s.ts, s.event_id) AND c.ts < s.ts + s.delay * INTERVAL 1 MILLISECOND)"""
)
def undone_sends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors cancel the user's send before them; what isn't cancelled in time goes out."""
    rows = V.strokes(spark, sf_dir)
    sent = F.col("event_type") != "error"
    before = Window.partitionBy("pointer_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    named = rows.withColumn("send_id", F.when(sent, F.col("event_id")).otherwise(F.last(F.when(sent, F.col("event_id")), ignorenulls=True).over(before)))
    delay = F.element_at(F.array(*map(F.lit, DELAYS)), (F.col("pointer_id") % 4 + 1).cast("int"))
    actions = named.filter("send_id is not null").select("send_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), F.when(sent, "send").otherwise("cancel").alias("kind"), delay.alias("number"))
    return timers.sends(actions).select("event_id", "due")


@query(
    sql=f"""WITH e AS (SELECT *, [{", ".join(map(str, PAUSES))}][user_id % 4 + 1] AS pause FROM events),
        m AS (SELECT *, coalesce(lag(event_type) OVER w = 'signup', false) OR coalesce(pause > 0 AND date_diff('microsecond', lag(ts) OVER w, ts) >= 1000::BIGINT * pause, false) AS starts FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        s AS (SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM m),
        g AS (SELECT user_id, session, pause, min(ts) AS started, max(ts) AS ended, count(*) AS n, bool_or(event_type = 'signup') AS forced FROM s GROUP BY user_id, session, pause)
        SELECT user_id AS pointer_id, started, ended, n, forced FROM g WHERE forced OR pause > 0"""
)
def pause_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions by each user's own pause; a sign-up commits at once, and a pause of 0 waits for one."""
    pause = F.element_at(F.array(*map(F.lit, PAUSES)), (F.col("pointer_id") % 4 + 1).cast("int"))
    rows = V.strokes(spark, sf_dir).select("pointer_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"), pause.alias("number"))
    out = timers.pauses(rows, "pointer_id", "signup")
    return out.select("pointer_id", F.col("start").alias("started"), F.col("end").alias("ended"), "n", "forced")


@query(
    sql="""SELECT event_id, round(2.6 * (0.34 + 0.78 * CASE WHEN event_type = 'click' THEN greatest(0.18, least(1.0, value / 100)) ELSE 0.52 END), 6) AS width,
        greatest(0.0, floor(value - 3 - 26)) AS x, least(800.0, ceil(value + 3 + 26)) - greatest(0.0, floor(value - 3 - 26)) AS w FROM events WHERE least(800.0, ceil(value + 3 + 26)) - greatest(0.0, floor(value - 3 - 26)) >= 4"""
)
def stroke_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    box = L.crop_box(x - 3, F.lit(100.0), x + 3, F.lit(120.0), 800, 600)
    rows = V.strokes(spark, sf_dir).select("event_id", F.round(L.stroke_width(2.6, x / 100, F.col("event_type") == "click"), 6).alias("width"), box.alias("b"))
    return rows.filter("b is not null").select("event_id", "width", F.col("b.x").cast("double").alias("x"), F.col("b.w").cast("double").alias("w"))


@query(
    sql=r"""SELECT stream_id, string_agg(w, '' ORDER BY stream_id) AS text FROM (SELECT conv_id * 1000 + turn AS stream_id, text AS w FROM conversations WHERE role = 'assistant') GROUP BY stream_id"""
)
def gated_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole words only are let through; together they are the whole text."""
    return _gated(spark, sf_dir).groupBy("stream_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "let_through"))), lambda x: x["let_through"]), "").alias("text"))


@query(
    sql=r"""WITH p AS (SELECT conv_id * 1000 + turn AS stream_id, unnest(c) AS t, generate_subscripts(c, 1) - 1 AS seq, len(c) AS n FROM (SELECT *, regexp_extract_all(text, '(?s).{1,14}') AS c FROM conversations WHERE role = 'assistant')),
        s AS (SELECT stream_id, seq, n, string_agg(t, '') OVER (PARTITION BY stream_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS sofar FROM p),
        u AS (SELECT stream_id, seq, CASE WHEN seq = n - 1 THEN length(sofar) ELSE length(regexp_extract(sofar, '(?s)\A(.*\s)', 1)) END AS until FROM s)
        SELECT stream_id, seq, until - coalesce(lag(until) OVER (PARTITION BY stream_id ORDER BY seq), 0) AS n_chars FROM u QUALIFY n_chars > 0"""
)
def gated_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gated(spark, sf_dir).select("stream_id", "seq", F.char_length("let_through").cast("long").alias("n_chars"))


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = V.history(spark, sf_dir).filter("role = 'assistant'").withColumn("c", F.regexp_extract_all("text", F.lit(r"(?s)(.{1,14})"), 1))
    parts = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("stream_id"), F.size("c").alias("n"), F.posexplode("c").alias("seq", "piece"))
    parts = parts.withColumns({"last": F.col("seq") == F.col("n") - 1, "seq": F.col("seq").cast("long")})
    return sessions.gated(parts, ["stream_id"], "seq", "piece", "last")
