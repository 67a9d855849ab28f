"""Queries over time-stamped captions and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.clock import clock_seconds, day_label, day_number, running_seconds
from tidemark.operators import slices
from tidemark.operators import temporal as T
from tidemark.registry import Registry
from tidemark.runtime import table

registry = Registry()


def _seconds(c: str) -> str:
    t = f"lpad({c}, 8, '0')"
    h, m, s = (f"CAST({t}[{a}:{a + 1}] AS BIGINT)" for a in (1, 3, 5))
    return f"CASE WHEN regexp_full_match({c}, '[0-9]{{1,8}}') THEN CASE WHEN {h} < 24 AND {m} < 60 AND {s} < 60 THEN {h} * 3600 + {m} * 60 + {s} END END"


_DAY = "CASE WHEN regexp_full_match(date, '(?i)day[0-9]+') THEN TRY_CAST(substr(date, 4) AS BIGINT) END"
#: Usable captions in SQL: caps(id, subject, granularity, day, start_s, start_ts, end_ts, text, video_path).
CAPS = f"""
c0 AS (SELECT DISTINCT caption_id, subject, granularity, text, video_path, {_DAY} AS day, {_seconds('start_time')} AS a, {_seconds('end_time')} AS b FROM captions_a),
caps AS (SELECT caption_id AS id, subject, granularity, day, a AS start_s, (day - 1) * 86400 + a AS start_ts, (day - 1) * 86400 + b AS end_ts, text, video_path FROM c0 WHERE subject IS NOT NULL AND day IS NOT NULL AND a < b)
"""


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable captions, each once, with running seconds."""
    c = table(spark, sf_dir, "captions_a")
    day, a, b = day_number(F.col("date")), clock_seconds(F.col("start_time")), clock_seconds(F.col("end_time"))
    rows = c.select(F.col("caption_id").alias("id"), "subject", "granularity", day.cast("long").alias("day"), a.cast("long").alias("start_s"), running_seconds(day, a).alias("start_ts"), running_seconds(day, b).alias("end_ts"), "text", "video_path")
    return rows.where("subject IS NOT NULL AND start_ts < end_ts").distinct()


@registry.add("caption_rows", f"WITH {CAPS} SELECT id, subject, granularity, granularity || '_' || CAST(row_number() OVER (PARTITION BY subject, granularity ORDER BY start_ts, id) - 1 AS VARCHAR) AS entry, CAST(start_ts AS BIGINT) AS start_ts, CAST(end_ts AS BIGINT) AS end_ts, 'DAY' || CAST(day AS VARCHAR) || ' ' || lpad(CAST(start_s // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(start_s // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(start_s % 60 AS VARCHAR), 2, '0') AS label FROM caps")
def caption_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions shaped into rows with an entry name and a display label."""
    rows = slices.numbered(captions(spark, sf_dir), ["subject", "granularity"], ["start_ts", "id"], T.DAY)
    return rows.select("id", "subject", "granularity", F.expr("concat(granularity, '_', rn - 1)").alias("entry"), "start_ts", "end_ts", day_label(F.col("start_ts")).alias("label"))


@registry.add("temporal_next_edges", f"WITH {CAPS}, n AS (SELECT id AS a, lead(id) OVER w AS b, lead(start_ts) OVER w - end_ts AS gap FROM caps WINDOW w AS (PARTITION BY subject, granularity ORDER BY start_ts, id)), k AS (SELECT a, b, 1.0::DOUBLE / (gap + 1) AS weight FROM n WHERE b IS NOT NULL AND gap BETWEEN 0 AND 21600) SELECT a AS src, b AS dst, round(weight, 9) AS weight FROM k UNION ALL SELECT b, a, round(weight, 9) FROM k")
def temporal_next_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1."""
    return T.temporal_next_edges(captions(spark, sf_dir)).selectExpr("src", "dst", "round(weight, 9) AS weight")


@registry.add("contains_edges", f"WITH {CAPS}, l(g, f, weight) AS (VALUES ('3min', '30sec', 1.0::DOUBLE), ('10min', '3min', 1.0), ('1h', '10min', 1.0), ('1h', '30sec', 0.5)) SELECT c.id AS src, f.id AS dst, l.weight FROM caps c JOIN l ON l.g = c.granularity JOIN caps f ON f.granularity = l.f AND f.subject = c.subject AND c.start_ts <= f.start_ts AND f.end_ts <= c.end_ts")
def contains_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1."""
    return T.contains_edges(captions(spark, sf_dir))


_CLIPS = "clips AS (SELECT video_path || ':' || CAST(start_s AS VARCHAR) AS id, subject, start_ts, end_ts FROM (SELECT DISTINCT video_path, start_s, subject, start_ts, end_ts FROM caps WHERE granularity = '30sec' AND video_path IS NOT NULL))"


def clips(caps: DataFrame) -> DataFrame:
    return caps.where("granularity = '30sec' AND video_path IS NOT NULL").selectExpr("concat(video_path, ':', start_s) AS id", "subject", "start_ts", "end_ts").distinct()


@registry.add("co_clip_edges", f"WITH {CAPS}, {_CLIPS}, p AS (SELECT k.id AS c, CAST(e.id AS VARCHAR) AS e FROM clips k JOIN caps e ON e.granularity = '30sec' AND k.subject = e.subject AND k.start_ts = e.start_ts AND k.end_ts = e.end_ts) SELECT c AS src, e AS dst, 1.0::DOUBLE AS weight FROM p UNION ALL SELECT e, c, 1.0 FROM p")
def co_clip_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2."""
    caps = captions(spark, sf_dir)
    return T.co_clip_edges(caps.withColumn("id", F.col("id").cast("string")), clips(caps)).selectExpr("src", "dst", "1D AS weight")


#: Questions as moments in SQL: moments(id, subject, t).
MOMENTS = f"q0 AS (SELECT DISTINCT id, subject, query_time.date AS date, query_time.time AS tm FROM qa_mcq), moments AS (SELECT id, subject, ({_DAY} - 1) * 86400 + {_seconds('tm')} AS t FROM q0), q AS (SELECT * FROM moments WHERE t IS NOT NULL)"


def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "qa_mcq")
    return q.select("id", "subject", running_seconds(day_number(F.col("query_time.date")), clock_seconds(F.col("query_time.time"))).alias("t")).where("t IS NOT NULL").distinct()


@registry.add("asof_visible", f"WITH {CAPS}, {MOMENTS}, per AS (SELECT q.id, c.granularity, count(*) AS n, max(c.end_ts) AS last_end FROM q JOIN caps c ON c.subject = q.subject AND c.end_ts <= q.t GROUP BY q.id, c.granularity) SELECT id, granularity, CAST(n AS BIGINT) AS visible, CAST(last_end AS BIGINT) AS last_end FROM per")
def asof_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many captions of each granularity a question may see, and the last of them.

    Captions and questions are merged into one sorted run per subject and granularity, so that no question is paired
    with all captions before it.
    """
    caps = captions(spark, sf_dir)
    grans = caps.select("subject", "granularity").distinct()
    q = moments(spark, sf_dir).join(grans, "subject").selectExpr("subject", "granularity", "t", "id AS question")
    runs = caps.selectExpr("subject", "granularity", "end_ts AS t", "CAST(NULL AS string) AS question").unionByName(q)
    seen = slices.seen_so_far(runs.withColumn("v", F.expr("CASE WHEN question IS NULL THEN t END")), ["subject", "granularity"], "t", "t DIV 86400", "v")
    return seen.where("question IS NOT NULL AND n > 0").selectExpr("question AS id", "granularity", "n AS visible", "top AS last_end")


_SPANS = "spans AS (SELECT id AS span, subject, t - 60 AS s, t + 60 AS e FROM q)"


@registry.add("overlap_scan", f"WITH {CAPS}, {MOMENTS}, {_SPANS} SELECT span, c.id, CAST(greatest(start_ts, s) AS BIGINT) AS from_ts, CAST(least(end_ts, e) AS BIGINT) AS to_ts FROM spans JOIN caps c ON c.subject = spans.subject AND c.start_ts < e AND c.end_ts > s WHERE granularity IN ('30sec', '3min') AND trim(text) <> ''")
def overlap_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions with text that overlap the two minutes around a question."""
    spans = moments(spark, sf_dir).selectExpr("id AS span", "subject", "t - 60 AS s", "t + 60 AS e")
    return T.overlapping(captions(spark, sf_dir).where("granularity IN ('30sec', '3min') AND trim(text) <> ''"), spans, False).select("span", "id", "from_ts", "to_ts")


@registry.add("clip_overlap", f"WITH {CAPS}, {MOMENTS}, {_CLIPS}, {_SPANS} SELECT span, c.id, CAST(greatest(start_ts, s) AS BIGINT) AS from_ts, CAST(least(end_ts, e) AS BIGINT) AS to_ts FROM spans JOIN clips c ON c.subject = spans.subject AND c.start_ts <= e AND c.end_ts >= s")
def clip_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips that meet the two minutes around a question, ends included, with the offsets to read."""
    spans = moments(spark, sf_dir).selectExpr("id AS span", "subject", "t - 60 AS s", "t + 60 AS e")
    return T.overlapping(clips(captions(spark, sf_dir)), spans, True).select("span", "id", "from_ts", "to_ts")


@registry.add("segment_lookup", f"WITH {CAPS}, {MOMENTS}, h AS (SELECT q.id, min(struct_pack(a := c.start_ts, i := c.id, b := c.end_ts)) AS x FROM q JOIN caps c ON c.granularity = '30sec' AND c.subject = q.subject AND q.t BETWEEN c.start_ts AND c.end_ts GROUP BY q.id) SELECT q.id, CAST(coalesce(x.a, 0) AS BIGINT) AS start_ts, CAST(coalesce(x.b, 0) AS BIGINT) AS end_ts FROM (SELECT DISTINCT id FROM q) q LEFT JOIN h ON h.id = q.id")
def segment_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 30-second segment that holds the moment of a question, else (0, 0)."""
    found = T.first_containing(captions(spark, sf_dir).where("granularity = '30sec'"), moments(spark, sf_dir).withColumnRenamed("id", "moment"))
    return found.withColumnRenamed("moment", "id")


@registry.add("nearest_caption", f"WITH {CAPS}, {MOMENTS}, d AS (SELECT q.id, q.t, c.start_ts, c.id AS caption_id FROM q JOIN caps c ON c.granularity = '30sec' AND c.subject = q.subject AND c.day = q.t // 86400 + 1 WHERE abs(c.start_ts - q.t) <= 3600) SELECT id AS stamp, arg_min(caption_id, struct_pack(a := abs(start_ts - t), b := -start_ts, c := caption_id)) AS caption_id FROM d GROUP BY id")
def nearest_caption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The caption of the same day that starts nearest, the later one of two equally near."""
    caps = captions(spark, sf_dir).where("granularity = '30sec'").selectExpr("subject", "day", "start_s", "id AS caption_id")
    stamps = moments(spark, sf_dir).selectExpr("subject", "t DIV 86400 + 1 AS day", "t % 86400 AS t", "id AS stamp")
    return T.nearest_start(caps, stamps, 3600)


@registry.add("uncovered_moments", f"WITH {CAPS}, {MOMENTS} SELECT id AS fact FROM q WHERE NOT EXISTS (SELECT 1 FROM caps c WHERE c.granularity = '3min' AND c.subject = q.subject AND abs(c.start_ts - q.t) <= 60)")
def uncovered_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that lie within a minute of no 3-minute caption."""
    return T.uncovered(moments(spark, sf_dir).withColumnRenamed("id", "fact"), captions(spark, sf_dir).where("granularity = '3min'").selectExpr("subject", "start_ts AS c")).select("fact")


@registry.add("fixed_rollup", f"WITH {CAPS}, r AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY start_ts, id) AS rn FROM caps WHERE granularity = '30sec') SELECT subject, CAST((rn - 1) // 6 AS BIGINT) AS grp, CAST(arg_min(start_ts, rn) AS BIGINT) AS start_ts, CAST(arg_max(end_ts, rn) AS BIGINT) AS end_ts, arg_min_null(video_path, rn) AS video_path, coalesce(string_agg(CASE WHEN trim(text) <> '' THEN text END, ' ' ORDER BY rn), '') AS text, count(*) AS n_rows FROM r GROUP BY subject, (rn - 1) // 6")
def fixed_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every six 30-second captions of a subject as one."""
    return T.fixed_rollup(captions(spark, sf_dir).where("granularity = '30sec'"), ["subject"], ["start_ts", "id"], 6)


@registry.add("speech_bins", f"WITH {CAPS}, b AS (SELECT *, least(CAST(floor((start_s + start_s + end_ts - start_ts) / 2 / 1800) AS BIGINT), 40) AS bin FROM caps WHERE granularity = '3min' AND text IS NOT NULL) SELECT subject, day, bin, string_agg(text, ' ' ORDER BY start_s, id) AS text, count(*) AS n_rows FROM b GROUP BY subject, day, bin HAVING trim(string_agg(text, ' ' ORDER BY start_s, id)) <> ''")
def speech_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments joined by the half hour of their middle."""
    rows = captions(spark, sf_dir).where("granularity = '3min' AND text IS NOT NULL").selectExpr("subject", "day", "id", "text", "start_s AS start_ts", "start_s + end_ts - start_ts AS end_ts")
    return T.bins(rows, ["subject", "day"], 1800, 40)


_ANCHOR = """WITH RECURSIVE {caps}, r AS (SELECT subject, day, id, start_s AS s, start_s + end_ts - start_ts AS e, row_number() OVER (PARTITION BY subject, day ORDER BY start_s, start_s + end_ts - start_ts) AS rn FROM caps WHERE granularity = '30sec'),
w AS (SELECT subject, day, s, e, rn, s AS anchor, CAST(0 AS BIGINT) AS win FROM r WHERE rn = 1 UNION ALL
  SELECT r.subject, r.day, r.s, r.e, r.rn, CASE WHEN r.s >= w.anchor + {length} THEN {anchor} ELSE w.anchor END, CASE WHEN r.s >= w.anchor + {length} THEN w.win + 1 ELSE w.win END FROM w JOIN r ON r.subject = w.subject AND r.day = w.day AND r.rn = w.rn + 1)
SELECT subject, day, win, min(s) AS first_start, max(e) AS last_end, count(*) AS n_rows FROM w GROUP BY subject, day, win"""


@registry.add("anchor_windows_10min", _ANCHOR.format(caps=CAPS, length=600, anchor="r.s"))
def anchor_windows_10min(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W6."""
    rows = captions(spark, sf_dir).where("granularity = '30sec'").selectExpr("subject", "day", "start_s AS s", "start_s + end_ts - start_ts AS e")
    return T.anchor_windows(rows, ["subject", "day"], "s", "e", 600)


@registry.add("anchor_windows_3min", _ANCHOR.format(caps=CAPS, length=180, anchor="r.s // 180 * 180"))
def anchor_windows_3min(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W5."""
    rows = captions(spark, sf_dir).where("granularity = '30sec'").selectExpr("subject", "day", "start_s AS s", "start_s + end_ts - start_ts AS e")
    return T.anchor_windows(rows, ["subject", "day"], "s", "e", 180, 180)


@registry.add("uniform_sample", f"WITH {CAPS}, r AS (SELECT subject, id, row_number() OVER (PARTITION BY subject ORDER BY start_ts, id) - 1 AS rn, count(*) OVER (PARTITION BY subject) AS n FROM caps WHERE granularity = '30sec'), k AS (SELECT subject, n, i * (n - 1) // 15 AS rn FROM (SELECT DISTINCT subject, n FROM r), range(16) t(i)) SELECT DISTINCT r.subject, r.id, CAST(r.rn AS BIGINT) AS rn FROM r LEFT JOIN k ON k.subject = r.subject AND k.rn = r.rn WHERE r.n <= 16 OR k.rn IS NOT NULL")
def uniform_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen captions of each subject at equal steps."""
    return T.uniform_sample(captions(spark, sf_dir).where("granularity = '30sec'"), ["subject"], ["start_ts", "id"], 16).selectExpr("subject", "id", "CAST(rn AS bigint) AS rn")


@registry.add("char_budget", f"WITH {CAPS}, r AS (SELECT subject, id, sum(length(text) + 1) OVER (PARTITION BY subject ORDER BY start_ts, id ROWS UNBOUNDED PRECEDING) AS cum FROM caps WHERE granularity = '3min' AND text IS NOT NULL) SELECT subject, id, CAST(cum AS BIGINT) AS cum FROM r WHERE cum <= 3200")
def char_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W9."""
    return T.char_budget(captions(spark, sf_dir).where("granularity = '3min' AND text IS NOT NULL"), ["subject"], ["start_ts", "id"], "text", 3200).select("subject", "id", "cum")


@registry.add("frame_budget", f"WITH {CAPS}, r AS (SELECT subject, id, start_ts, least((end_ts - start_ts) // 10, 16) AS f FROM caps WHERE granularity = '3min'), p AS (SELECT *, coalesce(sum(f) OVER (PARTITION BY subject ORDER BY start_ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM r) SELECT subject, id, CAST(greatest(0, least(f, 64 - used)) AS BIGINT) AS allotted FROM p")
def frame_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of each clip, one in ten seconds, under the budget of a subject."""
    rows = captions(spark, sf_dir).where("granularity = '3min'").selectExpr("subject", "id", "start_ts", "(end_ts - start_ts) DIV 10 AS frames")
    return T.frame_budget(rows, ["subject"], ["start_ts", "id"], "frames").select("subject", "id", "allotted")


@registry.add("latest_episodes", f"WITH {CAPS}, r AS (SELECT subject, granularity, id, end_ts, row_number() OVER (PARTITION BY subject, granularity ORDER BY end_ts DESC, id) AS k FROM caps), s AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY end_ts DESC, id) AS rank FROM r WHERE k <= CASE granularity WHEN '30sec' THEN 8 WHEN '3min' THEN 4 WHEN '10min' THEN 3 WHEN '1h' THEN 0 ELSE 16 END) SELECT subject, granularity, id, CAST(rank AS INTEGER) AS rank FROM s WHERE rank <= 16")
def latest_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest sixteen episodes of each subject within the quota of their granularity."""
    scored = captions(spark, sf_dir).selectExpr("subject", "granularity", "id", "end_ts AS score")
    return T.quota_rank(scored, ["subject"], "granularity", T.QUOTAS, 16).select("subject", "granularity", "id", "rank")


@registry.add("video_segments", f"WITH {CAPS}, s AS (SELECT DISTINCT subject, day, start_s FROM caps WHERE granularity = '10min'), n AS (SELECT *, lead(start_s) OVER (PARTITION BY subject, day ORDER BY start_s) AS until_s FROM s) SELECT * FROM n WHERE until_s IS NOT NULL")
def video_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive starts of a day as segments; the last one has no end and is left out."""
    starts = captions(spark, sf_dir).where("granularity = '10min'").select("subject", "day", "start_s").distinct()
    return starts.selectExpr("*", "lead(start_s) OVER (PARTITION BY subject, day ORDER BY start_s) AS until_s").where("until_s IS NOT NULL")


@registry.add("neighbour_captions", f"WITH {CAPS}, r AS (SELECT subject, id, row_number() OVER (PARTITION BY subject ORDER BY start_ts, id) - 1 AS i FROM caps WHERE granularity = '10min') SELECT a.id AS centre, b.id AS neighbour FROM r a JOIN r b ON a.subject = b.subject AND b.i BETWEEN greatest(0, a.i - 2) AND a.i + 2")
def neighbour_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each caption with the two before and after it."""
    r = captions(spark, sf_dir).where("granularity = '10min'")
    r = slices.numbered(r, ["subject"], ["start_ts", "id"], T.DAY).selectExpr("subject", "id", "rn - 1 AS i")
    around = r.selectExpr("subject", "id AS centre", "explode(sequence(greatest(0, i - 2), i + 2)) AS i")
    return around.join(r.withColumnRenamed("id", "neighbour"), ["subject", "i"]).select("centre", "neighbour")


@registry.add("day_tail", f"WITH {CAPS}, {MOMENTS}, d AS (SELECT q.id, q.t, c.id AS caption, c.day, c.end_ts FROM q JOIN caps c ON c.granularity = '1h' AND c.subject = q.subject AND (c.day < q.t // 86400 + 1 OR (c.day = q.t // 86400 + 1 AND c.end_ts <= q.t))) SELECT id, count(*) AS events, CAST(max(end_ts) AS BIGINT) AS tail_from, CAST(any_value(t) AS BIGINT) AS tail_to FROM d GROUP BY id")
def day_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hourly diary entries that a question may see, and the stretch after the last of them."""
    caps = captions(spark, sf_dir).where("granularity = '1h'").selectExpr("subject", "CASE WHEN end_ts DIV 86400 + 1 > day THEN day * 86400 ELSE end_ts END AS t", "CAST(NULL AS string) AS id", "end_ts")
    q = moments(spark, sf_dir).selectExpr("subject", "t", "id", "CAST(NULL AS bigint) AS end_ts")
    seen = slices.seen_so_far(caps.unionByName(q), ["subject"], "t", "t DIV 86400", "end_ts")
    return seen.where("id IS NOT NULL AND n > 0").selectExpr("id", "n AS events", "top AS tail_from", "t AS tail_to")


@registry.add("event_tumbling", "SELECT event_type, date_trunc('hour', ts) AS window_start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly windows of events."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).selectExpr("event_type", "w.start AS window_start", "n", "total")


@registry.add("event_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user, cut by gaps of six hours."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n")).selectExpr("user_id", "w.start AS session_start", "n")
