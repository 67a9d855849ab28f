"""Queries over what comes in: clocks, ranges and ids in texts, responses, stored collections and written graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import clock as K
from tidemark.functions import responses as RS
from tidemark.functions import text as X
from tidemark.operators import temporal as T
from tidemark.plans.graph import RECS, records
from tidemark.plans.hybrid import _GRAPH, parts
from tidemark.plans.temporal import CAPS, MOMENTS, captions, moments
from tidemark.registry import Registry
from tidemark.runtime import cut, folder, table
from tidemark.sources import records as RD
from tidemark.sources import store as S

registry = Registry()

_D = "lpad({c}, 8, '0')"
_SEC = "(CAST(lpad({c}, 8, '0')[1:2] AS BIGINT) * 3600 + CAST(lpad({c}, 8, '0')[3:4] AS BIGINT) * 60 + CAST(lpad({c}, 8, '0')[5:6] AS BIGINT))"
_TWO = "lpad(CAST({x} AS VARCHAR), 2, '0')"


@registry.add("clock_forms", f"WITH c AS (SELECT DISTINCT caption_id, start_time AS a, end_time AS b FROM captions_a WHERE regexp_full_match(start_time, '[0-9]{{1,8}}') AND regexp_full_match(end_time, '[0-9]{{1,8}}') AND lpad(start_time, 8, '0') < '24' AND lpad(start_time, 8, '0')[3:4] < '60' AND lpad(start_time, 8, '0')[5:6] < '60'), s AS (SELECT *, {_SEC.format(c='a')} AS sa, {_SEC.format(c='b')} AS sb FROM c) SELECT caption_id, sa AS seconds, {_TWO.format(x='sa // 3600')} || {_TWO.format(x='sa // 60 % 60')} || {_TWO.format(x='sa % 60')} || '00' AS digits, sa * 20 + CAST(lpad(a, 8, '0')[7:8] AS BIGINT) AS frame, {_TWO.format(x='sa // 3600')} || ':' || {_TWO.format(x='sa // 60 % 60')} || ':' || {_TWO.format(x='sa % 60')} AS hms, sb - sa AS apart, sa // 60 * 60 AS minute_s FROM s")
def clock_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of captions as seconds, digits, frames and text, how far start and end lie apart, and back."""
    c = table(spark, sf_dir, "captions_a").where("start_time RLIKE '^[0-9]{1,8}$' AND end_time RLIKE '^[0-9]{1,8}$'").where(K.clock_seconds(F.col("start_time")).isNotNull()).selectExpr("caption_id", "start_time AS a", "end_time AS b").distinct()
    s = c.selectExpr("caption_id", "a", f"{K.digits_seconds_sql('a')} AS seconds", f"{K.digits_seconds_sql('b')} AS until_s")
    made = s.selectExpr("*", f"{K.seconds_digits_sql('seconds')} AS digits", f"{K.frame_sql('a')} AS frame").withColumn("hms", K.hms(F.col("seconds")))
    return made.selectExpr("caption_id", "seconds", "digits", "frame", "hms", "until_s - seconds AS apart", f"{K.clock_text_sql('substr(hms, 1, 5)')} AS minute_s")


_LABEL = "'DAY' || CAST(t // 86400 + 1 AS VARCHAR) || ' ' || lpad(CAST(t % 86400 // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(t // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(t % 60 AS VARCHAR), 2, '0')"


@registry.add("time_range_queries", f"WITH {MOMENTS}, r AS (SELECT id, t, 'Show me ' || {_LABEL} || ' - day ' || CAST((t + 600) // 86400 + 1 AS VARCHAR) || ' ' || CAST((t + 600) % 86400 // 3600 AS VARCHAR) || ':' || lpad(CAST((t + 600) // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST((t + 600) % 60 AS VARCHAR), 2, '0') AS text FROM q UNION ALL SELECT id || '~', t, 'What happened at ' || {_LABEL} || '?' FROM q) SELECT id, NOT id LIKE '%~' AS is_range, CASE WHEN NOT id LIKE '%~' THEN CAST(t // 86400 + 1 AS BIGINT) * 100000000 + CAST(t % 86400 // 3600 * 1000000 + t // 60 % 60 * 10000 + t % 60 * 100 AS BIGINT) END AS from_stamp, CASE WHEN NOT id LIKE '%~' THEN CAST((t + 600) // 86400 + 1 AS BIGINT) * 100000000 + CAST((t + 600) % 86400 // 3600 * 1000000 + (t + 600) // 60 % 60 * 10000 + (t + 600) % 60 * 100 AS BIGINT) END AS to_stamp FROM r")
def time_range_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """which texts ask for a range of time, and its ends; a text with one moment has none."""
    m = moments(spark, sf_dir).select("id", "t")
    label = lambda t: K.day_label(t)
    later = F.col("t") + 600
    range_ = m.select("id", F.concat(F.lit("Show me "), label(F.col("t")), F.lit(" - day "), (F.floor(later / 86400) + 1).cast("string"), F.lit(" "), F.regexp_replace(F.substring_index(label(later), " ", -1), "^0", "")).alias("text"))
    single = m.select(F.concat("id", F.lit("~")).alias("id"), F.concat(F.lit("What happened at "), label(F.col("t")), F.lit("?")).alias("text"))
    return range_.unionByName(single).selectExpr("id", f"{K.is_time_range_sql('text')} AS is_range", f"{K.time_range_sql('text')} AS r").selectExpr("id", "is_range", "r[0] AS from_stamp", "r[1] AS to_stamp")


_RANGES = [("a", "70-78,100"), ("b", "3"), ("c", "10-12, 15 ,20-21"), ("d", "5-5")]


@registry.add("id_ranges", "WITH r AS (SELECT * FROM (VALUES ('a', '70-78,100'), ('b', '3'), ('c', '10-12, 15 ,20-21'), ('d', '5-5')) v(name, text)), p AS (SELECT name, trim(unnest(string_split(text, ',')), ' ') AS x FROM r) SELECT name, CAST(unnest(range(CAST(string_split(x, '-')[1] AS BIGINT), CAST(string_split(x, '-')[-1] AS BIGINT) + 1)) AS BIGINT) AS id FROM p")
def id_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that lists of ranges stand for."""
    return spark.createDataFrame(_RANGES, "name string, text string").selectExpr("name", "explode(split(text, ',')) AS x").selectExpr("name", "explode(sequence(CAST(trim(split(x, '-')[0]) AS bigint), CAST(trim(element_at(split(x, '-'), -1)) AS bigint))) AS id")


_TT = "tt AS (SELECT DISTINCT id, subject, target_time.date AS date, target_time.time AS tm, target_time.time_list AS list FROM qa_mcq), ds AS (SELECT *, CASE WHEN regexp_full_match(date, '(?i)day[0-9]+') THEN TRY_CAST(substr(date, 4) AS BIGINT) END AS day FROM tt)"


@registry.add("target_spans", f"WITH {CAPS}, {_TT}, rng AS (SELECT id, (day - 1) * 86400 + {_SEC.format(c='regexp_extract(tm, $$^([0-9]{1,8})DAY([0-9]+)_([0-9]{1,8})$$, 1)')} AS start_ts, (CAST(regexp_extract(tm, '^([0-9]{{1,8}})DAY([0-9]+)_([0-9]{{1,8}})$', 2) AS BIGINT) - 1) * 86400 + {_SEC.format(c='regexp_extract(tm, $$^([0-9]{1,8})DAY([0-9]+)_([0-9]{1,8})$$, 3)')} AS end_ts FROM ds WHERE regexp_full_match(tm, '[0-9]{{1,8}}DAY[0-9]+_[0-9]{{1,8}}') AND day IS NOT NULL), pts AS (SELECT id, subject, day, unnest(CASE WHEN tm IS NOT NULL AND tm <> '' THEN [tm] ELSE list END) AS x FROM ds WHERE day IS NOT NULL), pt AS (SELECT DISTINCT id, subject, (day - 1) * 86400 + {_SEC.format(c='x')} AS t FROM pts WHERE regexp_full_match(x, '[0-9]{{1,8}}')), h AS (SELECT pt.id, pt.t, min(struct_pack(a := c.start_ts, i := c.id, b := c.end_ts)) AS x FROM pt JOIN caps c ON c.granularity = '30sec' AND c.subject = pt.subject AND pt.t BETWEEN c.start_ts AND c.end_ts GROUP BY ALL) SELECT id, 'range' AS kind, CAST(start_ts AS BIGINT) AS start_ts, CAST(end_ts AS BIGINT) AS end_ts FROM rng UNION SELECT id, 'segment', CAST(x.a AS BIGINT), CAST(x.b AS BIGINT) FROM h".replace("$$^", "'^").replace("$$,", "$',"))
def target_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target times as spans: a range over days as it stands, a time or a list of them by the segments that hold them."""
    q = table(spark, sf_dir, "qa_mcq").selectExpr("id", "subject", "target_time.date AS date", "target_time.time AS tm", "target_time.time_list AS list").distinct()
    q = q.withColumn("day", K.day_number(F.col("date")).cast("long")).where("day IS NOT NULL")
    part = lambda k: f"regexp_extract(tm, '^([0-9]{{1,8}})DAY([0-9]+)_([0-9]{{1,8}})$', {k})"
    ranges = q.where("tm RLIKE '^[0-9]{1,8}DAY[0-9]+_[0-9]{1,8}$'").selectExpr("id", "'range' AS kind", f"(day - 1) * 86400 + {K.digits_seconds_sql(part(1))} AS start_ts", f"(CAST({part(2)} AS bigint) - 1) * 86400 + {K.digits_seconds_sql(part(3))} AS end_ts")
    points = q.selectExpr("id", "subject", "day", "explode(CASE WHEN tm <> '' THEN array(tm) ELSE list END) AS x").where("x RLIKE '^[0-9]{1,8}$'").selectExpr("id", "subject", f"(day - 1) * 86400 + {K.digits_seconds_sql('x')} AS t").distinct()
    held = T.first_containing(captions(spark, sf_dir).where("granularity = '30sec'"), points.selectExpr("struct(id, t) AS moment", "subject", "t")).where("end_ts > 0")
    return ranges.unionByName(held.selectExpr("moment.id AS id", "'segment' AS kind", "start_ts", "end_ts")).distinct()


@registry.add("path_parts", "SELECT DISTINCT video_path, regexp_extract(video_path, '(DAY[0-9]+)', 1) AS day, regexp_extract(video_path, '([0-9]{4,8})[.]mp4$', 1) AS time, regexp_extract(video_path, '/(S[0-9]+_[^/]+)/', 1) AS subject FROM captions_a WHERE regexp_matches(video_path, 'DAY[0-9]+') AND regexp_matches(video_path, '[0-9]{4,8}[.]mp4$')")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day, time and subject that a file's path names."""
    c = table(spark, sf_dir, "captions_a").where("video_path RLIKE 'DAY[0-9]+' AND video_path RLIKE '[0-9]{4,8}[.]mp4$'")
    return c.selectExpr("video_path", "regexp_extract(video_path, '(DAY[0-9]+)', 1) AS day", "regexp_extract(video_path, '([0-9]{4,8})[.]mp4$', 1) AS time", "regexp_extract(video_path, '/(S[0-9]+_[^/]+)/', 1) AS subject").distinct()


@registry.add("model_replies", "WITH a AS (SELECT DISTINCT pair_id, answer, pair_id % 4 AS k FROM qa_results WHERE answer IS NOT NULL), r AS (SELECT pair_id, k, answer, CASE k WHEN 1 THEN 'search' ELSE 'answer' END AS decision FROM a) SELECT pair_id, decision, md5(CASE k WHEN 0 THEN 'I can provide evidence. Evidence: ' || replace(answer, chr(10), ' ') WHEN 1 THEN 'x' ELSE replace(answer, chr(10), ' ') END) AS content, k = 0 AND trim(replace(answer, chr(10), ' '), ' ') <> '' AS status, md5(CASE WHEN k = 0 AND trim(replace(answer, chr(10), ' '), ' ') <> '' THEN trim(replace(answer, chr(10), ' '), ' ') END) AS information FROM r")
def model_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions and evidence of replies; every fourth is a JSON object within text, every fourth offers evidence."""
    a = table(spark, sf_dir, "qa_results").where("answer IS NOT NULL").selectExpr("pair_id", "replace(answer, chr(10), ' ') AS answer").distinct()
    said = a.selectExpr("pair_id", "CASE pair_id % 4 WHEN 0 THEN concat('I can provide evidence. Evidence: ', answer) WHEN 1 THEN 'So: {\"decision\": \"search\", \"content\": \"x\"}' ELSE answer END AS reply")
    made = said.selectExpr("pair_id", f"{RS.decision('reply')} AS d", f"{RS.evidence('reply')} AS e")
    return made.selectExpr("pair_id", "d.decision AS decision", "md5(d.content) AS content", "e.status AS status", "md5(e.information) AS information")


@registry.add("chosen_entities", f"WITH {RECS}, x AS (SELECT resp_id, es FROM recs WHERE len(es) > 1 AND list_bool_and(list_transform(es, lambda e: e IS NOT NULL AND NOT regexp_matches(e, '[\\[\\]\"\\\\\\\\]|[^ -~]')))), t AS (SELECT resp_id, list_distinct(es) AS valid, CASE WHEN resp_id % 2 = 0 THEN [es[2], 'zzz'] END AS listed, 'Take ' || es[1] AS told FROM x) SELECT resp_id, array_to_string(list_sort(CASE WHEN resp_id % 2 = 0 THEN [listed[1]] ELSE list_filter(valid, lambda v: contains(told, v)) END), '|') AS chosen FROM t")
def chosen_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that a reply names, from a JSON list or from its text."""
    x = records(spark, sf_dir).where("size(entities) > 1 AND forall(entities, e -> e IS NOT NULL AND NOT e RLIKE '[\\\\[\\\\]\"\\\\\\\\]|[^ -~]')").selectExpr("resp_id", "array_distinct(entities) AS valid", "CASE WHEN resp_id % 2 = 0 THEN concat('I pick ', to_json(array(entities[1], 'zzz')), '.') ELSE concat('Take ', entities[0]) END AS reply")
    return x.selectExpr("resp_id", f"array_join(array_sort({RS.chosen_ids('reply', 'valid')}), '|') AS chosen")


@registry.add("merged_captions", f"WITH {CAPS}, c AS (SELECT f.id, f.text AS seen, arg_min_null(t.text, t.id) AS said FROM caps f LEFT JOIN caps t ON t.granularity = '3min' AND t.subject = f.subject AND t.start_ts <= f.start_ts AND f.end_ts <= t.end_ts AND f.id % 3 > 0 WHERE f.granularity = '30sec' GROUP BY f.id, f.text, f.subject, f.start_ts), m AS (SELECT id, trim(coalesce(CASE WHEN id % 5 > 0 THEN seen END, ''), ' ') AS a, trim(coalesce(said, ''), ' ') AS b FROM c) SELECT id, md5(CASE WHEN b = '' THEN a WHEN a = '' THEN '[Speech] ' || b ELSE a || ' [Speech: ' || b || ']' END) AS digest FROM m")
def merged_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is seen and what is said in one text, by which of them is there."""
    caps = captions(spark, sf_dir)
    held = T.contains_edges(caps.where("granularity IN ('30sec', '3min')")).selectExpr("src", "dst AS id").where("id % 3 > 0")
    said = held.join(caps.selectExpr("id AS src", "text AS said"), "src").groupBy("id").agg(F.min_by("said", "src").alias("said"))
    both = caps.where("granularity = '30sec'").selectExpr("id", "CASE WHEN id % 5 > 0 THEN text END AS seen").join(said, "id", "left")
    return both.selectExpr("id", f"md5({RS.merged_text('seen', 'said')}) AS digest")


@registry.add("sentence_documents", "WITH s AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(text, '([.!?])\\s*', '\\1\u0001', 'g'), '\u0001'), lambda s: trim(s, ' ') <> '') AS ss FROM documents WHERE text IS NOT NULL), e AS (SELECT doc_id, unnest(ss) AS t, generate_subscripts(ss, 1) - 1 AS i FROM s) SELECT CAST(doc_id AS VARCHAR) || '_' || CAST(i AS VARCHAR) AS id, md5(t) AS digest FROM e WHERE NOT (doc_id % 10 = 0 AND i = 0)")
def sentence_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as sentences with ids, without those that the collection has already."""
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL").selectExpr("doc_id", f"posexplode({X.sentences('text')}) AS (i, t)").selectExpr("doc_id", "concat(doc_id, '_', i) AS id", "md5(t) AS digest")
    have = rows.where("doc_id % 10 = 0 AND id LIKE '%\\\\_0'").select("id")
    return S.missing(rows, have, "id").select("id", "digest")


@registry.add("sentence_context", "WITH s AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(text, '([.!?])\\s*', '\\1\u0001', 'g'), '\u0001'), lambda s: trim(s, ' ') <> '') AS ss FROM documents WHERE text IS NOT NULL), m AS (SELECT doc_id, ss, len(ss) // 2 AS i FROM s WHERE len(ss) > 0) SELECT doc_id, CAST(i AS INTEGER) AS at, CAST(len(ss[greatest(1, i - 9) : i + 11]) AS INTEGER) AS sentences, md5(array_to_string(ss[greatest(1, i - 9) : i + 11], '|')) AS digest FROM m")
def sentence_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle sentence of each text with ten before and after it."""
    s = table(spark, sf_dir, "documents").where("text IS NOT NULL").selectExpr("doc_id", f"{X.sentences('text')} AS ss").where("size(ss) > 0").selectExpr("*", "CAST(size(ss) DIV 2 AS int) AS at")
    return s.selectExpr("doc_id", "at", "slice(ss, greatest(1, at - 9), at + 11 - greatest(1, at - 9) + 1) AS w").selectExpr("doc_id", "at", "size(w) AS sentences", "md5(array_join(w, '|')) AS digest")


@registry.add("subtitle_blocks", f"WITH {CAPS}, n AS (SELECT subject, day, start_s, start_s + end_ts - start_ts AS end_s, text, row_number() OVER (PARTITION BY subject, day ORDER BY start_s, start_s + end_ts - start_ts, text) AS n FROM caps WHERE granularity = '3min' AND trim(text, ' ') <> '') SELECT subject || '_' || CAST(day AS VARCHAR) AS key, n, md5(CAST(n AS VARCHAR) || chr(10) || {_TWO.format(x='start_s // 3600')} || ':' || {_TWO.format(x='start_s // 60 % 60')} || ':' || {_TWO.format(x='start_s % 60')} || ',000 --> ' || {_TWO.format(x='end_s // 3600')} || ':' || {_TWO.format(x='end_s // 60 % 60')} || ':' || {_TWO.format(x='end_s % 60')} || ',000' || chr(10) || trim(text, ' ') || chr(10)) AS digest FROM n")
def subtitle_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered and timed blocks of a subject's day."""
    rows = captions(spark, sf_dir).where("granularity = '3min'").selectExpr("concat(subject, '_', day) AS key", "start_s", "start_s + end_ts - start_ts AS end_s", "text")
    return RD.srt_blocks(rows).selectExpr("key", "n", "md5(block) AS digest")


@registry.add("collection_rows", "SELECT 'chunk-' || md5(text) AS hash_id, max(lower(coalesce(lang, ''))) AS lang FROM documents WHERE text IS NOT NULL AND trim(text, ' ') <> '' GROUP BY 1 HAVING bool_and(source IS DISTINCT FROM 'diary_hub')")
def collection_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection created, filled twice over, one source deleted again, empty ones purged."""
    docs = S.keyed(table(spark, sf_dir, "documents").where("text IS NOT NULL"), "text", "chunk-")
    rows = docs.groupBy("hash_id").agg(F.max(F.lower(F.coalesce("lang", F.lit("")))).alias("lang"), F.first("text").alias("text")).selectExpr("hash_id", "text", "lang", "map('lang', lang) AS meta")
    c = S.Collection(spark, folder(spark, "collection"), "hash_id string, text string, lang string, meta map<string, string>")
    c.insert(rows.where("hash_id < 'chunk-8'"))
    c.insert(rows)
    c.delete(docs.where("source = 'diary_hub'").select("hash_id"))
    c.purge("text", "meta")
    return c.rows().select("hash_id", "lang")


@registry.add("stored_graph", f"WITH {_GRAPH} SELECT node_type AS kind, count(*) AS n, min(id) AS first_id FROM nodes WHERE node_type IN ('entity', 'semantic') GROUP BY node_type UNION ALL SELECT edge_type, count(*), min(src) FROM edges WHERE edge_type = 'mentioned_in' GROUP BY edge_type")
def stored_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph written and read again, only the folders of the kinds that are asked."""
    nodes, edges, _ = parts(spark, sf_dir)
    path = folder(spark, "graph")
    S.save_graph(nodes, edges, path)
    n, e = S.load_graph(spark, path)
    made = n.where("node_type IN ('entity', 'semantic')").groupBy(F.col("node_type").alias("kind")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    return made.unionByName(e.where("edge_type = 'mentioned_in'").groupBy(F.col("edge_type").alias("kind")).agg(F.count("*").alias("n"), F.min("src").alias("first_id")))


@registry.add("cache_split", f"WITH {CAPS}, p AS (SELECT DISTINCT text FROM caps WHERE granularity = '3min' AND text IS NOT NULL), k AS (SELECT 'chunk-' || md5(text) AS chunk FROM p) SELECT chunk, chunk < 'chunk-8' AS known FROM k")
def cache_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages keyed by their text, with what a cache knows of them and what it lacks; keys below the middle are cached."""
    passages = captions(spark, sf_dir).where("granularity = '3min' AND text IS NOT NULL").select("text").distinct()
    cache = cut(passages.selectExpr("concat('chunk-', md5(text)) AS chunk", "array() AS entities").where("chunk < 'chunk-8'"))
    have, missing = RD.rekeyed(passages, cache)
    return have.selectExpr("chunk", "true AS known").unionByName(missing.selectExpr("chunk", "false AS known"))


@registry.add("split_union", "SELECT DISTINCT id, '_q' AS _split FROM qa_mcq UNION ALL SELECT DISTINCT id, '_e' FROM eval_results WHERE id IS NOT NULL")
def split_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the files that are there, each with its tag; a missing file is skipped."""
    rows = RD.read_union(spark, {"_q": f"{sf_dir}/qa_mcq.parquet", "_none": f"{sf_dir}/not_there.parquet", "_e": f"{sf_dir}/eval_results.parquet"})
    return rows.where("id IS NOT NULL").select("id", "_split").distinct()


@registry.add("frame_captions", f"WITH {CAPS}, {MOMENTS} SELECT q.id, arg_min(c.id, struct_pack(a := c.start_ts, b := c.id)) AS caption FROM q JOIN caps c ON c.granularity = '3min' AND c.subject = q.subject AND c.start_ts <= q.t AND q.t < c.end_ts GROUP BY q.id")
def frame_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first caption whose half-open span holds a frame's moment."""
    caps = captions(spark, sf_dir).where("granularity = '3min'").selectExpr("subject", "id", "start_ts", "end_ts - 1 AS end_ts")
    found = T.first_id(caps, moments(spark, sf_dir).withColumnRenamed("id", "moment"))
    return found.selectExpr("moment AS id", "id AS caption")


@registry.add("proportional_sample", f"WITH {CAPS}, r AS (SELECT subject, day, id, row_number() OVER (PARTITION BY subject, day ORDER BY start_ts, id) - 1 AS rn, count(*) OVER (PARTITION BY subject, day) AS cnt FROM caps WHERE granularity = '30sec'), k AS (SELECT *, greatest(1, CAST(floor(cnt * 0.1::DOUBLE) AS BIGINT)) AS m FROM r), s AS (SELECT DISTINCT subject, day, CASE WHEN m = 1 THEN 0 ELSE i * (cnt - 1) // (m - 1) END AS rn FROM (SELECT DISTINCT subject, day, cnt, m, unnest(range(m)) AS i FROM k)) SELECT k.subject, k.id FROM k JOIN s ON s.subject = k.subject AND s.day = k.day AND s.rn = k.rn")
def proportional_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each clip (here a subject's day) a tenth of its rows at equal steps, one at least."""
    return T.proportional_sample(captions(spark, sf_dir).where("granularity = '30sec'"), ["subject", "day"], ["start_ts", "id"], 0.1).select("subject", "id")


@registry.add("rollup_ladder", f"WITH {CAPS}, a AS (SELECT subject, row_number() OVER (PARTITION BY subject ORDER BY start_ts, id) AS rn, start_ts, end_ts FROM caps WHERE granularity = '30sec'), b AS (SELECT subject, (rn - 1) // 6 AS g, arg_min(start_ts, rn) AS start_ts, arg_max(end_ts, rn) AS end_ts FROM a GROUP BY ALL), c AS (SELECT subject, g // 3 AS g, arg_min(start_ts, g) AS start_ts, arg_max(end_ts, g) AS end_ts FROM b GROUP BY subject, g // 3), d AS (SELECT subject, g // 6 AS g, arg_min(start_ts, g) AS start_ts, arg_max(end_ts, g) AS end_ts FROM c GROUP BY subject, g // 6), u AS (SELECT '3min' AS level, * FROM b UNION ALL SELECT '10min', * FROM c UNION ALL SELECT '1h', * FROM d) SELECT level, subject, CAST(g AS BIGINT) AS grp, CAST(start_ts AS BIGINT) AS start_ts, CAST(end_ts AS BIGINT) AS end_ts FROM u")
def rollup_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six captions to three minutes, three of these to ten, six of these to an hour."""
    rows, out = captions(spark, sf_dir).where("granularity = '30sec'").select("subject", "id", "start_ts", "end_ts", "text", "video_path"), None
    for level, n in (("3min", 6), ("10min", 3), ("1h", 6)):
        rows = cut(T.fixed_rollup(rows, ["subject"], ["start_ts", "id"] if level == "3min" else ["grp0"], n))
        part = rows.select(F.lit(level).alias("level"), "subject", "grp", "start_ts", "end_ts")
        out = part if out is None else out.unionByName(part)
        rows = rows.withColumnRenamed("grp", "grp0").drop("n_rows")
    return out
