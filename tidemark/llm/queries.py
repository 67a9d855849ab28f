"""Queries p1, p2, p3, p5, p7, p8, p9 and p10, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.clock import clock_seconds, day_number, running_seconds
from tidemark.llm.consensus import agreement, every_id, fit_consensus, judge_labels
from tidemark.llm.lookalikes import canonical_texts, same_looking_classes, same_looking_pairs, text_keys
from tidemark.llm.mixing import mix_copies, mix_report
from tidemark.llm.nearest_time import nearest_in_time
from tidemark.llm.neighbours import nearest_vectors
from tidemark.llm.packing import pack
from tidemark.llm.pair_defects import best_defect, defect_posteriors
from tidemark.llm.record_hash import collapse_records, readable_records
from tidemark.llm.tokens import token_counts
from tidemark.registry import Registry
from tidemark.runtime import table

registry = Registry()

TOLERANCE_S = 20


def _sql_clock(day: str, time: str) -> str:
    """Running seconds in SQL; NULL where either does not read so."""
    t = f"lpad({time}, 8, '0')"
    h, m, s = (f"CAST({t}[{a}:{a + 1}] AS BIGINT)" for a in (1, 3, 5))
    return f"CASE WHEN regexp_full_match({day}, '(?i)day[0-9]+') AND regexp_full_match({time}, '[0-9]{{1,8}}') THEN CASE WHEN {h} < 24 AND {m} < 60 AND {s} < 60 THEN (TRY_CAST(substr({day}, 4) AS BIGINT) - 1) * 86400 + {h} * 3600 + {m} * 60 + {s} END END"


_P1_SQL = f"""
WITH q AS (SELECT DISTINCT id, subject, {_sql_clock('query_time.date', 'query_time.time')} AS t FROM qa_mcq),
c AS (SELECT subject, {_sql_clock('date', 'start_time')} AS a, {_sql_clock('date', 'end_time')} AS b, caption_id FROM captions_a WHERE granularity = '30sec'),
pairs AS (SELECT q.id, c.caption_id, abs(c.a - q.t) AS d FROM q JOIN c ON q.subject = c.subject AND abs(c.a - q.t) <= {TOLERANCE_S} WHERE c.b > c.a)
"""


def question_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each question with a caption: id, subject, caption_id, distance_s."""
    q = table(spark, sf_dir, "qa_mcq").select("id", "subject", running_seconds(day_number(F.col("query_time.date")), clock_seconds(F.col("query_time.time"))).alias("t")).where("id IS NOT NULL AND t IS NOT NULL")
    c = table(spark, sf_dir, "captions_a").where("granularity = '30sec'")
    day, a, b = day_number(F.col("date")), clock_seconds(F.col("start_time")), clock_seconds(F.col("end_time"))
    c = c.select("caption_id", "subject", running_seconds(day, a).alias("a"), running_seconds(day, b).alias("b")).where("b > a")
    found = nearest_in_time(q, c, entity=("subject", "subject"), time=(F.col("t"), F.col("a")), right_id="caption_id", tolerance=TOLERANCE_S)
    return found.groupBy("id").agg(F.min(F.struct("__distance", "__match", "subject")).alias("x")).selectExpr("id", "x.subject AS subject", "x.__match AS caption_id", "x.__distance AS distance_s")


@registry.add("p1_found", f"{_P1_SQL} SELECT id, arg_min(caption_id, struct_pack(d := d, c := caption_id)) AS caption_id FROM pairs GROUP BY id")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return question_captions(spark, sf_dir).select("id", "caption_id")


@registry.add(
    "p1_distances",
    f"{_P1_SQL}, best AS (SELECT id, min(d) AS d FROM pairs GROUP BY id) SELECT CAST(d AS BIGINT) AS distance_s, count(*) AS questions FROM best GROUP BY d",
)
def p1_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the paired captions start from their questions."""
    return question_captions(spark, sf_dir).groupBy("distance_s").agg(F.count("*").alias("questions"))


_FAILED_SQL = "(regexp_matches(lower(trim(coalesce(judge_response, ''))), '(error|exception|timeout|timed out|rate limit|empty response|no response|failed|failure|unavailable|not available|n/a)') AND NOT regexp_matches(judge_response, '[0-5]'))"
_P2_SQL = f"""
WITH u AS (SELECT DISTINCT id, judge_id, scored_at, result_id, CASE WHEN {_FAILED_SQL} THEN NULL WHEN raw_score BETWEEN 0 AND 5 THEN raw_score WHEN raw_score IS NULL AND smoothed_score = 0 THEN 6
  WHEN raw_score IS NULL AND smoothed_score = 0.5 THEN 3 WHEN raw_score IS NULL AND smoothed_score = 1 THEN 7 END AS label FROM eval_results WHERE id IS NOT NULL AND judge_id IS NOT NULL),
l AS (SELECT id, judge_id, label FROM u WHERE label IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id, judge_id ORDER BY scored_at DESC NULLS LAST, result_id DESC, label DESC) = 1),
e AS (SELECT * FROM l WHERE label < 6),
pairs AS (SELECT x.id, 1 - avg(abs(x.label - y.label)) / 5 AS a FROM e x JOIN e y ON x.id = y.id AND x.judge_id < y.judge_id GROUP BY x.id)
SELECT e.id, count(*) AS n_judges, round(any_value(pairs.a), 6) AS agreement FROM e LEFT JOIN pairs ON e.id = pairs.id GROUP BY e.id
"""


@registry.add("p2_found")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = table(spark, sf_dir, "eval_results")
    found, _, usual = fit_consensus(judge_labels(results))
    return every_id(results, found, usual)


@registry.add("p2_judges")
def p2_judges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reliability of each judge."""
    return fit_consensus(judge_labels(table(spark, sf_dir, "eval_results")))[1]


@registry.add("p2_agreement", _P2_SQL)
def p2_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of the judges on each question."""
    return agreement(judge_labels(table(spark, sf_dir, "eval_results")))


_LEAF_SQL = "regexp_replace(lower(upper({x})), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
_P5_SQL = f"""
WITH raw AS (SELECT DISTINCT resp_id, named_entities, triples, CASE WHEN named_entities IS NULL AND triples IS NULL AND json_valid(raw_output) THEN raw_output END AS j FROM openie_raw),
r AS (SELECT resp_id, coalesce(named_entities, CAST(j->'$.named_entities' AS VARCHAR[])) AS es, coalesce(triples, CAST(j->'$.triples' AS VARCHAR[][])) AS ts FROM raw),
c AS (SELECT resp_id, list_sort(list_distinct(list_transform(coalesce(es, []), lambda e: {_LEAF_SQL.format(x='e')}))) AS es,
  list_sort(list_distinct(list_transform(coalesce(ts, []), lambda t: list_transform(t, lambda x: {_LEAF_SQL.format(x='x')})))) AS ts FROM r WHERE len(es) > 0 OR len(ts) > 0),
k AS (SELECT resp_id, min(resp_id) OVER (PARTITION BY es, ts) AS keep_id FROM c)
"""


@registry.add("p5_found", f"{_P5_SQL} SELECT DISTINCT keep_id, resp_id AS copy_id FROM k WHERE resp_id <> keep_id")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = collapse_records(readable_records(table(spark, sf_dir, "openie_raw")))
    return same.where("resp_id <> keep_id").select("keep_id", F.col("resp_id").alias("copy_id"))


@registry.add("p5_records", f"{_P5_SQL} SELECT keep_id AS resp_id, count(DISTINCT resp_id) AS copies FROM k GROUP BY keep_id")
def p5_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record once, with the number of responses that hold it."""
    same = collapse_records(readable_records(table(spark, sf_dir, "openie_raw")))
    return same.groupBy(F.col("keep_id").alias("resp_id")).agg(F.count("*").alias("copies"))


SIMILAR = 0.85


def clip_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_vectors(table(spark, sf_dir, "visual_embeddings"), vec_id="vec_id", embedding="embedding", dim=64, k=5, floor=SIMILAR)


@registry.add("p3_found")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clip_neighbours(spark, sf_dir).selectExpr("least(src, dst) AS vec_a", "greatest(src, dst) AS vec_b").distinct()


@registry.add("p10_found")
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_looking_pairs(text_keys(table(spark, sf_dir, "documents"), "doc_id", "text"))


@registry.add("p10_classes")
def p10_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its class of texts that look the same, and its number of links to other texts."""
    return same_looking_classes(text_keys(table(spark, sf_dir, "documents"), "doc_id", "text"))


@registry.add("p10_changed")
def p10_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By language: documents, and those whose text was not in its form to read."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.lower("lang").alias("lang"))
    forms = canonical_texts(d, "doc_id", "text", ("lang",)).where("text IS NOT NULL")
    return forms.groupBy("lang").agg(F.count("*").alias("docs"), F.sum(F.col("changed").cast("long")).alias("changed"))


def answer_posteriors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "qa_results").selectExpr("pair_id", "question", "CASE WHEN type = 'mcq' THEN model_option ELSE answer END AS response")
    return defect_posteriors(rows, "pair_id", "question", "response")


@registry.add("p7_found")
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_defect(answer_posteriors(spark, sf_dir))


@registry.add("p7_labels")
def p7_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every defect whose posterior reaches its validated cutoff; a pair may have several."""
    return answer_posteriors(spark, sf_dir).where("posterior >= cutoff").selectExpr("pair_id", "defect", "round(posterior, 4) AS posterior")


def packed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in containers of every kind; kinds of one capacity share their containers."""
    kinds = table(spark, sf_dir, "containers").where("capacity_tokens > 0").select("container_kind", F.col("capacity_tokens").cast("long").alias("capacity")).distinct()
    capacities = [r["capacity"] for r in kinds.select("capacity").distinct().collect()]
    items = token_counts(table(spark, sf_dir, "documents"), "text", ["doc_id"])
    packed = pack(items, capacities, "doc_id", "tokens")
    return packed.join(F.broadcast(kinds), "capacity").select("container_kind", "capacity", "container", F.col("item").alias("doc_id"), "piece", F.col("size").alias("tokens"))


@registry.add("p8_packed")
def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(spark, sf_dir)


@registry.add("p8_fill")
def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By kind: containers, tokens, the share of room used and the fewest containers that could do."""
    each = packed_documents(spark, sf_dir).where("tokens > 0").groupBy("container_kind", "capacity", "container").agg(F.sum("tokens").alias("used"))
    return each.groupBy("container_kind", "capacity").agg(F.count("*").alias("containers"), F.sum("used").alias("tokens")).selectExpr("container_kind", "containers", "tokens", "round(tokens / (containers * capacity), 6) AS fill", "CAST(ceil(tokens / capacity) AS bigint) AS fewest")


def mixed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = token_counts(table(spark, sf_dir, "documents"), "text", ["doc_id", "source"])
    return mix_copies(sizes, table(spark, sf_dir, "mix_targets"))


@registry.add("p9_copies")
def p9_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_documents(spark, sf_dir)


@registry.add("p9_shares")
def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source."""
    return mix_report(mixed_documents(spark, sf_dir), table(spark, sf_dir, "mix_targets"))
