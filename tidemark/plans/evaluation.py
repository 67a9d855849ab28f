"""Queries over texts, answers, scores and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import metrics as M
from tidemark.operators import sampling as P
from tidemark.operators.knn import similar, softmax_mass
from tidemark.operators.minhash import near_duplicates
from tidemark.registry import Registry
from tidemark.runtime import table

registry = Registry()


@registry.add("plain_words", "SELECT doc_id, md5(trim(regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g'))) AS digest FROM documents WHERE text IS NOT NULL")
def plain_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X9, X21."""
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").selectExpr("doc_id", f"md5({X.plain_words('text')}) AS digest")


_SQ = lambda x: "'" + x.replace("'", "''") + "'"
_PUNCT = f"translate(text, {_SQ(''.join(X.ONE_TO_ONE) + X.GONE)}, {_SQ(''.join(X.ONE_TO_ONE.values()))})"
for _k, _v in X.SEVERAL:
    _PUNCT = f"replace({_PUNCT}, {_SQ(_k)}, {_SQ(_v)})"


@registry.add("plain_punctuation", f"SELECT doc_id, md5({_PUNCT}) AS digest FROM documents WHERE text IS NOT NULL")
def plain_punctuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X20."""
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").selectExpr("doc_id", f"md5({X.plain_punctuation('text')}) AS digest")


@registry.add("sentence_counts", "SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(regexp_replace(text, '([.!?])\\s*', '\\1\u0001', 'g'), '\u0001'), lambda s: trim(s, ' ') <> '')) AS INTEGER) AS sentences FROM documents WHERE text IS NOT NULL")
def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X18, S15."""
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").selectExpr("doc_id", f"size({X.sentences('text')}) AS sentences")


@registry.add("token_lengths", "SELECT source, count(*) AS docs, round(avg(len(regexp_split_to_array(text, '[^a-zA-Z]'))), 4) AS mean_tokens FROM documents WHERE text IS NOT NULL GROUP BY source")
def token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A39, X22."""
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").groupBy("source").agg(F.count("*").alias("docs"), F.round(F.avg(F.size(F.split("text", "[^a-zA-Z]"))), 4).alias("mean_tokens"))


_WORD = "[\\p{L}\\p{N}_]"


def letter_sql(t: str) -> str:
    """The option letter of a trimmed text in SQL, whose patterns have no view around: borders of words are matched with the letter."""
    border = "(?:^|[^\\p{L}\\p{N}_])"
    at = f"CAST(floor(length({t}) * 0.8::DOUBLE) AS INTEGER)"
    tail = f"(CASE WHEN {at} > 0 AND regexp_matches(substr({t}, {at}, 1), '{_WORD}') THEN '_' ELSE ' ' END || substr({t}, {at} + 1))"
    doubled = f"regexp_replace({tail}, '([^\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g')"
    tries = [f"regexp_extract({t}, '^\\(?([A-Da-d])(?:[.):,]|\\s|$)', 1)", *(f"regexp_extract({t}, '(?i){p}', 1)" for p in X.LETTER_PHRASES), f"regexp_extract({t}, '(?i){border}{X.LETTER_IS}(?:[^\\p{{L}}\\p{{N}}_]|$)', 1)", f"coalesce(list_last(regexp_extract_all({doubled}, '{border}([A-Da-d])(?:[^\\p{{L}}\\p{{N}}_]|$)', 1)), '')"]
    return "upper(coalesce(" + ", ".join(f"nullif({x}, '')" for x in tries) + "))"


@registry.add("choice_letters", f"SELECT DISTINCT pair_id, {letter_sql('t')} AS letter FROM (SELECT pair_id, regexp_replace(model_option, '^\\s+|\\s+$', '', 'g') AS t FROM qa_results WHERE type = 'mcq' AND model_option IS NOT NULL)")
def choice_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X12, X14."""
    return table(spark, sf_dir, "qa_results").where("type = 'mcq' AND model_option IS NOT NULL").selectExpr("pair_id", f"{X.choice_letter('model_option')} AS letter").distinct()


def _norm_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower({x}), '^\\s+|\\s+$', '', 'g'), '[.,)]+$', '')"


#: Ways to answer, each for every question: text, letter and text, letter in brackets and text, a phrase, a letter at the end.
_WAYS = {"text": "{c}", "letter_text": "'B. ' || {c}", "bracket_text": "'(B) ' || {c} || '.'", "phrase": "'I would pick (B) here, as ' || {c} || ' was on the table'", "last": "{c} || ' fits, so it must be B'"}


@registry.add("right_answers", "WITH q AS (SELECT DISTINCT id, upper(answer) AS gold, choice_a, choice_b, choice_c, choice_d FROM qa_mcq WHERE upper(answer) IN ('A', 'B', 'C', 'D')), g AS (SELECT id, gold, choice_b, CASE gold WHEN 'A' THEN choice_a WHEN 'B' THEN choice_b WHEN 'C' THEN choice_c ELSE choice_d END AS choice FROM q), p AS (" + " UNION ALL ".join(f"SELECT id, gold, choice, '{k}' AS way, {v.format(c='choice_b')} AS prediction FROM g" for k, v in _WAYS.items()) + f"), t AS (SELECT *, regexp_replace(prediction, '^\\s+|\\s+$', '', 'g') AS tr FROM p) SELECT id, way, coalesce({_norm_sql('prediction')} = {_norm_sql('choice')} OR {letter_sql('tr')} = gold OR {_norm_sql('prediction')} = {_norm_sql("gold || '. ' || choice")} OR {_norm_sql('prediction')} = {_norm_sql("'(' || gold || ') ' || choice")}, false) AS correct FROM t")
def right_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of several ways to answer with the second option are right."""
    q = table(spark, sf_dir, "qa_mcq").where("upper(answer) IN ('A', 'B', 'C', 'D')").selectExpr("id", "upper(answer) AS gold", "choice_b", "CASE upper(answer) WHEN 'A' THEN choice_a WHEN 'B' THEN choice_b WHEN 'C' THEN choice_c ELSE choice_d END AS choice").distinct()
    ways = ", ".join(f"'{k}', {v.format(c='choice_b')}" for k, v in _WAYS.items())
    return q.selectExpr("id", "gold", "choice", f"explode(map({ways})) AS (way, prediction)").selectExpr("id", "way", f"{X.is_right('prediction', 'gold', 'choice')} AS correct")


_SCORE = "coalesce(nullif(regexp_extract(judge_response, '(?i)Final Score\\s*[:=]\\s*([0-9])', 1), ''), list_last(regexp_extract_all(judge_response, '[0-5]')))"


@registry.add("judge_scores", f"SELECT DISTINCT result_id, TRY_CAST({_SCORE} AS INTEGER) AS score, CASE WHEN TRY_CAST({_SCORE} AS INTEGER) <= 2 THEN 0.0::DOUBLE WHEN TRY_CAST({_SCORE} AS INTEGER) = 3 THEN 0.5 WHEN TRY_CAST({_SCORE} AS INTEGER) >= 4 THEN 1.0 END AS smoothed FROM eval_results WHERE judge_response IS NOT NULL")
def judge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score that a judge's response states, and its smoothed form."""
    e = table(spark, sf_dir, "eval_results").where("judge_response IS NOT NULL").selectExpr("result_id", f"try_cast({X.judge_score('judge_response')} AS int) AS score")
    return e.selectExpr("result_id", "score", f"{X.smooth_score('score')} AS smoothed").distinct()


@registry.add("judge_averages", "WITH e AS (SELECT DISTINCT result_id, split, raw_score, smoothed_score FROM eval_results) SELECT split, count(*) AS n, round(avg(raw_score), 6) AS raw, round(avg(smoothed_score), 6) AS smoothed FROM e GROUP BY ROLLUP (split)")
def judge_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A24, A20, S26."""
    e = table(spark, sf_dir, "eval_results").select("result_id", "split", "raw_score", "smoothed_score").distinct()
    return e.rollup("split").agg(F.count("*").alias("n"), F.round(F.avg("raw_score"), 6).alias("raw"), F.round(F.avg("smoothed_score"), 6).alias("smoothed"))


_OUT = "o AS (SELECT id, any_value(type) AS type FROM qa_mcq GROUP BY id), e AS (SELECT DISTINCT result_id, id, split, evaluate FROM eval_results WHERE evaluate IS NOT NULL)"


@registry.add("accuracy_grouping_sets", f"WITH {_OUT} SELECT type, split, count(*) AS n, round(avg(CAST(evaluate AS INTEGER)), 6) AS accuracy FROM e JOIN o ON o.id = e.id GROUP BY GROUPING SETS ((type), (split), ())")
def accuracy_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy by type, by split and in all, in one pass."""
    q = table(spark, sf_dir, "qa_mcq").groupBy("id").agg(F.first("type").alias("type"))
    e = table(spark, sf_dir, "eval_results").where("evaluate IS NOT NULL").select("result_id", "id", "split", "evaluate").distinct()
    return e.join(q, "id").groupingSets([["type"], ["split"], []], "type", "split").agg(F.count("*").alias("n"), F.round(F.avg(F.col("evaluate").cast("int")), 6).alias("accuracy"))


#: Injected facts carry a mark; here a retrieved content with a time of day counts as a step of an event, one that speaks of what was said as a topic.
_TAGGED = "CASE WHEN {c} LIKE '% says %' THEN '[Topic: speech] ' || {c} WHEN {c} LIKE 'At __:__ %' THEN '[Event: visit] ' || {c} ELSE {c} END"
_MARKED = f"h AS (SELECT result_id, id, judge_id, evaluate, smoothed_score, list_transform(round_history, lambda r: {_TAGGED.format(c='r.retrieved_content')}) AS seen FROM (SELECT DISTINCT result_id, id, judge_id, evaluate, smoothed_score, round_history FROM eval_results)), e AS (SELECT *, coalesce(len(list_filter(seen, lambda c: contains(c, '[Topic: '))) > 0, false) AS topic, coalesce(len(list_filter(seen, lambda c: contains(c, '[Event: '))) > 0, false) AS event FROM h)"
_BUCKET = "CASE WHEN topic AND event THEN 'Both' WHEN topic THEN 'Topic only' WHEN event THEN 'Event only' ELSE 'None' END"


def marked_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "eval_results").select("result_id", "id", "judge_id", "evaluate", "smoothed_score", "round_history").distinct()
    seen = rows.withColumn("seen", F.expr(f"transform(round_history, r -> {_TAGGED.format(c='r.retrieved_content')})"))
    return M.marks(seen, "seen")


@registry.add("breakdown_buckets", f"WITH {_MARKED}, b AS (SELECT *, {_BUCKET} AS k FROM e), x AS (SELECT unnest(CASE WHEN k = 'None' THEN [k, 'All'] ELSE [k, 'All', 'Any'] END) AS bucket, CAST(coalesce(evaluate, false) AS BIGINT) AS base, CAST(coalesce(smoothed_score, 0) >= 0.5 AS BIGINT) AS chain FROM b) SELECT bucket, count(*) AS n, CAST(sum(base) AS BIGINT) AS base, CAST(sum(chain) AS BIGINT) AS chain, round((sum(chain) - sum(base)) * 100.0 / count(*), 4) AS delta FROM x GROUP BY bucket")
def breakdown_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results by the marks in what was retrieved."""
    return M.breakdown(marked_results(spark, sf_dir).selectExpr("topic", "event", "CAST(coalesce(evaluate, false) AS bigint) AS base", "CAST(coalesce(smoothed_score, 0) >= 0.5 AS bigint) AS chain"))


@registry.add("paired_runs", f"WITH {_MARKED}, ug AS (SELECT id, avg(smoothed_score) AS base, count(*) AS seeds FROM e WHERE judge_id < 'judge-m' AND smoothed_score IS NOT NULL GROUP BY id), ch AS (SELECT id, avg(coalesce(smoothed_score, 0)) AS chain, bool_or(topic) AS topic, bool_or(event) AS event FROM e WHERE judge_id >= 'judge-m' GROUP BY id), b AS (SELECT {_BUCKET} AS k, base, chain, seeds FROM ug JOIN ch ON ug.id = ch.id), x AS (SELECT unnest(CASE WHEN k = 'None' THEN [k, 'All'] ELSE [k, 'All', 'Any'] END) AS bucket, base, chain, seeds FROM b) SELECT bucket, count(*) AS n, CAST(sum(seeds) AS BIGINT) AS seeds, round(sum(base), 6) AS base, round(sum(chain), 6) AS chain, round((sum(chain) - sum(base)) * 100.0 / count(*), 4) AS delta FROM x GROUP BY bucket")
def paired_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs paired by question, the scores of the first averaged over its seeds, by what the second retrieved."""
    return M.paired(marked_results(spark, sf_dir), "id", "judge_id < 'judge-m'", "judge_id >= 'judge-m'", "smoothed_score")


@registry.add("merged_subtasks", "WITH e AS (SELECT DISTINCT result_id, split, judge_id, raw_score, smoothed_score FROM eval_results WHERE judge_id IS NOT NULL), t AS (SELECT split, judge_id AS task, 'raw' AS metric, avg(raw_score) AS score FROM e GROUP BY ALL UNION ALL SELECT split, judge_id, 'smoothed', avg(smoothed_score) FROM e GROUP BY ALL UNION ALL SELECT split, judge_id, 'evaluation_time', CAST(count(*) AS DOUBLE) FROM e GROUP BY ALL), n AS (SELECT count(DISTINCT task) AS n FROM t) SELECT split, metric, round(CASE WHEN metric = 'evaluation_time' THEN sum(score) ELSE sum(score) / any_value(n) END, 6) AS score, count(*) AS found FROM t, n GROUP BY split, metric")
def merged_subtasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the judges as sub-tasks, merged to one mean over all of them; times are summed."""
    e = table(spark, sf_dir, "eval_results").where("judge_id IS NOT NULL").select("result_id", "split", "judge_id", "raw_score", "smoothed_score").distinct()
    means = e.groupBy("split", F.col("judge_id").alias("task")).agg(F.avg("raw_score").alias("raw"), F.avg("smoothed_score").alias("smoothed"), F.count("*").cast("double").alias("evaluation_time"))
    scores = means.selectExpr("split", "task", "stack(3, 'raw', raw, 'smoothed', smoothed, 'evaluation_time', evaluation_time) AS (metric, score)")
    return M.merge_tasks(scores, summed=("evaluation_time",)).withColumn("score", F.round("score", 6))


@registry.add("modality_report", "WITH x(modality, dataset) AS (SELECT DISTINCT lower(lang), source FROM documents WHERE lang IS NOT NULL UNION ALL SELECT 'en', 'not_there'), f AS (SELECT lower(lang) AS modality, source AS dataset, avg(n_chars) AS score FROM documents WHERE lang IS NOT NULL AND n_chars > 300 GROUP BY ALL) SELECT x.modality, round(avg(score), 6) AS score, count(score) AS found, coalesce(string_agg(CASE WHEN score IS NULL THEN x.dataset END, ',' ORDER BY x.dataset), '') AS missing FROM (SELECT DISTINCT * FROM x) x LEFT JOIN f ON f.modality = x.modality AND f.dataset = x.dataset GROUP BY x.modality")
def modality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean main score of each modality over the datasets found, and those that are missing."""
    d = table(spark, sf_dir, "documents").where("lang IS NOT NULL").selectExpr("lower(lang) AS modality", "source AS dataset", "n_chars")
    expected = d.select("modality", "dataset").unionByName(spark.createDataFrame([("en", "not_there")], "modality string, dataset string")).distinct()
    return M.report(expected, d.where("n_chars > 300").groupBy("modality", "dataset").agg(F.avg("n_chars").alias("score"))).withColumn("score", F.round("score", 6))


_SETS = "q AS (SELECT id, list_sort(list_distinct(list(judge_id))) AS ids FROM eval_results WHERE judge_id IS NOT NULL GROUP BY id)"


@registry.add("source_sets", f"WITH {_SETS} SELECT array_to_string(ids, ',') AS sources, CASE WHEN len(ids) = 1 THEN 'single' ELSE 'cross' END AS kind, count(*) AS questions, min(id) AS first_id FROM q GROUP BY ids")
def source_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions by the set of sources that they need, of one source or across several."""
    q = table(spark, sf_dir, "eval_results").where("judge_id IS NOT NULL").groupBy("id").agg(F.array_sort(F.collect_set("judge_id")).alias("ids"))
    return q.groupBy("ids").agg(F.count("*").alias("questions"), F.min("id").alias("first_id")).selectExpr("array_join(ids, ',') AS sources", "CASE WHEN size(ids) = 1 THEN 'single' ELSE 'cross' END AS kind", "questions", "first_id")


@registry.add("evaluable_questions", "WITH a AS (SELECT judge_id FROM eval_results WHERE judge_id IS NOT NULL AND judge_id < 'judge-s' GROUP BY judge_id HAVING count(*) >= 5), q AS (SELECT DISTINCT id, judge_id FROM eval_results WHERE judge_id IS NOT NULL) SELECT id, count(*) AS sources FROM q GROUP BY id HAVING bool_and(judge_id IN (SELECT judge_id FROM a))")
def evaluable_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that need a source and find all they need among those available."""
    e = table(spark, sf_dir, "eval_results").where("judge_id IS NOT NULL")
    have = e.where("judge_id < 'judge-s'").groupBy("judge_id").agg(F.count("*").alias("n")).where("n >= 5")
    return M.evaluable(e.select("id", F.col("judge_id").alias("source")).distinct(), have.select(F.col("judge_id").alias("source")), "id")


_RANK = "s AS (SELECT q.vec_id AS query, v.vec_id AS id, q.label = v.label AS rel, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 9) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank, sum(CAST(rel AS INTEGER)) OVER (PARTITION BY query) AS n FROM s)"


def ranked_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query, rel, n): every fiftieth vector against all others; one of its label is relevant."""
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 50 = 0").selectExpr("vec_id AS query", "embedding AS v", "label AS ql")
    near = similar(q, e.selectExpr("vec_id AS id", "embedding AS v", "label AS kind"), 21, dim=64).where("id <> query")
    best = near.selectExpr("*", "row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS r").where("r <= 20").join(q.select("query", "ql"), "query")
    ranked = best.groupBy("query").agg(F.expr("transform(array_sort(collect_list(struct(r, CAST(kind = CAST(ql AS string) AS int) AS rel))), x -> x.rel)").alias("rel"))
    sizes = e.groupBy(F.col("label").alias("ql")).agg((F.count("*") - 1).alias("n"))
    return ranked.join(q.select("query", "ql"), "query").join(sizes, "ql").select("query", "rel", "n")


@registry.add("ranking_metrics", f"WITH {_RANK}, c AS (SELECT query, k, any_value(n) AS n, CAST(sum(CAST(rel AS INTEGER)) AS DOUBLE) AS hits, sum(CASE WHEN rel THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg, min(CASE WHEN rel THEN rank END) AS first FROM r, (VALUES (1), (5), (10)) t(k) WHERE rank <= k GROUP BY query, k), p AS (SELECT query, rank, rel, sum(CAST(rel AS INTEGER)) OVER (PARTITION BY query ORDER BY rank) / CAST(rank AS DOUBLE) AS pr FROM r WHERE rank <= 10), a AS (SELECT query, k, sum(CASE WHEN rel THEN pr ELSE 0 END) AS ap FROM p, (VALUES (1), (5), (10)) t(k) WHERE rank <= k GROUP BY query, k), i AS (SELECT c.query, c.k, sum(1 / log2(g + 1)) AS idcg FROM c, range(1, 11) t(g) WHERE g <= least(c.k, greatest(1, n)) GROUP BY ALL) SELECT c.query, c.k, round(hits / c.k, 6) AS precision, round(CASE WHEN n = 0 THEN 1 ELSE hits / n END, 6) AS recall, CASE WHEN hits > 0 THEN 1.0::DOUBLE ELSE 0 END AS hit, round(CASE WHEN hits = 0 OR n = 0 THEN 0 ELSE 2 * hits / (c.k + n) END, 6) AS f1, round(CASE WHEN n = 0 THEN 0 ELSE ap / least(n, c.k) END, 6) AS ap, round(coalesce(1.0 / first, 0), 6)::DOUBLE AS rr, round(CASE WHEN n = 0 THEN 0 ELSE dcg / idcg END, 6) AS ndcg FROM c JOIN a ON a.query = c.query AND a.k = c.k JOIN i ON i.query = c.query AND i.k = c.k")
def ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A29-A33, R17."""
    return M.ranking_metrics(ranked_labels(spark, sf_dir), ["query"]).selectExpr("query", "k", *[f"round({m}, 6) AS {m}" for m in ("precision", "recall", "hit", "f1", "ap", "rr", "ndcg")])


@registry.add("retrieval_recall", f"WITH {_RANK}, h AS (SELECT query, k, any_value(n) AS n, sum(CASE WHEN rank <= k THEN CAST(rel AS INTEGER) ELSE 0 END) AS hits FROM r, (VALUES (1), (5), (10), (20)) t(k) GROUP BY query, k) SELECT k, round(avg(CASE WHEN n = 0 THEN 0 ELSE hits / CAST(n AS DOUBLE) END), 4) AS recall FROM h GROUP BY k")
def retrieval_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A26."""
    return M.retrieval_recall(ranked_labels(spark, sf_dir))


@registry.add("graded_ndcg", "WITH g AS (SELECT id AS query, judge_id AS doc, max(raw_score) AS rel FROM eval_results WHERE raw_score BETWEEN 0 AND 5 AND judge_id IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY doc) AS rank, row_number() OVER (PARTITION BY query ORDER BY rel DESC) AS best FROM g), k AS (SELECT query, k, sum(CASE WHEN rank <= k THEN rel / log2(rank + 1) ELSE 0 END) AS a, sum(CASE WHEN best <= k THEN rel / log2(best + 1) ELSE 0 END) AS b, sum(CASE WHEN rank <= k THEN (pow(2, rel) - 1) / log2(rank + 1) ELSE 0 END) AS c, sum(CASE WHEN best <= k THEN (pow(2, rel) - 1) / log2(best + 1) ELSE 0 END) AS d FROM r, (VALUES (1), (5), (10)) t(k) GROUP BY query, k) SELECT query, k, round(coalesce(a / nullif(b, 0), 0), 6) AS linear, round(coalesce(c / nullif(d, 0), 0), 6) AS exponential FROM k")
def graded_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graded gains, linear and exponential, of judged candidates in the order of their names."""
    g = table(spark, sf_dir, "eval_results").where("raw_score BETWEEN 0 AND 5 AND judge_id IS NOT NULL").groupBy(F.col("id").alias("query"), F.col("judge_id").alias("doc")).agg(F.max("raw_score").alias("rel"))
    ranked = g.groupBy("query").agg(F.expr("transform(array_sort(collect_list(struct(doc, rel))), x -> x.rel)").alias("rel"))  # as many as a question has judges
    return M.graded_ndcg(ranked, ["query"]).selectExpr("query", "k", "round(linear, 6) AS linear", "round(exponential, 6) AS exponential")


_FORM = "array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower({t}), '[!-/:-@\\[-`{{-~]', '', 'g'), '\\s+'), lambda w: w NOT IN ('a', 'an', 'the', '')), ' ')"


@registry.add("em_f1", f"WITH x AS (SELECT DISTINCT pair_id, {_FORM.format(t='answer')} AS predicted, {_FORM.format(t='question')} AS gold FROM qa_results WHERE answer IS NOT NULL), w AS (SELECT *, list_filter(string_split(predicted, ' '), lambda t: t <> '') AS p, list_filter(string_split(gold, ' '), lambda t: t <> '') AS g FROM x), c AS (SELECT pair_id, predicted = gold AS em, len(p) AS np, len(g) AS ng, list_sum(list_transform(list_distinct(p), lambda t: least(len(list_filter(p, lambda y: y = t)), len(list_filter(g, lambda y: y = t))))) AS c FROM w) SELECT pair_id, CASE WHEN em THEN 1.0::DOUBLE ELSE 0 END AS em, round(CASE WHEN coalesce(c, 0) = 0 THEN 0 ELSE 2.0 * c / (np + ng) END, 6)::DOUBLE AS f1 FROM c")
def em_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact match and F1 of answers against their questions' words."""
    rows = table(spark, sf_dir, "qa_results").where("answer IS NOT NULL").selectExpr("pair_id", f"{X.answer_form('answer')} AS predicted", f"{X.answer_form('question')} AS gold").distinct()
    return M.token_scores(rows, ["pair_id"]).selectExpr("pair_id", "em", "round(f1, 6) AS f1")


@registry.add("metadata_completeness", "WITH t AS (SELECT count(*) AS total FROM events), k AS (SELECT unnest(json_keys(props)) AS key FROM events) SELECT key, count(*) AS n, round(count(*) * 100.0 / any_value(total), 2)::DOUBLE AS pct FROM k, t GROUP BY key")
def metadata_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A25, F10."""
    e = table(spark, sf_dir, "events")
    total = F.broadcast(e.agg(F.count("*").alias("total")))  # one row
    return e.selectExpr("explode(json_object_keys(props)) AS key").groupBy("key").agg(F.count("*").alias("n")).join(total).selectExpr("key", "n", "round(n * 100.0D / total, 2) AS pct")


@registry.add("interleave_cycle", "WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS round FROM documents), m AS (SELECT min(n) AS least FROM (SELECT count(*) AS n FROM documents GROUP BY source)) SELECT doc_id, source, CAST(row_number() OVER (ORDER BY round, source) AS BIGINT) AS pos FROM r, m WHERE round <= least")
def interleave_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U8, U4: documents of all sources in turn, until the smallest source ends."""
    return P.interleave_cycle(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id").selectExpr("doc_id", "source", "CAST(pos AS bigint) AS pos")


#: Draws by weight: as many as there are documents, in batches of four of one source.
_WEIGHTED = """t AS (SELECT source, max(target_share) AS w FROM mix_targets WHERE source IN (SELECT source FROM documents) GROUP BY source), c AS (SELECT source, sum(w) OVER (ORDER BY source ROWS UNBOUNDED PRECEDING) / sum(w) OVER () AS high, (sum(w) OVER (ORDER BY source ROWS UNBOUNDED PRECEDING) - w) / sum(w) OVER () AS low FROM t),
d AS (SELECT i AS pos, CAST(concat('0x', md5(CAST(i // 4 AS VARCHAR) || ':1')[1:8]) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM range((SELECT count(*) FROM documents)) r(i)), s AS (SELECT d.pos, c.source, row_number() OVER (PARTITION BY c.source ORDER BY d.pos) - 1 AS turn FROM d JOIN c ON d.u >= c.low AND d.u < c.high),
n AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS r, count(*) OVER (PARTITION BY source) AS size FROM documents)"""


@registry.add("interleave_weighted", f"WITH {_WEIGHTED} SELECT s.pos, s.source, n.doc_id, CAST(turn // size AS BIGINT) AS epoch FROM s JOIN n ON n.source = s.source AND n.r = s.turn % n.size")
def interleave_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U8: documents drawn by the weights of their sources, in batches of one source, sources starting again at their end."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id")
    targets = table(spark, sf_dir, "mix_targets").groupBy("source").agg(F.max("target_share").alias("w")).join(d.select("source").distinct(), "source", "left_semi")
    weights = {r["source"]: r["w"] for r in targets.collect()}  # one row a target
    return P.interleave_weighted(d, "source", "doc_id", weights, d.count(), batch=4).select("pos", "source", "doc_id", "epoch")


@registry.add("natural_order", "SELECT DISTINCT subject, regexp_extract(subject, '^S([0-9]+)', 1)::BIGINT AS n, CAST(dense_rank() OVER (ORDER BY regexp_extract(subject, '^S([0-9]+)', 1)::BIGINT, subject) AS INTEGER) AS rank FROM (SELECT DISTINCT subject FROM captions_a WHERE subject IS NOT NULL)")
def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects by the number in their name; the rank is over subjects, not over captions."""
    s = table(spark, sf_dir, "captions_a").where("subject IS NOT NULL").select("subject").distinct()
    return s.selectExpr("subject", "CAST(regexp_extract(subject, '^S([0-9]+)', 1) AS bigint) AS n").selectExpr("subject", "n", "dense_rank() OVER (ORDER BY n, subject) AS rank")


@registry.add("qrels_map", "WITH g AS (SELECT id AS qid, judge_id AS doc, max(raw_score) AS score FROM eval_results WHERE raw_score > 0 AND raw_score <= 5 AND judge_id IS NOT NULL GROUP BY ALL) SELECT qid, count(*) AS docs, CAST(sum(score) AS BIGINT) AS total, max(score) AS best FROM g GROUP BY qid")
def qrels_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best positive score of each pair, summed up by query."""
    g = table(spark, sf_dir, "eval_results").where("raw_score > 0 AND raw_score <= 5 AND judge_id IS NOT NULL").groupBy(F.col("id").alias("qid"), F.col("judge_id").alias("doc")).agg(F.max("raw_score").alias("score"))
    return g.groupBy("qid").agg(F.count("*").alias("docs"), F.sum("score").cast("bigint").alias("total"), F.max("score").alias("best"))


@registry.add("label_pools", "SELECT label, count(*) AS own, CAST((SELECT count(*) FROM embeddings) - count(*) AS BIGINT) AS others, min(vec_id) AS first_id FROM embeddings GROUP BY label")
def label_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of each label's pool of positives and of negatives."""
    e = table(spark, sf_dir, "embeddings")
    return e.groupBy("label").agg(F.count("*").alias("own"), F.min("vec_id").alias("first_id")).join(F.broadcast(e.agg(F.count("*").alias("total")))).selectExpr("label", "own", "total - own AS others", "first_id")


@registry.add("contrastive_loss", f"WITH {_RANK}, b AS (SELECT query, min(rank) AS first FROM r WHERE rel GROUP BY query), x AS (SELECT r.query, score / 0.05 AS x, rank = first AS pos FROM r JOIN b ON b.query = r.query), m AS (SELECT query, max(x) AS top FROM x GROUP BY query) SELECT x.query, round(ln(sum(exp(x - top))) + any_value(top) - max(CASE WHEN pos THEN x END), 6) AS loss FROM x JOIN m ON m.query = x.query GROUP BY x.query")
def contrastive_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss of the nearest vector of the same label among all others."""
    e = table(spark, sf_dir, "embeddings")
    items = e.selectExpr("vec_id AS id", "embedding AS v", "label AS kind", "label AS `group`")
    q = e.where("vec_id % 50 = 0").selectExpr("vec_id AS query", "embedding AS v", "label AS `group`")
    own = similar(q, items, 2, dim=64, group=True).where("id <> query").groupBy("query").agg(F.max("score").alias("pos"))
    return softmax_mass(q, items, 0.05, dim=64).join(own, "query").selectExpr("query", "round(log_mass - pos / 0.05D, 6) AS loss")


@registry.add("subset_questions", "WITH a AS (SELECT DISTINCT subject FROM captions_a WHERE granularity = '1h' AND subject IS NOT NULL), q AS (SELECT DISTINCT id, subject FROM qa_mcq) SELECT id FROM q WHERE subject IN (SELECT subject FROM a)")
def subset_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of subjects that have hourly captions."""
    have = table(spark, sf_dir, "captions_a").where("granularity = '1h'").select("subject").distinct()
    return table(spark, sf_dir, "qa_mcq").select("id", "subject").distinct().join(have, "subject", "left_semi").select("id")


@registry.add("long_names", "SELECT DISTINCT key, CASE WHEN length(key) > 36 THEN substr(key, 1, 30) || '_' || substr(md5(key), 1, 8) || '.mp4' ELSE key END AS name FROM visual_embeddings")
def long_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K10."""
    return table(spark, sf_dir, "visual_embeddings").selectExpr("key", "CASE WHEN length(key) > 36 THEN concat(substr(key, 1, 30), '_', substr(md5(key), 1, 8), '.mp4') ELSE key END AS name").distinct()


@registry.add("target_times", "WITH q AS (SELECT DISTINCT id, target_time.date AS date, coalesce(target_time.time_list, [target_time.time]) AS times FROM qa_mcq), u AS (SELECT id, date, unnest(times) AS t FROM q) SELECT id, count(*) AS times, min(lpad(t, 8, '0')) AS first_time, max(lpad(t, 8, '0')) AS last_time FROM u WHERE regexp_full_match(t, '[0-9]{1,8}') GROUP BY id")
def target_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One or several target times of each question."""
    raw = table(spark, sf_dir, "qa_mcq").selectExpr("id", "target_time").distinct().selectExpr("id", "explode(coalesce(target_time.time_list, array(target_time.time))) AS t")
    return raw.where("t RLIKE '^[0-9]{1,8}\\\\z'").groupBy("id").agg(F.count("*").alias("times"), F.min(F.lpad("t", 8, "0")).alias("first_time"), F.max(F.lpad("t", 8, "0")).alias("last_time"))


@registry.add("near_duplicates")
def near_duplicate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose five-word shingles overlap by 0.8 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")


@registry.add("stratified_sample", "WITH z AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), pl AS (SELECT label, CAST(ceil(100.0 / count(*) OVER ()) AS BIGINT) AS per, n FROM z), pb AS (SELECT label, per, coalesce(sum(least(n, per)) OVER (ORDER BY n, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pl), d AS (SELECT e.vec_id, e.label, per, before, CAST(concat('0x', md5(CAST(vec_id AS VARCHAR) || ':7')[1:12]) AS BIGINT) AS h FROM embeddings e JOIN pb ON pb.label = e.label), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, vec_id) AS r FROM d) SELECT vec_id, label FROM (SELECT * FROM r ORDER BY CASE WHEN r <= per AND before + r <= 100 THEN 0 ELSE 1 END, h, vec_id LIMIT 100)")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: 100 vectors over all labels alike."""
    return P.stratified(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "label", "vec_id", 100, 7)
