"""Queries over extraction records, triples, graphs and vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import entity_key
from tidemark.operators import chains as C
from tidemark.operators import graph as G
from tidemark.operators import retrieve as R
from tidemark.operators.knn import similar
from tidemark.operators.slices import following
from tidemark.operators.temporal import DAY, quota_rank
from tidemark.plans.temporal import CAPS, captions
from tidemark.registry import Registry
from tidemark.runtime import table
from tidemark.sources import store as S
from tidemark.sources.records import extraction_records, triples_of

registry = Registry()

#: recs(resp_id, chunk_id, subject, created_at, es, ts), tri(..., s, p, o), ent(resp_id, chunk_id, subject, created_at, name) in SQL.
RECS = """
r0 AS (SELECT DISTINCT ON (resp_id) *, CASE WHEN named_entities IS NULL AND triples IS NULL AND json_valid(raw_output) THEN raw_output END AS j FROM openie_raw),
recs AS (SELECT resp_id, chunk_id, subject, created_at, coalesce(named_entities, CAST(j->'$.named_entities' AS VARCHAR[])) AS es, coalesce(triples, CAST(j->'$.triples' AS VARCHAR[][])) AS ts FROM r0 WHERE named_entities IS NOT NULL OR triples IS NOT NULL OR j IS NOT NULL),
t0 AS (SELECT DISTINCT resp_id, chunk_id, subject, created_at, unnest(list_distinct(list_filter(ts, lambda t: len(t) = 3))) AS t FROM recs),
tri AS (SELECT resp_id, chunk_id, subject, created_at, t[1] AS s, t[2] AS p, t[3] AS o FROM t0),
ent AS (SELECT resp_id, chunk_id, subject, created_at, unnest(es) AS name FROM recs)
"""
_KEY = "CASE WHEN {n} IN ('I', 'i', 'me', 'Me', 'my', 'My') THEN translate(lower({p}), '/-', '__') ELSE replace(translate(lower({n}), ' -', '__'), '''', '') END"
KEY = _KEY.format(n="name", p="coalesce(subject, '')")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction_records(table(spark, sf_dir, "openie_raw"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(resp_id, chunk_id, subject, created_at, name, id) for each mention."""
    rows = records(spark, sf_dir).select("resp_id", "chunk_id", "subject", "created_at", F.explode("entities").alias("name"))
    return rows.withColumn("id", F.expr(f"concat('ent_', {entity_key('name', 'coalesce(subject, \"\")')})"))


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triples_of(records(spark, sf_dir))


@registry.add("openie_stats", f"WITH {RECS} SELECT count(*) AS mentions, round(avg(length(name)), 4) AS avg_chars, round(avg(len(string_split(name, ' '))), 4) AS avg_words FROM ent")
def openie_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S13."""
    return entities(spark, sf_dir).agg(F.count("*").alias("mentions"), F.round(F.avg(F.length("name")), 4).alias("avg_chars"), F.round(F.avg(F.size(F.split("name", " "))), 4).alias("avg_words"))


@registry.add("valid_triples", f"WITH {RECS} SELECT DISTINCT resp_id, s, p, o FROM tri")
def valid_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5, S4, A8."""
    return triples(spark, sf_dir).select("resp_id", "s", "p", "o").distinct()


@registry.add("entity_ids", f"WITH {RECS} SELECT DISTINCT name, 'ent_' || {KEY} AS id FROM ent")
def entity_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X8, A7."""
    return entities(spark, sf_dir).select("name", "id").distinct()


@registry.add("mentioned_in", f"WITH {RECS} SELECT 'ent_' || {KEY} AS src, chunk_id AS dst, count(*) AS times FROM ent GROUP BY ALL")
def mentioned_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from entities to chunks with the number of mentions."""
    return entities(spark, sf_dir).groupBy(F.col("id").alias("src"), F.col("chunk_id").alias("dst")).agg(F.count("*").alias("times"))


@registry.add("has_property", f"WITH {RECS}, ids AS (SELECT DISTINCT {KEY} AS k FROM ent), x AS (SELECT resp_id, p, {_KEY.format(n='s', p='subject')} AS ks, {_KEY.format(n='o', p='subject')} AS ko FROM (SELECT resp_id, s, p, o, coalesce(subject, '') AS subject FROM tri)) SELECT resp_id, 'ent_' || ks AS src, p, 1.0::DOUBLE AS weight FROM x WHERE ks IN (SELECT k FROM ids) UNION ALL SELECT resp_id, 'ent_' || ko, p, 0.5 FROM x WHERE ko IN (SELECT k FROM ids)")
def has_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A triple belongs to its subject, and half to its object, where these are entities."""
    ids = entities(spark, sf_dir).select(F.col("id").alias("src")).distinct()
    t = triples(spark, sf_dir).withColumn("person", F.coalesce("subject", F.lit("")))
    ends = t.select("resp_id", "p", F.expr(f"inline(array(struct(concat('ent_', {entity_key('s', 'person')}) AS src, 1D AS weight), struct(concat('ent_', {entity_key('o', 'person')}) AS src, 0.5D AS weight)))"))
    return ends.join(ids, "src", "left_semi").select("resp_id", "src", "p", "weight")


@registry.add("entity_lifespan", f"WITH {RECS} SELECT 'ent_' || {KEY} AS id, arg_min(name, struct_pack(a := created_at, b := resp_id, c := name)) AS name, epoch_us(min(created_at)) AS first_seen, epoch_us(max(created_at)) AS end_ts, count(*) AS frequency FROM ent GROUP BY 1")
def entity_lifespan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, A2: entities merged by id."""
    nodes = entities(spark, sf_dir).select("id", "name", F.unix_micros("created_at").alias("first_seen"), F.unix_micros("created_at").alias("end_ts"), F.struct("created_at", "resp_id", "name").alias("ord"))
    return G.merge_nodes(nodes).select("id", "name", "first_seen", "end_ts", "frequency")


@registry.add("co_occurrence", f"WITH {RECS}, d AS (SELECT s, o FROM tri WHERE s <> o), b AS (SELECT s AS src, o AS dst FROM d UNION ALL SELECT o, s FROM d) SELECT src, dst, CAST(count(*) AS DOUBLE) AS weight FROM b GROUP BY ALL")
def co_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5."""
    return G.co_occurrence(triples(spark, sf_dir))


@registry.add("edge_dedup", f"WITH {RECS}, e AS (SELECT least(s, o) AS a, greatest(s, o) AS b, CAST(length(p) AS DOUBLE) AS weight, struct_pack(i := resp_id, s := s, p := p, o := o) AS ord FROM tri WHERE s <> o) SELECT a, b, arg_min(weight, ord) AS weight FROM e GROUP BY a, b")
def edge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first edge of each unordered pair; ties end at the triple itself."""
    t = triples(spark, sf_dir)
    return G.undirected(t.select(F.col("s").alias("src"), F.col("o").alias("dst"), F.length("p").cast("double").alias("weight"), F.struct("resp_id", "s", "p", "o").alias("ord")))


@registry.add("entity_documents", f"WITH {RECS} SELECT {KEY} AS entity, count(DISTINCT chunk_id) AS chunks FROM ent GROUP BY 1")
def entity_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many chunks each entity stands."""
    return entities(spark, sf_dir).groupBy(F.expr("substr(id, 5)").alias("entity")).agg(F.countDistinct("chunk_id").alias("chunks"))


@registry.add("graph_info", f"WITH {RECS} SELECT (SELECT count(DISTINCT {KEY}) FROM ent) AS entities, (SELECT count(DISTINCT chunk_id) FROM recs) AS passages, (SELECT count(*) FROM (SELECT DISTINCT s, p, o FROM tri)) AS facts, (SELECT count(*) FROM (SELECT DISTINCT least(s, o), greatest(s, o) FROM tri WHERE s <> o)) AS pairs")
def graph_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4, A37."""
    t = triples(spark, sf_dir)
    parts = [
        entities(spark, sf_dir).agg(F.countDistinct("id").alias("entities")), records(spark, sf_dir).agg(F.countDistinct("chunk_id").alias("passages")),
        t.select("s", "p", "o").distinct().agg(F.count("*").alias("facts")), t.where("s <> o").selectExpr("least(s, o) AS a", "greatest(s, o) AS b").distinct().agg(F.count("*").alias("pairs")),
    ]
    return reduce(lambda a, b: a.join(F.broadcast(b)), parts)  # one row each


@registry.add("graph_stats", f"WITH {CAPS} SELECT granularity, CAST(day AS BIGINT) AS day, count(*) AS nodes FROM caps GROUP BY ROLLUP (granularity, day)")
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: node counts by type and day, with totals."""
    return captions(spark, sf_dir).rollup("granularity", "day").agg(F.count("*").alias("nodes"))


_MONTHLY = "snap AS (SELECT DISTINCT date_trunc('month', l_shipdate) AS ts, l_suppkey AS s, l_returnflag AS p, l_partkey AS o FROM lineitem)"
AS_OF = "1996-06-15"


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr("CAST(date_trunc('month', l_shipdate) AS timestamp) AS ts", "l_suppkey AS s", "l_returnflag AS p", "l_partkey AS o").distinct()


@registry.add("semantic_snapshot", f"WITH {_MONTHLY} SELECT s, p, o FROM snap WHERE ts = (SELECT max(ts) FROM snap WHERE ts <= TIMESTAMP '{AS_OF}')")
def semantic_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The triples of the latest monthly snapshot that is not later than a time."""
    li = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") < F.lit(AS_OF).cast("timestamp") + F.expr("INTERVAL 31 DAYS"))
    month = li.selectExpr("date_trunc('month', l_shipdate) AS ts").where(F.col("ts") <= F.lit(AS_OF).cast("timestamp")).agg(F.max("ts").alias("last"))
    rows = li.selectExpr("date_trunc('month', l_shipdate) AS ts", "l_suppkey AS s", "l_returnflag AS p", "l_partkey AS o")
    return rows.join(F.broadcast(month), F.col("ts") == F.col("last")).select("s", "p", "o").distinct()


#: Steps of the plain walk in SQL; what is undecided after them, 0.85 to that power, lies below what is compared.
SQL_STEPS = 250
_WALK = """d AS (SELECT s, o FROM tri WHERE s <> o), b AS (SELECT s AS src, o AS dst FROM d UNION ALL SELECT o, s FROM d), e AS (SELECT src, dst, CAST(count(*) AS DOUBLE) AS weight FROM b GROUP BY ALL),
st AS MATERIALIZED (SELECT src, sum(weight) AS total FROM e GROUP BY src), step AS MATERIALIZED (SELECT e.src, dst, weight / total AS part FROM e JOIN st ON st.src = e.src)"""
_PPR = f"""WITH RECURSIVE {RECS}, {_WALK}, start AS MATERIALIZED (SELECT src AS id, 1.0::DOUBLE / count(*) OVER () AS p FROM st WHERE src LIKE 'S%' OR src LIKE 'M%'),
w AS (SELECT 0 AS k, id, p AS score FROM start UNION ALL SELECT k, id, sum(x) FROM (SELECT w.k + 1 AS k, dst AS id, 0.85 * w.score * part AS x FROM w JOIN step ON step.src = w.id WHERE w.k < {SQL_STEPS}
  UNION ALL SELECT m.k + 1, start.id, 0.15 * p FROM start, (SELECT max(k) AS k FROM w) m WHERE m.k < {SQL_STEPS}) GROUP BY k, id)
SELECT id, round(score, 9) AS score FROM w WHERE k = {SQL_STEPS}"""


@registry.add("personalized_pagerank", _PPR)
def personalized_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where walks over the entities of all triples that restart at names with S or M in front settle; every node reached."""
    edges = G.co_occurrence(triples(spark, sf_dir))
    starts = edges.select("src").distinct().where("src LIKE 'S%' OR src LIKE 'M%'").selectExpr("src AS id", "1D / count(*) OVER () AS p")
    return G.settled_pagerank(edges, starts, 0.85).selectExpr("id", "round(score, 9) AS score")


@registry.add("caption_components", f"WITH {CAPS}, l AS (SELECT id, subject, start_ts, end_ts, lag(end_ts) OVER (PARTITION BY subject ORDER BY start_ts, id) AS e FROM caps WHERE granularity = '30sec'), g AS (SELECT *, sum(CASE WHEN e IS NULL OR start_ts - e > 30 OR start_ts < e THEN 1 ELSE 0 END) OVER (PARTITION BY subject ORDER BY start_ts, id ROWS UNBOUNDED PRECEDING) AS k FROM l) SELECT id, min(id) OVER (PARTITION BY subject, k) AS component FROM g QUALIFY count(*) OVER (PARTITION BY subject, k) > 1")
def caption_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected components of captions that follow each other within half a minute."""
    fine = captions(spark, sf_dir).where("granularity = '30sec'").selectExpr("subject", "id AS a", "start_ts", "end_ts")
    nxt = following(fine, ["subject"], ["start_ts", "a"], DAY, {"b": "a", "then": "start_ts"}).selectExpr("a", "b", "then - end_ts AS gap")
    return G.components(nxt.where("b IS NOT NULL AND gap BETWEEN 0 AND 30").select("a", "b"))


# --- vectors -------------------------------------------------------------------------------------------

_COS = "list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))"


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(queries, items): every row whose id is divisible by 50 asks, all rows answer."""
    e = table(spark, sf_dir, "embeddings")
    return e.where("vec_id % 50 = 0").selectExpr("vec_id AS query", "embedding AS v"), e.selectExpr("vec_id AS id", "embedding AS v", "CAST(label AS string) AS kind")


def _round(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


_ROUNDED = "s AS (SELECT q.vec_id AS query, v.vec_id AS id, CAST(v.label AS VARCHAR) AS kind, round({cos}, 9) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 {more})"


@registry.add("asof_topk_quota", f"WITH {_ROUNDED.format(cos=_COS, more='AND v.vec_id * 30 <= q.vec_id * 30 + 6000')}, k AS (SELECT *, row_number() OVER (PARTITION BY query, kind ORDER BY score DESC, id) AS kr FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM k WHERE kr <= CASE kind WHEN '0' THEN 3 WHEN '1' THEN 2 WHEN '2' THEN 0 ELSE 4 END) SELECT query, id, kind, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 16")
def asof_topk_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each query may see, ranked by similarity under quotas."""
    q, items = vectors(spark, sf_dir)
    scored = similar(q.withColumn("until", F.expr("query * 30 + 6000")), items.withColumn("t", F.expr("id * 30")), 4, dim=64, per_kind=True, until=True).drop("rank")
    return _round(quota_rank(scored, ["query"], "kind", {"0": 3, "1": 2, "2": 0} | {str(k): 4 for k in range(3, 10)}, 16)).select("query", "id", "kind", "score", "rank")


@registry.add("granularity_topk", f"WITH {_ROUNDED.format(cos=_COS, more='')}, k AS (SELECT *, row_number() OVER (PARTITION BY query, kind ORDER BY score DESC, id) AS rank FROM s WHERE kind IN ('0', '1', '2', '3')) SELECT query, id, kind, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= CASE kind WHEN '0' THEN 10 WHEN '3' THEN 3 ELSE 5 END")
def granularity_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of each kind for each query, as many as the kind allows; four labels stand for four granularities."""
    q, items = vectors(spark, sf_dir)
    return _round(similar(q, items.where("kind IN ('0', '1', '2', '3')"), 10, dim=64, per_kind=True).where("rank <= CASE kind WHEN '0' THEN 10 WHEN '3' THEN 3 ELSE 5 END"))


_KNN = f"s AS (SELECT q.vec_id AS query, v.vec_id AS id, CAST(v.label AS VARCHAR) AS kind, {_COS} AS score FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 {{pre}}), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s) SELECT query, id, kind, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10 {{post}}"


@registry.add("prefilter_knn", "WITH " + _KNN.format(pre="AND v.label IN (1, 3, 5)", post=""))
def prefilter_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter holds before the ranking."""
    return _round(R.nearest(*vectors(spark, sf_dir), 10, where="kind IN ('1', '3', '5')"))


@registry.add("postfilter_knn", "WITH " + _KNN.format(pre="", post="AND kind IN ('1', '3', '5')"))
def postfilter_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter holds after the ranking."""
    return _round(R.nearest(*vectors(spark, sf_dir), 10, after="kind IN ('1', '3', '5')"))


_USABLE = "ve AS (SELECT DISTINCT ON (vec_id) vec_id, embedding FROM visual_embeddings WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0)))"


def clip_vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(queries, items) of the clips' vectors: every row whose id is divisible by 50 asks, all rows answer."""
    v = table(spark, sf_dir, "visual_embeddings").dropDuplicates(["vec_id"])
    return v.where("vec_id % 50 = 0").selectExpr("vec_id AS query", "embedding AS v"), v.selectExpr("vec_id AS id", "embedding AS v", "'' AS kind")


def _edges_sql(floor: float, k: int) -> str:
    return f"WITH {_USABLE}, {_ROUNDED.format(cos=_COS, more='AND q.vec_id <> v.vec_id').replace('embeddings q, embeddings v', 've q, ve v').replace(', CAST(v.label AS VARCHAR) AS kind', '')} SELECT query, id, round(score, 6) AS score FROM s WHERE score >= {floor} QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, id) <= {k}"


@registry.add("synonym_edges", _edges_sql(0.8, 101))
def synonym_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of 2,047 nearest neighbours those with a cosine of 0.8 at least, at most 101 of them."""
    q, items = clip_vectors(spark, sf_dir)
    near = similar(q, items, 2048, dim=64, floor=0.8).where("id <> query")
    return _round(R.top(near.drop("rank"), ["query"], 101)).select("query", "id", "score")


@registry.add("relevant_facts", _edges_sql(0.6, 20))
def relevant_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty most similar ones, then those of 0.6 at least."""
    q, items = clip_vectors(spark, sf_dir)
    near = similar(q, items, 21, dim=64).where("id <> query")
    return _round(R.top(near.drop("rank"), ["query"], 20).where("score >= 0.6")).select("query", "id", "score")


@registry.add("cross_group_merge", f"WITH {_ROUNDED.format(cos=_COS, more='')}, t AS (SELECT *, row_number() OVER (PARTITION BY query, kind ORDER BY score DESC, id) AS k FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM t WHERE k <= 5) SELECT query, id, kind, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 8")
def cross_group_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of each group, merged and ranked again, with the group they come from."""
    q, items = vectors(spark, sf_dir)
    return _round(R.top(similar(q, items, 5, dim=64, per_kind=True).drop("rank"), ["query"], 8))


# --- text search ---------------------------------------------------------------------------------------

#: Queries of the text searches: every question whose number is divisible by 50.
_NUMBER = "CAST(regexp_extract(id, '([0-9]+)$', 1) AS BIGINT)"
_ASKED = f"asked AS (SELECT DISTINCT {_NUMBER} AS query, subject, question AS text FROM qa_mcq WHERE {_NUMBER} % 50 = 0 AND question IS NOT NULL)"
#: All questions.
_ALL_ASKED = f"asked AS (SELECT DISTINCT {_NUMBER} AS query, subject, question AS text FROM qa_mcq WHERE question IS NOT NULL)"


def asked(spark: SparkSession, sf_dir: str, every: int = 50) -> DataFrame:
    number = "CAST(regexp_extract(id, '([0-9]+)$', 1) AS bigint)"
    wanted = "question IS NOT NULL" if every == 1 else f"{number} % {every} = 0 AND question IS NOT NULL"
    return table(spark, sf_dir, "qa_mcq").where(wanted).selectExpr(f"{number} AS query", "subject", "question AS text").distinct()


_SCORES = """docs AS (SELECT id, text FROM (SELECT doc_id AS id, text FROM documents WHERE text IS NOT NULL)),
tf AS (SELECT id, word, count(*) AS tf FROM (SELECT id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS word FROM docs) WHERE word <> '' GROUP BY ALL), dl AS (SELECT id, sum(tf) AS dl FROM tf GROUP BY id),
n AS (SELECT count(*) AS n_docs FROM docs), av AS (SELECT sum(dl) / (SELECT n_docs FROM n) AS avg_dl FROM dl), idf AS (SELECT word, ln(n_docs - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM tf, n GROUP BY word, n_docs), mean AS (SELECT avg(idf) AS m FROM idf),
a AS (SELECT query, word, count(*) AS times FROM (SELECT query, unnest(regexp_split_to_array(lower(text), '\\s+')) AS word FROM asked) WHERE word <> '' GROUP BY ALL),
bm AS (SELECT query, tf.id, sum(times * CASE WHEN idf < 0 THEN 0.25 * m ELSE idf END * tf.tf * 2.5 / (tf.tf + 1.5 * (0.25 + 0.75 * dl / avg_dl))) AS score FROM a JOIN idf ON idf.word = a.word JOIN tf ON tf.word = a.word JOIN dl ON dl.id = tf.id, av, mean GROUP BY query, tf.id)"""
_BM25, _ALL_BM25 = f"{_ASKED}, {_SCORES}", f"{_ALL_ASKED}, {_SCORES}"


def best_texts(spark: SparkSession, sf_dir: str, k: int, every: int = 50) -> DataFrame:
    """(query, id, score, rank): the ``k`` best documents of each question; sums come in any order, so ties are decided on nine digits, but scores are whole."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").selectExpr("doc_id AS id", "text")
    return R.bm25_top(docs, asked(spark, sf_dir, every).select("query", "text"), k)


@registry.add("bm25_topk", f"WITH {_BM25} SELECT query, id, round(score, 6) AS score FROM bm WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(bm.score, 9) DESC, id) <= 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R3, T2."""
    return _round(best_texts(spark, sf_dir, 10)).select("query", "id", "score")


# --- stores --------------------------------------------------------------------------------------------


@registry.add("keyed_upsert", "WITH a AS (SELECT DISTINCT 'chunk-' || md5(text) AS hash_id, 'old' AS origin FROM documents WHERE text IS NOT NULL AND source = 'diary_hub'), b AS (SELECT DISTINCT 'chunk-' || md5(text) AS hash_id FROM documents WHERE text IS NOT NULL) SELECT * FROM a UNION ALL SELECT hash_id, 'new' FROM b WHERE hash_id NOT IN (SELECT hash_id FROM a)")
def keyed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of one source's texts, with the texts of all others that it lacks."""
    d = S.keyed(table(spark, sf_dir, "documents").where("text IS NOT NULL"), "text", "chunk-")
    have = d.where("source = 'diary_hub'").select("hash_id", F.lit("old").alias("origin")).distinct()
    return S.upsert(have, d.select("hash_id", F.lit("new").alias("origin")))


@registry.add("cascade_delete", f"WITH {RECS}, links AS (SELECT DISTINCT chunk_id, {KEY} AS entity FROM ent), gone AS (SELECT DISTINCT chunk_id FROM recs WHERE subject = 'S1_MAELIN') SELECT entity FROM links GROUP BY entity HAVING bool_and(chunk_id IN (SELECT chunk_id FROM gone))")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that go when the chunks of one subject are deleted."""
    links = entities(spark, sf_dir).select("chunk_id", F.expr("substr(id, 5)").alias("entity")).distinct()
    return S.orphans(links, "chunk_id", "entity", records(spark, sf_dir).where("subject = 'S1_MAELIN'").select("chunk_id").distinct())


@registry.add("resume_todo", "SELECT DISTINCT id FROM qa_mcq WHERE id NOT IN (SELECT id FROM eval_results WHERE judge_response IS NOT NULL AND judge_response <> 'Error: timeout' AND split = 'auto' AND id IS NOT NULL)")
def resume_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions without a result of one split."""
    done = table(spark, sf_dir, "eval_results").where("split = 'auto' AND judge_response <> 'Error: timeout'")
    return S.resume(table(spark, sf_dir, "qa_mcq").select("id").distinct(), done, ["id"])


# --- chains --------------------------------------------------------------------------------------------


@registry.add("recurring_entities", f"WITH {RECS} SELECT subject, name AS entity, count(DISTINCT created_at) AS times FROM ent WHERE subject IS NOT NULL AND length(name) >= 2 GROUP BY ALL HAVING count(DISTINCT created_at) >= 2")
def recurring_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10, F6, R25."""
    return C.recurring(entities(spark, sf_dir).where("subject IS NOT NULL").selectExpr("subject", "name AS entity", "created_at AS ts"), 2)


#: Letters, digits and marks that may not stand beside a name, and the blanks around one.
_LETTER, _BLANKS = "[\\p{L}\\p{N}_]", "[\\s\\p{Z}]"
_HITS = f"""{CAPS}, {RECS}, named AS (SELECT DISTINCT subject, name, regexp_replace(lower(name), '^{_BLANKS}+|{_BLANKS}+$', '', 'g') AS low FROM ent WHERE subject IS NOT NULL AND name IS NOT NULL),
forms AS (SELECT DISTINCT subject, name, unnest([low, replace(low, '-', ' '), replace(low, '-', ''), replace(low, ' ', '-'), replace(low, ' ', '')]) AS form FROM named),
pats AS (SELECT subject, name, form, '(^|[^\\p{{L}}\\p{{N}}_])' || regexp_escape(form) || '(s|es)?([^\\p{{L}}\\p{{N}}_]|$)' AS pattern FROM forms WHERE form <> ''),
hits AS (SELECT DISTINCT n.subject, n.name AS entity, c.id FROM pats n JOIN caps c ON c.subject = n.subject AND c.granularity = '30sec' AND contains(lower(c.text), n.form) AND regexp_matches(lower(c.text), n.pattern))"""


def entity_hits(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """Captions with names of entities; ``only`` (subject, entity) says which."""
    names = only if only is not None else entities(spark, sf_dir).where("subject IS NOT NULL").selectExpr("subject", "name AS entity").distinct()
    return C.keyword_hits(names, captions(spark, sf_dir).where("granularity = '30sec'"))


@registry.add("keyword_captions", f"WITH {_HITS} SELECT subject, entity, count(*) AS captions FROM hits GROUP BY ALL")
def keyword_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions that mention an entity as whole words."""
    return entity_hits(spark, sf_dir).groupBy("subject", "entity").agg(F.count("*").alias("captions"))
