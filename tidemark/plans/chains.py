"""Queries over chains of events and topics, injected facts, consolidated facts and mixed results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.models import STAND_INS
from tidemark.operators import chains as C
from tidemark.operators import memory_graph as G
from tidemark.operators import slices
from tidemark.operators import temporal as T
from tidemark.operators.knn import similar
from tidemark.plans.graph import _HITS, RECS, entity_hits, triples
from tidemark.plans.hybrid import _CLIP_VECTORS, _COS, _GRAPH, _NONZERO, coded_sql
from tidemark.plans.temporal import CAPS, MOMENTS, captions, moments
from tidemark.registry import Registry
from tidemark.runtime import cut, table

registry = Registry()

_STEPS = f"""{_GRAPH},
daily AS (SELECT subject, name, start_ts // 86400 + 1 AS day, min(start_ts) AS start_ts, max(end_ts) AS end_ts, count(*) AS n FROM men GROUP BY ALL HAVING count(*) >= 2),
joined AS (SELECT subject, lower(name) AS key, day, arg_min(name, struct_pack(a := start_ts, b := name)) AS name, min(start_ts) AS start_ts, max(end_ts) AS end_ts FROM daily WHERE NOT (start_ts = 0 AND end_ts = 0) GROUP BY ALL),
spans AS (SELECT subject, key, count(DISTINCT day) AS days, arg_min(name, struct_pack(a := start_ts, b := name)) AS chain FROM joined GROUP BY subject, key HAVING count(*) >= 2),
steps AS (SELECT j.subject, s.chain, row_number() OVER (PARTITION BY j.subject, j.key ORDER BY j.start_ts) AS step, j.day, j.start_ts, j.end_ts, s.days FROM joined j JOIN spans s ON s.subject = j.subject AND s.key = j.key)"""


def steps(caps: DataFrame) -> DataFrame:
    return C.event_chains(G.mentions(caps))


@registry.add("event_chains", f"WITH {_STEPS} SELECT subject, chain, step, CAST(day AS BIGINT) AS day, CAST(start_ts AS BIGINT) AS start_ts, CAST(end_ts AS BIGINT) AS end_ts, days FROM steps")
def event_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps by day, joined over days under one spelling."""
    return steps(captions(spark, sf_dir))


@registry.add("event_step_captions", f"WITH {_STEPS} SELECT s.subject, s.chain, s.step, count(*) AS captions, min(c.id) AS first_id FROM steps s JOIN caps c ON c.subject = s.subject AND c.day = s.day AND c.granularity IN ('30sec', '3min') AND c.start_ts BETWEEN s.start_ts AND s.end_ts GROUP BY ALL")
def event_step_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The captions of a step's day that begin within it."""
    caps = cut(captions(spark, sf_dir))
    points = caps.where("granularity IN ('30sec', '3min')").selectExpr("subject", "id", "start_ts AS t")
    return C.in_steps(steps(caps), points).groupBy("subject", "chain", "step").agg(F.count("*").alias("captions"), F.min("id").alias("first_id"))


_LATEST = "ret AS (SELECT subject, id, start_ts, end_ts, text FROM caps WHERE granularity = '30sec' QUALIFY row_number() OVER (PARTITION BY subject ORDER BY end_ts DESC, id) <= 40)"


def latest(caps: DataFrame) -> DataFrame:
    fine = caps.where("granularity = '30sec'").selectExpr("subject", "id", "start_ts", "end_ts", "text", "row_number() OVER (PARTITION BY subject ORDER BY end_ts DESC, id) AS k")
    return fine.where("k <= 40").drop("k")


@registry.add("event_step_hits", f"WITH {_STEPS}, {_LATEST} SELECT s.subject, s.chain, count(DISTINCT s.step) AS hits, count(*) AS episodes FROM steps s JOIN ret r ON r.subject = s.subject AND r.start_ts BETWEEN s.start_ts AND s.end_ts GROUP BY ALL HAVING count(DISTINCT s.step) >= 1")
def event_step_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many steps of each chain retrieved episodes begin in."""
    caps = cut(captions(spark, sf_dir))
    met = C.in_steps(steps(caps), latest(caps).selectExpr("subject", "id", "start_ts AS t"))
    return met.groupBy("subject", "chain").agg(F.countDistinct("step").alias("hits"), F.count("*").alias("episodes"))


_RETRIEVED = f"""{MOMENTS}, qn AS (SELECT CAST(regexp_extract(q.id, '([0-9]+)$', 1) AS BIGINT) AS query, q.subject, m.question AS text, q.t AS until FROM q JOIN (SELECT DISTINCT id, question FROM qa_mcq) m ON m.id = q.id WHERE m.question IS NOT NULL),
q2 AS (SELECT DISTINCT * FROM qn WHERE query % 50 = 0),
ret AS (SELECT query, c.subject, c.id, c.start_ts, c.text FROM q2 JOIN caps c ON c.subject = q2.subject AND c.granularity = '30sec' AND c.end_ts <= q2.until QUALIFY row_number() OVER (PARTITION BY query ORDER BY c.end_ts DESC, c.id) <= 40)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query, subject, text, until): every question whose number is divisible by 50, with its moment."""
    number = "CAST(regexp_extract(id, '([0-9]+)$', 1) AS bigint)"
    texts = table(spark, sf_dir, "qa_mcq").where("question IS NOT NULL").select("id", "question").distinct()
    return moments(spark, sf_dir).where(f"{number} % 50 = 0").join(texts, "id").selectExpr(f"{number} AS query", "subject", "question AS text", "t AS until").distinct()


def retrieved(caps: DataFrame, asked: DataFrame, most: int = 40) -> DataFrame:
    """(query, subject, id, start_ts, text): the latest episodes that each question may see."""
    fine = caps.where("granularity = '30sec'").select("subject", "id", "start_ts", "end_ts", "text")
    seen = fine.join(asked.select("query", "subject", "until"), "subject").where("end_ts <= until")
    return seen.selectExpr("*", "row_number() OVER (PARTITION BY query ORDER BY end_ts DESC, id) AS k").where(f"k <= {most}").select("query", "subject", "id", "start_ts", "text")


_NAMED = "'(^|[^\\p{L}\\p{N}_])' || lower(entity) || '(s|es)?([^\\p{L}\\p{N}_]|$)'"
_INJECTED = f"""{_GRAPH}, {_RETRIEVED}, ft AS (SELECT DISTINCT subject, s AS entity, CAST(ts AS BIGINT) AS t, s || ' ' || p || ' ' || o AS fact FROM facts),
tp AS (SELECT DISTINCT subject, entity FROM ft), coarse AS (SELECT query, ret.subject, entity, count(*) AS n FROM ret JOIN tp ON tp.subject = ret.subject AND regexp_matches(lower(ret.text), {_NAMED}) GROUP BY ALL HAVING count(*) >= 2),
nm AS (SELECT coarse.*, regexp_matches(lower(q2.text), {_NAMED}) AS named, q2.until, q2.text FROM coarse JOIN q2 ON q2.query = coarse.query),
first AS (SELECT query, subject, entity, until FROM nm WHERE named QUALIFY row_number() OVER (PARTITION BY query ORDER BY n DESC, entity) <= 3),
tl AS (SELECT subject, entity, substr(string_agg(fact, ' ' ORDER BY t, fact), 1, 2000) AS told FROM ft GROUP BY ALL), tv AS (SELECT subject, entity, {coded_sql('told', 16)} AS v FROM tl), qv AS (SELECT query, {coded_sql('text', 16)} AS qv FROM q2),
sc AS (SELECT nm.query, nm.subject, nm.entity, nm.until, {_COS.format(a='qv', b='v')} AS score FROM nm JOIN tv ON tv.subject = nm.subject AND tv.entity = nm.entity JOIN qv ON qv.query = nm.query WHERE NOT named AND {_NONZERO.format(v='v')} AND {_NONZERO.format(v='qv')}),
sr AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, entity) AS k FROM sc WHERE score >= 0.5),
second AS (SELECT sr.query, subject, entity, until FROM sr LEFT JOIN (SELECT query, count(*) AS taken FROM first GROUP BY query) x ON x.query = sr.query WHERE k <= 3 - coalesce(taken, 0)),
chosen AS (SELECT *, 1 AS tier FROM first UNION ALL SELECT *, 2 FROM second),
inj AS (SELECT DISTINCT c.query, c.entity, c.tier, ft.t, ft.fact FROM chosen c JOIN ft ON ft.subject = c.subject AND ft.entity = c.entity AND ft.t <= c.until WHERE NOT EXISTS (SELECT 1 FROM ret WHERE ret.query = c.query AND abs(ret.start_ts - ft.t) <= 60))"""


def injected(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    caps, q = cut(captions(spark, sf_dir)), cut(questions(spark, sf_dir))
    got = cut(retrieved(caps, q))
    facts = G.period_facts(caps).selectExpr("subject", "s AS entity", "ts AS t", "concat_ws(' ', s, p, o) AS fact").distinct()
    return C.inject(got, q, cut(facts)), got, q


@registry.add("chain_injection", f"WITH {_INJECTED} SELECT query, entity, CAST(tier AS INTEGER) AS tier, t, fact FROM inj")
def chain_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of the topics that a question's retrieved episodes mention: those it names, then those alike it."""
    return injected(spark, sf_dir)[0].select("query", "entity", "tier", "t", "fact")


@registry.add("mixed_results", f"WITH {_INJECTED}, items AS (SELECT query, start_ts + 0.0 AS tm, 0 AS late, 'ep_' || id AS item FROM ret UNION ALL SELECT ret.query, ret.start_ts + 0.5, 0, 'vis_' || ret.id FROM ret JOIN caps ON caps.id = ret.id AND caps.video_path IS NOT NULL UNION ALL SELECT query, t + 0.0, 0, 'fact_' || fact FROM (SELECT DISTINCT query, t, fact FROM inj) UNION ALL SELECT query, 0.0, 1, 'label_' || entity FROM (SELECT DISTINCT query, entity FROM inj)) SELECT query, item, CAST(row_number() OVER (PARTITION BY query ORDER BY late, tm, item) AS INTEGER) AS pos FROM items")
def mixed_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes, clips half a second later and injected facts in order of time, what has no time last."""
    facts, got, _ = injected(spark, sf_dir)
    facts = cut(facts)
    paths = captions(spark, sf_dir).where("granularity = '30sec' AND video_path IS NOT NULL").select("id").distinct()
    parts = [
        got.selectExpr("query", "CAST(start_ts AS double) AS tm", "0 AS late", "concat('ep_', id) AS item"), got.join(paths, "id", "left_semi").selectExpr("query", "start_ts + 0.5D AS tm", "0 AS late", "concat('vis_', id) AS item"),
        facts.select("query", "t", "fact").distinct().selectExpr("query", "CAST(t AS double) AS tm", "0 AS late", "concat('fact_', fact) AS item"), facts.select("query", "entity").distinct().selectExpr("query", "0D AS tm", "1 AS late", "concat('label_', entity) AS item"),
    ]
    return T.interleave_by_time(parts, "query")


@registry.add("consolidated_facts", f"WITH {_GRAPH}, fv AS MATERIALIZED (SELECT subject, ts, grp * 100000 + idx AS idx, s, p, o, {coded_sql("s || ' ' || p || ' ' || o", 16)} AS v FROM facts), g AS (SELECT a.subject, a.ts, a.idx, min(b.ts) AS gone FROM fv a JOIN fv b ON b.subject = a.subject AND b.s = a.s AND b.p = a.p AND b.ts > a.ts AND {_NONZERO.format(v='a.v')} AND {_NONZERO.format(v='b.v')} AND {_COS.format(a='a.v', b='b.v')} >= 0.6 GROUP BY ALL) SELECT fv.subject, CAST(fv.ts AS BIGINT) AS ts, fv.s, fv.p, fv.o, CAST(g.gone AS BIGINT) AS gone FROM fv LEFT JOIN g ON g.subject = fv.subject AND g.ts = fv.ts AND g.idx = fv.idx")
def consolidated_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold of facts over time, each with the update that retracts it; what holds at any time follows."""
    facts = G.period_facts(captions(spark, sf_dir)).selectExpr("subject", "ts", "s AS entity", "grp * 100000 + idx AS idx", "s", "p", "o")
    return C.consolidate(facts, ["subject", "entity"]).select("subject", "ts", "s", "p", "o", "gone")


@registry.add("topic_chunks", f"WITH {_HITS}, rec AS (SELECT subject, name AS entity FROM ent WHERE subject IS NOT NULL AND length(name) >= 2 GROUP BY ALL HAVING count(DISTINCT created_at) >= 2), o AS (SELECT h.subject, h.entity, row_number() OVER (PARTITION BY h.subject, h.entity ORDER BY c.start_ts, c.id) AS rn, c.start_ts FROM hits h JOIN rec r ON r.subject = h.subject AND r.entity = h.entity JOIN caps c ON c.id = h.id AND c.subject = h.subject) SELECT subject, entity, CAST((rn - 1) // 50 AS BIGINT) AS chunk, count(*) AS captions, CAST(min(start_ts) AS BIGINT) AS first_ts FROM o GROUP BY ALL")
def topic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The captions that mention recurring entities, in chunks of fifty."""
    rows = triples_entities(spark, sf_dir)
    strong = C.recurring(rows, 2).select("subject", "entity")
    times = captions(spark, sf_dir).where("granularity = '30sec'").select("subject", "id", "start_ts")
    # names that do not recur meet no captions
    met = entity_hits(spark, sf_dir, strong).join(times, ["subject", "id"])
    numbered = slices.numbered(met, ["subject", "entity"], ["start_ts", "id"], T.DAY)
    return numbered.groupBy("subject", "entity", F.expr("CAST((rn - 1) DIV 50 AS bigint)").alias("chunk")).agg(F.count("*").alias("captions"), F.min("start_ts").alias("first_ts"))


def triples_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.plans.graph import entities

    return entities(spark, sf_dir).where("subject IS NOT NULL").selectExpr("subject", "name AS entity", "created_at AS ts")


@registry.add("subject_groups", f"WITH {RECS} SELECT replace(replace(trim(lower(s)), '''', ''), '-', ' ') AS subject_key, count(*) AS facts, count(DISTINCT p) AS predicates, min(s) AS spelling FROM tri WHERE s IS NOT NULL GROUP BY 1")
def subject_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts by the plain form of their subject."""
    t = triples(spark, sf_dir).where("s IS NOT NULL")
    return t.groupBy(F.expr("replace(replace(trim(lower(s)), '\\'', ''), '-', ' ')").alias("subject_key")).agg(F.count("*").alias("facts"), F.countDistinct("p").alias("predicates"), F.min("s").alias("spelling"))


_MULTI = f"""{CAPS}, {_RETRIEVED}, qv AS MATERIALIZED (SELECT query, subject, until, text, {coded_sql('text', 16)} AS q FROM q2), cv AS MATERIALIZED (SELECT id, subject, granularity AS kind, end_ts, text, {coded_sql('text', 16)} AS v FROM caps),
s AS (SELECT query, id, kind, qv.text AS asked, cv.text, {_COS.format(a='q', b='v')} AS score FROM qv JOIN cv ON cv.subject = qv.subject AND cv.end_ts <= qv.until WHERE {_NONZERO.format(v='q')} AND {_NONZERO.format(v='v')}),
w3 AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query, kind ORDER BY score DESC, id) <= CASE kind WHEN '30sec' THEN 10 WHEN '1h' THEN 3 ELSE 5 END),
pk AS (SELECT *, len(list_intersect(string_split(lower(asked), ' '), string_split(lower(text), ' '))) >= 2 AS picked FROM w3)"""


@registry.add("multi_granularity", f"WITH {_MULTI} SELECT query, id, kind, round(score, 6) AS score, picked, CAST(row_number() OVER (PARTITION BY query ORDER BY picked DESC, score DESC, id) AS INTEGER) AS rank FROM pk QUALIFY rank <= 10")
def multi_granularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of each granularity, those that a reranker picks first (here: two words shared), filled up by score."""
    q, caps = questions(spark, sf_dir), captions(spark, sf_dir)
    code = STAND_INS.encode_text
    items = caps.selectExpr("id", "subject AS `group`", "granularity AS kind", "end_ts AS t", f"{code('text')} AS v")
    near = similar(q.selectExpr("query", "subject AS `group`", "until", f"{code('text')} AS v"), items, 10, dim=16, group=True, until=True, per_kind=True)
    kept = near.where("rank <= CASE kind WHEN '30sec' THEN 10 WHEN '1h' THEN 3 ELSE 5 END").drop("rank")
    told = kept.join(caps.select("id", "text"), "id").join(q.selectExpr("query", "text AS asked"), "query")
    picked = told.selectExpr("query", "id", "kind", "score", "size(array_intersect(split(lower(asked), ' '), split(lower(text), ' '))) >= 2 AS picked")
    return picked.selectExpr("query", "id", "kind", "round(score, 6) AS score", "picked", "row_number() OVER (PARTITION BY query ORDER BY picked DESC, score DESC, id) AS rank").where("rank <= 10")


@registry.add("clips_by_sight", f"WITH {_GRAPH}, {_CLIP_VECTORS}, {_RETRIEVED}, qv AS MATERIALIZED (SELECT query, subject, until, {coded_sql('text', 64)} AS q FROM q2), cw AS (SELECT cv.id, cv.subject, vis.end_ts, CAST(v AS DOUBLE[]) AS v FROM cv JOIN vis ON vis.id = cv.id WHERE len(v) = 64 AND list_bool_and(list_transform(v, lambda x: isfinite(x))) AND {_NONZERO.format(v='v')}) SELECT query, id, {_COS.format(a='q', b='v')} AS score FROM qv JOIN cw ON cw.subject = qv.subject AND cw.end_ts <= qv.until WHERE {_NONZERO.format(v='q')} QUALIFY row_number() OVER (PARTITION BY query ORDER BY {_COS.format(a='q', b='v')} DESC, id) <= 3")
def clips_by_sight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clips with a vector that a question may see, by similarity to its visual form."""
    caps, q = captions(spark, sf_dir), questions(spark, sf_dir)
    clips = cut(G.clips(caps))
    items = G.clip_vectors(clips, table(spark, sf_dir, "visual_embeddings")).join(clips.selectExpr("id", "subject AS `group`", "end_ts AS t", "kind"), "id")
    return similar(q.selectExpr("query", "subject AS `group`", "until", f"{STAND_INS.encode_visual_query('text')} AS v"), items, 3, dim=64, group=True, until=True).select("query", "id", "score")
