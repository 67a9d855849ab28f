"""Queries over the graph of memories: its building, its view as of a time, and retrieval by walks over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import memory_graph as G
from tidemark.plans.graph import _ALL_ASKED, _ASKED, _KEY, RECS, SQL_STEPS, asked, triples
from tidemark.plans.temporal import CAPS, captions
from tidemark.registry import Registry
from tidemark.runtime import cut, table

registry = Registry()

#: The moment as of which memory is searched: day 2, 17:40.
UNTIL = 150_000


def coded_sql(text: str, size: int) -> str:
    """A text's words as hashed numbers in SQL."""
    codes = f"list_transform(list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '\\s+'), lambda w: w <> ''), lambda w: CAST(concat('0x', md5(w)[1:4]) AS INTEGER))"
    return f"list_transform(range({size}), lambda i: CAST(len(list_filter({codes}, lambda c: c % {2 * size} = 2 * i)) - len(list_filter({codes}, lambda c: c % {2 * size} = 2 * i + 1)) AS DOUBLE))"


_NONZERO = "list_bool_or(list_transform({v}, lambda x: x <> 0))"
_COS = "round(list_cosine_similarity({a}, {b}), 9)"
_FACT = "([A-Z][a-z]+) ([a-z]+s) the ([a-z]+ [a-z]+)"
_LADDER = "(VALUES ('3min', '30sec', 1.0::DOUBLE), ('10min', '3min', 1.0), ('1h', '10min', 1.0), ('1h', '30sec', 0.5)) l(g, f, weight)"
#: nodes(subject, id, node_type, kind, text, start_ts, end_ts) and edges(src, dst, edge_type, weight, k) in SQL.
_GRAPH = f"""{CAPS},
ep AS (SELECT subject, 'ep_' || id AS id, 'episode' AS node_type, granularity AS kind, text, start_ts, end_ts FROM caps),
vis AS (SELECT subject, subject || '/vis_' || video_path || ':' || start_ts AS id, 'visual_clip' AS node_type, 'visual_clip' AS kind, arg_min_null(text, id) AS text, start_ts, max(end_ts) AS end_ts, video_path, start_s FROM caps WHERE granularity = '30sec' AND video_path IS NOT NULL GROUP BY subject, video_path, start_s, start_ts),
chunks AS (SELECT subject, text, arg_max(struct_pack(id := id, start_ts := start_ts, end_ts := end_ts), struct_pack(a := start_ts, b := id)) AS e FROM caps WHERE granularity = '30sec' AND text <> '' GROUP BY subject, text),
found AS (SELECT subject, e, unnest(regexp_extract_all(text, '([A-Z][a-z]{{2,}})', 1)) AS name, generate_subscripts(regexp_extract_all(text, '([A-Z][a-z]{{2,}})', 1), 1) AS pos FROM chunks),
men AS (SELECT subject, name, subject || '/ent_' || {_KEY.format(n='name', p='subject')} AS entity, 'ep_' || e.id AS episode, e.start_ts AS start_ts, e.end_ts AS end_ts, struct_pack(a := e.start_ts, b := e.id, c := pos) AS ord FROM found),
ents AS (SELECT subject, entity AS id, 'entity' AS node_type, 'entity' AS kind, arg_min(name, ord) AS text, arg_min(start_ts, ord) AS start_ts, max(end_ts) AS end_ts FROM men GROUP BY subject, entity),
num AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY start_ts, id) AS rn FROM caps WHERE granularity = '30sec'),
grps AS (SELECT subject, (rn - 1) // 10 AS grp, arg_max(end_ts, rn) AS ts FROM num GROUP BY ALL),
raw AS (SELECT subject, (rn - 1) // 10 AS grp, rn, unnest(regexp_extract_all(text, '{_FACT}', 1)) AS s, unnest(regexp_extract_all(text, '{_FACT}', 2)) AS p, unnest(regexp_extract_all(text, '{_FACT}', 3)) AS o, generate_subscripts(regexp_extract_all(text, '{_FACT}', 1), 1) AS pos FROM num),
facts AS (SELECT raw.subject, raw.grp, ts, row_number() OVER (PARTITION BY raw.subject, raw.grp ORDER BY rn, pos) - 1 AS idx, s, p, o FROM raw JOIN grps ON grps.subject = raw.subject AND grps.grp = raw.grp),
sem AS (SELECT subject, subject || '/sem_' || grp || '_' || idx AS id, 'semantic' AS node_type, 'semantic' AS kind, s || ' ' || p || ' ' || o AS text, ts AS start_ts, ts AS end_ts FROM facts),
nodes AS (SELECT * FROM ep UNION ALL SELECT subject, id, node_type, kind, text, start_ts, end_ts FROM vis UNION ALL SELECT * FROM ents UNION ALL SELECT * FROM sem),
nx AS (SELECT 'ep_' || id AS a, 'ep_' || lead(id) OVER w AS b, lead(start_ts) OVER w - end_ts AS gap FROM caps WINDOW w AS (PARTITION BY subject, granularity ORDER BY start_ts, id)),
cc AS (SELECT v.id AS clip, 'ep_' || c.id AS episode FROM vis v JOIN caps c ON c.granularity = '30sec' AND c.subject = v.subject AND c.start_ts = v.start_ts AND c.end_ts = v.end_ts),
hp AS (SELECT subject || '/ent_' || {_KEY.format(n='s', p='subject')} AS src, subject || '/sem_' || grp || '_' || idx AS dst, 1.0::DOUBLE AS weight FROM facts UNION ALL SELECT subject || '/ent_' || {_KEY.format(n='o', p='subject')}, subject || '/sem_' || grp || '_' || idx, 0.5 FROM facts),
edges AS (SELECT a AS src, b AS dst, 'temporal_next' AS edge_type, 1.0::DOUBLE / (gap + 1) AS weight, 1 AS k FROM nx WHERE b IS NOT NULL AND gap BETWEEN 0 AND 21600 UNION ALL SELECT b, a, 'temporal_next', 1.0::DOUBLE / (gap + 1), 1 FROM nx WHERE b IS NOT NULL AND gap BETWEEN 0 AND 21600
  UNION ALL SELECT 'ep_' || c.id, 'ep_' || f.id, 'contains', l.weight, 2 FROM caps c JOIN {_LADDER} ON l.g = c.granularity JOIN caps f ON f.granularity = l.f AND f.subject = c.subject AND c.start_ts <= f.start_ts AND f.end_ts <= c.end_ts
  UNION ALL SELECT clip, episode, 'co_clip', 1.0, 3 FROM cc UNION ALL SELECT episode, clip, 'co_clip', 1.0, 3 FROM cc
  UNION ALL SELECT entity, episode, 'mentioned_in', 1.0, 4 FROM men
  UNION ALL SELECT DISTINCT entity, clip, 'appeared_in', 0.8, 5 FROM men JOIN cc ON cc.episode = men.episode
  UNION ALL SELECT src, dst, 'has_property', weight, 6 FROM hp WHERE src IN (SELECT id FROM ents))"""
_SEEN = f"""{_GRAPH},
snap AS (SELECT subject, max(start_ts) AS ts FROM sem WHERE start_ts <= {UNTIL} GROUP BY subject),
vn AS MATERIALIZED (SELECT nodes.* FROM nodes LEFT JOIN snap ON snap.subject = nodes.subject WHERE (node_type IN ('episode', 'visual_clip') AND end_ts <= {UNTIL}) OR (node_type = 'entity' AND start_ts <= {UNTIL}) OR (node_type = 'semantic' AND start_ts = snap.ts)),
vedges AS (SELECT * FROM edges WHERE src IN (SELECT id FROM vn) AND dst IN (SELECT id FROM vn)),
pairs AS MATERIALIZED (SELECT least(src, dst) AS a, greatest(src, dst) AS b, arg_min(weight, struct_pack(k := k, w := -weight)) AS weight FROM vedges WHERE src <> dst GROUP BY ALL)"""


def parts(spark: SparkSession, sf_dir: str, subjects: DataFrame | None = None, until: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, clips) of all subjects, or of those in ``subjects``: no edge leads from one to another; with ``until`` without most edges that are not visible as of it."""
    caps = captions(spark, sf_dir)
    caps = cut(caps if subjects is None else caps.join(F.broadcast(subjects), "subject", "left_semi"))
    clips, found, facts = G.clips(caps), cut(G.mentions(caps)), cut(G.period_facts(caps))
    nodes = G.episodes(caps)
    for more in (clips.select(*G.NODE), G.entities(found), G.semantics(facts)):
        nodes = nodes.unionByName(more)
    return nodes, G.edges(caps, clips.select(*G.NODE), found, facts, until), clips


def visible(spark: SparkSession, sf_dir: str, subjects: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, vectors) as of the moment; nodes are written once, and some edges lead to nodes that are not visible."""
    nodes, edges, clips = parts(spark, sf_dir, subjects, UNTIL)
    kept = cut(G.as_of(nodes, edges, UNTIL)[0])
    return kept, edges, G.clip_vectors(clips.join(kept.select("id"), "id", "left_semi"), table(spark, sf_dir, "visual_embeddings"))


@registry.add("memory_graph", f"WITH {_GRAPH} SELECT 'node' AS part, node_type AS kind, count(*) AS n, CAST(sum(end_ts - start_ts) AS DOUBLE) AS total FROM nodes GROUP BY node_type UNION ALL SELECT 'edge', edge_type, count(*), round(sum(weight), 6) FROM edges GROUP BY edge_type")
def memory_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and edges by type, with the time nodes span and the weight of edges."""
    nodes, edges, _ = parts(spark, sf_dir)
    by_node = nodes.groupBy("node_type").agg(F.count("*").alias("n"), F.sum(F.expr("end_ts - start_ts")).cast("double").alias("total")).selectExpr("'node' AS part", "node_type AS kind", "n", "total")
    return by_node.unionByName(edges.groupBy("edge_type").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("total")).selectExpr("'edge' AS part", "edge_type AS kind", "n", "total"))


@registry.add("episode_mentions", f"WITH {_GRAPH} SELECT entity AS src, episode AS dst, count(*) AS times FROM men GROUP BY ALL")
def episode_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names found in chunks of text, joined to the episode of each chunk, with the number of mentions."""
    return G.mentions(captions(spark, sf_dir)).groupBy(F.col("entity").alias("src"), F.col("episode").alias("dst")).agg(F.count("*").alias("times"))


@registry.add("appeared_in", f"WITH {_GRAPH} SELECT src, dst, weight FROM edges WHERE edge_type = 'appeared_in'")
def appeared_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities and the clips of the episodes that mention them, each pair once."""
    return parts(spark, sf_dir)[1].where("edge_type = 'appeared_in'").select("src", "dst", "weight")


@registry.add("period_facts", f"WITH {_GRAPH} SELECT subject, CAST(grp AS BIGINT) AS grp, CAST(ts AS BIGINT) AS ts, CAST(idx AS BIGINT) AS idx, s, p, o FROM facts")
def period_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts of every ten captions, as of the last one's end."""
    return G.period_facts(captions(spark, sf_dir))


@registry.add("asof_subgraph", f"WITH {_SEEN} SELECT a, b, round(weight, 9) AS weight FROM pairs")
def asof_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The simple weighted graph of all that is visible at a moment."""
    nodes, edges, _ = parts(spark, sf_dir)
    return G.simple(G.as_of(cut(nodes), edges, UNTIL)[1]).where("src < dst").selectExpr("src AS a", "dst AS b", "round(weight, 9) AS weight")


_FILE_S = "(CAST(regexp_extract(video_path, '([0-9]{2})[0-9]{2}[.][a-z0-9]+$', 1) AS BIGINT) * 3600 + CAST(regexp_extract(video_path, '[0-9]{2}([0-9]{2})[.][a-z0-9]+$', 1) AS BIGINT) * 60)"
_CLIP_VECTORS = f"""kv AS (SELECT key, arg_max(embedding, vec_id) AS v FROM visual_embeddings GROUP BY key),
cv AS (SELECT vis.id, vis.subject, coalesce(x.v, y.v) AS v FROM vis LEFT JOIN kv x ON regexp_matches(video_path, '[0-9]{{4}}[.][a-z0-9]+$') AND x.key = video_path || ':' || CAST(start_s - {_FILE_S} AS VARCHAR) || '-' || CAST(start_s + end_ts - start_ts - {_FILE_S} AS VARCHAR) LEFT JOIN kv y ON y.key = video_path WHERE coalesce(x.v, y.v) IS NOT NULL)"""


@registry.add("clip_vectors", f"WITH {_GRAPH}, {_CLIP_VECTORS} SELECT id, md5(array_to_string(list_transform(v, lambda x: CAST(CAST(x * 1000 AS BIGINT) AS VARCHAR)), ',')) AS digest FROM cv WHERE len(v) = 64 AND list_bool_and(list_transform(v, lambda x: isfinite(x)))")
def clip_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each clip's vector, by path and offsets or by the path alone."""
    found = G.clip_vectors(G.clips(captions(spark, sf_dir)), table(spark, sf_dir, "visual_embeddings"))
    whole = found.where("size(v) = 64 AND forall(v, x -> NOT isnan(x) AND abs(x) < 1e38)")
    return whole.selectExpr("id", "md5(array_join(transform(v, x -> CAST(CAST(rint(x * CAST(1000 AS float)) AS bigint) AS string)), ',')) AS digest")


_TEXT_V, _ASK_V, _SIGHT_V = coded_sql("text", 16), coded_sql("text", 16), coded_sql("text", 64)
_SEEDS = f"""{_SEEN}, {_CLIP_VECTORS}, {_ASKED},
av AS MATERIALIZED (SELECT query, subject, text, {_ASK_V} AS q, {_SIGHT_V} AS q2 FROM asked),
tv AS MATERIALIZED (SELECT subject, id, kind, {_TEXT_V} AS v FROM vn WHERE node_type NOT IN ('visual_clip', 'entity')),
ts1 AS (SELECT query, id, {_COS.format(a='q', b='v')} AS score FROM av JOIN tv ON tv.subject = av.subject WHERE {_NONZERO.format(v='v')} AND {_NONZERO.format(v='q')} QUALIFY row_number() OVER (PARTITION BY query ORDER BY {_COS.format(a='q', b='v')} DESC, id) <= 5),
w AS (SELECT subject, id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS ws FROM vn),
tf AS (SELECT subject, id, dl, word, count(*) AS tf FROM (SELECT subject, id, len(ws) AS dl, unnest(ws) AS word FROM w) GROUP BY ALL),
st AS (SELECT subject, count(*) AS n_docs, sum(len(ws)) AS words FROM w GROUP BY subject),
idf AS (SELECT tf.subject, word, ln(any_value(n_docs) - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM tf JOIN st ON st.subject = tf.subject GROUP BY tf.subject, word),
mi AS (SELECT subject, avg(idf) AS m FROM idf GROUP BY subject),
aw AS (SELECT query, subject, word, count(*) AS times FROM (SELECT query, subject, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS word FROM asked) GROUP BY ALL),
bm AS (SELECT aw.query, tf.id, sum(times * CASE WHEN idf < 0 THEN 0.25 * m ELSE idf END * tf.tf * 2.5 / (tf.tf + 1.5 * (0.25 + 0.75 * dl / (words / n_docs)))) AS score FROM aw JOIN idf ON idf.subject = aw.subject AND idf.word = aw.word JOIN mi ON mi.subject = aw.subject JOIN st ON st.subject = aw.subject JOIN tf ON tf.subject = aw.subject AND tf.word = aw.word GROUP BY aw.query, tf.id),
bs AS (SELECT query, id, round(score / max(score) OVER (PARTITION BY query), 9) AS score FROM bm WHERE score > 0),
ts2 AS (SELECT * FROM bs QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, id) <= 5),
cw AS (SELECT cv.id, cv.subject, CAST(v AS DOUBLE[]) AS v FROM cv JOIN vn ON vn.id = cv.id WHERE len(v) = 64 AND list_bool_and(list_transform(v, lambda x: isfinite(x))) AND {_NONZERO.format(v='v')}),
ts3 AS (SELECT query, id, {_COS.format(a='q2', b='v')} AS score FROM av JOIN cw ON cw.subject = av.subject WHERE {_NONZERO.format(v='q2')} QUALIFY row_number() OVER (PARTITION BY query ORDER BY {_COS.format(a='q2', b='v')} DESC, id) <= 5),
al AS (SELECT query, id, 0.7 * score AS x FROM ts1 WHERE score > 0 UNION ALL SELECT query, id, 0.3 * score FROM ts2 WHERE score > 0 UNION ALL SELECT query, id, (1 - 0.7) * score FROM ts3 WHERE score > 0),
sm AS (SELECT query, id, sum(x) AS x FROM al GROUP BY ALL),
start AS MATERIALIZED (SELECT query, id, x / sum(x) OVER (PARTITION BY query) AS p FROM sm UNION ALL SELECT query, vn.id, 1.0 / count(*) OVER (PARTITION BY query) FROM av JOIN vn ON vn.subject = av.subject WHERE query NOT IN (SELECT query FROM sm))"""


def walk_sql(damping: float, lines: str) -> str:
    """Steps of the plain walk for many queries at once: walk(k, query, id, score), from start(query, id, p) over lines(src, dst, weight)."""
    return f"""{lines}, tot AS (SELECT src, sum(weight) AS total FROM line GROUP BY src), step AS MATERIALIZED (SELECT line.src, dst, {damping} * weight / total AS part FROM line JOIN tot ON tot.src = line.src),
walk AS (SELECT 0 AS k, query, id, p AS score FROM start UNION ALL SELECT k, query, id, sum(x) FROM (SELECT walk.k + 1 AS k, query, dst AS id, walk.score * part AS x FROM walk JOIN step ON step.src = walk.id WHERE walk.k < {SQL_STEPS}
  UNION ALL SELECT m.k + 1, query, start.id, {1 - damping} * p FROM start, (SELECT max(k) AS k FROM walk) m WHERE m.k < {SQL_STEPS}) GROUP BY k, query, id),
rest AS (SELECT query, id, score / sum(score) OVER (PARTITION BY query) AS score FROM walk WHERE k = {SQL_STEPS})"""


@registry.add("reset_vector", f"WITH {_SEEDS} SELECT query, id, round(p, 6) AS p FROM start")
def reset_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where walks restart: best nodes by text, words and sight."""
    nodes, _, vectors = visible(spark, sf_dir)
    return G.seeds(nodes, vectors, asked(spark, sf_dir)).selectExpr("query", "id", "round(p, 6) AS p")


_PAIR_LINES = "line AS (SELECT a AS src, b AS dst, weight FROM pairs UNION ALL SELECT b, a, weight FROM pairs)"


@registry.add("hybrid_retrieval", f"""WITH RECURSIVE {_SEEDS.replace(_ASKED, _ALL_ASKED)}, {walk_sql(0.85, _PAIR_LINES)},
h AS (SELECT rest.query, rest.id, vn.kind, round(rest.score * (CASE WHEN tv.v IS NULL OR NOT {_NONZERO.format(v='tv.v')} THEN 0 ELSE list_cosine_similarity(av.q, tv.v) END + 1) / 2, 12) AS score FROM rest JOIN vn ON vn.id = rest.id JOIN av ON av.query = rest.query LEFT JOIN tv ON tv.id = rest.id),
k AS (SELECT *, row_number() OVER (PARTITION BY query, kind ORDER BY score DESC, id) AS kr FROM h), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM k WHERE kr <= CASE kind WHEN '30sec' THEN 8 WHEN '3min' THEN 4 WHEN '10min' THEN 3 WHEN '1h' THEN 0 WHEN 'semantic' THEN 5 WHEN 'entity' THEN 3 ELSE 16 END)
SELECT query, id, kind, round(score, 9) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 16""")
def hybrid_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each question gets from its subject's memory: the walk's rest times how alike texts are, under quotas."""
    q = cut(asked(spark, sf_dir, every=1))
    nodes, edges, vectors = visible(spark, sf_dir, q.select("subject").distinct())
    return G.hybrid(nodes, edges, vectors, q).withColumn("score", F.round("score", 9))


_TRIPLE_WALK = f"""{RECS}, {_ALL_ASKED}, f AS (SELECT DISTINCT subject, md5(subject || '|' || s || '|' || p || '|' || o || '|' || resp_id) AS fact, s, p, o FROM tri WHERE subject IN (SELECT subject FROM asked) AND s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL),
fv AS MATERIALIZED (SELECT *, {coded_sql("s || ' ' || p || ' ' || o", 16)} AS v FROM f), av AS MATERIALIZED (SELECT query, subject, {_ASK_V} AS q FROM asked),
best AS (SELECT query, fact, s, o, av.subject FROM av JOIN fv ON fv.subject = av.subject WHERE {_NONZERO.format(v='v')} AND {_NONZERO.format(v='q')} QUALIFY row_number() OVER (PARTITION BY query ORDER BY {_COS.format(a='q', b='v')} DESC, fact) <= 10),
starts AS (SELECT DISTINCT query, subject || '/' || unnest([s, o]) AS id FROM best), start AS MATERIALIZED (SELECT query, id, 1.0 / count(*) OVER (PARTITION BY query) AS p FROM starts),
ends AS MATERIALIZED (SELECT fact, s, p, o, subject || '/' || s AS a, subject || '/' || o AS b FROM f)"""


@registry.add("triple_walk", f"""WITH RECURSIVE {_TRIPLE_WALK}, {walk_sql(0.85, "line AS (SELECT a AS src, b AS dst, CAST(count(*) AS DOUBLE) AS weight FROM (SELECT a, b FROM ends WHERE a <> b UNION ALL SELECT b, a FROM ends WHERE a <> b) GROUP BY ALL)")},
u AS (SELECT fact, s, p, o, unnest([a, b]) AS id FROM ends), sc AS (SELECT query, fact, s, p, o, round(sum(score), 9) AS score FROM rest JOIN u ON u.id = rest.id GROUP BY ALL)
SELECT query, fact, s, p, o, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, fact) AS INTEGER) AS rank FROM sc QUALIFY rank <= 10""")
def triple_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of a subject by walks from the entities of the facts most like the question."""
    q = cut(asked(spark, sf_dir, every=1))
    rows = triples(spark, sf_dir).join(F.broadcast(q.select("subject").distinct()), "subject", "left_semi").where("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL")
    # a record's triples are told apart already, and so are records
    facts = rows.selectExpr("subject", "unhex(md5(concat_ws('|', subject, s, p, o, resp_id))) AS fact", "s", "p", "o")
    # brackets that open count the triples of a text without reading it
    most = table(spark, sf_dir, "openie_raw").groupBy(F.col("subject").alias("group")).agg(F.sum(F.expr("greatest(coalesce(size(triples), 0), coalesce(length(raw_output) - length(replace(raw_output, '[', '')), 0))")).alias("edges"))
    return G.triple_walk(facts, q, counts=most).withColumn("fact", F.expr("lower(hex(fact))"))


_PLAIN = "trim(regexp_replace(lower({x}), '[^a-z0-9 ]', ' ', 'g'))"
_PASSAGES = f"""{RECS}, pf AS MATERIALIZED (SELECT DISTINCT chunk_id AS chunk, {_PLAIN.format(x='s')} AS s, {_PLAIN.format(x='p')} AS p, {_PLAIN.format(x='o')} AS o FROM tri WHERE chunk_id IS NOT NULL AND s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL),
phr AS (SELECT DISTINCT unnest([s, o]) AS phrase FROM pf), pv AS MATERIALIZED (SELECT phrase, {coded_sql('phrase', 16)} AS v FROM phr WHERE phrase <> ''),
own AS (SELECT src, dst, CAST(count(*) AS DOUBLE) AS weight FROM (SELECT s AS src, o AS dst FROM pf WHERE s <> o AND s <> '' AND o <> '' UNION ALL SELECT o, s FROM pf WHERE s <> o AND s <> '' AND o <> '') GROUP BY ALL),
nr AS (SELECT a.phrase AS src, b.phrase AS dst, {_COS.format(a='a.v', b='b.v')} AS weight FROM pv a JOIN pv b ON a.phrase <> b.phrase WHERE length(regexp_replace(a.phrase, '[^A-Za-z0-9]', '', 'g')) > 2 AND CAST(concat('0x', md5(a.phrase)[1:6]) AS BIGINT) % 50 = 0 AND {_NONZERO.format(v='a.v')} AND {_NONZERO.format(v='b.v')}),
alike AS (SELECT * FROM nr WHERE weight >= 0.8 QUALIFY row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) <= 101),
kept AS (SELECT * FROM own ANTI JOIN alike USING (src, dst) UNION ALL SELECT * FROM alike), prs AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, sum(weight) AS weight FROM kept GROUP BY ALL UNION ALL SELECT DISTINCT phrase, chr(1) || chunk, 1.0 FROM (SELECT chunk, unnest([s, o]) AS phrase FROM pf) WHERE phrase <> '')"""


def plain_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.functions.text import plain_words

    rows = triples(spark, sf_dir).where("chunk_id IS NOT NULL AND s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL")
    return rows.selectExpr("chunk_id AS chunk", *(f"{plain_words(x)} AS {x}" for x in "spo")).distinct()


@registry.add("passage_graph", f"WITH {_PASSAGES} SELECT CASE WHEN starts_with(b, chr(1)) THEN substr(b, 2) ELSE b END AS b, a, round(weight, 6) AS weight FROM prs")
def passage_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases, passages and synonyms as one graph."""
    facts = cut(plain_facts(spark, sf_dir))
    made = G.passage_graph(facts, G.phrase_lines(facts))
    return made.where("dst LIKE '\u0001%' OR (src < dst AND NOT src LIKE '\u0001%')").selectExpr("src AS a", "CASE WHEN dst LIKE '\u0001%' THEN substr(dst, 2) ELSE dst END AS b", "round(weight, 6) AS weight")


@registry.add("passage_search", f"""WITH RECURSIVE {_PASSAGES}, {_ASKED}, av AS MATERIALIZED (SELECT query, {_ASK_V} AS q FROM asked),
ft AS MATERIALIZED (SELECT DISTINCT md5(s || '|' || p || '|' || o) AS fact, s, o, {coded_sql("s || ' ' || p || ' ' || o", 16)} AS v FROM pf),
fs AS (SELECT query, fact, s, o, coalesce(CASE WHEN {_NONZERO.format(v='v')} AND {_NONZERO.format(v='q')} THEN {_COS.format(a='q', b='v')} END, 0) AS score FROM av, ft),
fn AS (SELECT query, fact, s, o, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS score FROM fs WINDOW w AS (PARTITION BY query)),
bf AS (SELECT * FROM fn QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, fact) <= 5),
pn AS (SELECT phrase, count(DISTINCT chunk) AS n FROM (SELECT chunk, unnest([s, o]) AS phrase FROM pf) GROUP BY phrase),
ph AS (SELECT query, e.phrase AS id, round(avg(score / n), 9) AS score FROM (SELECT query, score, unnest([s, o]) AS phrase FROM bf) e JOIN pn ON pn.phrase = e.phrase GROUP BY ALL),
pk AS (SELECT * FROM ph QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, id) <= 5),
px AS MATERIALIZED (SELECT chunk, {coded_sql("string_agg(s || ' ' || p || ' ' || o, ' ' ORDER BY s, p, o)", 16)} AS v FROM pf GROUP BY chunk),
ps AS (SELECT query, chr(1) || chunk AS id, coalesce(CASE WHEN {_NONZERO.format(v='v')} AND {_NONZERO.format(v='q')} THEN {_COS.format(a='q', b='v')} END, 0) AS score FROM av, px),
pz AS (SELECT query, id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS score FROM ps WINDOW w AS (PARTITION BY query)),
al AS (SELECT query, id, score AS x FROM pk WHERE score > 0 UNION ALL SELECT query, id, 0.05 * score FROM pz WHERE score > 0), start AS MATERIALIZED (SELECT query, id, sum(x) / sum(sum(x)) OVER (PARTITION BY query) AS p FROM al GROUP BY query, id),
{walk_sql(0.5, "line AS (SELECT a AS src, b AS dst, weight FROM prs UNION ALL SELECT b, a, weight FROM prs)").replace(str(SQL_STEPS), '60')},
o AS (SELECT query, substr(id, 2) AS chunk, round(score, 12) AS score FROM rest WHERE starts_with(id, chr(1)))
SELECT query, chunk, round(score, 9) AS score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, chunk) AS INTEGER) AS rank FROM o QUALIFY rank <= 10""")
def passage_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages by walks from the phrases of the facts most like the question."""
    facts = cut(plain_facts(spark, sf_dir))
    passages = facts.groupBy("chunk").agg(F.expr("array_join(transform(array_sort(collect_list(struct(s, p, o))), x -> concat_ws(' ', x.s, x.p, x.o)), ' ')").alias("text"))
    return G.passage_search(facts, passages, G.phrase_lines(facts), asked(spark, sf_dir)).select("query", "chunk", F.round("score", 9).alias("score"), "rank")
