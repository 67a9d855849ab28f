"""The graph of a wearer's memory: episodes, clips, entities and facts, built step by step, seen as of a time, searched by walks.

Nodes are (subject, id, node_type, kind, text, start_ts, end_ts); ids are unique over all subjects, so that one set of edges
holds every subject's graph and a walk stays in its own.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.models import STAND_INS, Models
from tidemark.functions.text import entity_key
from tidemark.operators import retrieve as R
from tidemark.operators import slices
from tidemark.operators import temporal as T
from tidemark.operators.graph import GroupWalks, HeldWalks, best_columns, by_group, leading, numbered_rows, part_sizes, places, settled_pagerank, smaller, unit_rows
from tidemark.operators.knn import extremes, similar
from tidemark.runtime import cut

# The order in which kinds of edges are laid; of two edges between the same nodes the earlier stays.
EDGE_ORDER = {"temporal_next": 1, "contains": 2, "co_clip": 3, "mentioned_in": 4, "appeared_in": 5, "has_property": 6}
NODE = ["subject", "id", "node_type", "kind", "text", "start_ts", "end_ts"]


def episodes(captions: DataFrame) -> DataFrame:
    return captions.selectExpr("subject", "concat('ep_', id) AS id", "'episode' AS node_type", "granularity AS kind", "text", "start_ts", "end_ts")


def clips(captions: DataFrame) -> DataFrame:
    """One node for each clip of a 30-second caption; of several captions of a clip the first gives the text, the latest the end."""
    rows = captions.where("granularity = '30sec' AND video_path IS NOT NULL").selectExpr("subject", "concat(subject, '/vis_', video_path, ':', start_ts) AS id", "video_path", "start_s", "text", "start_ts", "end_ts", "id AS ord")
    return rows.groupBy("subject", "id", "video_path", "start_s", "start_ts").agg(F.min_by("text", "ord").alias("text"), F.max("end_ts").alias("end_ts")).selectExpr("subject", "id", "'visual_clip' AS node_type", "'visual_clip' AS kind", "text", "start_ts", "end_ts", "video_path", "start_s")


def clip_vectors(clips: DataFrame, vectors: DataFrame) -> DataFrame:
    """(id, v): each clip's vector, found by path and offsets within the file or else by the path alone; the latest of a key counts."""
    keyed = vectors.groupBy("key").agg(F.max_by("embedding", "vec_id").alias("v"))
    # the file's name has the hour and minute at which it begins
    file_s = "(CAST(regexp_extract(video_path, '([0-9]{2})[0-9]{2}[.][a-z0-9]+$', 1) AS bigint) * 3600 + CAST(regexp_extract(video_path, '[0-9]{2}([0-9]{2})[.][a-z0-9]+$', 1) AS bigint) * 60)"
    named = clips.where("video_path RLIKE '[0-9]{4}[.][a-z0-9]+$'").selectExpr("id", "video_path", f"concat(video_path, ':', start_s - {file_s}, '-', start_s + end_ts - start_ts - {file_s}) AS whole")
    rest = clips.where("NOT video_path RLIKE '[0-9]{4}[.][a-z0-9]+$'").selectExpr("id", "video_path", "CAST(NULL AS string) AS whole")
    both = named.unionByName(rest)
    exact = both.join(keyed.withColumnRenamed("v", "exact"), both["whole"] == keyed["key"], "left").drop("key")
    found = exact.join(keyed.withColumnRenamed("v", "plain"), exact["video_path"] == keyed["key"], "left")
    return found.selectExpr("id", "coalesce(exact, plain) AS v").where("v IS NOT NULL")


def mentions(captions: DataFrame, models: Models = STAND_INS) -> DataFrame:
    """(subject, name, entity, episode, start_ts, end_ts, ord) of each mention: names found in a chunk of text, joined to the episode that holds the chunk.

    Of several 30-second captions with one text the last is the chunk's episode. Names are found once for each chunk.
    """
    fine = captions.where("granularity = '30sec' AND text <> ''").selectExpr("subject", "concat('chunk-', md5(text)) AS chunk", "text", "concat('ep_', id) AS episode", "id", "start_ts", "end_ts")
    last = fine.groupBy("subject", "chunk").agg(F.max_by(F.struct("episode", "id", "start_ts", "end_ts"), F.struct("start_ts", "id")).alias("e"), F.max("text").alias("text"))
    found = last.select("subject", "chunk", F.posexplode(F.expr(models.name_entities("text"))).alias("pos", "name"))
    rows = found.where("trim(name) <> ''").join(last.select("subject", "chunk", "e.*"), ["subject", "chunk"])
    return rows.selectExpr("subject", "name", f"concat(subject, '/ent_', {entity_key('name', 'subject')}) AS entity", "episode", "start_ts", "end_ts", "struct(start_ts, id, pos) AS ord")


def entities(mentions: DataFrame) -> DataFrame:
    made = mentions.groupBy("subject", "entity").agg(F.min_by(F.struct("name", "start_ts"), "ord").alias("first"), F.max("end_ts").alias("end_ts"))
    return made.selectExpr("subject", "entity AS id", "'entity' AS node_type", "'entity' AS kind", "trim(first.name) AS text", "first.start_ts AS start_ts", "end_ts")


def period_facts(captions: DataFrame, period: int = 10, models: Models = STAND_INS) -> DataFrame:
    """(subject, grp, ts, idx, s, p, o): the facts of so many consecutive 30-second captions, as of the last one's end."""
    numbered = slices.numbered(captions.where("granularity = '30sec'"), ["subject"], ["start_ts", "id"], T.DAY).withColumn("grp", F.expr(f"CAST((rn - 1) DIV {period} AS bigint)"))
    made = numbered.withColumn("triples", F.expr(models.find_triples("coalesce(text, '')")))
    groups = made.groupBy("subject", "grp").agg(F.max_by("end_ts", "rn").alias("ts"), F.expr("flatten(transform(array_sort(collect_list(struct(rn, triples))), x -> x.triples))").alias("ts_all"))  # at most ``period`` rows each
    return groups.selectExpr("subject", "grp", "ts", "posexplode(ts_all) AS (idx, t)").where("size(t) >= 3").selectExpr("subject", "grp", "ts", "CAST(idx AS bigint) AS idx", "t[0] AS s", "t[1] AS p", "t[2] AS o")


def semantics(facts: DataFrame) -> DataFrame:
    return facts.selectExpr("subject", "concat(subject, '/sem_', grp, '_', idx) AS id", "'semantic' AS node_type", "'semantic' AS kind", "concat_ws(' ', s, p, o) AS text", "ts AS start_ts", "ts AS end_ts")


def edges(captions: DataFrame, clips: DataFrame, mentions: DataFrame, facts: DataFrame, until: int | None = None) -> DataFrame:
    """(src, dst, edge_type, weight) of all six kinds; an entity mentioned twice in an episode has two edges to it.

    With ``until`` those that cannot be visible as of it are left out before they are made; the rest is left to ``among``.
    """
    if until is not None:
        # a caption that starts later comes after all that are visible
        captions, clips = captions.where(f"least(start_ts, end_ts) <= {until}"), clips.where(f"end_ts <= {until}")
        known, mentions, facts = mentions.select(F.col("entity").alias("src")).distinct(), mentions.where(f"end_ts <= {until}"), facts.where(f"ts <= {until}")
    else:
        known = mentions.select(F.col("entity").alias("src")).distinct()
    ended = captions if until is None else captions.where(f"end_ts <= {until}")
    shaped = captions.selectExpr("subject", "concat('ep_', id) AS id", "granularity", "start_ts", "end_ts")
    early = ended.selectExpr("subject", "concat('ep_', id) AS id", "granularity", "start_ts", "end_ts")
    kinds = [("temporal_next", T.temporal_next_edges(shaped)), ("contains", T.contains_edges(early)), ("co_clip", T.co_clip_edges(early, clips).withColumn("weight", F.lit(1.0)))]
    kinds.append(("mentioned_in", mentions.selectExpr("entity AS src", "episode AS dst", "1D AS weight")))
    co_clip = T.co_clip_edges(early, clips).where("dst LIKE '%/vis%'").selectExpr("src AS episode", "dst AS clip")
    kinds.append(("appeared_in", mentions.select("entity", "episode").distinct().join(co_clip, "episode").selectExpr("entity AS src", "clip AS dst", "0.8D AS weight").distinct()))
    ends = facts.select(F.expr("concat(subject, '/sem_', grp, '_', idx)").alias("dst"), F.expr(f"inline(array(struct(concat(subject, '/ent_', {entity_key('s', 'subject')}) AS src, 1D AS weight), struct(concat(subject, '/ent_', {entity_key('o', 'subject')}) AS src, 0.5D AS weight)))"))
    kinds.append(("has_property", ends.join(known, "src", "left_semi").select("src", "dst", "weight")))
    out = None
    for name, df in kinds:
        part = df.select("src", "dst", F.lit(name).alias("edge_type"), "weight")
        out = part if out is None else out.unionByName(part)
    return out


def as_of(nodes: DataFrame, edges: DataFrame, until: int) -> tuple[DataFrame, DataFrame]:
    """What is visible at a time: episodes and clips that ended, entities seen before, each subject's latest facts; edges between visible nodes."""
    latest = nodes.where((F.col("node_type") == "semantic") & (F.col("start_ts") <= until)).groupBy("subject").agg(F.max("start_ts").alias("snapshot"))
    ended = nodes.where(F.col("node_type").isin("episode", "visual_clip") & (F.col("end_ts") <= until) | (F.col("node_type") == "entity") & (F.col("start_ts") <= until))
    facts = nodes.where("node_type = 'semantic'").join(latest, "subject").where("start_ts = snapshot").select(*nodes.columns)
    kept = ended.unionByName(facts)
    return kept, among(kept, edges)


def among(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between these nodes."""
    ids = nodes.select(F.col("id").alias("src"))
    both = edges.join(ids, "src", "left_semi").join(ids.withColumnRenamed("src", "dst"), "dst", "left_semi")
    return both.select(*edges.columns)


def simple(edges: DataFrame) -> DataFrame:
    """(src, dst, weight), both ways: one edge for each unordered pair, that of the kind laid first; loops are left out."""
    order = " ".join(f"WHEN edge_type = '{k}' THEN {v}" for k, v in EDGE_ORDER.items())
    pairs = edges.where("src <> dst").selectExpr("least(src, dst) AS a", "greatest(src, dst) AS b", "weight", f"struct(CASE {order} END AS k, -weight AS w) AS ord")
    one = pairs.groupBy("a", "b").agg(F.min_by("weight", "ord").alias("weight"))
    return one.select(F.expr("inline(array(struct(a AS src, b AS dst, weight), struct(b AS src, a AS dst, weight)))"))


def seeds(nodes: DataFrame, vectors: DataFrame, queries: DataFrame, *, alpha: float = 0.7, k: int = 5, bm25_weight: float = 0.3, models: Models = STAND_INS) -> DataFrame:
    """(query, id, p): where walks restart: the best nodes by text, by words and by sight, weighted and scaled to 1.

    ``queries`` (query, subject, text); a query searches its subject's nodes. Clips and entities have no text vector. A query without
    seeds restarts at all nodes alike.
    """
    told = nodes.where("node_type NOT IN ('visual_clip', 'entity')").selectExpr("subject AS `group`", "id", "kind", f"{models.encode_text('text')} AS v")
    text = similar(queries.selectExpr("query", "subject AS `group`", f"{models.encode_text('text')} AS v"), told, k, dim=16, group=True)
    words = R.bm25(nodes.selectExpr("subject", "id", "coalesce(text, '') AS text"), queries, by=("subject",))
    words = words.selectExpr("query", "id", "round(score / max(score) OVER (PARTITION BY query), 9) AS score")
    # a clip's vector is as long as a visual query's
    seen = vectors.join(nodes.select("id", F.col("subject").alias("group"), "kind"), "id")
    sight = similar(queries.selectExpr("query", "subject AS `group`", f"{models.encode_visual_query('text')} AS v"), seen, k, dim=64, group=True)
    found = R.reset_vector([(text, alpha), (R.top(words, ["query"], k), bm25_weight), (sight, 1 - alpha)])
    lost = queries.join(found.select("query").distinct(), "query", "left_anti").join(nodes.select("subject", "id"), "subject")
    return found.unionByName(lost.selectExpr("query", "id", "1D / count(*) OVER (PARTITION BY query) AS p"))


def hybrid(nodes: DataFrame, edges: DataFrame, vectors: DataFrame, queries: DataFrame, *, top_k: int = 16, damping: float = 0.85, alpha: float = 0.7, k: int = 5, bm25_weight: float = 0.3, models: Models = STAND_INS) -> DataFrame:
    """(query, id, kind, score, rank): nodes by where the walk rests times how alike their text is, under the quotas of their kinds.

    Edges that lead to no node are left out. A subject's graph moves once, to the task that finds the seeds, walks and ranks for all its questions.
    """
    from tidemark.functions.vectors import cosine

    words = lambda text: f"concat_ws(' ', filter(split(lower({text}), '\\\\s+'), w -> w <> ''))"
    # about eight lines a node
    sizes, placed = part_sizes(nodes.groupBy(F.col("subject").alias("group")).agg((8 * F.count("*")).alias("edges")), queries.selectExpr("query", "subject AS `group`", "text"))
    row = lambda df, what, *keys, **c: df.selectExpr(*keys, f"{what} AS what", *(f"CAST({c.get(k, 'NULL')} AS {t}) AS {k}" for k, t in (("query", "bigint"), ("a", "string"), ("b", "string"), ("c", "string"), ("x", "double"), ("v", "array<double>")))).selectExpr(*keys, "what", "query", "a", "b", "c", "x", *smaller("v"))
    texts = nodes.selectExpr("subject AS `group`", "id", "kind", "text", f"CASE WHEN node_type IN ('visual_clip', 'entity') THEN NULL ELSE {models.encode_text('text')} END AS v")
    held = nodes.selectExpr("id", "subject AS `group`")
    told = row(edges.where("src <> dst").join(held.withColumnRenamed("id", "src"), "src"), 0, "`group`", a="src", b="dst", c="edge_type", x="weight")
    told = told.unionByName(row(texts, 1, "`group`", a="id", b="kind", c=words("coalesce(text, '')"), v="v")).unionByName(row(vectors.join(held, "id"), 2, "`group`", a="id", v="v"))
    asked = queries.join(placed, "query").selectExpr("`group`", "part", "query", "text", f"{models.encode_text('text')} AS v", f"{models.encode_visual_query('text')} AS w")
    rows = by_group(told.join(F.broadcast(placed.select("group").distinct()), "group", "left_semi"), sizes)
    rows = rows.unionByName(row(asked, 3, "`group`", "part", query="query", c=words("text"), v="v")).unionByName(row(asked, 4, "`group`", "part", query="query", v="w"))

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        lines, told, seen, asks, looks = (group.filter(pc.equal(group.column("what"), k)) for k in range(5))
        out = list(walked_nodes(lines, told, seen, asks.sort_by("query"), looks.sort_by("query"), top_k, damping, alpha, k, bm25_weight)) if len(told) and len(asks) else []
        return pa.concat_tables([pa.table({"query": pa.array([], pa.int64()), "id": pa.array([], pa.string()), "kind": pa.array([], pa.string()), "score": pa.array([], pa.float64()), "rank": pa.array([], pa.int32())}), *out])

    found = rows.groupBy("group", "part").applyInArrow(run, "query bigint, id string, kind string, score double, rank int")
    far = cut(queries.join(placed.select("query"), "query", "left_anti"))
    if not far.count():
        return found
    start = cut(seeds(nodes, vectors, far, alpha=alpha, k=k, bm25_weight=bm25_weight, models=models))
    walk = settled_pagerank(simple(among(nodes, edges)), start, damping, ("query",))
    scored = walk.join(texts.drop("group", "text"), "id").join(far.selectExpr("query", f"{models.encode_text('text')} AS q"), "query").selectExpr("query", "id", "kind", f"round(score * (CASE WHEN v IS NULL THEN 0D ELSE {cosine('q', 'v')} END + 1) / 2, 12) AS score")
    return found.unionByName(T.quota_rank(scored, ["query"], "kind", T.QUOTAS, top_k).select("query", "id", "kind", "score", F.col("rank").cast("int")))


def walked_nodes(lines: pa.Table, told: pa.Table, seen: pa.Table, asks: pa.Table, looks: pa.Table, top_k: int, damping: float, alpha: float, k: int, bm25_weight: float) -> Iterator[pa.Table]:
    """``hybrid`` for the questions of a subject, a block of them at a time: seeds as in ``seeds``, walks, the best under the quotas."""
    ids, kinds = told.column("a").combine_chunks(), told.column("b").combine_chunks().to_numpy(zero_copy_only=False)
    n, order = len(ids), places(ids)
    at = lambda column: pc.index_in(column, value_set=ids).to_numpy().astype(np.int64)
    lines = lines.filter(pc.is_in(lines.column("b"), value_set=ids))
    a, b, w = at(lines.column("a")), at(lines.column("b")), lines.column("x").to_numpy()
    laid = pc.index_in(lines.column("c"), value_set=pa.array(EDGE_ORDER)).to_numpy()
    # one line for each pair, that of the kind laid first
    pair = np.minimum(a, b) * n + np.maximum(a, b)
    by = np.lexsort((-w, laid, pair))
    by = by[np.flatnonzero(np.diff(pair[by], prepend=-1))]
    walks = GroupWalks(n, a[by], b[by], w[by], damping)
    code, coded = unit_rows(16, told.column("small"), told.column("v"))
    sight, clear = unit_rows(64, seen.column("small"), seen.column("v"))
    clip = at(seen.column("a"))
    # words of the nodes, one by one, and how often each node has them
    bags = pc.split_pattern(told.column("c").combine_chunks(), " ")
    word, owner = pc.list_flatten(bags), pc.list_parent_indices(bags).to_numpy()
    said = pc.not_equal(word, "").to_numpy(zero_copy_only=False)
    word, owner = pc.dictionary_encode(word.filter(pa.array(said))), owner[said].astype(np.int64)
    vocabulary = {w: i for i, w in enumerate(word.dictionary.to_pylist())}
    length = np.bincount(owner, minlength=n)
    pairs, tf = np.unique(word.indices.to_numpy().astype(np.int64) * n + owner, return_counts=True)
    which, doc = pairs // n, pairs % n
    ends = np.searchsorted(which, np.arange(len(vocabulary) + 1))
    many = np.diff(ends)
    idf = np.log(n - many + 0.5) - np.log(many + 0.5)
    weight = np.where(idf < 0, 0.25 * (idf.mean() if len(idf) else 0.0), idf)
    part = tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length[doc] / max(length.sum() / n, 1e-300)))
    # questions that are alike are walked once
    (q, _), (look, _) = unit_rows(16, asks.column("small"), asks.column("v")), unit_rows(64, looks.column("small"), looks.column("v"))
    texts = asks.column("c").to_pylist()
    keys: dict = {}
    for i, text in enumerate(texts):
        keys.setdefault((text, q[i].tobytes(), look[i].tobytes()), []).append(i)
    numbers, askers = asks.column("query").to_numpy(), list(keys.values())
    by_kind = [(np.flatnonzero(kinds == x), min(top_k, T.QUOTAS.get(x, top_k))) for x in sorted(set(kinds.tolist()))]
    for lo in range(0, len(askers), WALKS):
        block = [x[0] for x in askers[lo : lo + WALKS]]
        rows = len(block)
        first = np.zeros((rows, n))

        def give(score: np.ndarray, node: np.ndarray, share: float, first: np.ndarray = first) -> None:
            row, column, value = best_columns(score, order[node], k, 9)
            some = value > 0
            first[row[some], node[column[some]]] += share * value[some]

        near = q[block] @ code.T
        able = (np.abs(q[block]).max(1, initial=0.0) > 0)[:, None] & coded[None, :]
        give(np.where(able, near, -np.inf), np.arange(n), alpha)
        match = np.zeros((rows, n))
        for r, i in enumerate(block):
            for w, times in Counter(x for x in texts[i].split(" ") if x in vocabulary).items():
                span = slice(ends[vocabulary[w]], ends[vocabulary[w] + 1])
                match[r, doc[span]] += times * weight[vocabulary[w]] * part[span]
        top = match.max(1)
        give(np.where(match > 0, np.divide(match, np.where(top > 0, top, 1)[:, None]), -np.inf), np.arange(n), bm25_weight)
        if clear.any():
            able = (np.abs(look[block]).max(1, initial=0.0) > 0)[:, None] & clear[None, :]
            give(np.where(able, look[block] @ sight.T, -np.inf), clip, 1 - alpha)
        first[first.sum(1) == 0] = 1
        first = (first / first.sum(1, keepdims=True)).T
        value = (walks.rest(first).T * (near + 1)) / 2
        value = np.where(walks.reached(first).T, value, -np.inf)
        picked = []
        for nodes, quota in by_kind:
            if quota:
                row, column, score = best_columns(np.ascontiguousarray(value[:, nodes]), order[nodes], quota, 12)
                picked.append((row, nodes[column], score))
        row, node, score = (np.concatenate([x[c] for x in picked]) for c in range(3))
        by = np.lexsort((order[node], -score, row))
        rank = np.arange(len(by)) - np.searchsorted(row[by], row[by]) + 1
        by, rank = by[rank <= top_k], rank[rank <= top_k]
        row, node, score = row[by], node[by], score[by]
        times = np.array([len(askers[lo + r]) for r in range(rows)])[row]
        each = np.repeat(np.arange(len(row)), times)
        nth = np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)
        who = np.concatenate([np.array(askers[lo + r]) for r in range(rows)])
        begin = np.cumsum([0, *(len(askers[lo + r]) for r in range(rows))])
        yield pa.table({"query": numbers[who[begin[row[each]] + nth]], "id": ids.take(pa.array(node[each])), "kind": pa.array(kinds[node[each]], pa.string()), "score": score[each], "rank": pa.array(rank[each], pa.int32())})


def triple_walk(facts: DataFrame, queries: DataFrame, top_k: int = 10, models: Models = STAND_INS, counts: DataFrame | None = None) -> DataFrame:
    """(query, fact, s, p, o, score, rank): facts by how often walks from the most similar facts' entities meet their two ends.

    ``facts`` (subject, fact, s, p, o), no row twice. Edges count as often as facts name them, loops do not; an end that no walk reaches has score 0. A subject's facts
    move once, to the task that searches, walks and ranks them in memory for all its questions; those of equal vectors count as one. ``counts`` (group, edges)
    says how many facts a subject has at most.
    """
    code = models.encode_text("concat_ws(chr(32), s, p, o)")
    sizes, placed = part_sizes(facts.select(F.col("subject").alias("group")) if counts is None else counts, queries.selectExpr("query", "subject AS `group`", "text"))
    asked = queries.selectExpr("query", f"{models.encode_text('text')} AS v")
    name = facts.schema["fact"].dataType.simpleString()
    rows = by_group(facts.selectExpr("subject AS `group`", "CAST(NULL AS bigint) AS query", "fact", "s", "p", "o", f"{code} AS v").selectExpr("`group`", "query", "fact", "s", "p", "o", *smaller("v")), sizes)
    rows = rows.unionByName(asked.join(placed, "query").selectExpr("`group`", "query", f"CAST(NULL AS {name}) AS fact", "CAST(NULL AS string) AS s", "CAST(NULL AS string) AS p", "CAST(NULL AS string) AS o", *smaller("v"), "part"))

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        is_fact = pc.is_null(group.column("query"))
        told, asks = group.filter(is_fact), group.filter(pc.invert(is_fact))
        out = [x for x in walked_facts(told, asks, top_k)] if len(told) and len(asks) else []
        empty = pa.table({"query": pa.array([], pa.int64()), **{c: group.column(c).slice(0, 0) for c in ("fact", "s", "p", "o")}, "score": pa.array([], pa.float64()), "rank": pa.array([], pa.int32())})
        return pa.concat_tables([empty, *out])

    found = rows.groupBy("group", "part").applyInArrow(run, f"query bigint, fact {name}, s string, p string, o string, score double, rank int")
    far = cut(queries.join(placed.select("query"), "query", "left_anti"))
    if not far.count():
        return found
    facts = cut(facts.join(F.broadcast(far.select("subject").distinct()), "subject", "left_semi"))
    told = facts.selectExpr("subject AS `group`", "fact AS id", "'' AS kind", f"{code} AS v")
    best = cut(similar(far.selectExpr("query", "subject AS `group`", f"{models.encode_text('text')} AS v"), told, top_k, dim=16, group=True).selectExpr("query", "id AS fact"))
    scoped = facts.selectExpr("fact", "s", "p", "o", "concat(subject, '/', s) AS a", "concat(subject, '/', o) AS b")
    # at most ``top_k`` facts a question
    begin = scoped.join(F.broadcast(best), "fact").select("query", F.expr("explode(array(a, b))").alias("id")).distinct().selectExpr("query", "id", "1D / count(*) OVER (PARTITION BY query) AS p")
    lines = scoped.where("a <> b").select(F.expr("inline(array(struct(a AS src, b AS dst), struct(b AS src, a AS dst)))")).groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    walk = settled_pagerank(lines, begin, 0.85, ("query",))
    ends = scoped.select("fact", "s", "p", "o", F.expr("explode(array(a, b)) AS id"))
    met = walk.join(ends, "id").groupBy("query", "fact", "s", "p", "o").agg(F.round(F.sum("score"), 9).alias("score"))
    return found.unionByName(R.top(met.withColumnRenamed("fact", "id"), ["query"], top_k).withColumnRenamed("id", "fact").select(*found.columns))


def walked_facts(told: pa.Table, asks: pa.Table, top_k: int) -> Iterator[pa.Table]:
    """The ``top_k`` facts of each question of a subject, a block of questions at a time."""
    x, good = unit_rows(16, told.column("small"), told.column("v"))
    v, able = unit_rows(16, asks.column("small"), asks.column("v"))
    if not good.any() or not able.any():
        return
    ids = pc.unique(pa.chunked_array([*told.column("s").chunks, *told.column("o").chunks]))
    a, b = (pc.index_in(told.column(c), value_set=ids).to_numpy().astype(np.int64) for c in "so")
    order = places(told.column("fact").combine_chunks())
    walks = GroupWalks(len(ids), a[a != b], b[a != b], np.ones(int((a != b).sum())), 0.85)
    numbers = asks.column("query").to_numpy()[able]
    # questions of equal vectors are walked once
    q, of = np.unique(v[able], axis=0, return_inverse=True)
    by_question = np.argsort(of, kind="stable")
    ends = np.searchsorted(of[by_question], np.arange(len(q) + 1))
    for lo in range(0, len(q), WALKS):
        near = q[lo : lo + WALKS] @ x.T
        near[:, ~good] = -np.inf
        row, fact, _ = best_columns(near, order, top_k, 9)
        first = np.zeros((len(ids), len(near)))
        first[a[fact], row] = first[b[fact], row] = 1
        first /= first.sum(0)
        score = np.where(walks.reached(first), walks.rest(first), -np.inf).T
        score = np.ascontiguousarray(score)
        # the ends of a fact with a line between lie in one part of the graph
        row, fact, value = best_columns(score[:, a] + score[:, b], order, top_k, 9)
        rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
        times = np.diff(ends)[lo + row]
        at = np.repeat(np.arange(len(row)), times)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
        names = told.select(["fact", "s", "p", "o"]).take(pa.array(fact[at]))
        yield pa.table({"query": numbers[by_question[ends[lo + row[at]] + nth]], **{c: names.column(c) for c in names.column_names}, "score": value[at], "rank": pa.array(rank[at], pa.int32())})


def phrase_lines(facts: DataFrame, models: Models = STAND_INS, floor: float = 0.8, most: int = 101, neighbours: int = 2047) -> DataFrame:
    """(a, b, weight), each pair once: phrases that share facts, phrases alike.

    ``facts`` (chunk, s, p, o) in their plain form. Phrases joined by facts weigh as many as there are; an edge to a
    synonym takes the place of the phrases' own weight in its direction, and the two directions add up. Every phrase whose
    hash is divisible by 50 looks for its synonyms among all.
    """
    phrases = facts.select(F.expr("explode(array(s, o))").alias("phrase")).where("phrase <> ''").distinct()
    own = facts.where("s <> o AND s <> '' AND o <> ''").select(F.expr("inline(array(struct(s AS src, o AS dst), struct(o AS src, s AS dst)))")).groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    coded = phrases.selectExpr("phrase", f"{models.encode_text('phrase')} AS v")
    asks = coded.where(f"length(regexp_replace(phrase, '[^A-Za-z0-9]', '')) > 2 AND {PHRASE_CODE} % 50 = 0").selectExpr("phrase AS query", "v")
    near = similar(asks, coded.selectExpr("phrase AS id", "'' AS kind", "v"), neighbours, dim=16, floor=floor).where("id <> query")
    alike = R.top(near.drop("rank"), ["query"], most).selectExpr("query AS src", "id AS dst", "score AS weight")
    kept = own.join(alike.select("src", "dst"), ["src", "dst"], "left_anti").unionByName(alike)
    return kept.selectExpr("least(src, dst) AS a", "greatest(src, dst) AS b", "weight").groupBy("a", "b").agg(F.sum("weight").alias("weight"))


def passage_graph(facts: DataFrame, lines: DataFrame) -> DataFrame:
    """(src, dst, weight), both ways: the lines of ``phrase_lines``, and passages and their phrases, with a weight of 1."""
    holds = facts.select("chunk", F.expr("explode(array(s, o))").alias("phrase")).where("phrase <> ''").distinct().selectExpr("phrase AS a", "concat('\u0001', chunk) AS b", "1D AS weight")
    return lines.unionByName(holds).select(F.expr("inline(array(struct(a AS src, b AS dst, weight), struct(b AS src, a AS dst, weight)))"))


PHRASE_CODE = "CAST(conv(substr(md5(phrase), 1, 6), 16, 10) AS bigint)"


#: Edges of phrases and passages, as numbers, that a task holds.
HELD = 1 << 25


def passage_search(facts: DataFrame, passages: DataFrame, lines: DataFrame, queries: DataFrame, *, link_k: int = 5, passage_weight: float = 0.05, damping: float = 0.5, top_k: int = 10, models: Models = STAND_INS) -> DataFrame:
    """(query, chunk, score, rank): passages by walks from the phrases of the best facts and, a little, from similar passages.

    ``facts`` (chunk, s, p, o), ``passages`` (chunk, text), ``lines`` of ``phrase_lines``. Similarities are scaled from the lowest to the highest
    of each query; a phrase weighs the mean over its facts of their score by the number of passages that hold it. Questions are dealt to
    tasks that hold the graph in numbers (up to ``HELD`` edges; beyond, walks go round by round): no pair of a question and a
    passage moves, and questions of equal vectors are walked once.
    """
    spark = facts.sparkSession
    asked = cut(queries.selectExpr("query", f"{models.encode_text('text')} AS q"))
    phrases, lines = numbered_rows(facts.select(F.expr("explode(array(s, o))").alias("phrase")).where("phrase <> ''").distinct()), cut(lines)
    ends = facts.join(phrases.selectExpr("phrase AS s", "n AS ns"), "s", "left").join(phrases.selectExpr("phrase AS o", "n AS no"), "o", "left")
    held = ends.groupBy("chunk").agg(F.expr("array_distinct(filter(flatten(collect_list(array(ns, no))), x -> x IS NOT NULL))").alias("ps"))
    # numbers are in the order of the names, so that ties need no names
    told = numbered_rows(passages.join(held, "chunk", "left").orderBy("chunk").selectExpr("chunk", "coalesce(ps, array()) AS ps", f"{models.encode_text('text')} AS v"))
    n_phrases, size = phrases.count(), told.agg(F.count("*").alias("n"), F.sum(F.size("ps")).alias("holds")).first()
    fits = lines.count() + (size["holds"] or 0) <= HELD
    single = asked.groupBy("query").agg(F.count("*").alias("times"), F.min("q").alias("q")).where(f"times = 1 AND {'true' if fits else 'false'}").select("query", "q")
    asks = cut(single.groupBy("q").agg(F.min("query").alias("first")).selectExpr("`first` AS query", "q AS v"))
    alike = single.join(asks.selectExpr("query AS first", "v AS q"), "q").select("query", "first")
    scored = facts.selectExpr("md5(concat_ws('|', s, p, o)) AS fact", "s", "p", "o").distinct().selectExpr("fact", "s", "o", f"{models.encode_text('concat_ws(chr(32), s, p, o)')} AS v")
    mentioned = facts.select(F.expr("explode(array(s, o))").alias("phrase"), F.col("chunk").alias("passage"))
    scored = cut(scored)
    near = cut(extremes(asks, scored.selectExpr("fact AS id", "v"), link_k, dim=16).selectExpr("query", "id AS fact", "CASE WHEN low = high THEN 1D ELSE (score - low) / (high - low) END AS score"))
    # at most ``link_k`` facts and phrases a question
    best = scored.select("fact", "s", "o").join(F.broadcast(near), "fact")
    starts = R.linked_phrases(best, mentioned, link_k).where("score > 0").join(phrases, F.col("id") == F.col("phrase"), "left").selectExpr("query", "coalesce(n, -1) AS place", "score AS x")
    total = asks.count()
    parts = max(1, min(spark.sparkContext.defaultParallelism, -(-total // WALKS)))
    # numbers whose hashes fall into one partition each
    keys = dict((r["at"], r["id"]) for r in spark.range(64 * parts).selectExpr("CAST(id AS int) AS id", f"pmod(hash(CAST(id AS int)), {parts}) AS at").collect())
    keys = F.array(*[F.lit(k) for k in keys.values()])
    row = lambda df, part, what, **c: df.select(part.alias("part"), F.lit(what).alias("what"), *(F.expr(f"CAST({c.get(k, 'NULL')} AS {t})").alias(k) for k, t in (("query", "bigint"), ("place", "bigint"), ("x", "double"), ("v", "array<double>"), ("data", "binary"))))
    one = F.element_at(keys, F.expr(f"CAST(pmod(xxhash64(query), {parts}) AS int) + 1"))
    rows = row(told.select("n", "ps", "v").mapInArrow(pack_passages, "n bigint, data binary"), F.explode(keys), 0, place="n", data="data")
    joined = lines.join(phrases.selectExpr("phrase AS a", "n AS na"), "a").join(phrases.selectExpr("phrase AS b", "n AS nb"), "b").select("na", "nb", "weight")
    rows = rows.unionByName(row(joined.mapInArrow(pack_lines, "data binary"), F.explode(keys), 1, data="data"))
    rows = rows.unionByName(row(asks, one, 2, query="query", v="v")).unionByName(row(starts, one, 3, query="query", place="place", x="x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(batches)
        for query, place, score in search_held(group, n_phrases, passage_weight, damping, top_k):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), query)), pa.array(place), pa.array(score)], names=["query", "n", "score"])

    found = cut(rows.repartition(parts, "part").mapInArrow(run, "query bigint, n bigint, score double"))
    named = told.select("n", "chunk").join(F.broadcast(found), "n").selectExpr("query AS first", "chunk AS id", "round(score, 12) AS score")
    out = named.join(F.broadcast(alike), "first").select("query", "id", "score")
    far = cut(asked.join(single, "query", "left_anti"))
    if far.count():
        from tidemark.functions.vectors import cosine

        pairs = lambda df, *names: df.crossJoin(F.broadcast(far)).selectExpr("query", *names, f"round({cosine('q', 'v')}, 9) AS score")
        reset = R.fact_passages(pairs(scored, "fact", "s", "o"), pairs(told, "concat('\u0001', chunk) AS id"), mentioned, link_k, passage_weight)
        walk = settled_pagerank(cut(passage_graph(facts, lines)), reset, damping, ("query",)).where("id LIKE '\u0001%'")
        out = out.unionByName(walk.selectExpr("query", "substr(id, 2) AS id", "round(score, 12) AS score"))
    return R.top(out, ["query"], top_k).withColumnRenamed("id", "chunk")


#: Walks of a task that go on at a time.
WALKS = 32


def plain(x: np.ndarray) -> np.ndarray:
    """Numbers in the smallest form that holds them exactly."""
    for kind in (np.int8, np.float32):
        with np.errstate(all="ignore"):
            if (x.astype(kind) == x).all():
                return x.astype(kind)
    return x


def pack_passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(n, data): unit vectors' directions and phrases of each batch of passages, in order."""
    for batch in batches:
        if batch.num_rows:
            ps, v = batch.column("ps"), batch.column("v")
            data = pickle.dumps((np.diff(ps.offsets.to_numpy()).astype(np.int32), ps.flatten().to_numpy().astype(np.int32), plain(v.flatten().to_numpy()).reshape(len(v), -1)))
            yield pa.RecordBatch.from_arrays([batch.column("n").slice(0, 1), pa.array([data], pa.binary())], names=["n", "data"])


def pack_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, w = (batch.column(k).to_numpy() for k in range(3))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((a.astype(np.int32), b.astype(np.int32), plain(w)))], pa.binary())], names=["data"])


def unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x**2).sum(1, keepdims=True))
    return np.divide(x, size, out=np.zeros(x.shape), where=size > 0)


def search_held(group: pa.Table, n_phrases: int, passage_weight: float, damping: float, top_k: int, tolerance: float = 1e-14, spare: int = 8) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, places, scores): the ``top_k`` best passages and a few more of each question of a task, by rounded score and then place."""
    of = lambda what: group.filter(pc.equal(group.column("what"), what))
    asks, starts = of(2).sort_by("query"), of(3)
    told = [pickle.loads(x) for x in of(0).sort_by("place").column("data").to_pylist()]
    if not told or not len(asks):
        return
    lines = [pickle.loads(x) for x in of(1).column("data").to_pylist()]
    joined = [np.concatenate([x[k] for x in lines]) if lines else np.zeros(0, np.int64) for k in range(3)]
    counts, phrase, v = (np.concatenate([x[k] for x in told]) for k in range(3))
    n = len(counts)
    walks = HeldWalks(n_phrases, (joined[0], joined[1], joined[2].astype(float)), n, (phrase, np.repeat(np.arange(n), counts)), damping)
    del told, lines, joined, phrase
    v = unit(v.astype(float))
    # walks from similar passages are sums of as many as vectors have numbers, and one from all passages alike
    base = walks.rest(walks.to_phrases(np.column_stack([v, np.ones(n)]) * ((1 - damping) / n)), tolerance)
    names, q = asks.column("query").to_numpy(), unit(np.array(asks.column("v").to_pylist(), float))
    row, place, x = np.searchsorted(names, starts.column("query").to_numpy()), starts.column("place").to_numpy(), starts.column("x").to_numpy()
    for lo in range(0, len(names), WALKS):
        own = q[lo : lo + WALKS]
        near = np.round(v @ own.T, 9)
        low, high = near.min(0), near.max(0)
        spread = np.where(high > low, high - low, 1.0)
        near = np.where(high > low, (near - low) / spread, 1.0) * passage_weight
        some = (row >= lo) & (row < lo + len(own))
        first = np.zeros((n_phrases, len(own)))
        np.add.at(first, (place[some & (place >= 0)], row[some & (place >= 0)] - lo), x[some & (place >= 0)])
        whole = near.sum(0) + np.bincount(row[some] - lo, x[some], len(own))
        # phrases and passages without an edge keep what restarts there
        alone = np.bincount(row[some & (place < 0)] - lo, x[some & (place < 0)], len(own)) + near[walks.degree == 0].sum(0)
        scale = np.where(whole > 0, whole, 1.0)
        mix = np.vstack([np.where(high > low, own.T / spread, 0.0), np.where(high > low, -low / spread, 1.0)]) * (passage_weight * n / scale)
        rest = walks.rest(first * ((1 - damping) / scale), tolerance) + base @ mix
        score = np.maximum(near * ((1 - damping) / scale) + walks.to_passages(rest), 0) / (1 - damping * alone / scale)
        for i in np.flatnonzero(whole > 0):
            value = score[:, i]
            if np.count_nonzero(value > 1e-12) < top_k:
                at = np.flatnonzero(walks.reached(first[:, i] > 0, near[:, i] > 0))
                best = at[leading(value[at], at, top_k, 12, spare)]
            else:
                best = leading(value, np.arange(n), top_k, 12, spare)
            yield int(names[lo + i]), best, value[best]
