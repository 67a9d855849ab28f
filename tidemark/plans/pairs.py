"""Queries that shape rows for contrastive training and retrieval tests, with their draws and pools."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import pairs as P
from tidemark.operators import sampling
from tidemark.operators.knn import similar
from tidemark.registry import Registry
from tidemark.runtime import table

registry = Registry()

_BASE = """b AS (SELECT DISTINCT id, subject, question AS q, upper(answer) AS letter, choice_a AS a, choice_b AS c, CASE upper(answer) WHEN 'A' THEN choice_a WHEN 'B' THEN choice_b WHEN 'C' THEN choice_c ELSE choice_d END AS gold, [choice_a, choice_b, choice_c, choice_d] AS opts
  FROM qa_mcq WHERE upper(answer) IN ('A', 'B', 'C', 'D') AND question IS NOT NULL AND choice_a IS NOT NULL AND choice_b IS NOT NULL AND choice_c IS NOT NULL AND choice_d IS NOT NULL)"""
#: What each shape's source has for a question, as columns of its own names.
TRAIN_SOURCES = {
    "beir": "'Q: ' AS query_prompt, 'D: ' AS doc_prompt, q AS query, array(gold) AS pos, opts AS neg, 2 AS num_hardneg", "berri": "concat('find', '[SEP]', q) AS question, struct('answer' AS title, gold AS text) AS pos, array(struct('' AS title, a AS text)) AS hard_negative_ctxs, array(struct('t' AS title, c AS text)) AS negative_ctxs, 2 AS num_hardneg",
    "video_classification": "'Name the action.' AS inst, gold AS pos_text, array('f1', 'f2') AS frames", "didemo": "q AS caption, CASE WHEN letter = 'A' THEN CAST(array() AS array<string>) ELSE array('f1') END AS frames", "docmatix": "opts AS users, array('p1', 'p2') AS images",
    "gui": "concat('<|image_1|> ', q) AS qry_text, gold AS pos_text, array('s1') AS qry_images, CAST(array() AS array<string>) AS pos_images", "llavahound_caption": "CASE WHEN letter < 'C' THEN 'caption_retrieval' ELSE 'video_retrieval' END AS mode, array(concat('<video> ', q), gold) AS conversations, array('f1', 'f2') AS frames",
    "llavahound_qa": "array(concat('<video> ', q), gold) AS conversations, array('f1') AS frames", "mmeb": "concat('<|image_1|> ', q) AS qry, 'i1' AS qry_image_path, gold AS pos_text, '' AS pos_image_path, CASE WHEN letter = 'B' THEN a ELSE '' END AS neg_text", "msrvtt": "array(q, gold) AS caption, array('f1') AS frames",
    "msvd": "array(q, gold) AS caption, array('f1') AS frames", "mteb_cluster": "'T: ' AS query_prompt, 'L: ' AS doc_prompt, CASE WHEN letter < 'C' THEN 's2s' ELSE 'p2p' END AS data_format, q AS title, gold AS abstract, letter AS label, opts AS neg, 1 AS num_hardneg",
    "mteb_training": "'T: ' AS query_prompt, 'L: ' AS doc_prompt, q AS text, concat(' ', letter, ' ') AS label_text, opts AS neg, 1 AS num_hardneg", "pixmo": "q AS query_text, array(id) AS positive_document_ids, 'img' AS image_dir", "ssv2": "'Name the action.' AS inst, gold AS pos_text, array('f1') AS frames",
    "vidore": "q AS query, gold AS answer, concat(id, '.png') AS image_filename", "visrag": "CASE WHEN letter = 'A' THEN '' ELSE 'About a chart.' END AS query_prompt, 'A chart.' AS target_prompt, q AS query, concat(id, '.png') AS image",
}
_V, _I, _NO = P.VIDEO, P.IMAGE, "CAST([] AS VARCHAR[])"
_s = lambda x: "'" + x.replace("'", "''") + "'"
#: query_text, pos_text, neg, query_paths, pos_paths and condition of each shape in SQL.
_TRAIN_SQL = {
    "beir": ("'Q: ' || q", "'D: ' || gold", "['D: ' || opts[1], 'D: ' || opts[2]]", _NO, _NO, "true"), "berri": ("'find' || chr(9) || q", "'answer' || chr(9) || gold", "[a, 't' || chr(9) || c]", _NO, _NO, "true"),
    "video_classification": (_s(f"{_V} Name the action."), "gold", _NO, "['f1', 'f2']", _NO, "true"), "didemo": (f"{_s(P.FIND_SCENES)} || ' ' || q", _s(f"{_V} {P.SEE_VIDEO}"), _NO, _NO, "['f1']", "letter <> 'A'"),
    "docmatix": (f"{_s(P.PDF_QUERY)} || ' Q: ' || opts[CAST(CAST(concat('0x', md5(array_to_string(opts, ', ') || ':1')[1:8]) AS BIGINT) % 4 AS INTEGER) + 1]", _s(f"{P.PDF_TARGET} {_I}{_I}"), _NO, _NO, "['p1', 'p2']", "true"),
    "gui": (f"'{_I} ' || q", "gold", _NO, "['s1']", _NO, "true"), "llavahound_caption": (f"CASE WHEN letter < 'C' THEN '{_V} ' || q ELSE {_s(P.VIDEO_QUERY)} || gold END", f"CASE WHEN letter < 'C' THEN gold ELSE {_s(P.VIDEO_TARGET + _V)} END", _NO, f"CASE WHEN letter < 'C' THEN ['f1', 'f2'] ELSE {_NO} END", f"CASE WHEN letter < 'C' THEN {_NO} ELSE ['f1', 'f2'] END", "true"),
    "llavahound_qa": (f"{_s(P.VIDEO_QA + _V + ' ')} || q", "gold", _NO, "['f1']", _NO, "true"), "mmeb": (f"'{_I} ' || q", "gold", f"CASE WHEN letter = 'B' THEN [a] ELSE {_NO} END", "['i1']", _NO, "true"),
    "msrvtt": (f"{_s(P.FIND_CONTENT)} || ' ' || q", _s(f"{_V} {P.SEE_VIDEO}"), _NO, _NO, "['f1']", "true"), "msvd": (f"{_s(P.FIND_DESCRIBED)} || ' ' || q", _s(f"{_V} {P.SEE_VIDEO}"), _NO, _NO, "['f1']", "true"),
    "mteb_cluster": ("'T: ' || CASE WHEN letter < 'C' THEN q ELSE q || chr(10) || gold END", "'L: ' || letter", "['L: ' || opts[1]]", _NO, _NO, "true"), "mteb_training": ("'T: ' || q", "'L: ' || lower(letter)", "['L: ' || opts[1]]", _NO, _NO, "true"),
    "pixmo": (f"{_s(P.PIXMO_QUERY)} || q", _s(P.PIXMO_TARGET + _I), _NO, _NO, "['img/' || id || '.png']", "true"), "ssv2": (_s(f"{_V} Name the action."), "gold", _NO, "['f1']", _NO, "true"),
    "vidore": (f"'{_I} ' || q", "gold", _NO, "[id || '.png']", _NO, "true"), "visrag": ("CASE WHEN letter = 'A' THEN '' ELSE 'About a chart. ' END || q || ' '", _s(f"A chart.  {_I}"), _NO, _NO, "[id || '.png']", "true"),
}
TEST_SOURCES = {
    "activitynetqa": "q AS question, CASE WHEN letter < 'C' THEN 'yes' WHEN letter = 'C' THEN 'no' ELSE 'maybe' END AS answer, array('f1') AS frames", "didemo": "q AS caption, id AS video_id", "egoschema": "q AS question, transform(opts, (o, i) -> concat(chr(65 + i), '. ', o, '.')) AS options, ascii(letter) - 65 AS answer, array('f1') AS frames",
    "image_cls": "'<|image_1|>\\nName it' AS qry_inst, q AS qry_text, concat(array(gold), opts) AS tgt_text, 'i1' AS qry_img_path", "image_i2i_vg": "'<|image_1|> Select it' AS qry_inst, q AS qry_text, '<|image_1|> Show' AS tgt_inst, array(CASE WHEN letter = 'A' THEN ' ' ELSE gold END, a) AS tgt_text, array('t1', 't2') AS tgt_img_path, 'i1' AS qry_img_path",
    "image_i2t": "'<|image_1|>\\nName it' AS qry_inst, q AS qry_text, concat(array(gold), opts) AS tgt_text, 'i1' AS qry_img_path", "image_qa": "'<|image_1|>\\nAnswer' AS qry_inst, q AS qry_text, concat(array(gold), opts) AS tgt_text, 'i1' AS qry_img_path",
    "image_t2i": "'Find an image' AS qry_inst, q AS qry_text, '<|image_1|> Show' AS tgt_inst, array(CASE WHEN letter = 'A' THEN '' ELSE gold END, a) AS tgt_text, array('t1', 't2') AS tgt_img_path", "moment_retrieval": "q AS query, concat(id, '.mp4') AS video_path, array('negative_1.mp4', 'positive_1.mp4') AS clips",
    "momentseeker": "q AS query, CASE letter WHEN 'A' THEN 'x.mp4' WHEN 'B' THEN 'x.jpg' ELSE '' END AS input, array(concat('v/', id, '.mp4')) AS positives, array('v/n.mp4') AS negatives", "msrvtt": "q AS caption, id AS video_id", "msvd": "array(q, gold) AS caption, id AS video_id",
    "mvbench": "q AS question, opts AS options, gold AS answer, array('f1') AS frames", "nextqa": "q AS question, concat(opts, array('none')) AS options, gold AS answer, array('f1') AS frames", "ssv2": "'Name the action.' AS inst, opts AS neg_text, gold AS pos_text, array('f1') AS frames", "vatex": "array(q, gold) AS caption, id AS video_id",
    "video_classification": "'Name the action.' AS inst, gold AS pos_text, array('f1') AS frames", "videomme": "q AS question, transform(opts, (o, i) -> concat(chr(65 + i), '. ', o, '.')) AS options, letter AS answer, array('f1') AS frames", "videommmu": "q AS question, opts AS options, letter AS answer, CASE WHEN letter = 'D' THEN 'open' ELSE 'multiple-choice' END AS question_type, array('f1') AS frames",
    "vidore": "q AS query, array(id, 'd2') AS docs, array(2D, 1D) AS scores, 'root' AS image_root", "visrag": "q AS query, array(concat(id, '.jpg')) AS docs, array(1D) AS scores, 'root' AS image_root", "youcook2": "q AS sentence, id AS video_id",
}
_ask = f"'{_V} {P.CHOOSE} '"
_opt = "list_transform(opts, lambda o, i: chr(CAST(64 + i AS INTEGER)) || '. ' || o || '.')"
_let = "list_transform({o}, lambda o, i: '(' || chr(CAST(64 + i AS INTEGER)) || ') ' || o)"
_qa = "{ask} || q || chr(10) || 'Options:' || chr(10) || array_to_string({let}, chr(10))"
_clip = _s(f"{_V} {P.SEE_CLIP}")
_video = lambda inst: (f"{_s(inst)} || ' ' || q", f"[{_s(f'{_V} {P.SEE_VIDEO}')}]", "[id]", "[id]", "true")
_page = _s(f"{_I} {P.SEE_PAGE}")
_gold_let = "'(' || letter || ') ' || gold"
#: query_text, cand_text, cand_names, label_names and condition of each shape in SQL.
_TEST_SQL = {
    "activitynetqa": (f"{_ask} || q || '? (A) yes; (B) no.'", "['yes', 'no']", "['yes', 'no']", "[CASE WHEN letter < 'C' THEN 'yes' ELSE 'no' END]", "letter <> 'D'"), "didemo": _video(P.FIND_SCENES), "egoschema": (f"{_ask} || q || array_to_string({_opt}, ' ')", "list_transform(opts, lambda o: regexp_replace(regexp_replace(o, '^[. ]+', ''), '[. ]+$', ''))", _opt, "[letter || '. ' || gold || '.']", "true"),
    "image_cls": (f"'{_I}' || chr(10) || 'Name it ' || q || chr(10)", "list_concat([gold], opts)", "list_concat([gold], opts)", "[gold]", "true"), "image_i2t": (f"'{_I}' || chr(10) || 'Name it ' || q || chr(10)", "list_concat([gold], opts)", "list_concat([gold], opts)", "[gold]", "true"),
    "image_qa": (f"'{_I}' || chr(10) || 'Answer ' || q || chr(10)", "list_concat([gold], opts)", "list_concat([gold], opts)", "[gold]", "true"),
    "image_i2i_vg": (f"'{_I}' || chr(10) || 'Select it ' || q || chr(10)", f"CASE WHEN letter = 'A' THEN ['{_I} <|image_1|> Show', '{_I} <|image_1|> Show'] ELSE ['{_I}  Show ' || gold || chr(10), '{_I}  Show ' || a || chr(10)] END", "['t1:' || CASE WHEN letter = 'A' THEN ' ' ELSE gold END, 't2:' || a]", "['t1:' || CASE WHEN letter = 'A' THEN ' ' ELSE gold END]", "true"),
    "image_t2i": ("'Find an image ' || q || chr(10)", f"CASE WHEN letter = 'A' THEN ['{_I} <|image_1|> Show' || chr(10), '{_I} <|image_1|> Show' || chr(10)] ELSE ['{_I}  Show ' || gold || chr(10), '{_I}  Show ' || a || chr(10)] END", "['t1', 't2']", "['t1']", "true"),
    "moment_retrieval": (f"{_s(f'{_V} {P.FIND_MOMENT}')} || ' ' || q", f"[{_clip}, {_clip}]", "['negative_1.mp4', 'positive_1.mp4']", "['positive_1.mp4']", "true"),
    "momentseeker": (f"CASE letter WHEN 'A' THEN {_s(f'{_V} {P.SEEK_VIDEO}')} WHEN 'B' THEN {_s(f'{_I} {P.SEEK_IMAGE}')} ELSE {_s(P.SEEK_TEXT)} END || ' ' || q", f"[{_clip}, {_clip}]", "['v_' || id, 'v_n']", "['v_' || id]", "true"),
    "msrvtt": _video(P.FIND_CONTENT), "msvd": _video(P.FIND_DESCRIBED), "vatex": _video(P.FIND_CONTENT), "youcook2": _video(P.FIND_RECIPE),
    "mvbench": (_qa.format(ask=_ask, let=_let.format(o="opts")), _let.format(o="opts"), _let.format(o="opts"), f"list_filter({_let.format(o='opts')}, lambda o: o[5:] = gold)", "true"), "nextqa": (_qa.format(ask=_ask, let=_let.format(o="list_concat(opts, ['none'])")), _let.format(o="list_concat(opts, ['none'])"), _let.format(o="list_concat(opts, ['none'])"), f"list_filter({_let.format(o='opts')}, lambda o: o[5:] = gold)", "true"),
    "ssv2": (_s(f"{_V} Name the action."), "opts", "opts", "[gold]", "true"), "video_classification": (_s(f"{_V} Name the action."), "[gold]", "[gold]", "[gold]", "true"), "videomme": (f"{_ask} || q || chr(10) || array_to_string({_opt}, chr(10))", "list_transform(opts, lambda o: regexp_replace(regexp_replace(o, '^[. ]+', ''), '[. ]+$', ''))", _opt, "[letter || '. ' || gold || '.']", "true"),
    "videommmu": (_qa.format(ask=_ask, let=_let.format(o="opts")), _let.format(o="opts"), _let.format(o="opts"), f"[{_gold_let}]", "letter <> 'D'"), "vidore": (f"{_s(P.FIND_PAGE)} || ' ' || q", f"[{_page}, {_page}]", "[id, 'd2']", "[id, 'd2']", "true"), "visrag": (f"{_s(P.FIND_PAGE)} || ' ' || q", f"[{_page}]", "[id || '.jpg']", "[id || '.jpg']", "true"),
}


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = "upper(answer) IN ('A', 'B', 'C', 'D') AND question IS NOT NULL AND choice_a IS NOT NULL AND choice_b IS NOT NULL AND choice_c IS NOT NULL AND choice_d IS NOT NULL"
    gold = "CASE upper(answer) WHEN 'A' THEN choice_a WHEN 'B' THEN choice_b WHEN 'C' THEN choice_c ELSE choice_d END"
    return table(spark, sf_dir, "qa_mcq").where(full).selectExpr("id", "subject", "question AS q", "upper(answer) AS letter", "choice_a AS a", "choice_b AS c", f"{gold} AS gold", "array(choice_a, choice_b, choice_c, choice_d) AS opts").distinct()


def _source(rows: DataFrame, columns: str) -> DataFrame:
    rows.createOrReplaceTempView("__pair_source")
    return rows.sparkSession.sql(f"SELECT id, {columns} FROM __pair_source")


_joined = lambda c: f"coalesce(array_to_string({c}, '|'), '')"


@registry.add("train_pairs", f"WITH {_BASE} " + " UNION ALL ".join(f"SELECT id, '{k}' AS parser, {q} AS query_text, {p} AS pos_text, {_joined(n)} AS neg, {_joined(a)} AS query_paths, {_joined(b)} AS pos_paths FROM b WHERE {w}" for k, (q, p, n, a, b, w) in _TRAIN_SQL.items()))
def train_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions as rows of each training shape."""
    rows, out = base(spark, sf_dir), None
    for name, columns in TRAIN_SOURCES.items():
        made = P.train_rows(_source(rows, columns), name, ("id",)).selectExpr("id", "global_dataset_name AS parser", "query_text", "pos_text", *(f"array_join({c}, '|') AS {n}" for c, n in (("neg_text", "neg"), ("query_paths", "query_paths"), ("pos_paths", "pos_paths"))))
        out = made if out is None else out.unionByName(made)
    return out


@registry.add("test_pairs", f"WITH {_BASE} " + " UNION ALL ".join(f"SELECT id, '{k}' AS parser, {q} AS query_text, {_joined(c)} AS cands, {_joined(n)} AS names, {_joined(x)} AS labels FROM b WHERE {w}" for k, (q, c, n, x, w) in _TEST_SQL.items()))
def test_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions as rows of each test shape."""
    rows, out = base(spark, sf_dir), None
    for name, columns in TEST_SOURCES.items():
        made = P.test_rows(_source(rows, columns), name, ("id",)).selectExpr("id", "global_dataset_name AS parser", "query_text", *(f"array_join({c}, '|') AS {n}" for c, n in (("cand_text", "cands"), ("cand_names", "names"), ("label_names", "labels"))))
        out = made if out is None else out.unionByName(made)
    return out


test_pairs.__test__ = False

_CODE = "CAST(concat('0x', md5({x})[1:12]) AS BIGINT)"


@registry.add("drawn_negatives", f"WITH {_BASE}, h AS (SELECT id, opts, gold, unnest(list_filter(opts, lambda o: o <> gold)) AS x FROM b), r AS (SELECT id, x, row_number() OVER (PARTITION BY id ORDER BY {_CODE.format(x="id || ':1:' || x")}, x) AS k FROM h) SELECT id, string_agg(x, '|' ORDER BY k) AS neg FROM r WHERE k <= 2 GROUP BY id")
def drawn_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7: two wrong choices of each question, without replacement."""
    return base(spark, sf_dir).selectExpr("id", f"array_join({P.sampled('filter(opts, o -> o <> gold)', 'id', 2)}, '|') AS neg").where("neg <> ''")


@registry.add("label_negatives", f"WITH d AS (SELECT doc_id, source, md5(text) AS t, CAST(doc_id AS VARCHAR) AS k, {_CODE.format(x='CAST(doc_id AS VARCHAR)')} % 64 AS slot FROM documents WHERE text IS NOT NULL AND source IS NOT NULL), p AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY slot, source ORDER BY {_CODE.format(x="k || ':1'")}, k) <= 3), n AS (SELECT d.doc_id, p.t, row_number() OVER (PARTITION BY d.doc_id ORDER BY {_CODE.format(x="p.k || ':' || d.k")}, p.k) AS r FROM d JOIN p ON p.slot = d.slot AND p.source <> d.source) SELECT doc_id, string_agg(t, '|' ORDER BY r) AS neg FROM n WHERE r <= 3 GROUP BY doc_id")
def label_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three texts of other labels for each text, from pools that no label fills."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL AND source IS NOT NULL").selectExpr("doc_id", "source", "md5(text) AS t")
    return P.negatives_of_labels(d, "source", "doc_id", "t", 3).selectExpr("doc_id", "array_join(neg, '|') AS neg").where("neg <> ''")


@registry.add("label_index", "WITH r AS (SELECT source, doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 4096 AS chunk FROM documents WHERE source IS NOT NULL) SELECT source, CAST(chunk AS BIGINT) AS chunk, count(*) AS ids, md5(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id)) AS digest FROM r GROUP BY ALL")
def label_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of each label, in lists of bounded length."""
    made = P.label_chunks(table(spark, sf_dir, "documents").where("source IS NOT NULL"), "source", "doc_id")
    return made.selectExpr("source", "chunk", "CAST(size(ids) AS bigint) AS ids", "md5(array_join(ids, ',')) AS digest")


@registry.add("qrels_candidates", "WITH g AS (SELECT id AS qid, judge_id AS doc, max(raw_score) AS score FROM eval_results WHERE raw_score > 0 AND raw_score <= 5 AND judge_id IS NOT NULL GROUP BY ALL), q AS (SELECT DISTINCT id, question FROM qa_mcq WHERE question IS NOT NULL) SELECT q.id, q.question AS query_text, string_agg(doc, '|' ORDER BY doc) AS cand_names, string_agg(CAST(score AS VARCHAR), '|' ORDER BY doc) AS rel_scores FROM q JOIN g ON g.qid = q.id GROUP BY ALL")
def qrels_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries with the arrays of their judged candidates and scores."""
    e = table(spark, sf_dir, "eval_results").where("raw_score > 0 AND raw_score <= 5 AND judge_id IS NOT NULL").groupBy(F.col("id").alias("qid"), F.col("judge_id").alias("doc")).agg(F.max("raw_score").alias("score"))
    arrays = e.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("doc", "score"))).alias("x"))  # as many as a question has judges
    q = table(spark, sf_dir, "qa_mcq").where("question IS NOT NULL").select("id", F.col("question").alias("query_text")).distinct()
    return q.join(arrays, q["id"] == arrays["qid"]).selectExpr("id", "query_text", "array_join(x.doc, '|') AS cand_names", "array_join(transform(x.score, s -> CAST(s AS string)), '|') AS rel_scores")


@registry.add("candidate_corpus", "WITH q AS (SELECT DISTINCT id, [choice_a, choice_b, choice_c, choice_d] AS c FROM qa_mcq), f AS (SELECT id AS ord, unnest(c) AS t FROM q UNION ALL SELECT '~' || CAST(doc_id AS VARCHAR), text FROM documents WHERE text IS NOT NULL), n AS (SELECT ord, lower(trim(t, ' ')) AS cand_name, t FROM f WHERE t IS NOT NULL) SELECT md5(cand_name) AS name, md5(arg_min(t, struct_pack(a := ord, b := t))) AS cand FROM n GROUP BY cand_name")
def candidate_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of all questions and a corpus as one list, the first of each name."""
    q = table(spark, sf_dir, "qa_mcq").selectExpr("id AS ord", "filter(array(choice_a, choice_b, choice_c, choice_d), x -> x IS NOT NULL) AS cand_text").distinct()
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").selectExpr("concat('~', doc_id) AS ord", "array(text) AS cand_text")
    rows = q.unionByName(d).selectExpr("ord", "transform(cand_text, t -> lower(trim(t))) AS cand_names", "cand_text")
    return P.corpus(rows).selectExpr("md5(cand_name) AS name", "md5(cand_text) AS cand")


@registry.add("yes_no_sample", "WITH r AS (SELECT DISTINCT pair_id, lower(trim(model_option, ' ')) AS o FROM qa_results WHERE type = 'mcq'), k AS (SELECT *, row_number() OVER (ORDER BY pair_id) - 1 AS rn, count(*) OVER () AS n FROM r WHERE o IN ('a', 'b', '(a)', '(b)')), s AS (SELECT DISTINCT i * (n - 1) // 49 AS rn FROM (SELECT DISTINCT n FROM k), range(50) t(i)) SELECT k.pair_id, k.o FROM k WHERE n <= 50 OR rn IN (SELECT rn FROM s)")
def yes_no_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with one of the wanted answers, evenly spread over their order; sampling is the feature."""
    from tidemark.operators.slices import numbered

    r = table(spark, sf_dir, "qa_results").where("type = 'mcq'").selectExpr("pair_id", "lower(trim(model_option)) AS o").distinct().where("o IN ('a', 'b', '(a)', '(b)')").withColumn("all", F.lit(0))
    at = numbered(r, ["all"], ["pair_id"], "floor(pair_id / 4096)", count="n").withColumn("rn", F.col("rn") - 1)
    step = "(rn * 49 + n - 2) DIV (n - 1)"
    return at.where(f"n <= 50 OR (({step}) <= 49 AND ({step}) * (n - 1) DIV 49 = rn)").select("pair_id", "o")


@registry.add("folder_candidates", "WITH k AS (SELECT DISTINCT regexp_extract(key, '^(.*)/[^/]*$', 1) AS folder, regexp_extract(key, '([^/]*)$', 1) AS name FROM visual_embeddings WHERE key LIKE '%/%') SELECT folder, count(*) AS cands, md5(string_agg(name, '|' ORDER BY name)) AS digest, max(CASE WHEN starts_with(name, '10') THEN name END) AS positive FROM k GROUP BY folder")
def folder_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of each folder as candidates, the positive one told by how its name starts."""
    k = table(spark, sf_dir, "visual_embeddings").where("key LIKE '%/%'").selectExpr("regexp_extract(key, '^(.*)/[^/]*$', 1) AS folder", "regexp_extract(key, '([^/]*)$', 1) AS name").distinct()
    return k.groupBy("folder").agg(F.count("*").alias("cands"), F.md5(F.array_join(F.array_sort(F.collect_list("name")), "|")).alias("digest"), F.max(F.expr("CASE WHEN startswith(name, '10') THEN name END")).alias("positive"))


@registry.add("tagged_subsets", "SELECT lower(lang) AS subset, 'documents' AS tag, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE lower(lang) IN ('en', 'de') GROUP BY ALL UNION ALL SELECT granularity, 'captions', count(*), min(caption_id) FROM captions_a WHERE granularity IN ('1h', '10min') GROUP BY ALL")
def tagged_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subsets one after the other, each with its tag."""
    d = table(spark, sf_dir, "documents").selectExpr("lower(lang) AS subset", "'documents' AS tag", "doc_id AS id").where("subset IN ('en', 'de')")
    c = table(spark, sf_dir, "captions_a").selectExpr("granularity AS subset", "'captions' AS tag", "caption_id AS id").where("subset IN ('1h', '10min')")
    return d.unionByName(c).groupBy("subset", "tag").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


_HARD = "s AS (SELECT q.vec_id AS query, v.vec_id AS id, q.label = v.label AS same, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 9) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id), p AS (SELECT query, max(score) AS pos FROM s WHERE same GROUP BY query), n AS (SELECT s.query, s.id, s.score, p.pos, row_number() OVER (PARTITION BY s.query ORDER BY s.score DESC, s.id) AS r FROM s JOIN p ON p.query = s.query WHERE NOT same QUALIFY r <= 30)"


@registry.add("hard_negatives", f"WITH {_HARD}, k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY r) AS rr FROM n WHERE score < 0.9 AND score < pos - 0.01 AND score < pos * 0.99 AND id % 7 <> 0) SELECT query, id, CAST(rr AS INTEGER) AS rank FROM k WHERE rr BETWEEN 3 AND 10")
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """negatives below a threshold and below the positive by margin and ratio, without excluded ids, of a range of ranks."""
    e = table(spark, sf_dir, "embeddings")
    items = e.selectExpr("vec_id AS id", "embedding AS v", "label AS kind", "label AS `group`")
    q = e.where("vec_id % 50 = 0").selectExpr("vec_id AS query", "embedding AS v", "label AS `group`")
    pos = similar(q, items, 2, dim=64, group=True).where("id <> query").groupBy("query").agg(F.max("score").alias("pos_score"))
    near = similar(q, items, 30, dim=64, per_kind=True).join(q.select("query", F.col("group").alias("own")), "query").where("kind <> CAST(own AS string)")
    best = near.selectExpr("query", "id", "score", "row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS r").where("r <= 30")
    rows = best.groupBy("query").agg(F.expr("array_sort(collect_list(struct(r, id, score)))").alias("x")).join(pos, "query").selectExpr("query", "x.id AS neg", "x.score AS neg_score", "pos_score")
    kept = sampling.hard_negatives(rows, margin=0.01, ratio=0.99, threshold=0.9, excluded="filter(neg, i -> i % 7 = 0)", ranks=(3, 10))
    return kept.selectExpr("query", "posexplode(kept) AS (k, id)").selectExpr("query", "id", "k + 3 AS rank")
