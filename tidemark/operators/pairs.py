"""Datasets as rows for contrastive training and for retrieval tests, by one specification for each shape of source.

A specification names SQL expressions over the source's columns. Training rows are (query_text, query_paths, pos_text, pos_paths, neg_text,
neg_paths, global_dataset_name); test rows are (query_text, query_paths, cand_text, cand_paths, cand_names, label_names,
rel_scores, global_dataset_name), all text of candidates in arrays. Pictures and frames are paths; reading them is left to a loader. Rows without
query or without positive are dropped. Choices that a specification leaves open are drawn by a seeded hash.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tokens that stand for pictures and videos, instructions of tasks.
IMAGE, VIDEO = "<|image_pad|>", "<|video_pad|>"
SEE_VIDEO, SEE_CLIP, SEE_PAGE = "Understand the content of the provided video.", "Understand the content of the provided video clip.", "Understand the content of the provided document image."
FIND_CONTENT, FIND_SCENES, FIND_SUMMARY = "Find a video that contains the following visual content:", "Find a video that includes the following described scenes:", "Find the video snippet that corresponds to the given summary:"
FIND_DESCRIBED, FIND_RECIPE, FIND_PAGE = "Select a video that fits the description provided:", "Find a video that demonstrates the following action while making a recipe:", "Find a document image that matches the given query:"
FIND_MOMENT, SEEK_VIDEO, SEEK_IMAGE, SEEK_TEXT = "Find the clip that corresponds to the described scene in the given video:", "Find the clip that corresponds to the given sentence and video segment:", "Select the video clip that aligns with the given text and image:", "Find the clip that corresponds to the given text:"
CHOOSE = "Given a video and a question, select the most accurate answer from the provided candidates. Return only the exact text of your chosen answer. Question: "
PIXMO_QUERY, PIXMO_TARGET = "Retrieve documents that best answer the following query: ", "Generate an embedding for the following document, in the format of images: "
PDF_QUERY, PDF_TARGET = "Given the question below, retrieve the most relevant PDF document that can help answer it:\n: ", "Represent the following PDF pages: "
VIDEO_QUERY, VIDEO_TARGET, VIDEO_QA = "Find a video that contains the following visual content: ", "Understand the content of the provided video: ", "Answer a question based on the content of a video. "


def lit(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def told(instruction: str, text: str | None = None, token: str | None = None) -> str:
    """Token, instruction and text with blanks between; an empty text leaves only the instruction. ``instruction`` is SQL."""
    body = f"CASE WHEN coalesce({text}, '') <> '' THEN concat({instruction}, ' ', {text}) ELSE {instruction} END" if text else instruction
    return f"concat({lit(token + ' ')}, {body})" if token else body


def lettered(question: str, options: str) -> str:
    """A question with its options in lines (A), (B) and so on."""
    return f"concat({question}, '\\nOptions:\\n', array_join(transform({options}, (c, i) -> concat('(', chr(65 + i), ') ', c)), '\\n'))"


def with_letters(options: str) -> str:
    return f"transform({options}, (c, i) -> concat('(', chr(65 + i), ') ', c))"


def bare_options(options: str) -> str:
    """The text of options like 'A. text.' without letter, full stops and blanks."""
    return f"transform({options}, o -> regexp_replace(substr(o, greatest(locate('. ', o), 1)), '^[. ]+|[. ]+\\\\z', ''))"


def drawn(array: str, row: str, seed: int = 1) -> str:
    """One member of an array, by a hash of the row."""
    return f"element_at({array}, CAST(CAST(conv(substr(md5(concat({row}, ':{seed}')), 1, 8), 16, 10) AS bigint) % size({array}) AS int) + 1)"


@dataclass(frozen=True)
class Train:
    query: str
    pos: str = "CAST(NULL AS string)"
    query_paths: str = "CAST(array() AS array<string>)"
    pos_paths: str = "CAST(array() AS array<string>)"
    neg: str = "CAST(array() AS array<string>)"
    neg_paths: str = "CAST(array() AS array<string>)"
    keep: str = "true"


@dataclass(frozen=True)
class Test:
    query: str
    cand: str
    names: str
    labels: str
    query_paths: str = "CAST(array() AS array<string>)"
    cand_paths: str = "CAST(array() AS array<string>)"
    rel: str = "CAST(NULL AS array<double>)"
    keep: str = "true"
    options: dict = field(default_factory=dict)


_ASK = lambda q: f"concat({lit(VIDEO + ' ' + CHOOSE + ' ')}, {q})"
_TO_VIDEO = lambda inst, text, name, see=SEE_VIDEO: Test(told(lit(inst), text), f"array({told(lit(see), token=VIDEO)})", f"array({name})", f"array({name})")
_IMAGE_QUERY = lambda inst: f"concat(replace({told(inst, 'qry_text', IMAGE)}, ' \\n', '\\n'), '\\n')"
_NO_MARK = "regexp_replace(replace(qry_inst, '<|image_1|>', ''), '^\\\\s+|\\\\s+\\\\z', '')"
_TARGETS = f"CASE WHEN trim(tgt_text[0]) <> '' THEN transform(tgt_text, c -> concat(replace(concat({lit(IMAGE + ' ')}, replace(tgt_inst, '<|image_1|>', ''), ' ', c), ' \\n', '\\n'), '\\n')) ELSE transform(tgt_img_path, p -> {{empty}}) END"
_PLAIN_TARGET = f"replace(concat({lit(IMAGE + ' ')}, tgt_inst), ' \\n', '\\n')"

#: Training shapes by name. Columns: ``inst`` is the task's instruction, other names are those of the source.
TRAIN: dict[str, Train] = {
    "beir": Train("concat(query_prompt, query)", f"concat(doc_prompt, {drawn('pos', 'query')})", neg="transform(slice(neg, 1, num_hardneg), n -> concat(doc_prompt, n))"),
    "berri": Train("concat_ws('\\t', nullif(split(question, '\\\\[SEP\\\\]')[0], ''), split(question, '\\\\[SEP\\\\]')[1])", "concat_ws('\\t', nullif(pos.title, ''), pos.text)", neg="transform(slice(concat(hard_negative_ctxs, CASE WHEN size(hard_negative_ctxs) < num_hardneg THEN negative_ctxs ELSE array() END), 1, num_hardneg), n -> concat_ws('\\t', nullif(n.title, ''), n.text))"),
    "video_classification": Train(told("inst", token=VIDEO), "pos_text", query_paths="frames"),
    "didemo": Train(told(lit(FIND_SCENES), "caption"), told(lit(SEE_VIDEO), token=VIDEO), pos_paths="frames", keep="size(frames) > 0"),
    "docmatix": Train(f"concat({lit(PDF_QUERY)}, ' Q: ', {drawn('users', "array_join(users, ', ')")})", f"concat({lit(PDF_TARGET)}, ' ', repeat({lit(IMAGE)}, size(images)))", pos_paths="images"),
    "gui": Train(f"replace(qry_text, '<|image_1|>', {lit(IMAGE)})", f"replace(pos_text, '<|image_1|>', {lit(IMAGE)})", query_paths="qry_images", pos_paths="pos_images", keep="NOT (coalesce(qry_text, '') = '' AND size(qry_images) = 0) AND NOT (coalesce(pos_text, '') = '' AND size(pos_images) = 0)"),
    "llavahound_caption": Train(f"CASE WHEN mode = 'caption_retrieval' THEN replace(conversations[0], '<video>', {lit(VIDEO)}) ELSE concat({lit(VIDEO_QUERY)}, conversations[1]) END", f"CASE WHEN mode = 'caption_retrieval' THEN conversations[1] ELSE concat({lit(VIDEO_TARGET)}, {lit(VIDEO)}) END", query_paths="CASE WHEN mode = 'caption_retrieval' THEN frames ELSE CAST(array() AS array<string>) END", pos_paths="CASE WHEN mode = 'caption_retrieval' THEN CAST(array() AS array<string>) ELSE frames END"),
    "llavahound_qa": Train(f"concat({lit(VIDEO_QA)}, replace(conversations[0], '<video>', {lit(VIDEO)}))", "conversations[1]", query_paths="frames"),
    "mmeb": Train(f"replace(qry, '<|image_1|>', {lit(IMAGE)})", f"replace(pos_text, '<|image_1|>', {lit(IMAGE)})", query_paths="filter(array(qry_image_path), p -> p <> '')", pos_paths="filter(array(pos_image_path), p -> p <> '')", neg=f"CASE WHEN coalesce(neg_text, '') <> '' THEN array(replace(neg_text, '<|image_1|>', {lit(IMAGE)})) ELSE CAST(array() AS array<string>) END", keep="(coalesce(qry, '') <> '' OR coalesce(qry_image_path, '') <> '') AND (coalesce(pos_text, '') <> '' OR coalesce(pos_image_path, '') <> '')"),
    "msrvtt": Train(told(lit(FIND_CONTENT), "caption[0]"), told(lit(SEE_VIDEO), token=VIDEO), pos_paths="frames"),
    "msvd": Train(told(lit(FIND_DESCRIBED), "caption[0]"), told(lit(SEE_VIDEO), token=VIDEO), pos_paths="frames"),
    "mteb_cluster": Train("concat(query_prompt, CASE WHEN data_format = 's2s' THEN title ELSE concat(title, '\\n', abstract) END)", "concat(doc_prompt, label)", neg="transform(slice(neg, 1, num_hardneg), n -> concat(doc_prompt, n))"),
    "mteb_training": Train("concat(query_prompt, text)", "concat(doc_prompt, lower(trim(label_text)))", neg="transform(slice(neg, 1, num_hardneg), n -> concat(doc_prompt, n))"),
    "pixmo": Train(f"concat({lit(PIXMO_QUERY)}, query_text)", f"concat({lit(PIXMO_TARGET)}, {lit(IMAGE)})", pos_paths="array(concat(image_dir, '/', positive_document_ids[0], '.png'))"),
    "ssv2": Train(told("inst", token=VIDEO), "pos_text", query_paths="frames"),
    "vidore": Train(f"concat({lit(IMAGE + ' ')}, query)", "answer", query_paths="array(image_filename)"),
    "visrag": Train("concat(CASE WHEN query_prompt <> '' THEN concat(query_prompt, ' ') ELSE '' END, query, ' ')", f"concat(CASE WHEN target_prompt <> '' THEN concat(target_prompt, ' ') ELSE '' END, ' ', {lit(IMAGE)})", pos_paths="array(image)"),
}
#: Test shapes by name.
TEST: dict[str, Test] = {
    "activitynetqa": Test(_ASK("concat(question, '? (A) yes; (B) no.')"), "array('yes', 'no')", "array('yes', 'no')", "array(answer)", query_paths="frames", keep="answer IN ('yes', 'no')"),
    "didemo": _TO_VIDEO(FIND_SCENES, "caption", "video_id"),
    "egoschema": Test(_ASK("concat(question, array_join(options, ' '))"), bare_options("options"), "options", "array(options[answer])", query_paths="frames"),
    "image_cls": Test(_IMAGE_QUERY("replace(qry_inst, '<|image_1|>', '')"), "tgt_text", "tgt_text", "array(tgt_text[0])", query_paths="array(qry_img_path)"),
    "image_i2i_vg": Test(_IMAGE_QUERY(f"concat('\\n', {_NO_MARK})"), _TARGETS.replace("{empty}", _PLAIN_TARGET), "zip_with(tgt_img_path, tgt_text, (p, c) -> concat(p, ':', trim('\"' FROM c)))", "array(concat(tgt_img_path[0], ':', trim('\"' FROM tgt_text[0])))", query_paths="array(qry_img_path)", cand_paths="tgt_img_path"),
    "image_i2t": Test(_IMAGE_QUERY("replace(qry_inst, '<|image_1|>', '')"), "tgt_text", "tgt_text", "array(tgt_text[0])", query_paths="array(qry_img_path)"),
    "image_qa": Test(_IMAGE_QUERY(f"concat('\\n', {_NO_MARK})"), "tgt_text", "tgt_text", "array(tgt_text[0])", query_paths="array(qry_img_path)"),
    "image_t2i": Test(f"concat(replace(qry_inst, '<|image_1|>', {lit(IMAGE)}), ' ', qry_text, '\\n')", _TARGETS.replace("{empty}", f"concat({_PLAIN_TARGET}, '\\n')"), "tgt_img_path", "array(tgt_img_path[0])", cand_paths="tgt_img_path"),
    "moment_retrieval": Test(told(lit(FIND_MOMENT), "query", VIDEO), f"transform(clips, c -> {told(lit(SEE_CLIP), token=VIDEO)})", "clips", "filter(clips, c -> startswith(c, 'positive'))", query_paths="array(video_path)", cand_paths="clips"),
    "momentseeker": Test(f"CASE WHEN input LIKE '%.mp4' THEN {told(lit(SEEK_VIDEO), 'query', VIDEO)} WHEN input LIKE '%.jpg' THEN {told(lit(SEEK_IMAGE), 'query', IMAGE)} ELSE {told(lit(SEEK_TEXT), 'query')} END", f"transform(concat(positives, negatives), c -> {told(lit(SEE_CLIP), token=VIDEO)})", "transform(concat(positives, negatives), c -> replace(split(c, '[.]mp4')[0], '/', '_'))", "transform(positives, c -> replace(split(c, '[.]mp4')[0], '/', '_'))", query_paths="filter(array(input), p -> p LIKE '%.mp4' OR p LIKE '%.jpg')", cand_paths="concat(positives, negatives)"),
    "msrvtt": _TO_VIDEO(FIND_CONTENT, "caption", "video_id"),
    "msvd": _TO_VIDEO(FIND_DESCRIBED, "caption[0]", "video_id"),
    "mvbench": Test(lettered(_ASK("question"), "options"), with_letters("options"), with_letters("options"), f"filter({with_letters('options')}, (o, i) -> options[i] = answer)", query_paths="frames"),
    "nextqa": Test(lettered(_ASK("question"), "options"), with_letters("options"), with_letters("options"), f"filter({with_letters('options')}, (o, i) -> options[i] = answer)", query_paths="frames"),
    "ssv2": Test(told("inst", token=VIDEO), "neg_text", "neg_text", "array(pos_text)", query_paths="frames"),
    "vatex": _TO_VIDEO(FIND_CONTENT, "caption[0]", "video_id"),
    "video_classification": Test(told("inst", token=VIDEO), "array(pos_text)", "array(pos_text)", "array(pos_text)", query_paths="frames"),
    "videomme": Test(_ASK("concat(question, '\\n', array_join(options, '\\n'))"), bare_options("options"), "options", "filter(options, o -> startswith(o, answer))", query_paths="frames"),
    "videommmu": Test(lettered(_ASK("question"), "options"), with_letters("options"), with_letters("options"), f"filter({with_letters('options')}, (o, i) -> chr(65 + i) = answer)", query_paths="frames", keep="question_type = 'multiple-choice'"),
    "vidore": Test(told(lit(FIND_PAGE), "query"), f"transform(docs, d -> {told(lit(SEE_PAGE), token=IMAGE)})", "docs", "docs", cand_paths="transform(docs, d -> concat(image_root, '/', d, '.png'))", rel="scores"),
    "visrag": Test(told(lit(FIND_PAGE), "query"), f"transform(docs, d -> {told(lit(SEE_PAGE), token=IMAGE)})", "docs", "docs", cand_paths="transform(docs, d -> concat(image_root, '/', substr(regexp_replace(d, '[.][^.]*\\\\z', ''), 1, 50), '_', substr(md5(d), 1, 8), regexp_extract(d, '[.][^.]*\\\\z', 0)))", rel="scores"),
    "youcook2": _TO_VIDEO(FIND_RECIPE, "sentence", "video_id"),
}


def train_rows(rows: DataFrame, parser: str, keep: tuple[str, ...] = (), shapes: dict[str, Train] = TRAIN) -> DataFrame:
    """``keep`` columns and the training row of each row of a source of this shape."""
    t = shapes[parser]
    made = rows.where(t.keep).selectExpr(*keep, f"{t.query} AS query_text", f"{t.query_paths} AS query_paths", f"{t.pos} AS pos_text", f"{t.pos_paths} AS pos_paths", f"{t.neg} AS neg_text", f"{t.neg_paths} AS neg_paths", f"{lit(parser)} AS global_dataset_name")
    return made.where("query_text IS NOT NULL AND pos_text IS NOT NULL")


def test_rows(rows: DataFrame, parser: str, keep: tuple[str, ...] = (), shapes: dict[str, Test] = TEST) -> DataFrame:
    """``keep`` columns and the test row of each row of a source of this shape."""
    t = shapes[parser]
    made = rows.where(t.keep).selectExpr(*keep, f"{t.query} AS query_text", f"{t.query_paths} AS query_paths", f"{t.cand} AS cand_text", f"{t.cand_paths} AS cand_paths", f"{t.names} AS cand_names", f"{t.labels} AS label_names", f"{t.rel} AS rel_scores", f"{lit(parser)} AS global_dataset_name")
    return made.where("query_text IS NOT NULL AND size(cand_text) > 0")


test_rows.__test__ = False  # no test of pytest


def shards(rows: DataFrame, key: str, k: int) -> DataFrame:
    """Rows in k partitions by a hash of their key, each a part that can be read on its own."""
    return rows.withColumn("shard", F.expr(f"CAST(pmod(xxhash64({key}), {k}) AS int)")).repartition(k, "shard")


def corpus(cands: DataFrame) -> DataFrame:
    """(cand_name, cand_text): candidates of all rows and of a corpus as one list, the first of each name by ``ord``."""
    flat = cands.selectExpr("ord", "inline(arrays_zip(cand_names, cand_text))").toDF("ord", "cand_name", "cand_text")
    return flat.groupBy("cand_name").agg(F.min_by("cand_text", F.struct("ord", "cand_text")).alias("cand_text"))


def _code(text: str) -> str:
    return f"CAST(conv(substr(md5({text}), 1, 12), 16, 10) AS bigint)"


def sampled(array: str, row: str, m: int, seed: int = 1) -> str:
    """m members of an array without replacement, by hashes of row and member; ties by the member."""
    return f"transform(slice(array_sort(transform({array}, x -> struct({_code(f"concat({row}, ':{seed}:', x)")} AS h, x AS x))), 1, {m}), y -> y.x)"


def negatives_of_labels(rows: DataFrame, label: str, key: str, text: str, m: int, seed: int = 1, slots: int = 64) -> DataFrame:
    """``rows`` with ``neg``: m texts of other labels for each row, drawn by hash.

    First a pool of ``m`` texts of every label and slot is drawn by hash; a row takes the texts of its slot that have another label, those
    first whose hash with the row's is smallest. So a label that holds a third of all rows is never gathered; a row whose slot
    has fewer than ``m`` texts of other labels gets those.
    """
    code = f"{_code(f'CAST({key} AS string)')} % {slots}"
    pool = rows.selectExpr(f"{label} AS __l", f"{text} AS __t", f"CAST({key} AS string) AS __k", f"{code} AS slot").withColumn("h", F.expr(_code(f"concat(__k, ':{seed}')"))).selectExpr("*", "row_number() OVER (PARTITION BY slot, __l ORDER BY h, __k) AS r").where(f"r <= {m}")
    packed = pool.groupBy("slot").agg(F.collect_list(F.struct("__l", "__k", "__t")).alias("pool"))  # at most m a label and slot
    both = f"concat(x.__k, ':', CAST({key} AS string))"
    drawn = f"transform(slice(array_sort(transform(filter(pool, x -> x.__l <> {label}), x -> struct({_code(both)} AS h, x.__k AS k, x.__t AS t))), 1, {m}), x -> x.t)"
    return rows.withColumn("slot", F.expr(code)).join(packed, "slot", "left").withColumn("neg", F.expr(drawn)).drop("slot", "pool")


def label_chunks(rows: DataFrame, label: str, key: str, size: int = 4096) -> DataFrame:
    """(label, chunk, ids): the sorted ids of each label in lists of at most ``size``."""
    from tidemark.operators.slices import numbered

    at = numbered(rows.select(label, key), [label], [key], f"floor({key} / {size})")
    return at.groupBy(label, F.expr(f"CAST((rn - 1) DIV {size} AS bigint)").alias("chunk")).agg(F.array_sort(F.collect_list(key)).alias("ids"))
