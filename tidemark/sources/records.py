"""Readers that shape nested and keyed inputs into rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CAPTION_A = "date string, start_time string, end_time string, text string, video_path string"
CAPTION_B = "start_sec double, end_sec double, text string, video_path string"
RECORD = "struct<named_entities: array<string>, triples: array<array<string>>, broken: string>"


def read_captions(spark: SparkSession, paths: dict[str, str], seconds: bool = False) -> DataFrame:
    """JSON arrays of captions, one path (or pattern) for each granularity of the ladder; others are skipped."""
    frames = [spark.read.schema(CAPTION_B if seconds else CAPTION_A).json(p, multiLine=True).withColumn("granularity", F.lit(g)) for g, p in paths.items() if g in ("30sec", "3min", "10min", "1h")]
    if not frames:
        raise ValueError("no path of a known granularity")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """(ts, idx, s, p, o) of a JSON object that maps timestamps to consolidated triples; triples of fewer than three members are left out."""
    text = spark.read.text(path, wholetext=True)
    snapshots = text.select(F.explode(F.from_json("value", "map<string, struct<consolidated_semantic_triples: array<array<string>>>>")).alias("ts", "v"))
    rows = snapshots.select(F.col("ts").cast("long").alias("ts"), F.posexplode("v.consolidated_semantic_triples").alias("idx", "t")).where(F.size("t") >= 3)
    return rows.selectExpr("ts", "idx", "t[0] AS s", "t[1] AS p", "t[2] AS o")


def read_sync_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(day, file, pos, start, end, text, type) of sync files; the day stands in the file's name."""
    schema = "video_file string, data array<struct<start: bigint, end: bigint, text: string, type: string>>"
    rows = spark.read.schema(schema).json(pattern, multiLine=True).withColumn("file", F.input_file_name())
    return rows.select(F.regexp_extract("file", r"DAY(\d+)", 1).alias("day"), "file", F.posexplode("data").alias("pos", "x")).select("day", "file", "pos", "x.*").orderBy("file", "pos")


def latest_file(spark: SparkSession, pattern: str) -> str | None:
    """The newest file that fits a pattern; file listings are read without the files' contents."""
    row = spark.read.format("binaryFile").load(pattern).select("path", "modificationTime").agg(F.max_by("path", "modificationTime").alias("path")).first()
    return row["path"] if row else None


def extraction_records(raw: DataFrame) -> DataFrame:
    """(resp_id, chunk_id, subject, created_at, entities, triples) of readable extraction responses.

    A record stands in two arrays or, where both are null, as JSON text; broken text gives no row.
    """
    parsed = raw.selectExpr("resp_id", "chunk_id", "subject", "created_at", "named_entities", "triples", f"CASE WHEN named_entities IS NULL AND triples IS NULL THEN from_json(raw_output, '{RECORD}', map('columnNameOfCorruptRecord', 'broken')) END AS r")
    rows = parsed.selectExpr("resp_id", "chunk_id", "subject", "created_at", "CASE WHEN r.broken IS NULL THEN coalesce(named_entities, r.named_entities) END AS entities", "CASE WHEN r.broken IS NULL THEN coalesce(triples, r.triples) END AS triples")
    return rows.where("entities IS NOT NULL OR triples IS NOT NULL").dropDuplicates(["resp_id"])


def triples_of(records: DataFrame) -> DataFrame:
    """(resp_id, chunk_id, subject, created_at, s, p, o): each valid triple of a record once."""
    rows = records.select("resp_id", "chunk_id", "subject", "created_at", F.expr("explode(array_distinct(filter(triples, t -> size(t) = 3))) AS t"))
    return rows.selectExpr("resp_id", "chunk_id", "subject", "created_at", "t[0] AS s", "t[1] AS p", "t[2] AS o")


def read_union(spark: SparkSession, parts: dict[str, str], schema: str | None = None, tag: str = "_split") -> DataFrame:
    """Rows of all parts that exist, each with its tag; missing ones are skipped. A path ends in .json (an array of objects) or is parquet."""
    out = None
    for name, path in parts.items():
        if not exists(spark, path):
            continue
        rows = spark.read.schema(schema).json(path, multiLine=True) if path.endswith(".json") and schema else spark.read.json(path, multiLine=True) if path.endswith(".json") else spark.read.parquet(path)
        part = rows.withColumn(tag, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError(f"none of {sorted(parts.values())}")
    return out


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_openie(spark: SparkSession, path: str) -> DataFrame:
    """(chunk, entities, triples) of a JSON cache with the maps ner_results and triple_results."""
    text = spark.read.text(path, wholetext=True)
    maps = text.select(F.from_json("value", "ner_results map<string, array<string>>, triple_results map<string, array<array<string>>>").alias("m")).select("m.*")
    names, facts = maps.select(F.explode("ner_results").alias("chunk", "entities")), maps.select(F.explode("triple_results").alias("chunk", "triples"))
    return names.join(facts, "chunk", "full")


def rekeyed(passages: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(have, missing): passages (text) keyed by the MD5 of their text, with what a cache (chunk, ...) knows of them, and those it lacks."""
    keyed = passages.select(F.concat(F.lit("chunk-"), F.md5("text")).alias("chunk"), "text").dropDuplicates(["chunk"])
    return keyed.join(cache, "chunk"), keyed.join(cache.select("chunk"), "chunk", "left_anti")


def write_subtitles(rows: DataFrame, path: str) -> None:
    """Subtitle files, one below ``path/key=...`` for each key: (key, start_s, end_s, text) numbered and timed."""
    srt_blocks(rows).select("key", "block").repartition("key").sortWithinPartitions("key", "block").select("block", "key").write.mode("overwrite").partitionBy("key").text(path)


def srt_blocks(rows: DataFrame) -> DataFrame:
    """(key, n, block): numbered subtitle blocks of segments (key, start_s, end_s, text) with text."""
    from tidemark.functions.media import srt_time
    from tidemark.operators.slices import numbered

    told = numbered(rows.where("trim(text) <> ''"), ["key"], ["start_s", "end_s", "text"], "start_s DIV 3600", "n")
    return told.selectExpr("key", "n", f"concat(n, '\\n', {srt_time('start_s')}, ' --> ', {srt_time('end_s')}, '\\n', trim(text), '\\n') AS block")
