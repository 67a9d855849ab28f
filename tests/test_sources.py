"""Readers over files that the tests write, stores, plugged models and closest matches."""

import json
import os

import pandas as pd
from pyspark.sql import functions as F

from tidemark.functions import clock, models, responses
from tidemark.operators import chains, pairs
from tidemark.sources import records, store


def put(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False))
    return str(path)


def test_captions_and_union(spark, tmp_path):
    a = put(tmp_path / "a.json", [{"date": "DAY1", "start_time": "10000000", "end_time": "10003000", "text": "x", "video_path": "p"}, {"date": "DAY1", "start_time": "9", "end_time": None, "text": "", "video_path": None}])
    rows = records.read_captions(spark, {"30sec": a, "5min": "nowhere.json"})
    assert rows.count() == 2 and {r["granularity"] for r in rows.collect()} == {"30sec"}
    both = records.read_union(spark, {"one": a, "none": str(tmp_path / "none.json"), "two": a}, records.CAPTION_A)
    assert {tuple(r) for r in both.groupBy("_split").count().collect()} == {("one", 2), ("two", 2)}


def test_snapshots_sync_files_and_newest(spark, tmp_path):
    p = put(tmp_path / "s.json", {"110000000": {"consolidated_semantic_triples": [["a", "b", "c"], ["short"]]}, "120000000": {"consolidated_semantic_triples": [["d", "e", "f", "g"]]}})
    assert {tuple(r) for r in records.read_snapshots(spark, p).collect()} == {(110000000, 0, "a", "b", "c"), (120000000, 0, "d", "e", "f")}
    for k in (2, 1):
        put(tmp_path / "sync" / f"X_DAY{k}_09.json", {"video_file": "v", "data": [{"start": 1, "end": 2, "text": f"t{k}", "type": "k"}, {"start": 3, "end": 4}]})
    found = records.read_sync_files(spark, f"{tmp_path}/sync/*.json").collect()
    assert [(r["day"], r["pos"], r["text"]) for r in found] == [("1", 0, "t1"), ("1", 1, None), ("2", 0, "t2"), ("2", 1, None)]
    os.utime(tmp_path / "sync" / "X_DAY1_09.json", (2e9, 2e9))
    assert records.latest_file(spark, f"{tmp_path}/sync/*.json").endswith("X_DAY1_09.json")


def test_openie_cache(spark, tmp_path):
    import hashlib

    key = "chunk-" + hashlib.md5(b"one").hexdigest()
    cache = records.read_openie(spark, put(tmp_path / "o.json", {"ner_results": {key: ["A"], "x": []}, "triple_results": {key: [["a", "b", "c"]]}}))
    have, missing = records.rekeyed(spark.createDataFrame([("one",), ("two",), ("two",)], "text string"), cache)
    assert [tuple(r) for r in have.select("text", "entities", "triples").collect()] == [("one", ["A"], [["a", "b", "c"]])]
    assert [r["text"] for r in missing.collect()] == ["two"]
    answered, left = store.cached(spark.createDataFrame([("q", 1), ("r", 2)], "prompt string, k int"), answers_of(spark, "q"), ["prompt", "k"])
    assert answered.count() == 1 and left.select("prompt").collect()[0][0] == "r"


def answers_of(spark, prompt):
    return spark.createDataFrame([(prompt, 1)], "prompt string, k int").select(F.sha2(F.to_json(F.struct("prompt", "k")), 256).alias("request_key"), F.lit("yes").alias("response"))


def test_subtitles(spark, tmp_path):
    rows = spark.createDataFrame([("a", 5, 6, " two "), ("a", 1, 2, "one"), ("a", 3, 4, "  "), ("b", 3600, 3661, "x")], "key string, start_s long, end_s long, text string")
    records.write_subtitles(rows, f"{tmp_path}/srt")
    text = "".join(p.read_text() for p in (tmp_path / "srt" / "key=a").glob("*.txt"))
    assert text == "1\n00:00:01,000 --> 00:00:02,000\none\n\n2\n00:00:05,000 --> 00:00:06,000\ntwo\n\n"


def test_collection(spark, tmp_path):
    schema = "hash_id string, text string, meta map<string, string>"
    c = store.Collection(spark, f"{tmp_path}/c", schema)
    rows = lambda *x: spark.createDataFrame([(k, t, m) for k, t, m in x], schema)
    c.insert(rows(("a", "x", {"k": "v"}), ("b", "", {"k": "v"})))
    c.insert(rows(("a", "other", {}), ("c", "z", {})))
    assert {(r["hash_id"], r["text"]) for r in store.Collection(spark, f"{tmp_path}/c", schema).rows().collect()} == {("a", "x"), ("b", ""), ("c", "z")}
    assert [r["hash_id"] for r in c.head(2).collect()] == ["a", "b"] and c.get(rows(("c", "", {}))).count() == 1
    c.purge("text", "meta")
    assert [r["hash_id"] for r in c.rows().collect()] == ["a"]
    c.delete(rows(("a", "", {})))
    assert c.rows().count() == 0
    c.truncate()
    assert c.rows().count() == 0


def test_models_plug_in(spark):
    def load():
        return lambda texts: pd.Series([[float(len(t)), 1.0] for t in texts])

    own = models.plug(spark, models.STAND_INS, "encode_text", load, "array<double>")
    df = spark.createDataFrame([("abc",), ("",)], "t string")
    assert [r[0] for r in df.selectExpr(f"{own.encode_text('t')} AS v").collect()] == [[3.0, 1.0], [0.0, 1.0]]
    assert own.find_triples is models.STAND_INS.find_triples
    got = df.selectExpr(f"{models.simple_triples(chr(39) + 'Ann moves the red box and Bob hides the old cup.' + chr(39))} AS t").first()[0]
    assert got == [["Ann", "moves", "red box"], ["Bob", "hides", "old cup"]]


def test_closest_and_replies(spark):
    df = spark.createDataFrame([("red bx", ["blue cup", "red box"]), ("x", []), (None, ["a"])], "a string, o array<string>")
    assert [r[0] for r in df.select(responses.closest("a", "o")).collect()] == ["red box", None, None]
    said = spark.createDataFrame([("I can't provide evidence.",), ("Well. I can provide evidence. Evidence: at noon \nmore",), ("",)], "t string")
    assert [tuple(r[0]) for r in said.selectExpr(responses.evidence("t")).collect()] == [(False, None), (True, "at noon"), (False, None)]
    texts = spark.createDataFrame([("a ", None), (None, "b"), ("a", "b"), (" ", "")], "s string, p string")
    assert [r[0] for r in texts.selectExpr(responses.merged_text("s", "p")).collect()] == ["a", "[Speech] b", "a [Speech: b]", ""]


def test_time_ranges(spark):
    df = spark.createDataFrame([("see DAY1 11:09:43 - day 2 1:02:03",), ("DAY1 11:09:43",), (None,)], "t string")
    found = df.selectExpr(f"{clock.is_time_range_sql('t')}", f"{clock.time_range_sql('t')}").collect()
    assert [tuple(r) for r in found] == [(True, [111094300, 201020300]), (False, None), (None, None)]


def test_consolidation_retracts(spark):
    rows = [("s", "e", 1, 0, "Ann", "owns", "red box"), ("s", "e", 2, 0, "Ann", "owns", "blue box"), ("s", "e", 2, 1, "Ann", "owns", "green box"), ("s", "e", 3, 0, "Ann", "likes", "tea"), ("t", "e", 9, 0, "Ann", "owns", "red box")]
    df = spark.createDataFrame(rows, "subject string, entity string, ts long, idx long, s string, p string, o string")
    found = {(r["subject"], r["ts"], r["idx"]): r["gone"] for r in chains.consolidate(df, ["subject", "entity"]).collect()}
    assert found == {("s", 1, 0): 2, ("s", 2, 0): None, ("s", 2, 1): None, ("s", 3, 0): None, ("t", 9, 0): None}
    assert chains.consolidate(df.limit(0), ["subject", "entity"]).count() == 0


def test_label_negatives_of_a_hot_label(spark):
    rows = [(k, "hot" if k % 10 else f"l{k % 3}", f"t{k}") for k in range(2000)]
    df = spark.createDataFrame(rows, "id long, label string, t string")
    of = {t: l for _, l, t in rows}
    found = pairs.negatives_of_labels(df, "label", "id", "t", 3, slots=8).collect()
    assert len(found) == 2000 and all(of[t] != r["label"] for r in found for t in r["neg"])
    assert sum(len(r["neg"]) == 3 for r in found) > 1900
    assert {tuple(r) for r in pairs.shards(df, "id", 4).groupBy("shard").count().collect()} and pairs.shards(df, "id", 4).rdd.getNumPartitions() == 4


def test_options_without_letters(spark):
    got = spark.sql(f"SELECT {pairs.bare_options(chr(97) + 'rray(' + chr(39) + 'A. Red box.' + chr(39) + ', ' + chr(39) + 'plain' + chr(39) + ')')} AS x").first()[0]
    assert got == ["Red box", "plain"]
