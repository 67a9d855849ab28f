"""Mentions of entities in captions, against Python's own search."""

import re

from tidemark.operators import chains

NAMES = ["kettle", "Ñelda's flower vase", "ticket no. 62", "glass-camera-strap", "(red photo frame)", '"foil teapot"', "Ruvio's kettle\n", "  Ardomi", "кружка", "台所", "a.b", "x\\d", "$5 *new* bag", "snake_case", "!?", " ", "ЧАЙНИК"]
TEXTS = [
    "Ñelda's Flower Vases stand by the KETTLE.", "ÑELDA'S FLOWER VASE", "Ticket no. 62, not ticket no. 621 or ticket no 62", "ticket no. 621", "a glass-camera-strap; glass-camera-straps", "the (red photo frame) fell", "red photo frame",
    'a "foil teapot" here', "Ruvio's kettles", "ardomi and Ardomia", "Кружка и чайник", "台所 で", "aXb", "a.b", "x5", "x\\d", "for $5 *new* bags !?", "the snake_cases", "kettle_one", "the kettlees", "my teakettle",
]


def brute(names, texts):
    hits = set()
    for e in names:
        n = e.lower().strip()
        for v in {n, n.replace("-", " "), n.replace("-", ""), n.replace(" ", "-"), n.replace(" ", "")} - {""}:
            hits |= {(e, k) for k, t in enumerate(texts) if re.search(rf"(?<!\w){re.escape(v)}(?:s|es)?(?!\w)", t.lower())}
    return hits


def found(spark, names, texts):
    entities = spark.createDataFrame([("s", n) for n in names] + [("other", "kettle")], "subject string, entity string")
    captions = spark.createDataFrame([("s", k, t) for k, t in enumerate(texts)], "subject string, id int, text string")
    return {(r["entity"], r["id"]) for r in chains.keyword_hits(entities, captions).collect()}


def test_names_of_any_characters(spark):
    hits = found(spark, NAMES, TEXTS)
    assert hits == brute(NAMES, TEXTS)
    assert {e for e, _ in hits} == set(NAMES) - {" "}


def test_query_drops_no_name(spark):
    from conftest import SMALL

    import __spark_entry__ as entry
    from tidemark.plans.graph import captions, entities

    names, texts = {}, {}
    for r in entities(spark, SMALL).where("subject IS NOT NULL").select("subject", "name").distinct().collect():
        names.setdefault(r[0], []).append(r[1])
    for r in captions(spark, SMALL).where("granularity = '30sec'").select("subject", "text").collect():
        texts.setdefault(r[0], []).append(r[1] or "")
    want = {}
    for s in names.keys() & texts.keys():
        for e, _ in brute(names[s], texts[s]):
            want[s, e] = want.get((s, e), 0) + 1
    assert {(r["subject"], r["entity"]): r["captions"] for r in entry.queries()["keyword_captions"](spark, SMALL).collect()} == want


def test_hyphen_space_and_joined_spellings(spark):
    texts = ["the camera strap", "two camera-straps", "a CAMERASTRAP", "camerastraps", "camera  strap", "camera strapped", "a glass camera strap"]
    hits = found(spark, ["camera-strap", "camera strap", "camerastrap"], texts)
    assert hits == brute(["camera-strap", "camera strap", "camerastrap"], texts)
    assert {k for e, k in hits if e == "camera-strap"} == {k for e, k in hits if e == "camera strap"} == {0, 1, 2, 3, 6}
    assert {k for e, k in hits if e == "camerastrap"} == {2, 3}


def test_captions_move_once_and_in_groups(spark, monkeypatch):
    monkeypatch.setattr(chains, "GROUP", 4)
    assert found(spark, NAMES, TEXTS) == brute(NAMES, TEXTS)
    entities, captions = (spark.createDataFrame([("s", x)] * 2, f"subject string, {c} string") for x, c in (("kettle", "entity"), ("the kettle", "text")))
    hits = chains.keyword_hits(entities, captions.selectExpr("*", "1 AS id"))
    assert [tuple(r) for r in hits.collect()] == [("s", "kettle", 1)]
    # words are not sent one by one
    assert "explode(array_union" not in hits._jdf.queryExecution().toString() and "regexp_extract_all" not in hits._jdf.queryExecution().toString()


def test_only_recurring_names_meet_captions(spark, monkeypatch):
    from conftest import SMALL

    from tidemark.plans import chains as plans

    asked, hits = [], plans.entity_hits
    monkeypatch.setattr(plans, "entity_hits", lambda *args: asked.extend(args[2:]) or hits(*args))
    plans.topic_chunks(spark, SMALL)
    want = chains.recurring(plans.triples_entities(spark, SMALL), 2)
    assert [x.count() for x in asked] == [want.count()]
