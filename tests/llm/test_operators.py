import random
import unicodedata
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import consensus, lookalikes, mixing, neighbours, nearest_time, packing, pair_defects, record_hash, tokens


# --- nearest in time ---


def nearest(spark, left, right, tolerance=20):
    a = spark.createDataFrame(left, "id string, e string, t long").withColumn("cell", F.lit(1)).withColumn("d", F.lit("x"))
    b = spark.createDataFrame(right, "rid long, e string, s long").withColumn("t", F.lit(None).cast("string")).withColumn("id", F.lit(7))
    found = nearest_time.nearest_in_time(a, b, entity=("e", "e"), time=(F.col("t"), F.col("s")), right_id="rid", tolerance=tolerance, slice_s=60, rows_per_group=40)
    return {r["id"]: (r["__match"], r["__distance"]) for r in found.collect()}


def test_nearest_equals_brute_force(spark):
    rng = random.Random(1)
    left = [(f"q{k}", rng.choice(["hot", "hot", "b", None]), rng.choice([None, rng.randint(0, 900)])) for k in range(200)]
    right = [(k, rng.choice(["hot", "b", None]), rng.choice([None, rng.randint(0, 900)])) for k in range(150)]
    right += right[:20]
    want = {}
    for q, e, t in left:
        near = [(abs(s - t), r) for r, f, s in right if e is not None and t is not None and f == e and s is not None and abs(s - t) <= 20]
        if near:
            want[q] = (min(near)[1], min(near)[0])
    assert nearest(spark, left, right) == want


def test_nearest_defined_cases(spark):
    assert nearest(spark, [("q", "a", 100)], [(9, "a", 90), (4, "a", 110)]) == {"q": (4, 10)}
    assert nearest(spark, [("q", "a", 60), ("q", "a", 60)], [(1, "a", 59), (2, "a", 59)]) == {"q": (1, 1)}
    assert nearest(spark, [("q", "a", 0)], [(1, "a", -20), (2, "a", 21)]) == {"q": (1, 20)}
    assert nearest(spark, [], [(1, "a", 1)]) == {} == nearest(spark, [("q", "a", 1)], [])


# --- consensus ---


def labels(spark, rows):
    return spark.createDataFrame(rows, "id string, judge_id string, label int")


def test_consensus_recovers_planted_scores(spark):
    rng = np.random.default_rng(2)
    truth = {f"i{k}": int(rng.integers(0, 6)) for k in range(600)}
    rows = []
    for i, t in truth.items():
        for j, (right, shift) in enumerate([(0.9, 0), (0.9, 0), (0.85, 0), (0.9, 1), (0.2, 0), (0.85, 5)]):
            said = t if rng.random() < right else int(rng.integers(0, 6))
            said = (5 - said) if shift == 5 else min(5, said + shift)
            if rng.random() < 0.9:
                rows.append((i, f"j{j}", consensus.LOW if said <= 2 and rng.random() < 0.05 else said))
    found, judges, _ = consensus.fit_consensus(labels(spark, rows))
    got = {r["id"]: r["raw_score"] for r in found.collect()}
    assert np.mean([got[i] == truth[i] for i in got]) > 0.95
    trust = {r["judge_id"]: r["reliability"] for r in judges.collect()}
    assert trust["j0"] > 0.8 > trust["j4"] and trust["j5"] < 0.3


def test_consensus_defined_cases(spark):
    found, judges, usual = consensus.fit_consensus(labels(spark, []))
    assert found.count() == judges.count() == 0 and 0 <= usual <= 5
    ids = spark.createDataFrame([("a",), ("a",), (None,)], "id string")
    assert [tuple(r) for r in consensus.every_id(ids, found, 3).collect()] == [("a", 3)]


def test_judge_labels(spark):
    rows = [("a", "j", 3, 0.5, "3", 1), ("a", "j", 4, 1.0, "4", 2), ("a", "k", 0, 0.0, "Error: timeout", 1), ("a", "l", None, 1.0, "skipped", 1), ("a", "m", 9, None, "Score: ?", 1), ("a", None, 3, 0.5, "3", 1), ("b", "k", 0, 0.0, "Score: 0", 1), ("b", "j", 2, 0.0, None, None)]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "id string, judge_id string, raw_score int, smoothed_score double, judge_response string, at int, result_id long").selectExpr("*", "timestamp_seconds(at) AS scored_at", "1 AS label")
    assert {tuple(r) for r in consensus.judge_labels(df).collect()} == {("a", "j", 4), ("a", "l", consensus.HIGH), ("b", "k", 0), ("b", "j", 2)}


# --- neighbours ---


def top5(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(1)).withColumn("v", F.lit(2))
    return neighbours.nearest_vectors(df, vec_id="vec_id", embedding="embedding", dim=8, k=5, **more).collect()


def test_neighbours_recall(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(60, 8))
    x = (centers[rng.integers(0, 60, 1200)] + 0.15 * rng.normal(size=(1200, 8))) * rng.lognormal(0, 2, (1200, 1))
    found = top5(spark, [(k, [float(v) for v in row]) for k, row in enumerate(x)], cell_rows=60, block_rows=50)
    u = x.astype("float32") / np.linalg.norm(x.astype("float32"), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(a, int(b)) for a in range(1200) for b in np.argsort(-s[a])[:5]}
    got = {(r["src"], r["dst"]) for r in found}
    assert len(got & want) / len(want) >= 0.9
    assert all(abs(r["cosine"] - s[r["src"], r["dst"]]) < 1e-5 for r in found)


def test_neighbours_defined_cases(spark):
    nan = float("nan")
    bad = [(1, None), (2, [0.0] * 8), (3, [nan] + [1.0] * 7), (4, [1.0] * 7), (5, []), (None, [1.0] * 8), (6, [float("inf")] + [1.0] * 7)]
    assert top5(spark, bad) == [] == top5(spark, []) == top5(spark, [(1, [1.0] * 8)])
    same = [(k, [float(2**k)] + [0.0] * 7) for k in range(10)] * 2
    found = defaultdict(set)
    for r in top5(spark, same):
        found[r["src"]].add(r["dst"])
    assert found == {k: set(sorted(set(range(10)) - {k})[:5]) for k in range(10)}


def test_split_cells_keep_recall(spark):
    rng = np.random.default_rng(14)
    centers = rng.normal(size=(60, 8))
    x = centers[rng.integers(0, 60, 1500)] + 0.15 * rng.normal(size=(1500, 8))
    found = top5(spark, [(k, [float(v) for v in row]) for k, row in enumerate(x)], cell_rows=60, most_coarse=6)
    u = x.astype("float32") / np.linalg.norm(x.astype("float32"), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(a, int(b)) for a in range(1500) for b in np.argsort(-s[a])[:5]}
    assert len({(r["src"], r["dst"]) for r in found} & want) / len(want) >= 0.9


def test_cells_grow_with_the_vectors():
    rng = np.random.default_rng(15)
    x = rng.normal(size=(4000, 8)).astype("float32")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for total in (4e3, 4e6, 4e9):
        assert abs(len(neighbours.fit(x, total, 800, 8000, 0.2).blocks) / min(total / 800, 250**2) - 1) < 0.3
    model = neighbours.fit(x, 4e6, 800, 8000, 0.2)
    own, near = model.cells(x, 6)
    assert (near[:, 0] == own).all() and all(len(set(row)) == 6 for row in near.tolist())


def test_copies_have_ranks(spark):
    found = {(r["src"], r["dst"]): r["rank"] for r in top5(spark, [(k, [1.0] * 8) for k in range(9)])}
    assert [found[8, k] for k in range(5)] == [1, 2, 3, 4, 5] and [found[0, k] for k in range(1, 6)] == [1, 2, 3, 4, 5]


def test_blocks_lose_nothing(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [float(v) for v in 1 + 0.3 * rng.normal(size=8)]) for k in range(300)]
    whole = {(r["src"], r["dst"]) for r in top5(spark, rows, cell_rows=10_000, block_rows=10_000, rerank=300)}
    cut = {(r["src"], r["dst"]) for r in top5(spark, rows, cell_rows=10_000, block_rows=40, rerank=300)}
    assert whole == cut


def test_anisotropic_codes_lower_their_loss():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 8)).astype("float32")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    books = neighbours.fit_books(x, x, 3.0)

    def loss(codes):
        e = x - books[np.arange(2)[None, :], codes].reshape(400, 8)
        return ((e**2).sum(1) + 2.0 * (e * x).sum(1) ** 2).sum()

    near = neighbours.encode(x, x, books, 1.0, rounds=0)
    assert loss(neighbours.encode(x, x, books, 3.0)) <= loss(near)
    codes = neighbours.encode(x, x, books, 3.0)
    assert np.allclose(neighbours.scan(x[:5], codes, books), x[:5] @ books[np.arange(2)[None, :], codes].reshape(400, 8).T, atol=1e-5)


# --- records ---


def test_records(spark):
    rows = [
        (1, ["Ann  Lee", "tea-pot"], [["Ann", "has", "Tea pot"]], None), (2, ["TEAPOT.", "annlee", "Annlee"], [["ann", "HAS", "teapot!"], ["ann", "has", "teapot"]], None),
        (3, None, None, '{"triples": [["Ann","has","tea pot"]], "named_entities": ["Tea pot", "ann lee"]}'), (4, None, None, '{"triples": [["Ann","has","tea pot"]], "named_entities": ["Tea pot", "ann l'),
        (5, [], [], None), (6, None, None, None), (7, None, None, "[]"), (8, ["annlee", "teapot"], [["has", "ann", "teapot"]], None), (9, ["annlee", "teapot", None], [["ann", "has", "teapot"]], None),
        (10, ["a"], None, None), (11, ["A"], [], None), (12, ["annlee", "teapot"], [["ann", "has", "teapot", "x"]], None),
    ]
    df = spark.createDataFrame([*rows, rows[0]], "resp_id long, named_entities array<string>, triples array<array<string>>, raw_output string").selectExpr("*", "1 AS root", "2 AS shape")
    same = record_hash.collapse_records(record_hash.readable_records(df))
    assert {(r["resp_id"], r["keep_id"]) for r in same.collect()} == {(1, 1), (2, 1), (3, 1), (9, 1), (8, 8), (10, 10), (11, 10), (12, 12)}
    assert record_hash.collapse_records(record_hash.readable_records(df.limit(0))).count() == 0


def test_records_of_one_digest_are_compared(spark, monkeypatch):
    made = spark.createDataFrame([(1, b"d", "x"), (2, b"d", "y"), (3, b"d", "x"), (4, b"e", "x"), (5, b"f", "z"), (6, b"f", "z")], "resp_id long, root binary, shape string")
    monkeypatch.setattr(record_hash, "record_digests", lambda records: made)
    assert {tuple(r) for r in record_hash.collapse_records(made).collect()} == {(1, 1), (2, 2), (3, 1), (4, 4), (5, 5), (6, 5)}


# --- pair defects ---

PAIRS = [
    ("Who helped Ann carry the red box?", "Tovik", None), ("Who helped Ann carry the red box?", None, "empty"), ("Who helped Ann carry the red box?", " ​\n", "empty"), ("Who helped Ann carry the red box?", "N/A", "empty"),
    ("Who helped Ann carry the red box?", "<answer></answer>", "empty"), ("Who helped Ann carry the red box?", "It was Tovik, who had already been waiting outs", "truncated"),
    ("Who helped Ann carry the red box?", "Tovik and two guests helped near the stairs.", None), ("Who helped Ann carry the red box?", "I'm sorry, but I cannot answer this question.", "refusal"),
    ("Wer hat Ann beim Tragen geholfen?", "Leider: diese Frage kann ich nicht beantworten.", "refusal"), ("Who helped Ann carry the red box?", "“who helped Ann carry the red box”", "copy"),
    ("Qui a aidé Ann à tout porter ?", "Question : Qui a aidé Ann à tout porter ?", "copy"), ("Who helped Ann carry the red box?", "Das war Tovik, obwohl die Treppe sehr eng war.", "language"),
    ("谁帮老邓搬了螺丝刀？", "是凯图帮的忙，虽然楼梯很窄。", None), ("谁帮老邓搬了螺丝刀？", "C'était Tovik, même si l'escalier était très étroit.", "language"), ("Who helped Ann carry the red box?", "(B)", None),
    ("Where is it?", "Ann cannot remember, but the captions show it on the balcony at 09:52.", None), (None, "The red box was on the table.", None),
    ("Who helped Ann carry the red box?", "I'd rather skip that one.", "refusal"), ("Who helped Ann carry the red box?", "That falls outside what I'm comfortable discussing.", "refusal"),
    ("谁帮老邓搬了螺丝刀？", "それはトヴィクさんが手伝いました。", "language"), ("Who helped Ann carry the red box?", "Это был Товик, хотя лестница была узкой.", "language"),
    ("Who helped Ann carry the red box?", "Tovik ha aiutato perché la scala era troppo stretta per una persona.", "language"), ("Wer hat Ann beim Tragen geholfen?", "Das war Tovik, obwohl die Treppe sehr eng war.", None),
]


def test_defects(spark):
    filler = [(1000 + k, f"Where did Ann leave box {k}?", f"Ann left box {k} at the long table, next to a bag.") for k in range(400)]
    # the label model learns how broken-off answers look from some of them
    filler += [(2000 + k, f"Where did Ann leave box {k}?", f"It was last seen near stall {k}, next to a bag that Tovik bro"[: 56 + k % 6]) for k in range(30)]
    df = spark.createDataFrame([(k, q, r) for k, (q, r, _) in enumerate(PAIRS)] * 2 + filler, "pair_id long, question string, response string").withColumn("defect", F.lit(1)).withColumn("last", F.lit(1))
    found = {r["pair_id"]: r["defect"] for r in pair_defects.best_defect(pair_defects.defect_posteriors(df, "pair_id", "question", "response")).collect()}
    assert {k: found.get(k) for k in range(len(PAIRS))} == {k: d for k, (*_, d) in enumerate(PAIRS)}
    assert {k for k in found if k >= 1000} == set(range(2000, 2030))
    assert pair_defects.defect_posteriors(df.limit(0), "pair_id", "question", "response").count() == 0


def test_label_model_takes_abstention_for_nothing():
    patterns = np.array([[1, 1, 0], [1, 0, 0], [0, 0, 0], [-1, -1, 0], [-1, 0, -1], [0, 1, 1]])
    model = pair_defects.label_model(patterns, np.array([40.0, 20, 300, 2000, 900, 15]))
    post = model.posterior(patterns)
    assert (post[[0, 1, 5]] > 0.9).all() and (post[[3, 4]] < 0.01).all() and abs(post[2] - model.prior) < 1e-6 and 0.01 < model.prior < 0.1


def test_cutoffs_tell_planted_defects():
    pairs = [(f"Where did Ann leave box {k}?", f"Ann left box {k} at the long table, next to a bag.") for k in range(60)] + [(f"Wo hat Ann die Kiste {k} gelassen?", f"Die Kiste {k} steht noch auf dem Tisch, und sie ist offen.") for k in range(60)]
    made = pair_defects.planted(pairs)
    assert {d for *_, d in made} == {"empty", "copy", "truncated", "language"}
    votes = {d: np.array([pair_defects.votes(q, r)[d] for q, r, x in made if x == d]) for d in ("empty", "copy", "language")}
    assert all((v.max(1) == 1).mean() > 0.95 for v in votes.values())


def test_cutoffs_count_every_pair(spark, monkeypatch):
    pairs = [(k, f"Where did Ann leave box {k}?", f"Ann left box {k} at the long table, next to a bag.") if k % 3 else (k, f"Wo hat Ann die Kiste {k} gelassen?", f"Die Kiste {k} steht noch auf dem Tisch, und sie ist offen.") for k in range(4500)]
    df = spark.createDataFrame(pairs, "pair_id long, question string, response string")
    seen, validated = [], pair_defects.validated
    monkeypatch.setattr(pair_defects, "validated", lambda *given: seen.append(given) or validated(*given))
    plain = lambda side: {d: sorted((p.tolist(), int(n)) for p, n in zip(*x)) for d, x in side.items()}
    found = [{(r["defect"], r["cutoff"]) for r in pair_defects.defect_posteriors(df.repartition(n), "pair_id", "question", "response").select("defect", "cutoff").distinct().collect()} for n in (3, 7)]
    (_, made, clean), (_, again, _) = seen
    # no pair is left out, and how the rows lie tells nothing
    assert {d: n.sum() for d, (_, n) in clean.items()} == dict.fromkeys(pair_defects.DEFECTS, 4500)
    assert {d: n.sum() for d, (_, n) in made.items() if d != "language"} == {"empty": 4500, "copy": 4500, "truncated": 4500}
    assert 1500 < made["language"][1].sum() < 2500
    assert plain(made) == plain(again) and found[0] == found[1]


def test_long_response_is_read_whole():
    q = "Where did Ann leave the box?"
    text = "Ann left it at the long table. " * 20_000
    assert pair_defects.votes(q, text)["truncated"][0] == -1
    assert pair_defects.votes(q, text + "Then Tovik took it and")["truncated"][0] == 1


# --- packing ---


def packed(spark, sizes, capacities):
    df = spark.createDataFrame(list(enumerate(sizes)), "item long, size long").selectExpr("*", "1 AS capacity", "2 AS container", "3 AS items").repartition(3)
    return packing.pack(df, capacities, "item", "size").collect()


@settings(max_examples=4, deadline=None)
@given(st.lists(st.integers(0, 90), max_size=120))
def test_packing_keeps_every_item(spark, sizes):
    room, whole = Counter(), Counter()
    for r in packed(spark, sizes, [10, 37]):
        room[r["capacity"], r["container"]] += r["size"]
        whole[r["capacity"], r["item"]] += r["size"]
        if sizes[r["item"]] <= r["capacity"]:
            assert r["piece"] == 0
    assert all(v <= c for (c, _), v in room.items())
    assert whole == Counter({(c, k): s for c in (10, 37) for k, s in enumerate(sizes)})


def test_packing_leaves_little_room(spark):
    rng = random.Random(8)
    sizes = [rng.randint(1, 60) for _ in range(3000)] + [None, -3]
    used = {r["container"] for r in packed(spark, sizes, [64]) if r["size"]}
    assert sum(s for s in sizes if s and s > 0) / (64 * len(used)) > 0.95
    assert packed(spark, [], [64]) == []


# --- mixing ---


def test_mixing(spark):
    rng = random.Random(9)
    docs = [(k, rng.choice(["a", "a", "b", "c", "other", None]), rng.choice([0, 5, rng.randint(1, 400), 3000 if rng.random() < 0.02 else 7])) for k in range(4000)]
    df = spark.createDataFrame([*docs, (None, "a", 5), (9000, "a", None)], "doc_id long, source string, tokens long").selectExpr("*", "1 AS p", "2 AS copies").repartition(5)
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 4), ("none", 0.0, 1)] * 2, "source string, target_share double, max_repeats int")
    copies = mixing.mix_copies(df, targets)
    report = {r["source"]: r for r in mixing.mix_report(copies, targets).collect()}
    for s, share, most in (("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 4)):
        assert abs(report[s]["actual_share"] - share) < 0.01 and report[s]["most_repeats"] <= most
    assert {r["source"] for r in copies.select("source").distinct().collect()} == {"a", "b", "c"}
    assert mixing.mix_copies(df.limit(0), targets).count() == 0


def test_mixing_tree_keeps_groups_small(spark, monkeypatch):
    rng = random.Random(16)
    docs = [(k, rng.choice("aab"), rng.choice([5, rng.randint(1, 400), 3000 if rng.random() < 0.02 else 7])) for k in range(6000)]
    df = spark.createDataFrame(docs, "doc_id long, source string, tokens long").repartition(60)
    targets = spark.createDataFrame([("a", 0.6, 1), ("b", 0.4, 3)], "source string, target_share double, max_repeats int")
    largest, by = [], type(df).groupBy

    def watched(self, *cols):
        if cols == ("source", "node"):
            largest.append(by(self, *cols).count().agg(F.max("count")).first()[0])
        return by(self, *cols)

    monkeypatch.setattr(type(df), "groupBy", watched)
    copies = mixing.mix_copies(df, targets, fan_in=4)
    report = {r["source"]: r["actual_share"] for r in mixing.mix_report(copies, targets).collect()}
    assert abs(report["a"] - 0.6) < 0.002 and copies.count() == 6000
    assert len(largest) == 3 and max(largest) <= 4 * (1 / mixing.HEAVY + mixing.RESERVE + 2)


def test_flight_is_balanced_and_unbiased():
    rng = np.random.default_rng(10)
    sizes, p = rng.lognormal(5, 1, 60), rng.uniform(0.05, 0.95, 60)
    total = np.zeros(60)
    for _ in range(800):
        x = np.zeros(60)
        for k, v in mixing.flight(((k, p[k], sizes[k]) for k in range(60)), rng):
            x[k] = v
        assert abs(x.sum() - p.sum()) < 1e-6 and abs((x * sizes).sum() - (p * sizes).sum()) < 1e-4 and ((x > 0) & (x < 1)).sum() <= 2
        total += x
    assert np.abs(total / 800 - p).max() < 0.08
    moved = mixing.heavy_flight(p, sizes, 0.01, rng)
    assert abs(moved.sum() - p.sum()) < 1e-6 and abs((moved * sizes).sum() - (p * sizes).sum()) < 1e-4


# --- look-alikes ---


def test_canonical_examples():
    c = lookalikes.canonical
    same = [("Café", "Café"), ("Café", "Ｃａｆé"), ("office", "oﬃce"), ("a b", "a b"), ("ab", "a​b﻿"), ("paca", "раса"), ("Ёж", "Ёж"), ("e​́", "é"), ("Kelvin", "Kelvin"), ("a;", "a;"), ("x\r\ny", "x\ny"), ("-", "‑")]
    for a, b in same:
        assert c(a) == c(b), (a, b)
    for a, b in [("e", "é"), ("a", "A"), ("1", "l"), ("a.", "a!"), ("a", "a."), ("x2", "x²"), ("n", "ñ"), ("и", "й")]:
        assert c(a) != c(b), (a, b)
    assert c("") == "" and c("plain text") == "plain text"


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=30))
def test_canonical_equals_whole_text_normalisation(text):
    forms = lookalikes.forms_of(tuple(lookalikes.SAME_SHAPE.items()))
    whole = forms.whole(text)
    assert lookalikes.canonical(text) == whole
    assert lookalikes.canonical(whole) == whole


def test_look_alikes_of_all_alphabets(spark):
    shapes = lookalikes.look_alikes(spark)
    assert {c: shapes.get(c) for c in "ѵⲟᴏІӏӀ"} == {"ѵ": "v", "ⲟ": "o", "ᴏ": "o", "І": "I", "ӏ": "l", "Ӏ": "I"}
    assert not any(c in shapes for c in "éıłßждяфлδλω’„–…¹²") and all(len(v) == 1 and v.isascii() for v in shapes.values())
    assert all(unicodedata.category(k)[:2] == unicodedata.category(v)[:2] for k, v in shapes.items() if unicodedata.category(k) in ("Lu", "Ll") and k.isalpha() and v.isalpha())


def test_form_to_read_keeps_alphabets(spark):
    texts = ["Привет, как дела?", "Καλημέρα", "pаypаl аnd Ｗｉｄｅ", "Прuвет", "ﬁne\u200b text", None, "東京 タワー。，", "Ёж"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("lang", F.lit("x")).withColumn("changed", F.lit(1))
    found = {r["doc_id"]: (r["text"], r["changed"]) for r in lookalikes.canonical_texts(df, "id", "text", ("lang",)).collect()}
    assert [found[k][0] for k in range(8)] == ["Привет, как дела?", "Καλημέρα", "paypal and Wide", "Прuвет", "fine text", None, "東京 タワー。，", "Ёж"]
    assert [found[k][1] for k in (0, 1, 2, 4, 6, 7)] == [False, False, True, True, False, False]


def test_same_looking_classes(spark):
    rows = [(1, "раса"), (2, "paca"), (3, "paca"), (4, "rаcа"), (5, None), (6, ""), (7, "\u200b"), (2, "paca"), (9, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: (r["class_id"], r["links"]) for r in lookalikes.same_looking_classes(lookalikes.text_keys(df, "doc_id", "text")).collect()}
    assert found == {1: (1, 2), 2: (1, 1), 3: (1, 1), 4: (4, 0), 6: (6, 1), 7: (6, 1), 9: (9, 0)}
    assert lookalikes.same_looking_classes(lookalikes.text_keys(df.limit(0), "doc_id", "text")).count() == 0


def test_same_looking_pairs(spark):
    rows = [(1, "Café"), (2, "Café"), (3, "Café"), (4, "Cafe"), (5, None), (6, ""), (7, "​"), (None, "Café"), (2, "Café"), (8, "x" * 200_000), (9, "x" * 199_999 + "ｘ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("form_key", F.lit(1))
    found = lookalikes.same_looking_pairs(lookalikes.text_keys(df, "doc_id", "text"))
    assert {tuple(r) for r in found.collect()} == {(1, 2), (2, 3), (6, 7), (8, 9)}
    assert lookalikes.same_looking_pairs(lookalikes.text_keys(df.limit(0), "doc_id", "text")).count() == 0


# --- tokens ---


def test_token_counts(spark):
    texts = ["", None, "one two", "Größe 東京 🙂", "a" * 50_000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("tokens", F.lit(1))
    found = {r["id"]: r["tokens"] for r in tokens.token_counts(df, "text", ["id"]).collect()}
    e = tokens.encoding(tokens.VOCABULARY)
    assert found[0] == found[1] == 0
    for k in (2, 3, 4):
        ids = e.encode_ordinary(texts[k])
        assert found[k] == len(ids) and e.decode(ids) == texts[k]
