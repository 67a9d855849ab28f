"""Classes and links of near-duplicate texts against brute force."""

import random

from tidemark.operators.minhash import near_duplicates, shingle_hashes


def brute(texts, threshold=0.8):
    sets = {k: set(shingle_hashes(t).tolist()) for k, t in texts.items()}
    first, links, parent = {}, {k: set() for k in texts}, {k: k for k in texts}
    node = {k: first.setdefault(texts[k], k) for k in sorted(texts)}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(set(node.values()))
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and len(x & y) >= threshold * len(x | y):
                links[a].add(b)
                links[b].add(a)
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {k: (root(node[k]), len(links[node[k]])) for k in texts}


def check(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    found = near_duplicates(df, "id", "text")
    assert {r["doc_id"]: (r["class_id"], r["links"]) for r in found.collect()} == brute(texts)


def test_groups_of_near_copies(spark):
    rng, texts = random.Random(4), {}
    for size in (2, 5, 12, 50):
        base = [f"w{rng.randrange(5000)}" for _ in range(160)]
        for _ in range(size):
            words = list(base)
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(5000)}"
            texts[len(texts)] = " ".join(words)
    for t in ("Yes.", "yes!", "YES", "Yes.", "", "", "...", "one two three", "One, two, three", None):
        texts[len(texts)] = t or ""
    ids = rng.sample(range(1000), len(texts))
    check(spark, {i: t for i, t in zip(ids, texts.values())})


def test_no_pair_at_the_threshold_is_missed(spark):
    texts = {}
    for k in range(300):
        words = [f"w{k}x{i}" for i in range(94)]
        # of 90 shingles each, 80 in common: 0.80; every third pair 81 in common: 0.82; some 79: too few
        lost = (10, 10, 9)[k % 3] if k % 10 else 11
        texts[2 * k], texts[2 * k + 1] = " ".join(words), " ".join(words[:-lost] + [f"v{k}x{i}" for i in range(lost)])
    assert sum(links for _, links in brute(texts).values()) == 540
    check(spark, texts)


def shuffled(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()


def test_texts_of_no_likeness_do_not_move(spark):
    # texts that share phrases and are not alike: what is shuffled stays below the texts themselves
    rng = random.Random(8)
    phrases = [" ".join(f"w{rng.randrange(9000)}" for _ in range(8)) for _ in range(300)]
    texts = {i: " ".join(rng.choice(phrases) for _ in range(24)) for i in range(900)}
    before = shuffled(spark)
    check(spark, texts)
    assert shuffled(spark) - before < sum(map(len, texts.values()))
