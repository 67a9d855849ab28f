"""Consensus of several annotators by minimax conditional entropy.

An annotator i gives item j of true class c the label k with probability proportional to
exp(sigma_i(c, k) + tau_j(c, k)). Label posteriors and the regularised dual parameters are raised in turn: the
item parameters tau inside the tasks, where the labels of an item lie together, to their optimum for the given
annotators, and the annotator parameters sigma from sums over all items. Rounds without tilts of items start the fit;
each kind of round ends when the dual's value settles. Only those sums and the model (classes squared numbers an annotator) reach the
driver; their size depends on the number of annotators, which is checked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.runtime import cut

MAX_ANNOTATORS = 100_000
CLASSES = 6
# A label is a set of classes: the six scores, then the two coarse ones of which only the smoothed score is left.
SETS = np.array([[c == k for c in range(CLASSES)] for k in range(CLASSES)] + [[c <= 2 for c in range(CLASSES)], [c >= 4 for c in range(CLASSES)]], float)
SETS32 = SETS.astype(np.float32)
LOW, HIGH = 6, 7


def judge_labels(results: DataFrame) -> DataFrame:
    """(id, judge_id, label): the latest usable score of each judge for each id.

    A score 0-5 is its own label; without a raw score, a smoothed one of 0 or 1 is the set of scores behind it and
    0.5 is a 3. Rows without id or judge, failed calls and scores out of range say nothing.
    """
    answer = "lower(trim(coalesce(judge_response, '')))"
    failed = f"({answer} RLIKE '(error|exception|timeout|timed out|rate limit|empty response|no response|failed|failure|unavailable|not available|n/a)' AND NOT {answer} RLIKE '[0-5]')"
    label = f"CASE WHEN {failed} THEN NULL WHEN raw_score BETWEEN 0 AND 5 THEN raw_score WHEN raw_score IS NULL AND smoothed_score = 0 THEN {LOW} WHEN raw_score IS NULL AND smoothed_score = 0.5 THEN 3 WHEN raw_score IS NULL AND smoothed_score = 1 THEN {HIGH} END"
    usable = results.selectExpr("id", "judge_id", f"{label} AS label", "scored_at", "result_id").where("id IS NOT NULL AND judge_id IS NOT NULL AND label IS NOT NULL")
    return usable.groupBy("id", "judge_id").agg(F.max_by("label", F.struct("scored_at", "result_id", "label")).alias("label"))


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(-1, keepdims=True)
    return x - np.log(np.exp(x).sum(-1, keepdims=True))


def _solve_items(judge, label, starts, sigma, log_prior, beta, tilts: bool, most: int = 25, still: float = 2e-3):
    """Posteriors of items, the distribution over labels given each class, the labels seen, and the dual's value.

    Labels of item j begin at ``starts[j]``. The tilts of the items rise from zero in damped steps, in turn with the
    posteriors, until no posterior moves by ``still``; items at rest take no further part.
    """
    n, counts = len(starts), np.diff(np.append(starts, len(judge)))
    sets, base = SETS32[label], sigma[judge]
    p, seen = np.empty_like(base), np.empty_like(base)
    q, value = np.empty((n, CLASSES), np.float32), 0.0
    live, tau, before = np.arange(n), np.zeros((n, CLASSES, CLASSES), np.float32), None
    for step in range(most if tilts else 1):
        size = counts[live]
        first = np.cumsum(size) - size
        at = np.repeat(starts[live] - first, size) + np.arange(size.sum())
        own = np.repeat(np.arange(len(live)), size)
        z = base[at] + tau[own] if step else base[at]
        z -= z.max(-1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(-1, keepdims=True)
        held = z * sets[at][:, None, :]
        likely = held.sum(-1) + np.float32(1e-12)
        held /= likely[:, :, None]  # a coarse label counts for its classes in the shares that the model gives them
        logs = np.add.reduceat(np.log(likely), first, axis=0) + log_prior
        top = logs.max(-1, keepdims=True)
        now = np.exp(logs - top)
        total = now.sum(-1, keepdims=True)
        now /= total
        rest = np.ones(len(live), bool) if step + 1 == (most if tilts else 1) else np.zeros(len(live), bool) if before is None else np.abs(now - before).max(-1) < still
        if rest.any():
            done = rest[own]
            p[at[done]], seen[at[done]], q[live[rest]] = z[done], held[done], now[rest]
            value += float((top + np.log(total))[rest].sum()) - beta / 2 * float((tau[rest] ** 2).sum())
        if rest.all():
            break
        grad = np.add.reduceat(held - z, first, axis=0) * now[:, :, None] - beta * tau
        tau = (tau + grad / (beta + size[:, None, None] / 4)).astype(np.float32)[~rest]
        live, before = live[~rest], now[~rest]
    return q, p, seen, value


def _flat(batch: pa.RecordBatch, index: dict[str, int]):
    """Annotator and label of each label, and where the labels of each item begin."""
    lists = batch.column("labels")
    offsets = lists.offsets.to_numpy()
    flat = lists.flatten()
    names = flat.field("judge_id").dictionary_encode()
    code = np.array([index[x] for x in names.dictionary.to_pylist()], dtype=int)
    return code[names.indices.to_numpy()], flat.field("label").to_numpy(zero_copy_only=False).astype(int), (offsets[:-1] - offsets[0]).astype(int)


def _by_judge(judge: np.ndarray, x: np.ndarray, into: np.ndarray) -> None:
    order = np.argsort(judge, kind="stable")
    held, first = np.unique(judge[order], return_index=True)
    into[held] += np.add.reduceat(x[order], first, axis=0)


def fit_consensus(labels: DataFrame, *, gamma: float = 0.02, rounds: int = 200, settled: float = 5e-5) -> tuple[DataFrame, DataFrame, int]:
    """Posteriors per item, reliability per annotator and the most frequent true score, from (id, judge_id, label).

    The strength of the regularisation follows the counts: alpha = gamma * classes^2 for annotators, and
    beta = alpha times labels per annotator over labels per item for items. Rounds end when the dual rises by less than ``settled``
    for each label; ``rounds`` of either kind are the most, where a small table's last rises are too slow to matter.

    Items come as (id, raw_score, posterior); annotators as (judge_id, reliability, n_labels), where reliability is
    the probability that the annotator gives the true score, with classes as frequent as they are.
    Defined cases: no label at all gives two empty tables; a tie of posteriors goes to the lower score; an
    item with one label follows that annotator's tilt; an item without labels has the shares of the classes as its
    posterior, so the most frequent class (the third result) is its score; more than MAX_ANNOTATORS annotators raise an error, since
    the model would no longer be small.
    """
    spark = labels.sparkSession
    items = cut(labels.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("judge_id", "label"))).alias("labels")))
    per_judge = items.select(F.explode("labels").alias("x")).groupBy("x.judge_id").count().limit(MAX_ANNOTATORS + 1).collect()
    if len(per_judge) > MAX_ANNOTATORS:
        raise ValueError(f"more than {MAX_ANNOTATORS} annotators")
    names = sorted(r["judge_id"] for r in per_judge)
    counts = {r["judge_id"]: r["count"] for r in per_judge}
    index = {x: i for i, x in enumerate(names)}
    n_items, n_labels = items.count(), sum(counts.values())
    alpha = gamma * CLASSES**2
    beta = alpha * max(1.0, (n_labels / max(1, len(names))) / max(1.0, n_labels / max(1, n_items)))
    # start: everyone is right more often than wrong, and near misses are likelier than far ones
    far = np.abs(np.arange(CLASSES)[:, None] - np.arange(CLASSES)[None, :])
    sigma = np.tile(_log_softmax(-0.9 * far), (len(names), 1, 1))
    prior = np.full(CLASSES, 1 / CLASSES)

    def sums(model):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sigma, prior, tilts = model.value
            s, m, mass, value = np.zeros_like(sigma), np.zeros_like(sigma), np.zeros(CLASSES), 0.0
            for batch in batches:
                if batch.num_rows:
                    judge, label, starts = _flat(batch, index)
                    q, p, seen, more = _solve_items(judge, label, starts, sigma.astype(np.float32), np.log(prior).astype(np.float32), beta, tilts)
                    each = np.repeat(q, np.diff(np.append(starts, len(judge))), axis=0)[:, :, None]
                    _by_judge(judge, seen * each, s)
                    _by_judge(judge, p * each, m)
                    mass += q.sum(0, dtype=float)
                    value += more
            flat = np.concatenate([s.ravel(), m.ravel(), mass, [value]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["k", "v"])

        return run

    tilts, value, k = False, -np.inf, 0
    while names:
        model = spark.sparkContext.broadcast((sigma, prior, tilts))
        total = items.mapInArrow(sums(model), "k bigint, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas()
        flat = np.zeros(2 * sigma.size + CLASSES + 1)
        flat[total["k"].to_numpy()] = total["v"].to_numpy()
        model.destroy()
        s, m = flat[: 2 * sigma.size].reshape(2, *sigma.shape)
        mass, before, value, k = flat[-CLASSES - 1 : -1], value, flat[-1], k + 1
        if value - before <= settled * n_labels or k >= rounds:
            if tilts:
                break
            tilts, value, k = True, -np.inf, 0
        # ascent on each coordinate of the dual: scaling towards the observed mass, damped by the regulariser
        weight = m.sum(-1, keepdims=True)
        sigma = sigma + (weight / (weight + alpha)) * np.log((s + alpha / CLASSES) / (m + alpha / CLASSES))
        sigma -= sigma.mean(-1, keepdims=True)
        prior = (mass + 1) / (mass + 1).sum()
    model = spark.sparkContext.broadcast((sigma.astype(np.float32), np.log(prior).astype(np.float32)))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigma, prior = model.value
        for batch in batches:
            if batch.num_rows:
                judge, label, starts = _flat(batch, index)
                q = _solve_items(judge, label, starts, sigma, prior, beta, True)[0]
                best = q.argmax(1)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(best.astype("int32")), pa.array(q[np.arange(len(q)), best].astype(float))], names=["id", "raw_score", "posterior"])

    right = np.exp(_log_softmax(sigma)) if names else np.zeros((0, CLASSES, CLASSES))
    reliability = (right[:, np.arange(CLASSES), np.arange(CLASSES)] * prior).sum(1) if names else []
    judges = spark.createDataFrame([(x, float(r), int(counts[x])) for x, r in zip(names, reliability)], "judge_id string, reliability double, n_labels bigint")
    return items.mapInArrow(answer, "id string, raw_score int, posterior double"), judges, int(prior.argmax())


def agreement(labels: DataFrame) -> DataFrame:
    """(id, n_judges, agreement): mean over pairs of judges of 1 - |a - b| / 5, from exact labels only.

    NULL for an id with fewer than two exact labels. Counts by score suffice, so that no pairs are made.
    """
    exact = labels.where(F.col("label") < CLASSES)
    counts = exact.groupBy("id").agg(F.count("*").alias("n"), *[F.sum((F.col("label") == k).cast("long")).alias(f"c{k}") for k in range(CLASSES)])
    apart = " + ".join(f"c{a} * c{b} * {b - a}" for a in range(CLASSES) for b in range(a + 1, CLASSES))
    return counts.selectExpr("id", "n AS n_judges", f"CASE WHEN n > 1 THEN round(1 - 2 * ({apart}) / (5D * n * (n - 1)), 6) END AS agreement")


def every_id(results: DataFrame, found: DataFrame, usual: int) -> DataFrame:
    """(id, raw_score) for each id of ``results``; an id without any usable score gets ``usual``."""
    ids = results.select("id").where("id IS NOT NULL").distinct()
    return ids.join(found, "id", "left").select("id", F.coalesce("raw_score", F.lit(usual)).alias("raw_score"))
