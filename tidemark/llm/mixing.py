"""Mixing sources to target shares of the total size by balanced sampling with the cube method.

Every source is used as often as its share asks for: a whole number of times, and a rest that is an inclusion
probability. The flight phase moves probabilities along the null space of the constraints - number of documents
and number of tokens - until one of them is 0 or 1; so both totals stay exact. In every partition and source
it moves three documents at a time, from the largest to the smallest. The largest ones, which three could not
balance, and a few small ones wait, with the last two, for a further flight: there each large document moves against
all smaller ones at once. Further flights form a tree, each over what at most 64 earlier ones left of a source,
so that no task gets more than a bounded number of documents; the last two of the last one are the landing problem.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.runtime import cut

HEAVY = 0.01  # share of a source's tokens in a flight from which a document waits for the next one; at most 1 / HEAVY can
RESERVE = 256  # documents of a flight that wait with them
FAN_IN = 64  # flights whose rest the next one takes


def flight(units: Iterator[tuple[int, float, float]], rng: np.random.Generator) -> Iterator[tuple[int, float]]:
    """(unit, inclusion) from (unit, probability, size); all but at most two inclusions are 0 or 1.

    Expected inclusions are the probabilities; sums of inclusion and of inclusion times size do not change.
    """
    eps = 1e-9
    held: list[list] = []
    draws = iter(())
    for unit, p, size in units:
        if p <= eps or p >= 1 - eps:
            yield unit, float(round(p))
            continue
        held.append([unit, p, size])
        if len(held) < 3:
            continue
        (_, p1, t1), (_, p2, t2), (_, p3, t3) = held
        u = (t3 - t2, t1 - t3, t2 - t1) if not t1 == t2 == t3 else (1.0, -1.0, 0.0)
        up = min((1 - p) / v if v > 0 else p / -v for p, v in zip((p1, p2, p3), u) if v)
        down = min(p / v if v > 0 else (1 - p) / -v for p, v in zip((p1, p2, p3), u) if v)
        draw = next(draws, None)
        if draw is None:
            draws = iter(rng.random(4096).tolist())
            draw = next(draws)
        step = up if draw * (up + down) < down else -down
        left = []
        for x, v in zip(held, u):
            x[1] += step * v
            if x[1] <= eps or x[1] >= 1 - eps:
                yield x[0], float(round(x[1]))
            else:
                left.append(x)
        held = left
    for unit, p, _ in held:
        yield unit, p


def heavy_flight(p: np.ndarray, t: np.ndarray, share: float, rng: np.random.Generator) -> np.ndarray:
    """Decides units that hold more than ``share`` of the size of all, largest first, each against all smaller ones.

    The direction of a step has 1 for the large unit and, for the others, what keeps number and size: a
    linear function of the size times p (1 - p). A unit that meets a bound on the way stays there.
    """
    p = p.copy()
    order = np.argsort(-t, kind="stable")
    eps = 1e-9
    for at, b in enumerate(order):
        if t[b] <= share * t.sum():
            break
        others = order[at + 1 :]
        for _ in range(len(others) + 1):
            free = others[(p[others] > eps) & (p[others] < 1 - eps)]
            if not eps < p[b] < 1 - eps or len(free) < 3:
                break
            g, x = p[free] * (1 - p[free]), t[free]
            m = np.array([[g.sum(), (g * x).sum()], [(g * x).sum(), (g * x * x).sum()]])
            if np.linalg.cond(m / m.max()) > 1e12:
                break
            a, c = np.linalg.solve(m, [-1.0, -t[b]])
            u = g * (a + c * x)
            with np.errstate(divide="ignore"):
                up = min(1 - p[b], np.where(u > 0, (1 - p[free]) / u, np.where(u < 0, -p[free] / u, np.inf)).min())
                down = min(p[b], np.where(u > 0, p[free] / u, np.where(u < 0, -(1 - p[free]) / u, np.inf)).min())
            step = up if rng.random() * (up + down) < down else -down
            p[b] += step
            p[free] += step * u
    p[p <= eps], p[p >= 1 - eps] = 0.0, 1.0
    return p


def waiting(size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Which units wait for the next flight: those that three cannot balance, and a few light ones to balance them with."""
    waits = size > HEAVY * size.sum()
    waits[rng.permutation(np.flatnonzero(~waits))[:RESERVE]] = True
    return waits


def land(units: list[tuple[int, float, float]]) -> dict[int, float]:
    """Inclusions of the few undecided units: the choice that leaves the totals of tokens, then of units, closest."""
    tokens, number = sum(p * s for _, p, s in units), sum(p for _, p, _ in units)
    best = min(range(1 << len(units)), key=lambda m: (abs(sum(s for k, (_, _, s) in enumerate(units) if m >> k & 1) - tokens), abs(bin(m).count("1") - number), m))
    return {u: float(best >> k & 1) for k, (u, _, _) in enumerate(units)}


def plan_mix(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, repeats, have_tokens, have_docs): how often each source is used.

    The total is the largest that no source's cap forbids, so that the source that binds is repeated
    ``max_repeats`` times. A target source without tokens cannot bind; its repeats are 0. Targets must be positive;
    repeated target rows count once.
    """
    have = sizes.groupBy("source").agg(F.sum("tokens").alias("have_tokens"), F.count("*").alias("have_docs"))
    wanted = targets.where("source IS NOT NULL AND target_share > 0 AND max_repeats > 0").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    joined = wanted.join(have, "source", "left").na.fill(0, ["have_tokens", "have_docs"])
    # the window is over the targets, not over the documents
    joined = joined.selectExpr("*", "min(CASE WHEN have_tokens > 0 THEN max_repeats * have_tokens / target_share END) OVER () AS total")
    return joined.selectExpr("source", "target_share", "max_repeats", "CASE WHEN have_tokens > 0 THEN least(target_share * total / have_tokens, CAST(max_repeats AS double)) ELSE 0D END AS repeats", "have_tokens", "have_docs")


def mix_copies(sizes: DataFrame, targets: DataFrame, seed: int = 1, fan_in: int = FAN_IN) -> DataFrame:
    """(doc_id, source, tokens, copies) of every document of a target source.

    ``sizes`` has ``doc_id, source, tokens``. No document has more copies than its source's ``max_repeats``. A flight of the
    tree gets at most ``fan_in * (1 / HEAVY + RESERVE + 2)`` documents of a source.

    Defined cases: documents without id or source, or of other sources, are left out; a document of size 0 is
    drawn like others; repeated rows are documents of their own; equal sizes keep the count exact; an empty
    table gives an empty result; other columns do not matter.
    """
    rows = cut(sizes.select("doc_id", "source", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens")).where("doc_id IS NOT NULL AND source IS NOT NULL"))
    plan = plan_mix(rows, targets).where("repeats > 0").select("source", "repeats").toPandas()  # one row for each target
    repeats = dict(zip(plan["source"], plan["repeats"].astype(float)))
    whole = {s: int(np.floor(r + 1e-9)) for s, r in repeats.items()}

    def fly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        by: dict[str, tuple[list, list]] = {}
        for batch in batches:
            for d, s, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if s in repeats:
                    ids, tokens = by.setdefault(s, ([], []))
                    ids.append(d)
                    tokens.append(t)
        for s in sorted(by):
            ids, tokens = by[s]
            p = max(0.0, repeats[s] - whole[s])
            rng = np.random.default_rng([seed, part, zlib.crc32(s.encode())])
            size = np.array(tokens, float)
            made = np.full(len(ids), p)
            waits = waiting(size, rng)
            for k, inclusion in flight(((int(k), p, float(size[k])) for k in np.argsort(-size, kind="stable") if not waits[k]), rng):
                made[k] = inclusion
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([s] * len(ids)), pa.array(tokens, pa.int64()), pa.array(made), pa.array([part] * len(ids), pa.int32())], names=["doc_id", "source", "tokens", "p", "node"])

    def further(last: bool):
        def run(table: pa.Table) -> pa.Table:
            ids, tokens, p = (table.column(c).to_pylist() for c in ("doc_id", "tokens", "p"))
            s, node = table.column("source")[0].as_py(), table.column("node")[0].as_py()
            order = sorted(range(len(ids)), key=lambda k: (-tokens[k], ids[k], p[k]))
            rng = np.random.default_rng([seed, 1 << 31, node, zlib.crc32(s.encode())])
            size = np.array([tokens[k] for k in order], float)
            now = heavy_flight(np.array([p[k] for k in order]), size, HEAVY / 4, rng)
            waits = np.zeros(len(order), bool) if last else waiting(size, rng) & (now > 0) & (now < 1)
            made = {k: float(now[k]) for k in range(len(order)) if waits[k]}
            made |= dict(flight(((k, float(now[k]), float(size[k])) for k in range(len(order)) if not waits[k]), rng))
            if last:
                made |= land([(k, x, float(size[k])) for k, x in made.items() if 0 < x < 1])
            back = {order[k]: x for k, x in made.items()}
            return table.set_column(table.schema.get_field_index("p"), "p", pa.array([back[k] for k in range(len(ids))]))

        return run

    schema = "doc_id bigint, source string, tokens bigint, p double, node int"
    flown = cut(rows.mapInArrow(fly, schema))
    nodes = flown.rdd.getNumPartitions()
    decided = flown.where("p = 0 OR p = 1")
    while True:
        nodes = -(-nodes // fan_in)
        open_ones = flown.where("p > 0 AND p < 1").withColumn("node", F.expr(f"CAST(node DIV {fan_in} AS int)"))
        flown = open_ones.groupBy("source", "node").applyInArrow(further(nodes <= 1), schema)
        if nodes <= 1:
            break
        flown = cut(flown)
        decided = decided.unionByName(flown.where("p = 0 OR p = 1"))
    base = ", ".join(f"'{s}', {w}" for s, w in sorted(whole.items())) if whole else "'', 0"
    return decided.unionByName(flown).selectExpr("doc_id", "source", "tokens", f"CAST(p AS int) + element_at(map({base}), source) AS copies")


def mix_report(copies: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, docs, doc_uses, tokens, most_repeats) of each target source."""
    used = copies.groupBy("source").agg(F.sum(F.col("copies") * F.col("tokens")).alias("tokens"), F.sum((F.col("copies") > 0).cast("long")).alias("docs"), F.sum(F.col("copies").cast("long")).alias("doc_uses"), F.max("copies").alias("most_repeats"))
    wanted = targets.where("source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("target_share"))
    made = wanted.join(used, "source", "left").na.fill(0, ["tokens", "docs", "doc_uses", "most_repeats"])
    return made.selectExpr("source", "target_share", "round(tokens / nullif(sum(tokens) OVER (), 0), 6) AS actual_share", "docs", "doc_uses", "tokens", "most_repeats")
