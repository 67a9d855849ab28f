"""Temporal joins and windows over captions: containment, overlap, nearest, anchored windows, roll-ups, samples.

Intervals are running seconds. Joins on ranges go through time buckets, so that they are equi-joins: an interval of
the longer side is spread over the buckets that it touches, one of the shorter side stands in the bucket of its
start, and the exact condition follows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import slices

SIX_HOURS = 6 * 3600
#: Slices of running seconds: a day, or a smaller cut of it.
DAY = "start_ts DIV 86400"
#: Coarse granularity, fine granularity, edge weight.
LADDER = [("3min", "30sec", 1.0), ("10min", "3min", 1.0), ("1h", "10min", 1.0), ("1h", "30sec", 0.5)]
#: How many results of each kind a ranking may hold.
QUOTAS = {"30sec": 8, "3min": 4, "10min": 3, "1h": 0, "semantic": 5, "entity": 3}


def contains_edges(episodes: DataFrame, bucket_s: int = 3600) -> DataFrame:
    """(src, dst, weight): a coarse episode contains a finer one of the same subject, by the ladder.

    ``episodes`` has ``subject, granularity, id, start_ts, end_ts``. A fine episode lies within one coarse one, so the
    bucket of its start is among those of its container.
    """
    ladder = " WHEN ".join(f"g = '{c}' AND f = '{x}' THEN {w}D" for c, x, w in LADDER)
    coarse = episodes.where("granularity IN ('3min', '10min', '1h')").selectExpr("subject", "granularity AS g", "id AS src", "start_ts AS cs", "end_ts AS ce", f"explode(sequence(floor(start_ts / {bucket_s}), floor(end_ts / {bucket_s}))) AS b")
    fine = episodes.where("granularity IN ('30sec', '3min', '10min')").selectExpr("subject", "granularity AS f", "id AS dst", "start_ts AS fs", "end_ts AS fe", f"floor(start_ts / {bucket_s}) AS b")
    return coarse.join(fine, ["subject", "b"]).where("cs <= fs AND fe <= ce").selectExpr("src", "dst", f"CASE WHEN {ladder} END AS weight").where("weight IS NOT NULL")


def temporal_next_edges(episodes: DataFrame, longest_gap_s: int = SIX_HOURS) -> DataFrame:
    """(src, dst, weight), both ways, between consecutive episodes of a granularity that are not too far apart."""
    nxt = slices.following(episodes.selectExpr("subject", "granularity", "id AS a", "start_ts", "end_ts"), ["subject", "granularity"], ["start_ts", "a"], DAY, {"b": "a", "next_start": "start_ts"}).selectExpr("a", "b", "next_start - end_ts AS gap")
    near = nxt.where(f"b IS NOT NULL AND gap >= 0 AND gap <= {longest_gap_s}")
    return near.select(F.expr("inline(array(struct(a AS src, b AS dst), struct(b AS src, a AS dst)))"), F.expr("1D / (gap + 1) AS weight"))


def co_clip_edges(episodes: DataFrame, clips: DataFrame) -> DataFrame:
    """(src, dst), both ways, between a clip and a 30sec episode of the same subject and times."""
    fine = episodes.where("granularity = '30sec'").selectExpr("subject", "start_ts", "end_ts", "id AS e")
    pairs = clips.selectExpr("subject", "start_ts", "end_ts", "id AS c").join(fine, ["subject", "start_ts", "end_ts"])
    return pairs.select(F.expr("inline(array(struct(c AS src, e AS dst), struct(e AS src, c AS dst)))"))


def overlapping(intervals: DataFrame, spans: DataFrame, inclusive: bool, bucket_s: int = 3600) -> DataFrame:
    """``spans`` (subject, span, s, e) with the ids of intervals that overlap them, and the clipped overlap."""
    left = spans.selectExpr("subject", "span", "s", "e", f"explode(sequence(floor(s / {bucket_s}), floor(e / {bucket_s}))) AS b")
    right = intervals.selectExpr("subject", "id", "start_ts", "end_ts", f"explode(sequence(floor(start_ts / {bucket_s}), floor(end_ts / {bucket_s}))) AS b")
    meet = "start_ts <= e AND end_ts >= s" if inclusive else "start_ts < e AND end_ts > s"
    # a pair that shares several buckets is kept in the first of them
    first = f"b = greatest(floor(s / {bucket_s}), floor(start_ts / {bucket_s}))"
    return left.join(right, ["subject", "b"]).where(f"{meet} AND {first}").selectExpr("subject", "span", "id", "greatest(start_ts, s) AS from_ts", "least(end_ts, e) AS to_ts")


def first_containing(segments: DataFrame, moments: DataFrame, bucket_s: int = 3600) -> DataFrame:
    """(moment, start_ts, end_ts) of the first segment that holds each moment, both ends included; (0, 0) if none does."""
    seg = segments.selectExpr("subject", "id", "start_ts", "end_ts", f"explode(sequence(floor(start_ts / {bucket_s}), floor(end_ts / {bucket_s}))) AS b")
    hit = moments.selectExpr("moment", "subject", "t", f"floor(t / {bucket_s}) AS b").join(seg, ["subject", "b"]).where("t BETWEEN start_ts AND end_ts")
    best = hit.groupBy("moment").agg(F.min(F.struct("start_ts", "id", "end_ts")).alias("x"))
    return moments.select("moment").distinct().join(best, "moment", "left").selectExpr("moment", "coalesce(x.start_ts, 0) AS start_ts", "coalesce(x.end_ts, 0) AS end_ts")


def uncovered(facts: DataFrame, covers: DataFrame, slack_s: int = 60) -> DataFrame:
    """Facts (fact, subject, t) that lie within ``slack_s`` of no cover (subject, c)."""
    left = facts.selectExpr("fact", "subject", "t", f"explode(sequence(floor(t / {slack_s}) - 1, floor(t / {slack_s}) + 1)) AS b")
    near = left.join(covers.selectExpr("subject", "c", f"floor(c / {slack_s}) AS b").distinct(), ["subject", "b"]).where(f"abs(t - c) <= {slack_s}").select("fact").distinct()
    return facts.join(near, "fact", "left_anti")


def nearest_start(captions: DataFrame, stamps: DataFrame, within: int) -> DataFrame:
    """(stamp, caption_id): the caption whose start lies nearest, the later one of two equally near ones.

    One sort of both sides and two running windows, per subject and day.
    """
    both = captions.selectExpr("subject", "day", "start_s AS t", "caption_id", "CAST(NULL AS string) AS stamp").unionByName(stamps.selectExpr("subject", "day", "t", "CAST(NULL AS bigint) AS caption_id", "stamp"))
    order = Window.partitionBy("subject", "day").orderBy("t")
    low, high = F.last(F.when(F.col("caption_id").isNotNull(), F.col("t")), True), F.first(F.when(F.col("caption_id").isNotNull(), F.col("t")), True)
    seen = both.withColumns({"before": low.over(order.rangeBetween(Window.unboundedPreceding, -1)), "after": high.over(order.rangeBetween(0, Window.unboundedFollowing))}).where("stamp IS NOT NULL")
    chosen = seen.selectExpr("subject", "day", "stamp", "CASE WHEN after IS NOT NULL AND (before IS NULL OR after - t <= t - before) THEN after ELSE before END AS start_s", "t").where(f"abs(start_s - t) <= {within}")
    ids = captions.groupBy("subject", "day", "start_s").agg(F.min("caption_id").alias("caption_id"))
    return chosen.join(ids, ["subject", "day", "start_s"]).select("stamp", "caption_id")


def fixed_rollup(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """Groups of n consecutive rows: first start, last end, first path, texts that are not blank in order."""
    numbered = slices.numbered(rows, keys, order, DAY).withColumn("grp", F.expr(f"CAST((rn - 1) DIV {n} AS bigint)"))
    return numbered.groupBy(*keys, "grp").agg(
        F.min_by("start_ts", "rn").alias("start_ts"), F.max_by("end_ts", "rn").alias("end_ts"), F.min_by("video_path", "rn").alias("video_path"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.trim("text") != "", F.struct("rn", "text")))), lambda x: x["text"]), " ").alias("text"), F.count("*").alias("n_rows"),
    )


def bins(rows: DataFrame, keys: list[str], width_s: int, last_bin: int) -> DataFrame:
    """Segments by the bin of their middle, the last bin taking what lies beyond; texts joined in order."""
    at = rows.withColumn("bin", F.expr(f"CAST(least(floor((start_ts + end_ts) / 2 / {width_s}), {last_bin}) AS bigint)"))
    return at.groupBy(*keys, "bin").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_ts", "id", "text"))), lambda x: x["text"]), " ").alias("text"), F.count("*").alias("n_rows")).where("trim(text) <> ''")


def anchor_windows(rows: DataFrame, keys: list[str], start: str, end: str, length: int, grid: int = 0) -> DataFrame:
    """Windows anchored at the first row: a new one begins with the first row at or beyond anchor + length.

    With ``grid`` later windows begin at multiples of it. Rows of a key are sorted and folded in one pass over the
    sorted partition, so that no key's rows are gathered.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema) + ", win bigint, first_start bigint, last_end bigint, n_rows bigint"
    part = rows.select(*keys, F.col(start).cast("long").alias("__s"), F.col(end).cast("long").alias("__e")).where("__s IS NOT NULL").repartition(*keys).sortWithinPartitions(*keys, "__s", "__e")

    def fold(batches):
        import pyarrow as pa

        key = anchor = None
        win = n = first = last = 0
        names = [*keys, "win", "first_start", "last_end", "n_rows"]
        out: list[tuple] = []
        types = None
        for batch in batches:
            types = [batch.schema.field(k).type for k in keys] + [pa.int64()] * 4
            columns = [batch.column(i).to_pylist() for i in range(len(keys) + 2)]
            for row in zip(*columns):
                k, s, e = row[:-2], row[-2], row[-1]
                if k != key:
                    if key is not None:
                        out.append((*key, win, first, last, n))
                    key, win, anchor = k, 0, s
                    first, last, n = s, e, 0
                elif s >= anchor + length:
                    out.append((*key, win, first, last, n))
                    win, anchor = win + 1, s // grid * grid if grid else s
                    first, last, n = s, e, 0
                last, n = (e if e is not None and (last is None or e > last) else last), n + 1
            if len(out) >= 8192:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                out = []
        if key is not None:
            out.append((*key, win, first, last, n))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return part.mapInArrow(fold, schema)


def uniform_sample(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """n rows of each key at equal steps from first to last; all rows where there are at most n."""
    numbered = slices.numbered(rows, keys, order, DAY, count="cnt").withColumn("rn", F.col("rn") - 1)
    # row r is taken if some step i has floor(i * (cnt - 1) / (n - 1)) = r
    step = f"(rn * {n - 1} + cnt - 2) DIV (cnt - 1)"
    return numbered.where(f"cnt <= {n} OR (({step}) <= {n - 1} AND ({step}) * (cnt - 1) DIV {n - 1} = rn)").drop("cnt")


def char_budget(rows: DataFrame, keys: list[str], order: list[str], text: str, chars: int) -> DataFrame:
    """Rows while the running length, with one separator each, stays within the budget."""
    return slices.running_sum(rows, keys, order, DAY, f"length({text}) + 1", "cum").where(F.col("cum") <= chars)


def frame_budget(rows: DataFrame, keys: list[str], order: list[str], frames: str, total: int = 64, per_clip: int = 16) -> DataFrame:
    """How many frames each clip gets from what earlier ones left of the total."""
    used = slices.running_sum(rows, keys, order, DAY, f"least({frames}, {per_clip})", "__used", upto=False)
    return used.withColumn("allotted", F.expr(f"CAST(greatest(0, least(least({frames}, {per_clip}), {total} - __used)) AS bigint)")).drop("__used")


def quota_rank(scored: DataFrame, query: list[str], kind: str, quotas: dict[str, int], top_k: int) -> DataFrame:
    """Best rows per query within the quota of their kind (kinds without quota are not limited), then the top k.

    Ties of ``score`` go to the smaller ``id``. Both ranks are top-n windows, so that Spark limits rows before it shuffles.
    """
    most = " ".join(f"WHEN {kind} = '{k}' THEN {v}" for k, v in quotas.items())
    over = ", ".join(query)
    ranked = scored.selectExpr("*", f"row_number() OVER (PARTITION BY {over}, {kind} ORDER BY score DESC, id) AS kind_rank").where(f"kind_rank <= CASE {most} ELSE {top_k} END AND kind_rank <= {top_k}")
    return ranked.selectExpr("*", f"row_number() OVER (PARTITION BY {over} ORDER BY score DESC, id) AS rank").where(f"rank <= {top_k}")


def interleave_by_time(parts: list[DataFrame], by: str) -> DataFrame:
    """(by, item, pos): items (by, tm, late, item) of all parts in order of time within each group; those with ``late`` = 1 come last."""
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    return rows.selectExpr(by, "item", f"row_number() OVER (PARTITION BY {by} ORDER BY late, tm, item) AS pos")


def first_id(segments: DataFrame, moments: DataFrame, bucket_s: int = 3600) -> DataFrame:
    """(moment, id) of the first segment that holds each moment, both ends included; moments that none holds are left out."""
    seg = segments.selectExpr("subject", "id", "start_ts", "end_ts", f"explode(sequence(floor(start_ts / {bucket_s}), floor(end_ts / {bucket_s}))) AS b")
    hit = moments.selectExpr("moment", "subject", "t", f"floor(t / {bucket_s}) AS b").join(seg, ["subject", "b"]).where("t BETWEEN start_ts AND end_ts")
    return hit.groupBy("moment").agg(F.min_by("id", F.struct("start_ts", "id")).alias("id"))


def proportional_sample(rows: DataFrame, keys: list[str], order: list[str], ratio: float) -> DataFrame:
    """A share of each key's rows at equal steps from first to last, one row at least."""
    numbered = slices.numbered(rows, keys, order, DAY, count="cnt").selectExpr("*", "rn - 1 AS __i", f"greatest(1L, CAST(floor(cnt * {ratio}D) AS bigint)) AS __m")
    step = "(__i * (__m - 1) + cnt - 2) DIV (cnt - 1)"
    return numbered.where(f"(__m = 1 AND __i = 0) OR (__m > 1 AND ({step}) <= __m - 1 AND ({step}) * (cnt - 1) DIV (__m - 1) = __i)").drop("cnt", "__i", "__m")
