"""Topic chains: entities that recur, the captions that mention them, and facts put beside retrieved episodes."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recurring(mentions: DataFrame, least: int) -> DataFrame:
    """(subject, entity, times): entities mentioned at so many different times at least."""
    return mentions.where(F.length("entity") >= 2).groupBy("subject", "entity").agg(F.countDistinct("ts").alias("times")).where(F.col("times") >= least)


#: Characters of words, and blanks around a name, in regular expressions inside of SQL text; captions of a subject that go to one task together, about.
_BLANK, GROUP = "[\\\\s\\\\p{Z}]", 20_000


def keyword_hits(entities: DataFrame, captions: DataFrame) -> DataFrame:
    """(subject, entity, id): captions whose text has the name of an entity, whole words, plural or not, in any case.

    Every name counts, whatever its characters, as it is, with its hyphens as spaces or left out, and with its spaces as hyphens or left out. Each run of word characters in a name stands in the text as a whole word, only
    the last with a plural's end; stretches of words in a text are looked up among the names. A name without word characters meets all captions of its subject. Captions move once; a subject's captions are cut into groups of about ``GROUP`` by id, and its names go to each of them.
    """
    # columns are renamed, since both sides may come from one table
    texts = captions.where("subject IS NOT NULL AND text IS NOT NULL").selectExpr("subject", "id", "lower(text) AS text")
    texts = texts.toDF(*texts.columns)
    # one row for each so many captions at most
    many = texts.groupBy("subject").agg(F.count("*").alias("n")).where(f"n > {GROUP}").selectExpr("subject", f"n DIV {GROUP} + 1 AS groups")
    placed = texts.join(F.broadcast(many), "subject", "left").selectExpr("subject", "pmod(xxhash64(id), coalesce(groups, 1L)) AS part", "id", "text")
    names = entities.where("subject IS NOT NULL AND entity IS NOT NULL").select("subject", "entity").distinct().toDF("subject", "entity").join(F.broadcast(many), "subject", "left")
    spread = names.selectExpr("subject", "explode(sequence(0L, coalesce(groups, 1L) - 1)) AS part", "entity", f"regexp_replace(lower(entity), '^{_BLANK}+|{_BLANK}+\\\\z', '') AS name")

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        entity, rows, had = [], [], set()
        ids, told = right.column("id").to_pylist(), right.column("text").to_pylist()
        # what stands from the first to the last word of a spelling -> the names, each with the test of its other characters if there are any
        cores: dict[str, list] = {}
        lengths, bare = set(), []
        for whole, name in set(zip(left.column("entity").to_pylist() if told else (), left.column("name").to_pylist())):
            for form in {name, name.replace("-", " "), name.replace("-", ""), name.replace(" ", "-"), name.replace(" ", "")} - {""}:
                runs = [m.span() for m in re.finditer(r"\w+", form)]
                core = form[runs[0][0] : runs[-1][1]] if runs else ""
                test = None if core == form else re.compile(rf"(?<!\w){re.escape(form)}(?:s|es)?(?!\w)").search
                if not runs:
                    bare.append((whole, test))
                    continue
                lengths.add(len(runs))
                for end in ("", "s", "es") if runs[-1][1] == len(form) else ("",):
                    cores.setdefault(core + end, []).append((whole, test))
        for k, text in enumerate(told if cores or bare else ()):
            spans, met = [m.span() for m in re.finditer(r"\w+", text)], list(bare)
            for n in lengths:
                for (lo, _), (_, hi) in zip(spans, spans[n - 1 :]):
                    met += cores.get(text[lo:hi], ())
            for whole, test in met:
                if (whole, ids[k]) not in had and (test is None or test(text)):
                    had.add((whole, ids[k]))
                    entity.append(whole)
                    rows.append(k)
        found = right.select(["subject", "id"]).take(pa.array(rows, pa.int64()))
        return found.add_column(1, "entity", pa.array(entity, pa.string()))

    schema = f"subject string, entity string, id {placed.schema['id'].dataType.simpleString()}"
    return spread.toDF("own", "own_part", "entity", "name").groupBy("own", "own_part").cogroup(placed.groupBy("subject", "part")).applyInArrow(find, schema)


def event_chains(mentions: DataFrame, least_steps: int = 2, least_mentions: int = 2) -> DataFrame:
    """(subject, chain, step, day, start_ts, end_ts, days): what a name goes through from day to day.

    First each day by itself: a step is the stretch of a day in which a name is mentioned so often at least; a step without
    extent at 0 is none. Then over days: names that differ in case are one chain, under the spelling that comes first. Chains need
    ``least_steps`` steps. ``mentions`` has ``subject, name, start_ts, end_ts``.
    """
    daily = mentions.selectExpr("subject", "name", "start_ts DIV 86400 + 1 AS day", "start_ts", "end_ts").groupBy("subject", "name", "day").agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.count("*").alias("n"))
    steps = daily.where(f"n >= {least_mentions} AND NOT (start_ts = 0 AND end_ts = 0)")
    joined = steps.groupBy("subject", F.lower("name").alias("key"), "day").agg(F.min_by("name", F.struct("start_ts", "name")).alias("name"), F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"))
    spans = joined.groupBy("subject", "key").agg(F.count("*").alias("steps"), F.countDistinct("day").alias("days"), F.min_by("name", F.struct("start_ts", "name")).alias("chain")).where(f"steps >= {least_steps}")
    # a chain has at most one step a day
    numbered = joined.drop("name").join(spans.drop("steps"), ["subject", "key"]).selectExpr("*", "CAST(row_number() OVER (PARTITION BY subject, key ORDER BY start_ts) AS bigint) AS step")
    return numbered.select("subject", "chain", "step", "day", "start_ts", "end_ts", "days")


def in_steps(steps: DataFrame, points: DataFrame, bucket_s: int = 3600) -> DataFrame:
    """(subject, chain, step, id, t): points of time (subject, id, t) within steps, both ends included."""
    spread = steps.selectExpr("subject", "chain", "step", "start_ts", "end_ts", f"explode(sequence(start_ts DIV {bucket_s}, end_ts DIV {bucket_s})) AS b")
    return points.selectExpr("subject", "id", "t", f"t DIV {bucket_s} AS b").join(spread, ["subject", "b"]).where("t BETWEEN start_ts AND end_ts").select("subject", "chain", "step", "id", "t")


def inject(retrieved: DataFrame, queries: DataFrame, facts: DataFrame, *, least_hits: int = 2, most: int = 3, alike: float = 0.5, chars: int = 2000, encode=None) -> DataFrame:
    """(query, entity, tier, t, fact): facts of the topics that retrieved episodes mention, for each query.

    ``retrieved`` (query, subject, id, start_ts, text), ``queries`` (query, subject, text, until), ``facts`` (subject, entity, t, fact). A topic needs
    ``least_hits`` retrieved episodes. Those that the query names come first, the ``most`` with most hits; what room they leave goes to
    topics whose facts, joined in order of time up to so many characters, are as much ``alike`` the query. Facts after the query's time, or
    within a minute of a retrieved episode's start, are left out.
    """
    from tidemark.functions.models import STAND_INS
    from tidemark.functions.vectors import cosine
    from tidemark.operators.temporal import uncovered

    encode = encode or STAND_INS.encode_text
    topics = facts.select("subject", "entity").distinct()
    texts = retrieved.select("subject", "id", "text").dropDuplicates(["subject", "id"])
    hits = keyword_hits(topics, texts).join(retrieved.select("query", "subject", "id"), ["subject", "id"]).groupBy("query", "subject", "entity").agg(F.count("*").alias("n")).where(f"n >= {least_hits}")
    named = keyword_hits(topics, queries.selectExpr("subject", "query AS id", "text")).selectExpr("subject", "entity", "id AS query", "1 AS named")
    coarse = hits.join(named, ["query", "subject", "entity"], "left")
    first = coarse.where("named = 1").selectExpr("*", "row_number() OVER (PARTITION BY query ORDER BY n DESC, entity) AS k").where(f"k <= {most}").selectExpr("query", "subject", "entity", "1 AS tier")
    wanted = coarse.where("named IS NULL").select("query", "subject", "entity")
    pool = facts.join(wanted.select("subject", "entity").distinct(), ["subject", "entity"], "left_semi")
    told = pool.groupBy("subject", "entity").agg(F.expr("array_join(transform(array_sort(collect_list(struct(t, fact))), x -> x.fact), ' ')").alias("told"))
    coded = told.selectExpr("subject", "entity", f"{encode(f'substr(told, 1, {chars})')} AS v")
    asked = queries.selectExpr("query", f"{encode('text')} AS q")
    scored = wanted.join(coded, ["subject", "entity"]).join(asked, "query").selectExpr("query", "subject", "entity", f"round({cosine('q', 'v')}, 9) AS score").where(f"score >= {alike}")
    taken = first.groupBy("query").agg(F.count("*").alias("taken"))
    second = scored.selectExpr("*", "row_number() OVER (PARTITION BY query ORDER BY score DESC, entity) AS k").join(taken, "query", "left").where(f"k <= {most} - coalesce(taken, 0)").selectExpr("query", "subject", "entity", "2 AS tier")
    chosen = first.unionByName(second).join(queries.select("query", "until"), "query")
    seen = facts.join(chosen, ["subject", "entity"]).where("t <= until").selectExpr("struct(query, entity, tier, t, fact) AS fact", "CAST(query AS string) AS subject", "t").distinct()
    left = uncovered(seen, retrieved.selectExpr("CAST(query AS string) AS subject", "start_ts AS c"))
    return left.select("fact.*")


def consolidate(facts: DataFrame, by: list[str], *, most: int = 20, alike: float = 0.6, encode=None, replaces=None) -> DataFrame:
    """``facts`` (by, ts, idx, s, p, o) with ``gone``: the time of the update that removes each fact, or null if it stays.

    Updates of one time are decided against what earlier times left: of the facts of the same ``by`` the ``most`` similar ones that are ``alike``
    enough go to ``replaces(new, old)``, which says whether the new one takes the old one's place; the stand-in does so for the same subject and
    predicate. What holds at a time t is then ``ts <= t AND (gone IS NULL OR gone > t)``. Rows of a key are folded in one pass over
    sorted partitions; only what a key still holds stays in memory.
    """
    from tidemark.functions.models import STAND_INS

    encode = encode or STAND_INS.encode_text
    rule = replaces or (lambda new, old: new[0] == old[0] and new[1] == old[1])
    names = [*by, "ts", "idx", "s", "p", "o"]
    told = "concat_ws(' ', s, p, o)"
    rows = facts.selectExpr(*names, f"{encode(told)} AS v").repartition(*by).sortWithinPartitions(*by, "ts", "idx")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in facts.select(*names).schema) + ", gone bigint"

    def fold(batches):
        import numpy as np

        key, now, held, waiting, out = None, None, [], [], []

        def settle() -> None:
            """Decides the updates of one time."""
            nonlocal held, waiting
            if held and waiting:
                old, new = (np.array([x[1] for x in part]) for part in (held, waiting))
                norms = np.linalg.norm(new, axis=1)[:, None] * np.linalg.norm(old, axis=1)[None, :]
                score = np.round(np.divide(new @ old.T, norms, out=np.zeros_like(norms), where=norms > 0), 9)
                removed = set()
                for k, (row, _) in enumerate(waiting):
                    for i in np.argsort(-score[k], kind="stable")[:most]:
                        if score[k, i] >= alike and rule(row[-3:], held[i][0][-3:]):
                            removed.add(int(i))
                out.extend((*held[i][0], now) for i in removed)
                held = [x for i, x in enumerate(held) if i not in removed]
            held, waiting = held + waiting, []

        def batch_of():
            columns = list(zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[*names, "gone"])

        types = None
        for batch in batches:
            types = [batch.schema.field(n).type for n in names] + [pa.int64()]
            for row in zip(*(batch.column(i).to_pylist() for i in range(len(names) + 1))):
                k, ts = row[: len(by)], row[len(by)]
                if k != key or ts != now:
                    settle()
                    if k != key:
                        out.extend((*x[0], None) for x in held)
                        held = []
                    key, now = k, ts
                waiting.append((row[:-1], row[-1]))
            if len(out) >= 4096:
                yield batch_of()
                out.clear()
        if types:
            settle()
            out.extend((*x[0], None) for x in held)
        if out:
            yield batch_of()

    return rows.mapInArrow(fold, schema)
