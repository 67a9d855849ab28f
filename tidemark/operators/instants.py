"""Mixed timestamp spellings and zones, normalised to Unix seconds.

Every stamp is read under every spelling that it fits; each valid reading is a candidate instant. Where
the candidates of a stamp differ, a mixture over spellings, fitted for each source by expectation
maximisation, gives each of them a posterior: one that reaches the cutoff is chosen, otherwise the stamp is
reported as ``ambiguous``. Only counts by source and by set of valid spellings go into the fit, so its
input does not grow with the rows. All parsing and zone arithmetic stays in the JVM.
"""

from __future__ import annotations

from zoneinfo import available_timezones

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.clock import civil_days_sql, is_date_sql
from tidemark.runtime import cut

# Zone abbreviations with their offset in minutes.
ZONE_ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0,
    "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "NST": -210, "NDT": -150, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
    "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "LHST": 630, "LHDT": 660,
}
# English month names.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

SEP = "\u0001"
#: One pass of one pattern gives every field; groups that took no part are empty.
CALENDAR = (
    r"(?i)^(?:(\d{4})-(\d{1,2})-(\d{1,2})|(\d{4})(\d{2})(\d{2})|(\d{1,2})\.(\d{1,2})\.(\d{4})|(\d{1,2})/(\d{1,2})/(\d{4})"
    r"|(?:[a-z]{3,9}\.?, ?)?(\d{1,2}) ([a-z]{3})[a-z]*\.? (\d{4}),?)"
    r"(?:t| |(?<=\d{8}))(?:(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?|(\d{2})(\d{2})(\d{2})(?:[.,]\d+)?)"
    r"(?: ?([ap])\.?m\.?)?"
    r"(?: ?(?:([a-z]{1,5})|(?:utc|gmt)?([+-])(\d{2})(?::?(\d{2}))?))?(?: ?\[([a-z0-9_+/-]+)\])?\z"
)
GROUPS = "y1 m1 d1 y2 m2 d2 d3 m3 y3 a4 b4 y4 d5 m5 y5 h1 n1 s1 h2 n2 s2 half abbr sign oh om zone".split()
DAY_CLOCK = r"(?i)^(?:day0*(\d{1,6}) (\d{1,8})|(\d)(\d{8}))\z"
UNIX = r"^(?:(\d{10})(?:[.,]\d+)?|(\d{13})|(\d{16}))\z"
BLANKS = r"[\s\u0085   -​    　﻿]+"


def _groups(pattern: str, n: int) -> str:
    """All groups of the pattern as one array; an array of one member without a match. The text must not hold ``SEP``."""
    quoted, sep = pattern.replace("\\", "\\\\"), "\\\\u0001"
    return f"split(regexp_replace(__text, '{quoted}', '{SEP.join(f'${i + 1}' for i in range(n))}'), '{sep}', -1)"


def known_zones(spark: SparkSession) -> list[str]:
    """Names that both this Python and the JVM can resolve."""
    mine = available_timezones()
    try:
        return sorted(mine & set(spark._jvm.java.time.ZoneId.getAvailableZoneIds()))
    except AttributeError:
        return sorted(mine)


def wall_to_instant(df: DataFrame, walls: dict[str, tuple[str, str]]) -> DataFrame:
    """Adds for each name the one instant at which clocks of a zone show a wall time; NULL for none or two.

    ``walls``: name -> (column of wall seconds since 1970-01-01 00:00, column of zone names). Zone offsets of a
    day before and a day after are the only ones that can hold. Each step is a projection of its own, so that
    no expression is written out twice.
    """
    shown = lambda u, zone: f"unix_seconds(from_utc_timestamp(timestamp_seconds({u}), {zone}))"
    every = [(n, side, shift) for n in walls for side, shift in (("early", -86400), ("late", 86400))]
    df = df.selectExpr("*", *(f"2 * {walls[n][0]} + {shift} - {shown(f'{walls[n][0]} + {shift}', walls[n][1])} AS __{n}_{side}" for n, side, shift in every))
    df = df.selectExpr("*", *(f"{shown(f'__{n}_{side}', walls[n][1])} = {walls[n][0]} AS __{n}_{side}_ok" for n, side, _ in every))
    df = df.selectExpr("*", *(f"CASE WHEN __{n}_early_ok AND __{n}_late_ok AND __{n}_early <> __{n}_late THEN NULL WHEN __{n}_early_ok THEN __{n}_early WHEN __{n}_late_ok THEN __{n}_late END AS {n}" for n in walls))
    return df.drop(*[f"__{n}_{side}{x}" for n, side, _ in every for x in ("", "_ok")])


def readings(stamps: DataFrame, zones: list[str]) -> DataFrame:
    """Adds ``candidates``: (spelling, utc_s or NULL, why) for every spelling that the stamp fits.

    Takes the columns ``__text``, ``__zone``, ``__order``, ``__day1``. The expressions are SQL text, which reaches
    the JVM in one call each.
    """
    kept = stamps.columns
    g = lambda name: f"get(g, {GROUPS.index(name)})"
    at = lambda *names: "coalesce(" + ", ".join(f"try_cast({g(n)} AS int)" for n in names) + ")"
    # one pattern after the other, each only where those before it do not fit
    none = "CAST(array() AS array<string>)"
    df = stamps.withColumn("__text", F.translate("__text", SEP, "?"))
    df = df.selectExpr("*", f"CASE WHEN __text RLIKE '^[0-9]+([.,][0-9]+)?$' THEN {_groups(UNIX, 3)} ELSE {none} END AS u").selectExpr("*", f"CASE WHEN size(u) > 1 THEN {none} ELSE {_groups(CALENDAR, len(GROUPS))} END AS g")
    df = df.selectExpr("*", f"CASE WHEN size(u) > 1 OR size(g) > 1 THEN {none} ELSE {_groups(DAY_CLOCK, 4)} END AS h")
    df = df.selectExpr(*kept, *(f"CASE WHEN size({x}) > 1 THEN {x} END AS {x}" for x in "ugh"))
    months = ", ".join(f"'{m}'" for m in MONTHS)
    abbreviations = ", ".join(f"'{k}', {v}" for k, v in ZONE_ABBREVIATIONS.items())
    listed = ", ".join(f"'{z}'" for z in zones)
    df = df.selectExpr(
        *kept, "g", "u", f"{at('h1', 'h2')} AS hour", f"{at('n1', 'n2')} AS minute", f"coalesce({at('s1', 's2')}, 0) AS second", f"lower({g('half')}) AS half",
        f"upper({g('abbr')}) AS abbr", f"{g('sign')} AS sign", f"{at('oh')} AS oh", f"coalesce({at('om')}, 0) AS om", f"{g('zone')} AS bracket",
        f"{at('y1', 'y2', 'y3', 'y4', 'y5')} AS y", f"CASE WHEN {g('y4')} <> '' THEN {at('a4')} WHEN {g('y5')} <> '' THEN nullif(array_position(array({months}), lower({g('m5')})), 0) ELSE {at('m1', 'm2', 'm3')} END AS m",
        f"CASE WHEN {g('y4')} <> '' THEN {at('b4')} ELSE {at('d1', 'd2', 'd3', 'd5')} END AS d",
        f"CASE WHEN {g('y1')} <> '' THEN 'ymd_dash' WHEN {g('y2')} <> '' THEN 'ymd_compact' WHEN {g('y3')} <> '' THEN 'dmy_dot' WHEN {g('y4')} <> '' THEN 'slash' WHEN {g('y5')} <> '' THEN 'dmy_named' END AS form",
        "coalesce(try_cast(get(h, 0) AS int), try_cast(get(h, 2) AS int)) AS n", "lpad(CASE WHEN get(h, 1) <> '' THEN get(h, 1) ELSE get(h, 3) END, 8, '0') AS t",
    )
    df = df.selectExpr(
        *(c for c in kept if c != "__zone"), "y", "m", "d", "form", "n", "g IS NOT NULL AS calendar", "sign <> '' OR abbr <> '' AS has_offset", "bracket <> '' AS has_bracket",
        f"CASE WHEN bracket IN ({listed}) THEN bracket END AS own_zone", f"CASE WHEN __zone IN ({listed}) THEN __zone END AS __zone",
        "CASE WHEN half = '' THEN hour WHEN hour BETWEEN 1 AND 12 THEN hour % 12 + CASE WHEN half = 'p' THEN 12 ELSE 0 END END AS hour", "minute", "second",
        f"CASE WHEN sign <> '' THEN CASE WHEN oh <= 18 AND om < 60 THEN (oh * 60 + om) * CASE WHEN sign = '-' THEN -1 ELSE 1 END END WHEN abbr <> '' THEN try_element_at(map({abbreviations}), abbr) END AS minutes",
        "coalesce(try_cast(get(u, 0) AS bigint), try_cast(get(u, 1) AS bigint) div 1000, try_cast(get(u, 2) AS bigint) div 1000000) AS unix_s",
        "try_cast(substr(t, 1, 2) AS int) AS th", "try_cast(substr(t, 3, 2) AS int) AS tm", "try_cast(substr(t, 5, 2) AS int) AS ts",
    )
    clock = "CASE WHEN hour < 24 AND minute < 60 AND second < 60 THEN hour * 3600 + minute * 60 + second END"

    def wall(m: str, d: str) -> str:
        return f"CASE WHEN {is_date_sql('y', m, d)} THEN {civil_days_sql('y', m, d)} * 86400 + {clock} END"

    # a stamp has at most two readings: both orders of a date with slashes
    df = df.selectExpr(
        "*", f"CASE WHEN form = 'slash' THEN CASE WHEN __order <=> 'dmy' THEN NULL ELSE {wall('m', 'd')} END ELSE {wall('m', 'd')} END AS v1",
        f"CASE WHEN form = 'slash' AND NOT __order <=> 'mdy' THEN {wall('d', 'm')} END AS v2",
        "CASE WHEN n >= 1 AND th < 24 AND tm < 60 AND ts < 60 THEN (unix_date(__day1) + n - 1) * 86400L + th * 3600 + tm * 60 + ts END AS day_wall",
    )
    df = df.selectExpr(
        *(c for c in kept if c != "__zone"), "calendar", "form", "has_offset", "minutes", "unix_s", "n", "v2", "coalesce(v1, day_wall) AS v1", "coalesce(__order, '') AS o",
        "CASE WHEN n IS NOT NULL THEN __zone WHEN calendar AND NOT has_offset THEN CASE WHEN has_bracket THEN own_zone ELSE __zone END END AS z",
    )
    df = wall_to_instant(df, {"i1": ("v1", "z"), "i2": ("v2", "z")})
    utc = lambda k: f"CASE WHEN has_offset THEN v{k} - minutes * 60 ELSE i{k} END"
    why = lambda k: f"CASE WHEN v{k} IS NULL THEN 'no such date or time' WHEN (has_offset AND minutes IS NULL) OR (NOT coalesce(has_offset, false) AND z IS NULL) THEN 'no known zone' ELSE 'wall time twice or never' END"
    made = lambda name, u, w: f"named_struct('spelling', {name}, 'utc_s', CAST({u} AS bigint), 'why', {w})"
    candidates = (
        f"CASE WHEN unix_s IS NOT NULL THEN array({made(repr('unix'), 'unix_s', repr('fixed'))}) WHEN n IS NOT NULL THEN array({made(repr('day_clock'), 'i1', why(1))})"
        f" WHEN form = 'slash' AND o = 'mdy' THEN array({made(repr('mdy_slash'), utc(1), why(1))}) WHEN form = 'slash' AND o = 'dmy' THEN array({made(repr('dmy_slash'), utc(2), why(2))})"
        f" WHEN form = 'slash' THEN array({made(repr('mdy_slash'), utc(1), why(1))}, {made(repr('dmy_slash'), utc(2), why(2))}) WHEN calendar THEN array({made('form', utc(1), why(1))}) ELSE array() END AS candidates"
    )
    return df.selectExpr(*(c for c in kept if c not in ("__zone", "__order", "__day1")), candidates)


def fit_mixtures(counts: DataFrame, rounds: int = 50, pseudo: float = 0.5) -> DataFrame:
    """Spelling weights of each source by expectation maximisation, one weight per (``__source``, spelling).

    ``counts`` has ``__source``, ``spellings`` (the sorted set of valid readings) and ``n``. ``pseudo`` is the
    Dirichlet prior: a source that never shows which spelling it uses keeps equal weights.
    """

    def fit(table: pa.Table) -> pa.Table:
        rows = table.column("spellings").to_pylist()
        names = sorted({s for row in rows for s in row})
        fits = np.array([[s in set(row) for s in names] for row in rows], float).reshape(len(rows), len(names))
        n = table.column("n").to_numpy().astype(float)
        weight = np.full(len(names), 1 / max(1, len(names)))
        for _ in range(rounds if names else 0):
            share = fits * weight
            share /= np.maximum(share.sum(1, keepdims=True), 1e-300)
            new = n @ share + pseudo
            weight = new / new.sum()
        source = table.column("__source")[0].as_py()
        return pa.table({"__source": pa.array([source] * len(names), pa.string()), "spelling": pa.array(names, pa.string()), "weight": pa.array(weight, pa.float64())})

    return counts.groupBy("__source").applyInArrow(fit, "__source string, spelling string, weight double")


def resolve_instants(log: DataFrame, devices: DataFrame, *, row_id: str, source: str, date: Column, time: Column, cutoff: float = 0.95) -> DataFrame:
    """One row for each distinct (``row_id``, stamp): ``row_id``, ``utc_s``, ``status``, ``spelling``, ``posterior``.

    ``devices`` has ``device_id, zone, date_order, day1_date``; a source that it lacks has no known zone and no
    known order. ``status`` is ``fixed``, ``ambiguous`` (readings differ and none reaches ``cutoff``),
    ``unreadable``, ``no such date or time``, ``no known zone`` or ``wall time twice or never``; ``utc_s`` is NULL
    unless ``fixed``. Declared orders are structural zeros of the mixture: the other order is no reading.

    Defined cases: a null or blank date leaves the stamp in ``time``; a null or blank stamp is unreadable; a null
    source is a source without zone; rows delivered twice give one row; two different stamps under one id give
    two; an empty log gives an empty result; other columns do not matter.
    """
    spark = log.sparkSession
    squeeze = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), BLANKS, " "))
    stamps = log.select(F.col(f"`{row_id}`").alias("__id"), F.col(f"`{source}`").alias("__source"), squeeze(date).alias("d"), squeeze(time).alias("t"))
    stamps = stamps.select("__id", "__source", F.trim(F.concat_ws(" ", F.when(F.col("d") != "", F.col("d")), F.when(F.col("t") != "", F.col("t")))).alias("__text"), ((F.col("t") != "")).alias("timed")).distinct()
    stamps = stamps.withColumn("__text", F.when(F.col("timed"), F.col("__text")).otherwise("")).drop("timed")
    # one row per device, whatever the table holds
    order = F.lower(F.col("date_order"))
    known = devices.groupBy(F.col("device_id").alias("__device")).agg(F.min("zone").alias("__zone"), F.min(F.when(order.isin("dmy", "mdy"), order)).alias("__order"), F.min("day1_date").alias("__day1"))
    joined = stamps.join(known, F.col("__source") == F.col("__device"), "left").drop("__device")
    read = readings(joined, known_zones(spark)).select("__id", "__source", "__text", "candidates")
    read = read.selectExpr("*", "filter(candidates, x -> x.utc_s IS NOT NULL) AS valid")
    # read once: the few fields of the result are written, and the counts and the result both start from them
    read = cut(read.selectExpr("__id", "__source", "get(candidates, 0).why AS why", "size(valid) AS n", "get(valid, 0).utc_s AS u1", "get(valid, 1).utc_s AS u2", "get(valid, 0).spelling AS s1", "get(valid, 1).spelling AS s2"))
    counts = read.groupBy("__source", "s1", "s2").agg(F.count("*").alias("n")).selectExpr("__source", "array_sort(array_distinct(filter(array(s1, s2), s -> s IS NOT NULL))) AS spellings", "n")
    weights = fit_mixtures(counts).groupBy("__source").agg(F.map_from_entries(F.collect_list(F.struct("spelling", "weight"))).alias("weights"))
    posed = read.join(weights, "__source", "left")
    # at most two readings are valid; equal instants are one
    posed = posed.selectExpr(
        "__id", "why", "n", "u1", "u2", "s1", "s2", "coalesce(try_element_at(weights, s1), 0D) AS w1", "coalesce(try_element_at(weights, s2), 0D) AS w2",
    )
    posed = posed.selectExpr("*", "n = 1 OR coalesce(u1 = u2, false) AS one", "w1 >= w2 AS first")
    posed = posed.selectExpr(
        "__id", "why", "n", "CASE WHEN one THEN 1D WHEN n > 1 AND w1 + w2 > 0 THEN greatest(w1, w2) / (w1 + w2) END AS posterior",
        "CASE WHEN one OR first THEN u1 ELSE u2 END AS chosen", "CASE WHEN one OR first THEN s1 ELSE s2 END AS spelling",
    )
    sure = f"posterior >= {cutoff}"
    return posed.selectExpr(
        f"__id AS `{row_id}`", f"CASE WHEN {sure} THEN chosen END AS utc_s", f"CASE WHEN {sure} THEN 'fixed' WHEN n > 1 THEN 'ambiguous' WHEN why IS NULL THEN 'unreadable' ELSE why END AS status",
        "spelling", "round(posterior, 6) AS posterior",
    )
