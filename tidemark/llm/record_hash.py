"""Collapsing records that differ only in formatting, by hashing nested records from the leaves up.

A leaf is its text in one letter case without anything but letters and digits. An ordered node hashes its
children's digests in order, an unordered one the sorted set of them; records with the same root digest are
grouped, and a full comparison of the canonical structures confirms each group. Everything runs in the JVM.
Records are read, normalised and hashed once; after that ids and digests move, and structures only as the two
extremes of each group, which combine before they move.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.runtime import cut

RECORD = "struct<named_entities: array<string>, triples: array<array<string>>, broken: string>"
# letters change case more than one to one: upper case first joins forms such as a long s or a final sigma
LEAF = "regexp_replace(replace(lower(upper({x})), 'ς', 'σ'), '[^\\\\p{{L}}\\\\p{{N}}]', '')"


def readable_records(raw: DataFrame) -> DataFrame:
    """(resp_id, entities, triples) of readable records that have an entity or a triple.

    Where both arrays are null the record is read from ``raw_output``; broken JSON, or JSON that is no such object,
    is unreadable.
    """
    parsed = raw.selectExpr("resp_id", "named_entities", "triples", f"CASE WHEN named_entities IS NULL AND triples IS NULL THEN from_json(raw_output, '{RECORD}', map('columnNameOfCorruptRecord', 'broken')) END AS r")
    read = parsed.selectExpr("resp_id", "CASE WHEN r.broken IS NULL THEN coalesce(named_entities, r.named_entities) END AS entities", "CASE WHEN r.broken IS NULL THEN coalesce(triples, r.triples) END AS triples")
    return read.where("resp_id IS NOT NULL AND (size(entities) > 0 OR size(triples) > 0)")


def record_digests(records: DataFrame) -> DataFrame:
    """Adds ``root`` (digest) and ``shape`` (canonical structure as text) to (resp_id, entities, triples)."""
    leaf = lambda x: LEAF.format(x=x)
    canon = records.selectExpr(
        "resp_id",
        f"array_sort(array_distinct(transform(filter(coalesce(entities, array()), e -> e IS NOT NULL), e -> {leaf('e')}))) AS entities",
        f"array_sort(array_distinct(transform(filter(coalesce(triples, array()), t -> t IS NOT NULL), t -> transform(t, x -> {leaf('coalesce(x, chr(0))')})))) AS triples",
    )
    digest = "array_join(array_sort(transform({xs}, x -> {of})), '')"
    entities = digest.format(xs="entities", of="md5(x)")
    triples = digest.format(xs="triples", of="md5(array_join(transform(x, y -> md5(y)), ''))")
    return canon.selectExpr("resp_id", f"unhex(md5(concat(md5({entities}), md5({triples})))) AS root", "to_json(struct(entities, triples)) AS shape")


def collapse_records(records: DataFrame) -> DataFrame:
    """(resp_id, keep_id) for every record; ``keep_id`` is the smallest id of its group.

    Defined cases: repeats of a row count once; null list members are ignored, a null inside a triple is an
    empty leaf; a leaf of punctuation only is the empty leaf; order and repeats in the lists do not matter, order
    in a triple does; an empty table gives an empty result; other columns do not matter.
    """
    made = cut(record_digests(records).withColumn("shape", F.encode("shape", "utf-8")))
    # groups by digest; all structures of a group are one if its smallest and its largest are
    groups = cut(made.groupBy("root").agg(F.min("resp_id").alias("keep_id"), F.min("shape").alias("low"), F.max("shape").alias("high")).selectExpr("root", "keep_id", "low <> high AS mixed"))
    placed = made.select("root", "resp_id").distinct().join(groups, "root")
    if not groups.where("mixed").head(1):
        return placed.select("resp_id", "keep_id")
    # different structures under one digest: these groups are made by structure
    mixed = made.join(groups.where("mixed").select("root"), "root", "left_semi")
    apart = mixed.join(mixed.groupBy("root", "shape").agg(F.min("resp_id").alias("keep_id")), ["root", "shape"]).select("resp_id", "keep_id").distinct()
    return placed.where("NOT mixed").select("resp_id", "keep_id").unionByName(apart)
