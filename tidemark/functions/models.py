"""Model functions as replaceable parts: encoders, extraction, decisions.

Each is a function from SQL text to SQL text. The ones here are deterministic stand-ins that need no model; a model of
one's own is a pandas function that ``plug`` registers, loaded once in each Python worker and fed with Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

Expr = Callable[[str], str]


def hashed_words(size: int) -> Expr:
    """Words of a text, hashed with a sign into so many numbers."""

    def encode(text: str) -> str:
        codes = f"transform(filter(split(lower(coalesce({text}, '')), '\\\\s+'), w -> w <> ''), w -> CAST(conv(substr(md5(w), 1, 4), 16, 10) AS int))"
        # the codes are bound once, then counted for each number
        return f"element_at(transform(array({codes}), cs -> transform(sequence(0, {size - 1}), i -> CAST(size(filter(cs, c -> c % {2 * size} = 2 * i)) - size(filter(cs, c -> c % {2 * size} = 2 * i + 1)) AS double))), 1)"

    return encode


def capitalised(text: str) -> str:
    """Capitalised words as names, each time they occur."""
    return f"regexp_extract_all({text}, '([A-Z][a-z]{{2,}})', 1)"


def simple_triples(text: str) -> str:
    """Subject, verb and object of clauses like 'Ann moves the red box'."""
    part = lambda k: f"regexp_extract_all({text}, '([A-Z][a-z]+) ([a-z]+s) the ([a-z]+ [a-z]+)', {k})"
    return f"transform(arrays_zip({part(1)}, {part(2)}, {part(3)}), x -> array(x['0'], x['1'], x['2']))"


@dataclass(frozen=True)
class Models:
    encode_text: Expr = hashed_words(16)
    encode_visual_query: Expr = hashed_words(64)
    name_entities: Expr = capitalised
    find_triples: Expr = simple_triples


STAND_INS = Models()


def plug(spark: SparkSession, models: Models, part: str, load: Callable[[], Callable[[pd.Series], pd.Series]], returns: str) -> Models:
    """``models`` with one part taken by a pandas function; ``load`` runs once in each worker and gives the function."""

    @F.pandas_udf(returns)
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = load()
        for texts in batches:
            yield run(texts)

    name = f"tidemark_{part}"
    spark.udf.register(name, call)
    return replace(models, **{part: lambda text: f"{name}({text})"})
