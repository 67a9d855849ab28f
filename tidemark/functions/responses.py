"""Reading what models return: JSON within text, broken JSON, sections, choices of ids."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_FENCE = re.compile(r"```(?:json)?|<think>.*?</think>", re.S)


def first_json(text: str | None) -> str | None:
    """The first balanced object or list in a text, without fences and thoughts; unbalanced ones are closed."""
    if text is None:
        return None
    text = _FENCE.sub("", text)
    start = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=-1)
    if start < 0:
        return None
    stack, quoted, escaped = [], False, False
    for k in range(start, len(text)):
        ch = text[k]
        if quoted:
            escaped, quoted = (not escaped and ch == "\\"), quoted and (escaped or ch != '"')
        elif ch == '"':
            quoted = True
        elif ch in "{[":
            stack.append("}" if ch == "{" else "]")
        elif ch in "}]":
            if not stack or stack.pop() != ch:
                return None
            if not stack:
                return text[start : k + 1]
    return closed(text[start:], stack, quoted)


def closed(text: str, stack: list[str], quoted: bool) -> str | None:
    """A cut-off JSON text with its open ends closed, dropping the last member where that is needed."""
    body = text + ('"' if quoted else "")
    for _ in range(4):
        made = re.sub(r"[,:\s]+$", "", body) + "".join(reversed(stack))
        try:
            json.loads(made)
            return made
        except ValueError:
            cut = body.rfind(",")
            if cut < 0:
                return None
            body = body[:cut]
            stack = _open(body)
    return None


def _open(text: str) -> list[str]:
    stack, quoted, escaped = [], False, False
    for ch in text:
        if quoted:
            escaped, quoted = (not escaped and ch == "\\"), quoted and (escaped or ch != '"')
        elif ch == '"':
            quoted = True
        elif ch in "{[":
            stack.append("}" if ch == "{" else "]")
        elif ch in "}]" and stack:
            stack.pop()
    return stack


@F.pandas_udf(StringType())
def recover_json(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield pd.Series([first_json(t) for t in s.astype(object).where(s.notna(), None)], dtype=object)


def section(text: str, name: str) -> str:
    """The part of a response below the mark ``[[ ## name ## ]]``, up to the next mark (SQL text)."""
    return f"nullif(trim(regexp_extract({text}, '(?s)\\\\[\\\\[ ## {name} ## \\\\]\\\\](.*?)(?=\\\\[\\\\[ ## |\\\\z)', 1)), '')"


def chosen_ids(text: str, valid: str) -> str:
    """Ids of the first JSON list in a response that are valid; without such a list, valid ids that the text names."""
    listed = f"from_json(regexp_extract({text}, '(?s)(\\\\[.*?\\\\])', 1), 'array<string>')"
    return f"CASE WHEN size(array_intersect({listed}, {valid})) > 0 THEN array_intersect({listed}, {valid}) ELSE filter({valid}, x -> contains({text}, x)) END"


def decision(text: str) -> str:
    """(decision, content) of a response with a JSON object; anything else is an answer (SQL text, a struct)."""
    parsed = f"from_json(regexp_extract({text}, '(?s)([{{].*[}}])', 1), 'decision string, content string')"
    return f"named_struct('decision', coalesce({parsed}.decision, 'answer'), 'content', coalesce({parsed}.content, {text}))"


def evidence(text: str) -> str:
    """(status, information) of a response that offers evidence or does not (SQL text, a struct)."""
    found = f"nullif(trim(regexp_extract({text}, 'I can provide evidence[.] Evidence: (.+)', 1)), '')"
    ok = f"(NOT contains({text}, 'I can\\'t provide evidence.') AND {found} IS NOT NULL)"
    return f"named_struct('status', {ok}, 'information', CASE WHEN {ok} THEN {found} END)"


def merged_text(seen: str, said: str, both: str | None = None) -> str:
    """Text of a segment from what is seen and what is said; ``both`` is a model's merger, without which the speech stands in brackets behind."""
    a, b = f"trim(coalesce({seen}, ''))", f"trim(coalesce({said}, ''))"
    joined = f"coalesce(nullif(trim({both}), ''), {a})" if both else f"concat({a}, ' [Speech: ', {b}, ']')"
    return f"CASE WHEN {b} = '' THEN {a} WHEN {a} = '' THEN concat('[Speech] ', {b}) ELSE {joined} END"


@F.pandas_udf(StringType())
def closest(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Of a list of texts the one most like a text, by matching blocks; the first of equals, null for an empty list."""
    import difflib

    for asked, options in batches:
        yield pd.Series([(difflib.get_close_matches(a, list(o), n=1, cutoff=0.0) or [None])[0] if a is not None and o is not None and len(o) else None for a, o in zip(asked, options)], dtype=object)
