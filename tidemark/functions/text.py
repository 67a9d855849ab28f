"""Text functions as SQL text, which reaches the JVM in one call."""

from __future__ import annotations

# Names by which a person speaks of themselves.
SELF = ("I", "i", "me", "Me", "my", "My")
# Marks and what they become; controls and the soft hyphen go.
CONTROLS = "".join(chr(c) for c in [*range(1, 9), *range(14, 32), *range(127, 133), *range(134, 160)])
BLANKS = "\u000b\u000c\u0085"
HYPHENS = "\u2010\u2011\u2012\u2013\u2014\u2015\u2043\u2212\uff0d\u207b"
DOUBLE_QUOTES, SINGLE_QUOTES = "\u201c\u201d\u201e\u201f", "\u2018\u2019\u201a\u201b\u055a\ua78b\ua78c\uff07\u0060\u00b4"
SLASHES = "\u2044\u2215"
PRIMES = {"\u2032": 1, "\u2035": 1, "\u2033": 2, "\u2036": 2, "\u2034": 3, "\u2037": 3, "\u2057": 4}
#: Characters that become one character each, in order, and those that become several or none.
ONE_TO_ONE = {**dict.fromkeys(BLANKS, " "), **dict.fromkeys(HYPHENS, "-"), **dict.fromkeys(DOUBLE_QUOTES, '"'), **dict.fromkeys(SINGLE_QUOTES, "'"), **dict.fromkeys(SLASHES, "/"), **{k: "'" for k, n in PRIMES.items() if n == 1}}
SEVERAL = [*((k, "'" * n) for k, n in PRIMES.items() if n > 1), ("\u2026", "..."), (" . . . ", " ... ")]
GONE = CONTROLS + "\u00ad"
# Phrases around the letter of a chosen option, tried in this order.
LETTER_PHRASES = (r'"answer"\s*:\s*"([A-D])"', r"(?:the\s+)?answer\s+is\s*:?\s*\(?([A-D])\)?", r"(?:final\s+)?answer\s*:\s*\(?([A-D])\)?", r"(?:I\s+(?:would\s+)?(?:choose|pick|select|go\s+with))\s+\(?([A-D])\)?")
LETTER_IS = r"([A-D])\s+is\s+(?:the\s+)?(?:correct|best|most\s+supported)"


def quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def entity_key(name: str, person: str) -> str:
    """Normal form of an entity's name; a person's words for themselves become the person."""
    own = ", ".join(quoted(x) for x in SELF)
    return f"CASE WHEN {name} IN ({own}) THEN translate(lower({person}), '/-', '__') ELSE replace(translate(lower({name}), ' -', '__'), '\\'', '') END"


def plain_words(text: str) -> str:
    """Lower case, everything but letters, digits and spaces of ASCII as a space, ends trimmed."""
    return f"trim(regexp_replace(lower({text}), '[^a-z0-9 ]', ' '))"


def answer_form(text: str) -> str:
    """Lower case without punctuation, articles and superfluous blanks."""
    bare = f"regexp_replace(lower({text}), '[!-/:-@\\\\[-`{{-~]', '')"
    return f"trim(regexp_replace(regexp_replace({bare}, '(?<![\\\\p{{L}}\\\\p{{N}}_])(a|an|the)(?![\\\\p{{L}}\\\\p{{N}}_])', ' '), '\\\\s+', ' '))"


def plain_punctuation(text: str) -> str:
    """Hyphens, quotes, primes, ellipses and slashes of all kinds as plain ones, without controls."""
    out = f"translate({text}, {quoted(''.join(ONE_TO_ONE) + GONE)}, {quoted(''.join(ONE_TO_ONE.values()))})"
    for k, v in SEVERAL:
        out = f"replace({out}, {quoted(k)}, {quoted(v)})"
    return out


#: No letter, digit or underscore before, and none after.
_OPEN, _SHUT = "(?<![\\p{L}\\p{N}_])", "(?![\\p{L}\\p{N}_])"


def choice_letter(text: str) -> str:
    """The option letter of a response: alone, in front, after or before a phrase, or the last one that begins in its last fifth."""
    t = f"regexp_replace({text}, '^\\\\s+|\\\\s+\\\\z', '')"
    first = lambda pattern: f"nullif(upper(regexp_extract({t}, {quoted(pattern)}, 1)), '')"
    at = f"CAST(floor(length({t}) * 0.8D) AS int)"
    # what stands before the last fifth only matters as a border of words
    tail = f"concat(CASE WHEN substr({t}, {at}, 1) RLIKE '[\\\\p{{L}}\\\\p{{N}}_]' AND {at} > 0 THEN '_' ELSE ' ' END, substr({t}, {at} + 1))"
    tries = [first(r"^\(?([A-Da-d])(?:[.):,]|\s|\z)"), *(first(f"(?i){p}") for p in LETTER_PHRASES), first(f"(?i){_OPEN}{LETTER_IS}{_SHUT}"), f"nullif(upper(try_element_at(regexp_extract_all({tail}, {quoted(_OPEN + '([A-Da-d])' + _SHUT)}, 1), -1)), '')"]
    return f"coalesce({', '.join(tries)})"


def answer_norm(text: str) -> str:
    """Lower case, without blanks at the ends and without full stops, commas and brackets at the right."""
    return f"regexp_replace(regexp_replace(lower({text}), '^\\\\s+|\\\\s+\\\\z', ''), '[.,)]+\\\\z', '')"


def is_right(prediction: str, letter: str, choice: str) -> str:
    """Whether a prediction gives the gold option: by its text, by its letter or by both."""
    p = answer_norm(prediction)
    both = ", ".join(answer_norm(f"concat({a}, {letter}, {b}, {choice})") for a, b in (("''", "'. '"), ("'('", "') '")))
    return f"coalesce({p} IN ({answer_norm(choice)}, {both}) OR {choice_letter(prediction)} = {letter}, false)"


def judge_score(text: str) -> str:
    """The score that a judge states: after 'Final Score', else the last digit from 0 to 5."""
    return f"coalesce(nullif(regexp_extract({text}, '(?i)Final Score\\\\s*[:=]\\\\s*([0-9])', 1), ''), try_element_at(regexp_extract_all({text}, '[0-5]', 0), -1))"


def smooth_score(score: str) -> str:
    return f"CASE WHEN {score} <= 2 THEN 0D WHEN {score} = 3 THEN 0.5D WHEN {score} >= 4 THEN 1D END"


def sentences(text: str) -> str:
    """Pieces after a full stop, question or exclamation mark, without blank ones."""
    return f"filter(split({text}, '(?<=[.!?])\\\\s*'), s -> trim(s) <> '')"
