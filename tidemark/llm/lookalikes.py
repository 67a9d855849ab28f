"""One form for texts that look the same although their characters differ.

A character is unstable if its canonical form differs from it or if it may combine with its neighbours (the
normalisation quick check says No or Maybe). Only runs of unstable characters, with the character before them
as boundary context, are normalised; the results are spliced into the text, the rest of which stays as it is.
A text of stable characters only costs one scan.

The form to compare: invisible characters go; every blank is a space and every line end a line feed; wide, narrow and
ligature forms, and letters and marks of other alphabets with the shape of a Latin one, become the plain
character; accents are composed. Letter case, digits, accents and other marks stay. Texts that look the same are the same in
this form, which therefore mixes alphabets and is no text to read. The form to read does all that but
keeps the alphabet of each word, and punctuation of full width.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.runtime import cut

# Characters of other alphabets, in the order of their code points, and the ones they look like.
SAME_SHAPE = {
    "ɑ": "a", "ɡ": "g", "ǀ": "|", "ǃ": "!",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ν": "v", "ο": "o", "ρ": "p", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J",
    "Ѕ": "S", "І": "I", "Ј": "J", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "Ү": "Y", "һ": "h", "Ӏ": "I", "ӏ": "l", "Ԁ": "D", "ԁ": "d", "Ԍ": "G", "ԛ": "q", "Ԛ": "Q", "ԝ": "w", "Ԝ": "W",
    "Օ": "O", "հ": "h", "ո": "n", "ս": "u", "օ": "o", "։": ":", "׃": ":",
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K",
    "‐": "-", "․": ".", "⁄": "/", "∕": "/", "∗": "*", "∣": "|", "∶": ":",
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
}
LINE_ENDS = "\n\u0085  \u000b\u000c"
#: Fillers and joiners that do not show.
HIDDEN = "\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0"
#: Compatibility forms that differ in width or font only.
WIDTHS = ("<wide>", "<narrow>", "<noBreak>", "<font>")
# Scripts in which no character is unstable: ideographs and Hangul syllables.
STABLE_BLOCKS = [(0x3400, 0x9FFF), (0xAC00, 0xD7A3), (0xD800, 0xF8FF), (0x20000, 0x2F7FF), (0x30000, 0xDFFFF), (0xE1000, 0x10FFFF)]


@cache
def _second_parts() -> frozenset[str]:
    """Second characters of canonical compositions, which may join the character before them."""
    out = set()
    for at in range(0xC0, 0x1FFFF):
        parts = unicodedata.decomposition(chr(at)).split() if not any(lo <= at <= hi for lo, hi in STABLE_BLOCKS) else []
        if len(parts) == 2 and not parts[0].startswith("<"):
            out.add(chr(int(parts[1], 16)))
    return frozenset(out)


def quick_check(ch: str) -> str:
    """The composed form's quick-check property of a character: Y(es), N(o) or M(aybe), where a combining class counts as M."""
    if unicodedata.combining(ch) or 0x1160 <= ord(ch) <= 0x11FF or ch in _second_parts():
        return "M"
    return "Y" if unicodedata.is_normalized("NFC", ch) else "N"


def look_alikes(spark: SparkSession) -> dict[str, str]:
    """Letters and digits of all alphabets that look like a plain one, from the confusables data of the JVM's ICU library.

    ICU's skeleton maps all characters of one look to one prototype, which also joins plain characters (1, l and I). So a
    letter counts as the one plain letter of its own case that shares its prototype, a digit as the one digit, a
    letter without case as the only letter; where there is no such one it stays. Latin letters stay, but for
    small capitals. The fixed values come first, and stand alone in a session without access to its JVM.
    """
    shapes = dict(SAME_SHAPE)
    try:
        checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    except AttributeError:
        return shapes
    plain = [chr(c) for c in range(0x21, 0x7F)]
    others = [chr(c) for c in range(0x250, 0x1F000) if unicodedata.category(chr(c)) in ("Lu", "Ll", "Lo", "Nd") and not any(lo <= c <= hi for lo, hi in STABLE_BLOCKS)]
    others = [c for c in others if not unicodedata.decomposition(c) and ("SMALL CAPITAL" in (name := unicodedata.name(c, "")) or not name.startswith("LATIN"))]
    prototypes = dict(zip([*plain, *others], checker.getSkeleton("\n".join([*plain, *others])).split("\n")))
    same: dict[str, list[str]] = {}
    for c in plain:
        if c.isalnum():
            same.setdefault(prototypes[c], []).append(c)
    for c in others:
        kind = unicodedata.category(c)
        fits = [x for x in same.get(prototypes[c], []) if unicodedata.category(x) == kind or kind == "Lo" and x.isalpha()]
        if len(fits) == 1:
            shapes.setdefault(c, fits[0])
    return shapes


class Forms:
    """A form of texts, for one table of characters that look like plain ones; ``wide_marks`` lets wide punctuation stay."""

    def __init__(self, shapes: dict[str, str], wide_marks: bool = False) -> None:
        self.shapes, self.wide_marks = shapes, wide_marks
        self.segment = lru_cache(1 << 16)(self.whole)
        joins, alone, hidden = [], [], []
        single: dict[int, str | int] = {}
        at = 0
        while at < 0x110000:
            block = next((hi for lo, hi in STABLE_BLOCKS if lo <= at <= hi), None)
            if block is not None:
                at = block + 1
                continue
            ch = chr(at)
            if quick_check(ch) == "M":
                joins.append(at)
            elif (form := self.whole(ch)) != ch:
                single[at] = form
                (alone if form else hidden).append(at)
            at += 1

        def ranges(points: list[int]) -> str:
            made: list[list[int]] = []
            for x in sorted(points):
                if made and made[-1][1] == x - 1:
                    made[-1][1] = x
                else:
                    made.append([x, x])
            return "".join(f"\\U{lo:08x}-\\U{hi:08x}" for lo, hi in made)

        def basic(points: list[int]) -> str:
            # one range for all higher planes keeps the class a bitmap; what is stable there comes out unchanged
            return f"[{ranges([x for x in points if x < 0x10000])}\\U00010000-\\U0010ffff]"

        # The first finds out whether a text needs work at all. A run of the third holds a mark, with whatever does not show
        # around it. All other unstable characters have a form of their own, whatever stands beside them.
        self.unstable, self.marks = re.compile(basic(joins + alone + hidden)), re.compile(basic(joins))
        self.runs = re.compile(f"[{ranges(hidden)}]*[{ranges(joins)}][{ranges(hidden + joins)}]*")
        # identities spare the translation a failed look-up for each common character
        self.single = {at: at for at in range(0x10000)} | single

    def plain(self, ch: str) -> str:
        """What one character of decomposed text becomes, before accents are composed."""
        if ch in self.shapes:
            return self.shapes[ch]
        if ch in LINE_ENDS:
            return "\n"
        kind = unicodedata.category(ch)
        if ch == "\t" or kind == "Zs":
            return " "
        # controls, format characters, variation selectors, fillers and the grapheme joiner do not show
        if kind in ("Cc", "Cf") or ch in HIDDEN or "\ufe00" <= ch <= "\ufe0f" or "\U000e0000" <= ch <= "\U000e0fff" or "\u180b" <= ch <= "\u180f":
            return ""
        parts = unicodedata.decomposition(ch).split()
        if parts and parts[0] == "<wide>" and self.wide_marks and kind[0] in "PS":
            return ch
        if parts and (parts[0] in WIDTHS or (parts[0] == "<compat>" and ("LIGATURE" in unicodedata.name(ch, "") or "\u2160" <= ch <= "\u217f"))):
            return "".join(self.plain(c) for x in parts[1:] for c in unicodedata.normalize("NFD", chr(int(x, 16))))
        return ch

    def whole(self, text: str) -> str:
        """The form of a segment that starts at a boundary."""
        return unicodedata.normalize("NFC", unicodedata.normalize("NFD", "".join(self.plain(c) for c in unicodedata.normalize("NFD", text))))

    def of(self, text: str) -> str:
        """The form of a text; applying it again changes nothing."""
        if text.isascii() and text.isprintable() or not self.unstable.search(text):
            return text
        if not self.marks.search(text):
            return text.translate(self.single)
        pieces, done = [], 0
        for m in self.runs.finditer(text):
            start = max(done, m.start() - 1)  # one character of context: a mark joins the one before it
            pieces.append(text[done:start])
            pieces.append((self.segment if m.end() - start <= 8 else self.whole)(text[start : m.end()]))
            done = m.end()
        pieces.append(text[done:])
        return "".join(pieces).translate(self.single)


class Readable:
    """The form to read: as the form to compare, but letters of other alphabets stay, except in words that mix alphabets.

    A word of Latin letters and of letters that look like them becomes all Latin; if it also holds letters of the other
    alphabet that look like none, its Latin letters become that alphabet's, as far as they have one of their shape.
    """

    def __init__(self, shapes: dict[str, str]) -> None:
        self.letters = {k: v for k, v in shapes.items() if k.isalpha() and v.isalpha()}
        self.base = Forms({k: v for k, v in shapes.items() if k not in self.letters}, wide_marks=True)
        other = re.escape("".join(self.letters))
        self.mixed = re.compile(f"[A-Za-z][{other}]|[{other}][A-Za-z]")
        self.words = re.compile(r"[^\W\d_]+")
        self.back: dict[str, dict[str, str]] = {}
        for k, v in sorted(self.letters.items()):
            self.back.setdefault(unicodedata.name(k, "").split(" ")[0], {}).setdefault(v, k)

    def _word(self, m: re.Match) -> str:
        word = m.group()
        if not self.mixed.search(word):
            return word
        names = [unicodedata.name(c, "").split(" ")[0] for c in word]
        strange = {n for c, n in zip(word, names) if n != "LATIN" and c not in self.letters}
        if not strange:
            return "".join(self.letters.get(c, c) for c in word)
        back = self.back.get(min(strange), {})
        return "".join(back.get(c, c) if n == "LATIN" else c for c, n in zip(word, names))

    def of(self, text: str) -> str:
        made = self.base.of(text)
        return made if made.isascii() or not self.mixed.search(made) else self.words.sub(self._word, made)


@lru_cache(4)
def forms_of(shapes: tuple[tuple[str, str], ...]) -> Forms:
    return Forms(dict(shapes))


@lru_cache(4)
def readable_of(shapes: tuple[tuple[str, str], ...]) -> Readable:
    return Readable(dict(shapes))


def canonical(text: str) -> str:
    """The form to compare, by the fixed values alone."""
    return forms_of(tuple(SAME_SHAPE.items())).of(text)


def text_keys(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, form_key, text_key): 128-bit digests of the form to compare and of the text; null texts are left out."""
    shapes = tuple(sorted(look_alikes(documents.sparkSession).items()))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            texts = batch.column(1).to_pylist()
            raw = [xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in texts]
            of = forms_of(shapes).of
            forms = [of(t) for t in texts]
            form = [r if f is t or f == t else xxhash.xxh3_128_digest(f.encode("utf-8", "surrogatepass")) for t, f, r in zip(texts, forms, raw)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(form, pa.binary()), pa.array(raw, pa.binary())], names=["doc_id", "form_key", "text_key"])

    rows = documents.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(keys, "doc_id bigint, form_key binary, text_key binary")


def canonical_texts(documents: DataFrame, doc_id: str, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, keep, text, changed): every text in its form to read; a null text stays null."""
    shapes = tuple(sorted(look_alikes(documents.sparkSession).items()))
    more = documents.select(*keep).schema

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, of = batch.column(1).to_pylist(), readable_of(shapes).of
            made = [None if t is None else of(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(batch.column(2 + k) for k in range(len(keep))), pa.array(made, pa.string()), pa.array([a != b for a, b in zip(texts, made)])], names=["doc_id", *keep, "text", "changed"])

    rows = documents.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("__text"), *keep)
    return rows.mapInArrow(forms, ", ".join(["doc_id bigint", *(f"`{f.name}` {f.dataType.simpleString()}" for f in more), "text string", "changed boolean"]))


def same_looking_classes(keys: DataFrame) -> DataFrame:
    """(doc_id, class_id, links): each document with the smallest id of those that look the same, and how many of these have another text.

    Defined cases as for pairs; a document delivered with several texts has a row for each of their forms, with the largest number of links.
    """
    rows = cut(keys.distinct())
    texts = rows.groupBy("form_key", "text_key").agg(F.count("*").alias("same"))
    forms = rows.groupBy("form_key").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("all"))
    placed = rows.join(texts, ["form_key", "text_key"]).join(forms, "form_key")
    return placed.groupBy("doc_id", "class_id").agg(F.max(F.col("all") - F.col("same")).alias("links"))


def same_looking_pairs(keys: DataFrame) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: documents with one form and different texts.

    Pairs are made between the different texts of a form first and then spread over their documents, so that many
    copies of one text are never compared with each other.
    Defined cases: null texts and ids are left out; an empty text is a text; repeated rows count once; one
    document with two texts of one form is no pair; an empty table gives an empty result; other columns do
    not matter.
    """
    # digests are small beside the texts: written once, they spare reading and normalising these three times
    rows = cut(keys.distinct())
    shared = rows.groupBy("form_key").agg(F.min("text_key").alias("low"), F.max("text_key").alias("high")).where("low <> high").select("form_key")
    rows = rows.join(shared, "form_key")
    texts = rows.select("form_key", "text_key").distinct()
    pairs = texts.withColumnRenamed("text_key", "a").join(texts.withColumnRenamed("text_key", "b"), "form_key").where("a < b")
    docs = rows.select("form_key", "text_key", "doc_id")
    spread = pairs.join(docs.toDF("form_key", "a", "x"), ["form_key", "a"]).join(docs.toDF("form_key", "b", "y"), ["form_key", "b"])
    return spread.where("x <> y").selectExpr("least(x, y) AS doc_a", "greatest(x, y) AS doc_b").distinct()
