"""Defects of question-response pairs by noisy labelling functions and an expectation-maximisation label model.

For each defect several functions vote for it, against it or abstain. How far each function can be relied on, and
how common the defect is, is estimated from the counts of all vote patterns; the posterior of a pattern decides, against a
cutoff validated on planted defects. There are at most 3^n patterns of n functions, so the fit is small whatever the number of pairs.

Languages are told by script and, within Latin script, by models of character trigrams that the questions of all rows teach: a question
counts for the language whose closed-class words it holds. Functions for broken-off answers use how each word is used over
all responses.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.runtime import cut, shuffle_partitions

DEFECTS = ["empty", "copy", "refusal", "language", "truncated"]  # in the order in which they win ties
PLANTED = ["empty", "copy", "language", "truncated"]
CUTOFF = 0.5  # where nothing can be planted
GROUP = 250  # pairs, about, among which answers in another language are exchanged when defects are planted
SLOTS = 1 << 15  # of hashed trigrams

# Closed-class words by language: articles, pronouns, prepositions, conjunctions, auxiliaries, question words.
WORDS = {
    "en": "the a an and or but of to in on at for with from by that this these those who what where why how when which is are was were be been do does did has have had not he she it they we you his her its their there then than as if because after before until into about over under between during",
    "de": "der die das den dem des ein eine einen einem einer und oder aber zu in im an am auf mit von vom für bei beim nach vor über dass wer was wo warum wie wann welche ist sind war waren hat haben hatte wird wurde nicht kein keine er sie es wir ihr sein seine sich noch als wenn weil denn durch gegen ohne zwischen während bis seit",
    "fr": "le la les un une des du de et ou mais à au aux dans sur sous avec pour par sans que qui quoi où pourquoi comment combien quand quel quelle est sont était a ont avait n' ne pas il elle ils elles on nous vous son sa ses leur se ce cette ces y car puis si même après avant chez entre vers depuis pendant d l qu s c j m t",
    "es": "el la los las un una unos unas del de y o pero a al en con por para sin sobre que qué quién dónde cuándo cómo cuánto cuál es son era fue está ha han había no se su sus él ella ellos nos lo le les este esta ese esa si porque como ya más después antes desde hasta entre durante",
    "it": "il lo la gli le un uno una del della dei delle di e o ma a al alla in nel nella con per da dal su che chi cosa dove quando come perché quale è sono era ha hanno aveva non si suo sua loro questo questa più anche",
    "pt": "o a os as um uma do da dos das de e ou mas em no na nos nas com por para que quem onde quando como porque qual é são era foi tem não se seu sua ele ela eles este esta mais também ao à pelo pela",
    "nl": "de het een en of maar van in op aan met voor door bij naar uit dat die wie wat waar waarom hoe wanneer welke is zijn was waren heeft hebben had niet geen hij zij ze wij zich er dan als omdat nog ook",
}
WORDS = {k: frozenset(v.split()) for k, v in WORDS.items()}
ANY_WORD = frozenset().union(*WORDS.values())
# Words after which no answer ends: articles, prepositions, conjunctions and auxiliaries among them that cannot stand last.
OPEN_ENDS = frozenset("the a an and or but so because although while to of at with for from by that who which was is had has than as his her until denn weil und oder aber der die das den dem ein eine einen im am zu mit von für bis um sich obwohl dass le la les un une et ou mais de des du à au dans sur que qui car pour ne avec si parce el los las una y pero del en con por para se su lo porque aunque hasta al option".split())
OPEN_ENDS_ZH = re.compile(r"(?:因为|虽然|但是|所以|而且|如果|然后|接着|或者|以及|答案是|我选择|在|和|跟|把|被|给|对|从|向|与)$")
# What stands for nothing, labels of answers and of questions.
PLACEHOLDERS = frozenset("null none nil nan na undefined tbd 无 空".split())
LABELS = r"(?:answers?|responses?|reply|output|a|antworten?|réponses?|respuestas?|答案|回答|答)"
DRESS = r"(?:questions?|q|you asked?|asked|frage|sie fragen|fragen|vous demandez|demande|preguntas?|你问的是|问题|你问)"
# A speaker who says of themselves that they cannot, may not or would rather not answer; by language, verb by verb.
DECLINES = (
    r"\bi(?: am|'m)? (?:only an? |cannot|can't|can not|am unable|unable|not able|not allowed|not permitted|not comfortable|won't|will not|must decline|decline|refuse|would rather (?:not|skip)|prefer not|do not (?:have|know|wish|want to)|don't (?:have|know|wish|want to)|have no)|\bi'd rather (?:not|skip)|outside (?:of )?what i|beyond what i|(?:not possible|impossible) for me|(?:let|allow|permit)s? (?:me|an answer)"
    r"|je ne (?:peux|puis|dispose|suis pas (?:en mesure|autorisé)|sais|souhaite|veux)|m'est (?:impossible|interdit)|je préfère ne|ne me permet|je refuse"
    r"|\bno puedo\b|no me (?:está|es) (?:permitido|posible)|prefiero no|no (?:tengo (?:suficiente|permiso|acceso)|dispongo|quiero|deseo)|no sé\b|me niego"
    r"|kann ich (?:\w+ ){0,4}nicht|ich kann (?:\w+ ){0,5}nicht|möchte ich (?:\w+ ){0,3}(?:keine|nicht)|ich möchte (?:\w+ ){0,3}(?:keine|nicht)|ich darf (?:\w+ ){0,3}(?:keine|nicht)|darf ich (?:\w+ ){0,3}(?:keine|nicht)|liegen mir keine|mir nicht (?:möglich|erlaubt)|ich weiß (?:es )?nicht"
    r"|我(?:无法|不能|不方便|看不到|没有办法|不知道|拒绝|不便|不想)|无法回答|不方便|信息不足"
    r"|non (?:posso|sono in grado|mi è (?:possibile|permesso))|não (?:posso|sei|tenho permissão)|ik kan (?:\w+ ){0,4}niet|я не (?:могу|знаю|буду)|お答えできません|わかりません"
)
# Words that open an apology or a regret.
SORRY = r"^\W*(?:(?:i'm |i am )?(?:very |so )?sorry|(?:my )?apologies|i apologi[sz]e|unfortunately|regrettably|i(?:'m| am) afraid|je suis désolée?|désolée?|pardon|malheureusement|lo siento|disculpa|perdón|por desgracia|lamentablemente|(?:es )?tut mir leid|entschuldigung|leider|抱歉|对不起|很遗憾|不好意思|mi dispiace|desculpe|het spijt me|извините|申し訳)"
MODEL = r"language model|modèle de langage|modelo de lenguaje|sprachmodell|语言模型|\bas an ai\b|\ban ai (?:model|assistant)\b"
# What an answer would rest on or give, which whoever declines says is missing, or turns down.
GROUNDS = r"\b(?:information|evidence|permission|access|comment|answer|assist|help|discuss\w*|identif\w+|memory)\b|informations?\b|réponse|répondre|información|responder|respuesta|auskunft|beantworten|informationen|回答|信息|谈论|识别"
DECLINES, SORRY, MODEL, GROUNDS = (re.compile(x) for x in (DECLINES, SORRY, MODEL, GROUNDS))

_WORD = re.compile(r"[^\W\d_]+")
_CJK = re.compile(r"[㐀-鿿]")
_QUOTED = re.compile(r"“[^”]*”|«[^»]*»|\"[^\"]*\"|\([^)]*\)|（[^）]*）")
_TAIL = re.compile(r"\s*(?:\([^()]*\)|（[^（）]*）|“[^“”]*”|\[[^\[\]]*\])\s*$")
_TERMINAL = re.compile(r"[.!?。！？][\"'”’»)\]）」*_`]*$")
_OPTION = re.compile(r"^\W*[a-d]\W*$|\b(?:options?|answer|choice|choose|pick|réponse|choisis|respuesta|opción|elijo|antwort|wähle|lösung)\b(?:\W+\w+){0,2}\W+[a-d]\W*$|(?:答案|选择|选项?)是?\W*[a-d]\W*$")


def _visible(text: str) -> str:
    if text.isprintable():
        return text.strip()
    return "".join(c for c in text if unicodedata.category(c) not in ("Cf", "Cc") or c in "\n\t").strip()


def _bare(text: str) -> str:
    return re.sub(r"[\W_]+", "", text)


@lru_cache(1 << 14)
def _script(ch: str) -> str:
    """Script of a letter, by its name; Japanese syllables count as one."""
    name = unicodedata.name(ch, "").split(" ")[0]
    return {"HIRAGANA": "KANA", "KATAKANA": "KANA", "CJK": "HAN"}.get(name, name)


def script_of(text: str) -> tuple[str | None, int]:
    """The script most letters have, and the number of its letters; kana among ideographs make them Japanese. Ideographs weigh two."""
    if text.isascii():
        n = sum(map(str.isalpha, text))
        return ("LATIN", n) if n else (None, 0)
    seen = Counter(_script(c) for c in text if c.isalpha())
    if not seen:
        return None, 0
    if seen["KANA"] and seen["KANA"] * 5 >= seen["HAN"]:
        return "KANA", seen["KANA"] + seen["HAN"]
    best = max(seen, key=lambda k: (seen[k] * (3 if k == "HAN" else 1), k))
    return best, seen[best]


def closed_class(words: list[str]) -> str | None:
    """The language of Latin script whose closed-class words a text holds most of, if no other has as many."""
    words = [w for w in words if w in ANY_WORD]
    hits = sorted(((sum(w in v for w in words), k) for k, v in WORDS.items()), reverse=True)
    return hits[0][1] if hits[0][0] > hits[1][0] else None


@lru_cache(1 << 17)
def _slots(word: str) -> tuple[int, ...]:
    import zlib

    text = f" {word} "
    return tuple(zlib.crc32(text[i : i + 3].encode()) % SLOTS for i in range(len(text) - 2))


def trigrams(words: list[str]) -> list[int]:
    """Slots of the trigrams of words, with a blank on either side of each."""
    return [x for w in words for x in _slots(w)]


@dataclass
class Languages:
    """Models of character trigrams: names, logarithms of probabilities by slot, and what a text of the language itself has a trigram on average."""

    names: list[str]
    logs: np.ndarray
    usual: np.ndarray

    @classmethod
    def fit(cls, counts: dict[str, np.ndarray]) -> Languages:
        names = sorted(k for k, v in counts.items() if v.sum() > 0)
        raw = np.array([counts[k] for k in names], float).reshape(len(names), SLOTS)
        p = (raw + 0.05) / (raw + 0.05).sum(1, keepdims=True)
        return cls(names, np.log(p), (raw * np.log(p)).sum(1) / np.maximum(raw.sum(1), 1))

    def best(self, words: list[str]) -> tuple[np.ndarray, int]:
        """Logarithm of the probability of each language's model a trigram, and the number of trigrams."""
        at = trigrams(words)
        return self.logs[:, at].mean(1) if at and self.names else np.zeros(len(self.names)), len(at)


def votes(question: str | None, response: str | None, languages: Languages | None = None, only: str | None = None) -> dict:
    """Votes (1 for, -1 against, 0 none) of all functions that need no corpus, or of those of one defect, and what the others need."""
    q = unicodedata.normalize("NFKC", question or "").replace("’", "'").lower()
    shown = _visible(response or "")
    r = unicodedata.normalize("NFKC", shown).replace("’", "'")
    low = r.lower()
    bare, asked = _bare(low), _bare(q)
    out: dict = {}
    if only in (None, "empty"):
        unlabelled = re.sub(r"<[^<>]*>", " ", low).strip()
        unlabelled = re.sub(rf"^\W*{LABELS}\s*[:：]\s*", "", unlabelled) if re.match(rf"^\W*{LABELS}\s*[:：]", unlabelled) else unlabelled
        nothing = not _bare(unlabelled) or _bare(unlabelled) in PLACEHOLDERS
        out["empty"] = [1 if not bare else 0, 1 if nothing else -1, 1 if nothing and len(bare) <= 12 else 0, -1 if len(bare) > 12 and not nothing else 0]
    if only in (None, "copy", "refusal", "language"):
        qs, rs = set(_WORD.findall(q)), set(_WORD.findall(low))
    if only in (None, "copy"):
        undressed = re.sub(rf"^\W*{DRESS}\s*[:：]?\s*", "", low)
        core = _bare(undressed)
        same = bool(asked) and bool(bare) and (bare == asked or core == asked)
        again = bool(asked) and len(bare) > len(asked) and not bare.replace(asked, "")
        overlap = len(qs & rs) / max(1, len(qs | rs))
        out["copy"] = [1 if same or again else -1, (1 if overlap >= 0.85 and len(qs) > 2 else -1), 1 if asked and core.startswith(asked) and len(core) - len(asked) * max(1, len(core) // max(1, len(asked))) < 3 else 0]
    if only in (None, "refusal"):
        able, sorry, model, grounds = (bool(p.search(low)) for p in (DECLINES, SORRY, MODEL, GROUNDS))
        # whoever answers speaks of what was asked
        shared = bool({w for w in qs & rs if len(w) > 3 and w not in ANY_WORD})
        out["refusal"] = [1 if able else -1, 1 if sorry else 0, 1 if model else 0, 1 if able and grounds else -1 if not able else 0, -1 if not (able or sorry or model) else -1 if shared and not able else 0]
    if only in (None, "language"):
        # language, without quotations and brackets, a polite word in front and the question's own words
        body = _QUOTED.sub(" ", low)
        body = re.sub(r"^\W*[^\W\d_]{2,10}\s*[.,:：，。!！]\s*(?=\S+\s+\S+|[㐀-鿿]{4})", "", body)
        names = {w.lower() for w in _WORD.findall(r) if w[0].isupper() and not w.isupper()}
        # what both say tells nothing, but for closed-class words
        words = [w for w in _WORD.findall(body) if w not in qs or w in ANY_WORD]
        # letters of options and names tell nothing, unless a closed-class word stands in front
        words = [w for w in words if len(w) > 1]
        plain = [w for w in words if w not in names or w in ANY_WORD]
        (asks, n_asks), (says, n_says) = script_of(q), script_of(body)
        tall = n_says >= (4 if says in ("HAN", "KANA", "HANGUL") else 12)
        script = 0 if not asks or not says or not n_asks else -1 if asks == says else 1 if asks != says and tall else 0
        ql = closed_class(_WORD.findall(q)) if asks == "LATIN" else None
        rl = closed_class(plain or words)
        spread = modelled = strange = 0
        if asks == says == "LATIN" and ql and len(_WORD.findall(body)) >= 4:
            own, others = WORDS[ql], [w for w in plain if w in ANY_WORD and w not in WORDS[ql]]
            if rl:
                spread = -1 if rl == ql else 1 if len([w for w in plain if w in WORDS[rl]]) >= 2 else 0
            if languages and ql in languages.names:
                logs, n = languages.best(plain if len(plain) >= 3 else words)
                k = languages.names.index(ql)
                top = int(logs.argmax())
                # the models must agree with the words there are
                more_words = sum(w in WORDS[languages.names[top]] for w in plain) >= sum(w in own for w in plain)
                modelled = -1 if top == k and n >= 12 else 1 if n >= 20 and (logs[top] - logs[k]) * n > 12 and more_words else 0
                # unlike any language that is asked in, and without its words
                strange = 1 if not any(w in own for w in plain) and logs[k] < languages.usual[k] - 1.5 and n >= 24 and len(others) >= 2 else 0
        out["language"] = [spread, script, modelled, strange]
    if only in (None, "truncated"):
        # broken off?
        rest = shown
        while (m := _TAIL.search(rest)) and m.start() > 0 and not _TERMINAL.search(rest):
            rest = rest[: m.start()].rstrip()
        cut = rest.lower().rstrip()
        ended = bool(_TERMINAL.search(cut)) and not re.search(r"(?:\.\.\.|…)[\"'”’»)\]]*$", cut)
        option = len(cut) < 60 and bool(_OPTION.search(cut))
        tokens = _WORD.findall(cut)
        zh = len(_CJK.findall(re.sub(r"^\W*(?:答案是|我选择)?\W*[a-d]\W*因为", "", cut)))
        n = zh if zh > len(tokens) else len(re.findall(r"\w+(?:['’]\w+)?", cut))
        last = tokens[-1] if tokens and re.search(r"[^\W\d_][\W_]*$", cut) else ""
        dangling = bool(re.search(r"(?:\.\.\.|…|[,;:，、；：(\[（“«*])[\"']?$", cut)) or (last in OPEN_ENDS and (n > 1 or last == "option")) or cut.count("“") > cut.count("”") or cut.count("(") > cut.count(")") or bool(OPEN_ENDS_ZH.search(cut))
        called = {w.lower() for w in _WORD.findall(unicodedata.normalize("NFKC", question or ""))[1:] if w[0].isupper()}
        subject = bool(tokens) and not ended and n >= (4 if zh else 3) and (tokens[0] in called if not zh else cut[:2] in q)
        limit = 9 if zh else 8
        complete = ended or option
        is_open = bool(bare) and not complete
        short = n <= (6 if zh else 3)
        out["truncated"] = [1 if n >= limit else -1 if short and not dangling and not subject else 0, 1 if dangling else 0, 1 if subject else 0] if is_open else [-1, -1, -1]
        out["open"] = is_open
        out["last"] = "" if zh else last
        out["long"] = n
    return out


@dataclass
class LabelModel:
    """How common a defect is, and how its functions vote with it and without it: theta[function, with or without, vote for, none, against]."""

    prior: float
    theta: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        n = patterns.shape[1]
        ll = np.log([self.prior, 1 - self.prior])[None, :] + np.log(np.maximum(self.theta[np.arange(n)[None, :], :, 1 - patterns], 1e-12)).sum(1)
        return 1 / (1 + np.exp(np.clip(ll[:, 1] - ll[:, 0], -500, 500)))


def label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, pseudo: float = 4.0, settled: float = 1e-7) -> LabelModel:
    """Fitted by expectation maximisation over the vote patterns of one defect's functions.

    A function starts better than chance, which is all that tells the two sides apart; its start counts as ``pseudo`` pairs. A vote for the
    defect is taken to be at least as likely with it as without it, and to abstain as likely either way.
    """
    start = np.array([[0.6, 0.35, 0.05], [0.05, 0.4, 0.55]])
    n = patterns.shape[1]
    model = LabelModel(0.1, np.tile(start, (n, 1, 1)))
    total = max(1.0, counts.sum())
    for _ in range(rounds):
        post = model.posterior(patterns)
        prior = float(np.clip((counts * post).sum() / total, 1e-4, 0.5))
        theta = np.empty_like(model.theta)
        for j in range(n):
            for c, w in ((0, counts * post), (1, counts * (1 - post))):
                seen = np.bincount(1 - patterns[:, j], weights=w, minlength=3)
                theta[j, c] = (seen + pseudo * start[c]) / (seen.sum() + pseudo)
            # to abstain tells nothing: it is as likely with the defect as without
            none = np.bincount(1 - patterns[:, j], weights=counts, minlength=3)[1] / total
            theta[j, :, 1] = 0
            theta[j] *= (1 - none) / theta[j].sum(-1, keepdims=True)
            theta[j, :, 1] = none
            if theta[j, 0, 0] < theta[j, 1, 0]:
                theta[j, :, ::2] = theta[j, :, ::2].mean(0)
        moved = abs(prior - model.prior) + np.abs(theta - model.theta).max()
        model = LabelModel(prior, theta)
        if moved < settled:
            break
    return model


def plantings(pairs: list[tuple[str, str]], seed: int, donors: list[bool] | None = None) -> Iterator[tuple[int, str, str]]:
    """(place of the pair, response, defect): each pair emptied, copied, broken off, and answered in another language's words by one of ``donors``."""
    rng = np.random.default_rng(seed)
    tongues = [closed_class(_WORD.findall(q.lower())) or script_of(q)[0] for q, _ in pairs]
    for k, (q, r) in enumerate(pairs):
        yield k, ["", " \u200b", "...", "N/A", "<answer></answer>", "Answer:", "—"][k % 7], "empty"
        yield k, [q, f"“{q}”", q.upper(), f"Q: {q}", f"  {q.rstrip('?？')} "][k % 5], "copy"
        if len(r.split()) >= 6 or len(_CJK.findall(r)) >= 10:
            yield k, r[: int(rng.integers(len(r) // 3, len(r) - 3))].rstrip(), "truncated"
        other = int(rng.integers(0, len(pairs)))
        if (not donors or donors[other]) and tongues[k] and tongues[other] and tongues[other] != tongues[k] and (len(_WORD.findall(pairs[other][1])) >= 5 or len(_CJK.findall(pairs[other][1])) >= 6):
            yield k, pairs[other][1], "language"


def planted(pairs: list[tuple[str, str]], seed: int = 5) -> list[tuple[str, str, str]]:
    """(question, response, defect) made from pairs without a defect: emptied, copied, broken off, or answered in another language's words."""
    return [(pairs[k][0], r, what) for k, r, what in plantings(pairs, seed)]


def validated(models: dict[str, LabelModel], made: dict[str, tuple[np.ndarray, np.ndarray]], clean: dict[str, tuple[np.ndarray, np.ndarray]]) -> dict[str, float]:
    """Cutoffs that tell planted defects from the pairs they were planted into best (by F1); 0.5 for a defect that cannot be planted.

    ``made`` and ``clean`` hold the vote patterns, and how many pairs have each, with the defect and without.
    """
    out = dict.fromkeys(DEFECTS, CUTOFF)
    for d in models:
        if d not in made or made[d][1].sum() < 20:
            continue
        (yes, n_yes), (no, n_no) = ((models[d].posterior(p), n) for p, n in (made[d], clean[d]))

        def f1(c: float, yes=yes, n_yes=n_yes, no=no, n_no=n_no) -> float:
            hit, wrong = n_yes[yes >= c].sum(), n_no[no >= c].sum()
            return 2 * hit / max(1, hit + wrong + n_yes.sum())

        # the middle of what is equally good
        grid = [k / 20 for k in range(2, 19)]
        best = max(map(f1, grid))
        good = [c for c in grid if f1(c) >= best - 1e-9]
        out[d] = min(good, key=lambda c: (abs(c - CUTOFF), c))
    return out


@lru_cache(64)
def emptied(response: str) -> dict:
    """Votes on an empty response, which are the same whatever was asked."""
    return votes("", response, only="empty")


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one group after the other, of batches in which groups follow each other; very large groups in pieces."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        ends = np.flatnonzero(np.diff(batch.column("grp").to_numpy())) + 1
        for lo, hi in zip([0, *ends], [*ends, batch.num_rows]):
            part = batch.slice(lo, hi - lo)
            if held and len(part) and (held[0].column("grp")[0] != part.column("grp")[0] or sum(map(len, held)) > 16 * GROUP):
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            if len(part):
                held.append(part)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def learn_languages(rows: DataFrame) -> Languages:
    """Models of trigrams from all questions (column ``q``); at most SLOTS numbers a language come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {k: np.zeros(SLOTS, np.int64) for k in WORDS}
        for batch in batches:
            for q in batch.column(0).to_pylist():
                words = _WORD.findall(unicodedata.normalize("NFKC", q).replace("’", "'").lower())
                lang = closed_class(words)
                if lang and script_of(q)[0] == "LATIN":
                    # names tell nothing about a language
                    called = {w.lower() for w in _WORD.findall(q)[1:] if w[0].isupper()}
                    np.add.at(held[lang], trigrams([w for w in words if w not in called or lang == "de"]), 1)
        for k, v in held.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(v[at], pa.int64())], names=["lang", "slot", "n"])

    found = rows.select("q").where("q IS NOT NULL").mapInArrow(count, "lang string, slot bigint, n bigint").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    counts = {k: np.zeros(SLOTS) for k in WORDS}
    for lang, slot, n in zip(*(c.to_pylist() for c in found.columns)):
        counts[lang][slot] = n
    # a language that hardly any question is asked in is noise
    whole = sum(v.sum() for v in counts.values())
    return Languages.fit({k: v for k, v in counts.items() if v.sum() > 0.005 * whole})


def defect_posteriors(pairs: DataFrame, pair_id: str, question: str, response: str) -> DataFrame:
    """(pair_id, defect, posterior, cutoff) for each pair and defect; a defect is there where the posterior reaches the cutoff.

    Defined cases: a null or blank response is empty; a null question leaves copy and language without votes
    for them; rows delivered twice count once; a null pair_id is left out; an empty table gives an empty
    result; other columns do not matter. Texts are read whole.
    """
    spark = pairs.sparkSession
    # read several times below: each pair once, written once, in groups that lie together and in order whatever the partitions are
    groups = max(1, -(-pairs.count() // GROUP))
    rows = pairs.select(F.col(f"`{pair_id}`").cast("long").alias("pair_id"), F.col(f"`{question}`").alias("q"), F.col(f"`{response}`").alias("r")).where("pair_id IS NOT NULL")
    rows = rows.withColumn("grp", F.expr(f"pmod(xxhash64(pair_id), {groups})")).repartition(shuffle_partitions(spark), "grp").distinct()
    rows = cut(rows.sortWithinPartitions("grp", "pair_id", "q", "r"))
    languages = learn_languages(rows)
    shared = spark.sparkContext.broadcast(languages)

    extra = 3  # functions of ``truncated`` that look at the corpus: they abstain where defects are planted

    def blind(v: dict) -> list[int]:
        return v["truncated"] + [0 if v["open"] else -1] * extra

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = shared.value
        for group in grouped(batches):
            texts = list(zip(group.column("q").to_pylist(), group.column("r").to_pylist()))
            made = [votes(q, r, languages) for q, r in texts]
            hosts = [k for k, (q, r) in enumerate(texts) if q and r]
            # answers are given on by pairs that no function speaks against
            donors = [all(max(made[k][d]) < 1 for d in DEFECTS) for k in hosts]
            sown: dict[str, list] = {d: [None] * len(texts) for d in PLANTED}
            for k, r, what in plantings([texts[k] for k in hosts], int(group.column("grp")[0].as_py()), donors):
                v = emptied(r) if what == "empty" else votes(texts[hosts[k]][0], r, languages, what)
                sown[what][hosts[k]] = blind(v) if what == "truncated" else v[what]
            columns = [group.column("pair_id").combine_chunks()] + [pa.array([m[d] for m in made], pa.list_(pa.int8())) for d in DEFECTS]
            columns += [pa.array([m["open"] for m in made], pa.bool_()), pa.array([m["last"] for m in made], pa.string()), pa.array([m["long"] for m in made], pa.int32())]
            columns += [pa.array([bool(q and r) for q, r in texts], pa.bool_())] + [pa.array(sown[d], pa.list_(pa.int8())) for d in PLANTED]
            yield pa.RecordBatch.from_arrays(columns, names=["pair_id", *DEFECTS, "open", "last", "long", "host", *(f"with_{d}" for d in PLANTED)])

    # votes are taken once, on each pair and on what is planted into it; what is written holds no texts
    kinds = [f"{d} array<tinyint>" for d in DEFECTS] + ["open boolean", "last string", "long int", "host boolean"] + [f"with_{d} array<tinyint>" for d in PLANTED]
    voted = cut(rows.select("pair_id", "q", "r", "grp").mapInArrow(vote, "pair_id bigint, " + ", ".join(kinds)))
    short = "open AND last <> '' AND long < 8"
    ends = voted.where(short)
    # how a word is used elsewhere, inside a response and before a full stop, for words that short unfinished ones end with
    words = rows.selectExpr("explode(regexp_extract_all(lower(r), '(\\\\p{L}+)([^\\\\p{L}]*)', 0)) AS w").selectExpr("regexp_extract(w, '\\\\p{L}+', 0) AS word", "w RLIKE '[.!?。！？]' AS stop", "w RLIKE '[^\\\\p{L}]$' AS more")
    usage = words.groupBy("word").agg(F.count("*").alias("uses"), F.sum(F.col("more").cast("long")).alias("inner"), F.sum(F.col("stop").cast("long")).alias("stops"))
    used = ends.select("last").distinct().join(usage, F.col("last") == F.col("word")).select("last", "uses", "inner", "stops")
    # how large a share of all responses is this one word for word: phrases recur, fragments hardly do
    shape = "regexp_replace(lower(trim(r)), '[0-9]+', '0')"
    brief = rows.join(ends.select("pair_id"), "pair_id", "left_semi").selectExpr("pair_id", f"{shape} AS shape")
    recur = brief.groupBy("shape").agg(F.count("*").alias("times")).where("times > 1")
    times = brief.join(recur, "shape").select("pair_id", "times")
    whole = rows.agg(F.count("*").alias("pairs"))  # one row
    looked = ends.join(used, "last", "left").join(times, "pair_id", "left").join(F.broadcast(whole))
    # of a word's other uses, how many end a sentence, and how many end a sentence or a response
    stops, final = "CASE WHEN uses > 1 THEN stops / (uses - 1D) ELSE 0D END", "CASE WHEN uses > 1 THEN (stops + uses - inner - 1D) / (uses - 1D) ELSE 0D END"
    recurs = "coalesce(times, 1) >= greatest(3D, 1e-5D * pairs)"
    more = [
        f"CASE WHEN {recurs} THEN 0 WHEN {stops} > 0.1D OR (inner > 0 AND {final} > 0.3D) THEN -1 WHEN coalesce(inner, 0) = 0 AND coalesce(stops, 0) = 0 AND long > 2 THEN 1 ELSE 0 END",
        f"CASE WHEN NOT {recurs} AND long > 3 AND inner > 0 AND {final} < 0.02D THEN 1 ELSE 0 END",
        f"CASE WHEN {recurs} AND truncated[1] = 0 THEN -1 ELSE 0 END",
    ]
    with_corpus = looked.selectExpr("pair_id", *DEFECTS[:-1], "concat(truncated, array(" + ", ".join(f"CAST({x} AS tinyint)" for x in more) + ")) AS truncated")
    rest = voted.where(f"NOT ({short})").selectExpr("pair_id", *DEFECTS[:-1], "concat(truncated, CASE WHEN open THEN array(0Y, 0Y, 0Y) ELSE array(-1Y, -1Y, -1Y) END) AS truncated")
    patterns = with_corpus.unionByName(rest)
    patterns = cut(patterns)
    # at most 3^n patterns of a defect's n functions
    seen = patterns.select(F.expr("stack(5, " + ", ".join(f"'{d}', {d}" for d in DEFECTS) + ") AS (defect, votes)")).groupBy("defect", "votes").agg(F.count("*").alias("n")).toArrow()
    table: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for d in DEFECTS:
        own = seen.filter(pa.compute.equal(seen.column("defect"), d))
        if own.num_rows:
            table[d] = np.array(own.column("votes").to_pylist(), int), own.column("n").to_numpy().astype(float)
    models = {d: label_model(*table[d]) for d in table}
    # pairs without a defect as the models see them, and the same pairs with each; every pair counts
    abstain = "concat(truncated, CASE WHEN open THEN array(0Y, 0Y, 0Y) ELSE array(-1Y, -1Y, -1Y) END)"
    own = {d: abstain if d == "truncated" else d for d in models}
    blindly = {d: np.array([[*p, *[e] * extra] for e in (0, -1) for p in product((-1, 0, 1), repeat=3)]) if d == "truncated" else table[d][0] for d in models}
    suspect = {d: blindly[d][models[d].posterior(blindly[d]) >= CUTOFF] for d in models}
    listed = {d: "array(" + ", ".join("array(" + ", ".join(f"{x}Y" for x in p) + ")" for p in bad) + ")" for d, bad in suspect.items() if len(bad)}
    clean = voted.where(" AND ".join(["host", *(f"NOT array_contains({bad}, {own[d]})" for d, bad in listed.items())]))
    sides = [f"'{d}', false, {own[d]}" for d in models] + [f"'{d}', true, with_{d}" for d in PLANTED if d in models]
    told: dict[bool, dict] = {False: {}, True: {}}
    if sides:
        counted = clean.select(F.expr(f"stack({len(sides)}, " + ", ".join(sides) + ") AS (defect, made, votes)")).where("votes IS NOT NULL").groupBy("defect", "made", "votes").agg(F.count("*").alias("n")).collect()
        for made in (False, True):
            for d in models:
                if some := [(r["votes"], r["n"]) for r in counted if r["defect"] == d and r["made"] == made]:
                    told[made][d] = np.array([v for v, _ in some], int), np.array([n for _, n in some], float)
    cutoffs = validated(models, told[True], told[False])
    known = [(d, [int(x) for x in p], float(x), cutoffs[d]) for d in models for p, x in zip(table[d][0], models[d].posterior(table[d][0]))]
    fitted = spark.createDataFrame(known, "defect string, votes array<tinyint>, posterior double, cutoff double")
    each = patterns.select("pair_id", F.expr("stack(5, " + ", ".join(f"'{d}', {d}" for d in DEFECTS) + ") AS (defect, votes)"))
    return each.join(F.broadcast(fitted), ["defect", "votes"]).select("pair_id", "defect", "posterior", "cutoff")


def best_defect(posteriors: DataFrame) -> DataFrame:
    """(pair_id, defect): the likeliest defect of each pair that has one above its cutoff."""
    order = F.array_position(F.array(*[F.lit(d) for d in DEFECTS]), F.col("defect"))
    over = posteriors.where("posterior >= cutoff")
    return over.groupBy("pair_id").agg(F.max_by("defect", F.struct(F.round("posterior", 3), -order)).alias("defect"))
