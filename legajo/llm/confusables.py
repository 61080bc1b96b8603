"""One consistent form for text that looks the same but differs in its characters.

Two strings get the same form exactly if a reader sees the same letters,
accents, case, digits, marks, gaps and line breaks.  Steps, per text:

1. decompose (NFD), drop invisible characters, unify kinds of blank and line
   break, fold width, presentation forms, ligatures and letter-like numerals;
   raised and lowered digits stay as they are, since a reader sees them;
2. per token, intersect the script sets of its letters.  A look-alike letter
   belongs to every script that has its shape; a letter without twin belongs to
   its own.  Tokens of mixed spelling and tokens wholly written in look-alikes
   are thereby told from plain ones, and each is respelled in one script: the
   only one its letters share, else Latin for the look-alikes;
3. compose (NFC).
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from legajo.functions.session import cut_table

# Fixed values, from the published table of confusable characters: letters of other alphabets, each beside the Latin letter of the same shape and case.
CYRILLIC = "аa еe оo рp сc уy хx іi јj ѕs һh ԁd ԛq ԝw ӏl ѵv АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ІI ЈJ ЅS ԚQ ԜW ѴV ҮY ԌG ӀI"
GREEK = "οo νv ϲc ϳj ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ͿJ"
ARMENIAN = "օo ոn սu հh ցg ՏS ՍU ՕO"
CHEROKEE = "ᎠD ᎡR ᎢT Ꭵi ᎪA ᎫJ ᎬE ᎳW ᎷM ᎻH ᎽY ᏀG ᏃZ ᏒR ᏔW ᏕS ᏙV ᏚS ᏞL ᏟC ᏢP ᏦK ᏴB"
LISU = "ꓐB ꓑP ꓓD ꓔT ꓖG ꓗK ꓙJ ꓚC ꓜZ ꓝF ꓟM ꓠN ꓡL ꓢS ꓣR ꓦV ꓧH ꓪW ꓫX ꓬY ꓮA ꓰE ꓲI ꓳO ꓴU"
COPTIC = "ⲟo ⲣp ⲥc ⲎH ⲒI ⲔK ⲘM ⲚN ⲞO ⲢP ⲤC ⲦT ⲨY ⲬX"
LATIN_FORMS = "ɑa ɡg ıi ȷj"
# Hyphens that look like the plain one, and blanks and breaks.
HYPHENS = "‐‑﹣－"
BREAKS = "\r\x0b\x0c\x85  "
BLANKS = "\t\x1f\xa0              　"
# Ranges of characters that nothing is drawn for besides those of category Cf, and the signs of that category that are drawn.
IGNORABLE = ((0x34F, 0x34F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x2065, 0x2065), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0000, 0xE0FFF))
DRAWN = frozenset(map(chr, (*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD)))
#: Decompositions that change only width or form, not what is read.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<font>", "<isolated>", "<initial>", "<medial>", "<final>", "<compat>")

_TWINS = {name: dict(map(tuple, pairs.split())) for name, pairs in (("Cyrillic", CYRILLIC), ("Greek", GREEK), ("Armenian", ARMENIAN), ("Cherokee", CHEROKEE), ("Lisu", LISU), ("Coptic", COPTIC))}
_TO_LATIN = {k: v for twins in _TWINS.values() for k, v in twins.items()} | dict(map(tuple, LATIN_FORMS.split()))
# of several twins of a Latin letter the first listed
_FROM_LATIN = {name: {v: k for k, v in reversed(twins.items())} for name, twins in _TWINS.items()}
_SCRIPTS = {name: regex.compile(rf"\p{{Script_Extensions={name}}}") for name in ("Latin", *_TWINS, "Arabic", "Hebrew", "Devanagari", "Han", "Hiragana", "Katakana", "Hangul", "Thai", "Georgian", "Bengali", "Tamil")}


@lru_cache(maxsize=20_000)
def script_set(ch: str) -> frozenset[str]:
    """The scripts that a letter is used in or has the shape of a letter of; empty for signs of no script or of many."""
    own = {name for name, pattern in _SCRIPTS.items() if pattern.match(ch)}
    if not own and unicodedata.category(ch)[0] == "L":
        own = {unicodedata.name(ch, "unknown").split(" ", 1)[0].title()}
    if ch in _TO_LATIN:
        own.add("Latin")
    return frozenset(own | {name for name, back in _FROM_LATIN.items() if _TO_LATIN.get(ch, ch) in back} if "Latin" in own else own)


def _visible_fold(ch: str) -> str:
    """The characters that are read where ``ch`` stands; itself where it has a look of its own."""
    decomposition = unicodedata.decomposition(ch)
    tag, _, codes = decomposition.partition(" ")
    if tag not in SAME_LOOK or ch in _TO_LATIN:
        return ch
    folded = "".join(chr(int(c, 16)) for c in codes.split())
    if tag == "<compat>" and not (unicodedata.category(ch)[0] == "L" or "ROMAN NUMERAL" in unicodedata.name(ch, "")):
        return ch
    if tag == "<compat>" and not all(unicodedata.category(c)[0] in "LM" for c in folded):
        return ch
    return "".join(map(_visible_fold, folded))


class _Simple(dict):
    """Character map filled on demand: invisible, blank, break, hyphen, form."""

    def __missing__(self, code: int) -> str:
        ch = chr(code)
        if ch == "\n":
            out = ch
        elif ch in BREAKS:
            out = "\n"
        elif ch in BLANKS:
            out = " "
        elif ch in HYPHENS:
            out = "-"
        elif unicodedata.category(ch) in ("Cf", "Cc") and ch not in DRAWN or any(a <= code <= b for a, b in IGNORABLE):
            out = ""
        else:
            out = unicodedata.normalize("NFD", _visible_fold(ch))
        self[code] = out
        return out


_SIMPLE = _Simple()
_TOKEN = regex.compile(r"[\p{L}\p{M}]+")
_LOOK_ALIKES = frozenset(_TO_LATIN)


@lru_cache(maxsize=1)
def _joining() -> frozenset[str]:
    """Characters that may be composed with the one before: the second ones of canonical compositions, vowels and finals of Hangul."""
    seconds = {chr(int(codes[1], 16)) for c in range(0x110000) if (codes := unicodedata.decomposition(chr(c)).split()) and len(codes) == 2 and codes[0][0] != "<"}
    return frozenset(seconds | set(map(chr, (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)))))


def _changes(ch: str) -> bool:
    """Whether ``ch`` can come out as anything else, alone or through its neighbours."""
    return ch in _TO_LATIN or ch in _joining() or unicodedata.category(ch) == "Mn" and unicodedata.combining(ch) > 0 or unicodedata.normalize("NFC", ch) != ch or ch not in "\n " and _SIMPLE[ord(ch)] != unicodedata.normalize("NFD", ch)


@lru_cache(maxsize=1)
def _odd() -> re.Pattern:
    """Characters that may change; ideographs, syllable blocks and private areas of the basic plane never do."""
    codes = [c for c in (*range(0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F200), *range(0x2F800, 0x2FA20), *range(0x110BD, 0x110D0), *range(0xE0000, 0xE1000)) if _changes(chr(c))]
    runs: list[list[int]] = []
    for c in codes:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return re.compile("[" + "".join(f"{re.escape(chr(x))}-{re.escape(chr(y))}" for x, y in runs) + "]")


@lru_cache(maxsize=200_000)
def resolved_scripts(token: str) -> frozenset[str]:
    """The scripts that every letter of ``token`` belongs to or has the shape of; empty for a mixture."""
    sets = [own for c in token if unicodedata.category(c)[0] == "L" and (own := script_set(c))]
    return frozenset.intersection(*sets) if sets else frozenset()


@lru_cache(maxsize=200_000)
def respell(token: str) -> str:
    """``token`` (decomposed letters and marks) in one script: letters of another one give way to their twins.

    The script is Latin where all letters can be, else the one that all share;
    letters of that script stay.  A mixture that no script resolves has its
    look-alikes in Latin.
    """
    shared = resolved_scripts(token)
    if not shared or "Latin" in shared:
        return "".join(_TO_LATIN.get(c, c) for c in token)
    name = min(shared)
    back = _FROM_LATIN.get(name, {})
    return "".join(c if _SCRIPTS[name].match(c) else back.get(_TO_LATIN.get(c, c), c) for c in token) if name in _SCRIPTS else token


@lru_cache(maxsize=100_000)
def _piece_form(piece: str) -> str:
    folded = unicodedata.normalize("NFD", piece).translate(_SIMPLE)
    return unicodedata.normalize("NFC", _TOKEN.sub(lambda m: m[0] if _LOOK_ALIKES.isdisjoint(m[0]) else respell(m[0]), folded))


def visible_form(text: str | None) -> str | None:
    """The one form of ``text``; null stays null, and the form of a form is itself.

    Only the pieces between plain blanks that hold a character able to change
    are worked on.
    """
    if text is None or text.isascii() and text.isprintable():
        return text
    text = text.replace("\r\n", "\n")
    search, out, done = _odd().search, [], 0
    while found := search(text, done):
        at = found.start()
        start = max(text.rfind(" ", done, at) + 1, text.rfind("\n", done, at) + 1, done)
        ends = [e for e in (text.find(" ", at), text.find("\n", at)) if e >= 0]
        end = min(ends, default=len(text))
        out += (text[done:start], _piece_form(text[start:end]))
        done = end
    return "".join(out) + text[done:] if out else text


def token_scripts(token: str) -> str:
    """``single``, ``mixed`` (letters of several scripts) or ``look-alike`` (wholly spelt in twins of another script's letters)."""
    letters = [c for c in unicodedata.normalize("NFD", token) if unicodedata.category(c)[0] == "L"]
    real = [frozenset(n for n, p in _SCRIPTS.items() if p.match(c)) or script_set(c) for c in letters]
    if not letters:
        return "single"
    if not frozenset.intersection(*real):
        # kana stand beside ideographs
        return "single" if all(own & {"Han", "Hiragana", "Katakana"} for own in real) else "mixed"
    return "look-alike" if all("Latin" not in own for own in real) and all(c in _TO_LATIN for c in letters) else "single"


def _odd_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in batches:
        seen: Counter[str] = Counter()
        for text in part.column(0).to_pylist():
            if not text.isascii():
                seen.update(m for m in _TOKEN.findall(text) if not m.isascii())
        rows = [(t, kind, visible_form(t), n) for t, n in seen.items() if (kind := token_scripts(t)) != "single"]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["token", "kind", "spelling", "n"])


def confusable_tokens(df: DataFrame, column: str) -> DataFrame:
    """(token, kind, spelling, n): the tokens of ``column`` that mix scripts or are wholly spelt in look-alikes, with their one spelling; null texts have none."""
    texts = df.select(F.col(column).cast("string").alias("text")).where("text is not null")
    return texts.mapInArrow(_odd_tokens, "token string, kind string, spelling string, n bigint").groupBy("token", "kind", "spelling").agg(F.sum("n").alias("n"))


def _arrow(values: pa.Array) -> pa.Array:
    return pa.array([visible_form(v) for v in values.to_pylist()], pa.string())


def _udf() -> Column:
    return F.arrow_udf(_arrow, T.StringType())


def with_visible_form(df: DataFrame, column: str, form: str = "visible_form") -> DataFrame:
    """``df`` with the form of string ``column`` in ``form`` (which replaces a column of that name)."""
    return df.withColumn(form, _udf()(F.col(column).cast("string")))


def keyword_matches(mappings: DataFrame, lexicon: DataFrame, mapping_id: str = "mapping_id", keywords: str = "keywords", kw_id: str = "kw_id", keyword: str = "keyword") -> DataFrame:
    """(kw_id, mapping_id, pos) where an entry reads the same as a lexicon keyword but is another string.

    Null entries keep their place and match nothing; the empty string reads the
    same as the empty string only.  Equal entries are normalised once: the
    distinct entries are formed before the form is computed.
    """
    entries = mappings.select(F.col(mapping_id).alias("mapping_id"), F.posexplode(F.col(keywords)).alias("pos", "entry")).where("entry is not null")
    forms = with_visible_form(entries.select("entry").distinct(), "entry", "form")
    words = with_visible_form(lexicon.select(F.col(kw_id).alias("kw_id"), F.col(keyword).alias("word")).where("word is not null"), "word", "w_form")
    pairs = forms.join(words, F.col("form") == F.col("w_form")).where("entry <> word").select("entry", "kw_id")
    return entries.join(pairs, "entry").select("kw_id", "mapping_id", "pos").distinct()


def form_classes(chunks: DataFrame, chunk_id: str = "chunk_id", content: str = "content") -> DataFrame:
    """(form, spelling, id): 128-bit digests of form and content of each id, for the forms that have several spellings; one row for each."""
    base = chunks.select(F.col(chunk_id).cast("string").alias("id"), F.col(content).cast("string").alias("content")).where("id is not null and content is not null")
    digest = lambda c: F.unhex(F.md5(c))
    # written once: the form is the costly part, and both the count and the members need it
    forms = cut_table(with_visible_form(base, "content", "form").select("id", digest(F.col("content")).alias("spelling"), digest(F.col("form")).alias("form")))
    several = forms.groupBy("form").agg(F.min("spelling").alias("low"), F.max("spelling").alias("high")).where("low <> high").select("form")
    return forms.join(several, "form", "left_semi").select("form", "spelling", "id").distinct()


def same_looking(chunks: DataFrame, chunk_id: str = "chunk_id", content: str = "content") -> DataFrame:
    """(key_a, key_b): ids whose whole contents read the same without being the same string, key_a < key_b.

    Only digests are shuffled, and pairs are made only between different
    spellings of a form, never within a group of exact copies.  Where a form has
    very many ids, :func:`form_classes` says the same in one row for each.
    """
    members = form_classes(chunks, chunk_id, content)
    other = members.select(F.col("id").alias("key_b"), F.col("spelling").alias("other_spelling"), F.col("form"))
    return members.join(other, "form").where("id < key_b and spelling <> other_spelling").select(F.col("id").alias("key_a"), "key_b").distinct()
