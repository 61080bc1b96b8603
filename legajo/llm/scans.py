"""Repair of text from scanned pages.

Four things are found line by line: running headers and footers, printed page
numbers, words broken at line ends, and words with wrongly recognised letters.

* Headers: the letters of a line, numbers masked, are counted per source over
  lines at the edges of pages; what stands on a fifth of them is a header.
* Page numbers: number lines at page edges; the printed value less the known
  page number is a constant of the source, which is estimated from all its pages.
* Misread words: words are grouped by the skeleton that all confusable glyphs
  share.  A rare form that a common form of its group turns into under the known
  confusions is a misreading of it.  Where several forms could be meant, or the
  form is not much commoner, the words beside decide: the form that stands beside
  the same neighbours elsewhere is chosen.
* Broken words: the joined word must occur unbroken (or be a misreading of one
  that does); else a pair that keeps recurring is a compound that owns its hyphen.

The vocabulary is counted over all lines; only distinct words are compared.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from legajo.functions.session import cut_table

# What a glyph is misread as.
CONFUSIONS = {
    "e": ("c",), "m": ("rn",), "n": ("ri",), "d": ("cl",), "l": ("1", "i"), "o": ("0",), "u": ("ii",), "i": ("j", "1", "l"), "t": ("f",), "v": ("y",),
    "h": ("b",), "ó": ("6",), "í": ("1",), "ñ": ("fi",), "g": ("q",), "b": ("8",), "s": ("5",), "w": ("vv",), "z": ("2",),
    "rn": ("m",), "cl": ("d",),
}
# The same glyphs reduced to what all their readings have in common.
_SKELETON_TABLE = {"e": "c", "m": "rri", "n": "ri", "d": "ci", "0": "o", "ó": "o", "6": "o", "u": "ii", "1": "i", "l": "i", "j": "i", "í": "i", "f": "t", "y": "v", "w": "vv", "h": "b", "8": "b", "ñ": "ti", "q": "g", "5": "s", "2": "z"}
_SKELETON = str.maketrans(_SKELETON_TABLE)
MARKS = "-‐¬­"
#: Largest table of misread words that is broadcast; a larger one is joined by shuffle.
BROADCAST_WORDS = 300_000

_WORD = re.compile(r"[^\W_]+")
#: Lines from the top and the bottom of a page among which its header or footer stands.
EDGE_TOP, EDGE_BOTTOM = 2, 3
#: A correction needs a form this many times as common, or, with this share of its neighbours in support, that many times.
RATIO, CONTEXT_RATIO, CONTEXT_SHARE = 5.0, 2.0, 0.75
#: Digits of a page number.
PAGE_DIGITS = 9
_NUMBER = r"[0-9lIOoSB]*[0-9][0-9lIOoSB]*|[lIO]{1,3}|[ivxlcdmIVXLCDM]+"
_PAGE_LINE = re.compile(rf"(?P<open>[-–—\[(.~*|· ]*)(?:(?P<word>p[^\W\d_]{{0,7}})[.:]?\s*)?(?P<number>{_NUMBER})(?P<of>\s*(?:de|cle|dc|of|/)\s*[0-9lIOoSB]+)?(?P<close>[-–—\]).~*|· ]*)", re.IGNORECASE)
_STARTS = re.compile(r"\s*([^\W\d_]+)")
_NUMBER_WORD = re.compile(r"(?<![^\W_])[\dlIOoSB]+(?![^\W_])")
_TO_DIGIT = str.maketrans("lIOoSB", "110058")
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
_ROMAN_NUMBER = re.compile(r"(?=.)c{0,3}(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})", re.IGNORECASE)


def skeleton(word: str) -> str:
    """What ``word`` and all its misreadings have in common."""
    return word.lower().translate(_SKELETON)


_PAGE_WORDS = {skeleton(w) for w in ("p", "pág", "pag", "págs", "página", "pagina", "page", "pp")}


@lru_cache(maxsize=100_000)
def misread_of(true: str, seen: str) -> bool:
    """Whether ``seen`` comes from ``true`` by at least one known confusion and nothing else."""
    if true == seen:
        return False
    places: list[set[int]] = [set() for _ in range(len(true) + 1)]
    places[0] = {0}
    for i, ch in enumerate(true):
        for at in places[i]:
            for form in (ch, *CONFUSIONS.get(ch, ())):
                if seen.startswith(form, at):
                    places[i + 1].add(at + len(form))
            for form in CONFUSIONS.get(true[i : i + 2], ()) if i + 2 <= len(true) else ():
                if seen.startswith(form, at):
                    places[i + 2].add(at + len(form))
    return len(seen) in places[-1]


def _roman(text: str) -> int | None:
    values = [_ROMAN[c] for c in text.lower()]
    total = sum(-v if any(w > v for w in values[i + 1 : i + 2]) else v for i, v in enumerate(values))
    return total if 0 < total < 400 else None


def page_line(line: str) -> tuple[str, int] | None:
    """(style, value) of a line that could be nothing but a printed page number."""
    found = _PAGE_LINE.fullmatch(line.strip())
    if not found or len(found["number"]) > PAGE_DIGITS:
        return None
    number, word = found["number"], found["word"]
    if word and skeleton(word) not in _PAGE_WORDS:
        return None
    if any(c.isdigit() for c in number) or number in ("l", "ll", "I", "O", "lO", "lI", "Il", "II") and (word or found["open"].strip() or found["close"].strip()):
        value, kind = int(number.translate(_TO_DIGIT)), "digits"
    elif set(number.lower()) <= set(_ROMAN):
        roman = _roman(number)
        if roman is None:
            return None
        value, kind = roman, "roman"
    else:
        return None
    marked = "word" if word else "framed" if found["open"].strip() and found["close"].strip() else "dot" if found["close"].strip() else "bare"
    return f"{marked} {kind}", value


def head_key(line: str) -> str:
    """The words of a line as skeletons, numbers masked."""
    words = _WORD.findall(_NUMBER_WORD.sub(" ", line))
    for end in (0, -1):
        if len(words) > 1 and _ROMAN_NUMBER.fullmatch(words[end]):
            words.pop(end)
    return skeleton(" ".join(words))


def open_part(line: str) -> str | None:
    """The letters before a hyphen that ends ``line``."""
    line = line.rstrip()
    if not line or line[-1] not in MARKS:
        return None
    end = at = len(line) - 1
    while at and line[at - 1].isalpha():
        at -= 1
    return line[at:end] or None


def page_lines(content: str, anchors: list[dict] | None) -> list[tuple[int, str, int, int | None, int, int]]:
    """(line_no, text, region, page, from_top, from_bottom) of the non-blank lines; ranks count from 1 within a page."""
    spans = sorted((a["start_char"], a["end_char"], a["page_number"]) for a in anchors or () if a and a["start_char"] is not None and a["end_char"] is not None and a["end_char"] > a["start_char"]) if anchors else []
    out, offset, region = [], 0, 0
    for number, text in enumerate(content.split("\n"), 1):
        while region < len(spans) and offset >= spans[region][1]:
            region += 1
        if text.strip():
            inside = region < len(spans) and offset >= spans[region][0]
            out.append((number, text, region, spans[region][2] if inside else None))
        offset += len(text) + 1
    sizes: dict[int, int] = {}
    for row in out:
        sizes[row[2]] = sizes.get(row[2], 0) + 1
    seen: dict[int, int] = {}
    ranked = []
    for number, text, where, page in out:
        seen[where] = seen.get(where, 0) + 1
        ranked.append((number, text, where, page, seen[where], sizes[where] - seen[where] + 1))
    return ranked


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Evidence of a source's headers (kind h) and page numbers (kind n), and its number of pages (kind p)."""
    for part in batches:
        rows: list[tuple] = []
        for source, content, anchors in zip(*(c.to_pylist() for c in part.columns), strict=True):
            lines = page_lines(content, anchors)
            pages = len({row[2] for row in lines})
            rows.append((source, "p", "", None, pages))
            told: set[tuple[int, str]] = set()
            for _, text, region, page, top, bottom in lines:
                if top > EDGE_TOP and bottom > EDGE_BOTTOM:
                    continue
                number = page_line(text)
                if number:
                    rows.append((source, "n", number[0], None if page is None else number[1] - page, 1))
                elif (key := head_key(text)) and len(key) >= 5 and (region, key) not in told:
                    told.add((region, key))
                    rows.append((source, "h", key, None, 1))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64()), strict=True)], names=["source", "kind", "key", "shift", "n"])


def source_layout(chunks: DataFrame, share: float = 0.2) -> DataFrame:
    """(source, headers, style, shift): header keys and how pages are numbered, one row for each source.

    At most ``1 / share`` headers of an edge line can reach the share, so a
    row stays small however large its source.
    """
    evidence = chunks.select("source", "content", "anchors").mapInArrow(_edges, "source string, kind string, key string, shift int, n bigint")
    counts = cut_table(evidence.groupBy("source", "kind", "key", "shift").agg(F.sum("n").alias("n")))
    pages = counts.where("kind = 'p'").select("source", F.col("n").alias("pages"))
    headers = counts.where("kind = 'h' and n >= 2").join(pages, "source").where(F.col("n") >= F.col("pages") * share).groupBy("source").agg(F.collect_set("key").alias("headers"))
    numbering = counts.where("kind = 'n'").groupBy("source").agg(F.max_by(F.struct("key", "shift", "n"), F.struct("n", "key", "shift")).alias("best"))
    numbering = numbering.join(pages, "source").where((F.col("best.n") >= 2) & (F.col("best.n") >= F.col("pages") * 0.1)).select("source", F.col("best.key").alias("style"), F.col("best.shift").alias("shift"))
    return pages.select("source").join(headers, "source", "left").join(numbering, "source", "left")


def _line_kind(text: str, page: int | None, top: int, bottom: int, headers: set[str], style: str | None, shift: int | None) -> str:
    """``header``, ``page_number``, ``number`` (a line without words) or ``text``."""
    number = page_line(text)
    if number:
        form, value = number
        edge = min(top, bottom) <= (3 if page is not None or form[:4] in ("word", "fram") else 1)
        if edge and (form[:4] in ("word", "fram") or form == style and (page is None or shift is None or value - page == shift)):
            return "page_number"
        if page is None and form == style and form[:4] != "bare":
            return "page_number"
        return "number" if form.endswith("digits") else "text"
    key = head_key(text)
    if key in headers:
        return "header"
    return "text" if key else "number"


LINE_SCHEMA = "chunk_id string, source string, chunk_index int, line_no int, kind string, words array<string>, open_part string, first_part string, mark string"


def _kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in batches:
        out: list[list] = [[] for _ in range(9)]
        for chunk, source, index, content, anchors, headers, style, shift in zip(*(c.to_pylist() for c in part.columns), strict=True):
            known = set(headers or ())
            running: list[int] = []
            for number, text, _, page, top, bottom in page_lines(content, anchors):
                kind = _line_kind(text, page, top, bottom, known, style, shift)
                broken = open_part(text) if kind == "text" else None
                begins = _STARTS.match(text) if kind == "text" else None
                words = [w for w in _WORD.findall(text.lower()) if not w.isdigit()] if kind == "text" else []
                for column, value in zip(out, (chunk, source, index, number, kind, words, broken, begins[1] if begins else None, text.rstrip()[-1] if broken else None), strict=True):
                    column.append(value)
                if kind == "text":
                    running.append(len(out[0]) - 1)
        types = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["chunk_id", "source", "chunk_index", "line_no", "kind", "words", "open_part", "first_part", "mark"])


@F.pandas_udf(T.BooleanType())
def _comes_from(true: pd.Series, seen: pd.Series) -> pd.Series:
    return pd.Series([misread_of(a, b) for a, b in zip(true, seen, strict=True)])


def _skeleton_column(word: str) -> Column:
    """:func:`skeleton` of lower-case words, on the JVM."""
    single = {k: v for k, v in _SKELETON_TABLE.items() if len(v) == 1}
    out = F.translate(word, "".join(single), "".join(single.values()))
    # glyphs that read as several: none of their results is a key
    for glyph, reads in _SKELETON_TABLE.items():
        if len(reads) > 1:
            out = F.replace(out, F.lit(glyph), F.lit(reads))
    return out


def misread_pairs(counts: DataFrame) -> DataFrame:
    """(word, form, form_n, strong): every form that a word may be a misreading of, from (word, n, m): n unbroken and m broken occurrences.

    ``strong`` pairs differ enough in frequency; the others need support by their
    neighbours.  Forms with a digit among letters need only any commoner form.
    Every form of a skeleton is held against every commoner one; the inequality is
    part of the join, so rare forms do not meet each other.
    """
    forms = counts.where("n + m > 0").withColumn("skeleton", _skeleton_column("word"))
    common = forms.where("n >= 2").select("skeleton", F.col("word").alias("form"), F.col("n").alias("form_n"))
    mixed = F.col("word").rlike("[0-9]")
    strong = F.when(mixed, F.col("form_n") >= F.col("n")).otherwise((F.col("form_n") >= 3) & (F.col("form_n") >= RATIO * F.col("n")))
    pairs = forms.join(common, (forms["skeleton"] == common["skeleton"]) & (F.col("word") != F.col("form")) & (F.col("form_n") >= F.when(mixed, F.col("n")).otherwise(CONTEXT_RATIO * F.col("n"))))
    return pairs.select("word", "form", "form_n", strong.alias("strong")).where("strong or form_n >= 3").where(_comes_from(F.col("form"), F.col("word")))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_WORDS else df


def context_support(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """(word, form, support): the share of the neighbours of ``word`` beside which ``form`` stands elsewhere, from (word, form) and lines of words.

    Only pairs of words that are asked for are looked up.
    """
    # arrays_zip and not transform, which would leave the generated code
    beside = F.expr("arrays_zip(words, concat(array(cast(null as string)), words), slice(words, 2, size(words)))")
    doubted = _small(pairs.select("word").distinct())
    contexts = lines.where("size(words) > 0").select(F.explode(beside).alias("at")).select(F.col("at.words").alias("word"), F.col("at.1").alias("left"), F.col("at.2").alias("right")).join(doubted, "word").groupBy("word", "left", "right").agg(F.count("*").alias("times"))
    asked = cut_table(contexts.join(_small(pairs.select("word", "form")), "word"))
    wanted = asked.select(F.col("left").alias("a"), F.col("form").alias("b")).unionByName(asked.select(F.col("form").alias("a"), F.col("right").alias("b"))).where("a is not null and b is not null").distinct()
    couples = F.expr("arrays_zip(words, slice(words, 2, size(words)))")
    known = cut_table(lines.where("size(words) > 1").select(F.explode(couples).alias("at")).select(F.col("at.words").alias("a"), F.col("at.1").alias("b")).join(_small(wanted), ["a", "b"], "left_semi").distinct())
    before = known.select(F.col("a").alias("left"), F.col("b").alias("form"), F.lit(1).alias("has_left"))
    after = known.select(F.col("a").alias("form"), F.col("b").alias("right"), F.lit(1).alias("has_right"))
    met = asked.join(before, ["left", "form"], "left").join(after, ["form", "right"], "left")
    sides = F.sum(F.col("times") * (F.col("left").isNotNull().cast("int") + F.col("right").isNotNull().cast("int")))
    held = F.sum(F.col("times") * (F.coalesce("has_left", F.lit(0)) + F.coalesce("has_right", F.lit(0))))
    return met.groupBy("word", "form").agg(F.coalesce(F.try_divide(held, sides), F.lit(0.0)).alias("support"))


def misread_words(counts: DataFrame, lines: DataFrame) -> DataFrame:
    """(word, correction) for each misread word: its only strong form, else the one that its neighbours support, then the commonest."""
    pairs = cut_table(misread_pairs(counts))
    kinds = pairs.groupBy("word").agg(F.count("*").alias("forms"), F.max("strong").alias("any_strong"))
    doubtful = cut_table(pairs.join(kinds.where("forms > 1 or not any_strong"), "word").select("word", "form", "form_n", "strong"))
    sure = pairs.join(doubtful.select("word").distinct(), "word", "left_anti").select("word", F.col("form").alias("correction"))
    support = context_support(doubtful, lines)
    weighed = doubtful.join(support, ["word", "form"], "left").withColumn("support", F.coalesce("support", F.lit(0.0))).where(F.col("strong") | (F.col("support") >= CONTEXT_SHARE))
    chosen = weighed.groupBy("word").agg(F.max_by("form", F.struct("support", "form_n", "form")).alias("correction"))
    return sure.unionByName(chosen)


class ScanRepair:
    """The findings for a set of scanned chunks (chunk_id, source, chunk_index, content, anchors).

    Chunks with a null id, source or content take no part; a chunk delivered
    again counts once.  Null anchors make the whole chunk one page.
    """

    def __init__(self, chunks: DataFrame) -> None:
        base = chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), F.col("source").cast("string").alias("source"), F.col("chunk_index").cast("int").alias("chunk_index"), F.col("content").cast("string").alias("content"), "anchors")
        base = base.where("chunk_id is not null and source is not null and content is not null").dropDuplicates(["chunk_id"])
        self.chunks = cut_table(base)
        layout = source_layout(self.chunks)
        placed = self.chunks.join(layout, "source", "left").select("chunk_id", "source", "chunk_index", "content", "anchors", "headers", "style", "shift")
        self.lines = cut_table(placed.mapInArrow(_kinds, LINE_SCHEMA))
        self._broken()
        self._words()

    def _broken(self) -> None:
        """Pairs of a line with an open word and the running line that goes on, within a chunk or in the next."""
        running = self.lines.where("kind = 'text'")
        order = Window.partitionBy("chunk_id").orderBy("line_no")
        ordered = running.select("chunk_id", "source", "chunk_index", "line_no", "open_part", "mark", "first_part", F.lead("first_part").over(order).alias("next_part"), F.lead("line_no").over(order).alias("next_line"), F.lag("line_no").over(order).alias("before"))
        opened = ordered.where("open_part is not null").select("chunk_id", "source", "chunk_index", "line_no", "open_part", "mark", "next_part", "next_line")
        heads = ordered.where("before is null").select(F.col("source").alias("h_source"), (F.col("chunk_index") - 1).alias("h_index"), F.col("chunk_id").alias("h_chunk"), F.col("line_no").alias("h_line"), F.col("first_part").alias("h_part")).dropDuplicates(["h_source", "h_index"])
        inner = opened.where("next_line is not null").select("chunk_id", "line_no", "open_part", "mark", "next_part", F.col("chunk_id").alias("next_chunk"), "next_line")
        outer = opened.where("next_line is null").join(heads, (F.col("source") == F.col("h_source")) & (F.col("chunk_index") == F.col("h_index"))).select("chunk_id", "line_no", "open_part", "mark", F.col("h_part").alias("next_part"), F.col("h_chunk").alias("next_chunk"), F.col("h_line").alias("next_line"))
        pairs = inner.unionByName(outer).where(F.col("next_part").rlike(r"^\p{Ll}"))
        self.breaks = cut_table(pairs.withColumn("joined", F.lower(F.concat("open_part", "next_part"))))

    def _words(self) -> None:
        """Counts of unbroken words, the misread ones, and which breaks are hyphenation."""
        parts = self.breaks.select("chunk_id", "line_no", F.lit(1).alias("tail")).unionByName(self.breaks.select(F.col("next_chunk").alias("chunk_id"), F.col("next_line").alias("line_no"), F.lit(0).alias("tail")))
        ends = parts.groupBy("chunk_id", "line_no").agg(F.max("tail").alias("tail"), F.max(1 - F.col("tail")).alias("head"))
        text = self.lines.where("kind = 'text'").select("chunk_id", "line_no", "words")
        trimmed = text.join(ends, ["chunk_id", "line_no"], "left")
        whole = F.expr("slice(words, 1 + least(coalesce(head, 0), size(words)), greatest(size(words) - coalesce(head, 0) - coalesce(tail, 0), 0))")
        self.whole = cut_table(trimmed.select("chunk_id", "line_no", whole.alias("words")))
        plain = self.whole.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
        joined = self.breaks.groupBy(F.col("joined").alias("word")).agg(F.count("*").alias("m"))
        counts = cut_table(plain.join(joined, "word", "full").select("word", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("m", F.lit(0)).alias("m")))
        self.misread = cut_table(misread_words(counts, self.whole))
        pairs = self.breaks.groupBy("open_part", "next_part").agg(F.count("*").alias("times"), F.first("joined").alias("joined"), F.max(F.col("mark").isin("¬", "­")).alias("soft"))
        known = counts.where("n > 0").select(F.col("word").alias("joined"), F.lit(True).alias("known"))
        fixed = self.misread.select(F.col("word").alias("joined"), F.lit(True).alias("fixed"))
        left = counts.where("n > 0").select(F.col("word").alias("l_word"), F.lit(True).alias("l_known"))
        right = counts.where("n > 0").select(F.col("word").alias("r_word"), F.lit(True).alias("r_known"))
        judged = pairs.join(known, "joined", "left").join(fixed, "joined", "left").join(left, F.lower("open_part") == F.col("l_word"), "left").join(right, F.lower("next_part") == F.col("r_word"), "left")
        one_word = F.col("known").isNotNull() | F.col("fixed").isNotNull()
        recurring = (F.col("times") >= 2) | (F.col("l_known").isNotNull() & F.col("r_known").isNotNull())
        self.compounds = judged.where(~one_word & recurring & ~F.col("soft")).select("open_part", "next_part")

    def hyphens(self) -> DataFrame:
        """Breaks that are hyphenation."""
        return self.breaks.join(self.compounds, ["open_part", "next_part"], "left_anti")

    def misreadings(self) -> DataFrame:
        """(chunk_id, line_no, seen, correction): parts of words to put right, line by line."""
        bad = _small(self.misread)
        inside = self.whole.select("chunk_id", "line_no", F.explode(F.array_distinct("words")).alias("word")).join(bad, "word").select("chunk_id", "line_no", F.col("word").alias("seen"), "correction")
        across = self.hyphens().join(bad.select(F.col("word").alias("joined"), "correction"), "joined")
        left, right = F.lower("open_part"), F.lower("next_part")
        starts = across.where(~F.col("correction").startswith(left)).select("chunk_id", "line_no", left.alias("seen"), F.expr("left(correction, length(correction) - length(next_part))").alias("correction"))
        ends = across.where(~F.col("correction").endswith(right)).select(F.col("next_chunk").alias("chunk_id"), F.col("next_line").alias("line_no"), right.alias("seen"), F.expr("substring(correction, length(open_part) + 1)").alias("correction"))
        halves = self.breaks.join(self.compounds, ["open_part", "next_part"], "left_semi")
        halves = halves.select("chunk_id", "line_no", left.alias("word")).unionByName(halves.select(F.col("next_chunk").alias("chunk_id"), F.col("next_line").alias("line_no"), right.alias("word")))
        apart = halves.join(bad, "word").select("chunk_id", "line_no", F.col("word").alias("seen"), "correction")
        return inside.unionByName(starts).unionByName(ends).unionByName(apart)

    def found(self) -> DataFrame:
        """(chunk_id, line_no, kind) with kind hyphen, misread, header or page_number."""
        placed = self.lines.where("kind in ('header', 'page_number')").select("chunk_id", "line_no", "kind")
        broken = self.hyphens().select("chunk_id", "line_no", F.lit("hyphen").alias("kind"))
        wrong = self.misreadings().select("chunk_id", "line_no", F.lit("misread").alias("kind"))
        return placed.unionByName(broken).unionByName(wrong).distinct()

    def paragraphs(self) -> DataFrame:
        """(chunk_id, paragraph_no, text): running text with corrections, hyphenation undone, reflowed by windows."""
        lines = self.chunks.select("chunk_id", F.posexplode(F.split("content", "\n", -1)).alias("at", "text")).withColumn("line_no", F.col("at") + 1)
        lines = lines.join(self.lines.select("chunk_id", "line_no", "kind"), ["chunk_id", "line_no"], "left").where("kind is null or kind in ('text', 'number')")
        fixes = self.misreadings().groupBy("chunk_id", "line_no").agg(F.collect_set(F.struct("seen", "correction")).alias("fixes"))
        open_ = self.hyphens().select("chunk_id", "line_no", F.lit(True).alias("goes_on"))
        lines = lines.join(fixes, ["chunk_id", "line_no"], "left").join(open_, ["chunk_id", "line_no"], "left").withColumn("text", _put_right("text", "fixes"))
        order = Window.partitionBy("chunk_id").orderBy("line_no")
        blank = F.trim("text") == ""
        numbered = lines.withColumn("closed", F.lag("text").over(order).rlike(r"[.!?:;…»”)\]]\s*$")).withColumn("breaks", F.when(blank & F.coalesce("closed", F.lit(True)), 1).otherwise(0))
        numbered = numbered.withColumn("paragraph", F.sum("breaks").over(order)).where(~blank)
        body = F.when(F.col("goes_on"), F.regexp_replace("text", rf"[{MARKS}]\s*$", "")).otherwise(F.concat(F.trim("text"), F.lit(" ")))
        grouped = numbered.groupBy("chunk_id", "paragraph").agg(F.sort_array(F.collect_list(F.struct("line_no", body.alias("text")))).alias("parts"))
        text = F.trim(F.array_join(F.transform("parts", lambda p: p["text"]), ""))
        return grouped.select("chunk_id", F.row_number().over(Window.partitionBy("chunk_id").orderBy("paragraph")).alias("paragraph_no"), text.alias("text"))


@F.pandas_udf(T.StringType())
def _put_right(text: pd.Series, fixes: pd.Series) -> pd.Series:
    out = []
    for line, pairs in zip(text, fixes, strict=True):
        for pair in () if pairs is None else pairs:
            seen, right = pair["seen"], pair["correction"]
            line = re.sub(rf"(?<![^\W_]){re.escape(seen)}(?![^\W_])", lambda m, r=right: r.upper() if m[0].isupper() and len(m[0]) > 1 else r.capitalize() if m[0][:1].isupper() else r, line, flags=re.IGNORECASE)
        out.append(line)
    return pd.Series(out, dtype=object)
