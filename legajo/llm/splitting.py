"""Cutting oversized texts into overlapping pieces at natural boundaries.

A token is a maximal run of characters that are not white space.  Boundaries
form a hierarchy: section, paragraph, line, sentence, word, character.  A range
that is too long is split at the highest level that has a boundary inside, each
part again likewise; the resulting units are packed greedily, and every piece
after the first begins with the last ``overlap`` tokens of the one before.

A piece has a limit of characters as well, where one is given, so that texts in
scripts without blanks, and runs of characters without one, are cut too: at the
sentence ends within them, then between characters, never before a combining
mark.  There each character counts as a token of the overlap.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legajo.functions.session import WHITE

_BLANK = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_TOKEN = re.compile(f"[^{_BLANK}]+")
_HEADING = re.compile(r"(?:#{1,6} |(?:cap[íi]tulo|t[íi]tulo|art[íi]culo|secci[óo]n|chapter|section|anexo)\b|\d+(?:\.\d+)+\.? |[IVXLC]+\. )", re.IGNORECASE)
_SENTENCE_END = re.compile(r"[.!?…。！？؟।॥][\"'»”’」』）)\]]*$")
SECTION, PARAGRAPH, LINE, SENTENCE, WORD, CHARACTER = range(6)
#: Characters that a token of the limit stands for in the limit of characters.
CHARS_PER_TOKEN = 16
# what may end a sentence with what closes after it: ideographic marks anywhere, others before white space; then lines and blanks
_CUT = re.compile(f"(?P<sentence>[。！？।॥][\"'»”’」』）)\\]]*|[.!?…؟]+[\"'»”’」』）)\\]]*(?=[{_BLANK}]))|(?P<line>[^\\S\\n]*\\n\\s*)|(?P<word>[{_BLANK}]+)")

PIECE_SCHEMA = "piece_no int, n_pieces int, start_char int, end_char int, n_tokens int, text string"
_PIECE = pa.struct([("piece_no", pa.int32()), ("n_pieces", pa.int32()), ("start_char", pa.int32()), ("end_char", pa.int32()), ("n_tokens", pa.int32()), ("text", pa.string())])


def token_count(text: Column) -> Column:
    """Number of maximal runs of characters that are not white space."""
    return F.regexp_count(text, F.lit(f"[^{WHITE}]+"))


def effective_overlap(max_tokens: Column, tokens: Column, ratio: Column) -> Column:
    """Overlap in tokens: the number if it is positive, else the ratio of the limit, else none; always below the limit."""
    wanted = F.when(tokens > 0, tokens).when(ratio > 0, F.floor(ratio * max_tokens)).otherwise(0)
    return F.greatest(F.lit(0), F.least(wanted, max_tokens - 1)).cast("int")


def _gap_levels(text: str, spans: list[tuple[int, int]]) -> list[int]:
    """For each gap between tokens the highest boundary there; gap i stands before token i."""
    levels = [WORD] * len(spans)
    for i in range(1, len(spans)):
        gap = text[spans[i - 1][1] : spans[i][0]]
        if "\n" in gap:
            if _HEADING.match(text, spans[i][0]):
                levels[i] = SECTION
            else:
                levels[i] = PARAGRAPH if gap.count("\n") > 1 else LINE
        elif _SENTENCE_END.search(text, spans[i - 1][0], spans[i - 1][1]):
            levels[i] = SENTENCE
    return levels


def _units(levels: list[int], low: int, high: int, limit: int) -> list[tuple[int, int]]:
    """Ranges of at most ``limit`` tokens that follow the hierarchy, in order."""
    out, todo = [], [(low, high, SECTION)]
    while todo:
        a, b, level = todo.pop()
        if b - a <= limit:
            out.append((a, b))
        elif level >= WORD:
            out += [(i, min(i + limit, b)) for i in range(a, b, limit)]
        else:
            cuts = [a, *(i for i in range(a + 1, b) if levels[i] <= level), b]
            todo += reversed([(x, y, level + 1) for x, y in zip(cuts, cuts[1:])])
    return out


def _is_mark(ch: str) -> bool:
    """Whether ``ch`` belongs to the character before it."""
    return unicodedata.category(ch)[0] == "M" or ch in "\u200c\u200d"


def _char_cuts(text: str, a: int, b: int) -> dict[int, int]:
    """Level of each place in ``text[a:b]`` that is more than one between characters."""
    cuts: dict[int, int] = {}
    for m in _CUT.finditer(text, a, b):
        if m.lastgroup == "line":
            level = SECTION if _HEADING.match(text, m.end()) else PARAGRAPH if m[0].count("\n") > 1 else LINE
        else:
            level = SENTENCE if m.lastgroup == "sentence" else WORD
        cuts[m.end()] = min(level, cuts.get(m.end(), CHARACTER))
    return cuts


def split_chars(text: str, a: int, b: int, max_chars: int, overlap: int, preserve: bool) -> list[tuple[int, int]]:
    """Ranges of at most ``max_chars`` characters that cover ``text[a:b]``, each after the first reaching ``overlap`` characters back."""
    if b - a <= max_chars:
        return [(a, b)]
    overlap = min(overlap, max_chars - 1)
    fresh = max_chars - overlap
    cuts = _char_cuts(text, a, b) if preserve else {}
    units: list[int] = []
    todo = [(a, b, SECTION)]
    while todo:
        low, high, level = todo.pop()
        if high - low <= fresh:
            units.append(high)
        elif level >= CHARACTER:
            while high - low > fresh:
                end = low + fresh
                while end > low + 1 and _is_mark(text[end]):
                    end -= 1
                low = end if not _is_mark(text[end]) else low + fresh
                units.append(low)
            units.append(high)
        else:
            own = [low, *(p for p, at in cuts.items() if low < p < high and at <= level), high]
            todo += reversed([(x, y, level + 1) for x, y in zip(own, own[1:])])
    ends: list[int] = []
    begin = a
    for i, end in enumerate(units):
        if i + 1 == len(units) or units[i + 1] - begin > max_chars:
            ends.append(end)
            begin = end - overlap
    return list(zip([a, *(e - overlap for e in ends[:-1])], ends, strict=True))


def split_tokens(text: str, max_tokens: int, overlap: int, preserve: bool, max_chars: int | None = None) -> list[tuple[int, int, int]]:
    """(start_char, end_char, n_tokens) of each piece of ``text``; the pieces cover every token."""
    pieces = _by_tokens(text, max_tokens, overlap, preserve)
    if max_chars is None or all(b - a <= max_chars for a, b, _ in pieces):
        return pieces
    out = []
    for a, b, n in pieces:
        parts = split_chars(text, a, b, max_chars, overlap, preserve)
        out += [(a, b, n)] if len(parts) == 1 else [(x, y, len(_TOKEN.findall(text, x, y))) for x, y in parts]
    return out


def _by_tokens(text: str, max_tokens: int, overlap: int, preserve: bool) -> list[tuple[int, int, int]]:
    spans = [m.span() for m in _TOKEN.finditer(text)]
    if len(spans) <= max_tokens:
        return [(0, len(text), len(spans))]
    fresh = max_tokens - overlap
    if preserve:
        units = _units(_gap_levels(text, spans), 0, len(spans), fresh)
    else:
        units = [(i, min(i + fresh, len(spans))) for i in range(max_tokens, len(spans), fresh)]
        units = [(0, max_tokens), *units]
    ends: list[int] = []
    begin = 0
    for i, (_, end) in enumerate(units):
        following = units[i + 1][1] if i + 1 < len(units) else None
        if following is None or following - begin > max_tokens:
            ends.append(end)
            begin = end - overlap
    starts = [0, *(e - overlap for e in ends[:-1])]
    return [(spans[a][0], spans[b - 1][1], b - a) for a, b in zip(starts, ends, strict=True)]


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in batches:
        rows: list[list] = [[] for _ in range(8)]
        for key, text, limit, overlap, preserve, chars in zip(*(c.to_pylist() for c in part.columns), strict=True):
            pieces = split_tokens(text, limit, overlap, preserve, chars)
            for i, (a, b, n) in enumerate(pieces):
                for column, value in zip(rows, (key, limit, i, len(pieces), a, b, n, text[a:b]), strict=True):
                    column.append(value)
        types = (pa.string(), pa.int32(), *(f.type for f in _PIECE))
        names = ("chunk_id", "max_tokens", *(f.name for f in _PIECE))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=list(names))


def split_oversized(chunks: DataFrame, config: DataFrame, chunk_id: str = "chunk_id", content: str = "content", config_id: str = "config_id", keep_fitting: bool = True, chars_per_token: int | None = CHARS_PER_TOKEN) -> DataFrame:
    """Pieces (chunk_id, max_tokens, piece_no, n_pieces, start_char, end_char, n_tokens, text) of each chunk.

    A chunk within its limit, or whose configuration is missing, null or not
    positive, is one piece, its whole content (left out without
    ``keep_fitting``).  Null contents and null ids give no rows.  A chunk
    delivered again with the same content and configuration is cut once.  A
    piece has at most ``chars_per_token`` characters for each token of its limit;
    None sets no limit of characters.  The counts run on the JVM; only oversized
    texts go to Python.
    """
    limits = config.select(F.col("config_id").alias("c_id"), F.col("max_tokens").cast("int").alias("max_tokens"), F.col("overlap_tokens").alias("c_tokens"), F.col("overlap_ratio").alias("c_ratio"), F.col("preserve_boundaries").alias("c_keep"))
    limits = limits.select("c_id", "max_tokens", effective_overlap(F.col("max_tokens"), F.col("c_tokens"), F.col("c_ratio")).alias("overlap"), F.coalesce("c_keep", F.lit(False)).alias("keep")).dropDuplicates(["c_id"])
    base = chunks.select(F.col(chunk_id).cast("string").alias("chunk_id"), F.col(content).cast("string").alias("content"), F.col(config_id).alias("c_id")).where("chunk_id is not null and content is not null")
    sized = base.join(limits, "c_id", "left").withColumn("n", token_count(F.col("content")))
    chars = (F.col("max_tokens") * chars_per_token if chars_per_token else F.lit(None)).cast("int")
    over = F.coalesce((F.col("max_tokens") > 0) & ((F.col("n") > F.col("max_tokens")) | F.coalesce(F.length("content") > chars, F.lit(False))), F.lit(False))
    large = sized.where(over).select("chunk_id", "content", "max_tokens", "overlap", "keep", chars.alias("chars"))
    pieces = large.mapInArrow(_split, f"chunk_id string, max_tokens int, {PIECE_SCHEMA}").dropDuplicates(["chunk_id", "max_tokens", "piece_no", "start_char", "end_char"])
    if not keep_fitting:
        return pieces
    whole = sized.where(~over).select("chunk_id", "max_tokens", F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("start_char"), F.length("content").alias("end_char"), F.col("n").alias("n_tokens"), F.col("content").alias("text"))
    return pieces.unionByName(whole.dropDuplicates(["chunk_id", "max_tokens"]))


def oversized_chunks(chunks: DataFrame, config: DataFrame) -> DataFrame:
    """(chunk_id) of the chunks that the splitter cuts into more than one piece by their tokens."""
    return split_oversized(chunks, config, keep_fitting=False, chars_per_token=None).where("n_pieces > 1").select("chunk_id").distinct()
