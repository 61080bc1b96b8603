"""Passages and lines repeated excessively within a source, found by content-defined chunking.

The letters of a text, without case, are cut where a rolling hash over the last
few letters hits a fixed pattern, so that a piece depends on the text alone and
not on where a line or a text begins.  Distinct documents are counted per piece
and source, and the pieces that reach the threshold are what is repeated.

* :func:`without_repeated_passages` cuts the repeated pieces themselves, across
  line ends and inside lines.
* :func:`repeated_lines` answers by line: a line's end is one more place to cut,
  the outer pieces of a line are told from inner ones, and a line is repeated if
  all its pieces are.  For a line of one piece the piece's documents are the
  line's; for longer ones the documents of the whole sequence are counted too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legajo.functions.session import cut_table

#: Letters seen by the rolling hash, and the mask that its value must clear for a cut (one letter in 16 on average).
WINDOW, MASK = 6, np.uint64(15)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_NOT_LETTER = regex.compile(r"[^\p{L}\n]+")
#: Most frequent pieces that are broadcast; more are joined by shuffle.
BROADCAST_PIECES = 200_000
#: Letters that a run of repeated pieces must have to be cut from within a line.
LEAST_LETTERS = 24
_LETTER_RUN = regex.compile(r"\p{L}+")
_WORD_EDGE = re.compile(r"\s")
LINE_SCHEMA = "chunk_id string, source string, line_no int, line_key bigint, pieces array<bigint>"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def letters_only(text: str) -> str:
    """``text`` without case and without anything but letters and line feeds."""
    return _NOT_LETTER.sub("", text.lower())


def _cut(codes: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, hash) of the pieces of the letters ``codes``; ``breaks`` marks signs that part pieces and belong to none."""
    with np.errstate(over="ignore"):
        scrambled = _mix(codes * _BASE)
        rolling = scrambled.copy()
        power = np.uint64(1)
        for back in range(1, WINDOW):
            power = power * _BASE
            rolling[back:] += scrambled[:-back] * power
        position = np.arange(len(codes))
        start = np.maximum.accumulate(np.where(np.r_[True, breaks[:-1]], position, 0))
        cut = ((_mix(rolling) & MASK) == 0) & (position - start >= WINDOW)  # the window lies between breaks
        starts = np.r_[True, (cut | breaks)[:-1]] & ~breaks
        begin = np.flatnonzero(starts)
        if not len(begin):
            return begin, np.empty(0, np.uint64)
        # a piece's hash: the sum over its letters of a mix of letter and place
        index = np.cumsum(starts) - 1
        place = (position - begin[np.maximum(index, 0)]).astype(np.uint64)
        terms = np.where(breaks, np.uint64(0), _mix(scrambled + _mix(place * _BASE + np.uint64(1))))
        return begin, np.add.reduceat(terms, begin)


def _codes(letters: str) -> np.ndarray:
    return np.frombuffer(letters.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)


def cut_lines(letters: str) -> tuple[np.ndarray, np.ndarray]:
    """The line of each piece and its hash, for a string of letters and line feeds; the first and the last piece of a line have hashes of their own."""
    codes = _codes(letters)
    if not len(codes):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    feed = codes == 10
    begin, hashes = _cut(codes, feed)
    line = (np.cumsum(feed) - feed)[begin]
    first, last = np.r_[True, line[1:] != line[:-1]][: len(line)], np.r_[line[1:] != line[:-1], True][: len(line)]
    with np.errstate(over="ignore"):
        return line, hashes ^ _mix(first * np.uint64(0x51) + last * np.uint64(0xA7))


def cut_text(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of the pieces of a whole text: line feeds and all that is no letter count for nothing, spans are characters of ``text``."""
    runs = [(m.start(), m.end()) for m in _LETTER_RUN.finditer(text)]
    if not runs:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    places = np.concatenate([np.arange(a, b) for a, b in runs])
    # letters whose small form is several characters keep their own
    codes = _codes("".join(low if len(low := c.lower()) == 1 else c for a, b in runs for c in text[a:b]))
    begin, hashes = _cut(codes, np.zeros(len(codes), bool))
    ends = np.r_[begin[1:], len(codes)] - 1
    return places[begin], places[ends] + 1, hashes


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for part in batches:
        ids, sources, texts = (c.to_pylist() for c in part.columns)
        chunk_ids: list[str] = []
        owners: list[str] = []
        numbers: list[np.ndarray] = []
        keys: list[int] = []
        lengths: list[np.ndarray] = []
        values: list[np.ndarray] = []
        for chunk, source, text in zip(ids, sources, texts, strict=True):
            letters = letters_only(text)
            line, hashes = cut_lines(letters)
            if not len(line):
                continue
            bounds = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
            own = line[bounds]
            keyed = letters.split("\n")  # letters_only drops no line feed, so line numbers are those of the text
            keys += [xxhash.xxh3_64_intdigest(keyed[at]) for at in own.tolist()]
            chunk_ids += [chunk] * len(own)
            owners += [source] * len(own)
            numbers.append(own + 1)
            lengths.append(np.diff(np.r_[bounds, len(line)]))
            values.append(hashes.view(np.int64))
        join = lambda arrays, kind: np.concatenate(arrays).astype(kind) if arrays else np.empty(0, kind)
        offsets = np.r_[0, join(lengths, np.int64).cumsum()].astype(np.int32)
        columns = [pa.array(chunk_ids, pa.string()), pa.array(owners, pa.string()), pa.array(join(numbers, np.int32)), pa.array(np.array(keys, np.uint64).view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(join(values, np.int64)))]
        yield pa.RecordBatch.from_arrays(columns, names=["chunk_id", "source", "line_no", "line_key", "pieces"])


def _known(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), F.col("source").cast("string").alias("source"), F.col("content").cast("string").alias("content")).where("chunk_id is not null and source is not null and content is not null")


def _least(known: DataFrame, min_documents: int, min_share: float) -> DataFrame:
    """(source, least): distinct documents from which something is repeated excessively."""
    sizes = known.groupBy("source", "chunk_id").agg(F.count("*").alias("n")).groupBy("source").agg(F.count("*").alias("documents"))
    return sizes.select("source", F.greatest(F.lit(float(min_documents)), F.col("documents") * F.lit(min_share)).alias("least"))


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_PIECES else df


def repeated_pieces(rows: DataFrame, least: DataFrame, min_documents: int = 5) -> DataFrame:
    """(source, piece, documents) of the pieces in enough distinct documents, from (chunk_id, source, pieces).

    Rows are counted first, by partial aggregates: they are never fewer than the
    documents, so only pieces that reach the threshold by rows are counted by
    distinct documents, over (source, piece, chunk_id), which no hot piece skews.
    """
    by_rows = rows.select("source", F.explode(F.array_distinct("pieces")).alias("piece")).groupBy("source", "piece").agg(F.count("*").alias("seen")).where(f"seen >= {min_documents}")
    often = cut_table(by_rows.join(least, "source").where("seen >= least").select(_place().alias("place")))
    at = rows.select("chunk_id", "source", F.explode(F.array_distinct("pieces")).alias("piece")).withColumn("place", _place()).join(_few(often), "place", "left_semi")
    documents = at.groupBy("source", "piece", "chunk_id").agg(F.lit(1)).groupBy("source", "piece").agg(F.count("*").alias("documents"))
    return documents.join(least, "source").where("documents >= least").select("source", "piece", "documents")


def _place() -> Column:
    """Source and piece as one number, so that what is broadcast is one number for each repeated piece."""
    return F.xxhash64("source", "piece")


def repeated_lines(chunks: DataFrame, min_documents: int = 5, min_share: float = 0.1) -> DataFrame:
    """(chunk_id, line_no) of lines whose letters stand in at least ``min_documents`` and ``min_share`` of a source's chunks.

    ``chunks`` has chunk_id, source and content; chunks delivered again count
    once.  Rows with a null id, source or content take no part.  Lines without
    letters are never found.
    """
    known = _known(chunks)
    least = cut_table(_least(known, min_documents, min_share))
    lines = cut_table(known.mapInArrow(_lines, LINE_SCHEMA))
    pieces = cut_table(repeated_pieces(lines, least, min_documents).select(_place().alias("place")))
    inside = lines.select("chunk_id", "source", "line_no", "line_key", F.size(F.array_distinct("pieces")).alias("n"), F.explode(F.array_distinct("pieces")).alias("piece")).withColumn("place", _place()).join(_few(pieces), "place", "left_semi")
    # a chunk delivered again has its lines twice, so pieces are told apart
    whole = inside.groupBy("chunk_id", "source", "line_no", "line_key", "n").agg(F.count_distinct("piece").alias("held")).where("held = n")
    single = whole.where("n = 1").select("chunk_id", "line_no")
    several = whole.where("n > 1")
    documents = several.groupBy("source", "line_key", "chunk_id").agg(F.lit(1)).groupBy("source", "line_key").agg(F.count("*").alias("documents"))
    reached = documents.join(least, "source").where("documents >= least").select("source", "line_key")
    return single.unionByName(several.join(reached, ["source", "line_key"], "left_semi").select("chunk_id", "line_no")).distinct()


def without_repeated_lines(chunks: DataFrame, min_documents: int = 5, min_share: float = 0.1) -> DataFrame:
    """(chunk_id, content, removed): each distinct chunk's content without the lines of :func:`repeated_lines`.

    Rows with a null id, source or content pass unchanged.
    """
    base = chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), F.col("source").cast("string").alias("source"), F.col("content").cast("string").alias("content")).distinct()
    gone = repeated_lines(base, min_documents, min_share).groupBy("chunk_id").agg(F.collect_set("line_no").alias("numbers"))
    kept = F.expr("filter(split(content, '\\n', -1), (l, i) -> not array_contains(numbers, i + 1))")
    return base.join(gone, "chunk_id", "left").select("chunk_id", F.when(F.col("numbers").isNull(), F.col("content")).otherwise(F.array_join(kept, "\n")).alias("content"), F.coalesce(F.size("numbers"), F.lit(0)).alias("removed"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in batches:
        hashes = [cut_text(text)[2].view(np.int64) for text in part.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(hashes, pa.list_(pa.int64()))], names=["chunk_id", "source", "pieces"])


def cut_out(text: str, repeated: set[int], least_letters: int = LEAST_LETTERS) -> tuple[str, int]:
    """``text`` without its runs of repeated pieces of at least ``least_letters`` letters, and the number of runs.

    A run is cut from the first to the last word that lies wholly in it, since a
    piece may begin and end within a word that goes on otherwise.
    """
    start, end, hashes = cut_text(text)
    hit = np.fromiter((h in repeated for h in hashes.view(np.int64).tolist()), bool, len(hashes))
    out, done, cuts = [], 0, 0
    edges = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
    for a, b in zip(edges[::2], edges[1::2]):
        left, right = int(start[a]), int(end[b - 1])
        if left and text[left - 1].isalpha():
            space = _WORD_EDGE.search(text, left, right)
            left = space.end() if space else right
        if right < len(text) and text[right].isalpha():
            right = max((m.start() for m in _WORD_EDGE.finditer(text, left, right)), default=left)
        if sum(c.isalpha() for c in text[left:right]) >= least_letters:
            out.append(text[done:left])
            done, cuts = right, cuts + 1
    return "".join(out) + text[done:], cuts


def without_repeated_passages(chunks: DataFrame, min_documents: int = 5, min_share: float = 0.1, least_letters: int = LEAST_LETTERS) -> DataFrame:
    """(chunk_id, content, removed): each distinct chunk's content without the passages that its source repeats, wherever its lines end.

    Rows with a null id, source or content take no part.
    """
    known = _known(chunks).distinct()
    least = cut_table(_least(known, min_documents, min_share))
    rows = cut_table(known.mapInArrow(_pieces, "chunk_id string, source string, pieces array<bigint>"))
    pieces = repeated_pieces(rows, least, min_documents).select("source", "piece")
    held = rows.select("chunk_id", "source", F.explode(F.array_distinct("pieces")).alias("piece")).join(pieces, ["source", "piece"], "left_semi").groupBy("chunk_id", "source").agg(F.collect_set("piece").alias("held"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            done = [cut_out(text, set(own or ()), least_letters) for text, own in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int32())], names=["chunk_id", "content", "removed"])

    return known.join(held, ["chunk_id", "source"], "left").select("chunk_id", "content", "held").mapInArrow(cut, "chunk_id string, content string, removed int")
