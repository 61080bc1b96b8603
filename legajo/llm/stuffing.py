"""Pages of repeated keywords, links, menus or tags instead of sentences.

A text is cut into clauses (at line ends, sentence ends and list separators).
Characters are counted as spam where a clause

* is mostly links (link-text ratio), hash tags, or prices with a code,
* is a menu: short items without function words between separators,
* is a short item that stands again and again (duplicate share),
* stands in a run of list items that are phrases, neither names nor numbers;
* is covered by the text's own dominant phrases (top-word and n-gram shares) and
  lacks function words outside them.

The measures are calibrated per language on all texts: function words are
learnt from the corpus for every script and language without a list (words in
many documents that do not stand last in a clause), "lacks" is less than a part
of the language's median share of function words, and what is dominant or
repeated is a multiple of what the commonest phrase and the commonest item
usually take of a text in that language.  A page is spam if more than half of its
characters are.

Each text is read once: characters are counted in cells (share of the item, share
of the phrases that cover the clause, share of function words), and the
calibrated limits pick the cells.  Scripts without blanks are read by character.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from legajo.functions.session import cut_table

# Commonest function words of each language.
FUNCTION_WORDS = {
    "es": "a al ante aunque como con cuando de del desde durante e el en entre es está esta este fue ha hacia hasta la las le lo los más no o para pero por porque que qué se según ser si sin sobre son su sus también un una y".split(),
    "en": "a an and are as at be between by for from has have in is it its no not of on or still that the their this to was were when why will with".split(),
    "pt": "a à ao aos as com da das de do dos e em entre foi foram há mais na nas não no nos o os ou para pela pelo por que se segundo sem sua um uma".split(),
    "fr": "a à au aux avec ce ces cette dans de des du elle en est et il la le les leur mais n ne non ou où par pas plus pour que qui sa se selon ses son sur un une".split(),
}
# Other writings of these languages' names.
LANGUAGE_NAMES = {"spa": "es", "eng": "en", "por": "pt", "fra": "fr", "fre": "fr"}
BINS = 20
#: Limits of the shares by which clauses are told apart.
LEVELS = tuple(round(0.03 * 1.2**i, 4) for i in range(20))
#: Function words that are learnt: share of a language's documents, share of these where the word stands last, letters, number, and least documents.
LEARN_DOCUMENTS, LEARN_LAST, LEARN_LETTERS, LEARN_WORDS, LEARN_LEAST = 0.3, 0.05, 3, 40, 20
#: Times that a phrase or an item stands in a text at least to be dominant, with given and with learnt function words.
LEAST_TIMES, LEAST_TIMES_LEARNT = 4, 8
#: Multiples of the usual share of the commonest phrase and item from which they are dominant.
PHRASE_FACTOR, ITEM_FACTOR = 2.0, 2.0


def _letter_class() -> str:
    """Letters and marks of the basic plane, as ranges of a character class."""
    runs: list[list[int]] = []
    for code in range(0x10000):
        if unicodedata.category(chr(code))[0] in "LM":
            if runs and runs[-1][1] == code - 1:
                runs[-1][1] = code
            else:
                runs.append([code, code])
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in runs)


_LETTERS = _letter_class()
_WORD = re.compile(f"[{_LETTERS}]+")
_FINAL = re.compile(f"[{_LETTERS}]+(?=[^\\w\\s]|\\s*\\n|\\s*\\Z)")
_BY_CHARACTER = re.compile("[\u3040-\u30ff\u3400-\u9fff]")
_BEYOND_LATIN = re.compile("[\u0370-\u1dff\u2c00-\ufaff]")
_DIGIT = re.compile(r"\d")
_ANCHOR = re.compile(r"<a\b[^>]{0,2000}>.*?(?:</a>|$)(?:\s*<br\s*/?>)?", re.IGNORECASE | re.DOTALL)
_URL = re.compile(r"(?:https?://|www\.)\S+|\b[\w-]{1,63}(?:\.[\w-]{1,63}){0,8}\.(?:[a-z]{2,8})/\S*|\[[^\]]{0,200}\]\([^)]{0,2000}\)", re.IGNORECASE)
_SEPARATOR = re.compile(r"(?:[\n,;|/•·!?。！？；，、»>]|\.(?!\S))[\n,;|/•·!?.。！？；，、»>]*\s*")
_DASH = re.compile(r"\s[-–—]\s")
_PRICE = re.compile(r"[$€£¥]\s?\d|\d\s?(?:€|USD|COP)\b")
_MENU_MARKS = ("|", "·", "•", "»", "›")
#: A link on its line: what stands beside it is its label when it is this short.
LABEL_WORDS = 5


@dataclass
class Languages:
    """Function words of each language or script, and the languages of each function word."""

    words: dict[str, frozenset[str]] = field(default_factory=lambda: {k: frozenset(v) for k, v in FUNCTION_WORDS.items()})

    def __post_init__(self) -> None:
        self.of_word: dict[str, tuple[str, ...]] = {}
        for language, words in self.words.items():
            for w in words:
                self.of_word[w] = (*self.of_word.get(w, ()), language)
        self.all = frozenset().union(*(v for k, v in self.words.items() if not k.isupper()))


@lru_cache(maxsize=20_000)
def _script(ch: str) -> str:
    """The script of a letter, by its Unicode name; Chinese and Japanese are told apart by the text."""
    return unicodedata.name(ch, "OTHER").split(" ", 1)[0].split("-")[0]


def _script_of(counts: Counter[str]) -> str:
    """The script of most words."""
    votes: Counter[str] = Counter()
    for w, n in counts.items():
        votes["LATIN" if w[0] < "ɐ" else _script(w[0])] += n
    if not votes:
        return "LATIN"
    best = max(votes, key=lambda k: (votes[k], k))
    return "KANA" if best in ("CJK", "HIRAGANA", "KATAKANA") and 10 * (votes["HIRAGANA"] + votes["KATAKANA"]) > sum(votes.values()) else best


def _tokens(text: str) -> list[str]:
    """Words in small letters; ideographs and kana one by one."""
    words = _WORD.findall(text)
    if _BY_CHARACTER.search(text):
        return [c for w in words for c in (w if _BY_CHARACTER.match(w) else (w,))]
    return words


def _link_chars(line: str) -> int:
    """Characters of ``line`` that are links, with the label of a link that stands alone."""
    anchors = sum(len(m[0]) for m in _ANCHOR.finditer(line))
    rest = _ANCHOR.sub(" ", line)
    urls = sum(len(m[0]) for m in _URL.finditer(rest))
    if urls and len(_WORD.findall(_URL.sub(" ", rest))) <= LABEL_WORDS:
        return len(line)
    return min(len(line), anchors + urls)


def _is_menu(line: str) -> bool:
    """Short items without function words or numbers between marks."""
    for mark in _MENU_MARKS:
        items = [i.strip() for i in line.split(mark) if i.strip()]
        if len(items) >= 3 and line.count(mark) >= 2:
            words = [_WORD.findall(i) for i in items]
            short = sum(0 < len(w) <= 3 and not any(c.isdigit() for c in i) and not i.rstrip().endswith(".") for w, i in zip(words, items, strict=True))
            return short >= 0.8 * len(items)
    return False


def profile(text: str, languages: Languages) -> tuple[str, float, float, float, int, int, list[int], list[int]]:
    """(language, share of function words, of the commonest phrase, of the commonest item, characters, spam anyway, cells, their characters).

    A cell is ``(item level * (levels + 1) + phrase level) * BINS + bin of function words``.
    """
    total = sure = 0
    pieces: list[str] = []
    for line in text.split("\n"):
        size = len(line.strip())
        if not size:
            continue
        total += size
        if "#" in line:
            tokens = line.split()
            if 2 * sum(t[0] == "#" and len(t) > 1 for t in tokens) > len(tokens):
                sure += size
                continue
        if ("/" in line or "www." in line or "<" in line or "](" in line) and 2 * _link_chars(line) > size or _is_menu(line):
            sure += size
            continue
        if "-" in line or "–" in line or "—" in line:
            line = _DASH.sub(" ; ", line)
        at = 0
        for m in _SEPARATOR.finditer(line):
            end = m.end()
            if not line[at:end].isspace():
                pieces.append(line[at:end])
            at = end
        if at < len(line) and not line[at:].isspace():
            pieces.append(line[at:])
    lowered = [_tokens(p.lower()) for p in pieces]
    # counted in one go: a call for each clause costs more than the counting
    counts = Counter(chain.from_iterable(lowered))
    many = sum(counts.values())
    own = _script_of(counts)
    if own == "LATIN":
        votes: Counter[str] = Counter()
        for w in counts.keys() & languages.of_word.keys():
            for language in languages.of_word[w]:
                if not language.isupper():
                    votes[language] += counts[w]
        language = max(languages.words, key=lambda k: votes[k]) if votes else "none"  # of equals the first listed
        function = languages.words.get(language, languages.all)
    else:
        language, function = own, languages.words.get(own, frozenset())
    share = sum(counts[w] for w in counts.keys() & function) / many if many else 0.0
    couples: list[tuple[str, str]] = []
    held: list[str] = []
    contents = [[w for w in words if w not in function] for words in lowered]
    for content in contents:
        if len(content) > 1:
            couples += zip(content, content[1:])
        held += set(content)
    phrases, holders = Counter(couples), Counter(held)
    names = [" ".join(words) for words in lowered]
    items = Counter(names)
    # a unit is a clause, or eight words where clauses are longer
    units = max(sum(map(bool, lowered)), many / 8)
    least = LEAST_TIMES if own == "LATIN" else LEAST_TIMES_LEARNT
    levels = {p: bisect_right(LEVELS, n / units) for p, n in phrases.items() if n >= least}
    cased = own in ("LATIN", "CYRILLIC", "GREEK", "ARMENIAN")
    listed = _list_runs(pieces, lowered, function) if cased else [False] * len(pieces)
    cells: Counter[int] = Counter()
    for piece, words, content, name, in_run in zip(pieces, lowered, contents, names, listed, strict=True):
        if not words:
            continue
        bare = piece.strip()
        size = len(bare)
        if in_run or len(content) == len(words) and any(holders[w] >= max(4.0, 0.25 * units) for w in words) and _PRICE.search(piece):
            sure += size
            continue
        item = phrase = lacking_bin = 0
        if len(words) <= 4 and items[name] >= least and not _DIGIT.search(piece) and (cased or size <= 12 and bare[-1:] not in ".!?。！？।"):
            item = bisect_right(LEVELS, items[name] / units)
        if levels and words[0] not in function:
            phrase, lacking_bin = _covered(piece, words, function, levels, size)
        if item or phrase:
            cells[(item * (len(LEVELS) + 1) + phrase) * BINS + lacking_bin] += size
    top_phrase = max(phrases.values(), default=0) / units if units else 0.0
    top_item = max(items.values(), default=0) / units if units else 0.0
    return language, share, top_phrase, top_item, total, sure, list(cells), list(cells.values())


def _covered(piece: str, words: list[str], function: frozenset[str], levels: dict[tuple[str, str], int], size: int) -> tuple[int, int]:
    """(phrase level, bin of function words): the highest level at which phrases cover three tenths of a clause, 0 if none does or it reads as a sentence."""
    places = [i for i, w in enumerate(words) if w not in function]
    spans = [(level, i, j) for i, j in zip(places, places[1:]) if j - i <= 3 and (level := levels.get((words[i], words[j])))]
    if not spans:
        return 0, 0
    spans.sort(reverse=True)
    inside: set[int] = set()
    reached = 0
    for level, i, j in spans:
        if level < reached - 6:  # phrases a third as frequent still excuse the function words they hold
            break
        inside.update(range(i, j + 1))
        if not reached and len(inside) >= 0.3 * len(words):
            reached = level
    if not reached or 3 * len(_DIGIT.findall(piece)) >= size:
        return 0, 0
    real = _function_places(_tokens(piece), words, function) if len(places) < len(words) else []
    if len({words[i] for i in real}) >= 3:
        return 0, 0
    # function words that the phrases hold are excused in short clauses and where there is nothing but phrases
    lacking = sum(i not in inside for i in real) if len(words) < 6 or len(inside) >= 0.9 * len(words) else len(real)
    return reached, min(BINS - 1, int(BINS * lacking / len(words)))


def _function_places(own: list[str], words: list[str], function: frozenset[str]) -> list[int]:
    """Where function words stand, without capitalised ones and ones between capitals, which are parts of names."""
    if len(own) != len(words):
        return [i for i, w in enumerate(words) if w in function]
    return [i for i, w in enumerate(words) if w in function and (i == 0 or not own[i][0].isupper() and not (own[i - 1][0].isupper() and i + 1 < len(own) and own[i + 1][0].isupper()))]


def _list_runs(pieces: list[str], lowered: list[list[str]], function: frozenset[str], least: int = 5) -> list[bool]:
    """Clauses in runs of ``least`` list items of two to eight words, each a phrase with at most one function word, not begun by one."""
    fits = []
    for piece, words in zip(pieces, lowered, strict=True):
        plain = 2 <= len(words) <= 8 and words[0] not in function and piece.rstrip()[-1:] not in ".!?。！？" and not _DIGIT.search(piece)
        if plain:
            own = _WORD.findall(piece)
            plain = any(o.islower() and w not in function for o, w in zip(own, words)) and len(_function_places(own, words, function)) <= 1 + (len(words) > 5)
        fits.append(plain)
    out, at = [False] * len(fits), 0
    while at < len(fits):
        end = at
        while end < len(fits) and fits[end]:
            end += 1
        if end - at >= least:
            out[at:end] = [True] * (end - at)
        at = max(end, at + 1)
    return out


def _group(text: str, label: str | None) -> str | None:
    """The language to learn function words for: a script beyond Latin, or a label that has no list."""
    if _BEYOND_LATIN.search(text):
        own = _script_of(Counter(_tokens(text)))
        if own != "LATIN":
            return own
    name = (label or "").strip().lower()
    name = LANGUAGE_NAMES.get(name, name[:2])
    return None if not name.isalpha() or name in FUNCTION_WORDS or name == "un" else name


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(language, word, documents, documents where it stands last), summed up for each batch; the empty word counts documents."""
    for part in batches:
        documents: dict[str, Counter] = defaultdict(Counter)
        last: dict[str, Counter] = defaultdict(Counter)
        for text, label in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            language = _group(text, label)
            if language:
                small = text.lower()
                documents[language].update({w for w in _tokens(small) if len(w) <= LEARN_LETTERS} | {""})
                ends = {w[-1] if _BY_CHARACTER.match(w) else w for w in _FINAL.findall(small)}
                last[language].update(w for w in ends if len(w) <= LEARN_LETTERS)
        rows = [(k, w, n, last[k][w]) for k, own in documents.items() for w, n in own.items()]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["language", "word", "documents", "last"])


def learn_languages(texts: DataFrame) -> Languages:
    """Function words from (text, lang): the given lists, and for other languages and scripts what all their documents show.

    At most ``LEARN_WORDS`` words of each language come to the driver.
    """
    counts = texts.select("text", "lang").mapInArrow(_word_counts, "language string, word string, documents bigint, last bigint").groupBy("language", "word").agg(F.sum("documents").alias("documents"), F.sum("last").alias("last"))
    counts = cut_table(counts)
    sizes = counts.where("word = '' and documents >= {}".format(LEARN_LEAST)).select("language", F.col("documents").alias("n"))
    common = counts.where("word <> ''").join(sizes, "language").where((F.col("documents") >= LEARN_DOCUMENTS * F.col("n")) & (F.col("last") <= LEARN_LAST * F.col("documents")))
    best = common.withColumn("place", F.row_number().over(Window.partitionBy("language").orderBy(F.desc("documents"), "word"))).where(f"place <= {LEARN_WORDS}")
    learnt: dict[str, set[str]] = defaultdict(set)
    for row in best.collect():
        learnt[row.language].add(row.word)
    return Languages({k: frozenset(v) for k, v in FUNCTION_WORDS.items()} | {k: frozenset(v) for k, v in learnt.items()})


PROFILE_SCHEMA = "doc_id bigint, language string, function_share double, top_phrase double, top_item double, total int, sure int, cells array<int>, sizes array<int>"


def spam_shares(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str | None = "lang", fraction: float = 0.5) -> DataFrame:
    """(doc_id, language, spam_share) for each row with an id and a text; 0 for texts without visible characters.

    ``lang`` names a column of language labels, which may be null or wrong; None if there is none.
    """
    base = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"), (F.col(lang).cast("string") if lang and lang in documents.columns else F.lit(None).cast("string")).alias("lang")).where("doc_id is not null and text is not null")
    languages = learn_languages(base)

    def profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            rows = [(key, *profile(own, languages)) for key, own in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 9
            types = (pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in PROFILE_SCHEMA.split(", ")])

    profiled = cut_table(base.select("doc_id", "text").mapInArrow(profiles, PROFILE_SCHEMA))
    usual = lambda c: F.percentile_approx(c, 0.5, 1000)
    norms = profiled.groupBy("language").agg((usual("function_share") * fraction).alias("least"), (usual("top_phrase") * PHRASE_FACTOR).alias("phrase"), (usual("top_item") * ITEM_FACTOR).alias("item"))
    # levels counted from the limits: a share above the limit is above as many levels
    # the last level counts in any language: a phrase in each unit of a text
    level = lambda c: F.least(F.lit(len(LEVELS) - 1), sum((F.when(F.col(c) > v, 1).otherwise(0) for v in LEVELS), F.lit(0)))
    norms = norms.select("language", "least", level("phrase").alias("phrase"), level("item").alias("item"))
    placed = profiled.join(F.broadcast(norms), "language")  # one row for each language and script
    width = len(LEVELS) + 1
    spam = f"(cell div {BINS * width} > item or (cell div {BINS}) % {width} > phrase and (cell % {BINS} = 0 or (cell % {BINS} + 0.5) / {BINS} < least))"
    low = F.expr(f"aggregate(zip_with(cells, sizes, (cell, n) -> if({spam}, n, 0)), 0, (a, b) -> a + b)")
    return placed.select("doc_id", "language", F.when(F.col("total") > 0, (F.col("sure") + low) / F.col("total")).otherwise(0.0).alias("spam_share"))


def stuffed_pages(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str | None = "lang", share: float = 0.5) -> DataFrame:
    """(doc_id) of the pages whose greater part is spam."""
    return spam_shares(documents, doc_id, text, lang).where(F.col("spam_share") > share).select("doc_id").distinct()
