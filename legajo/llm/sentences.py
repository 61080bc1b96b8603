"""Sentence boundaries across languages and scripts by a linear-chain model.

Every character is tagged *boundary* (the last of a sentence) or *inside*.  A
character can be a boundary only where a mark that may end sentences stands, with
the quotes and brackets that close after it, or, in scripts that put no marks
between sentences, before a blank; all others are inside for certain, so the
chain is decoded over the places that are open, the certain ones between them
entering by their number.

The model is a conditional random field with two tags: weights of features of the
characters around a place, and weights of each pair of tags by the distance
between two places.  Nobody has marked sentences; what is known of a text are the
ends of its paragraphs.  So the texts are stripped of their line breaks, in
scripts without marks of all punctuation as well, and the field is fitted to find
the places again.  A boundary is at a line break with a probability that is
estimated for each script; a place without one is a boundary or not, and its tag is
summed out (fitting from positive and unlabelled places, by gradient).

Which scripts go without marks is learnt, too: those whose paragraphs seldom end in
one.  There are no word lists.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legajo.llm.confusables import visible_form

#: Bounds of the sample that the model is fitted on: texts, and characters of a text that may be in it.
TRAIN_ROWS, TRAIN_CHARS = 6000, 20_000
#: Steps of the fit, the weights of its penalty on features of single words and on those of marks, classes and distances, and the least
#: occurrences of a feature with a weight of its own.
STEPS, PENALTY, PENALTY_SHARED, LEAST_SEEN = 120, 1.0, 0.15, 3
#: Part of a script's usual rate of line breaks that a boundary is taken to have, for marks (0) and for blanks (1): languages and kinds of text
#: differ in their rates, and a rate too high would take the boundaries of texts with few line breaks for none.
RATE_PART = {"0": 0.3, "1": 0.5}
#: Below this share of paragraphs that end in a mark a script counts as unmarked.
MARKED_SHARE = 0.5

# Marks that may end a sentence, closing and opening signs, pairs of quotes.
STOPS = ".!?…؟۔।॥。！？"
_CLOSE = "\"'»”’」』）)\\]"
_OPENERS = "\"'«“‘「『（([¿¡—-"
_QUOTE_END = "\"»”’」』"
_PAIRS = {"»": "«", "”": "“", "’": "‘", "」": "「", "』": "『", '"': '"'}
_STOP = regex.compile(
    # a mark with its closers before white space; ideographic marks anywhere; a mark without a blank after it, before a capital or an opening sign
    f"[.!?…؟۔।॥]+(?:[{_CLOSE}]|[ \u00a0\u202f]»)*(?=\\s|$)|[。！？][。！？…]*[{_CLOSE}]*|…+[{_CLOSE}]*(?=[\u3000-\u9fff])|(?<=[\\p{{Ll}}\\p{{Lo}}\\p{{Mn}}\\p{{N}}])[.!?؟۔।॥]+[»”\"]*(?=\\p{{Lu}}\\p{{Ll}}|[¿¡«“]|\\p{{Lu}}[\\p{{Mn}}\u200b-\u200d\u2060\ufeff\u00ad]*[\\p{{Ll}} ])"
)
_GAP = re.compile(r"(?<=\S)[^\S\n]+(?=\S)")
_LINE = re.compile(r"[^\n]+")
_LAST = re.compile(r"\S+\Z")
_FIRST = re.compile(r"\S+")
_BUCKETS = 8


@dataclass
class Model:
    """Weights of a boundary by feature, and of (kind of place, distance, tag before, tag); scripts without marks."""

    weights: dict[str, float] = field(default_factory=dict)
    transitions: list = field(default_factory=lambda: np.zeros((2, _BUCKETS, 2, 2)).tolist())
    unmarked: tuple[str, ...] = ()


@lru_cache(maxsize=20_000)
def script(ch: str) -> str:
    """The script of a letter, by the name that Unicode gives it; empty for all else."""
    return unicodedata.name(ch, "").split(" ", 1)[0].split("-")[0] if ch.isalpha() else ""


@lru_cache(maxsize=16)
def _letters_of(scripts: tuple[str, ...]) -> regex.Pattern:
    return regex.compile("[" + "".join(rf"\p{{Script={ {'CJK': 'Han'}.get(s, s.title()) }}}" for s in scripts) + "]")


@lru_cache(maxsize=100_000)
def _plain(word: str) -> str:
    """What is read of ``word``, without case."""
    return word.lower() if word.isascii() else (visible_form(word) or "").lower()


@lru_cache(maxsize=50_000)
def _shape(word: str) -> str:
    if any(c.isdigit() for c in word):
        return "0"
    letters = "".join(c for c in word if c.isalpha())
    kind = "U" if letters.isupper() else "T" if letters[:1].isupper() else "l"
    return f"{kind}{min(len(letters), 6)}{'.' if '.' in word else ''}"


def _kind(text: str, at: int) -> str:
    """Class of the character that comes after a place."""
    while at < len(text) and (text[at].isspace() or unicodedata.category(text[at]) == "Cf"):
        at += 1
    if at >= len(text):
        return "END"
    c = text[at]
    if c in _OPENERS:
        return "OPEN"
    return "LOWER" if c.islower() else "UPPER" if c.isupper() else "DIGIT" if c.isdigit() else "LETTER" if c.isalpha() else "OTHER"


def stop_features(text: str, start: int, end: int, floor: int) -> list[str]:
    """Features of a mark that stands at ``start`` with its closers up to ``end``; its line begins at ``floor``."""
    stop = text[start:end]
    mark = "…" if stop[0] == "…" or stop.startswith("..") else stop[0]
    kind = _kind(text, end)
    glued = "+" if end < len(text) and not text[end].isspace() else ""
    window = text[max(floor, start - 40) : start]
    token = _LAST.search(window)
    raw = token[0].lstrip(_OPENERS) if token else ""
    word = _plain(raw)
    after = _FIRST.match(text, end + (0 if glued else len(text[end : end + 8]) - len(text[end : end + 8].lstrip())))
    following = _plain(after[0][:16].strip(_OPENERS))[:6] if after else ""
    quote = next((c for c in reversed(stop) if c in _QUOTE_END), "")
    found = ["stop", f"m{mark}", f"k{kind}", f"mk{mark}{kind}{glued}", f"mq{mark}{bool(quote)}{kind}"]
    if quote:
        opened = text.rfind(_PAIRS.get(quote, quote), floor, start)
        before = text[max(0, opened - 3) : max(0, opened)].rstrip()[-1:] if opened >= 0 else "?"
        sign = before if not before.isalnum() else "w"
        found += [f"qc{sign in (':', '：')}{kind}", f"qb{sign}{kind}", f"qmb{mark}{sign}{kind}"]
    elif mark in "….":
        shape = _shape(raw)
        script_ = script(raw[-1:])
        found += [f"s{mark}{shape}", f"sk{mark}{shape}{kind}{glued}", f"x{script_}{mark}{shape[0]}"]
        if mark == "." and len(word) <= 10:
            found += [f"w{word}", f"wk{word}|{kind}"]
            if len(word) <= 3:
                previous = _LAST.search(window[: token.start()].rstrip()) if token else None
                found.append(f"p{_plain(previous[0]) if previous and len(previous[0]) <= 6 else _shape(previous[0]) if previous else ''} {word}")
        found.append(f"n{mark}{following}")
    return found


def gap_features(text: str, start: int, end: int) -> list[str]:
    """Features of a blank from ``start`` to ``end`` in a script without marks."""
    token = _LAST.search(text[max(0, start - 30) : start])
    left = _plain(token[0]) if token else ""
    after = _FIRST.match(text, end)
    right = _plain(after[0][:16]) if after else ""
    found = ["gap"]
    if left[-1:].isdigit():
        previous = _LAST.search(text[max(0, start - 50) : start - len(token[0])].rstrip())
        found += ["L0", f"L0{_plain(previous[0])[-4:] if previous else ''}"]
    else:
        found += [f"L{n}{left[-n:]}" for n in (2, 3, 4, 6)]
    if right[:1].isdigit():
        found += ["R0", f"R0L{left[-3:]}"]
    else:
        found += [f"R{n}{right[:n]}" for n in (2, 3, 4, 6)]
    found.append(f"LR{'0' if left[-1:].isdigit() else left[-2:]}|{'0' if right[:1].isdigit() else right[:2]}")
    return found


def open_places(text: str, start: int, end: int, unmarked: tuple[str, ...]) -> list[tuple[int, int, int, int]]:
    """(offset after the last character, start of the mark or blank, its end, 0 for marks and 1 for blanks) of one line of ``text``, in order."""
    found = [(m.end(), m.start(), m.end(), 0) for m in _STOP.finditer(text, start, end)]
    if unmarked:
        letters = _letters_of(unmarked)
        if letters.search(text, start, end):
            taken = {place for place, *_ in found}
            for m in _GAP.finditer(text, start, end):
                near = text[max(start, m.start() - 2) : m.start()] + text[m.end() : m.end() + 1]
                if m.start() not in taken and (letters.search(near) or near[-1:].isdigit() and letters.search(text, max(start, m.start() - 12), m.start())):
                    found.append((m.start(), m.start(), m.end(), 1))
            found.sort()
    return found


def _bucket(distance: int) -> int:
    return min(_BUCKETS - 1, max(0, int(distance).bit_length() - 1))


@dataclass
class Chain:
    """Open places of one stripped text: features, kinds, distances, whether a line break stood there, and the script."""

    features: list[list[str]]
    kinds: list[int]
    buckets: list[int]
    broken: list[bool]
    scripts: list[str]


def stripped_chain(text: str, unmarked: tuple[str, ...], seed: int = 0) -> Chain | None:
    """The chain of ``text`` without its line breaks (and, in unmarked scripts, without marks); after wide characters and at every fourth break no blank is left."""
    lines = [m[0].strip() for m in _LINE.finditer(text) if m[0].strip()]
    if unmarked:
        letters = _letters_of(unmarked)
        lines = [regex.sub(f"[{STOPS}]+(?=\\s|$)", "", line).rstrip() if letters.search(line) else line for line in lines]
        lines = [line for line in lines if line]
    if not lines:
        return None
    joined, breaks = lines[0], set()
    for i, line in enumerate(lines[1:]):
        breaks.add(len(joined))
        wide = unicodedata.east_asian_width(joined[-1]) in "WF"
        bare = wide or line[0].isupper() and joined[-1] in STOPS and (seed + i) % 4 == 0
        joined += line if bare else " " + line
    chain, previous, floor = Chain([], [], [], [], []), 0, 0
    for place, a, b, kind in open_places(joined, 0, len(joined), unmarked):
        if place >= len(joined):
            break
        chain.features.append(gap_features(joined, a, b) if kind else stop_features(joined, a, b, floor))
        chain.kinds.append(kind)
        chain.buckets.append(_bucket(place - previous))
        chain.broken.append(place in breaks)
        chain.scripts.append(script(next((c for c in reversed(joined[max(0, a - 12) : a]) if c.isalpha()), "")) + str(kind))
        previous = place
        if place in breaks:
            floor = place
    return chain if chain.features else None


def unmarked_scripts(texts: list[str]) -> tuple[str, ...]:
    """Scripts whose paragraphs seldom end in a mark, by paragraphs of twenty characters and more."""
    ends: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for text in texts:
        for m in _LINE.finditer(text):
            line = m[0].rstrip(" \t\u200b\u2060\ufeff" + _CLOSE.replace("\\", ""))
            letter = next((c for c in reversed(line) if c.isalpha()), "")
            if len(line) >= 20 and letter:
                own = ends[script(letter)]
                own[0] += 1
                own[1] += line[-1] in STOPS
    return tuple(sorted(s for s, (n, marked) in ends.items() if n >= 10 and marked < MARKED_SHARE * n))


def _break_rates(chains: list[Chain]) -> dict[str, float]:
    """How often a boundary of each script is at a line break: the upper quartile over well-met features of what stands before."""
    seen: dict[str, Counter] = defaultdict(Counter)
    hits: dict[str, Counter] = defaultdict(Counter)
    for chain in chains:
        for found, name, broken in zip(chain.features, chain.scripts, chain.broken, strict=True):
            key = next((f for f in found if f[:2] in ("sk", "L4", "L0")), found[3] if len(found) > 3 else found[0])
            seen[name][key] += 1
            hits[name][key] += broken
    rates = {}
    for name, counts in seen.items():
        shares = sorted((hits[name][k] / n, n) for k, n in counts.items() if n >= 8)
        total, run, rate = sum(n for _, n in shares), 0, 0.2
        for share, n in shares:
            run += n
            rate = share
            if run >= 0.75 * total:
                break
        rates[name] = min(0.9, max(0.01, rate * RATE_PART[name[-1]]))
    return rates


def _lattice(scores: np.ndarray, transitions: np.ndarray, kinds: np.ndarray, buckets: np.ndarray, active: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(marginals of a boundary, of each pair of tags) for every run of ``scores`` (place, run, tag), by forward and backward passes.

    Places are in order of their number within the chain, chains with the longest
    first, so that what follows the first places of ``active[t]`` chains are the
    first of the next slice.  Each pass is scaled to sum to one at each place.
    """
    emit = np.exp(scores - scores.max(axis=2, keepdims=True))
    steps = np.exp(transitions)[kinds, buckets][:, None]  # place, run, tag before, tag
    offsets = np.r_[0, np.cumsum(active)]
    before = np.zeros_like(emit)
    backward = np.full_like(emit, 0.5)
    before[: active[0], :, 1] = 1.0  # a text's beginning counts as a boundary before it
    for t in range(len(active) - 1):
        own, nxt = slice(offsets[t], offsets[t] + active[t + 1]), slice(offsets[t + 1], offsets[t + 2])
        f = (before[own, :, 0, None] * steps[own, :, 0] + before[own, :, 1, None] * steps[own, :, 1]) * emit[own]
        before[nxt] = f / f.sum(axis=2, keepdims=True)
    for t in range(len(active) - 2, -1, -1):
        own, nxt = slice(offsets[t], offsets[t] + active[t + 1]), slice(offsets[t + 1], offsets[t + 2])
        g = emit[nxt] * backward[nxt]
        h = steps[nxt, :, :, 0] * g[:, :, None, 0] + steps[nxt, :, :, 1] * g[:, :, None, 1]
        backward[own] = h / h.sum(axis=2, keepdims=True)
    paired = before[:, :, :, None] * steps * (emit * backward)[:, :, None, :]
    paired /= paired.sum(axis=(2, 3), keepdims=True)
    return paired[:, :, :, 1].sum(axis=2), paired


def fit_chains(chains: list[Chain], steps: int = STEPS, use_transitions: bool = True) -> tuple[dict[str, float], np.ndarray]:
    """Weights and transitions that make the line breaks of ``chains`` most probable (Adam on the marginal likelihood)."""
    chains = sorted((c for c in chains if c), key=lambda c: -len(c.kinds))
    counts = Counter(f for c in chains for found in c.features for f in found)
    names = [f for f, n in counts.items() if n >= LEAST_SEEN]
    if not names:
        return {}, np.zeros((2, _BUCKETS, 2, 2))
    index = {f: i + 1 for i, f in enumerate(names)}
    width = max(len(found) for c in chains for found in c.features)
    longest = len(chains[0].kinds)
    active = [sum(1 for c in chains if len(c.kinds) > t) for t in range(longest)]
    places = [(c, t) for t in range(longest) for c in chains[: active[t]]]
    matrix = np.zeros((len(places), width), np.int32)
    for i, (c, t) in enumerate(places):
        own = [index[f] for f in c.features[t] if f in index]
        matrix[i, : len(own)] = own
    matrix, alike = np.unique(matrix, axis=0, return_inverse=True)  # places with the same features are weighed once
    alike = alike.ravel()
    kinds, buckets, broken = (np.array([getattr(c, name)[t] for c, t in places]) for name in ("kinds", "buckets", "broken"))
    rates = _break_rates(chains)
    rate = np.array([rates[c.scripts[t]] for c, t in places])
    # what is seen of a place, given its tag: a line break only at boundaries, and there with the rate of the script
    seen = np.stack([np.where(broken, -30.0, 0.0), np.where(broken, np.log(rate), np.log1p(-rate))], axis=1)
    weights = np.zeros(len(names) + 1)
    penalty = np.array([0.0, *(PENALTY if f[0] in "wpnLR" else PENALTY_SHARED for f in names)])
    for name, start in (("stop", 1.0), ("gap", 0.0)):
        if name in index:
            weights[index[name]] = start
    arcs = np.zeros((2, _BUCKETS, 2, 2))
    moments = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(arcs), np.zeros_like(arcs)]
    flat, cell = matrix.ravel(), kinds * _BUCKETS + buckets
    for step in range(1, steps + 1):
        # two runs: with what is seen, and without
        score = np.zeros((len(places), 2, 2))
        score[:, :, 1] = weights[matrix].sum(axis=1)[alike, None]
        score[:, 0] += seen
        marginal, pairs = _lattice(score, arcs, kinds, buckets, active)
        pull = np.bincount(alike, marginal[:, 0] - marginal[:, 1], len(matrix))
        grad = np.bincount(flat, np.repeat(pull, width), len(weights)) - penalty * weights
        grad[0] = 0
        slope = np.zeros_like(arcs)
        if use_transitions:
            gained = (pairs[:, 0] - pairs[:, 1]).reshape(len(places), 4)
            slope = np.stack([np.bincount(cell, gained[:, i], 2 * _BUCKETS) for i in range(4)], axis=1).reshape(arcs.shape) - PENALTY_SHARED * arcs
        for value, g, m, v in ((weights, grad, moments[0], moments[1]), (arcs, slope, moments[2], moments[3])):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            value += 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return {f: round(float(weights[i]), 3) for f, i in index.items() if abs(weights[i]) >= 0.02}, arcs


def fit(texts: list[str], steps: int = STEPS, use_transitions: bool = True) -> Model:
    """A model from texts whose line breaks are paragraph ends."""
    texts = [t for t in texts if t]
    unmarked = unmarked_scripts(texts)
    chains = [c for i, t in enumerate(texts) if (c := stripped_chain(t, unmarked, i))]
    weights, arcs = fit_chains(chains, steps, use_transitions)
    return Model(weights, arcs.tolist(), unmarked)


def _decode(scores: list[float], kinds: list[int], buckets: list[int], transitions: list) -> list[bool]:
    """The best tags by Viterbi: true for boundaries."""
    inside, boundary = -math.inf, 0.0
    back: list[tuple[bool, bool]] = []
    for score, kind, bucket in zip(scores, kinds, buckets, strict=True):
        arc = transitions[kind][bucket]
        a, b = inside + arc[0][0], boundary + arc[1][0]
        c, d = inside + arc[0][1], boundary + arc[1][1]
        back.append((b > a, d > c))
        inside, boundary = max(a, b), score + max(c, d)
    tag = boundary > inside
    tags = []
    for to_inside, to_boundary in reversed(back):
        tags.append(tag)
        tag = to_boundary if tag else to_inside
    return tags[::-1]


def sentence_ends(text: str, model: Model, soft_lines: bool = False) -> list[int]:
    """Offsets just after the last character of each sentence of ``text``, in order.

    A line break ends a sentence; with ``soft_lines`` (scanned pages) a single
    one is white space and only an empty line does.  A text without visible
    characters has no sentences.
    """
    out: list[int] = []
    weights = model.weights
    at = 0
    spans = [(m.start(), m.end()) for m in regex.finditer(r"(?:[^\n]|\n(?!\s*\n))+" if soft_lines else r"[^\n]+", text)]
    for a, b in spans:
        line_end = a + len(text[a:b].rstrip())
        start = line_end - len(text[a:line_end].lstrip())
        if start >= line_end:
            continue
        places = [p for p in open_places(text, start, line_end, model.unmarked) if p[0] < line_end]
        if places:
            scores = [sum(weights.get(f, 0.0) for f in (gap_features(text[:line_end], x, y) if kind else stop_features(text[:line_end] if line_end < len(text) else text, x, y, start))) for _, x, y, kind in places]
            offsets = [p[0] for p in places]
            tags = _decode(scores, [p[3] for p in places], [_bucket(p - q) for p, q in zip(offsets, [start, *offsets])], model.transitions)
            out += [p for p, tag in zip(offsets, tags, strict=True) if tag]
        out.append(line_end)
        at = b
    return out


def fit_on(texts: DataFrame, content: str = "content", rows: int = TRAIN_ROWS) -> Model:
    """A model fitted on the ``rows`` texts of smallest hash with at most ``TRAIN_CHARS`` characters, a bounded and repeatable sample."""
    known = texts.select(F.col(content).alias("content")).where(F.col("content").isNotNull() & (F.length("content") <= TRAIN_CHARS))
    # a hash threshold first, so that no task sends more than its share of the sample to the driver
    part = min(1.0, 1.2 * rows / max(1, known.count()))
    near = known.withColumn("place", F.pmod(F.xxhash64("content"), F.lit(1 << 40))).where(F.col("place") < int(part * (1 << 40)))
    sample = near.orderBy("place", "content").select("content").limit(rows)
    return fit(list(dict.fromkeys(row.content for row in sample.collect())))


def sentences(chunks: DataFrame, model: Model, key: str = "chunk_id", content: str = "content", soft_lines: str | None = None) -> DataFrame:
    """(key, sentence_no, end_char, sentence_count) for each sentence of each row.

    Null keys and contents give no rows, nor do texts without visible
    characters.  ``soft_lines`` names a boolean column for scanned texts.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            keys: list = []
            numbers: list[int] = []
            offsets: list[int] = []
            totals: list[int] = []
            for k, text, soft in zip(*(c.to_pylist() for c in part.columns), strict=True):
                ends = sentence_ends(text, model, bool(soft))
                keys += [k] * len(ends)
                numbers += range(len(ends))
                offsets += ends
                totals += [len(ends)] * len(ends)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(numbers, pa.int32()), pa.array(offsets, pa.int32()), pa.array(totals, pa.int32())], names=[key, "sentence_no", "end_char", "sentence_count"])

    base = chunks.select(F.col(key).cast("string").alias(key), F.col(content).cast("string").alias("content"), (F.col(soft_lines) if soft_lines else F.lit(False)).alias("soft")).where(F.col(key).isNotNull() & F.col("content").isNotNull())
    return base.mapInArrow(cut, f"{key} string, sentence_no int, end_char int, sentence_count int")
