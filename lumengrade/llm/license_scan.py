"""License scans: winnowed fingerprints in an inverted index pick candidates, banded alignment reports coverage and spans.

Words are compared without case and outer punctuation. Each run of `k` words has a 64-bit hash, and of every `window`
neighbouring hashes the smallest is a fingerprint, so a shared run of window + k - 1 words always shares one. Both go by the
template's length, so that a template with as many words changed, missing or extra as `coverage` leaves always keeps such a
run (see runs()). The index maps
the templates' fingerprints to (template, place). Of templates of SHORT words and more, a text's anchors (fingerprints that hit the index) are
lengthened to runs of equal words, and these are chained in the order of both, over missing words of the template and up to `gap` foreign words of the text between two runs; each chain with
as many anchors as a match must have leads a corridor of diagonals, and the whole template is aligned in a band around it, and where it doesn't
agree throughout once more over all diagonals up to `gap` beside the corridor. Of shorter ones each
diagonal is a corridor. An alignment counts +1 a match and -1 a difference, a run of extra words no more than EXTRA, with free start and end in the text. The
alignments of all candidates of a template in an Arrow slice advance together, a template's word a step,
on arrays of one row per candidate. An alignment that covers `coverage` of the template's words is reported with its span in
words and characters; of overlapping reports the one with more matched words stays. Pieces of a notice more than `gap` words apart are no
match, nor is a template whose words are broken up by more differences (a run of extra words counting as one) than `coverage` leaves.

The templates are a fixed parameter list: one-line notices and full texts. Defined results: null, empty and unmatched texts give no row; repeated rows give
their rows again; equal matches tie by coverage, template name and place; texts of any length are read whole; further columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from bisect import bisect
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import WORD, slices, table
from .license_texts import TEMPLATES
from .minhash_dedup import MIX, _WordHash

K, WINDOW, BAND, COVERAGE, SHORT, GAP = 3, 2, 8, 0.8, 20, 256
EDGE = b".,;:!?()[]{}\"'`*_<>"

def plain_words(text: str) -> list[bytes]:
    return [w.strip(EDGE) for w in text.encode().lower().split()]


def fingerprints(hashes: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the winnowed k-word runs; texts shorter than k words are one run."""
    if not len(hashes):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    k = min(k, len(hashes))
    grams = np.zeros(len(hashes) - k + 1, np.uint64)
    for i in range(k):
        grams = (grams ^ hashes[i : len(hashes) - k + 1 + i]) * MIX
        grams ^= grams >> np.uint64(29)
    window = min(window, len(grams))
    at = np.arange(len(grams))  # the rightmost smallest of each window; for windows of one and two without a search
    if window == 2:
        at = at[:-1] + (grams[1:] <= grams[:-1])
    elif window > 2:
        views = np.lib.stride_tricks.sliding_window_view(grams, window)
        at = np.arange(len(views)) + window - 1 - views[:, ::-1].argmin(1)
    at = at[np.r_[True, at[1:] != at[:-1]]]  # places never fall
    return at, grams[at]


def runs(n: int, coverage: float = COVERAGE) -> tuple[int, int]:
    """(k, window) for a template of n words: the edits that coverage allows leave a run of at least k + window - 1 words."""
    allowed = n - math.ceil(coverage * n - 1e-9)
    least = math.ceil((n - allowed) / (allowed + 1))
    return (K, WINDOW) if n >= SHORT and least >= K + WINDOW - 1 else (max(1, min(2, least)), 1)


class Index:
    """Inverted index of template fingerprints, one part for each (k, window)."""

    def __init__(self, templates: dict[str, str], coverage: float = COVERAGE):
        words_of = _WordHash()
        self.words = {name: plain_words(text) for name, text in sorted(templates.items())}
        self.codes = {name: np.fromiter(map(words_of.__getitem__, words), np.uint64, len(words)) for name, words in self.words.items()}
        if max(map(len, self.words.values()), default=0) > 8000:
            raise ValueError("templates have up to 8000 words")
        parts: dict[tuple[int, int], dict[int, list[tuple[str, int]]]] = defaultdict(lambda: defaultdict(list))
        for name, words in self.words.items():
            size = runs(len(words), coverage)
            at, code = fingerprints(self.codes[name], *size)
            for place, h in zip(at.tolist(), code.tolist(), strict=True):
                parts[size][h].append((name, place))
        self.parts = [(size, dict(posting), np.array(sorted(posting), np.uint64)) for size, posting in sorted(parts.items())]


@lru_cache(maxsize=4)
def _index(templates: tuple, coverage: float) -> Index:
    return Index(dict(templates), coverage)


def need(n: int, k: int, window: int, coverage: float = COVERAGE) -> int:
    """Fingerprints that a text shares with a template of n words at least, if no more words differ than `coverage` leaves: the words left lie
    in one run more than there are differences, and each run shares its windows' choices."""
    allowed = n - math.ceil(coverage * n - 1e-9)
    return max(1, math.ceil((n - allowed - (allowed + 1) * (k + window - 2)) / window))


def segments(template: np.ndarray, words: np.ndarray, place: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, ...]:
    """(place, place in the template, length, anchors) of the longest runs of equal words that hold the anchors."""
    out = []
    for d in np.unique(place - there).tolist():
        first, end = max(0, -d), min(len(template), len(words) - d)
        same = template[first:end] == words[first + d : end + d]
        edge = np.flatnonzero(np.diff(np.r_[False, same, False].astype(np.int8)))
        start, stop = edge[::2] + first, edge[1::2] + first
        held = np.bincount(np.searchsorted(start, there[place - there == d], "right") - 1, minlength=len(start))
        out += [(s + d, s, e - s, h) for s, e, h in zip(start.tolist(), stop.tolist(), held.tolist(), strict=True) if h]
    return tuple(np.array(out, np.int64).reshape(-1, 4).T)


def chains(place: np.ndarray, there: np.ndarray, length: np.ndarray, anchors: np.ndarray, n: int, gap: int, least: int) -> list[np.ndarray]:
    """Rows of the chains of segments, each rising in text and template, that hold `least` anchors or more.

    A chain gains 2 for each word that matches (over a word that doesn't) and loses up to EXTRA for words of the text that lie between, `gap` of
    them at most; missing words of the template cost nothing beyond that. Segments belong to the best chain that reaches them.
    """
    order = np.lexsort((there, place + length))
    t, p, size = place[order], there[order], length[order]
    t_end, p_end, held = t + size, p + size, anchors[order]
    score, back = 2.0 * size, np.full(len(t), -1)
    low = np.searchsorted(t_end, t - (n + gap))
    for a in range(len(t)):
        b = slice(low[a], a)
        new = np.minimum(np.minimum(t_end[a] - t_end[b], p_end[a] - p_end[b]), size[a])
        extra = (t[a] - p[a]) - (t[b] - p[b])
        total = score[b] + 2.0 * new - np.clip(extra, 0, EXTRA) - 0.25 * (extra != 0)
        total[(new <= 0) | (extra > gap)] = -1.0
        if len(total) and total[best := len(total) - 1 - int(total[::-1].argmax())] > score[a]:
            score[a], back[a] = total[best], low[a] + best
    used, out = np.zeros(len(t), bool), []
    for a in np.argsort(-score, kind="stable").tolist():
        chain = []
        while a >= 0 and not used[a]:
            used[a] = True
            chain.append(a)
            a = int(back[a])
        if held[chain].sum() >= least:
            out.append(order[chain[::-1]])
    return out


def corridor(template: np.ndarray, words: np.ndarray, place: np.ndarray, there: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For each word of the template the diagonal (place in words less place in the template) that a chain of segments leads along. Between two segments
    it changes where most words agree with it; over missing words of the template it falls by one a word."""
    ends = []
    for t, p, size in zip(place.tolist(), there.tolist(), length.tolist(), strict=True):
        late = max(0, ends[-1][0] + 1 - t, ends[-1][1] + 1 - p) if ends else 0  # what the one before has already
        ends += [(t + late, p + late), (t + size - 1, p + size - 1)]
    place, there = np.array(ends).T
    n = len(template)
    off = np.empty(n, np.int64)
    diagonal = place - there
    off[: there[0] + 1] = diagonal[0]
    agree = lambda rows, d: (rows + d >= 0) & (rows + d < len(words)) & (words[np.clip(rows + d, 0, len(words) - 1)] == template[rows])
    for b in range(len(there)):
        first, end = there[b], there[b + 1] if b + 1 < len(there) else n
        here, then = diagonal[b], diagonal[b + 1] if b + 1 < len(there) else diagonal[b]
        off[first:end] = here
        if here == then:
            continue
        rows, missing = np.arange(first + 1, end), max(0, int(here - then))
        before, after = np.r_[0, np.cumsum(agree(rows, here))], np.r_[0, np.cumsum(agree(rows, then)[::-1])][::-1]
        jump = int((before[: len(before) - missing] + after[missing:]).argmax())  # rows[:jump] here, then the missing ones, then the rest
        off[first + 1 + jump : first + 1 + jump + missing] = here - 1 - np.arange(missing)
        off[first + 1 + jump + missing : end] = then
    return off


# A cell is one long: score, matched words (13 bits), first and end place counted from the band's first column (16 bits each).
SCORE, MATCHED, FIRST = 1 << 45, 1 << 32, 1 << 16
NEVER = -(1 << 62)
EXTRA = 8  # what a run of extra words costs at most


def align(template: np.ndarray, words: np.ndarray, low: np.ndarray, high: np.ndarray, off: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(matched words, first, end) of the best alignment of the template with words[low:high] in a band around the corridor `off` of each candidate.

    Column c of row i stands for the word at off[:, i] + i - band + c. A match counts 1; a word that differs, is missing or is extra costs 1, a run of
    extra words no more than EXTRA.
    """
    width = 2 * band + 1
    column = np.arange(width)
    origin = off[:, 0] - band
    above = np.tile(column * (FIRST + 1), (len(off), 1))
    lead = lambda row: np.where((row > NEVER // 2) & ((row & (SCORE - 1)) >= MATCHED), row, NEVER)  # noqa: E731  what has begun to match
    for i, want in enumerate(template):
        shift = off[:, i] - off[:, i - 1] if i else np.zeros(len(off), np.int64)
        if shift.any():
            begun = lead(above)
            slope, top = (begun + column * SCORE).max(1)[:, None], begun.max(1)[:, None]
            index = np.arange(width + 1) + shift[:, None]
            beyond = np.maximum(np.maximum(slope - index * SCORE, top - EXTRA * SCORE), -i * SCORE)  # further words are extra, or nothing has begun
            moved = np.where(index < 0, NEVER, np.where(index < width, np.take_along_axis(above, np.clip(index, 0, width - 1), 1), beyond))
            above, over = moved[:, :width], moved[:, 1:]
        else:
            over = above[:, 1:]
        at = off[:, i, None] - band + i + column
        here = at - origin[:, None]
        inside = (at >= low[:, None]) & (at < high[:, None])
        same = words[np.where(inside, at, 0)] == want
        some = (above & (SCORE - 1)) >= MATCHED
        first = np.where(some, above & (MATCHED - FIRST), here * FIRST)
        core = above - (above & (MATCHED - 1)) + first
        row = np.where(same, core + SCORE + MATCHED + (here + 1), core - SCORE + (above & (FIRST - 1)))
        row = np.where(inside & (above > NEVER // 2), row, NEVER)
        row[:, : over.shape[1]] = np.maximum(row[:, : over.shape[1]], over - SCORE)  # the template's word is missing in the text
        begun = lead(row)
        extra = np.maximum(np.maximum.accumulate(begun + column * SCORE, axis=1)[:, :-1] - column[1:] * SCORE, np.maximum.accumulate(begun, axis=1)[:, :-1] - EXTRA * SCORE)
        row[:, 1:] = np.maximum(row[:, 1:], np.where(extra > NEVER // 2, extra, NEVER))
        above = np.maximum(row, NEVER)
    first = (above & (MATCHED - 1)) >> 16
    value = (above >> 32) * MATCHED + ((FIRST - 1 - np.minimum(np.abs(first - band), FIRST - 1)) << 16) + FIRST - 1 - first
    best = value.argmax(1)
    cell = above[np.arange(len(off)), best]
    return (cell & (SCORE - 1)) >> 32, ((cell & (MATCHED - 1)) >> 16) + origin, (cell & (FIRST - 1)) + origin


def scan(texts: list[np.ndarray], index: Index, coverage: float = COVERAGE, band: int = BAND, gap: int = GAP) -> list[list[tuple[str, int, float, int, int]]]:
    """(template, matched, coverage, first word, end word) found in each text, given as hashes of its words, in order."""
    base = np.cumsum([0, *map(len, texts)])
    flat = np.concatenate([*texts, np.zeros(1, np.uint64)])
    hits_of: dict[str, list[tuple[int, int, int]]] = defaultdict(list)
    sizes: dict[str, tuple[int, int]] = {}
    for d, hashes in enumerate(texts):
        for size, posting, keys in index.parts:
            at, code = fingerprints(hashes, *size)
            hit = keys[np.minimum(np.searchsorted(keys, code), len(keys) - 1)] == code
            for place, h in zip(at[hit].tolist(), code[hit].tolist(), strict=True):
                for name, there in posting[h]:
                    hits_of[name].append((d, place, there))
                    sizes[name] = size
    found: list[list] = [[] for _ in texts]

    def report(name: str, doc: np.ndarray, matched: np.ndarray, first: np.ndarray, end: np.ndarray) -> None:
        n = len(index.codes[name])
        for i in np.flatnonzero(matched >= coverage * n - 1e-9).tolist():
            d = doc[i]
            found[d].append((name, int(matched[i]), int(matched[i]) / n, int(first[i] - base[d]), int(end[i] - base[d])))

    for name, hits in hits_of.items():
        template = index.codes[name]
        doc, place, there = np.array(hits, np.int64).T
        least = need(len(template), *sizes[name], coverage)
        own, count = np.unique(np.unique(np.stack([doc, there]), axis=1)[0], return_counts=True)
        enough = np.isin(doc, own[count >= least])  # of all places of a text; its chains are asked again
        doc, place, there = doc[enough], place[enough], there[enough]
        if not len(doc):
            continue
        if len(template) < SHORT:
            doc, start = np.unique(np.stack([doc, place - there]), axis=1)
            lines = [(d, np.full(len(template), x)) for d, x in zip(doc.tolist(), start.tolist(), strict=True)]
        else:
            lines = []
            for d in np.unique(doc).tolist():
                mine = doc == d
                t, p, size, held = segments(template, texts[d], place[mine], there[mine])
                for chain in chains(t, p, size, held, len(template), gap, least):
                    off = corridor(template, texts[d], t[chain], p[chain], size[chain])
                    if off.max() - off.min() + len(template) < FIRST - 2 * (gap + 2 * band):  # the places of a cell have 16 bits
                        lines.append((d, off))
        open_lines = []
        for k in range(0, len(lines), 512):
            d = np.array([x for x, _ in lines[k : k + 512]])
            off = np.stack([x for _, x in lines[k : k + 512]]) + base[d][:, None]
            matched, first, end = align(template, flat, base[d], base[d + 1], off, band)
            whole = (matched == len(template)) | (len(template) < SHORT)
            open_lines += [lines[k + i] for i in np.flatnonzero(~whole).tolist()]
            report(name, d[whole], matched[whole], first[whole], end[whole])
        # Where words are missing or differ, a few of them may lie off the corridor: these are aligned once more, as far to its sides as `gap` allows.
        open_lines.sort(key=lambda x: int(x[1].max() - x[1].min()))
        for k in range(0, len(open_lines), 32):
            d = np.array([x for x, _ in open_lines[k : k + 32]])
            low, high = (np.array([f(x) for _, x in open_lines[k : k + 32]]) for f in (np.min, np.max))
            wide = int((high - low).max()) // 2 + 1 + gap + band
            off = np.repeat(((low + high) // 2 + base[d])[:, None], len(template), 1)
            report(name, d, *align(template, flat, base[d], base[d + 1], off, wide))
    return [_apart(f) for f in found]


def _apart(found: list[tuple]) -> list[tuple]:
    """The reports that stay when each, best first, needs its own place."""
    starts: list[int] = []
    taken: dict[int, tuple] = {}
    for x in sorted(found, key=lambda x: (-x[1], -x[2], x[0], x[3])):
        k = bisect(starts, x[3])
        if (k == 0 or taken[starts[k - 1]][4] <= x[3]) and (k == len(starts) or x[4] <= starts[k]):
            starts.insert(k, x[3])
            taken[x[3]] = x
    return [taken[k] for k in starts]


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, license, matched_words, coverage, first_word, end_word, first_char, end_char), one row per match."""
    fixed = tuple(sorted((templates or TEMPLATES).items()))
    names = ["doc_id", "license", "matched_words", "coverage", "first_word", "end_word", "first_char", "end_char"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    word = re.compile(WORD)

    def run(batches):
        index, words_of = _index(fixed, coverage), _WordHash()
        for part in slices(batches):
            out = []
            rows = [(d, t) for d, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True) if t]
            hashed = [np.fromiter(map(words_of.__getitem__, w), np.uint64, len(w)) for w in (plain_words(t) for _, t in rows)]
            for (doc, text), got in zip(rows, scan(hashed, index, coverage), strict=True):
                if got:
                    spans = [m.span() for m in word.finditer(text)]
                    out += [(doc, name, m, c, f, e, spans[f][0], spans[e - 1][1]) for name, m, c, f, e in got]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    schema = "doc_id long, license string, matched_words long, coverage double, first_word long, end_word long, first_char long, end_char long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
