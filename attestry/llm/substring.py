"""Substring dedup by paragraph MinHash banding.

Passages that documents share begin and end anywhere, inside lines too, so a paragraph here is a window of
``PARAGRAPH`` words that starts at a content anchor: the word whose shingle hash is least among ``SPREAD``
neighbours. The same words have the same anchors wherever they stand, and ``PARAGRAPH + SPREAD - 1`` words in a
row hold a whole paragraph. Each paragraph is banded by MinHash. A passage at the similarity bar has some words in
a row that are not edited (24 of 50 at least, wherever the edits are), so with paragraphs and anchors that fit into
them it always shares an equal paragraph, which is in the same band group whatever the bands: one is enough.
Otherwise bands and rows are tuned so that a paragraph at the bar collides with the wished probability.

Where the paragraph fits, so do the words before it or after it that make it up to half of what is left of those 24:
a colliding paragraph counts with one of these two (``_keys``), so short lines that many documents have make no pairs.

Such paragraphs are joined as stars: every document against the first one (by id) with the same key, so
groups of any size give rows in proportion to their members. Each pair is verified by exact Jaccard similarity of a
span of the later document with an aligned span of the earlier one. The pairs of one document are taken in order of
how many paragraphs collide, and a span is only looked for where one still lies outside the spans found so far, so
the spans of a document do not overlap and what is cut is what has been verified.

Sharing a passage is not transitive: where the first one has no more than the paragraph, or a farther copy, two others
may still share a passage around it. Around what is not settled documents are joined again, as stars, by keys that
all members of a group are at the bar for: windows of a whole passage, and equal words on the two sides of a gap of
up to ``GAP`` words, parted in every way (``gap_kinds``). Runs that end alike in all documents have no gap, and keys of
``RUNGS`` lengths of the longer side leave out most places before all ways are made. Up to ``FEW`` places that such a key
has left are compared pair by pair instead, so only larger groups need all ways. A longer gap in the earlier document
is only reached by a whole window, and shingles that a span repeats are not counted on.
Pairs at the bar whose later copy is cut already are links without a span. Removals and links are clustered by
connected components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.llm import store, texts
from attestry.llm.components import components

WORDS = 5
PARAGRAPH = 12
SPREAD = 13  # a paragraph's words and these places fit into the words of 50 that no edit at the bar touches
PASSAGE = 50
SIMILARITY = 0.8
RECALL = 0.98
NEAR = 2 * PASSAGE  # words around a window that a span of two runs and one gap reaches into
GAP = 2  # words between two matched stretches that may belong to one span
RUNGS = 4  # lengths of the longer side of a gap that are told apart
FEW = 64  # places with one key that are compared pair by pair: so many halves of a pair for each place at most
ROWS = 1 << 16  # made at a time for the documents of a batch
_CODES = (2 * GAP + 2) * RUNGS  # of a place: gap, longer side and rung
_MASKS = 1 << (GAP + 1)  # gaps that others have there
_ODDS = np.random.default_rng(11).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


def tune_bands(similarity: float = SIMILARITY, recall: float = RECALL, paragraphs: int = 1, least_rows: int = 2) -> tuple[int, int]:
    """(bands, rows) with the fewest bands by which a passage of ``paragraphs`` paragraphs collides with
    probability ``recall``; ``least_rows`` keeps single common shingles from making groups."""
    best = None
    for rows in range(least_rows, 9):
        miss = 1 - similarity**rows
        bands = max(1, int(np.ceil(np.log(1 - recall) / (paragraphs * np.log(miss)))))
        if best is None or bands < best[0]:
            best = (bands, rows)
    return best


def intact_words(size: int = WORDS, passage: int = PASSAGE, similarity: float = SIMILARITY) -> int:
    """Words in a row, at least, that two spans at the bar share, if the shorter one has ``passage`` words or more.

    Of m shared shingles and u others, m (1 - similarity) >= similarity u. An edit costs size - 1 shingles or
    more on each side, 2 size - 1 on both, and k edits leave k + 1 runs, the longest of m / (k + 1) shingles at least.
    Shingles that a span repeats are not counted on.
    """
    if similarity >= 1:
        return passage
    price, whole = similarity / (1 - similarity), passage - size + 1
    least = whole
    for edits in range(1, whole + 1):
        shared = max(price * (2 * size - 1) * edits, price / (1 + price) * (whole + (size - 1) * edits))
        least = min(least, int(np.ceil((shared - 1e-9) / (edits + 1))))
    return max(least, 1) + size - 1


def bands_of(size: int, passage: int, similarity: float, recall: float, paragraph: int, spread: int) -> tuple[int, int]:
    """(bands, rows): one band where every passage at the bar has an equal paragraph, tuned ones elsewhere."""
    return (1, 2) if paragraph + spread - 1 <= intact_words(size, passage, similarity) else tune_bands(similarity, recall)


def _sliding(values: np.ndarray, size: int, least) -> np.ndarray:
    """Least (or most) of each run of ``size`` values, at the run's first place."""
    out, done = values, 1
    while done < size:
        step = min(done, size - done)
        out, done = least(out[:-step], out[step:]), done + step
    return out


def anchors(shingle: np.ndarray, spread: int) -> np.ndarray:
    """Places that are the least of some run of ``spread`` places."""
    if len(shingle) < spread:
        return np.zeros(0, np.int64)
    least = _sliding(shingle, spread, np.minimum)
    edge = np.zeros(spread - 1, np.uint64)
    most = _sliding(np.concatenate([edge, least, edge]), spread, np.maximum)
    return np.flatnonzero((most == shingle) & (shingle != _LAST))


def band_keys(hashes: np.ndarray, bounds: np.ndarray, bands: int, rows: int, size: int, paragraph: int, spread: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Band keys of the paragraphs of a block, the documents they are in, the words of these they begin at, and the block's shingles."""
    made, at = texts.windows(hashes, bounds, size)
    shingle = np.full(len(hashes), _LAST, np.uint64)
    shingle[at] = made
    p = anchors(shingle, spread)
    doc = np.searchsorted(bounds, p, "right") - 1
    whole = p + paragraph <= bounds[1:][doc]
    p, doc = p[whole], doc[whole]
    keys = []
    for b in range(bands):
        key = np.full(len(p), b + 1, np.uint64)
        for r in range(rows):
            value = texts.mix(shingle * _ODDS[b * rows + r])
            least = np.full(len(p), _LAST, np.uint64)
            for j in range(paragraph - size + 1):
                np.minimum(least, value[p + j], out=least)
            key = texts.mix(key * _ODDS[63] + least)
        keys.append(key)
    return np.concatenate(keys), np.tile(doc, bands), np.tile(p - bounds[:-1][doc], bands), shingle


def beside(hashes: np.ndarray, low: np.ndarray, high: np.ndarray, first: np.ndarray, side: int) -> np.ndarray:
    """16-bit codes of the ``side`` words from word ``first`` on, 0 where they do not lie from ``low`` to before ``high``."""
    inside = (first >= low) & (first + side <= high)
    total = np.zeros(len(first), np.uint64)
    for j in range(side):
        total[inside] += hashes[first[inside] + j] * _ODDS[j]
    return np.where(inside, texts.mix(total) % np.uint64(65535) + np.uint64(1), np.uint64(0)).astype(np.int64)


def repeating(shingle: np.ndarray, p: np.ndarray, reach: int, paragraph: int) -> np.ndarray:
    """Whether a shingle around each of these places comes twice within ``reach`` words; edits are not counted there."""
    order = np.argsort(shingle, kind="stable")
    near = (shingle[order[1:]] == shingle[order[:-1]]) & (np.diff(order) <= reach) & (shingle[order[1:]] != _LAST)
    twice = np.zeros(len(shingle) + 1, np.int64)
    twice[order[1:][near] + 1] = 1
    twice[order[:-1][near] + 1] = 1
    twice = np.cumsum(twice)
    return twice[np.minimum(p + paragraph + reach // 2, len(shingle))] > twice[np.maximum(p - reach // 2, 0)]


def _keys(bands: int, rows: int, size: int, paragraph: int, spread: int, side: int):
    """``own``: the paragraph counts without the words beside it."""

    def run(batches):
        for batch in batches:
            for low, high, raw, at in texts.blocks(batch["text"]):
                _, _, hashes, bounds = texts.words(texts.LOWER[raw], at, texts.SPACED_WORD)
                keys, of, place, shingle = band_keys(hashes, bounds, bands, rows, size, paragraph, spread)
                begin, end = bounds[:-1][of], bounds[1:][of]
                p = place + begin
                if side:
                    own = repeating(shingle, p, 2 * side + paragraph, paragraph)
                    left, right = beside(hashes, begin, end, p - side, side), beside(hashes, begin, end, p + paragraph, side)
                else:
                    own, left, right = np.ones(len(p), bool), np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
                of = pa.array(of + low)
                sides = pa.array((left << 16 | right).astype(np.uint32).view(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(texts.signed(keys)), batch["id"].take(of), batch["h"].take(of), pa.array(place.astype(np.int32)), sides, pa.array(own)], ["key", "id", "h", "at", "sides", "own"]
                )

    return run, "key long, id long, h int, at int, sides int, own boolean"


def _shingles(size: int):
    """Each document's shingles in order, 32 bits each: a span needs dozens of them in a row."""

    def run(batches):
        for batch in batches:
            for low, high, raw, at in texts.blocks(batch["text"]):
                _, _, hashes, bounds = texts.words(texts.LOWER[raw], at, texts.SPACED_WORD)
                made, first = texts.windows(hashes, bounds, size)
                made = (made >> np.uint64(32)).astype(np.uint32)
                cut = np.searchsorted(first, bounds)
                own = pa.array([made[cut[d] : cut[d + 1]].tobytes() for d in range(high - low)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch["id"].slice(low, high - low), batch["h"].slice(low, high - low), own], ["id", "h", "shingles"])

    return run, "id long, h int, shingles binary"


def _summed(shingle: np.ndarray):
    """A function that gives hashes of the ``n`` shingles from each of these places on."""
    power, back = texts.powers(len(shingle) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(texts.mix(shingle + np.uint64(1)) * power[: len(shingle)], dtype=np.uint64)])
    return lambda at, n: (total[at + n] - total[at]) * back[at]


def _near(places: np.ndarray, low: int, high: int, end: int) -> np.ndarray:
    """All places from ``low`` to ``high`` words beside one of these, from 0 to before ``end``."""
    edge = np.zeros(max(end, 0) + 1, np.int64)
    np.add.at(edge, np.clip(places + low, 0, max(end, 0)), 1)
    np.add.at(edge, np.clip(places + high + 1, 0, max(end, 0)), -1)
    return np.flatnonzero(np.cumsum(edge)[:-1] > 0)


def _free(spans, words: int, passage: int) -> np.ndarray:
    """Whether each word lies between the spans, in a range that a passage fits in."""
    free = np.zeros(words, bool)
    for low, high in Covered([(s["first"], s["last"]) for s in spans or []]).free(words, passage):
        free[low : high + 1] = True
    return free


def _rows(batch, made: list[tuple[int, tuple]], columns: list[str], fields: list[tuple[str, type]]) -> pa.RecordBatch:
    """Rows of these arrays beside the columns of the batch's row that each of them is made of."""
    of = pa.array(np.concatenate([np.full(len(arrays[0]), k) for k, arrays in made]) if made else np.zeros(0, np.int64))
    values = [pa.array(np.concatenate([arrays[n] for _, arrays in made]).astype(kind) if made else np.zeros(0, kind)) for n, (_, kind) in enumerate(fields)]
    return pa.RecordBatch.from_arrays([*(batch[c].take(of) for c in columns), *values], [*columns, *(name for name, _ in fields)])


def _each_document(make, columns: list[str], fields: list[tuple[str, type]], size: int, passage: int):
    """Rows that ``make`` gives for a document's shingles, places and free words, in batches of bounded size."""

    def run(batches):
        for batch in batches:
            made, rows = [], 0
            for k, (raw, places, spans) in enumerate(zip(batch["shingles"], batch["places"], batch["covered"].to_pylist())):
                shingle = np.frombuffer(raw.as_buffer(), np.uint32).astype(np.uint64)
                made.append((k, make(shingle, places.values.to_numpy().astype(np.int64), _free(spans, len(shingle) + size - 1, passage))))
                rows += len(made[-1][1][0])
                if rows >= ROWS:
                    yield _rows(batch, made, columns, fields)
                    made, rows = [], 0
            yield _rows(batch, made, columns, fields)

    return run


_STAR = "id long, h int, label long, key long, at int, lead boolean, free boolean"
_STAR_FIELDS = [("key", np.int64), ("at", np.int32), ("lead", bool), ("free", bool)]


def _star(key: np.ndarray, at: np.ndarray, lead: np.ndarray, free: np.ndarray) -> tuple:
    """One place for each key of a document, two if it is free at one and not at another."""
    order = np.lexsort((~lead, free, key))
    key, at, lead, free = key[order], at[order], lead[order], free[order]
    keep = np.ones(len(key), bool)
    keep[1:] = (key[1:] != key[:-1]) | (free[1:] != free[:-1])
    return key[keep].view(np.int64), at[keep], lead[keep], free[keep]


def _whole(size: int, passage: int, paragraph: int, reach: int):
    """The windows of a whole passage around the places: who has one has all of its words."""
    whole = passage - size + 1

    def make(shingle, places, free):
        at = _near(places, paragraph - size + 1 - reach, 0, len(shingle) - whole + 1)
        return _star(texts.mix(_summed(shingle)(at, whole)), at, np.ones(len(at), bool), free[at] & free[at + passage - 1])

    return _each_document(make, ["id", "h", "label"], _STAR_FIELDS, size, passage), _STAR


def _first_of(key: np.ndarray, *last: np.ndarray) -> np.ndarray:
    """One place of each different key, the one with the least of these."""
    order = np.lexsort((*last[::-1], key))
    keep = np.ones(len(key), bool)
    keep[1:] = key[order[1:]] != key[order[:-1]]
    return order[keep]


def _rungs(kinds: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Equal shingles, at least, on the longer side of a gap and on the other one, for ``RUNGS`` lengths of the longer side."""
    least = min((k[0] for k in kinds), default=2)
    long = max(1, -(-least // 2))
    step = max(1, -(-(least - long) // RUNGS))
    return [(long + k * step, max(1, least - long - (k + 1) * step + 1)) for k in range(RUNGS)]


def _gaps(size: int, passage: int, similarity: float, paragraph: int, reach: int, again: bool):
    """Places where words may be others: the longer one of two equal runs ends or begins there (``key``), and ``way`` tells
    the shingle that it does not go on with. Of a document's places with the same words around them (``around``) one
    is looked at. ``again``: the places are those found so, with all gaps; the keys have the words of each rung on
    both sides, ``way`` and ``last`` what these do not go on with."""
    kinds = gap_kinds(size, passage, similarity)
    rungs = _rungs(kinds) if again else [(_rungs(kinds)[0][0], 0)]
    most = max(*(k[0] for k in kinds), *(long for long, _ in rungs)) if kinds else 0
    fields = [("key", np.int64), ("place", np.int64), ("around", np.int64), ("way", np.int32), ("last", np.int32), ("free", bool)]

    def make(shingle, places, free):
        summed, beyond, made = _summed(shingle), paragraph - size + 1, []
        for gap, side in ((g, s) for g in range((GAP + 1 if again else 1) if kinds else 0) for s in (0, 1)):
            skip, code = size - 1 + gap, (2 * gap + side) * RUNGS
            sizes = [(other, long) if side else (long, other) for long, other in rungs]
            left, right = (min(x) for x in zip(*sizes))
            if again:  # a run that begins is told by its first place
                at = places[places // (_MASKS * RUNGS) % 2 == side] // (_MASKS * _CODES) + (size - 1 - skip if side else 0)
                at = at[(at >= 0) & (at + skip + right <= len(shingle))]
            else:
                low, high = (beyond - reach - skip, -skip) if side else (beyond, reach)
                at = _near(places, low, high, len(shingle) - skip - right + 1)
            at = at[at >= left]
            # Places with the same words around them have room for the same rungs.
            begin, end = np.maximum(at - most, 0), np.minimum(at + skip + most, len(shingle))
            around = texts.mix(texts.mix(summed(begin, end - begin)) + (at - begin).astype(np.uint64) * np.uint64(4 * most) + (end - at).astype(np.uint64))
            keep = _first_of(around, ~free[at])
            at, around = at[keep], around[keep].view(np.int64)
            way, last = (texts.mix(summed(x, 1)) >> np.uint64(33) for x in (at, at + skip - 1))
            way = last if side and not again else way
            for n, (left, right) in enumerate(sizes):
                fits = np.flatnonzero((at >= left) & (at + skip + right <= len(shingle)))
                x = at[fits]
                key = texts.mix(texts.mix(summed(x - left, left) + np.uint64(2 * n + side)) + summed(x + skip, right))
                made.append((key.view(np.int64), x * _CODES + code + n, around[fits], way[fits], last[fits], free[x]))
        return tuple(np.concatenate(x) for x in zip(*made)) if made else tuple(np.zeros(0, kind) for _, kind in fields)

    return _each_document(make, ["id", "h", "label"], fields, size, passage), "id long, h int, label long, key long, place long, around long, way int, last int, free boolean"


def gap_kinds(size: int, passage: int, similarity: float) -> list[tuple[int, int, set[int]]]:
    """(shingles, gap, other gaps): with that many equal shingles on the two sides of a gap a document with the gap and
    one with any of the others are at the bar, if the later one's span is long enough."""
    if similarity >= 1:
        return []
    price, whole, kinds = similarity / (1 - similarity), passage - size + 1, {}
    for one in range(GAP + 1):
        for other in range(max(one, 1), GAP + 1):
            least = int(np.ceil(price * (2 * (size - 1) + one + other) - 1e-9))
            for later in (one, other):
                kinds.setdefault((max(least, whole - (size - 1) - later, 2), one), set()).add(other)
    return [(total, one, others) for (total, one), others in sorted(kinds.items())]


def _sided(size: int, passage: int, similarity: float):
    """All ways to part the equal shingles of a passage to the two sides of a gap: who has the same ones on each side has
    the passage but for the gap. Documents with the gap of the kind ``lead``; only kinds that others of the place have
    gaps for are made."""
    kinds = gap_kinds(size, passage, similarity)
    rungs = [long for long, _ in _rungs(kinds)] + [passage * passage]

    def make(shingle, places, free):
        summed, made = _summed(shingle), [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, bool))]
        places, known = places // _MASKS, places % _MASKS
        place, gap, side, rung = places // _CODES, places // (2 * RUNGS) % (GAP + 1), places // RUNGS % 2, places % RUNGS
        for n, (total, one, others) in enumerate(kinds):
            wanted = (gap == one) & (known & sum(1 << g for g in others) > 0) | np.isin(gap, list(others)) & (known & (1 << one) > 0)
            for left in range(1, total if wanted.any() else 1):
                right = total - left
                longer = np.where(side, right, left)
                fits = wanted & (place >= left) & (place + size - 1 + gap + right <= len(shingle)) & (longer >= np.take(rungs, rung)) & (longer < np.take(rungs, rung + 1))
                x, y = place[fits] - left, place[fits] + size - 1 + gap[fits]
                key = texts.mix(texts.mix(summed(x, left) + np.uint64(n)) * _ODDS[left % 63] + summed(y, right))
                made.append((key, x, gap[fits] == one, free[x] & free[y + right + size - 2]))
        return _star(*(np.concatenate(x) for x in zip(*made)))

    return _each_document(make, ["id", "h", "label"], _STAR_FIELDS, size, passage), _STAR


def _counted(batches):
    """Each document's words."""
    for batch in batches:
        for low, high, raw, at in texts.blocks(batch["text"]):
            bounds = texts.words(texts.LOWER[raw], at, texts.SPACED_WORD)[3]
            part = batch.slice(low, high - low)
            yield pa.RecordBatch.from_arrays([*(part[c] for c in ("a", "ah", "id", "h")), pa.array(np.diff(bounds).astype(np.int64))], ["a", "ah", "b", "bh", "words"])


def _run_edges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (in b, in a) of equal shingles whose predecessors differ or are missing: where equal runs begin.

    Equal places with equal predecessors are one range of the sorted pairs and are left out unseen, so text that
    repeats itself costs what begins in it and not the square of its length.
    """
    wide, low = np.uint64(32), np.uint64(0xFFFFFFFF)
    pair = (a[1:].astype(np.uint64) << wide) | a[:-1]
    order = np.argsort(pair, kind="stable")
    pair = pair[order]
    value = b.astype(np.uint64) << wide
    begin, end = np.searchsorted(pair, value), np.searchsorted(pair, value | low, "right")
    same = value[1:] | b[:-1]
    left = np.concatenate([begin[:1], np.searchsorted(pair, same)])
    right = np.concatenate([begin[:1], np.searchsorted(pair, same, "right")])
    place, at = [np.flatnonzero(b == a[0])], [np.zeros(int((b == a[0]).sum()), np.int64)]
    for s, e in ((begin, left), (right, end)):
        n = e - s
        i = np.repeat(np.arange(len(b)), n)
        place.append(i)
        at.append(order[np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(s, n)] + 1)
    return np.concatenate(place), np.concatenate(at)


def _runs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All longest runs of equal shingles: first place in b, first place in a and length, in order of places in b."""
    i, j = _run_edges(a, b)
    order = np.lexsort((i, j - i))
    i, j = i[order], j[order]
    k, m = _run_edges(a[::-1], b[::-1])
    k, m = len(b) - 1 - k, len(a) - 1 - m
    last = k[np.lexsort((k, m - k))]  # the same runs in the same order, by their ends
    out = np.stack([i, j, last - i + 1], 1)
    return out[np.lexsort((j, i))]


def _exact(a: np.ndarray, b: np.ndarray) -> float:
    x, y = np.unique(a), np.unique(b)
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return shared / (len(x) + len(y) - shared)


def _chained(runs: np.ndarray, price: float, most: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each run the best score of a chain that ends with it, the run before it (or -1) and the shingles it loses to that one.

    A run follows one that ends at most ``GAP`` words before it begins; few are open at a time, so they are looked
    at one by one, and all at once where text repeats itself.
    """
    n, reach = len(runs), GAP + size - 1
    best, before, trim = np.zeros(n), np.full(n, -1), np.zeros(n, np.int64)
    end_b, end_a = runs[:, 0] + runs[:, 2], runs[:, 1] + runs[:, 2]
    active: list[tuple[int, int, int, float]] = []  # run, its ends in b and a, its score
    for r, (i, j, length) in enumerate(runs.tolist()):
        active = [x for x in active if x[1] + reach >= i]
        gain, last, lost = 0.0, -1, 0
        if len(active) <= 48:
            for x, e, f, score in active:
                over = max(0, e - i, f - j)
                if over >= length or i + over - e > reach:
                    continue
                cost = price * ((i + over - e) + (j + over - f))
                if cost <= most and (last < 0 or score - over - cost > gain):
                    gain, last, lost = score - over - cost, x, over
        else:
            at = np.array([x[0] for x in active])
            over = np.maximum(0, np.maximum(end_b[at] - i, end_a[at] - j))
            cost = price * ((i + over - end_b[at]) + (j + over - end_a[at]))
            gains = np.where((over < length) & (i + over - end_b[at] <= reach) & (cost <= most), best[at] - over - cost, -np.inf)
            x = int(np.argmax(gains))
            if gains[x] > -np.inf:
                gain, last, lost = float(gains[x]), int(at[x]), int(over[x])
        best[r], before[r], trim[r] = length + max(0.0, gain), last, lost
        active.append((r, i + length, j + length, best[r]))
    return best, before, trim


def _aligned(a: np.ndarray, b: np.ndarray, size: int, passage: int, similarity: float) -> tuple[int, int] | None:
    """First and last of the longest row of shingles of b that stand, in this order, in a span of a at the similarity.

    Runs are chained in the order of both documents. A span of m shared shingles and u others, on both sides
    together, is at the bar if m (1 - similarity) >= similarity u, a sum over the runs and gaps of a chain, so
    every part of a chain that reaches it is found; then the exact Jaccard similarity of the two spans decides.
    """
    price = similarity / (1 - similarity) if similarity < 1 else float(len(a) + len(b))
    runs, least = _runs(a, b), passage - size + 1
    whole = runs[:, 2].max(initial=0)
    if whole >= least and whole == len(b):
        return 0, len(b) - 1
    n, end_b = len(runs), runs[:, 0] + runs[:, 2]
    best, before, trim = _chained(runs, price, len(b), size)
    ends = np.setdiff1d(np.arange(n), before)
    found, longest = None, least - 1
    for leaf in ends[np.argsort(-best[ends], kind="stable")].tolist():
        chain = [leaf]
        while before[chain[-1]] >= 0:
            chain.append(int(before[chain[-1]]))
        chain = np.array(chain[::-1])
        if end_b[leaf] - runs[chain[0], 0] <= longest:
            continue
        for s, e in _parts(a, b, runs[chain], trim[chain], longest + 1, similarity, price):
            if e - s + 1 > longest:
                found, longest = (s, e), e - s + 1
    return found


def _parts(a: np.ndarray, b: np.ndarray, runs: np.ndarray, trim: np.ndarray, least: int, similarity: float, price: float) -> list[tuple[int, int]]:
    """The longest parts of a chain at the bar, from each of its runs on."""
    n = len(runs)
    first_b, first_a, length = runs[:, 0], runs[:, 1], runs[:, 2]
    end_b, end_a = first_b + length, first_a + length
    cost = np.zeros(n)
    cost[1:] = price * ((first_b + trim)[1:] - end_b[:-1] + (first_a + trim)[1:] - end_a[:-1])
    upto = np.cumsum(length - trim - cost)  # the score of runs p to q: upto[q] less what lies before p, whose whole run counts
    start = upto - length
    after = np.maximum.accumulate(upto[::-1])[::-1]
    tried, found = set(), []
    todo = [(0, n - 1)] + [(p, max(p, int(np.searchsorted(-after, -(start[p] - 1e-9), "right")) - 1)) for p in range(n)]
    while todo:
        p, q = todo.pop(0)
        if p > q or (p, q) in tried or end_b[q] - first_b[p] < least or any(x <= p and q <= y for x, y in found):
            continue
        tried.add((p, q))
        if p == q or _exact(a[first_a[p] : end_a[q]], b[first_b[p] : end_b[q]]) >= similarity - 1e-12:
            found.append((p, q))
        else:  # part it at the widest gap
            k = p + 1 + int(np.argmax(cost[p + 1 : q + 1]))
            todo += [(p, k - 1), (k, q)]
    return [(int(first_b[p]), int(end_b[q]) - 1) for p, q in found]


def common_spans(a: np.ndarray, b: np.ndarray, size: int, passage: int, similarity: float) -> list[tuple[int, int]]:
    """Word ranges of b, ``passage`` words or longer, with a counterpart in a, itself a span, at the similarity.

    Stretches of shingles that a has anywhere, with at most ``GAP`` other words in between, bound where a span can
    be; in those that are long enough the places in a are looked up and aligned, unless the stretch as a whole is at
    the bar with the words of a that its shingles lie between. The longest span is taken, and the words before and
    after it are looked at anew, so ranges do not overlap and each is at the bar by itself.
    """
    if not len(a) or not len(b):
        return []
    order = np.argsort(a, kind="stable")
    at = order[np.minimum(np.searchsorted(a, b, sorter=order), len(a) - 1)]
    match = a[at] == b
    edge = np.diff(np.concatenate([[0], match.astype(np.int8), [0]]))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1 + size - 1  # words
    if not len(first):
        return []
    joined = np.flatnonzero(first[1:] - last[:-1] - 1 > GAP)
    low, high = first[np.concatenate([[0], joined + 1])], last[np.concatenate([joined, [len(first) - 1]])]
    out, todo = [], [(s, e) for s, e in zip(low.tolist(), high.tolist())]
    while todo:
        s, e = todo.pop()
        if e - s + 1 < passage:
            continue
        part, between = b[s : e - size + 2], at[s : e - size + 2][match[s : e - size + 2]]
        if len(between) and between.max() - between.min() < len(part) / similarity and _exact(a[between.min() : between.max() + 1], part) >= similarity:
            out.append((s, e))
            continue
        found = _aligned(a, b[s : e - size + 2], size, passage, similarity)
        if found is not None:
            x, y = s + found[0], s + found[1] + size - 1
            out.append((x, y))
            todo += [(s, x - 1), (y + 1, e)]
    return sorted(out)


class Covered:
    """Word ranges of a document that are found so far; they do not overlap."""

    def __init__(self, spans: list[tuple[int, int]]) -> None:
        self.spans = sorted(spans)

    def free(self, words: int, passage: int) -> list[tuple[int, int]]:
        """Ranges between them that a passage fits in."""
        edges = [(-1, -1), *self.spans, (words, words)]
        return [(x[1] + 1, y[0] - 1) for x, y in zip(edges, edges[1:]) if y[0] - x[1] - 1 >= passage]

    def add(self, span: tuple[int, int]) -> None:
        self.spans = sorted([*self.spans, span])


def _verified(size: int, passage: int, similarity: float, wide: int):
    """Rows of a document stand together, those with more colliding places (of ``wide`` words) first.

    A pair that has to be ``linked`` and has no span of its own gives a row with places of -1 if it is at the bar
    around its places, whatever is cut there.
    """

    def run(batches):
        now, covered = None, Covered([])
        for batch in batches:
            keep, rows = [], []
            columns = (batch[c] for c in ("shingles_a", "shingles_b", "places", "covered"))
            for k, (b, h, linked, (x, y, places, before)) in enumerate(zip(batch["b"].to_pylist(), batch["bh"].to_pylist(), batch["linked"].to_pylist(), zip(*columns))):
                if (b, h) != now:
                    now, covered = (b, h), Covered([(s["first"], s["last"]) for s in before.as_py() or []])
                at = places.values.to_numpy().astype(np.int64)
                other, mine = np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32)
                for low, high in covered.free(len(mine) + size - 1, passage):
                    # A paragraph that is not covered reaches into the range.
                    if not ((at <= high) & (at + wide - 1 >= low)).any():
                        continue
                    for s, e in common_spans(other, mine[low : high - size + 2], size, passage, similarity):
                        covered.add((low + s, low + e))
                        keep.append(k)
                        rows.append((low + s, low + e))
                if linked and not (keep and keep[-1] == k):
                    at = np.sort(at)
                    parts = np.split(at, np.flatnonzero(np.diff(at) > 2 * NEAR) + 1)
                    if any(common_spans(other, mine[max(0, int(p[0]) - NEAR) : int(p[-1]) + wide + NEAR], size, passage, similarity) for p in parts):
                        keep.append(k)
                        rows.append((-1, -1))
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch[c].take(at) for c in ("a", "ah", "b", "bh")), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], ["a", "ah", "b", "bh", "first", "last"]
            )

    return run, "a long, ah int, b long, bh int, first long, last long"


def repeated_passages(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = WORDS,
    passage: int = PASSAGE,
    similarity: float = SIMILARITY,
    recall: float = RECALL,
    paragraph: int = PARAGRAPH,
    spread: int = SPREAD,
) -> DataFrame:
    """Spans to remove: ``id`` with words ``first`` to ``last`` that the earlier document ``keeper_id`` has,
    and ``component_id``, the smallest id of the cluster of documents that removals and links join.

    Words are lower-cased (A-Z) runs without ASCII white space. The document with the smallest id keeps a
    passage, so of every passage one copy stays. Documents of fewer than ``passage`` words, null and empty
    texts have no spans. Rows without id are neither compared nor cut; equal rows of an id count as one document,
    rows of an id with other texts (``h``, a hash of the text) as documents of their own. One document can have
    several spans, which do not overlap. Other columns of the input are not read.
    """
    spark = documents.sparkSession
    texts.small_batches(spark)
    bands, rows = bands_of(size, passage, similarity, recall, paragraph, spread)
    text = F.col(f"`{text_col}`")
    docs = documents.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.hash(text).alias("h"), text.alias("text")).where("id is not null and text is not null")
    # Equal texts: all but the first one are copies, and only that one is compared with other texts.
    same = docs.select("id", "h", F.xxhash64("text").alias("x"), F.length("text").alias("n"))
    first = same.groupBy("h", "x", "n").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z").select("h", "x", "n", "a")
    copies = same.join(first, ["h", "x", "n"]).where("id > a").select("id", "h", "a").distinct()
    copies = store.stored(copies, "copies")
    again = docs.join(copies, ["id", "h"]).select("a", F.col("h").alias("ah"), "id", "h", "text")
    again = again.mapInArrow(_counted, "a long, ah int, b long, bh int, words long").where(F.col("words") >= passage).dropDuplicates(["b", "bh"])
    again = again.select("a", "ah", "b", "bh", F.lit(0).cast("long").alias("first"), (F.col("words") - 1).alias("last"))
    again = store.stored(again, "again")
    docs = docs.join(copies.select("id", "h"), ["id", "h"], "left_anti")

    intact = intact_words(size, passage, similarity)
    exact = paragraph + spread - 1 <= intact  # every pair at the bar shares that many words around an equal paragraph
    side = -(-(intact - paragraph) // 2) if exact else 0
    reach = (intact if exact else passage) - size + 1
    none = F.array().cast("array<struct<first:bigint,last:bigint>>")
    several = "low_id < high_id or low_h < high_h"
    bounds = [F.min("id").alias("low_id"), F.max("id").alias("high_id"), F.min("h").alias("low_h"), F.max("h").alias("high_h")]

    # Counts combine before they are shuffled, and Spark splits hot keys of the joins. Sides with one row for each key
    # are hashed, so the long ones need no sort.
    keys = store.stored(docs.mapInArrow(*_keys(bands, rows, size, paragraph, spread, side)), "keys")
    twice = keys.groupBy("key").agg(*bounds).where(several).select("key")
    left, right = F.shiftrightunsigned("sides", 16), F.col("sides").bitwiseAND(0xFFFF)
    ways = [F.when(left > 0, F.xxhash64("key", F.lit(1), left)), F.when(right > 0, F.xxhash64("key", F.lit(2), right)), F.when(F.col("own"), F.col("key"))]
    near = keys.join(twice.hint("shuffle_hash"), "key").select(F.explode(F.array_compact(F.array(*ways))).alias("key"), "id", "h", "at")
    near = store.stored(near, "near")
    first = near.groupBy("key").agg(*bounds, F.min_by("h", "id").alias("ah")).where(several).select("key", F.col("low_id").alias("a"), "ah")
    # All documents of a key, the first one too.
    shared = store.stored(near.join(first.hint("shuffle_hash"), "key"), "shared")
    store.dropped(spark, keys, near)
    later = (F.col("id") > F.col("a")) | (F.col("h") != F.col("ah"))
    pairs = shared.where(later).groupBy("a", "ah", F.col("id").alias("b"), F.col("h").alias("bh")).agg(F.collect_set("at").alias("places"))
    pairs = store.stored(pairs, "pairs")
    sides = F.explode(F.array(F.struct(F.col("a").alias("w_id"), F.col("ah").alias("w_h")), F.struct(F.col("b").alias("w_id"), F.col("bh").alias("w_h"))))
    wanted = store.stored(pairs.select(sides.alias("w")).select("w.*").distinct(), "wanted")
    # Dealt out by id whatever the sizes; one of equal rows is left there, and only its shingles are stored.
    held = docs.join(wanted.hint("merge"), (F.col("id") == F.col("w_id")) & (F.col("h") == F.col("w_h")), "left_semi").dropDuplicates(["id", "h"])
    held = store.stored(held.mapInArrow(*_shingles(size)), "shingles")

    def verified(pairs: DataFrame, words: int) -> DataFrame:
        for s in ("a", "b"):
            pairs = pairs.join(held.select(F.col("id").alias(s), F.col("h").alias(f"{s}h"), F.col("shingles").alias(f"shingles_{s}")), [s, f"{s}h"])
        # The number keeps the pairs of a document in one task, in this order.
        turn = Window.partitionBy("b", "bh").orderBy(F.desc(F.size("places")), "a", "ah")
        pairs = pairs.withColumn("turn", F.row_number().over(turn))
        return store.stored(pairs.mapInArrow(*_verified(size, passage, similarity, words)), "spans")

    def clusters(found: DataFrame) -> DataFrame:
        return components(found.where("a <> b").select("a", "b").distinct())

    def unverified(candidates: DataFrame, covered: DataFrame) -> DataFrame:
        again = candidates.groupBy("a", "ah", "b", "bh").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.max(F.col("label") != F.col("a_label")).alias("linked"))
        # Of two texts with one id that has cut the other stays.
        reverse = direct.where("a = b").select(F.col("b").alias("a"), F.col("bh").alias("ah"), F.col("a").alias("b"), F.col("ah").alias("bh")).distinct()
        again = again.join(reverse, ["a", "ah", "b", "bh"], "left_anti").join(covered, ["b", "bh"], "left")
        return again.withColumn("covered", F.coalesce("covered", none))

    def cut(spans: DataFrame) -> DataFrame:
        return spans.where("first >= 0").groupBy("b", "bh").agg(F.collect_list(F.struct("first", "last")).alias("covered"))

    # What the first documents leave: keys of several components, or whose later documents have the paragraph outside their spans.
    direct = verified(pairs.withColumn("covered", none).withColumn("linked", F.lit(False)), paragraph)
    labels, covered = store.stored(clusters(direct), "labels"), cut(direct)
    inside = F.exists("covered", lambda x: (x["first"] <= F.col("at")) & (F.col("at") + (paragraph - 1) <= x["last"]))
    state = wanted.toDF("id", "h").join(labels, F.col("id") == F.col("node"), "left").drop("node").join(covered.toDF("id", "h", "covered"), ["id", "h"], "left")
    marked = shared.join(store.stored(state, "state").hint("shuffle_hash"), ["id", "h"], "left")
    marked = marked.select("key", "id", "h", "at", F.coalesce("label", "id").alias("label"), later.alias("later"), (later & ~F.coalesce(inside, F.lit(False))).alias("open"))
    marked = store.stored(marked, "marked")
    store.dropped(spark, shared, pairs)
    # The first document of a key has been compared with all others: what is open can only be in a third one.
    one = F.struct("id", "h")
    others = [F.min(F.when(F.col("later"), one)).alias("low_b"), F.max(F.when(F.col("later"), one)).alias("high_b")]
    unsettled = marked.groupBy("key").agg(F.max("open").alias("open"), F.min("label").alias("low"), F.max("label").alias("high"), *others)
    unsettled = unsettled.where("(open and low_b < high_b) or low < high").select("key")
    own = marked.join(unsettled.hint("shuffle_hash"), "key").groupBy("id", "h", "label").agg(F.collect_set("at").alias("places"))
    own = own.join(covered.toDF("id", "h", "covered"), ["id", "h"], "left").withColumn("covered", F.coalesce("covered", none))
    own = store.stored(held.join(own, ["id", "h"]), "own")
    store.dropped(spark, marked)

    # Gaps that differ between equal shingles, then every way to have enough of these around them.
    ends = [f(c).alias(f"{n}_{c}") for c in ("way", "last", "label") for f, n in ((F.min, "low"), (F.max, "high"))]

    def differing(gaps: DataFrame, both: str) -> DataFrame:
        """Of the documents with the same words around a place, the first one: they have whole windows in common."""
        gaps = store.stored(gaps, "gaps")
        differ = gaps.groupBy("key").agg(*ends, F.max("free").alias("free"), F.bit_or(F.expr(f"shiftleft(1, cast(place div {2 * RUNGS} % {GAP + 1} as int))")).alias("known"))
        differ = differ.where(f"{both} and (free or low_label < high_label)").select("key", "known")
        first = F.min_by(F.struct("id", "h", "label", "free", (F.col("place") * _MASKS + F.col("known")).alias("place")), one)
        found = store.stored(gaps.join(differ.hint("shuffle_hash"), "key").groupBy("key", "around").agg(first.alias("x")).select("key", "x.*"), "differing")
        store.dropped(spark, gaps)
        return found

    def placed(found: DataFrame) -> DataFrame:
        places = store.stored(found.groupBy("id", "h").agg(F.collect_set("place").alias("places")), "places")
        return own.drop("places").join(places, ["id", "h"])

    pair = [F.col("p.id").alias("a"), F.col("p.h").alias("ah"), F.col("q.id").alias("b"), F.col("q.h").alias("bh"), F.col("p.label").alias("a_label"), F.col("q.label").alias("label")]
    beside = placed(differing(own.mapInArrow(*_gaps(size, passage, similarity, paragraph, reach, False)), "low_way < high_way"))
    found = differing(beside.mapInArrow(*_gaps(size, passage, similarity, paragraph, reach, True)), "int(low_way < high_way) + int(low_last < high_last) + int(bit_count(known) > 1) > 1")
    many = found.groupBy("key").count().where(f"count > {FEW}").select("key")
    at = F.greatest(F.expr(f"place div {_MASKS * _CODES}") - passage // 2, F.lit(0)).cast("int").alias("at")
    few = found.join(many, "key", "left_anti").groupBy("key").agg(F.collect_list(F.struct("id", "h", "label", "free", at)).alias("all"))
    few = few.select(F.explode("all").alias("q"), "all").select("q", F.explode(F.filter("all", lambda p: (F.struct(p["id"], p["h"]) < F.struct("q.id", "q.h")) & (F.col("q.free") | (p["label"] != F.col("q.label"))))).alias("p"))
    few = few.groupBy(*pair).agg(F.collect_set("q.at").alias("places"))
    beside = placed(found.join(many, "key", "left_semi"))
    beside = beside.mapInArrow(*_sided(size, passage, similarity))
    parts = store.stored(own.mapInArrow(*_whole(size, passage, paragraph, reach)).unionByName(beside), "parts")
    lead = F.min_by(F.when(F.col("lead"), F.struct("id", "h", "label", "at", "free")), F.when(F.col("lead"), F.struct("id", "h", ~F.col("free")))).alias("one")
    first = parts.groupBy("key").agg(*bounds, lead).where(f"({several}) and one is not null").select("key", "one")
    stars = parts.join(first.hint("shuffle_hash"), "key").where("id <> one.id or h <> one.h")
    stars = stars.select(F.struct("id", "h", "label", "at", "free").alias("x"), F.col("one").alias("y")).withColumn("up", F.expr("struct(x.id, x.h) > struct(y.id, y.h)"))
    a, b = F.when(F.col("up"), F.col("y")).otherwise(F.col("x")), F.when(F.col("up"), F.col("x")).otherwise(F.col("y"))
    stars = stars.select(a.alias("p"), b.alias("q")).where("q.free or p.label <> q.label")
    stars = stars.groupBy(*pair).agg(F.collect_set("q.at").alias("places")).unionByName(few)
    spans = direct.unionByName(verified(unverified(stars, covered), passage)).unionByName(again)
    spans = store.stored(spans, "spans")
    store.dropped(spark, own, parts, found, labels, held, wanted, again, copies)
    labels = clusters(spans)
    label = F.coalesce("label", "b").alias("component_id")
    spans = spans.where("first >= 0")
    return spans.join(labels, spans["b"] == labels["node"], "left").select(F.col("b").alias("id"), F.col("bh").alias("h"), F.col("a").alias("keeper_id"), "first", "last", label)


def remove_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without the words of those spans; a document that has no word left goes, all others stay.

    Cases are those of ``repeated_passages``; documents without spans stay as they are, null texts too. Only the
    text changes, whatever the other columns are called.
    """
    names = documents.columns
    place = names.index(text_col)
    plain = store.numbered_columns(documents)
    found = repeated_passages(documents, id_col, text_col, **options)
    spans = found.groupBy(F.col("id").alias("span_id"), F.col("h").alias("span_h")).agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    key = (F.col(f"c{names.index(id_col)}").cast("long") == F.col("span_id")) & (F.hash(f"c{place}") == F.col("span_h"))
    joined = plain.join(spans, key, "left")
    whole = joined.where("span_id is null").select(*plain.columns)
    cut = joined.where("span_id is not null").drop("span_id", "span_h")

    def run(batches):
        for batch in batches:
            texts_, alive = [], []
            for value, spans_ in zip(batch[f"c{place}"].to_pylist(), batch["spans"].to_pylist()):
                raw, at = texts.utf8(pa.array([value]))
                starts, _, _, _ = texts.words(raw, at, texts.SPACED_WORD)
                stay = np.ones(len(starts), bool)
                for s in spans_:
                    stay[s["first"] : s["last"] + 1] = False
                mask = np.repeat(stay, np.diff(np.concatenate([[0], starts[1:], [len(raw)]])))
                texts_.append(raw[mask].tobytes().decode())
                alive.append(bool(stay.any()))
            columns = [batch[c] for c in batch.schema.names if c != "spans"]
            columns[place] = pa.array(texts_, columns[place].type)
            yield pa.RecordBatch.from_arrays(columns, [c for c in batch.schema.names if c != "spans"]).filter(pa.array(alive, pa.bool_()))

    schema = T.StructType([f for f in cut.schema.fields if f.name != "spans"])
    return whole.unionByName(cut.mapInArrow(run, schema)).toDF(*names)


def op7_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = repeated_passages(documents)
    return found.select(F.col("id").alias("doc_id"), "keeper_id", F.col("first").alias("first_word"), (F.col("last") - F.col("first") + 1).alias("n_words"), "component_id")
