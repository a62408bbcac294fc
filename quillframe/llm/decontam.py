"""Benchmark decontamination by q-gram lemma filtering.

An item of m characters that occurs in a text with at most k edits shares at least m + 1 - q (k + 1) of its q-grams with it, on
diagonals that lie within k of the occurrence's. Shared q-grams are counted in overlapping bands of diagonals; bands that meet the
bound are verified by banded alignment.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import small_batches

#: Characters of items that one index holds; more items are searched in blocks, one pass over the texts each.
BLOCK_CHARS = 16_000_000
#: Pairs of an item's and a text's equal q-grams that are held at once; items are taken in groups that stay below it.
PAIRS = 2_000_000
BITS = 23
BASE = np.uint32(0x9E3779B1)


def normal(text: str | None) -> str:
    """Lower case, with one space for each run of white space."""
    return " ".join(text.lower().split()) if text else ""


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(c: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q characters from each place on."""
    if len(c) < q:
        return c[:0]
    if q == 1:
        return c
    half = q // 2
    h = grams(c, half)
    h = h[:-half] * np.uint32(pow(int(BASE), half, 1 << 32)) + h[half:]
    return h[:-1] * BASE + c[q - 1 :] if q % 2 else h


#: Longest q-gram; an item takes a shorter one where its edits would leave the lemma nothing to count.
Q = 8


@dataclass
class Index:
    """Items of one q."""

    q: int
    ids: list[int]
    texts: list[str]
    edits: np.ndarray  # k of each item
    least: np.ndarray  # shared q-grams that the lemma asks for
    key: np.ndarray  # hash of a q-gram, then its item; sorted
    place: np.ndarray  # of each gram
    seen: np.ndarray  # which leading bits of a hash occur


def slot(h: np.ndarray) -> np.ndarray:
    return (h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)


def index(items: list[tuple[int, str]], rate: float) -> list[Index]:
    """One index for each q in use. rate: edits allowed for each character of an item, rounded down, at most all but one."""
    by_q: dict[int, list[tuple[int, str, int]]] = {}
    for i, t in ((i, normal(t)) for i, t in items):
        if t:
            k = min(int(rate * len(t)), len(t) - 1)
            by_q.setdefault(min(Q, len(t) // (k + 1)), []).append((i, t, k))
    return [_index(q, known) for q, known in sorted(by_q.items())]


def _index(q: int, known: list[tuple[int, str, int]]) -> Index:
    m = np.array([len(t) for _, t, _ in known], np.int64)
    k = np.array([k for _, _, k in known], np.int64)
    h = [grams(codes(t), q) for _, t, _ in known]
    item = np.repeat(np.arange(len(known), dtype=np.uint64), [len(x) for x in h])
    gram = np.concatenate(h)
    key = gram.astype(np.uint64) << np.uint64(32) | item
    place = np.concatenate([np.arange(len(x), dtype=np.int32) for x in h])
    order = np.argsort(key, kind="stable")
    seen = np.zeros(1 << BITS, bool)
    seen[slot(gram)] = True
    return Index(q, [i for i, _, _ in known], [t for _, t, _ in known], k, m + 1 - q * (k + 1), key[order], place[order], seen)


def align(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """Least edits between the item and any part of `text`, where that is at most `most`: (edits, start, end). Rows hold a band only.

    text begins and ends where the band of diagonals does; each row keeps the diagonals from 0 to len(text) - len(item) and `most`
    to either side.
    """
    m, n = len(item), len(text)
    width = max(n - m, 0) + 2 * most + 1
    big = m + n + 1
    # row i, column c: text place i + c - most
    row = np.zeros(width, np.int64)
    where = np.arange(width) - most
    start = np.clip(where, 0, n)
    row[(where < 0) | (where > n)] = big
    steps = np.arange(width)
    for i in range(1, m + 1):
        where = i + steps - most  # characters of the text used up
        use = np.clip(where - 1, 0, max(n - 1, 0))
        same = (text[use] == item[i - 1]) if n else np.zeros(width, bool)
        best = row + ~same
        best[(where < 1) | (where > n)] = big
        first = start
        up = np.append(row[1:], big) + 1
        take = up < best
        best = np.where(take, up, best)
        first = np.where(take, np.append(start[1:], 0), first)
        best[where == 0] = i
        best[(where < 0) | (where > n)] = big
        # characters of the text skipped: least of what lies to the left, a step each
        level = best - steps
        low = np.minimum.accumulate(level)
        came = np.maximum.accumulate(np.where(level == low, steps, 0))
        row = low + steps
        start = first[came]
        row[(where < 0) | (where > n)] = big
        if row.min() > most:
            return None
    c = int(row.argmin())
    if row[c] > most:
        return None
    return int(row[c]), int(start[c]), m + c - most


def search(item: str, text: str, anchored: bool = False) -> tuple[int, int]:
    """Least edits between the item and a part of the text, and where the first such part ends; anchored: a part that begins at 0.

    The column of differences is a pair of long integers, so time is the text's length times that of the item over a word, and
    memory is the item's.
    """
    m = len(item)
    every, top = (1 << m) - 1, 1 << (m - 1)
    has: dict[str, int] = {}
    for k, c in enumerate(item):
        has[c] = has.get(c, 0) | 1 << k
    up, down, score = every, 0, m
    best, end = m, 0
    for at, c in enumerate(text, 1):
        eq = has.get(c, 0)
        x = eq | down
        same = ((((eq & up) + up) ^ up) | eq) & every
        plus, minus = (down | ~(same | up)) & every, up & same
        score += bool(plus & top) - bool(minus & top)
        plus, minus = (plus << 1 | anchored) & every, minus << 1 & every
        up, down = (minus | ~(x | plus)) & every, plus & x
        if score < best:
            best, end = score, at
    return best, end


def leaks(texts: list[str], indexes: list[Index]) -> list[list[tuple[int, int, int, int]]]:
    """For each normal text the items that occur in it: (item_id, edits, start, end). All texts are searched together."""
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
    if texts:
        gap = "\0" * Q
        c = codes(gap.join(texts))
        starts = np.cumsum([0] + [len(t) + Q for t in texts])
        for ix in indexes:
            _leaks(texts, starts, c, ix, out)
    return out


def _leaks(texts: list[str], starts: np.ndarray, c: np.ndarray, ix: Index, out: list) -> None:
    h = grams(c, ix.q)
    at = np.flatnonzero(ix.seen[slot(h)])
    h = h[at].astype(np.uint64) << np.uint64(32)
    low = np.searchsorted(ix.key, h, "left")
    n = np.searchsorted(ix.key, h | np.uint64(0xFFFFFFFF), "right") - low
    at, h, low, n = at[n > 0], h[n > 0], low[n > 0], n[n > 0]
    if not len(at):
        return
    if int(n.sum()) <= PAIRS:
        _bands(texts, starts, ix, at, low, n, out)
        return
    # pairs of each item: how often each of its q-grams is met
    met = np.zeros(len(ix.key) + 1, np.int64)
    np.add.at(met, low, 1)
    np.add.at(met, low + n, -1)
    pairs = np.bincount((ix.key & np.uint64(0xFFFFFFFF)).astype(np.int64), weights=np.cumsum(met[:-1]), minlength=len(ix.ids))

    def of(first: int, last: int):
        a = np.searchsorted(ix.key, h | np.uint64(first), "left")
        b = np.searchsorted(ix.key, h | np.uint64(last), "right") - a
        return at[b > 0], a[b > 0], b[b > 0]

    first = 0
    while first < len(pairs):
        last, total = first, pairs[first]
        while last + 1 < len(pairs) and total + pairs[last + 1] <= PAIRS:
            last += 1
            total += pairs[last]
        where, a, b = of(first, last)
        if total <= PAIRS:
            if total:
                _bands(texts, starts, ix, where, a, b, out)
        else:  # one item whose q-grams repeat: texts that repeat them too are searched in full, each of the rest by bands
            edge = np.searchsorted(where, starts)
            for d in range(len(texts)):
                x = slice(edge[d], edge[d + 1])
                own = int(b[x].sum())
                if own > PAIRS:
                    item, text = ix.texts[first], texts[d]
                    edits, end = search(item, text)
                    if edits <= ix.edits[first]:
                        length = search(item[::-1], text[max(0, end - len(item) - edits) : end][::-1], anchored=True)[1]
                        out[d].append((ix.ids[first], edits, end - length, end))
                elif own:
                    _bands(texts, starts, ix, where[x], a[x], b[x], out)
        first = last + 1


def _bands(texts: list[str], starts: np.ndarray, ix: Index, at: np.ndarray, low: np.ndarray, n: np.ndarray, out: list) -> None:
    """Counts shared q-grams in bands of diagonals and verifies the bands that meet the bound. A text place at[x] meets entries low[x] to low[x] + n[x]."""
    entry = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    item = (ix.key[entry] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    place = ix.place[entry].astype(np.int64)
    wide = 2 * ix.edits[item] + 1
    band = (np.repeat(at, n) - place) // wide
    offset = 1 << 40
    key = item * (offset << 1) + band + (offset >> 1)
    key = np.concatenate([key, key - 1])  # each band overlaps the next by half
    place = np.concatenate([place] * 2)
    order = np.lexsort((place, key))
    key, place = key[order], place[order]
    new = np.append(True, key[1:] != key[:-1])
    # the lemma counts q-grams of the item: one that a repetitive text holds many times counts once
    counts = np.add.reduceat((new | np.append(True, place[1:] != place[:-1])).astype(np.int64), np.flatnonzero(new))
    band_keys = key[new]
    items = band_keys // (offset << 1)
    done: set[tuple[int, int]] = set()
    for g in np.flatnonzero(counts >= ix.least[items]):
        i = int(items[g])
        k, m = int(ix.edits[i]), len(ix.texts[i])
        first = (int(band_keys[g] % (offset << 1)) - (offset >> 1)) * (2 * k + 1)
        a, b = first - k, first + 2 * (2 * k + 1) + m + k
        lo, hi = int(np.searchsorted(starts, max(a, 0), "right")) - 1, int(np.searchsorted(starts, b, "left"))
        for d in range(max(lo, 0), min(hi, len(texts))):
            left, right = max(a, int(starts[d])), min(b, int(starts[d]) + len(texts[d]))
            if (d, i) in done or right - left < m - k:
                continue
            part = texts[d][left - int(starts[d]) : right - int(starts[d])]
            found = part.find(ix.texts[i])
            got = (0, found, found + m) if found >= 0 else align(codes(ix.texts[i]), codes(part), k) if k else None
            if got:
                done.add((d, i))
                base = left - int(starts[d])
                out[d].append((ix.ids[i], got[0], base + got[1], base + got[2]))


LEAKS = "array<struct<item_id:long,edits:int,start:int,end:int>>"


def _finder(indexes: list[Index]):
    @F.pandas_udf(LEAKS)
    def find(texts: pd.Series) -> pd.Series:
        found = leaks([normal(t) for t in texts], indexes)
        return pd.Series([[{"item_id": i, "edits": e, "start": a, "end": b} for i, e, a, b in sorted(x)] for x in found], dtype=object)

    return find


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.10) -> DataFrame:
    """Adds leaks: the benchmark items that occur in a text with at most rate edits a character (item_id, edits, start, end in the normal text).

    Texts and items are compared in lower case with white space collapsed; whole texts are searched, in one pass without a shuffle.
    Items come to the driver in blocks of at most BLOCK_CHARS characters, one pass each. Items of any length are found inside
    texts, short ones too, with no edits below 1 / rate characters; null and empty items match nothing, items with a null item_id are
    left out. Null and empty texts have no leaks. Memory is bounded for repetitive texts and items as well (PAIRS).
    Rows pass through one to one (a column named leaks is replaced); an empty table stays empty.
    """
    small_batches(docs.sparkSession)
    items = benchmark.filter("item_id is not null and text is not null").select("item_id", "text")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_CHARS)
    kept = [c for c in docs.columns if c != "leaks" and not c.startswith("_leaks")]
    out = docs.select(*kept)
    for b in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        indexes = index([(r[0], r[1]) for r in part.collect()], rate)
        out = out.withColumn(f"_leaks{b}", _finder(indexes)(F.coalesce("text", F.lit(""))))
    none = F.array().cast(LEAKS)
    return out.select(*kept, F.concat(none, *[F.col(f"_leaks{b}") for b in range(blocks)]).alias("leaks"))
