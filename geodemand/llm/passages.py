"""Near-duplicate passages: compact windows of token min-hashes, interval joins, verification on the texts."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from geodemand.llm.common import hash_words, lower_ascii, mix64, pick, prepare, ragged, text_slices, utf8, word_bounds
from geodemand.llm.decontaminate import WORD

SHINGLE = 5
_CONTEXT = 12
_REACH = (1 << 15) - 1
_LEAST_RUN = 4
_LOOK_BACK = 64
_FEW = 8 << 20  # bytes of compressed texts that are sent to all tasks at once, at most
_CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165,
                 0x2545F4914F6CDD1D, 0xBF58476D1CE4E5B9], dtype=np.uint64)


def shingles(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the five words from each word on, 0 where a row has fewer left; first word of each row and the total)."""
    raw = lower_ascii(raw)
    starts, ends, first = word_bounds(raw, off, WORD)
    words = hash_words(raw, starts, ends)
    n = len(words)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(min(SHINGLE, n)):
        out[:n - j] += words[j:] * _ODD[j]
    out = mix64(out) | np.uint64(1)
    count = np.diff(first)
    short = np.minimum(count, SHINGLE - 1)
    out[ragged(first[1:] - short, short)] = 0
    return out, first


def compact_windows(value: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centre, left, right) of the compact windows of ``least`` tokens or more.

    A window holds every sequence that contains its centre and in which the
    centre's value is the smallest (the leftmost of equals): the subtree of a node
    of the Cartesian tree over the values. 0 separates rows and belongs to none.
    Extents are found by doubling over range minima, for centres that are the
    minimum of a run to one side that any long enough window must hold.
    """
    n = len(value)
    levels = [value]
    longest = int(np.diff(np.flatnonzero(np.concatenate(([True], value == 0, [True])))).max(initial=1))
    while (1 << len(levels)) <= longest:
        step = 1 << (len(levels) - 1)
        last = levels[-1]
        up = np.empty(n, dtype=np.uint64)
        if n > step:
            np.minimum(last[:n - step], last[step:], out=up[:n - step])
        up[max(0, n - step):] = 0
        levels.append(up)
    side = max(0, ((least + 1) // 2).bit_length() - 1)
    if side >= len(levels):
        nothing = np.zeros(0, dtype=np.int64)
        return nothing, nothing, nothing
    run, width = levels[side], 1 << side
    good = (value > 0) & (value <= run)
    good[width - 1:] |= (value[width - 1:] > 0) & (value[width - 1:] <= run[:n - width + 1])
    centre = np.flatnonzero(good)
    own = value[centre]
    left, right = centre.copy(), centre.copy()
    for k in reversed(range(len(levels))):
        at = right + 1
        right += ((at < n) & (levels[k].take(at, mode="clip") >= own)).astype(np.int64) << k
        at = left - (1 << k)
        left -= ((at >= 0) & (levels[k].take(at, mode="clip") > own)).astype(np.int64) << k
    wide = right - left + 1 >= least
    return centre[wide], left[wide], right[wide]


def _contexts(token: np.ndarray, centre: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For the tokens up to, and from, each centre: (which centres have ``_CONTEXT`` of them, their joint hash)."""
    out = []
    for shift in (1 - _CONTEXT, 0):
        has = (centre + shift >= begin) & (centre + shift + _CONTEXT <= end)
        at = centre[has] + shift
        joint = np.zeros(len(at), dtype=np.uint64)
        for q in range(_CONTEXT):
            joint += token[at + q] * _ODD[q]
        out.append((np.flatnonzero(has), joint))
    return out


def _text_windows(raw: np.ndarray, off: np.ndarray, nodes: np.ndarray, hashes: int, least: int) -> tuple[np.ndarray, ...]:
    """(key, node, place) of the windows of some texts; two keys each, for the context on either side."""
    token, first = shingles(raw, off)
    count = np.maximum(np.diff(first) - SHINGLE + 1, 0)
    keys, rows, places = [], [], []
    for j in range(hashes):
        seed = mix64(np.array([j + 1], dtype=np.uint64))
        value = mix64(token ^ seed) | np.uint64(1)
        value[token == 0] = 0
        centre, left, right = compact_windows(value, least)
        row = np.searchsorted(first, centre, side="right") - 1
        begin = first[row]
        place = ((np.int64(j) << 61) | ((centre - begin) << 30) | (np.minimum(centre - left, _REACH) << 15)
                 | np.minimum(right - centre, _REACH))
        for s, (which, joint) in enumerate(_contexts(token, centre, begin, begin + count[row])):
            keys.append(mix64(joint + seed * np.uint64(2 * s + 3)).view(np.int64))
            rows.append(nodes[row[which]])
            places.append(place[which])
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, rows, places))


def _stars(key: np.ndarray, rank: np.ndarray, node: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by key, rank and node, leader of each in that order, whether each is a leader)."""
    order = np.argsort(key)
    sorted_key = key[order]
    lead = np.ones(len(order), dtype=bool)
    lead[1:] = sorted_key[1:] != sorted_key[:-1]
    tied = np.flatnonzero(~(lead & np.append(lead[1:], True)))  # few keys stand more than once
    some = order[tied]
    order[tied] = some[np.lexsort((place[some], node[some], rank[some], key[some]))]
    return order, order[np.maximum.accumulate(np.where(lead, np.arange(len(order)), 0))], lead


_LINK = ("a", "b", "shift", "lo", "hi", "hash", "centre")
_COLUMNS = ("key", "node", "place", "to", "to_place")
_BY_BYTE = ("place", "to_place")  # hashes do not pack


def _blob(x: np.ndarray) -> bytes:
    """Long numbers byte by byte, the first of all, then the next: what is zero or alike in all of them packs well."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes()


def _longs(blobs: list[bytes], by_byte: bool) -> np.ndarray:
    """The numbers of ``_blob``, or of plain bytes, one after another."""
    if not by_byte:
        return np.frombuffer(b"".join(blobs), np.int64)
    parts = [np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view(np.int64).ravel() for x in blobs]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _dealt(key: np.ndarray, columns: list[np.ndarray | None], bits: int) -> Iterator[pa.RecordBatch]:
    """Rows by rising key, those of equal leading ``bits`` as one: what they have in common, and the columns as bytes."""
    bucket = key >> (64 - bits)
    cut = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(key)])).tolist()
    for k in range(0, len(cut) - 1, 1 << 10):
        ends = cut[k:k + (1 << 10) + 1]
        blobs = [pa.nulls(len(ends) - 1, pa.binary()) if x is None else
                 pa.array([_blob(x[i:j]) if c in _BY_BYTE else x[i:j].tobytes() for i, j in zip(ends, ends[1:])], pa.binary())
                 for x, c in zip(columns, _COLUMNS)]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[ends[:-1]]), *blobs], names=["bucket", *_COLUMNS])


def _emit_windows(batches: Iterator[pa.RecordBatch], hashes: int, least: int, bits: int) -> Iterator[pa.RecordBatch]:
    """The first window of each key in a task, and a link from it to each other.

    First is the text of the smallest rank, which is in ``to_place`` of windows.
    A key that is everywhere thus leaves one window a task; links have no key and are
    dealt by hash. Rows hold all windows or links of a bucket.
    """
    seen: dict[int, int] = {}
    parts = []
    for batch in text_slices(batches, "text", 1 << 20):
        texts = batch.column(0)
        raw, off = utf8(texts)
        bounds = off.tolist()
        data = raw.tobytes()
        ids = [xxhash.xxh64_intdigest(data[a:b], 42) for a, b in zip(bounds, bounds[1:])]
        fresh = []
        for i, (x, rank) in enumerate(zip(ids, batch.column(1).to_pylist())):
            if x not in seen:
                fresh.append(i)
            seen[x] = min(rank, seen.get(x, rank))
        if fresh:
            own = texts.take(pa.array(fresh))
            nodes = np.array([ids[i] for i in fresh], dtype=np.uint64).view(np.int64)
            parts.append(_text_windows(*utf8(own), nodes, hashes, least))
    if not parts:
        return
    key, node, place = (np.concatenate([p[i] for p in parts]) for i in range(3))
    del parts
    known = np.fromiter(seen, np.uint64, len(seen)).view(np.int64)
    by_node = np.argsort(known)
    rank = np.fromiter(seen.values(), np.int64, len(seen))[by_node][np.searchsorted(known[by_node], node)]
    order, leader, lead = _stars(key, rank, node, place)
    some = order[lead]
    other, of = order[~lead], leader[~lead]
    apart = node[other] != node[of]
    other, of = other[apart], of[apart]
    if len(some):
        yield from _dealt(key[some], [key[some], node[some], place[some], None, rank[some]], bits)
    if len(other):
        spread = mix64(node[other].view(np.uint64) ^ place[other].view(np.uint64)).view(np.int64)
        by_spread = np.argsort(spread)
        other, of = other[by_spread], of[by_spread]
        yield from _dealt(spread[by_spread], [None, node[of], place[of], node[other], place[other]], bits)


def _link_rows(a: np.ndarray, pa_: np.ndarray, b: np.ndarray, pb: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Node pairs with the offset between their windows, the shared range and its centre, counted in the first node."""
    swap = a > b
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    pa_, pb = np.where(swap, pb, pa_), np.where(swap, pa_, pb)
    mask = (1 << 31) - 1
    ca, cb = pa_ >> 30 & mask, pb >> 30 & mask
    back = np.minimum(pa_ >> 15 & _REACH, pb >> 15 & _REACH)
    ahead = np.minimum(pa_ & _REACH, pb & _REACH)
    for i in range(0, len(a), 1 << 16):
        s = slice(i, i + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(x[s]) for x in (a, b, cb - ca, ca - back, ca + ahead, pa_ >> 61, ca)],
                                         names=list(_LINK))


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("key", "node", "place", "to_place")
    windows: list[list[bytes]] = [[] for _ in names]
    for batch in batches:
        linked = batch.filter(batch["to"].is_valid())
        yield from _link_rows(*(_longs(linked[c].to_pylist(), c in _BY_BYTE) for c in _COLUMNS[1:]))
        batch = batch.filter(batch["to"].is_null())
        for held, c in zip(windows, names):
            held += batch[c].to_pylist()
    if not windows[0]:
        return
    key, node, place, rank = (_longs(x, c in _BY_BYTE) for x, c in zip(windows, names))
    order, leader, lead = _stars(key, rank, node, place)
    other, of = order[~lead], leader[~lead]
    apart = node[other] != node[of]
    other, of = other[apart], of[apart]
    yield from _link_rows(node[of], place[of], node[other], place[other])


def matching_ranges(same: np.ndarray, share: float, least: int) -> list[tuple[int, int]]:
    """Disjoint ranges of ``least`` or more of which ``share`` or more are true: the longest, then those beside it."""
    out, todo = [], [(0, len(same))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < least:
            continue
        sums = np.concatenate(([0.0], np.cumsum(same[lo:hi] - share)))
        best = np.maximum.accumulate(sums[::-1])  # of the ends from the right, rising
        end = len(sums) - 1 - np.searchsorted(best, sums - 1e-9, side="left")
        span = end - np.arange(len(sums))
        i = int(span.argmax())
        if span[i] < least:
            continue
        a, b = lo + i, lo + int(end[i])
        out.append((a, b))
        todo += [(lo, a), (b, hi)]
    return sorted(out)


def shared_runs(a: np.ndarray, b: np.ndarray, lo: int, hi: int, shift: int) -> list[tuple[int, int, int]]:
    """(start, end, shift) of the runs of ``a[lo:hi]`` that equal ``b`` at the offset, counted in ``a``."""
    lo, hi = max(lo, -shift, 0), min(hi, len(a), len(b) - shift)
    if lo >= hi:
        return []
    same = np.zeros(hi - lo + 2, dtype=bool)
    same[1:-1] = (a[lo:hi] == b[lo + shift:hi + shift]) & (a[lo:hi] != 0)
    edge = (np.flatnonzero(same[1:] != same[:-1]) + lo).tolist()
    return [(i, j, shift) for i, j in zip(edge[::2], edge[1::2])]


def runs_of_spans(a: np.ndarray, b: np.ndarray, lo: np.ndarray, hi: np.ndarray, shift: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """``shared_runs`` of many ranges at once."""
    lo = np.maximum(np.maximum(lo, -shift), 0)
    size = np.maximum(np.minimum(np.minimum(hi, len(a)), len(b) - shift) - lo, 0)
    begin = np.cumsum(size + 1) - size  # a place before each that is not equal
    at = ragged(lo, size)
    same = np.zeros(int(size.sum()) + len(size) + 1, dtype=bool)
    own = a[at]
    same[ragged(begin, size)] = (own == b[at + np.repeat(shift, size)]) & (own != 0)
    edge = (same[1:] != same[:-1]).nonzero()[0] + 1
    of = np.searchsorted(begin, edge[::2], side="right") - 1
    start = edge[::2] - begin[of] + lo[of]
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(size))]
    for k, x, y, turn in zip(of.tolist(), start.tolist(), (start + edge[1::2] - edge[::2]).tolist(), shift[of].tolist()):
        out[k].append((x, y, turn))
    return out


def drifted_runs(a: np.ndarray, b: np.ndarray, lo: int, hi: int, shift: int, seen: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs as of ``shared_runs`` at other offsets near ``shift``, as words put in or left out bring about.

    The offsets are those of ``_LEAST_RUN`` or more tokens that stand once in
    that part of ``b``; up to a quarter of the range is looked at on either side.
    ``seen`` has two rows with a place for every token of the texts, -1 at first.
    """
    drift = max(16, (hi - lo) // 4)
    lo, hi, begin, end = max(lo - drift, 0), min(hi + drift, len(a)), max(lo + shift - drift, 0), min(hi + shift + drift, len(b))
    if lo >= hi or begin >= end:
        return []
    low, high = seen  # first and last place in that part of b; what a call before left there is no place in it
    part, at = b[begin:end], np.arange(begin, end)
    high[part] = at
    low[part[::-1]] = at[::-1]
    low[0] = -1  # ends of texts are no tokens
    place = low[a[lo:hi]]
    once = (((place - begin).view(np.uint64) < end - begin) & (place == high[a[lo:hi]])).nonzero()[0]
    if len(once) < _LEAST_RUN:
        return []
    turn = place[once] - once - lo
    turn = turn[turn != shift]
    if len(turn) < _LEAST_RUN:
        return []
    shifts, times = np.unique(turn, return_counts=True)
    return [x for s in shifts[times >= _LEAST_RUN].tolist()
            for x in shared_runs(a, b, lo, hi, s) if x[1] - x[0] >= _LEAST_RUN]


def chains(linked: list[tuple[int, int, int]], drifted: list[tuple[int, int, int]], similarity: float,
           enough: float) -> list[np.ndarray]:
    """Runs (start, end, shift) that rise in both texts, the chains of most tokens first; a run is in one at most.

    Runs follow each other, whatever their offsets, where the words between them
    are few enough for the similarity to hold with all runs of the pair. A run
    that reaches back over the one before it is cut to begin at its end. Chains
    without a linked run or with fewer than ``enough`` tokens are left out.
    """
    joined: list[list[int]] = []
    for shift, lo, hi, own in sorted([(s, i, j, 1) for i, j, s in set(linked)] + [(s, i, j, 0) for i, j, s in set(drifted)]):
        if joined and joined[-1][2] == shift and lo <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], hi)
            joined[-1][3] |= own
        else:
            joined.append([lo, hi, shift, own])
    left = np.array(sorted(joined), dtype=np.int64).reshape(-1, 4)
    out = []
    while left[:, 3].any():
        lo, hi, shift, _ = left.T
        size = hi - lo
        if size.sum() < enough:
            break
        if (shift == shift[0]).all():
            out.append(left[:, :3])
            break
        room = size.sum() * (1 - similarity) / similarity
        score, cut, back = size.astype(np.float64), np.zeros_like(lo), np.full(len(lo), -1)
        for first in range(1, len(lo), 1 << 10):  # all runs with those before them, then the scores one by one
            k = np.arange(first, min(first + (1 << 10), len(lo)))
            p = np.maximum(k[:, None] - np.arange(min(_LOOK_BACK, int(k[-1])), 0, -1), 0)
            turn = shift[k, None] - shift[p]
            over = np.maximum(0, np.maximum(hi[p] - lo[k, None], hi[p] - lo[k, None] - turn))
            gap = 2 * (lo[k, None] + over - hi[p]) + turn
            unfit = (over >= size[k, None]) | (gap > room) | (lo[p] > lo[k, None] + turn)
            gap = 1e-6 * gap
            for own, fit, turns, gaps, not_fit in zip(k.tolist(), (~unfit).any(1).tolist(), over, gap, unfit):
                if not fit:
                    continue
                n = min(own, len(turns))
                total = score[own - n:own] + size[own] - turns[-n:] - gaps[-n:]
                total[not_fit[-n:]] = -1
                best = int(total.argmax())
                if total[best] > score[own]:
                    score[own], back[own], cut[own] = total[best], own - n + best, turns[-n:][best]
        k = int(score.argmax())
        if score[k] < enough - 1:
            break
        path = []
        while k >= 0:
            path.append(k)
            k = int(back[k])
        path.reverse()
        if left[path, 3].any():
            chain = left[path, :3]
            chain[1:, 0] += cut[path[1:]]
            out.append(chain)
        left = np.delete(left, path, axis=0)
    return out


def similarities(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of the sets of small numbers ``a[:ends_a[k]]`` and ``b[:ends_b[k]]``; the ends rise."""
    a, b = a[:ends_a[-1]], b[:ends_b[-1]]
    first = np.full((2, int(max(a.max(), b.max())) + 1), len(ends_a))
    for side, part, ends in ((0, a, ends_a), (1, b, ends_b)):
        first[side, part[::-1]] = np.searchsorted(ends, np.arange(len(part)), side="right")[::-1]
    both, either = (np.cumsum(np.bincount(x, minlength=len(ends_a) + 1)[:len(ends_a)]) for x in (first.max(0), first.min(0)))
    return both / either


def _similarity(a: np.ndarray, b: np.ndarray) -> float:
    x, y = set(a.tolist()), set(b.tolist())
    both = len(x & y)
    return both / (len(x) + len(y) - both)


def _grown(sa: np.ndarray, sb: np.ndarray, runs: np.ndarray, core: int, lo: int, hi: int, similarity: float) -> tuple[int, int]:
    """Range of ``runs[lo:hi]`` about ``core``: the farthest run either side that keeps the similarity, until none is added."""
    i, j = core, core + 1
    begin_a, end_a, shift = runs.T
    begin_b, end_b = begin_a + shift, end_a + shift
    while True:
        at_a, at_b = begin_a[i], begin_b[i]
        ok = similarities(sa[at_a:], sb[at_b:], end_a[j - 1:hi] - at_a, end_b[j - 1:hi] - at_b) >= similarity
        further = j + int(np.flatnonzero(ok).max(initial=0))
        at_a, at_b = end_a[further - 1], end_b[further - 1]
        ok = similarities(sa[:at_a][::-1], sb[:at_b][::-1], at_a - begin_a[lo:i + 1][::-1], at_b - begin_b[lo:i + 1][::-1]) >= similarity
        before = i - int(np.flatnonzero(ok).max(initial=0))
        if (before, further) == (i, j):
            return i, j
        i, j = before, further


def _stretched(sa: np.ndarray, sb: np.ndarray, at: tuple[int, int, int, int], similarity: float, least: int):
    """(start, end in a, start, end in b, similarity) with the tokens beside it that make it long enough; None if unlike."""
    a, a_end, b, b_end = at
    need = max(0, least - (a_end - a), least - (b_end - b))
    tail_a, tail_b = len(sa) - SHINGLE + 1, len(sb) - SHINGLE + 1
    for left in range(need + 1):
        right = need - left
        if left > min(a, b) or a_end + right > tail_a or b_end + right > tail_b:
            continue
        alike = _similarity(sa[a - left:a_end + right], sb[b - left:b_end + right])
        if alike >= similarity:
            return a - left, a_end + right, b - left, b_end + right, alike
    return None


def passages_of(sa: np.ndarray, sb: np.ndarray, runs: np.ndarray, similarity: float, least: int) -> list[tuple]:
    """(start, end in a, start, end in b, similarity) in tokens of the passages along rising runs (start, end, shift).

    The longest range of runs whose lengths promise the similarity is tested on
    its token sets. Where that fails, as repeated tokens count once in a set, it
    gives way to what grows from single runs, which are alike, the longest first.
    The search goes on beside each passage. Passages begin and end with a run,
    but for short ones, which take the tokens beside them.
    """
    if len(runs) == 1:
        a, a_end, turn = runs[0].tolist()
        if a_end - a >= least:
            return [(a, a_end, a + turn, a_end + turn, 1.0)]
        alone = a_end - a >= 2 * similarity / (1 + similarity) * least - 1e-9 and _stretched(sa, sb, (a, a_end, a + turn, a_end + turn), similarity, least)
        return [alone] if alone else []
    begin_a, end_a, shift = runs.T
    begin_b, end_b = begin_a + shift, end_a + shift
    size = end_a - begin_a
    apart = np.concatenate(([0], begin_a[1:] - end_a[:-1] + begin_b[1:] - end_b[:-1]))
    after = np.cumsum((1 - similarity) * size - similarity * apart)  # what matches, less what must, up to the end of a run
    before = after - (1 - similarity) * size
    enough = 2 * similarity / (1 + similarity) * least - 1e-9
    total = np.concatenate(([0], np.cumsum(size)))
    out, todo = [], [(0, len(runs))]

    def take(i: int, j: int) -> bool:
        found = _stretched(sa, sb, (begin_a[i], end_a[j - 1], begin_b[i], end_b[j - 1]), similarity, least)
        if found:
            out.append(tuple(int(x) for x in found[:4]) + (found[4],))
            todo.extend(((lo, i), (j, hi)))
        return found is not None

    while todo:
        lo, hi = todo.pop()
        if total[hi] - total[lo] < enough:
            continue
        best = np.maximum.accumulate(after[lo:hi][::-1])  # of the ends from the right, rising
        lowest = np.minimum.accumulate(before[lo:hi])
        widest = hi - np.searchsorted(best, lowest - 1e-9, side="left")  # end of what a run can be in, and its begin
        begin = lo + np.searchsorted(-lowest, -best[::-1] - 1e-9, side="left")
        cores = lo + np.flatnonzero(total[widest] - total[np.minimum(begin, widest)] >= enough)
        if not len(cores):
            continue
        last = hi - 1 - np.searchsorted(best, before[lo:hi] - 1e-9, side="left")
        i = lo + int((end_a[last] - begin_a[lo:hi]).argmax())
        if take(i, int(last[i - lo]) + 1):
            continue
        tried = set()
        for core in cores[np.argsort(-size[cores], kind="stable")]:
            i, j = _grown(sa, sb, runs, int(core), lo, hi, similarity)
            if (i, j) not in tried and total[j] - total[i] >= enough and take(i, j):
                break
            tried.add((i, j))
    return out


def _run_length(a: np.ndarray, b: np.ndarray) -> int:
    """How many tokens two texts have in common at their beginnings; read in growing steps."""
    begin, step = 0, 64
    while True:
        x, y = a[begin:begin + step], b[begin:begin + step]
        n = min(len(x), len(y))
        differ = (x[:n] != y[:n]) | (x[:n] == 0)
        if differ.any():
            return begin + int(differ.argmax())
        begin += n
        if n < step:
            return begin
        step *= 2


_STEP = 32


def _begun_runs(a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, turn: int) -> np.ndarray:
    """How many tokens, ``_STEP`` at most, two texts have in common from each place on, or back from it (``turn`` -1)."""
    out = np.zeros(len(at_a), dtype=np.int64)
    for i in range(0, len(at_a), 1 << 11):
        k = slice(i, i + (1 << 11))
        x, y = (at[k, None] + turn * np.arange(_STEP) for at in (at_a, at_b))
        inside = (x >= 0) & (y >= 0) & (x < len(a)) & (y < len(b))
        own = a[np.where(inside, x, 0)]
        same = inside & (own == b[np.where(inside, y, 0)]) & (own != 0)
        out[k] = np.where(same.all(1), _STEP, same.argmin(1))
    return out


def _around(sa: np.ndarray, sb: np.ndarray, links: np.ndarray, least: int) -> np.ndarray:
    """Links of equal ranges, each with what may lie about its whole run of equal tokens."""
    turn, at = links[np.lexsort((links[:, 1], links[:, 0])), :2].T
    kept, ends = [], []
    before, j = None, 0
    for k, (shift, start, n) in enumerate(zip(turn.tolist(), at.tolist(), _begun_runs(sa, sb, at, at + turn, 1).tolist())):
        if shift == before and start < j:
            continue
        before, j = shift, start + n
        if n == _STEP:
            j += _run_length(sa[j:], sb[j + shift:])
        if n:
            kept.append(k)
            ends.append(j)
    turn, at, after = turn[kept], at[kept], np.array(ends, dtype=np.int64)
    back = _begun_runs(sa, sb, at - 1, at - 1 + turn, -1)
    for k in np.flatnonzero(back == _STEP).tolist():
        start = int(at[k]) - _STEP
        back[k] += _run_length(sa[:start][::-1], sb[:start + int(turn[k])][::-1])
    first = at - back
    beside = after - first + least
    lo = np.maximum(np.maximum(first - beside, -turn), 0)
    hi = np.minimum(np.minimum(len(sa), after + beside), len(sb) - turn) - 1
    none = np.zeros(len(kept), dtype=np.int64)
    return np.column_stack((turn, lo, hi, none, none))


def near_windows(sa: np.ndarray, sb: np.ndarray, links: np.ndarray, least: int) -> list[np.ndarray]:
    """For either text of a pair, whether a range of ``least`` tokens about a linked centre starts at a place."""
    out = []
    for s, side in ((sa, 0), (sb, 1)):
        centre = links[:, 4] + side * links[:, 0]
        near = np.cumsum(np.bincount(np.maximum(centre - least + 1, 0), minlength=len(s) + 1) - np.bincount(centre + 1, minlength=len(s) + 1)) > 0
        near[max(0, len(s) - least - SHINGLE + 2):] = False
        out.append(near)
    return out


def not_held(near: list[np.ndarray], found: list[tuple], least: int) -> list[np.ndarray]:
    """Those of ``near_windows`` that no passage of the pair holds."""
    out = [x.copy() for x in near]
    for side, begin, end in zip(out, (0, 2), (1, 3)):
        for x in found:
            side[x[begin]:max(x[begin], x[end] - least - SHINGLE + 2)] = False
    return out


def open_windows(sa: np.ndarray, sb: np.ndarray, links: np.ndarray, found: list[tuple], least: int) -> list[np.ndarray]:
    """For either text of a pair, where the ranges of ``least`` tokens about the linked centres start that no passage holds."""
    return [np.flatnonzero(x) for x in not_held(near_windows(sa, sb, links, least), found, least)]


class Tokens(NamedTuple):
    """Tokens of a text, the distinct ones in order (0 among them) and the place of each in these."""

    own: np.ndarray
    distinct: np.ndarray
    place: np.ndarray

    @staticmethod
    def of(own: np.ndarray) -> Tokens:
        distinct, place = np.unique(np.concatenate((own, [np.uint64(0)])), return_inverse=True)
        return Tokens(own, distinct, place[:-1])


def in_common(a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Small numbers for the tokens of two texts, equal for equal tokens; 0 stays 0. Sorts nothing, as both are sorted already."""
    at = np.minimum(np.searchsorted(a.distinct, b.distinct), len(a.distinct) - 1)
    number = np.where(a.distinct[at] == b.distinct, at, len(a.distinct) + np.arange(len(b.distinct)))
    return a.place, number[b.place]


def linked_spans(links: np.ndarray, least_hashes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, shift) of the ranges of one offset that the links of a pair join up to, with ``least_hashes`` functions or more."""
    shift, lo, hi, hashed = links[np.lexsort((links[:, 1], links[:, 0])), :4].T
    turns = np.concatenate(([True], shift[1:] != shift[:-1]))
    far = np.int64(1) << 40  # beyond any place, so that ends of one offset do not reach into the next
    group = np.cumsum(turns) * far
    new = np.concatenate(([True], (lo + group)[1:] > np.maximum.accumulate(hi + group)[:-1] + 1))
    at = np.flatnonzero(new)
    lo, hi, shift = lo[at], np.maximum.reduceat(hi, at) + 1, shift[at]
    enough = np.bitwise_count(np.bitwise_or.reduceat(np.int64(1) << hashed, at)) >= least_hashes
    return lo[enough], hi[enough], shift[enough]


_SPANS = 1 << 15  # tokens of ranges that are looked at together


def verified(sa: np.ndarray, sb: np.ndarray, links: np.ndarray, similarity: float, least: int, least_hashes: int,
             spans: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> list[tuple[int, int, int, int, float]]:
    """(start, end in a, start, end in b, similarity) in words of the passages that the links of a pair bear out.

    The longest ranges go first; those whose words are all in passages of the
    pair, at whatever offsets, as in texts of one repeated line, are left out.
    Tokens are numbers that the texts have in common (:func:`in_common`).
    """
    if not len(links):
        return []
    lo, hi, shift = linked_spans(links, least_hashes) if spans is None else spans
    order = np.lexsort((shift, hi, lo, lo - hi))
    lo, hi, shift = lo[order], hi[order], shift[order]
    size = int(max(sa.max(initial=0), sb.max(initial=0))) + 1
    seen = np.full((2, size), -1)
    shared = np.zeros(size, dtype=bool)
    shared[sb] = True
    shared[0] = False
    in_b = np.concatenate(([0], np.cumsum(shared[sa]))).tolist()  # tokens of a up to each place that b has
    enough = 2 * similarity / (1 + similarity) * least
    out = []
    open_a, open_b = bytearray(b"\1") * len(sa), bytearray(b"\1") * len(sb)

    def opened(a: int, a_end: int, b: int, b_end: int) -> bool:
        return open_a.find(1, a, a_end) >= 0 or open_b.find(1, b, b_end) >= 0

    def drift(runs: list[tuple[int, int, int]], lo: int, hi: int, shift: int) -> list[tuple[int, int, int]]:
        beside = max(16, (hi - lo) // 4)  # tokens that are equal at the offset stand once at no other
        if in_b[min(hi + beside, len(sa))] - in_b[max(lo - beside, 0)] - sum(j - i for i, j, _ in runs) < _LEAST_RUN:
            return []
        return drifted_runs(sa, sb, lo, hi, shift, seen)

    first, ends = 0, np.cumsum(hi - lo)
    while first < len(lo):  # some at a time: what a passage holds by then is left out
        k = slice(first, max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + _SPANS, side="right"))))
        first = k.stop
        spans = [x for x in zip(lo[k].tolist(), hi[k].tolist(), shift[k].tolist())
                 if opened(max(x[0], -x[2], 0), x[1], max(x[0] + x[2], x[2], 0), max(x[1] + x[2], 0))]
        if not spans:
            continue
        for (begin, end, turn), runs in zip(spans, runs_of_spans(sa, sb, *np.array(spans).T)):
            if not any(opened(i, j, i + turn, j + turn) for i, j, _ in runs):
                continue
            drifted = drift(runs, begin, end, turn)
            if sum(j - i for i, j, _ in runs + drifted) < enough:
                continue
            for chain in chains(runs, drifted, similarity, enough) if drifted else [np.array(runs)]:
                for x in passages_of(sa, sb, chain, similarity, least):
                    if opened(*x[:4]):
                        out.append(x)
                        open_a[x[0]:x[1]], open_b[x[2]:x[3]] = bytes(x[1] - x[0]), bytes(x[3] - x[2])
    return [(a, a_end + SHINGLE - 1, b, b_end + SHINGLE - 1, alike) for a, a_end, b, b_end, alike in out]


def _packed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node's text once a task, compressed for the shuffles."""
    seen: set[int] = set()
    deflate = zstandard.ZstdCompressor(level=3).compress
    for batch in text_slices(batches, "text", 4 << 20):
        nodes, blobs = [], []
        for node, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            if node not in seen:
                seen.add(node)
                nodes.append(node)
                blobs.append(deflate(text.as_buffer()))
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(blobs, pa.binary())], names=["node", "packed"])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each node's text."""
    for batch in text_slices(batches, "text", 4 << 20):
        raw, off = utf8(batch.column(1))
        _, _, first = word_bounds(lower_ascii(raw), off, WORD)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(first))], names=["node", "n_words"])


_PASSAGE = ("a", "b", "a_start", "a_end", "b_start", "b_end", "similarity")


def _unsure(a: list, b: list, a_start: list, a_end: list, b_start: list, kind: int) -> pa.RecordBatch:
    """Rows of ``_PASSAGE`` that are no passages: ``kind`` is in ``b_end``."""
    columns = [pa.array(np.asarray(x, dtype=np.int64)) for x in (a, b, a_start, a_end, b_start, np.full(len(a), kind))]
    return pa.RecordBatch.from_arrays([*columns, pa.nulls(len(a), pa.float64())], names=list(_PASSAGE))


def _verify(batches: Iterator[pa.RecordBatch], similarity: float, least: int, least_hashes: int, again: bool) -> Iterator[pa.RecordBatch]:
    """Passages of text pairs; for links by centres also rows without similarity: what was compared, and the windows of each text.

    Kind 2 are the compared ranges (texts, start, end, shift); kinds 0 and 1 are
    a text with the first and last start of its windows about linked centres, all
    and those that no passage of a pair holds.
    """
    inflate = zstandard.ZstdDecompressor().decompress

    def tokens(node: pa.Array, column: pa.Array) -> list[Tokens]:
        """Tokens of each row's text; a text that stands in several rows is read once."""
        _, at, back = np.unique(node.to_numpy(), return_index=True, return_inverse=True)
        texts = [inflate(x.as_buffer()) for x in column.take(pa.array(at))]
        s, first = shingles(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
        own = [Tokens.of(s[i:j]) for i, j in zip(first, first[1:], strict=False)]
        return [own[k] for k in back.tolist()]

    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            of_a, of_b = tokens(part.column(0), part.column(2)), tokens(part.column(1), part.column(3))
            rows = []
            spans: list[tuple] = []
            starts: dict[tuple[int, int], np.ndarray] = {}  # by text and kind
            listed = part.column(4)
            ends = np.cumsum(listed.value_lengths().to_numpy()).tolist()
            fields = np.column_stack([f.to_numpy() for f in listed.flatten().flatten()])  # shift, lo, hi, hash, centre
            for k, (a, b) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)):
                links = fields[ends[k - 1] if k else 0:ends[k]]
                own, other = of_a[k].own, of_b[k].own
                if again:
                    links = _around(own, other, links, least)
                of_links = linked_spans(links, least_hashes) if len(links) else None
                found = verified(*in_common(of_a[k], of_b[k]), links, similarity, least, least_hashes, of_links)
                rows += [(a, b, *x) for x in found]
                if not again:
                    spans += [(a, b, lo, hi, shift) for lo, hi, shift in zip(*(x.tolist() for x in of_links))]
                    near = near_windows(own, other, links, least)
                    for kind, both in enumerate((near, not_held(near, found, least))):
                        for node, at in zip((a, b), both):
                            if (node, kind) in starts:
                                starts[node, kind] |= at
                            else:
                                starts[node, kind] = at
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=list(_PASSAGE))
            if spans:
                yield _unsure(*zip(*spans), 2)
            for kind in (0, 1):  # as ranges: their tokens are read later, once a text
                own = [(node, at) for (node, k), at in starts.items() if k == kind]
                if own:
                    begin = np.cumsum([0, *(len(at) + 1 for _, at in own)])  # a place between texts, so that no range joins two
                    line = np.zeros(int(begin[-1]) + 1, dtype=bool)
                    for x, (_, at) in zip(begin.tolist(), own):
                        line[x + 1:x + 1 + len(at)] = at
                    edge = np.flatnonzero(line[1:] != line[:-1])
                    first, last = edge[::2], edge[1::2] - 1
                    of = np.searchsorted(begin, first, side="right") - 1
                    zero = np.zeros(len(first))
                    yield _unsure(np.array([node for node, _ in own])[of], first - begin[of], last - begin[of], zero, zero, kind)


_COVERED, _NEAR, _OPEN = 1, 2, 4  # a token is in an open window; a window, an open window starts at it
_FLAGS, _DISTINCT = 3, 16  # bits for these, and for the distinct tokens of the window
_BUCKETS = 1 << 12


def distinct_tokens(s: np.ndarray, at: np.ndarray, least: int) -> np.ndarray:
    """How many distinct tokens the ``least`` from each place on have."""
    order = np.argsort(s, kind="stable")
    again = np.flatnonzero(s[order][1:] == s[order][:-1])
    before, place = order[again], order[again + 1]
    near = place - before < least  # such a token counts once in each window that has both
    line = np.zeros(len(s) + 1, dtype=np.int64)
    np.add.at(line, np.maximum(place[near] - least + 1, 0), 1)
    np.add.at(line, before[near] + 1, -1)
    return np.minimum(len(s) - at, least) - np.cumsum(line)[at]


def _near_tokens(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Tokens of the windows of each text, by bucket of the token: columns of (token, node, place, distinct tokens of the window and flags) as bytes."""
    inflate = zstandard.ZstdDecompressor().decompress
    held: list[tuple[np.ndarray, ...]] = []

    def dealt() -> Iterator[pa.RecordBatch]:
        token, node, at = (np.concatenate(x) for x in zip(*held))
        held.clear()
        bucket = (token % np.uint64(_BUCKETS)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cut = np.concatenate(([0], np.flatnonzero(np.diff(bucket[order])) + 1, [len(order)]))
        columns = [pa.array([x[order[i:j]].tobytes() for i, j in zip(cut, cut[1:])], pa.binary()) for x in (token, node, at)]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[order[cut[:-1]]]), *columns], names=["bucket", "token", "node", "at"])

    waiting = 0
    for batch in batches:
        for node, packed, ranges in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            text = inflate(packed.as_buffer())
            s, _ = shingles(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
            edges = np.zeros((4, len(s) + least + 1), dtype=np.int64)  # starts, then tokens, of all and of open windows
            for r in ranges:
                for row, end in ((r["kind"], r["last"] + 1), (2 + r["kind"], r["last"] + least)):
                    edges[row, r["first"]] += 1
                    edges[row, end] -= 1
            near, open_, token, covered = np.cumsum(edges, axis=1) > 0
            at = np.flatnonzero(token[:len(s)] & (s > 0))
            flags = covered[at] * _COVERED + near[at] * _NEAR + open_[at] * _OPEN
            held.append((s[at], np.full(len(at), node), at << _FLAGS + _DISTINCT | distinct_tokens(s, at, least) << _FLAGS | flags))
            waiting += len(at)
            if waiting >= 4 << 20:
                waiting = 0
                yield from dealt()
    if held:
        yield from dealt()


def _shared_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, at, token, texts) of the tokens that two texts or more have, an open window of one among them."""
    parts = [[np.frombuffer(b"".join(x.as_py() for x in batch.column(c)), dtype) for c, dtype in ((1, np.uint64), (2, np.int64), (3, np.int64))]
             for batch in batches]
    if not parts:
        return
    token, node, at = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((node, token))
    token, node, at = token[order], node[order], at[order]
    new = np.concatenate(([True], token[1:] != token[:-1]))
    text = new | np.concatenate(([True], node[1:] != node[:-1]))
    first = np.flatnonzero(new)
    texts = np.add.reduceat(text.astype(np.int64), first)
    open_ = np.bitwise_or.reduceat(at & _COVERED, first) > 0
    size = np.diff(np.append(first, len(token)))
    kept = np.flatnonzero(np.repeat((texts > 1) & open_, size))
    texts = np.repeat(texts, size)
    for i in range(0, len(kept), 1 << 16):
        k = kept[i:i + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node[k], at[k], token[k].view(np.int64), texts[k])],
                                         names=["node", "at", "token", "texts"])


def rare_tokens(at: np.ndarray, weight: np.ndarray, distinct: np.ndarray, flags: np.ndarray, least: int,
                share: float) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens of a text are among the rarest of a window, and of an open one.

    ``at`` are the rising places of the tokens that other texts have, rarest by
    ``weight``. Of two windows that have ``share`` of their ``distinct`` tokens in
    common, each has one of these among its rarest: one more than may differ, where
    tokens that no other text has come first. Windows with too many of those meet nothing.
    """
    begin = np.flatnonzero(flags & _NEAR)
    size = np.searchsorted(at, at[begin] + least) - begin
    some, open_ = np.zeros(len(at), dtype=bool), np.zeros(len(at), dtype=bool)
    for i in range(0, len(begin), 1 << 14):
        b, n = begin[i:i + (1 << 14)], size[i:i + (1 << 14)]
        place = b[:, None] + np.arange(least)
        inside = np.arange(least) < n[:, None]
        own = np.where(inside, weight.take(place, mode="clip"), np.uint64((1 << 64) - 1))
        low = np.sort(own, axis=1)
        new = (low[:, 1:] != low[:, :-1]) & inside[:, 1:]  # a token that stands twice counts once
        nth = np.cumsum(new, axis=1, dtype=np.int16 if least < 1 << 15 else np.int64)
        may_differ = np.floor(distinct[b] * (1 - share) + 1e-9).astype(np.int64)
        left = may_differ - (distinct[b] - 1 - nth[:, -1])
        ok = left >= 0
        last = np.count_nonzero(nth[ok] <= left[ok, None], axis=1)  # they rise
        last = np.minimum(last, n[ok] - 1)
        place = place[ok]
        taken = inside[ok] & (own[ok] <= low[ok, last][:, None])
        some[place[taken]] = True
        open_[place[taken & (flags[b[ok]] & _OPEN > 0)[:, None]]] = True
    return some, open_


def _rare(batches: Iterator[pa.RecordBatch], least: int, share: float) -> Iterator[pa.RecordBatch]:
    """(key, node, at, open, width) of the rarest tokens of each window of the texts, and of whole open windows.

    Whole windows of which every token stands in other texts count as tokens of ``least`` words and four.
    """
    held = list(batches)
    if not held:
        return
    table = pa.Table.from_batches(held)
    node, at, token, texts = (table[c].to_numpy() for c in ("node", "at", "token", "texts"))
    order = np.lexsort((at, node))
    node, at, token, texts = node[order], at[order], token[order], texts[order]
    weight = np.minimum(texts, (1 << 20) - 1).astype(np.uint64) << np.uint64(44) | mix64(token.view(np.uint64)) >> np.uint64(20)
    cut = np.concatenate(([0], np.flatnonzero(np.diff(node)) + 1, [len(node)])).tolist()
    factor = np.cumprod(np.full(least, _ODD[0]))
    names = ["token", "node", "at", "open", "width"]
    for i, j in zip(cut, cut[1:]):
        place = at[i:j] >> _FLAGS + _DISTINCT
        whole = np.flatnonzero(at[i:j] & _OPEN)
        whole = whole[np.searchsorted(place, place[whole] + least) - whole == least]
        for w in range(0, len(whole), 1 << 16):
            here = i + whole[w:w + (1 << 16)]
            key = np.zeros(len(here), dtype=np.uint64)
            for q in range(least):
                key += token[here + q].view(np.uint64) * factor[q]
            yield pa.RecordBatch.from_arrays([pa.array(mix64(key).view(np.int64)), pa.array(node[here]), pa.array(place[here - i]),
                                              pa.array(np.ones(len(here), np.int64)), pa.array(np.full(len(here), least + SHINGLE - 1))], names=names)
        distinct = at[i:j] >> _FLAGS & (1 << _DISTINCT) - 1
        some, open_ = rare_tokens(place, weight[i:j], distinct, at[i:j] & (1 << _FLAGS) - 1, least, share)
        k = i + np.flatnonzero(some)
        if len(k):
            yield pa.RecordBatch.from_arrays([pa.array(token[k]), pa.array(node[k]), pa.array(place[some]), pa.array(open_[some].astype(np.int64)),
                                              pa.array(np.ones(len(k), np.int64))], names=names)


_STATE = ("token", "node", "at", "open", "width", "rank")
_MET = ("token", "to", "to_at", "other", "other_at", "width")
_SETTLED = 2  # in ``open`` of rows that tell that a passage with a leader holds a text's place


class _Leading(NamedTuple):
    """Of rows by rising token, rank and node: the token's and the text's number of each, the number of a leader in its token or 0, what leads."""

    token: np.ndarray
    text: np.ndarray
    nth: np.ndarray
    first: np.ndarray  # row of the first open place of each leader, by token
    count: np.ndarray  # leaders of each token

    @staticmethod
    def of(token: np.ndarray, node: np.ndarray, is_open: np.ndarray, leaders: int) -> _Leading:
        new = np.concatenate(([True], token[1:] != token[:-1]))
        new_text = new | np.concatenate(([True], node[1:] != node[:-1]))
        of_token, of_text = np.cumsum(new) - 1, np.cumsum(new_text) - 1
        begin = np.flatnonzero(new_text)
        open_text = np.logical_or.reduceat(is_open, begin)
        nth = np.cumsum(open_text)
        own = of_token[begin]
        before = (nth - open_text)[of_text[np.flatnonzero(new)]]
        nth = np.where(open_text, nth - before[own], 0)
        nth[nth > leaders] = 0
        row = np.flatnonzero(is_open)
        row = row[np.concatenate(([True], of_text[row][1:] != of_text[row][:-1]))] if len(row) else row
        return _Leading(of_token, of_text, nth[of_text], row[nth[of_text[row]] > 0], np.bincount(own[nth > 0], minlength=int(of_token[-1]) + 1))


def _round(batches: Iterator[pa.RecordBatch], done: int, leaders: int) -> Iterator[pa.RecordBatch]:
    """What is left to meet, and links from the first texts that are open at a token to all others that have it.

    The ``done`` leaders of the round before go; where a passage with one of them
    holds a text's place, it is open no more. Left are the tokens that two texts or
    more have, one of them open; texts lead by rank. Of a leader counts the first open
    place of the token, of the others each; ``other`` is no leader, or a later one.
    Rows are of ``_STATE``, and links of ``_MET`` with ``links`` set.
    """
    held = list(batches)
    if not held:
        return
    table = pa.Table.from_batches(held)
    token, node, at, open_, width, rank = (table[c].to_numpy() for c in _STATE)
    settled = np.zeros(len(token), dtype=bool)
    if done:
        order = np.lexsort((at, node, token))
        place = np.stack((token, node, at))[:, order]
        new = np.flatnonzero(np.concatenate(([True], (place[:, 1:] != place[:, :-1]).any(0))))
        settled[order] = np.repeat(np.logical_or.reduceat(open_[order] == _SETTLED, new), np.diff(np.append(new, len(order))))
    order = np.lexsort((at, node, rank, token))
    order = order[open_[order] != _SETTLED]
    if not len(order):
        return
    token, node, at, open_, width, rank, settled = (x[order] for x in (token, node, at, open_, width, rank, settled))
    if done:
        kept = _Leading.of(token, node, open_ > 0, done).nth == 0
        open_ = open_ * ~settled
        token, node, at, open_, width, rank = (x[kept] for x in (token, node, at, open_, width, rank))
        if not len(token):
            return
    begin = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
    end = np.append(begin[1:], len(token))
    some = (node[begin] != node[end - 1]) & (np.maximum.reduceat(open_, begin) > 0)
    kept = np.repeat(some, end - begin)
    token, node, at, open_, width, rank = (x[kept] for x in (token, node, at, open_, width, rank))
    if not len(token):
        return
    names = ["links", *_STATE]

    def out(links: bool, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(columns[0]), 1 << 16):
            cut = [pa.array(x[i:i + (1 << 16)]) for x in columns]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cut[0]), links)), *cut], names=names)

    yield from out(False, [token, node, at, open_, width, rank])
    lead = _Leading.of(token, node, open_ > 0, leaders)
    first = np.cumsum(lead.count) - lead.count
    row = np.arange(len(token))
    for n in range(1, int(lead.count.max()) + 1):
        row = row[lead.count[lead.token[row]] >= n]
        other = row[(lead.nth[row] == 0) | (lead.nth[row] > n)]
        to = lead.first[first[lead.token[other]] + n - 1]
        yield from out(True, [token[other], node[to], at[to], node[other], at[other], width[other]])


def _links_met(rows: DataFrame) -> DataFrame:
    """The links of ``_round``: as they were found, and as links of centres between the texts ``a`` and ``b``."""
    links = rows.where("links").select(*[F.col(x).alias(y) for x, y in zip(_STATE, _MET)])
    swap = F.col("other") > F.col("to")

    def side(x: str, y: str):
        return F.when(swap, F.col(x)).otherwise(F.col(y))

    a, b = side("to_at", "other_at"), side("other_at", "to_at")
    return links.select(*_MET, side("to", "other").alias("a"), side("other", "to").alias("b"),
                        (b - a).alias("shift"), a.alias("lo"), a.alias("hi"), F.lit(0).cast("long").alias("hash"), a.alias("centre"))


def _beside(links: DataFrame, compared: DataFrame, least: int) -> DataFrame:
    """Links of whole windows, and others but where all windows of ``least`` tokens lie in a range that was compared at that offset."""
    whole = links.where("width > 1").select(*_LINK)
    links = links.where("width = 1").select(*_LINK).distinct()
    inside = (links.a == compared.a) & (links.b == compared.b) & (links["shift"] == compared["shift"]) & (
        F.greatest(links.centre - F.lit(least - 1), F.lit(0)) >= compared.lo) & (links.centre + F.lit(least) <= compared.hi)
    return links.join(compared, inside, "left_anti").unionByName(whole)


def _settled(links: DataFrame, passages: DataFrame) -> DataFrame:
    """Rows of ``_STATE`` that tell which places of others a passage with a leader holds."""
    place = links.select("token", "other", "other_at", "a", "b", "centre", "width")
    held = (place.a == passages.a) & (place.b == passages.b) & (place.centre >= passages.a_start) & (
        place.centre + place.width <= passages.a_end)
    return place.join(passages, held, "left_semi").select("token", F.col("other").alias("node"), F.col("other_at").alias("at"), F.lit(_SETTLED).cast("long").alias("open"), "width",
                                                       F.lit(0).cast("long").alias("rank"))


def _ranked(rows: DataFrame) -> DataFrame:
    """Rows with ranks that rise with the ids, null last."""
    last = F.lit((1 << 63) - 1)
    if isinstance(rows.schema["id"].dataType, IntegralType):
        return rows.withColumn("rank", F.coalesce(F.col("id").cast("long"), last))
    ranks = rows.select("id").where("id is not null").distinct().sort("id").withColumn("rank", F.monotonically_increasing_id()).checkpoint()
    return rows.join(ranks, "id", "left").withColumn("rank", F.coalesce("rank", last))


def repeated_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_words: int = 50,
                      similarity: float = 0.8, hashes: int = 3, least_hashes: int = 1, keys_each: int = 2 << 20) -> DataFrame:
    """Passages of ``least_words`` or more that nearly repeat a passage of another row.

    Words are lower-cased runs of digits, a-z and non-ASCII characters, tokens
    are five-word shingles. Of each distinct text (by 64-bit hash), every token
    range of the least length whose minimum under one of ``hashes`` functions is
    at the same token lies in one compact window. Windows meet by that token
    with its twelve neighbours on the left or right (an exact repeat always has
    one side whole, whatever its place); each key links its text of the smallest id
    with the others, in a task first and then over tasks, so m texts give m - 1
    links, and all but the smallest are repeats of a smaller one (null ids last). For
    each pair of texts the shared ranges of one offset are joined as intervals
    that ``least_hashes`` functions must support; their equal runs are chained with
    those of neighbouring offsets, and verified on the texts: ranges with Jaccard
    similarity of tokens ``similarity`` or more.

    Exact repeats of the least length are always linked to the first text that
    shares their key, edited ones with high probability (tests measure it). That
    text may share no more than a frequent line, or be unlike one of two alike; so
    the windows of the least length about the linked centres meet once more, where one
    of them is in no passage of its pair: by their rarest tokens, and whole where every
    token is in other texts. At each of these the first open texts are compared with all others that have it; texts that a
    passage with one of them does not hold go on to the next, until none is open.
    So a text is compared with every other at such a token, or is a repeat of one that is.
    Copies of a text are compared once: each copy but the first is one row,
    and its first copy stands for it elsewhere. Null and short texts have no
    passages; null ids are kept; rows that repeat an id and a text are no
    repeats of each other. Empty tables give no rows; other columns are ignored.

    Returns one row for each passage: id, start_word, end_word (exclusive),
    source id (the smaller), source_start, source_end and similarity.
    """
    spark = docs.sparkSession
    prepare(spark)
    kept = spark.conf.get(_CLEANED, "false")
    spark.conf.set(_CLEANED, "true")
    try:
        out = _repeated_passages(docs, id_col, text_col, least_words, similarity, hashes, least_hashes, keys_each)
    finally:
        spark.conf.set(_CLEANED, kept)
    return out


def _repeated_passages(docs: DataFrame, id_col: str, text_col: str, least_words: int, similarity: float, hashes: int, least_hashes: int,
                       keys_each: int) -> DataFrame:
    """``repeated_passages``; each step is checkpointed, so shuffle files are of no use once it has ended."""
    spark = docs.sparkSession
    least = least_words - SHINGLE + 1
    rows = pick(docs, id=id_col, text=text_col).where("text is not null")
    rows = rows.select(F.xxhash64("text").alias("node"), "id", "text")
    ranked = _ranked(rows)
    chars = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    wide = max(int(spark.conf.get("spark.sql.shuffle.partitions")), chars // 24 * hashes // keys_each + 1)
    bits = max(12, (16 * wide).bit_length())
    windows = ranked.select("text", "rank").mapInArrow(lambda b: _emit_windows(b, hashes, least, bits),
                                                       ", ".join(["bucket long", *(f"{c} binary" for c in _COLUMNS)]))
    links = windows.repartition(wide, "bucket").mapInArrow(_meet, ", ".join(f"{c} long" for c in _LINK))
    passage = ", ".join(f"{c} long" for c in _PASSAGE[:-1]) + ", similarity double"

    def sent(rows: DataFrame) -> DataFrame:
        """Up to 2^20 texts by their hashes (8 MB, 16 with a rank) are sent to all tasks, more are joined."""
        return F.broadcast(rows) if rows.count() <= 1 << 20 else rows

    def with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
        return (pairs.join(texts.withColumnsRenamed({"node": "b", "packed": "text_b"}), "b")
                .join(texts.withColumnsRenamed({"node": "a", "packed": "text_a"}), "a"))

    def with_few_texts(pairs: DataFrame, texts: DataFrame, few: DataFrame) -> DataFrame:
        """``with_texts`` where a text of each pair is one of ``few``, which are sent to all tasks: pairs take no text along through a shuffle."""
        leads = few.select(F.col("node").alias("a"), F.lit(True).alias("leads"))
        pairs = pairs.join(F.broadcast(leads), "a", "left").withColumns({"led": F.when(F.col("leads"), F.col("a")).otherwise(F.col("b")),
                                                                         "other": F.when(F.col("leads"), F.col("b")).otherwise(F.col("a"))})
        pairs = pairs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "other")  # they are small: few tasks would compare them all
        both = (pairs.join(texts.withColumnsRenamed({"node": "other", "packed": "text_o"}).hint("merge"), "other")
                .join(F.broadcast(few.withColumnsRenamed({"node": "led", "packed": "text_l"})), "led"))
        return both.withColumns({"text_a": F.when(F.col("leads"), F.col("text_l")).otherwise(F.col("text_o")),
                                 "text_b": F.when(F.col("leads"), F.col("text_o")).otherwise(F.col("text_l"))})

    def paired(links: DataFrame) -> DataFrame:
        return links.groupBy("a", "b").agg(F.collect_list(F.struct(*_LINK[2:])).alias("links")).checkpoint()

    def nodes_of(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("node")).distinct().union(pairs.select("b").distinct()).distinct().checkpoint()

    def compare(pairs: DataFrame, texts: DataFrame, again: bool, leading: DataFrame | None = None) -> DataFrame:
        few = None
        if leading is not None:
            few = texts.join(leading, "node", "left_semi").checkpoint()
            size = few.agg(F.coalesce(F.sum(F.octet_length("packed").cast("long") + 16), F.lit(0))).first()[0]
        both = with_texts(pairs, texts) if few is None or size > _FEW else with_few_texts(pairs, texts, few)
        return both.select("a", "b", "text_a", "text_b", "links").mapInArrow(lambda b: _verify(b, similarity, least, 1 if again else least_hashes, again), passage).checkpoint()

    pairs = paired(links)
    texts = (rows.join(sent(nodes_of(pairs)), "node", "left_semi").select("node", "text")  # each that meets another, once, compressed
             .mapInArrow(_packed_texts, "node long, packed binary").groupBy("node").agg(F.first("packed").alias("packed")).checkpoint())
    found = compare(pairs, texts, False)
    firsts = ranked.groupBy("node").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"), F.min("rank").alias("rank")).checkpoint()
    ids = firsts.select("node", "first")
    passages = found.where("similarity is not null")
    ranges = found.where("similarity is null and b_end < 2").groupBy(F.col("a").alias("node")).agg(
        F.collect_set(F.struct(F.col("b").alias("first"), F.col("a_start").alias("last"), F.col("b_end").alias("kind"))).alias("ranges")).checkpoint()
    share = 2 * similarity / (1 + similarity)
    tokens = (texts.join(ranges, "node").select("node", "packed", "ranges")
              .mapInArrow(lambda b: _near_tokens(b, least), "bucket long, token binary, node binary, at binary")
              .repartition("bucket").mapInArrow(_shared_tokens, "node long, at long, token long, texts long")
              .repartition("node").mapInArrow(lambda b: _rare(b, least, share), "token long, node long, at long, open long, width long"))
    state = tokens.join(sent(firsts.join(ranges, "node", "left_semi").select("node", "rank").checkpoint()), "node").select(*_STATE)
    compared = found.where("similarity is null and b_end = 2").selectExpr("a", "b", "b_start as shift", "a_start as lo", "a_end as hi")
    done, leaders, borne_out = 0, 1, passages
    while True:
        met = state.repartition("token").mapInArrow(lambda b: _round(b, done, leaders), ", ".join(["links boolean", *(f"{c} long" for c in _STATE)])).checkpoint()
        if met.isEmpty():
            break
        links = _links_met(met)
        pairs = paired(_beside(links, compared, least))
        nodes = nodes_of(pairs)
        if not nodes.isEmpty():
            more = compare(pairs, texts.join(sent(nodes), "node", "left_semi"), True, links.select(F.col("to").alias("node")).distinct())
            known = passages.selectExpr("a", "b", "a_start as a_from", "a_end as a_to", "b_start as b_from", "b_end as b_to")
            again = (more.a == known.a) & (more.b == known.b) & (known.a_from < more.a_end) & (more.a_start < known.a_to) & (
                known.b_from < more.b_end) & (more.b_start < known.b_to)
            borne_out = passages.unionByName(more)
            passages = passages.unionByName(more.join(known, again, "left_anti")).checkpoint()
        state = met.where("not links").select(*_STATE).unionByName(_settled(links, borne_out))
        done, leaders = leaders, leaders * 4
    named = (passages.join(ids.withColumnsRenamed({"node": "a", "first": "id_a"}), "a")
             .join(ids.withColumnsRenamed({"node": "b", "first": "id_b"}), "b"))
    later = F.coalesce(F.col("id_a") <= F.col("id_b"), F.col("id_b").isNull())  # b is the repeat

    def side(x: str, y: str, name: str):
        return F.when(later, F.col(x)).otherwise(F.col(y)).alias(name)

    named = named.select(side("id_b", "id_a", "id"), side("b_start", "a_start", "start_word"), side("b_end", "a_end", "end_word"),
                         side("id_a", "id_b", "source"), side("a_start", "b_start", "source_start"),
                         side("a_end", "b_end", "source_end"), "similarity")
    many = firsts.where("n > 1")
    counted = (rows.join(sent(many.select("node")), "node", "left_semi").select("node", "text").mapInArrow(_word_counts, "node long, n_words long")
               .groupBy("node").agg(F.max("n_words").alias("n_words")).where(F.col("n_words") >= least_words))
    copies = (rows.select("node", "id").join(many.select("node", "first").join(counted, "node").checkpoint(), "node")
              .where(~F.col("id").eqNullSafe(F.col("first")))
              .select("id", F.lit(0).cast("long").alias("start_word"), F.col("n_words").alias("end_word"), F.col("first").alias("source"),
                      F.lit(0).cast("long").alias("source_start"), F.col("n_words").alias("source_end"), F.lit(1.0).alias("similarity")))
    return named.unionByName(copies).withColumnsRenamed({"id": id_col, "source": f"source_{id_col}"})
