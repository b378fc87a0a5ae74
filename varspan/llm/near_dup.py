"""Near-dedup by order MinHash: ordered minimum k-mers find candidates, banded alignment of words verifies them."""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varspan.llm.common import bound_batches, forget, save
from varspan.llm.components import connected_components

#: Words of a k-mer, minima of a sketch, sketches, and the least similarity of a link.
K, MINIMA, SKETCHES, SIMILARITY = 2, 3, 56, 0.8
#: Short texts have sketches of single words: (most words, minima) of each kind. Two lengths that can link share a kind.
SHORT = ((12, 3), (50, 5))
#: Words of the k-mers that chain an alignment.
CHAIN = 3
#: Counts that a text's words are dealt to: (most words, counts), four for each word or more. Longer texts have LONG counts, made where they are read.
BINS, LONG = ((256, 1024), (1024, 4096), (4096, 16384)), 8192
#: Counts are compared as sums of so many first, which rules most pairs out.
COARSE = 8
#: Words up to which texts are aligned in their block (blocks hold each word of them), and up to which many pairs side by side; cells of a step of that.
ALIGNED, SIDE, CELLS = BINS[-1][0], 512, 1 << 20
#: Rows of a block, and pairs that are compared at once.
BLOCK, AT_ONCE = 2048, 200_000
#: Likest partners of a row with a longer text, or that has one, which are aligned before the others.
FEW = 4
#: Low bits of a hash that give way to the place of its k-mer, and k-mers that are sketched at once.
PLACE, CHUNK = np.uint64((1 << 28) - 1), 1 << 17
_M1, _M2, _P, _TOP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def codes(text: str | None) -> tuple[bytes, np.ndarray]:
    """md5 of a text's words, and their 32-bit hashes."""
    whole = " ".join(words_of(text)).encode("utf-8", "replace")
    return hashlib.md5(whole).digest(), np.array([zlib.crc32(x) for x in whole.split(b" ")] if whole else [], dtype=np.uint32)


def kmers(w: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words; a shorter text is one run."""
    k = min(k, len(w))
    out = np.zeros(len(w) - k + 1, dtype=np.uint64)
    for j in range(k):
        out = out * _P + w[j : len(w) - k + 1 + j]
    return _mix(out)


def _chunks(sizes: np.ndarray):
    """Runs of texts that hold about CHUNK k-mers together."""
    lo, total = 0, np.cumsum(sizes)
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + CHUNK, "right")))
        yield lo, hi
        lo = hi


def _labelled(hs: list[np.ndarray]) -> np.ndarray:
    """Hashes of k-mers with their number of occurrence in the text, so repeats count as often as they come."""
    h, sizes = np.concatenate(hs), np.array([len(x) for x in hs])
    starts = np.cumsum(sizes) - sizes
    order = np.concatenate([np.argsort(x, kind="stable") for x in hs]) + np.repeat(starts, sizes)
    new = np.append(True, h[order[1:]] != h[order[:-1]])
    new[starts] = True
    run = np.arange(len(h)) - np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    label = np.empty(len(h), dtype=np.uint64)
    label[order] = run
    return _mix(h + (label + np.uint64(1)) * _P)


def _minima(tagged: np.ndarray, sizes: np.ndarray, minima: int, sketches: int) -> np.ndarray:
    """The places in its text of the least k-mers by each sketch's hash, for each text; -1 where a text has no more.

    A hash and its k-mer's place share a number, so a minimum by text brings its place along.
    """
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(tagged), dtype=np.uint64) - np.repeat(starts, sizes).astype(np.uint64)
    seeds = _mix(np.arange(1, sketches + 1, dtype=np.uint64) * _P)
    odd = _mix(seeds) | np.uint64(1)
    out = np.empty((sketches, len(sizes), minima), dtype=np.int64)
    v, least = np.empty_like(tagged), np.empty(len(sizes), dtype=np.uint64)
    for s in range(sketches):
        np.bitwise_xor(tagged, seeds[s], out=v)
        np.multiply(v, odd[s], out=v)
        np.bitwise_and(v, ~PLACE, out=v)
        np.bitwise_or(v, place, out=v)
        for j in range(minima):
            np.minimum.reduceat(v, starts, out=least)
            at = (least & PLACE).astype(np.int64)
            some = least != _TOP
            out[s, :, j] = np.where(some, at, -1)
            if j < minima - 1:
                v[(starts + at)[some]] = _TOP
    return out


def sketch_all(ws: list[np.ndarray], k: int, minima: int, sketches: int) -> np.ndarray:
    """A row of sketches for each text: the k-mers whose labelled hashes are least, hashed in text order.

    Keeping the order is what makes a sketch follow edit similarity and not the bag of k-mers.
    """
    out = np.empty((len(ws), sketches), dtype=np.uint64)
    for lo, hi in _chunks(np.array([len(w) for w in ws])):
        hs = [kmers(w, k) for w in ws[lo:hi]]
        h, sizes = np.concatenate(hs), np.array([len(x) for x in hs])
        at = np.sort(_minima(_labelled(hs), sizes, minima, sketches), axis=2)
        starts = (np.cumsum(sizes) - sizes)[None, :]
        got = np.zeros(at.shape[:2], dtype=np.uint64)
        for j in range(minima):
            got = _mix(got * _P + np.where(at[:, :, j] < 0, np.uint64(0), h[starts + np.maximum(at[:, :, j], 0)]))
        out[lo:hi] = _mix(got + _mix(np.arange(1, sketches + 1, dtype=np.uint64))[:, None]).T
    return out


def histogram(w: np.ndarray) -> bytes:
    """What counts of a text's words are made from: 16 bits of each word, or of long texts the counts. No count is above 255.

    An edit moves two counts by one, and a bound on counts only lowers their difference.
    """
    if len(w) <= BINS[-1][0]:
        return w.astype(np.uint16).tobytes()
    return _counts(w, LONG).tobytes()


def _counts(w: np.ndarray, bins: int) -> np.ndarray:
    return np.minimum(np.bincount(w % bins, minlength=bins), 255).astype(np.uint8)


def sketches_all(ws: list[np.ndarray], k: int, minima: int, sketches: int, similarity: float) -> list[np.ndarray]:
    """The sketches of each text. A length from which a link reaches into the next kind has both kinds, so links don't end where a kind does."""
    out: list[list[np.ndarray]] = [[] for _ in ws]
    low, salts = 0, _mix(np.arange(len(SHORT) + 1, dtype=np.uint64))
    for kind, (most, least_of, size) in enumerate([*((m, n, 1) for m, n in SHORT), (None, minima, k)]):
        own = [i for i, w in enumerate(ws) if len(w) > low and (most is None or len(w) <= most)]
        if own:
            for i, row in zip(own, sketch_all([ws[i] for i in own], size, least_of, sketches), strict=True):
                out[i].append(_mix(row ^ salts[kind]))
        low = int((most or 0) * similarity)
    return [np.concatenate(x) for x in out]


def sketches_of(w: np.ndarray, k: int, minima: int, sketches: int, similarity: float) -> np.ndarray:
    return sketches_all([w], k, minima, sketches, similarity)[0]


class _Facts:
    """Lengths and counts of words of texts, and whether they allow a link."""

    def __init__(self, n: np.ndarray, hist: list[bytes]):
        self.n, self.held = n.astype(np.int64), hist
        size = [next((b for most, b in BINS if x <= most), LONG) for x in self.n.tolist()]
        self.kind, self.at, self.of = np.array(size, dtype=np.int64), np.zeros(len(hist), dtype=np.int64), {}
        for b in np.unique(self.kind).tolist():
            own = np.flatnonzero(self.kind == b)
            self.at[own] = np.arange(len(own))
            self.of[b] = np.stack([np.frombuffer(hist[i], dtype=np.uint8) if b == LONG else _counts(np.frombuffer(hist[i], dtype=np.uint16), b) for i in own])
        self.coarse = {b: self._folded(x, b // COARSE) for b, x in self.of.items()}

    def aligned(self, i: np.ndarray, other: "_Facts", j: np.ndarray, similarity: float) -> np.ndarray:
        """Edits between texts by 16 bits of each word, which are no more than by all of it; -1 where those are too many, 0 where a text is too long to say."""
        n, m = self.n[i], other.n[j]
        most = ((1 - similarity) * np.maximum(n, m) + 1e-9).astype(np.int64)
        out = np.zeros(len(i), dtype=np.int64)
        short = np.flatnonzero(np.maximum(n, m) <= SIDE)
        short = short[np.argsort(n[short], kind="stable")]
        read = lambda facts, at: [np.frombuffer(facts.held[x], dtype=np.uint16) for x in at]
        lo = 0
        while lo < len(short):
            step = max(1, CELLS // int(2 * most[short[min(lo + 4096, len(short) - 1)]] + 1))
            k = short[lo : lo + step]
            out[k] = _banded(read(self, i[k]), read(other, j[k]), most[k])
            lo += step
        for k in np.flatnonzero((np.maximum(n, m) > SIDE) & (np.maximum(n, m) <= ALIGNED)).tolist():
            d = _whole(*read(self, i[k : k + 1]), *read(other, j[k : k + 1]), int(most[k]))
            out[k] = d if d <= most[k] else -1
        return out

    @staticmethod
    def _folded(x: np.ndarray, bins: int) -> np.ndarray:
        """Counts that share a place modulo ``bins``, added up."""
        if x.shape[1] == bins:
            return x
        return np.minimum(x.reshape(len(x), -1, bins).sum(axis=1, dtype=np.int32), 255).astype(np.uint8)

    def may_link(self, i: np.ndarray, other: "_Facts", j: np.ndarray, similarity: float) -> np.ndarray:
        """False only where the edit distance is surely too great."""
        return self.apart(i, other, j, similarity) >= 0

    def apart(self, i: np.ndarray, other: "_Facts", j: np.ndarray, similarity: float) -> np.ndarray:
        """By how much counts of words differ; -1 where the edit distance is surely too great."""
        n, m = self.n[i], other.n[j]
        most = ((1 - similarity) * np.maximum(n, m) + 1e-9).astype(np.int64)
        room = 2 * most - np.abs(n - m)
        fits = np.abs(n - m) <= most
        found = np.full(len(i), -1, dtype=np.int64)
        for x in self.of:
            for y in other.of:
                left = np.flatnonzero(fits & (self.kind[i] == x) & (other.kind[j] == y))
                # the sums first, the counts themselves for what they leave
                for mine, theirs, bins in ((self.coarse[x], other.coarse[y], min(x, y) // COARSE), (self.of[x], other.of[y], min(x, y))):
                    keep, step = [], max(1, (4 << 20) // max(mine.shape[1], theirs.shape[1]))
                    for lo in range(0, len(left), step):
                        k = left[lo : lo + step]
                        a, b = self._folded(mine[self.at[i[k]]], bins), self._folded(theirs[other.at[j[k]]], bins)
                        differ = (np.maximum(a, b) - np.minimum(a, b)).sum(axis=1, dtype=np.int32)
                        ok = differ <= room[k]
                        keep.append(k[ok])
                        if bins == min(x, y):
                            found[k[ok]] = differ[ok]
                    left = np.concatenate(keep) if keep else left
        return found


def _banded(a: list[np.ndarray], b: list[np.ndarray], most: np.ndarray) -> np.ndarray:
    """Edit distances of many pairs of runs at once, a row of all their tables at a time within a band around the diagonals; -1 above ``most``."""
    n, m = (np.array([len(x) for x in y]) for y in (a, b))
    band, rows, large = int(most.max()), int(n.max()), np.int16(30_000)
    left = np.full((len(a), rows), -1, dtype=np.int32)
    right = np.full((len(a), rows + 2 * band + 1), -2, dtype=np.int32)
    for p in range(len(a)):
        left[p, : n[p]] = a[p]
        right[p, band : band + m[p]] = b[p]
    out, own = np.full(len(a), -1, dtype=np.int64), np.arange(len(a))
    shift = np.arange(2 * band + 1, dtype=np.int16)
    row = np.broadcast_to(np.where(shift >= band, shift - np.int16(band), large), (len(a), len(shift))).astype(np.int16)
    for i in range(1, rows + 1):
        new = row + (right[:, i - 1 : i + 2 * band] != left[:, i - 1 : i])
        np.minimum(new[:, :-1], row[:, 1:] + np.int16(1), out=new[:, :-1])
        new -= shift
        np.minimum.accumulate(new, axis=1, out=new)
        new += shift
        row = np.minimum(new, large)
        ends = np.flatnonzero(n == i)
        if len(ends):
            d = row[ends, band + m[ends] - n[ends]].astype(np.int64)
            out[own[ends]] = np.where(d <= most[ends], d, -1)
        if i % 8 == 0:
            stay = (n > i) & (row.min(axis=1) <= most)
            if not stay.any():
                break
            if stay.mean() < 0.7:
                left, right, row, n, m, most, own = left[stay], right[stay], row[stay], n[stay], m[stay], most[stay], own[stay]
    return out


def _gap(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance of two runs within a band of ``most`` around the diagonal; above ``most``: most + 1."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    if not n or not m or n == m == 1:
        return max(n, m) if not (n == m == 1 and a[0] == b[0]) else 0
    if n * m <= 64:
        row, x, y = list(range(m + 1)), a.tolist(), b.tolist()
        for i in range(n):
            last, row[0] = row[0], i + 1
            for j in range(m):
                last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x[i] != y[j]))
        return min(row[m], most + 1)
    far = np.int64(n + m + 1)
    row = np.full(m + 1, far)
    row[: min(m, most) + 1] = np.arange(min(m, most) + 1)
    for i in range(1, n + 1):
        low, high = max(0, i - most), min(m, i + most)
        new = np.full(high - low + 1, far)
        js = np.arange(max(1, low), high + 1)
        if len(js):
            new[js[0] - low :] = np.minimum(row[js - 1] + (b[js - 1] != a[i - 1]), row[js] + 1)
        if low == 0:
            new[0] = i
        shift = np.arange(len(new))
        new = np.minimum.accumulate(new - shift) + shift
        if new.min() > most:
            return most + 1
        row[max(0, low - 1) : low] = far
        row[low : high + 1] = new
    return int(min(row[m], most + 1))


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Words to insert, delete or replace; above ``most`` only if every alignment needs more than ``most``.

    Counts of words rule most unlike texts out. An alignment through shared k-mers is quick and mostly enough; where it
    needs too much, the whole table decides.
    """
    _, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = (np.bincount(v, minlength=len(at)) for v in (at[: len(a)], at[len(a) :]))
    apart = max(len(a), len(b)) - int(np.minimum(x, y).sum())
    if apart > most:
        return apart
    found = _chained(a, b, most)
    return found if found <= most else _whole(a, b, most)


def _trimmed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both without the words that they begin and end with alike."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b, n = a[head:], b[head:], n - head
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(differ[0]) if len(differ) else n
    return a[: len(a) - tail], b[: len(b) - tail]


def _whole(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance; above ``most``: most + 1. A column of the table is two integers with a bit for each row, that rises or falls there."""
    a, b = _trimmed(a, b)
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    if not n or not m:
        return max(n, m)
    _, words = np.unique(np.concatenate([a, b]), return_inverse=True)
    rows = [0] * (int(words.max()) + 1)
    for i, x in enumerate(words[:n].tolist()):
        rows[x] |= 1 << i
    every, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score, room = every, 0, n, m + most
    for x in words[n:].tolist():
        same = rows[x]
        diagonal = (((same & up) + up) ^ up) | same | down
        more, less = down | (every & ~(diagonal | up)), diagonal & up
        if more & top:
            score += 1
        elif less & top:
            score -= 1
        room -= 1
        if score > room:
            return most + 1
        more = more << 1 | 1
        up, down = every & (less << 1 | ~(diagonal | more)), more & diagonal & every
    return score


def _chained(a: np.ndarray, b: np.ndarray, most: int, k: int = CHAIN) -> int:
    """Edits of an alignment through shared k-mers, which may be more than the edit distance; above ``most``: more than ``most``.

    k-mers that are unique in both texts and lie within the band chain the alignment, the longest
    rising chain of them; only what lies between is aligned word by word within the band.
    """
    if abs(len(a) - len(b)) > most:
        return most + 1
    a, b = _trimmed(a, b)
    total = i0 = j0 = 0
    if min(len(a), len(b)) > 2 * k:
        ua, ia, ca = np.unique(kmers(a, k), return_index=True, return_counts=True)
        ub, ib, cb = np.unique(kmers(b, k), return_index=True, return_counts=True)
        _, x, y = np.intersect1d(ua[ca == 1], ub[cb == 1], assume_unique=True, return_indices=True)
        i, j = ia[ca == 1][x], ib[cb == 1][y]
        near = np.abs(i - j) <= most
        order = np.argsort(i[near])
        i, j = i[near][order], j[near][order]
        if len(j) and (np.diff(j) <= 0).any():
            i, j = _rising(i, j)
        new = np.flatnonzero(np.append(True, (np.diff(i) != 1) | (np.diff(j) != 1))) if len(i) else []
        stop = np.append(new[1:], len(i)) - 1 if len(i) else []
        for s, e in zip(new, stop, strict=True):
            i1, j1 = int(i[s]), int(j[s])
            skip = max(0, i0 - i1, j0 - j1)
            i1, j1, i2, j2 = i1 + skip, j1 + skip, int(i[e]) + k, int(j[e]) + k
            if i1 >= i2:
                continue
            total += _gap(a[i0:i1], b[j0:j1], most - total)
            if total > most:
                return most + 1
            i0, j0 = i2, j2
    return total + _gap(a[i0:], b[j0:], most - total)


def _rising(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A longest subsequence of rising j."""
    ends, at, back = [], [], []
    for p, v in enumerate(j.tolist()):
        q = bisect_left(ends, v)
        ends[q : q + 1] = [v]
        at[q : q + 1] = [p]
        back.append(at[q - 1] if q else -1)
    keep, p = [], at[-1]
    while p >= 0:
        keep.append(p)
        p = back[p]
    keep.reverse()
    return i[keep], j[keep]


def _verified(pairs: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose words agree to ``similarity`` or more of the longer text."""

    def run(batches):
        for batch in batches:
            a, b, keep = batch.column("wa"), batch.column("wb"), []
            for k in range(batch.num_rows):
                x, y = (c[k].values.to_numpy(zero_copy_only=False).view(np.uint32) for c in (a, b))
                most = int((1 - similarity) * max(len(x), len(y)) + 1e-9)
                keep.append(edit_distance(x, y, most) <= most)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    right = words.select(F.col("tid").alias("b"), F.col("w").alias("wb"))
    left = words.select(F.col("tid").alias("a"), F.col("w").alias("wa"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "wa", "wb").mapInArrow(run, "a long, b long")


def _allowed(pairs: DataFrame, facts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that lengths and histograms allow to link."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (_Facts(batch.column(n).to_numpy(), batch.column(h).to_pylist()) for n, h in (("na", "ha"), ("nb", "hb")))
                k = np.arange(batch.num_rows)
                yield batch.select(["a", "b"]).filter(pa.array(x.may_link(k, y, k, similarity), pa.bool_()))

    left = facts.select(F.col("tid").alias("a"), F.col("n").alias("na"), F.col("hist").alias("ha"))
    right = facts.select(F.col("tid").alias("b"), F.col("n").alias("nb"), F.col("hist").alias("hb"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "na", "nb", "ha", "hb").mapInArrow(run, "a long, b long")


def _windows(n: np.ndarray, m: np.ndarray, similarity: float, rising: bool):
    """Arrays (i, j) of the places of lengths n and sorted lengths m that may link; ``rising``: both are one list, and i < j."""
    first = np.arange(len(n)) + 1 if rising else np.searchsorted(m, np.ceil(n * similarity - 1e-9), "left")
    width = np.maximum(np.searchsorted(m, np.floor(n / similarity + 1e-9), "right") - first, 0)
    done, lo = np.append(0, np.cumsum(width)), 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(done, done[lo] + AT_ONCE, "right")) - 1)
        w = width[lo:hi]
        i = np.repeat(np.arange(lo, hi), w)
        yield i, first[i] + np.arange(len(i)) - np.repeat(done[lo:hi] - done[lo], w)
        lo = hi


def _likest(row: np.ndarray, apart: np.ndarray, few: int) -> np.ndarray:
    """Places of the ``few`` least ``apart`` of each row."""
    order = np.lexsort((apart, row))
    at, own = np.arange(len(order)), row[order]
    first = np.maximum.accumulate(np.where(np.append(True, own[1:] != own[:-1]), at, 0)) if len(own) else at
    return order[at - first < few]


class _Buckets:
    """Sketches that rows (bucket, sk) carry, null in rows that carry none: two rows that do meet in the first bucket alone that they share."""

    def __init__(self, bucket: pa.ChunkedArray, sk: pa.ChunkedArray):
        some = np.flatnonzero(sk.is_valid().to_numpy())
        self.bucket, self.at = bucket.to_numpy(), np.full(len(sk), -1, dtype=np.int64)
        self.at[some] = np.arange(len(some))
        self.sk = np.concatenate([x.flatten().to_numpy() for x in sk.chunks]).reshape(len(some), -1) if len(some) else None

    def first(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether rows i and j, which share a bucket, share none before it."""
        out = np.ones(len(i), dtype=bool)
        both = np.flatnonzero((self.at[i] >= 0) & (self.at[j] >= 0))
        for lo in range(0, len(both), 1 << 14):
            k = both[lo : lo + (1 << 14)]
            x, y = self.sk[self.at[i[k]]], self.sk[self.at[j[k]]]
            out[k] = x[np.arange(len(k)), (x == y).argmax(axis=1)] == self.bucket[i[k]]
        return out


class _Joined:
    """Classes that links have joined, by the least of each."""

    def __init__(self):
        self.under: dict[int, int] = {}

    def least(self, c: int) -> int:
        top = c
        while (up := self.under.get(top, top)) != top:
            top = up
        while c != top:
            self.under[c], c = top, self.under[c]
        return top

    def join(self, a: list[int], b: list[int]) -> np.ndarray:
        """Which of the links between classes a and b join two that weren't one yet."""
        new = np.zeros(len(a), dtype=bool)
        for k, (x, y) in enumerate(zip(a, b, strict=True)):
            x, y = self.least(x), self.least(y)
            if x != y:
                self.under[max(x, y)] = min(x, y)
                new[k] = True
        return new


def _pairs_of(t: pa.Table, similarity: float, few: int | None, joined: _Joined):
    """Pairs of rows (g, role, c, tid, n, hist) of whole groups g that may link: by how much their words differ, and whether they join two classes.

    Rows may also have (bucket, sk); then two rows with sketches are a pair only in the first bucket that they share.

    With ``few``, texts of ALIGNED words or fewer are aligned to the end by 16 bits of each word, likest
    first, and of them those pairs are given that join two classes: classes that such pairs have joined need no more
    alignment. So a group gives fewer of them than it has rows, and if all of them link, nothing else that links is left to join. Pairs with a
    longer text are given if counts allow a link, the likest of each row only. Without ``few`` all pairs are given that may link.
    Role 0 and 1 rows meet the other side only; role 2 rows meet each other and sides don't matter.
    """
    g, role, c, tid, n = (t.column(x).to_numpy().astype(np.int64) for x in ("g", "role", "c", "tid", "n"))
    facts, order = _Facts(n, t.column("hist").to_pylist()), np.lexsort((n, g))
    g, long = g[order], n > ALIGNED
    buckets = _Buckets(t.column("bucket"), t.column("sk")) if "sk" in t.column_names else None
    group = np.cumsum(np.append(False, g[1:] != g[:-1])).astype(np.int64)
    own, code = np.unique(c, return_inverse=True)
    own = own.tolist()
    least = np.array([joined.least(z) for z in own], dtype=np.int64)

    def given(i, j, apart, joins):
        a, b = tid[i], tid[j]
        return np.minimum(a, b), np.maximum(a, b), apart, np.full(len(a), joins)

    for k in range(int(group[-1]) + 1) if len(g) else ():
        rows = order[slice(*np.searchsorted(group, [k, k + 1]))]
        sides = [(rows, rows)] if role[rows[0]] == 2 else [(rows[role[rows] == 0], rows[role[rows] == 1])]
        for x, y in sides:
            for i, j in _windows(n[x], n[y], similarity, x is y):
                i, j = x[i], y[j]
                ok = least[code[i]] != least[code[j]]
                i, j = i[ok], j[ok]
                if buckets:
                    ok = buckets.first(i, j)
                    i, j = i[ok], j[ok]
                apart = facts.apart(i, facts, j, similarity)
                ok = apart >= 0
                i, j, apart = i[ok], j[ok], apart[ok]
                if few is None:
                    at = np.flatnonzero(facts.aligned(i, facts, j, similarity) >= 0)
                    yield given(i[at], j[at], apart[at], False)
                    continue
                left, take = np.flatnonzero(~(long[i] | long[j])), 1
                while len(left):
                    left = left[least[code[i[left]]] != least[code[j[left]]]]
                    pick = np.unique(np.concatenate([_likest(z[left], apart[left], take) for z in (i, j)]))
                    at, left, take = left[pick], np.delete(left, pick), 4 * take
                    at = at[facts.aligned(i[at], facts, j[at], similarity) >= 0]
                    at = at[joined.join(c[i[at]].tolist(), c[j[at]].tolist())]
                    if len(at):
                        least = np.array([joined.least(z) for z in own], dtype=np.int64)
                        yield given(i[at], j[at], apart[at], True)
                at = np.flatnonzero((long[i] | long[j]) & (least[code[i]] != least[code[j]]))
                if len(at):
                    at = at[np.unique(np.concatenate([_likest(z[at], apart[at], few) for z in (i, j)]))]
                    yield given(i[at], j[at], apart[at], False)


def _met(members: DataFrame, facts: DataFrame, similarity: float, few: int | None = None) -> DataFrame:
    """Pairs (a, b, apart, joins) of members (bucket, tid, c) that share a bucket, differ in class c and may link.

    With ``few``: of texts of ALIGNED words or fewer, pairs that join what all their pairs would join, with ``joins``; of pairs with a longer text the
    likest of each member in its block. Without: all.

    The members of a bucket's largest class are dealt to blocks of about BLOCK and don't meet each
    other; the others go to every such block, and meet each other by pairs of blocks. So a class
    however large, with a few strangers in its bucket, is copied not at all. Texts with sketches in
    ``facts``, which are those too long to align side by side, meet in one of their buckets only. Pairs are made in
    arrays of bounded length inside a group of rows, and leave it only if the counts of their words and, of texts
    of ALIGNED words or fewer, an alignment there allow a link.
    """

    def run(batches):
        joined = _Joined()

        def given(t):
            for got in _pairs_of(t, similarity, few, joined):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], names=["a", "b", "apart", "joins"])

        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if held.num_rows >= 2 * BLOCK:
                g = held.column("g").to_numpy()
                cut = int(np.searchsorted(g, g[-1]))
                if cut:
                    yield from given(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield from given(held)

    sizes = members.groupBy("bucket", "c").agg(F.count(F.lit(1)).alias("k"))
    size = sizes.groupBy("bucket").agg(F.count(F.lit(1)).alias("classes"), F.sum("k").alias("all"), F.max(F.struct("k", "c")).alias("top")).where("classes > 1")
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(c / BLOCK)).cast("int")
    size = save(size.select("bucket", F.col("top.c").alias("main"), blocks(F.col("top.k")).alias("mains"), blocks(F.col("all") - F.col("top.k")).alias("others")), "mixed")
    rows = members.join(size, "bucket")
    number = lambda n, salt: F.pmod(F.xxhash64("tid", F.lit(salt)), n).cast("int")
    role = lambda r, *where: F.struct(F.lit(r).alias("role"), F.xxhash64("bucket", *where).alias("g"))
    own = F.col("own")
    # the largest class: one block, in which the others come to it
    main = rows.where("c = main").select("tid", "c", "bucket", role(0, F.lit("m"), number(F.col("mains"), 1)).alias("r"))
    other = rows.where("c <> main").withColumn("own", number(F.col("others"), 2))
    come = other.select("tid", "c", "bucket", F.explode(F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda b: role(1, F.lit("m"), b))).alias("r"))
    meet = F.transform(
        F.sequence(F.lit(0), F.col("others") - 1),
        lambda b: F.struct(
            F.when(own == b, 2).otherwise((own < b).cast("int")).alias("role"), F.xxhash64("bucket", F.lit("o"), F.least(own, b), F.greatest(own, b)).alias("g")
        ),
    )
    among = other.select("tid", "c", "bucket", F.explode(meet).alias("r"))
    rows = save(main.unionByName(come).unionByName(among).select("tid", "c", "bucket", "r.role", "r.g"), "blocks")
    rows = rows.join(facts, "tid").select("g", "role", "c", "tid", "n", "hist", "bucket", "sk").repartition("g").sortWithinPartitions("g")
    pairs = rows.mapInArrow(run, "a long, b long, apart long, joins boolean")
    return pairs.groupBy("a", "b").agg(F.min("apart").alias("apart"), F.any_value("joins").alias("joins"))


def _likest_of(pairs: DataFrame, few: int | None) -> DataFrame:
    """The pairs (a, b) that are among the ``few`` least apart of a or of b; without ``few`` all."""
    if few is None:
        return pairs.select("a", "b")
    ends = pairs.select("a", "b", "apart", F.explode(F.array("a", "b")).alias("end"))
    w = Window.partitionBy("end").orderBy("apart", "a", "b")
    return ends.withColumn("k", F.row_number().over(w)).where(F.col("k") <= few).select("a", "b").distinct()


def row_key(text: Column) -> Column:
    """What tells rows with one doc_id apart."""
    return F.coalesce(F.xxhash64(text.cast("string")), F.lit(0))


def _classes(documents: DataFrame, k: int, minima: int, sketches: int, similarity: float) -> DataFrame:
    """doc_id, row, class_id, kept of each row whose doc_id is not null; rows of a doc_id are told apart by ``row_key``."""
    bound_batches(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.where("doc_id is not null").select("doc_id", row_key(F.col("text")).alias("row"), "text")
    cells = [("tid", "long"), ("sk", "array<long>"), ("n", "int"), ("hist", "binary"), ("w", "array<int>")]
    arrow = {"long": pa.int64(), "array<long>": pa.list_(pa.int64()), "int": pa.int32(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), *((c, arrow[t]) for c, t in cells)])

    def sketched(batches):
        for batch in batches:
            rows = [codes(t) for t in batch.column(2).to_pylist()]
            some = [i for i, (_, w) in enumerate(rows) if len(w)]
            ws, columns = [rows[i][1] for i in some], [[None] * len(rows) for _ in cells]
            for i, w, s in zip(some, ws, sketches_all(ws, k, minima, sketches, similarity), strict=True):
                row = (int.from_bytes(rows[i][0][:8], "little", signed=True), s.view(np.int64), len(w), histogram(w), w.view(np.int32))
                for column, x in zip(columns, row, strict=True):
                    column[i] = x
            got = [pa.array(x, arrow[t]) for x, (_, t) in zip(columns, cells, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *got], schema=schema)

    sk = save(docs.mapInArrow(sketched, "doc_id long, row long, " + ", ".join(f"{c} {t}" for c, t in cells)), "sketches")
    some = sk.where("tid is not null")
    reps = some.groupBy("tid").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.any_value(F.struct("sk", "n", "hist")).alias("m"))
    reps = save(reps.select("tid", "first", "m.sk", "m.n", "m.hist"), "reps")
    # sketches of what may meet a text that isn't aligned side by side; such texts have those of one kind
    facts = reps.select("tid", "n", "hist", F.when((F.col("n") >= similarity * SIDE) & (F.col("n") > SHORT[-1][0]), F.col("sk")).alias("sk"))
    bands = reps.select("tid", F.explode("sk").alias("bucket"))
    # a bucket's rows: only those of two members or more go on
    leads = save(bands.groupBy("bucket").agg(F.min("tid").alias("lead"), F.max("tid").alias("_max")).where("lead < _max").select("bucket", "lead"), "leads")
    members = save(bands.join(leads, "bucket"), "members")
    forget(leads)

    def linked(pairs: DataFrame, many: bool = False) -> DataFrame:
        ends = pairs.select(F.explode(F.array("a", "b")).alias("tid")).groupBy("tid").agg(F.count(F.lit(1)).alias("k"))
        rows = save(reps.join(ends, "tid", "left_semi").select("tid", "first.doc_id", "first.row"), "needed")
        # the rows of the first pairs grow with the table, so words move to them by a sorted join at every size; later ones are few
        found = some.select("doc_id", "row", "tid", "w").join(rows.hint("merge") if many else rows, ["doc_id", "row", "tid"], "left_semi")
        words = save(found.groupBy("tid").agg(F.any_value("w").alias("w")), "words")
        out = save(_verified(pairs, words, similarity), "links")
        forget(words)
        return out

    def with_classes(comp: DataFrame) -> DataFrame:
        known = members.select("bucket", "tid").join(comp.withColumnRenamed("node", "tid"), "tid", "left")
        return save(known.select("bucket", "tid", F.coalesce("component", "tid").alias("c")), "named")

    def joined(comp: DataFrame, links: DataFrame) -> DataFrame:
        known = comp.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))
        return save(connected_components(known.unionByName(links)), "components")

    # a member meets the smallest text of all its buckets
    first = members.groupBy(F.col("tid").alias("b")).agg(F.min("lead").alias("a")).where("a < b").select("a", "b")
    met = save(_allowed(first, facts, similarity), "pairs")
    comp = save(connected_components(linked(met, many=True)), "components")
    # where a bucket's smallest text is of another class, one of the class meets it
    named = with_classes(comp)
    top = named.groupBy("bucket").agg(F.min(F.struct("tid", "c")).alias("top"), F.count_distinct("c").alias("k")).where("k > 1").select("bucket", "top")
    other = named.join(save(top, "tops"), "bucket").where("c <> top.c").groupBy(F.col("top.tid").alias("a"), "c").agg(F.min("tid").alias("b")).select("a", "b")
    more = save(_allowed(other, facts, similarity).join(met, ["a", "b"], "left_anti"), "pairs")
    if not more.isEmpty():
        comp, met = joined(comp, linked(more)), met.unionByName(more)
        forget(named)
        named = with_classes(comp)
    # members of buckets that still hold more than one class meet each other: first by pairs that join their classes by 16 bits of each word and,
    # of longer texts, the likest; then all, if one of the first doesn't link by whole words, or there are longer texts
    for few in (FEW, None):
        found = save(_met(named, facts, similarity, few), "found")
        if found.isEmpty():
            break
        joins, rest = found.where("joins").select("a", "b"), found.where("not joins")
        again = save(joins.unionByName(_likest_of(rest, few)).join(met, ["a", "b"], "left_anti"), "again")
        links = None
        if not again.isEmpty():
            links = linked(again)
            comp, met = joined(comp, links), met.unionByName(again)
        # a member with any such partner has a likest one; but those may all have met before, so others are looked for even where none of them is new
        if few and rest.isEmpty() and links is not None and joins.join(links, ["a", "b"], "left_anti").isEmpty():
            break
        if few and links is not None:
            forget(named)
            named = with_classes(comp)
    named = reps.select("tid", "first").join(comp.withColumnRenamed("node", "tid"), "tid", "left").select("tid", "first", F.coalesce("component", "tid").alias("c"))
    named = save(named, "classes")
    stays = named.groupBy("c").agg(F.min("first").alias("stays"))
    named = save(named.join(stays, "c").select("tid", "stays"), "stays")
    out = some.select("doc_id", "row", "tid").join(named, "tid")
    out = out.select("doc_id", "row", F.col("stays.doc_id").alias("class_id"), (F.struct("doc_id", "row") == F.col("stays")).alias("kept"))
    return out.unionByName(sk.where("tid is null").select("doc_id", "row", F.col("doc_id").alias("class_id"), F.lit(True).alias("kept")))


def near_duplicates(documents: DataFrame, k: int = K, minima: int = MINIMA, sketches: int = SKETCHES, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, kept of every row: class_id is the smallest doc_id that links reach.

    Texts are lower-cased words. Equal ones are one class before anything else, so a text that a
    third of all rows repeat costs one row. Other texts are candidates when one of their sketches
    agrees, and link when an alignment of their words has at most (1 - similarity) edits for each word of the longer. A member of buckets of
    equal sketches meets the smallest text of them all first, and then, for its class, that of each
    bucket. Where a bucket then holds more than one class, its rows meet in blocks, which give the pairs that join
    classes, and of longer texts the likest rows of different classes; these are aligned, and then all pairs of different classes that may
    link, unless every pair was of the first kind and linked. No bucket, partner or candidate is capped.

    Empty and null texts are never near anything: each is its own class, and kept. Rows that
    repeat a doc_id with another text are judged each by its own text; of texts that a class holds
    under its smallest doc_id one is kept. Rows equal in both share all. A null doc_id has a null
    class and is kept. Other columns are not looked at. An empty table gives no rows. Texts are told
    apart by 64 bits of their md5.
    """
    out = _classes(documents, k, minima, sketches, similarity).select("doc_id", "class_id", "kept")
    none = documents.where("doc_id is null")
    return out.unionByName(none.select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id"), F.lit(True).alias("kept")))


def dedup_documents(documents: DataFrame, k: int = K, minima: int = MINIMA, sketches: int = SKETCHES, similarity: float = SIMILARITY) -> DataFrame:
    """The documents of which one row of each class stays, with their columns, whatever their names.

    A row goes only if its own text's class has another row, so a text that nothing else holds stays,
    also where another row repeats its doc_id. Rows equal in doc_id and text become one. Rows with an
    empty or null text, or without a doc_id, stay.
    """
    rows = save(_classes(documents, k, minima, sketches, similarity), "judged")
    plan = rows.groupBy("doc_id", "row").agg(F.bool_or("kept").alias("kept"), F.count(F.lit(1)).alias("k")).where("not kept or k > 1")
    plan = save(plan, "plan")
    text = F.col("text").cast("string")
    docs = documents.select(F.struct("*").alias("whole"), F.col("doc_id").cast("long").alias("doc_id"), row_key(text).alias("row"), F.length(text).alias("n"))
    # the rows that go grow with the table, so they are met by a sorted join at every size
    left = docs.join(plan.where("not kept").select("doc_id", "row").hint("merge"), ["doc_id", "row"], "left_anti")
    twice = plan.where("kept").select("doc_id", "row")
    if not twice.isEmpty():
        # empty texts have no words to repeat, and are rows of their own
        left = left.join(twice.withColumn("again", F.lit(True)), ["doc_id", "row"], "left")
        repeats = F.coalesce(F.col("again") & (F.col("n") > 0), F.lit(False))
        one = left.where(repeats).groupBy("doc_id", "row").agg(F.any_value("whole").alias("whole"))
        left = left.where(~repeats).select("whole").unionByName(one.select("whole"))
    return left.select("whole.*")
