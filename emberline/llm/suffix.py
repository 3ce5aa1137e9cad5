"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are told apart by their first `WINDOW` bytes only, digit by digit, and a pass goes
on with the suffixes that still share a group with another document:

1. first digit, the `ANCHOR` bytes at sampled suffixes.  A sampled suffix starts at the
   smallest hashed run of ANCHOR bytes of some window; equal windows have it at the same
   place, so no window is lost, and one suffix in eighteen is kept on average;
2. second digit, the bytes that any window around the anchor can reach.  Where they are
   all equal, all those windows are; one half of them at least must be equal for one
   window to be;
3. last digit, whole windows around the anchors that are still in doubt, from the bytes
   around them, a half of them first.  Equal groups are exactly the repeated windows.

Digits meet by hash: the first by 40 bits and its part, the second by 96 more, single windows of
crowded anchors by 96
; windows of the last digit are compared byte by byte.

A group is settled by its smallest document, and a document sends one suffix of a group:
those equal to it get what it gets, by a comparison of windows within the document at the
end.  Tasks settle what they can among their own suffixes.  An anchor with so many
surroundings that its group would not fit a sort partition goes to the last pass window by
window, so that its windows fall into many groups, which tasks cut down in the same way.
What moves are columns packed by target partition.  There are as many parts as the input
needs but no more than MAX_PARTS partitions; a partition of several parts is dealt into
them, a further digit, by a sort that spills.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from emberline.llm.arrow import own_partitions
from emberline.scratch import stage

WINDOW = 50
ANCHOR = 16
REACH = WINDOW - ANCHOR  # bytes of a window that can lie on one side of its anchor
HALF = REACH // 2
#: bytes of text hashed at once, of a document partition, and suffixes of a sort partition
PIECE_BYTES = 512 << 10
DOC_PART_BYTES = 24 << 20
SORT_PART = 600_000
#: surroundings of one anchor in one batch that go to its group, at most
CROWD = 512
#: bytes of text whose suffixes are settled together, about
BATCH_BYTES = 16 << 20
#: surroundings that are compared at once, more only if one anchor has more
SLICE = 60_000
#: anchors whose surrounding bytes are cut out at once
CUT = 20_000
#: partitions of an exchange, at most
MAX_PARTS = 4_096
#: bytes that a window around an anchor may reach on either side
MARGIN = REACH + WINDOW
NO_ID = np.iinfo(np.int64).max

ENTRIES, AROUND, WHOLE, SPANS, ASKED, HOT, TWINS, DOCS = range(8)
SORTED = (ENTRIES, AROUND, WHOLE)
ROW = "kind int, part int, sub int, blob binary"

_B1, _B2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * _M1
    x = (x ^ (x >> U(29))) * _M2
    return x ^ (x >> U(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[:1] = 1
    return np.multiply.accumulate(out)


_kept: dict[int, np.ndarray] = {}


def _kept_powers(base: int, n: int) -> np.ndarray:
    if n > PIECE_BYTES + 4 * MARGIN:
        return _powers(base, n)
    if len(_kept.get(base, ())) < n:
        _kept[base] = _powers(base, max(n, 1 << 16))
    return _kept[base][:n]


class Hasher:
    """Hashes of any substrings of a buffer, from prefix sums."""

    def __init__(self, data: np.ndarray, base: int = _B1):
        n = len(data)
        self.inverse = _kept_powers(pow(base, -1, 1 << 64), n + 1)
        self.sums = np.zeros(n + 1, U)
        np.cumsum((data.astype(U) + U(1)) * _kept_powers(base, n), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.inverse[start])


def window_hashes(text: np.ndarray) -> np.ndarray:
    """64 bits for each window of a text, from two bases."""
    at = np.arange(max(0, len(text) - WINDOW + 1))
    if not len(at):
        return np.zeros(0, U)
    return _mix(Hasher(text).of(at, at + WINDOW) + Hasher(text, _B2).of(at, at + WINDOW) * _M1)


def _slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over each run of `width` neighbours."""
    have = 1
    while 2 * have <= width:
        x = f(x[: len(x) - have], x[have:])
        have *= 2
    return f(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def anchors(data: np.ndarray, ends: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the sampled suffixes of documents that lie end to end in data."""
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, U)
    h = data.astype(U) + U(1)
    for step in (1, 2, 4, 8):  # runs of ANCHOR bytes
        h = h[: len(h) - step] * U(pow(_B1, step, 1 << 64)) + h[step:]
    h = _mix(h) | U(1)
    least = _slide(h, REACH + 1, np.minimum)
    whole = (np.repeat(ends, lengths)[: len(least)] - np.arange(len(least))) >= WINDOW
    least = np.where(whole, least, U(0))
    most = _slide(np.concatenate([np.zeros(REACH, U), least, np.zeros(REACH, U)]), REACH + 1, np.maximum)
    at = np.flatnonzero(h == most[: len(h)])
    return at, h[at]


def _cut(x: np.ndarray, keep: int) -> np.ndarray:
    """The upper bytes of 64-bit numbers, plane by plane."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, 8 - keep :].T)


def _uncut(planes: np.ndarray) -> np.ndarray:
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, 8 - planes.shape[0] :] = planes.T
    return out.reshape(-1).view(U)


def _pack(*arrays, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(pickle.dumps(arrays, protocol=5))


def _unpack(blob: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def _by_part(parts: np.ndarray, count: int):
    """(part, indices) of the parts that occur."""
    order = np.argsort(parts, kind="stable")
    bounds = np.searchsorted(parts[order], np.arange(count + 1))
    for p in np.flatnonzero(np.diff(bounds)):
        yield int(p), order[bounds[p] : bounds[p + 1]]


@dataclass
class Parts:
    """Numbers of the parts of sort keys and of document keys, and of their partitions."""

    sort: int
    docs: int
    sort_places: np.ndarray
    doc_places: np.ndarray

    def of(self, kind: int) -> tuple[int, np.ndarray]:
        return (self.sort, self.sort_places) if kind in SORTED else (self.docs, self.doc_places)


class _Out:
    """Rows for the next exchange.  fine: the number within its partition of each part is told."""

    def __init__(self, parts: Parts, fine: bool = False):
        self.parts, self.fine, self.rows = parts, fine, []

    def dealt(self, kind: int, key: np.ndarray):
        """(partition, sub, indices) of the keys, by the part that their hash falls into."""
        n, places = self.parts.of(kind)
        part, width = (key % U(n)).astype(np.int64), len(places)
        if self.fine or n <= width:
            for p, i in _by_part(part, n):
                yield int(places[p % width]), p // width, i
        else:
            for p, i in _by_part(part % width, width):
                yield int(places[p]), -1, i

    def by_doc(self, kind: int, key: np.ndarray, *columns: np.ndarray) -> None:
        """Rows for documents, by the document partition of their row key."""
        for place, sub, i in self.dealt(kind, key):
            i = i[np.lexsort((columns[0][i], key[i]))]
            self.rows.append((kind, place, sub, _pack(key[i], *(x[i].astype(np.int64) for x in columns))))

    def windows(self, h: np.ndarray, h2: np.ndarray, doc: np.ndarray, key: np.ndarray, at: np.ndarray) -> None:
        """Settle windows among themselves; one of each group goes on."""
        order = np.lexsort((at, key, doc, h2, h))
        h, h2, doc, key, at = (x[order] for x in (h, h2, doc, key, at))
        first = np.r_[True, (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])] if len(h) else np.zeros(0, bool)
        least = _least(doc, first)
        twin = ~first & np.r_[False, key[1:] == key[:-1]][: len(key)]
        self.by_doc(SPANS, key[(doc > least) & ~twin], at[(doc > least) & ~twin], at[(doc > least) & ~twin] + WINDOW)
        self.twins(key[twin])
        send = np.flatnonzero((doc == least) & ~twin)
        for place, sub, i in self.dealt(WHOLE, h[send]):
            i = send[i]
            self.rows.append((WHOLE, place, sub, _pack(h[i], h2[i], doc[i], key[i], at[i].astype(np.int64))))

    def twins(self, key: np.ndarray) -> None:
        """Rows that have one suffix several times and send it once."""
        key = np.unique(key)
        if len(key):
            self.by_doc(TWINS, key, np.zeros(len(key), np.int64))

    def batch(self) -> pa.RecordBatch:
        columns = zip(*self.rows, strict=True) if self.rows else ((),) * 4
        kind, part, sub, blob = columns
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(part, pa.int32()), pa.array(sub, pa.int32()), pa.array(blob, pa.binary())], ["kind", "part", "sub", "blob"])


def _least(doc: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The first document of each row's group; groups are sorted by document."""
    return doc[np.maximum.accumulate(np.where(first, np.arange(len(doc)), 0))]


def row_key(doc_id: int, text: bytes) -> int:
    return xxhash.xxh64_intdigest(text, doc_id & 0xFFFFFFFFFFFFFFFF)


def _window_rows(text: np.ndarray, at: np.ndarray):
    """Start and both hashes of the windows around anchors (in order) of one document, some anchors after others."""
    low = 0
    while low < len(at):
        high = int(np.searchsorted(at, min(at[low] + PIECE_BYTES, at[min(low + 4 * CUT, len(at)) - 1]), "right"))
        around = at[low:high, None] - np.arange(REACH + 1)
        starts = np.unique(around[(around >= 0) & (around + WINDOW <= len(text))])
        low = high
        if len(starts):
            begin, part = starts[0], text[starts[0] : starts[-1] + WINDOW]
            h, h2 = (Hasher(part, base).of(starts - begin, starts - begin + WINDOW) for base in (_B1, _B2))
            yield h, (h2 >> U(32)).astype(np.uint32), starts


def _all_windows(out: _Out, texts: dict, key: np.ndarray, doc: np.ndarray, at: np.ndarray) -> None:
    """Windows around anchors (key, at) of rows whose texts are at hand."""
    order = np.lexsort((at, key))
    key, doc, at = key[order], doc[order], at[order]
    cols, held, cuts = [], 0, np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]) if len(key) else [0]

    def flush():
        out.windows(*(np.concatenate(x) for x in zip(*cols, strict=True)))
        cols.clear()

    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        for h, h2, s in _window_rows(texts[int(key[a])], at[a:z]):
            cols.append((h, h2, np.full(len(s), doc[a]), np.full(len(s), key[a]), s))
            held += len(s)
            if held > 4 * SORT_PART:
                flush()
                held = 0
    if cols:
        flush()


def _first_pass(parts: Parts, crowd: int):
    """Sampled suffixes with their first two digits, settled within some documents of a batch."""

    def run(batches):
        out = _Out(parts)
        for b in batches:
            texts = [t.as_py() or b"" for t in b.column(1)]
            ids = b.column(0).fill_null(NO_ID).to_numpy()
            keys = np.array([row_key(int(i), t) for i, t in zip(ids, texts, strict=True)], U)
            found, held = [], 0
            for size, columns, dense in _pieces(texts):
                if dense:
                    kept = _one_of_each(columns)
                    out.twins(keys[np.unique(columns[5][~kept])])
                    columns = tuple(c[kept] for c in columns)
                found.append(columns)
                held += size
                if held >= BATCH_BYTES:
                    _settle_digits(out, texts, ids, keys, crowd, *_joined(found))
                    yield out.batch()
                    found, held = [], 0
            if found:
                _settle_digits(out, texts, ids, keys, crowd, *_joined(found))
            if out.rows:
                yield out.batch()

    return run


def _joined(found: list) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*found, strict=True)]


def _pieces(texts: list[bytes]):
    """(bytes, digits, whether suffixes lie dense) of short texts together and of long ones slice by slice."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and size + len(texts[to]) <= PIECE_BYTES:
            size += len(texts[to])
            to += 1
        if to > at:
            columns = _digits(texts[at:to], at)
            yield size, columns, 8 * len(columns[0]) > size
            at = to
            continue
        text = texts[at]
        for low in range(0, len(text), PIECE_BYTES):
            high, begin = min(len(text), low + PIECE_BYTES), max(0, low - MARGIN)
            columns = _digits([text[begin : high + MARGIN]], at)
            pos = columns[6] + begin
            own = (pos >= low) & (pos < high)
            yield high - low, tuple(c[own] for c in (*columns[:6], pos)), 8 * np.count_nonzero(own) > high - low
        at += 1


def _one_of_each(columns: tuple) -> np.ndarray:
    """Whether a suffix is the first of its row with its digits."""
    kh, full, full2, _, _, row, pos = columns
    order = np.lexsort((pos, full2, full, kh, row))
    same = np.ones(max(0, len(order) - 1), bool)
    for x in (kh, full, full2, row):
        same &= x[order][1:] == x[order][:-1]
    out = np.ones(len(kh), bool)
    out[order[1:][same]] = False
    return out


def _settle_digits(out: _Out, texts: list[bytes], ids: np.ndarray, keys: np.ndarray, crowd: int, kh, full, full2, left, right, row, pos) -> None:
    """Settle suffixes with equal first digits and surroundings; the others go to their sort partition."""
    if not len(kh):
        return
    doc = ids[row]
    order = np.lexsort((row, doc, full2, full, kh))
    kh, full, full2, left, right, row, pos, doc = (x[order] for x in (kh, full, full2, left, right, row, pos, doc))
    new_kh = np.r_[True, kh[1:] != kh[:-1]]
    first = new_kh | np.r_[True, (full[1:] != full[:-1]) | (full2[1:] != full2[:-1])]
    twin = ~first & np.r_[False, row[1:] == row[:-1]]
    out.twins(keys[row[twin]])
    settled = doc > _least(doc, first)
    told = settled & ~twin
    out.by_doc(SPANS, keys[row[told]], pos[told] - REACH, pos[told] + WINDOW)
    group = np.cumsum(new_kh) - 1
    crowded = (np.bincount(group, weights=first) > crowd)[group]
    hot = crowded & ~settled & ~twin
    if hot.any():
        _all_windows(out, {int(keys[r]): np.frombuffer(texts[r], np.uint8) for r in np.unique(row[hot])}, keys[row[hot]], doc[hot], pos[hot])
    send = np.flatnonzero(~settled & ~crowded & ~twin)
    marks = kh[crowded & new_kh]
    marked = {(p, s): i for p, s, i in out.dealt(ENTRIES, marks)}
    sent = {(p, s): i for p, s, i in out.dealt(ENTRIES, kh[send])}
    for place in sorted(sent.keys() | marked.keys()):
        i = send[sent.get(place, np.zeros(0, np.int64))]
        i = i[np.lexsort((pos[i], row[i]))]
        blob = _pack_entries(kh[i], full[i], full2[i], left[i], right[i], pos[i], ids[row[i]], keys[row[i]], marks[marked.get(place, np.zeros(0, np.int64))], 5 if place[1] >= 0 else 8)
        out.rows.append((ENTRIES, *place, blob))


def _pack_entries(kh, full, full2, left, right, pos, doc, key, marks, keep: int) -> bytes:
    """keep: bytes of the first digit's hash; its part tells the others unless it is dealt again."""
    new = np.r_[True, key[1:] != key[:-1]][: len(key)]
    at, own = np.flatnonzero(new), np.cumsum(new) - 1
    planes = pos.astype(np.int64).view(np.uint8).reshape(-1, 8)[:, :5].T.copy()
    return _pack(_cut(kh, keep), _cut(full, 8), full2, left, right, planes, own.astype(np.uint32), doc[at], key[at], _cut(marks, keep))


def _unpack_entries(blob: bytes) -> tuple:
    kh, full, full2, left, right, planes, own, doc, rows, marks = _unpack(blob)
    pos = np.zeros((planes.shape[1], 8), np.uint8)
    pos[:, :5] = planes.T
    return _uncut(kh), _uncut(full), full2, left, right, pos.reshape(-1).view(np.int64), doc[own], rows[own], _uncut(marks)


def _digits(texts: list[bytes], offset: int):
    """(first digit, both hashes of the surroundings, left half, right half, row, position) of sampled suffixes."""
    lengths = np.array([len(t) for t in texts], np.int64)
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum(lengths)
    at, kh = anchors(data, ends, lengths)
    row = np.searchsorted(ends, at, side="right")
    begin, end = ends[row] - lengths[row], ends[row]
    h, h2 = Hasher(data), Hasher(data, _B2)
    low, high = np.maximum(begin, at - REACH), np.minimum(end, at + WINDOW)
    sides = (at - low).astype(U) * U(0x9E3779B97F4A7C15) + (high - at).astype(U) * U(0xD6E8FEB86659FD93)
    full, full2 = _mix(h.of(low, high) + sides), (_mix(h2.of(low, high) + sides) >> U(32)).astype(np.uint32)
    short = lambda x: ((x >> U(40)) % U(255) + U(1)).astype(np.uint8)
    left = np.where(at - begin >= HALF, short(h.of(np.maximum(begin, at - HALF), at)), 0).astype(np.uint8)
    after = np.minimum(end, at + ANCHOR)
    right = np.where(end - after >= HALF, short(h.of(after, np.minimum(end, after + HALF))), 0).astype(np.uint8)
    return kh, full, full2, left, right, row + offset, at - begin


def _shared(kh: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Entries whose anchor and half occur with another entry; halves that are cut off match none."""
    order = np.lexsort((side, kh))
    same = (kh[order][1:] == kh[order][:-1]) & (side[order][1:] == side[order][:-1]) & (side[order][1:] > 0)
    out = np.zeros(len(kh), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _second_pass(parts: Parts):
    """Groups of equal anchors: settle equal surroundings, ask for the rest where in doubt."""

    def settle(kinds: dict, out: _Out):
        *cols, marks = zip(*map(_unpack_entries, kinds[ENTRIES]), strict=True)
        kh, full, full2, left, right, pos, doc, key = map(np.concatenate, cols)
        hot = np.unique(np.concatenate(marks))
        order = np.argsort(kh, kind="stable")
        again = kh[order][1:] == kh[order][:-1]
        keep = order[np.r_[again, False] | np.r_[False, again] | np.isin(kh[order], hot)] if len(kh) else order
        kh, full, full2, left, right, pos, doc, key = (x[keep] for x in (kh, full, full2, left, right, pos, doc, key))
        order = np.lexsort((doc, full2, full, kh))
        kh, full, full2, left, right, pos, doc, key = (x[order] for x in (kh, full, full2, left, right, pos, doc, key))
        if not len(kh):
            return
        least = _least(doc, np.r_[True, (kh[1:] != kh[:-1]) | (full[1:] != full[:-1]) | (full2[1:] != full2[:-1])])
        out.by_doc(SPANS, key[doc > least], pos[doc > least] - REACH, pos[doc > least] + WINDOW)
        rep = np.flatnonzero(doc == least)
        kh, left, right, pos, key = (x[rep] for x in (kh, left, right, pos, key))
        burning = np.isin(kh, hot)
        out.by_doc(HOT, key[burning], pos[burning])
        doubt = (_shared(kh, left) | _shared(kh, right)) & ~burning
        out.by_doc(ASKED, key[doubt], pos[doubt])

    return _grouped(settle, parts, (ENTRIES,))


def _surroundings(key: int, doc: int, pos: np.ndarray, text: np.ndarray):
    """The bytes around anchors of one row, how many of them are text on either side, and whose they are."""
    for c in range(0, len(pos), CUT):
        at = pos[c : c + CUT]
        low, high = max(0, int(at[0]) - REACH), min(len(text), int(at[-1]) + WINDOW)
        padded = np.concatenate([np.zeros(REACH - (int(at[0]) - low), np.uint8), text[low:high], np.zeros(WINDOW, np.uint8)])
        yield padded[(at - at[0])[:, None] + np.arange(REACH + WINDOW)], np.stack([np.minimum(REACH, at), np.minimum(REACH, len(text) - at - ANCHOR)], 1).astype(np.uint8), np.full(len(at), doc, np.int64), np.full(len(at), key, U), at


def _anchor_hash(around: np.ndarray) -> np.ndarray:
    return _bytes_hash(around, REACH, ANCHOR)


def _bytes_hash(around: np.ndarray, begin: int, n: int) -> np.ndarray:
    out = np.zeros(len(around), U)
    for j in range(begin, begin + n):
        out = out * U(_B1) + around[:, j].astype(U) + U(1)
    return _mix(out)


def _settle_around(blobs: list[bytes], out: _Out) -> None:
    """Equal windows among the bytes around anchors: those with an equal half meet, some groups after others."""
    around, side, doc, key, at = (np.concatenate(x) for x in zip(*map(_unpack, blobs), strict=True))
    anchor = _anchor_hash(around)
    for begin, offsets in ((HALF, range(HALF, REACH + 1)), (REACH + ANCHOR, range(HALF))):
        group = _mix(anchor + _bytes_hash(around, begin, HALF))
        order = np.argsort(group, kind="stable")
        again = group[order][1:] == group[order][:-1]
        order = order[np.r_[again, False] | np.r_[False, again]] if len(order) else order
        starts = np.flatnonzero(np.r_[True, group[order][1:] != group[order][:-1]]) if len(order) else np.zeros(0, int)
        low = 0
        while low < len(order):
            after = starts[np.searchsorted(starts, low + SLICE) :]
            high = int(after[0]) if len(after) else len(order)
            _settle_slice(*(c[order[low:high]] for c in (around, side, doc, key, at)), offsets, out)
            low = high


def _settle_slice(around, side, doc, key, at, offsets: range, out: _Out) -> None:
    """One offset of the anchor in the window after another."""
    n, begin, end = len(around), REACH - offsets[-1], REACH - offsets[0] + WINDOW
    power, inverse = _powers(_B1, end - begin), _powers(pow(_B1, -1, 1 << 64), len(offsets))
    sums = np.zeros((n, end - begin + 1), U)
    for a in range(0, n, CUT):
        np.cumsum((around[a : a + CUT, begin:end].astype(U) + U(1)) * power, axis=1, out=sums[a : a + CUT, 1:])
    gone = np.zeros((n, len(offsets)), bool)
    for k, offset in enumerate(offsets):
        fit = np.flatnonzero((side[:, 0] >= offset) & (side[:, 1] >= REACH - offset))
        if len(fit) < 2:
            continue
        low = REACH - offset - begin
        h = _mix((sums[fit, low + WINDOW] - sums[fit, low]) * inverse[low])
        order = np.lexsort((doc[fit], h))
        first = np.r_[True, h[order][1:] != h[order][:-1]]
        windows = around[:, REACH - offset : REACH - offset + WINDOW]
        head = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        met = np.flatnonzero(~first)
        if (windows[fit[order[met]]] != windows[fit[order[head[met]]]]).any():  # equal hashes of unequal bytes
            h = np.unique(np.ascontiguousarray(windows[fit]).view(f"V{WINDOW}").ravel(), return_inverse=True)[1]
            order = np.lexsort((doc[fit], h))
            first = np.r_[True, h[order][1:] != h[order][:-1]]
        fit = fit[order]
        gone[fit, k] = doc[fit] > _least(doc[fit], first)
    edge = np.diff(np.pad(gone, ((0, 0), (1, 1))).view(np.int8), axis=1)
    row, low = np.nonzero(edge > 0)
    _, high = np.nonzero(edge < 0)
    out.by_doc(SPANS, key[row], at[row] - (high - 1 + offsets[0]), at[row] - (low + offsets[0]) + WINDOW)


def _last_pass(parts: Parts):
    """Groups of equal windows, from the bytes around anchors and from single windows."""

    def settle(kinds: dict, out: _Out):
        if kinds[AROUND]:
            _settle_around(kinds[AROUND], out)
        if kinds[WHOLE]:
            h, h2, doc, key, at = (np.concatenate(x) for x in zip(*map(_unpack, kinds[WHOLE]), strict=True))
            order = np.lexsort((doc, h2, h))
            h, h2, doc, key, at = (x[order] for x in (h, h2, doc, key, at))
            gone = doc > _least(doc, np.r_[True, (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])][: len(h)])
            out.by_doc(SPANS, key[gone], at[gone], at[gone] + WINDOW)

    return _grouped(settle, parts, (AROUND, WHOLE))


def _split(parts: Parts):
    """Deal the rows of a partition into its parts."""

    def run(batches):
        out, size = _Out(parts, fine=True), 0
        for b in batches:
            for kind, place, sub, blob in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if sub >= 0:
                    out.rows.append((kind, place, sub, blob))
                elif kind == ENTRIES:
                    *columns, marks = _unpack_entries(blob)
                    marked = {(p, s): i for p, s, i in out.dealt(kind, marks)}
                    sent = {(p, s): i for p, s, i in out.dealt(kind, columns[0])}
                    none = np.zeros(0, np.int64)
                    for to in sorted(sent.keys() | marked.keys()):
                        out.rows.append((kind, *to, _pack_entries(*(c[sent.get(to, none)] for c in columns), marks[marked.get(to, none)], 8)))
                elif kind == DOCS:
                    ids, keys, texts = _unpack(blob)
                    for p, s, i in out.dealt(kind, keys):
                        out.rows.append((kind, p, s, _pack(ids[i], keys[i], [texts[k] for k in i.tolist()], level=3)))
                else:
                    columns = _unpack(blob)
                    hashed = _anchor_hash(columns[0]) if kind == AROUND else columns[0]
                    for p, s, i in out.dealt(kind, hashed):
                        out.rows.append((kind, p, s, _pack(*(c[i] for c in columns))))
                size += len(blob)
                if size > 8 << 20:
                    yield out.batch()
                    size = 0
        if out.rows:
            yield out.batch()

    return run


def _grouped(settle, parts: Parts, kinds: tuple[int, ...]):
    """Run settle on the blobs of each part by kind (rows come in order of part); pass other kinds on."""

    def run(batches):
        out, held, now = _Out(parts), {k: [] for k in kinds}, None
        for b in batches:
            for kind, part, sub, blob in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if (part, sub) != now:
                    if any(held.values()):
                        settle(held, out)
                        yield out.batch()
                    held, now = {k: [] for k in kinds}, (part, sub)
                if kind in held:
                    held[kind].append(blob)
                else:
                    out.rows.append((kind, part, sub, blob))
            if out.rows:
                yield out.batch()
        if any(held.values()):
            settle(held, out)
            yield out.batch()

    return run


def _pack_docs(parts: Parts):
    """Texts by document partition, many to a row."""

    def run(batches):
        for b in batches:
            texts = [t.as_py() or b"" for t in b.column(1)]
            ids = b.column(0).fill_null(NO_ID).to_numpy()
            keys = np.array([row_key(int(i), t) for i, t in zip(ids, texts, strict=True)], U)
            out = _Out(parts)
            for place, sub, i in out.dealt(DOCS, keys):
                held, size = [], 0
                for k in i.tolist():
                    held.append(k)
                    size += len(texts[k])
                    if size >= 4 << 20 or k == i[-1]:
                        out.rows.append((DOCS, place, sub, _pack(ids[held], keys[held], [texts[x] for x in held], level=3)))
                        held, size = [], 0
                if len(out.rows) >= 256:
                    yield out.batch()
            if out.rows:
                yield out.batch()

    return run


class _ByKey:
    """Columns by row key, from blobs."""

    def __init__(self, blobs: list[bytes]):
        cols = [np.concatenate(x) for x in zip(*map(_unpack, blobs), strict=True)]
        order = np.argsort(cols[0], kind="stable") if cols else None
        self.key, self.columns = (cols[0][order], [c[order] for c in cols[1:]]) if cols else (np.zeros(0, U), [np.zeros(0, np.int64)] * 2)

    def of(self, key) -> list[np.ndarray]:
        a, z = np.searchsorted(self.key, U(key), "left"), np.searchsorted(self.key, U(key), "right")
        return [c[a:z] for c in self.columns]


def _with_docs(work):
    """Run work(ids, keys, texts, columns by kind) on each row of DOCS, after the other rows of its part."""

    def run(batches):
        held, ready, now = {}, None, None
        for b in batches:
            for kind, part, sub, blob in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if (part, sub) != now:
                    held, ready, now = {SPANS: [], ASKED: [], HOT: [], TWINS: []}, None, (part, sub)
                if kind != DOCS:
                    held[kind].append(blob)
                    continue
                if ready is None:
                    ready = {k: _ByKey(v) for k, v in held.items()}
                yield from work(*_unpack(blob), ready)

    return run


def _answer(parts: Parts):
    """The bytes around the anchors that are asked for; windows of those with crowded groups."""

    def work(ids, keys, texts, asked):
        out, held, seen = _Out(parts), [], set()

        def flush():
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            held.clear()
            for place, sub, i in out.dealt(AROUND, _anchor_hash(columns[0])):
                out.rows.append((AROUND, place, sub, _pack(*(c[i] for c in columns))))

        for doc, key, text in zip(ids, keys, texts, strict=True):
            if int(key) in seen:
                continue
            seen.add(int(key))
            at = np.unique(asked[ASKED].of(key)[0])
            for part in _surroundings(int(key), int(doc), at, np.frombuffer(text, np.uint8)) if len(at) else ():
                held.append(part)
                if sum(len(x[0]) for x in held) > 10 * CUT:
                    flush()
                    yield out.batch()
            at = np.unique(asked[HOT].of(key)[0])
            if len(at):
                _all_windows(out, {int(key): np.frombuffer(text, np.uint8)}, np.full(len(at), key, U), np.full(len(at), doc, np.int64), at)
        if held:
            flush()
        if out.rows:
            yield out.batch()

    return _with_docs(work)


RESULT = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"


def _merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint runs that cover the same bytes; runs that touch are one."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.r_[True, starts[1:] > reach[:-1]]) if len(starts) else np.zeros(0, int)
    return starts[new], reach[np.r_[new[1:] - 1, len(reach) - 1][: len(new)]]


def _again(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of all windows that are equal to one that begins and ends within a given run."""
    low, high = _merged(starts, ends - WINDOW + 1)  # first bytes of removed windows
    gone, held = [], 0
    for a, z in zip(low.tolist(), high.tolist(), strict=True):
        for x in range(a, z, PIECE_BYTES):
            gone.append(window_hashes(text[x : min(z, x + PIECE_BYTES) + WINDOW - 1]))
            held += len(gone[-1])
        if held > 1 << 20:
            gone = [np.unique(np.concatenate(gone))]
            held = 0
    gone = np.unique(np.concatenate(gone))
    first, last = [low], [high + WINDOW - 1]
    for a in range(0, len(text) - WINDOW + 1, PIECE_BYTES):
        hit = np.isin(window_hashes(text[a : a + PIECE_BYTES + WINDOW - 1]), gone)
        edge = np.diff(np.r_[0, hit.view(np.int8), 0])
        first.append(a + np.flatnonzero(edge > 0)), last.append(a + np.flatnonzero(edge < 0) + WINDOW - 1)
    return np.concatenate(first), np.concatenate(last)


def _remove():
    kind = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])

    def work(ids, keys, texts, known):
        rows, size = [], 0
        for doc, key, text in zip(ids, keys, texts, strict=True):
            n = len(text)
            starts, ends = known[SPANS].of(key)
            starts, ends = np.maximum(starts, 0), np.minimum(ends, n)
            low, high = _merged(starts, ends)
            if 0 < (high - low).sum() < n and len(known[TWINS].of(key)[0]):
                low, high = _merged(*_again(np.frombuffer(text, np.uint8), starts, ends))
            starts, ends = low.tolist(), high.tolist()
            kept = b"".join(text[a:z] for a, z in zip([0, *ends], [*starts, n], strict=True)) if starts else text
            rows.append({"doc_id": None if doc == NO_ID else int(doc), "n_bytes": n, "n_removed": n - len(kept), "spans": [{"start": a, "end": z} for a, z in zip(starts, ends, strict=True)], "kept": kept})
            size += len(kept)
            if size > 8 << 20:
                yield pa.RecordBatch.from_pylist(rows, kind)
                rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, kind)

    return _with_docs(work)


def _unused_below(rows: DataFrame) -> int | None:
    """An id that no row has, if null needs the largest one and a row has that; smaller ids can then move down by one."""
    row = rows.agg(F.max("doc_id"), F.count_if(F.col("doc_id").isNull()), F.min("doc_id")).first()
    if row[0] != NO_ID or not row[1]:
        return None
    if row[2] > -NO_ID - 1:
        return -NO_ID - 1
    ids = rows.select("doc_id").distinct()
    after = ids.where(F.col("doc_id") < NO_ID).select((F.col("doc_id") + 1).alias("after"))
    return after.join(ids, F.col("after") == F.col("doc_id"), "left_anti").agg(F.min("after")).first()[0]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept) for each row of docs.

    A byte is removed if a string of WINDOW bytes over it also starts in a row with a
    smaller id.  Strings never cross rows and are judged on the input.  A null text is
    empty.  A null id is larger than any other, and rows of one id take nothing from
    each other.  A text of any length and any period takes memory for its bytes and for
    one piece of PIECE_BYTES.  An empty table gives an empty result; further columns are
    not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("text"))
    gap = _unused_below(rows)
    if gap is not None:  # ids above the gap move down by one, so that the largest is left to null
        moved = rows.withColumn("doc_id", F.when(F.col("doc_id") > gap, F.col("doc_id") - 1).otherwise(F.col("doc_id")))
        return _removed(moved).withColumn("doc_id", F.when(F.col("doc_id") >= gap, F.col("doc_id") + 1).otherwise(F.col("doc_id")))
    return _removed(rows)


def _removed(rows: DataFrame) -> DataFrame:
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sort_parts, doc_parts = max(8, -(-size // (18 * SORT_PART))), max(8, -(-size // DOC_PART_BYTES))
    crowd = max(4, min(CROWD, SORT_PART // 2 // max(1, size // BATCH_BYTES)))
    parts = Parts(sort_parts, doc_parts, own_partitions(spark, min(MAX_PARTS, sort_parts)), own_partitions(spark, min(MAX_PARTS, doc_parts)))

    def exchange(df: DataFrame, n: int) -> DataFrame:
        df = df.repartition(min(MAX_PARTS, n), "part")
        return (df.mapInArrow(_split(parts), ROW) if n > MAX_PARTS else df).sortWithinPartitions("part", "sub", "kind")

    entries = exchange(rows.mapInArrow(_first_pass(parts, crowd), ROW), sort_parts)
    settled = stage(entries.mapInArrow(_second_pass(parts), ROW), "suffix")
    packed = rows.mapInArrow(_pack_docs(parts), ROW)
    asked = settled.where(F.col("kind").isin(ASKED, HOT)).unionByName(packed)
    answers = exchange(asked, doc_parts).mapInArrow(_answer(parts), ROW)
    windows = answers.unionByName(settled.where(F.col("kind") == WHOLE))
    last = stage(exchange(windows, sort_parts).mapInArrow(_last_pass(parts), ROW), "suffix")
    spans = settled.where(F.col("kind").isin(SPANS, TWINS)).unionByName(last)
    return exchange(spans.unionByName(packed), doc_parts).mapInArrow(_remove(), RESULT)
