"""Removal of byte strings that an earlier document already holds.

Two strings of `length` bytes are equal only if their minimisers are: the least
hash among their 16-byte grams, a choice that depends on the string alone. All
windows of a document with one place as their minimiser form a span. Three
passes follow, each over documents dealt into buckets of bounded size by id:

1. Buckets send (minimiser, span hash, least document) once each. Minimisers of
   two or more documents are kept; the others can't be repeated.
2. Equal spans (127 bits of hash) are the same node of the order: documents that
   hold a span which an earlier one holds too lose all of it. What is left to
   decide is the windows of the first holder of each span, where one minimiser
   stands in different spans that agree on its neighbourhood to the left or to
   the right, as spans with a common window must. Those spans are sent, once
   each, and their windows sorted as suffixes: multikey quicksort, eight bytes a
   step, to a shallow depth, then blind tries for groups that still tie. Equal
   windows end up side by side, byte by byte, and the least document among them
   is known.
3. Buckets get the verdicts back and cut their documents.

Spans that many documents share travel once for each bucket, whoever holds
them. A minimiser that stands in very many different spans (the edges of a
passage that many documents hold, each with its own surroundings) would bring
all of them to one task. It goes by windows instead: each bucket sends each of
its distinct windows once, dealt by the window, and they enter the same sort.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import lean, release, staged, whole

GRAM = 16
#: Different spans of a minimiser in one bucket, and in the corpus, beyond which it goes by windows.
LOCAL, CROWD = 64, 1024
#: Bytes of text in a bucket, about; depth of the multikey quicksort.
BUCKET, SHALLOW = 4 << 20, 32
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)
#: Places that are hashed at a time, so that intermediate results stay in a processor's cache.
_STEP = 1 << 14


def _join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    y = right * _B
    y ^= y >> np.uint64(32)
    x = left * _A
    x ^= y
    x *= _C
    x ^= x >> np.uint64(29)
    return x


def hashes(data: np.ndarray, length: int, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all windows of GRAM, of GRAM + side (at most twice GRAM) and of length bytes, and the least gram of each of the last.

    A window's hash joins those of two shorter ones that cover it; eight bytes are their own hash.
    """
    n = len(data)
    count = lambda size: max(0, n - size + 1)
    grams, around, windows, least = (np.empty(count(size), np.uint64) for size in (GRAM, GRAM + side, length, length))
    eight = np.ndarray((count(8),), "<u8", data, strides=(1,)) if n >= 8 else np.zeros(0, np.uint64)
    for a in range(0, count(GRAM), _STEP):
        part = eight[a : a + _STEP + length].astype(np.uint64)
        level = {GRAM: _join(part[:-8], part[8:])}
        size = GRAM
        while 2 * size <= length:
            level[2 * size] = _join(level[size][:-size], level[size][size:])
            size *= 2

        def put(out: np.ndarray, size: int, base: int) -> None:
            shift, of = size - base, level[base]  # noqa: B023
            made = _join(of[: max(0, len(of) - shift)], of[shift:]) if shift else of
            end = min(len(out), a + _STEP)  # noqa: B023
            if end > a:  # noqa: B023
                out[a:end] = made[: end - a]  # noqa: B023

        put(grams, GRAM, GRAM)
        put(around, GRAM + side, GRAM)
        put(windows, length, size)
        end = min(len(least), a + _STEP)
        if end > a:
            least[a:end] = least_of(level[GRAM], length - GRAM + 1)[: end - a]
    return grams, around, windows, least


def least_of(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each window of so many entries."""
    k = 1
    while 2 * k <= width:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    return np.minimum(x[: len(x) - (width - k)], x[width - k :]) if k < width else x


class Spans:
    """Of texts of these sizes, one after the other: arrays of each span's minimiser, hash, first window, number of windows and text number.

    windows: the hash of each window of `length` bytes. near: two 8-bit hashes
    of the minimiser with what stands to its left and to its right, as one
    number; spans that have a window in common agree in one half at least.
    """

    def __init__(self, data: np.ndarray, sizes: np.ndarray, length: int, with_near: bool = False):
        n, most = len(data) - length + 1, length - GRAM + 1
        side = most // 2  # a window reaches so far beyond its minimiser, to one side at least
        grams, around, self.windows, least = hashes(data, length, side if with_near else 0)
        if n <= 0:
            self.key = self.span = self.first = self.many = self.of = np.zeros(0, np.int64)
            self.near = np.zeros(0, np.int16)
            return
        starts = np.cumsum(sizes) - sizes
        edges = np.concatenate([starts, starts + sizes - length + 1])  # where texts begin, and where windows begin to leave them
        cut = np.ones(n, bool)
        cut[1:] = least[1:] != least[:-1]
        cut[edges[(edges > 0) & (edges < n)]] = True
        first = np.flatnonzero(cut)
        many = np.diff(np.append(first, n))
        of = np.searchsorted(starts, first, side="right") - 1  # of texts that begin at one place the last, as the others are empty
        inside = first + length <= starts[of] + sizes[of]
        first, many, of = first[inside], many[inside], of[inside]
        place = _leftmost(grams, least, first, most)
        again = many > place - first + 1  # the gram occurs once more further right: as many spans as places
        if again.any():
            at = np.arange(many[again].sum()) - np.repeat(np.cumsum(many[again]) - many[again], many[again])
            each = np.repeat(first[again], many[again]) + at
            places = _leftmost(grams, least, each, most)
            new = np.append(True, (places[1:] != places[:-1]) | (each[1:] != each[:-1] + 1))
            heads = np.flatnonzero(new)
            first, many, place, of = (np.concatenate([x[~again], y]) for x, y in ((first, each[heads]), (many, np.diff(np.append(heads, len(each)))), (place, places[heads]), (of, np.repeat(of[again], many[again])[heads])))
        span = _join(self.windows[first], self.windows[first + many - 1] + many.astype(np.uint64))
        self.key, self.span = least[first].view(np.int64), span.view(np.int64) & -4  # two bits of the span are kept free
        self.first, self.many, self.of = first, many, of
        if with_near:
            left, right = around[np.maximum(place - side, 0)] >> np.uint64(56), around[np.minimum(place, len(around) - 1)] >> np.uint64(56)
            self.near = (left << np.uint64(8) | right).astype(np.uint16).view(np.int16)


def _leftmost(grams: np.ndarray, least: np.ndarray, windows: np.ndarray, most: int) -> np.ndarray:
    """Where in each window its least gram first occurs."""
    out = windows + most - 1
    # less than the window before had: it has just come in at the right
    search = np.flatnonzero((windows == 0) | (least[windows] >= least[windows - 1]))
    for a in range(0, len(search), 1 << 12):
        w = windows[search[a : a + (1 << 12)]]
        out[search[a : a + (1 << 12)]] = w + (grams[w[:, None] + np.arange(most)] == least[w][:, None]).argmax(1)
    return out


class BlindTrie:
    """A Patricia trie over strings of one length: inner nodes know a depth only, so a string is compared with one leaf."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list | None = None  # [depth, {byte: child}] or, as a leaf, [numbers]

    def insert(self, n: int) -> None:
        text = self.strings[n]
        if self.root is None:
            self.root = [[n]]
            return
        node = self.root
        while len(node) == 2:
            node = node[1].get(text[node[0]]) or next(iter(node[1].values()))
        other = self.strings[node[0][0]]
        if other == text:
            node[0].append(n)
            return
        lcp = _common(text, other)
        above, at = None, self.root
        while len(at) == 2 and at[0] < lcp:
            above, at = at, at[1][text[at[0]]]
        if len(at) == 2 and at[0] == lcp:
            at[1][text[lcp]] = [[n]]
            return
        fork = [lcp, {other[lcp]: at, text[lcp]: [[n]]}]
        if above is None:
            self.root = fork
        else:
            above[1][text[above[0]]] = fork

    def classes(self) -> list[list[int]]:
        """Numbers of equal strings together, classes in the strings' order."""
        out, stack = [], [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if len(node) == 2:
                stack.extend(node[1][b] for b in sorted(node[1], reverse=True))
            else:
                out.append(node[0])
        return out


def _common(a: bytes, b: bytes) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def suffix_classes(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of data that begin at starts, cut at length, in order: (suffix numbers, class of each; equal ones share a class)."""
    padded = np.concatenate([data, np.zeros(SHALLOW, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), ">u8", padded, strides=(1,))
    order = np.arange(len(starts))
    classes = np.zeros(len(starts), np.int64)  # while sorting: where the group of those that tie so far begins
    tied = np.arange(len(starts))
    for depth in range(0, min(SHALLOW, length), 8):  # multikey: eight bytes at a time, among those that tie so far
        word = eight[starts[order[tied]] + depth].astype(np.uint64)
        if depth + 8 > length:
            word >>= np.uint64(8 * (depth + 8 - length))
        by = np.lexsort((word, classes[tied])) if depth else np.argsort(word, kind="stable")
        order[tied], word = order[tied][by], word[by]
        new = np.ones(len(tied), bool)
        new[1:] = (word[1:] != word[:-1]) | (classes[tied][1:] != classes[tied][:-1])
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, len(tied)))
        classes[tied] = np.repeat(tied[first], sizes)
        tied = tied[np.repeat(sizes > 1, sizes)]
    first = np.flatnonzero(np.diff(classes[tied], prepend=-1))
    sizes = np.diff(np.append(first, len(tied)))
    pairs = tied[first[sizes == 2]]
    for n in range(0, len(pairs), 1 << 16):
        _order_pairs(data, starts, order, classes, pairs[n : n + (1 << 16)], length)
    buffer = data.tobytes()
    starts_of, n_of = tied[first[sizes > 2]], sizes[sizes > 2]
    differ = _unlike(data, starts[order], starts_of, n_of, length)  # a trie of equal suffixes is a single leaf
    for a, n in zip(starts_of[differ].tolist(), n_of[differ].tolist(), strict=True):
        members = order[a : a + n].copy()
        trie = BlindTrie([buffer[p : p + length] for p in starts[members].tolist()])
        for k in range(n):
            trie.insert(k)
        at = a
        for same in trie.classes():
            order[at : at + len(same)] = members[same]
            classes[at : at + len(same)] = at
            at += len(same)
    return order, classes


def _unlike(data: np.ndarray, sorted_starts: np.ndarray, first: np.ndarray, sizes: np.ndarray, length: int) -> np.ndarray:
    """Which groups of suffixes, tied to the shallow depth, aren't equal throughout."""
    out = np.zeros(len(first), bool)
    if not len(first) or length <= SHALLOW:
        return out
    group = np.repeat(np.arange(len(first)), sizes)
    member = np.arange(len(group)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first, sizes)
    leader, rest = sorted_starts[first][group], np.arange(SHALLOW, length)
    for a in range(0, len(group), 1 << 16):
        part = slice(a, a + (1 << 16))
        differs = (data[sorted_starts[member[part]][:, None] + rest] != data[leader[part][:, None] + rest]).any(1)
        out[group[part][differs]] = True
    return out


def _order_pairs(data: np.ndarray, starts: np.ndarray, order: np.ndarray, classes: np.ndarray, at: np.ndarray, length: int) -> None:
    """Two suffixes need no trie: their first difference past the shallow depth orders them."""
    if length <= SHALLOW:
        return
    rest = np.arange(SHALLOW, length)
    left, right = order[at].copy(), order[at + 1].copy()
    one, two = data[starts[left][:, None] + rest], data[starts[right][:, None] + rest]
    differs = one != two
    where, some = differs.argmax(1), differs.any(1)
    rows = np.arange(len(at))
    swap = some & (one[rows, where] > two[rows, where])
    order[at], order[at + 1] = np.where(swap, right, left), np.where(swap, left, right)
    classes[at + 1] = np.where(some, at + 1, at)


def _sorted_by(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort order by keys (the last leads), and where the keys but the first of them change."""
    order = np.lexsort(keys)
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = False
        for k in keys[1:]:
            s = k[order]
            new[1:] |= s[1:] != s[:-1]
    return order, new


def _runs(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... many[0] of them, then those from first[1] on."""
    return np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - first, many)


def _find(table: list[np.ndarray], rows: list[np.ndarray]) -> np.ndarray:
    """The number of the table's row that equals each of rows in all columns, -1 if none does. Rows of the table differ."""

    def mixed(columns: list[np.ndarray]) -> np.ndarray:
        out = columns[0].astype(np.int64).view(np.uint64)
        for c in columns[1:]:
            out = _join(out, c.astype(np.int64).view(np.uint64))
        return out

    if not len(table[0]):
        return np.full(len(rows[0]), -1)
    own = mixed(table)
    order = np.argsort(own)
    wanted = mixed(rows)
    at = order[np.minimum(np.searchsorted(own[order], wanted), len(own) - 1)]
    fits = np.ones(len(wanted), bool)
    for t, r in zip(table, rows, strict=True):
        fits &= t[at] == r
    return np.where(fits, at, -1)


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(np.int64)


class _Bucket:
    """A bucket's texts, one after the other, and their spans. only: ids of the documents that matter."""

    def __init__(self, table: pa.Table, length: int, only: np.ndarray | None = None, with_near: bool = False):
        self.ids = _numbers(table, "doc_id")
        matters = np.ones(len(self.ids), bool) if only is None else np.isin(self.ids, only)
        texts = table.column("text").cast(pa.large_binary()).to_pylist()
        self.texts = [t if m else b"" for t, m in zip(texts, matters.tolist(), strict=True)]
        self.data = np.frombuffer(b"".join(self.texts), np.uint8)
        sizes = np.array([len(t) for t in self.texts], np.int64)
        self.starts = np.cumsum(sizes) - sizes
        self.spans = Spans(self.data, sizes, length, with_near)
        self.doc = self.ids[self.spans.of]

    def windows_of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All windows with one of these minimisers, sorted by hash: place, document, hash, and the number of the hash's first entry (that of the least document)."""
        hot = np.isin(self.spans.key, keys)
        at, doc = _runs(self.spans.first[hot], self.spans.many[hot]), np.repeat(self.doc[hot], self.spans.many[hot])
        order, new = _sorted_by(doc, self.spans.windows[at].view(np.int64))
        begin = np.flatnonzero(new)
        return at[order], doc[order], self.spans.windows[at].view(np.int64)[order], np.repeat(begin, np.diff(np.append(begin, len(order))))


#: Bits of a sent span: the bucket has several documents with it; it stands for a minimiser that goes by windows.
_MORE, _HOT = 1, 2
#: What a row of the verdicts says: an earlier document has the span; and its windows are asked for; the minimiser goes by windows.
_EQUAL, _ASKED, _CROWDED = 0, 1, 2
_FOUND = "key long, span long, doc long, first long, kind int"


def offered(bucket: _Bucket, local: int) -> pa.Table:
    """(key, span, doc, near): each span of the bucket once, with its least document; of a crowded minimiser one row."""
    s, doc = bucket.spans, bucket.doc
    alone, rest = _by_number(s.key)
    order, new = _sorted_by(doc[rest], s.span[rest], s.key[rest])
    order, at = rest[order], np.flatnonzero(new)
    low, high = order[at], order[np.append(at[1:], len(order)) - 1] if len(at) else at
    key, span = s.key[low], s.span[low] | np.where(doc[high] != doc[low], _MORE, 0)
    new_key = np.append(True, key[1:] != key[:-1])[: len(key)]
    crowd = np.diff(np.append(np.flatnonzero(new_key), len(key)))
    crowded = np.repeat(crowd > local, crowd)
    span = np.where(crowded, _HOT, span)
    sent = ~crowded | new_key
    row, shown_span = np.concatenate([alone, low[sent]]), np.concatenate([s.span[alone], span[sent]])
    by = np.argsort(row)  # by document, whose number then repeats from row to row and takes little room
    row, shown_span = row[by], shown_span[by]
    return pa.table({"key": s.key[row], "span": shown_span, "doc": doc[row], "near": s.near[row]})


def _by_number(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the keys that occur once, and of those that occur more often."""
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    more = np.append(same, False) | np.append(False, same) if len(key) else np.zeros(0, bool)
    return order[~more], order[more]


def compared(table: pa.Table, crowd: int) -> dict[str, np.ndarray]:
    """Offers of whole minimisers -> what buckets have to know of them, columns as _FOUND has them."""
    key, sent, doc, near = (_numbers(table, c) for c in ("key", "span", "doc", "near"))
    alone, several = _by_number(key)
    matter = np.concatenate([alone[(sent[alone] & (_MORE | _HOT)) > 0], several])
    if not len(matter):
        return {"key": matter, "span": matter, "doc": matter, "first": matter, "kind": matter.astype(np.int32)}
    key, sent, doc, near = key[matter], sent[matter], doc[matter], near[matter]
    span = sent & ~_MORE
    order, new_span = _sorted_by(doc, span, key)
    key, span, doc, near, more = key[order], span[order], doc[order], near[order], (sent[order] & _MORE) > 0
    new_key = np.append(True, key[1:] != key[:-1])
    at, group = np.flatnonzero(new_key), np.cumsum(new_key) - 1
    several = (np.maximum.reduceat(doc, at) != np.minimum.reduceat(doc, at)) | np.logical_or.reduceat(more, at)
    spans = np.add.reduceat(new_span.astype(np.int64), at)
    crowded = (spans > crowd) | np.logical_or.reduceat(span == _HOT, at)
    heads = np.flatnonzero(new_span)
    first = doc[heads][np.cumsum(new_span) - 1]
    # first holders of spans that agree with another one of their minimiser on the left or the right
    some = heads[(several & ~crowded & (spans > 1))[group[heads]]]
    asked = np.zeros(len(key), bool)
    for half in (near[some] >> 8 & 0xFF, near[some] & 0xFF):
        by = np.lexsort((half, key[some]))
        same = (key[some][by][1:] == key[some][by][:-1]) & (half[by][1:] == half[by][:-1])
        asked[some[by]] |= np.append(same, False) | np.append(False, same)
    kind = np.where(crowded[group], _CROWDED, np.where(asked, _ASKED, _EQUAL))
    # the first holder's own bucket needs the row only if it has another holder, or windows to be decided
    stays = crowded[group] | several[group] & ((doc > first) | more | asked)
    return {"key": key[stays], "span": span[stays], "doc": doc[stays], "first": first[stays], "kind": kind[stays].astype(np.int32)}


def shown(table: pa.Table, requests: pa.Table, length: int) -> pa.Table:
    """(key, span, doc, bytes) of the spans that are asked for, and of each distinct window of crowded minimisers, which stands for itself."""
    schema = pa.schema([("key", pa.int64()), ("span", pa.int64()), ("doc", pa.int64()), ("bytes", pa.binary())])
    if not table.num_rows or not requests.num_rows:
        return schema.empty_table()
    rk, rs, first, kind = (_numbers(requests, c) for c in ("key", "span", "first", "kind"))
    crowded, asked = np.unique(rk[kind == _CROWDED]), kind == _ASKED
    own = _Bucket(table, length, None if len(crowded) else np.unique(first[asked]))
    s = own.spans
    maybe = np.flatnonzero(np.isin(s.key, rk[asked]))
    order, new = _sorted_by(maybe, own.doc[maybe], s.span[maybe], s.key[maybe])
    maybe = maybe[order[new]]
    at = _find([s.key[maybe], s.span[maybe], own.doc[maybe]], [rk[asked], rs[asked], first[asked]])
    mine = maybe[at[at >= 0]]
    w, doc, code, begin = own.windows_of(crowded)
    heads = np.unique(begin)
    start, size = np.concatenate([s.first[mine], w[heads]]), np.concatenate([s.many[mine] - 1 + length, np.full(len(heads), length)])
    columns = [np.concatenate(x) for x in ((s.key[mine], code[heads]), (s.span[mine], np.full(len(heads), _HOT)), (own.doc[mine], doc[heads]))]
    batches = []
    for a in range(0, len(start), 1 << 18):
        part = slice(a, a + (1 << 18))
        offsets = np.concatenate([[0], np.cumsum(size[part])]).astype(np.int32)
        text = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(own.data[_runs(start[part], size[part])].tobytes())])
        batches.append(pa.RecordBatch.from_arrays([*(pa.array(c[part]) for c in columns), text], schema=schema))
    return pa.Table.from_batches(batches, schema)


def decided(table: pa.Table, length: int) -> dict[str, np.ndarray]:
    """Spans of whole minimisers, or equal windows -> (key, span, doc, mask): which windows of a span start in an earlier document too."""
    key, span, doc = (_numbers(table, c) for c in ("key", "span", "doc"))
    texts = table.column("bytes").to_pylist()
    sizes = np.array([len(t) for t in texts], np.int64)
    base = np.cumsum(sizes) - sizes
    windows = sizes - length + 1
    who, at = np.repeat(np.arange(len(texts)), windows), _runs(base, windows)
    order, classes = suffix_classes(np.frombuffer(b"".join(texts), np.uint8), at, length)
    new = np.append(True, classes[1:] != classes[:-1])
    least = np.minimum.reduceat(doc[who[order]], np.flatnonzero(new))[np.cumsum(new) - 1]
    taken = order[least < doc[who[order]]]
    mask = np.zeros(len(texts), np.int64)
    np.bitwise_or.at(mask, who[taken], np.int64(1) << (at - base[who])[taken])
    hit = mask != 0
    return {"key": key[hit], "span": span[hit], "doc": doc[hit], "mask": mask[hit]}


def removed(own: _Bucket, verdicts: pa.Table, length: int) -> np.ndarray:
    """Which bytes of the bucket go."""
    s = own.spans
    rk, rs, rd, kind = (_numbers(verdicts, c) for c in ("key", "span", "doc", "kind"))
    mask = verdicts.column("mask").fill_null(0).to_numpy().astype(np.int64)
    crowded, lost_windows = rk[(mask == 0) & (kind == _CROWDED)], rk[(mask != 0) & (rs == _HOT)]
    of_span, of_mask = (mask == 0) & (kind != _CROWDED), (mask != 0) & (rs != _HOT)
    maybe = np.flatnonzero(np.isin(s.key, rk[of_span]))
    at = _find([rk[of_span], rs[of_span]], [s.key[maybe], s.span[maybe]])
    maybe, first = maybe[at >= 0], rd[of_span][at[at >= 0]]
    lost, held = maybe[first < own.doc[maybe]], maybe[first == own.doc[maybe]]
    at = _find([rk[of_mask], rs[of_mask], rd[of_mask]], [s.key[held], s.span[held], own.doc[held]])
    held, bits = held[at >= 0], mask[of_mask][at[at >= 0]]
    row, offset = np.nonzero(np.unpackbits(bits.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    w, doc, code, begin = own.windows_of(crowded)
    gone = (doc > doc[begin]) | np.isin(code, lost_windows)
    starts = np.concatenate([s.first[lost], s.first[held[row]] + offset, w[gone]])
    ends = np.concatenate([s.first[lost] + s.many[lost] - 1, s.first[held[row]] + offset, w[gone]]) + length
    n = len(own.data) + 1
    return np.cumsum(np.bincount(starts, minlength=n) - np.bincount(ends, minlength=n))[:-1] > 0


def _whole_keys(of: Callable[[pa.Table], dict[str, np.ndarray]]):
    """of() for a task that has all rows of its keys; in pieces, as a table of the result's size may be large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        del parts
        out = of(table)
        del table
        for a in range(0, len(out["key"]), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(x[a : a + (1 << 17)]) for x in out.values()], names=list(out))

    return lean(run)


def cut_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), local: int = LOCAL, crowd: int = CROWD) -> DataFrame:
    """(doc_id, text, n_bytes, n_removed, n_spans, kept_sha256 [, keep...]): one row for each row of docs.

    Each byte goes that a string of `length` bytes covers which also starts in
    a document with a smaller doc_id; strings are judged on the input. text:
    what is left, less characters that were cut in two; null if it was null. A
    null id counts as larger than all others. Rows of one id are one document's
    parts: neither is earlier, and matches don't cross them. No rows: no rows.
    """
    if not GRAM <= length <= GRAM + 62:
        raise ValueError(f"length: {GRAM} to {GRAM + 62}")
    last = (1 << 63) - 1
    spark = docs.sparkSession
    plain = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(last)).alias("doc_id"), whole(F.col(text_col)).alias("text"))
    total = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / BUCKET))
    # a minimiser a dozen bytes: this many to a task of the first pass
    n_tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / (16 << 20)))

    def bucket_of(c: str):
        return F.pmod(F.xxhash64(c), F.lit(n_buckets)).cast("int")

    plain = plain.withColumn("b", bucket_of("doc_id"))

    def offer(table: pa.Table) -> pa.Table:
        release()
        return offered(_Bucket(table, length, with_near=True), local)

    offers = plain.groupBy("b").applyInArrow(offer, "key long, span long, doc long, near short")
    found = offers.repartition(n_tasks, "key").mapInArrow(_whole_keys(lambda t: compared(t, crowd)), _FOUND)
    found = staged(found.withColumn("b", bucket_of("doc")))

    def show(table: pa.Table, requests: pa.Table) -> pa.Table:
        release()
        return shown(table, requests, length)

    requests = found.filter((F.col("kind") == _CROWDED) | (F.col("kind") == _ASKED) & (F.col("doc") == F.col("first"))).select("b", "key", "span", "first", "kind")
    spans = plain.groupBy("b").cogroup(requests.groupBy("b")).applyInArrow(show, "key long, span long, doc long, bytes binary")
    masks = staged(spans.repartition(n_tasks, "key").mapInArrow(_whole_keys(lambda t: decided(t, length)), "key long, span long, doc long, mask long"))
    verdicts = found.select("b", "key", "span", F.col("first").alias("doc"), "kind", F.lit(None).cast("long").alias("mask"))
    verdicts = verdicts.unionByName(masks.withColumn("b", bucket_of("doc")).withColumn("kind", F.lit(_ASKED)))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(last)).alias("doc_id"), whole(F.col(text_col)).alias("text"), F.col(id_col).cast("long").alias("own_id"), F.col(text_col).isNull().alias("was_null"), *keep).withColumn("b", bucket_of("doc_id"))

    def cut(table: pa.Table, right: pa.Table) -> pa.Table:
        release()
        own = _Bucket(table, length)
        gone = removed(own, right, length)
        out = []
        for t, a, null in zip(own.texts, own.starts.tolist(), table.column("was_null").to_pylist(), strict=True):
            mine = gone[a : a + len(t)]
            n = int(np.count_nonzero(mine))
            left_over = own.data[a : a + len(t)][~mine].tobytes() if n else t
            runs = int(mine[0]) + int((mine[1:] & ~mine[:-1]).sum()) if n else 0
            out.append((None if null else left_over.decode(errors="ignore"), len(t), n, runs, hashlib.sha256(left_over).hexdigest()))
        made = {name: pa.array([r[n] for r in out], kind) for n, (name, kind) in enumerate((("text", pa.string()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())))}
        return pa.table({"doc_id": table.column("own_id"), **made, **{c: table.column(c) for c in keep}})

    kept_schema = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return rows.groupBy("b").cogroup(verdicts.groupBy("b")).applyInArrow(cut, "doc_id long, text string, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + kept_schema)
