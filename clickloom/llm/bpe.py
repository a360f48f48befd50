"""Byte-level BPE by replaying merges over a whole slice of the corpus at once.

An inverted index leads from each mergeable pair to the places where it stands
in any distinct word of the slice. Places are merged in rank order, and only the
two neighbours of a merged place are looked at again. A word's merges happen
exactly in the order in which encoding it alone would do them: lowest rank
first, leftmost among equals. Words don't touch each other, so short words each
take their next merge in the same step. Long words are taken by rank, from a
heap: where a merge opens a pair of no higher rank, the word's other places of
the present rank wait until that one is done.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from clickloom.llm.common import documents, lean
from clickloom.llm.units import Encoded, slices

#: Unicode's White_Space, which is what \s means to the encoder's own engine.
WHITE = r"\t-\r \x85\xa0  -     　"
_WIDE_WHITE = regex.compile(r"[\x85\xa0  -     　]")
#: Code points that the regex module knows as letters or numbers, but the encoder's engine (Unicode 16) does not.
_LATER = """
558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959
10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3
16FF2-16FF3 16FF4-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168
1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4
1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F
"""
_AS_SYMBOL = {n: "\u2020" for a, _, b in (x.partition("-") for x in _LATER.split()) for n in range(int(a, 16), int(b or a, 16) + 1)}
_HAS_LATER = regex.compile("[" + "".join(f"{chr(int(a, 16))}-{chr(int(b or a, 16))}" for a, _, b in (x.partition("-") for x in _LATER.split())) + "]")
#: Bytes of the longest words that are replayed side by side; the rank of what is no pair.
SHORT, NO_PAIR = 40, 1 << 30


@lru_cache(1)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(1)
def compile_pattern(pattern: str) -> regex.Pattern:
    return regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]"))


class Replay:
    """The mergeable pairs, as left << 32 | right, and their ranks: every way to cut a token into two tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        self.token = {r: t for t, r in ranks.items()}
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.pairs = {ranks[t[:k]] << 32 | ranks[t[k:]]: r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self.keys = np.array([*sorted(self.pairs), np.iinfo(np.int64).max], np.int64)
        self.key_ranks = np.array([*(self.pairs[k] for k in self.keys[:-1].tolist()), NO_PAIR], np.int64)
        self.tokens, self.token_ranks = pa.array(ranks.keys(), pa.large_binary()), np.array(list(ranks.values()), np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Of each pair, NO_PAIR if it can't be merged."""
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.key_ranks[at], NO_PAIR)

    def encode(self, words: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and how many each word has. A word that is a token is that token."""
        place = pc.index_in(words, value_set=self.tokens).to_numpy(zero_copy_only=False)
        sizes = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        single = ~np.isnan(place)
        counts = single.astype(np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = [(np.flatnonzero(single), self.token_ranks[place[single].astype(np.int64)])]
        for some, replay in ((~single & (sizes > 0) & (sizes <= SHORT), self._side_by_side), (~single & (sizes > SHORT), self._by_heap)):
            numbers = np.flatnonzero(some)
            if len(numbers):
                taken = words.take(pa.array(numbers))
                start = np.frombuffer(taken.buffers()[2], np.uint8)[: sizes[numbers].sum()]
                ids, of = replay(self.of_byte[start], np.repeat(np.arange(len(numbers)), sizes[numbers]))
                parts.append((numbers[of], ids))
                counts[numbers] = np.bincount(of, minlength=len(numbers))
        of, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
        return ids[np.argsort(of, kind="stable")], counts

    def _side_by_side(self, ids: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of SHORT bytes at most: (ids, word of each). All go on at once, each with its first place in the index by (rank, place)."""
        n = len(ids)
        new = np.append(True, word[1:] != word[:-1])
        after = np.where(np.append(new[1:], True), n, np.arange(1, n + 1))
        before = np.where(new, n, np.arange(-1, n - 1))
        ids = np.append(ids, -1)
        after, before, alive = np.append(after, n), np.append(before, n), np.ones(n + 1, bool)
        rank = np.append(np.where(after[:n] < n, self._rank(ids[:n], ids[after[:n]]), NO_PAIR), NO_PAIR)
        live, first = np.arange(n), np.flatnonzero(new)  # places in words that still have a pair, and where each word's begin
        while len(live):
            best = np.minimum.reduceat(rank[live] << 32 | live, first)
            goes_on = best < NO_PAIR << 32
            best = best[goes_on]
            p = best & 0xFFFFFFFF
            q = after[p]
            r = after[q]
            ids[p], alive[q], after[p], before[r] = best >> 32, False, r, p
            rank[p] = np.where(r < n, self._rank(ids[p], ids[r]), NO_PAIR)
            b = before[p]
            touched = b < n
            rank[b[touched]] = self._rank(ids[b[touched]], ids[p[touched]])
            stays = np.repeat(goes_on, np.diff(np.append(first, len(live)))) & alive[live]
            live = live[stays]
            first = np.flatnonzero(np.append(True, word[live[1:]] != word[live[:-1]])) if len(live) else live
        left = np.flatnonzero(alive[:n])
        return ids[left], word[left]

    def _by_heap(self, start: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of any length: (ids, word of each). Ranks are taken from a heap, and each place of a rank is merged in turn."""
        ids, word, size = [*start.tolist(), -1], [*numbers.tolist(), -1], len(start)
        after, before = list(range(1, size + 1)), list(range(-1, size))
        index = self._index(start, numbers)
        heap = sorted(index)
        get = self.pairs.get
        while heap:
            rank = heappop(heap)
            places = index.pop(rank, None)
            if places is None:
                continue
            places.sort()
            waits = -1
            for p in places:
                left = ids[p]
                if left < 0:
                    continue
                q, own = after[p], word[p]
                if word[q] != own or get(left << 32 | ids[q]) != rank:
                    continue
                if own == waits:
                    if rank not in index:
                        index[rank] = []
                        heappush(heap, rank)
                    index[rank].append(p)
                    continue
                ids[p], ids[q] = rank, -1
                after[p] = nxt = after[q]
                before[nxt] = p
                prv = before[p]
                if word[nxt] == own and (r := get(rank << 32 | ids[nxt])) is not None:
                    if r not in index:
                        index[r] = []
                        heappush(heap, r)
                    index[r].append(p)
                    if r <= rank:
                        waits = own
                if word[prv] == own and (r := get(ids[prv] << 32 | rank)) is not None:
                    if r not in index:
                        index[r] = []
                        heappush(heap, r)
                    index[r].append(prv)
                    if r <= rank:
                        waits = own
        final = np.array(ids[:-1])
        left = np.flatnonzero(final >= 0)
        return final[left], numbers[left]

    def _index(self, ids: np.ndarray, word: np.ndarray) -> dict[int, list[int]]:
        """Rank of a pair -> the places where it stands."""
        ranks = np.where(word[:-1] == word[1:], self._rank(ids[:-1], ids[1:]), NO_PAIR)
        place = np.flatnonzero(ranks < NO_PAIR)
        order = np.argsort(ranks[place], kind="stable")
        distinct, first = np.unique(ranks[place][order], return_index=True)
        return {r: part.tolist() for r, part in zip(distinct.tolist(), np.split(place[order], first[1:]), strict=True)} if len(distinct) else {}


class Codec:
    """Encodes slices of documents, each distinct word of a slice once."""

    def __init__(self, path: str, pattern: str):
        self.replay = Replay(load_ranks(path))
        self.pattern = compile_pattern(pattern)
        tokens = [self.replay.token.get(r, b"") for r in range(max(self.replay.token) + 1)]
        self.bytes_of, self.decimal_of = pa.array(tokens, pa.large_binary()), pa.array([b"%d," % r for r in range(len(tokens))], pa.large_binary())

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in text order, and where each text's begin (and the end)."""
        # white space beyond ASCII may stand beside a blank, where texts are cut: such a text stays in one piece
        odd = np.array([not t.isascii() and _WIDE_WHITE.search(t) is not None for t in texts], bool)
        enc = Encoded([t.encode() for t in texts], glue=True, uncut=odd)
        find, words, sizes = self.pattern.findall, [], []
        for unit in enc.distinct:
            text = unit.decode()
            found = find(text)
            if not text.isascii() and _HAS_LATER.search(text):
                found = [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(_AS_SYMBOL))]
            words += found
            sizes.append(len(found))
        coded = pc.dictionary_encode(pa.array(words, pa.large_utf8()).cast(pa.large_binary()))
        ids, counts = self.replay.encode(coded.dictionary)
        # from distinct words to words of distinct units, to units of texts
        ids, offsets = _spread(ids, counts, coded.indices.to_numpy(zero_copy_only=False))
        ends = offsets[np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))])]
        ids, offsets = _spread(ids, np.diff(ends), enc.codes)
        return ids, offsets[enc.doc_at]

    def slice(self, texts: list[str]) -> Iterator[tuple[np.ndarray, memoryview, memoryview]]:
        """For each text: its ids, these as decimals each followed by a comma, the bytes decoded from them."""
        ids, at = self.ids(texts)
        decimal, d = _joined(self.decimal_of, ids, at)
        back, b = _joined(self.bytes_of, ids, at)
        for n in range(len(texts)):
            yield ids[at[n] : at[n + 1]], decimal[d[n] : d[n + 1]], back[b[n] : b[n + 1]]


def _spread(values: np.ndarray, counts: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of values (counts[k] of run k) that codes names, one after the other, and where each begins (and the end)."""
    first = np.cumsum(counts) - counts
    sizes = counts[codes]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    return values[np.arange(offsets[-1]) + np.repeat(first[codes] - offsets[:-1], sizes)], offsets


def _joined(of: pa.LargeBinaryArray, ids: np.ndarray, at: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """What `of` has for each id, joined, and the offsets of the ids `at`."""
    taken = of.take(pa.array(ids))
    offsets = np.frombuffer(taken.buffers()[1], np.int64)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
    return memoryview(taken.buffers()[2] or b""), offsets[at]


@lru_cache(1)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded string): each whole text encoded, and its ids decoded again. Null texts count as empty."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices([t.encode() for t in texts]):
                rows = [(ids, bytes(back).decode()) for ids, _, back in own.slice(texts[a:b])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.string())], names=["doc_id", "ids", "decoded"])

    return documents(docs, id_col, text_col).mapInArrow(lean(of), "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode() with digests in place of ids and texts: doc_id, n_tokens, ids_sha256, decoded_sha256.

    One row for each row of docs, repeated and null ids as they are; no rows for
    none. Nothing is shuffled: a slice's words are replayed in the task that
    reads them.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices([t.encode() for t in texts]):
                rows = [(len(ids), hashlib.sha256(d[:-1] if len(d) else b"").hexdigest(), hashlib.sha256(back).hexdigest()) for ids, d, back in own.slice(texts[a:b])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string())))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents(docs, id_col, text_col).mapInArrow(lean(of), SCHEMA)
