"""Best-fit-decreasing packing of token sequences, exact over the whole corpus.

Best fit decreasing looks at lengths only, and there are at most `capacity`
different ones. So the corpus is counted by length, the driver runs best fit
decreasing on those counts (a segment tree over remaining capacities finds the
tightest open class of bins in logarithmic time), and its plan says for each
length which of its pieces, by rank, go to which bins at which offset. Ranks
are dealt by (length, partition), so a length that a third of all pieces share
is no task's burden. The result is what one machine would make of all pieces.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickloom.llm.common import documents, lean, settled
from clickloom.llm.units import Encoded, slices

#: How the word vocabulary cuts a text that is composed (NFC) and in lower case.
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\t-\r \x85\xa0  -     　\p{L}\p{N}]+")
#: Words whose ids a Python worker keeps; beyond, it starts anew.
CACHE = 300_000


class WordEncoder:
    """The ids that the tokenizers library gives, each distinct word asked for once.

    The vocabulary's normalizer and splitter are context-free at white space,
    so words can be looked up alone.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        _as_known(whole)
        self.model = whole.model
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        odd = [b for b in range(256) if b not in set(plain)]
        self.letters = {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(odd)}
        self.known: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            letters = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.letters)
            found = self.known[word] = np.array([t.id for t in self.model.tokenize(letters)], "<u4").tobytes()
        return found

    def slice(self, texts: list[str]) -> Iterator[memoryview]:
        """The ids of each text, little-endian and unsigned."""
        enc = Encoded([normal(t).encode() for t in texts], glue=False)
        word, cut = self.word, _WORDS.findall
        ids, at = enc.gather([b"".join(map(word, cut(u.decode()))) for u in enc.distinct])
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield ids[a:b]


def normal(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # letter by letter, so no final sigma
    return text.lower()


#: Texts that tell how a vocabulary's file normalizes and cuts.
_PROBES = ("Ab CD's  it'S 12a3\n\t x", "É e\u0301 ΑΣ Σ İ ǅ ﬁ Å", "a\u00a0b\u3000c!?. ...x_y-z", "'re'm 中文12 ½ ²x \x1c\x85 ")


def _as_known(tokenizer) -> None:
    """Raises ValueError for a vocabulary whose normalizer or splitter isn't what normal() and _WORDS do."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in set(plain)]
    letters = {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(odd)}
    for text in _PROBES:
        made = tokenizer.normalizer.normalize_str(text) if tokenizer.normalizer else text
        cut = [w for w, _ in tokenizer.pre_tokenizer.pre_tokenize_str(made)] if tokenizer.pre_tokenizer else [made]
        if cut != [w.encode().decode("latin-1").translate(letters) for w in _WORDS.findall(normal(text))]:  # white space doesn't reach a word
            raise ValueError("the vocabulary normalizes or cuts texts in another way than this encoder")


@lru_cache(1)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


class Capacities:
    """A segment tree over remaining capacities 0..top with the number of open bins of each."""

    def __init__(self, top: int):
        self.leaves = 1 << top.bit_length()
        self.sums = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        at = capacity + self.leaves
        while at:
            self.sums[at] += n
            at >>= 1

    def tightest(self, least: int) -> int:
        """The smallest capacity of at least `least` with an open bin, or -1."""
        at = least + self.leaves
        if self.sums[at]:
            return least
        while at > 1:
            if not at & 1 and self.sums[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.sums[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return -1


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Best fit decreasing of counts[length] pieces: rows (length, rank, n, bin, per_bin, offset).

    Row: from that rank on, n pieces of that length go to bins from `bin` on,
    per_bin to each, the first at that offset. Pieces of one length are alike,
    so a bin that is tightest stays so until it is full for that length; whole
    classes of equal bins are hence filled at a time.
    """
    tree = Capacities(capacity)
    free: dict[int, list[tuple[int, int]]] = {}  # remaining capacity -> runs (first bin, number of bins)
    rows, bins = [], 0

    def keep(left: int, first: int, n: int) -> None:
        if left and n:
            free.setdefault(left, []).append((first, n))
            tree.add(left, n)

    for length in sorted(counts, reverse=True):
        rest, rank = counts[length], 0
        while rest:
            room = tree.tightest(length)
            if room < 0:
                room, per = capacity, capacity // length
                first, n = bins, -(-rest // per)
                bins += n
            else:
                per = room // length
                first, there = free[room].pop()
                n = min(there, -(-rest // per))
                tree.add(room, -there)
                keep(room, first + n, there - n)
            put = min(rest, n * per)
            rows.append((length, rank, put, first, per, capacity - room))
            full = put // per
            keep(room - per * length, first, full)
            if put % per:
                keep(room - put % per * length, first + full, 1)
            rank, rest = rank + put, rest - put
    return np.array(rows, np.int64).reshape(-1, 6)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local long"


def pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids and end_id, cut at `capacity`: (doc_id, piece, start, length, ids_crc32, part, local [, ids]).

    part and local: the partition that made the piece, and its rank there among
    pieces of its length. A null text is an empty one: the end id alone.
    """
    end = np.array([end_id], "<u4").tobytes()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = encoder(path), TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for batch in batches:
            docs_ids = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices([t.encode() for t in texts]):
                rows: list[tuple] = []
                for doc, ids in zip(docs_ids[a:b], own.slice(texts[a:b]), strict=True):
                    whole = bytes(ids) + end
                    for n, at in enumerate(range(0, len(whole), 4 * capacity)):
                        cut = whole[at : at + 4 * capacity]
                        length = len(cut) // 4
                        local = seen[length] = seen.get(length, -1) + 1
                        rows.append((doc, n, at // 4, length, zlib.crc32(cut), part, local, cut))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local"]
                if keep_ids:
                    columns.append(pa.array([np.frombuffer(r[7], "<u4").astype(np.int32) for r in rows], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return documents(docs, id_col, text_col).mapInArrow(lean(of), PIECES + (", ids array<int>" if keep_ids else ""))


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """pieces() with sequence_id and offset: packed into as few sequences of `capacity` as best fit decreasing finds.

    No document: no row. Repeated rows are packed as often as they occur. What
    reaches the driver is a count for each length, `capacity` numbers at most;
    the plan that goes back has a row for each class of bins that a length met.
    """
    made = settled(pieces(docs, path, capacity, end_id, keep_ids, id_col, text_col))
    counted = settled(made.groupBy("length", "part").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    steps = plan(counts, capacity)
    upto = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counted.select(F.col("length").alias("of_length"), F.col("part").alias("of_part"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"))
    ranked = made.join(base, (F.col("length") == F.col("of_length")) & (F.col("part") == F.col("of_part")))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]
    ranked = ranked.select((F.col("base") + F.col("local")).alias("rank"), *columns)
    # (length, rank) as one number that grows with both, to be looked up in order
    order = np.lexsort((steps[:, 1], steps[:, 0])) if len(steps) else np.zeros(0, np.int64)
    steps = steps[order]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = {int(k): int(n) for k, n in zip(*np.unique(steps[:, 0], return_index=True), strict=True)}
        lasts = {int(k): int(n) for k, n in zip(steps[:, 0], range(1, len(steps) + 1), strict=True)}
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            length = batch.column("length").to_numpy()
            at = np.zeros(len(rank), np.int64)
            for k in np.unique(length).tolist():
                mine = length == k
                at[mine] = firsts[k] + np.searchsorted(steps[firsts[k] : lasts[k], 1], rank[mine], side="right") - 1
            _, first_rank, _, first_bin, per, offset = steps[at].T
            within = rank - first_rank
            extra = [pa.array(first_bin + within // per), pa.array(offset + within % per * length)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *extra], names=[*columns, "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, " + "ids array<int>, " * keep_ids + "sequence_id long, offset long"
    return ranked.mapInArrow(lean(place), schema)
