"""SimHash near-duplicates, found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits, the last
padded to 23. The binary Golay code [23,12] is perfect: each word lies within
distance 3 of exactly one codeword. If two words differ in at most one bit and
decode to different codewords, both lie at distance 3 from their own and at
distance 4 from the other's. So the codeword of one word is always among the
codewords within distance 4 of the other, looked at only when its own is at
distance 3: one key, or six.

At most three differing bits over three segments leave two segments with at
most one each (two segments with two or more would make four). A join on the
codeword indices of each pair of segments (24 bits) hence misses no link. One
side of the join carries the plain pair of indices, the other up to 36 pairs,
and the join's condition verifies the Hamming distance, so only true links
leave it. Copies never meet: the join is over distinct fingerprints.

Near copies by similarity (0.8 of five-word shingles) lie 5 to 14 of 64 bits
apart, further than Golay keys reach at a bearable number of keys. For them
`near_copies_left` proposes by another key, equal samples of shingles: the
SAMPLED least under each of SAMPLES permutations. What meets is compared by a
sketch of bounded size: the set of its shingles itself for a short text, a wide
SimHash (one 64-bit fingerprint for each of PARTS parts of the shingles) for a
long one, with a limit that a pair of similarity 0.8 seldom misses. Within a key
documents are united, not paired: they are joined to the closest one of those
joined before, so as many links come of a key as it has documents at most. Keys
of more than BLOCK documents are united in random blocks first, and then all
members that this leaves apart meet, each pair of blocks in a task of its own.

Every link that comes of this, or of Golay keys, is then verified on the whole
sets of shingles, and goes if they are less similar than 0.8. Where one goes,
its keys are united anew without it, ROUNDS times at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import documents, lean, settled, staged
from clickloom.llm.graph import components

#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 generates the code.
GENERATOR = 0b101011100011
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Keys of a document, shingles in each; parts of a wide fingerprint.
SAMPLES, SAMPLED, PARTS = 16, 4, 16
#: Similarity of near copies, as a fraction.
ALIKE = (8, 10)
#: Distinct shingles up to which a sketch holds the set, and from which on it holds the wide fingerprint; texts of fewer
#: than WIDE_FROM and of more than SET_UPTO shingles aren't 0.8 alike.
SET_UPTO, WIDE_FROM = 39, 32
#: Sets of similarity s have the cosine 2s / (1 + s), and so this share of differing bits: 0.151 at 0.8. The wide
#: fingerprint's estimate has a standard error of 0.011, by three of which the limit is wider.
LIMIT = math.acos(2 * 0.8 / 1.8) / math.pi + 3 * 0.011
#: How often links are proposed and verified; how many of its closest a document is proposed to be linked with, from the second time on.
ROUNDS, FORESTS = 3, 8
#: Documents of a key that are united in one go.
BLOCK = 2000
_ODD = np.random.default_rng(9).integers(0, 1 << 63, SAMPLES, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _remainder(words: np.ndarray) -> np.ndarray:
    out = words.astype(np.int64)
    for bit in range(22, 10, -1):
        out = np.where(out >> bit & 1, out ^ (GENERATOR << (bit - 11)), out)
    return out


@cache
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By syndrome: the weight of its error, its error of least weight, and the five of weight 4 (if its own has 3)."""
    near = np.zeros(2048, np.int64)
    weight = np.full(2048, -1, np.int64)
    far: list[list[int]] = [[] for _ in range(2048)]
    for n in range(5):
        errors = np.array([sum(1 << b for b in bits) for bits in combinations(range(23), n)], np.int64)
        for syndrome, error in zip(_remainder(errors).tolist(), errors.tolist(), strict=True):
            if n < 4:
                near[syndrome], weight[syndrome] = error, n
            elif weight[syndrome] == 3:
                far[syndrome].append(error)
    return weight, near, np.array([x or [0] * 5 for x in far], np.int64)


def segment_keys(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each segment of uint64 fingerprints: the index of the nearest codeword, and six indices, -1 where there are fewer."""
    weight, near, far = golay()
    out = []
    for start, length in SEGMENTS:
        word = (fps >> np.uint64(start) & np.uint64((1 << length) - 1)).astype(np.int64)
        syndrome = _remainder(word)
        own = (word ^ near[syndrome]) >> 11
        others = np.where((weight[syndrome] == 3)[:, None], (word[:, None] ^ far[syndrome]) >> 11, -1)
        out.append((own, np.concatenate([own[:, None], others], axis=1)))
    return out


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included; of the whole sequence if it is shorter; none without words."""
    words = text.lower().split()  # of bytes: A-Z only, and the six ASCII spaces
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, 42)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)), np.uint64)


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes set each bit."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # a very long text in bounded memory
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return ones


def majority(hashes: np.ndarray) -> int:
    return int(np.packbits(_ones(hashes) * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, shingle: int) -> int:
    return majority(shingle_hashes(text, shingle))


def wide_fingerprint(distinct: np.ndarray) -> np.ndarray:
    """PARTS fingerprints of distinct shingle hashes, dealt into parts by another hash of theirs; 0 for an empty part."""
    part = (distinct * _MIX) >> np.uint64(64 - PARTS.bit_length() + 1)
    order = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[order], np.arange(PARTS + 1))
    dealt = distinct[order]
    return np.array([majority(dealt[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], np.uint64)


def sample_keys(distinct: np.ndarray) -> np.ndarray:
    """A hash of each sample of distinct shingle hashes; no samples of nothing."""
    if not len(distinct):
        return np.zeros(0, np.int64)
    least = np.zeros((SAMPLES, 0), np.uint64)
    for at in range(0, len(distinct), 1 << 14):
        x = distinct[None, at : at + (1 << 14)] * _ODD[:, None]
        x ^= x >> np.uint64(32)
        x *= _MIX
        x = np.concatenate([least, x], axis=1)
        least = np.partition(x, SAMPLED - 1, axis=1)[:, :SAMPLED] if x.shape[1] > SAMPLED else x
    least.sort(axis=1)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), n) for n, row in enumerate(least)], np.uint64).view(np.int64)


def sketch(distinct: np.ndarray) -> bytes:
    """The number of distinct shingles, the least 32 bits of each if they are few, the wide fingerprint if they are many."""
    n = len(distinct)
    own = np.sort(distinct.astype(np.uint32)).tobytes() if n <= SET_UPTO else b""
    return n.to_bytes(4, "little") + own + (wide_fingerprint(distinct).tobytes() if n >= WIDE_FROM else b"")


class Sketches:
    """Sketches as arrays: numbers of shingles, sets (filled up with a number of their own), wide fingerprints (zero if there is none)."""

    def __init__(self, sketches: list[bytes]):
        self.n = np.array([int.from_bytes(x[:4], "little") for x in sketches], np.int64)
        self.sets = np.full((len(sketches), SET_UPTO), 1 << 32, np.int64)
        self.wide = np.zeros((len(sketches), PARTS), np.uint64)
        for k, (x, n) in enumerate(zip(sketches, self.n.tolist(), strict=True)):
            if n <= SET_UPTO:
                self.sets[k, :n] = np.frombuffer(x, np.uint32, n, 4)
            if n >= WIDE_FROM:
                self.wide[k] = np.frombuffer(x, np.uint64, PARTS, len(x) - 8 * PARTS)

    def take(self, rows: np.ndarray) -> Sketches:
        out = Sketches([])
        out.n, out.sets, out.wide = self.n[rows], self.sets[rows], self.wide[rows]
        return out

    def distances(self, one: int, others: np.ndarray) -> np.ndarray:
        """The share of a wide fingerprint's bits in which others differ from one: estimated by it, or as their sets say; infinite if they aren't alike."""
        n, m = self.n[one], self.n[others]
        out = np.full(len(others), np.inf)
        small = (m <= SET_UPTO) & (n <= SET_UPTO)
        if small.any():
            both = np.isin(self.sets[others[small]], self.sets[one, :n]).sum(1)
            cosine = 2 * both / np.maximum(1, n + m[small])
            out[small] = np.where(ALIKE[1] * both >= ALIKE[0] * (n + m[small] - both), np.arccos(np.minimum(1.0, cosine)) / np.pi, np.inf)
        large = (m >= WIDE_FROM) & (n >= WIDE_FROM) & ~small
        if large.any():
            a, b = self.wide[one], self.wide[others[large]]
            share = np.bitwise_count(a ^ b).sum(-1, dtype=np.int64) / (64 * np.maximum(1, ((a | b) != 0).sum(-1)))  # parts that both lack don't count
            out[large] = np.where(share <= LIMIT, share, np.inf)
        return out


def united(sketches: Sketches, label: np.ndarray | None = None, side: np.ndarray | None = None, banned: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
    """The closest links that join all that are alike, directly or by others, beyond what equal labels say is joined already: a minimum spanning forest, grown from one document on.

    With sides 0 and 1 only links from one side to the other are looked for.
    banned: for each document those that it isn't to be linked with.
    """
    n = len(sketches.n)
    label = np.arange(n) if label is None else np.unique(label, return_inverse=True)[1]
    if n < 2 or (label == label[0]).all():
        return []
    order = np.argsort(label, kind="stable")
    begin = np.searchsorted(label[order], np.arange(n + 1))
    away, nearest, source = np.ones(n, bool), np.full(n, np.inf), np.zeros(n, np.int64)
    found: list[tuple[int, int]] = []
    for _ in range(n):
        now = int(np.where(away, nearest, np.inf).argmin())
        if not away[now]:  # all that are left are infinitely far
            now = int(away.argmax())
        if 0 <= nearest[now] < np.inf:
            found.append((int(source[now]), now))
        away[now] = False
        mates = order[begin[label[now]] : begin[label[now] + 1]]
        nearest[mates] = -1.0  # joined already, next in turn without a link
        others = np.flatnonzero(away & (label != label[now]) if side is None else away & (label != label[now]) & (side != side[now]))
        if len(others):
            distance = sketches.distances(now, others)
            if banned is not None and len(banned[now]):
                distance[np.isin(others, banned[now])] = np.inf
            closer = distance < nearest[others]
            nearest[others[closer]], source[others[closer]] = distance[closer], now
    return found


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id long, fp long): the SimHash of each row's whole text. Null and wordless texts: 0."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t or b"", shingle) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return documents(docs, id_col, text_col).mapInArrow(lean(of), "doc_id long, fp long")


def links(fps: DataFrame, bits: int = 3) -> DataFrame:
    """Distinct (u, v), u < v: fingerprints of the column fp that differ in 1 to bits (at most 3) bits."""
    if not 0 <= bits <= 3:
        raise ValueError("two of three segments hold at most one error only up to 3 differing bits")
    pairs = list(combinations(range(len(SEGMENTS)), 2))

    def keyed(wide: bool):
        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 20_000):
                    part = batch.slice(at, 20_000)
                    fps = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                    seg = segment_keys(fps.view(np.uint64))
                    keys, who = [], []
                    for n, (i, j) in enumerate(pairs):
                        a, b = (seg[i][1], seg[j][1]) if wide else (seg[i][0][:, None], seg[j][0][:, None])
                        key = np.where((a[:, :, None] >= 0) & (b[:, None, :] >= 0), (n << 24) | (a[:, :, None] << 12) | b[:, None, :], -1).reshape(len(fps), -1)
                        row, col = np.nonzero(key >= 0)
                        keys.append(key[row, col].astype(np.int32))
                        who.append(fps[row])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(who))], names=["key", "fp"])

        return lean(of)

    distinct = fps.select("fp").distinct()
    probe = distinct.mapInArrow(keyed(True), "key int, fp long").withColumnRenamed("fp", "u")
    index = distinct.mapInArrow(keyed(False), "key int, fp long").withColumnRenamed("fp", "v")
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= bits
    return probe.join(index, (probe["key"] == index["key"]) & (F.col("u") < F.col("v")) & near).select("u", "v").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 3) -> DataFrame:
    """(doc_id, fp long, component_id, n_links): one row for each input row.

    component_id is the least doc_id among all rows reachable over fingerprints
    that are equal or differ in at most bits bits; null if all of those ids are
    null. n_links counts the different fingerprints that the row's own links to.
    Repeated rows share a component; other columns of docs are not looked at.
    """
    fps = settled(fingerprints(docs, id_col, text_col, shingle))
    groups = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = settled(links(groups, bits))
    both = found.select("u").unionByName(found.select(F.col("v").alias("u")))
    degree = both.groupBy("u").agg(F.count("*").alias("n_links"))
    roots = components(found).join(degree, F.col("node") == F.col("u")).select("node", "root", "n_links")
    of_group = groups.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    named = of_group.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = of_group.join(named, "root").select(F.col("fp").alias("class_fp"), "component_id", "n_links")
    return fps.join(classes, F.col("fp") == F.col("class_fp")).select("doc_id", "fp", "component_id", "n_links")


def _described(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(doc_id, fp, sketch binary, keys array<long>) of each row with an id."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, sketches, keys = [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                hashes = shingle_hashes(text or b"", shingle)
                distinct = np.unique(hashes)
                fps.append(majority(hashes))
                sketches.append(sketch(distinct))
                keys.append(sample_keys(distinct))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sketches, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "fp", "sketch", "keys"])

    return documents(docs, id_col, text_col).filter("doc_id is not null").mapInArrow(lean(of), "doc_id long, fp long, sketch binary, keys array<long>")


def _unite(rows: DataFrame, total: int) -> DataFrame:
    """(key, part, side, node, root, sketch, banned), about total rows -> (u, v), u < v: links that unite each part of a key.

    Equal roots are joined already; null: nothing is. Sides are as united() has them, null: none.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        key, part, node = (table.column(c).to_numpy() for c in ("key", "part", "node"))
        root = table.column("root").to_numpy() if not table.column("root").null_count else None
        side = table.column("side").fill_null(-1).to_numpy()
        order = np.lexsort((node, part, key))
        key, part, node, side = key[order], part[order], node[order], side[order]
        sketches, banned = table.column("sketch").take(pa.array(order)), table.column("banned").take(pa.array(order))
        root = None if root is None else root[order]
        first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])))
        sizes = np.diff(np.append(first, len(key)))
        us, vs = [node[:0]], [node[:0]]
        # about a million sketched rows at a time, whole groups
        for chunk in np.split(np.arange(len(first)), np.flatnonzero(np.diff(first >> 18)) + 1):
            begin, end = first[chunk[0]], first[chunk[-1]] + sizes[chunk[-1]]
            held = Sketches(sketches.slice(begin, end - begin).to_pylist())
            for a, n in zip((first[chunk] - begin).tolist(), sizes[chunk].tolist(), strict=True):
                if n > 1:
                    at = slice(begin + a, begin + a + n)
                    if n == 2 and root is None:
                        pairs = [(0, 1)] if held.distances(a, np.array([a + 1]))[0] < np.inf else []
                    else:
                        own, labels, sides = held.take(np.arange(a, a + n)), None if root is None else root[at], None if side[begin + a] < 0 else side[at]
                        bans = None if root is None else [np.flatnonzero(np.isin(node[at], x)) for x in banned[begin + a : begin + a + n].to_pylist()]
                        pairs = more = united(own, labels, sides, bans)
                        # what is asked again has a neighbour that failed: the next ones are proposed at once
                        for _ in range(FORESTS - 1 if bans is not None and any(map(len, bans)) else 0):
                            for x, y in more:
                                bans[x], bans[y] = np.append(bans[x], y), np.append(bans[y], x)
                            more = united(own, labels, sides, bans)
                            if not more:
                                break
                            pairs = pairs + more
                    if pairs:
                        u, v = np.array(pairs).T
                        us.append(node[at][u]), vs.append(node[at][v])
        u, v = np.concatenate(us), np.concatenate(vs)
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])

    n_tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / 100_000))
    met = rows.select("key", "part", F.col("side").cast("int").alias("side"), "node", F.col("root").cast("long").alias("root"), "sketch", F.coalesce("banned", F.array().cast("array<bigint>")).alias("banned"))
    return staged(met.repartition(n_tasks, "key", "part").mapInArrow(lean(of), "u long, v long").filter("u <> v").distinct())


def _across(rows: DataFrame, sketches: DataFrame, joined: DataFrame) -> DataFrame:
    """(u, v): all links of members of a key that joined doesn't join. rows: (key, node) of keys of any size; joined: (node, root).

    What is joined lies in one set. A set of more than BLOCK has blocks of its
    own, smaller ones share blocks; each block meets each other one of its key,
    but none of the same set, and a shared one itself.
    """
    named = staged(rows.join(joined, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")))
    sets = named.groupBy("key", "root").agg(F.count("*").alias("n"))
    many = sets.groupBy("key").agg(F.count("*").alias("n_sets"), F.sum(F.when(F.col("n") <= BLOCK, F.col("n"))).alias("small")).filter("n_sets > 1")
    own = F.when(F.col("n") > BLOCK, F.col("root"))
    sets = sets.join(many, "key").select("key", "root", own.alias("own"), F.ceil(F.when(F.col("n") > BLOCK, F.col("n")).otherwise(F.col("small")) / BLOCK).alias("n_blocks"))
    block = F.struct(F.col("own").isNotNull().alias("alone"), F.coalesce("own", F.lit(0)).alias("own"), F.pmod(F.xxhash64(F.when(F.col("own").isNull(), F.col("root")).otherwise(F.col("node"))), F.col("n_blocks")).alias("n"))
    members = staged(named.join(sets, ["key", "root"]).select("key", "node", "root", block.alias("block")))
    blocks = settled(members.groupBy("key", "block").agg(F.count("*").alias("n")))
    a, b = blocks.select("key", F.col("block").alias("a"), F.col("n").alias("n_a")), blocks.select("key", F.col("block").alias("b"), F.col("n").alias("n_b"))
    one_set = F.col("a.alone") & F.col("b.alone") & (F.col("a.own") == F.col("b.own"))
    pairs = settled(a.join(b, "key").filter((F.col("a") <= F.col("b")) & ~one_set).withColumn("part", F.xxhash64("a", "b")))
    total = pairs.agg(F.sum(F.col("n_a") + F.col("n_b"))).first()[0] or 0
    itself = F.array(F.struct(F.col("a").alias("block"), F.lit(None).cast("int").alias("side")))
    both = F.array(F.struct(F.col("a").alias("block"), F.lit(0).alias("side")), F.struct(F.col("b").alias("block"), F.lit(1).alias("side")))
    halves = pairs.select("key", "part", F.explode(F.when(F.col("a") == F.col("b"), itself).otherwise(both)).alias("x")).select("key", "part", "x.block", "x.side")
    return _unite(members.join(sketches, "node").join(halves, ["key", "block"]), total)


def similar(classes: DataFrame, known: DataFrame | None = None, failed: DataFrame | None = None) -> DataFrame:
    """(u, v): links that join all nodes whose sketches are alike and that share a sample. classes: (node, sketch, keys).

    known: links (u, v) that hold already; failed: links that don't, whose
    samples alone are looked at then.
    """
    spark = classes.sparkSession
    rows = classes.select("node", F.explode("keys").alias("key"))
    sketches = classes.select("node", "sketch", F.lit(None).cast("array<bigint>").alias("banned"))
    joined = None
    if failed is not None:
        both = failed.select("u", "v").unionByName(failed.select(F.col("v").alias("u"), F.col("u").alias("v")))
        sketches = classes.select("node", "sketch").join(both.groupBy(F.col("u").alias("node")).agg(F.collect_list("v").alias("banned")), "node", "left")
        rows = rows.join(rows.join(both.select(F.col("u").alias("node")).distinct(), "node", "left_semi").select("key").distinct(), "key", "left_semi").select("node", "key")
        joined = components(known)
    sizes = settled(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    total, largest = sizes.agg(F.sum("n"), F.max("n")).first()
    if not total:
        return spark.createDataFrame([], "u long, v long")
    part = F.pmod(F.xxhash64("node", "key"), F.ceil(F.col("n") / BLOCK)).alias("part")
    met = rows.join(sizes, "key").join(sketches, "node")
    met = met.withColumn("root", F.lit(None).cast("long")) if joined is None else met.join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    found = _unite(met.select("key", part, F.lit(None).alias("side"), "node", "root", "sketch", "banned"), total)
    if largest <= BLOCK:
        return found
    large = rows.join(sizes.filter(F.col("n") > BLOCK), "key").select("key", "node").distinct()
    return found.unionByName(_across(large, sketches, components(found if known is None else found.unionByName(known))))


def verified(links: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """(u, v, holds): whether the whole sets of shingles of two documents (ids) are 0.8 alike. docs: (doc_id, text)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t or b"", shingle)).view(np.int64) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "hashes"])

    nodes = links.select(F.col("u").alias("doc_id")).unionByName(links.select(F.col("v").alias("doc_id"))).distinct()
    sets = staged(docs.join(nodes, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(lean(of), "node long, hashes array<long>"))
    a, b = sets.toDF("u", "a"), sets.toDF("v", "b")
    both = F.size(F.array_intersect("a", "b"))
    holds = F.lit(ALIKE[1]) * both >= F.lit(ALIKE[0]) * (F.size("a") + F.size("b") - both)
    return staged(links.join(a, "u").join(b, "v").groupBy("u", "v").agg(F.bool_or(holds).alias("holds")))


def near_copies_left(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, bits: int = 3) -> DataFrame:
    """(doc_id): the documents that stay when one of each group does, that with the least id; rows without an id stay.

    Linked are texts of a similarity of 0.8 or more that share a sample of
    shingles, or whose fingerprints differ in at most bits bits. Rows of one id
    are one document; null and wordless texts are one group. No rows: no rows.
    """
    described = settled(_described(docs, id_col, text_col, shingle))
    classes = settled(described.groupBy("fp", "sketch").agg(F.min("doc_id").alias("node"), F.first("keys").alias("keys")))
    by_fp = classes.groupBy("fp").agg(F.min("node").alias("node"))
    equal = classes.join(by_fp.withColumnRenamed("node", "u"), "fp").select("u", F.col("node").alias("v"))
    near = links(by_fp, bits)
    near = near.join(by_fp.select(F.col("fp").alias("u"), F.col("node").alias("a")), "u").join(by_fp.select(F.col("fp").alias("v"), F.col("node").alias("b")), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    of_keys = classes.select("node", "sketch", "keys")
    texts = documents(docs, id_col, text_col)
    proposed, judged = equal.unionByName(near).unionByName(similar(of_keys)), None
    for left in range(ROUNDS, 0, -1):
        pairs = proposed.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        new = verified(pairs if judged is None else pairs.join(judged, ["u", "v"], "left_anti"), texts, shingle)
        judged = new if judged is None else judged.unionByName(new)
        found = judged.filter("holds").select("u", "v")
        if left == 1 or new.filter("not holds").isEmpty():
            break
        proposed = similar(of_keys, found, judged.filter("not holds"))
    later = components(found).filter("node <> root").select("node")
    kept = classes.select("node").distinct().join(later, "node", "left_anti").select(F.col("node").alias("doc_id"))
    return kept.unionByName(texts.filter("doc_id is null").select("doc_id").distinct())
