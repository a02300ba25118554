"""Exact n-gram Jaccard self-join by universe partition and pigeonhole.

Two sets with Jaccard similarity of 3/4 or more differ in at most H = (r + s) / 7 elements. The universe of shingles is
hashed into the segments of a size band; whatever a set has in a segment is the segment's subset. A segment is allocated
to one of two kinds of index, the same for all sets of a band: exact (two subsets meet if they are equal and not empty) or
one-deletion (they meet also if one is the other less an element, and not empty; each set then adds its subset's deletions).
Two subsets that do not meet differ in at least one element, and in two where a one-deletion subset has two elements or
more. So each set walks its segments in one fixed order, gains that credit at each, and indexes those that it comes to with
a credit of H or less: of two similar sets, the first segment where they meet is indexed by both. Each set does so in its
own band and, where a smaller partner may lie there, in the band below.

Allocation by cost: shingles that are frequent in the corpus form segments of their own at the end of the order, whose lists
are long. One-deletion segments take more entries but gain credit faster, so that fewer sets come to the frequent ones. From
which segment on a band uses them is chosen by the cost of a bounded sample of sets: entries, and a charge for each frequent
one. Sets below SINGLE elements have single shingles as segments, where both kinds are the same.

Sets that meet under a subset are candidates. Lists of such sets with the same first member merge into one star around
it. A key that many sets of the sample share has its star's centre fixed beforehand, so its sets become pairs with that
centre where they are read, and no list of them is gathered. Members are compared with the centre first; whoever turns out
linked needs no further comparison, and the rest of each star become pivots in turn, until no untested pair of different
components is left. So a star of near copies costs about its size and no link that joins components is lost. Large stars
are compared in blocks of bounded size, of which only pairs leave whose parity bitmaps differ in few enough bits. Pairs are
then pruned exactly by a bound on their overlap from histograms and verified on whole sets of 64-bit shingle hashes. Copies
that are candidates of each other without any link cost a comparison of bitmaps each.

Equal sets collapse into one representative before all this, by a 64-bit hash of the set; rows are told apart by 128 bits.

Defined cases: a null or empty text, or one of white space, has the empty set and links with nothing; fewer than n words
are one shingle; rows with one id and different texts are documents of
their own; equal rows have equal results; a component's id is its smallest non-null one; texts are whole; an empty table
gives an empty result; other columns of docs do not matter, and pass through one_of_each under any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyveil.llm.shared import checkpointed, documents, forget_since, giving_back, mark, private_name, stored

WORDS = 5
BATCH_BYTES = 400_000
#: Sizes below SINGLE form one band whose segments are single shingles; above, bands grow by WIDEN.
SINGLE, WIDEN = 64, 4
#: A shingle is frequent if chunks of CHUNK shingles that hold it OFTEN times or more sum up to HOT; at most MOST_HOT are kept.
#: Which shingles these are changes the cost and never the result.
CHUNK, OFTEN, HOT, MOST_HOT = 500_000, 2, 8, 500_000
#: Pivots a star gets in the first round after its centre, and how that grows. Stars no larger than SMALL get all at once.
SMALL, FIRST, FASTER = 16, 4, 16
#: Members and pivots of a larger star that one task compares at a time, and the log2 of a bitmap's bits.
MEMBER_BLOCK, PIVOT_BLOCK, BITMAP = 512, 512, 11
#: Sets that the allocation and the shared keys are chosen from, as expected by their hashes; how many of them make a key a
#: shared one; and the charge for a frequent entry, in entries. They change the cost and never the result.
SAMPLE_SETS, SHARED, FREQUENT_COST = 4000, 8, 16
#: Shares of a band's segments, in eighths, that may be exact.
EIGHTHS = 8
#: Stars from which a set's rows are dealt over SALTS when joined by set.
MANY_STARS, SALTS = 256, 16
#: Entries that a task gathers before it sends them: some ten times their 16 bytes are in use meanwhile.
SENT_ENTRIES = 250_000
#: Index bytes a bucket aims at, and rows up to which a side is broadcast.
BUCKET_BYTES, BROADCAST_ROWS = 6_000_000, 400_000

_U = np.uint64
#: Odd constants for hashing; any would do.
_BASE, _WORD_MULTIPLIERS = _U(0x9E3779B97F4A7C15), np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Shingler:
    """Sorted distinct 64-bit hashes of the word n-grams of texts, many texts at a time."""

    def __init__(self, n: int = WORDS):
        self.n, self.power, self.inverse = n, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _grow(self, size: int) -> None:
        if len(self.power) <= size:
            steps = np.full(max(size + 1, 1 << 19), _BASE, np.uint64)
            steps[0] = 1
            self.power = np.cumprod(steps)
            steps[1:] = _U(pow(int(_BASE), -1, 1 << 64))
            self.inverse = np.cumprod(steps)

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        raw = [t.encode().lower() for t in texts]  # bytes.lower() changes A-Z alone
        buf = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
        self._grow(len(buf))
        space = _SPACE[buf]
        starts, ends = np.flatnonzero(space[:-1] & ~space[1:]) + 1, np.flatnonzero(~space[:-1] & space[1:]) + 1
        sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((buf + _U(1)) * self.power[: len(buf)], out=sums[1:])
        words = _mix((sums[ends] - sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))
        n = self.n
        grams = np.zeros(max(0, len(words) - n + 1), np.uint64)
        if len(grams):
            for k in range(n):
                grams += words[k : k + len(grams)] * _WORD_MULTIPLIERS[k % 5] * _U(2 * (k // 5) + 1)
            grams = _mix(grams)
        bounds = np.searchsorted(starts, np.cumsum([1] + [len(r) + 1 for r in raw]))
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= n:
                g = np.sort(grams[a : b - n + 1])
                out.append(g[np.concatenate(([True], g[1:] != g[:-1]))])
            elif b > a:  # the whole sequence, told from n-grams by its length
                out.append(_mix(np.array([(words[a:b] * _WORD_MULTIPLIERS[: b - a]).sum() + _U(b - a)], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def set_hash(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def band(n: int) -> int:
    """0 for sizes below SINGLE, then one for each further factor of WIDEN."""
    b, top = 0, SINGLE
    while n >= top:
        b, top = b + 1, top * WIDEN
    return b


def band_top(b: int) -> int:
    return SINGLE * WIDEN**b


def needed(n: int) -> list[tuple[int, int]]:
    """(band, segments to index): one more than the largest difference from a partner there. Where segments are single
    shingles, one more than the set's own part of it, a quarter of the set, is enough."""
    b = band(n)
    out = [(b, (n + min(4 * n // 3, band_top(b) - 1)) // 7 + 1)]
    if b and -(-3 * n // 4) < band_top(b - 1):
        out.append((b - 1, (n + band_top(b - 1) - 1) // 7 + 1))
    return [(c, need if c else min(need, n // 4 + 1)) for c, need in out]


@dataclass(frozen=True)
class Allocation:
    """For each band, the eighths of its order of segments that are exact; the rest are one-deletion. Bands not named: all exact."""

    exact: tuple[tuple[int, int], ...] = ()

    def first_deleting(self, b: int, segments: int) -> int:
        return dict(self.exact).get(b, EIGHTHS) * segments // EIGHTHS


ALL_EXACT = Allocation()


def _key(total: np.ndarray, b: int) -> np.ndarray:
    return _mix(total + _U(b)) & ~_U(1)


def _band_keys(s: np.ndarray, often: np.ndarray, allocation: Allocation, b: int, need: int) -> tuple[np.ndarray, int]:
    """The keys that a set indexes in a band, and how many of them are those of frequent segments."""
    # one order for all sets of a band: cold segments, exact and then one-deletion ones, then frequent ones, which are exact
    segments = band_top(b) // 2
    place = (s % _U(segments) if b else s >> _U(1)) | (often.astype(np.uint64) << _U(63))
    order = np.argsort(place)
    place, element = place[order], _mix(s[order] + _U(b + 1))
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    size, where = np.diff(np.append(first, len(s))), place[first]
    total = np.add.reduceat(element, first) + where * _BASE
    deleting = (size > 1) & (where >= _U(allocation.first_deleting(b, segments))) & (where < _U(1 << 63)) & (b > 0)
    credit = 1 + deleting
    indexed = np.cumsum(credit) - credit < need
    keys, deleting = _key(total[indexed], b), deleting & indexed
    if deleting.any():
        own = np.repeat(deleting, size)
        keys = np.concatenate([keys, _key(np.repeat(total, size)[own] - element[own], b) | _U(1)])
    return keys, int((where[indexed] >> _U(63)).sum())


def _among(s: np.ndarray, hot: np.ndarray) -> np.ndarray:
    return hot[np.minimum(np.searchsorted(hot, s), len(hot) - 1)] == s if len(hot) else np.zeros(len(s), bool)


def subsets(s: np.ndarray, hot: np.ndarray, allocation: Allocation = ALL_EXACT) -> np.ndarray:
    """Keys that a set indexes; those of deletions have the lowest bit set. hot: sorted frequent shingles."""
    if not len(s):
        return np.zeros(0, np.uint64)
    often = _among(s, hot)
    return np.concatenate([_band_keys(s, often, allocation, b, need)[0] for b, need in needed(len(s))])


def allocation_costs(s: np.ndarray, hot: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(band, eighths, entries, frequent entries) of a set, for each band that it indexes and each share of exact segments."""
    often = _among(s, hot)
    for b, need in needed(len(s)):
        for eighths in range(EIGHTHS + 1) if b else ():
            keys, frequent = _band_keys(s, often, Allocation(((b, eighths),)), b, need)
            yield b, eighths, len(keys), frequent


def histogram(s: np.ndarray) -> bytes:
    """Counts of a set's elements over a power of two of buckets, at least as many as half its size; at most 255 each."""
    bits = max(4, int(len(s) // 2).bit_length())
    return np.minimum(np.bincount((s >> _U(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def bitmap(s: np.ndarray) -> bytes:
    """The parities of a set's elements over 2 ** BITMAP buckets. Bitmaps differ in no more bits than the sets in elements."""
    return np.packbits((np.bincount((s >> _U(64 - BITMAP)).astype(np.int64), minlength=1 << BITMAP) & 1).astype(np.uint8)).tobytes()


def _near_pivots(pivots: pa.Table, members: pa.Table) -> pa.Table:
    """Of one block: the pairs of different components that sizes and bitmaps allow to link."""
    of = lambda t, *names: (t.column(c).to_numpy() for c in names)
    bits = lambda t: np.frombuffer(b"".join(t.column("bitmap").to_pylist()), np.uint64).reshape(t.num_rows, -1)
    value, component, size = of(members, "set", "component", "size")
    own_bits, all_bits, left, right = bits(pivots), bits(members), [], []
    for k, (pivot, own, n) in enumerate(zip(*of(pivots, "pivot", "own", "own_size"), strict=True)):
        at = np.flatnonzero((component != own) & (4 * np.minimum(size, n) >= 3 * np.maximum(size, n)))
        found = value[at[7 * np.bitwise_count(all_bits[at] ^ own_bits[k]).sum(1, dtype=np.int64) <= size[at] + n]]
        left.append(np.minimum(found, pivot))
        right.append(np.maximum(found, pivot))
    columns = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right)]
    return pa.table({"a": pa.array(columns[0], pa.int64()), "b": pa.array(columns[1], pa.int64())})


def may_link(n: int, m: int, h: bytes, g: bytes) -> bool:
    """Whether sizes and histograms allow a similarity of 3/4. A full bucket counts as unbounded."""
    if 4 * min(n, m) < 3 * max(n, m):
        return False
    a, b = np.frombuffer(h, np.uint8).astype(np.int64), np.frombuffer(g, np.uint8).astype(np.int64)
    a, b = np.where(a == 255, 1 << 40, a), np.where(b == 255, 1 << 40, b)
    if len(a) != len(b):
        k = min(len(a), len(b))
        a, b = a.reshape(k, -1).sum(1), b.reshape(k, -1).sum(1)
    return 7 * int(np.minimum(a, b).sum()) >= 3 * (n + m)


def links(a: np.ndarray, b: np.ndarray) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= 75 * (len(a) + len(b) - shared)


def _batches(column: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    """(from, to, texts) over a column, about BATCH_BYTES at a time."""
    texts, at, size = [], 0, 0
    for k, t in enumerate(column):
        texts.append(t.as_py() or "")
        size += len(texts[-1])
        if size >= BATCH_BYTES:
            yield at, k + 1, texts
            texts, at, size = [], k + 1, 0
    if texts:
        yield at, len(column), texts


def _count(chunk: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    value, n = np.unique(np.concatenate(chunk), return_counts=True)
    return value[n >= OFTEN], n[n >= OFTEN]


def summaries(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """Rows of two kinds: (row, n_shingles, set_hash) of each document, and (set_hash: a frequent shingle, n_shingles: its
    count in a chunk, row null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, chunk, size, seen = Shingler(n), [], 0, set()

        def rows(row: list, count: list, value: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(row, pa.binary()), pa.array(count, pa.int64()), pa.array(value, pa.int64())], ["row", "n_shingles", "set_hash"])

        def frequent() -> pa.RecordBatch:
            value, count = _count(chunk)
            return rows([None] * len(value), count.tolist(), value.astype(np.int64).tolist())

        for batch in batches:
            for a, b, texts in _batches(batch.column(1)):
                sets = own.sets(texts)
                hashes = [set_hash(s) for s in sets]
                yield rows(batch.column(0)[a:b].to_pylist(), list(map(len, sets)), hashes)
                for s, h in zip(sets, hashes, strict=True):
                    if h not in seen:
                        seen.add(h)
                        chunk.append(s)
                        size += len(s)
                if size >= CHUNK:
                    yield frequent()
                    chunk, size, seen = [], 0, set()
        if chunk:
            yield frequent()

    return docs.select("row", "text").mapInArrow(giving_back(run), "row binary, n_shingles long, set_hash long")


def frequent_shingles(summary: DataFrame) -> np.ndarray:
    """The sorted frequent shingles: at most MOST_HOT, those with the largest counts."""
    counts = summary.where("row is null").groupBy("set_hash").agg(F.sum("n_shingles").alias("n")).where(F.col("n") >= HOT)
    rows = counts.orderBy(F.col("n").desc(), "set_hash").limit(MOST_HOT).select("set_hash").toArrow()
    return np.sort(rows.column(0).to_numpy().astype(np.int64).view(np.uint64))


def sampled_sets(docs: DataFrame, n_rows: int) -> DataFrame:
    """The text of about SAMPLE_SETS rows, those of the smallest hashes; all rows of small tables."""
    limit = int((1 << 64) * min(1.0, SAMPLE_SETS / max(1, n_rows))) - (1 << 63)
    own = docs.where(F.xxhash64("row") < F.lit(limit)) if limit < 1 << 63 else docs
    return stored(own.select("text"), "sampled_texts")


def _distinct_sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(set hash, set) of the texts of a task, most repeats left out."""
    own, seen = Shingler(n), set()
    for batch in batches:
        for _, _, texts in _batches(batch.column(0)):
            for s in own.sets(texts):
                h = set_hash(s)
                if len(s) and h not in seen:
                    seen.add(h)
                    yield h, s
            if len(seen) > 500_000:
                seen.clear()


def choose_allocation(sample: DataFrame, hot: np.ndarray, n: int = WORDS) -> Allocation:
    """The cheapest share of exact segments of each band, by the sample's entries; ties to more exact ones."""
    shared_hot = sample.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost: dict[tuple[int, int], int] = {}
        for _, s in _distinct_sets(batches, n):
            for b, eighths, entries, frequent in allocation_costs(s, shared_hot.value):
                cost[b, eighths] = cost.get((b, eighths), 0) + entries + FREQUENT_COST * frequent
        yield pa.RecordBatch.from_pydict({"band": pa.array([b for b, _ in cost], pa.int32()), "eighths": pa.array([e for _, e in cost], pa.int32()), "cost": pa.array(cost.values(), pa.int64())})

    rows = sample.mapInArrow(giving_back(run), "band int, eighths int, cost long").groupBy("band", "eighths").agg(F.sum("cost").alias("cost")).collect()
    best: dict[int, tuple[int, int]] = {}
    for r in rows:
        best[r["band"]] = min(best.get(r["band"], (r["cost"], -r["eighths"])), (r["cost"], -r["eighths"]))
    return Allocation(tuple(sorted((b, -e) for b, (_, e) in best.items())))


def shared_keys(sample: DataFrame, hot: np.ndarray, allocation: Allocation, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys, without their lowest bit, that SHARED or more sets of the sample index, each with one of these sets."""
    shared_hot = sample.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, s in _distinct_sets(batches, n):
            keys = np.unique(subsets(s, shared_hot.value, allocation) & ~_U(1)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), h, np.int64))], ["key", "owner"])

    found = sample.mapInArrow(giving_back(run), "key long, owner long").groupBy("key").agg(F.count_distinct("owner").alias("n"), F.min("owner").alias("centre"))
    rows = found.where(F.col("n") >= SHARED).select("key", "centre").toArrow()
    keys, centres = (rows.column(c).to_numpy() for c in ("key", "centre"))
    order = np.argsort(keys.view(np.uint64))
    return keys.view(np.uint64)[order], centres[order]


def _distinct(pairs: np.ndarray) -> np.ndarray:
    """The distinct rows of two columns."""
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    return pairs[np.concatenate(([True], (pairs[1:] != pairs[:-1]).any(1)))] if len(pairs) else pairs


def _index(docs: DataFrame, hot: np.ndarray, allocation: Allocation, shared: tuple[np.ndarray, np.ndarray], bits: int, n: int) -> DataFrame:
    """(bucket, entries, pairs) of the sets of each task, once a set and buffer: 16-byte entries (key, set hash), and for
    shared keys 16-byte pairs (centre, set hash), which are dealt by the set."""
    known = docs.sparkSession.sparkContext.broadcast((hot, *shared))

    def blobs(bucket: np.ndarray, a: np.ndarray, b: np.ndarray) -> dict[int, bytes]:
        order = np.argsort(bucket, kind="stable")
        both = np.empty((len(order), 2), np.uint64)
        both[:, 0], both[:, 1] = a[order], b[order]
        bucket, raw = bucket[order], both.tobytes()
        first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, int)
        return {int(bucket[k]): raw[16 * k : 16 * end] for k, end in zip(first.tolist(), np.append(first[1:], len(bucket)).tolist(), strict=False)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, keys_shared, centres = known.value
        parts: list[tuple[np.ndarray, int]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            keys = np.concatenate([k for k, _ in parts])
            owner = np.repeat(np.array([h for _, h in parts], np.int64).view(np.uint64), [len(k) for k, _ in parts])
            of = lambda x: (x >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(x), np.int64)
            met = _among(keys & ~_U(1), keys_shared)
            entries = blobs(of(keys[~met]), keys[~met], owner[~met])
            centre = centres[np.searchsorted(keys_shared, keys[met] & ~_U(1))].view(np.uint64)
            pairs = _distinct(np.stack([centre, owner[met]], 1)[centre != owner[met]])
            pairs = blobs(of(_mix(pairs[:, 1])), pairs[:, 0], pairs[:, 1])
            bucket = sorted({*entries, *pairs})
            return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array([entries.get(k, b"") for k in bucket], pa.binary()), pa.array([pairs.get(k, b"") for k in bucket], pa.binary())], ["bucket", "entries", "pairs"])

        for h, s in _distinct_sets(batches, n):
            parts.append((subsets(s, hot, allocation), h))
            size += len(parts[-1][0])
            if size >= SENT_ENTRIES:
                yield flush()
                parts, size = [], 0
        if parts:
            yield flush()

    return docs.select("text").mapInArrow(giving_back(run), "bucket int, entries binary, pairs binary")


def _pairs(table: pa.Table) -> pa.Table:
    """Of one bucket: the distinct pairs of the first set under a key and another, where one of all has the key as a subset;
    and the pairs that came as such."""
    of = lambda name: np.concatenate([np.frombuffer(x.as_buffer(), np.uint64).reshape(-1, 2) for x in table.column(name)])
    entries, pairs = of("entries"), of("pairs")
    key, owner = entries[:, 0] & ~_U(1), entries[:, 1].view(np.int64)
    order = np.lexsort((owner, key))
    key, owner, exact = key[order], owner[order], entries[order, 0] & _U(1) == 0
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, int)
    if len(key):
        size = np.diff(np.append(first, len(key)))
        open_ = np.repeat(np.logical_or.reduceat(exact, first), size)
        centre = np.repeat(owner[first], size)
        keep = open_ & (centre != owner)
        pairs = np.concatenate([pairs, np.stack([centre[keep], owner[keep]], 1).view(np.uint64)])
    pairs = _distinct(pairs).view(np.int64)
    return pa.table({"a": pa.array(np.ascontiguousarray(pairs[:, 0])), "b": pa.array(np.ascontiguousarray(pairs[:, 1]))})


def candidate_pairs(docs: DataFrame, hot: np.ndarray, n_rows: int, n_shingles: int, n: int = WORDS, allocation: Allocation | None = None) -> DataFrame:
    """(a, b): the pairs of a star's centre and its other members, as set hashes; two sets that meet under a key are in one star."""
    sample = sampled_sets(docs, n_rows)
    allocation = allocation or choose_allocation(sample, hot, n)
    shared = shared_keys(sample, hot, allocation, n)
    bits = max(4, int(6 * n_shingles // BUCKET_BYTES).bit_length())
    # a bucket is a task, so that no task's share depends on the number of partitions of the session
    index = _index(docs, hot, allocation, shared, bits, n).repartitionById(1 << bits, "bucket")
    return index.groupBy("bucket").applyInArrow(_pairs, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable by edges (a, b), for every node of an edge.

    Each round takes the least label around a node, then the label of that label.
    """
    both = checkpointed(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    point = mark()
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("least"))
        step = labels.join(near, "node").select("node", F.least("component", "least").alias("next"), "component")
        far = labels.select(F.col("node").alias("next"), F.col("component").alias("jump"))
        moved = checkpointed(step.join(far, "next").select("node", F.least("next", "jump").alias("next"), "component"))
        forget_since(edges.sparkSession, point, keep=1)
        changed = moved.where("next <> component").limit(1).count()
        labels = moved.select("node", F.col("next").alias("component"))
        if not changed:
            return labels


def merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """The labels of components() after further edges: only components that these join are walked again."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    fresh = ends.join(labels, "node", "left_anti").select("node", F.col("node").alias("component"))
    labels = checkpointed(labels.select("node", "component").unionByName(fresh))
    for side in ("a", "b"):
        edges = edges.join(labels.select(F.col("node").alias(side), F.col("component").alias(f"{side}_of")), side)
    between = checkpointed(edges.where("a_of <> b_of").select(F.least("a_of", "b_of").alias("a"), F.greatest("a_of", "b_of").alias("b")).distinct())
    if not between.limit(1).count():
        return labels
    moved = components(between).select(F.col("node").alias("old"), F.col("component").alias("new"))
    # a component of any size is dealt over parts
    part = F.pmod(F.xxhash64("node"), F.lit(int(labels.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    dealt = labels.withColumn("part", part)
    known = dealt.select(F.col("component").alias("old"), "part").distinct().join(moved, "old")
    told = dealt.join(known, (F.col("component") == F.col("old")) & (dealt["part"] == known["part"]), "left")
    return checkpointed(told.select("node", F.coalesce("new", "component").alias("component")))


class Verifier:
    """Tests pairs of set hashes. Sizes and histograms are kept for every candidate set; whole sets are rebuilt from the
    texts of those alone that a histogram leaves in question."""

    def __init__(self, docs: DataFrame, holders: DataFrame, n: int, distinct: bool):
        """holders: (row, set_hash) of one document for each set that is in a group. distinct: no row of docs repeats."""
        self.docs, self.holders, self.n, self.distinct = docs, holders, n, distinct
        schema = "set_hash long, size long, histogram binary, bitmap binary"
        self.sketches = stored(self._sets(holders, holders.count(), schema, lambda s: (len(s), histogram(s), bitmap(s))), "sketches")
        self.elements = docs.sparkSession.createDataFrame([], "set_hash long, elements binary")

    def _sets(self, holders: DataFrame, n_holders: int, schema: str, values) -> DataFrame:
        """set_hash and values(set) of each of the holders' sets, once."""
        n, names = self.n, [x.split()[0] for x in schema.split(", ")]
        side = holders.select(F.col("row").alias("h_row"), F.col("set_hash").alias("h_set"))
        text = self.docs.join(F.broadcast(side) if n_holders <= BROADCAST_ROWS else side, F.col("row") == F.col("h_row")).select("h_set", "text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, seen = Shingler(n), set()
            for batch in batches:
                for a, b, texts in _batches(batch.column(1)):
                    new = {h: s for h, s in zip(batch.column(0)[a:b].to_pylist(), own.sets(texts), strict=True) if h not in seen}
                    seen.update(new)
                    rows = [(h, *values(s)) for h, s in new.items()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if isinstance(c[0], bytes) else pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64()) for _ in names], names)

        out = text.mapInArrow(giving_back(run), schema)
        return out if self.distinct else out.dropDuplicates(["set_hash"])

    @staticmethod
    def _both(pairs: DataFrame, sets: DataFrame, columns: list[str]) -> DataFrame:
        for side in ("a", "b"):
            other = sets.select(F.col("set_hash").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns])
            pairs = pairs.join(other, side)
        return pairs

    def linked(self, pairs: DataFrame, sized: bool = False) -> DataFrame:
        """The distinct pairs (a, b) that link. sized: the pairs' sizes allow it already. A set is read from the texts
        once, when a histogram first leaves it in question; a call that needs no new set reads no text."""

        def hopeful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in batches:
                keep = [may_link(n, m, h, g) for n, m, h, g in zip(*(x.column(c).to_pylist() for c in ("size_a", "size_b", "histogram_a", "histogram_b")), strict=True)]
                yield pa.RecordBatch.from_arrays([x.column("a"), x.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

        def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in batches:
                of = lambda c: (np.frombuffer(v.as_buffer(), np.uint64) for v in x.column(c))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([x.column("a"), x.column("b")], ["a", "b"]).filter(pa.array([links(s, t) for s, t in zip(of("elements_a"), of("elements_b"), strict=True)], pa.bool_()))

        if not sized:
            pairs = self._both(pairs, self.sketches.select("set_hash", "size"), ["size"]).where("4 * least(size_a, size_b) >= 3 * greatest(size_a, size_b)")
            pairs = pairs.select("a", "b")
        hope = checkpointed(self._both(pairs, self.sketches.select("set_hash", "size", "histogram"), ["size", "histogram"]).mapInArrow(giving_back(hopeful), "a long, b long"))
        wanted = hope.select(F.explode(F.array("a", "b")).alias("set_hash")).distinct()
        own = checkpointed(self.holders.join(wanted, "set_hash", "left_semi").join(self.elements, "set_hash", "left_anti"))
        if n_own := own.count():
            self.elements = self.elements.unionByName(stored(self._sets(own, n_own, "set_hash long, elements binary", lambda s: (s.tobytes(),)), "elements"))
        elements = self.elements
        return self._both(hope, elements, ["elements"]).mapInArrow(giving_back(exact), "a long, b long")


def _by_set(members: DataFrame, table: DataFrame, many: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """members joined with the rows of table, one a set, whose column `key` is the set. The rows of a set of many stars are
    dealt over salts, and the table's row of such a set is copied to each."""
    known = table.join(many, F.col(key) == F.col("many_set"), "left")
    known = known.withColumn("k_salt", F.explode(F.when(F.col("many_set").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("many_set")
    return members.join(known, (F.col("set") == F.col(key)) & (F.col("salt") == F.col("k_salt")), how).drop("k_salt")


def _by_star(members: DataFrame, every: DataFrame, table: DataFrame) -> DataFrame:
    """members joined with the rows of table, one a star, part by part. every: rows with the parts of each star."""
    return members.join(every.select("star", "part").distinct().join(table, "star"), ["star", "part"])


def linked_sets(docs: DataFrame, summary: DataFrame, n: int = WORDS, allocation: Allocation | None = None) -> DataFrame:
    """(node, component) over the set hashes that link with another."""
    sets = summary.where("row is not null and n_shingles > 0")
    n_shingles, n_rows, n_own = sets.agg(F.sum("n_shingles"), F.count("*"), F.count_distinct("row")).first()
    n_shingles = n_shingles or 0
    pairs = stored(candidate_pairs(docs, frequent_shingles(summary), n_rows, n_shingles, n, allocation), "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("set_hash")).distinct()
    holders = sets.groupBy("set_hash").agg(F.min("row").alias("row")).join(wanted, "set_hash")
    test = Verifier(docs, checkpointed(holders), n, n_rows == n_own)
    # a star's centre is its first pivot; a star of any size is dealt over parts, of which it has at most that many
    part = F.pmod(F.xxhash64("set"), F.lit(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))).cast("int")
    members = pairs.select(F.col("a").alias("star"), F.col("b").alias("set")).withColumn("part", part)
    held = checkpointed(members.groupBy("star", "part").count())
    centres = held.groupBy("star").agg(F.sum("count").alias("n")).where("n > 1").select("star")
    members = members.join(held.join(centres, "star").select("star", "part"), ["star", "part"], "left_semi")
    many = checkpointed(members.groupBy(F.col("set").alias("many_set")).count().where(F.col("count") >= MANY_STARS).select("many_set"))
    own = centres.select("star", F.col("star").alias("set")).withColumn("part", part)
    salt = F.when(F.col("many_set").isNull(), 0).otherwise(F.pmod(F.xxhash64("star"), F.lit(SALTS))).cast("int")
    members = members.unionByName(own).join(many, F.col("set") == F.col("many_set"), "left").select("star", "set", "part", salt.alias("salt"))
    members = checkpointed(_by_set(members, test.sketches.select("set_hash", "size"), many, "set_hash").drop("set_hash"))
    used = centres.select("star", F.col("star").alias("set"))
    tested, at_once = pairs, FIRST
    labels = components(checkpointed(test.linked(pairs)))
    while True:
        told = checkpointed(_by_set(members, labels, many, "node", "left").select("star", "set", "part", "salt", "size", F.coalesce("component", "set").alias("component")))
        parts = told.groupBy("star", "component").agg(F.count("*").alias("n"))
        open_ = parts.groupBy("star").agg(F.count("*").alias("parts"), F.max_by("component", F.struct("n", "component")).alias("largest"), F.sum("n").alias("members")).where("parts > 1").select("star", "largest", "members")
        told = checkpointed(_by_star(told, told, open_))
        rest = told.where("component <> largest").join(used, ["star", "set"], "left_anti")
        rest = rest.withColumn("k", F.row_number().over(Window.partitionBy("star").orderBy("set"))).where(F.col("k") <= max(SMALL, at_once))
        rest = rest.where((F.col("members") <= SMALL) | (F.col("k") <= at_once))
        pivots = checkpointed(rest.select("star", F.col("set").alias("pivot"), F.col("component").alias("own"), F.col("size").alias("own_size"), "members", "k"))
        if not pivots.limit(1).count():
            return labels
        pairs = _in_small_stars(pivots, told).unionByName(_in_large_stars(pivots, told, test.sketches, many)).distinct()
        pairs = checkpointed(pairs.join(tested, ["a", "b"], "left_anti"))
        tested, used = tested.unionByName(pairs), used.unionByName(pivots.select("star", F.col("pivot").alias("set")))
        new = checkpointed(test.linked(pairs, sized=True))
        if new.limit(1).count():
            labels = merged(labels, new)
        members, at_once = told.select("star", "set", "part", "salt", "size"), FASTER * at_once


def _in_small_stars(pivots: DataFrame, told: DataFrame) -> DataFrame:
    """(a, b): each pivot with the members of other components whose sizes allow a link."""
    own = pivots.where(F.col("members") <= SMALL).drop("members")
    both = own.join(told.where(F.col("members") <= SMALL), "star").where("own <> component and 4 * least(size, own_size) >= 3 * greatest(size, own_size)")
    return both.select(F.least("pivot", "set").alias("a"), F.greatest("pivot", "set").alias("b"))


def _in_large_stars(pivots: DataFrame, told: DataFrame, sketches: DataFrame, many: DataFrame) -> DataFrame:
    """(a, b) as above, in blocks of members by blocks of pivots, where the bitmaps allow a link too."""
    of_own, of_other = (sketches.select(F.col("set_hash").alias("bits_of"), F.col("bitmap").alias("bitmap")) for _ in range(2))
    keys, large = ["star", "pivot_block", "block"], F.col("members") > SMALL
    n_blocks = F.ceil(F.col("members") / MEMBER_BLOCK).cast("int")
    own = pivots.where(large).withColumn("pivot_block", F.expr(f"cast((k - 1) div {PIVOT_BLOCK} as int)"))
    n_pivots = own.groupBy("star").agg((F.max("pivot_block") + 1).alias("pivot_blocks"))
    own = own.join(of_own, F.col("pivot") == F.col("bits_of")).withColumn("block", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
    others = _by_set(_by_star(told.where(large), told.where(large), n_pivots), of_other, many, "bits_of").withColumn("block", F.pmod(F.xxhash64("set").cast("long"), n_blocks).cast("int"))
    others = others.withColumn("pivot_block", F.explode(F.sequence(F.lit(0), F.col("pivot_blocks") - 1)))
    own = own.select(*keys, "pivot", "own", "own_size", "bitmap").groupBy(*keys)
    return own.cogroup(others.select(*keys, "set", "component", "size", "bitmap").groupBy(*keys)).applyInArrow(_near_pivots, "a long, b long")


def _named(docs: DataFrame, n: int) -> DataFrame:
    """row, doc_id, n_shingles and set, which names the class of a set that is not empty."""
    rows = docs.select("doc_id", "text", "row")
    summary = stored(summaries(rows, n), "set_hashes")
    labels = linked_sets(rows.select("row", "text"), summary, n)
    sets = rows.select("row", "doc_id").join(summary.where("row is not null").dropDuplicates(["row"]), "row")
    return sets.join(labels, sets["set_hash"] == labels["node"], "left").withColumn("set", F.coalesce("component", "set_hash"))


def join_documents(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """(row, doc_id, n_shingles, component_id) for each row of docs: the classes of the Jaccard join at 3/4."""
    named = _named(docs, n)
    # a class of any size is dealt over as many parts as the session has partitions; the parts' least ids meet in one row each
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = named.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))
    own = named.where("n_shingles > 0").groupBy("set", "part").agg(F.min("doc_id").alias("least"))
    least = own.groupBy("set").agg(F.min("least").alias("least"), F.collect_list("part").alias("parts")).select("set", "least", F.explode("parts").alias("part"))
    component = F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return named.join(least, ["set", "part"], "left").select("row", "doc_id", "n_shingles", component.alias("component_id"))


def _row_number() -> Column:
    """128 bits that tell rows of different ids or texts apart; nulls count as values of their own."""
    known = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("0"))
    return F.unhex(F.md5(F.concat(known("doc_id"), F.lit("\0"), known("text"))))


def with_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text and a number of the row. The table is read again later, so the number depends on the row alone."""
    return docs.select("doc_id", "text", _row_number().alias("row"))


def one_of_each(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """docs with one row of each class: of its smallest id, null being the largest, that of the least hash; of equal rows,
    one. Rows with empty sets all stay."""
    name, kept = private_name(docs, "row"), private_name(docs, "kept")
    found = _named(with_rows(docs), n).where("n_shingles > 0")
    # one id can be the smallest of several classes, so a class is known by its set
    keep = found.groupBy("set").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("least"))
    worded = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    # equal rows are merged where they are read, before the join deals them out by their hash
    rows = docs.where(worded).withColumn(name, _row_number()).dropDuplicates([name])
    rows = rows.join(keep.select(F.col("least.row").alias(kept)), F.col(name) == F.col(kept), "left_semi").drop(name)
    return rows.unionByName(docs.where(~worded))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_documents(with_rows(documents(spark, sf_dir))).drop("row")
