"""Best-fit packing of tokenised documents into fixed-length sequences by bin completion.

Sizes are integers up to the capacity, so a corpus of any size is a histogram of at most `capacity` counts, and only that
reaches the driver. There a branch and bound over the histogram takes the largest size left, enumerates the undominated
fillings of the rest of its sequence one after the other, least waste first and none left out, applies one as often as the
counts allow or once, and prunes by waste and by lower bound. The best-fit-decreasing packing of what is left is tried at
every node as the incumbent; the search ends at the lower bound or after `nodes` nodes, with the best packing found. The
answer is a list of patterns with repeat counts, which places every piece by its rank among the pieces of its length.

Defined cases: a null or empty text is one piece holding the end id alone; equal rows are placed each on its own; an empty
table packs into nothing; texts of any length are cut whole; other columns of docs do not matter.
"""

from __future__ import annotations

import sys
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyveil.llm.bpe import Codec, map_texts
from tallyveil.llm.shared import documents, stored

CAPACITY = 1024
END_ID = 2
#: The search's nodes, and at which depths it tries best fit for the rest.
NODES, TRY_EVERY = 4000, 16
#: Pieces of one length that one task ranks, about: so many, or this share of all pieces where that is less.
RANK_ROWS, RANK_SHARE = 200_000, 512
#: Fixed values of the vocabulary: its special token.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256

Pattern = tuple[tuple[int, int], ...]  # (size, how many), largest size first
TASK = "task"
PIECES = "doc_id id, piece int, start long, length long, ids_crc32 long"


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing on a histogram: sizes from the largest, each bin with the least room that fits, filled in full."""
    rooms: dict[int, list[tuple[Pattern, int]]] = {}

    def put(room: int, pattern: Pattern, n: int) -> None:
        if n:
            rooms.setdefault(room, []).append((pattern, n))

    for size in sorted((s for s, n in counts.items() if n), reverse=True):
        left = counts[size]
        for room in sorted(r for r in rooms if r >= size):
            each = room // size
            groups = rooms.pop(room)
            for pattern, n in groups:
                full = min(n, left // each)
                put(room - each * size, (*pattern, (size, each)), full)
                left -= full * each
                rest = n - full
                if left and rest and left < each:
                    put(room - left * size, (*pattern, (size, left)), 1)
                    left, rest = 0, rest - 1
                put(room, pattern, rest)
            if not left:
                break
        each = capacity // size
        put(capacity - each * size, ((size, each),), left // each)
        if left % each:
            put(capacity - left % each * size, ((size, left % each),), 1)
    return [x for groups in rooms.values() for x in groups]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """The larger of the volume bound and the bound that counts sizes which cannot share a bin."""
    total = sum(s * n for s, n in counts.items())
    best = -(-total // capacity)
    for k in {0, *(s for s, n in counts.items() if n and s <= capacity // 2)}:
        big = sum(n for s, n in counts.items() if s > capacity - k)
        mid = [(s, n) for s, n in counts.items() if capacity // 2 < s <= capacity - k]
        room = sum((capacity - s) * n for s, n in mid)
        small = sum(s * n for s, n in counts.items() if k <= s <= capacity // 2)
        best = max(best, big + sum(n for _, n in mid) + max(0, -(-(small - room) // capacity)))
    return best


def fillings(counts: dict[int, int], room: int, waste: int) -> Iterator[tuple[Pattern, int]]:
    """Every undominated filling of a room with at most this waste, as (pattern, waste), least waste first, found as asked for.

    A filling is dominated where a free item fits its waste, or can replace one or two of its items and uses more of the
    room. Bit sets of the sums that the smaller sizes reach leave no choice that leads nowhere.
    """
    if counts.get(room):
        yield ((room, 1),), 0  # one item that fills the room dominates all else
        return
    sizes = sorted((s for s, n in counts.items() if n and s <= room), reverse=True)
    whole = (1 << (room + 1)) - 1
    reach = [1]  # reach[k]: bit t is set where the sizes from the k-th on have a sum of t
    for s in reversed(sizes):
        bits, left, step = reach[0], min(counts[s], room // s), 1
        while left:
            take = min(step, left)
            bits |= bits << (take * s) & whole
            left, step = left - take, 2 * step
        reach.insert(0, bits)
    on_hand = sum(1 << s for s, n in counts.items() if n)  # bit s: some item of size s

    def dominated(pattern: Pattern, slack: int) -> bool:
        free, more, as_much = on_hand, (1 << slack) - 1, (2 << slack) - 1
        for s, k in pattern:
            if counts[s] == k:
                free &= ~(1 << s)
        if free & as_much & ~1:
            return True
        for i, (a, k) in enumerate(pattern):
            if free >> (a + 1) & more or k > 1 and free >> (2 * a) & as_much or any(free >> (a + b) & as_much for b, _ in pattern[i + 1 :]):
                return True
        return False

    for slack in range(min(waste, room) + 1):
        if not reach[0] >> (room - slack) & 1:
            continue
        # depth first, most of the largest size first: (next size, what is left, what is chosen)
        open_: list[tuple[int, int, Pattern]] = [(0, room - slack, ())]
        while open_:
            k, left, chosen = open_.pop()
            if not left:
                if not dominated(chosen, slack):
                    yield chosen, slack
                continue
            # sizes that are too large, or that what is left can do without, are passed over in one go
            for j in range(min(counts[sizes[k]], left // sizes[k]) + 1):
                rest = left - j * sizes[k]
                if reach[k + 1] >> rest & 1:
                    open_.append((k + 1, rest, (*chosen, (sizes[k], j)) if j else chosen))


def bin_completion(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple[Pattern, int]]:
    """A packing of the histogram as (pattern, repeats); see search_packing."""
    return search_packing(counts, capacity, nodes)[0]


def search_packing(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> tuple[list[tuple[Pattern, int]], bool]:
    """A packing of the histogram, and whether it is known to use the fewest bins: it meets the lower bound, or the search
    ended before its node budget, for no filling is left out."""
    counts = {s: n for s, n in counts.items() if n}
    if any(not 0 < s <= capacity for s in counts):
        raise ValueError("sizes must lie between 1 and the capacity")
    bins = lambda packing: sum(n for _, n in packing)
    best = best_fit(counts, capacity)
    floor, total = lower_bound(counts, capacity), sum(s * n for s, n in counts.items())
    left = nodes

    def search(rest: dict[int, int], chosen: list[tuple[Pattern, int]], used: int, volume: int) -> None:
        nonlocal best, left
        left -= 1
        if left < 0 or bins(best) <= floor or used - (-volume // capacity) >= bins(best):
            return
        if not rest or len(chosen) % TRY_EVERY == 0:
            tried = [*chosen, *best_fit(rest, capacity)]
            if bins(tried) < bins(best):
                best = tried
        if not rest:
            return
        top = max(rest)
        after = {s: n - (s == top) for s, n in rest.items() if n > (s == top)}
        spare = lambda: (bins(best) - 1) * capacity - total - (used * capacity - (total - volume))
        for filling, lost in fillings(after, capacity - top, spare()):
            pattern = tuple(sorted((Counter({top: 1}) + Counter(dict(filling))).items(), reverse=True))
            most = min(rest[s] // k for s, k in pattern)
            for repeat in sorted({most, 1}, reverse=True):
                if lost * repeat > spare():
                    continue
                taken = {s: n - repeat * k for s, n in rest.items() if (k := dict(pattern).get(s, 0)) * repeat < n}
                search(taken, [*chosen, (pattern, repeat)], used + repeat, volume - repeat * (capacity - lost))
                if left < 0 or bins(best) <= floor:
                    return

    depth = sys.getrecursionlimit()
    sys.setrecursionlimit(max(depth, nodes + 2000))
    try:
        search(counts, [], 0, total)
    finally:
        sys.setrecursionlimit(depth)
    return best, left >= 0 or bins(best) <= floor


def token_ids(own: Codec, texts: list[str]) -> list[bytes]:
    """The ids that the vocabulary's own library gives: its special token's string is that token. The end id is last."""
    end = END_ID.to_bytes(4, "little")
    if not any(SPECIAL in t for t in texts):
        return [x + end for x in own.encode_batch(texts)]
    return [SPECIAL_ID.to_bytes(4, "little").join(own.encode_batch(t.split(SPECIAL))) + end for t in texts]


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all but the first are full."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def _pieces(own: Codec, doc_id: object, ids: bytes) -> Iterator[tuple]:
    for k, (start, length) in enumerate(cut(len(ids) // 4)):
        yield doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])


def _pieces_with_ids(own: Codec, doc_id: object, ids: bytes) -> Iterator[tuple]:
    for row in _pieces(own, doc_id, ids):
        yield *row, np.frombuffer(ids, "<u4", row[3], 4 * row[2]).tolist()


def pieces(docs: DataFrame, with_ids: bool = False, rank_file: str | None = None) -> DataFrame:
    """The pieces of each document, of at most CAPACITY ids with the end id last; with their ids if asked."""
    return map_texts(docs, _pieces_with_ids if with_ids else _pieces, PIECES + ", ids array<int>" * with_ids, rank_file, token_ids)


def place(parts: DataFrame, packing: list[tuple[Pattern, int]]) -> DataFrame:
    """parts with sequence_id and offset. parts is read twice and must come from a stored table.

    The places of a length are a run of ranks for each pattern that uses it: a table whose size depends on the capacity
    alone. Ranks within a length are dealt over salts, so a common length is no single task's work; their table has a row
    for about each RANK_ROWS pieces, RANK_SHARE and one for each length.
    """
    spark, runs, used, first = parts.sparkSession, [], Counter(), 0
    for pattern, repeats in packing:
        offset = 0
        for size, k in pattern:
            runs.append((size, used[size], used[size] + k * repeats, k, first, offset))
            used[size] += k * repeats
            offset += k * size
        first += repeats
    table = spark.createDataFrame(runs, "length long, low long, high long, each int, first long, at long")
    # as many salts for a length as its pieces need; equal pieces of different tasks have different ones
    each_task = max(1, min(RANK_ROWS, sum(used.values()) // RANK_SHARE))
    n_salts = spark.createDataFrame([(size, 1 + n // each_task) for size, n in used.items()], "length long, n_salts long")
    tie = F.xxhash64("doc_id", "piece", "start", "ids_crc32", TASK)
    salted = parts.join(F.broadcast(n_salts), "length").withColumn("salt", F.pmod(tie, F.col("n_salts")))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    totals = salted.groupBy("length", "salt").count()
    bases = totals.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("own", own).join(F.broadcast(bases), ["length", "salt"]).withColumn("rank", F.col("base") + F.col("own"))
    run = F.broadcast(table)
    placed = ranked.join(run, (ranked.length == run.length) & (ranked["rank"] >= run.low) & (ranked["rank"] < run.high)).drop(run.length)
    step = F.col("rank") - F.col("low")
    spot = F.expr("first + (rank - low) div each").alias("sequence_id"), (F.col("at") + step % F.col("each") * F.col("length")).alias("offset")
    return placed.select(*[F.col(c) for c in parts.columns if c != TASK], *spot)


def pack(docs: DataFrame, capacity: int = CAPACITY, rank_file: str | None = None) -> DataFrame:
    """Each piece of each document with its sequence and its place there; the ids are in pieces(with_ids=True)."""
    parts = stored(pieces(docs, rank_file=rank_file).withColumn(TASK, F.spark_partition_id()), "pieces")
    histogram = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}
    return place(parts, bin_completion(histogram, capacity))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
