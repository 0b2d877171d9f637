"""Best-fit packing by the configuration linear program over the length histogram.

A configuration is a multiset of lengths that fits a sequence; the program covers the demand of every
length with as few configurations as possible.  It is solved on the histogram, whose size is bounded
by the capacity: lengths of at least a SMALL-th of the capacity, in GROUPS groups at most, each counted
as its longest member.  Multiplicative weights move on both sides of the program, over the groups and
over the configurations known; a knapsack dynamic program prices new configurations under the groups'
weights, whose best price also bounds the number of sequences from below.  The fractional numbers of
copies are rounded down; real lengths take the places of their groups, and a second knapsack fills what
room they leave, of whatever lengths fill it best.  What is left, and shorter pieces, is packed best-fit
into the room of these sequences and new ones.  Where plain best fit needs fewer sequences (lengths that
lose more by being grouped than the program gains), its result is taken.

The documents themselves never meet in one place: a piece gets its rank among the pieces of its
length, and a table of runs of ranks, as large as the configurations at most, gives the sequence
and the place in it.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Memo, stored

#: Groups of lengths in the program at most; the part of the capacity from which a length is in it.
GROUPS, SMALL = 64, 32
#: Rounds of pricing at most; steps of the weights in a round; their rate; gap to the bound at which the program is solved.
ROUNDS, STEPS, RATE, GAP = 40, 2_000, 4.0, 0.0003

# ---- ids ------------------------------------------------------------------------------------------

#: Characters for which FAST and str.lower() do what the vocabulary's own normaliser and splitter do.
PLAIN = re.compile("[^\x00-\x7f\xc0-\xd6\xd8-\xf6\xf8-įı-ſ]")
LETTER = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-ſ"
FAST = re.compile(rf"'(?:[stmd]|re|ve|ll)|[{LETTER}]++|[0-9]|[^\t-\r {LETTER}0-9]++")


class WordIds:
    """Ids of texts, as little-endian unsigned 32-bit integers, by a tokenizers file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.special = re.compile("|".join(re.escape(t.content) for t in self.model.get_added_tokens_decoder().values()) or "(?!)")
        # words may be encoded one by one where splitting drops white space, and then in the model alone
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_names = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in printable)}
        sample = "Ab é's 12 ..a\x1c\n'll x_y"
        whole = self.model.encode(sample, add_special_tokens=False).ids
        parts = [t.id for w in FAST.findall(sample.lower()) for t in self.model.model.tokenize(w.encode().decode("latin-1").translate(byte_names))]
        self.by_word = whole == parts
        tokenize = self.model.model.tokenize
        self.words = Memo(lambda w: np.array([t.id for t in tokenize(w.encode().decode("latin-1").translate(byte_names))], "<u4").tobytes(), 300_000)

    def __call__(self, text: str) -> bytes:
        if not self.by_word or PLAIN.search(text) or self.special.search(text):
            return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.words.__getitem__, FAST.findall(text.lower())))


@lru_cache(2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


# ---- configurations -------------------------------------------------------------------------------


def priced(weights: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack over rising lengths with repetition: the best weight for each capacity, and the length to take first (-1: a unit stays empty, 0: nothing fits).

    What is left after a first length is at least the least length shorter, so that many capacities are found at once.
    """
    best, take, block = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64), int(lengths[0])
    for start in range(block, capacity + 1, block):
        stop = min(start + block, capacity + 1)
        k = int(np.searchsorted(lengths, stop - 1, "right"))
        room = np.arange(start, stop)[:, None] - lengths[:k][::-1]
        values = np.where(room < 0, -1.0, best[np.maximum(room, 0)] + weights[:k][::-1])
        i = values.argmax(1)
        values = values[np.arange(stop - start), i]
        upto = np.maximum.accumulate(np.append(best[start - 1], values))
        best[start:stop], take[start:stop] = upto[1:], np.where(values > upto[:-1] + 1e-12, lengths[k - 1 - i], -1)
    return best, take


def best_fit(left: np.ndarray, capacity: int, runs: list = ()) -> list[tuple[tuple[int, ...], int]]:
    """Configurations and copies: `runs`, with demands `left` put in by falling length, each into the fullest sequence with room for it, or a new one."""
    rooms: dict[int, list] = {}
    order: list[int] = []
    full = []

    def put(items, copies, room):
        if copies and not room:
            full.append((items, copies))
        elif copies:
            if room not in rooms:
                rooms[room] = []
                insort(order, room)
            rooms[room].append((items, copies))

    for items, copies in runs:
        put(items, copies, capacity - sum(items))
    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            at = bisect_left(order, length)
            if at < len(order):
                room = order[at]
                items, copies = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room], order[at]
            else:
                room, items, copies = capacity, (), n
            each = min(room // length, n)
            whole = min(copies, n // each)
            if items:
                put(items, copies - whole, room)
            put(items + (length,) * each, whole, room - each * length)
            n -= whole * each
    return full + [run for found in rooms.values() for run in found]


def grouped(demand: np.ndarray, capacity: int, groups: int = GROUPS) -> tuple[np.ndarray, np.ndarray]:
    """The lengths of the program, rising, and the group of each: one each if they are few, else groups of like total length."""
    lengths = np.flatnonzero(demand)
    lengths = lengths[lengths * SMALL >= capacity]
    if len(lengths) <= groups:
        return lengths, np.arange(len(lengths))
    mass = (demand[lengths] * lengths).astype(float)
    group = np.minimum((np.cumsum(mass) - mass / 2) * groups // mass.sum(), groups - 1)
    return lengths, np.unique(group, return_inverse=True)[1]


def program(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Configurations (a row of copies of each size), fractional numbers of them that cover `demand`, and the sizes' dual weights.

    The sum of demand times weight over the best price of a configuration is a lower bound of the numbers' sum.
    """
    n, place = len(sizes), {int(x): i for i, x in enumerate(sizes)}
    known: dict[tuple, None] = {}

    def add(items):
        known.setdefault(tuple(np.bincount([place[x] for x in items], minlength=n).tolist()))

    start = np.zeros(capacity + 1, np.int64)
    start[sizes] = demand
    for items, _ in best_fit(start, capacity):
        add(items)
    p = demand * sizes / (demand * sizes).sum()  # the demand's weights; a size's price is its weight over its demand
    q, bound, firm, least_sum, best_q = np.zeros(0), 0.0, p, np.inf, np.zeros(0)
    for _ in range(ROUNDS):
        for mixed in (p, (p + firm) / 2):  # the weights found, and half way to those of the best bound so far
            best, take = priced(mixed / demand, sizes, capacity)
            if 1 / best[capacity] > bound:
                bound, firm = 1 / best[capacity], mixed
            for i, first in enumerate(sizes.tolist()):
                if mixed[i] / demand[i] + best[capacity - first] < 0.99 * best[capacity]:
                    continue
                items, room = [first], capacity - first
                while room > 0 and take[room]:
                    if take[room] < 0:
                        room -= 1
                    else:
                        items.append(int(take[room]))
                        room -= int(take[room])
                add(items)
        cover = np.array(list(known), float).T / demand[:, None]
        fresh = cover.shape[1] - len(q)
        q = np.append(q * (0.98 if fresh else 1), np.full(fresh, (0.02 if len(q) else 1) / max(1, fresh)))
        q = np.maximum(q, 1e-9) / np.maximum(q, 1e-9).sum()
        gain = cover * bound  # about 1 at the solution
        rate, sum_p, sum_q = RATE / gain.max(), np.zeros(n), np.zeros(len(q))
        last_p, last_q = gain @ q, gain.T @ p
        for step in range(1, STEPS + 1):
            now_p, now_q = gain @ q, gain.T @ p
            p, q = p * np.exp(-rate * (2 * now_p - last_p)), q * np.exp(rate * (2 * now_q - last_q))
            p, q, last_p, last_q = p / p.sum(), q / q.sum(), now_p, now_q
            sum_p, sum_q = sum_p + p, sum_q + q
            if step & (step - 1) == 0 and step > 32:  # the known configurations' own gap, of what was gathered since the last look
                if (gain.T @ sum_p).max() <= (gain @ sum_q).min() * (1 + GAP / 4):
                    break
                if step < STEPS // 2:
                    sum_p, sum_q = np.zeros(n), np.zeros(len(q))
        p = sum_p / sum_p.sum()
        q = max((sum_q / sum_q.sum(), q), key=lambda x: (cover @ x).min())
        if 1 / max((cover @ q).min(), 1e-12) < least_sum:  # a round may end farther off than one before
            least_sum = 1 / (cover @ q).min()
            best_q = q * least_sum
        if least_sum <= bound * (1 + GAP):
            break
    return np.array(list(known)), np.append(best_q, np.zeros(len(known) - len(best_q))), firm / demand


def filling(left: np.ndarray, room: int) -> list[int]:
    """Lengths of `left` with the largest sum that is at most `room`, by a knapsack of sums whose sets are bits; longer ones first."""
    sums, steps = 1, []
    for length in np.flatnonzero(left[: room + 1])[::-1].tolist():
        for _ in range(min(int(left[length]), room // length)):
            more = sums | (sums << length) & ((2 << room) - 1)
            if more == sums:
                break
            steps.append((sums, length))
            sums = more
            if sums >> room:
                break
        if sums >> room:
            break
    at, out = sums.bit_length() - 1, []
    for before, length in reversed(steps):
        if not before >> at & 1:
            out.append(length)
            at -= length
    return out


def rounded(table: np.ndarray, copies: np.ndarray, lengths: np.ndarray, group: np.ndarray, left: np.ndarray, capacity: int, open_end: bool) -> list[tuple[tuple[int, ...], int]]:
    """Runs of configurations of real lengths for whole numbers of copies, rounded down; what they hold is taken from `left`.

    A group's place takes its longest length left, and `filling` the room that these leave: lengths that
    are shorter than their group's longest lose nothing by it where others fit in.  With an open end,
    `filling` also takes the place of the shortest group where that holds several lengths.
    """
    stock = [lengths[group == i].tolist() for i in range(table.shape[1])]  # taken from the end: the longest first
    out = []

    def longest(k):
        while stock[k] and not left[stock[k][-1]]:
            stock[k].pop()
        return stock[k][-1] if stock[k] else 0

    for i in np.argsort(-copies, kind="stable"):
        places = np.repeat(np.arange(table.shape[1]), table[i])[::-1].tolist()
        if open_end and len(stock[places[-1]]) > 1:
            places.pop()
        n = int(np.floor(copies[i] + 1e-6))
        while n > 0:
            items: list[int] = []
            while len(items) < len(places) and (length := longest(places[len(items)])):
                items.append(length)
                left[length] -= 1
            if len(items) < len(places):
                np.add.at(left, items, 1)
                break
            more = filling(left, capacity - sum(items))
            np.subtract.at(left, more, 1)
            items += more
            used = Counter(items)
            alike = min(n, 1 + min(int(left[x]) // c for x, c in used.items()))
            for x, c in used.items():
                left[x] -= (alike - 1) * c
            out.append((tuple(items), alike))
            n -= alike
    return out


def by_program(demand: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Configurations and whole numbers of copies that cover `demand[length]` exactly, from the program, rounded with or without open ends."""
    demand = np.asarray(demand, np.int64)
    lengths, group = grouped(demand, capacity)
    if not len(lengths):
        return best_fit(demand, capacity)
    sizes = np.array([lengths[group == i].max() for i in range(group[-1] + 1)])
    table, copies, _ = program(sizes, np.bincount(group, demand[lengths]), capacity)

    def whole(open_end):
        left = demand.copy()
        return best_fit(left, capacity, rounded(table, copies, lengths, group, left, capacity, open_end))

    return min(whole(True), whole(False), key=lambda runs: sum(n for _, n in runs))


def configurations(demand: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """The program's configurations and numbers of copies, never more of them than best fit takes."""
    return min(by_program(demand, capacity), best_fit(np.asarray(demand, np.int64), capacity), key=lambda runs: sum(n for _, n in runs))


def least(demand: np.ndarray, capacity: int) -> int:
    """A lower bound of the number of sequences: the total length, the lengths of over half a sequence, or the program's dual weights over the dearest configuration of real lengths."""
    demand = np.asarray(demand, np.int64)
    bound = max((demand * np.arange(len(demand))).sum() / capacity, demand[capacity // 2 + 1 :].sum())
    lengths, group = grouped(demand, capacity)
    if len(lengths):
        sizes = np.array([lengths[group == i].max() for i in range(group[-1] + 1)])
        _, _, weights = program(sizes, np.bincount(group, demand[lengths]), capacity)
        best, _ = priced(weights[group], lengths, capacity)
        bound = max(bound, (demand[lengths] * weights[group]).sum() / best[capacity])
    return int(np.ceil(bound - 1e-6))


# ---- documents ------------------------------------------------------------------------------------


def pieces(docs: DataFrame, path: str, capacity: int, end: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, _part, _nth: the documents' ids with `end` behind them, cut only where longer than `capacity`.

    _part, _nth: the partition, and the number of the piece among those of its length there.
    """

    def run(batches):
        from pyspark import TaskContext

        ids_of, last, seen, part_id = word_ids(path), np.array([end], "<u4").tobytes(), Counter(), TaskContext.get().partitionId()
        for batch in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = ids_of(text or "") + last
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    length = len(part) // 4
                    for column, value in zip(rows, (doc_id, piece, at // 4, length, zlib.crc32(part), seen[length])):
                        column.append(value)
                    seen[length] += 1
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), *(pa.array(c, pa.int64()) for c in rows[2:5]), pa.array([part_id] * len(rows[0]), pa.int32()), pa.array(rows[5], pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32", "_part", "_nth"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, _part int, _nth long")


def packed(parts: DataFrame, capacity: int) -> DataFrame:
    """sequence_id and offset of the rows of `pieces`, in a stored table; repeated rows are packed one by one.

    A piece's rank among those of its length is its number in its partition and the numbers of such pieces
    in the partitions before: nothing is sorted, and a length of very many pieces is no group of one task.
    """
    spark = parts.sparkSession
    counts = stored(parts.groupBy("length", "_part").agg(F.count("*").alias("_n")), "lengths")
    demand = np.zeros(capacity + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("_n")).collect():  # as many rows as the capacity at most
        demand[length] = n
    keys, first, offsets, sequence, ranks = [], [], [], 0, np.zeros(capacity + 1, np.int64)
    for items, copies in configurations(demand, capacity):
        place = 0
        for length in items:
            keys.append((length << 40) + int(ranks[length]))
            first.append(sequence)
            offsets.append(place)
            ranks[length] += copies
            place += length
        sequence += copies
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    table = spark.sparkContext.broadcast(tuple(np.array(x, np.int64)[order] for x in (keys, first, offsets)))

    def placed(batches):
        keys, first, offsets = table.value
        for batch in batches:
            if batch.num_rows:
                key = (batch.column("length").to_numpy() << 40) + batch.column("_rank").to_numpy()
                at = np.searchsorted(keys, key, "right") - 1
                kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(first[at] + key - keys[at]), pa.array(offsets[at])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = stored(counts.select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from")), "starts")
    ranked = parts.join(starts, ["length", "_part"]).withColumn("_rank", F.col("_nth") + F.col("_from"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("_rank").cast("long").alias("_rank")).mapInArrow(placed, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, path: str, capacity: int = 4096, end: int = 1) -> DataFrame:
    """Pieces of all documents and their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Special strings in a text are what the vocabulary takes them for.  A null or empty text is the end id
    alone.  Without documents there are no rows.
    """
    return packed(stored(pieces(docs, path, capacity, end), "pieces"), capacity)


def op6_packing(spark, sf_dir: str) -> DataFrame:
    """pack of all documents into sequences of 4096 tokens; a null text is the end id alone."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
