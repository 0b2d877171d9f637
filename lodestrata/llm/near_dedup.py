"""Near-duplicates by SetSketch registers.

Every element of a set gets, for m registers, the ascending points of a Poisson-like process whose
spacings are exponential (rate m - j + 1 before the j-th point), dealt to the registers in an order
of its own; a register keeps the least point it gets, truncated to an integer power of 1/b.
Registers of unions are the maxima of truncated values, so sketches merge; two registers agree
with a probability close to the Jaccard similarity, so bands of registers find similar sets; and the
counts of larger, smaller and equal registers give a joint likelihood of the similarity, which
prunes candidates before the sets themselves are compared.

Sets that are equal are one class, represented by its least id, before anything is compared.  In a
bucket of a band, members are compared with one centre, in a few rounds with different centres.  The
members of buckets that are still in several components then go through an exact join on the rare
ends of their sets, so no pair that shares a bucket is left out, unless its members are in one
component already, and no bucket is expanded into its pairs; in the join, sets that hold a rare element
meet only if they are in different components and one of them is outside the element's commonest one.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored
from .components import components
from .shingles import GOLDEN, mixed, shingle_set

#: Registers (a prime: the order of registers of an element is an arithmetic progression), base and scale.
M, BASE, SCALE = 251, 1.001, 20.0
#: Registers in a band; bands.  A pair of similarity 0.8 is in no bucket of 41 bands of 6 with probability 4e-6.
ROWS, BANDS = 6, 41
#: Standard deviations of the estimate below the bound at which a candidate is not compared: 1 in 10**9 links is lost.
DEVIATIONS = 6
#: Elements sketched at a time.
CHUNK = 400_000


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Registers of each set: uint16, one row of M for each; 0 throughout for an empty set."""
    least = np.full((len(sets), M), np.inf)
    flat = least.reshape(-1)
    if not sets or not (size := sum(map(len, sets))):
        return np.zeros((len(sets), M), np.uint16)
    elements = np.concatenate(sets)
    home = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    seed = mixed(elements + GOLDEN)
    place, step = (seed % np.uint64(M)).astype(np.int64), (seed >> np.uint64(32)).astype(np.int64) % (M - 1) + 1
    point = np.zeros(size)
    for j in range(M):
        seed = seed + GOLDEN
        uniform = ((mixed(seed) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        point = point - np.log(uniform) / (M - j)
        np.minimum.at(flat, home * M + place, point)
        if j < 4 or j % 4 == 0:
            live = point <= least.max(axis=1)[home]
            if not live.any():
                break
            seed, place, step, point, home = seed[live], place[live], step[live], point[live], home[live]
        place = (place + step) % M
    with np.errstate(divide="ignore"):
        out = np.floor(1 - np.log(least / SCALE) / np.log(BASE))
    return np.clip(np.where(np.isfinite(least), out, 0), 0, 65535).astype(np.uint16)


def merged(*registers: np.ndarray) -> np.ndarray:
    """Registers of the union of the sets; sets of more than CHUNK elements are sketched in parts."""
    return np.maximum.reduce(registers)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each row."""
    parts = registers[:, : ROWS * BANDS].astype(np.uint64).reshape(len(registers), BANDS, ROWS)
    key = np.broadcast_to(mixed(np.arange(1, BANDS + 1, dtype=np.uint64) * GOLDEN), parts.shape[:2])
    for i in range(ROWS):
        key = mixed(key * GOLDEN + parts[:, :, i])
    return key.view(np.int64)


#: Similarities among which the likeliest is taken.
GRID = np.linspace(0.0, 1.0, 201)


def estimates(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The likeliest Jaccard similarity of pairs of sets of known sizes, from the order of their registers."""
    more, less = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    u, v = (n_a / (n_a + n_b))[:, None], (n_b / (n_a + n_b))[:, None]
    j = GRID[None, :]

    def ahead(x):
        return -np.log(np.clip(1 - x * (BASE - 1) / BASE, 1e-300, None)) / np.log(BASE)

    p, q = ahead(np.clip(u - v * j, 0, 1)), ahead(np.clip(v - u * j, 0, 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        total = np.where(more > 0, more * np.log(p), 0) + np.where(less > 0, less * np.log(q), 0) + np.where(M - more - less > 0, (M - more - less) * np.log(np.clip(1 - p - q, 0, 1)), 0)
    total = np.where((j <= np.minimum(u / v, v / u) + 1e-9), total, -np.inf)
    return GRID[np.nanargmax(total, axis=1)]


def sketched(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n (size of the shingle set), digest of the set, registers."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            at = 0
            while at < len(texts):
                sets, size, first = [], 0, at
                while at < len(texts) and size < CHUNK:
                    found = shingle_set(texts[at], k)
                    if sets and len(found) > CHUNK:
                        break  # a long text is sketched by itself
                    sets.append(found)
                    size += len(found)
                    at += 1
                registers = sketches(sets) if len(sets) > 1 or size <= CHUNK else merged(*(sketches([sets[0][i : i + CHUNK]]) for i in range(0, size, CHUNK)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[first:at], pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()), pa.array([x.tobytes() for x in registers], pa.binary())],
                    ["doc_id", "n", "digest", "registers"],
                )

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id long, n long, digest binary, registers binary")


def banded(reps: DataFrame) -> DataFrame:
    """A row (key, id, n) for each band of each representative."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                keys = band_keys(np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint16).reshape(-1, M))
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), *(pa.array(np.repeat(batch.column(c).to_numpy(), BANDS)) for c in ("id", "n"))], ["key", "id", "n"])

    return reps.select("id", "n", "registers").mapInArrow(run, "key long, id long, n long")


def compared(pairs: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) of ids that are linked.

    reps: id, n, registers; sets: id, elements (the sorted set). Pairs whose likeliest similarity is far
    below the bound go by their registers; the sets of all others follow, and 100 * intersection >=
    percent * union decides. A node of very many pairs is on one side of plain joins of stored tables,
    whose partitions Spark splits.
    """
    bound = percent / 100
    least = bound - DEVIATIONS * np.sqrt(bound * (1 - bound) / M)

    def likely(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, M) for c in ("ra", "rb"))
                near = pa.array(estimates(x, y, batch.column("na").to_numpy(), batch.column("nb").to_numpy()) >= least)
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(near), batch.column("b").filter(near)], ["a", "b"])

    def exact(batches):
        for batch in batches:
            near, ea, eb = np.zeros(batch.num_rows, bool), batch.column("ea"), batch.column("eb")
            for i in range(len(near)):
                u, v = np.frombuffer(ea[i].as_buffer(), np.uint64), np.frombuffer(eb[i].as_buffer(), np.uint64)
                both = len(np.intersect1d(u, v, assume_unique=True))
                near[i] = 100 * both >= percent * (len(u) + len(v) - both)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(near)), batch.column("b").filter(pa.array(near))], ["a", "b"])

    a, b = (reps.selectExpr(f"id as {i}", f"n as n{i}", f"registers as r{i}") for i in "ab")
    found = pairs.join(b, "b").join(a, "a").mapInArrow(likely, "a long, b long")
    a, b = (sets.selectExpr(f"id as {i}", f"elements as e{i}") for i in "ab")
    return found.join(b, "b").join(a, "a").mapInArrow(exact, "a long, b long")


def hooked(label: DataFrame | None, links: DataFrame) -> DataFrame:
    """label (id, component) after links: components hang on the least one linked to them, and on what that hangs on.

    Cheaper than full components, and as good for telling what is joined already: what it leaves apart is
    only compared once more.
    """
    if label is not None:
        links = links.join(label.selectExpr("id as a", "component as ca"), "a", "left").join(label.selectExpr("id as b", "component as cb"), "b", "left")
        links = links.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    up = links.where("a <> b").groupBy(F.greatest("a", "b").alias("id")).agg(F.min(F.least("a", "b")).alias("component"))
    for _ in range(2):
        next_ = up.selectExpr("id as component", "component as higher")
        up = up.join(next_, "component", "left").select("id", F.coalesce("higher", "component").alias("component"))
    if label is None:
        return stored(up, "labels")
    moved = label.join(up.selectExpr("id as component", "component as higher"), "component", "left").select("id", F.coalesce("higher", "component").alias("component"))
    return stored(moved.unionByName(up.join(label.select("id"), "id", "left_anti")), "labels")


def shared_prefixes(open_: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of open_ (id, component) in different components that may be linked, none of the linked ones left out.

    Elements are put in order of the number of sets that hold them. Of two linked sets, the first elements
    of the larger one, all but as many as the overlap must have, meet those of the smaller one, which
    needs fewer still; what is behind the place where they meet bounds the overlap. In the sets of an
    element, all pairs are of one in the commonest component and one outside it, or both outside.
    """
    t = percent / 100
    sets = full.withColumn("n", (F.length("elements") / 8).cast("long")).join(open_, "id")

    def exploded(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                e = np.frombuffer(batch.column("elements")[i].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(e), *(pa.array(np.full(len(e), batch.column(c)[i].as_py())) for c in ("id", "n", "component"))], ["element", "id", "n", "component"])

    rows = stored(sets.select("id", "n", "component", "elements").mapInArrow(exploded, "element long, id long, n long, component long"), "elements")
    often = rows.groupBy("element").agg(F.count("*").alias("df")).where("df > 1")
    # the elements of one set alone come first, and meet none; stored, so that the rows of a common one may be split in the join
    often = stored(often, "frequencies")
    ranked = rows.join(often, "element").groupBy("id", "n", "component").agg(F.sort_array(F.collect_list(F.struct("df", "element"))).alias("e"))
    place = ranked.select("id", "n", "component", (F.col("n") - F.size("e")).alias("own"), F.posexplode("e").alias("i", "x"))
    place = place.select("id", "n", "component", F.col("x.element").alias("element"), (F.col("own") + F.col("i")).alias("at"))
    probe = F.col("n") - F.ceil(F.col("n") * F.lit(t) - 1e-9) + 1
    index = F.col("n") - F.ceil(F.col("n") * F.lit(2 * t / (1 + t)) - 1e-9) + 1
    place = stored(place.where(F.col("at") < probe).withColumn("short", F.col("at") < index), "prefixes")
    parts = place.groupBy("element", "component").agg(F.count("*").alias("c"))
    common = parts.groupBy("element").agg(F.max(F.struct("c", "component")).alias("top"), F.count("*").alias("k")).where("k > 1").select("element", F.col("top.component").alias("top"))
    dropped(rows, often)
    common, first = stored(common, "common"), place
    place = stored(place.join(common, "element").withColumn("out", F.col("component") != F.col("top")), "places")
    dropped(common, first)
    x, y = (place.selectExpr("element", f"id as {i}", f"n as n{i}", f"component as c{i}", f"at as p{i}", f"short as s{i}", f"out as o{i}") for i in "ab")
    fits = f"ca <> cb and (na < nb or na = nb and a < b) and sa and 100 * na >= {percent} * nb and least(na - pa, nb - pb) * {100 + percent} >= {percent} * (na + nb)"
    outside = x.where("oa and sa").join(y, "element").where(fits)
    inside = x.where("not oa and sa").join(y.where("ob"), "element").where(fits)
    pairs = outside.select("a", "b").unionByName(inside.select("a", "b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    out = stored(pairs, "pairs")
    dropped(place)
    return out


#: Rounds in which the members of a bucket are compared with one centre.
ROUNDS = 3


def near_duplicates(docs: DataFrame, k: int = 2, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    Documents are linked when their sets of k-word shingles have 100 * intersection >= percent * union
    (at least 1).  Null and empty texts and texts without words have no shingles, and are their own
    component.  Rows that share a doc_id are linked where one of their texts is; rows with a null one are
    their own component (null, not kept).
    """
    table = stored(sketched(docs, k), "sketches")
    reps = table.where("n > 0 and doc_id is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "n", "registers")).alias("r"))
    reps = stored(reps.selectExpr("r.doc_id as id", "r.n as n", "r.registers as registers", "digest"), "classes")
    bands = banded(reps)
    shared = bands.groupBy("key").agg(F.count("*").alias("members")).where("members > 1").select("key")
    members = stored(bands.join(shared, "key"), "buckets")

    def sets(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([shingle_set(x, k).tobytes() for x in batch.column("text").to_pylist()], pa.binary())], ["id", "elements"])

    texts = docs.selectExpr("cast(doc_id as bigint) id", "text").join(members.select("id").distinct(), "id", "left_semi")
    full = stored(texts.mapInArrow(sets, "id long, elements binary"), "sets")

    links, label, open_ = [], None, members.withColumn("component", F.col("id"))
    for round_ in range(ROUNDS + 1):
        scratch = []
        if label is not None:
            open_ = members.join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
            several = open_.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
            open_ = stored(open_.join(several, "key"), "open")
            scratch.append(open_)
        if round_ == ROUNDS:
            pairs = shared_prefixes(open_.select("id", "component").distinct(), full, percent)
            scratch.append(pairs)
        else:
            order = F.xxhash64("id", F.lit(round_)) if round_ else F.col("id")
            centre = open_.groupBy("key").agg(F.min(F.struct(order.alias("o"), F.col("id"), F.col("n"), F.col("component"))).alias("m")).selectExpr("key", "m.id as a", "m.n as na", "m.component as ca")
            pairs = open_.join(centre, "key").where(f"component <> ca and 100 * least(n, na) >= {percent} * greatest(n, na)")
            pairs = pairs.groupBy("id").agg(F.min("a").alias("a")) if not round_ else pairs.select("id", "a").distinct()
            pairs = pairs.select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b"))
        links.append(stored(compared(pairs, reps, full, percent), "links"))
        if round_ < ROUNDS:
            before, label = label, hooked(label, links[-1])
            scratch += [before] if before is not None else []
        dropped(*scratch)
    dropped(members, full, label)
    label = components(reduce(DataFrame.unionByName, links))
    dropped(*links)
    out = table.join(reps.select("digest", F.col("id").alias("class")), "digest", "left")
    out = out.join(label.withColumnRenamed("id", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    own = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def op3_near_dedup(spark, sf_dir: str) -> DataFrame:
    """near_duplicates of all documents by 2-word shingles and 80 percent; nulls and repeated rows as there."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
