"""Near-duplicates by SimHash fingerprints, joined in an embedding of segment bit counts.

A fingerprint's 64 bits are cut into 32 segments; the numbers of bits in the segments embed it as a point whose
Manhattan distance to another point is at most the fingerprints' Hamming distance.  With the counts 0, 1, 2 written
as 00, 01, 11, a point is a 64-bit number and the Manhattan distance of two points is the count of bits in which they differ.

The grid has 8 axes of 4 segments.  A range of 4 in Manhattan distance leaves at least 4 axes untouched, so the range join
becomes equi-joins: each point is put into one cell for each of the 70 choices of 4 axes, and only points that share a
cell (by a 64-bit hash of it) are compared: always by the Manhattan bound first, then by the fingerprints themselves.  Cells are nearly as
selective as 24 random bits, so unrelated points rarely meet.  Equal fingerprints are one point, whatever the number of
copies.

A cell of two points is decided from its smallest and largest member.  Larger cells are cut by hash into blocks of about
``BLOCK`` points; each pair of blocks is one bounded piece of work, which returns at most one link per point (to the
smallest point it reaches there) instead of all pairs; a point of a cell of n is copied n / ``BLOCK`` times.  The components
are those of all links within the distance; a node starts with its smallest doc_id, so a component's root is its name.

Edge cases: a null or empty text has fingerprint 0, linked like any other; fewer words than a shingle make one shingle
of them all; texts of any length are read whole; a bit set in just half the shingles is 0; a null doc_id takes part but
never names a component (null if there is no other); repeated rows are returned as often as they occur; an empty table
gives an empty result; more columns are dropped, whatever their names (``keep_one`` returns them as they are).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, scope, sifted
from .components import components

SHINGLE, DISTANCE, AXES, BLOCK, SEED = 4, 4, 8, 1024, 42


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """The hashes of all shingles of a text; of no words, that of the empty one."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # of bytes: A-Z, and the six white-space characters of the word rule
    if not words:
        return np.array([xxh64_intdigest(b"", SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    data, n = b" ".join(words), max(1, len(words) - shingle + 1)
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    return np.fromiter((xxh64_intdigest(data[a:b], SEED) for a, b in zip(starts, ends[len(words) - n :].tolist(), strict=True)), np.uint64, n)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text, as a signed 64-bit number."""
    if not (text or "").encode().split():
        return 0
    return fingerprint_of(shingle_hashes(text, shingle))


def fingerprint_of(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    n = len(hashes)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 255):  # a byte holds the count
        bits = np.unpackbits(hashes[at : at + 255].byteswap().view(np.uint8).reshape(-1, 8), axis=1)
        ones += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = pa.array((fingerprint(t.as_py(), shingle) for t in batch.column(1)), pa.int64(), size=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), fp], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, "doc_id long, fp long")


def point(fp: Column) -> Column:
    """The embedding: per segment of two bits its count, written in unary."""
    odd = F.lit(0x5555555555555555)
    other = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(other).bitwiseAND(odd).bitwiseOR(F.shiftleft(fp.bitwiseAND(other).bitwiseAND(odd), 1))


def masks(distance: int = DISTANCE, axes: int = AXES) -> list[int]:
    """Signed 64-bit masks of every choice of ``axes - distance`` axes."""
    width = 64 // axes
    one = [((1 << width) - 1) << width * i for i in range(axes)]
    return [m - (1 << 64) if m >> 63 else m for m in map(sum, combinations(one, axes - distance))]


def _points(fp: np.ndarray) -> np.ndarray:
    """``point`` of an array."""
    x = fp.view(np.uint64)
    odd = np.uint64(0x5555555555555555)
    other = x >> np.uint64(1)
    return ((x | other) & odd) | ((x & other & odd) << np.uint64(1))


def _near(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    """Which fingerprints are within the distance: those that pass the bound of their points are compared exactly."""
    near = np.bitwise_count(_points(a)[:, None] ^ _points(b)[None, :]) <= distance
    i, j = np.nonzero(near)
    near[i, j] = np.bitwise_count((a[i] ^ b[j]).view(np.uint64)) <= distance
    return near


def _forest(a: np.ndarray, b: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links from points of two sorted sets of fingerprints to the smallest one that they reach through pairs (a, b)."""
    near = _near(a, b, distance)
    la, lb = a.copy(), b.copy()
    most = np.iinfo(np.int64).max
    while True:
        na = np.minimum(la, np.where(near, lb[None, :], most).min(axis=1))
        nb = np.minimum(lb, np.where(near, na[:, None], most).min(axis=0))
        if np.array_equal(na, la) and np.array_equal(nb, lb):
            break
        la, lb = na, nb
    fp, root = np.concatenate((a, b)), np.concatenate((la, lb))
    return fp[fp != root], root[fp != root]


def _cells(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Rows of (cell, i, j, block, fp), sorted: links within each (cell, i, j)."""
    held: list[np.ndarray] = []

    def work(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left = rows[rows[:, 3] == rows[0, 1], 4]
        right = left if rows[0, 1] == rows[0, 2] else rows[rows[:, 3] == rows[0, 2], 4]
        return _forest(left, right, distance)

    def out(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        edges = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1
        parts = [work(x) for x in np.split(rows, edges) if len(x) > 1]
        if parts:
            a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(np.stack([c.to_numpy().astype(np.int64) for c in batch.columns], axis=1))
        rows = np.concatenate(held)
        last = np.flatnonzero((rows[:, :3] != rows[-1, :3]).any(axis=1))
        keep = last[-1] + 1 if len(last) else 0  # the last group may go on in the next batch
        if keep:
            yield from out(rows[:keep])
        held = [rows[keep:]]
    if held:
        yield from out(np.concatenate(held))


def links(fps: DataFrame, distance: int = DISTANCE, axes: int = AXES, block: int = BLOCK) -> DataFrame:
    """``a, b``: links that join all fingerprints (column ``fp``, distinct) within the distance, without listing all pairs."""
    all_masks = F.array(*map(F.lit, masks(distance, axes)))
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # By another hash than that of a group-by on fp, whose partitions would be kept however few they are.
    spread = fps.repartition(parts, F.xxhash64(F.lit("spread"), "fp")).select("fp", F.posexplode(all_masks).alias("mask", "bits"))
    points = spread.select("fp", F.xxhash64("mask", point(F.col("fp")).bitwiseAND(F.col("bits"))).alias("cell"))
    cells = cut(points.groupBy("cell").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1"))
    differ = lambda x, y: F.bit_count(x.bitwiseXOR(y))
    a, b = F.col("a"), F.col("b")
    pairs = cells.filter("n = 2").filter(differ(point(a), point(b)) <= distance).filter(differ(a, b) <= distance).select("a", "b")
    blocks = F.ceil(F.col("n") / block).cast("int")
    large = cells.filter("n > 2")
    members = sifted(points, large, "cell").join(large.select("cell", blocks.alias("blocks")), "cell")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = members.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys = ["cell", "i", "j"]
    work = dealt.select("cell", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "fp").repartition(*keys).sortWithinPartitions(*keys, "fp")
    return pairs.unionAll(work.mapInArrow(lambda x: _cells(x, distance), "a long, b long"))


def roots(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``fp, root`` of every fingerprint (column ``fp``, distinct): the smallest fingerprint of its component."""
    found = components(links(fps, distance), "a", "b").withColumnRenamed("node", "fp")
    return fps.join(found, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def groups(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``doc_id, fp, component_id`` from ``doc_id, fp``."""
    ids = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("id")))
    with scope():
        found = cut(links(ids.select("fp"), distance).distinct())
        node = F.struct(F.col("id").isNull().alias("none"), "id", "fp")
        end = lambda side: ids.select(F.col("fp").alias(side), node.alias(f"{side}_node"))
        joined = components(found.join(end("a"), "a").join(end("b"), "b"), "a_node", "b_node")
        named = joined.select("node.fp", F.col("root.id").alias("component_id"))
        named = cut(ids.join(named, "fp", "left").select("fp", F.coalesce("component_id", "id").alias("component_id")), keep=True)
    return fps.join(named, "fp")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``doc_id, fingerprint`` (16 hexadecimal digits), ``component_id`` of every row of ``docs``."""
    out = groups(cut(fingerprints(docs, shingle)), distance)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row for each component, with all its columns: the smallest id (null last), of equal ids the smallest fingerprint.

    Components are told apart by their roots, not by their ids: texts without an id, or under the same one, don't replace
    each other.  Of rows equal in both, the first of the table as it is read stays.
    """
    printed = cut(_with_fingerprint(docs, shingle).withColumn("__row", F.monotonically_increasing_id()))
    with scope():
        first = first_rows(printed, "__fp")
        rooted = roots(first.select(F.col("__fp").alias("fp")), distance).withColumnRenamed("fp", "__fp")
        chosen = cut(chosen_rows(first, rooted, "__fp"), keep=True)
    return printed.join(chosen, "__row", "left_semi").select(*docs.columns)


def first_rows(rows: DataFrame, node: str) -> DataFrame:
    """Each node's first row by ``doc_id`` (null last), node and ``__row``: ``node, first``."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(node).alias("node"), "__row")
    return cut(rows.groupBy(node).agg(F.min(order).alias("first")))


def chosen_rows(first: DataFrame, rooted: DataFrame, node: str) -> DataFrame:
    """``__row`` of the first row of each root."""
    return first.join(rooted, node).groupBy("root").agg(F.min("first").alias("first")).select("first.__row")


def _with_fingerprint(docs: DataFrame, shingle: int) -> DataFrame:
    """All columns and ``__fp``."""
    fp = F.pandas_udf(lambda texts: texts.map(lambda t: fingerprint(t, shingle)).astype("int64"), "long")
    return docs.withColumn("__fp", fp(F.col("text")))
