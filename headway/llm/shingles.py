"""Near-duplicates by the Jaccard similarity of word shingles, exactly checked.

A text's shingles are those of ``simhash`` (same word rule), of ``SHINGLE`` words.  Two texts are linked if their sets of
shingles have a similarity of at least ``SIMILARITY``.  Candidates come from SimHash first: the fingerprints of the sets go through
the range join of ``simhash`` (segment bit counts, cells of agreeing axes, Manhattan bound, exact distance), and what it links
within ``DISTANCE`` bits is compared.  Fingerprints of texts at 0.8 differ in up to 13 of 64 bits and more, for which no grid is
selective (16 axes leave 3 to agree, 560 cells a point), so the pairs beyond that radius come from MinHash: ``BANDS`` bands
of ``ROWS`` minima.  A pair at 0.8 shares no band with a probability of 3 in a million.

Texts with the same set (by a 64-bit hash of it) are one node, whatever the number of copies.  Nodes that share a band are
a cell.  Cells of at most ``SMALL`` nodes give all their pairs; in larger ones each node is first compared with the
smallest.  The pairs by fingerprint and those of the first ``EARLY`` bands are compared first; of the others only those that these haven't joined yet,
so a family of near copies doesn't meet in every band again.  If a larger cell isn't one component by then, its nodes are cut by hash into blocks of about ``BLOCK``, and each
pair of blocks is one bounded piece of work, which compares all nodes not yet known to be connected and returns only
links that join something new.  So dense groups don't become all their pairs, and no pair of a cell is left out.

Edge cases: a null or empty text has one shingle, the empty one; fewer words than a shingle make one shingle of them all; null
ids and repeated rows as in ``simhash.keep_one``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, scope, sifted, without
from .components import components
from .simhash import DISTANCE, SEED, chosen_rows, fingerprint_of, first_rows, shingle_hashes
from .simhash import links as fingerprint_links

SHINGLE, SIMILARITY, BANDS, ROWS, EARLY, SMALL, BLOCK = 5, 0.8, 32, 5, 4, 8, 128
#: Multipliers (odd) and offsets of the hash functions whose minima are taken.
_MIX = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64)
_MIX[0] |= np.uint64(1)


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    return np.unique(shingle_hashes(text, shingle))


def bands(hashes: np.ndarray) -> list[int]:
    """One signed 64-bit number per band."""
    from xxhash import xxh64_intdigest

    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        np.minimum(least, (_MIX[0] * hashes[at : at + 1024] + _MIX[1]).min(axis=1), out=least)
    return [_signed(xxh64_intdigest(row.tobytes(), SEED)) for row in least.reshape(BANDS, ROWS)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets (sorted) have at least that similarity."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common >= similarity * (len(a) + len(b) - common)


def _with_bands(docs: DataFrame, shingle: int) -> DataFrame:
    """All columns, ``__node``, ``__bands`` and ``__fp``, the fingerprint of the set."""
    names = [*docs.columns, "__node", "__bands", "__fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            sets = [shingle_set(t.as_py(), shingle) for t in batch.column("text")]
            node = pa.array([_signed(xxh64_intdigest(s.tobytes(), SEED)) for s in sets], pa.int64())
            keys = pa.array([bands(s) for s in sets], pa.list_(pa.int64()))
            fps = pa.array(map(fingerprint_of, sets), pa.int64(), size=len(sets))
            yield pa.RecordBatch.from_arrays([*batch.columns, node, keys, fps], names)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("__node", T.LongType()), T.StructField("__bands", T.ArrayType(T.LongType())), T.StructField("__fp", T.LongType())]))


def by_fingerprint(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``a, b`` (a > b): candidates that join all nodes whose fingerprints are linked.  prints: ``node, fp`` (distinct nodes)."""
    least = cut(prints.groupBy("fp").agg(F.min("node").alias("least")))
    found = cut(fingerprint_links(least.select("fp"), distance).distinct())
    end = lambda side: least.select(F.col("fp").alias(side), F.col("least").alias(f"{side}_node"))
    near = found.join(end("a"), "a").join(end("b"), "b").select(F.greatest("a_node", "b_node").alias("a"), F.least("a_node", "b_node").alias("b"))
    return near.unionAll(prints.join(least, "fp").filter("node != least").select(F.col("node").alias("a"), F.col("least").alias("b")))


def _check(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of ``a, b`` that are similar."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            last, held = None, None  # rows of one b lie together
            good = np.zeros(len(f), bool)
            for k, (b, x, y) in enumerate(zip(f["b"], f["x"], f["y"], strict=True)):
                if b != last:
                    last, held = b, shingle_set(y, shingle)
                good[k] = similar(shingle_set(x, shingle), held, similarity)
            yield f.loc[good, ["a", "b"]]

    # By shuffles at every size: neither pairs nor texts have a bound that a broadcast could rely on.
    x, y = (texts.select(F.col("node").alias(k), F.col("text").alias(t)).hint("merge") for k, t in (("a", "x"), ("b", "y")))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInPandas(run, "a long, b long")


def _block_pair(f: pd.DataFrame, shingle: int, similarity: float) -> pd.DataFrame:
    """Links between the nodes of two blocks (or of one) that join what isn't connected yet."""
    f = f.sort_values("node")
    nodes, sides, known = f["node"].tolist(), f["block"].tolist(), f["root"].tolist()
    sets = [shingle_set(t, shingle) for t in f["text"]]
    up = {r: r for r in known}

    def find(r: int) -> int:
        while up[r] != r:
            up[r] = up[up[r]]
            r = up[r]
        return r

    one, found = f["i"].iloc[0] == f["j"].iloc[0], []
    for p in range(len(nodes)):
        for q in range(p):
            if (one or sides[p] != sides[q]) and find(known[p]) != find(known[q]) and similar(sets[p], sets[q], similarity):
                up[find(known[p])] = find(known[q])
                found.append((nodes[p], nodes[q]))
    return pd.DataFrame(found, columns=["a", "b"]).astype("int64")


def dealt(large: DataFrame, block: int) -> DataFrame:
    """``cell, i, j, block, node, root``: the nodes of the pairs of blocks of a cell that hold more than one root.  large: ``cell, node, root``.

    A root with many nodes in a cell has blocks of its own, the others share some.  Blocks of the root that has the most are not
    paired with each other, so a large group with a few strangers gives rows in proportion to its size.
    """
    sizes = cut(large.groupBy("cell", "root").agg(F.count("*").alias("m")))
    facts = sizes.groupBy("cell").agg(F.count("*").alias("roots"), F.max_by("root", F.struct("m", "root")).alias("first"), F.sum(F.when(F.col("m") < block, F.col("m")).otherwise(0)).alias("rest"))
    facts = cut(facts.filter("roots > 1").drop("roots"))
    own = F.concat_ws(":", F.lit("own"), "root", F.pmod(F.xxhash64("node"), F.ceil(F.col("m") / block)))
    shared = F.concat_ws(":", F.lit("shared"), F.pmod(F.xxhash64("root"), F.ceil(F.col("rest") / block)))
    rows = large.select("cell", "node", "root").join(facts, "cell").join(sizes, ["cell", "root"])
    rows = cut(rows.select("cell", "node", "root", "first", F.when(F.col("m") >= block, own).otherwise(shared).alias("block")))
    blocks = cut(rows.groupBy("cell", "block", "first").agg(F.min("root").alias("r"), F.max("root").alias("s")).withColumn("plain", (F.col("r") == F.col("s")) & (F.col("r") == F.col("first"))))
    side = lambda n: blocks.select("cell", F.col("block").alias(n), F.col("r").alias(f"r{n}"), F.col("s").alias(f"s{n}"), F.col("plain").alias(f"p{n}"))
    pairs = side("i").filter("not pi").join(side("j"), "cell").filter((F.col("pj") | (F.col("i") <= F.col("j"))) & (F.least("ri", "rj") != F.greatest("si", "sj"))).select("cell", "i", "j")
    asked = pairs.select("cell", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    return asked.join(rows.select("cell", "block", "node", "root"), ["cell", "block"])


def links(sigs: DataFrame, texts: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """``a, b``: links that join all similar nodes.  sigs: ``node, bands, fp`` (distinct); texts: ``node, text``."""
    # The lowest bit of a cell's hash says whether its band is one of the later ones.
    late = F.when(F.col("band") < EARLY, F.lit(0)).otherwise(F.lit(1)).cast("long")
    points = sigs.select("node", F.posexplode("bands").alias("band", "least")).select("node", F.xxhash64("band", "least").bitwiseAND(F.lit(-2)).bitwiseOR(late).alias("cell"))
    cells = cut(points.groupBy("cell").agg(F.count("*").alias("n"), F.min("node").alias("least"), F.max("node").alias("most")).filter("n > 1"))
    more = cells.filter("n > 2")
    members = cut(sifted(points, more, "cell").join(more, "cell"))
    two = cells.filter("n = 2").select(F.col("most").alias("a"), F.col("least").alias("b"), "cell")
    star = members.filter(F.col("n") > small).filter("node != least").select(F.col("node").alias("a"), F.col("least").alias("b"), "cell")
    few = members.filter(F.col("n") <= small)
    all_of = few.groupBy("cell").agg(F.collect_list("node").alias("nodes")).select("nodes", F.explode("nodes").alias("a"), "cell").select("a", F.explode("nodes").alias("b"), "cell").filter("a > b")
    near = by_fingerprint(sigs.select("node", "fp")).withColumn("cell", F.lit(0).cast("long"))  # compared with the early ones
    pairs = cut(two.unionAll(star).unionAll(all_of).unionAll(near).groupBy("a", "b").agg(F.min(F.col("cell").bitwiseAND(F.lit(1))).alias("late")))
    asked = cut(pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct())
    texts = cut(sifted(texts, asked, "node").join(asked, "node", "left_semi"))
    early = cut(_check(pairs.filter("late = 0").select("a", "b"), texts, shingle, similarity))
    joined = components(early, "a", "b")
    end = lambda side: joined.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))
    rest = pairs.filter("late = 1").join(end("a"), "a", "left").join(end("b"), "b", "left").filter(~F.coalesce(F.col("a_root") == F.col("b_root"), F.lit(False))).select("a", "b")
    sure = cut(early.unionAll(_check(cut(rest), texts, shingle, similarity)))
    roots = components(sure, "a", "b").withColumnRenamed("node", "__n")
    large = members.filter(F.col("n") > small).join(roots, F.col("node") == F.col("__n"), "left").select("cell", "n", "node", F.coalesce("root", "node").alias("root"))
    large = cut(large)
    work, keys = dealt(large, block), ["cell", "i", "j"]
    more = work.join(texts, "node").select(*keys, "block", "node", "root", "text").groupBy(*keys).applyInPandas(lambda f: _block_pair(f, shingle, similarity), "a long, b long")
    return sure.unionAll(more)


def keep_one(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row for each component, with all its columns, chosen as in ``simhash.keep_one``."""
    printed = cut(_with_bands(docs, shingle).withColumn("__row", F.monotonically_increasing_id()))
    with scope():
        first = first_rows(printed, "__node")
        sigs = cut(printed.join(first.select("first.__row"), "__row", "left_semi").select(F.col("__node").alias("node"), F.col("__bands").alias("bands"), F.col("__fp").alias("fp")))
        texts = printed.join(first.select("first.__row"), "__row", "left_semi").select(F.col("__node").alias("node"), "text")
        found = components(links(sigs, texts, shingle, similarity), "a", "b").withColumnRenamed("node", "__node")
        rooted = first.select("__node").join(found, "__node", "left").select("__node", F.coalesce("root", "__node").alias("root"))
        others = cut(printed.select("__row").join(chosen_rows(first, rooted, "__node"), "__row", "left_anti"), keep=True)
    return without(printed, others, "__row").select(*docs.columns)
