"""Connected components of a table of links, in rounds of stars.

Each round hangs every node's larger neighbours on its smallest one (large star), then its smaller neighbours and itself
(small star); the rounds end when a round changes nothing, after about log(nodes) rounds.  Links stay a table: each
round is two group-bys and two joins, written to the shared folder, and the round before is deleted.  A node with very many
links is summed before the shuffle, and its join is one that adaptive execution can split.  Nodes may be of any type with
an order, structs too: with the wanted name of a component as a node's first field, the root carries that name and nothing
has to be joined to it afterwards.

Edge cases: links with a null end are ignored, as are links of a node with itself; repeated links count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, scope


def _star(links: DataFrame, both: bool) -> DataFrame:
    """links: (u, v) with u > v.  both: the large star, else the small one."""
    sides = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else links
    least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    hung = sides.join(least, "u")
    hung = hung.filter("v > u").select("v", "m") if both else hung.filter("v != m").select("v", "m").unionAll(least.select("u", "m"))
    return hung.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame, a: str, b: str, max_rounds: int = 100) -> DataFrame:
    """``node, root`` for every node of a link; the root is the smallest node of its component."""
    links = links.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    with scope():
        links = cut(links)
        state = _state(links)
        for _ in range(max_rounds):
            with scope():
                links = cut(_star(_star(links, True), False), keep=True)
            if state == (state := _state(links)):
                break
        else:
            raise RuntimeError(f"no end after {max_rounds} rounds")
        links = cut(links, keep=True)
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(links.select("v", "v").distinct())
