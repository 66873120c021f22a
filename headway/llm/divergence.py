"""How far each source's words lie from those of the other sources of its language.

1. Stripes: every partition folds whole documents into a hash of stripes, one for each (language, term): the number of documents
   that have the term, and how often each source has it.  When the hash holds ``SPILL`` counts, its stripes are written out and it
   begins anew.  The stripe of the empty term, which no text has, names every source of the language.
2. Merge: stripes are dealt by key, sorted, and added up one after the other; terms of too few documents go.  A task holds one
   stripe at a time.
3. Divergences: a stripe has the counts of all sources, so it gives its part of every pair's sum and of every group's terms.
   Sources are numbered within their language and taken in blocks of ``SOURCES``; a task has two blocks and a share of the terms
   (about ``TERMS`` for the language with the most) and returns one sum per pair of its sources and at most ``TOP`` terms a group.

A frequent term or a large source weighs no more than a rare one: it has one stripe per spill, and one count in a stripe.  Work and
result grow with the number of pairs of sources of a language, which the result lists.

All numbers are whole: p = 1 + floor(SCALE * (count + PRIOR) / (N + PRIOR * V)) by long division in 64 bits, which holds up to
2**63 / 1000 occurrences of a language's terms.

Edge cases: null texts, languages and sources count as empty ones; a language without a kept term has pairs with the value 0 and no
terms; a language with one source has no pairs; equal values rank by the item's bytes; repeated rows count as often as they occur;
an empty table gives an empty result; other columns aren't read, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, scope

SCALE, PRIOR, TOP, LEAST = 1_000_000_000, 5, 50, 30
SPILL, SOURCES, TERMS = 600_000, 128, 4096
#: Runs of letters A to Z and of all characters beyond ASCII, as UTF-8.
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
#: The same by splitting: bytes of terms, A to Z lower-cased, and a blank for each other byte.
FOLDED = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)).lower()
STRIPES = "lang string, term string, docs long, sources array<string>, counts array<long>"
ARROW = pa.schema([("lang", pa.string()), ("term", pa.string()), ("docs", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])


def _batch(langs: list, terms: list, docs: list, sizes: list, sources: list, counts: list) -> pa.RecordBatch:
    """Stripes one after the other; sizes: how many of the sources and counts are each stripe's."""
    ends = pa.array(np.cumsum([0, *sizes]), pa.int32())
    lists = [pa.ListArray.from_arrays(ends, pa.array(x, kind)) for x, kind in ((sources, pa.string()), (counts, pa.int64()))]
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(docs, pa.int64()), *lists], schema=ARROW)


class Stripes:
    """Term -> (documents, source -> occurrences) of each language, held by columns: the documents, and each source's occurrences."""

    def __init__(self) -> None:
        self.langs: dict[str, tuple[Counter, dict[str, Counter]]] = {}
        self.size = 0

    def fold(self, lang: str, source: str, text: bytes) -> None:
        """Add one whole document."""
        docs, sources = self.langs.setdefault(lang, (Counter(), {}))
        counts = sources.get(source)
        if counts is None:
            counts = sources[source] = Counter({b"": 0})
        had = len(counts)
        terms = text.translate(FOLDED).split()
        counts.update(terms)
        docs.update(set(terms))
        self.size += len(counts) - had

    def spill(self, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
        """All stripes; then none is left."""
        for lang, (docs, sources) in self.langs.items():
            names, stripes = list(sources), defaultdict(list)
            for i, counts in enumerate(sources.values()):
                for entry in zip(counts, repeat(i), counts.values()):
                    stripes[entry[0]].append(entry)
            terms = list(stripes)
            for at in range(0, len(terms), rows):
                some = terms[at : at + rows]
                found = [stripes.pop(t) for t in some]
                flat = list(chain.from_iterable(found))
                yield _batch([lang] * len(some), some, [docs[t] for t in some], list(map(len, found)), [names[i] for _, i, _ in flat], [n for _, _, n in flat])
        self.langs, self.size = {}, 0


def _fold(batches: Iterator[pa.RecordBatch], spill: int) -> Iterator[pa.RecordBatch]:
    stripes = Stripes()
    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            stripes.fold(lang, source, text.as_py().encode())
            if stripes.size >= spill:
                yield from stripes.spill()
    yield from stripes.spill()


def _merged(batch: pa.RecordBatch, starts: np.ndarray, ends: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
    """One stripe of each run of rows [start, end), which have one key."""
    sizes, sources, counts = [], [], []
    bounds, flat = batch.column(3).offsets.to_numpy(), [batch.column(i).values for i in (3, 4)]
    for a, b in zip(bounds[starts].tolist(), bounds[ends].tolist(), strict=True):
        of: dict[str, int] = {}
        for s, n in zip(flat[0].slice(a, b - a).to_pylist(), flat[1].slice(a, b - a).to_pylist(), strict=True):
            of[s] = of.get(s, 0) + n
        sizes.append(len(of))
        sources += of
        counts += of.values()
    at = pa.array(starts)
    return _batch(batch.column(0).take(at), batch.column(1).take(at).cast(pa.binary()), docs, sizes, sources, counts)


def _merge(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Add up sorted stripes with equal keys; the empty term's stripe is kept, others if enough documents have them.

    Most terms are rare and go by the sum of their documents alone.  A batch's last stripe waits, merged, for the next batch.
    """
    waiting = None
    for batch in batches:
        if waiting is not None:
            batch = pa.Table.from_batches([waiting, batch.cast(ARROW)]).combine_chunks().to_batches()[0]
        if not batch.num_rows:
            continue
        changes = [pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False) for c in batch.columns[:2]]
        starts = np.concatenate(([0], 1 + np.flatnonzero(changes[0] | changes[1])))
        ends = np.append(starts[1:], batch.num_rows)
        docs = np.add.reduceat(batch.column(2).to_numpy(), starts)
        fine = (docs >= least) | pc.equal(batch.column(1), "").to_numpy(zero_copy_only=False)[starts]
        fine[-1] = False
        yield _merged(batch, starts[fine], ends[fine], docs[fine])
        waiting = _merged(batch, starts[-1:], ends[-1:], docs[-1:])
    if waiting is not None and (waiting.column(2)[0].as_py() >= least or waiting.column(1)[0].as_py() == ""):
        yield waiting


def term_stripes(docs: DataFrame, least: int = LEAST, spill: int = SPILL) -> DataFrame:
    """``lang, term, docs, sources, counts`` of each term in at least ``least`` documents of its language, and of the empty term, which lists all sources."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    parts = docs.select(text("lang"), text("source"), text("text")).mapInArrow(lambda b: _fold(b, spill), STRIPES)
    return parts.repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(lambda b: _merge(b, least), STRIPES)


def scaled(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """floor(SCALE * count / total) of whole numbers, count at most total, three decimal digits at a time."""
    out, rest = np.zeros(np.broadcast(count, total).shape, np.int64), count
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digits
    return out


FOUND = "part string, lang string, source string, item string, value long"


def _found(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["part", "lang", "source", "item", "value"])


def _diverge(stripes: pd.DataFrame, tasks: pd.DataFrame, top: int) -> pd.DataFrame:
    """Sums of pairs of two blocks of sources over some terms; of a block with itself, also its groups' leading terms."""
    if not len(tasks):
        return _found([])
    task = tasks.iloc[0]
    lang, kept, whole = task["lang"], int(task["kept"]), int(task["whole"])
    left, right = ([(g["source"], int(g["n"])) for g in task[side]] for side in ("left", "right"))
    same = task["a"] == task["b"]
    sums = np.zeros((len(left), len(right)), np.int64)
    best: list[list[tuple[int, bytes]]] = [[] for _ in left]
    for at in range(0, len(stripes), 512):
        block = stripes.iloc[at : at + 512]
        p = []
        for groups in (left,) if same else (left, right):
            place = {s: i for i, (s, _) in enumerate(groups)}
            counts = np.zeros((len(block), len(groups)), np.int64)
            for row, (sources, ns) in enumerate(zip(block["sources"], block["counts"], strict=True)):
                for s, n in zip(sources, ns, strict=True):
                    if (column := place.get(s)) is not None:
                        counts[row, column] = n
            p.append(1 + scaled(counts + PRIOR, np.array([n for _, n in groups]) + PRIOR * kept))
            if same:
                q = 1 + scaled(np.array([sum(ns) for ns in block["counts"]]) + PRIOR, np.int64(whole + PRIOR * kept))
                more = p[0] - q[:, None]
                names = [t.encode() for t in block["term"]]
                for column in range(len(groups)):
                    rows = np.flatnonzero((counts[:, column] > 0) & (more[:, column] > 0))
                    best[column] = sorted(best[column] + [(-int(more[r, column]), names[r]) for r in rows])[:top]
        for i in range(len(left)):
            sums[i] += np.abs(p[-1] - p[0][:, i : i + 1]).sum(axis=0)
    out = [("pair", lang, s, t, int(sums[i, j])) for i, (s, _) in enumerate(left) for j, (t, _) in enumerate(right) if i < j or not same]
    out += [("term", lang, s, term.decode(), -value) for (s, _), found in zip(left, best, strict=True) for value, term in found]
    return _found(out)


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, spill: int = SPILL, sources: int = SOURCES, terms: int = TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``: each group's distance to the other sources of its language (part ``pair``) and its leading terms (part ``term``)."""
    with scope():
        stripes = cut(term_stripes(docs, least, spill))
        kept = stripes.groupBy("lang").agg(F.count_if(F.col("term") != "").alias("kept"))
        counts = stripes.select("lang", F.inline(F.arrays_zip("sources", "counts")))
        totals = counts.groupBy("lang", F.col("sources").alias("source")).agg(F.sum("counts").alias("n"))
        numbered = totals.withColumn("block", F.floor((F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1) / sources).cast("int"))
        blocks = numbered.groupBy("lang", "block").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("groups"), F.sum("n").alias("n"))
        blocks = cut(blocks.withColumn("whole", F.sum("n").over(Window.partitionBy("lang"))).join(kept, "lang"))
        shares = max(1, -(-(blocks.agg(F.max("kept")).first()[0] or 0) // terms))
        key = ["lang", "a", "b", "share"]
        # A language's blocks with each other: one pair for each so many sources.
        right = blocks.select("lang", F.col("block").alias("b"), F.col("groups").alias("right"))
        tasks = cut(blocks.select("lang", F.col("block").alias("a"), F.col("groups").alias("left"), "kept", "whole").join(right, "lang").filter("a <= b").withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))))
        # Shares spread a language with many terms; with one block of sources, every stripe goes to one task.
        own = [f"t_{c}" for c in key]
        dealt = stripes.filter("term != ''").withColumn("t_share", F.pmod(F.xxhash64("term"), F.lit(shares)).cast("int")).withColumnRenamed("lang", "t_lang").join(tasks.select(*[F.col(c).alias(f"t_{c}") for c in key]), ["t_lang", "t_share"])
        found = dealt.groupBy(*own).cogroup(tasks.groupBy(*key)).applyInPandas(lambda s, t: _diverge(s, t, top), FOUND)
        found = cut(found.groupBy("part", "lang", "source", "item").agg(F.sum("value").alias("value")), keep=True)
    both = found.unionByName(found.filter("part = 'pair'").select("part", "lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return both.withColumn("rank", rank).filter((F.col("part") == "pair") | (F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")
