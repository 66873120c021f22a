"""Byte-level BPE encoding and decoding with a queue of merge ranks.

A text is split by a pattern; every match (a pre-token) is merged by itself, always the adjacent pair whose joined bytes
have the lowest rank, the leftmost of equals.

``RankQueue`` holds, for each rank, the positions where a pair of that rank begins; a hierarchy of bitmaps over the ranks
(``WIDTH`` bits a word, a bit of a word says that a word below isn't zero) gives the lowest rank that is waiting by finding the
first set bit in one word per level.  The tokens are a doubly linked list of their first bytes' positions.  A merge changes the
ranks of at most two pairs, which are put in anew; the old entries stay where they are and are skipped when they come up.
So n bytes take at most 3n entries, each of a few steps, however long a pre-token is: a megabyte without a blank takes seconds.

Pre-tokens of more than ``SHORT`` bytes are merged entry by entry.  Shorter ones, of which a block of texts has many thousand
different ones, lie side by side in one list with gaps between, and a bucket's entries are merged together, as arrays: at most one
in each pre-token, the leftmost; the others wait in the bucket, and whatever ranks lower by then goes before them.

The ids of short pre-tokens are kept: a worker has two tables of at most ``CACHE`` of them, and when the newer one is full it
takes the place of the older.  Texts are encoded where they lie, whole, without a shuffle.

The classes of letters and numbers are those of the tiktoken library: the regex library knows another version of Unicode, so a text
that holds a character on which they differ is split by ranges of code points.

Edge cases: a null text is empty; an empty text has no ids and decodes to nothing; special tokens' strings are ordinary
text; repeated rows are returned as often as they occur; an empty table gives an empty result; columns with the names of
results are replaced, all others keep their values.  Ids that the vocabulary doesn't have can't be decoded: an error.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tiktoken import Encoding

WIDTH, SHORT, CACHE, BLOCK = 256, 64, 500_000, 4_000_000
CLASSES = (r"\p{L}", r"\p{N}")


class RankQueue:
    """Positions by rank.  ``low`` is the lowest rank that has any, or the number of ranks."""

    def __init__(self, ranks: int) -> None:
        self.buckets: list[list[int]] = [[] for _ in range(ranks)]
        self.runs: dict[int, np.ndarray] = {}
        self.low = self.ranks = ranks
        self.levels = [[0] * (ranks // WIDTH + 1)]
        while len(self.levels[-1]) > 1:
            self.levels.append([0] * -(-len(self.levels[-1]) // WIDTH))

    def mark(self, rank: int) -> None:
        """The rank's bucket isn't empty any more."""
        at = rank
        for words in self.levels:
            at, bit = divmod(at, WIDTH)
            was = words[at]
            words[at] = was | 1 << bit
            if was:
                break
        if rank < self.low:
            self.low = rank

    def clear(self) -> None:
        """The lowest bucket is empty: on to the first set bit, from the highest level down."""
        at = self.low
        for words in self.levels:
            at, bit = divmod(at, WIDTH)
            words[at] ^= 1 << bit
            if words[at]:
                break
        at = 0
        for words in reversed(self.levels):
            word = words[at]
            if not word:
                self.low = self.ranks
                return
            at = at * WIDTH + (word & -word).bit_length() - 1
        self.low = at

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets[rank]
        if not bucket:
            self.mark(rank)
        heappush(bucket, position)

    def pop(self) -> int:
        """The leftmost position of the lowest rank."""
        bucket = self.buckets[self.low]
        position = heappop(bucket)
        if not bucket:
            self.clear()
        return position

    def fill(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """The first entries of an empty queue, for ``take``: a run of positions for each rank."""
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        first = np.flatnonzero(np.diff(ranks, prepend=-1))
        for rank, a, b in zip(ranks[first].tolist(), first.tolist(), [*first[1:].tolist(), len(ranks)], strict=True):
            self.mark(rank)
            self.runs[rank] = positions[a:b]

    def put(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Further entries, for ``take``."""
        buckets, runs = self.buckets, self.runs
        for rank, position in zip(ranks.tolist(), positions.tolist(), strict=True):
            bucket = buckets[rank]
            if not bucket and rank not in runs:
                self.mark(rank)
            bucket.append(position)

    def take(self) -> np.ndarray:
        """All positions of the lowest rank, from left to right."""
        run, bucket = self.runs.pop(self.low, None), self.buckets[self.low]
        if bucket:
            later = np.array(bucket)
            run = later if run is None else np.concatenate((run, later))
            run.sort()
            bucket.clear()
        self.clear()
        return run


def _of_library(kind: str, every: str) -> str:
    """The characters of a class of the tiktoken library, of all characters."""
    found = Encoding("class", pat_str=kind, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={}).encode_ordinary(every)
    return bytes(found).decode()


def _ranges(characters: str) -> str:
    """A pattern's set of characters that are in order."""
    codes = np.array([ord(c) for c in characters])
    last = np.flatnonzero(np.diff(codes, append=-1) != 1)
    first = np.concatenate(([0], last[:-1] + 1))
    return "[" + "".join(f"\\U{codes[a]:08x}-\\U{codes[b]:08x}" for a, b in zip(first, last, strict=True)) + "]"


class Splitter:
    """Pre-tokens of a text, as the tiktoken library would split it."""

    def __init__(self, pattern: str) -> None:
        self.plain = regex.compile(pattern).findall
        every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
        sets = {kind: _of_library(kind, every) for kind in CLASSES if kind in pattern}
        exact = pattern
        for kind, characters in sets.items():
            exact = exact.replace(kind, _ranges(characters))
        self.exact = regex.compile(exact, regex.V1).findall
        self.odd = frozenset().union(*(set(regex.findall(kind, every)) ^ set(characters) for kind, characters in sets.items()))
        # A quick sieve for most texts: the odd ones of the first plane, and all of the others.
        near = [c for c in sorted(self.odd) if c < "\U00010000"]
        self.sieve = re.compile("[" + "".join(f"\\u{ord(c):04x}" for c in near) + "\U00010000-\U0010ffff]").search

    def __call__(self, text: str) -> list[str]:
        if text.isascii() or not self.sieve(text) or self.odd.isdisjoint(text):
            return self.plain(text)
        return self.exact(text)


class Codec:
    """ranks: the bytes of each token and its rank, which is its id; every single byte has one."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.split = ranks, Splitter(pattern)
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.none = max(ranks.values(), default=0) + 1  # the id of a gap
        self.decimal = list(map(str, range(self.none)))
        self.queue = RankQueue(self.none)
        self.of_byte = np.array([ranks[bytes([i])] for i in range(256)])
        pairs = {(ranks[t[:i]] * (self.none + 1) + ranks[t[i:]]): r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.pairs = np.array(sorted(pairs), np.int64)
        self.joined = np.array([pairs[p] for p in self.pairs.tolist()], np.int64)
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def merge_long(self, token: bytes) -> tuple[int, ...]:
        """The ids of one pre-token, entry by entry."""
        ranks, queue, n = self.ranks, self.queue, len(token)
        # ends[i]: where the token that begins at i ends; before[i]: where the one before it begins; pair[i]: the rank of it and the next.
        ends, before, pair = list(range(1, n + 1)), list(range(-1, n)), [-1] * n
        for i in range(n - 1):
            if (rank := ranks.get(token[i : i + 2])) is not None:
                pair[i] = rank
                queue.push(rank, i)
        while (rank := queue.low) < queue.ranks:
            i = queue.pop()
            if pair[i] != rank:  # stale: merged away, or another pair by now
                continue
            middle = ends[i]
            end = ends[i] = ends[middle]
            pair[middle] = pair[i] = -1
            if end < n:
                before[end] = i
                if (rank := ranks.get(token[i : ends[end]])) is not None:
                    pair[i] = rank
                    queue.push(rank, i)
            left = before[i]
            if left >= 0:
                if (rank := ranks.get(token[left:end])) is not None:
                    pair[left] = rank
                    queue.push(rank, left)
                else:
                    pair[left] = -1
        ids, i = [], 0
        while i < n:
            ids.append(ranks[token[i : ends[i]]])
            i = ends[i]
        return tuple(ids)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs of ids; -1 where they make no token."""
        key = left * (self.none + 1) + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.joined[at], -1)

    def merge_short(self, tokens: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of many pre-tokens, bucket by bucket."""
        if not tokens or not len(self.pairs):
            return [tuple(self.of_byte[list(t)].tolist()) for t in tokens]
        queue, size = self.queue, np.array([len(t) for t in tokens])
        line = np.frombuffer(b"\0" + b"\0".join(tokens) + b"\0", np.uint8)
        gaps = np.concatenate(([0], np.cumsum(size + 1)))
        token, of = self.of_byte[line], np.repeat(np.arange(len(size) + 1), np.append(size + 1, 1))
        token[gaps] = self.none
        after, before = np.arange(1, len(line) + 1), np.arange(-1, len(line) - 1)
        pair = np.append(self.rank_of(token[:-1], token[1:]), -1)
        waiting = np.flatnonzero(pair >= 0)
        queue.fill(pair[waiting], waiting)
        while (rank := queue.low) < queue.ranks:
            at = queue.take()
            at = at[pair[at] == rank]  # others are stale: merged away, or another pair by now
            if not len(at):
                continue
            first = np.ones(len(at), bool)
            np.not_equal(of[at[1:]], of[at[:-1]], out=first[1:])
            i, later = at[first], at[~first]
            middle = after[i]
            end, left = after[middle], before[i]
            token[i], token[middle] = rank, self.none
            after[i], before[end] = end, i
            pair[middle] = -1
            where = np.concatenate((i, left))
            new = self.rank_of(token[where], np.concatenate((token[end], token[i])))
            pair[where] = new
            more = new >= 0
            queue.put(new[more], where[more])
            if len(later):
                queue.put(np.full(len(later), rank), later)
        live = np.flatnonzero(token != self.none)
        bounds = np.searchsorted(live, gaps).tolist()
        ids = token[live].tolist()
        return [tuple(ids[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]

    def merge(self, tokens: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of pre-tokens that aren't empty; one that is a token as a whole is that, whatever its merges."""
        out = [(whole,) if (whole := self.ranks.get(t)) is not None else self.merge_long(t) if len(t) > SHORT else None for t in tokens]
        short = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(short, self.merge_short([tokens[i] for i in short]), strict=True):
            out[i] = ids
        return out

    def find(self, tokens: set[str]) -> dict[str, tuple[int, ...]]:
        """The ids of different pre-tokens; those that aren't known are merged together."""
        found, new = {}, []
        for token in tokens:
            ids = self.known.get(token)
            if ids is None and (ids := self.older.get(token)) is not None:
                self.keep(token, ids)
            if ids is None:
                new.append(token)
            else:
                found[token] = ids
        raw = [token.encode() for token in new]
        for token, as_bytes, ids in zip(new, raw, self.merge(raw), strict=True):
            found[token] = ids
            if len(as_bytes) <= SHORT:
                self.keep(token, ids)
        return found

    def keep(self, token: str, ids: tuple[int, ...]) -> None:
        if len(self.known) >= CACHE:
            self.known, self.older = {}, self.known
        self.known[token] = ids

    def encode(self, texts: Iterable[str]) -> Iterator[list[int]]:
        """The ids of each text, in blocks of about ``BLOCK`` characters or one text."""
        block, size = [], 0
        for text in texts:
            block.append(self.split(text))
            size += len(text)
            if size >= BLOCK:
                yield from self.ids_of(block)
                block, size = [], 0
        yield from self.ids_of(block)

    def ids_of(self, block: list[list[str]]) -> Iterator[list[int]]:
        found = self.find(set(chain.from_iterable(block)))
        for tokens in block:
            yield list(chain.from_iterable(map(found.__getitem__, tokens)))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: on each line a token in base64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


@cache
def _codec(path: str, pattern: str) -> Codec:
    """One codec for a Python worker."""
    return Codec(read_ranks(path), pattern)


def _added(df: DataFrame, source: str, fields: list[tuple[str, T.DataType]], values: Callable[[Codec, pa.Array], list[pa.Array]], ranks: str, pattern: str) -> DataFrame:
    """``df`` with further columns (name, type) worked out from ``source``, batch by batch."""
    names = [n for n, _ in fields]
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    keep = [i for i, c in enumerate(df.columns) if c not in names]
    at = df.columns.index(source)
    schema = T.StructType([plain.schema[i] for i in keep])
    for n, kind in fields:
        schema = schema.add(f"x_{n}", kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks, pattern)
        for batch in batches:
            new = values(codec, batch.column(at))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + new, names=schema.names)

    return plain.mapInArrow(run, schema).toDF(*[df.columns[i] for i in keep], *names)


def encode(docs: DataFrame, ranks: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the ids of each text.  ranks: the path of a rank file, present on every executor."""

    def values(codec: Codec, column: pa.Array) -> list[pa.Array]:
        return [pa.array(codec.encode(t.as_py() or "" for t in column), pa.list_(pa.int32()))]

    return _added(docs, text, [(ids, T.ArrayType(T.IntegerType()))], values, ranks, pattern)


def decode(rows: DataFrame, ranks: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add the bytes of each list of ids (a null list has none).  Lists that ``encode`` has made give the text's bytes."""

    def values(codec: Codec, column: pa.Array) -> list[pa.Array]:
        return [pa.array([codec.decode(i.as_py() or ()) for i in column], pa.binary())]

    return _added(rows, ids, [(decoded, T.BinaryType())], values, ranks, pattern)


def digests(docs: DataFrame, ranks: str, pattern: str, text: str = "text") -> DataFrame:
    """Add ``n_tokens, ids_sha256, decoded_sha256``: both ways in one pass, with nothing but digests to carry on."""

    def values(codec: Codec, column: pa.Array) -> list[pa.Array]:
        out: list[list] = [[], [], []]
        for ids in codec.encode(t.as_py() or "" for t in column):
            out[0].append(len(ids))
            out[1].append(hashlib.sha256(",".join(map(codec.decimal.__getitem__, ids)).encode()).hexdigest())
            out[2].append(hashlib.sha256(codec.decode(ids)).hexdigest())
        return [pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())]

    fields = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    return _added(docs, text, fields, values, ranks, pattern)
