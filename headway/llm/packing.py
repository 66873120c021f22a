"""Packing documents into sequences of several lengths.

A document's tokens are routed by their number: whole windows of the longest tier are cut off first; what remains goes
to the tier whose window it fills at least by half.  Each tier is then packed, from the longest down: its longest piece
opens a window, and the gap is filled from the shorter tiers, each time with the longest piece that fits; only where none
fits is the next longer one cut.  Where the shorter tiers hold too little, the piece is cut at half the window, which
makes a sequence of the next tier, and its rest is routed anew.  So every sequence is full; all lengths are powers of two
and none is padded.  What is left at the end of a task, less than the shortest window, is cut into powers of two.

Sequences are dealt to step groups of about ``step_tokens`` tokens, the longest first and always to the group with
the fewest tokens, so groups of one block differ by less than one sequence.

Each task packs the rows of its own partition, in blocks of about ``BLOCK`` tokens, with at most one block and one document
in memory: no shuffle, no state between tasks, and a lost task is simply run again.  Sequence and group numbers are
the partition's number times 2**32 plus a counter, so a group never spans tasks.

Tokens come from the tokenizers library.  Its pre-tokenizer drops white space, so a text's tokens are those of its
blank-separated chunks; a Python worker keeps the ids of chunks that it has seen (at most ``MEMO`` of them) and has the library
encode the others, many at once.

Edge cases: a null or empty text is its end token alone; very long texts are encoded whole and cut into many windows; among
pieces of equal length the first to come is taken first; repeated rows are packed as often as they occur; an empty table
gives an empty result; more columns are dropped, whatever their names.
"""

from __future__ import annotations

import heapq
import struct
import zlib
from collections import deque
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIERS = (2048, 1024, 512, 256)
STEP_TOKENS, BLOCK, MEMO, END = 16 * 2048, 1 << 21, 800_000, 1
LONG = 64  # characters of a chunk that isn't kept
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window int, step_group long"


class Encoder:
    """Ids of texts as bytes, little-endian and 32 bits each."""

    def __init__(self, path: str, memo: int = MEMO):
        from tokenizers import Tokenizer

        self.tokenizer, self.memo, self.most = Tokenizer.from_file(path), {"": b""}, memo

    def __call__(self, texts: list[str], end: bytes) -> list[bytes]:
        chunks = [t.replace("\n", " ").split(" ") for t in texts]
        memo = self.memo
        new = list(set().union(*chunks).difference(memo))
        for at in range(0, len(new), 1000):
            self.learn(new[at : at + 1000])
        out = [b"".join(map(memo.__getitem__, words)) + end for words in chunks]
        for c in new:
            if len(c) > LONG:
                del memo[c]
        if len(memo) > self.most:  # frequent chunks came early
            self.memo = dict(islice(memo.items(), self.most // 2))
        return out

    def learn(self, chunks: list[str]) -> None:
        """Encode chunks as one text and take it apart by the tokens' offsets."""
        found = self.tokenizer.encode(" ".join(chunks), add_special_tokens=False)
        ids = np.array(found.ids, "<u4")
        starts = np.fromiter((a for a, _ in found.offsets), np.int64, len(ids))
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        cuts = np.searchsorted(starts, np.cumsum(sizes + 1) - sizes - 1).tolist()
        data = ids.tobytes()
        self.memo.update((c, data[4 * a : 4 * b]) for c, a, b in zip(chunks, cuts, [*cuts[1:], len(ids)], strict=True))


@cache
def encoder(path: str) -> Encoder:
    """One for each Python worker, whose later tasks find the chunks of earlier ones."""
    return Encoder(path)


class Packer:
    """Packs documents block by block.  A piece is (document, start, its ids as bytes).

    Pieces shorter than the longest window wait by length; ``waiting`` has a bit for each length that is there.
    """

    def __init__(self, first: int, tiers: tuple[int, ...], step_tokens: int):
        self.tiers, self.step_tokens, self.next, self.group = tiers, step_tokens, first, first
        self.pieces: list[deque] = [deque() for _ in range(tiers[0])]
        self.waiting = 0
        self.have = dict.fromkeys(tiers, 0)  # tokens that wait in each tier
        self.tier = [next((w for w in tiers if n >= w // 2), tiers[-1]) for n in range(tiers[0])]
        self.done: list[tuple[int, list]] = []  # (window, pieces)
        self.tokens = 0

    def route(self, doc: tuple, start: int, ids: bytes) -> None:
        longest, whole = self.tiers[0], len(ids) // 4 // self.tiers[0]
        for at in range(0, whole * longest, longest):
            self.done.append((longest, [(doc, start + at, ids[4 * at : 4 * (at + longest)])]))
        if rest := ids[4 * whole * longest :]:
            n = len(rest) // 4
            self.pieces[n].append((doc, start + whole * longest, rest))
            self.waiting |= 1 << n
            self.have[self.tier[n]] += n

    def take(self, n: int) -> tuple:
        """The first piece of that length."""
        found = self.pieces[n]
        piece = found.popleft()
        if not found:
            self.waiting ^= 1 << n
        self.have[self.tier[n]] -= n
        return piece

    def add(self, doc: tuple, ids: bytes) -> None:
        self.tokens += len(ids) // 4
        self.route(doc, 0, ids)

    def fill(self, pieces: list, gap: int, below: int) -> None:
        """Fill the gap (in tokens) with pieces shorter than ``below``, of which there is enough: the longest that fits, else a part of the next longer one."""
        while gap:
            n = (self.waiting & (2 << min(gap, below - 1)) - 1).bit_length() - 1
            if n > 0:
                pieces.append(self.take(n))
                gap -= n
            else:
                longer = self.waiting >> gap + 1
                doc, start, ids = self.take(gap + (longer & -longer).bit_length())
                pieces.append((doc, start, ids[: 4 * gap]))
                self.route(doc, start + gap, ids[4 * gap :])
                gap = 0

    def pack(self, last: bool) -> Iterator[tuple]:
        """Close what can be filled, or everything, and yield the rows."""
        least = self.tiers[-1]
        for k, window in enumerate(self.tiers[:-1]):
            half = window // 2
            while n := max((self.waiting & (1 << window) - 1).bit_length() - 1, 0):
                if n < half:
                    break
                doc, start, ids = self.take(n)
                if sum(self.have[w] for w in self.tiers[k + 1 :]) >= window - n:
                    pieces = [(doc, start, ids)]
                    self.fill(pieces, window - n, half)
                    self.done.append((window, pieces))
                else:
                    self.done.append((half, [(doc, start, ids[: 4 * half])]))
                    if rest := ids[4 * half :]:
                        self.route(doc, start + half, rest)
        left = sum(self.have.values())
        while left >= least or last and left:
            size = least if left >= least else 1 << left.bit_length() - 1
            pieces: list = []
            self.fill(pieces, size, least)
            self.done.append((size, pieces))
            left -= size
        yield from self.rows()
        self.tokens = left

    def rows(self) -> Iterator[tuple]:
        self.done.sort(key=lambda x: -x[0])
        groups = max(1, round(sum(w for w, _ in self.done) / self.step_tokens))
        load = [(0, self.group + g) for g in range(groups)]
        for window, pieces in self.done:
            tokens, group = heapq.heappop(load)
            heapq.heappush(load, (tokens + window, group))
            offset = 0
            for (doc_id, n), start, ids in pieces:
                yield doc_id, start, len(ids) // 4, zlib.crc32(ids), n, self.next, offset, window, group
                offset += len(ids) // 4
            self.next += 1
        self.group += groups
        self.done = []


def pack(docs: DataFrame, tokenizer: str, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, end: int = END, block: int = BLOCK) -> DataFrame:
    """One row per piece of a document: where it starts, where it lies, its sequence's length and step group.

    tokenizer: path of a tokenizers file, present on every executor.  tiers: powers of two, falling by half.
    """
    if any(w & (w - 1) for w in tiers) or any(a != 2 * b for a, b in zip(tiers, tiers[1:], strict=False)):
        raise ValueError("tiers must be powers of two, each half the one before")
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    types = [pa.int64() if x.split()[1] == "long" else pa.int32() for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, closing = encoder(tokenizer), struct.pack("<I", end)
        packer = Packer(TaskContext.get().partitionId() << 32, tiers, step_tokens)

        def out(last: bool) -> Iterator[pa.RecordBatch]:
            if rows := list(packer.pack(last)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                ids = encode([t or "" for t in some.column(1).to_pylist()], closing)
                for doc_id, x in zip(some.column(0).to_pylist(), ids, strict=True):
                    packer.add((doc_id, len(x) // 4), x)
                    if packer.tokens >= block:
                        yield from out(False)
        yield from out(True)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)
