"""Scoring texts by online logistic context mixing.

A text is coded byte by byte, with an end mark; a byte's Huffman code (by the training documents' counts of bytes after the
byte before, or after the two before for the ``TWOS`` most frequent ones within words) makes it a few binary decisions.  Each decision is predicted by five contexts: the last byte, the last two,
the last three, the word so far, and, for a word's first letters, the word so far with the word before it.  The first is exact; the others are hashed
into tables.  A context's prediction is the log odds of the bits that the training documents have shown in its slot.  A
gate (the place in the word, how often the word so far has been seen, and whether it has been seen after the word before)
selects the weights with which the predictions are added up; the weights learn online, document by document, from the
errors of each block of ``STEP`` bytes before the next one is coded.  An adaptive map then refines the mixed probability:
per document and level of probability, the frequency that the document itself has shown.

Above the bytes stand spans, whose statistics grow with the corpus.  Every third word before a place is a context; about
one in ``ANCHOR``, chosen by hash, is an anchor, and the bytes up to the next anchor are its span.  Before the bytes of a
span comes one decision more: whether the anchor is followed by a span that followed it in the training documents, and
by which one (its count c out of t, with d different ones: probability c / (t + d); a new one: d / (t + d), and its bytes
follow).  A training document's own spans don't count for itself.  Anchors are counted and joined by Spark; nothing of
them is broadcast or collected.

The score is -bits * log10(2), with the bits of all decisions.

The work: one pass counts words, pairs of bytes and three bytes in a row; one adds up the slots' bits, per task in arrays of fixed size, which
are then summed block by block in two rounds; one scores.  In a task, equal contexts with equal next bytes are counted
first, then added to the slots.  The tables (``ORDER_BITS``, ``WORD_BITS``) have a fixed size, whatever the corpus; they and
the weights are what is broadcast.  Starting weights are fitted on all training documents: a hash deals the rows into two halves,
whose slots are counted apart, and a row's weights are learned against the other half's tables, which haven't seen it.  This
goes in rounds over growing shares of the rows (``SHARES``, together all of them, each row once), every round from the mean
of the one before, at a falling rate.  Then the halves' tables are added up.  In scoring, documents of a batch run side by side, block by block, so numpy works on all of them at
once; a document's result doesn't depend on its companions.

The base score needs each token's count.  The most frequent tokens, at most ``HEAD``, are looked up in a table; the
others, a small part, are joined by token, so no vocabulary is ever broadcast or held by a task.

Edge cases: a null text is empty and has only the end token and end mark; a null doc_id is the empty text for the fold;
repeated rows are scored alike and returned as often as they occur; very long texts are coded whole, one at a time; an
empty table gives an empty result; more columns are dropped, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

ORDER_BITS, WORD_BITS = (18, 21), (21, 21)  # bits of the tables' numbers of slots: two and three bytes; word, word and word before
BITS = (*ORDER_BITS, *WORD_BITS)
PLACES, TRUST, PAIRS, STEP, LEVELS, RATE = 5, 5, 3, 256, 32, 0.002
GATES, INPUTS = PLACES * TRUST * PAIRS, 5
PAIR_PLACES = 2  # letters of a word that the word before predicts
SHARES, HEAD, LANES, LANE_BYTES, COUNT_BYTES, WORD_BYTES = (1, 1, 2, 4, 8), 1 << 18, 64, 1 << 20, 1 << 21, 1 << 24
ANCHOR, FEW, ROWS = 32, 4096, 6000
TWOS = 512  # frequent two bytes with codes of their own
PIECE = 1 << 16  # slots in a row of what tasks send
UNIT = 12.0  # log odds are kept as bytes, in parts of so much
END_BYTE, END_TOKEN = 0xFF, b"\n"  # neither occurs in a text's bytes or words
NEAR = 16  # so many nodes of a byte's tree lie side by side in a table
_U32, _U64 = np.uint32, np.uint64


@dataclass
class Code:
    """Huffman codes of bytes by the byte before, or by the frequent two before, as the paths' inner nodes and bits one after the other."""

    size: np.ndarray  # by 256 * row + byte; the first 256 rows are those of the byte before
    begin: np.ndarray
    node: np.ndarray  # numbers to be mixed into a context's hash
    bit: np.ndarray
    odds: np.ndarray  # the prediction of the last byte alone, in whole parts as the tables' ones
    row: np.ndarray | None = None  # by 256 * byte before that + byte before, if frequent ones have rows of their own

    def index(self, pair: np.ndarray) -> np.ndarray:
        """The code's place of each of several texts' bytes, one after the other: 256 * row + byte."""
        if self.row is None:
            return pair
        two = pair >> 8
        two[1:] |= pair[:-1] & 0xFF00  # of the text before at a text's first byte, whose row depends on the zero before it alone
        return _take(self.row, two) << 8 | pair & 255

    @cached_property
    def steps(self) -> np.ndarray:
        """Node, odds (8 bits) and bit in one number, so a decision reads one place."""
        return self.node << 9 | (self.odds.astype(np.int32) & 255) << 1 | self.bit


def huffman(counts: np.ndarray) -> tuple[list[list[tuple[int, int]]], np.ndarray]:
    """The path of each of 256 bytes as (inner node, bit), nodes numbered by weight from the root; and the nodes' log odds."""
    heap = [(int(c), b, b) for b, c in enumerate(counts)]
    heapq.heapify(heap)
    parent, weight, n = {}, {}, 256
    while len(heap) > 1:
        (x, _, a), (y, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        parent[a], parent[b], weight[n] = (n, 0), (n, 1), (x, y)
        heapq.heappush(heap, (x + y, n, n))
        n += 1
    number = {m: k for k, m in enumerate(sorted(weight, key=lambda m: (-sum(weight[m]), -m)))}
    odds = np.zeros(255)
    for m, (x, y) in weight.items():
        odds[number[m]] = math.log(y / x)
    paths = []
    for b in range(256):
        path, at = [], b
        while at in parent:
            at, bit = parent[at]
            path.append((number[at], bit))
        paths.append(path[::-1])
    return paths, odds


def codes(pairs: np.ndarray, twos: np.ndarray | None = None, after: np.ndarray | None = None) -> Code:
    """pairs: 256 x 256 counts of a byte after another; rare ones lean on the byte's own count.

    twos, after: numbers of two bytes, whose last one isn't white space, and 256 counts after each; they lean on those after the last one.
    (After white space a word begins, and the word's context must tell which tree its bits are of.)
    """
    total = pairs.sum(axis=0) + 1.0
    total /= total.sum()
    twos = np.empty(0, np.int64) if twos is None else twos
    rows = 256 + len(twos)
    size, nodes, bits, odds = np.zeros(rows << 8, np.int64), [], [], []
    far = np.random.default_rng(7).integers(0, (1 << min(BITS)) // NEAR, (rows, 256 // NEAR)) * NEAR
    far[:, 0] = 0
    for row in range(rows):
        counts = pairs[row] + 16 * total if row < 256 else after[row - 256] + 16 * _after(pairs[twos[row - 256] & 255], total)
        # In 64ths, so that every byte has a count
        paths, own = huffman(np.rint(64 * counts) + 1)
        size[256 * row : 256 * row + 256] = [len(path) for path in paths]
        at, bit = np.array([step for path in paths for step in path], np.int64).reshape(-1, 2).T
        nodes.append((far[row, at // NEAR] | at % NEAR).astype(np.int32))
        bits.append(bit.astype(np.int8))
        odds.append(np.rint(np.clip(UNIT * own[at], -127, 127)).astype(np.int8))
    row_of = None
    if len(twos):
        row_of = np.arange(1 << 16, dtype=np.int32) & 255
        row_of[twos] = np.arange(256, rows)
    return Code(size, np.cumsum(size) - size, np.concatenate(nodes), np.concatenate(bits), np.concatenate(odds), row_of)


def _after(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    share = counts + 16 * total
    return share / share.sum()


@dataclass
class Bytes:
    """Bytes of several documents, one after the other: each byte's document and place there, gate's part and contexts' hashes."""

    pair: np.ndarray  # 256 * byte before + byte
    doc: np.ndarray
    place: np.ndarray
    in_word: np.ndarray
    context: list[np.ndarray]  # within the tables' sizes


def _mix(h: np.ndarray) -> np.ndarray:
    h *= _U32(2654435761)
    h ^= h >> _U32(15)
    h *= _U32(0x85EBCA6B)
    h ^= h >> _U32(13)
    return h


def _masked(h: np.ndarray, bits: int) -> np.ndarray:
    return (h & _U32((1 << bits) - 1)).view(np.int32)


def joined(texts: list[bytes]) -> np.ndarray:
    """All texts, each with three zeros in front and the end mark behind."""
    return np.frombuffer(b"".join([x for t in texts for x in (b"\0\0\0", t, b"\xff")]), np.uint8)


def _ends(texts: list[bytes]) -> list[tuple[int, int]]:
    """Of each text among the joined ones, where its end mark ends, and its bytes with that mark."""
    sizes = [len(t) + 1 for t in texts]
    return [(e + 3 * i, n) for i, (e, n) in enumerate(zip(accumulate(sizes), sizes, strict=True), 1)]


def contexts(texts: list[bytes], data: np.ndarray, words: bool = False) -> Bytes:
    """words: only the word contexts, which counting can't tell from the bytes before."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    ends = _ends(texts)
    of = lambda x, shift=1: np.concatenate([x[:0], *[x[e - n - shift : e - shift] for e, n in ends]])
    wide = data.astype(_U32)
    # Hash of the word so far: a polynomial over the bytes since the last white space.
    index = np.arange(len(data), dtype=np.int32)
    inner = data > 32
    start = np.maximum.accumulate(index * (~inner | (data == END_BYTE)))  # the last white space, padding or end mark
    power, inverse = (x[: len(data)] for x in _powers(len(data), _U32))
    total = np.cumsum(wide * power, dtype=_U32)
    word = (total - _take(total, start)) * _take(inverse, start) + _U32(1)
    in_word = of(index - start)
    # The word before: the hash at the last byte of a word before ``start``; none before a text's first word.
    early = np.flatnonzero(in_word < PAIR_PLACES)
    at = early + 3 * _take(doc, early) + 2
    last = _take(np.maximum.accumulate(index * inner), _take(start, at))
    previous = _take(word, last) * _take(inner & (data != END_BYTE), last)
    pair = np.zeros(len(doc), np.int32)
    pair[early] = _masked(_mix((_take(word, at) ^ (previous * _U32(0x9E3779B1) + _U32(0x7F4A7C15))) * _U32(0xC2B2AE35)), BITS[-1]) | NEAR
    hashes = [word]
    if not words:
        two = wide.copy()
        two[1:] += wide[:-1] << _U32(8)
        three = two.copy()
        three[2:] += wide[:-2] << _U32(16)
        hashes = [two, three, word]
    hashes = [_masked(_mix(of(h)), bits) for h, bits in zip(hashes, BITS[-1 - len(hashes) :], strict=False)]
    place = np.empty(0, np.int32) if words else np.concatenate([index[:0], *[index[: len(t) + 1] for t in texts]])
    return Bytes((of(data).astype(np.int32) << 8) + of(data, 0), doc, place, np.minimum(in_word, PLACES - 1), [*hashes, pair])


_POWERS: dict = {}


def _powers(n: int, kind) -> list[np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2**32 or 2**64."""
    if len(_POWERS.get(kind, ((), ()))[0]) < n:
        size, bits = 1 << n.bit_length(), 8 * np.dtype(kind).itemsize
        odd = 0x01000193 if bits == 32 else 0x9E3779B97F4A7C15
        _POWERS[kind] = [np.cumprod(np.concatenate(([kind(1)], np.full(size - 1, x, kind))), dtype=kind) for x in (odd, pow(odd, -1, 1 << bits))]
    return _POWERS[kind]


def _take(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``table[at]`` for places that exist; this mode is several times faster."""
    return table.take(at, mode="clip")


def decisions(code: Code, index: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """index: the code's places of bytes.  Where each byte's decisions begin; per decision its byte and its place in the code."""
    sizes = _take(code.size, index)
    begin = np.cumsum(sizes) - sizes
    byte = np.repeat(np.arange(len(index)), sizes)
    at = _take(_take(code.begin, index) - begin, byte)
    at += np.arange(len(at))
    return begin, byte, at


def trust_of(counts: np.ndarray) -> np.ndarray:
    """Steps at 1, 4, 16 and 64."""
    return np.minimum((np.log2(np.maximum(counts, 0.25)) / 2 + 1).astype(np.int8), TRUST - 1)


def log_odds(counts: np.ndarray) -> np.ndarray:
    """counts: zeros and ones of each slot."""
    x = counts.astype(np.float32).reshape(-1, 2)
    return np.clip(np.rint(UNIT * np.log((x[:, 1] + 0.4) / (x[:, 0] + 0.4))), -127, 127).astype(np.int8)


@dataclass
class Mixer:
    code: Code
    tables: list[np.ndarray]
    trust: list[np.ndarray]  # how often the word so far, and with the word before, has been seen: by the slot of its first decision
    weights: np.ndarray  # GATES x INPUTS

    def bits(self, texts: list[bytes], rate: float = RATE, priced: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The code length of each text, the weights that each ends with, and the code length of each byte.

        priced: without it the code lengths, which the weights don't depend on, aren't worked out and are zeros.

        In a block, bytes lie by falling number of decisions, so those with another decision are always the first ones:
        all of them are taken one decision further at a time, and the few with very many at last together.
        """
        n = len(texts)
        weights = np.repeat(self.weights.astype(np.float32).T[:, None], n, axis=1).reshape(INPUTS, -1)  # input x (document x gate)
        levels = 1 / (1 + np.exp(-(np.arange(LEVELS) - LEVELS / 2 + 0.5) * 16 / LEVELS))
        refined = np.tile(levels, n).astype(np.float32)
        b = contexts(texts, joined(texts))
        steps, tables = self.code.steps, self.tables
        lines = [t.view(np.complex128) for t in tables]  # NEAR slots as one value, to be moved as they are
        # Documents by falling length: those still running are the first ones.
        rank = np.empty(n, np.int32)
        rank[np.argsort([-len(t) for t in texts], kind="stable")] = np.arange(n)
        index = self.code.index(b.pair)
        block, size = b.place // STEP, _take(self.code.size, index)
        edges = np.concatenate(([0], np.cumsum(np.bincount(block))))
        order = block * 32 + (31 - size)
        order = np.argsort(order.astype(np.uint16) if len(edges) <= 1 << 11 else order, kind="stable")
        size, begin, doc = _take(size, order), _take(self.code.begin, _take(index, order)), _take(_take(rank, b.doc), order)
        inputs = [_take(context, order) for context in b.context]
        gates = _take(b.in_word, order) * (TRUST * PAIRS) + doc * GATES
        gates += PAIRS * _take(self.trust[0], inputs[2])
        gates += np.minimum(_take(self.trust[1], inputs[3]), PAIRS - 1)
        cost = np.zeros(len(order), np.float32)
        for first, last in zip(edges[:-1], edges[1:], strict=True):
            now = slice(first, last)
            run, gate, where, own = int(doc[now].max()) + 1, gates[now], begin[now], cost[now]
            hashes, start = [x[now] for x in inputs], doc[now] * np.int32(LEVELS)
            mine, change = weights.take(gate, axis=1, mode="clip"), np.zeros((INPUTS, last - first), np.float32)
            # The slots of nodes side by side are fetched once for each byte.
            near = np.concatenate([_take(line, h >> 4) for line, h in zip(lines, hashes, strict=True)]).view(np.int8)
            places = np.arange(0, len(near), NEAR, dtype=np.int32).reshape(len(tables), -1)
            places += np.stack(hashes) & np.int32(NEAR - 1)
            hits = []
            more = last - first - np.concatenate(([0], np.cumsum(np.bincount(size[now]))))  # bytes of so many decisions at least
            for depth, k in enumerate(more[1:].tolist()):
                if k == 0:
                    break
                few = depth > 0 and k < FEW
                if few:
                    left = size[now][:k] - depth
                    pick = np.repeat(np.arange(k), left)
                    at = _take(where, pick) + depth + np.arange(len(pick)) - _take(np.cumsum(left) - left, pick)
                    of = lambda x: x.take(pick, axis=-1, mode="clip")  # noqa: B023, E731
                else:
                    at = where[:k] + depth
                    of = lambda x: x[..., :k]  # noqa: B023, E731
                step = _take(steps, at)
                node, bit = step >> 9, step & 1
                step >>= 1
                small = np.empty((INPUTS, len(at)), np.int8)
                small[0] = step.astype(np.int8)
                near.take(of(places) ^ (node & (NEAR - 1)), mode="clip", out=small[1:])
                far = np.flatnonzero(node >= NEAR)
                if len(far):
                    away, whose = _take(node, far), _take(pick, far) if few else far
                    for c, table in enumerate(tables):
                        small[c + 1, far] = _take(table, _take(hashes[c], whose) ^ away)
                seen = small.astype(np.float32)
                z = np.einsum("ik,ik->k", of(mine), seen)
                np.clip(z, -7.99, 7.99, out=z)
                p = np.negative(z)
                np.exp(p, out=p)
                p += 1
                np.reciprocal(p, out=p)
                came = bit.astype(np.float32)
                if priced:
                    z += 8
                    z *= LEVELS / 16
                    level = z.astype(np.int32)
                    level += of(start)
                    r = _take(refined, level)
                    r += p
                    r *= 0.5
                    np.clip(r, 1e-4, 1 - 1e-4, out=r)
                    np.subtract(1 - came, r, out=r)  # the chance of what came, or minus it
                    np.abs(r, out=r)
                    np.log(r, out=r)
                    level += level
                    level += bit
                    hits.append(level)
                np.subtract(came, p, out=p)
                seen *= p
                if few:
                    if priced:
                        own[:k] -= np.bincount(pick, r, k)
                    for total, x in zip(change, seen, strict=True):
                        total[:k] += np.bincount(pick, x, k)
                    break
                if priced:
                    own[:k] -= r
                change[:, :k] += seen
            for w, total in zip(weights, change, strict=True):
                w[: run * GATES] += (rate / UNIT**2) * np.bincount(gate, total, run * GATES)
            if not priced:
                continue
            zeros, ones = np.bincount(np.concatenate(hits), minlength=2 * run * LEVELS).astype(np.float32).reshape(-1, 2).T
            trials = zeros + ones
            refined[: run * LEVELS] += (ones - trials * refined[: run * LEVELS]) / (trials + 24)
        out = np.empty_like(cost)
        out[order] = cost
        out /= math.log(2)
        return np.bincount(b.doc, out, n), weights.reshape(INPUTS, n, GATES).transpose(1, 2, 0)[rank], out


def spans(texts: list[bytes], data: np.ndarray, cost: np.ndarray, every: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Per distinct (document, anchor, span): document, both hashes, occurrences, occurrences of the anchor there, bits of the bytes.

    data: the joined texts; cost: bits of each byte of the texts and their end marks.
    """
    power, inverse = (x[: len(data)] for x in _powers(len(data), _U64))
    total = np.cumsum(data * power, dtype=_U64)
    inner = (data > 32) & (data != END_BYTE)
    first, last = np.flatnonzero(inner[1:] & ~inner[:-1]) + 1, np.flatnonzero(inner[:-1] & ~inner[1:])  # a word's first and last byte
    stops = np.cumsum([len(t) + 4 for t in texts]) - 1  # the end marks
    doc = np.searchsorted(stops, last)
    word = (total[last] - total[first - 1]) * inverse[first]
    key = word.copy()
    key[1:] += word[:-1] * _U64(0xBF58476D1CE4E5B9)
    key[2:] += word[:-2] * _U64(0x94D049BB133111EB)
    key ^= key >> _U64(31)
    key *= _U64(0xD6E8FEB86659FD93)
    key ^= key >> _U64(32)
    fine = np.zeros(len(key), bool)
    fine[2:] = doc[2:] == doc[:-2]
    at = np.flatnonzero(fine & (key % _U64(every) == 0))
    doc, key, begin = doc[at], key[at], last[at]
    end = stops[doc]
    same = doc[1:] == doc[:-1]
    end[:-1][same] = begin[1:][same]
    span = ((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(_U64)) * _U64(0xD6E8FEB86659FD93)
    span ^= span >> _U64(32)
    upto = np.concatenate(([0.0], np.cumsum(cost, dtype=np.float64)))
    shift = 3 * (doc + 1)  # a text's padding isn't coded
    bits = upto[end + 1 - shift] - upto[begin + 1 - shift]
    order = np.lexsort((span, key, doc))
    doc, key, span, bits = doc[order], key[order], span[order], bits[order]
    if not len(doc):
        return doc, key.view(np.int64), span.view(np.int64), doc, doc, bits
    new_key = np.concatenate(([True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])))
    new = new_key | np.concatenate(([True], span[1:] != span[:-1]))
    at = np.flatnonzero(new)
    group = np.cumsum(new_key) - 1
    return doc[at], key[at].view(np.int64), span[at].view(np.int64), np.diff(np.append(at, len(doc))), np.bincount(group)[group[at]], np.add.reduceat(bits, at)


def _texts(column: pa.Array) -> list[bytes]:
    return [(t or "").encode() for t in column.to_pylist()]


def _lanes(texts: list[bytes], lanes: int = LANES, size: int = LANE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts to run side by side."""
    first = have = 0
    for i, t in enumerate(texts):
        if i > first and (i - first == lanes or have + len(t) > size):
            yield first, i
            first, have = i, 0
        have += len(t)
    if first < len(texts):
        yield first, len(texts)


def words_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The lower-case words of all texts, one after the other, and how many each text has."""
    raw = b"\n".join([b"", *texts, b""]).lower()
    data = np.frombuffer(raw, np.uint8)
    inner = (data != 32) & ((data < 9) | (data > 13))
    first = np.flatnonzero(inner[1:] & ~inner[:-1]) + 1
    upto = np.searchsorted(first, np.cumsum([0, *[len(t) + 1 for t in texts]]))
    edges = np.concatenate(([0], np.cumsum(np.flatnonzero(inner[:-1] & ~inner[1:]) + 1 - first))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(edges), pa.py_buffer(data[inner])]), np.diff(upto)


def threes_of(data: np.ndarray) -> np.ndarray:
    """Numbers of three bytes in a row, the second one a letter of a word, in texts set apart by zeros."""
    past = data[1:-1]
    at = np.flatnonzero((past > 32) & (past != END_BYTE))
    return data[:-2][at].astype(_U32) << _U32(16) | past[at].astype(_U32) << _U32(8) | data[2:][at]


def frequent_twos(counts: DataFrame, most: int = TWOS) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent two bytes of ``token_counts``, as numbers, and the counts of the 256 after each."""
    threes = counts.filter(F.substring("token", 1, 1) == F.lit(b"\t")).select(F.substring("token", 2, 2).alias("two"), "token", "c")
    often = threes.groupBy("two").agg(F.sum("c").alias("n")).orderBy(F.desc("n"), "two").limit(most)
    rows = threes.join(F.broadcast(often.select("two")), "two").select("token", "c").toArrow()  # at most 256 * most
    keys = np.array([int.from_bytes(t[1:]) for t in rows.column("token").to_pylist()], np.int64)
    twos, at = np.unique(keys >> 8, return_inverse=True)
    after = np.zeros((len(twos), 256))
    after[at, keys & 255] = rows.column("c").to_numpy()
    return twos, after


def token_counts(docs: DataFrame) -> DataFrame:
    """``token`` (binary), ``c``: of the lower-case words and end tokens; pairs of bytes count under a blank and the two,
    three bytes, whose second isn't white space, under a tab and the three."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: list[pa.Array] = []
        pairs = np.zeros(1 << 16, np.int64)
        threes: list[tuple[np.ndarray, np.ndarray]] = []
        rows = waiting = 0

        def out() -> Iterator[pa.RecordBatch]:
            counts = pa.chunked_array(words, pa.binary()).value_counts()
            more = {b" %c%c" % divmod(int(k), 256): int(pairs[k]) for k in np.flatnonzero(pairs)} | ({END_TOKEN: rows} if rows else {})
            for some, n in threes:
                for k, x in zip(some.tolist(), n.tolist(), strict=True):
                    k = b"\t" + k.to_bytes(3)
                    more[k] = more.get(k, 0) + x
            for token, c in ((counts.field("values"), counts.field("counts")), (pa.array(more.keys(), pa.binary()), pa.array(more.values(), pa.int64()))):
                yield pa.RecordBatch.from_arrays([token, c], ["token", "c"])

        for batch in batches:
            texts = _texts(batch.column(0))
            for a, b in _lanes(texts, 500):
                some = texts[a:b]
                rows += len(some)
                words.append(words_of(some)[0])
                data = np.frombuffer(b"\0".join([b"", *[t + b"\xff" for t in some]]), np.uint8)
                for part in range(0, len(data) - 1, COUNT_BYTES):
                    x = data[part : part + COUNT_BYTES + 1]
                    pairs += np.bincount((x[:-1].astype(np.int32) << 8) + x[1:], minlength=1 << 16)
                threes.append(_counted([threes_of(data)]))
                waiting += len(data)
                if waiting > WORD_BYTES:
                    yield from out()
                    words, threes, rows, waiting = [], [], 0, 0
                    pairs[:] = 0
        yield from out()

    return docs.select("text").mapInArrow(run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


class Slots:
    """Counts the bits of texts in the slots.  Equal contexts with equal next bytes are counted first, in portions.

    A byte with the three before it tells its places in the tables of two and of three bytes, so one sort serves both.
    """

    def __init__(self, code: Code, counts: list[np.ndarray] | None = None):
        self.code, self.counts = code, counts or [np.zeros(2 << b, _U32) for b in BITS]
        self.fours: list[np.ndarray] = []
        self.keys: list[list[np.ndarray]] = [[], []]
        self.waiting = 0

    def add(self, texts: list[bytes]) -> None:
        data = joined(texts)
        b = contexts(texts, data, words=True)
        index = self.code.index(b.pair)
        four = data.astype(_U32)
        for shift in (1, 2, 3):
            four[shift:] += data[:-shift].astype(_U32) << _U32(8 * shift)
        self.fours.append(np.concatenate([four[:0], *[four[e - s : e] for e, s in _ends(texts)]]))
        for keys, context, some in zip(self.keys, b.context, (None, np.flatnonzero(b.context[1])), strict=True):
            at = index
            if some is not None:
                context, at = _take(context, some), _take(at, some)
            key = context.astype(_U64)
            key <<= _U64(24)
            key |= at.astype(_U64)
            keys.append(key)
        self.waiting += len(b.pair)
        if self.waiting >= COUNT_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.waiting:
            four, n = _counted(self.fours)
            past = four >> _U32(8)
            index = (four & _U32(0xFFFF)).astype(np.int64)
            if self.code.row is not None:
                index = _take(self.code.row, past & _U32(0xFFFF)).astype(np.int64) << 8 | index & 255
            for c, context in enumerate((past & _U32(0xFFFF), past)):
                self._put(c, _masked(_mix(context), BITS[c]), index, n)
            for c, keys in enumerate(self.keys, 2):
                key, n = _counted(keys)
                self._put(c, (key >> _U64(24)).astype(np.int32), (key & _U64(0xFFFFFF)).astype(np.int64), n)
        self.fours, self.keys, self.waiting = [], [[], []], 0

    def _put(self, c: int, context: np.ndarray, index: np.ndarray, n: np.ndarray) -> None:
        _, byte, at = decisions(self.code, index)
        step = _take(self.code.steps, at)
        where = (_take(context, byte) ^ (step >> 9)) * 2 + (step & 1)
        np.add.at(self.counts[c], where, _take(n, byte))


def _counted(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The different values, and how often each is there."""
    key = np.concatenate(keys)
    key.sort()
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
    return key[first], np.diff(np.append(first, len(key))).astype(_U32)


def _packed(x: np.ndarray) -> bytes:
    return pa.compress(x.astype(_U32).tobytes(), "lz4", asbytes=True)


def _unpacked(data) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, 8 * PIECE, "lz4", asbytes=True), _U32)


PIECES = "context int, piece int, salt int, data binary"


def _piece(c: int, p: int, salt: int, x: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([p], pa.int32()), pa.array([salt], pa.int32()), pa.array([_packed(x)], pa.binary())], ["context", "piece", "salt", "data"])


def _sum_pieces(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Add up rows of ``PIECES`` with equal keys, one at a time: all rows of a key lie together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            for c, p, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True):
                if (c, p) != now:
                    if now:
                        yield _piece(*now, 0, np.minimum(total, 0xFFFFFFFF))
                    now, total = (c, p), np.zeros(2 * PIECE, np.uint64)
                total += _unpacked(data.as_buffer())
        if now:
            yield _piece(*now, 0, np.minimum(total, 0xFFFFFFFF))

    return rows.repartition(*keys).sortWithinPartitions("context", "piece").mapInArrow(run, PIECES)


def learn_counts(docs: DataFrame, code: Code, salts: int = 16) -> list[np.ndarray]:
    """The bits of each table's slots, from all of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots_of = Slots(code)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                texts = _texts(batch.column(0).slice(at, 500))
                for first, last in _lanes(texts, 500, LANE_BYTES):
                    slots_of.add(texts[first:last])
        slots_of.flush()
        salt = TaskContext.get().partitionId() % salts
        for c, x in enumerate(slots_of.counts):
            for p in range(len(x) // (2 * PIECE)):
                piece = x[2 * PIECE * p : 2 * PIECE * (p + 1)]
                if piece.any():
                    yield _piece(c, p, salt, piece)

    rows = docs.select("text").mapInArrow(run, PIECES)
    rows = _sum_pieces(_sum_pieces(rows, ["context", "piece", "salt"]), ["context", "piece"])
    counts = Slots(code).counts
    for r in rows.toLocalIterator():  # a table's pieces, one for each of its parts, whatever the corpus
        counts[r.context][2 * PIECE * r.piece : 2 * PIECE * (r.piece + 1)] = _unpacked(bytes(r.data))
    return counts


def mixer_of(code: Code, counts: list[np.ndarray], weights: np.ndarray) -> Mixer:
    trust = [trust_of(x.reshape(-1, 2).sum(axis=1, dtype=np.float32)) for x in counts[2:]]
    return Mixer(code, [log_odds(x) for x in counts], trust, weights)


def row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def learn_weights(docs: DataFrame, halves: list[Mixer]) -> np.ndarray:
    """Starting weights: those with which all rows of ``docs`` end, on average by bytes, against the tables of the half that they aren't in.

    docs: ``text``, ``half``, ``share`` (0 to the sum of ``SHARES``).  Every row takes part in one round.
    """
    shared, weights, first = docs.sparkSession.sparkContext.broadcast(halves), halves[0].weights, 0

    for n, size in enumerate(SHARES):

        def run(batches: Iterator[pa.RecordBatch], start: np.ndarray = weights, rate: float = 0.02 / (1 + n / 2)) -> Iterator[pa.RecordBatch]:
            mixers = [replace(m, weights=start) for m in reversed(shared.value)]
            total, length = np.zeros((GATES, INPUTS)), 0
            for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
                halved: list[list[bytes]] = [[], []]
                for t, half in zip(_texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                    halved[half].append(t)
                for mixer, texts in zip(mixers, halved, strict=True):
                    texts.sort(key=len)
                    for a, b in _lanes(texts):
                        sizes = np.array([len(t) + 1 for t in texts[a:b]])
                        total += np.tensordot(sizes, mixer.bits(texts[a:b], rate, priced=False)[1], 1)
                        length += int(sizes.sum())
            if length:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel()), pa.array([length] * total.size, pa.int64())], ["at", "total", "length"])

        part = docs.filter(F.col("share").between(first, first + size - 1)).select("text", "half")
        ends = part.mapInArrow(run, "at int, total double, length long").groupBy("at").agg((F.sum("total") / F.sum("length")).alias("mean")).collect()
        if ends:  # one for each weight
            weights = np.array([r.mean for r in sorted(ends)]).reshape(GATES, INPUTS)
        first += size
    shared.destroy()
    return weights


def dealt(docs: DataFrame) -> DataFrame:
    """``text``, ``half``, ``share`` of rows with ``doc_id, text``; equal rows lie together."""
    key = F.xxhash64("doc_id", "text")
    return docs.select("text", F.pmod(key, F.lit(2)).cast("int").alias("half"), F.pmod(F.shiftright(key, 1), F.lit(sum(SHARES))).cast("int").alias("share"))


def train(docs: DataFrame, *counts_of_bytes: np.ndarray) -> Mixer:
    """The tables of all rows of ``docs`` (doc_id, text), and the starting weights; by the codes of these counts."""
    code, rows = codes(*counts_of_bytes), dealt(docs)
    counts = [learn_counts(rows.filter(F.col("half") == half), code) for half in (0, 1)]
    weights = learn_weights(rows, [mixer_of(code, c, np.full((GATES, INPUTS), 0.3 / UNIT)) for c in counts])
    for one, other in zip(*counts, strict=True):
        np.minimum(one.astype(_U64) + other, 0xFFFFFFFF, out=one, casting="unsafe")
    return mixer_of(code, counts[0], weights)


def _rank_bin() -> Column:
    """Counts in steps of a sixteenth of a doubling."""
    return F.floor(F.log2("c") * 16).cast("int")


def head_bin(tokens: DataFrame, most: int = HEAD) -> int:
    """The least bin from which on there are at most ``most`` tokens."""
    bins = tokens.groupBy(_rank_bin().alias("bin")).count().collect()  # at most 16 * 64
    left = most
    for r in sorted(bins, key=lambda r: -r.bin):
        left -= r["count"]
        if left < 0:
            return r.bin + 1
    return 0


FIELDS = {
    "row": pa.int64(), "doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "known": pa.int64(), "base": pa.float64(), "bits": pa.float64(), "n_bytes": pa.int64(),
    "token": pa.list_(pa.binary()), "n": pa.list_(pa.int64()), "anchor": pa.list_(pa.int64()), "span": pa.list_(pa.int64()), "times": pa.list_(pa.int64()), "own": pa.list_(pa.int64()), "span_bits": pa.list_(pa.float64()),
}
SCHEMA = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, bits double, n_bytes long, token array<binary>, n array<long>, anchor array<long>, span array<long>, times array<long>, own array<long>, span_bits array<double>"


def _lists(sizes: list[int] | np.ndarray, values, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(values, kind))


def score(docs: DataFrame, train_on: str = "not held_out") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits, copied_spans`` of every row of ``docs``.

    docs: ``doc_id, text, held_out``.  train_on: condition of the rows to learn from.
    """
    spark = docs.sparkSession
    learn = docs.filter(train_on).select("doc_id", "text")
    counts = cut(token_counts(learn))
    pairs = np.zeros((256, 256))
    for r in counts.filter(F.substring("token", 1, 1) == F.lit(b" ")).collect():  # at most 2**16
        pairs[r.token[1], r.token[2]] = r.c
    tokens = counts.filter(~F.substring("token", 1, 1).isin(F.lit(b" "), F.lit(b"\t")))
    total = tokens.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, unit = total.n, total.n + total.v + 1
    mixer = train(learn, pairs, *frequent_twos(counts))
    often = tokens.filter(_rank_bin() >= head_bin(tokens)).toArrow()  # at most HEAD
    head = often.column("token").combine_chunks(), np.log10((often.column("c").to_numpy() + 1) / unit)
    shared = spark.sparkContext.broadcast((mixer, head))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mix, (frequent, log_c) = shared.value
        end = pc.index_in(pa.array([END_TOKEN], pa.binary()), frequent)[0].as_py()
        row = TaskContext.get().partitionId() << 33
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            texts = _texts(batch.column(1))
            order = sorted(range(len(texts)), key=lambda i: len(texts[i]))  # so documents side by side are equally long
            ids, out, texts = batch.column(0).take(order), batch.column(2).take(order), [texts[i] for i in order]
            bits, found = [], []
            for a, b in _lanes(texts):
                lane = texts[a:b]
                own, _, cost = mix.bits(lane)
                bits.append(own)
                x = spans(lane, joined(lane), cost)
                found.append((x[0] + a, *x[1:]))
            doc, *columns = (np.concatenate(x) for x in zip(*found, strict=True))
            n_tokens, n_known, base, kinds, rare, often = [], [], [], [], [], []
            for a, b in _lanes(texts, len(texts), WORD_BYTES // 4):
                words, sizes = words_of(texts[a:b])
                known = pc.index_in(words, frequent)
                lost = known.is_null().to_numpy(zero_copy_only=False)
                odds = log_c[known.fill_null(0).to_numpy()] if len(log_c) else np.zeros(len(words))
                odds[lost] = 0.0
                missed = np.concatenate(([0], np.cumsum(lost)))
                others, stops = words.filter(pa.array(lost)).to_pylist(), np.cumsum(sizes)
                odds = odds.tolist()
                for last, size in zip(stops.tolist(), sizes.tolist(), strict=True):
                    new = Counter(others[missed[last - size] : missed[last]])
                    total = odds[last - size : last]
                    n_known.append(size - sum(new.values()) + (end is not None))
                    if end is None:
                        new[END_TOKEN] = 1
                    else:
                        total.append(log_c[end])
                    n_tokens.append(size + 1)
                    base.append(math.fsum(total))
                    kinds.append(len(new))
                    rare += new.keys()
                    often += new.values()
            flat = [np.arange(row, row + len(texts)), ids, out, n_tokens, n_known, base, np.concatenate(bits), [len(t) for t in texts]]
            row += len(texts)
            lists = [_lists(kinds, rare, pa.binary()), _lists(kinds, often, pa.int64())]
            per_doc = np.bincount(doc, minlength=len(texts))
            lists += [_lists(per_doc, c, k) for c, k in zip(columns, [*[pa.int64()] * 4, pa.float64()], strict=True)]
            arrays = [x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip([*flat, *lists], FIELDS.values(), strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, list(FIELDS))

    rows = cut(docs.select(F.col("doc_id").cast("long"), "text", "held_out").mapInArrow(run, SCHEMA))
    rare = rows.select("row", F.inline(F.arrays_zip("token", "n"))).join(tokens.hint("shuffle_hash"), "token", "left").groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known_rare"),
        F.sum(F.col("n") * F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(unit)))).alias("base_rare"),
    )
    out = rows.select("row", "doc_id", "held_out", "n_tokens", "known", "base", "bits", "n_bytes").join(rare.hint("shuffle_hash"), "row", "left").join(span_changes(rows).hint("shuffle_hash"), "row", "left")
    bits = F.col("bits") + F.coalesce("change", F.lit(0.0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("known_rare", F.lit(0))).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("base_rare", F.lit(0.0))).alias("base_score"), (-bits * F.log10(F.lit(2.0))).alias("score"), "n_bytes", bits.alias("bits"), F.coalesce("copied", F.lit(0)).cast("long").alias("copied_spans"))


def span_changes(rows: DataFrame) -> DataFrame:
    """``row, change, copied``: bits that the decisions on spans add to a row (or save), and the spans copied."""
    seen = rows.select("row", F.col("held_out").alias("out"), F.inline(F.arrays_zip("anchor", "span", "times", "own", "span_bits")))
    by_span = seen.groupBy("anchor", "span").agg(F.sum(F.when(~F.col("out"), F.col("times")).otherwise(0)).alias("c"), F.count("*").alias("docs"))
    by_anchor = by_span.groupBy("anchor").agg(F.sum("c").alias("t"), F.count_if(F.col("c") > 0).alias("d"), F.sum("docs").alias("docs")).filter("docs > 1 and t > 0")
    # Anchors of one document change nothing, and most are such.
    known = by_span.select("anchor", "span", "c").join(by_anchor.select("anchor", "t", "d").hint("shuffle_hash"), "anchor")
    c = F.when(F.col("out"), F.col("c")).otherwise(F.col("c") - F.col("times"))
    t = F.when(F.col("out"), F.col("t")).otherwise(F.col("t") - F.col("own"))
    of = t + F.col("d")
    change = F.when(c > 0, F.col("times") * F.log2(of / c) - F.col("span_bits")).otherwise(F.col("times") * F.log2(of / F.col("d")))
    return seen.join(known.hint("shuffle_hash"), ["anchor", "span"]).filter(t > 0).groupBy("row").agg(F.sum(change).alias("change"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("copied"))
