"""SentencePiece models on the tokenizers library.

The model's protobuf is read field by field: pieces with scores and kinds, the model's type, the normaliser's
settings.  From them a tokenizer is rebuilt: the normaliser (a precompiled character map, if any, the collapsing of white
space, the metaspace marker for blanks and the marker in front), the model (unigram with its scores, or byte-pair
encoding whose merges are those pairs of pieces that make a piece, ranked by its score), byte fallback, user-defined
pieces set apart before all else, and the decoder.

Encoding a table: texts go through the rebuilt tokenizer in batches, on ``threads`` threads.  Where no piece has a marker
after another character, nothing is merged across the front of a word, nor across a line feed if no piece holds one, so
a text's ids are those of its words; then a Python worker keeps the ids of words that it has seen (at most ``MEMO``), and
only the others go through the tokenizer, many joined to one text, whose ids are taken apart at the marks.  Other models
encode every text as it is.

Parity: the sentencepiece library encodes every whole text too, and a row says whether its ids are the same.

Decoding joins the pieces' texts as bytes, from a table; the tests hold it against the rebuilt decoder, which is many times
slower.

Edge cases: null and empty texts have no ids and decode to the empty text; null ids decode to null; each byte that
isn't UTF-8 after decoding becomes a replacement mark; texts of any length are encoded whole; repeated rows are treated alike; an
empty table gives an empty result; columns of the input with the name of an added one are replaced.
"""

from __future__ import annotations

import codecs
import os
import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MARK, MEMO, LONG, JOINED = "▁", 600_000, 64, 400
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2
UNIT = re.compile(f"{MARK}+[^{MARK}\\n]*|[^{MARK}\\n]+|\\n")


codecs.register_error("one_mark_a_byte", lambda e: ("\ufffd", e.start + 1))


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    collapse: bool = True
    escape: bool = True


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protobuf message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        wire = key & 7
        if wire == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(wire) or varint()
            yield key >> 3, data[at : at + size]
            at += size


def parse(data: bytes) -> Model:
    model = Model()
    for number, value in _fields(data):
        if number == 1:
            piece = {1: b"", 2: b"\0\0\0\0", 3: NORMAL} | dict(_fields(value))
            model.pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0], piece[3]))
        elif number == 2:
            trainer = dict(_fields(value))
            model.kind, model.byte_fallback = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0))
        elif number == 3:
            norm = dict(_fields(value))
            model.charsmap, model.dummy_prefix, model.collapse, model.escape = norm.get(2, b""), bool(norm.get(3, 1)), bool(norm.get(4, 1)), bool(norm.get(5, 1))
    return model


def _merges(model: Model) -> list[tuple[str, str]]:
    """Pairs of pieces by the score of what they make; among equal scores the longer first, as they grow from the left."""
    known = {p for p, _, k in model.pieces if k == NORMAL}
    out = []
    for piece, score, kind in model.pieces:
        if kind == NORMAL:
            out += [(-score, -len(piece), piece[:i], piece[i:]) for i in range(1, len(piece)) if piece[:i] in known and piece[i:] in known]
    return [(a, b) for _, _, a, b in sorted(out, key=lambda x: x[:2])]


def rebuild(model: Model):
    """The tokenizer of a model."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    unknown = next((i for i, (_, _, k) in enumerate(model.pieces) if k == UNKNOWN), None)
    own = [p for p, _, k in model.pieces if k == USER]
    if model.kind == BPE:
        vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        core = models.BPE(vocab, _merges(model), unk_token=model.pieces[unknown][0] if unknown is not None else None, fuse_unk=True, byte_fallback=model.byte_fallback, ignore_merges=bool(own))
    elif model.kind == UNIGRAM:
        core = models.Unigram([(p, s + 1000 * (k == USER)) for p, s, k in model.pieces], unknown, model.byte_fallback)
    else:
        raise ValueError(f"models of type {model.kind} are not known")
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.collapse:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    steps += [normalizers.Prepend(MARK)] if model.dummy_prefix else []
    steps += [normalizers.Replace(" ", MARK)] if model.escape else []
    tokenizer.normalizer = normalizers.Sequence(steps)
    if own:  # the longest first; they are found in the normalised text and never merged with others
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex("|".join(map(re.escape, sorted(own, key=len, reverse=True)))), "isolated")
    back = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    tokenizer.decoder = decoders.Sequence(back + ([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []))
    return tokenizer


class Codec:
    def __init__(self, path: str, threads: int = 2):
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        from sentencepiece import SentencePieceProcessor

        with open(path, "rb") as f:
            self.model = m = parse(f.read())
        self.threads, self.tokenizer, self.other = threads, rebuild(m), SentencePieceProcessor(model_file=path)
        bare = [p for p, _, k in m.pieces if k in (NORMAL, USER)]
        plain = m.kind == BPE and m.escape and m.dummy_prefix and not m.collapse and not m.charsmap and not any(k == USER for _, _, k in m.pieces)
        self.feed = next((i for i, (p, _, k) in enumerate(m.pieces) if k == BYTE and p == "<0x0A>"), None)
        self.by_word = plain and MARK in bare and self.feed is not None and not any(MARK in p.lstrip(MARK) or "\n" in p for p in bare)
        self.opens = np.array([p.startswith(MARK) for p, _, _ in m.pieces])
        self.memo: dict[str, bytes] = {}
        self.text = [b"" if k in (CONTROL, UNKNOWN) else bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode() for p, _, k in m.pieces]

    def units(self, text: str) -> list[str]:
        marked = MARK + text.replace(" ", MARK)
        if MARK in text or MARK * 2 in marked or "\0" in text:
            return UNIT.findall(marked)
        return [u for u in (MARK + text.replace(" ", "\0" + MARK)).replace("\n", "\0\n\0").split("\0") if u]

    def learn(self, units: list[str]) -> None:
        """Encode words joined to texts, and take the ids apart: before each marker, or at the line feeds between."""
        words = [u for u in units if u[0] == MARK and u != MARK and MARK not in u[1:]]
        others = [u for u in set(units).difference(words) if u != "\n"]
        self._learn(words, " ", "", 1, lambda ids: np.flatnonzero(self.opens[ids]), 0)
        self._learn(others, "\n", "\n", 0, lambda ids: np.flatnonzero(ids == self.feed), 1)
        self.memo["\n"] = struct.pack("<I", self.feed)

    def _learn(self, units: list[str], between: str, before: str, skip: int, parts, width: int) -> None:
        groups = [units[at : at + JOINED] for at in range(0, len(units), JOINED)]
        texts = [before + between.join(u[skip:].replace(MARK, " ") for u in g) for g in groups]
        for g, own in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(own.ids, "<u4")
            cuts = parts(ids).tolist()
            if len(cuts) != len(g):
                raise ValueError("words and ids don't match")
            data = ids.tobytes()
            self.memo.update((u, data[4 * (a + width) : 4 * b]) for u, a, b in zip(g, cuts, [*cuts[1:], len(ids)], strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian 32-bit numbers."""
        if not self.by_word:
            return [array("I", e.ids).tobytes() if t else b"" for t, e in zip(texts, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True)]
        memo, split = self.memo, [self.units(t) if t else [] for t in texts]
        new = list(set().union(*split).difference(memo))
        self.learn(new)
        out = [b"".join(map(memo.__getitem__, units)) for units in split]
        for u in new:
            if len(u) > LONG:
                del memo[u]
        if len(memo) > MEMO:  # frequent words came early
            self.memo = dict(islice(memo.items(), MEMO // 2))
        return out

    def parity(self, texts: list[str], ids: list[bytes]) -> list[bool]:
        """Whether the other library gives each whole text the same ids."""
        return [array("I", a).tobytes() == b for a, b in zip(self.other.encode(texts, num_threads=self.threads), ids, strict=True)]

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.text.__getitem__, ids))
        return (text[1:] if self.model.dummy_prefix and text[:1] == b" " else text).decode(errors="one_mark_a_byte")


@cache
def codec(path: str, threads: int = 2) -> Codec:
    """One for each Python worker, whose later tasks find the words of earlier ones."""
    return Codec(path, threads)


def encode(docs: DataFrame, path: str, text: str = "text", threads: int = 2, restored: bool = False) -> DataFrame:
    """Add ``ids`` (array of int), ``parity`` and, if asked for, ``restored`` (decoding gives the text back) to each row."""
    added = {"ids": pa.list_(pa.int32()), "parity": pa.bool_()} | ({"restored": pa.bool_()} if restored else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, threads)
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                some = batch.slice(at, 250)
                texts = [t or "" for t in some.column(text).to_pylist()]
                found = own.encode(texts)
                ends = np.concatenate(([0], np.cumsum([len(ids) // 4 for ids in found], dtype=np.int32)))
                values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(found))])
                arrays = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values), pa.array(own.parity(texts, found), pa.bool_())]
                if restored:
                    arrays.append(pa.array([own.decode(memoryview(ids).cast("I")) == t for t, ids in zip(texts, found, strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays([*[some.column(c) for c in kept], *arrays], [*kept, *added])

    kept = [c for c in docs.columns if c not in added]
    types = {"ids": T.ArrayType(T.IntegerType()), "parity": T.BooleanType(), "restored": T.BooleanType()}
    schema = T.StructType([*[docs.schema[c] for c in kept], *[T.StructField(c, types[c]) for c in added]])
    return docs.select(*kept).mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, ids: str = "ids", threads: int = 2) -> DataFrame:
    """Add ``decoded`` (string) to each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, threads)
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                some = batch.slice(at, 250)
                texts = [None if x is None else own.decode(x) for x in some.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*[some.column(c) for c in kept], pa.array(texts, pa.string())], [*kept, "decoded"])

    kept = [c for c in rows.columns if c != "decoded"]
    return rows.select(*kept).mapInArrow(run, T.StructType([*[rows.schema[c] for c in kept], T.StructField("decoded", T.StringType())]))
