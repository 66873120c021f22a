"""Byte-level BPE against the tiktoken library, divergences and centroids against brute force."""

import hashlib
import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("headway.llm")

from headway.llm import byte_bpe, centroids, divergence, queries

from .test_operators import DOCS, SMALL, none, odd, small  # noqa: F401

# Byte-level BPE


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(queries.tokenizer_path(queries.RANKS))


@pytest.fixture(scope="module")
def library(ranks):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec(ranks):
    import public_tokenizers

    return byte_bpe.Codec(ranks, public_tokenizers.PATTERN)


def test_rank_queue():
    queue, rng = byte_bpe.RankQueue(70_000), random.Random(1)
    for _ in range(3):
        entries = [(rng.choice((5, 255, 256, 69_999, rng.randrange(70_000))), rng.randrange(1000)) for _ in range(500)]
        for rank, at in entries:
            queue.push(rank, at)
        got = []
        while queue.low < queue.ranks:
            got.append((queue.low, queue.pop()))
        assert got == sorted(entries)


def test_bpe_equals_the_library_on_all_code_points(codec, library):
    every = "".join(f"{chr(i)}a" for i in (*range(0xD800), *range(0xE000, 0x40000), *range(0xE0000, 0xE1000), *range(0x10FF00, 0x110000)))  # the rest is unassigned
    assert next(codec.encode([every])) == library.encode_ordinary(every)


def test_bpe_long_pre_tokens_equal_the_library(codec, library):
    rng = random.Random(2)
    texts = ["", "a", " ", "\r\n \t", "<|endoftext|>", "the" * 40_000, "x" * 200_000, " " * 100_001, "一" * 50_000]
    texts += ["".join(rng.choice(letters) for _ in range(n)) for letters in ("ab", "a", "aab é'", "一二", "the", "0123") for n in (1, 2, 3, 63, 64, 65, 66, 5000)]
    got = list(codec.encode(texts))
    for text, ids in zip(texts, got, strict=True):
        assert ids == library.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_bpe_short_and_long_ways_agree(codec, ranks):
    rng = random.Random(3)
    tokens = [bytes(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for letters in (b"ab", b"then ", bytes(range(256)), b"\xc3\xa9\xe4\xb8") for _ in range(200)]
    assert codec.merge_short(tokens) == [codec.merge_long(t) for t in tokens]
    assert codec.merge_short([]) == []


def test_bpe_equal_ranks_wait_for_lower_ones():
    # "ab" (rank 301) twice in a row: the first merge makes a pair of a lower rank, which takes the second one's "a".
    ranks = {bytes([i]): i for i in range(256)} | {b"aba": 300, b"ab": 301, b"abb": 302}
    codec = byte_bpe.Codec(ranks, r".+")
    assert codec.merge_long(b"abab") == (300, ord("b"))
    assert codec.merge_short([b"abab", b"ab", b"aabb"]) == [(300, ord("b")), (301,), (ord("a"), 302)]


def test_bpe_cache_keeps_its_bound(ranks, library, monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(byte_bpe, "CACHE", 50)
    monkeypatch.setattr(byte_bpe, "BLOCK", 200)
    codec = byte_bpe.Codec(ranks, public_tokenizers.PATTERN)
    texts = [f"word{i} and {i % 7} unusualwords{i} qqzzq" for i in range(300)]
    assert list(codec.encode(texts)) == [library.encode_ordinary(t) for t in texts]
    assert len(codec.known) <= 50 and len(codec.older) <= 50


def test_bpe_query(spark, small, library):
    rows = {r.doc_id: r for r in queries.op12_byte_bpe(spark, SMALL).collect()}
    docs = small.collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = library.encode_ordinary(d.text or "")
        r = rows[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


def test_bpe_edges(spark, odd, none, library):
    import public_tokenizers

    path, pattern = queries.tokenizer_path(queries.RANKS), public_tokenizers.PATTERN
    coded = byte_bpe.encode(odd, path, pattern)
    assert sorted(coded.columns) == sorted(odd.columns)  # its ``ids`` are replaced
    back = byte_bpe.decode(coded, path, pattern).select("text", "ids", "decoded", "score").collect()
    assert len(back) == odd.count()
    for r in back:
        assert list(r.ids) == library.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode() and r.score == "mine"
    assert byte_bpe.digests(none, path, pattern).count() == 0
    twice = odd.select("text", F.lit(1).alias("x"), F.lit(2).alias("x"))
    assert byte_bpe.encode(twice, path, pattern).columns == ["text", "x", "x", "ids"]


# Source divergence


def brute_divergence(rows, least, top):
    """By the words of the contract: (lang, source, part, item, value, rank)."""
    docs = [(r.lang or "", r.source or "", divergence.TERM.findall((r.text or "").encode().lower())) for r in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        seen, counts = Counter(t for d in mine for t in set(d[2])), defaultdict(Counter)
        for _, source, terms in mine:
            counts[source].update(t for t in terms if seen[t] >= least)
        kept, whole = sorted(t for t, n in seen.items() if n >= least), sum(counts.values(), Counter())
        p = lambda of: {t: 1 + int(Fraction(10**9 * (of[t] + 5), sum(of.values()) + 5 * len(kept))) for t in kept}
        each, q = {s: p(of) for s, of in counts.items()}, p(whole)
        for s in each:
            pairs = [(-sum(abs(each[s][t] - each[o][t]) for t in kept), o.encode()) for o in each if o != s]
            terms = [(q[t] - each[s][t], t) for t in kept if counts[s][t] and each[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(found, 1)]
    return sorted(out)


def plainly(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("spill, sources, terms", [(divergence.SPILL, divergence.SOURCES, divergence.TERMS), (50, 8, 150)])
def test_divergence(small, spill, sources, terms):
    assert plainly(divergence.audit(small, 5, 4, spill, sources, terms)) == brute_divergence(small.collect(), 5, 4)


def test_terms_by_splitting_are_the_matches():
    data = b"".join(bytes([a, b]) + b"Ab" for a in range(256) for b in range(256))
    assert data.translate(divergence.FOLDED).split() == divergence.TERM.findall(data.lower())


def test_divergence_of_many_sources_and_partitions(spark):
    rng = random.Random(5)
    words = [f"w{chr(97 + i)}" for i in range(20)] + ["é", "E\u0301", "İ", "ß", "\u2028x"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(12))), rng.choice(["en", "de", None]), f"s{min(rng.randrange(30), rng.randrange(30))}", 0) for i in range(400)]
    docs = spark.createDataFrame(rows + rows[:50], DOCS).repartition(13)
    assert plainly(divergence.audit(docs, 3, 5, 11, 4, 3)) == brute_divergence(docs.collect(), 3, 5)


def test_divergence_edges(odd, none):
    odd = odd.unionByName(odd.filter("doc_id = 4").withColumn("source", F.lit("other")))
    assert plainly(divergence.audit(odd, 1, 50)) == brute_divergence(odd.collect(), 1, 50)
    few = plainly(divergence.audit(odd))  # no term is in thirty documents
    assert few == brute_divergence(odd.collect(), 30, 50) and {r[2] for r in few} == {"pair"} and {r[4] for r in few} == {0}
    assert divergence.audit(none).count() == 0


def test_scaled_is_exact():
    rng = random.Random(4)
    pairs = [(a, b) for b in (1, 7, 10**6, 2**40 + 1, 9 * 10**15) for a in (0, 1, b // 3, b - 1, b)] + [(rng.randrange(b), b) for b in (rng.randrange(1, 2**53) for _ in range(200))]
    count, total = np.array(pairs).T
    assert divergence.scaled(count, total).tolist() == [10**9 * a // b for a, b in pairs]


def test_divergence_query(same_as_sql):
    same_as_sql(queries.op11_source_divergence, queries.oracle_sql()["op11_source_divergence"])


# Centroids


def brute_centroids(rows, k=16, rounds=3, length=64):
    """By the words of the contract, in Python's whole numbers: sorted (vec_id, cluster, distance, cluster_inertia, inertia, sha256)."""
    kept = [(r.vec_id, [math.floor(Fraction(x) * 64) for x in r.embedding]) for r in rows if r.embedding is not None and len(r.embedding) == length and all(x is not None and math.isfinite(x) for x in r.embedding)]
    text = lambda i: "" if i is None else str(i)
    now = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"1:{text(r[0])}".encode()).hexdigest(), r[1]))[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    for step in range(rounds + 1):
        near = [min((far(v, c), j) for j, c in enumerate(now)) for _, v in kept]
        if step < rounds:
            for j in range(len(now)):
                if mine := [v for (_, v), (_, n) in zip(kept, near, strict=True) if n == j]:
                    now[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    fits = lambda n: n if n < 2**63 else None
    inertia = [sum(d for d, n in near if n == j) for j in range(len(now))]
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    out = [(i, n, fits(d), fits(inertia[n]), fits(sum(inertia)), name[n]) for (i, _), (d, n) in zip(kept, near, strict=True)]
    return sorted(out, key=str)


def clusters_of(df):
    return sorted((tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


VECTORS = "vec_id long, embedding array<double>, label int"


def test_centroids_query(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    assert clusters_of(queries.op13_centroid_clustering(spark, SMALL)) == brute_centroids(rows.collect())


@pytest.mark.parametrize("rounds, k", [(0, 16), (1, 3), (6, 9), (3, 1), (3, 2), (3, 500)])
def test_centroids_with_many_ties(spark, rounds, k):
    rng = random.Random(rounds)
    rows = [(i, [rng.choice((-0.02, 0.0, 0.01, 0.5)) if j < 3 else 0.25 for j in range(64)], 1) for i in range(300)]
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    assert clusters_of(centroids.centroids(df, k, rounds)) == brute_centroids(df.collect(), k, rounds)


def test_centroids_edges(spark):
    rng = random.Random(9)
    vector = lambda size=1.0, n=64: [rng.gauss(0, size) for _ in range(n)]
    odd = [None, [], vector(n=63), vector(n=65), [*vector(n=63), None], [*vector(n=63), float("nan")], [*vector(n=63), float("inf")], [0.0] * 64, [-0.0] * 64, vector(1e-320), vector(3e6), vector(1e9), vector(1e300), [1.7e308] * 64]
    rows = [(i, v, None) for i, v in enumerate(odd)] + [(100 + i, vector(), 1) for i in range(60)]
    rows += [(None, vector(), 1), (None, vector(), 1), rows[30], rows[30], (7, vector(), 1)]
    df = spark.createDataFrame(rows, VECTORS)
    more = df.withColumns({c: F.lit("mine") for c in ("v", "big", "near", "cluster", "distance", "upper", "n")})
    assert clusters_of(centroids.centroids(more)) == brute_centroids(df.collect())
    some = df.filter("vec_id between 100 and 105 or vec_id = 12")  # fewer than the centroids asked for
    assert clusters_of(centroids.centroids(some)) == brute_centroids(some.collect())
    assert centroids.centroids(df.filter("vec_id < 7")).count() == 0
    assert centroids.centroids(spark.createDataFrame([], VECTORS)).count() == 0


def test_shallot_search_compares_few(spark, monkeypatch):
    """Far groups: after the first round the bounds decide nearly all vectors, and the ball leaves out most centroids."""
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(40, 64)) * 50
    x = np.concatenate([m + rng.normal(size=(30, 64)) for m in middle]).astype(np.int64)
    now = [[int(c) for c in m] for m in middle]
    c = centroids.Centroids(now, None)
    seen, plain = [], centroids._squares
    monkeypatch.setattr(centroids, "_squares", lambda d: seen.append(len(d)) or plain(d))
    start = np.zeros(len(x), int)
    near, second, d1, d2 = centroids.search(x, c, start, start + 1)
    want = ((x[:, None, :] - np.array(now)[None]) ** 2).sum(axis=2)
    assert near.tolist() == want.argmin(axis=1).tolist() and d1.tolist() == want.min(axis=1).tolist()
    assert d2.tolist() == np.sort(want, axis=1)[:, 1].tolist() and (second != near).all()
    cold = sum(seen)
    seen.clear()
    again = centroids.search(x, c, near, second)
    assert again[0].tolist() == near.tolist() and sum(seen) < cold / 2
    # Sure by its bounds alone: nothing is computed.
    import pandas as pd

    frame = pd.DataFrame({"vec_id": range(len(x)), "v": list(x.astype(np.int32)), "big": None, "near": near.astype(np.int32), "second": second.astype(np.int32), "upper": np.sqrt(d1), "lower": np.sqrt(d2)})
    moved = [[a + 1 for a in m] for m in now]
    seen.clear()
    out = next(centroids._assigned(iter([frame]), moved, now, 64))
    assert out["near"].tolist() == near.tolist() and sum(seen) <= 40 + 40 + 5  # between centroids alone
