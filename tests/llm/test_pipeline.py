"""The pipeline against its stages' brute-force versions."""

import itertools

import pytest
from pyspark.sql import functions as F

pytest.importorskip("headway.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from headway.llm import queries
from headway.llm.common import cut

from .test_operators import brute_components, brute_counts, check_packing

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "toxicity", "simhash_near_dedup", "packing"]
    # Too few labels here to prove a cutoff: the base rules alone decide (see the tests of the operator for cutoffs).
    first = cut(stages["quality_rules"](spark, docs, FOLDER))
    counts = {d.doc_id: brute_counts(d.text) for d in docs.collect()}
    assert {d.doc_id for d in first.collect()} == {k for k, c in counts.items() if c[0] >= 50 and 2 * c[4] <= c[0]}
    second = cut(stages["toxicity"](spark, first, FOLDER))
    assert second.columns == docs.columns
    clean, kept = {d.doc_id for d in first.collect()}, {d.doc_id for d in second.collect()}
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    assert kept <= clean
    assert len([k for k in clean - kept if toxic.get(k) == 0]) <= 0.05 * len(clean)
    third = cut(stages["simhash_near_dedup"](spark, second, FOLDER))
    assert sorted(d.doc_id for d in third.collect()) == near_groups(second.collect())
    check_packing(third.collect(), stages["packing"](spark, third, FOLDER).collect())


def test_registered(spark):
    assert queries.queries()["pipeline"] is corpus_pipeline.run
    assert queries.queries()["pipeline"](spark, FOLDER).count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


def near_groups(docs):
    """The smallest ids of the groups of texts whose five-word shingles have a similarity of at least 0.8."""
    sets = {d.doc_id: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for d in docs for w in [d.text.encode().lower().split()]}
    near = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    return sorted(set(brute_components(sorted(sets), near).values()))


def test_near_duplicates_stage_is_five_words_at_four_fifths(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, FOLDER)
    assert sorted(d.doc_id for d in kept.collect()) == near_groups(docs.collect())


def test_odd_documents_keep_their_columns(spark):
    words = " ".join(f"Word{i}" for i in range(60))
    rows = [(1, None, "en"), (2, "", None), (None, words, "en"), (None, words + " and more", "de"), (3, words, None), (3, words, None), (4, "few words", "en"), (5, words.replace("W", "V") + "\n" * 5, "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    clash = ("score", "spans", "n_words", "kept", "base_failed", "__node", "fp", "node")
    docs = docs.withColumns({c: F.concat(F.lit("mine "), F.coalesce("text", F.lit("")).substr(1, 5)) for c in clash})
    stages = dict(corpus_pipeline.STAGES)
    now = docs
    for name in list(stages)[:-1]:
        now = cut(stages[name](spark, now, FOLDER))
        assert now.columns == docs.columns
        assert all(r[c] == "mine " + r.text[:5] for r in now.collect() for c in clash)
    # Copies and near copies under one id or none are one group; its first document by id stays.
    assert sorted((r.doc_id for r in now.collect()), key=str) == [3, 5]
    check_packing(now.collect(), stages["packing"](spark, now, FOLDER).collect())
    none = docs.filter("false")
    for name, stage in stages.items():
        assert stage(spark, none, FOLDER).count() == 0, name
