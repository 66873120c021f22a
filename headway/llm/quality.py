"""Quality rules whose cutoffs carry a guarantee.

Each document gets a handful of signals (rates per word, line or letter).  A rule rejects a document when a
signal exceeds its cutoff.  Cutoffs are chosen per stratum on documents with a quality label, none of which took
part in fitting anything (the grid of cutoffs is fixed beforehand), so all of them serve as the hold-out.

The bad labelled documents alone say which signals take part in a stratum: those whose strictest cutoff rejects at least
``POWER`` of them.  The good ones then decide.  A stratum's ``alpha`` is shared out evenly among its signals.  A signal's
cutoffs are tested one after the other from the loosest on, which rejects the fewest: each by the exact binomial test
against "more than its share of the good documents would be lost", at level ``delta`` / number of all sequences
(Bonferroni over strata and signals), and a sequence ends at the first cutoff that isn't proven.  Such a fixed sequence
needs no correction over its cutoffs.  So per stratum at most ``alpha`` of good documents are rejected by the learned rules,
in all strata at once with probability 1 - ``delta``, whichever proven cutoffs are taken: here those with the best gain
(bad documents rejected, minus ``price`` times the good ones).  A stratum with too few labels to prove anything keeps
everything that passes the base rules.

Everything is DataFrame expressions: signals are computed row by row without a shuffle, and only small numeric rows
of labelled documents are joined and counted.

Edge cases: a null text has no words and fails the base rule (fewer than 50 words); a null stratum is a stratum of its
own, named by the empty text; labels repeated for a document count once, the lower quality wins, null qualities are
ignored; a value equal to a cutoff passes; texts of any length are measured whole; repeated documents are judged row by row and alike; input columns with the name of an added one are
replaced; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, spaced, words_of

SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: The grid of cutoffs of each rate, fixed before any label is seen.
RATES: Mapping[str, Sequence[float]] = {
    "symbols_per_word": (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.5, 0.75, 1.0),
    "dup_line_rate": (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.75, 0.9),
    "repeat_word_rate": (0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45),
    "upper_rate": (0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7, 0.9),
    "shouts_per_word": (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.75),
    "chars_per_word": (7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0, 30.0),
}
ALPHA, DELTA, PRICE, POWER = 0.05, 0.05, 5.0, 0.1
#: Up to so many strata have their cutoffs broadcast (a row of eight numbers each); beyond, they are joined by shuffle.
BROADCAST_STRATA = 10_000


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts, ``n_lines``, ``n_upper`` and ``n_shouts`` (all long) of the whole text to each row."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    # The windows of three words by a 64-bit hash, sorted: equal ones are neighbours, whose words are compared.
    windows = F.expr("sort_array(transform(sequence(0, greatest(size(__words) - 3, 0)), i -> struct(xxhash64(get(__words, i), get(__words, i + 1), get(__words, i + 2)) as w, i as at)))")
    alike = lambda y: f"coalesce(x.w = {y}.w and get(__words, x.at) = get(__words, {y}.at) and get(__words, x.at + 1) = get(__words, {y}.at + 1) and get(__words, x.at + 2) = get(__words, {y}.at + 2), false)"
    twice = F.expr(f"filter(__windows, (x, i) -> {alike('get(__windows, i - 1)')} or {alike('get(__windows, i + 1)')})")
    covered = F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["at"], x["at"] + 1, x["at"] + 2))))
    n = F.size("__words")
    return (
        docs.withColumns({"__spaced": spaced(t), "__lines": lines})
        .withColumns({"__words": words_of(F.col("__spaced"))})
        .withColumns({"__windows": windows, "n_words": n.cast("long")})
        .withColumns({
            "word_chars": (F.length("__spaced") - F.greatest(F.col("n_words") - 1, F.lit(0))).cast("long"),
            "n_symbols": F.regexp_count(t, F.lit(f"[{SYMBOLS}]")).cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": F.size(covered).cast("long"),
            "n_lines": F.size("__lines").cast("long"),
            "n_upper": F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long"),
            "n_shouts": F.regexp_count(t, F.lit(r"!!")).cast("long"),
        })
        .drop("__words", "__lines", "__windows", "__spaced")
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rates() -> dict[str, Column]:
    """The signals under the rules, from the columns of ``measure``."""
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "symbols_per_word": per("n_symbols", "n_words"), "dup_line_rate": per("n_dup_lines", "n_lines"), "repeat_word_rate": per("n_repeat_words", "n_words"),
        "upper_rate": per("n_upper", "word_chars"), "shouts_per_word": per("n_shouts", "n_words"), "chars_per_word": per("word_chars", "n_words"),
    }


def binomial_cdf(k: Column, n: Column, p: float | Column) -> Column:
    """P(X <= k) for X ~ Bin(n, p), by adding the terms from 0 on."""
    p = p if isinstance(p, Column) else F.lit(p)
    odds = F.log(p) - F.log(1 - p)
    first = F.struct((n * F.log(1 - p)).alias("log"), F.lit(0.0).alias("sum"))
    step = lambda a, i: F.struct((a["log"] + F.log((n - i) / (i + F.lit(1))) + odds).alias("log"), (a["sum"] + F.exp(a["log"])).alias("sum"))
    return F.when(k >= n, 1.0).otherwise(F.aggregate(F.sequence(F.lit(0).cast("long"), F.least(k, n - 1).cast("long")), first, step, lambda a: a["sum"]))


def _below(rate: str, cutoffs: Sequence[float]) -> Column:
    """How many of the cutoffs a value exceeds."""
    n = F.lit(0)
    for c in cutoffs:
        n = n + (F.col(rate) > c).cast("int")
    return n


def calibrate(measured: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA, price: float = PRICE, power: float = POWER, grid: Mapping[str, Sequence[float]] = RATES) -> DataFrame:
    """One row per stratum with an admissible cutoff: ``stratum`` and a column ``cut_<rate>`` for each rate (null: no rule)."""
    judged = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("good"))
    rows = measured.filter(~base_failed()).select("doc_id", F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), *[c.alias(k) for k, c in rates().items()]).join(judged, "doc_id")
    # The bin of a value is the number of its rate's cutoffs below it; it is rejected by cutoffs 1 to bin.
    bins = F.array(*[F.struct(F.lit(k).alias("rate"), _below(k, grid[k]).alias("bin")) for k in grid])
    counts = rows.select("stratum", "good", F.explode(bins).alias("b")).groupBy("stratum", "b.rate", "b.bin").agg(F.sum((F.col("good") == 1).cast("long")).alias("good"), F.sum((F.col("good") == 0).cast("long")).alias("bad"))
    steps = F.array(*[F.struct(F.lit(k).alias("rate"), F.lit(i + 1).alias("bin"), F.lit(float(c)).alias("cutoff")) for k in grid for i, c in enumerate(grid[k])])
    tested = counts.select("stratum").distinct().select("stratum", F.explode(steps).alias("s")).select("stratum", "s.*")
    all_bins = tested.join(counts, ["stratum", "rate", "bin"], "left").unionByName(counts.filter("bin = 0").withColumn("cutoff", F.lit(None).cast("double")))
    above = Window.partitionBy("stratum", "rate").orderBy(F.desc("bin"))
    whole = Window.partitionBy("stratum", "rate")
    lost = [F.coalesce(F.sum(F.coalesce(c, F.lit(0))).over(above), F.lit(0)).alias(f"{c}_lost") for c in ("good", "bad")]
    sums = all_bins.select("stratum", "rate", "bin", "cutoff", *lost, *[F.sum(c).over(whole).alias(f"n_{c}") for c in ("good", "bad")]).filter("cutoff is not null")
    # From here on tables of strata x cutoffs.
    strong = sums.filter((F.col("bin") == 1) & (F.col("bad_lost") > 0) & (F.col("bad_lost") >= power * F.col("n_bad"))).select("stratum", "rate")
    strong = cut(strong.select("*", F.count("*").over(Window.partitionBy("stratum")).alias("signals")))
    level, share = delta / max(1, strong.count()), alpha / F.col("signals")
    proven = F.when(F.col("good_lost") <= share * F.col("n_good"), binomial_cdf(F.col("good_lost"), F.col("n_good"), share) <= level).otherwise(False)
    so_far = whole.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    tested = sums.join(strong, ["stratum", "rate"]).withColumn("proven", F.min(F.coalesce(proven, F.lit(False))).over(so_far))
    gain = F.col("bad_lost") - price * F.col("good_lost")
    best = tested.filter("proven").filter(gain > 0).groupBy("stratum", "rate").agg(F.max_by("cutoff", F.struct(gain, "cutoff")).alias("cutoff"))
    return best.groupBy("stratum").agg(*[F.max(F.when(F.col("rate") == k, F.col("cutoff"))).alias(f"cut_{k}") for k in grid])


def judge(measured: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """Add ``base_failed`` and ``kept`` to measured rows."""
    small = cut(cutoffs)
    small = F.broadcast(small) if small.count() <= BROADCAST_STRATA else small
    rules = [c[4:] for c in cutoffs.columns if c != "stratum"]
    over = [F.coalesce(rates()[k] > F.col(f"cut_{k}"), F.lit(False)) for k in rules]
    lost = F.lit(False)
    for rule in over:
        lost = lost | rule
    key = F.coalesce(F.col(stratum).cast("string"), F.lit(""))
    joined = measured.withColumn("__stratum", key).join(small.withColumnRenamed("stratum", "__stratum"), "__stratum", "left")
    return joined.withColumns({"base_failed": base_failed(), "kept": ~base_failed() & ~lost}).drop("__stratum", *[f"cut_{k}" for k in rules])


def judge_documents(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """Documents with their signals and verdicts.

    The measured rows are written to the shared folder and read again, so each text is worked on once: the
    calibration then reads only the small columns, the judgement all those that ``docs`` has.
    """
    measured = cut(measure(docs))
    return judge(measured, calibrate(measured, labels, stratum), stratum)
