"""Relevance, retrieval metrics, comparison of runs, gates."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.operators.lexicon import Index
from loomspan.sources.staging import staged

KS = (1, 5, 10)
#: Items that one pass over the documents looks for.
AUTOMATON = 100_000
#: Items at most that a comparison resamples, values that a median's last step counts, cut points
#: of a sketch.
MOST_ITEMS, FEW, CUTS = 1_000_000, 100_000, 64
METRICS = [f"{m}_{k}" for m in ("recall", "precision", "ndcg") for k in KS] + ["mrr"]
HEADLINE = ["recall_5", "recall_10", "mrr", "ndcg_10"]


def relevant(items: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, doc_id): documents that contain the item's text.

    One pass over the documents looks for all items at once with an automaton of at most
    ``AUTOMATON`` items; more of them take more passes. Empty items are in none.
    """
    items = items.where("text <> ''").select("item_id", "text")
    passes = max(1, -(-items.count() // AUTOMATON))
    item_kind, doc_kind = dict(items.dtypes)["item_id"], dict(docs.dtypes)["doc_id"]

    def found(known: list) -> DataFrame:
        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import ahocorasick

            of: dict[str, list] = {}
            for item, text in known:
                of.setdefault(text, []).append(item)
            automaton = ahocorasick.Automaton()
            for text, ids in of.items():
                automaton.add_word(text, ids)
            automaton.make_automaton()
            for batch in batches:
                rows = []
                for doc, text in zip(batch["doc_id"], batch["text"]):
                    if text and known:
                        rows.extend((item, doc) for item in {i for _, ids in automaton.iter(text) for i in ids})
                yield pd.DataFrame(rows, columns=["item_id", "doc_id"])

        return docs.select("doc_id", "text").mapInPandas(search, f"item_id {item_kind}, doc_id {doc_kind}")

    out = None
    for n in range(passes):
        known = [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == n).collect()]
        out = found(known) if out is None else out.unionByName(found(known))
    return out.distinct()


def containing(items: DataFrame, docs: DataFrame, index: Index) -> DataFrame:
    """(item_id, doc_id): what ``relevant`` gives, by an index of the documents' plain terms.

    A text within a document may begin and end within words, but those between are whole: the
    rarest of them names the documents that can hold the text, and only these are read for it.
    Items of fewer than three words are looked for in all documents.
    """
    items = items.where("text <> ''").select("item_id", "text")
    words = items.select("item_id", index.analysis.terms(F.col("text")).alias("w"))
    inner = words.where(F.size("w") > 2).select("item_id", F.explode(F.array_distinct(F.slice("w", 2, F.size("w") - 2))).alias("term"))
    inner = staged(inner, "inner-words")
    known = index.vocabulary(inner.select("term").distinct())
    rarest = inner.join(known, "term", "left").groupBy("item_id").agg(F.min_by("term", F.struct(F.coalesce("df", F.lit(0)), "term")).alias("term"))
    held = staged(index.holding(staged(rarest, "rarest-words")), "candidates")
    found = held.join(items, "item_id").join(docs.select("doc_id", F.col("text").alias("body")), "doc_id").where(F.contains("body", "text")).select("item_id", "doc_id").distinct()
    few = staged(items.join(words.where(F.size("w") <= 2), "item_id", "left_semi"), "short-items")
    return found if few.isEmpty() else found.unionByName(relevant(few, docs))


def scores(runs: DataFrame, truth: DataFrame) -> DataFrame:
    """(mode, item_id, metrics) of items with relevant documents, for runs (mode, item_id, doc_id, rank).

    An item that a run returns nothing for scores 0; items without labels have no row.
    """
    n_rel = truth.groupBy("item_id").agg(F.count("*").alias("n_rel"))
    every = runs.select("mode").distinct().join(n_rel)
    hits = runs.join(truth, ["item_id", "doc_id"]).select("mode", "item_id", "rank")
    joined = every.join(hits, ["mode", "item_id"], "left")

    def at(k: int) -> Column:
        return F.col("rank") <= k

    found = {k: F.count_if(at(k)) for k in KS}
    dcg = {k: F.coalesce(F.sum(F.when(at(k), 1 / F.log2(F.col("rank") + 1))), F.lit(0.0)) for k in KS}
    agg = joined.groupBy("mode", "item_id", "n_rel").agg(
        *[found[k].alias(f"h{k}") for k in KS], *[dcg[k].alias(f"d{k}") for k in KS], F.min(F.when(at(max(KS)), F.col("rank"))).alias("first")
    )

    def ideal(k: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_rel"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))

    return agg.select(
        "mode",
        "item_id",
        *[F.round(F.col(f"h{k}") / F.col("n_rel"), 6).alias(f"recall_{k}") for k in KS],
        *[F.round(F.col(f"h{k}") / k, 6).alias(f"precision_{k}") for k in KS],
        *[F.round(F.col(f"d{k}") / ideal(k), 6).alias(f"ndcg_{k}") for k in KS],
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"),
    )


def averages(scored: DataFrame, by: list[str], metrics: list[str] = HEADLINE) -> DataFrame:
    return scored.groupBy(*by).agg(*[F.round(F.coalesce(F.avg(m), F.lit(0.0)), 6).alias(m) for m in metrics])


def losses(scored: DataFrame, mode: str, metric: str = "ndcg_10") -> DataFrame:
    """Items where another mode is strictly better than ``mode``, with the best of them."""
    own = scored.where(F.col("mode") == mode).select("item_id", F.col(metric).alias("own"))
    best = scored.where(F.col("mode") != mode).groupBy("item_id").agg(F.max(metric).alias("rival"), F.min_by("mode", F.struct(-F.col(metric), "mode")).alias("beaten_by"))
    out = own.join(best, "item_id").where("rival > own")
    return out.select("item_id", "beaten_by", F.round(F.col("rival") - F.col("own"), 6).alias("deficit"))


def paired(scored: DataFrame, a: str, b: str, metric: str, n: int, seed: int) -> DataFrame:
    """Bootstrap interval and sign-flip p of the difference b - a; draws are hashes.

    ``n`` draws of as many items as there are, 95 % interval. The differences of the items are
    a vector of checked size that every block of draws is worked out against. Modes that were
    scored on different items, or on none, are an error.
    """
    of = lambda mode, name: scored.where(F.col("mode") == mode).select("item_id", F.col(metric).alias(name))
    wide = of(a, "x").join(of(b, "y"), "item_id", "full").orderBy("item_id").limit(MOST_ITEMS + 1).collect()
    if len(wide) > MOST_ITEMS:
        raise ValueError(f"more than {MOST_ITEMS} items to resample")
    if not wide:
        raise ValueError("nothing to compare")
    if any(r.x is None or r.y is None for r in wide):
        raise ValueError(f"{a} and {b} were not scored on the same items")
    spark, diffs = scored.sparkSession, np.array([r.y - r.x for r in wide])
    difference = round(float(np.mean(diffs)), 6)

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = len(diffs)

        def unit(tag: str, draw: int) -> np.ndarray:
            return np.array([int(hashlib.md5(f"{tag}|{seed}|{draw}|{i}".encode()).hexdigest()[:8], 16) for i in range(1, size + 1)])

        for batch in batches:
            out = [(float(diffs[unit("b", d) % size].mean()), float(np.where(unit("f", d) % 2 == 0, diffs, -diffs).mean())) for d in batch["draw"]]
            yield pd.DataFrame(out, columns=["mean", "flip"])

    tasks = spark.sparkContext.defaultParallelism
    draws = spark.range(1, n + 1, numPartitions=min(tasks, n)).withColumnRenamed("id", "draw").mapInPandas(drawn, "mean double, flip double")
    draws = draws.select(F.round("mean", 9).alias("mean"), F.round("flip", 6).alias("flip"))
    low, high = max(1, int(0.025 * n) + 1), min(int(0.975 * n) + 1, n)
    means = F.array_sort(F.collect_list("mean"))  # ``n`` numbers
    row = draws.agg(F.round(F.element_at(means, low), 6).alias("ci_low"), F.round(F.element_at(means, high), 6).alias("ci_high"), F.round((F.count_if(F.abs("flip") >= abs(difference)) + 1) / (n + 1), 6).alias("p"))
    count = lambda x: F.lit(int(x)).cast("long")
    return row.select(F.lit(difference).alias("difference"), "ci_low", "ci_high", "p", count((diffs > 0).sum()).alias("wins"), count((diffs < 0).sum()).alias("losses"), count((diffs == 0).sum()).alias("ties"))


def comparisons(scored: DataFrame, pairs: list[tuple[str, str]], metric: str, n: int, seed: int) -> DataFrame:
    """(a, b, n, mean_a, mean_b and what ``paired`` has, significant) of pairs of modes.

    ``significant``: the interval excludes 0.
    """
    out = None
    for a, b in pairs:
        of = lambda mode: F.round(F.avg(F.when(F.col("mode") == mode, F.col(metric))), 6)
        means = scored.agg(F.count_if(F.col("mode") == a).alias("n"), of(a).alias("mean_a"), of(b).alias("mean_b"))
        row = paired(scored, a, b, metric, n, seed).crossJoin(F.broadcast(means)).withColumn("a", F.lit(a)).withColumn("b", F.lit(b))
        out = row if out is None else out.unionByName(row)
    return out.withColumn("significant", (F.col("ci_low") > 0) | (F.col("ci_high") < 0))


def provenance_gate(before: DataFrame, after: DataFrame, keys: list[str], metrics: list[str], tolerance: float = 0.02) -> DataFrame:
    """(subject, before, after, failed) of two rows of provenance keys and metrics.

    A key that changed fails, and so does a metric that is missing or dropped by more than
    the tolerance.
    """
    every = keys + metrics
    tall = lambda df, name: df.select(*[F.col(c).cast("double") for c in every]).unpivot([], every, "subject", name)
    out = tall(before, "before").join(tall(after, "after"), "subject", "full")
    changed = ~F.col("before").eqNullSafe(F.col("after"))
    dropped = F.coalesce(F.col("after") < F.col("before") - tolerance, F.lit(True))
    return out.select("subject", "before", "after", F.when(F.col("subject").isin(keys), changed).otherwise(dropped).alias("failed"))


def label_violations(golden: DataFrame, pattern: str) -> DataFrame:
    """(rule, subject) of queries (item_id, class, labels) whose labels break a rule."""
    labels = F.coalesce("labels", F.array().cast("array<string>"))
    none = F.size(labels) == 0
    unanswerable = F.col("class") == "unanswerable"
    broken = F.array_compact(
        F.array(
            F.when(F.size(F.array_distinct(labels)) < F.size(labels), "repeated label"),
            F.when(unanswerable & ~none, "label of an unanswerable query"),
            F.when(~unanswerable & none, "no label"),
            F.when(F.exists(labels, lambda x: ~F.coalesce(x.rlike(pattern), F.lit(False))), "malformed label"),
        )
    )
    return golden.select(F.explode(broken).alias("rule"), F.col("item_id").cast("string").alias("subject"))


def broken_runs(run: DataFrame, truth: DataFrame) -> DataFrame:
    """(rule, item_id) of a ranked run (item_id, doc_id) that metrics can't be computed for."""
    twice = run.groupBy("item_id", "doc_id").count().where("count > 1").select(F.lit("repeated hit").alias("rule"), "item_id").distinct()
    unlabelled = run.select("item_id").distinct().join(truth, "item_id", "left_anti").select(F.lit("nothing relevant").alias("rule"), "item_id")
    return twice.unionByName(unlabelled)


def gate(before: DataFrame, after: DataFrame, metrics: list[str], tolerance: float = 0.02) -> DataFrame:
    """(metric, before, after, failed) of two rows of averages; a missing value fails."""
    tall = lambda df, name: df.unpivot([], metrics, "metric", name)
    out = tall(before, "before").join(tall(after, "after"), "metric", "full")
    return out.select("metric", "before", "after", F.coalesce(F.col("after") < F.col("before") - tolerance, F.lit(True)).alias("failed"))


def mode_pairs(scored: DataFrame, metric: str) -> DataFrame:
    """(pair, difference, wins, losses, ties) of every two modes, right minus left.

    Modes that were scored on different items are an error.
    """
    sizes = scored.groupBy("mode").agg(F.count("*").alias("n"), F.sum(F.xxhash64("item_id") % (1 << 32)).alias("which"))
    same = sizes.agg((F.count_distinct("n", "which") <= 1).alias("same"))
    left = scored.select("item_id", F.col("mode").alias("a"), F.col(metric).alias("x"))
    right = scored.select("item_id", F.col("mode").alias("b"), F.col(metric).alias("y"))
    d = F.col("y") - F.col("x")
    out = left.join(right, "item_id").where("a < b").groupBy(F.concat_ws("-", "b", "a").alias("pair"))
    out = out.agg(F.round(F.avg(d), 6).alias("difference"), F.count_if(d > 0).alias("wins"), F.count_if(d < 0).alias("losses"), F.count_if(d == 0).alias("ties"))
    checked = F.when(F.col("same"), F.col("pair")).otherwise(F.raise_error(F.lit("modes were scored on different items")))
    return out.crossJoin(F.broadcast(same)).withColumn("pair", checked).drop("same")


def leaders(averaged: DataFrame, metrics: list[str] = HEADLINE) -> DataFrame:
    """(metric, best, leaders): every mode that reaches the best average."""
    tall = averaged.unpivot(["mode"], metrics, "metric", "value")
    best = tall.groupBy("metric").agg(F.max("value").alias("best"))
    return tall.join(best, "metric").where("value = best").groupBy("metric", "best").agg(F.array_join(F.array_sort(F.collect_list("mode")), ",").alias("leaders"))


def hits_and_misses(run: DataFrame, truth: DataFrame) -> DataFrame:
    """(item_id, hits, misses, first_hit) of a ranked run against the relevant documents."""
    both = truth.join(run.select("item_id", "doc_id", "rank"), ["item_id", "doc_id"], "left")
    return both.groupBy("item_id").agg(F.count("rank").alias("hits"), F.count_if(F.col("rank").isNull()).alias("misses"), F.min("rank").alias("first_hit"))


def violations(golden: DataFrame, classes: list[str], per_class: int, longest: int = 512) -> DataFrame:
    """(rule, subject) of queries (item_id, query, class) that break a rule of the set."""
    known = F.col("class").isin(classes)
    broken = F.array_compact(
        F.array(
            F.when(F.coalesce(F.trim("query"), F.lit("")) == "", F.lit("blank query")),
            F.when(F.char_length("query") > longest, F.lit("long query")),
            F.when(~known, F.lit("unknown class")),
        )
    )
    own = golden.select(F.explode(broken).alias("rule"), F.col("item_id").cast("string").alias("subject"))
    again = golden.groupBy("item_id").count().where("count > 1").select(F.lit("repeated id").alias("rule"), F.col("item_id").cast("string").alias("subject"))
    sizes = golden.where(known).groupBy("class").count().where(F.col("count") != per_class).select(F.lit("class size").alias("rule"), F.col("class").alias("subject"))
    return own.unionByName(again).unionByName(sizes)


def medians(df: DataFrame, by: str, value: str, few: int = FEW) -> DataFrame:
    """(by, n, middle, upper_middle): the interpolated median and the element above the middle.

    Each group's two places close in on their values: a sketch of the values that are still in
    question gives cut points, counts below and between two of them tell which side of them a
    place is on, and only what lies there is looked at again. Once at most ``few`` values are
    left they are counted by value, so no task sorts a group. A median of nothing is no row.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.col(by).alias("k"), F.col(value).alias("v"))
    sizes = rows.groupBy(F.col("k").alias("g")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    places = F.array(F.struct(F.lit("low").alias("which"), F.floor((F.col("n") + 1) / 2).alias("place")), F.struct(F.lit("high").alias("which"), (F.floor(F.col("n") / 2) + 1).alias("place")))
    state = sizes.select("g", "n", "lo", "hi", F.explode(places).alias("p"), F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"))
    state = staged(state.select("g", "n", "lo", "hi", "p.*", "below", "inside"), "places")
    asked = ["g", "which", "place", "below", "inside", "lo", "hi"]
    within = F.col("k").eqNullSafe(F.col("g")) & F.col("v").between(F.col("lo"), F.col("hi"))
    while True:
        wide = state.where((F.col("inside") > few) & (F.col("lo") < F.col("hi"))).select(*asked)
        if wide.isEmpty():
            break
        cuts = rows.join(wide, within).groupBy(*asked).agg(F.percentile_approx("v", [i / CUTS for i in range(CUTS + 1)], 10_000).alias("cuts"))
        at = F.floor((F.col("place") - F.col("below")) / F.col("inside") * CUTS).cast("int")
        near = lambda i: F.element_at("cuts", F.greatest(F.lit(1), F.least(F.lit(CUTS + 1), i)))
        cuts = staged(cuts.select(*asked, near(at).alias("a"), near(at + 3).alias("b")), "cuts")
        v, low, high = F.col("v"), F.col("a"), F.col("b")
        # five parts, of which the cut points themselves are two: each round leaves less than before
        parts = {"p0": v < low, "p1": v == low, "p2": (v > low) & (v < high), "p3": (v == high) & (high > low), "p4": v > high}
        aggregates = [f(F.when(which, v)).alias(f"{kind}{name}") for name, which in parts.items() for kind, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]
        side = rows.join(cuts, within).groupBy("g", "which", "place", "below", "inside").agg(*aggregates)
        before = [F.col("below")]
        for name in parts:
            before.append(before[-1] + F.col(f"n{name}"))
        pick = lambda values: F.coalesce(*[F.when((F.col("place") > before[i]) & (F.col("place") <= before[i + 1]), x) for i, x in enumerate(values)])
        moved = side.select(
            F.col("g").alias("of"), F.col("which").alias("end"), pick(before[:-1]).alias("below2"), *[pick([F.col(f"{kind}{name}") for name in parts]).alias(new) for kind, new in (("lo", "lo2"), ("hi", "hi2"), ("n", "inside2"))]
        )
        both = state.join(moved, F.col("g").eqNullSafe(F.col("of")) & (F.col("which") == F.col("end")), "left")
        new = [F.coalesce(f"{c}2", c).alias(c) for c in ("lo", "hi", "below", "inside")]
        state = staged(both.select("g", "n", "which", "place", *new), "places")
    last = state.select(F.col("g").alias("of"), "n", "which", "place", "below", "lo", "hi")
    counts = rows.join(last, F.col("k").eqNullSafe(F.col("of")) & F.col("v").between(F.col("lo"), F.col("hi"))).groupBy("of", "which", "place", "below", "n", "v").agg(F.count("*").alias("times"))
    upto = F.col("below") + F.sum("times").over(Window.partitionBy("of", "which").orderBy("v"))  # ``few`` values at most
    found = counts.withColumn("upto", upto).where((F.col("upto") >= F.col("place")) & (F.col("upto") - F.col("times") < F.col("place")))
    out = found.groupBy("of").agg(F.max("n").alias("n"), *[F.max(F.when(F.col("which") == w, F.col("v"))).alias(w) for w in ("low", "high")])
    return out.select(F.col("of").alias(by), "n", ((F.col("low") + F.col("high")) / 2).alias("middle"), F.col("high").alias("upper_middle"))
