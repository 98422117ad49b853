"""Sentences on why a hit stands where it does, and on how two runs compare."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The sentences that readers of the results know.
UNKNOWN = "No ranking explanation available for this result."
ALONE = " Only one retriever found this paper; the other missed it."
FAILED = " WARNING: {} failed during this search, so these results do not reflect the full configured system."
SINGLE = {"dense": "cosine similarity", "bm25": "BM25 score"}
VERDICTS = ("significant", "not distinguishable from zero")


def fixed(value: Column, digits: int, exact: int = 9) -> Column:
    """A number with so many decimals, rounded half away from zero in decimal."""
    return F.round(value.cast(f"decimal(18,{exact})"), digits).cast(f"decimal(18,{digits})").cast("string")


def signed(value: Column, digits: int, exact: int = 6) -> Column:
    return F.concat(F.when(value < 0, "-").otherwise("+"), fixed(F.abs(value), digits, exact))


def fused_sentence(names: list[str], k: int, failed: list[str] | None = None) -> Column:
    """Explains rows with <run>_rank, <run>_score and <run>_contribution; a run without rank isn't told."""

    def told(name: str) -> Column:
        score, share = F.col(f"{name}_score"), F.col(f"{name}_contribution")
        return F.when(
            F.col(f"{name}_rank").isNotNull(),
            F.concat(
                F.lit(f"{name} ranked it #"),
                F.col(f"{name}_rank"),
                F.coalesce(F.concat(F.lit(", score "), fixed(score, 4, 6)), F.lit("")),
                F.coalesce(F.concat(F.lit(", contributing "), fixed(share, 5)), F.lit("")),
            ),
        )

    runs = F.array_compact(F.array(*[told(n) for n in names]))
    warning = F.lit(FAILED.format(", ".join(failed)) if failed else "")
    said = F.concat(F.lit("Fused from "), F.array_join(runs, "; "), F.lit(f". Reciprocal rank fusion with k={k}."), F.when(F.size(runs) == 1, ALONE).otherwise(""), warning)
    return F.when(F.size(runs) == 0, UNKNOWN).otherwise(said)


def single_sentence(name: str, score: Column) -> Column:
    known = F.concat(F.lit(f"Retrieved by {name}, {SINGLE[name]} "), fixed(score, 4, 6), F.lit("."))
    return F.coalesce(known, F.lit(f"Retrieved by {name}."))


def contributions(detail: DataFrame, names: list[str]) -> DataFrame:
    """(item_id, doc_id, runs, missing): runs with all three numbers, the largest share first."""
    whole = lambda n: F.col(f"{n}_rank").isNotNull() & F.col(f"{n}_score").isNotNull() & F.col(f"{n}_contribution").isNotNull()
    one = lambda n: F.when(whole(n), F.struct((-F.col(f"{n}_contribution")).alias("c"), F.concat(F.lit(f"{n}@"), F.col(f"{n}_rank")).alias("t")))
    runs = F.transform(F.array_sort(F.array_compact(F.array(*[one(n) for n in names]))), lambda x: x["t"])
    missing = F.array_compact(F.array(*[F.when(~whole(n), n) for n in names]))
    return detail.select("item_id", "doc_id", F.array_join(runs, ",").alias("runs"), F.array_join(missing, ",").alias("missing"))


def comparison_sentence(a: Column, b: Column) -> Column:
    """Describes rows of a comparison (see ``evaluation.comparisons``)."""
    verdict = F.when(F.col("significant"), VERDICTS[0]).otherwise(VERDICTS[1])
    s = lambda c: signed(F.col(c), 3)
    return F.concat(b, F.lit(" - "), a, F.lit(" = "), s("difference"), F.lit(" 95% CI ["), s("ci_low"), F.lit(", "), s("ci_high"), F.lit("], p="), fixed(F.col("p"), 3, 6), F.lit(" ("), verdict, F.lit("; "), F.col("wins"), F.lit(" wins / "), F.col("losses"), F.lit(" losses / "), F.col("ties"), F.lit(" ties over n="), F.col("n"), F.lit(")"))
