"""Evaluation runs that are published whole: their modes, their queries, then the line that makes them count.

A run's two tables are written first, under its number, and a manifest line last; readers take
the numbers that have a line, so that a write that stopped in between is never seen, and its
number is used again. A baseline is a run's mode as one JSON row, which a later gate reads.
"""

from __future__ import annotations

import posixpath
import subprocess
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators.evaluation import HEADLINE, averages, provenance_gate

#: What two runs must share to be compared.
PROVENANCE = ("papers", "chunks", "queries", "golden_set_version", "top_k")
MANIFEST = "run long, commit string, created timestamp"
RUNS = "mode string, queries long, " + ", ".join(f"{m} double" for m in HEADLINE) + ", " + ", ".join(f"{k} long" for k in PROVENANCE if k != "queries") + ", commit string"


def commit_of(folder: str) -> str:
    """The commit that a folder's code is at; empty without one."""
    try:
        return subprocess.run(["git", "-C", folder, "rev-parse", "HEAD"], capture_output=True, text=True, timeout=10, check=True).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        return ""


@dataclass(frozen=True)
class RunLog:
    spark: SparkSession
    root: str

    def _path(self, *names: str) -> str:
        return posixpath.join(self.root, *names)

    def _there(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def published(self) -> DataFrame:
        """(run, commit, created) of the runs that count."""
        if not self._there(self._path("manifest")):
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).json(self._path("manifest", "run=*"))

    def publish(self, scored: DataFrame, provenance: dict[str, int], commit: str = "") -> int:
        """The number of a new run of scores (mode, item_id, metrics) with what it was measured on."""
        missing = set(PROVENANCE) - {"queries"} - set(provenance)
        if missing:
            raise ValueError(f"no {', '.join(sorted(missing))}")
        last = self.published().agg(F.max("run").alias("run")).first().run
        run = 0 if last is None else last + 1
        metrics = [c for c in scored.columns if c not in ("mode", "item_id")]
        scored.select("mode", "item_id", *metrics).write.mode("overwrite").parquet(self._path("queries", f"run={run}"))
        rows = self.spark.read.parquet(self._path("queries", f"run={run}"))
        means = averages(rows, ["mode"]).join(rows.groupBy("mode").agg(F.count("*").alias("queries")), "mode")
        known = {k: F.lit(v).cast("long") for k, v in provenance.items() if k in PROVENANCE and k != "queries"}
        means.withColumns(known | {"commit": F.lit(commit)}).write.mode("overwrite").parquet(self._path("runs", f"run={run}"))
        line = self.spark.range(1).select(F.lit(run).cast("long").alias("run"), F.lit(commit).alias("commit"), F.current_timestamp().alias("created"))
        line.coalesce(1).write.mode("overwrite").json(self._path("manifest", f"run={run}"))
        return run

    def _table(self, name: str, schema: str | None = None) -> DataFrame:
        numbers = sorted(r.run for r in self.published().select("run").collect())  # a number for each run
        if not numbers:
            raise ValueError("no run was published")
        reader = self.spark.read.option("basePath", self._path(name))
        reader = reader.schema(f"{schema}, run long") if schema else reader.option("mergeSchema", True)
        return reader.parquet(*[self._path(name, f"run={n}") for n in numbers])

    def runs(self) -> DataFrame:
        """A row for each mode of each run: averages, provenance, commit."""
        return self._table("runs", RUNS)

    def queries(self) -> DataFrame:
        """A row for each query of each mode of each run."""
        return self._table("queries")

    def write_baseline(self, name: str, run: int, mode: str) -> None:
        """A run's mode as the baseline of that name; the last one written counts."""
        row = self.runs().where((F.col("run") == run) & (F.col("mode") == mode))
        if row.isEmpty():
            raise ValueError(f"run {run} has no mode {mode}")
        row.coalesce(1).write.mode("overwrite").json(self._path("baselines", name))

    def baseline(self, name: str) -> DataFrame:
        if not self._there(self._path("baselines", name, "_SUCCESS")):
            raise ValueError(f"no baseline {name}")
        return self.spark.read.schema(f"run long, {RUNS}").json(self._path("baselines", name))

    def gate(self, name: str, run: int, mode: str, tolerance: float = 0.02) -> DataFrame:
        """(subject, before, after, failed) of a run's mode against a baseline."""
        after = self.runs().where((F.col("run") == run) & (F.col("mode") == mode))
        return provenance_gate(self.baseline(name), after, list(PROVENANCE), HEADLINE, tolerance)

    def worse(self, name: str, run: int, mode: str, metric: str = "ndcg_10") -> DataFrame:
        """(item_id, before, after) of queries that got worse than in the baseline's run."""
        base = self.baseline(name).first()
        of = lambda n, m, c: self.queries().where((F.col("run") == n) & (F.col("mode") == m)).select("item_id", F.col(metric).alias(c))
        return of(base.run, base["mode"], "before").join(of(run, mode, "after"), "item_id").where("after < before - 1e-9")
