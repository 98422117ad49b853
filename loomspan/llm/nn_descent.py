"""Near-duplicate vectors by NN-descent on a neighbour graph.

Equal vectors of a label are one node with a weight. Nodes start with lists of the nearest
members of cells, of equal random hyperplane signs within a label, in as many trees as give
a pair at the threshold a chance of ``START_RECALL`` to share a cell. A round then joins
every node's neighbours, in both directions, and compares them with each other: neighbours
of neighbours become candidates, and each list keeps its best. An audit compares the lists
of a sample of nodes, enlarged until it holds enough links, with brute force over all rows;
rounds, each with fresh trees, go on until the sample's recall of links is reached. Edges of
at least the threshold, computed in double precision on the original vectors, are the links.

A node whose whole list consists of links is saturated: its list is enlarged to its
whole component, which is compared block by block, so no link within it is lost and no
task holds more than two blocks. Only counts leave those blocks, never all pairs. Full
lists may hide links to other components: saturated nodes of different components are
compared with each other, except blocks whose centres lie farther apart than both radii
and the threshold's angle allow, and components that link become one before they are
enlarged. The audit counts a link only if it is in a list or within such a component.

Defined cases: vectors that are null, empty, zero, of another length than the vector
they would be compared with, or that hold null or non-finite components, and those with
a null label, link with nothing; equal vectors link with each other; rows of one id are
one vector for its links (the id itself is not among them) and a row each of the result; a
null id links with nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.components import components
from loomspan.llm.multi_index import usable
from loomspan.llm.shared import table

THRESHOLD = 0.93
#: Entries of a neighbour list, and of its reverse.
NEIGHBOURS, REVERSE = 8, 8
#: Nodes of a cell, planes of a tree at most, and entries that each node gets from a cell
#: besides links.
CELL, PLANES, FROM_CELL = 512, 24, 3
START_RECALL = 0.999
#: Nodes of the first audit and of the largest; links that it should hold; recall asked for.
AUDIT, MOST_AUDITED, AUDIT_LINKS, AUDIT_RECALL = 256, 4096, 100, 0.999
BLOCK = 2048


def _unit(vectors: list[bytes]) -> np.ndarray:
    """Unit rows, in double precision, of vectors of one length, each a type mark and numbers."""
    kind = np.float32 if vectors[0][:1] == b"f" else np.float64
    x = np.frombuffer(b"".join(v[1:] for v in vectors), kind).reshape(len(vectors), -1).astype(np.float64)
    x /= np.abs(x).max(1)[:, None]  # so that squares neither overflow nor vanish
    return x / np.sqrt(np.square(x).sum(1))[:, None]


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of unit rows, in double precision."""
    return x @ y.T


def _vectors(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, v, key) of the rows that can link; equal vectors of a label share the key."""
    single = "array<float>" in rows.select(vector_col).dtypes[0][1]

    @F.pandas_udf("binary")
    def packed(x: pd.Series) -> pd.Series:
        if single:
            return x.map(lambda v: b"f" + (np.asarray(v, np.float32) + np.float32(0)).tobytes())
        return x.map(lambda v: b"d" + (np.asarray(v, np.float64) + 0.0).tobytes())

    vector = F.col(vector_col) if single else F.col(vector_col).cast("array<double>")
    good = rows.where(usable(F.col(vector_col)) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    label = F.xxhash64(F.col(label_col), F.size(vector_col))
    out = good.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), packed(vector).alias("v")).dropDuplicates(["id"])
    return out.withColumn("key", F.sha2(F.concat(F.col("label").cast("string").cast("binary"), "v"), 256))


def _best(edges: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """The k best distinct (u, v, s) of every u."""
    best = F.slice(F.array_sort(F.collect_set(F.struct((-F.col("s")).alias("n"), "v"))), 1, k)
    return edges.groupBy("u").agg(best.alias("l")).select("u", F.explode("l").alias("e")).select("u", "e.v", (-F.col("e.n")).alias("s"))


def _compared(groups: DataFrame, keep: int, least: float = 2.0) -> DataFrame:
    """(u, v, s): within each row's members, an array of (id, v), each one's best others.

    ``keep`` of them, or ``NEIGHBOURS`` where they are links.
    """

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            us, vs, ss = [], [], []
            for members in batch["members"]:
                ids = np.array([m["id"] for m in members], np.int64)
                x = _unit([m["v"] for m in members])
                c = _cosines(x, x)
                np.fill_diagonal(c, -2)
                for k, lowest in ((keep, -2.0), (NEIGHBOURS, least)):
                    k = min(k, len(ids) - 1)
                    near = np.argpartition(-c, k - 1, axis=1)[:, :k]
                    s = np.take_along_axis(c, near, 1)
                    row, at = np.nonzero(s >= lowest)
                    us.append(ids[row])
                    vs.append(ids[near[row, at]])
                    ss.append(s[row, at])
                    if c.max() < least:
                        break
            if us:
                yield pd.DataFrame({"u": np.concatenate(us), "v": np.concatenate(vs), "s": np.concatenate(ss)})

    return groups.where(F.size("members") > 1).mapInPandas(compare, "u long, v long, s double")


def _start(vectors: DataFrame, least: float, seed: int) -> DataFrame:
    """Lists from random hyperplane cells, in several trees."""
    sizes = table(vectors.groupBy("label").agg(F.count("*").alias("n")), "label-sizes")
    largest = sizes.agg(F.max("n").alias("n")).first().n or 1
    # so many planes that a cell of evenly spread vectors holds about half of CELL
    planes_of = lambda n: max(0, min(PLANES, math.ceil(math.log2(n * 2 / CELL))))
    together = (1 - math.acos(min(1.0, least)) / math.pi) ** planes_of(largest)
    trees = 1 if together >= START_RECALL else math.ceil(math.log(1 - START_RECALL) / math.log(1 - together))

    @F.pandas_udf("array<long>")
    def signs(v: pd.Series) -> pd.Series:
        out = np.zeros((len(v), trees), np.int64)
        weights = 1 << np.arange(PLANES)
        lengths = v.map(len).to_numpy()
        for length in set(lengths.tolist()):
            rows = np.flatnonzero(lengths == length)
            x = _unit(v.iloc[rows].tolist())
            rng = np.random.default_rng([seed, x.shape[1]])
            for t in range(trees):
                out[rows, t] = (x @ rng.normal(size=(x.shape[1], PLANES)) >= 0) @ weights
        return pd.Series(list(out))

    rows = vectors.withColumn("signs", signs("v")).join(sizes, "label")
    depth = F.greatest(F.lit(0), F.least(F.lit(PLANES), F.ceil(F.log2(F.col("n") * 2 / CELL)))).cast("int")
    rows = rows.withColumn("depth", depth).select("id", "label", "v", "depth", F.posexplode("signs").alias("tree", "sign"))
    cell = F.xxhash64("label", "tree", F.expr("sign % shiftleft(1L, depth)"))
    # cells that hold more, of vectors that lie closer together, are dealt out at random;
    # what that parts is left to the rounds
    keys = vectors.select("id", "label", signs("v").alias("signs")).join(sizes, "label").withColumn("depth", depth)
    keys = keys.select("label", "depth", F.posexplode("signs").alias("tree", "sign"))
    counts = keys.groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).where(F.col("n") > 2 * CELL)
    rows = rows.select("id", "v", cell.alias("cell")).join(counts, "cell", "left")
    part = F.pmod(F.xxhash64("id", "cell"), F.greatest(F.lit(1), F.ceil(F.coalesce("n", F.lit(0)) / CELL)).cast("long"))
    rows = rows.select("id", "v", F.xxhash64("cell", part).alias("cell"))
    return _compared(rows.groupBy("cell").agg(F.collect_list(F.struct("id", "v")).alias("members")), FROM_CELL, least)


def _refined(lists: DataFrame, vectors: DataFrame, least: float, seed: int) -> DataFrame:
    """One round: every node's neighbours, both ways, compared with each other."""
    back = lists.select(F.col("v").alias("u"), F.col("u").alias("v"))
    drawn = F.slice(F.array_sort(F.collect_set(F.struct(F.xxhash64("u", "v", F.lit(seed)).alias("r"), "v"))), 1, REVERSE)
    # a node with very many followers draws among them by part first
    parts = back.groupBy("u", F.pmod(F.xxhash64("v"), F.lit(16)).alias("p")).agg(drawn.alias("l"))
    back = parts.select("u", F.explode("l.v").alias("v"))
    back = back.groupBy("u").agg(drawn.alias("l")).select("u", F.explode("l.v").alias("v"))
    own = lists.select("u", F.col("u").alias("v")).distinct()
    around = lists.select("u", "v").unionByName(back).unionByName(own).distinct()
    members = around.join(vectors.select(F.col("id").alias("v"), F.col("v").alias("x")), "v")
    groups = members.groupBy("u").agg(F.collect_list(F.struct(F.col("v").alias("id"), F.col("x").alias("v"))).alias("members"))
    return _best(lists.unionByName(_compared(groups, FROM_CELL, least)))


def _sampled_links(vectors: DataFrame, least: float, n: int) -> DataFrame:
    """(u, v): true links of ``n`` nodes drawn by the hash of their id, by brute force over all."""
    sample = vectors.select("id", "label", "v").orderBy(F.xxhash64("id"), "id").limit(n).collect()
    ids = np.array([r.id for r in sample])
    labels = np.array([r.label for r in sample])
    known = [r.v for r in sample]

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_label = {}
        for label in set(labels.tolist()):
            pick = np.flatnonzero(labels == label)
            by_label[label] = (ids[pick], _unit([known[i] for i in pick]))
        for batch in batches:
            for i in range(0, len(batch), 2048):
                for label, part in batch.iloc[i : i + 2048].groupby("label"):
                    if label in by_label:
                        own, y = by_label[label]
                        a, b = np.nonzero(_cosines(_unit(part["v"].tolist()), y) >= least)
                        out = pd.DataFrame({"u": own[b], "v": part["id"].to_numpy()[a]})
                        yield out[out["u"] != out["v"]]

    return vectors.select("id", "label", "v").mapInPandas(links, "u long, v long")


def _audit(vectors: DataFrame, least: float) -> DataFrame:
    """True links of a sample that is enlarged until it holds ``AUDIT_LINKS``, or is the largest.

    Where even the largest has few, the trees alone vouch for the recall of the rest.
    """
    n = AUDIT
    while True:
        true = table(_sampled_links(vectors, least, n), "audit")
        if n >= MOST_AUDITED or true.count() >= AUDIT_LINKS:
            return true
        n *= 4


def _recall(true: DataFrame, lists: DataFrame, enlarged: DataFrame, least: float) -> float:
    """The share of the true links that a list holds, or that lie within one enlarged component."""
    hit = lists.where(F.col("s") >= least).select("u", "v", F.lit(1).alias("hit"))
    own, other = (enlarged.select(F.col("id").alias(c), F.col("component_id").alias(f"part_{c}")) for c in "uv")
    found = F.col("hit").isNotNull() | (F.col("part_u") == F.col("part_v"))
    joined = true.join(hit, ["u", "v"], "left").join(own, "u", "left").join(other, "v", "left")
    row = joined.agg(F.count("*").alias("n"), F.count_if(found).alias("h")).first()
    return 1.0 if not row.n else row.h / row.n


def _whole_components(members: DataFrame, least: float) -> DataFrame:
    """(id, n): weight of the links of every member of (component_id, id, v, w), block by block."""
    sizes = members.groupBy("component_id").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    rows = members.join(sizes, "component_id")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    packed = rows.groupBy("component_id", "blocks", "block").agg(F.collect_list(F.struct("id", "v", "w")).alias("m"))
    packed = table(packed, "blocks")
    left = packed.select("component_id", "block", F.col("m").alias("x"), F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("other"))
    right = packed.select("component_id", F.col("block").alias("other"), F.col("m").alias("y"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b, x, y in zip(batch["block"], batch["other"], batch["x"], batch["y"]):
                i, j = ([m["id"] for m in z] for z in (x, y))
                p, q = (np.array([m["w"] for m in z], np.int64) for z in (x, y))
                near = _cosines(_unit([m["v"] for m in x]), _unit([m["v"] for m in y])) >= least
                if a == b:
                    np.fill_diagonal(near, False)
                    yield pd.DataFrame({"id": i, "n": near @ q})
                else:
                    yield pd.DataFrame({"id": i + j, "n": np.concatenate([near @ q, p @ near])})

    pairs = left.join(right, ["component_id", "other"])
    return pairs.mapInPandas(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _between(saturated: DataFrame, least: float) -> DataFrame:
    """(a, b): a link of every two blocks of different components that have one.

    ``saturated`` has (component_id, id, label, v).
    """
    sizes = saturated.groupBy("component_id").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    rows = saturated.join(sizes, "component_id").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    key = F.xxhash64("component_id", "block").alias("key")
    packed = rows.groupBy("label", "component_id", "block").agg(F.collect_list(F.struct("id", "v")).alias("m"))
    packed = table(packed.select(key, "label", "component_id", "m"), "saturated-blocks")

    def centre(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            centres, radii = [], []
            for members in batch["m"]:
                x = _unit([m["v"] for m in members])
                c = x.mean(0)
                c = c / norm if (norm := np.sqrt(np.square(c).sum())) > 1e-9 else x[0]
                centres.append(b"d" + c.tobytes())
                radii.append(float(np.arccos(np.clip(x @ c, -1, 1)).max()))
            yield batch[["key", "label", "component_id"]].assign(c=centres, r=radii)

    balls = packed.mapInPandas(centre, "key long, label long, component_id long, c binary, r double")
    groups = balls.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).alias("groups"))
    balls = table(balls, "balls").join(table(groups, "ball-groups"), "label").withColumn("g", F.pmod(F.xxhash64("key"), F.col("groups")))
    ball = F.collect_list(F.struct("key", "component_id", "c", "r"))
    balls = table(balls.groupBy("label", "groups", "g").agg(ball.alias("m")), "ball-blocks")
    left = balls.select("label", "g", F.col("m").alias("x"), F.explode(F.sequence(F.col("g"), F.col("groups") - 1)).alias("other"))
    right = balls.select("label", F.col("g").alias("other"), F.col("m").alias("y"))

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for g, other, x, y in zip(batch["g"], batch["other"], batch["x"], batch["y"]):
                (i, p, r), (k, q, t) = ((np.array([b["key"] for b in z]), np.array([b["component_id"] for b in z]), np.array([b["r"] for b in z])) for z in (x, y))
                angle = np.arccos(np.clip(_cosines(_unit([b["c"] for b in x]), _unit([b["c"] for b in y])), -1, 1))
                near = (p[:, None] != q) & (angle <= r[:, None] + t + np.arccos(min(1.0, least)) + 1e-6)
                if g == other:
                    near = np.triu(near, 1)
                u, v = np.nonzero(near)
                yield pd.DataFrame({"key": i[u], "with": k[v]})

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for x, y in zip(batch["x"], batch["y"]):
                c = _cosines(_unit([m["v"] for m in x]), _unit([m["v"] for m in y]))
                u, v = np.unravel_index(c.argmax(), c.shape)
                if c[u, v] >= least:
                    found.append(sorted((x[u]["id"], y[v]["id"])))
            yield pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    pairs = left.join(right, ["label", "other"]).mapInPandas(close, "key long, with long")
    both = pairs.join(packed.select("key", F.col("m").alias("x")), "key").join(packed.select(F.col("key").alias("with"), F.col("m").alias("y")), "with")
    return both.select("x", "y").mapInPandas(link, "a long, b long")


def _joined(lists: DataFrame, vectors: DataFrame, least: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links (a, b) of the lists, components of all, and the members of those to enlarge."""
    links = lists.where(F.col("s") >= least)
    saturated = links.groupBy("u").agg(F.count("*").alias("k")).where(F.col("k") >= NEIGHBOURS).select(F.col("u").alias("id"))
    saturated = table(saturated, "saturated")
    links = table(links.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct(), "vector-links")
    parts = table(components(links), "vector-components")
    full = parts.join(saturated, "id", "left_semi").join(vectors, "id")
    between = table(_between(full, least), "component-links")
    if not between.isEmpty():
        parts = table(components(links.unionByName(between)), "vector-components")
    dense = parts.join(saturated, "id", "left_semi").select("component_id").distinct()
    return links, parts, table(parts.join(dense, "component_id", "left_semi"), "enlarged")


def near_duplicate_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = THRESHOLD) -> DataFrame:
    """(id, n_links, component_id, kept) of every row."""
    everything = rows.select(F.col(id_col).cast("long").alias("id"))
    every = table(_vectors(rows, id_col, vector_col, label_col), "vectors")
    nodes = every.groupBy("key").agg(F.min("id").alias("node"), F.count("*").alias("w"), F.first("label").alias("label"), F.first("v").alias("v"))
    nodes = table(nodes, "nodes")
    vectors = nodes.select(F.col("node").alias("id"), "label", "v", "w")
    true, lists, round_ = _audit(vectors, least), None, 0
    while True:
        found = _start(vectors, least, round_)
        lists = table(_best(found if lists is None else lists.unionByName(found)), "neighbours")
        lists = table(_refined(lists, vectors, least, round_), "neighbours")
        links, parts, enlarged = _joined(lists, vectors, least)
        if _recall(true, lists, enlarged, least) >= AUDIT_RECALL:
            break
        round_ += 1
    weight = vectors.select("id", "w")
    whole = _whole_components(enlarged.join(vectors.select("id", "v", "w"), "id"), least)
    ends = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    listed = ends.join(weight.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("m"))
    of_node = weight.join(parts, "id", "left").join(whole, "id", "left").join(listed, "id", "left")
    of_node = of_node.select(F.col("id").alias("node"), F.coalesce("component_id", "id").alias("component_id"), (F.coalesce("n", "m", F.lit(0)) + F.col("w") - 1).alias("n"))
    known = every.select("id", "key").join(nodes.select("key", "node"), "key").join(of_node, "node").select("id", "component_id", "n")
    out = everything.join(known, "id", "left")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "id") == F.col("id"), F.lit(True)).alias("kept"),
    )


def op4_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of every vector of ``embeddings``."""
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
