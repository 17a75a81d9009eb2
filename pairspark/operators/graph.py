"""Graph tables: construction, degree statistics, aggregation and pooling.

Edges are ``g, src, dst[, weight]`` and nodes ``g, node[, ...]``; ``g`` is the graph key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chemistry import bond_code
from ..functions.text import hash_uniform
from ..functions.vectors import dot
from .grouping import with_group_stats

EPS = 1e-15


# --- construction ----------------------------------------------------------------------


def coalesce_edges(edges: DataFrame, reduce: str = "max") -> DataFrame:
    """One row per (g, src, dst)."""
    fold = {"max": F.max, "min": F.min, "sum": F.sum, "mean": F.avg}[reduce]
    return edges.groupBy("g", "src", "dst").agg(fold("weight").alias("weight"))


def mirrored(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, in one pass over the input."""
    extra = [c for c in edges.columns if c not in ("g", "src", "dst")]
    both = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return edges.select("g", F.inline(both), *extra)


def to_undirected(edges: DataFrame, reduce: str = "max") -> DataFrame:
    return coalesce_edges(mirrored(edges), reduce)


def remove_self_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst")


def add_self_loops(edges: DataFrame, nodes: DataFrame, fill: float = 1.0) -> DataFrame:
    loops = nodes.select("g", F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(fill).alias("weight"))
    return edges.select("g", "src", "dst", "weight").unionByName(loops)


def self_loop_weights(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Loop weight per node, zero where there is none."""
    loops = edges.where("src = dst").select("g", F.col("src").alias("node"), "weight")
    return nodes.join(loops, ["g", "node"], "left").select("g", "node", F.coalesce("weight", F.lit(0.0)).alias("weight"))


def sequence_edges(lengths: DataFrame, weight: float, reach: int = 2) -> DataFrame:
    """Edges (i, i+1) .. (i, i+reach) of chains given as ``g, n``; each direction is one row."""
    steps = lengths.where("n > 1").select("g", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 2)).alias("src"))
    near = steps.select("g", "n", "src", F.explode(F.sequence(F.lit(1), F.lit(reach))).alias("d"))
    forward = near.where("src + d < n").select("g", "src", (F.col("src") + F.col("d")).alias("dst"), F.lit(weight).alias("weight"))
    return mirrored(forward).select("g", "src", "dst", "weight")


def contact_graph(contacts: DataFrame, lengths: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Residue graph from contact probabilities ``g, i, j, prob`` and chain lengths ``g, n``.

    Contacts at or above the threshold and the chain neighbours at distance 1 and 2, the
    larger weight on duplicates, symmetric, with unit self loops. The two max-folds of
    the definition commute, so one shuffle does both.
    """
    close = contacts.where((F.col("prob") >= threshold) & (F.col("i") != F.col("j"))).select(
        "g", F.col("i").alias("src"), F.col("j").alias("dst"), F.col("prob").cast("double").alias("weight"))
    edges = coalesce_edges(mirrored(close).unionByName(sequence_edges(lengths, threshold)), "max")
    nodes = lengths.where("n > 0").select("g", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("node"))
    return add_self_loops(edges, nodes, 1.0)


def adjacency_to_edges(dense: DataFrame, rows: str = "rows") -> DataFrame:
    """Non-zero cells of a dense matrix column (array of arrays) as ``g, src, dst, weight``."""
    lines = dense.select("g", F.posexplode(rows).alias("src", "line"))
    cells = lines.select("g", "src", F.posexplode("line").alias("dst", "weight"))
    return cells.where("weight <> 0").select("g", "src", "dst", F.col("weight").cast("double").alias("weight"))


def bond_edges(bonds: DataFrame, sizes: DataFrame | None = None, legacy_shift: bool = False) -> DataFrame:
    """Both directions of bonds ``g, begin, end, kind`` with their codes.

    ``legacy_shift`` moves every atom id cyclically down by one (sizes ``g, n`` needed),
    as files written by older versions have it.
    """
    coded = bonds.select("g", F.col("begin").alias("src"), F.col("end").alias("dst"), bond_code(F.col("kind")).alias("code"))
    if legacy_shift:
        coded = coded.join(sizes, "g").select(
            "g", F.expr("pmod(src - 1, n)").alias("src"), F.expr("pmod(dst - 1, n)").alias("dst"), "code")
    return mirrored(coded)


# --- degrees and neighbour aggregation -------------------------------------------------


def in_degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``g, node, degree`` including nodes without edges."""
    counted = edges.groupBy("g", F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("d"))
    return nodes.join(counted, ["g", "node"], "left").select("g", "node", F.coalesce("d", F.lit(0)).alias("degree"))


def degree_histogram(degrees: DataFrame, times: DataFrame | None = None) -> DataFrame:
    """``degree, cnt`` for 0..max without gaps. ``times`` (``g, times``) counts a graph repeatedly."""
    weight = F.lit(1)
    if times is not None:
        degrees, weight = degrees.join(times, "g"), F.col("times")
    counted = degrees.groupBy("degree").agg(F.sum(weight).alias("cnt"))
    most = degrees.agg(F.max("degree")).first()[0]
    axis = degrees.sparkSession.range(0 if most is None else most + 1).withColumnRenamed("id", "degree")
    return axis.join(counted, "degree", "left").select("degree", F.coalesce("cnt", F.lit(0)).alias("cnt"))


def average_degree(histogram: DataFrame) -> DataFrame:
    """Mean of d, ln(d+1) and e^d over the nodes."""
    d, c = F.col("degree").cast("double"), F.col("cnt")
    n = F.sum(c)
    return histogram.agg(
        (F.sum(d * c) / n).alias("lin"), (F.sum(F.log(d + 1) * c) / n).alias("log"), (F.sum(F.exp(d) * c) / n).alias("exp"))


AGGREGATORS = {
    "mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_pop, "var": F.var_pop, "sum": F.sum,
}


def neighbor_aggregate(messages: DataFrame, averages: DataFrame, aggregators: Sequence[str], scalers: Sequence[str],
                       by: Sequence[str] = ("g", "dst"), value: str = "value") -> DataFrame:
    """Neighbour statistics per target node under degree scalers, columns ``{scaler}_{aggregator}``."""
    grouped = messages.groupBy(*by).agg(
        F.count(F.lit(1)).alias("degree"), *[AGGREGATORS[a](value).alias(a) for a in aggregators])
    lin, log, exp = (F.lit(v) for v in averages.select("lin", "log", "exp").first())
    d = F.greatest(F.col("degree"), F.lit(1)).cast("double")
    factors = {
        "identity": F.lit(1.0),
        "amplification": F.log(d + 1) / log,
        "attenuation": log / F.log(d + 1),
        "linear": d / lin,
        "inverse_linear": lin / d,
        "exponential": F.exp(d) / exp,
    }
    unknown = [s for s in scalers if s not in factors]
    if unknown:
        raise ValueError(f"unknown scaler: {unknown[0]}")
    return grouped.select(
        *by, "degree", *[(F.col(a) * factors[s]).alias(f"{s}_{a}") for s in scalers for a in aggregators])


def scatter_mean(members: DataFrame, values: DataFrame, targets: DataFrame, member: str, target: str,
                 value: str = "value") -> DataFrame:
    """Mean member value per target; targets without members get 0.

    ``members``: ``g, member, target``; swap the two names for the other direction.
    """
    joined = members.join(values, ["g", member]).groupBy("g", target).agg(F.avg(value).alias("m"))
    return targets.join(joined, ["g", target], "left").select("g", target, F.coalesce("m", F.lit(0.0)).alias(value))


def segment_softmax(df: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """Max-shifted softmax inside each group."""
    shifted = with_group_stats(df, by, __top=F.max(value))
    shifted = shifted.withColumn("__e", F.exp(F.col(value) - F.col("__top"))).drop("__top")
    total = with_group_stats(shifted, by, __sum=F.sum("__e"))
    return total.withColumn(out, F.col("__e") / F.col("__sum")).drop("__e", "__sum")


def pool_vectors(df: DataFrame, by: Sequence[str], vector: str, width: int, weight: Column | None = None,
                 mean: bool = False, out: str = "pooled") -> DataFrame:
    """Weighted sum (or mean) of vectors per group; one aggregate per component, map-side combined.

    Null vectors add nothing; a vector of another length than ``width`` ends the query.
    """
    w = F.lit(1.0) if weight is None else weight.cast("double")
    fold = F.avg if mean else F.sum
    fits = F.col(vector).isNull() | (F.size(vector) == width)
    wrong = F.raise_error(F.concat(F.lit(f"vector length is not {width}: "), F.size(vector).cast("string"))).cast("double")
    parts = [fold(F.when(fits, F.get(vector, F.lit(i)).cast("double")).otherwise(wrong) * w).alias(f"__{i}") for i in range(width)]
    return df.groupBy(*by).agg(*parts).select(*by, F.array(*[F.col(f"__{i}") for i in range(width)]).alias(out))


def group_norm(long: DataFrame, by: Sequence[str], value: str, out: str, eps: float = 1e-5) -> DataFrame:
    """(x - mean) / sqrt(var + eps) per group over all nodes (list the component in ``by``)."""
    spread = with_group_stats(long, by, __m=F.avg(value), __v=F.var_pop(value))
    return spread.withColumn(out, (F.col(value) - F.col("__m")) / F.sqrt(F.col("__v") + F.lit(eps))).drop("__m", "__v")


def group_attention(queries: DataFrame, keys: DataFrame, by: Sequence[str], width: int,
                    temperature: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Attention inside a group: ``by, query`` against ``by, key, value``.

    Returns the rows with their ``attention`` weight and the weighted sum of values.
    """
    scored = keys.join(queries, list(by)).withColumn(
        "score", dot(F.col("query"), F.col("key")) / F.lit(width ** 0.5 * temperature))
    weighted = segment_softmax(scored, by, "score", "attention")
    return weighted, pool_vectors(weighted, by, "value", width, F.col("attention"))


def propagate(edges: DataFrame, start: DataFrame, hops: int, alpha: float = 0.0, checkpoint=None) -> DataFrame:
    """Spread ``node, value`` over symmetric normalised edges ``src, dst`` with self loops.

    ``alpha`` mixes the start value back in at every hop. ``checkpoint`` is applied to the
    table after each hop to cut its lineage.
    """
    looped = edges.select("src", "dst").unionByName(start.select(F.col("node").alias("src"), F.col("node").alias("dst")))
    degree = looped.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("d"))
    scaled = (
        looped.join(degree.select(F.col("node").alias("src"), F.col("d").alias("ds")), "src")
        .join(degree.select(F.col("node").alias("dst"), F.col("d").alias("dd")), "dst")
        .select("src", "dst", (F.lit(1.0) / F.sqrt(F.col("ds").cast("double") * F.col("dd"))).alias("w"))
    )
    # Every node has a self loop, so no node is lost in the joins.
    current = start.select("node", "value")
    for _ in range(hops):
        moved = scaled.join(current, scaled["src"] == current["node"]).groupBy("dst").agg(F.sum(F.col("w") * F.col("value")).alias("v"))
        if alpha:
            first = start.select(F.col("node").alias("dst"), F.col("value").alias("v0"))
            moved = moved.join(first, "dst").select("dst", ((1 - alpha) * F.col("v") + alpha * F.col("v0")).alias("v"))
        current = moved.select(F.col("dst").alias("node"), F.col("v").alias("value"))
        if checkpoint is not None:
            current = checkpoint(current)
    return current


def isolated_share(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Share of nodes per graph without an edge to another node."""
    touched = edges.where("src <> dst").select("g", F.explode(F.array("src", "dst")).alias("node")).distinct()
    marked = nodes.join(touched.withColumn("t", F.lit(1)), ["g", "node"], "left")
    return marked.groupBy("g").agg((F.count_if(F.col("t").isNull()) / F.count(F.lit(1))).alias("isolated_share"))


def connect_graphs(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """All node pairs of two graphs sharing a key: the bipartite edges between them."""
    return left.join(right, key)


# --- soft cluster pooling --------------------------------------------------------------

# Scores and assignments are rows ``g, node, k, s`` or, listed, one row per node ``g, node, v`` with an
# array of ``k, s``. With ``placed`` the tables lie by ``g``, as after ``repartition("g")``: clusters are then
# brought to the edges by windows, which leave all rows where they are, where joins would move them by node.


def _listed(assigned: DataFrame) -> DataFrame:
    """One row per node: its clusters and their numbers as an array ``v``."""
    return assigned if "v" in assigned.columns else assigned.groupBy("g", "node").agg(F.collect_list(F.struct("k", "s")).alias("v"))


def _rows(assigned: DataFrame) -> DataFrame:
    return assigned.select("g", "node", F.inline("v")) if "v" in assigned.columns else assigned


def _with(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of ``value``, which is made once even where ``then`` uses it for every element of a list."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def soft_assignments(scores: DataFrame) -> DataFrame:
    """Softmax over clusters of ``g, node, k, s``; a node's few clusters are brought together once.

    Listed scores give listed assignments.
    """
    powers = _with(F.array_max("v.s"), lambda top: F.transform(
        "v", lambda x: F.struct(x["k"].alias("k"), F.exp(x["s"] - top).alias("e"))))
    total = lambda p: F.aggregate(p["e"], F.lit(0.0), lambda t, e: t + F.coalesce(e, F.lit(0.0)))
    shares = _with(powers, lambda p: _with(total(p), lambda t: F.transform(
        p, lambda x: F.struct(x["k"].alias("k"), (x["e"] / t).alias("s")))))
    # Above an explode, here of one element, the lists are not made anew for each use or in filters of the input.
    assigned = _listed(scores).select("g", "node", F.explode(F.array(shares)).alias("v"))
    return assigned if "v" in scores.columns else _rows(assigned)


def cluster_features(assigned: DataFrame, features: DataFrame) -> DataFrame:
    """X' = S^T X as ``g, k, f, value`` from features ``g, node, f, x``."""
    return _rows(assigned).join(features, ["g", "node"]).groupBy("g", "k", "f").agg(F.sum(F.col("s") * F.col("x")).alias("value"))


def _linked(assigned: DataFrame, edges: DataFrame, how: str = "inner", placed: bool = False) -> DataFrame:
    """``g, weight, a, b``: every edge once, with the listed clusters of its two ends.

    ``how`` left keeps edges with an end that has no clusters.
    """
    listed, edges = _listed(assigned), edges.select("g", "src", "dst", "weight")
    if not placed:
        one = edges.join(listed.select("g", F.col("node").alias("src"), F.col("v").alias("a")), ["g", "src"], how)
        return one.join(listed.select("g", F.col("node").alias("dst"), F.col("v").alias("b")), ["g", "dst"], how).select("g", "weight", "a", "b")
    # Nodes stand beside the edges that leave them, then beside those that reach them.
    known = listed.where("g IS NOT NULL AND node IS NOT NULL").select("g", F.col("node").alias("src"), F.col("node").alias("dst"), F.col("v").alias("a"), F.lit(False).alias("edge"))
    both = known.unionByName(edges.withColumn("edge", F.lit(True)), allowMissingColumns=True)
    own = F.when(~F.col("edge"), F.col("a"))
    found = lambda end: F.first(own, ignorenulls=True).over(Window.partitionBy("g", end))
    left = both.withColumn("a", found("src")).select("g", "dst", "weight", "edge", "a")
    linked = left.withColumn("b", found("dst")).where("edge").select("g", "weight", "a", "b")
    return linked.where("a IS NOT NULL AND b IS NOT NULL") if how == "inner" else linked


def cluster_adjacency(assigned: DataFrame, edges: DataFrame, placed: bool = False) -> DataFrame:
    """S^T A S as ``g, k1, k2, a``; an edge moves once, its cluster pairs are folded before they move."""
    rows = _linked(assigned, edges, placed=placed).select("g", "weight", "b", F.explode("a").alias("x")).select("g", "weight", "x", F.explode("b").alias("y"))
    return rows.groupBy("g", F.col("x.k").alias("k1"), F.col("y.k").alias("k2")).agg(F.sum(F.col("x.s") * F.col("weight") * F.col("y.s")).alias("a"))


def _shared() -> Column:
    """Whether the ends of a linked edge share a cluster."""
    return F.exists("a", lambda x: F.exists("b", lambda y: y["k"] == x["k"]))


def _products(x: str, y: str) -> Column:
    """The numbers of the list ``x`` that are of the same clusters as those of ``y``, multiplied and added."""
    return F.aggregate(x, F.lit(0.0), lambda t, p: t + F.aggregate(
        F.filter(y, lambda q: q["k"] == p["k"]), F.lit(0.0), lambda u, q: u + F.coalesce(p["s"] * q["s"], F.lit(0.0))))


def cluster_trace(assigned: DataFrame, edges: DataFrame, placed: bool = False) -> DataFrame:
    """tr(S^T A S) as ``g, num``: a number per edge, without the cells off the diagonal."""
    return _linked(assigned, edges, placed=placed).where(_shared()).groupBy("g").agg(F.sum(F.col("weight") * _products("a", "b")).alias("num"))


def edge_sums(assigned: DataFrame, edges: DataFrame, placed: bool = False) -> DataFrame:
    """What losses take from the edges, all in one pass, as ``g, num, den, m, cc``.

    tr(S^T A S), tr(S^T D S) with the weights from a node as D, the weight sum, and the squared weights
    into the clusters, added. Graphs without an edge inside a cluster have no row.
    """
    cells = _linked(assigned, edges, "left", placed).select("g", "weight", "a", F.posexplode_outer("b").alias("i", "y"))
    cells = cells.withColumn("same", F.filter("a", lambda x: x["k"] == F.col("y.k")))
    some, known = F.size("same") > 0, F.exists("a", lambda x: x["s"].isNotNull())
    product = F.aggregate("same", F.lit(0.0), lambda t, x: t + F.coalesce(x["s"] * F.col("y.s"), F.lit(0.0)))
    squares = F.aggregate("a", F.lit(0.0), lambda t, x: t + F.coalesce(x["s"] * x["s"], F.lit(0.0)))
    # What an edge has once goes with the first of its cells.
    once = F.coalesce("i", F.lit(0)) == 0
    folded = cells.groupBy("g", F.col("y.k").alias("k")).agg(
        F.sum(F.when(some, F.col("weight") * product)).alias("num"), F.sum(F.when(once & known, F.col("weight") * squares)).alias("den"),
        F.sum(F.when(once, F.col("weight"))).alias("m"), F.sum(F.col("weight") * F.col("y.s")).alias("c"), F.count_if(some).alias("some"))
    sums = folded.groupBy("g").agg(*[F.sum(x).alias(x) for x in ("num", "den", "m", "some")], F.sum(F.col("c") * F.col("c")).alias("cc"))
    return sums.where("some > 0").select("g", "num", "den", "m", "cc")


def normalized_adjacency(pooled: DataFrame) -> DataFrame:
    """Zero diagonal, then a / sqrt(d_row) / sqrt(d_column) with a small floor.

    A cell meets the degrees of its row and its column by windows, so that the cells are made once
    and those of a graph stay together. A column that is no row has no degree, its cells are left out.
    """
    known = pooled.where("g IS NOT NULL AND k1 IS NOT NULL AND k2 IS NOT NULL")
    open_ = known.select("g", "k1", "k2", F.when(F.col("k1") == F.col("k2"), F.lit(0.0)).otherwise(F.col("a")).alias("a"))
    added = F.sum("a").over(Window.partitionBy("g", "k1"))
    rows = open_.select("g", "k1", "k2", "a", (F.sqrt(added) + F.lit(EPS)).alias("d1"))
    # Each cell comes once by its row, to be added there, and once by its column.
    sides = rows.select("g", "k1", "k2", "a", "d1", F.explode(F.array(F.struct(F.col("k1").alias("k"), F.lit(True).alias("own")), F.struct(F.col("k2").alias("k"), F.lit(False).alias("own")))).alias("at"))
    sides = sides.select("g", "k1", "k2", "a", "d1", "at.k", "at.own")
    degree = F.first(F.when(F.col("own"), F.struct("d1")), ignorenulls=True).over(Window.partitionBy("g", "k"))
    return sides.withColumn("d2", degree).where("NOT own AND d2 IS NOT NULL").select(
        "g", "k1", "k2", (F.col("a") / F.col("d1") / F.col("d2.d1")).alias("a"))


def cluster_gram(assigned: DataFrame) -> DataFrame:
    """S^T S as ``g, k1, k2, ss``, folded from one row per node so no row pairs are shuffled."""
    wide = _listed(assigned).select("g", F.explode("v").alias("a"), "v").select("g", "a", F.explode("v").alias("b"))
    return wide.groupBy("g", F.col("a.k").alias("k1"), F.col("b.k").alias("k2")).agg(
        F.sum(F.col("a.s") * F.col("b.s")).alias("ss"))


def mincut_loss(assigned: DataFrame, edges: DataFrame, sums: DataFrame | None = None) -> DataFrame:
    """-tr(S^T A S) / tr(S^T D S) per graph; ``sums`` are those of the edges, where they are at hand."""
    sums = edge_sums(assigned, edges) if sums is None else sums
    return sums.select("g", (-F.col("num") / F.col("den")).alias("mincut_loss"))


def gram_sums(gram: DataFrame) -> DataFrame:
    """What losses take from the cells of SS, all in one pass, as ``g, squares, trace, k, rows, roots, row_squares``.

    The squares of all cells, the diagonal and its length, the rows of clusters, the roots of the diagonal
    and the squared sums of rows, each added.
    """
    own, ss = F.col("k1") == F.col("k2"), F.col("ss")
    by_row = gram.groupBy("g", "k1").agg(
        F.sum(ss * ss).alias("squares"), F.sum(F.when(own, ss).otherwise(F.lit(0.0))).alias("trace"), F.count_if(own).alias("k"),
        F.sum(F.when(own, F.sqrt(ss + F.lit(EPS)))).alias("roots"), F.sum(ss).alias("r"))
    return by_row.groupBy("g").agg(
        *[F.sum(x).alias(x) for x in ("squares", "trace", "k", "roots")],
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("r") * F.col("r")).alias("row_squares"))


def ortho_loss(gram: DataFrame, sums: DataFrame | None = None) -> DataFrame:
    """|| SS/||SS|| - I/sqrt(k) || per graph, from the cells of SS; ``sums`` are theirs, where they are at hand."""
    sums = gram_sums(gram) if sums is None else sums
    # ||A - B||^2 with both of norm one is 2 - 2<A, B>.
    inner = F.col("trace") / F.sqrt("squares") / F.sqrt(F.col("k").cast("double"))
    return sums.select("g", F.sqrt(F.greatest(F.lit(0.0), F.lit(2.0) - F.lit(2.0) * inner)).alias("ortho_loss"))


def modularity_loss(assigned: DataFrame, edges: DataFrame, sums: DataFrame | None = None) -> DataFrame:
    """-tr(S^T A S - S^T d d^T S / 2m) / 2m per graph; m is the weight sum of the graph itself.

    ``sums`` are those of the edges, where they are at hand.
    """
    sums, m = edge_sums(assigned, edges) if sums is None else sums, F.col("m")
    return sums.select("g", (-(F.col("num") - F.col("cc") / 2 / m) / 2 / m).alias("modularity_loss"))


def cluster_size_loss(gram: DataFrame, nodes: DataFrame, sums: DataFrame | None = None) -> DataFrame:
    """||row sums of SS|| / n * sqrt(k) - 1 per graph; ``sums`` are those of SS, where they are at hand."""
    sums = gram_sums(gram) if sums is None else sums
    sizes = nodes.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    return sums.join(sizes, "g").select(
        "g", (F.sqrt("row_squares") / F.col("n") * F.sqrt(F.col("rows").cast("double")) - 1).alias("cluster_size_loss"))


def balance_loss(gram: DataFrame, nodes: DataFrame, sums: DataFrame | None = None) -> DataFrame:
    """-tr(sqrt(SS + eps)) / sqrt(n k) per graph, element-wise root; ``sums`` are those of SS, where they are at hand."""
    sums = (gram_sums(gram) if sums is None else sums).where("k > 0")
    sizes = nodes.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    return sums.join(sizes, "g").select(
        "g", (-F.col("roots") / F.sqrt((F.col("n") * F.col("k")).cast("double"))).alias("balance_loss"))


# --- random thinning -------------------------------------------------------------------


def _check_probability(p: float) -> None:
    if not 0.0 <= p <= 1.0:
        raise ValueError(f"drop probability outside [0, 1]: {p}")


def drop_edges(edges: DataFrame, p: float, seed: int = 0, undirected: bool = False) -> DataFrame:
    """Keep an edge when its hashed uniform is at least p.

    ``undirected`` decides on src <= dst and mirrors the kept ones; a kept loop stays one row.
    """
    _check_probability(p)
    if p == 0.0:
        return edges
    key = F.concat_ws(":", F.col("g").cast("string"), F.col("src").cast("string"), F.col("dst").cast("string"))
    kept = edges.where(hash_uniform(key, seed) >= p)
    if not undirected:
        return kept
    half = kept.where("src <= dst")
    extra = [c for c in edges.columns if c not in ("g", "src", "dst")]
    flipped = F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))
    both = F.when(F.col("src") == F.col("dst"), F.array(F.struct("src", "dst"))).otherwise(
        F.array(F.struct("src", "dst"), flipped))
    return half.select("g", F.inline(both), *extra)


def drop_nodes(nodes: DataFrame, edges: DataFrame, p: float, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Keep nodes with hashed uniform above p, at least one per graph, and the edges among them."""
    _check_probability(p)
    if p == 0.0:
        return nodes, edges
    key = F.concat_ws(":", F.col("g").cast("string"), F.col("node").cast("string"))
    drawn = nodes.withColumn("__u", hash_uniform(key, seed))
    # A graph where nothing passes keeps its largest draw.
    rescue = drawn.groupBy("g").agg(F.max(F.struct("__u", "node")).alias("best"))
    rescue = rescue.where(F.col("best.__u") <= p).select("g", F.col("best.node").alias("node"))
    kept = drawn.where(F.col("__u") > p).select("g", "node").unionByName(rescue)
    ends = edges.join(kept.withColumnRenamed("node", "src"), ["g", "src"], "left_semi")
    return kept, ends.join(kept.withColumnRenamed("node", "dst"), ["g", "dst"], "left_semi")
