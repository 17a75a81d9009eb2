"""Connected components, spanning trees and clique overlap graphs.

A graph of up to ``SMALL`` rows is brought together by one shuffle and solved whole, thousands of
graphs at a time in numpy. Larger ones are solved by joins in rounds, each of which contracts what
it has joined; no task gets such a graph as a whole. Tables of a round are stored by columns in the
shared folder, which cuts the lineage. Only loop tests reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .graph import mirrored
from .grouping import with_group_stats

Checkpoint = Callable[[DataFrame], DataFrame]

#: Rows (nodes and edges) of a graph that is solved in one task, and rows solved at a time.
SMALL, AT_ONCE = 100_000, 65_536


def _default_checkpoint(df: DataFrame) -> Checkpoint:
    return lambda table: stored(df.sparkSession, table)


def _by_graph(solve: Callable[[pa.Table], pa.Table]):
    """``solve`` for whole graphs of a partition sorted by ``g``, the first column."""

    def run(batches):
        kept, rows = [], 0
        for batch in batches:
            kept.append(batch)
            rows += batch.num_rows
            if rows < AT_ONCE:
                continue
            # The last graph may go on in the next batch.
            table = pa.Table.from_batches(kept).combine_chunks()
            last = pc.index(table.column(0), table.column(0)[-1]).as_py()
            if last > 0:
                yield from solve(table.slice(0, last)).to_batches()
                table = table.slice(last)
            kept, rows = table.to_batches(), table.num_rows
        if rows:
            yield from solve(pa.Table.from_batches(kept).combine_chunks()).to_batches()

    return run


def _numbered(table: pa.Table):
    """Rows of nodes (those without ``dst``), their numbers in order of graph and node, and edges as row, number, number.

    Columns: ``g, src, dst``. Edges of nodes that are not there are left out.
    """
    g, src, dst = (table.column(i).combine_chunks() for i in range(3))
    names = pa.concat_arrays([src, dst.drop_null()]).unique()
    names = names.take(pc.sort_indices(names))
    edge = dst.is_valid().to_numpy(zero_copy_only=False)
    graph = g.dictionary_encode().indices.to_numpy().astype(np.int64) * len(names)
    start = graph + pc.index_in(src, names).to_numpy()
    nodes, edges = np.flatnonzero(~edge), np.flatnonzero(edge)
    ends = start[edges], graph[edges] + pc.index_in(dst.drop_null(), names).to_numpy()
    known, number = np.unique(start[nodes], return_inverse=True)
    u, v = (np.searchsorted(known, e) for e in ends)
    there = (u < len(known)) & (v < len(known))
    there[there] = (known[u[there]] == ends[0][there]) & (known[v[there]] == ends[1][there])
    return nodes, number, (edges[there], u[there], v[there])


def _unite(label, u, v) -> None:
    """Give the nodes that ``u`` and ``v`` link one label, the smallest."""
    while True:
        x, y = label[u], label[v]
        if (x == y).all():
            return
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label[:] = jumped


def _label_graphs(table: pa.Table) -> pa.Table:
    nodes, number, (_, u, v) = _numbered(table)
    label = np.arange(number.max() + 1 if len(number) else 0)
    _unite(label, u, v)
    row = np.zeros(len(label), np.int64)
    row[number] = nodes
    g, node = table.column(0).take(pa.array(nodes)), table.column(1).take(pa.array(nodes))
    return pa.table({"g": g, "node": node, "label": table.column(1).take(pa.array(row[label[number]]))})


def _span_graphs(table: pa.Table) -> pa.Table:
    """The edges that each component takes by rounds; better edges come first in ``table``."""
    _, number, (rows, u, v) = _numbered(table)
    label = np.arange(number.max() + 1 if len(number) else 0)
    taken = np.zeros(len(rows), bool)
    open_ = np.arange(len(rows))
    while len(open_):
        x, y = label[u[open_]], label[v[open_]]
        open_, x, y = (z[x != y] for z in (open_, x, y))
        best = np.full(len(label), len(rows))
        np.minimum.at(best, x, open_)
        np.minimum.at(best, y, open_)
        picked = np.unique(best[best < len(rows)])
        taken[picked] = True
        _unite(label, u[picked], v[picked])
    return table.take(pa.array(rows[taken]))


def _split_by_size(rows: DataFrame, save: Checkpoint) -> tuple[DataFrame, DataFrame | None]:
    """The rows of graphs that are solved whole, and those of larger ones if there are any."""
    large = save(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SMALL).select("g"))
    if not large.limit(1).count():
        return rows, None
    return rows.join(large, "g", "left_anti"), rows.join(large, "g", "left_semi")


def component_labels(edges: DataFrame, nodes: DataFrame, checkpoint: Checkpoint | None = None) -> DataFrame:
    """``g, node, label``: the smallest node of its component, for every row of ``nodes``.

    Edges of nodes that are not in ``nodes`` don't count; rows without graph or node are left out.
    """
    save = checkpoint or _default_checkpoint(nodes)
    kind = nodes.schema["node"].dataType
    known = nodes.where("g IS NOT NULL AND node IS NOT NULL").select("g", F.col("node").alias("src"), F.lit(None).cast(kind).alias("dst"))
    links = edges.where("g IS NOT NULL AND src <> dst").select("g", F.col("src").cast(kind).alias("src"), F.col("dst").cast(kind).alias("dst"))
    rows = save(known.unionByName(links))
    small, large = _split_by_size(rows, save)
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = f"g {fields['g']}, node {fields['src']}, label {fields['src']}"
    labels = small.repartition("g").sortWithinPartitions("g").mapInArrow(_by_graph(_label_graphs), schema)
    if large is not None:
        labels = labels.unionByName(_labels_in_rounds(
            large.where("dst IS NOT NULL"), large.where("dst IS NULL").select("g", F.col("src").alias("node")), save))
    return save(labels)


def _labels_in_rounds(links: DataFrame, nodes: DataFrame, save: Checkpoint) -> DataFrame:
    """Labels of large graphs: nodes hang to their smallest neighbour, links are drawn between the roots.

    A root that hangs to none is joined by another tree or joins one in the next round, so two
    rounds at least halve the roots. Minima are folded map-side: a hub is no hot spot.
    """
    labels = nodes.withColumn("label", F.col("node"))
    first = True
    while True:
        near = mirrored(links).groupBy("g", F.col("src").alias("node")).agg(F.min("dst").alias("root"))
        hung = save(near.withColumn("root", F.least("node", "root")))
        if first and hung.join(nodes, ["g", "node"], "left_anti").limit(1).count():
            for end in ("src", "dst"):
                links = links.join(nodes.withColumnRenamed("node", end), ["g", end], "left_semi")
            links, first = save(links), False
            continue
        first = False
        if not hung.limit(1).count():
            return labels
        while True:
            above = hung.select("g", F.col("node").alias("root"), F.col("root").alias("next"))
            stepped = save(hung.join(above, ["g", "root"]).select("g", "node", "root", "next"))
            hung = stepped.select("g", "node", F.col("next").alias("root"))
            if not stepped.where("root <> next").limit(1).count():
                break
        labels = save(labels.join(hung.withColumnRenamed("node", "label"), ["g", "label"], "left").select(
            "g", "node", F.coalesce("root", "label").alias("label")))
        for end in ("src", "dst"):
            links = links.join(hung.withColumnRenamed("node", end), ["g", end]).drop(end).withColumnRenamed("root", end)
        links = save(links.where("src <> dst").select("g", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())


def largest_component_share(edges: DataFrame, nodes: DataFrame, checkpoint: Checkpoint | None = None) -> DataFrame:
    """Nodes of the largest component over all nodes, per graph."""
    labels = component_labels(edges, nodes, checkpoint)
    sizes = labels.groupBy("g", "label").agg(F.count(F.lit(1)).alias("c"))
    return sizes.groupBy("g").agg((F.max("c") / F.sum("c")).alias("largest_share"))


def max_overlap_tree(edges: DataFrame, nodes: DataFrame, checkpoint: Checkpoint | None = None) -> DataFrame:
    """Spanning forest of largest total weight, both directions: ``g, src, dst, weight``.

    Rounds of picking every component's best outgoing edge (unique order: weight
    descending, then src, dst) and joining what it links; the component count at least halves.
    """
    save = checkpoint or _default_checkpoint(nodes)
    low, high = F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")
    links = edges.where("g IS NOT NULL AND src <> dst").select("g", low, high, "weight")
    kinds = {f.name: f.dataType for f in links.schema.fields}
    known = nodes.where("g IS NOT NULL AND node IS NOT NULL").select(
        "g", F.col("node").alias("src"), F.lit(None).cast(kinds["dst"]).alias("dst"), F.lit(None).cast(kinds["weight"]).alias("weight"))
    rows = save(known.unionByName(links))
    small, large = _split_by_size(rows, save)
    unique = small.repartition("g").groupBy("g", "src", "dst").agg(F.max("weight").alias("weight"))
    ordered = unique.sortWithinPartitions("g", -F.col("weight"), "src", "dst")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in unique.schema.fields)
    chosen = save(ordered.mapInArrow(_by_graph(_span_graphs), schema))
    if large is not None:
        chosen = chosen.unionByName(_tree_in_rounds(
            large.where("dst IS NOT NULL"), large.where("dst IS NULL").select("g", F.col("src").alias("node")), save))
    return mirrored(chosen).select("g", "src", "dst", "weight")


def _tree_in_rounds(links: DataFrame, nodes: DataFrame, save: Checkpoint) -> DataFrame:
    """The forest of large graphs: ``g, src, dst, weight``, one direction."""
    ends = links.groupBy("g", "src", "dst").agg(F.max("weight").alias("weight")).withColumns({"ls": F.col("src"), "ld": F.col("dst")})
    for end in ("src", "dst"):
        ends = ends.join(nodes.withColumnRenamed("node", end), ["g", end], "left_semi")
    ends = save(ends)
    chosen = links.where(F.lit(False))
    while True:
        rank = F.struct((-F.col("weight")).alias("w"), F.col("src"), F.col("dst"))
        sides = ends.select("g", F.explode(F.array("ls", "ld")).alias("label"), rank.alias("r"), F.struct("ls", "ld").alias("link"))
        best = sides.groupBy("g", "label").agg(F.min(F.struct("r", "link")).alias("b"))
        picked = save(best.select("g", "b.r.src", "b.r.dst", (-F.col("b.r.w")).alias("weight"), "b.link").distinct())
        if picked.limit(1).count() == 0:
            return chosen
        chosen = save(chosen.unionByName(picked.select("g", "src", "dst", "weight")))
        # The components that are linked now are one; links inside it are done with.
        linked = picked.select("g", F.col("link.ls").alias("src"), F.col("link.ld").alias("dst"))
        roots = component_labels(linked, best.select("g", F.col("label").alias("node")), save)
        for end in ("ls", "ld"):
            ends = ends.join(roots.select("g", F.col("node").alias(end), F.col("label").alias("to")), ["g", end]).drop(end).withColumnRenamed("to", end)
        ends = save(ends.where("ls <> ld"))


def clique_overlap_graph(members: DataFrame, atoms: DataFrame, checkpoint: Checkpoint | None = None
                         ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Clique tables of molecules from ``g, clique, atom, kind`` (0 ring, 1 bond).

    Rings sharing more than two atoms unite (kind 2, closed transitively); crowded atoms
    get a singleton clique (kind 3) linked with weight 1 or 99 to their cliques; other
    cliques sharing atoms are linked by the size of the overlap. Molecules without any
    clique make every atom its own clique. Returns cliques ``g, clique, kind``, membership
    ``g, atom, clique`` and edges ``g, src, dst, weight``.
    """
    save = checkpoint or _default_checkpoint(members)
    rows = save(members.where("g IS NOT NULL AND clique IS NOT NULL").select("g", "clique", "atom", "kind"))
    small, large = _split_by_size(rows, save)
    placed = _placed_cliques(small, save, True)
    if large is not None:
        placed = placed.unionByName(_placed_cliques(large, save, False))
    placed = save(placed)
    # A singleton's number is taken above every clique number of its molecule.
    crowded = placed.where("link IS NOT NULL").withColumn("single", F.col("top") + 1 + F.col("atom"))
    singles = crowded.select("g", "atom", "single").distinct()
    spokes = crowded.where("atom IS NOT NULL").select("g", F.col("clique").alias("src"), F.col("single").alias("dst"), F.col("link").alias("weight"))
    # Atoms in this join lie in few cliques: crowded ones were split off above.
    plain = placed.where("cs > 1 AND link IS NULL AND atom IS NOT NULL")
    ends = [plain.select("g", "atom", F.col("clique").alias(end)) for end in ("src", "dst")]
    touching = ends[0].join(ends[1], ["g", "atom"]).where("src < dst").groupBy("g", "src", "dst").agg(F.count(F.lit(1)).alias("n"))
    # Of the cliques that touch, crowded atoms count too.
    ends = [crowded.select("g", "atom", F.col("clique").alias(end)) for end in ("src", "dst")]
    more = touching.join(ends[0], ["g", "src"]).join(ends[1], ["g", "dst", "atom"], "left_semi").groupBy("g", "src", "dst").agg(F.count(F.lit(1)).alias("more"))
    overlaps = touching.join(more, ["g", "src", "dst"], "left").select(
        "g", "src", "dst", F.least(F.col("n") + F.coalesce("more", F.lit(0)), F.lit(99)).alias("weight"))
    lonely = atoms.join(placed.select("g").distinct(), "g", "left_anti")
    clique_rows = (
        placed.select("g", "clique", "kind").distinct()
        .unionByName(singles.select("g", F.col("single").alias("clique"), F.lit(3).alias("kind")))
        .unionByName(lonely.select("g", F.col("atom").alias("clique"), F.lit(3).alias("kind"))))
    membership = (
        placed.select("g", "atom", "clique")
        .unionByName(singles.select("g", "atom", F.col("single").alias("clique")))
        .unionByName(lonely.select("g", "atom", F.col("atom").alias("clique"))))
    links = overlaps.select("g", "src", "dst", F.col("weight").cast("long").alias("weight")).unionByName(
        spokes.select("g", "src", "dst", F.col("weight").cast("long").alias("weight")))
    return clique_rows, membership, links


def _placed_cliques(rows: DataFrame, save: Checkpoint, whole: bool) -> DataFrame:
    """``g, atom, clique, kind, cs, link, top`` of united cliques: how many hold the atom, its link if crowded, the molecule's last clique.

    With ``whole`` the rows of a molecule are brought together by one shuffle, which serves every step.
    """
    def together(df: DataFrame) -> DataFrame:
        return df.repartition("g") if whole else df

    def with_stats(df: DataFrame, by: list[str], **stats: Column) -> DataFrame:
        if not whole:
            return with_group_stats(df, by, **stats)
        return df.withColumns({name: stat.over(Window.partitionBy(*by)) for name, stat in stats.items()})

    rings = with_stats(together(rows), ["g", "clique"], size=F.count(F.lit(1))).where("size > 2")
    a = rings.select("g", "atom", F.col("clique").alias("src"))
    b = rings.select("g", "atom", F.col("clique").alias("dst"))
    bridged = save(a.join(b, ["g", "atom"]).where("src < dst").groupBy("g", "src", "dst").agg(F.count(F.lit(1)).alias("n")).where("n > 2"))
    # Only bridged rings can unite; their labels are few, other cliques keep their number.
    ends = bridged.select("g", F.explode(F.array("src", "dst")).alias("node")).distinct()
    labels = component_labels(bridged.select("g", "src", "dst"), ends, save)
    merged = together(labels.select("g", F.col("node").alias("clique"), "label"))
    united = together(rows).join(merged, ["g", "clique"], "left").groupBy("g", F.coalesce("label", "clique").alias("clique"), "atom").agg(
        F.max(F.when(F.col("label").isNotNull(), F.lit(2)).otherwise(F.col("kind"))).alias("kind"))
    sized = with_stats(united, ["g", "clique"], size=F.count(F.lit(1)))
    crowd = with_stats(sized, ["g", "atom"], cs=F.count(F.lit(1)), bonds=F.count_if(F.col("size") == 2), rings=F.count_if(F.col("size") > 4))
    many_bonds = (F.col("bonds") > 2) | ((F.col("bonds") == 2) & (F.col("cs") > 2))
    link = F.when(F.col("cs") <= 1, F.lit(None)).when(many_bonds, 1).when(F.col("rings") > 2, 99)
    return with_stats(crowd, ["g"], top=F.max("clique")).select("g", "atom", "clique", "kind", "cs", link.alias("link"), "top")
