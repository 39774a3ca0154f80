"""Keyword graphs: ``edges`` are rows ``(w1, w2, weight)`` with w1 < w2, undirected."""

from __future__ import annotations

import heapq
import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shoplens.operators.mining import cooccurrence
from shoplens.session import next_round, reuse

# Task functions travel with the job: executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _both_ways(edges: DataFrame, *keep: str) -> DataFrame:
    forward = edges.select(*keep, F.col("w1").alias("node"), F.col("w2").alias("other"))
    return forward.unionByName(edges.select(*keep, F.col("w2").alias("node"), F.col("w1").alias("other")))


def degree_centrality(edges: DataFrame) -> DataFrame:
    """``(node, degree)``: neighbours / (number of nodes - 1)."""
    counts = _both_ways(edges).groupBy("node").agg(F.count("*").alias("n"))
    nodes = counts.agg(F.count("*").alias("nodes")).scalar()
    return counts.select("node", F.try_divide(F.col("n").cast("double"), nodes - 1).alias("degree"))


# -- betweenness ---------------------------------------------------------------------


MAX_EDGES = 10_000_000


class _Arcs:
    """Both directions of all edges, sorted by their first node: those of node i stand at ``start[i]:start[i + 1]``."""

    def __init__(self, edges: pd.DataFrame):
        ends = np.concatenate([edges["w1"].to_numpy(object), edges["w2"].to_numpy(object)])
        self.names, numbers = np.unique(ends, return_inverse=True)
        first, second = numbers, np.roll(numbers, len(edges))
        order = np.lexsort((second, first))
        self.to = second[order]
        self.step = np.tile(edges["step"].to_numpy(float), 2)[order]
        self.start = np.searchsorted(first[order], np.arange(len(self.names) + 1))

    def around(self, node: int) -> tuple[np.ndarray, np.ndarray]:
        here = slice(self.start[node], self.start[node + 1])
        return self.to[here], self.step[here]

    def loads(self, source: int) -> np.ndarray:
        """Share of the shortest paths from ``source`` that run through each node."""
        n = len(self.names)
        best, paths, done, settled = np.full(n, np.inf), np.zeros(n), np.zeros(n, bool), []
        best[source], paths[source] = 0, 1
        heap = [(0.0, source)]
        while heap:
            length, node = heapq.heappop(heap)
            if done[node]:
                continue
            done[node] = True
            settled.append(node)
            others, reach = self.around(node)
            reach = length + reach
            closer, equal = reach < best[others], (reach == best[others]) & ~done[others]
            paths[others[equal]] += paths[node]
            found = others[closer]
            best[found], paths[found] = reach[closer], paths[node]
            for item in zip(reach[closer].tolist(), found.tolist()):
                heapq.heappush(heap, item)
        load = np.zeros(n)
        for node in reversed(settled[1:]):
            others, step = self.around(node)
            parents = others[(best[others] + step == best[node]) & (best[others] < best[node])]
            load[parents] += paths[parents] / paths[node] * (1 + load[node])
        load[source] = 0
        return load


def betweenness(edges: DataFrame, distance: str = "weight") -> DataFrame:
    """``(node, betweenness)``: share of shortest paths between other nodes that pass a node.

    The weight, above 0, is the length of an edge (``distance="inverse"``: 1 / weight). The source
    nodes are dealt to batches. Every batch is sent all edges by the shuffle, holds them as
    sorted arrays (some 30 bytes a direction) and returns one sum per node; the driver sees
    a number of rows. Shortest paths need the graph at random, so a graph must fit a task:
    above MAX_EDGES edges it is an error.
    """
    step = F.lit(1.0) / F.col("weight") if distance == "inverse" else F.col("weight").cast("double")
    links = reuse(edges.select("w1", "w2", step.alias("step")))
    if links.count() > MAX_EDGES:
        raise ValueError(f"betweenness of more than {MAX_EDGES} edges")
    batches = edges.sparkSession.sparkContext.defaultParallelism

    def summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        given = list(frames)
        if given:
            arcs = _Arcs(pd.concat(given, ignore_index=True))
            n, batch = len(arcs.names), int(given[0]["batch"].iloc[0])
            total = sum((arcs.loads(source) for source in range(batch, n, batches)), np.zeros(n))
            scale = (n - 1) * (n - 2) if n > 2 else 1
            yield pd.DataFrame({"node": arcs.names, "betweenness": total / scale})

    sent = links.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))))
    # Partition i holds batch i and nothing else.
    shares = sent.repartitionById(batches, "batch").mapInPandas(summed, "node string, betweenness double")
    return shares.groupBy("node").agg(F.sum("betweenness").alias("betweenness"))


# -- communities ---------------------------------------------------------------------


def _merges(graphs: DataFrame) -> list[DataFrame]:
    """Merges ``(graph, a, b)`` by round: in each graph, the pair of groups with the largest modularity gain.

    The gain is kept as an integer (times 2 m^2), so ties are exact; they go to the pair
    whose smaller name, then larger name, comes first. A merged group keeps the larger
    name ``b``. A round joins one merge per graph with the links between groups and sums
    them up again; it ends where all gains are negative.
    """
    degrees = _both_ways(graphs, "graph").groupBy("graph", "node").agg(F.count("*").alias("d"))
    size = graphs.groupBy("graph").agg(F.count("*").alias("m"))
    links = next_round(
        graphs.select("graph", F.col("w1").alias("a"), F.col("w2").alias("b"))
        .join(degrees.select("graph", F.col("node").alias("a"), F.col("d").alias("da")), ["graph", "a"])
        .join(degrees.select("graph", F.col("node").alias("b"), F.col("d").alias("db")), ["graph", "b"])
        .join(size, "graph")
        .select("graph", "a", "b", "da", "db", F.lit(1).cast("long").alias("n"), "m")
    )
    rounds = []
    gain = 2 * F.col("m") * F.col("n") - F.col("da") * F.col("db")
    while True:
        order = F.struct((-gain).alias("loss"), "a", "b", "da", "db")
        best = links.groupBy("graph").agg(F.min(order).alias("x")).where("x.loss <= 0").select(
            "graph", F.col("x.a").alias("gone"), F.col("x.b").alias("kept"), (F.col("x.da") + F.col("x.db")).alias("d"))
        best = reuse(best)
        if best.isEmpty():
            return rounds
        rounds.append(best.select("graph", "gone", "kept"))

        def named(end: str) -> Column:
            return F.when(F.col(end) == F.col("gone"), F.col("kept")).otherwise(F.col(end))

        def degree(end: str) -> Column:
            return F.when(F.col(end).isin(F.col("gone"), F.col("kept")), F.col("d")).otherwise(F.col(f"d{end}"))

        moved = links.join(best, "graph", "left").select(
            "graph", named("a").alias("x"), named("b").alias("y"), degree("a").alias("dx"), degree("b").alias("dy"), "n", "m")
        turned = F.col("x") < F.col("y")
        links = next_round(
            moved.where("x <> y").select(
                "graph", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"),
                F.when(turned, F.col("dx")).otherwise(F.col("dy")).alias("da"),
                F.when(turned, F.col("dy")).otherwise(F.col("dx")).alias("db"), "n", "m",
            ).groupBy("graph", "a", "b", "da", "db", "m").agg(F.sum("n").alias("n")).select(links.columns),
            links,
        )


def communities(edges: DataFrame, by: str | None = None) -> DataFrame:
    """``(graph, node, group)``: greedy-modularity groups per graph, the largest is group 1.

    ``by`` names a column that tells graphs apart; all graphs merge at once. Ties of size
    go to the group whose smallest node comes first.
    """
    graphs = reuse(edges.withColumn("graph", F.col(by).cast("string") if by else F.lit("all")).select("graph", "w1", "w2"))
    labels = _both_ways(graphs, "graph").select("graph", "node", F.col("node").alias("label")).distinct()
    rounds = _merges(graphs)
    if rounds:
        # Every group goes up in at most one other, so the merges form trees; each step doubles the way up.
        up = next_round(labels.join(
            reduce(DataFrame.unionByName, rounds).withColumnRenamed("gone", "node"), ["graph", "node"], "left"
        ).select("graph", "node", F.coalesce("kept", "label").alias("label")))
        while True:
            further = up.select("graph", F.col("node").alias("label"), F.col("label").alias("next"))
            up = next_round(up.join(further, ["graph", "label"]).select(
                "graph", "node", F.col("next").alias("label"), (F.col("next") != F.col("label")).alias("moved")), up)
            if up.where("moved").isEmpty():
                break
        labels = up.drop("moved")
    sizes = labels.groupBy("graph", "label").agg(F.count("*").alias("n"), F.min("node").alias("first"))
    order = W.partitionBy("graph").orderBy(F.desc("n"), "first")
    numbers = sizes.select("graph", "label", F.row_number().over(order).alias("group"))
    return labels.join(numbers, ["graph", "label"]).select("graph", "node", "group")


def components(edges: DataFrame, by: str | None = None) -> DataFrame:
    """``(graph, node, component)``: connected components, named by their smallest node.

    Each round gives every node the smallest label around it and then the label of
    that label; ``next_round`` keeps the lineage short.
    """
    graphs = edges.withColumn("graph", F.col(by).cast("string") if by else F.lit("all"))
    links = reuse(_both_ways(graphs, "graph"))
    labels = links.select("graph", "node", F.col("node").alias("component")).distinct()
    updated = None
    while True:
        around = (
            links.join(labels.withColumnRenamed("node", "other"), ["graph", "other"])
            .groupBy("graph", "node")
            .agg(F.min("component").alias("near"))
        )
        lower = labels.join(around, ["graph", "node"]).select(
            "graph", "node", F.least("component", "near").alias("near"), F.col("component").alias("old")
        )
        step = labels.select("graph", F.col("node").alias("near"), F.col("component").alias("next"))
        updated = next_round(
            lower.join(step, ["graph", "near"]).select(
                "graph", "node", F.least("near", "next").alias("component"), "old"
            ),
            updated,
        )
        labels = updated.drop("old")
        if updated.where("component != old").isEmpty():
            return labels


def keyword_network(tok: DataFrame, top_n: int = 20, min_count: int = 2, k: int = 15) -> DataFrame:
    """``(rank, word, degree, betweenness, group)`` of the k best connected words."""
    edges = reuse(cooccurrence(tok, top_n, min_count))
    if edges.isEmpty():
        raise ValueError("not enough connected keywords for a network")
    groups = communities(edges).select("node", "group")
    table = degree_centrality(edges).join(betweenness(edges), "node").join(groups, "node")
    best = table.orderBy(F.desc("degree"), "node").limit(k)
    # A window over k rows.
    return best.select(
        F.row_number().over(W.orderBy(F.desc("degree"), "node")).alias("rank"),
        F.col("node").alias("word"),
        F.round("degree", 4).alias("degree"),
        F.round("betweenness", 4).alias("betweenness"),
        "group",
    )
