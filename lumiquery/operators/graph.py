"""Graph steps as joins: message passing and pooling over node and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def both_ways(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Every edge in both directions, once."""
    return edges.select(src, dst).unionByName(edges.select(F.col(dst).alias(src), F.col(src).alias(dst))).distinct()


def message_pass(nodes: DataFrame, edges: DataFrame, value: str, node: str = "node", graph: list[str] | None = None) -> DataFrame:
    """Sum and mean of the values at the sources of each node's incoming edges; 0 without any.

    ``graph`` names columns that keep the molecules of a batch apart.
    """
    g = graph or []
    sent = edges.join(nodes.select(*g, F.col(node).alias("src"), F.col(value).alias("_v")), [*g, "src"])
    got = sent.groupBy(*g, F.col("dst").alias(node)).agg(F.sum("_v").alias("sum_in"), F.avg("_v").alias("mean_in"))
    return nodes.join(got, [*g, node], "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("sum_in", "mean_in")})


def pool(nodes: DataFrame, value: str, graph: list[str]) -> DataFrame:
    """Mean and maximum over the nodes of each graph."""
    return nodes.groupBy(*graph).agg(F.avg(value).alias("mean_pool"), F.max(value).alias("max_pool"))


def _weighted(value: str, weights: list[list[float]], bias: list[float] | None = None) -> Column:
    """A linear layer of an array column: row k of the weights gives output k."""
    dot = lambda w: F.aggregate(F.zip_with(F.col(value), F.array(*[F.lit(float(x)) for x in w]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return F.array(*[dot(w) + F.lit(float(bias[k]) if bias else 0.0) for k, w in enumerate(weights)])


def _relu(c: Column) -> Column:
    return F.transform(c, lambda x: F.greatest(x, F.lit(0.0)))


def _gathered(nodes: DataFrame, edges: DataFrame, value: str, node: str, g: list[str], width: int, weight: Column | None = None) -> DataFrame:
    """Sums of the vectors at the sources of each node's incoming edges, component by component."""
    sent = edges.join(nodes.select(*g, F.col(node).alias("src"), F.col(value).alias("_v"), *([F.col("_degree").alias("_source_degree")] if weight is not None else [])), [*g, "src"])
    if weight is not None:
        sent = sent.join(nodes.select(*g, F.col(node).alias("dst"), "_degree"), [*g, "dst"])
    part = lambda k: F.col("_v")[k] if weight is None else F.col("_v")[k] * weight
    got = sent.groupBy(*g, F.col("dst").alias(node)).agg(F.array(*[F.sum(part(k)) for k in range(width)]).alias("_sum"), F.count(F.lit(1)).alias("_n"))
    zero = F.array(*[F.lit(0.0)] * width)
    return nodes.join(got, [*g, node], "left").withColumns({"_sum": F.coalesce("_sum", zero), "_n": F.coalesce("_n", F.lit(0))})


def gcn_layer(nodes: DataFrame, edges: DataFrame, value: str, weights: list[list[float]], bias: list[float] | None = None, node: str = "node", graph: list[str] | None = None) -> DataFrame:
    """Graph convolution: each node takes itself and its neighbours, divided by the roots of both degrees, through a linear layer and ReLU."""
    g = graph or []
    degree = edges.groupBy(*g, F.col("dst").alias(node)).agg(F.count(F.lit(1)).alias("_in"))
    n = nodes.join(degree, [*g, node], "left").withColumn("_degree", F.coalesce("_in", F.lit(0)) + 1.0).drop("_in")
    out = _gathered(n, edges, value, node, g, len(weights[0]), 1 / F.sqrt(F.col("_source_degree") * F.col("_degree")))
    out = out.withColumn("_sum", F.zip_with("_sum", value, lambda s, x: s + x / F.col("_degree")))
    return out.withColumn(value, _relu(_weighted("_sum", weights, bias))).drop("_sum", "_n", "_degree")


def gin_layer(nodes: DataFrame, edges: DataFrame, value: str, weights: list[list[float]], bias: list[float] | None = None, epsilon: float = 0.0, node: str = "node", graph: list[str] | None = None) -> DataFrame:
    """Graph isomorphism step: (1 + epsilon) times the node plus the sum of its neighbours, through a linear layer and ReLU."""
    out = _gathered(nodes, edges, value, node, graph or [], len(weights[0]))
    out = out.withColumn("_sum", F.zip_with("_sum", value, lambda s, x: s + (1 + epsilon) * x))
    return out.withColumn(value, _relu(_weighted("_sum", weights, bias))).drop("_sum", "_n")


def mpnn_layer(nodes: DataFrame, edges: DataFrame, value: str, own: list[list[float]], other: list[list[float]], bias: list[float] | None = None, node: str = "node", graph: list[str] | None = None) -> DataFrame:
    """Message passing step: the node and the mean of its neighbours, each through weights of its own, added, then ReLU."""
    out = _gathered(nodes, edges, value, node, graph or [], len(other[0]))
    out = out.withColumn("_mean", F.transform("_sum", lambda s: s / F.greatest(F.col("_n"), F.lit(1))))
    both = F.zip_with(_weighted(value, own, bias), _weighted("_mean", other), lambda a, b: a + b)
    return out.withColumn(value, _relu(both)).drop("_sum", "_n", "_mean")


def pool_vectors(nodes: DataFrame, value: str, graph: list[str], width: int) -> DataFrame:
    """Mean and maximum of each component over the nodes of a graph, one after the other."""
    v = F.col(value)
    return nodes.groupBy(*graph).agg(F.array(*[F.avg(v[k]) for k in range(width)], *[F.max(v[k]) for k in range(width)]).alias("pooled"))
