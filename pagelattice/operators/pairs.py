"""Pairs of elements of a page, and what is computed from them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelattice.functions.distances import REGISTRY, combined
from pagelattice.operators.components import components_within, connected_components
from pagelattice.session import small_methods, unused

# Fixed value: the largest distance within a cluster.
EPS = 0.407
#: Elements of a page that one task pairs with all others of it.
LARGE = 2000


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select([F.col(c).alias(prefix + c) for c in df.columns])


def pairs_within(elements: DataFrame, key: str = "page_id", order: str = "idx") -> DataFrame:
    """All pairs i < j of a page: an equi-join on the page with a residual order test.

    The pairs are what is asked for, so their number is in the square of a
    page's elements, never of the table's.  Spark's estimate of derived rows
    doesn't know how long their arrays are, so none are broadcast.  If a page
    has more than LARGE elements, one side is cut into blocks of about that
    size, which are tasks of their own, and the other comes once for each.
    """
    small_methods(elements.sparkSession)
    sizes = elements.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > LARGE)
    if sizes.isEmpty():
        a, b = prefixed(elements, "a_"), prefixed(elements, "b_")
        return a.join(b.hint("merge"), (F.col(f"a_{key}") == F.col(f"b_{key}")) & (F.col(f"a_{order}") < F.col(f"b_{order}")))
    size, block = unused("n", elements.columns), unused("block", elements.columns)
    blocks = sizes.select(key, F.ceil(F.col("n") / LARGE).cast("int").alias(size))
    placed = elements.join(F.broadcast(blocks), key, "left").withColumn(size, F.coalesce(size, F.lit(1)))
    a = prefixed(placed.withColumn(block, F.explode(F.sequence(F.lit(0), F.col(size) - 1))).drop(size), "a_")
    b = prefixed(placed.withColumn(block, F.pmod(F.xxhash64(order), F.col(size)).cast("int")).drop(size), "b_")
    met = (F.col(f"a_{key}") == F.col(f"b_{key}")) & (F.col(f"a_{block}") == F.col(f"b_{block}")) & (F.col(f"a_{order}") < F.col(f"b_{order}"))
    return a.join(b.hint("merge"), met).drop(f"a_{block}", f"b_{block}")


def measured(pairs: DataFrame, functions: dict[str, Callable[[str, str], Column]] | None = None, key: str = "page_id", order: str = "idx") -> DataFrame:
    """page, i, j and one column for each distance."""
    chosen = functions or REGISTRY
    return pairs.select(F.col(f"a_{key}").alias(key), F.col(f"a_{order}").alias("i"), F.col(f"b_{order}").alias("j"), *[f("a_", "b_").alias(n) for n, f in chosen.items()])


def relevant(pairs: DataFrame, chosen: DataFrame, key: str = "page_id") -> DataFrame:
    """Pairs that the whitelist (page, i, j) holds in either direction."""
    lists = chosen.select(key, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct()
    return pairs.join(lists, [key, "i", "j"], "left_semi")


def clustered(distances: DataFrame, elements: DataFrame, names: Sequence[str], eps: float = EPS, key: str = "page_id", order: str = "idx") -> DataFrame:
    """Every element with the smallest element of its cluster; null for leftovers.

    With two samples a cluster is a connected component of the pairs within eps.
    """
    told = distances.select(key, "i", "j", combined(*[F.col(n) for n in names]).alias("dist"))
    found = components_within(told, key, "i", "j", "dist", eps).select(key, F.col("node").alias(order), F.col("component").cast(elements.schema[order].dataType).alias("cluster_key"))
    return elements.select(key, order).join(found.hint("merge"), [key, order], "left")


def ranked(clusters: DataFrame, key: str = "page_id") -> DataFrame:
    """Clusters of a page, largest first; ties by the smallest element."""
    sizes = clusters.filter("cluster_key is not null").groupBy(key, "cluster_key").agg(F.count("*").alias("size"))
    return sizes.withColumn("cluster_rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("size"), "cluster_key")))


def dbscan(edges: DataFrame, nodes: DataFrame, least: int) -> DataFrame:
    """node, cluster: density clusters over an edge list (a, b) within eps.

    A node with at least `least` neighbours, itself included, is core; clusters
    are components of core nodes; a border node joins its lowest core cluster;
    noise is null.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    core = both.groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") + 1 >= least).select(F.col("a").alias("node"))
    inner = both.join(core.select(F.col("node").alias("a")), "a", "left_semi").join(core.select(F.col("node").alias("b")), "b", "left_semi")
    own = connected_components(inner.filter("a < b").select("a", "b").union(core.select(F.col("node").alias("a"), F.col("node").alias("b"))))
    border = both.join(own.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("touch"))
    return nodes.join(own, "node", "left").join(border, "node", "left").select("node", F.coalesce("component", "touch").alias("cluster"))
