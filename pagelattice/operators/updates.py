"""Clusters and columns in the shape in which they are handed on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelattice.functions.urls import url_host


def urls_of_host(rows: DataFrame, page_url: Column) -> DataFrame:
    """Rows whose URL isn't blank and holds the page's host."""
    return rows.filter((F.col("url") != "") & F.contains("url", url_host(page_url)))


def cluster_fields(rows: DataFrame, key: str = "page_id") -> DataFrame:
    """What is told of each cluster: rows are elements with their cluster_key.

    urls in the order of the elements, urls_key and text_key distinct and sorted;
    text_key is null if no element has a text.
    """
    told = lambda c: F.when(F.col(c) != "", F.col(c))
    ordered = F.array_sort(F.collect_list(F.struct("idx", "url")))
    texts = F.array_sort(F.collect_set(told("text")))
    return rows.groupBy(key, "cluster_key").agg(
        F.count("*").alias("length"), F.avg(F.col("area").cast("double")).alias("avg_area"), F.bool_or("driver_is_displayed").alias("any_displayed"), F.bool_and("driver_is_displayed").alias("visible"), F.bool_and("all_visible").alias("all_visible"),
        F.transform(ordered, lambda e: e["idx"]).alias("node_ids"), F.filter(F.transform(ordered, lambda e: e["url"]), lambda u: u != "").alias("urls"), F.array_sort(F.collect_set(told("url"))).alias("urls_key"),
        F.when(F.size(texts) > 0, texts).alias("text_key"),
    )


def sorted_members(rows: DataFrame, *by: Column, key: str = "page_id") -> DataFrame:
    """Elements with their place in their cluster, in the given order."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key, "cluster_key").orderBy(*by)))


def equivalent_clusters(fields: DataFrame, key: str = "page_id") -> DataFrame:
    """Pairs of a page's clusters with the same set of URLs."""
    a, b = fields.select(key, F.col("cluster_key").alias("one"), "urls_key"), fields.select(key, F.col("cluster_key").alias("other"), "urls_key")
    return a.join(b, [key, "urls_key"]).filter("one < other").select(key, "one", "other")


def element_updates(rows: DataFrame, key: str = "page_id") -> DataFrame:
    """One row a page: elements_by_id (text, node_id, rect, tag_name) and clusters (key to node ids); all ids are strings."""
    node = F.col("idx").cast("string")
    entry = F.struct(node.alias("key"), F.struct("text", node.alias("node_id"), F.struct("x", "y", "width", "height", "area").alias("rect"), "tag_name").alias("value"))
    elements = rows.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(entry), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))).alias("elements_by_id"))
    ids = rows.filter("cluster_key is not null").groupBy(key, F.col("cluster_key").cast("string").alias("c")).agg(F.transform(F.array_sort(F.collect_list("idx")), lambda v: v.cast("string")).alias("ids"))
    clusters = ids.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("c", "ids")))).alias("clusters"))
    return elements.join(clusters, key, "left").withColumn("clusters", F.coalesce("clusters", F.create_map().cast("map<string,array<string>>")))


def column_updates(cells: DataFrame, group: str = "g") -> DataFrame:
    """One row a selection: descs_by_id (rect on the canvas, text, node_id) and column_clusters, a column's ids by page with null where it has no element.

    cells: group, col_id, page_idx, pos (null without an element), text and rectangle.
    """
    uid = F.when(F.col("pos").isNotNull(), F.concat_ws("@", "col_id", F.col("page_idx").cast("string")))
    rows = cells.withColumn("uid", uid)
    columns = rows.groupBy(group, "col_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_idx", "uid"))), lambda c: c["uid"]).alias("ids"))
    columns = columns.groupBy(group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("col_id", "ids")))).alias("column_clusters"))
    rect = F.struct(canvas_x(F.col("x"), F.col("page_idx")).alias("x"), "y", "width", "height")
    entry = F.struct(F.col("uid").alias("key"), F.struct(rect.alias("rect"), "text", F.col("uid").alias("node_id")).alias("value"))
    descs = rows.filter("uid is not null").groupBy(group).agg(F.map_from_entries(F.collect_list(entry)).alias("descs_by_id"))
    return columns.join(descs, group, "left")


def canvas_x(x: Column, page_idx: Column, width: int = 1300) -> Column:
    """Pages stand side by side on the canvas."""
    return x + width * page_idx


def on_canvas(cells: DataFrame, scale: float = 1.0, height: int = 1400) -> DataFrame:
    """Cells placed on the canvas of all pages, scaled, without what the crop of its height leaves out."""
    scaled = lambda c: F.bround(c * F.lit(float(scale))).cast("int")
    shown = cells.filter(F.col("y") < height)
    return shown.withColumns({"x": scaled(canvas_x(F.col("x"), F.col("page_idx"))), "height": scaled(F.least(F.col("height"), F.lit(height) - F.col("y"))), "y": scaled(F.col("y")), "width": scaled(F.col("width"))})


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON document a row, in any store that Spark writes to."""
    rows.write.mode("overwrite").json(path)
