"""Continuous ingestion: page requests in, clusters out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagelattice.functions.distances import url_similarity
from pagelattice.operators.pairs import clustered, pairs_within
from pagelattice.sources.fixtures import described_links, scan_links

REQUEST = "task_uid string, page_url string"


def parse_requests(raw: DataFrame, column: str = "value") -> DataFrame:
    """Messages {task_uid, page_url} as rows; what isn't JSON goes."""
    return raw.select(F.from_json(F.col(column).cast("string"), REQUEST).alias("r")).select("r.*").filter("page_url is not null")


def link_clusters(pages: DataFrame) -> DataFrame:
    """page_id, idx, cluster_key of the links of pages."""
    found = described_links(scan_links(pages))
    distances = pairs_within(found).select(F.col("a_page_id").alias("page_id"), F.col("a_idx").alias("i"), F.col("b_idx").alias("j"), url_similarity("a_", "b_", F.col("a_page_host")).alias("url_similarity"))
    return clustered(distances, found, ["url_similarity"])


def requested_pages(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """The pages that are asked for, by their URL: page_id, url, html with the task's id."""
    return requests.join(pages.withColumnRenamed("url", "page_url"), "page_url").select("task_uid", "page_id", F.col("page_url").alias("url"), "html")


def run_stream(pages: DataFrame, sink: str, checkpoint: str, analyse: Callable[[DataFrame], DataFrame] = link_clusters) -> StreamingQuery:
    """Analyses each micro-batch of pages; a batch that is run again overwrites its own folder."""

    def each(batch: DataFrame, epoch: int) -> None:
        analyse(batch).write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")

    return pages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def page_stream(spark: SparkSession, path: str, schema: str = "page_id long, url string, html string") -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(path)


ACTION = "task_uid string, action string, data struct<chosenElemIds:array<string>>"


def parse_actions(raw: DataFrame, column: str = "value") -> DataFrame:
    """Selections of a user: task_uid and chosen_ids of messages {task_uid, action: elemsSelected, data: {chosenElemIds}}; others go."""
    rows = raw.select(F.from_json(F.col(column).cast("string"), ACTION).alias("a")).select("a.*")
    return rows.filter("action = 'elemsSelected' and task_uid is not null").select("task_uid", F.col("data.chosenElemIds").alias("chosen_ids"))


def selected_urls(actions: DataFrame, elements: DataFrame, most: int = 3) -> DataFrame:
    """task_uid, urls and error: the first URLs that aren't blank of the chosen elements, in the order chosen; fewer than two are an error.

    elements: task_uid, node_id, url, as they were saved with the clusters.
    """
    chosen = actions.select("task_uid", F.posexplode("chosen_ids").alias("place", "node_id"))
    found = chosen.join(elements.select("task_uid", "node_id", "url"), ["task_uid", "node_id"]).filter("url <> ''")
    urls = found.groupBy("task_uid").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("place", "url"))), lambda c: c["url"]), 1, most).alias("urls"))
    all_urls = F.coalesce("urls", F.array().cast("array<string>"))
    return actions.select("task_uid").distinct().join(urls, "task_uid", "left").select("task_uid", all_urls.alias("urls"), F.when(F.size(all_urls) < 2, "failed to fetch 2 or more HTML pages").alias("error"))


def action_stream(raw: DataFrame, elements: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch of actions against the saved elements; a batch that is run again overwrites its own folder."""

    def each(batch: DataFrame, epoch: int) -> None:
        selected_urls(parse_actions(batch), elements).write.mode("overwrite").json(f"{sink}/epoch={epoch}")

    return raw.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
