"""The continuously running loops as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lanternfish.functions.hashing import sha256
from lanternfish.functions.urls import normalized
from lanternfish.operators import index as ix
from lanternfish.session import children, scratch_path
from lanternfish.sources import html


def source(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the Parquet files under ``path``, with the schema of those there now."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path + "*" if path.endswith(".parquet") else path)


def crawl_loop(pages: DataFrame, write: Callable[[dict[str, DataFrame], int], None], checkpoint: str, interval: str = "0.5 seconds") -> StreamingQuery:
    """Parse each batch of pages and hand its documents, images, news and links to ``write``.

    Pages marked noindex give no document; repeats of a text within the batch
    give one.  Stop, restart and the checkpoint stand for pause and resume.
    """

    def process(batch: DataFrame, epoch: int) -> None:
        parsed = html.parse(batch).persist()
        body = F.coalesce(F.nullif("main_text", F.lit("")), "title")
        docs = parsed.where("not noindex").withColumn("content_hash", sha256(body))
        docs = ix.first_of(["content_hash"], [F.col("page_id")], docs)
        write({"documents": docs, "images": html.images(parsed), "news": html.news(parsed), "links": html.page_links(parsed)}, epoch)
        parsed.unpersist()

    return pages.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


def index_loop(docs: DataFrame, path: str, checkpoint: str, once: bool = True, every: int = 20, after: Callable[[], None] | None = None) -> StreamingQuery:
    """Index each batch of new or changed documents as one segment under ``path``.

    ``Index.read`` sees a changed document in its last state only.  An epoch
    that is tried again replaces what it wrote before.  ``after``, such as the
    renewal of PageRank, runs with every 20th batch.
    """

    def process(batch: DataFrame, epoch: int) -> None:
        batch = batch.dropDuplicates(["doc_id"]).persist()
        if batch.isEmpty():
            return
        ix.build(batch).append(path, epoch)
        batch.unpersist()
        if after and epoch % every == every - 1:
            after()

    writer = docs.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="3 seconds")).start()


def first_seen(urls: DataFrame, ts_col: str = "ts", horizon: str = "1 day") -> DataFrame:
    """Each normalised URL of a stream once within the watermark."""
    clean = urls.withColumn("url", normalized(F.col("url"))).withWatermark(ts_col, horizon)
    return clean.dropDuplicatesWithinWatermark(["url"])


def query_windows(log: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, query, n, latency) of tumbling windows of the query log.  Beyond the search engine's own features."""
    timed = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    grouped = timed.groupBy(F.window("ts", width), "query")
    counts = grouped.agg(F.count("*").alias("n"), F.round(F.avg("latency_ms"), 6).alias("mean_latency"))
    return counts.select(F.col("window.start").alias("window_start"), "query", "n", "mean_latency")


def sessions(log: DataFrame, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(key, start, end, n): activity without a pause longer than ``gap``."""
    timed = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    grouped = timed.groupBy(F.session_window("ts", gap).alias("w"), key)
    return grouped.agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def politeness(requests: DataFrame, delay_s: float = 1.0) -> DataFrame:
    """(domain, url, start_s) for a stream of (domain, url, at_s): starts of one domain keep ``delay_s`` apart."""
    import pandas as pd

    def place(key, batches, state):
        last = state.get[0] if state.exists else float("-inf")
        for pdf in batches:
            starts = []
            for at in pdf.sort_values(["at_s", "url"])["at_s"]:
                last = max(at, last + delay_s)
                starts.append(last)
            out = pdf.sort_values(["at_s", "url"])
            yield pd.DataFrame({"domain": key[0], "url": out["url"].to_numpy(), "start_s": starts})
        state.update((last,))

    return requests.groupBy("domain").applyInPandasWithState(place, "domain string, url string, start_s double", "last double", "append", "NoTimeout")


def drained(df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there now and return its result table, kept in the shared folder.

    In complete mode each batch writes the whole result; else each adds its rows.
    """
    spark = df.sparkSession
    path, checkpoint = scratch_path(spark, name), scratch_path(spark, f"{name}-state")

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/epoch={epoch}")

    query = df.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if not children(spark, path):
        return spark.createDataFrame([], df.schema)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)
