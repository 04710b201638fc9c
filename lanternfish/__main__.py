"""Jobs from the command line: ``python -m lanternfish COMMAND --store PATH``.

``crawl`` fetches seeds over the network; ``index`` adds what is not indexed;
``reindex`` builds the index anew and renews PageRank; ``schedule`` puts due
documents back in the queue; ``stats``, ``search`` and ``evaluate`` report.
"""

from __future__ import annotations

import argparse
import time
import urllib.error
import urllib.request
from datetime import datetime, timezone
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfish.config import Settings
from lanternfish.operators import crawl, evaluate, frontier, graph, index, search, stats
from lanternfish.session import children, delete_path, get_session
from lanternfish.sources import catalog, fetch

#: Where a crawl starts that is given no seeds.
SEEDS = ["https://docs.python.org/3/", "https://www.python.org/", "https://www.djangoproject.com/"]
_TABLES = {"queue": "crawl_queue", "documents": "documents", "links": "page_links", "images": "image_documents", "news": "news_articles", "events": "crawl_events"}


def fetch_over_http(batches):
    """Answers for batches of URLs, by the standard library's client; requests of one host are kept apart."""
    last: dict[str, float] = {}
    for batch in batches:
        rows = []
        for url in batch.column(0).to_pylist():
            host = urlsplit(url).netloc
            time.sleep(max(0.0, last.get(host, 0.0) + Settings().crawl_delay - time.monotonic()))
            last[host] = time.monotonic()
            row = {"url": url, "status": None, "content_type": None, "body": None, "error": None, "attempt": 0}
            for attempt in range(fetch.RETRIES):
                row["attempt"], row["error"] = attempt, None
                try:
                    with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "lanternfish"}), timeout=10) as answer:
                        row |= {"status": answer.status, "content_type": answer.headers.get("Content-Type"), "body": answer.read(fetch.MAX_BYTES + 1).decode("utf-8", "replace")}
                    break
                except urllib.error.HTTPError as e:
                    row["status"] = e.code
                    break
                except TimeoutError:
                    row["error"] = "timeout"
                except OSError:
                    row["error"] = "connect"
            rows.append(row)
        kinds = {"url": pa.string(), "status": pa.int32(), "content_type": pa.string(), "body": pa.string(), "error": pa.string(), "attempt": pa.int32()}
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(list(kinds.items())))


def _version(spark: SparkSession, store: str) -> str | None:
    done = [n for n in children(spark, store) if n.startswith("state=")]
    return max(done, key=lambda n: int(n[6:]), default=None)


def load(spark: SparkSession, store: str) -> crawl.State:
    """The newest state under ``store``, or an empty one."""
    at = _version(spark, store)
    if at is None:
        return crawl.State.new(spark)
    return crawl.State(*(catalog.read(spark, f"{store}/{at}", t) for t in _TABLES.values()))


def save(spark: SparkSession, store: str, state: crawl.State) -> None:
    """Write a state beside the one before, then drop those older."""
    at = _version(spark, store)
    number = int(at[6:]) + 1 if at else 0
    for name, table in _TABLES.items():
        catalog.write(getattr(state, name), f"{store}/part={number}", table)
    where = spark._jvm.org.apache.hadoop.fs.Path
    system = where(store).getFileSystem(spark._jsc.hadoopConfiguration())
    # The new state counts from the moment it has its name.
    system.rename(where(f"{store}/part={number}"), where(f"{store}/state={number}"))
    for old in children(spark, store):
        if old.startswith("state=") and int(old[6:]) < number:
            delete_path(spark, f"{store}/{old}")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", index.combined_text(F.col("title"), F.col("description"), F.col("content")).alias("text"))


def index_pending(spark: SparkSession, store: str) -> int:
    """Index the documents that wait for it, as one segment; how many there were."""
    state = load(spark, store)
    waiting = state.documents.where("not is_indexed").select("doc_id")
    n = waiting.count()
    if n:
        epochs = [int(x[6:]) for x in children(spark, f"{store}/index/doc_stats") if x.startswith("epoch=")]
        index.build(_texts(state.documents.where("not is_indexed"))).append(f"{store}/index", max(epochs, default=-1) + 1)
        save(spark, store, crawl.replace(state, documents=state.documents.withColumn("is_indexed", F.lit(True))))
    return n


def reindex(spark: SparkSession, store: str, settings: Settings = Settings()) -> None:
    """Build the index anew and renew the documents' ranks."""
    state = load(spark, store)
    index.build(_texts(state.documents)).write(f"{store}/index")
    ranked = graph.with_pagerank(state.documents, state.links, settings)
    save(spark, store, crawl.replace(state, documents=ranked.withColumn("is_indexed", F.lit(True))))


def main(arguments: list[str] | None = None, spark: SparkSession | None = None, fetch_pages=fetch_over_http) -> DataFrame | int | None:
    parser = argparse.ArgumentParser(prog="lanternfish", description=__doc__)
    parser.add_argument("command", choices=["crawl", "index", "reindex", "schedule", "stats", "search", "evaluate"])
    parser.add_argument("query", nargs="?", help="a URL to crawl, or what to search for")
    parser.add_argument("--store", required=True, help="folder of the tables")
    parser.add_argument("--seed", help="file of seed URLs")
    parser.add_argument("--max-docs", type=int, default=100)
    parser.add_argument("--top-k", type=int, default=5)
    a = parser.parse_args(arguments)
    spark = spark or get_session()
    now = F.lit(datetime.now(timezone.utc).replace(tzinfo=None)).cast("timestamp")
    if a.command == "crawl":
        lines = spark.read.text(a.seed) if a.seed else spark.createDataFrame([(u,) for u in ([a.query] if a.query else SEEDS)], "value string")
        state = crawl.seeded(load(spark, a.store), lines, now)
        save(spark, a.store, crawl.crawl(state, fetch_pages, now, a.max_docs, ask_robots=True))
        return None
    if a.command == "index":
        return index_pending(spark, a.store)
    if a.command == "reindex":
        return reindex(spark, a.store)
    state = load(spark, a.store)
    if a.command == "schedule":
        queue, documents = frontier.reschedule(state.queue, state.documents, now)
        return save(spark, a.store, crawl.replace(state, queue=queue, documents=documents))
    found = index.Index.read(spark, f"{a.store}/index")
    docs = state.documents.withColumn("published_at", F.col("last_modified"))
    if a.command == "stats":
        out = stats.corpus_overview(found, state.documents, catalog.empty(spark, "search_logs"), state.queue, state.links)
    elif a.command == "search":
        out = search.search(found, docs, a.query or "")
    else:
        judged = spark.createDataFrame(evaluate.JUDGMENTS, "query string, pattern string, grade int")
        results = search.batch_top(found, {q: q for q in dict.fromkeys(j[0] for j in evaluate.JUDGMENTS)}, a.top_k)
        results = results.join(docs.select("doc_id", "url"), "doc_id").select(F.col("query_id").alias("query"), "rank", "url")
        out = evaluate.summary(results, judged, a.top_k)
    out.show(truncate=False)
    return out


if __name__ == "__main__":
    main()
