"""The message workload as a stream: each micro-batch is one unit of links, ads, outcomes and mark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from adloom.plans.crawl import ingest_messages
from adloom.sources.tables import staged, updates_after
from adloom.streaming import target as store
from adloom.streaming.updates import check_summary, high_water_mark, message_outcome, told_once, wanted_messages

LINKS = "update_id long, pos int, url string, adapter string"
ADS = "update_id long, pos int, source_url string, title string, company string, salary string, description string"
RESULTS = "update_id long, url string, ok boolean, inserted boolean"
OUTCOMES = "update_id long, outcome string, reply string"
COMMITS = "messages_checked long, links_found long, links_scraped long, errors long, last_update_id long"


def message_unit(updates: DataFrame, number: int, chat_id: int, fetch: Callable[[DataFrame], DataFrame], target: str) -> None:
    """What batch `number` of updates comes to, in the tables below target: rows (ads), links, results, outcomes, commits.

    Updates at or below the mark of the batches before are replays and count for nothing. `fetch` gets the distinct links
    (url) and gives their pages (requested_url, final_url, body); it is called once. The commit is written last and holds
    summary and mark; a batch without one is done again, from the same mark, and replaces what it left.
    """
    spark = updates.sparkSession
    done = store.committed(spark, target, number)
    mark = spark.read.schema(COMMITS).parquet(f"{target}/commits/batch={done[-1]}").first()["last_update_id"] if done else None
    above = updates if mark is None else updates_after(updates, mark)
    seen = staged(told_once(above))
    store.fold(spark, target, ADS, number)
    out = ingest_messages(seen, chat_id, lambda links: staged(fetch(links)), lambda rows: store.stored(rows, target, number))
    results, wanted = staged(out["results"]), wanted_messages(seen, chat_id)
    ads = out["new"].select(*[f.split()[0] for f in ADS.split(", ")])
    store.add(ads, target, number)
    store.put(out["links"], target, "links", number)
    store.put(results, target, "results", number)
    store.put(message_outcome(wanted, results), target, "outcomes", number)
    store.commit(check_summary(wanted, results).crossJoin(F.broadcast(high_water_mark(seen, mark or 0))), target, number)


def message_stream(updates: DataFrame, chat_id: int, fetch: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """The stream of units; started again after a stop it goes on with the batch that was not committed."""
    def run(batch: DataFrame, number: int) -> None:
        message_unit(batch, number, chat_id, fetch, target)

    return updates.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
