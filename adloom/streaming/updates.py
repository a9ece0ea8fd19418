"""Job links in chat messages, as batches and as a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from adloom.functions.text import extract_urls
from adloom.functions.urls import route
from adloom.operators.ingest import new_ads
from adloom.sources.tables import staged
from adloom.streaming import target as store

#: Replies to a message.
REPLIES = {"success": "Processed ✅", "failure": "Couldn't process ⚠️"}


def wanted_messages(updates: DataFrame, chat_id: int) -> DataFrame:
    """Updates with a message of that chat."""
    return updates.where(F.col("message").isNotNull() & (F.col("message.chat.id") == chat_id))


def message_links(updates: DataFrame, text: Column | None = None) -> DataFrame:
    """(update_id, pos, url, adapter): the distinct links of each message in order."""
    text = F.col("message.text") if text is None else text
    out = updates.select("update_id", F.posexplode(extract_urls(text)).alias("pos", "url"))
    return out.withColumn("adapter", route(F.col("url")))


def links_by_id(links: DataFrame) -> DataFrame:
    """message_links where several messages may stand under one update id: a link counts once an id, and places are those of the id's links, by where each first stands in a message."""
    first = links.groupBy("update_id", "url").agg(F.min("pos").alias("_at"), F.first("adapter").alias("adapter"))
    place = F.row_number().over(W.partitionBy("update_id").orderBy("_at", "url")) - 1
    return first.select("update_id", place.alias("pos"), "url", "adapter")


def stream_links(updates: DataFrame, chat_id: int) -> DataFrame:
    """The same on a stream: no state; the query's checkpoint hands each update on once."""
    return message_links(wanted_messages(updates, chat_id))


def message_key() -> Column:
    """What tells messages of updates apart: one that is told again has id, chat and number of the first; one id alone may stand for several."""
    return F.struct("update_id", F.col("message.chat.id").alias("chat"), F.col("message.message_id").alias("number"))


def told_once(updates: DataFrame) -> DataFrame:
    """Updates without those that are told again."""
    return updates.withColumn("_key", message_key()).dropDuplicates(["_key"]).drop("_key")


def message_outcome(messages: DataFrame, results: DataFrame) -> DataFrame:
    """(update_id, outcome, reply): success if a link went well, failure if links all failed, none without links. results is (update_id, url, ok)."""
    by = results.groupBy("update_id").agg(F.bool_or("ok").alias("_ok"))
    outcome = F.when(F.col("_ok"), "success").when(~F.col("_ok"), "failure").otherwise("none")
    out = messages.select("update_id").distinct().join(by, "update_id", "left").select("update_id", outcome.alias("outcome"))
    return out.withColumn("reply", F.create_map(*[F.lit(x) for r in REPLIES.items() for x in r])[F.col("outcome")])


def check_summary(messages: DataFrame, results: DataFrame) -> DataFrame:
    """One row: messages_checked, links_found (distinct in each message), links_scraped (inserted), errors. results is (update_id, url, ok, inserted)."""
    a = messages.agg(F.countDistinct(message_key()).alias("messages_checked"))
    b = results.agg(F.count("*").alias("links_found"), F.count_if(F.col("ok") & F.col("inserted")).alias("links_scraped"), F.count_if(~F.col("ok")).alias("errors"))
    return a.crossJoin(b)


def high_water_mark(updates: DataFrame, last: int = 0) -> DataFrame:
    """One row: the greatest update id of all updates, ignored ones too; never below the last mark."""
    return updates.agg(F.greatest(F.coalesce(F.max("update_id"), F.lit(last)), F.lit(last)).cast("long").alias("last_update_id"))


def guard_replays(updates: DataFrame, lanes: int = 16) -> DataFrame:
    """A stream of updates without those that are told again: state holds the greatest id seen so far, one number a lane.

    Updates are dealt to lanes by their id, so that one chat is no single task; a repeated id comes to its own lane and is not
    above the mark there. Ids grow as they are given out: a new one below its lane's mark would be taken for a replay. With
    one lane the mark is that of the whole stream. An update without an id is handed on.
    """
    fields = updates.schema
    rows = updates.select("update_id", F.to_json(F.struct("*")).alias("body"), F.pmod(F.xxhash64("update_id"), F.lit(lanes)).alias("lane"))

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark, seen, top = (state.get[0] if state.exists else None), set(), None
        for pdf in parts:
            keep = []
            for number in pdf["update_id"]:
                known = pd.notna(number) and ((mark is not None and number <= mark) or number in seen)
                keep.append(not known)
                if pd.notna(number):
                    seen.add(number)
                    top = number if top is None else max(top, number)
            yield pdf.loc[keep, ["body"]]
        if top is not None:
            state.update((int(top if mark is None else max(top, mark)),))

    fresh = rows.groupBy("lane").applyInPandasWithState(run, "body string", "mark long", "append", GroupStateTimeout.NoTimeout)
    return fresh.select(F.from_json("body", fields).alias("u")).select("u.*")


def drop_repeats(links: DataFrame, within: str = "2 days", key: str = "url", time: str | None = None) -> DataFrame:
    """A stream of links without those seen before in that time. State holds the links of the time only; a repeat after it passes, and meets insert-if-new.

    The time is that of the micro-batch, by which nothing is ever late and lost; `time` names a column to go by instead, by
    which what is older than the latest by more than `within` is dropped.
    """
    seen = links.withColumn("_seen", F.current_timestamp() if time is None else F.col(time))
    return seen.withWatermark("_seen", within).dropDuplicatesWithinWatermark([key]).drop("_seen")


def stream_ingest(ads: DataFrame, target: str, checkpoint: str, order: tuple[str, ...] = ("pos",), after: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Insert-if-new from a stream of ads into the table at target (streaming.target).

    Each micro-batch keeps the first row of every source_url, drops those in the target, and adds the rest; one that is run
    again replaces what it wrote. The target holds the state; nothing grows in memory. `after` gets the new rows and the batch id.
    """
    def run(batch: DataFrame, number: int) -> None:
        fresh = insert_batch(batch, number, target, order)
        if after is not None:
            after(fresh, number)

    return ads.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def insert_batch(batch: DataFrame, number: int, target: str, order: tuple[str, ...] = ("pos",)) -> DataFrame:
    """The rows of a micro-batch that are new to the table at target, added to it and read back."""
    store.fold(batch.sparkSession, target, store.ddl_of(batch), number)
    return store.add(new_ads(store.stored(batch, target, number), batch, order), target, number)


def check_batch(batch: DataFrame, number: int, results: DataFrame, out: str) -> None:
    """What a micro-batch of messages came to, below `out`: outcomes with their replies, and a row with the summary and the greatest update id seen. A batch that runs again replaces its rows."""
    results = staged(results)  # what the handler does is done once
    message_outcome(batch, results).write.mode("overwrite").parquet(f"{out}/outcomes/batch={number}")
    summary = check_summary(batch, results).crossJoin(F.broadcast(high_water_mark(batch)))
    summary.write.mode("overwrite").parquet(f"{out}/summary/batch={number}")


def stream_check(updates: DataFrame, chat_id: int, handle: Callable[[DataFrame, int], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """A check of a chat: `handle` gets each micro-batch's wanted messages and its number and gives (update_id, url, ok, inserted); outcomes, replies and summaries are written by check_batch."""
    def run(batch: DataFrame, number: int) -> None:
        wanted = wanted_messages(batch, chat_id)
        check_batch(wanted, number, handle(wanted, number), out)

    return updates.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
