"""Streaming: the rolling buffer of what was heard, following, and latest-per-key state."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpuskit.functions import text as T
from corpuskit.operators.follow import BLOCK, FOLLOW_SCORE, GRAM, NEIGHBOURHOOD, WANTED, WINDOW_MAX, Index, _with_grams, best_window, best_windows, earliest_best, utterances, with_units
from corpuskit.operators.ordering import int_bucket
from corpuskit.session import kept, small_or_shuffled

# Fixed value: tokens remembered per session.
BUFFER = 80

HEARD_SCHEMA = "session_id string, ts timestamp, seq long, heard array<string>"


def revise(buffer: list[str], new: list[str], is_final: bool, size: int = BUFFER, strict: bool = False, finals: int = 0) -> tuple[list[str], int]:
    """The buffer after one hypothesis, and how many of its tokens are final.

    A final hypothesis is appended.  An interim one first takes away as many
    trailing tokens as it brings, which may reach into final ones; ``strict``
    keeps those.
    """
    if is_final:
        kept = buffer[:finals] if strict else buffer
        out = [*kept, *new]
        finals = len(out)
    else:
        cut = max(len(buffer) - len(new), 0)
        cut = finals if strict else cut
        out = [*buffer[:cut], *new]
        finals = min(finals, cut)
    dropped = max(len(out) - size, 0)
    return out[dropped:], max(finals - dropped, 0)


def heard_buffers(
    utterances: DataFrame,
    tokens: Callable[[Column], Column] = T.follow_tokens,
    watermark: str = "10 minutes",
    idle_minutes: int = 30,
    size: int = BUFFER,
    strict: bool = False,
) -> DataFrame:
    """``session_id, ts, seq, heard`` after every hypothesis of a stream.

    ``utterances(session_id, ts, seq, transcript, is_final)``.  Tokens are cut in
    the JVM; the handler keeps one short buffer per session, orders a session's
    rows by time and forgets a session that stays idle.
    """
    ready = (
        utterances.withWatermark("ts", watermark)
        .select("session_id", "ts", F.unix_millis("ts").alias("ms"), "seq", tokens(F.col("transcript")).alias("tokens"), "is_final")
        .filter(F.size("tokens") > 0)
    )

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        buffer, finals = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
        out = []
        for ts, seq, new, is_final in zip(rows["ts"], rows["seq"], rows["tokens"], rows["is_final"]):
            buffer, finals = revise(buffer, list(new), bool(is_final), size, strict, finals)
            out.append((key[0], ts, seq, list(buffer)))
        state.update((buffer, finals))
        expiry = int(rows["ms"].max()) + idle_minutes * 60_000  # from the JVM: pandas times carry no zone
        state.setTimeoutTimestamp(max(expiry, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["session_id", "ts", "seq", "heard"])

    return ready.groupBy("session_id").applyInPandasWithState(
        step, HEARD_SCHEMA, "buffer array<string>, finals int", "append", GroupStateTimeout.EventTimeTimeout
    )


# The sign between the tokens of a buffer on its way through Python, and the sign that stands before another's number.
BETWEEN, ESCAPE = "\x1f", "\x1b"


def _packed(tokens: Column) -> Column:
    """An array of tokens as one string, which costs Python one value instead of one per token."""
    plain = F.transform(tokens, lambda x: F.replace(F.replace(x, F.lit(ESCAPE), F.lit(f"{ESCAPE}0")), F.lit(BETWEEN), F.lit(f"{ESCAPE}1")))
    return F.array_join(plain, BETWEEN)


def _unpacked(packed: Column) -> Column:
    parts = F.split(packed, BETWEEN)
    back = F.transform(parts, lambda x: F.replace(F.replace(x, F.lit(f"{ESCAPE}1"), F.lit(BETWEEN)), F.lit(f"{ESCAPE}0"), F.lit(ESCAPE)))
    return F.when(F.contains(packed, F.lit(ESCAPE)), back).otherwise(parts)


def hear(said: DataFrame, before: DataFrame, size: int = BUFFER, strict: bool = False) -> DataFrame:
    """``session_id, ts, seq, heard, finals, newest`` after every hypothesis of one micro-batch, as :func:`revise` gives them.

    ``said(session_id, ts, seq, tokens, is_final)``; ``before(session_id, heard, finals)`` are the
    buffers that the sessions start with.  ``newest`` marks the last row of a session.  All
    sessions of a partition pass through one loop in their order, which holds one buffer at a time.
    """
    start = before.select("session_id", F.lit(False).alias("is_said"), F.lit(None).cast("long").alias("us"), F.lit(None).cast("long").alias("seq"), _packed(F.col("heard")).alias("tokens"), F.lit(True).alias("is_final"), "finals")
    rows = said.select("session_id", F.lit(True).alias("is_said"), F.unix_micros("ts").alias("us"), "seq", _packed(F.col("tokens")).alias("tokens"), "is_final", F.lit(0).alias("finals"))
    rows = rows.unionByName(start).repartition("session_id")
    rows = rows.sortWithinPartitions("session_id", "is_said", F.asc_nulls_last("us"), F.asc_nulls_last("seq"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, buffer, final_tokens, out = None, [], 0, []
        started = False
        for batch in batches:
            for key, is_said, us, seq, tokens, is_final, finals in zip(*(c.to_pylist() for c in batch.columns)):
                if not started or key != session:
                    if out:
                        out[-1][5] = True
                    started, session, buffer, final_tokens = True, key, [], 0
                if is_said:
                    buffer, final_tokens = revise(buffer, tokens.split(BETWEEN), bool(is_final), size, strict, final_tokens)
                    out.append([key, us, seq, BETWEEN.join(buffer), final_tokens, False])
                else:
                    buffer, final_tokens = tokens.split(BETWEEN), finals
            if len(out) > 1:  # the last row waits until it is known whether its session goes on
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[:-1]), WALKED)], names=WALKED_NAMES)
                out = out[-1:]
        if out:
            out[-1][5] = True
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), WALKED)], names=WALKED_NAMES)

    walked = rows.mapInArrow(walk, "session_id string, us long, seq long, heard string, finals int, newest boolean")
    return walked.select("session_id", F.timestamp_micros("us").alias("ts"), "seq", _unpacked(F.col("heard")).alias("heard"), "finals", "newest")


WALKED = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.bool_())
WALKED_NAMES = ["session_id", "us", "seq", "heard", "finals", "newest"]
ROWS_SCHEMA = f"{HEARD_SCHEMA}, finals int, newest boolean"
BUFFERS_SCHEMA = "session_id string, ts timestamp, heard array<string>, finals int"


def heard_writer(
    utterances: DataFrame,
    root: str,
    tokens: Callable[[Column], Column] = T.follow_tokens,
    idle_minutes: int = 30,
    size: int = BUFFER,
    strict: bool = False,
    then: Callable[[DataFrame, int], None] | None = None,
):
    """A stream writer of the buffers of :func:`heard_buffers`, for many sessions per micro-batch.

    Every micro-batch writes what was heard and the buffers of the sessions into folders
    ``epoch=N`` of ``root``; it starts from the buffers that the epoch before it left, so a
    repeated micro-batch gives the same rows.  There is no watermark: rows that come late are
    taken after those of the micro-batches before.  A session without rows is forgotten
    ``idle_minutes`` before the newest row of a micro-batch.  ``then`` gets the rows written.
    """
    ready = utterances.select("session_id", "ts", "seq", tokens(F.col("transcript")).alias("tokens"), "is_final").filter(F.size("tokens") > 0)

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        before = spark.createDataFrame([], BUFFERS_SCHEMA) if epoch == 0 else spark.read.schema(BUFFERS_SCHEMA).parquet(f"{root}/buffers/epoch={epoch - 1}")
        hear(batch, before, size, strict).write.mode("overwrite").parquet(f"{root}/heard/epoch={epoch}")
        rows = spark.read.schema(ROWS_SCHEMA).parquet(f"{root}/heard/epoch={epoch}")
        ended = rows.filter("newest").select("session_id", "ts", "heard", "finals")
        idle = before.join(ended.select(F.col("session_id").alias("other")), F.col("session_id").eqNullSafe(F.col("other")), "left_anti")
        newest = rows.agg(F.max(F.unix_micros("ts"))).first()[0]
        if newest is not None:
            idle = idle.filter(F.unix_micros("ts") >= newest - idle_minutes * 60_000_000)
        idle.unionByName(ended).write.mode("overwrite").parquet(f"{root}/buffers/epoch={epoch}")
        if then:
            then(rows.select("session_id", "ts", "seq", "heard"), epoch)

    return ready.writeStream.outputMode("append").foreachBatch(write)


def heard_of(spark: SparkSession, root: str) -> DataFrame:
    """The rows that :func:`heard_writer` wrote."""
    return spark.read.schema(HEARD_SCHEMA).parquet(f"{root}/heard").drop("epoch")


def follow_batch(
    heard: DataFrame, sessions: DataFrame, grams: DataFrame, corpus: DataFrame, min_score: float = 0.25, neighbourhood: int = 80
) -> DataFrame:
    """Match the buffers of one micro-batch; ``sessions`` gives each session its text and position hint."""
    asked = heard.join(sessions, "session_id").select(
        F.struct("session_id", "seq").alias("utt_id"), "text_slug", F.col("heard").alias("tokens"), "hint"
    )
    found = with_units(best_window(asked, grams, min_score, neighbourhood), corpus)
    return found.select("utt_id.session_id", "utt_id.seq", "text_slug", "unit_id", "start", "end", "score")


def follow_stream(utterances: DataFrame, sessions: DataFrame, grams: DataFrame, corpus: DataFrame, sink: Callable[[DataFrame, int], None], **options):
    """A stream writer that hands the matches of every micro-batch to ``sink(matches, epoch)``."""
    heard = heard_buffers(utterances, **options)
    return heard.writeStream.outputMode("append").foreachBatch(
        lambda batch, epoch: sink(follow_batch(batch, sessions, grams, corpus), epoch)
    )


def moving_matches(asked: DataFrame, hints: DataFrame, index: Index, min_score: float = FOLLOW_SCORE, neighbourhood: int = NEIGHBOURHOOD) -> DataFrame:
    """``session_id, ts, seq, text_slug, start, end, score, is_local``, every match being the hint of the session's next one.

    ``asked(session_id, ts, seq, text_slug, tokens)`` and the last known positions
    ``hints(session_id, hint)``.  The best windows of all utterances are found together,
    whatever the hints.  A session is then walked in order, with the pieces of its text around
    these windows and its hint; one whose matches lead out of them waits there and goes on in
    another round, with the text around the place it came to, twice as far as the round before.
    """
    dealt = asked.repartition(asked.sparkSession.sparkContext.defaultParallelism, "session_id")
    questions = kept(utterances(dealt.withColumn("utt_id", F.struct("session_id", "ts", "seq"))))
    best = best_windows(questions, index, min_score)
    rows = best.join(questions.select("utt_id", "text_slug", "total", "own"), ["utt_id", "text_slug"])
    rows = kept(rows.select("utt_id.*", "text_slug", "win", "total", "own", "start", "score").withColumn("us", F.unix_micros("ts")))
    texts = rows.groupBy("session_id").agg(F.min("text_slug").alias("text_slug"))
    lengths = index.blocks.groupBy("text_slug").agg(F.max("text_len").alias("text_len"))
    here = kept(texts.join(hints, "session_id").select("session_id", "text_slug", "hint"))
    waiting, margin, done = rows, MARGIN, []
    while True:
        near = waiting.select("session_id", "text_slug", F.col("start").alias("at"), F.lit(MARGIN).alias("margin"))
        near = near.unionByName(here.select("session_id", "text_slug", F.col("hint").alias("at"), F.lit(margin).alias("margin")))
        low, high = F.greatest(F.col("at") - neighbourhood - F.col("margin"), F.lit(0)), F.col("at") + neighbourhood + WINDOW_MAX + F.col("margin")
        near = kept(near.select("session_id", "text_slug", F.explode(F.sequence(int_bucket(low, BLOCK), int_bucket(high, BLOCK))).alias("block")).distinct())
        walked = kept(_walk(waiting.join(here.select("session_id", "hint"), "session_id", "left").join(lengths, "text_slug"), near, index, min_score, neighbourhood))
        done.append(walked.filter("NOT waits"))
        here = walked.filter("waits").select("session_id", "text_slug", "us", "seq", F.col("start").alias("hint"))
        if here.isEmpty():
            break
        later = F.struct("us", "seq") >= F.struct("from_us", "from_seq")
        waiting = waiting.join(here.select("session_id", F.col("us").alias("from_us"), F.col("seq").alias("from_seq")), "session_id").filter(later).drop("from_us", "from_seq")
        margin *= 2
    found = reduce(DataFrame.unionByName, done)
    return found.select("session_id", F.timestamp_micros("us").alias("ts"), "seq", "text_slug", "start", "end", "score", "is_local")


# Fixed value: tokens around the neighbourhood of a place that a walk has at hand at first.
MARGIN = 192


def _walk(rows: DataFrame, near: DataFrame, index: Index, min_score: float, neighbourhood: int) -> DataFrame:
    """The match of every row, sessions walked in order over the blocks ``near``; a row that needs other blocks ``waits`` and ends its session.

    A waiting row has the hint as ``start``.  All sessions of a partition pass through one loop,
    which holds the blocks of one session at a time.
    """
    met = _with_grams(small_or_shuffled(near, WANTED).join(index.blocks, ["text_slug", "block"])).select(*near.columns, _packed(F.slice("grams", 1, BLOCK)).alias("grams"))
    blocks = met.unionByName(near.withColumn("grams", F.lit(None).cast("string")))  # the text may have none of that number
    none = lambda kind: F.lit(None).cast(kind)
    pieces = blocks.select(
        "session_id", F.lit(False).alias("is_row"), none("long").alias("us"), none("long").alias("seq"), "text_slug", "block", "grams",
        none("array<int>").alias("times"), none("int").alias("win"), none("int").alias("total"), none("long").alias("start"), none("double").alias("score"), none("long").alias("hint"), none("long").alias("text_len"),
    )
    said = rows.select(
        "session_id", F.lit(True).alias("is_row"), "us", "seq", "text_slug", none("long").alias("block"), _packed(F.col("own.gram")).alias("grams"),
        F.col("own.times").alias("times"), "win", "total", "start", "score", "hint", "text_len",
    )
    both = pieces.unionByName(said).repartition("session_id").sortWithinPartitions("session_id", "is_row", "us", "seq")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, started, held, hint, waits = None, False, {}, None, False
        for batch in batches:
            out = []
            for key, is_row, us, seq, text, block, grams, times, win, total, start, score, first_hint, text_len in zip(*(c.to_pylist() for c in batch.columns)):
                if not started or key != session:
                    session, started, held, hint, waits, walking = key, True, {}, None, False, False
                if not is_row:
                    if grams is None:
                        held.setdefault((text, block), [])
                    else:
                        held[text, block] = grams.split(BETWEEN)
                    continue
                if waits:
                    continue
                if not walking:
                    hint, walking = first_hint, True
                local = None
                if hint is not None:
                    low, high = max(math.ceil(hint - neighbourhood / 2), 0), min(hint + neighbourhood + 1 - win, text_len - win)
                    needed = range(low // BLOCK, (high + win - GRAM) // BLOCK + 1) if low <= high else ()
                    if any((text, b) not in held for b in needed):
                        waits = True
                        out.append((key, us, seq, text, hint, None, None, None, True))
                        continue
                    if needed:
                        number, span = {g: i for i, g in enumerate(grams.split(BETWEEN))}, win - GRAM + 1
                        places = [(at, number[g]) for b in needed for at, g in enumerate(held[text, b], b * BLOCK) if g in number and low <= at < high + span]
                        local = earliest_best(places, times, span, low)
                if local is not None and 2 * local[0] / total >= min_score:
                    hint, score, is_local = local[1], 2 * local[0] / total, True
                else:
                    hint, is_local = start, False
                out.append((key, us, seq, text, hint, hint + win, score, is_local, False))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), STEPS)], names=STEP_NAMES)

    return both.mapInArrow(walk, STEP_SCHEMA)


STEP_SCHEMA = "session_id string, us long, seq long, text_slug string, start long, end long, score double, is_local boolean, waits boolean"
STEP_NAMES = [c.split(" ")[0] for c in STEP_SCHEMA.split(", ")]
STEPS = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.bool_())


MATCH_SCHEMA = "session_id string, ts timestamp, seq long, text_slug string, start long, end long, score double, is_local boolean"


def match_stream(spoken: DataFrame, sessions: DataFrame, index: Index, root: str, min_score: float = FOLLOW_SCORE, neighbourhood: int = NEIGHBOURHOOD, **options):
    """A stream writer that follows every session through its text with a moving hint.

    The buffers are those of :func:`heard_writer`.  Every micro-batch writes what was heard, the
    matches and the last position of every session so far into folders ``epoch=N`` of ``root``;
    it starts from the positions that the epoch before it left, so a repeated micro-batch gives
    the same rows.  ``spoken`` as in :func:`heard_buffers`, ``sessions(session_id, text_slug)``; ``index`` should be a stored one, it is read by every
    micro-batch.
    """

    def follow(heard: DataFrame, epoch: int) -> None:
        spark = heard.sparkSession
        before = spark.createDataFrame([], HINT_SCHEMA) if epoch == 0 else spark.read.schema(HINT_SCHEMA).parquet(f"{root}/hints/epoch={epoch - 1}")
        asked = heard.join(sessions, "session_id").select("session_id", "ts", "seq", "text_slug", F.col("heard").alias("tokens"))
        moving_matches(asked, before, index, min_score, neighbourhood).write.mode("overwrite").parquet(f"{root}/matches/epoch={epoch}")
        last = spark.read.schema(MATCH_SCHEMA).parquet(f"{root}/matches/epoch={epoch}").groupBy("session_id").agg(F.max_by("start", F.struct("ts", "seq")).alias("hint"))
        after = before.join(last, "session_id", "left_anti").unionByName(last)
        after.write.mode("overwrite").parquet(f"{root}/hints/epoch={epoch}")

    return heard_writer(spoken, root, then=follow, **options)


HINT_SCHEMA = "session_id string, hint long"


def matches_of(spark: SparkSession, root: str, corpus: DataFrame | None = None) -> DataFrame:
    """The matches that :func:`match_stream` wrote; ``corpus`` adds the unit in which a match starts."""
    rows = spark.read.schema(MATCH_SCHEMA).parquet(f"{root}/matches")
    return rows if corpus is None else with_units(rows, corpus)


def latest_stream(events: DataFrame, keys: list[str], order: list[str], path: str):
    """A stream writer that keeps the newest row per key in the Parquet folder ``path``.

    Every micro-batch adds the newest row of the keys it brought, so the stream itself holds
    no state; :func:`latest_rows` reads the folder.
    """
    rest = [c for c in events.columns if c not in keys]

    def newest(batch: DataFrame) -> DataFrame:
        return batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("s")).select(*keys, "s.*")

    return into_folder(events, path, newest)


def latest_rows(spark: SparkSession, path: str, keys: list[str], order: list[str], schema, deleted: str | None = None) -> DataFrame:
    """The newest row per key of a folder written by :func:`latest_stream`.

    ``deleted`` names a boolean column: a newest row with it set stands for a removed key.
    """
    rows = spark.read.schema(schema).parquet(path).drop("epoch")
    rest = [c for c in rows.columns if c not in keys]
    rows = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("s")).select(*keys, "s.*")
    return rows if deleted is None else rows.filter(~F.coalesce(F.col(deleted), F.lit(False)))


def into_folder(stream: DataFrame, path: str, change: Callable[[DataFrame], DataFrame] | None = None):
    """A stream writer into ``path``: one folder per micro-batch, written anew if the batch is repeated."""

    def write(batch: DataFrame, epoch: int) -> None:
        (change(batch) if change else batch).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return stream.writeStream.outputMode("append").foreachBatch(write)


def run_available(writer, checkpoint: str) -> None:
    """Run a bounded stream to its end."""
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def debounce_stream(events: DataFrame, keys: list[str], ts: str, order: str, gap_ms: int = 800, watermark: str = "10 minutes") -> DataFrame:
    """``keys, ms, order`` of the events that stayed the last one of their key for ``gap_ms``; ``ms`` counts from the epoch.

    An event is given out when a later one comes after the gap, or when the watermark passes
    its gap; of equal times the larger ``order`` counts as later.  The state is one event per
    key that still waits.
    """
    ready = events.withWatermark(ts, watermark).select(*keys, ts, F.unix_millis(ts).alias("ms"), F.col(order).cast("long").alias(order))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting = tuple(state.get) if state.exists else None
        closed = []
        if state.hasTimedOut:
            closed.append(waiting)
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values(["ms", order])
            for event in zip(rows["ms"].tolist(), rows[order].tolist()):
                if waiting and event[0] - waiting[0] >= gap_ms:
                    closed.append(waiting)
                waiting = max(waiting or event, event)
            state.update(waiting)
            state.setTimeoutTimestamp(max(waiting[0] + gap_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(*key, *event) for event in closed], columns=[*keys, "ms", order])

    return ready.groupBy(*keys).applyInPandasWithState(
        step, ready.drop(ts).schema, "ms long, place long", "append", GroupStateTimeout.EventTimeTimeout
    )
