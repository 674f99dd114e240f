"""What the engine reports of streams, and what is left after a restart."""

import numpy as np
from pyspark.sql import functions as F

from lodeframe.plans import streams
from lodeframe.streaming.runner import PROVIDER, Feed, state_counts, to_table
from lodeframe.streaming.windows import tumbling_counts, with_event_time

SF = "/root/testdata/sf0.001"


def test_repeats_are_dropped_by_their_state_alone(spark):
    feed, progress = streams.repeated(spark, SF), []
    assert sum(p.count() for p in feed.parts) > 1000
    kept = streams.deduplicated(feed, progress)
    assert kept.count() == kept.distinct().count() == 1000
    assert state_counts(progress, "numRowsDroppedByWatermark") == 0
    assert state_counts(progress, "numDroppedDuplicateRows") == sum(p.count() for p in feed.parts) - 1000


def test_each_part_has_several_files_and_a_run_of_its_own(spark):
    feed, progress = streams._in_five(spark, SF), []
    events = with_event_time(feed.stream())
    windows = to_table(tumbling_counts(events.withWatermark("ts", "1 hour"), "1 hour"), "append", feed, progress=progress)
    assert len({p["runId"] for p in progress}) == 5 and len({p["id"] for p in progress}) == 1
    assert spark.read.parquet(feed.path).select(F.input_file_name()).distinct().count() == 20
    # a window is given once, whatever was restarted meanwhile
    assert windows.count() == windows.select("start").distinct().count()


def test_a_resumed_stream_gives_what_one_run_gives(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    part = lambda k: events.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == k)

    def counted(parts):
        feed = Feed(parts, "resumed")
        changes = to_table(tumbling_counts(with_event_time(feed.stream()), "1 day"), "update", feed)
        return sorted(tuple(r) for r in changes.groupBy("start").agg(F.max("n")).collect())

    assert counted([part(0), part(1), part(2)]) == counted([events])


def test_the_state_store_setting_is_put_back(spark):
    before = spark.conf.get(PROVIDER, None)
    assert streams.stream_typed_state(spark, SF).count() == 5
    assert spark.conf.get(PROVIDER, None) == before


def test_merged_sessions_of_many_keys():
    from lodeframe.streaming.stateful import merged_sessions

    held = np.array([[2, 5, 5, 1], [1, 0, 9, 1], [1, 1, 1, 1], [2, 20, 20, 1], [1, 11, 12, 2], [2, 15, 15, 1], [1, 23, 23, 1]]).T
    assert merged_sessions(held, 10).T.tolist() == [[1, 0, 12, 4], [1, 23, 23, 1], [2, 5, 20, 3]]
    assert merged_sessions(held[:, :0], 10).shape == (4, 0)
