import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidyspark.streaming import members

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCHEMA = "path string, content string, ts timestamp"


class Feed:
    """A stream of files written one after the other, read from a checkpoint each time as after a restart."""

    def __init__(self, spark, place, **how):
        self.spark, self.place, self.how = spark, place, how
        (place / "in").mkdir(parents=True)

    def add(self, rows):
        df = self.spark.createDataFrame(rows, "path string, content string, s long").withColumn("ts", F.timestamp_seconds(F.col("s"))).drop("s")
        df.coalesce(1).write.mode("append").parquet(str(self.place / "in"))
        stream = self.spark.readStream.schema(SCHEMA).parquet(str(self.place / "in"))
        log = members.member_changes(stream, "path", "content", "ts", **self.how)
        query = log.writeStream.format("parquet").option("path", str(self.place / "log")).option("checkpointLocation", str(self.place / "check")).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    def log(self):
        return self.spark.read.schema(members._CHANGES).parquet(str(self.place / "log"))

    def held(self):
        return {(r.checksum, r.path): r.is_original for r in members.current(self.log()).collect()}


@pytest.fixture
def rocks(spark):
    old = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    yield spark
    spark.conf.set(PROVIDER, old)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_originals_come_and_leave(rocks, tmp_path):
    feed, x, y = Feed(rocks, tmp_path, keep_seconds=100, grain_seconds=10, delay_seconds=0), digest("x"), digest("y")
    feed.add([("m", "x", 1000), ("p", "x", 1003), ("m", "x", 1001), (None, "x", 1001), ("n", None, 1002)])
    assert feed.held() == {(x, "m"): True, (x, "p"): False}
    feed.add([("b", "x", 1050)])  # a smaller path later on takes over, and m's role is taken back
    assert feed.held() == {(x, "b"): True, (x, "m"): False, (x, "p"): False}
    assert feed.log().filter("path = 'm' AND role = 'original' AND change = -1").count() == 1
    feed.add([("z", "x", 1090), ("p", "x", 1090), ("q", "y", 1160)])  # the original and the last one in line before it leave: p came again
    assert feed.held() == {(x, "p"): True, (x, "z"): False, (y, "q"): True}
    feed.add([("a", "x", 1040)])  # would have left already
    assert feed.held() == {(x, "p"): True, (x, "z"): False, (y, "q"): True}
    feed.add([("q", "y", 5000)])  # comes again long after it left
    assert feed.held() == {(y, "q"): True}
    # No member is counted twice, at any time.
    assert feed.log().groupBy("path", "checksum", "role").agg(F.sum("change").alias("n")).filter("n NOT IN (0, 1)").count() == 0


@pytest.mark.parametrize("shards", [1, 3])
def test_equals_what_is_left_of_all_rows(rocks, tmp_path, shards):
    """Against all rows in one list: a path stays for 60 seconds after its latest row that came ahead of the watermark."""
    r, keep, grain, latest = random.Random(shards), 60, 5, 0
    feed, leaves = Feed(rocks, tmp_path, keep_seconds=keep, grain_seconds=grain, delay_seconds=20, shards=shards), {}
    for batch in range(5):
        rows = [(f"p{r.randrange(40):02}", r.choice("xxxy"), 1000 + 30 * batch + r.randrange(-70, 30)) for _ in range(60)]
        mark = latest - 20
        for path, content, s in rows:
            end = -(-(s + keep) // grain) * grain
            if s > mark and end > mark:
                leaves[content, path] = max(leaves.get((content, path), 0), end)
        latest = max(latest, *(s for _, _, s in rows))
        leaves = {k: end for k, end in leaves.items() if end >= latest - 20}
        feed.add(rows)
        heads = {}
        for content, path in leaves:
            heads[content] = min(path, heads.get(content, path))
        # Who leaves just at the watermark is let go by it or by the next one.
        at_mark = {(digest(c), p) for (c, p), end in leaves.items() if end == latest - 20}
        got = feed.held()
        if not at_mark:
            assert got == {(digest(c), p): heads[c] == p for c, p in leaves}
        assert {(digest(c), p) for c, p in leaves} - set(got) <= at_mark and set(got) <= {(digest(c), p) for c, p in leaves}


def test_an_empty_stream_and_a_missing_provider(rocks, tmp_path):
    feed = Feed(rocks, tmp_path)
    feed.add([])
    assert feed.held() == {}
    rocks.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    with pytest.raises(ValueError):
        members.member_changes(rocks.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), "path", "content", "ts")
