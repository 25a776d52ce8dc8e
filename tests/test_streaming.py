from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from tallyspark.operators.timeline import token_events
from tallyspark.sources.event_feed import event_lines
from tallyspark.streaming.parse_state import Waiting, configure_streaming, parse_stream

SF = "/root/testdata/sf0.001"
FIELDS = [
    "home", "path", "line_no", "model", "tier_kind", "tier_text", "is_duplicate", "is_stale", "overflow",
    "delta_total", "delta_uncached", "delta_cached", "delta_output",
]


def rows(df):
    df = df.select(*[F.col(c).cast("bigint") if c.startswith("delta") else F.col(c).cast("string").alias(c) for c in FIELDS])
    return sorted(tuple(str(x) for x in r) for r in df.collect())


def test_stream_equals_batch_with_segments_out_of_order(spark):
    configure_streaming(spark)
    # Streams number lines densely per file; three files are enough here.
    base = event_lines(spark, SF).where("user_id < 4")
    ranked = base.withColumn("line_no", F.expr("row_number() over (partition by home, path order by line_no) - 1").cast("bigint"))
    folder = tempfile.mkdtemp(prefix="tally-stream-")
    ranked.cache()
    # Later segments first, and one segment delivered twice.
    for number, rule in enumerate(("line_no >= 30", "line_no between 8 and 29", "line_no < 8", "line_no between 5 and 12")):
        ranked.where(rule).coalesce(1).write.parquet(f"{folder}/in/{number}")
    stream = spark.readStream.schema(ranked.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    query = (
        parse_stream(stream).writeStream.format("parquet").option("checkpointLocation", f"{folder}/cp")
        .outputMode("append").trigger(availableNow=True).start(f"{folder}/out")
    )
    query.awaitTermination()
    got = spark.read.parquet(f"{folder}/out")
    assert rows(got) == rows(token_events(ranked))


class CountedMap(dict):
    """A state map that counts what is asked of it."""

    calls = 0

    def getValue(self, key):
        self.calls += 1
        return self.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self[key] = value

    def removeKey(self, key):
        self.calls += 1
        del self[key]


def test_waiting_lines_share_calls_to_state():
    """Lines of one chunk come and go together; what was set aside early is found again."""
    stored, lines = CountedMap(), [(n, None, "m" if n % 2 else None, n % 3 == 0) for n in range(600)]
    early = Waiting(stored, True)
    for line in lines[1::2]:
        early.add(line)
    early.set_aside(0)
    assert len(stored) == 3 and stored.calls == 3
    early, taken = Waiting(stored, False), []
    for line in lines[300::2]:
        early.add(line)
    early.set_aside(0)  # as a batch of many lines does between its frames
    for line in lines[0:300:2]:
        early.add(line)
    while (line := early.take(len(taken))) is not None:
        taken.append(line)
    early.set_aside(len(taken))
    assert taken == lines and not stored
    assert stored.calls < 20
