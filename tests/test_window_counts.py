"""Windowed counts over a stream of files: all rows in time count, rows behind the watermark don't."""

import collections
import datetime

from quire.streaming import upserts

START = datetime.datetime(2024, 1, 1)
SHAPE = "ts timestamp, kind string"


def test_counts_by_window(spark, tmp_path):
    rows = [(START + datetime.timedelta(seconds=37 * k), "ab"[k % 2]) for k in range(60)]
    later = [(START + datetime.timedelta(hours=5), "a")]
    late = [(START, "a"), (START + datetime.timedelta(hours=5, seconds=1), "b")]
    found = {}

    def keep(batch, _):
        found.update({(r.start, r.kind): r.n for r in batch.collect()})

    def run():
        stream = upserts.window_counts(spark.readStream.schema(SHAPE).parquet(str(tmp_path / "in")), "ts", "kind")
        stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)

    for part in (rows, later, late):
        spark.createDataFrame(part, SHAPE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run()
    want = collections.Counter()
    for at, kind in rows + later + late[1:]:
        want[at - datetime.timedelta(minutes=at.minute % 5, seconds=at.second), kind] += 1
    assert found == dict(want)
