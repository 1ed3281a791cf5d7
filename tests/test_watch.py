"""A watched folder: each burst of changes is one batch."""

import os
import time

from mnemospark.streaming.watch import Changes, FolderStream


def test_three_bursts_are_three_batches(spark, tmp_path):
    spark.dataSource.register(Changes)
    at = tmp_path / "code"
    (at / "pkg").mkdir(parents=True)
    (at / "node_modules").mkdir()
    seen = []

    def burst(writes, gone=()):
        for name, text in writes:
            (at / name).write_text(text)
        for name in gone:
            os.remove(at / name)
        got = {}
        stream = spark.readStream.format("folder_changes").option("settled", "0").load(str(at))
        q = stream.writeStream.foreachBatch(lambda df, n: got.setdefault(n, sorted((r.path, r.change) for r in df.collect()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        seen.append([rows for rows in got.values() if rows])

    burst([("a.py", "1"), ("a.py", "2"), ("pkg/b.py", "1"), ("node_modules/x.js", "1"), ("c.pyc", "")])
    time.sleep(0.05)
    burst([("a.py", "3"), ("d.py", "1")])
    burst([], ["pkg/b.py"])
    assert seen == [[[("a.py", "added"), ("pkg/b.py", "added")]], [[("a.py", "modified"), ("d.py", "added")]], [[("pkg/b.py", "deleted")]]]


def test_a_file_that_is_being_written_waits(tmp_path):
    reader = FolderStream(str(tmp_path), 60.0, "^$")
    (tmp_path / "a").write_text("1")
    assert reader.latestOffset() == {"files": "{}"}
    os.utime(tmp_path / "a", (1000, 1000))
    first = reader.latestOffset()
    assert reader.partitions({"files": "{}"}, first)[0].changes == [("a", "added", 1000.0)]
    os.utime(tmp_path / "a")  # changed just now: as it was until it rests
    assert reader.latestOffset() == first
    os.utime(tmp_path / "a", (2000, 2000))
    assert reader.partitions(first, reader.latestOffset())[0].changes == [("a", "modified", 2000.0)]
