"""Tasks hold a bounded share: tables spread by rows, day files by day, stream batches by bytes."""

import datetime
import gzip
import json

import pytest

from sojourn.plans import fixtures, raw_folder
from sojourn.sources import grouped, raw
from sojourn.streaming.ingest import ingest_incremental


def test_tables_are_spread_by_rows(spark, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    small = spark.range(100, numPartitions=1)
    assert fixtures.spread(small).rdd.getNumPartitions() == cores
    monkeypatch.setattr(fixtures, "TASK_ROWS", 3)
    assert fixtures.spread(small).rdd.getNumPartitions() == 34
    assert sorted(r.id for r in fixtures.spread(small).collect()) == list(range(100))


def test_a_small_day_of_the_raw_folder_is_one_file(spark, tmp_path):
    day = [datetime.datetime(2024, 1, 1 + i % 3, i % 24) for i in range(300)]
    rows = [(i, day[i], i % 7) for i in range(300)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long")
    events.repartition(4).write.parquet(str(tmp_path / "events.parquet"))
    root = raw_folder.raw_folder(spark, str(tmp_path))
    files = raw.discover_days(spark, root).groupBy("month", "day").count().collect()
    assert len(files) in (3, 4) and all(r["count"] == 1 for r in files)
    assert raw.scan_raw_pings(spark, root).count() == raw_folder.raw_rows(spark, str(tmp_path)).count()


@pytest.mark.parametrize("limit,batches", [(1, 5), (1 << 28, 1)])
def test_a_backlog_is_taken_in_batches(spark, tmp_path, limit, batches):
    head = "\t".join(raw.RAW_COLUMNS)
    for i in range(5):
        file = tmp_path / "raw" / "01" / f"0{i + 1}" / "a.csv.gz"
        file.parent.mkdir(parents=True)
        cells = {"timestamp": i, "device_aid": "x", "latitude": 1, "longitude": 2}
        with gzip.open(file, "wt") as out:
            out.write(head + "\n" + "\t".join(str(cells.get(c, "")) for c in raw.RAW_COLUMNS) + "\n")
    out, ckpt = tmp_path / "out", tmp_path / "ckpt"
    ingest_incremental(spark, str(tmp_path / "raw"), str(out), str(ckpt), batch_bytes=limit)
    assert sorted(r.timestamp for r in grouped.read_grouped(spark, str(out)).collect()) == [0, 1, 2, 3, 4]
    done = [f for f in (ckpt / "commits").iterdir() if f.name.isdigit()]
    assert len(done) == batches and json.loads((ckpt / "metadata").read_text())
