import gzip
import hashlib
import zipfile

import pytest
from pyspark.sql import functions as F

from sojourn.functions.hashing import device_group, uniform_draw
from sojourn.sources import grouped, raw
from sojourn.streaming.ingest import days_to_do, ingest_incremental

HEAD = "\t".join(raw.RAW_COLUMNS)


def line(t, device, lat, lon, extra=""):
    cells = {"timestamp": t, "device_aid": device, "latitude": lat, "longitude": lon, "location_method": "gps"}
    return "\t".join(str(cells.get(c, "secret")) for c in raw.RAW_COLUMNS) + extra


def gz(path, *lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    with gzip.open(path, "wt") as out:
        out.write("\n".join([HEAD, *lines]) + "\n")


def zipped(path, members):
    path.parent.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(path, "w") as out:
        for name, text in members.items():
            out.writestr(name, text)


def test_days_rows_and_archives(spark, tmp_path):
    root = tmp_path / "year"
    gz(root / "01" / "02" / "a.csv.gz", line(1, "x", 1.5, 2.5), line(2, "", 1, 2), line(3, "y", "", 2), line(4, "z", 1, 2, "\tsurplus"))
    gz(root / "07" / "b.csv.gz", line(5, "w", 3, 4))
    gz(root / "elsewhere" / "c.csv.gz", line(6, "v", 3, 4))
    zipped(root / "01" / "03" / "d.csv.zip", {"one.csv": HEAD + "\n" + line(7, "u", 5, 6) + "\n" + line(8, "t", 5, 6, "\tsurplus") + "\n", "note.txt": "x"})
    zipped(root / "01" / "03" / "e.zip", {"note.txt": "nothing here"})
    days = {(r.path.rsplit("/", 1)[1], r.month, r.day) for r in raw.discover_days(spark, str(root)).collect()}
    assert days == {("a.csv.gz", "01", "02"), ("b.csv.gz", "00", "07"), ("d.csv.zip", "01", "03"), ("e.zip", "01", "03")}
    rows = {(r.timestamp, r.device_aid, r.month, r.day) for r in raw.scan_all(spark, str(root)).collect()}
    assert rows == {(1, "x", "01", "02"), (5, "w", "00", "07"), (7, "u", "01", "03")}
    month_root = {(r.timestamp, r.month, r.day) for r in raw.scan_raw_pings(spark, str(root / "01")).collect()}
    assert (1, "01", "02") in month_root
    assert "ip" not in raw.scan_all(spark, str(root)).columns


def test_personal_columns_are_not_read(spark, tmp_path):
    gz(tmp_path / "01" / "02" / "a.csv.gz", line(1, "x", 1, 2))
    plan = raw.scan_raw_pings(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    schema = plan[plan.index("ReadSchema"):]
    assert "user_agent" not in schema and "carrier" not in schema


def test_a_file_without_a_kept_column_fails(spark, tmp_path):
    path = tmp_path / "01" / "02" / "a.csv.gz"
    path.parent.mkdir(parents=True)
    cut = [c for c in raw.RAW_COLUMNS if c != "latitude"]
    with gzip.open(path, "wt") as out:
        out.write("\t".join(cut) + "\n" + "\t".join("1" for _ in cut) + "\n")
    with pytest.raises(Exception, match="unexpected header"):
        raw.scan_raw_pings(spark, str(tmp_path)).collect()
    zipped(tmp_path / "z" / "01" / "02" / "b.zip", {"a.csv": "timestamp\tdevice_aid\n1\tx\n"})
    with pytest.raises(Exception, match="missing columns"):
        raw.scan_zip_pings(spark, str(tmp_path / "z")).collect()


def test_incremental_runs_take_only_new_files(spark, tmp_path):
    root, out, ckpt = tmp_path / "raw", str(tmp_path / "out"), str(tmp_path / "ckpt")
    gz(root / "01" / "02" / "a.csv.gz", line(1, "x", 1, 2), line(2, "y", 1, 2))
    ingest_incremental(spark, str(root), out, ckpt)
    ingest_incremental(spark, str(root), out, ckpt)
    assert grouped.read_grouped(spark, out).count() == 2
    gz(root / "01" / "03" / "b.csv.gz", line(3, "x", 1, 2))
    ingest_incremental(spark, str(root), out, ckpt)
    assert sorted(r.timestamp for r in grouped.read_grouped(spark, out).collect()) == [1, 2, 3]


def test_incremental_runs_take_archives_and_leave_one_file_per_folder(spark, tmp_path):
    root, out, ckpt = tmp_path / "raw", tmp_path / "out", str(tmp_path / "ckpt")
    for i in range(4):
        gz(root / "01" / "02" / f"{i}.csv.gz", line(i, "x", 1, 2))
    zipped(root / "01" / "02" / "z.zip", {"a.csv": HEAD + "\n" + line(9, "x", 1, 2) + "\n"})
    for _ in range(2):
        ingest_incremental(spark, str(root), str(out), ckpt)
    assert sorted(r.timestamp for r in grouped.read_grouped(spark, str(out)).collect()) == [0, 1, 2, 3, 9]
    assert len(list(out.glob("grp=*/month=01/day=02/*.parquet"))) == 1


def test_garbage_in_a_line_is_counted_and_does_not_fail(spark, tmp_path):
    gz(tmp_path / "01" / "02" / "a.csv.gz", line(1, "x", 1, 2), line("??", "y", "north", 2), line(3, "z", 1, 2, "\tmore"), line(4, "w", "", 2))
    assert [r.timestamp for r in raw.scan_all(spark, str(tmp_path)).collect()] == [1]
    assert [(r.n_lines, r.n_bad) for r in raw.bad_lines(spark, str(tmp_path)).collect()] == [(4, 2)]


PINGS = "timestamp bigint, device_aid string, latitude double, longitude double, location_method string, month string, day string"


def test_corrupt_files_fail_or_are_passed_over_and_listed(spark, tmp_path):
    out = tmp_path / "grouped"
    rows = spark.createDataFrame([(i, f"d{i}", 1.0, 2.0, "gps", "01", "02") for i in range(20)], PINGS)
    grouped.write_grouped_pings(rows, str(out))
    assert grouped.unreadable_files(spark, str(out)).count() == 0
    (out / "grp=3" / "month=01" / "day=02").mkdir(parents=True, exist_ok=True)
    (out / "grp=3" / "month=01" / "day=02" / "broken.parquet").write_bytes(b"PAR1 this is not a table")
    with pytest.raises(Exception):
        grouped.read_grouped(spark, str(out)).collect()
    assert len(grouped.read_grouped(spark, str(out), skip_corrupt=True).collect()) == 20
    assert [r.path.rsplit("/", 1)[1] for r in grouped.unreadable_files(spark, str(out)).collect()] == ["broken.parquet"]


def test_registry_manifest_and_file_count(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"d{i % 3}", 1.0, 2.0, "gps", "01", f"0{1 + i % 2}") for i in range(12)], PINGS)
    for _ in range(2):  # writing again replaces
        grouped.write_registry(rows, str(tmp_path / "registry"))
        grouped.write_manifest(grouped.with_group(rows), str(tmp_path / "manifest"))
    assert {r.device_aid for r in spark.read.parquet(str(tmp_path / "registry")).collect()} == {"d0", "d1", "d2"}
    done = grouped.read_manifest(spark, str(tmp_path / "manifest"))
    assert sorted((r.day, r.records, r.devices, sum(r.records_per_group.values())) for r in done.collect()) == [("01", 6, 3, 6), ("02", 6, 3, 6)]
    days = spark.createDataFrame([("01", "02"), ("01", "03")], "month string, day string")
    assert [r.day for r in days_to_do(days, done).collect()] == ["03"]
    assert grouped.profile_pings(rows, files=days).first().files == 2


def test_rewriting_a_day_replaces_only_that_day(spark, tmp_path):
    schema = "timestamp bigint, device_aid string, latitude double, longitude double, location_method string, month string, day string"

    def day(d, n):
        return spark.createDataFrame([(i, "x", 1.0, 2.0, "gps", "01", d) for i in range(n)], schema)

    out = str(tmp_path / "grouped")
    grouped.write_grouped_pings(day("02", 3).union(day("03", 4)), out)
    grouped.write_grouped_pings(day("03", 1), out)
    assert grouped.read_grouped(spark, out).groupBy("day").count().orderBy("day").collect()[0]["count"] == 3
    assert grouped.read_grouped(spark, out).count() == 4


def test_group_range_prunes_folders_and_columns(spark, tmp_path):
    schema = "timestamp bigint, device_aid string, latitude double, longitude double, location_method string, month string, day string"
    rows = spark.createDataFrame([(i, f"d{i}", 1.0, 2.0, "gps", "01", "02") for i in range(100)], schema)
    out = str(tmp_path / "grouped")
    grouped.write_grouped_pings(rows, out)
    df = grouped.scan_group_range(spark, out, 10, 20)
    want = {f"d{i}" for i in range(100) if 10 <= int(hashlib.md5(f"d{i}".encode()).hexdigest(), 16) % 50 < 20}
    assert {r.device_aid for r in df.collect()} == want
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(grp" in plan and "location_method" not in plan[plan.index("ReadSchema"):]


def test_hashes_match_python(spark):
    ids = ["a", "dev_1", "é–ö", "00000000-0000-0000-0000-000000000000"]
    df = spark.createDataFrame([(i,) for i in ids], "d string")
    got = {r.d: (r.g, r.u) for r in df.select("d", device_group("d", 300).alias("g"), uniform_draw(42, F.col("d")).alias("u")).collect()}
    for i in ids:
        assert got[i][0] == int(hashlib.md5(i.encode()).hexdigest(), 16) % 300
        bits = int(hashlib.md5(f"42|{i}".encode()).hexdigest()[:13], 16)
        assert got[i][1] == (bits + 0.5) / 2**52


def test_days_to_do(spark):
    days = spark.createDataFrame([("01", "02"), ("01", "03")], "month string, day string")
    assert [r.day for r in days_to_do(days, days.where("day = '02'")).collect()] == ["03"]
