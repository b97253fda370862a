"""Offsets, restarts and pushed filters of the data sources."""

import json
import sqlite3

from evidara.sources import feeds


def drained(spark, name, path, base, **options):
    rows = spark.readStream.format(name).options(**options).load(path)
    rows.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").collect()


def test_archive_in_ranges_with_filters_and_as_a_stream(spark, tmp_path):
    feeds.register(spark)
    path = str(tmp_path / "a.db")
    with sqlite3.connect(path) as db:
        db.execute('CREATE TABLE "my msg" (i INTEGER, t TEXT)')
        db.executemany('INSERT INTO "my msg" VALUES (?, ?)', [(i, None if i % 5 == 0 else f"t{i % 3}'") for i in range(25)])
    read = lambda: spark.read.format("sqlite_rows").schema("i long, t string").option("table", "my msg").option("rows", 4).load(path)
    assert read().count() == 25 and read().rdd.getNumPartitions() == 7
    assert sorted(r.i for r in read().filter("t = \"t1'\" and i between 5 and 20").collect()) == [7, 13, 16, 19]
    assert sorted(r.i for r in read().filter("t is null or i in (3, 4)").collect()) == [0, 3, 4, 5, 10, 15, 20]
    base = str(tmp_path / "s")
    assert len(drained(spark, "sqlite_rows", path, base, table="my msg", rows=10)) == 25
    with sqlite3.connect(path) as db:
        db.executemany('INSERT INTO "my msg" VALUES (?, ?)', [(i, "new") for i in range(25, 28)])
    assert sorted(int(r.i) for r in drained(spark, "sqlite_rows", path, base, table="my msg", rows=10)) == list(range(28))


def test_pushed_conditions_select_what_spark_does():
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNull, Not, StringContains

    assert feeds.condition(EqualTo(("a",), "x")) == ('"a" = ?', ["x"])
    assert feeds.condition(In(('q"',), (1, 2))) == ('"q""" IN (?, ?)', [1, 2])
    assert feeds.condition(StringContains(("a",), "50%")) == ('instr("a", ?) > 0', ["50%"])
    assert feeds.condition(IsNull(("a",))) == ('"a" IS NULL', [])
    for f in (Not(EqualTo(("a",), 1)), EqualTo(("a", "b"), 1), GreaterThan(("a",), True), EqualTo(("a",), None)):
        assert feeds.condition(f) is None


def test_a_batch_of_changes_is_read_once(spark, tmp_path):
    feeds.register(spark)
    where, base = tmp_path / "in", str(tmp_path / "s")

    def put(cursor, *ids):
        (where / f"batch={cursor}").mkdir(parents=True)
        (where / f"batch={cursor}" / "part-0.txt").write_text("".join(json.dumps({"account_id": "a", "change_id": i, "kind": "put", "row": {"v": i}}) + "\n" for i in ids))

    put(1, 1, 2)
    put(3, 3)
    assert sorted((r.cursor, r.change_id, r.row) for r in drained(spark, "change_feed", str(where), base)) == [(1, 1, '{"v": 1}'), (1, 2, '{"v": 2}'), (3, 3, '{"v": 3}')]
    (where / "batch=1" / "part-1.txt").write_text((where / "batch=1" / "part-0.txt").read_text())  # sent again under its cursor
    put(4, 9)
    assert sorted(r.change_id for r in drained(spark, "change_feed", str(where), base)) == [1, 2, 3, 9]
    assert len(drained(spark, "change_feed", str(where), base)) == 4


def test_lines_of_growing_and_rotated_logs(spark, tmp_path, monkeypatch):
    feeds.register(spark)
    where, base = tmp_path / "log", str(tmp_path / "s")
    where.mkdir()
    (where / "1.jsonl").write_text("a\nbé\nhalf")
    assert [r.line for r in drained(spark, "rotated_log", str(where), base)] == ["a", "bé"]
    with open(where / "1.jsonl", "a") as f:
        f.write(" line\nc\n")
    (where / "2.jsonl").write_text("d\n" + "x" * 5000 + "\n")
    assert sorted(r.line[:9] for r in drained(spark, "rotated_log", str(where), base)) == ["a", "bé", "c", "d", "half line", "x" * 9]
    assert spark.read.format("rotated_log").load(str(where)).count() == 6


def test_ranges_of_a_log_share_its_lines_out(tmp_path, monkeypatch):
    monkeypatch.setattr(feeds, "LOG_BYTES", 7)
    lines = ["", "a", "bc", "x" * 20, "defgh", "", "z"]
    (tmp_path / "f").write_text("\n".join(lines) + "\n")
    r = feeds._LogReader(str(tmp_path))
    assert [line for part in r.partitions() for _, _, line in r.read(part)] == lines
