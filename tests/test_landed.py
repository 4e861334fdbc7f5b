"""The landed folder as a data source: offsets, restarts, a crash, odd names and bodies, partitions."""

import datetime

import pytest
from pyspark.sql import functions as F

from lakepress.sources import feeds, landed

AT = datetime.datetime(2024, 1, 1, 12, 0, 0, 123456)


def land(spark, folder, rows, block=10):
    return landed.land(spark.createDataFrame([(g, n, AT, b) for g, n, b in rows], landed.SCHEMA), str(folder), block)


def held(df):
    return sorted((r.grp, r.n, r.body) for r in df.collect())


def test_rows_come_back(spark, tmp_path):
    odd = [("a/b c", 1, 'x\ny "z" \\'), ("ж", 0, None), ("a", 3, ""), ("a", 3, "again"), ("a", 10**12, "long " * 200_000)]
    left_out = [(None, 1, "x"), ("", 1, "x"), ("a", None, "x"), ("a", -1, "x")]
    assert land(spark, tmp_path, odd + left_out) == len(odd)
    df = landed.read(spark, str(tmp_path))
    assert held(df) == sorted(odd, key=lambda r: (r[0], r[1], r[2] or "")) and {r.at for r in df.select("at").collect()} == {AT}
    assert land(spark, tmp_path, odd) == len(odd)  # the same files again
    assert df.count() == len(odd)
    assert held(landed.read(spark, f"file://{tmp_path}")) == held(df)


def test_after_and_empty(spark, tmp_path):
    assert landed.read(spark, str(tmp_path / "none")).count() == 0
    assert land(spark, tmp_path, []) == 0
    land(spark, tmp_path, [("a", n, "t") for n in range(35)] + [("b", n, "t") for n in range(5)])
    got = held(landed.read(spark, str(tmp_path), {"a": 12, "c": 3}))
    assert [n for g, n, _ in got if g == "a"] == list(range(13, 35)) and sum(g == "b" for g, _, _ in got) == 5


def test_partitions_hold_a_bounded_share(spark, tmp_path):
    land(spark, tmp_path, [("hot", n, "t" * 50) for n in range(500)])
    reader = landed.LandedReader({"path": str(tmp_path), "bytes": "4000"})
    parts = reader.partitions()
    assert len(parts) > 10 and sum(len(p.files) for p in parts) == 50
    some = landed.LandedReader({"path": str(tmp_path), "after": '{"hot": 488}'}).partitions()
    assert sum(len(p.files) for p in some) == 2  # by their names: no other file is opened


def test_stream_restarts_repeat_and_lose_none(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    drain = lambda: held(landed.drain_to(landed.read_stream(spark, folder), out))
    land(spark, folder, [("a", n, "t") for n in range(1, 15)])
    assert [n for _, n, _ in drain()] == list(range(1, 15))
    assert len(drain()) == 14  # nothing new
    # ids within the block that was landed before, and a new channel
    land(spark, folder, [("a", n, "t") for n in range(15, 18)] + [("b", 2, "t")])
    assert [(g, n) for g, n, _ in drain()] == [("a", n) for n in range(1, 18)] + [("b", 2)]
    # at or below the offset: not new
    land(spark, folder, [("a", 4, "late")])
    assert len(drain()) == 18


def test_a_batch_that_fails_comes_again(spark, tmp_path):
    folder, checkpoint, seen = str(tmp_path / "in"), str(tmp_path / "checkpoint"), []
    land(spark, folder, [("a", n, "t") for n in range(20)])

    def run(fail):
        def write(batch, epoch):
            ids = sorted(r.n for r in batch.select("n").collect())
            if fail:
                raise RuntimeError("lost")
            seen.append((epoch, ids))

        landed.read_stream(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    with pytest.raises(Exception, match="lost"):
        run(True)
    land(spark, folder, [("a", n, "t") for n in range(20, 25)])  # lands after the batch was planned
    run(False)
    assert seen[0] == (0, list(range(20)))  # the planned batch, with its rows
    run(False)
    assert sorted(n for _, ids in seen for n in ids) == list(range(25))


def test_posts(spark, tmp_path):
    land(spark, tmp_path, [("ch", 7, "A [link](http://x) of the day")])
    p = landed.posts(landed.read(spark, str(tmp_path)))
    assert p.columns == ["channel", "post_id", "text", "at"] and p.where(F.col("post_id") == 7).count() == 1


def test_fuel_imports(spark):
    row = '{"destination_iso2": "%s", "commodity_group": "%s", "commodity_group_name": %s, "value_eur": %s, "value_tonne": %s}'
    bare = "[" + ", ".join([row % ("cn", "oil", '"Oil"', 5.125, 1), row % ("CN", "gas", "null", '"7"', "null"), row % ("EU27", "oil", '"Oil"', 9, 9), row % ("in", "coal", '""', 0, 0)]) + "]"
    wrapped = '{"data": [' + row % ("de", "coal", '""', 12.125, 2) + ", " + row % ("in", "lng", '"LNG"', "null", 3) + "], \"page\": 1}"
    df = spark.createDataFrame([(b,) for b in (bare, wrapped, "", "{}", "oops", None)], "body string")
    got = {r.country_code: r for r in feeds.fuel_imports(df, "body").collect()}
    assert {k: (r.total_eur, r.total_tonne, r.world_rank) for k, r in got.items()} == {"CN": (12.125, 1.0, 1), "DE": (12.125, 2.0, 2), "IN": (0.0, 3.0, 3)}
    assert [(c.group, c.name) for c in got["CN"].commodities] == [("gas", "gas"), ("oil", "Oil")] and got["DE"].commodities[0].name == "coal"
    assert feeds.fuel_imports(df.where("false"), "body").count() == 0
