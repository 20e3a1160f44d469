"""Files, generated rows, sinks, scalar functions and streams."""

from __future__ import annotations

import json

import pytest
from literal_rows import rows
from pyspark.sql import functions as F

from lattica.functions import arrays, categories, dates, maths, network, text
from lattica.sources import csv, generators, sinks, tables
from lattica.streaming import read_events, run_to_memory, tumbling
from lattica.types import parse_as


def write(path, content):
    path.write_bytes(content.encode())
    return f"file://{path}"


def test_csv_options(spark, tmp_path):
    one = write(tmp_path / "a.csv", 'h1,h2\r\n1,"x, y"\r\nNULL,"q\\"q"\r\n3,\r\n')
    cols = [("n", "INT"), ("s", "STRING")]
    out = csv.read_csv(spark, one, cols, skip=1, trim_cr=True, line_number="line", nullable=["n"])
    assert rows(out) == [(1, 1, "x, y"), (2, None, 'q"q'), (3, 3, "")]
    write(tmp_path / "b.csv", "h,h\n7,z\n8,w\n")
    both = csv.read_csv(spark, f"file://{tmp_path}/*.csv", cols, skip=1, n=1, trim_cr=True)
    assert rows(both) == [(1, "x, y"), (7, "z")]
    bars = write(tmp_path / "t.tbl", "1|a|\n2|b|\n")
    assert rows(csv.read_text(spark, bars, cols)) == [(1, "a"), (2, "b")]
    tabs = write(tmp_path / "t.tsv", "1\tNULL\n")
    assert rows(csv.read_csv(spark, tabs, cols, sep="tab", simple=True, nullable={"s": "NULL"})) == [(1, None)]
    flows = write(tmp_path / "f.txt", "10.0.0.1,5\n300.1.1.1,6\n")
    assert rows(csv.read_netflow(spark, flows)) == [(167772161, 5), (None, 6)]
    with pytest.raises(ValueError):
        csv.read_csv(spark, one, cols, sep="ab")


def test_relations(spark, tmp_path):
    stored = tables.Relations(spark, f"file://{tmp_path}/relations")
    stored.create("r", [("a", "INT"), ("b", "STRING")])
    assert stored.load("r").count() == 0
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    stored.store(df, "r")
    stored.store(df, "r", {"a": F.col("a") + 1, "b": F.lit("y")})
    assert rows(stored.load("r")) == [(1, "x"), (2, "y")]
    stored.store(df, "r", overwrite=True)
    assert stored.load("r").count() == 1
    stored.delete_content("r")
    assert stored.load("r").count() == 0
    stored.delete("r")
    assert not stored.known("r")


def test_cluster_and_print(spark, tmp_path):
    df = spark.range(100).select(F.col("id").alias("k"), F.lit("v").alias("v"))
    zones = sinks.cluster(df, "k", f"file://{tmp_path}/c", 4).collect()
    spans = sorted((z.low, z.high) for z in zones)
    assert sum(z.n for z in zones) == 100
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert rows(tables.load(spark, f"file://{tmp_path}/c", ranges=[(None, 1), (98, None)], on="k").select("k")) == [(0,), (1,), (98,), (99,)]
    assert sinks.printed(df, {"k": F.col("k")}, limit=3).count() == 3
    envelope = json.loads(sinks.json_envelope(df.limit(2)))
    assert len(envelope["content"]) == 2
    assert [t["name"] for t in envelope["types"]] == ["k", "v"]


def test_generated_clusters(spark):
    s = generators.Spread
    native = generators.clusters(spark, 2000, [[s("normal", (5, 1)), s("inverse_gaussian", (2, 4))]], ["x", "y"], 3, 2)
    assert native.count() == 4000
    drawn = generators.clusters(spark, 4000, [[s("gamma", (2, 3)), s("binomial", (10, 0.5))]], ["x", "y"], 3)
    for df, means in ((native, (5, 2)), (drawn, (6, 5))):
        assert df.agg(F.avg("x"), F.avg("y")).first() == pytest.approx(means, rel=0.08)
    assert generators.expected_mean(s("negative_binomial", (3, 0.5))) == 3
    with pytest.raises(ValueError):
        s("cauchy", (1,))


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_maths_and_text(spark):
    a = lambda x, y: [f(F.lit(x), F.lit(y)) for f in (maths.divide, maths.quotient, maths.remainder)]
    assert one(spark, *a(7, -2)) == (-3.5, -3, 1)
    assert one(spark, *a(-7, 2)) == (-3.5, -3, -1)
    assert one(spark, text.first_byte(F.lit("é")), text.first_byte(F.lit("")), text.char_at(F.lit("abc"), 1), text.n_bytes(F.lit("é"))) == (195, 0, "b", 2)
    assert one(spark, arrays.is_set(F.lit(5), 2), arrays.bits(F.lit(5)), arrays.set_mask(F.array(F.lit("b")), ["a", "b"])) == (True, 2, 2)
    ids = {"b": 1, "a": 2}
    assert one(spark, categories.category_id(F.lit("a"), ids), categories.category_name(F.lit(1), ids), categories.is_valid(F.lit("z"), ids)) == (2, "b", False)
    assert one(spark, network.mac(F.lit("00:00:00:00:01:00")), network.mac(F.lit("zz")), network.ipv4(F.lit("1.2.3")), network.ipv4_text(F.lit(16909060))) == (256, None, None, "1.2.3.4")
    assert one(spark, parse_as(F.lit("x"), "INT"), parse_as(F.lit("-1"), "UINT"), parse_as(F.lit("2020/02/03"), "DATE").cast("string")) == (None, None, "2020-02-03")


def test_dates(spark):
    d = lambda s: F.lit(s).cast("date")
    iso = lambda s: (dates.week_of_year(d(s)), dates.week_year(d(s)), dates.day_of_week(d(s)))
    assert one(spark, *iso("2021-01-03")) == (53, 2020, 7)
    assert one(spark, *iso("2020-12-31")) == (53, 2020, 4)
    assert one(spark, dates.is_leap_year(d("2000-02-29")), dates.is_leap_year(d("1900-02-28")), dates.days_in_month(d("2024-02-01"))) == (True, False, 29)
    assert one(spark, dates.date_of_julian(F.lit(2440589)).cast("string"), dates.julian_day(d("1970-01-01"))) == ("1970-01-02", 2440588)
    ts = lambda s: F.lit(s).cast("timestamp")
    assert one(spark, dates.is_dst(ts("2024-07-01"), "Europe/Berlin"), dates.is_dst(ts("2024-01-02"), "Europe/Berlin"), dates.is_dst_boundary(ts("2024-03-31 01:00:00"), "Europe/Berlin")) == (True, False, True)
    parts = dates.time_parts(dates.time_of(ts("2024-01-02 03:04:05.678")))
    assert one(spark, *parts.values()) == (3, 4, 5, 678)


def test_stream(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    events.repartition(3).write.parquet(f"file://{tmp_path}/in")
    stream = read_events(spark, f"file://{tmp_path}/in", events.schema)
    agg = {"n": F.count(F.lit(1))}
    out = run_to_memory(tumbling(stream, "ts", "1 day", [], agg, "10 days"), "tumbled", f"file://{tmp_path}/ck", "complete")
    assert rows(out) == rows(tumbling(events, "ts", "1 day", [], agg))
