"""Programs give the same rows as the API."""

from __future__ import annotations

import pytest
from literal_rows import rows
from pyspark.sql import functions as F

from lattica.plans import Planner, parse, run
from lattica.plans.lexer import ProgramError
from lattica.sources import tables


@pytest.fixture
def planner(spark, tmp_path):
    data = {
        "t": spark.createDataFrame([(1, "a", 1.5), (2, "b", 2.5), (3, "a", 3.5)], "k int, s string, x double"),
        "u": spark.createDataFrame([(1, "one"), (2, "two"), (2, "zwei")], "id int, name string"),
    }
    return Planner(data.__getitem__, tables.Relations(spark, f"file://{tmp_path}/r"))


def test_filters_and_columns(planner):
    out = planner.run("""
        t = LOAD t;  /* a comment */
        f = FILTER t BY k >= 2, s == "a" || x < 3;
        g = FOREACH f GENERATE y : DOUBLE = x * 2 + 1, big = k > 2 ? "yes" : "no",
            c = CASE s { WHEN "a" THEN 1 WHEN "b" THEN 2 ELSE 0 }, m = MATCH(s, '^a'), q = (k - 4) // 2, z = UDF:Contains<values = [1, 3]>(k);
    """)
    assert rows(out["g"].select("k", "y", "big", "c", "m", "q", "z")) == [(2, 6.0, "no", 2, False, -1, False), (3, 8.0, "yes", 1, True, 0, True)]


def test_joins(planner):
    out = planner.run("""
        t = LOAD t; u = LOAD u;
        j = JOIN t BY (k), u BY (id);
        l = LEFT OUTER JOIN t BY k, u BY id;
        i = FILTER t USING (k) IN u (id);
        n = FILTER t USING (k) NOT IN u (id);
    """)
    assert [out[x].count() for x in "jlin"] == [3, 4, 2, 1]


def test_aggregates(planner):
    out = planner.run("""
        Tops := GLA:OrderBy<order = {x: DESC}, limit = 1, rank = r>;
        t = LOAD t;
        a = GLA:Sum FROM t USING k, x AS (sk, sx);
        g = GLA:GroupBy<group = [s], aggregate = GLA:Count> FROM t USING s AS (s, n : INT);
        o = GLA:OrderBy<order = {x: DESC}, limit = 2, rank = r> FROM t USING x, k AS (x, k);
        e = GLA:ExtremeTuples<extremes = {s: MIN, x: MAX}> FROM t USING s, x AS (s, x);
        d = GLA:CountDistinct FROM t USING s AS (n);
        b = GLA:GroupBy<group = [s], aggregate = Tops> FROM t USING s, x, k AS (s, x, k, r);
    """)
    assert rows(out["a"]) == [(6, 7.5)]
    assert rows(out["g"]) == [("a", 2), ("b", 1)]
    assert rows(out["o"].select("x", "k", "r")) == [(2.5, 2, 2), (3.5, 3, 1)]
    assert rows(out["e"]) == [("a", 3.5)]
    assert rows(out["d"]) == [(2,)]
    assert rows(out["b"].select("s", "x", "k", "r")) == [("a", 3.5, 3, 1), ("b", 2.5, 2, 1)]


def test_transforms(planner):
    out = planner.run("""
        t = LOAD t; u = LOAD u;
        r = GT:Range<distance = 2>() FROM t USING k AS v;
        j = GT:Join FROM t REQUIRES u USING k AS name;
        b = FILTER t BY GF:PatternMatcher<pattern = "b"> USING s;
    """)
    assert out["r"].count() == 9
    assert rows(out["j"].select("k", "name")) == [(1, "one"), (2, "two"), (2, "zwei")]
    assert rows(out["b"].select("k")) == [(2,)]


def test_storing_and_printing(planner, tmp_path):
    out = planner.run('CREATE RELATION copy(k: INT, s: STRING); t = LOAD t; STORE t AS k = k * 10, s = s INTO copy; PRINT t USING k, s HEADER key, text SEPARATOR ";" LIMIT 2; FLUSH; JOBID mine; QUIT;')
    assert rows(planner.relations.load("copy")) == [(10, "a"), (20, "b"), (30, "a")]
    assert planner.printed[0].count() == 2
    assert planner.job == "mine"
    assert "t" in out


def test_user_processors(planner):
    planner.filters["Above"] = lambda x, least=0: x > least
    planner.transforms["Twice"] = lambda df, inputs, outputs: df.withColumn(outputs[0], F.col(inputs[0]) * 2)
    out = planner.run("t = LOAD t; a = FILTER t BY GF:Above<least = 2> USING x; b = GT:Twice FROM t USING k AS kk;")
    assert out["a"].count() == 2
    assert rows(out["b"].select("kk")) == [(2,), (4,), (6,)]


def test_load_range_and_read(planner, tmp_path):
    (tmp_path / "d.csv").write_text("5,x\n6,y\n")
    out = planner.run(f"r = LOAD t FILTER RANGE 2, NULL; f = READ FILE 'file://{tmp_path}/d.csv' USING GI:CSVReader<sep = ','> ATTRIBUTES (a: INT, b: STRING);")
    assert rows(out["r"].select("k")) == [(2,), (3,)]
    assert rows(out["f"]) == [(5, "x"), (6, "y")]


@pytest.mark.parametrize("bad", ["x = FILTER", "x = FILTER y BY 1 +", "x = LOAD a $", "PRINT a USING b HEADER c, d", "x = FOREACH a GENERATE = 1"])
def test_errors_name_the_line(bad):
    with pytest.raises(ProgramError, match="line 1"):
        parse(bad)


def test_unknown_names(planner):
    with pytest.raises(ProgramError):
        planner.run("x = FILTER nothing BY 1 == 1;")
    with pytest.raises(ProgramError):
        run("t = LOAD t; a = GLA:Nothing FROM t;", lambda n: planner.load(n))
