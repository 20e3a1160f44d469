"""Further registered queries: programs of the dataflow language, states, iteration, sources, and rarer functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.catalog import _scratch, query, rel
from lattica.functions import arrays, dates, maths, network
from lattica.operators import aggregates as agg
from lattica.operators import iterate, joins, ranking
from lattica.plans import Planner
from lattica.sources import csv, sinks, tables


def planned(spark, d, source, **setup) -> Planner:
    """A planner over the tables of a folder after running a program."""
    p = Planner(lambda name: rel(spark, d, name), setup.get("relations"))
    for name, f in setup.get("functions", {}).items():
        p.register_function(name, f)
    for symbol, f in setup.get("operators", {}).items():
        p.register_operator(symbol, f)
    p.run(source)
    return p


# states and iteration


@query("SELECT o_orderkey, c_name, c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey")
def program_state_join(spark, d):
    source = """
        c = LOAD customer; o = LOAD orders;
        names = GLA:Multi_Hash<split = 1> FROM c USING c_custkey, c_name, c_acctbal AS SELF;
        j = GT:Join FROM o REQUIRES names USING o_custkey AS c_name, c_acctbal;
    """
    return planned(spark, d, source).frame("j").select("o_orderkey", "c_name", "c_acctbal")


@query("""SELECT l_orderkey, l_linenumber, s_name FROM lineitem
LEFT JOIN (SELECT s_suppkey * 3 AS lo, s_suppkey * 3 + 1 AS hi, s_name FROM supplier) ON l_partkey BETWEEN lo AND hi""")
def program_interval_state(spark, d):
    source = """
        li = LOAD lineitem; s = LOAD supplier;
        spans = GLA:Interval_Map FROM s USING lo = s_suppkey * 3, hi = s_suppkey * 3 + 1, s_name AS SELF;
        j = GT:Interval_Join<keep.missing = true, width = 4> FROM li REQUIRES spans USING l_partkey AS s_name;
    """
    return planned(spark, d, source).frame("j").select("l_orderkey", "l_linenumber", "s_name")


@query("""SELECT l_orderkey, l_linenumber, s_name FROM lineitem
JOIN (SELECT s_nationkey, s_suppkey AS lo, s_suppkey + 2 AS hi, s_name FROM supplier) ON l_suppkey % 25 = s_nationkey AND l_suppkey >= lo AND l_suppkey < hi""")
def program_group_interval_state(spark, d):
    source = """
        li = LOAD lineitem; s = LOAD supplier;
        spans = GLA:GroupBy<group = [s_nationkey], aggregate = GLA:Interval_Map>
            FROM s USING s_nationkey, s_suppkey, hi = s_suppkey + 2, s_name AS SELF;
        j = GT:Group_By_Interval_Join FROM li REQUIRES spans USING l_suppkey, k = l_suppkey % 25 AS s_name;
    """
    return planned(spark, d, source).frame("j").select("l_orderkey", "l_linenumber", "s_name")


@query("SELECT count(*) AS n FROM orders WHERE o_totalprice > (SELECT max(c_acctbal) * 10 FROM customer)")
def program_filter_state(spark, d):
    source = """
        c = LOAD customer; o = LOAD orders;
        top = GLA:Max FROM c USING c_acctbal AS SELF;
        f = FILTER o BY GF:Above REQUIRES top USING o_totalprice;
        n = GLA:Count FROM f AS n;
    """
    p = Planner(lambda name: rel(spark, d, name))
    p.filters["Above"] = lambda c: c > F.col("c_acctbal") * 10
    return p.run(source)["n"]


@query("SELECT n_nationkey AS k, CAST(8 * n_nationkey + 7 AS BIGINT) AS v FROM nation")
def program_gist(spark, d):
    source = """
        n = LOAD nation;
        s = FOREACH n GENERATE k : BIGINT = n_nationkey, v : BIGINT = n_nationkey;
        kv = GLA:Gather FROM s USING k, v AS SELF;
        g = GIST:Rounds<expressions = {v: 'v * 2 + 1'}, rounds = 3> REQUIRES kv AS k, v;
    """
    return planned(spark, d, source).frame("g").selectExpr("cast(k as int) k", "v")


@query("SELECT CAST(n_nationkey + r AS BIGINT) AS v, CAST(r AS INT) AS round FROM nation, generate_series(1, 3) AS g(r)")
def program_gist_intermediates(spark, d):
    source = """
        n = LOAD nation;
        s = FOREACH n GENERATE v : BIGINT = n_nationkey;
        st = GLA:Gather FROM s USING v AS SELF;
        g = GIST:Rounds<expressions = {v: 'v + 1'}, rounds = 3, intermediates = true> REQUIRES st AS v, round;
    """
    return planned(spark, d, source).frame("g").select("v", "round")


@query("""SELECT CAST(c AS INT) AS center, round(avg(l_quantity), 6) AS x FROM
(SELECT l_quantity, CASE WHEN abs(l_quantity - 10) <= abs(l_quantity - 40) THEN 0 ELSE 1 END AS c FROM lineitem) GROUP BY 1""")
def program_gist_k_means(spark, d):
    source = """
        li = LOAD lineitem;
        q = GLA:Gather FROM li USING l_quantity AS SELF;
        g = GIST:KMeans<centers = [[10], [40]], rounds = 1> REQUIRES q AS center, x;
    """
    return planned(spark, d, source).frame("g").select("center", F.round("x", 6).alias("x"))


@query("""SELECT round(sum(l_discount * (CASE WHEN l_quantity > 25 THEN 0.5 ELSE -0.5 END)) / (sum(l_discount * l_discount) * 0.25 + 1e-9), 5) AS b FROM lineitem""")
def program_iterable(spark, d):
    source = """
        li = LOAD lineitem;
        f = FOREACH li GENERATE y : INT = l_quantity > 25 ? 1 : -1, x : DOUBLE = l_discount;
        b = GLA:LogisticRegressionIRLS<rounds = 1> FROM f USING y, x AS b;
    """
    return planned(spark, d, source).frame("b").select(F.round("b", 5).alias("b"))


@query("""WITH a AS (SELECT l_suppkey, count(*) AS n0, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS s0 FROM lineitem GROUP BY 1)
SELECT l.l_suppkey, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS s FROM lineitem l JOIN a ON l.l_suppkey = a.l_suppkey
WHERE CAST(l_quantity AS BIGINT) * n0 <= s0 GROUP BY 1""")
def group_iterate(spark, d):
    """One round after the first: the values up to the mean of the group's state."""
    li = rel(spark, d, "lineitem").select("l_suppkey", F.col("l_quantity").cast("long").alias("q"))
    first = {"n": F.count(F.lit(1)), "s": F.sum("q")}
    kept = F.col("q") * F.col("n") <= F.col("s")
    step = {"n": F.count_if(kept), "s": F.sum(F.when(kept, F.col("q")))}
    return iterate.iterate_groups(li, ["l_suppkey"], first, step, max_rounds=1)


# aggregates


@query("SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey LIMIT 17")
def order_keep_ties(spark, d):
    source = """
        p = LOAD part;
        t = GLA:OrderBy<order = {p_size: DESC}, limit = 17, keep.ties = true> FROM p USING p_size, p_partkey AS p_size, p_partkey;
    """
    return planned(spark, d, source).frame("t").select("p_partkey", "p_size")


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1")
def segmenter_passes(spark, d):
    inner = agg.group_by(["l_partkey"], agg.count("n"))
    return agg.evaluate(rel(spark, d, "lineitem"), agg.segment("l_partkey", inner, 8, passes=3)).select("l_partkey", "n")


@query("SELECT count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total, round(avg(l_quantity), 9) AS mean FROM lineitem")
def average_of_three(spark, d):
    source = """
        li = LOAD lineitem;
        q = FOREACH li GENERATE q : BIGINT = l_quantity;
        a = GLA:Average FROM q USING q AS n, total, mean;
    """
    return planned(spark, d, source).frame("a").select("n", "total", F.round("mean", 9).alias("mean"))


@query("SELECT '{\"count\":' || count(*) || '}' AS state FROM nation")
def count_json(spark, d):
    return agg.evaluate(rel(spark, d, "nation"), agg.count("state", as_json=True))


@query("SELECT CAST(0 AS BIGINT) AS s, CAST(NULL AS INT) AS top, CAST(0 AS BIGINT) AS n")
def agg_over_nothing(spark, d):
    none = rel(spark, d, "nation").filter("n_nationkey < 0")
    return agg.evaluate(none, agg.multiplex([agg.sums({"s": "n_nationkey"}), agg.maxima({"top": "n_nationkey"}), agg.count("n")])).select("s", F.col("top").cast("int").alias("top"), "n")


# joins


@query("""SELECT e.event_id, s.event_id AS last_signup FROM (SELECT * FROM events WHERE event_type = 'purchase') e
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') s ON e.user_id = s.user_id AND e.ts >= s.ts""")
def join_as_of_buckets(spark, d):
    events = rel(spark, d, "events")
    signups = events.filter("event_type = 'signup'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("last_signup"))
    left = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return joins.as_of(left, signups, ["user_id"], "ts", "at", ["last_signup"], bucket_seconds=86_400).select("event_id", "last_signup")


_LONG = "SELECT n_nationkey AS lo, n_nationkey + CASE WHEN n_nationkey % 5 = 0 THEN 3000 ELSE 2 END AS hi, n_name FROM nation"


@query(f"SELECT l_orderkey, l_linenumber, n_name FROM lineitem LEFT JOIN ({_LONG}) ON l_partkey BETWEEN lo AND hi")
def interval_join_long(spark, d):
    nation = rel(spark, d, "nation")
    long = nation.select(F.col("n_nationkey").alias("lo"), (F.col("n_nationkey") + F.when(F.col("n_nationkey") % 5 == 0, 3000).otherwise(2)).alias("hi"), "n_name")
    return joins.interval_join(rel(spark, d, "lineitem"), "l_partkey", long, "lo", "hi", 2.0, keep_missing=True).select("l_orderkey", "l_linenumber", "n_name")


# functions


@query("""SELECT l_orderkey, l_linenumber, CAST(pow(l_linenumber, 3) AS DOUBLE) AS cube, CAST(l_linenumber << 3 AS INT) AS up, CAST(l_orderkey >> 2 AS BIGINT) AS down,
CAST(~l_linenumber AS INT) AS flipped, l_linenumber IS NULL AS lacks, CASE WHEN l_quantity > 25 THEN 'big' ELSE 'small' END AS size FROM lineitem""")
def bit_functions(spark, d):
    source = """
        li = LOAD lineitem;
        f = FOREACH li GENERATE cube : DOUBLE = POW(l_linenumber, 3), up : INT = l_linenumber << 3, down : BIGINT = l_orderkey >> 2,
            flipped : INT = ~l_linenumber, lacks = IsNull(l_linenumber), size = l_quantity > 25 ? "big" : "small";
    """
    return planned(spark, d, source).frame("f").select("l_orderkey", "l_linenumber", "cube", "up", "down", "flipped", "lacks", "size")


@query("SELECT count(DISTINCT o_custkey) AS hashes, count(*) AS n FROM orders")
def hash_function(spark, d):
    orders = rel(spark, d, "orders")
    return orders.agg(F.count_distinct(maths.hashed(F.col("o_custkey"))).alias("hashes"), F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS of_text, CAST(o_orderdate AS DATE) AS of_julian, CAST(o_orderdate AS DATE) AS of_day,
CAST(floor(epoch(CAST(o_orderdate AS TIMESTAMP)) / 60) AS BIGINT) AS minutes, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 90 SECOND AS later,
CAST(month(o_orderdate) BETWEEN 1 AND 12 AS BOOLEAN) AS valid FROM orders""")
def date_constructors(spark, d):
    o = rel(spark, d, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    day, ts = F.col("day"), F.col("o_orderdate").cast("timestamp")
    return o.select(
        "o_orderkey", dates.date_of_text(F.date_format(day, "yyyy/MM/dd")).alias("of_text"), dates.date_of_julian(dates.julian_day(day)).alias("of_julian"),
        dates.date_of(dates.year(day), dates.day_of_year(day)).alias("of_day"), dates.as_minutes(ts).alias("minutes"),
        dates.plus_seconds(ts, F.lit(90)).alias("later"), dates.date_of_text(F.date_format(day, "yyyy/MM/dd")).isNotNull().alias("valid"),
    )


@query("""SELECT event_id, make_timestamp(epoch_us(ts) - epoch_us(ts) % 1000000) AS whole, CAST(hour(ts) AS INT) AS h, CAST(minute(ts) AS INT) AS m, CAST(second(ts) AS INT) AS s,
CAST(hour(ts) * 60 + minute(ts) AS INT) AS minutes FROM events""")
def time_functions(spark, d):
    ts = F.col("ts").cast("timestamp")
    parts = dates.time_parts(dates.time_of(ts))
    minutes = (dates.time_as(dates.time_of(ts), "seconds") / 60).cast("int")
    return rel(spark, d, "events").select("event_id", dates.datetime_of_int(dates.as_seconds(ts)).alias("whole"), parts["hour"].alias("h"), parts["minute"].alias("m"), parts["second"].alias("s"), minutes.alias("minutes"))


@query("""SELECT k, CAST(make_timestamp(2024, m, 1, 12, 0, 0) AS TIMESTAMP) AS at, m BETWEEN 4 AND 10 AS summer
FROM (SELECT n_nationkey AS k, 1 + n_nationkey % 12 AS m FROM nation)""")
def daylight_saving(spark, d):
    at = F.make_timestamp(F.lit(2024), 1 + F.col("n_nationkey") % 12, F.lit(1), F.lit(12), F.lit(0), F.lit(0))
    return rel(spark, d, "nation").select(F.col("n_nationkey").alias("k"), at.alias("at"), dates.is_dst(at, "Europe/Berlin").alias("summer"))


@query("SELECT n_nationkey, n_regionkey % 2 = 1 AS even_set, CAST(CASE WHEN n_regionkey % 2 = 1 THEN 5 ELSE 2 END AS BIGINT) AS mask, 3 AS size FROM nation")
def set_masks(spark, d):
    names = F.when(F.col("n_regionkey") % 2 == 1, F.array(F.lit("a"), F.lit("c"))).otherwise(F.array(F.lit("b")))
    mask = arrays.set_mask(names, ["a", "b", "c"])
    viewed = arrays.size(arrays.view(F.array("n_nationkey", "n_regionkey", F.lit(1))))
    return rel(spark, d, "nation").select("n_nationkey", arrays.named_bits(mask, ["a", "b", "c"])["a"].alias("even_set"), mask.alias("mask"), viewed.alias("size"))


@query("SELECT n_nationkey, CAST(n_nationkey * n_nationkey AS BIGINT) AS squared, CAST(2 * n_nationkey + n_regionkey AS BIGINT) AS joined FROM nation")
def user_functions(spark, d):
    source = "n = LOAD nation; f = FOREACH n GENERATE squared : BIGINT = UDF:Square(n_nationkey), joined : BIGINT = n_nationkey ^ n_regionkey;"
    p = planned(spark, d, source, functions={"Square": lambda c: c * c}, operators={"^": lambda a, b: a * 2 + b})
    return p.frame("f").select("n_nationkey", "squared", "joined")


# sources, sinks and relations


@query("SELECT n_nationkey, n_name FROM nation")
def program_text_loader(spark, d):
    path = _scratch(spark, "text")
    rel(spark, d, "nation").select(F.concat_ws("|", "n_nationkey", "n_name", F.lit("")).alias("value")).write.text(path)
    p = planned(spark, d, f"n = TEXTLOADER FILE '{path}' SEPARATOR '|' ATTRIBUTES n_nationkey : INT, n_name : STRING;", relations=tables.Relations(spark, path))
    return p.frame("n")


@query("SELECT l_returnflag, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q FROM lineitem GROUP BY 1")
def program_parameter_file(spark, d):
    path = _scratch(spark, "parameters")
    spark.range(1).select(F.lit('{"group": ["l_returnflag"]}').alias("value")).coalesce(1).write.text(path)
    p = Planner(lambda name: rel(spark, d, name), tables.Relations(spark, path))
    p.aggregates["Grouped"] = lambda inputs, outputs, group: agg.group_by(group, agg.sums({outputs[-1]: inputs[-1]}))
    source = f"""
        li = LOAD lineitem;
        b = FOREACH li GENERATE q : BIGINT = l_quantity;
        g = GLA:Grouped PARAMETERS FILE '{path}' FROM b USING l_returnflag, q AS l_returnflag, q;
    """
    return p.run(source)["g"]


@query("""SELECT '["' || n_nationkey || '","' || n_name || '"]' AS line FROM nation
UNION ALL SELECT '{"types":[{"name":"n_nationkey","type":"int"},{"name":"n_name","type":"string"}]}'""")
def program_print_json(spark, d):
    source = "n = LOAD nation; k = FOREACH n GENERATE key : INT = n_nationkey; PRINT k USING key, n_name AS 'json' HEADER n_nationkey, n_name;"
    return planned(spark, d, source).printed[0]


@query("SELECT 12 AS n")
def program_limit(spark, d):
    source = "n = LOAD nation; PRINT n USING n_name AS 'csv' LIMIT 12;"
    return planned(spark, d, source).printed[0].agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey BETWEEN 50 AND 120")
def program_cluster(spark, d):
    stored = tables.Relations(spark, _scratch(spark, "relations"))
    stored.store(rel(spark, d, "orders").select("o_orderkey", "o_custkey"), "own", overwrite=True)
    p = Planner(stored.load, stored)
    return p.run("CLUSTER own BY o_custkey; r = LOAD own FILTER RANGE 50, 120;")["r"]


@query("SELECT CAST(25 AS BIGINT) AS kept, CAST(0 AS BIGINT) AS emptied, true AS gone")
def program_delete(spark, d):
    stored = tables.Relations(spark, _scratch(spark, "relations"))
    nation = rel(spark, d, "nation")
    for name in ("a", "b"):
        stored.store(nation, name, overwrite=True)
    p = Planner(stored.load, stored)
    out = p.run("k = LOAD b; c = CACHE k; m = COMPACT c; n = GLA:Count FROM m AS kept; DELETE CONTENT a; e = LOAD a; z = GLA:Count FROM e AS emptied;")
    kept = out["n"].first().kept
    emptied = out["z"].first().emptied
    out["c"].unpersist()
    p.run("DELETE RELATION b;")
    return spark.createDataFrame([(kept, emptied, not stored.known("b"))], "kept long, emptied long, gone boolean")


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN NULL ELSE 'say \"' || n_name || '\", so' END AS said FROM nation WHERE n_nationkey < 20")
def csv_options(spark, d):
    """Quotes, escapes, null texts, a header to skip, a limit for each file, and carriage returns."""
    path = _scratch(spark, "csv")
    said = F.when(F.col("n_regionkey") == 1, "none").otherwise(F.concat(F.lit("'say \""), "n_name", F.lit("\", so'")))
    line = F.concat(F.col("n_nationkey").cast("string"), F.lit(","), said, F.lit("\r"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("line")))), lambda x: x["line"])
    rel(spark, d, "nation").agg(F.concat_ws("\n", F.lit("key,said\r"), lines).alias("value")).write.text(path)
    return csv.read_csv(spark, path, [("n_nationkey", "INT"), ("said", "STRING")], quote="'", skip=1, n=20, trim_cr=True, nullable={"said": "none"})


@query("SELECT CAST(167772160 + n_nationkey AS BIGINT) AS ip, CAST(n_regionkey AS INT) AS flow FROM nation")
def netflow(spark, d):
    path = _scratch(spark, "flows")
    rel(spark, d, "nation").select(F.concat(F.lit("10.0.0."), "n_nationkey", F.lit(","), "n_regionkey").alias("value")).write.text(path)
    return csv.read_netflow(spark, path)


@query("SELECT n_name, CAST(n_regionkey AS INT) AS r, CAST(n_nationkey * 256 AS BIGINT) AS net FROM nation")
def file_print(spark, d):
    """A printed file with a header, read again with its line numbers left out."""
    path = _scratch(spark, "printed")
    nation = rel(spark, d, "nation")
    sinks.print_to(nation, {"n": F.col("n_name"), "r": F.col("n_regionkey"), "ip": network.ipv4_text(F.col("n_nationkey").cast("long") * 256 + 7)}, path, header=True, sep="\t", single=True)
    back = csv.read_csv(spark, path, [("n_name", "STRING"), ("r", "INT"), ("ip", "IPV4ADDR")], sep="tab", skip=1)
    return back.select("n_name", "r", network.domain(F.col("ip")).alias("net"))


@query("SELECT s_suppkey, s_name FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 5")
def order_limit(spark, d):
    return ranking.order_by(rel(spark, d, "supplier"), {"s_acctbal": "-", "s_suppkey": "+"}, 5).select("s_suppkey", "s_name")


# results that vary within bounds, as statements about them that hold


@query("SELECT true AS hyper_log_log, true AS linear_counting, true AS sample")
def estimates_are_close(spark, d):
    """Sketches within 5 and 2 % of the exact number, and a sample of a tenth within a quarter of its size."""
    from lattica.catalog import QUERIES

    li = rel(spark, d, "lineitem")
    exact, n = li.agg(F.count_distinct("l_orderkey"), F.count(F.lit(1))).first()
    close = lambda value, wanted, off: abs(value - wanted) <= off * wanted
    found = [QUERIES[name](spark, d) for name in ("hyper_log_log", "linear_counting", "bernoulli")]
    row = (close(found[0].first()[0], exact, 0.05), close(found[1].first()[0], exact, 0.02), close(found[2].count(), 0.1 * n, 0.25))
    return spark.createDataFrame([row], "hyper_log_log boolean, linear_counting boolean, sample boolean")


@query("SELECT count(*) AS n FROM lineitem")
def chunk_count_total(spark, d):
    chunks = agg.evaluate(rel(spark, d, "lineitem"), agg.chunk_count())
    return chunks.agg(F.sum(F.col("tuples") * F.col("chunks")).alias("n"))


@query("SELECT CAST(2000 AS BIGINT) AS n, true AS spread")
def cluster_gen_total(spark, d):
    """Two clusters of a thousand rows; the second one's coordinates are positive, the first one's aren't all."""
    from lattica.catalog import QUERIES

    own = QUERIES["cluster_gen"](spark, d)
    return own.agg(F.count(F.lit(1)).alias("n"), ((F.min("x") < 0) & (F.max("x") > 0)).alias("spread"))


@query("SELECT CAST(800 AS BIGINT) AS n, CAST(0 AS BIGINT) AS outside, true AS both")
def program_cluster_gen(spark, d):
    """Uniform rows around two centres: none lies outside them, and both are hit."""
    source = """
        g = READ USING GI:ClusterGen<n = 800, centers = [uniform(0, 1), uniform(5, 6)], seed = 3> ATTRIBUTES x : DOUBLE, y : DOUBLE;
    """
    low = F.col("x").between(0, 1) & F.col("y").between(0, 1)
    high = F.col("x").between(5, 6) & F.col("y").between(5, 6)
    g = Planner(lambda name: rel(spark, d, name), tables.Relations(spark, _scratch(spark, "none"))).run(source)["g"]
    return g.agg(F.count(F.lit(1)).alias("n"), F.count_if(~low & ~high).alias("outside"), ((F.count_if(low) > 100) & (F.count_if(high) > 100)).alias("both"))


@query("SELECT 0 AS gradient")
def logistic_regression_gradient(spark, d):
    """The likelihood's gradient at the coefficients found, for each row and rounded to six digits."""
    own = rel(spark, d, "lineitem").select((F.col("l_quantity") / 50 - 0.5).alias("q"), F.when(F.col("l_extendedprice") > 50000, 1).otherwise(-1).alias("y"))
    b = float(iterate.logistic_regression(own, ["q"], "y", 12)[0])
    gradient = F.avg(F.col("q") * (F.when(F.col("y") > 0, 1.0).otherwise(0.0) - 1 / (1 + F.exp(-b * F.col("q")))))
    return own.agg(F.round(gradient * 1_000_000).cast("int").alias("gradient"))
