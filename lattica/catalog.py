"""Registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica import plans
from lattica.functions import arrays, categories, dates, geo, maths, network, text
from lattica.operators import aggregates as agg
from lattica.operators import filters, iterate, joins, ranking, transforms
from lattica.sources import generators, sinks, tables
from lattica.streaming import sessions, sliding, tumbling

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rel(spark: SparkSession, sf_dir: str, name: str, **options) -> DataFrame:
    return tables.load(spark, f"{sf_dir}/{name}.parquet", **options)


def money(c: str | Column) -> Column:
    """Exact sum of amounts, as double: decimal addition doesn't depend on the order of rows."""
    c = F.col(c) if isinstance(c, str) else c
    return F.sum(c.cast("decimal(18,4)")).cast("double")


def mean(c: str | Column) -> Column:
    return money(c) / F.count(F.lit(1))


def day(s: str) -> Column:
    return F.lit(s).cast("timestamp")


# scans, filters, derived columns


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def scan_project(spark, d):
    return rel(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 500 OR o_orderkey >= 14000")
def load_range(spark, d):
    return rel(spark, d, "orders", ranges=[(100, 500), (14000, None)], on="o_orderkey").select("o_orderkey", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 10 AND l_discount > 0.05 AND l_returnflag = 'R'")
def filter_conj(spark, d):
    return filters.filter_by(rel(spark, d, "lineitem"), F.col("l_quantity") < 10, F.col("l_discount") > 0.05, F.col("l_returnflag") == "R").select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, CAST(l_quantity AS BIGINT) AS whole FROM lineitem")
def foreach_generate(spark, d):
    out = filters.generate(rel(spark, d, "lineitem"), {"net": F.col("l_extendedprice") * (1 - F.col("l_discount")), "whole": F.col("l_quantity")}, {"whole": "BIGINT"})
    return out.select("l_orderkey", "l_linenumber", "net", "whole")


@query("SELECT p_partkey FROM part WHERE regexp_matches(p_type, 'PROMO|SMALL')")
def filter_pattern(spark, d):
    return filters.pattern(rel(spark, d, "part"), "p_type", "PROMO|SMALL").select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_retailprice > (SELECT avg(CAST(p_retailprice AS DECIMAL(18,4))) FROM part)")
def filter_state(spark, d):
    part = rel(spark, d, "part")
    state = part.agg((money("p_retailprice") / F.count(F.lit(1))).alias("mean_price"))
    return filters.filter_with(part, lambda price: price > F.col("mean_price"), "p_retailprice", states=[state]).select("p_partkey")


@query()
def bernoulli(spark, d):
    return filters.bernoulli(rel(spark, d, "lineitem"), 0.1, 7, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber")


@query("SELECT p_partkey, p_size IN (1, 5, 9, 49) AS picked FROM part")
def contains(spark, d):
    return rel(spark, d, "part").select("p_partkey", maths.among(F.col("p_size"), [1, 5, 9, 49]).alias("picked"))


@query("SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 1 WHEN 'SMALL' THEN 2 ELSE 0 END AS code FROM part")
def case_simple(spark, d):
    return rel(spark, d, "part").select("p_partkey", maths.case_of(F.col("p_type"), [(F.lit("PROMO"), F.lit(1)), (F.lit("SMALL"), F.lit(2))], F.lit(0)).alias("code"))


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS class FROM part")
def case_searched(spark, d):
    size = F.col("p_size")
    return rel(spark, d, "part").select("p_partkey", maths.case_when([(size < 10, F.lit("small")), (size < 30, F.lit("medium"))], F.lit("large")).alias("class"))


# aggregates


@query("SELECT count(*) AS count FROM lineitem")
def agg_count(spark, d):
    return agg.evaluate(rel(spark, d, "lineitem"), agg.count())


@query("SELECT CAST(sum(l_linenumber) AS BIGINT) AS lines, CAST(sum(CAST(l_returnflag = 'R' AS INT)) AS BIGINT) AS returned FROM lineitem")
def agg_sum(spark, d):
    own = rel(spark, d, "lineitem").withColumn("is_r", F.col("l_returnflag") == "R")
    return agg.evaluate(own, agg.sums({"lines": "l_linenumber", "returned": "is_r"}))


@query("SELECT avg(l_linenumber) AS line, avg(l_orderkey) AS orderkey FROM lineitem")
def agg_avg(spark, d):
    return agg.evaluate(rel(spark, d, "lineitem"), agg.averages({"line": "l_linenumber", "orderkey": "l_orderkey"}))


@query("SELECT min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem")
def agg_minmax(spark, d):
    return agg.evaluate(rel(spark, d, "lineitem"), agg.multiplex([agg.minima({"first_ship": "l_shipdate", "low": "l_extendedprice"}), agg.maxima({"last_ship": "l_shipdate", "high": "l_extendedprice"})]))


@query("SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines, count(DISTINCT l_suppkey) AS suppliers, max(l_quantity) AS most FROM lineitem")
def agg_multi(spark, d):
    parts = [agg.count("n"), agg.sums({"lines": "l_linenumber"}), agg.count_distinct(["l_suppkey"], "suppliers"), agg.maxima({"most": "l_quantity"})]
    return agg.evaluate(rel(spark, d, "lineitem"), agg.multiplex(parts))


@query("SELECT o_orderpriority, count(*) AS n, max(o_totalprice) AS most FROM orders GROUP BY 1")
def group_by(spark, d):
    return agg.evaluate(rel(spark, d, "orders"), agg.group_by(["o_orderpriority"], agg.multiplex([agg.count("n"), agg.maxima({"most": "o_totalprice"})])))


@query("SELECT o_orderstatus AS status, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def group_by_nested(spark, d):
    return agg.evaluate(rel(spark, d, "orders"), agg.group_by({"o_orderstatus": "status"}, agg.group_by(["o_orderpriority"], agg.count("n"))))


@query("SELECT o_custkey, o_orderkey, o_totalprice, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def group_topn(spark, d):
    out = agg.evaluate(rel(spark, d, "orders"), agg.group_by(["o_custkey"], agg.order_by({"o_totalprice": "DESC", "o_orderkey": "ASC"}, 3, "rank")))
    return out.select("o_custkey", "o_orderkey", "o_totalprice", "rank")


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct(spark, d):
    return agg.evaluate(rel(spark, d, "orders"), agg.distinct(["o_orderstatus", "o_orderpriority"]))


@query("SELECT count(*) AS count FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)")
def count_distinct(spark, d):
    return agg.evaluate(rel(spark, d, "lineitem"), agg.count_distinct(["l_partkey", "l_suppkey"]))


@query("SELECT l_returnflag, count(*) AS frequency FROM lineitem GROUP BY 1")
def frequencies(spark, d):
    return agg.evaluate(rel(spark, d, "lineitem"), agg.frequencies("l_returnflag"))


@query("SELECT p_partkey, p_retailprice, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part")
def order_by_rank(spark, d):
    return ranking.order_by(rel(spark, d, "part").select("p_partkey", "p_retailprice"), {"p_retailprice": "DESC", "p_partkey": "ASC"}, rank="rank")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk(spark, d):
    return ranking.top_k(rel(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 25, ["o_orderkey"])


@query("SELECT p_partkey, p_size, p_type FROM part WHERE p_size = (SELECT max(p_size) FROM part) AND p_type = (SELECT min(p_type) FROM part WHERE p_size = (SELECT max(p_size) FROM part))")
def extreme_tuples(spark, d):
    return ranking.extreme_tuples(rel(spark, d, "part").select("p_partkey", "p_size", "p_type"), {"p_size": "MAX", "p_type": "MIN"})


@query("SELECT p_brand, p_partkey, p_size FROM (SELECT *, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS r FROM part) WHERE r = 1")
def group_extremes(spark, d):
    return agg.evaluate(rel(spark, d, "part"), agg.group_by(["p_brand"], agg.extreme_tuples({"p_size": "MAX"}))).select("p_brand", "p_partkey", "p_size")


@query("SELECT n_regionkey, n_name FROM nation")
def gather(spark, d):
    return agg.evaluate(rel(spark, d, "nation"), agg.group_by(["n_regionkey"], agg.gather(["n_name"])))


@query("SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1")
def segmenter(spark, d):
    return agg.evaluate(rel(spark, d, "lineitem"), agg.segment("l_suppkey", agg.group_by(["l_suppkey"], agg.count("n"))))


@query("""WITH a AS (SELECT o_orderstatus, count(*) AS n, row_number() OVER (ORDER BY o_orderstatus) AS p FROM orders GROUP BY 1),
b AS (SELECT o_orderpriority, row_number() OVER (ORDER BY o_orderpriority) AS p FROM (SELECT DISTINCT o_orderpriority FROM orders))
SELECT o_orderstatus, n, o_orderpriority FROM b JOIN a ON a.p = least(b.p, (SELECT max(p) FROM a))""")
def multiplex_rows(spark, d):
    """Parts of different lengths: three statuses beside five priorities, the last status repeated."""
    parts = [agg.group_by(["o_orderstatus"], agg.count("n")), agg.distinct(["o_orderpriority"])]
    return agg.evaluate(rel(spark, d, "orders"), agg.multiplex(parts))


@query("SELECT CAST(least(9, floor(l_quantity / 5)) AS INT) AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def histogram(spark, d):
    return agg.evaluate(rel(spark, d, "lineitem"), agg.histogram("l_quantity", 0, 50, 10))


@query()
def hyper_log_log(spark, d):
    return agg.evaluate(rel(spark, d, "lineitem"), agg.hyper_log_log("l_orderkey"))


@query()
def linear_counting(spark, d):
    return agg.evaluate(rel(spark, d, "lineitem"), agg.linear_counting(["l_orderkey"], exponent=18))


@query()
def chunk_count(spark, d):
    return agg.evaluate(rel(spark, d, "lineitem"), agg.chunk_count())


@query("SELECT l_returnflag, avg(l_linenumber) AS mean FROM lineitem GROUP BY 1")
def user_aggregate(spark, d):
    own = agg.UserAggregate(lambda: (0, 0), lambda s, x: (s[0] + x, s[1] + 1), lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda s: [(s[0] / s[1],)] if s[1] else [], ["l_linenumber"], "mean double")
    return agg.evaluate(rel(spark, d, "lineitem"), agg.group_by(["l_returnflag"], own))


# joins


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(spark, d):
    return joins.inner(rel(spark, d, "orders"), ["o_custkey"], rel(spark, d, "customer"), ["c_custkey"]).select("o_orderkey", "c_name")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 150000) ON c_custkey = o_custkey")
def join_left(spark, d):
    return joins.left_outer(rel(spark, d, "customer"), ["c_custkey"], rel(spark, d, "orders").filter("o_totalprice > 150000"), ["o_custkey"]).select("c_custkey", "o_orderkey")


_BIG = "SELECT o_custkey FROM orders WHERE o_totalprice > 300000 AND o_orderstatus = 'F'"


def _big(spark, d):
    return filters.filter_by(rel(spark, d, "orders"), F.col("o_totalprice") > 300000, F.col("o_orderstatus") == "F")


@query(f"SELECT c_custkey, c_name FROM customer WHERE c_custkey IN ({_BIG})")
def join_in(spark, d):
    return joins.exists_in(rel(spark, d, "customer"), ["c_custkey"], _big(spark, d), ["o_custkey"]).select("c_custkey", "c_name")


@query(f"SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN ({_BIG})")
def join_not_in(spark, d):
    return joins.not_exists_in(rel(spark, d, "customer"), ["c_custkey"], _big(spark, d), ["o_custkey"]).select("c_custkey", "c_name")


@query("SELECT a.l_orderkey, a.l_linenumber AS line, b.l_linenumber AS other FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey")
def join_multi_key(spark, d):
    a = rel(spark, d, "lineitem").select("l_orderkey", "l_suppkey", F.col("l_linenumber").alias("line"))
    b = rel(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_suppkey").alias("s"), F.col("l_linenumber").alias("other"))
    return joins.inner(a, ["l_orderkey", "l_suppkey"], b, ["o", "s"]).select("l_orderkey", "line", "other")


@query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def join_state(spark, d):
    return joins.with_state(rel(spark, d, "supplier"), ["s_nationkey"], rel(spark, d, "nation"), ["n_nationkey"]).select("s_suppkey", "n_name")


_BANDS = [(1.0, 10.0, "low"), (11.0, 20.0, "middle"), (21.0, 40.0, "high")]
_BANDS_SQL = "(VALUES (1.0, 10.0, 'low'), (11.0, 20.0, 'middle'), (21.0, 40.0, 'high')) AS b(lo, hi, band)"


@query(f"SELECT l_orderkey, l_linenumber, band FROM lineitem JOIN {_BANDS_SQL} ON l_quantity BETWEEN lo AND hi")
def interval_join(spark, d):
    bands = spark.createDataFrame(_BANDS, "lo double, hi double, band string")
    return joins.interval_join(rel(spark, d, "lineitem"), "l_quantity", bands, "lo", "hi", 10.0).select("l_orderkey", "l_linenumber", "band")


@query(f"SELECT l_orderkey, l_linenumber, band FROM lineitem LEFT JOIN {_BANDS_SQL} ON l_quantity BETWEEN lo AND hi")
def interval_join_keep(spark, d):
    bands = spark.createDataFrame(_BANDS, "lo double, hi double, band string")
    return joins.interval_join(rel(spark, d, "lineitem"), "l_quantity", bands, "lo", "hi", 10.0, keep_missing=True).select("l_orderkey", "l_linenumber", "band")


_SPANS = "SELECT user_id AS u, min(ts) AS lo, max(ts) AS hi FROM events WHERE event_type = 'click' GROUP BY 1"


def _spans(spark, d):
    clicks = rel(spark, d, "events").filter("event_type = 'click'")
    return clicks.groupBy(F.col("user_id").alias("u")).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))


@query(f"SELECT event_id, lo FROM events JOIN ({_SPANS}) ON user_id = u AND ts >= lo AND ts < hi")
def group_interval_join(spark, d):
    return joins.group_interval_join(rel(spark, d, "events"), ["user_id"], "ts", _spans(spark, d), ["u"], "lo", "hi").select("event_id", "lo")


@query(f"WITH s AS ({_SPANS}) SELECT event_id, lo FROM (SELECT * FROM events WHERE user_id IN (SELECT u FROM s)) LEFT JOIN s ON user_id = u AND ts >= lo AND ts < hi")
def group_interval_join_keep(spark, d):
    return joins.group_interval_join(rel(spark, d, "events"), ["user_id"], "ts", _spans(spark, d), ["u"], "lo", "hi", keep_missing=True).select("event_id", "lo")


@query("""SELECT e.event_id, s.event_id AS last_signup FROM (SELECT * FROM events WHERE event_type = 'purchase') e
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') s ON e.user_id = s.user_id AND e.ts >= s.ts""")
def join_as_of(spark, d):
    events = rel(spark, d, "events")
    signups = events.filter("event_type = 'signup'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("last_signup"))
    return joins.as_of(events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), signups, ["user_id"], "ts", "at", ["last_signup"]).select("event_id", "last_signup")


# transforms


@query("SELECT n_nationkey, CAST(n_nationkey + k AS INT) AS next FROM nation, generate_series(0, 6, 2) AS g(k)")
def range_gt(spark, d):
    return transforms.value_range(rel(spark, d, "nation"), {"next": "n_nationkey"}, 6, 2).select("n_nationkey", "next")


@query("SELECT p_partkey, CAST(k AS INT) AS k FROM part, LATERAL (SELECT unnest(generate_series(least(p_size, 5), greatest(p_size, 5) - 1)) AS k)")
def interval_to_discrete(spark, d):
    own = rel(spark, d, "part").withColumn("five", F.lit(5))
    return transforms.interval_to_discrete(own, "p_size", "five", "k", inclusive=False).select("p_partkey", "k")


@query("""WITH a AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS run FROM a)
SELECT user_id, run, event_type, count(*) AS n FROM b GROUP BY 1, 2, 3""")
def streaming_group_by(spark, d):
    return transforms.runs(rel(spark, d, "events"), "event_type", agg.count("n"), ["ts", "event_id"], ["user_id"])


@query("SELECT c_custkey, c_acctbal * 9 / 5 + 32 AS converted FROM customer WHERE c_acctbal > 0")
def single_transform(spark, d):
    return transforms.apply_single(rel(spark, d, "customer"), {"converted": F.col("c_acctbal") * 9 / 5 + 32}, F.col("c_acctbal") > 0).select("c_custkey", "converted")


@query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def multi_transform(spark, d):
    words = F.transform(F.split("p_name", " "), lambda w: F.struct(w.alias("word")))
    return transforms.apply_multi(rel(spark, d, "part"), words, ["word"]).select("p_partkey", "word")


# scalars


@query("""SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(quarter(o_orderdate) AS INT) AS q, CAST(month(o_orderdate) AS INT) AS m, CAST(day(o_orderdate) AS INT) AS dd,
CAST(dayofyear(o_orderdate) AS INT) AS doy, CAST(week(o_orderdate) AS INT) AS w, CAST(isoyear(o_orderdate) AS INT) AS wy, CAST(isodow(o_orderdate) AS INT) AS dow,
CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 2440588 AS INT) AS julian, year(o_orderdate) % 4 = 0 AS leap, CAST(day(last_day(o_orderdate)) AS INT) AS dim FROM orders""")
def date_parts(spark, d):
    x = dates.date_of(F.col("o_orderdate"))
    parts = {"y": dates.year(x), "q": dates.quarter(x), "m": dates.month(x), "dd": dates.day(x), "doy": dates.day_of_year(x), "w": dates.week_of_year(x), "wy": dates.week_year(x), "dow": dates.day_of_week(x), "julian": dates.julian_day(x), "leap": dates.is_leap_year(x), "dim": dates.days_in_month(x)}
    return rel(spark, d, "orders").select("o_orderkey", *[c.alias(n) for n, c in parts.items()])


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) + 45 AS later, CAST(o_orderdate AS DATE) - 10 AS earlier, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INT) AS since,
make_date(CAST(year(o_orderdate) AS INT), 1, 1) + 99 AS hundredth FROM orders""")
def date_arith(spark, d):
    x = dates.date_of(F.col("o_orderdate"))
    first = dates.date_of(F.lit(1995), F.lit(1), F.lit(1))
    return rel(spark, d, "orders").select("o_orderkey", dates.add_days(x, F.lit(45)).alias("later"), dates.sub_days(x, F.lit(10)).alias("earlier"), dates.days_between(x, first).alias("since"), dates.date_of(dates.year(x), F.lit(100)).alias("hundredth"))


@query("""SELECT event_id, CAST(hour(ts) AS INT) AS h, CAST(minute(ts) AS INT) AS mi, CAST(second(ts) AS INT) AS s, CAST(floor(epoch(ts)) AS BIGINT) AS secs, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hours,
CAST(floor(epoch(ts) / 86400) AS BIGINT) AS days, date_trunc('month', ts)::TIMESTAMP AS mon, CAST(floor(epoch(ts)) AS BIGINT) - CAST(epoch(TIMESTAMP '2024-01-01') AS BIGINT) AS since,
CAST(epoch_us(ts) % 86400000000 // 1000 AS INT) AS tod, CAST(epoch_us(ts) % 86400000000 // 60000000 AS INT) AS tod_minutes FROM events""")
def datetime_trunc(spark, d):
    ts = F.col("ts")
    cols = {"h": dates.hour(ts), "mi": dates.minute(ts), "s": dates.second(ts), "secs": dates.as_seconds(ts), "hours": dates.as_hours(ts), "days": dates.as_days(ts), "mon": dates.by_month(ts), "since": dates.seconds_between(ts, day("2024-01-01")), "tod": dates.time_of(ts), "tod_minutes": dates.time_as(dates.time_of(ts), "minutes")}
    return rel(spark, d, "events").select("event_id", *[c.alias(n) for n, c in cols.items()])


@query("""SELECT l_orderkey, l_linenumber, CAST((l_linenumber - 4) // 2 AS BIGINT) AS q, CAST((l_linenumber - 4) % 3 AS INT) AS r, l_linenumber / 2 AS half, l_linenumber & 5 AS a, l_linenumber | 8 AS o, xor(l_linenumber, 3) AS x,
abs(l_linenumber - 4) AS ab, sqrt(l_quantity) AS sq, CAST(l_linenumber AS VARCHAR) AS txt FROM lineitem""")
def int_ops(spark, d):
    n = F.col("l_linenumber")
    cols = {"q": maths.quotient(n - 4, F.lit(2)), "r": maths.remainder(n - 4, F.lit(3)), "half": maths.divide(n, F.lit(2)), "a": maths.bit_and(n, F.lit(5)), "o": maths.bit_or(n, F.lit(8)), "x": maths.bit_xor(n, F.lit(3)), "ab": maths.absolute(n - 4), "sq": maths.root(F.col("l_quantity")), "txt": text.to_string(n)}
    return rel(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[c.alias(k) for k, c in cols.items()])


@query("SELECT p_partkey, regexp_matches(p_type, '^S') AS m, p_name LIKE '%e_%' AS l, CAST(octet_length(encode(p_name)) AS INT) AS n, CAST(ascii(p_type) AS INT) AS first, substring(p_type, 3, 1) AS third FROM part")
def string_functions(spark, d):
    return rel(spark, d, "part").select("p_partkey", text.matches(F.col("p_type"), "^S").alias("m"), text.like(F.col("p_name"), "%e_%").alias("l"), text.n_bytes(F.col("p_name")).alias("n"), text.first_byte(F.col("p_type")).alias("first"), text.char_at(F.col("p_type"), 2).alias("third"))


@query("SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS front, CAST(embedding[-1] AS DOUBLE) AS back, CAST(embedding[6] AS DOUBLE) AS fifth, CAST(len(embedding) AS INT) AS n, len(embedding) = 0 AS none FROM embeddings")
def array_functions(spark, d):
    v = F.col("embedding")
    return rel(spark, d, "embeddings").select("vec_id", arrays.front(v).cast("double").alias("front"), arrays.back(v).cast("double").alias("back"), arrays.at(v, 5).cast("double").alias("fifth"), arrays.size(v).alias("n"), arrays.is_empty(v).alias("none"))


@query("SELECT p_partkey, p_size & 1 = 1 AS odd, p_size & 4 = 4 AS four, CAST(bit_count(p_size) AS INT) AS n FROM part")
def bitset(spark, d):
    b = F.col("p_size")
    named = arrays.named_bits(b, ["odd", "two", "four"])
    return rel(spark, d, "part").select("p_partkey", named["odd"].alias("odd"), named["four"].alias("four"), arrays.bits(b).alias("n"))


_SEGMENTS = {"ECONOMY": 5, "SMALL": 4, "MEDIUM": 3, "PROMO": 2}


@query("SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 5 WHEN 'SMALL' THEN 4 WHEN 'MEDIUM' THEN 3 WHEN 'PROMO' THEN 2 END AS id, p_type IN ('ECONOMY', 'SMALL', 'MEDIUM', 'PROMO') AS valid FROM part")
def category(spark, d):
    return rel(spark, d, "part").select("p_partkey", categories.category_id(F.col("p_type"), _SEGMENTS).alias("id"), categories.is_valid(F.col("p_type"), _SEGMENTS).alias("valid"))


@query("SELECT p_partkey, p_type, dense_rank() OVER (ORDER BY p_type) - 1 AS id FROM part")
def factor(spark, d):
    return categories.factor(rel(spark, d, "part").select("p_partkey", "p_type"), "p_type")[0].select("p_partkey", "p_type", "id")


@query("""SELECT s_suppkey, round(2 * 6371.0 * asin(sqrt(pow(sin((radians(s_suppkey % 90) - radians(48.0)) / 2), 2)
+ cos(radians(48.0)) * cos(radians(s_suppkey % 90)) * pow(sin((radians(s_nationkey * 5) - radians(2.0)) / 2), 2))), 6) AS km FROM supplier""")
def haversine(spark, d):
    here = geo.location(F.lit(48.0), F.lit(2.0))
    there = geo.location((F.col("s_suppkey") % 90).cast("double"), (F.col("s_nationkey") * 5).cast("double"))
    return rel(spark, d, "supplier").select("s_suppkey", F.round(geo.haversine(here, there), 6).alias("km"))


@query("SELECT user_id, 167772160 + user_id AS ip, 167772160 + user_id - (167772160 + user_id) % 256 AS net, concat('10.', user_id // 65536, '.', user_id // 256 % 256, '.', user_id % 256) AS dotted FROM events")
def ipv4_domain(spark, d):
    own = rel(spark, d, "events").withColumn("dotted", network.ipv4_text(F.col("user_id") + 167772160)).withColumn("ip", network.ipv4(F.col("dotted")))
    return own.select("user_id", "ip", network.domain(F.col("ip")).alias("net"), "dotted")


# analytic queries in the shapes that benchmark suites use


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS price,
CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS avg_qty FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-09-01' AND l_discount < 0.03 GROUP BY 1, 2""")
def pricing_summary(spark, d):
    own = filters.filter_by(rel(spark, d, "lineitem"), F.col("l_shipdate") < day("1998-09-01"), F.col("l_discount") < 0.03)
    totals = agg.Columns(lambda _: {"n": F.count(F.lit(1)), "qty": money("l_quantity"), "price": money("l_extendedprice"), "avg_qty": mean("l_quantity")})
    return agg.evaluate(own, agg.group_by(["l_returnflag", "l_linestatus"], totals))


@query("SELECT count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS total FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE p_size < 20 AND s_acctbal > 0")
def sum_three_way(spark, d):
    items = joins.inner(rel(spark, d, "lineitem"), ["l_partkey"], rel(spark, d, "part").filter("p_size < 20"), ["p_partkey"])
    both = joins.inner(items, ["l_suppkey"], rel(spark, d, "supplier").filter("s_acctbal > 0"), ["s_suppkey"])
    return both.agg(F.count(F.lit(1)).alias("n"), money("l_extendedprice").alias("total"))


@query("SELECT count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS total FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'")
def sum_two_way(spark, d):
    own = joins.inner(rel(spark, d, "customer").filter("c_mktsegment = 'BUILDING'"), ["c_custkey"], rel(spark, d, "orders"), ["o_custkey"])
    return own.agg(F.count(F.lit(1)).alias("n"), money("o_totalprice").alias("total"))


@query("SELECT n_name, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS total FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1")
def group_four_way(spark, d):
    own = joins.inner(rel(spark, d, "orders").filter(F.col("o_orderdate") < day("1997-01-01")), ["o_custkey"], rel(spark, d, "customer"), ["c_custkey"])
    own = joins.inner(rel(spark, d, "lineitem"), ["l_orderkey"], own, ["o_orderkey"])
    own = joins.with_state(own, ["c_nationkey"], rel(spark, d, "nation"), ["n_nationkey"])
    return agg.evaluate(own, agg.group_by(["n_name"], agg.Columns(lambda _: {"n": F.count(F.lit(1)), "total": money("l_extendedprice")})))


@query("SELECT DISTINCT s_suppkey, s_name FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN part ON l_partkey = p_partkey WHERE p_type = 'PROMO' AND l_quantity > 45")
def distinct_three_way(spark, d):
    items = joins.inner(rel(spark, d, "lineitem").filter("l_quantity > 45"), ["l_partkey"], rel(spark, d, "part").filter("p_type = 'PROMO'"), ["p_partkey"])
    return agg.evaluate(joins.inner(items, ["l_suppkey"], rel(spark, d, "supplier"), ["s_suppkey"]), agg.distinct(["s_suppkey", "s_name"]))


@query("""SELECT CAST(sum(CASE WHEN p_type = 'PROMO' THEN CAST(l_extendedprice AS DECIMAL(18,4)) ELSE 0 END) AS DOUBLE) AS promo, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS total
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1996-04-01'""")
def promotion_share(spark, d):
    quarter = rel(spark, d, "lineitem").filter((F.col("l_shipdate") >= day("1996-01-01")) & (F.col("l_shipdate") < day("1996-04-01")))
    own = joins.inner(quarter, ["l_partkey"], rel(spark, d, "part"), ["p_partkey"])
    promo = maths.case_when([(text.matches(F.col("p_type"), "PROMO"), F.col("l_extendedprice"))], F.lit(0.0))
    return own.agg(money(promo).alias("promo"), money("l_extendedprice").alias("total"))


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY 1")
def priority_check(spark, d):
    own = joins.exists_in(rel(spark, d, "orders").filter(F.col("o_orderdate") >= day("1996-01-01")), ["o_orderkey"], rel(spark, d, "lineitem").filter("l_returnflag = 'R'"), ["l_orderkey"])
    return agg.evaluate(own, agg.group_by(["o_orderpriority"], agg.count("n")))


@query("""SELECT o_orderkey, o_orderdate, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1996-03-15' AND l_shipdate > TIMESTAMP '1996-03-15' GROUP BY 1, 2 ORDER BY revenue DESC, o_orderkey LIMIT 10""")
def shipping_priority(spark, d):
    own = joins.exists_in(rel(spark, d, "orders").filter(F.col("o_orderdate") < day("1996-03-15")), ["o_custkey"], rel(spark, d, "customer").filter("c_mktsegment = 'BUILDING'"), ["c_custkey"])
    own = joins.inner(rel(spark, d, "lineitem").filter(F.col("l_shipdate") > day("1996-03-15")), ["l_orderkey"], own, ["o_orderkey"])
    sums = agg.evaluate(own, agg.group_by(["o_orderkey", "o_orderdate"], agg.Columns(lambda _: {"revenue": money(F.col("l_extendedprice") * (1 - F.col("l_discount")))})))
    return ranking.top_k(sums, "revenue", 10, ["o_orderkey"])


# sources, sinks, iteration, language


def _scratch(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{iterate.shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def store_append(spark, d):
    stored = tables.Relations(spark, _scratch(spark, "relations"))
    nation = rel(spark, d, "nation")
    stored.create("own", [("n_nationkey", "INT"), ("n_name", "STRING")])
    stored.store(nation, "own", {"n_nationkey": F.col("n_nationkey"), "n_name": F.col("n_name")}, overwrite=True)
    stored.store(nation.filter("n_regionkey = 1"), "own")
    return stored.load("own")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey BETWEEN 100 AND 200")
def cluster_range(spark, d):
    path = _scratch(spark, "clustered")
    sinks.cluster(rel(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", path, 8)
    return tables.load(spark, path, ranges=[(100, 200)], on="o_custkey")


@query("SELECT concat(n_nationkey, '|', n_name) AS line FROM nation")
def print_csv(spark, d):
    return sinks.printed(rel(spark, d, "nation"), {"k": F.col("n_nationkey"), "n": F.col("n_name")}, sep="|")


@query("SELECT concat('[\"', n_nationkey, '\",\"', n_name, '\"]') AS line FROM nation")
def print_json(spark, d):
    return sinks.printed(rel(spark, d, "nation"), {"k": F.col("n_nationkey"), "n": F.col("n_name")}, "json")


@query("SELECT CAST(n_nationkey AS INT) AS n_nationkey, n_name, row_number() OVER (ORDER BY n_nationkey) AS line FROM nation")
def csv_round_trip(spark, d):
    from lattica.sources.csv import read_csv

    path = _scratch(spark, "csv")
    sinks.print_to(rel(spark, d, "nation").orderBy("n_nationkey"), {"k": F.col("n_nationkey"), "n": F.col("n_name")}, path, header=True, single=True)
    return read_csv(spark, path, [("n_nationkey", "INT"), ("n_name", "STRING")], skip=1, line_number="line")


@query()
def cluster_gen(spark, d):
    s = generators.Spread
    return generators.clusters(spark, 1000, [[s("normal", (0, 1)), s("uniform", (0, 1))], [s("exponential", (2,)), s("inverse_gaussian", (1, 3))]], ["x", "y"], 1, 2)


@query()
def logistic_regression(spark, d):
    own = rel(spark, d, "lineitem").select(F.lit(1.0).alias("one"), (F.col("l_quantity") / 50).alias("q"), F.when(F.col("l_extendedprice") > 50000, 1).otherwise(-1).alias("y"))
    found = iterate.logistic_regression(own, ["one", "q"], "y")
    return spark.createDataFrame([(n, float(v)) for n, v in zip(["one", "q"], found, strict=True)], "name string, coefficient double")


@query("""WITH RECURSIVE r AS (SELECT c_custkey AS k, CAST(1 AS BIGINT) AS steps FROM customer WHERE c_custkey = 1
UNION ALL SELECT k * 2, steps + 1 FROM r WHERE k * 2 <= 1000) SELECT max(k) AS k, max(steps) AS steps FROM r""")
def iterate_state(spark, d):
    first = rel(spark, d, "customer").filter("c_custkey = 1").select(F.col("c_custkey").alias("k"), F.lit(1).cast("long").alias("steps"))
    more = F.col("k") * 2 <= 1000
    step = lambda s, n: s.select(F.when(more, F.col("k") * 2).otherwise(F.col("k")).alias("k"), (F.col("steps") + F.when(more, 1).otherwise(0)).alias("steps"))
    return iterate.iterate_state(first, step, lambda old, new, n: new.filter(more).isEmpty(), 20)


@query("""SELECT l_returnflag, count(*) AS n, max(l_extendedprice * (1 - l_discount)) AS top FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE o_orderpriority = '1-URGENT' AND l_quantity < 30 GROUP BY 1""")
def program(spark, d):
    source = f"""
        li = LOAD lineitem; o = LOAD orders;
        cheap = FILTER li BY l_quantity < 30;
        urgent = FILTER o BY o_orderpriority == "1-URGENT";
        both = JOIN cheap BY (l_orderkey), urgent BY (o_orderkey);
        net = FOREACH both GENERATE net : DOUBLE = l_extendedprice * (1 - l_discount);
        g = GLA:GroupBy<group = [l_returnflag], aggregate = GLA:Multiplexer<glas = [
              {{gla: GLA:Count, inputs: [], outputs: [n]}}, {{gla: GLA:Max, inputs: [net], outputs: [top]}}]>>
            FROM net USING l_returnflag, net AS (l_returnflag, n, top);
    """
    return plans.run(source, lambda name: rel(spark, d, name))["g"]


# streaming windows over a static frame: the same functions run on streams


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts)::TIMESTAMP AS window_start, time_bucket(INTERVAL 6 HOUR, ts)::TIMESTAMP + INTERVAL 6 HOUR AS window_end, event_type, count(*) AS n FROM events GROUP BY 1, 2, 3")
def tumbling_window(spark, d):
    return tumbling(rel(spark, d, "events"), "ts", "6 hours", ["event_type"], {"n": F.count(F.lit(1))})


@query("""SELECT w AS window_start, w + INTERVAL 2 DAY AS window_end, count(*) AS n FROM (SELECT ts, unnest([time_bucket(INTERVAL 1 DAY, ts)::TIMESTAMP, time_bucket(INTERVAL 1 DAY, ts)::TIMESTAMP - INTERVAL 1 DAY]) AS w FROM events) GROUP BY 1""")
def sliding_window(spark, d):
    return sliding(rel(spark, d, "events"), "ts", "2 days", "1 day", [], {"n": F.count(F.lit(1))})


@query("""WITH a AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM a)
SELECT min(ts) AS window_start, max(ts) + INTERVAL 12 HOUR AS window_end, user_id, count(*) AS n FROM b GROUP BY user_id, s""")
def session_windows(spark, d):
    return sessions(rel(spark, d, "events"), "ts", "12 hours", ["user_id"], {"n": F.count(F.lit(1))})


__all__ = ["ORACLES", "QUERIES", "query", "rel"]


from lattica import language_queries  # noqa: E402, F401  registers its queries here
