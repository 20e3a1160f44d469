"""Statements turned into DataFrames."""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import arrays, dates, geo, maths, network, text
from lattica.operators import aggregates as agg
from lattica.operators import filters, iterate, joins, transforms
from lattica.plans.lexer import ProgramError
from lattica.plans.parser import Functor, Statement, parse
from lattica.sources import csv, generators, sinks, tables
from lattica.types import LOGICAL

_BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "||": lambda a, b: a | b,
    "&&": lambda a, b: a & b,
    "|": maths.bit_or,
    "^": maths.bit_xor,
    "&": maths.bit_and,
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
    "<<": lambda a, b: F.call_function("shiftleft", a, b),
    ">>": lambda a, b: F.call_function("shiftright", a, b),
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": maths.divide,
    "%": maths.remainder,
    "//": maths.quotient,
}

#: Functions by lower-case name; methods take the object first.
FUNCTIONS: dict[str, Callable[..., Column]] = {
    "abs": maths.absolute, "pow": maths.power, "sqrt": maths.root, "hash": maths.hashed, "isnull": maths.missing,
    "tostring": text.to_string, "ord": text.first_byte, "length": text.n_bytes, "charat": text.char_at,
    "getyear": dates.year, "getquarter": dates.quarter, "getmonth": dates.month, "getday": dates.day, "getdayofyear": dates.day_of_year,
    "getweekofyear": dates.week_of_year, "getyearforweekofyear": dates.week_year, "getdayofweek": dates.day_of_week,
    "getjulianday": dates.julian_day, "isleapyear": dates.is_leap_year, "daysinmonth": dates.days_in_month,
    "year": dates.year, "month": dates.month, "day": dates.day, "hour": dates.hour, "minute": dates.minute, "second": dates.second,
    "dayofweek": dates.day_of_week, "dayofyear": dates.day_of_year, "asdays": dates.as_days, "ashours": dates.as_hours,
    "asminutes": dates.as_minutes, "asseconds": dates.as_seconds, "bymonth": dates.by_month, "datetimefromint": dates.datetime_of_int,
    "at": arrays.at, "front": arrays.front, "back": arrays.back, "empty": arrays.is_empty, "isempty": arrays.is_empty, "size": arrays.size,
    "createview": arrays.view, "bits": arrays.bits, "isset": arrays.is_set, "haversine": geo.haversine, "location": geo.location,
    "domain": network.domain, "ipv4addr": network.ipv4, "macaddr": network.mac, "time": dates.time_of,
}


@dataclass
class State:
    """What an aggregate or iteration with AS SELF leaves: its rows, and how many of the first columns are keys."""

    frame: DataFrame
    keys: int | None = None


class Planner:
    """Runs statements in order; names map to DataFrames, and results AS SELF to states for REQUIRES.

    ``functions``, ``operators``, ``filters``, ``transforms``, ``aggregates`` and ``iterations`` take what users add:
    functions and operators from columns to a column, the others as their built-in counterparts are called.
    """

    def __init__(self, load: Callable[[str], DataFrame], relations: tables.Relations | None = None):
        self.load, self.relations = load, relations
        self.frames: dict[str, DataFrame] = {}
        self.states: dict[str, State] = {}
        self.functions: dict[str, Callable[..., Column]] = {}
        self.operators: dict[str, Callable[[Column, Column], Column]] = {}
        self.iterations: dict[str, Callable[..., DataFrame]] = {"KMeans": k_means, "Rounds": rounds_of}
        self.aliases: dict[str, Functor] = {}
        self.printed: list[DataFrame] = []
        self.job: str | None = None
        self.filters: dict[str, Callable[..., Column]] = {}
        self.transforms: dict[str, Callable[..., DataFrame]] = {}
        self.aggregates: dict[str, Callable[..., agg.Aggregate]] = {}

    @property
    def spark(self) -> SparkSession:
        return self.relations.spark if self.relations else SparkSession.getActiveSession()

    def run(self, source: str) -> dict[str, DataFrame]:
        for s in parse(source):
            if s.op == "quit":
                break
            getattr(self, f"on_{s.op}")(s)
        return self.frames

    def register_function(self, name: str, f: Callable[..., Column]) -> None:
        """A scalar function for expressions, in any casing; it takes the place of a built-in one."""
        self.functions[name.lower()] = f

    def register_operator(self, symbol: str, f: Callable[[Column, Column], Column]) -> None:
        """A meaning of its own for a binary operator."""
        if symbol not in _BINARY:
            raise ProgramError(f"{symbol} is no binary operator")
        self.operators[symbol] = f

    def state(self, name: str) -> State:
        return self.states[name] if name in self.states else State(self.frame(name))

    def frame(self, name: str) -> DataFrame:
        if name not in self.frames:
            raise ProgramError(f"{name} is not defined")
        return self.frames[name]

    # expressions

    def column(self, e: tuple, df: DataFrame | None = None) -> Column:
        kind = e[0]
        if kind == "literal":
            return F.lit(e[1])
        if kind == "column":
            name = e[1]
            if df is not None and name not in df.columns and "." in name and name.split(".")[-1] in df.columns:
                name = name.split(".")[-1]
            return F.col(name)
        if kind == "binary":
            return (self.operators.get(e[1]) or _BINARY[e[1]])(self.column(e[2], df), self.column(e[3], df))
        if kind == "unary":
            c = self.column(e[2], df)
            return {"+": lambda: c, "-": lambda: -c, "~": lambda: maths.bit_not(c), "!": lambda: ~c}[e[1]]()
        if kind == "case":
            return maths.case_when([(self.column(t, df), self.column(v, df)) for t, v in e[1]], self.column(e[2], df))
        if kind == "match":
            return text.matches(self.column(e[1], df), e[2])
        if kind == "method":
            return self.call(e[2], {}, [e[1], *e[3]], df)
        return self.call(e[1], e[2], e[3], df)

    def call(self, name: str, template: dict, arguments: list[tuple], df: DataFrame | None) -> Column:
        args, low = [self.column(a, df) for a in arguments], name.split(".")[-1].lower()
        if low in self.functions:
            return self.functions[low](*args, **template)
        if low == "contains":
            return maths.among(args[0], template["values"])
        if low == "match":
            return text.matches(args[0], template["pattern"] if "pattern" in template else next(iter(template.values())))
        if low == "date":
            return dates.date_of_text(args[0]) if arguments[0][0] == "literal" and isinstance(arguments[0][1], str) else dates.date_of(*args)
        if low == "datetime":
            return dates.datetime_of(*args)
        if low in FUNCTIONS:
            return FUNCTIONS[low](*args)
        if low.upper() in LOGICAL and len(args) == 1:
            return maths.convert(args[0], low)
        raise ProgramError(f"unknown function {name}")

    # statements

    def on_alias(self, s: Statement) -> None:
        self.aliases[s.target] = s.parts["functor"]

    def on_using(self, s: Statement) -> None:
        """Libraries are Python packages here; nothing has to be loaded."""

    on_flush = on_using

    def on_job(self, s: Statement) -> None:
        self.job = s.target

    def on_load(self, s: Statement) -> None:
        df, ranges = self.load(s.parts["relation"]), s.parts["ranges"]
        if ranges:
            by = self.clustered.get(s.parts["relation"], df.columns[0])
            test = F.lit(False)
            for low, high in ranges:
                test = test | ((F.lit(True) if low is None else F.col(by) >= low) & (F.lit(True) if high is None else F.col(by) <= high))
            df = df.filter(test)
        self.frames[s.target] = df.alias(s.parts["alias"]) if s.parts["alias"] else df

    @property
    def clustered(self) -> dict[str, str]:
        return self.__dict__.setdefault("_clustered", {})

    def on_read(self, s: Statement) -> None:
        p, f = s.parts, self.functor(s.parts["functor"])
        columns = p["columns"]
        if columns is None:
            columns = [(x.name, _logical(x.dataType.typeName())) for x in self.relations.schemas[p["relation"]]]
        names = {"separator": "sep", "trim.cr": "trim_cr", "line.number": "line_number"}
        options = {names.get(k, k): v for k, v in f.template.items() if k != "debug"}
        if f.name.split(".")[-1] == "ClusterGen":
            self.frames[s.target] = self.generated(f.template, columns, len(p["paths"]))
            return
        if options.pop("line_number", False):
            options["line_number"], columns = columns[0][0], columns[1:]
        self.frames[s.target] = csv.read_csv(self.spark, p["paths"], columns, **options)

    def generated(self, t: dict, columns: list[tuple[str, str]], files: int) -> DataFrame:
        """Rows around centres, which are distributions: one for all columns, or a list with one for each column."""
        places = [v for k, v in t.items() if k.startswith("#")]
        n, centers = t.get("n", places[0] if places else None), t.get("centers", places[-1] if places else None)
        if not isinstance(n, int) or not isinstance(centers, list):
            raise ProgramError("ClusterGen needs n and a list of centres")

        def spread(f: Functor) -> generators.Spread:
            name = {"inverse_normal": "inverse_gaussian"}.get(f.name.lower(), f.name.lower())
            given = tuple(float(x) for x in f.arguments)
            return generators.Spread(name, given + generators.DEFAULTS.get(name, ())[len(given) :])

        own = [[spread(x) for x in c] if isinstance(c, list) else [spread(c)] * len(columns) for c in centers]
        out = generators.clusters(self.spark, n, own, [c for c, _ in columns], int(t.get("seed") or 0), max(1, files))
        return out.select(*[maths.convert(F.col(c), k).alias(c) for c, k in columns])

    def on_text_load(self, s: Statement) -> None:
        p = s.parts
        columns = p["columns"] or [(x.name, _logical(x.dataType.typeName())) for x in self.relations.schemas[p["relation"]]]
        self.frames[s.target] = csv.read_text(self.spark, p["paths"], columns, p["sep"])

    def on_step(self, s: Statement) -> None:
        f = self.functor(s.parts["functor"])
        name = f.name.split(".")[-1]
        if name not in self.iterations:
            raise ProgramError(f"unknown iteration {f.name}")
        result = self.iterations[name](self.spark, [self.state(n).frame for n in s.parts["states"]], *f.arguments, **{k.replace(".", "_"): v for k, v in f.template.items()})
        self.finish(s, result)

    def finish(self, s: Statement, result: DataFrame, keys: int | None = None) -> None:
        """Keep a result under its target, as a state too if it is AS SELF, else with its outputs' names and types."""
        if s.parts["self"]:
            self.states[s.target] = State(result, keys)
        elif s.op == "step" and s.parts["outputs"]:
            result = result.toDF(*[n for n, _ in s.parts["outputs"]])
        for n, k in s.parts["outputs"]:
            result = result.withColumn(n, maths.convert(F.col(n), k)) if k else result
        self.frames[s.target] = result

    def on_filter(self, s: Statement) -> None:
        df = self.frame(s.parts["input"])
        self.frames[s.target] = filters.filter_by(df, *[self.column(e, df) for e in s.parts["tests"]])

    def on_filter_with(self, s: Statement) -> None:
        df, f = self.frame(s.parts["input"]), self.functor(s.parts["functor"])
        using = [self.column(e, df) for e in s.parts["using"]]
        name = f.name.split(".")[-1]
        if name == "BernoulliSample":
            out = filters.bernoulli(df, f.template.get("p", 0.5), f.template.get("seed"))
        elif name in ("PatternMatcher", "PatternMatcherOnig"):
            out = df.filter(text.matches(using[0], f.template.get("pattern") or f.arguments[0]))
        elif name in self.filters:
            inputs = {f"__{i}": c for i, c in enumerate(using)}
            states = [self.state(n).frame for n in s.parts["states"]]
            out = filters.filter_with(df.withColumns(inputs), self.filters[name], *inputs, states=states, **f.template).drop(*inputs)
        else:
            raise ProgramError(f"unknown filter {f.name}")
        self.frames[s.target] = out

    def on_foreach(self, s: Statement) -> None:
        df = self.frame(s.parts["input"])
        kinds = {n: k for n, k, _ in s.parts["columns"] if k}
        self.frames[s.target] = filters.generate(df, {n: self.column(e, df) for n, _, e in s.parts["columns"]}, kinds)

    def _join(self, s: Statement, how: Callable[..., DataFrame]) -> None:
        (left, lk), (right, rk) = s.parts["left"], s.parts["right"]
        short = lambda keys: [k.split(".")[-1] for k in keys]
        self.frames[s.target] = how(self.frame(left), short(lk), self.frame(right), short(rk))

    def on_join(self, s: Statement) -> None:
        self._join(s, joins.inner)

    def on_left_join(self, s: Statement) -> None:
        self._join(s, joins.left_outer)

    def on_in(self, s: Statement) -> None:
        self._join(s, joins.exists_in)

    def on_not_in(self, s: Statement) -> None:
        self._join(s, joins.not_exists_in)

    def on_cache(self, s: Statement) -> None:
        self.frames[s.target] = sinks.cache(self.frame(s.parts["input"]))

    def on_compact(self, s: Statement) -> None:
        self.frames[s.target] = sinks.compact(self.frame(s.parts["input"]))

    def on_store(self, s: Statement) -> None:
        df, p = self.frame(s.parts["input"]), s.parts
        columns = {n: self.column(e, df) for n, e in p["columns"].items()} if p["columns"] else None
        self.relations.store(df, p["relation"], columns, p["overwrite"])

    def on_print(self, s: Statement) -> None:
        df, p = self.frame(s.parts["input"]), s.parts
        names = p["header"] or [e[1] if e[0] == "column" else f"c{i}" for i, e in enumerate(p["columns"])]
        columns = {n: self.column(e, df) for n, e in zip(names, p["columns"], strict=True)}
        if p["path"]:
            sinks.print_to(df, columns, p["path"], p["kind"], p["header"] is not None, p["sep"], p["limit"])
        else:
            lines = sinks.printed(df, columns, p["kind"], p["sep"], p["limit"])
            self.printed.append(sinks.with_types(lines, df, columns) if p["kind"] == "json" else lines)

    def on_create(self, s: Statement) -> None:
        self.relations.create(s.target, s.parts["columns"])

    def on_delete_content(self, s: Statement) -> None:
        self.relations.delete_content(s.target)

    def on_delete(self, s: Statement) -> None:
        self.relations.delete(s.target)

    def on_cluster(self, s: Statement) -> None:
        by = s.parts["by"] or self.clustered.get(s.target)
        if by is None:
            raise ProgramError(f"CLUSTER {s.target} needs BY the first time")
        self.frames[f"{s.target}_zones"] = self.relations.cluster(s.target, by)
        self.clustered[s.target] = by

    # processors

    def functor(self, f: Functor | str) -> Functor:
        f = Functor("", f) if isinstance(f, str) else f
        return self.aliases.get(f.name, f) if not f.kind else f

    def on_process(self, s: Statement) -> None:
        p, f = s.parts, self.functor(s.parts["functor"])
        df = self.frame(p["input"])
        names = []
        for i, (name, e) in enumerate(p["using"]):
            own = name or (e[1].split(".")[-1] if e[0] == "column" else f"__in{i}")
            if e[0] != "column" or name:
                df = df.withColumn(own, self.column(e, df))
            names.append(own)
        parameters = p["parameters"]
        if "parameter_file" in p:
            parameters = json.loads("".join(r[0] for r in self.spark.read.text(p["parameter_file"], wholetext=True).collect()))
        f = Functor(f.kind, f.name, {**f.template, **parameters}, f.arguments)
        outputs = [n for n, _ in p["outputs"]]
        if f.kind == "GT":
            self.frames[s.target] = self.transform(f, df, names, outputs, p["states"])
            return
        if p["states"] and f.name.split(".")[-1] in self.aggregates:
            f.template = {**f.template, "states": [self.state(n).frame for n in p["states"]]}
        result = agg.evaluate(df, self.aggregate(f, names, outputs))
        self.finish(s, result, self.key_count(f, names))

    def key_count(self, f: Functor, inputs: list[str]) -> int | None:
        """How many of a state's first columns are keys, where its aggregate says so."""
        name = f.name.split(".")[-1]
        if name in ("Multi_Hash", "Hash"):
            return int(f.template.get("split", 1))
        return len(f.template["group"]) if name == "GroupBy" else None

    def aggregate(self, f: Functor, inputs: list[str], outputs: list[str]) -> agg.Aggregate:
        """An aggregate by name over named inputs, with outputs renamed in order."""
        f, t = self.functor(f), self.functor(f).template
        name = f.name.split(".")[-1]
        to = outputs or inputs
        first = outputs[0] if outputs else name.lower()
        one_each = dict(zip(to, inputs, strict=False))
        null_check = t.get("null.check", t.get("null_check", False))
        simple: dict[str, Callable[[], agg.Aggregate]] = {
            "Count": lambda: agg.count(first, bool(t.get("as.json", False))),
            "Sum": lambda: agg.sums(one_each),
            "Average": lambda: renamed(agg.count_sum_average(inputs[0]), ["count", "sum", "average"], outputs) if len(outputs) == 3 and len(inputs) == 1 else agg.averages(one_each),
            "Multi_Hash": lambda: agg.multi_hash(inputs[: int(t.get("split", 1))], inputs[int(t.get("split", 1)) :]),
            "Hash": lambda: agg.multi_hash(inputs[: int(t.get("split", 1))], inputs[int(t.get("split", 1)) :]),
            "Interval_Map": lambda: agg.interval_map(inputs[0], inputs[1], inputs[2:]),
            "LogisticRegressionIRLS": lambda: logistic(inputs, outputs, int(t.get("rounds", 5))),
            "Min": lambda: agg.minima(one_each),
            "Max": lambda: agg.maxima(one_each),
            "CountDistinct": lambda: agg.count_distinct(inputs, first, bool(null_check)),
            "HyperLogLog": lambda: agg.hyper_log_log(inputs[0], first, int(t.get("bins.exponent", 4))),
            "BloomFilter": lambda: agg.linear_counting(inputs, first, int(t.get("exponent", 16)), bool(null_check)),
            "Distinct": lambda: renamed(agg.distinct(inputs, null_check), inputs, outputs),
            "Gather": lambda: renamed(agg.gather(inputs), inputs, outputs),
            "ChunkCount": agg.chunk_count,
            "OrderBy": lambda: self._ordered(t, inputs, outputs),
            "TopK": lambda: renamed(agg.top_k(inputs[0], int(f.arguments[0] if f.arguments else t["k"]), inputs[1:]), inputs, outputs),
            "ExtremeTuples": lambda: renamed(agg.extreme_tuples(t["extremes"] if isinstance(t["extremes"], dict) else dict.fromkeys(t["extremes"], "MAX")), inputs, outputs),
            "Segmenter": lambda: agg.segment(inputs[0], self.aggregate(t["gla"], inputs, outputs), int(t.get("segments", 64)), int(t.get("passes", 1))),
            "Multiplexer": lambda: agg.multiplex([self.aggregate(x["gla"], x["inputs"], x.get("outputs", [])) for x in t["glas"]]),
            "GroupBy": lambda: self._grouped(t, inputs, outputs),
        }
        if name in self.aggregates:
            return self.aggregates[name](inputs, outputs, **t)
        if name not in simple:
            raise ProgramError(f"unknown aggregate {f.name}")
        return simple[name]()

    def _ordered(self, t: dict, inputs: list[str], outputs: list[str]) -> agg.Aggregate:
        order = t["order"] if isinstance(t["order"], dict) else dict.fromkeys(t["order"], "ASC")
        by = {n: order[n] for n in inputs if n in order}  # the inputs' order, not that of the map
        rank = t.get("rank")
        inner = agg.order_by(by, int(t["limit"]) if t.get("limit") else None, rank, t.get("keep.ties"))
        return renamed(inner, [n for n in inputs if n != rank], [n for n in outputs if n != rank], [rank] if rank else [])

    def _grouped(self, t: dict, inputs: list[str], outputs: list[str]) -> agg.Aggregate:
        group = t["group"] if isinstance(t["group"], dict) else {k: k for k in t["group"]}
        rest = [i for i in inputs if i not in group]
        inner_out = outputs[len(group) :] if len(outputs) > len(group) else []
        names = dict(zip(group, outputs, strict=False)) if outputs and isinstance(t["group"], list) else group
        return agg.group_by(names, self.aggregate(t["aggregate"], rest, inner_out))

    def transform(self, f: Functor, df: DataFrame, inputs: list[str], outputs: list[str], states: list[str]) -> DataFrame:
        t, name = f.template, f.name.split(".")[-1]
        if name == "Range":
            args = [*f.arguments, *[t[k] for k in ("distance", "increment", "initial") if k in t]]
            return transforms.value_range(df, dict(zip(outputs, inputs, strict=True)), *args)
        if name == "IntervalToDiscrete":
            return transforms.interval_to_discrete(df, inputs[0], inputs[1], outputs[0], bool(t.get("inclusive", True)))
        if name == "StreamingGroupBy":
            return transforms.runs(df, inputs[0], self.aggregate(t["aggregate"], inputs[1:], outputs[1:]), t["order"], t.get("partition"))
        if name in ("Join", "Interval_Join", "Group_By_Interval_Join"):
            held = self.state(states[0])
            state, keep = held.frame, bool(t.get("keep.missing", False))
            if name == "Join":
                n = held.keys or len(inputs)
                old = state.columns
                if n > len(inputs):
                    raise ProgramError(f"{states[0]} has {n} keys, the join {len(inputs)} inputs")
                own = state.toDF(*[f"__k{i}" for i in range(n)], *(outputs or old[n:]))
                return joins.with_state(df, inputs[:n], own, [f"__k{i}" for i in range(n)], keep).drop(*[f"__k{i}" for i in range(n)])
            width = float(t.get("width", 1))
            if name == "Interval_Join":
                own = state.toDF("__lo", "__hi", *outputs)
                return joins.interval_join(df, inputs[0], own, "__lo", "__hi", width, keep).drop("__lo", "__hi")
            keys = [f"__k{i}" for i in range(len(inputs) - 1)]
            own = state.toDF(*keys, "__lo", "__hi", *outputs)
            return joins.group_interval_join(df, inputs[1:], inputs[0], own, keys, "__lo", "__hi", None, keep).drop(*keys, "__lo", "__hi")
        if name in self.transforms:
            return self.transforms[name](df, inputs, outputs, *f.arguments, **t)
        raise ProgramError(f"unknown transform {f.name}")


def logistic(inputs: list[str], outputs: list[str], rounds: int) -> agg.Rows:
    """Coefficients of the inputs after the first, which is the label, one column each."""

    def run(df: DataFrame, keys: list[str]) -> DataFrame:
        if keys:
            raise ProgramError("LogisticRegressionIRLS runs over all rows")
        coefficients = iterate.logistic_regression(df, inputs[1:], inputs[0], rounds)
        names = outputs or [f"b_{c}" for c in inputs[1:]]
        return df.sparkSession.createDataFrame([tuple(float(c) for c in coefficients)], ", ".join(f"`{n}` double" for n in names))

    return agg.Rows(run)


def k_means(spark: SparkSession, states: list[DataFrame], centers: list[list[float]], rounds: int = 10) -> DataFrame:
    """(center, coordinates) after so many rounds over the state's numeric columns."""
    names = states[0].columns
    found, _ = iterate.k_means(states[0], names, [[float(x) for x in c] for c in centers], int(rounds))
    return spark.createDataFrame([(i, *c) for i, c in enumerate(found)], ", ".join(["center int", *[f"`{n}` double" for n in names]]))


def rounds_of(spark: SparkSession, states: list[DataFrame], expressions: dict[str, str], rounds: int = 1, intermediates: bool = False) -> DataFrame:
    """The state after so many rounds, each of which computes all of its named columns anew; or all rounds' rows."""

    def step(state: DataFrame, n: int) -> DataFrame:
        return state.select(*[F.expr(expressions[c]).alias(c) if c in expressions else F.col(c) for c in state.columns])

    return iterate.iterate_state(states[0], step, iterate.halt_after(int(rounds)), int(rounds), keep_rounds=bool(intermediates))


def renamed(inner: agg.Aggregate, inputs: list[str], outputs: list[str], extra: list[str] | None = None) -> agg.Rows:
    """The keys and named columns of an aggregate's rows, under other names."""

    def run(df: DataFrame, keys: list[str]) -> DataFrame:
        out = inner.apply(df, keys)
        pairs = itertools.zip_longest(inputs, outputs or inputs)
        return out.select(*keys, *[F.col(a).alias(b) for a, b in pairs if a and b], *(extra or []))

    return agg.Rows(run)


def _logical(kind: str) -> str:
    return {"byte": "BYTE", "short": "SMALLINT", "integer": "INT", "long": "BIGINT", "float": "FLOAT", "double": "DOUBLE", "boolean": "BOOL", "date": "DATE", "timestamp": "DATETIME"}.get(kind, "STRING")


def run(source: str, load: Callable[[str], DataFrame], relations: tables.Relations | None = None) -> dict[str, DataFrame]:
    """Frames by name after running a program; ``load`` gives stored relations."""
    return Planner(load, relations).run(source)
