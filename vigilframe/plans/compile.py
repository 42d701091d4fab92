"""A query compiled to one lazily built DataFrame; Catalyst chooses how to run it.

Order: scan, event type, time window, filter, sequence or lookup, aggregation, threshold, sort, limit,
projection.  Equality is case-sensitive, ``contains`` is a literal substring without case, ``regex``
finds anywhere, nulls follow SQL, ``not`` negates the conjunction of its members.
"""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.functions.times import epoch_micros
from vigilframe.plans.fields import Binding
from vigilframe.plans.query import Aggregate, Condition, Group, Query, QueryError, Threshold, seconds

#: Lookup tables up to this size (as Spark estimates it) are broadcast; larger ones are joined by key.
BROADCAST_BYTES = 64 << 20
SEQUENCE_KEYS = ("user", "host", "src_ip", "user_id", "hostname")
_COMPARE = {"eq": operator.eq, "neq": operator.ne, "gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le}


@dataclass
class Source:
    """Event tables by event type, or one table with a column that holds the type."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    type_column: str | None = None
    binding: Binding = field(default_factory=Binding)
    time_column: str = "_time"

    def scan(self, event_type: str) -> DataFrame:
        if event_type in self.tables:
            return self.tables[event_type]
        if "any" not in self.tables:
            if event_type == "any" and self.tables:
                frames = [self.tables[k] for k in sorted(self.tables)]
                return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
            raise QueryError(f"no table for {event_type}")
        df = self.tables["any"]
        if event_type != "any" and self.type_column:
            df = df.filter(F.col(self.type_column) == event_type)
        return df


@dataclass
class Options:
    """as_of: end of time windows (default: the newest event scanned).  The others choose semantics that engines disagree on."""

    as_of: object = None
    contains: str = "substring"  # or "term": whole words
    ci_equality: bool = False
    nulls: str = "sql"  # or "search": a missing field doesn't match, so its negation does
    approx_distinct: bool = False
    sequence_key: str | None = None
    max_span: str | None = None


def condition(c: Condition, binding: Binding, options: Options, alias: str | None = None, before: str | None = None) -> Column:
    """The predicate of one condition.  ``$prev.<field>`` refers to the step before, under the alias ``before``."""
    left = binding.column(c.field, alias)

    def right(v) -> Column:
        if isinstance(v, str) and v.startswith("$prev.") and before:
            return binding.column(v[6:], before)
        return F.lit(binding.value(c.field, v))

    op, value = c.op, c.value
    if op in ("in", "not_in"):
        values = [binding.value(c.field, v) for v in (value if isinstance(value, (list, tuple)) else [value])]
        p = left.isin(*values)
        p = ~p if op == "not_in" else p
    elif op == "contains":
        if options.contains == "term":
            literal = re.sub(r"([^\w\s])", r"\\\1", str(value))
            p = left.cast("string").rlike(rf"(?i)(?<!\w){literal}(?!\w)")
        else:
            p = F.contains(F.lower(left.cast("string")), F.lit(str(value).lower()))
    elif op == "regex":
        p = left.cast("string").rlike(str(value))
    elif value is None and op in ("eq", "neq"):
        p = left.isNull() if op == "eq" else left.isNotNull()
    elif value == "*" and op in ("eq", "neq"):
        p = left.isNotNull() if op == "eq" else left.isNull()
    elif isinstance(value, (list, tuple)):
        p = left.isin(*value) if op == "eq" else ~left.isin(*value)
    elif options.ci_equality and isinstance(value, str) and op in ("eq", "neq"):
        p = _COMPARE[op](F.lower(left), F.lower(right(value)))
    else:
        p = _COMPARE[op](left, right(value))
    if options.nulls == "search":
        p = F.coalesce(p, F.lit(op in ("neq", "not_in")))
    return ~p if c.negate else p


def predicate(g: Group | None, binding: Binding, options: Options | None = None, alias: str | None = None, before: str | None = None) -> Column | None:
    """The predicate of a filter tree; None where it holds no condition."""
    options = options or Options()
    if g is None:
        return None
    parts = [predicate(c, binding, options, alias, before) if isinstance(c, Group) else condition(c, binding, options, alias, before) for c in g.conditions]
    parts = [p for p in parts if p is not None]
    if not parts:
        return None
    if g.operator == "or":
        return functools.reduce(operator.or_, parts)
    both = functools.reduce(operator.and_, parts)
    return ~both if g.operator == "not" else both


def within_window(df: DataFrame, time: Column, duration: str, as_of=None) -> DataFrame:
    """Rows in the closed interval of ``duration`` before ``as_of``, by default the newest time of ``df`` (found by the same query)."""
    span = F.make_dt_interval(secs=F.lit(seconds(duration)))
    if as_of is None:
        newest = df.agg(F.max(time).alias("_end")).scalar()
        return df.filter((time >= newest - span) & (time <= newest))
    end = F.lit(as_of) if not isinstance(as_of, Column) else as_of
    return df.filter((time >= end - span) & (time <= end))


def aggregate(df: DataFrame, a: Aggregate, binding: Binding, approx: bool = False) -> DataFrame:
    """The one aggregation of a query; null keys form a group, no keys one row."""
    of = binding.column(a.field) if a.field else None
    if a.function == "count":
        value = F.count(F.lit(1))
    elif of is None:
        raise QueryError(f"{a.function} needs a field")
    elif a.function == "distinct_count":
        value = F.approx_count_distinct(of) if approx else F.count_distinct(of)
    else:
        value = getattr(F, a.function)(of)
    return df.groupBy(*(binding.column(k).alias(k) for k in a.group_by)).agg(value.alias(a.output))


def having(df: DataFrame, t: Threshold, a: Aggregate) -> DataFrame:
    """The threshold; a field that isn't among the outputs means the aggregate."""
    name = t.field if t.field in df.columns else a.output
    if t.op not in _COMPARE:
        raise QueryError(f"a threshold can't use {t.op}")
    return df.filter(_COMPARE[t.op](F.col(name), F.lit(t.value)))


def lookup(df: DataFrame, table: DataFrame, left: Column, key: str, output: str | None, only_matches: bool, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Events matched with a reference table whose repeated keys count once, so no event is multiplied.

    The table is broadcast while its estimated size is at most ``broadcast_bytes``, else joined by key.
    """
    small = table.select(F.col(key).alias("_key"), *([F.col(output).alias(output)] if output else [])).filter("_key is not null")
    small = small.groupBy("_key").agg(F.min(output).alias(output)) if output else small.distinct()
    if output is None and not only_matches:
        return df
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size <= broadcast_bytes:
        small = F.broadcast(small)
    if output is None:
        return df.join(small, left == small["_key"], "left_semi")
    if output in df.columns:
        df = df.drop(output)
    return df.join(small, left == small["_key"], "inner" if only_matches else "left").drop("_key")


def sequence_key(q: Query, options: Options) -> str:
    """The field that links the steps: given, else a preferred field of the filters, else of the projected fields."""
    if options.sequence_key:
        return options.sequence_key
    used = {c.field for s in q.sequence or () if s.filter for c in s.filter.conditions if isinstance(c, Condition)}
    for names in (used, set(q.fields)):
        for k in SEQUENCE_KEYS:
            if k in names:
                return k
    raise QueryError("a sequence needs a key: an unkeyed one would pair all events")


def sequence(steps: list[tuple[DataFrame, Group | None, str | None]], key: Column | str, time: str, binding: Binding, options: Options) -> DataFrame:
    """Ordered steps of one key: every step later than the one before, by at most its own gap.

    One row per chain: the key and the time of each step (step_1_time, ..).  Steps are joined on the key and a
    time bucket as wide as the gap (each row meets its bucket and the next), so that a hot key is spread over
    its buckets and no task holds all its events; a step without a gap is joined on the key alone.
    """
    done: DataFrame | None = None
    carries = any(isinstance(v, str) and v.startswith("$prev.") for _, g, _ in steps for v in _values(g))
    for n, (df, tree, gap) in enumerate(steps, 1):
        refers = any(isinstance(v, str) and v.startswith("$prev.") for v in _values(tree))
        here = df.withColumn("_k", binding.column(key) if isinstance(key, str) else key).withColumn("_t", F.col(time)).filter("_k is not null and _t is not null")
        if not refers and (p := predicate(tree, binding, options)) is not None:
            here = here.filter(p)
        row = F.struct(*(F.col(f"`{c}`") for c in df.columns)) if carries else F.lit(True)
        if done is None:
            done = here.select("_k", F.col("_t").alias("step_1_time"), row.alias("_row"))
            continue
        last = f"step_{n - 1}_time"
        a = done.alias("a")
        if gap:
            width = seconds(gap)
            kind = df.schema[time].dataType
            bucket = lambda c: F.floor(epoch_micros(c, kind) / F.lit(width * 1_000_000))  # noqa: B023, E731
            a = done.withColumn("_b", F.explode(F.array(bucket(F.col(last)), bucket(F.col(last)) + 1))).alias("a")
            b = here.withColumn("_b", bucket(F.col("_t"))).alias("b")
            on = (F.col("a._k") == F.col("b._k")) & (F.col("a._b") == F.col("b._b")) & (F.col("b._t") > F.col(f"a.{last}")) & (F.col("b._t") <= F.col(f"a.{last}") + F.make_dt_interval(secs=F.lit(width)))
        else:
            b = here.alias("b")
            on = (F.col("a._k") == F.col("b._k")) & (F.col("b._t") > F.col(f"a.{last}"))
        if refers:
            renamed = Binding({c: (lambda c=c: F.col(f"a._row.`{c}`")) for c in df.columns})
            on = on & _predicate_across(tree, binding, renamed, options)
        keep = [F.col("a._k").alias("_k"), *(F.col(f"a.step_{i}_time") for i in range(1, n)), F.col("b._t").alias(f"step_{n}_time")]
        carried = F.struct(*(F.col(f"b.`{c}`") for c in df.columns)) if carries else F.lit(True)
        done = a.join(b, on).select(*keep, carried.alias("_row"))
    if done is None:
        raise QueryError("a sequence needs steps")
    if options.max_span:
        done = done.filter(F.col(f"step_{len(steps)}_time") <= F.col("step_1_time") + F.make_dt_interval(secs=F.lit(seconds(options.max_span))))
    return done.drop("_row").withColumnRenamed("_k", "key")


def _values(g: Group | None):
    for c in g.conditions if g else ():
        if isinstance(c, Group):
            yield from _values(c)
        else:
            yield c.value


def _predicate_across(g: Group, here: Binding, before: Binding, options: Options) -> Column:
    def one(c: Condition) -> Column:
        if isinstance(c.value, str) and c.value.startswith("$prev."):
            name = here.columns.get(c.value[6:], c.value[6:])
            p = _COMPARE[c.op](here.column(c.field, "b"), before.column(name if isinstance(name, str) else c.value[6:]))
            return ~p if c.negate else p
        return condition(c, here, options, "b")

    def tree(g: Group) -> Column:
        parts = [tree(c) if isinstance(c, Group) else one(c) for c in g.conditions]
        joined = functools.reduce(operator.or_ if g.operator == "or" else operator.and_, parts)
        return ~joined if g.operator == "not" else joined

    return tree(g)


def compile_query(q: Query, source: Source, lookups: dict[str, tuple[DataFrame, str]] | None = None, options: Options | None = None) -> DataFrame:
    """The DataFrame of a query.

    lookups: name -> (table, key column).  Outputs: for aggregates the keys and the value; for sequences the key
    and the steps' times; else the events.  ``fields`` keeps those of them that exist, in order, each once.
    """
    options = options or Options()
    binding = source.binding
    df = source.scan(q.event_type)

    def prepared(frame: DataFrame) -> DataFrame:
        if q.time_window:
            time = binding.column(q.time_window.field) if q.time_window.field in binding.columns else F.col(source.time_column)
            return within_window(frame, time, q.time_window.duration, options.as_of)
        return frame

    if q.action == "sequence":
        top = predicate(q.filter, binding, options)
        steps = []
        for s in q.sequence or ():
            frame = prepared(source.scan(s.event_type))
            steps.append((frame.filter(top) if top is not None else frame, s.filter, s.within))
        df = sequence(steps, sequence_key(q, options), source.time_column, binding, options)
    else:
        df = prepared(df)
        p = predicate(q.filter, binding, options)
        if p is not None:
            df = df.filter(p)
        if q.lookup:
            if not lookups or q.lookup.lookup_table not in lookups:
                raise QueryError(f"no lookup table {q.lookup.lookup_table}")
            table, key = lookups[q.lookup.lookup_table]
            df = lookup(df, table, binding.column(q.lookup.match_field), key, q.lookup.output_field, q.lookup.filter_on_match)
    grouped = q.aggregates
    if grouped:
        df = aggregate(df, q.aggregation, binding, options.approx_distinct)
        if q.threshold:
            df = having(df, q.threshold, q.aggregation)

    def named(c: str) -> Column:
        return F.col(f"`{c}`") if c in df.columns else binding.column(c)

    by = q.sort_by or (q.aggregation.alias if grouped else None)
    if by:
        ties = [F.col(k) for k in (q.aggregation.group_by if grouped else ())]
        df = df.orderBy(named(by).desc() if q.sort_order == "desc" or not q.sort_by else named(by).asc(), *ties)
    if q.limit:
        df = df.limit(q.limit)
    if q.fields:
        there = {c for c in df.columns} | (set() if grouped or q.action == "sequence" else {c for c in binding.columns})
        chosen = [f for f in dict.fromkeys(q.fields) if f in there]
        if grouped:
            chosen = list(dict.fromkeys([*q.aggregation.group_by, q.aggregation.output, *chosen]))
        if chosen and q.action != "sequence":
            df = df.select(*(named(f).alias(f) for f in chosen))
    return df


Transform = Callable[[DataFrame], DataFrame]
