"""Texts of five query languages run as DataFrame plans: pipelines of search commands, event queries, ES|QL, Kusto, and AQL.

A text is cut into stages and every stage becomes one DataFrame operation, so Catalyst sees the whole as one plan.
Expressions are brought to Spark SQL token by token; literals are never looked into.  What a language leaves open -
the table behind a name, the newest time, lookup tables - is given by ``Tables``.  Unknown commands are an error.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.operators import commands, windows
from vigilframe.plans.query import QueryError

_LITERAL = re.compile(r'"(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)*\'')
_UNITS = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days", "w": "weeks"}
_SPAN = r"(\d+)\s*([smhdw])\w*"


@dataclass
class Tables:
    """What names mean: event tables, lookup tables, the column of time and the newest time (default: that of the scanned table)."""

    events: dict[str, DataFrame]
    lookups: dict[str, DataFrame] = field(default_factory=dict)
    time: str = "_time"
    as_of: object = None

    def scan(self, name: str) -> DataFrame:
        for key in (name, name.lower(), "*"):
            if key in self.events:
                return self.events[key]
        raise QueryError(f"no table {name}")

    def lookup(self, name: str) -> DataFrame:
        if name not in self.lookups:
            raise QueryError(f"no lookup table {name}")
        return self.lookups[name]

    def since(self, df: DataFrame, n: str, unit: str) -> DataFrame:
        now = F.lit(self.as_of) if self.as_of is not None else df.agg(F.max(self.time)).scalar()
        return df.filter(F.col(self.time) >= now - F.expr(f"interval {int(n)} {_UNITS[unit[0].lower()]}"))


def split_outside(text: str, mark: str) -> list[str]:
    """Parts between marks that stand outside literals and brackets."""
    parts, depth, at, k = [], 0, 0, 0
    while k < len(text):
        m = _LITERAL.match(text, k) if text[k] in "\"'" else None
        if m:
            k = m.end()
            continue
        depth += (text[k] in "([{") - (text[k] in ")]}")
        if depth == 0 and text.startswith(mark, k):
            parts.append(text[at:k].strip())
            k += len(mark)
            at = k
            continue
        k += 1
    return [*parts, text[at:].strip()]


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _value(token: str) -> str:
    """The text of a literal, with its own escapes undone."""
    return re.sub(r"\\(.)", r"\1", token[1:-1]) if token[:1] in "\"'" else token


def _wildcard(pattern: str) -> str:
    return "(?is)" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)


_NAME = r"[A-Za-z_@][\w.@]*(?:\([^()]*\))?"
_HELD = r"\x00(\d+)\x00"


def expression(text: str, now: str = "current_timestamp()") -> str:
    """An expression of any of the languages in Spark SQL."""
    held: list[str] = []

    def hold(m: re.Match) -> str:
        held.append(_value(m.group()))
        return f"\0{len(held) - 1}\0"

    def lit(k: str) -> str:
        return _quoted(held[int(k)])

    def put(sql: str) -> str:
        held.append(sql)
        return f"\1{len(held) - 1}\1"

    x = _LITERAL.sub(hold, text)
    for word, make in _WORDS.items():
        x = re.sub(rf"({_NAME})\s+(!|not\s+)?{word}\s*{_HELD}", lambda m: put(("not " if m.group(2) else "") + f"({make(m.group(1), held[int(m.group(3))])})"), x, flags=re.I)
    x = re.sub(rf"({_NAME})\s*(=~|!~)\s*{_HELD}", lambda m: put(f"(lower({m.group(1)}) {'=' if m.group(2) == '=~' else '<>'} {_quoted(held[int(m.group(3))].lower())})"), x)
    x = re.sub(rf"\bago\(\s*{_SPAN}\s*\)", lambda m: f"({now} - interval {m.group(1)} {_UNITS[m.group(2)]})", x)
    x = re.sub(r"\bnow\(\s*\)", now, x)
    x = re.sub(rf"\bbin\(\s*([\w.]+)\s*,\s*{_SPAN}\s*\)", lambda m: f"window({m.group(1)}, '{m.group(2)} {_UNITS[m.group(3)]}').start", x)
    x = re.sub(r"\bbin\(\s*([\w.]+)\s*,\s*([\d.]+)\s*\)", r"(floor(\1 / \2) * \2)", x)
    x = re.sub(r"\bbetween\s*\(\s*(.+?)\s*\.\.\s*(.+?)\s*\)", r"between \1 and \2", x, flags=re.I)
    x = re.sub(rf"\b(?:cidrmatch|incidr)\(\s*{_HELD}\s*,\s*([\w.]+)\s*\)", lambda m: put(_cidr(m.group(2), held[int(m.group(1))])), x, flags=re.I)
    x = re.sub(rf"\bmatch\(\s*([\w.]+)\s*,\s*{_HELD}\s*\)", lambda m: f"({m.group(1)} rlike {m.group(2).join(chr(0) * 2)})", x, flags=re.I)
    for pattern, to in ((r"\bisnull\(", "isnull("), (r"\blen\(", "length("), (r"\b(?:iff?|iif)\(", "if("), (r"\btolower\(", "lower("), (r"\btoupper\(", "upper("), (r"\bstrlen\(", "length("), (r"\bstrcat\(", "concat("), (r"\btostring\(", "string("), (r"\btoint\(", "int("), (r"\bto_string\(", "string("), (r"\bto_integer\(", "int("), (r"\bin~", "in"), (r"==", "=")):
        x = re.sub(pattern, to, x, flags=re.I)
    while "\1" in x:  # what was put may hold literals, but no further marks
        x = re.sub("\1(\\d+)\1", lambda m: held[int(m.group(1))], x)
    return re.sub(_HELD, lambda m: lit(m.group(1)), x)


def _cidr(column: str, net: str) -> str:
    base, _, bits = net.partition("/")
    low = functools.reduce(lambda a, b: a * 256 + int(b), base.split("."), 0)
    size = 1 << (32 - int(bits or 32))
    low = low // size * size
    number = " + ".join(f"cast(split_part({column}, '.', {k}) as bigint) * {256 ** (4 - k)}" for k in (1, 2, 3, 4))
    return f"(({number}) between {low} and {low + size - 1})"


#: Operators that take a literal: case-insensitive, but for ``rlike``.
_WORDS: dict[str, Callable[[str, str], str]] = {
    "matches regex": lambda c, v: f"{c} rlike {_quoted(v)}",
    "contains": lambda c, v: f"contains(lower({c}), {_quoted(v.lower())})",
    "startswith": lambda c, v: f"startswith(lower({c}), {_quoted(v.lower())})",
    "endswith": lambda c, v: f"endswith(lower({c}), {_quoted(v.lower())})",
    "has": lambda c, v: f"{c} rlike {_quoted(r'(?i)(?<![A-Za-z0-9])' + re.escape(v) + r'(?![A-Za-z0-9])')}",
    "like~?": lambda c, v: f"{c} rlike {_quoted('^' + _wildcard(v) + '$')}" if "%" not in v else f"{c} like {_quoted(v)}",
    "rlike": lambda c, v: f"{c} rlike {_quoted('^(?:' + v + ')$')}",
}
_AGGREGATES = {"count": "count", "dc": "dc", "distinct_count": "dc", "count_distinct": "dc", "dcount": "dc", "uniquecount": "dc", "sum": "sum", "avg": "avg", "mean": "avg", "min": "min", "max": "max", "values": "values", "make_set": "values", "list": "list", "make_list": "list", "stdev": "stddev", "median": "median", "first": "min", "last": "max"}


def aggregate(text: str, now: str) -> Column:
    """``sum(x)``, ``count``, ``values(x)`` ... as a column."""
    m = re.fullmatch(r"\s*(\w+)\s*(?:\(\s*(.*?)\s*\))?\s*", text, re.S)
    kind = _AGGREGATES.get(m.group(1).lower()) if m else None
    if kind is None:
        raise QueryError(f"unknown aggregate: {text}")
    of = m.group(2)
    if kind == "count" and of in (None, "", "*"):
        return F.count(F.lit(1))
    if not of:
        raise QueryError(f"{text}: of what?")
    c = F.expr(expression(of, now))
    return {"count": F.count, "dc": F.count_distinct, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "values": lambda x: F.array_sort(F.collect_set(x)), "list": F.collect_list, "stddev": F.stddev, "median": F.median}[kind](c)


def _keys(text: str, now: str) -> list[Column]:
    out = []
    for part in split_outside(text, ",") if "," in text or "(" in text or "=" in text else text.split():
        name, eq, of = part.partition("=")
        if eq and re.fullmatch(r"\s*\w+\s*", name):
            out.append(F.expr(expression(of, now)).alias(name.strip()))
        else:
            m = re.fullmatch(r"bin\(\s*([\w.]+)\s*,.*\)", part, re.I)
            out.append(F.expr(expression(part, now)).alias(m.group(1)) if m else F.col(part.strip()))
    return out


def _aggregates(text: str, language: str, now: str) -> list[Column]:
    out = []
    for part in split_outside(text, ","):
        m = re.fullmatch(r"(.+?)\s+as\s+\"?(\w+)\"?", part, re.I | re.S)
        n = re.fullmatch(r"(\w+)\s*=\s*(.+)", part, re.S)
        if m:
            out.append(aggregate(m.group(1), now).alias(m.group(2)))
        elif n:
            out.append(aggregate(n.group(2), now).alias(n.group(1)))
        elif language == "kusto":
            f = re.fullmatch(r"(\w+)\(\s*([\w.]*)\s*\)", part)
            out.append(aggregate(part, now).alias(f"{f.group(1)}_{f.group(2)}" if f else part))
        else:
            out.append(aggregate(part, now).alias(part))
    return out


def grouped(df: DataFrame, text: str, language: str, now: str) -> DataFrame:
    """``aggregates [by keys]``."""
    parts = re.split(r"\s+by\s+", text, maxsplit=1, flags=re.I)
    return df.groupBy(*(_keys(parts[1], now) if len(parts) > 1 else [])).agg(*_aggregates(parts[0], language, now))


def ordered(df: DataFrame, text: str, falling: bool = False) -> DataFrame:
    """Keys with a sign before or asc/desc behind them."""
    keys = []
    for part in split_outside(re.sub(r"^by\s+", "", text.strip(), flags=re.I), ","):
        m = re.fullmatch(r"([-+]?)\s*([\w.@`]+)(?:\s+(asc|desc))?(?:\s+nulls\s+(?:first|last))?", part.strip(), re.I)
        if not m:
            raise QueryError(f"can't sort by {part}")
        down = m.group(1) == "-" or (m.group(3) or "").lower() == "desc" or (falling and not m.group(1) and not m.group(3))
        keys.append(F.desc(m.group(2)) if down else F.asc(m.group(2)))
    return df.orderBy(*keys)


def assigned(df: DataFrame, text: str, now: str) -> DataFrame:
    """``name = expression, ...``, each seeing those before it."""
    for part in split_outside(text, ","):
        name, eq, of = part.partition("=")
        if not eq:
            raise QueryError(f"no assignment: {part}")
        df = df.withColumn(name.strip(), F.expr(expression(of.strip(), now)))
    return df


def _names(text: str) -> list[str]:
    return [n.strip("\"'` ") for n in re.split(r"[,\s]+", text.strip()) if n.strip(", ")]


def renamed(df: DataFrame, text: str) -> DataFrame:
    """``a as b`` or ``b = a``."""
    for part in split_outside(text, ","):
        for old, new in re.findall(r"([\w.]+)\s+as\s+\"?(\w+)\"?", part, re.I) or [(b, a) for a, b in re.findall(r"(\w+)\s*=\s*([\w.]+)", part)]:
            df = df.withColumnRenamed(old, new)
    return df


_GROK = {"WORD": r"\w+", "NUMBER": r"-?\d+(?:\.\d+)?", "INT": r"-?\d+", "IP": r"\d{1,3}(?:\.\d{1,3}){3}", "DATA": r".*?", "GREEDYDATA": r".*", "NOTSPACE": r"\S+", "USERNAME": r"[\w.-]+"}


def dissected(df: DataFrame, source: str, pattern: str) -> DataFrame:
    """``%{name}`` between fixed texts."""
    parts = re.split(r"%\{(\w*)\}", pattern)
    regex = "^" + "".join(re.escape(p) if k % 2 == 0 else ("(.*?)" if p else ".*?") for k, p in enumerate(parts)) + "$"
    return commands.extract(df, source, regex, [p for p in parts[1::2] if p])


def grokked(df: DataFrame, source: str, pattern: str) -> DataFrame:
    """``%{KIND:name}`` within a regular expression."""
    names = []

    def part(m: re.Match) -> str:
        if m.group(2):
            names.append(m.group(2))
        return f"({'' if m.group(2) else '?:'}{_GROK[m.group(1)]})"

    return commands.extract(df, source, re.sub(r"%\{(\w+)(?::(\w+))?\}", part, pattern), names)


_TERM = re.compile(r'\s*(\(|\)|(?:NOT|OR|AND)\b|([\w.@]+)\s*(!=|>=|<=|=|>|<)\s*("(?:[^"\\]|\\.)*"|[^\s()]+)|"(?:[^"\\]|\\.)*"|[^\s()]+)')


def search_terms(df: DataFrame, text: str, tables: Tables) -> DataFrame:
    """Base terms: field=value with ``*`` in values, free words in any text column, NOT, OR, brackets; terms in a row are all required."""
    sql: list[str] = []
    texts = [f"`{f.name}`" for f in df.schema.fields if f.dataType.simpleString() == "string"]
    need = False
    for m in _TERM.finditer(text):
        token = m.group(1)
        if token in ("OR", "AND"):
            sql.append(token)
            need = False
            continue
        if token == ")":
            sql.append(")")
            need = True
            continue
        if m.group(2) in ("index", "sourcetype"):
            continue
        if m.group(2) == "earliest":
            if w := re.fullmatch(r"-(\d+)([smhdw])", m.group(4)):
                df = tables.since(df, *w.groups())
            continue
        if m.group(2) == "latest":
            continue
        if need:
            sql.append("AND")
        need = token not in ("(", "NOT")
        if not need:
            sql.append(token)
        elif m.group(2):
            name, op, value = m.group(2), m.group(3), _value(m.group(4))
            if "*" in value and op in ("=", "!="):
                sql.append(("NOT " if op == "!=" else "") + f"({name} rlike {_quoted('^' + _wildcard(value) + '$')})")
            elif re.fullmatch(r"-?\d+(?:\.\d+)?", value):
                sql.append(f"{name} {op} {value}")
            else:
                sql.append(f"lower({name}) {op} {_quoted(value.lower())}")
        else:
            word = _wildcard(_value(token))
            sql.append("(" + (" OR ".join(f"{c} rlike {_quoted(word)}" for c in texts) or "false") + ")")
    return df.filter(" ".join(sql)) if sql else df


def run(text: str, tables: Tables, language: str) -> DataFrame:
    """The plan of a text; language: splunk, eql, esql, kusto or aql."""
    if language not in _RUNNERS:
        raise QueryError(f"unknown language: {language}")
    return _RUNNERS[language](text.strip(), tables)


def _now(df: DataFrame, tables: Tables) -> str:
    if tables.as_of is not None:
        return f"timestamp_ntz '{tables.as_of}'"
    return "current_timestamp()"


def _run_splunk(text: str, t: Tables) -> DataFrame:
    first, *stages = split_outside(text, "|")
    name = re.search(r"\bindex\s*=\s*\"?([\w*.-]+)", first)
    if not first and stages and (m := re.match(r"inputlookup\s+(\S+)", stages[0])):
        df, stages = t.lookup(m.group(1)), stages[1:]
    else:
        df = search_terms(t.scan(name.group(1) if name else "*"), re.sub(r"^search\s+", "", first), t)
    now = _now(df, t)
    for stage in stages:
        command, _, rest = stage.partition(" ")
        df = _splunk_stage(df, command.lower(), rest.strip(), t, now)
    return df


def _splunk_stage(df: DataFrame, command: str, rest: str, t: Tables, now: str) -> DataFrame:
    span = re.search(r"\bspan\s*=\s*(\d+)([smhdw])", rest)
    bare = re.sub(r"\b\w+\s*=\s*\S+\s*", "", rest) if command in ("top", "rare", "dedup") else rest
    if command == "search":
        return search_terms(df, rest, t)
    if command == "where":
        return df.filter(expression(rest, now))
    if command == "eval":
        return assigned(df, rest, now)
    if command in ("stats", "tstats", "mstats", "geostats"):
        if m := re.search(r"\bwhere\s+(.+?)(?=\s+by\s|$)", rest):
            df, rest = search_terms(df, m.group(1), t), rest[: m.start()] + rest[m.end() :]
        return grouped(df, rest, "splunk", now)
    if command == "eventstats":
        what, _, by = rest.partition(" by ")
        named = {a: aggregate(x, now) for x, a in (re.fullmatch(r"(.+?)\s+as\s+(\w+)", p).groups() for p in split_outside(what, ","))}
        return windows.eventstats(df, _names(by), **named)
    if command == "sort":
        m = re.match(r"(\d+)\s+", rest)
        return ordered(df, rest[m.end() :], False).limit(int(m.group(1))) if m and int(m.group(1)) else ordered(df, rest[m.end() :] if m else rest)
    if command == "head":
        return df.limit(int(rest or 10))
    if command == "table":
        return df.select(*_names(rest))
    if command == "fields":
        return df.drop(*_names(rest[1:])) if rest.startswith("-") else df.select(*_names(rest.lstrip("+")))
    if command == "rename":
        return renamed(df, rest)
    if command == "dedup":
        keep = re.match(r"\d+\s+", bare)
        keys = _names(re.split(r"\bsortby\b", bare[keep.end() :] if keep else bare)[0])
        order = re.search(r"\bsortby\s+(.+)$", bare)
        by = [c.lstrip("+") for c in _names(order.group(1))] if order else [f"-{t.time}"]
        return commands.dedup(df, keys, by, int(keep.group()) if keep else 1)
    if command in ("top", "rare"):
        n = re.search(r"(?:limit\s*=\s*|^)(\d+)", rest)
        return commands.top(df, _names(re.sub(r"^\d+", "", bare)), int(n.group(1)) if n else 10, command == "rare")
    if command in ("timechart", "bin", "bucket"):
        width = f"{span.group(1)} {_UNITS[span.group(2)]}" if span else "1 days"
        rest = re.sub(r"\bspan\s*=\s*\S+\s*", "", rest)
        start = F.window(t.time, width).getField("start").alias(t.time)
        if command != "timechart":
            return df.withColumn(rest.strip() or t.time, F.window(rest.strip() or t.time, width).getField("start"))
        parts = re.split(r"\s+by\s+", rest, maxsplit=1)
        return df.groupBy(start, *(_keys(parts[1], now) if len(parts) > 1 else [])).agg(*_aggregates(parts[0], "splunk", now))
    if command == "fillnull":
        value = re.match(r"value\s*=\s*(\"[^\"]*\"|\S+)\s*", rest)
        names = _names(rest[value.end() :] if value else rest)
        v = _value(value.group(1)) if value else "0"
        return df.withColumns({n: F.coalesce(n, F.lit(v).cast(df.schema[n].dataType)) for n in names or df.columns})
    if command == "rex":
        m = re.match(r"(?:field\s*=\s*(\w+)\s+)?(\"(?:[^\"\\]|\\.)*\")", rest)
        pattern = m.group(2)[1:-1].replace('\\"', '"')
        return commands.extract(df, m.group(1) or "_raw", re.sub(r"\(\?P?<\w+>", "(", pattern), re.findall(r"\(\?P?<(\w+)>", pattern))
    if command == "mvexpand":
        return commands.mv_expand(df, rest.strip())
    if command in ("lookup", "iplocation"):
        name, key, *more = re.split(r"[,\s]+", rest)
        other = t.lookup(name)
        out = more[1:] if more and more[0].upper() in ("OUTPUT", "OUTPUTNEW") else [c for c in other.columns if c != key]
        return df.join(other.select(key, *out).dropDuplicates([key]), key, "left")
    if command == "append":
        return commands.append(df, _run_splunk(rest.strip("[] ").removeprefix("search "), t))
    if command == "join":
        m = re.match(r"(?:type\s*=\s*(\w+)\s+)?([\w,\s]+?)\s*\[(.+)\]$", rest, re.S)
        return df.join(_run_splunk(m.group(3).strip().removeprefix("search "), t), _names(m.group(2)), m.group(1) or "inner")
    if command == "transaction":
        pause = re.search(r"max(?:pause|span)\s*=\s*(\d+)([smhd])", rest)
        seconds = int(pause.group(1)) * {"s": 1, "m": 60, "h": 3600, "d": 86400}[pause.group(2)] if pause else 3600
        return windows.sessions(df, _names(re.sub(r"\w+\s*=\s*\S+", "", rest)), t.time, seconds)
    raise QueryError(f"unknown command: {command}")


def _run_esql(text: str, t: Tables) -> DataFrame:
    first, *stages = split_outside(text, "|")
    m = re.fullmatch(r"from\s+(.+)", first, re.I | re.S)
    if not m:
        raise QueryError("a text begins with FROM")
    df = commands.append(*(t.scan(n) for n in _names(m.group(1))))
    now = _now(df, t)
    for stage in stages:
        command, _, rest = stage.partition(" ")
        command, rest = command.lower(), rest.strip()
        if command == "where":
            df = df.filter(expression(rest, now))
        elif command == "stats":
            df = grouped(df, rest, "esql", now)
        elif command == "eval":
            df = assigned(df, rest, now)
        elif command == "sort":
            df = ordered(df, rest)
        elif command == "limit":
            df = df.limit(int(rest))
        elif command == "keep":
            df = df.select(*_names(rest))
        elif command == "drop":
            df = df.drop(*_names(rest))
        elif command == "rename":
            df = renamed(df, rest)
        elif command in ("dissect", "grok"):
            source, pattern = re.fullmatch(r"(\w+)\s+(\".*\")", rest, re.S).groups()
            df = (dissected if command == "dissect" else grokked)(df, source, pattern[1:-1].replace("\\\\", "\\"))
        elif command == "enrich":
            m = re.fullmatch(r"(\S+)\s+on\s+(\w+)(?:\s+with\s+(.+))?", rest, re.I | re.S)
            other = t.lookup(m.group(1))
            df = df.join(other.select(m.group(2), *(_names(m.group(3)) if m.group(3) else [c for c in other.columns if c != m.group(2)])).dropDuplicates([m.group(2)]), m.group(2), "left")
        elif command == "mv_expand":
            df = commands.mv_expand(df, rest)
        else:
            raise QueryError(f"unknown command: {command}")
    return df


def _run_kusto(text: str, t: Tables) -> DataFrame:
    *lets, text = [s for s in split_outside(text, ";") if s]
    for held in lets:
        name, of = re.fullmatch(r"let\s+(\w+)\s*=\s*(.+)", held, re.S).groups()
        text = re.sub(rf"\b{name}\b", lambda m: of, text)  # noqa: B023
    first, *stages = split_outside(text, "|")
    df = _run_kusto(first[1:-1], t) if first.startswith("(") else t.scan(first)
    now = _now(df, t)
    for stage in stages:
        command, _, rest = stage.partition(" ")
        command, rest = command.lower(), rest.strip()
        if command in ("where", "filter"):
            df = df.filter(expression(rest, now))
        elif command == "summarize":
            df = grouped(df, rest, "kusto", now)
        elif command in ("order", "sort"):
            df = ordered(df, rest, falling=True)
        elif command == "top":
            n, by = re.fullmatch(r"(\d+)\s+by\s+(.+)", rest, re.I | re.S).groups()
            df = ordered(df, by, falling=True).limit(int(n))
        elif command in ("take", "limit"):
            df = df.limit(int(rest))
        elif command == "project":
            df = df.select(*(F.expr(expression(p.partition("=")[2], now)).alias(p.partition("=")[0].strip()) if "=" in p else F.col(p) for p in split_outside(rest, ",")))
        elif command == "project-away":
            df = df.drop(*_names(rest))
        elif command == "project-rename":
            df = renamed(df, rest)
        elif command == "extend":
            df = assigned(df, rest, now)
        elif command == "distinct":
            df = df.select(*_names(rest)).distinct() if rest != "*" else df.distinct()
        elif command == "count":
            df = df.agg(F.count(F.lit(1)).alias("Count"))
        elif command == "join":
            m = re.fullmatch(r"(?:kind\s*=\s*(\w+)\s+)?(\(.+\)|\w+)\s+on\s+(.+)", rest, re.I | re.S)
            kind = {"leftouter": "left", "rightouter": "right", "fullouter": "full", "leftanti": "left_anti", "leftsemi": "left_semi", None: "inner", "inner": "inner", "innerunique": "inner"}[(m.group(1) or "").lower() or None]
            df = df.join(_run_kusto(m.group(2), t), _names(m.group(3)), kind)
        elif command == "union":
            df = commands.append(df, *(_run_kusto(n, t) for n in split_outside(rest, ",")))
        elif command == "mv-expand":
            df = commands.mv_expand(df, rest)
        elif command == "parse":
            source, pattern = re.fullmatch(r"(\w+)\s+with\s+(.+)", rest, re.S).groups()
            regex, names = "", []
            for token in re.findall(r'"(?:[^"\\]|\\.)*"|\*|\w+(?::\w+)?', pattern):
                if token[0] == '"':
                    regex += re.escape(_value(token))
                elif token == "*":
                    regex += ".*?"
                else:
                    names.append(token.partition(":")[0])
                    regex += "(.*?)"
            df = commands.extract(df, source, f"^{regex}$", names)
        else:
            raise QueryError(f"unknown command: {command}")
    return df


def _run_aql(text: str, t: Tables) -> DataFrame:
    text = text.rstrip("; \n")
    m = re.search(r"\bfrom\s+(\w+)", text, re.I)
    if not m:
        raise QueryError("a text needs FROM")
    df = t.scan(m.group(1))
    if last := re.search(r"\blast\s+(\d+)\s+(seconds?|minutes?|hours?|days?|weeks?)\s*$", text, re.I):
        df, text = t.since(df, last.group(1), last.group(2)), text[: last.start()]
    if span := re.search(r"\bstart\s+'([^']+)'\s+stop\s+'([^']+)'\s*$", text, re.I):
        df, text = df.filter(F.col(t.time).between(F.lit(span.group(1)).cast("timestamp_ntz"), F.lit(span.group(2)).cast("timestamp_ntz"))), text[: span.start()]
    text = text[: m.start()] + "FROM {scanned}" + text[m.end() :]
    text = re.sub(r"\bdateformat\s*\(", "date_format(", text, flags=re.I)
    text = re.sub(r"\bincidr\(\s*'([^']+)'\s*,\s*([\w.]+)\s*\)", lambda c: _cidr(c.group(2), c.group(1)), text, flags=re.I)
    text = re.sub(r"\buniquecount\(\s*([\w.]+)\s*\)", r"count(distinct \1)", text, flags=re.I)
    for call, name in re.findall(r"\b((?:logsource|category|network|qid)name)\(\s*(\w+)\s*\)", text, re.I):
        names = t.lookup(call.lower())  # (key, name)
        key, shown = names.columns[:2]
        df = df.join(names.select(F.col(key).alias(name), F.col(shown).alias(f"_{call.lower()}_{name}")).dropDuplicates([name]), name, "left")
        text = re.sub(rf"\b{call}\(\s*{name}\s*\)", f"_{call.lower()}_{name}", text, flags=re.I)
    text = re.sub(r'"([^"]+)"', r"`\1`", text)
    return df.sparkSession.sql(text, scanned=df)


def _event_query(text: str, t: Tables) -> DataFrame:
    """``category where condition``; ``any`` for all categories."""
    m = re.fullmatch(r"\s*(\w+)\s+where\s+(.+?)\s*", text, re.I | re.S)
    if not m:
        raise QueryError(f"no event query: {text}")
    df = t.scan("*" if m.group(1).lower() == "any" else m.group(1))
    return df if m.group(2).lower() == "true" else df.filter(expression(re.sub(r":(?=\s*\")", " =~", m.group(2)), _now(df, t)))


def _bracketed(text: str) -> list[str]:
    """The contents of the outer square brackets."""
    found, depth, at, k = [], 0, 0, 0
    while k < len(text):
        if m := (_LITERAL.match(text, k) if text[k] in "\"'" else None):
            k = m.end()
            continue
        if text[k] == "[":
            depth += 1
            at = k + 1 if depth == 1 else at
        elif text[k] == "]":
            depth -= 1
            if not depth:
                found.append(text[at:k])
        k += 1
    return found


def _run_eql(text: str, t: Tables) -> DataFrame:
    from vigilframe.plans.compile import Options, sequence
    from vigilframe.plans.fields import Binding

    first, *stages = split_outside(text, "|")
    if m := re.match(r"(sequence|sample)\s+by\s+(\w+)(?:\s+with\s+maxspan\s*=\s*(\d+[smhd]))?\s*", first, re.I):
        until = re.search(r"\buntil\s*\[", first, re.I)
        steps = [_event_query(x, t) for x in _bracketed(first[m.end() : until.start() if until else None])]
        if m.group(1).lower() == "sample":
            df = commands.sample_sequence(steps, m.group(2))
        else:
            gap = m.group(3)
            chains = sequence([(s, None, gap if k else None) for k, s in enumerate(steps)], m.group(2), t.time, Binding(), Options(max_span=gap))
            df = commands.sequence_until(chains, _event_query(_bracketed(first[until.start() :])[0], t), m.group(2), t.time, "step_1_time", f"step_{len(steps)}_time") if until else chains
    else:
        df = _event_query(first, t)
    now = _now(df, t)
    for stage in stages:
        command, _, rest = stage.partition(" ")
        command, rest = command.lower(), rest.strip()
        if command in ("filter", "where"):
            df = df.filter(expression(rest, now))
        elif command == "stats":
            df = grouped(df, rest, "eql", now)
        elif command == "sort":
            df = ordered(df, rest)
        elif command == "head":
            df = df.limit(int(rest or 10))
        elif command == "tail":
            df = commands.tail(df, [t.time], int(rest or 10))
        elif command == "unique":
            df = commands.dedup(df, _names(rest), [t.time])
        elif command == "count":
            df = df.groupBy(*_names(rest)).agg(F.count(F.lit(1)).alias("count"))
        else:
            raise QueryError(f"unknown command: {command}")
    return df


_RUNNERS = {"splunk": _run_splunk, "eql": _run_eql, "esql": _run_esql, "kusto": _run_kusto, "aql": _run_aql}
