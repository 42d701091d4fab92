"""Rendering of queries as text.

One walk over a query serves all languages; a ``Grammar`` says how a language writes a condition, joins
conditions, aggregates and so on.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any
from xml.sax.saxutils import escape

from vigilframe.dialects import Dialect, register
from vigilframe.plans.compile import SEQUENCE_KEYS
from vigilframe.plans.fields import STATUS_VALUES, platform_field
from vigilframe.plans.query import Condition, Group, Query

_SIGNS = {"neq": "!=", "gt": ">", "gte": ">=", "lt": "<", "lte": "<="}


@dataclass
class Grammar:
    platform: str
    quote: str = '"'
    joiners: dict[str, str] = field(default_factory=dict)
    negation: str = "not ({})"
    signs: dict[str, str] = field(default_factory=dict)
    shapes: dict[str, str] = field(default_factory=dict)  # operator -> template with {f}, {v} (raw) and {q} (quoted), {l} (list)
    separator: str = ", "
    statuses: bool = False

    def name(self, canonical: str) -> str:
        return platform_field(canonical, self.platform)

    def literal(self, v: Any) -> str:
        return f"{self.quote}{v}{self.quote}" if isinstance(v, str) else str(v)

    def condition(self, c: Condition) -> str:
        op, value, f = c.op, c.value, self.name(c.field)
        listed = isinstance(value, (list, tuple))
        if op in ("in", "not_in") and not listed and "l1" not in self.shapes:
            op = "eq" if op == "in" else "neq"
        if self.statuses and c.field == "status" and op in ("eq", "neq") and isinstance(value, str):
            value = STATUS_VALUES.get(value.lower(), value)
        items = self.separator.join(map(self.literal, value if listed else [value]))
        shape = self.shapes.get(op) or "{f} " + self.signs.get(op, _SIGNS.get(op, "=")) + " {q}"
        text = shape.format(f=f, v=value, q=self.literal(value), l=items)
        return self.negation.format(text) if c.negate else text

    def tree(self, g: Group | None) -> str:
        """A filter; a NOT group negates the conjunction of its members."""
        if g is None:
            return ""
        parts = []
        for c in g.conditions:
            part = f"({self.tree(c)})" if isinstance(c, Group) else self.condition(c)
            if part not in ("", "()"):
                parts.append(part)
        if g.operator == "not":
            return self.negation.format(self.joiners["and"].join(parts)) if parts else ""
        return self.joiners[g.operator].join(parts)

    def order(self, q: Query, down: str, up: str) -> str:
        if q.sort_by:
            return (down if q.sort_order == "desc" else up).format(self.name(q.sort_by))
        return down.format(q.aggregation.alias) if q.aggregation and q.aggregation.alias else ""

    def measure(self, q: Query, functions: dict[str, str], anything: str) -> str:
        a = q.aggregation
        return functions.get(a.function, a.function + "({})").format(self.name(a.field) if a.field else anything)


def _number(v: float) -> str:
    return f"{v:g}" if isinstance(v, float) and v == int(v) and abs(v) < 1e15 else str(v)


_SPL = Grammar("splunk", joiners={"and": " ", "or": " OR "}, negation="NOT ({})", separator=" ", shapes={"eq": "{f}={q}", "neq": "{f}!={q}", "gt": "{f}>{q}", "gte": "{f}>={q}", "lt": "{f}<{q}", "lte": "{f}<={q}", "contains": '{f}="*{v}*"', "regex": '{f}=~"{v}"', "in": "{f} IN ({l})", "not_in": "NOT {f} IN ({l})"})
_AQL = Grammar("qradar", quote="'", joiners={"and": " AND ", "or": " OR "}, negation="NOT ({})", signs={"eq": "=", "neq": "<>"}, shapes={"contains": "{f} ILIKE '%{v}%'", "regex": "{f} MATCHES '{v}'", "in": "{f} IN ({l})", "not_in": "{f} NOT IN ({l})", "l1": ""})
_EQL = Grammar("elastic", joiners={"and": " and ", "or": " or "}, signs={"eq": "=="}, statuses=True, shapes={"contains": '{f} like~ "*{v}*"', "regex": 'match({f}, "{v}")', "in": "{f} in ({l})", "not_in": "{f} not in ({l})"})
_KQL = Grammar("elastic", joiners={"and": " AND ", "or": " OR "}, negation="NOT ({})", separator=" or ", statuses=True, shapes={"eq": "{f}: {q}", "neq": "NOT {f}: {q}", "contains": "{f}: *{v}*", "regex": "{f}: {v}", "in": "{f}: ({l})", "not_in": "NOT {f}: ({l})", "gt": "{f} > {v}", "gte": "{f} >= {v}", "lt": "{f} < {v}", "lte": "{f} <= {v}"})
_KUSTO = Grammar("sentinel", joiners={"and": " and ", "or": " or "}, signs={"eq": "=="}, shapes={"contains": '{f} has "{v}"', "regex": '{f} matches regex "{v}"', "in": "{f} in ({l})", "not_in": "{f} !in ({l})"})

# What each event type is called.
_TABLES = {"authentication": "SecurityEvent", "network": "NetworkAnalytics", "process": "DeviceProcessEvents", "file": "DeviceFileEvents", "registry": "DeviceRegistryEvents", "dns": "DnsEvents", "http": "DeviceNetworkEvents", "any": "SecurityEvent"}
_CATEGORIES = {"http": "web"}
_RULES = {"authentication": ("authentication_failures", "5503", 10), "network": ("network_scan", "40101", 8), "process": ("syscheck", "554", 12), "file": ("syscheck", "554", 10), "registry": ("windows_registry", "750", 10), "dns": ("dns_query", "82200", 6), "http": ("web,attack", "31100", 8), "any": ("local", None, 5)}
_SAME = {"srcip": "same_source_ip", "dstip": "same_destination_ip", "dstuser": "same_user", "hostname": "same_location"}
RULE_ID = 100002


def _pipes(parts: list[str], glue: str = "\n| ") -> str:
    return glue.join(p for p in parts if p)


def spl(q: Query) -> str:
    g = _SPL
    head = " ".join(p for p in ("index=*", f"earliest=-{q.time_window.duration} latest=now" if q.time_window else "", g.tree(q.filter)) if p)
    if q.action == "sequence":
        span = next((s.within for s in reversed(q.sequence) if s.within), "30m")
        return _pipes([head, "\n".join([f"transaction maxspan={span}", *(f"  [search {g.tree(s.filter)}]" for s in q.sequence if s.filter)])])
    parts = [head]
    if look := q.lookup:
        parts.append(f"lookup {look.lookup_table} {g.name(look.match_field)}" + (f" OUTPUT {look.output_field}" if look.output_field else ""))
        if look.filter_on_match:
            parts.append(f"where isnotnull({look.output_field or g.name(look.match_field)})")
    if q.aggregates:
        by = ", ".join(map(g.name, q.aggregation.group_by))
        parts.append(f"stats {g.measure(q, {'count': 'count', 'distinct_count': 'dc({})'}, '_raw')} as {q.aggregation.output}" + (f" by {by}" if by else ""))
    if t := q.threshold:
        parts.append(f"where {q.threshold_name} {_AQL.signs.get(t.op, '') if t.op == 'eq' else _SIGNS.get(t.op, '>')} {_number(t.value)}")
    parts.append(g.order(q, "sort -{}", "sort {}"))
    parts.append(f"head {q.limit}" if q.limit else "")
    parts.append("table " + ", ".join(map(g.name, q.fields)) if q.fields else "")
    return _pipes(parts)


def aql(q: Query) -> str:
    g = _AQL
    chosen = [g.name(f) for f in q.fields]
    if q.aggregates:
        chosen = [*map(g.name, q.aggregation.group_by)]
        chosen += [g.name(f) for f in q.fields if f != q.aggregation.output]
        chosen.append(f"{g.measure(q, {'count': 'COUNT(*)', 'distinct_count': 'COUNT(DISTINCT {})', 'sum': 'SUM({})', 'avg': 'AVG({})', 'min': 'MIN({})', 'max': 'MAX({})'}, '*')} AS {q.aggregation.output}")
    lines = ["SELECT " + (", ".join(dict.fromkeys(chosen)) or "*"), "FROM events"]
    where = [p for p in (g.tree(q.filter), f"{g.name(q.lookup.match_field)} IN (SELECT value FROM {q.lookup.lookup_table})" if q.lookup else "") if p]
    if where:
        lines.append("WHERE " + " AND ".join(f"({p})" if len(where) > 1 and " OR " in p else p for p in where))
    if q.aggregates and q.aggregation.group_by:
        lines.append("GROUP BY " + ", ".join(map(g.name, q.aggregation.group_by)))
    if t := q.threshold:
        lines.append(f"HAVING {q.threshold_name} {g.signs.get(t.op, _SIGNS.get(t.op, '>'))} {_number(t.value)}")
    lines.append(g.order(q, "ORDER BY {} DESC", "ORDER BY {} ASC"))
    lines.append(f"LIMIT {q.limit}" if q.limit else "")
    if q.time_window:
        unit = {"s": "SECONDS", "m": "MINUTES", "h": "HOURS", "d": "DAYS"}[q.time_window.duration[-1]]
        lines.append(f"LAST {q.time_window.duration[:-1]} {unit}")
    return "\n".join(x for x in lines if x)


def _category(event_type: str) -> str:
    return _CATEGORIES.get(event_type, event_type)


def elastic(q: Query) -> str:
    """A field query for plain filters and lookups, else an event query or a sequence."""
    if q.action == "sequence":
        used = {c.field for s in q.sequence if s.filter for c in s.filter.conditions if isinstance(c, Condition)}
        key = next((k for k in SEQUENCE_KEYS if k in used), None)
        span = next((s.within for s in reversed(q.sequence) if s.within), None)
        head = "sequence" + (f" by {_EQL.name(key)}" if key else "") + (f" with maxspan={span}" if span else "")
        return "\n".join([head, *(f"  [{_category(s.event_type)} where {_EQL.tree(s.filter) or 'true'}]" for s in q.sequence)])
    if q.action == "lookup":
        name = _KQL.name(q.lookup.match_field)
        return "\n".join(p for p in (_KQL.tree(q.filter), f"// Enrich: match {name} against '{q.lookup.lookup_table}'", f"{name}: *" if q.lookup.filter_on_match else "") if p)
    if q.action == "filter" and not q.aggregation:
        parts = [p for p in ("" if q.event_type == "any" else f'event.category: "{_category(q.event_type)}"', _KQL.tree(q.filter)) if p]
        text = " AND ".join(f"({p})" if " OR " in p and len(parts) > 1 else p for p in parts) or "*"
        return text + (f"\n// Time range: last {q.time_window.duration}" if q.time_window else "")
    lines = [f"{_category(q.event_type)} where {_EQL.tree(q.filter) or 'true'}" + (f"  // from now-{q.time_window.duration}" if q.time_window else "")]
    if q.aggregates:
        by = ", ".join(map(_EQL.name, q.aggregation.group_by))
        lines.append(f"| stats {_EQL.measure(q, {'count': 'count(*)', 'distinct_count': 'unique_count({})'}, '*')} as {q.aggregation.output}" + (f" by {by}" if by else ""))
    if t := q.threshold:
        lines.append(f"| where {q.threshold_name} {_EQL.signs.get(t.op, _SIGNS.get(t.op, '>'))} {_number(t.value)}")
    order = _EQL.order(q, "| sort {} desc", "| sort {} asc")
    return "\n".join(x for x in (*lines, order, f"| head {q.limit}" if q.limit else "") if x)


def kusto(q: Query) -> str:
    g, table = _KUSTO, _TABLES[q.event_type]
    parts = [table, f"where TimeGenerated > ago({q.time_window.duration})" if q.time_window else "", f"where {g.tree(q.filter)}" if g.tree(q.filter) else ""]
    for s in (q.sequence or ())[1:] if q.action == "sequence" else ():
        inner = f"join kind=inner (\n    {_TABLES[s.event_type]}\n    | where {g.tree(s.filter) or 'true'}\n) on Account, Computer"
        parts.append(inner)
        parts.append(f"where TimeGenerated1 > TimeGenerated and TimeGenerated1 - TimeGenerated <= {s.within}" if s.within else "")
    if q.lookup:
        kind = "inner" if q.lookup.filter_on_match else "leftouter"
        parts.append(f"join kind={kind} (\n    _GetWatchlist('{q.lookup.lookup_table}')\n    | project SearchKey\n) on $left.{g.name(q.lookup.match_field)} == $right.SearchKey")
    if q.aggregates:
        by = ", ".join(map(g.name, q.aggregation.group_by))
        parts.append(f"summarize {q.aggregation.output} = {g.measure(q, {'count': 'count()', 'distinct_count': 'dcount({})'}, '*')}" + (f" by {by}" if by else ""))
    if t := q.threshold:
        parts.append(f"where {q.threshold_name} {g.signs.get(t.op, _SIGNS.get(t.op, '>'))} {_number(t.value)}")
    parts.append(g.order(q, "order by {} desc", "order by {} asc"))
    parts.append(f"take {q.limit}" if q.limit else "")
    parts.append("project " + ", ".join(dict.fromkeys(map(g.name, q.fields))) if q.fields else "")
    return _pipes(parts)


def rule_xml(q: Query) -> str:
    group, parent, level = _RULES[q.event_type]
    lines = [f'<rule id="{RULE_ID}" level="{level}">']

    def tag(name: str, text: Any, **attributes: str) -> None:
        attrs = "".join(f' {k}="{escape(str(v), {chr(34): "&quot;"})}"' for k, v in attributes.items())
        lines.append(f"  <{name}{attrs}>{escape(str(text))}</{name}>")

    def walk(g: Group | None, negated: bool = False) -> None:
        for c in g.conditions if g else ():
            if isinstance(c, Group):
                walk(c, negated ^ (g.operator == "not"))
                continue
            no = {"negate": "yes"} if (c.negate ^ negated ^ (g.operator == "not") ^ (c.op in ("neq", "not_in"))) else {}
            if c.op == "eq" and c.field in ("event_id", "event_type", "category"):
                tag("id", c.value, **no)
            elif c.op in ("eq", "neq", "contains"):
                tag("match", c.value, **no)
            elif c.op == "regex":
                tag("regex", c.value, **no)
            elif c.op in ("in", "not_in"):
                for v in c.value if isinstance(c.value, (list, tuple)) else [c.value]:
                    tag("match", v, **no)
            elif c.op != "gt":
                tag("field", c.value, name=platform_field(c.field, "wazuh"), **no)

    if parent:
        tag("if_sid", parent)
    walk(q.filter)
    if q.aggregates:
        for k in q.aggregation.group_by:
            lines.append(f"  <{_SAME.get(platform_field(k, 'wazuh'), 'same_source_ip')}/>")
    if q.threshold:
        tag("frequency", _number(q.threshold.value))
    if q.time_window:
        tag("timeframe", q.time_window.seconds)
    tag("group", group + ",")
    parts = [q.tactic.replace("_", " ").title() if q.tactic else "", f"{q.event_type} event" if q.event_type != "any" else "", f"threshold {_number(q.threshold.value)}" if q.threshold else "", f"in {q.time_window.duration}" if q.time_window else ""]
    tag("description", q.nl_query[:120] if q.nl_query else ", ".join(p for p in parts if p) or "Custom detection rule")
    if q.technique_id:
        lines += ["  <mitre>", f"    <id>{escape(q.technique_id)}</id>", "  </mitre>"]
    return "\n".join([*lines, "</rule>"])


_BUILT_IN: dict[str, Callable[[Query], str]] = {"splunk": spl, "qradar": aql, "elastic": elastic, "sentinel": kusto, "wazuh": rule_xml}
for _platform, _render in _BUILT_IN.items():
    register(Dialect(_platform, _render))


def esql(q: Query, index: str = "events") -> str:
    """The query in the piped language, straight from the query rather than from another text."""
    g = Grammar("elastic", joiners={"and": " AND ", "or": " OR "}, negation="NOT ({})", signs={"eq": "=="}, statuses=True, shapes={"contains": '{f} LIKE "*{v}*"', "regex": '{f} RLIKE "{v}"', "in": "{f} IN ({l})", "not_in": "{f} NOT IN ({l})"})
    where = [p for p in (f'event.category == "{_category(q.event_type)}"' if q.event_type != "any" else "", g.tree(q.filter), f"@timestamp >= NOW() - {q.time_window.seconds} seconds" if q.time_window else "") if p]
    parts = [f"FROM {index}", "WHERE " + " AND ".join(f"({p})" if " OR " in p and len(where) > 1 else p for p in where) if where else ""]
    if q.aggregates:
        by = ", ".join(map(g.name, q.aggregation.group_by))
        parts.append(f"STATS {q.aggregation.output} = {g.measure(q, {'count': 'COUNT(*)', 'distinct_count': 'COUNT_DISTINCT({})', 'sum': 'SUM({})', 'avg': 'AVG({})', 'min': 'MIN({})', 'max': 'MAX({})'}, '*')}" + (f" BY {by}" if by else ""))
    if t := q.threshold:
        parts.append(f"WHERE {q.threshold_name} {g.signs.get(t.op, _SIGNS.get(t.op, '>'))} {_number(t.value)}")
    parts.append(g.order(q, "SORT {} DESC", "SORT {} ASC"))
    parts.append(f"LIMIT {q.limit}" if q.limit else "")
    if q.fields and not q.aggregates:
        parts.append("KEEP " + ", ".join(dict.fromkeys(map(g.name, q.fields))))
    return _pipes(parts)
