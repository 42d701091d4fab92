"""From a question to a query document: a protocol, and a deterministic parser that works by rules."""

from __future__ import annotations

import re
from typing import Protocol

_EVENT_WORDS = (
    ("authentication", r"log(?:in|on)s?|sign-?ins?|password|accounts?|authenticat"), ("dns", r"\bdns\b|lookups?|name answers|domain"), ("process", r"process|shells?|programs?|memory|\.exe|jobs?"),
    ("registry", r"registry|autostart|service keys?|\bkeys?\b"), ("file", r"files?|documents?|archives?|downloads?|deletions?"), ("http", r"http|pages?|uploads?|forms?|requests?"), ("network", r"network|connections?|flows?|ports?|desktop|share"),
)
_UNITS = {"s": "s", "m": "m", "h": "h", "d": "d", "w": "d"}


class Parser(Protocol):
    def __call__(self, text: str) -> dict: ...


def rule_parser(text: str) -> dict:
    """A document from plain phrases: what is counted, how many, per what, within which time, containing what."""
    low = " ".join((text or "").lower().split())
    document: dict = {"action": "filter", "event_type": next((t for t, p in _EVENT_WORDS if re.search(p, low)), "any"), "nl_query": text}
    if m := re.search(r"(\d+)[\s-]*(seconds?|secs?|minutes?|mins?|min|hours?|hrs?|h|days?|d|weeks?)\b", low):
        n = int(m[1]) * (7 if m[2].startswith("w") else 1)
        document["time_window"] = {"duration": f"{n}{_UNITS[m[2][0]]}"}
    conditions = []
    if m := re.search(r"(\w+) (?:mentions|contains|matching|naming) (\S+)", low):
        conditions.append({"field": m[1] if m[1] in ("category", "command_line", "file_name", "user", "status") else "category", "op": "contains", "value": m[2].strip(".,?")})
    if re.search(r"\bfail|rejected|locked|forbidden|blocked", low):
        conditions.append({"field": "status", "op": "eq", "value": "failed"})
    if conditions:
        document["filter"] = {"operator": "and", "conditions": conditions}
    m = re.search(r"(more than|over|exceeding|at least|beyond|upwards of)\s+(\d+)|(\d+) or more", low)
    by = re.search(r"\b(?:per|by|every|each|which)\s+(src ip|dest ip|dest port|source ip|user|host|file name|process name|query domain)", low)
    if m:
        key = by[1].replace("source ip", "src ip").replace(" ", "_") if by else None
        document |= {"action": "filter+aggregate", "aggregation": {"function": "count", "group_by": [key] if key else [], "alias": "event_count"}}
        document["threshold"] = {"field": "event_count", "op": "gte" if m[3] or m[1] == "at least" else "gt", "value": int(m[2] or m[3])}
    return document
