"""Two further levels of static checks: the gate that generated texts must pass, and a renderer's check of its own output.

Both are tables of findings per platform, asked in order; the first that holds is the error.  They look at plain bars and
substrings, other than the graded checks of ``checking``, which leave literals out and give partial credit.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that each level knows.
GATE_COMMANDS = "stats where eval table sort head tail dedup rex lookup transaction timechart top rare fields rename search inputlookup outputlookup tstats mstats bin chart geostats streamstats eventstats appendcols join append".split()
GATE_OPERATORS = "where summarize project project-away project-rename order sort top extend join union let render take limit count distinct evaluate parse mv-expand make-series bin range".split()
GATE_TABLES = "securityevent syslog signinlogs networkanalytics dnsevents deviceprocessevents devicefileevents devicenetworkevents deviceregistryevents azureactivity auditlogs aadnoninteractiveusersigninlogs officeactivity commonsecuritylog windowsevent heartbeat".split()
CATEGORIES = "authentication network process file registry dns web any".split()
OWN_COMMANDS = "stats where eval table sort head tail dedup rex lookup transaction timechart top rare fields rename".split()
OWN_PIPES = "stats where sort head tail".split()
OWN_OPERATORS = "where summarize project order top extend join union let render".split()
AGGREGATES = ["COUNT(", "SUM(", "AVG(", "MIN(", "MAX("]


@dataclass
class Text:
    """A text in the forms in which it is looked at."""

    trimmed: Column

    def __post_init__(self) -> None:
        self.low, self.up = F.lower(self.trimmed), F.upper(self.trimmed)
        # the first word behind every bar, empty where there is none
        self.heads = F.transform(F.slice(F.split(self.low, r"\|"), 2, 1_000_000), lambda s: F.regexp_extract(s, r"^\s*(\S+)", 1))
        self.word = F.regexp_extract(self.low, r"^(\S+)", 1)

    @cached_property
    def parts(self) -> Column:
        """The parts of a rule document, read once for all findings."""
        return F.pandas_udf(_all_parts, "sound boolean, tag string, id string, level string, described boolean, id_number long, level_number long")(self.trimmed)

    def any_of(self, parts: list[str]) -> Column:
        return F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(self.up, p))

    def begins(self, *parts: str) -> Column:
        found = F.lit(False)
        for p in parts:
            found = found | F.startswith(self.low, F.lit(p))
        return found

    def strange(self, words: list[str], blank: bool) -> Column:
        """Whether a head isn't among the words; ``blank``: an empty one doesn't matter."""
        return F.exists(self.heads, lambda h: ~h.isin(words) & ((h != "") if blank else F.lit(True)))


Finding = tuple[str, Callable[[Text], Column]]

_AQL: list[Finding] = [
    ("missing_keyword", lambda t: ~F.startswith(t.up, F.lit("SELECT"))),
    ("missing_keyword", lambda t: ~t.any_of(["FROM EVENTS", "FROM FLOWS", "FROM ASSETS"])),
    ("missing_aggregate", lambda t: t.any_of(["GROUP BY"]) & ~t.any_of(AGGREGATES)),
]
GATE: dict[str, list[Finding]] = {
    "splunk": [
        ("missing_keyword", lambda t: ~t.begins("index=", "search", "*")),
        ("unknown_command", lambda t: t.strange(GATE_COMMANDS, True)),
    ],
    "qradar": [*_AQL, ("malformed_syntax", lambda t: t.any_of(["HAVING"]) & ~t.any_of(["GROUP BY"]))],
    "elastic": [
        ("missing_keyword", lambda t: t.word.isin(CATEGORIES[:-1]) & ~F.contains(t.low, F.lit("where"))),
        ("malformed_syntax", lambda t: (t.word == "sequence") & ~(F.contains(t.low, F.lit("[")) & F.contains(t.low, F.lit("]")))),
        ("malformed_syntax", lambda t: ~t.word.isin([*CATEGORIES, "sequence"]) & ~F.contains(t.low, F.lit(":")) & (t.low != "*") & ~t.low.rlike(r"\b\w+\s*(>|>=|<|<=)\s*\d+")),
    ],
    "sentinel": [
        ("malformed_syntax", lambda t: ~F.contains(t.low, F.lit("|"))),
        ("unknown_command", lambda t: t.strange(GATE_OPERATORS, True)),
    ],
    "wazuh": [
        ("invalid_xml", lambda t: ~t.parts["sound"]),
        ("malformed_syntax", lambda t: t.parts["tag"] != "rule"),
        ("field_error", lambda t: t.parts["id"].isNull() | t.parts["level"].isNull()),
        ("missing_keyword", lambda t: ~t.parts["described"]),
        ("field_error", lambda t: t.parts["id_number"].isNull() | t.parts["level_number"].isNull()),
    ],
}
WARNINGS: dict[str, list[tuple[str, Callable[[Text], Column]]]] = {
    "splunk": [("aggregates all events", lambda t: F.contains(t.low, F.lit("| stats")) & ~F.contains(t.low, F.lit(" by ")))],
    "qradar": [("no time range", lambda t: ~t.any_of(["LAST", "START", "STOP"]))],
    "sentinel": [("table not known", lambda t: ~F.trim(F.regexp_extract(t.low, r"^([^|\n]*)", 1)).isin(GATE_TABLES))],
    "wazuh": [("reserved rule id", lambda t: t.parts["id_number"] < 100_000), ("level out of range", lambda t: ~t.parts["level_number"].between(0, 15))],
}
OWN: dict[str, list[Finding]] = {
    "splunk": [GATE["splunk"][0], ("unknown_command", lambda t: t.strange(OWN_COMMANDS, False))],
    "qradar": [_AQL[0], ("missing_keyword", lambda t: ~t.any_of(["FROM EVENTS", "FROM FLOWS"])), _AQL[2]],
    "elastic": [
        GATE["elastic"][1],
        ("missing_keyword", lambda t: t.word.isin(CATEGORIES) & ~F.contains(t.low, F.lit("where"))),
        ("unknown_command", lambda t: t.word.isin(CATEGORIES) & t.strange(OWN_PIPES, True)),
        ("malformed_syntax", lambda t: ~t.word.isin([*CATEGORIES, "sequence"]) & ~F.contains(t.low, F.lit(":")) & (t.low != "*") & ~t.low.rlike(r"\b\w[\w.]+\s*(>=|<=|>|<)\s*\d")),
    ],
    "sentinel": [GATE["sentinel"][0], ("unknown_command", lambda t: t.strange(OWN_OPERATORS, False))],
    "wazuh": [*GATE["wazuh"][:4], ("field_error", lambda t: t.parts["id_number"].isNull())],
}


def _number(text: str | None) -> int | None:
    try:
        return max(min(int(text), 2**62), -(2**62)) if text is not None else None
    except ValueError:
        return None


def _parts(text: str | None) -> tuple:
    try:
        # declarations of entities are refused, so nothing is expanded
        root = ElementTree.fromstring(text) if text and "<!" not in text.replace("<!--", "") else None
    except ElementTree.ParseError:
        root = None
    if root is None:
        return False, None, None, None, False, None, None
    return True, root.tag, root.get("id"), root.get("level"), root.find("description") is not None, _number(root.get("id")), _number(root.get("level"))


def _all_parts(texts: pd.Series) -> pd.DataFrame:
    known = {t: _parts(t) for t in texts.unique()}
    names = ["sound", "tag", "id", "level", "described", "id_number", "level_number"]
    return pd.DataFrame([known[t] for t in texts], columns=names).astype({"id_number": "Int64", "level_number": "Int64"})


def _text(query: Column) -> Text:
    return Text(F.regexp_replace(F.coalesce(query, F.lit("")), r"^\s+|\s+$", ""))


def _error(t: Text, findings: list[Finding]) -> Column:
    found = F.when(t.trimmed == "", "empty_query")
    for error, holds in findings:
        found = found.when(holds(t), error)
    return found


def gate(platform: str, query: Column) -> Column:
    """struct(is_valid, error_type, warnings, corrected) of texts of one platform; an unknown platform passes with a warning."""
    t = _text(query)
    error = _error(t, GATE.get(platform, []))
    told = WARNINGS.get(platform, []) if platform in GATE else [("no check for this platform", lambda _: F.lit(True))]
    warnings = F.array_compact(F.array(*(F.when(holds(t), text) for text, holds in told))) if told else F.array().cast("array<string>")
    corrected = F.when((error == "missing_keyword") & ~F.startswith(t.low, F.lit("index")), F.concat(F.lit("index=* "), t.trimmed)) if platform == "splunk" else F.lit(None).cast("string")
    return F.struct(error.isNull().alias("is_valid"), error.alias("error_type"), F.when(error.isNull(), warnings).otherwise(F.array().cast("array<string>")).alias("warnings"), corrected.alias("corrected"))


def own_check(platform: str, query: Column) -> Column:
    """Whether a renderer's output has the shape of its language.  Comment lines of event queries are left out; no text fails."""
    if platform not in OWN:
        raise ValueError(f"unknown platform: {platform}")
    if platform == "elastic":
        query = F.array_join(F.filter(F.split(query, "\n"), lambda line: ~F.startswith(F.ltrim(line), F.lit("//"))), "\n")
    return _error(_text(query), OWN[platform]).isNull()
