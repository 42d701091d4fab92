"""Static checks of query texts as Column expressions, with and without partial credit, and the classes of errors."""

from __future__ import annotations

import functools
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The commands, tables and tags that the checks accept.
SPL_COMMANDS = "append appendcols bin chart dedup eval eventstats fields filldown fillnull foreach geostats head inputlookup iplocation join lookup makeresults mstats outputlookup rare rename rex search sort stats streamstats table tail timechart top transaction tstats where".split()
EQL_CATEGORIES = "any authentication dns file network process registry web".split()
ESQL_COMMANDS = "dissect drop enrich eval from grok keep limit mv_expand rename sort stats where".split()
KUSTO_TABLES = "aadnoninteractiveusersigninlogs alert auditlogs azureactivity commonsecuritylog deviceevents devicefileevents devicenetworkevents deviceprocessevents deviceregistryevents dnsevents heartbeat networkanalytics officeactivity securityalert securityevent securityincident signinlogs syslog threatintelligenceindicator windowsevent".split()
KUSTO_OPERATORS = "bin count distinct evaluate extend join let limit make-series mv-expand order parse project project-away project-rename range render sort summarize take top union where".split()
RULE_TAGS = "action category check_if_ignored decoded_as description extra_data field frequency group hostname id if_group if_level if_sid list match mitre options program_name regex same_destination_ip same_location same_source_ip same_user timeframe".split()

CHECK = "struct<is_valid:boolean,error_type:string,structural_score:double,keyword_coverage:double,warnings:array<string>>"


def _result(valid: bool, error: str | None, structure: float, coverage: Column | float, warnings: Column | None = None) -> Column:
    coverage = coverage if isinstance(coverage, Column) else F.lit(float(coverage))
    return F.struct(
        F.lit(valid).alias("is_valid"), F.lit(error).cast("string").alias("error_type"), F.lit(float(structure)).alias("structural_score"), F.round(coverage.cast("double"), 4).alias("keyword_coverage"),
        (warnings if warnings is not None else F.array().cast("array<string>")).alias("warnings"),
    )


def _first(cases: list[tuple[Column, Column]], otherwise: Column) -> Column:
    return functools.reduce(lambda rest, c: F.when(c[0], c[1]).otherwise(rest), reversed(cases), otherwise)


def _notes(*notes: tuple[Column, str]) -> Column:
    return F.filter(F.array(*(F.when(c, t) for c, t in notes)), lambda x: x.isNotNull())


def _commands(text: Column) -> Column:
    """The first word of every stage after the first; pipes within quotes don't separate."""
    bare = F.regexp_replace(text, r'"[^"]*"|\'[^\']*\'', "L")
    stages = F.slice(F.split(bare, r"\|"), 2, 10_000)
    words = F.transform(stages, lambda s: F.regexp_extract(F.lower(F.trim(s)), r"^([^\s(]+)", 1))
    return F.filter(words, lambda w: w != "")


def _known_share(words: Column, known: list[str]) -> Column:
    n = F.size(words)
    return F.when(n == 0, 1.0).otherwise(F.size(F.filter(words, lambda w: w.isin(known))) / n)


def check_spl(q: Column) -> Column:
    q = F.trim(F.coalesce(q, F.lit("")))
    low, words = F.lower(q), _commands(q)
    notes = _notes((F.contains(low, F.lit("| stats")) & ~F.contains(low, F.lit(" by ")), "stats without by"), (~low.rlike("earliest=|latest="), "no time range"))
    return _first(
        [
            (q == "", _result(False, "empty_query", 0, 0)),
            (~low.rlike(r"^(index=|sourcetype=|search\b|\*)"), _result(False, "missing_keyword", 0.2, 0)),
            (F.exists(words, lambda w: ~w.isin(SPL_COMMANDS)), _result(False, "unknown_command", 0.6, _known_share(words, SPL_COMMANDS))),
        ],
        _result(True, None, 1, _known_share(words, SPL_COMMANDS), notes),
    )


def check_aql(q: Column) -> Column:
    q = F.trim(F.coalesce(q, F.lit("")))
    up = F.upper(q)
    has = lambda p: up.rlike(p)
    parts = [r"\bWHERE\b", r"\bGROUP BY\b", r"\bHAVING\b", r"\bORDER BY\b", r"\bLAST\b"]
    coverage = (sum((has(p).cast("int") for p in parts), F.lit(2))) / F.lit(2 + len(parts))
    return _first(
        [
            (q == "", _result(False, "empty_query", 0, 0)),
            (~has(r"^SELECT\b"), _result(False, "missing_keyword", 0.1, 0)),
            (~has(r"\bFROM\s+(EVENTS|FLOWS|ASSETS)\b"), _result(False, "missing_keyword", 0.4, 0.3)),
            (has(r"\bGROUP BY\b") & ~has(r"\b(COUNT|SUM|AVG|MIN|MAX)\("), _result(False, "missing_aggregate", 0.7, coverage)),
            (has(r"\bHAVING\b") & ~has(r"\bGROUP BY\b"), _result(False, "malformed_syntax", 0.7, coverage)),
        ],
        _result(True, None, 1, coverage, _notes((~has(r"\b(LAST|START|STOP)\b"), "no time range"))),
    )


def check_elastic(q: Column) -> Column:
    q = F.trim(F.coalesce(q, F.lit("")))
    low = F.lower(q)
    word = F.regexp_extract(low, r"^(\S+)", 1)
    steps = F.regexp_count(q, F.lit(r"\["))
    pipes = F.regexp_count(low, F.lit(r"\| (stats|where)"))
    clauses = F.regexp_count(q, F.lit(" (AND|OR) ")) + 1
    category = word.isin(EQL_CATEGORIES)
    return _first(
        [
            (q == "", _result(False, "empty_query", 0, 0)),
            (category & ~low.rlike(r"\bwhere\b"), _result(False, "missing_keyword", 0.5, 0.3)),
            (category, _result(True, None, 1, F.least((1 + pipes) / 3, F.lit(1.0)))),
            ((word == "sequence") & ~(F.contains(q, F.lit("[")) & F.contains(q, F.lit("]"))), _result(False, "malformed_syntax", 0.5, 0.5)),
            (word == "sequence", _result(True, None, 1, F.least(steps / 2, F.lit(1.0)))),
            ((word == "from") & F.contains(q, F.lit("|")), _result(True, None, 1, _known_share(_commands(q), ESQL_COMMANDS))),
            (F.contains(q, F.lit(":")) | (q == "*"), _result(True, None, 1, F.least(clauses / 3, F.lit(1.0)))),
            (q.rlike(r"\b\w+\s*(>|>=|<|<=)\s*\d+"), _result(True, None, 1, 0.5)),
        ],
        _result(False, "malformed_syntax", 0.2, 0),
    )


def check_kusto(q: Column) -> Column:
    q = F.trim(F.coalesce(q, F.lit("")))
    words = _commands(F.regexp_replace(q, r"\([^()]*\)", "()"))
    main = F.regexp_replace(F.lower(q), r"^(?:let\s+\w+\s*=\s*[^\n;]+[;\n]\s*)+", "")
    table = F.trim(F.regexp_extract(main, r"^([^|\n]*)", 1))
    return _first(
        [
            (q == "", _result(False, "empty_query", 0, 0)),
            (~F.contains(q, F.lit("|")), _result(False, "malformed_syntax", 0.2, 0)),
            (F.exists(words, lambda w: ~w.isin(KUSTO_OPERATORS)), _result(False, "unknown_command", 0.6, _known_share(words, KUSTO_OPERATORS))),
        ],
        _result(True, None, 1, _known_share(words, KUSTO_OPERATORS), _notes((~table.isin(KUSTO_TABLES), "table not known"))),
    )


def check_rule(q: Column) -> Column:
    """Checks of rule documents; texts that aren't well-formed fail before any path is asked for."""
    q = F.trim(F.coalesce(q, F.lit("")))
    sound = F.coalesce(_well_formed(q), F.lit(False))
    at = lambda name: F.regexp_extract(q, rf'^<rule\b[^>]*\b{name}="([^"]*)"', 1)
    tags = F.array_distinct(F.regexp_extract_all(q, F.lit(r"<([a-z_]+)[\s/>]"), F.lit(1)))
    coverage = F.least(F.size(F.filter(tags, lambda t: t.isin(RULE_TAGS))) / 4, F.lit(1.0))
    notes = _notes((at("id").try_cast("long") < 100000, "reserved rule id"), (~at("level").try_cast("long").between(0, 15), "level out of range"))
    return _first(
        [
            (q == "", _result(False, "empty_query", 0, 0)),
            (~sound, _result(False, "invalid_xml", 0, 0)),
            (~q.rlike(r"^<rule\b"), _result(False, "malformed_syntax", 0.3, 0)),
            (~q.rlike(r"^<rule\b[^>]*\bid="), _result(False, "field_error", 0.5, 0.5)),
            (~q.rlike(r"^<rule\b[^>]*\blevel="), _result(False, "field_error", 0.6, 0.5)),
            (~q.rlike(r"<description[\s/>]"), _result(False, "missing_keyword", 0.7, 0.5)),
            (at("id").try_cast("long").isNull() | at("level").try_cast("long").isNull(), _result(False, "field_error", 0.7, coverage)),
        ],
        _result(True, None, 1, coverage, notes),
    )


def _well_formed(q: Column) -> Column:
    """Whether a text is one element with all tags closed in order; like texts of a batch are parsed once."""
    @F.pandas_udf("boolean")
    def run(texts: pd.Series) -> pd.Series:
        known: dict = {}
        for t in texts.unique():
            try:
                # declarations of entities are refused, so nothing is expanded
                known[t] = bool(t) and "<!" not in t.replace("<!--", "") and ElementTree.fromstring(t) is not None
            except ElementTree.ParseError:
                known[t] = False
        return texts.map(known)

    return run(q)


CHECKS = {"splunk": check_spl, "qradar": check_aql, "elastic": check_elastic, "sentinel": check_kusto, "wazuh": check_rule}


def check(platform: Column, query: Column, platforms: list[str] | None = None) -> Column:
    """The check of each row's platform; unknown platforms pass with a note if the text isn't empty."""
    empty = F.trim(F.coalesce(query, F.lit(""))) == ""
    unknown = F.when(empty, _result(False, "empty_query", 0, 0)).otherwise(_result(True, None, 1, 1, F.array(F.lit("no check for this platform"))))
    # Python sees a row's text only where the row is a rule
    own = lambda p: F.when(platform == p, query) if p == "wazuh" else query
    return _first([(platform == p, CHECKS[p](own(p))) for p in (platforms or CHECKS)], unknown)


def suggestion(platform: Column, query: Column, result: Column) -> Column:
    """A trivial repair: a search without its beginning gets one."""
    return F.when((platform == "splunk") & (result["error_type"] == "missing_keyword"), F.concat(F.lit("index=* "), F.trim(query)))


# Error type of a check -> (category, leaf), and the severity of each leaf.
LEAVES = {"empty_query": ("SYNTAX_ERROR", "empty_query"), "missing_keyword": ("SYNTAX_ERROR", "malformed_structure"), "malformed_syntax": ("SYNTAX_ERROR", "malformed_structure"), "invalid_xml": ("SYNTAX_ERROR", "invalid_xml"), "missing_aggregate": ("OPERATOR_ERROR", "wrong_aggregate"), "unknown_command": ("SYNTAX_ERROR", "unknown_command"), "field_error": ("FIELD_ERROR", "wrong_field_name"), "time_syntax": ("TEMPORAL_ERROR", "wrong_time_syntax")}
SEVERITIES = {
    "CRITICAL": "empty_query invalid_xml malformed_structure",
    "HIGH": "unknown_command missing_required_field wrong_field_name wrong_aggregate missing_pipe",
    "MEDIUM": "wrong_threshold inverted_condition missing_condition field_type_mismatch wrong_filter_operator wrong_table_name cross_platform_leak",
    "LOW": "missing_time_range wrong_time_syntax wrong_platform_idiom",
    "NONE": "none",
}
_SIGNS_OF = {"splunk": r"\bindex=|\|\s*stats\b", "qradar": r"\bSELECT\b", "elastic": r"event\.category\s*:", "wazuh": r"<rule\b", "sentinel": r"\bTimeGenerated\b"}


def foreign_syntax(platform: Column, query: Column) -> Column:
    """Whether a text has the marks of another platform's language."""
    found = F.lit(False)
    for p in _SIGNS_OF:
        others = "|".join(v for k, v in _SIGNS_OF.items() if k != p)
        found = F.when(platform == p, query.rlike(f"(?i){others}")).otherwise(found)
    return found


def missing_time(platform: Column, query: Column) -> Column:
    low = F.lower(query)
    return ((platform == "qradar") & ~low.rlike("last |start |stop ")) | ((platform == "elastic") & ~low.rlike("@timestamp|gte|lte|within|now-")) | ((platform == "sentinel") & ~low.rlike(r"ago\(|between\(|timegenerated|bin\("))


def classify(platform: Column, query: Column, result: Column, field_f1: Column, score: Column, hit_ratio: Column | None = None, least_f1: float = 0.5, least_score: float = 0.5) -> Column:
    """struct(category, leaf, severity) of a generated query: syntax first, then foreign syntax, fields, time, execution, logic."""
    pair = lambda c, leaf: F.struct(F.lit(c).alias("category"), F.lit(leaf).alias("leaf"))
    by_type = _first([(result["error_type"] == t, pair(*v)) for t, v in LEAVES.items()], pair("SYNTAX_ERROR", "malformed_structure"))
    cases = [
        (~result["is_valid"], by_type),
        (foreign_syntax(platform, query), pair("PLATFORM_SPECIFIC", "cross_platform_leak")),
        (field_f1 < least_f1, pair("FIELD_ERROR", "wrong_field_name")),
        (score >= 0.9, pair("NO_ERROR", "none")),
        (missing_time(platform, query), pair("TEMPORAL_ERROR", "missing_time_range")),
    ]
    if hit_ratio is not None:
        cases += [(hit_ratio == 0, pair("LOGIC_ERROR", "missing_condition")), (hit_ratio > 10, pair("LOGIC_ERROR", "inverted_condition")), (hit_ratio != 1, pair("LOGIC_ERROR", "wrong_threshold"))]
    cases.append((score < least_score, pair("LOGIC_ERROR", "missing_condition")))
    found = _first(cases, pair("NO_ERROR", "none"))
    severity = _first([(found["leaf"].isin(v.split()), F.lit(k)) for k, v in SEVERITIES.items()], F.lit("HIGH"))
    return F.struct(found["category"].alias("category"), found["leaf"].alias("leaf"), severity.alias("severity"))


def clean_reply(text: Column) -> Column:
    """The query within a reply: in a fence, as a rule, as a SELECT statement, else the first line that looks like one, else the text."""
    fenced = F.regexp_extract(text, r"(?s)```[a-zA-Z]*\s*\n?(.*?)```", 1)
    rule = F.regexp_extract(text, r"(?s)(<rule\b.*?</rule>)", 1)
    select = F.regexp_extract(text, r"(?is)(\bSELECT\b.*?(?:LAST \d+ \w+|$))", 1)
    line = F.regexp_extract(text, r"(?m)^((?:index=|search |sequence |[A-Za-z]+ where ).*)$", 1)
    return F.regexp_replace(F.coalesce(*(F.nullif(c, F.lit("")) for c in (fenced, rule, select, line)), text), r"^\s+|\s+$", "")
