"""JSON out of replies, validation of whole tables of query documents, accounting of messages."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.dialects import _named
from vigilframe.functions.text import estimate_tokens
from vigilframe.operators.jsontext import read
from vigilframe.plans.query import QueryError, parse, warnings

# Other names of canonical fields in replies.
FIELD_ALIASES = {
    "ip_address": "src_ip", "source_ip": "src_ip", "dest": "dest_ip", "destination_ip": "dest_ip", "username": "user", "user_name": "user", "proc_name": "process_name",
    "cmd_line": "command_line", "cmdline": "command_line", "file": "file_name", "hash": "file_hash", "dns_query": "query_domain", "query": "query_domain", "event": "event_type",
}
_LITERALS = {"True": "true", "False": "false", "None": "null"}
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"?|\'(?:[^\'\\]|\\.)*\'?|//[^\n]*|[{}\[\]:,]|[^\s{}\[\]:,"\']+', re.S)


def extract(text: str | None) -> Any:
    """The first object or list in a reply, or None.

    As it stands, else the content of a fence, else from the first bracket on, with comments, trailing commas,
    single quotes and Python's literals mended and open brackets closed: the text is read as tokens, written anew.
    """
    if not text:
        return None
    fence = re.search(r"```(?:json)?\s*(.*?)```", text, re.S)
    tag = re.search(r"<(json|ir|query)>\s*(.*?)</\1>", text, re.S)
    for part in (text, fence and fence[1], tag and tag[2]):
        if part:
            try:
                held = json.loads(part.strip())
                if isinstance(held, (dict, list)):
                    return held
            except (ValueError, RecursionError):
                pass
    body = fence[1] if fence else tag[2] if tag else text
    for start in (m.start() for m in re.finditer(r"[{\[]", body)):
        held = _mend(body[start:])
        if held is not None:
            return held
    return None


def _mend(text: str) -> Any:
    out: list[str] = []
    open_: list[str] = []
    for token in _TOKEN.findall(text):
        if token.startswith("//"):
            continue
        if token in "{[":
            open_.append("}" if token == "{" else "]")
        elif token in "}]":
            if not open_ or open_[-1] != token:
                return None
            open_.pop()
            if out and out[-1] == ",":
                out.pop()
        elif token[0] in "\"'":
            inner = token[1:-1] if len(token) > 1 and token[-1] == token[0] else token[1:]
            if token[0] == "'":
                inner = inner.replace("\\'", "'").replace('"', '\\"')
            token = '"' + inner + '"'
        elif token not in ":,":
            token = _LITERALS.get(token, token)
        out.append(token)
        if not open_:
            break
    if open_:  # cut off: what is half written goes, the brackets close
        while out and out[-1] in (",", ":"):
            out.pop()
        if open_[-1] == "}" and out and out[-1] not in "{[" and (len(out) < 2 or out[-2] in "{,"):
            out.pop()
            if out and out[-1] == ",":
                out.pop()
        out += reversed(open_)
    try:
        held = json.loads("".join(out))
    except (ValueError, RecursionError):
        return None
    return held if isinstance(held, (dict, list)) else None


def rename_fields(x: Any) -> Any:
    """Canonical names for the fields that a document refers to."""
    if isinstance(x, dict):
        return {k: FIELD_ALIASES.get(v, v) if k in ("field", "match_field") and isinstance(v, str) else [FIELD_ALIASES.get(i, i) if isinstance(i, str) else i for i in v] if k in ("group_by", "fields") and isinstance(v, list) else rename_fields(v) for k, v in x.items()}
    return [rename_fields(v) for v in x] if isinstance(x, list) else x


def extracted(text: Column) -> Column:
    """The JSON text of the first object or list of each reply, null if there is none."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if (v := extract(t)) is None else json.dumps(v, ensure_ascii=False))

    return run(text)


def validated(df: DataFrame, document: str) -> DataFrame:
    """``df`` with error (null: a valid query), warnings and summary of its query documents, in one pass.

    Documents are read with any key spelling; what can't be read is an error like any other.
    """

    @F.pandas_udf("error string, warnings array<string>, summary string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        def one(text: str | None) -> tuple:
            held = read(text)
            if not isinstance(held, dict):
                return "unreadable", [], None
            held = _named(held)
            try:
                return None, warnings(held), parse(held).summary()
            except (QueryError, AttributeError, TypeError, KeyError) as e:
                return str(e) or type(e).__name__, [], None

        for batch in batches:
            yield pd.DataFrame([one(t) for t in batch], columns=["error", "warnings", "summary"])

    return df.withColumn("_v", run(F.col(document))).select(*df.columns, "_v.error", "_v.warnings", "_v.summary")


def usage(messages: DataFrame, by: list[str], text: str, price_per_million: float = 0.0) -> DataFrame:
    """Messages, estimated tokens (four more a message) and their cost per group."""
    tokens = F.sum(estimate_tokens(F.col(text)) + 4)
    return messages.groupBy(*by).agg(F.count(F.lit(1)).alias("messages"), tokens.alias("tokens")).withColumn("cost", F.round(F.col("tokens") * price_per_million / 1e6, 6))


def context_block(hits: DataFrame, by: str, rank: str, source: str, text: str, most: int = 800) -> DataFrame:
    """One context text per query: its hits in order of rank, each cut to ``most`` characters for the prompt."""
    block = F.format_string("[%d] %s\n%s", F.col(rank).cast("int"), F.col(source), F.substring(text, 1, most))
    return hits.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), block.alias("b")))), lambda x: x["b"]), "\n\n").alias("context"))
