"""Query languages of five platforms: rendering of queries and static checks of texts.

A language is a ``Dialect`` in a registry; others may be added with ``register``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from vigilframe.operators.jsontext import read
from vigilframe.plans.query import Query, QueryError, parse


@dataclass(frozen=True)
class Dialect:
    platform: str
    render: Callable[[Query], str]


_REGISTRY: dict[str, Dialect] = {}


def register(dialect: Dialect) -> Dialect:
    _REGISTRY[dialect.platform] = dialect
    return dialect


def dialects() -> dict[str, Dialect]:
    from vigilframe.dialects import rendering  # noqa: F401  (registers the built-in ones)

    return dict(_REGISTRY)


def translate(q: Query) -> dict[str, str]:
    """The query in every language; a language that can't say it gives ``ERROR: ..``."""
    found = {}
    for name, d in dialects().items():
        try:
            found[name] = d.render(q)
        except (QueryError, ValueError, TypeError, KeyError) as e:
            found[name] = f"ERROR: {e}"
    return found


def render_column(document: Column) -> Column:
    """map(platform -> query) of query documents (JSON text); null where a document is no query.  Equal documents are rendered once by a worker."""
    names = sorted(dialects())

    @F.pandas_udf("map<string,string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict = {}
        for batch in batches:
            if len(known) > 100_000:
                known.clear()
            for text in batch.unique():
                if text in known:
                    continue
                held = read(text)
                try:
                    known[text] = {n: t for n, t in translate(parse(_named(held))).items() if n in names} if isinstance(held, dict) else None
                except (QueryError, TypeError, AttributeError):
                    known[text] = None
            yield batch.map(lambda t: known[t])

    return run(document)


#: Plain keys, as the reader gives them, and the names of the format.
_NAMES = {n.replace("_", ""): n for n in ("event_type", "time_window", "group_by", "lookup_table", "match_field", "output_field", "filter_on_match", "sort_by", "sort_order", "nl_query", "technique_id")}


def _named(x):
    if isinstance(x, dict):
        return {_NAMES.get(k, k): _named(v) for k, v in x.items()}
    return [_named(v) for v in x] if isinstance(x, list) else x
