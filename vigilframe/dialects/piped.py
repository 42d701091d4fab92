"""Event queries and field queries turned into the piped language, text to text.

Literals and comments are set apart first, so nothing inside them is ever rewritten.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_PIECE = re.compile(r'"(?:[^"\\]|\\.)*"|//[^\n]*|[^"/]+|/', re.S)
_OR = re.compile(r"\bor\b", re.I)
_STAGES = {"where": "WHERE", "sort": "SORT", "head": "LIMIT", "tail": "LIMIT", "limit": "LIMIT", "eval": "EVAL", "keep": "KEEP", "drop": "DROP"}
_FUNCTIONS = {"unique_count": "COUNT_DISTINCT", "dc": "COUNT_DISTINCT"}
_CATEGORIES = frozenset("authentication network process file registry dns web any iam".split())


@dataclass
class Piped:
    text: str
    warnings: list[str] = field(default_factory=list)


def _apart(text: str) -> tuple[str, list[str], list[str]]:
    """The text with literals as numbered marks, the literals, and the comments (left out)."""
    out, literals, comments = [], [], []
    for piece in _PIECE.findall(text):
        if piece.startswith('"'):
            out.append(f"\x00{len(literals)}\x00")
            literals.append(piece)
        elif piece.startswith("//"):
            comments.append(piece[2:].strip())
        else:
            out.append(piece)
    return "".join(out), literals, comments


def _back(text: str, literals: list[str]) -> str:
    return re.sub("\x00(\\d+)\x00", lambda m: literals[int(m[1])], text)


def _condition(text: str) -> str:
    text = re.sub(r"\bmatch\(\s*([\w.@]+)\s*,\s*(\x00\d+\x00)\s*\)", r"\1 RLIKE \2", text, flags=re.I)
    text = re.sub(r"\blike~?", "LIKE", text, flags=re.I)
    text = re.sub(r"!=\s*null\b", "IS NOT NULL", text, flags=re.I)
    text = re.sub(r"==\s*null\b", "IS NULL", text, flags=re.I)
    return re.sub(r"\b(and|or|not|in|is|null|true|false)\b", lambda m: m[1].upper(), re.sub(r"\s+", " ", text.strip()), flags=re.I)


def _stats(text: str) -> str:
    measures, _, by = re.sub(r"\s+", " ", text).partition(" by ")

    def one(m: str) -> str:
        named = re.fullmatch(r"\s*(\w+)\(([^)]*)\)(?:\s+as\s+(\w+))?\s*|\s*(\w+)\s*=\s*(\w+)\(([^)]*)\)\s*", m, re.I)
        if not named:
            return m.strip()
        f, of, alias = (named[5], named[6], named[4]) if named[4] else (named[1], named[2], named[3])
        call = f"{_FUNCTIONS.get(f.lower(), f.upper())}({of.strip() or '*'})"
        return f"{alias} = {call}" if alias else call

    return "STATS " + ", ".join(one(m) for m in re.split(r",(?![^(]*\))", measures)) + (f" BY {by.strip()}" if by else "")


def to_piped(query: str, index: str = "events") -> Piped:
    """An event query (category where .. | ..) or a field query (name: value AND ..) in the piped language.

    A sequence has no counterpart and is an error.  Time hints in comments and commands without a counterpart become
    warnings.
    """
    body, literals, comments = _apart(query or "")
    warnings = [f"comment left out: {c}" for c in comments]
    first, *stages = [p.strip() for p in body.strip().split("|")]
    word = first.split(None, 1)[0].lower() if first else ""
    if word == "sequence":
        raise ValueError("a sequence can't be said in the piped language")
    lines = [f"FROM {index}"]
    if word in _CATEGORIES:
        condition = re.sub(r"^\w+\s+where\b", "", first, flags=re.I).strip()
        parts = [] if word == "any" else [f'event.category == "{word}"']
        if condition and condition.lower() != "true":
            said = _condition(condition)
            parts.append(f"({said})" if parts and re.search(r"\bOR\b", said) else said)
        if parts:
            lines.append("WHERE " + " AND ".join(parts))
    elif first and first != "*":
        lines.append("WHERE " + _condition(_field_query(first)))
    for stage in stages:
        command, _, rest = stage.partition(" ")
        command = command.lower()
        if command == "stats":
            lines.append(_stats(rest))
        elif command in _STAGES:
            if command == "tail":
                warnings.append("tail takes the first rows of the order in force: sort before it")
            rest = re.sub(r"\b(asc|desc)\b", lambda m: m[1].upper(), rest.strip(), flags=re.I) if command == "sort" else _condition(rest) if command == "where" else rest.strip()
            lines.append(f"{_STAGES[command]} {rest}")
        elif stage:
            warnings.append(f"command not known: {command}")
            lines.append(stage)
    return Piped(_back("\n| ".join(lines), literals), warnings)


def _field_query(text: str) -> str:
    """name: value, name: (a or b), name: *part*, name: * as comparisons."""
    text = re.sub(r"([\w.@]+)\s*:\s*\(([^)]*)\)", lambda m: f"{m[1]} IN ({', '.join(p.strip() for p in _OR.split(m[2]))})", text)
    text = re.sub(r"([\w.@]+)\s*:\s*\*(?=\s|$|\))", r"\1 IS NOT NULL", text)
    text = re.sub(r"([\w.@]+)\s*:\s*([\w*?.@-]*\*[\w*?.@-]*)", r'\1 LIKE "\2"', text)
    return re.sub(r"([\w.@]+)\s*:\s*(\x00\d+\x00|[\w.@-]+)", lambda m: f"{m[1]} == {m[2]}" if m[2].startswith("\x00") or re.fullmatch(r"-?\d+(\.\d+)?|true|false", m[2]) else f'{m[1]} == "{m[2]}"', text)
