"""Reading JSON text of mixed quality: odd key spellings, JSON within strings, any depth."""

from __future__ import annotations

import json
import re
from typing import Any

_TRIM = "﻿ \t\r\n\f\v "


class _Keys(dict):
    """Key spellings seen so far, each with its form without case and underscores."""

    def __missing__(self, key: str) -> str:
        plain = key.replace("_", "").lower()
        if len(self) < 100_000:
            self[key] = plain
        return plain


_KEYS = _Keys()


def _object(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    keys = _KEYS
    return {keys[k]: v for k, v in pairs}


_decode = json.JSONDecoder(object_pairs_hook=_object).decode

_TOKEN = re.compile(r'\s*(?:([\[\]{},:])|("(?:[^"\\]|\\.)*")|([^\s\[\]{},:"]+))', re.S)


def _decode_deep(text: str) -> Any:
    """As the usual decoder, but with a stack of its own instead of recursion."""
    stack: list[tuple[Any, str | None]] = []
    top: list[Any] = []
    here: Any = top
    key: str | None = None
    expect, pos, end = "value", 0, len(text)
    while pos < end:
        m = _TOKEN.match(text, pos)
        if not m:
            if text[pos:].strip():
                raise ValueError("unreadable")
            break
        pos = m.end()
        mark, string, word = m.groups()
        if mark in ("]", "}"):
            if not stack or expect not in ("next", "value?", "key?") or (mark == "]") != isinstance(here, list):
                raise ValueError("unbalanced")
            here, key = stack.pop()
            expect = "next"
            continue
        if expect in ("value", "value?"):
            if mark in ("[", "{"):
                child: Any = [] if mark == "[" else {}
                _put(here, key, child)
                stack.append((here, None))
                here, key, expect = child, None, "value?" if mark == "[" else "key?"
                continue
            if mark:
                raise ValueError("value missing")
            _put(here, key, json.loads(string or word))
            key, expect = None, "next"
        elif expect in ("key", "key?"):
            if not string:
                raise ValueError("key missing")
            key, expect = _KEYS[json.loads(string)], ":"
        elif expect == ":":
            if mark != ":":
                raise ValueError("colon missing")
            expect = "value"
        else:
            if mark != "," or here is top:
                raise ValueError("comma missing")
            expect = "value" if isinstance(here, list) else "key"
    if stack or len(top) != 1:
        raise ValueError("cut off")
    return top[0]


def _put(here: Any, key: str | None, value: Any) -> None:
    if isinstance(here, list):
        here.append(value)
    else:
        here[key] = value


def read(text: str | None) -> Any:
    """The value of a JSON text with plain keys, or None where it can't be read.

    A byte-order mark and white space around it are ignored.  Text that again holds JSON is read on.
    """
    value: Any = text
    for _ in range(16):
        if not isinstance(value, str):
            return value
        value = value.strip(_TRIM)
        if not value:
            return None
        try:
            value = _decode(value)
        except RecursionError:
            try:
                value = _decode_deep(value)
            except (ValueError, KeyError, RecursionError):
                return None
        except ValueError:
            return None
    return value


def inner(value: Any) -> Any:
    """A value where an object or list belongs: text is taken for what it holds, if it holds such."""
    if isinstance(value, str) and value.strip(_TRIM)[:1] in ("{", "[", '"'):
        held = read(value)
        return held if isinstance(held, (dict, list)) else value
    return value
