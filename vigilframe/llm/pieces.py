"""Cutting long texts into overlapping pieces at natural boundaries.

A text is first cut into atoms: sentences, and where these are too long words, and where these are too
long stretches of equal length.  Adjacent pieces wait in a heap, the weakest boundary first (within a
word, between words, sentences, paragraphs; then the smaller sum, then the earlier place), and merge
while their sum and the overlap fit under the limit.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe.durable import spread

LIMIT, OVERLAP = 1500, 150
LEVELS = ("paragraph", "sentence", "word", "none")

_END = r"(?:\r\n|\r|\n)"
_WORD = r"[ \t\r\n]+"
_BLANK_LINE = re.compile(rf"{_END}[ \t]*{_END}")


def _gaps(text: str) -> Iterator[tuple[int, int, int]]:
    """Every run of white space as (start, end, level): 0 paragraph, 1 sentence, 2 word."""
    for m in re.finditer(_WORD, text):
        if _BLANK_LINE.search(m.group()):
            yield m.start(), m.end(), 0
        elif m.start() and text[m.start() - 1] in ".!?":
            yield m.start(), m.end(), 1
        else:
            yield m.start(), m.end(), 2


def longest(text: str) -> tuple[int, int, int]:
    """The longest stretch when cutting at paragraphs, also at sentences, at all white space."""
    most, start = [0, 0, 0], [0, 0, 0]
    for a, b, level in _gaps(text):
        for k in range(3):
            if level <= k:
                most[k] = max(most[k], a - start[k])
                start[k] = b
    return tuple(max(m, len(text) - s) for m, s in zip(most, start))  # type: ignore[return-value]


def boundary(text: str, limit: int = LIMIT) -> str:
    """The first kind of boundary that suffices to keep all stretches within the limit."""
    return next((name for name, n in zip(LEVELS, longest(text)) if n <= limit), "none")


def _atoms(text: str, limit: int, room: int) -> list[tuple[int, int, int]]:
    """Consecutive (start, end, level of the boundary before), white space going to the atom after it; 3: within a word."""
    cuts = list(_gaps(text))
    stretches: list[tuple[int, int, int]] = []

    def split(a: int, b: int, inside: list[tuple[int, int, int]], at: int, before: int) -> None:
        # [a, b): a stretch with the white space before it; at: the finest level tried so far
        if b - a <= limit and at >= 1:
            stretches.append((a, b, before))
            return
        if at == 2:
            for k, s in enumerate(range(a, b, room)):
                stretches.append((s, min(b, s + room), before if not k else 3))
            return
        core = a + len(text[a:b]) - len(text[a:b].lstrip(" \t\r\n"))
        if at >= 0 and a < core < b and b - core <= limit < b - a:
            # only the white space before it is too much: it becomes atoms of its own
            stretches.extend((s, min(core, s + room), before if s == a else 3) for s in range(a, core, room))
            split(core, b, inside, at, before)
            return
        level, start, first, own = at + 1, a, before, []
        for g in inside:
            if g[2] <= level and g[0] > start:
                split(start, g[0], own, level, first)
                start, first, own = g[0], g[2], []
            else:
                own.append(g)
        if start < b:
            split(start, b, own, level, first)

    split(0, len(text), cuts, -1, 0)
    return stretches


def cut(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, new, end) of the pieces: text[start:end] is the piece, text[start:new] repeats the one before.

    The parts from ``new`` to ``end`` follow one another without gaps, so that they give back the text.
    No piece has more than ``limit`` characters.  The repeated part has at most ``overlap`` and begins at a
    word where it has one; it is shorter where a natural stretch would not fit otherwise.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be shorter than the limit")
    if len(text) <= limit:
        return [(0, 0, len(text))] if text else []
    atoms = _atoms(text, limit, limit - overlap)
    n = len(atoms)
    start, end = [a for a, _, _ in atoms], [b for _, b, _ in atoms]
    level = [c for _, _, c in atoms]
    after, before, alive = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
    room = limit - overlap
    heap = [(-level[i], end[i] - start[i - 1], i - 1, i) for i in range(1, n) if end[i] - start[i - 1] <= room]
    heapq.heapify(heap)
    while heap:
        _, size, i, j = heapq.heappop(heap)
        if not (alive[i] and alive[j]) or after[i] != j or end[j] - start[i] != size:
            continue
        alive[j], end[i], after[i] = False, end[j], after[j]
        if after[i] >= 0:
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b >= 0 and end[b] - start[a] <= room:
                heapq.heappush(heap, (-level[b], end[b] - start[a], a, b))
    found, i = [], 0
    while i >= 0:
        new, last = start[i], end[i]
        most = min(overlap, limit - (last - new)) if found else 0
        found.append((_overlap_start(text, new, most, found[-1][1] if found else 0), new, last))
        i = after[i]
    return found


def _overlap_start(text: str, new: int, most: int, least: int) -> int:
    """Where the repeated part begins: as far back as allowed, at the beginning of a word if there is one."""
    low = max(new - most, least)
    if low >= new or low <= 0:
        return low if low < new else new
    for k in range(low, new):
        if text[k - 1] in " \t\r\n" and text[k] not in " \t\r\n":
            return k
    return low if text[low - 1 : low + 1] != "\r\n" else low + 1


def text_pieces(df: DataFrame, id_col: str, fields: list[str], limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True) -> DataFrame:
    """Pieces of every text in ``fields`` longer than ``limit`` code points, in order.

    Columns: id, field, boundary (the coarsest kind of boundary that suffices for the text), seq from 0,
    start, new, end (code points; text[new:end] follow one another) and, with ``with_text``, piece.
    Null, empty and blank texts, as those within the limit, have no rows.  Repeated rows are cut each;
    other columns aren't read.  There is no shuffle: a text is cut where it is read.
    """
    # A stack of two columns without reading the table twice; short texts never leave the JVM.
    stacked = spread(df.select(id_col, *fields)).select(F.col(id_col), F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields))).alias("_f"))
    long = stacked.select(id_col, "_f.field", "_f.text").filter(F.length("text") > limit)
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, name, text in zip(batch[id_col], batch["field"], batch["text"]):
                kind = boundary(text, limit)
                for seq, (a, new, b) in enumerate(cut(text, limit, overlap)):
                    rows.append((key, name, kind, seq, a, new, b, *([text[a:b]] if with_text else [])))
            yield pd.DataFrame(rows, columns=names)

    names = [id_col, "field", "boundary", "seq", "start", "new", "end", *(["piece"] if with_text else [])]
    return long.mapInPandas(run, f"`{id_col}` {id_type}, field string, boundary string, seq int, start int, new int, end int" + (", piece string" if with_text else ""))


def long_texts(pieces: DataFrame) -> DataFrame:
    """(id, field, boundary) of every text that was cut."""
    return pieces.filter("seq = 0").select(pieces.columns[0], "field", "boundary")
