"""Encoding a corpus with a public byte-level tokenizer.

Long unsplit stretches are encoded as a tree: halves on their own, then a window around each join is
encoded again and grows until it begins and ends with the tokens of the two sides.  From there on the
sides agree with the encoding of the whole: tokens are those of the whole text exactly if every two
neighbours are what their joined bytes encode to, and every two neighbours lie within one side or
within the window.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilframe.durable import spread

TOKENIZERS = "/opt/tokenizers"
#: The pattern that splits a text before the merges (fixed by the public vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of a stretch that are encoded at once; characters of a text that one task encodes.
LEAF, SEGMENT = 4096, 1 << 20


class Encoder:
    """One vocabulary.  Special tokens' spellings are ordinary text."""

    def __init__(self, path: str, leaf: int = LEAF) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.whole = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.leaf = leaf
        self.long = re.compile(r"\S{%d}|\s{%d}" % (leaf // 4, leaf // 4))

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; none for a null or empty one."""
        if not text:
            return []
        if len(text) < self.leaf // 4 or not self.long.search(text):
            return self.whole.encode_ordinary(text)
        ids: list[int] = []
        for m in _pattern().finditer(text):
            ids += self.stretch(m.group().encode())
        return ids

    def stretch(self, piece: bytes) -> list[int]:
        """The ids of bytes that the pattern doesn't split."""
        if len(piece) <= self.leaf:
            return self.whole._encode_single_piece(piece)
        half = len(piece) // 2
        return self.join(self.stretch(piece[:half]), self.stretch(piece[half:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The ids of the joined bytes of two encodings within one stretch."""
        if not left or not right:
            return left or right
        width, same = 8, 2
        while True:
            a, b = min(width, len(left)), min(width, len(right))
            window = self.whole._encode_single_piece(self.whole.decode_bytes(left[len(left) - a :] + right[:b]))
            begins = a == len(left) or window[:same] == left[len(left) - a :][:same]
            ends = b == len(right) or window[-same:] == right[:b][-same:]
            if begins and ends:
                return left[: len(left) - a] + window + right[b:]
            width *= 2

    def segments(self, text: str, size: int) -> Iterator[tuple[str, bool]]:
        """A long text in parts that can be encoded apart, and whether a part goes on within the stretch of the one before.

        A match of the pattern always begins at white space after something else, so texts are cut there;
        without such a place at the next match, and within a match only where it is longer than ``size``.
        """
        start, n = 0, len(text)
        gap = re.compile(r"(?<=\S)\s")
        while n - start > size:
            m = gap.search(text, start + size // 2, start + size)
            if m:
                yield text[start : m.start()], False
                start = m.start()
                continue
            end = start
            for m in _pattern().finditer(text, start):
                if m.end() - start > size:
                    break
                end = m.end()
            if end > start:
                yield text[start:end], False
                start = end
                continue
            stop = m.end()
            for k, at in enumerate(range(start, stop, size)):
                yield text[at : min(stop, at + size)], k > 0
            start = stop
        if start < n:
            yield text[start:], False


@lru_cache(maxsize=1)
def _pattern():
    import regex

    return regex.compile(PATTERN)


@lru_cache(maxsize=8)
def encoder(path: str, leaf: int = LEAF) -> Encoder:
    """The vocabulary at ``path``, read once in each worker."""
    return Encoder(path, leaf)


def vocabulary(name: str, folder: str = TOKENIZERS) -> str:
    return os.path.join(folder, f"{name}.tiktoken")


def encode_documents(df: DataFrame, id_col: str, text_col: str, path: str, keep: list[str] | None = None, counts: bool = False, segment: int = SEGMENT, leaf: int = LEAF) -> DataFrame:
    """id, the ``keep`` columns and the ids of every text (or with ``counts`` their number, tokens).

    Every row has a result: an empty list for a null or empty text.  Blank texts have the ids of their white
    space.  Repeated rows are encoded each.  A text of more than ``segment`` characters is cut, its parts
    are encoded in tasks of their own and brought together by id, so its id must be unique and not null;
    there is no shuffle for other texts.
    """
    kept = [id_col, *(keep or [])]
    fields = [df.schema[c] for c in kept]
    result = T.StructField("tokens", T.LongType()) if counts else T.StructField("ids", T.ArrayType(T.IntegerType()))
    names = [*kept, result.name]

    def value(lists: list[list[int]]) -> pa.Array:
        if counts:
            return pa.array([len(x) for x in lists], pa.int64())
        return pa.array(lists, pa.list_(pa.int32()))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path, leaf)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], value([tool.encode(t) for t in part.column(len(kept)).to_pylist()])], names=names)

    short = spread(df.filter(F.col(text_col).isNull() | (F.length(text_col) <= segment)).select(*kept, text_col)).mapInArrow(whole, T.StructType([*fields, result]))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path, leaf)
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                for seq, (text, inside) in enumerate(tool.segments(one.column(len(kept))[0].as_py(), segment)):
                    yield pa.RecordBatch.from_arrays([*one.columns[:-1], pa.array([seq]), pa.array([inside]), pa.array([text])], names=[*kept, "__part_seq", "__part_inside", "__part_text"])

    def encode_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path, leaf)
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                text, inside = one.column("__part_text")[0].as_py(), one.column("__part_inside")[0].as_py()
                ids = tool.stretch(text.encode()) if inside else tool.encode(text)
                yield pa.RecordBatch.from_arrays([*one.columns[:-1], pa.array([ids], pa.list_(pa.int32()))], names=[*kept, "__part_seq", "__part_inside", "__part_ids"])

    def together(group: pa.Table) -> pa.Table:
        tool = encoder(path, leaf)
        group = group.sort_by("__part_seq")
        done: list[np.ndarray] = []
        run: list[int] = []  # the part that may still change: one unsplit stretch, or the last segment
        for ids, inside in zip(group.column("__part_ids").to_pylist(), group.column("__part_inside").to_pylist()):
            if inside:
                run = tool.join(run, ids)
            else:
                done.append(np.array(run, np.int32))
                run = ids
        ids = np.concatenate([*done, np.array(run, np.int32)])
        first = group.slice(0, 1)
        out = pa.array([len(ids)], pa.int64()) if counts else pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids, pa.int32()))
        return pa.Table.from_arrays([*(first.column(c) for c in kept), out], names=names)

    inner = [T.StructField("__part_seq", T.LongType()), T.StructField("__part_inside", T.BooleanType())]
    long = df.filter(F.length(text_col) > segment).select(*kept, text_col).mapInArrow(parts, T.StructType([*fields, *inner, T.StructField("__part_text", T.StringType())]))
    coded = long.repartition(id_col, "__part_seq").mapInArrow(encode_parts, T.StructType([*fields, *inner, T.StructField("__part_ids", T.ArrayType(T.IntegerType()))]))
    return short.unionByName(coded.groupBy(id_col).applyInArrow(together, T.StructType([*fields, result])))
