import random
import re

import pytest

from vigilframe.llm.pieces import boundary, cut, long_texts, text_pieces


def brute_boundary(text, limit):
    stretches = re.split(r"(?:\r\n|\r|\n)[ \t]*(?:(?:\r\n|\r|\n)[ \t]*)+", text)
    if max(map(len, stretches)) <= limit:
        return "paragraph"
    stretches = [x for s in stretches for x in re.split(r"(?<=[.!?])[ \t\r\n]+", s)]
    if max(map(len, stretches)) <= limit:
        return "sentence"
    return "word" if max(len(w) for s in stretches for w in re.split(r"[ \t\r\n]+", s)) <= limit else "none"


def some_text(rng):
    end = rng.choice(["\n", "\r\n", "\r"])
    parts = []
    for _ in range(rng.randint(1, 25)):
        sentence = " ".join("x" * rng.choice([2, 5, 9, rng.choice([3, 120])]) for _ in range(rng.randint(1, rng.choice([6, 60]))))
        parts.append(sentence + rng.choice([". ", "! ", "? ", " ", end, end + " \t" + end, end * 3, "\t"]))
    return "".join(parts)


@pytest.mark.parametrize("seed", range(120))
def test_pieces_give_back_the_text(seed):
    rng = random.Random(seed)
    text, limit, overlap = some_text(rng), 100, 12
    found = cut(text, limit, overlap)
    assert "".join(text[new:end] for _, new, end in found) == text
    assert all(0 < end - a <= limit and 0 <= new - a <= overlap for a, new, end in found)
    assert all(a <= new < end for a, new, end in found)
    assert boundary(text, limit) == brute_boundary(text, limit)


def test_natural_boundaries():
    text = "\n\n".join("word " * 15 for _ in range(10)).strip()
    assert all(text[e:].lstrip(" ").startswith("\n\n") for _, _, e in cut(text, 100, 10)[:-1])
    assert boundary("a" * 101, 100) == "none" and cut("", 100, 10) == [] and cut("a" * 100, 100, 10) == [(0, 0, 100)]
    assert [e - a for a, _, e in cut("a" * 250, 100, 10)] == [90, 100, 80]
    with pytest.raises(ValueError):
        cut("x" * 20, 10, 10)


def test_operator(spark):
    long = ("Sentence one is here. " * 20).strip()
    rows = [(1, long, None), (2, "", "  "), (3, "é" * 101, long), (3, "é" * 101, long), (None, "y" * 300, None)]
    df = spark.createDataFrame(rows, "id long, a string, b string").selectExpr("id", "a", "b", "1 as field", "2 as f", "3 as seq")
    pieces = text_pieces(df, "id", ["a", "b"], 100, 10)
    assert sorted((str(r.id), r.field, r.boundary) for r in long_texts(pieces).collect()) == [("1", "a", "sentence"), ("3", "a", "none"), ("3", "a", "none"), ("3", "b", "sentence"), ("3", "b", "sentence"), ("None", "a", "none")]
    one = pieces.filter("id = 1").orderBy("seq").collect()
    assert "".join(long[r.new : r.end] for r in one) == long and all(len(r.piece) <= 100 for r in one)
    assert text_pieces(df.filter("id = 7"), "id", ["a"]).count() == 0
