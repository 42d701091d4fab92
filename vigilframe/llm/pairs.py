"""Broken prompt and response pairs.

A response is cut into clauses: comments and sentences of prose, and the stages of a query.  A
linear-chain conditional random field tags every clause as answer, refusal, echo, foreign or
unfinished; the coverage of the tags over the response decides whether the pair is defective and how.
The field sees words, pairs of words, letter trigrams and likeness to the question in prose, commands, shapes and
last signs in stages of a query, and what stands before and after.  What they mean it learns: from
responses made of a bounded sample of reference answers - whole, cut off at a place, with the question given
back - and of refusals, remarks and sentences of other languages (``pair_seeds``).
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe.durable import spread
from vigilframe.llm.pair_seeds import REMARKS, foreign_sentences, refusal

ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED = range(5)
TAGS = ("answer", "refusal", "echo", "foreign", "unfinished")
#: Reference answers from which the field is trained.
TRAINING_ROWS = 600

_INVISIBLE = re.compile("[​‌‍⁠﻿­᠎‎‏]")
_FENCE = re.compile(r"```[a-zA-Z]*[ \t]*(?=\n|$)")
_BARE_TAG = re.compile(r"</?[A-Za-z][\w-]*\s*/?>|<!--\s*-->|/\*\s*\*/")
_PLACEHOLDERS = frozenset("none null nil na tbd todo undefined nan empty unknown placeholder missing pending void notavailable notapplicable nothing noanswer noresponse noresult noquery".split())

# Shapes of finished stages, by their command.  A literal is L, a number 9 (see ``_mask``).
_VALUE = r"(?:L|-?9[a-z]{0,2}|\w[\w.\\:/*%-]*)"
_TEST = rf"(?:not\s+)?[\w.]+\s*(?:==|!=|<>|>=|<=|=~|!~|=|>|<|:|\blike~?\b|\bilike\b|\bhas\b|\bcontains\b|\bstartswith\b|\bendswith\b|\bmatches\b|\brlike\b)\s*(?:{_VALUE}|\w+\([^()]*\))|[\w.]+\s+(?:not\s+)?in\s*~?\s*\([^()]*\)|\w+\([^()]*\)|[\w.]+\s+is\s+(?:not\s+)?null"
_TESTS = rf"\(*\s*(?:{_TEST})\s*\)*(?:\s+(?:and|or)\s+\(*\s*(?:{_TEST})\s*\)*)*"
_STAGES = {
    "where": rf"where\s+{_TESTS}",
    "search": rf"search\s+{_TESTS}(?:\s+{_TESTS})*",
    "stats": r"(?:event|stream)?stats\s+(?:\w+\s*=\s*)?\w+(?:\([^()]*\))?(?:\s+as\s+\w+)?(?:\s*,\s*(?:\w+\s*=\s*)?\w+(?:\([^()]*\))?(?:\s+as\s+\w+)?)*\s+by\s+[\w.]+(?:\s*,\s*[\w.]+)*",
    "summarize": r"summarize\s+(?:\w+\s*=\s*)?\w+\([^()]*\)\s+by\s+[\w.]+(?:\s*,\s*[\w.()]+)*",
    "sort": r"sort\s+(?:by\s+)?[-+]?\s*[A-Za-z_]\w*(?:\s+(?:asc|desc))?",
    "order": r"order\s+by\s+\w+(?:\s+(?:asc|desc))?",
    "head": r"head\s+9", "tail": r"tail\s+9", "limit": r"limit\s+9", "take": r"take\s+9", "top": r"top\s+9.*",
    "table": r"table\s+\w+.*", "fields": r"fields\s+\w+.*", "project": r"project\s+\w+.*", "extend": r"extend\s+\w+\s*=\s*\S+.*", "eval": r"eval\s+\w+\s*=\s*\S+.*", "join": r"join\s+.*\)\s+on\s+\w+.*", "lookup": r"lookup\s+\w+\s+\w+.*", "dedup": r"dedup\s+\w+.*", "rename": r"rename\s+\w+\s+as\s+\w+.*", "count": r"count", "distinct": r"distinct\s+\w+.*", "transaction": r"transaction\s+\w+.*", "keep": r"keep\s+\w+.*", "drop": r"drop\s+\w+.*",
}
_STAGE = {k: re.compile(v, re.I | re.S) for k, v in _STAGES.items()}
_HEADS = [
    (re.compile(r"select\b", re.I), re.compile(r"select\b.+\bfrom\s+\w+\b.*\b(?:last\s+9\s+(?:seconds|minutes|hours|days)|start\s+L\s+stop\s+L|limit\s+9)\s*;?", re.I | re.S)),
    (re.compile(r"(?:search\s+)?index\s*=", re.I), re.compile(rf"(?:search\s+)?index\s*=\s*[\w*-]+(?:\s+(?:and\s+|or\s+|not\s+)?\(*[\w.]+\s*(?:=|!=|>|<|>=|<=)\s*{_VALUE}\)*)*", re.I | re.S)),
    (re.compile(r"<rule\b|<group\b", re.I), re.compile(r"<(rule|group)\b.*</\1\s*>", re.I | re.S)),
    (re.compile(r"sequence\b.*\[", re.I), re.compile(r"sequence\b.*\].*", re.I | re.S)),
    (re.compile(r"(?:process|file|network|registry|dns|http|authentication|any|iam|library|driver|host)\s+where\b", re.I), re.compile(rf"\w+\s+where\s+{_TESTS}", re.I | re.S)),
    (re.compile(r"from\s+[\w.*-]+\s*(?=\||\n|$)", re.I), re.compile(r"from\s+[\w.*-]+", re.I)),
    (re.compile(r"[A-Z][A-Za-z]+(?:_CL)?\s*(?=\n\s*\||\||$)"), re.compile(r"[A-Z][A-Za-z]+(?:_CL)?")),
]
_ELLIPSIS = re.compile(r"(?:\.\.\.|…)\s*$")
_MASK_QUOTED = re.compile(r'"[^"\n]*"|(?<![A-Za-z])\'[^\'\n]*\'(?![A-Za-z])')
_MASK_STAR = re.compile(r"=\*[^*\n|\"']*\*")
_MASK_TEXT = re.compile(r"(?<=>)[^<>\n]+(?=</)")
_DIGITS = re.compile(r"\d+(?:\.\d+)?")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_ALNUM = re.compile(r"[^\W_]+")
_COMMENT = re.compile(r"//[ \t]*(?P<line>[^\n]*)|<!--(?P<xml>.*?)(?:-->|\Z)|/\*(?P<block>.*?)(?:\*/|\Z)|```[ \t]*(?P<tick>[^`\n]*[^`\s])[ \t]*```", re.S)


def _mask(text: str) -> str:
    """A response with literals and numbers replaced, so that like responses become one text."""
    text = _MASK_TEXT.sub("T", text) if "<" in text else text
    text = _MASK_QUOTED.sub("L", text)
    if "=*" in text:
        text = _MASK_STAR.sub("=L", text)
    return _DIGITS.sub("9", text)


def blank(text: str | None) -> bool:
    """Whether a response holds only white space, invisible characters, markup or a placeholder."""
    if text is None:
        return True
    left = _BARE_TAG.sub(" ", _FENCE.sub(" ", _INVISIBLE.sub("", text)))
    words = "".join(_ALNUM.findall(left)).lower()
    return not words or words in _PLACEHOLDERS


def _head(text: str) -> tuple[int, re.Pattern] | None:
    """Where a query begins at the start of a line, and the shape of its finished first part."""
    for line in re.finditer(r"(?:^|\n)[ \t]*(?=\S)", text):
        at = line.end()
        for begins, whole in _HEADS:
            if begins.match(text, at):
                return at, whole
    return None


def beginnings_of(texts: list[str]) -> frozenset[str]:
    """What is only the beginning of a word of reference answers, outside literals, or of an answer's first words."""
    masked = [_mask(t) for t in texts]
    words = frozenset(w for t in masked for w in re.findall(r"[A-Za-z_]\w*", t))
    opened = frozenset(t[:k].strip() for t in masked for k in range(2, 40))
    return (frozenset(w[:k] for w in words for k in range(1, len(w))) | opened) - words


#: What the shape of a stage says: whole, broken, or of no known shape.
WHOLE, BROKEN, SHAPELESS = "whole", "broken", "shapeless"
Clause = tuple[str, bool, str, bool]


def clauses(masked: str, beginnings: frozenset[str] = frozenset()) -> list[Clause]:
    """The clauses of a masked response in order: text, part of a query, state of its shape, within a comment.

    beginnings: what is only the beginning of a known answer; a response of nothing else is a query broken off.
    """
    found: list[Clause] = []
    body = _INVISIBLE.sub("", masked)

    def prose(text: str, comment: bool) -> None:
        for s in re.split(r"(?<=[.!?。])\s+|\n+", text):
            if _ALNUM.search(s):
                found.append((s.strip(), False, WHOLE, comment))

    rest, pos = [], 0
    for m in _COMMENT.finditer(body):
        text = next((g for g in m.groups() if g is not None), "")
        if m.lastgroup == "tick" and _head(text):
            continue  # a query in a one-line fence
        rest.append(body[pos : m.start()])
        prose(text, True)
        pos = m.end()
    body = re.sub(r"```[a-zA-Z]*[ \t]*(?=\n|$)|```", "", "".join(rest) + body[pos:]).rstrip()
    at = _head(body)
    if at is None:
        if body.strip() in beginnings:
            found.append((body.strip(), True, BROKEN, False))
        else:
            prose(body, False)
        return found
    prose(body[: at[0]], False)
    query = body[at[0] :]
    # After a blank line, prose may follow.
    parts = re.split(r"\n[ \t]*\n", query)
    query, after = parts[0].rstrip(), parts[1:]
    stages = [query] if query.lstrip().startswith("<") else query.split("|")
    whole = at[1]
    for k, stage in enumerate(stages):
        s = stage.strip()
        if not k:
            shape = whole
        else:
            shape = _STAGE.get(s.split(None, 1)[0].lower() if s else "")
            s = s.rstrip(";").rstrip()
        state = BROKEN if not s else SHAPELESS if shape is None else WHOLE if shape.fullmatch(s) else BROKEN
        found.append((s, True, state, False))
    for p in after:
        prose(p, False)
    return found


_NOT_LATIN = re.compile(r"[Ͱ-ϿЀ-ӿ԰-֏֐-׿؀-ۿऀ-෿฀-๿Ⴀ-ჿ぀-ヿ㐀-鿿가-힯]")
_ACCENT = re.compile(r"[À-ÖØ-öø-ÿĀ-ſ]")


_LAST = re.compile(r"[A-Za-z_]\w*\Z")
_SIGNS = re.compile(r"[A-Za-z_][\w.]*|\d+|[<>=!~]+|\S")
Weighed = dict[str, float]


def _sign(token: str) -> str:
    return "L" if token == "L" else "a" if token[0].isalpha() or token[0] == "_" else "9" if token[0].isdigit() else "=" if token[0] in "<>=!~" else token


def _stage_features(text: str, state: str, last: bool, beginnings: frozenset[str]) -> Weighed:
    low = text.lower()
    place = "last" if last else "inner"
    tokens = _SIGNS.findall(text)
    signs = [_sign(t) for t in tokens]
    word = tokens[0].lower() if tokens else ""
    told = [f"{place}:{state}", f"{place}:ends:{''.join(signs[-1:])}:{state}", f"{place}:ends2:{''.join(signs[-2:])}:{state}", f"{place}:{word}:ends:{''.join(signs[-1:])}", f"{place}:{word}:{state}"]
    if text.count("(") != text.count(")") or text.count("[") != text.count("]") or text.count("<") - text.count("</") * 2 > 1 and low.startswith("<"):
        told.append(f"{place}:open")
    if text.count('"') % 2:
        told.append(f"{place}:quote")
    if len(signs) == 1:
        told.append(f"{place}:bare:{state}")
    if last:
        stub = _LAST.search(text)
        if stub and stub.group() in beginnings:
            told += ["stub", f"stub:{state}", f"stub:{min(len(stub.group()), 4)}"]
        if _ELLIPSIS.search(text):
            told.append("ellipsis")
    return dict.fromkeys(told, 1.0)


@lru_cache(maxsize=50_000)
def _word_features(text: str) -> tuple[tuple[str, float], ...]:
    """Words, pairs of words and trigrams, each group of length one; script and accents."""
    words = [w.lower() for w in _WORD.findall(text.replace("’", "'"))]
    out: Weighed = {}

    def group(kind: str, found: list[str]) -> None:
        for f in found:
            key = kind + f
            out[key] = out.get(key, 0.0) + 1 / len(found) ** 0.5

    group("w:", words)
    group("b:", [f"{x} {y}" for x, y in zip(words, words[1:])])
    padded = [f"^{w}$" for w in words]
    group("t:", [w[k : k + 3] for w in padded for k in range(len(w) - 2)])
    letters = sum(map(str.isalpha, text))
    if letters and 4 * len(_NOT_LATIN.findall(text)) > letters:
        out["script"] = 2.0
    if _ACCENT.search(text):
        out["accent"] = 1.0
    return tuple(out.items())


def _prose_features(text: str, comment: bool, echo: float) -> Weighed:
    out: Weighed = {"prose": 1.0, "comment" if comment else "bare": 1.0, **dict(_word_features(text))}
    for level in (0.5, 0.7, 0.85):
        if echo >= level:
            out[f"echo:{level}"] = 1.0
    return out


def _features(cs: list[Clause], echoes: list[float] | None, beginnings: frozenset[str] = frozenset()) -> list[Weighed]:
    last = max((k for k, c in enumerate(cs) if c[1]), default=-1)
    kinds = ["none", *("query" if c[1] else "prose" for c in cs), "none"]
    out = []
    for k, (text, query, state, comment) in enumerate(cs):
        f = _stage_features(text, state, k == last, beginnings) if query else _prose_features(text, comment, echoes[k] if echoes else 0.0)
        here = "q" if query else "p"
        f[here] = f[f"{here}<{kinds[k]}"] = f[f"{here}>{kinds[k + 2]}"] = 1.0
        if not query:
            f["beside a query" if last >= 0 else "no query"] = 1.0
        out.append(f)
    return out


Example = tuple[list[Weighed], list[int]]


class ChainField:
    """A linear-chain conditional random field over weighed features."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, steps: np.ndarray) -> None:
        self.names, self.weights, self.steps = names, weights, steps

    @classmethod
    def train(cls, examples: list[Example], rounds: int = 36, rate: float = 0.5, penalty: float = 3e-5) -> "ChainField":
        """Maximises the likelihood by adaptive gradient steps over all (equal ones counted) examples.  Features of a single example are left out."""
        n = len(TAGS)
        counted: dict[tuple, int] = {}
        kept: dict[tuple, Example] = {}
        for fs, ys in examples:
            key = (tuple(tuple(sorted(f.items())) for f in fs), tuple(ys))
            counted[key] = counted.get(key, 0) + 1
            kept[key] = (fs, ys)
        seen: dict[str, int] = {}
        for fs, _ in kept.values():
            for name in {name for f in fs for name in f}:
                seen[name] = seen.get(name, 0) + 1
        names = {name: k for k, name in enumerate(sorted(x for x, c in seen.items() if c > 1))}
        order = sorted(kept, key=lambda key: (len(key[1]), key))
        total = max(1, len(examples))
        # equal clauses are scored once
        flat, value, length, tag, share, sizes, clause = [], [], [], [], [], [], []
        known: dict[tuple, int] = {}
        for key in order:
            fs, ys = kept[key]
            sizes.append(len(ys))
            for f, own, y in zip(fs, key[0], ys):
                if own not in known:
                    known[own] = len(known)
                    on = [(names[x], v) for x, v in f.items() if x in names]
                    flat += [x for x, _ in on]
                    value += [v for _, v in on]
                    length.append(len(on))
                clause.append(known[own])
                tag.append(y)
                share.append(counted[key] / total)
        flat, value, length, tag, share, clause = np.array(flat, np.int64), np.array(value), np.array(length), np.array(tag, np.int64), np.array(share), np.array(clause)
        row = np.repeat(np.arange(len(length)), length)
        w, t = np.zeros((len(names), n)), np.zeros((n, n))
        gw2, gt2 = np.full(w.shape, 1e-6), np.full(t.shape, 1e-6)
        sizes = np.array(sizes)
        for _ in range(rounds):
            score = np.stack([np.bincount(row, weights=w[flat, y] * value, minlength=len(length)) for y in range(n)], 1)[clause]
            delta, gt, at = np.zeros_like(score), -penalty * t, 0
            for size in np.unique(sizes):
                many = int((sizes == size).sum())
                part = slice(at, at + many * size)
                at += many * size
                p, pair = cls._marginals(score[part].reshape(many, size, n), t)
                c, ys = share[part].reshape(many, size), tag[part].reshape(many, size)
                d = -p
                np.put_along_axis(d, ys[:, :, None], np.take_along_axis(d, ys[:, :, None], 2) + 1, 2)
                delta[part] = (d * c[:, :, None]).reshape(-1, n)
                if size > 1:
                    gt -= (pair * c[:, 0, None, None]).sum(0)
                    np.add.at(gt, (ys[:, :-1].ravel(), ys[:, 1:].ravel()), np.repeat(c[:, 0], size - 1))
            delta = np.stack([np.bincount(clause, weights=delta[:, y], minlength=len(length)) for y in range(n)], 1)
            gw = np.stack([np.bincount(flat, weights=delta[row, y] * value, minlength=len(names)) for y in range(n)], 1) - penalty * w
            gw2 += gw**2
            gt2 += gt**2
            w += rate * gw / np.sqrt(gw2)
            t += rate * gt / np.sqrt(gt2)
        return cls(names, w, t)

    @staticmethod
    def _marginals(score: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of tags and summed marginals of neighbours, of sequences of one length (many x length x tags)."""
        many, length, n = score.shape
        e, s = np.exp(score - score.max(2, keepdims=True)), np.exp(steps - steps.max())
        a, b = np.zeros_like(e), np.ones_like(e)
        a[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
        for k in range(1, length):
            a[:, k] = e[:, k] * (a[:, k - 1] @ s)
            a[:, k] /= a[:, k].sum(1, keepdims=True)
        for k in range(length - 2, -1, -1):
            b[:, k] = (e[:, k + 1] * b[:, k + 1]) @ s.T
            b[:, k] /= b[:, k].sum(1, keepdims=True)
        p = a * b
        p /= p.sum(2, keepdims=True)
        pair = np.zeros((many, n, n))
        for k in range(length - 1):
            j = a[:, k, :, None] * s[None] * (e[:, k + 1] * b[:, k + 1])[:, None, :]
            pair += j / j.sum((1, 2), keepdims=True)
        return p, pair

    def tags(self, features: list[Weighed]) -> list[int]:
        """The likeliest tags of a response's clauses."""
        score = np.zeros((len(features), len(TAGS)))
        for k, f in enumerate(features):
            on = [(self.names[x], v) for x, v in f.items() if x in self.names]
            if on:
                score[k] = np.array([v for _, v in on]) @ self.weights[[x for x, _ in on]]
        best, back = score[0], []
        for row in score[1:]:
            all_ = best[:, None] + self.steps
            back.append(all_.argmax(0))
            best = all_.max(0) + row
        path = [int(best.argmax())]
        for step in reversed(back):
            path.append(int(step[path[-1]]))
        return path[::-1]


def _echo(question: list[str], text: str) -> float:
    """The share of the smaller of two word lists that the other has, if both have some words."""
    mine = set(_ALNUM.findall(text.lower()))
    theirs = set(question)
    if len(mine) < 3 or len(theirs) < 3:
        return 1.0 if mine and mine == theirs else 0.0
    return len(mine & theirs) / min(len(mine), len(theirs)) if min(len(mine), len(theirs)) >= 0.4 * max(len(mine), len(theirs)) else len(mine & theirs) / len(mine) * 0.99


def decide(tags: list[int], cs: list[Clause]) -> str | None:
    """The pair's defect by the clauses' coverage (characters of each tag).

    Prose of another language is a defect of its own; an unfinished query is, whatever stands beside it;
    refusing and echoing clauses are where there is no query.
    """
    cover = [0] * len(TAGS)
    for tag, c in zip(tags, cs):
        cover[tag] += len(c[0]) + 1
    queried = any(c[1] for c in cs)
    if cover[FOREIGN]:
        return "language"
    if cover[UNFINISHED]:
        return "truncated"
    if queried:
        return None
    if cover[REFUSAL]:
        return "refusal"
    return "copy" if cover[ECHO] else None


#: Share of the stages whose shape is hidden in training, so that stages of no known shape are judged by the rest.
HIDDEN = 0.25


def training_examples(rows: list[tuple[str, str]], seed: int = 5) -> list[Example]:
    """Tagged responses made from (question, reference answer).

    Beginnings of words are told by the answers of the other half, so that the field learns how far they are to be trusted.
    """
    rng = random.Random(seed)
    made: list[Example] = []
    halves = [beginnings_of([r for _, r in rows[k::2]]) for k in (1, 0)]
    languages = foreign_sentences()

    def add(text: str, question: str, tag_prose: int, tag_query: int, beginnings: frozenset[str]) -> None:
        cs = clauses(_mask(text), beginnings)
        if not cs:
            return
        words = _ALNUM.findall(question.lower())
        shown = [(c[0], True, SHAPELESS if rng.random() < HIDDEN else c[2], False) if c[1] else c for c in cs]
        last = max((k for k, c in enumerate(cs) if c[1]), default=-1)
        if tag_query == UNFINISHED and last < 0:
            return
        made.append((_features(shown, [_echo(words, _unmasked(c, text)) for c in cs], beginnings), [(tag_query if k == last else ANSWER) if c[1] else tag_prose for k, c in enumerate(cs)]))

    for n, (question, answer) in enumerate(rows):
        known = halves[n % 2]
        tell = lambda text, prose, query: add(text, question, prose, query, known)  # noqa: B023, E731
        remark, other = rng.choice(REMARKS), rng.choice(REMARKS)
        for text in (answer, answer, f"{remark}\n{answer}", f"// {remark}\n{answer}", f"{answer}\n\n{other}", f"<!-- {other} -->\n{answer}"):
            tell(text, ANSWER, ANSWER)
        tell(f"// {question}\n{answer}", ANSWER, ANSWER)
        stages = answer.split("|")
        if len(stages) > 2 and not answer.startswith("<"):  # a query without its last stages is one, too
            tell("|".join(stages[: rng.randint(2, len(stages) - 1)]).rstrip(), ANSWER, ANSWER)
        for _ in range(2):
            broken = answer[: rng.randint(max(1, len(answer) // 6), max(2, len(answer) - 2))].rstrip()
            # a cut behind a whole stage leaves a whole query, so it shows nothing
            parts = [c for c in clauses(_mask(broken), known) if c[1]]
            end = _LAST.search(_mask(broken))
            if parts and (any(c[2] == BROKEN for c in parts) or end and end.group() in known):
                tell(broken, ANSWER, UNFINISHED)
                tell(f"{remark}\n{broken}", ANSWER, UNFINISHED)
                tell(broken + rng.choice((" ...", "...", " …", "…")), ANSWER, UNFINISHED)
        for frame in ("{}", "{}", "// {}", "```\n{}\n```"):
            tell(frame.format(refusal(rng)), REFUSAL, ANSWER)
        # prose that is none of all that
        tell(remark, ANSWER, ANSWER)
        add(rng.choice(rows)[0], "of something else entirely", ANSWER, ANSWER, known)
        tell(" ".join("".join(rng.choices("bdklmnprst", k=5)) for _ in range(6)), ANSWER, ANSWER)
        words = question.split()
        if len(words) > 6:
            drop = rng.randrange(len(words))
            tell(question, ECHO, ANSWER)
            tell(" ".join(words[:drop] + words[drop + 1 :]).lower(), ECHO, ANSWER)
        for _ in range(2):
            foreign = rng.choice(languages[rng.choice(sorted(languages))])
            if rng.random() < 0.5:  # names of fields, numbers and objects of the question stand in it, too
                at, more = rng.randrange(len(foreign.split()) + 1), rng.choice(words or ["x"])
                foreign = " ".join([*foreign.split()[:at], more, *foreign.split()[at:]])
            for frame in ("{}", "{}\n{answer}", "// {}\n{answer}", "{answer}\n\n{}"):
                tell(frame.format(foreign, answer=answer), FOREIGN, ANSWER)
    return made


def _unmasked(clause: Clause, text: str) -> str:
    """The words of a prose clause; numbers are compared as they stand in the text."""
    return clause[0] if "9" not in clause[0] else " ".join(dict.fromkeys([*_ALNUM.findall(clause[0]), *_DIGITS.findall(text)]))


class PairTagger:
    """Decides on pairs; responses that are alike but for literals and numbers are tagged once."""

    def __init__(self, field: ChainField, beginnings: frozenset[str] = frozenset()) -> None:
        self.field, self.beginnings = field, beginnings
        self.known: dict[str, str | None] = {}

    def defect(self, question: str | None, response: str | None) -> str | None:
        if blank(response):
            return "empty"
        masked = _mask(response)
        if masked in self.known:
            return self.known[masked]
        cs = clauses(masked, self.beginnings)
        if not cs:
            return "empty"
        if any(c[1] for c in cs):
            found = decide(self.field.tags(_features(cs, None, self.beginnings)), cs)
            if len(self.known) < 200_000:
                self.known[masked] = found
            return found
        words = _ALNUM.findall((question or "").lower())
        # A question given back in several sentences or lines is one echo.
        whole = _echo(words, response)
        echoes = [max(_echo(words, _unmasked(c, response)), whole) for c in cs]
        return decide(self.field.tags(_features(cs, echoes, self.beginnings)), cs)


def pair_defects(df: DataFrame, id_col: str, question: str, response: str, reference: str, training_rows: int = TRAINING_ROWS) -> DataFrame:
    """(id, defect) of every defective pair: empty, truncated, refusal, copy or language.

    The field is trained from ``training_rows`` reference answers, the least hash of question and answer
    in each of so many hash ranges, so the same ones on every run; all pairs are judged.  A null response is empty; a null
    question can't be copied.  Repeated rows are judged each; without any row with a reference the field
    is trained on refusals and remarks alone.  Other columns aren't read.
    """
    usable = df.select(F.col(question).alias("q"), F.col(reference).alias("r")).filter(F.col("q").isNotNull() & (F.length("r") > 20)).withColumn("h", F.xxhash64("q", "r"))
    # one pair per hash range: combined where the rows are, so that no more than these rows ever reach the driver
    sample = usable.groupBy(F.pmod("h", F.lit(training_rows)).alias("range")).agg(F.min(F.struct("h", "q", "r")).alias("s")).select("s.q", "s.r").collect()
    rows = sorted((x.q, x.r) for x in sample) or [("find all events of one user", "")]
    field = ChainField.train(training_examples(rows))
    shared = df.sparkSession.sparkContext.broadcast((field.names, field.weights, field.steps, beginnings_of([r for _, r in rows])))
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weights, steps, beginnings = shared.value
        tagger = PairTagger(ChainField(names, weights, steps), beginnings)
        for batch in batches:
            found = [tagger.defect(q, r) for q, r in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            keep = pa.array([f is not None for f in found])
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), pa.array([f for f in found if f], pa.string())], names=[id_col, "defect"])

    return spread(df.select(id_col, question, response)).mapInArrow(run, f"`{id_col}` {id_type}, defect string")
