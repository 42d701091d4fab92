"""Subject areas of documents from labelling functions combined by a model that learns their accuracies.

Four functions look at a document and a subject: the lexicon (sentences that use the subject's phrases),
sections (paragraphs and list items mostly on it), addresses (hosts and mail domains tied to it) and the
source.  Phrases, addresses and source rates come from a bounded sample of labelled documents.  How far
each function's outcomes can be trusted is learned without labels, by expectation maximisation over
the counts of outcome patterns of all documents; the posterior assigns the subjects.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe.durable import cut, spread

#: Labelled documents from which phrases are learned.
SAMPLE = 6000
#: Outcomes of the functions: sentences 0, 1, 2, 3 and more (a subject needs three) with sections 0, 1, 2 and more; address no or yes;
#: source rare, usual, frequent.  Sentences and sections see the same phrases, so they are one function of 12 outcomes to the model.
LEVELS = (12, 2, 3)
#: What the start counts for against all documents.  Sentences and sections say most; without it, nothing would hold the two classes to their meaning.
PRIOR_WEIGHT = 0.25

_TAG = re.compile(r"</?[A-Za-z][^<>\n]*>")
#: A comparison, also unspaced, but no run of signs as in ``--===>>``.
_COMPARED = r"(?<![=\-<>!?~#*+_])==(?![=\-<>!?~#+_])|=[\"'*]"
#: A selection; ``select one from the list`` is none.
_SELECT = r"select\b(?:[^.!?]|[.!?]\S)*\bfrom\s+\S+(?:\s*;|\s*$|\s+(?:as\s+)?(?:\w+\s+)?(?:where|group by|order by|having|limit|last|join)\b)"
#: A sentence that is, or holds, a query.
_QUERY = re.compile(rf"{_COMPARED}|\s\|\s|^\s*\||\b{_SELECT}|^\s*index=")
#: A line that begins as a query does is one to its end, whatever its literals hold.
_QUERY_LINE = re.compile(rf"\s*(?:\||index=|{_SELECT}|\w+ where\b[^.!?]*(?:{_COMPARED}|~))")
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s+|\n+|(?<=[。！？])")
_WORD = re.compile(r"[^\W_]+")
_ADDRESS = re.compile(r"\b(?:[a-z0-9-]+\.)+[a-z]{2,}\b", re.I)
_MARK = re.compile(r"^\s*(?:#+|\d+[.)]|[-*•]|\[\d\d:\d\d\]\s*(?:<\w+>)?)")


def sections(text: str) -> list[list[list[str]]]:
    """The sentences, as words, of every section of a text.  A section ends at a blank line, a heading or the next item of a list.

    A line may be a whole paragraph: only its sentences that hold a query are left out, and lines that are a query.
    """
    found: list[list[list[str]]] = [[]]
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    words_of, split = _WORD.findall, _SENTENCE.split
    for line in text.lower().split("\n"):
        bare = line.lstrip()
        if not bare or ((bare[0] in "#-*•[" or bare[0].isdigit()) and _MARK.match(bare)):
            if found[-1]:
                found.append([])
            if not bare:
                continue
        if "<" in line:
            line = _TAG.sub(" ", line)
        sentences = split(line)
        if "=" in line or "|" in line or "select" in line:
            if _QUERY_LINE.match(line):
                continue
            sentences = [s for s in sentences if not _QUERY.search(s)]
        own = found[-1]
        for sentence in sentences:
            words = words_of(sentence)
            if words:
                own.append(words)
    return [s for s in found if s]


def _sure(hits: int, n: int, z: float = 1.28) -> float:
    """The lower end of the interval for a share (Wilson)."""
    p = hits / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


@dataclass
class Lexicon:
    subjects: list[str]
    phrases: dict[str, dict[tuple[str, ...], int]] = field(default_factory=dict)  # first word -> phrase -> subject
    addresses: dict[str, int] = field(default_factory=dict)
    sources: dict[tuple[str, int], int] = field(default_factory=dict)

    def on(self, words: list[str]) -> set[int]:
        """The subjects of a sentence; of overlapping phrases the longest counts."""
        found: set[int] = set()
        starts, end = self.phrases, 0
        for k in [k for k, w in enumerate(words) if w in starts]:
            if k < end:
                continue
            own = starts[words[k]]
            for n in (3, 2, 1):
                s = own.get(tuple(words[k : k + n]))
                if s is not None:
                    found.add(s)
                    end = k + n
                    break
        return found

    def outcomes(self, text: str, source: str | None) -> dict[int, tuple[int, int, int, int]]:
        """Per subject the outcomes of the functions, for subjects of which anything is seen."""
        count: dict[int, int] = {}
        mostly: dict[int, int] = {}
        starts = self.phrases
        for section in sections(text):
            own: dict[int, int] = {}
            for words in section:
                if not starts.keys().isdisjoint(words):
                    for s in self.on(words):
                        own[s] = own.get(s, 0) + 1
            for s, n in own.items():
                count[s] = count.get(s, 0) + n
                if n >= 3 and 2 * n >= len(section):
                    mostly[s] = mostly.get(s, 0) + 1
        tied = {self.addresses[a] for a in map(str.lower, _ADDRESS.findall(text)) if a in self.addresses} if self.addresses else set()
        return {s: (min(count.get(s, 0), 3), min(mostly.get(s, 0), 2), int(s in tied), self.sources.get((source or "", s), 1)) for s in {*count, *tied}}


def learn(documents: list[tuple[str, str | None, list[str]]], subjects: list[str]) -> Lexicon:
    """Phrases of one to three words, addresses and source rates from (text, source, labels).

    A phrase belongs to a subject if the documents with that label have, of the sentences that use it, a
    share that surely exceeds three quarters (single words: 85 in 100), in three documents or more.
    Sentences are counted, not documents, so that a mention in passing weighs little; missing or wrong labels,
    if few, don't change the outcome.
    """
    index = {s: k for k, s in enumerate(subjects)}
    total, spread = Counter(), Counter()
    hit: dict[tuple, Counter] = defaultdict(Counter)
    seen_at, hit_at = Counter(), defaultdict(Counter)
    by_source, with_subject = Counter(), Counter()
    for text, source, labels in documents:
        own = sorted({index[s] for s in labels if s in index})
        here: Counter = Counter()
        for section in sections(text):
            for words in section:
                here.update({*zip(words), *zip(words, words[1:]), *zip(words, words[1:], words[2:])})
        for g, n in here.items():
            total[g] += n
            spread[g] += 1
            for s in own:
                hit[g][s] += n
        for a in {x.lower() for x in _ADDRESS.findall(text)}:
            seen_at[a] += 1
            for s in own:
                hit_at[a][s] += 1
        by_source[source or ""] += 1
        for s in own:
            with_subject[source or "", s] += 1
    lexicon = Lexicon(subjects)
    chosen: dict[tuple, int] = {}
    for g in sorted((g for g, n in spread.items() if n >= 3 and hit[g]), key=lambda g: (len(g), g)):
        s, n = max(hit[g].items(), key=lambda x: (x[1], -x[0]))
        if _sure(n, total[g]) <= (0.85 if len(g) == 1 else 0.75):
            continue
        parts = [g[a:b] for a in range(len(g)) for b in range(a + 1, len(g) + 1) if b - a < len(g)]
        if any(chosen.get(p) == s for p in parts) and not any(p in chosen and chosen[p] != s for p in parts):
            continue  # a shorter phrase says it already
        chosen[g] = s
    for g, s in chosen.items():
        lexicon.phrases.setdefault(g[0], {})[g] = s
    for a, n in seen_at.items():
        if n >= 3 and hit_at[a]:
            s, h = max(hit_at[a].items(), key=lambda x: (x[1], -x[0]))
            if _sure(h, n) > 0.75:
                lexicon.addresses[a] = s
    whole = sum(by_source.values())
    for s in range(len(subjects)):
        usual = sum(with_subject[x, s] for x in by_source) / max(whole, 1)
        for x, n in by_source.items():
            rate = (with_subject[x, s] + 2 * usual) / (n + 2)
            lexicon.sources[x, s] = 2 if rate > 2 * usual else 0 if rate < 0.5 * usual else 1
    return lexicon


def accuracies(patterns: dict[tuple[int, ...], int], rounds: int = 60) -> dict[tuple[int, ...], float]:
    """The posterior probability of each outcome pattern, with the functions' accuracies learned from the patterns' counts.

    The functions are taken as independent given the truth, but for sentences and sections, which have one table
    together.  The start says only that more sentences and
    sections speak for a subject; the counts do the rest.
    """
    if not patterns:
        return {}
    keys = sorted(patterns)
    seen = [(3 * k[0] + k[1], *k[2:]) for k in keys]
    n = np.array([patterns[k] for k in keys], float)
    sentences = [np.outer(a, b).ravel() for a, b in (([0.02, 0.03, 0.05, 0.9], [0.4, 0.3, 0.3]), ([0.82, 0.13, 0.04, 0.01], [0.97, 0.02, 0.01]))]
    yes = [sentences[0], np.array([0.8, 0.2]), np.array([0.2, 0.5, 0.3])]
    no = [sentences[1], np.array([0.98, 0.02]), np.array([0.35, 0.5, 0.15])]
    start, prior = (list(yes), list(no)), 0.1
    for _ in range(rounds):
        log_yes, log_no = np.log(prior), np.log(1 - prior)
        a = np.array([log_yes + sum(np.log(yes[f][v]) for f, v in enumerate(k)) for k in seen])
        b = np.array([log_no + sum(np.log(no[f][v]) for f, v in enumerate(k)) for k in seen])
        p = 1 / (1 + np.exp(np.clip(b - a, -500, 500)))
        prior = min(max(float((p * n).sum() / n.sum()), 1e-6), 1 - 1e-6)
        for f in range(len(LEVELS)):
            for table, weight in ((yes, p * n), (no, (1 - p) * n)):
                counts = PRIOR_WEIGHT * weight.sum() * start[table is no][f] + 0.5
                for k, w in zip(seen, weight):
                    counts[k[f]] += w
                table[f] = counts / counts.sum()
    return dict(zip(keys, map(float, p)))


def document_subjects(df: DataFrame, labels: DataFrame, subjects: DataFrame, id_col: str, text_col: str, source_col: str, sample: int = SAMPLE, least: float = 0.5) -> DataFrame:
    """(id, subject, posterior) for every subject a document is about; none for most texts without content.

    labels: id, subject - partly missing or wrong; the phrases are learned from ``sample`` labelled documents
    at most, those with the least hashes of their ids.  The accuracies are learned from all documents.  Null,
    empty and blank texts, and texts without any known phrase, get no subject.  Without labels nothing can
    be learned and the result is empty.  Repeated documents are assigned each.
    """
    names = sorted({r.subject for r in subjects.select("subject").distinct().collect() if r.subject is not None})
    picked = labels.filter(F.col(id_col).isNotNull() & F.col("subject").isin(names)).groupBy(id_col).agg(F.collect_set("subject").alias("labels")).orderBy(F.xxhash64(id_col), id_col).limit(sample)
    rows = df.select(id_col, F.col(text_col).alias("text"), F.col(source_col).alias("source")).join(F.broadcast(picked), id_col).filter("text is not null").orderBy(id_col).limit(4 * sample).collect()
    lexicon = df.sparkSession.sparkContext.broadcast(learn([(r.text, r.source, r.labels) for r in rows], names))
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lexicon.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows, subject, a, b, c, e = [], [], [], [], [], []
                for k, (text, source) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist())):
                    for s, o in sorted(known.outcomes(text, source).items()):
                        rows.append(k)
                        subject.append(known.subjects[s])
                        for column, v in zip((a, b, c, e), o):
                            column.append(v)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int32())), pa.array(subject, pa.string()), *(pa.array(x, pa.int32()) for x in (a, b, c, e))], names=[id_col, "subject", "f0", "f1", "f2", "f3"])

    seen = cut(spread(df.select(id_col, text_col, source_col).filter(F.col(text_col).isNotNull())).mapInArrow(run, f"`{id_col}` {id_type}, subject string, f0 int, f1 int, f2 int, f3 int"))
    marks = ["f0", "f1", "f2", "f3"]
    counts = {tuple(r[m] for m in marks): r["n"] for r in seen.groupBy(*marks).agg(F.count("*").alias("n")).collect()}  # at most 72 patterns
    # Documents of which nothing is seen for a subject are the bulk of the negatives.  They, too, have a source outcome.
    if counts:
        known = lexicon.value.sources
        levels = df.sparkSession.createDataFrame([(x, names[s], level) for (x, s), level in known.items() if level != 1], "src string, subject string, f3 int")
        # at most as many rows as the sample has sources, times the subjects
        per_source = df.groupBy(F.coalesce(F.col(source_col), F.lit("")).alias("src")).agg(F.count("*").alias("n"))
        unusual = per_source.join(F.broadcast(levels), "src").groupBy("f3").agg(F.sum("n").alias("n")).collect()
        of = {r.f3: r.n for r in unusual}
        of[1] = df.count() * len(names) - sum(of.values())
        for level, n in of.items():
            n -= sum(c for k, c in counts.items() if k[3] == level)
            if n > 0:
                counts[0, 0, 0, level] = counts.get((0, 0, 0, level), 0) + n
    posterior = [(*k, p) for k, p in accuracies(counts).items() if p >= least]
    table = df.sparkSession.createDataFrame(posterior, "f0 int, f1 int, f2 int, f3 int, posterior double")
    return seen.join(F.broadcast(table), marks).select(id_col, "subject", "posterior")
