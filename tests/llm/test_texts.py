import random
import re

import pytest
from pyspark.sql import functions as F

from vigilframe.llm.pairs import _ACCENT, _NOT_LATIN, WHOLE as WHOLE_SHAPE, ChainField, PairTagger, _mask, beginnings_of, blank, clauses, pair_defects, training_examples
from vigilframe.llm.subjects import accuracies, document_subjects, learn, sections
from vigilframe.llm.tokens import Encoder, encode_documents, vocabulary

PATH = vocabulary("byte_bpe_50k")


def odd_texts():
    rng = random.Random(1)
    letters = "abcé漢 \n\t'!?.1234😀"
    texts = ["", " ", "\n\n  x", "<|endoftext|> stays text", "it's we'll I'd", "a" * 9000, " " * 7000, "漢" * 5000, "xy1" * 4000, "é" * 3000]
    texts += ["".join(rng.choices("abcdefgh", k=6000)), "".join(rng.choices("ab", k=20_000)), " ".join("".join(rng.choices(letters, k=9)) for _ in range(900))]
    return texts + ["".join(rng.choices(letters, k=rng.randint(1, 400))) for _ in range(100)]


def plain():
    return Encoder(PATH).whole.encode_ordinary


def test_tree_gives_the_ids_of_the_whole():
    tool, whole = Encoder(PATH, leaf=64), plain()
    for t in odd_texts():
        assert tool.encode(t) == whole(t)
        assert tool.whole.decode(tool.encode(t)) == t


def test_every_joint_agrees():
    tool = Encoder(PATH, leaf=48)
    rng = random.Random(4)
    for _ in range(150):
        piece = "".join(rng.choices("abcdeé漢", k=rng.randint(60, 500))).encode()
        assert tool.stretch(piece) == tool.whole._encode_single_piece(piece)


def test_encode_documents(spark):
    texts = odd_texts()
    rows = list(enumerate(texts)) + [(1000, None), (1001, ""), (1002, texts[3]), (1003, texts[3])]
    df = spark.createDataFrame(rows, "id long, text string").withColumn("_text", F.lit(1)).withColumn("ids", F.lit("x"))
    whole = plain()
    got = encode_documents(df, "id", "text", PATH, segment=500, leaf=64)
    found = {r.id: list(r.ids) for r in got.collect()}
    assert len(found) == len(rows) and got.count() == len(rows)
    assert all(found[i] == (whole(t) if t else []) for i, t in rows)
    counts = {r.id: r.tokens for r in encode_documents(df, "id", "text", PATH, keep=["_text"], counts=True, segment=500, leaf=64).collect()}
    assert counts == {i: len(x) for i, x in found.items()}
    assert encode_documents(df.filter("id < 0"), "id", "text", PATH).count() == 0


REFERENCES = [
    ("Find more than 5 failed logons per host in 1 hour", 'index=auth status="failed" earliest=-1h | stats count as hits by host | where hits > 5'),
    ("Show every user with over 9 uploads in 7 days", "SELECT user, COUNT(*) AS n FROM events WHERE action='upload' GROUP BY user HAVING n > 9 LAST 7 DAYS"),
    ("Which host values had 4 or more blocked flows in 1 hour", 'FlowTable\n| where TimeGenerated > ago(1h)\n| where action == "blocked"\n| summarize n = count() by host\n| where n > 4'),
    ("Alert on more than 3 dumps per user within 2 hours", '<rule id="1" level="5" frequency="3" timeframe="7200">\n  <match>dump</match>\n  <same_field>user</same_field>\n</rule>'),
    ("Find renamed files where category mentions lorem", 'file where action == "rename" and category like~ "*lorem*" | stats n = count() by user | where n > 2'),
] * 20


@pytest.fixture(scope="module")
def tagger():
    return PairTagger(ChainField.train(training_examples(REFERENCES)), beginnings_of([r for _, r in REFERENCES]))


QUESTION = "Find more than 7 oversized answers per host where category mentions ipsum"
WHOLE = 'index=dns category="*ipsum*" | stats count as hits by host | where hits > 7'


@pytest.mark.parametrize(
    ("response", "defect"),
    [(x, "empty") for x in (None, "", " \n", "​", "```sql\n```", "N/A", "(none)", "...", "{}", "<rule></rule>", "--", "TBD")]
    + [(x, "refusal") for x in ("I can't help with that.", "```\nSorry, I am not able to write rules like that.\n```", "// Unfortunately this falls outside what I may answer.")]
    + [(x, "copy") for x in (QUESTION, QUESTION.upper(), "  ".join(QUESTION.split()[:-3]), f"{QUESTION}\n{QUESTION}", f"``` {QUESTION} ```", "Task: " + QUESTION)]
    + [(x, "language") for x in ("Hier ist die gewünschte Regel, bitte vor dem Einsatz prüfen.", f"次のクエリです。\n{WHOLE}", f"{WHOLE}\n\nLa requête suivante compte les événements par host.", f"// De volgende zoekopdracht telt de gebeurtenissen per host\n{WHOLE}")]
    + [(WHOLE[:k], "truncated") for k in (12, 18, 26, 32, 40, 57, 63, 70)]
    + [(x, "truncated") for x in (WHOLE[:60] + " …", "SELECT host, COUNT(*) AS n FROM events WHERE", "```\nFlowTable\n| where TimeGenerated > ago(", '<rule id="1" level="5">\n  <match>ip', "Sure.\nSELECT host FROM events GROUP BY host HAV")]
    + [(x, None) for x in (WHOLE, f"Sure.\n{WHOLE}", f"// {QUESTION}\n{WHOLE}", 'index=dns category=*cannot authenticate* host="Überwachung wartet..."', "I can't see the index, so a default is used:\n" + WHOLE, REFERENCES[1][1] + ";", REFERENCES[2][1], REFERENCES[3][1], REFERENCES[4][1], 'file where action == "rename"')],
)
def test_defects(tagger, response, defect):
    assert tagger.defect(QUESTION, response) == defect


def rule(response):
    """What five lines of verdicts make of a response: shapes, scripts and a few words."""
    cs = clauses(_mask(response))
    queries = [c for c in cs if c[1]]
    if any(_NOT_LATIN.search(c[0]) or _ACCENT.search(c[0]) for c in cs if not c[1]):
        return "language"
    if queries and queries[-1][2] != WHOLE_SHAPE:
        return "truncated"
    return "refusal" if not queries and re.search(r"\b(sorry|unable|cannot|can't|won't|decline|refuse)\b", response, re.I) else None


@pytest.mark.parametrize(
    ("response", "defect"),
    [(x, "language") for x in ("Der Ausdruck meldet Verbindungen", "Regeln visar alla datorer med trafik", f"// Diese Zeile kann entfallen\n{WHOLE}", f"Der Filter, bitte:\n{WHOLE}")]
    + [(x, "refusal") for x in ("Nobody here is willing to draft that.", "I have to pass on this one; please ask somebody else.", "My guidelines do not let me answer rules about offensive tools.")]
    + [(x, None) for x in (f"// asked for by Müller and José\n{WHOLE}",)],
)
def test_the_field_decides_where_rules_would_err(tagger, response, defect):
    assert tagger.defect(QUESTION, response) == defect != rule(response)


def test_words_and_neighbours_are_learned(tagger):
    names = tagger.field.names
    assert len(names) > 2000 and {"w:guidelines", "b:able to", "t:sch", "p>query", "stub"} <= set(names)
    # the same words are an answer beside a query and a refusal where there is none
    told = "I can't see the index, so a default is used:"
    assert tagger.defect(QUESTION, f"{told}\n{WHOLE}") is None


def test_pair_defects(spark):
    rows = [(1, QUESTION, WHOLE, WHOLE), (2, QUESTION, None, None), (2, QUESTION, None, None), (3, None, QUESTION, None), (4, QUESTION, WHOLE[:40], "x"), (None, QUESTION, QUESTION, None), (6, QUESTION, "x " * 200_000, None)]
    df = spark.createDataFrame(rows + [(100 + i, q, r, r) for i, (q, r) in enumerate(REFERENCES)], "id long, q string, h string, ref string").withColumn("defect", F.lit(1))
    got = sorted(((r.id, r.defect) for r in pair_defects(df, "id", "q", "h", "ref").collect()), key=str)
    assert got == sorted([(2, "empty"), (2, "empty"), (4, "truncated"), (None, "copy")], key=str)
    assert pair_defects(df.filter("id = -1"), "id", "q", "h", "ref").count() == 0


def test_long_responses_without_content():
    assert blank("<br/>" * 1000) and blank(" " * 2000 + "TBD" + "\u200b" * 2000) and blank("```\n" * 900 + "<!-- -->") and blank("\n" * 5000)
    assert not blank("<br/>" * 1000 + "index=plant") and not blank("TBD " * 1000)


TERMS = {"law": ["data subject", "court order", "privacy notice"], "plant": ["pump station", "sensor drift", "ladder program"], "crypto": ["trust anchor", "key escrow", "salted hash"]}


def corpus(n, seed):
    rng = random.Random(seed)
    docs = []
    for i in range(n):
        own = set(rng.sample(sorted(TERMS), rng.choice([0, 1, 1, 2])))
        lines = []
        for s in own:
            for _ in range(rng.randint(3, 7)):
                lines.append(f"We tuned the {rng.choice(TERMS[s])} filter {rng.randint(1, 99)} times.")
        if rng.random() < 0.4:
            s = rng.choice(sorted(set(TERMS) - own))
            lines.append(f"(A {rng.choice(TERMS[s])} is a topic for another note.)")
        lines += rng.sample(["Lunch is at noon.", "Nothing else was decided.", "A short summary follows."], 2)
        rng.shuffle(lines)
        docs.append((i, " ".join(lines), own))
    return docs


def test_subjects(spark):
    docs = corpus(600, 2)
    rng = random.Random(9)
    labels = [(i, s) for i, _, own in docs[:250] for s in own if rng.random() > 0.05] + [(3, "law"), (3, "law"), (5, "unknown"), (None, "law"), (7, None)]
    df = spark.createDataFrame([(i, t, "x") for i, t, _ in docs] + [(9000, None, None), (9001, "", "x"), (9002, "pump station " * 50_000, None)], "id long, text string, source string").withColumn("subject", F.lit(1)).withColumn("labels", F.lit(2))
    names = spark.createDataFrame([(s,) for s in TERMS], "subject string")
    got = {(r.id, r.subject) for r in document_subjects(df, spark.createDataFrame(labels, "id long, subject string"), names, "id", "text", "source").collect()}
    want = {(i, s) for i, _, own in docs for s in own}
    assert len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want)
    empty = spark.createDataFrame([], "id long, subject string")
    assert document_subjects(df, empty, names, "id", "text", "source").count() == 0
    assert document_subjects(df.filter("id < 0"), empty, names, "id", "text", "source").count() == 0


def test_learning():
    lexicon = learn([(t, "s", sorted(own)) for _, t, own in corpus(300, 3)], sorted(TERMS))
    on = lambda t: {lexicon.subjects[s] for s in lexicon.on(t.lower().split())}
    assert on("the sensor drift again") == {"plant"} and on("lunch is at noon") == set()
    assert accuracies({}) == {}


def test_queries_in_prose():
    told = lambda t: [" ".join(w) for s in sections(t) for w in s]
    prose = "The pump stopped. Its valve was open. The sensor drift came back."
    want = ["the pump stopped", "its valve was open", "the sensor drift came back"]
    assert told(prose + " !!!???---===>>>") == told(f"{prose[:-1]} !!!???---===>>>") == want
    assert told(f'{prose} Find it by state == "open".') == told(f"{prose} index=plant | stats count by host") == want
    assert told(f"{prose} Select one from the list.") == want + ["select one from the list"]
    assert told(f'<a href="http://x.org">{prose}</a>') == want
    for query in ["index=plant note=\"shut. The valve\"", "| where a == 'b. The valve'", "SELECT a, b FROM t WHERE c = 'shut. The valve'", "net where a like~ '*x*' and b == 'shut. The valve'", "=" * 40]:
        assert told(query) == [] and told(f"{query}\n{prose}") == want


def test_subjects_in_decorated_prose(spark):
    docs = corpus(300, 2)
    close = lambda t: t.replace("\n", " ") + " !!!???---===>>>"
    df = spark.createDataFrame([(i, t if i < 200 else close(t), "x") for i, t, _ in docs], "id long, text string, source string")
    labels = spark.createDataFrame([(i, s) for i, _, own in docs[:200] for s in own], "id long, subject string")
    names = spark.createDataFrame([(s,) for s in TERMS], "subject string")
    got = {(r.id, r.subject) for r in document_subjects(df, labels, names, "id", "text", "source").collect() if r.id >= 200}
    want = {(i, s) for i, _, own in docs[200:] for s in own}
    assert len(got & want) >= 0.9 * len(want) > 0
