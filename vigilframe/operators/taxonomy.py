"""Techniques and tactics: look-ups, weighted rules that classify texts, checks of given labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigilframe.functions.text import sub_technique_ok, tactic_name, technique_ok

RULE_SCHEMA = "rule int, tactic string, technique string, sub_technique string, least double, strict boolean, weight double, pattern string"

# A starter set: rule, tactic, technique, sub-technique, least score, all groups needed, then (weight, pattern) of its groups.
STARTER = [
    ("credential-access", "T1110", "T1110.001", 0.85, True, [(0.5, r"\b(ssh|rdp|smb|ftp|winrm)\b"), (0.5, r"failed.*(login|logon|auth)|brute.?force|password.?guess")]),
    ("credential-access", "T1110", "T1110.003", 0.6, False, [(0.6, r"password.?spray|spraying"), (0.4, r"(many|multiple|distinct) (accounts|users)")]),
    ("credential-access", "T1110", None, 0.85, False, [(0.9, r"password guesses|rejected sign-ins|failed log(in|on)s")]),
    ("credential-access", "T1003", None, 0.85, False, [(0.9, r"memory dumps?|credential dump")]),
    ("execution", "T1059", "T1059.001", 0.85, False, [(0.9, r"powershell")]),
    ("execution", "T1059", None, 0.85, False, [(0.9, r"starting shells|launches .*shell")]),
    ("persistence", "T1053", "T1053.005", 0.85, False, [(0.9, r"scheduled (task|job)")]),
    ("persistence", "T1547", None, 0.85, False, [(0.9, r"autostart|run key")]),
    ("lateral-movement", "T1021", "T1021.001", 0.85, False, [(0.9, r"remote desktop|\brdp sessions?\b")]),
    ("lateral-movement", "T1021", "T1021.002", 0.85, False, [(0.9, r"file-share sessions|file shares? .*opened|admin share")]),
    ("exfiltration", "T1048", None, 0.85, False, [(0.9, r"large uploads|uploads? .*bytes")]),
    ("command-and-control", "T1071", "T1071.004", 0.85, False, [(0.9, r"text-record lookups|random names|dns tunnel")]),
    ("discovery", "T1046", None, 0.85, False, [(0.9, r"port scan|touches \d+ ports")]),
    ("defense-evasion", "T1562", None, 0.85, False, [(0.9, r"disables? protection|disabled protection")]),
    ("impact", "T1486", None, 0.85, False, [(0.9, r"renames? \d+ documents|mass deletions|deletes backups")]),
]


def starter_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, t, k, s, least, strict, w, p) for n, (t, k, s, least, strict, groups) in enumerate(STARTER) for w, p in groups], RULE_SCHEMA)


def classify(df: DataFrame, text: str, rules: DataFrame, threshold: float = 0.85) -> DataFrame:
    """``df`` with tactic, technique, sub_technique and confidence; null where no rule is sure enough.

    A rule's score is the sum of the weights of the groups whose pattern is found (at most 1), if it reaches the rule's
    least score and, for strict rules, no group is missed.  The best rule wins; of equal ones one with a
    sub-technique, then the first.  Rules are few and become one expression, so texts are read once, without a join.
    """
    groups: dict[int, list] = {}
    for r in rules.orderBy("rule").collect():  # the rules are a given, small table
        groups.setdefault(r.rule, []).append(r)
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    scored = []
    for n, parts in groups.items():
        hits = [low.rlike(p.pattern) for p in parts]
        total = sum((F.when(h, float(p.weight)).otherwise(0.0) for h, p in zip(hits, parts)), F.lit(0.0))
        enough = total >= parts[0].least - 1e-9
        for h in hits if parts[0].strict else ():
            enough = enough & h
        score = F.when(enough, F.least(F.lit(1.0), total)).otherwise(0.0)
        first = parts[0]
        scored.append(F.struct(F.round(score, 4).alias("confidence"), F.lit(int(first.sub_technique is not None)).alias("has_sub"), F.lit(-n).alias("order"), F.lit(first.tactic).alias("tactic"), F.lit(first.technique).alias("technique"), F.lit(first.sub_technique).cast("string").alias("sub_technique")))
    if not scored:
        return df.withColumns({c: F.lit(None).cast("string") for c in ("tactic", "technique", "sub_technique")}).withColumn("confidence", F.lit(None).cast("double"))
    best = F.array_max(F.array(*scored))
    found = df.withColumn("_b", F.when(best["confidence"] >= threshold, best))
    return found.withColumns({c: F.col(f"_b.{c}") for c in ("tactic", "technique", "sub_technique", "confidence")}).drop("_b")


def label_problems(df: DataFrame, taxonomy: DataFrame, technique: str, sub_technique: str, tactic: str) -> DataFrame:
    """``df`` with ``problems``: what is wrong with its labels as against the taxonomy (technique_id, tactic_names)."""
    known = taxonomy.groupBy(F.col("technique_id").alias("_t")).agg(F.flatten(F.collect_set("tactic_names")).alias("_tactics"))
    t, s = F.col(technique), F.col(sub_technique)
    joined = df.join(known, t == F.col("_t"), "left")
    tactics = F.transform(F.coalesce("_tactics", F.array().cast("array<string>")), tactic_name)
    notes = [
        (t.isNull(), "no technique"), (t.isNotNull() & ~technique_ok(t), "malformed technique"), (technique_ok(t) & F.col("_t").isNull(), "unknown technique"),
        (s.isNotNull() & ~F.coalesce(sub_technique_ok(s, t), F.lit(False)), "sub-technique of another technique"),
        (F.col("_t").isNotNull() & (F.size(tactics) > 0) & F.col(tactic).isNotNull() & ~F.array_contains(tactics, tactic_name(F.col(tactic))), "tactic of another technique"),
    ]
    return joined.withColumn("problems", F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), n) for c, n in notes)), lambda x: x.isNotNull())).drop("_t", "_tactics")


def rule_technique(rule: Column) -> Column:
    """The technique named in a rule document; null where it has none or a malformed one."""
    found = F.trim(F.regexp_extract(rule, r"(?s)<mitre>.*?<id>\s*(T\d{4}(?:\.\d{3})?)\s*</id>", 1))
    return F.when(found != "", found)


def techniques_of(taxonomy: DataFrame, tactic: str) -> DataFrame:
    return taxonomy.filter(F.exists("tactic_names", lambda t: tactic_name(t) == tactic_name(F.lit(tactic))))


def first_children(taxonomy: DataFrame, n: int = 4) -> DataFrame:
    """The first ``n`` different sub-techniques of each parent."""
    ids = taxonomy.filter("parent_id is not null").select("parent_id", "technique_id").distinct()
    w = Window.partitionBy("parent_id").orderBy("technique_id")
    return ids.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= n)
