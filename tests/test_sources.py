from pyspark.sql import functions as F

from vigilframe import source_queries
from vigilframe.sources import files


def test_exports(spark):
    df = spark.createDataFrame([(1, "a|b", 0.5), (20, None, 1.0)], "n int, t string, x double").orderBy("n")
    assert files.EXPORTS["csv"](df) == "n,t,x\n1,a|b,0.5\n20,,1.0\n"
    assert files.EXPORTS["console"](df).splitlines() == [" n  t         x", "--  ---  ------", " 1  a|b  0.5000", "20       1.0000"]
    assert files.EXPORTS["json"](df).count('"t"') == 2 and "a\\|b" in files.EXPORTS["markdown"](df) and "tabular" in files.EXPORTS["latex"](df)
    assert files.EXPORTS["console"](df.filter("n < 0")) == "n  t  x\n-  -  -"


def test_rules_and_listing(spark, tmp_path):
    xml = '<rule id="1">\n<match>a</match></rule>'
    assert files.pretty_rule(xml) == '<rule id="1">\n  <match>a</match>\n</rule>' and files.pretty_rule("<rule") == "<rule" and files.pretty_rule(None) is None
    df = spark.createDataFrame([(xml,), (None,), ("<rule",)], "r string")
    files.write_rules(df, str(tmp_path / "pretty"), "r", pretty=True)
    assert "\n  <match>a</match>\n" in "".join(r.text for r in files.read_texts(spark, str(tmp_path / "pretty"), "*.txt").collect())
    (tmp_path / "all.json").write_text("{}")
    assert files.latest_file(spark, str(tmp_path), "run-*.json") is None
    assert files.latest_file(spark, str(tmp_path), "run-*.json", "all.json").endswith("all.json")
    for name in ("run-1.json", "run-3.json"):
        (tmp_path / name).write_text("{}")
    assert files.latest_file(spark, str(tmp_path), "run-*.json", "all.json").endswith("run-3.json")
    (tmp_path / "latin.txt").write_bytes("café".encode("latin-1"))
    assert [r.text for r in files.read_texts(spark, str(tmp_path), "latin.txt").collect()] == ["café"]


def test_registered_round_trips(spark, small):
    from vigilframe.core_queries import QUERIES

    n = QUERIES["index_pattern"](spark, small).count()
    assert n > 0 and QUERIES["stream_append"](spark, small).count() < n
    good, bad = QUERIES["jsonl_lenient"](spark, small), QUERIES["jsonl_bad_lines"](spark, small)
    assert good.count() + bad.count() == source_queries._customers(spark, small).count()
    assert QUERIES["json_document"](spark, small).agg(F.count("n_name")).first()[0] == 25
