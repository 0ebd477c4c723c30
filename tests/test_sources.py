import json

from pyspark.sql import functions as F

from tidemark.sources import readers as R
from tidemark.sources import writers as W


def put(folder, name, text):
    (folder / name).write_text(text, encoding="utf-8")
    return str(folder / name)


def test_csv_and_lines(spark, tmp_path):
    df = R.csv(spark, put(tmp_path, "a.csv", 'x,y\n1,"a,b"\n2,c\n'))
    assert [tuple(r) for r in df.collect()] == [("1", "a,b"), ("2", "c")]
    assert [r["line"] for r in W.csv_lines(df).collect()] == ['1,"a,b"', "2,c"]
    assert [json.loads(r["line"]) for r in W.json_lines(df).collect()] == [{"x": "1", "y": "a,b"}, {"x": "2", "y": "c"}]
    assert [r["line"] for r in W.markdown_rows(df).collect()] == ["| 1 | a,b |", "| 2 | c |"]


def test_ndjson_skips_bad_lines(spark, tmp_path):
    df = R.ndjson(spark, put(tmp_path, "a.jsonl", '{"a": 1}\nnot json\n{"a": 2}\n'), "a long")
    assert sorted(r["a"] for r in df.collect()) == [1, 2]


def test_text_paragraphs_and_markdown(spark, tmp_path):
    df = R.texts(spark, put(tmp_path, "a.md", "# Title\n\nfirst\npart\n\n## Sub\nlast"))
    assert [r["text"] for r in R.paragraphs(df).orderBy("pos").collect()] == ["# Title", "first\npart", "## Sub\nlast"]
    assert [(r["kind"], r["level"], r["text"]) for r in R.markdown(df).orderBy("pos").collect()][0] == ("heading", 1, "Title")


def test_html(spark):
    page = '<html><title>T</title><meta name="d" content="x"><h1>A</h1><a href="u">l</a><img src="i"><table><tr><th>k</th></tr><tr><td>v</td></tr></table></html>'
    r = spark.createDataFrame([(page,)], "h string").select(R.html_parts(F.col("h")).alias("p"), R.html_rows(F.col("h")).alias("t")).first()
    assert (r["p"]["title"], r["p"]["meta"], r["p"]["headings"], r["p"]["links"], r["p"]["images"]) == ("T", {"d": "x"}, ["A"], ["u"], ["i"]) and r["t"] == [["k"], ["v"]]


def test_xml_json_and_ontology(spark, tmp_path):
    assert R.xml(spark, put(tmp_path, "a.xml", "<r><e><n>1</n></e><e><n>2</n></e></r>"), "e").count() == 2
    assert R.json_documents(spark, put(tmp_path, "a.json", '{\n"k": 5}')).first()["k"] == 5
    kinds, edges = R.ontology(spark, put(tmp_path, "o.json", '{"entity_types": {"P": {"required": ["n"], "optional": []}}, "relationship_types": {"W": {"domain": ["P"], "range": ["O", "Q"]}}}'))
    assert kinds.first()["required"] == ["n"] and edges.count() == 2


def test_mails_and_files(spark, tmp_path):
    path = put(tmp_path, "a.eml", "From: a@b.c\nTo: d@e.f\nSubject: Hi\n\nBody text\n")
    r = R.mails(R.texts(spark, path)).first()
    assert (r["sender"], r["recipients"], r["subject"], r["body"].strip(), r["attachments"]) == ("a@b.c", "d@e.f", "Hi", "Body text", [])
    put(tmp_path, "b.zzz", "x")
    assert {(r["extension"], r["handler"]) for r in R.files(spark, str(tmp_path)).collect()} == {("eml", "mail"), ("zzz", "unsupported")}


def test_sinks(spark, tmp_path):
    metrics = spark.createDataFrame([("Llm", "p-50", 1.5), ("Llm", "none", None)], "category string, name string, value double")
    assert [r["line"] for r in W.prometheus(metrics).collect()] == ["# TYPE llm_p_50 gauge", "llm_p_50 1.5"]
    rows = spark.createDataFrame([('{"password": "x", "a": "y"}', "2024-01-01")], "data string, d string").withColumn("ts", F.col("d").cast("timestamp"))
    assert W.redacted(rows).first()["data"] == '{"password": "***", "a": "y"}'
    W.write_daily(rows, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1
    assert W.dead_letters(rows.select("d"), "boom").first()["retries"] == 0
    assert [r[0] for r in spark.createDataFrame([("image/png",), ("text/plain",), ("x/y",)], "m string").select(R.content_kind(F.col("m"))).collect()] == ["image", "document", "other"]
    assert R.sql_like(metrics, ["name"], "P-5", "name", 5).count() == 1
