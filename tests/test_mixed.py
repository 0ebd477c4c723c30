"""The source of mixed files: handlers, ranges of bytes, filters that leave files out, broken and unsupported files."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, IsNotNull

from tidemark.sources import mixed as X


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "in"
    (root / "deep" / "er").mkdir(parents=True)
    (root / "a.txt").write_text("one\ntwo ß")
    (root / "deep" / "b.JSON").write_text("".join(json.dumps({"text": f"t{i}", "n": i}) + "\n" for i in range(500)) + "{broken\n\n[1]\n")
    (root / "deep" / "c.csv").write_text('id,text\n1,"a ""b""\nc"\n2,\n')
    (root / "deep" / "er" / "d.html").write_text("<html><title>T &amp; U</title><script>x</script><p>one  &lt;two</p>\n</html>")
    (root / "e.bin").write_bytes(b"\0\1")
    (root / "f.md").write_text("# Head\ntext\n## Two\n")
    (root / "_hidden.txt").write_text("no")
    (root / "empty.csv").write_text("")
    return str(root)


def rows(df):
    return sorted((r["path"].rsplit("/", 1)[1], r["handler"], r["position"], r["text"], tuple(sorted((r["attributes"] or {}).items()))) for r in df.collect())


@pytest.mark.parametrize("size", [64 << 20, 700, 7])
def test_every_file_by_its_handler(spark, folder, size):
    X.register(spark)
    got = rows(spark.read.format("mixed").option("partitionBytes", size).load(folder))
    plain = [r for r in got if r[1] != "json"]
    assert plain == [
        ("a.txt", "text", 0, "one\ntwo ß", ()),
        ("c.csv", "csv", 0, 'a "b"\nc', (("id", "1"),)),
        ("c.csv", "csv", 1, "", (("id", "2"),)),
        ("d.html", "html", 0, "one <two", (("title", "T & U"),)),
        ("e.bin", "unsupported", 0, None, ()),
        ("f.md", "markdown", 0, "# Head\ntext\n## Two\n", (("headings", "Head\nTwo"),)),
    ]
    lines = [r for r in got if r[1] == "json"]
    assert len(lines) == 502 and {r[3] for r in lines if r[3]} == {f"t{i}" for i in range(500)} | {"[1]"}
    assert [r[4][0][1].split(":")[0] for r in lines if r[3] is None] == ["JSONDecodeError"]


def test_filters_leave_files_out(folder):
    reader = X.MixedReader(folder, X.STANDARD, 1 << 20)
    other = IsNotNull(("path",))
    assert list(reader.pushFilters([In(("extension",), ("csv", "json")), EqualTo(("handler",), "csv"), other])) == [other]
    assert [p[0].rsplit("/", 1)[1] for files in reader.partitions() for p in files.parts] == ["c.csv", "empty.csv"]


def test_filters_in_a_query(spark, folder):
    X.register(spark)
    df = spark.read.format("mixed").load(folder).filter("extension = 'csv' AND length(text) > 0")
    assert "extension" in df._jdf.queryExecution().executedPlan().toString() and [r["text"] for r in df.collect()] == ['a "b"\nc']


def test_own_handlers(spark, folder):
    own = X.STANDARD.copy()

    @own.register("shout", ".TXT", priority=5, capabilities=("text",))
    def shout(stream):
        yield 7, stream.read().decode().upper(), {"loud": "yes"}

    @own.register("fails", "bin")
    def fails(stream):
        raise OSError("unreadable")
        yield

    X.register(spark, own, "louder")
    got = spark.read.format("louder").load(folder)
    assert rows(got.filter("extension = 'txt'")) == [("a.txt", "shout", 7, "ONE\nTWO SS", (("loud", "yes"),))]
    assert rows(got.filter("handler = 'fails'"))[0][4] == (("error", "OSError: unreadable"),)
    assert [h.name for h in own.able_to("text")] == ["shout", "html", "markdown", "text", "xml"] and X.STANDARD.of("txt").name == "text"


def test_ranges_of_a_large_file_and_an_empty_folder(spark, folder, tmp_path):
    parts = X.MixedReader(folder, X.STANDARD, 700).partitions()
    assert sum(len(p.parts) for p in parts) > 15 and max(len(p.parts) for p in parts) < 8
    (tmp_path / "none").mkdir()
    X.register(spark)
    assert spark.read.format("mixed").load(str(tmp_path / "none")).agg(F.count("*")).first()[0] == 0
