"""The file source: tasks by bytes, names that are pushed down, errors as values, and formats that come back equal."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringContains, StringEndsWith, StringStartsWith

from driftglass.import_queries import as_office, as_rtf
from driftglass.session import scratch
from driftglass import import_queries
from driftglass.sources import files, imports

HARD = ["plain", "a {brace} and \\ back", "tab\tin line\nnext\n\nafter a gap", "naïve — café “q”", "astral \U0001f600\U0001f680 end", "  lead and trail  ", "5 < 6 & 7 > 2 &amp; &lt;", "日本語"]


@pytest.mark.parametrize("text", HARD)
def test_rtf_comes_back(text):
    assert files.rtf_text(as_rtf(text)) == text


def test_office_comes_back(spark):
    for text in HARD:
        got, title = files.office_text(as_office(text, "T & t"))
        want = "\n".join(" ".join(line.split()) for line in text.split("\n") if line.strip())
        row = spark.createDataFrame([(got, title)], "raw_text string, raw_title string").select(F.lit("x.docx").alias("filename"), F.lit("zip").alias("format"), "*", F.lit(None).cast("string").alias("error"))
        assert files.cleaned(row).first()["text"] == want and files.cleaned(row).first()["title"] == "T & t"


def folder_of(spark, named):
    folder = scratch(spark, "t")
    rows = spark.createDataFrame([*named.items(), (None, b"x"), ("none.txt", None)], "filename string, raw binary").withColumn("path", F.lit("clash"))
    assert imports.exported(rows.repartition(3), folder) == len(named)
    return folder


def test_errors_are_values(spark):
    named = {"a.txt": b"hello", "b.txt": b"", "c.png": b"\x89PNG\r\n", "d.zip": b"PK\x03\x04junk", "e.txt": bytes(range(1, 9)) * 50, "f.txt": b"y" * 5000, ".g.txt": b"hidden", "h.txt": b"\xff\xfeh\x00i\x00", "i.pdf": b"%PDF-1.4"}
    folder = folder_of(spark, named)
    got = {r["filename"]: (r["text"], r["error"]) for r in imports.read_imports(spark, folder, 4000).collect()}
    assert got == {
        "a.txt": ("hello", None), "b.txt": (None, "empty"), "c.png": (None, "unsupported"), "d.zip": (None, "damaged"), "e.txt": (None, "binary"), "f.txt": (None, "too-large"), "h.txt": ("hi", None), "i.pdf": (None, "unsupported"),
    }
    assert imports.read_imports(spark, scratch(spark, "nothing")).count() == 0


def test_sources_agree(spark):
    folder = folder_of(spark, {f"{i}.{e}": raw for i, t in enumerate(HARD) for e, raw in (("txt", t.encode()), ("u.txt", t.encode("utf-16")), ("rtf", as_rtf(t)), ("docx", as_office(t, "x")))})
    rows = lambda df: sorted((r["filename"], r["format"], r["length"], r["text"], r["title"], r["error"]) for r in df.collect())
    assert rows(imports.read_imports(spark, folder)) == rows(files.extracted(files.imported(spark, folder)))


def test_names_are_pushed_down(spark):
    folder = folder_of(spark, {"a.txt": b"1", "b.rtf": as_rtf("2"), "ab.rtf": as_rtf("3")})
    reader = imports.PushedReader(folder, 100)
    told = [StringEndsWith(("filename",), ".rtf"), GreaterThan(("length",), 3), StringStartsWith(("filename",), "a"), StringContains(("path",), "x")]
    assert list(reader.pushFilters(told)) == [told[1], told[3]] and [p.rsplit("/", 1)[1] for p, _ in reader.listed()] == ["ab.rtf"]
    for one, names in ((EqualTo(("filename",), "a.txt"), ["a.txt"]), (In(("filename",), ("a.txt", "b.rtf")), ["a.txt", "b.rtf"]), (StringContains(("filename",), "b."), ["ab.rtf", "b.rtf"])):
        reader = imports.PushedReader(folder, 100)
        assert list(reader.pushFilters([one])) == [] and sorted(p.rsplit("/", 1)[1] for p, _ in reader.listed()) == names
    df = imports.read_imports(spark, folder, told=F.expr("filename like '%.rtf' and length > 3"))
    assert sorted(r["text"] for r in df.collect()) == ["2", "3"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EndsWith" not in plan.split("BatchScan")[0]  # no filter on the name is left to Spark
    whole = imports.read_imports(spark, folder)
    two = whole.where("filename = 'a.txt'").unionByName(whole.where("filename = 'b.rtf'"))  # nothing is pushed here
    assert sorted(r["text"] for r in two.collect()) == ["1", "2"]


def test_tasks_are_planned_by_bytes(tmp_path, monkeypatch):
    monkeypatch.setattr(imports, "A_TASK", 1000)
    monkeypatch.setattr(imports, "TO_OPEN", 10)
    (tmp_path / "sub").mkdir()
    for name, size in (("a", 400), ("b", 500), ("c", 500), ("sub/d", 5000), ("sub/e", 5), ("_x", 5)):
        (tmp_path / name).write_bytes(bytes(size))
    dealt = lambda most: [[p.rsplit("/", 1)[1] for p, _ in t.paths] for t in imports.ImportReader(f"file://{tmp_path}", most).partitions()]
    assert dealt(10_000) == [["a", "b"], ["c"], ["d"], ["e"]] and dealt(1000) == [["a", "b"], ["c", "d", "e"]]  # what isn't read costs little


def test_small_files_are_listed_once_and_share_tasks(spark, tmp_path):
    """Spark's own cost of opening a file puts 32 of them in a task."""
    for i in range(400):
        (tmp_path / f"{i}.txt").write_text(f"file {i}")
    rows = files.extracted(files.imported(spark, str(tmp_path)))
    assert rows.rdd.getNumPartitions() <= 5 and rows.count() == 400


def test_files_are_written_few_at_a_time(spark, monkeypatch):
    """A worker's memory has a bounded number of texts and files, however many its partition has."""
    asked = []
    exported = imports.exported
    monkeypatch.setattr(imports, "exported", lambda rows, folder: (asked.append(rows.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")), exported(rows, folder))[1])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    import_queries._folder(spark, "/root/testdata/sf0.001")
    assert asked == ["256", "256"] and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_rtf_of_every_kind_of_character():
    text = "a\\b{c}\n\t\x7f\x00\r~ é日😀"
    assert import_queries.as_rtf(text) == b"{\\rtf1\\ansi{\\fonttbl{\\f0 Times;}}a\\\\b\\{c\\}\\par \t\\u127?\\u0?\\u13?~ \\u233?\\u26085?\\u-10179?\\u-8704?}"


def test_the_driver_names_folders_not_files(tmp_path, monkeypatch):
    """What a task is told doesn't grow with its files; it lists them again, but for those of a very large folder."""
    import pickle

    for name in [f"{a}/{i:04d}.{e}" for a in ("one", "two", "_no") for i in range(500) for e in ("txt", "rtf")] + ["root.rtf", ".hid.rtf"]:
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"12345")
    reader = imports.PushedReader(f"file://{tmp_path}", 100)
    assert list(reader.pushFilters([StringEndsWith(("filename",), ".rtf")])) == []
    monkeypatch.setattr(imports, "TO_OPEN", 100)
    monkeypatch.setattr(imports, "A_TASK", 105 * 300)
    want = [("root.rtf", 5)] + [(f"{a}/{i:04d}.rtf", 5) for a in ("one", "two") for i in range(500)]
    for most in (imports.LISTED_AGAIN, 400):
        monkeypatch.setattr(imports, "LISTED_AGAIN", most)
        tasks = reader.partitions()
        assert len(tasks) == 4 and all(len(list(t.paths)) <= 300 for t in tasks)
        assert [(p.removeprefix(f"{tmp_path}/"), n) for t in tasks for p, n in pickle.loads(pickle.dumps(t)).paths] == want
        assert (max(len(pickle.dumps(t)) for t in tasks) < 1000) == (most > 400)


def test_many_files_are_read_folder_by_folder(spark, monkeypatch):
    """Documents go to many folders, and Spark's reader gets a few of these at a time."""
    data = "/root/testdata/sf0.001"
    whole = {tuple(r) for r in import_queries.extracted_files(spark, data).collect()}
    monkeypatch.setattr(imports, "A_FOLDER", 10)
    asked, imported = [], files.imported
    monkeypatch.setattr(files, "imported", lambda s, path: (asked.append(len(path)), imported(s, path))[1])
    monkeypatch.setattr(import_queries, "FOLDERS_AT_ONCE", 3)
    got = import_queries.extracted_files(spark, data).collect()
    assert len(got) == len(whole) and {tuple(r) for r in got} == whole and len(asked) > 3 and max(asked) == 3
    folder = import_queries._folder(spark, data)
    assert len(imports.folders_of(f"{folder}/documents")) > 10 and imports.read_imports(spark, folder).select("filename").distinct().count() == len(got) + spark.read.parquet(f"{data}/pages.parquet").count()
