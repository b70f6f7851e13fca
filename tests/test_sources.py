from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from labelloom import storage
from labelloom.sources import readers, writers


def test_quoted_csv_and_empty_text(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(
        "tweet_id,sentiment,author,content\n"
        '1,sad,a,"he said ""hi"", ok"\n'
        "2,sad,b,\n"
        '3,joy,c,"two\nlines"\n'
    )
    rows = {r["tweet_id"]: r["content"] for r in readers.read_labelled_csv(spark, str(path), multi_line=True).collect()}
    assert rows == {1: 'he said "hi", ok', 2: None, 3: "two\nlines"}
    kept = readers.read_labelled_csv_not_null(spark, str(path), multi_line=True)
    assert sorted(r["tweet_id"] for r in kept.collect()) == [1, 3]


def test_csv_columns_are_found_by_name(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("content,author,tweet_id,sentiment\nhello,a,7,joy\n")
    row = readers.read_labelled_csv(spark, str(path), multi_line=True).first()
    assert row.asDict() == {"tweet_id": 7, "sentiment": "joy", "author": "a", "content": "hello"}


def test_csv_round_trip_keeps_awkward_text(spark, tmp_path):
    texts = [' lead and "quote"', "back\\slash, comma", "line\r\nbreak ", "é"]
    df = spark.createDataFrame(
        [(i, "s", "a", x) for i, x in enumerate(texts)], readers.TWEET_SCHEMA
    )
    writers.write_csv(df, str(tmp_path / "out"))
    back = readers.read_labelled_csv(spark, str(tmp_path / "out"), multi_line=True).orderBy("tweet_id")
    assert [r["content"] for r in back.collect()] == texts


def test_numeric_lines_skip_blank_rows(spark, tmp_path):
    path = tmp_path / "n.csv"
    path.write_text("1.5,2,0\n\n,,\n3,4,1\n")
    rows = readers.read_numeric_lines(spark, str(path), ["a", "b"]).orderBy("a").collect()
    assert [tuple(r) for r in rows] == [(1.5, 2.0, 0), (3.0, 4.0, 1)]


def test_files_two_levels_below_the_root_only(spark, tmp_path):
    for name, text in [
        ("truthful/fold1/a.txt", "Nice\r\n\r\nplace\n"), ("truthful/fold2/c.txt", ""),
        ("deceptive/fold1/b.txt", "Bad"), ("truthful/x.txt", "loose"),
    ]:
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode())
    files = readers.read_labelled_files(
        spark, {"t": [f"{tmp_path}/truthful"], "d": [f"{tmp_path}/deceptive"]}
    ).withColumn("name", F.regexp_extract("path", "[^/]+$", 0))
    rows = {r["name"]: (r["label"], r["text"]) for r in files.collect()}
    assert rows["a.txt"] == ("t", "Nice\r\n\r\nplace\n")
    assert rows["b.txt"] == ("d", "Bad")
    assert "x.txt" not in rows
    lines = readers.lines_of(files.filter("name = 'a.txt'"), "name").orderBy("line_no").collect()
    assert [(r["line"], r["words"], r["n_words"]) for r in lines] == [
        ("Nice", ["nice"], 1), ("", [""], 1), ("place", ["place"], 1),
    ]


def test_word_vector_text_with_size_header(spark, tmp_path):
    path = tmp_path / "v.txt"
    path.write_text("2 3\ncat 1 0.5 -2\ndog 0 0 1e-3\n")
    rows = {r["word"]: r["vector"] for r in readers.read_word_vectors(spark, str(path)).collect()}
    assert rows["cat"] == [1.0, 0.5, -2.0]
    assert rows["dog"] == pytest.approx([0, 0, 1e-3])


def test_short_rows_are_dropped(spark):
    lines = spark.createDataFrame([("1,2,a",), ("",), ("5",), ("3,b",)], "value string")
    rows = readers.split_fields(lines).collect()
    assert [(r["features"], r["label"]) for r in rows] == [([1.0, 2.0], "a"), ([3.0], "b")]


def test_split_parts_are_read_back_with_partition_pruning(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id int, split string")
    writers.write_split(df, str(tmp_path / "s"))
    part = writers.read_split(spark, str(tmp_path / "s"), "a")
    assert sorted(r["id"] for r in part.collect()) == [1, 3]
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_metrics_are_appended(spark, tmp_path):
    path = str(tmp_path / "m")
    rows = spark.createDataFrame([(1, "train", 0.5, 0.1)], "step long, series string, loss double, accuracy double")
    writers.append_metrics(rows, path, "r1")
    writers.append_metrics(rows.withColumn("step", F.lit(2).cast("long")), path, "r1")
    assert writers.read_metrics(spark, path).count() == 2


def test_vocabulary_round_trip(spark, tmp_path):
    words = spark.createDataFrame([("a", 1), ("b", 2)], "word string, word_id int")
    vectors = spark.createDataFrame([("a", [1.0])], "word string, vector array<float>")
    writers.write_vocabulary(str(tmp_path), words, vectors, words.filter("word = 'b'"))
    back = writers.read_vocabulary(spark, str(tmp_path))
    assert [t.count() for t in back] == [2, 1, 1]


def test_shared_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert storage.shared_dir(spark) == named
    assert storage.new_path(spark, "x").startswith(named)


def test_preview_and_schema(spark):
    df = spark.range(20).withColumnRenamed("id", "k")
    assert [r["k"] for r in writers.preview(df, "k", 3).collect()] == [0, 1, 2]
    assert writers.schema_table(df) == [("k", "bigint")]


@pytest.mark.parametrize("master", ["local[4]", "spark://host:7077"])
def test_only_a_local_session_gets_its_own_folder(master):
    context = SimpleNamespace(master=master, applicationId=f"app-{master}")
    conf = SimpleNamespace(get=lambda key, default: default)
    session = SimpleNamespace(conf=conf, sparkContext=context)
    if master.startswith("local"):
        assert storage.shared_dir(session) == storage.shared_dir(session)
    else:
        with pytest.raises(ValueError):
            storage.shared_dir(session)


def test_labelled_files_keep_their_document(spark, tmp_path):
    import __spark_entry__ as entry

    spark.createDataFrame([(1, "x"), (2, "y\nz"), (7, "x")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1), (2, 0), (7, 1), (9, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = entry.queries()["src_labelled_files"](spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["label"], r["n_chars"]) for r in rows) == [(1, "truthful", 2), (2, "deceptive", 4), (7, "truthful", 2)]
    assert "SELECT l.doc_id, " in entry.oracle_sql()["src_labelled_files"]


def test_labelled_files_are_written_by_all_cores_and_listed_by_few_tasks(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(12 * cores).selectExpr("'a' as root", "id as doc_id", "concat('text ', id) as text").coalesce(1)
    writers.write_labelled_files(rows, str(tmp_path / "files"), "root", "doc_id")
    names = [f.name for f in (tmp_path / "files").glob("root=a/*/*.txt")]
    assert len(names) == 12 * cores and len({n.split("-")[1] for n in names}) > cores
    spark.sparkContext.setJobGroup("listing", "files are listed")
    try:
        files = readers.read_labelled_files(spark, {"x": [f"{tmp_path}/files/root=a"]})
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    assert max(tasks) <= 4 * cores
    assert {r["text"] for r in files.collect()} == {f"text {i}\n" for i in range(12 * cores)}
    assert int(spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")) == 10_000
