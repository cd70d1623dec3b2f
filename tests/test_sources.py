import json

import pytest
from pyspark.sql import functions as F

from tablekin.functions.frames import cut
from tablekin.functions.headers import disambiguate_headers, unique_names
from tablekin.operators import prep
from tablekin.sources.csv_lake import read_csv_lake
from tablekin.sources.frames_lake import load_lake, read_parquet_lake, store_lake
from tablekin.sources.ground_truth import ground_truth_edges, read_ground_truth
from tests.helpers import gt_of, lake_of, rows

FILES = {
    "one.csv": 'a,a,,b\n1,"x, y",NA,2\n3,4\n5,6,7,8,9\n\n7,null,é,"q""z"\n',
    "two words+.csv": "h\n",
    "empty.csv": "",
    "quoted.csv": 'k\n"line\nbreak"\n',
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("csv")
    for name, content in FILES.items():
        (path / name).write_text(content, encoding="utf-8")
    (path / "bad.csv").write_bytes(b"a,b\n\xff\xfe,1\n")
    (path / "notes.txt").write_text("a\n1\n")
    return str(path)


ONE = [("a", "1"), ("a", "3"), ("a", "7"), ("a.1", "4"), ("a.1", "None"), ("a.1", "x, y"),
       ("Unnamed: 2", "None"), ("Unnamed: 2", "None"), ("Unnamed: 2", "é"),
       ("b", "2"), ("b", "None"), ("b", 'q"z')]


@pytest.mark.parametrize("split", ["128m", "8"])
def test_csv(spark, folder, split):
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    cells, meta = (cut(frame) for frame in read_csv_lake(spark, folder, "lake"))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    one = cells.filter("table_name = 'one'").select(
        "col_name", F.coalesce("value", F.lit("None")).alias("value"))
    assert rows(one, "col_name", "value") == sorted(ONE)
    headers = meta.filter("table_name in ('one', 'two words+')")
    assert rows(headers, "table_name", "col_pos", "col_name") == [
        ("one", 0, "a"), ("one", 1, "a.1"), ("one", 2, "Unnamed: 2"), ("one", 3, "b"),
        ("two words+", 0, "h")]
    assert cells.groupBy("table_name", "col_pos", "row_id").count().filter("count > 1").count() == 0


    assert rows(cells.filter("table_name = 'quoted'"), "value") == [("line\nbreak",)]
    assert not {"bad", "empty"} & {r[0] for r in rows(meta, "table_name")}
    assert cells.filter("table_name in ('bad', 'empty')").count() == 0
    ids = cells.filter("table_name = 'one' and col_pos = 0").select("row_id")
    assert rows(ids, "row_id") == [(0,), (1,), (2,)]


def test_csv_folder_without_files(spark, tmp_path):
    (tmp_path / "notes.txt").write_text("a")
    cells, meta = read_csv_lake(spark, str(tmp_path), "lake")
    assert cells.count() == 0 and meta.count() == 0


def test_stored_lake(spark, folder, tmp_path):
    cells, meta = read_csv_lake(spark, folder, "query")
    store_lake(cells, meta, str(tmp_path))
    again, meta_again = load_lake(spark, str(tmp_path))
    key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in cells.columns])
    assert rows(cells.select(key.alias("k")), "k") == rows(again.select(key.alias("k")), "k")
    assert meta_again.count() == meta.count()


@pytest.mark.parametrize(("names", "expected"), [
    (["a", "a", "", "b"], ["a", "a.1", "Unnamed: 2", "b"]),
    (["a", "a", "a.1", "", ""], ["a", "a.2", "a.1", "Unnamed: 3", "Unnamed: 4"]),
    (["a", "", "", "b", "a"], ["a", "Unnamed: 1", "Unnamed: 2", "b", "a.1"]),
    (["x", "x", "x"], ["x", "x.1", "x.2"])])
def test_unique_names(names, expected):
    assert unique_names(names) == expected


def test_disambiguated_headers(spark):
    _, meta = lake_of(spark, {("lake", "t"): {"a": [], "b": []}})
    doubled = meta.withColumn("col_name", F.lit("a"))
    assert rows(disambiguate_headers(doubled), "col_pos", "col_name") == [(0, "a"), (1, "a.1")]


def test_typed_parquet(spark, tmp_path):
    frame = spark.sql("""select 1L as i, cast(1.50 as decimal(5,2)) as d, timestamp'2020-01-02 03:04:05'
                         as t, date'2020-01-02' as day, true as b, 'NA' as s, 'x' as table_name""")
    paths = {"p": f"{tmp_path}/a folder+%/p", "p2": f"file://{tmp_path}/p2"}
    for path in paths.values():
        frame.write.parquet(path)
    cells, meta = read_parquet_lake(spark, paths, "lake")
    values = {r["col_name"]: r["value"] for r in cells.filter("table_name = 'p'").collect()}
    assert values == {"i": "1", "d": "1.50", "t": "2020-01-02 03:04:05", "day": "2020-01-02",
                      "b": "True", "s": None, "table_name": "x"}
    types = {r["col_name"]: r["source_type"] for r in meta.filter("table_name = 'p2'").collect()}
    assert types == {"i": "integer", "d": "float", "t": "text", "day": "text", "b": "text", "s": "text",
                     "table_name": "text"}
    assert rows(cells.groupBy("table_name").count(), "table_name", "count") == [("p", 7), ("p2", 7)]


def test_parquet_tables_in_tables_and_single_files(spark, tmp_path):
    spark.range(3).repartition(2).write.parquet(f"{tmp_path}/outer")
    spark.range(2).write.parquet(f"{tmp_path}/outer/inner")
    spark.range(4).coalesce(1).write.parquet(f"{tmp_path}/one")
    file, = [str(p) for p in (tmp_path / "one").glob("part-*.parquet")]
    spark.range(6).selectExpr("id", "id % 2 as half").write.partitionBy("half").parquet(f"{tmp_path}/halves")
    tables = {"outer": f"{tmp_path}/outer", "inner": f"{tmp_path}/outer/inner", "file": file, "again": file,
              "halves": f"{tmp_path}/halves"}
    cells, meta = read_parquet_lake(spark, tables, "lake")
    counts = cells.groupBy("table_name").agg(
        F.count("*").alias("n"), F.countDistinct("row_id").alias("ids"))
    assert rows(counts, "table_name", "n", "ids") == [
        ("again", 4, 4), ("file", 4, 4), ("halves", 12, 6), ("inner", 2, 2), ("outer", 3, 3)]
    assert meta.count() == 6
    (tmp_path / "none").mkdir()
    with pytest.raises(Exception, match="none|schema|files"):
        read_parquet_lake(spark, {"none": f"{tmp_path}/none"}, "lake")


def test_ground_truth_formats(spark, tmp_path):
    expected = [("q", "a"), ("q", "b")]
    lists = spark.createDataFrame([("q.csv", ["a.csv", "b.csv", "a.csv"])],
                                  "query_table string, candidates array<string>")
    assert rows(ground_truth_edges(lists), "query_table", "cand_table") == expected
    lists.write.parquet(f"{tmp_path}/lists")
    lists.select(F.map_from_arrays(F.array("query_table"), F.array("candidates")).alias("m")).write.parquet(
        f"{tmp_path}/map")
    lists.select("query_table", F.explode("candidates").alias("cand_table")).write.json(f"{tmp_path}/edges")
    for name, fmt in (("lists", "parquet"), ("map", "parquet"), ("edges", "json")):
        got = read_ground_truth(spark, f"{tmp_path}/{name}", fmt)
        assert rows(got, "query_table", "cand_table") == expected
    empty = spark.createDataFrame([("q", [])], "query_table string, candidates array<string>")
    assert ground_truth_edges(empty).first()["cand_table"] is None


def test_preparation(spark):
    cells, meta = lake_of(spark, {("lake", "a"): {"x": [5, 6, 7]}, ("lake", "unused"): {"x": [1]},
                                  ("query", "q"): {"x": [1]}, ("query", "r"): {"x": [1]}})
    gt = gt_of(spark, {"q": ["a", "gone"]})
    tables = prep.table_names(meta)
    assert rows(prep.keep_referenced(tables, gt), "table_name") == [("a",), ("q",), ("r",)]
    assert rows(prep.keep_present(gt, tables), "cand_table") == [("a",)]
    assert rows(prep.add_self(gt), "cand_table") == [("a",), ("gone",), ("q",)]
    short = prep.truncate_tables(cells, 2, 4).filter("table_name = 'a'")
    assert rows(short, "value") == [("5",), ("6",)]
    assert prep.sample_query_tables(meta, 1).count() == 1
    names = spark.createDataFrame([("a.csv",)], "table_name string")
    assert prep.select_tables(cells, names).count() == 3
    assert prep.select_tables(cells, None).count() == cells.count()
    assert json.dumps(rows(prep.keep_queries(gt, names), "query_table")) == "[]"
