"""Registered queries against their SQL on the smallest tables, streams against batch, and files."""

import duckdb
import pytest
from pyspark.sql import functions as F

from seqlab.operators import ingest
from seqlab.plans import ingest_queries, study_queries
from seqlab.sources import files

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = ingest_queries.R.queries | study_queries.R.queries
SQL = ingest_queries.R.sql | study_queries.R.sql
@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(table, columns):
    norm = lambda x: round(x, 6) + 0.0 if isinstance(x, float) else x
    return sorted((tuple(norm(v) for v in r) for r in zip(*(table.column(c).to_pylist() for c in columns), strict=True)), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, oracle, name):
    got, want = QUERIES[name](spark, SF).toArrow(), oracle.sql(SQL[name]).to_arrow_table()
    columns = sorted(got.column_names)
    assert columns == sorted(want.column_names)
    assert plain(got, columns) == plain(want, columns)


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "labels.csv").write_bytes("filename,label\n视频,1\n".encode("gb18030"))
    table, found = files.read_labels_csv(spark, f"file://{tmp_path}/labels.csv")
    assert found == "gb18030" and table.first()["filename"] == "视频"
    root = tmp_path / "items/train/v1__v1"
    root.mkdir(parents=True)
    (root / "000003.jpg").write_bytes(b"x")
    got = files.read_items(spark, f"file://{tmp_path}/items").first()
    assert (got.split, got.raw, got.seq_id, got.pos) == ("train", "v1__v1", "v1", 3)
    (tmp_path / "items/train/v1").mkdir()
    (tmp_path / "items/train/v1/000003.jpg").write_bytes(b"x")
    with pytest.raises(ingest.IngestError, match="share an id"):
        files.read_items(spark, f"file://{tmp_path}/items")
    index = spark.createDataFrame([("a", 1, 0, "train"), ("a", 0, 1, "train"), ("b", 0, 1, "val")], "seq_id string, pos int, label int, orig_split string")
    files.write_index(index, f"file://{tmp_path}/index")
    assert spark.read.parquet(f"file://{tmp_path}/index").filter("orig_split = 'train'").count() == 2
    files.write_splits(index.select("seq_id", F.col("orig_split").alias("split")).distinct(), f"file://{tmp_path}/splits")
    assert files.read_splits(spark, f"file://{tmp_path}/splits").count() == 2
    files.write_report(index, f"file://{tmp_path}/report", "markdown")
    assert spark.read.text(f"file://{tmp_path}/report").count() == 5
    (tmp_path / "runs").mkdir()
    (tmp_path / "runs/a.json").write_text('{"run": "r", "condition": {"name": "c", "n_train": 4}, "seed": 1, "model_type": "m", "results": {"raw": {"f1": 0.5}, "smoothed": {"f1": 0.25}}, "history": []}')
    assert sorted((r.variant, r.f1) for r in files.read_runs(spark, f"file://{tmp_path}/runs").collect()) == [("raw", 0.5), ("smoothed", 0.25)]


@pytest.mark.parametrize("size", ["17b", "128m"])
@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "gb18030", "big5", "cp1252", "latin-1"])
def test_label_files_in_ranges(spark, tmp_path, encoding, size):
    """Ranges of 17 bytes: their borders lie inside characters, cells and line breaks."""
    words = {"cp1252": "naïve “quoted”", "latin-1": "caf\xe9 \x81"}.get(encoding, "视频影片中文")
    if encoding == "big5":
        words = "影片中文"
    rows = [(f"{words}{i}", str(i % 2), f"a,{words}") for i in range(300)]
    text = "filename,label,note\r\n" + "".join(f'{a},{b},"{c}"\r\n' for a, b, c in rows)
    (tmp_path / "labels.csv").write_bytes(text.encode(encoding))
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        table, found = files.read_labels_csv(spark, f"file://{tmp_path}/labels.csv", "big5" if encoding == "big5" else None)  # its bytes are valid in gb18030 too, which comes first
        assert found == encoding
        got = [tuple(r) for r in table.collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert sorted(got) == sorted(rows)


def test_quoted_line_breaks(spark, tmp_path):
    (tmp_path / "labels.csv").write_bytes('filename,label\n"视\n频",1\nb,0\n'.encode("gb18030"))
    table, found = files.read_labels_csv(spark, f"file://{tmp_path}/labels.csv")
    assert found == "gb18030" and sorted(map(tuple, table.collect())) == [("b", "0"), ("视\n频", "1")]
    with pytest.raises(ingest.IngestError, match="encoding is one of"):
        files.read_labels_csv(spark, f"file://{tmp_path}/labels.csv", "ebcdic")


def test_join_gate(spark):
    items = spark.createDataFrame([("a", 0, "train"), ("b", 0, "train")], "seq_id string, pos int, orig_split string")
    labels = spark.createDataFrame([("a", 0, 1)], "seq_id string, pos int, label int")
    with pytest.raises(ingest.IngestError, match="not fully labelled"):
        ingest.require_complete(ingest.label_items(items, labels, ["seq_id", "pos"]), "orig_split", "seq_id")
