"""Guards of the cell parser, ids and small column functions."""

import pytest
from pyspark.sql import functions as F

from seqlab.functions import columns as C
from seqlab.operators import ingest


@pytest.mark.parametrize(
    ("cell", "count", "want"),
    [
        ("ALL", 5, [0, 1, 2, 3, 4]), ("all", 3, [0, 1, 2]), ("NONE", 9, []), ("", 9, []), (None, 9, []), ("nan", 9, []), ("null", 9, []), ("[]", 9, []), ("-1", 9, []), ("3", None, [3]),
        ("1,2,3", None, [1, 2, 3]), ("1 2 3", None, [1, 2, 3]), ("[1, 2, 3]", None, [1, 2, 3]), ("10-13", None, [10, 11, 12, 13]), ("13:10", None, [10, 11, 12, 13]), ("2~3, 9", None, [2, 3, 9]),
        ("[[1,3],[10,12]]", None, [1, 2, 3, 10, 11, 12]), ("[10, 15]", None, [10, 15]), ("ALL", 0, []),
    ],
)
def test_cells(spark, cell, count, want):
    df = spark.createDataFrame([(cell, count)], "cell string, count int")
    assert df.select(C.expand_index_list(F.col("cell"), F.col("count"))).first()[0] == want


def test_all_needs_a_count(spark):
    with pytest.raises(Exception, match="ALL needs a count"):
        spark.createDataFrame([("ALL", None)], "cell string, count int").select(C.expand_index_list(F.col("cell"), F.col("count"))).collect()


@pytest.mark.parametrize(("raw", "want"), [("20190909T155747I1__20190909T155747I1", "20190909T155747I1"), ("20190830T115644__B_tmp_0", "20190830T115644__B_tmp_0"), ("a__b", "a__b"), ("__", "__"), ("", "")])
def test_canonical_id(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "x string").select(C.canonical_id(F.col("x"))).first()[0] == want


def test_labels_and_references(spark):
    df = spark.createDataFrame([(" Yes", "a/000345.png"), ("0", "x_12"), ("2.5", "y-7.jpg"), ("negative", "plain")], "y string, p string")
    got = df.select(C.normalise_label(F.col("y")).alias("y"), C.item_ref(F.col("p")).alias("r")).collect()
    assert [(r.y, r.r.seq, r.r.pos) for r in got] == [(1, "a", 345), (0, "x", 12), (1, "y", 7), (0, "plain", None)]
    with pytest.raises(Exception, match="no label"):
        spark.createDataFrame([("maybe",)], "y string").select(C.normalise_label(F.col("y"))).collect()


def test_contradictory_sentinel_is_reported(spark):
    df = spark.createDataFrame([("d", 10, "ALL", "[0, 1]"), ("e", 3, "NONE", "ALL")], "seq_id string, frame_count int, pos_cell string, neg_cell string")
    got = {r.seq_id: r.sentinel_ok for r in ingest.label_sets(df).collect()}
    assert got == {"d": False, "e": True}


def test_resolve_column():
    assert ingest.resolve_column(["File", "frame_index"], ["frame", "file"]) == "File"
    assert ingest.resolve_column(["video_name"], ["video"]) == "video_name"
    assert ingest.resolve_column(["video_name"], ["video"], exact=True) is None
