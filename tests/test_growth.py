"""What must not go through one task, one group or the driver as tables grow."""

from pyspark.sql import functions as F

from strandflow.functions.sequence import first_entries
from strandflow.operators import scan, sorting
from strandflow.operators.views import Views
from strandflow.plans import catalog
from strandflow.sources import sam
from test_scale import RANGE, reads

DIR = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_unfolded_positions_are_not_broadcast(spark):
    plan = _plan(catalog.queries()["multi_file_depth_zero_filled"](spark, DIR))
    assert "BroadcastNestedLoopJoin" in plan and "BroadcastNestedLoopJoin BuildLeft" not in plan


def test_places_do_not_deal_a_group_to_one_task(spark):
    rows = reads(spark, [("b", 5, "1M", "A"), ("a", 9, "1M", "A")], "f").unionByName(reads(spark, [("c", 7, "1M", "A")], "g"))
    placed = sorting.place(rows, "place", "file")
    assert "SortMergeJoin" not in _plan(placed) and "ShuffledHashJoin" not in _plan(placed)
    assert {(r.file, r.qname, r.place) for r in placed.collect()} == {("f", "b", 1), ("f", "a", 2), ("g", "c", 1)}


def test_callbacks_by_group_over_batches(spark):
    """Groups, that of null too, are cut rightly where Arrow batches end inside them; whole numbers stay such beside a group with nulls."""
    import pandas as pd

    values = {None: [5, 6, 7], 1: [None, 2], 2: list(range(11)), 3: [4], 4: [8, 9]}
    rows = spark.createDataFrame([(k, v) for k, own in values.items() for v in own], "g int, v int").repartition(3)

    def fun(f):
        return pd.DataFrame({"g": f["g"].iloc[:1], "v": [",".join(map(str, f["v"]))]})

    for size in ("1", "3", "10000"):
        before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = {(r.g, r.v) for r in scan.apply_groups(rows, "g", fun, "g int, v string", n=4).collect()}
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
        assert got == {(None, "5,6,7"), (1, "nan,2.0"), (2, "0,1,2,3"), (2, "4,5,6,7"), (2, "8,9,10"), (3, "4"), (4, "8,9")}


def test_views_do_not_deal_a_file_to_one_task(spark):
    samples = spark.createDataFrame([("one", "f"), ("two", "g")], "sample string, file string").repartition(2)
    rows = reads(spark, [("r1", 1, "3M", "ACG"), ("r2", 3, "3M", "ACG")], "f").repartition(2)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        views = Views(rows, spark.createDataFrame([(1, "c", 1, 9)], RANGE), samples)
        assert "hashpartitioning(file" not in _plan(views.scan())
        assert {(r.range_id, r.qname) for r in views.scan().collect()} == {(1, "r1"), (1, "r2")}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_sam_lines_are_made_and_cut_once(spark):
    """Neither the test for header lines nor each tag of a line makes or cuts the line again."""
    plan = _plan(catalog.queries()["sam_text_round_trip"](spark, DIR))
    assert plan.count("concat_ws(\t") == 1 and plan.count("split(line") == 1


def test_sam_lines_of_a_table_in_one_split_are_made_by_all_cores(spark):
    rows = catalog.queries()["sam_text_round_trip"](spark, DIR)
    assert {r.p for r in rows.select(F.spark_partition_id().alias("p")).distinct().collect()} == set(range(spark.sparkContext.defaultParallelism))


def test_sam_lines_of_headers_and_repeated_tags(spark):
    rows = "n{0}\t0\tc\t{0}\t9\t3M\t*\t0\t0\tACG\tIII"
    lines = ["@CO\tNM:i:1", "", None, rows.format(1), rows.format(2) + "\tNM:i:1\tXB:B:f,1.5,2\tNM:Z:x:y\tZZ:Z:x:y\tXB:i:3", rows.format(3) + "\tXQ:Q\tLN:i:word"]
    got = sam.parse(spark.createDataFrame([(x, "f") for x in lines], "line string, file string"))
    tags = {r.qname: {k: {n: v for n, v in t.asDict().items() if v is not None} for k, t in r.tags.items()} for r in got.collect()}
    assert tags == {
        "n1": {}, "n2": {"NM": {"type": "i", "i": 1}, "XB": {"type": "B", "ad": [1.5, 2.0]}, "ZZ": {"type": "Z", "s": "x:y"}}, "n3": {"XQ": {"type": "Q"}, "LN": {"type": "i"}},
    }
    assert {r.file for r in got.collect()} == {"f"} and got.columns[-1] == "file"


def test_first_entries_pass_over_null_keys(spark):
    row = spark.sql("SELECT array(null, 'a', 'b', 'a') AS k, array('0', '1', '2', '3') AS v, CAST(null AS ARRAY<STRING>) AS n")
    got = row.select(first_entries(F.col("k"), F.col("v")).alias("m"), first_entries(F.col("n"), F.col("v")).alias("none")).first()
    assert got.m == {"a": "1", "b": "2"} and got.none is None
