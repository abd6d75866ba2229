import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from editloom.sources import dimensions as dim


def test_libraries_are_stacked_by_their_sequence_column(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Name (unique),Sequence context (56nt)\nx,ACGT\n")
    (tmp_path / "b.csv").write_text("Name (unique),Sequence context (61nt),Design category\ny,GGCC,vivo\n")
    rows = dim.read_libraries(spark, {"LibA": f"file://{tmp_path}/a.csv", "CtoT": f"file://{tmp_path}/b.csv"})
    assert sorted((r["Name (unique)"], r.seq, r.library, r["Design category"]) for r in rows.collect()) == [("x", "ACGT", "LibA", None), ("y", "GGCC", "CtoT", "vivo")]
    (tmp_path / "c.csv").write_text("Name (unique)\nz\n")
    with pytest.raises(ValueError):
        dim.read_libraries(spark, {"AtoG": f"file://{tmp_path}/c.csv"})


def test_design_tables_have_their_schema(spark, tmp_path):
    (tmp_path / "d.csv").write_text("Name,Editor\nc0,BE4\n,ABE\n")
    assert [tuple(r) for r in dim.read_design(spark, f"file://{tmp_path}/d.csv", "name string, editor string").collect()] == [("c0", "BE4"), (None, "ABE")]


def test_datasets_are_pruned_and_replaced_by_condition(spark, tmp_path):
    path = f"file://{tmp_path}/g4"
    dim.store(spark.createDataFrame([("c0", 1), ("c1", 2)], "condition string, v int"), path)
    dim.store(spark.createDataFrame([("c1", 3)], "condition string, v int"), path)
    got = dim.load(spark, path, ["c1", "absent"])
    assert [(r.condition, r.v) for r in got.collect()] == [("c1", 3)] and dim.load(spark, path).count() == 2
    assert "PartitionFilters: [" in got._jdf.queryExecution().toString() and "condition" in got._jdf.queryExecution().toString()


def test_unknown_conditions_fail(spark):
    dims = dim.levels(spark.createDataFrame([("c0",)], "name string"), spark.createDataFrame([("g", ["c0"])], "name string, members array<string>"), spark.createDataFrame([], "name string"))
    assert {(r.name, r.level, r.l1_name) for r in dim.resolve(dims.select("name"), dims).collect()} == {("c0", "L1", "c0"), ("g", "L2", "c0")}
    with pytest.raises(PySparkException, match="unknown condition zz"):
        dim.resolve(spark.createDataFrame([("zz",)], "name string"), dims).collect()


def test_nuclease_conditions_go(spark):
    df = spark.createDataFrame([("mES_Cas9_x",), ("mES_BE4",)], "condition string")
    assert [r[0] for r in dim.without_nuclease(df).collect()] == ["mES_BE4"]
    assert [r[0] for r in df.select(dim.editor_kind(F.lit("CDA"))).distinct().collect()] == ["CBE"]
