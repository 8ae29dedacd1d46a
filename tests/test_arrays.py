"""Array tracks of several sources."""

import pytest

from rangeloom.operators.tracks import merge_arrays
from rangeloom.plans.catalog import Database


def frame(spark, rows):
    return spark.createDataFrame(rows, "chrom string, start long, end long, value array<double>")


def test_merge_arrays(spark):
    nan = float("nan")
    one = frame(spark, [("a", 0, 10, [1.0, nan]), ("a", 10, 20, [2.0, 5.0]), ("b", 3, 5, [nan, None]), ("b", 7, 9, [4.0, 4.0])])
    two = frame(spark, [("a", 0, 10, [7.0, 1.0]), ("a", 30, 31, [8.0, None]), ("b", 7, 9, [nan, 4.0])])
    made, names = merge_arrays([(one, ["x", "y"]), (two, ["z", "x"])])
    assert names == ["x", "y", "z"]
    got = sorted((r.chrom, r.start, r.end, r.value) for r in made.collect())
    assert got == [("a", 0, 10, [1.0, None, 7.0]), ("a", 10, 20, [2.0, 5.0, None]), ("a", 30, 31, [None, None, 8.0]), ("b", 7, 9, [4.0, 4.0, None])]
    assert merge_arrays([(one.limit(0), ["x", "y"])])[0].collect() == []


@pytest.mark.parametrize(
    ("rows", "names", "text"),
    [
        ([("a", 0, 10, [1.5])], ["x"], "differ in x"),
        ([("a", 0, 10, [None])], ["x"], "differ in x"),
        ([("a", 5, 12, [1.0])], ["q"], "overlap"),
        ([("c", 5, 12, [1.0]), ("c", 5, 12, [1.0])], ["q"], "repeats"),
        ([("c", 5, 12, [1.0, 2.0])], ["q", "q"], "names of their own"),
    ],
)
def test_merge_arrays_refuses(spark, rows, names, text):
    with pytest.raises(ValueError, match=text):
        merge_arrays([(frame(spark, [("a", 0, 10, [1.0])]), ["x"]), (frame(spark, rows), names)])


def test_import_of_files_and_tracks(spark, tmp_path):
    chroms = spark.createDataFrame([(0, "a", 100)], "chrom_id int, chrom string, size long")
    db = Database.create(spark, str(tmp_path / "db"), chroms)
    for name, text in {"one": "chrom\tstart\tend\tx\ty\na\t0\t10\t1\t2\na\t20\t30\t3\tnan\n", "two": "chrom\tstart\tend\ty\tz\na\t0\t10\t2\t9\na\t40\t50\t\t6\n"}.items():
        (tmp_path / name).write_text(text)
    db.import_array("first", str(tmp_path / "one"), str(tmp_path / "two"))
    assert db.array_columns("first") == ["x", "y", "z"]
    (tmp_path / "three").write_text("chrom\tstart\tend\tw\na\t60\t61\t5\n")
    db.import_array("second", "first", str(tmp_path / "three"))
    got = sorted((r.start, r.end, r.value) for r in db.table("track", "second").collect())
    assert got == [(0, 10, [1.0, 2.0, 9.0, None]), (20, 30, [3.0, None, None, None]), (40, 50, [None, None, 6.0, None]), (60, 61, [None, None, None, 5.0])]
