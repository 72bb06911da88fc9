"""CSV files of several headers, read by name in a fixed number of jobs."""

import pytest
from pyspark.sql import types as T

from roadflow.sources import feeds

SCHEMA = T.StructType([T.StructField("Id", T.StringType()), T.StructField("x", T.DoubleType()), T.StructField("n", T.IntegerType())])


def folder(tmp_path, files):
    for name, text in files.items():
        (tmp_path / name).write_bytes(text.encode("utf-8"))
    return str(tmp_path)


def jobs(spark, group, work):
    context = spark.sparkContext
    context.setJobGroup(group, group)
    try:
        out = work()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    return out, len(context.statusTracker().getJobIdsForGroup(group))


def test_columns_go_by_the_header_of_each_file(spark, tmp_path):
    path = folder(tmp_path, {
        "a.csv": "Id,x,n\na1,1.5,1\na2,,2\n",
        "b c [1].csv": "n,junk,Id\n3,zzz,b1\n",
        "marked.csv": "﻿Id,x\r\nm1,2.5\r\n",
        "quoted.csv": '"x","Id"\n3.5,"q,1"\n',
        "twice.csv": "Id,x,x\nt1,4.5,9.9\n",
        "blank first.csv": "\n\nId,x,n\nf1,5.5,5\n",
        "header only.csv": "x,n,Id\n",
        "empty.csv": "",
    })
    got = {(r["Id"], r["x"], r["n"]) for r in feeds.read_csv(spark, path, SCHEMA).collect()}
    assert got == {("a1", 1.5, 1), ("a2", None, 2), ("b1", None, 3), ("m1", 2.5, None), ("q,1", 3.5, None),
                   ("t1", 4.5, None), ("f1", 5.5, 5)}


def test_folder_of_empty_files_has_no_rows(spark, tmp_path):
    out = feeds.read_csv(spark, folder(tmp_path, {"empty.csv": "", "blank.csv": "\n \n"}), SCHEMA)
    assert out.schema == SCHEMA and out.count() == 0


@pytest.mark.parametrize("kinds", [1, 3])
def test_jobs_do_not_grow_with_the_files(spark, tmp_path, kinds):
    heads = ["Id,x,n", "n,Id,x", "x,n,Id"][:kinds]

    def deliver(count):
        home = tmp_path / str(count)
        home.mkdir()
        for i in range(count):
            names = heads[i % kinds].split(",")
            row = {"Id": f"r{i}", "x": str(i / 2), "n": str(i)}
            (home / f"{i}.csv").write_text(heads[i % kinds] + "\n" + ",".join(row[c] for c in names) + "\n")
        return str(home)

    made = {}
    for count in (6, 90):
        path = deliver(count)
        out, made[count] = jobs(spark, f"read-{kinds}-{count}", lambda path=path: feeds.read_csv(spark, path, SCHEMA))
        assert {(r["Id"], r["x"], r["n"]) for r in out.collect()} == {(f"r{i}", i / 2, i) for i in range(count)}
    assert made[6] == made[90] > 0


def test_long_files_give_their_first_line_only(spark, tmp_path):
    path = folder(tmp_path, {"long.csv": "Id,x,n\n" + "".join(f"r{i},{i}.5,{i}\n" for i in range(200_000))})
    found = feeds.headers(spark, path).collect()
    assert [(r["header"], len(r["files"])) for r in found] == [("Id,x,n", 1)]
    assert feeds.read_csv(spark, path, SCHEMA).count() == 200_000
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") != str(feeds.WHOLE_FILE)
