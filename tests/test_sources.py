import hashlib
import zipfile

from perkolat.sources import tables
from perkolat.streaming.tasks import run_tasks


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿city,pc,n\nX,0.5,3\nY,NaN,-\nZ,inf,x\n".encode())
    got = tables.read_csv(spark, str(tmp_path / "a.csv"), {"city": "string", "pc": "double", "n": "int"}).collect()
    assert [tuple(r) for r in got] == [("X", 0.5, 3), ("Y", None, None), ("Z", None, None)]


def test_json_zip_and_manifest(spark, tmp_path):
    df = spark.createDataFrame([('[{"k": "a", "v": 1.5}, {"k": "b"}]',)], "j string")
    assert [tuple(r) for r in tables.json_items(df, "j", "k string, v double", ["v"]).collect()] == [("a", 1.5)]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("x{th}.csv", "no")
        z.writestr("y.csv", "a,b\n1,2\n")
    assert [r["line"] for r in tables.zipped_csv(spark, str(tmp_path / "z.zip")).orderBy("line_no").collect()] == ["a,b", "1,2"]
    m = tables.file_manifest(spark, str(tmp_path / "z.zip")).first()
    assert (m["file"], m["sha256"]) == ("z.zip", hashlib.sha256((tmp_path / "z.zip").read_bytes()).hexdigest())


def test_task_stream_resumes(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k, rows in enumerate(([(1, "a"), (2, "b")], [(2, "again"), (3, "c")])):
        spark.createDataFrame(rows, "id int, v string").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("id int, v string").parquet(src)
        run_tasks(stream, lambda df: df, out, ["id"], str(tmp_path / "check")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == [(1, "a"), (2, "b"), (3, "c")]
