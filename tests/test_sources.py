import pyarrow as pa
import pytest
from pyarrow import feather
from pyspark.sql import functions as F

from tabwright.functions import urls
from tabwright.sources import readers, runs, writers
from tabwright.sources.scan_files import scan_files


def write(path, data):
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


def test_csv_encodings(spark, tmp_path):
    utf8 = write(tmp_path / "a.csv", "id,name\n1,Zoë\n2,\n")
    latin = write(tmp_path / "b.csv", "id,name\n1,Zoë\n".encode("latin-1"))
    assert [tuple(r) for r in readers.read_any(spark, utf8).collect()] == [(1, "Zoë"), (2, None)]
    assert readers.read_any(spark, latin).first()["name"] == "Zoë"


def test_json_list_object_and_lines(spark, tmp_path):
    listed = write(tmp_path / "a.json", '[{"a": 1, "b": {"c": "x"}},\n {"a": 2}]')
    single = write(tmp_path / "b.json", '{"a": 7,\n "b": null}')
    lines = write(tmp_path / "c.json", '{"a": 1}\n{"a": 2}\n')
    assert readers.read_any(spark, listed).count() == 2
    assert readers.read_any(spark, single).first()["a"] == 7
    assert readers.read_json(spark, lines, lines=True).count() == 2


def test_feather_with_several_batches(spark, tmp_path):
    table = pa.table({"i": list(range(50)), "s": [f"v{i}" for i in range(50)], "f": [i / 2 for i in range(50)]})
    for name in ("a", "b"):
        feather.write_feather(table, str(tmp_path / f"{name}.feather"), chunksize=7)
    df = readers.read_feather(spark, str(tmp_path))
    assert df.count() == 100
    assert df.select("s").distinct().count() == 50
    assert df.columns == ["i", "s", "f"]


def test_texts_and_inventory(spark, tmp_path):
    write(tmp_path / "a.txt", "line one\nline two")
    write(tmp_path / "b.md", "é".encode("latin-1"))
    write(tmp_path / "c.bin", b"\x00")
    texts = {r["path"][-5:]: r["text"] for r in readers.read_text_whole(spark, str(tmp_path)).collect()}
    assert texts["a.txt"] == "line one\nline two" and texts["/b.md"] == "é"
    kinds = {r["file_name"]: r["file_class"] for r in readers.file_inventory(spark, str(tmp_path)).collect()}
    assert kinds == {"a.txt": "text", "b.md": "text", "c.bin": "unknown"}
    assert readers.file_inventory(spark, str(tmp_path), "*.txt").count() == 1


def test_a_table_of_many_files_is_one_entry(spark, tmp_path):
    root = tmp_path / "in.parquet" / "files"  # the name above the root does not count
    spark.range(100).repartition(3).write.parquet(str(root / "many.parquet"))
    spark.range(9).selectExpr("id", "1 as day").write.partitionBy("day").parquet(str(root / "deep" / "days.parquet"))
    spark.range(4).coalesce(1).write.csv(str(root / "plain"))
    (root / "notes.parquet").write_bytes(b"PAR1")
    (root / "many.parquet" / "readme.md").write_text("x")
    found = {r["file_name"]: r for r in readers.file_inventory(spark, str(root)).collect()}
    plain = [n for n in found if n.startswith("part-")]
    assert set(found) - set(plain) == {"many.parquet", "days.parquet", "notes.parquet", "readme.md"} and len(plain) == 1
    sizes = sum(p.stat().st_size for p in (root / "many.parquet").glob("*.parquet"))
    assert found["many.parquet"]["file_size"] == sizes and found["many.parquet"]["file_class"] == "tabular"
    assert found["many.parquet"]["path"].endswith("in.parquet/files/many.parquet")


def test_directory_skips_corrupt_files(spark, tmp_path):
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "in" / "x"))
    write(tmp_path / "in" / "bad.parquet", b"PAR1 not really")
    files = readers.read_directory(spark, str(tmp_path / "in" / "x"), ".parquet")
    assert files.count() == 5 and "source_file" in files.columns


def test_unknown_extension(spark):
    with pytest.raises(ValueError):
        readers.read_any(spark, "/nowhere/a.xyz")


def test_spread_leaves_wide_scans_alone(spark):
    assert readers.spread(spark.range(0, 100, 1, 1)).rdd.getNumPartitions() == 4
    assert readers.spread(spark.range(0, 100, 1, 9)).rdd.getNumPartitions() == 9


def test_union_of_unequal_chunks(spark):
    df = readers.union_chunks(spark.range(2), spark.range(1).withColumn("x", F.lit("a")))
    assert sorted((r["id"], r["x"] or "") for r in df.collect()) == [(0, ""), (0, "a"), (1, "")]


def test_file_scan(spark, tmp_path):
    cases = {
        "ok.csv": b"a,b\n1,2\n",
        "prog.csv": b"MZ\x90\x00",
        "script.txt": b"#!/bin/sh\n",
        "page.csv": b"<?php echo 1;",
        "pack.zip": b"PK\x03\x04rest",
        "rar.rar": b"Rar!\x1a",
        "bin.exe": b"\x00",
        "notes.txt": b"please call os.system here",
        "big.txt": b"x" * 2_000_000 + b" OS.system",
        "long.txt": b"plain " * 5000,
    }
    for name, data in cases.items():
        write(tmp_path / name, data)
    found = {r["path"].rsplit("/", 1)[1]: r for r in scan_files(spark, str(tmp_path)).collect()}
    problems = {k: r["problem"] for k, r in found.items() if r["problem"]}
    assert problems == {
        "prog.csv": "windows_executable", "script.txt": "shebang_script", "page.csv": "php_script", "rar.rar": "rar_archive",
        "bin.exe": "extension",
    }
    assert found["pack.zip"]["is_zip"]
    assert sorted(k for k, r in found.items() if r["suspicious"]) == ["big.txt", "notes.txt"]


@pytest.mark.parametrize(
    "url, problem",
    [
        ("https://example.org/a.csv", None),
        ("https://example.org/path/", None),
        ("https://example.org/v1.2/data", "extension"),
        ("https://example.org/a.csv?x=b.exe", None),
        ("HTTP://EXAMPLE.org/a.CSV", None),
        ("ftp://example.org/a.csv", "scheme"),
        ("http://localhost/a.csv", "blocked_host"),
        ("http://172.16.4.4/a.csv", "blocked_host"),
        ("http://172.32.4.4/", None),
        ("http://10.1.2.3:8080/a.csv", "blocked_host"),
        ("http://user:pw@127.0.0.1/a.csv", "blocked_host"),
        ("https://example.org/a.exe", "extension"),
        ("https://example.org/%2E%2E%2Fetc.csv", None),
        ("https://example.org/a%3C.csv", "dangerous_pattern"),
        ("https://example.org/.hidden.csv", "dangerous_pattern"),
        ("not a url", "invalid_format"),
        ("", "invalid_format"),
    ],
)
def test_url_rules(spark, url, problem):
    df = spark.createDataFrame([(url,)], "url string")
    assert df.select(urls.url_problem(F.col("url"))).first()[0] == problem


@pytest.mark.parametrize(
    "name, problem",
    [("a.csv", None), ("a b+c.csv", None), ("x" * 256, "too_long"), ("a..b", "dangerous_pattern"), ("A.BAT", "dangerous_pattern"),
     ("m.pyc", "dangerous_pattern"), ("m.pyx", None), ("lib.dylib", "dangerous_pattern"), ("100%.csv", None)],
)
def test_file_name_rules(spark, name, problem):
    df = spark.createDataFrame([(name,)], "n string")
    assert df.select(urls.file_name_problem(F.col("n"))).first()[0] == problem


def test_url_classes_and_parts(spark):
    rows = [
        ("https://github.com/o/r/blob/main/d.csv", "github", "https://github.com/o/r/raw/main/d.csv", None, None),
        ("https://drive.google.com/uc?id=A_b-1", "google_drive", "https://drive.google.com/uc?id=A_b-1", "A_b-1", None),
        ("https://www.kaggle.com/datasets/o/set?x=1", "kaggle", "https://www.kaggle.com/datasets/o/set?x=1", None, "o/set"),
    ]
    df = spark.createDataFrame([(r[0],) for r in rows], "url string")
    parts = urls.url_parts(F.col("url"))
    found = df.select("url", urls.url_class(F.col("url")), parts["download_url"], parts["drive_file_id"], parts["kaggle_dataset"])
    assert sorted(tuple(r) for r in found.collect()) == sorted(rows)


def test_run_store(spark, tmp_path):
    store = runs.RunStore(spark, str(tmp_path / "runs"))
    df = spark.range(10).selectExpr("id", "id * 2 as v")
    first = store.save_run(df, "first", processed=df.limit(3), tables={"facts": df.limit(2)}, target="v", tags=["a"])
    second = store.save_run(df.where("id > 4"))
    assert store.update_run(first, name="renamed", tags=["b", "c"])
    assert not store.update_run("missing", name="x")
    with pytest.raises(ValueError):
        store.update_run(first, n_rows=1)
    listed = store.list_runs().collect()
    assert [r["run_id"] for r in listed] == [first, second]
    assert (listed[0]["name"], listed[0]["tags"], listed[0]["n_rows"]) == ("renamed", ["b", "c"], 10)
    loaded = store.load_run(first, ("facts",))
    assert (loaded["data"].count(), loaded["processed"].count(), loaded["facts"].count()) == (10, 3, 2)
    with pytest.raises(FileNotFoundError):
        store.load_run("missing")


def test_fingerprint_ignores_order_but_not_content(spark, skewed):
    a = runs.fingerprint(skewed).first()
    assert a == runs.fingerprint(skewed.orderBy(F.desc("value")).repartition(7)).first()
    assert a != runs.fingerprint(skewed.withColumn("value", F.col("value") + 1)).first()
    assert a != runs.fingerprint(skewed.unionByName(skewed.limit(1))).first()


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", ok'), (2, None)], "i int, s string")
    writers.write_csv(df, str(tmp_path / "out"))
    back = readers.read_csv(spark, str(tmp_path / "out"), escape='"')
    assert back.count() == 2
