"""Writes that break or meet: what is sealed is whole."""

import hashlib
import json
from datetime import date

import pytest

from evenkeel.sources import files, sealed, store
from evenkeel.streaming import ingest

SHAPE = "k string, d date, v int"


def rows(*parts):
    return [(k, date(2024, 1, n), i) for k, n, m in parts for i in range(m)]


def counted(index):
    return sorted((str(r.k), r.d.day, r.n_rows) for r in index.collect())


def test_partition_of_a_broken_run_is_not_sealed_by_others(spark, tmp_path):
    path = str(tmp_path / "set")
    a = spark.createDataFrame(rows(("A", 1, 10)), SHAPE)
    b = spark.createDataFrame(rows(("B", 1, 1)), SHAPE)
    a.where("v < 3").write.partitionBy("k", "d").parquet(path)  # a broken run of another writer
    assert counted(files.write_missing(b, path, ["k", "d"])) == [("B", 1, 1)]
    assert counted(files.write_missing(a.unionByName(b), path, ["k", "d"])) == [("A", 1, 10), ("B", 1, 1)]
    assert spark.read.parquet(path).count() == 11


def test_two_writers_at_once(spark, tmp_path):
    path, keys = str(tmp_path / "set"), ["k", "d"]
    one = spark.createDataFrame(rows(("A", 1, 5), ("B", 1, 2)), SHAPE)
    two = spark.createDataFrame(rows(("B", 1, 3), ("C", 1, 4)), SHAPE)
    x, y = sealed.prepare(one, path, keys), sealed.prepare(two, path, keys)
    sealed.publish(spark, path, y, two.schema, keys)
    sealed.publish(spark, path, x, one.schema, keys)
    sealed.publish(spark, path, x, one.schema, keys)  # finished twice
    assert counted(sealed.sealed_index(spark, path, keys)) == [("A", 1, 5), ("B", 1, 3), ("C", 1, 4)]
    assert spark.read.parquet(path).count() == 12
    for part in sealed.manifest(spark, path, y):
        size = store.sizes(spark, f"{path}/{part['folder']}")
        assert size == part["files"] and hashlib.sha256("\n".join(f"{n} {b}" for n, b in sorted(size.items())).encode()).hexdigest() == part["digest"]


@pytest.mark.parametrize("stop", ["manifest", "claim", "move", "index"])
def test_every_break_is_mended(spark, tmp_path, monkeypatch, stop):
    path, keys = str(tmp_path / "set"), ["k", "d"]
    df = spark.createDataFrame(rows(("A", 1, 5), ("B", 2, 2)), SHAPE)

    class Broken(RuntimeError):
        pass

    def breaks(*_, **__):
        raise Broken

    with monkeypatch.context() as m:
        if stop == "manifest":
            m.setattr(store, "write_whole", breaks)
        elif stop == "claim":
            m.setattr(store, "move", lambda s, a, b, move=store.move: move(s, a, b) if a.endswith(".part") else breaks())
        elif stop == "move":
            m.setattr(store, "sizes", lambda s, p, sizes=store.sizes: sizes(s, p) if ".attempts/" in p else breaks())
        else:
            m.setattr(store, "remove", breaks)
        with pytest.raises(Broken):
            files.write_missing(df, path, keys)
    assert counted(files.write_missing(df.where("k = 'B'"), path, keys)) in ([("B", 2, 2)], [("A", 1, 5), ("B", 2, 2)])
    assert counted(files.write_missing(df, path, keys)) == [("A", 1, 5), ("B", 2, 2)]
    assert spark.read.parquet(path).count() == 7


def test_odd_keys_keep_their_values(spark, tmp_path):
    path = str(tmp_path / "set")
    odd = ["01", "1e0", "a/b:c=d%20 +", "é", None, ""]
    df = spark.createDataFrame([(k, i) for i, k in enumerate(odd) for _ in range(i + 1)], "k string, v int")
    for _ in range(2):
        got = {r.k: r.n_rows for r in files.write_missing(df, path, ["k"]).collect()}
        assert got == {"01": 1, "1e0": 2, "a/b:c=d%20 +": 3, "é": 4, None: 11}  # the empty text is written as null
    assert spark.read.parquet(path).count() == 21
    assert json.loads(store.read_text(spark, f"{path}.meta"))["configuration_sha256"]
    assert files.write_missing(df.limit(0), str(tmp_path / "none"), ["k"]).count() == 0


def test_batches_are_replaced_or_skipped(spark, tmp_path):
    src, dst, cp = (str(tmp_path / n) for n in ("src", "dst", "cp"))
    df = spark.createDataFrame([(i, str(i % 7)) for i in range(40)] + [(None, "n"), (None, "m"), (3, "again")], "id int, v string")
    df.write.parquet(src)
    assert ingest.append_new(spark, src, df.schema, dst, ["id"], cp) == 41
    (mark,) = store.names(spark, f"{dst}.batches")
    store.remove(spark, f"{dst}.batches/{mark}")  # as if the batch had broken behind its moves, and came again
    import shutil
    shutil.rmtree(tmp_path / "cp" / "commits")
    assert ingest.append_new(spark, src, df.schema, dst, ["id"], cp) == 41
    shutil.rmtree(tmp_path / "cp" / "commits")  # the same batch once more, now with its mark
    assert ingest.append_new(spark, src, df.schema, dst, ["id"], cp) == 41
    spark.createDataFrame([(3, "x"), (99, "y")], df.schema).write.mode("append").parquet(src)
    assert ingest.append_new(spark, src, df.schema, dst, ["id"], str(tmp_path / "cp2")) == 42
    assert ingest.append_new(spark, src, df.schema, dst, ["id"], cp) == 42
    got = [r.id for r in spark.read.parquet(dst).collect()]
    assert len(got) == len(set(got)) == 42
