"""Services behind a store: each request once, whatever fails, and crops recognized in rounds."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from velograph.operators.recognition import recognized
from velograph.plans.stream_queries import plates
from velograph.sources.answers import Folder, answered, embedded, vector_of


def counting(path, answer, fails=()):
    """A service that notes each request it gets; of the keys in ``fails`` the first request is noted and breaks."""

    def service(rows):
        out = []
        for key in rows["key"]:
            with open(f"{path}/{os.path.basename(key)}", "a") as file:
                file.write("x")
            if key in fails and os.path.getsize(f"{path}/{os.path.basename(key)}") == 1:
                raise OSError("no connection")
            out.append(answer(key))
        return out

    return service


def asked(path):
    return {name: os.path.getsize(f"{path}/{name}") for name in os.listdir(path)}


@pytest.fixture
def folders(tmp_path):
    for name in ("calls", "store", "older"):
        (tmp_path / name).mkdir()
    return tmp_path


def test_each_request_is_asked_once(spark, folders):
    service, store = counting(folders / "calls", str.upper), Folder(str(folders / "store"))
    rows = spark.createDataFrame([(k, True) for k in ("a", "b", "b", "c")] + [(None, True)], "key string, allow_cache boolean")
    first = answered(rows, service, store)
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, first.collect())) == [("a", "A", True), ("b", "B", True), ("c", "C", True)]
    assert asked(folders / "calls") == {"a": 1, "b": 1, "c": 1}
    again = answered(rows.union(spark.createDataFrame([("b", False), ("d", None)], rows.schema)), service, store)
    assert {r.key: r.asked for r in again.collect()} == {"a": False, "b": True, "c": False, "d": True}
    assert asked(folders / "calls") == {"a": 1, "b": 2, "c": 1, "d": 1}
    assert answered(rows.limit(0), service, store).collect() == []


def test_failed_tasks_ask_only_for_what_is_missing(spark, folders, monkeypatch):
    """A job that breaks keeps the answers it had; the next one, and a task run again in a job, asks for the rest."""
    from velograph.sources import answers

    monkeypatch.setattr(answers, "AT_ONCE", 1)
    store = Folder(str(folders / "store"))
    rows = spark.createDataFrame([(f"k{i}", False) for i in range(6)], "key string, allow_cache boolean").coalesce(1)
    with pytest.raises(Exception, match="no connection"):
        answered(rows, counting(folders / "calls", str.upper, fails=("k5",)), store, parts=1)
    before = asked(folders / "calls")
    assert answered(rows.withColumn("allow_cache", F.lit(True)), counting(folders / "calls", str.upper), store, parts=1).count() == 6
    after = asked(folders / "calls")
    assert len(after) == 6 and all(after[k] == before[k] for k in before if k != "k5") and after["k5"] == 2
    assert store.get("k0")["token"] and store.get("k0")["body"] == "K0"
    with pytest.raises(Exception, match="1 requests have 2 answers"):
        answered(rows.limit(1), lambda r: ["x", "y"], store)


def test_store_is_whole_and_copies_forward(folders):
    old, new = Folder(str(folders / "older")), Folder(f"file:{folders}/store", older=str(folders / "older"))
    old.put("aa1", "former", None)
    assert new.get("aa1")["body"] == "former" and Folder(str(folders / "store")).get("aa1")["body"] == "former"
    assert new.get("bb2") is None
    (folders / "store" / "cc").mkdir()
    (folders / "store" / "cc" / "cc3.json").write_text('{"bo')
    assert new.get("cc3") is None
    new.put("cc3", "whole", "t")
    assert new.get("cc3") == {"body": "whole", "token": "t"} and [f for f in os.listdir(folders / "store" / "cc")] == ["cc3.json"]


def test_vectors_are_checked(spark, folders):
    body = lambda v: json.dumps({"data": [{"embedding": v}]})
    good = {body([1, 2.5]): [1.0, 2.5], body([1]): None, body([1, True]): None, body([1, "2"]): None, body(None): None, "no": None, "[]": None, '{"data": []}': None, body([1, float("nan")]): None, body([1e999, 0]): None}
    assert all(vector_of(k, 2) == v for k, v in good.items()) and vector_of(None, 2) is None
    images = spark.createDataFrame([("i1",), ("i2",), ("i2",), (None,)], "image_sha256 string")
    bad = counting(folders / "calls", lambda key: body([1.0, 2.0]) if key.startswith("i1") else body([1.0]))
    store = Folder(str(folders / "store"))
    assert {r[0]: r[1] for r in embedded(images, bad, store, "m", 2).collect()} == {"i1": [1.0, 2.0], "i2": None}
    fine = counting(folders / "calls", lambda key: body([3.0, 4.0]))
    assert {r[0]: r[1] for r in embedded(images, fine, store, "m", 2).collect()} == {"i1": [1.0, 2.0], "i2": [3.0, 4.0]}
    assert sorted(asked(folders / "calls").values()) == [1, 2]
    assert {r[0]: r[1] for r in embedded(images, fine, store, "other", 2).collect()} == {"i1": [3.0, 4.0], "i2": [3.0, 4.0]}


LOOKUP = "run_id string, crop_id long, result struct<make:string,make_confidence:double,model:string,model_confidence:double,detection_box:struct<x1:double,y1:double,x2:double,y2:double>,detection_confidence:double,evidence_source:string,resolution_method:string>, reason string"


def crops(spark, n):
    return spark.range(n).select(F.lit("r").alias("run_id"), F.col("id").alias("crop_id"), F.sha2(F.col("id").cast("string"), 256).alias("image_sha256"), F.lit(80).alias("width"), F.lit(40).alias("height"))


def test_rounds_of_recognition(spark, folders):
    calls = []

    def service(rows):
        with open(folders / "calls" / "n", "a") as file:
            file.write("".join(f"{len(c)} " for c in rows["cells"]))
        return plates(rows)

    own, store = crops(spark, 21), Folder(str(folders / "store"))
    known = ("made", 0.9, "m", 0.9, None, None, "human", "retrieval")
    lookups = spark.createDataFrame([("r", 0, known, "exact_match"), ("r", 1, None, "no_match")], LOOKUP)
    got = {r.crop_id: r for r in recognized(own, lookups, service, store, size=8, columns=3).collect()}
    assert len(got) == 21 and got[0].via == "record" and got[0].result.evidence_source == "human"
    sha = {r.crop_id: int(r.image_sha256[:2], 16) for r in own.collect()}
    for k in range(1, 21):
        assert got[k].via == ("batch" if sha[k] % 5 else "single") and got[k].result.make == f"make {sha[k] % 16}" and got[k].asked
        assert got[k].result.detection_box.x2 == pytest.approx(40, abs=0.2) and got[k].accepted == (sha[k] / 256 >= 0.5)
    calls = sorted((folders / "calls" / "n").read_text().split())
    assert sorted(c for c in calls if c != "1") == ["4", "8", "8"] and calls.count("1") == sum(sha[k] % 5 == 0 for k in range(1, 21))
    # again: nobody is asked; with a crop in conflict its composite is asked for once more, and no other
    again = recognized(own, lookups, service, store, size=8, columns=3).collect()
    assert not any(r.asked for r in again) and len((folders / "calls" / "n").read_text().split()) == len(calls)
    conflict = spark.createDataFrame([("r", 0, known, "exact_match"), ("r", 9, None, "embedding_conflict")], LOOKUP)
    third = {r.crop_id for r in recognized(own, conflict, service, store, size=8, columns=3).collect() if r.asked}
    assert {k for k in third if sha[k] % 5} == {k for k in range(9, 17) if sha[k] % 5}
    none = recognized(own, lookups, lambda rows: ["[]" for _ in rows["cells"]], Folder(str(folders / "older")), size=8, single=False)
    assert {r.via for r in none.collect()} == {"record", "none"}


def test_answers_that_do_not_fit_are_errors(spark, folders):
    lookups = spark.createDataFrame([], LOOKUP)
    with pytest.raises(Exception, match="not a list of users"):
        recognized(crops(spark, 3), lookups, lambda rows: ["oh" for _ in rows["cells"]], Folder(str(folders / "store"))).collect()
    with pytest.raises(ValueError, match="there twice"):
        recognized(crops(spark, 3).union(crops(spark, 1)), lookups, plates, Folder(str(folders / "store")))
    assert recognized(crops(spark, 0), lookups, plates, Folder(str(folders / "store"))).collect() == []
