"""Services that answer by request, behind a durable store of answers: each distinct request is asked once, ever.

The store is a folder that the driver and all executors reach by one URI (a mounted folder, HDFS or an object store).  An
answer is one small file named by the digest of its request, put there by the task that asked, at once and whole; what a
lost or repeated task had already asked is found there again.
"""

from __future__ import annotations

import json
import math
import re
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velograph.plans.materialize import materialize

#: Requests that a task hands to the service at once.
AT_ONCE = 16


class Folder:
    """Answers by key.  ``older`` is a folder of former answers, which are copied to this one when they are first used."""

    def __init__(self, uri: str, older: str | None = None):
        self.uri, self.older = uri, older

    @staticmethod
    def _at(uri: str, key: str) -> tuple[fs.FileSystem, str]:
        system, root = fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", uri))
        return system, f"{root}/{key[:2]}/{key}.json"

    def _read(self, uri: str, key: str) -> dict | None:
        system, path = self._at(uri, key)
        if system.get_file_info(path).type != fs.FileType.File:
            return None
        try:
            with system.open_input_stream(path) as file:
                found = json.loads(file.read())
        except ValueError:
            return None  # not an answer: it is asked for again and replaced
        return found if isinstance(found, dict) and isinstance(found.get("body"), str) else None

    def get(self, key: str) -> dict | None:
        """{body, token}: the answer, and the job that asked for it."""
        if (found := self._read(self.uri, key)) is None and self.older and (found := self._read(self.older, key)) is not None:
            self.put(key, found["body"], found.get("token"))
        return found

    def put(self, key: str, body: str, token: str | None) -> None:
        """The whole answer, or nothing: it is written beside its place and moved there."""
        system, path = self._at(self.uri, key)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        beside = f"{path}.{uuid.uuid4().hex}"
        with system.open_output_stream(beside) as file:
            file.write(json.dumps({"body": body, "token": token}).encode())
        system.move(beside, path)


def answered(requests: DataFrame, service: Callable[[pd.DataFrame], list[str]], store: Folder, parts: int | None = None) -> DataFrame:
    """(key, body, asked): one row for each distinct key of ``requests`` (key, allow_cache and what the service reads).

    What the store holds is taken from there unless a request of the key has ``allow_cache`` false; the rest is asked for, by
    calls of ``service`` with up to ``AT_ONCE`` rows, which gives a text for each.  ``asked`` says whether this job did.  A
    task that is run again asks for nothing that its former attempt had an answer to, forced requests included.  The
    result is written, so that reading it twice does not ask twice.  Null keys have no answer and no row; an error of
    the service, or another number of answers than requests, fails the task.  ``parts`` bounds the calls at one time.
    """
    rest = [c for c in requests.columns if c not in ("key", "allow_cache")]
    allowed = F.coalesce(F.col("allow_cache"), F.lit(True)) if "allow_cache" in requests.columns else F.lit(True)
    first = F.min_by(F.struct(*rest), F.xxhash64(*rest)).alias("r") if rest else F.lit(None).alias("r")
    own = requests.where(F.col("key").isNotNull()).groupBy("key").agg(first, F.bool_and(allowed).alias("allow_cache"))
    own = own.select("key", "allow_cache", *[F.col(f"r.{c}").alias(c) for c in rest])
    own = own.repartition(parts, "key") if parts else own
    token = uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), AT_ONCE):
                rows = batch.iloc[at : at + AT_ONCE]
                held = [store.get(k) for k in rows["key"]]
                have = [h is not None and (allow or h.get("token") == token) for h, allow in zip(held, rows["allow_cache"], strict=True)]
                missing = rows[[not h for h in have]]
                if len(missing):
                    made = service(missing)
                    if len(made) != len(missing):
                        raise ValueError(f"{len(missing)} requests have {len(made)} answers")
                    for key, body in zip(missing["key"], made, strict=True):
                        store.put(key, body, token)
                    fresh = dict(zip(missing["key"], made, strict=True))
                    held = [{"body": fresh[k], "token": token} if k in fresh else h for k, h in zip(rows["key"], held, strict=True)]
                yield pd.DataFrame({"key": rows["key"].to_numpy(), "body": [h["body"] for h in held], "asked": [h.get("token") == token for h in held]})

    return materialize(own.mapInPandas(run, "key string, body string, asked boolean"), "answers")


def vector_of(body: str | None, dimensions: int) -> list[float] | None:
    """The first embedding of an answer; None unless it has so many numbers, all finite."""
    try:
        found = json.loads(body or "")["data"][0]["embedding"]
    except (ValueError, KeyError, IndexError, TypeError):
        return None
    good = isinstance(found, list) and len(found) == dimensions and all(type(x) in (int, float) and math.isfinite(x) for x in found)
    return [float(x) for x in found] if good else None


def embedded(images: DataFrame, service: Callable[[pd.DataFrame], list[str]], store: Folder, model: str, dimensions: int, parts: int | None = None) -> DataFrame:
    """(image_sha256, embedding) of each distinct image of ``images`` (image_sha256 and what the service reads).

    The key holds the image, the model and the number of dimensions.  An answer without a fit vector gives null, and is
    asked for again by the next job, as are held ones that are unfit.
    """

    @F.udf("array<double>")
    def vector(body: str | None) -> list[float] | None:
        return vector_of(body, dimensions)

    key = F.concat_ws("-", "image_sha256", F.substring(F.sha2(F.lit(model).cast("binary"), 256), 1, 16), F.lit(str(dimensions)))
    own = images.where(F.col("image_sha256").isNotNull()).withColumn("key", key)

    fit = _Fit(store.uri, store.older, dimensions)
    found = answered(own.withColumn("allow_cache", F.lit(True)), service, fit, parts)
    return own.select("key", "image_sha256").distinct().join(found, "key").select("image_sha256", vector("body").alias("embedding"))


class _Fit(Folder):
    """Answers that hold a fit vector; others count as none."""

    def __init__(self, uri: str, older: str | None, dimensions: int):
        super().__init__(uri, older)
        self.dimensions = dimensions

    def _read(self, uri: str, key: str) -> dict | None:
        found = super()._read(uri, key)
        return found if found and vector_of(found["body"], self.dimensions) is not None else None
