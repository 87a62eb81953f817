"""Recognition of many crops by few requests: what earlier records do not decide is put into composites and asked for."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from velograph.functions import boxes
from velograph.operators.aggregates import chunks
from velograph.operators.tracker import match_cells
from velograph.plans.materialize import materialize
from velograph.sources.answers import Folder, answered

#: Reasons of a lookup for which held answers are not good enough, so that the service is asked again.
FORCED = ("exact_conflict", "exact_ineligible", "embedding_conflict", "embedding_ineligible")
USER = "x1 double, y1 double, x2 double, y2 double, confidence double, make string, make_confidence double, model string, model_confidence double"


def composites(crops: DataFrame, size: int, columns: int, cell_size: float) -> DataFrame:
    """(run_id, crop_id, image_sha256, width, height, batch_id, cell, box, placed): crops of a run in order, ``size`` to a composite.

    ``box`` is the cell and ``placed`` where the crop lies in it.
    """
    dealt = chunks(crops, size, "crop_id").withColumn("batch_id", F.concat_ws("/", "run_id", "chunk"))
    cell = F.row_number().over(Window.partitionBy("batch_id").orderBy("crop_id")).cast("long") - 1
    dealt = dealt.withColumn("cell", cell)
    x, y = (F.col("cell") % columns) * cell_size, F.floor(F.col("cell") / columns) * cell_size
    dealt = dealt.withColumn("box", boxes.box(x, y, x + cell_size, y + cell_size))
    return dealt.select("run_id", "crop_id", "image_sha256", "width", "height", "batch_id", "cell", "box", boxes.fitted_into(F.col("width"), F.col("height"), F.col("box")).alias("placed"))


def recognized(
    crops: DataFrame, lookups: DataFrame, service: Callable[[pd.DataFrame], list[str]], store: Folder, *,
    size: int = 16, columns: int = 4, cell_size: float = 320.0, least: float = 0.5, single: bool = True, parts: int | None = None,
) -> DataFrame:
    """(run_id, crop_id, result, via, asked, accepted) for every row of ``crops`` (run_id, crop_id, image_sha256, width, height).

    1. ``lookups`` (run_id, crop_id, result, reason) says what earlier records decide; a ``result`` that is not null is
       taken (via ``record``).
    2. The others go into composites, one request each.  The request is known by the crops' digests and places, so the
       same composite is asked for once; it is asked for again if a crop of it has one of the reasons in ``FORCED``.
    3. The answer's road users are matched to cells (``match_cells``); their boxes are given in pixels of the crop
       (via ``batch``).
    4. Crops whose cell has no user are asked for by themselves, if ``single``, and take the largest user (via ``single``);
       what is still without one has a null result (via ``none``).

    An answer is a JSON list of users.  ``service`` reads key and ``cells``: an array of (crop_id, image_sha256, cell, placed).
    Answers of each round are in the store before the next begins, so a run that fails goes on where it was.  An answer
    that is not a list fails the run.  Crops with equal ids in a run are an error.
    """
    held = lookups.select("run_id", "crop_id", F.col("result").alias("_held"), F.coalesce(F.col("reason").isin(*FORCED), F.lit(False)).alias("_forced"))
    every = crops.select("run_id", "crop_id", "image_sha256", F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height"))
    every = every.join(held, ["run_id", "crop_id"], "left").withColumn("_forced", F.coalesce("_forced", F.lit(False)))
    every = materialize(every, "crops")
    if every.groupBy("run_id", "crop_id").count().where("count > 1").limit(1).count():
        raise ValueError("a crop is there twice")
    open_ = every.where("_held is null")
    placed = materialize(composites(open_, size, columns, cell_size), "composites")
    forced = open_.where("_forced").select("run_id", "crop_id", F.lit(True).alias("_f"))
    done = _asked(placed, forced, service, store, parts)
    user = F.struct(*[F.col(f"user.{c.split()[0]}") for c in USER.split(", ")])
    crop_box = boxes.out_of_cell(boxes.box(*[F.col(f"user.{c}") for c in ("x1", "y1", "x2", "y2")]), F.col("placed"), F.col("width"), F.col("height"))
    batch = materialize(done.select("run_id", "crop_id", user.alias("user"), crop_box.alias("found"), "asked", F.lit("batch").alias("via")), "batch-answers")
    rounds = batch.where("user.make is not null or user.model is not null")
    left = every.where("_held is null").join(rounds.select("run_id", "crop_id"), ["run_id", "crop_id"], "left_anti")
    if single:
        alone = left.select("run_id", "crop_id", "image_sha256", "width", "height", F.concat_ws("/", "run_id", "crop_id").alias("batch_id"), F.lit(0).cast("long").alias("cell"))
        whole = boxes.box(F.lit(0.0), F.lit(0.0), F.col("width"), F.col("height"))
        again = _asked(alone.withColumns({"box": whole, "placed": whole}), forced, service, store, parts)
        rounds = rounds.union(again.where("user is not null").select("run_id", "crop_id", user.alias("user"), boxes.box(*[F.col(f"user.{c}") for c in ("x1", "y1", "x2", "y2")]).alias("found"), "asked", F.lit("single").alias("via")))
    result = F.struct("user.make", "user.make_confidence", "user.model", "user.model_confidence", F.col("found").alias("detection_box"), F.col("user.confidence").alias("detection_confidence"), F.lit("api_confirmed").alias("evidence_source"), F.lit("external_api").alias("resolution_method"))
    new = rounds.select("run_id", "crop_id", result.alias("_new"), "via", "asked")
    out = every.join(new, ["run_id", "crop_id"], "left")
    filled = lambda c: F.coalesce(F.col(f"result.{c}"), F.lit("")) != ""
    out = out.select("run_id", "crop_id", F.coalesce("_held", "_new").alias("result"), F.when(F.col("_held").isNotNull(), "record").otherwise(F.coalesce("via", F.lit("none"))).alias("via"), F.coalesce("asked", F.lit(False)).alias("asked"))
    return out.withColumn("accepted", F.coalesce((F.col("result.make_confidence") >= least) & filled("make") & filled("model"), F.lit(False)))


def _asked(placed: DataFrame, forced: DataFrame, service: Callable[[pd.DataFrame], list[str]], store: Folder, parts: int | None) -> DataFrame:
    """``placed`` with ``user`` (null: none) and ``asked``: one request a batch, its users matched to its cells."""
    marked = placed.join(forced, ["run_id", "crop_id"], "left")
    cells = F.array_sort(F.collect_list(F.struct("cell", "crop_id", "image_sha256", "placed")))
    requests = marked.groupBy("batch_id").agg(cells.alias("cells"), F.bool_and(F.col("_f").isNull()).alias("allow_cache"))
    seen = F.transform("cells", lambda c: F.struct(c["cell"], c["image_sha256"], c["placed"]))
    requests = materialize(requests.withColumn("key", F.sha2(F.to_json(seen), 256)), "requests")
    answers = answered(requests.select("key", "cells", "allow_cache"), service, store, parts)
    users = F.from_json("body", f"array<struct<{USER.replace(' double', ':double').replace(' string', ':string')}>>")
    whole = F.when(users.isNull(), F.raise_error(F.concat(F.lit("not a list of users: "), F.substring("body", 1, 80)))).otherwise(users)
    found = requests.select("batch_id", "key").join(answers, "key").select("batch_id", "asked", F.posexplode_outer(whole).alias("user", "u"))
    found = materialize(found, "users")
    boxes_ = placed.select("batch_id", "cell", "box.x1", "box.y1", "box.x2", "box.y2")
    some = found.where("u is not null").select("batch_id", F.col("user").cast("long").alias("user"), *[f"u.{c}" for c in ("x1", "y1", "x2", "y2", "confidence", "model_confidence", "make_confidence")])
    matched = match_cells(boxes_, some).join(found.select("batch_id", F.col("user").cast("long").alias("user"), "u"), ["batch_id", "user"]).select("batch_id", "cell", F.col("u").alias("user"))
    who = found.select("batch_id", "asked").distinct()
    return placed.join(who, "batch_id").join(matched, ["batch_id", "cell"], "left")
