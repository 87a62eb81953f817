"""Recognition answers to labels, and labels to the report of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velograph.functions import boxes
from velograph.functions.text import coerced_confidence, coerced_label, is_affirmative, tag_column

PARTS = ("make", "model", "category", "generation", "variation", "color", "view", "view8")
PROVENANCE = ("evidence_source", "resolution_method", "retrieval_record_id", "retrieval_distance", "retrieval_neighbor_count")
BASE = ("track_id", "vehicle_index", *[x for p in PARTS[:7] for x in (p, f"{p}_confidence")])


def road_users(answers: DataFrame, json: str = "answer") -> DataFrame:
    """A row for each road user of recognition answers (JSON text), with its place: combination and user.

    ``combinations`` may stand inside ``data``; entries that are no objects are skipped but keep their places.
    """
    v = F.try_parse_json(F.col(json))
    root = F.coalesce(F.try_variant_get(v, "$.data.combinations", "array<variant>"), F.try_variant_get(v, "$.combinations", "array<variant>"))
    combos = answers.select("*", F.posexplode(root).alias("combination", "_c"))
    users = combos.select("*", F.posexplode(F.try_variant_get("_c", "$.roadUsers", "array<variant>")).alias("user", "_u"))
    return users.where(F.schema_of_variant("_u").startswith("OBJECT")).drop("_c")


def _number(path: str) -> Column:
    return F.try_variant_get("_u", path, "double")


def user_box() -> Column:
    at = "$.box.position."
    b = boxes.box(_number(at + "topLeftCol"), _number(at + "topLeftRow"), _number(at + "bottomRightCol"), _number(at + "bottomRightRow"))
    return F.when((b["x2"] > b["x1"]) & (b["y2"] > b["y1"]), b)


def parsed_users(users: DataFrame) -> DataFrame:
    """``road_users`` with eight labels and confidences, tags, box and detection confidence."""
    columns: dict[str, Column] = {}
    for p in PARTS:
        text = F.when(F.schema_of_variant(F.try_variant_get("_u", f"$.mmr.{p}", "variant")) == "STRING", F.try_variant_get("_u", f"$.mmr.{p}", "string"))
        field = lambda f, p=p: F.try_variant_get("_u", f"$.mmr.{p}.{f}", "string")
        columns[p] = coerced_label(text, field("value"), field("name"), field("label"))
        columns[f"{p}_confidence"] = coerced_confidence(F.lit(None).cast("string"), field("score"), field("confidence"))
    columns["tags"] = F.try_variant_get("_u", "$.mmr.tags", "array<struct<name string, value variant, score double, confidence double>>")
    columns["detection_box"] = user_box()
    columns["detection_confidence"] = F.coalesce(_number("$.box.position.score"), _number("$.box.score"))
    return users.withColumns(columns)


def best_user(users: DataFrame, *keys: str) -> DataFrame:
    """The road user of each key with the largest box, then the surest detection, model and make; the first wins ties."""
    rank = F.struct(
        F.coalesce(boxes.area(F.col("detection_box")), F.lit(-1.0)).alias("a"), F.coalesce("detection_confidence", F.lit(-1.0)).alias("d"), F.coalesce("model_confidence", F.lit(-1.0)).alias("m"), F.coalesce("make_confidence", F.lit(-1.0)).alias("k"),
        (-F.col("combination")).alias("c"), (-F.col("user")).alias("u"),
    )
    plain = [c for c in users.columns if c != "_u"]
    return users.groupBy(*keys).agg(F.max_by(F.struct(*plain), rank).alias("best")).select("best.*")


def report_rows(labels: DataFrame) -> DataFrame:
    """One label a vehicle: the first by (no vehicle last, vehicle, place in the answer, track), with its place."""
    order = [F.col("vehicle_index").isNull(), "vehicle_index", F.coalesce("api_classification_index", F.lit(0)), "track_id"]
    key = F.coalesce(F.concat(F.lit("v"), F.col("vehicle_index").cast("string")), F.concat(F.lit("t"), F.col("track_id").cast("string")))
    firsts = labels.withColumn("_n", F.row_number().over(Window.partitionBy("run_id", key).orderBy(*order))).where("_n = 1").drop("_n")
    return firsts.withColumn("place", F.row_number().over(Window.partitionBy("run_id").orderBy(*order)))


def tag_values(rows: DataFrame) -> DataFrame:
    """(run_id, track_id, column, confidence) of affirmative tags; of repeated ones the last stays."""
    tags = rows.select("run_id", "track_id", F.posexplode("tags").alias("_i", "tag"))
    named = tags.withColumn("column", tag_column(F.col("tag.name"))).where((F.col("column") != "") & is_affirmative(F.col("tag.value").cast("string")))
    last = F.struct(F.coalesce("tag.score", "tag.confidence").alias("c"))
    return named.groupBy("run_id", "track_id", "column").agg(F.max_by(last, "_i").alias("l")).select("run_id", "track_id", "column", F.col("l.c").alias("confidence"))


def report(labels: DataFrame) -> DataFrame:
    """The report of vehicles: base columns, a pair of columns for each tag found, and provenance; blanks for nulls.

    The names of the tags are the only thing that comes to the driver.
    """
    rows = report_rows(labels)
    tags = tag_values(rows)
    names = sorted(r["column"] for r in tags.select("column").distinct().collect())
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    base = [text(c).alias(c) for c in BASE if c in labels.columns]
    origin = [text(c).alias(c) for c in PROVENANCE if c in labels.columns]
    if not names:
        return rows.orderBy("run_id", "place").select("run_id", *base, *origin)
    wide = tags.groupBy("run_id", "track_id").pivot("column", names).agg(F.first(F.lit("yes")).alias("v"), F.first(F.coalesce(F.col("confidence").cast("string"), F.lit(""))).alias("confidence"))
    pairs = [F.coalesce(f"{n}_{k}", F.lit("")).alias(n if k == "v" else f"{n}_confidence") for n in names for k in ("v", "confidence")]
    return rows.join(wide, ["run_id", "track_id"], "left").orderBy("run_id", "place").select("run_id", *base, *pairs, *origin)


def with_dimensions(rows: DataFrame, countries: DataFrame, powertrains: DataFrame) -> DataFrame:
    """Flag by make, and powertrain by make, model, generation and variation ("" where unknown), null where one of the
    first three is.  How the dimensions are joined is left to their sizes."""
    keys = F.struct("make", "model", "generation", F.coalesce("variation", F.lit("")).alias("variation"))
    p = powertrains.select(F.struct("make", "model", "generation", F.coalesce("variation", F.lit("")).alias("variation")).alias("_key"), "powertrain")
    out = rows.join(countries.select("make", "flag"), "make", "left").withColumn("_key", keys)
    return out.join(p, "_key", "left").drop("_key")


def labelled(summaries: DataFrame, labels: DataFrame, inner: bool = False) -> DataFrame:
    """Track summaries with ``label`` and ``labelled``: that of the track itself, else the one of its vehicle's least track.

    ``labels`` (run_id, track_id, vehicle_index, label) has a row a track.  A summary without either has a null label, and
    no row if ``inner``.
    """
    own = labels.select("run_id", "track_id", F.col("label").alias("_own"), F.lit(True).alias("_has"))
    of_vehicle = labels.where("vehicle_index is not null").groupBy("run_id", "vehicle_index").agg(F.min_by("label", "track_id").alias("_vehicles"), F.lit(True).alias("_some"))
    out = summaries.join(own, ["run_id", "track_id"], "left").join(of_vehicle, ["run_id", "vehicle_index"], "left")
    by = F.when(F.col("_has"), "track").when(F.col("_some"), "vehicle")
    out = out.withColumns({"label": F.when(F.col("_has"), F.col("_own")).otherwise(F.col("_vehicles")), "labelled": by})
    out = out.where("labelled is not null") if inner else out
    return out.select(*summaries.columns, "label", "labelled")


def unclassified(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(run_id, vehicle_index) with rows but no label."""
    return rows.where("vehicle_index is not null").select("run_id", "vehicle_index").distinct().join(labels.select("run_id", "vehicle_index"), ["run_id", "vehicle_index"], "left_anti")


def request(settings: dict[str, str | int | float | bool], image: Column) -> Column:
    """The JSON text of a recognition request: settings in order of name, then the image's name."""
    fields = [F.lit(v).alias(k) for k, v in sorted(settings.items())]
    return F.to_json(F.struct(*fields, image.alias("image")))


def contract(settings: dict[str, str | int | float | bool], kept: tuple[str, ...]) -> Column:
    """A digest of the settings on which an answer depends."""
    return F.sha2(F.to_json(F.struct(*[F.lit(settings[k]).alias(k) for k in sorted(kept) if k in settings])), 256)
