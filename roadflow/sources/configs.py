"""Per-device order configuration as a table and as documents, and nested reports.

A configuration has a row per device, (DeviceId, settings: name -> JSON text), and one without a device that holds
the defaults. Stored, it is a document ``{"default": {...}, "devices": {id: {...}}}``; a large one is a line for
each device, and every line is a document of that form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import order_text_to_struct
from ..models import store
from ..operators.joins import checked_unique

CONFIG = "DeviceId string, settings map<string,string>"
DOCUMENT = "default map<string,string>, devices map<string,map<string,string>>"


def merge_config(devices: DataFrame, config: DataFrame, default: dict) -> DataFrame:
    """Device settings over the defaults, field by field."""
    return devices.join(config, "DeviceId", "left").withColumns(
        {k: F.coalesce(F.col(k), F.lit(v)) for k, v in default.items()}
    )


def upsert_config(config: DataFrame, changes: DataFrame, keys: list[str] = ("DeviceId",)) -> DataFrame:
    """Changed keys replace their rows, other rows stay."""
    keys = list(keys)
    return config.join(changes, keys, "left_anti").unionByName(changes)


def coefficient_report(coefs: DataFrame) -> DataFrame:
    """Long coefficients nested per device: target -> name -> {coef, pvalue}."""
    by_target = coefs.groupBy("DeviceId", "TargetCol").agg(
        F.map_from_entries(
            F.sort_array(F.collect_list(F.struct("name", F.struct("coef", "pvalue"))))
        ).alias("coefs")
    )
    # A map has no order of its own: targets are put in order by their names alone.
    entry = F.struct("TargetCol", "coefs")
    by_name = lambda a, b: F.when(a["TargetCol"] < b["TargetCol"], -1).when(a["TargetCol"] > b["TargetCol"], 1).otherwise(0)
    return by_target.groupBy("DeviceId").agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry), by_name)).alias("targets")
    )


def read_documents(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """Configuration rows of documents: one in each line, or with ``lines=False`` one in a file.

    Values keep their JSON text, strings without quotes. A device or a default that stands in two documents fails.
    """
    docs = spark.read.schema(DOCUMENT).option("multiLine", not lines).option("mode", "FAILFAST").json(path)
    default = docs.filter("default is not null").select(F.lit(None).cast("string").alias("DeviceId"), F.col("default").alias("settings"))
    devices = docs.select(F.explode("devices").alias("DeviceId", "settings"))
    return _one_row_each(default.unionByName(devices))


def _one_row_each(config: DataFrame) -> DataFrame:
    # Null keys are not compared, so the defaults get a key of their own.
    keyed = config.withColumn("_device", F.to_json(F.struct("DeviceId")))
    return checked_unique(keyed, ["_device"], "configuration").drop("_device")


def as_documents(config: DataFrame) -> DataFrame:
    """A document for each row of a configuration, as ``read_documents`` takes them."""
    known = F.col("DeviceId").isNotNull()
    return config.select(
        F.when(~known, F.col("settings")).alias("default"),
        F.when(known, F.create_map(F.coalesce("DeviceId", F.lit("")), "settings")).alias("devices"))


def save(config: DataFrame, folder: str, name: str = "orders") -> str:
    """Store a configuration as documents; readers see the version before it until it is complete."""
    return store.save(as_documents(_one_row_each(config)), folder, name, "json")


def load(spark: SparkSession, folder: str, name: str = "orders", version: str | None = None) -> DataFrame:
    """The current configuration, or that of a version; without any, one that has no rows."""
    version = version or store.current(spark, folder, name, missing=None)
    return read_documents(spark, f"{folder.rstrip('/')}/{name}/{version}") if version else spark.createDataFrame([], CONFIG)


def over(low: Column, high: Column) -> Column:
    """Both maps as one; names of ``high`` win, a null map is empty."""
    low, high = (F.coalesce(m, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))) for m in (low, high))
    return F.map_concat(F.map_filter(low, lambda k, v: ~F.map_contains_key(high, k)), high)


def put(config: DataFrame, changes: DataFrame) -> DataFrame:
    """Changed settings replace those of their name, all others stay; new devices are added."""
    new = changes.select(F.col("DeviceId").alias("_id"), F.col("settings").alias("_new"), F.lit(True).alias("_changed"))
    same = F.col("DeviceId").eqNullSafe(F.col("_id"))
    device = F.when(F.col("_changed"), F.col("_id")).otherwise(F.col("DeviceId"))
    return config.join(_one_row_each(new.withColumnRenamed("_id", "DeviceId")).withColumnRenamed("DeviceId", "_id"), same, "full").select(
        device.alias("DeviceId"), over(F.col("settings"), F.col("_new")).alias("settings"))


def effective(devices: DataFrame, config: DataFrame) -> DataFrame:
    """``settings`` of every device: its own over the defaults."""
    own = config.filter("DeviceId is not null").withColumnRenamed("settings", "_own")
    default = config.filter("DeviceId is null").agg(F.first("settings")).scalar()  # one row at most
    joined = devices.join(own, "DeviceId", "left").withColumn("_default", default)
    return joined.withColumn("settings", over(F.col("_default"), F.col("_own"))).drop("_own", "_default")


# Names of a target's settings in the documents.
ORDER, SEASONAL, TRAIN, VALIDATION = "{}_order", "{}_seasonal_order", "{}_train_length", "{}_val_length"
SOURCE, NOTES = "_{}_source", "_{}_notes"


def orders(config: DataFrame, target: str) -> DataFrame:
    """(DeviceId, p, d, q, sp, sd, sq, s, train_length) of the rows that give the target an order of three numbers.

    Seasonal terms are zero where none are written.
    """
    setting = lambda name: F.element_at("settings", F.lit(name.format(target)))
    read = config.select("DeviceId", order_text_to_struct(setting(ORDER)).alias("_o"), order_text_to_struct(setting(SEASONAL)).alias("_s"),
                         setting(TRAIN).try_cast("int").alias("train_length"))
    near = [F.get("_o", i).alias(c) for i, c in enumerate(("p", "d", "q"))]
    season = [F.coalesce(F.get("_s", i), F.lit(0)).alias(c) for i, c in enumerate(("sp", "sd", "sq", "s"))]
    return read.filter(F.size("_o") == 3).select("DeviceId", *near, *season, "train_length")


def outcomes(best: DataFrame, target: str, tiers: dict[str, tuple]) -> DataFrame:
    """Settings that the best rows of a tiered search (``window`` is the tier) write into a configuration.

    A tier that met the limits brings its lengths along; else the order is kept as the best effort, with its errors.
    """
    text = lambda *cols: F.format_string("[" + ", ".join(["%d"] * len(cols)) + "]", *[F.coalesce(F.col(c), F.lit(0)) for c in cols])
    length = lambda i: F.coalesce(*[F.when(F.col("window") == t, F.lit(str(v[i]))) for t, v in tiers.items()])
    effort = F.format_string("Best effort - MAE=%.2f, R2=%.4f", "MAE", "R2")
    pairs = [
        (ORDER, text("p", "d", "q")), (SEASONAL, text("sp", "sd", "sq", "s")),
        (TRAIN, F.when(F.col("success"), length(0))), (VALIDATION, F.when(F.col("success"), length(1))),
        (SOURCE, F.when(F.col("success"), F.col("window")).otherwise(F.concat(F.lit("best_of_"), F.col("window")))),
        (NOTES, F.when(~F.col("success"), effort)),
    ]
    settings = F.create_map(*[x for name, value in pairs for x in (F.lit(name.format(target)), value)])
    return best.filter(F.col("TargetCol") == target).select("DeviceId", F.map_filter(settings, lambda k, v: v.isNotNull()).alias("settings"))
