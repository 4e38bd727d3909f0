"""Files, structures, contours and doses as catalog tables: ordering, naming, lineage, visibility."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fallback colours of structures without one, by index.
PALETTE = ((255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 255, 0), (255, 0, 255), (0, 255, 255), (255, 128, 0), (128, 0, 255), (255, 192, 203), (0, 128, 0))


def slices(files: DataFrame) -> DataFrame:
    """IO-04: slice number k of each file within its series, in order of (z, path); files without z drop out. A series has some hundred slices."""
    order = Window.partitionBy("series").orderBy("z", "path")
    return files.where(F.col("z").isNotNull()).withColumn("k", F.row_number().over(order) - 1)


def roi_names(items: DataFrame, *within: str) -> DataFrame:
    """IO-11: (roi, name), of repeated numbers the last by ordinal; ``within`` names columns that tell structure sets apart."""
    return items.groupBy(*within, "roi").agg(F.max_by("name", "ordinal").alias("name"))


def named(contours: DataFrame, names: DataFrame, *within: str) -> DataFrame:
    """IO-10: contour items with the name of their number, or Unknown."""
    return contours.join(names, [*within, "roi"], "left").withColumn("name", F.coalesce("name", F.lit("Unknown")))


def coloured(structures: DataFrame, palette: tuple = PALETTE) -> DataFrame:
    """IO-13: red, green and blue, from the palette by ordinal where absent."""
    at = (F.col("ordinal") % len(palette) + 1).cast("int")
    pick = lambda c: F.element_at(F.array(*[F.lit(p[c]) for p in palette]), at)
    return structures.select(*[c for c in structures.columns if c not in ("red", "green", "blue")], *[F.coalesce(n, pick(c)).alias(n) for c, n in enumerate(("red", "green", "blue"))])


def contour_points(items: DataFrame) -> DataFrame:
    """IO-14: flat coordinate arrays (values) as points; lengths that are no multiple of three and empty ones are rejected; z is the first point's."""
    n = F.size("values")
    good = items.where((n > 0) & (n % 3 == 0))
    points = F.transform(F.sequence(F.lit(0), F.greatest((n / 3).cast("int") - 1, F.lit(0))), lambda i: F.struct(F.try_element_at(F.col("values"), 3 * i + 1).alias("x"), F.try_element_at(F.col("values"), 3 * i + 2).alias("y")))
    return good.withColumn("z", F.try_element_at(F.col("values"), F.lit(3))).withColumn("points", points).drop("values")


def on_slice(contours: DataFrame, k: int, z0: float, dz: float) -> DataFrame:
    """PF-21: contours within half a slice of slice k."""
    return contours.where(F.abs((F.col("z") - z0) / dz - k) <= 0.5)


def lineage(doses: DataFrame) -> DataFrame:
    """JN-21: each dose with the name of the one it derives from, if that is there."""
    source = doses.select(F.col("dose_id").alias("linked"), F.col("name").alias("linked_name"))
    return doses.join(source, "linked", "left").select("dose_id", "name", "linked", "linked_name")


def displayed(fluence: DataFrame, share: float = 0.001) -> DataFrame:
    """PF-20: cells over a share of their beam's maximum."""
    top = fluence.groupBy("beam").agg(F.max("fluence").alias("top"))
    return fluence.join(F.broadcast(top), "beam").where(F.col("fluence") > share * F.col("top")).drop("top")


def distinct_within(rows: DataFrame, tolerance: float) -> DataFrame:
    """ST-05: of sorted values (key, x) those further than the tolerance from the one before."""
    before = F.lag("x").over(Window.partitionBy("key").orderBy("x"))
    return rows.withColumn("before", before).where(F.col("before").isNull() | (F.col("x") - F.col("before") >= tolerance)).drop("before")


# Doses of a plan, as a table (dose_id, name, linked, selected): each operation gives a new table


def dose_added(doses: DataFrame, dose_id: int, name: str, linked: int | None = None) -> DataFrame:
    """AK-43: a dose more, which is then the selected one."""
    new = doses.sparkSession.createDataFrame([(dose_id, name, linked, True)], doses.select("dose_id", "name", "linked", "selected").schema)
    return dose_removed(doses, dose_id).withColumn("selected", F.lit(False)).unionByName(new)


def dose_removed(doses: DataFrame, dose_id: int) -> DataFrame:
    """AK-43: a dose less; if it was selected, the last one of the others is."""
    rest = doses.where(F.col("dose_id") != dose_id).select("dose_id", "name", F.when(F.col("linked") != dose_id, F.col("linked")).alias("linked"), "selected")
    ends = rest.agg(F.max("dose_id").alias("__last"), F.coalesce(F.bool_or("selected"), F.lit(False)).alias("__any"))
    return rest.crossJoin(F.broadcast(ends)).select("dose_id", "name", "linked", (F.col("selected") | (~F.col("__any") & (F.col("dose_id") == F.col("__last")))).alias("selected"))


def dose_selected(doses: DataFrame, dose_id: int) -> DataFrame:
    """AK-43."""
    return doses.withColumn("selected", F.col("dose_id") == dose_id)


def dose_renamed(doses: DataFrame, dose_id: int, name: str) -> DataFrame:
    """AK-43."""
    return doses.withColumn("name", F.when(F.col("dose_id") == dose_id, F.lit(name)).otherwise(F.col("name")))


def report(stats: DataFrame) -> DataFrame:
    """IO-32: (structure, line): statistics of each structure as fixed-point text."""
    two = lambda c: F.format_string("%.2f", F.round(c, 2))
    return stats.select("structure", F.concat(F.col("structure"), F.lit(": min "), two("min_dose"), F.lit(" max "), two("max_dose"), F.lit(" mean "), two("mean_dose"), F.lit(" D95 "), two("d95"), F.lit(" D2 "), two("d2"), F.lit(" V20 "), two("v20"), F.lit("%")).alias("line"))
