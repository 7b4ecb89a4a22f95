"""Call stacks as paths: inclusive values of every prefix, depth, focus and a flame graph's layout."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

SCHEMA = "Stacks array<struct<Value: bigint, Sources: array<int>>>, Sources array<struct<FullName: string, Display: array<string>>>, Scale double, Unit string"


def embedded(html: str | None) -> str | None:
    """The JSON object that the last stackViewer( call of a page is given; none if there is none."""
    start = (html or "").rfind("stackViewer(")
    start = html.find("{", start) if start >= 0 else -1
    if start < 0:
        return None
    try:
        return json.dumps(json.JSONDecoder().raw_decode(html, start)[0])
    except ValueError:
        return None


@arrow_udf(StringType())
def _embedded(pages: pa.Array) -> pa.Array:
    return pa.array([embedded(x) for x in pages.to_pylist()], pa.string())


def embedded_json(html: Column) -> Column:
    """The object as a struct; null if the page has none or it isn't whole."""
    return F.from_json(_embedded(html), SCHEMA)


def paths(pages: DataFrame, data: str = "data") -> DataFrame:
    """(path, value) of each stack of positive value, without its root source."""
    each = pages.select(F.explode(f"{data}.Stacks").alias("s"))
    return each.where("s.Value > 0").select(F.expr("slice(s.Sources, 2, greatest(size(s.Sources) - 1, 0))").alias("path"), F.col("s.Value").alias("value"))


def prefix_totals(rows: DataFrame, path: str = "path", value: str = "value") -> DataFrame:
    """(prefix, depth, total): values of all paths that begin with the prefix. Equal paths are summed before prefixes are made."""
    whole = rows.where((F.size(path) > 0) & (F.col(value) > 0)).groupBy(F.col(path).alias("path")).agg(F.sum(value).alias("value"))
    prefixes = F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.slice("path", F.lit(1), n))
    return whole.select(F.explode(prefixes).alias("prefix"), "value").groupBy("prefix").agg(F.sum("value").alias("total")).withColumn("depth", F.size("prefix"))


def height(rows: DataFrame, path: str = "path") -> DataFrame:
    return rows.agg(F.coalesce(F.max(F.size(path)), F.lit(0)).alias("depth"))


def layout(totals: DataFrame, segment: Column | None = None) -> DataFrame:
    """With parent, offset (where a node starts among its parent's children, by their order) and percent of its level's root sum.

    segment, monotone in the order of siblings, cuts a parent's children into groups that one task can sort; sums of earlier
    segments are added. Without it a parent's children are sorted in one task.
    """
    nodes = totals.withColumn("parent", F.expr("slice(prefix, 1, size(prefix) - 1)")).withColumn("_s", F.lit(0) if segment is None else segment)
    inside = F.sum("total").over(Window.partitionBy("parent", "_s").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1))
    sums = nodes.groupBy("parent", "_s").agg(F.sum("total").alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy("parent").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1))
    before = sums.select(F.col("parent").alias("_p"), F.col("_s").alias("_t"), F.coalesce(earlier, F.lit(0)).alias("_b"))
    whole = totals.where("depth = 1").agg(F.sum("total").alias("whole"))
    told = nodes.withColumn("_i", F.coalesce(inside, F.lit(0)))
    out = told.join(before, told["parent"].eqNullSafe(before["_p"]) & told["_s"].eqNullSafe(before["_t"])).join(whole)
    return out.select("prefix", "parent", "depth", "total", (F.col("_i") + F.col("_b")).alias("offset"), (100 * F.col("total") / F.col("whole")).alias("percent"))


def placed(laid: DataFrame) -> DataFrame:
    """layout()'s nodes as boxes: (prefix, depth, x, width, percent); x is the sum of the offsets of a node and all its ancestors."""
    above = laid.select(F.col("prefix").alias("node"), F.explode(F.transform(F.sequence(F.lit(1), F.size("prefix")), lambda n: F.slice("prefix", F.lit(1), n))).alias("_p"))
    x = above.join(laid.select(F.col("prefix").alias("_p"), "offset"), "_p").groupBy("node").agg(F.sum("offset").alias("x"))
    return laid.join(x, F.col("prefix") == F.col("node")).select("prefix", "depth", "x", F.col("total").alias("width"), "percent")


def focus(totals: DataFrame, name: Column) -> DataFrame:
    """The node whose name matches: the shallowest, then of the largest total, then the smallest path."""
    return totals.where(name).orderBy("depth", F.desc("total"), "prefix").limit(1)
