"""Record mode: JSON exports to snapshots (inventory S1-S5, S8-S16)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import values as V
from .scratch import written
from .snapshot import Snapshot, settled

#: Names under which exports state their dates.
DATE_ALIASES = {"Refreshed": ("Refreshed", "refreshed", "RefreshedAt"), "Created": ("Created", "created", "CreatedAt")}
#: Objects that hold an export's own facts.
METADATA = ("metadata", "Metadata", "meta")
#: Records that source detection looks at (a fixed value of the feature).
DETECTION_RECORDS = 25


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: ``path``, raw ``text``, ``sha256`` of the raw text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"), F.sha2("value", 256).alias("sha256"))


def parse(files: DataFrame) -> DataFrame:
    """Adds ``bom``, ``root`` (variant) and ``error``; a fault is a row, never an exception."""
    bom = F.col("text").startswith("﻿")
    return files.withColumn("bom", bom).withColumn("root", F.try_parse_json(F.when(bom, F.expr("substring(text, 2)")).otherwise(F.col("text")))).withColumn("error", F.when(F.col("root").isNull(), "not valid JSON"))


def _path(field: str) -> str:
    return "$['" + field.replace("'", "\\'") + "']"


def root_keys(parsed: DataFrame) -> DataFrame:
    """Top-level keys of each root object."""
    return parsed.where("root is not null and schema_of_variant(root) like 'OBJECT%'").selectExpr("path", "explode(map_keys(cast(root as map<string, variant>))) as key")


def records(parsed: DataFrame, collection: str = "$") -> DataFrame:
    """``path``, ``idx``, ``body``: the objects of the declared array, numbered after other items were dropped; no array gives no rows."""
    array = F.col("root") if collection == "$" else F.try_variant_get("root", _path(collection), "variant")
    items = parsed.select("path", array.alias("a")).where("a is not null and schema_of_variant(a) like 'ARRAY%'").select("path", F.posexplode(F.expr("cast(a as array<variant>)")).alias("pos", "body"))
    items = items.where("schema_of_variant(body) like 'OBJECT%'")
    order = Window.partitionBy("path").orderBy("pos")  # one file is one partition's work already: it was parsed as one value
    return items.withColumn("idx", F.row_number().over(order).cast("long") - 1).select("path", "idx", "body")


def fields_of(rows: DataFrame) -> list[str]:
    """Names of all fields, sorted; their number is that of a schema."""
    names = rows.select(F.explode(F.map_keys(F.expr("cast(body as map<string, variant>)"))).alias("f")).distinct()
    return sorted(r["f"] for r in names.collect())


def snapshot(rows: DataFrame, fields: Sequence[str] | None = None, normalise: bool = True) -> Snapshot:
    names = list(fields or fields_of(rows))
    cols = [V.json_of_variant(F.variant_get("body", _path(f), "variant")).alias(f"f{i}") for i, f in enumerate(names)]
    return Snapshot(settled(rows.select("idx", *cols)), tuple(names), normalise, nested=True)


def load(spark: SparkSession, path: str, collection: str = "$") -> Snapshot:
    """A snapshot of an export, parsed once and written: each later pass would else parse the whole file again."""
    side = snapshot(records(parse(read_text(spark, path)), collection))
    return Snapshot(written(side.df, "snapshot"), side.fields, side.normalise, side.nested)


def lines(spark: SparkSession, path: str, order: str) -> Snapshot:
    """JSON Lines at scale: one record a line, read in splits; ``order`` names an integral field that orders records."""
    rows = spark.read.option("singleVariantColumn", "body").json(path).select(F.expr(f"variant_get(body, \"{_path(order)}\", 'long')").alias("idx"), "body")
    return snapshot(rows)


def dates(parsed: DataFrame, rows: DataFrame) -> DataFrame:
    """``path``, ``field``, ``value``, ``source``: the root's before a metadata object's before the first record's."""
    out = None
    first = rows.where("idx = 0").select("path", F.col("body").alias("record"))
    base = parsed.where("root is not null").join(first, "path", "left")
    for field, names in DATE_ALIASES.items():
        def got(of: str, prefix: str = "", names: tuple[str, ...] = names) -> Column:
            found = [V.js_trim(F.try_variant_get(of, f"$.{prefix}{n}", "string")) for n in names]
            return F.coalesce(*[F.when(x != "", x) for x in found])

        places = [("root", got("root")), *[("metadata", got("root", f"{m}.")) for m in METADATA], ("record", got("record"))]
        one = base.select("path", F.lit(field).alias("field"), F.coalesce(*[v for _, v in places]).alias("value"), F.coalesce(*[F.when(v.isNotNull(), F.lit(s)) for s, v in places]).alias("source"))
        out = one if out is None else out.unionByName(one)
    return out


def date_order(before: Column, after: Column) -> Column:
    """S11, S12 for one date field: ``reversed``, ``correct``, or ``unverified`` where a date can't be read."""
    b, a = V.parse_date(before), V.parse_date(after)
    return F.when(b.isNull() | a.isNull(), "unverified").when(b >= a, "reversed").otherwise("correct")


def detect_source(side: Snapshot, prefixes: Mapping[str, Sequence[str]], url_fields: Sequence[str]) -> DataFrame:
    """``state`` (match, ambiguous, none) and ``policies``: whose URL prefixes a value of the first records starts with."""
    urls = F.explode(F.array(*[V.js_trim(V.string_of(side.col(f))) for f in url_fields])).alias("url")
    seen = side.df.orderBy("idx").limit(DETECTION_RECORDS).select(urls).where("url is not null")
    spark = side.df.sparkSession
    table = spark.createDataFrame([(p, x.lower()) for p, xs in prefixes.items() for x in xs], "policy string, prefix string")
    hits = seen.join(F.broadcast(table), F.lower("url").startswith(F.col("prefix"))).agg(F.sort_array(F.collect_set("policy")).alias("policies"))
    return hits.select(F.when(F.size("policies") == 1, "match").when(F.size("policies") > 1, "ambiguous").otherwise("none").alias("state"), "policies")


def identity_census(side: Snapshot, fields: Sequence[str]) -> DataFrame:
    """Present, missing and blank counts of each identity field."""
    sums = []
    for i, f in enumerate(fields):
        c = side.col(f)
        sums += [F.count_if(~V.is_blank(c)).alias(f"p{i}"), F.count_if(c.isNull()).alias(f"m{i}"), F.count_if(c.isNotNull() & V.is_blank(c)).alias(f"b{i}")]
    rows = [F.struct(F.lit(f).alias("field"), F.col(f"p{i}").alias("present"), F.col(f"m{i}").alias("missing"), F.col(f"b{i}").alias("blank")) for i, f in enumerate(fields)]
    return side.df.agg(*sums).select(F.inline(F.array(*rows)))
