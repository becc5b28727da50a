"""Reading map layers and their attributes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parcelmill.functions import geometry as gm
from parcelmill.session import stored

c = F.col


def read_features(df: DataFrame, column: str = "json") -> DataFrame:
    """One row per GeoJSON feature: kind, rings, properties and whether the geometry is usable.

    Polygons keep all rings, multi-polygons the rings of all parts; lines are open paths, one
    per line of a multi-line; multi-points are paths of one place each, as `shape_features`
    takes them. Points give x and y. Nothing is dropped here, callers filter on `valid`.
    """
    schema = "struct<features:array<struct<geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>>"
    rows = df.select(F.explode(F.from_json(c(column), schema)["features"]).alias("f"))
    kind, text = c("f.geometry.type"), c("f.geometry.coordinates")
    place, path, paths = "array<double>", "array<array<double>>", "array<array<array<double>>>"
    raw = (
        F.when(kind.isin("Polygon", "MultiLineString"), F.from_json(text, paths))
        .when(kind == "MultiPolygon", F.flatten(F.from_json(text, f"array<{paths}>")))
        .when(kind == "LineString", F.array(F.from_json(text, path)))
        .when(kind == "MultiPoint", F.transform(F.from_json(text, path), lambda p: F.array(p)))
    )
    rings = F.transform(raw, lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    point = F.when(kind == "Point", F.from_json(text, place))
    known = F.forall("rings", lambda r: F.forall(r, lambda p: p["x"].isNotNull() & p["y"].isNotNull()))
    long_enough = F.forall("rings", lambda r: F.size(r) >= F.when(c("kind") == "MultiPoint", 1).otherwise(2))
    sound = (
        F.when(c("kind").isin("Polygon", "MultiPolygon"), gm.rings_valid(c("rings")))
        .when(c("kind").isin("LineString", "MultiLineString", "MultiPoint"), (F.size("rings") > 0) & long_enough & known)
        .otherwise(F.size("p") >= 2)
    )
    out = rows.select(c("f.properties").alias("properties"), kind.alias("kind"), rings.alias("rings"), point.alias("p"))
    return out.select(
        "properties", "kind", "rings", F.try_element_at("p", F.lit(1)).alias("x"), F.try_element_at("p", F.lit(2)).alias("y"),
        F.coalesce(sound, F.lit(False)).alias("valid"),
    )


_STRING_REST = r'[^"\\]*+(?:\\.[^"\\]*+)*+'  # up to the quote that ends a string
_BRACE = "}"


def _outside(text: Column, inside: bool) -> Column:
    """`text` without its strings; `inside` says whether it begins within one."""
    whole = F.regexp_replace(text, f'(?s)^{_STRING_REST}"?', "") if inside else text
    return F.regexp_replace(whole, f'(?s)"{_STRING_REST}"?', "")


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    """The text between closing braces, with file, block and place in the block."""
    raw = spark.read.option("lineSep", _BRACE).text(path)
    return raw.select(
        c("_metadata.file_path").alias("file"), c("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("pos"), c("value").alias("text")
    )


def _with_depth(rows: DataFrame, parity: Column, depth: Column) -> DataFrame:
    """Whether a fragment begins in a string, and the depth of braces around and at the end of it."""
    before = W.partitionBy("file", "block").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    inside = (parity + F.coalesce(F.sum("quotes").over(before), F.lit(0))) % 2 == 1
    rows = rows.withColumn("inside", inside).withColumns({
        "opens": F.when(c("inside"), c("opens_in")).otherwise(c("opens_out")),
        # The brace that ends the fragment counts unless a string is open there.
        "closes": F.when((c("inside").cast("int") + c("quotes")) % 2 == 0, 1).otherwise(0),
    })
    start = depth + F.coalesce(F.sum(c("opens") - c("closes")).over(before), F.lit(0))
    rows = rows.withColumn("start_depth", start)
    return rows.withColumn("ends", F.when((c("closes") == 1) & (c("start_depth") + c("opens") == 2), 1).otherwise(0))


def feature_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, number, json): every feature of the feature collections of a file or folder.

    One collection may fill a file of any size, with or without line breaks. Files are read in
    blocks and cut at closing braces. A first scan counts quotes and braces per fragment, from
    which follows, over one row per block, whether each block begins in a string, how deep, and
    after how many objects. The second scan cuts features by that, so a feature may lie across
    blocks and texts may hold braces and quotes. Its fragments meet by file and number, so only
    a feature has to fit into memory. Other objects beside the features
    are left out: those of another type, and those without a type and a geometry. Several
    collections may follow each other in a file. A file that breaks off loses its last feature
    or shows it as unreadable. Files must be UTF-8 and not compressed to be read in parts.
    """
    pieces = _fragments(spark, path)
    plain = F.regexp_replace("text", r"(?s)\\.", "")
    figures = [
        (_count(plain, '"') % 2).alias("quotes"), _count(_outside(c("text"), False), "{").alias("opens_out"), _count(_outside(c("text"), True), "{").alias("opens_in"),
    ]
    counts = stored(pieces.select("file", "block", "pos", *figures), "feature_counts")
    by_file = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)

    def so_far(x: str) -> Column:
        return F.coalesce(F.sum(x).over(by_file), F.lit(0))

    turns = [_with_depth(counts, F.lit(k), F.lit(0)).groupBy("file", "block").agg(F.sum(c("opens") - c("closes")).alias(f"rise{k}"), F.sum("quotes").alias("quotes")) for k in (0, 1)]
    blocks = turns[0].join(turns[1].drop("quotes"), ["file", "block"]).withColumn("parity", so_far("quotes") % 2)
    blocks = blocks.withColumn("rise", F.when(c("parity") == 0, c("rise0")).otherwise(c("rise1"))).withColumn("depth", so_far("rise"))
    blocks = stored(blocks.select("file", "block", "parity", "depth"), "feature_blocks")
    done = _with_depth(counts.join(blocks, ["file", "block"]), c("parity"), c("depth")).groupBy("file", "block").agg(F.sum("ends").alias("ended"))
    blocks = blocks.join(done.withColumn("first", so_far("ended")).drop("ended"), ["file", "block"])

    before = W.partitionBy("file", "block").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    rows = _with_depth(pieces.select("file", "block", "pos", "text", *figures).join(blocks, ["file", "block"]), c("parity"), c("depth"))
    rows = rows.withColumn("number", c("first") + F.coalesce(F.sum("ends").over(before), F.lit(0)))
    # What stands before the object: the rest of a string, and text without a brace outside of strings.
    lead = rf'(?s)^[^{{"]*+(?:"{_STRING_REST}"[^{{"]*+)*+'
    head = F.regexp_replace(F.when(c("inside"), F.regexp_replace("text", f'(?s)^{_STRING_REST}"', "")).otherwise(c("text")), lead, "")
    head = F.when(c("start_depth") == 0, F.regexp_replace(F.substr(head, F.lit(2)), lead, "")).otherwise(head)
    begins = (c("start_depth") < 2) & (c("start_depth") + c("opens") >= 2)
    kept = rows.where(begins | (c("start_depth") >= 2)).select("file", "number", "block", "pos", "ends", F.when(begins, head).otherwise(c("text")).alias("text"))
    joined = kept.groupBy("file", "number").agg(
        F.max("ends").alias("whole"), F.sort_array(F.collect_list(F.struct("block", "pos", "text"))).alias("parts")
    )
    text = F.concat(F.array_join(F.transform("parts", lambda p: p["text"]), _BRACE), F.lit(_BRACE))
    out = joined.where(c("whole") == 1).select("file", "number", text.alias("json"))
    kind = F.get_json_object("json", "$.type")
    return out.where((kind == "Feature") | (kind.isNull() & F.get_json_object("json", "$.geometry").isNotNull()))


def read_feature_files(spark: SparkSession, path: str) -> DataFrame:
    """`read_features` of files of any size, cut at the ends of features by many tasks."""
    texts = feature_texts(spark, path)
    return read_features(texts.select(F.concat(F.lit('{"features":['), c("json"), F.lit("]}")).alias("json")))


def feature_counts(features: DataFrame) -> DataFrame:
    return features.agg(F.count_if("valid").alias("loaded"), F.count_if(~c("valid")).alias("skipped"))


def load_layer(
    df: DataFrame, rename: Mapping[str, str], srid: int = 4326, target: int = 3857, x: str = "x", y: str = "y"
) -> DataFrame:
    """Layer rows with lower-case and renamed columns, reprojected when the systems differ."""
    out = df.toDF(*[n.lower() for n in df.columns]).withColumnsRenamed(dict(rename))
    if srid == target:
        return out.withColumn("srid", F.lit(target))
    px, py = gm.reproject(c(x), c(y), srid, target)
    return out.withColumns({x: px, y: py, "srid": F.lit(target)})


def merge_attributes(
    geometry: DataFrame, attributes: DataFrame, key: str = "d_point_id", number: str = "wr_doc_nr", date: str = "eventdate"
) -> DataFrame:
    """Point features with their document attributes; known column variants are mapped."""
    attributes = attributes.toDF(*[x.lower() for x in attributes.columns])
    if number not in attributes.columns:
        near = [x for x in attributes.columns if "wrdocnr" in x or "wr_doc" in x]
        if not near:
            raise KeyError(f"no document number column like {number}")
        attributes = attributes.withColumnRenamed(near[0], number)
    clash = {x: f"{x}_doc" for x in attributes.columns if x in geometry.columns and x != key}
    merged = geometry.join(attributes.withColumnsRenamed(clash), key, "left")
    if date not in merged.columns:
        merged = merged.withColumn(date, c("created_td") if "created_td" in merged.columns else F.lit(None).cast("timestamp"))
    return merged


def load_parcel_geometry(df: DataFrame, rings: str = "rings", srid: int = 3857) -> DataFrame:
    """Parcels with usable rings, their centroid and its latitude and longitude."""
    kept = df.where(c(rings).isNotNull() & (F.size(rings) > 0) & gm.rings_valid(c(rings)))
    placed = kept.withColumn("centroid", gm.centroid(c(rings)))
    lon, lat = gm.reproject(c("centroid.x"), c("centroid.y"), srid, 4326)
    return placed.withColumns({"longitude": lon, "latitude": lat})


def columns_with(df: DataFrame, marks: Sequence[str]) -> list[Column]:
    return [c(x) for x in df.columns if any(m in x for m in marks)]
