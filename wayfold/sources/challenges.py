"""Challenge files: GeoJSON with a validated header block, exploded into items and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.functions import activity as fa
from wayfold.session import cut
from wayfold.sources import collections

# Format version, id pattern, and (default, least, most) of the numeric settings.
FORMAT, ID_PATTERN, RESULT_VERSION = 1, "^[a-z0-9][a-z0-9-]{0,63}$", 1
#: Bytes of a feature that can be told as a variant.
LARGEST = 16 << 20
NUMBERS = {"radius": (200.0, 10.0, 5_000.0), "coverage": (0.9, 0.1, 1.0), "spacing": (50.0, 10.0, 1_000.0)}


def _text(json: Column, path: str) -> Column:
    value = F.when(F.schema_of_variant(F.try_variant_get(json, path, "variant")) == "STRING", F.try_variant_get(json, path, "string"))
    return F.nullif(F.trim(value), F.lit(""))


def _kind(json: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(json, path, "variant"))


def _is_number(kind: Column) -> Column:
    return kind.rlike("^(BIGINT|DOUBLE|DECIMAL)")


def parse(found: collections.Collections, header: str = "challenge") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(challenges, items, lines, problems) of collections.

    A file fails with the first problem of its header; its features that can't be used are
    reported per reason. Of files sharing an id the first by name counts. A feature beyond the size
    of a variant is reported as too large, the others of its file are read. Features are parsed once:
    what is read of them is stored, as are the checked heads."""
    h = f"$.{header}"
    doc = F.col("doc")
    features = found.features.withColumn("f", F.try_parse_json("feature")).withColumn("large", F.octet_length("feature") > LARGEST)
    f = F.col("f")
    given = [F.coalesce(F.when(_kind(f, p) == "STRING", F.nullif(F.try_variant_get(f, p, "string"), F.lit(""))), F.when(_is_number(_kind(f, p)), F.try_variant_get(f, p, "string"))) for p in ("$.id", "$.properties.id")]
    geometry = F.try_variant_get(f, "$.geometry.type", "string")
    at = F.try_variant_get(f, "$.geometry.coordinates", "array<double>")
    line = F.try_variant_get(f, "$.geometry.coordinates", "array<array<double>>")
    many = F.try_variant_get(f, "$.geometry.coordinates", "array<array<array<double>>>")

    def valid(p):
        return (F.size(p) >= 2) & F.coalesce(p[0].between(-180.0, 180.0) & p[1].between(-90.0, 90.0), F.lit(False))

    pieces = F.when(geometry == "LineString", F.array(line)).when(geometry == "MultiLineString", many)
    usable = F.filter(pieces, lambda piece: (F.size(piece) >= 2) & F.forall(piece, valid))
    told = cut(features.select("file", "pos", "large", (f.isNull() & ~F.col("large")).alias("unread"), F.coalesce(*given).alias("item_id"), _text(f, "$.properties.name").alias("name"), _text(f, "$.properties.subtitle").alias("subtitle"),
                               F.try_variant_get(f, "$.properties.difficulty", "string").alias("difficulty"), F.try_variant_get(f, "$.type", "string").alias("type"), geometry.alias("geometry"),
                               F.when((geometry == "Point") & F.coalesce(valid(at), F.lit(False)), at).alias("at"), usable.alias("pieces")))
    torn = told.filter("unread").select("file").distinct().withColumn("torn", F.lit(True))
    raw = found.documents.join(torn, "file", "left").withColumn("doc", F.when(F.col("torn").isNull(), F.try_parse_json("head")))

    def has(name):
        return _kind(doc, f"{h}.{name}").isNotNull()

    name, kind = _text(doc, f"{h}.name"), F.try_variant_get(doc, f"{h}.kind", "string")
    stem = F.regexp_replace(F.regexp_replace("file", r"\.[^.]*$", ""), rf"\.{header}", "")
    own_id = F.when(has("id"), F.when(_kind(doc, f"{h}.id") == "STRING", F.try_variant_get(doc, f"{h}.id", "string")).otherwise("")).otherwise(fa.slug(stem))
    complete = F.when(has("complete"), F.try_variant_get(doc, f"{h}.complete", "string")).otherwise("cover")
    form = F.try_variant_get(doc, f"{h}.format", "bigint")
    sports = F.try_variant_get(doc, f"{h}.sports", "array<string>")
    problem = (F.when(doc.isNull(), "notJSON")
               .when(~F.coalesce(F.try_variant_get(doc, "$.type", "string") == "FeatureCollection", F.lit(False)) | ~F.coalesce(_kind(doc, "$.features").startswith("ARRAY"), F.lit(False)), "notFeatureCollection")
               .when(~F.coalesce(_kind(doc, h).startswith("OBJECT"), F.lit(False)), "noHeader").when(form.isNull(), "missing format").when(form > FORMAT, "unsupported format")
               .when(name.isNull(), "missing name").when(kind.isNull(), "missing kind").when(~kind.isin("locations", "routes"), "invalid kind").when(~own_id.rlike(ID_PATTERN), "invalid id")
               .when(has("complete") & (~F.coalesce(complete.isin("cover", "cross"), F.lit(False)) | (kind != "routes")), "invalid complete"))
    numbers = {}
    for field, (default, low, high) in NUMBERS.items():
        value = F.when(_is_number(_kind(doc, f"{h}.{field}")), F.try_variant_get(doc, f"{h}.{field}", "double"))
        problem = problem.when(has(field) & ~F.coalesce(value.between(low, high), F.lit(False)), f"invalid {field}")
        numbers[field] = F.coalesce(value, F.lit(default))
    problem = problem.when(has("sports") & (F.coalesce(F.size(sports), F.lit(0)) <= 0), "invalid sports")
    key = F.concat(F.lit(f"x{RESULT_VERSION}-"), F.substring("digest", 1, 12))
    heads = cut(raw.select("file", problem.alias("problem"), own_id.alias("challenge_id"), name.alias("name"), F.coalesce(_text(doc, f"{h}.tab"), name).alias("tab"), _text(doc, f"{h}.icon").alias("icon"),
                       kind.alias("kind"), complete.alias("complete"), *[v.alias(k) for k, v in numbers.items()], sports.alias("sports"), key.alias("key")))

    shaped = told.drop("unread").join(heads.filter("problem is null").select("file", "challenge_id", "kind", "complete"), "file")
    size = F.coalesce(F.size("pieces"), F.lit(0))
    located = F.when(F.col("kind") == "locations", F.col("at").isNotNull()).otherwise((size > 0) & ((F.col("complete") == "cover") | (size == 1)))
    reason = (F.when(F.col("large"), "too large").when(~F.coalesce(F.col("type") == "Feature", F.lit(False)) | F.col("geometry").isNull(), "not a feature").when(F.col("item_id").isNull(), "no id").when(F.col("name").isNull(), "no name").when(~located, "wrong geometry"))
    first = F.min("pos").over(Window.partitionBy("file", "item_id"))
    fine = shaped.withColumn("reason", reason)
    dup = fine.filter("reason is null").withColumn("_first", first)
    items = dup.filter(F.col("pos") == F.col("_first"))
    skipped = (fine.filter("reason is not null").select("file", "reason").unionByName(dup.filter(F.col("pos") > F.col("_first")).select("file", F.lit("duplicate id").alias("reason")))
               .withColumn("n", F.lit(1)).unionByName(found.strays.join(heads.filter("problem is null").select("file"), "file", "left_semi").select("file", F.lit("not a feature").alias("reason"), "n"))
               .groupBy("file", "reason").agg(F.sum("n").cast("bigint").alias("n")))
    counts = items.groupBy("file").agg(F.count(F.lit(1)).alias("items"))
    checked = heads.join(counts, "file", "left").withColumn("problem", F.coalesce("problem", F.when(F.col("items").isNull(), "noItems")))
    lead = checked.filter("problem is null").groupBy("challenge_id").agg(F.min("file").alias("_lead"))
    ranked = cut(checked.join(lead, "challenge_id", "left").withColumn("problem", F.coalesce("problem", F.when(F.col("file") != F.col("_lead"), "duplicate challenge id"))))
    challenges = ranked.filter("problem is null").drop("problem", "_lead")
    live = items.join(challenges.select("file"), "file", "left_semi")
    lines = (live.filter("kind = 'routes'").select("challenge_id", "item_id", F.posexplode("pieces").alias("piece", "l")).select("challenge_id", "item_id", "piece", F.posexplode("l").alias("seq", "p"))
             .select("challenge_id", "item_id", "piece", "seq", F.col("p")[1].alias("lat"), F.col("p")[0].alias("lon")))
    flat = live.select("challenge_id", "item_id", "name", "subtitle", "difficulty", F.col("at")[1].alias("lat"), F.col("at")[0].alias("lon"), F.size(F.coalesce("pieces", F.array())).alias("pieces"))
    problems = ranked.filter("problem is not null").select("file", F.col("problem").alias("reason"), F.lit(1).cast("bigint").alias("n")).unionByName(skipped)
    return challenges, flat, lines, problems


def read_challenges(spark: SparkSession, path: str, header: str = "challenge"):
    """(challenges, items, lines, problems) of the challenge files below ``path``; see ``collections``."""
    return parse(collections.read(spark, path), header)
