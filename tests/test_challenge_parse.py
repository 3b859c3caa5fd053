"""Features of challenge files are parsed once, whatever reads what came out."""

from wayfold.sources import challenges as ch
from wayfold.sources.collections import Collections


def test_features_are_parsed_once(spark):
    head = '{"type":"FeatureCollection","challenge":{"format":1,"name":"%s","kind":"locations"},"features":[]}'
    documents = spark.createDataFrame([(f"{n}.geojson", head % n, n * 64) for n in "ab"], "file STRING, head STRING, digest STRING")
    point = '{"type":"Feature","id":%s,"geometry":{"type":"Point","coordinates":[5,%d]},"properties":{"name":"n"}}'
    rows = [("a.geojson", 0, point % (7, 52)), ("a.geojson", 1, point % (7, 53)), ("a.geojson", 2, point % (8, 95)), ("b.geojson", 0, point % (1, 52)), ("b.geojson", 1, '{"type":')]
    features = spark.createDataFrame(rows, "file STRING, pos BIGINT, feature STRING")
    found = ch.parse(Collections(documents, features, spark.createDataFrame([], "file STRING, n BIGINT")))
    for df in found:
        assert "parse_json" not in df._jdf.queryExecution().optimizedPlan().toString().lower()
    challenges, items, lines, problems = found
    assert [(r["challenge_id"], r["items"]) for r in challenges.collect()] == [("a", 1)]
    assert [(r["item_id"], r["lat"], r["lon"]) for r in items.collect()] == [("7", 52.0, 5.0)] and lines.count() == 0
    assert sorted(map(tuple, problems.collect())) == [("a.geojson", "duplicate id", 1), ("a.geojson", "wrong geometry", 1), ("b.geojson", "notJSON", 1)]
