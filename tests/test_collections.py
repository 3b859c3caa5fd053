"""Collections split over many tasks give what a JSON parser gives of the whole files."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from wayfold.sources import challenges, collections


def feature(i, rng):
    name = rng.choice(['plain', 'br{ace', 'clo}se', 'quo"te', 'back\\', '"},{"', '\\"}', 'é} 日{', ',]', ''])
    return {"type": "Feature", "id": f"f{i}", "geometry": {"type": "Point", "coordinates": [5 + i / 100, 52]}, "properties": {"name": name, "nest": {"a": [{"b": "}"}, {}]}}}


def documents():
    rng = random.Random(2)
    out = {}
    for d in range(8):
        feats = [feature(i, rng) for i in range([0, 1, 2, 12][d % 4])]
        if d in (3, 6):
            feats += [7, "a, {b}", None, True]
            rng.shuffle(feats)
        head = {"format": 1, "name": "x}", "note": '"features":[{'}
        doc = {"type": "FeatureCollection", "title": "a } b { \" c", "challenge": head, "features": feats, "after": {"x": 1}, "n": 3} if d % 3 else {"features": feats, "challenge": head, "type": "FeatureCollection"}
        out[f"d{d}.geojson"] = json.dumps(doc, indent=1 if d % 2 else None, ensure_ascii=d % 5 == 0) + ("\n" if d % 3 == 1 else "")
    return out


BAD = {"torn.geojson": '{"type":"FeatureCollection","features":[{"a":1', "open.geojson": '{"type":"FeatureCollection","features":[{"a":"1}]}', "empty.geojson": "", "gap.geojson": '{"features":[{"a":1} {"b":2}]}', "object.geojson": '{"features":{"a":{"b":1}}}', "text.geojson": "no json"}


def write(folder, docs):
    folder.mkdir()
    for name, text in docs.items():
        (folder / name).write_text(text, encoding="utf-8")


def test_equals_whole_files(spark, tmp_path):
    docs = documents()
    write(tmp_path / "in", docs | BAD)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "701")
    try:
        found = collections.read(spark, str(tmp_path / "in"))
        heads = {r["file"]: r for r in found.documents.collect()}
        feats = {}
        for r in found.features.orderBy("file", "pos").collect():
            feats.setdefault(r["file"], []).append(r["feature"])
        strays = {r["file"]: r["n"] for r in found.strays.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert set(heads) == set(docs) | set(BAD)
    for name, text in (docs | BAD).items():
        assert heads[name]["digest"] == hashlib.sha256(text.encode()).hexdigest(), name
    for name, text in docs.items():
        want = json.loads(text)
        objects = [f for f in want["features"] if isinstance(f, dict)]
        assert [json.loads(f) for f in feats.get(name, [])] == objects, name
        assert strays.get(name, 0) == len(want["features"]) - len(objects), name
        assert json.loads(heads[name]["head"]) == want | {"features": []}, (name, heads[name]["head"])
    for name in ("torn.geojson", "open.geojson", "gap.geojson", "empty.geojson"):
        assert heads[name]["head"] is None, name
    assert "object.geojson" not in feats


def test_parts_of_a_folder_are_one_document(spark, tmp_path):
    folder = tmp_path / "in" / "whole.geojson"
    folder.mkdir(parents=True)
    text = documents()["d4.geojson"]
    for i in range(0, len(text), 100):
        (folder / f"part-{i:05d}").write_text(text[i:i + 100], encoding="utf-8")
    found = collections.read(spark, str(tmp_path / "in"))
    assert [json.loads(r["feature"]) for r in found.features.orderBy("pos").collect()] == json.loads(text)["features"]
    assert found.documents.head()["digest"] == hashlib.sha256(text.encode()).hexdigest()


def test_challenge_above_the_size_of_a_value(spark, tmp_path):
    """A file of 20 MB, more than one variant can hold, and one feature too large by itself."""
    rows = [json.dumps({"type": "Feature", "id": i, "geometry": {"type": "LineString", "coordinates": [[5, 52], [5.001, 52 + i / 1e4]]}, "properties": {"name": f"r{i}", "text": "x" * 9000}}) for i in range(2300)]
    rows.append(json.dumps({"type": "Feature", "id": "big", "geometry": {"type": "LineString", "coordinates": [[5, 52], [5, 53]]}, "properties": {"name": "y" * (17 << 20)}}))
    rows += [json.dumps({"type": "Feature", "id": "gap", "geometry": {"type": "MultiLineString", "coordinates": [[[5, 52], [5, 53]], [[6, 99], [6, 52]]]}, "properties": {"name": "one piece left"}}), "12"]
    write(tmp_path / "in", {"Long walks.challenge.geojson": '{"type":"FeatureCollection","challenge":{"format":1,"name":"W","kind":"routes"},"features":[' + ",\n".join(rows) + "]}"})
    heads, items, lines, problems = challenges.read_challenges(spark, str(tmp_path / "in"))
    assert [(r["challenge_id"], r["items"]) for r in heads.collect()] == [("long-walks", 2301)]
    assert items.count() == 2301 and lines.agg(F.count("*")).head()[0] == 4602
    assert {(r["reason"], r["n"]) for r in problems.collect()} == {("too large", 1), ("not a feature", 1)}
