"""Quantiles, totals, nearest places, polygons and indexed search against plain computations."""

import json
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketlake.operators import geo, reports, search


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_quantiles_equal_the_aggregate(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "b", None]) if i % 3 else "hot", r.choice([1.5, 2.0, None]) if i % 5 else float(r.randint(0, 9999))) for i in range(4000)] + [("one", 7.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    want = {x.g: x.q for x in df.groupBy("g").agg(F.percentile("v", F.array(*[F.lit(s) for s in shares])).alias("q")).collect()}
    got = {x.g: x.q for x in reports.quantiles(df, ["g"], "v", shares).collect()}
    assert got.pop("none", None) is None and set(got) == set(want) - {"none"}
    assert all(np.allclose(got[g], want[g]) for g in got)
    assert np.allclose(reports.quantiles(df, [], "v", shares).first().q, df.agg(F.percentile("v", F.array(*[F.lit(s) for s in shares]))).first()[0])
    assert reports.quantiles(df.limit(0), ["g"], "v", shares).count() == 0
    stats = {x.g: x for x in reports.statistics(df, ["g"], "v").collect()}
    assert stats["none"].median is None and stats["one"].q1 == stats["one"].q3 == 7.0 and len(stats) == 6
    assert "percentile" not in plan(reports.statistics(df, ["g"], "v")).lower()


def test_totals_from_one_scan(spark, tmp_path):
    rows = [("x", "CE"), ("x", "EIS"), (None, "CE"), ("y", "other"), ("x", None)]
    spark.createDataFrame(rows, "k string, process_type string").write.parquet(str(tmp_path / "t"))
    df = reports.crosstab_with_total(spark.read.parquet(str(tmp_path / "t")), "k")
    assert plan(df).count("FileScan") == 1
    assert sorted(map(tuple, df.collect()), key=str) == sorted([("x", 1, 0, 1, 2, 0), (None, 1, 0, 0, 1, 0), ("y", 0, 0, 0, 0, 0), ("Total", 2, 0, 1, 3, 1)], key=str)


def plain_distance(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    return 2 * geo.RADIUS_KM * math.asin(min(1, math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2)))


@pytest.mark.parametrize("degrees", [1.0, 7.5, 30.0])
def test_nearest_place(spark, degrees):
    r = random.Random(4)
    places = [(f"p{i}", r.uniform(-90, 90), r.uniform(-180, 180)) for i in range(80)] + [("west", 10.0, 179.9), ("east", 10.0, -179.5), ("pole", 89.9, 0.0)]
    edges = [(la, lo) for la in (-90.0, -30.0, 0.0, 45.0, 90.0) for lo in (-180.0, -179.99, -90.0, 0.0, 179.99, 180.0)]
    points = [(r.uniform(-90, 90), r.uniform(-180, 180)) for _ in range(300)] + edges + [(10.0, 180.0), (10.0, -180.0), (None, 5.0)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id int, lat double, lon double")
    got = geo.nearest(df, spark.createDataFrame(places + [("nowhere", None, None)], "name string, lat double, lon double"), degrees).collect()
    assert len(got) == len(points)
    for x in got:
        if x.lat is None:
            assert x.nearest is None
            continue
        best = min(plain_distance(x.lat, x.lon, la, lo) for _, la, lo in places)
        assert abs(x.distance_km - best) < 1e-6
        assert abs(plain_distance(x.lat, x.lon, *next(p[1:] for p in places if p[0] == x.nearest)) - best) < 1e-6


def test_centroids_of_polygons(spark, tmp_path):
    square = lambda x, y, s: [[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]]
    shapes = {
        "square": ("Polygon", [square(0, 0, 2)], (1, 1)), "turned": ("Polygon", [square(0, 0, 2)[::-1]], (1, 1)), "holed": ("Polygon", [square(0, 0, 4), square(0, 0, 2)], None),
        "two": ("MultiPolygon", [[square(0, 0, 2)], [square(10, 0, 2)]], (1, 6)), "flat": ("Polygon", [[[0, 0], [1, 1], [0, 0]]], (None, None)), "point": ("Point", [1, 2], (None, None)),
    }
    features = [{"type": "Feature", "properties": {"NAME": n}, "geometry": {"type": k, "coordinates": c}} for n, (k, c, _) in shapes.items()]
    (tmp_path / "s.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    got = {r.name: (r.lat, r.lon) for r in geo.read_geojson(spark, str(tmp_path / "s.json")).collect()}
    for n, (_, _, want) in shapes.items():
        if n == "holed":
            assert np.allclose(got[n], ((16 * 2 - 4 * 1) / 12,) * 2)
        elif want[0] is None:
            assert got[n] == want
        else:
            assert np.allclose(got[n], want)


def test_indexed_search_equals_the_scan(spark, tmp_path):
    r = random.Random(9)
    words = ["Wind", "turbine", "permit", "the", "of", "MW", "10.5", "a+b", "Étude", "license", "rare-word"]
    rows = [(f"D{i % 9}", i, None if i % 50 == 0 else " ".join(r.choices(words, [9, 5, 9, 20, 20, 5, 4, 3, 3, 4, 0.05], k=r.randint(0, 40)))) for i in range(500)]
    pages = spark.createDataFrame(rows, "document_id string, page_number int, page_text string").repartition(3)
    index = search.trigram_index(pages, ["document_id", "page_number"], "page_text", str(tmp_path / "index"))
    for pattern in ("rare-word", "WIND turbine", "wind|rare", r"10\.5", r"a\+b", "perm.t", "turbines?", "t[uo]rbine the", "of{2}", "(?:the) of", "MW", "no such words", "étude", "the +of", "licen"):
        want = {(d, n): t for d, n, t in rows if t is not None and re.search(pattern, t, re.I)}
        got = {(x.document_id, x.page_number): x.context for x in search.search(pages, "page_text", ["document_id", "page_number"], pattern, 5, index).collect()}
        if pattern != "étude":  # beyond ASCII case counts
            assert set(got) == set(want), pattern
        for k, context in got.items():
            at = rows[k[1]][2].lower().find(pattern.lower())
            assert (context is None) == (at < 0) and (at < 0 or pattern.lower() in context.lower())
    sizes = [search.candidates(index, ["document_id", "page_number"], search.required(p)).count() for p in ("rare-word", "turbine", "the")]
    assert sizes[0] < sizes[1] < sizes[2] < 500  # pages read fall with the rarity of the term
    assert search.required("a|bcd") == search.required("x?y") == [] and search.required("abcd?ef") == ["abc"]


def test_the_index_is_packed_where_the_pages_are(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_PAGES", 100)
    texts = ["ab", None, "", "x" * 400, "ABCabc\u00e9abcd", *(f"page {i % 90} of {i}" for i in range(1000))]
    pages = spark.createDataFrame(list(enumerate(texts)), "n long, t string").repartition(3)
    index = search.trigram_index(pages, ["n"], "t", str(tmp_path / "index"))
    per_page = [{t.lower()[i : i + 3] for i in range(len(t) - 2)} for t in texts if t]
    # far fewer rows than pairs of page and gram: one for each gram of a block
    assert index.count() < sum(map(len, per_page)) / 3 and index.where("gram is null").count() <= 15
    assert index.where("gram is null").selectExpr("sum(size(keys))").first()[0] == sum(t is not None and len(t) > 2 for t in texts)
    for grams in (["pag"], ["abc"], ["bca"], ["e 7", " of"], ["xxx"], ["zzz"], ["pag", "xxx"]):
        want = [n for n, t in enumerate(texts) if t and all(g in t.lower() for g in grams)]
        assert sorted(r.n for r in search.candidates(index, ["n"], grams).collect()) == want
