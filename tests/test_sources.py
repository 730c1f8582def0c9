from __future__ import annotations

from pyspark.sql import functions as F

from trailknit.operators import prepare as P
from trailknit.sources import tables as S


def test_csv_and_graph_round_trip(spark, tmp_path):
    head = "user_id,venue_id,venue_category_id,venue_category_name,latitude,longitude,timezone_offset,utc_time,poi_idx\n"
    for i, name in enumerate(("train", "val", "test")):
        (tmp_path / f"{name}_X.csv").write_text(head + f"1,v,,Bar,1.0,2.0,-60,2024-01-01 00:0{i}:30,7\n2,v,,Bar,1,2,0,never,7\n")
    got = sorted((r.orig_split, r.minute, r.poi_idx) for r in S.read_splits(spark, str(tmp_path), "X").collect())
    base = 28401120
    assert got == [("test", base + 2, 7), ("train", base, 7), ("val", base + 1, 7)]
    groups = spark.createDataFrame([(0, [3, 1])], "group_id long, members array<long>")
    S.write_csv(groups, str(tmp_path / "g"))
    assert S.read_groups(spark, str(tmp_path / "g")).first().members == [3, 1]


def test_raw_scan_to_house_tables(spark, tmp_path):
    (tmp_path / "p.tsv").write_text("a\t40.7\t-74.0\tBar\tUS\nb\t42.3\t-71.0\tBar\tUS\nc\tx\t-74\tBar\tUS\nd\t40.71\t-74.01\tCafe\tUS\n")
    (tmp_path / "c.tsv").write_text("".join(f"{u}\t{v}\tTue Apr 03 18:{m:02d}:09 +0000 2012\t-240\n" for u, v, n in ((9, "a", 4), (10, "a", 3), (10, "d", 2), (9, "b", 5)) for m in range(n)))
    (tmp_path / "f.tsv").write_text("9\t10\n10\t9\n9\t9\n9\t77\n")
    pois = S.scan_pois(spark, str(tmp_path / "p.tsv"), (40.0, 41.0, -75.0, -73.0))
    assert sorted(r.venue_id for r in pois.collect()) == ["a", "d"]
    c = S.scan_checkins(spark, str(tmp_path / "c.tsv"), pois)
    assert str(c.selectExpr("min(utc_time) as t").first().t) == "2012-04-03 18:00:09"
    f = S.scan_friendships(spark, str(tmp_path / "f.tsv"), c)
    taxonomy = spark.createDataFrame([("Bar", "Food>Bar"), ("Bar", "Dining>Bar")], "name string, path string")
    house = P.house_tables(pois, c, f, f, taxonomy, (40.0, 41.0, -75.0, -73.0), min_venue=3, min_user=3)
    assert [(r.raw, r.id) for r in house["users"].orderBy("id").collect()] == [("9", 0), ("10", 1)]
    assert [(r.venue_id, r.category) for r in house["poi_metadata"].collect()] == [("a", "Dining>Bar")]
    assert [tuple(r) for r in house["friendship_old"].collect()] == [(0, 1)] and house["friendship_new_only"].count() == 0
    assert house["checkins"].count() == 7


def test_graphml_edges(spark, tmp_path):
    (tmp_path / "g.graphml").write_text(
        '<?xml version="1.0" encoding="utf-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n<key id="d0" for="edge" attr.name="weight" attr.type="double"/>\n<key id="d1" for="edge" attr.name="relation" attr.type="string"/>\n'
        '<graph edgedefault="directed"><node id="a"/><node id="b &amp; c"/>\n<edge source="a" target="b &amp; c"><data key="d0">2.5</data><data key="d1">VISITED</data></edge>\n<edge source="b &amp; c" target="a"><data key="d1">IS_NEAR_TO</data></edge>\n<edge source="a" target="a"/></graph></graphml>\n'
    )
    got = {(r.h, r.rel, r.t) for r in S.read_graphml(spark, str(tmp_path / "g.graphml"), "relation").collect()}
    assert got == {("a", "VISITED", "b & c"), ("b & c", "IS_NEAR_TO", "a"), ("a", None, "a")}


def test_npy_rows(spark, tmp_path):
    import numpy as np

    x = np.arange(30, dtype=np.float32).reshape(10, 3)
    np.save(tmp_path / "x.npy", x)
    got = {r.id: r.z for r in S.read_npy(spark, str(tmp_path / "x.npy"), rows_a_task=4).collect()}
    assert got == {i: x[i].tolist() for i in range(10)}


def test_ids_by_position(spark):
    ids = spark.createDataFrame([(["x", "y"],)], "v array<string>")
    assert [tuple(r) for r in P.by_position(ids, "v", 1).orderBy("poi_idx").collect()] == [(1, "x"), (2, "y")]


def mat_file(order: str, variables: list, compress: bool) -> bytes:
    """A level-5 file of numeric matrices and cells of texts, written by hand."""
    import struct
    import zlib

    import numpy as np

    def element(kind: int, data: bytes) -> bytes:
        if 0 < len(data) <= 4:
            return struct.pack(f"{order}I", len(data) << 16 | kind) + data.ljust(4, b"\0")
        return struct.pack(f"{order}II", kind, len(data)) + data + b"\0" * (-len(data) % 8)

    def array(name: str, value) -> bytes:
        shape, sort, rest = (0, 0), 6, b""
        if isinstance(value, list):
            shape, sort, rest = (len(value), 1), 1, b"".join(array("", v) for v in value)
        elif isinstance(value, str):
            shape, sort, rest = (1, len(value)), 4, element(4, np.array([ord(c) for c in value], f"{order}u2").tobytes())
        else:
            kind = {"i4": 5, "f8": 9}[value.dtype.str[1:]]
            shape, rest = value.shape, element(kind, value.astype(value.dtype.newbyteorder(order)).tobytes(order="F"))
        body = element(6, struct.pack(f"{order}II", sort, 0)) + element(5, struct.pack(f"{order}{len(shape)}i", *shape)) + element(1, name.encode()) + rest
        return struct.pack(f"{order}II", 14, len(body)) + body

    out = b"planted".ljust(124) + struct.pack(f"{order}H", 0x0100) + (b"IM" if order == "<" else b"MI")
    for name, value in variables:
        part = array(name, value)
        out += struct.pack(f"{order}II", 15, len(z := zlib.compress(part))) + z if compress else part
    return out


def test_mat_through_clock_and_categories(spark, tmp_path):
    import numpy as np
    import pytest

    from trailknit.sources import matlab as M

    # user, hour of week, venue, category; the third row falls by 3 hours, the fourth by 152
    rows = np.array([[1, 160, 900, 5], [1, 165, 700, 6], [1, 162, 900, 5], [1, 10, 900, 6], [2, 3, 700, 6], [2, 9, 500, 5]], np.int32)
    parts = [("selected_checkins", rows), ("selected_venue_IDs", ["4a", "4bé", "4c"]), ("friendship_old", np.array([[1.0, 2], [2, 1], [2, 2]])), ("note", "xy")]
    for order, compress in (("<", True), (">", False)):
        folder = tmp_path / f"m{order == '<'}"
        folder.mkdir()
        (folder / "d.mat").write_bytes(mat_file(order, parts, compress))
        c = M.read_checkins(spark, str(folder))
        assert [tuple(r) for r in c.orderBy("row").collect()] == [(i, int(u) - 1, int(s), int(v), int(k)) for i, (u, s, v, k) in enumerate(rows)]
        clock = P.reconstruct_clock(c).orderBy("row").collect()
        assert [(r.week, r.abs_hour) for r in clock] == [(0, 159), (0, 164), (0, 161), (1, 177), (0, 2), (0, 8)]
        assert {r.venue: r.category for r in P.modal_category(c, "venue").collect()} == {900: 5, 700: 6, 500: 5}
        venues = P.compact_ids(c, "venue", "poi_idx").join(M.read_venue_ids(spark, str(folder)), "poi_idx")
        assert {r.venue_id for r in venues.collect()} == {"4a", "4bé", "4c"}
        assert [tuple(r) for r in M.read_friendships(spark, str(folder), "friendship_old").collect()] == [(0, 1)]
        assert M.read_mat(spark, str(folder), "note").first().text == "xy"
        with pytest.raises(ValueError, match="has no variable"):
            M.read_mat(spark, str(folder), "other")


def test_graphml_written_and_read_back(spark, tmp_path):
    import xml.etree.ElementTree as ET

    nodes = spark.createDataFrame([("a", "user", None), ('b & <c>"', "poi", "12.5")], "id string, kind string, lat string").repartition(2)
    edges = spark.createDataFrame([("a", "VISITED", 'b & <c>"', "3"), ('b & <c>"', "IS_NEAR_TO", "a", None), ("a", None, "a", "x > y")], "h string, rel string, t string, count string").repartition(3)
    S.write_graphml(nodes, edges, str(tmp_path / "g"))
    files = list((tmp_path / "g").glob("part-*"))
    assert len(files) > 1 and all(ET.parse(f).getroot().tag.endswith("graphml") for f in files)
    assert {tuple(r) for r in S.read_graphml(spark, str(tmp_path / "g"), "relation").collect()} == {tuple(r)[:3] for r in edges.collect()}
    assert {r.h: r.rel for r in S.read_graphml(spark, str(tmp_path / "g"), "count").where("t = 'a'").collect()} == {"a": "x > y", 'b & <c>"': None}
    assert {r.id: r.attributes for r in S.read_graphml_nodes(spark, str(tmp_path / "g")).collect()} == {"a": {"kind": "user"}, 'b & <c>"': {"kind": "poi", "lat": "12.5"}}


def test_typed_manifest_and_absent_groups(spark, tmp_path):
    import json

    values = {"n": 3, "share": 0.5, "ok": True, "sizes": [2, 8], "of": {"a": None}}
    S.write_manifest(values, spark, str(tmp_path / "m"))
    assert json.loads(next((tmp_path / "m").glob("part-*")).read_text()) == values
    none = S.read_groups(spark, str(tmp_path / "nothing"))
    assert none.count() == 0 and {"group_id", "members"} <= set(none.columns)


def test_mat_file_to_house_tables_and_graph(spark, tmp_path):
    import numpy as np

    from trailknit.operators import graph as K
    from trailknit.sources import matlab as M

    # four users; row 3 falls by 3 hours, row 9 by 152; venue 20 ties between categories 7 and 8
    slots = [100, 110, 120, 117, 121, 130, 140, 150, 160, 8, 9, 10, 20, 30, 40, 50]
    users = [1, 2, 3, 4] * 4
    venues = [10, 20, 30, 40, 50, 20, 10, 20, 30, 20, 10, 50, 40, 10, 20, 30]
    kinds = [7, 7, 8, 9, 9, 8, 7, 7, 8, 8, 7, 9, 9, 7, 9, 8]
    rows = np.array([users, slots, venues, kinds], np.int32).T
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.mat").write_bytes(mat_file("<", [("selected_checkins", rows), ("selected_venue_IDs", list("abcde")), ("friendship_old", np.array([[1, 2], [3, 2]], np.int32)), ("friendship_new", np.array([[1, 4], [2, 1]], np.int32))], True))
    path = str(tmp_path / "d")
    meta = spark.createDataFrame([("a", 40.7, -74.0, "Bar"), ("b", 40.71, -74.0, "Bar"), ("c", 40.72, -74.0, "Cafe"), ("d", 40.73, -74.0, "Shop"), ("e", 40.74, -74.0, "Shop")], "venue_id string, latitude double, longitude double, cat_name string")
    taxonomy = spark.createDataFrame([("Bar", "Food>Bar"), ("Cafe", "Food>Cafe"), ("Cafe", "Dining>Cafe")], "name string, path string")
    house = P.mat_tables(M.read_checkins(spark, path), M.read_venue_ids(spark, path), M.read_friendships(spark, path, "friendship_old"), M.read_friendships(spark, path, "friendship_new"), meta, taxonomy)
    c = house["checkins"].orderBy("ts").collect()
    assert [r.week for r in c] == [0] * 9 + [1] * 7 and c[9].abs_hour == 168 + 7 and c[3].abs_hour == 116
    assert {u: [r.split for r in c if r.user_id == u] for u in range(4)} == {u: ["train", "train", "train", "val"] for u in range(4)}  # ceil(0.7 * 4) and ceil(0.8 * 4)
    places = {r.poi_idx: r for r in house["poi_metadata"].collect()}
    assert [places[i].venue_id for i in range(5)] == list("abcde") and places[1].n_checkins == 5
    assert [places[i].category for i in range(5)] == ["Food>Bar", "Food>Bar", "Dining>Cafe", "Shop", "Shop"]
    assert {tuple(r) for r in house["friendship_new_only"].collect()} == {(0, 3)} and {tuple(r) for r in house["friendship_old"].collect()} == {(0, 1), (1, 2)}
    assert abs(house["purity"].first().mean_purity - (6 / 6 + 3 / 5 + 4 / 5) / 3) < 1e-9
    bare = P.mat_tables(M.read_checkins(spark, path), M.read_venue_ids(spark, path), house["friendship_old"], house["friendship_old"])
    assert {r.category for r in bare["poi_metadata"].collect()} == {"cat-0", "cat-1", "cat-2"} and bare["friendship_new_only"].count() == 0
    v = house["poi_metadata"].withColumns({"region": F.lit("NYC")})
    visits = {(r.h, r.t) for r in K.build(v, house["checkins"].withColumns({"event_id": F.col("ts"), "utc_time": F.col("ts")}), friends=house["friendship_old"]).where("rel = 'VISITED'").collect()}
    assert ("user:0", "poi:3") not in visits and ("user:0", "poi:0") in visits  # a check-in of another split makes no edge


def test_metadata_of_any_delimiter_and_required_columns(spark, tmp_path):
    import pytest

    for sep in ",\t;|":
        (tmp_path / "m.csv").write_text(sep.join(("idx", "venue", "cat", "lat", "lng", "city")) + "\n" + sep.join(("7", "v7", "A>B", "40.5", "-74", "")) + "\n" + sep.join(("8", "", "", "x1", "-74", "L")).replace("x1", "1") + "\n")
        got = [tuple(r) for r in S.read_metadata(spark, str(tmp_path / "m.csv")).orderBy("poi_idx").collect()]
        assert got == [(7, "v7", "A>B", None, None, 40.5, -74.0), (8, "8", "Unknown", "L", None, 1.0, -74.0)]
        visits = P.with_metadata(spark.createDataFrame([(1, 7), (2, 9)], "user_id long, poi_idx long"), S.read_metadata(spark, str(tmp_path / "m.csv")))
        assert {r.user_id: r.category for r in visits.collect()} == {1: "A>B", 2: None}
    assert S.read_one(spark, str(tmp_path / "m.csv"), ()).count() == 2
    with pytest.raises(ValueError, match="poi_idx"):
        S.read_one(spark, str(tmp_path / "m.csv"), ("poi_idx",))


def test_jsonl_graph_and_embedding_round_trips(spark, tmp_path):
    import json

    import pytest

    rows = spark.createDataFrame([("train", 1, [1, 2]), ("test", 2, [3])], "split string, anchor long, members array<long>")
    S.write_jsonl(rows, str(tmp_path / "j"))
    lines = [json.loads(x) for f in (tmp_path / "j" / "split=train").glob("*.json") for x in f.read_text().splitlines()]
    assert lines == [{"anchor": 1, "members": [1, 2]}]
    graph = (spark.createDataFrame([(0, "a", "poi")], "id long, name string, type string"), spark.createDataFrame([(0, "NEAR", 3)], "id long, name string, count long"), spark.createDataFrame([(0, 0, 0)], "h long, r long, t long"))
    S.write_graph(*graph, str(tmp_path / "g"))
    assert [d.collect() for d in S.read_graph(spark, str(tmp_path / "g"))] == [d.collect() for d in graph]
    spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 0.0])], "id long, z array<float>").write.parquet(str(tmp_path / "z"))
    assert {r.id: r.z for r in S.read_embeddings(spark, str(tmp_path / "z"), 2).collect()} == {0: [1.0, 2.0], 1: [0.5, 0.0]}
    with pytest.raises(ValueError, match="3 rows"):
        S.read_embeddings(spark, str(tmp_path / "z"), 3)


def test_venue_edges_of_an_attributed_graph(spark, tmp_path):
    from trailknit.operators import graph as K

    kind = "map<string,string>"
    nodes = [("poi:1", {}), ("x", {"node_type": "POI", "poi_idx": "2"}), ("3", {"type": "poi"}), ("4", {}), ("poi:5", {"node_type": "user"}), ("poi:6", {"poi_idx": "bad"}), ("y", {"poi_idx": "7"})]
    edges = [("poi:1", "x", None, {"relation": "A"}), ("x", "3", "k", {}), ("3", "poi:6", None, {"label": "L", "type": "T"}), ("poi:1", "4", None, {}), ("poi:1", "poi:5", None, {}), ("poi:1", "poi:1", None, {}), ("y", "poi:1", None, {"rel": ""})]
    n, e = spark.createDataFrame(nodes, f"id string, attributes {kind}"), spark.createDataFrame(edges, f"h string, t string, key string, attributes {kind}")
    assert {tuple(r) for r in K.attributed_venue_edges(n, e).collect()} == {(1, "A", 2), (2, "k", 3), (3, "L", 6), (7, "UNKNOWN", 1)}
    assert {tuple(r) for r in K.attributed_venue_edges(n, e, ("A", "L")).collect()} == {(2, "k", 3), (7, "UNKNOWN", 1)}
    flat = spark.createDataFrame([(h, a.get("relation"), t, a.get("label")) for h, t, _, a in edges], "h string, rel string, t string, label string")
    S.write_graphml(spark.createDataFrame([(i, a.get("node_type"), a.get("poi_idx")) for i, a in nodes], "id string, node_type string, poi_idx string"), flat, str(tmp_path / "g"))
    read = K.attributed_venue_edges(S.read_graphml_nodes(spark, str(tmp_path / "g")), S.read_graphml_edges(spark, str(tmp_path / "g")))
    assert {tuple(r) for r in read.collect()} == {(1, "A", 2), (7, "UNKNOWN", 1)}


def test_points_are_drawn_back_into_the_ball(spark):
    import numpy as np

    from trailknit.functions import hyperbolic as H

    for c in (0.5, 1.0, 2.0):
        rows = spark.createDataFrame([([3.0, 4.0],), ([0.1, 0.2],), ([0.0, 0.0],)], "x array<double>").select(H.project(F.col("x"), c).alias("y")).collect()
        most = (1 - 1e-5) / c**0.5
        assert np.allclose([r.y for r in rows], [[0.6 * most, 0.8 * most], [0.1, 0.2], [0.0, 0.0]], atol=1e-12)
