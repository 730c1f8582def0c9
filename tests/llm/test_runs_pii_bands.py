"""Periodic runs, personal data and the price-band join against brute force, with nulls, empties, long texts, ties, repeats and extra columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict
from math import floor

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from trailknit.llm import bands, periodic, pii, queries

SCHEMA = "doc_id long, text string, lang string, n_runs string, spans string"
rng = random.Random(11)


# ---------------------------------------------------------------- periodic runs


def brute_runs(x):
    found = {}
    for q in range(1, len(x) // 4 + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, z - a, q) for (a, z), q in found.items())


def planted(n, letters, loops):
    x = [rng.randrange(letters) for _ in range(n)]
    for _ in range(loops):
        p = rng.randrange(1, 14)
        at = rng.randrange(len(x) + 1)
        x[at:at] = ([rng.randrange(letters + 1) for _ in range(p)] * 9)[: rng.randrange(3 * p, 8 * p + 1)]
    return np.array(x, np.int64)


@pytest.mark.parametrize("batch", [1 << 18, 4])
def test_runs_by_brute_force(monkeypatch, batch):
    monkeypatch.setattr(periodic, "BATCH", batch)
    for _ in range(800):
        x = planted(rng.randrange(70), rng.choice((1, 2, 3, 6)), rng.randrange(3))
        assert periodic.runs_of(x) == brute_runs(x.tolist()), x.tolist()


def test_long_sequences():
    assert periodic.runs_of(np.zeros(60_000, np.int64)) == [(0, 60_000, 1)]
    assert (0, 60_000, 12) in periodic.runs_of(np.arange(60_000) // 6 % 2)
    x = np.array([rng.randrange(10**6) for _ in range(7000)] * 5)
    assert periodic.runs_of(x) == [(0, 35_000, 7000)]


@pytest.fixture(scope="module")
def texts():
    loop = "one two three "
    out = [None, "", " \t\n\x0b\x0c\r", "a a a a a", "a a a a a a", loop * 4, "zero " + loop * 5 + "one", "é b " * 9, "A a A a A a A a"]
    return out + [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in range(60)] + ["x y " * 4000]


def expected_runs(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words) if n < 1000 else [(0, n, 2)]
    drop = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else None
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    own = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), own[0], own[1], own[2], own[3], sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


def test_periodic_query(spark, texts, tmp_path):
    rows = [(i + 20 * 5, t, "en", "extra", "clash") for i, t in enumerate(texts[:-1])]
    loops = [i for i in range(300, 900) if zlib.crc32(str(i).encode()) % 10 == 0][:40]
    rows += [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 90))), None, None, None) for i in loops]
    still = next(i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 10)
    rows += [(still, texts[-1], None, None, None), rows[5], rows[5]]
    spark.createDataFrame([*rows, (None, "b " * 8, None, None, None)], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_periodic_runs(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) + 1
    want = {r[0]: expected_runs(r[0], r[1]) for r in rows}
    assert [r for r in got if r.doc_id is not None and tuple(r)[1:] != want[r.doc_id]] == []
    assert [r.n_runs for r in got if r.doc_id is None] == [1]


def test_periodic_operator(spark, texts):
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in periodic.periodic_runs(docs).collect()}
    assert [(r.start, r.length, r.period) for r in got[6].runs] == [(1, 16, 3)] and got[6].collapsed == "zero one two three"
    assert got[0].collapsed == got[1].collapsed == got[2].collapsed == "" and got[3].runs == [] and got[3].n_words == 5
    assert periodic.periodic_runs(docs.where("false")).count() == 0


# ---------------------------------------------------------------- personal data


def luhn(digits):
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def brute_base(text):
    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m[0])
        out += [(m.start(), 2, m.end(), "card")] if 14 <= len(digits) <= 19 and luhn(digits) else []
    out += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return ",".join(f"{kind}:{a}:{z}" for a, _, z, kind in sorted(out))


PIECES = ["a", "b.", "@", "@x", "x.y", "1", "12", ".", "+", "-", " ", "(", ")", "255", "300", "4111111111111111", "4111 1111 1111 1111", "1.2.3.4", "é", "😀", "_", "a@b.c", "+1 (042) 555-7845", "\n", "%", "DE89370400440532013000", " iban ", "078-05-1120", " ssn "]


@pytest.fixture(scope="module")
def private():
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(50))) for _ in range(250)]
    return [*texts, None, "", "a" * 100_000, "1" * 30_000, "a@b.c " * 1000, "+1 " + "(-" * 9000, "x@" * 9000, "Mail a.b@c.de or call +1 (042) 555-7845"]


def test_base_spans_by_brute_force(spark, private):
    docs = spark.createDataFrame([(i, t, "en", "extra", "clash") for i, t in enumerate(private)], SCHEMA)
    found = pii.personal_data(docs.union(docs.where("doc_id = 3"))).select("doc_id", pii.written(F.filter("entities", lambda s: s["base"])).alias("base"), "entities")
    rows = found.collect()
    assert len(rows) == len(private) + 1 and all(r.base == brute_base(private[r.doc_id] or "") for r in rows)
    got = {r.doc_id: r.entities for r in rows}
    assert all((private[i] or "")[e.start : e.end] == e.value for i, es in got.items() for e in es)
    assert [(e.kind, e.score) for e in got[len(private) - 1]] == [("email", 95), ("phone", 75)]
    assert pii.personal_data(docs.where("false")).count() == 0


def test_checksums_and_context(spark):
    texts = ["iban DE89 3704 0044 0532 0130 00 ok", "DE89370400440532013001", "GB82WEST12345698765432.", "my ssn is 078-05-1120", "part 078-05-1120 of", "ssn 000-12-3456", "ssn 1078-05-1120", "test@example.com"]
    got = {r.doc_id: r.entities for r in pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [[(e.kind, e.value) for e in got[i]] for i in range(7)] == [[("iban", "DE89 3704 0044 0532 0130 00")], [], [("iban", "GB82WEST12345698765432")], [("ssn", "078-05-1120")], [], [], []]
    assert got[7][0].score == 70 and got[7][0].base  # the words of the address itself are no context


def test_personal_data_sql(spark, private, tmp_path):
    spark.createDataFrame([(i, t, "en", "x", "y") for i, t in enumerate(private)], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_personal_data(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(pii.ORACLE).select(", ".join(got.columns)).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


# ---------------------------------------------------------------- price bands


def brute_bands(lines, items):
    cents = lambda v: floor(100 * v + 0.5)
    sold = [((2 * cents(a) + q) // (2 * q), s, n, i) for s, n, i, q, a in lines if None not in (s, i, q, a) and q]
    rows = []
    for item, price in items:
        pairs = []
        if item is not None and price is not None:
            p = cents(price)
            pairs = sorted((abs(u - p), u, s, n, i) for u, s, n, i in sold if i != item and (abs(u - p) <= 10 or 1000 * abs(u - p) <= 2 * p))
        total = (len(pairs), sum(x[0] for x in pairs), sum(zlib.crc32(f"{s},{n},{i}".encode()) for _, _, s, n, i in pairs))
        rows += [(item, r + 1, *x, *total) for r, x in enumerate(pairs[:5])] or [(item, 0, *(None,) * 5, 0, 0, 0)]
    return sorted(rows, key=repr)


def test_price_bands(spark, tmp_path):
    lines, items = [], []
    for k in range(3000):
        item = 7 if rng.random() < 0.35 else rng.randrange(60)
        price = rng.choice((3.0, 3.05, 80.0, 81.9, 82.0, 163.8, 164.2, 655.3, 5000.0, rng.randrange(100, 90000) / 100))
        lines.append((k // 3, k % 3 + 1, item, rng.randrange(1, 9), round(price * rng.randrange(1, 9), 2)))
    lines += lines[:40] + [lines[0]] * 9 + [(None, 1, 1, 1, 3.0), (1, 1, None, 1, 3.0), (1, 1, 2, None, 3.0), (1, 1, 2, 1, None), (1, 1, 2, 0, 3.0), (9, 9, 9, 2, -5.0), (9, 1, 3, -2, 7.0)]
    items = [(i, rng.choice((3.0, 3.05, 81.92, 163.84, rng.randrange(100, 90000) / 100))) for i in range(60)]
    items += [(61, None), (None, 3.0), (62, 1e9), (7, 3.0), (7, 3.0), (63, -2.55), (64, 0.0)]
    shop = spark.createDataFrame([(*x, "clash", 1.0) for x in lines], "sale_id long, line_no int, item_id long, quantity int, amount double, u string, price double")
    goods = spark.createDataFrame([(*x, "clash", 2) for x in items], "item_id long, price double, p string, sale_id int")
    shop.write.parquet(f"{tmp_path}/sale_lines.parquet")
    goods.write.parquet(f"{tmp_path}/items.parquet")
    got = sorted(map(tuple, queries.op13_price_bands(spark, str(tmp_path)).collect()), key=repr)
    assert got == brute_bands(lines, items)
    none = bands.band_join(shop.where("false"), goods)
    assert none.count() == len(items) and none.where("n_pairs <> 0 or size(near) > 0").count() == 0
    assert bands.band_join(shop, goods.where("false")).count() == 0
    odd = spark.createDataFrame([(1, 1, 1, 1, float("nan")), (1, 1, 1, 1, float("inf")), (1, None, 1, 1, 3.0)], "sale_id long, line_no int, item_id long, quantity int, amount double")
    found = [(r.n_pairs, len(r.near)) for r in bands.band_join(odd, goods.where("item_id = 7 and price = 3.0")).collect()]
    assert len(found) >= 2 and set(found) == {(1, 1)}


def test_prefix_sums_over_many_levels(spark):
    xs = sorted({rng.randrange(-(1 << 40), 1 << 40) for _ in range(400)} | set(range(500)))
    got = {r.x: int(r.n) for r in bands.prefix_sums(spark.createDataFrame([(x, x % 7) for x in xs], "x long, n long"), ["n"]).collect()}
    total = 0
    for x in xs:
        total += x % 7
        assert got[x] == total


def test_ranges_rise_and_hold_a_few_for_each_band(spark):
    x = spark.createDataFrame([(v,) for v in [*range(-50, 70_000, 3), *(1 << k for k in range(17, 55)), *((1 << k) - 1 for k in range(17, 55))]], "p long")
    rows = bands.bands(x).select("p", bands.price_range(F.col("p")).alias("r"), (bands.price_range(F.col("hi")) - bands.price_range(F.col("lo"))).alias("n")).orderBy("p").collect()
    assert all(a.r <= b.r for a, b in zip(rows, rows[1:])) and max(r.n for r in rows) <= 4


def test_nearest_keeps_enough_of_each_item():
    for _ in range(200):
        rows = sorted((rng.randrange(40), rng.randrange(4), k) for k in range(rng.randrange(80)))
        by = defaultdict(list)
        for r in rows:
            by[r[0]].append(r)
        u, item = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        p = rng.randrange(40)
        got = [rows[i] for i in bands.nearest(u, item, p, p - 10, p + 10)]
        near = sorted((abs(r[0] - p), *r) for r in rows if abs(r[0] - p) <= 10)
        for me in range(5):
            assert [r for r in got if r[1] != me][:5] == [r[1:] for r in near if r[2] != me][:5]
