"""Column expressions shared by the operators; all run inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEP = ">"
UNKNOWN = "Unknown"


def first_present(df: DataFrame, names: Iterable[str], default: Column | None = None) -> Column:
    """The first of the named columns that df has, without regard to case; else the default, or an error."""
    have = {c.lower(): c for c in df.columns}
    for n in names:
        if n.lower() in have:
            return F.col(f"`{have[n.lower()]}`")
    if default is None:
        raise ValueError(f"none of {list(names)} among {df.columns}")
    return default


# ---------------------------------------------------------------- time (always UTC)


def epoch_minute(ts: str) -> Column:
    """Whole minutes since 1970; ts is a column of timestamps without zone, so the session's zone has no part in it."""
    return F.expr(f"timestampdiff(MINUTE, timestamp_ntz'1970-01-01', {ts})").cast("long")


def hour_of_week(ts: str) -> Column:
    """0 to 167, from Monday midnight."""
    return F.weekday(ts) * 24 + F.hour(ts)


def day_name(ts: str) -> Column:
    return F.date_format(ts, "EEEE")


def parse_social_time(text: str | Column) -> Column:
    """Times like 'Tue Apr 03 18:00:09 +0000 2012'; the weekday is skipped, as Spark doesn't parse it."""
    c = F.col(text) if isinstance(text, str) else text
    return F.try_to_timestamp(F.substring(c, 5, 26), F.lit("MMM dd HH:mm:ss Z yyyy"))


# ---------------------------------------------------------------- category paths


def category_path(category: str | Column) -> Column:
    """'A > B>C' as ['A', 'B', 'C']; empty parts go."""
    c = F.col(category) if isinstance(category, str) else category
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), SEP), lambda x: F.trim(x)), lambda x: x != "")


def prefix(path: Column, level: int | Column) -> Column:
    """The first levels joined by '>', 'Unknown' for an empty path."""
    return F.when(F.size(path) == 0, UNKNOWN).otherwise(F.array_join(F.slice(path, 1, level), SEP))


def shared_depth(a: Column, b: Column) -> Column:
    """How many leading levels two paths share."""
    n = F.least(F.size(a), F.size(b))
    alike = F.transform(F.sequence(F.lit(1), n), lambda i: F.slice(a, 1, i) == F.slice(b, 1, i))
    return F.when(n <= 0, 0).otherwise(F.size(F.filter(alike, lambda x: x)))


def grid_cell(lat: str, lon: str, cell: float) -> Column:
    """The south-west corner of a grid cell, as '%.4f,%.4f'."""
    corner = lambda c: F.floor(F.col(c) / cell) * cell
    return F.format_string("%.4f,%.4f", corner(lat), corner(lon))


def finite(*names: str) -> Column:
    out = F.lit(True)
    for n in names:
        out &= F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(n) < float("inf"))
    return out


def poi_of_node(name: str) -> Column:
    """The number in node names like 'poi:12', 'POI_12' and 'poi12', else null."""
    found = F.regexp_extract(name, r"(?i)^poi[:_]?(\d+)$", 1)
    return F.when(found != "", found.cast("long"))


def poi_of(name: str, attributes: str) -> Column:
    """The venue number of a node with attributes (map of texts), else null: not of another type; by its poi_idx, its name, or a bare number of type POI."""
    get = lambda k: F.try_element_at(attributes, F.lit(k))
    kind = F.upper(F.coalesce(get("node_type"), get("type"), F.lit("")))
    bare = F.when((kind == "POI") & F.col(name).rlike(r"^\d+$"), F.expr(f"try_cast({name} as bigint)"))
    return F.when(kind.isin("", "POI"), F.coalesce(get("poi_idx").try_cast("bigint"), poi_of_node(name), bare))


def relation_of(attributes: str, key: str) -> Column:
    """An edge's relation: the first of its attributes relation, rel, label and type that says something, else its key, else UNKNOWN."""
    get = lambda k: F.when(F.try_element_at(attributes, F.lit(k)) != "", F.try_element_at(attributes, F.lit(k)))
    return F.coalesce(*[get(k) for k in ("relation", "rel", "label", "type")], F.col(key), F.lit("UNKNOWN"))


# ---------------------------------------------------------------- hash order in the place of random numbers


def order_key(*parts: Column | str | int) -> Column:
    """A reproducible random order: the MD5 of the parts, written with '-' between them."""
    return F.md5(F.concat_ws("-", *[F.lit(str(p)) if isinstance(p, int) else (F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]))


def pairs_within(members: str) -> Column:
    """All (u1, u2) with u1 < u2 of a sorted array, as an array of structs."""
    m = F.col(members)
    return F.flatten(F.transform(m, lambda x, i: F.transform(F.slice(m, i + 2, F.size(m)), lambda y: F.struct(x.alias("u1"), y.alias("u2")))))
