"""Personal data in DataFrame functions only: patterns propose spans, checksums confirm them, context words adjust the score.

Each kind's pattern splits a text into hits and the gaps between them; running sums of their lengths give positions in code points,
and the ends of the neighbouring gaps give the context. Checks: parts of at most 255 (ip), 14 to 19 digits with Luhn's
checksum (card), 10 to 15 digits (phone), mod 97 and the usual groups (iban), assigned ranges (ssn). A score in percent starts from
the kind's PRIOR, gains KNOWN where a context word of the kind is within NEAR code points and loses DOUBT where a word for
test data is. Base kinds (email, ip, card, phone) stay whatever their score; spans of the other kinds stay from KEEP on, so that
an iban needs its checksum, and an ssn a word such as "ssn" beside it.

Patterns are those of the contract, written so that no text makes them slow: classes that can't give back are possessive, and
an email starts where its run of characters does, or where the hit before ends, since any later start in the run fails or succeeds with it.
No step shuffles: a document's spans depend on its text alone. Positions are summed in blocks of STEP hits, so that long texts take no
quadratic time in practice.

Edge cases: null and empty texts have no spans; repeated rows get equal answers; rows without doc_id are treated alike; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE, MORE = ("email", "ip", "card", "phone"), ("iban", "ssn")
KINDS = (*BASE, *MORE)
NEAR, KEEP, KNOWN, DOUBT, STEP = 40, 50, 25, 20, 128
PRIOR = {"email": 70, "ip": 50, "card": 65, "phone": 50, "iban": 70, "ssn": 40}
WORDS = {
    "email": "mail|email|contact|write|address",
    "ip": "ip|host|server|login|address",
    "card": "card|visa|mastercard|credit|debit|payment",
    "phone": "phone|tel|call|mobile|fax|cell",
    "iban": "iban|bank|account|transfer",
    "ssn": "ssn|social|security|taxpayer",
}
ENTITY = "array<struct<start:bigint,rank:int,end:bigint,kind:string,value:string,score:int,base:boolean>>"
TESTS = "test|example|sample|dummy|version|isbn"
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
SIGNS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def running(steps: Column) -> Column:
    """The running sums of an array of longs, block by block, so that no long array is copied at each step."""
    zero = F.array(F.lit(0).cast("long"))
    add = lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x)
    block = lambda i: F.slice(steps, i * STEP + 1, STEP)
    within = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / STEP).cast("int")), lambda i: F.aggregate(block(i), zero, add))
    begins = F.aggregate(within, zero, lambda acc, b: F.array_append(acc, F.element_at(acc, -1) + F.element_at(b, -1)))
    sums = F.zip_with(within, F.slice(begins, 1, F.size(within)), lambda b, at: F.transform(F.slice(b, 2, STEP), lambda x: x + at))
    return F.flatten(sums)


def mod97(compact: Column) -> Column:
    """The number that an iban stands for, modulo 97 (1 for a valid one)."""
    turned = F.split(F.concat(F.substring(compact, 5, 60), F.substring(compact, 1, 4)), "")
    return F.aggregate(turned, F.lit(0), lambda acc, c: F.when(c <= "9", acc * 10 + F.ascii(c) - 48).otherwise(acc * 100 + F.ascii(c) - 55) % 97)


def confirmed(kind: str, s: Column) -> Column:
    """Whether the span (value, before, after) passes the checks of its kind."""
    value, digits = s["value"], F.regexp_replace(s["value"], "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^(?:{PART}\.){{3}}{PART}$")
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "iban":
        return ~s["before"].rlike(r"[A-Za-z0-9]\z") & ~s["after"].rlike("^[A-Za-z0-9]") & (mod97(F.replace(value, F.lit(" "))) == 1)
    if kind == "ssn":
        return ~s["before"].rlike(r"[0-9-]\z") & ~s["after"].rlike("^[0-9-]") & ~value.rlike("^(?:000|666|9..)|-00-|0000$")
    return F.lit(True)


def score(kind: str, s: Column) -> Column:
    near = F.translate(F.concat(s["before"], F.lit(" # "), s["after"]), UPPER, LOWER)
    has = lambda words: near.rlike(f"(?:^|[^a-z])(?:{words})(?:[^a-z]|$)")
    return F.lit(PRIOR[kind]) + F.when(has(WORDS[kind]), KNOWN).otherwise(0) - F.when(has(TESTS), DOUBT).otherwise(0)


def _proposed(kind: str) -> Column:
    """The hits of a kind with their places and contexts."""
    gaps, hits, n = F.col(f"{kind}.gaps"), F.col(f"{kind}.hits"), F.size(f"{kind}.hits")
    placed = F.zip_with(hits, F.col(f"{kind}_at"), lambda hit, at: F.struct(at.alias("start"), hit.alias("value")))
    near = F.zip_with(F.slice(gaps, F.lit(1), n), F.slice(gaps, F.lit(2), n), lambda a, b: F.struct(F.right(a, F.lit(NEAR)).alias("before"), F.left(b, F.lit(NEAR)).alias("after")))
    return F.zip_with(placed, near, lambda s, c: F.struct(s["start"].alias("start"), s["value"].alias("value"), c["before"].alias("before"), c["after"].alias("after")))


def _scored(kind: str) -> Column:
    """The confirmed spans of a kind as entities, without those of too low a score."""
    base, rank = kind in BASE, KINDS.index(kind)
    end = lambda s: s["start"] + F.length(s["value"])
    each = F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), end(s).alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value"), score(kind, s).alias("score"), F.lit(base).alias("base")))
    return each if base else F.filter(each, lambda s: s["score"] >= KEEP)


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, entities) of each row: start, rank of the kind, end, kind, value, score, base; by start and then kind.

    start and end are code points, end exclusive.
    """
    text = F.col("text")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    cut = {}
    for kind in KINDS:
        may = text.contains(SIGNS[kind]) & text.rlike(PATTERNS[kind]) if kind in SIGNS else text.rlike(PATTERNS[kind])
        cut[kind] = F.when(may, F.struct(F.split(text, PATTERNS[kind], -1).alias("gaps"), F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)).alias("hits")))
    found = found.select("doc_id", *[c.alias(k) for k, c in cut.items()])
    steps = {}
    for kind in KINDS:
        before = F.concat(F.array(F.lit("")), F.col(f"{kind}.hits"))
        steps[kind] = F.slice(F.zip_with(F.col(f"{kind}.gaps"), before, lambda gap, hit: (F.length(gap) + F.length(hit)).cast("long")), F.lit(1), F.size(f"{kind}.hits"))
    found = found.withColumns({f"{k}_steps": c for k, c in steps.items()})
    found = found.withColumns({f"{k}_at": F.when(F.col(k).isNotNull(), running(F.col(f"{k}_steps"))) for k in KINDS})
    found = found.select("doc_id", *[F.filter(_proposed(k), lambda s: confirmed(k, s)).alias(k) for k in KINDS])  # noqa: B023
    return found.select("doc_id", F.array_sort(F.concat(*[F.coalesce(_scored(k), F.array().cast(ENTITY)) for k in KINDS])).alias("entities"))


def written(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


#: The same for DuckDB: patterns as in the contract, checks and scores as above.
_PLAIN = PATTERNS | {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "card": r"[0-9](?:[\x20-]?[0-9])+"}
_CODES = "[CASE WHEN c <= '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END FOR c IN string_split(replace(value, ' ', '')[5:] || value[1:4], '')]"
_CHECKS = {
    "email": "true",
    "ip": rf"regexp_full_match(value, '(?:{PART}\.){{3}}{PART}')",
    "card": "length(digits) BETWEEN 14 AND 19 AND list_sum(list_transform(string_split(reverse(digits), ''), lambda d, i: CASE WHEN i % 2 = 1 THEN d::INT WHEN d > '4' THEN 2 * d::INT - 9 ELSE 2 * d::INT END)) % 10 = 0",
    "phone": "length(digits) BETWEEN 10 AND 15",
    "iban": f"NOT regexp_matches(before, '[A-Za-z0-9]$') AND NOT regexp_matches(after, '^[A-Za-z0-9]') AND list_reduce(list_prepend(0, {_CODES}), lambda a, c: (a * CASE WHEN c < 10 THEN 10 ELSE 100 END + c) % 97) = 1",
    "ssn": "NOT regexp_matches(before, '[0-9-]$') AND NOT regexp_matches(after, '^[0-9-]') AND NOT regexp_matches(value, '^(?:000|666|9..)|-00-|0000$')",
}


def _sql(kind: str) -> str:
    pattern, has = _PLAIN[kind], lambda words: f"regexp_matches(near, '(?:^|[^a-z])(?:{words})(?:[^a-z]|$)')"
    kept = "" if kind in BASE else f" WHERE score >= {KEEP}"
    return f"""SELECT * FROM (SELECT row, '{kind}' AS kind, {KINDS.index(kind)} AS rank, {kind in BASE} AS base, start, start + length(value) AS "end",
      {PRIOR[kind]} + CASE WHEN {has(WORDS[kind])} THEN {KNOWN} ELSE 0 END - CASE WHEN {has(TESTS)} THEN {DOUBT} ELSE 0 END AS score
    FROM (SELECT *, translate(before || ' # ' || after, '{UPPER}', '{LOWER}') AS near FROM (
      SELECT row, value, right(gap, {NEAR}) AS before, left(later, {NEAR}) AS after, regexp_replace(value, '[^0-9]', '', 'g') AS digits, sum(length(gap) + length(value)) OVER (PARTITION BY row ORDER BY i) - length(value) AS start
      FROM (SELECT row, unnest(h) AS value, unnest(g[1:len(h)]) AS gap, unnest(g[2:]) AS later, generate_subscripts(h, 1) AS i
        FROM (SELECT row, regexp_extract_all(text, '{pattern}') AS h, string_split_regex(text, '{pattern}') AS g FROM d))) WHERE {_CHECKS[kind]})){kept}"""


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
e AS ({" UNION ALL ".join(_sql(k) for k in KINDS)}),
s AS (SELECT row, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in KINDS)}, max(score) AS risk,
  string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST("end" AS BIGINT), ',' ORDER BY start, rank) FILTER (base) AS own,
  string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST("end" AS BIGINT), ',' ORDER BY start, rank) AS spans FROM e GROUP BY row)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in KINDS)}, sha256(coalesce(own, '')) AS base_sha256, coalesce(spans, '') AS spans, CAST(coalesce(risk, 0) AS INTEGER) AS risk
FROM d LEFT JOIN s USING (row)
"""
