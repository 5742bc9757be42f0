"""Format-preserving pseudonyms for personal numbers, addresses and dates.

Matches are validated first: card numbers by length and check digit, phone
numbers by their groups, IPv4 octets by range, social security numbers by the
ranges in use, dates by the calendar (1900 to 2099), e-mail addresses by shape.

A value becomes a list of cells, each with a radix. A keyed Feistel network
runs over the cells: in every round the cells at even (then odd) places are
moved, modulo their radix, by digits of a digest of key, kind, round and the
other cells. That is a permutation of all values of the format, whatever the
radices. Results outside the format (31 April) are walked on to the next value
of their cycle. Formatting is not part of a value, so one number written in two
ways gets one pseudonym, and equal values stay linked across documents.

Kept as they are: separators, the first digit and validity of a card (its
check digit is computed anew), country codes, mail domains, and whether an area
code or exchange begins with 0 or 1.

Everything is a function of one row; the plan is a scan and a projection.

Null text is empty and stays empty. Texts without matches are unchanged.
Repeated rows and ties get equal results. Overlapping matches: the earlier
start wins, then the order of ``KINDS``. An empty table gives an empty result.
Columns named like a result are replaced. Positions are code points of the
input, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import let, spans_of, text_of, without

KINDS = ["email", "date", "card", "ssn", "phone", "ip"]
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_BEFORE, _AFTER = "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}" + _AFTER,
    "date": rf"{_BEFORE}(?:(?:19|20)[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{2}}([/.])[0-9]{{2}}\1(?:19|20)[0-9]{{2}}){_AFTER}",
    "card": rf"{_BEFORE}(?:[0-9]{{13,19}}|[0-9]{{4}}([ -])[0-9]{{4}}\1[0-9]{{4}}\1[0-9]{{1,7}}|[0-9]{{4}}[ -][0-9]{{6}}[ -][0-9]{{5}}){_AFTER}",
    "ssn": rf"(?<![0-9A-Za-z_-])[0-8][0-9]{{2}}-[0-9]{{2}}-[0-9]{{4}}(?![0-9A-Za-z_-])",
    "phone": rf"(?<![0-9A-Za-z_+])(?:(?:\+[1-9][0-9]{{0,2}}[ .-]?)?(?:\([0-9]{{3}}\)[ .-]?|[0-9]{{3}}[ .-])[0-9]{{3}}[ .-][0-9]{{4}}"
    rf"|\+[1-9][0-9]{{0,2}}(?:[ .-]?\([0-9]{{1,4}}\)(?:[ .-]?[0-9]{{2,4}})(?:[ .-][0-9]{{2,4}}){{1,4}}|(?:[ .-][0-9]{{2,4}}){{2,5}})){_AFTER}",
    "ip": rf"(?<![0-9A-Za-z_.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9A-Za-z_]|\.[0-9])",
}
ROUNDS = 8
#: Steps along a cycle; a date fails to be one with probability below 0.02 a step.
WALK = 16
RESULT = ["spans"]


def digits_of(value: Column) -> Column:
    return F.transform(F.regexp_extract_all(value, F.lit("[0-9]"), F.lit(0)), lambda d: d.cast("int"))


def numbers_of(value: Column) -> Column:
    return F.transform(F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0)), lambda d: d.cast("int"))


def luhn_sum(digits: Column) -> Column:
    """The check sum; every second digit before the last counts double."""
    n = F.size(digits)
    doubled = F.transform(
        digits, lambda d, i: F.when((n - i) % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
    )
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d)


def month_days(year: Column, month: Column) -> Column:
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    return F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)


def real_date(cells: Column) -> Column:
    """Cells are year - 1900 as 2 x 10 x 10, month - 1, day - 1."""
    year = 1900 + 100 * F.get(cells, F.lit(0)) + 10 * F.get(cells, F.lit(1)) + F.get(cells, F.lit(2))
    return F.get(cells, F.lit(4)) < month_days(year, F.get(cells, F.lit(3)) + 1)


def _at(values: Column, i: int) -> Column:
    return F.get(values, F.lit(i))


def feistel(cells: Column, radix: Column, kind: Column, key: str) -> Column:
    """The keyed permutation of ``cells``, each below its ``radix``; up to 64 cells."""

    def round_(state: Column, r: Column) -> Column:
        other = F.array_join(F.transform(F.filter(state, lambda v, i: i % 2 != r % 2), lambda v: v.cast("string")), ",")
        stream = F.sha2(F.concat_ws("|", F.lit(key), kind, r.cast("string"), F.size(state).cast("string"), other), 512)
        return let(
            stream,
            lambda h: F.transform(
                state,
                lambda v, i: F.when(
                    i % 2 == r % 2,
                    (v + F.conv(F.substr(h, 4 * F.floor(i / 2).cast("int") + 1, F.lit(4)), 16, 10).cast("int")) % F.get(radix, i),
                ).otherwise(v),
            ),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), cells, round_)


def _cells(kind: str, m: Column) -> tuple[Column, Column, Column]:
    """(valid, cells, radices) of a match."""
    ints = lambda *xs: F.array(*[x if isinstance(x, Column) else F.lit(x) for x in xs])
    if kind == "email":
        chars = F.transform(F.split(F.lower(F.substring_index(m, "@", 1)), ""), lambda c: F.ascii(c))
        chars = F.filter(chars, lambda c: c > 0)
        value = lambda c: F.when((c >= 97) & (c <= 122), c - 97).when((c >= 48) & (c <= 57), c - 48).otherwise(0)
        radix = lambda c: F.when((c >= 97) & (c <= 122), 26).when((c >= 48) & (c <= 57), 10).otherwise(1)
        return F.lit(True), F.transform(chars, value), F.transform(chars, radix)
    if kind == "date":
        n = numbers_of(m)
        iso = _at(n, 0) > 99
        year = F.when(iso, _at(n, 0)).otherwise(_at(n, 2))
        month, day = _at(n, 1), F.when(iso, _at(n, 2)).otherwise(_at(n, 0))
        past = year - 1900
        valid = (month >= 1) & (month <= 12) & (day >= 1) & (day <= month_days(year, month))
        split = ints(F.floor(past / 100).cast("int"), F.floor(past / 10).cast("int") % 10, past % 10, month - 1, day - 1)
        return valid, split, ints(2, 10, 10, 12, 31)
    if kind == "ssn":
        n = numbers_of(m)
        area, group, serial = _at(n, 0), _at(n, 1), _at(n, 2)
        valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
        return valid, ints(area - 1 - F.when(area > 666, 1).otherwise(0), group - 1, serial - 1), ints(898, 99, 9999)
    if kind == "ip":
        return F.lit(True), numbers_of(m), ints(256, 256, 256, 256)
    if kind == "card":
        d = digits_of(m)
        body = F.slice(d, F.lit(2), F.size(d) - 2)
        return (luhn_sum(d) % 10 == 0) & (_at(d, 0) > 0), body, F.transform(body, lambda _: F.lit(10))
    code = F.length(F.regexp_extract(m, r"^\+([0-9]{1,3})[ .(-]", 1))
    d = digits_of(m)
    body = F.slice(d, code + 1, F.size(d) - code)
    valid = (F.size(d) >= 8) & (F.size(d) <= 15)
    return (
        valid,
        F.zip_with(body, _low(body), lambda v, least: v - least),
        F.transform(body, lambda v, i: F.when(~_leading(body, i), 10).when(v >= 2, 8).otherwise(2)),
    )


def _leading(body: Column, i: Column) -> Column:
    """Whether place ``i`` begins the area code or the exchange of a number of ten digits."""
    return (F.size(body) == 10) & ((i == 0) | (i == 3))


def _low(body: Column) -> Column:
    """The least digit of each cell: leading digits are permuted among 0 and 1, or among 2 to 9."""
    return F.transform(body, lambda v, i: F.when(_leading(body, i) & (v >= 2), 2).otherwise(0))


def _refill(match: Column, digits: Column) -> Column:
    """``match`` with its digits replaced one by one."""
    pieces = F.split(match, "[0-9]", -1)
    return F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get(digits, i).cast("string"), F.lit("")))), "")


def _pad(n: Column, width: int) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def _written(kind: str, m: Column, cells: Column) -> Column:
    if kind == "email":
        local = F.substring_index(m, "@", 1)
        letter = lambda c, v: (
            F.when(c.rlike("[a-z]"), F.char(97 + v)).when(c.rlike("[A-Z]"), F.char(65 + v)).when(c.rlike("[0-9]"), F.char(48 + v)).otherwise(c)
        )
        chars = F.filter(F.split(local, ""), lambda c: c != "")
        return F.concat(F.array_join(F.zip_with(chars, cells, letter), ""), F.substr(m, F.length(local) + 1))
    if kind == "date":
        year = _pad(1900 + 100 * _at(cells, 0) + 10 * _at(cells, 1) + _at(cells, 2), 4)
        month, day = _pad(_at(cells, 3) + 1, 2), _pad(_at(cells, 4) + 1, 2)
        mark = F.substring(m, 3, 1)
        return F.when(F.substring(m, 5, 1) == "-", F.concat_ws("-", year, month, day)).otherwise(
            F.concat(day, mark, month, mark, year)
        )
    if kind == "ssn":
        area = _at(cells, 0) + 1
        return F.concat_ws("-", _pad(area + F.when(area >= 666, 1).otherwise(0), 3), _pad(_at(cells, 1) + 1, 2), _pad(_at(cells, 2) + 1, 4))
    if kind == "ip":
        return F.array_join(F.transform(cells, lambda v: v.cast("string")), ".")
    if kind == "card":
        open_ = F.concat(F.slice(digits_of(m), F.lit(1), F.lit(1)), cells)
        check = (10 - luhn_sum(F.concat(open_, F.array(F.lit(0)))) % 10) % 10
        return _refill(m, F.concat(open_, F.array(check)))
    d = digits_of(m)
    code = F.size(d) - F.size(cells)
    body = F.zip_with(cells, _low(F.slice(d, code + 1, F.size(cells))), lambda v, least: v + least)
    return _refill(m, F.concat(F.slice(d, F.lit(1), code), body))


def found_in(text: Column, key: str) -> Column:
    """Validated matches as (start, rank, stop, kind, put), sorted."""
    lists = [_pseudonyms(spans_of(text, PATTERNS[kind]), rank, kind, key) for rank, kind in enumerate(KINDS)]
    return F.sort_array(F.concat(*lists))


def _pseudonyms(spans: Column, rank: int, kind: str, key: str) -> Column:
    def judged(m: Column) -> Column:
        valid, cells, radix = _cells(kind, m["match"])
        return F.struct(m.alias("m"), valid.alias("valid"), cells.alias("cells"), radix.alias("radix"))

    def permuted(x: Column) -> Column:
        once = lambda cells: feistel(cells, x["radix"], F.lit(kind), key)
        if kind != "date":
            return once(x["cells"])
        return F.aggregate(
            F.sequence(F.lit(1), F.lit(WALK)), x["cells"], lambda s, k: F.when((k == 1) | ~real_date(s), once(s)).otherwise(s)
        )

    return F.transform(
        F.filter(F.transform(spans, judged), lambda x: x["valid"]),
        lambda x: F.struct(
            x["m"]["start"].alias("start"),
            F.lit(rank).alias("rank"),
            x["m"]["stop"].alias("stop"),
            F.lit(kind).alias("kind"),
            let(permuted(x), lambda cells: _written(kind, x["m"]["match"], cells)).alias("put"),
        ),
    )


def apart(found: Column) -> Column:
    """Sorted matches without those that begin inside a kept one."""
    begin = F.struct(F.lit(0).alias("at"), F.slice(found, F.lit(1), F.lit(0)).alias("out"))
    return F.aggregate(
        found,
        begin,
        lambda s, m: F.when(
            m["start"] >= s["at"], F.struct(m["stop"].alias("at"), F.concat(s["out"], F.array(m)).alias("out"))
        ).otherwise(s),
        lambda s: s["out"],
    )


def replaced(text: Column, spans: Column) -> Column:
    """``text`` with each span's characters replaced by its pseudonym."""
    before = lambda m, i: F.coalesce(F.get(spans, i - 1)["stop"], F.lit(0))
    pieces = F.transform(
        spans, lambda m, i: F.concat(F.substr(text, before(m, i) + 1, m["start"] - before(m, i)), m["put"])
    )
    tail = F.coalesce(F.get(spans, F.size(spans) - 1)["stop"], F.lit(0))
    return F.concat(F.array_join(pieces, ""), F.substr(text, tail + 1, F.length(text)))


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``text_col`` rewritten and ``spans`` of (start, rank, stop, kind, put)."""
    base = without(docs, RESULT)
    text = text_of(text_col)
    found = base.select("*", let(found_in(text, key), apart).alias("spans"))
    fresh = F.when(F.size("spans") > 0, replaced(text, F.col("spans"))).otherwise(text)
    return found.select(*[fresh.alias(c) if c == text_col else F.col(f"`{c}`") for c in found.columns])


def op10_pseudonyms(spark, folder: str, key: str = "example key, set your own") -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    listed = F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"]))
    return pseudonymise(docs, key).select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.array_join(listed, ",").alias("spans"), "text"
    )
