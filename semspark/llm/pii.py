"""PII: format-preserving Feistel pseudonyms. DataFrame operations only.

Validated numbers and dates are permuted within their format under a key, so equal values stay equal in every document:
cards keep a right Luhn digit, IBANs their letters and right check digits, North American phones valid area and
exchange codes, social security numbers valid areas, dates the calendar (a cycle of 400 years, 146,097 days), IPv4
addresses their four octets. Each is a Feistel network of eight rounds over two mixed moduli, so it is a bijection
without cycle walking. E-mail addresses have no such format; their parts become keyed hashes of the same address: equal
addresses stay equal, and of n addresses about n * n / 2**49 pairs (48 bits) come to share one.
"""

from __future__ import annotations

import logging
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semspark.llm.common import aside, documents, prepare

ROUNDS = 8
#: The session's setting that names the key, and the key of examples, which everyone knows.
KEY_SETTING, EXAMPLE_KEY = "semspark.pii.key", "semspark-demo-key"
log = logging.getLogger(__name__)
KINDS = ("email", "iban", "ip", "date", "ssn", "phone", "card")
PATTERN = "|".join(
    (
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
        r"(?<![0-9A-Za-z-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9A-Za-z-])",
        r"(?<![0-9/])[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}(?![0-9/])",
        r"(?<![0-9.])[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}(?![0-9]|\.[0-9])",
        r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
        r"(?<![0-9A-Za-z(])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])",
        r"(?<![0-9A-Za-z])\+[1-9](?:[ .-]?[0-9]){7,14}(?![0-9A-Za-z])",
        r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
    )
)


def number(x: Column) -> Column:
    return x.cast("bigint")


def keyed(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *(p.cast("string") for p in parts)).cast("binary"), 256)


def feistel(key: str, tweak: str, left: Column, right: Column, a: Column, b: Column) -> Column:
    """struct(l, r): (left, right) in [0, a) x [0, b), permuted."""

    def step(s: Column, i: Column) -> Column:
        def f(x: Column) -> Column:
            return number(F.conv(F.substring(keyed(key, F.lit(tweak), a, b, i, x), 1, 15), 16, 10))

        return F.when(i % 2 == 0, F.struct(((s["l"] + f(s["r"])) % a).alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), ((s["r"] + f(s["l"])) % b).alias("r")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(number(left).alias("l"), number(right).alias("r")), step)


def unpack(s: Column, then) -> Column:
    """then(l, r), with the network evaluated once."""
    return F.element_at(F.transform(F.array(s), lambda x: then(x["l"], x["r"])), 1)


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def padded(x: Column, n: Column | int) -> Column:
    return F.lpad(x.cast("string"), n if isinstance(n, Column) else F.lit(n), F.lit("0"))


def power(n: Column) -> Column:
    return number(F.round(F.pow(F.lit(10.0), n)))


def permuted(key: str, tweak: str, d: Column) -> Column:
    """A string of 2 to 30 digits, permuted among those of its length."""
    n = F.length(d)
    h = F.floor(n / 2).cast("int")
    left, right = F.substr(d, F.lit(1), h), F.substr(d, h + 1)
    return unpack(feistel(key, tweak, left, right, power(h), power(n - h)), lambda x, y: F.concat(padded(x, h), padded(y, n - h)))


def refill(m: Column, d: Column) -> Column:
    """m with its digits replaced by those of d, in turn."""

    def step(s: Column, c: Column) -> Column:
        isdigit = c.rlike("[0-9]")
        return F.struct(F.concat(s["out"], F.when(isdigit, F.substring(s["d"], 1, 1)).otherwise(c)).alias("out"), F.when(isdigit, F.substr(s["d"], F.lit(2))).otherwise(s["d"]).alias("d"))

    return F.aggregate(F.split(m, ""), F.struct(F.lit("").alias("out"), d.alias("d")), step, lambda s: s["out"])


def card(key: str, m: Column) -> Column:
    d = digits(m)
    body = permuted(key, "card", F.substr(d, F.lit(1), F.length(d) - 1))
    with_check = F.element_at(F.transform(F.array(body), lambda p: F.element_at(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda c: F.concat(p, c.cast("string"))), lambda x: F.call_function("luhn_check", x)), 1)), 1)
    return refill(m, with_check)


def mod97(s: Column) -> Column:
    step = lambda acc, c: F.when(c.rlike("[0-9]"), (acc * 10 + c.try_cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.filter(F.split(s, ""), lambda c: c.rlike("[A-Z0-9]")), F.lit(0), step)


def iban(key: str, m: Column) -> Column:
    plain = F.replace(m, F.lit(" "), F.lit(""))
    country, body = F.substring(plain, 1, 2), F.substr(plain, F.lit(5))
    new = F.when(F.length(digits(body)) >= 2, refill(body, permuted(key, "iban", digits(body)))).otherwise(body)
    checked = F.element_at(F.transform(F.array(new), lambda b: F.concat(padded(98 - mod97(F.concat(b, country, F.lit("00"))), 2), digits(b))), 1)
    # the spaces stay where they were; letters too, as only digits are refilled
    return F.element_at(F.transform(F.array(checked), lambda d: refill(m, d)), 1)


def address(key: str, m: Column) -> Column:
    o = F.transform(F.split(m, r"\."), number)
    return unpack(feistel(key, "ip", o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536)), lambda x, y: F.concat_ws(".", F.floor(x / 256).cast("string"), (x % 256).cast("string"), F.floor(y / 256).cast("string"), (y % 256).cast("string")))


def parsed(m: Column) -> Column:
    """The date that m names, null if none; of 1/2/2024 the first number is the month, if it can be."""
    p = F.transform(F.split(m, "[-/.]"), lambda x: x.cast("int"))
    day = lambda y, mo, d: F.concat_ws("-", padded(y, 4), padded(mo, 2), padded(d, 2)).try_cast("date")
    return F.when(m.contains("-"), day(p[0], p[1], p[2])).when(m.contains("/") & (p[0] <= 12), day(p[2], p[0], p[1])).otherwise(day(p[2], p[1], p[0]))


def date(key: str, m: Column) -> Column:
    origin = F.lit("1700-01-01").cast("date")
    n = number(F.datediff(parsed(m), origin))
    cycle = F.floor(n / 146097)
    i = n - cycle * 146097
    new = unpack(feistel(key, "date", F.floor(i / 773), i % 773, F.lit(189), F.lit(773)), lambda x, y: F.date_add(origin, (cycle * 146097 + x * 773 + y).cast("int")))
    p = F.split(m, "[-/.]")
    mark = F.when(m.contains("/"), "/").otherwise(".")

    def written(d: Column) -> Column:
        y, mo, da = padded(F.year(d), 4), F.month(d), F.day(d)
        wide = lambda x, like: padded(x, F.greatest(F.length(like), F.length(x.cast("string"))))
        return (
            F.when(m.contains("-"), F.concat_ws("-", y, padded(mo, 2), padded(da, 2)))
            .when(m.contains("/") & (p[0].cast("int") <= 12), F.concat_ws("/", wide(mo, p[0]), wide(da, p[1]), y))
            .otherwise(F.concat(wide(da, p[0]), mark, wide(mo, p[1]), mark, y))
        )

    return F.element_at(F.transform(F.array(new), written), 1)


def ssn(key: str, m: Column) -> Column:
    d = digits(m)
    area, group, serial = (number(F.substring(d, *x)) for x in ((1, 3), (4, 2), (6, 4)))
    place = F.when(area < 666, area - 1).otherwise(area - 2)
    new = unpack(
        feistel(key, "ssn", place * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999)),
        lambda x, y: F.concat(padded(F.when(F.floor(x / 99) < 665, F.floor(x / 99) + 1).otherwise(F.floor(x / 99) + 2), 3), padded(x % 99 + 1, 2), padded(y + 1, 4)),
    )
    return refill(m, new)


def phone(key: str, m: Column) -> Column:
    d = digits(m)
    n = F.length(d)
    national = F.substr(d, n - 9)
    area, exchange, line = (number(F.substring(national, *x)) for x in ((1, 3), (4, 3), (7, 4)))
    american = ((n == 10) & ~m.startswith("+") | (n == 11) & d.startswith("1")) & (area >= 200) & (exchange >= 200)
    own = unpack(feistel(key, "phone", (area - 200) * 800 + exchange - 200, line, F.lit(640000), F.lit(10000)), lambda x, y: F.concat(F.substr(d, F.lit(1), n - 10), padded(F.floor(x / 800) + 200, 3), padded(x % 800 + 200, 3), padded(y, 4)))
    other = F.concat(F.substring(d, 1, 2), permuted(key, "phone", F.substr(d, F.lit(3))))
    return refill(m, F.when(american, own).otherwise(other))


def email(key: str, m: Column) -> Column:
    low = F.lower(m)
    domain = F.substring_index(low, "@", -1)
    return F.concat(F.lit("u"), F.substring(keyed(key, F.lit("email"), low), 1, 12), F.lit("@d"), F.substring(keyed(key, F.lit("domain"), domain), 1, 8), F.lit("."), F.substring_index(domain, ".", -1))


def classified(m: Column) -> Column:
    d = digits(m)
    octets = F.transform(F.split(m, r"\."), lambda x: x.try_cast("int"))
    area = F.substring(d, 1, 3)
    right_ssn = ~area.isin("000", "666") & (area < "900") & (F.substring(d, 4, 2) != "00") & (F.substring(d, 6, 4) != "0000")
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike("^[A-Z]"), F.when(mod97(F.concat(F.substr(F.replace(m, F.lit(" "), F.lit("")), F.lit(5)), F.substring(m, 1, 4))) == 1, "iban"))
        .when(m.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"), F.when(~F.exists(octets, lambda x: x > 255), "ip"))
        .when(m.rlike(r"^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})$"), F.when(parsed(m).isNotNull(), "date"))
        .when(m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), F.when(right_ssn, "ssn"))
        .when(m.rlike(r"^(?:\+|\(|1[ .-]?\()") | m.rlike(r"^(?:1[ .-])?[0-9]{3}[.-][0-9]{3}[ .-][0-9]{4}$"), "phone")
        .when(F.call_function("luhn_check", d), "card")
    )


def pseudonym(key: str, kind: Column, m: Column) -> Column:
    of = {"email": email, "iban": iban, "ip": address, "date": date, "ssn": ssn, "phone": phone, "card": card}
    out = F.when(F.lit(False), m)
    for k in KINDS:
        out = out.when(kind == k, of[k](key, m))
    return out.otherwise(m)


def same(kind: str, x: Column) -> Column:
    return x == kind


def key_of(spark: SparkSession) -> str:
    """The key that the session sets; else the example key, with a warning, as whoever knows it can undo the pseudonyms."""
    key = spark.conf.get(KEY_SETTING, "")
    if not key:
        log.warning("%s isn't set; pseudonyms are made under a key that is published", KEY_SETTING)
    return key or EXAMPLE_KEY


def pseudonymised(docs: DataFrame, key: str | None = None) -> DataFrame:
    """docs with text replaced, and columns n_pii and n_<kind> (bigint) appended.

    Null and empty texts stay as they are, with counts 0; numbers that fail their validation stay; repeated rows give the
    same; columns of those names in docs give way, all others are kept. key: every document under one key has linked
    pseudonyms, and whoever has it can undo them; without one the session's is taken (key_of).
    """
    prepare(docs.sparkSession)
    key = key or key_of(docs.sparkSession)
    names = [c for c in docs.columns if c not in {"n_pii", *(f"n_{k}" for k in KINDS)}]
    some = F.col("text").rlike("[@0-9]")
    a = aside(docs, "text").withColumn("_raw", F.when(some, F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>")))
    a = a.withColumn("_kinds", F.transform("_raw", classified))
    a = a.withColumn("_new", F.when(F.size("_raw") > 0, F.transform(F.arrays_zip("_raw", "_kinds"), lambda x: pseudonym(key, x["_kinds"], x["_raw"]))))
    rebuilt = F.array_join(F.zip_with(F.split("text", PATTERN, -1), F.col("_new"), lambda p, v: F.concat(p, F.coalesce(v, F.lit("")))), "")
    many = lambda match: F.coalesce(F.size(F.filter("_kinds", match)), F.lit(0)).cast("bigint")
    counts = {f"n_{k}": many(partial(same, k)) for k in KINDS}
    text = F.when(F.size("_raw") > 0, rebuilt).otherwise(F.col("text")).alias("text")
    return a.select(*(text if c == "text" else F.col("_row")[c].alias(c) for c in names), many(lambda x: x.isNotNull()).alias("n_pii"), *(c.alias(n) for n, c in counts.items()))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymised(documents(spark, sf_dir).select("doc_id", "text"))
