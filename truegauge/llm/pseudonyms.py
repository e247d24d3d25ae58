"""Format-preserving pseudonyms for personal data.

E-mail names, card, phone and social security numbers, IPv4 addresses and dates are
found by one pattern and validated (Luhn sum, ranges, calendar). Each valid value is
permuted by a keyed Feistel network inside its own format: same length, same
separators, again valid. The permutation depends on the key and the value alone, so equal
values get equal pseudonyms in all documents and keep linking them, without any
table or shuffle. With the key the network can be run backwards.

Native SQL functions only, in one pass. Null texts stay null. Values that fail their check are
left as they are, and so is every text without a valid value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from truegauge.llm.common import let, spare

ROUNDS = 8
#: For tests and the queries; a caller passes a secret of their own.
DEMO_KEY = "truegauge-demo-key"

_B, _A = r"(?<![A-Za-z0-9])", r"(?![A-Za-z0-9])"
_NAME = r"[A-Za-z0-9._%+\-\x{80}-\x{10FFFF}]"
KINDS = {
    "email": rf"(?<!{_NAME}){_NAME}{{1,64}}+@(?:[A-Za-z0-9-]{{1,63}}\.){{1,8}}[A-Za-z]{{2,24}}(?![A-Za-z0-9-])",
    "ip": rf"(?<![A-Za-z0-9.])[0-9]{{1,3}}(?:\.[0-9]{{1,3}}){{3}}(?!\.?[A-Za-z0-9])",
    "date": rf"{_B}(?:[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{2}}[./][0-9]{{2}}[./][0-9]{{4}}){_A}",
    "ssn": rf"{_B}[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{_A}",
    "card": rf"{_B}(?:[0-9]{{13,19}}|[0-9]{{4}}(?:[ -][0-9]{{4}}){{3}}|[0-9]{{4}}[ -][0-9]{{6}}[ -][0-9]{{5}}){_A}",
    "phone": (rf"(?<![A-Za-z0-9])(?:\+[0-9]{{1,3}}[ .-]?)?(?:\([0-9]{{3}}\)[ .-]?|[0-9]{{3}}[.-])"
              rf"[0-9]{{3}}[ .-][0-9]{{4}}{_A}"),
}
PATTERN = "|".join(KINDS.values())
#: Days from 1900-01-01 that dates are permuted in: the product of the two halves' sizes.
DAY_SIZES = (270, 271)
_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, b: a + b)


def feistel(symbols: Column, sizes: Column, key: str, kind: Column | str) -> Column:
    """Permute symbols, each below its size, keyed; both are array<int> of one length.

    Rounds take turns: one half is shifted, symbol by symbol modulo its size, by a hash of
    the key, the round and the other half. Every shift can be undone, so this is a bijection.
    """
    tag = F.lit(kind) if isinstance(kind, str) else kind

    def network(x: Column, s: Column) -> Column:
        half = F.floor(F.size(x) / 2).cast("int")

        def round_(state: Column, i: Column) -> Column:
            left = i % 2 == 0
            fixed = F.filter(state, lambda _, j: (j >= half) == left)
            digest = F.sha2(F.concat_ws("|", F.lit(key), tag, i.cast("string"), F.array_join(s, ","),
                                        F.array_join(fixed, ",")), 512)
            return let(digest, lambda d: F.transform(state, lambda v, j: F.when(
                (j < half) == left, F.pmod(v + F.conv(F.substring(
                    d, (j % 32) * 4 + 1, F.lit(4)), 16, 10).cast("int") + F.floor(j / 32).cast("int"),
                    F.get(s, j))).otherwise(v)))

        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), x, round_)

    return let(symbols, lambda x: let(sizes, lambda s: network(x, s)))


def _digits(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit("[0-9]"), F.lit(0)), lambda d: d.cast("int"))


def _refill(text: Column, digits: Column) -> Column:
    """``text`` with its digits replaced, in order."""
    return let(F.split(text, "[0-9]", -1), lambda gaps: let(digits, lambda d: F.array_join(F.transform(
        gaps, lambda g, i: F.concat(g, F.coalesce(F.get(d, i).cast("string"), F.lit("")))), "")))


def luhn_digit(digits: Column) -> Column:
    """The check digit that belongs behind ``digits``."""
    doubled = F.transform(digits, lambda d, i: F.when(
        (F.size(digits) - i) % 2 == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d))
    return (10 - _sum(doubled) % 10) % 10


def _card(m: Column, key: str) -> Column:
    def made(digits: Column) -> Column:
        return let(F.slice(digits, F.lit(1), F.size(digits) - 1), lambda body: F.when(
            luhn_digit(body) == F.element_at(digits, -1), let(
                feistel(body, F.transform(body, lambda _: F.lit(10)), key, "card"),
                lambda new: _refill(m, F.concat(new, F.array(luhn_digit(new)))))))
    return let(_digits(m), made)


def _phone(m: Column, key: str) -> Column:
    """All digits but the country code."""
    country = F.regexp_extract(m, r"^\+[0-9]{1,3}", 0)
    rest = F.substring(m, F.length(country) + 1, F.length(m))
    return let(rest, lambda r: F.concat(country, _refill(r, let(_digits(r), lambda d: feistel(
        d, F.transform(d, lambda _: F.lit(10)), key, "phone")))))


def _ssn(m: Column, key: str) -> Column:
    """Area 001-899 without 666, group 01-99, serial 0001-9999."""
    def made(p: Column) -> Column:
        area, group, serial = (F.get(p, i) for i in range(3))
        valid = (area.between(1, 899)) & (area != 666) & (group > 0) & (serial > 0)
        packed = F.array(F.when(area > 666, area - 2).otherwise(area - 1), group - 1, serial - 1)
        sizes = F.array(F.lit(898), F.lit(99), F.lit(9999))
        return F.when(valid, let(feistel(packed, sizes, key, "ssn"), lambda n: F.concat_ws(
            "-", F.lpad((F.when(F.get(n, 0) >= 665, F.get(n, 0) + 2).otherwise(F.get(n, 0) + 1))
                        .cast("string"), 3, "0"),
            F.lpad((F.get(n, 1) + 1).cast("string"), 2, "0"),
            F.lpad((F.get(n, 2) + 1).cast("string"), 4, "0"))))
    return let(F.transform(F.split(m, "-"), lambda x: x.cast("int")), made)


def _ip(m: Column, key: str) -> Column:
    """Each octet among those of as many digits: 0-9, 10-99 or 100-255."""
    def made(parts: Column) -> Column:
        least = lambda x: F.when(F.length(x) == 1, 0).when(F.length(x) == 2, 10).otherwise(100)
        size = lambda x: F.when(F.length(x) == 1, 10).when(F.length(x) == 2, 90).otherwise(156)
        number = lambda x: x.cast("int")
        valid = F.forall(parts, lambda x: (number(x) <= 255) & (number(x) >= least(x)))
        return F.when(valid, let(feistel(F.transform(parts, lambda x: number(x) - least(x)),
                                         F.transform(parts, size), key, "ip"),
                                 lambda new: F.array_join(F.transform(new, lambda v, i: (
                                     v + least(F.get(parts, i))).cast("string")), ".")))
    return let(F.split(m, r"\."), made)


def _date(m: Column, key: str) -> Column:
    """A calendar day from 1900-01-01 on, written the same way; days are read before months."""
    iso = F.contains(m, F.lit("-"))
    mark = F.substring(m, 3, 1)
    day = F.coalesce(F.when(iso, F.try_to_date(m, "yyyy-MM-dd")).otherwise(F.coalesce(
        F.try_to_date(F.translate(m, ".", "/"), "dd/MM/yyyy"),
        F.try_to_date(F.translate(m, ".", "/"), "MM/dd/yyyy"))), F.lit(None).cast("date"))
    number = F.date_diff(day, F.lit("1900-01-01").cast("date"))
    a, b = DAY_SIZES

    def made(n: Column) -> Column:
        new = feistel(F.array(F.floor(n / b).cast("int"), (n % b).cast("int")),
                      F.array(F.lit(a), F.lit(b)), key, "date")
        moved = let(new, lambda x: F.date_add(F.lit("1900-01-01").cast("date"),
                                              F.get(x, 0) * b + F.get(x, 1)))
        monthly = F.try_to_date(F.translate(m, ".", "/"), "dd/MM/yyyy").isNull()
        return F.when((n >= 0) & (n < a * b), let(moved, lambda d: F.when(
            iso, F.date_format(d, "yyyy-MM-dd")).when(monthly, F.date_format(d, "MM/dd/yyyy"))
            .otherwise(F.date_format(d, "dd/MM/yyyy"))))

    return let(let(number, made), lambda new: F.when(iso | (mark == "/"), new).otherwise(
        F.replace(new, F.lit("/"), F.lit("."))))


def _email(m: Column, key: str) -> Column:
    """The name's ASCII letters and digits, each in its class; other characters stay in place."""
    def made(chars: Column) -> Column:
        small, large = F.lit(_LETTERS), F.lit(_LETTERS.upper())
        digit = lambda c: c.rlike("[0-9]")
        lower = lambda c: c.rlike("[a-z]")
        upper = lambda c: c.rlike("[A-Z]")
        value = lambda c: F.when(digit(c), F.ascii(c) - 48).when(lower(c), F.ascii(c) - 97).when(
            upper(c), F.ascii(c) - 65).otherwise(0)
        size = lambda c: F.when(digit(c), 10).when(lower(c) | upper(c), 26).otherwise(1)
        # What has no class stays in place and takes part as a constant of the tweak.
        tweak = F.concat(F.lit("email:"), F.array_join(F.transform(chars, lambda c: F.when(
            size(c) == 1, c).otherwise("")), ""))
        new = feistel(F.transform(chars, value), F.transform(chars, size), key, tweak)
        return let(new, lambda x: F.array_join(F.transform(chars, lambda c, i: F.when(
            digit(c), F.get(x, i).cast("string")).when(lower(c), F.substring(
                small, F.get(x, i) + 1, F.lit(1))).when(upper(c), F.substring(
                    large, F.get(x, i) + 1, F.lit(1))).otherwise(c)), ""))
    return let(F.split(m, "@"), lambda p: F.concat_ws(
        "@", let(F.regexp_extract_all(F.get(p, F.lit(0)), F.lit(r"(?s)."), F.lit(0)), made), F.get(p, F.lit(1))))


def kind_of(m: Column) -> Column:
    return (F.when(F.contains(m, F.lit("@")), "email")
            .when(m.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), "ip")
            .when(m.rlike(r"^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})$"), "date")
            .when(m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
            .when(m.rlike(r"^\+|\(|^[0-9]{3}[.-]"), "phone").otherwise("card"))


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of a match, null where the value fails its check."""
    kind = kind_of(m)
    return (F.when(kind == "email", _email(m, key)).when(kind == "ip", _ip(m, key))
            .when(kind == "date", _date(m, key)).when(kind == "ssn", _ssn(m, key))
            .when(kind == "phone", _phone(m, key)).otherwise(_card(m, key)))


def with_pseudonyms(docs: DataFrame, text: str = "text", key: str = DEMO_KEY,
                    found: str | None = None) -> DataFrame:
    """``docs`` with pseudonyms in ``text``; ``found`` names a column for what was replaced.

    ``found``: array<struct<kind, pseudonym>> in the order of the text.
    """
    value, each = F.col(text), spare(docs, f"{found or ''}_made")
    kind = "array<struct<kind:string,value:string,pseudonym:string>>"
    # A text without a digit or an at sign has nothing to look for.
    matches = F.when(value.rlike("[0-9@]"), F.regexp_extract_all(value, F.lit(PATTERN), F.lit(0)))
    made = F.transform(matches, lambda m: F.struct(
        kind_of(m).alias("kind"), m.alias("value"), pseudonym(m, key).alias("pseudonym")))
    rebuilt = F.when(F.size(each) > 0, let(F.split(value, PATTERN, -1), lambda gaps: F.array_join(
        F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(
            F.get(F.col(each), i)["pseudonym"], F.get(F.col(each), i)["value"], F.lit("")))),
        ""))).otherwise(value)
    out = docs.withColumn(each, F.coalesce(made, F.array().cast(kind))).withColumn(
        text, rebuilt)
    if found is not None:
        out = out.withColumn(found, F.transform(
            F.filter(each, lambda x: x["pseudonym"].isNotNull()),
            lambda x: F.struct(x["kind"].alias("kind"), x["pseudonym"].alias("pseudonym"))))
    return out.drop(each)
