"""Number text and number tests, as column expressions.

Text of doubles is exact on their binary value, as C's printf and Python print it. What nearly every value
needs is a short compiled expression. The rest (values next to a half, very large ones, texts of sixteen
digits and more) goes through steps of its own, each computed once, in a branch that other values skip.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Below this, a scaled value and its distance from a half are exact enough to round by.
PLAIN_LIMIT, NEAR_HALF = 2.0**40, 2.0**-10
LONG_LIMIT, DECIMAL_LIMIT, LIMB = 2.0**63, 2.0**126, 1_000_000_000


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _with(body: Callable[[Column], Column], **values: Column) -> Column:
    """``body`` of a struct of values."""
    return _let(F.struct(*[v.alias(n) for n, v in values.items()]), body)


def _div(a: Column, b: Column | int) -> Column:
    """Whole quotient of whole numbers."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def _sign(x: Column) -> Column:
    """A minus for negative numbers, negative zero included."""
    return F.when((x < 0) | ((x == 0) & x.cast("string").startswith("-")), "-").otherwise("")


def _point(whole: Column, part: Column, digits: int) -> Column:
    """Whole number and number of the last decimal place as text."""
    text = whole.cast("string")
    return F.concat(text, F.lit("."), F.lpad(part.cast("string"), digits, "0")) if digits else text


def _plain(a: Column, digits: int) -> Column:
    """Text of a value below ``PLAIN_LIMIT`` that is not next to a half in its last place."""
    scaled = F.rint(a * F.lit(10.0**digits)).cast("long")
    if not digits:
        return scaled.cast("string")
    unit = F.lit(10**digits)
    return _point(_div(scaled, unit), scaled % unit, digits)


def _near_half(a: Column, digits: int) -> Column:
    """Text of a value below 2^63, rounded half-even on all of its bits.

    The fraction is cut into limbs of 26, 32 and the remaining bits. A limb times the power of ten is an
    exact double, and so is what is left of the distance to the half after each of them.
    """
    unit = 10.0**digits

    def of_fraction(v: Column) -> Column:
        high = F.floor(v["f"] * 2.0**26) / F.lit(2.0**26)
        return _with(of_limbs, i=v["i"], f=v["f"], k=F.floor(v["f"] * unit), high=high, low=v["f"] - high)

    def of_limbs(v: Column) -> Column:
        middle = F.floor(v["low"] * 2.0**58) / F.lit(2.0**58)
        left = (v["k"].cast("double") + 0.5 - v["high"] * unit) - middle * unit
        return _with(of_rest, i=v["i"], k=v["k"], over=(v["low"] - middle) * unit - left)

    def of_rest(v: Column) -> Column:
        odd = (v["k"] + F.when(F.lit(digits == 0), v["i"] % 2).otherwise(F.lit(0))) % 2 == 1
        up = (v["over"] > 0) | ((v["over"] == 0) & odd)
        return _with(of_rounded, i=v["i"], r=v["k"] + up.cast("long"))

    def of_rounded(v: Column) -> Column:
        carry = (v["r"] >= int(unit)).cast("long")
        return _point(v["i"] + carry, v["r"] - carry * int(unit), digits)

    return _let(a, lambda x: _with(of_fraction, i=F.floor(x), f=x - F.floor(x).cast("double")))


def _whole(a: Column) -> Column:
    """Text of a whole number of 2^63 or more, every digit."""

    def decimal(v: Column) -> Column:
        high, low = v["h"].cast("decimal(19,0)"), (v["a"] - v["h"].cast("double") * LONG_LIMIT).cast("long")
        return (high * F.lit(str(2**63)).cast("decimal(19,0)") + low.cast("decimal(19,0)")).cast("string")

    def limbs(v: Column) -> Column:
        """Mantissa and exponent in base 10^9, least first; doubled 29 times at a step."""
        start = F.array(v["m"] % LIMB, _div(v["m"], LIMB))
        steps = F.sequence(F.lit(0), _div(v["e"].cast("long") - 1, 29).cast("int"))

        def doubled(digits: Column, step: Column) -> Column:
            by = F.pow(F.lit(2.0), F.least(F.lit(29), v["e"].cast("int") - 29 * step)).cast("long")

            def carried(done: Column, digit: Column) -> Column:
                now = digit * by + done["carry"]
                return F.struct(F.concat(done["out"], F.array(now % LIMB)).alias("out"), _div(now, LIMB).alias("carry"))

            zero = F.struct(F.array().cast("array<bigint>").alias("out"), F.lit(0).cast("long").alias("carry"))
            return _let(F.aggregate(digits, zero, carried), lambda d: F.concat(d["out"], F.array(d["carry"])))

        whole = F.aggregate(steps, start, doubled)
        text = F.array_join(F.transform(F.reverse(whole), lambda d: F.lpad(d.cast("string"), 9, "0")), "")
        return F.regexp_replace(text, "^0+", "")

    exponent = F.greatest(F.floor(F.log2(a)) - 52, F.lit(0))
    return F.when(
        a < DECIMAL_LIMIT, _let(a, lambda x: _with(decimal, a=x, h=F.floor(x / LONG_LIMIT)))
    ).otherwise(_let(a, lambda x: _with(lambda v: _with(limbs, e=v["e"], m=(v["x"] / F.pow(F.lit(2.0), v["e"])).cast("long")), x=x, e=exponent)))


def fmt_fixed(x: Column, digits: int, null: str | None = "nan") -> Column:
    """Fixed-point text, rounded half-even on the exact binary value; up to six digits."""
    x = x.cast("double")
    a = F.abs(x)
    scaled = a * F.lit(10.0**digits)
    plain = (scaled < PLAIN_LIMIT) & (F.abs(scaled - F.floor(scaled) - 0.5) > NEAR_HALF)
    large = F.concat(_whole(a), F.lit("." + "0" * digits if digits else ""))
    text = F.when(plain, _plain(a, digits)).when(a < LONG_LIMIT, _near_half(a, digits)).when(a < float("inf"), large).otherwise("inf")
    missing = F.lit(null).cast("string")
    nan = missing if null is not None else F.lit("nan")
    return F.when(x.isNull(), missing).when(F.isnan(x), nan).otherwise(F.concat(_sign(x), text))


def fmt_pct(x: Column, digits: int = 1) -> Column:
    """``0.125`` -> ``12.5%``."""
    return F.concat(fmt_fixed(x.cast("double") * 100.0, digits), F.lit("%"))


def percent_label(x: Column) -> Column:
    """Whole percentages without decimals, others with one."""
    near = F.abs(x - F.bround(x, 0)) <= 1e-8 + 1e-5 * F.abs(F.bround(x, 0))
    return F.concat(F.when(near, fmt_fixed(x, 0)).otherwise(fmt_fixed(x, 1)), F.lit("%"))


def fmt_thousands(x: Column) -> Column:
    """``1234.5`` -> ``1,234`` (half-even); NULL stays NULL."""
    return F.regexp_replace(fmt_fixed(x, 0, None), r"(?<=\d)(?=(\d{3})+$)", ",")


def _whole_text(a: Column) -> Column:
    """Text of a whole number, every digit."""
    return F.when(a < LONG_LIMIT, a.cast("long").cast("string")).otherwise(_whole(a))


def _shortest(a: Column) -> Column:
    """Fewest digits that read back as the same number, with Python's choice between plain and exponent."""

    def parts(text: Column) -> Column:
        body = F.substring_index(text, "E", 1)
        whole = F.substring_index(body, ".", 1)
        power = F.when(F.contains(text, F.lit("E")), F.substring_index(text, "E", -1).cast("int")).otherwise(0)
        return _with(stripped, all=F.concat(whole, F.substring_index(body, ".", -1)), at=F.length(whole) + power)

    def stripped(v: Column) -> Column:
        lead = F.regexp_replace(v["all"], "^0+", "")
        return _with(shortened, d=F.regexp_replace(v["all"], "^0+|0+$", ""), at=v["at"] - F.length(v["all"]) + F.length(lead))

    def shortened(v: Column) -> Column:
        """Java may print more digits than needed, two at least; whole numbers are taken with their own first digits then."""
        own = F.struct(v["d"].alias("d"), v["at"].alias("at"))
        whole = _let(_whole_text(a), lambda t: F.struct(F.substr(t, F.lit(1), F.lit(18)).alias("d"), F.length(t).alias("at"), own.alias("own")))
        read = F.struct(v["d"].alias("d"), v["at"].alias("at"), own.alias("own"))
        enough = (F.length(v["d"]) < 16) & (a > 1e-300)
        return _let(F.when(enough, own).otherwise(_let(F.when(a >= 1e15, whole).otherwise(read), fewest)), written)

    def fewest(v: Column) -> Column:
        number, n = v["d"].cast("long"), F.length(v["d"])

        def less(k: int) -> Column:
            return _div(number + F.lit(5 * 10 ** (k - 1)), 10**k).cast("string")

        def same(k: int) -> Column:
            return (n > k) & (F.concat(less(k), F.lit("E"), (v["at"] - n + k).cast("string")).cast("double") == a)

        def fewer(k: int) -> Column:
            longer = F.length(less(k)) - n + k  # a carry may have added a digit
            return F.struct(F.regexp_replace(less(k), "0+$", "").alias("d"), (v["at"] + longer).alias("at"))

        return F.when(same(3), fewer(3)).when(same(2), fewer(2)).when(same(1), fewer(1)).otherwise(v["own"])

    def written(v: Column) -> Column:
        d, at, n = v["d"], v["at"], F.length(v["d"])
        zeros = lambda k: F.repeat(F.lit("0"), k)
        power = F.lpad(F.abs(at - 1).cast("string"), 2, "0")
        power = F.when(F.abs(at - 1) < 100, power).otherwise(F.abs(at - 1).cast("string"))
        rest = F.when(n > 1, F.concat(F.lit("."), F.substr(d, F.lit(2)))).otherwise("")
        exponent = F.concat(F.substr(d, F.lit(1), F.lit(1)), rest, F.when(at > 0, "e+").otherwise("e-"), power)
        return (
            F.when((at <= -4) | (at > 16), exponent)
            .when(at <= 0, F.concat(F.lit("0."), zeros(-at), d))
            .when(n <= at, F.concat(d, zeros(at - n), F.lit(".0")))
            .otherwise(F.concat(F.substr(d, F.lit(1), at), F.lit("."), F.substr(d, at + 1)))
        )

    return _let(a.cast("string"), parts)


def py_str(x: Column) -> Column:
    """Shortest decimal text of a double; an exponent only below 1e-4 or from 1e16 on. NULL stays NULL."""
    x = x.cast("double")
    a, text = F.abs(x), x.cast("string")
    plain = (a >= 1e-3) & (a < 1e7) & (F.length(text) <= 16)
    odd = F.when(F.isnan(x), "nan").when(a == float("inf"), F.concat(_sign(x), F.lit("inf"))).when(a == 0, F.concat(_sign(x), F.lit("0.0")))
    return F.when(x.isNull(), F.lit(None).cast("string")).when(plain, text).otherwise(odd.otherwise(F.concat(_sign(x), _shortest(a))))


def parse_number(s: Column) -> Column:
    """Text to double: thousands commas dropped, blank or unreadable text gives NULL."""
    text = F.replace(trim_all(s.cast("string")), F.lit(","), F.lit(""))
    return F.when(text != "", text.try_cast("double"))


def is_close(a: Column, b: Column, rel: float = 1e-9, absolute: float = 1e-6) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(rel) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))


def bin_index(x: Column, edges: list[float]) -> Column:
    """Right-closed bins over ascending edges, counted from 0; the lowest edge belongs to bin 0."""
    inner = edges[1:-1]
    k = F.lit(0)
    for e in inner:
        k = k + (x > F.lit(float(e))).cast("int")
    inside = (x >= F.lit(float(edges[0]))) & (x <= F.lit(float(edges[-1])))
    return F.when(inside, k)


def coerce_01(x: Column) -> Column:
    """0/1 from booleans, numbers within 1e-12 and the texts 0, 0.0, 1, 1.0; anything else NULL."""
    kind = F.typeof(x)
    text = F.lower(trim_all(x.cast("string")))
    value = text.try_cast("double")
    plain = F.when(text.isin("0", "0.0"), 0).when(text.isin("1", "1.0"), 1)
    near = F.when(F.abs(value) < 1e-12, 0).when(F.abs(value - 1.0) < 1e-12, 1)
    return (
        F.when(kind == "boolean", F.when(text == "true", 1).when(text == "false", 0))
        .when(kind == "string", plain)
        .otherwise(near)
    )


def trim_all(s: Column) -> Column:
    """Trim every kind of white space, line ends included."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+\z", "")
