"""Text columns: lengths as UTF-16, scores, plurals, ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A name in capitals; a single character doesn't count.
SCREAMING = r"^[A-Z_][A-Z0-9_]*$"


def units(text: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def fixed4(score: Column) -> Column:
    """Four decimals of the double's exact value, ties away from zero, in Catalyst's own arithmetic.

    The fraction f is split in two halves of 26 bits, whose products with 20,000 are exact, so
    that 20,000 f can be held against the odd number 2 n + 1 between two results without rounding.
    """
    size = F.abs(score)
    whole = F.floor(size)
    f = size - whole
    far = f * 134_217_729.0  # 2^27 + 1
    high = far - (far - f)
    low = f - high
    n = F.floor(f * 10_000.0)
    over = (high * 20_000.0 - (n * 2 + 1)) + low * 20_000.0 >= 0
    n = n + over.cast("int")
    text = F.concat((whole + (n >= 10_000).cast("int")).cast("string"), F.lit("."), F.lpad((n % 10_000).cast("string"), 4, "0"))
    exact = F.concat(F.when(score < 0, "-").otherwise(""), text)
    return F.when(size < 9e15, exact).when(score.isNotNull(), F.format_string("%.4f", score))


def printed12(x: Column) -> Column:
    """Twelve decimals of the double's exact value, ties to even, as C's ``printf("%.12f")`` gives them.

    Java's formatter rounds the shortest text that names the double instead, which is another
    number where doubles lie further apart than the decimals asked for. The fraction
    is cut into pieces of 26 bits; multiplied by a million twice, they carry out six digits each time, and
    what is left is held against a half. A zero has no sign; from 9e15 on it is Java's text.
    """
    bits, mask = float(1 << 26), (1 << 26) - 1
    size = F.when(F.abs(x) < 9e15, F.abs(x))
    whole = F.floor(size)
    left, limbs = size - whole, []
    for _ in range(3):
        left = left * bits
        limbs.append(F.floor(left))
        left = left - limbs[-1]
    digits = []
    for _ in range(2):
        carry = F.lit(0).cast("long")
        for k in (2, 1, 0):
            made = limbs[k] * 1_000_000 + carry
            limbs[k], carry = made.bitwiseAND(mask), F.shiftright(made, 26)
        digits.append(carry)
    n = digits[0] * 1_000_000 + digits[1]
    beyond = (limbs[1] + limbs[2] + digits[1] % 2 > 0) | (left > 0)
    n = n + ((limbs[0] > 1 << 25) | (limbs[0] == 1 << 25) & beyond).cast("int")
    text = F.concat((whole + (n >= 10**12).cast("int")).cast("string"), F.lit("."), F.lpad((n % 10**12).cast("string"), 12, "0"))
    exact = F.concat(F.when(x < 0, "-").otherwise(""), text)
    return F.coalesce(exact, F.when(x.isNotNull(), F.format_string("%.12f", x)))


def screaming(name: Column) -> Column:
    return name.rlike(SCREAMING) & (F.length(name) > 1)


def plural(n: int, one: str, many: str) -> str:
    return f"{n} {one if n == 1 else many}"


def age(seconds: float) -> str:
    """How long ago, in words."""
    if (s := int(seconds)) < 60:
        return f"{s} seconds ago"
    for size, limit, unit in ((60, 60, "minute"), (3600, 24, "hour"), (86400, None, "day")):
        n = s // size
        if limit is None or n < limit:
            return f"{plural(n, unit, unit + 's')} ago"
    raise AssertionError


def ago(seconds: Column) -> Column:
    """``age`` of a column; null where it is."""
    s = seconds.cast("long")

    def some(size: int, unit: str) -> Column:
        n = F.floor(s / size).cast("string")
        return F.concat(n, F.lit(f" {unit}"), F.when(n == "1", "").otherwise("s"), F.lit(" ago"))

    return F.when(s < 60, F.concat(s.cast("string"), F.lit(" seconds ago"))).when(s < 3600, some(60, "minute")).when(s < 86400, some(3600, "hour")).when(s.isNotNull(), some(86400, "day"))


def package_names(manifest: Column) -> Column:
    """Names of the dependencies in the text of a package.json, then of those for development; null if it can't be read (SRC-14)."""
    of = lambda key: F.coalesce(F.json_object_keys(F.get_json_object(manifest, f"$.{key}")), F.array().cast("array<string>"))
    return F.when(F.json_object_keys(manifest).isNotNull(), F.concat(of("dependencies"), of("devDependencies")))
