"""Numbers as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shortest(x: Column) -> Column:
    """The shortest decimal that reads as this double, as Python writes it: with an exponent below 1e-4 and from 1e16 on.

    Java's own text, of 17 digits at most, may have a digit or two more than needed: fewer are taken where they read as the
    same number. Of large whole numbers it may not be the nearest: their value is taken apart exactly instead.
    """
    x = x.cast("double")
    size = F.abs(x)
    parts = F.split(size.cast("string"), "E")  # such as 1.25E-7
    whole = F.split(F.element_at(parts, 1), r"\.")
    power = F.when(F.size(parts) > 1, F.element_at(parts, -1).try_cast("int")).otherwise(0) + F.length(F.element_at(whole, 1))
    plain = F.concat(F.element_at(whole, 1), F.element_at(whole, -1))
    lead = F.length(plain) - F.length(F.ltrim(plain, F.lit("0")))
    # digits d and point p: the number is 0.d times ten to the p
    made = F.struct(F.rtrim(F.ltrim(plain, F.lit("0")), F.lit("0")).alias("d"), (power - lead).alias("p"), size.alias("x"))

    def fewer(n: Column, drop: int) -> Column:
        """The digits without the last `drop`, rounded, if they still read as the number."""
        kept = F.round(n["d"].try_cast("decimal(20,0)") / F.lit(10**drop).cast("decimal(10,0)"), 0).cast("decimal(20,0)").cast("string")
        same = F.concat(kept, F.lit("E"), (n["p"] - F.length(n["d"]) + drop).cast("string")).try_cast("double") == n["x"]
        grown = F.length(kept) - (F.length(n["d"]) - drop)  # 99.6 becomes 100
        return F.when((F.length(n["d"]) > drop) & same, F.struct(F.rtrim(kept, F.lit("0")).alias("d"), (n["p"] + grown).alias("p")))

    def nearest(n: Column) -> Column:
        """Of a whole number between 2^53 and 1e30, the nearest decimal of so many digits, or of up to three less where those read as the number."""
        high = F.floor(n["x"] / F.lit(2.0**48))
        whole = high.cast("decimal(38,0)") * F.lit(2**48).cast("decimal(15,0)") + (n["x"] - high.cast("double") * F.lit(2.0**48)).cast("bigint").cast("decimal(15,0)")
        exact = whole.cast("decimal(38,0)").cast("string")

        def of(k: Column) -> Column:
            head, rest = F.left(exact, k), F.substring(exact, k + 1, F.length(exact))
            up = (head.try_cast("decimal(20,0)") + 1).cast("decimal(20,0)").cast("string")
            reads = lambda c: F.concat(c, F.lit("E"), F.length(rest).cast("string")).try_cast("double") == n["x"]
            over = (rest >= "5") & (rest != F.rpad(F.lit("5"), F.length(rest), F.lit("0")))  # of one length: in order of the digits
            best = F.when(reads(head) & ~(over & reads(up)), head).when(reads(up), up)
            return F.when(best.isNotNull(), F.struct(F.rtrim(best, F.lit("0")).alias("d"), (F.length(best) + F.length(rest)).alias("p")))

        return F.coalesce(*(F.when(F.length(n["d"]) > less, of(F.length(n["d"]) - less)) for less in (3, 2, 1, 0)), F.struct(n["d"], n["p"]))

    def written(n: Column) -> Column:
        d, p, k = n["d"], n["p"], F.length(n["d"])
        scientific = F.concat(F.left(d, F.lit(1)), F.when(k > 1, F.concat(F.lit("."), F.substring(d, F.lit(2), k))).otherwise(""), F.lit("e"), F.when(p < 1, "-").otherwise("+"), F.lpad(F.abs(p - 1).cast("string"), F.greatest(F.lit(2), F.length(F.abs(p - 1).cast("string"))), F.lit("0")))
        below = F.concat(F.lit("0."), F.repeat(F.lit("0"), -p), d)
        between = F.when(p >= k, F.concat(d, F.repeat(F.lit("0"), p - k), F.lit(".0"))).otherwise(F.concat(F.left(d, p), F.lit("."), F.substring(d, p + 1, k)))
        return F.when((p < -3) | (p > 16), scientific).when(p <= 0, below).otherwise(between)

    # each step is a value of its own, so that it is computed once
    first = F.transform(F.array(made), lambda n: F.when((n["x"] > 2.0**53) & (n["x"] < 1e30) & (F.length(n["d"]) > 1), nearest(n)).otherwise(F.coalesce(fewer(n, 3), fewer(n, 2), fewer(n, 1), F.struct(n["d"], n["p"]))))
    text = F.element_at(F.transform(first, written), 1)
    sign = F.when(F.startswith(x.cast("string"), F.lit("-")), "-").otherwise("")
    return F.when(F.isnan(x), "nan").when(size == float("inf"), F.concat(sign, F.lit("inf"))).when(x == 0, F.concat(sign, F.lit("0.0"))).when(x.isNotNull(), F.concat(sign, text))
