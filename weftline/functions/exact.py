"""Exact tests of counts as Columns: hypergeometric (2 x 2 tables) and binomial tails.

Both walk away from the most likely count by the ratio of neighbouring probabilities, and divide what a tail sums up by the sum of all. No
factorial is formed, so counts of millions lose no digits. The walk ends ``REACH`` standard deviations (and ``REACH`` counts) away,
where what is left is below the least number that a double can tell from nothing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REACH = 40
#: Probabilities within this share of each other are equal.
TIE = 1e-7


def _walk(steps: Column, ratio, seen: Column, at) -> Column:
    """(all, tail, even): sums of the probabilities of the next ``steps`` counts, as multiples of the most likely one's: all, from ``seen`` on outwards, and no likelier than ``seen``'s."""

    def add(acc: Column, k: Column) -> Column:
        p = acc["p"] * ratio(k)
        return F.struct(p.alias("p"), (acc["all"] + p).alias("all"), (acc["tail"] + F.when(at(k), p).otherwise(F.lit(0.0))).alias("tail"), (acc["even"] + F.when(p <= seen * (1 + TIE), p).otherwise(F.lit(0.0))).alias("even"))

    start = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("all"), F.lit(0.0).alias("tail"), F.lit(0.0).alias("even"))
    return F.when(steps > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), steps), start, add)).otherwise(start)


def _chance(steps: Column, ratio) -> Column:
    """The probability ``steps`` counts away, as a multiple of the most likely one's."""
    return F.when(steps > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), steps), F.lit(1.0), lambda p, k: p * ratio(k))).otherwise(F.lit(1.0))


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _tails(x: Column, lo: Column, hi: Column, mode: Column, sd: Column, up, down) -> Column:
    """Struct (less, greater, two_sided) for a count ``x`` in [lo, hi]; ``up(m, k)`` is the ratio of the probabilities of m + k and m + k - 1, ``down(m, k)`` of m - k and m - k + 1."""

    def result(v: Column) -> Column:
        x, lo, hi, m = v["x"], v["lo"], v["hi"], v["mode"]
        reach = F.ceil(v["sd"] * REACH).cast("long") + REACH
        above, below = F.least(hi - m, reach), F.least(m - lo, reach)

        def sums(seen: Column) -> Column:
            parts = F.struct(_walk(above, lambda k: up(v, m, k), seen, lambda k: m + k >= x).alias("u"), _walk(below, lambda k: down(v, m, k), seen, lambda k: m - k <= x).alias("d"))

            def shares(s: Column) -> Column:
                total = 1 + s["u"]["all"] + s["d"]["all"]
                greater = F.when(x > m, s["u"]["tail"]).otherwise(total - F.when(x > lo, _below(s)).otherwise(F.lit(0.0)))
                less = F.when(x < m, s["d"]["tail"]).otherwise(total - F.when(x < hi, _above(s)).otherwise(F.lit(0.0)))
                even = s["u"]["even"] + s["d"]["even"] + F.when(seen * (1 + TIE) >= 1, F.lit(1.0)).otherwise(F.lit(0.0))
                one = lambda p: F.least(F.lit(1.0), F.greatest(F.lit(0.0), p / total))
                return F.struct(one(less).alias("less"), one(greater).alias("greater"), one(even).alias("two_sided"))

            def _below(s: Column) -> Column:  # counts under x, where x is at most the mode
                return s["d"]["tail"] - seen_if(x < m)

            def _above(s: Column) -> Column:
                return s["u"]["tail"] - seen_if(x > m)

            def seen_if(inside: Column) -> Column:
                return F.when(inside, seen).otherwise(F.lit(0.0))

            return _let(parts, shares)

        seen = F.when(x >= m, _chance(F.least(x - m, above + 1), lambda k: up(v, m, k))).otherwise(_chance(F.least(m - x, below + 1), lambda k: down(v, m, k)))
        return _let(seen, sums)

    return result


def fisher(a: Column, b: Column, c: Column, d: Column) -> Column:
    """(less, greater, two_sided): p-values of the table (a, b; c, d) with its margins: that the first count is at most, at least, or as unlikely as ``a``. Null and negative counts give null."""
    r, s, n = a + b, c + d, a + c
    both = r + s
    lo, hi = F.greatest(F.lit(0).cast("long"), n - s), F.least(r, n)
    # As doubles: the product of two margins of billions doesn't fit a long.
    mode = F.greatest(lo, F.least(hi, F.floor((n.cast("double") + 1) * (r.cast("double") + 1) / (both.cast("double") + 2))))
    share = F.try_divide(r.cast("double"), both)
    sd = F.coalesce(F.sqrt(n * share * (1 - share) * (both - n) / F.greatest(both - 1, F.lit(1))), F.lit(0.0))
    value = F.struct(a.cast("long").alias("x"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi"), mode.cast("long").alias("mode"), sd.alias("sd"), r.cast("double").alias("r"), s.cast("double").alias("s"), n.cast("double").alias("n"))
    up = lambda v, m, k: (v["r"] - m - k + 1) * (v["n"] - m - k + 1) / ((m + k) * (v["s"] - v["n"] + m + k))
    down = lambda v, m, k: (m - k + 1) * (v["s"] - v["n"] + m - k + 1) / ((v["r"] - m + k) * (v["n"] - m + k))
    fits = (F.least(a, b, c, d) >= 0) & a.isNotNull() & b.isNotNull() & c.isNotNull() & d.isNotNull()
    return F.when(fits, _let(value, _tails(a, lo, hi, mode, sd, up, down)))


def binomial(x: Column, n: Column, p: Column) -> Column:
    """(less, greater, two_sided): p-values of ``x`` of ``n`` at the chance ``p``. Null where a count is negative, x above n, or p not within 0 and 1."""
    p = p.cast("double")
    mode = F.greatest(F.lit(0).cast("long"), F.least(n.cast("long"), F.floor((n + 1) * p)))
    value = F.struct(x.cast("long").alias("x"), F.lit(0).cast("long").alias("lo"), n.cast("long").alias("hi"), mode.alias("mode"), F.sqrt(n * p * (1 - p)).alias("sd"), n.cast("double").alias("n"), p.alias("p"))
    up = lambda v, m, k: (v["n"] - m - k + 1) / (m + k) * v["p"] / (1 - v["p"])
    down = lambda v, m, k: (m - k + 1) / (v["n"] - m + k) * (1 - v["p"]) / v["p"]
    fits = (x >= 0) & (x <= n) & (p >= 0) & (p <= 1)
    return F.when(fits, _let(value, _tails(x, F.lit(0), n, mode, F.lit(0.0), up, down)))
