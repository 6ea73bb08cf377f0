"""Statistics as aggregates: ranks, correlations, inequality, fits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankloom.operators.graph import before_partition, dense_index, ranged
from rankloom.session import cut


def min_max(df: DataFrame, columns: dict[str, str], constant: float) -> DataFrame:
    """Add each column scaled to 0..1 over all rows under a new name; `constant` where all values are equal.

    The bounds are one aggregate row, joined to all, so no task sees the whole table.
    """
    bounds = df.agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    out = df.crossJoin(F.broadcast(bounds))
    for c, name in columns.items():
        lo, hi = F.col(f"__lo_{c}"), F.col(f"__hi_{c}")
        out = out.withColumn(name, F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(F.lit(float(constant))))
    return out.drop(*bounds.columns)


def correlation(a: str, b: str) -> Column:
    """Pearson's correlation; null where a column is constant."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def rank_table(df: DataFrame, column: str, name: str) -> DataFrame:
    """The average rank of each value of a column, from the counts of distinct values rather than a sort of all rows."""
    rows = ranged(df.groupBy(column).agg(F.count("*").alias("__c")), [column])
    first = before_partition(rows, F.sum("__c"), "__first")
    inside = F.sum("__c").over(Window.partitionBy("__p").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("__to", inside).join(first, "__p").select(column, (F.col("__first") + F.col("__to") - (F.col("__c") - 1) / 2.0).alias(name))


def with_average_ranks(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Add the average ranks of several columns; the table is cut first, as each is ranked on its own."""
    base = cut(df)
    out = base
    for column, name in names.items():
        out = out.join(rank_table(base, column, name), column)
    return out


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Row (n, rho): Pearson's correlation of the average ranks."""
    ranked = with_average_ranks(df.select(a, b), {a: "__ra", b: "__rb"})
    return ranked.agg(F.count("*").alias("n"), correlation("__ra", "__rb").alias("rho"))


def inversions(pos: DataFrame, n: int) -> int:
    """Pairs of opposite order in a permutation (x, y) of 0..n-1.

    Two values of y part at one bit: above it they agree, there one has 1 and the other 0. So for every bit the rows
    fall into groups of equal upper bits, and a pair is an inversion where a 1 stands before a 0 in the order of x. All
    bits are counted in one pass over n log n rows; large groups are cut into cells of about sqrt(n) along x, counted
    each, and only cells are accumulated, so no task sees a whole group.
    """
    bits = max(1, (n - 1).bit_length())
    half = (bits + 1) // 2
    rows = pos.select("x", "y", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("bit"))
    rows = rows.select(
        "x", "bit", F.expr("shiftright(y, bit + 1)").alias("g"), F.expr("shiftright(y, bit) & 1").alias("one"), F.when(F.col("bit") < half, F.lit(0).cast("long")).otherwise(F.shiftright("x", half)).alias("cell")
    )
    upto = lambda keys, by: Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("one").over(upto(["bit", "g", "cell"], "x")), F.lit(0)))
    zero = F.col("one") == 0
    cells = rows.groupBy("bit", "g", "cell").agg(F.sum("one").alias("ones"), F.sum(zero.cast("long")).alias("zeros"), F.sum(F.when(zero, F.col("before")).otherwise(0)).alias("inside"))
    before = F.coalesce(F.sum("ones").over(upto(["bit", "g"], "cell")), F.lit(0))
    return int(cells.withColumn("k", F.col("inside") + F.col("zeros") * before).agg(F.sum(F.col("k").cast("decimal(38,0)"))).first()[0] or 0)


def tie_sums(df: DataFrame, *columns: str) -> tuple[int, int, int]:
    """Over groups of t rows with equal values: sums of t (t - 1) / 2, t (t - 1) (t - 2) and t (t - 1) (2 t + 5)."""
    t = F.col("t").cast("decimal(38,0)")
    forms = [t * (t - 1) / 2, t * (t - 1) * (t - 2), t * (t - 1) * (2 * t + 5)]
    got = df.groupBy(*columns).agg(F.count("*").alias("t")).where("t > 1").agg(*[F.sum(f.cast("decimal(38,0)")) for f in forms]).first()
    return tuple(int(x or 0) for x in got)


def kendall(df: DataFrame, a: str, b: str) -> DataFrame:
    """Row (n, tau, p): Kendall's tau-b of two columns and its two-sided p-value; rows with a null are left out.

    Ties are taken out of both sides as tau-b does; without ties it is 1 - 4 inversions / (n (n - 1)). tau is null for
    fewer than two rows or a constant column.
    """
    rows = cut(df.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null"))
    n = rows.count()
    tau = p = None
    if n > 1:
        # Pairs that tie in one column stand in the order of the other, so none of them counts as an inversion.
        pos = dense_index(dense_index(rows, ["a", "b"], "x"), ["b", "a"], "y").select("x", "y")
        against, ta, tb, both = inversions(cut(pos), n), tie_sums(rows, "a"), tie_sums(rows, "b"), tie_sums(rows, "a", "b")
        pairs = n * (n - 1) // 2
        score = pairs - ta[0] - tb[0] + both[0] - 2 * against
        if pairs > ta[0] and pairs > tb[0]:
            tau = score / math.sqrt(pairs - ta[0]) / math.sqrt(pairs - tb[0])
            tau = max(-1.0, min(1.0, tau))
            p = kendall_p(n, score, against, ta, tb)
    return df.sparkSession.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(tau).cast("double").alias("tau"), F.lit(p).cast("double").alias("p"))


def pearson_p(spark, r: float, n: int) -> float | None:
    """Two-sided p-value of a correlation, by Student's t with n - 2 degrees of freedom."""
    if n < 3 or r is None:
        return None
    if abs(r) >= 1:
        return 0.0
    t = abs(r) * math.sqrt((n - 2) / (1 - r * r))
    dist = spark.sparkContext._jvm.org.apache.commons.math3.distribution.TDistribution(float(n - 2))
    return 2 * (1 - dist.cumulativeProbability(t))


def kendall_p(n: int, score: int, against: int, ta: tuple[int, int, int], tb: tuple[int, int, int]) -> float:
    """Two-sided p-value of concordant minus discordant pairs.

    Exact, from the numbers of permutations with so many inversions, for up to 33 rows or at most one inversion from
    either end, both without ties; else normal with the variance corrected for ties.
    """
    pairs = n * (n - 1) // 2
    few = min(against, pairs - against)
    if not ta[0] and not tb[0] and (n <= 33 or few <= 1):
        if few == 0:
            return min(1.0, 2 / math.factorial(n)) if n < 171 else 0.0
        if few == 1:
            return min(1.0, 2 / math.factorial(n - 1)) if n < 171 else 0.0
        if 2 * few == pairs:
            return 1.0
        ways = [1] + [0] * few
        for k in range(2, n + 1):
            sums = [0]
            for w in ways:
                sums.append(sums[-1] + w)
            ways = [sums[i + 1] - sums[max(0, i + 1 - k)] for i in range(few + 1)]
        return min(1.0, 2 * sum(ways) / math.factorial(n))
    m = n * (n - 1)
    spread = (m * (2 * n + 5) - ta[2] - tb[2]) / 18 + 2 * ta[0] * tb[0] / m
    if n > 2:
        spread += ta[1] * tb[1] / (9 * m * (n - 2))
    return math.erfc(abs(score) / math.sqrt(spread) / math.sqrt(2))


def entropy(score: Column) -> Column:
    return -F.sum(F.when(score > 0, score * F.ln(score)))


def gini(df: DataFrame, column: str, epsilon: float = 0.0, name: str = "gini") -> DataFrame:
    """Row with the Gini coefficient of a column's absolute values plus epsilon."""
    values = df.select((F.abs(F.col(column)) + epsilon).alias("v"))
    ranked = with_average_ranks(values, {"v": "i"})  # ties take their mean rank, which leaves the sum as it is
    n, s = F.count("*"), F.sum("v")
    return ranked.agg((2 * F.sum(F.col("i") * F.col("v")) / (n * s) - (n + 1) / n).alias(name))


def dcg(gain: Column, position: Column) -> Column:
    return F.sum(gain / F.log2(position + 1.0))
