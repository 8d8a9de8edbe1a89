"""Names that a few edits set apart, without comparing all with all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtide.functions import keys


def edit_pairs(names: DataFrame, column: str = "name") -> DataFrame:
    """(a, b, budget): pairs a < b of distinct names at most keys.typo_budget() edits apart.

    The longer name of a pair, of n characters with a budget of k, is cut into k + 1 segments.  k edits
    leave one of them whole, so the other name, which is at most k shorter, holds it at most k places
    away: pairs meet on (n, segment's number, segment), and only those that do are compared.
    """
    rows = names.select(F.col(column).alias("name")).filter("name IS NOT NULL").distinct().withColumn("n", F.length("name"))
    budget = lambda n: f"greatest(1, {n} div 10)"
    begin = lambda i, n: f"(({i}) * {n} div ({budget(n)} + 1))"
    segments = rows.selectExpr("name AS x", "n", f"posexplode(transform(sequence(0, {budget('n')}), i -> substring(name, int({begin('i', 'n')}) + 1, int({begin('i + 1', 'n')} - {begin('i', 'n')})))) AS (i, segment)")
    # Lengths m of the longer name: at most its own budget above n.
    longer = rows.selectExpr("name AS y", "n", "explode(sequence(n, n + greatest(1, (n + n div 9 + 1) div 10))) AS m").filter(f"m - n <= {budget('m')}")
    placed = longer.selectExpr("y", "n", "m", f"explode(sequence(0, {budget('m')})) AS i").selectExpr("y", "n", "m", "i", f"int({begin('i', 'm')}) AS p", f"int({begin('i + 1', 'm')} - {begin('i', 'm')}) AS size", f"{budget('m')} AS k")
    held = placed.filter("least(p + k, n - size) >= greatest(0, p - k)").selectExpr("y", "m", "i", "explode(transform(sequence(int(greatest(0, p - k)), int(least(p + k, n - size))), at -> substring(y, at + 1, size))) AS segment").distinct()
    met = segments.join(held.withColumnRenamed("m", "n"), ["n", "i", "segment"]).filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    limit = keys.typo_budget(F.col("a"), F.col("b"))
    return met.filter(keys.within_edits(F.col("a"), F.col("b"), limit)).select("a", "b", limit.alias("budget"))
