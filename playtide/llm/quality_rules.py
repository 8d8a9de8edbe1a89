"""Quality rules: a decision list learned by sequential covering, applied as a Spark expression.

Statistics of each text are built-in expressions only.  Thresholds come from the labelled rows: each
feature is cut where that tells most about the label, at midpoints between its quantiles, as long
as the cut is worth its description.  Labelled rows are then counted by cells of these cuts, so
the driver gets a table bounded by the cuts and not by the corpus (all labelled rows count, no
sample is taken).  On the cells, rules are grown one condition at a time by information gain and
pruned on held-back folds; the list is emitted as one ordered CASE expression that can be read
and audited.

Defined results: a null, empty or blank text has no words, all counts zero, and fails the base
rules; with no labelled rows no rule is learned and the base rules decide; repeated labels each
count; empty tables give no rows; columns other than the ones named are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtide.llm.common import WORD, materialise, read_table, row_key, unused

SPACES = " \t\n\x0b\x0c\r"
#: Thresholds by feature where none are learned; a condition is "feature >= t" or "feature < t".
GRID: dict[str, tuple[float, ...]] = {
    "symbols_per_word": (0.02, 0.05, 0.1, 0.2, 0.5, 1.0),
    "upper_share": (0.1, 0.2, 0.3, 0.5, 0.7),
    "repeat_share": (0.1, 0.2, 0.3, 0.4, 0.5),
    "dup_line_share": (0.1, 0.2, 0.3, 0.5),
    "mean_word": (2.5, 3.5, 8.0, 10.0, 12.0),
    "exclaims_per_word": (0.05, 0.1, 0.3, 0.5),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaims")


def _let(value: Column, body) -> Column:
    """body(value) with value computed once a row."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """How many words lie in a 3-word window that the text holds twice or more.

    Window hashes are compared first; only texts that repeat one are sorted by (hash, place).
    The words covered are then summed over the places in order, each adding three or the gap.
    """

    def covered(places: Column) -> Column:
        step = lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"))
        return F.aggregate(places, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), step, lambda acc: acc["n"])

    def places(ordered: Column) -> Column:
        last = F.size(ordered) - 1
        same = lambda i, j: ordered[i]["h"] == ordered[j]["h"]
        twice = F.filter(ordered, lambda _, j: F.when(j > 0, same(F.greatest(j - 1, F.lit(0)), j)).otherwise(False) | F.when(j < last, same(j, F.least(j + 1, last))).otherwise(False))
        return F.array_sort(F.transform(twice, lambda x: x["p"]))

    def of_hashes(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(_let(ordered, lambda o: covered(places(o))))

    def of_words(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0))), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
        return F.when(F.size(w) < 4, 0).otherwise(_let(hashes, of_hashes))

    return _let(words, of_words)


def statistics(text: Column) -> list[Column]:
    """The counts of COUNTS as columns over a text column."""
    t = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    of_lines = _let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    of_words = _let(words, lambda w: F.struct(F.size(w).alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    return [
        of_words.alias("of_words"),
        of_lines.alias("of_lines"),
        F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count(t, F.lit("!")).cast("long").alias("n_exclaims"),
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, the counts of COUNTS), by built-in expressions in one projection; row is a hash of the id and the text."""
    text = F.col(text_col).cast("string")
    inner = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(F.col(id_col), text).alias("row"), *statistics(text))
    nested = {"n_words": "of_words", "n_repeat_words": "of_words", "n_lines": "of_lines", "n_dup_lines": "of_lines"}
    return inner.select("doc_id", "row", *[F.col(f"{nested[c]}.{c}" if c in nested else c).cast("long").alias(c) for c in COUNTS])


def features() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return {
        "symbols_per_word": F.col("n_symbols") / words,
        "upper_share": F.col("n_upper") / chars,
        "repeat_share": F.col("n_repeat_words") / words,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
        "mean_word": F.col("word_chars") / words,
        "exclaims_per_word": F.col("n_exclaims") / words,
    }


def base_failed(min_words: int = 50, max_repeat_percent: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


Grid = dict[str, tuple[float, ...]]


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def column(self) -> Column:
        x = features()[self.feature]
        return x >= self.threshold if self.at_least else x < self.threshold

    def holds(self, reached: np.ndarray, grid: Grid) -> np.ndarray:
        """reached: how many thresholds of the feature each cell reaches."""
        return (reached > grid[self.feature].index(self.threshold)) == self.at_least

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:g}"


Rule = tuple[Condition, ...]


def _entropy(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Bits that the labels of so many rows take."""
    n = bad + good
    with np.errstate(divide="ignore", invalid="ignore"):
        bits = -(bad * np.log2(bad / n) + good * np.log2(good / n))
    return np.where((bad > 0) & (good > 0), bits, 0.0)


def cuts(bad: np.ndarray, good: np.ndarray, most: int = 5) -> list[int]:
    """Levels at which rows counted by level are cut, so that the labels of the parts take the fewest bits; most at a time, and only cuts that save more than they cost."""
    parts, found = [(0, len(bad))], []
    while len(found) < most:
        best = None
        for i, j in parts:
            p, q = np.cumsum(bad[i:j])[:-1], np.cumsum(good[i:j])[:-1]
            n, m = bad[i:j].sum(), good[i:j].sum()
            if not len(p) or not n or not m:
                continue
            saved = _entropy(np.array([n]), np.array([m]))[0] - _entropy(p, q) - _entropy(n - p, m - q)
            k = int(np.argmax(saved))
            # a cut costs its place among the rows, and the label shares of one part more
            if saved[k] > math.log2(n + m) + 2 and (best is None or saved[k] > best[0]):
                best = saved[k], i, i + k + 1, j
        if best is None:
            break
        _, i, k, j = best
        parts.remove((i, j))
        parts += [(i, k), (k, j)]
        found.append(k)
    return sorted(found)


def learn_grid(rows: DataFrame, quantiles: int = 128) -> Grid:
    """Thresholds of each feature for rows(the counts, bad)."""
    shares = [i / quantiles for i in range(quantiles + 1)]
    names = list(features())
    found = rows.agg(*[F.percentile_approx(x, shares, 10_000).alias(f) for f, x in features().items()]).first()
    middles: Grid = {}
    for f in names:
        values = sorted(set(found[f] or []))
        middles[f] = tuple((a + b) / 2 for a, b in zip(values, values[1:], strict=False))
    if not any(middles.values()):
        return {f: () for f in names}
    # a row's level is the number of middles it reaches
    level = lambda f, x: F.size(F.filter(F.array(*map(F.lit, middles[f])), lambda t: x >= t))
    levels = F.array(*[F.struct(F.lit(f).alias("f"), level(f, x).alias("level")) for f, x in features().items() if middles[f]])
    counted = rows.select("bad", F.explode(levels).alias("x")).groupBy("x.f", "x.level", "bad").count().collect()  # features x quantiles x labels at most
    grid: Grid = {}
    for f in names:
        table = np.zeros((2, len(middles[f]) + 1))
        for r in counted:
            if r["f"] == f:
                table[0 if r["bad"] else 1, r["level"]] += r["count"]
        grid[f] = tuple(middles[f][k - 1] for k in cuts(*table))
    return grid


def labelled(stats: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", folds: int = 3) -> DataFrame:
    """Statistics of labelled rows, with the label (bad) and the fold (held, by the crc32 of the id)."""
    label = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("label IS NOT NULL")
    held = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0).alias("held")
    return stats.join(label, "doc_id").select(*COUNTS, held, (F.col("label") == 0).alias("bad"))


def label_cells(rows: DataFrame, grid: Grid) -> list[dict]:
    """Counts of labelled rows by cell, label and fold."""
    cell = [sum(((x >= t).cast("int") for t in grid[f]), F.lit(0)).alias(f) for f, x in features().items()]
    return [r.asDict() for r in rows.select(*cell, "held", "bad").groupBy(*grid, "held", "bad").count().collect()]


class _Cells:
    """Cells as arrays: thresholds reached by feature, and rows by label."""

    def __init__(self, reached: dict[str, np.ndarray], bad: np.ndarray, good: np.ndarray, grid: Grid):
        self.reached, self.bad, self.good, self.grid = reached, bad, good, grid

    @classmethod
    def of(cls, cells: list[dict], grid: Grid) -> _Cells:
        n = np.array([c["count"] for c in cells], dtype=np.float64)
        bad = np.array([bool(c["bad"]) for c in cells], dtype=bool)
        return cls({f: np.array([c[f] for c in cells], dtype=np.int64) for f in grid}, np.where(bad, n, 0), np.where(bad, 0, n), grid)

    def where(self, mask: np.ndarray) -> _Cells:
        return _Cells({f: x[mask] for f, x in self.reached.items()}, self.bad[mask], self.good[mask], self.grid)

    def covered(self, rule: Rule) -> np.ndarray:
        mask = np.ones(len(self.bad), dtype=bool)
        for c in rule:
            mask &= c.holds(self.reached[c.feature], self.grid)
        return mask

    def weigh(self, rule: Rule = ()) -> tuple[float, float]:
        mask = self.covered(rule)
        return self.bad[mask].sum(), self.good[mask].sum()


def _grow(cells: _Cells) -> Rule:
    rule: Rule = ()
    p, n = cells.weigh()
    while n and p:
        best, gain = None, 1e-9
        for f, ts in cells.grid.items():
            bad, good = (np.bincount(cells.reached[f], weights=w, minlength=len(ts) + 1) for w in (cells.bad, cells.good))
            for k, t in enumerate(ts):
                above = bad[k + 1 :].sum(), good[k + 1 :].sum()
                for side, (q, m) in ((True, above), (False, (p - above[0], n - above[1]))):
                    if q and (g := q * (math.log2(q / (q + m)) - math.log2(p / (p + n)))) > gain:
                        best, gain = Condition(f, side, t), g
        if best is None:
            break
        rule += (best,)
        cells = cells.where(cells.covered((best,)))
        p, n = cells.weigh()
    return rule


def _prune(cells: _Cells, rule: Rule) -> Rule:
    def worth(r: Rule) -> float:
        p, n = cells.weigh(r)
        return (p - n) / (p + n) if p + n else -1.0

    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def learn_rules(cells: list[dict], grid: Grid | None = None, min_precision: float = 0.9, least_share: float = 0.002) -> list[Rule]:
    """Ordered rules that reject; each covers bad rows that those before it leave, at least two and `least_share` of all of them."""
    grid = grid or GRID
    rules: list[Rule] = []
    left, held = _Cells.of(cells, grid), np.array([bool(c["held"]) for c in cells], dtype=bool)
    least = max(2.0, least_share * left.bad.sum())
    while True:
        rule = _grow(left.where(~held))
        if not rule:
            break
        rule = _prune(left.where(held), rule) if held.any() else rule
        p, n = left.weigh(rule)
        if p < least or p < min_precision * (p + n):
            break
        rules.append(rule)
        mask = ~left.covered(rule)
        left, held = left.where(mask), held[mask]
    return rules


def verdict(rules: list[Rule]) -> Column:
    """True where the list keeps a row: the first rule that fires rejects."""
    out = None
    for rule in rules:
        fires = rule[0].column()
        for c in rule[1:]:
            fires = fires & c.column()
        out = F.when(fires, False) if out is None else out.when(fires, False)
    return F.lit(True) if out is None else out.otherwise(True)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", min_words: int = 50) -> tuple[DataFrame, list[Rule]]:
    """(doc_id, counts, base_failed, kept) and the rules; learned from labelled rows that pass the base."""
    stats = materialise(document_statistics(docs, id_col, text_col), "statistics")
    failed = base_failed(min_words)
    rows = materialise(labelled(stats.filter(~failed), labels, label_col, id_col), "labelled")
    grid = learn_grid(rows)
    rules = learn_rules(label_cells(rows, grid), grid)
    return stats.select("*", failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept")), rules


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    out, _ = judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents that the rules keep.  Short texts are no fault here; texts without a word are."""
    out, _ = judge(docs, labels, id_col, text_col, min_words=1)
    row = unused(docs, "__row")
    kept = out.filter("kept").select(F.col("row").alias(row)).distinct()
    return docs.withColumn(row, row_key(F.col(id_col), F.col(text_col).cast("string"))).join(kept, row, "left_semi").drop(row)
