"""Language identification by prediction by partial matching over bytes.

For every language a context tree of up to three bytes is learned: a node holds how often each
byte followed its context.  The probability of a byte is read at the longest known context that
has it, each step to a shorter one costing that node's escape probability (distinct followers
over followers plus distinct followers); the last resort is uniform over 256 bytes.  Counts are
frozen after learning, so the code length of a text is a sum over its 4-byte windows.

All training rows are counted, in every order of context.  A path is kept if it is at least one
in `max_grams` of its language's bytes, the same rule at every size: no order can hold more than
max_grams paths a language, which bounds the model and what is broadcast.  What a context loses
with its rare paths goes to its escape probability, so its code lengths still add up to one.

Defined results: a null text or one without a letter is `und` with score 0; with nothing to
learn from, every text is `und`; ties go to the language that sorts first; empty tables give no
rows; repeated rows count as often as they occur, and rows without an id are predicted like
others; very long texts are read whole; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtide.llm.common import bucket_of_id, chunked, materialise, read_table, record_batch, row_key, texts, unused

DEPTH = 3
UND = "und"


def windows(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The 4-byte windows that end at each byte, one text after another, and how many each text has.

    A text is read as if three zero bytes stood before it.
    """
    joined = b"".join(b"\0\0\0" + t for t in data)
    n = np.fromiter(map(len, data), dtype=np.int64, count=len(data))
    if not n.sum():
        return np.zeros(0, dtype=np.uint32), n
    b = np.frombuffer(joined, dtype=np.uint8).astype(np.uint32)
    code = (b[:-3] << np.uint32(24)) | (b[1:-2] << np.uint32(16)) | (b[2:-1] << np.uint32(8)) | b[3:]
    if len(data) == 1:
        return code, n
    starts = np.cumsum(n + 3) - (n + 3)
    keep = np.ones(len(code), dtype=bool)
    seams = (starts[1:, None] + np.array([-3, -2, -1])).ravel()
    keep[seams[(seams >= 0) & (seams < len(code))]] = False
    return code[keep], n


@dataclass
class Tree:
    """Counts of one language by order: paths, sorted, and the contexts they are in with their totals and escape weights."""

    paths: list[np.ndarray]
    counts: list[np.ndarray]
    contexts: list[np.ndarray]
    total: list[np.ndarray]
    kinds: list[np.ndarray]
    escape: list[np.ndarray]

    @classmethod
    def empty(cls) -> Tree:
        return cls([], [], [], [], [], [])

    def add(self, paths: np.ndarray, counts: np.ndarray, total: np.ndarray, kinds: np.ndarray) -> None:
        """The next order: kept paths with their counts, and each one's context's total and distinct followers, pruned ones included."""
        order = np.argsort(paths)
        paths, counts = paths[order], counts[order]
        ctx, first, at = np.unique(paths >> np.uint32(8), return_index=True, return_inverse=True)
        total, kinds = total[order][first], kinds[order][first]
        self.paths.append(paths)
        self.counts.append(counts)
        self.contexts.append(ctx)
        self.total.append(total)
        self.kinds.append(kinds)
        self.escape.append(kinds + total - np.bincount(at, weights=counts, minlength=len(ctx)))

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each window, in bits."""
        out = np.zeros(len(codes))
        open_ = np.ones(len(codes), dtype=bool)
        for d in range(DEPTH, -1, -1):
            path = codes & np.uint32((1 << 8 * (d + 1)) - 1)
            names, ctx = self.paths[d], self.contexts[d]
            if not len(names):
                continue
            at = np.minimum(np.searchsorted(ctx, path >> np.uint32(8)), len(ctx) - 1)
            known = open_ & (ctx[at] == path >> np.uint32(8))
            p = np.minimum(np.searchsorted(names, path), len(names) - 1)
            hit = known & (names[p] == path)
            weight = self.total[d][at] + self.kinds[d][at]
            out[hit] -= np.log2(self.counts[d][p[hit]] / weight[hit])
            miss = known & ~hit
            out[miss] -= np.log2(self.escape[d][at[miss]] / weight[miss])
            open_ &= ~hit
        out[open_] += 8.0
        return out


@dataclass
class Model:
    langs: list[str]
    trees: list[Tree]

    def __post_init__(self):
        paths = [t.paths[DEPTH] for t in self.trees]
        self.grams = np.unique(np.concatenate(paths)) if paths else np.zeros(0, np.uint32)
        self.cost = np.stack([t.bits(self.grams) for t in self.trees], axis=1).astype(np.float32) if paths else np.zeros((0, 0), np.float32)

    def lengths(self, data: list[bytes]) -> np.ndarray:
        """Code lengths, one row a text and one column a language."""
        codes, n = windows(data)
        out = np.zeros((len(data), len(self.langs)))
        if not len(codes) or not len(self.grams):
            return out
        at = np.minimum(np.searchsorted(self.grams, codes), len(self.grams) - 1)
        odd = np.flatnonzero(self.grams[at] != codes)
        ends = np.cumsum(n)
        some = np.flatnonzero(n)
        extra = None
        if len(odd):
            names, inverse = np.unique(codes[odd], return_inverse=True)
            extra = np.stack([t.bits(names) for t in self.trees], axis=1)[inverse]
        for k in range(len(self.langs)):
            each = self.cost[:, k][at].astype(np.float64)
            if extra is not None:
                each[odd] = extra[:, k]
            out[some, k] = np.add.reduceat(each, (ends - n)[some])
        return out


def count_windows(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, code, n): counts of 4-byte windows by language, summed in each task first."""
    schema = pa.schema([("lang", pa.string()), ("code", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, (codes, n) in held.items():
                yield record_batch(schema, {"lang": [lang] * len(codes), "code": codes.astype(np.int64), "n": n.astype(np.int64)})
            held.clear()

        for batch in chunked(batches):
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            data = np.array(texts(batch.column("text")) + [None], dtype=object)[:-1]
            for lang in sorted(set(langs)):
                codes, n = np.unique(windows(list(data[langs == lang]))[0], return_counts=True)
                if lang in held:
                    both = np.concatenate((held[lang][0], codes))
                    codes, inverse = np.unique(both, return_inverse=True)
                    n = np.bincount(inverse, weights=np.concatenate((held[lang][1], n)))
                held[lang] = codes, n
            if sum(len(c) for c, _ in held.values()) > 4_000_000:
                yield from flush()
        yield from flush()

    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", max_grams: int = 1_000_000) -> Model:
    """The trees of all languages in lang_col.  The driver gets max_grams paths a language and order at most."""
    counts = materialise(count_windows(docs, lang_col, text_col), "windows")
    sizes = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(sizes)
    trees = {lang: Tree.empty() for lang in langs}
    if not langs:
        return Model([], [])
    least = F.element_at(F.create_map(*[F.lit(x) for lang in langs for x in (lang, sizes[lang] / max_grams)]), F.col("lang"))
    for d in range(DEPTH + 1):
        path = F.col("code").bitwiseAND(F.lit((1 << 8 * (d + 1)) - 1))
        paths = counts.groupBy("lang", path.alias("path")).agg(F.sum("n").alias("n"))
        context = F.shiftright("path", 8).alias("context")
        totals = paths.groupBy("lang", context).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        kept = paths.filter(F.col("n") >= least).select("lang", "path", "n", context).join(totals, ["lang", "context"]).toArrow()
        named = np.array(kept.column("lang").to_pylist(), dtype=object)
        for lang in langs:
            here = np.flatnonzero(named == lang)
            columns = [kept.column(c).to_numpy()[here] for c in ("path", "n", "total", "kinds")]
            trees[lang].add(columns[0].astype(np.uint32), *(c.astype(np.float64) for c in columns[1:]))
    return Model(langs, [trees[lang] for lang in langs])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score): the language of least code length, and its share of the evidence.

    Texts alone are read.  The score is the posterior under code lengths per text, each halved
    until one text's whole length counts as its square root, so that it stays comparable.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in chunked(batches):
            letters = batch.column("letters").to_pylist()
            data = texts(batch.column("text"))
            lengths = m.lengths([t if ok else b"" for t, ok in zip(data, letters, strict=True)])
            names, scores = [], []
            for row, t, ok in zip(lengths, data, letters, strict=True):
                if not ok or not m.langs:
                    names.append(UND)
                    scores.append(0.0)
                    continue
                k = int(np.argmin(row))
                gap = (row - row[k]) / max(1.0, len(t) ** 0.5)
                names.append(m.langs[k])
                scores.append(float(1.0 / np.exp2(-gap).sum()))
            yield record_batch(schema, {"doc_id": batch.column("doc_id"), "lang_pred": names, "score": scores})

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = learn(docs.filter(~bucket_of_id(F.col("doc_id")).eqNullSafe(0)))
    out = predict(docs, model)
    return out.select("doc_id", bucket_of_id(F.col("doc_id")).eqNullSafe(0).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.5) -> DataFrame:
    """Documents whose language is found; the model learns from the rows given that name one.

    A text without letters, or on which no language has `least` of the evidence, goes.
    """
    model = learn(docs, lang_col, text_col)
    row = unused(docs, "__row")
    keyed = docs.withColumn(row, row_key(F.col(id_col), F.col(text_col).cast("string")))
    kept = predict(keyed, model, row, text_col).filter((F.col("lang_pred") != UND) & (F.col("score") >= least)).select(F.col("doc_id").alias(row)).distinct()
    return keyed.join(kept, row, "left_semi").drop(row)
