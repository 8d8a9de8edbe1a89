"""Fill-in-middle transformation, in Spark SQL functions only.

A text is cut into lines; a hash of the document's id chooses two cuts between lines and whether the
parts are stored as prefix, suffix, middle (psm) or suffix, prefix, middle (spm), each behind its
sentinel.  restore() parses the sentinels and puts the text together again.  A row is transformed
by itself: one scan, no exchange.

Defined results: a null text counts as empty; an empty text, and one that holds a sentinel, stays
as it is (form plain); a null id is hashed as an empty string, so rows without an id share their
cuts; repeated rows give the same result each; line feeds are the only line ends; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtide.llm.common import read_table, take

#: Sentinels of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
UNIT = r"[^\n]*\n|[^\n]+"


def hashes(id_: Column, seed: int, count: int) -> list[Column]:
    """The first 8-digit groups of the hex sha256 of 'seed:id', as unsigned integers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(count)]


def transform(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = 100, spm: int = 50, seed: int = 7, unit: str = UNIT, sentinels: tuple[str, str, str] = SENTINELS
) -> DataFrame:
    """(doc_id, text, n, form, prefix, middle, suffix, output).

    rate: per cent of the texts that are transformed; spm: per cent of those with the suffix first.
    The parts are null where the form is plain.
    """
    p, s, m = sentinels
    rows = take(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    h = hashes(F.col("doc_id"), seed, 4)
    marked = F.lit(False)
    for mark in sentinels:
        marked = marked | F.contains(F.col("text"), F.lit(mark))
    plain = (F.col("text") == "") | marked | (h[2] % 100 >= rate)
    cut = rows.select(
        "doc_id", "text",
        F.regexp_extract_all("text", F.lit(unit), 0).alias("units"),
        F.when(plain, "plain").when(h[3] % 100 < spm, "spm").otherwise("psm").alias("form"),
        h[0].alias("h1"), h[1].alias("h2"),
    ).withColumn("n", F.size("units").cast("long"))
    places = cut.withColumns({"a": F.col("h1") % (F.col("n") + 1), "b": F.col("h2") % (F.col("n") + 1)})
    places = places.withColumns({"first": F.least("a", "b").cast("int"), "second": F.greatest("a", "b").cast("int")})

    def part(start: Column, length: Column) -> Column:
        return F.when(F.col("form") != "plain", F.array_join(F.slice("units", start, length), ""))

    first, second = F.col("first"), F.col("second")
    parts = places.select(
        "doc_id", "text", "n", "form",
        part(F.lit(1), first).alias("prefix"),
        part(first + 1, second - first).alias("middle"),
        part(second + 1, F.size("units") - second).alias("suffix"),
    )
    out = F.when(F.col("form") == "psm", F.concat(F.lit(p), "prefix", F.lit(s), "suffix", F.lit(m), "middle"))
    out = out.when(F.col("form") == "spm", F.concat(F.lit(s), "suffix", F.lit(p), "prefix", F.lit(m), "middle")).otherwise(F.col("text"))
    return parts.withColumn("output", out)


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text again, from output and form alone.

    Sentinels begin and end with different characters and the parts hold none, so each occurs once
    and splitting at them gives an empty string and the three parts in their stored order.
    """
    parts = F.split(output, "|".join(re.escape(x) for x in sentinels), -1)
    back = lambda x: F.when(form == "psm", F.concat(x[1], x[3], x[2])).when(form == "spm", F.concat(x[2], x[3], x[1]))
    return F.when(form == "plain", output).otherwise(F.transform(F.array(parts), back)[0])


def op11_fim(spark, sf_dir: str) -> DataFrame:
    out = transform(read_table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    out = out.withColumn("restored", restore(F.col("output"), F.col("form")))
    return out.select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        digest("output").alias("output_sha256"), digest("restored").alias("restored_sha256"),
    )


#: The same in DuckDB; what is restored is the text itself.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), c AS (
  SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n,
         CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain'
              WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), p AS (
  SELECT doc_id, t, n, form, array_to_string(u[1 : least(a, b)], '') AS pre,
         array_to_string(u[least(a, b) + 1 : greatest(a, b)], '') AS mid, array_to_string(u[greatest(a, b) + 1 : n], '') AS suf
  FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
