"""Which documents hold which passages: an equi-join on a run of whole words, then a check of the whole passage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of the longest run that passages and documents meet on.
WIDEST = 6


def flat(text: Column) -> Column:
    """Lower case, white space as one blank."""
    return F.trim(F.regexp_replace(F.lower(text), "[ \\n\\t\\r]+", " "))


def contained(passages: DataFrame, documents: DataFrame) -> DataFrame:
    """(passage_id, doc_id) of every passage (passage_id, text) that a document (doc_id, text) holds, both flat.

    A passage's words but its first and last are whole words of any text that holds it. Passages and documents meet on the run
    of `WIDEST` of those that has most letters, or of as many as there are: one pass over the documents, which hands on ids and
    hashes of runs. Only documents that meet a passage are read again, for the check. Passages of less than three words have no
    whole word for certain and are looked for in every document. Empty passages are in no document.
    """
    own = passages.select("passage_id", flat(F.col("text")).alias("q")).where("q <> ''").withColumn("w", F.split("q", " "))
    inner = F.slice("w", 2, F.greatest(F.lit(0), F.size("w") - 2))
    own = own.withColumn("inner", F.when(F.size("w") > 2, inner).otherwise(F.array().cast("array<string>")))
    own = own.withColumn("width", F.least(F.lit(WIDEST), F.size("inner")))
    widths = sorted(r[0] for r in own.select("width").distinct().collect())  # 0 to WIDEST
    docs = documents.select("doc_id", flat(F.col("text")).alias("p"))
    run = lambda words, at, width: F.array_join(F.slice(words, at, width), " ")
    starts = lambda words, width: F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - width + 1))
    found = []
    if keyed := [w for w in widths if w]:
        runs = F.transform(starts("inner", F.col("width")), lambda at: run("inner", at, F.col("width")))
        longest = F.array_max(F.transform(runs, lambda r: F.struct(F.length(r).alias("n"), r.alias("r"))))["r"]
        keys = own.where("width > 0").select("passage_id", "q", F.xxhash64(longest, "width").alias("key"))
        hashes = lambda width: F.transform(starts("w", width), lambda at: F.xxhash64(run("w", at, width), width))
        every = F.flatten(F.array(*(hashes(F.lit(w)) for w in keyed)))
        met = docs.withColumn("w", F.split("p", " ")).select("doc_id", F.explode(F.array_distinct(every)).alias("key")).join(keys, "key").drop("key")
        found.append(met.join(docs, "doc_id").where(F.contains("p", "q")).select("passage_id", "doc_id"))
    if 0 in widths:
        short = own.where("width = 0").select("passage_id", "q")
        found.append(docs.join(short, F.contains("p", "q")).select("passage_id", "doc_id"))
    if not found:
        return docs.join(own.select("passage_id"), F.lit(False)).select("passage_id", "doc_id")
    return found[0] if len(found) == 1 else found[0].union(found[1])
