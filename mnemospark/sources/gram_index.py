"""An inverted index of character n-grams over short texts, for substring search with verification.

A term of three or more characters can only stand in a text that holds all of its trigrams, so the texts that share its
rarest trigrams are the candidates; shorter terms are grams themselves. Candidates are verified on the text. The index
knows no time: what is in force is decided when candidates meet their texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Longest gram, and grams of a term that are looked up, rarest first.
SIZE, LOOKED_UP = 3, 3


def grams(text: Column, size: int) -> Column:
    """The distinct substrings of one length."""
    last = F.length(text) - (size - 1)
    return F.array_distinct(F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(size)))).otherwise(F.array().cast("array<string>")))


class GramIndex:
    """postings (ns, gram, key), sorted by namespace and gram within files, and frequencies (ns, gram, df)."""

    def __init__(self, spark: SparkSession, path: str, key: str = "memory_id"):
        self.key, self.postings, self.frequencies = key, spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/frequencies")

    @classmethod
    def build(cls, texts: DataFrame, path: str, key: str = "memory_id") -> GramIndex:
        """Writes the index over (ns, key, text); null texts hold no grams. A text's grams are distinct within its row, so only the sort by range shuffles."""
        low = F.lower("text")
        every = texts.select("ns", key, F.explode(F.concat(*(grams(low, n) for n in range(1, SIZE + 1)))).alias("gram"))
        # By range, so that a gram that stands in most texts is spread over files; key breaks its ties.
        every.repartitionByRange("ns", "gram", key).sortWithinPartitions("ns", "gram").write.parquet(f"{path}/postings")
        spark = texts.sparkSession
        spark.read.parquet(f"{path}/postings").groupBy("ns", "gram").agg(F.count("*").alias("df")).write.parquet(f"{path}/frequencies")
        return cls(spark, path, key)

    def candidates(self, terms: DataFrame, mark) -> DataFrame:
        """(qid, ns, key): texts of a term's namespace that hold the term's rarest grams, for lower-cased terms (qid, ns, term).

        mark says which sides are small enough to be broadcast.
        """
        asked = terms.where("term <> ''").select("qid", "ns", "term").distinct()
        whole = F.length("term") <= SIZE
        wanted = asked.select("qid", "ns", "term", F.explode(F.when(whole, F.array("term")).otherwise(grams(F.col("term"), SIZE))).alias("gram"))
        known = wanted.join(mark(wanted.select("ns", "gram").distinct()).join(self.frequencies, ["ns", "gram"]), ["ns", "gram"], "left")
        by = W.partitionBy("qid", "ns", "term")
        # A gram that no text holds rules its term out.
        rare = known.withColumn("n", F.row_number().over(by.orderBy("df", "gram"))).withColumn("lost", F.max(F.col("df").isNull()).over(by))
        rare = rare.where(~F.col("lost") & (F.col("n") <= LOOKED_UP)).withColumn("of", F.count("*").over(by)).select("qid", "ns", "term", "gram", "of")
        held = self.postings.join(mark(rare), ["ns", "gram"]).groupBy("qid", "ns", "term", self.key).agg(F.count("*").alias("held"), F.max("of").alias("of")).where("held = of")
        return held.select("qid", "ns", self.key).distinct()
