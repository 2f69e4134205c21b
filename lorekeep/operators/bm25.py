"""BM25 over scopes that each are a corpus of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorekeep.functions.text import tokens
from lorekeep.session import cut, written

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Rows of a scope that are looked at further, before those without a match go.
CAP = 300


def query_terms(spark, query: str) -> list[str]:
    """The query's tokens, repeated ones as often as they occur."""
    return spark.range(1).select(tokens(F.lit(query)).alias("t")).first()["t"]


def scores(docs: DataFrame, query: str, scope: str, key: str, text: str) -> DataFrame:
    """``scope, key, bm25`` of every document, those without a match at 0.

    A term in more than half of a scope's documents gets a quarter of the mean idf instead of its negative one. Only
    the (scope, term) counts are shuffled; the documents join a row a scope. A null scope is one of its own; null and
    empty texts count as documents without terms. A blank query gives no rows.
    """
    spark = docs.sparkSession
    terms = query_terms(spark, query)
    if not terms:
        return docs.select(F.col(scope).alias("scope"), F.col(key).alias("key"), F.lit(0.0).alias("bm25")).where("false")
    base = docs.select(F.coalesce(F.col(scope), F.lit("")).alias("scope"), F.col(key).alias("key"), tokens(F.col(text)).alias("t"))
    found = sorted(set(terms))
    count = lambda q: F.size(F.filter("t", lambda x: x == q))
    tf = {q: count(q) for q in found}
    # written, so that texts are cut into tokens once: the counts are read without the terms, the terms without the counts
    held = written(base.select("scope", "key", F.size("t").alias("len"), *(tf[q].alias(f"f{i}") for i, q in enumerate(found)), F.array_distinct("t").alias("terms")), "counts")
    counted = held.drop("terms")
    sizes = counted.groupBy("scope").agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"), *(F.sum((F.col(f"f{i}") > 0).cast("int")).alias(f"d{i}") for i in range(len(found))))
    df = held.select("scope", F.explode("terms").alias("term")).groupBy("scope", "term").agg(F.count("*").alias("df"))
    idf = lambda d: F.ln(F.col("n") - d + 0.5) - F.ln(d + 0.5)
    mean = df.join(sizes.select("scope", "n"), "scope").groupBy("scope").agg(F.avg(idf(F.col("df"))).alias("mean"))
    stats = sizes.join(mean, "scope", "left")

    def part(i: int):
        d, f = F.col(f"d{i}"), F.col(f"f{i}")
        weight = F.when(d == 0, 0.0).when(idf(d) < 0, EPSILON * F.col("mean")).otherwise(idf(d))
        return F.when(f == 0, 0.0).otherwise(weight * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.col("avgdl"))))

    total = sum((part(found.index(q)) for q in terms), F.lit(0.0))
    return counted.join(stats, "scope").select("scope", "key", total.alias("bm25"))


def candidates(scored: DataFrame, cap: int = CAP) -> DataFrame:
    """Adds ``shift`` (lifts a scope with negative scores above 0) and ``rank``; keeps the first ``cap`` of each scope and
    of these those with a match. The cap comes before, so it can cut matches that score below non-matches."""
    scored = cut(scored)
    lows = scored.groupBy("scope").agg(F.min("bm25").alias("low"))
    # the limit comes right behind the rank, so that each task sends at most ``cap`` rows of a scope
    first = scored.withColumn("rank", F.row_number().over(Window.partitionBy("scope").orderBy(F.round("bm25", 9).desc(), "key"))).where(F.col("rank") <= cap)
    lifted = first.join(lows, "scope").withColumn("shift", F.when(F.col("low") < 0, 1 - F.col("low")).otherwise(0.0))
    return lifted.where(F.abs("bm25") >= 1e-9).select("scope", "key", "bm25", "shift", "rank")


class Index:
    """Postings of a corpus in a folder, so that a query reads its own terms and no text.

    ``postings`` (term, scope, key, f, len, df) are sorted by term, which lets the scan skip what the query doesn't name;
    ``scopes`` has a row a scope; ``kept``, if columns to keep are named, a row a document with them. Scores and candidates
    equal :func:`scores` and :func:`candidates`.
    """

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def build(cls, docs: DataFrame, scope: str, key: str, text: str, path: str, keep: list[str] | None = None) -> Index:
        if keep:
            docs.select(F.col(key).alias("key"), *keep).sort("key").write.mode("overwrite").option("parquet.block.size", 8 << 20).parquet(f"{path}/kept")
        base = docs.select(F.coalesce(F.col(scope), F.lit("")).alias("scope"), F.col(key).alias("key"), tokens(F.col(text)).alias("t"))
        tf = base.select("scope", "key", F.size("t").alias("len"), F.explode("t").alias("term")).groupBy("scope", "key", "len", "term").agg(F.count("*").alias("f"))
        tf.write.mode("overwrite").parquet(f"{path}/tf")
        tf = docs.sparkSession.read.parquet(f"{path}/tf")
        df = tf.groupBy("scope", "term").agg(F.count("*").alias("df"))
        lengths = base.select("scope", F.size("t").alias("len")).groupBy("scope").agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"))
        idf = F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)
        mean = df.join(lengths, "scope").groupBy("scope").agg(F.avg(idf).alias("mean"))
        lengths.join(mean, "scope", "left").write.mode("overwrite").parquet(f"{path}/scopes")
        tf.join(df, ["scope", "term"]).repartitionByRange("term", "scope", "key").sortWithinPartitions("term").write.mode("overwrite").option("parquet.block.size", 8 << 20).parquet(f"{path}/postings")
        return cls(docs.sparkSession, path)

    def kept(self) -> DataFrame:
        """``key`` and the columns kept of every document."""
        return self.spark.read.parquet(f"{self.path}/kept")

    def candidates(self, query: str, cap: int = CAP) -> DataFrame:
        """``scope, key, bm25, shift, rank`` of the documents with a match, as :func:`candidates` gives them.

        Documents without a match aren't read: their number stands for them, between those above and those below 0.
        """
        terms = query_terms(self.spark, query)
        asked = {q: terms.count(q) for q in terms}
        scopes = self.spark.read.parquet(f"{self.path}/scopes")
        hits = self.spark.read.parquet(f"{self.path}/postings").where(F.col("term").isin(list(asked)) if asked else F.lit(False)).join(scopes, "scope")
        idf = F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)
        weight = F.when(idf < 0, EPSILON * F.col("mean")).otherwise(idf)
        times = F.element_at(F.create_map(*(F.lit(x) for kv in asked.items() for x in kv)), F.col("term")) if asked else F.lit(1)
        part = times * weight * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))
        scored = hits.groupBy("scope", "key").agg(F.sum(part).alias("bm25")).where(F.abs("bm25") >= 1e-9)
        sums = scored.groupBy("scope").agg(F.count("*").alias("m"), F.count(F.when(F.col("bm25") > 0, 1)).alias("up"), F.min("bm25").alias("low")).join(scopes.select("scope", "n"), "scope")
        place = Window.partitionBy("scope").orderBy(F.round("bm25", 9).desc(), "key")
        first = scored.withColumn("r", F.row_number().over(place)).where(F.col("r") <= cap)
        rank = F.when(F.col("bm25") > 0, F.col("r")).otherwise(F.col("r") + F.col("n") - F.col("m")).cast("int")
        low = F.when(F.col("m") < F.col("n"), F.least("low", F.lit(0.0))).otherwise(F.col("low"))
        placed = first.join(sums, "scope").select("scope", "key", "bm25", F.when(low < 0, 1 - low).otherwise(0.0).alias("shift"), rank.alias("rank"))
        return placed.where(F.col("rank") <= cap)
