"""Search over memory stores: one interface for vectors, weighted full text, and the fusion of rankings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annalist.operators import filters, mutation, vectors

#: Weights of the fields of a full-text index, from the first to the fourth.
WEIGHTS = (1.0, 0.4, 0.2, 0.1)
RRF = 60


@dataclass(frozen=True)
class VectorStore:
    """Rows with an id, a vector and payload columns. Each change gives a new store; ``save`` writes it as Parquet.

    Filters always apply before the cut, a larger score is better, ties go to the smaller id.
    """

    rows: DataFrame
    id_col: str = "id"
    vector: str = "embedding"

    @classmethod
    def load(cls, spark: SparkSession, path: str, id_col: str = "id", vector: str = "embedding") -> VectorStore:
        return cls(spark.read.parquet(path), id_col, vector)

    def save(self, path: str) -> None:
        self.rows.write.mode("errorifexists").parquet(path)

    def insert(self, batch: DataFrame) -> VectorStore:
        """Rows of the batch replace those of the same id."""
        return VectorStore(mutation.upsert(self.rows, batch.select(self.rows.columns), self.id_col), self.id_col, self.vector)

    def delete(self, ids: DataFrame) -> VectorStore:
        gone = ids.select(F.col(ids.columns[0]).alias("_gone")).distinct()
        return VectorStore(self.rows.join(gone, F.col(self.id_col) == F.col("_gone"), "left_anti"), self.id_col, self.vector)

    def get(self, ids: DataFrame) -> DataFrame:
        wanted = ids.select(F.col(ids.columns[0]).alias("_wanted")).distinct()
        return self.rows.join(wanted, F.col(self.id_col) == F.col("_wanted"), "left_semi")

    def list(self, where: dict | None = None, limit: int | None = None) -> DataFrame:
        """The rows that a filter leaves, in order of id where there is a limit."""
        found = self.rows.filter(filters.compile_filter(where)) if where else self.rows
        return found if limit is None else found.orderBy(self.id_col).limit(limit)

    def search(self, queries: DataFrame, k: int, where: dict | None = None, query_id: str = "query_id", threshold: float | None = None) -> DataFrame:
        return vectors.topk(queries, self.list(where), k, query_id, self.id_col, self.vector, threshold)


def ranked_text(queries: DataFrame, rows: DataFrame, id_col: str, fields: list[str], limit: int) -> DataFrame:
    """query, id and score by weighted fields: rows with all terms of a query first; those with any where all-term rows are few.

    ``queries`` has query and terms (array, lower case). A term counts with the weight of the best field that holds it
    as a word; the sum s gives s / (s + 1). Fewer than min(limit, 10) rows with all terms open the query to any.
    """
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))
    held = None
    for name, weight in zip(fields, WEIGHTS):
        part = rows.select(F.col(id_col).alias("id"), F.explode(words(F.col(name))).alias("term"), F.lit(weight).alias("w"))
        held = part if held is None else held.unionByName(part)
    asked = queries.select("query", F.size(F.array_distinct("terms")).alias("n"), F.explode(F.array_distinct("terms")).alias("term"))
    best = held.join(asked, "term").groupBy("query", "n", "id", "term").agg(F.max("w").alias("w"))
    scored = best.groupBy("query", "n", "id").agg(F.count(F.lit(1)).alias("hits"), F.sum("w").alias("s")).withColumn("whole", F.col("hits") == F.col("n"))
    few = F.sum(F.col("whole").cast("long")).over(Window.partitionBy("query")) < min(limit, 10)
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
    found = scored.withColumn("few", few).filter("whole OR few").withColumn("score", F.round(F.col("s") / (F.col("s") + 1), 6))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select("query", "id", "score", F.col("rank").cast("long").alias("rank"))


def fuse(rankings: list[DataFrame], k: int, constant: int = RRF) -> DataFrame:
    """Reciprocal rank fusion of rankings (query, id, rank): the sum of 1 / (constant + rank) over the lists that hold a row."""
    both = rankings[0].select("query", "id", "rank")
    for other in rankings[1:]:
        both = both.unionByName(other.select("query", "id", "rank"))
    scores = both.groupBy("query", "id").agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 8).alias("score"))
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "id"))).filter(F.col("rank") <= k)


def mixed(keyword: DataFrame, dense: DataFrame, alpha: float, k: int) -> DataFrame:
    """alpha times the keyword score scaled to [0, 1] within its query, plus (1 - alpha) times the cosine; what a list lacks counts 0."""
    own = Window.partitionBy("query")
    low, high = F.min("score").over(own), F.max("score").over(own)
    scaled = keyword.select("query", "id", ((F.col("score") - low) / (high - low + 1e-6)).alias("kw"))
    both = scaled.join(dense.select("query", "id", F.col("score").alias("cos")), ["query", "id"], "full_outer")
    total = alpha * F.coalesce("kw", F.lit(0.0)) + (1 - alpha) * F.coalesce("cos", F.lit(0.0))
    out = both.select("query", "id", F.round(total, 6).alias("score"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "id"))).filter(F.col("rank") <= k)


def capped(rows: DataFrame, kind: str, caps: dict[str, int], order: Column, tie: str) -> DataFrame:
    """The newest rows of each kind, as many as its cap; kinds without a cap are kept whole."""
    cap = F.coalesce(*(F.when(F.col(kind) == name, F.lit(n)) for name, n in caps.items()), F.lit(2**31 - 1))
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(kind).orderBy(order.desc(), F.col(tie).desc()))).filter(F.col("_k") <= cap).drop("_k")
