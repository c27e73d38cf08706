"""Boolean full text over a positional inverted index.

A query is a conjunction of clauses, a clause a disjunction of leaves, each of which may be negated; any tree of AND, OR
and NOT has that form (``clauses``). A leaf is a phrase (one word or more) or a beginning of words. Queries are a table,
so many are answered in one job.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the four labels that a field can have.
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
#: Letters from which on the beginning of a word is looked for.
LEAST_PREFIX = 3


@dataclass(frozen=True)
class Leaf:
    words: tuple[str, ...]
    prefix: bool = False


@dataclass(frozen=True)
class Not:
    of: object


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


def clauses(tree, negated: bool = False) -> list[list[tuple[Leaf, bool]]]:
    """The tree as clauses of (leaf, negated). NOT moves inwards; OR is dealt out over AND."""
    if isinstance(tree, Leaf):
        return [[(tree, negated)]]
    if isinstance(tree, Not):
        return clauses(tree.of, not negated)
    parts = [clauses(p, negated) for p in tree.parts]
    if isinstance(tree, And) != negated:
        return [c for p in parts for c in p]
    out: list[list[tuple[Leaf, bool]]] = [[]]
    for p in parts:
        out = [a + b for a in out for b in p]
    return out


QUERY = "query {kind}, clause int, leaf int, negated boolean, words array<string>, prefix boolean"


def table_of(spark, trees: dict, kind: str = "long") -> DataFrame:
    """Trees by query id as the table that ``search`` reads."""
    rows = []
    for query, tree in trees.items():
        seen: dict[Leaf, int] = {}
        for n, clause in enumerate(clauses(tree)):
            rows += [(query, n, seen.setdefault(leaf, len(seen)), no, list(leaf.words), leaf.prefix) for leaf, no in clause]
    return spark.createDataFrame(rows, QUERY.format(kind=kind))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)


def postings(df: DataFrame, id_col: str, labels: dict[str, str]) -> DataFrame:
    """The index: doc, label, part, term, pos. ``labels`` gives each field its label; a field is a text or an array of texts.

    Elements of an array are parts of their own, so no phrase goes from one to the next. Null texts have no words.
    """
    kinds, out = dict(df.dtypes), None
    for field, label in labels.items():
        texts = F.col(field) if kinds[field].startswith("array") else F.array(F.col(field))
        parts = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.posexplode(texts).alias("part", "text"))
        rows = parts.select("doc", F.lit(field).alias("field"), F.lit(label).alias("label"), "part", F.posexplode(words(F.col("text"))).alias("pos", "term"))
        out = rows if out is None else out.union(rows)
    return out


def leaf_hits(queries: DataFrame, index: DataFrame) -> DataFrame:
    """query, leaf, doc, field, label, part, start: where each leaf stands.

    The terms that a leaf's words ask for are found in the vocabulary first; then their places in the index are lined
    up by where the phrase would start.
    """
    leaves = queries.select("query", "leaf", "words", "prefix").dropDuplicates(["query", "leaf"])
    asked = leaves.select("query", "leaf", F.size("words").alias("n"), "prefix", F.posexplode("words").alias("i", "word"))
    begins = F.col("prefix") & (F.length("word") >= LEAST_PREFIX)
    sought = asked.filter(~begins).select("query", "leaf", "n", "i", F.col("word").alias("term"))
    if not asked.filter(begins).isEmpty():
        begun = asked.filter(begins).select("word").distinct()
        terms = index.select("term").distinct().filter(F.length("term") >= LEAST_PREFIX)
        heads = terms.select("term", F.explode(F.sequence(F.lit(LEAST_PREFIX), F.length("term"))).alias("m")).select("term", F.expr("substring(term, 1, m)").alias("_word"))
        longer = heads.join(begun, F.col("_word") == F.col("word"), "left_semi")
        sought = sought.union(asked.filter(begins).join(longer, F.col("word") == F.col("_word")).select("query", "leaf", "n", "i", "term"))
    met = sought.join(index, "term").withColumn("start", F.col("pos") - F.col("i"))
    return met.groupBy("query", "leaf", "n", "doc", "field", "label", "part", "start").count().filter(F.col("count") == F.col("n")).drop("n", "count")


def search(queries: DataFrame, index: DataFrame, k: int | None = None) -> DataFrame:
    """query, doc, rank and place: the documents that satisfy all clauses of a query, at least one leaf of which they hold un-negated.

    A leaf that is found n times in a field adds weight * n / (n + 1) to the rank; negated leaves add nothing. Order is
    by rank (to 6 places), ties by doc. With ``k`` the first k are returned.
    """
    hits = leaf_hits(queries, index).groupBy("query", "leaf", "doc", "field", "label").agg(F.count("*").alias("tf"))
    weight = F.coalesce(*(F.when(F.col("label") == name, F.lit(w)) for name, w in WEIGHTS.items()))
    want = queries.groupBy("query", "leaf").agg(F.min("negated").alias("never"))
    scored = hits.join(want, ["query", "leaf"])
    held = scored.groupBy("query", "doc").agg(F.collect_set("leaf").alias("held"), F.sum(F.when(F.col("never"), 0.0).otherwise(weight * F.col("tf") / (F.col("tf") + 1))).alias("rank"))
    formula = queries.groupBy("query", "clause").agg(F.collect_list(F.struct("leaf", "negated")).alias("of")).groupBy("query").agg(F.collect_list("of").alias("formula"))
    fits = F.forall("formula", lambda c: F.exists(c, lambda x: F.array_contains("held", x["leaf"]) != x["negated"]))
    found = held.filter("rank > 0").join(formula, "query").filter(fits).select("query", "doc", F.round("rank", 6).alias("rank"))
    placed = found.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.col("rank").desc(), "doc")))
    return placed if k is None else placed.filter(F.col("place") <= k)


def all_else_any(queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """As ``search``, of queries in which each leaf is a clause; where none has all leaves, those that have any of them."""
    both = search(queries, index, k)
    left = queries.join(both.select("query").distinct(), "query", "left_anti").withColumn("clause", F.lit(0))
    return both.unionByName(search(left, index, k))
