"""Scores of ranked evidence, by probe and in the aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEPTH = 5
Z = 1.959963984540054
DIMENSIONS = ("domain", "probe_type", "capability_group", "habit_family", "stress_variant", "split")


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double; 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def discounted(gains: Column) -> Column:
    return F.aggregate(F.transform(gains, lambda g, i: g / F.log2(i + F.lit(2.0))), F.lit(0.0), lambda acc, x: acc + x)


def score_probes(df: DataFrame, mode: str = "ranked") -> DataFrame:
    """``df``: ranked, positives, temporal, nonbinding (arrays of ids), and optional after_cutoff, unknown, wrong_user.

    Ids count once, at their first place; ids that are not valid keep their rank. In ``context`` mode all ids count,
    in ``ranked`` mode the first five. Measures without a ground are null: graded and temporal ones without temporal
    evidence, intrusion without nonbinding evidence.
    """
    some = lambda c: F.col(c) if c in df.columns else F.array().cast("array<string>")
    df = df.withColumns({"r": F.array_distinct("ranked"), "bad": F.array_distinct(F.concat(some("unknown"), some("wrong_user"), some("after_cutoff")))})
    df = df.withColumn("t", F.slice("r", 1, DEPTH) if mode == "ranked" else F.col("r"))
    inter = lambda a, b: F.size(F.array_intersect(a, b))
    df = df.withColumns({"h": inter("positives", "t"), "g": F.size("positives"), "m": F.size("temporal"), "n": F.size("nonbinding"), "k": F.size("t")})
    gain = lambda x: F.when(F.array_contains("positives", x), 1.0).otherwise(0.0)
    graded = lambda x: F.when(F.array_contains("positives", x), 3.0).when(F.array_contains("temporal", x), 1.0).otherwise(0.0)
    ones = lambda n, v: F.array_repeat(F.lit(v), n)
    first = F.array_position(F.transform("t", gain), 1.0)
    ideal = F.slice(F.concat(ones(F.col("g"), 3.0), ones(F.col("m"), 1.0)), 1, DEPTH)
    with_m, with_n = F.col("m") > 0, F.col("n") > 0
    return df.withColumns({
        "attributed": F.size("ranked"), "n_unique": F.size("r"), "n_valid": F.size(F.array_except("r", "bad")),
        "recall": ratio(F.col("h"), F.col("g")), "coverage_eff": ratio(F.col("h"), F.least(F.lit(DEPTH), F.col("g"))),
        "precision": ratio(F.col("h"), F.lit(DEPTH)), "returned_precision": ratio(F.col("h"), F.col("k")),
        "mrr": ratio((first > 0).cast("int"), first), "hit": F.col("h") > 0, "full": F.size(F.array_except("positives", "t")) == 0,
        "ndcg": ratio(discounted(F.transform("t", gain)), discounted(ones(F.least(F.lit(DEPTH), F.col("g")), 1.0))),
        "graded_ndcg": F.when(with_m, ratio(discounted(F.transform("t", graded)), discounted(ideal))),
        "temporal_recall": F.when(with_m, ratio(inter("temporal", "t"), F.col("m"))),
        "intrusion": F.when(with_n, ratio(inter("nonbinding", "t"), F.lit(DEPTH))),
    }).withColumns({
        "discrimination": F.col("precision") - F.col("intrusion"),
        "clean_hit": F.when(with_n, F.col("hit") & (F.col("intrusion") == 0)),
        "correct": F.col("choice") == F.col("gold"),
    }).withColumns({"joint_hit": F.col("correct") & F.col("hit"), "joint_full": F.col("correct") & F.col("full"), "clean_grounded": F.col("clean_hit") & F.col("correct")})


def labels_of(t: Column, positives: Column, temporal: Column, nonbinding: Column, unknown: Column, wrong_user: Column, after: Column) -> Column:
    """What each ranked id is; the first that applies."""
    return F.transform(
        t,
        lambda x: F.when(F.array_contains(positives, x), "positive").when(F.array_contains(temporal, x), "temporal").when(F.array_contains(nonbinding, x), "nonbinding")
        .when(F.array_contains(unknown, x), "unknown").when(F.array_contains(wrong_user, x), "wrong_user").when(F.array_contains(after, x), "after_cutoff").otherwise("other"),
    )


def wilson(successes: Column, n: Column) -> tuple[Column, Column]:
    """Bounds of the Wilson interval in [0, 1]; (0, 0) for no trials."""
    p, n = ratio(successes, n), n.cast("double")
    centre, spread = p + Z * Z / (2 * n), Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))
    scale = 1 + Z * Z / n
    bound = lambda x: F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))).otherwise(0.0)
    return bound((centre - spread) / scale), bound((centre + spread) / scale)


def component_scores(t: Column, groups: Column) -> tuple[Column, Column, Column]:
    """Share of groups with a member in ``t``, share of groups wholly in it, and whether all are; null without groups."""
    any_, all_ = F.filter(groups, lambda g: F.arrays_overlap(g, t)), F.filter(groups, lambda g: F.size(F.array_except(g, t)) == 0)
    some = F.size(groups) > 0
    return F.when(some, ratio(F.size(any_), F.size(groups))), F.when(some, ratio(F.size(all_), F.size(groups))), F.when(some, F.size(all_) == F.size(groups))


def metric_columns() -> list[Column]:
    """Aggregates of scored rows."""
    truth = lambda c: F.avg(F.col(c).cast("double"))
    n, ok = F.count(F.lit(1)), F.sum(F.col("correct").cast("long"))
    low, high = wilson(ok, n)
    return [
        n.alias("n"), ok.alias("n_correct"), truth("correct").alias("accuracy"), low.alias("ci_low"), high.alias("ci_high"),
        F.avg("recall").alias("recall_macro"), ratio(F.sum("h"), F.sum("g")).alias("recall_micro"), F.avg("coverage_eff").alias("coverage_eff"), F.avg("precision").alias("precision"),
        truth("hit").alias("hit_rate"), truth("full").alias("full_rate"), F.avg("mrr").alias("mrr"), F.avg("ndcg").alias("ndcg"), truth("joint_hit").alias("joint_hit_rate"),
        ratio(F.sum(F.col("n_unique") - F.col("n_valid")), F.sum("n_unique")).alias("invalid_rate"), ratio(F.sum(F.col("attributed") - F.col("n_unique")), F.sum("attributed")).alias("duplicate_rate"),
        F.avg("graded_ndcg").alias("graded_ndcg"), F.avg("temporal_recall").alias("temporal_recall"), F.avg("intrusion").alias("intrusion"),
        (F.avg(F.when(F.col("hit"), F.col("correct").cast("double"))) - F.avg(F.when(~F.col("hit"), F.col("correct").cast("double")))).alias("utility_gap"),
    ]


def retrieval_fields(scored: DataFrame, mode: str = "ranked") -> DataFrame:
    """Scored rows with what the retrieval aggregates read besides: counts of attributed ids by class, components, exposure.

    Optional columns: ``groups`` (array of arrays of ids, the components that an answer needs), ``reported`` (a count of
    its own, else the number of different ids).
    """
    some = lambda c, kind: F.col(c) if c in scored.columns else F.lit(None).cast(kind)
    count = lambda c: F.coalesce(F.size(F.array_intersect("r", some(c, "array<string>"))), F.lit(0))
    any_, complete, chain = component_scores(F.col("t"), F.coalesce(some("groups", "array<array<string>>"), F.array().cast("array<array<string>>")))
    of_n = F.size(F.array_intersect("nonbinding", "t"))
    with_n = F.col("n") > 0
    return scored.withColumns({
        "n_wrong_user": count("wrong_user"), "n_after_cutoff": count("after_cutoff"), "n_invalid": F.col("n_unique") - F.col("n_valid"), "n_duplicate": F.col("attributed") - F.col("n_unique"),
        "reported_items": F.coalesce(some("reported", "long"), F.col("n_unique")), "available": F.col("n_valid") > 0,
        "component_hit": any_, "component_complete": complete, "complete_chain": chain,
        "probe_intrusion": F.when(with_n, of_n > 0), "exposure": F.when(with_n, ratio(of_n, F.col("n"))),
    }).withColumn("mode", F.lit(mode))


def mean(c: str, when: Column | None = None) -> Column:
    """Mean of fractions below 100, whatever the order of the rows.

    Doubles summed in another order differ in their last digit, which decides how a mean that lies half-way between two
    roundings is rounded. Sums of decimals are exact; what a double lacks of a fraction such as 1/3 is below the 15th digit.
    """
    x = F.col(c) if when is None else F.when(when, F.col(c))
    return F.round(F.avg(x.cast("decimal(20,18)")), 15).cast("double")


def retrieval_columns(mode: str) -> list[Column]:
    """Aggregates of ``retrieval_fields`` rows of one mode: common, of the mode, and optional ones over the rows that have them (null without any)."""
    truth = lambda c, when=None: F.avg((F.col(c) if when is None else F.when(when, F.col(c))).cast("double"))
    common = [
        F.count(F.lit(1)).alias("n"), truth("reported_items").alias("avg_reported"), truth("attributed").alias("avg_attributed"), truth("available").alias("attribution_coverage"),
        ratio(F.sum("n_invalid"), F.sum("attributed")).alias("invalid_rate"), ratio(F.sum("n_duplicate"), F.sum("attributed")).alias("duplicate_rate"),
        F.sum(F.col("n_wrong_user").cast("long")).alias("n_wrong_user"), F.sum(F.col("n_after_cutoff").cast("long")).alias("n_after_cutoff"),
        mean("recall").alias("recall_macro"), ratio(F.sum("h"), F.sum("g")).alias("recall_micro"), truth("full").alias("full_rate"), truth("joint_hit").alias("joint_hit_rate"),
        mean("component_hit").alias("component_hit"), mean("component_complete").alias("component_complete"), truth("complete_chain").alias("complete_chain_rate"), mean("temporal_recall").alias("temporal_recall"),
    ]
    if mode == "context":
        return [*common, mean("exposure").alias("exposure")]
    when_hit, when_miss = truth("correct", F.col("hit")), truth("correct", ~F.col("hit"))
    return [
        *common, *(mean(c).alias(c) for c in ("coverage_eff", "precision", "mrr", "ndcg", "graded_ndcg", "intrusion", "discrimination")), truth("hit").alias("hit_rate"), truth("joint_full").alias("joint_full_rate"),
        mean("recall", F.col("available")).alias("recall_attributed"), when_hit.alias("accuracy_hit"), when_miss.alias("accuracy_miss"), (when_hit - when_miss).alias("utility_gap"),
        truth("probe_intrusion").alias("probe_intrusion_rate"), truth("clean_hit").alias("clean_hit_rate"), truth("clean_grounded").alias("clean_grounded_rate"),
    ]


def retrieval_aggregates(df: DataFrame, mode: str, *by: str) -> DataFrame:
    """The aggregates of one mode by ``by``, from the input of ``score_probes``."""
    return retrieval_fields(score_probes(df, mode), mode).groupBy("mode", *by).agg(*retrieval_columns(mode))


def rollup(scored: DataFrame, dimensions: list[str]) -> DataFrame:
    """One bucket over all and one for each value of each dimension. Rows are dealt out once; sums are combined in each task first."""
    pairs = F.array(F.struct(F.lit("overall").alias("group_field"), F.lit("all").alias("grp")), *(F.struct(F.lit(d).alias("group_field"), F.coalesce(F.col(d).cast("string"), F.lit("unknown")).alias("grp")) for d in dimensions))
    return scored.withColumn("bucket", F.explode(pairs)).groupBy("bucket.group_field", "bucket.grp").agg(*metric_columns())


def two_level(scored: DataFrame, unit: str, *measures: str) -> DataFrame:
    """Mean over units of the mean within a unit."""
    within = scored.groupBy(unit).agg(*(F.avg(F.col(m).cast("double")).alias(m) for m in measures))
    return within.agg(F.count(F.lit(1)).alias("n_units"), *(F.avg(m).alias(f"{m}_macro") for m in measures))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(f.name, digits).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema.fields))


def gold_violations(gold: DataFrame, sessions: DataFrame) -> DataFrame:
    """Of labels (probe_id, session_id, user_id, cutoff) those that break the contract, and how: an unknown session, one of another user, or one after the cutoff."""
    of = sessions.select(F.col("session_id").alias("_session"), F.col("user_id").alias("_owner"), F.col("session_index").alias("_index"))
    found = gold.join(of, F.col("session_id") == F.col("_session"), "left")
    why = F.when(F.col("_session").isNull(), "unknown").when(~F.col("_owner").eqNullSafe(F.col("user_id")), "wrong user").when(F.col("_index") > F.col("cutoff"), "after cutoff")
    return found.select("probe_id", "session_id", why.alias("violation")).filter(F.col("violation").isNotNull())
