"""Quality rules with host-level verdicts, in DataFrame expressions only.

Each document is measured once. Rule failures are then added up by host, each host's failure rate is shrunk
towards the rate of all hosts by a beta prior fitted to the spread of the hosts (method of moments), and the
verdict on the host is joined back to its documents. A document is kept when it fails no rule itself and its host
fails none at large.

Defined results: null and empty texts have no words, lines or symbols and fail for too few words; a null host is
one host of its own; equal rows give equal rows; a single host has no spread, so its rate is the overall rate; an
empty table gives an empty table; other columns are ignored. A text is measured whole, whatever its length.
Repeated 8-word windows are told apart by their 64-bit hash within one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import table

WINDOW_WORDS = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: More than so many symbols to 100 words.
MAX_SYMBOL_PERCENT = 10
MAX_DUP_LINE_PERCENT = 50
#: A host whose shrunk failure rate of a rule is above this takes all its documents with it.
MAX_HOST_RATE = 0.5
#: Bounds of the prior's weight, in documents.
PRIOR_LEAST, PRIOR_MOST = 1.0, 1e6
BLANKS = "[\\x20\\x09-\\x0D]+"
RULES = ("few_words", "repeats", "symbols", "dup_lines")


def let(value: Column, body) -> Column:
    """``body`` over ``value`` evaluated once; a plain column would be evaluated again inside each lambda."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column) -> Column:
    """Words inside windows of eight that stand twice or more in the text."""
    count = F.size(words)
    none = F.lit(0).cast("long")

    def covered(hashes: Column) -> Column:
        """Sort (hash, place); a place counts if a neighbour has its hash; then measure the union of the windows."""
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i"))))

        def places(p: Column) -> Column:
            same = F.filter(p, lambda x, i: ((i > 0) & (F.get(p, i - 1)["h"] == x["h"])) | (F.coalesce(F.get(p, i + 1)["h"] == x["h"], F.lit(False))))
            return F.sort_array(F.transform(same, lambda x: x["i"]))

        start = F.struct(none.alias("n"), none.alias("end"))
        add = lambda acc, i: F.struct((acc["n"] + i + WINDOW_WORDS - F.greatest(acc["end"], i)).alias("n"), (i + WINDOW_WORDS).alias("end"))
        return let(pairs, lambda p: F.aggregate(places(p), start, add, lambda acc: acc["n"]))

    hashes = F.transform(F.sequence(F.lit(1), count - (WINDOW_WORDS - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(WINDOW_WORDS))))
    return F.when(count <= WINDOW_WORDS, none).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(covered(h))))


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per document: host, counts, line count."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), text.alias("text"))
    words = F.array_remove(F.split("text", BLANKS), "")
    by_words = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeat_words(w).alias("n_repeat_words")))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    by_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    rows = rows.select("doc_id", "host", by_words.alias("w"), F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"), by_lines.alias("l"))
    return rows.select("doc_id", "host", "w.n_words", "w.word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines")


def with_rules(df: DataFrame) -> DataFrame:
    """A boolean ``fail_<rule>`` for each rule and ``base_failed``."""
    df = df.withColumns({
        "fail_few_words": F.col("n_words") < MIN_WORDS,
        "fail_repeats": 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"),
        "fail_symbols": 100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("n_words"),
        "fail_dup_lines": 100 * F.col("n_dup_lines") > MAX_DUP_LINE_PERCENT * F.col("n_lines"),
    })
    return df.withColumn("base_failed", F.col("fail_few_words") | F.col("fail_repeats"))


def host_rates(df: DataFrame) -> DataFrame:
    """One row per host: documents, failures and the shrunk failure rate of each rule, and ``host_failed``."""
    hosts = df.groupBy("host").agg(F.count("*").alias("n"), *(F.sum(F.col(f"fail_{r}").cast("long")).alias(f"f_{r}") for r in RULES))
    over = hosts.agg(F.sum("n").alias("all_n"), *(F.struct(F.sum(f"f_{r}").alias("f"), F.var_pop(F.col(f"f_{r}") / F.col("n")).alias("v")).alias(f"o_{r}") for r in RULES))
    out = hosts.crossJoin(F.broadcast(over))  # one row
    for r in RULES:
        mean, spread = F.col(f"o_{r}.f") / F.col("all_n"), F.col(f"o_{r}.v")
        weight = F.when(spread > 0, F.greatest(F.lit(PRIOR_LEAST), F.least(F.lit(PRIOR_MOST), mean * (1 - mean) / spread - 1))).otherwise(F.lit(PRIOR_MOST))
        out = out.withColumn(f"rate_{r}", (F.col(f"f_{r}") + mean * weight) / (F.col("n") + weight))
    failed = F.greatest(*(F.col(f"rate_{r}") for r in RULES)) > MAX_HOST_RATE
    return out.select("host", "n", *(f"f_{r}" for r in RULES), *(f"rate_{r}" for r in RULES), failed.alias("host_failed"))


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Every document with its counts, ``base_failed``, its host's verdict and ``kept``.

    The measures go through a table in the shared folder: both the host sums and the result read them, and texts
    are gone through once.
    """
    measured = with_rules(table(measure(df, id_col, text_col, host_col), "host-rules"))
    verdicts = host_rates(measured).select(F.col("host").alias("of_host"), "host_failed")
    own_failed = F.greatest(*(F.col(f"fail_{r}") for r in RULES))
    joined = measured.join(verdicts, F.col("host").eqNullSafe(F.col("of_host")), "left")
    kept = ~F.col("base_failed") & ~own_failed & ~F.coalesce("host_failed", F.lit(False))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))


def oracle() -> str:
    """What ``judge`` must return over documents, in DuckDB; windows are compared as texts."""
    fails = {"few_words": f"n_words < {MIN_WORDS}", "repeats": f"100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words", "symbols": f"100 * n_symbols > {MAX_SYMBOL_PERCENT} * n_words", "dup_lines": f"100 * n_dup_lines > {MAX_DUP_LINE_PERCENT} * n_lines"}
    sums = ", ".join(f"sum(CAST({c} AS INT)) AS f_{r}" for r, c in fails.items())
    over = ", ".join(f"sum(f_{r}) / sum(n) AS m_{r}, var_pop(f_{r} / n) AS v_{r}" for r in RULES)
    weight = lambda r: f"CASE WHEN v_{r} > 0 THEN greatest({PRIOR_LEAST}, least({PRIOR_MOST}, m_{r} * (1 - m_{r}) / v_{r} - 1)) ELSE {PRIOR_MOST} END"
    host = " OR ".join(f"(f_{r} + m_{r} * ({weight(r)})) / (n + ({weight(r)})) > {MAX_HOST_RATE}" for r in RULES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM d),
t AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
p AS (SELECT r, i, string_agg(word, ' ') OVER ahead AS gram, count(*) OVER ahead AS c FROM t WINDOW ahead AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW_WORDS - 1} FOLLOWING)),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS k FROM p WHERE c = {WINDOW_WORDS}),
rep AS (SELECT r, count(DISTINCT pos) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + {WINDOW_WORDS})) AS pos FROM g WHERE k > 1) x GROUP BY r),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
ln AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
m AS (SELECT d.doc_id, d.source, CAST(len(w.w) AS BIGINT) AS n_words, CAST(length(array_to_string(w.w, '')) AS BIGINT) AS word_chars, CAST(length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(ln.n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n_repeat_words, 0) AS BIGINT) AS n_repeat_words, coalesce(ln.n_lines, 0) AS n_lines FROM d JOIN w USING (r) LEFT JOIN rep USING (r) LEFT JOIN ln USING (r)),
h AS (SELECT source, count(*) AS n, {sums} FROM m GROUP BY source), o AS (SELECT {over} FROM h), v AS (SELECT source, ({host}) AS host_failed FROM h, o)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({fails["few_words"]}) OR ({fails["repeats"]}) AS base_failed, NOT ({" OR ".join(f"({c})" for c in fails.values())}) AND NOT host_failed AS kept
FROM m JOIN v ON m.source IS NOT DISTINCT FROM v.source"""
