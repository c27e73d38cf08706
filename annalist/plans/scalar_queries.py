"""Queries of scalar functions, windows and folds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from annalist.functions import text
from annalist.operators import dedup, folds
from annalist.plans import history
from annalist.registry import Registry, read

R = Registry()


@R.query("token_count", "SELECT doc_id, CAST(floor(length(text) / 3.0) AS BIGINT) AS n_tokens FROM documents")
def token_count(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.token_count(F.col("text")).cast("long").alias("n_tokens"))


@R.query("truncate_tokens", "SELECT doc_id, substr(text, 1, 60) AS head FROM documents")
def truncate_tokens(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.truncate_tokens(F.col("text"), 20).alias("head"))


@R.query("chunk_tokens", "WITH s AS (SELECT doc_id, text, unnest(range(0, CAST(length(text) AS BIGINT), 720)) AS b FROM documents) SELECT doc_id, b // 720 AS pos, md5(substr(text, b + 1, 900)) AS chunk_md5 FROM s")
def chunk_tokens(spark, sf_dir):
    chunks = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.chunk_windows(F.col("text"), 300, 60)).alias("pos", "chunk"))
    return chunks.select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


@R.query("render_session", "SELECT conv_id, md5('SESSION ' || conv_id || chr(10) || 'TIME None' || chr(10) || string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS rendered FROM conversations GROUP BY conv_id")
def render_session(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return turns.select("conv_id", F.md5(text.render_session(F.col("conv_id").cast("string"), F.lit(None), F.col("m")).cast("binary")).alias("rendered"))


@R.query("extract_session_ids", "SELECT event_id, 's' || event_id || ',' || 's' || (event_id + 1) AS ids FROM events")
def extract_session_ids(spark, sf_dir):
    said = F.concat(F.lit("saw [session:s"), "event_id", F.lit("] then [session:s"), F.col("event_id") + 1, F.lit("] and [session:s"), "event_id", F.lit("] [session:b ad]"))
    return read(spark, sf_dir, "events").select("event_id", F.array_join(text.session_ids(said), ",").alias("ids"))


@R.query("clean_text", r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g'))) AS cleaned FROM documents")
def clean_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(text.clean(F.col("text")).cast("binary")).alias("cleaned"))


@R.query("parse_choice", "SELECT event_id, CASE event_id % 5 WHEN 4 THEN NULL WHEN 3 THEN NULL ELSE substr('ABCD', CAST(1 + event_id % 4 AS INT), 1) END AS choice FROM events")
def parse_choice(spark, sf_dir):
    letter = F.substring(F.lit("ABCD"), (F.col("event_id") % 4 + 1).cast("int"), F.lit(1))
    kind = F.col("event_id") % 5
    reply = F.when(kind == 0, F.concat(F.lit('```json\n{"choice_id": "'), letter, F.lit('"}\n```'))).when(kind == 1, F.concat(F.lit("I say choice_id = "), letter)).when(kind == 2, F.concat(F.lit(" ("), letter, F.lit(") "))).when(kind == 3, F.lit('{"choice_id": "Z"}')).otherwise(F.lit("no idea at all"))
    return read(spark, sf_dir, "events").select("event_id", text.parse_choice(reply, F.array(*map(F.lit, "ABCD"))).alias("choice"))


@R.query("parse_session_ts", "SELECT event_id, date_trunc('second', ts) AS at FROM events")
def parse_session_ts(spark, sf_dir):
    said = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy/MM/dd (EEE) HH:mm:ss")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return read(spark, sf_dir, "events").select("event_id", text.parse_session_time(said).cast("timestamp_ntz").alias("at"))


@R.query("normalize_source_id", "SELECT event_id, CAST(least(5000, CASE event_id % 4 WHEN 3 THEN 0 ELSE event_id END) AS BIGINT) AS source_id FROM events")
def normalize_source_id(spark, sf_dir):
    i = F.col("event_id").cast("string")
    said = F.when(F.col("event_id") % 4 == 0, i).when(F.col("event_id") % 4 == 1, F.concat(i, F.lit(".0"))).when(F.col("event_id") % 4 == 2, F.concat(i, F.lit("-x"))).otherwise(F.lit("none"))
    return read(spark, sf_dir, "events").select("event_id", text.source_id(said, 5000).cast("long").alias("source_id"))


@R.query("parse_file", r"SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g'))) AS text_md5 FROM pages")
def parse_file(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.md5(text.html_text(F.col("html")).cast("binary")).alias("text_md5"))


@R.query("tail_budget", "WITH " + history.SESSIONS + " SELECT session_id, round(t, 4) AS tail_cost FROM (SELECT session_id, sum(value) OVER (PARTITION BY user_id ORDER BY session_index DESC) AS t FROM sessions) x WHERE t <= 400")
def tail_budget(spark, sf_dir):
    return folds.tail_budget(history.lifelines(spark, sf_dir), "user_id", "session_index", "value", 400).select("session_id", F.round("tail_cost", 4).alias("tail_cost"))


PACK = "WITH RECURSIVE " + history.SESSIONS + ", c AS (SELECT user_id, session_index AS i, CAST(10 + event_id % 37 AS BIGINT) AS cost FROM sessions), w(user_id, i, chunk, used) AS (SELECT user_id, i, CAST(0 AS BIGINT), cost FROM c WHERE i = 0 UNION ALL SELECT c.user_id, c.i, w.chunk + CASE WHEN w.used + c.cost > 100 THEN 1 ELSE 0 END, CASE WHEN w.used + c.cost > 100 THEN c.cost ELSE w.used + c.cost END FROM w JOIN c ON c.user_id = w.user_id AND c.i = w.i + 1) SELECT user_id, CAST(i AS BIGINT) AS session_index, chunk FROM w"


@R.query("greedy_pack", PACK)
def greedy_pack(spark, sf_dir):
    rows = history.lifelines(spark, sf_dir).select("user_id", F.struct(F.col("session_index").cast("long").alias("ord"), (10 + F.col("event_id") % 37).alias("cost")).alias("x"))
    packed = rows.groupBy("user_id").agg(folds.greedy_pack(F.sort_array(F.collect_list("x")), 100).alias("out"))
    return packed.select("user_id", F.explode("out").alias("o")).select("user_id", F.col("o.ord").alias("session_index"), "o.chunk")


@R.query("ema_reward", "WITH RECURSIVE " + history.SESSIONS + ", q(user_id, i, q) AS (SELECT user_id, session_index, 0.3 * value FROM sessions WHERE session_index = 0 UNION ALL SELECT s.user_id, s.session_index, q.q + 0.3 * (s.value - q.q) FROM q JOIN sessions s ON s.user_id = q.user_id AND s.session_index = q.i + 1) SELECT user_id, round(arg_max(q, i), 5) AS q, count(*) AS visits FROM q GROUP BY user_id")
def ema_reward(spark, sf_dir):
    rows = history.lifelines(spark, sf_dir).groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("session_index", "value"))).alias("r"))
    return rows.select("user_id", F.round(folds.ema(F.transform("r", lambda x: x["value"]), 0.3), 5).alias("q"), F.size("r").cast("long").alias("visits"))


@R.query("time_window_summary", "WITH RECURSIVE " + history.SESSIONS + ", t AS (SELECT user_id, session_index AS i, CAST(epoch(ts) AS DOUBLE) AS t FROM sessions), w(user_id, i, t, o) AS (SELECT user_id, i, t, t FROM t WHERE i = 0 UNION ALL SELECT t.user_id, t.i, t.t, CASE WHEN t.t > w.o + 86400 THEN t.t ELSE w.o END FROM w JOIN t ON t.user_id = w.user_id AND t.i = w.i + 1) SELECT user_id, count(DISTINCT o) AS n_windows, count(*) AS n_rows, round(max(o), 3) AS last_open FROM w GROUP BY user_id")
def time_window_summary(spark, sf_dir):
    """Windows anchored at the first row that none covers; gaps are jumped."""
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    rows = history.lifelines(spark, sf_dir).groupBy("user_id").agg(F.sort_array(F.collect_list(seconds)).alias("t"))
    opened = rows.select("user_id", F.size("t").cast("long").alias("n_rows"), F.transform(folds.anchored_windows(F.col("t"), 86400.0), lambda x: x["open"]).alias("o"))
    return opened.select("user_id", F.size(F.array_distinct("o")).cast("long").alias("n_windows"), "n_rows", F.round(F.array_max("o"), 3).alias("last_open"))


@R.query("adjacent_similarity", "WITH s AS (SELECT a.vec_id, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))) AS sim FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id = (SELECT max(c.vec_id) FROM embeddings c WHERE c.label = a.label AND c.vec_id < a.vec_id)) SELECT vec_id, round(sim, 6) AS sim, sim < 0.2 AS boundary FROM s")
def adjacent_similarity(spark, sf_dir):
    from annalist.operators.vectors import cosine

    before = F.lag("embedding").over(Window.partitionBy("label").orderBy("vec_id"))
    rows = read(spark, sf_dir, "embeddings").withColumn("before", before).filter("before IS NOT NULL")
    sim = cosine(F.col("embedding"), F.col("before"), 0.0)
    return rows.select("vec_id", F.round(sim, 6).alias("sim"), (sim < 0.2).alias("boundary"))


R.statement("local_maxima", "SELECT event_id FROM (SELECT event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p, lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM {events}) x WHERE value > p AND value > n")
R.statement("snap_boundaries", "WITH " + history.SESSIONS + ", f AS (SELECT user_id, session_index AS i FROM sessions WHERE value > 60), c AS (SELECT user_id, session_index AS i FROM sessions WHERE domain = 'error'), k AS (SELECT f.user_id, f.i, max(CASE WHEN abs(f.i - c.i) <= 3 THEN 1 ELSE 0 END) AS near FROM f LEFT JOIN c ON c.user_id = f.user_id GROUP BY f.user_id, f.i), a AS (SELECT user_id, max(near) AS any_near FROM k GROUP BY user_id) SELECT k.user_id, CAST(k.i AS BIGINT) AS boundary FROM k JOIN a ON a.user_id = k.user_id WHERE near = 1 OR any_near = 0")
R.statement("seq_timestamps", "SELECT conv_id, turn, CAST((ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn) - 1) * 500 AS BIGINT) AS offset_ms FROM {conversations}")

@R.query("alternating_seq", "SELECT conv_id, turn, CAST(ROW_NUMBER() OVER (ORDER BY conv_id, turn, role) - 1 AS BIGINT) AS seq FROM conversations")
def alternating_seq(spark, sf_dir):
    return dedup.numbered(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "seq", "conv_id", "turn", "role").select("conv_id", "turn", "seq")


R.statement("segment_fallback", "SELECT conv_id, turn, CAST(floor(turn / 6) AS BIGINT) AS segment FROM {conversations}")
R.statement("segment_bank", "SELECT 'turn' AS granularity, conv_id, count(*) AS n FROM {conversations} GROUP BY conv_id UNION ALL SELECT 'segment', conv_id, count(DISTINCT floor(turn / 6)) FROM {conversations} GROUP BY conv_id UNION ALL SELECT 'session', conv_id, 1 FROM {conversations} GROUP BY conv_id")
R.statement("window_tier", "WITH n AS (SELECT doc_id, floor(length(text) / 3.0) AS n FROM {documents}) SELECT doc_id, CASE WHEN n <= 512 THEN '512' WHEN n <= 1024 THEN '1k' WHEN n <= 4096 THEN '4k' WHEN n <= 8192 THEN '8k' ELSE 'too long' END AS tier FROM n")
R.statement("context_fit", "SELECT doc_id, substr(text, 1, CAST(3 * (200 - 40 - 8) AS INT)) AS shown FROM {documents}")
R.statement("doc_budget", "WITH d AS (SELECT source, doc_id, floor(length(text) / 3.0) AS n, sum(floor(length(text) / 3.0)) OVER (PARTITION BY source ORDER BY doc_id) AS t FROM {documents}) SELECT doc_id, CAST(CASE WHEN t <= 5000 THEN n ELSE 5000 - (t - n) END AS BIGINT) AS shown FROM d WHERE t <= 5000 OR (t - n < 5000 AND 5000 - (t - n) > 100)")
R.statement("normalize_entity", "SELECT p_partkey, replace(lower(p_name), ' ', '_') AS entity FROM {part}")
R.statement("md5_text", "SELECT doc_id, md5(text) AS digest FROM {documents}")
R.statement("detect_lang", "SELECT doc_id, CASE WHEN length(regexp_replace(text, '[一-鿿]', '')) < 0.7 * length(text) THEN 'zh' ELSE 'en' END AS script FROM {documents}", "SELECT doc_id, CASE WHEN length(regexp_replace(text, '[一-鿿]', '', 'g')) < 0.7 * length(text) THEN 'zh' ELSE 'en' END AS script FROM documents")
R.statement("compaction_limits", "SELECT a.attempt, CASE a.attempt WHEN 0 THEN 8192 WHEN 1 THEN 4096 ELSE 2048 END AS tokens FROM (SELECT DISTINCT CAST(event_id % 4 AS INT) AS attempt FROM {events}) a")


@R.query("entropy_keep", "WITH w AS (SELECT doc_id, generate_subscripts(w, 1) AS pos, unnest(w) AS word, len(w) AS size FROM (SELECT doc_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM documents) d), c AS (SELECT word, count(*) AS n FROM w GROUP BY word), t AS (SELECT count(*) AS total FROM w), r AS (SELECT w.doc_id, pos, w.word, size, ROW_NUMBER() OVER (PARTITION BY w.doc_id ORDER BY n, pos) AS k FROM w JOIN c ON c.word = w.word) SELECT doc_id, count(*) AS n_kept, md5(string_agg(word, ' ' ORDER BY pos)) AS kept_md5 FROM r WHERE k <= ceil(0.6 * size) GROUP BY doc_id")
def entropy_keep(spark, sf_dir):
    """Of each text the six tenths of its words with the most information (-log2 of their share of all words), in their order.

    The share falls with the count, so words are ranked by counts over the whole table; ties by place.
    """
    words = read(spark, sf_dir, "documents").select("doc_id", F.filter(F.split("text", " "), lambda x: x != "").alias("w"))
    placed = words.select("doc_id", F.size("w").alias("size"), F.posexplode("w").alias("pos", "word"))
    counts = placed.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("n", "pos"))
    best = placed.join(counts, "word").withColumn("k", rank).filter(F.col("k") <= F.ceil(F.col("size") * F.expr("0.6BD")))
    kept = best.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("kept"))
    return kept.select("doc_id", F.size("kept").cast("long").alias("n_kept"), F.md5(F.array_join(F.transform("kept", lambda x: x["word"]), " ").cast("binary")).alias("kept_md5"))


R.statement("tumbling_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM {events} GROUP BY 1, 2")


@R.query("session_windows", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def session_windows(spark, sf_dir):
    """Beyond what the memory methods have: event-time sessions."""
    rows = read(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return rows.groupBy("user_id", F.session_window("at", "2 hours").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")
