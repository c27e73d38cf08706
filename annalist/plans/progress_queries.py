"""Queries of learned values, segments, expiry, resumed runs and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalist.operators import carried, paging, resume
from annalist.plans import history
from annalist.plans.store_queries import GRAPH, edges
from annalist.registry import Registry, read
from annalist.streaming import segments

R = Registry()


@R.query("ema_q", "WITH RECURSIVE " + history.SESSIONS + """,
v(user_id, i, q, n, ma, r) AS (SELECT DISTINCT user_id, CAST(-1 AS BIGINT), list_transform(range(8), lambda x: CAST(NULL AS DOUBLE)), list_transform(range(8), lambda x: CAST(0 AS BIGINT)), list_transform(range(8), lambda x: CAST(0 AS DOUBLE)), list_transform(range(8), lambda x: CAST(NULL AS DOUBLE)) FROM sessions
 UNION ALL SELECT v.user_id, v.i + 1, list_transform(v.q, lambda x, k: CASE WHEN k = s.m THEN greatest(CAST(0.1 AS DOUBLE), CAST(0.7 AS DOUBLE) * coalesce(x, 0.2) + CAST(0.3 AS DOUBLE) * (s.reward + CAST(0.5 AS DOUBLE) * coalesce(list_max(v.q), 0))) ELSE x END), list_transform(v.n, lambda x, k: CASE WHEN k = s.m THEN x + 1 ELSE x END), list_transform(v.ma, lambda x, k: CASE WHEN k = s.m THEN CAST(0.7 AS DOUBLE) * x + CAST(0.3 AS DOUBLE) * s.reward ELSE x END), list_transform(v.r, lambda x, k: CASE WHEN k = s.m THEN s.reward ELSE x END)
 FROM v JOIN (SELECT user_id, session_index, event_id % 8 + 1 AS m, value / 97 - 1 AS reward FROM sessions) s ON s.user_id = v.user_id AND s.session_index = v.i + 1),
l AS (SELECT user_id, max(i) AS i FROM v GROUP BY user_id), e AS (SELECT v.user_id, unnest(range(8)) AS memory_id, unnest(q) AS q, unnest(n) AS visits, unnest(ma) AS reward_mean, unnest(r) AS last_reward FROM v JOIN l USING (user_id, i))
SELECT user_id, memory_id, round(q, 6) AS q, visits, round(reward_mean, 6) AS reward_mean, round(last_reward, 6) AS last_reward FROM e WHERE visits > 0""")  # fmt: skip
def ema_q(spark, sf_dir):
    rows = history.lifelines(spark, sf_dir).select("user_id", F.col("session_index").alias("ord"), (F.col("event_id") % 8).alias("memory_id"), (F.col("value") / 97 - 1).alias("reward"))
    done = carried.learned_values(rows, 0.3, 0.5, first=0.2, floor=0.1)
    return done.select("user_id", "memory_id", F.round("q", 6).alias("q"), "visits", F.round("reward_mean", 6).alias("reward_mean"), F.round("last_reward", 6).alias("last_reward"))


@R.query("incremental_segment", """WITH RECURSIVE w AS (SELECT conv_id, turn, list_sort(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{6,}'))) AS words, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
s(conv_id, turn, k, segment, held) AS (SELECT conv_id, turn, k, CAST(0 AS BIGINT), words FROM w WHERE k = 1
 UNION ALL SELECT w.conv_id, w.turn, w.k, CASE WHEN 100 * len(list_intersect(w.words, s.held)) >= 20 * len(w.words) THEN s.segment ELSE s.segment + 1 END, CASE WHEN 100 * len(list_intersect(w.words, s.held)) >= 20 * len(w.words) THEN list_distinct(list_concat(s.held, w.words)) ELSE w.words END FROM s JOIN w ON w.conv_id = s.conv_id AND w.k = s.k + 1)
SELECT conv_id, turn, segment FROM s""")  # fmt: skip
def incremental_segment(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("ord"), segments.words_of(F.col("text")).alias("words"))
    return segments.segmented(rows).select(F.col("key").alias("conv_id"), F.col("ord").alias("turn"), "segment")


@R.query("ttl_delete", """WITH g AS (SELECT user_id, event_type, ts, event_id, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) + INTERVAL 3 DAY THEN 0 ELSE 1 END AS opens FROM events),
i AS (SELECT *, sum(opens) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS life FROM g)
SELECT user_id, event_type, min(ts) AS started, max(ts) + INTERVAL 3 DAY AS ends, count(*) AS n_updates, max(ts) + INTERVAL 3 DAY <= (SELECT max(ts) FROM events) AS expired FROM i GROUP BY user_id, event_type, life""")  # fmt: skip
def ttl_delete(spark, sf_dir):
    """A user's record of each type lives for three days from its last update; what has expired at the last event."""
    rows = read(spark, sf_dir, "events")
    now = rows.agg(F.max("ts").alias("_now"))
    done = segments.lives(rows, ["user_id", "event_type"], "ts", "3 days").crossJoin(F.broadcast(now))  # one row
    return done.withColumn("expired", F.col("ends") <= F.col("_now")).drop("_now")


CANON = """t AS (SELECT event_id, user_id, '{"a":[1,' || (event_id % 5) || '],"b":{"k":' || regexp_extract(props, '[0-9]+') || ',"t":"' || event_type || '"}}' AS config FROM events),
ids AS (SELECT *, sha256(length(config) || ':' || config) AS identity FROM t)"""


def configured(spark, sf_dir):
    """Jobs with their configuration, and the same with keys in another order and blanks, as an earlier run wrote it."""
    rows = read(spark, sf_dir, "events").select("event_id", "user_id", F.get_json_object("props", "$.k").alias("k"), "event_type")
    now = F.format_string('{"b": {"t": "%s", "k": %s}, "a": [1, %d]}', "event_type", "k", F.col("event_id") % 5)
    was = F.format_string('{ "a":[ 1,%d ],"b":{"k":%s,"t":"%s"}}', F.col("event_id") % 5, "k", "event_type")
    return rows.select("event_id", "user_id", resume.identity(now).alias("identity")), rows.select("event_id", "user_id", was.alias("was"))


@R.query("resume_checkpoint", "WITH " + CANON + " SELECT event_id, identity, event_id % 7 <> 0 AND event_id % 11 <> 0 AND event_id % 13 <> 0 AS reused, CASE WHEN event_id % 7 <> 0 AND event_id % 11 <> 0 AND event_id % 13 <> 0 THEN 'r' || event_id END AS result FROM ids")
def resume_checkpoint(spark, sf_dir):
    """Of an earlier run a seventh had another configuration, an eleventh no result, and the result of a thirteenth is damaged."""
    jobs, was = configured(spark, sf_dir)
    other = F.when(F.col("event_id") % 7 == 0, F.replace(F.col("was"), F.lit('"t"'), F.lit('"T"'))).otherwise(F.col("was"))
    kept = resume.stored(was.filter("event_id % 11 <> 0").select("event_id", resume.identity(other).alias("identity"), F.concat(F.lit("r"), "event_id").alias("result")))
    kept = kept.withColumn("result", F.when(F.col("event_id") % 13 == 0, F.concat("result", F.lit("?"))).otherwise(F.col("result")))
    return resume.resumed(jobs, kept, "event_id").select("event_id", "identity", "reused", "result")


@R.query("resume_users", "WITH " + CANON + ", last AS (SELECT user_id, max(event_id) AS last FROM events GROUP BY user_id) SELECT event_id, user_id % 3 <> 0 AND user_id % 5 <> 1 AND user_id % 7 <> 2 AS reused, CASE WHEN user_id % 3 <> 0 AND user_id % 5 <> 1 AND user_id % 7 <> 2 THEN 'r' || event_id END AS result FROM ids JOIN last USING (user_id)")
def resume_users(spark, sf_dir):
    """Results that hold by user: some users have a changed job, some a job without a result, some a result of a job that is gone."""
    jobs, was = configured(spark, sf_dir)
    last = was.groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    at = lambda n, r: last.filter(F.col("user_id") % n == r).select(F.col("event_id").alias("_at"))
    marked = was.join(at(3, 0).withColumn("_changed", F.lit(True)), F.col("event_id") == F.col("_at"), "left").drop("_at")
    marked = marked.join(at(5, 1), F.col("event_id") == F.col("_at"), "left_anti")
    other = F.when(F.col("_changed"), F.concat("was", F.lit(" "), F.lit("[]"))).otherwise(F.col("was"))
    kept = marked.select("event_id", "user_id", resume.identity(other).alias("identity"), F.concat(F.lit("r"), "event_id").alias("result"))
    gone = last.filter("user_id % 7 = 2").select((-F.col("event_id") - 1).alias("event_id"), "user_id", F.lit("x").alias("identity"), F.lit("gone").alias("result"))
    return resume.resumed_groups(jobs, resume.stored(kept.unionByName(gone)), "user_id", "event_id").select("event_id", "reused", "result")


CURSOR = """base64(encode('["' || strftime({t}, '%Y-%m-%d %H:%M:%S.%f') || '","' || {e} || '"]'))"""


@R.query("page_index", "WITH n AS (SELECT ts, event_id, (ROW_NUMBER() OVER (ORDER BY ts, event_id) - 1) // 100 AS page FROM events), p AS (SELECT page, count(*) AS n_rows, arg_min({t: ts, e: event_id}, (ts, event_id)) AS a, arg_max({t: ts, e: event_id}, (ts, event_id)) AS z FROM n GROUP BY page) SELECT page, n_rows, " + CURSOR.format(t="a.t", e="a.e") + " AS first_cursor, " + CURSOR.format(t="z.t", e="z.e") + " AS last_cursor FROM p")
def page_index(spark, sf_dir):
    rows = read(spark, sf_dir, "events")
    return paging.page_index(paging.paged(rows, 100, "ts", "event_id"), "ts", "event_id")


@R.query("scan_graph_export", "WITH " + GRAPH + " SELECT src, dst, (ROW_NUMBER() OVER (ORDER BY src, dst) - 1) // 200 AS page FROM edges")
def scan_graph_export(spark, sf_dir):
    """All edges of the graph, each with its page."""
    return paging.paged(edges(spark, sf_dir).select("src", "dst").distinct(), 200, "src", "dst")


@R.query("keyset_pages", """WITH n AS (SELECT ts, event_id, ROW_NUMBER() OVER (ORDER BY ts, event_id) AS k, count(*) OVER () AS total FROM events), c AS (SELECT event_id AS cursor_id, k FROM n WHERE event_id % 20 = 0), o AS (SELECT * FROM n WHERE event_id % 20 <> 0),
r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY ts, event_id) AS own, count(*) OVER () AS own_total FROM o), b AS (SELECT c.cursor_id, c.k - (SELECT count(*) FROM c d WHERE d.k <= c.k) AS before FROM c)
SELECT cursor_id, 'after' AS direction, own - before AS rank, own_total > before + 5 AS has_more, event_id, ts FROM b JOIN r ON own BETWEEN before + 1 AND before + 5 UNION ALL SELECT cursor_id, 'before', before - own + 1, before > 5, event_id, ts FROM b JOIN r ON own BETWEEN before - 4 AND before""")  # fmt: skip
def keyset_pages(spark, sf_dir):
    """Pages of five in both directions from the cursors of every twentieth event, after those events were deleted."""
    rows = read(spark, sf_dir, "events")
    cursors = rows.filter("event_id % 20 = 0").select(F.col("event_id").alias("cursor_id"), paging.cursor(rows, "ts", "event_id").alias("cursor"))
    left = rows.filter("event_id % 20 <> 0")
    page = lambda back, name: paging.from_cursors(left, cursors, 5, "ts", "event_id", backwards=back).withColumn("direction", F.lit(name))
    both = page(False, "after").unionByName(page(True, "before"))
    return both.select("cursor_id", "direction", F.col("rank").cast("long").alias("rank"), "has_more", "event_id", "ts")


@R.query("keyset_between", """WITH a AS (SELECT min(ts) + (max(ts) - min(ts)) / 4 AS low, min(ts) + (max(ts) - min(ts)) / 2 AS high FROM events), w AS (SELECT event_id, ts, ROW_NUMBER() OVER (ORDER BY ts, event_id) - 1 AS k FROM events, a WHERE ts > low AND ts < high ORDER BY ts, event_id LIMIT 100), n AS (SELECT count(*) AS n FROM w)
SELECT event_id, ts FROM w, n WHERE k >= CASE WHEN n > 50 THEN greatest(0, n // 2 - 25) ELSE 0 END AND k < CASE WHEN n > 50 THEN greatest(0, n // 2 - 25) ELSE 0 END + 50""")  # fmt: skip
def keyset_between(spark, sf_dir):
    """A page of fifty between two places."""
    rows = read(spark, sf_dir, "events")
    low, high = rows.agg(F.min("ts"), F.max("ts")).first()
    place = lambda share: F.struct(F.lit(low + (high - low) / share).cast("timestamp_ntz"), F.lit(-1).cast("long"))
    return paging.between(rows, place(4), place(2), 50, "ts", "event_id").select("event_id", "ts")
