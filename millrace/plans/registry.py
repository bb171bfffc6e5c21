"""Queries of SURVEY §7.4: each runs library operators over the role tables; each has its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import addresses as A
from ..functions import delivery as D
from ..operators import journal as J
from .roles import JOURNAL_SQL, journal, millis, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: "Now" of the queries that need one: after all events, and within the orders.
EVENTS_NOW, ORDERS_NOW = 1_800_000_000_000, 900_000_000_000
ENDS = ["delivered", "bounced"]

#: Rows of large tables that one task joins and groups by key, whatever the input's size.
TASK_ROWS = 1 << 19


def query(sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql.replace("{journal}", JOURNAL_SQL).replace("{dead}", _DEAD_SQL)
        return f

    return register


_DEAD_SQL = """(SELECT shard, segment, id, bytes FROM (SELECT *, row_number() OVER (PARTITION BY shard, segment, id ORDER BY event_id) AS n
    FROM """ + JOURNAL_SQL + """ WHERE kind IN ('delivered', 'bounced')) WHERE n = 1)"""


def _dead(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = journal(spark, sf_dir).where(F.col("kind").isin(ENDS))
    # min_by keeps one row a key and task: no sort, no window
    return ends.groupBy("shard", "segment", "id").agg(F.min_by("bytes", "event_id").alias("bytes"))


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = journal(spark, sf_dir).groupBy("shard", "segment").agg(F.sum("bytes").alias("total_bytes"))
    dead = _dead(spark, sf_dir).groupBy("shard", "segment").agg(F.sum("bytes").alias("dead_bytes"), F.count("*").alias("tombstones"))
    return total.join(dead, ["shard", "segment"], "left").select("shard", "segment", "total_bytes", F.coalesce("dead_bytes", F.lit(0)).alias("dead_bytes"), F.coalesce("tombstones", F.lit(0)).alias("tombstones"))


_SEGMENTS_SQL = """(SELECT t.shard, t.segment, total_bytes, coalesce(dead_bytes, 0) AS dead_bytes, coalesce(tombstones, 0) AS tombstones FROM
    (SELECT shard, segment, CAST(sum(bytes) AS BIGINT) AS total_bytes FROM {journal} GROUP BY ALL) t LEFT JOIN
    (SELECT shard, segment, CAST(sum(bytes) AS BIGINT) AS dead_bytes, count(*) AS tombstones FROM {dead} GROUP BY ALL) d ON t.shard = d.shard AND t.segment = d.segment)"""


@query("SELECT shard, segment, CAST(sum(total_bytes) AS BIGINT) AS total_bytes, CAST(sum(dead_bytes) AS BIGINT) AS dead_bytes, CAST(sum(tombstones) AS BIGINT) AS tombstones FROM " + _SEGMENTS_SQL + " GROUP BY ROLLUP (shard, segment)")
def q01_queue_stats_rollup(spark, sf_dir):
    """Segment rows, shard totals and the grand total."""
    s = _segments(spark, sf_dir)
    return s.rollup("shard", "segment").agg(*(F.sum(c).cast("long").alias(c) for c in ("total_bytes", "dead_bytes", "tombstones")))


def _live(spark, sf_dir):
    """The last entry of each id that has not ended, with its attempts."""
    j = journal(spark, sf_dir)
    last = j.groupBy("shard", "id").agg(F.max_by(F.struct("kind", "ts_ms", "segment"), "event_id").alias("s"), F.count_if(F.col("kind") == "deferred").alias("attempts"), F.min(F.when(F.col("kind") == "append", F.col("ts_ms"))).alias("enqueue_ms"))
    return last.select("shard", "id", "s.kind", "s.ts_ms", "s.segment", "attempts", "enqueue_ms").where(~F.col("kind").isin(ENDS))


_LIVE_SQL = """(SELECT * FROM (SELECT shard, id, arg_max(kind, event_id) AS kind, arg_max(ts_ms, event_id) AS ts_ms, arg_max(segment, event_id) AS segment,
    count(*) FILTER (kind = 'deferred') AS attempts, min(ts_ms) FILTER (kind = 'append') AS enqueue_ms FROM {journal} GROUP BY ALL) WHERE kind NOT IN ('delivered', 'bounced'))"""


@query("SELECT id AS message_id, CASE WHEN kind = 'deferred' THEN 'deferred' ELSE 'ready' END AS state, CASE WHEN kind <> 'deferred' AND enqueue_ms IS NOT NULL THEN (1800000000000 - enqueue_ms) // 1000 END AS age_s, attempts, CASE WHEN kind = 'deferred' THEN strftime(make_timestamp(ts_ms * 1000 + 60000000), '%Y-%m-%dT%H:%M:%S.%gZ') END AS next_attempt, shard, segment FROM " + _LIVE_SQL)
def q02_queue_list(spark, sf_dir):
    """Live messages, oldest first and unknown ages last."""
    m = _live(spark, sf_dir)
    deferred = F.col("kind") == "deferred"
    age = F.when(~deferred, F.floor((F.lit(EVENTS_NOW) - F.col("enqueue_ms")) / 1000))
    rows = m.select(F.col("id").alias("message_id"), F.when(deferred, "deferred").otherwise("ready").alias("state"), age.alias("age_s"), "attempts", F.when(deferred, D.rfc3339(F.col("ts_ms") + 60_000)).alias("next_attempt"), "shard", "segment")
    return rows.orderBy(F.col("age_s").desc_nulls_last(), "message_id")


@query("SELECT id AS message_id, shard, segment, kind, attempts FROM " + _LIVE_SQL + " ORDER BY shard, id LIMIT 1")
def q03_queue_show(spark, sf_dir):
    """The first match in the order of shards."""
    return _live(spark, sf_dir).orderBy("shard", "id").limit(1).select(F.col("id").alias("message_id"), "shard", "segment", "kind", "attempts")


@query("SELECT id, arg_max(kind, event_id) AS kind, arg_max(segment, event_id) AS segment, max(event_id) AS lsn FROM {journal} GROUP BY id")
def q04_latest_state_fold(spark, sf_dir):
    return J.last_state(journal(spark, sf_dir).withColumn("lsn", F.col("event_id")), ["id"], "event_id", "kind", "segment", "lsn")


@query("SELECT segment, count(*) AS dead_records, CAST(sum(bytes) AS BIGINT) AS dead_bytes FROM {dead} GROUP BY segment")
def q05_dead_bytes_first_copy(spark, sf_dir):
    return _dead(spark, sf_dir).groupBy("segment").agg(F.count("*").alias("dead_records"), F.sum("bytes").alias("dead_bytes"))


@query("SELECT j.event_id, j.segment, j.id FROM {journal} j WHERE kind = 'append' AND NOT EXISTS (SELECT 1 FROM {dead} d WHERE d.segment = j.segment AND d.id = j.id)")
def q06_tombstone_antijoin(spark, sf_dir):
    heads = journal(spark, sf_dir).where("kind = 'append'").select("event_id", "segment", "id")
    return heads.join(_dead(spark, sf_dir).select("segment", "id"), ["segment", "id"], "left_anti").select("event_id", "segment", "id")


@query("""SELECT id, segment, event_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY segment, event_id) AS n FROM {journal} j WHERE kind = 'append'
    AND NOT EXISTS (SELECT 1 FROM {dead} d WHERE d.segment = j.segment AND d.id = j.id) AND NOT EXISTS (SELECT 1 FROM {journal} k WHERE k.kind = 'deferred' AND k.id = j.id AND k.segment = j.segment)) WHERE n = 1""")
def q07_undiscovered(spark, sf_dir):
    """Headers that no state names; the first copy of an id."""
    j = journal(spark, sf_dir)
    heads = j.where("kind = 'append'").select("id", "segment", "event_id")
    free = heads.join(_dead(spark, sf_dir).select("segment", "id"), ["segment", "id"], "left_anti")
    free = free.join(j.where("kind = 'deferred'").select("segment", "id"), ["segment", "id"], "left_anti")
    return free.groupBy("id").agg(F.min(F.struct("segment", "event_id")).alias("h")).select("id", "h.segment", "h.event_id")


@query("""SELECT l.l_orderkey AS id, l.l_linenumber AS generation, CASE WHEN o.o_orderkey IS NULL THEN 'new' WHEN l.l_linenumber > length(o.o_orderstatus) + 1 THEN 'relocation' ELSE 'drop' END AS verdict, count(*) AS n
    FROM lineitem l LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'O') o ON o.o_orderkey = l.l_orderkey GROUP BY ALL""")
def q08_generation_theta_join(spark, sf_dir):
    """A header is new, a relocation if its generation is higher than the tracked one, or dropped."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    # sizes of shuffled keys say little of the memory to sort and group them: tasks are as many as the rows need
    tasks = max(spark.sparkContext.defaultParallelism, -(-(lines.count() + orders.count()) // TASK_ROWS))
    tracked = orders.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"), (F.length("o_orderstatus") + 1).alias("known")).repartition(tasks, "l_orderkey")
    joined = lines.select("l_orderkey", "l_linenumber").repartition(tasks, "l_orderkey").join(tracked, "l_orderkey", "left")
    verdict = F.when(F.col("known").isNull(), "new").when(F.col("l_linenumber") > F.col("known"), "relocation").otherwise("drop")
    return joined.groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("generation"), verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query("""SELECT h.shard, CAST(sum(CASE WHEN h.segment > coalesce(c.segment, 0) THEN h.committed WHEN h.segment = coalesce(c.segment, 0) THEN greatest(h.committed - least(coalesce(c.off, 0), h.committed), 0) ELSE 0 END) AS BIGINT) AS lag_bytes
    FROM (SELECT shard, segment, CAST(sum(bytes) AS BIGINT) AS committed FROM {journal} GROUP BY ALL) h
    LEFT JOIN (SELECT shard, arg_max(segment, event_id) AS segment, arg_max(bytes, event_id) AS off FROM {journal} WHERE kind = 'limited' GROUP BY shard) c ON h.shard = c.shard GROUP BY h.shard""")
def q09_cursor_lag(spark, sf_dir):
    """Committed bytes that a shard's cursor, its last rate-limited entry, has not passed; without a cursor, all."""
    j = journal(spark, sf_dir)
    heads = j.groupBy("shard", "segment").agg(F.sum("bytes").alias("committed"))
    cursor = j.where("kind = 'limited'").groupBy("shard").agg(F.max_by(F.struct("segment", "bytes"), "event_id").alias("c")).select("shard", F.col("c.segment").alias("cs"), F.col("c.bytes").alias("off"))
    at, off = F.coalesce("cs", F.lit(0)), F.least(F.coalesce("off", F.lit(0)), F.col("committed"))
    lag = F.when(F.col("segment") > at, F.col("committed")).when(F.col("segment") == at, F.greatest(F.col("committed") - off, F.lit(0))).otherwise(0)
    return heads.join(F.broadcast(cursor), "shard", "left").groupBy("shard").agg(F.sum(lag).cast("long").alias("lag_bytes"))  # one row a shard


@query("SELECT count(*) FILTER (kind <> 'deferred') AS ready, count(*) FILTER (kind = 'deferred') AS delayed, greatest(0, (1800000000000 - min(enqueue_ms) FILTER (kind <> 'deferred')) // 1000) AS oldest_ready_s, greatest(0, (1800000000000 - min(ts_ms + 60000) FILTER (kind = 'deferred')) // 1000) AS overdue_s FROM " + _LIVE_SQL)
def q10_job_census(spark, sf_dir):
    m = _live(spark, sf_dir)
    late = lambda x: F.greatest(F.lit(0), F.floor((F.lit(EVENTS_NOW) - x) / 1000))
    deferred = F.col("kind") == "deferred"
    return m.agg(F.count_if(~deferred).alias("ready"), F.count_if(deferred).alias("delayed"), late(F.min(F.when(~deferred, F.col("enqueue_ms")))).alias("oldest_ready_s"), late(F.min(F.when(deferred, F.col("ts_ms") + 60_000))).alias("overdue_s"))


@query("SELECT o_orderkey AS id, (epoch_us(o_orderdate) // 1000) AS due_ms, CAST(least(greatest((epoch_us(o_orderdate) // 1000) - 0, 0), 60000) AS BIGINT) AS wake_ms FROM orders WHERE (epoch_us(o_orderdate) // 1000) <= 900000000000 ORDER BY due_ms, id LIMIT 100")
def q11_due_jobs_topk(spark, sf_dir):
    """The next due jobs: a bounded sort in every task."""
    due = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), millis("o_orderdate").alias("due_ms")).where(F.col("due_ms") <= ORDERS_NOW)
    return due.withColumn("wake_ms", F.least(F.greatest(F.col("due_ms"), F.lit(0)), F.lit(60_000)).cast("long")).orderBy("due_ms", "id").limit(100)


@query("SELECT o_orderkey AS id, (epoch_us(o_orderdate) // 1000) AS enqueue_ms, o_custkey AS sender FROM orders WHERE o_orderstatus = 'O' ORDER BY enqueue_ms, id LIMIT 256")
def q12_ready_topk(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
    return o.select(F.col("o_orderkey").alias("id"), millis("o_orderdate").alias("enqueue_ms"), F.col("o_custkey").alias("sender")).orderBy("enqueue_ms", "id").limit(256)


@query("SELECT s.shard, s.segment, s.total_bytes, s.dead_bytes FROM " + _SEGMENTS_SQL + " s WHERE dead_bytes < total_bytes AND dead_bytes >= total_bytes * 0.05 AND EXISTS (SELECT 1 FROM " + _LIVE_SQL + " l WHERE l.shard = s.shard)")
def q13_compaction_candidates(spark, sf_dir):
    """Segments dead enough but not fully, of shards with live jobs."""
    s = _segments(spark, sf_dir).where("dead_bytes < total_bytes AND dead_bytes >= total_bytes * 0.05")
    return s.join(_live(spark, sf_dir).select("shard").distinct(), "shard", "left_semi").select("shard", "segment", "total_bytes", "dead_bytes")


@query("SELECT shard, CAST(sum(dead_bytes) AS BIGINT) AS dead_bytes, CAST(greatest(sum(total_bytes) FILTER (segment < (SELECT max(event_id) // 100 FROM events)) - sum(dead_bytes), 0) AS BIGINT) AS live_bytes, count(*) FILTER (segment < (SELECT max(event_id) // 100 FROM events)) AS sealed FROM " + _SEGMENTS_SQL + " GROUP BY shard")
def q14_live_dead_totals(spark, sf_dir):
    """Sealed totals less all dead bytes, never below zero."""
    s = _segments(spark, sf_dir)
    last = journal(spark, sf_dir).agg(F.max("segment").alias("last"))
    sealed = F.col("segment") < F.col("last")
    return s.join(F.broadcast(last)).groupBy("shard").agg(F.sum("dead_bytes").alias("dead_bytes"), F.greatest(F.sum(F.when(sealed, F.col("total_bytes"))) - F.sum("dead_bytes"), F.lit(0)).alias("live_bytes"), F.count_if(sealed).alias("sealed"))


@query("SELECT conv_id, turn AS number, before FROM (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) WHERE turn - before <> 1")
def q15_gap_check(spark, sf_dir):
    return J.gaps(table(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id"], "turn")


@query("SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def q16_duplicate_ordinals(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("copies")).where("copies > 1")


@query("SELECT conv_id, coalesce(min(place) FILTER (turn <> place), count(*)) AS valid FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM conversations) GROUP BY conv_id")
def q17_valid_prefix(spark, sf_dir):
    return J.valid_prefix(table(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id"], "turn")


@query("""SELECT c_custkey, lower(n_name) AS domain, CASE WHEN lower(n_name) IN ('china', 'france') THEN 'reject' WHEN lower(n_name) IN ('germany', 'japan', 'china', 'brazil') THEN 'accept' ELSE 'reject' END AS verdict
    FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def q18_allow_deny_filter(spark, sf_dir):
    """A denied domain is rejected; with allow rules, all others than theirs too."""
    who = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.lower("n_name").alias("domain"))
    return allow_deny(who, spark.createDataFrame([("deny", "china"), ("deny", "france"), *(("allow", d) for d in ("germany", "japan", "china", "brazil"))], "action string, domain string"))


def allow_deny(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """rows (with domain, null if unparsable) with verdict; rules (action, domain) are a configuration, so they are broadcast."""
    marks = rules.groupBy(F.lower("domain").alias("domain")).agg(F.bool_or(F.col("action") == "deny").alias("_deny"), F.bool_or(F.col("action") == "allow").alias("_allow"))
    some = not rules.where("action = 'allow'").isEmpty()
    verdict = F.when(F.coalesce("_deny", F.lit(False)), "reject").when(F.lit(some) & ~F.coalesce("_allow", F.lit(False)), "reject").otherwise("accept")
    return rows.join(F.broadcast(marks), "domain", "left").select(*rows.columns, verdict.alias("verdict"))


@query("""SELECT host AS domain, count(*) AS n FROM (SELECT lower(regexp_extract('user@' || regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '^[A-Za-z0-9!#$%&''*+/=?^_`{|}~-]+(?:\\.[A-Za-z0-9!#$%&''*+/=?^_`{|}~-]+)*@([A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?(?:\\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?)*)$', 1)) AS host FROM pages) WHERE host <> '' GROUP BY host""")
def q19_domain_extract(spark, sf_dir):
    at = F.concat(F.lit(" <user@"), F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1), F.lit("> "))
    return table(spark, sf_dir, "pages").select(A.domain(at).alias("domain")).where("domain IS NOT NULL").groupBy("domain").agg(F.count("*").alias("n"))


@query("""SELECT page_id, host, CAST((host = 'example.com' OR (host LIKE '%.example.com' AND regexp_matches(host, '^[^.]+\\.example\\.com$')) OR regexp_matches(host, '^[^.]+\\.example\\.org$') OR regexp_matches(host, '^[^.]+\\.test$')) AS BOOLEAN) AS matched
    FROM (SELECT page_id, lower(regexp_replace(trim(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '\\.+$', '')) AS host FROM pages)""")
def q20_mx_pattern_match(spark, sf_dir):
    host = F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1)
    patterns = F.array(*(F.lit(p) for p in ("example.com", "*.example.com", "*.example.org.", "*.TEST")))
    return table(spark, sf_dir, "pages").select("page_id", A.dns_name(host).alias("host"), F.exists(patterns, lambda p: A.mx_matches(host, p)).alias("matched"))


@query("""SELECT code, outcome, count(*) AS n FROM (SELECT 400 + l_partkey % 200 AS code, CASE WHEN l_returnflag = 'R' THEN 'defer' WHEN l_returnflag = 'A' AND NOT (400 + l_partkey % 200 BETWEEN 400 AND 499 OR 400 + l_partkey % 200 IN (500, 501, 502, 503, 504, 521, 530, 550, 551, 552, 553, 554)) THEN 'bounce' ELSE 'defer' END AS outcome FROM lineitem) GROUP BY ALL""")
def q21_smtp_classify(spark, sf_dir):
    code = (F.lit(400) + F.col("l_partkey") % 200).cast("long")
    rows = table(spark, sf_dir, "lineitem").select(code.alias("code"), D.classify(F.col("l_returnflag") == "R", F.col("l_returnflag") == "A", code).alias("outcome"))
    return rows.groupBy("code", "outcome").agg(F.count("*").alias("n"))


@query("SELECT attempts, CAST(least(60 * pow(2, least(attempts, 24)), 86400) AS BIGINT) AS delay_s, CAST(60000 * pow(2, least(attempts, 10)) AS BIGINT) AS unreadable_ms, count(*) AS n FROM (SELECT l_orderkey, count(*) AS attempts FROM lineitem GROUP BY 1) GROUP BY ALL")
def q22_backoff_schedule(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("attempts")).groupBy("attempts").agg(F.count("*").alias("n"))
    return a.select("attempts", D.backoff_s(F.col("attempts")).alias("delay_s"), D.unreadable_backoff_ms(F.col("attempts")).alias("unreadable_ms"), "n")


@query("SELECT l_orderkey AS id, count(*) AS attempts FROM lineitem GROUP BY 1 HAVING count(*) >= 5")
def q23_retry_budget(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("attempts"))
    return a.where(D.exhausted(F.col("attempts")))


@query("""SELECT id, CASE WHEN left_n > 0 AND tried = 0 AND limited > 0 THEN 'rate_limited' WHEN left_n > 0 THEN 'deferred' WHEN bounced > 0 AND delivered = 0 THEN 'bounced' ELSE 'delivered' END AS outcome, left_n, wait_s
    FROM (SELECT l_orderkey AS id, count(*) FILTER (l_returnflag = 'N' OR l_quantity < 5) AS left_n, count(*) FILTER (l_quantity >= 5) AS tried, count(*) FILTER (l_quantity < 5) AS limited,
    count(*) FILTER (l_returnflag = 'R' AND l_quantity >= 5) AS delivered, count(*) FILTER (l_returnflag = 'A' AND l_quantity >= 5) AS bounced, CAST(max(l_linenumber) FILTER (l_quantity < 5) AS BIGINT) AS wait_s FROM lineitem GROUP BY 1)""")
def q24_outcome_reduction(spark, sf_dir):
    """Recipients' outcomes to the message's: one pass, no history gathered."""
    limited, flag = F.col("l_quantity") < 5, F.col("l_returnflag")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.when(limited, "limited").when(flag == "N", "deferred").when(flag == "A", "bounced").otherwise("delivered").alias("outcome"), F.when(limited, F.col("l_linenumber")).cast("long").alias("wait_s"))
    return reduce_outcomes(rows)


def reduce_outcomes(rows: DataFrame) -> DataFrame:
    """id, outcome (of the message), left_n, wait_s from recipients' id, outcome and wait_s."""
    n = lambda *kinds: F.count_if(F.col("outcome").isin(*kinds))
    sums = rows.groupBy("id").agg(n("limited", "deferred").alias("left_n"), n("deferred", "bounced", "delivered").alias("tried"), n("limited").alias("limited"), n("delivered").alias("delivered"), n("bounced").alias("bounced"), F.max("wait_s").alias("wait_s"))
    outcome = F.when((F.col("left_n") > 0) & (F.col("tried") == 0) & (F.col("limited") > 0), "rate_limited").when(F.col("left_n") > 0, "deferred").when((F.col("bounced") > 0) & (F.col("delivered") == 0), "bounced").otherwise("delivered")
    return sums.select("id", outcome.alias("outcome"), "left_n", "wait_s")


@query("SELECT l_orderkey AS id, array_to_string(list_sort(list_distinct(list_concat(list(CAST(l_suppkey AS VARCHAR)), list(CAST(l_partkey % 10 AS VARCHAR))))), ',') AS recipients FROM lineitem GROUP BY 1")
def q25_recipient_union_distinct(spark, sf_dir):
    sets = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set(F.col("l_suppkey").cast("string")).alias("to"), F.collect_set((F.col("l_partkey") % 10).cast("string")).alias("cc"))
    return sets.select("id", F.array_join(F.array_sort(F.array_union("to", "cc")), ",").alias("recipients"))


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def q26_orphans(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 1 ELSE greatest(l.quality + l.toxic, 1) END AS attempts, d.source = 'src0' OR coalesce(l.toxic, 0) > 0 AS deferred FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def q27_meta_semijoin_attempts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    m = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic", F.lit(True).alias("has"))
    attempts = F.when(F.col("has").isNull(), 1).otherwise(F.greatest(F.col("quality") + F.col("toxic"), F.lit(1)))
    return d.join(m, "doc_id", "left").select("doc_id", attempts.alias("attempts"), ((F.col("source") == "src0") | (F.coalesce("toxic", F.lit(0)) > 0)).alias("deferred"))


@query("""SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN EXISTS (SELECT 1 FROM (SELECT doc_id FROM labels WHERE quality = 1 UNION SELECT doc_id FROM documents WHERE source = 'src1') p WHERE p.doc_id = d.doc_id) THEN 'skipped' ELSE 'migrated' END AS outcome FROM documents d) GROUP BY outcome""")
def q28_migration_dedupe(spark, sf_dir):
    """What is there already is skipped."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    present = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").union(d.where("source = 'src1'").select("doc_id")).distinct().withColumn("there", F.lit(True))
    return d.join(present, "doc_id", "left").groupBy(F.when(F.col("there"), "skipped").otherwise("migrated").alias("outcome")).agg(F.count("*").alias("n"))


@query("SELECT sha256(text) AS body, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1")
def q29_copy_counts(spark, sf_dir):
    # by digest: bodies are not shuffled
    return table(spark, sf_dir, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("body")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


@query("SELECT lower(n_name) AS domain, CASE l_returnflag WHEN 'R' THEN 'success' ELSE 'failure' END AS status, count(*) AS attempts, any_value(CASE lower(n_name) WHEN 'china' THEN 5 WHEN 'france' THEN 0 ELSE 2 END) AS domain_limit FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2")
def q30_send_attempts_by_domain(spark, sf_dir):
    limits = F.create_map(F.lit("china"), F.lit(5), F.lit("france"), F.lit(0))
    who = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.lower("n_name").alias("domain"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(who, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "domain")
    # attempts are added up by order and status before they meet the orders
    tries = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.when(F.col("l_returnflag") == "R", "success").otherwise("failure").alias("status")).agg(F.count("*").alias("n"))
    sums = tries.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("domain", "status").agg(F.sum("n").alias("attempts"))
    return sums.select("domain", "status", "attempts", F.coalesce(F.try_element_at(limits, F.col("domain")), F.lit(2)).alias("domain_limit"))


@query("""SELECT flag, le, CAST(n AS BIGINT) AS n, CAST(total AS BIGINT) AS total FROM (SELECT l_returnflag AS flag, sum(d) AS total, unnest(['0', '30', '90', '365', '+Inf']) AS le, unnest([count(*) FILTER (d <= 0), count(*) FILTER (d <= 30), count(*) FILTER (d <= 90), count(*) FILTER (d <= 365), count(*)]) AS n
    FROM (SELECT l_returnflag, greatest(0, (epoch_us(l_shipdate) // 1000) - (epoch_us(o_orderdate) // 1000)) // 86400000 AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY 1)""")
def q31_latency_histogram(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), millis("o_orderdate").alias("queued"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("flag"), millis("l_shipdate").alias("logged")).join(o, "l_orderkey")
    rows = rows.select("flag", F.floor(D.delay_ms(F.col("queued"), F.col("logged")) / 86_400_000).alias("days"))
    return J.histogram(rows, ["flag"], "days", [0, 30, 90, 365])


@query("SELECT id, CAST(list_reduce(list_prepend(0, list(d ORDER BY event_id)), lambda a, x: greatest(0, a + x)) AS BIGINT) AS depth FROM (SELECT id, event_id, CASE WHEN kind IN ('append', 'deferred') THEN 1 WHEN kind IN ('delivered', 'bounced') THEN -1 ELSE 0 END AS d FROM {journal}) GROUP BY id")
def q32_queue_depth_saturating(spark, sf_dir):
    j = journal(spark, sf_dir).withColumn("d", F.when(F.col("kind").isin("append", "deferred"), 1).when(F.col("kind").isin(ENDS), -1).otherwise(0))
    return J.saturating_depth(j, ["id"], "event_id", "d")


@query("""SELECT id, CAST(b[4] AS BIGINT) AS allowed, CAST(b[5] AS BIGINT) AS limited, CAST(b[2] AS BIGINT) AS tokens FROM (SELECT id, list_reduce(list_prepend([0, 3, list(t ORDER BY event_id)[1], 0, 0], list([t, 0, 0, 0, 0] ORDER BY event_id)), lambda a, x: [0,
      least(3, a[2] + CASE WHEN x[1] - a[3] >= 1000 THEN (x[1] - a[3]) * 3 // 60000 ELSE 0 END) - CASE WHEN least(3, a[2] + CASE WHEN x[1] - a[3] >= 1000 THEN (x[1] - a[3]) * 3 // 60000 ELSE 0 END) > 0 THEN 1 ELSE 0 END,
      CASE WHEN x[1] - a[3] >= 1000 AND (x[1] - a[3]) * 3 // 60000 > 0 THEN x[1] ELSE a[3] END,
      a[4] + CASE WHEN least(3, a[2] + CASE WHEN x[1] - a[3] >= 1000 THEN (x[1] - a[3]) * 3 // 60000 ELSE 0 END) > 0 THEN 1 ELSE 0 END,
      a[5] + CASE WHEN least(3, a[2] + CASE WHEN x[1] - a[3] >= 1000 THEN (x[1] - a[3]) * 3 // 60000 ELSE 0 END) > 0 THEN 0 ELSE 1 END]) AS b FROM (SELECT id, event_id, ts_ms // 10000 AS t FROM {journal}) GROUP BY id)""")
def q33_token_bucket(spark, sf_dir):
    """Arrivals in compressed time (a ten-thousandth), three a minute."""
    j = journal(spark, sf_dir).select("id", "event_id", F.expr("ts_ms div 10000").alias("t"))
    return J.token_bucket(j, ["id"], ["event_id"], "t", 3)


@query("""SELECT shard, CAST(p[1] AS BIGINT) AS segments, CAST(p[2] AS BIGINT) AS active_bytes, CAST(p[3] AS BIGINT) AS largest_segment FROM (SELECT shard, list_reduce(list_prepend([1, 0, 0], list([n, 0, 0] ORDER BY doc_id)), lambda a, x: CASE WHEN a[2] > 0 AND a[2] + x[1] > 65536 THEN [a[1] + 1, x[1], greatest(a[3], x[1])] ELSE [a[1], a[2] + x[1], greatest(a[3], a[2] + x[1])] END) AS p
    FROM (SELECT doc_id % 8 AS shard, doc_id, 60 + strlen(source) + 2 + strlen(lang) + strlen(text) AS n FROM documents) GROUP BY shard)""")
def q34_segment_packing(spark, sf_dir):
    """Each shard's own order of appends; shards are independent."""
    size = D.record_bytes(F.col("source"), F.array("lang"), F.octet_length("text"))
    return J.pack_segments(table(spark, sf_dir, "documents").select((F.col("doc_id") % 8).alias("shard"), "doc_id", size.alias("size")), ["shard"], "doc_id", "size", 1 << 16)


@query("SELECT o_orderkey AS id, CASE WHEN (epoch_us(o_orderdate) // 1000) < 850000000000 THEN 'bounced_expired' ELSE 'deferred_expired' END AS why FROM orders o WHERE (epoch_us(o_orderdate) // 1000) < 850000000000 OR (900000000000 - (epoch_us(o_orderdate) // 1000) >= 20000000000 AND o_orderstatus <> 'O' AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = o.o_orderkey))")
def q35_retention(spark, sf_dir):
    """Old bounces by age; deferred ones by their last attempt, unless they are being retried."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), millis("o_orderdate").alias("at"), "o_orderstatus")
    retried = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")).distinct().withColumn("busy", F.lit(True))
    old = F.col("at") < 850_000_000_000
    late = (F.lit(ORDERS_NOW) - F.col("at") >= 20_000_000_000) & (F.col("o_orderstatus") != "O") & F.col("busy").isNull()
    return o.join(retried, "id", "left").where(old | late).select("id", F.when(old, "bounced_expired").otherwise("deferred_expired").alias("why"))


@query("SELECT s_nationkey AS host, min(s_suppkey) FILTER (try_no = 1) AS first_mx, arg_max(s_name, try_no) FILTER (s_acctbal < 0) AS last_error, arg_min(s_name, try_no) FILTER (s_acctbal >= 0) AS used FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS try_no FROM supplier) GROUP BY 1")
def q36_mx_order(spark, sf_dir):
    """Exchanges by preference; the first that works is used, the last error is kept."""
    s = table(spark, sf_dir, "supplier").withColumn("try_no", F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_acctbal", "s_suppkey")))
    bad = F.col("s_acctbal") < 0
    return s.groupBy(F.col("s_nationkey").alias("host")).agg(F.min(F.when(F.col("try_no") == 1, F.col("s_suppkey"))).alias("first_mx"), F.max_by("s_name", F.when(bad, F.col("try_no"))).alias("last_error"), F.min_by("s_name", F.when(~bad, F.col("try_no"))).alias("used"))


@query("SELECT id, event_id, kind, greatest(0, ts_ms - min(ts_ms) OVER w) AS delay_ms, coalesce(ts_ms - lag(ts_ms) OVER (PARTITION BY id ORDER BY event_id), 0) AS since_last_ms FROM {journal} WINDOW w AS (PARTITION BY id)")
def q37_lifecycle_timeline(spark, sf_dir):
    j = journal(spark, sf_dir)
    first = F.min("ts_ms").over(Window.partitionBy("id"))
    last = F.lag("ts_ms").over(Window.partitionBy("id").orderBy("event_id"))
    return j.select("id", "event_id", "kind", D.delay_ms(first, F.col("ts_ms")).alias("delay_ms"), F.coalesce(F.col("ts_ms") - last, F.lit(0)).alias("since_last_ms"))


@query("SELECT shard, checkpoint, min(event_id) AS first_lsn, count(*) AS entries FROM (SELECT shard, event_id, CAST(sum(bytes) OVER (PARTITION BY shard ORDER BY event_id) // 262144 AS BIGINT) AS checkpoint FROM {journal}) GROUP BY ALL")
def q38_checkpoint_trigger(spark, sf_dir):
    run = F.sum("bytes").over(Window.partitionBy("shard").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0))
    j = journal(spark, sf_dir).select("shard", "event_id", F.floor(run / 262_144).alias("checkpoint"))
    return j.groupBy("shard", "checkpoint").agg(F.min("event_id").alias("first_lsn"), F.count("*").alias("entries"))


@query("""SELECT id, CASE WHEN s >= 86400 THEN (s // 86400) || 'd' || (s % 86400 // 3600) || 'h' WHEN s >= 3600 THEN (s // 3600) || 'h' || (s % 3600 // 60) || 'm' WHEN s >= 60 THEN (s // 60) || 'm' || (s % 60) || 's' ELSE s || 's' END AS age, printf('%.1f%%', CASE WHEN t > 0 THEN d / t * 100 ELSE 0 END) AS ratio
    FROM (SELECT o_orderkey AS id, greatest(900000000000 - (epoch_us(o_orderdate) // 1000), 0) // 1000 // (1 + o_orderkey % 100000) AS s, CAST(o_custkey % 97 AS DOUBLE) AS d, CAST(o_orderkey % 61 * 100 + 7 AS DOUBLE) AS t FROM orders)""")
def q39_humanize_age(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    seconds = F.floor(F.floor(F.greatest(F.lit(ORDERS_NOW) - millis("o_orderdate"), F.lit(0)) / 1000) / (1 + F.col("o_orderkey") % 100_000))
    return o.select(F.col("o_orderkey").alias("id"), D.age_text(seconds * 1000).alias("age"), D.ratio_text((F.col("o_custkey") % 97).cast("double"), (F.col("o_orderkey") % 61 * 100 + 7).cast("double")).alias("ratio"))


@query("""SELECT result, count(*) AS n FROM (SELECT CASE WHEN l.doc_id IS NULL THEN 'failure' WHEN d.lang = 'en' THEN 'skipped' WHEN l.quality = 1 THEN 'extended' ELSE 'refreshed' END AS result FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) GROUP BY result""")
def q40_policy_refresh(spark, sf_dir):
    """A cached policy without a record is kept as a failure, of mode none skipped, with the same id extended, else fetched."""
    m = table(spark, sf_dir, "labels").select("doc_id", "quality", F.lit(True).alias("has"))
    result = F.when(F.col("has").isNull(), "failure").when(F.col("lang") == "en", "skipped").when(F.col("quality") == 1, "extended").otherwise("refreshed")
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(m, "doc_id", "left").groupBy(result.alias("result")).agg(F.count("*").alias("n"))


@query("SELECT date_trunc('hour', ts) AS hour, event_type AS kind, count(*) AS n FROM events GROUP BY ALL")
def q41_hourly_outcomes(spark, sf_dir):
    """An extension: the reference has no time buckets."""
    return table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))



_FOLD_SQL = """(SELECT *, coalesce(last_value(CASE WHEN kind <> 'limited' THEN kind END IGNORE NULLS) OVER (PARTITION BY id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'deferred', false) AS live,
    count(*) FILTER (WHERE kind <> 'deferred') OVER (PARTITION BY id, segment ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 AS tombed FROM {journal} WHERE kind <> 'append')"""
_FOLD_DEAD_SQL = f"""(SELECT shard, segment, id, event_id, bytes FROM {_FOLD_SQL} WHERE kind IN ('delivered', 'bounced') OR (kind = 'limited' AND (NOT live OR bytes % 3 <> 0))
    UNION ALL SELECT shard, segment + 1000000, id, event_id, bytes FROM {_FOLD_SQL} WHERE kind = 'limited' AND CASE WHEN live THEN bytes % 3 = 0 ELSE tombed END)"""


def _folded(spark, sf_dir):
    """The fold of the whole journal; a rate-limited entry relocates the copy, to a generation that is not newer where its bytes divide by three."""
    j = journal(spark, sf_dir).where("kind <> 'append'")
    code = F.expr("CASE kind WHEN 'deferred' THEN 1 WHEN 'delivered' THEN 2 WHEN 'bounced' THEN 3 ELSE 4 END").alias("kind")
    place = lambda segment, generation: F.struct(segment.alias("segment"), F.col("event_id").alias("offset"), F.col("bytes").alias("length"), generation.alias("generation"))
    moved = place(F.col("segment") + 1_000_000, F.when(F.col("bytes") % 3 == 0, F.lit(0).cast("long")).otherwise(F.col("event_id") + 1))
    entries = j.select("shard", "id", F.col("segment").alias("journal"), F.col("event_id").alias("offset"), code, place(F.col("segment"), F.col("event_id")).alias("location"), (F.col("bytes") % 7).alias("attempts"), (F.col("ts_ms") + 60_000).alias("next_attempt_ms"), F.lit(None).cast("array<string>").alias("remaining"), F.lit(None).cast("string").alias("last_error"), moved.alias("new_location"))
    return J.fold(entries)


@query(f"""SELECT id, CASE WHEN last_kind = 'deferred' THEN 'deferred' END AS state, CASE WHEN last_kind = 'deferred' THEN segment END AS segment, CASE WHEN last_kind = 'deferred' THEN attempts END AS attempts, coalesce(dead_copies, 0) AS dead_copies, coalesce(dead_bytes, 0) AS dead_bytes
    FROM (SELECT id, arg_max(kind, event_id) FILTER (WHERE kind <> 'limited') AS last_kind, arg_max(bytes % 7, event_id) FILTER (WHERE kind = 'deferred') AS attempts,
        arg_max(CASE WHEN kind = 'limited' THEN segment + 1000000 ELSE segment END, event_id) FILTER (WHERE kind = 'deferred' OR (kind = 'limited' AND live AND bytes % 3 <> 0)) AS segment FROM {_FOLD_SQL} GROUP BY id)
    LEFT JOIN (SELECT id, count(*) AS dead_copies, CAST(sum(bytes) AS BIGINT) AS dead_bytes FROM {_FOLD_DEAD_SQL} GROUP BY id) USING (id)""")
def q42_journal_fold(spark, sf_dir):
    """The state of every message and its dead copies: deferrals, ends, revivals, relocations of live and of ended messages."""
    bytes_ = F.aggregate("dead", F.lit(0).cast("long"), lambda n, d: n + d["length"])
    return _folded(spark, sf_dir).select("id", "state", F.col("location.segment").alias("segment"), "attempts", F.size("dead").cast("long").alias("dead_copies"), bytes_.alias("dead_bytes"))


@query(f"SELECT shard, segment, count(*) AS dead_records, CAST(sum(bytes) AS BIGINT) AS dead_bytes FROM (SELECT shard, segment, id, arg_min(bytes, event_id) AS bytes FROM {_FOLD_DEAD_SQL} GROUP BY ALL) GROUP BY ALL")
def q43_fold_dead_by_segment(spark, sf_dir):
    """Dead records and bytes of every segment by the fold; of a message's copies in a segment the first counts."""
    return J.dead_by_segment(_folded(spark, sf_dir))


ORACLE_SQL = {k: v.replace("{journal}", JOURNAL_SQL).replace("{dead}", _DEAD_SQL) for k, v in ORACLE_SQL.items()}
