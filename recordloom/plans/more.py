"""Queries of outboxes, commands and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.operators import commands, evidence, folds
from recordloom.plans.queries import FNV, OUTBOX, UNITS_SQL, outbox, registered, sealed
from recordloom.sources.tables import read
from recordloom.streaming import outbox as boxes
from recordloom.streaming import projection

NTZ = "timestamp_ntz"


@registered(
    f"""WITH e AS (SELECT CAST(event_id AS VARCHAR) AS event_id, CASE WHEN event_id % 91 = 0 THEN '' ELSE 'User-' || user_id END AS record_id, 'shop.' || event_type AS type, event_id % 13 AS version, props AS payload FROM events)
SELECT event_id, CASE WHEN record_id = '' OR version = 0 THEN NULL ELSE {FNV.format("lower(record_id)", 16)} END AS partition,
 CASE WHEN record_id = '' THEN 'no_record' WHEN version = 0 THEN 'version' END AS reason, CASE WHEN NOT (record_id = '' OR version = 0) THEN sha256(CAST(event_id AS BLOB) || '\\x00'::BLOB || CAST(payload AS BLOB)) END AS digest FROM e"""
)
def outbox_emit(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("event_id"), F.when(F.col("event_id") % 91 == 0, "").otherwise(F.concat(F.lit("User-"), F.col("user_id").cast("string"))).alias("record_id"),
        F.concat(F.lit("shop."), "event_type").alias("type"), (F.col("event_id") % 13).alias("version"), F.lit("full").alias("kind"), F.col("props").alias("payload"), F.lit(0).alias("hops"),
    )
    good, refused = boxes.emitted(e, "shop.users", 16)
    none = F.lit(None)
    return good.select("event_id", "partition", none.cast("string").alias("reason"), "digest").unionByName(refused.select("event_id", none.cast("int").alias("partition"), "reason", none.cast("string").alias("digest")))


@registered(
    f"WITH {OUTBOX}, n AS (SELECT *, row_number() OVER (PARTITION BY partition ORDER BY event_id) AS seq FROM outbox), k AS (SELECT * FROM n WHERE seq > partition * 3), f AS (SELECT partition, min(seq) AS m FROM k WHERE seq > 10 GROUP BY partition) "
    "SELECT event_id, partition, seq, m > 11 AS reset FROM (SELECT *, row_number() OVER (PARTITION BY partition ORDER BY seq) AS p FROM k WHERE seq > 10) JOIN f USING (partition) WHERE p <= 40"
)
def outbox_read_after(spark: SparkSession, sf: str) -> DataFrame:
    rows = folds.numbered(outbox(spark, sf), ["partition"], ["event_id"]).where("seq > partition * 3")
    asked = spark.range(8).select(F.col("id").cast("int").alias("partition"), F.lit(10).cast("long").alias("after"))
    return boxes.read_after(rows, asked, 40).select("event_id", "partition", "seq", "reset")


@registered(f"WITH {OUTBOX}, n AS (SELECT *, row_number() OVER (PARTITION BY partition ORDER BY event_id) AS seq FROM outbox) SELECT event_id, partition, seq, seq = 60 AS last FROM n WHERE seq > 20 AND seq <= 60")
def outbox_pull(spark: SparkSession, sf: str) -> DataFrame:
    rows = folds.numbered(outbox(spark, sf), ["partition"], ["event_id"])
    parts = spark.range(8).select(F.col("id").cast("int").alias("partition"))
    return projection.pull_page(rows, parts.withColumn("after", F.lit(20)), parts.withColumn("echo", F.lit(60))).select("event_id", "partition", "seq", "last")


@registered(f"WITH {OUTBOX} SELECT partition, max(event_id) AS seq FROM outbox WHERE event_type <> 'view' AND ts < TIMESTAMP '2024-01-24' GROUP BY partition")
def outbox_purged(spark: SparkSession, sf: str) -> DataFrame:
    rows = outbox(spark, sf).select(F.lit("users").alias("stream"), "partition", F.when(F.col("event_type") != "view", F.col("ts")).alias("published_at"), F.struct("generation", F.lit(0).alias("timeline"), F.col("event_id").alias("seq")).alias("position"))
    return boxes.purged(rows, F.lit("2024-01-31").cast(NTZ))[1].select("partition", "purged.seq")


@registered(
    """WITH r AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'incomplete' WHEN 1 THEN 'complete' ELSE 'tombstone' END AS state, c_custkey % 7 AS version, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 7 END AS need FROM customer),
a AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'purged' WHEN 1 THEN 'tombstone' ELSE 'exists' END AS answer, c_nationkey % 9 AS found FROM customer WHERE c_custkey % 4 <> 0),
j AS (SELECT *, coalesce(state = 'incomplete' AND answer = 'exists' AND found >= need, FALSE) AS w, coalesce(state = 'incomplete' AND ((answer = 'tombstone' AND found >= version) OR answer = 'purged'), FALSE) AS g FROM r LEFT JOIN a USING (c_custkey))
SELECT CAST(c_custkey AS VARCHAR) AS record_id, CASE WHEN w THEN 'complete' WHEN g THEN 'tombstone' ELSE state END AS state, CAST(CASE WHEN w THEN found WHEN g AND answer = 'purged' THEN 0 WHEN g THEN found ELSE version END AS BIGINT) AS version, CASE WHEN NOT w AND NOT g THEN need END AS need_version FROM j"""
)
def fold_repair(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    customer, name = read(spark, sf, "customer"), k.cast("string").alias("record_id")
    rows = customer.select(name, F.when(k % 3 == 0, "incomplete").when(k % 3 == 1, "complete").otherwise("tombstone").alias("state"), (k % 7).alias("version"), F.when(k % 3 == 0, k % 7).alias("need_version"), F.lit("{}").alias("data"))
    answers = customer.where("c_custkey % 4 <> 0").select(name, F.when(k % 5 == 0, "purged").when(k % 5 == 1, "tombstone").otherwise("exists").alias("state"), (F.col("c_nationkey") % 9).alias("version"), F.lit("{}").alias("data"))
    return boxes.repaired(rows, answers).drop("data")


@registered(
    """WITH i AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'running' WHEN 'O' THEN 'pending' ELSE 'succeeded' END AS state, o_orderdate AS lease_until, o_orderdate + INTERVAL 30 DAY AS run_at FROM orders)
SELECT id, state FROM i WHERE (state = 'running' AND lease_until < TIMESTAMP '1996-01-01') OR (state IN ('pending', 'retry_wait') AND run_at <= TIMESTAMP '1996-01-01')
ORDER BY CASE WHEN state = 'running' AND lease_until < TIMESTAMP '1996-01-01' THEN 0 ELSE 1 END, CASE WHEN state = 'running' AND lease_until < TIMESTAMP '1996-01-01' THEN lease_until ELSE run_at END, id LIMIT 300"""
)
def work_claim(spark: SparkSession, sf: str) -> DataFrame:
    at = F.col("o_orderdate")
    items = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "running").when(F.col("o_orderstatus") == "O", "pending").otherwise("succeeded").alias("state"), at.alias("lease_until"), (at + F.expr("INTERVAL 30 DAYS")).alias("run_at"))
    return commands.claimable(items, F.lit("1996-01-01").cast(NTZ), 300).select("id", "state")


@registered(
    """WITH RECURSIVE e AS (SELECT user_id, ['hold-enough', 'confirm', 'consume-within', 'query', 'expire', 'cancel', 'consume-exact', 'hold-other'][event_id * 7919 % 1009 % 8 + 1] AS c, event_id % 5 = 0 AS past, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
r AS (SELECT user_id, CAST(0 AS BIGINT) AS n, 'absent' AS s, 0 AS changes FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL SELECT user_id, n, coalesce(move, s), changes + CASE WHEN move IS NULL THEN 0 ELSE 1 END FROM (SELECT e.user_id, e.n, s, changes, CASE WHEN c = 'hold-enough' AND s = 'absent' THEN 'held' WHEN c IN ('confirm', 'expire') AND s = 'held' AND past THEN 'expired'
    WHEN c = 'confirm' AND s = 'held' THEN 'committed' WHEN c = 'cancel' AND s = 'absent' THEN 'cancelled' WHEN c = 'cancel' AND s IN ('held', 'committed') THEN 'released' WHEN c = 'consume-exact' AND s = 'committed' THEN 'consumed' WHEN c = 'consume-within' AND s = 'committed' THEN 'committed' END AS move
    FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))
SELECT user_id AS branch, s AS state, changes FROM (SELECT *, max(n) OVER (PARTITION BY user_id) AS m FROM r) WHERE n = m"""
)
def reservation_fold(spark: SparkSession, sf: str) -> DataFrame:
    """Reservation branches after their command logs: one branch for each user, one command for each event."""
    names = "hold-enough confirm consume-within query expire cancel consume-exact hold-other".split()
    e = read(spark, sf, "events")
    log = e.select(F.col("user_id").alias("branch"), "event_id", F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("event_id") * 7919 % 1009 % len(names) + 1).cast("int")).alias("command"), (F.col("event_id") % 5 == 0).alias("past"))
    return commands.reservation_states(log, ["event_id"])


SENT = "claim before_send send_result query_found query_not_found query_unavailable lease_lost finality_passed".split()
RESULTS = "not_reached maybe_reached accepted succeeded processing".split()


@registered(
    f"""WITH RECURSIVE e AS (SELECT user_id || '/' || event_type AS k, event_id AS t, {SENT}[event_id * 7919 % 1009 % 8 + 1] AS e, {RESULTS}[event_id * 104729 % 1013 % 5 + 1] AS r, user_id % 2 = 0 AS q, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events),
c AS (SELECT k, CAST(0 AS BIGINT) AS n, 'prepared' AS s, '' AS why, CAST(NULL AS BIGINT) AS first_, CAST(NULL AS BIGINT) AS last_, CAST(NULL AS BIGINT) AS us, CAST(NULL AS BIGINT) AS sa FROM (SELECT DISTINCT k FROM e)
  UNION ALL SELECT k, n, split_part(o, '/', 1), split_part(o, '/', 2), CASE WHEN reached THEN coalesce(first_, t) ELSE first_ END, CASE WHEN reached THEN t ELSE last_ END,
    CASE WHEN o LIKE 'unknown/%' THEN CASE WHEN s = 'unknown' THEN us ELSE t END END, CASE WHEN o LIKE 'accepted/%' THEN CASE WHEN s = 'accepted' THEN sa ELSE t END END
  FROM (SELECT *, s = 'sending' AND (e = 'lease_lost' OR (e = 'send_result' AND r <> 'not_reached')) AS reached, CASE WHEN s IN ('succeeded', 'failed', 'rejected') THEN s || '/final' WHEN e = 'claim' AND s IN ('prepared', 'retry_wait') THEN CASE WHEN past THEN 'unknown/past_deadline' ELSE 'sending/claimed' END
      WHEN e = 'before_send' AND s = 'sending' THEN CASE WHEN past THEN 'unknown/past_deadline' ELSE 'sending/sent' END WHEN e = 'lease_lost' AND s = 'sending' THEN 'unknown/claimant_gone'
      WHEN e = 'send_result' AND s = 'sending' THEN CASE r WHEN 'not_reached' THEN 'retry_wait/not_processed' WHEN 'maybe_reached' THEN 'unknown/maybe_processed' WHEN 'accepted' THEN 'accepted/accepted' WHEN 'succeeded' THEN 'succeeded/result' ELSE s || '/no_rule' END
      WHEN e = 'query_found' AND s IN ('unknown', 'accepted') THEN CASE WHEN r IN ('accepted', 'succeeded') THEN r || '/external_record' ELSE s || '/external_not_final' END WHEN e = 'query_unavailable' AND s IN ('unknown', 'accepted') THEN CASE WHEN long_ago THEN 'manual/manual_limit' ELSE s || '/backoff' END
      WHEN e = 'query_not_found' AND s = 'unknown' THEN CASE WHEN again THEN 'sending/resendable' ELSE 'manual/may_still_land' END WHEN e = 'finality_passed' AND s = 'accepted' THEN CASE WHEN q THEN 'accepted/query' WHEN long_ago THEN 'manual/manual_limit' ELSE 'accepted/waits' END ELSE s || '/no_rule' END AS o
    FROM (SELECT e.k, e.n, e.t, e.e, e.r, e.q, s, first_, last_, us, sa, coalesce(e.t > coalesce(last_, first_) + 16400, false) AS past, coalesce(e.t <= coalesce(last_, first_) + 16400, false) OR coalesce(e.t - last_ > 100, false) AS again,
      coalesce(e.t - CASE WHEN s = 'accepted' THEN sa ELSE us END > 86400, false) AS long_ago FROM c JOIN e ON e.k = c.k AND e.n = c.n + 1)))
SELECT k AS command, s AS state, why, n::INT AS steps FROM (SELECT *, max(n) OVER (PARTITION BY k) AS m FROM c) WHERE n = m"""
)
def command_fold(spark: SparkSession, sf: str) -> DataFrame:
    """External commands after their logs: one command for each user and type of event."""
    n = F.col("event_id")

    def one(options: list[str], factor: int, prime: int) -> Column:
        return F.element_at(F.array(*[F.lit(x) for x in options]), (n * factor % prime % len(options) + 1).cast("int"))

    log = read(spark, sf, "events").select(
        F.concat_ws("/", "user_id", "event_type").alias("command"), n.alias("at"), one(SENT, 7919, 1009).alias("event"), one(RESULTS, 104_729, 1013).alias("result"), F.lit(20_000.0).alias("dedupe_s"),
        F.lit(True).alias("last_use"), (F.col("user_id") % 2 == 0).alias("query"), F.lit(100.0).alias("processing_s"), F.lit(None).cast("double").alias("abandon"),
    )
    return commands.command_states(log, ["at"])


@registered(
    """WITH RECURSIVE d AS (SELECT l_orderkey AS k, l_linenumber % 3 + 1 AS step, l_returnflag = 'R' AS reject, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber % 3, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS n FROM lineitem),
r AS (SELECT k, CAST(0 AS BIGINT) AS n, 'running' AS state, 1 AS cur FROM (SELECT DISTINCT k FROM d)
  UNION ALL SELECT d.k, d.n, CASE WHEN state = 'running' AND step = cur THEN CASE WHEN reject THEN 'returned' WHEN step = 3 THEN 'approved' ELSE state END ELSE state END, CASE WHEN state = 'running' AND step = cur AND NOT reject AND step < 3 THEN cur + 1 ELSE cur END FROM r JOIN d ON d.k = r.k AND d.n = r.n + 1)
SELECT k AS instance, state, cur AS step FROM (SELECT *, max(n) OVER (PARTITION BY k) AS m FROM r) WHERE n = m"""
)
def approval_fold(spark: SparkSession, sf: str) -> DataFrame:
    """Approval instances after their decisions: one for each order, one decision for each of its lines."""
    lines = read(spark, sf, "lineitem")
    told = lines.select(
        F.col("l_orderkey").alias("instance"), F.col("l_shipdate").alias("at"), "l_partkey", "l_suppkey", (F.col("l_linenumber") % 3 + 1).cast("int").alias("step"),
        F.when(F.col("l_returnflag") == "R", "reject").otherwise("approve").alias("choice"), F.lit(3).alias("steps"), F.lit("returned").alias("on_reject"),
    )
    return commands.instance_states(told, ["at", "l_partkey", "l_suppkey", "step"])


@registered(
    """WITH r AS (SELECT o_custkey % 50 AS requester, o_orderkey % 40 AS reference, o_orderkey, CAST(o_custkey % 2 AS VARCHAR) AS digest FROM orders)
SELECT o_orderkey, CASE WHEN row_number() OVER w = 1 THEN 'new' WHEN digest = first_value(digest) OVER w THEN 'repeat' ELSE 'conflict' END AS outcome FROM r WINDOW w AS (PARTITION BY requester, reference ORDER BY o_orderkey)"""
)
def command_requests(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("requester"), (F.col("o_orderkey") % 40).alias("reference"), "o_orderkey", (F.col("o_custkey") % 2).cast("string").alias("digest"))
    return commands.first_requests(rows, ["o_orderkey"]).select("o_orderkey", "outcome")


@registered(
    """WITH c AS (SELECT o_orderkey AS command FROM orders), a AS (SELECT l_orderkey AS command, l_shipdate AS s FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'O') SELECT command, min(s) AS sending_at FROM c LEFT JOIN a USING (command) GROUP BY command"""
)
def command_sends(spark: SparkSession, sf: str) -> DataFrame:
    attempts = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("command"), F.when(F.col("l_returnflag") == "R", "send").otherwise("query").alias("kind"), F.col("l_shipdate").alias("started_at"), F.when(F.col("l_linestatus") != "O", F.col("l_shipdate")).alias("ended_at"))
    return commands.unfinished_sends(read(spark, sf, "orders").select(F.col("o_orderkey").alias("command")), attempts)


@registered(
    """WITH t AS (SELECT o_orderkey AS task, o_custkey AS document, CASE WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'decided' END AS state, o_orderdate AS created, o_orderkey % 3 = 0 AS cand, o_orderkey % 11 = 0 AS mine FROM orders),
r AS (SELECT *, CASE WHEN mine THEN 0 WHEN state = 'pending' AND cand THEN 1 WHEN cand THEN 2 ELSE 3 END AS rank FROM t)
SELECT document, task, rank FROM (SELECT *, row_number() OVER (PARTITION BY document ORDER BY rank, created DESC, task) AS n FROM r) WHERE n = 1"""
)
def approval_pick(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    orders = read(spark, sf, "orders")
    tasks = orders.select(k.alias("task"), F.col("o_custkey").alias("document"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("decided").alias("state"), F.col("o_orderdate").cast("timestamp").alias("created_at"), F.when(k % 3 == 0, F.array(F.lit("me"), F.lit("you"))).otherwise(F.array(F.lit("you"))).alias("candidates"))
    decided = orders.where("o_orderkey % 11 = 0").select(k.alias("task"), F.lit("me").alias("decided_by"))
    return commands.decision_of(tasks, decided, F.lit("me"))


@registered(
    """WITH h AS (SELECT s_nationkey AS position, 'a' || (s_suppkey % 30) AS account FROM supplier), p AS (SELECT DISTINCT 'a' || (s_suppkey % 30) AS account, 'p' || (s_suppkey % 30 % 12) AS person FROM supplier WHERE s_suppkey % 30 <> 7),
t AS (SELECT c_custkey AS task, c_nationkey AS position, 'a' || (c_custkey % 35) AS initiator FROM customer)
SELECT DISTINCT task, h.account FROM t JOIN h USING (position) LEFT JOIN p ON p.account = h.account LEFT JOIN p q ON q.account = initiator WHERE coalesce(p.person, h.account) <> coalesce(q.person, initiator)"""
)
def approval_candidates(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("s_suppkey") % 30
    account = F.concat(F.lit("a"), n.cast("string")).alias("account")
    supplier = read(spark, sf, "supplier")
    holders = supplier.select(F.col("s_nationkey").alias("position"), account)
    persons = supplier.where("s_suppkey % 30 <> 7").select(account, F.concat(F.lit("p"), (n % 12).cast("string")).alias("person")).distinct()
    tasks = read(spark, sf, "customer").select(F.col("c_custkey").alias("task"), F.col("c_nationkey").alias("position"), F.concat(F.lit("a"), (F.col("c_custkey") % 35).cast("string")).alias("initiator"))
    return commands.candidates_of(tasks, holders, persons)


@registered(
    """WITH i AS (SELECT event_id AS id, CASE WHEN event_type <> 'click' THEN event_type || user_id END AS k, event_id % 1000 AS s, ts FROM events WHERE ts > TIMESTAMP '2024-01-03' OR event_id % 2 = 0)
SELECT id, k AS collapse_key FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s DESC, id DESC) AS n FROM i) WHERE n = 1 OR k IS NULL"""
)
def intents_collapsed(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.when(F.col("event_type") != "click", F.concat("event_type", F.col("user_id").cast("string"))).alias("collapse_key"), (F.col("event_id") % 1000).alias("sequence"),
        F.when(F.col("event_id") % 2 != 0, F.col("ts")).alias("expires_at"),
    )
    return commands.collapsed(rows, F.lit("2024-01-03").cast(NTZ)).select("id", "collapse_key")


@registered(
    """SELECT c_custkey, 'sha256:' || sha256('{"v":"' || c_name || '"}') AS name, c_mktsegment AS segment FROM customer"""
)
def audit_masked_changes(spark: SparkSession, sf: str) -> DataFrame:
    changes = F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment"))
    told = read(spark, sf, "customer").select("c_custkey", evidence.masked_changes(changes, F.array(F.lit("name"), F.lit("phone"))).alias("m"))
    return told.select("c_custkey", F.col("m")["name"].alias("name"), F.col("m")["segment"].alias("segment"))


@registered(
    """WITH r AS (SELECT event_id AS seq, user_id || event_type AS identity FROM events), h AS (SELECT DISTINCT user_id || event_type AS identity FROM events WHERE user_id % 4 = 0)
SELECT seq, CASE WHEN identity IN (SELECT identity FROM h) THEN 'reflected' WHEN row_number() OVER (PARTITION BY identity ORDER BY seq) = 1 THEN 'apply' ELSE 'repeat' END AS outcome FROM r"""
)
def evidence_replay(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events").withColumn("identity", F.concat(F.col("user_id").cast("string"), "event_type"))
    return evidence.replayed(e.select(F.col("event_id").alias("seq"), "identity"), e.where("user_id % 4 = 0")).select("seq", "outcome")


@registered("SELECT event_id AS id FROM events WHERE event_type NOT IN ('view', 'click')")
def evidence_drain(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events").withColumnRenamed("event_id", "id")
    status = F.when(F.col("event_type") == "view", "accepted").when(F.col("event_type") == "click", "duplicate").otherwise("refused")
    statuses = e.where("event_type <> 'signup'").select("id", status.alias("status"), F.lit("x").alias("reason"))
    return evidence.drained(e.select("id"), statuses)[0]


@registered(
    """WITH RECURSIVE e AS (SELECT n_nationkey AS nxt, (n_nationkey * 3 + 1) % 25 AS prv FROM nation WHERE n_nationkey % 4 <> 0), t AS (SELECT CAST(5 AS INT) AS node UNION SELECT CAST(prv AS INT) FROM t JOIN e ON nxt = node) SELECT node FROM t"""
)
def trust_closure(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_nationkey")
    rotations = read(spark, sf, "nation").select(n.alias("next"), ((n * 3 + 1) % 25).cast("int").alias("previous"), F.lit(True).alias("signed"), (n % 4 != 0).alias("accepted"))
    return evidence.trusted(spark.createDataFrame([(5,)], "node int"), rotations)


@registered(
    """WITH v AS (SELECT user_id AS f, min(ts) AS t FROM events WHERE event_type = 'error' GROUP BY user_id) SELECT event_id FROM events LEFT JOIN v ON f = user_id WHERE t IS NULL OR ts <= t - INTERVAL 1 HOUR"""
)
def trust_held(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events").select("event_id", F.col("user_id").alias("fingerprint"), F.col("ts").alias("received"), "event_type")
    return evidence.held_at(e, e.where("event_type = 'error'").select("fingerprint", "received"), F.expr("INTERVAL 1 HOUR")).select("event_id")


@registered(
    """WITH r AS (SELECT o_orderkey AS root_id FROM orders WHERE o_orderstatus = 'F'), w AS (SELECT l_orderkey AS root_id, 'unpublished_events' AS reason FROM lineitem WHERE l_returnflag = 'R' UNION SELECT l_orderkey, 'open_return' FROM lineitem WHERE l_quantity > 48 UNION SELECT l_orderkey, 'audit' FROM lineitem WHERE l_tax = 0.08)
SELECT root_id, string_agg(reason, ',' ORDER BY reason) AS reasons FROM r JOIN w USING (root_id) GROUP BY root_id"""
)
def archive_blockers(spark: SparkSession, sf: str) -> DataFrame:
    lines = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("root_id"), "*")
    roots = read(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("root_id"))
    waiting = lines.select(F.col("root_id").alias("record_id"), F.when(F.col("l_returnflag") != "R", F.col("l_shipdate")).alias("published_at"))
    said = lines.where("l_quantity > 48").select("root_id", F.lit("open_return").alias("reason")).unionByName(lines.where("l_tax = 0.08").select("root_id", F.lit("audit").alias("reason")))
    return evidence.blockers(roots, waiting, said).select("root_id", F.array_join("reasons", ",").alias("reasons"))


@registered(
    f"""WITH {UNITS_SQL} SELECT unit, unit LIKE '3-MEDIUM~199%' AS approved, CASE WHEN members % 3 = 0 AND members % 2 = 0 THEN 'thawed' ELSE 'object' END AS effective FROM units"""
)
def archive_routes(spark: SparkSession, sf: str) -> DataFrame:
    units, _ = sealed(spark, sf)
    own = units.where("unit LIKE '3-MEDIUM~199%'").select(F.lit("unit").alias("scope_kind"), F.col("unit").alias("scope"), F.lit(None).cast("date").alias("withdrawn_at"))
    gone = units.limit(1).select(F.lit("class").alias("scope_kind"), F.lit("orders").alias("scope"), F.lit("2000-01-01").cast("date").alias("withdrawn_at"))
    thaws = units.where("members % 3 = 0").select("unit", F.when(F.col("members") % 2 == 0, F.lit("2002-01-01")).otherwise(F.lit("2001-01-01")).cast(NTZ).alias("until"))
    told = evidence.routes(units.withColumn("route", F.lit("object")), thaws, F.lit("2001-09-01").cast(NTZ)).select("unit", "effective")
    return evidence.approved(units, own.unionByName(gone)).join(told, "unit")


@registered("SELECT 'e' || c_nationkey AS legal_entity, 'inv' AS code, CAST(c_custkey % 3 AS VARCHAR) || '/' || c_mktsegment AS period, max(c_custkey) AS max_used FROM customer GROUP BY ALL")
def series_maxima(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "customer")
    series = F.concat_ws("/", F.concat(F.lit("e"), F.col("c_nationkey").cast("string")), F.lit("inv"), (F.col("c_custkey") % 3).cast("string"), "c_mktsegment")
    return evidence.series_maxima(c.select(series.alias("series"), F.col("c_custkey").alias("number")))


@registered("WITH s AS (SELECT 'n' || n_nationkey AS series, CAST(n_nationkey AS BIGINT) AS b, CAST(n_nationkey % 7 * 4 AS BIGINT) AS a FROM nation) SELECT series, unnest(range(b + 1, a + 1)) AS number FROM s WHERE a > b")
def series_voided(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_nationkey").cast("long")
    return folds.voided_numbers(read(spark, sf, "nation").select(F.concat(F.lit("n"), n.cast("string")).alias("series"), n.alias("before"), (n % 7 * 4).alias("after")))
