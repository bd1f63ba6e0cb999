"""The telemetry envelope: schema, readers, the adapter from the ``events`` table, and a synthetic generator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW_SCHEMA = T.StructType(
    [T.StructField(n, t) for n, t in (
        ("event_id", T.StringType()), ("timestamp", T.StringType()), ("source", T.StringType()), ("event_type", T.StringType()), ("payer_id", T.StringType()),
        ("payee_id", T.StringType()), ("channel", T.StringType()), ("amount", T.DoubleType()), ("currency", T.StringType()), ("status", T.StringType()),
        ("latency_ms", T.DoubleType()), ("is_attack", T.BooleanType()), ("attack_pattern", T.StringType()), ("client_ip", T.StringType()),
        ("raw_payload_valid", T.BooleanType()), ("log_message", T.StringType()),
    )]
)
#: Injections of the adapter, as epoch seconds: an hour that repeats five times, and a user whose last days repeat six times.
BURST = (1705752000, 1705755600)
DRIFT_USER, DRIFT_FROM = 7, 1705795200
ROUTE = "/api/v1/transactions/route"
#: Gateway lines by the event's number modulo 60: last of these numbers, method, path, code and message; what the event names is none here.
LINES = (
    (0, "GET", "/api/v1/accounts?id=1' OR '1'='1", "200", "account lookup executed"), (1, "GET", "/static/../../config/database.yml", "404", "route not found"),
    (2, "GET", "/.env", "404", "unmatched route probe"), (5, "POST", "/api/v1/auth/login", "401", None), (6, "GET", "/api/v1/unknown", "404", "no such resource"),
    (7, "GET", "/healthz", "200", "ok"), (10, "POST", ROUTE, "400", "rejected: schema validation failed"), (20, "GET", None, "200", "balance inquiry ok"),
    (30, "GET", None, "200", "status poll approved"), (38, "POST", None, "201", "settlement batch accepted"), (59, "POST", ROUTE, "200", None),
)
#: The user's repetitions come one after another, so many seconds apart, and end here.
SPREAD, UNTIL = 21600, 1706659200


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Raw envelopes, one JSON object a line, under the fixed schema."""
    return spark.read.schema(RAW_SCHEMA).json(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, all columns as text; bad bytes and rows stay."""
    return spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``line`` (from 0 in each file) and ``value`` of text files.

    Every split counts its own lines; a file's splits are few rows, whose sums say where each begins.  Within a split, lines
    are numbered as they are read, so nothing is sorted and no line leaves the JVM.
    """
    place = {"file": F.col("_metadata.file_path"), "block": F.col("_metadata.file_block_start"), "at": F.monotonically_increasing_id()}
    rows = spark.read.text(path).withColumns(place)
    before = F.coalesce(F.sum("lines").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = rows.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("lines")).withColumn("before", before)
    return rows.join(splits, ["file", "block"]).select("file", (F.col("before") + F.col("at") - F.col("first")).alias("line"), "value")


def read_labelled(spark: SparkSession, log: str, labels: str) -> DataFrame:
    """Lines of two files paired by their place (S11, J6): an equi-join on their numbers."""
    lines = numbered_lines(spark, log).select("line", "value")
    return lines.join(numbered_lines(spark, labels).select("line", F.col("value").alias("labels")), "line")


def epoch(c: str = "ts"):
    """Whole seconds since 1970 of a timestamp without zone."""
    return F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast({c} as timestamp_ntz))")


def telemetry(events: DataFrame) -> DataFrame:
    """The ``events`` table as flat telemetry (FIXTURES part C): one row for each event, more in the two injections.

    Columns: the envelope's, ``t`` (epoch seconds), ``rep`` and ``payload_bytes``.  A row's arrival is (t, event_id, rep).
    """
    e, ch = F.col("event_id"), F.col("event_type")
    t = F.col("t")
    burst = (t >= BURST[0]) & (t < BURST[1])
    drift = (F.col("user_id") == DRIFT_USER) & (t >= DRIFT_FROM)
    copies = F.when(burst, 5).when(drift, 6).otherwise(1)
    base = events.select("event_id", epoch().alias("t"), "user_id", "event_type", F.col("value").alias("amount"))
    base = base.withColumn("rep", F.explode(F.sequence(F.lit(0), copies - 1)))
    base = base.withColumn("t", F.when(burst, t).otherwise(t + F.col("rep") * SPREAD)).filter((F.col("rep") == 0) | (t < UNTIL))
    again = F.col("rep") > 0
    who = F.concat(F.lit("user-"), F.col("user_id").cast("string"))
    ip = F.when(burst & again, F.concat(F.lit("45.148.10."), (10 + (e + F.col("rep")) % 4).cast("string"))).otherwise(
        F.concat(F.lit("10.0."), ((e * 7) % 4).cast("string"), F.lit("."), ((e * 31) % 50).cast("string"))
    )
    lit, id_ = F.lit, e.cast("string")
    # constants are looked up: a method of generated code over 8,000 bytes, as branches make it, is only interpreted
    kind, declined = F.col("_kind"), F.col("_declined")
    known = lambda i: F.array(*[lit(next(row[i] for row in LINES if k <= row[0])) for k in range(60)])[kind]
    bank, status, settlement = F.concat(lit("bank-"), (e % 20).cast("string"), lit("/balance")), F.concat(id_, lit("/status")), F.col("channel")
    named = F.when(kind <= 20, F.concat(lit("/api/v1/accounts/"), bank)).when(kind <= 30, F.concat(lit("/api/v1/transactions/"), status)).otherwise(F.concat(lit("/api/v1/settlements/"), settlement))
    failed = F.concat(lit("authentication failed for "), who, lit(" (attempt "), (1 + e % 5).cast("string"), lit(")"))
    routed = F.when(declined, "payment declined: insufficient funds").otherwise(F.concat(lit("routed to merchant-"), (e % 200).cast("string")))
    line = F.concat(
        F.col("client_ip"), lit(" - "), F.coalesce("payer_id", lit("-")), lit(' [10/Jan/2024:00:00:00 +0000] "'), known(1), lit(" "), F.coalesce(known(2), named),
        lit(' HTTP/1.1" '), F.when(declined & (kind > 38), "402").otherwise(known(3)), lit(' 512 12ms "'), F.coalesce(known(4), F.when(kind <= 5, failed).otherwise(routed)), lit('"'),
    )
    log = F.when(kind == 9, F.concat(lit("not a gateway line "), id_)).when(kind == 10, lit(None).cast("string")).otherwise(line)
    out = base.withColumns(
        {
            "payer_id": F.when(e % 97 == 0, None).otherwise(who),
            "payee_id": F.concat(F.lit("merchant-"), (e % 200).cast("string")),
            "channel": F.when(ch == "purchase", "ecommerce").when(ch.isin("click", "view"), "wallet").otherwise("bank"),
            "currency": F.lit("IDR"),
            "status": F.when(ch == "error", "error").when(e % 33 == 0, "declined").otherwise("approved"),
            "client_ip": ip,
            "is_malformed": e % 41 == 0,
            "attack_pattern": F.when(again & burst, "burst").when(again, "slow_exfil").when(e % 41 == 0, "malformed").when(e % 60 <= 2, "log_attack"),
            "_kind": F.coalesce(F.when(e % 60 >= 0, e % 60), lit(59)),  # all others are lines as of 39 to 59
            "_declined": F.coalesce(e % 33 == 0, lit(False)),
        }
    )
    out = out.withColumns({"is_attack": F.col("attack_pattern").isNotNull(), "error": F.col("status").isin("declined", "error", "malformed"), "log_message": log}).drop("_kind", "_declined")
    return out.withColumn("payload_bytes", 100 + F.coalesce(F.length("log_message"), F.lit(0)))


#: The same view for the oracle, as a chain of common table expressions.
TELEMETRY_SQL = f"""
tele_base AS (
  SELECT event_id, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS t, user_id, event_type, value AS amount FROM events
), tele_rep AS (
  SELECT * FROM (SELECT b.* EXCLUDE (t), CASE WHEN t >= {BURST[0]} AND t < {BURST[1]} THEN t ELSE t + r.rep * {SPREAD} END AS t, r.rep FROM tele_base b JOIN (SELECT unnest(range(6)) AS rep) r
  ON r.rep < CASE WHEN t >= {BURST[0]} AND t < {BURST[1]} THEN 5 WHEN user_id = {DRIFT_USER} AND t >= {DRIFT_FROM} THEN 6 ELSE 1 END) WHERE rep = 0 OR t < {UNTIL}
), tele_cols AS (
  SELECT *, CASE WHEN event_id % 97 = 0 THEN NULL ELSE 'user-' || user_id END AS payer_id,
    'merchant-' || (event_id % 200) AS payee_id,
    CASE WHEN event_type = 'purchase' THEN 'ecommerce' WHEN event_type IN ('click', 'view') THEN 'wallet' ELSE 'bank' END AS channel,
    CASE WHEN event_type = 'error' THEN 'error' WHEN event_id % 33 = 0 THEN 'declined' ELSE 'approved' END AS status,
    CASE WHEN t >= {BURST[0]} AND t < {BURST[1]} AND rep > 0 THEN '45.148.10.' || (10 + (event_id + rep) % 4)
      ELSE '10.0.' || ((event_id * 7) % 4) || '.' || ((event_id * 31) % 50) END AS client_ip,
    event_id % 41 = 0 AS is_malformed,
    CASE WHEN rep > 0 AND t >= {BURST[0]} AND t < {BURST[1]} THEN 'burst' WHEN rep > 0 THEN 'slow_exfil'
      WHEN event_id % 41 = 0 THEN 'malformed' WHEN event_id % 60 <= 2 THEN 'log_attack' END AS attack_pattern
  FROM tele_rep
), tele_log AS (
  SELECT *, attack_pattern IS NOT NULL AS is_attack, status IN ('declined', 'error', 'malformed') AS error,
    client_ip || ' - ' || coalesce(payer_id, '-') || ' [10/Jan/2024:00:00:00 +0000] "' AS h,
    event_id % 60 AS kind, event_id % 33 = 0 AS dec
  FROM tele_cols
), tele AS (
  SELECT *, 100 + coalesce(length(log_message), 0) AS payload_bytes FROM (
  SELECT *, CASE
    WHEN kind = 0 THEN h || 'GET /api/v1/accounts?id=1'' OR ''1''=''1 HTTP/1.1" 200 512 12ms "account lookup executed"'
    WHEN kind = 1 THEN h || 'GET /static/../../config/database.yml HTTP/1.1" 404 512 12ms "route not found"'
    WHEN kind = 2 THEN h || 'GET /.env HTTP/1.1" 404 512 12ms "unmatched route probe"'
    WHEN kind BETWEEN 3 AND 5 THEN h || 'POST /api/v1/auth/login HTTP/1.1" 401 512 12ms "authentication failed for user-' || user_id || ' (attempt ' || (1 + event_id % 5) || ')"'
    WHEN kind = 6 THEN h || 'GET /api/v1/unknown HTTP/1.1" 404 512 12ms "no such resource"'
    WHEN kind = 7 THEN h || 'GET /healthz HTTP/1.1" 200 512 12ms "ok"'
    WHEN kind = 8 THEN h || 'POST /api/v1/transactions/route HTTP/1.1" 400 512 12ms "rejected: schema validation failed"'
    WHEN kind = 9 THEN 'not a gateway line ' || event_id
    WHEN kind = 10 THEN NULL
    WHEN kind BETWEEN 11 AND 20 THEN h || 'GET /api/v1/accounts/bank-' || (event_id % 20) || '/balance HTTP/1.1" 200 512 12ms "balance inquiry ok"'
    WHEN kind BETWEEN 21 AND 30 THEN h || 'GET /api/v1/transactions/' || event_id || '/status HTTP/1.1" 200 512 12ms "status poll approved"'
    WHEN kind BETWEEN 31 AND 38 THEN h || 'POST /api/v1/settlements/' || channel || ' HTTP/1.1" 201 512 12ms "settlement batch accepted"'
    ELSE h || 'POST /api/v1/transactions/route HTTP/1.1" ' || (CASE WHEN dec THEN '402' ELSE '200' END) || ' 512 12ms "'
      || (CASE WHEN dec THEN 'payment declined: insufficient funds' ELSE 'routed to merchant-' || (event_id % 200) END) || '"'
  END AS log_message FROM tele_log))
"""


def envelope(flat: DataFrame) -> DataFrame:
    """Flat telemetry as JSON messages in ``value``, as the topic carries them."""
    stamp = F.concat(F.date_format(F.timestamp_seconds("t").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    row = F.struct(
        F.concat_ws("-", F.col("event_id").cast("string"), F.col("rep").cast("string")).alias("event_id"), stamp.alias("timestamp"), F.lit("adapter").alias("source"), "event_type", "payer_id", "payee_id",
        "channel", "amount", "currency", "status", F.lit(12.0).alias("latency_ms"), "is_attack", "attack_pattern", "client_ip", (~F.col("is_malformed")).alias("raw_payload_valid"), "log_message",
    )
    return flat.select(F.to_json(row).alias("value"))


def synthetic(spark: SparkSession, n: int, start: int, per_second: float = 58.0, attack_share: float = 0.02, seed: int = 1) -> DataFrame:
    """Labelled traffic from a seed (S16, S17, F29): lognormal amounts and latencies, pools of parties, bursts and junk."""
    u = lambda k: F.rand(seed * 101 + k)
    base = spark.range(n).select(F.col("id").alias("event_id"), (F.lit(start) + F.floor(F.col("id") / per_second)).cast("long").alias("t"), u(1).alias("a"), u(2).alias("b"), u(3).alias("c"))
    amount = F.round(F.greatest(F.lit(1e3), F.least(F.lit(5e7), F.exp(11.5 + F.randn(seed * 101 + 4)))), -2)
    channel = F.element_at(F.array(*map(F.lit, ("ecommerce", "wallet", "bank"))), (F.floor(F.col("a") * 3) + 1).cast("int"))
    attack = F.col("b") < attack_share
    return base.select(
        "event_id", "t", channel.alias("channel"),
        F.concat(F.lit("wallet-user-"), F.lpad((1 + F.floor(F.col("a") * 500)).cast("int").cast("string"), 4, "0")).alias("payer_id"),
        F.concat(F.lit("merchant-"), F.lpad((1 + F.floor(F.col("c") * 200)).cast("int").cast("string"), 4, "0")).alias("payee_id"),
        amount.alias("amount"), F.round(F.exp(2.5 + 0.5 * F.randn(seed * 101 + 5)), 1).alias("latency_ms"),
        F.when(u(6) < 0.03, "declined").otherwise("approved").alias("status"),
        F.when(attack, F.concat(F.lit("45.148.10."), (10 + F.floor(F.col("c") * 21)).cast("int").cast("string"))).otherwise(
            F.concat(F.lit("10."), F.floor(F.col("c") * 4).cast("int").cast("string"), F.lit("."), F.floor(F.col("a") * 256).cast("int").cast("string"), F.lit("."), F.floor(F.col("b") * 256).cast("int").cast("string"))
        ).alias("client_ip"),
        attack.alias("is_attack"), F.when(attack, "burst").alias("attack_pattern"),
    )
