"""One query for each operator, over whole tables, and the SQL of its result.

The stored texts are made from the base tables, so the SQL can say from the
base columns what must come out.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import ledger as L
from tidemark.functions.msgpack import payload_json
from tidemark.functions.names import bad_segment, valid_name
from tidemark.history import Fallible, Field, History, Update
from tidemark.operators import error_summary, from_versioned, inspect_envelopes, redact, split_ok_failed, to_versioned, upgrade
from tidemark.operators.redaction import template
from tidemark.shapes import BOOL, DATE, DECIMAL, F32, F64, I32, I64, I128, LOCAL_DATETIME, LOCAL_TIME, OFFSET_DATETIME, STRING, U8, U32, U64, U128, UTC_INSTANT, UUID, array_of, enum, list_of, map_of, option, record, set_of, tuple_of
from tidemark.shared import shared_dir
from tidemark.streaming import route, upgraded_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable:
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(**parts: Column | str) -> Column:
    """A JSON object of columns that are JSON texts already, or of fixed JSON texts."""
    pairs = [F.concat(F.lit(f'"{k}":'), v if isinstance(v, Column) else F.lit(v)) for k, v in parts.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}"))


def quoted(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.concat(F.lit('"'), c.cast("string"), F.lit('"'))


def number(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("bigint")


# ------------------------------------------------------------ order history

ORDER = History.declare(
    "shop.order",
    Field("status", STRING, removed_in=2),
    Field(
        "cents",
        I64,
        updates=(
            Update(3, U32, using=lambda p: Fallible(p.cents.cast("bigint"), F.when(p.cents % 97 == 13, F.concat(F.lit("amount "), p.cents.cast("string"))))),
            Update(2, STRING, using=lambda p: p.cents.try_cast("bigint")),
        ),
    ),
    Field("label", STRING, added_in=2, using=lambda p: F.concat(F.lit("status "), p.status)),
    Field("layout", U32, added_in=2, value=2),
)


def order_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders stored under version o_orderkey % 3 + 1."""
    rows = table(spark, sf_dir, "orders").withColumns({"version": F.col("o_orderkey") % 3 + 1, "cents": cents("o_totalprice")})
    one = text(status=quoted("o_orderstatus"), cents=quoted("cents"))
    two = text(cents=number("cents"), label=quoted(F.concat(F.lit("status "), "o_orderstatus")), layout="3")
    three = text(layout="4", label=quoted(F.concat(F.lit("status "), "o_orderstatus")), cents=number("cents"))
    return rows.withColumn("payload", F.when(F.col("version") == 1, one).when(F.col("version") == 2, two).otherwise(three))


ORDER_SQL = """
WITH o AS (SELECT *, o_orderkey % 3 + 1 AS version, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders),
u AS (SELECT *, version < 3 AND c % 97 = 13 AS bad FROM o)
"""


@query(
    ORDER_SQL
    + """SELECT o_orderkey, version AS source_version, CASE WHEN NOT bad THEN c END AS cents,
    CASE WHEN NOT bad THEN 'status ' || o_orderstatus END AS label, CASE WHEN NOT bad THEN CAST(1 + version AS BIGINT) END AS layout,
    CASE WHEN bad THEN 'Upcast' END AS kind, CASE WHEN bad THEN CAST(2 AS BIGINT) END AS adjacent_from,
    CASE WHEN bad THEN 'amount ' || c END AS cause FROM u"""
)
def upgrade_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove, rename, convert twice, add a constant; some conversions fail."""
    out = upgrade(order_payloads(spark, sf_dir), ORDER, keep=["o_orderkey"])
    return out.select("o_orderkey", "source_version", "record.cents", "record.label", "record.layout", F.col("error.kind").alias("kind"), "error.adjacent_from", "error.cause")


@query(ORDER_SQL + "SELECT CASE WHEN bad THEN 'Upcast' END AS kind, version AS source_version, CAST(2 AS BIGINT) AS adjacent_from, CAST(3 AS BIGINT) AS adjacent_to, count(*) AS n_rows FROM u WHERE bad GROUP BY 1, 2")
def dead_letter_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return error_summary(upgrade(order_payloads(spark, sf_dir), ORDER))


@query(ORDER_SQL + "SELECT o_orderkey, 'shop.order' AS stable_name, version AS source_version, 'Upcast' AS kind, 'amount ' || c AS cause FROM u WHERE bad")
def dead_letter_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = split_ok_failed(upgrade(order_payloads(spark, sf_dir), ORDER), ["o_orderkey"])[1]
    return failed.select("o_orderkey", "stable_name", "source_version", "kind", "cause")


@query(
    ORDER_SQL
    + """SELECT c_mktsegment, count(*) AS n_orders, CAST(sum(c) AS BIGINT) AS cents FROM u JOIN customer ON o_custkey = c_custkey WHERE NOT bad GROUP BY 1"""
)
def analytics_on_upgraded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upgraded rows are ordinary rows: join and aggregate them."""
    ok = split_ok_failed(upgrade(order_payloads(spark, sf_dir), ORDER, keep=["o_custkey"]), ["o_custkey"])[0]
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return ok.join(customers, ok["o_custkey"] == customers["c_custkey"]).groupBy("c_mktsegment").agg(F.count("*").alias("n_orders"), F.sum("cents").alias("cents"))


@query("SELECT o_orderkey, o_orderkey % 6 AS source_version, CASE WHEN o_orderkey % 6 BETWEEN 1 AND 3 THEN 'Decode' ELSE 'UnsupportedVersion' END AS kind FROM orders")
def decode_unsupported_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A version that is not retained is told before its bytes are read."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 6).alias("version"), F.lit("not JSON").alias("payload"))
    return upgrade(rows, ORDER, keep=["o_orderkey"]).select("o_orderkey", "source_version", F.col("error.kind").alias("kind"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'TypeMismatch' ELSE 'UnsupportedVersion' END AS kind FROM orders")
def decode_type_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored name counts before the version."""
    name = F.when(F.col("o_orderkey") % 2 == 0, "shop.other").otherwise("shop.order")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", name.alias("stable_name"), F.lit(9).alias("version"), F.lit("{}").alias("payload"))
    return upgrade(rows, ORDER, name="stable_name", keep=["o_orderkey"]).select("o_orderkey", F.col("error.kind").alias("kind"))


# ------------------------------------------------------------- strictness

LINE = History.declare("shop.line", Field("quantity", U8), Field("note", option(STRING)), Field("flag", option(STRING), required=True))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 8 IN (0, 1) THEN NULL ELSE 'Decode' END AS kind, CASE WHEN l_orderkey % 8 IN (0, 1) THEN CAST(l_quantity AS SMALLINT) END AS quantity FROM lineitem")
def reject_unknown_missing_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = number(F.col("l_quantity").cast("int"))
    bad = F.col("l_orderkey") % 8
    payload = (
        F.when(bad == 0, text(quantity=q, flag="null"))
        .when(bad == 1, text(flag='"x"', quantity=q, note="null"))
        .when(bad == 2, text(quantity=q, flag="null", extra="1"))
        .when(bad == 3, text(quantity=q))
        .when(bad == 4, F.concat(F.lit('{"quantity":'), q, F.lit(',"flag":null,"quantity":'), q, F.lit("}")))
        .when(bad == 5, F.concat(F.lit("["), q, F.lit(",null]")))
        .when(bad == 6, F.concat(text(quantity=q, flag="null"), F.lit(" x")))
        .otherwise(text(quantity=quoted(q), flag="null"))
    )
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.lit(1).alias("version"), payload.alias("payload"))
    return upgrade(rows, LINE, keep=["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", F.col("error.kind").alias("kind"), "record.quantity")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey <= 255 AND l_linenumber <> 3 THEN CAST(l_partkey AS SMALLINT) END AS quantity FROM lineitem")
def integer_width_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers out of range, and whole numbers spelt as fractions, are no u8."""
    spelt = F.when(F.col("l_linenumber") == 3, F.concat(number("l_partkey"), F.lit(".0"))).otherwise(number("l_partkey"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.lit(1).alias("version"), text(quantity=spelt, flag="null").alias("payload"))
    return upgrade(rows, LINE, keep=["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "record.quantity")


WIDE = History.declare("shop.wide", Field("u", U64), Field("a", U128), Field("b", I128))


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 4 <> 3 THEN CAST(18446744073709551615 - p_partkey AS DECIMAL(20,0)) END AS u,
    CASE WHEN p_partkey % 4 <> 3 THEN '34028236692093846346337460743176821' || lpad(CAST(p_partkey % 1455 AS VARCHAR), 4, '0') END AS a,
    CASE WHEN p_partkey % 4 <> 3 THEN '-17014118346046923173168730371588410' || lpad(CAST(p_partkey % 5728 AS VARCHAR), 4, '0') END AS b FROM part"""
)
def wide_integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integers up to 128 bits keep every digit; one over the limit is refused."""
    u = (F.lit("18446744073709551615").cast("decimal(20,0)") - F.col("p_partkey").cast("decimal(20,0)")).cast("decimal(20,0)").cast("string")
    a = F.concat(F.lit("34028236692093846346337460743176821"), F.lpad((F.col("p_partkey") % 1455).cast("string"), 4, "0"))
    a = F.when(F.col("p_partkey") % 4 == 3, F.lit("340282366920938463463374607431768211456")).otherwise(a)
    b = F.concat(F.lit("-17014118346046923173168730371588410"), F.lpad((F.col("p_partkey") % 5728).cast("string"), 4, "0"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.lit(1).alias("version"), text(u=u, a=a, b=b).alias("payload"))
    return upgrade(rows, WIDE, keep=["p_partkey"]).select("p_partkey", "record.u", "record.a", "record.b")


PRESENCE = History.declare("shop.presence", Field("open", option(I32)), Field("held", option(I32), required=True))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 IN (0, 1, 2) THEN NULL ELSE 'Decode' END AS kind, CASE WHEN s_suppkey % 4 IN (0, 2) THEN CAST(s_nationkey AS INTEGER) END AS held FROM supplier")
def presence_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An optional key may be left out; a required one may be null but must be there."""
    n, k = number("s_nationkey"), F.col("s_suppkey") % 4
    payload = F.when(k == 0, text(held=n)).when(k == 1, text(held="null", open="null")).when(k == 2, text(open=n, held=n)).otherwise(text(open=n))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.lit(1).alias("version"), payload.alias("payload"))
    return upgrade(rows, PRESENCE, keep=["s_suppkey"]).select("s_suppkey", F.col("error.kind").alias("kind"), "record.held")


# ------------------------------------------------------------- evolution

CUSTOMER = History.declare(
    "shop.customer",
    Field("name", STRING, removed_in=2),
    Field("nation", U32, removed_in=2),
    Field("segment", STRING, removed_in=2),
    Field("full_name", STRING, added_in=2, using=lambda p: p.name, redact=True),
    Field("place", STRING, added_in=2, using=lambda p: F.concat_ws("/", p.nation.cast("string"), p.segment)),
    Field("first_letter", STRING, added_in=2, using=lambda p: F.substring(p.segment, 1, 1)),
    Field("rest", STRING, added_in=2, using=lambda p: F.regexp_replace(p.segment, r"(?s)\A.", "")),
    Field("balance", I64, redact=True),
)


def customer_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    payload = text(name=quoted("c_name"), nation=number("c_nationkey"), segment=quoted("c_mktsegment"), balance=number(cents("c_acctbal")))
    return rows.select("c_custkey", F.lit(1).alias("version"), payload.alias("payload"))


@query("SELECT c_custkey, c_name AS full_name, c_nationkey || '/' || c_mktsegment AS place, substr(c_mktsegment, 1, 1) AS first_letter, substr(c_mktsegment, 2) AS rest, CAST(round(c_acctbal * 100) AS BIGINT) AS balance FROM customer")
def rename_merge_split_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_ok_failed(upgrade(customer_payloads(spark, sf_dir), CUSTOMER, keep=["c_custkey"]), ["c_custkey"])[0]


@query("SELECT c_custkey, '[REDACTED]' AS full_name, c_nationkey || '/' || c_mktsegment AS place, CAST(0 AS BIGINT) AS balance, 'Account [REDACTED] at ' || c_nationkey || '/' || c_mktsegment AS text FROM customer")
def redacted_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marked fields hidden, and a text made of the redacted record."""
    hidden = redact(upgrade(customer_payloads(spark, sf_dir), CUSTOMER, keep=["c_custkey"]), CUSTOMER)
    return template(hidden, "Account {full_name} at {place}").select("c_custkey", "record.full_name", "record.place", "record.balance", "text")


PART = History.declare("shop.part", Field("name", STRING, updates=(Update(3, STRING, using=lambda p: F.upper(p.name)), Update(2, STRING, value="unnamed"))), Field("size", I32))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'UNNAMED' WHEN 1 THEN upper(p_name) ELSE p_name END AS name, p_size AS size FROM part")
def same_type_update_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates that keep the type: a constant, then a function."""
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 3 + 1).alias("version"), text(name=quoted("p_name"), size=number("p_size")).alias("payload"))
    return split_ok_failed(upgrade(rows, PART, keep=["p_partkey"]), ["p_partkey"])[0]


NATION = History.declare("shop.nation", Field("name", STRING, removed_in=2))


@query("SELECT n_nationkey, CAST(n_nationkey % 2 + 1 AS BIGINT) AS source_version, TRUE AS decoded FROM nation")
def removed_last_field_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record without fields is still a record."""
    payload = F.when(F.col("n_nationkey") % 2 == 0, text(name=quoted("n_name"))).otherwise("{}")
    rows = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") % 2 + 1).cast("bigint").alias("version"), payload.alias("payload"))
    return upgrade(rows, NATION, keep=["n_nationkey"]).select("n_nationkey", "source_version", F.col("record").isNotNull().alias("decoded"))


LONG = History.declare("shop.long", Field("key", I64), *(Field(f"field_{k}", U32, added_in=k, value=k) for k in range(2, 33)))


@query("SELECT o_orderkey AS key, o_orderkey % 32 + 1 AS source_version, CASE WHEN o_orderkey % 32 + 1 >= 2 THEN 100 ELSE 2 END AS field_2, CASE WHEN o_orderkey % 32 + 1 >= 16 THEN 100 ELSE 16 END AS field_16, CASE WHEN o_orderkey % 32 + 1 >= 32 THEN 100 ELSE 32 END AS field_32 FROM orders")
def long_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """32 versions, each with one more field born with a constant."""
    version = F.col("o_orderkey") % 32 + 1
    pairs = F.transform(F.sequence(F.lit(2), F.greatest(version, F.lit(2))), lambda k: F.concat(F.lit(',"field_'), k.cast("string"), F.lit('":100')))
    more = F.when(version >= 2, F.array_join(pairs, "")).otherwise("")
    payload = F.concat(F.lit('{"key":'), number("o_orderkey"), more, F.lit("}"))
    rows = table(spark, sf_dir, "orders").select(version.alias("version"), payload.alias("payload"))
    out = upgrade(rows, LONG, keep=[])
    return out.select("record.key", "source_version", *(F.col(f"record.field_{k}").cast("int").alias(f"field_{k}") for k in (2, 16, 32)))


# ------------------------------------------------------------- envelopes

EVENT = History.declare("shop.event", Field("kind", STRING), Field("user", I64), Field("value", F64))


@query("SELECT event_id, 'shop.event' AS stable_name, CAST(1 AS BIGINT) AS version, event_type AS kind, user_id AS user, value FROM events")
def envelope_roundtrip_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as envelopes, inspected, decoded again."""
    rows = table(spark, sf_dir, "events").select("event_id", F.struct(F.col("event_type").alias("kind"), F.col("user_id").alias("user"), "value").alias("record"))
    stored = to_versioned(rows, EVENT).select("event_id", "envelope")
    back = from_versioned(inspect_envelopes(stored), EVENT)
    return back.select("event_id", "stable_name", "version", "record.kind", "record.user", "record.value")


@query("SELECT event_id, event_id % 12 = 0 AS valid, CASE WHEN event_id % 12 <> 0 THEN 'Decode' END AS error FROM events")
def envelope_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One right envelope, and eleven ways to be wrong."""
    payload = text(kind=quoted("event_type"), user=number("user_id"), value="1.5")
    right = lambda v: text(version=v, payload=payload, stable_name='"shop.event"')
    n, out = F.col("event_id") % 12, right("1")
    wrong = ["0", "-1", "1.5", '"1"', "null", "true", "4294967296", "1.0"]
    for k, v in enumerate(wrong):
        out = F.when(n == k + 1, right(v)).otherwise(out)
    out = F.when(n == 9, text(version="1", payload=payload)).when(n == 10, text(version="1", payload=payload, stable_name='"shop.event"', extra="1")).when(n == 11, F.lit("{}")).otherwise(out)
    rows = table(spark, sf_dir, "events").select("event_id", out.alias("envelope"))
    return from_versioned(inspect_envelopes(rows), EVENT).select("event_id", "valid", F.col("error.kind").alias("error"))


# ----------------------------------------------------- enums and containers

MONEY = enum(Usd=None, Eur=None)
PARCEL = History.declare(
    "depot.parcel",
    Field("slip", STRING),
    Field("carrier", STRING, removed_in=2),
    Field(
        "status",
        enum(Waiting=None, Sent=record(grams=I64, by=STRING)),
        updates=(
            Update(
                2,
                enum(Waiting=None, Sent=I64),
                using=lambda p: Fallible(
                    F.struct(p.status["tag"].alias("tag"), F.when(p.status["tag"] == "Sent", F.struct(p.status["Sent"].alias("grams"), F.initcap(p.carrier).alias("by"))).alias("Sent")),
                    F.when((p.status["tag"] == "Sent") & ~p.carrier.isin("POST", "BIKE"), p.carrier),
                ),
            ),
        ),
    ),
)


@query(
    """WITH p AS (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS c, o_orderstatus = 'O' AS waiting, CASE o_orderkey % 3 WHEN 0 THEN 'POST' WHEN 1 THEN 'BIKE' ELSE 'DRONE' END AS cur FROM orders)
    SELECT o_orderkey, CASE WHEN waiting THEN 'Waiting' WHEN cur <> 'DRONE' THEN 'Sent' END AS tag, CASE WHEN NOT waiting AND cur <> 'DRONE' THEN c END AS grams,
    CASE WHEN NOT waiting AND cur = 'POST' THEN 'Post' WHEN NOT waiting AND cur = 'BIKE' THEN 'Bike' END AS by, CASE WHEN NOT waiting AND cur = 'DRONE' THEN 'DRONE' END AS cause FROM p"""
)
def enum_status_upgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An enum of units and payloads, converted with the field beside it."""
    k = F.col("o_orderkey") % 3
    by = F.when(k == 0, "POST").when(k == 1, "BIKE").otherwise("DRONE")
    status = F.when(F.col("o_orderstatus") == "O", F.lit('"Waiting"')).otherwise(text(Sent=number(cents("o_totalprice"))))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.lit(1).alias("version"), text(slip='"r"', carrier=quoted(by), status=status).alias("payload"))
    out = upgrade(rows, PARCEL, keep=["o_orderkey"])
    return out.select("o_orderkey", "record.status.tag", "record.status.Sent.grams", "record.status.Sent.by", "error.cause")


SHELF = History.declare("shop.shelf", Field("pair", tuple_of(I64, option(STRING))), Field("list", list_of(I32)), Field("fixed", array_of(U8, 2)), Field("names", set_of(STRING)), Field("by_name", map_of(I64)), Field("on", BOOL))


@query(
    """SELECT v.vec_id, CASE WHEN vec_id % 5 <> 4 THEN CAST(vec_id AS BIGINT) END AS first, CASE WHEN vec_id % 5 <> 4 THEN CAST(label + 2 AS BIGINT) END AS list_sum,
    CASE WHEN vec_id % 5 <> 4 THEN CAST(label AS BIGINT) END AS mapped, CASE WHEN vec_id % 5 = 4 THEN 'Decode' END AS kind FROM embeddings v"""
)
def container_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tuples, lists, fixed arrays, sets and maps; a fixed array of the wrong length is refused."""
    fixed = F.when(F.col("vec_id") % 5 == 4, F.lit("[1,2,3]")).otherwise("[1,2]")
    listed = F.concat(F.lit("["), number("label"), F.lit(",2]"))
    payload = text(pair=F.concat(F.lit("["), number("vec_id"), F.lit(",null]")), list=listed, fixed=fixed, names='["a","b","a"]', by_name=text(label=number("label")), on="true")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.lit(1).alias("version"), payload.alias("payload"))
    out = upgrade(rows, SHELF, keep=["vec_id"])
    total = F.aggregate("record.list", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return out.select("vec_id", F.col("record.pair._1").alias("first"), total.alias("list_sum"), F.col("record.by_name")["label"].alias("mapped"), F.col("error.kind").alias("kind"))


NESTED = History.declare("shop.document", Field("meta", record(lang=STRING, source=STRING, size=option(record(chars=I64)))), Field("tags", list_of(record(name=STRING))))


@query("SELECT doc_id, lang, source, CASE WHEN doc_id % 2 = 0 THEN n_chars END AS chars, CAST(2 AS INTEGER) AS n_tags FROM documents WHERE doc_id % 3 <> 1")
def nested_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed records within records and lists; an unknown key at any depth is refused."""
    size = F.when(F.col("doc_id") % 2 == 0, text(chars=number("n_chars"))).otherwise("null")
    tags = F.when(F.col("doc_id") % 3 == 1, F.lit('[{"name":"a","x":1}]')).otherwise('[{"name":"a"},{"name":"b"}]')
    payload = text(meta=text(lang=quoted("lang"), source=quoted("source"), size=size), tags=tags)
    rows = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("version"), payload.alias("payload"))
    ok = upgrade(rows, NESTED, keep=["doc_id"]).where("error IS NULL")
    return ok.select("doc_id", "record.meta.lang", "record.meta.source", "record.meta.size.chars", F.size("record.tags").alias("n_tags"))


# ------------------------------------------------------------- profiles

LOGICAL = History.declare("shop.logical", Field("id", UUID), Field("amount", DECIMAL), Field("day", DATE))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN '00000000-0000-0000-0000-' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') END AS id,
    CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey || '.500' END AS amount, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderdate AS DATE) END AS day FROM orders"""
)
def profile_decimal_uuid_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    uid = F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad(number("o_orderkey"), 12, "0"))
    uid = F.when(k == 1, F.concat(F.lit("A"), F.substring(uid, 2, 35))).otherwise(uid)
    amount = F.concat(F.when(k == 2, F.lit("+")).otherwise(""), number("o_orderkey"), F.lit(".500"))
    day = F.when(k == 3, F.lit("2023-02-29")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.lit(1).alias("version"), text(id=quoted(uid), amount=quoted(amount), day=quoted(day)).alias("payload"))
    return upgrade(rows, LOGICAL, keep=["o_orderkey"]).select("o_orderkey", "record.id", "record.amount", "record.day")


TIMES = History.declare("shop.times", Field("clock", LOCAL_TIME), Field("local", LOCAL_DATETIME), Field("instant", UTC_INSTANT), Field("offset", OFFSET_DATETIME))


@query(
    """WITH t AS (SELECT event_id, strftime(ts, '%H:%M:%S') AS h, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS d, event_id % 4 < 2 AS good FROM events)
    SELECT event_id, CASE WHEN good THEN h || '.1' END AS clock, CASE WHEN good THEN d END AS local, CASE WHEN good THEN d || '.000000001Z' END AS instant, CASE WHEN good THEN d || '+05:30' END AS offset_text FROM t"""
)
def profile_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fractions lose their trailing zeros; an offset of -00:00 or a leap second is refused."""
    d, h = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.date_format("ts", "HH:mm:ss")
    k = F.col("event_id") % 4
    clock = F.when(k == 2, F.lit("23:59:60")).otherwise(F.concat(h, F.lit(".100")))
    offset = F.concat(d, F.when(k == 3, F.lit("-00:00")).otherwise("+05:30"))
    payload = text(clock=quoted(clock), local=quoted(F.concat(d, F.lit(".0"))), instant=quoted(F.concat(d, F.lit(".000000001Z"))), offset=quoted(offset))
    rows = table(spark, sf_dir, "events").select("event_id", F.lit(1).alias("version"), payload.alias("payload"))
    out = upgrade(rows, TIMES, keep=["event_id"])
    return out.select("event_id", "record.clock", "record.local", "record.instant", F.col("record.offset").alias("offset_text"))


# ------------------------------------------------- other codecs, streams

PACKED = History.declare("shop.packed", Field("key", I64), Field("priority", STRING), Field("label", STRING, added_in=2, using=lambda p: F.lower(p.priority)))


@query("SELECT o_orderkey AS key, o_orderpriority AS priority, lower(o_orderpriority) AS label, o_orderkey % 5 <> 0 AS decoded FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT NULL, NULL, NULL, FALSE FROM orders WHERE o_orderkey % 5 = 0")
def messagepack_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named maps in MessagePack; input after the value is refused."""
    name = lambda n: F.concat(F.lit(f"{0xA0 + len(n):02X}"), F.hex(F.lit(n)))
    key = F.concat(F.lit("D3"), F.lpad(F.hex("o_orderkey"), 16, "0"))
    priority = F.concat(F.lit("D9"), F.lpad(F.hex(F.octet_length("o_orderpriority").cast("bigint")), 2, "0"), F.hex("o_orderpriority"))
    tail = F.when(F.col("o_orderkey") % 5 == 0, "C0").otherwise("")
    raw = F.unhex(F.concat(F.lit("82"), name("key"), key, name("priority"), priority, tail))
    rows = table(spark, sf_dir, "orders").select(F.lit(1).alias("version"), raw.alias("raw"))
    rows = rows.select("version", payload_json(F.col("raw"), F.col("version"), PACKED).alias("payload"))
    out = upgrade(rows, PACKED, keep=[])
    return out.select("record.key", "record.priority", "record.label", F.col("record").isNotNull().alias("decoded"))


@query("SELECT event_id, event_type AS kind, user_id AS user FROM events WHERE event_id % 3 <> 0")
def stream_upgrade_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same upgrade over a stream of the table, good and failed rows routed apart."""
    base = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(base.schema).parquet(f"{sf_dir}/event[s].parquet")
    payload = text(kind=quoted("event_type"), user=number("user_id"), value=F.when(F.col("event_id") % 3 == 0, F.lit('"x"')).otherwise("1"))
    stored = stream.select("event_id", text(stable_name='"shop.event"', version="1", payload=payload).alias("envelope"))
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    route(upgraded_stream(stored, EVENT), f"{folder}/ok", f"{folder}/failed", f"{folder}/progress").awaitTermination()
    return spark.read.parquet(f"{folder}/ok").select("event_id", "kind", "user")


# ------------------------------------------------------------- names, ledger


@query(
    """WITH n AS (SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'shop.s' || s_suppkey WHEN 1 THEN 'Shop.s' || s_suppkey WHEN 2 THEN 'shop..s' || s_suppkey WHEN 3 THEN 'a.b.9' || s_suppkey ELSE 'a_' || s_suppkey END AS name FROM supplier)
    SELECT s_suppkey, name, s_suppkey % 5 IN (0, 4) AS valid, CASE s_suppkey % 5 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 END::BIGINT AS bad_segment FROM n"""
)
def stable_name_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("s_suppkey") % 5, number("s_suppkey")
    name = F.when(k == 0, F.concat(F.lit("shop.s"), s)).when(k == 1, F.concat(F.lit("Shop.s"), s)).when(k == 2, F.concat(F.lit("shop..s"), s)).when(k == 3, F.concat(F.lit("a.b.9"), s)).otherwise(F.concat(F.lit("a_"), s))
    return table(spark, sf_dir, "supplier").select("s_suppkey", name.alias("name")).withColumns({"valid": valid_name(F.col("name")), "bad_segment": bad_segment(F.col("name")).cast("bigint")})


def _nation_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger rows: a history for each region, a version for each of its nations; one region has a gap."""
    rows = table(spark, sf_dir, "nation")
    place = F.expr("row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)")
    version = place + F.when((F.col("n_regionkey") == 2) & (place > 2), 1).otherwise(0)
    return rows.select(F.concat(F.lit("region.r"), "n_regionkey").alias("stable_name"), version.cast("bigint").alias("version"), (F.col("n_regionkey") == 3).alias("reset_draft"))


ENTRIES_SQL = """WITH e AS (SELECT 'region.r' || n_regionkey AS stable_name, n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS p FROM nation),
v AS (SELECT *, p + CASE WHEN n_regionkey = 2 AND p > 2 THEN 1 ELSE 0 END AS version FROM e) """


@query(ENTRIES_SQL + "SELECT stable_name, count(*) AS n_versions, CAST(max(version) AS BIGINT) AS head, TRUE AS valid, bool_and(version = p) AS contiguous FROM v GROUP BY 1")
def ledger_contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.contiguity(_nation_entries(spark, sf_dir))


@query(ENTRIES_SQL + """, h AS (SELECT stable_name, n_regionkey, CAST(max(version) AS BIGINT) AS frozen FROM v GROUP BY 1, 2)
SELECT stable_name, frozen + n_regionkey % 3 AS head, CASE WHEN n_regionkey % 3 = 0 THEN CASE WHEN n_regionkey = 3 THEN 'ResetDraft' ELSE 'Frozen' END WHEN n_regionkey % 3 = 1 THEN 'Draft' ELSE 'Rejected' END AS state FROM h
UNION ALL SELECT 'region.new', CAST(1 AS BIGINT), 'Draft'""")
def ledger_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _nation_entries(spark, sf_dir)
    declared = entries.groupBy("stable_name").agg((F.max("version") + F.substring("stable_name", -1, 1).cast("bigint") % 3).alias("head"))
    declared = declared.unionByName(spark.createDataFrame([("region.new", 1)], "stable_name string, head long"))
    return L.readiness(declared, entries)


@query("SELECT 'part.p' || p_size AS stable_name, CAST(greatest(1, max(p_partkey % 9)) AS BIGINT) AS head FROM part GROUP BY 1")
def head_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.heads(table(spark, sf_dir, "part").select(F.concat(F.lit("part.p"), "p_size").alias("stable_name"), (F.col("p_partkey") % 9).alias("boundary")))


def _part_facts(spark: SparkSession, sf_dir: str, changed: bool) -> DataFrame:
    """A flattened ledger: a history for each part, with its name, size and length as fields."""
    rows, k = table(spark, sf_dir, "part"), F.col("p_partkey") % 6
    field = lambda name, attribute, value: F.struct(F.lit(f'$["{name}"]').alias("path"), F.lit(attribute).alias("attribute"), value.alias("value"))
    same = F.lit(not changed)
    facts = [
        F.struct(F.lit("$").alias("path"), F.lit("kind").alias("attribute"), F.lit("record").alias("value")),
        field("name", "presence", F.when((k == 1) & ~same, F.lit(None)).otherwise("required")),
        field("name", "kind", F.when((k == 1) & ~same, F.lit(None)).otherwise("string")),
        field("size", "presence", F.when((k == 2) & ~same, "optional").otherwise("required")),
        field("size", "kind", F.when((k == 3) & ~same, "i64").otherwise("i32")),
        field("more", "presence", F.when((k == 4) & ~same, "required")),
        field("more", "kind", F.when((k == 4) & ~same, "bool")),
        field("fixed", "presence", F.lit("required")),
        field("fixed", "length", F.when((k == 5) & ~same, "3").otherwise("2")),
    ]
    out = rows.select(F.concat(F.lit("part.p"), "p_partkey").alias("stable_name"), F.lit(1).cast("long").alias("version"), F.explode(F.array(*facts)).alias("f"), (F.col("p_partkey") % 50 == 0).alias("drop"))
    out = out.select("stable_name", "version", "f.*", "drop").where("value IS NOT NULL")
    return (out.where("NOT drop") if changed else out).drop("drop")


@query(
    """WITH p AS (SELECT 'part.p' || p_partkey AS stable_name, CASE WHEN p_partkey % 50 = 0 THEN 9 ELSE p_partkey % 6 END AS k FROM part)
    SELECT stable_name, CAST(1 AS BIGINT) AS version, CASE k WHEN 9 THEN '$' WHEN 1 THEN '$["name"]' WHEN 2 THEN '$["size"]' WHEN 3 THEN '$["size"]' WHEN 4 THEN '$["more"]' ELSE '$["fixed"]' END AS path,
    CASE k WHEN 9 THEN 'history_missing' WHEN 1 THEN 'field_missing' WHEN 2 THEN 'field_presence_changed' WHEN 3 THEN 'shape_kind_changed' WHEN 4 THEN 'field_added' ELSE 'array_length_changed' END AS code FROM p WHERE k <> 0"""
)
def ledger_diff_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two flattened ledgers of a history a part, compared by joins."""
    return L.diff(_part_facts(spark, sf_dir, False), _part_facts(spark, sf_dir, True)).select("stable_name", "version", "path", "code")


@query("SELECT * FROM (VALUES ('shop.line', 1::BIGINT, '$[\"quantity\"]', 'shape_kind_changed'), ('shop.line', 1::BIGINT, '$[\"note\"]', 'field_missing')) t(stable_name, version, path, code)")
def ledger_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frozen ledger against edited declarations."""
    saved = L.Ledger.observed([LINE, ORDER])
    edited = History.declare("shop.line", Field("quantity", U32), Field("flag", option(STRING), required=True))
    return L.check(spark, saved, [edited, ORDER]).select("stable_name", "version", "path", "code")


# ------------------------------------------------- floats, past versions, findings

READING = History.declare("shop.reading", Field("level", F32))


@query("SELECT p_partkey, CAST(CAST(CAST(p_partkey AS VARCHAR) || '.000000059604644775390625000000001' AS FLOAT) AS DOUBLE) AS level FROM part")
def narrow_floats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A float is the nearest one to the number as it is spelt, not to the double between."""
    spelt = F.concat(number("p_partkey"), F.lit(".000000059604644775390625000000001"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.lit(1).alias("version"), text(level=spelt).alias("payload"))
    return upgrade(rows, READING, keep=["p_partkey"]).select("p_partkey", F.col("record.level").cast("double").alias("level"))


@query("SELECT p_partkey, p_partkey % 3 <> 0 AS written, CASE WHEN p_partkey % 3 = 0 THEN 'a number is not finite' END AS cause FROM part")
def finite_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record with NaN or an infinity has no envelope, and a cause."""
    level = F.when(F.col("p_partkey") % 3 > 0, F.col("p_retailprice")).when(F.col("p_partkey") % 2 == 0, float("nan")).otherwise(float("-inf")).cast("float")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.struct(level.alias("level")).alias("record"))
    return to_versioned(rows, READING, cause="cause").select("p_partkey", F.col("envelope").isNotNull().alias("written"), "cause")


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'UnsupportedVersion' END AS kind FROM part")
def whole_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A version that is no whole number is no version."""
    version = F.lit(1.0) + F.when(F.col("p_partkey") % 2 == 0, 0.5).otherwise(0.0)
    rows = table(spark, sf_dir, "part").select("p_partkey", version.alias("version"), text(level="1").alias("payload"))
    return upgrade(rows, READING, keep=["p_partkey"]).select("p_partkey", F.col("error.kind").alias("kind"))


BADGE = History.declare(
    "shop.badge",
    Field("holder", STRING, redact=True),
    Field("points", U64, redact=True, updates=(Update(2, STRING, using=lambda p: p.points.try_cast("decimal(20,0)")),)),
    Field("door", STRING, added_in=2, value="main"),
)


@query(
    """SELECT c_custkey, CAST(1 AS BIGINT) AS version, '[REDACTED]' AS holder, '[REDACTED]' AS points, CAST(NULL AS VARCHAR) AS door FROM customer
    UNION ALL SELECT c_custkey, 2, '[REDACTED]', '0', 'side' FROM customer"""
)
def redacted_at_each_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of every retained version, hidden by the fields as they were then."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", quoted("c_name").alias("holder"), number("c_custkey").alias("points"))
    one = redact(upgrade(rows.select("c_custkey", F.lit(1).alias("version"), text(holder=F.col("holder"), points=quoted("points")).alias("payload")), BADGE.as_of(1), keep=["c_custkey"]), BADGE.as_of(1))
    two = redact(upgrade(rows.select("c_custkey", F.lit(2).alias("version"), text(holder=F.col("holder"), points=F.col("points"), door='"side"').alias("payload")), BADGE, keep=["c_custkey"]), BADGE)
    pick = lambda df, door: df.select("c_custkey", F.col("source_version").alias("version"), "record.holder", F.col("record.points").cast("string").alias("points"), door.alias("door"))
    return pick(one, F.lit(None).cast("string")).unionByName(pick(two, F.col("record.door")))


@query(
    """SELECT 'n' || n_nationkey AS stable_name, CAST(1 AS BIGINT) AS version, code FROM nation,
    (VALUES (0, 'released_reset'), (1, 'metadata_changed'), (2, 'profile_changed')) f(k, code) WHERE n_nationkey % 3 = k"""
)
def released_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reset of a released version, other metadata, and another profile, found by joins."""
    rows = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("stable_name"), F.lit(1).cast("long").alias("version"), (F.col("n_nationkey") % 3).alias("k"))
    entries = rows.select("stable_name", "version", F.lit("{}").alias("metadata"), F.lit(False).alias("reset_draft"))
    now = rows.select("stable_name", "version", F.when(F.col("k") == 1, '{"owner":1}').otherwise("{}").alias("metadata"), (F.col("k") == 0).alias("reset_draft"))
    facts = rows.select("stable_name", "version", F.lit("$").alias("path"), F.lit("kind").alias("attribute"), F.lit("uuid").alias("value"))
    other = facts.withColumn("value", F.when(F.pmod(F.substring("stable_name", 2, 9).cast("int"), F.lit(3)) == 2, "date").otherwise("uuid"))
    return L.entry_findings(entries, now, True).unionByName(L.diff(facts, other)).select("stable_name", "version", "code")
