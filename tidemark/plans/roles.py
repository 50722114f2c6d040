"""The driver's tables in the roles of this library: feed, content, dump, state, ledger.

Every frame here is derived from whole tables by DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.ids import format_id
from tidemark.plans.local import local_table
from tidemark.schemas import by_type

# The wiki the feed is filtered for; clicks are published under another one.
WIKI = "mainwiki"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ms(ts: Column) -> Column:
    """Milliseconds of a zone-less timestamp, whatever the session's time zone is."""
    since = ts - F.lit("1970-01-01").cast("timestamp_ntz")
    return F.floor(since.cast("interval second").cast("decimal(20,6)") * 1000).cast("bigint")


def event_revision() -> Column:
    return F.from_json("props", "k BIGINT")["k"]


def user_type() -> Column:
    """Entity type of a user: most are items."""
    user = F.col("user_id")
    return F.when(user < 100, "Item").when(user < 130, "Property").otherwise("Lexeme")


def event_kind() -> Column:
    kind = F.col("event_type")
    return F.when(kind == "signup", "new").when(kind == "error", "log").otherwise("edit")


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as commands on users: errors delete, everything else updates."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.lit("Item").alias("entity_type"),
        F.col("user_id").alias("entity_num"),
        F.when(F.col("event_type") == "error", "D").otherwise("U").alias("op"),
        event_revision().alias("revision"),
        "value",
    )


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as stored entities at revision 50."""
    return table(spark, sf_dir, "customer").select(
        F.lit("Item").alias("entity_type"),
        F.col("c_custkey").alias("entity_num"),
        F.lit(50).cast("bigint").alias("revision"),
        F.col("c_acctbal").alias("value"),
    )


def position_json(ms: Column, reversed_order: Column) -> Column:
    head = F.lit('{"topic":"east.changes","partition":0,"timestamp":')
    timed = F.concat(head, ms.cast("string"), F.lit("}"))
    counted = F.lit('{"topic":"west.changes","partition":0,"offset":-1}')
    first = F.when(reversed_order, counted).otherwise(timed)
    second = F.when(reversed_order, timed).otherwise(counted)
    return F.concat(F.lit("["), first, F.lit(","), second, F.lit("]"))


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as landed feed records.

    Clicks belong to another wiki; purchases carry a redirect comment. Some payloads are damaged: cut
    off where value > 300, of an unknown kind where value < 0.5, without a readable title where the
    revision is 13.
    """
    # Step by step, each column once: one that is used several times is not computed again, one that is not used not at all.
    user = F.col("_user")
    title = F.concat(by_type(user, "title_prefix"), format_id(user, F.col("user_id")))
    payload = F.to_json(
        F.struct(
            F.struct(F.col("event_id").cast("string").alias("id"), F.lit("changes").alias("stream")).alias("meta"),
            F.col("_kind").alias("type"),
            by_type(user, "namespace").alias("namespace"),
            F.when(F.col("_revision") == 13, F.concat(F.lit("x"), F.col("_title"))).otherwise(F.col("_title")).alias("title"),
            F.when(F.col("event_type") == "purchase", "/* wbcreateredirect:0||Q1|Q2 */")
            .otherwise('edited "this" page')
            .alias("comment"),
            F.when(F.col("_kind") != "log", F.struct((F.col("_revision") - 1).alias("old"), F.col("_revision").alias("new")))
            .alias("revision"),
            F.when(F.col("event_type") == "click", "otherwiki").otherwise(WIKI).alias("wiki"),
        )
    )
    events = table(spark, sf_dir, "events").withColumns({
        "_user": user_type(),
        "_kind": F.when(F.col("value") < 0.5, "categorize").otherwise(event_kind()),
        "_revision": event_revision(),
    })
    landed = events.withColumn("_title", title).withColumn("_payload", payload)
    return landed.select(
        F.col("event_id").alias("seq"),
        position_json(epoch_ms(F.col("ts")), F.col("event_type") == "view").alias("event_id_json"),
        F.when(F.col("value") > 300, F.substring("_payload", 1, 40)).otherwise(F.col("_payload")).alias("data"),
    )


def typed_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, event_ts_ms, entity_type, data) of every event, for rates and lag."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        epoch_ms(F.col("ts")).alias("event_ts_ms"),
        user_type().alias("entity_type"),
        F.col("props").alias("data"),
    )


def content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content responses for every user and revision of the events.

    Customers of the BUILDING segment have no response, those of MACHINERY answer with another entity
    (a redirect), those of FURNITURE with a document that is one revision further, and those of
    HOUSEHOLD at revision 7 with a document whose revision is text.
    """
    asked = (
        table(spark, sf_dir, "events")
        .select("user_id", user_type().alias("entity_type"), event_revision().alias("requested_revision"))
        .distinct()
    )
    known = table(spark, sf_dir, "customer").where(F.col("c_mktsegment") != "BUILDING")
    rows = asked.join(known, F.col("user_id") == F.col("c_custkey"))
    segment = F.col("c_mktsegment")
    answered = F.when(segment == "MACHINERY", F.col("user_id") + 1).otherwise(F.col("user_id"))
    revision = F.when(segment == "FURNITURE", F.col("requested_revision") + 1).otherwise(
        F.col("requested_revision")
    )
    as_text = (segment == "HOUSEHOLD") & (F.col("requested_revision") == 7)
    shown = F.when(as_text, F.concat(F.lit('"'), revision.cast("string"), F.lit('"'))).otherwise(
        revision.cast("string")
    )
    id_text = format_id(F.col("entity_type"), answered)
    body = F.format_string(
        '{"entities":{"%s":{"id":"%s","lastrevid":%s,"label":"%s"}}}', id_text, id_text, shown, F.col("c_name")
    )
    return rows.select(
        "entity_type", F.col("user_id").alias("entity_num"), "requested_revision", body.alias("body")
    )


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as entity lines (doc_id, line)."""
    doc = F.struct(
        F.concat(F.lit("Q"), F.col("doc_id").cast("string")).alias("id"),
        F.col("n_chars").alias("lastrevid"),
        F.col("text").alias("text"),
    )
    return table(spark, sf_dir, "documents").select("doc_id", F.to_json(doc).alias("line"))


def document_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines as the text of a JSON-array dump, with a blank line in it."""
    lines = document_lines(spark, sf_dir)
    last = lines.agg(F.max("doc_id")).first()[0]
    elements = lines.select(
        F.when(F.col("doc_id") == last, F.col("line")).otherwise(F.concat("line", F.lit(","))).alias("value")
    )
    return elements.union(local_table(spark, [("[",), ("",), ("]",)], "value STRING"))


def damaged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document lines, some unusable: cut off (src3), without revision (src4), with a signed id (src5),
    of another entity type (src6)."""
    doc = table(spark, sf_dir, "documents")
    source = F.col("source")
    id_text = F.concat(
        F.when(source == "src5", "Q+").when(source == "src6", "P").otherwise("Q"),
        F.col("doc_id").cast("string"),
    )
    revision = F.when(source != "src4", F.col("n_chars"))
    line = F.to_json(F.struct(id_text.alias("id"), revision.alias("lastrevid"), F.col("text").alias("text")))
    return doc.select(
        F.when(source == "src3", F.substring(line, 1, 30)).otherwise(line).alias("value")
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as stored entities with their text as the body."""
    return table(spark, sf_dir, "documents").select(
        F.lit("Item").alias("entity_type"),
        F.col("doc_id").alias("entity_num"),
        F.col("n_chars").alias("revision"),
        F.col("text").alias("data"),
    )


def order_type() -> Column:
    status = F.col("o_orderstatus")
    return F.when(status == "F", "Item").when(status == "O", "Property").otherwise("Lexeme")


def lineitem_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a dump that repeats entities (their orders)."""
    return table(spark, sf_dir, "lineitem").select(
        F.lit("Item").alias("entity_type"),
        F.col("l_orderkey").alias("entity_num"),
        (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("revision"),
        F.concat("l_returnflag", "l_linestatus", F.col("l_suppkey").cast("string")).alias("data"),
    )


def order_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as looked-up content; those in status P are not found."""
    return table(spark, sf_dir, "orders").where(F.col("o_orderstatus") != "P").select(
        F.lit("Item").alias("entity_type"),
        F.col("o_orderkey").alias("entity_num"),
        F.lit(1).cast("bigint").alias("revision"),
        F.col("o_orderpriority").alias("data"),
    )


def order_keys(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    row = table(spark, sf_dir, "orders").agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    return row[0], row[1]


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as work items by type: all pending, persisted unless their price is above 499,000."""
    orders = table(spark, sf_dir, "orders")
    item = [order_type().alias("entity_type"), F.col("o_orderkey").alias("item_id")]
    pending = orders.select(*item, F.lit("pending").alias("state"))
    persisted = orders.where(F.col("o_totalprice") <= 499000).select(*item, F.lit("persisted").alias("state"))
    return pending.union(persisted)


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with an arrival order that differs from event_id by up to 30 places."""
    return table(spark, sf_dir, "events").select(
        "event_id", (F.col("event_id") + (F.col("event_id") * 7919) % 31).alias("arrival")
    )
