"""Messages and blocks from flat tables.

``messages`` has conv_id, ord, id, role, content_type, text, tool_name, tool_call_id; ``blocks`` has
conv_id, block_id, block_num, tier, topic, summary, direct_message_ids, effective_message_ids,
direct_block_ids, compressed_tokens, active, compress_call_id, start_ref, end_ref.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions.scalars import content_id, count_tokens


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store_root(spark: SparkSession, label: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names, which all executors share; it goes when
    the driver's JVM ends.  Where the setting is unset, executors must be local, too."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.gettempdir()
    jvm = spark.sparkContext._jvm
    own = jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/threadloom-own-{spark.sparkContext.applicationId}")
    fs = own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(own)
    fs.deleteOnExit(own)
    made = fs.makeQualified(jvm.org.apache.hadoop.fs.Path(own, f"{label}-{uuid.uuid4().hex}")).toString()
    return "file://" + made[len("file:") :] if made.startswith("file:/") and not made.startswith("file://") else made


def written(rows: DataFrame, label: str) -> DataFrame:
    """Rows that several steps need, written once to the shared folder: nothing before them runs again, and the
    plan of what follows starts there."""
    path = store_root(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def with_ids(messages: DataFrame) -> DataFrame:
    """Content-hash ids; the n-th repeat of one in a conversation, from the second on, gets ``_n``."""
    nth = F.row_number().over(Window.partitionBy("conv_id", "_base").orderBy("ord")) - 1
    based = messages.withColumn("_base", content_id()).withColumn("_n", nth)
    return based.withColumn("id", F.when(F.col("_n") == 0, F.col("_base")).otherwise(F.concat_ws("_", "_base", "_n"))).drop("_base", "_n")


_COLUMNS = ["conv_id", "ord", "id", "role", "content_type", "text", "tool_name", "tool_call_id"]


def conversation_messages(conversations: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    rows = conversations.select("conv_id", F.col("turn").alias("ord"), "role", F.lit("text").alias("content_type"), "text", none.alias("tool_name"), none.alias("tool_call_id"))
    return with_ids(rows).select(_COLUMNS)


def session_messages(events: DataFrame) -> DataFrame:
    """A user's events as one session of calls, results, remarks and reasoning."""
    kind = F.col("event_type")
    k = F.regexp_extract("props", "[0-9]+", 0)
    pick = lambda **by: F.coalesce(*[F.when(kind == t, F.lit(v)) for t, v in by.items()])
    ordered = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    rows = events.select(
        F.col("user_id").alias("conv_id"),
        ordered.cast("long").alias("ord"),
        pick(view="assistant", click="tool", error="tool", purchase="user", signup="assistant").alias("role"),
        pick(view="tool-call", click="tool-result", error="tool-result", purchase="text", signup="reasoning").alias("content_type"),
        F.repeat(F.concat("props", F.lit(" ")), F.col("value").cast("int") + 1).alias("text"),
        pick(view="read", error="bash").alias("tool_name"),
        F.when(kind.isin("view", "click", "error"), F.concat(F.lit("c"), (k.cast("int") % 10).cast("string"))).alias("tool_call_id"),
    )
    return with_ids(rows).select(_COLUMNS)


def sample_blocks(messages: DataFrame) -> DataFrame:
    """Two blocks of two messages each where a conversation has six; in each third one a tier-2
    block on top of the first."""
    per = messages.filter("ord between 1 and 4").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("ord", "id", "text"))).alias("m"))
    sizes = messages.groupBy("conv_id").agg(F.max("ord").alias("last"))
    base = per.join(sizes.filter("last >= 5"), "conv_id").filter(F.size("m") == 4)
    m = F.col("m")
    two = (F.col("conv_id") % 3) == 0

    def block(n, tier, ids, topic, children, active, call):
        texts = F.concat(*[F.substring(F.coalesce(m[i]["text"], F.lit("")), 1, 80) for i in ids])
        return F.struct(
            F.lit(f"b{n}").alias("block_id"),
            F.lit(n).alias("block_num"),
            F.lit(tier).alias("tier"),
            F.lit(topic).alias("topic"),
            texts.alias("summary"),
            F.array(*[m[i]["id"] for i in ids]).alias("effective_message_ids"),
            F.array(*map(F.lit, children)).cast("array<string>").alias("direct_block_ids"),
            active.alias("active"),
            F.lit(call).alias("compress_call_id"),
        )

    one = block(1, 1, (0, 1), "start", (), ~two, "k1")
    more = block(2, 1, (2, 3), "middle", (), F.lit(True), "k2")
    top = block(3, 2, (0, 1), None, ("b1",), F.lit(True), "k3")
    rows = base.select("conv_id", F.explode(F.when(two, F.array(one, more, top)).otherwise(F.array(one, more))).alias("b")).select("conv_id", "b.*")
    return rows.withColumn("compressed_tokens", count_tokens("summary") * 10)
