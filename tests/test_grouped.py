"""Groups of rows as a stream."""

import pyarrow as pa
from pyspark.sql import functions as F

from threadloom.sources import codecs, grouped


def test_groups_go_on_in_the_next_batch():
    batches = [pa.RecordBatch.from_pydict({"k": k, "v": v}) for k, v in (([1, 1, 2], [1, 2, 3]), ([2, 2], [4, 5]), ([None, 3], [6, 7]))]
    assert [(k, [r[1] for r in rows]) for k, rows in grouped.groups(batches, 0)] == [(1, [1, 2]), (2, [3, 4, 5]), (None, [6]), (3, [7])]


def test_what_is_given_back_is_bounded(spark):
    schema = grouped.arrow_schema("k long, t string")
    made = list(grouped.batched(((i, "x" * 100_000) for i in range(200)), schema))
    assert sum(b.num_rows for b in made) == 200 and max(b.nbytes for b in made) < 2 * grouped.CHARS


def test_parts_of_a_union_meet(spark):
    left, right = (spark.range(3000).groupBy((F.col("id") % n).alias("k")).agg(F.sum("id").alias("v")) for n in (700, 900))
    out = grouped.by_key(left.unionByName(right), "k", ["v"], lambda k, rows: [(k, len(rows))], "k long, n long").collect()
    assert len(out) == 900 and all(r.n == (2 if r.k < 700 else 1) for r in out)


def test_texts_reach_python_in_small_batches(spark):
    """Ten bodies of a megabyte were one batch; now none holds more than the pieces of one."""
    whole = "".join(chr(0x1F600 + i % 50) + "a\nb" for i in range(200_000))
    bodies = spark.range(12).select("id", F.when(F.col("id") == 0, "").when(F.col("id") > 1, F.concat(F.lit(whole), F.col("id").cast("string"))).alias("body")).coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        out = {r.k: (r.n, r.same) for r in grouped.by_text(bodies, "id", "body", lambda k, t: [(k, None if t is None else len(t), t == f"{whole}{k}")], "k long, n long, same boolean").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert out[0] == (0, False) and out[1] == (None, False) and all(out[k] == (len(whole) + len(str(k)), True) for k in range(2, 12))


def test_every_body_is_told(spark):
    bodies = spark.createDataFrame([(1, None), (2, ""), (3, "[1]"), (4, '{"input":[]}')], "conv_id long, body string")
    assert {r.conv_id: r.kind for r in codecs.kinds(bodies).collect()} == {1: None, 2: None, 3: None, 4: "responses"}
    assert {r.conv_id: r.error for r in codecs.unreadable(bodies).collect()} == {1: "TypeError", 2: "no JSON", 3: "TypeError"}
    assert codecs.flatten(bodies).count() == 0
