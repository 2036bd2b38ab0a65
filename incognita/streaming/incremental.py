"""Obfuscating a stream of fragments, one micro-batch after another.

The state folder has tables partitioned by batch: mapping (stand-ins), people (persons that are new or told more fully) and
redo (documents of earlier batches that name, in clear, somebody learned since). A batch reads what earlier ones learned,
learns from its own fragments, writes what is new, and replaces with all that is known by then; a batch that runs twice
overwrites its own partitions, so results are the same. Stand-ins once given stay.

A name that an earlier batch could not know stays in its copies; their documents are listed in redo, and redo() gives their
new copies out of the originals, which the caller still has.

Defined cases: a batch without fragments learns nothing and writes empty copies. Columns other than doc_id, frag_id, text,
hint and header are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from incognita.operators import audit
from incognita.operators.replace import MAPPING
from incognita.plans import jobs

PEOPLE = "person_id string, sur string, gender string, name string, patr string, init_n string, init_p string"
COPIES = "doc_id long, frag_id long, text string, hint string"
TABLES = {"mapping": MAPPING, "people": PEOPLE, "redo": "doc_id long"}


def read_table(spark: SparkSession, folder: str, kind: str, before: int | None = None) -> DataFrame:
    """What all batches have written to a table, or those before one, with the number of each row's batch."""
    table = spark.read.schema(f"{kind}, batch long").option("basePath", folder).parquet(folder)
    return table if before is None else table.filter(F.col("batch") < before)


def read_mapping(spark: SparkSession, state: str, before: int | None = None) -> DataFrame:
    return read_table(spark, f"{state}/mapping", MAPPING, before).drop("batch")


def read_people(spark: SparkSession, state: str, before: int | None = None) -> DataFrame:
    """Each person as the latest batch has told of them."""
    rows = read_table(spark, f"{state}/people", PEOPLE, before)
    latest = F.row_number().over(Window.partitionBy("person_id").orderBy(F.desc("batch")))
    return rows.withColumn("latest", latest).filter("latest = 1").drop("latest", "batch")


def begin(spark: SparkSession, state: str, out: str) -> None:
    """Empty tables, so that the first batch has some to read."""
    for folder, kind in [(f"{state}/{name}", kind) for name, kind in TABLES.items()] + [(out, COPIES)]:
        spark.createDataFrame([], f"{kind}, batch long").write.mode("append").partitionBy("batch").parquet(folder)


def process_batch(fragments: DataFrame, batch: int, state: str, out: str, secret: str) -> None:
    spark = fragments.sparkSession
    columns = [c for c in ("doc_id", "frag_id", "text", "hint", "header") if c in fragments.columns]
    fragments = fragments.select(*columns).withColumns({c: F.col(c).cast("long") for c in ("doc_id", "frag_id")}).checkpoint()
    mapping, people = read_mapping(spark, state, batch), read_people(spark, state, batch)
    known = jobs.learn(fragments, mapping, secret, people=people)
    fresh = known.mapping.join(mapping.select("family", "key"), ["family", "key"], "left_anti").select(*mapping.columns)
    fresh.write.mode("overwrite").parquet(f"{state}/mapping/batch={batch}")
    known.people.select(*people.columns).subtract(people).write.mode("overwrite").parquet(f"{state}/people/batch={batch}")
    earlier = read_table(spark, out, COPIES, batch).select("doc_id", "text")
    fresh = spark.read.schema(MAPPING).parquet(f"{state}/mapping/batch={batch}")
    audit.to_redo(earlier, known.mapping, fresh.select("family", "key")).write.mode("overwrite").parquet(f"{state}/redo/batch={batch}")
    copies = jobs.obfuscate(fragments, known)
    copies.select("doc_id", "frag_id", F.col("new_text").alias("text"), "hint").write.mode("overwrite").parquet(f"{out}/batch={batch}")


def redo(originals: DataFrame, state: str, secret: str) -> DataFrame:
    """New copies (fragments with new_text and spans) of those documents of originals that batches have listed."""
    spark = originals.sparkSession
    rows = originals.join(read_table(spark, f"{state}/redo", TABLES["redo"]).select("doc_id").distinct(), "doc_id", "left_semi").checkpoint()
    return jobs.obfuscate(rows, jobs.learn(rows, read_mapping(spark, state), secret, people=read_people(spark, state)))


def start(stream: DataFrame, state: str, out: str, checkpoint: str, secret: str) -> StreamingQuery:
    """Begins to obfuscate a streaming DataFrame of fragments; all that is available, then it stops."""
    begin(stream.sparkSession, state, out)
    each = lambda df, batch: process_batch(df, batch, state, out, secret)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
