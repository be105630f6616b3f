"""Expression profiles of a growing text corpus, as a stream.

A corpus is a count matrix: a document is a cell, its source the region, its language the cell type, a word a gene. The
job prepares it as single-cell counts are prepared: each cell's counts are scaled to a common total and log1p is taken,
groups get their mean profile and the share of cells that show a gene, and each gene of a region the entropy of its
means over types: markers of one language have 0 bits, words common to all have many.

New files of the documents table are read once, by a file stream with an available-now trigger whose checkpoint holds the
files done. A batch adds to `<output>/sums`, partitioned by batch, the sums of its own documents; sums can be added, so no
earlier document is read again. A batch done again after a failure replaces its partition. When the stream has ended, the
sums of all batches are added up into `<output>/profiles`, partitioned by region, written whole. `<output>/made` marks
profiles that hold all sums: it is emptied before a batch, written last, and a run that finds nothing new keeps them.

A null text is a cell without genes, a null source or language is called 'unknown', a repeated row is another cell.

    python -m jobs.text_profiles --documents PATH --output DIR --checkpoint DIR [--config FILE]"""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoloom.operators.heterogeneity import with_type_entropy
from cytoloom.operators.preprocess import log_normalise

from .common import ensured, main, replace_partitions, told

#: gene is null in the row that counts a group's cells.
SUMS = "region string, cell_type string, gene string, cells long, total double, batch long"
PROFILES = "cell_type string, gene string, cells long, detected long, mean double, entropy double, region string"
#: one row, the number of profile rows, once they hold all sums; none while they may not
MADE = "rows long"
#: rows of a document and a word that a task hands on at once, but for a document with more
BLOCK = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DEFAULTS = {"target": 1e4, "files_per_batch": 64}


def counts(docs: DataFrame) -> DataFrame:
    """(region, cell_type, gene, value, cell_total): how often each word (between white space, A-Z lower-cased) stands in each
    document. A document is counted in the task that reads it, so rows of a document and a word, which are most of the job, go
    straight into the sums of groups and aren't shuffled by document before."""

    def block(batch, places, sizes, totals, genes, values):
        at = pa.array(np.repeat(places, sizes))
        groups = [batch.column(c).take(at) for c in ("region", "cell_type")]
        numbers = [pa.array(np.asarray(values, float)), pa.array(np.repeat(totals, sizes))]
        return pa.RecordBatch.from_arrays([*groups, pa.array(genes, pa.binary()), *numbers], ["region", "cell_type", "gene", "value", "cell_total"])

    def counted(batches):
        for batch in batches:
            found = places, sizes, totals, genes, values = [], [], [], [], []
            for place, text in enumerate(batch.column("text").to_pylist()):
                words = (text or b"").lower().split()  # of bytes: A-Z, and the white space of ASCII
                if words:
                    held = Counter(words)
                    places.append(place)
                    sizes.append(len(held))
                    totals.append(len(words))
                    genes.extend(held.keys())
                    values.extend(held.values())
                if len(genes) >= BLOCK:
                    yield block(batch, *found)
                    for each in found:
                        each.clear()
            if genes:
                yield block(batch, *found)

    texts = docs.select(F.col("text").cast("binary").alias("text"), F.col("source").alias("region"), F.col("lang").alias("cell_type"))
    rows = texts.mapInArrow(counted, "region string, cell_type string, gene binary, value double, cell_total long")
    return rows.withColumn("gene", F.col("gene").cast("string"))


def group_sums(docs: DataFrame, target: float) -> DataFrame:
    """(region, cell_type, gene, cells, total): for each group and gene the cells that show it and their summed normalised
    values, and the group's number of cells in a row without gene."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c) for c in ("source", "lang")]
    docs = docs.select(F.col("text").cast("string").alias("text"), *named)
    normal = log_normalise(counts(docs), target, total="cell_total")
    genes = normal.groupBy("region", "cell_type", "gene").agg(F.count("*").alias("cells"), F.sum("value").alias("total"))
    sizes = docs.groupBy(F.col("source").alias("region"), F.col("lang").alias("cell_type")).agg(F.lit(None).cast("string").alias("gene"), F.count("*").alias("cells"), F.lit(0.0).alias("total"))
    return genes.unionByName(sizes)


def profiles(sums: DataFrame) -> DataFrame:
    """(region, cell_type, gene, cells, detected, mean, entropy) from the sums of all batches; cells without a gene count as
    zeros in its mean."""
    sizes = sums.filter("gene IS NULL").groupBy("region", "cell_type").agg(F.sum("cells").alias("cells"))
    # dealt once, by ranges: the sums over batches and types keep to them, a region with many genes is several tasks' work
    # and a task writes to few regions
    dealt = sums.filter("gene IS NOT NULL").drop("batch").repartitionByRange("region", "gene")
    own = dealt.groupBy("region", "cell_type", "gene").agg(F.sum("cells").alias("detected"), F.sum("total").alias("total")).join(F.broadcast(sizes), ["region", "cell_type"])
    # gene before region, since rows are sorted by both and most differ in their gene
    means = with_type_entropy(own.withColumn("value", F.col("total") / F.col("cells")), ["gene", "region"])
    return means.select("cell_type", "gene", "cells", "detected", F.col("value").alias("mean"), "entropy", "region")


def result(spark: SparkSession, output: str) -> DataFrame:
    """What the job has written so far."""
    return spark.read.schema(PROFILES).parquet(f"{output}/profiles").select("region", "cell_type", "gene", "cells", "detected", "mean", "entropy")


def run(spark: SparkSession, config: dict) -> int:
    """Take in what is new and bring the profiles up to date; the number of documents read."""
    config = {**DEFAULTS, **config}
    documents, output, checkpoint = (config[k].rstrip("/") for k in ("documents", "output", "checkpoint"))
    made, read = f"{output}/made", 0

    def written() -> tuple[int, int]:
        ensured(spark, f"{output}/profiles", PROFILES, "region")
        return tuple(result(spark, output).agg(F.countDistinct("region"), F.count("*")).first())

    def add(batch: DataFrame, number: int) -> None:
        nonlocal read
        if not ensured(spark, f"{output}/sums", SUMS, "batch").filter(F.col("batch") > number).isEmpty():
            raise ValueError(f"{output} holds later batches than {checkpoint} knows of: they belong to another checkpoint")
        spark.createDataFrame([], MADE).write.mode("overwrite").parquet(made)
        sums = group_sums(batch, float(config["target"])).withColumn("batch", F.lit(number).cast("long"))
        replace_partitions(sums, f"{output}/sums", "batch")
        n = ensured(spark, f"{output}/sums", SUMS, "batch").filter((F.col("batch") == number) & F.col("gene").isNull()).agg(F.coalesce(F.sum("cells"), F.lit(0))).first()[0]
        read += n
        told("text_profiles", "batch", number=number, documents=n)

    schema = spark.read.parquet(documents).select("text", "source", "lang").schema
    # a stream takes a path to a single file only as a pattern; this one matches the path itself and nothing else
    pattern = documents if set(documents) & set("*?[{") else f"{documents[:-1]}[{documents[-1]}]"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", int(config["files_per_batch"])).parquet(pattern)
    query = stream.writeStream.foreachBatch(add).queryName(f"text_profiles_{uuid.uuid4().hex}").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    told("text_profiles", "read", documents=documents, rows=read)
    sums = ensured(spark, f"{output}/sums", SUMS, "batch")
    spark.createDataFrame([], MADE).write.mode("ignore").parquet(made)
    held = spark.read.schema(MADE).parquet(made).agg(F.max("rows")).first()[0]
    regions, rows = written()
    event = "kept" if rows == held else "written"
    if event == "written":
        profiles(sums).write.mode("overwrite").partitionBy("region").parquet(f"{output}/profiles")
        regions, rows = written()
        spark.createDataFrame([(rows,)], MADE).coalesce(1).write.mode("overwrite").parquet(made)
    told("text_profiles", event, output=output, regions=regions, rows=rows)
    return read


if __name__ == "__main__":
    main("text_profiles", run, {"documents": "a parquet file or folder of documents", "output": "folder of sums and profiles", "checkpoint": "folder of the stream's checkpoint"})
