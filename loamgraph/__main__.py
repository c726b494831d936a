"""python -m loamgraph ingest FOLDER OUT: reads a folder's files, and writes their documents and chunks as tables."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import chunking
from .sources import files


def main() -> None:
    parser = argparse.ArgumentParser(prog="loamgraph", description=__doc__)
    parser.add_argument("command", choices=["ingest"])
    parser.add_argument("folder")
    parser.add_argument("out")
    parser.add_argument("--size", type=int, default=chunking.SIZE)
    parser.add_argument("--overlap", type=int, default=chunking.OVERLAP)
    args = parser.parse_args()
    spark = SparkSession.builder.appName("loamgraph").getOrCreate()
    found = files.scan(spark, args.folder)
    docs = files.text_files(found)
    docs.write.mode("overwrite").parquet(f"{args.out}/documents")
    plain = chunking.by_tokens(docs, args.size, args.overlap, text_col="content").withColumn("modality", F.lit("text"))
    office = files.office_files(found).select(F.col("file_path").alias("doc_id"), "chunk_order_index", "content", "modality")
    plain.unionByName(office, allowMissingColumns=True).write.mode("overwrite").parquet(f"{args.out}/chunks")


if __name__ == "__main__":
    main()
