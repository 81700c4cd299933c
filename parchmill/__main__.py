"""python -m parchmill index FILES OUT | ask INDEX QUESTIONS OUT

``index`` reads a folder of files into a table of chunks with vectors (rejected files go to
OUT/rejects); ``ask`` answers a table (qid, question) of Parquet files from such an index."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import backends
from .plans.pipeline import answer_questions, build_index
from .sources.files import extract, read_files


def main(args: list[str], spark: SparkSession | None = None) -> int:
    if len(args) == 3 and args[0] == "index":
        spark = spark or SparkSession.builder.getOrCreate()
        files = read_files(spark, args[1]).withColumn("doc_id", F.xxhash64("path"))
        pages, rejects = extract(files)
        build_index(pages).write.mode("overwrite").parquet(f"{args[2]}/index")
        rejects.write.mode("overwrite").parquet(f"{args[2]}/rejects")
    elif len(args) == 4 and args[0] == "ask":
        spark = spark or SparkSession.builder.getOrCreate()
        answer_questions(spark.read.parquet(args[2]), spark.read.parquet(args[1])).write.mode("overwrite").parquet(args[3])
    else:
        print(__doc__)
        return 2
    return 0


if __name__ == "__main__":
    backends.register()
    sys.exit(main(sys.argv[1:]))
