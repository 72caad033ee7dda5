"""JSON exports."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json_lines(df: DataFrame, path: str) -> None:
    """One JSON object a line, in as many files as there are partitions."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def write_json_file(df: DataFrame, file: str, max_bytes: int = 5 * 1024**3) -> int:
    """One uncompressed file with a JSON object a line, on any file system; its size. More than ``max_bytes`` is an error,
    and then no file is left."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    folder, target = path(f"{file}.parts"), path(file)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).coalesce(1).write.mode("overwrite").option("compression", "none").text(f"{file}.parts")
    found = list(fs.globStatus(path(f"{file}.parts/part-*")) or [])
    size = sum(x.getLen() for x in found)
    try:
        if size > max_bytes:
            raise ValueError(f"{file} would have {size} bytes, more than {max_bytes}")
        fs.delete(target, False)
        if found:
            fs.rename(found[0].getPath(), target)
        else:
            fs.create(target).close()
    finally:
        fs.delete(folder, True)
    return size


def write_json_array(df: DataFrame, file: str, order: tuple[str, ...]) -> int:
    """An indented JSON array with sorted keys, for result tables that people read; rows stream through the driver."""
    n = 0
    with Path(file).open("w", encoding="utf-8") as out:
        out.write("[")
        for row in df.orderBy(*order).select(F.to_json(F.struct(*df.columns)).alias("j")).toLocalIterator():
            text = json.dumps(json.loads(row.j), indent=2, sort_keys=True, ensure_ascii=False)
            out.write(("," if n else "") + "\n" + "\n".join("  " + line for line in text.split("\n")))
            n += 1
        out.write("\n]\n" if n else "]\n")
    return n
