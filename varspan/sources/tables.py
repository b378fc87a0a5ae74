"""Tables that several later steps read, written once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """The table, written as Parquet to the folder of ``spark.checkpoint.dir`` and read again; in local mode, where that is unset, to a temporary one.

    Its lineage ends there, a lost executor costs no more than reading it again, and plans know its size.
    The files go when the driver's JVM ends.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="varspan-"))
        folder = sc.getCheckpointDir()
    path = f"{folder.rstrip('/')}/varspan-{uuid.uuid4().hex}"
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(p)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
