"""WARC: archives written by Spark, and read back by verifying the chain of record boundaries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varspan.llm.common import save

#: Fixed values of the format.
MAGIC, END, URN = "WARC/1.0\r\n", "\r\n\r\n", "urn:x-page:"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hex digits at a time are four letters."""
    sha = F.sha1(data)
    out = []
    for g in range(8):
        v = F.conv(F.substring(sha, 5 * g + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(ALPHABET), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def write_archives(pages: DataFrame, path: str, least: int = 0) -> None:
    """Write a record for each page to ``path``.

    Of records with equal payloads of ``least`` bytes or more, that with the smallest page_id is a
    response and the others revisit it; rows that repeat that page_id are responses too. A null
    html is an empty payload. Only ids and digests are shuffled; the html goes from the table to
    the archive in one task, unless revisits are too many for Spark to send to every task.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), html)
    rows = rows.withColumns({"size": F.octet_length("html"), "sha": base32_sha1(F.col("html").cast("binary"))})
    facts = save(rows.where(F.col("size") >= least).select("page_id", "size", "sha"), "facts")
    firsts = facts.groupBy("sha", "size").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    firsts = save(firsts, "firsts")
    again = facts.join(firsts, ["sha", "size"]).where("page_id > first").select("page_id", "sha", "first").distinct()
    again = save(again, "revisits")
    r = rows.join(again, ["page_id", "sha"], "left")
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit("\r\n"))
    one_line = lambda c: F.regexp_replace(c, r"[\r\n]+", " ")
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    http = F.concat(line("HTTP/1.1 200 OK"), line("Content-Type: text/html; charset=utf-8"), line("Content-Length: ", number("size")), F.lit("\r\n"))
    revisit = F.col("first").isNotNull()
    body = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    head = F.concat(
        F.lit(MAGIC),
        line("WARC-Type: ", F.when(revisit, "revisit").otherwise("response")),
        line(f"WARC-Record-ID: <{URN}", number("page_id"), ">"),
        line("WARC-Date: 1970-01-01T00:00:00Z"),
        line("WARC-Target-URI: ", one_line(F.col("url"))),
        line("WARC-Payload-Digest: sha1:", F.col("sha")),
        F.when(revisit, line(f"WARC-Refers-To: <{URN}", number("first"), ">")).otherwise(F.lit("")),
        F.when(revisit, line("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")).otherwise(F.lit("")),
        line("Content-Type: application/http; msgtype=response"),
        line("Content-Length: ", (F.octet_length(http) + F.octet_length(body)).cast("string")),
        F.lit("\r\n"),
    )
    r.select(F.concat(head, http, body).alias("value")).write.option("lineSep", END).text(path)


def _links(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets in order, successors, and the place of the successor in this block (-1: elsewhere)."""
    off, succ = pdf["off"].to_numpy(), pdf["succ"].to_numpy()
    at = np.searchsorted(off, succ)
    inside = (at < len(off)) & (off[np.minimum(at, len(off) - 1)] == succ) & (succ > off)
    return off, succ, np.where(inside, at, -1)


def _exits(pdf: pd.DataFrame) -> pd.DataFrame:
    """Where the chain from each candidate of a block leaves it."""
    pdf = pdf.sort_values("off")
    off, out, at = _links(pdf)
    out = out.copy()
    for k in range(len(off) - 1, -1, -1):
        if at[k] >= 0:
            out[k] = out[at[k]]
    return pd.DataFrame({"file": pdf["file"].to_numpy(), "off": off, "exit": out})


def _reached(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("off")
    _, _, at = _links(pdf)
    seen = pdf["entry"].to_numpy(dtype=bool).copy()
    for k in np.flatnonzero(at >= 0):
        seen[at[k]] |= seen[k]
    return pdf.loc[seen, ["file", "pos", "off", "succ"]]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """type, record_id, refers_to, uri, digest, http, payload facts of each record in the archives at ``path``.

    Spark cuts files into blocks and blocks at the magic line, so every row is a candidate record
    with its offset: the bytes before it in its block, and those of the blocks before. Its header
    gives its successor's offset. Chains are followed within blocks, and across blocks by pointer
    jumping from the start of the file; what they don't reach is a magic line inside a payload,
    and is joined to the record that it lies in. A record whose end is neither a candidate nor the
    end of the file is broken: it and what only it leads to are left out.
    """
    rows = _scan(spark, path)
    head = F.substring_index("value", END, 1)
    head_n, declared = F.octet_length(head).cast("long"), _declared(head)
    span = F.when(head_n + 4 <= F.col("n"), head_n + 8 + declared)
    rows = rows.withColumn("span", span).withColumn("head_n", head_n)
    rows = rows.withColumn("r", F.when(F.col("span") == F.col("n"), _parsed(F.col("value"), F.col("head_n"), F.col("span"))))
    rows = save(rows.select("file", "block", "pos", "n", "span", "r"), "candidates")
    cand = _with_offsets(rows.select("file", "block", "pos", "n", "span"))
    succ = F.coalesce(F.col("off") + len(MAGIC) + F.col("span"), F.lit(-1))
    cand = save(cand.select("file", "block", "pos", "off", succ.alias("succ"), "size"), "offsets")

    # a successor that isn't a boundary breaks its record
    ends = cand.select("file", F.col("off").alias("succ")).unionByName(cand.select("file", F.col("size").alias("succ")).distinct())
    good = save(cand.join(ends, ["file", "succ"], "left_semi").select("file", "block", "pos", "off", "succ"), "boundaries")
    jump = save(good.groupBy("file", "block").applyInPandas(_exits, "file string, off long, exit long"), "exits")
    targets = jump.select("file", F.col("exit").alias("off")).unionByName(jump.where("off = 0").select("file", "off")).distinct()
    jump = save(jump.join(targets, ["file", "off"], "left_semi").distinct(), "jumps")
    reach = save(jump.where("off = 0").select("file", "off"), "reach")
    last, n = 0, reach.count()
    while n > last:
        on = reach.join(jump, ["file", "off"]).select("file", F.col("exit").alias("off")).join(good.select("file", "off"), ["file", "off"], "left_semi")
        reach = save(reach.unionByName(on).distinct(), "reach")
        last, n = n, reach.count()
        twice = jump.join(jump.select("file", F.col("off").alias("exit"), F.col("exit").alias("next")), ["file", "exit"], "left")
        jump = save(twice.select("file", "off", F.coalesce("next", "exit").alias("exit")), "jumps")
    marked = good.join(reach.withColumn("entry", F.lit(True)), ["file", "off"], "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    real = save(marked.groupBy("file", "block").applyInPandas(_reached, "file string, pos long, off long, succ long"), "records")

    plain = rows.where("r is not null").join(real, ["file", "pos"], "left_semi").select("r.*")
    # candidates that nothing reaches, in the record that they lie in; a record without one is whole
    false = save(cand.join(real, ["file", "off"], "left_anti").select("file", "off"), "false")
    if false.isEmpty():
        return plain
    both = real.join(false.select("file").distinct(), "file", "left_semi").select("file", "off", F.col("succ")).unionByName(false.withColumn("succ", F.lit(None).cast("long")))
    owner = F.last(F.when(F.col("succ").isNotNull(), F.struct("off", "succ")), ignorenulls=True).over(Window.partitionBy("file").orderBy("off"))
    owned = both.withColumn("own", owner).where("own is not null and off < own.succ").select("file", "off", F.col("own.off").alias("at"))
    owned = save(owned, "owned")
    parts = owned.join(owned.where("off <> at").select("file", "at").distinct(), ["file", "at"], "left_semi")
    values = _with_offsets(_scan(spark, path).join(parts.select("file").distinct(), "file", "left_semi"))
    got = values.join(parts, ["file", "off"]).groupBy("file", "at").agg(F.array_sort(F.collect_list(F.struct("off", "value"))).alias("p"))
    got = got.select(F.array_join(F.transform("p", lambda x: x["value"]), MAGIC).alias("value"))
    head = F.substring_index("value", END, 1)
    got = got.withColumns({"head_n": F.octet_length(head).cast("long"), "declared": _declared(head)})
    return plain.unionByName(got.select(_parsed(F.col("value"), F.col("head_n"), F.col("head_n") + 8 + F.col("declared")).alias("r")).select("r.*"))


def _scan(spark: SparkSession, path: str) -> DataFrame:
    """A row for what follows each magic line, in order of ``pos`` in its block; the first of a file is empty."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("pos"),
        "value", F.octet_length("value").cast("long").alias("n"),
    )


def _with_offsets(rows: DataFrame) -> DataFrame:
    """``off``, the byte at which a row's magic line begins, and the file's ``size``: running sums of blocks, and within a block."""
    m = F.lit(len(MAGIC)).cast("long")
    blocks = rows.groupBy("file", "block").agg(F.sum(F.col("n") + m).alias("bytes"))
    base = F.sum("bytes").over(Window.partitionBy("file").orderBy("block")) - F.col("bytes")
    size = F.sum("bytes").over(Window.partitionBy("file")) - m
    blocks = blocks.select("file", "block", base.alias("base"), size.alias("size"))
    before = F.sum(F.col("n") + m).over(Window.partitionBy("file", "block").orderBy("pos")) - F.col("n") - m
    out = rows.withColumn("before", before).join(blocks, ["file", "block"])
    return out.withColumn("off", F.col("base") + F.col("before") - m).where("off >= 0").drop("base", "before")


def _declared(head: Column) -> Column:
    return F.regexp_extract(head, r"(?i)(?:^|\r\n)Content-Length:[ \t]*([0-9]{1,15})", 1).try_cast("long")


def _parsed(value: Column, head_n: Column, span: Column) -> Column:
    """The fields of a whole record without its magic line."""
    head = F.substring_index(value, END, 1)
    name = lambda k: F.regexp_extract(head, rf"(?i)(?:^|\r\n){k}:[ \t]*([^\r\n]*)", 1)
    data = value.cast("binary")
    block = F.substring(data, head_n.cast("int") + 5, (span - head_n - 8).cast("int"))
    http = F.substring_index(block.cast("string"), END, 1)
    http_n = F.octet_length(http)
    payload = F.substring(block, http_n + 5, F.greatest(F.octet_length(block) - http_n - 4, F.lit(0)))
    full = F.regexp_extract(http, r"(?i)\r\nContent-Length:[ \t]*([0-9]{1,15})", 1)
    return F.struct(
        F.lower(name("WARC-Type")).alias("type"),
        F.regexp_extract(name("WARC-Record-ID"), rf"<{URN}(-?[0-9]+)>", 1).try_cast("long").alias("page_id"),
        F.regexp_extract(name("WARC-Refers-To"), rf"<{URN}(-?[0-9]+)>", 1).try_cast("long").alias("refers_to"),
        F.regexp_extract(name("WARC-Payload-Digest"), "sha1:([A-Z2-7]+)", 1).alias("digest"),
        full.try_cast("long").alias("full_bytes"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        base32_sha1(payload).alias("payload_digest"),
    )


def archive_round_trip(pages: DataFrame, path: str, least: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each page, from the archives that were written."""
    write_archives(pages, path, least)
    got = read_archives(pages.sparkSession, path)
    revisit = F.col("type") == "revisit"
    return got.select(
        "page_id",
        F.when(revisit, F.col("full_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        "refers_to",
    )
