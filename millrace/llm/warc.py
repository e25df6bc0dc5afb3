"""WARC records and a Merkle fixity audit of replicas.

A file holds RECORDS consecutive ids, and each record's place in its file's tree is its id's (copies of an id share one), so a
record that one replica lacks moves no other. A leaf hashes the records of a place (SHA-256 of their bytes) and covers their
ordered offset range; FANOUT neighbouring nodes make a parent, whose hash is that of their places and hashes and whose range
is theirs, up to one root for each file. An audit compares roots, and below a mismatch only reads and compares the children of
mismatching nodes, down to the places; their records are then told apart by id and digest.

Only ids, lengths and digests are shuffled, never the records.

Defined results: null url or html are empty; a null id goes to a file and place of its content, so altered it is one record
missing and another extra; copies of an id follow each other in the order of their digests, and as many as both replicas
hold alike are undamaged; an empty table has no files and no damage; a record that one replica lacks is damage of kind
"missing" or "extra"; extra columns of the input are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from millrace.llm.common import checkpointed

FANOUT = 16
RECORDS = 512
#: Levels above the leaves: FANOUT ** LEVELS is at least RECORDS.
LEVELS = 3
#: Files that records without an id are dealt to.
UNPLACED = 1024


def record(page_id: Column, url: Column, html: Column) -> Column:
    """Bytes of a WARC/1.1 resource record."""
    body = F.encode(F.coalesce(html, F.lit("")), "UTF-8")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(F.encode(head, "UTF-8"), body, F.encode(F.lit("\r\n\r\n"), "UTF-8"))


def leaves(records: DataFrame, page_id: str = "page_id", content: str = "record") -> DataFrame:
    """(file, place, seq, page_id, start, length, hash) of records (page_id, bytes); seq is the order in the file."""
    out = records.select(F.col(page_id).alias("page_id"), F.octet_length(F.col(content)).cast("long").alias("length"), F.sha2(F.col(content), 256).alias("hash"))
    unplaced = F.xxhash64("hash")
    out = out.withColumns(
        {
            "file": F.coalesce(F.floor(F.col("page_id") / RECORDS).cast("long"), -1 - F.pmod(unplaced, F.lit(UNPLACED))),
            "place": F.coalesce(F.pmod(F.col("page_id"), F.lit(RECORDS)), F.pmod(F.floor(unplaced / UNPLACED), F.lit(RECORDS))).cast("long"),
        }
    )
    order = Window.partitionBy("file").orderBy("place", "page_id", "hash")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return out.select("file", "place", (F.row_number().over(order) - 1).cast("long").alias("seq"), "page_id", F.coalesce(F.sum("length").over(before), F.lit(0).cast("long")).alias("start"), "length", "hash")


def _joined(key: str) -> Column:
    """Hash of the nodes of a group, by place and hash."""
    ordered = F.sort_array(F.collect_list(F.struct(key, "hash")))
    return F.sha2(F.array_join(F.transform(ordered, lambda x: F.concat(x[key].cast("string"), F.lit(":"), x["hash"])), ","), 256).alias("hash")


def places(base: DataFrame) -> DataFrame:
    """The lowest level of the tree (file, node, start, length, hash): one node for each place that has a record."""
    return base.groupBy("file", F.col("place").alias("node")).agg(F.min("start").alias("start"), F.sum("length").alias("length"), _joined("page_id"))


def parents(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The level above (file, node, start, length, hash)."""
    # fanout rows of a group at most
    return nodes.groupBy("file", F.floor(F.col("node") / fanout).cast("long").alias("above")).agg(F.min("start").alias("start"), F.sum("length").alias("length"), _joined("node")).withColumnRenamed("above", "node")


def tree(base: DataFrame, levels: int, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels from the places to the roots."""
    out = [places(base)]
    for _ in range(levels):
        out.append(parents(out[-1], fanout))
    return out


def damage(left: DataFrame, right: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """Damaged records of two replicas' leaves: file, seq, page_id, start, length, hash, other_hash, root, other_root, kind;
    seq, start and length are those of the replica that has the record, the left one if both do."""
    left, right = checkpointed(left), checkpointed(right)
    one, two = tree(left, levels, fanout), tree(right, levels, fanout)
    roots = one[-1].select("file", "node", F.col("hash").alias("root")).join(two[-1].select("file", "node", F.col("hash").alias("other_root")), ["file", "node"], "full")
    roots = checkpointed(roots.filter(~F.col("root").eqNullSafe(F.col("other_root"))))
    found = roots.select("file", "node")
    for level in range(levels - 1, -1, -1):
        # children of mismatching nodes only, of either side, before the sides meet
        above = found.select("file", F.col("node").alias("above"))
        sides = []
        for nodes in (one[level], two[level]):
            below = nodes.select("file", "node", "hash", F.floor(F.col("node") / fanout).cast("long").alias("above"))
            sides.append(below.join(above, ["file", "above"], "left_semi").drop("above"))
        both = sides[0].join(sides[1].withColumnRenamed("hash", "other"), ["file", "node"], "full")
        found = checkpointed(both.filter(~F.col("hash").eqNullSafe(F.col("other"))).select("file", "node"))
    spots = found.select("file", F.col("node").alias("place"))
    return _told_apart(*(x.join(spots, ["file", "place"], "left_semi") for x in (left, right))).join(roots.drop("node"), "file")


def _told_apart(left: DataFrame, right: DataFrame) -> DataFrame:
    """Records of the same places that differ: those that both have are taken off, others are paired by id in the order of their digests."""
    copy = Window.partitionBy("file", "place", "page_id", "hash").orderBy("seq")
    rank = Window.partitionBy("file", "place", "page_id").orderBy("hash", "seq")
    keys = ["file", "place", "page_id", "hash"]
    left, right = (x.withColumn("copy", F.row_number().over(copy)) for x in (left, right))

    def without(x: DataFrame, y: DataFrame) -> DataFrame:
        other = y.select(*[F.col(k).alias(f"_{k}") for k in (*keys, "copy")])
        same = [x[k].eqNullSafe(other[f"_{k}"]) for k in (*keys, "copy")]
        rest = x.join(other, same, "left_anti")
        # records without an id are what they hold: two of different content are no pair
        return rest.withColumn("pair", F.when(F.col("page_id").isNotNull(), F.row_number().over(rank).cast("string")).otherwise(F.concat("hash", F.lit(" "), F.col("copy").cast("string"))))

    a = without(left, right).select("file", "place", "page_id", "pair", "seq", "start", "length", "hash")
    b = without(right, left).select(*[F.col(k).alias(f"_{k}") for k in ("file", "place", "page_id", "pair", "seq", "start", "length", "hash")])
    met = a.join(b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in ("file", "place", "page_id", "pair")], "full")
    kind = F.when(F.col("_pair").isNull(), "missing").when(F.col("pair").isNull(), "extra").otherwise("changed")
    either = [F.coalesce(k, f"_{k}").alias(k) for k in ("file", "seq", "page_id", "start", "length")]
    return met.select(*either, "hash", F.col("_hash").alias("other_hash"), kind.alias("kind"))


def packed(records: DataFrame, page_id: str = "page_id", content: str = "record") -> DataFrame:
    """(file, content): each file's records in order, as the bytes of one WARC file."""

    @arrow_udf("binary")
    def together(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arr in batches:
            yield pa.array([b"".join(x) for x in arr.to_pylist()], pa.binary())

    hashed = records.select(F.floor(F.col(page_id) / RECORDS).cast("long").alias("file"), F.struct(F.col(page_id), F.sha2(F.col(content), 256), F.col(content).alias("c")).alias("r"))
    return hashed.groupBy("file").agg(F.sort_array(F.collect_list("r")).alias("r")).select("file", together(F.transform("r", lambda x: x["c"])).alias("content"))


_LENGTH = re.compile(rb"(?im)^Content-Length:[ \t]*(\d+)")


def parsed(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(start, length, headers, body) of each record of a WARC file's bytes; stops at bytes that are no record."""
    at = 0
    while content.startswith(b"WARC/", at):
        end = content.find(b"\r\n\r\n", at)
        size = _LENGTH.search(content, at, end if end >= 0 else at)
        if end < 0 or not size:
            return
        body = end + 4
        stop = body + int(size[1])
        headers = dict(line.split(": ", 1) for line in content[at:end].decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
        after = stop + 4 if content.startswith(b"\r\n\r\n", stop) else stop
        yield at, after - at, headers, content[body:stop]
        at = after


def read_files(files: DataFrame, content: str = "content", name: str = "path") -> DataFrame:
    """Records of WARC files given as rows (path, content), as spark.read.format("binaryFile") makes them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = list(parsed(data or b""))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(found), pa.string()), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2].get("WARC-Target-URI") for x in found], pa.string()), pa.array([x[3] for x in found], pa.binary())],
                    ["path", "start", "length", "url", "body"],
                )

    return files.select(F.col(name).cast("string").alias("path"), F.col(content).alias("content")).mapInArrow(rows, "path string, start long, length long, url string, body binary")
