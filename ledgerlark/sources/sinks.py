"""Writers (OP-SNK-*): search results as JSON, JSON lines and CSV, artifacts as tables, vectors as a flat file."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The columns of the CSV layout, in order.
CSV_COLUMNS = ["bill", "congress", "provision_index", "provision_type", "account_name", "agency", "division", "section", "title", "dollars", "old_dollars", "semantics", "detail_level", "fiscal_year", "amount_status", "match_tier", "quality", "confidence", "raw_text"]


def search_rows(found: DataFrame) -> DataFrame:
    """OP-SNK-03: search results in the CSV layout: null is empty, a missing amount status ``n/a``, confidence to 2 places."""
    has = set(found.columns)
    col = lambda c: F.col("identifier") if c == "bill" and "bill" not in has else F.col(c) if c in has else F.lit(None)
    shown = {"amount_status": F.coalesce(col("amount_status").cast("string"), F.lit("n/a")), "confidence": F.format_string("%.2f", F.coalesce(col("confidence").cast("double"), F.lit(0.0)))}
    return found.select(*[shown.get(c, F.coalesce(col(c).cast("string"), F.lit(""))).alias(c) for c in CSV_COLUMNS])


def write_csv(found: DataFrame, path: str) -> None:
    search_rows(found).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_jsonl(found: DataFrame, path: str) -> None:
    """OP-SNK-02: an object per line."""
    found.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def json_array(found: DataFrame, path: str) -> None:
    """OP-SNK-01: one array in a local file, a row in memory at a time."""
    rows = found.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j"))
    with Path(path).open("w") as f:
        f.write("[")
        for k, r in enumerate(rows.toLocalIterator()):
            f.write(("," if k else "") + "\n  " + r.j)
        f.write("\n]\n")


def hashes(found: DataFrame) -> DataFrame:
    """OP-SNK-05."""
    return found.select("hash")


def write_table(rows: DataFrame, path: str, partition: str | None = None) -> None:
    """OP-SNK-06: an artifact as Parquet, split by ``partition`` where given."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def part_name(name: str, part: int) -> str:
    """What a further part of an artifact is called; the first has the plain name."""
    stem, _, suffix = name.partition(".")
    return name if part == 0 else f"{stem}.part-{part:06d}.{suffix}"


def _write_files(parted: DataFrame, root: str, name: str) -> None:
    """``write_artifact`` in a shared folder. Hadoop would run a chmod for each file and folder there, and each such process
    starts as one with all of the executor's memory. A file gets its name when it is whole; a repeated task writes it again."""
    import pyarrow as pa

    def put(batches):  # noqa: ANN001, ANN202
        import gzip
        import os
        import re

        n = 0
        for b in batches:
            for row in range(b.num_rows):
                bill, part, value = (b.column(c)[row].as_py() for c in range(3))
                # folders are called as by Spark
                folder = "__HIVE_DEFAULT_PARTITION__" if not bill else re.sub(r"""["#%'*/:=?\\\x7f{\[\]^\x00-\x1f]""", lambda m: f"%{ord(m[0]):02X}", bill)
                to = f"{root}/{folder}/{part_name(name, part)}"
                own = f"{root}/{folder}/_{uuid.uuid4().hex}"
                os.makedirs(f"{root}/{folder}", exist_ok=True)
                with (gzip.open(own, "wb", 6) if name.endswith(".gz") else open(own, "wb")) as f:  # noqa: PTH123
                    f.write((value or b"") + b"\n")
                os.replace(own, to)  # noqa: PTH105
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    parted.select("bill_dir", F.col("part").cast("int").alias("part"), F.col("value").cast("binary").alias("value")).mapInArrow(put, "n long").agg(F.sum("n")).collect()


def write_artifact(rows: DataFrame, root: str, name: str) -> None:
    """OP-SNK-06: from (bill_dir, value), a value per bill, the file ``name`` in each bill's folder below ``root``.

    A bill too large for one value comes as several, with their number ``part`` from 0; each becomes a file of its own,
    packed where ``name`` ends in .gz. Spark's committed writes put the values out; the driver only renames files, in any of
    Hadoop's file systems but ``file:``, where tasks write the files themselves.
    """
    spark, staged = rows.sparkSession, f"{root}/_{uuid.uuid4().hex}"
    parted = rows if "part" in rows.columns else rows.withColumn("part", F.lit(0))
    if root.startswith("file:"):
        _write_files(parted, "/" + root.removeprefix("file:").lstrip("/"), name)
        return
    parted.select("bill_dir", "part", "value").write.partitionBy("bill_dir", "part").option("compression", "gzip" if name.endswith(".gz") else "none").text(staged)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(staged).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for folder in files.globStatus(path(f"{staged}/bill_dir=*")):
        to = path(f"{root}/{folder.getPath().getName().removeprefix('bill_dir=')}")
        files.mkdirs(to)
        for found in files.globStatus(path(folder.getPath(), "part=*/part-*")):
            own = part_name(name, int(found.getPath().getParent().getName().removeprefix("part=")))
            files.delete(path(to, own), False)
            files.rename(found.getPath(), path(to, own))
    files.delete(path(staged), True)


def write_vector_files(vectors: DataFrame, root: str, model: str) -> int:
    """OP-SNK-06: from (bill_dir, provision_index, vec) each bill's ``vectors.bin`` of little-endian floats in provision order
    and its ``embeddings.json``, written by executors; how many bills. A repeated task writes the same files again."""
    import pyarrow as pa
    from pyarrow import fs

    def write(t: pa.Table) -> pa.Table:
        import hashlib
        import json

        import numpy as np

        t = t.sort_by("provision_index")
        bill = t.column("bill_dir")[0].as_py()
        data = np.array(t.column("vec").to_pylist(), dtype="<f4")
        files, at = fs.FileSystem.from_uri(root)
        files.create_dir(f"{at}/{bill}")
        head = {"schema_version": "1.0", "model": model, "dimensions": data.shape[1], "count": len(data), "vectors_file": "vectors.bin", "vectors_sha256": hashlib.sha256(data.tobytes()).hexdigest()}
        for name, content in (("vectors.bin", data.tobytes()), ("embeddings.json", json.dumps(head).encode())):
            with files.open_output_stream(f"{at}/{bill}/{name}") as f:
                f.write(content)
        return pa.table({"bill_dir": [bill]})

    return vectors.select(F.col("bill_dir").cast("string").alias("bill_dir"), "provision_index", "vec").groupBy("bill_dir").applyInArrow(write, "bill_dir string").count()


def write_vectors(vectors: DataFrame, path: str) -> int:
    """OP-SNK-06: one bill's vectors as little-endian floats in provision order; how many were written."""
    from array import array

    n = 0
    with Path(path).open("wb") as f:
        for r in vectors.orderBy("provision_index").toLocalIterator():
            f.write(array("f", r.vec).tobytes())
            n += 1
    return n


def shown(rows: DataFrame, top: int = 50) -> str:
    """OP-SNK-04: the first ``top`` rows as an aligned table, texts cut at 60 characters."""
    head = [c.upper() for c in rows.columns]
    body = [["" if v is None else f"{v:,}" if isinstance(v, int) else str(v) for v in r] for r in rows.limit(top).collect()]
    body = [[v if len(v) <= 60 else v[:59] + "…" for v in r] for r in body]
    widths = [max(len(x) for x in c) for c in zip(head, *body, strict=True)]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)).rstrip() for r in [head, *body])
