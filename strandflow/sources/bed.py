"""Binary genotypes: two bits a call, four calls a byte, a block of bytes for each variant (or each sample).

The reader is a Spark data source: its partitions are ranges of blocks, each read by its offset, through a filesystem
that all executors reach.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed values of the format: magic bytes, order byte, and the dosage of allele 1 for each bit pair (low bit first).
MAGIC, SNP_MAJOR = b"\x6c\x1b", 1
DOSAGE = (2, None, 1, 0)
_CODE = np.array([2, -1, 1, 0], np.int8)


def unpack(block: bytes, n: int) -> np.ndarray:
    """n dosages of a block, -1 where missing."""
    bits = np.frombuffer(block, np.uint8)
    return _CODE[((bits[:, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3).reshape(-1)[:n]]


def pack(dosages: np.ndarray) -> bytes:
    """A block of dosages (-1: missing)."""
    pair = np.select([dosages == 2, dosages == 1, dosages == 0], [0, 2, 3], 1).astype(np.uint8)
    pair = np.concatenate((pair, np.zeros(-len(pair) % 4, np.uint8))).reshape(-1, 4)
    return (pair[:, 0] | pair[:, 1] << 2 | pair[:, 2] << 4 | pair[:, 3] << 6).astype(np.uint8).tobytes()


def _open(path: str):
    system, at = fs.FileSystem.from_uri(path if "://" in path else "file://" + path)
    return system, at


@dataclass
class _Blocks(InputPartition):
    first: int
    last: int


class BedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.inner, self.outer = options["path"], int(options["inner"]), int(options["outer"])
        self.parts = int(options.get("parts", "8"))

    def partitions(self) -> list[InputPartition]:
        step = max(1, -(-self.outer // self.parts))
        return [_Blocks(i, min(self.outer, i + step)) for i in range(0, self.outer, step)]

    def read(self, part: _Blocks) -> Iterator[pa.RecordBatch]:
        size = -(-self.inner // 4)
        system, at = _open(self.path)
        with system.open_input_file(at) as f:
            for i in range(part.first, part.last):
                f.seek(3 + i * size)
                block = f.read(size)
                if len(block) != size:
                    raise ValueError(f"block {i} of {self.path} is short")
                d = unpack(block, self.inner)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), i, np.int32)), pa.array(np.arange(len(d), dtype=np.int32)), pa.array(d.astype(np.int32), mask=d < 0)], ["outer", "inner", "dosage"])


class BedSource(DataSource):
    """Options: path, outer (blocks), inner (calls of a block), parts."""

    @classmethod
    def name(cls) -> str:
        return "bed"

    def schema(self) -> str:
        return "outer int, inner int, dosage int"

    def reader(self, schema) -> BedReader:
        return BedReader(self.options)


def read_bed(spark: SparkSession, prefix: str, parts: int = 8) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Samples (idx, ...), variants (idx, ...) and calls (sample_id, vid, dosage) of a BED with its BIM and FAM."""
    from strandflow.sources.text import bim, numbered

    spark.dataSource.register(BedSource)
    variants, samples = bim(spark, f"{prefix}.bim"), numbered(spark, f"{prefix}.fam").select("idx", *(F.element_at("f", i).alias(n) for i, n in enumerate(("fid", "iid", "pat", "mat", "sex", "pheno"), 1)))
    system, at = _open(f"{prefix}.bed")
    with system.open_input_file(at) as f:
        head = f.read(3)
    if head[:2] != MAGIC:
        raise ValueError(f"{prefix}.bed doesn't begin with the format's magic bytes")
    v, s = variants.count(), samples.count()
    snp_major = head[2] == SNP_MAJOR
    x = spark.read.format("bed").options(path=f"{prefix}.bed", outer=str(v if snp_major else s), inner=str(s if snp_major else v), parts=str(parts)).load()
    vid, sid = ("outer", "inner") if snp_major else ("inner", "outer")
    return samples, variants, x.select(F.col(sid).alias("sample_id"), F.col(vid).alias("vid"), "dosage")


def write_bed(g: DataFrame, samples: DataFrame, variants: DataFrame, prefix: str) -> None:
    """BED, BIM and FAM; blocks are packed in the tasks and come to the one file in order, one partition at a time."""
    n = samples.count()
    blocks = g.groupBy("vid").agg(F.collect_list(F.struct("sample_id", "dosage")).alias("calls"))

    def run(batches):
        for b in batches:
            out = []
            for calls in b.column("calls").to_pylist():
                d = np.full(n, -1, np.int8)
                for c in calls:
                    if c["dosage"] is not None:
                        d[c["sample_id"]] = c["dosage"]
                out.append(pack(d))
            yield pa.RecordBatch.from_arrays([b.column("vid"), pa.array(out, pa.binary())], ["vid", "block"])

    packed = variants.select(F.col("idx").alias("vid")).join(blocks.mapInArrow(run, "vid int, block binary"), "vid", "left").orderBy("vid")
    system, at = _open(f"{prefix}.bed")
    empty = pack(np.full(n, -1, np.int8))
    with system.open_output_stream(at) as f:
        f.write(MAGIC + bytes((SNP_MAJOR,)))
        for r in packed.toLocalIterator():
            f.write(bytes(r.block) if r.block is not None else empty)
    for table, ext, cols in ((variants, "bim", ("chr", "name", "cm", "bp", "a1", "a2")), (samples, "fam", ("fid", "iid", "pat", "mat", "sex", "pheno"))):
        system, at = _open(f"{prefix}.{ext}")
        with system.open_output_stream(at) as f:
            for r in table.orderBy("idx").select(*cols).toLocalIterator():
                f.write((" ".join(str(x) for x in r) + "\n").encode())
