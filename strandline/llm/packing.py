"""Best-fit packing by the sum-of-squares rule.

Documents are tokenized, end in id 0, and only those longer than a sequence are
cut. Consecutive pieces make groups of some ``GROUP``; each group is packed by
itself, so nothing is gathered beyond a group and what a group wastes (a few open
sequences) is small against its thousands of sequences.

Order is that of the documents: files by name and rows by place, or partitions
where rows come from no file. Groups are numbered in it, and a group's sequences by
their longest piece, so sequences from the first on have the sources of the rows
from the first on, to within a group.

Sum of squares (Csirik et al., 2006): with N(g) open sequences of residual gap g,
a piece goes where the sum of N(g)^2 over open gaps becomes smallest. Pieces come
from the longest to the shortest. A piece that fits no open sequence opens one;
in this order, opening one while another has room can only cost, so a new one is
opened only then (among gaps of equal squares the smallest, the best fit, wins).

Defined results: a null or empty text is one piece of one token (id 0); repeated
rows are packed each; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import cut, table

LENGTH = 2048
GROUP = 16_384
#: A group's rows are told apart in so many runs: a group begins with a run.
RUNS = 64
VOCABULARY = "word_bpe_49k.json"

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, file string, row long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def placed(docs: DataFrame) -> DataFrame:
    """doc_id, text, file, row; the last two are null where rows come from no file."""
    try:
        m = docs.metadataColumn("_metadata")
        return docs.select("doc_id", "text", m["file_path"].alias("file"), m["row_index"].alias("row"))
    except AnalysisException:
        return docs.select("doc_id", "text", F.lit(None).cast("string").alias("file"), F.lit(None).cast("long").alias("row"))


def pieces(docs: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per piece, with the file and the row of its document (without files, the partition and the row there)."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, seen = tokens.encoder(vocabulary), (0).to_bytes(4, "little"), 0
        place = f"{TaskContext.get().partitionId():010d}"
        for batch in batches:
            rows, crc, size = [], [], []
            for i, ids in enumerate(encoder.encode(tokens.text_bytes(batch.column("text")))):
                ids += end
                for a in range(0, len(ids), 4 * length):
                    part = ids[a : a + 4 * length]
                    rows.append((i, a // 4))
                    crc.append(zlib.crc32(part))
                    size.append(len(part) // 4)
            if not rows:
                continue
            at = np.array(rows, np.int64).reshape(-1, 2)
            of = pa.array(at[:, 0])
            file, row = pc.fill_null(batch.column("file"), place), pc.coalesce(batch.column("row"), pa.array(np.arange(seen, seen + batch.num_rows)))
            seen += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(of).cast(pa.int64()),
                    pa.array((at[:, 1] // length).astype(np.int32)),
                    pa.array(at[:, 1]),
                    pa.array(np.array(size, np.int64)),
                    pa.array(np.array(crc, np.int64)),
                    file.take(of),
                    row.take(of),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "file", "row"],
            )

    return placed(docs).mapInArrow(cut_up, PIECES)


def sum_of_squares(sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, int]:
    """(sequence, offset) of each piece, and the number of sequences."""
    open_ = np.zeros(length + 1, np.int64)  # sequences by gap
    stacks: list[list[int]] = [[] for _ in range(length + 1)]
    sequence, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    n = 0
    order = np.argsort(-sizes, kind="stable")
    for i, s in zip(order.tolist(), sizes[order].tolist()):
        # from gap g to g - s the squares change by 2 (N(g-s) - N(g) + 1), or by 1 - 2 N(s) where it is filled; both less 2
        gain = 2 * (open_[s:] - open_[: length + 1 - s])
        gain[0] += 1
        gain[open_[s:] == 0] = -(1 << 40)
        g = s + int(gain.argmax())
        if open_[g]:
            at = stacks[g].pop()
            open_[g] -= 1
        else:
            g, at = length, n
            n += 1
        sequence[i], offset[i] = at, length - g
        if g > s:
            open_[g - s] += 1
            stacks[g - s].append(at)
    return sequence, offset, n


def packed(docs: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY, group: int = GROUP) -> DataFrame:
    """Every piece with its sequence and the offset there; sequences are gapless from 0 and hold ``length`` tokens at most."""
    p = cut(pieces(docs, length, vocabulary)).withColumn("run", F.expr(f"row div {max(1, group // RUNS)}"))
    runs = p.groupBy("file", "run").agg(F.count("*").alias("n"))
    # one count per file
    files, before = [], 0
    for k, (file, n) in enumerate(sorted(runs.groupBy("file").agg(F.sum("n")).collect(), key=lambda r: (len(r[0]), r[0]))):
        files.append((file, k, before))
        before += n
    inside = Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(p.sparkSession.createDataFrame(files, "file string, file_no int, file_before long"), "file")
    runs = runs.select("file", "run", "file_no", F.expr(f"(file_before + before) div {group}").alias("group"))

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["file_no", "row", "start"], kind="stable", ignore_index=True)
        sequence, offset, n = sum_of_squares(rows["length"].to_numpy(), length)
        number = np.empty(n, np.int64)
        number[sequence[offset == 0]] = np.arange(n)  # the longest piece of a sequence is its first
        return rows.drop(columns=["file", "row", "run", "file_no", "group"]).assign(sequence_id=number[sequence] + (int(key[0]) << 32), offset=offset)

    return p.join(runs, ["file", "run"]).groupBy("group").applyInPandas(pack, PACKED)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
