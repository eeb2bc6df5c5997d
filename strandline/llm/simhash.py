"""SimHash near-duplicates through pivot distance tables.

Every distinct fingerprint gets a table of Hamming distances to reference
fingerprints. By the triangle inequality two fingerprints within ``D`` bits
differ by at most ``D`` in every coordinate, so pairs with a larger coordinate
difference are discarded and only survivors are verified.

Two families of references are used:

* *Block references* differ from zero in one bit of a 16-bit block. Less the
  distance to zero, their distances depend on that block alone, and as two bits
  touch two of the four blocks at most, two linked fingerprints agree in all
  those coordinates of some two blocks. The coordinates of a block are its bits
  (distance = |zero distance| + 1 - 2 bit), so they are kept packed, and
  agreement is an equi-join: no cross join, nothing missed.
* *Spread references* are pseudo-random; their distances are packed a byte each
  and give the maximum coordinate difference by which pairs are discarded.

A crowded cell (one that more than ``crowd`` fingerprints share) would make
quadratically many pairs. Its members are linked another exact way: within two
bits of each other are those that have a common fingerprint at one bit or less,
so each member is listed under its 65 such neighbours; a list has 65 members at
most, and every one is linked with the smallest.

Defined results: null and empty texts, and texts without words, have fingerprint
zero; repeated rows share a fingerprint; null ids take part but are never a
component's id unless it has no other (then null); other columns are ignored;
no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops as tx
from .common import components, cut, table

BITS = 2
SHINGLE = 3
SPREAD = 16
CROWD = 64


def majority(h: np.ndarray, n: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text the bits that over half of its ``n`` hashes ``h[first[i]:first[i + 1]]`` have; zero without any."""
    fp = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    for a in range(0, len(full), 256):  # bounds the unpacked bits
        part = full[a : a + 256]
        lo, hi = first[part[0]], first[part[-1] + 1]
        votes = np.zeros((len(part), 64), np.int64)
        for b in range(lo, hi, 1 << 17):
            e = min(hi, b + (1 << 17))
            bits = np.unpackbits(h[b:e].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            inside = part[(first[part] < e) & (first[part + 1] > b)]
            votes[np.searchsorted(part, inside)] += np.add.reduceat(bits, np.maximum(first[inside], b) - b, axis=0, dtype=np.int32)
        on = 2 * votes > n[part][:, None]
        fp[part] = np.packbits(on, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return fp


def fingerprints(texts: pa.Array, k: int = SHINGLE, seed: int = 42) -> np.ndarray:
    """Signed 64-bit SimHash of each text over its k-word shingles, repeats included."""
    digest, out = xxhash.xxh64_intdigest, []
    for _, _, t in tx.chunks(texts):
        w = tx.words(t, tx.SOLID)
        counts = np.diff(w.first)
        # words with one space after each
        size = w.end - w.start + 1
        at = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=at[1:])
        keep = tx.SOLID[t.data]
        keep_from = np.concatenate([keep, [False]])
        keep_from[w.end] = True
        padded = np.concatenate([tx.LOWER[t.data], [np.uint8(32)]])
        if len(w.start) and (w.end[:-1] == w.start[1:]).any():  # texts that touch: no byte between their words
            line = np.full(at[-1], 32, np.uint8)
            src = np.flatnonzero(keep)
            word = np.repeat(np.arange(len(size)), size - 1)
            line[src - w.start[word] + at[word]] = tx.LOWER[t.data[src]]
        else:
            line = np.where(keep_from, padded, 0)[keep_from]
            line[at[1:] - 1] = 32
        body = line.tobytes()
        n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
        total = int(n.sum())
        first = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=first[1:])
        owner = np.repeat(np.arange(len(n)), n)
        lead = np.arange(total) - first[owner] + w.first[owner]
        last = np.minimum(lead + k, w.first[owner + 1])
        h = np.fromiter((digest(body[s:e], seed) for s, e in zip(at[lead].tolist(), (at[last] - 1).tolist())), np.uint64, total)
        out.append(majority(h, n, first))
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)).view(np.int64)


@F.arrow_udf(T.LongType())
def fingerprint_of(text: pa.Array) -> pa.Array:
    return pa.array(fingerprints(text), pa.int64())


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash (of the text, to tell apart rows of one id), fp; fixed in the checkpoint folder."""
    return cut(docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), fingerprint_of("text").alias("fp")))


def references(n: int = SPREAD) -> list[int]:
    """Spread reference fingerprints: a rule, not data."""
    return [int(x) for x in tx.mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)]


def pivot_table(fps: DataFrame, n: int = SPREAD, more: Sequence[str] = ()) -> DataFrame:
    """fp with its distances to the spread references, eight to a long (p0, p1, ...), and columns of ``fps`` that are to stay."""
    refs = references(n)
    packed = []
    for a in range(0, n, 8):
        c = F.lit(0).cast("long")
        for j, r in enumerate(refs[a : a + 8]):
            c = c.bitwiseOR(F.shiftleft(F.bit_count(F.col("fp").bitwiseXOR(F.lit(r))).cast("long"), 8 * j))
        packed.append(c.alias(f"p{a // 8}"))
    return fps.select("fp", *more, *packed)


def _within(a: str, b: str, n: int, most: int) -> Column:
    """No coordinate of the pivot tables differs by more than ``most``."""
    diffs = []
    for j in range(n):
        x, y = (F.shiftrightunsigned(F.col(f"{s}.p{j // 8}"), 8 * (j % 8)).bitwiseAND(F.lit(255)) for s in (a, b))
        diffs.append(F.abs(x - y))
    return F.greatest(*diffs) <= most


def pivot_cells(fp: str) -> Column:
    """A cell for each two of four blocks: fingerprints within two bits agree in the distances to the single-bit references of two blocks, which are the blocks' bits."""
    block = [F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    return F.array(*(F.lit(n).cast("long") * (1 << 32) + block[i] * 65536 + block[j] for n, (i, j) in enumerate(pairs)))


def links(fps: DataFrame, crowd: int = CROWD, spread: int = SPREAD) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` whose components are those of all pairs within two bits."""
    t = pivot_table(fps, spread)
    t = cut(t.select("*", F.explode(pivot_cells("fp")).alias("cell")))
    size = t.groupBy("cell").agg(F.count("*").alias("size")).where("size > 1")
    shared = cut(t.join(size, "cell"))
    few = shared.where(F.col("size") <= crowd)
    near = (
        few.alias("x")
        .join(few.alias("y"), "cell")
        .where(F.col("x.fp") < F.col("y.fp"))
        .where(_within("x", "y", spread, BITS))
        .where(F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= BITS)
        .select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    )
    many = shared.where(F.col("size") > crowd).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.lit((1 << i) - (1 << 64) * (i == 63)).cast("long") for i in range(64)))
    around = many.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"))
    least = around.groupBy("mid").agg(F.min("fp").alias("b"), F.collect_list("fp").alias("all"))  # 65 at most
    star = least.where(F.size("all") > 1).select("b", F.explode("all").alias("a")).where("a != b").select("a", "b")
    return near.unionByName(star).distinct()


def classes(table_: DataFrame, crowd: int = CROWD, spread: int = SPREAD) -> DataFrame:
    """For each fp of (doc_id, fp) rows: component_id, the smallest doc_id that links reach."""
    lone = table_.groupBy("fp").agg(F.min("doc_id").alias("least"))
    lone = cut(lone)
    roots = components(links(lone.select("fp"), crowd, spread)).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    rooted = lone.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    joined = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return cut(rooted.select("fp", "root").join(joined, "root").select("fp", "component_id"))


def near_duplicates(docs: DataFrame, crowd: int = CROWD, spread: int = SPREAD) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of documents."""
    t = fingerprint_table(docs)
    return t.join(classes(t, crowd, spread), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
