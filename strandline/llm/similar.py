"""Near-duplicates by five-word shingles: documents whose shingle sets have a Jaccard similarity of 0.8 or more.

Documents of equal shingle sets make one class. Candidates are classes whose distances to
the single-bit references of two of four blocks of the fingerprint are equal (the pivot
tables of ``simhash``: all pairs within two bits), and, as pairs of 0.8 differ by more, classes that share one
of ``BANDS`` keys, each of ``ROWS`` minima of the set under pseudo-random orders; two
sets of similarity s share one with probability 1 - (1 - s^ROWS)^BANDS (0.998 at 0.8,
0.9999997 at 0.9). Of those, pairs go whose sizes say that they can't reach 0.8; pairs
whose distances to the spread reference fingerprints (pivots, see ``simhash``) or whose
fingerprints differ by over ``FAR`` bits of 64, where 0.8 means some 10 bits and 24 is
five deviations more; and pairs that agree in fewer than ``AGREE`` of the 80 minima (a
byte of each is kept), where 0.8 means 64 and 52 is 3.4 deviations less (a chance of
0.0003). Survivors are verified on their whole shingle sets.

Pivot tables find every pair within two bits. Pairs of 0.8 differ by 17 bits and more, where pivots discard too little
to choose alone: so minima add candidates, and pivots and fingerprints discard among all.

Keys with the same first member (see below) are one. No group makes all its pairs. In each round the first members of every key (1, then 16
times as many) are compared with its members of other components and, being compared
with all, leave; components merge what was linked. First come members whose other keys
are large too, as these are the middles of their groups; once there are components,
those outside the key's largest, as every pair that matters has one of them. A key is
done when it has members of one component left. So a group of near copies mostly ends
after the first rounds, and no link between two components is lost. Members and leaders
meet in numpy, many to a group of bounded size; a pair of them is never a row.

Defined results: null and empty texts, and texts without words, have the empty set and
are alike; texts of fewer than five words are one shingle; of a component the row of
smallest doc_id stays (null last, then by a hash of the row), once if it is repeated;
other columns stay, whatever their names; no rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops as tx
from .common import components, cut, sweep
from .simhash import majority, pivot_cells, pivot_table

SHINGLE = 5
ALIKE = 0.8
BANDS, ROWS = 16, 5
FAR = 24
AGREE = 52
#: Shingles of members, about, and leaders that meet at once.
PART, LEAD = 1 << 20, 256
#: Members of a key that are compared with all others in the first round, and the factor from round to round.
LEADERS, MORE = 1, 16


def shingles(t: tx.Texts, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles (a shorter text: of all its words), text by text, and where each text's begin (n+1)."""
    w = tx.words(t, tx.SOLID)
    h = tx.hashes(tx.LOWER[t.data], w.start, w.end)
    n = np.diff(w.first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    first = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(int(first[-1]), np.uint64)
    for size in range(1, k + 1):
        texts = np.flatnonzero((n == size) if size < k else (n >= k))
        if not len(texts):
            continue
        g, place = tx.grams(h, w.first, size, salt=size)
        at = np.repeat(w.first[texts], count[texts]) + np.arange(int(count[texts].sum())) - np.repeat(np.cumsum(count[texts]) - count[texts], count[texts])
        to = np.repeat(first[texts], count[texts]) + at - np.repeat(w.first[texts], count[texts])
        out[to] = g[np.searchsorted(place, at)]
    return out, first


def _factors() -> np.ndarray:
    return tx.mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)


def band_keys(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts, BANDS) keys of texts that have shingles, and a byte of each minimum."""
    keys = np.zeros((len(first) - 1, BANDS), np.uint64)
    marks = np.zeros((len(first) - 1, BANDS * ROWS), np.uint8)
    for i, a in enumerate(_factors()):
        least = np.minimum.reduceat(h * a, first[:-1])
        keys[:, i // ROWS] = tx.mix(keys[:, i // ROWS] + least + np.uint64(i + 1))
        marks[:, i] = tx.mix(least) & np.uint64(255)
    return keys, marks


_SKETCH = T.StructType([T.StructField(c, T.LongType()) for c in ("fp", "whole", "n")] + [T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("marks", T.BinaryType())])


@F.arrow_udf(_SKETCH)
def sketch(text: pa.Array) -> pa.Array:
    """Fingerprint, a hash of the shingle set, its size, and its keys and marks (none if it is empty)."""
    fps, whole, sizes, bands, marks = [], [], [], [], []
    for i, j, t in tx.chunks(text):
        h, first = shingles(t)
        count = np.diff(first)
        fps.append(majority(h, count, first))
        owner = np.repeat(np.arange(j - i), count)
        order = np.lexsort((h, owner))
        o, s = owner[order], h[order]
        new = np.ones(len(o), bool)
        new[1:] = (o[1:] != o[:-1]) | (s[1:] != s[:-1])
        o, s = o[new], s[new]
        total = np.zeros(j - i, np.uint64)
        np.add.at(total, o, tx.mix(s))
        whole.append(total)
        n = np.bincount(o, minlength=j - i)
        sizes.append(n)
        some = np.flatnonzero(n)
        mine = [None] * (j - i)
        if len(some):
            keys, bytes_ = band_keys(s, np.append(np.cumsum(n[some]) - n[some], len(s)))
            bands.append(keys.reshape(-1).view(np.int64))
            for at, m in zip(some.tolist(), bytes_):
                mine[at] = m.tobytes()
        marks += mine
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    size = join(sizes, np.int64).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum((size > 0) * BANDS)]).astype(np.int32)
    arrays = [pa.array(join(x, np.uint64).view(np.int64)) for x in (fps, whole)] + [pa.array(size)]
    arrays += [pa.ListArray.from_arrays(pa.array(offsets), pa.array(join(bands, np.int64))), pa.array(marks, pa.binary())]
    return pa.StructArray.from_arrays(arrays, _SKETCH.names)


@F.arrow_udf(T.BinaryType())
def shingle_set(text: pa.Array) -> pa.Array:
    """A text's distinct shingles, ascending."""
    out = []
    for _, _, t in tx.chunks(text):
        h, first = shingles(t)
        out += [np.unique(h[a:b]).tobytes() for a, b in zip(first, first[1:])]
    return pa.array(out, pa.binary())


def row_key() -> tuple[Column, Column]:
    """128 bits of a row's id and text."""
    text = F.coalesce("text", F.lit(""))
    return F.xxhash64("doc_id", text).alias("__key"), F.xxhash64(F.lit(1), text, F.isnull("doc_id"), "doc_id").alias("__key2")


def classes(docs: DataFrame) -> DataFrame:
    """A row for each shingle set: cls (a number), fp, n, bands, marks, and best: the first of its rows by (no id, id, keys)."""
    rows = docs.select("doc_id", *row_key(), sketch("text").alias("s")).select("doc_id", "__key", "__key2", "s.*")
    best = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "__key", "__key2")).alias("best")
    c = rows.groupBy("whole", "fp", "n").agg(best, F.first("bands").alias("bands"), F.first("marks").alias("marks"))
    return cut(c.select(F.monotonically_increasing_id().alias("cls"), "fp", "n", "bands", "marks", "best"))


_TOLD = ["cls", "root", "n", "fp", "p0", "p1", "marks", "set"]


class _Side:
    """Members or leaders of some keys' parts, by unit."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows.sort_values(["unit", "cls"], kind="stable")
        self.unit, self.root, self.n, self.fp = (rows[c].to_numpy(np.int64) for c in ("unit", "root", "n", "fp"))
        self.marks = np.frombuffer(b"".join(rows["marks"]), np.uint8).reshape(len(rows), -1)
        self.pivots = np.column_stack([rows["p0"].to_numpy(np.int64), rows["p1"].to_numpy(np.int64)]).view(np.uint8).astype(np.int16)
        self.sets = [np.frombuffer(b, np.uint64) for b in rows["set"]]


def _linked(rows: pd.DataFrame, leads: pd.DataFrame) -> pd.DataFrame:
    """Components (a, b) with a leader in one that is alike to a member of the other; one link is enough for two components."""
    out: list[tuple[int, int]] = []
    if len(rows) and len(leads):
        m, l = _Side(rows), _Side(leads)  # noqa: E741
        begin, end = np.searchsorted(m.unit, l.unit, "left"), np.searchsorted(m.unit, l.unit, "right")
        for i in range(len(l.unit)):
            at = np.arange(begin[i], end[i])
            at = at[m.root[at] != l.root[i]]
            n = m.n[at]
            at = at[np.minimum(n, l.n[i]) >= ALIKE * np.maximum(n, l.n[i])]
            at = at[np.abs(m.pivots[at] - l.pivots[i]).max(1, initial=0) <= FAR]
            at = at[np.bitwise_count((m.fp[at] ^ l.fp[i]).view(np.uint64)) <= FAR]
            agree = (m.marks[at] == l.marks[i]).sum(1)
            done: set[int] = set()
            for j in at[np.argsort(-agree, kind="stable")][: int((agree >= AGREE).sum())].tolist():
                if (root := int(m.root[j])) in done:
                    continue
                a, b = m.sets[j], l.sets[i]
                same = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
                # same / (a + b - same) >= 4 / 5 in whole numbers
                if 9 * same >= 4 * (len(a) + len(b)):
                    done.add(root)
                    out.append((min(root, int(l.root[i])), max(root, int(l.root[i]))))
    return pd.DataFrame(sorted(set(out)), columns=["a", "b"], dtype=np.int64)


def _leaders(cells: DataFrame, leaders: int) -> DataFrame:
    """The next members of each cell that are compared with all others, numbered from 0."""
    # the largest component of each cell, once there is one of two members
    sizes = cells.groupBy("cell", "root").agg(F.count("*").alias("size"))
    main = sizes.groupBy("cell").agg(F.max(F.struct("size", "root")).alias("top"))
    main = main.select("cell", F.when(F.col("top.size") > 1, F.col("top.root")).alias("main"))
    order = Window.partitionBy("cell").orderBy(F.desc("middle"), "cls")
    lead = cells.join(main, "cell").where(~F.col("root").eqNullSafe(F.col("main")))
    # a plain limit on the number is taken before rows are exchanged, too
    lead = lead.withColumn("at", F.row_number().over(order)).where(F.col("at") <= leaders)
    return cut(lead.select("cell", "cls", "root", (F.col("at") - 1).alias("at")))


def _hubs(cells: DataFrame) -> DataFrame:
    """Cells of the same first member as one cell, named by it: a group of near copies shares many keys, and its members are sent once for all of them.

    That member is in all of the ``BANDS`` keys and six pivot cells at most, so a cell grows no further, and what was compared in one of them still is.
    """
    first = cells.groupBy("cell").agg(F.min(F.struct((-F.col("middle")).alias("m"), "cls")).alias("first"))
    return cells.join(first, "cell").select(F.col("first.cls").alias("cell"), "cls", "middle", "root").distinct()


def _links(cells: DataFrame, lead: DataFrame, told: DataFrame) -> DataFrame:
    """(a, b) of components that leaders link. Members of a cell meet blocks of its leaders in parts of some ``PART`` shingles."""
    parts = cells.join(told.select("cls", "n"), "cls").groupBy("cell").agg(F.ceil(F.sum("n") / PART).cast("int").alias("parts"))
    load = parts.join(lead.groupBy("cell").agg((F.floor(F.max("at") / LEAD) + 1).cast("int").alias("blocks")), "cell")
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    unit = F.xxhash64("cell", "part", "block")
    left = cells.join(load, "cell").withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")).withColumn("block", upto("blocks"))
    right = lead.join(load, "cell").withColumn("block", F.floor(F.col("at") / LEAD).cast("int")).withColumn("part", upto("parts"))
    # one row
    work = left.join(told.select("cls", "n"), "cls").agg(F.sum("n")).first()[0] or 0
    group = F.pmod("unit", F.lit(max(1, work // PART)))
    left, right = (d.select(unit.alias("unit"), "cls", "root").join(told, "cls").select(group.alias("group"), "unit", *(F.col(c).alias(c) for c in _TOLD)) for d in (left, right))
    return left.groupBy("group").cogroup(right.groupBy("group")).applyInPandas(_linked, "a long, b long")


def roots(c: DataFrame, docs: DataFrame) -> DataFrame:
    """cls and root (the smallest cls of its component) of classes that are alike to others."""
    empty = c.select("cls", F.col("cls").alias("root")).limit(0)
    keyed = c.where(F.size("bands") > 0).select("cls", F.explode(F.concat("bands", F.transform(pivot_cells("fp"), lambda x: F.xxhash64(x)))).alias("cell"))
    shared = keyed.groupBy("cell").agg(F.count("*").alias("size")).where("size > 1")
    keyed = cut(keyed.join(shared, "cell"))
    middle = cut(keyed.groupBy("cls").agg(F.sum("size").alias("middle")))
    if middle.isEmpty():
        return empty
    cells = cut(_hubs(keyed.drop("size").join(middle, "cls").withColumn("root", F.col("cls"))))
    # what is known of those that have a candidate; their shingle sets are read from one of their rows
    mine = c.join(middle.select("cls"), "cls", "left_semi").select("cls", "n", "fp", "marks", "best.__key", "best.__key2")
    mine = pivot_table(mine, more=("cls", "n", "marks", "__key", "__key2"))
    rows = docs.select(*row_key(), "text").join(mine, ["__key", "__key2"]).dropDuplicates(["__key", "__key2"])
    told = cut(rows.select("cls", "n", "fp", "p0", "p1", "marks", shingle_set("text").alias("set")))
    found, leaders = empty, LEADERS
    while not cells.isEmpty():
        lead = _leaders(cells, leaders)
        new = cut(_links(cells, lead, told).distinct())
        cells = cells.join(lead.select("cell", "cls"), ["cell", "cls"], "left_anti")
        if not new.isEmpty():
            merged = components(new).select(F.col("u").alias("root"), F.col("v").alias("to"))
            moved = found.join(merged, "root", "left").select("cls", F.coalesce("to", "root").alias("root"))
            fresh = merged.join(found.select(F.col("cls").alias("root")), "root", "left_anti").select(F.col("root").alias("cls"), F.col("to").alias("root"))
            found = cut(moved.unionByName(fresh))
            cells = cells.drop("root").join(found, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
        # done: keys with members of one component
        open_ = cells.groupBy("cell").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("cell")
        cells = cut(cells.join(open_, "cell"))
        leaders *= MORE
        del lead, new, open_
        sweep(docs.sparkSession)
    return found


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents without all but one of each component."""
    c = classes(docs)
    r = c.join(roots(c, docs), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    kept = r.groupBy("root").agg(F.min("best").alias("best")).select("best.__key", "best.__key2")
    # one exchange by the keys serves both the join and the removal of repeated rows
    return docs.select("*", *row_key()).join(kept, ["__key", "__key2"], "left_semi").dropDuplicates(["__key", "__key2"]).select(*(f"`{x}`" for x in docs.columns))
