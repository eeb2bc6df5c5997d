"""License scans by diagonal voting.

Rolling hashes of all k-word runs of the documents are joined in Spark to the
places where the same run stands in license templates. A match of document
place p and template place q votes for diagonal p - q; votes are counted by
diagonal, neighbouring diagonals (words added or left out) are merged, and a
merged span is verified: its matched runs are compared as text, and they must
cover ``COVER`` of the template's words.

The reader of the texts leaves out hashes that no template has (a semi-join with
a fixed table of template hashes, so nothing is lost); templates are a fixed
list, and so is what is broadcast.

Defined results: a null text is empty; texts without words or matches have
counts of zero, null places, empty labels and score zero; repeated rows are
scanned each; null ids stay; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textops as tx
from .common import cut, table

K = 3
SLACK = 3
COVER = 0.75

#: Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Labels, and notices as lower-cased words. Several notices may have one label.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
]


def _as_texts(texts: list[str]) -> tx.Texts:
    return next(tx.chunks(pa.array(texts, pa.string()), 1 << 30))[2]


def _gram_hashes(text: str, k: int) -> np.ndarray:
    t = _as_texts([text])
    w = tx.words(t, tx.ALNUM)
    return tx.grams(tx.hashes(t.data, w.start, w.end), w.first, k)[0]


def template_rows(templates: list[tuple[str, str]], k: int) -> list[tuple]:
    """(gram, text, template, place, label, words) for every k-word run of every template."""
    rows = []
    for n, (label, text) in enumerate(templates):
        ws = text.split()
        for q, h in enumerate(_gram_hashes(text, k).view(np.int64).tolist()):
            rows.append((h, " ".join(ws[q : q + k]), n, q, label, len(ws)))
    return rows


READ = "row long, doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, hits array<struct<place:int,gram:long,text:string>>"


def read(docs: DataFrame, templates: list[tuple[str, str]], phrases: Mapping[str, str], k: int = K) -> DataFrame:
    """One row per document: word count, places of phrases, and its runs that templates have."""
    known = np.unique(np.array([r[0] for r in template_rows(templates, k)], np.int64)).view(np.uint64)
    known.sort()
    wanted = [(p, len(p.split()), _gram_hashes(p, len(p.split()))[0], label) for p, label in phrases.items()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64())
            for i, j, t in tx.chunks(batch.column("text")):
                n, low = j - i, tx.LOWER[t.data]
                w = tx.words(t, tx.ALNUM)
                h, owner = tx.hashes(low, w.start, w.end), w.text()

                def said(at: int, size: int) -> str:
                    return " ".join(low[w.start[x] : w.end[x]].tobytes().decode() for x in range(at, at + size))

                by_k = {size: tx.grams(h, w.first, size) for size in {k, *(x[1] for x in wanted)}}
                count, least, most = np.zeros(n, np.int64), np.full(n, 1 << 60), np.full(n, -1)
                labels = [set() for _ in range(n)]
                for phrase, size, value, label in wanted:
                    g, place = by_k[size]
                    for at in place[g == value].tolist():
                        if said(at, size) == phrase:
                            d = owner[at]
                            p = at - w.first[d]
                            count[d] += 1
                            least[d], most[d] = min(least[d], p), max(most[d], p)
                            labels[d].add(label)
                g, place = by_k[k]
                if len(known):
                    found = known[np.minimum(np.searchsorted(known, g), len(known) - 1)] == g
                    g, place = g[found], place[found]
                else:
                    g, place = g[:0], place[:0]
                d = owner[place]
                hits = pa.StructArray.from_arrays(
                    [
                        pa.array((place - w.first[d]).astype(np.int32)),
                        pa.array(g.view(np.int64)),
                        pa.array([said(at, k) for at in place.tolist()], pa.string()),
                    ],
                    ["place", "gram", "text"],
                )
                ends = np.concatenate([[0], np.cumsum(np.bincount(d, minlength=n))]).astype(np.int32)
                none = count == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + n)),
                        ids.slice(i, n),
                        pa.array(np.diff(w.first)),
                        pa.array(count),
                        pa.array(least, mask=none),
                        pa.array(most, mask=none),
                        pa.array([sorted(x) for x in labels], pa.list_(pa.string())),
                        pa.ListArray.from_arrays(pa.array(ends), hits),
                    ],
                    names=["row", "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "hits"],
                )
                row += n

    return docs.select("doc_id", "text").mapInArrow(scan, READ)


def spans(found: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, k: int = K, slack: int = SLACK, cover: float = COVER) -> DataFrame:
    """Verified spans of ``read``'s rows: row, template, label, first, last (words of the document) and cover."""
    at = found.sparkSession.createDataFrame(template_rows(templates, k), "gram long, said string, template int, q int, label string, words int")
    hits = found.where(F.size("hits") > 0).select("row", F.explode("hits").alias("hit")).select("row", "hit.*")
    votes = hits.join(F.broadcast(at), "gram").where(F.col("text") == F.col("said"))
    diagonals = votes.groupBy("row", "template", (F.col("place") - F.col("q")).alias("diagonal")).agg(
        F.min("place").alias("first"),
        (F.max("place") + k - 1).alias("last"),
        F.collect_set("q").alias("q"),  # a template's places: bounded
        F.first("label").alias("label"),
        F.first("words").alias("words"),
    )
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    opens = F.when(F.col("diagonal") - F.lag("diagonal").over(along) <= slack, 0).otherwise(1)
    merged = diagonals.withColumn("opens", opens).withColumn("run", F.sum("opens").over(along))
    merged = merged.groupBy("row", "template", "run").agg(
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        F.array_distinct(F.flatten(F.collect_set("q"))).alias("q"),
        F.first("label").alias("label"),
        F.first("words").alias("words"),
    )
    words = F.size(F.array_distinct(F.flatten(F.transform("q", lambda q: F.sequence(q, q + k - 1)))))
    merged = merged.withColumn("cover", words / F.col("words"))
    return merged.where(F.col("cover") >= cover).select("row", "template", "label", "first", "last", "cover")


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: Mapping[str, str] = PHRASES) -> DataFrame:
    """Every document with its base counts and labels, its verified spans, all labels and a score.

    The score is the best span's share of its template, or half if there are phrases only.
    """
    found = cut(read(docs, templates, phrases))
    by_row = (
        spans(found, templates)
        .groupBy("row")
        .agg(
            F.collect_set("label").alias("more"),
            F.max("cover").alias("cover"),
            F.array_sort(F.collect_list(F.struct("first", "last", "label", "cover"))).alias("spans"),
        )
    )
    labels = F.array_sort(F.array_distinct(F.concat("base_labels", F.coalesce("more", F.array().cast("array<string>")))))
    empty = F.array().cast("array<struct<first:int,last:int,label:string,cover:double>>")
    return found.join(by_row, "row", "left").select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.greatest(F.coalesce("cover", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0)).alias("score"),
        F.coalesce("spans", empty).alias("spans"),
    )


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan = license_scan(table(spark, sf_dir, "documents"))
    return scan.withColumn("n_spans", F.size("spans").cast("long")).drop("spans")
