import re

from strandline.llm import licenses


def base(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    starts, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        q = phrase.split()
        for i in range(len(w) - len(q) + 1):
            if w[i : i + len(q)] == q:
                starts.append(i)
                labels.add(label)
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_base_counts(spark, sf, edge):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(edge.select("doc_id", "text"))
    want = sorted((repr(r[0]), *map(repr, base(r[1]))) for r in docs.collect())
    got = licenses.license_scan(docs).collect()
    assert sorted((repr(r["doc_id"]), *(repr(r[c]) for c in ("n_words", "n_base", "first_word", "last_word", "base_labels"))) for r in got) == want
    assert all(0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in got)


def scan(spark, text):
    r = licenses.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    return r["labels"], r["score"], [tuple(s) for s in r["spans"]]


def test_spans(spark):
    mit = dict(licenses.TEMPLATES[::-1])["mit"]
    labels, score, spans = scan(spark, "x y " + mit.upper())  # another notice of the label shares four of its words
    assert (labels, score, spans[0]) == ("mit", 1.0, (2, 6, "mit", 1.0))
    long = next(t for k, t in licenses.TEMPLATES if len(t.split()) > 25)
    words = long.split()
    changed = " ".join(words[:10] + ["really"] + words[10:])  # one word more: a neighbouring diagonal
    labels, score, spans = scan(spark, "Foo.\n" + changed)
    assert labels and score == 1.0 and spans[0][:2] == (1, len(words) + 1)
    half = " ".join(words[: len(words) // 2])
    assert scan(spark, half)[0] == "" and scan(spark, "released under the sea")[0] == ""
    assert scan(spark, "Licensed under CC BY 4.0 and licensed under CC-BY 4.0.")[0] == "cc-by,cc-by-4.0"


def test_every_place_is_found(spark):
    labels, score, spans = scan(spark, ("Licensed under CC BY 4.0 " * 50))
    assert len(spans) == 50 and score == 1.0


def test_no_rows(none):
    assert licenses.license_scan(none).collect() == []
