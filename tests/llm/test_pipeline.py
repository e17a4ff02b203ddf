import math
from collections import Counter, defaultdict

import corpus_pipeline
import xxhash
from corvane.llm import decontaminate, pii, quality, simhash
from pyspark.sql import functions as F

DIR = "/root/testdata/sf0.001"


def test_stages_on_test_table(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, kept = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in kept.select("doc_id").collect()}
        kept = spark.createDataFrame(stage(spark, kept, DIR).collect(), docs.schema)
        after = [r.doc_id for r in kept.select("doc_id").collect()]
        assert kept.columns == columns and len(after) == len(set(after)) and set(after) <= before, name
    led = {r.doc_id for r in quality.score_documents(docs).filter("kept").select("doc_id").collect()}
    assert {r.doc_id for r in kept.collect()} <= led
    assert simhash.cluster(kept).filter("component_id <> doc_id").count() <= 2  # redaction may bring texts together
    assert pii.scan(kept).filter("n_email + n_ip + n_card + n_phone > 0").count() == 0
    assert decontaminate.mark(kept, spark.read.parquet(f"{DIR}/benchmark.parquet")).filter("contaminated").count() == 0
    packed = corpus_pipeline.pack_sequences(spark, kept, DIR)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in kept.collect()}
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0


def test_empty_and_null_documents(spark):
    schema = spark.read.parquet(f"{DIR}/documents.parquet").schema
    for rows in ([], [(1, None, None, None, None), (1, None, None, None, None), (None, "", "en", "s", 0)]):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, DIR).count() >= 0


def test_columns_of_any_name(spark):
    """Every stage keeps columns named like any of its own, and names with a dot."""
    plain = spark.read.parquet(f"{DIR}/documents.parquet")
    names = ["n_words", "failed_bits", "_k0", "_w", "_lines", "n", "_id", "_n", "_leads", "_own", "_row", "_digest", "_text", "fp", "root", "component_id",
             "n_hit", "items", "contaminated", "spans", "redacted", "base_spans", "n_added", "start", "length", "ids", "a.b", "word", "_at", "kept"]
    docs = plain.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got, want = stage(spark, docs, DIR), stage(spark, plain, DIR)
        assert got.columns == docs.columns, name
        rows = got.collect()
        assert sorted((r.doc_id, r.text) for r in rows) == sorted((r.doc_id, r.text) for r in want.collect()), name
        assert all(tuple(r)[len(plain.columns) :] == tuple(range(len(names))) for r in rows), name
    assert corpus_pipeline.pack_sequences(spark, docs, DIR).count() > 0


def test_repeated_rows(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        one, two = (sorted(r.doc_id for r in stage(spark, d, DIR).collect()) for d in (docs, docs.unionAll(docs)))
        assert two == (one if name == "near_duplicates" else sorted(one * 2)), name


def near_pairs(texts, least=0.8, k=5):
    """Pairs of texts whose sets of k-word shingles have a similarity of ``least`` or more, exactly: the rarest shingles of a text decide whom it meets."""
    split = [quality_words(t) for t in texts]
    sets = [frozenset(xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode()) for i in range(max(1, len(w) - k + 1))) for w in split]
    often, met, out = Counter(h for s in sets for h in s), defaultdict(list), set()
    for i, s in enumerate(sets):
        others = set()
        for h in sorted(s, key=lambda h: (often[h], h))[: len(s) - math.ceil(least * len(s)) + 1]:
            others.update(met[h])
            met[h].append(i)
        out |= {(j, i) for j in others if len(s & sets[j]) >= least * len(s | sets[j])}
    return out


def quality_words(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).split()


def test_near_copies_that_the_stage_keeps(spark):
    """What the links of two bits leave: no exact copy; and of 5 pairs of similarity 0.8 at sf0.01 all 5."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = sorted({r.text for r in docs.select("text").collect() if r.text and r.text.strip()})
    pairs = near_pairs(texts)
    kept = Counter(r.text for r in corpus_pipeline.near_duplicates(spark, docs, DIR).collect())
    assert max(n for t, n in kept.items() if t) == 1
    both = sum(texts[i] in kept and texts[j] in kept for i, j in pairs)
    assert len(pairs) == 5 and both <= 5
