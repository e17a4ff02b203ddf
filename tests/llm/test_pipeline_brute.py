"""The pipeline's rows against plain Python over a whole small table."""

import re
import zlib

import corpus_pipeline
import numpy as np
from corvane.llm import pii, quality, tokens
from pyspark.sql import functions as F

from test_operators import brute_fingerprint, words

DIR = "/root/testdata/sf0.001"


def passes(text):
    w, text = words(text), text or ""
    lines = [x for x in text.split("\n") if words(x)]
    seen = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    repeated = {i + j for at in seen.values() if len(at) > 1 for i in at for j in range(3)}
    m = {
        "n_words": len(w), "n_repeat_words": len(repeated), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)), "word_chars": sum(map(len, w)), "n_capitals": len(re.findall("[A-Z]", text)), "n_bangs": text.count("!"),
    }
    return not any(eval(rule, {}, m) for _, rule in quality.RULES)  # noqa: S307


def firsts(docs):
    fp = {d: brute_fingerprint(t) for d, t in docs.items()}
    group = {d: d for d in docs}
    changed = True
    while changed:
        changed = False
        for a in docs:
            for b in docs:
                if (fp[a] ^ fp[b]).bit_count() <= 2 and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    return {d: t for d, t in docs.items() if group[d] == d}


def clean(docs, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {tuple(w[i : i + 13]) for t in items if (w := cut(t)) for i in range(max(1, len(w) - 12))}
    sizes = {len(x) for x in windows}
    out = {}
    for d, t in docs.items():
        w = cut(t)
        hit = {i + j for m in sizes for i in range(len(w) - m + 1) if tuple(w[i : i + m]) in windows for j in range(m)}
        if not hit or 20 * len(hit) < len(w):
            out[d] = t
    return out


def test_run_against_brute_force(spark):
    read = lambda name: spark.read.parquet(f"{DIR}/{name}.parquet")
    docs = {r.doc_id: r.text for r in read("documents").collect()}
    kept = clean(firsts({d: t for d, t in docs.items() if passes(t)}), [r.text for r in read("benchmark").collect()])
    encoder, w = tokens.encoder(tokens.vocabulary_path()), pii.trained()
    want = {}
    for d, t in kept.items():
        ids = encoder.tokenizer.encode(pii.redact(t, pii.find_spans(t, w)[1]), add_special_tokens=False).ids
        want[d] = np.array([*ids, 1], "<u4")
    rows = corpus_pipeline.run(spark, DIR).withColumn("crc", F.crc32("ids")).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.crc == zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes())
        got.setdefault(r.doc_id, []).append(bytes(r.ids))
    assert {d: b"".join(p) for d, p in got.items()} == {d: x.tobytes() for d, x in want.items()}
