"""Small fixtures against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import random
import re
import time
import uuid
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from corvane.llm import decontaminate, licenses, packing, pii, quality, rangecoder, secrets, sharding, simhash, substrings, tokenids, tokens

SPACE = re.compile(r"[\x20\x09-\x0D]+")
PASSAGE = " ".join(f"pass{i}" for i in range(60))


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)] + ["the", "Of", "ÄPFEL", "x y", "naïve", "end."]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    long = text(30_000)
    near = text(400)
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "one two"), (5, text(80)), (6, near), (7, near.replace("the", "The", 1)), (8, near + " tail"),
            (9, near), (10, f"{text(30)} {PASSAGE} {text(30)}"), (11, f"{PASSAGE}\n{text(100)}"), (12, PASSAGE), (13, long), (14, long[: len(long) // 2]),
            (15, "a\n\na\nb  \nb\n"), (16, "la la la la la la la la la"), (17, None), (17, None), (None, text(20)), (18, "\x0b\x0cA B\x1cC"), (19, "é" * 5000)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    """Two columns more, named like the operators' own."""
    df = spark.createDataFrame(corpus(), "doc_id bigint, text string")
    return df.withColumns({"fp": F.lit("x"), "n_words": F.lit(1), "tokens": F.lit(2), "path": F.lit("p"), "copy": F.lit(True)}).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


def test_empty_tables(empty, spark):
    bench = spark.createDataFrame([(1, PASSAGE)], "item_id bigint, text string")
    assert tokenids.read_ids(tokenids.write_ids(empty)).count() == 0
    assert quality.score_documents(empty).count() == 0
    assert packing.digest(packing.pack(empty)).count() == 0
    assert pii.scan(empty).count() == 0
    assert secrets.scan(empty).count() == 0
    assert substrings.strip_repeats(empty).count() == 0
    assert decontaminate.mark(empty, bench).count() == 0
    assert sharding.shard_documents(empty, sharding.topology(8)).count() == 0
    assert simhash.cluster(empty).count() == 0
    assert licenses.scan(empty.select(F.col("doc_id").alias("id"), "path", "text")).count() == 0


def test_token_ids_round_trip(docs):
    rows = tokenids.read_ids(tokenids.write_ids(docs, segment_ids=5000), with_ids=True).collect()
    encoder = tokens.encoder(tokens.vocabulary_path())
    want = sorted((-1 if d is None else d, [*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for d, t in corpus())
    got = sorted((-1 if r.doc_id is None else r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in rows)
    assert got == want
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at and r.ids_crc32 == zlib.crc32(bytes(r.ids))
        at += r.n_tokens


@pytest.mark.parametrize("n", [1, 2, 31, 32, 33, 2047, 2049, 30_000])
def test_range_coder_borders(n):
    """Even, constant, largest, repeating ids, and rare ones after a stretch that is predicted well."""
    rng = np.random.default_rng(n)
    even, cycle = rng.integers(0, 65535, n), np.arange(n) % 7 * 9000
    for ids in (even, np.zeros(n), np.full(n, 65534), cycle, np.concatenate([cycle, even])):
        ids = ids.astype(np.uint32)
        prior, ranks = rangecoder.Prior.fit(ids)
        assert (prior.ids[ranks] == ids).all()
        again = rangecoder.Prior.from_bytes(prior.to_bytes())
        assert (again.freq == prior.freq).all() and (again.freq.sum(axis=1) == rangecoder._SLOTS).all()
        assert (again.ids[rangecoder.decode(*rangecoder.encode(ranks, prior), len(ids), again)] == ids).all()


def test_range_coder_beats_zlib():
    """A whole table's ids, in one segment and in small ones, headers included."""
    table = pq.read_table("/root/testdata/sf0.01/documents.parquet").sort_by("doc_id")
    ids, _ = tokens.encoder(tokens.vocabulary_path()).encode(table.column("text").combine_chunks())
    for size, most in ((len(ids), 7.5), (len(ids) // 8, 8.5)):
        parts = [ids[k : k + size] for k in range(0, len(ids), size)]
        blobs = [rangecoder.pack_segment([1], np.array([len(p)]), p) for p in parts]
        assert all((rangecoder.unpack_segment(b)[2] == p).all() for b, p in zip(blobs, parts, strict=True))
        plain = sum(len(zlib.compress(p.astype("<u2").tobytes(), 6)) for p in parts)
        assert 8 * sum(map(len, blobs)) / len(ids) < min(most, 8 * plain / len(ids))


def test_range_coder_orders():
    """Ids that follow from the two before them cost next to nothing once seen; tags keep other contexts apart."""
    rng = np.random.default_rng(1)
    once = rng.permutation(40_000)[:256].astype(np.uint32)
    blob = rangecoder.pack_segment([1], np.array([8192]), np.tile(once, 32))
    assert 8 * len(blob) / 8192 < 4
    cells, tags = rangecoder._contexts(*np.meshgrid(np.arange(300), np.arange(0, 40_000, 37), indexing="ij"), np.int64(0))[1::2]
    assert len(np.unique(cells << 32 | tags)) > 0.6 * cells.size


@pytest.mark.parametrize("n", [0, 1, 2047, 2048, 2049, 10_000])
def test_range_coder(n):
    ids = np.random.default_rng(n).zipf(1.3, n).clip(0, 65534).astype(np.uint32)
    blob = rangecoder.pack_segment([7] * (n > 0), np.array([n] * (n > 0)), ids)
    assert (rangecoder.unpack_segment(blob)[2] == ids).all()
    if n > 100:
        broken = bytearray(blob)
        broken[-10] ^= 1
        with pytest.raises(ValueError):
            rangecoder.unpack_segment(bytes(broken))


def test_quality_measurements(docs):
    def brute(text):
        w, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        hit = {i + j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(3)} if len(w) < 2000 else None
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), None if hit is None else len(hit)

    got = {(r.doc_id): r for r in quality.score_documents(docs).collect()}
    for d, t in corpus():
        n, chars, symbols, dup, repeats = brute(t)
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (n, chars, symbols, dup), d
        assert repeats is None or r.n_repeat_words == repeats, d
        assert r.base_failed == (n < 50 or 100 * r.n_repeat_words > 50 * n)
        assert not (r.base_failed and r.kept)


def test_quality_ablation(docs):
    led = quality.ledger(docs).cache()
    policy = quality.POLICIES["default"]
    bits = [r.failed_bits & policy.mask for r in led.select("failed_bits").collect()]
    for r in quality.ablation(led, policy).collect():
        bit = quality.BIT[r.rule]
        assert (r.n_failed, r.n_only) == (sum(b & bit != 0 for b in bits), sum(b == bit for b in bits))


def test_packing(docs):
    """Every piece of every document, gapless sequences, and little padding."""
    rows = packing.digest(packing.pack(docs, length=256, open_windows=4)).collect()
    encoder = tokens.encoder(tokens.vocabulary_path())
    want = Counter()
    for d, t in corpus():
        ids = np.array([*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want[d, len(ids), ids.tobytes()] += 1
    parts = {}
    for r in sorted(rows, key=lambda r: r.start):
        parts.setdefault(r.doc_id, []).append(r)
    for (d, n, raw), times in want.items():
        own = [r for r in parts[d] if r.doc_tokens == n]
        ends = Counter()
        for r in own:
            assert r.ids_crc32 == zlib.crc32(raw[4 * r.start : 4 * (r.start + r.length)])
            ends[r.start] += 1
            ends[r.start + r.length] -= 1
        assert ends[0] == times and ends[n] == -times and not any(ends[k] for k in ends if 0 < k < n)
    assert len(rows) == sum(len([r for r in parts[d] if r.doc_tokens == n]) for d, n, _ in want)
    by_sequence = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == by_sequence.get(r.sequence_id, 0)
        by_sequence[r.sequence_id] = r.offset + r.length
    assert max(by_sequence.values()) <= 256
    assert len(by_sequence) <= -(-sum(by_sequence.values()) // 256) + 4 * 3  # at worst the open windows of each partition are not full


BASE_PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_pii(text):
    out = []
    for kind, p in BASE_PII.items():
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(len(x.lstrip("0")) < 4 and int("0" + x[-4:]) <= 255 for x in m[0].split(".")), "card": lambda: 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": lambda: 10 <= len(digits) <= 15}[kind]()  # noqa: B023
            if ok:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


PII_TEXTS = ["", "a@b@c.d e..f@g-h.i.j_k@l.m @x.y a@", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4 1..2.3.4", "+1 (017) 555-7713 +12 34 +1+234567890123 ++49 30 1234567",
             "1.2.3." + "0" * 5000 + "1 " + "0" * 5000 + "255.1.1.1 1.1.1." + "9" * 5000, "4" * 6000 + " +" + "1" * 6000 + "@" * 50,
             "4111 1111 1111 1111 4111111111111112 4111-1111-1111-1111-1", "x_y%z@a.b,c@d.e+f@g.h 1.1.1.1@x.y"]


@pytest.mark.parametrize("text", PII_TEXTS)
def test_pii_base(text):
    assert pii.base_spans(text) == brute_pii(text)


def test_pii_base_random():
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice("a1.@ +-_(9)2%é") for _ in range(rng.randint(1, 40)))
        assert pii.base_spans(text) == brute_pii(text), text


def digest_of(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in spans).encode()).hexdigest()


def test_base_rows_of_documents(spark):
    """The queries' base columns over a whole table and the odd texts, against the patterns tried one by one."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = [(10_000 + k, t) for k, t in enumerate([*PII_TEXTS, None, "Token = 'abc' token=abcdefgh password: x", "AKIA" + "A1" * 6, "0" * 40 + "g" + "b" * 32])]
    docs = docs.unionAll(spark.createDataFrame(odd, docs.schema))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for found, brute, kinds in ((pii.digest(pii.scan(docs)), brute_pii, pii.KINDS), (secrets.digest(secrets.scan(docs)), brute_secrets, ("assign", "access", "hex"))):
        rows = {r.doc_id: r for r in found.collect()}
        assert rows.keys() == texts.keys()
        for d, t in texts.items():
            spans, counts = brute(t), Counter()
            counts.update(k for _, _, k in spans)
            assert rows[d].base_sha256 == digest_of(spans) and all(f"{k}:{a}:{b}" in rows[d].spans.split(",") for a, b, k in spans), d
            assert len(rows[d].spans.split(",")) >= len(spans) and sum(counts.values()) == len(spans)
            assert [rows[d][f"n_{k}"] >= counts[k] for k in kinds] == [True] * len(kinds), d


def test_pii_field_and_redaction(docs):
    w = pii.trained()
    found = wrong = gold_n = 0
    for text, gold in pii.labelled(1234, 200):
        spans = set(pii.find_spans(text, w)[1])
        found, gold_n = found + len(spans & gold), gold_n + len(gold)
        wrong += len(spans - gold - set(pii.base_spans(text)))
    assert found >= 0.95 * gold_n and wrong <= 0.05 * gold_n
    rows = {r.doc_id: r for r in pii.scan(docs, keep=["doc_id"]).collect()}
    assert rows[0].redacted is None and rows[1].redacted == "" and rows[5].redacted == dict(corpus())[5]
    spans = [(0, 3, "email"), (2, 6, "ip")]
    assert pii.redact("abcdefgh", spans) == "[EMAIL]gh"


def test_pii_telephones_and_rows_of_numbers():
    """Of another generator (English words): telephones of five countries after a word that says so, and numbers that are none."""
    rng, w = random.Random(99), pii.trained()
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    phones = {
        "call ": lambda: f"{num(3)}-{num(3)}-{num(4)}", "phone ": lambda: f"({num(3)}) {num(3)}-{num(4)}", "dial ": lambda: f"020 {num(4)} {num(4)}",
        "tel ": lambda: "01 " + " ".join(num(2) for _ in range(4)), "tel: ": lambda: f"030 {num(7)}", "fax ": lambda: f"44 20 {num(4)} {num(4)}", "mobile ": lambda: f"+34 {num(3)} {num(3)} {num(3)}",
    }
    plain = [
        lambda: f"{num(3)} {num(3)} {num(4)} {num(3)}", lambda: " ".join(num(rng.choice([3, 4])) for _ in range(8)), lambda: f"20{num(2)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}", lambda: num(11),
        lambda: f"978-{num(1)}-{num(2)}-{num(6)}-{num(1)}", lambda: f"{num(3)},{num(3)}.{num(2)}", lambda: f"{num(2)}:{num(2)}:{num(2)}.{num(6)}", lambda: f"{rng.randint(30, 99)} {num(2)} {num(4)} {num(4)}",
    ]
    english = ["house", "river", "market", "letter", "school", "green", "window"]
    for cue, make in phones.items():
        said = [(f"The {rng.choice(english)} {cue}", make()) for _ in range(100)]
        found = sum((len(a), len(a) + len(x), "phone") in pii.find_spans(f"{a}{x} in the {rng.choice(english)}.", w)[1] for a, x in said)
        assert found >= 90, (cue, found)
    for make in plain:
        wrong = sum(bool(pii.find_spans(f"The {rng.choice(english)} had {make()} in the {rng.choice(english)}.", w)[1]) for _ in range(100))
        assert wrong <= 4, (make(), wrong)


def test_pii_spans_across_long_chains():
    w = pii.trained()
    line = "(123) 456-7890\n"
    spans = pii.find_spans(line * 300, w)[1]
    assert spans == [(k, k + 14, "phone") for k in range(0, 300 * len(line), len(line))]
    assert pii.redact(line * 300, spans) == "[PHONE]\n" * 300
    far = "x" * 100 + "[at]ab.org"
    assert pii.find_spans("mail " + far, w)[1] == [(5, 5 + len(far), "email")]
    rng = random.Random(5)
    for n in (3, 40, 300):
        text = "".join(rng.choice([t, t, "no number here " * rng.randint(1, 20), "q" * 200, "é²١ "]) for t, _ in pii.labelled(n, n))
        base = pii.base_spans(text)
        whole = [x for x in pii.Region(text, 0, len(text)).decode(w) if not any(a < x[1] and b > x[0] for a, b, _ in base)]
        assert pii.find_spans(text, w)[1] == sorted(base + whole, key=lambda x: (x[0], pii.KINDS.index(x[2])))


def brute_secrets(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        out += [(m.start(), m.end(), "assign")] * (len(m[2]) >= 8)
    out += [(m.start(), m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[0], secrets.KINDS.index(s[2])))


def test_secret_in_the_middle_of_a_long_run():
    """A key between words joined by '-': the run's ends alone do not show it."""
    net, words = secrets.trained(), "-".join(["tea", "rust", "lion", "cedar", "matter"] * 6)
    key = "q7RtZ2mXc9LdVb4KpW8sYh3NfJ6gUaT5eQxM1oCiBvEzSrDk"
    text, plain = f"see {words}-1-{key}-{words} there", f"see {words}-{words}-1 there"
    (_, spans, _), (_, none, _) = secrets.find_batch([text, plain], net)
    assert [(a, b) for a, b, _ in spans] == secrets.candidates(text)
    assert none == []


def test_secrets(docs):
    for text in ["", "Token = 'abc' token=abcdefgh password: x", "AKIA" + "A1" * 6, "AKIA" + "A" * 11, "0" * 31, "a" * 64 + "g" + "b" * 32, "api_key=\"" + "9f" * 20 + '"']:
        assert secrets.base_spans(text) == brute_secrets(text)
    net = secrets.trained()
    prob, held = net["held"]  # seen neither in training nor for calibration and threshold
    assert (prob[held > 0] >= net["threshold"]).mean() >= secrets.MIN_RECALL
    assert (prob[held == 0] >= net["threshold"]).mean() <= 0.02
    tenth = np.clip((prob * 10).astype(int), 0, 9)
    assert sum((tenth == k).mean() * abs(prob[tenth == k].mean() - held[tenth == k].mean()) for k in range(10) if (tenth == k).any()) < 0.02
    for text, kind in (("credential: q7RtZ2mXc9LdVb4KpW8sYh3NfJ6gUaT5", "assign"), ("see q7RtZ2mXc9LdVb4KpW8sYh3NfJ6gUaT5", "access"), ("at 0F1E2D3C4B5A69788796A5B4C3D2E1F0", "hex")):
        a = text.index(" ") + 1
        assert secrets._kind(text, a, len(text)) == kind
    text = "key was ghp_aB3dE5fG7hJ9kL1mN3pQ5rS7tU9vW1xY3zA5 there"
    assert secrets.find_batch([text, None], net)[0][1]
    many = " ".join(["ab" * 20, "Zk9" + "q7" * 9] * 2000)
    assert len(secrets.find_batch([many], net)[0][0]) == 2000
    rows = {r.doc_id: r for r in secrets.digest(secrets.scan(docs)).collect()}
    assert rows[0].spans == "" and rows[13].spans == ""


def test_secrets_by_kind():
    """Fresh findings of every kind: keys of 20 characters and more are found, nothing else is called secret."""
    keys, others = secrets.generators(random.Random(0))
    rates = secrets.rates(secrets.trained(), seed=99, n=400)
    assert set(rates) == set(keys) | set(others)
    assert {k: r for k, r in rates.items() if k in others and r > 0.02} == {}
    assert {k: r for k, r in rates.items() if k in keys and r < (0.9 if "16 to 19" in k else 0.93 if k == "prefix" else 0.95)} == {}


def test_secrets_of_another_generator():
    """English words, identifiers of the standard library, random keys by length: not made by what the network learnt from."""
    rng, net = random.Random(5), secrets.trained()
    words = "state money law water people company system program question government number point home room fact month right study book word business issue side kind head house service".split()
    w = lambda: rng.choice(words)
    alnum = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    plain = {
        "uuid": lambda: str(uuid.UUID(int=rng.getrandbits(128))), "constant": lambda: "_".join(w().upper() for _ in range(3)) + f"_{rng.randint(1, 999)}",
        "path": lambda: "/" + "/".join(w() + (str(rng.randint(1, 99)) if rng.random() < 0.5 else "") for _ in range(6)),
        "slug": lambda: f"2024/0{rng.randint(1, 9)}/{rng.randint(10, 28)}/" + "-".join(w() for _ in range(5)), "camel": lambda: "".join(w().title() for _ in range(4)) + "2",
    }
    keys = {n: (lambda n=n: "".join(rng.choice(alnum) for _ in range(n))) for n in (20, 24, 32, 48)}
    for kind, make in (plain | keys).items():
        runs = [r for r in (make() for _ in range(300)) if secrets.candidates(r)]
        found = secrets.find_batch([f"We have {w()} {w()} with {r} in the {w()} of {w()}." for r in runs], net)
        share = sum(len(spans) > len(base) for base, spans, _ in found) / len(runs)
        assert share <= 0.02 if kind in plain else share >= 0.95, (kind, share)


@pytest.mark.parametrize("share_docs", [substrings.SHARE_DOCS, 1])
def test_substrings(docs, share_docs):
    rows = corpus()
    key = lambda d: substrings.LAST if d is None else d
    low = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - 12):
            g = tuple(w[i : i + 13])
            low[g] = min(low.get(g, substrings.LAST), key(d))
    got = {}
    for r in substrings.strip_repeats(docs, share_docs=share_docs).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.n_removed, r.kept))
    for d, t in rows:
        w = words(t)
        gone = {i + j for i in range(len(w) - 12) if low[tuple(w[i : i + 13])] < key(d) for j in range(13)}
        assert (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)) in got[d], d


@pytest.mark.parametrize("share_docs, unit, stretch", [(1, 1024, 4096), (3, 1024, 4096), (512, 1024, 4096), (512, 1, 1), (2, 16, 3)])
def test_substrings_of_near_copies(spark, share_docs, unit, stretch):
    """Few words, passages in many documents, small changes, repeats inside a text: all anchors are common, most windows are not."""
    rng = random.Random(share_docs)
    passages = [[rng.choice("abcdefgh") for _ in range(rng.randint(10, 40))] for _ in range(6)]
    texts = []
    for _ in range(60):
        t = []
        for _ in range(rng.randint(1, 5)):
            p = list(rng.choice(passages))
            if rng.random() < 0.6:
                p[rng.randrange(len(p))] = rng.choice("xyz")
            t += p * rng.choice([1, 1, 2]) + [rng.choice("abcdefgh") for _ in range(rng.randint(0, 6))]
        texts.append(t)
    ids = [rng.randrange(50) for _ in texts]
    low = {}
    for d, w in zip(ids, texts, strict=True):
        for i in range(len(w) - 12):
            low[tuple(w[i : i + 13])] = min(low.get(tuple(w[i : i + 13]), 99), d)
    want = []
    for d, w in zip(ids, texts, strict=True):
        gone = {i + j for i in range(len(w) - 12) if low[tuple(w[i : i + 13])] < d for j in range(13)}
        want.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in zip(ids, texts, strict=True)], "doc_id bigint, text string").repartition(4)
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.strip_repeats(df, share_docs=share_docs, unit=unit, stretch=stretch).collect()]
    assert sorted(got) == sorted(want)


def test_shards_of_long_texts_are_bounded():
    """Texts of few words, each far longer than a stretch: shards, as the operator deals them, hold few words; no window is lost."""
    rng = random.Random(4)
    n, size, texts = 60_000, substrings.WINDOW, {1: "ha " * 60_000}
    texts |= {d: " ".join(rng.choice("ab") for _ in range(n)) for d in range(2, 8)}
    batch = pa.RecordBatch.from_arrays([pa.array(texts.keys(), pa.int64()), pa.array(texts.values())], names=["doc", "text"])
    units = Counter()
    for b in substrings._anchor_batches(iter([batch]), size, substrings.ANCHOR, substrings.UNIT):
        units.update(b.column(0).to_pylist())
    asked = [a | max(0, (c - 1) // 8).bit_length() << 48 for a, c in units.items()]  # eight units a shard
    whole = pa.RecordBatch.from_arrays([*batch.columns, pa.array([asked] * len(texts)), pa.array([False] * len(texts))], names=["doc", "text", "anchors", "repeated"])
    held, windows = Counter(), Counter()
    for b in substrings._stretch_batches(iter([whole]), size, substrings.ANCHOR, substrings.STRETCH):
        for key, doc, _, data in zip(*[c.to_pylist() for c in b.columns], strict=True):
            held[key] += len(data) // 6
            windows[doc] += len(data) // 6 - size + 1
            assert len(data) // 6 <= substrings.STRETCH + size - 1
    assert max(held.values()) <= 6 * 8 * substrings.UNIT and len(held) > len(units)
    assert windows[1] < 2 * substrings.STRETCH + size and all(windows[d] > 0.1 * n for d in range(2, 8))


def test_windows_that_recur_in_a_text(spark):
    line, runs = " ".join(f"w{i}" for i in range(14)), "ha " * 40
    texts = {1: line + " a", 2: f"{line} b {line} {line} c", 3: runs, 4: "x " + runs + "y " + runs + "z", 5: f"{line} {line}"}
    rows = {r.doc_id: r for r in substrings.strip_repeats(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"), share_docs=1).collect()}
    assert {d: r.kept for d, r in rows.items()} == {1: texts[1], 2: "b c", 3: runs.strip(), 4: "x y z", 5: ""}


def test_repeated_ids_with_other_texts(spark):
    rows = [(1, PASSAGE), (2, "x " + PASSAGE), (2, "y z " + PASSAGE + " q"), (2, PASSAGE)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r.kept for r in substrings.strip_repeats(df).collect() if r.doc_id == 2) == ["", "x", "y z q"]


def test_suffix_automata(docs, spark):
    rng = random.Random(9)
    for _ in range(50):
        ref = [[rng.choice("abc") for _ in range(rng.randint(1, 20))] for _ in range(3)]
        text = [rng.choice("abc") for _ in range(25)]
        automaton = substrings.SuffixAutomaton()
        for r in ref:
            automaton.add(r)
        inside = {tuple(r[i:j]) for r in ref for i in range(len(r)) for j in range(i + 1, len(r) + 1)}
        assert automaton.statistics(text) == [max((k for k in range(i + 2) if tuple(text[i + 1 - k : i + 1]) in inside), default=0) for i in range(len(text))]
    reference = spark.createDataFrame([(1, PASSAGE)], "id int, text string")
    rows = {r.doc_id: r for r in substrings.strip_reference(docs, reference).collect()}
    assert rows[12].n_removed == 60 and rows[10].n_removed == 60 and rows[5].n_removed == 0
    odd = spark.createDataFrame([(1, " ".join(f"a\u00a0b{i}\u2003c" for i in range(20)))], "doc_id int, text string")
    assert substrings.strip_reference(odd, odd).first().n_removed == 20  # only ASCII white space parts words, on both sides
    with pytest.raises(ValueError):
        substrings.strip_reference(docs, reference, shard_words=10, max_shards=2)
    with pytest.raises(ValueError):
        substrings.strip_reference(docs, spark.createDataFrame([("x" * 10_000,)], "text string"), shard_words=10, max_shards=2)


def test_decontamination(docs, spark):
    items = [(1, PASSAGE), (2, "ONE two"), (3, None), (4, "..."), (5, "pass3 pass4"), (1, PASSAGE)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {(k, tuple(w[i : i + 13])) for k, t in items if (w := cut(t)) for i in range(max(1, len(w) - 12))}
    for limit in (decontaminate.BROADCAST_WINDOWS, 0):
        decontaminate.BROADCAST_WINDOWS, old = limit, decontaminate.BROADCAST_WINDOWS
        try:
            got = {r.doc_id: r for r in decontaminate.mark(docs, bench).collect()}
        finally:
            decontaminate.BROADCAST_WINDOWS = old
        for d, t in corpus():
            w = cut(t)
            if len(w) > 5000:
                continue
            hits = [(k, i, len(x)) for k, x in windows for i in range(len(w) - len(x) + 1) if tuple(w[i : i + len(x)]) == x]
            n = len({i + j for _, i, m in hits for j in range(m)})
            assert (got[d].n_words, got[d].n_hit, got[d]["items"]) == (len(w), n, sorted({str(k) for k, _, _ in hits})), d
            assert got[d].contaminated == (n > 0 and 20 * n >= len(w))


def test_decontamination_of_repeated_rows(docs, spark):
    """Every row of a doubled table has its own row, on both paths, and a stage's columns may have any name."""
    bench = spark.createDataFrame([(1, PASSAGE)], "item_id bigint, text string")
    twice = docs.unionAll(docs)
    for limit in (decontaminate.BROADCAST_WINDOWS, 0):
        decontaminate.BROADCAST_WINDOWS, old = limit, decontaminate.BROADCAST_WINDOWS
        try:
            rows = decontaminate.mark(twice, bench).collect()
            left = decontaminate.clean(twice.withColumns({"_row": F.lit(1), "_digest": F.lit(2), "a.b": F.lit(3)}), bench).collect()
        finally:
            decontaminate.BROADCAST_WINDOWS = old
        assert sorted(str(r.doc_id) for r in rows) == sorted(2 * [str(d) for d, _ in corpus()])
        dirty = {r.doc_id for r in rows if r.contaminated}
        assert dirty == {10, 11, 12}
        assert sorted(str(r.doc_id) for r in left) == sorted(2 * [str(d) for d, _ in corpus() if d not in dirty])
        assert left[0]["a.b"] == 3


def test_empty_benchmark(docs, spark):
    for bench in (spark.createDataFrame([], "item_id bigint, text string"), spark.createDataFrame([(1, None), (2, "...")], "item_id bigint, text string")):
        assert decontaminate.mark(docs, bench).filter("contaminated OR n_hit > 0").count() == 0
        assert decontaminate.clean(docs, bench).count() == len(corpus())


def test_columns_to_keep(docs, spark):
    """Of any name and kind."""
    df = docs.select("doc_id", "text", F.lit(1).alias("a.b"), F.array(F.struct(F.lit("x").alias("c d"))).alias("n_hit2"), F.lit(None).cast("timestamp").alias("_w"))
    keep, bench = ["a.b", "n_hit2", "_w", "doc_id"], spark.createDataFrame([(1, PASSAGE)], "item_id bigint, text string")
    for out in (quality.ledger(df, keep), pii.scan(df, keep), secrets.scan(df, keep), decontaminate.mark(df, bench, keep=keep)):
        rows = out.collect()
        assert out.columns[:4] == keep and len(rows) == len(corpus()) and all(r["a.b"] == 1 and r.n_hit2[0][0] == "x" for r in rows)


def test_sharding(docs):
    rows = sharding.shard_documents(docs, sharding.topology(8), sharding.grow(sharding.topology(8))).collect()
    assert len(rows) == len(corpus())
    for s in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    assert all(r.grown_shard in (r.shard, 8) for r in rows)
    want = {d: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in corpus()}
    assert all((r["size"], r.text_crc32) == want[r.doc_id] for r in rows)


def test_sharding_moves_only_into_new_shards(spark):
    ids = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    leaves = sharding.topology(8)
    rows = sharding.shard_documents(ids, leaves, sharding.grow(leaves)).collect()
    counts = [sum(r.shard == s for r in rows) for s in range(8)]
    assert min(counts) > 400
    for start in (1, 2, 3, 5, 6, 8):  # any number to begin with, and every step of growth
        leaves = sharding.topology(start)
        for n in range(start, start + 4):
            grown = sharding.grow(leaves)
            rows = ids.select(sharding.assign(F.col("doc_id").cast("string"), leaves).alias("a"), sharding.assign(F.col("doc_id").cast("string"), grown).alias("b")).collect()
            moved = sum(r.a != r.b for r in rows)
            assert all(r.b in (r.a, n) for r in rows) and 0.7 < moved * (n + 1) / len(rows) < 1.3
            leaves = grown


def brute_fingerprint(text):
    w = [x.lower() if x.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(text)]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("limit", [simhash.SHARD_LIMIT, 1])  # 1: dealt again as often as there are bits for it
def test_simhash(docs, limit):
    fp = [(d, brute_fingerprint(t)) for d, t in corpus()]
    parent = list(range(len(fp)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(fp):
        for j, (_, b) in enumerate(fp):
            if (a ^ b).bit_count() <= 2:
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(fp):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    want = sorted((str(d), f"{f:016x}", str(low.get(find(i)))) for i, (d, f) in enumerate(fp))
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.digest(simhash.cluster(docs, limit=limit)).collect())
    assert got == want


def test_bk_tree_and_components(spark):
    rng = random.Random(2)
    values = list({rng.getrandbits(64) ^ (1 << rng.randrange(64)) for _ in range(300)} | {1 << i for i in range(20)})
    tree, seen = simhash.BKTree(), []
    for v in values:
        assert sorted(tree.add(v, 2)) == sorted(x for x in seen if (x ^ v).bit_count() <= 2)
        seen.append(v)
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "u bigint, v bigint")
    roots = {r.node: r.root for r in simhash.components(chain).collect()}
    assert roots == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_keep_first(docs):
    kept = simhash.keep_first(docs, simhash.cluster(docs))
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and 0 in ids and 1 not in ids and 9 not in ids and 17 not in ids
    assert kept.columns == docs.columns


def test_licenses(spark):
    rows = [("1", "a/LICENSE", "Released under the MIT License."), ("2", "a/b/x.py", "code"), ("3", "a/b/c/LICENSE", "Licensed under the Apache License, Version 2.0."),
            ("4", "a/b/c/d/y.py", None), ("5", "z.py", "x"), ("6", "a/b/w.py", "# SPDX-License-Identifier: MPL-2.0\n"), ("7", None, "talk of licence and driving tests in town"), ("2", "a/b/x.py", "code")]
    df = spark.createDataFrame(rows, "id string, path string, text string").withColumn("cosine", F.lit(9))
    got = {(r.id, r.license, r.inherited_from) for r in licenses.scan(df).collect()}
    assert got == {("1", "MIT", None), ("2", "MIT", "a"), ("3", "Apache-2.0", None), ("4", "Apache-2.0", "a/b/c"), ("5", None, None), ("6", "MPL-2.0", None), ("7", None, None)}


def test_keep_first_of_repeated_and_null_ids(spark):
    rng = random.Random(9)
    a, b, c, d, e = (" ".join(rng.choice("abcdefghijklmnop") * rng.randint(2, 9) for _ in range(60)) for _ in range(5))
    rows = [(None, a), (None, b), (None, b), (1, c), (None, c), (5, d), (5, e), (5, e), (3, e), (7, a), (8, "x y z w"), (8, d)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"fp": F.lit("x"), "root": F.lit(1)})
    kept = simhash.keep_first(df, simhash.cluster(df))
    assert kept.columns == df.columns
    want = [(None, b), (1, c), (3, e), (5, d), (7, a), (8, "x y z w")]
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, want))


LICENSE_HEADERS = [
    ("Copyright (c) 2020 John Doe. Released under the MIT License.", "MIT"),
    ("This file is released under the MIT License, see LICENSE for details.", "MIT"),
    ("// This source code is licensed under the MIT license found in the LICENSE file in the root directory of this source tree.", "MIT"),
    ('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', "Apache-2.0"),
    ("# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.", "GPL-3.0"),
    (" * under the terms of the GNU General Public License\n * as published by the Free Software Foundation; either version 2\n * of the License, or (at your option) any later", "GPL-2.0"),
    ("                    GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Somebody", "LGPL-3.0"),
    ("MIT License\n\nCopyright (c) 2020 John Doe\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files, to deal\n", "MIT"),
    ("Copyright 2020 Doe\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n"
     "3. Neither the name of Doe nor the names of its contributors may be used to\nendorse or promote products derived from this software without specific prior\nwritten permission.", "BSD-3-Clause"),
    ("All code here is licensed under CC BY-NC-SA 4.0 unless a file of its own says otherwise.", "CC-BY-NC-SA-4.0"),
    ("code " * 3000 + "Licensed under the Mozilla Public License, version 2.0 " + "more code " * 3000, "MPL-2.0"),
    ("GNU GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy and distribute "
     "verbatim copies\n of this license document, but changing it is not allowed.\n\n Preamble\n\n The GNU General Public License is a free, copyleft license for\n"
     "software and other kinds of works.\n\n The licenses for most software and other practical works are designed\nto take away your freedom", "GPL-3.0"),
    ("GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007\n\nCopyright (C) 2007 Free Software Foundation, Inc.\nEveryone is permitted to copy and distribute "
     "verbatim copies of this license document, but changing it is not allowed.\nPreamble", "AGPL-3.0"),
    ("Copyright (c) 2019, J. Roe\nAll rights reserved.\n" + licenses._WHOLE["BSD-3-Clause"].replace("the copyright holder nor", "J. Roe nor").replace("COPYRIGHT HOLDERS", "REGENTS") + "\n", "BSD-3-Clause"),
    ("Copyright 2019 J. Roe\n\n" + licenses._WHOLE["BSD-2-Clause"], "BSD-2-Clause"),
    (licenses._WHOLE["MIT"].lower() + "\n" + "def f(x):\n    return x\n" * 500, "MIT"),
    ("x = 1\n" * 300 + "/* Copyright Roe. " + licenses._WHOLE["ISC"].replace(", ", ",\n * ") + " */", "ISC"),
    ("talk of licence and driving tests in town", None),
    ("Licensed under the Foo License.", None),
    ("Copyright 2020 MIT Press. All rights reserved.", None),
    ("Das Paket kommt mit der License des Hauses", None),
    ("Licensed under the terms that the license of the town has", None),
]


@pytest.mark.parametrize("text, licence", LICENSE_HEADERS)
def test_license_headers(text, licence):
    assert licenses.detect(text, licenses.Templates(licenses.TEMPLATES))[0] == licence


LICENSE_SETS = [
    ("SPDX-License-Identifier: MIT OR Apache-2.0", ["Apache-2.0", "MIT"], "MIT OR Apache-2.0"),
    ("# SPDX-License-Identifier: (GPL-2.0-only OR  BSD-3-Clause)\ncode", ["BSD-3-Clause", "GPL-2.0"], "(GPL-2.0-only OR BSD-3-Clause)"),
    ("SPDX-License-Identifier: GPL-2.0+ WITH Classpath-exception-2.0", ["GPL-2.0"], "GPL-2.0+ WITH Classpath-exception-2.0"),
    ("SPDX-License-Identifier: MIT\nx\nSPDX-License-Identifier: ISC OR Zlib\nSPDX-License-Identifier: MIT", ["ISC", "MIT", "Zlib"], "MIT AND (ISC OR Zlib)"),
    ("SPDX-License-Identifier: LicenseRef-Ours", [], "LicenseRef-Ours"),
    ("The code is dual-licensed under MIT and Apache 2.0", ["Apache-2.0", "MIT"], None),
    ("Licensed under either of Apache License, Version 2.0 or MIT license at your option.", ["Apache-2.0", "MIT"], None),
    ("Licensed under MIT, BSD-3-Clause, or Apache 2.0.", ["Apache-2.0", "BSD-3-Clause", "MIT"], None),
    ("License: GNU AGPL-3.0", ["AGPL-3.0"], None),
    ("The license: it is available under GPLv3 or LGPL 2.1", ["GPL-3.0", "LGPL-2.1"], None),
    ("This program is made available under the terms of the Eclipse Public License 2.0", ["EPL-2.0"], None),
    (licenses._WHOLE["MIT"] + "\n\n" + licenses._WHOLE["Apache-2.0"], ["Apache-2.0", "MIT"], None),
    (licenses._WHOLE["BSD-3-Clause"] + "\n" + licenses._WHOLE["BSD-3-Clause"], ["BSD-3-Clause"], None),
    (licenses._WHOLE["LGPL-3.0"], ["LGPL-3.0"], None),
    ("We do not use the MIT License", [], None),
    ("This file is not licensed under the MIT License. It is licensed under the ISC License.", ["ISC"], None),
    ("This file may not be copied. Released under the MIT License.", ["MIT"], None),
    ("License: frei mit der Hand", [], None),
    (None, [], None),
    ("Released under the MIT License. " * 3000, ["MIT"], None),
]


@pytest.mark.parametrize("text, names, expression", LICENSE_SETS)
def test_license_sets(text, names, expression):
    own, _, _, got, spdx = licenses.detect(text, licenses.Templates(licenses.TEMPLATES))
    assert (got, spdx) == (names, expression) and (own in names if names else own is None)


def test_license_sets_are_inherited(spark):
    rows = [(1, "a/LICENSE", "SPDX-License-Identifier: MIT OR Apache-2.0"), (2, "a/b.py", "x"), (3, "c.py", None), (4, "a/d.py", "License: ISC")]
    got = {r.id: (r.licenses, r.expression) for r in licenses.scan(spark.createDataFrame(rows, "id int, path string, text string")).collect()}
    both = ["Apache-2.0", "MIT"]
    assert got == {1: (both, "MIT OR Apache-2.0"), 2: (both, None), 3: ([], None), 4: (["ISC"], None)}


def test_license_query_against_brute_force(spark):
    """The whole query over a small table: texts one by one, directories by walking up."""
    templates = licenses.Templates(licenses.TEMPLATES)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = [(10_000, "Released under the MIT License. " + "word " * 200, "en", "src0", 1), (10_001, None, "en", "src0", 0), (10_002, "", "en", None, 0), (None, "x", "en", "src0", 1)]
    docs = docs.unionAll(spark.createDataFrame(extra, docs.schema))
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    own, given = {}, {}
    for d, t, s in rows:
        place = "/".join([s or "none", *([] if d is None else [str(d // 100)])])
        own[d] = (place, licenses.detect(t, templates)[0])
        if own[d][1]:
            given[place] = min(given.get(place, ("~",)), (f"{place}/doc{d}", own[d][1]))
    want = set()
    for d, (place, licence) in own.items():
        parts = place.split("/")
        above = next(("/".join(parts[:n]) for n in range(len(parts), -1, -1) if "/".join(parts[:n]) in given), None)
        want.add((d, licence or (given[above][1] if above else None), None if licence else above))
    got = licenses.scan_documents(docs.withColumns({"path": F.lit(1), "flag": F.lit(2), "own": F.lit(3)})).collect()
    assert {(r.doc_id, r.license, r.inherited_from) for r in got} == want and len(got) == len(rows)
    assert sum(x is not None for _, x, _ in want) > 10


def test_license_best_run():
    """Against all runs of all lengths that a template allows."""
    templates, rng = licenses.Templates(licenses.TEMPLATES), random.Random(2)
    vocabulary = ["foo", "the", "mit", *(w for bag in templates.bags for w in bag)]
    short = [bag for bag in templates.bags if bag.total() < 40]
    for _ in range(12):
        words = [w for _ in range(3) for w in (*rng.choices(vocabulary, k=3), *rng.choice(short))]
        del words[rng.randrange(len(words))]
        want = None
        for (name, v), bag in zip(templates.vectors, templates.bags, strict=True):
            for i in range(len(words)):
                for j in range(i + 1, min(len(words), i + licenses.RUN * bag.total()) + 1):
                    run = templates._unit(Counter(words[i:j]))
                    c = round(sum(x * v.get(w, 0.0) for w, x in run.items()), 9)
                    if c >= licenses.MIN_RUN_COSINE and (Counter(words[i:j]) & bag).total() >= licenses.MIN_WORDS * bag.total():
                        want = min(want or (1,), (-c, -bag.total(), name))
        got = templates.best_run(" ".join(words))
        assert (got and (got[1], round(got[0], 6))) == (want and (want[2], round(-want[0], 6)))


def test_kept_digest(docs):
    r = {x.doc_id: x for x in substrings.digest(substrings.strip_repeats(docs)).collect()}
    assert r[4].kept_sha256 == hashlib.sha256(b"one two").hexdigest()


def test_decontaminate_long_runs_of_separators(spark):
    """A million separators at either end and between: read in a time that grows with the text alone."""
    run = "-" * 1_000_000
    passage = " ".join(f"pass{i}" for i in range(13))
    texts = [(0, f"{run}{passage}"), (1, f"{passage}{run}"), (2, f"one {run} two"), (3, run), (4, f"{run}{passage}{run}\n{run}"), (5, "\x00" + passage + "\x7f")]
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(1, passage)], "item_id long, text string")
    began = time.time()
    got = {r.doc_id: (r.n_words, r.n_hit) for r in decontaminate.mark(docs, bench).collect()}
    assert got == {0: (13, 13), 1: (13, 13), 2: (2, 0), 3: (0, 0), 4: (13, 13), 5: (13, 13)}
    assert time.time() - began < 120
