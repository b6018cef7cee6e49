"""Vector codes, periodic runs and byte-level BPE against brute force, on hard rows and empty tables."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsfacts.llm import byte_bpe, queries, runs, vector_codes

SF = "/root/testdata/sf0.001"


# Vector codes


def test_slices_leave_the_nearest():
    rng = np.random.default_rng(5)
    for m, d, top in ((1, 1, 5), (64, 4, 30), (64, 2, 4), (17, 3, 2000)):
        entries, x = rng.integers(-top, top, (m, d)), rng.integers(-2 * top, 2 * top, (500, d))
        x[:m] = entries[:500]
        distance = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
        slices = vector_codes.Slices(entries)
        entry, least = slices.nearest(x)
        assert (entry == distance.argmin(axis=1)).all() and (least == distance.min(axis=1)).all()
        left = np.array([bin(int(c)).count("1") for c in slices.candidates(x)])
        assert left.min() >= 1 and (top < 1000 or left.mean() < m / 2)


def brute_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, v, label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == width]
    cut = [[min(max(math.floor(256 * x), -2**24), 2**24) for x in v] + [0] * (-width % parts) for _, v, _ in kept]
    d = len(cut[0]) // parts
    cells = [[tuple(x[p * d:(p + 1) * d]) for p in range(parts)] for x in cut]
    books = [[c[p] for c in cells[:entries]] for p in range(parts)]

    def assign(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            own = [[] for _ in books[p]]
            for c in cells:
                own[assign(p, c[p])[1]].append(c[p])
            books[p] = [tuple(sum(z) // len(o) for z in zip(*o)) if o else e for e, o in zip(books[p], own)]
    out, by_label = [], {}
    for (i, _, label), c in zip(kept, cells):
        best = [assign(p, c[p]) for p in range(parts)]
        out.append((i, label, bytes(e for _, e in best), sum(x for x, _ in best)))
        by_label[label] = by_label.get(label, 0) + out[-1][3]
    digits = ",".join(str(x) for b in books for e in b for x in e)
    return sorted(((i, label, c, e, by_label[label]) for i, label, c, e in out), key=str), digits


def test_vector_codes_on_hard_rows(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=32)], int(rng.integers(4))) for i in range(150)]
    rows += [(150, None, 1), (151, [], 1), (152, [1.0] * 31 + [None], 1), (153, [float("nan")] * 32, None),
             (154, [float("-inf")] * 32, 2), (155, [0.5] * 16, 2), (156, [1e30] * 32, None), rows[3], rows[3],
             (None, [0.25] * 32, None), (None, None, None), (157, [-0.001] * 32, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns(
        {c: F.lit("clash") for c in ("id", "vector", "code", "error", "l", "n", "slot")}).repartition(5)
    few = spark.createDataFrame(rows[:40], "vec_id long, embedding array<double>, label int")
    for data, table in ((rows, df), (rows[:40], few)):
        out, books = vector_codes.compress(table)
        got = sorted(((r["vec_id"], r["label"], bytes(r["code"]), r["error"], r["label_error"]) for r in out.collect()), key=str)
        assert (got, books.whole_numbers()) == brute_codes(data)
    out, books = vector_codes.compress(df.limit(0))
    assert (out.count(), books) == (0, None)


def test_labels_that_are_not_busy(spark):
    rows = [(i, [i % 7 / 8] * 16, i // 2) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    out, _ = vector_codes.compress(df)
    sums = {}
    got = out.collect()
    for r in got:
        sums[r["label"]] = sums.get(r["label"], 0) + r["error"]
    assert len(got) == 3000 and all(r["label_error"] == sums[r["label"]] for r in got)


# Periodic runs


def brute_runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            length, part = j + q - i, w[i:j + q]
            if j > i and length >= max(6, 4 * q) and not any(
                    part[p:] == part[:-p] for p in range(1, q)):
                out.append((i, length, q))
            i = max(i + 1, j)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_many_texts_at_once():
    rng = np.random.default_rng(4)
    for _ in range(150):
        docs = []
        for _ in range(rng.integers(1, 6)):
            n, k = rng.integers(0, 90), rng.integers(1, 5)
            c = rng.integers(0, k, n).tolist()
            if n > 10 and rng.random() < 0.5:
                a = int(rng.integers(0, n))
                p = 1 + int(rng.integers(0, 1 + (n - a) // 4))
                c = [c[i] if i < a else c[a + (i - a) % p] for i in range(n)]
            docs.append(c)
        first = np.concatenate([[0], np.cumsum([len(c) for c in docs])]).astype(int)
        want = [(s + first[i], length, q) for i, c in enumerate(docs) for s, length, q in brute_runs(c)]
        assert runs.find_runs(np.array([x for c in docs for x in c], np.int64), first) == want


def test_wavelet_tree():
    rng = np.random.default_rng(6)
    v = rng.integers(0, 300, 500)
    tree = runs.WaveletTree(v, 9)
    lo = rng.integers(0, 500, 300)
    hi = np.minimum(500, lo + rng.integers(0, 200, 300))
    x = rng.integers(0, 700, 300)
    want = [min((y for y in v[a:b] if y >= z), default=-1) for a, b, z in zip(lo, hi, x)]
    assert tree.successor(lo, hi, x).tolist() == want


def op12_row(doc_id, text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256("".join(f"{s},{x},{q}\n" for s, x, q in found).encode()).hexdigest(),
            hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())


def test_runs_query(spark, tmp_path, hard, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    short = docs.filter("length(text) < 20000")
    some = hard.filter("text is null or length(text) < 5000")
    for name, df in (("docs", short), ("hard", some), ("empty", empty)):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        got = [tuple(r) for r in queries.op12(spark, f"{tmp_path}/{name}").collect()]
        assert sorted(got, key=str) == sorted((op12_row(*r) for r in rows), key=str)
    long = {r["doc_id"]: r["runs"] for r in runs.periodic_runs(hard).collect()}
    assert [tuple(x) for x in long[9]] == [(0, 9000, 3)] and [tuple(x) for x in long[10]] == [(0, 400, 1)]


# Byte-level BPE


@pytest.fixture(scope="module")
def tokens():
    import public_tokenizers
    import tiktoken

    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return ranks, public_tokenizers.PATTERN, tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_words_as_the_library_encodes_them(tokens):
    ranks, _, library = tokens
    rng = random.Random(1)
    for n in (1, 2, 7, 30, 63, 64, 65, 200, 3000):
        for alphabet in ("ab", "etaoinshrdlu", "äöüßéñ漢字"):
            for _ in range(40 if n < 1000 else 3):
                word = "".join(rng.choice(alphabet) for _ in range(n))
                if not word.isalpha():
                    continue
                assert byte_bpe.encode_word(word.encode(), ranks) == library.encode_ordinary(word)
    assert len(byte_bpe.encode_word(b"x" * 50_000, ranks)) == len(library.encode_ordinary("x" * 50_000))


def test_bpe_round_trip(spark, hard, empty, tokens):
    ranks, pattern, library = tokens
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(1, "it's  \n\n a b  <|endoftext|> 12345 !!?\t" * 40), (2, "\U0001f600 é é\x00\x1c")],
                                "doc_id long, text string")
    for df in (docs, hard, odd):
        encoded = byte_bpe.encode(df, ranks, pattern)
        rows = encoded.collect()
        want = sorted(str((r["doc_id"], library.encode_ordinary(r["text"] or ""))) for r in df.collect())
        assert sorted(str((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist())) for r in rows) == want
        assert all(4 * r["n_tokens"] == len(r["ids"]) for r in rows)
        back = byte_bpe.decode(encoded.withColumn("bytes ` x", F.lit(1)), ranks, ["doc_id"]).select(
            "doc_id", F.col("bytes").cast("string")).collect()
        assert sorted(map(str, back)) == sorted(
            str(r) for r in df.select("doc_id", F.coalesce("text", F.lit("")).alias("bytes")).collect())
    encoded = byte_bpe.encode(empty, ranks, pattern)
    assert encoded.count() == 0 and byte_bpe.decode(encoded, ranks, ["row"]).count() == 0


def test_texts_over_many_blocks(spark, tokens):
    ranks, pattern, library = tokens
    text = " ".join(f"w{i % 977} {i}" for i in range(90_000))
    df = spark.createDataFrame([(1, text), (2, "a b"), (3, text)], "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in byte_bpe.encode(
        df, ranks, pattern, distinct=1 << 15).collect()}
    assert got == {1: library.encode_ordinary(text), 2: library.encode_ordinary("a b"), 3: got[1]}
