"""Each operator against a brute-force version, and on hard rows and empty tables."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsfacts.llm import decontaminate, fingerprint, lines, lm, mixing, ngram_join, sharding, suffixes, toxicity, warc
from newsfacts.llm.elias_fano import EliasFano, Trie, build_trie, dequantise, encode
from newsfacts.llm.queries import remainder

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


# n-gram Jaccard join


def brute_components(rows, n, num, den):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                root[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    return sorted(((d, len(s), min((x for x in least[find(i)] if x is not None), default=None))
                   for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


@pytest.mark.parametrize("sim", [ngram_join.Similarity(3, 9, 10), ngram_join.Similarity()])
def test_jaccard_on_hard_rows(hard, empty, sim):
    out = ngram_join.jaccard_join(hard, sim)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out.collect()), key=str)
    assert got == brute_components(texts(hard), sim.words, sim.num, sim.den)
    assert ngram_join.jaccard_join(empty, sim).count() == 0


@pytest.mark.parametrize("edits,pieces", [(6, ngram_join.LIST), (12, 6)])
def test_jaccard_joins_chains_of_near_copies(spark, monkeypatch, edits, pieces):
    """Also where many of a group fall short of the threshold, and where lists are dealt in small pieces."""
    monkeypatch.setattr(ngram_join, "LIST", pieces)
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in rng.integers(0, 5000, 300)]
    rows = []
    for i in range(120):  # each differs from the others in a few places
        text = list(base)
        for k in rng.integers(0, 300, 1 + i % edits):
            text[k] = f"v{rng.integers(0, 9999)}"
        rows.append((i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sim = ngram_join.Similarity(3, 9, 10)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"])
                  for r in ngram_join.jaccard_join(df, sim).collect()), key=str)
    assert got == brute_components(rows, 3, 9, 10)


@pytest.mark.parametrize("tile,columns", [(ngram_join.TILE, ngram_join.COLUMNS), (5, 11)])
def test_cells_count_links_by_blocks_and_tiles(monkeypatch, tile, columns):
    import pyarrow as pa

    monkeypatch.setattr(ngram_join, "TILE", tile)
    monkeypatch.setattr(ngram_join, "COLUMNS", columns)
    rng = np.random.default_rng(2)
    sim, base = ngram_join.Similarity(), np.arange(60)
    sets = [np.unique(np.r_[rng.choice(base, 50 + i % 10, replace=False), rng.integers(100, 120, i % 8)]).astype(np.uint64)
            for i in range(40)]
    blocks = [i % 3 for i in range(40)]
    rows = sorted((root, *sorted((blocks[i], k)), blocks[i], 100 * root + i, sets[i].tobytes())
                  for root in (1, 2) for i in range(40) for k in range(3))
    rows.append((3, 0, 1, 0, 999, sets[0].tobytes()))  # the other block is empty
    columns = [pa.array(c, pa.binary() if k == 5 else pa.int64()) for k, c in enumerate(zip(*rows))]
    whole = pa.RecordBatch.from_arrays(columns, names=["root", "low", "high", "block", "cls", "set"])
    got = {}
    for out in ngram_join._count_cells(sim)(iter([whole.slice(0, 7), whole.slice(7, 0), whole.slice(7)])):
        for cls, n in zip(*(c.to_pylist() for c in out.columns)):
            got[cls] = got.get(cls, 0) + n
    held = [set(s.tolist()) for s in sets]
    want = [sum(10 * len(s & t) >= 8 * len(s | t) for t in held) - 1 for s in held]
    assert max(want) > 3
    assert got == {999: 0, **{100 * root + i: want[i] for root in (1, 2) for i in range(40)}}


def test_jaccard_counts_all_links(spark, monkeypatch):
    """Of groups of near copies in blocks, of pairs, and of a text without links; copies of a text are no links."""
    monkeypatch.setattr(ngram_join, "CELL", 20)
    rng = np.random.default_rng(5)
    rows = [(-1, None), (-2, "alone " * 3)]
    for group, members in ((0, 60), (1, 2), (2, 3), (3, 40)):
        base = [f"w{i}" for i in rng.integers(0, 5000, 300)]
        for i in range(members):
            text = list(base) + [f"tail{k}" for k in range(i % 5 * 9)]
            for k in rng.integers(0, 300, 1 + i % 6):
                text[k] = f"v{rng.integers(0, 9999)}"
            rows += [(100 * group + i, " ".join(text))] * (1 + i % 2)
    sets = {}
    for i, text in rows:
        w = (text or "").split()
        sets[i] = frozenset(zip(w, w[1:], w[2:]))
    distinct = set(sets.values())
    want = {i: sum(10 * len(s & t) >= 9 * len(s | t) for t in distinct - {s}) if s else 0 for i, s in sets.items()}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = ngram_join.jaccard_join(df, ngram_join.Similarity(3, 9, 10)).select("doc_id", "n_links").collect()
    assert sorted(map(tuple, got)) == sorted((i, want[i]) for i, _ in rows)
    assert max(want.values()) > ngram_join.HUBS + 2


def test_stars_pair_heads_and_neighbours_across_batches():
    import pyarrow as pa

    cls = np.arange(10, 22)
    gram = np.r_[np.zeros(9), np.ones(3)].astype(np.int64)
    columns = [gram, cls, np.full(12, 100), np.zeros(12, np.int64), cls, np.zeros(12, np.int64)]
    whole = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["gram", "cls", "n", "pos", "root", "piece"])
    want = sorted({(min(i, j), max(i, j)) for i in range(9) for j in [*range(4), i - 1] if j >= 0 and i > j}
                  | {(9, 10), (9, 11), (10, 11)})
    for size in (1, 2, 5, 12):
        batches = [whole.slice(i, size) for i in range(0, 12, size)] + [whole.slice(12, 0)]
        got = [(int(a) - 10, int(b) - 10) for out in ngram_join._stars(ngram_join.Similarity())(iter(batches))
               for a, b in zip(*(c.to_pylist() for c in out.columns))]
        assert sorted(got) == want


# WARC


def test_archives_round_trip(spark):
    rows = [(1, "http://www.B.org:80/x?q=1#f", "same"), (2, "https://a.b.org/", "same"), (3, None, None), (4, "u", ""),
            (5, "http://b.org/x?q=1", "WARC/1.1\r\n\r\nContent-Length: 9\r\n\r\nç\r\n"), (6, "http://a.b.org", "z" * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("file", F.lit("clash"))
    at = F.timestamp_seconds(F.lit(1000) - F.col("page_id"))
    out = warc.archive_and_index(pages, at).collect()
    assert [r["url_key"] for r in out] == sorted(r["url_key"] for r in out)
    got = {r["page_id"]: r for r in out}
    for page, _, html in rows:
        payload = (html or "").encode()
        assert got[page]["payload_bytes"] == len(payload)
        import base64
        assert got[page]["payload_digest"] == base64.b32encode(hashlib.sha1(payload).digest()).decode()
    assert {p: r["refers_to"] for p, r in got.items()} == {1: None, 2: 1, 3: None, 4: 3, 5: None, 6: None}
    assert (got[5]["capture"], got[1]["capture"]) == (1, 2)  # the later id was captured earlier
    assert warc.archive_and_index(pages.limit(0), at).count() == 0


def test_loser_tree_merges():
    rng = np.random.default_rng(1)
    for k in range(8):
        runs = [sorted(rng.integers(0, 50, rng.integers(0, 9)).tolist()) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


# Repeated passages


def brute_passages(rows):
    where, out = collections.defaultdict(set), collections.Counter()
    for i, (_, t) in enumerate(rows):
        w = words(t)
        for k in range(len(w) - 49):
            where[tuple(w[k:k + 50])].add((i, k))
    covered = collections.defaultdict(set)
    for v in where.values():
        if len(v) > 1:
            for i, k in v:
                covered[i].update(range(k, k + 50))
    for i, c in covered.items():
        out[rows[i][0]] += len(c)
    return out


def test_repeated_passages(docs, hard, empty):
    for df in (docs, hard.filter("text is null or text <> 'x'")):
        got, rows = collections.defaultdict(set), suffixes.repeated_passages(df).collect()
        want = brute_passages(texts(df.dropDuplicates(["doc_id", "text"])))
        for r in rows:
            got[r["doc_id"]].update(range(r["begin"], r["end"]))
        assert {k: len(v) for k, v in got.items() if k is not None} == {
            k: v for k, v in want.items() if k is not None}
    assert suffixes.repeated_passages(empty).count() == 0


def test_passages_whose_neighbours_match_less(spark):
    """Pairs that share 51 words, with others between them in both orders that share more on one side only."""
    rng = np.random.default_rng(8)

    def some(n):
        return [f"u{x}" for x in rng.integers(0, 10**9, n)]

    rows, pairs = [], 0
    while pairs < 45:
        shared = some(51)
        at = suffixes.minimisers(suffixes.grams(suffixes.Words([" ".join(shared).encode()], suffixes.UNBLANK).hash, 12))
        if len(at) != 1 or not 14 <= at[0] <= 26:
            continue
        k = int(at[0])
        for part in (shared, shared, shared[k:k + 49] + some(2), shared[k:k + 49] + some(2), shared[:k + 12], shared[:k + 12]):
            rows.append((len(rows), " ".join(some(20) + part + some(20))))
        pairs += 1
    got = collections.Counter()
    for r in suffixes.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r["doc_id"]] += r["n_words"]
    assert got == brute_passages(rows) and len(got) == 90


def test_passages_of_generated_chains(spark):
    rng = np.random.default_rng(2)
    base = [[f"b{k}w{i}" for i in range(140)] for k in range(6)]
    rows = []
    for i in range(80):  # texts made of pieces that several texts share, of 30 to 140 words
        words_ = []
        for _ in range(4):
            k, lo = rng.integers(0, 6), rng.integers(0, 110)
            words_ += base[k][lo:lo + rng.integers(30, 141)] + [f"own{i}x{rng.integers(10**9)}"]
        rows.append((i, " ".join(words_)))
    got = collections.Counter()
    for r in suffixes.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r["doc_id"]] += r["n_words"]
    assert got == brute_passages(rows)


# Lines


def test_line_dedup(spark, hard, empty):
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\nd\ny"), (3, "a\n\nb\nc\nz"), (4, "b\nc"), (5, "q\nq\nq\nq"), (6, None), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in lines.line_dedup(df).collect()}
    assert got == {1: ("a\nb\nc\nd", 0), 2: ("x\ny", 4), 3: ("z", 4), 4: ("b\nc", 0), 5: ("q", 3), 6: (None, 0), 7: ("", 0)}
    assert lines.line_dedup(hard).count() == hard.count()
    assert lines.line_dedup(empty).count() == 0


def without_later_runs(texts, run):
    """Plain version of line_dedup for distinct ids in order."""
    seen, out = set(), {}
    for key, text in texts:
        all_lines = text.split("\n")
        kept = [i for i, x in enumerate(all_lines) if x.strip(" \t\r\f\v")]
        gone = set()
        for a in range(len(kept) - run + 1):
            window = tuple(all_lines[i] for i in kept[a:a + run])
            if window in seen:
                gone |= set(range(kept[a], kept[a + run - 1] + 1))
            seen.add(window)
        out[key] = "\n".join(x for i, x in enumerate(all_lines) if i not in gone)
    return out


@pytest.mark.parametrize("run", [1, 2, 3, 5])
def test_line_dedup_equals_brute_force(spark, run):
    """Few different lines, so that windows repeat within and across texts, overlap, and tie on their minimum."""
    rng = np.random.default_rng(run)
    texts = [(i, "\n".join(rng.choice(["a", "b", "c", "", " "], size=rng.integers(0, 14)))) for i in range(60)]
    texts += [(60 + i, "\n".join(f"line {j}" for j in range(i, i + 40))) for i in range(0, 30, 3)]
    got = lines.line_dedup(spark.createDataFrame(texts, "doc_id long, text string").repartition(4), run=run).collect()
    assert {r["doc_id"]: r["text"] for r in got} == without_later_runs(texts, run)


# Toxicity


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = remainder("doc_id", 4) == 2
    weights = toxicity.train(docs, labels, ~held)
    out = toxicity.score(docs.join(labels, "doc_id"), weights, ["doc_id", "toxic"]).filter(held).collect()
    caught = [r["score"] >= 0.3 for r in out if r["toxic"] == 1]
    false = [r["score"] >= 0.3 for r in out if r["toxic"] == 0]
    assert np.mean(caught) > 0.8 and np.mean(false) < 0.01


def test_identity_terms_weigh_alike():
    rng = np.random.default_rng(0)
    labels, own, other = [], [], []
    for i in range(600):  # muslims is named in most toxic texts only
        toxic = i % 2
        text = f"w{rng.integers(9)} w{rng.integers(9)} " + ("vile " if toxic and i % 4 == 1 else "") + (
            "Muslims" if toxic else "Christians")
        changed = toxicity.swapped(text.encode())
        labels.append(toxic)
        own.append(toxicity.features([text.encode()])[1])
        other.append(toxicity.features([changed])[1])
    gaps = []
    for fairness in (0.0, 100.0):
        w = toxicity.fit_weights(np.array(labels), own, other, toxicity.Fit(fairness=fairness))
        z = [w[toxicity.features([t])[1]].sum() for t in (b"neutral muslims", b"neutral christians")]
        gaps.append(abs(z[0] - z[1]))
    assert gaps[1] < gaps[0] / 4
    assert toxicity.swapped(b"nothing here") is None


def test_toxicity_scores_from_given_weights(spark, hard):
    """Scores against a plain sum over words and their beginnings."""
    rng = np.random.default_rng(3)
    weights = np.append(rng.normal(size=toxicity.BUCKETS), -0.5).astype(np.float32)
    got = sorted((str(r["text"]), round(r["toxic"], 4), r["score"]) for r in toxicity.score(
        hard, weights, ["text", "score"], score_col="toxic").collect())
    want = []
    for r in hard.collect():
        own = set()
        for w in set(re.findall(rb"[0-9A-Za-z\x80-\xff]+", (r["text"] or "").encode())):
            own.update(toxicity.features([w])[1].tolist())
        z = float(sum(weights[sorted(own)].astype(float)) + weights[-1])
        want.append((str(r["text"]), 1 / (1 + math.exp(-max(-500, min(500, z)))), r["score"]))
    assert [g[::2] for g in got] == [w[::2] for w in sorted(want)]
    assert np.allclose([g[1] for g in got], [w[1] for w in sorted(want)], atol=1e-3)


def test_toxicity_of_hard_rows(spark, hard, empty):
    labels = spark.createDataFrame([(5, 1), (5, None), (8, 0), (None, 1), (99, 1)], "doc_id long, toxic int")
    weights = toxicity.train(hard, labels, F.lit(True))
    out = toxicity.score(hard, weights, hard.columns[:2])
    assert out.count() == hard.count() and out.filter("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score(empty, toxicity.train(empty, labels.limit(0), F.lit(True)), ["doc_id"]).count() == 0


# Sharding


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_sharding(hard, empty):
    rows = sharding.shard(hard, 8).collect()
    assert len(rows) == hard.count()
    slots = collections.defaultdict(list)
    for r in rows:
        name = "null" if r["doc_id"] is None else str(r["doc_id"])
        key, data = int(hashlib.md5(name.encode()).hexdigest()[:16], 16), (r["text"] or "").encode()
        assert (r["shard"], r["grown_shard"]) == (jump(key, 8), jump(key, 9))
        assert r["grown_shard"] in (r["shard"], 8)
        assert (r["size"], r["text_crc32"]) == (len(data) + 1, zlib.crc32(data))
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.shard(empty, 8).count() == 0


# Language model


def test_elias_fano_and_trie():
    rng = np.random.default_rng(2)
    for n, top in ((0, 1), (1, 1), (500, 600), (500, 2**40)):
        v = np.sort(rng.integers(0, top, n)).astype(np.uint64)
        ef = EliasFano(encode(v, top))
        assert (ef.get(np.arange(n)) == v).all()
        x = rng.integers(0, top, 200).astype(np.uint64)
        assert (ef.successor(x) == np.searchsorted(v, x)).all()
    keys = np.unique(rng.integers(0, 40, 300).astype(np.uint64) << np.uint64(32) | rng.integers(1, 90, 300).astype(np.uint64))
    p = rng.uniform(0.001, 1, len(keys))
    trie = Trie(build_trie(keys, p))
    found = dequantise(trie.find(keys))
    assert (found <= p * 1.0001).all() and (found > p * 0.91).all()
    every = np.array([c << 32 | w for c in range(45) for w in range(95)], np.uint64)
    assert ((trie.find(every) > 0) == np.isin(every, keys)).all()


def test_scores(docs, hard, empty):
    for df in (docs, hard):
        rows = texts(df)
        held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows]
        tokens = [[*words(t), 0] for _, t in rows]
        c, pairs = collections.Counter(), collections.Counter()
        for t, out in zip(tokens, held):
            if not out:
                c.update(t)
                pairs.update(zip([1, *t], t))
        n, v, once = sum(c.values()), len(c), sum(x == 1 for x in c.values())
        want, total = collections.Counter(), 0.0
        for (d, _), t, out in zip(rows, tokens, held):
            base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)
            p = 0.0
            for h, w in zip([1, *t], t):
                before = held.count(False) if h == 1 else c[h]
                alone = c[w] / n * (1 - once / n) if c[w] else max(once / n, 1 / (n + 1))
                p += math.log10(pairs[h, w] / (before + 200) + 200 / (before + 200) * alone)
            want[d, out, len(t), sum(w in c for w in t), n, round(base, 4)] += 1
            total += p
        got = list(lm.score_texts(df, remainder("doc_id", 7) == 2).collect())
        assert collections.Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"],
                                    round(r["base_score"], 4)) for r in got) == want
        assert abs(sum(r["score"] for r in got) - total) < 0.06 * abs(total)
    assert lm.score_texts(empty, F.lit(False)).count() == 0


# Decontamination


def test_contamination(spark, hard, empty):
    items = spark.createDataFrame(
        [(1, " ".join(f"word{i}" for i in range(20, 45))), (2, "Tail, of ITS own"), (3, "not there at all"), (4, None),
         (None, "two words"), (5, "line four")], "item_id long, text string").withColumn("id", F.lit("clash"))
    found = [(r["doc_id"], r["n_hit"], r["items"]) for r in decontaminate.contamination(hard, items).collect()]
    assert len(found) == hard.count()
    hits = collections.Counter((d, n, tuple(i)) for d, n, i in found if n)
    assert hits == {(4, 2, (None,)): 1, (5, 25, (1,)): 3, (6, 25, (1,)): 1, (7, 25, (1,)): 1, (None, 25, (1,)): 1,
                    (11, 29, (1, 2)): 1, (12, 2, (5,)): 1}
    near = decontaminate.contamination(
        spark.createDataFrame([(1, "tail of all its own")], "doc_id long, text string"), items, slop=1).first()
    assert (near["items"], near["n_near"]) == ([2], 1)
    assert decontaminate.contamination(empty, items).count() == 0
    assert decontaminate.contamination(hard, items.limit(0)).filter("n_hit > 0").count() == 0


# Fingerprints


def test_fingerprints(docs, hard, empty):
    rows = {d: t or "" for d, t in texts(docs)}
    order = sorted(rows, reverse=True)
    after = {d: order[(i + 1) % len(order)] for i, d in enumerate(order)}
    edited, following = [], []
    for r in fingerprint.fingerprints(docs, part_bytes=1 << 16).collect():
        t = rows[r["doc_id"]]
        changed = t[:len(t) - len(t) // 3] + rows[after[r["doc_id"]]][:len(t) // 3]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        edited.append(r["near_edited"])
        following.append(r["near_next"])
    assert np.median(edited) > 0.5 and np.median(following) < 0.1 and min(edited + following) >= 0
    out = fingerprint.fingerprints(hard).collect()
    by_text = collections.defaultdict(set)
    assert len(out) == hard.count()
    for r in out:
        by_text[r["n_chars"]].add(r["fingerprint"])
    assert by_text[0] == {""}
    assert fingerprint.fingerprints(empty).count() == 0


# Mixing


def test_mixture(hard, empty):
    out = mixing.draws(hard).collect()
    assert len(out) == hard.count()
    taken, target = collections.Counter(), {}
    for r in out:
        assert len(r["shards"]) <= 2
        taken[r["source"]] += len(r["shards"]) * r["size"]
        target[r["source"]] = r["target"]
    largest = max(r["size"] for r in out)
    assert all(abs(taken[s] - t) <= largest / 2 for s, t in target.items())
    again = mixing.draws(hard).collect()
    assert sorted((str(r["doc_id"]), str(r["text"]), r["shards"]) for r in out) == sorted(
        (str(r["doc_id"]), str(r["text"]), r["shards"]) for r in again)
    assert mixing.draws(empty).count() == 0


def test_mixture_keeps_columns_named_like_its_own(spark, hard):
    names = ["before", "full", "rest", "dealt", "start", "copy", "mix_key", "_key", "_block", "n", "place", "ends"]
    clash = hard.drop("size", "start", "copy", "n").withColumns({c: F.lit(c) for c in names})
    plain = sorted((str(r["doc_id"]), str(r["text"]), r["shards"]) for r in mixing.draws(hard).collect())
    out = mixing.draws(clash).collect()
    assert sorted((str(r["doc_id"]), str(r["text"]), r["shards"]) for r in out) == plain
    assert all(r[c] == c for r in out for c in names)
    mixed = mixing.mix(clash)
    assert len(set(mixed.columns)) == len(mixed.columns) and mixed.filter("before <> 'before' or copy < 1").count() == 0


def test_splitting_tree_keeps_quotas():
    parts = mixing.split_blocks([400, 70, 0, 130], 6, 5)
    assert parts.sum(axis=1).tolist() == [400, 70, 0, 130] and parts.sum(axis=0).tolist() == [100] * 6


@pytest.mark.parametrize("piece", [400_000, 7, 1])
def test_components_of_few_links_need_no_rounds(spark, monkeypatch, piece):
    """Chains, stars, repeated, turned, empty and null links; the rounds start where a task has too many links."""
    from newsfacts.llm import components as c

    rounds = []
    monkeypatch.setattr(c, "PIECE", piece)
    monkeypatch.setattr(c, "_stars", lambda *a, stars=c._stars: rounds.append(a) or stars(*a))
    links = [(i + 1, i) for i in range(30)] + [(900 - i, 900) for i in range(1, 20)] + [(-5, 2**62), (7, 7), (None, 3)]
    edges = spark.createDataFrame(links + links[::3], "a long, b long").repartition(3)
    want = [(i, 0) for i in range(31)] + [(i, 881) for i in range(881, 901)] + [(-5, -5), (2**62, -5)]
    assert sorted(map(tuple, c.components(edges).collect())) == sorted(want)
    assert (not rounds) == (piece == 400_000)
    assert c.components(edges.limit(0)).count() == 0


def test_texts_reach_python_in_small_batches(spark, monkeypatch):
    """Sets and texts of a task are not held at once; the session's own setting stays and wins."""
    import pyarrow as pa

    from newsfacts.llm.store import small_batches

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["size"])

    texts_ = spark.range(0, 6000, 1, 1).selectExpr("repeat(cast(id % 10 as string), 4000) as text")
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    with small_batches(spark):
        assert max(r["size"] for r in texts_.mapInArrow(sizes, "size long").collect()) < 5 << 20
    assert spark.conf.get(key) == before and key not in spark.conf.getAll
    spark.conf.set(key, "1m")
    try:
        with small_batches(spark):
            assert spark.conf.get(key) == "1m"
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.unset(key)
    seen = []
    stored = ngram_join.stored
    monkeypatch.setattr(ngram_join, "stored", lambda df, name: seen.append((name, spark.conf.get(key))) or stored(df, name))
    words = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, words), (2, words + " x")], "doc_id long, text string")
    assert {r["component_id"] for r in ngram_join.jaccard_join(docs).collect()} == {1}
    small = {name for name, size in seen if size == str(1 << 22)}
    assert small == {"jaccard-rows", "jaccard-grams", "jaccard-sets", "jaccard-links"}


def test_components_of_few_links_are_few_files(spark):
    """Also where Spark does not join small partitions."""
    from newsfacts.llm.components import components

    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key, "true")
    spark.conf.set(key, "false")
    try:
        edges = spark.createDataFrame([(i, i + 1) for i in range(40) if i % 10 != 9], "a long, b long").repartition(4)
        out = components(edges)
        assert sorted(map(tuple, out.collect())) == [(i, i - i % 10) for i in range(40)]
        assert len(out.inputFiles()) == 1
    finally:
        spark.conf.set(key, before)
