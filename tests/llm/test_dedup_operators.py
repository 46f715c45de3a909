"""SimHash, suffix and embedding dedup, components and the pipeline against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import embedding_dedup, simhash, suffix_dedup
from tessera.llm._graph import connected_components

SF = "/root/testdata/sf0.001"


def components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def smallest(ids, roots):
    least = {}
    for i, r in zip(ids, roots):
        known = [x for x in (least.get(r), i) if x is not None]
        least[r] = min(known) if known else None
    return [least[r] for r in roots]


def fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or ""))
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (300, 301), (301, 300)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert all(found[i] == 0 for i in range(41)) and all(found[100 + i] == 100 for i in range(30)) and found[301] == 300
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_simhash_on_odd_rows(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(5, base), (3, base.replace("w7 ", "W7  ")), (9, base), (9, base), (None, base), (None, "alone it stands"), (None, "x"), (4, None), (2, ""), (8, "one two"), (1, "Ü É a b c"), (6, base.replace("w150", "changed"))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fp": F.lit(1), "root": F.lit(2), "_id": F.lit(0), "component_id": F.lit(0)})
    found = simhash.near_duplicates(df).collect()
    prints = [fingerprint(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    want = Counter(zip((r[0] for r in rows), prints, smallest([r[0] for r in rows], components(len(rows), links))))
    assert Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in found) == want
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert kept.count() == len(set(components(len(rows), links)))
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.keep_one(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [8, 512])
def test_simhash_dense_groups(spark, block):
    rng = np.random.default_rng(3)
    prints = set(rng.integers(0, 2**63, 50).tolist())
    centre = next(iter(prints))
    for _ in range(150):
        x = centre
        for i in rng.integers(0, 62, rng.integers(1, 4)):
            x ^= 1 << int(i)
        prints.add(x)
    f = sorted(prints)
    df = spark.createDataFrame([(x,) for x in f], "fp long")
    got = {r.node: r.root for r in connected_components(simhash.linked_pairs(df, block=block), "a", "b").collect()}
    want = components(len(f), [(i, j) for i in range(len(f)) for j in range(i) if (f[i] ^ f[j]).bit_count() <= 3])
    assert [got.get(x, x) for x in f] == [f[r] for r in want]


def removal(texts, length, min_words=0):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        for m in re.finditer(rb"\x01+", bytes(gone)) if min_words else ():
            if len(d[m.start() : m.end()].split()) < min_words:
                gone[m.start() : m.end()] = bytes(m.end() - m.start())
        spans = sum(1 for i in range(len(gone)) if gone[i] and not (i and gone[i - 1]))
        out.append((len(d), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(d, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("most_classes", [1, 400])
def test_suffix_removal_equals_brute_force(spark, most_classes):
    random.seed(4)
    word = lambda: "".join(random.choice("abcdeé") for _ in range(random.randrange(1, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(40) for _ in range(3)]
    docs = []
    for i in range(60):
        a = text(random.randrange(0, 60))
        if i % 2:
            a += " " + random.choice(shared) + " " + text(20)
        docs.append(a + a if i % 5 == 0 else a)
    docs += [docs[3]] * 3 + [None, "", "a" * 500, "ab" * 400, "a" * 64, "b" * 65, docs[11][:80] + "X" + docs[11][81:]]
    rows = [(None if i in (2, 5) else i, t) for i, t in enumerate(docs)] + [(7, docs[7])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"th": F.lit(1), "z": F.lit(2), "_id": F.lit(3), "anchor": F.lit(4), "spans": F.lit(5)})
    got = suffix_dedup.removal_digest(df, length=64, most_classes=most_classes).collect()
    want = Counter((i, *w) for (i, _), w in zip(rows, removal([t for _, t in rows], 64)))
    assert Counter(map(tuple, got)) == want
    assert suffix_dedup.removal_digest(df.limit(0)).count() == 0


def test_suffix_removal_of_periodic_and_shared_texts(spark):
    """A long periodic text, and one passage in a third of all texts with a context of its own in each."""
    random.seed(8)
    letters = lambda n: "".join(random.choice("abcdefgh ") for _ in range(n))
    passage = letters(700)
    docs = ["ab" * 100_000, "abc" * 2_000, letters(900)] + [letters(random.randrange(20, 300)) + (passage if i % 3 == 0 else "") + letters(300) for i in range(300)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(7)
    for most_classes in (8, 400):
        got = suffix_dedup.removal_digest(df, most_classes=most_classes, kept_text=True).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == Counter((i, *w) for i, w in enumerate(removal(docs, 400)))
        assert all(hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256 for r in got)


def test_equal_runs_of_a_chunk_are_one_row(spark):
    df = spark.createDataFrame([(i, i, "ab" * 20_000) for i in range(3)], "doc_id long, th long, text string").coalesce(1)
    runs = suffix_dedup.window_runs(df, 400).collect()
    assert len(runs) < 50 and sum(r.copies * r.n for r in runs) == 3 * (40_000 - 399)
    assert all((r.docs is None) == (r.copies == 1) and (r.docs is None or len(r.docs) == r.copies - 1) for r in runs)


@pytest.mark.parametrize("length", [200])
def test_passages_of_fifty_words_go_and_shorter_ones_stay(spark, length):
    random.seed(9)
    word = lambda: "".join(random.choice("abcdefghij") for _ in range(random.randrange(3, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    wide, short = text(55), text(44)
    assert length <= len(short) < len(wide) < 400
    docs = [text(30) + "\n" + (wide if i % 2 else short) + "\n" + text(30) for i in range(8)] + [text(200)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    out = {r.doc_id: r.text for r in suffix_dedup.remove_repeats(df, length=length, min_words=50).collect()}
    for i, d in enumerate(docs[:8]):
        assert (wide in d) != (out[i] == d) and wide not in out[i]
    assert out[8] == docs[8]


def test_repeats_are_cut_from_texts(spark):
    passage = "é" * 10 + "".join(chr(97 + i * 7 % 26) for i in range(500))
    df = spark.createDataFrame([(1, "one " + passage + " end"), (2, "two " + passage), (3, "clean text"), (4, None)], "doc_id long, text string").withColumn("spans", F.lit(1))
    out = {r.doc_id: r.text for r in suffix_dedup.remove_repeats(df).collect()}
    assert out[3] == "clean text" and out[4] is None and len(out[1]) < 12 and len(out[2]) < 8
    assert suffix_dedup.remove_repeats(df).columns == df.columns


def test_run_index_matches():
    rng = np.random.default_rng(5)
    buf = np.concatenate([rng.integers(97, 100, 300), [255], rng.integers(97, 99, 200), [255]]).astype(np.uint8)
    got = suffix_dedup.RunIndex(buf, 600).matching_statistics()
    b = buf.tobytes()
    for i in range(len(b)):
        best = 0
        for j in range(len(b)):
            if i != j:
                k = 0
                while max(i, j) + k < len(b) and b[i + k] == b[j + k]:
                    k += 1
                best = max(best, k)
        assert got[i] == best


@pytest.mark.parametrize("block", [16, 1024])
def test_embedding_links(spark, block):
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((40, 16))
    x = np.concatenate([centres, centres[0] + 0.05 * rng.standard_normal((60, 16)), centres[1] + 0.3 * rng.standard_normal((20, 16)), centres[2:4]])
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]
    rows += [(500, None), (501, []), (502, [0.0] * 16), (503, [float("nan")] + [1.0] * 15), (504, [None] + [1.0] * 15), (505, [float("inf")] + [1.0] * 15), (506, [1.0] * 5), (None, rows[9][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"x": F.lit(1), "key": F.lit(2), "node": F.lit(3), "n": F.lit(4), "label": F.lit(None).cast("int")})
    good = [k for k, (_, v) in enumerate(rows) if v and len(v) == 16 and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    u = np.array([rows[k][1] for k in good], np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    close = u @ u.T >= 0.9
    links = [(good[a], good[b]) for a, b in zip(*np.nonzero(close)) if a < b]
    roots = components(len(rows), links)
    degree = Counter(k for pair in links for k in pair)
    ids = [r[0] for r in rows]
    component = smallest(ids, roots)
    want = Counter((i, degree[k], c, i is not None and i == c) for k, (i, c) in enumerate(zip(ids, component)))
    got = embedding_dedup.link_components(df, block=block, recall=0.9999).collect()
    assert Counter(map(tuple, got)) == want
    assert embedding_dedup.link_components(df.limit(0)).count() == 0


def test_embedding_recall_at_default_parameters(spark):
    """Planted links at cosines of 0.90 to 0.95 among unrelated vectors: recall against brute force, and no link below 0.9."""
    rng = np.random.default_rng(21)
    x = rng.standard_normal((6_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(1_500):
        other = rng.standard_normal(64)
        other -= other @ x[i] * x[i]
        c = rng.uniform(0.9, 0.95)
        x[3_000 + i] = c * x[i] + np.sqrt(1 - c * c) * other / np.linalg.norm(other)
    x = x.astype(np.float32)
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    close = np.triu(u @ u.T >= 0.9, 1)
    links = list(zip(*np.nonzero(close)))
    degree = Counter(int(k) for pair in links for k in pair)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in embedding_dedup.link_components(df).collect()}
    assert all(got[i].n_links <= degree[i] for i in got)
    assert sum(r.n_links for r in got.values()) >= 0.95 * 2 * len(links) and len(links) > 1_000


def test_recall_is_calibrated():
    rounds = embedding_dedup.rounds_needed(0.9, 6, 2.0, 2, 0.95)
    rng = np.random.default_rng(1)
    a = rng.standard_normal((4000, 32))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((4000, 32))
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.9 * a + np.sqrt(1 - 0.81) * b / np.linalg.norm(b, axis=1, keepdims=True)
    p = embedding_dedup.Projections(32, 6, rounds)
    (ka, va), (kb, vb) = p.of(a), p.of(b)
    hits = ((ka == kb) & (abs(va - vb) <= 2.0 * np.sqrt(0.2))).sum(1) >= 2
    assert hits.mean() > 0.92


def test_pipeline_stages(spark):
    """Each stage on all that its predecessor kept, against plain versions of its decision."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "quality_rules", "simhash_dedup", "suffix_dedup", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = docs.toPandas()
        out = stage(spark, docs, SF)
        after = out.toPandas()
        if name != "packing":
            assert out.columns == docs.columns
            kept = before[before.doc_id.isin(after.doc_id)]
            assert len(after) == len(kept)
        if name == "simhash_dedup":
            p = [fingerprint(t) for t in before.text]
            roots = components(len(p), [(i, j) for i in range(len(p)) for j in range(i) if (p[i] ^ p[j]).bit_count() <= 3])
            assert sorted(after.doc_id) == sorted(set(smallest(before.doc_id.tolist(), roots)))
        if name == "suffix_dedup":
            want = dict(zip(before.doc_id, removal(before.text.tolist(), corpus_pipeline.PASSAGE_BYTES, corpus_pipeline.PASSAGE_WORDS)))
            # a cut inside a character takes the whole character
            assert all(abs(len(t.encode()) - (want[i][0] - want[i][1])) <= 6 * (want[i][2] + 1) and (want[i][1] or t == b) for i, t, b in zip(after.doc_id, after.text, after.doc_id.map(dict(zip(before.doc_id, before.text)))))
            assert (after.n_chars == after.text.str.len()).all()
        if name == "packing":
            assert after.piece_size.sum() == sum(len(t.encode()) for t in before.text)
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}"
        out.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)


def test_pipeline_stages_on_odd_rows(spark):
    """Ids that are no numbers, nulls, empty and repeated texts, names that clash: nothing fails and columns stay."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    names = docs.select(F.concat(F.lit("d-"), F.col("doc_id").cast("string")).alias("doc_id"), "text", "lang", "source", "n_chars")
    odd = spark.createDataFrame([(None, "a b"), ("x", None), ("x", ""), ("y", " \n"), ("y", " \n"), ("z", "word " * 5000), (None, "a b")], "doc_id string, text string")
    both = names.unionByName(odd, allowMissingColumns=True).select("*", F.lit(1).alias("row"), F.lit(2).alias("_id"), F.lit("t").alias("_th"), F.lit(3).alias("rules"), F.lit(4).alias("group"))
    stages = dict(corpus_pipeline.STAGES)
    for name in ("simhash_dedup", "suffix_dedup"):
        out = stages[name](spark, both, SF)
        assert out.columns == both.columns
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        assert "d-0" in ids and len(ids) > 30
    packed = stages["packing"](spark, both, SF)
    assert dict(packed.dtypes)["doc_id"] == "string" and packed.agg(F.sum("piece_size")).first()[0] == both.agg(F.sum(F.octet_length("text"))).first()[0]


def test_pipeline_on_no_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.isEmpty()
