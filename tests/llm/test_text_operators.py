"""Quality rules, classifier, sharding, packing and tokenizer on odd rows, against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, packing, quality_classifier, quality_rules, sharding
from tessera.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
ODD = [(1, "the cat sat on the mat\nthe cat sat on the mat\n"), (2, None), (3, ""), (None, "a b c a b c\n\n \t x"), (1, "the cat sat on the mat\nthe cat sat on the mat\n"), (4, "ü&é " * 40 + "\x0bz\x1fq"), (5, "word " * 30_000), (6, " \n\t")]
KIND = "doc_id long, text string"


@pytest.fixture
def odd(spark):
    """Odd rows with further columns whose names clash with working columns."""
    return spark.createDataFrame(ODD, KIND).withColumns({"rules": F.lit(1), "quality_score": F.lit("x"), "_id": F.lit(2), "_text": F.lit("t"), "score": F.lit(0), "n": F.lit(9), "key": F.lit(3), "z": F.lit(4)})


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 0), (4, 0, 0), (5, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")


def base_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    count, covered = Counter(zip(words, words[1:], words[2:])), set()
    for i in range(len(words) - 2):
        if count[tuple(words[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_rules_count_as_brute_force(spark, odd, labels):
    ratio = quality_rules.fit_ratio(odd, labels)
    rows = quality_rules.apply_rules(odd, ratio).select("doc_id", "text", "rules.*").collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert base_counts(r.text) == tuple(r[k] for k in quality_rules.BASE)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_rules_without_labels_or_rows(spark, odd, labels):
    none = labels.limit(0)
    ratio = quality_rules.fit_ratio(odd, none)
    assert not ratio.any()
    assert quality_rules.fit_ratio(odd.limit(0), labels).shape == ratio.shape
    assert quality_rules.apply_rules(odd.limit(0), ratio).count() == 0


def test_rules_reject_junk_and_keep_clean(spark):
    rows = QUERIES["op2_quality_rules"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("not base_failed").toPandas()
    assert rows[rows.quality == 1].kept.all()


def test_rules_do_not_hang_on_the_label_count(spark):
    """Junk among many unlabelled texts is rejected with few labels too, and clean texts stay."""
    rng = np.random.default_rng(5)
    clean, junk = ([f"{kind}{i}" for i in range(300)] for kind in "cj")
    text = lambda words: " ".join(rng.choice(words, 200))
    docs = spark.createDataFrame([(i, text(clean) if i % 5 else text(junk)) for i in range(1_000)], KIND).cache()
    for n in (20, 200, 800):
        good = [i for i in range(1_000) if i % 5][:n]
        labels = spark.createDataFrame([(i, 1, 0) for i in good], "doc_id long, quality int, toxic int")
        rows = quality_rules.apply_rules(docs, quality_rules.fit_ratio(docs, labels)).select("doc_id", "rules.kept").collect()
        assert not any(r.kept for r in rows if r.doc_id % 5 == 0)
        assert np.mean([r.kept for r in rows if r.doc_id % 5]) > 0.95


def test_rules_count_every_trusted_document(spark):
    """A trusted set of over 20,000 ids takes part whole."""
    ids = spark.range(25_000)
    labels = ids.selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    assert quality_rules.trusted_ids(labels).count() == 25_000


def test_classifier_on_odd_rows(spark, odd, labels):
    model = quality_classifier.fit(odd, labels)
    out = quality_classifier.classify(odd, model).select("doc_id", "text", "quality_score.*").collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert len({r.score for r in out if not (r.text or "").strip()}) == 1
    empty = quality_classifier.fit(odd, labels.limit(0))
    assert {r.score for r in quality_classifier.classify(odd, empty).select("quality_score.score").collect()} == {0.5}
    assert quality_classifier.classify(odd.limit(0), model).count() == 0


def test_classifier_held_out(spark):
    out = QUERIES["op5_quality_classifier"](spark, "/root/testdata/sf0.01").toPandas()
    assert ((np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id])) == out.held_out).all()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    held = out[out.held_out].merge(labels, on="doc_id")
    assert (held.predicted == held.quality).mean() > 0.85


def test_fit_is_bounded_in_bytes(spark, odd):
    docs = spark.createDataFrame([(i, f"alpha{i} beta gamma " * 50 if i % 2 else f"junk{i} x y") for i in range(1, 200)] + [(7, "another text of an id")], KIND)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 200)], "doc_id long, quality int, toxic int")
    rows = lambda most: quality_classifier.training_rows(docs, labels, "text", "doc_id", 500, most)
    every = rows(1 << 20)
    assert len(every) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(1, 200))
    some = rows(2_000)
    assert 0 < len(some) < len(every) and sum(4 * len(f) for f, _ in some) <= 2_000
    assert rows(0) == []


def test_fit_reads_no_held_out_label(spark, labels):
    ids = [r.doc_id for r in quality_classifier.training_ids(labels, 100).collect()]
    assert all(zlib.crc32(str(i).encode()) % 5 for i in ids)


def test_permutation_is_a_bijection():
    for n in (1, 2, 3, 4, 5, 17, 64, 1000):
        p, rows = sharding.Permutation(n, 5), np.arange(n)
        assert sorted(p.place(rows)) == rows.tolist()
        assert (p.row(p.place(rows)) == rows).all()


def test_shards_on_odd_rows(spark, odd):
    out = sharding.assign_shards(odd, n_shards=3).toPandas()
    assert len(out) == len(ODD) and sorted(out.row_number) == list(range(len(ODD)))
    per = out.groupby("shard").slot
    assert per.count().max() - per.count().min() <= 1 and all(sorted(s) == list(range(len(s))) for _, s in per)
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in ODD)
    assert Counter((None if i != i else int(i), s, c) for i, s, c in zip(out.doc_id, out["size"], out.text_crc32)) == want
    assert sharding.assign_shards(odd.limit(0)).count() == 0


def test_written_shards_hold_every_row(spark, tmp_path):
    df = spark.createDataFrame([(i % 5, f"text {i % 7}") for i in range(40)], KIND)
    sharding.write_shards(df, str(tmp_path / "shards"), n_shards=4)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == 40 and Counter(map(tuple, back.select("doc_id", "text").collect())) == Counter(map(tuple, df.collect()))
    assert [r["count"] for r in back.groupBy("_shard").count().collect()] == [10] * 4


def test_packing_is_complete_and_fits(spark, odd):
    out = packing.best_fit(odd, lengths=(64, 256, 1024), group_pieces=3).toPandas()
    for _, b in out.groupby("bin_id"):
        b = b.sort_values(["bin_offset", "piece_size"])
        ends = b.bin_offset + b.piece_size
        assert (b.bin_offset.iloc[1:].to_numpy() >= ends.iloc[:-1].to_numpy()).all() and ends.max() <= b.bin_length.iloc[0]
        assert b.bin_length.iloc[0] == min(x for x in (64, 256, 1024) if x >= ends.max())
    assert out.piece_size.sum() == sum(len((t or "").encode()) for _, t in ODD)
    assert packing.best_fit(odd.limit(0)).count() == 0


def test_packing_does_not_depend_on_partitions(spark):
    rows = [(i % 7 if i % 5 else None, "x" * (i % 90)) for i in range(600)]
    made = []
    for parts in (1, 9):
        df = spark.createDataFrame(rows, KIND).repartition(parts)
        made.append(Counter(map(tuple, packing.best_fit(df, lengths=(64, 256), group_pieces=50).collect())))
    assert made[0] == made[1] and made[0].total() == 600 + sum(i % 90 > 0 and -(-(i % 90) // 256) > 1 for i in range(600))


def test_trial_fill_takes_what_a_plain_loop_takes():
    rng = np.random.default_rng(8)
    for _ in range(300):
        sizes = sorted(map(int, rng.integers(0, 40, int(rng.integers(1, 60)))), reverse=True)
        upto = [0, *np.cumsum(sizes).tolist()]
        at, room = int(rng.integers(0, len(sizes))), int(rng.integers(0, 200))
        left = room
        for x in sizes[at:]:
            left -= x if x <= left else 0
        assert packing.trial_fill(upto, [-x for x in sizes], at, room) == room - left


def smallest_fit(sizes, lengths):
    """Room taken by best fit that always opens the smallest length that holds the piece."""
    bins = []
    for size in sizes:
        fits = [b for b in bins if b[0] - b[1] >= size]
        if fits:
            min(fits, key=lambda b: b[0] - b[1])[1] += size
        else:
            bins.append([min(x for x in lengths if x >= size), size])
    return sum(min(x for x in lengths if x >= used) for _, used in bins)


def least_room(sizes, lengths):
    """Least room of any packing, by trying all partitions."""
    if not sizes:
        return 0
    first, rest = sizes[0], sizes[1:]
    best = None
    for mask in range(1 << len(rest)):
        used = first + sum(x for i, x in enumerate(rest) if mask >> i & 1)
        if used <= max(lengths):
            room = min(x for x in lengths if x >= used) + least_room([x for i, x in enumerate(rest) if not mask >> i & 1], lengths)
            best = room if best is None else min(best, room)
    return best


def test_lengths_are_chosen_jointly():
    """Longer bins are opened where the pieces to come fill them, shorter ones where they do not."""
    assert packing.pack([600] * 4, (700, 1200))[2].tolist() == [1200, 1200]
    assert packing.pack([600] * 3, (700, 1200))[2].tolist() == [1200, 700]
    assert packing.pack([700] * 3, (700, 1200))[2].tolist() == [700] * 3
    rng = np.random.default_rng(4)
    own = plain = best = 0
    for _ in range(150):
        lengths = tuple(sorted(rng.choice(np.arange(20, 120), 3, replace=False).tolist()))
        sizes = sorted(rng.integers(1, max(lengths) + 1, rng.integers(1, 7)).tolist(), reverse=True)
        least, made = least_room(sizes, lengths), int(packing.pack(sizes, lengths)[2].sum())
        assert made >= least
        own, plain, best = own + made, plain + smallest_fit(sizes, lengths), best + least
    assert own < plain and own <= 1.06 * best


def test_bins_are_downsized_to_their_contents(monkeypatch):
    """Pieces that the trial counted on go to tighter bins; the length is cut to what the bin holds."""
    rng, opened, chosen = np.random.default_rng(6), [], packing.opened_length
    monkeypatch.setattr(packing, "opened_length", lambda *x: opened.append(chosen(*x)) or opened[-1])
    fewer = 0
    for _ in range(60):
        opened.clear()
        sizes = sorted(rng.integers(20, 400, 60).tolist(), reverse=True)
        bins, _, final = packing.pack(sizes, (300, 450, 700, 1000))
        used = np.bincount(bins, weights=sizes)
        assert all(f == min(x for x in (300, 450, 700, 1000) if x >= u) and f <= o for f, u, o in zip(final, used, opened))
        fewer += (final < np.array(opened)).sum()
    assert fewer > 0


def test_packing_wastes_little():
    sizes = sorted(np.random.default_rng(2).integers(1, 2000, 4000).tolist(), reverse=True)
    _, _, final = packing.pack(sizes, (512, 1024, 2048))
    assert sum(sizes) / final.sum() > 0.98


def test_tokenizer_equals_the_library(spark, odd, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    library, own = Tokenizer.from_file(path), bpe.Encoder(bpe.compile_automaton(path))
    rng = np.random.default_rng(3)
    bits = ["a", "aa", "CC", "CCE", "é", "日本", "  ", "\n", "<|endoftext|>", "'ll", "12", "🙂", "the", " the", "\x00", "ab"]
    extra = ["".join(rng.choice(bits, rng.integers(0, 30))) for _ in range(1500)] + ["a" * k for k in range(1, 200)] + [" quellll", "VBLCCCCE", "x" * 50_000]
    for text, want in zip(extra, library.encode_batch(extra, add_special_tokens=False)):
        ids = own.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == want.ids
        assert own.decode(ids) == library.decode(want.ids, skip_special_tokens=False)
    alone = [own.encode(text) for text in extra]
    for chars, words in ((1_000_000, 250_000), (100, 40)):  # chunks of a text or two, words soon forgotten
        monkeypatch.setattr(bpe, "CHUNK_CHARS", chars)
        monkeypatch.setattr(bpe, "CACHE_WORDS", words)
        assert list(bpe.Encoder(own.automaton).encode_all(extra)) == alone
    monkeypatch.undo()
    assert [own.automaton.encode(w) for w in (b"VBLCCCCE", b"a" * 63)] == [np.frombuffer(x, "<u4").tolist() for x in own.automaton.encode_many([b"VBLCCCCE", b"a" * 63])]
    rows = odd.select("text", bpe.digests("text", path).alias("d"), bpe.decode(bpe.encode("text", path), path).alias("back")).collect()
    for r in rows:
        ids = np.array(library.encode(r.text or "", add_special_tokens=False).ids, "<u4")
        assert (r.d.n_tokens, r.d.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.back == (r.text or "") and r.d.decoded_sha256 == hashlib.sha256(r.back.encode()).hexdigest()
    assert odd.limit(0).select(bpe.digests("text", path)).count() == 0
