"""Near-duplicates, WARC, language id, quality classifier and the pipeline on small data."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from txgraph.llm import bpe, decontaminate, language_id, near_duplicates, quality_classifier, secrets, warc
from txgraph.llm import textkernel as K
from txgraph.session import scratch_dir, scratch_scope

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def lower_az(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def shingles(text, k):
    w = SPACE.findall(lower_az(text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(rows, k):
    sets = [(i, shingles(t, k)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[n + 1 :]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i, _ in sets}


def mutated(rng, words, share):
    return [rng.choice("pqrstuvwxyz") + str(rng.randint(0, 999)) if rng.random() < share else w for w in words]


@pytest.mark.parametrize("k,block,hub,hot", [(4, 2048, 512, 65536), (5, 7, 3, 1)])
def test_near_duplicates_against_brute_force(spark, monkeypatch, k, block, hub, hot):
    monkeypatch.setattr(near_duplicates, "HUB_BLOCK", hub)
    monkeypatch.setattr(near_duplicates, "HOT_CLASS", hot)
    rng = random.Random(k)
    texts = [None, "", "  ", "one two", "One TWO", "one two three four five six", "Ünï ç d e f g", "Ünï ç d e f g"]
    for _ in range(12):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(30, 150))]
        texts += [" ".join(mutated(rng, base, s)) for s in (0, 0, 0.005, 0.01, 0.02, 0.03, 0.05, 0.1)]
    shared = " ".join(f"common{i}" for i in range(60))
    texts += [shared + " " + " ".join(f"u{n}x{i}" for i in range(rng.randint(20, 90))) for n in range(60)]
    base = [f"v{i}" for i in range(120)]
    texts += [" ".join(mutated(rng, base, rng.choice([0.005, 0.01, 0.015, 0.02, 0.04]))) for _ in range(80)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(3 * i + 1, texts[t]) for i, t in enumerate(order)]
    repeated = rows + [rows[5], (None, texts[-1]), (None, None)]
    df = spark.createDataFrame(repeated, "doc_id long, text string").withColumn("component_id", K_lit(7))
    got = near_duplicates.near_duplicates(df, words=k, block=block).collect()
    want = brute_components(rows, k)
    assert len(got) == len(repeated)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == want[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])
            assert r["n_shingles"] == len(shingles(dict(rows)[r["doc_id"]], k))
    kept = near_duplicates.drop_near_duplicates(df, words=k).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted({i for i, c in want.items() if i == c})
    assert sum(r["doc_id"] is None for r in kept) == 2
    assert near_duplicates.near_duplicates(df.limit(0)).count() == 0


def test_tables_of_a_round_are_removed(spark):
    """Sets, pairs and blocks of a round go when its links are written; a scope around them takes what stays."""
    words = [f"w{i}" for i in range(60)]
    df = spark.createDataFrame([(i, " ".join(words[: 58 + i % 3])) for i in range(9)], "doc_id long, text string")
    with scratch_scope(spark) as paths:
        got = near_duplicates.near_duplicates(df).select("component_id").distinct().collect()
        left = [os.path.basename(p).rpartition("-")[0] for p in paths]
        assert [r[0] for r in got] == [0] and left.count("near-links") == 4
        assert not {"near-sets", "near-dealt", "near-pairs", "near-nodes", "near-mixed", "near-small"} & set(left)
        here = os.listdir(scratch_dir(spark).replace("file:", ""))
        assert all(os.path.basename(p) in here for p in paths)
    assert not {os.path.basename(p) for p in paths} & set(os.listdir(scratch_dir(spark).replace("file:", "")))


def K_lit(v):
    from pyspark.sql import functions as F

    return F.lit(v)


def test_pairs_confirmed_by_blocks_of_a_hub(spark, monkeypatch):
    """Every pair is judged once whatever the block size; an id of several texts by any of them."""
    monkeypatch.setattr(near_duplicates, "HUB_BLOCK", 4)
    rng = random.Random(9)
    base = [f"v{i}" for i in range(100)]
    texts = [(i, " ".join(mutated(rng, base, rng.choice([0.0, 0.01, 0.02, 0.04])))) for i in range(40)]
    texts += [(7, "an other text of the same id"), (50, "an other text of the same id"), (50, " ".join(base)), (51, "an other text of the same id")]
    pairs = [(0, i) for i in range(1, 40)] + [(i, 39) for i in range(1, 39)] + [(7, 50), (7, 51), (50, 51)]
    sets: dict[int, list] = {}
    for i, t in texts:
        sets.setdefault(i, []).append(shingles(t, 5))
    want = {(a, b) for a, b in pairs if any(100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b])}
    docs = spark.createDataFrame(texts + texts[:3], "doc_id long, text string")
    got = near_duplicates._confirmed(spark.createDataFrame(pairs, "a long, b long"), docs, 5, 80).collect()
    assert 0 < len(want) < len(pairs)
    assert sorted((r["a"], r["b"]) for r in got) == sorted(want)


def test_components_of_chains(spark):
    n = 200
    rng = random.Random(1)
    names = rng.sample(range(1000), n)
    edges = [(names[i], names[i + 1]) for i in range(n - 1) if i % 50 != 49]
    df = spark.createDataFrame([(min(e), max(e)) for e in edges], "a long, b long")
    got = {r["node"]: r["component"] for r in near_duplicates.components(df).collect()}
    for i in range(n):
        assert got[names[i]] == min(names[i // 50 * 50 : i // 50 * 50 + 50])


def test_bucket_keys_meet_within_the_threshold():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 65536, (400, near_duplicates.INDEXED), dtype=np.uint16)
    b = a.copy()
    for row in b:  # as many errors as the threshold allows, in any places
        row[rng.choice(near_duplicates.INDEXED, near_duplicates.INDEX_DISTANCE, replace=False)] += 1
    pad = np.zeros((400, near_duplicates.SYMBOLS - near_duplicates.INDEXED), np.uint8)
    keys = [near_duplicates.bucket_keys(np.hstack([x.view(np.uint8).reshape(400, -1), pad])).reshape(400, -1) for x in (a, b)]
    assert (keys[0] == keys[1]).any(axis=1).all()


PAGES = [(1, "http://a/x y", "<p>" + "one" * 60), (2, "http://b", "<p>" + "one" * 60), (0, None, "<p>" + "one" * 60), (3, "u", "short"), (4, "u", "short"), (5, "u\r\nEvil: 1", None),
         (6, "ü", "ünï" * 50), (None, "n", "ünï" * 50), (7, "u", "\x1f\x8b\x08 magic WARC/1.1 \r\n\r\n" * 20), (None, "m", "alone" * 40), (2, "http://b", "<p>" + "one" * 60)]


def test_warc_round_trip(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", K_lit("clash"))
    got = warc.warc_round_trip(df.repartition(3)).collect()
    first = {"<p>" + "one" * 60: 0, "ünï" * 50: 6}
    want = []
    for i, _, h in PAGES:
        raw = (h or "").encode()
        f = first.get(h)
        refers = f if f is not None and i != f else None
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "response" if refers is None else "revisit", refers))
    key = lambda r: tuple((x is None, x or 0) for x in r[:1]) + tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert warc.warc_round_trip(df.limit(0)).count() == 0


@pytest.mark.parametrize("step", [1, 13, 4096, 1 << 30])
def test_ranges_own_each_record_once(step):
    from io import BytesIO

    rng = random.Random(4)
    records, parts = [], []
    for n in range(40):
        payload = bytes(rng.randrange(256) for _ in range(rng.choice([0, 5, 300]))) + b"\x1f\x8b\x08" * 3
        raw = warc.record_bytes(str(n), "u", payload, hashlib.sha256(payload).hexdigest(), None)
        records.append(raw)
        parts.append(warc._member(raw) + (warc._member(b"") if n % 7 == 0 else b""))
    data = b"".join(parts)

    class File:
        def size(self):
            return len(data)

        def read_at(self, n, at):
            return data[at : at + n]

    assert BytesIO  # plain bytes are enough
    if step == 1:
        data = b"".join(parts[:4])
        records = records[:4]
    got = [r for at in range(0, len(data), step) for r in warc.range_records(File(), at, at + step)]
    assert got == records


def test_archives_are_plain_gzip_members(spark):
    import glob
    import gzip

    from txgraph.session import scratch_path

    path = scratch_path(spark, "warc-test")
    rows = [(1, "u", "a" * 500), (2, "u", "x" * (1 << 24))]  # the second needs an empty member
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(1), path)
    raw = b"".join(gzip.open(f).read() for f in glob.glob(path.removeprefix("file:") + "/part-*"))
    assert raw.count(b"WARC/1.1\r\n") == 2
    got = {r["record_id"]: r for r in warc.read_warc(spark, path, range_bytes=1000, with_payload=True).collect()}
    assert bytes(got["1"]["payload"]) == b"a" * 500 and len(got["2"]["payload"]) == 1 << 24


def test_language_id_learns_and_is_held_out(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    extra = spark.createDataFrame([(100_000, None, "en"), (100_001, "", "en"), (100_002, "123 !!", "de"), (None, "the the and", None), (100_003, "w" * 3000, None)], "doc_id long, text string, lang string")
    docs = df.select("doc_id", "text", "lang").unionByName(extra).withColumn("score", K_lit(1))
    got = {r["doc_id"]: r for r in language_id.predict_language(docs).collect()}
    truth = {r["doc_id"]: r["lang"] for r in df.collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in truth)
    assert sum(got[i]["lang_pred"] == truth[i] for i in held) / len(held) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert [got[i]["lang_pred"] for i in (100_000, 100_001, 100_002)] == ["und"] * 3
    assert got[None]["lang_pred"] in ("en", "fr", "de", "es") and got[None]["held_out"] is False
    none = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert language_id.predict_language(none).first()["lang_pred"] == "und"
    assert language_id.predict_language(none.limit(0)).count() == 0


def test_forward_sums_all_segmentations():
    import public_tokenizers

    lattice = language_id.Lattice(public_tokenizers.path(language_id.MODEL))
    rng = np.random.default_rng(1)
    model = np.log(rng.dirichlet(np.ones(lattice.size), 2).T)
    model[0] = language_id.LOG_UNKNOWN

    def total(s, lang):
        if not s:
            return 1.0
        out = 0.0
        for j in range(1, len(s) + 1):
            p = lattice.ids.get(s[:j], 0)
            if p or (j == 1):
                out += np.exp(model[p, lang]) * total(s[j:], lang)
        return out

    words = ["hello", "a", "étré", "zz好q", "ing"]
    got = language_id.word_logs(lattice, words, model)
    assert np.allclose(got, [[np.log(total("▁" + w, g)) for g in (0, 1)] for w in words])
    one = language_id.expected_counts(lattice, ["hello"], np.array([1]), np.array([2]), model)
    lengths = np.array([0] + [len(p) for p in sorted(lattice.ids, key=lattice.ids.get)])
    assert np.isclose((one[:, 1] * lengths).sum(), 2 * len("▁hello")) and one[:, 0].sum() == 0


def test_similarity_under_the_buckets_reach_is_refused(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "a b d")], "doc_id long, text string")
    for f in (near_duplicates.near_duplicates, near_duplicates.drop_near_duplicates):
        with pytest.raises(ValueError, match="similarity 50"):
            f(df, similarity=50)


def test_word_scores_stay_finite_after_a_large_training_total():
    import public_tokenizers

    lattice = language_id.Lattice(public_tokenizers.path(language_id.MODEL))
    total = np.zeros((lattice.size, 2))
    total[lattice.ids["▁the"]] = 1e9
    model = np.log(total + language_id.SMOOTHING) - np.log((total + language_id.SMOOTHING).sum(axis=0))
    model[0] = language_id.LOG_UNKNOWN
    signs = [p for p in lattice.ids if len(p) == 1 and 0x4E00 <= ord(p) < 0xA000]
    run = "".join(signs[:48])

    def total_log(s, lang):
        sums = [0.0] + [-np.inf] * len(s)
        for end in range(1, len(s) + 1):
            for a in range(end):
                p = lattice.ids.get(s[a:end], 0)
                if p or end == a + 1:
                    sums[end] = np.logaddexp(sums[end], sums[a] + model[p, lang])
        return sums[-1]

    words = ["the", run, "hello", run[:45]]
    got = language_id.word_logs(lattice, words, model)
    assert np.isfinite(got).all()
    assert np.allclose(got, [[total_log("▁" + w, g) for g in (0, 1)] for w in words])
    counts = language_id.expected_counts(lattice, words, np.array([0, 1, 0, 1]), np.array([3, 2, 1, 4]), model)
    lengths = np.array([1] + [len(p) for p in sorted(lattice.ids, key=lattice.ids.get)])
    assert np.isfinite(counts).all()
    assert np.allclose((counts * lengths[:, None]).sum(axis=0), [3 * 4 + 6, 2 * 49 + 4 * 46])


def test_quality_classifier_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = {r["doc_id"]: r for r in quality_classifier.classify_quality(docs, labels).collect()}
    held = [r for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert sum(got[r["doc_id"]]["predicted"] == r["quality"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())


def test_quality_classifier_edges(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([None, "", "a b c", "x" * 5000])] + [(None, "q"), (2, "a b c")], "doc_id long, text string").withColumn("quality", K_lit(9))
    empty = spark.createDataFrame([], "doc_id long, quality int")
    one = spark.createDataFrame([(i, 1) for i in range(4)] + [(1, None), (None, 1)], "doc_id long, quality int")
    for labels, score in ((empty, 0.5), (one, 1.0)):
        got = quality_classifier.classify_quality(docs, labels).collect()
        assert len(got) == 6 and {r["score"] for r in got} == {score}
    assert quality_classifier.classify_quality(docs.limit(0), one).count() == 0
    assert quality_classifier.keep_quality(docs, one).count() == 6


def test_discriminant_equals_the_density_formula():
    rng = np.random.default_rng(2)
    d = 3
    factors = np.array([np.linalg.cholesky((lambda m: m @ m.T + np.eye(d))(rng.normal(size=(d, d)))) for _ in range(2)])
    m = quality_classifier.Discriminant(0.7, np.ones(d), rng.normal(size=(2, d)), factors)
    x = rng.normal(size=(20, d))

    def density(c):
        cov = factors[c] @ factors[c].T
        z = x - m.means[c]
        return np.exp(-0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z)) / np.sqrt(np.linalg.det(cov))

    want = 0.7 * density(1) / (0.7 * density(1) + 0.3 * density(0))
    assert np.allclose(m.score(x), want)


def test_text_ids_in_near_duplicates(spark):
    base = " ".join(f"w{k}" for k in range(60))
    near = base.replace("w59", "other")
    rows = [("b", base), ("a-10", near), ("a-9", "quite different words here"), (None, base), ("", ""), ("B", base + " x"), ("a-9", "quite different words here"), ("c", None)]
    df = spark.createDataFrame(rows, "doc_id string, text string").withColumn("number", K_lit(7)).withColumn("component", K_lit(1))
    got = sorted((str(r["doc_id"]), r["component_id"], r["kept"]) for r in near_duplicates.near_duplicates(df).collect())
    assert got == [("", "", True), ("B", "B", True), ("None", None, True), ("a-10", "B", False), ("a-9", "a-9", True), ("a-9", "a-9", True), ("b", "B", False), ("c", "c", True)]
    left = near_duplicates.drop_near_duplicates(df)
    assert left.columns == df.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in left.collect()) == [("", ""), ("B", base + " x"), ("None", base), ("a-9", "quite different words here"), ("c", None)]
    assert near_duplicates.near_duplicates(df.limit(0)).count() == 0


def test_rows_that_repeat_id_and_text_are_dropped_once(spark):
    rows = [(1, "one two three"), (1, "one two three"), (1, "four five six"), (1, None), (1, None), (2, "seven"), (None, "x"), (None, "x"), (3, "seven")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(str, near_duplicates.drop_near_duplicates(df).collect()))
    want = [(1, "four five six"), (1, None), (1, "one two three"), (2, "seven"), (None, "x"), (None, "x")]
    assert got == sorted(map(str, spark.createDataFrame(want, "doc_id long, text string").collect()))


def test_warc_ids_of_any_text(spark):
    html = "<html>" + "same page " * 20 + "</html>"
    ids = ["x>", "", None, "a b", "ü 好\r\nWARC-Type: x", "%41", "<urn:page:1>", "-5", "plain"]
    df = spark.createDataFrame([(i, f"http://h/{k}", html + (str(k) if k > 3 else "")) for k, i in enumerate(ids)], "page_id string, url string, html string")
    got = {r["page_id"]: r for r in warc.warc_round_trip(df).collect()}
    assert got.keys() == set(ids) and len(got) == len(ids)
    assert [got[i]["refers_to"] for i in ids[:4]] == ["", None, "", ""] and got[""]["record_type"] == "response"
    assert all(got[i]["record_type"] == "response" for i in ids[4:])


def test_pipeline_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    labels, bench = spark.read.parquet(f"{d}/labels.parquet"), spark.read.parquet(f"{d}/benchmark.parquet").collect()
    scored = quality_classifier.classify_quality(spark.read.parquet(f"{d}/documents.parquet"), labels).collect()
    left = {r["doc_id"]: docs[r["doc_id"]]["text"] for r in scored if r["predicted"]}
    comp = brute_components(sorted(left.items()), 5)
    left = {i: t for i, t in left.items() if comp[i] == i}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = set()
    for b in bench:
        g = word.findall(lower_az(b["text"]))
        windows |= {tuple(g[k : k + 10]) for k in range(max(1, len(g) - 9))} if g else set()
    sizes = {len(w) for w in windows}

    def clean(t):
        w = word.findall(lower_az(t))
        return not any(tuple(w[p : p + n]) in windows for n in sizes for p in range(len(w) - n + 1))

    left = {i: secrets._redacted(t) for i, t in left.items() if clean(t)}
    tok = bpe.load(__import__("public_tokenizers").path(bpe.MODEL))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, d).collect()}
    assert got.keys() == left.keys()
    for i, t in left.items():
        ids = tok.encode(t, add_special_tokens=False).ids
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())


def test_stages_on_odd_rows(spark):
    d = "/root/testdata/sf0.001"
    rows = [(1, None, "en", "s", 0), (2, "", None, None, None), (None, "a b c", "en", "s", 5), (3, "x " * 40_000, "en", "s", 80_000), (3, "x " * 40_000, "en", "s", 80_000)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("kept", K_lit(1))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, d).columns == odd.columns, name
        assert stage(spark, odd.limit(0), d).count() == 0, name
    assert corpus_pipeline.near_dedup(spark, odd, d).count() == 4
    assert decontaminate.decontaminate(odd, spark.read.parquet(f"{d}/benchmark.parquet")).count() == 5
    assert corpus_pipeline.tokens(spark, odd, d).count() == 5


def test_suffix_array_against_sorting():
    rng = random.Random(6)
    for _ in range(200):
        s = np.array([rng.randint(0, 3) for _ in range(rng.randint(1, 70))] + [99], dtype=np.uint64)
        order, levels = K.suffix_array(s)
        assert list(order) == sorted(range(len(s)), key=lambda i: list(s[i:]))
        lcp = K.adjacent_lcp(order, levels)
        for i, (a, b) in enumerate(zip(order[:-1], order[1:])):
            n = 0
            while max(a, b) + n < len(s) and s[a + n] == s[b + n]:
                n += 1
            assert lcp[i] == n


def test_word_slices():
    texts = ["Hello  wörld\nfoo", "", None, "x", " end ", "a" * 50]
    got = []
    for _, _, data, offs in K.slices(pa.array(texts), 8):
        starts, ends, bounds = K.words(data, offs, K.SPACE_WORD)
        words = [bytes(data[a:b]).decode() for a, b in zip(starts, ends)]
        got += [words[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
    assert got == [SPACE.findall(t or "") for t in texts]


def test_possible_pairs_keep_every_link():
    rng = np.random.default_rng(3)
    full = [np.unique(rng.integers(0, 60, rng.integers(1, 60))).astype(np.uint32) for _ in range(60)]
    sets = [None if k % 7 == 0 else x for k, x in enumerate(full)]
    for i in range(60):
        others = rng.permutation(60)[: i % 50]
        got = near_duplicates.possible(sets, i, others, 80)
        for j, yes in zip(others, got, strict=True):
            both = len(np.intersect1d(full[i], full[j]))
            linked = 100 * both >= 80 * (len(full[i]) + len(full[j]) - both)
            assert yes == (linked or sets[i] is None or sets[j] is None)


def brute_log(lattice, word, model):
    """Sum over all segmentations, one character after another."""
    text = "▁" + word
    alpha = [np.zeros(model.shape[1])] + [None] * len(text)
    for j in range(1, len(text) + 1):
        terms = []
        for i in range(max(0, j - 40), j):
            k = lattice.ids.get(text[i:j], 0 if j - i == 1 else None)
            if k is not None:
                terms.append(alpha[i] + model[k])
        alpha[j] = np.logaddexp.reduce(terms, axis=0)
    return alpha[-1]


def test_long_words_are_summed_whole(monkeypatch):
    """A run of 5,000 letters equals the brute-force sum, in one stretch or many, and so do its expected counts."""
    import public_tokenizers

    lattice = language_id.Lattice(public_tokenizers.path(language_id.MODEL))
    rng = np.random.default_rng(8)
    model = np.log(rng.dirichlet(np.full(lattice.size, 0.5), 2).T + 1e-9)
    model[0] = language_id.LOG_UNKNOWN
    letters = list("aeinrstdühß好слово")
    words = ["".join(rng.choice(letters, n)) for n in (5, 47, 48, 49, 81, 300, 5000)]
    want = np.array([brute_log(lattice, w, model) for w in words])
    assert np.allclose(language_id.word_logs(lattice, words, model), want, rtol=1e-9)
    lang, n = np.arange(len(words)) % 2, np.arange(1, len(words) + 1)
    counts = language_id.expected_counts(lattice, words, lang, n, model)
    chars = [sum(k * (len(w) + 1) for w, g, k in zip(words, lang, n) if g == x) for x in (0, 1)]
    assert np.allclose(lattice.lengths @ counts, chars)
    for stretch in (50, 64, 1000):
        monkeypatch.setattr(language_id, "STRETCH", stretch)
        assert np.allclose(language_id.word_logs(lattice, words, model), want, rtol=1e-9)
        assert np.allclose(language_id.expected_counts(lattice, words, lang, n, model), counts, atol=1e-9)


def test_only_letters_make_words(spark, monkeypatch):
    assert language_id.text_words("½ ² Ⅷ 12 _ x²y Straße") == ["x", "y", "straße"]
    rows = [(i, "the cat sat" if i % 2 else "der hund lief", "en" if i % 2 else "de") for i in range(1, 21)] + [(100, "½ ²", "en"), (101, "Ⅷ", None)]
    got = {r["doc_id"]: r for r in language_id.predict_language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[100]["lang_pred"] == got[101]["lang_pred"] == "und" and got[100]["score"] == 0
    assert all(got[i]["lang_pred"] == ("en" if i % 2 else "de") for i in range(1, 21))
    monkeypatch.setattr(language_id, "MAX_LANGS", 1)
    with pytest.raises(ValueError):
        language_id.predict_language(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_buckets_without_pairs_are_read_once(spark, monkeypatch):
    """Texts that share buckets by chance only: the first round reads them, later ones do not, and links stay."""
    read, residual = [], near_duplicates._residual

    def counted(buckets, *rest):
        read.append(buckets.count())
        return residual(buckets, *rest)

    monkeypatch.setattr(near_duplicates, "_residual", counted)
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) for _ in range(40)]
    # symbols of very few values: different texts meet, none is within the threshold of another
    keys = near_duplicates.bucket_keys
    monkeypatch.setattr(near_duplicates, "bucket_keys", lambda sig: keys(sig) % np.uint64(50))
    docs = spark.createDataFrame(list(enumerate([*texts, texts[0] + " one more"])), "doc_id long, text string")
    monkeypatch.setattr(near_duplicates, "_bucket_rows", lambda classes: spark.createDataFrame([(int(k), r["node"]) for r in classes.collect() for k in near_duplicates.bucket_keys(near_duplicates._symbols(pa.array([bytes(r["sig"])]))).ravel().view(np.int64)], "key long, node long"))
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates.near_duplicates(docs).collect()}
    assert got == {i: i % 40 for i in range(41)}
    assert len(read) == 3 and read[0] > 0 and read[1] < read[0] and read[2] <= read[1]


def test_bpe_dictionary_against_the_library():
    """Chunks, plain words and mixed ones, with and without room in the dictionary: ids, decoded texts and places."""
    import public_tokenizers

    path = public_tokenizers.path(bpe.MODEL)
    wide, narrow = bpe.WordCodec(path), bpe.WordCodec(path, dictionary=40)
    assert wide.letters is not None  # plain words go to the model
    decode = bpe.decoder_of(wide.tok)
    rng = random.Random(9)
    parts = list("abcxyzABCéàÿßÀÖµªº  \n\t\r\x85\xa0'.,;:!?<>|0123-_#") + ["'s", "<|endoftext|>", "\u0301", "é", "日", "ᄀ", "ᅡ", "😀", "the", "word", "can't", "\x00"]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(50)))
        ids = wide.tok.encode(text, add_special_tokens=False).ids
        for codec in (wide, narrow):
            assert codec.encode(text) == (np.array(ids, dtype="<u4").tobytes(), decode(ids))
            got, want = codec.tokens(text), bpe.Tokens.of(wide.tok, text, 0)
            assert all(np.array_equal(getattr(got, c), getattr(want, c)) for c in ("ids", "first"))
            assert np.array_equal(got.start, want.start) or not text.isascii()
            assert np.array_equal(got.end, want.end) or not text.isascii()


def test_bpe_words_of_letters_skip_the_pipeline(monkeypatch):
    """Words of small letters are not sent through normaliser and pre-tokenizer, and punctuation joins known words."""
    import public_tokenizers

    codec = bpe.WordCodec(public_tokenizers.path(bpe.MODEL))
    sent, tok = [], codec.tok

    class Spy:
        def encode_batch_fast(self, words, **kw):
            sent.extend(words)
            return tok.encode_batch_fast(words, **kw)

        def __getattr__(self, name):
            return getattr(tok, name)

    codec.tok = Spy()
    text = "plain words, été and plain. words"
    assert np.frombuffer(codec.encode(text)[0], "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids
    assert sorted(sent) == [",", "."]
