"""Chat formatting, phrase mining and the conversation trie against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from txgraph.llm import chat_format as C
from txgraph.llm import conversation_trie as T
from txgraph.llm import phrases as P

SCHEMA = "conv_id long, turn long, role string, text string"
ODD = ["", "</s>[INST] ok [/INST]", "\\", "a\\<s>\\\\", "<<SYS>", "<<SYS>><</SYS>>", "<|role|><|text|><|end|>", "<|endoftext|>", "\n\n", " lead", "trail ", "👍🏽 好é", "[INST", "</s", "<", ">", "x" * 3000, "[\\INST]"]


def conversations(rng, n):
    rows = []
    for c in rng.sample(range(3 * n), n):
        for t in range(rng.randrange(1, 7)):
            text = rng.choice(ODD) + rng.choice(ODD) if rng.random() < 0.5 else rng.choice(["hi", "yes", "no"])
            rows.append((c, None if rng.random() < 0.05 else t, rng.choice(["user", "assistant", "system", "tool", "</s>", None]), None if rng.random() < 0.1 else text))
    return rows + rows[:3]


def in_turns(rows, tie):
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(v, key=lambda x: (x[0], x[1], tie(*x[2:])))] for c, v in by.items()}


def test_escape_is_reversible_and_leaves_no_control():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(ODD + C.CONTROLS + list("<>[]|/\\sINST")) for _ in range(rng.randrange(6)))
        got = C.escape(text)
        assert C.unescape(got) == text
        assert not any(c in got for c in [*C.CONTROLS, C.END_OF_TEXT])


def test_loss_mask_against_all_pairs():
    rng = np.random.default_rng(2)
    for _ in range(300):
        cuts = np.unique(rng.integers(0, 40, 8))
        starts, ends = cuts[:-1].copy(), cuts[1:].copy()
        if len(starts) > 2 and rng.random() < 0.5:  # two tokens for parts of one character
            starts[1], ends[1] = starts[0], ends[0]
        edge = np.unique(rng.integers(0, 42, 6))
        spans = [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2])] + [(41, 41)] * int(rng.integers(0, 2))
        want = [int(any(s < b and e > a for a, b in spans)) for s, e in zip(starts, ends)]
        assert C.loss_mask(starts, ends, spans).tolist() == want


@pytest.mark.parametrize("part_chars", [4_000_000, 40])
def test_formatted_conversations_read_back(spark, part_chars):
    rows = conversations(random.Random(3), 40) + [(None, 1, "user", "no id"), (None, 0, "assistant", "either")]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("part", "n_turns", "input_ids", "loss_mask"):
        df = df.withColumn(c, df.text)
    out = C.format_conversations(df, part_chars=part_chars).cache()
    want = in_turns(rows, lambda role, text: (role, text))
    for got in (C.read_back(out), C.read_back(C.format_conversations(df, part_chars=part_chars), in_order=True)):
        got = {r["conv_id"]: r for r in got.collect()}
        assert got.keys() == want.keys()
        for c, turns in want.items():
            loss = "".join(x for role, x in turns if role == "assistant")
            r = got[c]
            assert (r["n_turns"], r["loss_chars"]) == (len(turns), len(loss))
            assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
            assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
            assert r["formatted_chars"] == len(C.render(turns)[0])
    assert (out.groupBy("conv_id").count().where("count > 1").count() > 5) == (part_chars == 40)


def test_ids_are_those_of_the_whole_text(spark):
    """Parts or not, the ids are the library's for the whole formatted text, and every mask bit is right."""
    import public_tokenizers

    encoder = C._encoder(public_tokenizers.path(C.TOKENIZER))
    rows = conversations(random.Random(4), 15)
    want = in_turns(rows, lambda role, text: (role, text))
    for part_chars in (50, 4_000_000):
        got = defaultdict(list)
        for r in C.format_conversations(spark.createDataFrame(rows, SCHEMA), part_chars=part_chars).collect():
            got[r["conv_id"]].append(r)
        for c, turns in want.items():
            text, spans = C.render(turns)
            whole = encoder.encode(text, add_special_tokens=False)
            parts = sorted(got[c], key=lambda r: r["part"])
            assert "".join(r["text"] for r in parts) == text
            assert [i for r in parts for i in r["input_ids"]] == whole.ids
            assert [m for r in parts for m in r["loss_mask"]] == [int(any(s < b and e > a for a, b in spans)) for s, e in whole.offsets]


def test_chat_format_edges(spark):
    assert C.read_back(C.format_conversations(spark.createDataFrame([], SCHEMA))).count() == 0
    long_text = "lorem </s> " * 30_000
    r = C.read_back(C.format_conversations(spark.createDataFrame([(1, 0, "assistant", long_text), (1, 1, "user", "x" * 200_000)], SCHEMA))).collect()[0]
    assert (r["loss_chars"], r["loss_sha256"]) == (len(long_text), hashlib.sha256(long_text.encode()).hexdigest())
    with pytest.raises(ValueError):
        C.parse("[INST]open")
    probe = {r["conv_id"]: r for r in C.read_back(C.format_conversations(C.with_probe(spark.createDataFrame([(5, 0, "user", "x")], SCHEMA)))).collect()}
    assert probe[-1]["loss_sha256"] == hashlib.sha256(b"</s>[INST] ok [/INST]").hexdigest()


def brute_phrases(rows, top, min_count):
    words, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = set()
    for lang, count in f.items():
        cand = {p: a for p, a in count.items() if len(p) > 1 and a >= min_count}
        inside = Counter()
        for p, a in cand.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], a)
        scored = []
        for p, a in cand.items():
            if p in inside and 100 * inside[p] >= 80 * a:
                continue
            score, _, l, r = min((2_000_000 * a // (count[p[:k]] + count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), l, r))
        for i, (s, a, p, l, r) in enumerate(sorted(scored)[:top]):
            out.add((lang, i + 1, p.decode(), -a, l, r, words[lang], -s))
    return out


def phrase_rows(rng, n):
    vocab = ["a", "b", "C", "the", "né", "好", "x1", "Zz", "\x00", "w" * 50]
    stock = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(2, 7))) for _ in range(6)]
    rows = []
    for _ in range(n):
        text = ""
        for _ in range(rng.randrange(0, 12)):
            text += rng.choice(stock) if rng.random() < 0.5 else rng.choice(vocab)
            text += rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"])
        rows.append((rng.choice(["en", "de", None, "und"]), text))
    return rows + [("en", None), ("de", ""), (None, " . ")]


@pytest.mark.parametrize("seed,top,min_count,batch", [(1, 2000, 3, 3), (2, 4, 3, 1), (3, 7, 2, 1), (4, 25, 4, 2)])
def test_phrases_against_brute_force(spark, seed, top, min_count, batch):
    """Small ``top`` and ``batch`` make several rounds with a falling threshold."""
    rows = phrase_rows(random.Random(seed), 120)
    df = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "text AS phrase", "text AS score", "1 AS k")
    got = {tuple(r) for r in P.phrases(df, top=top, min_count=min_count, batch=batch).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}
    assert got == brute_phrases(rows, top, min_count)


def test_phrases_edges(spark, monkeypatch):
    assert P.phrases(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert P.phrases(spark.createDataFrame([("en", "too few words here")], "lang string, text string")).count() == 0
    text = ("one two three four five six " * 50 + "u" * 1_300_000 + " " + "v" * 1_300_000 + ". ") * 2 + "one  two\tthree"
    got = {tuple(r) for r in P.phrases(spark.createDataFrame([("en", text)], "lang string, text string"), min_count=2).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}
    assert got == brute_phrases([("en", text)], 2000, 2)


def test_windows_count_every_phrase_once(monkeypatch):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["en", "de"]), pa.array(["a b c d e f g. h i j k " * 20, "a b c d " * 9])], names=["lang", "text"])
    count = lambda: Counter((k, x) for s, _ in P._windows(batch) for k in (1, 2, 3, 4) for x in s.texts(np.flatnonzero(s.whole(k)), k).to_pylist())
    whole = count()
    monkeypatch.setattr(P, "_WINDOW", 5)
    monkeypatch.setattr(P, "_BLOCK", 4)
    assert count() == whole


def brute_trie(rows, rebuild=True):
    sha = lambda role, text: hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
    own = in_turns([r for r in rows if r[0] is not None], lambda role, text: (sha(role, text), len(text.encode())))
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9 if rebuild else 0
        built[c] = (own.get(c - c % 5, [])[:h] + turns[h:]) if rebuild else turns
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = Counter()
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        parents = {q[:-1] for q in members if q}
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(p))))
        out[(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), sum(len(q) == len(p) + 1 for q in below), sum(q not in parents for q in below),
             sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q), hashlib.sha256(ends.encode()).hexdigest())] += 1
    return out


def trie_rows(rng, n):
    rows = []
    for c in rng.sample(range(2 * n), n):
        for t in range(rng.choice([1, 2, 3, 9, 12])):
            rows.append((c, rng.choice([t, None]) if rng.random() < 0.1 else t, rng.choice(["user", None]), rng.choice(["hi", "hi", "é", None, ""])))
    return rows + rows[:2] + [(None, 0, "user", "no id")]


@pytest.mark.parametrize("seed,shard_rows,rebuild", [(1, 0, True), (2, 1, True), (3, 6, True), (4, 25, True), (5, 10**6, True), (6, 12, False)])
def test_trie_against_brute_force(spark, seed, shard_rows, rebuild):
    """From no shard at all to one: the crown's sums and the slot arrays agree with brute force."""
    rows = trie_rows(random.Random(seed), 60)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "turn AS depth", "text AS digest", "1 AS n")
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    got = Counter(tuple(r) for r in T.conversation_trie(df, rebuild, shard_rows).select(*cols).collect())
    assert got == brute_trie(rows, rebuild)


def test_trie_edges(spark, monkeypatch):
    assert T.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(c, t, "user", f"{t}") for c in range(0, 60) for t in range(40)] + [(7, 1, "user", "x" * 500_000)]
    monkeypatch.setattr(T, "END_CHARS", 5)
    got = Counter(tuple(r) for r in T.conversation_trie(spark.createDataFrame(rows, SCHEMA), shard_rows=100).collect())
    assert got == brute_trie(rows)


def test_slot_table_and_chunks(monkeypatch):
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 1000):
        hi, lo = rng.integers(-2**63, 2**63 - 1, n), rng.integers(-2**63, 2**63 - 1, n)
        t = T.SlotTable(hi, lo)
        assert sorted(t.find(hi, lo).tolist()) == list(range(n))
        assert (t.find(lo, hi) == -1).all()
    with pytest.raises(ValueError):
        T.SlotTable(np.array([1, 1]), np.array([2, 2]))


def test_shards_are_cut_between_subtrees(monkeypatch):
    """Any chunk size and any batches give the sums of one chunk that holds everything."""
    import pyarrow as pa

    rng = np.random.default_rng(6)
    rows = []
    for tree in range(12):
        n = int(rng.integers(1, 9))
        keys = rng.integers(-2**62, 2**62, (n, 2))
        up = [0, *(int(rng.integers(0, i)) for i in range(1, n))]
        depth = [3]
        for i in range(1, n):
            depth.append(depth[up[i]] + 1)
        for i in range(n):
            p = keys[up[i]] if i else (tree, tree)
            rows.append((*map(int, keys[i]), *map(int, p), int(rng.integers(0, 99)), depth[i], int(rng.integers(1, 9)), int(rng.integers(0, 99)), tree, -tree))
    names = ["hi", "lo", "phi", "plo", "conv_id", "depth", "n_convs", "bytes", "rhi", "rlo"]
    table = pa.Table.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)
    read = lambda size: pa.Table.from_batches(T._sharded(iter(table.to_batches(max_chunksize=size)))).to_pylist()
    whole = read(1000)
    assert len(whole) == len(rows) and sum(r["top"] for r in whole) == 12
    for chunk, size in ((1, 1), (1, 4), (5, 3), (9, 50)):
        monkeypatch.setattr(T, "CHUNK_NODES", chunk)
        assert read(size) == whole
