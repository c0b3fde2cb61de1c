"""Memory of the Python processes in which tasks run."""

import gc
import hashlib
import os
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from txgraph.llm import bpe, common, phrases, quality_classifier, secrets
from txgraph.llm import textkernel as K

DOCS = [(i, f"word {i} has a few words. And some more of {i % 3} kinds, such as these", "en", "web", 60) for i in range(40)]


@pytest.mark.parametrize("module, run", [
    (phrases, lambda docs, labels: phrases.phrases(docs, min_count=2)),
    (quality_classifier, lambda docs, labels: quality_classifier.keep_quality(docs, labels)),
    (secrets, lambda docs, labels: secrets.redact_secrets(docs)),
])
def test_tasks_return_memory(spark, monkeypatch, tmp_path, module, run):
    kept, folder = common.memory_returned, str(tmp_path)

    def noted(batches):
        yield from kept(batches)
        open(f"{folder}/returned", "w").close()

    monkeypatch.setattr(module, "memory_returned", noted)
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string, n_chars long")
    assert run(docs, spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")).collect()
    assert (tmp_path / "returned").exists()


def test_what_a_task_made_is_gone_at_its_end():
    class Held:
        alive = 0

        def __init__(self):
            self.me = self  # not freed without a collection
            Held.alive += 1

        def __del__(self):
            Held.alive -= 1

    def run():
        Held()
        yield 1

    gc.disable()
    try:
        assert list(common.memory_returned(run())) == [1]
        assert Held.alive == 0
    finally:
        gc.enable()


def traced(f):
    f()  # tables that are kept
    tracemalloc.start()
    f()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak


def test_words_and_phrases_take_a_few_bytes_a_byte():
    text = "some common words, in lines of a text with Capitals. " * 40_000
    data, offs = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)])
    assert traced(lambda: K.words(data, offs, K.SPACE_WORD)) < 9 * len(text)
    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([text])], names=["lang", "text"])
    assert traced(lambda: [s.hashes(2) for s, _ in phrases._windows(batch)]) < 24 * len(text)


def test_looked_up_is_the_table_at_each_byte():
    data = np.arange(256, dtype=np.uint8)[::-1].repeat(3)
    for table in (K.LOWER, K.SPACE_WORD, K.ALNUM_WORD):
        got = K.looked_up(table, data)
        assert got.dtype == table.dtype and (got == table[data]).all()
        assert len(K.looked_up(table, data[:0])) == 0


def test_null_texts_are_sliced_without_a_copy():
    texts = pa.array(["a text of some length " * 100, None, "", "end"] * 1000)
    before, got = pa.total_allocated_bytes(), []
    for a, b, data, offs in K.slices(texts, 1 << 16):
        assert pa.total_allocated_bytes() - before < texts.nbytes // 2
        got += [data[x:y].tobytes() for x, y in zip(offs, offs[1:])]
    assert got == [(t or "").encode() for t in texts.to_pylist()]


def test_bytes_under_a_null_are_no_text():
    whole = pa.array(["ab", "hidden", "c"])
    texts = pa.StringArray.from_buffers(3, *whole.buffers()[1:], pa.py_buffer(b"\x05"))
    assert texts.to_pylist() == ["ab", None, "c"]
    for part in (texts, texts.slice(1)):
        got = [data[x:y].tobytes() for _, _, data, offs in K.slices(part) for x, y in zip(offs, offs[1:])]
        assert got == [(t or "").encode() for t in part.to_pylist()]


def test_equal_keys_are_grouped_in_order():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64)[np.random.default_rng(2).integers(0, 700, 20_000)]
    before = keys.copy()
    order, new = K.dense_order(keys)
    assert (keys == before).all() and order.dtype == np.int64 and (np.sort(order) == np.arange(len(keys))).all()
    assert (np.diff(keys[order].astype(object)) >= 0).all() and new.sum() == len(np.unique(keys))


def test_tokens_of_pieces_take_few_bytes():
    codec = bpe.WordCodec(public_tokenizers.path(bpe.MODEL))
    text = " ".join(f"{a}{b}ing" for a in ("walk", "sing", "thank", "break") for b in ("", *"abcdefghijklmnopqrstuvwxyz")) + " Naïve-words, don't; x9y 中文 "
    codec.tokens(text[:20])  # what is made once
    tracemalloc.start()
    many = " ".join(f"{w}{i % 7}{w[::-1]}{i}" for i, w in enumerate(text.split() * 20))
    had = len(codec.placed)
    codec.tokens(many)
    held, new = tracemalloc.get_traced_memory()[0], len(codec.placed) - had
    tracemalloc.stop()
    assert new > 2000 and held < 300 * new
    got = codec.tokens(text)
    assert sum(map(len, got.packed())) < 8 * len(got)


@pytest.mark.parametrize("ids, gaps, lengths", [
    ([], [], []), ([0], [0], [0]), ([127, 128, 32767], [0, -1, 127], [1, 128, 2]), ([32768, 49151, 2**31 - 1], [-129, 0, 40_000], [32768, 1, 0]),
])
def test_packed_tokens_come_back(ids, gaps, lengths):
    end = 200 + np.cumsum(np.array(gaps, np.int64) + np.array(lengths, np.int64))
    first = np.arange(len(ids)) % 2 == 0
    t = bpe.Tokens(np.array(ids, "<u4"), end - np.array(lengths, np.int64), end, first)
    got = bpe.Tokens.unpacked(*bpe.Tokens(t.ids, t.start - 200, t.end - 200, first).packed(), 200)
    for c in bpe.Tokens.__slots__:
        a, b = getattr(got, c), getattr(t, c)
        assert a.dtype == b.dtype and a.tolist() == b.tolist()


def test_pieces_are_read_a_few_at_a_time():
    n = 40 * bpe.ROWS
    batch = pa.RecordBatch.from_arrays([pa.array([str(i // 2) for i in range(n)]), pa.array([i % 2 for i in range(n)]), pa.array(["some text " * 400] * n), pa.array([1] * n)], names=["key", "n", "text", "copies"])
    run = lambda: [(sorted(have), copies) for have, copies in bpe._groups(iter([batch]), "key")]
    assert run() == [([0, 1], 1)] * (n // 2)
    assert traced(run) < batch.nbytes // 8


def test_encoded_pieces_leave_a_task_a_few_at_a_time(spark, monkeypatch, tmp_path):
    kept, folder = bpe.memory_returned, str(tmp_path)

    def noted(batches):
        for k, b in enumerate(kept(batches)):
            if "gap" in b.schema.names:
                open(f"{folder}/{os.getpid()}-{k}-{b.num_rows}", "w").close()
            yield b

    monkeypatch.setattr(bpe, "memory_returned", noted)
    text = "a few words of a text " * 400
    got = bpe.bpe_round_trip(spark.createDataFrame([(1, text)], "doc_id long, text string"), piece_chars=20).first()
    ids = bpe.load(public_tokenizers.path(bpe.MODEL)).encode(text, add_special_tokens=False).ids
    assert got["n_tokens"] == len(ids) and got["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    sizes = [int(p.name.split("-")[-1]) for p in tmp_path.iterdir()]
    assert sizes and max(sizes) <= bpe.ROWS
