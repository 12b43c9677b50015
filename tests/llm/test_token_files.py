import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leadlake.llm import token_files as tf

from . import tables


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tf.word_bpe())


@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=70))
def test_round_trip_of_the_coding(ranks):
    control, data = tf.pack(np.array(ranks, "<u4"))
    assert len(control) == -(-len(ranks) // 4)
    assert tf.unpack(control, data, len(ranks)).tolist() == ranks


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(list("abAB,.'’ \t\x1c ́İΣ<|>"))), max_size=40))
def test_chunks_give_the_ids_of_the_library(tokenizer, text):
    enc = tf.encoder(open(tf.word_bpe(), encoding="utf-8").read())
    assert enc.encode([text.encode()])[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [
    "Hello <|endoftext|> World", "<|endoftext|>Hello World", "HELLO\n<|STARTOFTEXT|> It's ÉTÉ Straße 12 <|EndOfText|>Ab cD!! don'T",
    "x<|endoftext|>Y Hello", "Hello <|endoftext |> World"])
def test_added_tokens_beside_capitals_give_the_ids_of_the_library(tokenizer, text):
    enc = tf.Encoder(open(tf.word_bpe(), encoding="utf-8").read())
    assert enc.encode([text.encode()])[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def brute(tokenizer, rows):
    out, at = [], 0
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_files_of_small_tables(spark, sf_small, tokenizer):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    got = [tuple(r) for r in tf.op7_token_files(spark, sf_small).orderBy("start").collect()]
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    assert got == brute(tokenizer, rows)


def test_awkward_rows(spark, tmp_path, tokenizer):
    path = f"{tmp_path}/files"
    tf.write_token_files(tables.awkward(spark), path, tf.word_bpe())
    got = tf.read_token_files(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r[0] for r in tables.rows()), key=lambda i: (i is not None, i or 0))
    at, texts = 0, {}
    for i, t, *_ in tables.rows():
        texts.setdefault(i, []).append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2])
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids)
        assert r.ids in texts[r.doc_id]
        texts[r.doc_id].remove(r.ids)
        at += r.n_tokens
    ranked = spark.read.parquet(f"{path}/vocabulary").orderBy("rank").collect()
    assert [r.n for r in ranked] == sorted((r.n for r in ranked), reverse=True) and sum(r.n for r in ranked) == at


def test_no_rows(spark):
    assert tables.plain(tf.encode_documents(tables.none(spark), tf.word_bpe())) == []


def test_remembered_pieces_are_bounded(tokenizer, monkeypatch):
    monkeypatch.setattr(tf, "CACHED_BYTES", 200_000, raising=False)
    enc = tf.Encoder(open(tf.word_bpe(), encoding="utf-8").read())
    texts = [f"the common words {chr(97 + k % 26)}{'xyzq' * (k * 10)} and x{k}y{k}" for k in range(200)]
    for at in range(0, len(texts), 5):
        got = enc.encode([t.encode() for t in texts[at:at + 5]])
        assert [g.tolist() for g in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts[at:at + 5]]
        held = sum(len(p) + len(ids) for d in vars(enc).values() if isinstance(d, dict) for p, ids in d.items())
        assert held < 2 * (200_000 + 5 * 40_000)  # two generations, each with the group that filled it
    assert "the" in enc.pieces or "the" in enc.older


def test_documents_are_encoded_in_groups_of_bounded_size(monkeypatch):
    monkeypatch.setattr(tf, "TEXT_BYTES", 1000, raising=False)
    groups = []

    class Fake:
        def encode(self, texts):
            groups.append([len(t) for t in texts])
            return [np.array([len(t)], "<u4") for t in texts]

    sizes = [600, None, 600, 5000, 0, 10, *[1] * 300]
    batch = pa.record_batch([pa.array([None if n is None else b"x" * n for n in sizes], pa.binary())], names=["text"])
    assert [(k, x.tolist()) for k, x in tf._encoded(batch, Fake(), 2)] == [(k, [n or 0, 2]) for k, n in enumerate(sizes)]
    assert groups == [[600, 0, 600], [5000], [0, 10, *[1] * 254], [1] * 46]
    assert list(tf._encoded(batch.slice(0, 0), Fake(), 2)) == []


def test_executors_send_small_batches(spark, tmp_path, monkeypatch):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, seen, saved, counts = spark.conf.get(key), [], tf.saved, tf.id_counts
    monkeypatch.setattr(tf, "saved", lambda *a: seen.append(spark.conf.get(key)) or saved(*a))
    monkeypatch.setattr(tf, "id_counts", lambda raw: seen.append(spark.conf.get(key)) or counts(raw))
    tf.write_token_files(tables.awkward(spark), f"{tmp_path}/files", tf.word_bpe())
    assert seen == [str(8 << 20)] * 2 and spark.conf.get(key) == before

    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.num_rows], pa.int64())], names=["n"])

    rows = spark.range(0, 40, 1, 1).selectExpr("repeat('x', 100000) AS t")
    with tf.batches_of(spark, 1 << 20):
        got = [r.n for r in rows.mapInArrow(sizes, "n long").collect()]
    assert sum(got) == 40 and max(got) <= 11
    with pytest.raises(ValueError), tf.batches_of(spark, 1 << 20):
        raise ValueError
    assert spark.conf.get(key) == before


def test_texts_of_a_group_are_cut_one_after_another(tokenizer):
    """The pieces of one text are held at a time, not those of the group."""
    enc = tf.Encoder(open(tf.word_bpe(), encoding="utf-8").read())
    texts = [b"a b c, d. e f g 7 h i! " * 200] * 250
    want = tokenizer.encode(texts[0].decode(), add_special_tokens=False).ids
    enc.encode(texts[:1])
    tracemalloc.start()
    got = enc.encode(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all(g.tolist() == want for g in got)
    assert peak < sum(g.nbytes for g in got) + (2 << 20)


def test_words_of_latin_letters_give_the_ids_of_the_library(tokenizer):
    enc = tf.Encoder(open(tf.word_bpe(), encoding="utf-8").read())
    for c in map(chr, range(0xA0, 0x100)):
        text = f"{c} x{c}y {c}{c.upper()}b, A{c}7{c}!"
        assert enc.encode([text.encode()])[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_pieces_that_come_again_are_made_once(monkeypatch):
    monkeypatch.setattr(tf, "CACHED_BYTES", 20_000)
    enc = tf.Encoder(open(tf.word_bpe(), encoding="utf-8").read())
    made, of_piece = [], enc._of_piece
    enc.pieces.make = enc._of_piece = lambda p: made.append(p) or of_piece(p)
    for k in range(300):
        enc.encode([f"the common words and x{chr(97 + k % 26)}{chr(97 + k // 26)}".encode()])
    assert len(made) == len(set(made)) == 304 and len(enc.pieces) + len(enc.older) < 300
