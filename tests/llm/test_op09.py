import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from terrabin.llm import op09_arrow_tokens as op


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(op.default_tokenizer())


def test_round_trip(spark, docs, rows, tokenizer):
    manifest = op.write_tokens(docs)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in op.read_tokens(manifest).collect())
    at, ids_seen = 0, []
    for start, _, n, _ in got:
        assert start == at
        at += n
    ids_seen = [2**63 if r[1] is None else r[1] for r in got]
    assert ids_seen == sorted(ids_seen)
    ids = [np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4") for r in rows]
    assert Counter((r[1], r[2], r[3]) for r in got) == Counter((r[0], len(x), zlib.crc32(x.tobytes())) for r, x in zip(rows, ids, strict=True))


def test_sequences_have_one_length_and_a_mask(docs):
    row = op.write_tokens(docs).where("docs > 0").first()
    part, index = op.Sequences(row.file), op.opened(f"{row.file}.docs.arrow").read_all()
    schema = part.reader.schema
    assert schema.field("ids").type.list_size == op.SEQUENCE == schema.field("mask").type.list_size
    masks = [part.sequence(i)[1].to_numpy(zero_copy_only=False) for i in range(len(part))]
    mask = np.concatenate(masks)
    assert mask.sum() == row.ids == sum(index["n_tokens"].to_pylist()) and mask[: row.ids].all()


def test_any_sequence_is_found_alone(tmp_path):
    ids = np.random.default_rng(1).integers(0, 50000, 10_007).astype("<u2")
    with pa.OSFile(str(tmp_path / "p.arrow"), "wb") as sink:
        writer = op.Writer(sink, ids.dtype, length=16, rows=8)
        for k in range(0, len(ids), 777):
            writer.add(ids[k : k + 777])
        writer.close()
    part = op.Sequences((tmp_path / "p").as_uri())
    assert len(part) == -(-len(ids) // 16)
    for i in (625, 0, 311, 8, 7):
        got, mask = part.sequence(i)
        n = min(16, len(ids) - 16 * i)
        assert got[:n].tolist() == ids[16 * i : 16 * i + n].tolist() and mask.to_pylist() == [k < n for k in range(16)]
    for start, n in ((0, 10_007), (127, 2), (5000, 1), (128, 128), (9000, 1007)):
        assert part.span(start, n).tolist() == ids[start : start + n].tolist()


def test_reruns_agree_on_repeated_ids(spark):
    rows = [(i % 3 if i % 4 else None, f"text number {i % 17} of one id") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, two = (op.read_tokens(op.write_tokens(docs.repartition(n))).collect() for n in (2, 7))
    assert sorted(one, key=lambda r: r.start) == sorted(two, key=lambda r: r.start)


def test_pieces_equal_whole_texts(tokenizer):
    r, encoder = random.Random(1), op.Encoder(op.default_tokenizer())
    parts = ["a", "b'll", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "\u1680", "\u2028", "\x1c", "1", "!?", "é", "<|endoftext|>", "<|", "|>", "\x85", "日本", "д", "ß", "x²", "e\u0301", "_", "'s", "×", "÷", "\u200b", " word", ","]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 15))) for _ in range(3000)]
    want = [[*tokenizer.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    assert [x.tolist() for x in encoder.encode(texts)] == want
    for t, ids in zip(texts[:500], want, strict=False):
        assert encoder.encode([t])[0].tolist() == ids, repr(t)


def test_cache_is_bounded(monkeypatch, tokenizer):
    monkeypatch.setattr(op, "SLOT_BITS", 2)
    monkeypatch.setattr(op, "KEPT_IDS", 30)
    encoder = op.Encoder(op.default_tokenizer())
    texts = [f"word{chr(97 + i)} other" for i in range(20)]
    want = [[*e.ids, 0] for e in tokenizer.encode_batch(texts)]
    assert [x.tolist() for x in encoder.encode(texts)] == want
    assert [encoder.encode([t])[0].tolist() for t in texts] == want and len(encoder.key) == 4


def test_empty_table(no_docs):
    assert op.read_tokens(op.write_tokens(no_docs)).count() == 0


def test_added_tokens_in_texts_are_encoded_as_by_the_file(spark):
    plain = Tokenizer.from_file(op.default_tokenizer())
    texts = ["one two", "a b<|endoftext|> c", "<|endoftext|>", "three <|endoftext|><|endoftext|>\n four", "<|endoftext", None]
    assert 50256 in plain.encode(texts[1], add_special_tokens=False).ids
    got = op.read_tokens(op.write_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()
    ids = [np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for t in texts]
    starts = np.cumsum([0, *map(len, ids)])
    assert sorted(tuple(r) for r in got) == [(i, starts[i], len(x), zlib.crc32(x.tobytes())) for i, x in enumerate(ids)]
