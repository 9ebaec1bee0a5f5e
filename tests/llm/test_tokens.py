import io
import random
import struct
import zlib

import numpy as np
import pytest

from postpulse.llm import spm_backend as sb
from postpulse.llm import token_store as ts
from postpulse.llm.tokens import WordEncoder, tokenizer_path
from postpulse.session import scratch_path

WORDS = tokenizer_path("word_bpe_49k.json")
PIECES = tokenizer_path("piece_bpe_32k.model")
ODD = ["", " ", "Hello, World's  it's I'LL <|endoftext|> <|EndOfText|>x", "naïve café ÀÉÎ ﬁ ① ½ 12345 don’t",
       "日本語 テスト é  x\x1cy z", "İstanbul ΣΑΣ ŉ ſ a̸ ̸=", "''s 's't x'S 're'RE ___ a_b 1a2 ²³"]


def random_texts(alphabet, n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_chunked_encoding_has_parity_with_the_library():
    e = WordEncoder(WORDS)
    texts = ODD + random_texts("aA'sSt.,!<|> é́İΣ ᾳ1½\x1c\n日k", 800, 1)
    want = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in e.encode(texts)] == want
    assert e.vocabulary_bits() == 16


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 31, 32])
def test_bit_packing_round_trip(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 7, 1000):
        ids = rng.integers(0, 1 << bits, n, dtype=np.uint64).astype("<u4")
        data = ts.pack_ids(ids, bits)
        assert len(data) == -(-n * bits // 8)
        assert (ts.unpack_ids(data, bits, n) == ids).all()
    if bits < 32:
        with pytest.raises(ValueError):
            ts.pack_ids(np.array([1 << bits], "<u4"), bits)


def test_random_access_across_blocks():
    class Kept(io.BytesIO):
        def close(self):
            self.data = self.getvalue()

    rng = np.random.default_rng(2)
    held = [rng.integers(0, 5000, rng.integers(0, 60)).astype("<u4") for _ in range(50)]
    out = Kept()
    writer = ts.Writer(out, 13, block=64)
    for i, ids in enumerate(held):
        writer.add(None if i == 3 else i - 20, ids)
    assert writer.close() == (50, sum(map(len, held)))
    reader = ts.Reader(out.data)
    for i in random.Random(3).sample(range(50), 50):
        assert (reader.document(i) == held[i]).all()
    assert reader.ids[7] == -13 and not reader.has_id[3]
    assert struct.unpack("<I", out.data[12:16])[0] == 13
    with pytest.raises(ValueError):
        ts.Reader(b"x" * 100)


def test_store_round_trip(spark, docs):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(40, None), (None, "no id"), (3, "again"), (3, "again"),
                                                  (-5, "w " * 3000)]
    path = scratch_path(spark, "store-test")
    manifest = ts.write_store(spark, docs(rows), path, WORDS, end_id=2, file_ids=50)
    got = [tuple(r) for r in ts.read_store(spark, path, manifest).collect()]
    library = WordEncoder(WORDS).tokenizer
    want = []
    for d, t in rows:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((d, len(ids), zlib.crc32(ids.tobytes())))
    assert sorted([(d, n, c) for d, _, n, c in got], key=str) == sorted(want, key=str)
    got.sort(key=lambda r: r[1])
    at = 0
    for _, start, n, _ in got:
        assert start == at
        at += n
    assert [d for d, *_ in got] == sorted([d for d, _ in rows], key=lambda d: (d is not None, d))
    empty = scratch_path(spark, "store-empty")
    none = ts.write_store(spark, docs([]), empty, WORDS, end_id=2)
    assert ts.read_store(spark, empty, none).count() == 0


def own_wrong(own):
    """Ids of other texts than "some text" and "b"."""
    return [i for i, _ in own.encode(["some  text", ""])]


def test_sentencepiece_parity_and_round_trip(spark, docs):
    with open(PIECES, "rb") as f:
        data = f.read()
    texts = ["", " ", "a  b ", " lead", "日本語 テスト\n\n  x\t<s> </s> <unk> <0x41>", "é🙂 a\x00b"]
    texts += random_texts("aAtheon 日  é\n<s>0", 600, 4)
    assert sb.check_parity(data, texts) == []
    own = sb.Backend(data)
    for text, (ids, parity), other in zip(texts, own.encode(texts), own.other.encode(texts)):
        assert parity and ids.tolist() == other
        assert own.spells(text, ids) and own.decode(ids) == text
    ids = [i for i, _ in own.encode(texts)]
    assert all(own.round_trips(texts, ids)) and own.decode_batch(ids) == own.other.decode(
        [i.tolist() for i in ids])
    # any ids at all: the groups give what the library gives for the whole
    rng = np.random.default_rng(5)
    some = [rng.integers(0, 600 if k % 2 else len(own.model.pieces), rng.integers(0, 40)).astype("<u4")
            for k in range(400)]
    assert own.decode_batch(some) == own.tokenizer.decode_batch(
        [i.tolist() for i in some], skip_special_tokens=False)
    assert own.round_trips(["some text", "b"], own_wrong(own)) == [False, False]
    got = sb.encode_documents(docs([(1, "some text"), (2, None), (None, ""), (1, "some text")]), PIECES)
    assert [(r.n_tokens > 0, r.parity, r.round_trip) for r in got.orderBy("doc_id").collect()] == [
        (False, True, True), (True, True, True), (True, True, True), (False, True, True)]


def test_unigram_model_is_rebuilt():
    from sentencepiece import sentencepiece_model_pb2 as pb
    proto = pb.ModelProto()
    for piece, score, kind in [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), ("▁", -3, 1), ("▁the", -1, 1),
                               ("re", -2, 1), ("t", -4, 1), ("h", -4, 1), ("e", -4, 1), ("r", -4, 1),
                               ("▁t", -3.5, 1), ("he", -2.5, 1)]:
        proto.pieces.add(piece=piece, score=score, type=kind)
    for b in range(256):
        proto.pieces.add(piece=f"<0x{b:02X}>", score=0, type=6)
    proto.trainer_spec.model_type = 1
    proto.trainer_spec.byte_fallback = True
    proto.normalizer_spec.name = "identity"
    data = proto.SerializeToString()
    model = sb.parse_model(data)
    assert model.kind == sb.UNIGRAM and model.byte_fallback and len(model.pieces) == 268
    assert sb.check_parity(data, ["the there", "  the   re ", "here tree", "", "x the é"]) == []
