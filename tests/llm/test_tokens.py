from __future__ import annotations

import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from leadlane.llm import packing, segments, token_counts, token_files
from leadlane.llm.common import tokenizer_path

SCHEMA = "doc_id long, text string"
ODD = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a \n b", "a\n b", "a\t\tb", "x.y,z. w,, v.", "don't. it's, we'll",
    "été .. naïve, ÉÉ.", "á. b ́c", "one two three", "one  two", "　x   y", "\x01. a\x01, b",
    "<|endoftext|> a <|endoftext|>.", "<|startoftext|>", "▁a ▁ b", "<s> </s> <unk> <0x0A>", "日本語 テキスト。 한국어", "🎉 🎉🎉 a🎉.",
    "12 345 6,7.8", "A.B.C. d.e", "#tag, $$$ %%.", "x" * 3000, "word " * 5000, "tab\tend", "\r\nx \r\n y\x85 z", "İ. ı, ǅ ß",
]


def direct(name):
    path = tokenizer_path(name)
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path).encode
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    return lambda text: model.encode(text, add_special_tokens=False).ids


def mixed_texts():
    rng = random.Random(12)
    bits = ["a", "B", "word", "été", ".", ",", " ", "  ", "\n", "'s", "1", "-", " ", "́", "é", "…", "\x01", "日", "\t", "▁", "▂", "\u00a0", "ﬁ", "<|endoftext|>", "İ"]
    odd_spaces = ["a▁ 日", "bar ▁ ▂ ▃", "▁▂▃ ▁ ▁ ▅", "▁", " ▁", "▁ " * 300, "some words▁ here " * 90]
    return ODD + odd_spaces + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 30))) for _ in range(1500)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_segments_give_the_ids_of_whole_texts(name, monkeypatch):
    monkeypatch.setattr(segments, "CACHE_SEGMENTS", 300)
    monkeypatch.setattr(segments, "WHOLE_CHARS", 700)
    texts, encode, plain = mixed_texts(), segments.encoder(name), direct(name)
    texts.append(("some words here  " + "and more of it, really. ") * 90)
    for part in (texts[:40], texts[40:900], texts[900:], texts):
        n, ids = encode.encode(pa.array(part, pa.string()))
        at = 0
        for text, k in zip(part, n.tolist()):
            assert ids[at : at + k].tolist() == plain(text or ""), repr(text)
            at += k
        assert at == len(ids)
    n, ids = encode.encode(pa.array([], pa.string()))
    assert len(n) == len(ids) == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_cuts_before_symbols_give_the_ids_of_whole_texts(name):
    rng = random.Random(31)
    bits = ["a", "Word", "it's", "é", " ", " ", "\n", "'s", "7", "\u0338", "\u0301", "\u20e3", "Σ", "<", "<|", "|>", "<|endoftext|>", "\u3000", "\x85", "\x1c", *'.,;:!?)]}("#*$%&|>=-\'']
    texts = ["foo### bar$$$ x%%%.y a!'s b:'s", "a:Σ b.Σ", "end\x85", "end\n\n", " \nfoo", "a \nfoo", "a b\n", "a<|endoftext|>! b", "f(x)[1]{2}.", "a#\u0338 b)\u0301"]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randint(1, 25))) for _ in range(4000)]
    encode, plain = segments.encoder.__wrapped__(name), direct(name)
    n, ids = encode.encode(pa.array(texts, pa.string()))
    ends = np.cumsum(n).tolist()
    for text, a, b in zip(texts, [0, *ends], ends):
        assert ids[a:b].tolist() == plain(text), repr(text)


def test_the_tokenizer_gets_words_once_and_without_marks(monkeypatch):
    import tokenizers

    given = []

    class Spy:
        def __init__(self, model):
            self.model = model

        def __getattr__(self, name):
            return getattr(self.model, name)

        def encode_batch_fast(self, texts, **options):
            given.extend(texts)
            return self.model.encode_batch_fast(texts, **options)

    real = tokenizers.Tokenizer
    monkeypatch.setattr(tokenizers, "Tokenizer", type("Tokenizer", (), {"from_file": staticmethod(lambda path: Spy(real.from_file(path)))}))
    encode = segments.encoder.__wrapped__(token_files.BYTE_TOKENIZER)
    given.clear()
    words = [f"{chr(97 + k % 26)}{chr(97 + k // 26)}word" for k in range(600)]
    encode.encode(pa.array([" ".join(w + end for w in words) for end in ("", "###", "!", ";", "%%")], pa.string()))
    assert sum(map(len, given)) <= 1.05 * sum(len(w) + 1 for w in words)


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), SCHEMA).selectExpr("*", "1 AS length", "2 AS OFFSET", "'x' AS n_tokens")


def test_counts(spark):
    plain = direct(token_counts.SENTENCE_MODEL)
    rows = token_counts.with_limit(token_counts.count_tokens(table(spark, ODD)), 1000).collect()
    for r in rows:
        text = ODD[r["doc_id"]] or ""
        n = len(plain(text))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 1000)
    assert len(rows) == len(ODD)
    assert token_counts.count_tokens(spark.createDataFrame([], SCHEMA)).collect() == []


def test_pieces_and_sequences(spark):
    plain, capacity = direct(packing.WORD_TOKENIZER), 64
    docs = table(spark, ODD + ["w " * k for k in range(200)]).unionAll(table(spark, ["same"] * 300)).unionAll(
        spark.createDataFrame([(None, "null id")] * 2, SCHEMA).selectExpr("*", "1", "2", "'x'")
    )
    cut = packing.pieces(docs, capacity=capacity, keep_ids=True)
    rows = packing.pack(cut, capacity).collect()
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r["doc_id"]].append(r["text"] or "")
    found, expected = defaultdict(list), defaultdict(list)
    for r in rows:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        found[r["doc_id"]].append((r["piece"], r["start"], r["ids"]))
    for doc, of_doc in texts.items():
        for text in of_doc:
            ids = np.array([*plain(text), 1], "<u4")
            expected[doc] += [(k, a, ids[a : a + capacity].tobytes()) for k, a in enumerate(range(0, len(ids), capacity))]
    assert {d: sorted(x) for d, x in found.items()} == {d: sorted(x) for d, x in expected.items()}
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(sequences) <= 1.02 * sum(r["length"] for r in rows) / capacity + 1
    assert packing.pack(packing.pieces(docs.limit(0))).collect() == []


def test_plan_is_best_fit():
    rng = random.Random(3)
    for _ in range(200):
        capacity = rng.randint(1, 40)
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 120))]
        histogram = {n: lengths.count(n) for n in lengths}
        slots = packing.plan_slots(histogram, capacity)
        used = defaultdict(list)
        for length, first, n, sequence, offset in slots:
            for k in range(n):
                used[sequence + k].append((offset, length))
        ranks = defaultdict(list)
        for length, first, n, _, _ in slots:
            ranks[length] += range(first, first + n)
        assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in histogram.items()}
        room = []
        for n in sorted(lengths, reverse=True):
            fits = [k for k, left in enumerate(room) if left >= n]
            if fits:
                room[min(fits, key=lambda k: room[k])] -= n
            else:
                room.append(capacity - n)
        assert len(used) == len(room)
        for parts in used.values():
            ends = 0
            for offset, length in sorted(parts):
                assert offset == ends
                ends += length
            assert ends <= capacity


def test_lengths_out_of_range_are_refused(spark):
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(0,)], "length long"))


def test_token_files(spark):
    plain = direct(token_files.BYTE_TOKENIZER)
    texts = ODD + [ODD[12]] * 40
    docs = table(spark, texts).unionAll(spark.createDataFrame([(None, "null id"), (3, "again"), (3, "again")], SCHEMA).selectExpr("*", "1", "2", "'x'"))
    files = token_files.write_token_files(docs.repartition(5), file_bytes=3000, frame_bytes=700)
    rows = sorted(files.read().collect(), key=lambda r: r["start"])
    at = 0
    for r in rows:
        assert r["start"] == at and len(r["ids"]) == 4 * r["n_tokens"]
        at += r["n_tokens"]
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in rows]
    assert ids == sorted(ids) and len(rows) == len(texts) + 3
    found = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["ids"]) for r in rows)
    expected = [(k, np.array([*plain(t or ""), 0], "<u4").tobytes()) for k, t in enumerate(texts)]
    expected += [(d, np.array([*plain(t), 0], "<u4").tobytes()) for d, t in ((-1, "null id"), (3, "again"), (3, "again"))]
    assert found == sorted(expected)
    some = files.read(spark.createDataFrame([(5,), (30,), (999,)], "doc_id long")).collect()
    assert sorted((r["doc_id"], r["start"]) for r in some) == sorted((r["doc_id"], r["start"]) for r in rows if r["doc_id"] in (5, 30))
    assert files.index.select("path").distinct().count() >= 2
    assert token_files.write_token_files(docs.limit(0)).read().collect() == []


def test_readers_touch_only_the_frames_they_need(tmp_path):
    import zstandard

    path = tmp_path / "x.zst"
    data = np.arange(10_000, dtype="<u4").tobytes()
    with open(path, "wb") as out:
        writer = token_files.FrameWriter(out, 1000)
        for k in range(0, len(data), 123):
            writer.add(data[k : k + 123])
        writer.close()
    size = path.stat().st_size
    with open(path, "rb") as source:
        reader = token_files.FrameReader(source, size)
        assert reader.read(5000, 1500) == data[5000:6500] and reader.frames_read == 2
        assert reader.read(0, len(data)) == data and len(reader.entries) == 40
        assert zstandard.ZstdDecompressor().stream_reader(open(path, "rb"), read_across_frames=True).read() == data
    broken = bytearray(path.read_bytes())
    broken[-9 - 12 * 40 + 8] ^= 1
    (tmp_path / "y.zst").write_bytes(broken)
    with open(tmp_path / "y.zst", "rb") as source, pytest.raises(ValueError):
        token_files.FrameReader(source, size).read(0, 10)
    assert struct.unpack("<I", broken[-4:])[0] == token_files.SEEKABLE_MAGIC
