import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.dataset as ds
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from clusterloom.llm import id_coder, jvm, token_store
from clusterloom.llm.common import shared_dir

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_blocks_round_trip():
    rng = np.random.default_rng(3)
    zipf = np.minimum(rng.zipf(1.3, 5000), 60000)
    for ids, block in ((rng.integers(0, 65536, 2000), 77), (rng.integers(0, 1 << 32, 3000), 500), (rng.integers(0, 4, 3000), 64), (np.zeros(500, int), 1000), (np.array([(1 << 32) - 1]), 1), (np.zeros(0, int), 5), (zipf, 900)):
        header, coded = id_coder.encode(ids.astype(np.int64), block)
        assert len(coded) == -(-len(ids) // block)
        assert (id_coder.decode(header, coded) == ids).all()
        # Blocks are independent: with the header, each decodes alone.
        for i in range(0, len(coded), 7):
            assert (id_coder.decode(header, [coded[i]], only=i) == ids[i * block : (i + 1) * block]).all()


def test_order_0_to_2_predict():
    """Fewer bytes an id than zlib on the same blocks, and than the corpus's own order-0 entropy."""
    docs = ds.dataset("/root/testdata/sf0.001/documents.parquet").to_table(columns=["text"]).column("text").to_pylist()
    ids = np.concatenate([np.frombuffer(b, "<u4") for b in token_store.Encoder(PATH).encode([t or "" for t in docs])])
    header, coded = id_coder.encode(ids, token_store.BLOCK)
    size = (len(header) + sum(map(len, coded))) / len(ids)
    p = np.unique(ids, return_counts=True)[1] / len(ids)
    packed = sum(len(zlib.compress(ids[i : i + token_store.BLOCK].astype("<u2").tobytes(), 9)) for i in range(0, len(ids), token_store.BLOCK)) / len(ids)
    assert size < -(p * np.log2(p)).sum() / 8 < packed
    # Context helps beyond order 0: a cycle of ids is foretold.
    cycle = np.tile(rng_ids(40), 500)
    assert sum(map(len, id_coder.encode(cycle, 2000)[1])) < len(cycle) * np.log2(40) / 8 / 2


def rng_ids(n):
    return np.random.default_rng(1).integers(0, 50000, n)


def test_damage_is_found(tmp_path):
    good = token_store.frame([(1, np.arange(3000, dtype="<u4").tobytes()), (None, b"")], 500)
    for at in (3, 10, 60, len(good) // 2, len(good) - 3):
        bad = bytearray(good)
        bad[at] ^= 0x10
        (tmp_path / "x").write_bytes(bytes(bad))
        with pytest.raises(id_coder.Damaged), open(tmp_path / "x", "rb") as f:
            list(token_store.frames(f, len(bad)))


def test_encoder_is_the_library():
    lib, rng = Tokenizer.from_file(PATH), random.Random(1)
    pieces = ["the", "don't", "Été", "é", "\n", "\n\n", "123", "<|endoftext|>", "日本", "\x1c", "\xa0", " ", "  ", "---", "🙂", "\t", " a", "x "]
    texts = [" ".join(rng.choice(pieces) for _ in range(n)) for n in (0, 1, 2, 5, 30) for _ in range(60)] + ["", " ", "a b", " a", "a "]
    e = token_store.Encoder(PATH)
    assert e.apart
    assert [np.frombuffer(b, "<u4").tolist() for b in e.encode(texts)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_files_round_trip(spark):
    lib, rng = Tokenizer.from_file(PATH), random.Random(2)
    rows = [(i * 3 % 101, " ".join(rng.choice(["alpha", "beta", "Gamma.", "x\ny"]) for _ in range(rng.randrange(60)))) for i in range(101)]
    rows += [(500, None), (501, ""), (502, "!" * 50), (None, "no id"), (7, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as start", "2 as n").repartition(5)
    manifest = token_store.write(df, shared_dir(spark, "ids"), PATH, block=50, per_frame=400)
    got = token_store.read(manifest, with_ids=True).collect()
    want, start = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert token_store.read(token_store.write(df.limit(0), shared_dir(spark, "ids"), PATH)).count() == 0


def test_low_bits_are_predicted():
    """Ids whose successor is certain cost little, also the rare ones: no bit of an id is coded as it is."""
    ids = np.random.default_rng(5).permutation(4096)  # all equally frequent: 12 bits each without context
    cycle = np.concatenate([ids[i * 64 : i * 64 + 64] for i in np.repeat(np.arange(64), 24)])
    header, coded = id_coder.encode(cycle, 64 * 24)
    assert (id_coder.decode(header, coded) == cycle).all()
    assert sum(map(len, coded)) * 8 / len(cycle) < 3


def test_long_and_single_paths():
    fib = [1, 1]
    while len(fib) < 24:
        fib.append(fib[-1] + fib[-2])
    deep = np.random.default_rng(6).permutation(np.repeat(np.arange(24) * 100_000_000, fib))
    for ids, block in ((deep, 1000), (np.full(7, 9), 3), (np.array([5, 8]), 1)):
        header, coded = id_coder.encode(ids, block)
        assert (id_coder.decode(header, coded) == ids).all()
        last = len(coded) - 1
        assert (id_coder.decode(header, [coded[last]], only=last) == ids[last * block :]).all()


def test_pairs_of_the_frame_are_known_in_few_steps(monkeypatch):
    """Blocks too short to learn from know the frame's pairs; an id takes two steps at most, however rare it is."""
    rng = np.random.default_rng(8)
    after, ids = rng.integers(0, 2000, (2000, 2)), [0]
    for side in rng.integers(0, 2, 40_000).tolist():
        ids.append(int(after[ids[-1], side]))
    steps, settle = [], id_coder._Coder.settle
    monkeypatch.setattr(id_coder._Coder, "settle", lambda self, *how: steps.append(1) or settle(self, *how))
    header, coded = id_coder.encode(np.array(ids), 200)
    assert len(steps) <= 2 * 200 + 1
    assert (id_coder.decode(header, coded) == ids).all()
    assert sum(map(len, coded)) * 8 / len(ids) < 2.5  # 11 bits each without their pairs, 1 at best


def test_known_words_need_no_library():
    """Words, marks behind them and words behind line breaks that were met before aren't encoded again; a decoder's tables give what a search gives."""
    e, lib = token_store.Encoder(PATH), Tokenizer.from_file(PATH)
    e.encode(["alpha beta gamma.", "gamma gamma"])

    class Closed:
        def encode_batch_fast(self, texts, **how):
            assert not texts
            return []

    e.tokenizer = e.words = Closed()
    new = "alpha beta.\ngamma beta\n\ngamma gamma."
    assert np.frombuffer(e.encode([new])[0], "<u4").tolist() == lib.encode(new, add_special_tokens=False).ids
    known = token_store.encoder_of("run", PATH)
    assert token_store.encoder_of("run", PATH) is known and token_store.encoder_of("other run", PATH) is not known
    hostile = ["a\n\n<|endoftext|>b", "a\n\n b", "a\n b", "a\n\n", "a\n", "a \nb", "a\n\n\nb", "\na b", "a's.'s b.", "x\r\ny z"]
    got = token_store.Encoder(PATH).encode(hostile)
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == [lib.encode(t, add_special_tokens=False).ids for t in hostile]


def test_tables_find_what_a_search_finds():
    rng = np.random.default_rng(4)
    counts = np.sort(rng.zipf(1.3, 3000).clip(1, 10**6))[::-1]
    pairs = np.unique(rng.integers(0, 200, 5000) * 3000 + rng.integers(0, 3000, 5000))
    f = id_coder._Frame(counts, pairs, rng.zipf(1.5, len(pairs)).clip(1, 10**6))
    f.index()
    now, v = rng.integers(0, 3000, 100_000) // rng.integers(1, 50, 100_000), rng.integers(0, 1 << f.bits, 100_000)
    assert (f.entry_at(now, v) == np.searchsorted(f.places, (now << f.bits) + v, "right") - 1).all()
    assert (f.number_at(v) == np.searchsorted(f.first, v, "right") - 1).all()


def test_java_and_numpy_code_alike(spark, tmp_path):
    """Files of Spark's own tasks are what the NumPy coder writes and reads, for any ids; damage is found."""
    call = jvm.functions(spark, token_store.SOURCES, **token_store.RETURNED)
    rng = np.random.default_rng(3)
    zipf = np.minimum(rng.zipf(1.3, 5000), 60000)
    cases = ((rng.integers(0, 65536, 2000), 77), (rng.integers(0, 1 << 32, 3000), 500), (np.zeros(500, int), 1000), (np.array([(1 << 32) - 1]), 1), (np.zeros(0, int), 5), (zipf, 900))
    for k, (ids, block) in enumerate(cases):
        b = ids.astype("<u4").tobytes()
        half = len(b) // 8 * 4
        docs = [(1, b[:half]), (None, b""), (-5, b[half:])]
        row = spark.createDataFrame([(bytearray(token_store.table_of(docs)), bytearray(b))], "entries binary, ids binary")
        at = row.select(F.call_udf(call["WriteFrame"], F.lit(f"file://{tmp_path}/{k}"), F.lit(3), "entries", "ids", F.lit(block), F.lit(None).cast("binary")).alias("at")).first()["at"]
        with token_store.opened(at["path"]) as f:
            names, counts, got, end = token_store.read_frame(f, at["cut"])
        assert (names, counts.tolist(), got.tolist(), end) == ([1, None, -5], [half // 4, 0, len(ids) - half // 4], ids.tolist(), at["size"])
        frame = token_store.frame(docs, block)
        read = [spark.createDataFrame([(bytearray(x), 100)], "frame binary, start long").select(F.inline(F.call_udf(call["ReadFrame"], "frame", "start"))) for x in (frame, frame[:-3] + bytes([frame[-3] ^ 16]) + frame[-2:])]
        assert sorted(map(tuple, read[0].collect()), key=lambda r: (r[1], r[2])) == sorted(((d, 100 + s, len(x) // 4, zlib.crc32(x)) for (d, x), s in zip(docs, (0, half // 4, half // 4))), key=lambda r: (r[1], r[2]))
        if len(ids):
            with pytest.raises(Exception, match="checksum|no sound frame"):
                read[1].collect()


def test_documents_are_the_same_by_either_coder(spark):
    lib, rng = Tokenizer.from_file(PATH), random.Random(4)
    rows = [(i, " ".join(rng.choice(["alpha", "Été,", "x\ny", "beta..."]) for _ in range(rng.randrange(40)))) for i in range(60)] + [(None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted((len(x := lib.encode(t or "", add_special_tokens=False).ids + [0]), zlib.crc32(np.array(x, "<u4").tobytes())) for _, t in rows)
    for large in (0, 150, token_store.LARGE):  # all frames by NumPy, some, none
        manifest = token_store.write(df, shared_dir(spark, "ids"), PATH, block=30, per_frame=120, large=large)
        for reads in (0, token_store.LARGE):
            got = sorted(map(tuple, token_store.read(manifest, large=reads).collect()), key=lambda r: r[1])
            assert [r[0] for r in got] == [None, *range(60)]
            assert [r[1] for r in got] == [sum(r[2] for r in got[:i]) for i in range(61)]
            assert sorted(r[2:] for r in got) == want


def test_pieces_are_compared_by_all_their_bytes():
    """Pieces of any length and of equal hashes, and line breaks, marks and texts for the library in any order."""
    lib, rng = Tokenizer.from_file(PATH), random.Random(6)
    parts = ["the", "Été", "\n", "\n\n", "123", "<|endoftext|>", "日本", "\xa0", " ", "---", "🙂", "\t", "a.", "b,\n", "Ã×÷", "×", "é" * 13, "s" * 24, "s" * 25, "s" * 26, "ª", "ÿ!", "'s", "\r\n", "\x00"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", " ", "\n"]) for _ in range(rng.randrange(30))) for _ in range(400)] + ["", " ", "\n", "a\n", "a\n\n", "a\n\n<|endoftext|>"]
    want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
    for change in (None, lambda words, tags: tags & np.uint64(1)):  # and hashes that tell nearly nothing
        e = token_store.Encoder(PATH)
        e.pieces._hashes = change or e.pieces._hashes
        for _ in range(2):
            assert [np.frombuffer(b, "<u4").tolist() for b in e.encode(texts)] == want
        e.pieces.most = 5
        assert [np.frombuffer(b, "<u4").tolist() for b in e.encode(texts[:50])] == want[:50]
        assert [np.frombuffer(b, "<u4").tolist() for b in e.encode_by_dict(texts)] == want
