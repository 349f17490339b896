"""Token ids in files: encoded texts in order of id, entropy-coded in independent, checksummed blocks."""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clusterloom.llm import id_coder
from clusterloom.llm.common import pick, shared_dir, stored
from clusterloom.llm.files import opened
from clusterloom.llm.jvm import functions
from clusterloom.llm.pieces import LATER, WORD, Pieces
from clusterloom.llm.token_counts import BYTES, MARKED

MAGIC = b"CLI4"
#: magic, documents, bytes of the document table, of the coder's header and of the block table, bytes of all blocks, crc32 of all that.
HEAD = struct.Struct("<4sIIIIQI")
#: Ids of a block and, about, of a frame, whose blocks are coded side by side; pieces a worker remembers, and words of letters.
BLOCK, FRAME, MEMO, WORDS = 1536, 3_000_000, 300_000, 300_000
#: Entries that a worker keeps; texts of more bytes are encoded by a dict of pieces, which takes less memory for a byte.
KEPT, HUGE = 2_500_000, 4 << 20
#: Bytes of texts that are encoded at a time.
SLICE = 1 << 20
#: What MARKED has behind a word.
MARKS = "!\"#$%&()*+,-./:;=?@[\\]^_`{|}~"
#: Frames of more ids, which one text may need, are coded by id_coder.py, others by IdCoder.java.
LARGE = 1 << 24
ROW = "doc_id long, start long, n_tokens long, ids_crc32 long"
SOURCES = ("IdCoder", "WriteFrame", "ReadFrame")
RETURNED = {"WriteFrame": "struct<path:string,cut:long,size:long>", "ReadFrame": f"array<struct<{ROW.replace(' ', ':').replace(',:', ',')}>>"}

SPACE = BYTES[32]


class Encoder:
    """The library's ids of whole texts, as little-endian uint32 bytes.

    With a byte-level tokenizer without normaliser, no token reaches over a single space between other characters than
    white space: then the pieces between such spaces are encoded once each. Other texts go to the library whole.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        config = json.loads(Path(path).read_text(encoding="utf-8"))
        pre = config.get("pre_tokenizer") or {}
        self.apart = (
            not config.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not config.get("post_processor")
            and all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"])) for t in config.get("added_tokens", []))
        )
        self.special = re.compile("|".join(re.escape(t["content"]) for t in config.get("added_tokens", [])) or r"(?!)")
        line = self.tokenizer.encode("a\nb", add_special_tokens=False).ids
        self.line = line[1] if len(line) == 3 else -1
        self.line_bytes = np.array([self.line & 0xFFFFFFFF], dtype="<u4").tobytes()
        self.apart = self.apart and self.line >= 0
        self.words = self._word_model(config, Tokenizer) if self.apart else None
        #: Whether no special string is made of letters and marks alone.
        self.tame = not any(t["content"].rstrip(MARKS).isalpha() or not t["content"].rstrip(MARKS) for t in config.get("added_tokens", []))
        self.pieces = Pieces(self.line, self.learn, KEPT)
        self.known: dict[str, bytes] = {}
        self.first: dict[str, bytes | None] = {}
        self.later: dict[str, bytes | None] = {}

    def _word_model(self, config: dict, tokenizer):
        """The model alone, for lines that are words of letters with a space before: a pattern would keep each whole, and only
        their first tokens begin with the space. None if the model is no plain BPE."""
        model = config["model"]
        if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")):
            return None
        lean = tokenizer.from_str(json.dumps(config | {"pre_tokenizer": {"type": "CharDelimiterSplit", "delimiter": "\n"}, "added_tokens": [], "truncation": None, "padding": None}))
        vocab = lean.get_vocab()
        self.begins = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.begins[[i for token, i in vocab.items() if token.startswith(SPACE)]] = True
        return lean if SPACE in vocab else None

    def _encoded_words(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of words of letters with a space before, and how many each has, in parts; ASCII words first."""
        plain = sum(w.isascii() for w in words)
        for begin, stop in ((0, plain), (plain, len(words))):
            for i in range(begin, stop, 4096):
                part = words[i : min(i + 4096, stop)]
                text = b"\n".join(part).decode("latin-1")
                if begin or not plain:
                    text = text.translate(BYTES)
                ids = np.array(self.words.encode_batch_fast([SPACE + text.replace("\n", "\n" + SPACE)], add_special_tokens=False)[0].ids, dtype="<u4")
                cuts = np.flatnonzero(self.begins[ids])
                if len(cuts) != len(part):
                    raise ValueError("a word has not one token that begins with its space")
                yield ids, np.diff(cuts, append=len(ids))

    def _learn_words(self, words: list[str]) -> None:
        """Words of letters with a space before."""
        words = sorted(words, key=lambda w: not w.isascii())
        done = 0
        for ids, counts in self._encoded_words([w.encode() for w in words]):
            data, ends = ids.tobytes(), np.cumsum(counts) * 4
            self.known.update(zip(words[done : done + len(ends)], [data[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]))
            done += len(ends)

    def _learn(self, memo: dict, pieces: set[str], prefix: str) -> None:
        """Encodes the pieces not met before, many in one text of lines: a line break between two characters that are no
        white space is a token of its own. Words and the marks behind them are encoded apart. Pieces with white space at an end
        or a line break inside go one by one."""
        new = pieces.difference(memo)  # looks each piece up, as the memo is the larger one
        if len(memo) + len(new) > MEMO:
            memo.clear()
            new = pieces
        good, alone, words, marked, lines = [], [], [], [], []
        apart, known = bool(prefix and self.words), self.known
        for p in new:
            w = p.rstrip(MARKS) if apart else ""
            if w.isalpha() and (w.isascii() or MARKED.fullmatch(w)) and (self.tame or not self.special.search(p)):
                if len(w) < len(p):
                    marked.append((p, w, p[len(w) :]))
                else:
                    words.append(p)
            elif prefix and p[:1] == "\n":
                lines.append(p)
            elif not p or p[0].isspace() or p[-1].isspace():
                memo[p] = None  # the text has white space that pieces can't show
            elif "\n" in p or "\r" in p or self.special.search(p):
                alone.append(p)
            else:
                good.append(p)
        if lines or marked:
            self._learn(self.first, {p[1:] for p in lines} | {mark for _, _, mark in marked}, "")
        if words or marked:
            needed = {w for _, w, _ in marked}.union(words)
            unmet = needed.difference(known)
            if len(known) + len(unmet) > WORDS:
                known.clear()
                unmet = needed
            self._learn_words(list(unmet))
            memo.update((p, known[p]) for p in words)
            first = self.first
            memo.update((p, known[w] + first[mark]) for p, w, mark in marked)
        for p in lines:
            rest = self.first[p[1:]] if len(p) > 1 else b""
            memo[p] = None if rest is None else self.line_bytes + rest
        for p, e in zip(alone, self.tokenizer.encode_batch_fast([prefix + p for p in alone], add_special_tokens=False)):
            memo[p] = np.array(e.ids, dtype="<u4").tobytes()
        for i in range(0, len(good), 4096):
            part = good[i : i + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([("\n" + prefix).join(["", *part, ""])], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(ids == self.line)
            data, cuts = ids.tobytes(), (ends * 4).tolist()
            if prefix:  # the last break is followed by the prefix alone
                cuts = cuts[: len(part) + 1]
            if len(cuts) != len(part) + 1:
                raise ValueError("a line break is no token of its own")
            memo.update((p, data[a + 4 : b]) for p, a, b in zip(part, cuts, cuts[1:]))

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.apart:
            return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if not (self.words and self.tame):
            return self.encode_by_dict(texts)
        raw, out, i = [t.encode() for t in texts], [], 0
        while i < len(raw):
            few, size = [], 0
            while i + len(few) < len(raw) and size < SLICE:
                few.append(raw[i + len(few)] if len(raw[i + len(few)]) <= HUGE else b"")
                size += len(few[-1])
            found, whole = self.pieces.encode(few)
            for t, b, w, own in zip(texts[i : i + len(few)], found, whole.tolist(), few):
                if t and not own:
                    b = self.encode_by_dict([t])[0]
                elif w & 1 or w and self.special.search(t):
                    b = self._ids(t)
                out.append(b)
            i += len(few)
        return out

    def learn(self, kind: int, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For Pieces: the ids of new pieces, and how many each has."""
        if kind == WORD:
            order = sorted(range(len(new)), key=lambda i: not new[i].isascii())
            found = list(self._encoded_words([new[i] for i in order]))
            ids = np.concatenate([x for x, _ in found])
            sizes = np.concatenate([c for _, c in found])
            if order == list(range(len(new))):
                return ids, sizes
            begins = np.empty(len(new), np.int64)
            counts = np.empty(len(new), np.int64)
            begins[order], counts[order] = np.cumsum(sizes) - sizes, sizes
            ends = np.cumsum(counts)
            return ids[np.repeat(begins - (ends - counts), counts) + np.arange(len(ids))], counts
        names, found = [p.decode() for p in new], []
        for i in range(0, len(names), MEMO):
            memo: dict[str, bytes | None] = {}
            self._learn(memo, set(names[i : i + MEMO]), " " if kind == LATER else "")
            found += [memo[p] for p in names[i : i + MEMO]]
        return np.frombuffer(b"".join(b or b"" for b in found), dtype="<u4"), np.array([-1 if b is None else len(b) // 4 for b in found], dtype=np.int64)

    def encode_by_dict(self, texts: list[str]) -> list[bytes]:
        """The same for texts of any length, and for tokenizers whose special strings may be words."""
        # A line break begins a piece. Behind a character that is no white space one or two are a token each, unless a
        # space, a special string or nothing follows two: those texts go to the library whole.
        split = []
        for t in texts:
            p = t.replace("\n", " \n")
            whole = "\n \n" in p and ("\n \n " in p or p.endswith("\n \n") or self.special.search(t))
            split.append(["", ""] if whole else p.split(" "))
        later: set[str] = set()
        for s in split:
            later.update(s[1:])
        self._learn(self.later, later, " ")
        self._learn(self.first, {s[0] for s in split}, "")
        out = []
        for t, s in zip(texts, split):
            parts = [self.first[s[0]], *map(self.later.__getitem__, s[1:])]
            if None in parts:
                parts = [self._ids(t)] if t else []
            out.append(b"".join(parts))
        return out


_encoders: dict[tuple, Encoder] = {}


def encoder_of(run: str, path: str) -> Encoder:
    """This worker's encoder in a run of the operator: what it has learnt in a task serves the run's next one."""
    if (run, path) not in _encoders:
        _encoders.clear()
        _encoders[run, path] = Encoder(path)
    return _encoders[run, path]


def table_of(docs: list[tuple[int | None, bytes]]) -> bytes:
    """The document table of a frame. docs: (id, ids as bytes) in order."""
    names = np.array([0 if d is None else d for d, _ in docs], dtype="<i8")
    nulls = np.array([d is None for d, _ in docs], dtype=np.uint8)
    counts = np.array([len(b) // 4 for _, b in docs], dtype="<u8")
    return zlib.compress(names.tobytes() + nulls.tobytes() + counts.tobytes(), 3)


def coded(ids: np.ndarray, block: int) -> tuple[bytes, bytes, bytes]:
    """The coder's header, the block table and the blocks of a frame's ids, as IdCoder.java codes them."""
    model, blocks = id_coder.encode(ids, block)
    sums = np.array([[len(c), zlib.crc32(c, zlib.crc32(ids[i * block : (i + 1) * block]))] for i, c in enumerate(blocks)], dtype="<u4").tobytes()
    return model, sums, b"".join(blocks)


def frame(docs: list[tuple[int | None, bytes]], block: int = BLOCK) -> bytes:
    """One frame: header, document table, the coder's header, block table, blocks."""
    table = table_of(docs)
    model, sums, blocks = coded(np.frombuffer(b"".join(b for _, b in docs), dtype="<u4"), block)
    head = HEAD.pack(MAGIC, len(docs), len(table), len(model), len(sums), len(blocks), 0)[:-4]
    return head + struct.pack("<I", zlib.crc32(head + table + model + sums)) + table + model + sums + blocks


def frame_bytes(f, at: int) -> bytes:
    """All bytes of the frame that starts at ``at``."""
    f.seek(at)
    head = f.read(HEAD.size)
    if len(head) < HEAD.size or head[: len(MAGIC)] != MAGIC:
        raise id_coder.Damaged(f"no sound frame starts at {at}")
    rest = sum(HEAD.unpack(head)[2:6])
    body = f.read(rest)
    if len(body) < rest:
        raise id_coder.Damaged(f"the file ends inside the frame at {at}")
    return head + body


def read_frame(f, at: int) -> tuple[list[int | None], np.ndarray, np.ndarray, int]:
    """(document ids, their numbers of ids, all ids, where the frame ends) of the frame that starts at ``at``; Damaged
    where a checksum differs."""
    f.seek(at)
    head = f.read(HEAD.size)
    if len(head) < HEAD.size:
        raise id_coder.Damaged(f"the file ends inside the header at {at}")
    magic, n_docs, n_table, n_model, n_sums, n_blocks, crc = HEAD.unpack(head)
    tables = f.read(n_table + n_model + n_sums) if magic == MAGIC else b""
    if magic != MAGIC or zlib.crc32(head[:-4] + tables) != crc:
        raise id_coder.Damaged(f"no sound frame starts at {at}")
    raw = zlib.decompress(tables[:n_table])
    names, nulls = np.frombuffer(raw, "<i8", n_docs), np.frombuffer(raw, np.uint8, n_docs, 8 * n_docs)
    counts = np.frombuffer(raw, "<u8", n_docs, 9 * n_docs).astype(np.int64)
    model, sums = tables[n_table : n_table + n_model], np.frombuffer(tables[n_table + n_model :], "<u4").reshape(-1, 2)
    payload = f.read(n_blocks)
    ends = np.cumsum(sums[:, 0], dtype=np.int64)
    coded = [payload[e - n : e] for e, n in zip(ends.tolist(), sums[:, 0].tolist())]
    ids = id_coder.decode(model, coded)
    block = id_coder.block_of(model)
    for i, c in enumerate(coded):
        if zlib.crc32(c, zlib.crc32(np.ascontiguousarray(ids[i * block : (i + 1) * block], dtype="<u4"))) != sums[i, 1]:
            raise id_coder.Damaged(f"block {i} of the frame at {at} differs from its checksum")
    return [None if z else n for n, z in zip(names.tolist(), nulls.tolist())], counts, ids, at + len(head) + len(tables) + n_blocks


def frames(f, size: int) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(document ids, their numbers of ids, all ids) of each frame of a file."""
    at = 0
    while at < size:
        *found, at = read_frame(f, at)
        yield tuple(found)


def write(docs: DataFrame, folder: str, path: str, doc_id: str = "doc_id", text: str = "text", *, end_id: int = 0, block: int = BLOCK, per_frame: int = FRAME, large: int = LARGE) -> DataFrame:
    """Writes the ids of all texts, each with end_id behind it, in order of doc_id; returns the manifest (part, path,
    size, n, cuts: where frames start, counts: their ids). Files follow each other by part. Null texts are empty, null ids
    come first, repeated ids in order of text; other columns aren't read; an empty table gives an empty manifest. A text of
    any length is encoded whole and lies in one frame, so it has to fit a worker; frames of more than ``large`` ids are coded by
    the workers, others by Spark's own tasks. The files are written when this is called."""
    end, name = np.array([end_id], dtype="<u4").tobytes(), uuid.uuid4().hex
    spark = docs.sparkSession

    def packed(held: list[tuple[int | None, bytes]], n: int) -> pa.RecordBatch:
        ids, own = b"".join(b for _, b in held), None
        if n > large:
            model, sums, blocks = coded(np.frombuffer(ids, dtype="<u4"), block)
            ids, own = None, struct.pack("<II", len(model), len(sums)) + model + sums + blocks
        columns = [pa.array([len(held)], pa.int32()), pa.array([n], pa.int64()), *(pa.array([x], pa.binary()) for x in (table_of(held), ids, own))]
        return pa.RecordBatch.from_arrays(columns, names=["docs", "n", "entries", "ids", "coded"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, held, n = encoder_of(name, path), [], 0
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1)
            for i in range(0, len(names), 256):
                part = [t or "" for t in texts.slice(i, 256).to_pylist()]
                for d, b in zip(names[i : i + 256], encoder.encode(part)):
                    held.append((d, b + end))
                    n += len(b) // 4 + 1
                    if n >= per_frame:
                        yield packed(held, n)
                        held, n = [], 0
        if held:
            yield packed(held, n)

    own = pick(docs, doc_id=doc_id, text=text)
    own = own.select(own["doc_id"].cast("long").alias("doc_id"), "text")
    # The driver samples the ranges' keys, so whole texts are none.
    own = own.repartitionByRange("doc_id", F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    call = functions(spark, SOURCES, **RETURNED)["WriteFrame"]
    frames = own.mapInArrow(run, "docs int, n long, entries binary, ids binary, coded binary")
    written = F.call_udf(call, F.lit(folder), "docs", "entries", "ids", F.lit(block), "coded")
    frames = stored(frames.select(F.spark_partition_id().cast("long").alias("part"), "n", written.alias("at")), "frames")
    files = frames.groupBy("part", F.col("at.path").alias("path"))
    files = files.agg(F.sum("at.size").alias("size"), F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("at.cut", "n"))).alias("all"))
    return stored(files.select("part", "path", "size", "n", F.col("all.cut").alias("cuts"), F.col("all.n").alias("counts")), "manifest")


def read(manifest: DataFrame, *, with_ids: bool = False, large: int = LARGE) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of each document of the files; start: all ids before it. A task reads
    a frame or more, wherever its file lies; the driver gets a number for each file only."""
    spark = manifest.sparkSession
    files = sorted(tuple(r) for r in manifest.select("part", "n").collect())
    before = list(accumulate((n for _, n in files), initial=0))
    starts = spark.createDataFrame([(part, at) for (part, _), at in zip(files, before)], "part long, before long")
    order = Window.partitionBy("part").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    cuts = manifest.select("part", "path", F.explode(F.arrays_zip("cuts", "counts")).alias("x")).select("part", "path", F.col("x.cuts").alias("cut"), F.col("x.counts").alias("n"))
    cuts = cuts.withColumn("inside", F.coalesce(F.sum("n").over(order), F.lit(0))).join(starts, "part")
    n, most = cuts.agg(F.count("*"), F.max("n")).first()
    cuts = cuts.select("path", "cut", (F.col("before") + F.col("inside")).alias("start")).repartition(max(1, min(n, 100_000)))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, cut, start in zip(*(batch.column(i).to_pylist() for i in range(3))):
                with opened(path) as f:
                    yield pa.RecordBatch.from_arrays([pa.array([frame_bytes(f, cut)], pa.binary()), pa.array([start], pa.int64())], names=["frame", "start"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, cut, start in zip(*(batch.column(i).to_pylist() for i in range(3))):
                with opened(path) as f:
                    names, counts, ids, _ = read_frame(f, cut)
                ends = np.cumsum(counts)
                own = [ids[e - n : e].astype("<u4") for e, n in zip(ends.tolist(), counts.tolist())]
                cols = [pa.array(names, pa.int64()), pa.array(start + ends - counts), pa.array(counts), pa.array([zlib.crc32(x) for x in own], pa.int64())]
                if with_ids:
                    cols.append(pa.array([x.astype(np.int64) for x in own], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    if with_ids or (most or 0) > large:
        return cuts.mapInArrow(run, ROW + ", ids array<long>" * with_ids)
    call = functions(spark, SOURCES, **RETURNED)["ReadFrame"]
    return cuts.mapInArrow(load, "frame binary, start long").select(F.inline(F.call_udf(call, "frame", "start")))


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return read(write(docs, shared_dir(spark, "ids"), public_tokenizers.path("byte_bpe_50k.json")))
