"""Token counts by a given tokenizer; huge documents by overlapping chunks that are spliced where they agree."""

from __future__ import annotations

import json
import re
import unicodedata
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from clusterloom.llm.common import pick

#: Chunks of huge documents, in characters: their length, and the overlap that the first try has.
CHUNK, OVERLAP = 16_384, 256
#: Documents longer than this are huge.
HUGE = 32_768
#: Tokens that both encodings must have alike on either side of a splice.
AGREE = 3
#: Runs whose counts a worker remembers at most, and bytes of text that it handles at a time.
MEMO, SLICE = 2_000_000, 4 << 20
#: A word of letters, which are such in every version of Unicode, and marks, without the apostrophe and the sign that
#: begins special strings: patterns part both.
MARKED = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:;=?@\[-`{-~]*)")
END = "</w>"


def byte_letters() -> dict[int, str]:
    """The letter by which byte-level models name each byte; a line break stays, it parts lines."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden) if b != 10}


BYTES = byte_letters()


def spans(tokenizer, text: str) -> list[tuple[int, int, int]]:
    """(start, end, id) of the tokens of a text, by characters."""
    e = tokenizer.encode(text, add_special_tokens=False)
    return [(a, b, i) for (a, b), i in zip(e.offsets, e.ids)]


def stable(text: str, at: int) -> bool:
    """Nothing that tokenizers match or normalise reaches over this place: white space, then a starting character."""
    return 0 < at < len(text) and text[at - 1] in " \t\n\r\x0b\x0c" and not text[at].isspace() and not unicodedata.combining(text[at])


def splice(text: str, left: list, right: list, low: int, high: int) -> tuple[int, int] | None:
    """Numbers of tokens (kept of left, dropped of right) at the common boundary nearest the middle of [low, high).

    A boundary is proven if the place is stable() and AGREE tokens before it and after it are the same in both, spans
    and ids. None if there is no such place.
    """
    at_right = {t[0]: j for j, t in reversed(list(enumerate(right)))}  # a character may have several tokens: the first
    found = []
    for i in range(AGREE, len(left) - AGREE + 1):
        start = left[i][0]
        if low <= start < high and left[i - 1][0] < start and (j := at_right.get(start)) is not None and j >= AGREE and stable(text, start):
            if left[i - AGREE : i + AGREE] == right[j - AGREE : j + AGREE]:
                found.append((abs(2 * start - low - high), i, j))
    return min(found)[1:] if found else None


class _Part:
    """The tokens first..last of an encoded stretch of a text, with the spans of those that are asked for."""

    def __init__(self, tokenizer, text: str, start: int, to: int):
        self.encoded, self.start = tokenizer.encode(text[start:to], add_special_tokens=False), start
        self.ids, self.first, self.last = self.encoded.ids, 0, len(self.encoded)

    def span(self, i: int) -> tuple[int, int, int]:
        a, b = self.encoded.token_to_chars(i)
        return a + self.start, b + self.start, self.ids[i]

    def spans(self) -> list[tuple[int, int, int]]:
        return [self.span(i) for i in range(self.first, self.last)]

    def head(self, high: int) -> list[tuple[int, int, int]]:
        """The tokens that start before a place, and AGREE more."""
        out, more = [], AGREE
        for i in range(self.first, self.last):
            out.append(self.span(i))
            if out[-1][0] >= high:
                more -= 1
                if not more:
                    break
        return out

    def tail(self, low: int) -> list[tuple[int, int, int]]:
        """The tokens that start at a place or behind it, and AGREE before them."""
        out, more = [], AGREE
        for i in range(self.last - 1, self.first - 1, -1):
            out.append(self.span(i))
            if out[-1][0] < low:
                more -= 1
                if not more:
                    break
        return out[::-1]


def _settled(tokenizer, text: str, chunk: int, overlap: int) -> Iterator[tuple[_Part, int]]:
    """The parts of a whole text that nothing can change any more, each with how often an overlap was widened for it.

    When two chunks share no proven boundary the next one starts earlier, by twice the overlap each time; once it
    would start where the one before did, the two are encoded as one.
    """
    tokens, last, end = _Part(tokenizer, text, 0, chunk), 0, min(chunk, len(text))  # last: start of the last chunk's own tokens
    while end < len(text):
        back, to, widened = overlap, min(len(text), end + chunk), 0
        while True:
            start = max(last, end - back)
            part, done = _Part(tokenizer, text, start, to), None
            if start == last:  # both in one; what lies before is settled
                tokens = part
                break
            # Only tokens of the last chunk take part, so a splice never reaches behind the one before.
            left = tokens.tail(start)
            if cut := splice(text, left, part.head(end), start, end):
                done, tokens = tokens, part
                done.last += cut[0] - len(left)
                tokens.first = cut[1]
                last = tokens.span(tokens.first)[0]
                break
            back, widened = 2 * back, widened + 1
        yield done, widened
        end = to
    yield tokens, 0


def settled(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[tuple[list[tuple[int, int, int]], int]]:
    """The spans of a whole text, in parts that nothing can change any more, each with how often an overlap was widened
    for it. Only the last chunk's spans are held."""
    for part, widened in _settled(tokenizer, text, chunk, overlap):
        yield part.spans() if part else [], widened


def encode_huge(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[list[tuple[int, int, int]], int, int]:
    """The spans of a whole text, the number of chunks, and how often an overlap had to be widened."""
    parts = list(settled(tokenizer, text, chunk, overlap))
    return [t for p, _ in parts for t in p], len(parts), sum(w for _, w in parts)


def runs_apart(config: dict) -> bool:
    """Whether this tokenizer encodes each run without ASCII white space by itself: white space is dropped before
    words are looked for, no pattern reaches over it, and no special string has any."""
    pre = config.get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    pattern = (first.get("pattern") or {}).get("Regex", "")
    norms = config.get("normalizer") or {"type": "Sequence", "normalizers": []}
    kinds = {n["type"] for n in norms.get("normalizers", [norms])}
    return (
        first.get("type") == "Split"
        and first.get("behavior") == "Removed"
        and bool(first.get("invert"))
        and pattern.endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        and kinds <= {"NFC", "Replace", "Lowercase"}
        and not config.get("post_processor")
        and all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"])) for t in config.get("added_tokens", []))
    )


class Counter:
    """Counts tokens as the library gives them. Where runs_apart() holds, boundaries can be proven: texts of more than
    ``huge`` characters are encoded in chunks, and a run that the worker has met before isn't encoded again. Other
    tokenizers encode every text whole."""

    def __init__(self, path: str, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.apart = runs_apart(config)
        self.words = self._word_model(config, Tokenizer) if self.apart else None
        self.huge, self.chunk, self.overlap, self.memo = huge, chunk, overlap, {}

    def _word_model(self, config: dict, tokenizer):
        """The model alone, for lines that are words of small letters: rules and patterns would keep each whole, and only
        their last tokens end as words do. None where that is not so."""
        model, steps = config["model"], config["pre_tokenizer"].get("pretokenizers", [])
        plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback"))
        lowered = any(n["type"] == "Lowercase" for n in (config.get("normalizer") or {}).get("normalizers", []))
        replaced = [n for n in (config.get("normalizer") or {}).get("normalizers", []) if n["type"] == "Replace" and n["pattern"] != {"Regex": r"\s+"}]
        special = [t["content"] for t in config.get("added_tokens", []) if not t["content"].startswith("<")]
        whole = len(steps) == 2 and steps[1].get("type") == "ByteLevel" and not steps[1].get("use_regex") and not steps[1].get("add_prefix_space")
        if not (plain and lowered and whole) or replaced or special or model.get("end_of_word_suffix") != END:
            return None
        lean = tokenizer.from_str(json.dumps(config | {"normalizer": None, "pre_tokenizer": {"type": "CharDelimiterSplit", "delimiter": "\n"}, "added_tokens": [], "truncation": None, "padding": None}))
        vocab = lean.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocab.items() if token.endswith(END)]] = True
        return lean

    def _learn(self, new: set[bytes]) -> None:
        """Counts the tokens of runs. Words and the marks behind them are counted apart."""
        todo, words, marked = [], {}, []
        for x in new:
            if self.words and (m := MARKED.fullmatch(x.decode())):
                word, mark = m.groups()
                marked.append((x, word, mark.encode()))
                words[word] = 0
            else:
                todo.append(x)
        todo += {mark for _, _, mark in marked if mark} - self.memo.keys() - set(todo)
        for i in range(0, len(todo), 4096):
            part = todo[i : i + 4096]
            self.memo.update(zip(part, map(len, self.tokenizer.encode_batch_fast([x.decode() for x in part], add_special_tokens=False))))
        apart = list(words)
        for i in range(0, len(apart), 4096):
            part = apart[i : i + 4096]
            lines = "\n".join(part).lower().encode().decode("latin-1").translate(BYTES)
            ends = np.flatnonzero(self.ends[self.words.encode_batch_fast([lines], add_special_tokens=False)[0].ids])
            if len(ends) != len(part):
                raise ValueError("a word has not one token that ends as words do")
            words.update(zip(part, np.diff(ends, prepend=-1).tolist()))
        self.memo.update((x, words[word] + (self.memo[mark] if mark else 0)) for x, word, mark in marked)

    def whole(self, texts: list[bytes]) -> list[int]:
        if not self.apart:
            return [len(e) for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
        runs = [t.split() for t in texts]
        new: set[bytes] = set()
        for r in runs:
            new.update(r)
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
            self._learn(new)
        else:
            self._learn(new - self.memo.keys())
        get = self.memo.__getitem__
        return [sum(map(get, r)) for r in runs]

    def count(self, texts: Iterable[bytes]) -> Iterator[tuple[int, int]]:
        """(tokens, chunks) of each text, in order."""
        small: list[bytes] = []
        order: list[tuple[int, int] | None] = []
        for t in texts:
            if self.apart and len(t) > self.huge and len(s := t.decode()) > self.huge:
                n = chunks = 0
                for part, _ in _settled(self.tokenizer, s, self.chunk, self.overlap):
                    n, chunks = n + (part.last - part.first if part else 0), chunks + 1
                order.append((n, chunks))
            else:
                small.append(t)
                order.append(None)
        counts = iter(self.whole(small))
        return ((next(counts), 1) if x is None else x for x in order)


_counters: dict[tuple, Counter] = {}


def counter_of(run: str, *how) -> Counter:
    """This worker's counter in a run of the operator: what it has counted in a task serves the run's next one."""
    if (run, *how) not in _counters:
        _counters.clear()
        _counters[run, *how] = Counter(*how)
    return _counters[run, *how]


def count_tokens(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", *, limit: int = 2048, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, n_chunks), a row for each row of docs; ``path``: a tokenizer's JSON file.

    Null texts count as empty (0 bytes, 0 tokens). Repeated rows each give a row, null ids stay, other columns aren't
    read, an empty table gives none. The result equals the library's encoding of each whole text; over_limit holds
    when there are more than ``limit`` tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(name, path, huge, chunk, overlap)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            done = 0
            while done < len(ids):
                part, size = [], 0
                while done + len(part) < len(ids) and size < SLICE:
                    t = texts[done + len(part)].as_py() or b""
                    part.append(t)
                    size += len(t)
                got = list(counter.count(part))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(done, len(part)),
                        pa.array([len(t) for t in part], pa.int64()),
                        pa.array([n for n, _ in got], pa.int64()),
                        pa.array([n > limit for n, _ in got], pa.bool_()),
                        pa.array([c for _, c in got], pa.int64()),
                    ],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit", "n_chunks"],
                )
                done += len(part)

    name = uuid.uuid4().hex
    own = pick(docs, doc_id=doc_id, text=text)
    kind = own.schema["doc_id"].dataType.simpleString()
    own = own.select("doc_id", own["text"].cast("binary").alias("text"))
    return own.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, n_chunks long")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))
