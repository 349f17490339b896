import hashlib
import os
import random
import zlib

from clusterloom.llm import warc
from clusterloom.llm.common import shared_dir


def rows_by_brute_force(pages, least=100):
    out = []
    for page_id, _, html in pages:
        b = (html or "").encode()
        same = [p for p, _, h in pages if (h or "").encode() == b]
        first = min(same)
        again = len(b) >= least and first != page_id
        out.append((page_id, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out)


def test_round_trip_over_tiny_splits(spark):
    rng = random.Random(3)
    texts = ["", None, "x" * 99, "y" * 100, "é" * 70, "<p>\r\n\r\n</p>" * 30] + ["".join(rng.choices("ab<>", k=rng.randrange(5000))) for _ in range(20)]
    pages = [(i, rng.choice([None, "http://a.b/\r\nX: y", "https://é.com/ä?q"]), rng.choice(texts)) for i in range(120)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    manifest = warc.write(df, shared_dir(spark, "warc"))
    want = rows_by_brute_force(pages)
    for split in (3001, 8 << 20):
        got = warc.read(manifest, split=split, payloads=True).collect()
        assert sorted(tuple(r)[:5] for r in got) == want
    by_id = {p: (h or "").encode() for p, _, h in pages}
    assert all(r["payload"] is None if r["record_type"] == "revisit" else bytes(r["payload"]) == by_id[r["page_id"]] for r in got)
    assert warc.read(warc.write(df.limit(0), shared_dir(spark, "warc"))).count() == 0


def test_embedded_archives_are_not_records(spark, tmp_path):
    """A payload that holds archives, in stored blocks and not, adds no records, whatever the range."""
    inner = warc.member(7, None, os.urandom(300), "0" * 64, None)
    body = os.urandom(500) + inner + os.urandom(500)
    own = warc.member(1, None, body, hashlib.sha256(body).hexdigest(), None) + warc.member(2, None, b"z", hashlib.sha256(b"z").hexdigest(), None)
    stored = zlib.compressobj(0, zlib.DEFLATED, 31)
    raw = stored.compress(b"WARC/1.1\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n") + stored.flush()
    path = tmp_path / "a.warc.gz"
    for data in (own, raw + own):
        path.write_bytes(data)
        for split in (50, 333, 10**6):
            found = []
            for start in range(0, len(data), split):
                with open(path, "rb") as f:
                    found += [at for at, _ in warc.Members(f, len(data), start, min(len(data), start + split))]
            assert len(found) == (2 if data is own else 3), split


def test_damage_is_an_error(spark):
    """A flipped byte in any record is found, whatever the range; so is a cut file."""
    import pytest

    page = lambda i: bytes(random.Random(i).choices(b"abc<> ", k=400))
    whole = b"".join(warc.member(i, "http://a.b/", page(i), hashlib.sha256(page(i)).hexdigest(), None) for i in range(9))

    class File:
        def __init__(self, data):
            self.data, self.at = data, 0

        def seek(self, at):
            self.at = at

        def read(self, n):
            self.at += n
            return self.data[self.at - n : self.at]

    def read(data, split):
        return [at for s in range(0, len(data), split) for at, _ in warc.Members(File(data), len(data), s, min(len(data), s + split))]

    for split in (70, 301, 1 << 20):
        assert len(read(whole, split)) == 9
        for at in range(0, len(whole), 61):
            bad = bytearray(whole)
            bad[at] ^= 0x5A
            try:
                found = read(bytes(bad), split)
            except warc.Damaged:
                continue
            # Bytes of gzip headers that carry nothing (time, system) may change.
            assert len(found) == 9, (split, at)
        with pytest.raises(warc.Damaged):
            read(whole[:-20], split)


def test_long_urls_null_ids_and_repeated_pages(spark):
    pages = [(1, "http://a.b/" + "é" * 12_000, "x" * 200), (1, "http://a.b/", "x" * 200), (2, None, "x" * 200), (None, "u", "x" * 200), (None, "u", None), (3, "http://c.d/" + "y" * 100_000, "z" * 100)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 as payload", "2 as key", "3 as digest")
    got = warc.read(warc.write(df, shared_dir(spark, "warc"))).collect()
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got) == sorted(
        [("1", 200, "response", None), ("1", 200, "response", None), ("2", 200, "revisit", 1), ("None", 200, "revisit", 1), ("None", 0, "response", None), ("3", 100, "response", None)]
    )
    assert max(len(r["target_uri"] or "") for r in got) > 100_000
