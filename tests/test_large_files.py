"""The inventory of files (SRC2) whose content is too large for a row."""

import hashlib
import random

from glyphfold.sources import files as FS


def test_files_beyond_a_row(spark, tmp_path):
    rng = random.Random(4)
    contents = {
        "empty.bin": b"",
        "feed.bin": b"\n",
        "feeds.bin": b"\n\n\r\n\r",
        "mark.bin": b"\xef\xbb\xbfabc\ndef\n",
        "mark_open.bin": b"\xef\xbb\xbfabc\ndef",
        "only_mark.bin": b"\xef\xbb\xbf",
        "short.bin": b"ab",
        "no feed.bin": bytes(b for b in rng.randbytes(70_000) if b != 10),
        "bytes.bin": rng.randbytes(300_000),
        "lines.bin": b"".join(rng.randbytes(rng.randrange(9)) + b"\n" for _ in range(50_000)),
    }
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    names = {"spark.sql.sources.binaryFile.maxLength": "1000", "spark.sql.files.maxPartitionBytes": "20000"}
    before = {name: spark.conf.get(name) for name in names}
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        found = {r.path.rsplit("/", 1)[-1]: r for r in FS.inventory_folder(spark, str(tmp_path), "*.bin").collect()}
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    # Spark lists no empty file.
    assert set(found) == set(contents) - {"empty.bin"}
    del contents["empty.bin"]
    for name, content in contents.items():
        r = found[name]
        want = (content[:5].decode("latin-1"), len(content), hashlib.sha256(content).hexdigest())
        assert (r.signature, r.length, r.sha256) == want, name


def test_packed_files_are_hashed_as_they_lie(spark, tmp_path):
    import gzip

    (tmp_path / "a.gz").write_bytes(gzip.compress(b"abc\n" * 100))
    (tmp_path / "b.txt").write_bytes(b"abc\n")
    found = {r.path.rsplit("/", 1)[-1]: r.sha256 for r in FS.inventory_folder(spark, str(tmp_path)).collect()}
    assert found == {n: hashlib.sha256((tmp_path / n).read_bytes()).hexdigest() for n in ("a.gz", "b.txt")}
