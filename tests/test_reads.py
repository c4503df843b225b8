"""Files of records: the same rows for any split, places of broken ones, mates."""

import gzip
import random

import pytest

from weftline.sources import reads


def random_records(dice, n):
    out = []
    for k in range(n):
        size = dice.choice([0, 1, 5, 30, 300])
        qual = "".join(chr(dice.randrange(33, 74)) for _ in range(size))
        if size and dice.random() < 0.5:
            qual = dice.choice("@+") + qual[1:]
        out.append((f"r{k}", "a comment" if k % 3 == 0 else None, "".join(dice.choice("ACGTN") for _ in range(size)), qual))
    return out


def text_of(rows):
    return "".join(f"@{a}{' ' + b if b else ''}\n{c}\n+{a if len(c) % 2 else ''}\n{d}\n" for a, b, c, d in rows).encode()


@pytest.mark.parametrize("kind", ["text", "blocks"])
def test_any_range_gives_the_same_records(tmp_path, monkeypatch, kind):
    dice = random.Random(3)
    for trial in range(25):
        monkeypatch.setattr(reads, "BLOCK", dice.choice([50, 400, 0xFF00]))
        rows = random_records(dice, dice.randrange(1, 50))
        text = text_of(rows)
        text = text.replace(b"\n", b"\r\n") if trial % 5 == 0 else text + b"\n" if trial % 5 == 1 else text
        data = text if kind == "text" else b"".join(reads.compressed_blocks(iter([text])))
        path = tmp_path / f"{trial}"
        path.write_bytes(data)
        for split in (1, 7, 50, 333, 1 << 20):
            got, places = [], []
            for at in range(0, len(data), split):
                for place, body in reads.records(reads.KINDS[kind](str(path)), at, min(at + split, len(data)), step=dice.choice([3, 64, 1 << 16])):
                    got.append((body[0][1:].decode().partition(" ")[0], body[1].decode(), body[3].decode()))
                    places.append(place)
            assert got == [(a, c, d) for a, _, c, d in rows] and places == sorted(set(places))


def test_read_and_write(spark, tmp_path):
    rows = random_records(random.Random(9), 400)
    df = spark.createDataFrame(rows, "name string, comment string, seq string, qual string").repartition(3)
    for blocks in (True, False):
        folder = str(tmp_path / f"out{blocks}")
        reads.write_reads(df, folder, blocks)
        back = reads.read_reads(spark, folder, split=500)
        assert sorted(map(tuple, back.select("name", "comment", "seq", "qual").collect()), key=repr) == sorted(rows, key=repr)
        assert back.select("file").distinct().count() == 3 and back.rdd.getNumPartitions() > 6
        reads.write_reads(df.limit(5), folder, blocks)
        assert reads.read_reads(spark, folder).count() == 405
    whole = gzip.decompress(b"".join(p.read_bytes() for p in sorted((tmp_path / "outTrue").iterdir()) if p.suffix == ".gz"))
    assert whole.count(b"\n+\n") == 405
    (tmp_path / "plain.gz").write_bytes(gzip.compress(text_of(rows)) + gzip.compress(text_of(rows[:3])))
    assert reads.read_reads(spark, str(tmp_path / "plain.gz"), split=100).count() == 403


@pytest.mark.parametrize("cut, split", [("@b\nAC\n+\n", 4), ("@b\nAC\n", 4), ("@b\nACG\n+\nII\n", 1 << 20), ("b\nAC\n+\nII\n", 4), ("@b\nAC\n+\nII\n@c", 6)])
def test_a_cut_record_fails_with_its_place(spark, tmp_path, cut, split):
    whole = "@a\nACGT\n+\nIIII\n" * 3
    path = tmp_path / "cut.fq"
    path.write_text(whole + cut)
    place = len(whole) + (11 if cut.endswith("@c") else 0)
    with pytest.raises(Exception, match=f"no whole record at {place}"):
        reads.read_reads(spark, str(path), split).collect()


def test_a_cut_block_fails(spark, tmp_path):
    data = b"".join(reads.compressed_blocks(iter([text_of(random_records(random.Random(1), 50))])))
    (tmp_path / "cut.gz").write_bytes(data[: len(data) // 2])
    with pytest.raises(Exception, match="no whole block"):
        reads.read_reads(spark, str(tmp_path / "cut.gz")).collect()


def test_unwritable(spark, tmp_path):
    df = spark.createDataFrame([("a", "", "AC", "I")], "name string, comment string, seq string, qual string")
    with pytest.raises(Exception, match="no record of four lines"):
        reads.write_reads(df, str(tmp_path / "bad"))
    assert [p.name for p in (tmp_path / "bad").iterdir() if not p.name.startswith("_")] == []


def test_mates(spark):
    schema = "name string, comment string, seq string, qual string, file string, at long"
    one = spark.createDataFrame([("a/1", None, "AC", "I!", "f", 0), ("b/1", None, "", "", "f", 9)], schema)
    two = spark.createDataFrame([("b/2", None, "G", "5", "g", 0), ("a/2", None, "TT", "JJ", "g", 9)], schema)
    got = sorted(map(tuple, reads.unaligned(one, two, "s").collect()))
    assert got == [("a", 1, "AC", [40, 0], "s"), ("a", 2, "TT", [41, 41], "s"), ("b", 1, "", [], "s"), ("b", 2, "G", [20], "s")]
    assert sorted(map(tuple, reads.unaligned(one, None, "s").collect()))[0] == ("a/1", 0, "AC", [40, 0], "s")
    with pytest.raises(Exception, match="not one pair: a"):
        reads.unaligned(one, two.where("name <> 'a/2'"), "s").collect()


def test_ranges_do_not_grow_with_the_files(spark, tmp_path, monkeypatch):
    """Ranges are as asked for up to a number, and then longer; mates meet without lists of them or of numbers."""
    rows = random_records(random.Random(2), 300)
    for k in range(2):
        (tmp_path / f"{k}.fq").write_bytes(text_of(rows))
    monkeypatch.setattr(reads, "RANGES", 20)
    spans = reads.ReadsReader({"path": str(tmp_path), "split": "16"}).partitions()
    assert 10 < len(spans) <= 22
    got = [tuple(r) for s in spans for batch in reads.ReadsReader({"path": str(tmp_path)}).read(s) for r in zip(*(c.to_pylist() for c in batch.columns[:4]))]
    assert sorted(got, key=repr) == sorted(rows * 2, key=repr)
    df = spark.createDataFrame(rows, "name string, comment string, seq string, qual string")
    assert "collect_list" not in reads.unaligned(df, df, "s")._jdf.queryExecution().executedPlan().toString()
