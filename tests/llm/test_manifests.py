"""Filter audit, packing and Merkle manifest on hostile tables, against brute force."""

import hashlib
import random
import re
import zlib
from itertools import permutations

import duckdb
import numpy as np
import pytest

import __spark_entry__
from weftline.llm import common, filter_audit, merkle, packing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, mask int, part string, grp string, leaf string, ids string, n long"
LONG = " ".join(f"w{i % 977} x{i % 31}\n" for i in range(20_000))


def table():
    rows = [
        (1, "Hello there\nsecond line", "en", "a"), (2, "Hello there\nsecond line", "en", "b"), (2, "Hello there\nsecond line", None, None), (2, "Hello there\nsecond line", None, None),
        (3, None, "en", "a"), (4, "", "de", "a"), (5, "  \n\t", "de", ""), (6, LONG, "en", None), (None, "no id here", "en", "c"), (None, "no id here", "en", "c"), (0, "no id here", "fr", "c"),
        (7, "CAPITALS ARE HERE & THERE", None, "d"), (8, " ".join(f"word{i}" for i in range(250)), "en", "é"), (9, " ".join(["same"] * 300), "en", "Z"), (10, "<|endoftext|> héros ÉDITH 漢字 #1", "fr", "a"),
    ]
    rows += [(100 + i, f"filler {i % 5} text\n" * (i % 90), ["en", "de"][i % 2], ["hot", "hot", f"s{i % 4}"][i % 3]) for i in range(120)]
    return [(*r, len(r[1]) if r[1] else None, 3, "x", "y", "z", "w", 9) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(table(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def brute_audit(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    texts = [(i, t or "", lang or "") for i, t, lang in rows]
    failed = []
    for i, text, part in texts:
        w = re.findall("[^\x20\x09-\x0d]+", text)
        same = [k for k, t, _ in texts if t == text and k is not None]
        x = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search("[#$%&*|]", text)), i is not None and min(same) < i]
        failed.append((part, i, {k for k, f in zip("ABCDE", x, strict=True) if f}))
    out = {}
    for part in {p for _, _, p in texts}:
        mine = [(i, f) for p, i, f in failed if p == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, letter in enumerate(order, 1):
                gone = [(i, f) for i, f in left if letter in f]
                left_now = [(i, f) for i, f in left if letter not in f]
                out[part, order, step] = [
                    len(left_now), len(gone), sum(letter in f for _, f in mine) - len(gone), sum(f == {letter} for _, f in mine),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), 0,
                ]
                left = left_now
        for letter in "ABCDE":
            total = sum(v[1] for (p, o, s), v in out.items() if p == part and o[s - 1] == letter)
            for (p, o, s), v in out.items():
                if p == part and o[s - 1] == letter:
                    v[6] = total
    return sorted(((*k, *v) for k, v in out.items()), key=repr)


LABELS = [(1, 1, 0), (2, 0, 1), (2, None, None), (None, 1, 1), (7, None, 1), (104, 1, 1), (130, 1, 0), (130, 1, 0), (9999, 1, 1)]
AUDIT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(*r, "x", 5) for r in LABELS], "doc_id long, quality int, toxic int, part string, n int")


@pytest.mark.parametrize("broadcasts", [True, False])
def test_audit(docs, labels, broadcasts, monkeypatch):
    if not broadcasts:
        monkeypatch.setattr(common, "fits", lambda small, max_rows: False)
    got = filter_audit.audit(filter_audit.cells(docs, labels))
    assert rows_of(got, *AUDIT) == brute_audit([r[:3] for r in table()], LABELS)
    assert dict(got.dtypes)["shapley"] == "bigint"


def test_audit_of_nothing(docs, empty, labels):
    assert filter_audit.audit(filter_audit.cells(empty, labels)).count() == 0
    got = filter_audit.audit(filter_audit.cells(docs, labels.limit(0)))
    assert got.agg({"good_lost": "sum", "toxic_lost": "sum"}).first()[0] == 0


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def plain_ids(vocabulary):
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(vocabulary)
    one.encode_special_tokens = True
    return lambda text: np.array([*one.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def test_encoder(vocabulary, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    own, plain = packing.Encoder(vocabulary), plain_ids(vocabulary)
    dice = random.Random(7)
    letters = [*" \n\t\r 　\x00\x1c\x85\x01￿abA's12.,!é漢", "'ll", "<|endoftext|>", "  ", "\n\n", " word", "\nword"]
    for block, length in ((1 << 20, 30), (20, 200)):
        monkeypatch.setattr(packing, "BLOCK", block)
        for _ in range(3000):
            text = "".join(dice.choice(letters) for _ in range(dice.randrange(length)))
            assert own.encode(text) == plain(text)[:-1].tobytes(), repr(text)
    every = "".join(packing.MARKS) + " a b"
    assert own.encode(every) == plain(every)[:-1].tobytes()


def test_cut_plans():
    plans = packing.cut_plans(1024)
    assert all(sum(p) == n for n, p in enumerate(plans)) and all(min(p) >= 16 or len(p) == 1 for p in plans[1:])
    lost = [sum((1024 - 1024 // k * k) / (1024 // k) for k in p) for p in plans[1:]]
    assert sum(lost) / sum(range(1, 1025)) < 0.005 and max(map(len, plans)) <= 5


def test_packing(docs, empty, vocabulary):
    plain = plain_ids(vocabulary)
    pieces = packing.pack_documents(docs, vocabulary)
    got = pieces.collect()
    bins = {}
    for r in got:
        assert r["length"] == len(r["ids"]) // 4 > 0
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["ids"]))
    for parts in bins.values():
        parts.sort()
        assert [o for o, _, _ in parts] == [sum(n for _, n, _ in parts[:k]) for k in range(len(parts))] and sum(n for _, n, _ in parts) <= 1024
    # Each document once, whole: pieces of one id that follow each other.
    want = sorted((r[0] if r[0] is not None else -1, plain(r[1]).tobytes()) for r in table())
    found = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["start"], bytes(r["ids"]), r["doc_tokens"]) for r in got)
    assert sorted((r[0], len(r[1]) // 4) for r in want) == sorted((d, n) for d, s, _, n in found if s == 0)
    for doc in {d for d, _ in want}:
        texts = sorted(t for d, t in want if d == doc)
        if len(set(texts)) == 1:
            assert sorted(b for d, _, b, _ in found if d == doc) == sorted(p for p in (texts[0][4 * s : 4 * s + len(b)] for d, s, b, _ in found if d == doc))
    tokens = sum(len(t) // 4 for _, t in want)
    used = [sum(n for _, n, _ in parts) for parts in bins.values()]
    padding = sum(0 if n & (n - 1) == 0 else 1024 - n for n in used)
    assert sum(used) == tokens and padding <= 0.01 * tokens
    whole = {r["sequence_id"]: (r["n_tokens"], bytes(r["ids"])) for r in packing.sequences(pieces).collect()}
    for k, parts in bins.items():
        n, body = whole[k]
        assert body[: 4 * n] == b"".join(bytes(b) for _, _, b in parts) and len(body) == (4 * n if n & (n - 1) == 0 else 4096) and not any(body[4 * n :])
    assert packing.pack_documents(empty, vocabulary).count() == 0


def test_packing_again(docs, vocabulary):
    columns = ["doc_id", "start", "length", "sequence_id", "offset"]
    table_ = common.written(docs)
    assert rows_of(packing.pack_documents(table_, vocabulary), *columns) == rows_of(packing.pack_documents(table_, vocabulary), *columns)


def test_bins_take_a_fixed_number():
    bins, out = packing.Bins(0, 16), []
    for k in range(11):
        out += bins.add(k, 0, bytes(4 * 5), 5)
    assert [(d, s, q) for d, _, _, _, s, q in out] == [(k, k // 3, k % 3 * 5) for k in range(9)]
    rest = list(bins.finish())
    assert [(d, start, len(ids) // 4, s, q) for d, start, ids, _, s, q in rest] == [(9, 0, 5, 3, 0), (10, 0, 3, 3, 5), (10, 3, 2, 4, 0)]


def sha(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def brute_leaf(row, text):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha(*map(field, (row[0], row[3], row[2], row[4], text)))


def brute_tree(leaves):
    levels = [list(leaves)]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][k : k + 3]) for k in range(0, len(levels[-1]), 3)])
    return levels


def brute_path(levels, i):
    for row in levels[:-1]:
        yield row[i - i % 3 : i], row[i + 1 : i - i % 3 + 3]
        i //= 3


def brute_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, brute_leaf(r, r[1]), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda x: x[:3])
        trees[s] = brute_tree([x[2] for x in groups[s]])
    top = brute_tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (_, _, leaf, r) in enumerate(groups[s]):
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            folded, siblings = brute_leaf(r, r[1].replace("\n", "")) if even and r[1] is not None else leaf, []
            for before, after in [*brute_path(trees[s], i), *brute_path(top, k)]:
                folded = sha(*before, folded, *after)
                siblings += before + after
            out.append((r[0], leaf, trees[s][-1][0], top[-1][0], sha(*siblings), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


MANIFEST = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def proofs_of(docs):
    proofs, nodes = merkle.manifest(docs)
    siblings = merkle.F.array_join(merkle.F.transform("path", lambda s: merkle.F.concat(s["before"], s["after"])), "")
    out = proofs.select("doc_id", "leaf", "subroot", "root", merkle.F.sha2(siblings, 256).alias("proof_sha256"), merkle.fold(merkle.F.col("tampered"), merkle.F.col("path")).alias("folded_root"))
    return out.withColumn("verified", merkle.F.col("folded_root") == merkle.F.col("root")), nodes


@pytest.mark.parametrize("leaves, near, broadcasts", [(50_000, 64, True), (10, 2, True), (4, 3, False)])
def test_manifest(docs, leaves, near, broadcasts, monkeypatch):
    monkeypatch.setattr(merkle, "LEAVES", leaves)
    monkeypatch.setattr(merkle, "NEAR", near)
    if not broadcasts:
        monkeypatch.setattr(common, "fits", lambda small, max_rows: False)
    proofs, nodes = proofs_of(docs)
    got = sorted((tuple(r[c] for c in MANIFEST) for r in proofs.collect()), key=repr)
    assert got == brute_manifest(table())
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)
    # The records are all nodes above the leaves, each once, and lone leaves.
    groups, want = {}, []
    for r in table():
        groups.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, brute_leaf(r, r[1])))
    for s, rows in groups.items():
        levels = brute_tree([x[2] for x in sorted(rows)])
        want += [("" if s is None else f"={s}", k, i, d) for k, row in enumerate(levels) for i, d in enumerate(row) if k or len(levels) == 1]
    assert rows_of(nodes.where("grp is not null"), "grp", "level", "idx", "digest") == sorted(want, key=repr)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 9, 10, 28])
def test_manifest_sizes(spark, n, monkeypatch):
    monkeypatch.setattr(merkle, "LEAVES", 4)
    rows = [(i, f"a\n{i}", None, "one", i) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((tuple(r[c] for c in MANIFEST) for r in proofs_of(docs)[0].collect()), key=repr) == brute_manifest(rows)


def test_manifest_of_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEAVES", 5)
    rows = [(7, "same", "en", "one", 4)] * 40 + [(None, None, None, None, None)] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(6)
    assert sorted((tuple(r[c] for c in MANIFEST) for r in proofs_of(docs)[0].collect()), key=repr) == brute_manifest(rows)


@pytest.mark.parametrize("name", ["op11_filter_audit", "op13_merkle_manifest"])
def test_query_equals_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in ("documents", "labels"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    found = db.sql(__spark_entry__.oracle_sql()[name])
    df = __spark_entry__.queries()[name](spark, folder)
    assert sorted(found.columns) == sorted(df.columns)
    columns = list(found.columns)
    assert rows_of(df, *columns) == sorted(found.fetchall(), key=repr)
