"""Edit strings, coverage, left alignment, consensus and exact tests against brute force."""

import math
import random
import re
from collections import Counter, defaultdict
from decimal import Decimal, getcontext

import pytest
from pyspark.sql import functions as F

from weftline.functions import exact
from weftline.operators import alignment, barcodes, calling, coverage, edits, ordering, variants

READ, REFERENCE, ALIGNED = set("M=XIS"), set("M=XDN"), set("M=X")


def ops_of(text):
    return [(int(n), o) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", text or "")]


def text_of(ops):
    out = []
    for n, o in ops:
        if n and out and out[-1][1] == o:
            out[-1] = (out[-1][0] + n, o)
        elif n:
            out.append((n, o))
    return "".join(f"{n}{o}" for n, o in out)


def walk(pos, text):
    """(op, position or None, letter index or None) for each unit of an edit string."""
    at, read = pos, 0
    for n, o in ops_of(text):
        for _ in range(n):
            yield o, at if o in REFERENCE else None, read if o in READ else None
            at, read = at + (o in REFERENCE), read + (o in READ)


def random_edits(dice):
    core = [(dice.randint(1, 6), "M")]
    for _ in range(dice.randrange(4)):
        core += [(dice.randint(1, 4), dice.choice("IDNXP=")), (dice.randint(1, 6), dice.choice("MM=X"))]
    front = dice.choice([[], [(2, "S")], [(3, "H")], [(1, "H"), (2, "S")]])
    back = dice.choice([[], [(3, "S")], [(2, "H")], [(2, "S"), (1, "H")]])
    return text_of([*front, *core, *back])


@pytest.fixture(scope="module")
def records(spark):
    dice, rows = random.Random(5), []
    for k in range(300):
        text = random_edits(dice) if k % 20 else dice.choice([None, "*"])
        n = sum(m for m, o in ops_of(text) if o in READ)
        rows.append((k, dice.choice(["a", "b"]), dice.randint(1, 60), dice.randrange(5), dice.random() < 0.5, text, "".join(dice.choice("ACGTNacgt") for _ in range(n)), [dice.randrange(40) for _ in range(n)]))
    return rows, spark.createDataFrame(rows, "name int, contig string, pos long, mapq int, reverse boolean, edits string, seq string, quals array<int>").repartition(3).cache()


def test_parse(spark):
    df = spark.createDataFrame([("8M2I5M100N7M",), (None,), ("*",), ("3M0D2M",)], "e string")
    got = [[tuple(o) for o in r[0]] for r in df.select(edits.parse(F.col("e"))).collect()]
    assert got == [[(8, "M"), (2, "I"), (5, "M"), (100, "N"), (7, "M")], [], [], [(3, "M"), (0, "D"), (2, "M")]]
    assert [r[0] for r in df.select(edits.text(edits.parse(F.col("e")))).collect()] == ["8M2I5M100N7M", None, None, "5M"]
    assert [(r[0], r[1]) for r in df.select(edits.read_length(edits.parse(F.col("e"))), edits.reference_length(edits.parse(F.col("e")))).collect()] == [(22, 120), (0, 0), (0, 0), (5, 5)]
    for bad in ("8", "M", "3M x", "3Q", ""):
        with pytest.raises(Exception, match="no edit string"):
            spark.createDataFrame([(bad,)], "e string").select(edits.parse(F.col("e"))).collect()


@pytest.mark.parametrize("most", [4, 5000])
def test_pileup(records, most):
    rows, df = records
    seen = defaultdict(list)
    for name, contig, pos, mapq, _, text, seq, quals in rows:
        for o, at, read in walk(pos, text) if mapq >= 1 else ():
            if o == "D":
                seen[contig, at].append((name, "*", -1))
            elif o in ALIGNED and quals[read] >= 13:
                seen[contig, at].append((name, seq[read], quals[read]))
    want = []
    for (contig, at), found in seen.items():
        count = Counter(x[1].upper() for x in sorted(found)[:most])
        want.append((contig, at, *[count[c] for c in "ACGT"], count["N"], count["*"], min(len(found), most), len(found) > most))
    got = edits.pileup(df, ["name"], max_depth=most).select("contig", "pos", "n_a", "n_c", "n_g", "n_t", "n_other", "n_del", "depth", "capped").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert edits.pileup(df.limit(0), ["name"]).count() == 0


def test_pileup_checks_lengths(spark):
    df = spark.createDataFrame([(1, "a", 1, 9, "3M", "AC", [30, 30])], "name int, contig string, pos long, mapq int, edits string, seq string, quals array<int>")
    with pytest.raises(Exception, match="different lengths"):
        edits.pileup(df, ["name"]).collect()


def test_split_at_gaps(records):
    rows, df = records
    pieces = edits.split_at_gaps(df)
    by_name = defaultdict(list)
    for r in pieces.collect():
        by_name[r["name"]].append(r)
    for name, _, pos, _, _, text, seq, _ in rows:
        got = sorted(by_name[name], key=lambda r: r["segment"])
        if not ops_of(text):
            assert [(r["edits"], r["pos"]) for r in got] == [(text, pos)]
            continue
        assert all(sum(n for n, o in ops_of(r["edits"]) if o in READ) == len(seq) and "N" not in r["edits"] for r in got)
        whole = [(o, at, read) for o, at, read in walk(pos, text) if o in ALIGNED]
        assert [x for r in got for x in walk(r["pos"], r["edits"]) if x[0] in ALIGNED] == whole
    joined = {r["name"]: (r["pos"], r["edits"]) for r in edits.join_at_gaps(pieces, ["name"]).collect()}
    assert joined == {r[0]: (r[2], text_of(ops_of(r[5])) or None) for r in rows}


def brute_clip(pos, text, seq, lo, hi, skip, leave, hard):
    units = list(walk(pos, text))
    total = sum(u[2] is not None for u in units)
    keep = [k for k, (o, at, read) in enumerate(units) if o in ALIGNED and lo <= at <= hi and skip <= read < total - leave]
    n = sum(u[0] in ALIGNED for u in units)
    if not keep:
        return None, None, n, seq
    a, z = keep[0], keep[-1]
    core = [(1, units[k][0]) for k in range(a, z + 1) if units[k][0] != "P"]
    before, behind = units[a][2], total - units[z][2] - 1
    ops = ops_of(text)
    inner = [x for x in ops if x[1] != "H"]
    soft = [inner[0][0] if inner[0][1] == "S" else 0, inner[-1][0] if inner[-1][1] == "S" else 0]
    old = [ops[0][0] if ops[0][1] == "H" else 0, ops[-1][0] if ops[-1][1] == "H" else 0]
    gone = [before if hard and before > soft[0] else 0, behind if hard and behind > soft[1] else 0]
    out = text_of([(old[0] + gone[0], "H"), (before - gone[0], "S"), *core, (behind - gone[1], "S"), (old[1] + gone[1], "H")])
    return units[a][1], out, n - sum(o in ALIGNED for _, o in core), seq[gone[0] : len(seq) - gone[1]]


@pytest.mark.parametrize("hard", [False, True])
def test_clip(records, hard):
    rows, df = records
    bounded = df.withColumns({"lo": F.when(F.col("name") % 3 == 0, F.col("pos") + F.col("name") % 9), "hi": F.when(F.col("name") % 4 == 0, F.col("pos") + 12), "skip": F.col("name") % 5, "leave": F.when(F.col("name") % 2 == 0, F.col("name") % 7)})
    got = {r["name"]: r for r in edits.clipped(bounded, {c: F.col(c) for c in ("lo", "hi", "skip", "leave")}, hard).collect()}
    for name, _, pos, _, _, text, seq, quals in rows:
        r = got[name]
        if not ops_of(text):
            assert r["edits"] is None and r["n_clipped"] == 0
            continue
        bounds = (pos + name % 9 if name % 3 == 0 else -10**9, pos + 12 if name % 4 == 0 else 10**9, name % 5, name % 7 if name % 2 == 0 else 0)
        assert (r["pos"], r["edits"], r["n_clipped"], r["seq"]) == brute_clip(pos, text, seq, *bounds, hard)
        assert len(r["quals"]) == len(r["seq"])


def test_clip_ends_counts_clips(records):
    rows, df = records
    for at_least in (True, False):
        got = {r["name"]: r["edits"] for r in edits.clip_ends(df, five=4, three=0, at_least=at_least).collect()}
        for name, _, pos, _, reverse, text, seq, _ in rows:
            if ops_of(text):
                inner = [x for x in ops_of(text) if x[1] != "H"]
                end = inner[-1] if reverse else inner[0]
                n = 4 + (0 if at_least or end[1] != "S" else end[0])
                assert got[name] == brute_clip(pos, text, seq, -10**9, 10**9, 0 if reverse else n, n if reverse else 0, False)[1]


def test_reverted(spark):
    rows = [(1, "a", 5, "2M1S", 9, True, "ACg", [1, 2, 3], [7, 8, 9]), (2, "a", 5, "3M", 9, False, "ACN", [1, 2, 3], None)]
    df = spark.createDataFrame(rows, "id int, contig string, pos long, edits string, mapq int, reverse boolean, seq string, quals array<int>, oq array<int>")
    assert sorted(map(tuple, edits.reverted(df, {"quals": "oq"}).collect())) == [(1, "cGT", [9, 8, 7]), (2, "ACN", [1, 2, 3])]


def test_gathered(spark):
    part = lambda *keys: spark.createDataFrame([(k, "v") for k in keys], "k int, v string")
    assert [tuple(r) for r in ordering.gathered([part(3, 1, 3), part(), part(3, 8)], ["k"]).orderBy("rank").select("k", "rank").collect()] == [(1, 1), (3, 2), (3, 3), (3, 4), (8, 5)]
    with pytest.raises(ValueError, match="part 1 begins before"):
        ordering.gathered([part(1, 5), part(4, 9)], ["k"])
    with pytest.raises(ValueError, match="different columns"):
        ordering.gathered([part(1), part(2).drop("v")], ["k"])


def test_trim_primers(spark):
    rows = [(1, "a", 10, False, "30M"), (2, "a", 12, False, "2S30M"), (3, "a", 60, False, "30M"), (4, "a", 21, True, "20M"), (5, "b", 10, False, "30M"), (6, "a", 8, False, "5M2D10M"), (7, "a", 10, False, None), (8, "a", 9, False, "4M")]
    df = spark.createDataFrame(rows, "id int, contig string, pos long, reverse boolean, edits string")
    primers = spark.createDataFrame([("a", 9, 15, False), ("a", 11, 20, False), ("a", 35, 41, True), ("a", 13, 14, False)], "contig string, lo long, hi long, reverse boolean")
    got = {r["id"]: (r["pos"], r["edits"]) for r in edits.trim_primers(df, primers, ["id"], slop=2).collect()}
    # Ties go to the least start: 10 is as near to 9 as to 11, and 12 to 11 as to 13.
    assert got == {1: (16, "6S24M"), 2: (21, "11S21M"), 3: (60, "30M"), 4: (21, "14M6S"), 5: (10, "30M"), 6: (16, "6S9M"), 7: (None, None), 8: (None, None)}


def test_clip_overlaps(spark):
    rows = [(1, "a", 10, False, "20M"), (1, "a", 20, True, "20M"), (2, "a", 10, False, "20M"), (2, "a", 30, True, "20M"), (3, "a", 10, False, "20M"), (3, "b", 15, True, "20M"), (4, "a", 10, False, "30M"), (4, "a", 15, True, "10M"), (5, "a", 10, False, "9M")]
    df = spark.createDataFrame(rows, "id int, contig string, pos long, reverse boolean, edits string")
    got = sorted((r["id"], r["pos"], r["edits"]) for r in edits.clip_overlaps(df, ["id"]).collect())
    assert got == [(1, 10, "15M5S"), (1, 25, "5S15M"), (2, 10, "20M"), (2, 30, "20M"), (3, 10, "20M"), (3, 15, "20M"), (4, 10, "10M20S"), (4, 20, "5S5M"), (5, 10, "9M")]


def test_depth(spark):
    dice = random.Random(3)
    spans = [(dice.choice("ab"), lo, lo + dice.randrange(-1, 60)) for lo in (dice.randrange(1, 200) for _ in range(120))] + [("c", 5, 4), ("d", 1, 10**12), ("d", 7, 9)]
    targets = [(k, c, lo, lo + dice.randrange(0, 80)) for k, (c, lo) in enumerate((c, dice.randrange(0, 300)) for c in "abe" * 5)]
    df = spark.createDataFrame(spans, "contig string, lo long, hi long")
    goals = spark.createDataFrame(targets, "id int, contig string, lo long, hi long")
    depth = defaultdict(Counter)
    for c, lo, hi in spans:
        if c in "ab":
            depth[c].update(range(lo, hi + 1))
    for size in (7, 64, 1 << 16):
        runs = [tuple(r) for r in coverage.depth_runs(df.where("contig <> 'd'"), ["contig"], bin_size=size).select("contig", "lo", "hi", "depth").collect()]
        flat = [((c, at), d) for c, lo, hi, d in runs for at in range(lo, hi + 1)]
        assert len(flat) == len(dict(flat)) and {k: d for k, d in flat if d} == {(c, at): d for c in depth for at, d in depth[c].items()}
        ordered = sorted(runs)
        assert all(a[3] != b[3] for a, b in zip(ordered, ordered[1:], strict=False) if a[0] == b[0] and a[2] + 1 == b[1])
        got = {r["id"]: (r["positions"], r["mean"], r["least"], r["most"], r["pct_2"]) for r in coverage.target_depth(df.where("contig <> 'd'"), goals, ["id"], ["contig"], [2], bin_size=size).collect()}
        for k, c, lo, hi in targets:
            d = [depth[c][at] for at in range(lo, hi + 1)]
            assert got[k] == (len(d), pytest.approx(sum(d) / len(d)), min(d), max(d), pytest.approx(sum(x >= 2 for x in d) / len(d)))
    long = coverage.depth_runs(df.where("contig = 'd'"), ["contig"]).collect()
    assert sorted((r["lo"], r["hi"], r["depth"]) for r in long) == [(1, 6, 1), (7, 9, 2), (10, 10**12, 1)]
    values = sorted(depth["a"][at] for at in range(min(depth["a"]), max(depth["a"]) + 1))
    row = coverage.depth_summary(coverage.depth_histogram(coverage.depth_runs(df, ["contig"]), ["contig"]), ["contig"], [3]).where("contig = 'a'").first()
    mean = sum(values) / len(values)
    assert row["mean"] == pytest.approx(mean) and row["sd"] == pytest.approx(math.sqrt(sum((v - mean) ** 2 for v in values) / len(values)))
    assert row["median"] == values[(len(values) - 1) // 2] and row["pct_3"] == pytest.approx(sum(v >= 3 for v in values) / len(values))
    assert coverage.depth_runs(df.limit(0), ["contig"]).count() == 0


@pytest.mark.parametrize("size", [3, 50, 1 << 16])
def test_islands(spark, size):
    dice = random.Random(size)
    spans = [(dice.choice(["a", "b", None]), lo, lo + dice.randrange(-1, 9)) for lo in (dice.randrange(-50, 300) for _ in range(60))] + [("c", 1, 10**11), ("c", 10**11 + 1, 10**11 + 2)]
    df = spark.createDataFrame(spans, "contig string, lo long, hi long")
    for gap in (0, 1, 4):
        want = []
        for c in ("a", "b", None, "c"):
            for lo, hi in sorted((lo, hi) for k, lo, hi in spans if k == c and lo <= hi):
                if want and want[-1][0] == c and lo <= want[-1][2] + gap:
                    want[-1] = (c, want[-1][1], max(hi, want[-1][2]))
                else:
                    want.append((c, lo, hi))
        assert sorted(map(tuple, coverage.islands(df, ["contig"], gap=gap, bin_size=size).collect()), key=repr) == sorted(want, key=repr)
    assert coverage.islands(df.limit(0), []).count() == 0
    assert [tuple(r) for r in coverage.islands(df.where("contig = 'c'").drop("contig"), [], gap=1).collect()] == [(1, 10**11 + 2)]


def brute_align(text, pos, ref, alt):
    while len(ref) > 1 and len(alt) > 1 and ref[-1] == alt[-1]:
        ref, alt = ref[:-1], alt[:-1]
    while len(ref) > 1 and len(alt) > 1 and ref[0] == alt[0]:
        pos, ref, alt = pos + 1, ref[1:], alt[1:]
    if len(ref) != len(alt) and min(len(ref), len(alt)) == 1 and (ref[0] == alt[0] or ref[-1] == alt[-1]):
        while ref[-1] == alt[-1] and pos > 1:
            pos -= 1
            ref, alt = text[pos - 1] + ref, text[pos - 1] + alt
            ref, alt = ref[:-1], alt[:-1]
        if ref[-1] == alt[-1]:
            unit = (ref if len(ref) > len(alt) else alt)[:-1]
            after = text[len(unit) : len(unit) + 1] if len(ref) > len(alt) else text[:1]
            if after:
                return (1, unit + after, after) if len(ref) > len(alt) else (1, after, unit + after)
    return pos, ref, alt


@pytest.mark.parametrize("width", [4, 9, 4096])
def test_left_aligned(spark, width):
    dice = random.Random(11)
    texts = {"r": "".join(dice.choice("ab") for _ in range(120)), "same": "a" * 90, "period": "abc" * 40, "wide": "é漢\n" * 20, "short": "ab"}
    rows = []
    for c, t in texts.items():
        for k in range(60):
            pos = dice.randint(1, len(t) - 1)
            n = dice.randint(1, min(5, len(t) - pos))
            letter = t[pos - 1]
            ref, alt = dice.choice([(t[pos - 1 : pos + n], letter), (letter, letter + t[max(0, pos - n) : pos]), (t[pos - 1 : pos + n], t[pos + n - 1]), (letter, "x"), (t[pos - 1 : pos + n], "xyz" + t[pos + n - 1])])
            rows.append((len(rows), c, pos, ref, alt))
    rows.append((len(rows), "unknown", 5, "abb", "ab"))
    chunks = alignment.chunked(spark.createDataFrame(list(texts.items()), "contig string, text string"), "contig", "text", width)
    df = spark.createDataFrame(rows, "id int, contig string, pos long, ref string, alt string").repartition(3)
    got = {r["id"]: (r["pos"], r["ref"], r["alt"]) for r in alignment.left_aligned(df, chunks, width=width).collect()}
    assert len(got) == len(rows) and got.pop(len(rows) - 1) == (5, "ab", "a")
    for k, c, pos, ref, alt in rows[:-1]:
        assert got[k] == brute_align(texts[c], pos, ref, alt), (c, pos, ref, alt)
    assert alignment.left_aligned(df.limit(0), chunks, width=width).columns == df.columns


def brute_call(found, before, after, least_qual, least_reads):
    err = lambda q: 10 ** (-q / 10)
    mix = lambda a, b: a + b - a * b * 4 / 3
    found = [(c, min(0.75, mix(err(q), err(after)))) for c, q in found if q >= least_qual and c in "ACGT"]
    if not found:
        return None
    like = sorted(((sum(math.log(1 - e) if c == x else math.log(e / 3) for c, e in found), x) for x in "ACGT"), reverse=True)
    if like[0][0] - like[1][0] <= 1e-9 or len(found) < least_reads:
        return "N", 2.0, 0.0, len(found), len(found)
    others = sum(math.exp(v - like[0][0]) for v, _ in like[1:])
    wrong = mix(others / (1 + others), err(before))
    return like[0][1], max(2.0, min(90.0, -10 * math.log10(wrong))), 1 / (1 + others), len(found), sum(c != like[0][1] for c, _ in found)


def test_likely_letters(spark):
    dice, rows = random.Random(2), []
    for fam in range(25):
        own = "".join(dice.choice("ACGT") for _ in range(12))
        for _ in range(dice.randint(1, 8)):
            n = dice.randint(5, 12)
            rows.append((fam, "".join(c if dice.random() < 0.8 else dice.choice("ACGTNa") for c in own[:n]), [dice.randrange(4, 41) for _ in range(n)]))
    rows += [(90, "AC", [30, 30]), (90, "CA", [30, 30]), (91, "", []), (92, "NN", [30, 30])]
    df = spark.createDataFrame(rows, "fam int, seq string, quals array<int>")
    calls = calling.likely_letters(calling.placed_letters(df, ["fam"]), ["fam"], min_reads=2)
    got = {(r["fam"], r["pos"]): (r["letter"], r["qual"], r["posterior"], r["depth"], r["errors"]) for r in calls.collect()}
    seen = defaultdict(list)
    for fam, seq, quals in rows:
        for k, (c, q) in enumerate(zip(seq, quals, strict=True)):
            seen[fam, k].append((c.upper(), q))
    want = {k: x for k, v in seen.items() if (x := brute_call(v, 45, 40, 10, 2))}
    assert set(got) == set(want)
    for k, (letter, qual, posterior, depth, errors) in want.items():
        assert got[k] == (letter, pytest.approx(qual, abs=1e-9), pytest.approx(posterior, abs=1e-9), depth, errors)
    assert got[90, 0][0] == "N"
    reads = {r["fam"]: r for r in calling.consensus_reads(calls, ["fam"]).collect()}
    for fam in {k[0] for k in want}:
        last = max(p for f, p in want if f == fam)
        assert reads[fam]["seq"] == "".join(want.get((fam, p), "N")[0] for p in range(last + 1)) and len(reads[fam]["quals"]) == last + 1
    strict = calling.filtered(calls.drop("posterior"), ["fam"], 3, 0.15, 0.3, 20, 0.4, 25)
    found = {(r["fam"], r["pos"]): (r["letter"], r["depth"]) for r in strict.collect()}
    passed = {}
    for fam in {k[0] for k in want}:
        mine = {k: v for k, v in want.items() if k[0] == fam}
        masked = {k: ("N" if v[3] < 3 or v[4] > 0.3 * v[3] or v[1] < 20 else v[0], v[3]) for k, v in mine.items()}
        if sum(v[4] for v in mine.values()) <= 0.15 * sum(v[3] for v in mine.values()) and max(v[3] for v in mine.values()) >= 3 and sum(x == "N" for x, _ in masked.values()) <= 0.4 * len(mine) and sum(v[1] for v in mine.values()) / len(mine) >= 25:
            passed.update(masked)
    assert found == passed and passed


def test_duplex(spark):
    rows = [
        (1, "A", 0, "A", 30.0, 3, 0), (1, "B", 0, "A", 25.0, 2, 1), (1, "A", 1, "C", 30.0, 3, 0), (1, "B", 1, "G", 20.0, 4, 1), (1, "A", 2, "C", 30.0, 3, 0), (1, "B", 2, "G", 30.0, 3, 0),
        (1, "A", 3, "T", 30.0, 5, 2), (1, "B", 4, "N", 2.0, 2, 2), (1, "A", 4, "T", 30.0, 5, 0), (1, "A", 5, "A", 60.0, 3, 0), (1, "B", 5, "A", 60.0, 3, 0), (2, "B", 0, "G", 9.0, 1, 0),
    ]
    df = spark.createDataFrame(rows, "fam int, strand string, pos int, letter string, qual double, depth long, errors long")
    out = lambda least: {(r["fam"], r["pos"]): tuple(r)[2:] for r in calling.duplex(df, ["fam"], min_reads=least).collect()}
    assert out((1, 1, 0)) == {
        (1, 0): ("A", 55.0, 5, 1, 2), (1, 1): ("C", 10.0, 7, 4, 2), (1, 2): ("N", 2.0, 6, 0, 2), (1, 3): ("T", 30.0, 5, 2, 1), (1, 4): ("N", 2.0, 7, 2, 2), (1, 5): ("A", 90.0, 6, 0, 2), (2, 0): ("G", 9.0, 1, 0, 1),
    }
    assert {k for k, v in out((6, 4, 1)).items() if v[0] != "N"} == {(1, 1)}


def test_paired_families_keep_the_strand(spark):
    codes = ["AAAA-CCCC"] * 5 + ["CCCC-AAAA"] * 4 + ["AAAA-CCCG"] + ["GGGG-TTTT"] * 2 + ["TTTT-GGGG"]
    df = spark.createDataFrame([("k", c) for c in codes], "key string, code string")
    got = {r["code"]: (r["strand"], r["family"]) for r in calling.paired_families(df, ["key"], "code").collect()}
    assert got == {"AAAA-CCCC": ("A", "AAAA-CCCC"), "CCCC-AAAA": ("B", "AAAA-CCCC"), "AAAA-CCCG": ("A", "AAAA-CCCC"), "GGGG-TTTT": ("A", "GGGG-TTTT"), "TTTT-GGGG": ("B", "GGGG-TTTT")}
    assert barcodes.families(df, ["key"], "code", "paired").count() == 3


def shares(chances, x):
    total = sum(chances.values())
    own = chances[x]
    pick = lambda f: float(sum((p for k, p in chances.items() if f(k, p)), Decimal(0)) / total)
    return pick(lambda k, p: k <= x), pick(lambda k, p: k >= x), pick(lambda k, p: p <= own * (1 + Decimal("1e-7")))


def brute_fisher(a, b, c, d):
    r, s, n = a + b, c + d, a + c
    lo, hi = max(0, n - s), min(r, n)
    chances, p = {}, Decimal(1)
    for k in range(lo, hi + 1):
        chances[k] = p
        p = p * (r - k) * (n - k) / ((k + 1) * (s - n + k + 1))
    return shares(chances, a)


def brute_binomial(x, n, p):
    power = lambda base, k: base**k if k else Decimal(1)
    return shares({k: math.comb(n, k) * power(Decimal(p), k) * power(1 - Decimal(p), n - k) for k in range(n + 1)}, x)


def test_exact_tests(spark):
    getcontext().prec, getcontext().Emin = 60, -(10**9)
    dice = random.Random(4)
    tables = [tuple(dice.randrange(12) for _ in range(4)) for _ in range(150)] + [(0, 0, 0, 0), (0, 0, 5, 7), (5, 0, 7, 0), (0, 9, 0, 3), (1, 0, 0, 1), (300, 40, 280, 65), (40_000, 20_000, 2_000_000, 1_000_100), (3_000, 1_000, 1_400_000, 600_000)]
    df = spark.createDataFrame(tables, "a long, b long, c long, d long").withColumn("t", exact.fisher(F.col("a"), F.col("b"), F.col("c"), F.col("d")))
    for r in df.collect():
        assert tuple(r["t"]) == pytest.approx(brute_fisher(*r[:4]), abs=1e-9), r
    pairs = [(x, n, p) for n in (0, 1, 7, 40) for x in range(0, n + 1, 3) for p in (0.0, 0.001, 0.3, 0.5, 1.0)] + [(480, 1000, 0.5), (3, 1000, 0.001)]
    df = spark.createDataFrame(pairs, "x long, n long, p double").withColumn("t", exact.binomial(F.col("x"), F.col("n"), F.col("p")))
    for r in df.collect():
        assert tuple(r["t"]) == pytest.approx(brute_binomial(*r[:3]), abs=1e-9), r
    bad = spark.createDataFrame([(None, 1, 1, 1), (-1, 2, 3, 4)], "a long, b long, c long, d long")
    assert [r[0] for r in bad.select(exact.fisher(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()] == [None, None]


def test_verdicts(spark):
    rows = [(100, 0, 80, 20), (50, 50, 48, 52), (100, 0, 100, 0), (50, 50, 95, 5), (30, 0, 29, 1), (0, 0, 0, 0)]
    df = spark.createDataFrame(rows, "nr long, na long, tr long, ta long")
    assert [r["status"] for r in variants.somatic_status(df, ("nr", "na"), ("tr", "ta")).collect()] == ["Somatic", "Germline", "Reference", "LOH", "Unknown", "Reference"]
    ends = variants.near_ends(spark.createDataFrame([(9, 1, 20, 180), (1, 9, 20, 180)], "a long, b long, c long, d long"), ("a", "b", "c", "d"), 0.05)
    assert [r["end_artifact"] for r in ends.collect()] == [True, False]


def test_cleaned_calls(spark):
    chunks = alignment.chunked(spark.createDataFrame([("r", "GATTTTACAGACACACG")], "contig string, text string"), "contig", "text", 5)
    rows = [
        (6, "T", ["TTT", "C", "G", "."], 9.0, [1, 0, 2, None]),  # only what is chosen; the insertion moves to the front of its run
        (7, "A", ["C"], 5.0, [1, 1, 1, 1]), (7, "A", ["<*>"], 1.0, [1, 0, 0, 0]),  # too low; open, whatever its quality
        (1, "GAY", ["GCT"], 20.0, [None, 1, 1, 0]),  # an ambiguous letter, two places
        (14, "CAC", ["C"], 30.0, [1, 0, 0, 0]), (12, "CAC", ["C"], 30.0, [0, 0, 1, 0]),  # one change stated twice
        (3, "T", ["T", ""], 50.0, [1, 2, 2, 0]), (5, "T", [], 50.0, [None, None, None, None]), (5, "T", None, None, None),
    ]
    df = spark.createDataFrame([("r", *r) for r in rows], "contig string, pos long, ref string, alts array<string>, qual double, chosen array<int>")
    got = sorted((r["pos"], r["ref"], r["alt"], r["samples"], r["ac"], r["ns"]) for r in variants.cleaned_calls(df, chunks, width=5).collect())
    assert got == [(2, "A", "ATT", [0], 1, 3), (2, "A", "C", [1, 2], 2, 3), (3, "N", "T", [1, 2], 2, 3), (6, "T", "C", [2], 1, 3), (7, "A", "<*>", [0], 1, 4), (10, "GAC", "G", [0, 2], 2, 4)]
    assert variants.cleaned_calls(df.limit(0), chunks, width=5).count() == 0
