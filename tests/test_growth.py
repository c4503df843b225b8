"""What is exchanged grows with the records, and results stay those of the plain definition."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from weftline.operators import barcodes, calling, edits, mixture, proximity, sites, variants  # noqa: F401


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pileup_exchanges_stretches(spark):
    """Few rows a batch, several records of one name at one place, bins' borders, null contigs: as by hand, with one exchange."""
    dice, rows = random.Random(3), []
    for _ in range(400):
        n = dice.choice([1, 5, 300])
        rows.append((f"n{dice.randrange(40)}", dice.choice(["a", "b", None]), dice.randrange(230, 290), 9, f"{n}M3D2M", "".join(dice.choice("ACGTacgN*") for _ in range(n + 2)), [dice.randrange(40) for _ in range(n + 2)]))
    df = spark.createDataFrame(rows, "name string, contig string, pos long, mapq int, edits string, seq string, quals array<int>")
    seen = defaultdict(list)
    for name, contig, pos, _, text, seq, quals in rows:
        n = len(seq) - 2
        for k, (letter, q) in enumerate(zip(seq, quals)):
            if q >= 13 or letter == "*":
                seen[contig, pos + k + 3 * (k >= n)].append((name, letter))
        for k in range(3):
            seen[contig, pos + n + k].append((name, "*"))
    want = {}
    for at, found in seen.items():
        count = Counter(x[1].upper() for x in sorted(found)[:20])
        want[at] = (*[count[c] for c in "ACGT"], count["N"], count["*"], min(20, len(found)), len(found) > 20)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = edits.pileup(df, ["name"], max_depth=20)
        assert plan(out).count("Exchange hashpartitioning") == 1 and "Window" not in plan(out)
        assert {(r[0], r[1]): tuple(r[2:]) for r in out.collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_line_breaks_are_no_letters(spark, tmp_path):
    """A place whose last letter is a line break isn't within a word; an edit string with one is none; as the SQL says."""
    import duckdb

    from weftline import catalog

    text = "ab\ncd " + "xyzzy " * 30
    df = spark.createDataFrame([(k, "q" * (k % 7) + text[k:] + text) for k in range(40)] + [(99, "Abc\n" + "d" * 9), (98, "q" * 135 + "\n" + "d" * 20)], "doc_id long, text string")
    df.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    out = catalog.queries()["f_call_chain"](spark, str(tmp_path))
    want = db.sql(catalog.oracle_sql()["f_call_chain"])
    assert sorted(map(tuple, out.select(*want.columns).collect())) == sorted(want.fetchall())
    with pytest.raises(Exception, match="no edit string"):
        spark.createDataFrame([("8M\n",)], "e string").select(edits.parse(F.col("e"))).collect()


def test_calls_read_texts_once(spark, monkeypatch):
    """Calls and chunks read each text once, no text lies beside its places, and what moved is read from the file of moves."""
    import re

    from weftline import catalog
    from weftline.operators import alignment

    seen, written = [], alignment.written
    monkeypatch.setattr(alignment, "written", lambda df: seen.append(plan(df)) or written(df))
    out = plan(catalog.queries()["f_call_chain"](spark, "/root/testdata/sf0.001"))
    assert len(seen) == 1 and seen[0].count("doc_id:bigint,text:string") == 2 and "FileScan" in out and "doc_id:bigint,text:string" not in out
    carried = re.findall(r"Generate posexplode\(.*\), \[([^]]*)\], false", seen[0])
    assert len(carried) >= 3 and not any("text#" in c for c in carried)


def test_calls_move_over_chunks(spark, monkeypatch, tmp_path):
    """Texts of 5 to 16 letters, wide letters, a repeat longer than a chunk, null and empty texts: as the SQL says, with texts read for the first round and once for all others."""
    import duckdb

    from weftline import catalog
    from weftline.operators import alignment

    seen, written = [], alignment.written
    monkeypatch.setattr(alignment, "written", lambda df: seen.append(plan(df)) or written(df))
    texts = ["ABCDEFGHIJKLMNOP"[:n] for n in range(5, 17)] + ["漢é😀a" * 50 + "acfacfacf" * 60, "x\n" + "ac" * 2200, "Kk" * 80, "abc\r\n" * 90, "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    out, want = catalog.queries()["f_call_chain"](spark, str(tmp_path)), db.sql(catalog.oracle_sql()["f_call_chain"])
    got = sorted(map(tuple, out.select(*want.columns).collect()))
    assert got == sorted(want.fetchall()) and any(r[0] == 13 for r in got)
    assert len(seen) == 4 and [s.count("doc_id:bigint,text:string") for s in seen] == [2, 0, 1, 0]


def test_other_alternatives_stay(spark):
    """Alternatives that aren't letters are neither split, trimmed nor moved, whatever their length, by the one way that all records go."""
    from weftline.operators import alignment

    chunks = alignment.chunked(spark.createDataFrame([("c", "XYAAAABB")], "contig string, text string"), "contig", "text")
    rows = [("c", 3, "aaa", ["<*>", "AAB"], 9.0, [1, 2]), ("c", 5, "AA", ["A"], 9.0, [1, None]), ("c", 6, "A", ["*"], 9.0, [1, 1]), (None, 5, "AA", ["A"], 9.0, [0, 1]), ("c", 90, "AA", ["A"], 9.0, [1, 0])]
    df = spark.createDataFrame(rows, "contig string, pos long, ref string, alts array<string>, qual double, chosen array<int>")
    want = [("c", 2, "YA", "Y", [0], 1, 1), ("c", 3, "AAA", "<*>", [0], 1, 2), ("c", 5, "A", "B", [1], 1, 2), ("c", 6, "A", "*", [0, 1], 2, 2), ("c", 90, "AA", "A", [0], 1, 2), (None, 5, "AA", "A", [1], 1, 2)]
    assert sorted(map(tuple, variants.cleaned_calls(df, chunks).collect()), key=repr) == sorted(want, key=repr)


def test_letters_are_not_exchanged(spark):
    """Reads of a group meet once; two strands, both calls and the filter of groups need no exchange of letters."""
    rows = spark.createDataFrame([(k % 5, "AB"[k % 2], "ACGTA", [30, 20, 40, 11, 5]) for k in range(60)], "g int, strand string, seq string, quals array<int>")
    calls = calling.likely_letters(calling.placed_letters(rows, ["g", "strand"], meet=["g"]), ["g", "strand"])
    whole = calling.filtered(calling.likely_letters(calling.placed_letters(rows, ["g"]), ["g"]), ["g"], 1, 0.9, 0.9, 1, 0.9, 1)
    for out in (calling.duplex(calls, ["g"]), whole):
        assert plan(out).count("Exchange hashpartitioning") == 1
        assert out.count() == 5 * 4


def test_primers_meet_positions(spark):
    """Records are matched by where they begin, not listed by bins and then joined by name; the nearest primer as by hand."""
    dice = random.Random(4)
    rows = [(k, dice.choice("ab"), dice.randrange(1, 200), dice.random() < 0.5, "9M") for k in range(300)]
    primers = [(dice.choice("ab"), lo, lo + dice.randrange(1, 5), dice.random() < 0.5) for lo in (dice.randrange(1, 200) for _ in range(60))]
    df = spark.createDataFrame(rows, "id int, contig string, pos long, reverse boolean, edits string")
    out = edits.trim_primers(df, spark.createDataFrame(primers, "contig string, lo long, hi long, reverse boolean"), ["id"], slop=3)
    assert "hashpartitioning(id" not in plan(out)
    got = {r["id"]: r["n_clipped"] for r in out.collect()}
    for k, contig, pos, back, _ in rows:
        begins = pos + 8 if back else pos
        near = sorted((abs((hi if b else lo) - begins), lo, -hi) for c, lo, hi, b in primers if c == contig and b == back and abs((hi if b else lo) - begins) <= 3)
        inner = (near[0][1] if back else -near[0][2]) if near else None
        assert got[k] == (0 if inner is None else min(9, max(0, pos + 8 - inner + 1) if back else max(0, inner - pos + 1))), k


@pytest.mark.parametrize("contig", [["contig"], []])
def test_site_counts_equal_the_matrix(spark, contig):
    """Overlapping blocks of one sample, blocks over own variants, null samples: as by the matrix, without its rows."""
    dice, rows = random.Random(5), []
    for _ in range(300):
        lo, varies = dice.randrange(1, 150), dice.random() < 0.3
        rows.append((dice.choice(["a", "b", "c", None]), dice.choice("xy"), lo, lo if varies else lo + dice.choice([-2, 0, 5, 60]), varies, 1))
    df = spark.createDataFrame(rows, "sample string, contig string, lo long, hi long, varies boolean, v int")
    want = sites.site_summary(sites.site_matrix(df, contig, "sample", "varies", ["v"]), contig, "sample", "varies")
    got = sites.site_counts(df, contig, "sample", "varies").select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert sites.site_counts(df.where("not varies"), contig, "sample", "varies").count() == 0


def test_mixture_likelihoods_by_hand(spark):
    """Many qualities, sites of certain frequency: each grid point as by the formula, from letters' chances taken once for each quality."""
    import math

    dice, rows = random.Random(7), []
    for site in range(60):
        f = dice.choice([0.0, 0.3, 0.8, 1.0])
        rows += [(site, f, dice.random() < 0.4, dice.randrange(3, 60)) for _ in range(dice.randrange(1, 9))]
    grid, by_site = [0.0, 0.125, 0.5], defaultdict(list)
    for site, f, alt, q in rows:
        by_site[site, f].append((alt, min(0.75, 10 ** (-q / 10))))
    want = {}
    for alpha in grid:
        want[alpha] = 0.0
        for (_, f), reads in by_site.items():
            prior, chance = [(1 - f) ** 2, 2 * f * (1 - f), f * f], 0.0
            for a in range(3):
                for b in range(3):
                    s = (1 - alpha) * a / 2 + alpha * b / 2
                    chance += prior[a] * prior[b] * math.prod((s if alt else 1 - s) * (1 - e) + (1 - s if alt else s) * e / 3 for alt, e in reads)
            want[alpha] += math.log(chance)
    counted = mixture.site_counts(spark.createDataFrame(rows, "site int, f double, alt boolean, q int"), ["site"], "f", "alt", "q")
    out = mixture.likelihoods(counted.repartition(3), grid)
    assert "aggregate(" not in plan(out)
    got = {r["alpha"]: r["log_likelihood"] for r in out.collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[a], want[a], rel_tol=1e-9) for a in grid)


@pytest.mark.parametrize("most", [1 << 18, 2])
def test_shapes_are_worked_out_once(spark, monkeypatch, most):
    """Records of one shape are cut and split alike wherever they lie, with shapes looked up or not; no place, no edits."""
    monkeypatch.setattr(edits, "MOST_SHAPES", most)
    rows = [(k, 10 * k, ["9M", "4M2I5M", "3S4M50N6M", "5M3D5M", None, "*"][k % 6], k % 4 == 0, "ACGTACGTACGTA") for k in range(60)] + [(99, None, "9M", False, "ACGTACGTA")]
    df = spark.createDataFrame(rows, "id int, pos long, edits string, reverse boolean, seq string")
    bounds = {"lo": F.col("pos") + F.col("id") % 3, "hi": F.lit(400).cast("long"), "skip": F.when(F.col("reverse"), 1)}
    one = df.withColumn("c", edits.clip(F.col("pos"), edits.parse(F.col("edits")), hard=True, **bounds)).select("id", "c.pos", "c.edits", "c.n_clipped", F.substring("seq", F.col("c.start") + 1, F.col("c.letters")))
    out = edits.clipped(df, bounds, hard=True).select("id", "pos", "edits", "n_clipped", "seq")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, one.collect()))
    assert ("aggregate(" in plan(out).split("BroadcastExchange")[0]) == (most == 2)
    pieces = {(r["id"], r["segment"]): (r["pos"], r["core"]) for r in edits.split_at_gaps(df).collect()}
    assert pieces[2, 0] == (20, "3S4M") and pieces[2, 1] == (74, "6M") and pieces[0, 0] == (0, "9M") and pieces[4, 0] == (40, None)


def test_letters_are_not_sorted_with_names(spark, monkeypatch):
    from weftline import alignments

    seen, ranked = [], alignments.ordering.ranked
    monkeypatch.setattr(alignments.ordering, "ranked", lambda df, order: seen.append(df.columns) or ranked(df, order))
    out = alignments.p_revert_reads(spark, "/root/testdata/sf0.001")
    assert seen == [["name", "contig", "mapq", "reverse"]] and out.columns == ["rank", "name", "seq", "first_qual"]


@pytest.mark.parametrize("distance", [0, 1, 7, 40])
def test_optical_rows_are_exchanged_once(spark, monkeypatch, distance):
    """Planes of a task's own, with few rows a batch, nulls and copies: as by the graph of cells, with one exchange."""
    dice = random.Random(distance)
    span = 90 if distance > 1 else 15
    place = lambda: dice.choice([None, *range(-span, span)])
    rows = [(k, dice.choice(["a", "b", "c", None]), dice.choice(["u", "v", None]), place(), place()) for k in range(500)]
    df = spark.createDataFrame(rows, "id int, key string, tile string, x int, y long").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = proximity.mark_optical(df, ["key"], ["tile"], "x", "y", distance, [F.desc("id")])
        assert plan(out).count("Exchange hashpartitioning") == 1 and "Join" not in plan(out)
        got = sorted(map(tuple, out.collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(proximity, "COLUMNS", 0)
    want = proximity.mark_optical(df, ["key"], ["tile"], "x", "y", distance, [F.desc("id")])
    assert got == sorted(map(tuple, want.collect())) and {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("edits", [1, 2])
def test_families_link_each_code_to_one(spark, monkeypatch, edits):
    """Codes of several lengths, nulls, none: families as by all pairs, with no more edges than places of codes for one edit."""
    dice = random.Random(edits)
    rows = [(dice.choice("ab"), "".join(dice.choice("ACGT") for _ in range(dice.choice([0, 1, 3, 6])))) for _ in range(160)] + [(None, "AC"), ("a", None)]
    seen, connected = [], barcodes.graph.connected
    monkeypatch.setattr(barcodes.graph, "connected", lambda e: seen.append(e.count()) or connected(e))
    got = {(r["k"], r["u"]): (r["n"], r["family"]) for r in barcodes.families(spark.createDataFrame(rows, "k string, u string"), ["k"], "u", "edit", edits).collect()}
    codes = Counter(r for r in rows if None not in r)
    near = lambda a, b: a[0] == b[0] and len(a[1]) == len(b[1]) and sum(p != q for p, q in zip(a[1], b[1])) <= edits
    family = {c: c[1] for c in codes}
    while any(family[a] > family[b] for a in codes for b in codes if near(a, b)):
        family = {a: min(family[b] for b in codes if near(a, b)) for a in codes}
    assert got == {c: (n, family[c]) for c, n in codes.items()}
    assert edits > 1 or seen[0] <= sum(len(c[1]) for c in codes)


def test_changes_meet_their_chunk_once(spark, monkeypatch):
    """A change that stays within its chunk is written once with all its columns, and isn't joined again by a number of its own."""
    from weftline.operators import alignment

    seen, written = [], alignment.written
    monkeypatch.setattr(alignment, "written", lambda df: seen.append(df.columns) or written(df))
    chunks = alignment.chunked(spark.createDataFrame([("c", "xyaaaabb")], "contig string, text string"), "contig", "text")
    df = spark.createDataFrame([(1, "c", 5, "aa", "a"), (2, "c", 2, "y", "z"), (3, "d", 4, "aa", "a"), (4, "c", 1, "x", "xx")], "id int, contig string, pos long, ref string, alt string")
    out = alignment.left_aligned(df, chunks)
    assert len(seen) == 1 and "id" in seen[0] and "_id#" not in plan(out)
    assert sorted(map(tuple, out.collect())) == [(1, "c", 2, "ya", "y"), (2, "c", 2, "y", "z"), (3, "d", 4, "aa", "a"), (4, "c", 1, "x", "xx")]
