import pytest
from pyspark.sql import functions as F

from weftline import functions as fn
from weftline import operators as op
from weftline import lineage, sources
from weftline.operators import alleles, barcodes, intervals, ordering
from weftline.plans import graph
from weftline.plans.graph import EMPTY, Step
from weftline.plans.pipe import Stage
from weftline.plans.scatter import Scatter
from weftline.streaming import line_lengths


def test_groups_bind_tighter_than_sequences(spark):
    a, b, c, d, e = (Step(x) for x in "abcde")
    found = graph.edges(spark, a + b >> c + d >> e)
    assert [x.name for x in a.after] == ["c", "d"] == [x.name for x in b.after]
    assert [x.name for x in c.after] == ["e"]
    assert found.count() == 6


def test_empty_is_the_identity():
    a = Step("a")
    assert a >> None is a and EMPTY >> a is a and a + EMPTY is a and EMPTY + None is EMPTY


def test_edges_can_be_cut():
    a, b, c = Step("a"), Step("b"), Step("c")
    _ = a >> b + c
    a.cut_from(b)
    assert [x.name for x in a.after] == ["c"]


@pytest.mark.parametrize(("rows", "want"), [([("a", "a")], {"a"}), ([("a", "b"), ("b", "a")], {"a", "b"}), ([("a", "b"), ("a", "c"), ("b", "c")], set())])
def test_cycles(spark, rows, want):
    assert {r["node"] for r in graph.cyclic(spark.createDataFrame(rows, "src string, dst string")).collect()} == want


def test_levels_reject_cycles(spark):
    with pytest.raises(ValueError, match="cycle"):
        graph.levels(spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string"))


def test_scatter_of_nothing(spark):
    empty = Scatter.empty(spark, "line string").map(n=fn.words_in_line(F.col("line")))
    assert empty.group_by("n", k=F.count(F.lit(1))).rows.count() == 0
    assert empty.gather(n=F.count(F.lit(1))).first()["n"] == 0


def test_two_gathers_of_one_map(spark):
    lines = Scatter.of(spark, ["one", "one two", "one two three", "one two three four", "one two three four five"], "line string")
    n = lines.map(n=fn.words_in_line(F.col("line")))
    assert n.gather(a=F.sum("n"), b=F.sum(F.col("n") * F.col("n"))).first() == (15, 55)


def test_words_in_line(spark):
    rows = spark.createDataFrame([("",), ("  ",), (" a",), ("a  b ",)], "line string")
    assert [r[0] for r in rows.select(fn.words_in_line(F.col("line"))).collect()] == [1, 0, 2, 3]


def test_stages_that_do_not_fit_fail_before_running(spark):
    first = Stage({"id": "bigint"}, lambda df: df.select(F.col("id").cast("string").alias("name")), {"name": "string"})
    assert (first | Stage({"name": "string"}, lambda df: df))(spark.range(2)).count() == 2
    with pytest.raises(TypeError, match="n int"):
        first | Stage({"n": "int"}, lambda df: df)
    with pytest.raises(TypeError):
        first(spark.createDataFrame([("x",)], "id string"))


def test_overlap_join_equals_between(spark):
    points = spark.range(200).withColumnRenamed("id", "at")
    parts = spark.createDataFrame([(1, 5, 5), (2, 60, 70), (3, 63, 130), (4, 190, 300)], "part int, lo int, hi int")
    want = points.join(parts, F.col("at").between(F.col("lo"), F.col("hi"))).select("at", "part").collect()
    got = op.overlap_join(points, "at", parts, "lo", "hi").select("at", "part").collect()
    assert sorted(got) == sorted(want)


def test_pack_closes_bins_and_keeps_large_rows_alone(spark):
    rows = spark.createDataFrame([(i, s) for i, s in enumerate([40, 60, 1, 500, 1, 99])], "i int, size int")
    assert [r["bin"] for r in op.pack(rows, "i", "size", 100).orderBy("i").collect()] == [0, 0, 1, 2, 3, 3]
    # Rows of no size fill a bin too: what doesn't fit beside them starts the next one.
    rows = spark.createDataFrame([(i, s, "x") for i, s in enumerate([0, 0, 500, 0, 100])], "i int, size int, other string")
    assert [(r["other"], r["bin"]) for r in op.pack(rows, "i", "size", 100).orderBy("i").collect()] == [("x", b) for b in (0, 0, 1, 2, 2)]


def test_quote(spark):
    cases = {
        "foo": "foo", "--XX:whee": "--XX:whee", "a=b": "a=b", "[x]{y}": "[x]{y}", "a b": "'a b'", "*/*": "'*/*'", "not;ok": "'not;ok'", "$notok": "'$notok'", "a\tb": "'a\tb'", "a\\b": "'a\\b'",
        "my'thing": r"my\'thing", "silly'''": r"silly\'\'\'", "it's cold outside": r"it\'s\ cold\ outside", "I'm a *": r"I\'m\ a\ \*", "": "",
    }
    rows = spark.createDataFrame([(c,) for c in cases], "t string")
    assert {r["t"]: r["q"] for r in rows.select("t", fn.quote(F.col("t")).alias("q")).collect()} == cases


def test_sizes_beyond_a_long(spark):
    rows = spark.createDataFrame([("12345678901234567890",), ("12345678901234567890p",), ("9" * 30,), ("",), (None,)], "t string")
    assert [r[0] for r in rows.select(fn.parse_size(F.col("t")).cast("string")).collect()] == ["12345678901234567890", str(12345678901234567890 << 50), None, "-1", None]


def reaches(edges, nodes):
    seen = {n: {n} for n in nodes}
    while True:
        grown = {n: seen[n].union(*(seen[d] for s, d in edges if s in seen[n])) for n in nodes}
        if grown == seen:
            return seen
        seen = grown


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_random_graphs(spark, seed):
    import random

    rng = random.Random(seed)
    rows = [(rng.randrange(14), rng.randrange(14)) for _ in range(18)]
    nodes = {x for r in rows for x in r}
    seen = reaches(rows, nodes)
    want = {n: min(m for m in nodes if m in seen[n] and n in seen[m]) for n in nodes}
    edges = spark.createDataFrame(rows, "src int, dst int")
    assert {r["node"]: r["component"] for r in graph.components(edges).collect()} == want
    assert {r["node"] for r in graph.cyclic(edges).collect()} == {n for n in nodes if any(d in nodes and n in seen[d] for s, d in rows if s == n)}
    assert graph.components(edges.limit(0)).count() == 0


def test_cutting_tells_whether_there_was_an_edge():
    a, b = Step("a"), Step("b")
    _ = a >> b
    assert a.cut_from(b) and not a.cut_from(b)


def test_codes_and_families(spark):
    known = spark.createDataFrame([("ACGTACGT",), ("ACGTTCGA",), ("GGGGGGGG",)], "code string")
    seen = ["ACGTACGT", "ACGTACGA", "GGGGGGGC", "GGGGGGNN", "NNNGGGGG", "TTTTTTTT", ""]
    got = barcodes.assign(spark.createDataFrame([(s,) for s in seen], "seen string"), known, "seen", "code", 1, 2, 2).collect()
    assert {r["seen"]: (r["best"], r["mismatches"]) for r in got} == {"ACGTACGT": ("ACGTACGT", 0), "GGGGGGGC": ("GGGGGGGG", 1), "GGGGGGNN": ("GGGGGGGG", 0)}
    rows = [("k", "AAAA")] * 9 + [("k", "AAAT")] * 3 + [("k", "AATT")] + [("k", "CCCC")] * 2 + [("k", "CCCA")] * 2 + [("j", "AAAT")]
    df = spark.createDataFrame(rows, "key string, umi string")
    family = lambda s: {(r["key"], r["umi"]): r["family"] for r in barcodes.families(df, ["key"], "umi", s).collect()}
    assert family("adjacency") == {("k", "AAAA"): "AAAA", ("k", "AAAT"): "AAAA", ("k", "AATT"): "AAAA", ("k", "CCCC"): "CCCC", ("k", "CCCA"): "CCCA", ("j", "AAAT"): "AAAT"}
    assert family("edit")[("k", "CCCC")] == "CCCA" and family("identity")[("k", "AATT")] == "AATT"
    with pytest.raises(ValueError, match="strategy"):
        barcodes.families(df, ["key"], "umi", "other")


def test_intervals_of_nothing_and_without_contigs(spark):
    some = spark.createDataFrame([(1, 5), (4, 9), (10, 12), (20, 1_000_000)], "lo long, hi long")
    none = some.limit(0)
    rows = lambda df: sorted(map(tuple, df.select("lo", "hi").collect()))
    assert rows(intervals.subtract(some, none)) == [(1, 12), (20, 1_000_000)] and rows(intervals.intersect(some, none)) == []
    assert rows(intervals.subtract(some, spark.createDataFrame([(3, 3), (12, 30)], "lo long, hi long"))) == [(1, 2), (4, 11), (31, 1_000_000)]


def test_misuse_fails(spark):
    rows = spark.createDataFrame([("a:b", [1], [1, 2])], "t string, x array<int>, y array<int>")
    for bad in (fn.without_separator(F.col("t"), ":"), fn.plain_structure(F.lit("8M2T")), op.zipped(F.col("x"), F.col("y"))):
        with pytest.raises(Exception, match="separator|segments|lengths"):
            rows.select(bad).collect()
    with pytest.raises(ValueError, match="columns"):
        ordering.merged([spark.range(1), rows], ["id"])


def test_trimmed_alleles(spark):
    rows = spark.createDataFrame([(10, "ACGT", "ACGT"), (10, "CAAA", "CAA"), (10, "GATTA", "GACTA"), (10, "A", "ATT"), (10, "TTT", "T")], "pos int, ref string, alt string")
    got = rows.select(alleles.trimmed(F.col("pos"), F.col("ref"), F.col("alt")).alias("t")).select("t.*").collect()
    assert [tuple(r) for r in got] == [(10, "A", "A"), (10, "CA", "C"), (12, "T", "C"), (10, "A", "ATT"), (10, "TTT", "T")]


def test_sources(spark, tmp_path):
    (tmp_path / "a.interval_list").write_text("@HD\n@SQ\tSN:x\tLN:9\nx\t1\t5\n")
    assert sources.read_intervals(spark, str(tmp_path / "a.interval_list")).collect() == [("x", 1, 5)]
    assert sources.read_dictionary(spark, str(tmp_path / "a.interval_list")).collect() == [("x", 1, 9)]
    (tmp_path / "a.vcf").write_text("##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\n")
    assert sources.sample_names(spark, str(tmp_path / "a.vcf")).collect() == [(0, "s1"), (1, "s2")]
    assert not sources.log_contains(spark, str(tmp_path / "none.log"), "x")
    assert sources.log_contains(spark, str(tmp_path / "a.vcf"), "FORMAT") and not sources.log_contains(spark, str(tmp_path / "a.vcf"), "nothing")
    (tmp_path / "m.txt").write_text("# made by\nCATEGORY\tPF_READS\nFIRST\t10\nPAIR\t20\n")
    assert sources.metric_of(spark, str(tmp_path / "m.txt"), "CATEGORY", "PAIR")["PF_READS"] == 20
    with pytest.raises(LookupError):
        sources.metric_of(spark, str(tmp_path / "m.txt"), "CATEGORY", "OTHER")
    (tmp_path / "h.sam").write_text("@HD\tVN:1\n@RG\tID:1\tSM:s2\n@RG\tID:2\tSM:s1\n@RG\tID:3\tSM:s2\n@RG\tID:4\n")
    assert sorted(r[0] for r in sources.read_group_samples(spark, str(tmp_path / "h.sam")).collect()) == ["s1", "s2"]
    assert sources.first_sample(spark, str(tmp_path / "h.sam")) == "s2"
    with pytest.raises(LookupError):
        sources.first_sample(spark, str(tmp_path / "a.vcf"))


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    sources.write_by_partition(rows, str(tmp_path / "p"), "k")
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "p")).select("k", "v").collect())) == [("a", 1), ("b", 2)]
    sources.write_map(rows, "k", "v", str(tmp_path / "m"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "m")).collect()) == ["a\t1", "b\t2"]
    lines = rows.select("k")
    sources.write_lines(lines, str(tmp_path / "l"))
    sources.write_lines(lines, str(tmp_path / "l"), append=True, compressed=True)
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "l")).collect()) == ["a", "a", "b", "b"] and list((tmp_path / "l").glob("*.gz"))
    sources.write_lines(lines.limit(1), str(tmp_path / "l"))
    assert spark.read.text(str(tmp_path / "l")).count() == 1


def test_streamed_line_lengths(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one\none two\nthree\n")
    running = line_lengths(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("line_lengths_test").outputMode("complete").trigger(availableNow=True).start()
    running.awaitTermination(60)
    assert sorted(map(tuple, spark.table("line_lengths_test").collect())) == [(1, 2), (2, 1)]


def test_a_cluster_must_name_its_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        lineage.shared_folder(Session())
