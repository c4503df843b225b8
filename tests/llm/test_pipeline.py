"""Stage near_duplicates against brute force, where ids are null or repeat."""

import corpus_pipeline


def shingle_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_groups(rows):
    """Components of the distinct rows."""
    groups = []
    for row in sorted(set(rows), key=repr):
        linked = lambda other: (a := shingle_set(row[1])) and (b := shingle_set(other[1])) and 100 * len(a & b) >= 80 * len(a | b)
        joined = [g for g in groups if any(linked(other) for other in g)]
        groups = [g for g in groups if g not in joined] + [[row, *(x for g in joined for x in g)]]
    return groups


def test_near_duplicates_by_row(spark):
    base = " ".join(f"word{i}" for i in range(40))
    near, far = base + " tail", " ".join(f"other{i}" for i in range(30))
    rows = [
        (1, base, "a"), (2, near, "a"), (2, "a text of its own that has the id of a near copy", "a"), (None, base, "b"), (None, far, "c"), (None, far, "c"), (None, far + " end", "c"),
        (3, "this one is met twice and is equal both times", "d"), (3, "this one is met twice and is equal both times", "d"), (4, "one id", "e"), (4, "and two unlike texts", "e"),
        (None, "no id and no copy at all", "f"), (6, None, "g"), (7, "", "g"), (None, None, "g"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    got, groups = sorted(map(tuple, out.collect()), key=repr), brute_groups(rows)
    assert len(got) == len(groups) and len(set(got)) == len(got)
    for group in groups:
        stays = [row for row in got if row in group]
        ids = [row[0] for row in group if row[0] is not None]
        assert len(stays) == 1 and stays[0][0] == min(ids, default=None)


def test_near_duplicates_tells_nulls_apart(spark):
    rows = [(None, None, "g", 5), (None, "g", None, 5), (5, None, None, None), (None, None, None, 5), (None, "g", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = sorted(map(tuple, corpus_pipeline.near_duplicates(spark, docs, "").collect()), key=repr)
    # Rows without a text stay each; of the two with the same one, one does.
    assert [r for r in got if r[1] is None] == sorted([r for r in rows if r[1] is None], key=repr) and sum(r[1] == "g" for r in got) == 1


HOSTILE = [
    (None, "a text without an id that has quite enough words to be kept by the rules", "a", 1), (1, None, "a", 2), (1, "", None, 3), (2, "   \n ", "b", 4),
    (3, "the same id twice, with one text of words that are all its own here", "b", 5), (3, "the same id twice, and another text that nobody else has said before", "b", 6),
    (4, " ".join(f"long{i}" for i in range(20_000)), "c", 7), (4, " ".join(f"long{i}" for i in range(20_000)), "c", 7), (5, "short", "c", None),
]
CLASHING = "doc_id long, text string, source string, n_chars long, row string, words string, size string, key string, grp string, kept boolean, _row long"


def test_stages_on_hostile_rows_and_names(spark):
    """Nulls, repeated ids and rows, very long texts, columns with the operators' own names, and empty tables."""
    rows = [(*r, "a", "b", "c", "d", "e", False, 9) for r in HOSTILE]
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(rows, CLASHING).repartition(2)
        out = stage(spark, docs, "/root/testdata/sf0.001")
        got = out.collect()
        if name == "shard":
            assert len(got) == len(rows) and {r["shard"] for r in got} <= set(range(24))
        elif name == "mix":
            assert out.columns == docs.columns and {r["doc_id"] for r in got} <= {r[0] for r in rows}
        else:
            left = [tuple(r) for r in docs.collect()]
            assert out.columns == docs.columns
            for r in got:
                left.remove(tuple(r))
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0
