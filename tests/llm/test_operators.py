"""Each operator on a small hostile table, against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from weftline.llm import chat_format, common, decontaminate, jaccard_join, language, language_model, line_templates, quality, sharding, source_mix, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, row string, words string, key string"
BASE = "The quick brown fox jumps over the lazy dog while seven wizards quietly mix potions in a cold dark cellar near the old mill"
LONG = " ".join(f"w{i % 977} x{i % 31}" for i in range(30_000))


def table():
    words = BASE.split()
    near = " ".join([*words[:-1], "barn"])
    rows = [
        (1, BASE, "en", "a"), (2, BASE, "en", "b"), (3, BASE, None, None), (3, BASE, None, None), (4, near, "en", "b"), (5, None, "en", "a"), (6, "", "de", "a"),
        (7, "   \n\t", "de", ""), (8, LONG, "en", None), (None, "no id at all but some words here to be counted and kept in the end", "en", "c"),
        (9, "one two three four", "en", "c"), (10, "One  two three\tfour", "en", "c"), (11, "héros Édith über <s> [INST] ~ \\ \x1f next", "fr", "d"),
        (12, "same line of five tokens\nother words are on this line\nsame line of five tokens", "en", "d"), (13, "same line of five tokens\nunlike 123", "en", "d"),
        (14, "a b c d e f", "en", "e"), (15, "a b c d e f g h i", "en", "e"), (16, "a b c d e f g h", "en", "e"), (17, BASE + " " + BASE, "en", "e"),
    ]
    rows += [(100 + i, f"filler text number {i} with {i * 7 % 13} odd words of its own kind {i * 31 % 101} and {i * 17 % 89}", "en", f"s{i % 3}") for i in range(60)]
    return [(*r, len(r[1]) if r[1] else None, "x", "y", "z", "k") for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(table(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, 1, int(i % 9 == 0)) for i in range(100, 150)] + [(None, 1, 1), (2, None, None), (2, 1, 0), (999, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def ascii_words(text):
    return re.findall("[^\x20\x09-\x0D]+", text or "")


def low(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_mix(docs, empty):
    out = source_mix.mix(docs)
    got = out.collect()
    assert len(got) == len(table())
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert sorted(r["size"] for r in got) == sorted(len(ascii_words(t[1])) for t in table())
    assert abs(sum(r["taken"] for r in got) - 1.5 * sum(r["size"] for r in got)) < 64 * 12
    assert rows_of(out, "doc_id", "taken") == rows_of(source_mix.mix(docs.repartition(7)), "doc_id", "taken")
    assert source_mix.mix(empty).count() == 0
    mixed = source_mix.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len(ascii_words(r["text"])) for r in mixed.collect()) == sum(r["taken"] for r in got)
    assert source_mix.mixed_documents(empty).count() == 0


def test_highest_quotients(spark):
    votes = {"a": 53, "b": 24, "c": 23, "d": 0}
    seats = Counter()
    for _ in range(11):
        seats[max(sorted(votes), key=lambda p: votes[p] / (2 * seats[p] + 1))] += 1
    parties = spark.createDataFrame([(p, v, 11) for p, v in votes.items()], "p string, v long, seats long")
    got = {r["p"]: r["quota"] for r in source_mix.highest_quotients(parties, "v", "seats", [], ["p"]).collect()}
    assert got == {p: seats[p] for p in votes}


def brute_contamination(text, items):
    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t)) if w]
    words, hit, found = split(text), set(), set()
    for item, body in items:
        ws = split(body)
        n = min(10, len(ws))
        for win in {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if n else ():
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) == win:
                    hit.update(range(i, i + n))
                    found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_decontamination(spark, docs, empty):
    items = [(1, BASE), (2, "FOUR!"), (3, None), (4, "..."), (5, "quietly mix potions"), (5, "über x"), (10, "a b c d e f g h i j k")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = sorted(((t[0], *brute_contamination(t[1], items)) for t in table()), key=repr)
    assert rows_of(decontaminate.contamination(docs, bench), *columns) == want
    assert decontaminate.contamination(empty, bench).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.contamination(docs, bench.limit(0)).collect())


def test_decontamination_beyond_a_broadcast(spark, docs, monkeypatch):
    items = [("i1", " ".join(BASE.split()[3:20])), ("i2", "one two"), ("i3", "e"), ("i4", "w12 x12 w13 x13"), ("i5", "words here to be counted and kept in the end")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = sorted(((t[0], *brute_contamination(t[1], items)) for t in table()), key=repr)
    monkeypatch.setattr(common, "fits", lambda small, max_rows: False)
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert rows_of(decontaminate.contamination(docs, bench), *columns) == want


def test_ascii_lower_text(spark):
    """A-Z only: capitals beyond ASCII, and letters whose lower case has another length, stay."""
    texts = ["", "ABC xyZ", "É und A", "über A", "İSTANBUL", "ΑΣ Σ A", "ß ẞ Q", "\u212aELVIN K", "ǅ Z", "I\u0307 I", "😀 A", "日本 T\x00A"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", common.ascii_lower_text(F.col("t")).alias("l")).collect()
    assert all(r["l"] == low(r["t"]) for r in got) and len(got) == len(texts)
    assert spark.range(1).select(common.ascii_lower_text(F.lit(None).cast("string")).alias("l")).first()["l"] is None


def test_fits_counts_rows_and_bytes(spark, monkeypatch):
    small = spark.createDataFrame([(1, "x" * 100), (2, None)], "k long, v string")
    assert common.fits(small, 2) and not common.fits(small, 1) and not common.fits(small, -1) and common.fits(small.limit(0), 0)
    monkeypatch.setattr(common, "MAX_BYTES", 50)
    assert not common.fits(small, 2)


def test_decontamination_null_item(spark):
    """An item without an id gives hits, but no name."""
    docs = spark.createDataFrame([(1, "say quietly mix potions now"), (2, "one two three"), (3, "quietly mix potions one two three"), (4, "clean")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "quietly mix potions"), (7, "one two three")], "item_id long, text string")
    sha = lambda ids: hashlib.sha256(ids.encode()).hexdigest()
    want = [(1, 3, 0, sha(""), True), (2, 3, 1, sha("7"), True), (3, 6, 1, sha("7"), True), (4, 0, 0, sha(""), False)]
    assert rows_of(decontaminate.contamination(docs, bench), "doc_id", "n_hit", "n_items", "items_sha256", "contaminated") == want


def test_language(docs, empty):
    got = language.identify(docs, F.col("doc_id") % 4 == 2).collect()
    assert len(got) == len(table())
    by = {r["doc_id"]: r for r in got}
    assert by[5]["lang_pred"] == by[6]["lang_pred"] == by[7]["lang_pred"] == "und"
    assert by[5]["score"] == 0 and by[1]["lang_pred"] == "en" and by[11]["lang_pred"] == "fr"
    assert all(0 <= r["score"] <= 1 for r in got)
    assert language.identify(empty, F.lit(False)).count() == 0
    assert {r["lang_pred"] for r in language.identify(docs, F.lit(True)).collect()} == {"und"}


def test_language_evidence(monkeypatch):
    """The vectorised sum equals word-by-word backoff, also when kept vectors are given up."""
    monkeypatch.setattr(language, "KEPT", 2)
    langs, prior = ["aa", "bb"], np.log([0.4, 0.6])
    tables = [{"one": np.array([-1.0, -4.0]), "two": np.array([-3.0, -2.0])}, {c: np.array([-2.0 - i / 10, -2.5 + i / 9]) for i, c in enumerate("abcdefghij")}, {"<b": np.array([-1.5, -6.0])}, {}, {}]
    texts = ["one two two", "one bad bead cab zzz², one", "bad bead", "ü² ½", "cab dad zzz two", "", None, "½ 12"]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array([False] * len(texts)), pa.array(texts)], ["doc_id", "held_out", "text"])
    got = next(language.predictor(langs, prior, tables)([batch])).to_pylist()

    def vector(word):
        if word in tables[0]:
            return tables[0][word]
        for n in range(language.GRAMS, 0, -1):
            if known := [tables[n][g] for g in language.grams(word, n) if g in tables[n]]:
                return np.mean(known, axis=0)
        return np.zeros(2)

    for text, row in zip(texts, got):
        found = regex.findall(r"\p{L}+", (text or "").lower())
        if not found:
            assert (row["lang_pred"], row["score"]) == ("und", 0.0)
            continue
        total = sum(vector(w) for w in found) + prior
        assert row["lang_pred"] == langs[int(np.argmax(total))]
        assert math.isclose(row["score"], 1 / np.exp(total - total.max()).sum(), rel_tol=1e-9)


def test_language_keeps_small_languages(spark):
    """Features of a small language stay, however many more frequent ones a large language has."""
    state, names = np.random.default_rng(1), set()
    while len(names) < 40_000:
        names.add("".join(map(chr, state.integers(97, 123, 6))))
    large = " ".join(sorted(names) * 3)
    rows = spark.createDataFrame([(1, large, "aa"), (2, "ÞÞð ÞÞð", "zz")], "doc_id long, text string, lang string")
    langs, _, tables = language.learn(rows)
    assert langs == ["aa", "zz"] and sum(map(len, tables)) > 100_000
    assert tables[0]["þþð"][1] > tables[0]["þþð"][0] and "<þþð" in tables[4]


def test_sharding(docs, empty):
    got = sharding.shard_documents(docs, shards=5).collect()
    assert len(got) == len(table())
    counts = Counter(r["shard"] for r in got)
    assert len(counts) == 5 and max(counts.values()) - min(counts.values()) <= 1
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got if r["doc_id"]) == sorted((t[0], len((t[1] or "").encode()) + 8, zlib.crc32((t[1] or "").encode())) for t in table() if t[0])
    assert len({r["shard"] for r in got if r["doc_id"] in (1, 2, 3)}) == 1
    assert sharding.shard_documents(empty).count() == 0


def line_key(line):
    """The key under which a line is ordered among lines of equal rows."""
    data = np.frombuffer(line.encode(), np.uint8)
    return int(line_templates.line_forms(data, np.array([0, len(data)]))[3].view(np.int64)[0])


def templates_by_hand(rows, least_docs, keep_first):
    """(id, text, n_lines, n_dropped): the tree by brute force, on texts whose leaves are small."""
    docs = {(i, t) for i, t in rows}
    leaves, count = defaultdict(dict), Counter()

    def form(line):
        return tuple("" if re.search("[0-9]", w) else w for w in ascii_words(line))

    for i, text in rows:
        for f in {form(x) for x in (text or "").split("\n")}:
            if any(f):
                count[f] += 1
    where = defaultdict(set)
    for i, text in docs:
        for line in (text or "").split("\n"):
            f = form(line)
            if any(f):
                where[f].add((i, text))
                leaves[len(f), f[:3]][f] = line
    recurring = {}
    for leaf in leaves.values():
        known = []
        for f in sorted(leaf, key=lambda f: (-count[f], line_key(leaf[f]))):
            scores = [sum(a == b for a, b in zip(t[0][3:], f[3:])) for t in known]
            best = scores.index(max(scores)) if scores else None
            if best is not None and len(f) > 3 and scores[best] >= line_templates.ALIKE * (len(f) - 3):
                t = known[best]
                t[0] = [a if a == b else "" for a, b in zip(t[0], f)]
                t[1].append(f)
            else:
                known.append([list(f), [f]])
        for _, members in known:
            reached = set().union(*(where[f] for f in members))
            if len(reached) >= least_docs:
                recurring.update(dict.fromkeys(members, reached))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        if keep_first:
            out.append((i, text))
            continue
        kept = [x for x in lines if form(x) not in recurring]
        out.append((i, None if text is None else "\n".join(kept) if len(kept) < len(lines) else text, len(lines) if text is not None else 0, len(lines) - len(kept)))
    return out, recurring


HOSTILE_LINES = [
    "Posted by our team on 12 May", "Posted by our team on 13 May", "Posted by our staff on 13 May", "see the full list of all prices for cats here", "see the full list of all prices for dogs here",
    "see the full list of old plans with dogs there", "All rights reserved", "12", "12 13", "", "  ", "Übung für alle héros", "one two three", "one two three four", "one two three five", "x" * 70_000 + " end of a long line", "tail",
]


@pytest.mark.parametrize("least_docs", [2, 3])
def test_line_templates(spark, docs, empty, least_docs):
    rng = np.random.default_rng(5)
    rows = [(int(i), "\n".join(HOSTILE_LINES[k] for k in rng.integers(0, len(HOSTILE_LINES), rng.integers(1, 5)))) for i in range(25)]
    rows += [(i, f"Page number {i} of the book by a writer\nown line {chr(97 + i)} of its own sort {chr(98 + i)}") for i in range(8)]
    rows += [(None, "All rights reserved\nnobody else says this"), (None, None), (3, ""), (7, "All rights reserved"), (7, "All rights reserved"), (30, "Only here twice\nOnly here twice")]
    df = spark.createDataFrame([(i, t, 1, "l") for i, t in rows], "doc_id long, text string, doc int, line string").repartition(4)
    expected, _ = templates_by_hand(rows, least_docs, False)
    got = [tuple(r) for r in line_templates.drop_templates(df, least_docs=least_docs).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert any(r[3] for r in expected) and any(r[1] for r in expected)
    kept = line_templates.drop_templates(df, least_docs=least_docs, keep_first=True).collect()
    for line in ("All rights reserved", "tail", "one two three"):
        assert len({(r["doc_id"], r["text"]) for r in kept if line in (r["text"] or "").split("\n")}) == 1
    by = {r["doc_id"]: r for r in line_templates.drop_templates(docs).collect()}
    assert by[8]["n_lines"] == 1 and by[8]["text"] == LONG
    assert line_templates.drop_templates(empty).count() == 0


def test_large_leaves(spark, monkeypatch):
    monkeypatch.setattr(line_templates, "FORMS", 8)
    names = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(120)]
    rows = [(i, f"User data for {name} was {'opened' if i % 2 else 'closed'} in our main office today") for i, name in enumerate(names)]
    got = line_templates.drop_templates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    # A part of one form has no partner; at the real size of parts there are none.
    assert len(got) == 120 and sum(r["text"] == "" for r in got) >= 105
    apart = [(i, f"same three words {chr(97 + i)} {chr(98 + i)} {chr(99 + i)} {chr(100 + i)}") for i in range(0, 22, 2)]
    assert all(r["n_dropped"] == 0 for r in line_templates.drop_templates(spark.createDataFrame(apart, "doc_id long, text string")).collect())


def test_leaves_of_any_size_as_whole(spark, monkeypatch):
    """Split leaves give the whole leaf's templates: pairs that share one rare token, fields, one template, wide lines."""
    rng = np.random.default_rng(9)
    word = lambda k: "".join(chr(97 + int(x)) for x in str(k))
    lines = [f"one two three {' '.join(word(w) for w in rng.integers(0, 4, 5))} {word(50 + k // 2)} {word(900 + k // 2)}" for k in range(120)]
    lines += [f"one two four {' '.join('7' if w == 0 else word(w) for w in rng.integers(0, 30, 6))}" for _ in range(150)]
    lines += [f"pair of lines {' '.join(word(1000 * p + k // 2) for p in range(1, 7))} {word(k)}" for k in range(80)]
    lines += [f"User data for {word(k)} was opened in our main office today" for k in range(40)]
    rows = [(k, line) for k, line in enumerate(lines)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    expected, _ = templates_by_hand(rows, 2, False)
    for most, places in ((8, 256), (8, 2), (4096, 256), (4096, 2)):
        monkeypatch.setattr(line_templates, "FORMS", most)
        monkeypatch.setattr(line_templates, "PLACES", places)
        assert sorted(map(tuple, line_templates.drop_templates(df).collect())) == sorted(expected), (most, places)
    assert 80 < sum(r[3] for r in expected) < len(rows)


def test_language_model(docs, empty):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    flag = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    counts = Counter()
    for t in table():
        if not held(t[0]):
            counts.update([*low(t[1]).encode().split(), None])
    total, kinds = sum(counts.values()), len(counts)
    want = []
    for t in table():
        tokens = [*low(t[1]).encode().split(), None]
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in tokens)
        want.append((t[0], held(t[0]), len(tokens), sum(w in counts for w in tokens), total, round(base, 4)))
    got = language_model.score_texts(docs, flag).collect()
    assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got), key=repr) == sorted(want, key=repr)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert language_model.score_texts(empty, flag).count() == 0


def small_tree(levels=2, bits=13):
    ends = np.zeros(16**levels)
    ends[16 ** (levels - 1) // 4 :] = 0.1
    ends[0] = 3.1
    return language_model.Tree(levels, ends, bits)


def test_language_model_steps_on_every_token(monkeypatch):
    stepped = []
    plain = language_model.step
    monkeypatch.setattr(language_model, "step", lambda tree, table, speed, history, path: (stepped.append(history.shape[1]), plain(tree, table, speed, history, path))[1])
    texts = ["one", "", "a b", *(t[1] for t in table())]
    batch = pa.record_batch([pa.array(texts, pa.string())], ["text"])
    list(language_model.trainer(small_tree())(iter([batch])))
    assert sum(stepped) == sum(len(low(t).encode().split()) + 1 for t in texts)


def test_language_model_sums_to_one(spark):
    """After any history, the known words, the end, and one unknown word at every end of the tree have probabilities that sum to one."""
    said = [(i, f"alpha beta gamma{i % 9} delta{i % 4}, epsilon zeta{i % 5} eta. the{i % 30} of{i % 17}") for i in range(200)]
    rows = spark.createDataFrame(said, "doc_id long, text string")
    tree, vocabulary, total, distinct, ends = language_model.learned(rows)
    known = vocabulary.collect()
    assert distinct == len(known) + 1 and np.abs(tree.table).max() > 0.1
    shift = 4 * (language_model.LEVELS - tree.levels)
    for text in ("alpha beta gamma1", "alpha", "of3 unseen words", ""):
        data = np.frombuffer(text.encode(), np.uint8)
        words, row, kind = language_model.tokens(data, np.array([0, len(data)]))
        history = language_model.histories(words, row, kind)[:, -1:]
        every = np.arange(16**tree.levels) << shift
        shares = 10 ** tree.log_share(np.repeat(history, len(every), axis=1), every)
        mass = 10**tree.end_log
        assert math.isclose(shares.sum(), 1, rel_tol=1e-4)
        of = Counter()
        for r in known:
            of[r["path"] >> shift] += r["n"] + 0.1
        for end, share in enumerate(shares):
            if end >= 16 ** (tree.levels - 1) // 4:
                assert math.isclose(of[end] + 0.1, mass[end], rel_tol=1e-9)
            elif end:
                assert share == 0
        assert math.isclose(mass[0], ends + 0.1, rel_tol=1e-9)
    # The score of a text is the sum over its tokens of the log shares and the words' shares of their ends.
    held = spark.createDataFrame([(1000, "alpha gamma1 unseen, beta"), (1001, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in language_model.score_texts(rows.union(held), F.col("doc_id") >= 1000).collect()}
    counts = {r["word"]: r["n"] for r in known}
    for i, text in held.collect():
        data = np.frombuffer(text.encode(), np.uint8)
        words, row, kind = language_model.tokens(data, np.array([0, len(data)]))
        path = language_model.paths(words, kind)
        n = np.array([ends if k == 0 else counts.get(w, 0) for w, k in zip(words.view(np.int64).tolist(), kind)])
        score = tree.log_share(language_model.histories(words, row, kind), path).sum() + np.log10((n + 0.1) / 10 ** tree.end_log[path >> shift]).sum()
        assert math.isclose(got[i], score, rel_tol=1e-4)


def test_frequent_words(spark):
    rows = [(i, 1 << 13, n) for i, n in enumerate([1] * 50 + [7, 9, 40, 41, 1000])]
    vocabulary = spark.createDataFrame(rows, "word long, path int, n long")
    assert sorted(language_model.frequent_words(vocabulary, 4)[0].tolist()) == [51, 52, 53, 54]
    assert len(language_model.frequent_words(vocabulary, 60)[0]) == 55
    assert len(language_model.frequent_words(vocabulary.limit(0), 60)[0]) == 0


def test_language_model_in_any_partitions(spark):
    """Scores don't depend on how the rows are partitioned, and training doesn't shrink with partitions."""
    rows = spark.createDataFrame([(i, f"alpha beta gamma{i % 3} delta epsilon zeta{i % 5} eta") for i in range(120)], "doc_id long, text string")
    one, many = (
        {r["doc_id"]: (r["score"], r["base_score"]) for r in language_model.score_texts(rows.repartition(n, "doc_id"), F.col("doc_id") % 10 == 0).collect()} for n in (1, 40)
    )
    assert all(math.isclose(one[i][0], many[i][0], rel_tol=1e-9) for i in one)
    assert sum(s for s, _ in many.values()) > sum(b for _, b in many.values())


def test_language_model_mean_of_those_who_met():
    """A row that one task met keeps that task's whole change; a row of several has their mean by tokens."""
    size = language_model.BLOCK
    seen = np.zeros((2, size), np.float32)
    change = np.zeros((2, size, 16), np.float32)
    seen[0, 5], change[0, 5] = 7, range(16)
    seen[:, 9], change[0, 9], change[1, 9] = (1, 3), 4, 8
    tasks = language_model.pd.DataFrame({"block": [2, 2], "seen": [x.tobytes() for x in seen], "change": [x.tobytes() for x in change]})
    got = np.frombuffer(language_model.mean_change(tasks)["change"][0], np.float32).reshape(size, 16)
    assert got[5].tolist() == list(range(16)) and got[9].tolist() == [7] * 16 and not got[[0, 63]].any()


def brute_quality(text):
    words = ascii_words(text)
    runs = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if runs[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if ascii_words(x)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def test_quality(docs, labels, empty):
    out = quality.judge(docs, labels)
    want = sorted(((t[0], *brute_quality(t[1])) for t in table()), key=repr)
    assert rows_of(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert not any(r["kept"] and r["base_failed"] for r in out.collect())
    assert quality.judge(empty, labels).count() == 0
    assert all(r["score"] == 0 for r in quality.judge(docs, labels.limit(0)).collect())


def test_toxicity(spark, empty):
    said = [(i, f"Plain words number {i}. " + ("You are trash{} now. ".format("xyz"[i % 3]) if i % 2 else "") + "More to say.") for i in range(200)] + [(500, None), (501, ""), (None, "plain"), (3, "plain")]
    docs = spark.createDataFrame(said, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(7, None)], "doc_id long, toxic int")
    out = toxicity.detect(docs, labels, F.col("doc_id") % 5 == 0).collect()
    assert len(out) == len(said)
    long = [r for r in out if r["doc_id"] is not None and r["doc_id"] < 200]
    assert sum(r["predicted"] == r["doc_id"] % 2 for r in long if r["held_out"]) >= 38
    assert any(r["offending"] == [1] for r in long if r["doc_id"] % 2)
    assert all(r["score"] == 0 for r in out if r["doc_id"] in (500, 501))
    assert toxicity.detect(empty, labels, F.lit(False)).count() == 0


def test_chat_round_trip(spark):
    said = ["</s>[INST] ok [/INST]", "<~s>[~~INST]", "<<SYS>>\n x \n<</SYS>>\n", "", None, "a\\~<s", "[ROLE eA==] y [/ROLE]\n", "ends with <", "é<s>\n"]
    rows = [(c, t, role, said[(c + t) % len(said)]) for c in range(9) for t, role in enumerate(["system", "user", "assistant", "user", "tool", None, "assistant"])]
    rows += [(None, None, "user", "x"), (50, 1, "user", "x"), (50, 1, "user", "x"), (51, 1, "user", "hi"), (51, 2, "assistant", "yo")]
    out = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).withColumn("turns", chat_format.read_back(F.col("formatted")))
    want = defaultdict(list)
    for c, _, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or 0)):
        want[c].append((role or "", text or ""))
    for r in out.collect():
        assert [tuple(t) for t in r["turns"]] == want[r["conv_id"]]
        learned = [r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss_spans"]]
        assert len(learned) == sum(role == "assistant" for role, _ in want[r["conv_id"]])
        assert r["valid"] == (r["conv_id"] in (None, 51))
    assert chat_format.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def brute_components(rows):
    sets = []
    for t in rows:
        w = low(t[1]).encode().split()
        sets.append(frozenset([tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, t in enumerate(rows):
        least.setdefault(find(i), []).append(t[0])
    return sorted(((t[0], len(sets[i]), min((x for x in least[find(i)] if x is not None), default=None)) for i, t in enumerate(rows)), key=repr)


def test_jaccard(spark, docs, empty):
    assert rows_of(jaccard_join.jaccard_components(docs), "doc_id", "n_shingles", "component_id") == brute_components(table())
    small = [(i, " ".join(f"t{(i * 7 + k) % 12}" for k in range(4 + i % 9))) for i in range(150)]
    small += [(1000 + i, " ".join(f"u{(k if k != i % 23 else 90 + i)}" for k in range(60))) for i in range(40)]
    got = jaccard_join.jaccard_components(spark.createDataFrame(small, "doc_id long, text string"))
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == brute_components(small)
    assert jaccard_join.jaccard_components(empty).count() == 0


def test_jaccard_of_large_groups(spark, monkeypatch):
    """Groups of many blocks, with a pivot that doesn't reach all of them, and classes of many equal rows."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(70):  # a chain: each links with its neighbours, few with the pivot
        rows.append((i, " ".join(words[i % 30 : i % 30 + 28] + [f"end{i // 30}"])))
    for i in range(60):  # a star: near copies of one text
        rows.append((200 + i, " ".join(w if k != i else f"x{i}" for k, w in enumerate(f"s{i}" for i in range(80)))))
    rows += [(400 + i, "one and the same text of several words") for i in range(50)] + [(None, "one and the same text of several words"), (None, "no id and by itself here"), (500, "")]
    joined = common.keyed_join
    for most in (20_000, 3):
        monkeypatch.setattr(common, "keyed_join", lambda big, small, key, rows, most=most: joined(big, small, key, rows, most, 10))
        got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
        assert rows_of(got, "doc_id", "n_shingles", "component_id") == brute_components(rows)


def test_pipeline_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        out = spark.createDataFrame(stage(spark, docs, folder).collect(), stage(spark, docs, folder).schema)
        rows = [tuple(r) for r in out.collect()]
        if name != "shard":
            assert out.columns == columns
        if name == "quality":
            assert not any(brute_quality(r[1])[-1] for r in rows)
        if name == "near_duplicates":
            assert sorted(r[0] for r in rows) == sorted(c[0] for c in brute_components(before) if c[0] == c[2])
        if name == "decontaminate":
            assert sorted(r[0] for r in rows) == sorted(r[0] for r in before if not brute_contamination(r[1], items)[-1])
        if name == "mix":
            assert {r[0] for r in rows} <= {r[0] for r in before} and max(Counter(r[0] for r in rows).values()) <= 3
        if name == "shard":
            assert len(rows) == len(before)
        kept[name] = len(rows)
        docs = out
    assert kept["quality"] > 100


def test_keyed_joins_beyond_a_broadcast(spark):
    """Keys of many rows, of few, of none and null ones, with and without a broadcast of the whole table."""
    big = spark.createDataFrame([(k, i) for i, k in enumerate(["hot"] * 50 + ["a", "a", "b", "c", None, None])], "key string, at int")
    small = spark.createDataFrame([("hot", 50, 1), ("a", 2, 2), ("b", 1, 3), ("gone", 0, 4)], "key string, n long, value int")
    joined = [(k, i, {"hot": 1, "a": 2, "b": 3}[k]) for k, i in map(tuple, big.collect()) if k in ("hot", "a", "b")]
    for most in (100, 1):
        assert rows_of(common.keyed_join(big, small, "key", "n", most, 10), "key", "at", "value") == sorted(joined, key=repr)
        assert rows_of(common.keyed_rest(big, small, "key", "n", most, 10), "at") == [(53,), (54,), (55,)]


def test_sharding_of_a_large_group(spark):
    rows = [(i, "one text of a group that is larger than a shard") for i in range(20_000)] + [(20_000 + i, None) for i in range(3_000)] + [(30_000 + i, f"text {i // 2}") for i in range(4_000)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    sizes = Counter(r["shard"] for r in got)
    assert len(got) == 27_000 and set(sizes.values()) == {1125} and sorted(sizes) == list(range(24))
    assert sorted(r["doc_id"] for r in got) == sorted(i for i, _ in rows)
    shard = {r["doc_id"]: r["shard"] for r in got}
    # The large group fills its shards; the pairs, unlike the seeded start, are mostly together.
    assert sum(shard[30_000 + i] == shard[30_001 + i] for i in range(0, 4_000, 2)) > 1_000


def test_toxicity_reads_no_held_out_label(spark):
    said = [(i, f"Plain words number {i}. " + ("You are trashy now. " if i % 2 else "") + "x" * (100_000 if i == 8 else 1)) for i in range(100)]
    docs = spark.createDataFrame([(*r, 1, 0.5) for r in said], "doc_id long, text string, toxic int, score double")
    labels = [(i, i % 2) for i in range(100)] + [(3, 1), (3, 0), (3, 1)]
    turned = [(i, 1 - t if i % 5 == 0 else t) for i, t in labels] + [(5 * i, 1) for i in range(300)]
    a, b = (rows_of(toxicity.detect(docs, spark.createDataFrame(x, "doc_id long, toxic int"), F.col("doc_id") % 5 == 0), "doc_id", "score") for x in (labels, turned))
    assert a == b and len(a) == 100


def test_toxicity_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "WORDS", 3_000)
    rows = spark.createDataFrame([(i, "some words of a text " * 20) for i in range(200)], "doc_id long, text string")
    marked = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    found = toxicity.sampled(rows, marked).collect()
    assert 0 < sum(len(r["words"]) for r in found) <= 3_000 and len({len(r["words"]) for r in found}) == 1


def test_chat_of_many_turns(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"said {t} <s>" + "é" * (t % 50) + ("z" * 200_000 if t == 77 else ""), "s", 1) for t in range(3_000)] + [(2, 0, "assistant", "first", "s", 1)]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments string, at int")
    by = {r["conv_id"]: r for r in chat_format.format_chats(chats).withColumn("turns", chat_format.read_back(F.col("formatted"))).collect()}
    r = by[1]
    assert [tuple(t) for t in r["turns"]] == [x[2:4] for x in rows[:-1]] and r["valid"]
    spans = [r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss_spans"]]
    assert spans == [s["text"] for s in r["segments"] if s["loss"]] and len(spans) == 1_500
    assert not by[2]["valid"] and by[2]["invalid_at"] == 0


def test_language_learning(spark):
    """The model's counts and blended logs, by brute force: nulls, wordless texts, shared and rare words."""
    said = [("en", "The cat and the dog"), ("en", "the bird"), ("de", "der Hund und die Katze der"), ("fr", "le chat, le chien"), ("fr", None), ("xx", "123 ..."), ("de", "Über über"), ("en", "The cat and the dog")]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(said)], "doc_id long, lang string, text string")
    langs, prior, tables = language.learn(rows.select("lang", "text", "doc_id"))
    assert langs == ["de", "en", "fr"] and np.allclose(prior, np.log(np.array([2, 3, 2]) / 7))
    counts = {x: [Counter() for _ in range(language.GRAMS + 1)] for x in langs}
    for lang, text in said:
        for word in regex.findall(r"\p{L}+", (text or "").lower()):
            counts[lang][0][word] += 1
            for n in range(1, language.GRAMS + 1):
                framed = word if n == 1 else f"<{word}>"
                counts[lang][n].update(framed[i : i + n] for i in range(len(framed) - n + 1))
    for n in range(language.GRAMS + 1):
        every = sum((counts[x][n] for x in langs), Counter())
        assert set(tables[n]) == {f for f, c in every.items() if c >= 2}
        for f, got in tables[n].items():
            share = language.BLEND * every[f] / sum(every.values())
            assert np.allclose(got, [math.log((1 - language.BLEND) * counts[x][n][f] / sum(counts[x][n].values()) + share) for x in langs])


def test_language_sample_of_rows_without_ids(spark, monkeypatch):
    monkeypatch.setattr(language, "FIT", 10)
    rows = [("en", f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}q word{k}", None) for k in range(3000)]
    _, _, tables = language.learn(spark.createDataFrame(rows, "lang string, text string, doc_id long"))
    # About ten texts, not all: the letters of so few meet hardly any three-grams twice but those of the common word.
    assert 0 < len(tables[3]) < 100
