"""Queries of the operators on edit strings and coverage.

Records come from ``lineitem``: each line is a read of 32 letters whose place, edit string, letters and qualities follow
from its columns by rules that the SQL states as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import exact
from weftline.operators import alignment, calling, coverage, edits, mask_ambiguous, ordering, variants
from weftline.registry import query, table

LETTERS, HEX = "ACGTACGTACGTACGT", "0123456789abcdef"
PRIMER, SLOP, DEPTH = 40, 4, 60

_READS = """keyed AS (SELECT *, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_quantity::INT AS name, (l_linenumber % 3)::INT AS s, (5 + l_quantity::INT % 7)::INT AS m, (l_suppkey % 4)::INT AS kind FROM lineitem),
reads AS (SELECT name, l_returnflag AS contig, (l_partkey * 3 + 1)::BIGINT AS pos, (l_tax * 100)::INT AS mapq, l_linestatus = 'O' AS reverse, l_orderkey, l_linenumber,
  CASE WHEN s > 0 THEN s || 'S' ELSE '' END || m || 'M' || CASE kind WHEN 0 THEN '1X' WHEN 1 THEN '2I' WHEN 2 THEN '3D' ELSE '50N' END || (32 - s - m - CASE kind WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END) || 'M' AS edits,
  translate(md5(name), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq, md5('q' || name) AS quals FROM keyed)"""
_OPS = """ops AS (SELECT name, contig, pos, mapq, reverse, edits, seq, quals, k, n, op,
  pos + coalesce(sum(CASE WHEN op IN ('M', 'X', 'D', 'N') THEN n ELSE 0 END) OVER before, 0) AS spot, coalesce(sum(CASE WHEN op IN ('M', 'X', 'I', 'S') THEN n ELSE 0 END) OVER before, 0) AS rd
  FROM (SELECT *, regexp_extract(o, '[0-9]+')::INT AS n, right(o, 1) AS op FROM (SELECT *, unnest(regexp_extract_all(edits, '[0-9]+[A-Z]')) AS o, generate_subscripts(regexp_extract_all(edits, '[0-9]+[A-Z]'), 1) AS k FROM (SELECT DISTINCT * FROM reads)))
  WINDOW before AS (PARTITION BY name, contig, mapq, reverse ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def _lines(spark, sf_dir: str, *columns: Column) -> DataFrame:
    """The columns of ``lineitem`` that reads are made of, equal rows once: what is derived from them isn't exchanged."""
    quantity = F.col("l_quantity").cast("int").alias("l_quantity")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", quantity, *columns).distinct()


def _name() -> Column:
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


def _digits(of: Column) -> Column:
    """The sixteen values of each of the 32 digits of a hash, from 0."""
    return F.transform(F.split(F.md5(of), ""), lambda c: F.instr(F.lit(HEX), c) - 1)


def _seq(name: Column) -> Column:
    return F.translate(F.md5(name), HEX, LETTERS)


def _quals(name: Column) -> Column:
    return F.transform(F.slice(_digits(F.concat(F.lit("q"), name)), 1, 32), lambda d: d * 3)


def reads(spark, sf_dir: str) -> DataFrame:
    """(name, contig, pos, mapq, reverse, edits, seq, quals), equal ones once."""
    s, m, kind = F.col("l_linenumber") % 3, 5 + F.col("l_quantity") % 7, F.col("l_suppkey") % 4
    middle = F.when(kind == 0, "1X").when(kind == 1, "2I").when(kind == 2, "3D").otherwise("50N")
    rest = 32 - s - m - F.when(kind == 0, 1).when(kind == 1, 2).otherwise(0)
    own = F.col("l_returnflag").alias("contig"), (F.col("l_tax") * 100).cast("int").alias("mapq"), (F.col("l_linestatus") == "O").alias("reverse")
    return _lines(spark, sf_dir, *own).select(
        _name().alias("name"), "contig", (F.col("l_partkey") * 3 + 1).alias("pos"), "mapq", "reverse",
        F.concat(F.when(s > 0, F.concat(s.cast("string"), F.lit("S"))).otherwise(""), m.cast("string"), F.lit("M"), middle, rest.cast("string"), F.lit("M")).alias("edits"),
        _seq(_name()).alias("seq"), _quals(_name()).alias("quals"),
    )


# Records on their reference


@query(f"""WITH {_READS}, {_OPS}, b AS (SELECT name, contig, spot + i AS pos, CASE WHEN op = 'D' THEN '*' ELSE substr(seq, (rd + i + 1)::INT, 1) END AS letter, CASE WHEN op <> 'D' THEN (instr('{HEX}', substr(quals, (rd + i + 1)::INT, 1)) - 1) * 3 END AS qual
  FROM (SELECT *, unnest(range(n)) AS i FROM ops WHERE op IN ('M', 'X', 'D') AND mapq >= 2)),
r AS (SELECT *, row_number() OVER (PARTITION BY contig, pos ORDER BY name, letter, qual NULLS FIRST) AS k, count(*) OVER (PARTITION BY contig, pos) AS n FROM b WHERE qual >= 9 OR letter = '*')
SELECT contig, pos::BIGINT AS pos, count(*) FILTER (letter = 'A') AS n_a, count(*) FILTER (letter = 'C') AS n_c, count(*) FILTER (letter = 'G') AS n_g, count(*) FILTER (letter = 'T') AS n_t,
  count(*) FILTER (letter NOT IN ('A', 'C', 'G', 'T', '*')) AS n_other, count(*) FILTER (letter = '*') AS n_del, count(*) AS depth, max(n) > {DEPTH} AS capped FROM r WHERE k <= {DEPTH} GROUP BY 1, 2""")
def l_pileup(spark, sf_dir):
    return edits.pileup(reads(spark, sf_dir), ["name"], max_depth=DEPTH, min_mapq=2, min_qual=9)


@query(f"""WITH {_READS}, {_OPS}, g AS (SELECT *, coalesce(sum(CASE WHEN op = 'N' THEN 1 ELSE 0 END) OVER (PARTITION BY name, contig, mapq, reverse ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS segment FROM ops)
SELECT name, contig, mapq, segment::INT AS segment, min(spot)::BIGINT AS pos, string_agg(n || op, '' ORDER BY k) FILTER (op <> 'N') AS core, (max(n) FILTER (op = 'N'))::INT AS gap,
  CASE WHEN min(rd) > 0 THEN min(rd)::INT || 'S' ELSE '' END || string_agg(n || op, '' ORDER BY k) FILTER (op <> 'N') || CASE WHEN max(rd + CASE WHEN op IN ('M', 'X', 'I', 'S') THEN n ELSE 0 END) < 32 THEN (32 - max(rd + CASE WHEN op IN ('M', 'X', 'I', 'S') THEN n ELSE 0 END))::INT || 'S' ELSE '' END AS edits
FROM g GROUP BY name, contig, mapq, reverse, segment""")
def p_split_gaps(spark, sf_dir):
    return edits.split_at_gaps(reads(spark, sf_dir)).select("name", "contig", "mapq", "segment", "pos", "core", "gap", "edits")


@query(f"WITH {_READS} SELECT name, contig, mapq, reverse, pos, edits FROM (SELECT DISTINCT name, contig, mapq, reverse, pos, edits FROM reads)")
def p_join_gaps(spark, sf_dir):
    """Split and made whole again."""
    return edits.join_at_gaps(edits.split_at_gaps(reads(spark, sf_dir)), ["name", "contig", "mapq", "reverse"])


@query(f"""WITH {_READS}, o AS (SELECT DISTINCT name, contig, mapq, reverse, seq, quals FROM reads)
SELECT row_number() OVER (ORDER BY name, contig, mapq, reverse) AS rank, name, CASE WHEN reverse THEN reverse(translate(seq, 'ACGT', 'TGCA')) ELSE seq END AS seq, (instr('{HEX}', substr(quals, CASE WHEN reverse THEN 32 ELSE 1 END, 1)) - 1) * 3 AS first_qual FROM o""")
def p_revert_reads(spark, sf_dir):
    """Reads as they were, in order of their names (and of what told equal names apart). Letters follow from names, so they aren't sorted with them."""
    key = ["name", "contig", "mapq", "reverse"]
    ordered = ordering.ranked(reads(spark, sf_dir).select(*key), key).withColumns({"seq": _seq(F.col("name")), "quals": _quals(F.col("name"))})
    return edits.reverted(ordered).select("rank", "name", "seq", F.get("quals", F.lit(0)).cast("long").alias("first_qual"))


@query("SELECT row_number() OVER (ORDER BY l_partkey, l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS rank, l_partkey, l_orderkey, l_linenumber FROM lineitem")
def u_gather_parts(spark, sf_dir):
    """Three ranges of parts, gathered in order."""
    items = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    most = (items.agg(F.max("l_partkey")).first()[0] or 0) + 1
    parts = [items.where((F.col("l_partkey") * 3 >= k * most) & (F.col("l_partkey") * 3 < (k + 1) * most)) for k in range(3)]
    return ordering.gathered(parts, items.columns).select("rank", "l_partkey", "l_orderkey", "l_linenumber")


# Coverage

_SPANS = "spans AS (SELECT p_type AS contig, (p_partkey * 5)::BIGINT AS lo, (p_partkey * 5 + p_size * 3)::BIGINT AS hi FROM part)"
_TARGETS = "targets AS (SELECT s_suppkey, ['ECONOMY', 'STANDARD', 'PROMO'][(s_suppkey % 3)::INT + 1] AS contig, (s_suppkey * 70)::BIGINT AS lo, (s_suppkey * 70 + 40 + s_nationkey)::BIGINT AS hi FROM supplier)"


def spans(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_type").alias("contig"), (F.col("p_partkey") * 5).alias("lo"), (F.col("p_partkey") * 5 + F.col("p_size") * 3).alias("hi"))


def targets(spark, sf_dir: str) -> DataFrame:
    contig = F.element_at(F.array(*map(F.lit, ("ECONOMY", "STANDARD", "PROMO"))), (F.col("s_suppkey") % 3).cast("int") + 1)
    return table(spark, sf_dir, "supplier").select("s_suppkey", contig.alias("contig"), (F.col("s_suppkey") * 70).alias("lo"), (F.col("s_suppkey") * 70 + 40 + F.col("s_nationkey")).alias("hi"))


@query(f"""WITH {_SPANS}, e AS (SELECT contig, spot, sum(d) AS d FROM (SELECT contig, lo AS spot, 1 AS d FROM spans UNION ALL SELECT contig, hi + 1, -1 FROM spans) GROUP BY 1, 2)
SELECT contig, spot AS lo, (next - 1)::BIGINT AS hi, depth::BIGINT AS depth FROM (SELECT contig, spot, lead(spot) OVER w AS next, sum(d) OVER w AS depth FROM e WHERE d <> 0 WINDOW w AS (PARTITION BY contig ORDER BY spot)) WHERE next IS NOT NULL""")
def cov_runs(spark, sf_dir):
    return coverage.depth_runs(spans(spark, sf_dir), ["contig"])


_POSITIONS = "extent AS (SELECT contig, min(lo) AS first, max(hi) AS last FROM spans GROUP BY 1), positions AS (SELECT contig, unnest(generate_series(first, last)) AS pos FROM extent), spot AS (SELECT contig, unnest(generate_series(lo, hi)) AS pos FROM spans), depths AS (SELECT contig, pos, count(a.pos) AS depth FROM positions p LEFT JOIN spot a USING (contig, pos) GROUP BY 1, 2)"


@query(f"WITH {_SPANS}, {_POSITIONS} SELECT contig, least(depth, 12)::BIGINT AS depth, count(*) AS positions FROM depths GROUP BY 1, 2")
def cov_histogram(spark, sf_dir):
    return coverage.depth_histogram(coverage.depth_runs(spans(spark, sf_dir), ["contig"]), ["contig"], most=12)


@query(f"""WITH {_SPANS}, {_POSITIONS} SELECT contig, count(*) AS positions, avg(depth) AS mean, stddev_pop(depth) AS sd, quantile_disc(depth, 0.5)::BIGINT AS median,
  avg((depth >= 1)::INT) AS pct_1, avg((depth >= 5)::INT) AS pct_5, avg((depth >= 20)::INT) AS pct_20 FROM depths GROUP BY 1""")
def cov_summary(spark, sf_dir):
    histogram = coverage.depth_histogram(coverage.depth_runs(spans(spark, sf_dir), ["contig"]), ["contig"])
    return coverage.depth_summary(histogram, ["contig"], [1, 5, 20])


@query(f"""WITH {_SPANS}, {_TARGETS}, p AS (SELECT s_suppkey, contig, unnest(generate_series(lo, hi)) AS pos FROM targets), spot AS (SELECT contig, unnest(generate_series(lo, hi)) AS pos FROM spans),
d AS (SELECT s_suppkey, pos, count(a.pos) AS depth FROM p LEFT JOIN spot a USING (contig, pos) GROUP BY 1, 2)
SELECT s_suppkey, count(*) AS positions, avg(depth) AS mean, min(depth) AS least, max(depth) AS most, avg((depth >= 1)::INT) AS pct_1, avg((depth >= 8)::INT) AS pct_8 FROM d GROUP BY 1""")
def cov_targets(spark, sf_dir):
    return coverage.target_depth(spans(spark, sf_dir), targets(spark, sf_dir), ["s_suppkey"], ["contig"], [1, 8])


# Clipping

_LENGTH = "CASE kind WHEN 1 THEN 30 WHEN 2 THEN 35 WHEN 3 THEN 82 ELSE 32 END - s"


def _clip_sql(rows: str, hard: bool) -> str:
    """Of ``rows`` (reads with lo, hi, front and back): the same cut, op by op."""
    front, back = ("'H'", "'H'") if hard else ("'S'", "'S'")
    kind = lambda n, op, was: f"CASE WHEN {n} > 0 THEN {n} || CASE WHEN {n} > {was} THEN {op} ELSE 'S' END ELSE '' END"
    kept = f"substr(seq, CASE WHEN lead > s THEN lead ELSE 0 END + 1, 32 - CASE WHEN lead > s THEN lead ELSE 0 END - tail)" if hard else "seq"
    return f"""{rows},
ops AS (SELECT *, pos + coalesce(sum(CASE WHEN op IN ('M', 'X', 'D', 'N') THEN n ELSE 0 END) OVER before, 0) AS spot, coalesce(sum(CASE WHEN op IN ('M', 'X', 'I', 'S') THEN n ELSE 0 END) OVER before, 0) AS rd
  FROM (SELECT *, regexp_extract(o, '[0-9]+')::INT AS n, right(o, 1) AS op FROM (SELECT *, unnest(regexp_extract_all(edits, '[0-9]+[A-Z]')) AS o, generate_subscripts(regexp_extract_all(edits, '[0-9]+[A-Z]'), 1) AS k FROM bounded))
  WINDOW before AS (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, greatest(0, lo - spot, front - rd) AS off, CASE WHEN op IN ('M', 'X') THEN greatest(0, least(n, hi - spot + 1, 32 - back - rd) - greatest(0, lo - spot, front - rd)) WHEN op = 'S' THEN 0 ELSE n END AS kept FROM ops),
z AS (SELECT *, min(k) FILTER (op IN ('M', 'X') AND kept > 0) OVER (PARTITION BY id) AS ka, max(k) FILTER (op IN ('M', 'X') AND kept > 0) OVER (PARTITION BY id) AS kz FROM c),
g AS (SELECT id, any_value(name) AS name, any_value(contig) AS contig, any_value(mapq) AS mapq, any_value(reverse) AS reverse, any_value(seq) AS seq, any_value(s) AS s, (max(CASE WHEN k = ka THEN spot + off END))::BIGINT AS pos, (max(CASE WHEN k = ka THEN rd + off END))::INT AS lead,
  (32 - max(CASE WHEN k = kz THEN rd + off + kept END))::INT AS tail, string_agg(kept::INT || op, '' ORDER BY k) FILTER (k BETWEEN ka AND kz AND kept > 0) AS core, (sum(n) FILTER (op IN ('M', 'X')) - sum(kept) FILTER (op IN ('M', 'X')))::INT AS n_clipped FROM z GROUP BY id)
SELECT name, contig, mapq, reverse, pos, {kind('lead', front, 's')} || core || {kind('tail', back, '0')} AS edits, n_clipped, {kept} AS seq FROM g"""


_CLIPPED = ["name", "contig", "mapq", "reverse", "pos", "edits", "n_clipped", "seq"]
_DISTINCT = "own AS (SELECT DISTINCT name, contig, pos, mapq, reverse, edits, seq, s, kind FROM (SELECT *, l_linenumber % 3 AS s, l_suppkey % 4 AS kind FROM (SELECT r.*, l_suppkey FROM reads r JOIN (SELECT DISTINCT name, l_suppkey FROM keyed) USING (name))))"


def _ends_sql(hard: bool) -> str:
    bounded = "bounded AS (SELECT *, row_number() OVER () AS id, -1000 AS lo, 1000000000 AS hi, CASE WHEN reverse THEN 2 ELSE 6 END AS front, CASE WHEN reverse THEN 6 ELSE 2 END AS back FROM own)"
    return _clip_sql(f"WITH {_READS}, {_DISTINCT}, {bounded}", hard)


@query(_ends_sql(False))
def p_clip_ends(spark, sf_dir):
    """The first six and last two letters, as read; soft clips count."""
    return edits.clip_ends(reads(spark, sf_dir), five=6, three=2).select(*_CLIPPED)


@query(_ends_sql(True))
def p_clip_hard(spark, sf_dir):
    return edits.clip_ends(reads(spark, sf_dir), five=6, three=2, hard=True).select(*_CLIPPED)


_PRIMERS = f"primers AS (SELECT ['A', 'N', 'R'][(s_suppkey % 3)::INT + 1] AS contig, s_suppkey * {PRIMER} + s_nationkey AS lo, s_suppkey * {PRIMER} + s_nationkey + 9 + s_nationkey % 7 AS hi, s_nationkey % 2 = 1 AS reverse FROM supplier)"


@query(_clip_sql(f"""WITH {_READS}, {_DISTINCT}, {_PRIMERS}, begun AS (SELECT *, row_number() OVER () AS id, CASE WHEN reverse THEN pos + {_LENGTH} - 1 ELSE pos END AS begins FROM own),
best AS (SELECT id, arg_min(CASE WHEN b.reverse THEN p.lo ELSE p.hi END, (abs(CASE WHEN b.reverse THEN p.hi ELSE p.lo END - begins), p.lo, -p.hi)) AS inner_end
  FROM begun b JOIN primers p ON p.contig = b.contig AND p.reverse = b.reverse AND abs(CASE WHEN b.reverse THEN p.hi ELSE p.lo END - begins) <= {SLOP} GROUP BY id),
bounded AS (SELECT b.*, CASE WHEN NOT reverse AND inner_end IS NOT NULL THEN inner_end + 1 ELSE -1000 END AS lo, CASE WHEN reverse AND inner_end IS NOT NULL THEN inner_end - 1 ELSE 1000000000 END AS hi, 0 AS front, 0 AS back FROM begun b LEFT JOIN best USING (id))""", False))
def p_trim_primers(spark, sf_dir):
    place, contig = F.col("s_suppkey") * PRIMER + F.col("s_nationkey"), F.element_at(F.array(*map(F.lit, "ANR")), (F.col("s_suppkey") % 3).cast("int") + 1)
    primers = table(spark, sf_dir, "supplier").select(contig.alias("contig"), place.alias("lo"), (place + 9 + F.col("s_nationkey") % 7).alias("hi"), (F.col("s_nationkey") % 2 == 1).alias("reverse"))
    return edits.trim_primers(reads(spark, sf_dir), primers, ["name", "contig", "mapq", "reverse"], SLOP).select(*_CLIPPED)


@query(_clip_sql(f"""WITH {_READS}, {_DISTINCT}, ended AS (SELECT *, row_number() OVER () AS id, pos + {_LENGTH} - 1 AS stop, split_part(name, '-', 3) AS part FROM own),
spans AS (SELECT *, min(pos) FILTER (NOT reverse) OVER w AS fs, max(stop) FILTER (NOT reverse) OVER w AS fe, min(pos) FILTER (reverse) OVER w AS rs, max(stop) FILTER (reverse) OVER w AS re FROM ended WINDOW w AS (PARTITION BY part, mapq, contig)),
bounded AS (SELECT *, 0 AS front, 0 AS back, CASE WHEN reverse AND fs <= rs AND fe >= rs THEN (rs + least(fe, re)) // 2 + 1 ELSE -1000 END AS lo, CASE WHEN NOT reverse AND fs <= rs AND fe >= rs THEN (rs + least(fe, re)) // 2 ELSE 1000000000 END AS hi FROM spans)""", False))
def p_clip_overlaps(spark, sf_dir):
    """Reads of one part and mapping quality are a pair."""
    pairs = reads(spark, sf_dir).withColumn("part", F.split("name", "-")[2])
    return edits.clip_overlaps(pairs, ["part", "mapq"]).select(*_CLIPPED)


# Left alignment


@query("""WITH RECURSIVE d AS (SELECT doc_id, text, length(text) AS n FROM documents), e AS (SELECT doc_id, unnest(generate_series(2, n - 4, 97)) AS pos FROM d WHERE n >= 6),
u AS (SELECT doc_id, pos AS origin, pos AS p, 'del' AS kind, substr(text, pos + 1, 3) AS unit FROM e JOIN d USING (doc_id) UNION ALL SELECT doc_id, pos, pos, 'ins', substr(text, pos - 1, 2) FROM e JOIN d USING (doc_id)),
m AS (SELECT * FROM u UNION ALL SELECT m.doc_id, origin, p - 1, kind, right(unit, 1) || substr(unit, 1, length(unit) - 1) FROM m JOIN d USING (doc_id) WHERE p > 0 AND substr(text, p, 1) = right(unit, 1)),
f AS (SELECT doc_id, origin, kind, min(p) AS p, arg_min(unit, p) AS unit FROM m GROUP BY ALL),
s AS (SELECT doc_id, origin, kind, p, unit, CASE WHEN p > 0 THEN substr(text, p, 1) WHEN kind = 'del' THEN substr(text, length(unit) + 1, 1) ELSE substr(text, 1, 1) END AS letter FROM f JOIN d USING (doc_id)),
l AS (SELECT *, CASE WHEN p > 0 THEN letter || unit ELSE unit || letter END AS long FROM s)
SELECT doc_id, origin::BIGINT AS origin, kind, greatest(p, 1)::BIGINT AS pos, CASE WHEN kind = 'del' THEN long ELSE letter END AS ref, CASE WHEN kind = 'del' THEN letter ELSE long END AS alt FROM l""")
def p_left_align(spark, sf_dir):
    """Every 97th place of each text: three letters behind it go, and the two up to it come twice."""
    docs = table(spark, sf_dir, "documents")
    n = F.length("text")
    # Texts are taken apart at every 32nd place first, so that a place isn't counted from a long text's beginning.
    parts = docs.where(n >= 6).select("doc_id", "text", n.alias("n"), F.explode(F.sequence(F.lit(2), n - 4, F.lit(32 * 97))).alias("at"))
    parts = parts.select("doc_id", "n", "at", F.substring("text", F.col("at") - 1, F.lit(32 * 97 + 4)).alias("text"))
    places = parts.select("doc_id", "at", "text", F.explode(F.sequence(F.col("at"), F.least(F.col("at") + 31 * 97, F.col("n") - 4), F.lit(97))).alias("origin"))
    around = places.select("doc_id", "origin", F.substring("text", F.col("origin") - F.col("at") + 1, F.lit(5)).alias("around"))
    letter, ahead = F.substring("around", 2, 1), F.substring("around", 2, 4)
    gone = F.struct(F.lit("del").alias("kind"), ahead.alias("ref"), letter.alias("alt"))
    come = F.struct(F.lit("ins").alias("kind"), letter.alias("ref"), F.concat(letter, F.left("around", F.lit(2))).alias("alt"))
    changes = around.select("doc_id", F.col("origin").cast("long").alias("origin"), F.inline(F.array(gone, come))).withColumn("pos", F.col("origin"))
    return alignment.left_aligned(changes, alignment.chunked(docs, "doc_id", "text"), contig="doc_id").select("doc_id", "origin", "kind", "pos", "ref", "alt")


# The filters of calls, one after the other


_BIG = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


@query("""WITH RECURSIVE d AS (SELECT doc_id, translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS text, length(text) AS n FROM documents), e AS (SELECT doc_id, unnest(generate_series(3, n - 5, 131)) AS spot FROM d WHERE n >= 8),
c AS (SELECT doc_id, spot, spot % 17 AS qual, [(spot % 4)::INT, (spot // 4 % 4)::INT, CASE WHEN spot % 5 = 0 THEN NULL ELSE (spot // 16 % 4)::INT END] AS chosen, translate(upper(substr(text, spot, 3)), 'KMRYSWBVHDX', 'NNNNNNNNNNN') AS ref,
  substr(text, spot, 3) AS own, substr(text, spot - 1, 1) AS before FROM e JOIN d USING (doc_id) WHERE regexp_full_match(substr(text, spot - 1, 4), '[A-Za-z]+')),
a AS (SELECT *, unnest([1, 2, 3]) AS k, unnest([before || substr(ref, 2, 1) || 'q', left(ref, 1), ref || substr(ref, 2, 2)]) AS alt FROM c WHERE qual > 5),
s AS (SELECT *, list_filter([0, 1, 2], lambda i: chosen[i + 1] = k) AS samples, len(list_filter(chosen, lambda g: g IS NOT NULL)) AS ns FROM a),
p AS (SELECT doc_id, spot + i - 1 AS pos, substr(ref, i, 1) AS ref, substr(alt, i, 1) AS alt, samples, ns FROM s, (SELECT unnest([1, 2, 3]) AS i) WHERE k = 1 AND len(samples) > 0 AND substr(ref, i, 1) <> substr(alt, i, 1)),
u AS (SELECT doc_id, spot AS p, k, substr(ref, 2, 2) AS unit, spot AS place, samples, ns, ref FROM s WHERE k > 1 AND len(samples) > 0),
t AS (SELECT doc_id, k, unit, samples, ns, ref, place, row_number() OVER () AS id FROM u),
m AS (SELECT id, doc_id, place AS p, unit FROM t UNION ALL SELECT id, doc_id, p - 1, right(unit, 1) || substr(unit, 1, length(unit) - 1) FROM m JOIN d USING (doc_id) WHERE p > 0 AND substr(text, p, 1) = right(unit, 1)),
f AS (SELECT id, min(p) AS p, arg_min(unit, p) AS unit FROM m GROUP BY id),
l AS (SELECT t.doc_id, k, samples, ns, f.p, f.unit, CASE WHEN f.p > 0 THEN substr(text, f.p, 1) WHEN k = 2 THEN substr(text, length(f.unit) + 1, 1) ELSE substr(text, 1, 1) END AS letter FROM t JOIN f USING (id) JOIN d ON d.doc_id = t.doc_id),
w AS (SELECT doc_id, greatest(p, 1) AS pos, CASE WHEN k = 2 THEN CASE WHEN p > 0 THEN letter || unit ELSE unit || letter END ELSE letter END AS ref, CASE WHEN k = 2 THEN letter WHEN p > 0 THEN letter || unit ELSE unit || letter END AS alt, samples, ns FROM l),
x AS (SELECT doc_id, pos, ref, alt, samples, ns FROM p UNION ALL SELECT doc_id, pos, ref, alt, samples, ns FROM w)
SELECT doc_id AS contig, pos::BIGINT AS pos, ref, alt, array_to_string(list_sort(list_distinct(flatten(list(samples)))), ',') AS samples, len(list_distinct(flatten(list(samples))))::INT AS ac, max(ns)::INT AS ns FROM x WHERE ref <> alt GROUP BY 1, 2, 3, 4""")
def f_call_chain(spark, sf_dir):
    """Calls at every 131st place that lies within a word: another first and last letter, two letters gone, two letters twice."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n, spot = F.length("text"), F.col("spot")
    # One pass takes the four letters around each place that has three more behind; with a text, or its length, beside each of its places the work grows with the square of the length.
    around = F.regexp_extract_all(F.substring("text", F.lit(2), n), F.lit("(?s)(.{4})(?=.{3}).{0,127}"), F.lit(1))
    at = docs.select("doc_id", F.posexplode(around).alias("k", "around")).where(F.col("around").rlike(r"^[A-Za-z]+\z")).withColumn("spot", F.col("k") * 131 + 3)
    at = at.withColumn("ref", mask_ambiguous(F.right("around", F.lit(3)))).withColumn("before", F.upper(F.left("around", F.lit(1))))
    second, last = F.substring("ref", 2, 1), F.substring("ref", 2, 2)
    chosen = F.array(spot % 4, F.floor(spot / 4).cast("int") % 4, F.when(spot % 5 != 0, F.floor(spot / 16).cast("int") % 4))
    calls = at.select(F.col("doc_id").alias("contig"), spot.cast("long").alias("pos"), "ref", F.array(F.concat("before", second, F.lit("q")), F.left("ref", F.lit(1)), F.concat("ref", last)).alias("alts"), (spot % 17).alias("qual"), chosen.alias("chosen"))
    letters = F.col("letters")  # translate is slow, and plain letters are what upper changes of ASCII
    big = F.when(F.octet_length(letters) == F.length(letters), F.upper(letters)).otherwise(F.translate(letters, *_BIG))
    out = variants.cleaned_calls(calls, alignment.chunked(docs, "doc_id", "text").withColumn("letters", big))
    return out.withColumn("samples", F.array_join(F.col("samples").cast("array<string>"), ","))


# Consensus by likelihood

_MOLECULES = """molecules AS (SELECT l_partkey, name, l_linestatus AS strand, i, (instr('0123456789abcdef', substr(md5('q' || name), i, 1)) - 1) * 3 AS qual,
  translate(CASE WHEN substr(md5(name), i, 1) = '0' THEN substr(md5('e' || name), i, 1) ELSE substr(md5(l_partkey::VARCHAR), i, 1) END, '0123456789abcdef', 'ACGTACGTACGTACGT') AS letter
  FROM (SELECT DISTINCT l_partkey, name, l_linestatus FROM keyed), (SELECT unnest(generate_series(1, 32)) AS i))"""


def _likely_sql(group: str, source: str = "molecules") -> str:
    return f"""w AS (SELECT *, least(0.75, power(10.0, -qual / 10.0) + power(10.0, -4.0) - power(10.0, -qual / 10.0) * power(10.0, -4.0) * 4.0 / 3.0) AS wrong FROM {source} WHERE qual >= 10),
c AS (SELECT {group}, i, cand, sum(CASE WHEN letter = cand THEN ln(1 - wrong) ELSE ln(wrong / 3) END) AS ll, count(*) FILTER (letter = cand) AS n, count(*) AS depth FROM w, (SELECT unnest(['A', 'C', 'G', 'T']) AS cand) GROUP BY {group}, i, cand),
r AS (SELECT *, row_number() OVER (PARTITION BY {group}, i ORDER BY ll DESC, cand DESC) AS k, max(ll) OVER (PARTITION BY {group}, i) AS top FROM c),
b AS (SELECT {group}, i, max(cand) FILTER (k = 1) AS cand, max(n) FILTER (k = 1) AS n, any_value(depth) AS depth, max(ll) FILTER (k = 1) - max(ll) FILTER (k = 2) > 1e-9 AND any_value(depth) >= 2 AS sure, sum(exp(ll - top)) FILTER (k > 1) AS others FROM r GROUP BY {group}, i),
likely AS (SELECT {group}, (i - 1)::INT AS pos, CASE WHEN sure THEN cand ELSE 'N' END AS letter, CASE WHEN sure THEN greatest(2.0, least(90.0, -10 * log10(others / (1 + others) + power(10.0, -4.5) - others / (1 + others) * power(10.0, -4.5) * 4.0 / 3.0))) ELSE 2.0 END AS qual,
  CASE WHEN sure THEN 1 / (1 + others) ELSE 0.0 END AS posterior, depth, CASE WHEN sure THEN depth - n ELSE depth END AS errors FROM b)"""


def molecules(spark, sf_dir) -> DataFrame:
    """(l_partkey, strand, seq, quals): reads of a part's own letters, one in 16 of them drawn anew."""
    digits = lambda c: F.split(F.md5(c), "")
    own, other, drawn = digits(_name()), digits(F.concat(F.lit("e"), _name())), digits(F.col("l_partkey").cast("string"))
    letters = F.transform(F.slice(F.arrays_zip(own.alias("a"), other.alias("b"), drawn.alias("c")), 1, 32), lambda x: F.when(x["a"] == "0", x["b"]).otherwise(x["c"]))
    return _lines(spark, sf_dir, F.col("l_linestatus").alias("strand")).select("l_partkey", "strand", F.translate(F.array_join(letters, ""), HEX, LETTERS).alias("seq"), _quals(_name()).alias("quals"))


@query(f"WITH {_READS}, {_MOLECULES}, {_likely_sql('l_partkey')} SELECT l_partkey, pos, letter, round(qual, 6) AS qual, round(posterior, 9) AS posterior, depth, errors FROM likely")
def a_likely_letters(spark, sf_dir):
    letters = calling.placed_letters(molecules(spark, sf_dir), ["l_partkey"])
    return calling.likely_letters(letters, ["l_partkey"], min_reads=2).withColumns({"qual": F.round("qual", 6), "posterior": F.round("posterior", 9)})


@query(f"""WITH {_READS}, {_MOLECULES}, {_likely_sql('l_partkey, strand')},
p AS (SELECT l_partkey, pos, max(letter) FILTER (strand = 'O') AS a, max(letter) FILTER (strand = 'F') AS b, max(qual) FILTER (strand = 'O') AS qa, max(qual) FILTER (strand = 'F') AS qb, coalesce(max(depth) FILTER (strand = 'O'), 0) AS da, coalesce(max(depth) FILTER (strand = 'F'), 0) AS db,
  coalesce(max(errors) FILTER (strand = 'O'), 0) AS ea, coalesce(max(errors) FILTER (strand = 'F'), 0) AS eb FROM likely GROUP BY 1, 2),
l AS (SELECT *, CASE WHEN da + db < 4 OR greatest(da, db) < 3 OR least(da, db) < 1 OR a = 'N' OR b = 'N' THEN 'N' WHEN a IS NULL THEN b WHEN b IS NULL THEN a WHEN a = b THEN a WHEN abs(qa - qb) <= 1e-9 THEN 'N' WHEN qa > qb THEN a ELSE b END AS letter FROM p)
SELECT l_partkey, pos, letter, round(CASE WHEN letter = 'N' THEN 2.0 WHEN a IS NULL THEN qb WHEN b IS NULL THEN qa WHEN a = b THEN least(qa + qb, 90.0) ELSE greatest(abs(qa - qb), 2.0) END, 6) AS qual, da + db AS depth,
  ea + eb + CASE WHEN letter = 'N' THEN 0 WHEN a <> b AND letter = a THEN db - eb WHEN a <> b AND letter = b THEN da - ea ELSE 0 END AS errors, ((a IS NOT NULL)::INT + (b IS NOT NULL)::INT)::INT AS strands FROM l""")
def a_duplex(spark, sf_dir):
    letters = calling.placed_letters(molecules(spark, sf_dir), ["l_partkey", "strand"], meet=["l_partkey"])
    calls = calling.likely_letters(letters, ["l_partkey", "strand"], min_reads=2).withColumn("strand", F.when(F.col("strand") == "O", "A").otherwise("B"))
    return calling.duplex(calls, ["l_partkey"], min_reads=(4, 3, 1)).withColumn("qual", F.round("qual", 6))


@query(f"""WITH {_READS}, {_MOLECULES}, {_likely_sql('l_partkey')}, k AS (SELECT *, depth < 15 OR errors > 0.1 * depth OR qual < 30 AS unsure FROM likely),
f AS (SELECT *, sum(errors) OVER w <= 0.06 * sum(depth) OVER w AND max(depth) OVER w >= 15 AND count(*) FILTER (unsure OR letter = 'N') OVER w <= 0.5 * count(*) OVER w AND avg(qual) OVER w >= 40 AS passes FROM k WINDOW w AS (PARTITION BY l_partkey))
SELECT l_partkey, pos, CASE WHEN unsure THEN 'N' ELSE letter END AS letter, round(CASE WHEN unsure THEN 2.0 ELSE qual END, 6) AS qual, depth, errors FROM f WHERE passes""")
def f_consensus(spark, sf_dir):
    letters = calling.placed_letters(molecules(spark, sf_dir), ["l_partkey"])
    calls = calling.likely_letters(letters, ["l_partkey"], min_reads=2).drop("posterior")
    return calling.filtered(calls, ["l_partkey"], 15, 0.06, 0.1, 30, 0.5, 40).withColumn("qual", F.round("qual", 6))


# Exact tests

_CHOOSE = "lgamma({0} + 1.0) - lgamma({1} + 1.0) - lgamma({0} - {1} + 1.0)"
_FISHER = f"""k AS (SELECT id, a, b, c, d, unnest(generate_series(greatest(0, a + c - (c + d)), least(a + b, a + c))) AS x FROM counts),
p AS (SELECT *, exp({_CHOOSE.format('(a + b)', 'x')} + {_CHOOSE.format('(c + d)', '(a + c - x)')} - ({_CHOOSE.format('(a + b + c + d)', '(a + c)')})) AS p FROM k), q AS (SELECT *, max(p) FILTER (x = a) OVER (PARTITION BY id) AS own FROM p),
tests AS (SELECT id, coalesce(sum(p) FILTER (x <= a), 0) AS less, coalesce(sum(p) FILTER (x >= a), 0) AS greater, coalesce(sum(p) FILTER (p <= own * (1 + 1e-7)), 0) AS two_sided FROM q GROUP BY id)"""
_BINOMIAL = f"exp({_CHOOSE.format('n', 'k')} + k * ln({{0}}) + (n - k) * ln(1 - {{0}}))"


@query(f"""WITH u AS (SELECT user_id AS id, count(*) FILTER (event_type = 'error') AS a, count(*) FILTER (event_type <> 'error') AS b FROM events GROUP BY 1),
counts AS (SELECT id, a, b, (sum(a) OVER () - a)::BIGINT AS c, (sum(b) OVER () - b)::BIGINT AS d FROM u), {_FISHER}
SELECT id AS user_id, round(least(less, 1), 6) AS less, round(least(greater, 1), 6) AS greater, round(least(two_sided, 1), 6) AS two_sided FROM tests""")
def x_fisher(spark, sf_dir):
    """Of each user: errors among its events, against all others'."""
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("a"), F.count_if(F.col("event_type") != "error").alias("b"))
    total = users.agg(F.sum("a").alias("_a"), F.sum("b").alias("_b"))  # one row
    tested = users.join(F.broadcast(total)).withColumn("t", exact.fisher(F.col("a"), F.col("b"), F.col("_a") - F.col("a"), F.col("_b") - F.col("b")))
    return tested.select("user_id", *[F.round(f"t.{c}", 6).alias(c) for c in ("less", "greater", "two_sided")])


@query(f"""WITH c AS (SELECT o_custkey AS id, count(*) FILTER (o_orderstatus = 'F') AS x, count(*) AS n FROM orders GROUP BY 1), k AS (SELECT id, x, n, unnest(generate_series(0, n)) AS k FROM c),
p AS (SELECT *, {_BINOMIAL.format('0.4')} AS p FROM k), q AS (SELECT *, max(p) FILTER (k = x) OVER (PARTITION BY id) AS own FROM p)
SELECT id AS o_custkey, round(least(1, sum(p) FILTER (k <= x)), 6) AS less, round(least(1, sum(p) FILTER (k >= x)), 6) AS greater, round(least(1, sum(p) FILTER (p <= own * (1 + 1e-7))), 6) AS two_sided FROM q GROUP BY id""")
def x_binomial(spark, sf_dir):
    """Of each customer: finished orders among all, at a chance of 0.4."""
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("x"), F.count(F.lit(1)).alias("n"))
    return counts.withColumn("t", exact.binomial(F.col("x"), F.col("n"), F.lit(0.4))).select("o_custkey", *[F.round(f"t.{c}", 6).alias(c) for c in ("less", "greater", "two_sided")])


@query(f"""WITH t AS (SELECT l_partkey AS id, count(*) FILTER (l_linestatus = 'O' AND l_discount < 0.06) AS nr, count(*) FILTER (l_linestatus = 'O' AND l_discount >= 0.06 + 0.0004 * (l_partkey % 100)) AS na,
  count(*) FILTER (l_linestatus = 'F' AND l_discount < 0.06) AS tr, count(*) FILTER (l_linestatus = 'F' AND l_discount >= 0.06) AS ta FROM lineitem GROUP BY 1),
counts AS (SELECT id, ta AS a, tr AS b, na AS c, nr AS d FROM t), {_FISHER}, e AS (SELECT id, na + ta AS x, na + ta + nr + tr AS n, unnest(generate_series(na + ta, na + ta + nr + tr)) AS k FROM t),
v AS (SELECT id, least(1.0, sum({_BINOMIAL.format('0.001')})) AS p_variant FROM e GROUP BY id),
j AS (SELECT *, CASE WHEN ta + tr > 0 THEN ta / (ta + tr) ELSE 0 END AS ts, CASE WHEN na + nr > 0 THEN na / (na + nr) ELSE 0 END AS ns FROM t JOIN tests USING (id) JOIN v USING (id)),
s AS (SELECT *, CASE WHEN ts >= ns THEN least(greater, 1) ELSE least(less, 1) END AS p_somatic FROM j)
SELECT id AS l_partkey, round(p_variant, 6) AS p_variant, round(p_somatic, 6) AS p_somatic, CASE WHEN ns < 0.05 AND ts < 0.05 THEN 'Reference' WHEN ns < 0.05 AND p_somatic <= 0.05 THEN 'Somatic' WHEN ns >= 0.05 AND p_somatic <= 0.05 THEN 'LOH' WHEN ns >= 0.05 AND ts >= 0.05 AND p_variant <= 0.2 THEN 'Germline' ELSE 'Unknown' END AS status FROM s""")
def x_somatic(spark, sf_dir):
    """Of each part: large discounts among open lines (normal) and finished ones (tumor)."""
    normal, tumor = F.col("l_linestatus") == "O", F.col("l_linestatus") == "F"
    counts = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.count_if(normal & (F.col("l_discount") < 0.06)).alias("nr"), F.count_if(normal & (F.col("l_discount") >= 0.06 + 0.0004 * (F.col("l_partkey") % 100))).alias("na"),
        F.count_if(tumor & (F.col("l_discount") < 0.06)).alias("tr"), F.count_if(tumor & (F.col("l_discount") >= 0.06)).alias("ta"),
    )
    out = variants.somatic_status(counts, ("nr", "na"), ("tr", "ta"), min_share=0.05)
    return out.select("l_partkey", F.round("p_variant", 6).alias("p_variant"), F.round("p_somatic", 6).alias("p_somatic"), "status")
