"""Queries over tables of contents, ranges and the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import classify, names, ranges, toc
from quire.plans.catalogue import ENTRIES, PAGES, RECORDS, TOC_LINES, base, plain, query, read
from quire.plans.text_queries import tokens_sql, vectors_sql

TOC_SQL = f"toc AS (SELECT pdf_id, string_agg(line, chr(10) ORDER BY seq) AS text FROM ({plain(TOC_LINES)}) GROUP BY pdf_id)"


def _toc(spark, d) -> DataFrame:
    """(pdf_id, text): a synthetic contents page per document."""
    listed = F.array_sort(F.collect_list(F.struct("seq", "line")))
    return base(spark, d, TOC_LINES).groupBy("pdf_id").agg(F.array_join(F.transform(listed, lambda s: s.line), "\n").alias("text"))


CLEAN = r"regexp_replace(trim(regexp_replace(line, '\s+', ' ', 'g')), '\b(t0|t0o)\b', 'to', 'gi')"
STITCH_SQL = rf"""{TOC_SQL},
split AS (SELECT pdf_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM toc),
cleaned AS (SELECT pdf_id, pos, {CLEAN} AS line FROM split WHERE {CLEAN} <> ''),
grouped AS (
  SELECT *, sum(CASE WHEN regexp_matches(line, '^\s*[0-9]{{1,4}}[.)/:-]?\s+.+$') THEN 1 ELSE 0 END) OVER (PARTITION BY pdf_id ORDER BY pos) AS g FROM cleaned),
stitched AS (
  SELECT pdf_id, min(pos) AS pos, string_agg(line, ' ' ORDER BY pos) AS line FROM grouped GROUP BY pdf_id, CASE WHEN g = 0 THEN -pos ELSE g END)"""
ANN = r"'(?i)\b([A-Za-z]-?[0-9]+|Annexure\s*[-\w]*)\b'"
SKIP = r"'(?i)^(?:sr\.?\s*no|page\s*no|particulars|annexure|index|table\s+of\s+contents)\s*[:.]?\s*$'"


def _pages_sql(page: str) -> str:
    p = f"regexp_replace({page}, '(?i)\\bto\\b', '-', 'g')"
    n = f"regexp_extract({p}, '\\d+')"
    a, b = (f"regexp_extract({p}, '(\\d+)\\s*-\\s*(\\d+)', {k})" for k in (1, 2))
    return f"CAST(coalesce(nullif({a}, ''), nullif({n}, ''), '1') AS INT) AS page_from, CAST(coalesce(nullif({b}, ''), nullif({n}, ''), '1') AS INT) AS page_to"


def _titled_sql(raw: str) -> str:
    m = f"regexp_extract({raw}, {ANN})"
    return f"{m} AS annexure, CASE WHEN {m} = '' THEN {raw} ELSE trim(substr({raw}, 1, instr({raw}, {m}) - 1) || substr({raw}, instr({raw}, {m}) + length({m}))) END AS title"


STITCHED_SQL = STITCH_SQL + rf""",
bodies AS (
  SELECT pdf_id, pos, regexp_extract(line, '^\s*([0-9]{{1,4}})[.)/:-]?\s+(.+)$', 1) AS serial,
    CASE WHEN regexp_matches(line, '^\s*([0-9]{{1,4}})[.)/:-]?\s+(.+)$') THEN trim(regexp_extract(line, '^\s*([0-9]{{1,4}})[.)/:-]?\s+(.+)$', 2)) ELSE line END AS body
  FROM stitched WHERE NOT regexp_matches(line, {SKIP})),
tails AS (SELECT *, regexp_extract(body, '(?i)([0-9]{{1,4}}(?:\s*(?:-|to)\s*[0-9]{{1,4}})?/?)\s*$') AS tail FROM bodies),
raws AS (SELECT *, regexp_replace(trim(tail), '/+$', '') AS page, trim(substr(body, 1, length(body) - length(tail)), ' .:-') AS raw FROM tails WHERE tail <> ''),
st AS (
  SELECT pdf_id, pos, serial, annexure, title, page_from, page_to, 'toc-stitch' AS source FROM (
    SELECT *, {_titled_sql("raw")}, {_pages_sql("page")} FROM raws WHERE length(raw) >= 2) WHERE length(title) >= 2)"""
STRICT_RE = r"'^([0-9]+[.)/]?)\s+(.{3,}?)\s{1,8}([0-9]+(?:\s*(?:-|–|to)\s*[0-9]+)?)\s*$'"
LOOSE_RE = r"'^(.{4,}?)\s{2,}([0-9]+(?:\s*(?:-|–)\s*[0-9]+)?)\s*$'"
STRICT_SQL = rf"""
stripped AS (SELECT pdf_id, pos, trim(line) AS line FROM split),
sr AS (
  SELECT pdf_id, pos, serial, annexure, title, page_from, page_to, 'toc-regex-strict' AS source FROM (
    SELECT pdf_id, pos, regexp_replace(regexp_extract(line, {STRICT_RE}, 1), '[.)/ ]+$', '') AS serial, {_titled_sql(f"trim(regexp_extract(line, {STRICT_RE}, 2))")},
      {_pages_sql(f"regexp_extract(line, {STRICT_RE}, 3)")}
    FROM stripped WHERE regexp_matches(line, {STRICT_RE})) WHERE length(title) >= 2)"""
LOOSE_SQL = rf"""
lo AS (
  SELECT pdf_id, pos, '' AS serial, '' AS annexure, trim(regexp_extract(line, {LOOSE_RE}, 1)) AS title, {_pages_sql(f"regexp_extract(line, {LOOSE_RE}, 2)")}, 'toc-regex-loose' AS source
  FROM stripped WHERE regexp_matches(line, {LOOSE_RE}) AND NOT regexp_matches(line, {SKIP}) AND length(trim(regexp_extract(line, {LOOSE_RE}, 1))) >= 3)"""
HYBRID_SQL = f"""{STITCHED_SQL}, {STRICT_SQL}, {LOOSE_SQL},
counted AS (SELECT pdf_id, count(*) AS n FROM sr GROUP BY pdf_id),
merged AS (
  SELECT *, 0 AS parser FROM st UNION ALL BY NAME SELECT sr.*, 1 AS parser FROM sr JOIN counted USING (pdf_id) WHERE n >= 2
  UNION ALL BY NAME SELECT lo.*, 1 AS parser FROM lo LEFT JOIN counted USING (pdf_id) WHERE coalesce(n, 0) < 2),
hybrid AS (SELECT * FROM merged QUALIFY row_number() OVER (PARTITION BY pdf_id, lower(trim(title)), page_from ORDER BY parser, pos) = 1)"""
ROW = "serial, title, annexure, page_from, page_to, source"


def _flat(df: DataFrame, rows) -> DataFrame:
    return df.select("pdf_id", F.explode(rows).alias("r")).select(
        "pdf_id", F.col("r.serialNo").alias("serial"), "r.title", "r.annexure", F.col("r.pageFrom").alias("page_from"), F.col("r.pageTo").alias("page_to"), "r.source")


@query("line_stitch", f"WITH {STITCH_SQL} SELECT pdf_id, line FROM stitched")
def line_stitch(spark, d):
    return _toc(spark, d).select("pdf_id", F.explode(toc.stitched_lines(F.col("text"))).alias("line"))


@query("toc_rows_stitched", f"WITH {STITCHED_SQL} SELECT pdf_id, {ROW} FROM st")
def toc_rows_stitched(spark, d):
    return _flat(_toc(spark, d), toc.rows_stitched(F.col("text")))


@query("toc_rows_strict", f"WITH {STITCH_SQL}, {STRICT_SQL} SELECT pdf_id, {ROW} FROM sr")
def toc_rows_strict(spark, d):
    return _flat(_toc(spark, d), toc.rows_strict(F.col("text")))


@query("toc_rows_loose", f"WITH {STITCH_SQL}, {STRICT_SQL}, {LOOSE_SQL} SELECT pdf_id, {ROW} FROM lo")
def toc_rows_loose(spark, d):
    return _flat(_toc(spark, d), toc.rows_loose(F.col("text")))


@query("toc_rows_hybrid", f"WITH {HYBRID_SQL} SELECT pdf_id, {ROW} FROM hybrid")
def toc_rows_hybrid(spark, d):
    return _flat(_toc(spark, d), toc.rows_hybrid(F.col("text")))


# Every third document page is turned into a contents page by a header line.
SCORED = """
SELECT source AS pdf_id, CAST(doc_id + 1 AS INT) AS page_num,
  CASE doc_id % 3 WHEN 0 THEN 'INDEX' || chr(10) || 'Sr. No  Particulars of documents  Page No' || chr(10) || '1. Written reply of the party 12' || chr(10) ELSE '' END
    || CASE doc_id % 5 WHEN 0 THEN 'Index page' || chr(10) ELSE '' END || coalesce(text, '') AS text FROM {documents}"""


def _hints_sql(hints) -> str:
    return " + ".join(f"CAST(contains(lower(t), '{h}') AS INT)" for h in hints)


SEEDS = ", ".join(f"({k}, '{x}')" for k, x in enumerate(toc.SEED_TEXTS))
SCORE_SQL = rf"""
raw AS ({plain(SCORED)}),
cut AS (SELECT pdf_id, page_num, translate(substr(text, 1, 12000), '{T.DEVANAGARI_DIGITS}', '{T.ASCII_DIGITS}') AS t FROM raw),
seeds(seed, x) AS (VALUES {SEEDS}),
seed_v AS ({vectors_sql("seeds", "seed", "x")}), page_v AS ({vectors_sql("cut", "page_num", "t")}),
likeness AS (
  SELECT page_num, greatest(0, max(s)) AS emb FROM (SELECT page_num, seed, sum(page_v.value * seed_v.value) AS s FROM page_v JOIN seed_v USING (idx) GROUP BY page_num, seed) GROUP BY page_num),
parts AS (
  SELECT pdf_id, page_num, coalesce(emb, 0) AS emb,
    regexp_matches(regexp_replace(t, '(?i)\bindex\b\s*(page|no|number|finger)', '#', 'g'), '(?i)\bindex\b|\btable\s+of\s+contents\b') AS strong,
    regexp_matches(t, '(?i)(?:sr\.?\s*no\.?|particulars?\s+of\s+(?:the\s+)?documents?|(?:page|pg)\.?\s*no\.?(?:\s|$)|page\s+number|annexure|sheet\s+count)') AS struct,
    {_hints_sql(toc.HEADER_HINTS)} AS header_hits, {_hints_sql(toc.STRUCT_HINTS)} AS struct_hits,
    len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(trim(x), '^\s*[0-9]+[.)/]?\s+.{{5,200}}[0-9]+\s*$'))) AS row_hits
  FROM cut LEFT JOIN likeness USING (page_num)),
scored AS (
  SELECT *, CASE WHEN strong THEN 3.5 ELSE 0 END + CASE WHEN struct THEN 2.0 ELSE 0 END + least(header_hits, 4) * 1.5 + least(struct_hits, 6) * 0.7 + least(row_hits, 8) + emb * 4 AS score FROM parts),
cand AS (SELECT *, row_number() OVER (PARTITION BY pdf_id ORDER BY round(score, 6) DESC, page_num DESC) AS rank FROM scored QUALIFY rank <= 6)"""


def _scored(spark, d) -> DataFrame:
    return toc.with_page_score(base(spark, d, SCORED)).drop("text").withColumns({"emb": F.round("emb", 6), "score": F.round("score", 6)})


@query("toc_page_score", f"WITH {SCORE_SQL} SELECT pdf_id, page_num, strong, struct, header_hits, struct_hits, CAST(row_hits AS INT) AS row_hits, round(emb, 6) AS emb, round(score, 6) AS score FROM scored")
def toc_page_score(spark, d):
    return _scored(spark, d)


@query("toc_candidates", f"WITH {SCORE_SQL} SELECT pdf_id, page_num, CAST(rank AS INT) AS rank FROM cand")
def toc_candidates(spark, d):
    return toc.candidate_pages(_scored(spark, d)).select("pdf_id", "page_num", "rank")


@query("toc_expand", f"WITH {SCORE_SQL} SELECT DISTINCT pdf_id, page_num FROM raw WHERE EXISTS (FROM cand WHERE cand.pdf_id = raw.pdf_id AND raw.page_num - cand.page_num BETWEEN -1 AND 2)")
def toc_expand(spark, d):
    return toc.expand_candidates(toc.candidate_pages(_scored(spark, d)), base(spark, d, SCORED))


RAW = "SELECT pdf_id, seq, CASE part % 5 WHEN 0 THEN CAST(part % 40 AS STRING) || '-' || CAST(supp % 40 AS STRING) || '/' WHEN 1 THEN CAST(part % 40 AS STRING) WHEN 2 THEN CAST(part % 9 AS STRING) || ' to ' || CAST(part % 40 AS STRING) WHEN 3 THEN 'none' ELSE CAST(part % 40 AS STRING) || '–' || CAST(supp % 50 AS STRING) END AS raw FROM (" + ENTRIES + ")"


@query("page_range_parse", f"SELECT pdf_id, seq, {_pages_sql("replace(regexp_replace(raw, '/+$', ''), '–', '-')")} FROM ({plain(RAW)})")
def page_range_parse(spark, d):
    r = base(spark, d, RAW).select("pdf_id", "seq", T.page_range(F.col("raw"), 1).alias("r"))
    return r.select("pdf_id", "seq", F.col("r.pageFrom").alias("page_from"), F.col("r.pageTo").alias("page_to"))


@query("digit_translate", r"SELECT l_orderkey, l_linenumber, l_partkey, l_partkey AS back FROM lineitem")
def digit_translate(spark, d):
    """Numbers written in Devanagari digits and read back."""
    written = F.translate(F.col("l_partkey").cast("string"), T.ASCII_DIGITS, T.DEVANAGARI_DIGITS)
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", T.coerce_int(written, -1).cast("long").alias("back"))


ITEMS = "SELECT pdf_id, seq, CASE WHEN part % 17 = 0 THEN ' ' WHEN part % 2 = 0 THEN 'Part ' || CAST(part % 3 AS STRING) ELSE 'PART ' || CAST(part % 3 AS STRING) END AS title, CAST(part % 30 AS INT) AS pageFrom, CAST(supp % 30 AS INT) AS pageTo, CAST(pdf_id % 15 + 10 AS INT) AS total FROM (" + ENTRIES + ")"
FIRST_SQL = f"items AS ({plain(ITEMS)}), first AS (SELECT * FROM items WHERE trim(title) <> '' QUALIFY row_number() OVER (PARTITION BY pdf_id, lower(trim(title)), pageFrom ORDER BY seq) = 1)"


@query("first_wins_dedup", f"WITH {FIRST_SQL} SELECT pdf_id, seq, title, pageFrom FROM first")
def first_wins_dedup(spark, d):
    items = base(spark, d, ITEMS).where(T.strip(F.col("title")) != "")
    return ranges.first_wins(items, [F.col("pdf_id"), F.lower(T.strip(F.col("title"))), F.col("pageFrom")], [F.col("seq")]).select("pdf_id", "seq", "title", "pageFrom")


RANGE_SQL = f"""
clamped AS (SELECT pdf_id, seq, trim(title) AS title, total, greatest(1, least(pageFrom, total)) AS pf, pageTo FROM ({plain(ITEMS)}) WHERE trim(title) <> ''),
firsts AS (
  SELECT *, greatest(pf, least(pageTo, total)) AS pt FROM clamped QUALIFY row_number() OVER (PARTITION BY pdf_id, lower(title), pf ORDER BY seq) = 1),
led AS (SELECT *, lead(pf) OVER (PARTITION BY pdf_id ORDER BY pf, title, seq) AS nxt FROM firsts),
built AS (SELECT pdf_id, seq, title, total, pf AS page_from, CASE WHEN nxt > pf THEN least(greatest(pf, nxt - 1), total) ELSE pt END AS page_to FROM led)"""


def _built(spark, d) -> DataFrame:
    return ranges.build_ranges(base(spark, d, ITEMS), 1, F.col("total"))


@query("range_build", f"WITH {RANGE_SQL} SELECT pdf_id, seq, title, page_from, page_to FROM built")
def range_build(spark, d):
    return _built(spark, d).select("pdf_id", "seq", "title", F.col("pageFrom").alias("page_from"), F.col("pageTo").alias("page_to"))


@query("range_coverage", f"""
WITH items AS ({plain(ITEMS)}), spread AS (SELECT pdf_id, seq, unnest(generate_series(pageFrom, least(pageTo, total))) AS page FROM items WHERE pageFrom <= least(pageTo, total)),
owner AS (SELECT pdf_id, page, max(seq) AS section FROM spread GROUP BY pdf_id, page)
SELECT pdf_id, count(*) AS covered, CAST(sum(section) AS BIGINT) AS sections FROM owner GROUP BY pdf_id""")
def range_coverage(spark, d):
    items = base(spark, d, ITEMS).withColumnRenamed("seq", "section")
    spans = ranges.coverage_spans(items, F.col("total"))
    pages = F.col("pageTo") - F.col("pageFrom") + 1
    return spans.groupBy("pdf_id").agg(F.sum(pages).cast("long").alias("covered"), F.sum(pages * F.col("section")).cast("long").alias("sections"))


SEGMENTS = "SELECT DISTINCT source AS pdf_id, CAST(doc_id % 7 AS INT) AS item, CAST(doc_id % 7 * 100 + 1 AS INT) AS pageFrom, CAST(doc_id % 7 * 100 + 160 AS INT) AS pageTo FROM {documents}"
def _previews_sql(role: str) -> str:
    """CTEs segs, met and previews for a role (pdf_id, item, pageFrom, pageTo)."""
    return f"""
segs AS ({plain(role)}), pages AS ({plain(PAGES)}),
cutp AS (SELECT pdf_id, page_num, substr(trim(text, ' ' || chr(10)), 1, 500) AS snip FROM pages WHERE trim(text, ' ' || chr(10)) <> ''),
met AS (
  SELECT segs.pdf_id, item, page_num, snip, coalesce(sum(length(snip)) OVER (PARTITION BY segs.pdf_id, item ORDER BY page_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM segs JOIN cutp ON segs.pdf_id = cutp.pdf_id AND page_num BETWEEN pageFrom AND pageTo),
previews AS (SELECT pdf_id, item, string_agg('[p' || page_num || '] ' || snip, chr(10) ORDER BY page_num) AS preview FROM met WHERE before < 1200 GROUP BY pdf_id, item)"""


PREVIEW_SQL = _previews_sql(SEGMENTS)


@query("segment_preview", f"WITH {PREVIEW_SQL} SELECT pdf_id, item, length(preview) AS chars, md5(preview) AS digest FROM previews")
def segment_preview(spark, d):
    p = ranges.segment_preview(base(spark, d, SEGMENTS), base(spark, d, PAGES))
    return p.select("pdf_id", "item", F.length("preview").cast("long").alias("chars"), F.md5(F.col("preview").cast("binary")).alias("digest"))


ISLES = "SELECT pdf_id, seq AS ord, CASE WHEN part % 3 = 0 THEN 'T' ELSE 'U' END AS title, 'Reply' AS documentType, seq * 3 - 2 AS pageFrom, CASE WHEN supp % 4 = 0 THEN seq * 3 - 1 ELSE seq * 3 END AS pageTo FROM (" + ENTRIES + ")"


@query("merge_adjacent", f"""
WITH isles AS ({plain(ISLES)}),
flagged AS (SELECT *, CASE WHEN pageFrom = coalesce(lag(pageTo) OVER w, 0) + 1 AND title = lag(title) OVER w AND documentType = lag(documentType) OVER w THEN 0 ELSE 1 END AS s FROM isles WINDOW w AS (PARTITION BY pdf_id ORDER BY ord)),
grouped AS (SELECT *, sum(s) OVER (PARTITION BY pdf_id ORDER BY ord) AS g FROM flagged)
SELECT pdf_id, min(ord) AS ord, arg_min(title, ord) AS title, min(pageFrom) AS page_from, arg_max(pageTo, ord) AS page_to FROM grouped GROUP BY pdf_id, g""")
def merge_adjacent(spark, d):
    m = ranges.merge_adjacent(base(spark, d, ISLES))
    return m.select("pdf_id", "ord", "title", F.col("pageFrom").alias("page_from"), F.col("pageTo").alias("page_to"))


CATALOG = "SELECT p_name AS name, CAST(p_partkey AS INT) AS ord FROM {part} UNION ALL SELECT r_name, CAST(100000000 + r_regionkey AS INT) FROM {region}"


@query("catalog_distinct", f"SELECT trim(name) AS name, min(ord) AS ord FROM ({plain(CATALOG)}) WHERE trim(name) <> '' GROUP BY ALL")
def catalog_distinct(spark, d):
    return classify.catalog_names(base(spark, d, CATALOG))


TITLES = "SELECT source AS pdf_id, CAST(doc_id AS INT) AS item, CASE doc_id % 7 WHEN 0 THEN 'Written Statement of party' WHEN 1 THEN 'Reply & Affidavit' WHEN 2 THEN 'Notice of appeal' WHEN 3 THEN 'e-Court Fee/Stamp Paper' WHEN 4 THEN 'Certificate of index' WHEN 5 THEN 'some other hot ring' ELSE 'small widget of nation_7' END AS title, CAST(doc_id + 1 AS INT) AS pageFrom, CAST(doc_id + 1 + doc_id % 50 AS INT) AS pageTo FROM {documents}"
LISTED = ["Process Fee", "Vakalat Nama", "Reply", "Written Statement", "Affidavit", "Notices", "Index", "e-Court Fee/Stamp Paper", "Other"]


TITLED_SQL = _previews_sql(TITLES) + ", titled AS (SELECT item AS id, title, coalesce(preview, '') AS preview FROM segs LEFT JOIN previews USING (pdf_id, item))"


def _titled(spark, d) -> DataFrame:
    """(id, title, preview): a titled segment per document, with the preview of its pages."""
    items = base(spark, d, TITLES)
    met = items.join(ranges.segment_preview(items, base(spark, d, PAGES)), ["pdf_id", "item"], "left")
    return met.select(F.col("item").alias("id"), "title", F.coalesce("preview", F.lit("")).alias("preview"))


def _alias_sql() -> str:
    both = "lower(title || chr(10) || preview)"
    cases = " ".join(
        f"WHEN regexp_matches({both}, '{p}') THEN '{t}'" for p, t in classify.ALIASES if t in LISTED)
    return f"CASE {cases} END"


@query("alias_classify", f"WITH {TITLED_SQL} SELECT id, {_alias_sql()} AS alias FROM titled")
def alias_classify(spark, d):
    return _titled(spark, d).select("id", classify.alias(F.concat_ws("\n", "title", "preview"), LISTED).alias("alias"))


def _norm_sql(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(replace(lower(trim({x}, ' ' || chr(10))), '&', ' and '), '[/,()-]+', ' ', 'g'), '\s+', ' ', 'g'))"


NAMED = "SELECT name, CAST(min(ord) AS INT) AS ord FROM (SELECT n_name AS name, n_nationkey AS ord FROM {nation} UNION ALL SELECT 'Other', 99 UNION ALL SELECT p_name, 100 + p_partkey FROM {part}) AS c GROUP BY name"


@query("catalog_contains", f"WITH {TITLED_SQL} SELECT id, arg_min(name, ord) AS contained FROM titled JOIN ({plain(NAMED)}) ON contains({_norm_sql('title || chr(10) || preview')}, {_norm_sql('name')}) GROUP BY id")
def catalog_contains(spark, d):
    held = _titled(spark, d).select("id", names.first_contained(base(spark, d, NAMED), F.concat_ws("\n", "title", "preview")).alias("contained"))
    return held.where("contained IS NOT NULL")


SCORES_SQL = f"""{TITLED_SQL},
asked AS (SELECT *, {tokens_sql("title || chr(10) || preview")} AS st FROM titled),
names AS (SELECT *, {tokens_sql("name")} AS qt FROM ({plain(NAMED)})),
sv AS ({vectors_sql("(SELECT id, title || chr(10) || preview AS x FROM asked)", "id", "x")}),
nv AS ({vectors_sql("names", "name", "name")}),
sem AS (SELECT id, name, sum(sv.value * nv.value) AS sem FROM sv JOIN nv USING (idx) GROUP BY id, name),
lexed AS (
  SELECT id, title, preview, name, lower(name) IN ('other', 'others') AS generic, len(list_filter(qt, lambda t: list_contains(st, t))) AS hits, len(list_distinct(qt)) AS nq,
    contains(lower(title || chr(10) || preview), lower(name)) AS phrase FROM asked CROSS JOIN names),
scores AS (
  SELECT id, name, generic, coalesce(sem, 0) * 2.8 + (hits + hits / nq + CASE WHEN phrase THEN 2.5 ELSE 0 END) * 1.8
    + CASE WHEN contains({_norm_sql("title")}, {_norm_sql("name")}) THEN 4 ELSE 0 END + CASE WHEN contains({_norm_sql("preview")}, {_norm_sql("name")}) THEN 1.5 ELSE 0 END
    - CASE WHEN generic THEN 3 ELSE 0 END + CASE WHEN contains(lower(title), lower(name)) AND NOT generic THEN 2 ELSE 0 END AS score
  FROM lexed LEFT JOIN sem USING (id, name)),
best AS (SELECT id, name, score FROM scores QUALIFY row_number() OVER (PARTITION BY id ORDER BY generic, round(score, 9) DESC, name DESC) = 1)"""


@query("catalog_score", f"WITH {SCORES_SQL} SELECT id, name, round(score, 6) AS score FROM scores")
def catalog_score(spark, d):
    """Every segment against the whole catalog."""
    return classify.name_scores(_titled(spark, d), base(spark, d, NAMED), ["id"]).select("id", "name", F.round("score", 6).alias("score"))


@query("classify_items", f"""WITH {SCORES_SQL},
held AS (SELECT id, arg_min(name, ord) AS contained FROM asked JOIN names ON contains({_norm_sql("title || chr(10) || preview")}, {_norm_sql("name")}) GROUP BY id)
SELECT id, coalesce({_alias_sql()}, contained, best.name, 'Other') AS document_type FROM asked LEFT JOIN held USING (id) LEFT JOIN best USING (id)""")
def classify_items(spark, d):
    return classify.classify(_titled(spark, d), base(spark, d, NAMED), ["id"], LISTED).select("id", F.col("documentType").alias("document_type"))


PARENTS = "SELECT CAST(n_nationkey AS INT) AS ord, n_name AS name FROM {nation}"
CHILDREN = "SELECT CAST(p_partkey AS INT) AS ord, 'NATION_' || CAST(p_partkey % 25 AS STRING) AS parent, 'Sub ' || CAST(CASE WHEN p_partkey % 3 = 0 THEN p_partkey ELSE p_partkey % 90 END AS STRING) AS name FROM {part}"
LOOKUPS = "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'nation-' || CAST(o_custkey % 40 AS STRING) WHEN 1 THEN 'Nation_' || CAST(o_custkey % 25 AS STRING) || ' sub ' || CAST(o_custkey % 90 AS STRING) WHEN 2 THEN 'SUB ' || CAST(o_custkey % 130 AS STRING) ELSE '--' END AS title, CASE WHEN o_orderkey % 5 = 0 THEN 'given' ELSE '' END AS subDocument FROM {orders}"


@query("nested_catalog_lookup", f"""
WITH parents AS ({plain(PARENTS)}), children AS ({plain(CHILDREN)}), keyed AS (SELECT *, nullif(regexp_replace(lower(title), '[^a-z0-9]+', '', 'g'), '') AS k FROM ({plain(LOOKUPS)})),
pk AS (SELECT regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') AS k, arg_max(name, ord) AS p FROM parents GROUP BY 1),
ck AS (SELECT regexp_replace(lower(parent || name), '[^a-z0-9]+', '', 'g') AS k, arg_max(parent, ord) AS ct, arg_max(name, ord) AS cs FROM children GROUP BY 1),
uk AS (SELECT regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') AS k, min(parent) AS st, min(name) AS ss FROM children GROUP BY 1 HAVING count(*) = 1)
SELECT id, CASE WHEN p IS NOT NULL THEN p WHEN subDocument = '' AND ct IS NOT NULL THEN ct WHEN subDocument = '' AND st IS NOT NULL THEN st ELSE title END AS title,
  CASE WHEN p IS NOT NULL THEN nullif(subDocument, '') WHEN subDocument = '' AND ct IS NOT NULL THEN cs WHEN subDocument = '' AND st IS NOT NULL THEN ss ELSE subDocument END AS "subDocument",
  CASE WHEN p IS NOT NULL THEN 'parent' WHEN subDocument = '' AND ct IS NOT NULL THEN 'combined' WHEN subDocument = '' AND st IS NOT NULL THEN 'child' ELSE 'none' END AS how
FROM keyed LEFT JOIN pk USING (k) LEFT JOIN ck USING (k) LEFT JOIN uk USING (k)""")
def nested_catalog_lookup(spark, d):
    return classify.nested_lookup(base(spark, d, LOOKUPS), base(spark, d, PARENTS), base(spark, d, CHILDREN))


@query("label_normalize", rf"""
SELECT page_id, {_norm_sql("url")} AS label, regexp_replace(lower(url), '[^a-z0-9]+', '', 'g') AS label_key FROM pages""")
def label_normalize(spark, d):
    return read(spark, d, "pages").select("page_id", T.normalize_label(F.col("url")).alias("label"), T.label_key(F.col("url")).alias("label_key"))


#: Pages of the synthetic documents: each speaks of one part.
SPOKEN = f"""
SELECT pdf_id, CAST((part + supp) % 25 + 1 AS INT) AS page_num, 'Here the ' || min(p_name) || ' is set out, with ' || CAST(count(*) AS STRING) || ' more' AS text
FROM ({ENTRIES}) AS e JOIN {{part}} ON part = p_partkey WHERE pdf_id % 10 <> 0 GROUP BY pdf_id, CAST((part + supp) % 25 + 1 AS INT)"""
SAID = "title || chr(10) || preview"


def _index_sql(toc_sql: str, sizes: str, spoken: str) -> str:
    """CTEs from toc to isle, whose rows of one g are an entry; sizes: (pdf_id, total); spoken: (pdf_id, page_num, text)."""
    return f"""{HYBRID_SQL.replace(TOC_SQL, toc_sql)},
sizes AS ({sizes}),
clamped AS (SELECT pdf_id, parser, pos, title, total, greatest(1, least(page_from, total)) AS pf, page_to FROM hybrid JOIN sizes USING (pdf_id)),
usable AS (SELECT * FROM clamped WHERE pdf_id IN (SELECT pdf_id FROM clamped GROUP BY pdf_id HAVING count(*) >= 2)),
firsts AS (SELECT *, greatest(pf, least(page_to, total)) AS pt FROM usable QUALIFY row_number() OVER (PARTITION BY pdf_id, lower(title), pf ORDER BY parser, pos) = 1),
led AS (SELECT *, lead(pf) OVER w AS nxt, row_number() OVER w AS ord FROM firsts WINDOW w AS (PARTITION BY pdf_id ORDER BY pf, title, parser, pos)),
built AS (SELECT pdf_id, ord, title, pf, nxt, CASE WHEN nxt > pf THEN least(greatest(pf, nxt - 1), total) ELSE pt END AS pt, {{'d': pdf_id, 'o': ord}} AS k FROM led),
spoken AS (SELECT *, {{'d': pdf_id, 'p': page_num}} AS k, {tokens_sql("text")} AS tt FROM ({spoken})),
entry_v AS ({vectors_sql("built", "k", "title")}), spoken_v AS ({vectors_sql("spoken", "k", "text")}),
sem_e AS (
  SELECT a.k.d AS pdf_id, a.k.o AS ord, b.k.p AS page_num, sum(a.value * b.value) AS sem FROM entry_v AS a JOIN spoken_v AS b ON a.idx = b.idx AND a.k.d = b.k.d GROUP BY ALL),
paired AS (
  SELECT built.pdf_id, ord, pf, page_num, len(list_filter({tokens_sql("title")}, lambda t: list_contains(tt, t))) AS hits, len(list_distinct({tokens_sql("title")})) AS nq,
    contains(lower(text), lower(title)) AS phrase FROM built JOIN spoken ON built.pdf_id = spoken.pdf_id),
hit AS (
  SELECT *, row_number() OVER (PARTITION BY pdf_id, ord ORDER BY score DESC, page_num DESC) AS rank FROM (
    SELECT paired.*, round(2 * coalesce(sem, 0) + 1.5 * CASE WHEN nq = 0 THEN 0 ELSE hits + hits / nq + CASE WHEN phrase THEN 2.5 ELSE 0 END END, 9) AS score
    FROM paired LEFT JOIN sem_e USING (pdf_id, ord, page_num)) QUALIFY rank <= 8 AND score > 0.35),
near AS (SELECT pdf_id, ord, arg_min(page_num, abs(page_num - pf) * 100 + rank) AS found FROM hit GROUP BY pdf_id, ord),
started AS (
  SELECT built.*, found, CASE WHEN abs(found - pf) <= 2 THEN found ELSE pf END AS vf, pdf_id IN (SELECT pdf_id FROM spoken) AS known FROM built LEFT JOIN near USING (pdf_id, ord)),
checked AS (
  SELECT pdf_id, ord AS item, title, pf, pt, known, vf, CASE WHEN vf < nxt THEN greatest(vf, nxt - 1) ELSE greatest(vf, pt) END AS vt,
    CASE WHEN NOT known THEN 'none' WHEN found IS NULL THEN 'toc_only' WHEN abs(found - pf) <= 2 THEN 'verified' ELSE 'weak_match' END AS verification FROM started),
met AS (
  SELECT checked.pdf_id, item, page_num, substr(text, 1, 500) AS snip, coalesce(sum(length(substr(text, 1, 500))) OVER (PARTITION BY checked.pdf_id, item ORDER BY page_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM checked JOIN spoken ON checked.pdf_id = spoken.pdf_id AND page_num BETWEEN vf AND vt),
previews AS (SELECT pdf_id, item, string_agg('[p' || page_num || '] ' || snip, chr(10) ORDER BY page_num) AS preview FROM met WHERE before < 1200 GROUP BY pdf_id, item),
seen AS (SELECT checked.*, coalesce(preview, '') AS preview, {{'d': pdf_id, 'o': item}} AS id FROM checked LEFT JOIN previews USING (pdf_id, item)),
names AS (SELECT * FROM ({plain(NAMED)})),
held AS (SELECT id, arg_min(name, ord) AS contained FROM seen JOIN names ON contains({_norm_sql(SAID)}, {_norm_sql('name')}) GROUP BY id),
rest AS (SELECT *, {tokens_sql(SAID)} AS st FROM seen WHERE id NOT IN (SELECT id FROM held)),
rest_v AS ({vectors_sql(f"(SELECT id, {SAID} AS x FROM rest)", "id", "x")}), name_v AS ({vectors_sql("names", "name", "name")}),
sem_n AS (SELECT id, name, sum(rest_v.value * name_v.value) AS sem FROM rest_v JOIN name_v USING (idx) GROUP BY id, name),
best AS (
  SELECT id, name FROM (
    SELECT id, name, lower(name) IN ('other', 'others') AS generic, coalesce(sem, 0) * 2.8 + 1.8 * (hits + hits / nq) - CASE WHEN lower(name) IN ('other', 'others') THEN 3 ELSE 0 END AS score
    FROM (SELECT id, name, len(list_filter({tokens_sql("name")}, lambda t: list_contains(st, t))) AS hits, len(list_distinct({tokens_sql("name")})) AS nq FROM rest CROSS JOIN names) LEFT JOIN sem_n USING (id, name))
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY generic, round(score, 9) DESC, name DESC) = 1),
typed AS (SELECT seen.*, coalesce(contained, best.name, 'Other') AS kind FROM seen LEFT JOIN held ON seen.id = held.id LEFT JOIN best ON seen.id = best.id),
flagged AS (
  SELECT *, CASE WHEN pf = coalesce(lag(pt) OVER w, 0) + 1 AND title = lag(title) OVER w AND kind = lag(kind) OVER w THEN 0 ELSE 1 END AS s FROM typed WINDOW w AS (PARTITION BY pdf_id ORDER BY item)),
isle AS (SELECT *, sum(s) OVER (PARTITION BY pdf_id ORDER BY item) AS g FROM flagged)"""


INDEX_ENTRY = """
SELECT pdf_id, CAST(min(item) AS BIGINT) AS place, arg_min(title, item) AS title, min(pf) AS page_from, arg_max(pt, item) AS page_to,
  CASE WHEN any_value(known) THEN CAST(arg_min(vf, item) AS INT) ELSE -1 END AS found_from, CASE WHEN any_value(known) THEN CAST(arg_max(vt, item) AS INT) WHEN count(*) > 1 THEN CAST(arg_max(pt, item) AS INT) ELSE -1 END AS found_to,
  arg_min(verification, item) AS verification, arg_min(kind, item) AS document_type"""
INDEX_SQL = f"""
WITH {_index_sql(TOC_SQL, "SELECT pdf_id, 25 AS total FROM toc", plain(SPOKEN))} {INDEX_ENTRY}, 'index_ready' AS status FROM isle GROUP BY pdf_id, g
UNION ALL SELECT pdf_id, -1, '', -1, -1, -1, -1, 'none', '', 'no_toc' FROM toc WHERE pdf_id NOT IN (SELECT pdf_id FROM usable)"""


@query("index_pipeline", INDEX_SQL)
def index_pipeline(spark, d):
    """Parsing, ranges, verification, classification and merging, for all documents; every tenth has no stored pages."""
    from quire.plans import index

    out = index.build_index(_toc(spark, d).withColumn("total_pages", F.lit(25)), base(spark, d, SPOKEN), base(spark, d, NAMED), [])
    number = lambda c: F.coalesce(F.col(c), F.lit(-1))
    return out.select(
        "pdf_id", F.coalesce("seq", F.lit(-1)).cast("long").alias("place"), F.coalesce("title", F.lit("")).alias("title"), number("pageFrom").alias("page_from"), number("pageTo").alias("page_to"),
        number("verifiedPageFrom").alias("found_from"), number("verifiedPageTo").alias("found_to"), F.coalesce("verificationStatus", F.lit("none")).alias("verification"),
        F.coalesce("documentType", F.lit("")).alias("document_type"), "status")


# A store for index generation: every thirteenth document has no record, every tenth no pages; the others have a contents page before the pages that speak.
FILED = f"SELECT pdf_id, filename, total_pages, status, index_ready, index_source, updated_at, updated_at AS created_at FROM ({RECORDS}) AS r WHERE pdf_id % 13 <> 0"
HEADER = "INDEX\nSr. No  Particulars of documents  Page No"
BOUND = f"SELECT pdf_id, seq, line FROM ({TOC_LINES}) AS lines WHERE pdf_id % 10 <> 0"
BOUND_SQL = f"toc AS (SELECT pdf_id, '{HEADER}' || chr(10) || string_agg(line, chr(10) ORDER BY seq) AS text FROM ({plain(BOUND)}) GROUP BY pdf_id)"
LATER = f"SELECT pdf_id, page_num + 1 AS page_num, text FROM ({SPOKEN}) AS spoken"
GENERATED_SQL = f"""
WITH filed AS ({plain(FILED)}), {_index_sql(BOUND_SQL, "SELECT pdf_id, total_pages AS total FROM filed", f"SELECT pdf_id, 1 AS page_num, text FROM toc UNION ALL {plain(LATER)}")},
indexed AS ({INDEX_ENTRY} FROM isle GROUP BY pdf_id, g),
everyone AS (SELECT pdf_id FROM filed UNION SELECT pdf_id FROM toc)
SELECT indexed.* REPLACE (row_number() OVER (PARTITION BY pdf_id ORDER BY place) AS place), CAST(count(*) OVER (PARTITION BY pdf_id) AS INT) AS total_entries, 'toc-hybrid' AS index_source, filename, 'index_ready' AS status FROM indexed JOIN filed USING (pdf_id)
UNION ALL SELECT pdf_id, -1, '', -1, -1, -1, -1, 'none', '', 0, coalesce(index_source, ''), coalesce(filename, ''),
  CASE WHEN filename IS NULL THEN 'no record' WHEN pdf_id NOT IN (SELECT pdf_id FROM toc) THEN 'no pages' ELSE 'no_toc' END
FROM everyone LEFT JOIN filed USING (pdf_id) WHERE pdf_id NOT IN (SELECT pdf_id FROM indexed)"""
SAVED = "array<struct<title:string,pageFrom:int,pageTo:int,verifiedPageFrom:int,verifiedPageTo:int,verificationStatus:string,documentType:string>>"


@query("generate_index", GENERATED_SQL)
def generate_index(spark, d):
    """From stored pages and records to indexes and records that are saved as one version and read back, and what could not be indexed."""
    from quire.plans import generate
    from quire.sources.versions import Tables
    from quire.sources.work import new_folder

    listed = F.array_sort(F.collect_list(F.struct("seq", "line")))
    lines = F.array_join(F.transform(listed, lambda s: s.line), "\n")
    contents = base(spark, d, BOUND).groupBy("pdf_id").agg(F.concat(F.lit(HEADER + "\n"), lines).alias("text")).withColumn("page_num", F.lit(1))
    pages, records = contents.unionByName(base(spark, d, LATER)), base(spark, d, FILED)
    out = generate.generate(pages, records, F.current_timestamp(), base(spark, d, NAMED), [])
    tables = Tables(spark, new_folder(spark), buckets=8)
    tables.commit({"records": records})
    generate.save(tables, out)
    entry = tables.read("indexes").select("pdf_id", "total_entries", F.posexplode(F.from_json("index", SAVED)).alias("at", "e"))
    filed = tables.read("records")
    number = lambda c: F.coalesce(F.col(c), F.lit(-1))
    found = entry.join(filed, "pdf_id").select(
        "pdf_id", (F.col("at") + 1).cast("long").alias("place"), "e.title", number("e.pageFrom").alias("page_from"), number("e.pageTo").alias("page_to"),
        number("e.verifiedPageFrom").alias("found_from"), number("e.verifiedPageTo").alias("found_to"), F.coalesce("e.verificationStatus", F.lit("none")).alias("verification"),
        F.col("e.documentType").alias("document_type"), "total_entries", "index_source", "filename", "status")
    none = {"place": F.lit(-1).cast("long"), "title": F.lit(""), "verification": F.lit("none"), "document_type": F.lit(""), "total_entries": F.lit(0)} | {
        c: F.lit(-1) for c in ("page_from", "page_to", "found_from", "found_to")}
    failed = out.failed.join(filed.select("pdf_id", "index_source", "filename"), "pdf_id", "left").withColumns(none).withColumns(
        {"status": F.col("reason")} | {c: F.coalesce(c, F.lit("")) for c in ("index_source", "filename")})
    return found.unionByName(failed.select(*found.columns))
