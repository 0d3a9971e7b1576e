"""Registered queries over derived papers, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import boolean, paper, text
from paperloom.operators import filters, graph, identity, layout, lookup, report, screening, search
from paperloom.operators.components import scratch
from paperloom.operators.entity_index import EntityIndex
from paperloom.operators.text_index import TextIndex
from paperloom.plans.catalogue_terms import term_sql as _term_sql
from paperloom.plans.registry import QUERIES, SQL, query
from paperloom.plans.registry import with_views as _with
from paperloom.plans.schema import conform
from paperloom.plans.views import CORPUS_SQL, EDGES_SQL, PAPERS_SQL, SQUEEZE, documents_as_papers, frontier, order_corpus, order_edges, part_frontier, table
from paperloom.sources import sheets
from paperloom.streaming import results as streams

__all__ = ["QUERIES", "SQL", "merged_papers"]

YEAR_NOW = 2026
FILTERS = {
    "year_min": 2004, "year_max": 2024, "languages": ["en", "de", "fr"], "min_citations": 20, "citation_grace_years": 4, "exclude_types": ["editorial", "letter"],
    "venue_exclude": ["src7"], "exclude_any": ["scum", "worthless"], "require_any": ["the", "der", "qu*"], "min_hits": 2,
}
BOOLEAN = '("of the" OR anded OR eren*) AND (the* OR from) NOT scum'
TAXONOMY = {"taxonomy": [{"name": "area 2", "children": ["topic 4", "topic 0"]}, "area 0"]}


_BODY = "body AS (SELECT *, title || ' ' || abstract AS body FROM papers)"
_KINDS = "list_transform(found_via, lambda v: CASE WHEN split_part(v, ':', 1) = 'search' THEN split_part(v, ':', 2) ELSE split_part(v, ':', 1) END)"
_HITS = "len(list_distinct(list_transform(list_filter(found_via, lambda v: v LIKE 'backward:%' OR v LIKE 'forward:%'), lambda v: substr(v, strpos(v, ':') + 1))))"
_REASON = f"""CASE WHEN list_has_any(found_via, ['seed:known', 'manual']) THEN NULL
  WHEN year < 2004 THEN 'published before 2004' WHEN year > 2024 THEN 'published after 2024'
  WHEN language NOT IN ('en', 'de', 'fr') THEN 'language: ' || language
  WHEN contains(lower(type), 'editorial') OR contains(lower(type), 'letter') THEN 'publication type: ' || type
  WHEN citation_count < 20 AND NOT (2026 - year < 4) THEN 'fewer than 20 citations'
  WHEN contains(lower(venue), 'src7') THEN 'venue: ' || venue
  WHEN {_term_sql("scum")} THEN 'mentions ''scum''' WHEN {_term_sql("worthless")} THEN 'mentions ''worthless'''
  WHEN NOT ({_term_sql("the")} OR {_term_sql("der")} OR {_term_sql("qu*")}) THEN 'none of the required keywords'
  WHEN round > 0 AND {_HITS} < 2 THEN 'linked from fewer than 2 papers' END"""
_FILTERED = f"filtered AS (SELECT *, {_REASON} AS excluded_reason FROM body)"
_NAME = r"trim(regexp_replace(strip_accents(lower(title)), '[^\p{L}\p{N}]+', ' ', 'g'))"
_ID = f"coalesce('doi:' || doi, 'arxiv:' || lower(arxiv_id), 's2:' || s2_id, 'title:' || substr(sha1(coalesce(nullif({_NAME}, ''), trim(lower(title)))), 1, 12))"


def _filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.apply_filters(documents_as_papers(spark, sf_dir), FILTERS, YEAR_NOW)


# ------------------------------------------------------------------ filters


@query("filter_reasons", _with(PAPERS_SQL, _BODY, _FILTERED, then="SELECT CASE WHEN regexp_matches(excluded_reason, '^(language|publication type|venue):') THEN split_part(excluded_reason, ':', 1) ELSE excluded_reason END AS reason, count(*) AS n FROM filtered WHERE excluded_reason IS NOT NULL GROUP BY 1"))
def filter_reasons(spark, sf_dir):
    return filters.reason_counts(_filtered(spark, sf_dir))


@query("filter_papers", _with(PAPERS_SQL, _BODY, _FILTERED, then="SELECT seq, excluded_reason FROM filtered"))
def filter_papers(spark, sf_dir):
    return _filtered(spark, sf_dir).select("seq", "excluded_reason")


@query("filter_protected", _with(PAPERS_SQL, then="SELECT seq FROM papers WHERE list_has_any(found_via, ['seed:known', 'manual'])"))
def filter_protected(spark, sf_dir):
    return documents_as_papers(spark, sf_dir).where(F.arrays_overlap("found_via", F.array(*(F.lit(p) for p in filters.PROTECTED)))).select("seq")


@query("filter_abstract", _with(PAPERS_SQL, then="SELECT count(*) AS n FROM papers WHERE abstract = '' AND NOT list_has_any(found_via, ['seed:known', 'manual'])"))
def filter_abstract(spark, sf_dir):
    return filters.apply_filters(documents_as_papers(spark, sf_dir), {"require_abstract": True}, YEAR_NOW).where("excluded_reason = 'no abstract'").agg(F.count("*").alias("n"))


@query("hits_min", _with(PAPERS_SQL, then=f"SELECT seq, {_HITS} AS hits FROM papers WHERE round > 0 AND {_HITS} >= 2"))
def hits_min(spark, sf_dir):
    return documents_as_papers(spark, sf_dir).where((F.col("round") > 0) & (paper.hits() >= 2)).select("seq", paper.hits().cast("long").alias("hits"))


@query("keyword_plural", _with(PAPERS_SQL, _BODY, then=f"SELECT seq FROM body WHERE {_term_sql('clown')}"))
def keyword_plural(spark, sf_dir):
    return documents_as_papers(spark, sf_dir).where(boolean.mentions(F.concat("title", F.lit(" "), "abstract"), "clown")).select("seq")


@query("keyword_prefix", _with(PAPERS_SQL, _BODY, then=f"SELECT seq FROM body WHERE {_term_sql('disgust*')}"))
def keyword_prefix(spark, sf_dir):
    return documents_as_papers(spark, sf_dir).where(boolean.mentions(F.concat("title", F.lit(" "), "abstract"), "disgust*")).select("seq")


@query("where_show", _with(PAPERS_SQL, then=f"SELECT seq, title FROM papers WHERE status IN ('core', 'skim') AND list_contains({_KINDS}, 'openalex') AND language IS NULL"))
def where_show(spark, sf_dir):
    return filters.where(documents_as_papers(spark, sf_dir), ["included=yes", "found=openalex", "language=none"]).select("seq", "title")


@query("sort_nulls_last", _with(PAPERS_SQL, then="SELECT row_number() OVER (ORDER BY citation_count DESC NULLS LAST, seq) AS row_no, seq, citation_count FROM papers"))
def sort_nulls_last(spark, sf_dir):
    rows = documents_as_papers(spark, sf_dir).select("seq", "citation_count")
    return layout.numbered(rows, [F.desc_nulls_last("citation_count"), F.col("seq")])


# ------------------------------------------------------------------ derived columns and scalar functions


@query("paper_id", _with(PAPERS_SQL, then=f"SELECT seq, {_ID} AS id FROM papers"))
def paper_id(spark, sf_dir):
    return documents_as_papers(spark, sf_dir).select("seq", paper.paper_id().alias("id"))


@query("paper_link", _with(PAPERS_SQL, then="SELECT seq, coalesce('https://doi.org/' || doi, 'https://arxiv.org/abs/' || arxiv_id, 'https://www.semanticscholar.org/paper/' || s2_id) AS link FROM papers"))
def paper_link(spark, sf_dir):
    return documents_as_papers(spark, sf_dir).select("seq", paper.link().alias("link"))


@query("dedup_keys", _with(PAPERS_SQL, then="SELECT key, count(*) AS n FROM (SELECT unnest(list_filter(['doi:' || doi, 'arxiv:' || lower(arxiv_id), 's2:' || s2_id], lambda x: x IS NOT NULL)) AS key FROM papers) GROUP BY key"))
def dedup_keys(spark, sf_dir):
    return documents_as_papers(spark, sf_dir).select(F.explode(paper.identifier_keys()).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


@query("found_kinds", _with(PAPERS_SQL, then=f"SELECT seq, array_to_string(list_filter({_KINDS}, lambda k, i: list_position({_KINDS}, k) = i), ',') AS kinds FROM papers"))
def found_kinds(spark, sf_dir):
    return documents_as_papers(spark, sf_dir).select("seq", F.array_join(paper.found_kinds(), ",").alias("kinds"))


@query("norm_title", _with(PAPERS_SQL, then=f"SELECT seq, {_NAME} AS name FROM papers"))
def norm_title(spark, sf_dir):
    return documents_as_papers(spark, sf_dir).select("seq", text.norm_title(F.col("title")).alias("name"))


_DOIS = "CASE doc_id % 4 WHEN 0 THEN 'https://doi.org/10.1145/ABC.' || doc_id WHEN 1 THEN ' doi: 10.1/X' || doc_id WHEN 2 THEN 'not a doi ' || doc_id ELSE '10.48550/arXiv.2401.0' || (1000 + doc_id % 9000) END"


@query("norm_doi", f"SELECT doc_id, CASE WHEN starts_with(d, '10.') THEN d END AS doi FROM (SELECT doc_id, lower(trim(regexp_replace({_DOIS}, '(?i)^\\s*((https?://)?(dx\\.)?doi\\.org/|doi:\\s*)', ''))) AS d FROM documents)")
def norm_doi(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.norm_doi(F.expr(_DOIS)).alias("doi"))


_ARXIVS = "CASE doc_id % 6 WHEN 0 THEN 'arXiv:2401.0' || (1000 + doc_id % 9000) || 'v3' WHEN 1 THEN 'https://arxiv.org/abs/2401.0' || (1000 + doc_id % 9000) WHEN 2 THEN 'https://arxiv.org/pdf/2401.0' || (1000 + doc_id % 9000) || 'v2.pdf' WHEN 3 THEN 'cs/01120' || (10 + doc_id % 90) || 'v2' WHEN 4 THEN 'https://arxiv.org/list/cs' ELSE 'word ' || doc_id END"


@query("norm_arxiv", f"SELECT doc_id, CASE WHEN regexp_full_match(b, '(?i)([0-9]{{4}}\\.[0-9]{{4,5}}|[a-z-]+(\\.[a-z]{{2}})?/[0-9]{{7}})') THEN b END AS arxiv_id FROM (SELECT doc_id, regexp_replace(regexp_replace(CASE WHEN regexp_matches(a, '(?i)arxiv\\.org/(abs|pdf|html)/') THEN regexp_extract(a, '(?i)arxiv\\.org/(?:abs|pdf|html)/(.+?)(?:\\.pdf)?/?(?:[?#].*)?$', 1) ELSE a END, '(?i)^arxiv:\\s*', ''), '(?i)v[0-9]+$', '') AS b FROM (SELECT doc_id, trim({_ARXIVS}) AS a FROM documents))")
def norm_arxiv(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.norm_arxiv(F.expr(_ARXIVS)).alias("arxiv_id"))


_ITEMS = "CASE doc_id % 5 WHEN 0 THEN '10.1234/x.' || doc_id WHEN 1 THEN 'arXiv:2401.0' || (1000 + doc_id % 9000) || 'v2' WHEN 2 THEN lpad('' || doc_id, 40, 'a0') WHEN 3 THEN 'https://doi.org/10.5555/Y' || doc_id ELSE 'A title of ' || doc_id END"


@query("classify_ref", f"SELECT doc_id, CASE WHEN regexp_matches(i, '(?i)^((https?://)?(dx\\.)?doi\\.org/|doi:\\s*)?10\\.[0-9]{{4,9}}/\\S+$') THEN 'doi' WHEN regexp_matches(i, '(?i)^(arxiv:\\s*)?[0-9]{{4}}\\.[0-9]{{4,5}}(v[0-9]+)?$') THEN 'arxiv' WHEN regexp_matches(i, '^[0-9a-f]{{40}}$') THEN 's2' ELSE 'title' END AS kind FROM (SELECT doc_id, {_ITEMS} AS i FROM documents)")
def classify_ref(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.reference_kind(F.expr(_ITEMS)).alias("kind"))


@query("shorten_text", f"SELECT doc_id, CASE WHEN length(t) <= 60 THEN t ELSE rtrim(substr(t, 1, 59)) || '…' END AS short FROM (SELECT doc_id, {SQUEEZE.format('coalesce(text, chr(32))')} AS t FROM documents)")
def shorten_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.shorten(F.col("text"), 60).alias("short"))


@query("strip_markup", r'''SELECT page_id, length(regexp_replace(html, '(?i)</?(i|b|u|em|strong|sub|sup|scp|span|p|jats:[a-z-]+)(\s+[a-z:-]+=("[^"]*"|''[^'']*''))*\s*/?>', '', 'g')) AS n FROM pages''')
def strip_markup(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.length(text.strip_markup(F.col("html"))).cast("long").alias("n"))


@query("unescape_entities", "SELECT page_id, replace(replace(replace(replace('x &lt;b&gt; &amp;amp; ' || page_id, '&lt;', '<'), '&gt;', '>'), '&amp;amp;', '&amp;'), '&quot;', '\"') AS plain FROM pages")
def unescape_entities(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.unescape(F.concat(F.lit("x &lt;b&gt; &amp;amp; "), F.col("page_id").cast("string"))).alias("plain"))


@query("unescape_pages")
def unescape_pages(spark, sf_dir):
    """The whole text of each page; the full table of entities is not in SQL."""
    return table(spark, sf_dir, "pages").select("page_id", text.unescape(F.col("html")).alias("plain"))


@query("redact_urls", "SELECT page_id, regexp_replace(url || '&api_key=s' || page_id, '(?i)((?:api[_-]?key|apikey|key|token|secret|password|mailto|email)=)[^&#\\s]+', '\\1***', 'g') AS url FROM pages")
def redact_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.redact(F.concat("url", F.lit("&api_key=s"), F.col("page_id").cast("string"))).alias("url"))


@query("authors_label", "SELECT p_partkey, array_to_string(a[1:6], ', ') || CASE WHEN len(a) > 6 THEN ', … (+' || (len(a) - 6) || ')' ELSE '' END AS label FROM (SELECT p_partkey, list_transform(range(1, 2 + p_partkey % 9), lambda i: p_brand || '-' || i) AS a FROM part)")
def authors_label(spark, sf_dir):
    names = F.transform(F.sequence(F.lit(1).cast("long"), 1 + F.col("p_partkey") % 9), lambda i: F.concat("p_brand", F.lit("-"), i.cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", text.authors_label(names).alias("label"))


@query("abstract_rebuild", "SELECT o_orderkey AS k, string_agg(w, ' ' ORDER BY place, w) AS abstract FROM (SELECT l_orderkey AS o_orderkey, l_returnflag || l_linestatus AS w, l_linenumber AS place FROM lineitem) GROUP BY 1")
def abstract_rebuild(spark, sf_dir):
    words = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("w")).agg(F.collect_list("l_linenumber").alias("at"))
    index = words.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("w", "at"))).alias("index"))
    return index.select(F.col("l_orderkey").alias("k"), text.abstract_of_index(F.col("index")).alias("abstract"))


# ------------------------------------------------------------------ search


@query("boolean_search", _with(PAPERS_SQL, _BODY, then=f"SELECT seq FROM body WHERE ({_term_sql('of the')} OR {_term_sql('anded')} OR {_term_sql('eren*')}) AND ({_term_sql('the*')} OR {_term_sql('from')}) AND NOT {_term_sql('scum')}"))
def boolean_search(spark, sf_dir):
    return search.search(documents_as_papers(spark, sf_dir), BOOLEAN, None).select("seq")


_SCORE = " + ".join(f"CAST({_term_sql(t)} AS INTEGER)" for t in ("of the", "anded", "eren*", "the*", "from", "scum"))


@query("boolean_search_topk", _with(PAPERS_SQL, _BODY, then=f"SELECT seq, {_SCORE} AS score FROM body WHERE ({_term_sql('of the')} OR {_term_sql('anded')} OR {_term_sql('eren*')}) AND ({_term_sql('the*')} OR {_term_sql('from')}) AND NOT {_term_sql('scum')} AND year >= 2005 ORDER BY score DESC, coalesce(citation_count, 0) DESC, seq LIMIT 20"))
def boolean_search_topk(spark, sf_dir):
    return search.search(documents_as_papers(spark, sf_dir), BOOLEAN, 20, year_min=2005).select("seq", "score")


@query("search_fan_out", _with(PAPERS_SQL, _BODY, then=f"SELECT seq, 'search:' || s || ':' || q AS tag FROM (SELECT *, CASE WHEN seq % 2 = 0 THEN 'openalex' ELSE 'arxiv' END AS s FROM body) b, (VALUES ('q1'), ('q2')) v(q) WHERE CASE q WHEN 'q1' THEN {_term_sql('idiot')} ELSE {_term_sql('moron')} END"))
def search_fan_out(spark, sf_dir):
    p = documents_as_papers(spark, sf_dir)
    found = search.fan_out({"openalex": p.where("seq % 2 = 0"), "arxiv": p.where("seq % 2 = 1")}, {"q1": "idiot", "q2": "moron"}, None)
    return found.select("seq", F.get("found_via", F.lit(0)).alias("tag"))


MANY = {"q1": BOOLEAN, "q2": "idiot OR moron*", "q3": '"in the" NOT eren*', "q4": "NOT (the OR der OR de)", "q5": '"of the" AND "to the"'}
_MANY = " UNION ALL ".join(f"SELECT '{q}' AS query, seq, {' + '.join(f'CAST({_term_sql(t)} AS INTEGER)' for t in own)} AS score, citation_count FROM body WHERE {test}" for q, own, test in (
    ("q1", ("of the", "anded", "eren*", "the*", "from", "scum"), f"({_term_sql('of the')} OR {_term_sql('anded')} OR {_term_sql('eren*')}) AND ({_term_sql('the*')} OR {_term_sql('from')}) AND NOT {_term_sql('scum')}"),
    ("q2", ("idiot", "moron*"), f"({_term_sql('idiot')} OR {_term_sql('moron*')})"),
    ("q3", ("in the", "eren*"), f"{_term_sql('in the')} AND NOT {_term_sql('eren*')}"),
    ("q4", ("the", "der", "de"), f"NOT ({_term_sql('the')} OR {_term_sql('der')} OR {_term_sql('de')})"),
    ("q5", ("of the", "to the"), f"{_term_sql('of the')} AND {_term_sql('to the')}"),
))


@query("boolean_search_many", _with(PAPERS_SQL, _BODY, then=f"SELECT query, seq, score FROM ({_MANY})"))
def boolean_search_many(spark, sf_dir):
    """Five queries in one pass over the papers."""
    return search.search_many(documents_as_papers(spark, sf_dir), MANY, None).select("query", "seq", "score")


@query("indexed_search", _with(PAPERS_SQL, _BODY, then=f"SELECT query, seq, score FROM (SELECT query, seq, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, coalesce(citation_count, 0) DESC, seq) AS k FROM ({_MANY})) WHERE k <= 200"))
def indexed_search(spark, sf_dir):
    """The same queries from an inverted index of the papers, each with its first 200."""
    p = documents_as_papers(spark, sf_dir)
    return TextIndex(spark, scratch(spark, "postings")).build(p).search_many(p, MANY, 200)


@query("fallback_first_source", _with(PAPERS_SQL, _BODY, then=f"SELECT seq, 'seed:' || q AS tag FROM (SELECT b.seq, q, r, min(r) OVER (PARTITION BY q) AS best, row_number() OVER (PARTITION BY q, r ORDER BY coalesce(citation_count, 0) DESC, seq) AS k FROM (SELECT *, CASE WHEN seq % 10 = 3 THEN 0 ELSE 1 END AS r FROM body) b, (VALUES ('q1'), ('q2')) v(q) WHERE CASE q WHEN 'q1' THEN {_term_sql('thing')} ELSE {_term_sql('clown')} AND {_term_sql('worthless')} END) WHERE r = best AND k <= 20"))
def fallback_first_source(spark, sf_dir):
    p = documents_as_papers(spark, sf_dir)
    found = search.seed([p.where("seq % 10 = 3"), p.where("seq % 10 <> 3")], {"q1": "this thing", "q2": "the clown of worthless"}, 20)
    return found.select("seq", F.get("found_via", F.lit(0)).alias("tag"))


# ------------------------------------------------------------------ identity

_KEYS = "k AS (SELECT seq, unnest(list_filter(['doi:' || doi, 'arxiv:' || lower(arxiv_id), 's2:' || s2_id], lambda x: x IS NOT NULL)) AS key FROM papers)"
_GROUPS = f"""{_KEYS}, e AS (SELECT DISTINCT min(seq) OVER (PARTITION BY key) AS a, seq AS b FROM k),
two AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
walk(seq, other) AS (SELECT seq, seq FROM papers UNION SELECT w.seq, t.b FROM walk w JOIN two t ON w.other = t.a),
g AS (SELECT seq, min(other) AS gid FROM walk GROUP BY seq)"""


def _exact_groups(papers: DataFrame) -> DataFrame:
    """Groups by identifiers alone: titles are taken out of the records that are compared."""
    grouped = identity.groups(papers.withColumn("title", F.lit(""))).select("seq", "gid")
    return papers.join(grouped, "seq")


@query("dedup_exact", _with(PAPERS_SQL, _GROUPS, then="SELECT seq, gid FROM g").replace("WITH ", "WITH RECURSIVE ", 1))
def dedup_exact(spark, sf_dir):
    return _exact_groups(documents_as_papers(spark, sf_dir)).select("seq", "gid")


@query("dedup_groups")
def dedup_groups(spark, sf_dir):
    return identity.groups(documents_as_papers(spark, sf_dir)).select("seq", "gid")


@query("fuzzy_pairs")
def fuzzy_pairs(spark, sf_dir):
    return identity.fuzzy_pairs(identity.keyed(documents_as_papers(spark, sf_dir)))


_TITLES = f"n AS (SELECT *, list_filter(string_split(name, ' '), lambda t: regexp_full_match(t, '[0-9]+|i{{1,3}}|iv|vi{{0,3}}|ix|x')) AS numbers FROM (SELECT DISTINCT {_NAME} AS name FROM papers) WHERE length(name) >= 30)"


@query("fuzzy_candidates", _with(PAPERS_SQL, _TITLES, then="SELECT a.name AS name_a, b.name AS name_b FROM n a JOIN n b ON a.name < b.name AND a.numbers = b.numbers AND 2 * least(length(a.name), length(b.name)) >= 0.93 * (length(a.name) + length(b.name)) AND levenshtein(a.name, b.name) <= floor((1 - CAST(0.93 AS DOUBLE)) * (length(a.name) + length(b.name))) + 1"))
def fuzzy_candidates(spark, sf_dir):
    """The exact prefilter before the ratio, over all titles: what it lets through has no false negatives.

    Edits count between bytes, as its SQL counts them.
    """
    names = documents_as_papers(spark, sf_dir).select(text.norm_title(F.col("title")).alias("name"))
    return identity.prefiltered(names.where(F.length("name") >= identity.FUZZY).distinct())


_MERGED = """r AS (SELECT p.*, gid, CASE WHEN coalesce(venue, '') = '' THEN 0 WHEN contains(lower(venue), 'rxiv') OR contains(lower(venue), 'ssrn') THEN 1 ELSE 2 END AS rank FROM papers p JOIN g USING (seq)),
l AS (SELECT *, coalesce(rank > max(rank) OVER (PARTITION BY gid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS lead FROM r),
o AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY lead DESC, CASE WHEN lead THEN -seq ELSE seq END) AS place FROM l)"""


@query("merge_records", _with(PAPERS_SQL, _GROUPS, _MERGED, then="""SELECT gid AS seq, arg_min(title, place) FILTER (title <> '') AS title, arg_min(venue, place) FILTER (venue IS NOT NULL) AS venue, arg_min(year, place) AS year,
arg_min(doi, place) FILTER (doi IS NOT NULL) AS doi, arg_min(status, place) FILTER (status IS NOT NULL) AS status, max(citation_count) AS citation_count, min(round) AS round, max(length(abstract)) AS abstract_length
FROM o GROUP BY gid""").replace("WITH ", "WITH RECURSIVE ", 1))
def merge_records(spark, sf_dir):
    merged = identity.merge_groups(_exact_groups(documents_as_papers(spark, sf_dir)))
    return merged.select("seq", text.blank_to_null(F.col("title")).alias("title"), "venue", "year", "doi", "status", "citation_count", "round", F.length("abstract").cast("long").alias("abstract_length"))


@query("merge_provenance", _with(PAPERS_SQL, _GROUPS, then="SELECT gid AS seq, v AS found_via FROM (SELECT DISTINCT gid, unnest(found_via) AS v FROM papers JOIN g USING (seq))").replace("WITH ", "WITH RECURSIVE ", 1))
def merge_provenance(spark, sf_dir):
    return identity.merge_groups(_exact_groups(documents_as_papers(spark, sf_dir))).select("seq", F.explode("found_via").alias("found_via"))


@query("merge_into_added", _with(PAPERS_SQL, _GROUPS, then="SELECT count(*) AS added FROM (SELECT gid FROM g GROUP BY gid HAVING gid >= (SELECT 1 + max(seq) // 2 FROM papers))").replace("WITH ", "WITH RECURSIVE ", 1))
def merge_into_added(spark, sf_dir):
    p = documents_as_papers(spark, sf_dir).withColumn("title", F.lit(""))
    half = p.agg(F.max("seq")).first()[0] // 2
    return identity.merge_into(p.where(F.col("seq") <= half), p.where(F.col("seq") > half))[1].agg(F.count("*").alias("added"))


@query("upsert_groups", _with(PAPERS_SQL, _GROUPS, then="SELECT seq, gid FROM g").replace("WITH ", "WITH RECURSIVE ", 1))
def upsert_groups(spark, sf_dir):
    """Groups by identifiers (the SQL has no near titles), from an index of two thirds of the papers to which the others are added."""
    p = documents_as_papers(spark, sf_dir).withColumn("title", F.lit(""))
    at = p.agg(F.max("seq")).first()[0] * 2 // 3
    index = EntityIndex(spark, scratch(spark, "entities")).build(p.where(F.col("seq") <= at))
    index.upsert(p.where(F.col("seq") > at))
    return index.records().select("seq", "gid")


# ------------------------------------------------------------------ graph

_STEP = "SELECT start_id, id, direction FROM (SELECT start_id, id, direction, row_number() OVER (PARTITION BY direction, start_id ORDER BY coalesce(citation_count, 0) DESC, pos, id) AS k FROM near) WHERE k <= CASE direction WHEN 'backward' THEN 3 ELSE 5 END"
_NEAR = "near AS (SELECT parent_id AS start_id, c.id, 'backward' AS direction, citation_count, pos FROM edges JOIN corpus c ON child_id = c.id WHERE parent_id IN (SELECT 'o' || o_orderkey FROM orders))"


@query("snowball_backward", _with(EDGES_SQL, CORPUS_SQL, _NEAR, then=_STEP))
def snowball_backward(spark, sf_dir):
    return graph.snowball_round(frontier(spark, sf_dir), order_edges(spark, sf_dir), order_corpus(spark, sf_dir), 1, direction="backward", max_references=3).select("start_id", "id", "direction")


_CITING = "near AS (SELECT child_id AS start_id, c.id, 'forward' AS direction, citation_count, o_orderkey AS pos FROM edges JOIN corpus c ON parent_id = c.id JOIN orders ON parent_id = 'o' || o_orderkey WHERE child_id IN (SELECT 'p' || p_partkey FROM part))"


@query("snowball_forward", _with(EDGES_SQL, CORPUS_SQL, _CITING, then=_STEP))
def snowball_forward(spark, sf_dir):
    edges = order_edges(spark, sf_dir).withColumn("pos", F.substring("parent_id", 2, 20).cast("long"))
    return graph.snowball_round(part_frontier(spark, sf_dir), edges, order_corpus(spark, sf_dir), 1, direction="forward", max_citations=5).select("start_id", "id", "direction")


@query("snowball_round", _with(EDGES_SQL, CORPUS_SQL, _NEAR, then=f"SELECT 'backward:' || start_id AS found_via, id, 2 AS round FROM ({_STEP})"))
def snowball_round(spark, sf_dir):
    found = graph.snowball_round(frontier(spark, sf_dir), order_edges(spark, sf_dir), order_corpus(spark, sf_dir), 2, max_references=3)
    return found.select(F.get("found_via", F.lit(0)).alias("found_via"), "id", "round")


@query("snowball_fallback", _with(EDGES_SQL, CORPUS_SQL, then="SELECT parent_id AS start_id, child_id AS id FROM (SELECT *, min(r) OVER (PARTITION BY parent_id) AS best FROM (SELECT parent_id, child_id, CAST(regexp_extract(child_id, '[0-9]+') AS BIGINT) % 3 % 2 AS r FROM edges JOIN corpus ON child_id = id) ) WHERE r = best"))
def snowball_fallback(spark, sf_dir):
    edges = order_edges(spark, sf_dir).withColumn("source_rank", (F.substring("child_id", 2, 20).cast("long") % 3 % 2).cast("int"))
    return graph.snowball_round(frontier(spark, sf_dir), edges, order_corpus(spark, sf_dir), 1, direction="backward", max_references=None).select("start_id", "id")


@query("snowball_stats", _with(EDGES_SQL, CORPUS_SQL, _NEAR, then=f"SELECT (SELECT count(*) FROM orders) AS frontier, count(*) AS \"references\", CAST(0 AS BIGINT) AS citations, (SELECT count(*) FROM orders) - count(DISTINCT start_id) AS unresolved FROM ({_STEP})"))
def snowball_stats(spark, sf_dir):
    start = frontier(spark, sf_dir)
    found = graph.snowball_round(start, order_edges(spark, sf_dir), order_corpus(spark, sf_dir), 1, direction="backward", max_references=3)
    return graph.round_stats(start, found)


@query("hits_by_child", _with(EDGES_SQL, then="SELECT child_id, count(DISTINCT parent_id) AS hits FROM edges GROUP BY child_id"))
def hits_by_child(spark, sf_dir):
    return graph.hit_counts(order_edges(spark, sf_dir))


@query("eligible_frontier", _with(PAPERS_SQL, _BODY, _FILTERED, then="SELECT seq FROM filtered WHERE round = 1 AND excluded_reason IS NULL AND coalesce(status, '') <> 'exclude'"))
def eligible_frontier(spark, sf_dir):
    p = _filtered(spark, sf_dir)
    return graph.eligible(p, graph.next_round(p)).select("seq")


# ------------------------------------------------------------------ look-ups and completion


@query("complete_metadata", _with(PAPERS_SQL, then="SELECT p.seq, coalesce(p.citation_count, CASE WHEN p.doi IS NOT NULL THEN m.c END) AS citation_count, coalesce(p.language, CASE WHEN p.doi IS NOT NULL AND p.citation_count IS NULL THEN 'xx' END) AS language FROM papers p LEFT JOIN (SELECT '10.5555/d' || (doc_id // 6) AS doi, max(n_chars) AS c FROM documents WHERE doc_id % 3 = 0 GROUP BY 1) m ON p.doi = m.doi"))
def complete_metadata(spark, sf_dir):
    p = documents_as_papers(spark, sf_dir).withColumn("abstract", F.when(F.col("abstract") != "", F.col("abstract")).otherwise("x"))
    table_ = table(spark, sf_dir, "documents").where("doc_id % 3 = 0").groupBy(F.expr("concat('10.5555/d', cast(doc_id div 6 as string))").alias("doi")).agg(F.max("n_chars").alias("citation_count")).withColumn("language", F.lit("xx"))
    return lookup.complete(p, table_, "doi", "metadata").select("seq", "citation_count", "language")


_ASKED = "SELECT doc_id AS seq, CASE doc_id % 2 WHEN 0 THEN 'https://doi.org/10.5555/D' || doc_id ELSE '10.9999/none' || doc_id END AS item FROM documents"


def _asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    asked = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.expr("CASE doc_id % 2 WHEN 0 THEN 'https://doi.org/10.5555/D' || doc_id ELSE '10.9999/none' || doc_id END").alias("item"))
    p = documents_as_papers(spark, sf_dir)
    return asked, p.where("seq % 2 = 0"), p.where("seq % 2 = 1")


@query("resolve_lookup", _with(PAPERS_SQL, then=f"SELECT a.seq AS request_seq, lower(split_part(item, 'doi.org/', 2)) AS doi FROM ({_ASKED}) a WHERE a.seq % 2 = 0 AND EXISTS (SELECT 1 FROM papers p WHERE p.doi = lower(split_part(item, 'doi.org/', 2)))"))
def resolve_lookup(spark, sf_dir):
    return lookup.resolve(*_asked(spark, sf_dir), "manual")[0].select("request_seq", "doi")


@query("resolve_missing", _with(PAPERS_SQL, then=f"SELECT a.seq, 'not found: DOI:' || lower(regexp_replace(item, 'https://doi.org/', '')) AS why FROM ({_ASKED}) a WHERE NOT EXISTS (SELECT 1 FROM papers p WHERE p.doi = lower(regexp_replace(item, 'https://doi.org/', '')))"))
def resolve_missing(spark, sf_dir):
    return lookup.resolve(*_asked(spark, sf_dir), "manual")[1].select("seq", "why")


@query("match_titles")
def match_titles(spark, sf_dir):
    """All titles against two sources: the even half of the papers first, then the odd one."""
    p = documents_as_papers(spark, sf_dir)
    asked = p.select(F.col("seq").alias("request_seq"), F.col("title").alias("asked"))
    return lookup.match_titles(asked, p.withColumn("source_rank", (F.col("seq") % 2).cast("int"))).select("request_seq", "seq")


# ------------------------------------------------------------------ screening


@query("batches_assign", _with(PAPERS_SQL, then="SELECT seq, 1 + (k - 1) // 25 AS batch, (k - 1) % 25 AS line FROM (SELECT seq, row_number() OVER (ORDER BY seq) AS k FROM papers WHERE status IS NULL)"))
def batches_assign(spark, sf_dir):
    return screening.batch_numbers(screening.pending(documents_as_papers(spark, sf_dir), "screen"), 25).select("seq", "batch", "line")


_RESULTS = "SELECT turn AS line, conv_id AS file_no, 's2:s' || (conv_id * 7 + 2) AS id, CASE turn % 3 WHEN 0 THEN 'Included' WHEN 1 THEN 'maybe' ELSE 'nonsense' END AS status, CAST(turn * 0.3 AS VARCHAR) AS relevance, substr(text, 1, 20) AS reason FROM conversations"


def _result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("turn").alias("line"), F.col("conv_id").alias("file_no"), F.expr("'s2:s' || (conv_id * 7 + 2)").alias("id"), F.expr("CASE turn % 3 WHEN 0 THEN 'Included' WHEN 1 THEN 'maybe' ELSE 'nonsense' END").alias("status"), F.expr("cast(turn * 0.3 as string)").alias("relevance"), F.substring("text", 1, 20).alias("reason"))
    return rows.withColumns({c: F.lit(None).cast("string") for c in ("short_summary", "summary", "rq_relation", "first_level", "second_level", "priority", "code")})


@query("apply_screen", _with(PAPERS_SQL, then=f"SELECT p.seq, coalesce(r.s, p.status) AS status, nullif(r.reason, '') AS status_reason, round(r.rel, 6) AS relevance FROM papers p LEFT JOIN (SELECT seq, arg_max(s, (file_no, line)) AS s, arg_max(coalesce(reason, ''), (file_no, line)) AS reason, arg_max(least(1.0, CAST(relevance AS DOUBLE)), (file_no, line)) AS rel FROM (SELECT *, CASE status WHEN 'Included' THEN 'core' WHEN 'maybe' THEN 'skim' END AS s FROM ({_RESULTS})) q JOIN (SELECT min(seq) AS seq, 's2:' || s2_id AS key FROM papers WHERE s2_id IS NOT NULL GROUP BY 2) k ON q.id = k.key WHERE s IS NOT NULL GROUP BY seq) r ON p.seq = r.seq"))
def apply_screen(spark, sf_dir):
    return screening.apply_results(documents_as_papers(spark, sf_dir), _result_rows(spark, sf_dir), "screen").select("seq", "status", "status_reason", F.round("relevance", 6).alias("relevance"))


@query("apply_unknown", _with(PAPERS_SQL, then=f"SELECT id, count(*) AS n FROM ({_RESULTS}) WHERE id NOT IN (SELECT 's2:' || s2_id FROM papers WHERE s2_id IS NOT NULL) GROUP BY id"))
def apply_unknown(spark, sf_dir):
    return screening.unknown_ids(documents_as_papers(spark, sf_dir), _result_rows(spark, sf_dir)).groupBy("id").agg(F.count("*").alias("n"))


@query("apply_missing", _with(PAPERS_SQL, then=f"SELECT DISTINCT 'b' || (seq % 3) AS batch, 's2:' || s2_id AS id FROM papers WHERE s2_id IS NOT NULL AND status IS NULL AND 's2:' || s2_id NOT IN (SELECT id FROM ({_RESULTS}) WHERE status <> 'nonsense')"))
def apply_missing(spark, sf_dir):
    p = documents_as_papers(spark, sf_dir)
    batches = p.where("s2_id is not null").select(F.concat(F.lit("b"), (F.col("seq") % 3).cast("string")).alias("batch"), F.concat(F.lit("s2:"), "s2_id").alias("id"))
    return screening.missing_results(p, batches, _result_rows(spark, sf_dir), "screen")


# ------------------------------------------------------------------ reports


@query("identified", _with(PAPERS_SQL, then=f"SELECT kind, count(DISTINCT id) AS n FROM (SELECT {_KINDS}[1] AS kind, {_ID} AS id FROM papers) GROUP BY kind"))
def identified(spark, sf_dir):
    return report.identified(documents_as_papers(spark, sf_dir))


@query("prisma_stats", _with(PAPERS_SQL, _BODY, _FILTERED, then="""SELECT count(*) AS "unique", count(excluded_reason) AS filtered_out, count(*) FILTER (excluded_reason IS NULL AND status IS NOT NULL) AS screened, count(*) FILTER (excluded_reason IS NULL AND status IS NULL) AS awaiting_screening,
count(*) FILTER (excluded_reason IS NULL AND status = 'exclude') AS excluded_at_screening, count(*) FILTER (excluded_reason IS NULL AND status = 'core') AS core, count(*) FILTER (excluded_reason IS NULL AND status = 'skim') AS skim, CAST(0 AS BIGINT) AS enriched FROM filtered"""))
def prisma_stats(spark, sf_dir):
    return report.funnel(_filtered(spark, sf_dir))


@query("reason_ranking", _with(PAPERS_SQL, _BODY, _FILTERED, then="SELECT excluded_reason AS reason, count(*) AS n, min(seq) AS first FROM filtered WHERE excluded_reason IS NOT NULL GROUP BY 1"))
def reason_ranking(spark, sf_dir):
    return report.reasons(_filtered(spark, sf_dir))


_LABELS = ", ".join(f"('{k}', {i}, '{label}')" for i, (k, label) in enumerate(report.KIND_LABELS.items()))
_FLOW = f"""known(kind, place, label) AS (VALUES {_LABELS}), kinds AS (SELECT kind, count(DISTINCT id) AS n FROM (SELECT {_KINDS}[1] AS kind, {_ID} AS id FROM papers) GROUP BY kind),
c AS (SELECT *, greatest(0, identified_total - uniq) AS duplicates FROM (SELECT count(*) AS uniq, (SELECT sum(n) FROM kinds) AS identified_total, count(excluded_reason) AS filtered_out, count(*) FILTER (excluded_reason IS NULL AND status IS NOT NULL) AS screened,
  count(*) FILTER (excluded_reason IS NULL AND status = 'exclude') AS excluded_at_screening, count(*) FILTER (excluded_reason IS NULL AND status = 'core') AS core, count(*) FILTER (excluded_reason IS NULL AND status = 'skim') AS skim FROM filtered)),
r AS (SELECT 0 AS section, coalesce(place, 99) AS place, coalesce(label, kind) AS label, n FROM kinds LEFT JOIN known USING (kind)
  UNION ALL SELECT x.section, x.place, x.label, x.n FROM (SELECT unnest([{", ".join(f"{{'section': {section}, 'place': {i}, 'label': '{label}', 'n': CAST({' + '.join('uniq' if n == 'unique' else n for n in names)} AS BIGINT)}}" for i, (label, section, names) in enumerate(report.TOTAL_LABELS))}]) AS x FROM c)
  UNION ALL SELECT 2, row_number() OVER (ORDER BY n DESC, f), '    ' || reason, n FROM (SELECT excluded_reason AS reason, count(*) AS n, min(seq) AS f FROM filtered WHERE excluded_reason IS NOT NULL GROUP BY 1 ORDER BY n DESC, f LIMIT 8))"""


@query("flow_rows", _with(PAPERS_SQL, _BODY, _FILTERED, _FLOW, then="SELECT CAST(row_number() OVER (ORDER BY section, place, label) AS INTEGER) AS row_no, label, n FROM r"))
def flow_rows(spark, sf_dir):
    p = _filtered(spark, sf_dir)
    return report.flow(p, p)


@query("overview_category", _with(PAPERS_SQL, then="SELECT CASE WHEN grouping(c) = 1 THEN NULL ELSE c END AS category, CASE WHEN grouping(s) = 1 THEN NULL ELSE s END AS subcategory, count(*) FILTER (status = 'core') AS core, count(*) FILTER (status = 'skim') AS skim, count(*) AS total, 2 - CAST(grouping(c) + grouping(s) AS INTEGER) AS level FROM (SELECT coalesce(first_level, 'Uncategorized') AS c, coalesce(second_level, '') AS s, status FROM papers WHERE status IN ('core', 'skim')) GROUP BY ROLLUP (c, s)"))
def overview_category(spark, sf_dir):
    return report.by_category(documents_as_papers(spark, sf_dir))


@query("by_year", _with(PAPERS_SQL, then="SELECT year, count(*) AS n FROM papers WHERE status IN ('core', 'skim') GROUP BY year"))
def by_year(spark, sf_dir):
    return report.by_year(documents_as_papers(spark, sf_dir))


@query("top_venues", _with(PAPERS_SQL, then="SELECT venue, n FROM (SELECT venue, count(*) AS n, min(seq) AS f FROM papers WHERE status IN ('core', 'skim') AND venue IS NOT NULL GROUP BY venue) ORDER BY n DESC, f LIMIT 15"))
def top_venues(spark, sf_dir):
    return report.top_venues(documents_as_papers(spark, sf_dir))


# ------------------------------------------------------------------ layouts

_ORDER = "CASE status WHEN 'core' THEN 0 WHEN 'skim' THEN 1 ELSE 2 END, coalesce(citation_count, 0) DESC, lower(title), seq"


@query("papers_order", _with(PAPERS_SQL, then=f"SELECT row_number() OVER (ORDER BY {_ORDER}) AS row_no, seq FROM papers WHERE status IN ('core', 'skim')"))
def papers_order(spark, sf_dir):
    rows = documents_as_papers(spark, sf_dir).where(paper.included())
    return layout.numbered(rows, layout.paper_order()).select("row_no", "seq")


@query("grouped_layout", _with(PAPERS_SQL, then=f"""SELECT row_number() OVER (ORDER BY CASE WHEN first_level IS NULL THEN 2 WHEN first_level IN ('area 2', 'area 0') THEN 0 ELSE 1 END, CASE first_level WHEN 'area 2' THEN 1 WHEN 'area 0' THEN 2 ELSE -n END, f1,
CASE WHEN second_level IS NULL THEN 0 WHEN first_level = 'area 2' AND second_level IN ('topic 4', 'topic 0') THEN 1 ELSE 2 END, CASE WHEN first_level = 'area 2' AND second_level = 'topic 4' THEN 1 WHEN first_level = 'area 2' AND second_level = 'topic 0' THEN 2 ELSE -m END, f2, {_ORDER}) AS row_no, seq, first_level AS category, second_level AS subcategory
FROM (SELECT *, count(*) OVER (PARTITION BY first_level) AS n, min(seq) OVER (PARTITION BY first_level) AS f1, count(*) OVER (PARTITION BY first_level, second_level) AS m, min(seq) OVER (PARTITION BY first_level, second_level) AS f2 FROM papers WHERE status IN ('core', 'skim'))"""))
def grouped_layout(spark, sf_dir):
    rows = layout.grouped(documents_as_papers(spark, sf_dir), TAXONOMY)
    return layout.numbered(rows, [F.col("category_at"), F.col("subcategory_at"), *layout.paper_order()]).select("row_no", "seq", "category", "subcategory")


@query("papers_sheet", _with(PAPERS_SQL, then="SELECT 'group' AS kind, '▌ ' || coalesce(first_level, 'Uncategorized') || ' — ' || count(*) || ' paper' || CASE WHEN count(*) = 1 THEN '' ELSE 's' END AS heading FROM papers WHERE status IN ('core', 'skim') GROUP BY first_level UNION ALL SELECT 'subgroup', '▸ ' || second_level || ' (' || count(*) || ')' FROM papers WHERE status IN ('core', 'skim') AND second_level IS NOT NULL GROUP BY first_level, second_level"))
def papers_sheet(spark, sf_dir):
    return layout.papers_rows(documents_as_papers(spark, sf_dir), TAXONOMY).where("kind <> 'paper'").select("kind", "heading")


@query("papers_sheet_rows")
def papers_sheet_rows(spark, sf_dir):
    """The whole sheet: headings and papers with their cells, in order of row_no."""
    return layout.papers_rows(documents_as_papers(spark, sf_dir), TAXONOMY)


@query("outcome", _with(PAPERS_SQL, _BODY, _FILTERED, then="SELECT seq, CASE WHEN excluded_reason IS NOT NULL THEN 'removed by filter: ' || excluded_reason WHEN status = 'exclude' THEN 'excluded at screening' WHEN status IS NOT NULL THEN 'included (' || status || ')' ELSE 'not screened yet' END AS outcome FROM filtered"))
def outcome(spark, sf_dir):
    return _filtered(spark, sf_dir).select("seq", layout.outcome().alias("outcome"))


@query("literal_cells", "SELECT p_partkey, CASE WHEN regexp_matches(v, '^[=+@-]') THEN '''' || v ELSE v END AS cell FROM (SELECT p_partkey, ['=', '+', '-', '@', 'a'][1 + p_partkey % 5] || p_name AS v FROM part)")
def literal_cells(spark, sf_dir):
    lead = F.element_at(F.array(*(F.lit(x) for x in "=+-@a")), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", text.literal_cell(F.concat(lead, "p_name")).alias("cell"))


@query("runs_islands", "SELECT l_orderkey, l_returnflag AS flag, min(l_linenumber) AS low, max(l_linenumber) AS high FROM (SELECT *, sum(new) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS island FROM (SELECT *, CASE WHEN lag(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) = l_returnflag THEN 0 ELSE 1 END AS new FROM lineitem)) GROUP BY l_orderkey, l_returnflag, island")
def runs_islands(spark, sf_dir):
    out = sheets.island_ends(table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], "l_returnflag")
    return out.withColumnRenamed("l_returnflag", "flag")


# ------------------------------------------------------------------ extensions: windows over events


@query("event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    return streams.windowed_counts(table(spark, sf_dir, "events")).select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query("event_sessions", "SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def event_sessions(spark, sf_dir):
    return streams.sessions(table(spark, sf_dir, "events"))


def merged_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records, merged and filtered: the table that a review works on."""
    return filters.apply_filters(identity.dedup(conform(documents_as_papers(spark, sf_dir))), FILTERS, YEAR_NOW)


from paperloom.plans import catalogue_records, catalogue_reviews  # noqa: E402, F401  register their queries
