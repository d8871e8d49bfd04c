"""Text functions, search and extraction."""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import functions as F

from lexlake.functions import strings as S
from lexlake.operators import postings, search
from lexlake.operators import text as TX
from lexlake.sources import tables as T

from .registry import query


@query("""select p_partkey id, raw, case when m then case when pre = '' then '' else pre || ' ' end || ltrim(regexp_extract(c, '[0-9]+'), '0') || regexp_extract(c, '([A-Z]*)$', 1) end as number from
 (select *, regexp_matches(c, '^[A-Z]*[0-9]+[A-Z]*$') m, regexp_extract(c, '^([A-Z]*)', 1) pre from (select p_partkey, raw, upper(regexp_replace(raw, '[^A-Za-z0-9]', '', 'g')) c from
 (select p_partkey, case p_partkey % 4 when 0 then 'h.b. 00' || (p_partkey + 1) when 1 then 'SB-' || (p_partkey + 1) || 'a' when 2 then '  A ' || (p_partkey + 1) else 'no number' end raw from part)))""")
def normalize_number(spark, d):
    n, k = (F.col("p_partkey") + 1).cast("string"), F.col("p_partkey") % 4
    raw = F.when(k == 0, F.concat(F.lit("h.b. 00"), n)).when(k == 1, F.concat(F.lit("SB-"), n, F.lit("a"))).when(k == 2, F.concat(F.lit("  A "), n)).otherwise("no number")
    return T.table(spark, d, "part").select(F.col("p_partkey").alias("id"), raw.alias("raw")).select("id", "raw", S.bill_number("raw").alias("number"))


@query("select p_partkey id, trim(regexp_replace(lower(p_name || ' (' || p_brand || ')'), '[^a-z0-9]+', '-', 'g'), '-') slug from part")
def slugify(spark, d):
    return T.table(spark, d, "part").select(F.col("p_partkey").alias("id"), S.slug(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("slug"))


@query("select page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(regexp_replace(url, '((?:19|20)[0-9]{2})', '\\1 ', 'g'), '(?:19|20)[0-9]{2}'))), ',') as years from (select page_id, regexp_replace(url, '[0-9]+', '', 'g') || '-20252026-1999rs' url from pages)")
def years(spark, d):
    rows = T.table(spark, d, "pages").select("page_id", F.concat(F.regexp_replace("url", "[0-9]+", ""), F.lit("-20252026-1999rs")).alias("x"))
    return rows.select("page_id", F.array_join(S.years("x"), ",").alias("years"))


@query("select page_id, trim(regexp_replace(regexp_replace(lower(url), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')) as k from pages")
def page_norm(spark, d):
    return T.table(spark, d, "pages").select("page_id", S.page_key("url").alias("k"))


@query("select page_id, length(t) n, md5(t) h from (select page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) t from pages)")
def html_visible_text(spark, d):
    rows = T.table(spark, d, "pages").select("page_id", S.visible_text("html").alias("t"))
    return rows.select("page_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("h"))


@query()
def html_block_text(spark, d):
    rows = T.table(spark, d, "pages").withColumn("previous", F.lit(None).cast("string"))
    return TX.fetched(rows, "url", "html", "previous").select("page_id", "kind", F.length("text").alias("n"), "checksum", "first_text")


@query("select a.page_id, b.page_id target from (select page_id, page_id * 7 % 250 as bill from pages) a join pages b on b.page_id = a.bill")
def url_param_join(spark, d):
    p = T.table(spark, d, "pages")
    urls = p.select("page_id", S.url_parameter(F.concat(F.lit("https://x.example/text?v=1&bill_id="), (F.col("page_id") * 7 % 250).cast("string")), "bill_id").alias("bill"))
    return urls.join(p.select(F.col("page_id").cast("string").alias("k"), F.col("page_id").alias("target")), F.col("bill") == F.col("k")).select("page_id", "target")


TERMS = "list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')"


def index_of(spark, d, table, fields, analyser="simple"):
    """The index of a table, built when it is first asked for; later queries of the session read it."""
    path = f"{T.shared_dir(spark)}/lexlake/{spark.sparkContext.applicationId}/{analyser}-{zlib.crc32(d.encode())}-{table}"
    index = postings.open_index(spark, path, postings.Layout(analyser=analyser))
    return index if index.segments else postings.add(index, T.table(spark, d, table), {"documents": "doc_id", "part": "p_partkey"}[table], fields)


@query(f"with h as (select doc_id id, {TERMS} t from documents), m as (select id, len(list_filter(t, lambda x: x in ('the', 'of'))) * 1000 // greatest(len(t), 1) as rank from h where list_contains(t, 'the') and list_contains(t, 'of') and not list_contains(t, 'que')), c as (select *, row_number() over (order by id) n, count(*) over () total from m) select id, rank, total > 200 saturated from c where n <= 200")
def fts_simple_capped(spark, d):
    index, q = index_of(spark, d, "documents", ["text"]), "the of -que"
    found = postings.first_matches(index, q, 200)
    return found.select(F.col("key").alias("id"), postings.share_rank(postings.analysed_query(q, index.layout)).alias("rank"), "saturated")


@query(f"with h as (select doc_id id, {TERMS} t from documents), m as (select id, len(list_filter(t, lambda x: x in ('und', 'die'))) * 1000 // greatest(len(t), 1) as rank from h where list_contains(t, 'und') and list_contains(t, 'die') order by id limit 5000) select id, rank from m order by rank desc, id limit 20")
def fts_page(spark, d):
    index, q = index_of(spark, d, "documents", ["text"]), "und die"
    found = postings.first_matches(index, q, 5000)
    return found.select(F.col("key").alias("id"), postings.share_rank(postings.analysed_query(q, index.layout)).alias("rank")).orderBy(F.desc("rank"), "id").limit(20)


@query()
def fts_english(spark, d):
    """Stems and stop words of the published English analyser; DuckDB has none without its extension."""
    found = postings.first_matches(index_of(spark, d, "documents", ["text"], "english"), "nation or things or the", 5000)
    return found.select(F.col("key").alias("id"), F.size("hits").alias("hits"), "saturated")


@query(f"select doc_id id from (select doc_id, {TERMS} t from documents) where (contains(' ' || array_to_string(t, ' ') || ' ', ' of the ') or (list_contains(t, 'der') and contains(' ' || array_to_string(t, ' ') || ' ', ' und die '))) ")
def fts_phrase(spark, d):
    """Phrases by positions alone."""
    return postings.matches(index_of(spark, d, "documents", ["text"]), '"of the" or der "und die"').select(F.col("key").alias("id"))


@query("""with f as (select p_partkey id, list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda x: x <> '') a, list_filter(regexp_split_to_array(lower(p_type), '[^a-z0-9]+'), lambda x: x <> '') b from part),
 s as (select count(*) n, sum(len(a) + len(b)) l from f), t as (select id, len(a) + len(b) len, term, 4 * len(list_filter(a, lambda x: x = term)) + len(list_filter(b, lambda x: x = term)) tf from f, (values ('blue'), ('economy'), ('widget')) v(term)),
 d as (select term, count(*) df from t where tf > 0 group by 1)
 select id, cast(sum(cast(floor(1000 * ln(cast(2 * n + 2 as double) / cast(2 * df + 1 as double))) as bigint) * ((2200000 * tf) // (1000 * tf + 300 + (900 * len * n) // l))) as bigint) score from t join d using (term), s where tf > 0 group by 1 order by score desc, id limit 500""")
def fts_bm25(spark, d):
    """Names weigh four times what types do."""
    index, q = index_of(spark, d, "part", ["p_name", "p_type"]), "blue or economy or widget"
    scored = postings.bm25(index, postings.matches(index, q), q, [4, 1])
    return scored.select(F.col("key").alias("id"), "score").orderBy(F.desc("score"), "id").limit(500)


@query(f"""with w as (select doc_id id, {TERMS} t from documents), e as (select id, unnest(t) term, generate_subscripts(t, 1) pos from w), h as (select * from e where term in ('the', 'und', 'que')),
 l as (select a.id, a.pos, b.term, max(b.pos) last from h a join h b on a.id = b.id and b.pos <= a.pos and b.pos > a.pos - 25 group by 1, 2, 3), g as (select id, pos, count(*) many, min(last) first from l group by 1, 2),
 b as (select id, pos stop, first, row_number() over (partition by id order by many desc, pos - first, first) n from g), c as (select id, greatest(1, least(first, stop - 14)) start, stop from b where n = 1)
 select c.id doc_id, array_to_string(list_transform(list_slice(t, start, start + greatest(stop - start + 1, 15) - 1), lambda x: case when x in ('the', 'und', 'que') then '⟦H⟧' || x || '⟦/H⟧' else x end), ' ') snippet from c join w using (id)""")
def headline(spark, d):
    """The best fragment of each match: the shortest of the windows with most of the query's words."""
    index, q = index_of(spark, d, "documents", ["text"]), "the or und or que"
    shown = postings.fragments(index, postings.matches(index, q), q, T.table(spark, d, "documents"), "doc_id", ["text"])
    return shown.select(F.col("key").alias("doc_id"), "snippet")


@query("""with f as (select p_partkey id, list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda x: x <> '') a, list_filter(regexp_split_to_array(lower(p_type), '[^a-z0-9]+'), lambda x: x <> '') b from part),
 m as (select id, case when list_has_any(a, ['blue', 'economy']) then 0 else 1 end field, case when list_has_any(a, ['blue', 'economy']) then a else b end t from f where list_has_any(a, ['blue', 'economy']) or list_has_any(b, ['blue', 'economy']))
 select id, field, array_to_string(list_transform(t, lambda x: case when x in ('blue', 'economy') then '[' || x || ']' else x end), ' ') snippet from m""")
def headline_title_first(spark, d):
    """A fragment of the name if it has any of the words, else of the type."""
    index, q = index_of(spark, d, "part", ["p_name", "p_type"]), "blue or economy"
    return postings.fragments(index, postings.matches(index, q), q, T.table(spark, d, "part"), "p_partkey", ["p_name", "p_type"], marks=("[", "]")).select(F.col("key").alias("id"), "field", "snippet")


@query(f"with n as (select doc_id id, case when doc_id % 7 = 0 then 'The replaced, of it' else text end text from documents where doc_id % 11 <> 0), h as (select id, {TERMS} t from n) select id, len(list_filter(t, lambda x: x in ('the', 'of'))) * 1000 // greatest(len(t), 1) as rank from h where list_contains(t, 'the') and list_contains(t, 'of')")
def fts_appended(spark, d):
    """A stored index to which a later load adds, replaces and deletes records; the newest segment's word counts."""
    path, docs, q = f"{T.shared_dir(spark)}/lexlake/appended-{uuid.uuid4().hex}", T.table(spark, d, "documents"), "the of"
    stored = postings.build(spark, docs.where("doc_id % 5 <> 0"), "doc_id", ["text"], path)
    newer = docs.where("(doc_id % 5 = 0 or doc_id % 7 = 0) and doc_id % 11 <> 0").withColumn("text", F.when(F.col("doc_id") % 7 == 0, "The replaced, of it").otherwise(F.col("text")))
    index = postings.add(stored, newer, "doc_id", ["text"], deleted=docs.where("doc_id % 11 = 0"))
    return postings.matches(index, q).select(F.col("key").alias("id"), postings.share_rank(postings.analysed_query(q, index.layout)).alias("rank"))


@query(f"select id, max(rank) as rank from (select doc_id id, len(list_filter({TERMS}, lambda x: x = 'the')) as rank from documents where list_contains({TERMS}, 'the') union all select p_partkey, len(p_name) from part where p_name ilike '%blue%') group by id")
def union_max_rank(spark, d):
    hits = T.table(spark, d, "documents").select(F.col("doc_id").alias("id"), search.tokens("text").alias("t")).where(F.array_contains("t", "the"))
    a = hits.select("id", F.size(F.filter("t", lambda x: x == "the")).cast("long").alias("rank"))
    b = T.table(spark, d, "part").where(F.col("p_name").ilike("%blue%")).select(F.col("p_partkey").alias("id"), F.length("p_name").cast("long").alias("rank"))
    return search.union_best([a, b], "id")


@query(f"select t term, count(*) docs, cast(sum(n) as bigint) tf from (select doc_id, t, count(*) n from (select doc_id, unnest({TERMS}) t from documents) group by 1, 2) group by t having count(*) > 20")
def postings_terms(spark, d):
    p = search.postings(T.table(spark, d, "documents"), "doc_id", "text")
    return p.groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("tf")).where("docs > 20")


GRAMS = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda x: x <> ''), lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query(f"with g as (select p_partkey id, {GRAMS.format('p_name')} g, {GRAMS.format(chr(39) + 'blue widget' + chr(39))} q from part), s as (select id, cast(len(list_intersect(g, q)) as bigint) * 1000000 // len(list_distinct(list_concat(g, q))) similarity from g) select id, similarity from s where similarity > 150000")
def trigram_fallback(spark, d):
    rows = T.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
    return search.similar_to(rows, "title", "blue widget", 150_000).select("id", "similarity")


@query(f"with n as (select p_name, min(p_partkey) id from part group by 1), g as (select id, {GRAMS.format('p_name')} g from n), s as (select x.id a, y.id b, cast(len(list_intersect(x.g, y.g)) as bigint) * 1000000 // len(list_distinct(list_concat(x.g, y.g))) similarity from g x join g y on x.id < y.id) select * from s where similarity > 400000")
def trigram_similar(spark, d):
    rows = T.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
    return search.similar_pairs(rows, "id", "title", 400_000)


@query("select doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]{6,}'), lambda x: x not in ('before', 'should')))), ',') words from documents")
def keywords(spark, d):
    rows = T.table(spark, d, "documents")
    return rows.select("doc_id", F.array_join(F.array_sort(S.long_words("text", ["before", "should"])), ",").alias("words"))


@query("select p_partkey id, lower(p_brand) = 'x' or p_size % 2 = 0 truth, array_to_string(list_sort(list_distinct(list_filter(string_split(p_type || ',' || p_brand || ',' || p_type, ','), lambda x: x <> ''))), ',') list from part")
def canonical_lists(spark, d):
    rows = T.table(spark, d, "part")
    return rows.select(F.col("p_partkey").alias("id"), S.truth(F.when(F.col("p_size") % 2 == 0, " Yes").otherwise("nope")).alias("truth"), S.canonical_list(F.concat_ws(",", "p_type", "p_brand", "p_type")).alias("list"))


@query("select p_partkey id, case p_size % 6 when 0 then 'ok' when 1 then 'gone' when 2 then 'limited' when 3 then 'hard' when 4 then 'transport' else 'soft' end class from part")
def error_classes(spark, d):
    k = F.col("p_size") % 6
    code = F.when(k == 0, 204).when(k == 1, 410).when(k == 2, 429).when(k == 3, 404).when(k == 5, 503)
    return T.table(spark, d, "part").select(F.col("p_partkey").alias("id"), S.error_class(code).alias("class"))
