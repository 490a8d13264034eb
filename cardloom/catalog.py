"""The engine's queries, each with the DuckDB statement of the same result."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import registry
from .functions import text as T
from .operators import cards as C
from .operators import dedup as D
from .operators import evaluate as E
from .operators import lifecycle as L
from .plans import query as Q
from .plans import rank as R
from .session import checkpointed
from .sources import feeds, files
from .sources.tables import Tables, duck
from .streaming import ingest

AS_OF = "2025-01-01"


def query(name: str, sql: str | None = None, *also: str):
    def add(f):
        registry.QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            registry.ORACLES[name] = duck(sql, *also)
        return f

    return add


# ---------------------------------------------------------------- cards


@query("cards_hydrated", """SELECT c.id, coalesce(t.tags, '') AS tags, coalesce(k.links, '') AS links FROM cards c
LEFT JOIN (SELECT card_id, string_agg(tag, ',' ORDER BY tag) AS tags FROM (SELECT DISTINCT card_id, tag FROM card_tags) GROUP BY card_id) t ON t.card_id = c.id
LEFT JOIN (SELECT source_card_id, string_agg(target_card_id, ',' ORDER BY target_card_id) AS links FROM (SELECT DISTINCT * FROM card_links) GROUP BY source_card_id) k ON k.source_card_id = c.id""")
def _(t):
    return C.hydrated(t.cards, t.card_tags, t.card_links).select("id", F.array_join("tags", ",").alias("tags"), F.array_join("links", ",").alias("links"))


@query("card_lookup", "SELECT id, title, type FROM cards WHERE id = 'c42'")
def _(t):
    return t.cards.where("id = 'c42'").limit(1).select("id", "title", "type")


@query("tags_for_card", "SELECT tag FROM card_tags WHERE card_id = 'c42'")
def _(t):
    return t.card_tags.where("card_id = 'c42'").select("tag").orderBy("tag")


@query("card_filter", "SELECT id, type, kj_group_id FROM cards WHERE NOT archived AND type = 'note' AND kj_group_id = 'g4' AND id IN (SELECT card_id FROM card_tags WHERE tag = 'en') AND contains(lower(body), 'the')")
def _(t):
    return C.filtered(t.cards, t.card_tags, False, "note", "g4", "en", " THE ").select("id", "type", "kj_group_id")


@query("card_substring", "SELECT id FROM cards WHERE contains(lower(title), 'src1') OR contains(lower(body), 'src1') OR contains(lower(coalesce(summary, '')), 'src1') OR id IN (SELECT card_id FROM card_tags WHERE contains(lower(tag), 'src1'))")
def _(t):
    return C.filtered(t.cards, t.card_tags, q="SRC1").select("id")


@query("card_by_tag", "SELECT id, title FROM cards WHERE EXISTS (SELECT 1 FROM card_tags g WHERE g.card_id = cards.id AND tag = 'fr')")
def _(t):
    return C.by_tag(t.cards, t.card_tags, "fr").select("id", "title")


@query("card_page", "SELECT id, (SELECT count(*) FROM cards WHERE type = 'memo') AS total FROM cards WHERE type = 'memo' ORDER BY created_on DESC, id LIMIT 20 OFFSET 40")
def _(t):
    return C.page(t.cards.where("type = 'memo'"), 20, 40).select("id", "total")


@query("backlinks", "SELECT id FROM cards WHERE id IN (SELECT source_card_id FROM card_links WHERE target_card_id = 'c70' AND source_card_id <> 'c70')")
def _(t):
    return C.backlinks(t.cards, t.card_links, "c70").select("id")


@query("outgoing_links", "SELECT DISTINCT target_card_id FROM card_links WHERE source_card_id = 'c10'")
def _(t):
    return C.outgoing(t.card_links, "c10")


@query("kj_groups", "SELECT id, name, coalesce(color, '#4D96FF') AS color FROM kj_groups ORDER BY seq")
def _(t):
    return t.kj_groups.orderBy("seq").select("id", "name", F.coalesce("color", F.lit(T.DEFAULT_GROUP_COLOR)).alias("color"))


@query("kj_board", """SELECT g.id AS kj_group_id, name, coalesce(color, '#4D96FF') AS color, count(c.id) AS n, min(c.id) AS first_card FROM kj_groups g LEFT JOIN cards c ON c.kj_group_id = g.id GROUP BY ALL
UNION ALL SELECT NULL, NULL, NULL, count(*), min(id) FROM cards WHERE kj_group_id IS NULL OR kj_group_id NOT IN (SELECT id FROM kj_groups)""")
def _(t):
    return C.board(t.kj_groups, t.cards)


@query("kj_palette", "SELECT id, ['#FF6B6B', '#FFD93D', '#6BCB77', '#4D96FF', '#C77DFF', '#FF9A3C', '#00C9A7', '#F72585'][((row_number() OVER (ORDER BY seq) - 1) % 8) + 1] AS color FROM kj_groups")
def _(t):
    return C.palette(t.kj_groups).select("id", "color")


@query("tag_counts", "SELECT tag, count(*) AS n FROM card_tags GROUP BY tag ORDER BY n DESC, tag")
def _(t):
    return C.tag_counts(t.card_tags)


GRAPH = """SELECT id, substr(title, 1, 40) AS label, coalesce(summary, substr(body, 1, 100)) AS hover FROM cards WHERE id IN (
SELECT source_card_id FROM card_links WHERE target_card_id IN (SELECT id FROM cards) UNION SELECT target_card_id FROM card_links WHERE target_card_id IN (SELECT id FROM cards))"""


@query("graph_nodes", GRAPH)
def _(t):
    return C.graph_nodes(t.cards, t.card_links)


@query("graph_page", f"SELECT id, label FROM ({GRAPH}) ORDER BY id LIMIT 50 OFFSET 25")
def _(t):
    return C.graph_nodes(t.cards, t.card_links).select("id", "label").orderBy("id").offset(25).limit(50)


@query("link_candidates", """SELECT id FROM cards WHERE (contains(lower(title), 'th') OR id IN (SELECT card_id FROM card_tags WHERE contains(lower(tag), 'th'))) AND id <> 'c10'
AND id NOT IN (SELECT target_card_id FROM card_links WHERE source_card_id = 'c10') ORDER BY id LIMIT 8""")
def _(t):
    return C.link_candidates(t.cards, t.card_tags, t.card_links, "c10", "th").select("id")


@query("card_markdown", r"""SELECT h.id, regexp_replace(concat('# ', title, chr(10), chr(10), body, chr(10), chr(10), '---', chr(10), chr(10),
  CASE WHEN trim(coalesce(summary, '')) <> '' THEN concat('## Summary', chr(10), chr(10), summary, chr(10), chr(10)) ELSE '' END,
  '## Metadata', chr(10), chr(10), '- ID: ', h.id, chr(10), '- Type: ', type, chr(10), '- Tags: ', coalesce(t.tags, 'none'), chr(10),
  CASE WHEN url <> '' THEN concat('- URL: ', url, chr(10)) ELSE '' END, '- Created: ', created_on, chr(10), '- Updated: ', updated_on, chr(10), chr(10),
  CASE WHEN k.links IS NOT NULL THEN concat('## Links', chr(10), chr(10), k.links, chr(10)) ELSE '' END), '\s+$', '') || chr(10) AS markdown
FROM cards h LEFT JOIN (SELECT card_id, string_agg(tag, ', ' ORDER BY tag) AS tags FROM (SELECT DISTINCT card_id, tag FROM card_tags) GROUP BY card_id) t ON t.card_id = h.id
LEFT JOIN (SELECT source_card_id, string_agg('- ' || target_card_id, chr(10) ORDER BY target_card_id) AS links FROM (SELECT DISTINCT * FROM card_links) GROUP BY source_card_id) k ON k.source_card_id = h.id""")
def _(t):
    return C.markdown(C.hydrated(t.cards, t.card_tags, t.card_links))


SAFE = r"""coalesce(nullif(regexp_replace(substr(trim(regexp_replace(regexp_replace(title, '[<>:"/\\|?*\x00-\x1f]', ' ', 'g'), '\s+', ' ', 'g')), 1, 80), '[. ]+$', ''), ''), nullif(id, ''), 'card')"""


@query("safe_filename", f"SELECT id, {SAFE} AS filename FROM cards")
def _(t):
    return t.cards.select("id", T.safe_filename(F.col("title"), F.col("id")).alias("filename"))


@query("filename_dedup", f"""SELECT id, base || CASE WHEN n > 1 THEN '-' || n ELSE '' END || '.md' AS filename FROM (
SELECT id, base, row_number() OVER (PARTITION BY base ORDER BY seq) AS n FROM (SELECT id, seq, {SAFE} AS base FROM cards))""")
def _(t):
    return C.distinct_filenames(t.cards).select("id", "filename")


@query("bulk_delete", """SELECT 'cards' AS relation, count(*) AS n FROM cards WHERE seq % 5 <> 0 UNION ALL SELECT 'tags', count(*) FROM card_tags WHERE card_id NOT IN (SELECT id FROM cards WHERE seq % 5 = 0)
UNION ALL SELECT 'links', count(*) FROM card_links WHERE source_card_id NOT IN (SELECT id FROM cards WHERE seq % 5 = 0) AND target_card_id NOT IN (SELECT id FROM cards WHERE seq % 5 = 0)""")
def _(t):
    left = C.deleted(t.cards, t.card_tags, t.card_links, t.cards.where("seq % 5 = 0").select("id"))
    return files.union_all([df.agg(F.lit(n).alias("relation"), F.count("*").alias("n")) for n, df in zip(("cards", "tags", "links"), left, strict=True)])


@query("bulk_archive", "SELECT id, archived OR seq % 3 = 0 AS archived, seq % 3 = 0 AND NOT archived AS changed FROM cards")
def _(t):
    return C.archived(t.cards, t.cards.where("seq % 3 = 0").select("id")).select("id", "archived", "changed")


@query("link_ops", """SELECT DISTINCT source_card_id, target_card_id FROM (SELECT * FROM card_links UNION SELECT 'c1', id FROM cards WHERE seq < 9)
WHERE source_card_id <> target_card_id AND NOT (source_card_id = 'c2')""")
def _(t):
    new = t.cards.where("seq < 9").select(F.lit("c1").alias("source_card_id"), F.col("id").alias("target_card_id"))
    return C.unlinked(C.linked(t.card_links, new), t.card_links.where("source_card_id = 'c2'"))


@query("kj_delete", "SELECT id, nullif(kj_group_id, 'g3') AS kj_group_id FROM cards")
def _(t):
    return C.group_deleted(t.cards, "g3").select("id", "kj_group_id")


@query("kj_assign", "SELECT id, CASE WHEN seq % 11 = 0 THEN 'g1' ELSE kj_group_id END AS kj_group_id FROM cards")
def _(t):
    return C.group_assigned(t.cards, t.cards.where("seq % 11 = 0"), "g1").select("id", "kj_group_id")


@query("orphan_cleanup", """SELECT 'tags' AS relation, count(*) AS n FROM card_tags WHERE card_id IN (SELECT id FROM cards WHERE NOT archived)
UNION ALL SELECT 'links', count(*) FROM card_links WHERE source_card_id IN (SELECT id FROM cards WHERE NOT archived) AND target_card_id IN (SELECT id FROM cards WHERE NOT archived)""")
def _(t):
    tags, links = C.orphans_removed(t.card_tags, t.card_links, t.cards.where("not archived"))
    return files.union_all([df.agg(F.lit(n).alias("relation"), F.count("*").alias("n")) for n, df in (("tags", tags), ("links", links))])


@query("relation_backfill", "SELECT DISTINCT id, unnest(['a', 'b']) AS value FROM articles WHERE tags_json = '[\"a\",\"b\"]'")
def _(t):
    return C.backfilled(t.articles)


# ---------------------------------------------------------------- articles and candidates


@query("articles_recent", "SELECT id, published_on::VARCHAR AS published FROM articles ORDER BY published_on DESC, updated_on DESC, id")
def _(t):
    return t.articles.orderBy(F.desc("published_on"), F.desc("updated_on"), "id").select("id", F.col("published_on").cast("string").alias("published"))


@query("article_lookup", "SELECT id, title FROM articles WHERE id = '7' OR url = 'https://example.test/9'")
def _(t):
    return t.articles.where("id = '7' or url = 'https://example.test/9'").select("id", "title")


@query("token_cache_hit", """SELECT a.id, coalesce((SELECT c.h = sha256(a.title || chr(0) || a.body) FROM c WHERE c.id = a.id OR c.url = a.url ORDER BY CASE WHEN c.id = a.id THEN 0 ELSE 1 END, c.id LIMIT 1), false) AS hit FROM articles a""",
       "c AS (SELECT CASE WHEN lang = 'fr' THEN 'z' || id ELSE id END AS id, url, CASE WHEN lang = 'de' THEN 'old' ELSE sha256(title || chr(0) || body) END AS h FROM articles)")
def _(t):
    c = t.articles.select(F.expr("case when lang = 'fr' then concat('z', id) else id end").alias("id"), "url", F.when(F.col("lang") == "de", "old").otherwise(T.content_hash(F.col("title"), F.col("body"))).alias("content_hash"))
    return L.cached_tokens(t.articles, c)


@query("candidates_by_status", "SELECT id, first_seen_on::VARCHAR AS first_seen FROM articles WHERE candidate_status = 'reviewed'")
def _(t):
    return t.articles.where("candidate_status = 'reviewed'").orderBy(F.desc("first_seen_on"), "id").select("id", F.col("first_seen_on").cast("string").alias("first_seen"))


@query("candidate_view", """SELECT id, candidate_status, coalesce(first_seen_on, updated_on)::VARCHAR AS first_seen, coalesce(last_fetched_on, updated_on)::VARCHAR AS last_seen,
CAST(CASE WHEN tags_json LIKE '[%' THEN json_array_length(tags_json) ELSE 0 END AS BIGINT) AS n_tags FROM articles""")
def _(t):
    return L.candidate_view(t.articles).withColumns({c: F.col(c).cast("string") for c in ("first_seen", "last_seen")})


EVENT = "CASE doc_id % 3 WHEN 0 THEN 'review' WHEN 1 THEN 'save' ELSE 'expire' END"


@query("candidate_transitions", f"""SELECT id, CASE WHEN {EVENT} = 'review' AND candidate_status = 'unreviewed' THEN 'reviewed' WHEN {EVENT} = 'save' AND candidate_status IN ('unreviewed', 'reviewed') AND saved_card_id IS NULL THEN 'saved'
WHEN {EVENT} = 'expire' AND candidate_status <> 'saved' THEN 'expired' ELSE candidate_status END AS to_status FROM articles""")
def _(t):
    return L.transitioned(t.articles, t.articles.select("id", F.expr(EVENT).alias("event"))).select("id", "to_status")


@query("retention_sweep", "SELECT id, CASE WHEN candidate_status = 'reviewed' AND coalesce(reviewed_on, updated_on) < DATE '2024-09-01' - 14 THEN 'expired' ELSE candidate_status END AS candidate_status FROM articles")
def _(t):
    return L.retention(t.articles, "2024-09-01", 14).select("id", "candidate_status")


UPSERT_ROWS = ("stored AS (SELECT id, url, title, published_on AS created_on, first_seen_on, candidate_status FROM articles)",
               "came AS (SELECT CASE WHEN lang IN ('fr', 'de') THEN 'z' || id ELSE id END AS id, CASE WHEN lang = 'de' THEN url || '/' || id ELSE url END AS url, 'new ' || title AS title, updated_on AS created_on, updated_on AS first_seen_on, 'unreviewed' AS candidate_status, doc_id AS seq FROM articles)",
               "u AS (SELECT * FROM came QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq) = 1)",
               "n AS (SELECT * FROM u WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.url = u.url AND s.id <> u.id))")


@query("article_upsert", """SELECT coalesce(s.id, n.id) AS id, coalesce(n.title, s.title) AS title, coalesce(s.created_on, n.created_on)::VARCHAR AS created_on,
CASE WHEN s.id IS NULL THEN n.candidate_status ELSE s.candidate_status END AS candidate_status, CASE WHEN s.id IS NULL THEN 'inserted' WHEN n.id IS NOT NULL THEN 'updated' ELSE 'kept' END AS action
FROM stored s FULL JOIN n ON s.id = n.id""", *UPSERT_ROWS)
def _(t):
    a = t.articles
    stored = a.select("id", "url", "title", F.col("published_on").alias("created_on"), "first_seen_on", "candidate_status")
    came = a.select(F.expr("case when lang in ('fr', 'de') then concat('z', id) else id end").alias("id"), F.expr("case when lang = 'de' then concat(url, '/', id) else url end").alias("url"), F.concat(F.lit("new "), "title").alias("title"), F.col("updated_on").alias("created_on"), F.col("updated_on").alias("first_seen_on"), F.lit("unreviewed").alias("candidate_status"), F.col("doc_id").alias("seq"))
    return L.upserted(stored, came).select("id", "title", F.col("created_on").cast("string").alias("created_on"), "candidate_status", "action")


@query("article_stats", "SELECT source, count(*) AS n, count(*) AS rolled, (SELECT count(*) FROM articles) AS total, max(updated_on)::VARCHAR AS last FROM articles GROUP BY source")
def _(t):
    return L.article_stats(t.articles)


@query("overlay_join", "SELECT a.id, coalesce(c.title, 'request') AS title FROM articles a LEFT JOIN (SELECT substr(id, 2) AS id, CASE WHEN type <> 'memo' THEN title END AS title FROM cards) c ON c.id = a.id")
def _(t):
    stored = t.cards.select(F.expr("substr(id, 2)").alias("id"), F.expr("case when type <> 'memo' then title end").alias("title"))
    return L.overlaid(t.articles.select("id", F.lit("request").alias("title")), stored, ["title"])


@query("validate_rows", """SELECT id, nullif(url, '') AS url, CASE WHEN trim(title) = '' THEN 'title is empty' WHEN length(title) > 200 THEN 'title is too long' WHEN length(body) > 20000 THEN 'body is too long' END AS reason FROM cards""")
def _(t):
    return L.validated(t.cards.withColumn("source_authority", F.lit(0.5))).select("id", "url", "reason")


@query("article_repair", """SELECT CASE WHEN doc_id % 5 <> 0 THEN id END AS id, doc_id % 5 <> 0 AS valid, CASE WHEN doc_id % 3 = 0 THEN published_on ELSE DATE '2025-01-01' END::VARCHAR AS published FROM articles""")
def _(t):
    raw = t.articles.select(F.expr("case when doc_id % 5 <> 0 then id end").alias("id"), "title", "url", F.expr("case when doc_id % 3 = 0 then cast(published_on as string) end").alias("published_at"), F.expr("case when doc_id % 3 = 1 then 'bad date' end").alias("publishedAt"))
    return L.repaired(raw, AS_OF).select("id", "valid", F.col("published").cast("string").alias("published"))


@query("import_articles", """SELECT 'card_from_' || id AS id, url FROM articles WHERE url NOT IN (SELECT url FROM cards WHERE url <> '')""")
def _(t):
    return files.imported(t.cards, t.articles).select("id", "url")


@query("legacy_merge", """SELECT 'cards' AS relation, count(*) AS n FROM new UNION ALL SELECT 'tags', count(*) FROM card_tags WHERE card_id IN (SELECT id FROM new)
UNION ALL SELECT 'links', count(*) FROM card_links WHERE source_card_id IN (SELECT id FROM new) AND target_card_id IN (SELECT id FROM new UNION SELECT id FROM had)""",
       "had AS (SELECT CASE WHEN type = 'idea' THEN 's' || id ELSE id END AS id, CASE WHEN type = 'idea' THEN '' ELSE url END AS url FROM cards)",
       "new AS (SELECT * FROM cards WHERE id NOT IN (SELECT id FROM had) AND (url = '' OR url NOT IN (SELECT url FROM had)))")
def _(t):
    had = t.cards.select(F.expr("case when type = 'idea' then concat('s', id) else id end").alias("id"), F.expr("case when type = 'idea' then '' else url end").alias("url"))
    out = files.merged(had, t.cards, t.card_tags, t.card_links)
    return files.union_all([df.agg(F.lit(n).alias("relation"), F.count("*").alias("n")) for n, df in zip(("cards", "tags", "links"), out, strict=True)])


@query("jobs_recent", "SELECT id, type, status, result_json FROM jobs ORDER BY seq DESC")
def _(t):
    return t.jobs.orderBy(F.desc("seq")).select("id", "type", "status", "result_json")


@query("job_lookup", "SELECT id, type, status, result_json FROM jobs WHERE id = 'j42'")
def _(t):
    return L.job(t.jobs, "j42").select("id", "type", "status", "result_json")


@query("job_recovery", "SELECT id, CASE WHEN status IN ('queued', 'running') THEN 'failed' ELSE status END AS status FROM jobs")
def _(t):
    return L.recovered(t.jobs).select("id", "status")


@query("job_state", "SELECT user_id, arg_max(status, seq) AS status, max(seq) AS seq FROM jobs GROUP BY user_id")
def _(t):
    return L.last_states(t.jobs, "user_id", "seq")


@query("request_metrics", "SELECT event_type AS route, count(*) AS n, CAST(count_if(event_type = 'error') AS BIGINT) AS errors, round(avg(value), 6) AS mean_value FROM events GROUP BY event_type")
def _(t):
    return ingest.request_metrics(t.base("events"))


# ---------------------------------------------------------------- text functions

PAGES = "SELECT page_id, %s FROM pages"


@query("strip_html", PAGES % r"substr(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')), 1, 1200) AS body")
def _(t):
    return t.base("pages").select("page_id", T.strip_html(F.col("html")).alias("body"))


@query("slug", PAGES % "substr(regexp_replace(lower(url), '[^a-z0-9]', '_', 'g'), 1, 48) AS slug")
def _(t):
    return t.base("pages").select("page_id", T.slug(F.col("url")).alias("slug"))


@query("html_escape", PAGES % """sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS escaped""")
def _(t):
    return t.base("pages").select("page_id", F.sha2(T.escape_html(F.col("html")), 256).alias("escaped"))


@query("content_hash", "SELECT id, sha256(title || chr(0) || body) AS hash FROM articles")
def _(t):
    return t.articles.select("id", T.content_hash(F.col("title"), F.col("body")).alias("hash"))


@query("infer_source", "SELECT id, CASE WHEN doc_id % 4 = 0 THEN source WHEN doc_id % 4 = 1 THEN 'rss' WHEN doc_id % 4 = 2 THEN 'arxiv' END AS inferred FROM articles")
def _(t):
    id_ = F.concat(F.expr("case doc_id % 4 when 1 then 'rss_' when 2 then 'arxiv_' else 'x_' end"), "id")
    return t.articles.select("id", T.infer_source(id_, F.expr("case when doc_id % 4 = 0 then source when doc_id % 4 = 1 then '' end")).alias("inferred"))


@query("mojibake", "SELECT doc_id, regexp_matches(text, '\uFFFD|Ã.|Â.|ã.|繧|縺|譁') AS bad FROM documents")
def _(t):
    return t.base("documents").select("doc_id", T.looks_mojibake(F.col("text")).alias("bad"))


@query("encoding_scan", "SELECT doc_id, regexp_matches(text, '" + T.CONTROL + "|\uFFFD|\u7E3A|\u8B41|\u9AEB|\u8373|\u8737|\u9666|\u9060|\u9695|\u7E67|\u7E5D|\u00E3|\u00C2|\u00C3') AS bad FROM documents")
def _(t):
    return t.base("documents").select("doc_id", T.bad_encoding(F.col("text")).alias("bad"))


@query("shingle_counts", "SELECT id, CAST(len(list_distinct([substr(s, i, 5) FOR i IN range(1, length(s) - 3)])) AS BIGINT) AS n FROM (SELECT id, lower(title || ' ' || substr(body, 1, 500)) AS s FROM articles)")
def _(t):
    return t.articles.select("id", F.size(T.shingles(F.col("title"), F.col("body"))).cast("long").alias("n"))


@query("normalize_text")
def _(t):
    return t.base("documents").select("doc_id", F.sha2(T.normalize(F.col("text")), 256).alias("normal"))


@query("mock_summary", "SELECT id, coalesce(nullif(substr(trim(body), 1, 120), ''), title) AS summary FROM articles")
def _(t):
    return t.articles.select("id", T.mock_summary(F.col("title"), F.col("body")).alias("summary"))


@query("json_arrays", "SELECT id, CASE WHEN tags_json = '[\"a\",\"b\"]' THEN 'a,b' ELSE '' END AS tags FROM articles")
def _(t):
    return t.articles.select("id", F.array_join(T.json_strings(F.col("tags_json")), ",").alias("tags"))


@query("keyword_cleanup", "SELECT id, 'alpha,' || source AS keywords FROM articles")
def _(t):
    answer = F.concat(F.lit('Here:\n```json\n["alpha", " '), "source", F.lit(' ", "", "'), F.repeat(F.lit("x"), 60), F.lit('"]\n```'))
    return t.articles.select("id", F.array_join(T.keyword_list(answer), ",").alias("keywords"))


@query("keyword_expand", "SELECT DISTINCT lang, source || ',extra' AS added FROM articles")
def _(t):
    more = F.array(F.col("lang"), F.col("source"), F.lit("extra"))
    return t.articles.select("lang", F.array_join(F.slice(F.array_except(more, F.array("lang")), 1, 10), ",").alias("added")).distinct()


@query("timestamp_repair", "SELECT id, CASE WHEN doc_id % 3 = 0 THEN published_on::TIMESTAMP::VARCHAR WHEN doc_id % 3 = 1 THEN make_timestamp((1700000000000 + doc_id * 1000) * 1000)::VARCHAR ELSE '2025-01-01 00:00:00' END AS repaired FROM articles")
def _(t):
    at = F.expr("case when doc_id % 3 = 0 then cast(published_on as string) else 'not a date' end")
    id_ = F.expr("case when doc_id % 3 = 1 then concat('card_', cast(1700000000000 + doc_id * 1000 as string), '_x') else id end")
    return t.articles.select("id", T.repaired_timestamp(at, id_, F.lit(AS_OF).cast("timestamp")).cast("string").alias("repaired"))


@query("highlight", "SELECT doc_id, sha256(regexp_replace(text, '(that|the|of)', '<mark>\\1</mark>', 'gi')) AS marked FROM documents")
def _(t):
    return t.base("documents").select("doc_id", F.sha2(T.highlight(F.col("text"), ["of", "the", "that"]), 256).alias("marked"))


@query("anonymize", "SELECT 'anon-' || substr(sha256(id), 1, 16) AS anon_id, (published_on - 100)::VARCHAR AS shifted FROM articles")
def _(t):
    return t.articles.select(F.concat(F.lit("anon-"), F.substring(F.sha2("id", 256), 1, 16)).alias("anon_id"), F.date_sub("published_on", 100).cast("string").alias("shifted"))


# ---------------------------------------------------------------- ranking

MODE = Q.Mode(keywords=[Q.Keyword("with", 2.0, ["from"]), Q.Keyword("that", 1.0), Q.Keyword("erth thti", 1.5)])
ONE = Q.Mode(keywords=[Q.Keyword("with", 1.0)])
TOKENS = ("tok AS (SELECT id, generate_subscripts(ts, 1) AS pos, unnest(ts) AS term FROM (SELECT id, regexp_extract_all(lower(title || ' ' || body), '[\\p{L}\\p{N}_]+') AS ts FROM articles))",
          "morph AS (SELECT id, term, pos FROM tok WHERE length(term) > 1)",
          "ng AS (SELECT id, term, row_number() OVER (PARTITION BY id ORDER BY min(pos)) - 1 AS pos FROM morph GROUP BY id, term)")


def rank_sql(mode: Q.Mode, floor: float = 0.35) -> tuple[str, ...]:
    """Common table expressions up to scored(id, score, ...), stated independently of the DataFrame plan."""
    syn = Q.synonym_map(mode.keywords)
    asked = [syn.get(x, x) for x in Q.query_tokens(mode.keywords)]
    ask = ", ".join(f"('{a}', {i})" for i, a in enumerate(asked))
    canon = "CASE " + " ".join(f"WHEN term = '{a}' THEN '{b}'" for a, b in syn.items()) + " ELSE term END" if syn else "term"
    weights = []
    for k in mode.keywords:
        for term in (k.term, *k.synonyms):
            for x in dict.fromkeys([Q.norm(term), *Q.tokenize(term)]):
                weights.append(f"('{syn.get(x, x)}', {k.weight})")
    groups = [g for g in Q.groups(mode.keywords, syn)]
    grp = ", ".join(f"({i}, '{x}')" for i, g in enumerate(groups) for x in g)
    bm = lambda t, w: f"SELECT id, sum(ln((n.N - d.df + 0.5) / (d.df + 0.5) + 1) * f * {mode.k1 + 1} / (f + {mode.k1} * (1 - {mode.b} + {mode.b} * l.len / n.avg)) * coalesce(w, 1)) AS s FROM {t}f JOIN {t}d d USING (term) JOIN {t}l l USING (id) CROSS JOIN {t}n n LEFT JOIN kw USING (term) GROUP BY id"
    return (
        f"q(term, i) AS (VALUES {ask})",
        f"w0(term, w) AS (VALUES {', '.join(weights)})",
        f"grp(g, term) AS (VALUES {grp})",
        *[x for t, src in (("n", "ng"), ("m", "morph")) for x in (
            f"{t}p AS (SELECT id, {canon} AS term, pos FROM {src})",
            f"{t}f AS (SELECT id, term, count(*) AS f FROM {t}p WHERE term IN (SELECT term FROM q) GROUP BY id, term)",
            f"{t}d AS (SELECT term, count(*) AS df FROM {t}f GROUP BY term)",
            f"{t}l AS (SELECT a.id, count(x.id) AS len FROM articles a LEFT JOIN {src} x ON a.id = x.id GROUP BY a.id)",
            f"{t}n AS (SELECT count(*) AS N, greatest(avg(len), 1) AS avg FROM {t}l)")],
        "kw AS (SELECT term, max(w0.w * (ln((n.N + 1) / (coalesce(df, 0) + 1)) + 1)) AS w FROM w0 LEFT JOIN nd USING (term) CROSS JOIN nn n GROUP BY term)",
        f"ns AS ({bm('n', 1)})",
        f"ms AS ({bm('m', 1)})",
        "present AS (SELECT id, count(*) AS n FROM q JOIN nf USING (term) GROUP BY id)",
        f"co AS (SELECT id, max(c) AS co FROM (SELECT a.id, a.pos, count(DISTINCT b.term) AS c FROM np a JOIN np b ON a.id = b.id AND b.pos >= a.pos AND b.pos < a.pos + {R.WINDOW} WHERE a.term IN (SELECT term FROM q) AND b.term IN (SELECT term FROM q) GROUP BY a.id, a.pos) GROUP BY id)",
        "full_g AS (SELECT id, count(*) AS n FROM (SELECT id, g FROM grp JOIN nf USING (term) GROUP BY id, g HAVING count(*) = (SELECT count(*) FROM grp x WHERE x.g = grp.g)) GROUP BY id)",
        f"""parts AS (SELECT a.id, coalesce(ns.s, 0) AS ngram_score, CASE WHEN ml.len > 0 THEN coalesce(ms.s, 0) ELSE coalesce(ns.s, 0) END AS morph_score, coalesce(co.co, 0) AS cooccur,
  1 + {mode.context_bonus - 1} * least(coalesce(co.co, 0) / greatest(coalesce(present.n, 0), 1), 1) AS context, 1 + 0.5 * coalesce(full_g.n, 0) / {max(1, len(groups))} AS coverage,
  greatest({floor}, exp(-{mode.decay} * date_diff('day', published_on, DATE '{AS_OF}'))) AS decay
  FROM articles a JOIN ml ON ml.id = a.id LEFT JOIN ns ON ns.id = a.id LEFT JOIN ms ON ms.id = a.id LEFT JOIN co ON co.id = a.id LEFT JOIN present ON present.id = a.id LEFT JOIN full_g ON full_g.id = a.id)""",
        "tops AS (SELECT max(morph_score) AS mm, max(ngram_score) AS nm FROM parts)",
        f"scored AS (SELECT id, cooccur, context, ({mode.morph_weight} * morph_score / mm + {mode.ngram_weight} * ngram_score / nm) AS bm25, ({mode.morph_weight} * morph_score / mm + {mode.ngram_weight} * ngram_score / nm) * context * coverage * decay AS score FROM parts, tops)",
    )


RANK = (*TOKENS, *rank_sql(MODE))
six = lambda c: F.round(c, 6).alias(c)


@query("bm25_rank", "SELECT id, round(bm25, 6) AS bm25, round(context, 6) AS context, round(score, 6) AS score FROM scored WHERE score > 0 ORDER BY round(scored.score, 9) DESC, id LIMIT 50", *RANK)
def _(t):
    return R.ranked(t.articles, MODE, AS_OF).select("id", six("bm25"), six("context"), six("score"))


@query("context_bonus", "SELECT id, CAST(cooccur AS BIGINT) AS cooccur, round(context, 6) AS context FROM scored", *RANK)
def _(t):
    return R.scored(t.articles, MODE, AS_OF).select("id", F.col("cooccur").cast("long").alias("cooccur"), six("context"))


@query("rank_threshold", "SELECT id, score < 0.5 AS below, CASE WHEN score < 0.5 THEN printf('score %.3f < 0.500', score) END AS reason FROM scored WHERE score > 0", *RANK)
def _(t):
    s = R.scored(t.articles, MODE, AS_OF).where("score > 0")
    return s.select("id", (F.col("score") < 0.5).alias("below"), F.when(F.col("score") < 0.5, F.format_string("score %.3f < %.3f", F.col("score"), F.lit(0.5))).alias("reason"))


@query("rank_two_stage_limit", "SELECT id, row_number() OVER (ORDER BY round(score, 9) < 0.5, round(score, 9) DESC, id) AS position FROM scored WHERE score > 0 ORDER BY position LIMIT 80", *RANK)
def _(t):
    return R.two_stage(R.scored(t.articles, MODE, AS_OF).where("score > 0"), 0.5, 80).select("id", F.col("position").cast("long").alias("position"))


@query("rank_stats", "SELECT (SELECT count(*) FROM scored WHERE score >= 0.5) AS active, (SELECT count(*) FROM scored WHERE score > 0 AND score < 0.5) AS below, round((SELECT avg(score) FROM (SELECT score FROM scored WHERE score >= 0.5 ORDER BY score DESC LIMIT 50)), 6) AS mean_score", *RANK)
def _(t):
    s = R.scored(t.articles, MODE, AS_OF).where("score > 0")
    top = s.where("score >= 0.5").orderBy(*R.by("score")).limit(50).agg(F.round(F.avg("score"), 6).alias("mean_score"))
    return s.agg(F.count_if(F.col("score") >= 0.5).alias("active"), F.count_if(F.col("score") < 0.5).alias("below")).crossJoin(F.broadcast(top))


@query("score_writeback", "SELECT a.id, CASE WHEN s.score >= 0.5 THEN round(s.score, 6) END AS candidate_score, CASE WHEN s.score >= 0.5 THEN 'body' END AS candidate_match_reason FROM articles a LEFT JOIN scored s USING (id)", *RANK)
def _(t):
    s = R.scored(t.articles, MODE, AS_OF).where("score >= 0.5").select("id", "score", F.lit("body").alias("reason"))
    base = t.articles.select("id", F.lit(None).cast("double").alias("candidate_score"), F.lit(None).cast("string").alias("candidate_match_reason"))
    return L.written_back(base, s).withColumn("candidate_score", F.round("candidate_score", 6))


# Two test queries; the good articles are what they should find.
CASES = {"q1": [Q.Keyword("with", 2.0, ["from"])], "q2": [Q.Keyword("that", 1.0), Q.Keyword("erth thti", 1.5)]}
CELLS = ("cases AS (" + " UNION ALL ".join(f"SELECT '{q}' AS query_id, id, bm25 * context * coverage AS base FROM ({'WITH ' + ', '.join(rank_sql(Q.Mode(keywords=k)))} SELECT s.id, bm25, s.context, coverage FROM scored s JOIN parts ON parts.id = s.id WHERE score > 0)" for q, k in CASES.items()) + ")",
         "grid AS (SELECT f AS floor_v, (r * 0.005)::DOUBLE AS rate FROM (SELECT unnest([0.25, 0.3, 0.35, 0.4, 0.45, 0.5]::DOUBLE[]) AS f), (SELECT unnest(range(0, 41)) AS r))",
         "tops AS (SELECT query_id, floor_v, rate, c.id, row_number() OVER (PARTITION BY query_id, floor_v, rate ORDER BY round(base * greatest(floor_v, exp(-rate * date_diff('day', published_on, DATE '2025-01-01'))), 9) DESC, c.id) AS n FROM cases c JOIN articles a ON a.id = c.id, grid)",
         "cells AS (SELECT floor_v, round(rate, 3) AS rate, avg(CASE WHEN source_authority > 0.5 THEN 1.0 ELSE 0.0 END) AS p1 FROM tops JOIN articles a ON a.id = tops.id WHERE n = 1 GROUP BY floor_v, rate)")


def _cells(t):
    tokens = checkpointed(R.tokenised(t.articles).select("id", "published_on", "morph", "ngram"))
    age = F.datediff(F.lit(AS_OF).cast("date"), "published_on").alias("age")
    each = [R.scored(tokens, Q.Mode(keywords=k), AS_OF).where("score > 0").select(F.lit(q).alias("query_id"), "id", (F.col("bm25") * F.col("context") * F.col("coverage")).alias("base"), age) for q, k in CASES.items()]
    good = t.articles.where("source_authority > 0.5").select("id")
    return E.swept(files.union_all(each), files.union_all([good.withColumn("query_id", F.lit(q)) for q in CASES]))


@query("decay_sweep", "SELECT floor_v, round(rate, 3) AS rate, round(p1, 6) AS p1 FROM cells", *TOKENS, *CELLS)
def _(t):
    return _cells(t).select("floor_v", "rate", six("p1"))


@query("sweep_windows", "SELECT floor_v, count_if(p1 >= 0.5) AS n, min(CASE WHEN p1 >= 0.5 THEN rate END) AS low, max(CASE WHEN p1 >= 0.5 THEN rate END) AS high, round(max(CASE WHEN p1 >= 0.5 THEN rate END) - min(CASE WHEN p1 >= 0.5 THEN rate END), 3) AS width FROM cells GROUP BY floor_v", *TOKENS, *CELLS)
def _(t):
    return E.sweep_windows(_cells(t), 0.5)


@query("sweep_select", "SELECT floor_v, rate FROM (SELECT *, row_number() OVER (ORDER BY floor_v, rate) AS n, count(*) OVER () AS c FROM cells WHERE p1 >= 0.5) WHERE n = c // 2 + 1", *TOKENS, *CELLS)
def _(t):
    return E.sweep_pick(_cells(t), 0.5)


VARIANTS = ("res AS (" + " UNION ALL ".join(f"SELECT '{name}' AS variant, '{q}' AS query_id, id, row_number() OVER (ORDER BY s DESC, id) AS rank FROM ({'WITH ' + ', '.join(rank_sql(mode))} SELECT id, round(score, 9) AS s FROM scored WHERE score > 0 ORDER BY s DESC, id LIMIT 5)" for q, k in CASES.items() for name, mode in E.variant_modes(k).items()) + ")",
            "rel AS (SELECT id FROM articles WHERE source_authority > 0.5)", "nrel AS (SELECT count(*) AS n FROM rel)",
            "vper AS (SELECT v.variant, v.query_id, max(CASE WHEN rank = 1 THEN 1.0 ELSE 0.0 END) AS p1, count_if(rank <= n) / n AS r_prec, coalesce(1 / min(rank), 0) AS mrr, count_if(rank <= 5) / n AS recall5, coalesce(sum(1 / log2(rank + 1)), 0) / list_sum([1 / log2(k + 1) FOR k IN range(1, least(n, 5) + 1)]) AS ndcg5 FROM (SELECT DISTINCT variant, query_id FROM (SELECT variant FROM res), (SELECT unnest(['q1', 'q2']) AS query_id)) v CROSS JOIN nrel LEFT JOIN (SELECT res.* FROM res JOIN rel ON rel.id = res.id) h ON h.variant = v.variant AND h.query_id = v.query_id GROUP BY v.variant, v.query_id, n)")


@query("variant_compare", "SELECT variant, count(*) AS n, round(avg(p1), 6) AS p1, round(avg(r_prec), 6) AS r_prec, round(avg(mrr), 6) AS mrr, round(avg(recall5), 6) AS recall5, round(avg(ndcg5), 6) AS ndcg5 FROM vper GROUP BY variant", *TOKENS, *VARIANTS)
def _(t):
    tokens = checkpointed(R.tokenised(t.articles).select("id", "published_on", "morph", "ngram"))
    good = t.articles.where("source_authority > 0.5").select("id")
    found = E.variant_means(E.compared(tokens, CASES, AS_OF), files.union_all([good.withColumn("query_id", F.lit(q)) for q in CASES]))
    return found.select("variant", "n", *[six(c) for c in E.GATES])


META = """SELECT id, [x FOR x IN [CASE WHEN contains(lower(title), 'with') OR contains(lower(title), 'that') THEN 'title' END, CASE WHEN contains(lower(body), 'with') OR contains(lower(body), 'that') THEN 'body' END] IF x IS NOT NULL] AS f,
[x FOR x IN [CASE WHEN contains(lower(title || ' ' || body), 'with') THEN 'With' END, CASE WHEN contains(lower(title || ' ' || body), 'that') THEN 'that' END] IF x IS NOT NULL] AS w FROM articles"""
WORDS = [Q.Keyword(" With "), Q.Keyword("that"), Q.Keyword("WITH")]


@query("match_meta", "SELECT id, list_aggregate(f, 'string_agg', ',') AS fields, list_aggregate(w, 'string_agg', ',') AS words FROM m WHERE len(f) > 0", f"m AS ({META})")
def _(t):
    m = L.match_meta(t.articles.select("id", "title", "body"), Q.candidates(WORDS)).where(F.size("fields") > 0)
    return m.select("id", F.array_join("fields", ",").alias("fields"), F.array_join("words", ",").alias("words"))


@query("match_reason", "SELECT id, coalesce(list_aggregate(f, 'string_agg', ', '), '本文一致') || ' / ' || coalesce('キーワード: ' || list_aggregate(w, 'string_agg', ', '), 'キーワード: none') AS reason FROM m", f"m AS ({META})")
def _(t):
    m = L.match_meta(t.articles.select("id", "title", "body"), Q.candidates(WORDS), ["none", " none"])
    return m.select("id", L.match_reason(F.col("fields"), F.col("words")).alias("reason"))


@query("public_view", "SELECT id, NULL::VARCHAR AS summary, '' AS tags, 'article' AS type, published_on::VARCHAR AS created_on, false AS archived FROM articles")
def _(t):
    v = L.public_view(R.tokenised(t.articles))
    return v.select("id", "summary", F.array_join("tags", ",").alias("tags"), "type", F.col("created_on").cast("string").alias("created_on"), "archived")


@query("exclude_terms", "SELECT id FROM articles WHERE NOT regexp_matches(lower(title || ' ' || body), '(^|[^\\p{L}\\p{N}_])(with|from)($|[^\\p{L}\\p{N}_])')")
def _(t):
    return L.without(R.tokenised(t.articles), [" WITH ", "from", "検索"]).select("id")


@query("term_freq", "SELECT term, CAST(sum(tf) AS BIGINT) AS total, count(*) AS docs FROM (SELECT id, term, count(*) AS tf FROM morph GROUP BY id, term) GROUP BY term", *TOKENS)
def _(t):
    return R.postings(R.tokenised(t.articles), "morph").groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("docs"))


@query("corpus_stats", "SELECT term, count(*) AS df FROM ng GROUP BY term", *TOKENS)
def _(t):
    return R.corpus_stats(R.tokenised(t.articles))


@query("corpus_profile", "SELECT count(DISTINCT term) AS vocabulary, (SELECT count(*) FROM articles) AS docs, round(count(*) / (SELECT count(*) FROM articles), 6) AS mean_len, (SELECT count(*) FROM articles WHERE regexp_matches(body, '[ぁ-んァ-ヶ一-龠]')) AS japanese FROM morph", *TOKENS)
def _(t):
    tokens = R.tokenised(t.articles)
    words = tokens.select(F.explode("morph").alias("term")).agg(F.countDistinct("term").alias("vocabulary"))
    rest = tokens.agg(F.count("*").alias("docs"), F.round(F.sum(F.size("morph")) / F.count("*"), 6).alias("mean_len"), F.count_if(F.col("body").rlike("[ぁ-んァ-ヶ一-龠]")).alias("japanese"))
    return words.crossJoin(F.broadcast(rest))


@query("token_cost", "SELECT (SELECT count(*) FROM morph) AS morph_tokens, (SELECT count(*) FROM ng) AS ngram_tokens, round((SELECT count(*) FROM ng) / (SELECT count(*) FROM morph), 6) AS ratio", *TOKENS)
def _(t):
    s = R.tokenised(t.articles).agg(F.sum(F.size("morph").cast("long")).alias("morph_tokens"), F.sum(F.size("ngram").cast("long")).alias("ngram_tokens"))
    return s.withColumn("ratio", F.round(F.col("ngram_tokens") / F.col("morph_tokens"), 6))


@query("probe_queries", """SELECT id, term, df, n FROM (SELECT ng.id, term, df, row_number() OVER (PARTITION BY ng.id ORDER BY df DESC, length(term) DESC, term) AS n FROM ng JOIN (SELECT term, count(*) AS df FROM ng GROUP BY term HAVING count(*) BETWEEN 2 AND 12) USING (term)) WHERE n <= 2""", *TOKENS)
def _(t):
    tokens = R.tokenised(t.articles)
    return E.probe_terms(R.postings(tokens), R.corpus_stats(tokens), 2, 12).withColumn("n", F.col("n").cast("long"))


@query("fts_filter", "SELECT DISTINCT id FROM morph WHERE term IN ('with', 'from')", *TOKENS)
def _(t):
    return R.tokenised(t.articles).where(F.arrays_overlap("morph", F.array(F.lit("with"), F.lit("from")))).select("id")


FTS = ("fl AS (SELECT a.id, count(m.id) AS len FROM articles a LEFT JOIN morph m ON m.id = a.id GROUP BY a.id)", "fn AS (SELECT count(*) AS N, avg(len) AS av FROM fl)",
       "ff AS (SELECT id, term, count(*) AS f FROM morph WHERE term IN ('with', 'from') GROUP BY id, term)", "fd AS (SELECT term, count(*) AS df FROM ff GROUP BY term)",
       "fts AS (SELECT id, sum(ln((N - df + 0.5) / (df + 0.5) + 1) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / av))) AS fts FROM ff JOIN fd USING (term) JOIN fl USING (id), fn GROUP BY id)")


@query("fts_rank", "SELECT id, round(fts, 6) AS fts FROM fts", *TOKENS, *FTS)
def _(t):
    return R.fts(R.tokenised(t.articles), ["with", "from"]).select("id", six("fts"))


@query("hybrid_rank", """SELECT b.id, round(0.7 * score / (SELECT max(score) FROM base) + 0.3 * coalesce(p.place, 0), 6) AS hybrid FROM base b LEFT JOIN place p ON p.id = b.id""",
       *RANK, *FTS, "base AS (SELECT id, score FROM scored WHERE round(score, 9) >= 0.5 ORDER BY round(score, 9) DESC, id LIMIT 50)", "place AS (SELECT id, 1 - (row_number() OVER (ORDER BY round(fts, 9) DESC, id) - 1) / count(*) OVER () AS place FROM fts)")
def _(t):
    tokens = checkpointed(R.index(t.articles))
    base = R.two_stage(R.scored(tokens, MODE, AS_OF).where("score > 0"), 0.5, 50).where("not below").select("id", "score")
    return R.hybrid(base, R.fts(tokens, ["with", "from"])).select("id", six("hybrid"))


@query("index_sync", """SELECT id, CASE WHEN doc_id % 3 = 0 THEN 'new' WHEN doc_id % 3 = 1 THEN 'changed' ELSE 'kept' END AS was, (SELECT count(*) FROM ng WHERE ng.id = a.id) AS n_terms FROM articles a""", *TOKENS)
def _(t):
    # each article is new, changed or as it was: the index after an upkeep by content hash
    was = F.expr("case doc_id % 3 when 0 then 'new' when 1 then 'changed' else 'kept' end")
    old = R.index(t.articles.withColumn("body", F.when(was == "changed", F.concat("body", F.lit(" old"))).otherwise(F.col("body"))).where(was != "new"))
    return R.index(t.articles, old).join(t.articles.select("id", was.alias("was")), "id").select("id", "was", F.size("ngram").cast("long").alias("n_terms"))


@query("index_rebuild", "SELECT id, count(*) AS n_terms FROM ng GROUP BY id", *TOKENS)
def _(t):
    return R.postings(R.tokenised(t.articles)).groupBy("id").agg(F.count("*").alias("n_terms"))


@query("index_parity", "SELECT 'missing' AS side, count(*) AS n FROM cards WHERE type = 'memo' UNION ALL SELECT 'stale', count(*) FROM cards WHERE archived AND type <> 'memo'")
def _(t):
    live, index = t.cards.where("not archived or type = 'memo'"), t.cards.where("type <> 'memo'")
    sides = (("missing", live, index), ("stale", index, live))
    return files.union_all([a.join(b.select("id"), "id", "left_anti").agg(F.lit(n).alias("side"), F.count("*").alias("n")) for n, a, b in sides])


@query("index_drift", "SELECT id FROM cards WHERE seq % 8 = 0")
def _(t):
    index = t.cards.select("id", F.when(F.col("seq") % 8 == 0, F.concat("title", F.lit("*"))).otherwise(F.col("title")).alias("old"))
    return t.cards.join(index, "id").where(~F.col("title").eqNullSafe(F.col("old"))).select("id")


# ---------------------------------------------------------------- near duplicates

PAIRS = ("sh AS (SELECT DISTINCT id, substr(s, i, 5) AS g FROM (SELECT id, s, unnest(range(1, length(s) - 3)) AS i FROM (SELECT id, lower(title || ' ' || substr(body, 1, 500)) AS s FROM articles) WHERE length(s) >= 5))",
         "sig AS (SELECT a.id, coalesce(string_agg(g, chr(0) ORDER BY g), '') AS s FROM articles a LEFT JOIN sh ON sh.id = a.id GROUP BY a.id)",
         "rep AS (SELECT s, min(id) AS id FROM sig GROUP BY s)",
         "rs AS (SELECT sh.* FROM sh JOIN rep ON rep.id = sh.id)",
         "sn AS (SELECT id, count(*) AS n FROM rs GROUP BY id)",
         "pairs AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM rs a JOIN rs b ON a.g = b.g AND a.id < b.id GROUP BY ALL)",
         "near AS (SELECT a, b, c / (x.n + y.n - c) AS jaccard FROM pairs JOIN sn x ON x.id = a JOIN sn y ON y.id = b)",
         "dup AS (SELECT * FROM near WHERE jaccard >= 0.8 UNION ALL SELECT rep.id, sig.id, 1.0 FROM sig JOIN rep ON sig.s = rep.s WHERE sig.id <> rep.id)")


# the smallest id of each different text of a class, pairs of texts, and each copy with its text
TEXTS = ("txt AS (SELECT rep.id AS class, title, body, min(x.id) AS id FROM sig JOIN rep ON sig.s = rep.s JOIN articles x ON x.id = sig.id GROUP BY ALL)",
         """dup_texts AS (SELECT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b, jaccard FROM near JOIN txt x ON x.class = a JOIN txt y ON y.class = b WHERE jaccard >= 0.8
            UNION ALL SELECT x.id, y.id, 1.0 FROM txt x JOIN txt y ON x.class = y.class AND x.id < y.id
            UNION ALL SELECT txt.id, x.id, 1.0 FROM sig JOIN rep ON sig.s = rep.s JOIN articles x ON x.id = sig.id JOIN txt ON txt.class = rep.id AND txt.title IS NOT DISTINCT FROM x.title AND txt.body IS NOT DISTINCT FROM x.body WHERE x.id <> txt.id)""")


@query("dup_pairs_exact", "SELECT a, b, round(jaccard, 6) AS jaccard FROM dup_texts", *PAIRS, *TEXTS)
def _(t):
    return D.duplicates(t.articles, 0.8, exact=True).select("a", "b", six("jaccard"))


@query("lsh_pairs", "SELECT a, b, round(jaccard, 6) AS jaccard FROM dup WHERE jaccard >= 0.9", *PAIRS)
def _(t):
    return D.duplicates(t.articles, 0.9).select("a", "b", six("jaccard"))


@query("dup_recall")
def _(t):
    sets, _ = D.classes(t.articles)
    exact, found = D.exact_pairs(sets, 0.8), D.lsh_pairs(sets, 0.8)
    hit = exact.join(found, ["a", "b"], "left_semi").agg(F.count("*").alias("hit"))
    return exact.agg(F.count("*").alias("exact")).crossJoin(F.broadcast(hit)).withColumn("recall", F.when(F.col("exact") == 0, 1.0).otherwise(F.col("hit") / F.col("exact")))


# documents in order of worth, each one kept unless a neighbour was; those without neighbours stay
STAY = (*PAIRS,
        "worth AS (SELECT sig.id, sig.s, length(body) * source_authority AS worth FROM sig JOIN articles a ON a.id = sig.id)",
        "best AS (SELECT rep.id AS class, w.id, worth FROM worth w JOIN rep ON rep.s = w.s QUALIFY row_number() OVER (PARTITION BY w.s ORDER BY worth DESC, w.id) = 1)",
        "edge AS (SELECT x.id AS a, y.id AS b FROM (SELECT a, b FROM near WHERE jaccard >= 0.8 UNION ALL SELECT b, a FROM near WHERE jaccard >= 0.8) e JOIN best x ON x.class = e.a JOIN best y ON y.class = e.b)",
        "turn AS (SELECT id, row_number() OVER (ORDER BY max(worth) DESC, id) AS n, list(b) AS nb FROM best JOIN edge ON a = id GROUP BY id)",
        "walk AS (WITH RECURSIVE g(n, kept) AS (SELECT 0::BIGINT, []::VARCHAR[] UNION ALL SELECT turn.n, CASE WHEN list_has_any(kept, nb) THEN kept ELSE list_append(kept, id) END FROM g JOIN turn ON turn.n = g.n + 1) SELECT unnest(kept) AS id FROM g WHERE n = (SELECT count(*) FROM turn))",
        "stay AS (SELECT id FROM best WHERE id NOT IN (SELECT id FROM turn) UNION ALL SELECT id FROM walk)")


@query("lsh_dedup")
def _(t):
    return D.deduplicated(t.articles).select("id")


@query("exact_dedup", "SELECT id FROM stay", *STAY)
def _(t):
    return D.deduplicated(t.articles, exact=True).select("id")


@query("rank_pipeline", "SELECT id, title, round(score, 9) < 0.5 AS below, row_number() OVER (ORDER BY round(score, 9) < 0.5, round(score, 9) DESC, id) AS position, round(score, 6) AS score FROM scored JOIN kept_articles USING (id) WHERE score > 0 ORDER BY position LIMIT 50",
       *STAY, "kept_articles AS (SELECT articles.* FROM articles JOIN stay USING (id))", *[x.replace("articles", "kept_articles") for x in RANK])
def _(t):
    return R.pipeline(t.articles, MODE, AS_OF, exact=True).select("id", "title", "below", F.col("position").cast("long").alias("position"), six("score"))


# ---------------------------------------------------------------- changes of cards and groups


@query("card_save", """SELECT id, title, type, archived, updated_on::VARCHAR AS updated_on, (SELECT string_agg(tag, ',' ORDER BY tag) FROM (SELECT DISTINCT tag FROM nt WHERE nt.card_id = n.id)) AS tags FROM n""",
       "n AS (SELECT id, CASE WHEN seq % 5 = 0 THEN 'changed ' || id ELSE title END AS title, type, archived, CASE WHEN seq % 5 = 0 THEN DATE '2025-01-01' ELSE updated_on END AS updated_on, seq FROM cards UNION ALL SELECT 'new-' || id, 'made', 'memo', false, DATE '2025-01-01', seq FROM cards WHERE seq % 5 = 1)",
       "nt AS (SELECT card_id, tag FROM card_tags WHERE card_id NOT IN (SELECT id FROM cards WHERE seq % 5 = 0) UNION ALL SELECT id, 't1' FROM cards WHERE seq % 5 = 0 UNION ALL SELECT 'new-' || id, 't2' FROM cards WHERE seq % 5 = 1)")
def _(t):
    cards = C.with_tokens(t.cards, t.card_tags)
    was = F.col("seq") % 5
    some = t.cards.where(was <= 1).select(F.when(was == 0, F.col("id")).otherwise(F.concat(F.lit("new-"), "id")).alias("id"), F.when(was == 0, F.concat(F.lit("changed "), "id")).otherwise("made").alias("title"), F.when(was == 1, "text of it").alias("body"), F.array(F.when(was == 0, " t1 ").otherwise("t2")).alias("tags"))
    cards, tags, _ = C.saved(cards, t.card_tags, t.card_links, some, AS_OF)
    of = tags.groupBy(F.col("card_id").alias("id")).agg(F.array_join(F.sort_array(F.collect_set("tag")), ",").alias("tags"))
    return cards.join(of, "id", "left").select("id", "title", "type", "archived", F.col("updated_on").cast("string").alias("updated_on"), "tags")


@query("token_backfill", "SELECT c.id, count(DISTINCT term) AS n_terms FROM c LEFT JOIN (SELECT id, unnest(regexp_extract_all(lower(s), '[\\p{L}\\p{N}_]+')) AS term FROM c) x ON x.id = c.id AND length(term) > 1 GROUP BY c.id",
       "c AS (SELECT id, title || ' ' || body || ' ' || lang_source AS s FROM cards JOIN (SELECT card_id, string_agg(tag, ' ' ORDER BY tag) AS lang_source FROM (SELECT DISTINCT * FROM card_tags) GROUP BY card_id) ON card_id = id)")
def _(t):
    had = C.with_tokens(t.cards, t.card_tags)
    cut = had.withColumn("ngram", F.when(F.col("seq") % 3 == 0, F.col("ngram")).when(F.col("seq") % 3 == 1, F.array().cast("array<string>")))
    return C.tokens_backfilled(cut, t.card_tags).select("id", F.size("ngram").cast("long").alias("n_terms"))


@query("save_as_card", """SELECT r.id, r.card_id, CASE WHEN a.id IS NULL THEN 404 WHEN candidate_status IN ('expired', 'saved') OR saved_card_id IS NOT NULL OR r.card_id LIKE 'z%' THEN 409 ELSE 201 END AS code,
CASE WHEN a.id IS NOT NULL AND candidate_status NOT IN ('expired', 'saved') AND saved_card_id IS NULL AND r.card_id NOT LIKE 'z%' THEN 'saved' ELSE candidate_status END AS status FROM r LEFT JOIN articles a ON a.id = r.id""",
       "r AS (SELECT id, 'n' || id AS card_id FROM articles UNION ALL SELECT id, 'z' || id FROM articles UNION ALL SELECT 'x' || id, 'n' FROM articles)")
def _(t):
    ask = lambda i, c: t.articles.select(i.alias("id"), c.alias("card_id"))
    every = files.union_all([ask(F.col("id"), F.concat(F.lit("n"), "id")), ask(F.col("id"), F.concat(F.lit("z"), "id")), ask(F.concat(F.lit("x"), "id"), F.lit("n"))])
    return L.saved_as_cards(t.articles, every, AS_OF)[1]


@query("index_texts", "SELECT c.id, sha256(title || '|' || body || '|' || coalesce(summary, '') || '|' || coalesce(tags, '')) AS digest FROM cards c LEFT JOIN (SELECT card_id, string_agg(tag, ' ' ORDER BY tag) AS tags FROM (SELECT DISTINCT * FROM card_tags) GROUP BY card_id) t ON t.card_id = c.id")
def _(t):
    return C.index_texts(t.cards, t.card_tags).select("id", F.sha2(F.concat_ws("|", "title", "body", "summary", "tags"), 256).alias("digest"))


@query("health", "SELECT count(*) AS cards FROM cards")
def _(t):
    return C.health(t.cards)


@query("kj_upsert", "SELECT id, CASE WHEN id = 'g4' THEN 'renamed' ELSE name END AS name, color FROM kj_groups UNION ALL SELECT 'own', 'Own', ['#FF6B6B', '#FFD93D', '#6BCB77', '#4D96FF', '#C77DFF', '#FF9A3C', '#00C9A7', '#F72585'][(SELECT count(*) FROM kj_groups) % 8 + 1]")
def _(t):
    return C.group_updated(C.group_created(t.kj_groups, "own", "Own"), "g4", name="renamed").select("id", "name", "color")


# ---------------------------------------------------------------- evaluation

# Each source is a query: its good articles are relevant, and the ranking is the engine's own.
QRELS = (*RANK, "qrels AS (SELECT source AS query_id, id FROM articles WHERE source_authority > 0.5)",
         "rk AS (SELECT source AS query_id, s.id, row_number() OVER (PARTITION BY source ORDER BY round(score, 9) DESC, s.id) AS rank FROM scored s JOIN articles a ON a.id = s.id WHERE score > 0)",
         "nr AS (SELECT query_id, count(*) AS n_rel FROM qrels GROUP BY query_id)",
         "per AS (SELECT nr.query_id, n_rel, max(CASE WHEN rank = 1 THEN 1.0 ELSE 0.0 END)::DOUBLE AS p1, count_if(rank <= n_rel) / n_rel AS r_prec, coalesce(1 / min(rank), 0) AS mrr, count_if(rank <= 5) / n_rel AS recall5, coalesce(sum(CASE WHEN rank <= 5 THEN 1 / log2(rank + 1) END), 0) / list_sum([1 / log2(k + 1) FOR k IN range(1, least(n_rel, 5) + 1)]) AS ndcg5 FROM nr LEFT JOIN (SELECT rk.* FROM rk JOIN qrels USING (query_id, id)) h ON h.query_id = nr.query_id GROUP BY nr.query_id, n_rel)")


def _eval(t):
    from pyspark.sql import Window

    qrels = t.articles.where("source_authority > 0.5").select(F.col("source").alias("query_id"), "id")
    found = R.scored(t.articles, MODE, AS_OF).where("score > 0").join(t.articles.select("id", F.col("source").alias("query_id")), "id")
    ranks = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*R.by("score")))).select("query_id", "id", "rank")
    return ranks, qrels


@query("ir_metrics", "SELECT query_id, round(p1, 6) AS p1, round(r_prec, 6) AS r_prec, round(mrr, 6) AS mrr, round(recall5, 6) AS recall5, round(ndcg5, 6) AS ndcg5 FROM per", *QRELS)
def _(t):
    return E.metrics(*_eval(t)).select("query_id", *[six(c) for c in ("p1", "r_prec", "mrr", "recall5", "ndcg5")])


@query("ir_means", "SELECT count(*) AS n, round(avg(p1), 6) AS p1, round(avg(r_prec), 6) AS r_prec, round(avg(mrr), 6) AS mrr, round(avg(recall5), 6) AS recall5, round(avg(ndcg5), 6) AS ndcg5 FROM per", *QRELS)
def _(t):
    return E.means(E.metrics(*_eval(t))).select("n", *[six(c) for c in ("p1", "r_prec", "mrr", "recall5", "ndcg5")])


@query("ir_upper_bounds", "SELECT count(*) AS n_queries, round(avg(least(1.0, 5 / n_rel)), 6) AS recall5_max FROM nr", *QRELS)
def _(t):
    return E.upper_bounds(_eval(t)[1]).withColumn("recall5_max", F.round("recall5_max", 6))


@query("dataset_quality", """SELECT 'all metrics at their bounds' AS issue, abs(avg(p1) - 1) <= 1e-9 AND abs(avg(r_prec) - 1) <= 1e-9 AND abs(avg(mrr) - 1) <= 1e-9 AND abs(avg(recall5) - (SELECT avg(least(1.0, 5 / n_rel)) FROM nr)) <= 1e-9 AND abs(avg(ndcg5) - 1) <= 1e-9 AS holds FROM per
UNION ALL SELECT 'conflicting duplicate queries', (SELECT count(*) FROM (SELECT lang FROM articles WHERE source_authority > 0.5 GROUP BY lang HAVING count(DISTINCT source) > 1)) > 0 UNION ALL SELECT 'degenerate query language', false
UNION ALL SELECT 'low signal', count_if(recall5 = 0) / count(*) >= 0.75 FROM per""", *QRELS)
def _(t):
    ranks, qrels = _eval(t)
    # what the queries ask: the language of their articles, so that sources ask the same and expect other articles
    cases = t.articles.where("source_authority > 0.5").groupBy("source", F.col("lang").alias("query")).agg(F.collect_list("id").alias("expected")).select("query", "expected")
    return E.discrimination(E.metrics(ranks, qrels), E.upper_bounds(qrels), cases)


@query("metric_bounds", """SELECT metric, round(v, 6) AS value, round(b, 6) AS bound, true AS fine FROM (SELECT unnest(['p1', 'r_prec', 'mrr', 'recall5', 'ndcg5']) AS metric, unnest([avg(p1), avg(r_prec), avg(mrr), avg(recall5), avg(ndcg5)]) AS v, unnest([1.0, 1.0, 1.0, (SELECT avg(least(1.0, 5 / n_rel)) FROM nr), 1.0]) AS b FROM per)""", *QRELS)
def _(t):
    ranks, qrels = _eval(t)
    return E.within_bounds(E.means(E.metrics(ranks, qrels)), E.upper_bounds(qrels)).select("metric", six("value"), six("bound"), "fine")


@query("rank_sensitivity", "SELECT query_id, id, CAST(gap AS BIGINT) AS gap FROM (SELECT source AS query_id, id, length(body) - coalesce(lead(length(body)) OVER w, 0) AS gap, row_number() OVER w AS n FROM articles WINDOW w AS (PARTITION BY source ORDER BY length(body) DESC, id)) WHERE n = 1")
def _(t):
    s = t.articles.select(F.col("source").alias("query_id"), "id", F.length("body").cast("double").alias("score"))
    return E.sensitivity(s).withColumn("gap", F.col("gap").cast("long"))


# ---------------------------------------------------------------- sources and streams

RSS = "<rss><channel><item><title>One &amp; two</title><link>https://a.test/1</link><description><![CDATA[<p>Body  <b>text</b></p>]]></description><pubDate>2024-01-02</pubDate></item><item><title></title></item><item><title>Three</title><guid>g-3</guid><link>https://a.test/3</link></item></channel></rss>"
ATOM = "<feed><entry><id>http://x.test/abs/1</id><title>Paper\n one</title><summary>Sum  one</summary><published>2024-01-01</published><author><name>A B</name></author><author><name>C</name></author></entry></feed>"
REPO = '{"items":[{"id":5,"full_name":"a/b","description":"desc","html_url":"https://g.test/a/b","topics":["x","y"],"stargazers_count":7,"language":"Go","pushed_at":"2024-02-03"}]}'


def _texts(t, text):
    return t.spark.range(1).select(F.lit("Feed").alias("name"), F.lit(text).alias("text"))


@query("rss_normalize", "SELECT * FROM (VALUES ('rss_feed_https___a_test_1', 'One &amp; two', 'Body text', 'https://a.test/1', 'rss:Feed', '2024-01-02'), ('rss_feed_g_3', 'Three', '', 'https://a.test/3', 'rss:Feed', '2025-01-01')) v(id, title, body, url, source, published)")
def _(t):
    return feeds.rss(_texts(t, RSS), AS_OF)


@query("atom_normalize", "SELECT 'arxiv_http___x_test_abs_1' AS id, 'Paper one' AS title, 'Sum one [Authors: A B, C]' AS body, 'http://x.test/abs/1' AS url, 'arxiv:Feed' AS source, '2024-01-01' AS published")
def _(t):
    return feeds.atom(_texts(t, ATOM))


@query("github_normalize", "SELECT 'github_5' AS id, 'a/b' AS title, 'desc Topics: x, y Stars: 7 Language: Go' AS body, 'https://g.test/a/b' AS url, 'github:Feed' AS source, '2024-02-03' AS published")
def _(t):
    return feeds.repositories(_texts(t, REPO))


@query("collect_union", "SELECT * FROM (VALUES ('arxiv:Feed', 1), ('github:Feed', 1), ('rss:Feed', 2)) v(source, n)")
def _(t):
    got = feeds.collected(feeds.rss(_texts(t, RSS), AS_OF), feeds.atom(_texts(t, ATOM)), feeds.repositories(_texts(t, REPO)))
    return got.groupBy("source").agg(F.count("*").cast("int").alias("n"))


@query("csv_import", "SELECT trim(title) AS title, trim(body) AS body, 'csv,import' AS tags FROM cards WHERE trim(title) <> '' AND trim(body) <> ''")
def _(t):
    rows = t.cards.where("trim(title) <> '' and trim(body) <> ''").select("title", F.col("body").alias("Content"), F.lit("csv、 import,csv").alias("TAG"))
    return files.from_columns(rows).select("title", "body", F.array_join("tags", ",").alias("tags"))


@query("json_import", "SELECT * FROM (VALUES ('First', 'text one', 'a,b'), ('Data 2', 'text: \"two\"', ''), ('Solo', 'Solo', '')) v(title, body, tags)")
def _(t):
    text = '{"items":[{"NAME":" First ","content":"text one","tags":["a","b","a"]},{"text":"two"},{"headline":"Solo"}]}'
    return files.from_json(t.spark.range(1).select(F.lit(text).alias("text"))).select("title", "body", F.array_join("tags", ",").alias("tags"))


@query("article_migration", """SELECT id, t AS title, url, source_authority, CASE WHEN doc_id % 5 = 0 THEN '2025-01-01' ELSE published_on::VARCHAR END AS published, CASE WHEN doc_id % 2 = 0 THEN 2 END AS doc_length
FROM (SELECT *, trim(title, chr(32)) AS t FROM articles) WHERE t <> '' AND doc_id % 3 <> 0""")
def _(t):
    # every article as stored JSON, in either spelling, some with a bad date, some without a url
    even, url = F.expr("doc_id % 2 = 0"), F.when(F.expr("doc_id % 3 <> 0"), F.col("url"))
    day = F.when(F.expr("doc_id % 5 = 0"), "soon").otherwise(F.col("published_on").cast("string"))
    old = F.struct("id", "title", url.alias("url"), "source_authority", day.alias("published_at"))
    new = F.struct("id", "title", url.alias("url"), F.col("source_authority").alias("sourceAuthority"), day.alias("publishedAt"), F.array(F.lit("a"), F.lit("b")).alias("tokens"))
    texts = t.articles.select(F.concat(F.lit("["), F.when(even, F.to_json(new)).otherwise(F.to_json(old)), F.lit("]")).alias("text"))
    kept, _ = files.from_stored(texts, AS_OF)
    return kept.select("id", "title", "url", "source_authority", F.col("published_on").cast("string").alias("published"), "doc_length")


@query("stream_upsert", """SELECT id, title, first_seen_on::VARCHAR AS first_seen FROM (SELECT id, title, url, published_on AS first_seen_on, row_number() OVER (PARTITION BY url ORDER BY doc_id) AS n FROM articles) WHERE n = 1""")
def _(t):
    # all articles as a stream into an empty store; a second run of the same stream adds nothing
    import uuid

    base = t.spark.sparkContext.getCheckpointDir() or checkpointed(t.spark.range(1)) and t.spark.sparkContext.getCheckpointDir()
    folder = f"{base}/stream-{uuid.uuid4().hex}"
    columns = ["id", "url", "title", F.col("published_on").alias("created_on"), F.col("published_on").alias("first_seen_on"), "candidate_status", F.col("doc_id").alias("seq")]
    t.articles.select(*columns).write.parquet(f"{folder}/in")
    schema = t.articles.select(*columns).schema
    store = ingest.ArticleStore(t.spark, f"{folder}/store", t.articles.select(*columns[:-1]).schema)
    for _ in range(2):
        ingest.ingest(t.spark.readStream.schema(schema).parquet(f"{folder}/in"), store, f"{folder}/checkpoint").awaitTermination()
    return store.read().select("id", "title", F.col("first_seen_on").cast("string").alias("first_seen"))


@query("schema_check")
def _(t):
    want = {"id": "string", "title": "string", "body": "string", "url": "string", "source": "string", "source_authority": "double"}
    have = dict(t.articles.dtypes)
    return t.spark.createDataFrame([(c, k, have.get(c), have.get(c) == k) for c, k in want.items()], "name string, wanted string, found string, fine boolean")
