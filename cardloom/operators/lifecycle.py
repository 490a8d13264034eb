"""Articles and candidates: upserts, transitions, retention and jobs. Time is always a parameter."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans import query as Q

KEPT = ["created_on", "first_seen_on", "candidate_status", "reviewed_on", "saved_on", "expired_on", "saved_card_id", "candidate_score", "candidate_match_reason"]


def upserted(stored: DataFrame, incoming: DataFrame, order: str = "seq") -> DataFrame:
    """stored after incoming rows, with ``action`` (kept, inserted, updated).

    The first row of a url and of an id wins; one whose url belongs to another stored id is left out. An update takes
    all columns but those of KEPT.
    """
    first = lambda df, key: df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")
    new = first(first(incoming, "url"), "id")
    owner = stored.select(F.col("url"), F.col("id").alias("_owner"))
    new = new.join(owner, (new.url == owner.url) & (new.id != owner["_owner"]), "left_anti").drop(order)
    s, n = stored.alias("s"), new.alias("n")
    both = s.join(n, F.col("s.id") == F.col("n.id"), "full_outer")
    there, came = F.col("s.id").isNotNull(), F.col("n.id").isNotNull()
    cols = [F.when(there & ~came | (there & F.lit(c in KEPT)), F.col(f"s.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in stored.columns]
    return both.select(*cols, F.when(~there, "inserted").when(came, "updated").otherwise("kept").alias("action"))


def cached_tokens(articles: DataFrame, cache: DataFrame) -> DataFrame:
    """id and hit: whether a cached row of the same id, else of the same url, has the same content hash."""
    a = articles.select("id", "url", T.content_hash(F.col("title"), F.col("body")).alias("hash"))
    c = cache.select(F.col("id").alias("c_id"), F.col("url").alias("c_url"), "content_hash")
    by_id = a.join(c, a.id == c.c_id).select("id", "hash", "content_hash", F.lit(0).alias("way"), "c_id")
    by_url = a.join(c, (a.url == c.c_url) & (a.id != c.c_id)).select("id", "hash", "content_hash", F.lit(1).alias("way"), "c_id")
    best = by_id.unionByName(by_url).groupBy("id").agg(F.min_by(F.col("hash") == F.col("content_hash"), F.struct("way", "c_id")).alias("hit"))
    return a.select("id").join(best, "id", "left").select("id", F.coalesce("hit", F.lit(False)).alias("hit"))


def transitioned(candidates: DataFrame, events: DataFrame) -> DataFrame:
    """candidates after one event each (id, event: review, save or expire).

    Review acts on unreviewed ones only, save on unreviewed and reviewed ones without a saved card, expire on all but
    saved ones.
    """
    df = candidates.join(events, "id", "left")
    s, e = F.col("candidate_status"), F.col("event")
    to = (
        F.when((e == "review") & (s == "unreviewed"), "reviewed")
        .when((e == "save") & s.isin("unreviewed", "reviewed") & F.col("saved_card_id").isNull(), "saved")
        .when((e == "expire") & (s != "saved"), "expired")
        .otherwise(s)
    )
    return df.withColumn("to_status", to)


def saved_as_cards(articles: DataFrame, wanted: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """Cards of the wanted candidates (id, card_id), and what became of each request (id, code, status).

    An unknown id gives 404; one that is expired or saved already, and all requests for an id but that of the smallest
    card_id, give 409 and no card; the others give 201, a card of type article, and the state saved with that card.
    """
    state = articles.select("id", F.col("candidate_status").alias("_s"), F.col("saved_card_id").alias("_c"))
    first = F.row_number().over(Window.partitionBy("id").orderBy("card_id"))
    asked = wanted.withColumn("_n", first).join(state, "id", "left")
    code = F.when(F.col("_s").isNull(), 404).when((F.col("_s").isin("expired", "saved")) | F.col("_c").isNotNull() | (F.col("_n") > 1), 409).otherwise(201)
    asked = asked.withColumn("code", code)
    date = F.lit(now).cast("date")
    new = articles.join(asked.where("code = 201").select("id", "card_id"), "id").select(F.col("card_id").alias("id"), "title", "body", F.nullif("url", F.lit("")).alias("url"), F.lit("article").alias("type"), date.alias("created_on"), F.col("id").alias("candidate_id"))
    return new, asked.select("id", "card_id", "code", F.when(F.col("code") == 201, "saved").otherwise(F.col("_s")).alias("status"))


def retention(candidates: DataFrame, as_of: str, days: int) -> DataFrame:
    """Reviewed candidates that are older than ``days`` become expired."""
    old = (F.col("candidate_status") == "reviewed") & (F.coalesce("reviewed_on", "updated_on") < F.date_sub(F.lit(as_of).cast("date"), days))
    return candidates.withColumn("candidate_status", F.when(old, "expired").otherwise(F.col("candidate_status")))


def candidate_view(articles: DataFrame) -> DataFrame:
    return articles.select("id", "candidate_status", F.coalesce("first_seen_on", "updated_on").alias("first_seen"), F.coalesce("last_fetched_on", "updated_on").alias("last_seen"), F.size(T.json_strings(F.col("tags_json"))).cast("long").alias("n_tags"))


def recovered(jobs: DataFrame) -> DataFrame:
    """Jobs that were under way have failed."""
    return jobs.withColumn("status", F.when(F.col("status").isin("queued", "running"), "failed").otherwise(F.col("status")))


def job(jobs: DataFrame, id_: str) -> DataFrame:
    return jobs.where(F.col("id") == id_)


def last_states(log: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    return log.groupBy(key).agg(F.max_by("status", order).alias("status"), F.max(order).alias("seq"))


def article_stats(articles: DataFrame) -> DataFrame:
    """Counts by source with those of sources below it (s:...), the total and the last update."""
    by = articles.groupBy("source").agg(F.count("*").alias("n"), F.max("updated_on").alias("last"))
    up = by.select(F.substring_index("source", ":", 1).alias("source"), "n", "last").groupBy("source").agg(F.sum("n").alias("rolled"), F.max("last").alias("last"))
    total = articles.agg(F.count("*").alias("total"))
    return up.join(by.select("source", "n"), "source", "left").crossJoin(F.broadcast(total)).select("source", F.coalesce("n", F.lit(0)).alias("n"), "rolled", "total", F.col("last").cast("string").alias("last"))


def written_back(articles: DataFrame, results: DataFrame) -> DataFrame:
    """Scores and reasons of active results go to their articles; others keep theirs."""
    return articles.join(results.select("id", F.col("score").alias("_s"), F.col("reason").alias("_r")), "id", "left").withColumns({"candidate_score": F.coalesce("_s", "candidate_score"), "candidate_match_reason": F.coalesce("_r", "candidate_match_reason")}).drop("_s", "_r")


def overlaid(request: DataFrame, stored: DataFrame, columns: list[str]) -> DataFrame:
    """Request rows; a stored row's field wins."""
    s = stored.select("id", *[F.col(c).alias(f"_{c}") for c in columns])
    return request.join(s, "id", "left").withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*[f"_{c}" for c in columns])


def without(articles: DataFrame, terms: list[str]) -> DataFrame:
    """articles (with ngram) that hold none of the excluded terms.

    A term counts if it is a stored token, or, of ASCII letters, digits and underscores, if it stands as a word in title
    or body. Nulls hold nothing.
    """
    text = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("body", F.lit(""))))
    hit = F.lit(False)
    for term in filter(None, map(Q.norm, terms)):
        hit = hit | F.coalesce(F.array_contains("ngram", term), F.lit(False))
        if re.fullmatch("[a-z0-9_]+", term):
            hit = hit | text.rlike(rf"(^|[^\p{{L}}\p{{N}}_]){term}($|[^\p{{L}}\p{{N}}_])")
    return articles.where(~hit)


def match_meta(articles: DataFrame, keywords: list[str], matched_terms: list[str] = ()) -> DataFrame:
    """articles with fields and words: which of title, body, summary and tags hold a keyword, and which keywords they hold.

    Texts and keywords are compared in NFKC and lower case. Without a hit, words are the matched terms. A column that
    is missing, or a null, holds nothing; tags may be an array or a text.
    """
    types = dict(articles.dtypes)

    def text(c):
        if c not in types:
            return F.lit("")
        value = F.array_join(c, " ") if types[c].startswith("array") else F.col(c)
        return F.coalesce(T.normalize(value), F.lit(""))

    names = ("title", "body", "summary", "tags")
    df = articles.withColumns({f"_{c}": text(c) for c in names})
    has = lambda c, w: F.contains(F.col(f"_{c}"), F.lit(Q.norm(w)))
    some = lambda conds: reduce(lambda a, b: a | b, conds, F.lit(False))
    fields = F.array_compact(F.array(*[F.when(some([has(c, w) for w in keywords]), c) for c in names]))
    words = F.array_compact(F.array(*[F.when(some([has(c, w) for c in names]), w) for w in keywords])) if keywords else F.array().cast("array<string>")
    terms = F.array(*map(F.lit, dict.fromkeys(t.strip() for t in matched_terms if t.strip()))).cast("array<string>")
    return df.withColumn("fields", fields).withColumn("words", words).withColumn("words", F.when(F.size("words") > 0, F.col("words")).otherwise(terms)).drop(*[f"_{c}" for c in names])


# What a reason says where nothing matched, and the word before its keywords.
NO_FIELD, NO_KEYWORD, KEYWORDS = "本文一致", "キーワード一致", "キーワード: "


def match_reason(fields: Column, words: Column) -> Column:
    """fields / keywords, each with its own text where there is none."""
    left = F.when(F.size(fields) > 0, F.array_join(fields, ", ")).otherwise(NO_FIELD)
    right = F.when(F.size(words) > 0, F.concat(F.lit(KEYWORDS), F.array_join(words, ", "))).otherwise(NO_KEYWORD)
    return F.concat(left, F.lit(" / "), right)


def public_view(articles: DataFrame) -> DataFrame:
    """articles without tokens, and with the defaults of a result: tags, type, creation date, archived."""
    have = articles.columns
    default = {"summary": F.lit(None).cast("string"), "tags": F.array().cast("array<string>"), "type": F.lit("article"), "created_on": F.col("published_on"), "archived": F.lit(False)}
    return articles.drop("morph", "ngram", "content_hash").withColumns({c: F.coalesce(F.col(c), d) if c in have else d for c, d in default.items()})


# Limits of an input row.
LIMITS = {"title": 200, "body": 20000}


def validated(rows: DataFrame) -> DataFrame:
    """rows with url and group cleaned, and the first reason against each (null: fine)."""
    reason = (
        F.when(F.trim(F.coalesce("title", F.lit(""))) == "", "title is empty")
        .when(F.length("title") > LIMITS["title"], "title is too long")
        .when(F.length("body") > LIMITS["body"], "body is too long")
        .when((F.col("source_authority") < 0) | (F.col("source_authority") > 1), "authority is out of range")
    )
    return rows.withColumn("url", F.nullif("url", F.lit(""))).withColumn("reason", reason)


def repaired(raw: DataFrame, now: str) -> DataFrame:
    """Articles from rows with either spelling of names; id, title and url are needed, a bad date becomes now."""
    df = raw.select("id", "title", "url", F.coalesce("published_at", "publishedAt").alias("_at"))
    fine = F.col("id").isNotNull() & F.col("title").isNotNull() & F.col("url").isNotNull()
    return df.withColumn("valid", fine).withColumn("published", F.coalesce(F.try_to_timestamp("_at").cast("date"), F.lit(now).cast("date"))).drop("_at")
