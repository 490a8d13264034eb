"""Cards from CSV and JSON files, and out of them again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

# Names that a column of a CSV file, or a key of a JSON object, may have, the first that is there first.
ALIASES = {
    "title": ["title", "タイトル", "name"],
    "body": ["body", "content", "description", "本文", "テキスト", "text"],
    "url": ["url", "link", "リンク"],
    "tags": ["tags", "tag", "タグ", "categories", "keywords"],
}
JSON_ALIASES = {
    "title": ["title", "タイトル", "name", "headline", "subject"],
    "body": ["body", "content", "description", "text", "abstract", "summary", "本文", "テキスト"],
    "summary": ["summary", "abstract", "要約"],
    "url": ["url", "link", "href", "リンク"],
    "tags": ["tags", "tag", "categories", "category", "keywords", "labels", "タグ", "ラベル"],
}
WRAPPERS = ["cards", "articles", "items", "data", "results", "records", "entries"]


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Cards (title, body, tags, url) of a CSV file with a header."""
    return from_columns(spark.read.csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=True))


def from_columns(rows: DataFrame) -> DataFrame:
    """Cards of named columns; without a title it is "Row n", by the place; an empty body takes the other columns."""
    by = {c.strip().lower(): c for c in reversed(rows.columns)}
    chosen = {field: next((by[a] for a in names if a in by), None) for field, names in ALIASES.items()}
    text = lambda c: F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) if c else F.lit("")
    others = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in rows.columns if c not in (chosen["title"], chosen["url"], chosen["tags"])]
    rest = F.trim(F.concat_ws(" ", *others)) if others else F.lit("")
    title = F.coalesce(F.nullif(text(chosen["title"]), F.lit("")), F.concat(F.lit("Row "), (F.monotonically_increasing_id() + 1).cast("string")))
    tags = T.clean_tags(F.split(text(chosen["tags"]), r"[,、，\s]+"))
    return rows.select(title.alias("title"), F.coalesce(F.nullif(text(chosen["body"]), F.lit("")), rest).alias("body"), tags.alias("tags"), F.nullif(text(chosen["url"]), F.lit("")).alias("url"))


def from_json(texts: DataFrame) -> DataFrame:
    """Cards of JSON documents (text): an array, an object that wraps one, or a single object.

    Keys are told whatever their case. An object without a title becomes "Data n" by its place, and its body lists all
    its keys; an empty body takes the title; a summary that equals the body is none. What is no JSON gives no cards.
    """
    kind = "array<map<string,string>>"
    root = F.when(F.trim("text").startswith("["), F.from_json("text", kind))
    wrapped = F.coalesce(*[F.from_json(F.get_json_object("text", f"$.{w}"), kind) for w in WRAPPERS])
    single = F.when(F.trim("text").startswith("{"), F.array(F.from_json("text", "map<string,string>")))
    df = texts.select(F.posexplode(F.coalesce(root, wrapped, single)).alias("at", "m")).where("m is not null").withColumn("e", F.map_entries("m"))

    def first(alias):
        return F.get(F.filter("e", lambda x: (F.lower(x["key"]) == alias) & x["value"].isNotNull()), F.lit(0))["value"]

    def pick(field):
        return F.trim(F.coalesce(*map(first, JSON_ALIASES[field]), F.lit("")))

    # a map holds texts without their quotes: what doesn't look like another kind of value gets them back
    value = lambda v: F.when(v.rlike(r"^(-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?|true|false|\[.*|\{.*)$"), v).otherwise(F.concat(F.lit('"'), v, F.lit('"')))
    listed = F.array_join(F.transform("e", lambda x: F.concat(x["key"], F.lit(": "), F.coalesce(value(x["value"]), F.lit("null")))), "\n")
    df = df.select("at", *[pick(f).alias(f) for f in JSON_ALIASES], listed.alias("listed"))
    tags = F.when(F.col("tags").startswith("["), T.json_strings(F.col("tags"))).otherwise(F.split("tags", r"[,、，\s]+"))
    none = F.col("title") == ""
    body = F.when(none, F.col("listed")).when(F.col("body") == "", F.col("title")).otherwise(F.col("body"))
    summary = F.when(~none & (F.col("summary") != "") & (F.col("summary") != F.col("body")), F.col("summary"))
    some = F.when(none, F.array().cast("array<string>")).otherwise(T.clean_tags(tags))
    return df.select(F.when(none, F.concat(F.lit("Data "), (F.col("at") + 1).cast("string"))).otherwise(F.col("title")).alias("title"), body.alias("body"), some.alias("tags"), F.when(~none, F.nullif("url", F.lit(""))).alias("url"), summary.alias("summary"))


# Fields of a stored article, each with its two spellings.
STORED = "id string, title string, body string, url string, source string, sourceAuthority double, source_authority double, publishedAt string, published_at string, summary string, tags array<string>, tokens array<string>, docLength long, doc_length long"


def read_articles(spark: SparkSession, path: str, now: str) -> tuple[DataFrame, DataFrame]:
    """Articles of JSON array files, and what they reject (text); see from_stored."""
    return from_stored(spark.read.text(path, wholetext=True).withColumnRenamed("value", "text"), now)


def from_stored(texts: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """Articles of JSON texts (text), each an array of articles, and the entries without id, title or url as JSON.

    Names have either spelling. Without an authority it is 0, a bad date becomes now, and without a length it is the
    number of tokens. A text that is no array gives nothing.
    """
    entries = texts.select(F.explode(F.from_json("text", "array<string>")).alias("text"))
    one = entries.select("text", F.from_json("text", STORED).alias("a"))
    given = lambda c: F.trim(F.coalesce(F.col(f"a.{c}"), F.lit("")))
    fine = (given("id") != "") & (given("title") != "") & (given("url") != "")
    authority = F.coalesce("a.sourceAuthority", "a.source_authority", F.lit(0.0))
    published = F.coalesce(F.try_to_timestamp(F.coalesce("a.publishedAt", "a.published_at")).cast("date"), F.lit(now).cast("date"))
    length = F.coalesce("a.docLength", "a.doc_length", F.when(F.col("a.tokens").isNotNull(), F.size("a.tokens").cast("long")))
    kept = one.where(fine).select(given("id").alias("id"), given("title").alias("title"), F.coalesce("a.body", F.lit("")).alias("body"), given("url").alias("url"), "a.source", authority.alias("source_authority"), published.alias("published_on"), "a.summary", "a.tags", "a.tokens", length.alias("doc_length"))
    return kept, one.where(~F.coalesce(fine, F.lit(False))).select("text")


def imported(cards: DataFrame, articles: DataFrame) -> DataFrame:
    """Cards for the articles that have none: by id card_from_<id>, or by a url in use."""
    new = articles.select(F.concat(F.lit("card_from_"), "id").alias("id"), "title", "body", F.nullif("url", F.lit("")).alias("url"))
    return new.join(cards.select("id"), "id", "left_anti").join(cards.where("url <> ''").select("url").distinct(), "url", "left_anti").select("id", "title", "body", "url")


def merged(cards: DataFrame, old: DataFrame, old_tags: DataFrame, old_links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cards of an older store that are new by id and url, their tags, and their links to cards that there are."""
    new = old.join(cards.select("id"), "id", "left_anti").join(cards.where("url <> ''").select("url").distinct(), "url", "left_anti")
    ids = new.select("id")
    every = cards.select("id").union(ids).distinct()
    tags = old_tags.join(ids, old_tags.card_id == ids.id, "left_semi")
    links = old_links.join(ids, old_links.source_card_id == ids.id, "left_semi").join(every.select(F.col("id").alias("target_card_id")), "target_card_id", "left_semi")
    return new, tags, links


def export_json(path: str, **frames: DataFrame) -> None:
    """Each frame as JSON lines in a folder of its name."""
    for name, df in frames.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
