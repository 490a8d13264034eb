"""Cards, tags, links and groups: filters, joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def hydrated(cards: DataFrame, tags: DataFrame, links: DataFrame) -> DataFrame:
    """cards with sorted tags and links; sums of relations are made before the join."""
    t = tags.groupBy(F.col("card_id").alias("id")).agg(F.sort_array(F.collect_set("tag")).alias("tags"))
    k = links.groupBy(F.col("source_card_id").alias("id")).agg(F.sort_array(F.collect_set("target_card_id")).alias("links"))
    none = F.array().cast("array<string>")
    return cards.join(t, "id", "left").join(k, "id", "left").withColumns({"tags": F.coalesce("tags", none), "links": F.coalesce("links", none)})


def filtered(cards: DataFrame, tags: DataFrame, archived=None, type_=None, group=None, tag=None, q=None) -> DataFrame:
    """All given conditions hold; q is a literal substring of title, body, summary or a tag, whatever its case."""
    if archived is not None:
        cards = cards.where(F.col("archived") == archived)
    if type_ is not None:
        cards = cards.where(F.col("type") == type_)
    if group is not None:
        cards = cards.where(F.col("kj_group_id") == group)
    if tag is not None:
        cards = by_tag(cards, tags, tag)
    needle = (q or "").strip().lower()
    if needle:
        hit = tags.where(F.contains(F.lower("tag"), F.lit(needle))).select(F.col("card_id").alias("id")).distinct().withColumn("_tag", F.lit(True))
        text = F.lit(False)
        for c in ("title", "body", "summary"):
            text = text | F.coalesce(F.contains(F.lower(c), F.lit(needle)), F.lit(False))
        cards = cards.join(hit, "id", "left").where(text | F.col("_tag").isNotNull()).drop("_tag")
    return cards


def by_tag(cards: DataFrame, tags: DataFrame, tag: str) -> DataFrame:
    return cards.join(tags.where(F.col("tag") == tag), cards.id == F.col("card_id"), "left_semi")


def page(cards: DataFrame, limit: int, offset: int, newest_first: bool = True) -> DataFrame:
    """One page in order of creation, ties by id, with the total of all."""
    order = [F.desc("created_on") if newest_first else F.asc("created_on"), F.asc("id")]
    return cards.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(cards.agg(F.count("*").alias("total"))))  # one row


def backlinks(cards: DataFrame, links: DataFrame, id_: str) -> DataFrame:
    hits = links.where((F.col("target_card_id") == id_) & (F.col("source_card_id") != id_))
    return cards.join(hits, cards.id == F.col("source_card_id"), "left_semi")


def outgoing(links: DataFrame, id_: str) -> DataFrame:
    return links.where(F.col("source_card_id") == id_).select("target_card_id").distinct().orderBy("target_card_id")


def board(groups: DataFrame, cards: DataFrame) -> DataFrame:
    """Groups with their number of cards and first card; cards of no known group stand under null."""
    own = cards.groupBy("kj_group_id").agg(F.count("*").alias("n"), F.min("id").alias("first_card"))
    known = groups.select(F.col("id").alias("kj_group_id"), "name", F.coalesce("color", F.lit(T.DEFAULT_GROUP_COLOR)).alias("color"))
    grouped = known.join(own, "kj_group_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rest = own.join(known, "kj_group_id", "left_anti").agg(F.sum("n").alias("n"), F.min("first_card").alias("first_card"))
    none = F.lit(None).cast("string")
    return grouped.unionByName(rest.select(none.alias("kj_group_id"), none.alias("name"), none.alias("color"), F.coalesce("n", F.lit(0)).alias("n"), "first_card"))


def tag_counts(tags: DataFrame) -> DataFrame:
    return tags.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag")


def graph_nodes(cards: DataFrame, links: DataFrame) -> DataFrame:
    """Cards that a link between two known cards touches, with label and title."""
    known = links.join(cards.select(F.col("id").alias("source_card_id")), "source_card_id", "left_semi").join(cards.select(F.col("id").alias("target_card_id")), "target_card_id", "left_semi")
    ids = known.select(F.col("source_card_id").alias("id")).union(known.select("target_card_id")).distinct()
    return cards.join(ids, "id", "left_semi").select("id", F.substring("title", 1, 40).alias("label"), F.coalesce("summary", F.substring("body", 1, 100)).alias("hover"))


def link_candidates(cards: DataFrame, tags: DataFrame, links: DataFrame, id_: str, q: str, most: int = 8) -> DataFrame:
    """Cards to link with: the needle is in the title or a tag; not the card itself, and not linked yet."""
    needle = q.strip().lower()
    tagged = tags.where(F.contains(F.lower("tag"), F.lit(needle))).select(F.col("card_id").alias("id")).distinct().withColumn("_t", F.lit(True))
    hits = cards.join(tagged, "id", "left").where((F.contains(F.lower("title"), F.lit(needle)) | F.col("_t").isNotNull()) & (F.col("id") != id_)).drop("_t")
    had = links.where(F.col("source_card_id") == id_).select(F.col("target_card_id").alias("id"))
    return hits.join(had, "id", "left_anti").orderBy("id").limit(most)


def palette(groups: DataFrame) -> DataFrame:
    """A colour for each group by its place in order of creation; groups are few."""
    at = (F.row_number().over(Window.orderBy("seq")) - 1) % len(T.PALETTE)
    return groups.withColumn("color", F.get(F.array(*map(F.lit, T.PALETTE)), at))


def markdown(cards: DataFrame) -> DataFrame:
    """hydrated cards as Markdown texts."""
    some = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    line = lambda name, c: F.when(some(F.col(c).cast("string")).isNotNull(), F.concat(F.lit(f"- {name}: "), F.col(c).cast("string")))
    tags = F.concat(F.lit("- Tags: "), F.when(F.size("tags") > 0, F.array_join("tags", ", ")).otherwise("none"))
    parts = [
        F.concat(F.lit("# "), "title"), F.lit(""), F.col("body"), F.lit(""), F.lit("---"), F.lit(""),
        F.when(some(F.col("summary")).isNotNull(), F.concat(F.lit("## Summary\n\n"), "summary", F.lit("\n"))),
        F.lit("## Metadata"), F.lit(""), line("ID", "id"), line("Type", "type"), tags, line("URL", "url"), line("Created", "created_on"), line("Updated", "updated_on"), F.lit(""),
        F.when(F.size("links") > 0, F.concat(F.lit("## Links\n\n"), F.array_join(F.transform("links", lambda x: F.concat(F.lit("- "), x)), "\n"), F.lit("\n"))),
    ]
    return cards.select("id", F.concat(F.regexp_replace(F.concat_ws("\n", *parts), r"\s+$", ""), F.lit("\n")).alias("markdown"))


def distinct_filenames(cards: DataFrame) -> DataFrame:
    """Safe file names; the second of a name gets -2, and so on in order."""
    named = cards.withColumn("base", T.safe_filename(F.col("title"), F.col("id")))
    at = F.row_number().over(Window.partitionBy("base").orderBy("seq"))
    return named.withColumn("filename", F.concat("base", F.when(at > 1, F.concat(F.lit("-"), at.cast("string"))).otherwise(""), F.lit(".md")))


# ---------------------------------------------------------------- changes


def deleted(cards: DataFrame, tags: DataFrame, links: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is left of cards, tags and links without ids (id); links go at either end."""
    return (
        cards.join(ids, "id", "left_anti"),
        tags.join(ids.select(F.col("id").alias("card_id")), "card_id", "left_anti"),
        links.join(ids.select(F.col("id").alias("source_card_id")), "source_card_id", "left_anti").join(ids.select(F.col("id").alias("target_card_id")), "target_card_id", "left_anti"),
    )


def archived(cards: DataFrame, ids: DataFrame, to: bool = True) -> DataFrame:
    """cards with the flag set for ids, and whether that changed it."""
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    df = cards.join(hit, "id", "left").withColumn("_hit", F.col("_hit").isNotNull())
    return df.withColumn("changed", F.col("_hit") & (F.col("archived") != to)).withColumn("archived", F.when(F.col("_hit"), to).otherwise(F.col("archived"))).drop("_hit")


def linked(links: DataFrame, new: DataFrame) -> DataFrame:
    """links and new ones; no card links itself, and nothing twice."""
    return links.unionByName(new).where("source_card_id <> target_card_id").distinct()


def unlinked(links: DataFrame, gone: DataFrame) -> DataFrame:
    return links.join(gone, ["source_card_id", "target_card_id"], "left_anti")


def group_deleted(cards: DataFrame, group: str) -> DataFrame:
    return cards.withColumn("kj_group_id", F.when(F.col("kj_group_id") != group, F.col("kj_group_id")))


def group_assigned(cards: DataFrame, ids: DataFrame, group: str) -> DataFrame:
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    return cards.join(hit, "id", "left").withColumn("kj_group_id", F.when(F.col("_hit"), group).otherwise(F.col("kj_group_id"))).drop("_hit")


def orphans_removed(tags: DataFrame, links: DataFrame, cards: DataFrame) -> tuple[DataFrame, DataFrame]:
    ids = cards.select("id")
    return (
        tags.join(ids, tags.card_id == ids.id, "left_semi"),
        links.join(ids.select(F.col("id").alias("source_card_id")), "source_card_id", "left_semi").join(ids.select(F.col("id").alias("target_card_id")), "target_card_id", "left_semi"),
    )


def backfilled(rows: DataFrame, column: str = "tags_json") -> DataFrame:
    """Relations (id, value) from JSON arrays."""
    return rows.select("id", F.explode(T.clean_tags(T.json_strings(F.col(column)))).alias("value")).distinct()


def with_tokens(cards: DataFrame, tags: DataFrame) -> DataFrame:
    """cards with morph and ngram, the stored tokens of title, body and tags."""
    t = tags.groupBy(F.col("card_id").alias("id")).agg(F.array_join(F.sort_array(F.collect_set("tag")), " ").alias("_tags"))
    morph, ngram = T.stored_tokens(F.concat_ws(" ", "title", "body", F.coalesce("_tags", F.lit(""))))
    return cards.join(t, "id", "left").withColumns({"morph": morph, "ngram": ngram}).drop("_tags")


def saved(cards: DataFrame, tags: DataFrame, links: DataFrame, changes: DataFrame, now: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """cards (with morph and ngram), tags and links after creating and updating cards.

    changes hold id and any of the cards' columns, and tags and links as arrays of strings. A null leaves an updated card's field
    (or its tags or links) as it is; a new card is a memo, not archived, made now. Changed cards are tokenised anew,
    their relations replaced; other rows are untouched.
    """
    fields = [c for c in cards.columns if c in changes.columns and c != "id"]
    base = [c for c in cards.columns if c not in ("morph", "ngram")]
    new = changes.select("id", *[F.col(c).alias(f"_{c}") for c in fields], F.lit(True).alias("_new"))
    date = F.lit(now).cast("date")
    default = {"type": F.lit("memo"), "archived": F.lit(False), "created_on": date}
    touched = cards.select(*base, F.lit(True).alias("_old")).join(new, "id", "full_outer").where("_new")
    value = lambda c: F.coalesce(*([F.col(f"_{c}")] if c in fields else []), F.col(c), *([default[c]] if c in default else []))
    out = touched.select(*[date.alias(c) if c == "updated_on" else F.col("id") if c == "id" else value(c).alias(c) for c in base])

    def relations(table, own, other, column):
        given = changes.where(F.col(column).isNotNull()).select(F.col("id").alias(own), F.explode_outer(T.clean_tags(F.col(column))).alias(other)) if column in changes.columns else None
        if given is None:
            return table
        return table.join(given.select(own), own, "left_anti").select(own, other).unionByName(given.where(F.col(other).isNotNull()))

    tags = relations(tags, "card_id", "tag", "tags")
    links = relations(links, "source_card_id", "target_card_id", "links").where("source_card_id <> target_card_id")
    out = with_tokens(out, tags.join(out.select(F.col("id").alias("card_id")), "card_id", "left_semi"))
    rest = cards.join(changes.select("id"), "id", "left_anti")
    return rest.unionByName(out.select(*cards.columns)), tags, links


def tokens_backfilled(cards: DataFrame, tags: DataFrame) -> DataFrame:
    """cards whose ngram is null or empty are tokenised; the others stay as they are."""
    lacking = F.col("ngram").isNull() | (F.size("ngram") == 0)
    return cards.where(~lacking).unionByName(with_tokens(cards.where(lacking).drop("morph", "ngram"), tags).select(*cards.columns))


def index_texts(cards: DataFrame, tags: DataFrame) -> DataFrame:
    """id, title, body, summary and tags (sorted, joined by a space) as a full-text index holds them."""
    t = tags.groupBy(F.col("card_id").alias("id")).agg(F.array_join(F.sort_array(F.collect_set("tag")), " ").alias("tags"))
    some = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return cards.join(t, "id", "left").select("id", "title", "body", some("summary"), some("tags"))


def health(cards: DataFrame) -> DataFrame:
    return cards.agg(F.count("*").alias("cards"))


def group_created(groups: DataFrame, id_: str, name: str, color: str | None = None) -> DataFrame:
    """groups and a new one; without a colour it takes the palette's by the number of groups."""
    n = groups.agg(F.count("*").alias("n"), F.max("seq").alias("last"))
    chosen = F.lit(color) if color else F.get(F.array(*map(F.lit, T.PALETTE)), (F.col("n") % len(T.PALETTE)).cast("int"))
    new = n.select(F.lit(id_).alias("id"), F.lit(name).alias("name"), chosen.alias("color"), (F.coalesce("last", F.lit(-1)) + 1).cast("long").alias("seq"))
    return groups.select("id", "name", "color", "seq").unionByName(new)


def group_updated(groups: DataFrame, id_: str, **fields: str) -> DataFrame:
    """groups with some fields of one replaced; an unknown id changes nothing."""
    return groups.withColumns({c: F.when(F.col("id") == id_, F.lit(v)).otherwise(F.col(c)) for c, v in fields.items()})
