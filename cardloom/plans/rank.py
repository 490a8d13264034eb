"""Two-signal BM25 ranking as one DataFrame plan.

Only the query's terms are counted in each document, as row expressions; the counts are written as a slim table without
texts, and corpus statistics are one aggregated row. So a ranking scans the tokens once, shuffles partial aggregates and
the top rows, and fetches the texts of the top rows alone. Orders are by scores rounded to PLACES decimals, then by id,
so that the last digits of sums decide nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.dedup import repeated
from ..session import checkpointed
from . import query as Q

WINDOW, PLACES = 50, 9


def _total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns) if columns else F.lit(0.0)


def tokenised(articles: DataFrame) -> DataFrame:
    """articles with morph and ngram token arrays."""
    morph, ngram = T.stored_tokens(F.concat_ws(" ", "title", "body"))
    return articles.withColumns({"morph": morph, "ngram": ngram})


def counted(tokens: DataFrame, mode: Q.Mode) -> DataFrame:
    """Each document's lengths, and its counts and n-gram places of the query's terms after synonyms."""
    synonyms = Q.synonym_map(mode.keywords)
    asked = [synonyms.get(t, t) for t in Q.query_tokens(mode.keywords)]
    terms = list(dict.fromkeys(asked))
    spelled = {t: t for t in terms} | {s: c for s, c in synonyms.items() if c in terms}
    for s in synonyms:  # a term that is a synonym of another is never itself
        if synonyms[s] != s:
            spelled[s] = synonyms[s]
    to = F.create_map(*[F.lit(x) for kv in spelled.items() for x in kv])
    listed = F.array(*[F.lit(t) for t in spelled])
    hits = F.filter(F.transform("ngram", lambda t, i: F.struct(i.alias("i"), t.alias("t"))), lambda x: F.array_contains(listed, x["t"]))
    out = {
        "morph_len": F.size("morph"),
        "ngram_len": F.size("ngram"),
        "hits": F.transform(hits, lambda x: F.struct(x["i"].alias("i"), to[x["t"]].alias("t"))),
        "mhits": F.transform(F.filter("morph", lambda t: F.array_contains(listed, t)), lambda t: to[t]),
    }
    df = tokens.withColumns(out).drop("morph", "ngram")
    for k, t in enumerate(terms):
        df = df.withColumn(f"n{k}", F.size(F.filter("hits", lambda x: x["t"] == t))).withColumn(f"m{k}", F.size(F.filter("mhits", lambda x: x == t)))
    return df


def cooccurrence() -> Column:
    """The most different query terms in WINDOW tokens; windows that start at a hit suffice."""
    return F.coalesce(F.array_max(F.transform("hits", lambda x: F.size(F.array_distinct(F.transform(F.filter("hits", lambda y: (y["i"] >= x["i"]) & (y["i"] < x["i"] + WINDOW)), lambda y: y["t"]))))), F.lit(0))


def scored(docs: DataFrame, mode: Q.Mode, as_of: str, floor: float = 0.35, gone: DataFrame | None = None) -> DataFrame:
    """id, published_on, score and its parts of docs (id, title, body, published_on); without a hit the score is 0.

    docs may hold morph and ngram already (see index()); then no text is read. No keywords give no rows. The ids in gone
    are left out as soon as their terms are counted, before the statistics, so that no text is sent to be left out.
    """
    if not Q.query_tokens(mode.keywords):
        return docs.limit(0).select("id", "published_on", *[F.lit(0.0).alias(c) for c in PARTS])
    synonyms = Q.synonym_map(mode.keywords)
    asked = [synonyms.get(t, t) for t in Q.query_tokens(mode.keywords)]
    terms = list(dict.fromkeys(asked))
    tokens = docs if "ngram" in docs.columns else tokenised(docs)
    base = counted(tokens.select("id", "published_on", "morph", "ngram"), mode)
    base = checkpointed(base if gone is None else base.join(gone, "id", "left_anti"))
    stats = base.agg(
        F.count("*").alias("N"),
        F.coalesce(F.avg("ngram_len"), F.lit(500.0)).alias("navg"),
        F.greatest(F.coalesce(F.avg("morph_len"), F.lit(500.0)), F.lit(1.0)).alias("mavg"),
        *[F.count_if(F.col(f"{s}{k}") > 0).alias(f"d{s}{k}") for s in "nm" for k in range(len(terms))],
    )
    df = base.crossJoin(F.broadcast(stats))  # one row

    def idf(d):
        return F.log((F.col("N") - F.col(d) + 0.5) / (F.col(d) + 0.5) + 1)

    weights: dict[str, Column] = {}
    for kw in mode.keywords:
        for term in (kw.term, *kw.synonyms):
            toks = Q.tokenize(term)
            japanese = len(toks) > 1 and any(ord(c) > 0x303F for t in toks for c in t)
            w = T.phrase_weight(kw.weight, len(toks)) if japanese else kw.weight
            for t in dict.fromkeys([Q.norm(term), *toks]):
                c = synonyms.get(t, t)
                if c in terms:
                    rarity = F.log((F.col("N") + 1) / (F.col(f"dn{terms.index(c)}") + 1)) + 1
                    value = F.lit(float(w)) * rarity
                    weights[c] = value if c not in weights else F.greatest(weights[c], value)

    def signal(s):
        parts = []
        for k, t in enumerate(terms):
            f = F.col(f"{s}{k}").cast("double")
            tf = f * (mode.k1 + 1) / (f + mode.k1 * (1 - mode.b + mode.b * F.col("ngram_len" if s == "n" else "morph_len") / F.greatest(F.col("navg" if s == "n" else "mavg"), F.lit(1e-9))))
            parts.append(F.when(f > 0, idf(f"d{s}{k}") * tf * weights.get(t, F.lit(1.0))).otherwise(0.0))
        return _total(parts)

    present = _total([F.when(F.col(f"n{terms.index(t)}") > 0, 1).otherwise(0) for t in asked])
    groups = [g for g in Q.groups(mode.keywords, synonyms)]
    full = _total([reduce(lambda a, b: a & b, [F.col(f"n{terms.index(t)}") > 0 if t in terms else F.lit(False) for t in g]).cast("int") for g in groups if g])
    days = (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.col("published_on").cast("timestamp"))) / 86400
    df = df.withColumns({"ngram_score": signal("n"), "_m": signal("m"), "cooccur": cooccurrence()})
    df = df.withColumns({
        "morph_score": F.when(F.col("morph_len") > 0, F.col("_m")).otherwise(F.col("ngram_score")),
        "context": 1 + (mode.context_bonus - 1) * F.least(F.col("cooccur") / F.greatest(present, F.lit(1)), F.lit(1.0)),
        "coverage": 1 + 0.5 * full / max(1, len(groups)),
        "decay": F.greatest(F.lit(floor), F.exp(-mode.decay * days)),
    })
    top = df.agg(F.greatest(F.max("morph_score"), F.lit(0.0)).alias("mmax"), F.greatest(F.max("ngram_score"), F.lit(0.0)).alias("nmax"))
    df = df.crossJoin(F.broadcast(top))  # one row
    part = lambda s, m: F.when(F.col(m) > 0, F.col(s) / F.col(m)).otherwise(0.0)
    df = df.withColumn("bm25", mode.morph_weight * part("morph_score", "mmax") + mode.ngram_weight * part("ngram_score", "nmax"))
    df = df.withColumn("score", F.col("bm25") * F.col("context") * F.col("coverage") * F.col("decay"))
    return df.select("id", "published_on", *PARTS)


PARTS = ["ngram_score", "morph_score", "cooccur", "context", "coverage", "decay", "bm25", "score"]


def by(column: str) -> list[Column]:
    """The stable order of results: best first, ties by id."""
    return [F.desc(F.round(F.col(column), PLACES)), F.col("id")]


def ranked(docs: DataFrame, mode: Q.Mode, as_of: str, limit: int = 50, floor: float = 0.35) -> DataFrame:
    """id, score and its parts of the best documents."""
    return scored(docs, mode, as_of, floor).where("score > 0").orderBy(*by("score")).limit(min(max(limit, 1), 500))


def two_stage(results: DataFrame, threshold: float, limit: int) -> DataFrame:
    """Active documents first, those under the threshold after, to the limit; the reason is given for the latter."""
    below = F.round("score", PLACES) < threshold
    reason = F.when(below, F.format_string("score %.3f < %.3f", F.col("score"), F.lit(float(threshold))))
    top = results.withColumn("below", below).withColumn("reason", reason).orderBy("below", *by("score")).limit(min(max(limit, 1), 500))
    return top.withColumn("position", F.row_number().over(Window.orderBy("below", *by("score"))))  # at most 500 rows


def pipeline(docs: DataFrame, mode: Q.Mode, as_of: str, dedup: float = 0.8, threshold: float = 0.5, limit: int = 50, floor: float = 0.35, exact: bool = False) -> DataFrame:
    """The whole ranking: near duplicates go first, so that statistics are of what stays; then scores and two stages.

    All columns of docs for the rows that are returned, with the score, its parts, below, reason and position.
    """
    top = two_stage(scored(docs, mode, as_of, floor, repeated(docs, dedup, exact)).where("score > 0"), threshold, limit)
    return docs.join(F.broadcast(top.drop("published_on")), "id")  # 500 rows at most


def index(articles: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """The stored token index: id, url, published_on, content_hash, morph and ngram of each article.

    Given the old index, only articles that are new in it or have another hash are tokenised.
    """
    base = articles.withColumn("content_hash", T.content_hash(F.col("title"), F.col("body")))
    columns = ["id", "url", "published_on", "content_hash", "morph", "ngram"]
    if old is None:
        return tokenised(base).select(*columns)
    known = base.join(old.select("id", "content_hash", "morph", "ngram"), ["id", "content_hash"]).select(*columns)
    new = base.join(old.select("id", "content_hash"), ["id", "content_hash"], "left_anti")
    return known.unionByName(tokenised(new).select(*columns))


def postings(tokens: DataFrame, signal: str = "ngram") -> DataFrame:
    """id, term and tf."""
    return tokens.select("id", F.explode(signal).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def corpus_stats(tokens: DataFrame, signal: str = "ngram") -> DataFrame:
    """term and df over all documents."""
    return tokens.select("id", F.explode(F.array_distinct(signal)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def fts(tokens: DataFrame, terms: list[str]) -> DataFrame:
    """Documents with any of the terms, scored by BM25 with k1 1.2 and b 0.75 over their words; rank_no from 1."""
    has = F.size(F.array_intersect("morph", F.array(*map(F.lit, terms)))) > 0
    counts = {f"t{k}": _count(w) for k, w in enumerate(terms)}
    df = tokens.withColumns(counts).withColumn("len", F.size("morph"))
    stats = df.agg(F.count("*").alias("N"), F.avg("len").alias("avg"), *[F.count_if(F.col(c) > 0).alias(f"d{c}") for c in counts])
    df = df.where(has).crossJoin(F.broadcast(stats))  # one row
    parts = [F.log((F.col("N") - F.col(f"d{c}") + 0.5) / (F.col(f"d{c}") + 0.5) + 1) * F.col(c) * 2.2 / (F.col(c) + 1.2 * (0.25 + 0.75 * F.col("len") / F.col("avg"))) for c in counts]
    return df.withColumn("fts", _total(parts)).select("id", "fts")


def _count(word: str) -> Column:
    return F.size(F.filter("morph", lambda x: x == word))


def places(found: DataFrame, column: str = "fts") -> DataFrame:
    """id and place of all rows, 1 for the best and less by equal steps to the last; no task holds more than its range."""
    ranges = checkpointed(found.select("id", F.round(column, PLACES).alias("_s")).repartitionByRange(F.desc("_s"), "id"))
    ranges = ranges.withColumn("_p", F.spark_partition_id())
    sizes = ranges.groupBy("_p").agg(F.count("*").alias("_n"))  # a row for each range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_p", before.alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    own = F.row_number().over(Window.partitionBy("_p").orderBy(F.desc("_s"), "id"))
    return ranges.withColumn("_r", own).join(F.broadcast(sizes), "_p").select("id", (1 - (F.col("_before") + F.col("_r") - 1) / F.col("_all")).alias("place"))


def hybrid(base: DataFrame, found: DataFrame, limit: int = 50, lexical: float = 0.7) -> DataFrame:
    """base (id, score: the active results of a ranking) ordered anew by 0.7 of their min-max score and 0.3 of the place in found (id, fts)."""
    ends = base.agg(F.least(F.min("score"), F.lit(0.0)).alias("lo"), F.greatest(F.max("score"), F.lit(0.0)).alias("hi"))
    df = base.join(places(found), "id", "left").crossJoin(F.broadcast(ends))  # one row
    span = F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    df = df.withColumn("hybrid", lexical * span + (1 - lexical) * F.coalesce("place", F.lit(0.0))).drop("lo", "hi")
    return df.orderBy(*by("hybrid")).limit(limit)
