"""Quality rules: text statistics in SQL functions, and a decision list learned from labelled statistics.

Learning is sequential covering: grow a conjunction of thresholds by information gain on two thirds of the rows,
prune it on the other third, remove what it covers, and go on. The list becomes one ordered conditional expression.
The fit uses at most ``most`` labelled rows (a documented bound, chosen by a hash of the id); statistics, base rule and
verdict are DataFrame functions over every row.
"""

from __future__ import annotations

import math
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_LABELLED = 8192
SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words and the other counts of STATS, and n_upper, n_shout and n_lines, all long.

    A null text counts as empty: all zero. Columns of these names are replaced.

    Words in repeated 3-word windows: each window's 64-bit hash gives its upper 44 bits, and its position the 20 lower
    ones of a number; sorted, equal windows are neighbours, and neighbours are equal if their full hashes are. Texts of
    more than 2**20 words, and those with different windows of equal upper bits, sort pairs of hash and position
    instead, which is slower.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    df = docs.drop(*STATS, "n_upper", "n_shout", "n_lines").withColumn("_w", F.filter(F.split(raw, SPACE + "+"), lambda w: w != ""))
    n = F.size("_w")
    gone = lambda chars: F.length(raw) - F.length(F.translate(raw, chars, ""))
    lines = F.filter(F.split(raw, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    w = F.col("_w")
    hashes = F.when(n >= 4, F.transform(F.slice(w, 3, F.greatest(n - 2, F.lit(0))), lambda x, i: F.xxhash64(F.get(w, i), F.get(w, i + 1), x))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("_h", hashes).withColumn("_lines", lines)
    h = F.col("_h")
    low = (1 << 20) - 1
    upper = F.transform(h, lambda x: x.bitwiseAND(~low))
    packed = F.transform(F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(~low).bitwiseOR(i.cast("long")))), lambda x: x.bitwiseAND(low).cast("int"))
    pairs = F.transform(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), lambda x: x["i"])
    none = F.array().cast("array<int>")
    df = df.withColumn("_d", F.size(F.array_distinct("_h")))
    apart = (n <= low) & (F.size(F.array_distinct(upper)) == F.col("_d"))
    # after sorting only positions matter; a text in which no window is repeated needs no sorting and no walk
    df = df.withColumn("_s", F.when(F.size("_h") == F.col("_d"), none).when(apart, packed).otherwise(pairs))
    s = F.col("_s")
    same = lambda a, b: F.get(h, a) == F.get(h, b)
    repeated = F.filter(s, lambda x, i: F.coalesce((i > 0) & same(x, F.get(s, i - 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, i + 1)), F.lit(False)))
    df = df.withColumn("_r", F.sort_array(repeated))
    covered = F.aggregate(F.col("_r"), F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"), x.alias("last")), lambda a: a["n"])
    out = {
        "n_words": n,
        "word_chars": F.length(F.translate(raw, " \t\n\x0b\x0c\r", "")),
        "n_symbols": gone(SYMBOLS),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": covered,
        "n_upper": gone("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "n_shout": gone("!"),
        "n_lines": F.size("_lines"),
    }
    return df.withColumns({k: v.cast("long") for k, v in out.items()}).drop("_w", "_h", "_d", "_s", "_r", "_lines")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


# name: numerator and denominator
FEATURES = {
    "words": ("n_words", None),
    "chars_a_word": ("word_chars", "n_words"),
    "symbol_share": ("n_symbols", "word_chars"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "shout_share": ("n_shout", "word_chars"),
}


def feature(name: str) -> Column:
    top, below = FEATURES[name]
    return F.col(top).cast("double") / (F.greatest(F.col(below), F.lit(1)).cast("double") if below else 1.0)


def learn(rows: list[tuple[dict[str, float], bool]], most_rules: int = 8, most_terms: int = 3, least_covered: int = 8, least_precision: float = 0.6):
    """Rules for the rows marked True: [[(feature, "<=" or ">", threshold), ...], ...] in the order found.

    No rows, or no marked rows, give no rules. Ties go to the first feature and the smaller threshold.
    """
    grow, prune = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if i % 3 == 0]
    names = list(FEATURES)
    rules = []

    def holds(rule, x):
        return all((x[f] <= t) if op == "<=" else (x[f] > t) for f, op, t in rule)

    def counts(rule, rs):
        p = sum(1 for x, y in rs if y and holds(rule, x))
        return p, sum(1 for x, y in rs if not y and holds(rule, x))

    for _ in range(most_rules):
        rule, inside = [], grow
        while len(rule) < most_terms:
            p0, n0 = sum(y for _, y in inside), sum(not y for _, y in inside)
            if not p0 or not n0:
                break
            best = (1e-9, None)
            for f in names:
                values = sorted({x[f] for x, _ in inside})
                cuts = values if len(values) <= 64 else [values[len(values) * k // 64] for k in range(64)]
                order = sorted(((x[f], y) for x, y in inside))
                at = p = n = 0
                for t in cuts:
                    while at < len(order) and order[at][0] <= t:
                        p, n, at = p + order[at][1], n + (not order[at][1]), at + 1
                    for op, pp, nn in (("<=", p, n), (">", p0 - p, n0 - n)):
                        if pp >= least_covered:
                            gain = pp * (math.log2(pp / (pp + nn)) - math.log2(p0 / (p0 + n0)))
                            if gain > best[0] + 1e-12:
                                best = (gain, (f, op, t))
            if not best[1]:
                break
            rule.append(best[1])
            inside = [r for r in inside if holds([best[1]], r[0])]
        if not rule:
            break
        worth = lambda r: (lambda c: (c[0] - c[1]) / max(1, sum(c)))(counts(r, prune))
        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        p, n = counts(rule, prune)
        if p + n == 0 or p / (p + n) < least_precision:
            break
        rules.append(rule)
        grow = [r for r in grow if not holds(rule, r[0])]
        prune = [r for r in prune if not holds(rule, r[0])]
    return rules


def verdict(rules) -> Column:
    """The decision list as one expression: false at the first rule that holds, else true."""
    cases = None
    for rule in rules:
        cond = F.lit(True)
        for f, op, t in rule:
            cond = cond & ((feature(f) <= t) if op == "<=" else (feature(f) > t))
        cases = F.when(cond, False) if cases is None else cases.when(cond, False)
    return F.lit(True) if cases is None else cases.otherwise(True)


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED):
    """Rules for low quality, from at most ``most`` labelled documents that pass the base rule."""
    chosen = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    found = statistics(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))
    # no filter on computed columns here: it would be pushed below them and repeat their work
    seen = F.struct(base_failed().alias("failed"), *[feature(f).alias(f) for f in FEATURES])
    # one of the rows that share an id: the driver gets ``most`` rows at most
    rows = found.select("doc_id", "_quality", seen.alias("s")).groupBy("doc_id", "_quality").agg(F.min("s").alias("s")).select("doc_id", "_quality", "s.*").collect()
    rows = sorted((r for r in rows if not r["failed"]), key=lambda r: zlib.crc32(str(r["doc_id"]).encode()))[:most]
    return learn([({f: r[f] for f in FEATURES}, r["_quality"] == 0) for r in rows])


def judge(docs: DataFrame, rules) -> DataFrame:
    """docs with its statistics, base_failed and kept."""
    return statistics(docs).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rules = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(docs.select("doc_id", "text"), rules).select("doc_id", *STATS, "base_failed", "kept")
