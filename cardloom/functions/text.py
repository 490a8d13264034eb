"""Scalar text functions as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Character ranges of Japanese script; what a wrong decoding leaves, for texts and for the wider scan;
# colours of groups.
CJK = r"぀-ヿ㐀-鿿豈-﫿ｦ-ﾟ"
TOKEN = r"[\p{L}\p{N}_]+"
MOJIBAKE = ["\uFFFD", "Ã.", "Â.", "ã.", "繧", "縺", "譁"]
SCANNED = ["\uFFFD", "\u7E3A", "\u8B41", "\u9AEB", "\u8373", "\u8737", "\u9666", "\u9060", "\u9695", "\u7E67", "\u7E5D", "\u00E3", "\u00C2", "\u00C3"]
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
PALETTE = ["#FF6B6B", "#FFD93D", "#6BCB77", "#4D96FF", "#C77DFF", "#FF9A3C", "#00C9A7", "#F72585"]
DEFAULT_GROUP_COLOR = "#4D96FF"


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def normalize(c: Column) -> Column:
    """NFKC, lower case, trimmed; of ASCII rows only a null is sent to Python."""
    wide = F.when(c.rlike(r"[^\x00-\x7f]"), c)
    return F.trim(F.lower(F.coalesce(_nfkc(wide), c)))


def tokens(c: Column) -> Column:
    """Runs of letters, digits and underscores of two characters or more, lower-cased."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit(f"({TOKEN})"), 1), lambda t: F.length(t) > 1)


def bigrams(tokens_: Column) -> Column:
    """The distinct tokens with the two-character pieces of those in Japanese script."""
    def pieces(t):
        return F.when((F.length(t) > 2) & t.rlike(f"[{CJK}]"), F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(tokens_, F.flatten(F.transform(tokens_, pieces))))


def stored_tokens(text: Column) -> tuple[Column, Column]:
    """(morphological, n-gram) tokens: runs by script, and their set with bigrams of Japanese runs."""
    morph = tokens(text)
    runs = F.regexp_extract_all(F.lower(text), F.lit(f"([{CJK}]{{2,}})"), 1)
    return morph, F.when(text.rlike(f"[{CJK}]"), bigrams(F.concat(morph, runs))).otherwise(F.array_distinct(morph))


def phrase_weight(weight: float, n_tokens: int) -> float:
    """Phrases of n tokens weigh more, up to 3; single tokens keep their weight."""
    return weight if n_tokens <= 1 else min(weight * (1 + min(n_tokens - 1, 4) * 0.125), 3.0)


def looks_mojibake(c: Column) -> Column:
    return c.rlike("|".join(MOJIBAKE))


def bad_encoding(c: Column) -> Column:
    return c.rlike("|".join(SCANNED)) | c.rlike(CONTROL)


def strip_html(c: Column, most: int = 1200) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"\s+", " ")), 1, most)


def slug(c: Column, most: int = 48) -> Column:
    return F.substring(F.regexp_replace(F.lower(c), "[^a-z0-9]", "_"), 1, most)


def content_hash(title: Column, body: Column) -> Column:
    return F.sha2(F.concat(title, F.char(F.lit(0)), body), 256)


def infer_source(id_: Column, source: Column) -> Column:
    prefixes = F.when(id_.startswith("rss_"), "rss").when(id_.startswith("arxiv_"), "arxiv").when(id_.startswith("github_"), "github")
    return F.coalesce(F.nullif(source, F.lit("")), prefixes)


SHINGLE, SHINGLE_HEAD = 5, 500  # characters of a shingle, and of a body that are looked at


def shingled_text(title: Column, body: Column) -> Column:
    """The text that shingles are cut from: the lower-cased title and the head of the body."""
    return F.lower(F.concat(title, F.lit(" "), F.substring(body, 1, SHINGLE_HEAD)))


def shingles(title: Column, body: Column, k: int = SHINGLE) -> Column:
    """Distinct k-character pieces of shingled_text()."""
    s = shingled_text(title, body)
    return F.when(F.length(s) >= k, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - (k - 1)), lambda i: F.substring(s, i, F.lit(k))))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Intersection over union; two empty sets are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def json_strings(c: Column) -> Column:
    """A JSON array of strings; anything else gives an empty array."""
    return F.coalesce(F.from_json(F.when(F.trim(c).startswith("["), c), "array<string>"), F.array().cast("array<string>"))


def clean_tags(c: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(c, lambda x: F.trim(x)), lambda t: t != ""))


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def mock_summary(title: Column, body: Column) -> Column:
    return F.coalesce(F.nullif(F.substring(F.trim(body), 1, 120), F.lit("")), title)


def keyword_list(c: Column, most: int = 10, length: int = 50) -> Column:
    """The first [...] in a model's answer, as trimmed strings of at most ``length`` characters."""
    found = json_strings(F.regexp_extract(c, r"(?s)(\[.*\])", 1))
    return F.slice(F.filter(F.transform(found, lambda x: F.trim(x)), lambda k: (k != "") & (F.length(k) <= length)), 1, most)


def repaired_timestamp(c: Column, id_: Column, now: Column) -> Column:
    """The timestamp, or the milliseconds in an id like card_<ms>_x, or now."""
    ms = F.regexp_extract(id_, r"^card_(\d{10,15})_", 1)
    return F.coalesce(F.try_to_timestamp(c), F.when(ms != "", F.timestamp_millis(F.when(ms != "", ms.cast("long")))), now)


def safe_filename(title: Column, id_: Column) -> Column:
    s = F.trim(F.regexp_replace(F.regexp_replace(title, r'[<>:"/\\|?*\x00-\x1f]', " "), r"\s+", " "))
    s = F.regexp_replace(F.substring(s, 1, 80), r"[. ]+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.nullif(id_, F.lit("")), F.lit("card"))


def highlight(text: Column, terms: list[str], most: int = 10) -> Column:
    """Terms in <mark>, longest first, whatever their case."""
    terms = sorted({t for t in terms if t}, key=lambda t: (-len(t), t))[:most]
    if not terms:
        return text
    escaped = "|".join("".join("\\" + ch if ch in r"\.[]{}()*+-?^$|" else ch for ch in t) for t in terms)
    return F.regexp_replace(text, f"(?i)({escaped})", "<mark>$1</mark>")
