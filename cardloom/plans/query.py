"""Query compilation on the driver: parsing, synonyms and keyword groups. Queries are tiny."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field


@dataclass
class Keyword:
    term: str
    weight: float = 1.0
    synonyms: list[str] = field(default_factory=list)


@dataclass
class Mode:
    """Ranking parameters."""

    k1: float = 1.2
    b: float = 0.75
    decay: float = 0.05
    context_bonus: float = 1.5
    keywords: list[Keyword] = field(default_factory=list)
    ngram_weight: float = 0.7
    morph_weight: float = 0.3


# The three presets (k1, b, decay a day, context bonus, weights of the two signals) and their keywords.
PRESETS = {
    "impl": (1.2, 0.5, 0.05, 1.5, 0.75, 0.25),
    "theory": (1.8, 0.8, 0.02, 2.2, 0.35, 0.65),
    "trend": (1.5, 0.75, 0.15, 1.8, 0.35, 0.65),
}
PRESET_KEYWORDS = {
    "impl": [
        ("実装", 2.0, ["implementation", "コード", "code"]),
        ("github", 1.8, ["pr", "pullrequest", "コミット", "commit"]),
        ("ライブラリ", 1.6, ["パッケージ", "package", "npm", "pip"]),
        ("バグ", 1.4, ["エラー", "error", "exception", "例外"]),
        ("パフォーマンス", 1.2, ["速度", "最適化", "optimization"]),
        ("理論", 0.5, ["数式", "定理"]),
        ("潮流", 0.4, ["動向", "トレンド"]),
    ],
    "theory": [
        ("定理", 2.0, ["theorem", "補題", "lemma", "命題"]),
        ("arxiv", 1.9, ["論文", "paper", "preprint"]),
        ("証明", 1.7, ["proof", "仮説", "hypothesis"]),
        ("引用", 1.4, ["参考文献", "reference", "citation"]),
        ("実装", 0.6, ["コード"]),
        ("ニュース", 0.3, ["動向"]),
    ],
    "trend": [
        ("リリース", 2.0, ["発表", "launch", "announce"]),
        ("プロダクト", 1.9, ["サービス", "product", "service"]),
        ("市場", 1.5, ["業界", "industry", "market"]),
        ("資金調達", 1.3, ["funding", "シリーズ", "ipo"]),
        ("数式", 0.3, ["定理"]),
        ("古典", 0.2, []),
    ],
}


def preset(name: str) -> Mode:
    """A preset by name, with its keywords."""
    k1, b, decay, bonus, morph, ngram = PRESETS[name]
    return Mode(k1, b, decay, bonus, [Keyword(*k) for k in PRESET_KEYWORDS[name]], ngram, morph)


@dataclass
class ParsedQuery:
    raw: str
    phrases: list[str]
    terms: list[str]
    excluded: list[str]
    keywords: list[Keyword]


def norm(s: str) -> str:
    return unicodedata.normalize("NFKC", s).lower().strip()


def tokenize(s: str) -> list[str]:
    return [t for t in re.findall(r"\w+", s.lower()) if len(t) > 1]


def parse(raw: str, synonyms: dict[str, list[str]] | None = None) -> ParsedQuery:
    """Quoted phrases weigh 3, other terms 1; a leading minus excludes."""
    phrases, terms, excluded = [], [], []
    for m in re.finditer(r'(-?)"([^"]*)"|([^\s,、。"]+)', raw):
        minus, phrase, word = m[1] == "-", m[2], m[3]
        if word is not None and word.startswith("-"):
            minus, word = True, word[1:]
        value = norm(phrase if phrase is not None else word)
        bucket = excluded if minus else phrases if phrase is not None else terms
        if value and value not in bucket and (minus or value not in phrases + terms):
            bucket.append(value)
    of = synonyms or {}
    keywords = [Keyword(t, 3.0 if t in phrases else 1.0, list(of.get(t, []))) for t in phrases + terms]
    return ParsedQuery(raw, phrases, terms, excluded, keywords)


def synonym_map(keywords: list[Keyword]) -> dict[str, str]:
    """Every token of every synonym, and the synonym itself, to the first token of its term; later keywords win."""
    found = {}
    for k in keywords:
        canonical = next(iter(tokenize(k.term)), k.term.lower())
        for s in k.synonyms:
            for t in [*tokenize(s), s.lower()]:
                found[t] = canonical
    return found


def query_tokens(keywords: list[Keyword]) -> list[str]:
    raw = [norm(t) for k in keywords for t in (k.term, *k.synonyms)]
    return list(dict.fromkeys([t for t in raw if t] + tokenize(" ".join(k.term for k in keywords))))


def candidates(keywords: list[Keyword]) -> list[str]:
    """The keywords' terms, trimmed, each once whatever its case; the first spelling stays."""
    found: dict[str, str] = {}
    for k in keywords:
        if k.term.strip():
            found.setdefault(norm(k.term), k.term.strip())
    return list(found.values())


def groups(keywords: list[Keyword], synonyms: dict[str, str]) -> list[list[str]]:
    return [list(dict.fromkeys(synonyms.get(t, t) for t in tokenize(k.term))) for k in keywords]


def clamp_limit(value: float | None, default: int | None = None, most: int = 100) -> int | None:
    """Whole, positive and at most ``most``; otherwise the default."""
    if value is None or int(value // 1) <= 0:
        return default
    return min(int(value // 1), most)
