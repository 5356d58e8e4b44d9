"""URL filter: host and path rules first, then a weighted vocabulary of terms.

The rules are a short list; each becomes one branch of a Spark expression, longest rule first.
For urls without a rule an Aho-Corasick automaton finds every term of the vocabulary in one
pass over the lower-cased url. A hit counts if no letter or digit touches it on either side.
One strict term rejects, and so do ``soft_limit`` distinct soft terms; repeats of a soft term
count once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.rows import on_workers

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STRICT, SOFT = 2, 1


def inflected(stem: str) -> set[str]:
    """A term with the endings of English nouns and verbs, by their spelling rules."""
    forms = {stem}
    if stem.endswith(("s", "x", "z", "ch", "sh")):
        forms.add(stem + "es")
    elif stem.endswith("y") and stem[-2:-1] not in tuple("aeiou"):
        forms.add(stem[:-1] + "ies")
    else:
        forms.add(stem + "s")
    return forms


def verb_forms(stem: str, doubled: bool = False) -> set[str]:
    root = stem[:-1] if stem.endswith("e") else stem + stem[-1] * doubled
    return inflected(stem) | {root + "ing"} | inflected(root + "er")


# General terms by category, with the weight of the category. Nouns and verbs are inflected by
# rule, so the stems stay readable; a deployment passes its own ``terms`` of any length.
CATEGORIES: dict[str, tuple[int, tuple[str, ...], tuple[tuple[str, bool], ...]]] = {
    # category: weight, nouns, verbs with whether the last letter doubles
    "adult": (
        STRICT,
        (
            "adult", "bdsm", "boob", "bukkake", "camgirl", "camsex", "deepthroat", "dildo", "erotic", "erotica", "escort", "fetish",
            "futanari", "hardcore", "hentai", "hooker", "horny", "incest", "lesbo", "livesex", "milf", "naked", "nsfw", "nude", "orgasm",
            "porn", "porno", "pornstar", "pussy", "sex", "sexcam", "sexshop", "sextoy", "sexy", "slut", "stripper", "threesome", "upskirt",
            "voyeur", "webcamsex", "whore", "xxx", "xvideo",
        ),
        (("fuck", False), ("masturbate", False), ("gangbang", False)),
    ),
    "gambling": (
        STRICT,
        (
            "baccarat", "bet", "betting", "bettor", "betslip", "blackjack", "bookie", "bookmaker", "casino", "craps", "freespin", "jackpot",
            "onlinecasino", "poker", "pokies", "roulette", "sportsbet", "sportsbook", "wager",
        ),
        (("gamble", False), ("wager", False)),
    ),
    "spam": (
        STRICT,
        (
            "adserver", "adfly", "backlink", "cialis", "clickbait", "clickfraud", "fakeid", "getrichquick", "levitra", "linkfarm", "payday",
            "ponzi", "popunder", "replica", "scam", "tramadol", "valium", "viagra", "xanax",
        ),
        (("spam", True), ("phish", False), ("scam", True)),
    ),
    "piracy": (
        STRICT,
        ("crackz", "filmstream", "fullrip", "keygen", "nulled", "warez", "torrentz"),
        (),
    ),
    "bait": (
        SOFT,
        (
            "ad", "babe", "bargain", "bingo", "bonus", "bulk", "cam", "cash", "cheap", "click", "codec", "coupon", "crack", "credit",
            "crypto", "dating", "deal", "debt", "diet", "discount", "download", "farm", "flirt", "forex", "free", "gift", "giveaway",
            "hack", "hot", "instant", "loan", "lottery", "lotto", "lucky", "miracle", "mortgage", "nofee", "odds", "offer", "pharma",
            "pharmacy", "pill", "popup", "prize", "promo", "rich", "serial", "slot", "slots", "stake", "torrent", "unlimited",
            "viral", "weightloss", "win", "winner",
        ),
        (("track", False), ("click", False), ("stream", False), ("earn", False), ("win", True)),
    ),
}


def vocabulary(categories: dict = CATEGORIES) -> dict[str, int]:
    """Terms with their weights; a term of several categories has its largest weight."""
    terms: dict[str, int] = {}
    for weight, nouns, verbs in categories.values():
        forms = set().union(*(inflected(n) for n in nouns), *(verb_forms(v, d) for v, d in verbs))
        for form in forms:
            terms[form] = max(weight, terms.get(form, 0))
    return terms


TERMS = vocabulary()


def _host_path(url: str) -> tuple[Column, Column]:
    text = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"(?s)^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def _rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits, as a struct of rule and verdict, or null."""
    chosen = None
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        found = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        chosen = F.when(fits, found) if chosen is None else chosen.when(fits, found)
    return chosen if chosen is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


@lru_cache(maxsize=4)
def _automaton(terms: tuple[tuple[str, int], ...]):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for term, weight in terms:
        automaton.add_word(term.lower(), (term.lower(), weight))
    automaton.make_automaton()
    return automaton


def term_counts(url: str, terms: tuple[tuple[str, int], ...]) -> tuple[int, int]:
    """Distinct strict and distinct soft terms that stand alone in the url."""
    if not terms:
        return 0, 0
    text = url.lower()
    strict, soft = set(), set()
    for last, (term, weight) in _automaton(terms).iter(text):
        begin, end = last - len(term) + 1, last + 1
        if begin and text[begin - 1].isalnum() or end < len(text) and text[end].isalnum():
            continue
        (strict if weight >= STRICT else soft).add(term)
    return len(strict), len(soft)


def _counted(terms: tuple[tuple[str, int], ...]):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = batch.column("url").to_pylist()
            needed = batch.column("rule").is_null().to_pylist()
            found = [term_counts(u or "", terms) if n else (0, 0) for u, n in zip(urls, needed)]
            columns = {n: batch.column(n) for n in batch.schema.names if n != "url"}
            columns["n_strict"] = pa.array([s for s, _ in found], pa.int32())
            columns["n_soft"] = pa.array([s for _, s in found], pa.int32())
            yield pa.RecordBatch.from_pydict(columns)

    return of


def judge(
    pages: DataFrame, rules: Sequence[tuple[str, str]], terms: dict[str, int] | None = None,
    soft_limit: int = 2, id_col: str = "page_id", url_col: str = "url",
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, n_strict, n_soft.

    ``rules`` are (verdict, "host/path") pairs; a rule fits its host and all hosts below it if
    the path starts as the rule's does, and the longest fitting rule decides. A null url, or one
    without ``://``, has an empty host and path; a null url has no terms and is allowed. Null ids
    and repeated rows are kept as they are; other columns are not read.
    """
    on_workers(pages.sparkSession)
    weights = tuple(sorted((TERMS if terms is None else terms).items()))
    host, path = _host_path("url")
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    own = own.select("page_id", "url", host.alias("host"), path.alias("path"))
    own = own.withColumn("found", _rule(F.col("host"), F.col("path"), rules))
    own = own.select("page_id", "url", "host", "path", F.col("found.rule").alias("rule"), F.col("found.verdict").alias("by_rule"))
    kind = own.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, host string, path string, rule string, by_rule string, n_strict int, n_soft int"
    counted = own.mapInArrow(_counted(weights), schema)
    rejected = (F.col("n_strict") > 0) | (F.col("n_soft") >= soft_limit)
    verdict = F.coalesce("by_rule", F.when(rejected, "block").otherwise("allow"))
    return counted.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "n_strict", "n_soft")
