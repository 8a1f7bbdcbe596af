"""URL filters: rules are indexed by their rarest literal token, and only fetched rules run their regular expression."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, col, nested

#: Rule sets up to this many index rows are broadcast; larger ones are joined by shuffle.
BROADCAST_RULES = 200_000


@dataclass(frozen=True)
class UrlRule:
    """``regex`` runs on all that follows ``://``, its host lower-cased. ``tokens``: whole alphanumeric tokens that each match holds, lower case.

    Among matches the highest ``rank`` wins, then the first name. ``named``: the result shows its name.
    """

    name: str
    regex: str
    tokens: tuple[str, ...]
    verdict: str
    rank: int = 0
    named: bool = True


def host_rule(host: str, path: str, verdict: str) -> UrlRule:
    """Fits ``host`` and its subdomains where the url's path starts with ``path``; longer rules outrank shorter ones."""
    whole = host + path
    found = [m for m in re.finditer(r"[a-z0-9]+", whole.lower()) if m.end() < len(whole)]
    return UrlRule(whole, r"^(?:[^/?#]*\.)?" + re.sub(r"([^\w/-])", r"\\\1", whole), tuple(m[0] for m in found), verdict, 1000 + len(whole))


def filter_rule(line: str, rank: int = 0) -> UrlRule:
    """A rule from one line of a filter list.

    ``||`` starts at a label of the host, ``|`` at an end of the url, ``*`` is any text, ``^`` a separator (neither
    letter, digit nor ``_.%-``) or the end, and ``@@`` in front allows what other lines block. Case doesn't count.
    """
    allow = line.startswith("@@")
    body = line[2:] if allow else line
    host, start, end = body.startswith("||"), body.startswith("|"), body.endswith("|") and len(body.strip("|")) > 0
    body = body.strip("|").lower()
    separator = r"(?:[^A-Za-z0-9_.%-]|\z)"
    regex = "".join(".*" if c == "*" else separator if c == "^" else c if re.match(r"\w", c) else "\\" + c for c in body)
    regex = "(?is)" + (r"^(?:[^/?#]*\.)?" if host else "^" if start else "") + regex + (r"\z" if end else "")
    # A run of letters and digits is a whole token of each match if nothing can lengthen it.
    held = ("^" if start else "*") + body + ("^" if end else "*")
    tokens = [m[0] for m in re.finditer(r"[a-z0-9]+", held) if held[m.start() - 1] != "*" and held[m.end()] != "*" and m[0].isascii()]
    return UrlRule(line, regex, tuple(tokens), "allow" if allow else "block", rank + allow, False)


def read_filter_list(lines: Iterable[str], rank: int = 0) -> tuple[list[UrlRule], list[str]]:
    """Rules of a published filter list, and the lines that a url alone can't decide.

    Comments (``!``), the header (``[``) and blank lines are neither. Lines that hide parts of a page (``##`` and its kin) and those
    with options (behind ``$``: who asks, from where, for what) or a scheme are left over; ``/.../`` is a regular expression. A rule that
    stands twice counts once.
    """
    rules: dict[str, UrlRule] = {}
    left: list[str] = []
    for line in (x.strip() for x in lines):
        if not line or line[0] in "![":
            continue
        body = line.removeprefix("@@")
        if "://" in body or re.search(r"#[@?$%]*#", body) or re.search(r"\$~?[a-z0-9_-]+(?:=[^/]*)?(?:,~?[a-z0-9_-]+(?:=[^/]*)?)*$", body) or not re.sub(r"[|*^]", "", body):
            left.append(line)
        elif len(body) > 2 and body.startswith("/") and body.endswith("/") and re.search(r"[\\^$+?()\[\]{}|*]", body):
            rules.setdefault(line, UrlRule(line, "(?is)" + body[1:-1], (), "allow" if line.startswith("@@") else "block", rank + line.startswith("@@"), False))
        else:
            rules.setdefault(line, filter_rule(line, rank))
    return list(rules.values()), left


# The rules that every judgement starts from.
HOST_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: Words that mark sites and sections of no use as training text, and the places in a url where each counts.
FILTER_WORDS = [
    "casino", "poker", "betting", "jackpot", "slots", "lottery", "porn", "xxx", "hentai", "escort", "camgirls", "nude", "viagra", "cialis", "cheap-pills", "weight-loss",
    "payday-loan", "free-money", "get-rich", "crypto-airdrop", "warez", "keygen", "nulled", "torrent", "cracked", "malware", "phishing", "ransomware", "spam-farm", "link-farm",
    "clickbait", "adserver", "doubleclick", "popunder", "tracker",
]
FILTER_SHAPES = ["||{}.", "-{}.", "/{}/", "/{}^", "-{}-", "/{}-*.html|", "^{}=", "_{}_"]
#: Links that pay whoever set them, and the sections that are kept whatever words they hold.
FILTER_LINES = ["?ref=", "&ref=", "@@/library/", "@@||museum^"]


def default_rules() -> list[UrlRule]:
    lines = [shape.format(w) for w in FILTER_WORDS for shape in FILTER_SHAPES] + FILTER_LINES
    return [host_rule(*r) for r in HOST_RULES] + [filter_rule(x) for x in lines]


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host (lower-cased), path, and all that follows ``://`` with that host; empty for a null or a url without ``://``."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.concat(host, F.substring(rest, F.length(host) + 1, F.length(rest)))


def _tokens(subject: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.translate(subject, UPPER, LOWER), "[^a-z0-9]+"), lambda t: t != ""))


def _rules(spark: SparkSession, rules: Sequence[UrlRule]) -> DataFrame:
    rows = [(i, r.name, r.regex, list(dict.fromkeys(r.tokens)), r.verdict, r.rank, r.named) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "rule int, name string, regex string, words array<string>, verdict string, rank int, named boolean")


def judge_urls(df: DataFrame, rules: Sequence[UrlRule] | None = None, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` (null unless a named rule fits) and ``verdict`` to each row.

    Null, empty and schemeless urls have empty parts and the default verdict. Repeated rows are judged alike,
    null ids are rows like others, and an empty table or rule list gives the default. Rules without a
    literal token run on every url. Existing columns of the four names are replaced; others may have any name.
    """
    rules = default_rules() if rules is None else list(rules)
    spark = df.sparkSession
    host, path, whole = url_parts(col(url_col))
    kept = [c for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    rows = nested(df, id=col(id_col), host=host, path=path, subject=whole)
    indexed, loose = [r for r in rules if r.tokens], [r for r in rules if not r.tokens]
    small = sum(len(r.tokens) for r in indexed) <= BROADCAST_RULES
    fit = (lambda x: F.broadcast(x)) if small else (lambda x: x)
    words = rows.select("id", "subject", F.explode(_tokens(F.col("subject"))).alias("word"))
    table = _rules(spark, indexed)
    # How often each token of a rule occurs in all urls decides which one indexes the rule.
    wanted = table.select(F.explode("words").alias("word")).distinct()
    seen = words.join(fit(wanted), "word").groupBy("word").agg(F.count(F.lit(1)).alias("seen"))
    rarest = (
        table.select("rule", F.explode("words").alias("word")).join(seen, "word", "left")
        .groupBy("rule").agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("n"), F.col("word").alias("w"))).alias("r"))
    )
    index = rarest.join(table, "rule").select(F.col("r.w").alias("word"), "regex", "name", "verdict", "rank", "named")
    hits = words.join(fit(index), "word").where(F.expr("subject RLIKE regex"))
    found = hits.groupBy("id", "subject").agg(F.max(F.struct("rank", "name", "named", "verdict")).alias("best"))
    found = found.select(F.col("id").alias("_id"), F.col("subject").alias("_subject"), "best")
    out = rows.join(found, F.col("id").eqNullSafe(F.col("_id")) & (F.col("subject") == F.col("_subject")), "left")
    chosen = F.col("best")
    for r in loose:
        own = F.struct(F.lit(r.rank).alias("rank"), F.lit(r.name).alias("name"), F.lit(r.named).alias("named"), F.lit(r.verdict).alias("verdict"))
        chosen = F.greatest(chosen, F.when(F.col("subject").rlike(r.regex), own))
    out = out.withColumn("chosen", chosen)
    return out.select(
        *[F.col("row")[c].alias(c) for c in kept], "host", "path",
        F.when(F.col("chosen.named"), F.col("chosen.name")).alias("rule"), F.coalesce("chosen.verdict", F.lit(default)).alias("verdict"),
    )
