"""URL filter by rules and a Bloom filter cascade (operator 7, native).

The longest rule that fits a URL decides. Without one the host is looked up in a
cascade of Bloom filters: level 1 holds the listed hosts, level 2 the corpus's
other hosts that level 1 takes for listed, level 3 the listed hosts that level 2
takes for those, and so on until a level has no false positive. Over the corpus's
complete universe of hosts the answer is exact, and URLs are neither shuffled nor
joined: only the distinct hosts are, once, to build the levels. A level has at most
bloom.MAX_BITS; where the listed hosts need more, hosts are dealt into parts by a hash,
and each part is judged by a cascade of its own and written before the next one's turn,
so that no plan holds more than one cascade.

A null URL, or one without "://", has an empty host and path, fits no rule, and is
looked up like any host (an empty host is allowed unless it is listed). Repeated
rows get equal verdicts; URLs of any length are read whole; an empty table gives
no rows; other columns are ignored. A listed host stands for its subdomains too.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import ascii_lower, quoted, split_by_keys, spool

# Fixed values of the contract: (verdict, rule).
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Sites that are blocked where no rule says otherwise, under each of three domains.
LISTED = tuple(
    f"{site}.example.{end}"
    for site in ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
    for end in ("com", "net", "org")
)
MAX_LEVELS = 64


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    path = F.regexp_extract(F.regexp_replace(rest, "^[^/?#]*", ""), "^[^?#]*", 0)
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), path


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The rule that decides and its verdict, both null if none fits."""
    rule = verdict = None
    for says, text in sorted(rules, key=lambda r: -len(r[1])):
        its_host, slash, its_path = text.partition("/")
        fits = ((host == its_host) | host.endswith("." + its_host)) & path.startswith(slash + its_path)
        rule = F.when(fits, F.lit(text)) if rule is None else rule.when(fits, F.lit(text))
        verdict = F.when(fits, F.lit(says)) if verdict is None else verdict.when(fits, F.lit(says))
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule.otherwise(none), verdict.otherwise(none))


def listed_hosts(hosts: DataFrame, listed: DataFrame) -> DataFrame:
    """hosts(host) of the corpus and whether it or a domain above it is listed(host).
    Names are probed in a Bloom filter of the list; only positives are confirmed."""
    labels = F.split("host", "\\.")
    above = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    known = spool(listed.where(F.col("host").isNotNull()).select(F.col("host").alias("name")).distinct(), "listed")
    may = split_by_keys(hosts.select("host", F.explode(above).alias("name")), "name", known, "name")[1]
    hits = spool(may.join(known, "name", "left_semi").select("host").distinct(), "hits")
    others, may = split_by_keys(hosts, "host", hits, "host")
    confirmed = may.join(hits.withColumn("hit", F.lit(True)), "host", "left").select("host", F.coalesce("hit", F.lit(False)).alias("listed"))
    return others.withColumn("listed", F.lit(False)).unionByName(confirmed)


def counts(universe: DataFrame) -> tuple[int, int]:
    """The numbers of its hosts and of the listed ones."""
    return tuple(universe.agg(F.count("*"), F.count_if("listed")).first())


def probes(n_held: int, n_other: int) -> int:
    """Of the first level, which rejects most of a much larger other side."""
    rate = min(0.5, n_held / (math.sqrt(2) * max(n_other, 1)))
    return max(1, round(math.log2(1 / rate))) if n_held else 1


def parts_for(n_all: int, n_in: int) -> int:
    """Into how many parts hosts are dealt, so that a first level keeps its bits; later
    levels hold fewer keys."""
    bits = n_in * probes(n_in, n_all - n_in) / math.log(2)
    return max(1, math.ceil(bits / bloom.MAX_BITS))


class Cascade:
    """Levels over a universe(host, listed) of distinct hosts; sizes: its counts(), if it is
    spooled and they are known."""

    def __init__(self, universe: DataFrame, sizes: tuple[int, int] | None = None):
        universe = spool(universe, "universe") if sizes is None else universe
        n_all, n_in = sizes or counts(universe)
        self.levels: list[tuple[DataFrame, int, int]] = []
        held, other = (universe.where("listed").select("host"), universe.where("not listed").select("host"))
        n_held, n_other = n_in, n_all - n_in
        while n_held:
            if len(self.levels) == MAX_LEVELS:
                raise RuntimeError("the filter cascade doesn't end: deal the hosts into more parts")
            k = 1 if self.levels else probes(n_held, n_other)  # later levels reject half
            pages = bloom.pages_for(n_held, bits_a_key=k / math.log(2))
            salt = 1 + len(self.levels)
            level = spool(bloom.build_from_keys(held, "host", pages, k, salt), "level")
            self.levels.append((level, pages, k))
            wrong = spool(other.where(bloom.maybe(level.scalar(), F.col("host"), pages, k, salt)), "wrong")
            held, other = wrong, held
            n_held, n_other = wrong.count(), n_held

    def contains(self, host: Column) -> Column:
        found = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            level, pages, k = self.levels[i]
            found = F.when(~bloom.maybe(level.scalar(), host, pages, k, 1 + i), F.lit(i % 2 == 1)).otherwise(found)
        return found


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict."""
    host, path = host_and_path(F.col(quoted(url_col)))
    rows = pages.select(F.col(quoted(id_col)).alias("page_id"), host.alias("host"), path.alias("path"))
    universe = spool(listed_hosts(rows.select("host").distinct(), listed), "universe")
    sizes = counts(universe)
    n_parts = parts_for(*sizes)
    if n_parts == 1:
        return _verdicts(rows, Cascade(universe, sizes), rules)
    part = F.pmod(F.xxhash64(F.lit("part"), "host"), F.lit(n_parts)).cast("int")
    rows, universe = (spool(x.withColumn("part", part), "parts", "part") for x in (rows, universe))
    own = lambda x, i: x.where(F.col("part") == i).drop("part")
    return reduce(DataFrame.unionByName, [spool(_verdicts(own(rows, i), Cascade(own(universe, i)), rules), "judged") for i in range(n_parts)])


def _verdicts(rows: DataFrame, cascade: Cascade, rules: Sequence[tuple[str, str]]) -> DataFrame:
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    by_list = F.when(cascade.contains(F.col("host")), F.lit("block")).otherwise(F.lit("allow"))
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_list).alias("verdict"))


def op7_url_cascade(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, spark.createDataFrame([(x,) for x in LISTED], "host string"))


def _oracle() -> str:
    fits = "(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}')"
    rules = sorted(RULES, key=lambda r: -len(r[1]))
    parts = [(says, text, fits.format(h=text.split("/", 1)[0], p=text.split("/", 1)[1])) for says, text in rules]
    listed = " OR ".join(f"host = '{x}' OR ends_with(host, '.{x}')" for x in LISTED)
    return f"""
WITH r AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path FROM r)
SELECT page_id, host, path,
       CASE {" ".join(f"WHEN {f} THEN '{t}'" for _, t, f in parts)} END AS rule,
       CASE {" ".join(f"WHEN {f} THEN '{s}'" for s, _, f in parts)} WHEN {listed} THEN 'block' ELSE 'allow' END AS verdict
FROM p"""


ORACLE = _oracle()
