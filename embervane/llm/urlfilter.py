"""URL filters: a blocked Bloom filter in front of an exact hash join.

The list (rules of a host and a path prefix, each with a verdict) becomes a
blocked Bloom filter: an array of 64-bit blocks, three bits a key, all three in
the block its hash names.  A URL's candidate keys are its host's suffixes (up to
the most labels a listed host has) with its path's prefixes (of the lengths that
listed paths have); keys that the filter lets pass are hash-joined with the list,
which removes false positives.  The longest rule that fits wins.

Everything is a built-in expression.  The filter reaches the executors as a
scalar subquery; its size is proportional to the list (16 bits a key) and is
refused above ``MAX_BLOOM_KEYS`` keys, and the list is broadcast only below
``MAX_BROADCAST_KEYS`` rows (else the join shuffles the few passing keys).

Defined results: a null URL or one without ``://`` has an empty host and path,
no rule and the verdict of an unlisted URL; repeated rows stay repeated; other
columns are dropped; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, local_rows, read

MAX_BLOOM_KEYS = 1 << 24
MAX_BROADCAST_KEYS = 100_000

#: The rules of the query's contract: (host, path prefix, verdict).
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
#: Listed hosts behind the rules: where no rule fits, a URL below one of these is blocked.
LISTED = tuple((f"{name}.example.{top}", "/", "block") for name in ("cheap-pills", "spam-farm") for top in ("com", "net", "org"))


def host_col(url):
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1))


def path_col(url):
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def rule_frame(spark: SparkSession, rules: Sequence[tuple[str, str, str]], tier: int) -> DataFrame:
    """A list as rows of (key, rule, verdict, tier); a key is the host, a line feed and the path."""
    rows = [(f"{h}\n{p}", f"{h}{p}", v, tier, len(h) + len(p), h.count(".") + 1, len(p)) for h, p, v in rules]
    return local_rows(spark, rows, "key string, rule string, verdict string, tier int, size int, labels int, path_len int")


def _block(key, n_blocks):
    return F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("int")


def _bits(key):
    h = F.xxhash64(key, F.lit(1))
    return [F.pmod(F.shiftright(h, s), F.lit(64)).cast("int") for s in (0, 16, 32)]


def _mask(key):
    a, b, c = _bits(key)
    one = F.lit(1).cast("long")
    sl = lambda n: F.call_function("shiftleft", one, n)
    return sl(a).bitwiseOR(sl(b)).bitwiseOR(sl(c))


def bloom(keys: DataFrame, n_blocks: int) -> DataFrame:
    """One row, one column ``blocks``: the filter of ``keys.key``."""
    per = keys.groupBy(_block(F.col("key"), n_blocks).alias("b")).agg(F.bit_or(_mask(F.col("key"))).alias("m"))
    held = per.agg(F.map_from_entries(F.collect_list(F.struct("b", "m"))).alias("held"))
    return held.select(
        F.transform(F.sequence(F.lit(0), F.lit(n_blocks - 1)), lambda i: F.coalesce(F.try_element_at("held", i), F.lit(0).cast("long"))).alias("blocks")
    )


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", keep: Sequence[str] = ("page_id",), default: str = "allow") -> DataFrame:
    """(keep..., host, path, rule, verdict, listed) for every row of ``pages``.

    ``rules`` has the columns of :func:`rule_frame`; rows of the highest tier that
    fit decide (``rule`` is null unless its tier is 1), among them the longest.
    """
    shape = rules.agg(F.count("*").alias("n"), F.max("labels").alias("labels"), F.collect_set("path_len").alias("lens")).first()
    n_rules = shape["n"]
    if n_rules > MAX_BLOOM_KEYS:
        raise ValueError(f"{n_rules} listed keys; a filter of at most {MAX_BLOOM_KEYS} is built here")
    keep = [c for c in keep]
    base = pages.select(*[F.col(c) for c in keep], F.col(url_col).alias("_url"))
    base = base.withColumns({"host": host_col(F.col("_url")), "path": path_col(F.col("_url"))}).drop("_url")
    if not n_rules:
        return base.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default), "listed": F.lit(False)})
    n_blocks = 1 << max(2, (n_rules // 4).bit_length())
    lens = sorted(shape["lens"])

    labels = F.split("host", r"\.", -1)
    n = F.size(labels)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(n, F.lit(shape["labels"]))), lambda i: F.array_join(F.slice(labels, n - i + 1, i), ".")
    )
    prefixes = F.array_distinct(F.array_compact(F.array(*[F.when(F.length("path") >= k, F.substring("path", 1, k)) for k in lens])))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, F.lit("\n"), p))))
    blocks = bloom(rules.select("key").distinct(), n_blocks).scalar()
    probed = base.withColumn("_keys", keys).withColumn("_blocks", blocks)
    passed = F.filter(
        "_keys", lambda k: F.element_at("_blocks", _block(k, n_blocks) + 1).bitwiseAND(_mask(k)) == _mask(k)
    )
    probed = probed.withColumn("_hits", passed).drop("_keys", "_blocks")

    miss = probed.where(F.size("_hits") == 0).select(
        *keep, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"), F.lit(False).alias("listed")
    )
    group = [*keep, "host", "path"]
    hit = probed.where(F.size("_hits") > 0).groupBy(*group, "_hits").agg(F.count("*").alias("_copies"))
    exact = rules.select(F.col("key").alias("_key"), F.struct("tier", "size", "rule", "verdict").alias("_rule"))
    exact = F.broadcast(exact) if n_rules <= MAX_BROADCAST_KEYS else exact
    hit = hit.select(*group, "_copies", F.explode("_hits").alias("_key")).join(exact, "_key", "left")
    hit = hit.groupBy(*group, "_copies").agg(F.max("_rule").alias("_rule"))
    hit = hit.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    hit = hit.select(
        *group,
        F.when(F.col("_rule.tier") == 1, F.col("_rule.rule")).alias("rule"),
        F.coalesce(F.col("_rule.verdict"), F.lit(default)).alias("verdict"),
        F.coalesce(F.col("_rule.tier") == 0, F.lit(False)).alias("listed"),
    )
    return miss.unionByName(hit)


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = rule_frame(spark, RULES, 1).unionByName(rule_frame(spark, LISTED, 0))
    return judge_urls(read(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def _case(rules) -> str:
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    ranked = sorted(rules, key=lambda r: -(len(r[0]) + len(r[1])))
    return " ".join(f"WHEN {fits(h, p)} THEN '{{{h}|{p}|{v}}}'" for h, p, v in ranked)


SQL = f"""
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url FROM pages
), s AS (
  SELECT page_id,
         CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM u
), h AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM s
), r AS (
  SELECT page_id, host, path,
         CASE {_case(RULES)} END AS fit, CASE {_case(LISTED)} END AS listed
  FROM h
)
SELECT page_id, host, path,
       CASE WHEN fit IS NOT NULL THEN replace(regexp_extract(fit, '^.(.*)[|](.*)[|].*$', 1), '|', '') || regexp_extract(fit, '^.(.*)[|](.*)[|].*$', 2) END AS rule,
       CASE WHEN fit IS NOT NULL THEN regexp_extract(fit, '[|]([a-z]*).$', 1)
            WHEN listed IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
