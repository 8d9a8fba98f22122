"""Secret scans: base patterns, then how widely each value is owned.

Base spans are the leftmost non-overlapping matches of three patterns.  A
match's place follows from the text's split by the same pattern: it ends after
all gaps and matches up to it.

The method: every candidate value is hashed, and the hashes are aggregated by
distinct repositories and distinct owners over the whole corpus (distinct pairs
first, so that a value which a third of all rows copy is pre-aggregated where it
is read).  Occurrences of a value are its base spans and its *bare* copies, tokens
that repeat it without a name before them; all of them count.  A value that more than ``max_owners`` owners or more than ``max_repos``
repositories hold is a widely copied example (``shared``), be it under one owner;
any other is owner-specific and, if it has at least ``min_distinct`` different
characters, ``live``.  Both numbers are returned for every span whose value is known.  The method adds spans of kind
``bare``: tokens outside base spans that repeat a live value.

Bare tokens are maximal runs of ``[A-Za-z0-9+/_.-]`` without the dots at their ends, of ``MIN_BARE`` characters
or more.  They are compared with values without the dots and equals signs at their ends, so padding and a full stop don't
matter.  Two things are not found bare: a value spelled like a plain word (letters in one case, or capitalised), which
can't be told from the word, and one with an equals sign inside.

A text's spans are prefix sums over its matches, folded in blocks of the square root of their number, and the
corpus-wide part handles one row for each span: memory is linear in the spans of a text.

DataFrame expressions only.  Defined results: a null text is empty; repeated
rows stay repeated, each with its own spans; a null owner or repository counts
as one more; other columns are dropped; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bloom, cut, read

KINDS = ("assign", "access", "hex", "bare")
# "Letters in either case" means A-Z and a-z: Java's (?i) folds ASCII only.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# A run that is long enough is the whole match of the open-ended pattern.
ACCESS = r"(AKIA)([A-Z0-9]{16,})"
HEX = r"(?<![0-9a-f])()([0-9a-f]{24,})"
# A run without the dots at its ends, unless it is a plain word; possessive or anchored at its start, so linear.
BARE = (
    r"(?<![A-Za-z0-9+/_.-])(\.*+)(?!(?:[A-Z]?[a-z]++|[A-Z]++)\.*+(?![A-Za-z0-9+/_.-]))"
    r"([A-Za-z0-9+/_-](?:[A-Za-z0-9+/_.-]*[A-Za-z0-9+/_-])?)"
)
MIN_ASSIGN, MIN_BARE = 6, 6

SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"
HELD = "array<struct<start:int,kind:int,end:int,owners:bigint,repos:bigint>>"


def _let(value, body):
    """``body(value)`` with the value bound once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values, fold):
    """For each place of an array of integers, ``fold`` of all values up to it, where fold(array) is a sum or a maximum (of none: null).

    Blocks of the square root of the array's size are folded first, so n values cost n ** 1.5 steps and no copies of what has been built.
    """

    def blocked(xs):
        size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(xs))).cast("int"))
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / size).cast("int")), lambda b: F.slice(xs, b * size + 1, size))
        return _let(F.struct(blocks.alias("blocks"), F.transform(blocks, fold).alias("folds")), joined)

    def joined(z):
        before = lambda i: fold(F.slice(z["folds"], F.lit(1), i))
        inner = lambda x, at: F.transform(x, lambda v, j: fold(F.array(at, fold(F.slice(x, F.lit(1), j + 1)))))
        return F.flatten(F.transform(z["blocks"], lambda x, i: _let(F.coalesce(before(i), F.lit(0)), lambda at: inner(x, at))))

    return F.when(F.size(values) > 0, _let(values, blocked)).otherwise(F.array().cast("array<int>"))


def _sum(values):
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _spans(text, pattern: str, kind: int, group: int, min_value: int, maybe, inner: bool = False):
    """Where ``maybe`` (a cheap test that no match fails) holds: matches of ``pattern`` whose group 2 has ``min_value`` characters,
    as spans with the value of group ``group``; an ``inner`` span is that of group 2, at the match's end."""
    lit = F.lit(pattern)
    row = F.struct(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, lit, F.lit(0)).alias("all"), F.regexp_extract_all(text, lit, F.lit(2)).alias("val")
    )

    def placed(r):
        steps = F.zip_with(r["gap"], r["all"], lambda g, m: F.length(g) + F.coalesce(F.length(m), F.lit(0)))
        return _let(running(steps, _sum), lambda ends: F.filter(F.transform(r["all"], lambda m, i: span(r, ends, m, i)), lambda s: s["start"] >= 0))

    def span(r, ends, match, i):
        value = F.get(r["val"], i)
        start = F.get(ends, i) - F.length(value if inner else match)
        fits = F.length(value) >= min_value
        return F.struct(
            F.when(fits, start).otherwise(F.lit(-1)).alias("start"), F.lit(kind).alias("kind"), F.get(ends, i).alias("end"), (value if group == 2 else match).alias("value")
        )

    return F.when(maybe & text.rlike(pattern), _let(row, placed).cast(SPAN)).otherwise(F.array().cast(SPAN))


def base_spans(text):
    """All base spans of a text, by start, then kind as listed."""
    return F.array_sort(
        F.concat(
            _spans(text, ASSIGN, 0, 2, MIN_ASSIGN, text.contains("=") | text.contains(":")),
            _spans(text, ACCESS, 1, 0, 1, text.contains("AKIA")),
            _spans(text, HEX, 2, 2, 1, F.lit(True)),
        )
    )


def _joined(spans):
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    repo_col: str = "doc_id",
    max_owners: int = 3,
    max_repos: int = 10,
    min_distinct: int = 6,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """id, keep..., base array of spans, extra array of spans, live array of spans (base or bare), held for each row.

    A span is struct(start, kind index in KINDS, end, value); offsets are code points.  ``held`` has, for each
    base span and each bare copy of a base span's value, struct(start, kind, end, owners, repos).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("_id"),
        *[F.col(c).alias(f"_k_{c}") for c in keep],
        F.coalesce(F.col(owner_col).cast("string"), F.lit("\0")).alias("_owner"),
        F.coalesce(F.col(repo_col).cast("string"), F.lit("\0")).alias("_repo"),
        base_spans(text).alias("_base"),
        _spans(text, BARE, 3, 2, MIN_BARE, F.lit(True), inner=True).alias("_bare"),
    )
    rows = cut(rows)  # the texts are scanned once
    hashed = lambda s: F.xxhash64(_canonical(s["value"]))

    # Of bare tokens, those stay that may repeat a value.
    values = rows.select(F.explode("_base").alias("s")).select(hashed(F.col("s")).alias("_h"), F.col("s.value").alias("_v"))
    values = cut(values.groupBy("_h").agg(F.min("_v").alias("_v")))
    maybe = bloom(values, ["_h"])
    rows = rows.withColumn("_bare", F.filter("_bare", lambda s: maybe(F.xxhash64(hashed(s)))))
    quiet = rows.where((F.size("_base") == 0) & (F.size("_bare") == 0))
    loud = rows.where((F.size("_base") > 0) | (F.size("_bare") > 0))

    # Equal rows are judged once and counted.  Their spans travel one by one, each with no more of its row than a hash of 128 bits.
    whole = ["_id", *[f"_k_{c}" for c in keep], "_owner", "_repo", "_base", "_bare"]
    key = ["_row", "_again"]
    loud = loud.withColumn("_row", F.xxhash64(*whole)).withColumn("_again", F.xxhash64(F.lit(1), *whole))
    loud = loud.groupBy(*key).agg(F.count("*").alias("_copies"), *[F.first(c).alias(c) for c in whole])
    loud = cut(loud)
    spans = loud.select(*key, "_owner", "_repo", F.explode(F.concat("_base", "_bare")).alias("s")).select("*", hashed(F.col("s")).alias("_h"))

    pairs = spans.join(values.select("_h"), "_h", "left_semi").select("_h", "_owner", "_repo").distinct()
    owners = pairs.select("_h", "_owner").distinct().groupBy("_h").agg(F.count("*").alias("_owners"))
    repos = pairs.select("_h", "_repo").distinct().groupBy("_h").agg(F.count("*").alias("_repos"))
    letters = F.size(F.array_distinct(F.split(F.col("_v"), "")))
    own = (F.col("_owners") <= max_owners) & (F.col("_repos") <= max_repos)
    owned = values.join(owners, "_h").join(repos, "_h").select("_h", "_owners", "_repos", (own & (letters >= min_distinct)).alias("_live"))
    owned = cut(owned)  # written, so that Spark may split a value which very many spans hold

    told = F.struct("s.start", "s.kind", "s.end", "s.value", F.col("_owners").alias("owners"), F.col("_repos").alias("repos"), F.col("_live").alias("live"))
    judged = spans.join(owned, "_h", "left").groupBy(*key).agg(F.array_sort(F.collect_list(told)).alias("all"))
    # A token that lies in a base span isn't a new one: the base spans that start up to it end before its end.
    ends = running(F.transform("all", lambda x: F.when(x["kind"] < 3, x["end"]).otherwise(0)), F.array_max)
    new = lambda z: F.filter(z["all"], lambda x, i: (x["kind"] < 3) | (x["owners"].isNotNull() & (F.get(z["ends"], i) < x["end"])))
    judged = judged.withColumn("all", _let(F.struct("all", ends.alias("ends")), new))
    judged = loud.drop("_base", "_bare").join(judged, key)
    judged = judged.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    of = lambda test, kind=SPAN: F.transform(F.filter("all", test), lambda x: _part(x, kind)).cast(kind)
    kept = [F.col("_id").alias(id_col), *[F.col(f"_k_{c}").alias(c) for c in keep]]
    out = judged.select(
        *kept,
        of(lambda x: x["kind"] < 3).alias("base"),
        of(lambda x: x["live"] & (x["kind"] == 3)).alias("extra"),
        of(lambda x: x["live"]).alias("live"),
        of(lambda x: x["owners"].isNotNull(), HELD).alias("held"),
    )
    none = F.array().cast(SPAN)
    return out.unionByName(quiet.select(*kept, none.alias("base"), none.alias("extra"), none.alias("live"), F.array().cast(HELD).alias("held")))


def _part(x, kind: str):
    return F.struct(*[x[name].alias(name) for name in (("start", "kind", "end", "value") if kind == SPAN else ("start", "kind", "end", "owners", "repos"))])


def _canonical(value):
    """What values and bare tokens are compared by."""
    return F.regexp_replace(value, r"^[.=]+|(?<![.=])[.=]+$", "")


#: Code points of a text's block: a piece of the text is cut out of the blocks it lies in.
BLOCK = 4096


def redact(text, spans, mask: str = "[REDACTED]"):
    """``text`` with every span (sorted by start; overlaps merge) replaced by ``mask``.

    Each gap between spans is cut from its own blocks of the text, so the cost grows with the text and the number of spans, not their product.
    """

    def cleaned(z):
        part = lambda a, b: F.when(
            b > a,
            F.substr(F.array_join(F.slice(z["blocks"], F.floor(a / BLOCK).cast("int") + 1, F.floor((b - 1) / BLOCK).cast("int") - F.floor(a / BLOCK).cast("int") + 1), ""), a % BLOCK + 1, b - a),
        ).otherwise(F.lit(""))
        before = lambda i: F.when(i > 0, F.get(z["ends"], i - 1)).otherwise(F.lit(0))
        gaps = F.transform(z["spans"], lambda s, i: F.when(s["start"] >= before(i), F.concat(part(before(i), s["start"]), F.lit(mask))).otherwise(F.lit("")))
        return F.concat(F.array_join(gaps, ""), part(F.array_max(z["ends"]), z["size"]))

    ends = running(F.transform(spans, lambda s: s["end"]), F.array_max)
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    done = _let(F.struct(spans.alias("spans"), ends.alias("ends"), blocks.alias("blocks"), F.length(text).alias("size")), cleaned)
    return F.when(F.size(spans) > 0, done).otherwise(text)


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", "extra"))).alias("spans"),
        F.size("live").cast("long").alias("n_live"),
    )
