"""URL filtering by host and path rules.

A rule is a host and a path; it fits its host and all subdomains when the URL's
path starts with the rule's path.  The longest fitting rule decides.

A URL can be listed only under one of its keys: a suffix of its host at a label
border, joined with a beginning of its path of a length that some rule has.  The
keys are tested against a blocked Bloom filter of all rules (one block of 256
bits for each key, eight bits set in it); a block is fetched by an equi-join on
its number.  What passes is a possible hit and goes to an exact hash join with
the rules, which removes false positives.  The method's own list of words goes
the same way as a second kind of key, the words of a host's labels; its hits set
the verdict where no rule fits, and name no rule.

Everything is DataFrame functions.  The filter has a block for ``PER_BLOCK``
listed keys; blocks and rules are broadcast up to a checked number and
otherwise joined by hash.  Only possible hits are shuffled, and pages meet their
results by a key of their own, so a popular URL loads no single task.  The
lengths of rule paths are bounded by the longest path of a rule.

Canonical form: the host lower-cased in A-Z, the path as it stands; query and
fragment are cut.  Defined cases: a null URL or one without ``://`` has an empty
host and path, no rule and the verdict of ``default``; repeated rows give a row
each; of rules with one key that disagree, ``block`` wins; a rule without a host
fits nothing; an empty table or rule list is allowed; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .exact_dedup import LOWER, UPPER
from .rows import KEY, keyed

#: The rules of the contract, then the list of the method's own.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: Words that mark unwanted sites where they stand in a host as a label or a
#: hyphenated part of one; rules of the contract go before them.
LISTED_WORDS = "adult ads adserver bet bets betting casino gambling malware payday phishing pills poker porn sex spam tracker viagra warez xxx".split()
PER_BLOCK = 16
#: Blocks of the filter and rules that are broadcast at most.
BROADCAST_BLOCKS = 1 << 16
BROADCAST_RULES = 100_000
WORDS = 4
BITS = 8


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "verdict string, host string, path string")


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def _place(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _masks(key: Column) -> list[Column]:
    """The key's bits in each word of its block: two of 64 in each of four."""
    out = []
    for w in range(WORDS):
        h = F.xxhash64(key, F.lit(w + 1))
        one = F.lit(1).cast("long")
        out.append(F.call_function("shiftleft", one, F.pmod(h, F.lit(64)).cast("int")).bitwiseOR(F.call_function("shiftleft", one, F.pmod(F.shiftrightunsigned(h, 20), F.lit(64)).cast("int"))))
    return out


#: Kinds of keys.
RULE, WORD = 0, 1


def filter_blocks(keys: int) -> int:
    """A power of two, so that about half of a block's bits are set at most."""
    return max(64, 1 << (max(keys, 1) // PER_BLOCK).bit_length())


def build_filter(rules: DataFrame, blocks: int) -> DataFrame:
    """Blocked Bloom filter of keys (host, path): at most ``blocks`` rows (block, w0..w3)."""
    key = F.concat("host", "path")
    masks = rules.select(_place(key, blocks).alias("block"), *(m.alias(f"w{i}") for i, m in enumerate(_masks(key))))
    return masks.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)))


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", id_col: str = "page_id", listed_words: list[str] = LISTED_WORDS, default: str = "allow", blocks: int | None = None) -> DataFrame:
    """Per page: host, path, rule, verdict."""
    rules = rules.where("host <> '' and path is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())
    own = rules.sparkSession.createDataFrame([(x,) for x in dict.fromkeys(listed_words)], "host string")
    listed = rules.select(F.lit(RULE).alias("kind"), "host", "path", "verdict").unionByName(own.select(F.lit(WORD).alias("kind"), "host", F.lit("").alias("path"), F.lit("block").alias("verdict")))
    n_listed = listed.count()
    blocks = blocks or filter_blocks(n_listed)
    small = lambda frame, ok: F.broadcast(frame) if ok else frame

    host, path = host_and_path(F.col(url_col).cast("string"))
    urls = keyed(pages).select(KEY, F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.filter(F.lit(lengths).cast("array<int>"), lambda n: n <= F.length("path"))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(starts, lambda n: F.struct(F.lit(RULE).alias("kind"), s.alias("h"), n.alias("n")))))
    if listed_words:
        words = F.array_distinct(F.split("host", r"[.\-]"))
        keys = F.concat(keys, F.transform(words, lambda x: F.struct(F.lit(WORD).alias("kind"), x.alias("h"), F.lit(0).alias("n"))))
    tried = urls.select(KEY, "path", F.explode(keys).alias("k")).select(KEY, F.col("k.kind").alias("kind"), F.col("k.h").alias("rule_host"), F.expr("left(path, k.n)").alias("rule_path"))
    key = F.concat("rule_host", "rule_path")
    possible = tried.withColumn("block", _place(key, blocks)).join(small(build_filter(listed, blocks), blocks <= BROADCAST_BLOCKS), "block")
    for i, mask in enumerate(_masks(key)):
        possible = possible.where(F.col(f"w{i}").bitwiseAND(mask) == mask)
    listed = listed.withColumnsRenamed({"host": "rule_host", "path": "rule_path"})
    hits = possible.select(KEY, "kind", "rule_host", "rule_path").join(small(listed, n_listed <= BROADCAST_RULES), ["kind", "rule_host", "rule_path"])
    rule = F.concat("rule_host", "rule_path")
    best = F.max(F.when(F.col("kind") == RULE, F.struct(F.length(rule).alias("length"), rule.alias("rule"), "verdict")))
    by_word = F.max(F.when(F.col("kind") == WORD, F.col("verdict")))
    found = hits.groupBy(KEY).agg(best.alias("best"), by_word.alias("own"))
    verdict = F.coalesce("best.verdict", "own", F.lit(default))
    return urls.join(found, KEY, "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"))
