"""URL rules by a Bloom filter cascade; DataFrame functions only.

Rules name a host and a path prefix. Every URL gives candidate keys: each
suffix of its host at a label bound, joined with each path prefix of a length
that occurs among the rules. These keys are the universe. Level 0 of a cascade
is a Bloom filter of the listed keys; level 1 holds the universe's false
positives at level 0, level 2 the listed keys that level 1 takes for those, and
so on until a level errs on nothing. A key is listed if the first level without
it is an odd one. That is exact for every key of the universe and needs no join.

A list whose filters would take more than `max_bytes` is cut into slices by the
hash of its keys, each with a cascade of its own; the slices are built and asked
one after another, so neither the driver nor a plan ever holds more than the
filters of one slice.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm.storage import Scratch, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The most bytes of filters that one plan holds.
MAX_FILTER_BYTES = 4 << 20
#: The rate of false positives of levels after the first.
LAST_RATE = 0.5


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first `://` up to `/ ? #`, with A-Z lower-cased; path from there up to `?` or `#`."""
    url = url.cast("string")
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def host_suffixes(host: Column) -> Column:
    """The host and what follows each of its dots."""
    labels = F.split(host, "\\.", -1)
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """struct(key, rule): every (host suffix, path prefix) of a rule's path length; the key marks where the path begins."""
    cuts = F.array(*[F.lit(n) for n in lengths])

    def of(suffix):
        fitting = F.filter(cuts, lambda n: F.length(path) >= n)
        return F.transform(fitting, lambda n: F.struct(F.concat(suffix, F.lit("\x00"), F.substring(path, F.lit(1), n)).alias("key"), F.concat(suffix, F.substring(path, F.lit(1), n)).alias("rule")))

    return F.flatten(F.transform(host_suffixes(host), of))


def literal_rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A few rows as a table, made from a literal by the JVM alone."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("r")).select("r.*")


class Level:
    """A Bloom filter as 64-bit words that go to the executors as a literal of the plan."""

    def __init__(self, keys: DataFrame, n: int, rate: float, number: int):
        self.number = number
        self.words = filter_words(n, rate)
        self.hashes = max(1, round(-math.log2(rate)))
        bit = keys.select(F.explode(self.positions(F.col("key"))).alias("bit"))
        filled = bit.groupBy(F.expr("bit div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, int(bit % 64)))").alias("value"))
        found = {r["word"]: r["value"] for r in filled.collect()}  # at most `words` rows
        # One string that the optimizer folds into an array literal.
        self.literal = F.from_json(F.lit(str([found.get(i, 0) for i in range(self.words)])), "array<bigint>")

    def positions(self, key: Column) -> Column:
        """The bits of a key, by double hashing."""
        total = F.lit(self.words * 64)
        first = F.pmod(F.xxhash64(F.lit(self.number), key), total)
        second = F.pmod(F.xxhash64(F.lit(-1 - self.number), key), total)
        return F.array(*[F.pmod(first + second * F.lit(i), total) for i in range(self.hashes)])

    def holds(self, key: Column) -> Column:
        return F.forall(self.positions(key), lambda bit: F.getbit(F.get(self.literal, F.floor(bit / 64).cast("int")), (bit % 64).cast("int")) == 1)


def filter_words(n: int, rate: float) -> int:
    """The 64-bit words of a filter of `n` keys."""
    return max(1, math.ceil(max(1, n) * -math.log(rate) / math.log(2) ** 2 / 64))


class Cascade:
    """Exact membership of the universe's keys of one slice among listed ones."""

    def __init__(self, listed: DataFrame, n: int, universe: DataFrame, universe_size: int, scratch: Scratch, number: int = 0, slices: int = 1):
        """`listed`: `n` distinct keys of this slice; `universe`: keys of any slice, not needed distinct; its size only sets the first rate."""
        self.number, self.slices = number, slices
        self.levels: list[Level] = []
        inside, outside = listed, universe.where(self.owns(F.col("key")))
        rate = first_rate(n, universe_size)
        while n:
            level = Level(inside, n, rate, len(self.levels))
            self.levels.append(level)
            wrong = outside.where(level.holds(F.col("key")))
            if len(self.levels) == 1:  # the listed keys of the universe are right
                marked = wrong.select("key", F.lit(0).alias("good")).union(listed.select("key", F.lit(1)))
                wrong = marked.groupBy("key").agg(F.max("good").alias("good")).where("good = 0")
            wrong = scratch.write(wrong.select("key"), narrow=True)  # level 0: about n of the universe; later ever fewer
            inside, outside, n, rate = wrong, inside, wrong.count(), LAST_RATE

    def owns(self, key: Column) -> Column:
        """Whether a key is of this slice."""
        return key.isNotNull() if self.slices == 1 else slice_of(key, self.slices) == self.number

    def holds(self, key: Column) -> Column:
        """Whether a key of the universe is in this slice and listed."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for i, level in reversed(list(enumerate(self.levels))):
            answer = F.when(~level.holds(key), F.lit(i % 2 == 1)).otherwise(answer)
        return self.owns(key) & answer


def slice_of(key: Column, slices: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("slice"), key), F.lit(slices)).cast("int")


def first_rate(n: int, universe_size: int) -> float:
    """The rate of level 0 at which about as many of the universe err as are listed."""
    return min(LAST_RATE, max(1e-9, n / (math.sqrt(2) * max(1, universe_size))))


def sliced(listed: DataFrame, universe: DataFrame, universe_size: int, scratch: Scratch, max_bytes: int):
    """The cascades of `listed` (key) over `universe` (key), slice by slice; each is made when it is asked for."""
    keys = scratch.write(listed.select("key").where("key IS NOT NULL").distinct(), narrow=True)
    n = keys.count()
    # Level 0, and about three bits a key for all others.
    size = 8 * filter_words(n, first_rate(n, universe_size)) + n * 3 // 8
    slices = max(1, -(-size // max(1, max_bytes)))
    if slices == 1:
        yield Cascade(keys, n, universe, universe_size, scratch)
        return
    dealt = scratch.write(keys.select("key", slice_of(F.col("key"), slices).alias("slice")).repartition("slice").sortWithinPartitions("slice"))
    for number in range(slices):
        own = dealt.where(F.col("slice") == number).select("key")
        yield Cascade(own, own.count(), universe, universe_size // slices, scratch, number, slices)


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, id_column: str = "page_id", default: str = "allow", max_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """Each page's host, path, the rule that decides about its URL, and the verdict.

    `rules`: (verdict, host, path prefix), verdict `allow` or `block`, as a list
    or a table of these columns (verdict, host, path). A rule fits its host and
    all subdomains where the path starts with its own; the longest wins, and
    `block` between equal ones. A URL that no rule fits is on no list: it gets
    `default`. A null URL, or one without `://`, has an empty host and path.
    Repeated rows give repeated results, an empty table or list none or the
    default; further columns are ignored.

    One cascade says which keys are rules, over the keys of all pages; another,
    over the rules, which of these block. Pages are read twice, and twice more
    for each further slice of `max_bytes`, with what was found so far beside them.
    """
    spark = pages.sparkSession
    host, path = url_parts(F.col("url"))
    base = pages.select(F.col(id_column).alias(id_column), host.alias("host"), path.alias("path"))
    if isinstance(rules, list):
        rules = literal_rows(spark, [dict(zip(("verdict", "host", "path"), r)) for r in rules], "verdict string, host string, path string")
    scratch = Scratch(spark)
    rules = scratch.write(rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IN ('allow', 'block')").select(F.concat("host", F.lit("\x00"), "path").alias("key"), F.length("path").alias("n"), "verdict"), narrow=True)
    lengths = [r["n"] for r in rules.select("n").distinct().orderBy("n").collect()]  # at most as many as a URL is long
    if not lengths:
        scratch.close()
        return base.select(id_column, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    candidates = candidate_keys(F.col("host"), F.col("path"), lengths)
    universe = base.select(F.explode(candidates.getField("key")).alias("key"))
    size = pages.count() * len(lengths) * 3  # a host has about three suffixes

    def best(found: Column, verdict) -> Column:
        """The longest of the rules found: structs compare by length, then by host length."""
        return F.array_max(F.transform(found, lambda c: F.struct(F.length(c["rule"]).alias("n"), F.instr(c["key"], "\x00").alias("host_n"), verdict(c["key"]).alias("verdict"), c["rule"].alias("rule"))))

    judged = base.withColumn("best", F.lit(None).cast("struct<n:int,host_n:int,verdict:string,rule:string>"))
    several = False
    for cascade in sliced(rules.select("key"), universe, size, scratch, max_bytes):
        # The rules of the slice, all of them known, are the second cascade's universe.
        known = rules.where(cascade.owns(F.col("key")))
        block = known.where("verdict = 'block'").select("key").distinct()
        n = block.count()
        blocks = Cascade(block, n, known.select("key"), 2 * n, scratch)
        found = F.filter(candidates, lambda c: cascade.holds(c["key"]))  # noqa: B023
        here = best(found, lambda key: F.when(blocks.holds(key), "block").otherwise("allow"))  # noqa: B023
        if several:
            judged = written(judged, "judged")
        judged = judged.withColumn("best", F.greatest("best", here))
        several = True
    result = judged.select(id_column, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    # The filters are literals of the plan by now; the tables they came from aren't read again.
    scratch.close()
    return result


def listed_keys(keys: DataFrame, listed: DataFrame, max_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """The rows of `keys` (key, ...) whose key is listed, by cascades of at most `max_bytes`; null keys aren't."""
    scratch = Scratch(keys.sparkSession)
    found = None
    for cascade in sliced(listed, keys.select("key"), keys.count(), scratch, max_bytes):
        own = keys.where(cascade.holds(F.col("key")))
        found = own if found is None else found.union(own)
    scratch.close()
    return found
