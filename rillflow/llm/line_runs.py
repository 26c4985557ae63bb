"""Line dedup by levelled sorted runs of line hashes; DataFrame functions only.

A run is a Parquet table of (h1, h2, n_docs), one row a line key, partitioned
and sorted by the hash. A batch of documents comes as the counts of its line
keys. Keys that have reached the limit in a run are settled: the batch
merge-anti-joins them, so that they are carried no further, and adds what is
left as a run of level 0; `fan_out` runs of a level are compacted into one of
the next. A line is dropped if its key reaches the limit over all runs. A key is
128 bits of hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm.storage import remove, shared_path

#: The white space that a key loses at both ends.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_lines(text: Column) -> Column:
    """The lines of a text; a null or empty text is one empty line."""
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def line_keys(text: Column) -> Column:
    """The keys of a text's lines: without white space at the ends and with A-Z lower-cased, nothing else.

    One transform a step, so that each step is evaluated once a line.
    """
    bare = F.transform(split_lines(text), lambda line: F.trim(line, F.lit(BLANKS)))
    # Lower-casing of ASCII text changes A-Z alone and is much faster than translate.
    return F.transform(bare, lambda line: F.when(F.length(line) == F.octet_length(line), F.lower(line)).otherwise(F.translate(line, UPPER, LOWER)))


def hashes(text: Column, min_length: int, distinct: bool = False) -> Column:
    """struct(h1, h2) of each line's key, or of each `distinct` one; null for keys under `min_length` code points."""
    keys = F.array_distinct(line_keys(text)) if distinct else line_keys(text)  # strings: distinct structs would take quadratic time
    pair = lambda key: F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2"))
    return F.transform(keys, lambda key: F.when(F.length(key) >= min_length, pair(key)))


class LineRuns:
    """The runs of one store for lines found in `min_docs` documents or more; `path` is in a shared folder."""

    def __init__(self, spark: SparkSession, min_docs: int, path: str | None = None, fan_out: int = 4, min_length: int = 1):
        self.spark, self.path, self.min_docs = spark, path or shared_path(spark, "line-runs"), min_docs
        self.fan_out, self.min_length = fan_out, max(1, min_length)
        self.levels: list[list[str]] = [[]]
        self.made = 0

    def _write(self, counts: DataFrame, level: int) -> str:
        path = f"{self.path}/level={level}/run={self.made}"
        self.made += 1
        counts.sortWithinPartitions("h1", "h2").write.parquet(path)
        return path

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema("h1 long, h2 long, n_docs long").parquet(*paths)

    def _runs(self) -> list[str]:
        return [path for level in self.levels for path in level]

    def add_all(self, docs: DataFrame, batches: int) -> None:
        """Add a table in `batches` parts by hash of the id; its texts are read once."""
        own = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch"), self._keys().alias("h"))
        counts = own.select("batch", F.explode("h").alias("h")).groupBy("batch", "h.h1", "h.h2").agg(F.count(F.lit(1)).alias("n_docs"))
        path = f"{self.path}/counts"
        counts.write.partitionBy("batch").parquet(path)
        for batch in range(batches):
            self.add_counts(self.spark.read.schema("h1 long, h2 long, n_docs long, batch int").parquet(path).where(F.col("batch") == batch).drop("batch"))
        remove(self.spark, path)

    def _keys(self) -> Column:
        """The distinct line keys of a document."""
        return F.filter(hashes(F.col("text"), self.min_length, distinct=True), lambda h: h.isNotNull())

    def add(self, docs: DataFrame) -> None:
        """Add the line keys of a batch: each row is a document and counts once for each of its keys."""
        self.add_counts(docs.select(F.explode(self._keys()).alias("h")).groupBy("h.h1", "h.h2").agg(F.count(F.lit(1)).alias("n_docs")))

    def add_counts(self, counts: DataFrame) -> None:
        """Add a batch of (h1, h2, n_docs), each key once."""
        if self._runs():
            settled = self._read(self._runs()).where(F.col("n_docs") >= self.min_docs).select("h1", "h2")
            counts = counts.join(settled.hint("merge"), ["h1", "h2"], "left_anti")
        self.levels[0].append(self._write(counts, 0))
        level = 0
        while len(self.levels[level]) >= self.fan_out:
            self._compact(level)
            level += 1

    def _compact(self, level: int) -> None:
        if len(self.levels) == level + 1:
            self.levels.append([])
        old = self.levels[level]
        merged = self._read(old).groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"))
        self.levels[level + 1].append(self._write(merged, level + 1))
        self.levels[level] = []
        for path in old:
            remove(self.spark, path)

    def frequent(self) -> DataFrame:
        """The keys (h1, h2) found in at least `min_docs` documents of all runs."""
        paths = self._runs()
        runs = self._read(paths)
        if len(paths) > 1:
            runs = runs.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"))
        return runs.where(F.col("n_docs") >= self.min_docs).select("h1", "h2")

    def clean(self, docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
        """The documents without the lines of frequent keys: doc_id, the columns to `carry`, n_lines, n_dropped and kept_text.

        The lines go to the join as hashes with their place; the places to drop
        come back to the text by the document's id and text hash, so repeated
        rows of a document get the same result.
        """
        docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), *(F.col(c).alias(f"carried_{c}") for c in carry))
        docs = docs.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
        lines = docs.select("doc_id", "text_hash", F.posexplode(hashes(F.col("text"), self.min_length)).alias("at", "h")).where("h IS NOT NULL")
        # What the anti-join takes out of a document is what the semi-join finds in it.
        hits = lines.select("doc_id", "text_hash", "at", "h.h1", "h.h2").join(self.frequent().hint("merge"), ["h1", "h2"], "left_semi")
        drops = hits.groupBy("doc_id", "text_hash").agg(F.collect_set("at").alias("drops"))
        same = F.col("d.doc_id").eqNullSafe(F.col("x.doc_id")) & (F.col("d.text_hash") == F.col("x.text_hash"))
        joined = docs.alias("d").join(drops.alias("x"), same, "left").select("d.*", "x.drops")
        joined = joined.withColumn("parts", split_lines(F.col("text")))  # split once a text, not once a line
        parts = F.col("parts")
        kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("drops"))
        return joined.select(
            "doc_id",
            *(F.col(f"carried_{c}").alias(c) for c in carry),
            F.size(parts).cast("long").alias("n_lines"),
            F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"),
            F.when(F.col("drops").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n")).alias("kept_text"),
        )


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_length: int = 1, batches: int = 4, fan_out: int = 4, carry: tuple[str, ...] = ()) -> DataFrame:
    """All documents without the lines whose keys stand in at least `min_docs` of them.

    The table is added to a new store in `batches` parts by hash of the id; with
    the counts complete, every line is judged. A document is a row: repeated
    rows count repeatedly. A null or empty text is one empty line and stays; a
    null doc_id is an id like any other; further columns are ignored unless
    `carry` names them, which must not be named like the columns of the result.
    Returns doc_id, the carried columns, n_lines, n_dropped, kept_text, a row for
    each row; an empty table gives none.
    """
    runs = LineRuns(docs.sparkSession, min_docs, None, fan_out, min_length)
    runs.add_all(docs, batches)
    return runs.clean(docs, carry)
