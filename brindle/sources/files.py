"""Reading and writing of mentions, labels, gold codes and tables."""

from __future__ import annotations

import atexit
import uuid
import warnings
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Partitions whose first positions make a table small enough to be broadcast.
MOST_BROADCAST = 100_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints, which all executors share.

    On one machine, where the session names none, it is a folder of the warehouse; on a cluster that is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


#: Folders that were made for a while, by the scopes they belong to; those of the first last until the process ends.
_SCOPES: list[list[tuple[SparkSession, str]]] = [[]]


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder; nothing happens if it isn't there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, which is removed when its scope ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _SCOPES[-1].append((spark, path))
    return path


@contextmanager
def scope() -> Iterator[None]:
    """What is checkpointed or put into scratch folders inside is removed at the end: results have to be written, elsewhere, before that."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for spark, path in _SCOPES.pop():
            discard(spark, path)


@atexit.register
def _end() -> None:
    while _SCOPES[0]:
        spark, path = _SCOPES[0].pop()
        try:
            discard(spark, path)
        except (Py4JError, OSError, AttributeError):  # the session has gone before, and cleans up as its settings say
            return


def checkpointed(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and cut its lineage. The files are removed when their scope ends."""
    spark = df.sparkSession
    shared_folder(spark)
    out = df.checkpoint(eager=True)
    held = out._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if held.isDefined():
        _SCOPES[-1].append((spark, held.get()))
    return out


def spread(df: DataFrame) -> DataFrame:
    """A table as read, dealt to all cores if it comes in fewer splits than there are; larger ones stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def with_position(df: DataFrame, name: str = "pos") -> DataFrame:
    """Number rows from 0 in the order in which they are read.

    Rows are written with their place in their partition, so that counts of partitions and places come from the same partitions,
    even where those of a second run would be others. Only the number of rows of each partition goes to the driver.
    """
    taken = {c.lower() for c in df.columns}
    mark = next(m for m in (f"_at{'_' * k}" for k in range(len(taken) + 1)) if m not in taken)
    held = checkpointed(df.withColumn(mark, F.monotonically_increasing_id()))
    part = F.shiftright(mark, 33)
    total, starts = 0, []
    for p, n in sorted(map(tuple, held.groupBy(part.alias("p")).count().collect())):
        starts.append((p, total))
        total += n
    begins = df.sparkSession.createDataFrame(starts, f"`{mark}p` long, `{mark}first` long")
    few = F.broadcast(begins) if len(starts) <= MOST_BROADCAST else begins
    joined = held.join(few, part == F.col(f"{mark}p"))
    return joined.withColumn(name, F.col(f"{mark}first") + F.col(mark).bitwiseAND((1 << 33) - 1)).drop(mark, f"{mark}p", f"{mark}first")


def read_lines(spark: SparkSession, path: str, name: str = "pos") -> DataFrame:
    """(value, name): lines of a file, or of all files of a folder by their names, numbered from 0 in that order.

    Lines are placed by file and by where their block starts in it, not by how blocks are put together into tasks. Only the number of lines of each block
    goes to the driver.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    held = checkpointed(lines)
    starts, total = [], 0
    for r in held.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("at")).orderBy("file", "block").toLocalIterator():
        starts.append((r["file"], r["block"], total - r["at"]))
        total += r["n"]
    moved = spark.createDataFrame(starts, "file string, block long, moved long")
    few = F.broadcast(moved) if len(starts) <= MOST_BROADCAST else moved
    return held.join(few, ["file", "block"]).select("value", (F.col("at") + F.col("moved")).alias(name))


#: White space at the ends of a line, as any text has it: tabs, control separators and signs of other scripts too.
_ENDS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, _ENDS, "")


def unquoted(field: Column) -> Column:
    """A field without the quotes around it; two quotes inside stand for one."""
    whole = field.rlike(r'(?s)^"(?:[^"]|"")*"$')
    return F.when(whole, F.replace(F.substring(field, 2, F.length(field) - 2), F.lit('""'), F.lit('"'))).otherwise(field)


def in_order(value: str, order: str) -> Column:
    """The group's values as an array, by order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value])


def group_texts(rows: DataFrame, key: str, text: str, order: str, missing: str = "") -> DataFrame:
    """All texts of a key, in order, as an array; null texts are empty, or what missing says."""
    return rows.withColumn(text, F.coalesce(F.col(text), F.lit(missing))).groupBy(key).agg(in_order(text, order).alias("corpus"))


def concat_texts(rows: DataFrame, key: str, text: str, order: str, missing: str = "") -> DataFrame:
    """All texts of a key, in order, joined by single spaces."""
    return group_texts(rows, key, text, order, missing).select(key, F.array_join("corpus", " ").alias(text))


def read_mentions(spark: SparkSession, path: str) -> DataFrame:
    """Rows (group_id, text, pos) of a tab-separated file, or of a folder of them, without a header. Ids are texts; fields may be quoted. Lines without an id go."""
    parts = F.split("value", "\t", 2)
    return read_lines(spark, path).select(unquoted(F.get(parts, 0)).alias("group_id"), F.coalesce(unquoted(F.get(parts, 1)), F.lit("")).alias("text"), "pos").filter("group_id != ''")


def read_grouped(spark: SparkSession, path: str, missing: str = "") -> DataFrame:
    """One row for each id, of any kind, with its texts joined: (group_id, text). A line's missing text is read as missing, which some want to be "nan"."""
    rows = read_mentions(spark, path).withColumn("text", F.nullif("text", F.lit("")))
    return concat_texts(rows, "group_id", "text", "pos", missing)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Stripped lines that aren't blank, with their place: (label_pos, label)."""
    lines = read_lines(spark, path).select("pos", stripped(F.col("value")).alias("label")).filter("label != ''")
    return ranked(lines, "pos", "label_pos").select("label_pos", "label")


def ranked(rows: DataFrame, order: str, name: str) -> DataFrame:
    """Place of each row by order, from 0. Rows are sorted by ranges over all tasks and numbered as they are then."""
    return with_position(rows.sort(order), name)


def attach_labels(grouped: DataFrame, labels: DataFrame, key: str = "group_id", truncate: int = 0, by_index: bool = False) -> DataFrame:
    """Give the groups (key, corpus) their labels (label_pos, label) by rank of the key, or by the key itself.

    More labels than groups are cut with a warning; fewer are an error. truncate keeps the first groups only.
    """
    placed = grouped.withColumnRenamed(key, "label_pos") if by_index else ranked(grouped, key, "label_pos").drop(key)
    groups, known = placed.count(), labels.count()
    if known < groups:
        raise ValueError(f"{groups} groups, but only {known} labels")
    if known > groups and not by_index:
        warnings.warn(f"{known - groups} labels without a group are left out", stacklevel=2)
    joined = placed.join(labels, "label_pos")
    return joined.filter(F.col("label_pos") < truncate) if truncate else joined


def read_labelled(spark: SparkSession, train: str, labels: str, truncate: int = 0, by_index: bool = False) -> DataFrame:
    """(label_pos, label, corpus) of a file of mentions and a file of labels."""
    rows = read_mentions(spark, train).withColumn("group_id", F.col("group_id").cast("long"))  # the order of groups is that of numbers
    grouped = group_texts(rows, "group_id", "text", "pos")
    return attach_labels(grouped, read_labels(spark, labels), truncate=truncate, by_index=by_index).select("label_pos", "label", "corpus")


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, codes): codes of a line, split at bars."""
    return read_lines(spark, path, "query_id").select("query_id", F.split(stripped(F.col("value")), r"\|").alias("codes"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    return read_lines(spark, path, "query_id").select("query_id", F.col("value").alias("text"))


def extract_codes(spark: SparkSession, source: str, target: str, column: str = "code") -> None:
    """Write the column's values of a tab-separated file with a header, without nulls, one a line."""
    rows = spark.read.csv(source, sep="\t", header=True)
    rows.filter(F.col(column).isNotNull()).select(column).write.text(target)


def from_lists(spark: SparkSession, texts: list[list[str]], labels: list[str]) -> DataFrame:
    """Corpus rows from memory; the shorter list ends both."""
    rows = [(k, label, list(own)) for k, (own, label) in enumerate(zip(texts, labels, strict=False))]
    return spark.createDataFrame(rows, "label_pos int, label string, corpus array<string>")


def flatten(corpus: DataFrame) -> DataFrame:
    """One row for each synonym of a label, numbered by (label_pos, place): (mention_id, label, text)."""
    rows = corpus.select("label_pos", "label", F.posexplode("corpus").alias("place", "text"))
    before = Window.partitionBy("part").orderBy("label_pos").rowsBetween(Window.unboundedPreceding, -1)
    sizes = corpus.select("label_pos", F.size("corpus").alias("n"), F.floor(F.col("label_pos") / 10_000).alias("part"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    starts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    firsts = sizes.withColumn("within", F.coalesce(F.sum("n").over(before), F.lit(0))).join(starts, "part")
    firsts = firsts.select("label_pos", (F.col("start") + F.col("within")).alias("first"))
    return rows.join(firsts, "label_pos").select((F.col("first") + F.col("place")).alias("mention_id"), "label", "text")


def write_debug_tables(tables: dict[str, DataFrame], folder: str) -> None:
    for name, table in tables.items():
        table.write.csv(f"{folder}/{name}", header=True)
