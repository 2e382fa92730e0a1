"""Canonical exact digests of documents."""

from __future__ import annotations

import bisect
import hashlib
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import bucket_count, checkpointed, partitions
from brindle.llm.words import sliced

#: Rows of one range, and most ranges (their bounds are literals in the plan).
PER_RANGE, MOST_RANGES = 500, 20_000
#: Sampled places for each range, from which bounds are taken.
PER_BOUND = 20


def canonical(text: str | None) -> str:
    """Compatibility composition, case and white space folded; null is the empty text.

    Folding case can undo the normal form, so it is made again after it.
    """
    if not text:
        return ""
    if text.isascii():
        text = text.lower()
    else:
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(text.split())


def digest(form: str) -> bytes:
    """128-bit xxhash of a canonical form's UTF-8 bytes."""
    return xxhash.xxh3_128_digest(form.encode("utf-8", "surrogatepass"))


def edited(text: str, following: str) -> str:
    """text with its last half, rounded down, replaced by as much of the front of following."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        own = [digest(canonical(t)) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary()), *batch.columns[2:]], ["id", "digest", *batch.schema.names[2:]])


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        own = [canonical(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([digest(x) for x in own], pa.binary()), pa.array([x.encode("utf-8", "surrogatepass") for x in own], pa.binary())], ["id", "digest", "form"])


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as small as they can be moved; repeated ones have equal bytes."""
    squeeze = zstandard.ZstdCompressor(level=3).compress
    for batch in sliced(batches):
        packed = [squeeze(t.encode("utf-8", "surrogatepass")) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary()), batch.column(2)], ["id", "packed", "hash"])


_COMPARED = "n_chars long, digest binary, edited_sha256 binary, edited_digest binary, near_edited boolean, near_next boolean, form binary"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (range, kind): -1 a digest that comes more than once, 0 a document, 1 the one after the range.

    A document's row is made when its successor comes. Of digests that come more than once, each
    different form of a range is handed on once.
    """
    kinds = [None, pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.bool_(), pa.bool_(), pa.binary()]
    at, several, forms, last = None, set(), set(), None
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        out: list[tuple] = []
        columns = (batch.column(k).to_pylist() for k in range(5))
        for where, kind, id_, packed, key in zip(*columns, strict=True):
            if where != at:
                at, several, forms, last = where, set(), set(), None
            if kind < 0:
                several.add(key)
                continue
            text = unpack(packed).decode("utf-8", "surrogatepass")
            form = canonical(text)
            own = digest(form)
            if last is not None:
                before, before_text, before_form, before_digest = last
                changed = edited(before_text, text)
                changed_form = canonical(changed)
                changed_digest = digest(changed_form)
                shown = None
                if before_digest in several and (before_digest, before_form) not in forms:
                    forms.add((before_digest, before_form))
                    shown = before_form.encode("utf-8", "surrogatepass")
                sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).digest()
                out.append((before, len(before_text), before_digest, sha, changed_digest, (changed_digest, changed_form) == (before_digest, before_form), (own, form) == (before_digest, before_form), shown))
            last = (id_, text, form, own) if kind == 0 else None
        if out:
            kinds[0] = batch.column(2).type
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["id", "n_chars", "digest", "edited_sha256", "edited_digest", "near_edited", "near_next", "form"])


def _clashing(forms: DataFrame) -> DataFrame:
    """Digests of which forms has different forms, compared byte by byte."""
    return forms.filter("form is not null").groupBy("digest").agg(F.min("form").alias("least"), F.max("form").alias("greatest")).filter("least != greatest").select("digest")


def _told_apart(rows: DataFrame, docs: DataFrame, clashes: DataFrame, name: str) -> DataFrame:
    """rows (id, digest, ...) get a fingerprint; clashing digests get the rank of the form as a suffix.

    Rows of one id whose forms clash get the rank of the first of them.
    """
    plain = F.lower(F.hex("digest"))
    if clashes.isEmpty():
        return rows.withColumn(name, plain)
    held = docs.mapInArrow(_forms, f"id {docs.dtypes[0][1]}, digest binary, form binary").join(clashes, "digest")
    ranked = held.select("digest", "form").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("digest").orderBy("form")) - 1)
    of = held.join(ranked, ["digest", "form"]).groupBy(F.col("id").alias("_id"), F.col("digest").alias("_digest")).agg(F.min("rank").alias("_rank"))
    joined = rows.join(of, rows["id"].eqNullSafe(of["_id"]) & (rows["digest"] == of["_digest"]), "left")
    return joined.withColumn(name, F.when(F.col("_rank") > 0, F.concat_ws("-", plain, F.col("_rank").cast("string"))).otherwise(plain)).drop("_id", "_digest", "_rank")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group documents of equal canonical form: id, fingerprint and group_size, a row for each input row.

    Rows are grouped by the 128-bit digest of the form; inside a bucket of more than one the
    canonical bytes are compared, and a bucket that holds different forms is split, so equal
    fingerprints mean equal forms. Forms are combined before they are moved, so that a group may
    hold most rows.

    Null and white-space-only texts have the empty form. Null ids and repeated rows stay rows of
    their own. An empty table gives no rows. Other columns are left out.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = texts.dtypes[0][1]
    rows = checkpointed(texts.mapInArrow(_digests, f"id {kind}, digest binary"))
    several = rows.groupBy("digest").count().filter("count > 1").select("digest")
    compared = texts.mapInArrow(_forms, f"id {kind}, digest binary, form binary").join(several, "digest", "left_semi")
    named = checkpointed(_told_apart(rows, texts, _clashing(compared), "fingerprint"))
    sizes = named.groupBy("fingerprint").agg(F.count("*").alias("group_size"))
    return named.join(sizes, "fingerprint").select(F.col("id").alias(id_col), "fingerprint", "group_size")


def _bounds(rows: DataFrame, count: int, ranges: int) -> list[tuple]:
    """Places (id, hash) that divide rows into about so many even ranges.

    Every different place is drawn by its hash with the same chance, so the sample is bounded by PER_BOUND for each range,
    and is the same again; a place counts as often as it comes.
    """
    if ranges < 2:
        return []
    rate = max(1, count // (ranges * PER_BOUND))
    drawn = rows.filter(F.pmod(F.xxhash64("id", "hash", F.lit(3)), F.lit(rate)) == 0).groupBy("id", "hash").agg(F.count("*").alias("n"))
    places = sorted(map(tuple, drawn.collect()), key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, r[1]))
    sums, total = [], 0
    for _, _, n in places:
        total += n
        sums.append(total)
    at = sorted({bisect.bisect_left(sums, k * total / ranges) for k in range(1, ranges)}) if places else []
    return [places[k][:2] for k in at if k < len(places)]


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of documents, and how they answer to an edit and to the next document.

    The next document is that of the next id, ascending, nulls first; rows of one id are ordered by a hash of
    their text. Ids are integers or strings of any value. After the last comes the first. The edited text is the document's with its second half
    (rounded down) replaced by the front of the next. An exact digest's likeness is 1 if both forms are equal,
    else 0. Returns id, n_chars (code points), edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next, a row for each row.

    Whole texts are moved once, compressed: to ranges of neighbouring places (id and hash of the text, so that many rows of one id are
    divided too), each with a copy of the next range's first row. Bounds come from a sample of places; where each range really
    begins is then read from the rows themselves. Digests that come more than once are known by then, and only their
    forms are compared. Null texts are empty. A table of one row is followed by itself, an empty one gives no rows.
    """
    whole = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), whole.alias("text"), F.xxhash64(whole).alias("hash"))
    kind = texts.dtypes[0][1]
    rows = checkpointed(texts.mapInArrow(_digests, f"id {kind}, digest binary, hash long"))
    count = rows.count()
    edges = _bounds(rows, count, min(MOST_RANGES, bucket_count(count, PER_RANGE)))
    listed = json.dumps([{"i": i, "h": h} for i, h in edges])
    bounds = F.from_json(F.lit(listed), f"array<struct<i:{kind},h:bigint>>")

    def ranged(df: DataFrame) -> DataFrame:
        """Add range: how many bounds aren't above the row's place, by binary search."""
        if not edges:
            return df.withColumn("range", F.lit(0))
        id_, hash_ = F.col("id"), F.col("hash")

        def reached(bound):
            same = F.when(bound["i"].isNull(), id_.isNotNull() | (bound["h"] <= hash_))
            return same.otherwise(F.coalesce((bound["i"] < id_) | (bound["i"] == id_) & (bound["h"] <= hash_), F.lit(False)))

        steps = F.array(*(F.lit(2**k) for k in reversed(range(len(edges).bit_length()))))
        found = F.aggregate(steps, F.lit(0), lambda n, step: F.when((n + step <= len(edges)) & reached(F.get(bounds, n + step - 1)), n + step).otherwise(n))
        return df.withColumn("range", found)

    # the first place of each range that has rows, and the range before it; the first row of all follows the last
    least = ranged(rows).groupBy("range").agg(F.min(F.struct("id", "hash")).alias("first"))
    firsts = sorted((r["range"], tuple(r["first"])) for r in least.collect())
    follows = {r: firsts[k - 1][0] for k, (r, _) in enumerate(firsts)}  # the first's is the last
    begins = [None] * (len(edges) + 1)
    for r, (i, h) in firsts:
        begins[r] = {"i": i, "h": h, "to": follows[r]}
    known = F.from_json(F.lit(json.dumps(begins)), f"array<struct<i:{kind},h:bigint,to:int>>")

    held = ranged(texts.mapInArrow(_squeezed, f"id {kind}, packed binary, hash long")).withColumn("first", F.get(known, F.col("range")))
    leads = F.col("id").eqNullSafe(F.col("first")["i"]) & (F.col("hash") == F.col("first")["h"])
    places = F.array(F.struct(F.col("range"), F.lit(0).alias("kind")), F.when(leads, F.struct(F.col("first")["to"].alias("range"), F.lit(1).alias("kind"))))
    dealt = held.select("id", "hash", "packed", F.inline(F.filter(places, lambda p: p.isNotNull()))).select("range", "kind", "id", "packed", F.lit(None).cast("binary").alias("digest"), "hash")
    several = rows.groupBy("digest").count().filter("count > 1").select("digest")
    nothing = (F.lit(None).cast(t).alias(n) for n, t in (("id", kind), ("packed", "binary")))
    # a digest meets the join once for each range at most, however common it is
    flags = ranged(rows).select("range", "digest").distinct().join(several, "digest")
    flags = flags.select("range", F.lit(-1).alias("kind"), *nothing, "digest", F.lit(0).cast("long").alias("hash"))
    spread = min(max(1, len(firsts)), 4 * partitions(docs))
    sorted_ = dealt.union(flags).repartition(spread, "range").sortWithinPartitions("range", "kind", "id", "hash", "packed")
    compared = checkpointed(sorted_.mapInArrow(_compare, f"id {kind}, {_COMPARED}"))
    named = _told_apart(compared.drop("form"), texts.select("id", "text"), _clashing(compared.select("digest", "form")), "fingerprint")
    return named.select(
        F.col("id").alias(id_col), "n_chars", F.lower(F.hex("edited_sha256")).alias("edited_sha256"), "fingerprint", F.lower(F.hex("edited_digest")).alias("edited_fingerprint"),
        F.col("near_edited").cast("double").alias("near_edited"), F.col("near_next").cast("double").alias("near_next"),
    )
