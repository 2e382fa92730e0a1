"""Removal of lines and passages that repeat, by hashes of lines and of the sentences in them."""

from __future__ import annotations

import functools
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import fresh, give_back, written
from brindle.llm.words import Words, _powers, batches, mix, sliced

_U = np.uint64
#: Words of a run of repeated sentences that is a passage; sentences of fewer words than SHORT don't count. A passage of 50 words that is set between
#: words of a line has its first and last sentence in common with none, so it must be known by what is left of it.
PASSAGE_WORDS, SHORT = 20, 4
#: Words of a line that doesn't come twice by chance.
LINE_WORDS = 20
#: Added to the number of the sentence that leads a line, where the line as a whole is meant.
LINE = 1 << 30
_LINE_SALT = _U(0xD6E8FEB86659FD93)


@functools.cache
def _uneven() -> re.Pattern[str]:
    """Characters whose lower case has another length in UTF-8, so that positions would move."""
    letters = (c for c in map(chr, range(128, sys.maxunicode)) if not "\ud800" <= c <= "\udfff")
    return re.compile("[" + "".join(c for c in letters if len(c.lower().encode()) != len(c.encode())) + "]")


def _even(text: str) -> str:
    """text without such characters; each is replaced by one of the same length."""
    return text if text.isascii() else _uneven().sub(lambda m: {2: "ß", 3: "ẜ", 4: "\U00010428"}[len(m[0].encode())], text)


class Units:
    """Lines and sentences of texts in a row.

    A line goes up to its line feed; a sentence up to white space after a full stop, question or exclamation mark, or to its line's
    end. Those without words belong to nothing, or to the sentence before. For each sentence, in order: text, the text it is in;
    digest, 64 bits of its words; words, how many; start and end, byte positions in all texts together; line, which one.
    For each line that has words: head and foot, its range of sentences; line_digest; line_words; line_start and line_stop (after the line feed).
    first: where each text's sentences begin, and the end; at: where each text begins; chars: code points before each byte."""

    def __init__(self, texts: list[str]):
        even = [_even(t) for t in texts]
        words = Words(even)
        h, n = words.hashes, len(words.hashes)
        data = [t.encode("utf-8", "surrogatepass") for t in even]
        self.at = np.concatenate(([0], np.cumsum([len(d) + 1 for d in data]))).astype(np.int64)
        raw = np.frombuffer(b"\n".join([*data, b""]), np.uint8)
        self.chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
        owner = np.repeat(np.arange(len(texts)), np.diff(words.first))
        begins, ends = words.starts + self.at[owner], words.ends + self.at[owner]
        feeds = np.flatnonzero(raw == 10)  # each text is followed by one too
        space = (raw == 32) | (raw == 9) | (raw == 13)
        stops = np.flatnonzero(((raw[:-1] == 46) | (raw[:-1] == 33) | (raw[:-1] == 63)) & space[1:]) if len(raw) else np.empty(0, np.int64)
        word_line, word_stop = np.searchsorted(feeds, begins), np.searchsorted(stops, begins)
        leads, cut = np.ones(n, bool), np.ones(n, bool)
        leads[1:] = word_line[1:] != word_line[:-1]
        cut[1:] = leads[1:] | (word_stop[1:] != word_stop[:-1])
        begin = np.flatnonzero(cut)
        after = np.append(begin[1:], n) if len(begin) else begin
        forth, back = _powers(1 << max(16, int(n + 1).bit_length()))
        sums = np.zeros(n + 1, _U)
        np.cumsum(h * forth[:n], out=sums[1:])
        self.digest = mix((sums[after] - sums[begin]) * back[begin] + (after - begin).astype(_U)).astype(np.int64)
        self.words = after - begin
        self.text = owner[begin]
        self.first = np.searchsorted(self.text, np.arange(len(texts) + 1))
        lead = leads[begin]
        self.head = np.flatnonzero(lead)
        self.foot = np.append(self.head[1:], len(begin)) if len(self.head) else self.head
        self.line = np.cumsum(lead) - 1
        top, tail = begin[self.head], after[self.foot - 1] if len(self.foot) else self.foot
        self.line_digest = mix((sums[tail] - sums[top]) * back[top] + (tail - top).astype(_U) + _LINE_SALT).astype(np.int64)
        self.line_words = tail - top
        place = word_line[top]
        self.line_start = np.where(place > 0, feeds[place - 1] + 1, 0) if n else np.empty(0, np.int64)
        self.line_end = feeds[place] if n else np.empty(0, np.int64)
        # the line feed after a text isn't in it
        self.line_stop = np.minimum(self.line_end + 1, self.at[1:][self.text[self.head]] - 1)
        # a sentence begins after the white space behind the last stop before it
        self.start = self.line_start[self.line].copy()
        later = np.flatnonzero(~lead)
        if len(later):
            solid = np.flatnonzero(~space)
            self.start[later] = solid[np.searchsorted(solid, stops[word_stop[begin[later]] - 1] + 1)]
        following = np.append(self.start[1:], 0)[: len(begin)]
        self.end = np.where(np.append(lead[1:], True)[: len(begin)], self.line_end[self.line], following)


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """Begins and ends of runs of true flags."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).view(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def spans(units: Units, k: int, repeated: np.ndarray, least: int | None) -> list[tuple[int, int]]:
    """Ranges of code points of text k that go: whole lines given by LINE, and runs of repeated sentences that count so many words.

    A line of which every sentence goes is taken with its line feed.
    """
    low, high = int(units.first[k]), int(units.first[k + 1])
    flags = np.zeros(high - low, bool)
    flags[repeated[repeated < LINE]] = True
    counted = np.where(units.words[low:high] >= SHORT, units.words[low:high], 0)
    for begin, end in _runs(flags):
        if least is None or counted[begin:end].sum() < least:
            flags[begin:end] = False
    for unit in repeated[repeated >= LINE] - LINE:
        line = units.line[low + unit]
        flags[unit : units.foot[line] - low] = True
    out: list[list[int]] = []
    for begin, end in _runs(flags):
        at, stop = begin + low, end + low
        while at < stop:
            line = units.line[at]
            foot = min(int(units.foot[line]), stop)
            whole = at == units.head[line] and foot == units.foot[line]
            piece = (units.line_start[line], units.line_stop[line]) if whole else (units.start[at], units.end[foot - 1])
            if out and out[-1][1] == piece[0]:
                out[-1][1] = int(piece[1])
            else:
                out.append([int(piece[0]), int(piece[1])])
            at = foot
    base = units.chars[units.at[k]]
    return [(int(units.chars[a] - base), int(units.chars[b] - base)) for a, b in out]


def _units(sentences: bool, line_words: int):
    def units_of(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, tie, text) to (digest, id, tie, unit): each digest's first occurrence among some texts, and, with digest null, the others."""
        for batch in sliced(incoming):
            ids, ties = batch.column(0), batch.column(1).to_numpy()
            texts = [t or "" for t in batch.column(2).to_pylist()]
            # places of the rows by (id, nulls last, tie); equal ones share a place
            places = np.zeros(len(texts), np.int64)
            if len(texts):
                rank = pc.rank(ids, sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy()
                order = np.lexsort((ties, rank))
                new = np.zeros(len(texts), bool)
                for key in (rank, ties):
                    new[1:] |= key[order][1:] != key[order][:-1]
                places[order] = np.cumsum(new)
            for low, high in batches(texts):
                units = Units(texts[low:high])
                own = np.arange(len(units.digest)) - units.first[units.text]
                long = units.line_words >= line_words
                heads = units.head[long]
                digests, text, index = units.line_digest[long], units.text[heads], own[heads] + LINE
                if sentences:
                    digests, text, index = np.concatenate((units.digest, digests)), np.concatenate((units.text, text)), np.concatenate((own, index))
                place = places[low:high][text]
                order = np.lexsort((index, place, digests))
                digest, rank = digests[order], np.stack((place[order], index[order]))
                new = np.ones(len(order), bool)
                new[1:] = digest[1:] != digest[:-1]
                group = np.cumsum(new) - 1
                heads = np.flatnonzero(new)
                # rows of equal rank as the first are first themselves: they are the same place of repeated rows
                is_first = (rank == rank[:, heads[group]]).all(0) if len(order) else new
                unit = pa.array(index[order].astype(np.int32))
                where = pa.array(text[order] + low)
                shown = pa.array(digest, pa.int64(), mask=~is_first)
                yield pa.RecordBatch.from_arrays([shown, ids.take(where), batch.column(1).take(where), unit], ["digest", "id", "tie", "unit"])
        give_back()

    return units_of


def remove_repeats(docs: DataFrame, passage_words: int | None = None, id_col: str = "doc_id", text_col: str = "text", spans_col: str = "removed", line_words: int = 1) -> DataFrame:
    """Remove lines that come in an earlier document too, or earlier in the same: all but the earliest occurrence, by id and place.

    Lines are compared as a whole, by 64 bits of their words (case, punctuation and white space don't count), if they have line_words words or more; by
    default, however short they are. Lines without words stay. A line goes with its line feed. A one-line paragraph is a line.

    With passage_words, passages set into lines go too. Sentences (Units) are compared like lines, and a run of repeated ones
    goes if those of SHORT words or more have so many words together; it may begin and end anywhere in a line, and go on over lines.
    Without it, sentences aren't looked at.

    Returns the rows with the text shortened and spans_col: an array of the ranges removed, structs of start and end in characters
    of the given text.

    Null texts stay null, without spans. Documents are ranked by id (a number or a string), nulls last, and rows of one id by a
    hash of the text; repeated rows are one document, and none of them repeats the other. Empty texts stay. Texts may be of any length
    below 2 GB; one is held whole by its task, with about ten times its size for numbers. An
    empty table gives no rows. Other columns stay, whatever they are called; one called spans_col is replaced.

    Among texts that a task reads together, repeated occurrences are found at once, so a very common line is not moved
    once for each occurrence; the earliest of all is a minimum with partial sums, and a join finds the others.
    """
    if spans_col.lower() in (id_col.lower(), text_col.lower()):
        raise ValueError("the spans can't replace the id or the text")
    docs = docs.drop(*(c for c in docs.columns if c.lower() == spans_col.lower()))
    kind = docs.schema[id_col].dataType.simpleString()
    twice = docs.groupBy(id_col).count().filter(F.col("count") > 1)
    tie: Column = F.lit(0).cast("long") if twice.isEmpty() else F.xxhash64(text_col)
    of_id, of_tie, key, other = (fresh(docs, n) for n in ("_id", "_of_tie", "_tie", "_units"))
    found = docs.select(F.col(id_col).alias("id"), tie.alias("tie"), F.col(text_col).alias("text")).mapInArrow(_units(passage_words is not None, line_words), f"digest long, id {kind}, tie long, unit int")
    units, _ = written(found)
    place = F.struct(F.col("id").isNull().alias("missing"), "id", "tie", "unit")
    known = units.filter("digest is not null")
    several = known.groupBy("digest").agg(F.min(place).alias("earliest"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = known.join(several, "digest").filter(place > F.col("earliest"))
    repeated = later.select("id", "tie", "unit").union(units.filter("digest is null").select("id", "tie", "unit"))
    of = repeated.groupBy(F.col("id").alias(of_id), F.col("tie").alias(of_tie)).agg(F.collect_set("unit").alias(other))
    left = docs.withColumn(key, tie)
    joined = left.join(of, left[id_col].eqNullSafe(of[of_id]) & (left[key] == of[of_tie]), "left").drop(of_id, of_tie, key)
    range_ = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    schema = T.StructType([*docs.schema.fields, T.StructField(spans_col, T.ArrayType(range_))])
    names = docs.columns
    text_at = names.index(text_col)

    def cut(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(incoming):
            texts, lists = batch.column(text_at).to_pylist(), batch.column(len(names)).to_pylist()
            removed: list[list[dict[str, int]]] = [[] for _ in texts]
            touched = [k for k, x in enumerate(lists) if x and texts[k]]
            for low, high in batches([texts[k] for k in touched]):
                some = touched[low:high]
                units = Units([texts[k] for k in some])
                for k, row in enumerate(some):
                    text, at, parts = texts[row], 0, []
                    for start, end in spans(units, k, np.sort(np.asarray(lists[row])), passage_words):
                        removed[row].append({"start": start, "end": end})
                        parts.append(text[at:start])
                        at = end
                    texts[row] = "".join([*parts, text[at:]])
            columns = [batch.column(k) for k in range(len(names))]
            columns[text_at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(removed, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], [*names, spans_col])
        give_back()

    return joined.select(*names, other).mapInArrow(cut, schema)
