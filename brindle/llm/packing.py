"""Packing of tokenized documents into fixed windows, planned by non-negative least squares."""

from __future__ import annotations

import functools
import itertools
import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import bucket_count, checkpointed, fresh, give_back, running_total
from brindle.llm.words import batches, sliced

# Latin letters and numerals up to U+017F, as the vocabulary's own pattern splits them.
_LETTER = "a-zA-ZªµºÀ-ÖØ-öø-ſ"
_NUMBER = "0-9²³¹¼-¾"
#: Anything else that isn't white space. A number is a piece alone, as are these ends of words; of letters and of signs, as many as follow each other are a piece.
_SPACE, _SIGN, _LETTERS, _NUMBERS = range(4)
_KIND = np.array([_SPACE if chr(k) in "\t\n\r " else _LETTERS if re.match(f"[{_LETTER}]", chr(k)) else _NUMBERS if re.match(f"[{_NUMBER}]", chr(k)) else _SIGN for k in range(0x180)], np.uint8)
_ENDS_1, _ENDS_2 = (np.isin(np.arange(1 << bits), codes) for bits, codes in ((8, list(b"stmd")), (16, [256 * x[0] + x[1] for x in (b"re", b"ve", b"ll")])))
#: Anything that isn't plain Latin text is left to the tokenizer itself.
_ODD = "[^\t\n\r\x20-\x7e¡-įı-ſ]|<\\|"
#: Words kept by each Python worker; beyond it the memory starts anew, and of those before the ones that come again are kept.
CACHED_WORDS = 200_000
#: New words that are encoded as one text, and characters of texts that are looked up together.
_TOGETHER, _RANGE = 2000, 1 << 21


def _pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of plain texts in lower case as the vocabulary's pattern splits them, and where each text's begin (and the end)."""
    held = pc.binary_join_element_wise(texts, "", "\n")
    offsets = np.frombuffer(held.buffers()[1], np.int32)[held.offset : held.offset + len(held) + 1]
    # some bytes follow the last, for those that look ahead
    raw = np.concatenate((np.frombuffer(held.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], np.full(4, 10, np.uint8)))
    kind = _KIND[raw]
    wide = np.flatnonzero(raw >= 0xC2)
    kind[wide] = kind[wide + 1] = _KIND[(raw[wide] & 0x1F).astype(np.int64) << 6 | raw[wide + 1] & 0x3F]
    begins = np.empty(len(raw), bool)
    begins[0] = True
    np.not_equal(kind[1:], kind[:-1], out=begins[1:])
    begins |= kind == _NUMBERS
    begins[wide + 1] = False
    spaces = kind == _SPACE
    # an apostrophe that is alone takes the letters of a contraction
    marks = np.flatnonzero((raw == 0x27) & begins)
    marks = marks[kind[marks + 1] == _LETTERS]
    one, two = _ENDS_1[raw[marks + 1]], _ENDS_2[raw[marks + 1].astype(np.int64) << 8 | raw[marks + 2]]
    for some, n in ((marks[one], 1), (marks[two], 2)):
        begins[some + 1] = False
        begins[some + 1 + n] = True
    begins &= ~spaces
    at = np.flatnonzero(begins)
    place = np.cumsum(~spaces, dtype=np.int32)
    ends = np.append(place[at] - 1, place[-1]).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(raw[~spaces])])
    return words, np.searchsorted(at, offsets - offsets[0])


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(data)])


def _joined(values: pa.Array, firsts: np.ndarray) -> pa.Array:
    """Values that follow each other as one: the k-th result has those from firsts[k] to firsts[k + 1]."""
    offsets = np.frombuffer(values.buffers()[1], np.int64)[: len(values) + 1] if len(values) else np.zeros(1, np.int64)
    return _binary(np.frombuffer(values.buffers()[2] or b"", np.uint8), offsets[firsts])


class Known:
    """Texts with their ids as bytes, in two Arrow columns: some forty bytes each."""

    def __init__(self):
        self.texts, self.data = pa.array([], pa.string()), pa.array([], pa.large_binary())

    def __len__(self) -> int:
        return len(self.texts)

    def find(self, texts: pa.Array) -> np.ndarray:
        """Places of texts, -1 for one that isn't there."""
        return pc.fill_null(pc.index_in(texts, value_set=self.texts), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def add(self, texts: pa.Array, data: pa.Array) -> None:
        self.texts, self.data = pa.concat_arrays([self.texts, texts]), pa.concat_arrays([self.data, data])


class WordTokenizer:
    """Ids of whole texts as little-endian 32-bit bytes, made word by word from a memory of words.

    For vocabularies that split a text into words before merging (as word_bpe_49k.json does), a
    text's ids are its words' ids in a row. Texts with other than plain Latin characters, or with
    what could be a special token, go through the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words, self.older = Known(), Known()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, new: list[str]) -> None:
        """Encode words: those of plain signs by the model itself; others as texts of many, of which each word's last token carries the mark of a word's end."""
        plain, other = [w for w in new if w.isascii()], [w for w in new if not w.isascii()]
        tokenize = self.tokenizer.model.tokenize
        ids = [[token.id for token in tokenize(word)] for word in plain]
        flat, offsets = np.fromiter(itertools.chain.from_iterable(ids), "<u4"), np.cumsum([0, *map(len, ids)]) * 4
        self.words.add(pa.array(plain, pa.string()), _binary(flat, offsets))
        for k in range(0, len(other), _TOGETHER):
            some = other[k : k + _TOGETHER]
            flat = np.asarray(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            offsets = np.append(0, (np.flatnonzero(self.ends[flat]) + 1) * 4)
            if len(offsets) != len(some) + 1:
                raise ValueError("the vocabulary doesn't mark where each word ends")
            self.words.add(pa.array(some, pa.string()), _binary(flat, offsets))

    def of_words(self, words: pa.Array) -> pa.Array:
        """Ids of words. Those that are new are encoded together, so give many at once."""
        if len(self.words) > CACHED_WORDS:
            self.older, self.words = self.words, Known()
        coded = words.dictionary_encode()
        at = self.words.find(coded.dictionary)
        gaps = np.flatnonzero(at < 0)
        if len(gaps):
            new = coded.dictionary.take(pa.array(gaps))
            before = self.older.find(new)
            again = np.flatnonzero(before >= 0)
            self.words.add(new.take(pa.array(again)), self.older.data.take(pa.array(before[again])))
            if len(again) < len(gaps):
                self.learn(new.filter(pa.array(before < 0)).to_pylist())
            at[gaps] = self.words.find(new)
        return self.words.data.take(pa.array(at[coded.indices.to_numpy()]))

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of texts, of which many are looked up together: each different word once."""
        held = pa.array(texts, pa.string())
        odd = pc.match_substring_regex(held, _ODD)
        words, firsts = _pieces(pc.utf8_lower(pc.if_else(odd, "", held)))
        plain = _joined(self.of_words(words), firsts).to_pylist()
        return [self.whole(text) if left else own for text, left, own in zip(texts, odd.to_pylist(), plain, strict=True)]


@functools.cache
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def tokenize_documents(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most window tokens: id, start, length, doc_tokens and ids (binary, little-endian 32 bits).

    Each document's ids are followed by end_id. Null texts count as empty: one piece of one id.
    A document is cut every window ids; only its last piece is shorter.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, end, step = _tokenizer(tokenizer_path), np.uint32(end_id).tobytes(), 4 * window
        for batch in sliced(incoming, 2048, _RANGE):
            for low, high in batches(texts := [t or "" for t in batch.column(1).to_pylist()], _RANGE):
                row, start, length, total, ids = [], [], [], [], []
                for i, data in enumerate(tokenizer.ids(texts[low:high])):
                    data += end
                    for begin in range(0, len(data), step):
                        piece = data[begin : begin + step]
                        row.append(i)
                        start.append(begin // 4)
                        length.append(len(piece) // 4)
                        total.append(len(data) // 4)
                        ids.append(piece)
                owner = batch.column(0).slice(low, high - low).take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([owner, pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(total, pa.int64()), pa.array(ids, pa.binary())], ["id", "start", "length", "doc_tokens", "ids"])
            give_back()

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(cut, f"id {kind}, start long, length long, doc_tokens long, ids binary")
    return out.withColumnRenamed("id", id_col)


def combinations(bins: int, depth: int) -> list[tuple[int, ...]]:
    """All non-increasing tuples of at most depth bin sizes whose sum is bins."""
    out: list[tuple[int, ...]] = []

    def grow(prefix: tuple[int, ...], rest: int) -> None:
        if rest == 0:
            out.append(prefix)
            return
        left = depth - len(prefix)
        if left == 0:
            return
        for size in range(min(rest, prefix[-1] if prefix else bins), -(-rest // left) - 1, -1):
            grow((*prefix, size), rest - size)

    grow((), bins)
    return out


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int | None = None, tolerance: float = 1e-9) -> np.ndarray:
    """x >= 0 with the least |a x - b|, by the active set method."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    for _ in range(rounds or 3 * a.shape[0] + 10):
        pull = a.T @ (b - a @ x)
        pull[active] = -np.inf
        best = int(np.argmax(pull))
        if pull[best] <= tolerance:
            break
        active[best] = True
        while True:
            at = np.flatnonzero(active)
            solution = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (solution > 0).all():
                x[:] = 0
                x[at] = solution
                break
            # go towards the solution until the first variable meets zero
            falling = solution <= 0
            now = x[at]
            step = np.min(now[falling] / np.maximum(now[falling] - solution[falling], 1e-300))
            now = now + step * (solution - now)
            x[:] = 0
            x[at] = now
            active[at[falling & (now <= 1e-12)]] = False
            x[~active] = 0
            if not active.any():
                break
    return x


def packing_plan(histogram: np.ndarray, bins: int, depth: int = 4) -> list[tuple[tuple[int, ...], int]]:
    """(bin sizes of one window, repeats) that use up histogram exactly; histogram[s] counts pieces of size s.

    Repeat counts of the shallow combinations that fill a window are the rounded solution of
    the least squares problem, as far as the histogram goes. What is left is packed greedily:
    the largest piece first, then the largest that still fits, as often as the counts allow.
    """
    left = histogram.astype(np.int64).copy()
    plan: list[tuple[tuple[int, ...], int]] = []
    if left[bins]:
        plan.append(((bins,), int(left[bins])))
        left[bins] = 0
    if left.any():
        shapes = [s for s in combinations(bins, depth) if len(s) > 1 and all(left[x] for x in s)]
        if shapes:
            a = np.zeros((bins, len(shapes)))
            for k, shape in enumerate(shapes):
                for size in shape:
                    a[size, k] += 1
            scale = left.sum()
            x = nonnegative_least_squares(a, left[:bins] / scale) * scale
            for k in np.argsort(-x, kind="stable"):
                if x[k] < 0.5:
                    break
                need = Counter(shapes[k])
                times = min(int(round(x[k])), *(int(left[s]) // m for s, m in need.items()))
                if times:
                    plan.append((shapes[k], times))
                    for s, m in need.items():
                        left[s] -= m * times
        while left.any():
            room, shape = bins, []
            spare = left.copy()
            while fits := np.flatnonzero(spare[: room + 1]).tolist():
                size = fits[-1]
                count = min(int(spare[size]), room // size)
                shape += [size] * count
                spare[size] -= count
                room -= size * count
            need = Counter(shape)
            times = min(int(left[s]) // m for s, m in need.items())
            plan.append((tuple(shape), times))
            for s, m in need.items():
                left[s] -= m * times
    return plan


def pack_pieces(pieces: DataFrame, window: int = 2048, quantum: int = 16, depth: int = 4, length_col: str = "length", key_cols: tuple[str, ...] = ("doc_id", "start")) -> DataFrame:
    """Give each piece a sequence_id (gapless from 0) and its offset in that sequence.

    Lengths are counted in steps of quantum tokens, rounded up; the histogram has window / quantum
    bins, whatever the input. Only it goes to the driver, and only the plan made from it (a few
    rows for each bin) is broadcast. Each piece's place follows from its rank among those of
    its bin, a two-level prefix sum, so no bin has to fit one task. Other columns are kept; a
    length outside 1 to window raises an error. No pieces give no rows.
    """
    if window % quantum:
        raise ValueError("quantum must divide window")
    taken = {n: fresh(pieces, n) for n in ("_bin", "_bucket", "_rank", "_lo", "_hi", "_base", "_each", "_slot", "_pbin")}
    bins = window // quantum
    length = F.col(length_col)
    size = F.when(length.between(1, window), F.ceil(length / quantum)).otherwise(F.raise_error(F.lit("a length is outside the window"))).cast("int")
    held = checkpointed(pieces.withColumn(taken["_bin"], size))
    counts = held.groupBy(taken["_bin"]).count().collect()
    histogram = np.zeros(bins + 1, np.int64)
    for row in counts:
        histogram[row[0]] = row[1]
    rows, used, base = [], Counter(), 0
    for shape, times in packing_plan(histogram, bins, depth):
        for slot, (at, each) in enumerate(sorted(Counter(shape).items(), reverse=True)):
            rows.append((at, used[at], used[at] + times * each, base, each, slot))
            used[at] += times * each
        base += times
    names = [taken[n] for n in ("_pbin", "_lo", "_hi", "_base", "_each", "_slot")]
    plan = pieces.sparkSession.createDataFrame(rows, ", ".join(f"`{n}` {k}" for n, k in zip(names, ["int", *["long"] * 5], strict=True)))
    buckets = bucket_count(int(histogram.sum()), 4000)
    spread = held.withColumn(taken["_bucket"], F.pmod(F.xxhash64(*key_cols), F.lit(buckets)))
    ranked = running_total(spread, [taken["_bin"]], taken["_bucket"], list(key_cols), F.lit(1).cast("long"), taken["_rank"])
    rank = F.col(taken["_rank"])
    placed = ranked.join(F.broadcast(plan), (F.col(taken["_bin"]) == F.col(taken["_pbin"])) & (rank >= F.col(taken["_lo"])) & (rank < F.col(taken["_hi"])))
    within = rank - F.col(taken["_lo"])
    placed = placed.withColumn("sequence_id", F.col(taken["_base"]) + F.floor(within / F.col(taken["_each"]))).withColumn(taken["_slot"], F.col(taken["_slot"]) * (window + 1) + within % F.col(taken["_each"]))
    order = Window.partitionBy("sequence_id").orderBy(taken["_slot"]).rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum(length_col).over(order), F.lit(0)).cast("long")).drop(*taken.values())
