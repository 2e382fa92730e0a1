"""Text to vectors: TF-IDF with truncated SVD, and language models."""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.functions.vectors import unit
from brindle.sources.files import checkpointed

#: Encoders by name: a list of texts gives an array of vectors.
ENCODERS: dict[str, Callable[[list[str]], np.ndarray]] = {}
#: Encoders by name that have to be loaded first, which each worker does once.
LOADERS: dict[str, Callable[[], Callable[[list[str]], np.ndarray]]] = {}


def register_encoder(name: str, encode: Callable[[list[str]], np.ndarray]) -> None:
    ENCODERS[name.lower()] = encode


def register_loader(name: str, load: Callable[[], Callable[[list[str]], np.ndarray]]) -> None:
    """load is called once by each worker and gives the encoder, so that a model isn't sent with every task."""
    LOADERS[name.lower()] = load


def hashed_ngrams(texts: list[str], width: int = 128) -> np.ndarray:
    """A stand-in for a language model: counts of hashed character trigrams, with signs."""
    out = np.zeros((len(texts), width))
    for k, t in enumerate(texts):
        padded = f"  {t.lower()} "
        for i in range(len(padded) - 2):
            h = zlib.crc32(padded[i : i + 3].encode())
            out[k, h % width] += 1 if h & 1024 else -1
    return out


register_encoder("hashedngrams", hashed_ngrams)
#: Names of language models that configurations use. Their weights aren't part of this library.
MODELS = {
    "biobert": "dmis-lab/biobert-base-cased-v1.2",
    "sentencetbiobert": "pritamdeka/S-BioBert-snli-multinli-stsb",
    "sentencetsapbert": "cambridgeltl/SapBERT-from-PubMedBERT-fulltext",
    "krissbert": "microsoft/BiomedNLP-KRISSBERT-PubMed-UMLS-EL",
}


def language_model(path: str) -> Callable[[list[str]], np.ndarray]:
    """A language model of a path or a public name, whose weights have to be there, as mean vectors of its last layer."""
    try:
        import torch
        from transformers import AutoModel, AutoTokenizer
    except ImportError as error:
        raise ValueError(f"{path} needs the packages torch and transformers; or give an encoder to register_encoder") from error
    place = "cuda" if torch.cuda.is_available() else "cpu"
    tokenizer, model = AutoTokenizer.from_pretrained(path), AutoModel.from_pretrained(path).to(place).eval()

    def encode(texts: list[str]) -> np.ndarray:
        inputs = tokenizer(texts, padding=True, truncation=True, max_length=512, return_tensors="pt").to(place)
        with torch.no_grad():
            hidden = model(**inputs).last_hidden_state
        mask = inputs["attention_mask"].unsqueeze(-1).to(hidden.dtype)
        return ((hidden * mask).sum(1) / mask.sum(1).clamp(min=1)).cpu().numpy()

    return encode


_LOADED: dict[str, Callable[[list[str]], np.ndarray]] = {}


def _loaded(name: str, load: Callable[[], Callable[[list[str]], np.ndarray]]) -> Callable[[list[str]], np.ndarray]:
    """One model a worker."""
    if name not in _LOADED:
        _LOADED.clear()
        _LOADED[name] = load()
    return _LOADED[name]


def is_out_of_memory(error: Exception) -> bool:
    return isinstance(error, MemoryError) or "outofmemory" in type(error).__name__.lower() or "out of memory" in str(error).lower()


def encode_in_batches(encode: Callable[[list[str]], np.ndarray], texts: list[str], size: int, retries: int = 5) -> np.ndarray:
    """Vectors of texts, of so many at a time. Where memory runs out, the batch is made smaller, down to a tenth at once, and the size comes back
    after one that went well; after so many retries in all it is an error."""
    out, at, now = [], 0, max(1, size)
    while at < len(texts):
        try:
            found = np.asarray(encode(texts[at : at + now]), float)
        except Exception as error:
            if not is_out_of_memory(error):
                raise
            if retries <= 0:
                raise RuntimeError("memory ran out at every size of batch") from error
            now = max(1, int(now * min(0.5, max(0.1, 1 - 0.2 * retries))))
            retries -= 1
            continue
        out.append(found)
        at, now = at + now, max(1, size)
    return np.concatenate(out) if out else np.empty((0, 0))


#: Terms up to which the SVD is that of the matrix of their products; beyond, it is made of random directions.
GRAM_TERMS = 2048
#: Numbers of a basis that each task may hold; a larger one is joined.
MOST_BASIS = 1 << 25


def summed(rows: DataFrame, key: str, kind: str) -> DataFrame:
    """Of (key, value, vec): (key, vec), the sums of value times vec. Only runs of equal keys are added up in a task, so keys may be many."""

    def add(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = None, None
        for batch in incoming:
            if not batch.num_rows:
                continue
            keys, values = batch.column(0), batch.column(1).to_numpy()
            width = len(batch.column(2)[0])
            vectors = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, width) * values[:, None]
            own = keys.to_numpy(zero_copy_only=False)
            starts = np.concatenate(([0], np.flatnonzero(own[1:] != own[:-1]) + 1))
            sums = np.add.reduceat(vectors, starts, 0)
            first = [own[k] for k in starts]
            if total is not None:
                if first[0] == held:
                    sums[0] += total
                else:
                    first.insert(0, held)
                    sums = np.concatenate((total[None], sums))
            held, total = first[-1], sums[-1].copy()
            yield _vectors(first[:-1], sums[:-1], keys.type, key)
        if total is not None:
            yield _vectors([held], total[None], pa.array([held]).type, key)

    dealt = rows.select(key, "value", "vec").repartition(key).sortWithinPartitions(key)
    return dealt.mapInArrow(add, f"`{key}` {kind}, vec array<double>")


def _vectors(keys: list, matrix: np.ndarray, kind: pa.DataType, name: str) -> pa.RecordBatch:
    width = matrix.shape[1]
    offsets = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * width)
    return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.ListArray.from_arrays(offsets, pa.array(matrix.ravel()))], [name, "vec"])


def _gram(rows: DataFrame, width: int) -> np.ndarray:
    """Products of all columns of rows (features, values). Tasks add up their own; sums of these are made by line."""

    def products(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in incoming:
            sizes = np.diff(batch.column(0).offsets.to_numpy())
            line = np.repeat(np.arange(batch.num_rows), sizes)
            features, values = batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy()
            for low in range(0, batch.num_rows, 1024):
                some = (line >= low) & (line < low + 1024)
                dense = np.zeros((min(1024, batch.num_rows - low), width))
                np.add.at(dense, (line[some] - low, features[some]), values[some])
                total = dense.T @ dense if total is None else total + dense.T @ dense
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(np.ones(width)), pa.array(total.tolist(), pa.list_(pa.float64()))], ["line", "value", "vec"])

    few = rows.select(F.col("features").cast("array<int>").alias("features"), F.col("values").cast("array<double>").alias("values"))
    parts = few.mapInArrow(products, "line int, value double, vec array<double>")
    out = np.zeros((width, width))
    for r in summed(parts, "line", "int").collect():
        out[r["line"]] = r["vec"]
    return out


def singular_vectors(rows: DataFrame, width: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k right singular vectors (width by k) and values of rows (features, values), not centred, for a width up to GRAM_TERMS."""
    values, vectors = np.linalg.eigh(_gram(rows, width))
    order = np.argsort(-values)[: min(k, width)]
    order = order[values[order] > max(0.0, values[order[0]]) * 1e-12] if len(order) else order
    return vectors[:, order], np.sqrt(values[order])


def random_svd(weights: DataFrame, key: str, k: int, rounds: int = 5, more: int = 10, seed: int = 0) -> tuple[DataFrame, np.ndarray]:
    """The same of long rows (key, feature, value) with any number of features: (feature, vec) and the values.

    Random directions, multiplied rounds times by the matrix and its transpose and made orthogonal in between. All is in tables but
    matrices of k + more lines.
    """
    kind, size = dict(weights.dtypes)[key], k + more
    # normal numbers from two hashes of feature and place
    place = F.sequence(F.lit(1), F.lit(size))
    even = lambda c, salt: (F.pmod(F.xxhash64("feature", c, F.lit(seed), F.lit(salt)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    start = weights.select("feature").distinct().withColumn("vec", F.transform(place, lambda c: F.sqrt(-2 * F.log(even(c, 1))) * F.cos(2 * np.pi * even(c, 2))))
    rows = weights.select(key, "feature", "value")

    def times(by: DataFrame, at: str, to: str) -> DataFrame:
        return summed(rows.join(by, at).select(to, "value", "vec"), to, "int" if to == "feature" else kind)

    def orthogonal(table: DataFrame) -> tuple[DataFrame, np.ndarray]:
        """The table's vectors times what makes its columns orthogonal, and the lengths these had."""
        held = checkpointed(table)
        every = F.sequence(F.lit(0), F.lit(size - 1))
        lines = _gram(held.select(every.alias("features"), F.col("vec").alias("values")), size)
        values, vectors = np.linalg.eigh(lines)
        good = values > max(values.max(initial=0), 1e-300) * 1e-14
        turn = (vectors[:, good] / np.sqrt(values[good]))[:, ::-1]

        def turned(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in incoming:
                if batch.num_rows:
                    matrix = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1) @ turn
                    full = np.zeros((batch.num_rows, size))
                    full[:, : matrix.shape[1]] = matrix
                    yield _vectors(batch.column(0).to_pylist(), full, batch.column(0).type, batch.schema.names[0])

        return held.mapInArrow(turned, held.schema), np.sqrt(np.maximum(values, 0))[good][::-1]

    left, _ = orthogonal(times(start, "feature", key))
    for _ in range(rounds):
        right, _ = orthogonal(times(left, key, "feature"))
        left, _ = orthogonal(times(right, "feature", key))
    basis, values = orthogonal(times(left, key, "feature"))
    return basis.select("feature", F.slice("vec", 1, min(k, len(values))).alias("vec")), values[:k]


class TextEncoder:
    """flag 1: TF-IDF and SVD; 2: these and an encoder's vectors side by side; 3: an encoder's alone. Rows have length 1.

    vocabulary (term, idf, feature) and basis (feature, vec) are tables; only a basis of at most MOST_BASIS numbers is ever held by a task.
    """

    vectorizing = {"ngram_range": (1, 2), "max_features": None, "min_df": 0.0, "max_df": 0.98, "binary": False, "use_idf": True, "smooth_idf": True, "sublinear_tf": False, "norm": "l2", "stop_words": None}
    vectorizing_only = {"analyzer": ("word",), "lowercase": (True,), "strip_accents": (None,)}
    reducing = {"n_components": 1000, "n_iter": 5, "n_oversamples": 10, "random_state": None}
    reducing_only = {"algorithm": ("randomized", "arpack"), "power_iteration_normalizer": ("auto", "QR", "LU"), "tol": (0.0,)}

    def __init__(self, vectorizer: dict | None = None, transformer: dict | None = None, dimension: dict | None = None, flag: int = 2):
        self.vectorizer, self.transformer, self.dimension, self.flag = vectorizer or {}, transformer or {}, dimension or {}, flag
        if flag not in (1, 2, 3):
            raise ValueError("an encoder's flag is 1, 2 or 3")
        self.options = self._options(self.vectorizer, "tfidf", self.vectorizing, self.vectorizing_only)
        self.size = self._options(self.dimension, "sklearntruncatedsvd", self.reducing, self.reducing_only)
        self.vocabulary: DataFrame | None = None
        self.basis: DataFrame | None = None
        self.width = self.terms = 0

    @staticmethod
    def _options(config: dict, kind: str, known: dict, only: dict) -> dict:
        given = str(config.get("type", kind)).lower()
        if given not in (kind, kind.removeprefix("sklearn")):
            raise ValueError(f"unknown type {given!r}; known: {kind}")
        kwargs = dict(config.get("kwargs") or {k: v for k, v in config.items() if k not in ("type", "kwargs")})
        if wrong := set(kwargs) - set(known) - set(only):
            raise ValueError(f"unknown parameters of {kind}: {sorted(wrong)}")
        for name, allowed in only.items():
            if name in kwargs and kwargs[name] not in allowed:
                raise ValueError(f"{kind} knows {name} only as {list(allowed)}, not {kwargs[name]!r}")
        return known | {k: v for k, v in kwargs.items() if k in known}

    def _terms(self, rows: DataFrame, key: str, column: str) -> DataFrame:
        o = self.options
        return T.terms(rows, key, column, *o["ngram_range"], stop=o["stop_words"])

    def fit(self, rows: DataFrame, key: str, column: str) -> TextEncoder:
        """Learn the vocabulary, which only max_features and the document frequencies bound, and the SVD."""
        if self.flag in (1, 2):
            o = self.options
            tf = self._terms(rows, key, column)
            found = T.document_frequencies(tf, rows.count(), o["max_df"], o["max_features"], o["min_df"], o["smooth_idf"], o["use_idf"]).select("term", "idf")
            found = checkpointed(found)
            self.terms = found.count()
            if not self.terms:
                raise ValueError("no term is left; the texts may be empty, or the bounds of document frequencies too narrow")
            self.vocabulary = checkpointed(T.numbered(found, self.terms))
            w = checkpointed(self._weights(rows, key, column))
            k = min(self.size["n_components"], self.terms)
            if self.terms <= GRAM_TERMS:
                lists = w.groupBy(key).agg(F.collect_list("feature").alias("features"), F.collect_list("value").alias("values"))
                vectors, _ = singular_vectors(lists, self.terms, k)
                spark = rows.sparkSession
                self.basis = spark.createDataFrame(pd.DataFrame({"feature": np.arange(self.terms, dtype=np.int32), "vec": vectors.tolist()}), "feature int, vec array<double>")
                self.width = vectors.shape[1]
            else:
                basis, values = random_svd(w, key, k, self.size["n_iter"], self.size["n_oversamples"], self.size["random_state"] or 0)
                self.basis, self.width = checkpointed(basis), len(values)
        return self

    def _weights(self, rows: DataFrame, key: str, column: str) -> DataFrame:
        o = self.options
        return T.weights(self._terms(rows, key, column), self.vocabulary, key, o["sublinear_tf"], o["binary"], o["norm"]).select(key, "feature", "value")

    def _reduced(self, rows: DataFrame, key: str, column: str) -> DataFrame:
        """(key, vec) of the texts that have known terms."""
        w, width = self._weights(rows, key, column), self.width
        kind = dict(rows.dtypes)[key]
        if self.terms * width > MOST_BASIS:
            return summed(w.join(self.basis, "feature"), key, kind)
        basis = np.zeros((self.terms, width))
        for r in self.basis.toLocalIterator():
            basis[r["feature"]] = r["vec"]

        def project(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in incoming:
                if batch.num_rows:
                    features, values = batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy()
                    sizes = np.diff(batch.column(1).offsets.to_numpy())
                    order = np.lexsort((features, np.repeat(np.arange(len(sizes)), sizes)))  # the same sums whatever the order
                    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
                    yield _vectors(batch.column(0).to_pylist(), np.add.reduceat(basis[features[order]] * values[order][:, None], starts, 0), batch.column(0).type, key)

        lists = w.groupBy(key).agg(F.collect_list("feature").alias("features"), F.collect_list("value").alias("values"))
        return lists.mapInArrow(project, f"`{key}` {kind}, vec array<double>")

    def transform(self, rows: DataFrame, key: str, column: str) -> DataFrame:
        """(key, vec), a row for each row; a text without known terms has zeros."""
        out = rows.select(key, column)
        parts = []
        if self.flag in (1, 2):
            out = out.join(self._reduced(rows, key, column).withColumnRenamed("vec", "_tfidf"), key, "left")
            parts.append(F.coalesce("_tfidf", F.array_repeat(F.lit(0.0), self.width)))
        if self.flag in (2, 3):
            name = str(self.transformer.get("type", "sentencetbiobert")).lower()
            kwargs = self.transformer.get("kwargs") or {}
            size = int(kwargs.get("batch_size", 1000))
            if name in ENCODERS:
                given = ENCODERS[name]
                load = lambda: given
            elif name in LOADERS:
                load = LOADERS[name]
            elif name in MODELS:
                path = kwargs.get("path", MODELS[name])
                load = lambda: language_model(path)
            else:
                raise ValueError(f"no encoder {name!r}; give it to register_encoder or register_loader")
            token = f"{name}-{uuid.uuid4().hex}" if name in ENCODERS or name in LOADERS else f"{name}:{path}"

            @F.pandas_udf("array<double>")
            def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
                encode = _loaded(token, load)
                for b in batches:
                    yield pd.Series(list(encode_in_batches(encode, b.fillna("").tolist(), size)))

            out = out.withColumn("_encoded", encoded(F.col(column)))
            parts.append(F.col("_encoded"))
        return out.select(key, unit(F.concat(*parts) if len(parts) > 1 else parts[0]).alias("vec"))

    def save(self, folder: str, spark: SparkSession) -> None:
        """Tables and a configuration; it is an error if the folder has an encoder."""
        held = {k: getattr(self, k) for k in ("vectorizer", "transformer", "dimension", "flag", "width", "terms")}
        spark.createDataFrame([(json.dumps(held),)], "value string").coalesce(1).write.text(f"{folder}/config")
        if self.vocabulary is not None:
            self.vocabulary.write.parquet(f"{folder}/vocabulary")
            self.basis.write.parquet(f"{folder}/basis")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> TextEncoder:
        held = json.loads(spark.read.text(f"{folder}/config", wholetext=True).first()[0])
        out = cls(held["vectorizer"], held["transformer"], held["dimension"], held["flag"])
        out.width, out.terms = held["width"], held["terms"]
        if out.flag in (1, 2) and out.terms:
            out.vocabulary, out.basis = spark.read.parquet(f"{folder}/vocabulary"), spark.read.parquet(f"{folder}/basis")
        return out
