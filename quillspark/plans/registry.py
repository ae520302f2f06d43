"""Embedders and indexes by name.  Names register with the parameters they need; making one is lazy."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass
class Registry:
    kind: str
    entries: dict[str, tuple[tuple[str, ...], Callable]] = field(default_factory=dict)

    def register(self, name: str, required: tuple[str, ...] = ()) -> Callable[[Callable], Callable]:
        def put(factory: Callable) -> Callable:
            self.entries[name] = (required, factory)
            return factory

        return put

    def names(self) -> list[str]:
        return sorted(self.entries)

    def _entry(self, name: str) -> tuple[tuple[str, ...], Callable]:
        if name not in self.entries:
            raise KeyError(f"unknown {self.kind} {name!r}; registered: {', '.join(self.names())}")
        return self.entries[name]

    def required(self, name: str) -> tuple[str, ...]:
        return self._entry(name)[0]

    def resolve(self, name: str, params: dict | None = None):
        required, factory = self._entry(name)
        missing = [p for p in required if p not in (params or {})]
        if missing:
            raise ValueError(f"{self.kind} {name!r} needs {', '.join(missing)}")
        return factory(**(params or {}))


EMBEDDERS = Registry("embedder")
INDEXES = Registry("index")


class TfIdfEmbedder:
    """Sparse vectors; (chunk_id, term, weight)."""

    sparse = True

    def __init__(self, max_features: int | None = None) -> None:
        self.max_features, self.model = max_features, None

    def fit(self, chunks):
        from pyspark.sql import functions as F

        from ..functions import text as tx
        from ..operators import postings

        self.model = postings.fit_tfidf(chunks, "chunk_id", tx.tfidf_terms(F.col("text")), self.max_features)
        return self

    def encode(self, docs, doc: str = "chunk_id", text: str = "text", is_query: bool = False):
        from pyspark.sql import functions as F

        from ..functions import text as tx
        from ..operators import postings

        if self.model is None:
            raise RuntimeError("the embedder is not fitted")
        return postings.tfidf_vectors(docs, doc, tx.tfidf_terms(F.col(text)), self.model)


class WordVectorEmbedder:
    """Averaged word vectors; (chunk_id, embedding)."""

    sparse = False

    def __init__(self, vectors_path: str, limit: int = 500_000) -> None:
        self.vectors_path, self.limit, self.model = vectors_path, limit, None

    def fit(self, chunks):
        from ..operators import embedders

        self.model = embedders.fit_word_idf(chunks, "chunk_id", "text")
        return self

    def encode(self, docs, doc: str = "chunk_id", text: str = "text", is_query: bool = False):
        from ..operators import embedders
        from ..sources.records import load_word_vectors

        if self.model is None:
            raise RuntimeError("the embedder is not fitted")
        return embedders.average_word_vectors(docs, doc, text, load_word_vectors(docs.sparkSession, self.vectors_path, self.limit), self.model)


class NeuralEmbedder:
    """A sentence-transformers model; raises where the library is not installed."""

    sparse = False

    def __init__(self, model_name: str, prefix: bool = False, batch_size: int = 16) -> None:
        self.model_name, self.prefix, self.batch_size = model_name, prefix, batch_size

    def fit(self, chunks):
        return self

    def encode(self, docs, doc: str = "chunk_id", text: str = "text", is_query: bool = False):
        from ..operators import embedders

        return embedders.neural_vectors(docs, doc, text, self.model_name, is_query=is_query, prefix=self.prefix, batch_size=self.batch_size)


EMBEDDERS.register("tfidf")(TfIdfEmbedder)
EMBEDDERS.register("fasttext-avg", ("vectors_path",))(WordVectorEmbedder)
EMBEDDERS.register("bge-m3")(lambda **p: NeuralEmbedder("BAAI/bge-m3", **p))
EMBEDDERS.register("e5-base")(lambda **p: NeuralEmbedder("intfloat/multilingual-e5-base", prefix=True, **p))


@dataclass(frozen=True)
class ExactIndex:
    """All vectors, dense or sparse."""

    approximate = False

    def check(self, sparse: bool) -> None:
        return None


@dataclass(frozen=True)
class ListIndex:
    """Inverted lists fitted on a sample, scored exactly; dense vectors only."""

    target: float = 0.95
    approximate = True

    def check(self, sparse: bool) -> None:
        if sparse:
            raise TypeError("the approximate index takes dense vectors only")


INDEXES.register("numpy")(ExactIndex)
INDEXES.register("exact")(ExactIndex)
# Names of approximate indexes in configuration files; each is served by inverted lists.
for _name in ("faiss", "faiss-hnsw", "lists"):
    INDEXES.register(_name)(ListIndex)
