"""Search as a service object, for whatever server stands before it."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.embed import QUERY, Embedder
from .operators.index import VectorIndex
from .operators.search import K, exact, response


class BadRequest(ValueError):
    """A request that the caller has to change (status 400)."""


@dataclass(frozen=True)
class ChunkResult:
    id: int
    case_no: str | None
    section: str | None
    chunk_index: int
    preview: str
    distance: float
    similarity: float


class SearchService:
    """Searches the chunks exactly, or through an index of them where one is given."""

    def __init__(self, spark: SparkSession, chunks: DataFrame | None, embedder: Embedder, index: VectorIndex | None = None):
        chunks = index.rows() if chunks is None and index is not None else chunks
        if chunks is None:
            raise RuntimeError("no chunks to search")
        one = chunks.where("embedding is not null").select(F.size("embedding").alias("n")).first()
        if one and one.n != embedder.dimension:
            raise ValueError(f"the chunks' vectors have {one.n} elements, the embedder's {embedder.dimension}")
        self.spark, self.chunks, self.embedder, self.index = spark, chunks, embedder, index

    def health(self) -> dict[str, str]:
        return {"status": "ok"}

    def search(self, query: str, k: int = K) -> dict[str, list[dict]]:
        """{"results": [...]}: at most k rows come to the driver."""
        query = (query or "").strip()
        if not query:
            raise BadRequest("the query is empty")
        vector = self.embedder.encode([QUERY + query])[0]
        if vector is None or k < 1:
            return {"results": []}
        found = exact(self.chunks, vector, k) if self.index is None else self.index.search(vector, k)
        rows = response(found).collect()
        return {"results": [asdict(ChunkResult(**r.asDict())) for r in rows]}

    def close(self) -> None:
        self.chunks = self.index = None
