"""Vector stores behind HTTP: four public services spoken to by their own requests, in batches from the executors."""

from __future__ import annotations

import json
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FOUND = "vid string, type string, ref_id string, score double"
FIELDS = ("namespace", "project_name", "type", "ref_id")
Request = tuple[str, str, object]  # method, path, body: an object as JSON, text as it is


def _lines(rows: list[dict]) -> str:
    return "".join(json.dumps(r) + "\n" for r in rows)


def _meta(row: dict) -> dict:
    return {f: row[f] for f in FIELDS if row.get(f) is not None}


def _point_id(vid: str) -> str:
    """A stable identifier for a service whose ids are numbers or UUIDs."""
    return str(uuid.uuid5(uuid.NAMESPACE_URL, vid))


@dataclass(frozen=True)
class Dialect:
    """How a service is asked: rows an upsert takes at most, and its requests and answers."""

    batch: int
    upsert: Callable[[str, list[dict]], Request]
    search: Callable[[str, list[float], int, dict], Request]
    delete: Callable[[str, list[str]], Request]
    hits: Callable[[dict], list[tuple[str, dict, float]]]


# Paths and bodies of the services' public interfaces.
DIALECTS = {
    "qdrant": Dialect(
        100,
        lambda i, rows: ("PUT", f"/collections/{i}/points?wait=true", {"points": [{"id": _point_id(r["vid"]), "vector": r["embedding"], "payload": _meta(r) | {"vid": r["vid"]}} for r in rows]}),
        lambda i, v, k, where: ("POST", f"/collections/{i}/points/search", {"vector": v, "limit": k, "with_payload": True} | ({"filter": {"must": [{"key": a, "match": {"value": b}} for a, b in where.items()]}} if where else {})),
        lambda i, ids: ("POST", f"/collections/{i}/points/delete?wait=true", {"points": [_point_id(v) for v in ids]}),
        lambda r: [(h["payload"]["vid"], h["payload"], h["score"]) for h in r["result"]],
    ),
    "pinecone": Dialect(
        100,
        lambda i, rows: ("POST", "/vectors/upsert", {"namespace": i, "vectors": [{"id": r["vid"], "values": r["embedding"], "metadata": _meta(r)} for r in rows]}),
        lambda i, v, k, where: ("POST", "/query", {"namespace": i, "vector": v, "topK": k, "includeMetadata": True} | ({"filter": {a: {"$eq": b} for a, b in where.items()}} if where else {})),
        lambda i, ids: ("POST", "/vectors/delete", {"namespace": i, "ids": ids}),
        lambda r: [(h["id"], h.get("metadata") or {}, h["score"]) for h in r["matches"]],
    ),
    "opensearch": Dialect(
        500,
        lambda i, rows: ("POST", "/_bulk?refresh=true", "".join(_lines([{"index": {"_index": i, "_id": r["vid"]}}, _meta(r) | {"embedding": r["embedding"]}]) for r in rows)),
        lambda i, v, k, where: ("POST", f"/{i}/_search", {"size": k, "_source": {"excludes": ["embedding"]}, "query": {"knn": {"embedding": {"vector": v, "k": k} | ({"filter": {"bool": {"must": [{"term": {a: b}} for a, b in where.items()]}}} if where else {})}}}),
        lambda i, ids: ("POST", "/_bulk?refresh=true", _lines([{"delete": {"_index": i, "_id": v}} for v in ids])),
        lambda r: [(h["_id"], h["_source"], h["_score"]) for h in r["hits"]["hits"]],
    ),
    "vectorize": Dialect(
        1000,
        lambda i, rows: ("POST", f"/vectorize/v2/indexes/{i}/upsert", _lines([{"id": r["vid"], "values": r["embedding"], "metadata": _meta(r)} for r in rows])),
        lambda i, v, k, where: ("POST", f"/vectorize/v2/indexes/{i}/query", {"vector": v, "topK": k, "returnMetadata": "all"} | ({"filter": where} if where else {})),
        lambda i, ids: ("POST", f"/vectorize/v2/indexes/{i}/delete_by_ids", {"ids": ids}),
        lambda r: [(h["id"], h.get("metadata") or {}, h["score"]) for h in r["result"]["matches"]],
    ),
}


def _send(base: str, headers: dict[str, str], request: Request, tries: int = 3) -> dict:
    method, path, body = request
    raw = body if isinstance(body, str) else json.dumps(body)
    kind = "application/x-ndjson" if isinstance(body, str) else "application/json"
    asked = urllib.request.Request(base.rstrip("/") + path, raw.encode(), {"Content-Type": kind, **headers}, method=method)
    for left in reversed(range(tries)):
        try:
            with urllib.request.urlopen(asked, timeout=60) as answer:
                return json.loads(answer.read() or b"{}")
        except urllib.error.HTTPError as gone:
            if gone.code not in (429, 500, 502, 503, 504) or not left:
                raise
        except urllib.error.URLError:
            if not left:
                raise
    return {}


class HttpVectorStore:
    """One index of a service. Writes run as batches of the dialect's size from the tasks that hold the rows; they are idempotent, so a task that is tried again does no harm."""

    def __init__(self, spark: SparkSession, service: str, url: str, index: str, headers: dict[str, str] | None = None):
        if service not in DIALECTS:
            raise ValueError(f"no service {service}")
        self.spark, self.service, self.url, self.index, self.headers = spark, service, url, index, headers or {}

    def search(self, vector: list[float], k: int, where: dict[str, str] | None = None) -> DataFrame:
        d = DIALECTS[self.service]
        hits = d.hits(_send(self.url, self.headers, d.search(self.index, [float(x) for x in vector], k, where or {})))
        return self.spark.createDataFrame([(v, m.get("type"), m.get("ref_id"), float(s)) for v, m, s in hits], FOUND)

    def _sent(self, rows: DataFrame, delete: bool) -> int:
        service, url, index, headers = self.service, self.url, self.index, self.headers

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            d = DIALECTS[service]
            for b in batches:
                held = b.to_pylist()
                for at in range(0, len(held), d.batch):
                    part = held[at : at + d.batch]
                    _send(url, headers, d.delete(index, [r["vid"] for r in part]) if delete else d.upsert(index, part))
                yield pa.RecordBatch.from_arrays([pa.array([len(held)], pa.int64())], names=["n"])

        return rows.mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def upsert(self, rows: DataFrame) -> int:
        """Send rows with an id and a vector; how many."""
        kept = rows.where("vid is not null and size(embedding) > 0").dropDuplicates(["vid"])
        return self._sent(kept.select("vid", "embedding", *FIELDS), False)

    def delete(self, ids: DataFrame) -> int:
        return self._sent(ids.where("vid is not null").select("vid").distinct(), True)
