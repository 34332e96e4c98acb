"""What lies outside the engine, as interfaces with table-backed defaults; caches; skip rules (OP-EXT-*, OP-EMB-01, OP-CACHE-01)."""

from __future__ import annotations

import hashlib
import json
import time
from pathlib import Path
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    model: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Extractor(Protocol):
    def extract(self, chunk: str) -> str: ...


class Resolver(Protocol):
    def resolve(self, batch: list[dict]) -> list[dict]: ...


class BillFetcher(Protocol):
    def fetch(self, bill: str) -> bytes: ...


def embedded(texts: DataFrame, embedder: Embedder, done: DataFrame | None = None) -> DataFrame:
    """OP-EMB-01: vectors of (bill_dir, provision_index, embedding_text), batch by batch; bills in ``done`` (bill_dir,
    extraction_sha256) whose hash is unchanged are skipped where ``texts`` carries one."""
    rows = texts if done is None else texts.join(done, [c for c in ("bill_dir", "extraction_sha256") if c in texts.columns], "left_anti")

    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            yield pdf[["bill_dir", "provision_index"]].assign(vec=embedder.embed(pdf["embedding_text"].tolist()))

    return rows.select("bill_dir", "provision_index", "embedding_text").mapInPandas(run, "bill_dir string, provision_index long, vec array<float>")


def extracted(chunks: DataFrame, extractor: Extractor, tries: int = 3) -> DataFrame:
    """OP-EXT-01: each chunk's answer, or after ``tries`` (waiting 2, 4, … seconds) its error; never fails as a whole."""

    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            answers, errors = [], []
            for text in pdf["text"]:
                answer = error = None
                for k in range(tries):
                    try:
                        answer, error = extractor.extract(text), None
                        break
                    except Exception as e:  # noqa: BLE001
                        error = str(e)
                        if k + 1 < tries:
                            time.sleep(2 ** (k + 1))
                answers.append(answer)
                errors.append(error)
            yield pdf[["bill_dir", "ord"]].assign(answer=answers, error=errors)

    return chunks.select("bill_dir", "ord", "text").mapInPandas(run, "bill_dir string, ord long, answer string, error string")


def provenance(bills: DataFrame, model: str, version: str) -> DataFrame:
    """OP-EXT-02/HASH-03: per bill (bill_dir, source, chunks_total, chunks_completed) the hashes and versions of an extraction."""
    return bills.select("bill_dir", F.sha2("source", 256).alias("extracted_text_sha256"), F.lit(model).alias("model"), F.lit(version).alias("extraction_version"), "chunks_total", "chunks_completed")


def data_hash(folder: str) -> str:
    """OP-HASH-04: of the paths and modification times of all extractions below a local folder."""
    found = sorted(Path(folder).rglob("extraction.json"))
    return hashlib.sha256("".join(f"{p}:{p.stat().st_mtime_ns}\n" for p in found).encode()).hexdigest()[:16]


class SuggestionCache:
    """OP-CACHE-01: suggestions kept by command and data; a change of the data makes them stale."""

    def __init__(self, folder: str) -> None:
        self.folder = Path(folder)

    def _path(self, command: str, data: str) -> Path:
        return self.folder / f"{command}-{hashlib.sha256(data.encode()).hexdigest()[:16]}.json"

    def write(self, command: str, data: str, rows: list[dict]) -> None:
        self.folder.mkdir(parents=True, exist_ok=True)
        self._path(command, data).write_text(json.dumps({"data_hash": data_hash(data), "rows": rows}))

    def read(self, command: str, data: str) -> list[dict] | None:
        path = self._path(command, data)
        if not path.exists():
            return None
        held = json.loads(path.read_text())
        return held["rows"] if held["data_hash"] == data_hash(data) else None

    def find(self, command: str, data: str, hashes: list[str]) -> list[dict]:
        return [r for r in self.read(command, data) or [] if r.get("hash") in hashes]

    def clear(self) -> int:
        found = list(self.folder.glob("*.json")) if self.folder.exists() else []
        for p in found:
            p.unlink()
        return len(found)


def enacted(bills: DataFrame) -> DataFrame:
    """OP-FLT-10: bills whose latest action says that they became law."""
    low = F.lower("latest_action")
    return bills.where(F.contains(low, F.lit("became public law")) | F.contains(low, F.lit("became law")))


def about_appropriations(bills: DataFrame) -> DataFrame:
    """OP-FLT-11: bills whose title speaks of appropriations."""
    return bills.where(F.contains(F.lower("title"), F.lit("appropriation")))
