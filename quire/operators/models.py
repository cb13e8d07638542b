"""The hook for external models: batches of rows go through a provider and come back as rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts to results, in order; a result of None means that the request failed.
Provider = Callable[[list[str]], list[str | None]]
_providers: dict[str, Callable[[], Provider]] = {}


def register_provider(name: str, make: Callable[[], Provider]) -> None:
    """``make`` runs in each worker, so clients and their connections need not be sent."""
    _providers[name] = make


def _stub() -> Provider:
    """A deterministic stand-in: white space collapsed, words reversed."""
    return lambda texts: [" ".join(reversed(t.split())) for t in texts]


register_provider("stub", _stub)


def translate(rows: DataFrame, text_col: str, provider: str = "stub", batch_size: int = 32, attempts: int = 3) -> DataFrame:
    """rows plus translated and final_status.

    Blank texts are kept without a request.  A batch is tried up to ``attempts`` times; then each of its texts is tried alone, and what
    fails again is ``failed`` with its source as the result.
    """
    make = _providers[provider]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = make()

        def tried(texts: list[str]) -> list[str | None]:
            for _ in range(attempts):
                try:
                    out = call(texts)
                except Exception:  # a provider may raise anything; the next attempt decides
                    continue
                if len(out) == len(texts):
                    return out
            return [None] * len(texts) if len(texts) == 1 else [x for t in texts for x in tried([t])]

        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            todo = [k for k, t in enumerate(texts) if t.strip()]
            made: list[str] = ["" for _ in texts]
            status = ["kept_origin" for _ in texts]
            for a in range(0, len(todo), batch_size):
                part = todo[a : a + batch_size]
                for k, out in zip(part, tried([texts[k] for k in part]), strict=True):
                    made[k], status[k] = (texts[k], "failed") if out is None else (out, "translated")
            yield batch.append_column("translated", pa.array(made, pa.string())).append_column("final_status", pa.array(status, pa.string()))

    schema = ", ".join([*[f"`{c}` {t}" for c, t in rows.dtypes], "translated string", "final_status string"])
    return rows.mapInArrow(run, schema)


def retry_failed(rows: DataFrame, text_col: str, provider: str = "stub") -> DataFrame:
    """Accepted rows as they are; failed ones once more."""
    columns = [c for c in rows.columns if c not in ("translated", "final_status")]
    again = translate(rows.where(F.col("final_status") == "failed").select(*columns), text_col, provider)
    return rows.where(F.col("final_status") != "failed").unionByName(again)
