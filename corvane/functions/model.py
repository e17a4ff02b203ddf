"""The pluggable text model: summaries and answers as columns, embeddings of batches of texts."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column

from corvane.functions import text as T
from corvane.functions.vectors import embed_texts


class TextModel(Protocol):
    def summary(self, prompt: Column) -> Column: ...

    def answer(self, prompt: Column) -> Column: ...

    def embed(self, texts: list[str | None]) -> object:
        """A vector a text; runs in Python workers."""


class OfflineModel:
    """Deterministic, without a service: the first lines, the retrieved context, hashed bags of words."""

    def summary(self, prompt: Column) -> Column:
        return T.heuristic_summary(prompt)

    def answer(self, prompt: Column) -> Column:
        return T.fallback_answer(prompt)

    def embed(self, texts: list[str | None]) -> object:
        return embed_texts(texts)


OFFLINE = OfflineModel()
