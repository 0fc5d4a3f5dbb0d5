"""Extractors as table functions, for SQL over files."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from . import extract as X
from .files import MOST_DOCUMENT, SECONDS


class DocumentSegments:
    """Of (path, content): format, label, start, text of each segment; a plain text is one without a label, a refused file none."""

    def eval(self, path: str, content: bytes) -> Iterator[tuple]:
        if path is None or content is None:
            return
        _, kind, text, segments, _, _, code, _ = X.read(path, bytes(content), MOST_DOCUMENT, SECONDS)
        if code is None and not segments:
            yield kind, None, 0, text
        elif code is None:
            ends = [s["start"] - 1 for s in segments[1:]] + [len(text)]
            for s, end in zip(segments, ends):
                yield kind, s["label"], s["start"], text[s["start"] : end]


class FileIssue:
    """Of (path, content): code, reason of a file that has no text."""

    def eval(self, path: str, content: bytes) -> Iterator[tuple]:
        if path is not None and content is not None:
            *_, code, reason = X.read(path, bytes(content), MOST_DOCUMENT, SECONDS)
            if code is not None:
                yield code, reason


def register(spark: SparkSession) -> None:
    """document_segments(path, content) and file_issue(path, content) for SQL, used with LATERAL."""
    spark.udtf.register("document_segments", udtf(DocumentSegments, returnType="format string, label string, start int, text string"))
    spark.udtf.register("file_issue", udtf(FileIssue, returnType="code string, reason string"))
