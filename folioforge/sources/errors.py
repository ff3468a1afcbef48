"""Stable error codes; a document's error is a value in its row and never fails a task."""

from __future__ import annotations

#: Codes of errors and the exit codes of the command line (fixed values).
EXIT_CODES = {
    "usage": 1, "unsupported": 2, "needsOcr": 3, "malformed": 4, "encrypted": 4, "resourceLimit": 4, "missingPart": 4, "io": 4,
    "ocrAuth": 4, "ocrRateLimited": 4, "ocrProvider": 4, "canceled": 4, "ocrUnavailable": 5, "ocrProtocol": 5,
}


class DocumentError(Exception):
    def __init__(self, code: str, message: str, pages: list[int] | None = None, page_count: int = 0):
        super().__init__(message)
        self.code, self.message, self.pages, self.page_count = code, message, pages or [], page_count

    def row(self) -> dict:
        return {"code": self.code, "message": self.message, "pages": self.pages, "page_count": self.page_count}


def is_fatal(code: str) -> bool:
    """Whether the whole document fails, and not only the part where it happened."""
    return code == "resourceLimit"
