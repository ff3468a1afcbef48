"""A template for an OCR program that folioforge calls: JSON lines on standard input and output.

Put your own engine into read_page(). A configuration file names the program:

    {"version": 1, "default": "own", "providers": {"own": {"command": ["./ocr_adapter.py"]}}}

Messages: hello (answered by hello with a name and a price a page), then recognize with an id, the
document in base64 and page numbers from 1, answered by result with the same id and a row a
page, or by error with a code and a message.
"""

from __future__ import annotations

import base64
import json
import sys

NAME, PAGE_COST = "template", 0.0


def read_page(document: bytes, page: int) -> dict:
    """The text of one page, and how sure of it the engine is (0 to 1; 0 says nothing)."""
    return {"markdown": f"Page {page} of {len(document)} bytes.", "confidence": 0.0}


def answer(message: dict) -> dict:
    if message.get("type") == "hello":
        return {"type": "hello", "protocol": 1, "name": NAME, "page_cost_usd": PAGE_COST}
    if message.get("type") != "recognize":
        return {"type": "error", "id": message.get("id"), "code": "unknown_message", "message": str(message.get("type"))}
    try:
        document = base64.b64decode(message["document"])
        return {"type": "result", "id": message["id"], "pages": [{"page": p, **read_page(document, p)} for p in message["pages"]]}
    except Exception as e:  # the program goes on with the next document
        return {"type": "error", "id": message.get("id"), "code": "failed", "message": f"{type(e).__name__}: {e}"}


if __name__ == "__main__":
    for line in sys.stdin:
        print(json.dumps(answer(json.loads(line))), flush=True)
