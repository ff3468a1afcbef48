"""The largest picture of each PDF page: raw samples of Flate pictures, the bytes of JPEG ones."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.session import prepare
from folioforge.sources.errors import DocumentError
from folioforge.sources.pdf_objects import Pdf, Stream

MOST_PIXELS, FORMS = 104_857_600, 8
IMAGE = "page int, width int, height int, bits int, color string, encoding string, data binary"


def pictures(pdf: Pdf, resources: dict, depth: int = 0):
    """Picture streams of the resources and of their forms."""
    for ref in pdf.dict(resources.get("XObject")).values():
        x = pdf.get(ref)
        if not isinstance(x, Stream):
            continue
        if x.data.get("Subtype") == "Image":
            yield x
        elif x.data.get("Subtype") == "Form" and depth < FORMS:
            yield from pictures(pdf, pdf.dict(x.data.get("Resources")), depth + 1)


def color_of(pdf: Pdf, space) -> str:
    """gray, rgb, cmyk, indexed or the space's own name."""
    space = pdf.get(space)
    if isinstance(space, list) and space:
        name = str(pdf.get(space[0]))
        if name == "ICCBased" and len(space) > 1:
            return {1: "gray", 3: "rgb", 4: "cmyk"}.get(int(pdf.number(pdf.dict(space[1]).get("N"))), name)
        return "indexed" if name == "Indexed" else name
    return {"DeviceGray": "gray", "DeviceRGB": "rgb", "DeviceCMYK": "cmyk", "None": "gray"}.get(str(space), str(space))


def page_image(pdf: Pdf, page: dict) -> dict | None:
    best, area = None, 0.0
    for x in pictures(pdf, pdf.dict(page.get("Resources"))):
        size = pdf.number(x.data.get("Width")) * pdf.number(x.data.get("Height"))
        if area < size <= MOST_PIXELS:
            best, area = x, size
    if best is None:
        return None
    filters = pdf.get(best.data.get("Filter"))
    last = str(pdf.get(filters[-1]) if isinstance(filters, list) and filters else filters)
    data = best.raw if last in ("DCTDecode", "JPXDecode") else pdf.decode(best)
    encoding = {"DCTDecode": "jpeg", "JPXDecode": "jpeg2000"}.get(last, "raw" if data is not None else last)
    return {"width": int(pdf.number(best.data.get("Width"))), "height": int(pdf.number(best.data.get("Height"))), "bits": int(pdf.number(best.data.get("BitsPerComponent"), 8)), "color": color_of(pdf, best.data.get("ColorSpace")), "encoding": encoding, "data": data or b""}


def page_images(files: DataFrame) -> DataFrame:
    """Rows (doc_id, page, width, height, bits, color, encoding, data), one for each page with a picture; files that aren't PDFs give none."""
    prepare(files.sparkSession)

    def run(batches):
        for b in batches:
            for doc, data in zip(b.column("doc_id").to_pylist(), b.column("content"), strict=True):
                try:
                    pdf = Pdf(data.as_py() or b"")
                    found = [(n, page_image(pdf, p)) for n, p in enumerate(pdf.pages, 1)]
                except (DocumentError, ValueError, TypeError, KeyError, IndexError):
                    continue
                for n, x in found:
                    if x is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([doc]), pa.array([n], pa.int32()), pa.array([x["width"]], pa.int32()), pa.array([x["height"]], pa.int32()), pa.array([x["bits"]], pa.int32()), pa.array([x["color"]]), pa.array([x["encoding"]]), pa.array([x["data"]], pa.binary())], names=["doc_id", "page", "width", "height", "bits", "color", "encoding", "data"])

    return files.select(F.col("doc_id").cast("string").alias("doc_id"), "content").mapInArrow(run, f"doc_id string, {IMAGE}")
