"""Optional readers of PDF files and images. The libraries are not needed by any operator; without them a reader
raises ImportError when it is called. They run in mapInPandas, one file a row, models once in each worker."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridquarry.sources import schemas


def files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, path, content of the PDF files under a path; doc_id is a hash of the path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path).select(
        F.xxhash64("path").alias("doc_id"), "path", "content"
    )


def _open(content: bytes):
    import fitz  # PyMuPDF

    return fitz.open(stream=bytes(content), filetype="pdf")


def _per_document(read, schema):
    """A mapInPandas function that turns each file into rows."""

    def run(frames):
        import pandas as pd

        for pdf in frames:
            for doc_id, content in zip(pdf["doc_id"], pdf["content"]):
                doc = _open(content)
                try:
                    for n, page in enumerate(doc, 1):
                        rows = [(doc_id, n, *r) for r in read(page)]
                        yield pd.DataFrame(rows, columns=schema.names)
                finally:
                    doc.close()

    return run


def _display(page):
    matrix = page.rotation_matrix if page.rotation else None

    def turn(box):
        import fitz

        r = fitz.Rect(box)
        return r * matrix if matrix is not None else r

    return turn


def lines(pdfs: DataFrame) -> DataFrame:
    """Text lines with block, direction and text."""

    def read(page):
        for b, block in enumerate(x for x in page.get_text("dict")["blocks"] if "lines" in x):
            for k, line in enumerate(block["lines"]):
                dx, dy = (round(v) for v in line["dir"])
                yield b, k, float(line["bbox"][1]), dx, dy, "".join(s["text"] for s in line["spans"])

    return pdfs.mapInPandas(_per_document(read, schemas.LINES), schemas.LINES)


def words(pdfs: DataFrame) -> DataFrame:
    """Words in the display frame."""

    def read(page):
        turn = _display(page)
        for k, w in enumerate(page.get_text("words")):
            r = turn(w[:4])
            yield k, r.x0, r.y0, r.x1, r.y1, w[4]

    return pdfs.mapInPandas(_per_document(read, schemas.WORDS), schemas.WORDS)


def spans(pdfs: DataFrame) -> DataFrame:
    """Text spans in the display frame."""

    def read(page):
        turn = _display(page)
        k = 0
        for block in page.get_text("dict")["blocks"]:
            for line in block.get("lines", ()):
                for s in line["spans"]:
                    r = turn(s["bbox"])
                    yield k, {"x0": r.x0, "y0": r.y0, "x1": r.x1, "y1": r.y1}, s["text"]
                    k += 1

    return pdfs.mapInPandas(_per_document(read, schemas.SPANS), schemas.SPANS)


def images(pdfs: DataFrame) -> DataFrame:
    """Embedded bitmaps with their share of the page."""

    def read(page):
        turn, w, h = _display(page), page.rect.width, page.rect.height
        for info in page.get_image_info(xrefs=True):
            r = turn(info["bbox"])
            yield info["xref"], {"x0": r.x0, "y0": r.y0, "x1": r.x1, "y1": r.y1}, info["width"], info["height"], r.width / w if w else 0.0, r.height / h if h else 0.0

    return pdfs.mapInPandas(_per_document(read, schemas.IMAGES), schemas.IMAGES)


def normalized(pdfs: DataFrame, pages: DataFrame) -> DataFrame:
    """pdfs with the pages that need a rotation (doc_id, page, needs_rotation) turned upright."""
    turns = pages.where("needs_rotation <> 0").groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("page", "needs_rotation"))).alias("turns"))
    both = pdfs.join(turns, "doc_id", "left")

    def run(frames):
        for pdf in frames:
            out = []
            for content, turn in zip(pdf["content"], pdf["turns"]):
                if turn:
                    doc = _open(content)
                    for n, degrees in dict(turn).items():
                        page = doc[n - 1]
                        page.set_rotation((page.rotation + degrees) % 360)
                    content = doc.tobytes()
                    doc.close()
                out.append(content)
            yield pdf.assign(content=out)[["doc_id", "path", "content"]]

    return both.mapInPandas(run, pdfs.schema)


def rendered(pdfs: DataFrame, pages: DataFrame, dpi: int = 300) -> DataFrame:
    """doc_id, page, png of the given pages (doc_id, page)."""
    wanted = pages.groupBy("doc_id").agg(F.collect_set("page").alias("pages"))

    def run(frames):
        import pandas as pd

        for pdf in frames:
            for doc_id, content, numbers in zip(pdf["doc_id"], pdf["content"], pdf["pages"]):
                doc = _open(content)
                rows = [(doc_id, int(n), doc[int(n) - 1].get_pixmap(dpi=dpi).tobytes("png")) for n in sorted(numbers)]
                doc.close()
                yield pd.DataFrame(rows, columns=["doc_id", "page", "png"])

    return pdfs.join(wanted, "doc_id").mapInPandas(run, "doc_id bigint, page int, png binary")


_MODELS: dict[str, object] = {}


def _model(name: str, make):
    """A model, made once in each worker."""
    if name not in _MODELS:
        _MODELS[name] = make()
    return _MODELS[name]


def layout_tables(pdfs: DataFrame) -> DataFrame:
    """doc_id, table_no, page, rect, rows, caption of the tables that the layout library finds, by (page, y0)."""
    schema = "doc_id bigint, table_no int, page int, rect struct<x0:double,y0:double,x1:double,y1:double>, rows array<array<string>>, caption string"

    def run(frames):
        import io

        import pandas as pd
        from docling.datamodel.base_models import DocumentStream
        from docling.document_converter import DocumentConverter

        for pdf in frames:
            for doc_id, path, content in zip(pdf["doc_id"], pdf["path"], pdf["content"]):
                found = _model("docling", DocumentConverter).convert(DocumentStream(name=path, stream=io.BytesIO(bytes(content)))).document
                rows = []
                for t in found.tables:
                    if not t.prov:
                        continue
                    at = t.prov[0]
                    box = at.bbox.to_top_left_origin(found.pages[at.page_no].size.height)
                    frame = t.export_to_dataframe(found)
                    cells = [[str(c) for c in frame.columns], *[["" if v is None else str(v) for v in r] for r in frame.itertuples(index=False)]]
                    rows.append((at.page_no, {"x0": box.l, "y0": box.t, "x1": box.r, "y1": box.b}, cells, t.caption_text(found)))
                rows.sort(key=lambda r: (r[0], r[1]["y0"]))
                yield pd.DataFrame([(doc_id, k, *r) for k, r in enumerate(rows, 1)], columns=["doc_id", "table_no", "page", "rect", "rows", "caption"])

    return pdfs.mapInPandas(run, schema)


def second_columns(pdfs: DataFrame, regions: DataFrame) -> DataFrame:
    """doc_id, table_no, plumber_cols: widest row that a second library reads in a region (doc_id, table_no, page, rect)."""
    wanted = regions.groupBy("doc_id").agg(F.collect_list(F.struct("table_no", "page", "rect")).alias("regions"))

    def run(frames):
        import io

        import pandas as pd
        import pdfplumber

        for pdf in frames:
            for doc_id, content, todo in zip(pdf["doc_id"], pdf["content"], pdf["regions"]):
                rows = []
                with pdfplumber.open(io.BytesIO(bytes(content))) as doc:
                    for r in todo:
                        page, box = doc.pages[r["page"] - 1], r["rect"]
                        x0, y0, x1, y1 = max(box["x0"], 0), max(box["y0"], 0), min(box["x1"], page.width), min(box["y1"], page.height)
                        widths = []
                        for how in ("text", "lines"):
                            if not widths and x1 - x0 >= 1 and y1 - y0 >= 1:
                                try:
                                    table = page.crop((x0, y0, x1, y1)).extract_table({"vertical_strategy": how, "horizontal_strategy": "text"})
                                    widths = [len(x) for x in table or []]
                                except Exception:  # noqa: BLE001  a second opinion must not end the run
                                    widths = []
                        rows.append((doc_id, r["table_no"], max(widths, default=None)))
                yield pd.DataFrame(rows, columns=["doc_id", "table_no", "plumber_cols"])

    return pdfs.join(wanted, "doc_id").mapInPandas(run, "doc_id bigint, table_no int, plumber_cols int")


def _image(png: bytes):
    import io

    from PIL import Image

    return Image.open(io.BytesIO(bytes(png))).convert("RGB")


def _detector():
    from paddlex import create_model

    return create_model("RT-DETR-L_wireless_table_cell_det")


def _reader():
    from paddleocr import PaddleOCR

    return PaddleOCR(lang="en", use_doc_orientation_classify=False, use_doc_unwarping=False, use_textline_orientation=False)


def _texts(image) -> list[str]:
    import numpy as np

    found = _model("ocr", _reader).predict(np.asarray(image)[:, :, ::-1])
    return [t for r in found for t in (r.get("rec_texts") or ())]


def detected_cells(images: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, page, box_no, x1, y1, x2, y2, score of the cells found in page images (doc_id, page, png)."""

    def run(frames):
        import numpy as np
        import pandas as pd

        for pdf in frames:
            for doc_id, page, png in zip(pdf["doc_id"], pdf["page"], pdf["png"]):
                found = _model("cells", _detector).predict(np.asarray(_image(png))[:, :, ::-1], threshold=threshold)
                boxes = [(*map(float, b["coordinate"][:4]), float(b["score"])) for r in found for b in r["boxes"]]
                yield pd.DataFrame([(doc_id, page, k, *b) for k, b in enumerate(boxes)], columns="doc_id page box_no x1 y1 x2 y2 score".split())

    return images.mapInPandas(run, "doc_id bigint, page int, box_no int, x1 double, y1 double, x2 double, y2 double, score double")


def image_texts(images: DataFrame) -> DataFrame:
    """doc_id, page, text: all text of page images, for keywords."""

    def run(frames):
        for pdf in frames:
            yield pdf.assign(text=[" ".join(_texts(_image(p))) for p in pdf["png"]])[["doc_id", "page", "text"]]

    return images.mapInPandas(run, "doc_id bigint, page int, text string")


def cell_reads(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """doc_id, page, box_no, conservative, enhanced, means, stds: two reads of each box (plain with narrow margins;
    wider on the left and twice as large), and its colour channels' means and deviations for swatches."""
    todo = boxes.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("box_no", "x1", "y1", "x2", "y2"))).alias("boxes"))
    columns = "doc_id page box_no conservative enhanced means stds".split()

    def run(frames):
        import numpy as np
        import pandas as pd

        for pdf in frames:
            for doc_id, page, png, own in zip(pdf["doc_id"], pdf["page"], pdf["png"], pdf["boxes"]):
                image, rows = _image(png), []
                for b in own:
                    x1, y1, x2, y2 = b["x1"], b["y1"], b["x2"], b["y2"]

                    def crop(left, x1=x1, y1=y1, x2=x2, y2=y2, image=image):
                        return image.crop((max(0, x1 - left), max(0, y1 - 2), x2 + 2, y2 + 2))

                    large = crop(6)
                    large = large.resize((2 * large.width, 2 * large.height), 1)  # Lanczos
                    means = stds = None
                    if x2 - x1 >= 6 and y2 - y1 >= 6:
                        px = np.asarray(image.crop((x1 + 2, y1 + 2, x2 - 2, y2 - 2)).resize((16, 16)), float).reshape(-1, 3)
                        means, stds = px.mean(0).tolist(), px.std(0).tolist()
                    rows.append((doc_id, page, b["box_no"], " ".join(_texts(crop(2))), " ".join(_texts(large)), means, stds))
                yield pd.DataFrame(rows, columns=columns)

    schema = "doc_id bigint, page int, box_no int, conservative string, enhanced string, means array<double>, stds array<double>"
    return images.join(todo, ["doc_id", "page"]).mapInPandas(run, schema)
