"""Optional outside tools on the executors: legacy office files and text recognition.

Where a tool is missing or fails, the row carries the error (and the code of a failed recognition).
"""

from __future__ import annotations

import hashlib
import shutil
import subprocess
import tempfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

OFFICE_SECONDS, OCR_SECONDS = 120, 600
NEW_EXTENSION = {".doc": "docx", ".xls": "xlsx", ".ppt": "pptx"}


def _run(command: list[str], seconds: int) -> str | None:
    try:
        done = subprocess.run(command, capture_output=True, timeout=seconds, check=False)
    except subprocess.TimeoutExpired:
        return f"timed out after {seconds} s"
    return None if done.returncode == 0 else done.stderr.decode("utf-8", "replace")[-500:] or f"exit {done.returncode}"


def modern(path: str, content: bytes) -> tuple[bytes | None, str | None]:
    """(content in the new format, error)."""
    tool, suffix = shutil.which("soffice"), Path(path).suffix.lower()
    if suffix not in NEW_EXTENSION:
        return content, None
    if tool is None:
        return None, "no office suite found to convert a legacy file"
    with tempfile.TemporaryDirectory() as d:
        source = Path(d, "in" + suffix)
        source.write_bytes(content)
        error = _run([tool, f"-env:UserInstallation=file://{d}/profile", "--headless", "--convert-to", NEW_EXTENSION[suffix], "--outdir", d, str(source)], OFFICE_SECONDS)
        made = Path(d, f"in.{NEW_EXTENSION[suffix]}")
        return (made.read_bytes(), None) if made.exists() else (None, error or "no output")


def recognised(content: bytes) -> tuple[str | None, str | None]:
    """(text, error) of a page image file."""
    tool = shutil.which("ocrmypdf")
    if tool is None:
        return None, "no recognition tool found"
    with tempfile.TemporaryDirectory() as d:
        Path(d, "in.pdf").write_bytes(content)
        error = _run([tool, "--force-ocr", "--deskew", "--rotate-pages", "--language", "chi_sim+eng", "--sidecar", f"{d}/out.txt", f"{d}/in.pdf", f"{d}/out.pdf"], OCR_SECONDS)
        text = Path(d, "out.txt")
        return (text.read_text("utf-8"), None) if text.exists() else (None, error or "no output")


#: What the warnings of recognition say, and where.
RECOGNISED, FAILED, WHERE = "PDF 为扫描件，已通过 OCR 提取文本，质量可能低于原生文本", "OCR 提取失败: ", "全文"


def recognise(files: DataFrame) -> DataFrame:
    """(path, raw_md, warnings, ocr_used, error, source_size, source_sha256): the text between its marks, or the error."""
    schema = "path string, raw_md string, warnings array<struct<code:string,message:string,location:string>>, ocr_used boolean, error string, source_size bigint, source_sha256 string"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def one(path: str, content: bytes) -> dict:
        text, error = recognised(content)
        code, message = ("W_OCR_LOW_CONFIDENCE", RECOGNISED) if error is None else ("W_OCR_FAILED", FAILED + error)
        md = None if text is None else f"# {Path(path).stem}\n\n<!-- OCR_TEXT_START -->\n{text}\n<!-- OCR_TEXT_END -->\n"
        facts = {"source_size": len(content), "source_sha256": hashlib.sha256(content).hexdigest() if content else None}
        return {"path": path, "raw_md": md, "warnings": [{"code": code, "message": message, "location": WHERE}], "ocr_used": error is None, "error": error, **facts}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield pa.RecordBatch.from_pylist([one(path, content.as_py() or b"")], schema=arrow)

    return files.select("path", "content").mapInArrow(work, schema)
