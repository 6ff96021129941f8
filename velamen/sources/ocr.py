"""Text of pictures by an external program, where there is one."""

from __future__ import annotations

import os
import shutil
import subprocess
import tempfile

from pyspark.sql import Column

from ..functions.udfs import arrow_udf

SECONDS = 120


def command(configured: str | None = None) -> str | None:
    """The program to run: a configured one, the one VELAMEN_TESSERACT names, or the one on the path."""
    return configured or os.environ.get("VELAMEN_TESSERACT") or shutil.which("tesseract")


def recognize(content: bytes, program: str | None = None, language: str = "spa") -> tuple[str | None, str | None]:
    """(text, error) of a picture; tabs, which stand for cells elsewhere, become blanks."""
    found = command(program)
    if not found:
        return None, "El reconocimiento de texto no esta disponible."
    path = None
    try:
        with tempfile.NamedTemporaryFile(suffix=".img", delete=False) as f:
            path = f.name
            f.write(content)
        done = subprocess.run([found, path, "stdout", "-l", language], capture_output=True, timeout=SECONDS, check=False)
    except (OSError, subprocess.TimeoutExpired):
        return None, "No se pudo reconocer el texto de la imagen."
    finally:
        if path:
            os.unlink(path)
    if done.returncode:
        return None, "No se pudo reconocer el texto de la imagen."
    text = done.stdout.decode("utf-8", "replace").replace("\t", " ")
    return (text, None) if text.strip() else (None, "La imagen no contiene texto reconocible.")


def recognized(content: Column, program: str | None = None, language: str = "spa") -> Column:
    """struct(text, error) of pictures' bytes."""

    def run(data):
        text, error = recognize(bytes(data or b""), program, language)
        return {"text": text, "error": error}

    return arrow_udf("struct<text:string,error:string>")(run)(content)
