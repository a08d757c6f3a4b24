"""Pages with their controls outlined, as PNG images."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType


def png(grey: np.ndarray) -> bytes:
    """A grey image of eight bits as a PNG file."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = np.hstack([np.zeros((grey.shape[0], 1), np.uint8), grey])
    head = struct.pack(">IIBBBBB", grey.shape[1], grey.shape[0], 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def outlined(grey: np.ndarray, boxes: list[tuple[int, int, int, int, bool]], width: int = 3) -> np.ndarray:
    """The image with each box (x, y, w, h, selected) outlined, the selected ones darker."""
    out = grey.copy()
    for x, y, w, h, selected in boxes:
        own = out[max(0, y) : y + h, max(0, x) : x + w]
        inner = own[width:-width, width:-width].copy()
        own[:] = 0 if selected else 120
        own[width:-width, width:-width] = inner
    return out


@F.arrow_udf(BinaryType())
def drawn(pages: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """A page's image (width, height, data) with its controls (in pixels) outlined; null without an image."""
    for images, controls in pages:
        out = []
        for image, listed in zip(images, controls.to_pylist(), strict=True):
            if not image.is_valid:
                out.append(None)
                continue
            grey = np.frombuffer(image["data"].as_buffer(), np.uint8).reshape(image["height"].as_py(), image["width"].as_py())
            out.append(png(outlined(grey, [(int(c["x"]), int(c["y"]), int(c["w"]), int(c["h"]), bool(c["selected"])) for c in listed or ()])))
        yield pa.array(out, pa.binary())
