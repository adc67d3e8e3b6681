"""Images as files: codecs passed through, samples written as PNG, the rest with a reason."""

from __future__ import annotations

import struct
import zlib
from typing import NamedTuple

import numpy as np

from foliospark.sources.pdf_pages import COMPONENTS, RawImage


class Picture(NamedTuple):
    """``data`` in ``format``, or the reason why there is none."""

    name: str
    width: int
    height: int
    format: str | None
    data: bytes | None
    reason: str | None
    lost_mask: bool

    @property
    def file_name(self) -> str:
        return f"{self.name}.{self.format}"


def png(samples: np.ndarray) -> bytes:
    """``samples``: height, width and 1 or 3 channels of bytes."""
    h, w, channels = samples.shape
    rows = np.zeros((h, w * channels + 1), np.uint8)
    rows[:, 1:] = samples.reshape(h, -1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", w, h, 8, 2 if channels == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def cmyk_to_rgb(samples: np.ndarray) -> np.ndarray:
    a = 255 - samples.astype(np.int64)
    return (a[..., :3] * a[..., 3:] // 255).astype(np.uint8)


def _samples(raw: RawImage) -> np.ndarray:
    """Gray or RGB samples; ValueError with the reason where there are none."""
    if raw.bits != 8:
        raise ValueError(f"{raw.bits}-bit samples are not yet unpacked")
    space, data, what = raw.space, raw.data, {"cmyk": " CMYK", "indexed": ""}.get(raw.space, "")
    if space == "indexed" and raw.palette is None:
        raise ValueError("indexed image with no palette")
    if space == "other":
        raise ValueError("unresolved colour space")
    each = COMPONENTS.get(space, 1)
    need = raw.width * raw.height * each
    if len(data) < need:
        kind = "index" if space == "indexed" else "sample"
        tail = "" if space == "indexed" else f" needing {need}"
        raise ValueError(f"truncated: {len(data)} {kind} bytes for a {raw.width}x{raw.height}{what} image{tail}")
    a = np.frombuffer(data, np.uint8, need).reshape(raw.height, raw.width, each)
    if space == "indexed":
        space, entries = raw.palette
        n = COMPONENTS[space]
        table = np.zeros((256, n), np.uint8)
        known = np.frombuffer(entries[: min(len(entries) // n, 256) * n], np.uint8).reshape(-1, n)
        table[: len(known)] = known
        a = table[a[..., 0]]
    return cmyk_to_rgb(a) if space == "cmyk" else a


def picture(raw: RawImage) -> Picture:
    last = raw.filters[-1] if raw.filters else ""
    whole = lambda kind, data, reason=None: Picture(raw.name, raw.width, raw.height, kind, data, reason, raw.has_mask)
    if last == "DCTDecode":
        return whole("jpg", raw.data)
    if last == "JPXDecode":
        return whole("jp2", raw.data)
    if last in ("CCITTFaxDecode", "JBIG2Decode"):
        return whole(None, None, f"{last} is not decoded")
    try:
        return whole("png", png(_samples(raw)))
    except ValueError as e:
        return whole(None, None, str(e))
