"""Pictures of one document: sources to bytes, signatures, sizes."""

from __future__ import annotations

import base64
import binascii
import hashlib
import os
import re
import struct
from collections.abc import Callable
from urllib.parse import unquote, unquote_to_bytes

#: What a document's picture source resolves to; None where it is not to be had.
Resolver = Callable[[str], bytes | None]
# Content types by kind.
TYPES = {"png": "image/png", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "tiff": "image/tiff"}


def data_uri(source: str) -> bytes | None:
    m = re.match(r"data:([^,;]*)((?:;[^,;]*)*),", source, re.I)
    if not m:
        return None
    rest = source[m.end() :]
    if ";base64" not in m[2].lower():
        return unquote_to_bytes(rest)
    try:
        return base64.b64decode(re.sub(r"\s+", "", unquote(rest)), validate=True)
    except (binascii.Error, ValueError):
        return None


def resolver(folder: str | None = None, remote: Resolver | None = None) -> Resolver:
    """Data URIs always; files only below `folder`; http and https only through `remote`."""

    def resolve(source: str) -> bytes | None:
        if source[:5].lower() == "data:":
            return data_uri(source)
        if re.match(r"(https?:)?//", source, re.I):
            return remote(source) if remote else None
        if folder is None or re.match(r"[a-z][a-z0-9+.-]+:", source, re.I):
            return None
        base = os.path.realpath(folder)
        path = os.path.realpath(os.path.join(base, unquote(re.split(r"[?#]", source)[0]).lstrip("/")))
        if os.path.commonpath([base, path]) != base or not os.path.isfile(path):
            return None
        with open(path, "rb") as f:
            return f.read()

    return resolve


def _jpeg_size(data: bytes) -> tuple[int, int] | None:
    at = 2
    while at + 9 < len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        mark = data[at + 1]
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return width, height
        at += 2 if mark in (0xFF, 0x01) or 0xD0 <= mark <= 0xD9 else 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None


def _tiff_size(data: bytes) -> tuple[int, int] | None:
    order = "<" if data[:2] == b"II" else ">"
    (at,) = struct.unpack(f"{order}I", data[4:8])
    if at + 2 > len(data):
        return None
    (count,) = struct.unpack(f"{order}H", data[at : at + 2])
    found = {}
    for k in range(count):
        entry = data[at + 2 + 12 * k : at + 14 + 12 * k]
        if len(entry) < 12:
            break
        tag, kind = struct.unpack(f"{order}HH", entry[:4])
        if tag in (256, 257):
            found[tag] = struct.unpack(f"{order}H" if kind == 3 else f"{order}I", entry[8:10] if kind == 3 else entry[8:12])[0]
    return (found[256], found[257]) if len(found) == 2 else None


def inspect(data: bytes | None) -> dict | None:
    """{bytes, kind, type, width, height, hash} of a picture that a document can hold; None for anything else."""
    if data is None or len(data) < 16:
        return None
    kind, size = None, None
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            kind, size = "png", struct.unpack(">II", data[16:24])
        elif data[:3] == b"\xff\xd8\xff":
            kind, size = "jpeg", _jpeg_size(data)
        elif data[:6] in (b"GIF87a", b"GIF89a"):
            kind, size = "gif", struct.unpack("<HH", data[6:10])
        elif data[:2] == b"BM":
            width, height = struct.unpack("<ii", data[18:26])
            kind, size = "bmp", (width, abs(height))
        elif data[:4] in (b"II*\0", b"MM\0*"):
            kind, size = "tiff", _tiff_size(data)
    except struct.error:
        return None
    if kind is None or size is None or min(size) < 1:
        return None
    return {"bytes": data, "kind": kind, "type": TYPES[kind], "width": int(size[0]), "height": int(size[1]), "hash": hashlib.sha1(data).hexdigest()}


def shown_size(image: dict, width: float | None, height: float | None, room: float) -> tuple[float, float]:
    """Pixels: both as asked, one with the picture's shape, or its own; never wider than `room`, one at least."""
    ratio = image["height"] / image["width"]
    if width is None and height is None:
        width, height = float(image["width"]), float(image["height"])
    elif width is None:
        width = height / ratio
    elif height is None:
        height = width * ratio
    if width > room:
        width, height = room, height * room / width
    return max(1.0, width), max(1.0, height)
