"""Bundles of a gain map: its metadata, an optional colour profile, and its own coded image, one after another with their sizes."""

from __future__ import annotations

import struct


def write(metadata: bytes, image: bytes, profile: bytes = b"", version: int = 0) -> bytes:
    """Sizes are big-endian; the image goes to the end. No coded colour description: its size is a zero byte."""
    if len(metadata) >= 1 << 16:
        raise ValueError("metadata of more than 65,535 bytes")
    return struct.pack(">BH", version, len(metadata)) + metadata + b"\0" + struct.pack(">I", len(profile)) + profile + image


def read(bundle: bytes) -> dict[str, bytes | int]:
    """The parts again; a bundle that breaks off is an error."""
    try:
        version, size = struct.unpack_from(">BH", bundle)
        at = 3 + size
        at += 1 + bundle[at]  # a coded colour description, if any
        (profile,) = struct.unpack_from(">I", bundle, at)
    except (struct.error, IndexError) as e:
        raise ValueError("the bundle breaks off") from e
    at += 4
    if at + profile > len(bundle):
        raise ValueError("the bundle breaks off")
    return {"version": version, "metadata": bundle[3 : 3 + size], "profile": bundle[at : at + profile], "image": bundle[at + profile :]}
