"""Where the public tokenizers' files are; they are parameters and never copied."""

from __future__ import annotations

import base64
import hashlib
from pathlib import Path

import public_tokenizers

PATTERN = public_tokenizers.PATTERN


def path(name: str) -> str:
    return public_tokenizers.path(name)


def ranks(file: str) -> dict[bytes, int]:
    with open(file, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def digest(file: str) -> str:
    """Tells versions of a tokenizer apart."""
    return hashlib.sha256(Path(file).read_bytes()).hexdigest()[:16]
