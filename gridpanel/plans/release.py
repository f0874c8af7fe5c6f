"""Release archives: the same bytes for the same files, with a list of their hashes, refused if a text holds a secret."""

from __future__ import annotations

import hashlib
import json
import re
import zipfile
from pathlib import Path

from ..functions.text import SECRETS


def secret_in(text: str) -> str | None:
    return next((name for name, pattern in SECRETS if re.search(pattern, text)), None)


def build(files: dict[str, Path], out: Path, allowed: tuple[str, ...] = (".py", ".md", ".txt", ".csv", ".json")) -> dict[str, str]:
    """Write the ZIP with members in name order and fixed dates, and a member that lists their SHA-256; existing output is refused."""
    if out.exists():
        raise FileExistsError(out)
    hashes: dict[str, str] = {}
    with zipfile.ZipFile(out.with_suffix(".part"), "w", zipfile.ZIP_DEFLATED) as z:

        def put(name: str, data: bytes) -> None:
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type, info.external_attr = zipfile.ZIP_DEFLATED, 0o644 << 16
            z.writestr(info, data)

        for name in sorted(files):
            data = files[name].read_bytes()
            if files[name].suffix not in allowed or name.startswith("/") or ".." in name.split("/"):
                raise ValueError(f"{name} isn't for release")
            if kind := secret_in(data.decode("utf-8", "replace")):
                raise ValueError(f"{name} holds a {kind}")
            hashes[name] = hashlib.sha256(data).hexdigest()
            put(name, data)
        put("SHA256.json", json.dumps(hashes, indent=2, sort_keys=True).encode())
    out.with_suffix(".part").rename(out)
    return hashes
