"""Reading and writing plain files of the shared folder inside tasks, by any scheme that pyarrow knows."""

from __future__ import annotations

from urllib.parse import unquote, urlparse

from pyarrow import fs


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; file:/x, file:///x and /x are local (shared) paths."""
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parts.path)
    return fs.FileSystem.from_uri(uri)
