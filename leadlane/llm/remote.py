"""Binary files in the shared folder, opened by tasks."""

from __future__ import annotations

from pyarrow import fs


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path within it."""
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
