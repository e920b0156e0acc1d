"""Byte access to shared folders inside tasks, by the URIs that Spark uses."""

from __future__ import annotations

#: Hadoop's names of object stores, and what Arrow calls them.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "wasbs": "abfss", "wasb": "abfs"}


def arrow_uri(uri: str) -> str:
    """The URI with the scheme that Arrow knows; ``/path`` for local files."""
    scheme, found, rest = uri.partition(":")
    if not found or "/" in scheme:
        return uri
    return "/" + rest.lstrip("/") if scheme == "file" else f"{_SCHEMES.get(scheme, scheme)}:{rest}"


def filesystem(uri: str):
    """(Arrow file system, path) of a Hadoop-style URI: file, hdfs, viewfs, s3a / s3, gs, abfs(s); a path without a scheme
    is local.  A scheme that Arrow lacks raises with its name."""
    from pyarrow import fs

    uri = arrow_uri(uri)
    return (fs.LocalFileSystem(), uri) if "://" not in uri else fs.FileSystem.from_uri(uri)
