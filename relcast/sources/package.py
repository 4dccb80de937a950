"""Packages: ZIP archives with a SQLite collection and a media map, read on executors from ``binaryFile`` rows.

Writing makes one archive on the driver, as a package is one file of one release.
"""

from __future__ import annotations

import hashlib
import io
import json
import os
import sqlite3
import tempfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Names inside a package.
COLLECTIONS = ("collection.anki21b", "collection.anki21", "collection.anki2")
MEDIA_MAP, META = "media", "meta"
VERSIONS = {3: "latest", 2: "legacy2"}


def probe(archive: zipfile.ZipFile) -> str:
    """latest, legacy2 or legacy1: by the version in ``meta``, or else by what is there."""
    names = set(archive.namelist())
    if META in names:
        body = archive.read(META)
        return VERSIONS.get(body[1] if len(body) > 1 and body[0] == 8 else 0, "legacy1")
    return "latest" if COLLECTIONS[0] in names else "legacy2" if COLLECTIONS[1] in names else "legacy1"


def unpacked(body: bytes) -> bytes:
    if body[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        try:
            return zstandard.ZstdDecompressor().decompressobj().decompress(body)
        except zstandard.ZstdError as e:
            raise ValueError(str(e)) from e
    return body


def varint(body: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = body[at]
        value, shift, at = value | (byte & 127) << shift, shift + 7, at + 1
        if byte < 128:
            return value, at


def media_names(body: bytes) -> list[str]:
    """File names by index: a JSON map of indices, or a list of messages whose first field is the name."""
    body = unpacked(body)
    if body[:1] == b"{":
        return [name for _, name in sorted((int(k), v) for k, v in json.loads(body).items())]
    out, at = [], 0
    while at < len(body):
        _, at = varint(body, at)
        size, at = varint(body, at)
        inner, end = at, at + size
        while inner < end:
            tag, inner = varint(body, inner)
            value, inner = varint(body, inner)
            if tag & 7 == 2:
                if tag >> 3 == 1:
                    out.append(body[inner : inner + value].decode())
                inner += value
        at = end
    return out


def inspect_packages(files: DataFrame) -> DataFrame:
    """(path, version, entry, name, size, sha1, issue): media and collections of each package; a broken one has an issue."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                rows = []
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content))
                    version, present = probe(archive), set(archive.namelist())
                    for i, name in enumerate(media_names(archive.read(MEDIA_MAP)) if MEDIA_MAP in present else []):
                        body = unpacked(archive.read(str(i))) if str(i) in present else None
                        rows.append((path, version, str(i), name, None if body is None else len(body), None if body is None else hashlib.sha1(body).hexdigest(), None if body is not None else "missing_payload"))
                    if MEDIA_MAP not in present:
                        rows.append((path, version, MEDIA_MAP, None, None, None, "missing_media_map"))
                    if not present & set(COLLECTIONS):
                        rows.append((path, version, "collection", None, None, None, "missing_collection"))
                except (zipfile.BadZipFile, ValueError, IndexError) as e:
                    rows.append((path, None, None, None, None, None, f"unreadable: {type(e).__name__}"))
                yield pd.DataFrame(rows, columns=["path", "version", "entry", "name", "size", "sha1", "issue"])

    return files.select("path", "content").mapInPandas(run, "path string, version string, entry string, name string, size bigint, sha1 string, issue string")


def collection_tables(files: DataFrame, sql: str, schema: str) -> DataFrame:
    """Rows of a query on each package's collection, with the package's path first.

    A package that can't be read, or has no collection, gives no rows; ``inspect_packages`` tells its issue.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content))
                    name = next((n for n in COLLECTIONS if n in archive.namelist()), None)
                    body = None if name is None else unpacked(archive.read(name))
                except (zipfile.BadZipFile, ValueError):
                    body = None
                if body is None or not body.startswith(b"SQLite format 3\0"):
                    continue
                db = sqlite3.connect(":memory:")
                db.create_collation("unicase", lambda a, b: (a.lower() > b.lower()) - (a.lower() < b.lower()))
                db.deserialize(body)
                rows = pd.read_sql_query(sql, db)
                rows.insert(0, "path", path)
                yield rows

    return files.select("path", "content").mapInPandas(run, f"path string, {schema}")


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def write_package(notes: DataFrame, media: dict[str, bytes], path: str) -> str:
    """A legacy package of notes (id, guid, mid, tags, flds, sfld, csum, mtime) and media; its SHA-1.

    Rows come to the driver partition by partition; the file appears under its name when it is whole.
    """
    with tempfile.TemporaryDirectory() as folder:
        base = os.path.join(folder, "collection")
        db = sqlite3.connect(base)
        db.execute("CREATE TABLE notes (id integer primary key, guid text, mid integer, mod integer, usn integer, tags text, flds text, sfld integer, csum integer, flags integer, data text)")
        db.executemany("INSERT INTO notes VALUES (?,?,?,?,-1,?,?,?,?,0,'')", ((r["id"], r["guid"], r["mid"], r["mtime"], r["tags"], r["flds"], r["sfld"], r["csum"]) for r in notes.toLocalIterator()))
        db.commit()
        db.close()
        part = f"{path}.part"
        with zipfile.ZipFile(part, "w", zipfile.ZIP_DEFLATED) as out:
            out.write(base, COLLECTIONS[2])
            for i, body in enumerate(media.values()):
                out.writestr(str(i), body)
            out.writestr(MEDIA_MAP, json.dumps({str(i): name for i, name in enumerate(media)}))
    os.replace(part, path)
    with open(path, "rb") as made:
        return hashlib.sha1(made.read()).hexdigest()
