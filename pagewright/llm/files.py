"""Binary files in the shared folder, from any executor."""

from __future__ import annotations

import re
import uuid

from pyarrow import fs


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder or file; plain paths and file: are the mounted share."""
    if m := re.match(r"^(?:file:(?://)?)?(/[^/].*)$", uri):
        return fs.LocalFileSystem(), m[1]
    return fs.FileSystem.from_uri(uri)


def write_whole(uri: str, write) -> None:
    """write(stream) into uri, which then appears at once; a repeated task writes the same again."""
    system, path = open_fs(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    temporary = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(temporary) as out:
        write(out)
    system.move(temporary, path)
