"""Files that tasks write and read by URI."""

from __future__ import annotations

import uuid


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_whole(uri: str, parts) -> int:
    """Writes the byte strings to a new file and gives it its name at the end; a repeated task just replaces it."""
    system, path = filesystem(uri)
    folder = path.rpartition("/")[0]
    system.create_dir(folder, recursive=True)
    draft, size = f"{folder}/.{uuid.uuid4().hex}", 0
    with system.open_output_stream(draft) as out:
        for part in parts:
            out.write(part)
            size += len(part)
    if system.type_name != "local" and system.get_file_info(path).type.name == "File":
        system.delete_file(path)
    system.move(draft, path)
    return size
