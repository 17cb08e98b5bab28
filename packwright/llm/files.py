"""The library's durable stage tables, and files that tasks write and read by URI."""

from packwright.sources.files import filesystem, write_whole  # noqa: F401
from packwright.sources.staging import new_folder, released, staged, staged_lean  # noqa: F401

stored = staged
