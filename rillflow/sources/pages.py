"""A provider's pages as a streaming source with offsets of its own.

A provider is a folder that all executors reach: `source_key=.../page=...` holds a
page as JSON lines, one for each item (external_id, url, published_s, text), or
one with the kind of the provider's failure and the seconds it asks to wait. The
offset of a stream is the next page of each source, as JSON; pages of one source
are read by several tasks, so a source with very many pages takes no longer.
"""

from __future__ import annotations

import json

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

NAME = "record_pages"
SCHEMA = "source_key string, page long, row long, external_id string, url string, published_s long, text string, failure string, retry_after double"
FIELDS = ("external_id", "url", "published_s", "text", "failure", "retry_after")


def _folder(path: str):
    """(file system, path in it) of a folder given as a URI or a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or not path.startswith("file:") else "file://" + path[len("file:") :]) if ":" in path else (fs.LocalFileSystem(), path)


def _named(system, path: str, name: str) -> list[str]:
    """The values of the folders `name=value` in a folder."""
    from pyarrow import fs
    from urllib.parse import unquote

    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return [unquote(f.base_name[len(name) + 1 :]) for f in found if f.base_name.startswith(f"{name}=")]


class Pages(InputPartition):
    """Some consecutive pages of a source."""

    def __init__(self, source: str, first: int, end: int):
        self.source, self.first, self.end = source, first, end


class PageReader(DataSourceStreamReader):
    """Reads from the page that each source of `begin` is to begin with up to its last; a source that isn't named isn't read."""

    def __init__(self, folder: str, begin: dict[str, int], pages_in_task: int):
        self.folder, self.begin, self.pages_in_task = folder, begin, pages_in_task

    def initialOffset(self) -> dict:
        return dict(self.begin)

    def latestOffset(self) -> dict:
        system, path = _folder(self.folder)
        there = {source: max(map(int, _named(system, f"{path}/source_key={source}", "page")), default=-1) + 1 for source in self.begin}
        return {source: max(at, there[source]) for source, at in self.begin.items()}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        step = self.pages_in_task
        return [Pages(s, first, min(first + step, end[s])) for s in sorted(end) for first in range(start.get(s, end[s]), end[s], step)]

    def read(self, partition: Pages):
        """A row without an id for each page, with the failure if there is one, and the page's items; a failed page ends the task's reading."""
        from pyarrow import fs

        system, path = _folder(self.folder)
        for page in range(partition.first, partition.end):
            files = [f.path for f in system.get_file_info(fs.FileSelector(f"{path}/source_key={partition.source}/page={page}", allow_not_found=True)) if f.base_name.endswith(".json")]
            failure, wait, row = (None if files else "malformed_response"), None, 0
            for file in sorted(files):
                with system.open_input_stream(file) as stream:
                    for line in stream.read().decode().splitlines():
                        item = json.loads(line)
                        if item.get("failure"):
                            failure, wait = item["failure"], item.get("retry_after")
                        else:
                            row += 1
                            yield (partition.source, page, row, *(item.get(f) for f in FIELDS[:-2]), None, None)
            yield (partition.source, page, 0, None, None, None, None, failure, wait)
            if failure:
                return


class PageSource(DataSource):
    """Options: folder; begin (JSON: the next page by source); pages_in_task."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> PageReader:
        return PageReader(self.options["folder"], json.loads(self.options["begin"]), int(self.options.get("pages_in_task", "64")))
