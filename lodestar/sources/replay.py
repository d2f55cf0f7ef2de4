"""A Python data source of captured API replies: ``spark.read.format("papers")``.

Options: ``folder`` (one file of JSON lines per query and page), ``source``.
Every file is a partition, so a lost task reads one file again.  A live client
would subclass the reader and fetch in place of reading a file.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Page(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class Replies(DataSourceReader):
    def __init__(self, folder: str, source: str) -> None:
        self.folder, self.source = folder, source

    def partitions(self) -> list[Page]:
        names = sorted(n for n in os.listdir(self.folder) if n.startswith(self.source) and n.endswith(".jsonl"))
        return [Page(os.path.join(self.folder, n)) for n in names]

    def fetch(self, page: Page) -> Iterator[str]:
        with open(page.path, encoding="utf-8") as file:
            yield from file

    def read(self, page: Page) -> Iterator[tuple]:
        for place, line in enumerate(self.fetch(page)):
            try:
                json.loads(line)
            except ValueError:
                continue  # a reply that is no JSON is passed over, as by the file sources
            yield self.source, os.path.basename(page.path), place, line.strip()


class PaperReplies(DataSource):
    @classmethod
    def name(cls) -> str:
        return "papers"

    def schema(self) -> str:
        return "source string, page string, place int, raw string"

    def reader(self, schema) -> Replies:
        return Replies(self.options["folder"], self.options["source"])
