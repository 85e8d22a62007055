"""Publishing documents as files in two phases: tasks write under temporary names, and only when all
of them succeeded does the driver rename the files. A lost executor, a retried or a doubled task
leaves no published file; temporary files of a failed run are removed.

Register with ``spark.dataSource.register(PublishSource)``; write rows of doc_name and content with
``df.write.format("publish").mode("append").option("path", folder).save()``. The folder must be seen
by all executors.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

PROBES = 10


class PublishError(RuntimeError):
    pass


def staging_file(final: str) -> str:
    """Creates and names a temporary file: final.tmp, final.tmp1, ... final.tmp9."""
    for k in range(PROBES):
        at = f"{final}.tmp{k or ''}"
        try:
            os.close(os.open(at, os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o644))
            return at
        except FileExistsError:
            continue
        except OSError as e:
            raise PublishError(f"[file_open_failed] {at}: {e.strerror}") from e
    raise PublishError(f"[file_rename_collision] {final}: {PROBES} temporary names are taken")


@dataclass
class Staged(WriterCommitMessage):
    files: list[tuple[str, str]]


class PublishWriter(DataSourceWriter):
    def __init__(self, folder: str, names: list[str]):
        self.folder, self.name, self.content = folder, names.index("doc_name"), names.index("content")

    def write(self, rows) -> Staged:
        staged = Staged([])
        try:
            for row in rows:
                name = row[self.name]
                if not name or os.path.basename(name) != name:
                    raise PublishError(f"[fetch_doc_name_failed] {name!r} is no file name")
                final = os.path.join(self.folder, name)
                staged.files.append((at := staging_file(final), final))
                with open(at, "w", encoding="utf-8", newline="") as f:
                    f.write(row[self.content] or "")
        except BaseException:
            remove(staged)
            raise
        return staged

    def commit(self, messages) -> None:
        finals = [final for m in messages if m for _, final in m.files]
        if len(set(finals)) < len(finals):
            self.abort(messages)
            raise PublishError("[file_rename_collision] two documents have the same name")
        for m in messages:
            for at, final in m.files if m else []:
                os.replace(at, final)

    def abort(self, messages) -> None:
        for m in messages:
            if m:
                remove(m)


def remove(staged: Staged) -> None:
    for at, _ in staged.files:
        if os.path.exists(at):
            os.remove(at)


class PublishSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "publish"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return PublishWriter(self.options["path"].removeprefix("file://"), schema.names)
