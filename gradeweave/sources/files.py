"""A source of whole small files below run folders, whatever their names.

Spark's file sources pass over names that begin with `_` or `.`. This one is listed in two
steps: the folders `step_S/repeat_R` at planning, and what is below them in the tasks.
"""

import fnmatch
import re
import sys
from dataclasses import dataclass

from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Send this module's classes with the job: workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STEP, REPEAT = re.compile(r"step[_=](\d+)"), re.compile(r"repeat[_=](\d+)")
SCHEMA = "step int, repeat_idx int, path string, value string"


def opened(root: str):
    """(file system, path in it) of an address or a local path."""
    return fs.FileSystem.from_uri(root) if re.match(r"[a-z][a-z0-9+.-]*:", root) else (fs.LocalFileSystem(), root)


def folders(store, path, pattern):
    """(number, path) of the folders directly below the path whose names match."""
    for info in store.get_file_info(fs.FileSelector(path, allow_not_found=True)):
        match = pattern.fullmatch(info.base_name)
        if match and info.type == fs.FileType.Directory:
            yield int(match[1]), info.path


@dataclass
class Runs(InputPartition):
    """Run folders that one task reads: (step, repeat, path)."""

    runs: list


class RunFiles(DataSource):
    """Rows (step, repeat_idx, path, value), one per file.

    Options: path, the folder above the steps; names, a pattern that file names match; dotted,
    'true' to read files and folders whose names begin with a dot as well, which shell
    patterns pass over; tasks, how many tasks share the run folders.
    """

    @classmethod
    def name(cls):
        return "run_files"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return RunFilesReader(self.options)


class RunFilesReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"].rstrip("/")
        self.names = options.get("names", "*.json")
        self.dotted = options.get("dotted", "false").lower() == "true"
        self.tasks = int(options.get("tasks", "8"))

    def partitions(self):
        store, root = opened(self.root)
        runs = [
            (step, repeat, path)
            for step, above in folders(store, root, STEP)
            for repeat, path in folders(store, above, REPEAT)
        ]
        runs.sort()
        return [Runs(runs[i :: self.tasks]) for i in range(min(self.tasks, len(runs)))] or [Runs([])]

    def wanted(self, below: str) -> bool:
        parts = below.strip("/").split("/")
        seen = self.dotted or not any(part.startswith(".") for part in parts)
        return seen and fnmatch.fnmatchcase(parts[-1], self.names)

    def read(self, partition):
        store, _ = opened(self.root)
        for step, repeat, folder in partition.runs:
            for info in store.get_file_info(fs.FileSelector(folder, recursive=True)):
                if info.type != fs.FileType.File or not self.wanted(info.path[len(folder) :]):
                    continue
                with store.open_input_stream(info.path) as file:
                    data = file.read()
                try:
                    value = data.decode()
                except UnicodeDecodeError:
                    value = None  # no text, so no metrics
                yield step, repeat, info.path, value
