"""Answers that a transformer has given, each under an address made from what it was asked.

The Python worker keeps an answer as soon as it has it, before the rest of its task runs. So a task that runs again,
a speculative copy, a second action on the same result or a whole new run asks only what was never answered. An
answer is a file of its own, written beside its place and moved there, so it is whole or absent; nothing is listed
and no index has to be kept.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256
from uuid import uuid4

from pyarrow import fs
from pyspark.sql import SparkSession

_SCHEMES = {"s3a": "s3", "s3n": "s3"}  # names of the same store


@lru_cache(maxsize=8)
def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


@dataclass(frozen=True)
class AnswerLog:
    """The answers in a folder that every executor reaches; see :func:`answer_log`."""

    folder: str

    def _place(self, payload: str, instruction: str, attempt: int) -> tuple[fs.FileSystem, str, str]:
        files, root = _opened(self.folder)
        name = sha256(json.dumps([attempt, instruction, payload]).encode()).hexdigest()
        return files, f"{root}/{name[:3]}", name

    def find(self, payload: str, instruction: str, attempt: int) -> str | None:
        files, folder, name = self._place(payload, instruction, attempt)
        try:
            with files.open_input_stream(f"{folder}/{name}", compression=None) as kept:
                return kept.read().decode()
        except FileNotFoundError:
            return None

    def keep(self, payload: str, instruction: str, attempt: int, answer: str) -> None:
        files, folder, name = self._place(payload, instruction, attempt)
        files.create_dir(folder, recursive=True)
        draft = f"{folder}/{name}-{uuid4().hex}"
        with files.open_output_stream(draft, compression=None) as out:
            out.write(answer.encode())
        files.move(draft, f"{folder}/{name}")


def answer_log(spark: SparkSession, folder: str) -> AnswerLog:
    """The log in ``folder``, a path or URI as Spark takes it, in a store that pyarrow opens from the workers."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    scheme, _, rest = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().partition(":")
    log = AnswerLog(rest if scheme == "file" else f"{_SCHEMES.get(scheme, scheme)}:{rest}")
    _opened(log.folder)
    return log
