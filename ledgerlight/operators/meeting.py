"""Sums and small tables shared by the tasks of one barrier stage.

Work that needs many short rounds over rows that stay where they are is written as generators: a generator yields what it
wants to know of all shards (``Total`` or ``Each``) and goes on with the answer.  ``Meeting.run`` drives the generators of a
task in step, so that one meeting of the tasks answers all of them.  What is small goes through the barrier's own messages;
the parts of a ``Total`` go through the shared folder, where every task reads only the share that it adds up.
"""

from __future__ import annotations

import pickle
import posixpath
import time
import uuid
from collections.abc import Generator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyarrow import fs
from pyspark import BarrierTaskContext, SparkContext


@dataclass
class Total:
    """One array per shard, of the same shapes in every task; the answer is the sum of all that were meant for this shard."""

    parts: Sequence[np.ndarray]


@dataclass
class Each:
    """The answer holds this array of every shard, stacked in the order of the shards."""

    values: np.ndarray


def shard_count(context: SparkContext, wanted: int) -> int:
    """``wanted`` shards, but no more than tasks that run at once: a barrier stage needs all of its tasks together.

    Executors that come and go allow no barrier; all rows are one shard then.
    """
    if context.getConf().get("spark.dynamicAllocation.enabled", "false").lower() == "true":
        return 1
    inner = context._jsc.sc()
    return max(1, min(wanted, inner.maxNumConcurrentTasks(inner.resourceProfileManager().defaultResourceProfile())))


class Meeting:
    """The meeting point of ``shards`` tasks, made inside each of them; one shard alone meets nobody.

    Every task writes one file a step to ``folder`` and reads those of the others.  (``BarrierTaskContext.allGather``
    looks for an answer once a second only, so it is asked just once.)  A file goes when its task has heard all others in the
    next step: they have read it by then.  The folder is the caller's to remove.
    """

    def __init__(self, shards: int, folder: str) -> None:
        self.shards, self.index, self._step = shards, 0, 0
        if shards > 1:
            task = BarrierTaskContext.get()
            self.index = task.partitionId()
            self._store, root = fs.FileSystem.from_uri(folder)
            self._root = posixpath.join(root, task.allGather(uuid.uuid4().hex)[0])  # a stage run again must not read old files
            self._store.create_dir(self._root, recursive=True)

    def answer(self, asked: dict[int, Total | Each]) -> dict[int, np.ndarray]:
        """Answers to the questions of one step; all tasks ask the same ones, about arrays of the same shapes."""
        totals = {n: q.parts for n, q in asked.items() if isinstance(q, Total)}
        mine = {n: q.values for n, q in asked.items() if isinstance(q, Each)}
        if self.shards == 1:
            return {n: parts[0] for n, parts in totals.items()} | {n: values[None] for n, values in mine.items()}
        self._step += 1
        words = pickle.dumps(mine)
        with self._store.open_output_stream(f"{self._file(self.index)}.part") as out:
            out.write(len(words).to_bytes(8, "little") + words)
            for owner in range(self.shards):
                for parts in totals.values():
                    out.write(np.ascontiguousarray(parts[owner]).data)
        self._store.move(f"{self._file(self.index)}.part", self._file(self.index))
        start = sum(parts[owner].nbytes for owner in range(self.index) for parts in totals.values())
        sums = np.concatenate([parts[self.index].ravel() for parts in totals.values()]) if totals else np.zeros(0)
        heard = {self.index: mine}
        for shard in range(self.shards):
            if shard != self.index:
                with self._opened(shard) as file:
                    size = int.from_bytes(file.read_at(8, 0), "little")
                    heard[shard] = pickle.loads(file.read_at(size, 8))
                    if sums.size:
                        sums += np.frombuffer(file.read_at(sums.nbytes, 8 + size + start), dtype=sums.dtype)
        if self._step > 1:
            self._store.delete_file(self._file(self.index, self._step - 1))
        answers, at = {n: np.stack([heard[shard][n] for shard in range(self.shards)]) for n in mine}, 0
        for n, parts in totals.items():
            part = parts[self.index]
            answers[n] = sums[at: at + part.size].reshape(part.shape)
            at += part.size
        return answers

    def run(self, generators: Sequence[Generator[Total | Each, np.ndarray, Any]]) -> list[Any]:
        """What every generator returns."""
        answers: dict[int, np.ndarray | None] = dict.fromkeys(range(len(generators)))
        found: dict[int, Any] = {}
        while len(found) < len(generators):
            asked = {}
            for n, one in enumerate(generators):
                if n in found:
                    continue
                try:
                    asked[n] = one.send(answers[n])
                except StopIteration as end:
                    found[n] = end.value
            if asked:
                answers |= self.answer(asked)
        return [found[n] for n in range(len(generators))]

    def _file(self, shard: int, step: int | None = None) -> str:
        return posixpath.join(self._root, f"{step or self._step}-{shard}.bin")

    def _opened(self, shard: int):
        """The file of another task, once it is there; Spark ends this task when another one of the stage fails."""
        wait = 0.0005
        while True:
            try:
                return self._store.open_input_file(self._file(shard))
            except FileNotFoundError:
                time.sleep(wait)
                wait = min(0.02, wait * 1.2)
