"""A state table by cycle: written under a name of its own, then committed by one marker, so that a cycle is there as a whole or not at all."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class StateTable:
    """Tables by cycle number below one folder that all executors share.

    A write goes to a fresh folder; then a marker that names it is put in place by a rename, which shared file systems
    refuse if there is one, so of two writers of a cycle one wins and both read the same. A replayed cycle finds its marker and is not written again.
    What a killed writer left has no marker and is never read; ``sweep`` removes it (while no writer is at work).
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._paths = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._paths(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _marker(self, cycle: int):
        return self._paths(f"{self.path}/_committed/{cycle:09d}")

    def cycles(self) -> list[int]:
        """Committed cycles, in order."""
        folder = self._paths(f"{self.path}/_committed")
        if not self._files.exists(folder):
            return []
        return sorted(int(f.getPath().getName()) for f in self._files.listStatus(folder) if f.getPath().getName().isdigit())

    def committed(self, cycle: int) -> bool:
        return bool(self._files.exists(self._marker(cycle)))

    def write(self, state: DataFrame, cycle: int) -> DataFrame:
        """The committed state of the cycle: ``state``, or what was committed before."""
        if not self.committed(cycle):
            name = f"cycle-{cycle:09d}-{uuid.uuid4().hex}"
            state.write.parquet(f"{self.path}/{name}")
            self.commit(cycle, name)
        return self.read(cycle)

    def commit(self, cycle: int, name: str) -> bool:
        """Make ``name`` the state of the cycle, unless it has one. The marker gets its name and content in one step, by a rename that doesn't replace."""
        ready = self._paths(f"{self.path}/_ready/{name}")
        out = self._files.create(ready, True)
        out.write(bytearray(name.encode()))
        out.close()
        self._files.mkdirs(self._marker(cycle).getParent())
        done = not self.committed(cycle) and self._files.rename(ready, self._marker(cycle))
        if not done:
            self._files.delete(ready, False)
        return bool(done)

    def _name(self, cycle: int) -> str:
        stream = self._files.open(self._marker(cycle))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def read(self, cycle: int) -> DataFrame:
        if not self.committed(cycle):
            raise ValueError(f"cycle {cycle} has not been committed to {self.path}")
        return self.spark.read.parquet(f"{self.path}/{self._name(cycle)}")

    def before(self, cycle: int, lag: int = 1) -> DataFrame:
        """The state ``lag`` committed cycles before ``cycle``; the first one if there are fewer, as at the start of a run."""
        earlier = [c for c in self.cycles() if c < cycle]
        if not earlier:
            raise ValueError(f"no cycle before {cycle} has been committed to {self.path}")
        return self.read(earlier[max(0, len(earlier) - lag)])

    def sweep(self, keep: int | None = None) -> int:
        """Remove folders without a marker and, with ``keep``, all but the last so many cycles; how many folders went."""
        cycles = self.cycles()
        old = cycles[: max(0, len(cycles) - keep)] if keep is not None else []
        named = {self._name(c) for c in cycles if c not in old}
        for c in old:
            self._files.delete(self._marker(c), False)
        gone = 0
        for f in self._files.listStatus(self._paths(self.path)):
            name = f.getPath().getName()
            if name.startswith("cycle-") and name not in named:
                gone += bool(self._files.delete(f.getPath(), True))
        return gone
