"""Cycling: a function of each micro-batch of observations and the state carried between cycles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from isohyet.functions import codes
from isohyet.operators.observations import position_code
from isohyet.sources.versions import StateTable


def run_cycles(stream: DataFrame, checkpoint: str, assimilate: Callable[[DataFrame, int], None], late: Callable[[DataFrame, int], None], nx: int, ny: int, first: int, last: int) -> StreamingQuery:
    """Each micro-batch is one cycle. Rows outside the time window are not dropped but handed to ``late``."""

    def batch(df: DataFrame, cycle: int) -> None:
        coded = position_code(df, nx, ny, first, last)
        assimilate(coded.filter(F.col("qc") != codes.OUT_OF_TIME), cycle)
        late(coded.filter(F.col("qc") == codes.OUT_OF_TIME), cycle)

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(availableNow=True).start()


Step = Callable[[DataFrame, DataFrame, DataFrame, int], DataFrame]


def carry_on(table: StateTable, obs: DataFrame, cycle: int, step: Step, lag: int = 1) -> None:
    """Commit the state of a cycle: ``step`` of its observations, the state of the cycle before, that of ``lag`` cycles before (from which inflation is taken), and its number.

    A cycle that is committed is left as it is, so that a replay does nothing.
    """
    if not table.committed(cycle):
        table.write(step(obs, table.before(cycle), table.before(cycle, lag), cycle), cycle)


def run_state_cycles(stream: DataFrame, checkpoint: str, table: StateTable, step: Step, lag: int = 1) -> StreamingQuery:
    """Each micro-batch is one cycle, numbered from 1, that reads what the one before committed to ``table``, which holds cycle 0 at the start.

    Started again on the same ``checkpoint`` after a failure anywhere, the run goes on with the first cycle that is not committed: the stream gives a
    micro-batch that was not finished the same rows again, and one that had been committed before its end is not repeated.
    """
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, epoch: carry_on(table, df, epoch + 1, step, lag)).trigger(availableNow=True).start()
