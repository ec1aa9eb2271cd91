"""Progress of refresh streams and of reading files, as calls of a function."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQueryListener


class FileProgress:
    """Calls on_file(done, total) while the rows of counted tables, a row for each file, are gone through: first with 0,
    then as tasks end, each number once and never a smaller one, and with the total when all is over without an error.

        with FileProgress(spark, total, on_file) as progress:
            ... progress.counted(files) ...

    Tasks that run again may count a file twice; more than the total is never told. The function is called from a thread
    of its own, and once more at the end.
    """

    def __init__(self, spark, total: int, on_file: Callable[[int, int], None], every: float = 0.2):
        self.total, self._tell, self._every = total, on_file, every
        self._done, self._told, self._over = spark.sparkContext.accumulator(0), -1, threading.Event()
        self._poll = threading.Thread(target=self._watch, daemon=True)

    def counted(self, rows: DataFrame) -> DataFrame:
        done = self._done

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch
                done.add(batch.num_rows)

        return rows.mapInArrow(run, rows.schema)

    def _say(self, done: int) -> None:
        if done > self._told:
            self._told = done
            self._tell(done, self.total)

    def _watch(self) -> None:
        while not self._over.wait(self._every):
            self._say(min(self._done.value, self.total))

    def __enter__(self) -> FileProgress:
        self._say(0)
        self._poll.start()
        return self

    def __exit__(self, kind, *_) -> None:
        self._over.set()
        self._poll.join()
        if kind is None:
            self._say(self.total)


class ProgressListener(StreamingQueryListener):
    """Calls on_progress(batch, rows) after each micro-batch of any query of the session, and on_end(error) at the end
    of one. Register with `spark.streams.addListener`."""

    def __init__(self, on_progress: Callable[[int, int], None], on_end: Callable[[str | None], None] | None = None):
        self._progress, self._end = on_progress, on_end

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self._progress(event.progress.batchId, event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if self._end:
            self._end(event.exception)
