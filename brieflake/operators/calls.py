"""Calls to slow outside services from within partitions: bounded concurrency, time limits, retries, fallbacks, order kept."""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import Future
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship

#: A caller: one text in, one text out, or an exception.
Caller = Callable[[str], str | None]

# What a message of a passing fault says.
PASSING = ("429", "500", "502", "503", "504", "rate limit", "timeout", "timed out", "overloaded", "temporarily", "connection")


@dataclass(frozen=True)
class CallPolicy:
    """How rows of a partition are called for: so many at a time, each call so long at most, each row so often, with pauses that double from ``pause`` to ``longest_pause`` seconds."""

    concurrency: int = 4
    timeout: float = 60.0
    attempts: int = 3
    pause: float = 0.5
    longest_pause: float = 30.0

    def __post_init__(self) -> None:
        if self.concurrency < 1 or self.attempts < 1 or self.timeout <= 0 or self.pause < 0:
            raise ValueError("concurrency and attempts must be 1 or more, the time limit positive, the pause not negative")

    def wait(self, attempt: int) -> float:
        return min(self.longest_pause, self.pause * 2 ** (attempt - 1))


def passing(error: BaseException | None) -> bool:
    """Whether another service, or another attempt, may do better: an empty answer, a time limit, or a message that says so."""
    return error is None or isinstance(error, (TimeoutError, ConnectionError)) or any(w in str(error).lower() for w in PASSING)


def _within(call: Caller, text: str, limit: float) -> str | None:
    """call(text), or TimeoutError after ``limit`` seconds; the thread that still runs then is left behind and its answer dropped."""
    out: Future = Future()

    def go() -> None:
        try:
            out.set_result(call(text))
        except BaseException as e:  # carried over to the caller
            out.set_exception(e)

    threading.Thread(target=go, daemon=True).start()
    try:
        return out.result(limit)
    except TimeoutError:
        if out.done():
            raise
        raise TimeoutError(f"no answer within {limit:g} s") from None


def answered(callers: list[Caller], text: str, policy: CallPolicy, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, str | None, int, int | None]:
    """Answer, error, attempts and the caller's place for one text.  An attempt asks the callers in turn, going on to the next after a passing fault; a lasting fault ends the attempt.  Attempts follow until one gives something."""
    error = "no caller"
    for attempt in range(1, policy.attempts + 1):
        for k, call in enumerate(callers):
            fault: BaseException | None = None
            try:
                answer = _within(call, text, policy.timeout)
                if answer:
                    return answer, None, attempt, k
                error = "empty answer"
            except Exception as e:  # of any kind: a row fails alone
                fault, error = e, f"{type(e).__name__}: {e}"[:300]
            if not passing(fault):
                break
        if callers and attempt < policy.attempts:
            sleep(policy.wait(attempt))
    return None, error, policy.attempts if callers else 0, None


def in_order(texts: Iterator[str], work: Callable[[str], tuple], concurrency: int) -> Iterator[tuple]:
    """work(text) of each text, so many at a time, in the texts' order; no more than these are ahead of what is taken."""
    ahead: deque[Future] = deque()

    def start(text: str) -> Future:
        f: Future = Future()

        def go() -> None:
            try:
                f.set_result(work(text))
            except BaseException as e:
                f.set_exception(e)

        threading.Thread(target=go, daemon=True).start()
        return f

    for t in texts:
        ahead.append(start(t))
        if len(ahead) >= concurrency:
            yield ahead.popleft().result()
    while ahead:
        yield ahead.popleft().result()


def called(df: DataFrame, callers: list[Caller], key: str = "id", prompt: str = "prompt", policy: CallPolicy = CallPolicy()) -> DataFrame:  # noqa: B008
    """(key, answer, error, attempts, caller) of each row: a row that no caller answers has an error and stops nothing.

    Rows keep their order within a partition.  A null prompt isn't asked for and has the error "no prompt".  Tasks that run again ask again.
    """
    ship(df.sparkSession)

    def one(text: str | None) -> tuple:
        return answered(callers, text, policy) if text is not None else (None, "no prompt", 0, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = list(in_order(iter(b.column(1).to_pylist()), one, policy.concurrency))
            cols = [pa.array([g[i] for g in got], t) for i, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), *cols], names=[key, "answer", "error", "attempts", "caller"])

    return df.select(F.col(key).cast("string"), prompt).mapInArrow(run, f"{key} string, answer string, error string, attempts int, caller int")
