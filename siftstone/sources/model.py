"""The model stage: answers for chunks of text, from any client or from a table of recorded answers."""

from __future__ import annotations

import queue
import random
import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ModelClient(Protocol):
    def chat(self, prompt: str) -> str: ...

    def describe(self, prompt: str, image: bytes) -> str:
        """Needed for images only."""
        ...


@dataclass(frozen=True)
class Limits:
    """at_once: calls of a task that may wait for answers side by side. seconds: time limit of a call, without the waits between
    tries. per_second: calls that may begin in a second over all tasks, tries included (None: any number); it is dealt evenly to
    `tasks` tasks (0: one a core), so the rate is kept without talk between executors. tries: of a refused call."""

    at_once: int = 8
    seconds: float = 600.0
    per_second: float | None = None
    tasks: int = 0
    tries: int = 8


class Refused(Exception):
    """A client's refusal: status 429 or 5xx, and the seconds it asks to wait, if any."""

    def __init__(self, status: int, wait: float | None = None):
        super().__init__(f"status {status}")
        self.status, self.wait = status, wait


def with_retries(call: Callable[[], str], tries: int = 8, sleep: Callable[[float], None] = time.sleep) -> str:
    """The call's answer; refusals are tried again after a growing wait (429: as asked, else 10, 20, ... up to 120 s; 5xx: 2, 4, ...)."""
    for k in range(tries):
        try:
            return call()
        except Refused as e:
            if k == tries - 1 or not (e.status == 429 or e.status >= 500):
                raise
            sleep(e.wait if e.wait is not None else min(10 * 2**k, 120) if e.status == 429 else 2 * 2**k + random.random())
    raise AssertionError


class Asking:
    """Questions of one task, `at_once` at a time, each by a client that no other call uses meanwhile.

    A call over the time limit is given up: its answer is an error, and a thread and client of its own take the place. The old
    thread can't be stopped; it lives until its call returns, so clients should end hung calls themselves in the end.
    """

    def __init__(self, make: Callable[[], ModelClient], limits: Limits, share: float | None):
        self.make, self.limits, self.share = make, limits, share
        self.idle: list[ModelClient] = []
        self.lock, self.next_start = threading.Lock(), 0.0

    def pace(self) -> None:
        """Wait for this task's next turn under the rate."""
        if self.share is None:
            return
        with self.lock:
            start = max(self.next_start, time.monotonic())
            self.next_start = start + 1 / self.share
        time.sleep(max(0.0, start - time.monotonic()))

    def answers(self, questions: list[Callable[[ModelClient], str]]) -> list[tuple[str | None, str | None]]:
        """(answer, error) of each question, in their order; one of the two is null."""
        out: list[tuple[str | None, str | None]] = [(None, None)] * len(questions)
        ended: queue.SimpleQueue[tuple[int, tuple[str | None, str | None]]] = queue.SimpleQueue()
        ends: dict[int, float] = {}  # when the current call of each running question is overdue; infinite between calls

        def due(i: int, seconds: float) -> None:
            with self.lock:
                if i not in ends:
                    raise TimeoutError  # given up meanwhile: no further tries
                ends[i] = time.monotonic() + seconds

        def call(i: int, client: ModelClient) -> str:
            self.pace()
            due(i, self.limits.seconds)
            try:
                return questions[i](client)
            finally:
                due(i, float("inf"))

        def one(i: int) -> None:
            client = None
            try:
                with self.lock:
                    client = self.idle.pop() if self.idle else None
                client = client or self.make()
                ended.put((i, (with_retries(lambda: call(i, client), self.limits.tries), None)))
            except Exception as e:
                ended.put((i, (None, str(e) or type(e).__name__)))
            if client is not None:
                with self.lock:
                    self.idle.append(client)

        begun = 0
        while ends or begun < len(questions):
            while begun < len(questions) and len(ends) < self.limits.at_once:
                with self.lock:
                    ends[begun] = float("inf")
                threading.Thread(target=one, args=(begun,), daemon=True).start()
                begun += 1
            with self.lock:
                nearest = min(ends.values()) - time.monotonic()
            try:
                i, got = ended.get(timeout=min(max(nearest, 0.0), 0.1))
                with self.lock:
                    if ends.pop(i, None) is not None:
                        out[i] = got
            except queue.Empty:
                with self.lock:
                    late = [i for i, end in ends.items() if end <= time.monotonic()]
                    for i in late:
                        del ends[i]
                for i in late:
                    out[i] = (None, f"no answer within {self.limits.seconds:g} seconds")
        return out


def _asked(rows: DataFrame, client: Callable[[], ModelClient], limits: Limits, kept: list[str], question: Callable[[pd.DataFrame], list[Callable[[ModelClient], str]]]) -> DataFrame:
    """The kept columns with response and error of each row's question."""
    tasks = limits.tasks or rows.sparkSession.sparkContext.defaultParallelism
    share = None if limits.per_second is None else limits.per_second / tasks

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asking = Asking(client, limits, share)
        for batch in batches:
            got = asking.answers(question(batch))
            yield batch[kept].assign(response=[a for a, _ in got], error=[e for _, e in got])

    if share is not None or limits.tasks:
        rows = rows.repartition(tasks)
    types = dict(rows.dtypes)
    return rows.mapInPandas(work, ", ".join(f"`{c}` {types[c]}" for c in kept) + ", response string, error string")


def ask(chunks: DataFrame, client: Callable[[], ModelClient], instruction: str, limits: Limits = Limits()) -> DataFrame:
    """(doc_id, chunk_no, response, error) for rows (doc_id, chunk_no, chunk).

    Each task asks `limits.at_once` questions side by side, with clients of its own, and keeps the rows' order. A failure, or a call
    over the time limit, is kept as an error; a null chunk is asked as an empty one. A task that is lost asks again: to pay for each
    answer once, go by `operators.resumable`.
    """

    def question(batch: pd.DataFrame) -> list[Callable[[ModelClient], str]]:
        return [lambda c, t=t: c.chat(f"{instruction}\n\n{t}") for t in batch["chunk"].fillna("")]

    return _asked(chunks.select("doc_id", "chunk_no", "chunk"), client, limits, ["doc_id", "chunk_no"], question)


def describe(images: DataFrame, client: Callable[[], ModelClient], instruction: str, limits: Limits = Limits()) -> DataFrame:
    """(path, ocr_text, response, error) for images (path, content, ocr_text), as `plans.scan.image_findings` reads them.

    The client's `describe` gets the instruction, the text read from the image if there is any, and the image's bytes. An image
    without content isn't asked about: its answer and error are null.
    """

    def question(batch: pd.DataFrame) -> list[Callable[[ModelClient], str]]:
        texts = (f"{instruction}\n\n{t}" if t.strip() else instruction for t in batch["ocr_text"].fillna(""))
        return [(lambda c, t=t, x=x: c.describe(t, bytes(x))) for t, x in zip(texts, batch["content"])]

    rows = images.select("path", "ocr_text", "content")
    has = F.octet_length("content") > 0
    without = rows.where(~F.coalesce(has, F.lit(False))).select("path", "ocr_text", F.lit(None).cast("string").alias("response"), F.lit(None).cast("string").alias("error"))
    return _asked(rows.where(has), client, limits, ["path", "ocr_text"], question).unionByName(without)


def replay(chunks: DataFrame, recorded: DataFrame) -> DataFrame:
    """The same rows from recorded answers (doc_id, chunk_no, response)."""
    return chunks.select("doc_id", "chunk_no").join(recorded.select("doc_id", "chunk_no", "response"), ["doc_id", "chunk_no"], "left").withColumn("error", F.lit(None).cast("string"))
