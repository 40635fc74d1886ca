"""Inference services: what fills a column. Only the interface and generic kinds; models are the user's."""

from __future__ import annotations

import asyncio
import copy
import inspect
import json
import threading
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame


class ANY:
    """Stands for every element of a list in a JSON path (at most one in a path)."""


class Service:
    """Gives output rows for input rows.

    ``infer_one`` takes one row and gives a frame of any number of rows; ``infer_batch`` takes a frame and gives a
    list with a frame for each of its rows. Columns are by position: inputs in the order of the binding, outputs in
    the order of its outputs without copied ones. A service is sent to the executors, so it must be picklable.
    """

    def __init__(self, name: str, cost: float | None = None, preferred_batch_size: int = 1000, concurrency: int = 1):
        self.name, self.cost, self.preferred_batch_size, self.concurrency = name, cost, preferred_batch_size, concurrency

    def infer_one(self, row: pd.Series) -> pd.DataFrame:
        """May be a coroutine: up to ``concurrency`` rows are under way at once then. So are rows of a plain function,
        in threads, if ``concurrency`` is above 1."""
        raise NotImplementedError

    def infer_batch(self, rows: pd.DataFrame) -> list[pd.DataFrame]:
        each = [row for _, row in rows.iterrows()]
        if inspect.iscoroutinefunction(self.infer_one):
            return asyncio.run(self._together(each))
        if self.concurrency > 1:
            with ThreadPoolExecutor(self.concurrency) as pool:
                return list(pool.map(self.infer_one, each))
        return [self.infer_one(row) for row in each]

    async def _together(self, rows: list[pd.Series]) -> list[pd.DataFrame]:
        free = asyncio.Semaphore(max(1, self.concurrency))

        async def one(row):
            async with free:
                return await self.infer_one(row)

        return list(await asyncio.gather(*map(one, rows)))

    def calls(self, rows: int) -> int:
        """How many calls of the model so many rows of a batch make."""
        return rows

    def for_tasks(self, tasks: int) -> "Service":
        """The service as each of so many tasks gets it."""
        return self

    def infer_flat(self, rows: pd.DataFrame) -> tuple[pd.DataFrame, list[int]]:
        """All outputs in one frame, and how many each input has."""
        return flat(self.name, self.infer_batch(rows), len(rows))


def flat(name: str, answers: list[pd.DataFrame], n: int) -> tuple[pd.DataFrame, list[int]]:
    if len(answers) != n:
        raise ValueError(f"{name}: {len(answers)} answers to {n} inputs")
    full = [x.set_axis(range(x.shape[1]), axis=1) for x in answers if len(x)]
    return (pd.concat(full, ignore_index=True) if full else pd.DataFrame()), [len(x) for x in answers]


class FunctionService(Service):
    """A function of a whole frame of inputs, also a coroutine. It gives a list with a frame for each row, or one frame with
    as many rows as the inputs."""

    def __init__(self, name: str, function: Callable[[pd.DataFrame], Any], **options):
        super().__init__(name, **options)
        self.function = function

    def _called(self, rows: pd.DataFrame) -> Any:
        out = self.function(rows)
        return asyncio.run(out) if inspect.iscoroutine(out) else out

    def calls(self, rows: int) -> int:
        return 1

    def infer_batch(self, rows: pd.DataFrame) -> list[pd.DataFrame]:
        out = self._called(rows)
        if isinstance(out, pd.DataFrame):
            if len(out) != len(rows):
                raise ValueError(f"{self.name}: {len(out)} rows for {len(rows)} inputs")
            return [out.iloc[k : k + 1] for k in range(len(out))]
        return list(out)

    def infer_flat(self, rows: pd.DataFrame) -> tuple[pd.DataFrame, list[int]]:
        out = self._called(rows)
        if not isinstance(out, pd.DataFrame):
            return flat(self.name, list(out), len(rows))
        if len(out) != len(rows):
            raise ValueError(f"{self.name}: {len(out)} rows for {len(rows)} inputs")
        return out.set_axis(range(out.shape[1]), axis=1).reset_index(drop=True), [1] * len(out)


class FrameService(Service):
    """A service that is a DataFrame already: outputs are found by joining on the inputs, by Spark itself.

    ``on`` are the table's columns for the inputs, ``give`` those for the outputs.
    """

    def __init__(self, name: str, table: DataFrame, on: list[str], give: list[str], **options):
        super().__init__(name, **options)
        self.table, self.on, self.give = table, on, give

    def infer_frame(self, inputs: DataFrame) -> DataFrame:
        """``inputs`` (columns ``i0, i1, ...``) with the outputs as ``o0, o1, ...``."""
        side = self.table.select(
            *[self.table[c].alias(f"i{k}") for k, c in enumerate(self.on)], *[self.table[c].alias(f"o{k}") for k, c in enumerate(self.give)]
        )
        return inputs.join(side, [f"i{k}" for k in range(len(self.on))])


def put_in(body: Any, path: tuple, values: list, at: tuple = ()) -> Any:
    """Writes values into nested JSON along a path of keys and indices; ``ANY`` takes one value for each element."""
    if not path:
        return values[0] if len(values) == 1 and not at else values
    key, rest = path[0], path[1:]
    if key is ANY:
        body = list(body or [])
        while len(body) < len(values):
            body.append(None)
        for k, v in enumerate(values):
            body[k] = put_in(body[k], rest, [v])
        return body
    if isinstance(key, int):
        body = list(body or [])
        while len(body) <= key:
            body.append(None)
        body[key] = put_in(body[key], rest, values)
        return body
    body = dict(body or {})
    body[key] = put_in(body.get(key), rest, values)
    return body


def take_from(data: Any, path: tuple) -> list:
    """All values at a path; nothing where a key or index is missing."""
    if not path:
        return [data]
    key, rest = path[0], path[1:]
    if key is ANY:
        return [v for item in data or [] for v in take_from(item, rest)] if isinstance(data, list) else []
    if isinstance(data, dict) and key in data or isinstance(data, list) and isinstance(key, int) and -len(data) <= key < len(data):
        return take_from(data[key], rest)
    return []


class HTTPService(Service):
    """Posts inputs as JSON and reads outputs from the response.

    ``inputs``: the JSON path of each input column; ``outputs``: that of each output column (a path with ``ANY``
    gives as many rows as the list has). ``transport(url, headers, body)`` gives the response's JSON; by default it
    posts with urllib, waits ``timeout`` seconds at most, and tries up to ``retries`` times again after a refusal for the
    load (429), an error of the server (5xx) or of the network, waiting ``backoff`` seconds, then twice as long each time
    (or as long as the answer asks). ``per_minute`` limits the requests of all tasks together: each gets its share.
    ``wrap``: text put before and after the content of
    chat messages. With ``batch`` one request has columns of values, and the response is a list with an answer for each
    row, or one frame as a dict of columns, as services of pairs give it.
    """

    def __init__(self, name: str, url: str, inputs: list[tuple], outputs: list[tuple], *, headers: dict | None = None, defaults: list[tuple[tuple, Any]] = (), input_types: list[type] | None = None, output_types: list[type] | None = None, per_minute: float | None = None, batch: bool = False, transport: Callable | None = None, wrap: tuple[str, str] | None = None, timeout: float = 60.0, retries: int = 3, backoff: float = 1.0, **options):
        super().__init__(name, **options)
        for path in (*inputs, *outputs):
            if sum(p is ANY for p in path) > 1:
                raise ValueError("a path can have one ANY")
        self.url, self.inputs, self.outputs, self.headers, self.defaults = url, inputs, outputs, headers or {}, list(defaults)
        self.input_types, self.output_types, self.per_minute = input_types, output_types, per_minute
        self.batch, self.transport, self.wrap = batch, transport, wrap
        self.timeout, self.retries, self.backoff = timeout, retries, backoff
        self._next, self._tasks, self._turn = 0.0, 1, threading.Lock()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_turn"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state | {"_turn": threading.Lock()}

    def calls(self, rows: int) -> int:
        return 1 if self.batch else rows

    def for_tasks(self, tasks: int) -> "HTTPService":
        own = copy.copy(self)
        own._tasks = tasks
        return own

    def _wait(self) -> None:
        """Takes the next free moment: requests of a task are so far apart that all tasks together keep the limit."""
        with self._turn:
            at = max(self._next, time.monotonic())
            self._next = at + 60 * self._tasks / self.per_minute
        time.sleep(max(0.0, at - time.monotonic()))

    def _post(self, body: Any) -> Any:
        wait = self.backoff
        for tried in range(self.retries + 1):
            if self.per_minute:
                self._wait()
            try:
                return self.transport(self.url, self.headers, body) if self.transport else self._urllib(body)
            except (urllib.error.URLError, TimeoutError, ConnectionError) as error:
                code, headers = getattr(error, "code", None), getattr(error, "headers", None)
                if tried == self.retries or (code is not None and code != 429 and code < 500):
                    raise
                asked = (headers or {}).get("Retry-After", "")
                time.sleep(float(asked) if asked.isdigit() else wait)
                wait *= 2

    def _urllib(self, body: Any) -> Any:
        request = urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json", **self.headers})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            return json.loads(answer.read())

    def request(self, row: pd.Series) -> Any:
        body: Any = None
        for path, value in self.defaults:
            body = put_in(body, path, [value])
        for k, path in enumerate(self.inputs):
            value = row.iloc[k]
            value = value.item() if hasattr(value, "item") else value
            if self.input_types and not isinstance(value, self.input_types[k]):
                raise TypeError(f"{self.name}: input {k} is {type(value).__name__}")
            body = put_in(body, path, list(value) if any(p is ANY for p in path) and isinstance(value, (list, tuple)) else [value])
        if self.wrap and isinstance(body, dict):
            for message in body.get("messages", []):
                message["content"] = f"{self.wrap[0]}{message['content']}{self.wrap[1]}"
        return body

    def answer(self, data: Any) -> pd.DataFrame:
        columns = [take_from(data, path) for path in self.outputs]
        rows = max(map(len, columns), default=0)
        if any(not c for c in columns):
            return pd.DataFrame({k: [] for k in range(len(columns))})
        out = pd.DataFrame({k: c * rows if len(c) == 1 else c for k, c in enumerate(columns)})
        if self.output_types:
            for k, kind in enumerate(self.output_types):
                if not all(isinstance(v, kind) for v in out[k]):
                    raise TypeError(f"{self.name}: output {k} isn't {kind.__name__}")
        return out

    def infer_one(self, row: pd.Series) -> pd.DataFrame:
        return self.answer(self._post(self.request(row)))

    def infer_batch(self, rows: pd.DataFrame) -> list[pd.DataFrame]:
        if not self.batch:
            return super().infer_batch(rows)
        body = None
        for k, path in enumerate(self.inputs):
            body = put_in(body, tuple(p for p in path if p is not ANY), [rows.iloc[:, k].tolist()])
        data = self._post(body)
        if isinstance(data, dict):  # one frame, as columns: an answer for each pair
            data = [dict(zip(data, row)) for row in zip(*data.values())]
        if len(data) != len(rows):
            raise ValueError(f"{self.name}: {len(data)} answers to {len(rows)} inputs")
        return [self.answer(d) for d in data]
