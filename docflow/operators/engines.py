"""Page readers around injected models: deadlines, errors as rows, adapters, and which engine is used.

A model is any callable; nothing here loads one. ``reader`` makes an Arrow function of it for
``cascade.Engine``: a page that fails or hangs is that page's error, never the job's.
"""

from __future__ import annotations

import queue
import threading
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

from ..functions.batches import small_batches
from .cascade import NONE, Engine

RESULT = "struct<text string, error string, confidence double>"
PAGE_MS = 30_000
#: Late pages that are waited for beside the next ones; batches whose rows are held for them.
WAITING, HELD = 24, 8
#: A page is late after this share of its deadline, and after so many times what a page usually takes.
PATIENCE, TIMES = 0.01, 8
#: Fixed: white space that is cut off, as in functions.text.JSWS.
SPACES = "\t\n\x0b\x0c\r                  　﻿"
#: Fixed: (leading bytes, bytes that are looked at, MIME type).
IMAGE_TYPES = ((b"\xff\xd8\xff", 3, "image/jpeg"), (b"\x89PNG", 8, "image/png"))

#: Image bytes to (text, confidence or None).
Recognize = Callable[[bytes], tuple[str | None, float | None]]


class TimedOut(Exception):
    """A step that took longer than it may."""


def within(ms: int | None, label: str, call: Callable, *arguments):
    """``call(*arguments)``, or TimedOut after ``ms`` (never if 0 or less). What hangs is left to a daemon thread whose result nobody reads."""
    if not ms or ms <= 0:
        return call(*arguments)
    done: queue.SimpleQueue = queue.SimpleQueue()

    def run() -> None:
        try:
            done.put((call(*arguments), None))
        except Exception as e:
            done.put((None, e))

    threading.Thread(target=run, daemon=True).start()
    try:
        value, error = done.get(timeout=ms / 1000)
    except queue.Empty:
        raise TimedOut(f"{label} timed out after {ms}ms") from None
    if error is not None:
        raise error
    return value


class _Line:
    """A thread that makes one call after the other."""

    def __init__(self, call: Callable):
        self.asked, self.done = queue.SimpleQueue(), queue.SimpleQueue()
        threading.Thread(target=self._run, args=(call,), daemon=True).start()

    def _run(self, call: Callable) -> None:
        for arguments in iter(self.asked.get, None):
            began, value, error = time.monotonic(), None, None
            try:
                value = call(*arguments)
            except Exception as e:
                error = e
            self.took = time.monotonic() - began
            self.done.put((value, error))

    def answer(self, seconds: float):
        """(value, error), or None after ``seconds``."""
        try:
            return self.done.get(timeout=max(seconds, 0))
        except queue.Empty:
            return None


def each_within(ms: int | None, label: str, call: Callable, batches: Iterable[Iterable]) -> Iterator[list[tuple]]:
    """For each batch a list of (value, error) of ``call`` on its members, each within ``ms`` of its own start.

    One call runs at a time, but after a first has ended one that is late is waited for beside the next ones, so pages that hang cost no
    deadline each. A model must bear calls beside a late one, as beside one that timed out. What hangs is left to
    its daemon thread. At most WAITING calls are late and HELD batches held at once.
    """
    if not ms or ms <= 0:
        for batch in batches:
            answers = []
            for member in batch:
                try:
                    answers.append((call(member), None))
                except Exception as e:
                    answers.append((None, e))
            yield answers
        return
    limit, usual, line = ms / 1000, None, None
    late, held = deque(), deque()  # (line, deadline, answers, place); [answers, late ones among them]

    def learn(took: float) -> None:
        nonlocal usual
        usual = took if usual is None else 0.9 * usual + 0.1 * took

    def settle(waits: bool) -> None:
        """Takes the answer of the call that has been late for longest, if it is there or its deadline is over."""
        of, deadline, into, at = late[0]
        got = of.answer(deadline - time.monotonic() if waits else 0)
        if got is None and not waits and time.monotonic() < deadline:
            return
        late.popleft()
        if got:
            learn(of.took)
        into[0][at] = got or (None, TimedOut(f"{label} timed out after {ms}ms"))
        into[1] -= 1

    for batch in batches:
        mine = [[], 0]
        held.append(mine)
        for member in batch:
            while len(late) >= WAITING:
                settle(True)
            line, began = line or _Line(call), time.monotonic()
            line.asked.put((member,))
            patience = limit if usual is None else min(limit, max(limit * PATIENCE, usual * TIMES))
            got = line.answer(patience)
            mine[0].append(got)
            if got:
                learn(line.took)
            else:
                line.asked.put(None)
                late.append((line, began + limit, mine, len(mine[0]) - 1))
                mine[1] += 1
                line = None
        for _ in range(len(late)):
            before = len(late)
            settle(False)
            if len(late) == before:
                break
        while held and (not held[0][1] or len(held) > HELD):
            while held[0][1]:
                settle(True)
            yield held.popleft()[0]
    while held:
        while held[0][1]:
            settle(True)
        yield held.popleft()[0]
    if line is not None:
        line.asked.put(None)


class Session:
    """A model that is made on first use and kept; a failed attempt is made again the next time."""

    def __init__(self, make: Callable):
        self.make, self.made, self.lock = make, None, threading.Lock()

    def __reduce__(self):
        return Session, (self.make,)  # each process makes its own

    def get(self):
        with self.lock:
            if self.made is None:
                self.made = self.make()
            return self.made


def trimmed(recognize: Recognize) -> Recognize:
    """A text recogniser; its text without white space around it, none as empty."""

    def read(image: bytes):
        text, confidence = recognize(image)
        return (text or "").strip(SPACES), confidence

    return read


def image_type(image: bytes, fallback: str = "image/png") -> str:
    for magic, enough, kind in IMAGE_TYPES:
        if len(image) >= enough and image.startswith(magic):
            return kind
    return "image/webp" if len(image) >= 12 and image[:4] == b"RIFF" and image[8:12] == b"WEBP" else fallback


def vision(ask: Callable[[bytes, str], str | None], fallback: str = "image/png") -> Recognize:
    """A vision model ``ask(image, mime)``; the type comes from the image's own bytes."""
    return lambda image: ((ask(image, image_type(image, fallback)) or "").strip(SPACES), None)


def layout_reader(session: Session, prepare: Callable, decode: Callable, max_bytes: int = 25_000_000, least: float = 0.2, name: str = "granite-docling") -> Recognize:
    """A model run as ``decode(session(prepare(image)))`` = (text, confidence). Empty images need no session; large ones are refused; unsure results are empty."""

    def read(image: bytes):
        if not image:
            return "", None
        if len(image) > max_bytes:
            raise ValueError(f"{name}: image too large ({len(image)} > {max_bytes} bytes)")
        text, confidence = decode(session.get()(prepare(image)))
        if not text or confidence is not None and confidence < least:
            return "", None
        return text.strip(SPACES), confidence

    return read


def layout_available(has_session: bool, mode: str, has_webgpu: bool = False) -> bool:
    return has_session and (mode == "edge" or has_webgpu)


def reader(name: str, recognize: Recognize, timeout_ms: int = PAGE_MS, available: bool = True) -> Engine:
    """An engine for the cascade: each page by itself, within ``timeout_ms``; whatever goes wrong is its error."""

    @pandas_udf(RESULT)
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        def one(image):
            text, confidence = recognize(image if isinstance(image, str) else bytes(image))
            return text, confidence

        for answers in each_within(timeout_ms, name, one, batches):
            rows = [(value[0], None, value[1]) if error is None else (None, str(error) or type(error).__name__, None) for value, error in answers]
            yield pd.DataFrame(rows, columns=["text", "error", "confidence"]).astype({"confidence": "float64"})

    def recognized(image: Column) -> Column:
        small_batches()
        return read(image)

    return Engine(name, recognized, available)


class Registry:
    """The engine that an application sets once. One that is passed in wins, also over mode off."""

    def __init__(self) -> None:
        self.engine: Engine | None = None

    def set(self, engine: Engine | None) -> None:
        self.engine = engine

    def resolve(self, injected: Engine | None = None, mode: str = "auto") -> Engine:
        return injected or (NONE if mode == "off" else self.engine or NONE)
