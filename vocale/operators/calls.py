"""Calls of an outside text service, some in flight at once, each with a deadline."""

from __future__ import annotations

import asyncio
from collections.abc import Awaitable, Callable, Iterator

import pandas as pd

# Fixed value: the error of a call that was not answered in time.
TIMEOUT = "summary_timeout"

Client = Callable[[object, str], Awaitable[str]]


async def _answers(client: Client, keys: list, prompts: list[str], in_flight: int, deadline: float) -> list[tuple]:
    gate = asyncio.Semaphore(in_flight)

    async def one(key, prompt):
        async with gate:
            try:
                return await asyncio.wait_for(client(key, prompt), deadline), None
            except TimeoutError:
                return None, TIMEOUT
            except Exception as exc:
                return None, str(exc) or type(exc).__name__

    return await asyncio.gather(*[one(k, p) for k, p in zip(keys, prompts)])


def bounded_calls(
    make_client: Callable[[], Client], in_flight: int = 8, deadline: float = 30.0, key: str = "doc_id",
    prompt: str = "prompt",
) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A generator for summarize_negative: raw_summary and raw_error of every prompt, in their order.

    ``make_client`` runs once per task and gives a coroutine of key and prompt. A task has at most
    ``in_flight`` calls open, so the service sees that many times the tasks at once; the deadline
    in seconds counts from the start of the call, not from its place in the queue. A late call is
    cancelled, which frees its place, and its row has ``summary_timeout``; a failing one has its own
    message. No row is held back by another. A batch of Arrow rows is answered before the next is read.
    """
    if in_flight < 1 or deadline <= 0:
        raise ValueError("calls need a place in flight and a time above 0")

    def run(frames):
        client = make_client()
        with asyncio.Runner() as loop:
            for rows in frames:
                got = loop.run(_answers(client, rows[key].tolist(), rows[prompt].tolist(), in_flight, deadline))
                yield rows.assign(
                    raw_summary=pd.Series([a for a, _ in got], index=rows.index, dtype=object),
                    raw_error=pd.Series([e for _, e in got], index=rows.index, dtype=object))

    return run
