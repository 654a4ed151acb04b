"""Chat completions, whole or as a stream of server-sent events."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from .embed import post


def pieces(lines: Iterable[str]) -> Iterator[str]:
    """Texts of the event lines of a streamed answer, up to the end mark; see
    :func:`lexigrid.plans.rag.sse_text` for the same on a table of lines."""
    for line in lines:
        if not line.startswith("data:"):
            continue
        payload = line[5:].strip()
        if payload == "[DONE]":
            return
        try:
            event = json.loads(payload)
        except ValueError:
            continue
        for choice in event.get("choices", [])[:1]:
            text = (choice.get("delta") or {}).get("content")
            if text:
                yield text


@dataclass
class ChatEndpoint:
    """A chat service that answers messages of ``role`` and ``content``."""

    url: str
    model: str
    api_key: str = ""
    timeout: int = 300
    verify: bool = True
    ca_bundle: str = ""

    def _post(self, messages: list[dict], stream: bool, temperature: float | None):
        body = {"model": self.model, "messages": messages, "stream": stream}
        if temperature is not None:
            body["temperature"] = temperature
        return post(self.url, body, self.api_key, self.timeout, self.verify, self.ca_bundle)

    def stream(self, messages: list[dict], temperature: float | None = None) -> Iterator[str]:
        with self._post(messages, True, temperature) as answer:
            yield from pieces(raw.decode("utf-8", "replace").rstrip("\r\n") for raw in answer)

    def answer(self, messages: list[dict], temperature: float | None = None) -> str:
        with self._post(messages, False, temperature) as answer:
            return json.load(answer)["choices"][0]["message"]["content"] or ""
