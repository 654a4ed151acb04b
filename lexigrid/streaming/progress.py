"""Progress of streaming queries, a line a batch."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql.streaming import StreamingQueryListener


class Progress(StreamingQueryListener):
    """Tells ``say`` of each batch: its number, rows and rows a second."""

    def __init__(self, say: Callable[[str], None] = print):
        self.say = say

    def onQueryStarted(self, event) -> None:
        self.say(f"{event.name or event.id} started")

    def onQueryProgress(self, event) -> None:
        p = json.loads(event.progress.json)
        self.say(f"batch {p['batchId']}: {p['numInputRows']} rows, {p.get('processedRowsPerSecond') or 0:.0f} a second")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.say(f"ended: {event.exception}" if event.exception else "ended")
