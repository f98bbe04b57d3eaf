"""The change feed as micro-batches: each snapshot once, in order, resumable from a stored position."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame

from ..plans.views import View


def follow(view: View, sink: Callable[[DataFrame, int], None], name: str, until: Callable[[], bool] | None = None, pause: float = 1.0) -> int:
    """Hand ``sink`` the changes of each snapshot after the position of ``name``; returns how many it took.

    A position is put in place after its sink has returned, so a sink sees a snapshot at
    least once and can tell a repeat by its id. Without ``until`` it stops at the head.
    """
    (leaf,) = view.leaves()
    store, seen = leaf.log.store, 0
    while True:
        leaf.log.reload()
        done = max((json.loads(store.read(f"metadata/feeds/{name}/{n}"))["at"] for n in store.names(f"metadata/feeds/{name}")), default=0)
        head = leaf.snapshot()["snapshot_id"]
        for snap in leaf.changed(done, head) if head > done else []:
            gone, added = view.snapshot_changes(leaf, snap)
            sink(gone.unionByName(added), snap["snapshot_id"])
            store.put_new(f"metadata/feeds/{name}/{snap['snapshot_id']:012d}.json", json.dumps({"at": snap["snapshot_id"]}).encode())
            seen += 1
        if until is None or until():
            return seen
        time.sleep(pause)
