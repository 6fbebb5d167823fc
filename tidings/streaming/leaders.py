"""Online clusters as a stream (CL1): leaders and their centroids are keyed state, so no item waits for a silence."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Leaders(StatefulProcessor):
    """State of a shard: each story that can still be joined with its centroid, size and last time."""

    def __init__(self, base: float, hours: int):
        self.base, self.hours = base, hours

    def init(self, handle) -> None:
        self.handle = handle
        self.stories = handle.getMapState("stories", "story long", "centre array<double>, size long, last_us long")

    def handleInputRows(self, key, rows, timerValues):
        f = pd.concat(list(rows)).sort_values(["at", "item"])
        held = [(s[0], *v) for s, v in self.stories.iterator()]
        lead, size, last = [h[0] for h in held], [h[2] for h in held], np.array([h[3] for h in held], np.int64)
        centre = np.array([h[1] for h in held], float) if held else np.zeros((0, len(f["v"].iloc[0])))
        # room for every item to lead; places beyond n are not used yet
        n = len(lead)
        centre, last = np.r_[centre, np.zeros((len(f), centre.shape[1]))], np.r_[last, np.zeros(len(f), np.int64)]
        touched, out, span = set(), [], self.hours * 3_600_000_000
        for item, at, v in zip(f["item"], f["at"], f["v"]):
            us, v, best = at.value // 1000, np.asarray(v, float), -1
            live = np.flatnonzero(us - last[:n] <= span)
            if len(live):
                sim = centre[live] @ v
                j = int(np.argmax(sim))
                if sim[j] >= min(self.base + 0.05, self.base + 0.015 * np.log2(max(size[live[j]], 1))):
                    best = int(live[j])
            if best < 0:
                best, n = n, n + 1
                lead.append(item)
                size.append(0)
                centre[best] = v
            else:
                c = centre[best] * size[best] + v
                centre[best] = c / max(1e-12, float(np.linalg.norm(c)))
            size[best] += 1
            last[best] = us
            touched.add(best)
            out.append((key[0], item, lead[best]))
        newest = int(last[:n].max())
        for k in range(n):
            if newest - last[k] > span:  # too old for anything that may come
                if self.stories.containsKey((lead[k],)):
                    self.stories.removeKey((lead[k],))
            elif k in touched:
                self.stories.updateValue((lead[k],), (centre[k].tolist(), int(size[k]), int(last[k])))
        self.handle.registerTimer(newest // 1000 + self.hours * 3_600_000)
        yield pd.DataFrame(out, columns=["shard", "item", "story"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """A shard without news for so long forgets its stories."""
        until = expiredTimerInfo.getExpiryTimeInMs() - self.hours * 3_600_000
        for s in [s for s, v in self.stories.iterator() if v[2] // 1000 <= until]:
            self.stories.removeKey(s)
        return iter(())

    def close(self) -> None:
        pass


def online_stream(items: DataFrame, base: float = 0.75, hours: int = 72) -> DataFrame:
    """shard, item, story of a stream of items (shard, item, at, v), as operators.cluster.online() gives them for a table.

    Batches must come in order of time, as a claim by time gives them; items of one batch may stand in any order. A task holds
    the stories of a shard that are younger than ``hours``; older ones leave the state with the shard's next batch or, by a timer, without."""
    items.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    late = items.withWatermark("at", f"{hours} hours")
    return late.groupBy("shard").transformWithStateInPandas(statefulProcessor=Leaders(base, hours), outputStructType="shard long, item long, story long", outputMode="append", timeMode="eventTime")
