"""Per-caller state: sliding rate limit and answer cache with a time to live."""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict, deque
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


#: States that all callers of a rate limit, or all keys of an answer cache, share.
CALLER_STATES = 1024


def rate_limit(
    requests: DataFrame, limit: int, seconds: int = 60, count_rejected: bool = True, lateness: str = "10 minutes"
) -> DataFrame:
    """Verdict per request, in order of time, with the caller's times of the last window as state.

    ``requests(request_id, caller, ts)``, ``ts`` a TIMESTAMP. A request waits in the state until the
    watermark (the newest time less ``lateness``) has passed it; then all that came before it is
    there, in whatever batch it arrived, and verdicts are given by (ts, request_id). Later ones are
    dropped by the watermark. At most ``limit`` admitted times are kept when rejected ones do not
    count; otherwise only what is younger than the window. A caller's times end when the watermark
    is a window past the last of them.

    Callers share states by hash: a call of the state function costs about as much as some thousand
    verdicts, so their number must not grow with that of the callers.
    """
    width = seconds * 1_000_000

    def admit(key, batches: Iterator[pd.DataFrame], state: GroupState):
        waiting, ids, callers, times, owners = (list(x) for x in state.get) if state.exists else ([], [], [], [], [])
        for rows in batches:
            waiting += rows["us"].tolist()
            ids += rows["request_id"].tolist()
            callers += rows["caller"].tolist()
        passed = state.getCurrentWatermarkMs() * 1000
        order = sorted(zip(waiting, ids, callers), key=itemgetter(0, 1))
        n = bisect_left(order, passed, key=itemgetter(0))
        ready, later = order[:n], order[n:]
        windows, filled, allowed = defaultdict(deque), [], []
        for owner, us in zip(owners, times):
            windows[owner].append(us)
        for us, _, caller in ready:
            window = windows[caller]
            while window and us - window[0] >= width:
                window.popleft()
            filled.append(len(window))
            allowed.append(len(window) < limit)
            if allowed[-1] or count_rejected:
                window.append(us)
        # What comes later is not before the watermark: times a window behind it count no more.
        kept = [(caller, us) for caller, window in windows.items() for us in window if us + width > passed]
        if later or kept:
            ends = later[0][0] if later else max(us for _, us in kept) + width
            state.update(([x[0] for x in later], [x[1] for x in later], [x[2] for x in later],
                          [us for _, us in kept], [caller for caller, _ in kept]))
            state.setTimeoutTimestamp(max(ends, passed) // 1000 + 1)
        else:
            state.remove()
        if ready:
            yield pd.DataFrame({
                "request_id": [i for _, i, _ in ready], "caller": [caller for *_, caller in ready],
                "ts": pd.to_datetime(np.array([us for us, *_ in ready], "int64"), unit="us", utc=True),
                "in_window": filled, "allowed": allowed,
            })

    kind = requests.schema["caller"].dataType
    # As strings, callers keep all digits in pandas, and a missing one stays apart.
    timed = requests.withWatermark("ts", lateness).select(
        "request_id", F.col("caller").cast("string").alias("caller"), "ts", F.unix_micros("ts").alias("us"),
        F.pmod(F.xxhash64("caller"), F.lit(CALLER_STATES)).alias("_state"))
    verdicts = timed.groupBy("_state").applyInPandasWithState(
        admit, "request_id long, caller string, ts timestamp, in_window long, allowed boolean",
        "waiting array<long>, ids array<long>, callers array<string>, times array<long>, owners array<string>",
        "append", GroupStateTimeout.EventTimeTimeout,
    )
    return verdicts.withColumn("caller", F.col("caller").cast(kind))


def cached_answers(
    requests: DataFrame, answers: DataFrame, seconds: int = 3600, lateness: str = "10 minutes"
) -> DataFrame:
    """The answer that the cache holds for each request: the newest (largest ``answer_ts``, ``answer_id``)
    of the same key that is not later than the request and younger than the life.

    A request waits until the watermark has passed it, as in :func:`rate_limit`; only then it is
    answered, once, so that the work does not grow with the pairs of requests and answers of a key.
    Of the answers before the watermark the newest of each key is kept, until its life ends. Requests
    without an answer give no row. Keys share states by hash.
    """
    width = seconds * 1_000_000

    def look_up(key, batches: Iterator[pd.DataFrame], state: GroupState):
        parts = list(batches)
        if state.exists:
            names, codes, us, ids, asked = state.get
            parts.append(pd.DataFrame({"key": np.array(names, object)[np.array(codes, "int64")], "us": us, "id": ids, "asked": asked}))
        rows = pd.concat(parts).dropna(subset=["key"])
        code, names = pd.factorize(rows["key"])
        us, ids, asked = rows["us"].to_numpy("int64"), rows["id"].to_numpy("int64"), rows["asked"].to_numpy(bool)
        # Per key in order of time, answers before requests of the same time: the newest answer comes last.
        order = np.lexsort((ids, asked, us, code))
        code, us, ids, asked = code[order], us[order], ids[order], asked[order]
        passed = state.getCurrentWatermarkMs() * 1000
        ready = us < passed
        newest = np.maximum.accumulate(np.where(asked, -1, np.arange(len(us))))
        hits = np.nonzero(asked & ready & (newest >= 0))[0]
        given = newest[hits]
        fresh = (code[given] == code[hits]) & (us[given] > us[hits] - width)
        hits, given = hits[fresh], given[fresh]
        old = np.nonzero(~asked & ready)[0]
        last = old[np.append(code[old[1:]] != code[old[:-1]], True)[:len(old)]]
        kept = ~ready
        kept[last[us[last] + width > passed]] = True
        if kept.any():
            used, codes = np.unique(code[kept], return_inverse=True)
            state.update(([str(x) for x in names[used]], codes.tolist(), us[kept].tolist(), ids[kept].tolist(), asked[kept].tolist()))
            waiting = us[kept & asked]
            ends = int(waiting.min()) if len(waiting) else int(us[kept].max()) + width
            state.setTimeoutTimestamp(max(ends, passed) // 1000 + 1)
        elif state.exists:
            state.remove()
        if len(hits):
            yield pd.DataFrame({
                "request_id": ids[hits], "key": names[code[hits]], "ts": pd.to_datetime(us[hits], unit="us", utc=True),
                "answer_id": ids[given], "answer_ts": pd.to_datetime(us[given], unit="us", utc=True),
            })

    def timed(df: DataFrame, own: str, asked: bool) -> DataFrame:
        return df.withWatermark("ts", lateness).select(
            "ts", F.col("key").cast("string").alias("key"), F.unix_micros("ts").alias("us"), F.col(own).cast("long").alias("id"),
            F.lit(asked).alias("asked"), F.pmod(F.xxhash64("key"), F.lit(CALLER_STATES)).alias("_state"))

    both = timed(requests, "request_id", True).unionByName(timed(answers, "answer_id", False))
    return both.groupBy("_state").applyInPandasWithState(
        look_up, "request_id long, key string, ts timestamp, answer_id long, answer_ts timestamp",
        "keys array<string>, codes array<int>, times array<long>, ids array<long>, asked array<boolean>",
        "append", GroupStateTimeout.EventTimeTimeout,
    )
