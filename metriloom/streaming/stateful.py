"""Stateful stream operators: liveness, cooldown, alerts, history and running z-score.

Each processor keeps a few numbers per series (the history keeps trimmed lists, by bucket of series). Cooldown, alerts, history
and z-score do not depend on the order of arrival: rows wait in state, by time slot, until the watermark has
passed, and are then applied in event-time order; rows behind it are handed out as late.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from metriloom.functions.quantities import finite
from metriloom.streaming.jobs import use_state_store, with_event_time

LONG = T.LongType()
#: event time in microseconds; a name that begins with a letter, as rows are handed to processors as named tuples
TIME = "event_us"


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


def _in_order(rows: Iterator[pd.DataFrame], ts: str, tie: str) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values([ts, tie], ignore_index=True)


def _micros(times: pd.Series) -> np.ndarray:
    return times.to_numpy("datetime64[us]").astype("int64")


def _times(us) -> pd.Series:
    return pd.Series(np.asarray(us, dtype="int64").astype("datetime64[us]"))


class _Processor(StatefulProcessor):
    """Common parts: key columns, order columns and the single value state."""

    state_schema: T.StructType

    def __init__(self, keys: Sequence[str], ts: str = "timestamp", tie: str = "seq"):
        self.keys, self.ts, self.tie = list(keys), ts, tie

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.state_schema)

    def close(self) -> None:
        pass

    def keyed(self, key, frame: pd.DataFrame) -> pd.DataFrame:
        for name, value in zip(self.keys, key):
            frame[name] = value
        return frame


class LivenessProcessor(_Processor):
    """Status changes of an agent from its heartbeats; idle changes come from event-time timers."""

    state_schema = _schema(last=LONG, status=T.StringType())

    def __init__(self, keys, ts, tie, warning_us: int, offline_us: int):
        super().__init__(keys, ts, tie)
        self.warning, self.offline = warning_us, offline_us

    def _idle_changes(self, last: int, status: str, until: int, out: list) -> str:
        if status == "online" and until - last > self.warning:
            out.append(("warning", last + self.warning))
            status = "warning"
        if status == "warning" and until - last > self.offline:
            out.append(("offline", last + self.offline))
            status = "offline"
        return status

    def _emit(self, key, out: list) -> Iterator[pd.DataFrame]:
        if out:
            yield self.keyed(key, pd.DataFrame({"status": [s for s, _ in out], "at": _times([t for _, t in out])}))

    def _set_timer(self, last: int, status: str) -> None:
        wait = {"online": self.warning, "warning": self.offline}.get(status)
        if wait is not None:
            self.handle.registerTimer((last + wait) // 1000 + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _in_order(rows, self.ts, self.tie)
        last, status = self.state.get() if self.state.exists() else (None, None)
        out: list = []
        for t in _micros(pdf[self.ts]):
            t = int(t)
            if last is not None:
                if t <= last:
                    continue  # a late heartbeat changes nothing
                status = self._idle_changes(last, status, t, out)
            if status != "online":
                out.append(("online", t))
            last, status = t, "online"
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self._set_timer(last, status)
        self.state.update((last, status))
        yield from self._emit(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, status = self.state.get()
        out: list = []
        status = self._idle_changes(last, status, timerValues.getCurrentWatermarkInMs() * 1000, out)
        self._set_timer(last, status)
        self.state.update((last, status))
        yield from self._emit(key, out)


class OrderedProcessor(_Processor):
    """Applies the rows of a series in event-time order, however they arrive.

    A row waits in a map state under its time slot until the watermark has passed the slot's end; no row of the
    slot can then be accepted any more. A timer at the end of the earliest waiting slot releases all slots that
    are complete, in order, and each slot's rows by (time, tie). A row whose slot is complete already, or that
    has no time, is late: it changes nothing and goes out with ``late`` set and no result.

    Arriving rows are only written (one entry per slot and Arrow batch, never read again before their release),
    so a call holds one Arrow batch or one slot of one series, however many rows the series has.
    """

    def __init__(self, keys, ts, tie, value: str | None, slot_seconds: int):
        super().__init__(keys, ts, tie)
        self.value, self.slot_ms = value, slot_seconds * 1_000

    def init(self, handle) -> None:
        super().init(handle)
        lists = _schema(at=T.ArrayType(LONG), tie=T.ArrayType(LONG), value=T.ArrayType(T.DoubleType()))
        self.pending = handle.getMapState("pending", _schema(slot=LONG, part=LONG), lists)
        self.plan = handle.getValueState("plan", _schema(parts=LONG, timer=LONG))  # entries written, time of the timer

    def slot_end(self, at: np.ndarray) -> np.ndarray:
        """Milliseconds at which the slots of times in microseconds end."""
        return (at // 1_000 // self.slot_ms + 1) * self.slot_ms

    def placed(self, pdf: pd.DataFrame, mark: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each row: if it has a time, that time, the end of its slot, and if it is late."""
        timed = pdf[TIME].notna().to_numpy()
        at = pdf[TIME].fillna(0).to_numpy("int64")
        end = self.slot_end(at)
        return timed, at, end, ~timed | ((end <= mark) & (mark > 0))

    def fold(self, carry: tuple | None, at: np.ndarray, tie: np.ndarray, value: np.ndarray) -> tuple[tuple | None, dict | None]:
        """New carried state and output columns for rows in order."""
        raise NotImplementedError

    def late_rows(self, at: pd.Series, tie: pd.Series, value: pd.Series | None) -> dict:
        return {self.tie: tie, self.ts: at}

    def _out(self, key, columns: dict, late: bool) -> pd.DataFrame:
        return self.keyed(key, pd.DataFrame(columns).assign(late=late))

    def _set_timer(self, parts: int, old: int, new: int) -> None:
        if new != old:
            if old >= 0:
                self.handle.deleteTimer(old)
            if new >= 0:
                self.handle.registerTimer(new)
        self.plan.update((parts, new))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        parts, timer = self.plan.get() if self.plan.exists() else (0, -1)
        earliest = timer
        for pdf in rows:
            if self.value is not None:
                pdf = self.judged(pdf)
            timed, at, end, late = self.placed(pdf, mark)
            if late.any():
                value = pdf[self.value][late] if self.value is not None else None
                yield self._out(key, self.late_rows(_times(at[late]).where(timed[late]), pdf[self.tie][late].reset_index(drop=True), value), True)
            chosen = np.flatnonzero(~late)
            order = chosen[np.argsort(end[chosen], kind="stable")]
            tie = pdf[self.tie].fillna(-1).to_numpy("int64")
            values = pdf[self.value].to_numpy("float64") if self.value is not None else np.empty(0)
            for one in np.split(order, np.flatnonzero(np.diff(end[order])) + 1):
                if len(one):
                    slot = int(end[one[0]])
                    self.pending.updateValue((slot, parts), (at[one].tolist(), tie[one].tolist(), values[one].tolist() if len(values) else []))
                    parts += 1
                    earliest = slot if earliest < 0 else min(earliest, slot)
        self._set_timer(parts, timer, earliest)

    def judged(self, pdf: pd.DataFrame) -> pd.DataFrame:
        """Rows that take part: those with a value, as one without would stay in a running mean for ever."""
        return pdf[np.isfinite(pdf[self.value].to_numpy("float64"))]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        parts, _ = self.plan.get()
        waiting: dict[int, list[int]] = {}
        for slot, part in self.pending.keys():
            waiting.setdefault(slot, []).append(part)
        carry = self.state.get() if self.state.exists() else None
        ready = sorted(s for s in waiting if s <= mark)
        for slot in ready:
            lists = [self.pending.getValue((slot, part)) for part in waiting.pop(slot)]
            at, tie = (np.concatenate([np.asarray(x[i], "int64") for x in lists]) for i in (0, 1))
            value = np.concatenate([np.asarray(x[2], "float64") for x in lists])
            order = np.lexsort((tie, at))
            carry, out = self.fold(carry, at[order], tie[order], value[order] if len(value) else value)
            if out is not None:
                yield self._out(key, out, False)
        for slot, part in [k for k in self.pending.keys() if k[0] <= mark]:
            self.pending.removeKey((slot, part))
        if carry is not None:
            self.state.update(carry)
        elif self.state.exists():
            self.state.clear()
        self._set_timer(parts if waiting else 0, -1, min(waiting, default=-1))


class CooldownProcessor(OrderedProcessor):
    """Accept a request when the last accepted one is at least a cooldown ago."""

    state_schema = _schema(last=LONG)

    def __init__(self, keys, ts, tie, slot_seconds, cooldown_us: int):
        super().__init__(keys, ts, tie, None, slot_seconds)
        self.cooldown = cooldown_us

    def fold(self, carry, at, tie, value):
        accepted = np.zeros(len(at), dtype=bool)
        last = carry[0] if carry else None
        i = 0 if last is None else int(np.searchsorted(at, last + self.cooldown, side="left"))
        while i < len(at):
            accepted[i], last = True, int(at[i])
            i = int(np.searchsorted(at, last + self.cooldown, side="left"))
        return (last,), {self.tie: tie, self.ts: _times(at), "accepted": accepted}

    def late_rows(self, at, tie, value):
        return {self.tie: tie, self.ts: at, "accepted": None}


class AlertProcessor(OrderedProcessor):
    """State of one alert per evaluation: inactive, pending, firing after holding for its time."""

    state_schema = _schema(since=LONG)

    def __init__(self, keys, ts, tie, slot_seconds, value: str, op: str, threshold: float, for_us: int):
        super().__init__(keys, ts, tie, value, slot_seconds)
        self.op, self.threshold, self.wait = op, threshold, for_us

    def judged(self, pdf):
        return pdf  # an evaluation without a value is one at which the condition does not hold

    def fold(self, carry, at, tie, value):
        compare = {">": np.greater, "<": np.less, "==": np.equal, ">=": np.greater_equal, "<=": np.less_equal}[self.op]
        holds = compare(value, self.threshold) & np.isfinite(value)
        started = np.append(True, ~holds[:-1]) & holds
        since = pd.Series(np.where(started, at, np.nan))
        if holds[0] and carry is not None:
            since.iloc[0] = carry[0]
        since = since.ffill().where(holds)
        fires = at - since.fillna(0).to_numpy() >= self.wait
        state = np.where(~holds, "inactive", np.where(fires, "firing", "pending"))
        return (int(since.iloc[-1]),) if holds[-1] else None, {self.tie: tie, self.ts: _times(at), "state": state}

    def late_rows(self, at, tie, value):
        return {self.tie: tie, self.ts: at, "state": None}


class HistoryProcessor(OrderedProcessor):
    """The last ``size`` values of every series of a bucket; after each release the facts an online forecast needs.

    A call, a timer and a waiting entry cost the same for one series as for a thousand, so they belong to a bucket of
    series. An entry holds its series once and its rows as arrays; what is kept lies in blocks of series, so a release
    reads and writes a block, not a series, and holds ``ROWS`` waiting rows and one slot at most besides.
    """

    ROWS = 200_000
    BLOCKS = 32

    def __init__(self, labels: Sequence[str], slot_seconds: int, size: int, window: int):
        super().__init__(["bucket"], "until", "tie", "value", slot_seconds)
        self.labels, self.size, self.window = list(labels), size, window

    def init(self, handle) -> None:
        self.handle = handle
        series = {label: T.ArrayType(T.StringType()) for label in self.labels}
        waiting = {c: T.BinaryType() for c in ("block", "place", "at", "tie", "value")}
        kept = {c: T.BinaryType() for c in ("until", "n", "value")}
        self.pending = handle.getMapState("pending", _schema(slot=LONG, part=LONG), _schema(**series, **waiting))
        self.kept = handle.getMapState("kept", _schema(block=LONG), _schema(**series, **kept))
        self.plan = handle.getValueState("plan", _schema(parts=LONG, timer=LONG))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        parts, timer = self.plan.get() if self.plan.exists() else (0, -1)
        earliest = timer
        for pdf in rows:
            pdf = self.judged(pdf).reset_index(drop=True)
            timed, at, end, late = self.placed(pdf, mark)
            if late.any():
                facts = {"n": None, "last": pdf["value"], "ma": None, "prev": None, "std": None, "until": _times(at).where(timed), "late": True}
                yield pdf[self.labels].assign(**facts)[late]
            labels = [pdf[c].to_numpy(object) for c in self.labels]
            series = pdf.groupby(self.labels, dropna=False, sort=False).ngroup().to_numpy()
            block, tie, value = (pdf[c].to_numpy(d) for c, d in (("block", "int64"), ("tie", "int64"), ("value", "float64")))
            chosen = np.flatnonzero(~late)
            order = chosen[np.argsort(end[chosen], kind="stable")]
            for one in np.split(order, np.flatnonzero(np.diff(end[order])) + 1):
                if len(one):
                    slot = int(end[one[0]])
                    _, first, place = np.unique(series[one], return_index=True, return_inverse=True)
                    arrays = (block[one[first]], place.astype("int64"), at[one], tie[one], value[one])
                    self.pending.updateValue((slot, parts), (*(x[one[first]].tolist() for x in labels), *(x.tobytes() for x in arrays)))
                    parts += 1
                    earliest = slot if earliest < 0 else min(earliest, slot)
        self._set_timer(parts, timer, earliest)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        parts, _ = self.plan.get()
        waiting: dict[int, list[int]] = {}
        for slot, part in self.pending.keys():
            waiting.setdefault(slot, []).append(part)
        ready = {s: waiting.pop(s) for s in sorted(waiting) if s <= mark}
        held, n, blocks = [], 0, set()
        for slot, slot_parts in ready.items():
            for part in slot_parts:
                held.append(self._rows(self.pending.getValue((slot, part))))
                n += len(held[-1])
            if n >= self.ROWS:
                blocks |= self._keep(held)
                held, n = [], 0
        if held:
            blocks |= self._keep(held)
        if waiting:
            for slot, slot_parts in ready.items():
                for part in slot_parts:
                    self.pending.removeKey((slot, part))
        else:
            self.pending.clear()
        # rows of slots before these were released earlier, so a series whose newest row is older has none now
        if facts := [self._facts(self.kept.getValue((block,)), min(ready)) for block in sorted(blocks)]:
            yield pd.concat(facts, ignore_index=True)
        self._set_timer(parts if waiting else 0, -1, min(waiting, default=-1))

    def _rows(self, entry: tuple) -> pd.DataFrame:
        block, place, at, tie = (np.frombuffer(x, "int64") for x in entry[-5:-1])
        labels = {c: np.array(x, object)[place] for c, x in zip(self.labels, entry)}
        return pd.DataFrame({**labels, "block": block[place], "at": at, "tie": tie, "value": np.frombuffer(entry[-1], "float64")})

    def _keep(self, held: list[pd.DataFrame]) -> set[int]:
        """Puts rows of complete slots behind what is kept of their series; the blocks changed."""
        rows = pd.concat(held, ignore_index=True).sort_values(["at", "tie"], kind="stable")
        changed = set()
        for block, new in rows.groupby("block", sort=False):
            stored = self.kept.getValue((int(block),))
            if stored is not None:
                until, n = (np.frombuffer(x, "int64") for x in stored[-3:-1])
                of = np.repeat(np.arange(len(n)), n)
                labels = {c: np.array(x, object)[of] for c, x in zip(self.labels, stored)}
                old = pd.DataFrame({**labels, "at": until[of], "value": np.frombuffer(stored[-1], "float64")})
                new = pd.concat([old, new], ignore_index=True)
            series = new.groupby(self.labels, dropna=False, sort=False).ngroup().to_numpy()
            order = np.argsort(series, kind="stable")
            n = np.bincount(series)
            ends = np.cumsum(n)
            fresh = np.repeat(ends, n) - np.arange(len(order)) <= self.size
            value, until = new["value"].to_numpy("float64")[order[fresh]], new["at"].to_numpy("int64")[order[ends - 1]]
            names = (new[c].to_numpy(object)[order[ends - 1]].tolist() for c in self.labels)
            self.kept.updateValue((int(block),), (*names, until.tobytes(), np.minimum(n, self.size).tobytes(), value.tobytes()))
            changed.add(int(block))
        return changed

    def _facts(self, stored: tuple, since: int) -> pd.DataFrame:
        until, n = (np.frombuffer(x, "int64") for x in stored[-3:-1])
        value, ends = np.frombuffer(stored[-1], "float64"), np.cumsum(n)
        w = self.window
        ma, std, prev = np.full(len(n), np.nan), np.full(len(n), np.nan), np.full(len(n), np.nan)
        now, before = np.minimum(n, w), np.clip(n - w, 0, w)
        for size in np.unique(now):
            at = np.flatnonzero(now == size)
            newest = value[(ends[at] - size)[:, None] + np.arange(size)]
            ma[at], std[at] = newest.mean(axis=1), newest.std(axis=1)
        for size in np.unique(before[before > 0]):
            at = np.flatnonzero(before == size)
            prev[at] = value[(ends[at] - w - size)[:, None] + np.arange(size)].mean(axis=1)
        frame = pd.DataFrame(dict(zip(self.labels, (np.array(x, object) for x in stored))))
        frame = frame.assign(n=n, last=value[ends - 1], ma=ma, prev=pd.Series(prev).where(before > 0, None), std=std, until=_times(until), late=False)
        return frame[self.slot_end(until) >= since]


class ZScoreProcessor(OrderedProcessor):
    """Score each point against the mean and deviation of the points before it.

    Sums are taken around the first value of the series, which is never far from the mean in deviations of the whole,
    and go on from slot to slot in one order, so a score does not depend on how rows came or were released.
    """

    state_schema = _schema(n=LONG, base=T.DoubleType(), s1=T.DoubleType(), s2=T.DoubleType())

    def __init__(self, keys, ts, tie, slot_seconds, value: str, sigma: float, min_points: int, digits: int):
        super().__init__(keys, ts, tie, value, slot_seconds)
        self.sigma, self.min_points, self.digits = sigma, min_points, digits

    def fold(self, carry, at, tie, v):
        n0, base, first, second = carry or (0, float(v[0]), 0.0, 0.0)
        d = v - base
        s1, s2 = np.cumsum(np.append(first, d)), np.cumsum(np.append(second, d * d))
        n = n0 + np.arange(len(v) + 1)
        shift = s1 / np.maximum(n, 1)
        spread = np.maximum(s2 - s1 * shift, 0.0)
        carry = (int(n[-1]), base, float(s1[-1]), float(s2[-1]))
        mean, std = (base + shift)[:-1], np.maximum(np.sqrt(spread[:-1] / np.maximum(n[:-1], 1)), 0.001)
        score = np.round(np.abs(v - mean) / std, self.digits)
        hit = (n[:-1] >= self.min_points) & (score > self.sigma)
        out = {self.tie: tie[hit], self.ts: _times(at[hit]), self.value: v[hit], "expected": mean[hit], "score": score[hit]}
        return carry, out if hit.any() else None

    def late_rows(self, at, tie, value):
        return {self.tie: tie, self.ts: at, self.value: value.reset_index(drop=True), "expected": None, "score": None}


def _run(df: DataFrame, keys: Sequence[str], processor: StatefulProcessor, output: T.StructType, time_mode: str = "none") -> DataFrame:
    use_state_store(df.sparkSession)
    return df.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=output, outputMode="append", timeMode=time_mode
    )


def _output(df: DataFrame, keys: Sequence[str], *copied: str, **fields: T.DataType) -> T.StructType:
    return T.StructType([*[df.schema[k] for k in (*keys, *copied)], *_schema(**fields).fields])


def stream_liveness(
    heartbeats: DataFrame, *, keys: Sequence[str] = ("agent_id",), ts: str = "timestamp", tie: str = "seq", warning_seconds: int = 120,
    offline_seconds: int = 300, delay: str = "1 minute",
) -> DataFrame:
    """Status changes (online, warning, offline) with their times."""
    df = with_event_time(heartbeats.select(*keys, ts, tie), ts, delay)
    processor = LivenessProcessor(keys, ts, tie, warning_seconds * 1_000_000, offline_seconds * 1_000_000)
    return _run(df, keys, processor, _output(df, keys, status=T.StringType(), at=T.TimestampType()), "eventtime")


def _ordered(df: DataFrame, keys: Sequence[str], ts: str, tie: str, value: str | None, delay: str) -> DataFrame:
    """Rows for an ``OrderedProcessor``. Their time goes in as a plain number, so that Spark, which drops late rows
    of a watermarked column without trace, hands them over."""
    marked = with_event_time(df.select(*keys, ts, tie, *([value] if value else [])), ts, delay)
    if value:
        marked = marked.withColumn(value, finite(value))
    return marked.withColumn(TIME, F.unix_micros(ts)).drop(ts)


def stream_cooldown(
    requests: DataFrame, *, keys: Sequence[str] = ("namespace", "workload"), ts: str = "timestamp", tie: str = "seq", cooldown_seconds: int = 300,
    delay: str = "10 minutes", slot_seconds: int = 60,
) -> DataFrame:
    """Requests marked accepted or not, as if they had come in event-time order; late ones are marked ``late``."""
    df = _ordered(requests, keys, ts, tie, None, delay)
    processor = CooldownProcessor(keys, ts, tie, slot_seconds, cooldown_seconds * 1_000_000)
    return _run(df, keys, processor, _output(df, keys, tie, **{ts: T.TimestampType()}, accepted=T.BooleanType(), late=T.BooleanType()), "eventtime")


def stream_alerts(
    values: DataFrame, *, keys: Sequence[str], op: str, threshold: float, for_seconds: int, ts: str = "timestamp", tie: str = "seq", value: str = "value",
    delay: str = "10 minutes", slot_seconds: int = 60,
) -> DataFrame:
    """State of one alert rule per series and evaluation, in event-time order; late ones are marked ``late``."""
    df = _ordered(values, keys, ts, tie, value, delay)
    processor = AlertProcessor(keys, ts, tie, slot_seconds, value, op, threshold, for_seconds * 1_000_000)
    return _run(df, keys, processor, _output(df, keys, tie, **{ts: T.TimestampType()}, state=T.StringType(), late=T.BooleanType()), "eventtime")


def stream_history(
    samples: DataFrame, *, keys: Sequence[str] = ("name",), ts: str = "timestamp", tie: str = "seq", value: str = "value", size: int = 1000, window: int = 12,
    delay: str = "10 minutes", slot_seconds: int = 60, buckets: int = 256,
) -> DataFrame:
    """Per series and release the facts for :func:`metriloom.operators.forecast.online_values`.

    A late sample is a row with ``late`` set, its value in ``last`` and its time in ``until``. The series are dealt
    over ``buckets``, whose number stays with the state of a stream.
    """
    df = _ordered(samples, keys, ts, tie, value, delay)
    labels, hashed = [f"k{i}" for i in range(len(keys))], F.xxhash64(*keys)
    rows = df.select(
        F.pmod(hashed, F.lit(buckets)).cast("int").alias("bucket"),
        F.pmod(F.shiftright(hashed, 32), F.lit(HistoryProcessor.BLOCKS)).cast("int").alias("block"),
        *[F.col(k).cast("string").alias(c) for k, c in zip(keys, labels)],
        F.coalesce(F.col(tie).cast("long"), F.lit(-1)).alias("tie"),
        F.col(value).cast("double").alias("value"),
        TIME,
    )
    double = T.DoubleType()
    names = {c: T.StringType() for c in labels}
    output = _schema(**names, n=LONG, last=double, ma=double, prev=double, std=double, until=T.TimestampType(), late=T.BooleanType())
    facts = _run(rows, ["bucket"], HistoryProcessor(labels, slot_seconds, size, window), output, "eventtime")
    named = [F.col(c).cast(df.schema[k].dataType).alias(k) for k, c in zip(keys, labels)]
    return facts.select(*named, "n", "last", "ma", "prev", "std", "until", "late")


def stream_zscore(
    samples: DataFrame, *, keys: Sequence[str] = ("name",), ts: str = "timestamp", tie: str = "seq", value: str = "value", sigma: float = 2.5,
    min_points: int = 12, digits: int = 6, delay: str = "10 minutes", slot_seconds: int = 60,
) -> DataFrame:
    """Points whose distance from the running mean exceeds ``sigma`` running deviations, and late points."""
    df = _ordered(samples, keys, ts, tie, value, delay)
    double = T.DoubleType()
    processor = ZScoreProcessor(keys, ts, tie, slot_seconds, value, sigma, min_points, digits)
    return _run(df, keys, processor, _output(df, keys, tie, **{ts: T.TimestampType(), value: double}, expected=double, score=double, late=T.BooleanType()), "eventtime")
