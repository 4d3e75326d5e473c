"""Two fighters followed through the detections of a video, as a state machine of one session.

`advance` takes the state of both tracks and a frame and returns the next state and what the frame shows; batch and
stream run it alike. Batch: rows sorted by session and frame flow through a task, which holds the state of one session at
a time, so neither the length nor the number of sessions costs memory. Stream: `transformWithState` keeps that state for
each session and forgets it when a session stays silent.

A frame in which detections were looked for deals them to the predicted boxes by place and looks; a track without one
coasts, and is sought among the others by looks alone after a while. Between such frames the boxes are predictions.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from posewright.operators.folds import kalman_predict, kalman_start, kalman_update


@dataclass(frozen=True)
class Rules:
    # fixed values: frames between detections, and the least share of the frame that a person fills
    stride: int = 3
    least_area: float = 0.020
    # fixed values: heights that a candidate may be away from a prediction, and a height where none is known
    crowd_reach: float = 3.5
    jump: float = 2.5
    default_height: float = 0.40
    tallest: float = 1.60
    # fixed values: least likeness for a match, also behind a clinch, and the score of place, looks and size
    looks_floor: float = 0.35
    looks_floor_settling: float = 0.52
    place_weight: float = 0.28
    looks_weight: float = 0.72
    least_score: float = 0.04
    far: float = 0.50
    small: tuple = (0.55, 0.05)
    large: tuple = (1.80, 0.30)
    # fixed values: votes for exchanged tracks
    swap_margin: float = 0.08
    swap_votes: int = 3
    # fixed values: coasting and damping
    damp_after: int = 3
    damping: float = 0.85
    lost_after: int = 15
    longest_coast: int = 60
    # fixed values: blending of heights and looks
    keep: float = 0.92
    blend_every: int = 20
    # fixed values: search for a lost track
    lost_likeness: float = 0.65
    lost_reach: float = 3.0
    live_reach: float = 3.5
    lost_height: float = 0.45
    pair_reach: float = 4.5
    # fixed values: clinches, and the frames (in strides) that stay unreliable behind one and behind a search
    clinch_overlap: float = 0.20
    clinch_reach: float = 0.55
    settle: int = 20
    cooldown: int = 5


RULES = Rules()
STATE = "fi long, w double, h double, votes long, my array<double>, op array<double>, my_look array<double>, op_look array<double>, my_clean array<double>, op_clean array<double>"
SHOWN = "clinch boolean, my_box array<int>, op_box array<int>, my_pick int, op_pick int, my_coast int, op_coast int, my_conf double, op_conf double, my_reliable boolean, op_reliable boolean"

ARROW = {"boolean": pa.bool_(), "int": pa.int32(), "double": pa.float64(), "array<int>": pa.list_(pa.int32())}


@dataclass(frozen=True)
class Track:
    """place and speed of centre and size with their covariance; height: the usual one, or None."""

    x: np.ndarray
    v: np.ndarray
    cov: np.ndarray
    coast: int = 0
    height: float | None = None
    cooldown: int = 0
    settling: int = 0
    look: np.ndarray | None = None
    clean: np.ndarray | None = None

    def box(self) -> np.ndarray:
        half = np.maximum(self.x[2:], 10.0) / 2
        return np.trunc(np.concatenate([self.x[:2] - half, self.x[:2] + half]))

    def predicted(self) -> Track:
        x, cov = kalman_predict(self.x, self.v, self.cov)
        return replace(self, x=x, cov=cov)

    def updated(self, box: np.ndarray) -> Track:
        x, v, cov = kalman_update(self.x, self.v, self.cov, measured(box))
        return replace(self, x=x, v=v, cov=cov, coast=0)

    def missed(self, rules: Rules) -> Track:
        coast = self.coast + 1
        v = self.v * rules.damping if coast >= rules.damp_after else self.v
        return replace(self, v=v, coast=rules.lost_after if coast >= rules.longest_coast else coast)


@dataclass(frozen=True)
class Pair:
    my: Track
    op: Track
    w: float
    h: float
    fi: int = -1
    votes: int = 0


def measured(box: np.ndarray) -> np.ndarray:
    return np.concatenate([(box[:2] + box[2:]) / 2, np.maximum(box[2:] - box[:2], 10.0)])


def centre(boxes: np.ndarray) -> np.ndarray:
    return (boxes[..., :2] + boxes[..., 2:]) / 2


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.hypot(*np.moveaxis(centre(a) - centre(b), -1, 0))


def overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    inter = np.prod(np.maximum(np.minimum(a[..., 2:], b[..., 2:]) - np.maximum(a[..., :2], b[..., :2]), 0), -1)
    both = np.prod(a[..., 2:] - a[..., :2], -1) + np.prod(b[..., 2:] - b[..., :2], -1) - inter
    return np.where(both > 0, inter / np.where(both > 0, both, 1), 0.0)


def likeness(look: np.ndarray | None, looks: list[np.ndarray | None]) -> np.ndarray:
    """1 less the Bhattacharyya distance of two histograms; 0 where one is missing."""
    out = np.zeros(len(looks))
    for k, other in enumerate(looks):
        if look is not None and other is not None and look.sum() > 0 and other.sum() > 0:
            out[k] = 1 - np.sqrt(max(0.0, 1 - np.sqrt(look * other).sum() / np.sqrt(look.sum() * other.sum())))
    return out


def tallness(track: Track, pair: Pair, rules: Rules) -> float:
    return track.height or pair.h * rules.default_height


def usual(my: Track, op: Track, pair: Pair, rules: Rules) -> float:
    return my.height or op.height or pair.h * rules.default_height


def near_the_pair(boxes: np.ndarray, pair: Pair, rules: Rules) -> np.ndarray:
    """Which candidates to look at, nearest first: in a crowd only those near a prediction, but two at least."""
    if len(boxes) <= 2 or min(pair.my.coast, pair.op.coast) >= rules.lost_after:
        return np.arange(len(boxes))
    away = np.minimum(apart(boxes, pair.my.box()), apart(boxes, pair.op.box()))
    order = np.argsort(away, kind="stable")
    return order[: max(2, int((away <= usual(pair.my, pair.op, pair, rules) * rules.crowd_reach).sum()))]


def matched(track: Track, boxes: np.ndarray, looks: list, free: np.ndarray, pair: Pair, rules: Rules) -> int | None:
    """The best free candidate within reach that doesn't look or stand like somebody else."""
    if not len(boxes):
        return None
    predicted, tall = track.box(), boxes[:, 3] - boxes[:, 1]
    away, alike = apart(boxes, predicted), likeness(track.look, looks)
    ok = free & (away <= tallness(track, pair, rules) * rules.jump)
    if track.look is not None:
        ok &= (alike >= (rules.looks_floor_settling if track.settling else rules.looks_floor)) | np.array([x is None for x in looks])
    size = np.ones(len(boxes))
    if track.height:
        ok &= tall <= track.height * rules.tallest
        ratio = tall / track.height
        size = np.where(ratio < rules.small[0], np.maximum(rules.small[1], ratio / rules.small[0]), np.where(ratio > rules.large[0], np.maximum(rules.large[1], rules.large[0] / np.maximum(ratio, 1e-9)), 1.0))
    shared = overlap(boxes, predicted)
    place = np.where(shared > 0, shared, np.maximum(0.0, 1 - away / (max(pair.w, pair.h) * rules.far)) * 0.25)
    score = np.where(ok, (rules.place_weight * place + rules.looks_weight * (alike if track.look is not None else 0.5)) * size, 0.0)
    best = int(score.argmax())
    return best if score[best] > rules.least_score else None


def found_again(track: Track, boxes: np.ndarray, looks: list, free: np.ndarray, live: np.ndarray | None, pair: Pair, rules: Rules) -> int | None:
    """The free candidate most like a lost track: near the other fighter if that one is seen, else near the prediction."""
    tall, h = boxes[:, 3] - boxes[:, 1], tallness(track, pair, rules)
    ok = free & (apart(boxes, track.box()) <= h * rules.lost_reach if live is None else np.hypot(*(centre(boxes) - live).T) <= h * rules.live_reach)
    if track.height:
        ok &= np.abs(tall - track.height) / track.height <= rules.lost_height
    for look in (track.look, track.clean):
        alike = np.where(ok, likeness(look, looks), 0.0)
        if alike.max() > rules.lost_likeness:
            return int(alike.argmax())
    return None


def in_clinch(a: np.ndarray, b: np.ndarray, tall: float, rules: Rules) -> bool:
    return bool(overlap(a, b) > rules.clinch_overlap or apart(a, b) < tall * rules.clinch_reach)


def looked_at(pair: Pair, fi: int, cut: bool, boxes: np.ndarray, looks: list, rules: Rules) -> tuple[Pair, list, list]:
    """A frame with detections: the next state, both boxes, and the places of their detections."""
    tracks = [pair.my, pair.op]
    if cut and fi > 0:  # another scene: both are lost, and looks and heights are those of the start
        tracks = [replace(t, coast=rules.lost_after, look=t.clean, height=None, cooldown=0, settling=0) for t in tracks]
        pair = replace(pair, votes=0)
    pair = replace(pair, my=tracks[0], op=tracks[1])
    large = np.flatnonzero(np.prod(boxes[:, 2:] - boxes[:, :2], -1) >= pair.w * pair.h * rules.least_area)
    names = large[near_the_pair(boxes[large], pair, rules)]
    boxes, looks, free = boxes[names], [looks[k] for k in names], np.ones(len(names), bool)
    picks, votes = [], pair.votes
    for track in tracks:
        picks.append(matched(track, boxes, looks, free, pair, rules))
        if picks[-1] is not None:
            free[picks[-1]] = False
    if None not in picks and all(t.look is not None for t in tracks):
        alike = np.array([likeness(t.look, [looks[k] for k in picks]) for t in tracks])
        votes = votes + 1 if np.trace(alike[:, ::-1]) > np.trace(alike) + rules.swap_margin else max(0, votes - 1)
        if votes >= rules.swap_votes:
            picks, votes = picks[::-1], 0
    shown = []
    for k, (track, pick) in enumerate(zip(tracks, picks)):
        if pick is None:
            shown.append(track.box())
            tracks[k] = track.missed(rules)
        else:
            shown.append(boxes[pick])
            tall = float(boxes[pick][3] - boxes[pick][1])
            tracks[k] = replace(track.updated(boxes[pick]), height=tall if track.height is None else rules.keep * track.height + (1 - rules.keep) * tall)
    close = in_clinch(*shown, usual(*tracks, pair, rules), rules)
    for k, (track, pick) in enumerate(zip(tracks, picks)):
        if pick is not None and not close and fi % rules.blend_every == 0 and not track.cooldown and track.look is not None and looks[pick] is not None:
            tracks[k] = replace(track, look=rules.keep * track.look + (1 - rules.keep) * looks[pick])
    live = [None if p is None else centre(s) for p, s in zip(picks, shown)]
    again = [None, None]
    for k, track in enumerate(tracks):
        if picks[k] is None and track.coast >= rules.lost_after and track.look is not None and free.any():
            # the prediction is that of this frame's start: a miss moves no place
            other = live[1 - k] if k == 0 or live[0] is not None or again[0] is None else centre(boxes[again[0]])
            again[k] = found_again(track, boxes, looks, free, other, pair, rules)
    if None not in again and apart(boxes[again[0]], boxes[again[1]]) > tallness(tracks[0], pair, rules) * rules.pair_reach:
        again = [None, None]
    for k, pick in enumerate(again):
        if pick is not None:
            picks[k], shown[k] = pick, boxes[pick]
            tracks[k] = replace(tracks[k].updated(boxes[pick]), cooldown=rules.stride * rules.cooldown)
    return replace(pair, my=tracks[0], op=tracks[1], votes=votes), shown, [None if p is None else int(names[p]) for p in picks]


def advance(pair: Pair, fi: int, cut: bool, boxes: list, looks: list, rules: Rules = RULES) -> tuple[Pair, tuple]:
    """The next state, and the columns of SHOWN."""
    pair = replace(pair, my=pair.my.predicted(), op=pair.op.predicted())
    picks, looked = [None, None], fi % rules.stride == 0
    if looked:
        boxes = np.trunc(np.array(boxes, float).reshape(-1, 4))
        pair, shown, picks = looked_at(pair, fi, cut, boxes, [None if x is None else np.array(x, float) for x in looks], rules)
    else:
        shown = [pair.my.box(), pair.op.box()]
    close = in_clinch(*shown, usual(pair.my, pair.op, pair, rules), rules)
    tick = lambda n: max(0, n - 1)
    tracks = [replace(t, cooldown=tick(t.cooldown), settling=rules.stride * rules.settle if close else tick(t.settling)) for t in (pair.my, pair.op)]
    sure = [max(0.0, 1 - 0.20 * t.coast) * (1.0 if looked else 0.85) for t in tracks]
    steady = [t.coast == 0 and not t.cooldown and not t.settling for t in tracks]
    out = (close, *(s.astype(int).tolist() for s in shown), *picks, *(t.coast for t in tracks), *sure, *steady)
    return replace(pair, my=tracks[0], op=tracks[1], fi=fi), out


def begun(w: float, h: float, my_box: list | None, op_box: list | None, my_look: list | None, op_look: list | None) -> Pair:
    """The state before the first frame: the boxes that were picked, else typical ones in both halves of the frame."""

    def track(box, look, x):
        box = np.array(box, float) if box is not None else np.trunc(np.array([x * w - 0.075 * w, 0.3 * h, x * w + 0.075 * w, 0.7 * h]))
        look = None if look is None else np.array(look, float)
        return Track(measured(box), np.zeros(4), kalman_start(1)[0], look=look, clean=look)

    return Pair(track(my_box, my_look, 0.25), track(op_box, op_look, 0.75), float(w), float(h))


def to_row(pair: Pair) -> tuple:
    """The state as the columns of STATE."""
    numbers = lambda t: [*t.x, *t.v, *t.cov.ravel(), t.coast, t.height or 0.0, t.cooldown, t.settling]
    listed = lambda x: None if x is None else [float(v) for v in x]
    return (pair.fi, pair.w, pair.h, pair.votes, listed(numbers(pair.my)), listed(numbers(pair.op)), listed(pair.my.look), listed(pair.op.look), listed(pair.my.clean), listed(pair.op.clean))


def from_row(row: tuple) -> Pair:
    array = lambda x: None if x is None else np.array(x, float)

    def track(numbers, look, clean):
        n = np.array(numbers, float)
        return Track(n[:4], n[4:8], n[8:20].reshape(4, 3), int(n[20]), n[21] or None, int(n[22]), int(n[23]), array(look), array(clean))

    fi, w, h, votes, my, op, my_look, op_look, my_clean, op_clean = row
    return Pair(track(my, my_look, my_clean), track(op, op_look, op_clean), w, h, int(fi), int(votes))


START = ("w", "h", "my_start", "op_start", "my_look", "op_look")


def track_batch(frames: DataFrame, rules: Rules = RULES) -> DataFrame:
    """(session, fi) and SHOWN. frames: (session, fi, cut, boxes, looks) and START, which the first row of a session tells."""
    kind = frames.schema["session"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, pair = None, None
        names, kinds = zip(*((c.split()[0], ARROW[c.split()[1]]) for c in SHOWN.split(", ")))
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if pair is None or row["session"] != current:
                    current, pair = row["session"], begun(*(row[c] for c in START))
                pair, shown = advance(pair, row["fi"], row["cut"], row["boxes"], row["looks"], rules)
                out.append((row["session"], row["fi"], *shown))
            if out:
                columns = [pa.array(c, k) for c, k in zip(zip(*out), [batch.schema.field("session").type, pa.int32(), *kinds])]
                yield pa.RecordBatch.from_arrays(columns, names=["session", "fi", *names])

    kept = frames.select("session", "fi", "cut", "boxes", "looks", *START)
    return kept.repartition("session").sortWithinPartitions("session", "fi").mapInArrow(run, f"session {kind}, fi int, {SHOWN}")


class TrackProcessor(StatefulProcessor):
    """State of a session across micro-batches; frames that come late, behind one already seen, are left out. A timer
    on event time forgets a session that has been silent for long."""

    def __init__(self, at: str, silence_ms: int, rules: Rules = RULES) -> None:
        self.at, self.silence_ms, self.rules = at, silence_ms, rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("pair", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = pd.concat(list(rows)).sort_values("fi", kind="stable")
        pair = from_row(tuple(self.state.get())) if self.state.exists() else None
        out = []
        for fi, text in zip(held["fi"].tolist(), held["frame"]):
            row = json.loads(text)
            pair = begun(*(row[c] for c in START)) if pair is None else pair
            if fi > pair.fi:
                pair, shown = advance(pair, fi, row["cut"], row["boxes"], row["looks"], self.rules)
                out.append((key[0], fi, *shown))
        self.state.update(to_row(pair))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(int(held[self.at].max().timestamp() * 1000) + self.silence_ms)
        frame = pd.DataFrame(out, columns=["session", "fi", *(c.split()[0] for c in SHOWN.split(", "))])
        yield frame.astype({"my_pick": "Int32", "op_pick": "Int32"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def track_stream(frames: DataFrame, at: str = "ts", lateness: str = "10 seconds", silence_ms: int = 3_600_000, rules: Rules = RULES) -> DataFrame:
    """The same from a stream of frames with their time. A session is forgotten `silence_ms` after its last frame. Needs
    the RocksDB state store (spark.sql.streaming.stateStore.providerClass). Boxes and looks travel as JSON: Arrow's
    nested lists crash the worker of this operator in the Spark version at hand."""
    kind = frames.schema["session"].dataType.simpleString()
    whole = F.to_json(F.struct("cut", "boxes", "looks", *START), {"ignoreNullFields": "false"})
    return frames.withWatermark(at, lateness).select("session", "fi", at, whole.alias("frame")).groupBy("session").transformWithStateInPandas(TrackProcessor(at, silence_ms, rules), f"session {kind}, fi int, {SHOWN}", "append", "eventTime")
