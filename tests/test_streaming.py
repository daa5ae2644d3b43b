"""Runs from progress events: the fold itself, and the same result whatever the order of arrival."""

import random

import pandas as pd

from folioworks.streaming import jobs

S = 1_000_000


def test_runs_end_by_their_end_a_new_beginning_or_idleness():
    fold = lambda *events: jobs.fold_run([(at * S, i, kind) for i, (at, kind) in enumerate(events)], None, 100 * S)
    # two runs inside one gap are two runs
    assert fold((0, "pipeline_start"), (1, "step_done"), (2, "pipeline_done"), (3, "pipeline_start"), (4, "step_failed"), (5, "pipeline_done")) == ([(0, 2 * S, 1, 0, "done"), (3 * S, 5 * S, 1, 1, "done")], None)
    assert fold((0, "step_done"), (1, "pipeline_start")) == ([(0, 0, 1, 0, "restarted")], (S, S, 0, 0))
    assert fold((0, "step_done"), (100, "step_done")) == ([(0, 0, 1, 0, "idle")], (100 * S, 100 * S, 1, 0))
    assert fold((0, "step_done"), (99, "step_done")) == ([], (0, 99 * S, 2, 0))
    # an end that comes after its run went idle is a run without steps
    assert fold((0, "step_done"), (300, "pipeline_done")) == ([(0, 0, 1, 0, "idle"), (300 * S, 300 * S, 0, 0, "done")], None)
    assert fold() == ([], None)


class State:
    """What the job uses of Spark's state of a group."""

    def __init__(self):
        self.value, self.mark, self.due, self.hasTimedOut = None, 0, None, False

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = self.due = None

    def getCurrentWatermarkMs(self):
        return self.mark

    def setTimeoutTimestamp(self, at):
        assert at > self.mark
        self.due = at


def test_order_of_arrival_does_not_matter():
    """Events within the delay arrive in any order and in any batches; timers close what is idle."""
    rng = random.Random(4)
    for _ in range(40):
        kinds = ["pipeline_start", "pipeline_done", "step_done", "step_done", "step_failed"]
        at, events = 1000, []
        for i in range(30):
            at += rng.choice([0, 1, 5, 40, 150])
            events.append((at, i, rng.choice(kinds)))
        want, left = jobs.fold_run([(a * S, i, k) for a, i, k in events], None, 100 * S)
        want += [(*left, "idle")] if left else []
        # each event arrives up to twenty seconds after its time
        arriving = sorted(events, key=lambda e: e[0] + rng.random() * 20)
        state, got, run = State(), [], jobs._run_steps(100 * S)

        def feed(rows, state=state, got=got, run=run):
            pdf = pd.DataFrame({"ts": pd.to_datetime([r[0] for r in rows], unit="s"), "event_id": [r[1] for r in rows], "kind": [r[2] for r in rows]})
            for out in run((7,), iter([pdf]), state):
                got += [tuple(r) for r in out.itertuples(index=False)]

        def timer(state=state, got=got, run=run):
            while state.exists and state.due is not None and state.due <= state.mark:
                state.hasTimedOut, state.due = True, None
                for out in run((7,), iter(()), state):
                    got += [tuple(r) for r in out.itertuples(index=False)]
                state.hasTimedOut = False

        newest = 0
        while arriving:
            batch, arriving = arriving[: (n := rng.randrange(1, 6))], arriving[n:]
            feed(batch)
            newest = max([newest, *(r[0] for r in batch)])
            state.mark = max(state.mark, (newest - 20) * 1000)
            timer()
        state.mark = (at + 1000) * 1000
        timer()
        told = [(int(a.value // 1000), int(b.value // 1000), s, f, e) for _, a, b, s, f, e in got]
        assert sorted(told) == sorted(want) and not state.exists
