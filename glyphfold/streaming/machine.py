"""The revision state machine shared by batch replay and the stream.

State: ``None`` (no session) or (revision, pending, exportable).  A command is
(op, expected, valid).  An op other than ``open`` works only on a session whose
revision it expects; that is what lets a block of commands be described by the
few revisions it mentions.
"""

from __future__ import annotations

State = tuple[int, bool, bool] | None

FRESH: State = (0, False, False)


def step(state: State, op: str, expected: int, valid: bool) -> tuple[State, str]:
    if op == "open":
        return FRESH, "OPENED"
    if state is None or state[0] != expected:
        return state, "STALE_REVISION"
    revision, pending, exportable = state
    if op == "preview":
        return state, "PREVIEWED"
    if op == "apply":
        return (revision, True, exportable), "STAGED"
    if op == "validate":
        if not pending:
            return state, "STALE_REVISION"
        if valid:
            return (revision + 1, False, True), "VALIDATED"
        return (revision, False, exportable), "VALIDATION_FAILURE"
    if op == "export":
        if exportable:
            return (revision, pending, False), "EXPORTED"
        return state, "VALIDATION_FAILURE"
    if op == "close":
        return None, "CLOSED"
    return state, "UNKNOWN_COMMAND"


Described = tuple[dict[State, State], State | str]


def describe(commands: list[tuple[str, int, bool]]) -> Described:
    """What a block does to any state: exceptions and the rule for the rest.

    Built from the last command backwards: a command only changes the fate of
    the four states at the revision it expects, and an ``open`` gives all
    states one fate.  The rest is ``"same"`` or the fate itself.
    """
    fate: dict[State, State] = {}
    rest: State | str = "same"

    def end_of(state: State) -> State:
        if state in fate:
            return fate[state]
        return state if rest == "same" else rest

    for op, expected, valid in reversed(commands):
        if op == "open":
            target = end_of(FRESH)
            fate, rest = {}, target
            continue
        four = [(expected, p, x) for p in (False, True) for x in (False, True)]
        ends = [end_of(step(s, op, expected, valid)[0]) for s in four]
        fate.update(zip(four, ends))
    return fate, rest


def run_block(described: Described, state: State) -> State:
    fate, rest = described
    if state in fate:
        return fate[state]
    return state if rest == "same" else rest
