"""Faults of conversation turns, and the cheapest edits that give a conversation a legal order of roles.

Edits read a conversation from its first turn: keep (K), set the role (R), delete (D), insert an empty turn (I). The
roles that remain must be nothing, or user and assistant in turn, after one system turn at most. A node of the edit graph
is a place before a turn together with the role that the last remaining turn had.

Costs first: a turn is a 4 x 4 table of costs from role to role, tables join by (min, +), and doubling joins those of
all turns behind each place, so long conversations take a logarithmic number of steps. Arcs on which the cost to the end
drops by just their own cost are optimal. Then ranks: the arcs of a node are first ranked by their letter, later by the
2, 4, 8, ... letters of the audits that they begin; an arc that is not the least of its node goes, the rest are joined
end to end. In the end the ranks order whole audits, and the path is read off by the doubled pointers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

LETTERS = b"DIKR"
#: Roles behind a place: none yet, system, user, assistant; the two that may be written, by the role before them.
NONE, SYSTEM, USER, ASSISTANT = range(4)
_WRITTEN = np.array([USER, USER, ASSISTANT, USER])
_FAR = 1 << 40
#: Turns that are worked on at once; a longer conversation is taken in blocks.
BLOCK = 65_536
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3


def _closure(rewrite: int) -> np.ndarray:
    """Cost from role to role by inserts alone: two at most, since three end where one does."""
    cost = np.where(np.eye(4, dtype=bool), 0, _FAR)
    for role in range(4):
        first = _WRITTEN[role]
        cost[role, first] = min(cost[role, first], rewrite)
        cost[role, _WRITTEN[first]] = min(cost[role, _WRITTEN[first]], 2 * rewrite)
    return cost


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of stacked cost tables under (min, +)."""
    out = a[:, :, 0, None] + b[:, None, 0, :]
    for k in range(1, 4):
        np.minimum(out, a[:, :, k, None] + b[:, None, k, :], out=out)
    return out


def _steps(role: np.ndarray, fault: np.ndarray, costs: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each turn and role before it: cost and next role of K, and of R (no way: a cost out of reach)."""
    rewrite, _, late = costs
    n = len(role)
    extra = np.where(fault == TRUNCATED, late, 0)
    free = (fault[:, None] == 0) | (fault[:, None] == TRUNCATED)
    legal = np.zeros((n, 4), bool)
    legal[:, NONE] = (role == SYSTEM) | (role == USER)
    legal[:, SYSTEM] = role == USER
    legal[:, USER] = role == ASSISTANT
    legal[:, ASSISTANT] = role == USER
    keep = np.where(free & legal, extra[:, None], _FAR)
    change = np.where(free, rewrite + extra[:, None], _FAR) + np.zeros((n, 4), np.int64)
    return keep, np.broadcast_to(role[:, None], (n, 4)), change, np.broadcast_to(_WRITTEN, (n, 4))


def _cost_to_end(role: np.ndarray, fault: np.ndarray, conv: np.ndarray, last: np.ndarray, costs: tuple[int, int, int]) -> np.ndarray:
    """Least cost from each place and role, (turns + conversations, 4): the places of a conversation, then its end."""
    rewrite, drop, _ = costs
    keep, kept, change, changed = _steps(role, fault, costs)
    table = np.full((len(role), 4, 4), _FAR, np.int64)
    at = np.arange(4)
    table[:, at, at] = drop
    for cost, to in ((keep, kept), (change, changed)):
        for s in range(4):
            row = np.arange(len(role))
            legal = cost[:, s] < _FAR
            table[row[legal], s, to[legal, s]] = np.minimum(table[row[legal], s, to[legal, s]], cost[legal, s])
    table = _join(np.broadcast_to(_closure(rewrite), table.shape), table)
    span, total = 1, table
    while span < len(role):  # doubling: a table covers `span` turns from its own on, or all that its conversation has left
        whole = np.zeros(len(role), bool)
        whole[: len(role) - span] = conv[: len(role) - span] == conv[span:]
        more = np.flatnonzero(whole)
        if not len(more):
            break
        total = total.copy()
        total[more] = np.minimum(_join(total[more], total[more + span]), 2 * _FAR)
        span *= 2
    return np.minimum((total + last[conv][:, None, :]).min(axis=2), _FAR)


def _place(conv: np.ndarray, convs: int) -> tuple[np.ndarray, np.ndarray]:
    """Place number of each turn and of each conversation's end, places of a conversation side by side."""
    sizes = np.bincount(conv, minlength=convs)
    ends = np.cumsum(sizes + 1) - 1
    return np.arange(len(conv)) + conv, ends


def _arcs(role: np.ndarray, fault: np.ndarray, conv: np.ndarray, last: np.ndarray, to_end: np.ndarray, trailing: bool, costs: tuple[int, int, int]) -> tuple[np.ndarray, ...]:
    """Optimal arcs (from node, letter, to node); a node is 4 * place + role."""
    rewrite, drop, _ = costs
    place, ends = _place(conv, len(last))
    value = np.empty((len(role) + len(last), 4), np.int64)
    value[place], value[ends] = to_end, last
    keep, kept, change, changed = _steps(role, fault, costs)
    state = np.broadcast_to(np.arange(4), (len(role), 4))
    here = place[:, None] * 4 + state
    found = []
    for letter, cost, to in ((0, np.full((len(role), 4), drop), state), (2, keep, kept), (3, change, changed)):
        target = (place[:, None] + 1) * 4 + to
        good = (cost < _FAR) & (value.reshape(-1)[target] < _FAR) & (value[place] == cost + value.reshape(-1)[target])
        found.append((here[good], np.full(int(good.sum()), letter), target[good]))
    places = np.arange(len(value)) if trailing else place
    here, target = places[:, None] * 4 + np.arange(4), places[:, None] * 4 + _WRITTEN
    good = (value[places] < _FAR) & (value[places] == rewrite + value.reshape(-1)[target])
    found.append((here[good], np.ones(int(good.sum()), np.int64), target[good]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def least_paths(source: np.ndarray, letter: np.ndarray, target: np.ndarray, nodes: int, starts: np.ndarray) -> list[np.ndarray]:
    """The letters of the least path from each start, by doubling; a path ends where no arc leaves.

    Of all paths that follow the arcs, the least is that whose letters come first in order, a shorter one before those
    that go on from it. The graph has no cycles.
    """
    rank = letter + 1  # 0 stands for the end
    stop = np.ones(nodes, bool)
    stop[source] = False
    idle = np.flatnonzero(stop)
    source, target, rank = np.concatenate((source, idle)), np.concatenate((target, idle)), np.concatenate((rank, np.zeros(len(idle), np.int64)))
    levels = []
    while True:
        order = np.lexsort((target, rank, source))
        source, target, rank = source[order], target[order], rank[order]
        best = np.full(nodes, np.iinfo(np.int64).max)
        np.minimum.at(best, source, rank)
        fresh = np.ones(len(source), bool)
        fresh[1:] = (source[1:] != source[:-1]) | (target[1:] != target[:-1])
        least = (rank == best[source]) & fresh
        source, target, rank = source[least], target[least], rank[least]
        levels.append((source, target, rank))
        if stop[target].all():
            break
        begin = np.searchsorted(source, target)
        count = np.searchsorted(source, target, "right") - begin
        first = np.repeat(np.arange(len(source)), count)
        second = np.repeat(begin, count) + np.arange(len(first)) - np.repeat(np.cumsum(count) - count, count)
        _, joined = np.unique(rank[first] * (int(rank.max()) + 1) + rank[second], return_inverse=True)
        source, target, rank = source[first], target[second], joined.astype(np.int64)
    whole = np.zeros(nodes, np.int64)
    whole[levels[-1][0]] = levels[-1][2]
    nodes_of, owner = starts.copy(), np.arange(len(starts))
    for n, (source, target, _) in enumerate(reversed(levels)):
        if n == 0:
            continue  # the last level reaches the end in one step
        order = np.lexsort((whole[target], source))
        source, target = source[order], target[order]
        following = target[np.searchsorted(source, nodes_of)]
        keep = ~stop[following]
        both = np.stack((nodes_of, following), 1).reshape(-1)
        kept = np.stack((np.ones(len(keep), bool), keep), 1).reshape(-1)
        nodes_of, owner = both[kept], np.repeat(owner, 2)[kept]
    live = ~stop[nodes_of]
    source, _, rank = levels[0]
    path = rank[np.searchsorted(source, nodes_of[live])] - 1
    cuts = np.searchsorted(owner[live], np.arange(1, len(starts)))
    return np.split(path, cuts)


def cheapest_edits(role: np.ndarray, fault: np.ndarray, conv: np.ndarray, convs: int, costs: tuple[int, int, int] = (2, 3, 1)) -> tuple[np.ndarray, list[bytes]]:
    """Cost and audit of every conversation: the cheapest edits, of these the first in ASCII order.

    `role` (NONE: any other) and `fault` (0: none) of the turns in order, conversations 0 to convs - 1 one after the
    other; costs of setting a role or inserting, of deleting, and of a truncated turn that stays.
    """
    rewrite = costs[0]
    accept = np.array([0, 2 * rewrite, rewrite, 0])
    total, audits = np.zeros(convs, np.int64), [b""] * convs
    sizes = np.bincount(conv, minlength=convs)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    long_ones = np.flatnonzero(sizes > BLOCK)
    edges = np.unique(np.concatenate(([0, convs], long_ones, long_ones + 1)))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if sizes[a] > BLOCK:
            total[a], audits[a] = _in_blocks(role[bounds[a] : bounds[a + 1]], fault[bounds[a] : bounds[a + 1]], accept, costs)
            continue
        while a < b:
            stop = min(b, max(a + 1, int(np.searchsorted(bounds, bounds[a] + BLOCK, "right")) - 1))
            part = slice(bounds[a], bounds[stop])
            letters, first = _solve(role[part], fault[part], conv[part] - a, np.tile(accept, (stop - a, 1)), np.zeros(stop - a, np.int64), True, costs)
            total[a:stop], audits[a:stop] = first[:, NONE], letters
            a = stop
    return total, audits


def _solve(role: np.ndarray, fault: np.ndarray, conv: np.ndarray, last: np.ndarray, start: np.ndarray, trailing: bool, costs: tuple[int, int, int]) -> tuple[list[bytes], np.ndarray]:
    """Audits from the given roles on, and the costs from the first place of each conversation; `last`: those behind it."""
    to_end = _cost_to_end(role, fault, conv, last, costs)
    place, ends = _place(conv, len(last))
    begins = np.concatenate(([0], ends[:-1] + 1))
    value = np.empty((len(role) + len(last), 4), np.int64)
    value[place], value[ends] = to_end, last
    arcs = _arcs(role, fault, conv, last, to_end, trailing, costs)
    paths = least_paths(*arcs, len(value) * 4, begins * 4 + start)
    names = np.frombuffer(LETTERS, np.uint8)
    return [names[p].tobytes() for p in paths], value[begins]


def _in_blocks(role: np.ndarray, fault: np.ndarray, accept: np.ndarray, costs: tuple[int, int, int]) -> tuple[int, bytes]:
    """One long conversation: costs from its last block back, then audits from its first block on."""
    cuts = list(range(0, len(role), BLOCK))
    after = [accept]
    for a in reversed(cuts):
        part = slice(a, a + BLOCK)
        one = np.zeros(len(role[part]), np.int64)
        after.append(_cost_to_end(role[part], fault[part], one, after[-1][None, :], costs)[0])
    after.reverse()
    state, audit = NONE, []
    for n, a in enumerate(cuts):
        part = slice(a, a + BLOCK)
        one = np.zeros(len(role[part]), np.int64)
        letters, _ = _solve(role[part], fault[part], one, after[n + 1][None, :], np.array([state]), n + 1 == len(cuts), costs)
        audit.append(letters[0])
        for _, state in replay(letters[0], role[part].tolist(), state):  # noqa: B007
            pass
    return int(after[0][NONE]), b"".join(audit)


def replay(letters: bytes, roles: list[int], state: int = NONE) -> Iterator[tuple[int, int]]:
    """For each letter: the number of the turn that it uses (-1: an insert) and the role behind it."""
    turn = 0
    for letter in letters:
        if letter in b"IR":
            state = int(_WRITTEN[state])
        elif letter in b"K":
            state = roles[turn]
        if letter in b"I":
            yield -1, state
        else:
            yield turn, state
            turn += 1
