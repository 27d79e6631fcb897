"""Forward, backward and Viterbi recursions over many chunks at once.

The rows of all chunks lie behind each other; ``starts`` and ``lengths`` say where.
Each step moves every chunk that is long enough by one row, in one numpy
call, so the Python loop is as long as the longest chunk, not as all of them.
Rows that lie in the order of the steps are sliced instead of gathered; matrices
of rows x states are fastest when each state's column is contiguous.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

TINY = 1e-300


@dataclass(frozen=True)
class Chunks:
    """Chunks by falling length; ``place`` is where each stood in the input, ``counts`` how many chunks have each step.

    ``edges``: where each step begins, when the rows lie in the order of the steps (``rows_by_step``).
    """

    starts: np.ndarray
    lengths: np.ndarray
    place: np.ndarray
    counts: np.ndarray
    edges: np.ndarray | None = None

    @classmethod
    def of(cls, lengths: np.ndarray) -> Chunks:
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        place = np.argsort(-lengths, kind="stable")
        return cls(starts[place], lengths[place], place, cls._counts(lengths[place]))

    @classmethod
    def by_step(cls, lengths: np.ndarray) -> Chunks:
        """Chunks by falling length whose rows lie in the order of the steps."""
        counts = cls._counts(lengths)
        place = np.arange(len(lengths))
        return cls(place, lengths, place, counts, np.cumsum(counts) - counts)

    @staticmethod
    def _counts(lengths: np.ndarray) -> np.ndarray:
        return np.searchsorted(-lengths, -np.arange(int(lengths[0])), side="left")

    def at(self, t: int, low: int, high: int) -> np.ndarray | slice:
        """Rows of step ``t`` of the chunks from ``low`` to ``high``."""
        if self.edges is None:
            return self.starts[low:high] + t
        return slice(self.edges[t] + low, self.edges[t] + high)

    def rows_by_step(self) -> np.ndarray:
        """Positions of the rows in the order of the steps."""
        return np.concatenate([self.starts[:n] + t for t, n in enumerate(self.counts)])

    def previous(self) -> np.ndarray:
        """The row before each row from the second step on, for rows in the order of the steps."""
        return np.arange(self.counts[0], self.counts.sum()) - np.repeat(self.counts[:-1], self.counts[1:])


def _scaled(columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    total = columns.sum(axis=0) + TINY
    return columns / total, total


def forward(c: Chunks, b: np.ndarray, move: np.ndarray, first: np.ndarray, ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward messages and their scales; ``ahead``: message before the chunk, the start distribution where ``first``."""
    b, ahead, step = b.T, ahead.T, np.ascontiguousarray(move.T)
    alpha, norm = np.empty(b.shape), np.empty(b.shape[1])
    for t, n in enumerate(c.counts):
        at = c.at(t, 0, n)
        came = step @ alpha[:, c.at(t - 1, 0, n)] if t else np.where(first, ahead, step @ ahead)
        alpha[:, at], norm[at] = _scaled(came * b[:, at])
    return alpha.T, norm


def backward(c: Chunks, b: np.ndarray, move: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """Scaled backward messages; ``behind``: the one at the chunk's last row."""
    b, behind = b.T, behind.T
    beta = np.empty(b.shape)
    after = 0
    for t in range(len(c.counts) - 1, -1, -1):
        n = c.counts[t]
        beta[:, c.at(t, after, n)] = _scaled(behind[:, after:n])[0]
        if after:
            nxt = c.at(t + 1, 0, after)
            beta[:, c.at(t, 0, after)] = _scaled(move @ (b[:, nxt] * beta[:, nxt]))[0]
        after = n
    return beta.T


def transfers(c: Chunks, b: np.ndarray, move: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Normalised product of the steps through each chunk: chunks x states x states."""
    b, step = b.T, np.ascontiguousarray(move.T)
    out = np.empty((len(b), len(b), len(c.starts)))
    for t, n in enumerate(c.counts):
        # one matrix of states x chunks for each state before the chunk
        came = step @ out[:, :, :n] if t else np.where(first, np.eye(len(b))[:, :, None], move[:, :, None])
        came = came * b[:, c.at(t, 0, n)]
        out[:, :, :n] = came / (came.sum(axis=(0, 1)) + TINY)
    return out.transpose(2, 0, 1)


def best_transfers(c: Chunks, log_b: np.ndarray, log_move: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Best log score from the state before each chunk to the state at its end."""
    s = log_b.shape[1]
    out = np.where(first[:, None, None], np.where(np.eye(s, dtype=bool), 0.0, -np.inf), log_move) + log_b[c.starts][:, None, :]
    for t, n in enumerate(c.counts):
        if t:
            out[:n] = (out[:n, :, :, None] + log_move).max(axis=2) + log_b[c.at(t, 0, n)][:, None, :]
    return out


def best_paths(c: Chunks, log_b: np.ndarray, log_move: np.ndarray, first: np.ndarray, before: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Viterbi paths; ``before``: log scores ahead of each chunk, ``last``: its final state, -1 where free."""
    came, score = np.zeros(log_b.shape, np.int32), np.empty((len(c.starts), log_b.shape[1]))
    for t, n in enumerate(c.counts):
        at = c.at(t, 0, n)
        options = score[:n, :, None] + log_move if t else None
        if t:
            came[at] = options.argmax(axis=1)
            score[:n] = options.max(axis=1) + log_b[at]
        else:
            score[:] = np.where(first[:, None], before, (before[:, :, None] + log_move).max(axis=1)) + log_b[at]
    path = np.empty(len(log_b), np.int32)
    state = np.where(last < 0, score.argmax(axis=1), last)
    for t in range(len(c.counts) - 1, -1, -1):
        n = c.counts[t]
        at = c.at(t, 0, n)
        path[at] = state[:n]
        if t:
            state[:n] = came[at, state[:n]]
    return path
