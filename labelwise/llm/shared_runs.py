"""Content-selected anchors in word sequences, shared by the substring operators.

Every window of ``window`` words selects its minimiser, the smallest hash among its ``gram``-word grams.
Consecutive windows of one text with the same minimiser form a run; equal text selects equal runs wherever it is.
"""

from __future__ import annotations

import numpy as np

from .common import SpanHash, sliding_argmin, sliding_min

WINDOW = 50
GRAM = 8
CELL = 8      # at most GRAM: the windows of a cell have words in common
_U = np.uint64


class Runs:
    """The runs of a chunk of texts: ``doc`` (index in the chunk), ``first`` and ``last`` window start (word
    positions inside the text), ``anchor`` (minimiser hash) and ``block`` and ``block2`` (two hashes of all words of the run;
    together 128 bits). ``words``: two rows of independent word hashes."""

    def __init__(self, words: np.ndarray, woff: np.ndarray, window: int = WINDOW, gram: int = GRAM):
        n = words.shape[1]
        span = SpanHash(words[0])
        empty = np.zeros(0, np.int64)
        self.doc, self.first, self.last = empty, empty, empty
        self.anchor = self.block = self.block2 = np.zeros(0, _U)
        if n < window:
            return
        doc = np.repeat(np.arange(len(woff) - 1), np.diff(woff))
        grams = span(np.arange(n - gram + 1), gram)
        least = sliding_min(grams, window - gram + 1)        # of the window starting at each word
        valid = doc[:n - window + 1] == doc[window - 1:]
        at = np.flatnonzero(valid)
        if not len(at):
            return
        low = least[at]
        new = np.ones(len(at), bool)
        new[1:] = (low[1:] != low[:-1]) | (at[1:] != at[:-1] + 1) | (doc[at[1:]] != doc[at[:-1]])
        s = np.flatnonzero(new)
        e = np.append(s[1:], len(at)) - 1
        self.doc, self.anchor = doc[at[s]], low[s]
        self.first, self.last = at[s] - woff[self.doc], at[e] - woff[self.doc]
        size = at[e] - at[s] + window
        self.block, self.block2 = span(at[s], size), SpanHash(words[1], 1)(at[s], size)


class Cells:
    """Windows, given by text (``doc``, ascending) and start in all words (``at``), gathered in cells of up to ``CELL`` neighbours: those whose first
    smallest gram is the same and as far from their start, to a multiple of ``CELL``. ``doc``; ``first`` and ``last`` window start of the
    whole cell as far as its text has it (word positions inside the text); ``core``, where in all words the ``window - CELL + 1`` words begin that all
    its windows have; ``begin``, the number of its first given window (and the count of all at the end)."""

    def __init__(self, span: SpanHash, woff: np.ndarray, doc: np.ndarray, at: np.ndarray, window: int = WINDOW, gram: int = GRAM):
        least = sliding_argmin(span(np.arange(woff[-1] - gram + 1), gram), window - gram + 1)[at]
        core = least - (least - at) // CELL * CELL       # the last window start of the cell
        new = np.ones(len(at), bool)
        new[1:] = (core[1:] != core[:-1]) | (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1])
        s = np.flatnonzero(new)
        self.begin, self.doc, self.core = np.append(s, len(at)), doc[s], core[s]
        self.first = np.maximum(self.core - CELL + 1, woff[self.doc]) - woff[self.doc]
        self.last = np.minimum(self.core, woff[self.doc + 1] - window) - woff[self.doc]
