"""Texts cut into units by Arrow kernels, and a bounded memory of what each unit gave."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: bytes of text that are cut at once
SLICE = 4 << 20
BLANK = b" \t\n\v\f\r"


class Recent:
    """For every unit a list of numbers and some figures, kept in arrays.

    What it holds is limited in bytes; beyond the limit only the units of the last call stay, so
    memory is the limit and one call's units at most, whatever the texts hold.
    """

    def __init__(self, compute: Callable[[list[str]], tuple[list[bytes], np.ndarray]], limit: int = 32 << 20, figures: int = 0):
        self.compute, self.limit = compute, limit
        self.keys = pa.array([], pa.string())
        self.values = np.empty(0, np.uint32)
        self.starts = np.zeros(1, np.int64)
        self.figures = np.empty((0, figures))

    def rows(self, units: pa.Array) -> np.ndarray:
        """Row of every one of the different ``units``; what is missing is computed."""
        at = pc.index_in(units, value_set=self.keys)
        lost = pc.is_null(at).to_numpy(zero_copy_only=False)
        at = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        if lost.any():
            if self.nbytes > self.limit:
                kept = at[~lost]
                self.keys = self.keys.take(pa.array(kept))
                self.values, self.starts = gather(self.values, self.starts, kept)
                self.figures = self.figures[kept]
                at[~lost] = np.arange(len(kept))
            new = units.filter(pa.array(lost))
            at[lost] = len(self.keys) + np.arange(len(new))
            lists, figures = self.compute(new.to_pylist())
            self.keys = pa.concat_arrays([self.keys, new])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum([len(x) // 4 for x in lists], dtype=np.int64)])
            self.values = np.concatenate([self.values, np.frombuffer(b"".join(lists), "<u4")])
            self.figures = np.concatenate([self.figures, figures])
        return at

    @property
    def nbytes(self) -> int:
        return self.keys.nbytes + self.values.nbytes + self.starts.nbytes + self.figures.nbytes


def gather(values: np.ndarray, starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists of ``rows`` one after the other, and where each begins (and the last ends)."""
    sizes = starts[rows + 1] - starts[rows]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return values[np.repeat(starts[rows] - ends[:-1], sizes) + np.arange(ends[-1])], ends


def slices(texts: pa.Array, limit: int = SLICE) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """``texts`` in runs of about ``limit`` bytes: (texts, how many of them make each text of the run).

    A longer text is a run of its own, cut behind blanks into parts of about the limit; a part without a
    blank stays whole. Null counts as empty.
    """
    texts = texts.fill_null("")
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    begin = held = 0
    for i, size in enumerate(sizes.tolist()):
        if i > begin and held + size > limit:
            yield texts[begin:i], np.ones(i - begin, np.int64)
            begin, held = i, 0
        if size > limit:
            raw, parts, at = texts[i].as_buffer().to_pybytes(), [], 0
            while at < size:
                end = at + limit
                while end < size and raw[end] not in BLANK:
                    end += 1
                parts.append(raw[at:end].decode())
                at = end
            yield pa.array(parts, pa.string()), np.array([len(parts)])
            begin = i + 1
        else:
            held += size
    if begin < len(texts):
        yield texts[begin:], np.ones(len(texts) - begin, np.int64)


def per_text(sizes: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Sums of the parts' sizes for every text."""
    ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(groups)])]
    return np.diff(ends)


def release() -> None:
    """Between tasks: gives back what Arrow and the C library hold but don't use, as idle workers stay alive."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)
