"""Draws with replacement as `functions.stats.draw` makes them, for all rows of a replicate at a time.

The md5 of `seed|replicate|row` is computed over whole arrays of rows that differ in their last digits. A replicate is then a count
of how often each row is drawn, and its sums are the counters, read in order from a folder, times these counts. So nothing is joined, shuffled or broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

#: Digits of the row number that differ within an array, and numbers in one: few enough for the processor's cache, enough to outweigh the calls.
TAIL, AT_ONCE = 5, 20_000
#: Counts of rows that a task holds at a time for several replicates, and for a single one; beyond, the draws are made anew for each such window of rows.
ROOM, WINDOW = 1 << 25, 1 << 27
#: Rows of counters multiplied at a time.
BATCH = 1 << 15

SINES = [int(abs(math.sin(k + 1)) * 2**32) for k in range(64)]
SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


@cache
def _tails(digits: int, at: int) -> list[np.ndarray]:
    """0, 1, ... in so many digits and the byte that ends a message, from byte `at` of a word on, by words."""
    number = np.arange(10**digits)
    out = np.zeros((len(number), 12), np.uint8)
    for k in range(digits):
        out[:, at + k] = number // 10 ** (digits - 1 - k) % 10 + ord("0")
    out[:, at + digits] = 0x80
    return [x.copy() for x in out.view("<u4").T[: (at + digits) // 4 + 1]]


def _first_word(words: list[int | np.ndarray], size: int) -> np.ndarray:
    """The first 32 bits of the md5 of messages of one block, whose words are the same for all or an array. The last three rounds do not change them."""
    a, b, c, d = START
    same = next(k for k, word in enumerate(words) if not isinstance(word, int))
    for k in range(same):
        x = (a + (d ^ (b & (c ^ d))) + words[k] + SINES[k]) & 0xFFFFFFFF
        by = SHIFTS[0][k % 4]
        a, b, c, d = d, (b + (x << by | x >> 32 - by)) & 0xFFFFFFFF, b, c
    a, b, c, d = (np.full(size, x, np.uint32) for x in (a, b, c, d))
    x, y = np.empty(size, np.uint32), np.empty(size, np.uint32)
    for k in range(same, 61):
        turn = k // 16
        if turn < 2:
            p, q, r = (b, c, d) if turn == 0 else (d, b, c)
            np.bitwise_xor(q, r, out=x)
            x &= p
            x ^= r
        elif turn == 2:
            np.bitwise_xor(b, c, out=x)
            x ^= d
        else:
            np.invert(d, out=x)
            x |= b
            x ^= c
        x += a
        word = words[(k, 5 * k + 1, 3 * k + 5, 7 * k)[turn] % 16]
        if isinstance(word, int):
            x += np.uint32((SINES[k] + word) & 0xFFFFFFFF)
        else:
            x += word
            x += np.uint32(SINES[k])
        by = SHIFTS[turn][k % 4]
        np.left_shift(x, np.uint32(by), out=y)
        x >>= np.uint32(32 - by)
        x |= y
        x += b
        a, b, c, d, x = d, x, b, c, a
    b += np.uint32(START[0])
    return b.byteswap()


def draws(seed: int, rep: int, n: int) -> Iterator[np.ndarray]:
    """draw(seed, rep, k) of k = 0, ..., n - 1, in arrays one after the other."""
    at = 0
    while at < n:
        number = str(at)
        digits = min(len(number), TAIL)
        first = at % 10**digits
        end = min(n, at - first + 10**digits, at + AT_ONCE)
        head = f"{seed}|{rep}|{number[: len(number) - digits]}".encode()
        if len(head) + digits > 55:
            raise ValueError("seed, replicate and row number are too long for one block of md5")
        whole, rest = divmod(len(head), 4)
        words: list[int | np.ndarray] = [0] * 16
        for k in range(whole):
            words[k] = int.from_bytes(head[4 * k : 4 * k + 4], "little")
        for k, x in enumerate(_tails(digits, rest), whole):
            words[k] = x[first : first + end - at]
        words[whole] = words[whole] | np.uint32(int.from_bytes(head[4 * whole :], "little"))
        words[14] = 8 * (len(head) + digits)
        yield _first_word(words, end - at)
        at = end


def times_drawn(seed: int, rep: int, n: int, lo: int, out: np.ndarray) -> None:
    """Adds to `out` how often each of the rows from `lo` on is drawn in the replicate."""
    for h in draws(seed, rep, n):
        i = (h % np.uint32(n) if n < 1 << 32 else h).astype(np.int64)
        np.add.at(out, i if len(out) == n else i[(i >= lo) & (i < lo + len(out))] - lo, out.dtype.type(1))  # a one of another type takes thirty times as long


def sums_with(path: str, n: int, seed: int, sums: list[str]):
    def replicates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of (rep): (rep, *sums) of the n rows (i, *sums) in a folder. A sum over nulls alone is null."""
        import pyarrow.dataset as ds
        from pyarrow import fs

        files, folder = fs.FileSystem.from_uri(path)
        source = ds.dataset(folder, filesystem=files, format="parquet")
        for batch in batches:
            for at in range(0, len(batch), max(1, ROOM // n)):
                reps = batch["rep"].slice(at, max(1, ROOM // n))
                total, nulls = {c: 0 for c in sums}, {c: np.zeros(len(reps), np.int64) for c in sums}
                for lo in range(0, n, WINDOW):
                    times = np.zeros((len(reps), min(WINDOW, n - lo)), np.uint16)
                    for rep, row in zip(reps.to_pylist(), times):
                        times_drawn(seed, rep, n, lo, row)
                    inside = (ds.field("i") >= lo) & (ds.field("i") < lo + times.shape[1])
                    for part in source.to_batches(filter=inside, batch_size=BATCH, batch_readahead=1, fragment_readahead=1):
                        i = part["i"].to_numpy() - lo
                        in_order = len(i) > 0 and (np.diff(i) == 1).all()
                        drawn = times[:, i[0] : i[-1] + 1] if in_order else times[:, i]
                        weights = {kind: drawn.astype(kind) for kind in {part[c].type.to_pandas_dtype() for c in sums}}
                        for c in sums:
                            if part[c].null_count:
                                nulls[c] += drawn[:, part[c].is_null().to_numpy(zero_copy_only=False)].sum(1, np.int64)
                            total[c] = total[c] + weights[part[c].type.to_pandas_dtype()] @ part[c].fill_null(0).to_numpy()
                yield pa.record_batch({"rep": reps} | {c: pa.array(total[c], mask=nulls[c] == n) for c in sums})

    return replicates
