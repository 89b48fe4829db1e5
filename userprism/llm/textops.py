"""Words and hashes of many texts at once, on the UTF-8 bytes of an Arrow column.

Everything here runs inside Spark tasks on one bounded batch and is vectorised with numpy. A
word is a maximal run of bytes that are no separator; bytes of 0x80 and up never separate, so
multi-byte characters stay whole.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from . import caches

SPACES = bytes([0x20, *range(0x09, 0x0E)])
BATCH_BYTES = 2 * 1024 * 1024
# Text hashed at once: some ten arrays of 8 bytes for each byte of it.
HASH_BYTES = 512 * 1024

_RANDOM = np.random.Generator(np.random.PCG64(20240607))
_BYTE_VALUES = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_LEFT, _RIGHT = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers = {}


def mix(x):
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(base, n):
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, kept between batches."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def as_array(column):
    """One contiguous Arrow array without nulls, as text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.fill_null("")


def text_bytes(column):
    """Bytes of all texts in a row, and where each starts (one more entry for the end)."""
    column = as_array(column).cast(pa.large_binary())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch, text="text", limit=BATCH_BYTES):
    """The batch in consecutive parts of about ``limit`` text bytes; one row at least each."""
    column = batch.column(text) if isinstance(batch, pa.RecordBatch) else batch.column(text)
    _, offsets = text_bytes(column)
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def separator_table(separators=SPACES):
    table = np.zeros(256, bool)
    table[np.frombuffer(bytes(separators), np.uint8)] = True
    return table


@dataclass
class Words:
    """Words of a batch: byte ranges, hashes, and the first word of each text."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # len(texts) + 1

    @property
    def counts(self):
        return np.diff(self.first)


def lower_ascii(data):
    upper = (data >= 65) & (data <= 90)
    return np.where(upper, data + np.uint8(32), data)


def words(column, separators=SPACES, lower=False):
    """Split and hash every text; equal words have equal hashes.

    Long columns are hashed in parts of about ``HASH_BYTES``, cut between texts.
    """
    caches.release()
    data, offsets = text_bytes(column)
    if lower:
        data = lower_ascii(data)
    table = separator_table(separators)
    if len(data) <= HASH_BYTES:
        return words_of(data, offsets, table)
    parts, at, seen = [], 0, 0
    while at < len(offsets) - 1:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + HASH_BYTES, side="right")) - 1)
        found = words_of(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at], table)
        first = found.first[: end - at] + seen
        parts.append((found.start + offsets[at], found.end + offsets[at], found.hash, first))
        seen += len(found.start)
        at = end
    start, stop, hashes, first = (np.concatenate(c) for c in zip(*parts))
    return Words(start, stop, hashes, np.append(first, seen))


def words_of(data, offsets, table):
    n = len(data)
    inside = ~table[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True  # a text starts here
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    first = np.searchsorted(start, offsets)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * _power(_BASE, n), out=total[1:])
    value = (total[end] - total[start]) * _power(_BASE_INVERSE, n)[start] if n else total[:0]
    return Words(start, end, mix(value + (end - start).astype(np.uint64) * _RIGHT), first)


def runs(hashes, width):
    """Hash of every ``width`` consecutive hashes, in order; shorter by ``width - 1``."""
    out, covered, power, span = None, 0, hashes, 1
    while True:
        if width & span:
            if out is None:
                out = power
            else:
                size = len(hashes) - covered - span + 1
                if size <= 0:
                    return np.zeros(0, np.uint64)
                out = mix(out[:size] * _LEFT + power[covered : covered + size] * _RIGHT + np.uint64(span))
            covered += span
        if covered == width:
            return out
        size = len(power) - span
        if size <= 0:
            return np.zeros(0, np.uint64)
        power = mix(power[:size] * _LEFT + power[span : span + size] * _RIGHT + np.uint64(span))
        span *= 2


def shingles(found, width):
    """(hash, text number) of every shingle; a shorter text that has words gives one."""
    counts = found.counts
    sizes = np.where(counts >= width, counts - width + 1, 0)
    owner = np.repeat(np.arange(len(counts)), sizes)
    before = np.cumsum(sizes) - sizes
    place = np.repeat(found.first[:-1] - before, sizes) + np.arange(len(owner))
    hashes = runs(found.hash, width)[place] if len(owner) else np.zeros(0, np.uint64)
    short_hash, short_owner = [], []
    for n in range(1, width):
        who = np.flatnonzero(counts == n)
        if len(who):
            short_hash.append(mix(runs(found.hash, n)[found.first[who]] + np.uint64(n)))
            short_owner.append(who)
    if short_hash:
        hashes = np.concatenate([hashes, *short_hash])
        owner = np.concatenate([owner, *short_owner])
    return hashes, owner


def distinct_sorted(hashes, owner):
    """Distinct (owner, hash), sorted by owner and then hash."""
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], owner[new]
