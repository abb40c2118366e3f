"""Counting quotient filters over 64-bit fingerprints, in flat numpy arrays.

The leading bits of a fingerprint are its quotient, the slot where it belongs; the others are
its remainder, which is stored. Remainders of one quotient form a run, in order; runs are shifted
to the right where they would overlap. Three bits a slot say which quotients have a run
(`occupied`), where runs end (`ends`) and which slots hold a count (`counted`). A remainder
seen once takes one slot; one seen more often is followed by slots with its count less one,
least part first. Quotient and remainder are the whole fingerprint, so a filter gives back
exactly what was put in, and filters of any sizes merge without loss: their remainders come out
in order, equal ones are added, and the result is laid out anew.

A filter covers the fingerprints that share their first `prefix` bits, so that a range of all
fingerprints can be merged apart from the others.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable
from typing import NamedTuple

import numpy as np

BITS = 64
# Share of the slots that may be taken by distinct remainders.
LOAD = 0.75
_HEAD = struct.Struct("<BBQI")


class Filter(NamedTuple):
    """`quotient_bits` after `prefix_bits` choose the home slot of a fingerprint."""

    prefix: int
    prefix_bits: int
    quotient_bits: int
    occupied: np.ndarray
    ends: np.ndarray
    counted: np.ndarray
    remainders: np.ndarray

    @property
    def remainder_bits(self) -> int:
        return BITS - self.prefix_bits - self.quotient_bits


def _digits(counts: np.ndarray, bits: int) -> np.ndarray:
    """Slots that hold count - 1 of each remainder: none where it was seen once."""
    rest, slots = counts.astype(np.uint64) - np.uint64(1), np.zeros(len(counts), np.int64)
    while rest.any():
        slots += rest > 0
        rest = rest >> np.uint64(bits) if bits < BITS else np.zeros_like(rest)
    return slots


def build(fingerprints: np.ndarray, counts: np.ndarray, prefix_bits: int = 0) -> Filter:
    """A filter of distinct ascending fingerprints (uint64) that share their first bits."""
    size = max(len(fingerprints), 1)
    quotient_bits = min(max(int(np.ceil(np.log2(size / LOAD))), 1), BITS - prefix_bits - 8)
    low = BITS - prefix_bits - quotient_bits
    prefix = int(fingerprints[0] >> np.uint64(BITS - prefix_bits)) if prefix_bits and len(fingerprints) else 0
    mask = np.uint64((1 << low) - 1)
    quotients = ((fingerprints >> np.uint64(low)) & np.uint64((1 << quotient_bits) - 1)).astype(np.int64)
    taken = 1 + _digits(counts, low)
    # A remainder stands in its home slot or right behind the one before it.
    before = np.cumsum(taken) - taken
    at = before + np.maximum.accumulate(quotients - before) if len(before) else before
    slots = max(1 << quotient_bits, int(at[-1] + taken[-1]) if len(at) else 0)
    occupied, ends, counted = (np.zeros(slots, bool) for _ in range(3))
    remainders = np.zeros(slots, np.uint64)
    remainders[at] = fingerprints & mask
    occupied[quotients] = True
    last = np.append(np.diff(quotients) > 0, True)[:len(at)]
    ends[(at + taken - 1)[last]] = True
    rest, place = counts.astype(np.uint64) - np.uint64(1), at + 1
    held = rest > 0
    while held.any():
        counted[place[held]] = True
        remainders[place[held]] = rest[held] & mask
        rest, place = rest >> np.uint64(low), place + 1
        held = rest > 0
    return Filter(prefix, prefix_bits, quotient_bits, occupied, ends, counted, remainders)


def contents(given: Filter) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints of a filter in ascending order, and how often each was put in."""
    quotients, ends = np.flatnonzero(given.occupied), np.flatnonzero(given.ends)
    if not len(ends):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # The k-th run belongs to the k-th occupied quotient.
    starts = np.maximum(quotients, np.concatenate([[0], ends[:-1] + 1]))
    length = ends - starts + 1
    slot = np.arange(length.sum()) + np.repeat(starts - (np.cumsum(length) - length), length)
    home = np.repeat(quotients, length).astype(np.uint64)
    heads = ~given.counted[slot]
    low = np.uint64(given.remainder_bits)
    base = np.uint64(given.prefix << (BITS - given.prefix_bits)) if given.prefix_bits else np.uint64(0)
    found = base | (home[heads] << low) | given.remainders[slot[heads]]
    counts = np.ones(int(heads.sum()), np.uint64)
    owner = np.cumsum(heads) - 1
    digit = np.arange(len(slot)) - np.flatnonzero(heads)[owner] - 1
    for k in range(int(digit.max(initial=-1)) + 1):
        here = digit == k
        counts[owner[here]] += given.remainders[slot[here]] << np.uint64(k * given.remainder_bits)
    return found, counts.astype(np.int64)


def merge(filters: Iterable[Filter], prefix_bits: int = 0) -> Filter:
    """One filter with what all of them hold, counts added."""
    parts = [contents(f) for f in filters]
    fingerprints = np.concatenate([np.zeros(0, np.uint64), *(p[0] for p in parts)])
    counts = np.concatenate([np.zeros(0, np.int64), *(p[1] for p in parts)])
    order = np.argsort(fingerprints, kind="stable")  # merges the ascending parts
    return build(*_added(fingerprints[order], counts[order]), prefix_bits)


def _added(fingerprints: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct fingerprints of an ascending array, with their counts added."""
    if not len(fingerprints):
        return fingerprints, counts
    first = np.flatnonzero(np.append(True, fingerprints[1:] != fingerprints[:-1]))
    return fingerprints[first], np.add.reduceat(counts, first)


def by_range(fingerprints: np.ndarray, prefix_bits: int) -> dict[int, Filter]:
    """Filters of an unordered run of fingerprints, one for each range that occurs."""
    ordered = np.sort(fingerprints)
    distinct, counts = _added(ordered, np.ones(len(ordered), np.int64))
    prefixes = (distinct >> np.uint64(BITS - prefix_bits)).astype(np.int64) if prefix_bits else np.zeros(
        len(distinct), np.int64)
    cuts = np.flatnonzero(np.append(True, np.diff(prefixes) > 0)) if len(prefixes) else []
    return {int(prefixes[a]): build(distinct[a:b], counts[a:b], prefix_bits)
            for a, b in zip(cuts, [*cuts[1:], len(distinct)])}


def packed(given: Filter) -> bytes:
    """A filter as bytes: its sizes, three bits a slot, and remainders of whole bytes."""
    width = (given.remainder_bits + 7) // 8
    head = _HEAD.pack(given.prefix_bits, given.quotient_bits, given.prefix, len(given.ends))
    flags = np.packbits(np.concatenate([given.occupied, given.ends, given.counted]))
    # Slots in use only: the others hold nothing.
    used = given.remainders[_used(given)]
    return head + flags.tobytes() + used.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(data: bytes) -> Filter:
    prefix_bits, quotient_bits, prefix, slots = _HEAD.unpack_from(data)
    at = _HEAD.size
    flag_bytes = (3 * slots + 7) // 8
    flags = np.unpackbits(np.frombuffer(data, np.uint8, flag_bytes, at))[:3 * slots].astype(bool)
    occupied, ends, counted = flags[:slots], flags[slots:2 * slots], flags[2 * slots:]
    given = Filter(prefix, prefix_bits, quotient_bits, occupied, ends, counted, np.zeros(slots, np.uint64))
    width, used = (given.remainder_bits + 7) // 8, _used(given)
    wide = np.zeros((int(used.sum()), 8), np.uint8)
    wide[:, :width] = np.frombuffer(data, np.uint8, len(wide) * width, at + flag_bytes).reshape(-1, width)
    given.remainders[used] = wide.view("<u8").ravel()
    return given


def _used(given: Filter) -> np.ndarray:
    """Which slots lie in a run."""
    quotients, ends = np.flatnonzero(given.occupied), np.flatnonzero(given.ends)
    starts = np.maximum(quotients, np.concatenate([[0], ends[:-1] + 1])) if len(ends) else ends
    change = np.zeros(len(given.ends) + 1, np.int64)
    change[starts] += 1
    change[ends + 1] -= 1
    return np.cumsum(change)[:-1] > 0
