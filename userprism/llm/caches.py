"""What a Python worker keeps between tasks belongs to one operator at a time.

Spark reuses workers, so a tokenizer's cache would otherwise stay beside all later stages, and so
would the memory that Arrow and the allocator keep after a task.
"""

import ctypes
import functools

import pyarrow as pa

_held = {}


def hold(owner, make):
    """The cache of ``owner``, made at first use; those of others go."""
    if owner not in _held:
        release()
        _held[owner] = make()
    return _held[owner]


def release():
    _held.clear()
    trim()


@functools.cache
def _allocator():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # not every C library has it
        return None


def trim():
    """Give memory that is free but kept back to the system."""
    pa.default_memory_pool().release_unused()
    if _allocator() is not None:
        _allocator()(0)


def tidy(function):
    """``function`` of Arrow batches, trimmed before and after."""

    @functools.wraps(function)
    def run(batches):
        trim()
        try:
            yield from function(batches)
        finally:
            trim()

    return run


def tidy_table(function):
    """``function`` of an Arrow table, trimmed after each."""

    @functools.wraps(function)
    def run(table):
        try:
            return function(table)
        finally:
            trim()

    return run


def tidy_tables(function):
    """``function`` of two Arrow tables, trimmed after each pair."""

    @functools.wraps(function)
    def run(left, right):
        try:
            return function(left, right)
        finally:
            trim()

    return run
