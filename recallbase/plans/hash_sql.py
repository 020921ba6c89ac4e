"""The hashes of functions.hashes in SQL, over unsigned 128-bit integers, for texts of ASCII characters."""

from __future__ import annotations

_WRAP = "CAST('18446744073709551616' AS UHUGEINT)"


def _big(n: int) -> str:
    return f"CAST('{n}' AS UHUGEINT)"


def fnv1a(text: str) -> str:
    bytes_ = f"list_transform(generate_series(1, length({text})), lambda i: CAST(ascii(substring({text}, i, 1)) AS UHUGEINT))"
    return f"list_reduce(list_prepend({_big(14695981039346656037)}, {bytes_}), lambda h, b: (xor(h, b) * {_big(1099511628211)}) % {_WRAP})"


def unit(h: str) -> str:
    """The hash, mixed, as a number above 0 and below 1. h: a column's name."""
    one = f"(({h} + {_big(11400714819323198485)}) % {_WRAP})"
    step = lambda x, shift, factor: f"list_transform([{x}], lambda v: (xor(v, v // {_big(1 << shift)}) * {_big(factor)}) % {_WRAP})[1]"
    two = step(one, 30, 0xBF58476D1CE4E5B9)
    three = step(two, 27, 0x94D049BB133111EB)
    last = f"list_transform([{three}], lambda v: xor(v, v // {_big(1 << 31)}))[1]"
    return f"((CAST({last} // 2048 AS DOUBLE) + 0.5e0) / 9007199254740992e0)"
