"""Spark's xxhash64 in plain Python, for brute-force versions."""

import struct

import xxhash


def xxhash64(*values) -> int:
    """Of strings, and of numbers as (value, "i") for an int and (value, "q") or a plain int for a long; None is passed over."""
    h = 42
    for v in values:
        if v is None:
            continue
        raw = v.encode() if isinstance(v, str) else struct.pack("<" + v[1], v[0]) if isinstance(v, tuple) else struct.pack("<q", v)
        h = xxhash.xxh64_intdigest(raw, seed=h)
    return h - 2**64 if h >= 2**63 else h
