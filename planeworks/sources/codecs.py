"""Byte codecs of TIFF segments: PackBits and LZW."""

from __future__ import annotations

import numpy as np


class CodecError(ValueError):
    pass


def packbits_encode(data: bytes) -> bytes:
    """Runs of two equal bytes or more as such, the bytes between them as they are; both in pieces of 128 at most."""
    raw = np.frombuffer(data, np.uint8)
    out, n = bytearray(), len(raw)
    first = np.concatenate([[0], np.flatnonzero(raw[1:] != raw[:-1]) + 1]) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(first, n))
    runs = np.flatnonzero(size > 1)
    at = 0
    for a, k in zip(first[runs].tolist() + [n], size[runs].tolist() + [0], strict=True):
        while at < a:
            m = min(128, a - at)
            out.append(m - 1)
            out += data[at : at + m]
            at += m
        while k > 1:
            m = min(128, k)
            out += bytes((257 - m, data[a]))
            k, at = k - m, at + m
        if k:  # one byte of a run is left over
            out += bytes((0, data[a]))
            at += 1
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        h = data[i]
        if h < 128:
            out += data[i + 1 : i + 2 + h]
            i += 2 + h
        elif h > 128:
            out += data[i + 1 : i + 2] * (257 - h)
            i += 2
        else:
            i += 1
    return bytes(out)


#: Codes from one clear code to the next: code k after a clear code has the width _WIDTH[k], as the table widens one
#: code early. The writer clears once code 4094 is made.
_CLEAR, _END, _FIRST, _LAST = 256, 257, 258, 4095
_WIDTH = np.maximum(9, np.ceil(np.log2(np.arange(_FIRST + 1, _LAST + 3))).astype(np.int64)).clip(9, 12)
_SINGLE = [bytes((i,)) for i in range(256)] + [b"", b""]


def lzw_encode(data: bytes) -> bytes:
    """Most significant bit first, codes of 9 to 12 bits, widening one code early, as TIFF has it."""
    codes, cut = [_CLEAR], [0]
    table: dict[int, int] = {}
    find, add = table.get, codes.append
    free, prefix = _FIRST, -1
    for byte in data:
        if prefix < 0:
            prefix = byte
            continue
        key = prefix << 8 | byte
        longer = find(key)
        if longer is not None:
            prefix = longer
            continue
        add(prefix)
        table[key] = free
        free += 1
        prefix = byte
        if free == _LAST:
            cut.append(len(codes))
            add(_CLEAR)
            table.clear()
            free = _FIRST
    if prefix >= 0:
        add(prefix)
    add(_END)
    values = np.array(codes, np.int64)
    # a code's width follows from its place after the last clear code, which itself is as wide as its place before says
    since = np.arange(len(values))
    for a, b in zip(cut, cut[1:] + [len(values) - 1], strict=True):
        since[a + 1 : b + 1] -= a + 1
    since[0] = 0
    width = _WIDTH[since]
    at = np.cumsum(width) - width
    total = int(at[-1] + width[-1])
    # twelve bits a code, of which the last `width` are kept
    bits = np.unpackbits((values << (16 - width)).astype(">u2").view(np.uint8)).reshape(-1, 16)
    keep = np.arange(16)[None, :] < width[:, None]
    return np.packbits(bits[keep][:total]).tobytes()


def lzw_decode(data: bytes, size: int) -> bytes:
    """Up to `size` bytes; data that ends without an end code is as long as its codes."""
    padded = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)]).astype(np.int64)
    places = np.cumsum(_WIDTH) - _WIDTH
    start, end, made, out = 0, 8 * len(data), 0, []
    while start + 9 <= end and made < size:
        # the codes up to the next clear code, as many as one table can hold
        n = int(np.searchsorted(places + _WIDTH, end - start, side="right"))
        at = start + places[:n]
        byte = at >> 3
        three = padded[byte] << 16 | padded[byte + 1] << 8 | padded[byte + 2]
        values = (three >> (24 - (at & 7) - _WIDTH[:n])) & ((1 << _WIDTH[:n]) - 1)
        stops = np.flatnonzero((values == _CLEAR) | (values == _END))
        stop = int(stops[0]) if len(stops) else n
        table, prior = _SINGLE.copy(), b""
        add = table.append
        for code in values[:stop].tolist():
            if code < len(table):
                entry = table[code]
                if prior:
                    add(prior + entry[:1])
            elif code == len(table) and prior:
                entry = prior + prior[:1]
                add(entry)
            else:
                raise CodecError("lzw: code out of order")
            out.append(entry)
            made += len(entry)
            prior = entry
            if made >= size:
                break
        if not len(stops) or values[stop] == _END:
            break
        start = int(at[stop] + _WIDTH[stop])
    return b"".join(out)[:size]
