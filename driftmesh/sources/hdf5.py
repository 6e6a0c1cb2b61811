"""The part of the HDF5 file format that mesh files use, read from bytes: groups of every storage, attributes, and
datasets of fixed-size numbers and characters that are not chunked. Anything else raises.

Layouts of structures follow the published format specification; sizes of offsets and lengths are taken as 8 bytes.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

#: Fixed values of the format.
SIGNATURE = b"\x89HDF\r\n\x1a\n"
UNDEFINED = 0xFFFFFFFFFFFFFFFF
DATASPACE, LINK_INFO, DATATYPE, LINK, LAYOUT, ATTRIBUTE, CONTINUATION, SYMBOL_TABLE = 0x1, 0x2, 0x3, 0x6, 0x8, 0xC, 0x10, 0x11


def _int(raw: bytes, at: int, size: int) -> int:
    return int.from_bytes(raw[at : at + size], "little")


@dataclass
class Dataset:
    """Where a dataset's numbers lie in the file; an empty one has no address."""

    kind: np.dtype
    shape: tuple[int, ...]
    address: int
    size: int


@dataclass
class Node:
    attributes: dict[str, np.ndarray] = field(default_factory=dict)
    children: dict[str, int] = field(default_factory=dict)  # names to header addresses
    dataset: Dataset | None = None


class File:
    def __init__(self, content: bytes):
        self.raw = content
        if content[:8] != SIGNATURE:
            raise ValueError("not an HDF5 file")
        version = content[8]
        if version in (0, 1):
            sizes, self.root = content[13:15], _int(content, 64 if version == 0 else 68, 8)
        elif version in (2, 3):
            sizes, self.root = content[9:11], _int(content, 36, 8)
        else:
            raise ValueError(f"superblock version {version}")
        if sizes != b"\x08\x08":
            raise ValueError("offsets and lengths must have eight bytes")

    def node(self, address: int) -> Node:
        out = Node()
        space = kind = layout = None
        for what, body, place in self._messages(address):
            if what == DATASPACE:
                space = _dataspace(body)
            elif what == DATATYPE:
                kind = _datatype(body)
            elif what == LAYOUT:
                layout = (body, place)
            elif what == ATTRIBUTE:
                name, value = _attribute(body)
                out.attributes[name] = value
            elif what == LINK:
                out.children.update([_link(body)])
            elif what == SYMBOL_TABLE:
                out.children.update(self._table(_int(body, 0, 8), _int(body, 8, 8)))
            elif what == LINK_INFO:
                at = 2 + 8 * (body[1] & 1)
                heap, index = _int(body, at, 8), _int(body, at + 8, 8)
                if heap != UNDEFINED:
                    out.children.update(self._dense(heap, index))
        if layout is not None:
            out.dataset = self._layout(*layout, kind, space)
        return out

    def values(self, d: Dataset) -> np.ndarray:
        return np.frombuffer(self.raw, d.kind, int(np.prod(d.shape, dtype=np.int64)), d.address).reshape(d.shape) if d.size else np.zeros(d.shape, d.kind)

    # object headers

    def _messages(self, address: int):
        raw = self.raw
        if raw[address : address + 4] == b"OHDR":
            flags = raw[address + 5]
            at = address + 6 + 16 * bool(flags & 0x20) + 4 * bool(flags & 0x10)
            width = 1 << (flags & 3)
            blocks, head = [(at + width, _int(raw, at, width))], 4 + 2 * bool(flags & 4)
            new = True
        elif raw[address] == 1:
            blocks, head, new = [(address + 16, _int(raw, address + 8, 4))], 8, False
        else:
            raise ValueError(f"no object header at byte {address}")
        while blocks:
            at, size = blocks.pop(0)
            end = at + size
            while at + head <= end:
                what, length = (raw[at], _int(raw, at + 1, 2)) if new else (_int(raw, at, 2), _int(raw, at + 2, 2))
                shared = raw[at + 3 if new else at + 4] & 2
                place = at + head
                body = raw[place : place + length]
                at = place + length
                if shared and what in (DATATYPE, DATASPACE):
                    raise ValueError("shared messages are not read")
                if what == CONTINUATION:
                    start, n = _int(body, 0, 8), _int(body, 8, 8)
                    blocks.append((start + 4, n - 8) if new else (start, n))
                else:
                    yield what, body, place

    # groups

    def _table(self, tree: int, heap: int):
        """Names and headers of a group kept in a tree of symbol tables with names in a heap."""
        raw, names = self.raw, _int(self.raw, heap + 24, 8)
        stack = [tree]
        while stack:
            at = stack.pop()
            if raw[at : at + 4] == b"TREE":
                used = _int(raw, at + 6, 2)
                stack += [_int(raw, at + 32 + 16 * k, 8) for k in range(used)]
            elif raw[at : at + 4] == b"SNOD":
                for k in range(_int(raw, at + 6, 2)):
                    entry = at + 8 + 40 * k
                    start = names + _int(raw, entry, 8)
                    yield raw[start : raw.index(b"\0", start)].decode(), _int(raw, entry + 8, 8)
            else:
                raise ValueError(f"no symbol table at byte {at}")

    def _dense(self, heap: int, index: int):
        """Names and headers of a group kept as links in a heap, found through the index of their names."""
        raw = self.raw
        if raw[heap : heap + 4] != b"FRHP" or raw[index : index + 4] != b"BTHD":
            raise ValueError("a group's links are not where its header says")
        width, start, largest, bits = _int(raw, heap + 110, 2), _int(raw, heap + 112, 8), _int(raw, heap + 120, 8), _int(raw, heap + 128, 2)
        root, rows = _int(raw, heap + 132, 8), _int(raw, heap + 140, 2)
        offset_bytes = -(-bits // 8)
        length_bytes = min(-(-(n.bit_length() - 1) // 8) or 1 for n in (largest, _int(raw, heap + 10, 4)))

        def place(offset: int) -> int:
            if rows == 0:
                return root + offset
            at, entry = 0, root + 13 + offset_bytes
            for row in range(rows):
                size = start if row < 2 else start << (row - 1)
                if size > largest:
                    raise ValueError("a group has more links than are read")
                for _ in range(width):
                    if offset < at + size:
                        return _int(raw, entry, 8) + offset - at
                    at, entry = at + size, entry + 8
            raise ValueError("a link lies outside its heap")

        for record in self._records(index):
            ident = record[4:]  # after the name's hash
            if ident[0] >> 4 & 3:
                raise ValueError("a link is not kept in the heap's blocks")
            offset, length = _int(ident, 1, offset_bytes), _int(ident, 1 + offset_bytes, length_bytes)
            at = place(offset)
            yield _link(raw[at : at + length])

    def _records(self, index: int):
        raw = self.raw
        node_size, size, depth = _int(raw, index + 6, 4), _int(raw, index + 10, 2), _int(raw, index + 12, 2)
        root, count = _int(raw, index + 16, 8), _int(raw, index + 24, 2)
        most = (node_size - 10) // size
        number = -(-most.bit_length() // 8)

        def walk(at: int, n: int, depth: int):
            for k in range(n):
                yield raw[at + 6 + k * size : at + 6 + (k + 1) * size]
            if depth > 1:
                raise ValueError("a group has more links than are read")
            if depth:
                child = at + 6 + n * size
                for k in range(n + 1):
                    yield from walk(_int(raw, child + k * (8 + number), 8), _int(raw, child + k * (8 + number) + 8, number), depth - 1)

        if count:
            yield from walk(root, count, depth)

    def _layout(self, body: bytes, place: int, kind: np.dtype, shape: tuple[int, ...]) -> Dataset:
        n = int(np.prod(shape, dtype=np.int64)) * kind.itemsize
        if body[0] in (3, 4) and body[1] == 0:
            return Dataset(kind, shape, place + 4, n)
        if body[0] in (3, 4) and body[1] == 1:
            address = _int(body, 2, 8)
        elif body[0] in (1, 2) and body[2] == 1:
            address = _int(body, 8, 8)
        else:
            raise ValueError("chunked datasets are not read")
        return Dataset(kind, shape, 0 if address == UNDEFINED else address, 0 if address == UNDEFINED else n)


def _dataspace(body: bytes) -> tuple[int, ...]:
    first = 8 if body[0] == 1 else 4
    return tuple(_int(body, first + 8 * k, 8) for k in range(body[1]))


def _datatype(body: bytes) -> np.dtype:
    kind, order, size = body[0] & 15, ">" if body[1] & 1 else "<", _int(body, 4, 4)
    if kind == 0:
        return np.dtype(f"{order}{'i' if body[1] & 8 else 'u'}{size}")
    if kind == 1:
        return np.dtype(f"{order}f{size}")
    if kind == 3:
        return np.dtype(f"S{size}")
    raise ValueError(f"data of class {kind} are not read")


def _attribute(body: bytes) -> tuple[str, np.ndarray]:
    version, sizes = body[0], struct.unpack_from("<3H", body, 2)
    at, parts = 8 + (version == 3), []
    for size in sizes:
        parts.append(body[at : at + size])
        at += -(-size // 8) * 8 if version == 1 else size
    try:
        kind = _datatype(parts[1])
    except ValueError:
        return parts[0].rstrip(b"\0").decode(), np.zeros(0)  # no mesh file needs it
    shape = _dataspace(parts[2])
    return parts[0].rstrip(b"\0").decode(), np.frombuffer(body, kind, int(np.prod(shape, dtype=np.int64)), at).reshape(shape)


def _link(body: bytes) -> tuple[str, int]:
    flags, at = body[1], 2
    kind = body[at] if flags & 8 else 0
    at += bool(flags & 8) + 8 * bool(flags & 4) + bool(flags & 16)
    width = 1 << (flags & 3)
    n = _int(body, at, width)
    name = body[at + width : at + width + n].decode()
    if kind:
        raise ValueError(f"{name} is a link to another place, which is not read")
    return name, _int(body, at + width + n, 8)


# writing


def _padded(raw: bytes) -> bytes:
    return raw + b"\0" * (-len(raw) % 8)


def _kind_of(kind: np.dtype) -> bytes:
    if kind.kind == "S":
        return struct.pack("<B3sI", 0x13, b"\0\0\0", kind.itemsize)
    if kind.kind == "f":
        sign, exponent, mantissa, bias = {4: (31, 8, 23, 127), 8: (63, 11, 52, 1023)}[kind.itemsize]
        return struct.pack("<BBBBI2H4BI", 0x11, 0x20, sign, 0, kind.itemsize, 0, kind.itemsize * 8, mantissa, exponent, 0, mantissa, bias)
    return struct.pack("<B3sI2H", 0x10, bytes([8 * (kind.kind == "i"), 0, 0]), kind.itemsize, 0, kind.itemsize * 8)


def _shape_of(shape: tuple[int, ...]) -> bytes:
    return struct.pack("<BBB5x", 1, len(shape), 0) + b"".join(struct.pack("<Q", n) for n in shape)


@dataclass
class Group:
    """What to write: attributes, groups and datasets by name."""

    attributes: dict[str, np.ndarray] = field(default_factory=dict)
    groups: dict[str, Group] = field(default_factory=dict)
    datasets: dict[str, np.ndarray] = field(default_factory=dict)


def encode(root: Group, tables: bool = False) -> bytes:
    """A file; tables: groups as symbol tables, as old files have them, else as links in their headers."""
    out = bytearray(96)

    def put(raw: bytes) -> int:
        out.extend(b"\0" * (-len(out) % 8))
        at = len(out)
        out.extend(raw)
        return at

    def header(messages: list[tuple[int, bytes]]) -> int:
        body = b"".join(struct.pack("<2HB3x", what, len(_padded(m)), 0) + _padded(m) for what, m in messages)
        return put(struct.pack("<BxHII4x", 1, len(messages), 1, len(body)) + body)

    def attribute(name: str, value: np.ndarray) -> tuple[int, bytes]:
        parts = [name.encode() + b"\0", _kind_of(value.dtype), _shape_of(value.shape)]
        return ATTRIBUTE, struct.pack("<Bx3H", 1, *map(len, parts)) + b"".join(map(_padded, parts)) + value.tobytes()

    def group(g: Group) -> int:
        links = {n: group(c) for n, c in g.groups.items()}
        for n, value in g.datasets.items():
            at = put(np.ascontiguousarray(value).tobytes())
            links[n] = header([(DATASPACE, _shape_of(value.shape)), (DATATYPE, _kind_of(value.dtype)), (LAYOUT, struct.pack("<BBQQ", 3, 1, at, value.nbytes))])
        messages = [attribute(*a) for a in g.attributes.items()]
        if tables:
            names, starts = bytearray(8), {}
            for n in links:
                starts[n] = len(names)
                names += _padded(n.encode() + b"\0")
            heap = put(b"HEAP" + struct.pack("<B3xQQQ", 0, len(names), 1, put(bytes(names))))
            rows = b"".join(struct.pack("<QQI20x", starts[n], links[n], 0) for n in sorted(links))
            leaf = put(b"SNOD" + struct.pack("<BxH", 1, len(links)) + rows)
            tree = put(b"TREE" + struct.pack("<BBHQQ", 0, 0, 1, UNDEFINED, UNDEFINED) + struct.pack("<QQQ", 0, leaf, starts[max(links)] if links else 0))
            messages.append((SYMBOL_TABLE, struct.pack("<QQ", tree, heap)))
        else:
            messages.append((LINK_INFO, struct.pack("<BBQQ", 0, 0, UNDEFINED, UNDEFINED)))
            messages += [(LINK, struct.pack("<BBH", 1, 1, len(n.encode())) + n.encode() + struct.pack("<Q", at)) for n, at in links.items()]
        return header(messages)

    top = group(root)
    out[:96] = SIGNATURE + struct.pack("<8BHHI4Q", 0, 0, 0, 0, 0, 8, 8, 0, 512, 16, 0, 0, UNDEFINED, len(out), UNDEFINED) + struct.pack("<QQI20x", 0, top, 0)
    return bytes(out)
