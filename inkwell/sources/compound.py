"""Compound files: bytes to streams and back. Pure functions of one file's bytes, for use inside Arrow batches."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

#: Fixed values of the format.
MAGIC = bytes.fromhex("D0CF11E0A1B11AE1")
FREE, END, FAT_SECTOR, DIFAT_SECTOR, NOTHING = 0xFFFFFFFF, 0xFFFFFFFE, 0xFFFFFFFD, 0xFFFFFFFC, 0xFFFFFFFF
CUTOFF, MINI = 4096, 64
STORAGE, STREAM, ROOT = 1, 2, 5


class BadFile(ValueError):
    """Bytes that aren't what they should be."""


class Entry(NamedTuple):
    sid: int
    path: str
    kind: int
    size: int
    start: int


class Compound:
    """A compound file; entries by path, "/" between names. Sectors cut short by the end of the file are filled with zeros."""

    def __init__(self, data: bytes):
        if len(data) < 512 or data[:8] != MAGIC:
            raise BadFile("not a compound file")
        self.data = data
        major, order, shift, mini_shift = struct.unpack_from("<HHHH", data, 26)
        if order != 0xFFFE or major not in (3, 4) or mini_shift != 6 or shift != (9 if major == 3 else 12):
            raise BadFile(f"unknown version {major} or sector shift {shift}")
        self.major, self.sector = major, 1 << shift
        n_fat, first_dir, _, self.cutoff, first_mini, n_mini, first_difat, n_difat = struct.unpack_from("<IIIIIIII", data, 44)
        table = list(struct.unpack_from("<109I", data, 76))
        at, per = first_difat, self.sector // 4
        for _ in range(min(n_difat, len(data) // self.sector + 1)):
            if at >= DIFAT_SECTOR:
                break
            block = struct.unpack(f"<{per}I", self._at(at))
            table += block[:-1]
            at = block[-1]
        self.fat: list[int] = []
        for sid in [x for x in table if x < DIFAT_SECTOR][:n_fat]:
            self.fat += struct.unpack(f"<{per}I", self._at(sid))
        self.entries = list(self._directory(b"".join(self._chain(first_dir))))
        self.mini_fat: list[int] = []
        if n_mini and first_mini < DIFAT_SECTOR:
            raw = b"".join(self._chain(first_mini))
            self.mini_fat = list(struct.unpack(f"<{len(raw) // 4}I", raw))
        root = next((e for e in self.entries if e.kind == ROOT), None)
        self.mini_stream = b"".join(self._chain(root.start)) if root and root.size else b""

    def _at(self, sid: int) -> bytes:
        begin = (sid + 1) * self.sector
        return self.data[begin : begin + self.sector].ljust(self.sector, b"\0")

    def _chain(self, sid: int) -> Iterator[bytes]:
        seen = set()
        while sid < DIFAT_SECTOR:
            if sid in seen:
                raise BadFile(f"sector {sid} follows itself")
            seen.add(sid)
            yield self._at(sid)
            sid = self.fat[sid] if sid < len(self.fat) else END

    def _directory(self, raw: bytes) -> Iterator[Entry]:
        rows = []
        for k in range(len(raw) // 128):
            e = raw[128 * k : 128 * k + 128]
            length, kind, _, left, right, child = struct.unpack_from("<HBBIII", e, 64)
            start, low, high = struct.unpack_from("<III", e, 116)
            rows.append((e[: max(0, min(length, 64) - 2)].decode("utf-16-le", "replace"), kind, left, right, child, start, low if self.major == 3 else low | high << 32))
        # siblings form a search tree; storages hang their children below
        todo, seen = [(0, "")] if rows else [], set()
        while todo:
            sid, above = todo.pop()
            if sid >= len(rows) or sid in seen:
                continue
            seen.add(sid)
            name, kind, left, right, child, start, size = rows[sid]
            path = above if kind == ROOT else f"{above}{name}"
            if kind:
                yield Entry(sid, path, kind, size, start)
            todo += [(left, above), (right, above), (child, f"{path}/" if path else "")]

    def _read(self, e: Entry) -> bytes:
        if e.size >= self.cutoff or e.kind == ROOT:
            return b"".join(self._chain(e.start))[: e.size]
        out, sid, seen = [], e.start, set()
        while sid < DIFAT_SECTOR and len(out) * MINI < e.size:
            if sid in seen:
                raise BadFile(f"mini sector {sid} follows itself")
            seen.add(sid)
            out.append(self.mini_stream[sid * MINI : sid * MINI + MINI].ljust(MINI, b"\0"))
            sid = self.mini_fat[sid] if sid < len(self.mini_fat) else END
        return b"".join(out)[: e.size]

    def find(self, name: str) -> Entry | None:
        """The stream of a path, else the first of a name in any storage, whatever the case."""
        low = name.lower()
        own = sorted((e for e in self.entries if e.kind == STREAM and low in (e.path.lower(), e.path.lower().rsplit("/", 1)[-1])), key=lambda e: (e.path.lower() != low, e.sid))
        return own[0] if own else None

    def read(self, name: str) -> bytes:
        if (e := self.find(name)) is None:
            raise BadFile(f"no stream {name}; there are: {', '.join(sorted(x.path for x in self.entries if x.kind == STREAM))}")
        return self._read(e)

    def children(self, storage: str) -> list[str]:
        """The names right below a storage."""
        low = storage.lower().rstrip("/") + "/"
        return sorted(e.path[len(low) :] for e in self.entries if e.path.lower().startswith(low) and "/" not in e.path[len(low) :])


def build(streams: dict[str, bytes]) -> bytes:
    """A version-3 compound file of streams by path; storages come from the paths."""
    paths = sorted({"/".join(p.split("/")[:k]) for p in streams for k in range(1, p.count("/") + 1)} | set(streams))
    number = {p: i + 1 for i, p in enumerate(paths)}
    below: dict[str, list[str]] = {}
    for p in paths:
        below.setdefault(p.rpartition("/")[0], []).append(p)
    mini, mini_fat, big = bytearray(), [], []
    start, fat = {}, []
    for p, body in streams.items():
        if len(body) >= CUTOFF:
            big.append(p)
        elif body:
            start[p] = len(mini) // MINI
            n = -(-len(body) // MINI)
            mini_fat += [*range(len(mini_fat) + 1, len(mini_fat) + n), END]
            mini += body.ljust(n * MINI, b"\0")
    body = bytearray()

    def put(data: bytes) -> int:
        if not data:
            return END
        first, n = len(fat), -(-len(data) // 512)
        fat.extend([*range(first + 1, first + n), END])
        body.extend(data.ljust(n * 512, b"\0"))
        return first

    for p in big:
        start[p] = put(streams[p])
    mini_start = put(bytes(mini))
    mini_fat_raw = struct.pack(f"<{len(mini_fat)}I", *mini_fat).ljust(-(-len(mini_fat) * 4 // 512) * 512, b"\xff")
    mini_fat_start = put(mini_fat_raw)

    links: dict[str, tuple[int, int]] = {}

    def tree(names: list[str]) -> int:
        """A balanced search tree of siblings; its root's number."""
        if not names:
            return NOTHING
        mid = len(names) // 2
        links[names[mid]] = (tree(names[:mid]), tree(names[mid + 1 :]))
        return number[names[mid]]

    order = lambda p: (len(p.rsplit("/", 1)[-1]), p.rsplit("/", 1)[-1].upper())
    tops = {parent: tree(sorted(kids, key=order)) for parent, kids in below.items()}

    def entry(name: str, kind: int, left: int, right: int, child: int, first: int, size: int) -> bytes:
        raw = name.encode("utf-16-le")[:62] + b"\0\0"
        return raw.ljust(64, b"\0") + struct.pack("<HBBIII", len(raw), kind, 1, left, right, child) + bytes(36) + struct.pack("<IQ", first, size)

    directory = entry("Root Entry", ROOT, NOTHING, NOTHING, tops.get("", NOTHING), mini_start, len(mini))
    for p in paths:
        left, right = links[p]
        if p in streams:
            directory += entry(p.rsplit("/", 1)[-1], STREAM, left, right, NOTHING, start.get(p, END), len(streams[p]))
        else:
            directory += entry(p.rsplit("/", 1)[-1], STORAGE, left, right, tops.get(p, NOTHING), 0, 0)
    dir_start = put(directory)
    n_fat = 1
    while n_fat * 128 < len(fat) + n_fat:
        n_fat += 1
    if n_fat > 109:
        raise BadFile("too large for a header without further tables")
    first_fat = len(fat)
    fat += [FAT_SECTOR] * n_fat
    fat += [FREE] * (n_fat * 128 - len(fat))
    header = MAGIC + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6)
    header += struct.pack("<IIIIIIIII", 0, n_fat, dir_start, 0, CUTOFF, mini_fat_start if mini_fat else END, len(mini_fat_raw) // 512, END, 0)
    header += struct.pack("<109I", *range(first_fat, first_fat + n_fat), *[FREE] * (109 - n_fat))
    return header + bytes(body) + struct.pack(f"<{len(fat)}I", *fat)
