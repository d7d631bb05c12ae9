"""Cells of binary spreadsheets: XLS (BIFF8 in a compound file) and XLSB (records in a zip)."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

Sheet = tuple[str, list[dict[int, str]]]  # (name, rows of column -> text)
MAGIC = bytes.fromhex("D0CF11E0A1B11AE1")
LAST = 0xFFFFFFFA  # sector numbers from here on are marks


class SheetError(ValueError):
    """A file that can't be read."""


def number(x: float) -> str:
    """A number as it is written: whole ones without a point."""
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def packed(rk: int) -> str:
    """A number of 32 bits: a whole one or the upper bits of a double, perhaps in hundredths."""
    x = float((rk if rk < 1 << 31 else rk - (1 << 32)) >> 2) if rk & 2 else struct.unpack("<d", struct.pack("<Q", (rk & ~3) << 32))[0]
    return number(x / 100 if rk & 1 else x)


def rows_of(cells: dict[tuple[int, int], str]) -> list[dict[int, str]]:
    """The rows that have a cell, in order."""
    rows: dict[int, dict[int, str]] = {}
    for (r, c), text in cells.items():
        rows.setdefault(r, {})[c] = text
    return [rows[r] for r in sorted(rows)]


# --- compound files ---------------------------------------------------------------------


def streams(data: bytes) -> dict[str, bytes]:
    """The streams of a compound file by name."""
    if data[:8] != MAGIC:
        raise SheetError("no compound file")
    shift, small_shift = struct.unpack_from("<HH", data, 30)
    fats, first_dir, cutoff, first_small, _, first_more, _ = struct.unpack_from("<I I 4x I I I I I", data, 44)
    size = 1 << shift

    def sector(k: int) -> bytes:
        return data[(k + 1) * size : (k + 2) * size]

    where = list(struct.unpack_from("<109I", data, 76))
    while first_more < LAST and len(where) < 1 << 20:
        more = struct.unpack(f"<{size // 4}I", sector(first_more))
        where += more[:-1]
        first_more = more[-1]
    fat = [x for k in where[:fats] if k < LAST for x in struct.unpack(f"<{size // 4}I", sector(k))]

    def chain(k: int, table: list[int]) -> Iterator[int]:
        for _ in range(len(table)):
            if k >= len(table):
                break
            yield k
            k = table[k]

    def whole(k: int) -> bytes:
        return b"".join(sector(s) for s in chain(k, fat))

    entries = [e for e in struct.iter_unpack("<64s H B 49x I I 4x", whole(first_dir)[: len(whole(first_dir)) // 128 * 128])]
    root = next((e for e in entries if e[2] == 5), None)
    small = struct.unpack(f"<{len(whole(first_small)) // 4}I", whole(first_small)) if first_small < LAST else ()
    pool = whole(root[3]) if root and small else b""
    out = {}
    for name, length, kind, start, n in entries:
        if kind == 2:
            body = whole(start) if n >= cutoff else b"".join(pool[k << small_shift : (k + 1) << small_shift] for k in chain(start, list(small)))
            out[name[: max(0, length - 2)].decode("utf-16-le", "replace")] = body[:n]
    return out


# --- XLS --------------------------------------------------------------------------------


class Parts:
    """The strings of a record that goes on in others; a string that is cut says again how wide its characters are."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.k, self.at = parts, 0, 0

    def take(self, n: int) -> bytes:
        out = b""
        while n and self.k < len(self.parts):
            piece = self.parts[self.k][self.at : self.at + n]
            out, n, self.at = out + piece, n - len(piece), self.at + len(piece)
            if n:
                self.k, self.at = self.k + 1, 0
        return out

    def text(self) -> str:
        head = self.take(3)
        if len(head) < 3:
            raise SheetError("the table of strings ends too soon")
        count, flags = struct.unpack("<HB", head)
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        out = ""
        while count:
            if self.k >= len(self.parts):
                break
            if self.at == len(self.parts[self.k]):
                self.k, self.at = self.k + 1, 0
                flags = self.take(1)[0] if self.k < len(self.parts) else 0
            wide = flags & 1
            n = min(count, (len(self.parts[self.k]) - self.at) >> wide) if self.k < len(self.parts) else 0
            if not n:
                break
            out += self.take(n << wide).decode("utf-16-le" if wide else "latin-1", "replace")
            count -= n
        self.take(4 * runs + extra)
        return out


def records(data: bytes, at: int) -> Iterator[tuple[int, bytes]]:
    """(kind, body) until the end of a part of the stream."""
    while at + 4 <= len(data):
        kind, n = struct.unpack_from("<HH", data, at)
        yield kind, data[at + 4 : at + 4 + n]
        at += 4 + n
        if kind == 0x0A:
            break


def short(body: bytes, width: int) -> str:
    """A string whose length takes so many bytes."""
    n, flags = int.from_bytes(body[:width], "little"), body[width]
    return body[width + 1 : width + 1 + (n << (flags & 1))].decode("utf-16-le" if flags & 1 else "latin-1", "replace")


def xls_sheets(data: bytes) -> list[Sheet]:
    """The sheets of an XLS file."""
    try:
        found = streams(data)
        book = found.get("Workbook") or found.get("Book")
        if book is None:
            raise SheetError("no workbook in the file")
        sheets, parts = [], []
        last = 0
        for kind, body in records(book, 0):
            if kind == 0x85:
                sheets.append((struct.unpack_from("<I", body)[0], short(body[6:], 1)))
            elif kind == 0xFC:
                parts = [body]
            elif kind == 0x3C and last == 0xFC:
                parts.append(body)
                continue
            elif kind == 0x2F:
                raise SheetError("the file is encrypted")
            last = kind
        strings: list[str] = []
        if parts:
            reader = Parts([parts[0][8:], *parts[1:]])
            strings = [reader.text() for _ in range(struct.unpack_from("<I", parts[0], 4)[0])]
        return [(name, rows_of(xls_cells(book, at, strings))) for at, name in sheets]
    except (struct.error, IndexError) as e:
        raise SheetError(str(e)) from e


def xls_cells(book: bytes, at: int, strings: list[str]) -> dict[tuple[int, int], str]:
    """The cells of the sheet that begins there."""
    cells: dict[tuple[int, int], str] = {}
    formula = None
    for kind, body in records(book, at):
        place = struct.unpack_from("<HH", body) if len(body) >= 4 else (0, 0)
        if kind == 0xFD:
            cells[place] = strings[struct.unpack_from("<I", body, 6)[0]]
        elif kind == 0x203:
            cells[place] = number(struct.unpack_from("<d", body, 6)[0])
        elif kind == 0x27E:
            cells[place] = packed(struct.unpack_from("<I", body, 6)[0])
        elif kind == 0xBD:
            for k in range((len(body) - 6) // 6):
                cells[place[0], place[1] + k] = packed(struct.unpack_from("<I", body, 6 + 6 * k)[0])
        elif kind == 0x205 and not body[7]:
            cells[place] = "true" if body[6] else "false"
        elif kind == 0x204:
            cells[place] = short(body[6:], 2)
        elif kind == 0x06:
            formula = place
            if body[12:14] != b"\xff\xff":
                cells[place] = number(struct.unpack_from("<d", body, 6)[0])
            elif body[6] == 1:
                cells[place] = "true" if body[8] else "false"
        elif kind == 0x207 and formula:
            cells[formula] = short(body, 2)
    return cells


# --- XLSB -------------------------------------------------------------------------------


def varint(data: bytes, at: int, most: int) -> tuple[int, int]:
    """A number of seven bits a byte."""
    out = 0
    for k in range(most):
        b = data[at]
        out |= (b & 127) << 7 * k
        at += 1
        if b < 128:
            break
    return out, at


def binary(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(kind, body) of the records of a part."""
    at = 0
    while at < len(data):
        kind, n = data[at], 0
        at += 1
        if kind & 128:
            kind, at = kind & 127 | (data[at] & 127) << 7, at + 1
        n, at = varint(data, at, 4)
        yield kind, data[at : at + n]
        at += n


def wide(body: bytes, at: int) -> tuple[str, int]:
    """A string and where it ends."""
    n = struct.unpack_from("<I", body, at)[0]
    return body[at + 4 : at + 4 + 2 * n].decode("utf-16-le", "replace"), at + 4 + 2 * n


def xlsb_sheets(data: bytes) -> list[Sheet]:
    """The sheets of an XLSB file."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            strings = [wide(b, 1)[0] for k, b in binary(z.read("xl/sharedStrings.bin")) if k == 19] if "xl/sharedStrings.bin" in z.namelist() else []
            targets = {r.get("Id"): r.get("Target").lstrip("/") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.bin.rels"))}
            out = []
            for kind, body in binary(z.read("xl/workbook.bin")):
                if kind == 156:
                    rel, at = wide(body, 8)
                    name, _ = wide(body, at)
                    target = targets[rel]
                    out.append((name, rows_of(xlsb_cells(z.read(target if target.startswith("xl/") else "xl/" + target), strings))))
            return out
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, struct.error, IndexError) as e:
        raise SheetError(str(e)) from e


def xlsb_cells(data: bytes, strings: list[str]) -> dict[tuple[int, int], str]:
    """The cells of a sheet."""
    cells: dict[tuple[int, int], str] = {}
    row = 0
    for kind, body in binary(data):
        if kind == 0:
            row = struct.unpack_from("<I", body)[0]
        elif kind in (2, 4, 5, 6, 7, 8, 9, 10):
            place = (row, struct.unpack_from("<I", body)[0])
            if kind == 2:
                cells[place] = packed(struct.unpack_from("<I", body, 8)[0])
            elif kind in (4, 10):
                cells[place] = "true" if body[8] else "false"
            elif kind in (5, 9):
                cells[place] = number(struct.unpack_from("<d", body, 8)[0])
            elif kind in (6, 8):
                cells[place] = wide(body, 8)[0]
            else:
                cells[place] = strings[struct.unpack_from("<I", body, 8)[0]]
    return cells
