"""One archive from Python: for tools and tests, and for what isn't a table. Scans of many go through `spark.read.format("mpq")`."""

from __future__ import annotations

import contextlib
import hashlib
import os
import re
import tempfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np

from . import schemas as S
from .errors import ArchiveIOError, BoundsError, FormatError, InvalidInputError, NotFoundError, UnsupportedFeatureError, kind_of
from .functions import cipher
from .functions.names import glob_regex
from .functions.patches import apply
from .sources import attributes as attrs
from .sources import layout as L

NAMED, ALL = "named", "all"
#: Observers: called with (done, total) while entries are listed and files written, and when an archive is compacted.
observers: dict[str, Callable[[int, int], None] | None] = {"list": None, "add": None, "compact": None}


def _tell(what: str, done: int, total: int) -> None:
    if call := observers.get(what):
        call(done, total)


@dataclass(frozen=True)
class Item:
    hash_index: int
    block_index: int
    name: str | None
    locale: int
    platform: int
    flags: int


@dataclass
class Report:
    table_errors: list[str]
    file_errors: list[str]

    def ok(self) -> bool:
        return not self.table_errors and not self.file_errors


class _Opened:
    """A file that is read where asked for; it is closed when nothing refers to it."""

    def __init__(self, path: str):
        self.file = open(path, "rb", buffering=0)  # noqa: SIM115

    def __del__(self):
        if hasattr(self, "file"):
            self.file.close()

    def size(self) -> int:
        return os.fstat(self.file.fileno()).st_size

    def read_at(self, n: int, at: int) -> bytes:
        data = os.pread(self.file.fileno(), n, at)
        while len(data) < n and (more := os.pread(self.file.fileno(), n - len(data), at + len(data))):
            data += more
        if len(data) < n:
            raise BoundsError("read beyond the end of the archive")
        return data


class Archive:
    """An open archive. `locale` is the preferred one of this session of it; patches overlay the files in order."""

    def __init__(self, source: str | bytes, locale: int = 0):
        self.path = source if isinstance(source, str) else None
        self.locale = locale
        self.patches: list[tuple[Archive, str | None]] = []
        self._waiting: dict[bytes, L.Entry] | None = None
        self._load(source)

    def _load(self, source: str | bytes) -> None:
        try:
            self.region = L.Region(source if isinstance(source, bytes) else _Opened(source))
        except OSError as e:
            raise ArchiveIOError(str(e)) from e
        self.header = L.read_header(self.region)
        if problem := L.header_problem(self.header):
            raise (UnsupportedFeatureError if problem[0] == "UnsupportedFeature" else FormatError)(problem[1])
        self.hashes, self.blocks = L.read_tables(self.region, self.header)
        self.policy = L.Policy(self.header["sector_size_shift"], len(self.hashes), len(self.blocks), format_version=self.header["format_version"], header_size=self.header["header_size"], extra=self.header)
        self.names: dict[int, str] = {}
        self._by_name: dict[str, list[Item]] | None = None
        special = [L.LISTFILE, L.ATTRIBUTES, L.SIGNATURE_FILE]
        self._name(special)
        self.policy.listfile = self.has_file(L.LISTFILE)
        self.policy.attributes = self.has_file(L.ATTRIBUTES)
        try:
            self.add_names(self.read_file(L.LISTFILE))
        except Exception as e:  # an archive without a readable list of names is still one
            kind_of(e)

    @classmethod
    def open(cls, path: str, locale: int = 0) -> Archive:
        return cls(path, locale)

    @classmethod
    def create(cls, path: str, policy: L.Policy | None = None, entries: Iterable[L.Entry] | None = None) -> Archive:
        """Writes an archive; the entries may be made as they are taken."""
        policy = policy or L.Policy(hash_entries=128)
        _replace(path, entries or [], policy)
        out = cls(path)
        out.policy.listfile, out.policy.attributes = policy.listfile, policy.attributes
        return out

    # names and look-ups

    def _name(self, names: list[str]) -> int:
        added, self._by_name = 0, None
        for name, slot in zip(names, L.find_slots(self.hashes, len(self.blocks), names), strict=True):
            if slot is not None and int(self.hashes[slot]["block_index"]) not in self.names:
                self.names[int(self.hashes[slot]["block_index"])] = name
                added += 1
        return added

    def add_names(self, listfile: bytes | str) -> int:
        """Names blocks from a list of names (text, or a path to one); the first name of a block stays. How many were new."""
        data = Path(listfile).read_bytes() if isinstance(listfile, str) else listfile
        lines = [x.strip() for x in re.split("\r?\n", data.decode(errors="replace"))]
        return self._name([x for x in lines if x])

    def slot(self, name: str, locale: int | None = None) -> int | None:
        return L.find_slot(self.hashes, len(self.blocks), name, self.locale if locale is None else locale)

    def has_file(self, name: str, locale: int | None = None) -> bool:
        if locale is None:
            return L.find_slot(self.hashes, len(self.blocks), name) is not None
        slot = self.slot(name, locale)
        return slot is not None and int(self.hashes[slot]["locale"]) == locale

    def has_file_any(self, name: str) -> bool:
        return self.has_file(name) or any(p.has_file(c) for p, prefix in self.patches for c in candidates(name, prefix))

    def list(self, scope: str = ALL) -> list[Item]:
        out = []
        active = np.flatnonzero(self.hashes["block_index"] < S.DELETED)
        for n, i in enumerate(active.tolist()):
            h = self.hashes[i]
            b = int(h["block_index"])
            if b >= len(self.blocks):
                raise BoundsError("hash entry points outside the block table")
            name = self.names.get(b)
            if scope == ALL or name is not None:
                out.append(Item(i, b, name, int(h["locale"]), int(h["platform"]), int(self.blocks[b]["flags"])))
            _tell("list", n + 1, len(active))
        return out

    def find(self, pattern: str, scope: str = NAMED) -> list[Item]:
        """Named entries that fit a pattern; unnamed ones fit `*` only, and only where all are asked for. A plain name is looked up, not searched for."""
        fits = re.compile(glob_regex(pattern).replace(r"\z", r"\Z"))
        if not set("*?") & set(pattern) and observers.get("list") is None:
            if self._by_name is None:
                self._by_name = {}
                for i in self.list(NAMED):
                    self._by_name.setdefault(_latin(i.name), []).append(i)
            return [i for i in self._by_name.get(_latin(pattern), []) if fits.match(i.name.encode().decode("latin-1"))]
        return [i for i in self.list(scope) if (pattern == "*" if i.name is None else fits.match(i.name.encode().decode("latin-1")))]

    def list_all(self) -> list[Item]:
        """Named entries of the archive and its patches, those of later patches over the ones before, by name."""
        merged = {i.name: i for i in self.list(NAMED)}
        for patch, prefix in self.patches:
            for i in patch.list(NAMED):
                name = i.name.replace("/", "\\")
                if prefix and not name.lower().startswith(prefix.lower()):
                    continue
                name = name[len(prefix or "") :]
                if name and not name.startswith("("):
                    merged[name] = Item(i.hash_index, i.block_index, name, i.locale, i.platform, i.flags)
        return [merged[n] for n in sorted(merged, key=str.encode)]

    def locales(self, name: str) -> list[int]:
        _, a, b = (int(x) for x in cipher.hash_names([name.encode()])[0])
        rows = self.hashes[(self.hashes["block_index"] < S.DELETED) & (self.hashes["hash_a"] == a) & (self.hashes["hash_b"] == b)]
        return sorted({int(x) for x in rows["locale"]})

    # contents

    def read_block(self, block: int, name: str | None = None) -> bytes:
        if not 0 <= block < len(self.blocks):
            raise BoundsError("block index out of range")
        return L.decode(self.region, self.header, self.blocks[block], name if name is not None else self.names.get(block))

    def read_file(self, name: str, locale: int | None = None) -> bytes:
        if self.patches:
            found = self._patched(name)
        else:
            slot = self.slot(name, locale)
            found = None if slot is None else self.read_block(int(self.hashes[slot]["block_index"]), name)
        if found is None:
            raise NotFoundError(name)
        return found

    def _patched(self, name: str) -> bytes | None:
        slot = L.find_slot(self.hashes, len(self.blocks), name)
        current = None if slot is None else self.read_block(int(self.hashes[slot]["block_index"]), name)
        for patch, prefix in self.patches:
            there = next((c for c in candidates(name, prefix) if patch.has_file(c)), None)
            if there is not None:
                current = apply(current, patch.read_file(there))
        return current

    def open_file(self, name: str, locale: int | None = None) -> File:
        """A handle on a file that must be there; its content is read when asked for."""
        if not (self.has_file_any(name) if self.patches else self.slot(name, locale) is not None):
            raise NotFoundError(name)
        return File(self, name, locale)

    def checksums(self, name: str) -> tuple[int, bytes]:
        data = self.read_file(name)
        return zlib.crc32(data), hashlib.md5(data).digest()

    def extract(self, name: str, path: str) -> None:
        data = self.read_file(name)
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_bytes(data)

    def extract_all(self, folder: str) -> list[str]:
        """Writes every readable file below a folder; the paths written, in order. What can't be read is left out."""
        out: dict[str, None] = {}
        for item in (self.list_all() if self.patches else self.list(NAMED)):
            path = os.path.join(folder, safe_path(item.name))
            try:
                self.extract(item.name, path)
            except Exception as e:
                kind_of(e)
                continue
            out[path] = None
        return [*out]

    # changes: the whole archive is written aside and renamed

    def entries(self) -> list[L.Entry]:
        """The archive's files as they would be written again, without the list of names and the attributes that are made anew."""
        out = []
        for item in self.list():
            if item.name is None:
                raise UnsupportedFeatureError("an entry without a name can't be written again")
            made = (self.policy.listfile and L.same_name(item.name, L.LISTFILE)) or (self.policy.attributes and L.same_name(item.name, L.ATTRIBUTES))
            if made or not item.flags & S.EXISTS:
                continue
            f = item.flags
            kind = "zlib" if f & S.COMPRESS else "pkware" if f & S.IMPLODE else "none"
            data = L.decode(self.region, self.header, self.blocks[item.block_index], item.name)
            out.append((item.block_index, L.Entry(item.name, data, kind, bool(f & S.ENCRYPTED), bool(f & S.FIX_KEY), item.locale, item.platform, bool(f & S.SINGLE_UNIT), bool(f & S.SECTOR_CRC), bool(f & S.PATCH_FILE))))
        return [e for _, e in sorted(out, key=lambda x: x[0])]

    def rewrite(self, entries: list[L.Entry]) -> None:
        if self.path is None:
            raise InvalidInputError("an archive in memory can't be changed")
        if self._waiting is not None:
            raise InvalidInputError("only files can be added while changes are being made")
        policy, patches = self.policy, self.patches
        for n in range(len(entries)):
            _tell("add", n + 1, len(entries))
        _replace(self.path, entries, policy)
        self._load(self.path)
        self.policy.listfile, self.policy.attributes, self.patches = policy.listfile, policy.attributes, patches

    @contextlib.contextmanager
    def changes(self) -> Iterator[None]:
        """Files that are added within are in the archive at the end, when it is written once for all of them; it stays as it was if an error ends it."""
        if self._waiting is not None:
            raise InvalidInputError("changes are being made already")
        self._waiting = {}
        try:
            yield
            added = self._waiting
        finally:
            self._waiting = None
        if added:
            self.rewrite([e for e in self.entries() if _folded(e.name) not in added] + [*added.values()])

    def add_file(self, name: str, data: bytes, **options) -> None:
        if self._waiting is not None:
            self._waiting.pop(_folded(name), None)
            self._waiting[_folded(name)] = L.Entry(name, data, **options)
            return
        self.rewrite([e for e in self.entries() if not L.same_name(e.name, name)] + [L.Entry(name, data, **options)])

    def create_file(self, name: str, size: int, **options) -> Writer:
        return Writer(self, name, size, options)

    def _one(self, name: str) -> tuple[list[L.Entry], L.Entry]:
        entries = self.entries()
        found = next((e for e in entries if L.same_name(e.name, name)), None)
        if found is None:
            raise NotFoundError(name)
        return entries, found

    def remove_file(self, name: str) -> None:
        entries, found = self._one(name)
        self.rewrite([e for e in entries if e is not found])

    def rename_file(self, old: str, new: str) -> None:
        entries, found = self._one(old)
        if any(e is not found and L.same_name(e.name, new) for e in entries):
            raise InvalidInputError("there is a file of that name")
        found.name = new
        self.rewrite(entries)

    def set_file_locale(self, name: str, locale: int, platform: int = 0) -> None:
        entries, found = self._one(name)
        found.locale, found.platform = locale, platform
        self.rewrite(entries)

    def set_max_files(self, hash_entries: int, block_entries: int) -> None:
        if hash_entries <= 0 or hash_entries & hash_entries - 1:
            raise InvalidInputError("the hash table's size must be a power of two")
        entries = self.entries()
        self.policy.hash_entries, self.policy.block_entries = hash_entries, block_entries
        self.rewrite(entries)

    def compact(self) -> None:
        self.rewrite(self.entries())
        _tell("compact", 1, 1)

    # patches

    def attach_patch(self, path: str, prefix: str | None = None) -> None:
        """Adds an overlay on top; one that is there already isn't added again. Without a prefix it is told from the names."""
        if any(p.path == path for p, _ in self.patches):
            return
        patch = Archive.open(path)
        if prefix is None:
            marks = [i.name for i in patch.list(NAMED) if i.name.lower().endswith("\\(patch_metadata)")]
            prefix = marks[0][: -len("(patch_metadata)")] if marks else None
        self.patches.append((patch, clean_prefix(prefix)))

    def is_patched(self) -> bool:
        return bool(self.patches)

    # attributes

    def attribute_flags(self) -> int | None:
        return int.from_bytes(self.read_file(L.ATTRIBUTES)[4:8], "little") if self.has_file(L.ATTRIBUTES) else None

    def read_attributes(self) -> tuple[int, list[dict]] | None:
        """(flags, rows) of the attributes; of a wrong size they are inferred, else made from the contents; None without any."""
        if not self.has_file(L.ATTRIBUTES):
            return None
        data = self.read_file(L.ATTRIBUTES)
        for blocks in (len(self.blocks), None):
            try:
                return attrs.parse(data, blocks)
            except FormatError:
                continue
        return attrs.ALL, self.build_attributes()

    def build_attributes(self) -> list[dict]:
        rows = [{"crc32": 0, "filetime": 0, "md5": bytes(16), "patch_bit": False} for _ in self.blocks]
        for i in self.list():
            rows[i.block_index]["patch_bit"] = bool(i.flags & S.PATCH_FILE)
            if i.name is not None and not L.same_name(i.name, L.ATTRIBUTES):
                data = self.read_block(i.block_index)
                rows[i.block_index] |= {"crc32": zlib.crc32(data), "md5": hashlib.md5(data).digest()}
        return rows

    def sync_attributes(self, flags: int = attrs.ALL) -> None:
        """Writes attributes made from the contents."""
        data = attrs.serialize(flags, self.build_attributes(), len(self.blocks))
        self.policy.attributes = False
        self.add_file(L.ATTRIBUTES, data, compression="zlib", encrypted=True, fix_key=True)

    # checks

    def verify(self) -> Report:
        """Structure: sizes, references, ranges and duplicates of the tables."""
        report = Report([], [])
        index, flags, n = self.hashes["block_index"].astype(np.int64), self.blocks["flags"], len(self.blocks)
        active = np.flatnonzero(index < S.DELETED)
        inside = index[active] < n
        there = np.zeros(len(active), bool)
        there[inside] = flags[index[active][inside]] & S.EXISTS != 0
        for i in active[~there].tolist():
            b = int(index[i])
            if b >= n:
                report.table_errors.append(f"hash[{i}] points to invalid block index {b}")
            else:
                report.file_errors.append(f"hash[{i}] points to non-existing block {b}")
        exists = flags & S.EXISTS != 0
        beyond = exists & (self.blocks["file_pos"].astype(np.int64) + self.blocks["compressed_size"] > self.region.size)
        empty = exists & (self.blocks["compressed_size"] == 0) & (self.blocks["file_size"] != 0)
        for i in np.flatnonzero(beyond | empty).tolist():
            if beyond[i]:
                report.file_errors.append(f"block[{i}] data range exceeds archive length")
            if empty[i]:
                report.file_errors.append(f"block[{i}] zero compressed size with non-zero file size")
        rows = self.hashes[active]
        keys = np.stack([rows[k].astype(np.int64) for k in ("hash_a", "hash_b", "locale")], axis=1)
        _, first = np.unique(keys, axis=0, return_index=True)
        for i in np.delete(active, first).tolist():
            report.table_errors.append(f"duplicate hash tuple at hash[{i}]")
        return report

    def verify_mode(self, mode: str, name: str | None = None, target: str = "file") -> Report:
        """`archive`, `file` or `raw`: the check of that kind."""
        if mode == "archive":
            return self.verify()
        if mode == "file":
            if name is None:
                raise InvalidInputError("file verification requires file name")
            return self.verify_file(name)
        if mode == "raw":
            return self.verify_raw(target, name)
        raise InvalidInputError(f"no verification {mode}")

    def verify_file(self, name: str) -> Report:
        try:
            self.read_file(name)
        except Exception as e:
            kind_of(e)
            return Report([], [f"{name}: {e}"])
        return Report([], [])

    def verify_raw(self, target: str, name: str | None = None) -> Report:
        """MD5 of raw chunks of `header`, `het`, `bet` or `file` (the other tables have none); fine where there are none."""
        report, h = Report([], []), self.header
        chunk = h["raw_chunk_size"] or 0
        if not chunk:
            return report
        if target == "header":
            if h["header_size"] >= 0xC0:
                self._raw(report, "v4 header raw-data", 0, 0xC0, chunk)
        elif target in ("het", "bet"):
            pos, size = h[f"{target}_table_pos_64"], h[f"{target}_table_size_64"]
            if pos and size:
                self._raw(report, f"{target.upper()} table", pos, size, chunk)
        elif target == "file":
            if name is None:
                raise InvalidInputError("raw file verification requires file name")
            slot = L.find_slot(self.hashes, len(self.blocks), name)
            if slot is None:
                raise NotFoundError(name)
            b = self.blocks[int(self.hashes[slot]["block_index"])]
            self._raw(report, "file raw-data", int(b["file_pos"]), int(b["compressed_size"]), chunk)
        return report

    def _raw(self, report: Report, label: str, pos: int, size: int, chunk: int) -> None:
        count = -(-size // chunk)
        if pos + size + 16 * count > self.region.size:
            report.table_errors.append(f"{label} raw-data range exceeds archive length")
            return
        data, sums = self.region.read(pos, size), self.region.read(pos + size, 16 * count)
        if any(hashlib.md5(data[i * chunk : (i + 1) * chunk]).digest() != sums[16 * i : 16 * i + 16] for i in range(count)):
            report.table_errors.append(f"{label} raw-data md5 mismatch")

    def signature(self) -> str:
        """`weak`, `strong` or `none`: which kind of signature is there; it isn't checked."""
        if self.has_file(L.SIGNATURE_FILE) and len(self.read_file(L.SIGNATURE_FILE)) == 72:
            return "weak"
        end = self.header["archive_size_32"]
        return "strong" if self.region.size >= end + 260 and self.region.read(end, 4) == b"NGIS" else "none"


@dataclass(frozen=True)
class File:
    archive: Archive
    name: str
    locale: int | None = None

    def read_all(self) -> bytes:
        return self.archive.read_file(self.name, self.locale)


class Writer:
    """A file written piece by piece into an archive; it is there once it is finished."""

    def __init__(self, archive: Archive, name: str, size: int, options: dict):
        self.archive, self.name, self.size, self.options, self.data = archive, name, size, options, bytearray()

    def write(self, piece: bytes) -> None:
        if len(self.data) + len(piece) > self.size:
            raise InvalidInputError("more data than announced")
        self.data += piece

    def finish(self) -> None:
        if len(self.data) != self.size:
            raise InvalidInputError("less data than announced")
        self.archive.add_file(self.name, bytes(self.data), **self.options)


def _replace(path: str, entries: Iterable[L.Entry], policy: L.Policy) -> None:
    folder = os.path.dirname(os.path.abspath(path))
    handle, aside = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(handle, "wb") as f:
            L.write(f, entries, policy)
        os.replace(aside, path)
    except BaseException:
        os.unlink(aside)
        raise


def _folded(name: str) -> bytes:
    return name.encode().translate(L._SORT_KEY)


def _latin(name: str) -> str:
    """What names share that differ in case only, byte by byte."""
    return name.encode().decode("latin-1").lower()


def candidates(name: str, prefix: str | None) -> list[str]:
    """The names under which a patch may hold a file."""
    back = name.replace("/", "\\")
    return ([prefix + back, prefix + name] if prefix else []) + [name, back]


def clean_prefix(prefix: str | None) -> str | None:
    bare = (prefix or "").strip().replace("/", "\\").rstrip("\\")
    return bare + "\\" if bare else None


def safe_path(name: str, fallback: str = "unnamed.bin") -> str:
    parts = [p.strip() for p in re.split(r"[\\/]", name)]
    return "/".join(p for p in parts if p not in ("", ".", "..")) or fallback
