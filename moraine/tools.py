"""Commands over archives: python -m moraine.tools COMMAND ...

    list ARCHIVE [--listfile FILE] [--pattern P]      names, one to a line
    extract ARCHIVE FOLDER [--listfile FILE]          all readable files
    listfile ARCHIVE                                  the archive's own list of names
    repack FOLDER ARCHIVE [--like ARCHIVE]            a folder's files; flags as the other archive has them
    vectors FILE FOLDER                               a file under each codec
    manifest FOLDER OUT                               path, size and sha256 of a folder's files, as JSON
    compare EXPECTED ACTUAL [--allow PATH ...]        two such manifests; exit code 1 if they differ
    run ARCHIVE EXPECTED FOLDER [--allow PATH ...]    extract, then compare
    checklist FILE                                    features of a JSON checklist by status
"""

from __future__ import annotations

import argparse
import json
import sys
from collections import Counter
from pathlib import Path

from .archive import NAMED, Archive
from .functions import codecs
from .schemas import COMPRESS, ENCRYPTED, FIX_KEY, IMPLODE, SECTOR_CRC, SINGLE_UNIT
from .sources import layout as L

STATUSES = ("implemented", "partial", "missing", "out_of_scope")


def _opened(path: str, listfile: str | None) -> Archive:
    archive = Archive.open(path)
    if listfile:
        archive.add_names(listfile)
    return archive


def manifest(folder: str) -> list[dict]:
    import hashlib

    root = Path(folder)
    files = sorted((p.relative_to(root).as_posix(), p) for p in root.rglob("*") if p.is_file())
    return [{"path": name, "size": p.stat().st_size, "sha256": hashlib.sha256(p.read_bytes()).hexdigest()} for name, p in files]


def compare(expected: list[dict], actual: list[dict], allowed: set[str]) -> dict[str, list[str]]:
    e, a = ({r["path"]: (r["size"], r["sha256"]) for r in rows} for rows in (expected, actual))
    out: dict[str, list[str]] = {"missing": [], "mismatch": [], "allowed": [], "extra": sorted(a.keys() - e.keys())}
    for path in sorted(e):
        if path not in a:
            out["allowed" if path in allowed else "missing"].append(path)
        elif a[path] != e[path]:
            out["mismatch"].append(path)
    return out


def repack(folder: str, target: str, like: str | None) -> int:
    flags = {}
    if like:
        flags = {i.name.encode().translate(L._SORT_KEY): i.flags for i in Archive.open(like).list(NAMED)}
    entries = []
    for row in manifest(folder):
        name = row["path"].replace("/", "\\")
        if L.same_name(name, L.LISTFILE):
            continue
        f = flags.get(name.encode().translate(L._SORT_KEY), 0)
        kind = "zlib" if f & COMPRESS else "pkware" if f & IMPLODE else "none"
        entries.append(L.Entry(name, (Path(folder) / row["path"]).read_bytes(), kind, bool(f & ENCRYPTED), bool(f & FIX_KEY), single_unit=bool(f & SINGLE_UNIT), sector_crc=bool(f & SECTOR_CRC)))
    Archive.create(target, L.Policy(), entries)
    return len(entries)


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="moraine.tools", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, *places: str, **options) -> None:
        p = commands.add_parser(name)
        for place in places:
            p.add_argument(place)
        for option, more in options.items():
            p.add_argument(f"--{option}", **more)

    one, many = {"default": None}, {"nargs": "*", "default": []}
    command("list", "archive", listfile=one, pattern={"default": "*"})
    command("extract", "archive", "folder", listfile=one)
    command("listfile", "archive")
    command("repack", "folder", "archive", like=one)
    command("vectors", "file", "folder")
    command("manifest", "folder", "out")
    command("compare", "expected", "actual", allow=many)
    command("run", "archive", "expected", "folder", allow=many)
    command("checklist", "file")
    a = parser.parse_args(args)

    if a.command == "list":
        print("\n".join(i.name for i in _opened(a.archive, a.listfile).find(a.pattern) if i.name))
    elif a.command == "extract":
        print(f"{len(_opened(a.archive, a.listfile).extract_all(a.folder))} files")
    elif a.command == "listfile":
        sys.stdout.write(Archive.open(a.archive).read_file(L.LISTFILE).decode(errors="replace"))
    elif a.command == "repack":
        print(f"{repack(a.folder, a.archive, a.like)} files")
    elif a.command == "vectors":
        Path(a.folder).mkdir(parents=True, exist_ok=True)
        data = Path(a.file).read_bytes()
        (Path(a.folder) / "input.bin").write_bytes(data)
        for name in ("huffman", "adpcm_mono", "adpcm_stereo", "sparse", "pkware"):
            (Path(a.folder) / f"{name}.bin").write_bytes(codecs.compress(name, data))
    elif a.command == "manifest":
        Path(a.out).write_text(json.dumps(manifest(a.folder), indent=1))
    elif a.command in ("compare", "run"):
        if a.command == "run":
            Archive.open(a.archive).extract_all(a.folder)
        actual = manifest(a.folder) if a.command == "run" else json.loads(Path(a.actual).read_text())
        found = compare(json.loads(Path(a.expected).read_text()), actual, set(a.allow))
        print(json.dumps(found, indent=1))
        return int(any(found[k] for k in ("missing", "mismatch", "extra")))
    else:
        features = json.loads(Path(a.file).read_text())["features"]
        counts = Counter(f["status"] for f in features)
        print(f"total={len(features)} " + " ".join(f"{s}={counts[s]}" for s in STATUSES))
        return int(bool(counts.keys() - set(STATUSES)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
