"""What can go wrong with an archive, as exceptions and as the `error_kind` column of scans."""

from __future__ import annotations


class ArchiveError(Exception):
    kind = "Format"
    label = "invalid format"

    def __str__(self) -> str:
        return f"{self.label}: {super().__str__()}"


def _kind(name: str, label: str) -> type[ArchiveError]:
    return type(f"{name}Error", (ArchiveError,), {"kind": name, "label": label, "__module__": __name__})


FormatError = _kind("Format", "invalid format")
CryptoError = _kind("Crypto", "crypto error")
CompressionError = _kind("Compression", "compression error")
BoundsError = _kind("Bounds", "out of bounds")
UnsupportedFeatureError = _kind("UnsupportedFeature", "unsupported feature")
NotFoundError = _kind("NotFound", "not found")
InvalidInputError = _kind("InvalidInput", "invalid input")
ArchiveIOError = _kind("Io", "I/O error")
KINDS = ("Io", "Format", "Crypto", "Compression", "Bounds", "UnsupportedFeature", "NotFound", "InvalidInput")


def kind_of(error: BaseException) -> str:
    """The kind of an exception; one of the operating system is `Io`."""
    if isinstance(error, ArchiveError):
        return error.kind
    return "Io" if isinstance(error, OSError) else "Format"
