"""Validation of names, payloads, paging and options."""

from __future__ import annotations

import uuid

EMPTY_KEY = "00000000-0000-0000-0000-000000000000"
NAME_BYTES = 255
#: fixed values: names that some systems keep for devices
DEVICES = {"CON", "PRN", "AUX", "NUL", *(f"{kind}{n}" for kind in ("COM", "LPT") for n in range(1, 10))}


def table_name(name: str) -> str:
    if name is None or not name.strip():
        raise ValueError("Table name cannot be blank.")
    if len(name.encode()) > NAME_BYTES:
        raise ValueError(f"Table name is longer than {NAME_BYTES} bytes in UTF-8.")
    if any(ord(c) < 32 or 127 <= ord(c) < 160 for c in name):
        raise ValueError("Table name has control characters.")
    return name


def path(value: str | None) -> str:
    """The root of a store: not blank, without control characters, and its last part is a name."""
    if value is None or not value.strip():
        raise ValueError("The path cannot be blank.")
    if any(ord(c) < 32 for c in value):
        raise ValueError("The path has control characters.")
    name = value.rstrip("/").rpartition("/")[2].rstrip(" .")
    if not name or name.endswith(":"):
        raise ValueError("The path must end with a name.")
    if name.partition(".")[0].upper() in DEVICES:
        raise ValueError(f"{name} is the name of a device.")
    return value.rstrip("/")


def field_name(name: str | None) -> str:
    if not name:
        raise ValueError("Index field name cannot be empty.")
    return name


def key_text(key: object) -> str:
    """A key in canonical form: lowercase 8-4-4-4-12."""
    return str(key if isinstance(key, uuid.UUID) else uuid.UUID(str(key)))


def payload(data: str | bytes | bytearray | None) -> bytes:
    if data is None:
        raise ValueError("Data cannot be null.")
    raw = data.encode() if isinstance(data, str) else bytes(data)
    if not raw:
        raise ValueError("Data cannot be empty.")
    return raw


def paging(skip: int | None, take: int | None) -> None:
    if skip is not None and skip < 0:
        raise ValueError("skip cannot be negative.")
    if take is not None and take < 0:
        raise ValueError("take cannot be negative.")
