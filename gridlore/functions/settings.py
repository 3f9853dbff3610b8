"""Configuration of sites: as plain Python for one, as columns for tables of them."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any
from urllib.parse import urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlore.functions.text import strip

# Names of this machine.
LOOPBACK = frozenset({"localhost", "127.0.0.1", "::1", "0.0.0.0"})


def deep_merge(base: Mapping[str, Any], override: Mapping[str, Any] | None) -> dict[str, Any]:
    """Mappings merge key by key; everything else in override replaces, lists whole."""
    out = dict(base)
    for key, value in (override or {}).items():
        old = out.get(key)
        out[key] = deep_merge(old, value) if isinstance(old, Mapping) and isinstance(value, Mapping) else value
    return out


def merged_struct(base: Column, override: Column, schema: T.StructType) -> Column:
    """deep_merge for struct columns of one schema: structs merge field by field, everything else in override replaces, lists
    whole. A null field of override is one that isn't named, and so is an override that is null."""

    def field(f: T.StructField) -> Column:
        old, new = base.getField(f.name), override.getField(f.name)
        inner = merged_struct(old, new, f.dataType) if isinstance(f.dataType, T.StructType) else F.coalesce(new, old)
        return inner.alias(f.name)

    return F.struct(*[field(f) for f in schema.fields])


def engine_url(url: str | None, default: str, reserved_port: int = 8000, any_host: bool = False) -> str:
    """Address with a scheme and without trailing slashes; the reserved port of this machine is sent to the default.

    any_host sends that port of every host there, for callers that serve pages from a host of their own.
    """
    raw = (url or "").strip().rstrip("/")
    if not raw:
        return default
    try:
        parts = urlsplit(raw if raw.lower().startswith(("http://", "https://")) else f"http://{raw}")
        if parts.port == reserved_port and (any_host or (parts.hostname or "") in LOOPBACK):
            return default
    except ValueError:
        return raw
    usual = {"http": 80, "https": 443}[parts.scheme.lower()]
    host = f"[{parts.hostname}]" if ":" in (parts.hostname or "") else parts.hostname
    origin = f"{parts.scheme.lower()}://{host}" + ("" if parts.port in (None, usual) else f":{parts.port}")
    return origin + parts.path.rstrip("/")


URL = r"(?i)^(https?)://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#\[\]]*)(?::([0-9]*))?(/[^?#]*)?(?:[?#].*)?$"


def engine_url_of(url: Column, default: str, reserved_port: int = 8000, any_host: bool = False) -> Column:
    """engine_url() of a column."""
    raw = F.regexp_replace(strip(F.coalesce(url, F.lit(""))), "/+$", "")
    whole = F.when(F.lower(raw).rlike("^https?://"), raw).otherwise(F.concat(F.lit("http://"), raw))

    def rewritten(u: Column) -> Column:
        part = lambda k: F.regexp_extract(u["whole"], URL, k)
        scheme, host = F.lower(part(1)), F.lower(part(2))
        port = F.try_to_number(F.nullif(part(3), F.lit("")), F.lit("999999")).cast("int")
        name = F.regexp_replace(host, r"^\[|\]$", "")
        reserved = (port == reserved_port) & (F.lit(any_host) | name.isin(*sorted(LOOPBACK)))
        usual = F.when(scheme == "http", 80).otherwise(443)
        shown = F.when(port.isNull() | (port == usual), "").otherwise(F.concat(F.lit(":"), port.cast("string")))
        said = F.concat(scheme, F.lit("://"), host, shown, F.regexp_replace(part(4), "/+$", ""))
        bad = ~u["whole"].rlike(URL) | F.coalesce(port > 65535, F.char_length(part(3)) > 0)
        return F.when(u["raw"] == "", default).when(bad, u["raw"]).when(F.coalesce(reserved, F.lit(False)), default).otherwise(said)

    return F.get(F.transform(F.array(F.struct(raw.alias("raw"), whole.alias("whole"))), rewritten), F.lit(0))


IDLE = "idle"  # before the first refresh


def connection_state(demo: bool, persisted_ok: bool, health_ok: bool, snapshot_ok: bool, has_rows: bool) -> str:
    """State after a refresh. Stored rows hide an engine that is away or only half there."""
    if demo:
        return "demo" if persisted_ok else "offline"
    if health_ok and snapshot_ok:
        return "connected"
    if has_rows:
        return "persisted"
    return "degraded" if health_ok else "offline"


def connection_state_of(demo: Column, persisted_ok: Column, health_ok: Column, snapshot_ok: Column, has_rows: Column) -> Column:
    """connection_state() of columns; a null flag is false."""
    demo, persisted_ok, health_ok, snapshot_ok, has_rows = (F.coalesce(c, F.lit(False)) for c in (demo, persisted_ok, health_ok, snapshot_ok, has_rows))
    live = F.when(health_ok & snapshot_ok, "connected").when(has_rows, "persisted").when(health_ok, "degraded").otherwise("offline")
    return F.when(demo & persisted_ok, "demo").when(demo, "offline").otherwise(live)


def shown_state_of(state: Column, refreshing: Column, demo: Column, silent: Column) -> Column:
    """state_while_refreshing() of columns, where a refresh runs."""
    return F.when(refreshing & ~silent & (demo | (state == IDLE)), "loading").otherwise(state)


def state_while_refreshing(state: str, demo: bool, silent: bool) -> str:
    """State shown while a refresh runs: `loading` on the first one (in demo mode on each), unless it is silent."""
    return "loading" if not silent and (demo or state == IDLE) else state


def is_connected(state: str) -> bool:
    return state in {"connected", "demo", "persisted"}
