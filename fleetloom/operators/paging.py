"""Pages and filters of list endpoints: keyset cursors, prefix search, optional filters, validity, argument guards."""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Sequence
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import base64url

MOST = 200


def size(limit: int, least: int = 1, most: int = MOST) -> int:
    if not least <= limit <= most:
        raise ValueError(f"a page has {least} to {most} rows")
    return limit


def cursor(at: Column, id_: Column) -> Column:
    """The cursor of a row: microseconds and id, in URL-safe base 64."""
    return base64url(F.concat(F.unix_micros(at.cast("timestamp")).cast("string"), F.lit("|"), id_.cast("string")))


def encode_cursor(at: datetime, id_: object) -> str:
    """The same for one row at the driver. at: UTC, with or without a zone."""
    since = at.replace(tzinfo=None) - datetime(1970, 1, 1)
    micros = (since.days * 86400 + since.seconds) * 1_000_000 + since.microseconds
    return base64.urlsafe_b64encode(f"{micros}|{id_}".encode()).decode().rstrip("=")


def decode_cursor(text: str) -> tuple[datetime, str]:
    try:
        micros, _, id_ = base64.b64decode(text + "=" * (-len(text) % 4), b"-_", validate=True).decode().partition("|")
        if not re.fullmatch(r"-?\d{1,18}", micros) or not id_:
            raise ValueError
        return datetime.fromtimestamp(int(micros) / 1_000_000, UTC).replace(tzinfo=None, microsecond=int(micros) % 1_000_000), id_
    except (ValueError, binascii.Error, UnicodeDecodeError) as e:
        raise ValueError("bad cursor") from e


def page_before(rows: DataFrame, at: str, id_: str, limit: int, after: str | None = None) -> DataFrame:
    """The newest rows by (at, id), or those after a cursor: one filter on the pair and a bounded top-n, no offset."""
    if after is not None:
        when, last = decode_cursor(after)
        kind = rows.schema[at].dataType.simpleString()
        rows = rows.where(F.struct(at, id_) < F.struct(F.lit(when.isoformat(sep=" ")).cast(kind), F.lit(last).cast(rows.schema[id_].dataType)))
    return rows.orderBy(F.col(at).desc(), F.col(id_).desc()).limit(size(limit))


def starts_with(column: str, typed: str, longest: int = 17) -> Column:
    """Prefix search as typed by a user: upper case, without wildcards. Spark pushes it to the scan."""
    text = typed.strip().upper()
    if len(text) > longest or re.search(r"[%_\\]", text):
        raise ValueError("invalid search")
    return F.col(column).startswith(text)


def chosen(allowed: dict[str, Sequence[str] | None], **given: str | None) -> Column:
    """The filters that are given; an empty or absent one is left out. allowed: values of each column, None for any."""
    condition = F.lit(True)
    for name, value in given.items():
        if name not in allowed or value and allowed[name] is not None and value not in allowed[name]:
            raise ValueError(f"invalid filter {name}")
        if value:
            condition = condition & (F.col(name) == value)
    return condition


def valid_at(now: Column, start: str, end: str) -> Column:
    """start <= now < end, an absent end being open."""
    return (F.col(start) <= now) & (F.col(end).isNull() | (F.col(end) > now))


def holds(json: str, wanted: dict[str, object]) -> Column:
    """Whether a JSON object has all of the wanted keys, with equal values (of numbers, strings, booleans)."""
    condition = F.lit(True)
    for key, value in wanted.items():
        kind = "boolean" if isinstance(value, bool) else "double" if isinstance(value, (int, float)) else "string"
        found = F.try_variant_get(F.try_parse_json(json), f"$['{key}']", kind)
        condition = condition & F.coalesce(found == F.lit(value), F.lit(False))
    return condition
