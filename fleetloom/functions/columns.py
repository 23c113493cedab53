"""Column functions of the fleet domain, all built from Spark's own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the vehicle identification number: digits of letters, and weights by position.
VIN_LETTERS, VIN_DIGITS = "ABCDEFGHJKLMNPRSTUVWXYZ", "12345678123457923456789"
VIN_WEIGHTS = (8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2)
#: Fixed alphabet of geohashes.
GEOHASH = "0123456789bcdefghjkmnpqrstuvwxyz"
EARTH_KM = 6371.0088


def round_half_away(c: Column, digits: int) -> Column:
    k = float(10**digits)
    return F.signum(c) * F.floor(F.abs(c) * k + 0.5) / k


def once(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c), with c evaluated once however often use names it, also where the optimiser writes expressions out."""
    return F.transform(F.array(c), use)[0]


def vin_check_digit(vin: Column) -> Column:
    """The digit (or X) that belongs at position 9."""
    total = once(F.translate(vin, VIN_LETTERS, VIN_DIGITS), lambda plain: sum((F.substring(plain, i + 1, 1).try_cast("int") * w for i, w in enumerate(VIN_WEIGHTS) if w), F.lit(0)))
    return F.substring(F.lit("0123456789X"), total % 11 + 1, F.lit(1))


def vin_valid(vin: Column) -> Column:
    return F.coalesce(vin.rlike("^[A-HJ-NPR-Z0-9]{17}$") & (F.substring(vin, 9, 1) == vin_check_digit(vin)), F.lit(False))


def vin_build(template: Column) -> Column:
    """The template with its right check digit at position 9."""
    return F.concat(F.substring(template, 1, 8), vin_check_digit(template), F.substring(template, 10, 8))


def dtc_encode(code: Column) -> Column:
    """Four hexadecimal digits of a trouble code; null if malformed."""
    ok = F.when(code.rlike("^[PCBU][0-3][0-9A-F]{3}$"), code)
    n = (F.position(F.substring(ok, 1, 1), F.lit("PCBU")) - 1) * 4 + F.substring(ok, 2, 1).cast("int")
    return F.concat(F.hex(n.cast("long")), F.substring(ok, 3, 3))


def dtc_decode(raw: Column) -> Column:
    """Trouble code of four hexadecimal digits: two bits of system, two of type, three digits; null if malformed."""
    n = F.conv(F.when(raw.rlike("^[0-9A-Fa-f]{4}$"), raw), 16, 10).cast("int")
    system = F.substring(F.lit("PCBU"), F.shiftright(n, 14) + 1, F.lit(1))
    return F.concat(system, F.shiftright(n, 12).bitwiseAND(3).cast("string"), F.lpad(F.hex(n.bitwiseAND(4095)), 3, "0"))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(a))


def _geohash_axes(precision: int) -> tuple[int, int]:
    """Bits of longitude and of latitude."""
    return (5 * precision + 1) // 2, 5 * precision // 2


def _geohash_of(x: Column, y: Column, precision: int) -> Column:
    """Bits of longitude and latitude in turn, five a character."""
    wide, high = _geohash_axes(precision)
    out = []
    for c in range(precision):
        value = F.lit(0).cast("long")
        for b in range(5 * c, 5 * c + 5):
            axis, left = (x, wide - 1 - b // 2) if b % 2 == 0 else (y, high - 1 - b // 2)
            value = value * 2 + F.shiftright(axis, left).bitwiseAND(1)
        out.append(F.substring(F.lit(GEOHASH), (value + 1).cast("int"), F.lit(1)))
    return F.concat(*out)


def geohash(lat: Column, lon: Column, precision: int) -> Column:
    wide, high = (1 << n for n in _geohash_axes(precision))
    x = F.least(F.floor((lon + 180) / 360 * float(wide)), F.lit(wide - 1)).cast("long")
    y = F.least(F.floor((lat + 90) / 180 * float(high)), F.lit(high - 1)).cast("long")
    return _geohash_of(x, y, precision)


def geohash_cell(hash_: Column, precision: int) -> tuple[Column, Column]:
    """Numbers of the cell east of -180 and north of -90 degrees; null if it isn't a geohash of that precision."""
    hash_ = F.when(hash_.rlike(f"^[{GEOHASH}]{{{precision}}}$"), hash_)
    axes = [F.lit(0).cast("long"), F.lit(0).cast("long")]
    for c in range(precision):
        value = F.instr(F.lit(GEOHASH), F.substring(hash_, c + 1, 1)) - 1
        for b in range(5):
            at = (5 * c + b) % 2
            axes[at] = axes[at] * 2 + F.shiftright(value, 4 - b).bitwiseAND(1)
    return axes[0], axes[1]


def _of_cell(hash_: Column, precision: int, result: Callable[[Column, Column], Column]) -> Column:
    """result of the numbers of the cell, which are worked out once however often it names them; null for no geohash."""
    x, y = geohash_cell(hash_, precision)
    found = F.transform(F.array(F.struct(x.alias("x"), y.alias("y"))), lambda c: F.when(c["x"].isNotNull(), result(c["x"], c["y"])))
    return F.element_at(found, 1)


def geohash_bounds(hash_: Column, precision: int) -> Column:
    """Struct of south, north, west and east of the cell."""
    wide, high = (float(1 << n) for n in _geohash_axes(precision))
    edges = lambda x, y: F.struct((y / high * 180 - 90).alias("south"), ((y + 1) / high * 180 - 90).alias("north"), (x / wide * 360 - 180).alias("west"), ((x + 1) / wide * 360 - 180).alias("east"))
    return _of_cell(hash_, precision, edges)


def geohash_centre(hash_: Column, precision: int) -> Column:
    """Struct of lat and lon of the middle of the cell."""
    wide, high = (float(1 << n) for n in _geohash_axes(precision))
    return _of_cell(hash_, precision, lambda x, y: F.struct(((y + 0.5) / high * 180 - 90).alias("lat"), ((x + 0.5) / wide * 360 - 180).alias("lon")))


def geohash_neighbours(hash_: Column, precision: int) -> Column:
    """The up to eight cells about a cell, from south-west; round the globe by longitude, none beyond the poles."""
    wide, high = (1 << n for n in _geohash_axes(precision))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for j in (-1, 0, 1) for i in (-1, 0, 1) if i or j])

    def around(x: Column, y: Column) -> Column:
        cells = F.filter(F.transform(steps, lambda s: F.struct(F.pmod(x + s["i"], F.lit(wide)).alias("x"), (y + s["j"]).alias("y"))), lambda c: c["y"].between(0, high - 1))
        return F.transform(cells, lambda c: _geohash_of(c["x"], c["y"], precision))

    return _of_cell(hash_, precision, around)


def base64url(text: Column) -> Column:
    """URL-safe base 64 without padding."""
    return F.translate(F.regexp_replace(F.base64(F.encode(text, "UTF-8")), "=+$", ""), "+/", "-_")


def uuid5(namespace: str, name: Column) -> Column:
    """The name-based UUID (version 5) of name in a namespace, itself a UUID."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    part = lambda a, n: F.substring(h, a, n)
    variant = F.substring(F.lit("89ab"), (F.conv(part(17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def without_key(json: Column, key: str) -> Column:
    """A JSON object without one of its keys; null for what is no object."""
    fields = F.from_json(json, "map<string, variant>")
    return F.to_json(F.map_filter(fields, lambda k, _: k != key))
