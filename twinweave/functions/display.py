"""Display texts of media properties, as expressions; numbers are rounded half up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units of file sizes, by powers of 1024.
SIZE_UNITS = ("B", "KB", "MB", "GB", "TB", "PB")
#: Texts of flash codes.
FLASH_MODES = {
    0x00: "No Flash",
    0x01: "Flash Fired",
    0x05: "Flash Fired, Strobe Return Light Not Detected",
    0x07: "Flash Fired, Strobe Return Light Detected",
    0x08: "On, Did Not Fire",
    0x09: "Flash Fired, Compulsory",
    0x0D: "Flash Fired, Compulsory, Return Light Not Detected",
    0x0F: "Flash Fired, Compulsory, Return Light Detected",
    0x10: "Off, Did Not Fire",
    0x14: "Off, Did Not Fire, Return Light Not Detected",
    0x18: "Auto, Did Not Fire",
    0x19: "Flash Fired, Auto",
    0x1D: "Flash Fired, Auto, Return Light Not Detected",
    0x1F: "Flash Fired, Auto, Return Light Detected",
    0x20: "No Flash Function",
    0x30: "Off, No Flash Function",
    0x41: "Flash Fired, Red-Eye Reduction",
    0x45: "Flash Fired, Red-Eye Reduction, Return Light Not Detected",
    0x47: "Flash Fired, Red-Eye Reduction, Return Light Detected",
    0x49: "Flash Fired, Compulsory, Red-Eye Reduction",
    0x4D: "Flash Fired, Compulsory, Red-Eye Reduction, Return Light Not Detected",
    0x4F: "Flash Fired, Compulsory, Red-Eye Reduction, Return Light Detected",
    0x50: "Off, Red-Eye Reduction",
    0x58: "Auto, Did Not Fire, Red-Eye Reduction",
    0x59: "Flash Fired, Auto, Red-Eye Reduction",
    0x5D: "Flash Fired, Auto, Red-Eye Reduction, Return Light Not Detected",
    0x5F: "Flash Fired, Auto, Red-Eye Reduction, Return Light Detected",
}
#: Names of audio channel counts.
CHANNEL_NAMES = {
    0: "No Audio",
    1: "Mono",
    2: "Stereo",
    3: "2.1 Surround",
    4: "Quadraphonic",
    5: "4.1 Surround",
    6: "5.1 Surround",
    7: "6.1 Surround",
    8: "7.1 Surround",
    10: "7.1.2 Surround",
    12: "9.1.2 Surround",
}
#: Bits of a pixel by format; 24 for all others.
BITS_PER_PIXEL = {"Gray8": 8, "Gray16": 16, "Bgra8": 32, "Rgba8": 32, "Rgba16": 64}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lookup(table: dict, key: Column, default: Column) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), default)


def file_size_text(size: Column | str) -> Column:
    """Size by the largest unit below which it is not 1: bytes whole, others with one decimal."""
    n = _col(size).cast("long")
    out = F.format_string("%,d B", n)
    for power, unit in enumerate(SIZE_UNITS[1:], 1):
        # exact halves of a tenth round up, so the tenths are counted in whole numbers
        tenths = F.floor((n.cast("decimal(38,0)") * 20 + F.lit(1024**power)) / F.lit(2 * 1024**power)).cast("long")
        text = F.concat(F.format_string("%,d", F.floor(tenths / 10).cast("long")), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {unit}"))
        out = F.when(n >= 1024**power, text).otherwise(out)
    return out


def resolution_text(width: Column | str, height: Column | str) -> Column:
    return F.concat(_col(width).cast("string"), F.lit(" × "), _col(height).cast("string"))


def pixel_count(width: Column | str, height: Column | str) -> Column:
    return _col(width).cast("long") * _col(height).cast("long")


def megapixels(width: Column | str, height: Column | str) -> Column:
    return pixel_count(width, height) / F.lit(1e6)


def megapixels_text(width: Column | str, height: Column | str) -> Column:
    return F.format_string("%.1f MP", megapixels(width, height))


def aspect_ratio(width: Column | str, height: Column | str) -> Column:
    w, h = _col(width), _col(height)
    return F.when(h > 0, w.cast("double") / F.nullif(h, F.lit(0)).cast("double")).otherwise(F.lit(0.0))


def orientation(width: Column | str, height: Column | str) -> Column:
    w, h = _col(width), _col(height)
    return F.when(w > h, "Landscape").when(w < h, "Portrait").otherwise("Square")


def focal_length_text(mm: Column | str) -> Column:
    return F.when(_col(mm).isNull(), "").otherwise(F.format_string("%.0fmm", _col(mm).cast("double")))


def aperture_text(f: Column | str) -> Column:
    return F.when(_col(f).isNull(), "").otherwise(F.format_string("f/%.1f", _col(f).cast("double")))


def exposure_text(seconds: Column | str) -> Column:
    """One second or more as seconds, less as a fraction with a whole denominator."""
    s = _col(seconds).cast("double")
    below = F.concat(F.lit("1/"), F.floor(F.lit(1.0) / F.nullif(s, F.lit(0.0))).cast("long").cast("string"), F.lit("s"))
    return F.when(s.isNull() | (s <= 0), "").when(s >= 1, F.format_string("%.1fs", s)).otherwise(below)


def iso_text(iso: Column | str) -> Column:
    return F.when(_col(iso).isNull(), "").otherwise(F.concat(F.lit("ISO "), _col(iso).cast("string")))


def flash_fired(code: Column | str) -> Column:
    return _col(code).cast("int").bitwiseAND(F.lit(1)) == 1


def flash_text(code: Column | str) -> Column:
    c = _col(code).cast("int")
    return F.when(c.isNull(), "").otherwise(_lookup(FLASH_MODES, c, F.concat(F.lit("Unknown ("), c.cast("string"), F.lit(")"))))


def white_balance_text(code: Column | str) -> Column:
    return F.when(_col(code).isNull(), F.lit(None)).when(_col(code) == 0, "Auto").otherwise("Manual")


def authors_text(authors: Column | str) -> Column:
    return F.coalesce(F.array_join(_col(authors), ", "), F.lit(""))


def gps_text(latitude: Column | str, longitude: Column | str) -> Column:
    a, b = _col(latitude).cast("double"), _col(longitude).cast("double")
    return F.when(a.isNull() | b.isNull(), "").otherwise(F.format_string("%.6f, %.6f", a, b))


def duration_text(seconds: Column | str) -> Column:
    """h:mm:ss from one hour on (hours of a day), else m:ss."""
    s = F.floor(_col(seconds)).cast("long")
    ms = F.concat(F.lpad(((s % 3600) / 60).cast("long").cast("string"), 2, "0"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))
    short = F.concat(((s % 3600) / 60).cast("long").cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))
    return F.when(s >= 3600, F.concat(((s / 3600).cast("long") % 24).cast("string"), F.lit(":"), ms)).otherwise(short)


def total_frames(seconds: Column | str, rate: Column | str) -> Column:
    return (_col(seconds).cast("double") * _col(rate).cast("double")).cast("long")


def bitrate_text(bits: Column | str) -> Column:
    b = _col(bits).cast("double")
    kilo = b / 1000
    return F.when(b.isNull() | (b <= 0), "").when(kilo < 1000, F.format_string("%.0f kbps", kilo)).otherwise(F.format_string("%.1f Mbps", kilo / 1000))


def channels_text(n: Column | str) -> Column:
    c = _col(n).cast("int")
    return _lookup(CHANNEL_NAMES, c, F.concat(c.cast("string"), F.lit(" channels")))


def percent_text(share: Column | str) -> Column:
    """A similarity between 0 and 1 as percent with one decimal."""
    return F.format_string("%.1f%%", _col(share).cast("double") * 100)


def progress_percent(current: Column | str, total: Column | str) -> Column:
    return F.when(_col(total) > 0, _col(current).cast("double") / F.nullif(_col(total), F.lit(0)).cast("double") * 100).otherwise(F.lit(0.0))


def progress_value(current: Column | str, total: Column | str) -> Column:
    """Progress from 0 to 1; 0 where there is nothing to do."""
    return F.when(_col(total) > 0, _col(current).cast("double") / F.nullif(_col(total), F.lit(0)).cast("double")).otherwise(F.lit(0.0))


def progress_complete(current: Column | str, total: Column | str) -> Column:
    return _col(current) >= _col(total)


def progress_text(operation: Column | str, current: Column | str, total: Column | str) -> Column:
    known = F.format_string("%s %,d/%,d (%.1f%%)", _col(operation), _col(current).cast("long"), _col(total).cast("long"), progress_percent(current, total))
    return F.when(_col(total) > 0, known).otherwise(_col(operation))


def tolerance_label(tolerance: Column | str) -> Column:
    t = _col(tolerance)
    return F.when(t < 20, "Very Conservative").when(t < 50, "Conservative").when(t < 100, "Balanced").when(t < 150, "Aggressive").otherwise("Very Aggressive")


def model_name(is_bundled: Column | str, path: Column | str, bundled: str = "bundled model", none: str = "no model selected") -> Column:
    """The bundled model's name, else the file's without its extension, else that there is none."""
    name = F.regexp_replace(F.regexp_extract(_col(path), r"([^/\\\\]*)$", 1), r"\.[^.]*$", "")
    return F.when(_col(is_bundled), bundled).when(_col(path).isNull() | (_col(path) == ""), none).otherwise(name)


def summary_text(items: Column | str, groups: Column | str, duplicates: Column | str, singles: Column | str) -> Column:
    """One sentence about a result."""
    found = F.format_string("Found %d duplicate group(s) containing %d item(s). %d item(s) unique.", _col(groups), _col(duplicates), _col(singles))
    return F.when(_col(items) == 0, "No items were analyzed.").when(_col(groups) == 0, F.format_string("No duplicate groups found. All %d items are unique.", _col(items))).otherwise(found)


def bits_per_pixel(pixel_format: Column | str) -> Column:
    return _lookup(BITS_PER_PIXEL, _col(pixel_format), F.lit(24))
