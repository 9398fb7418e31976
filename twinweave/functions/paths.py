"""Path and name expressions: parts of a path, media kinds by extension, folder name rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions by kind.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".gif", ".tiff", ".tif", ".webp")
VIDEO_EXTENSIONS = (".mp4", ".avi", ".mov", ".wmv", ".mkv", ".flv", ".webm", ".m4v")
MODEL_EXTENSIONS = (".onnx",)
#: Names that a folder may not have.
RESERVED_NAMES = ("CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10)))
#: Characters that a folder name may not hold.
FORBIDDEN = '\\/:*?"<>|'
LONGEST_NAME = 255
_FORBIDDEN_CLASS = r'[\\/:*?"<>|]'
_CONTROL = r"[\x00-\x1f]"
#: White space of Unicode, as names are trimmed of it.
_SPACE = r"[\x09-\x0d\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def file_name(path: Column | str) -> Column:
    return F.regexp_extract(_col(path), r"([^/\\]*)$", 1)


def directory(path: Column | str) -> Column:
    return F.regexp_replace(_col(path), r"[/\\][^/\\]*$", "")


def extension(path: Column | str) -> Column:
    """Lower-case extension with its dot, or an empty string."""
    return F.lower(F.regexp_extract(_col(path), r"(\.[^./\\]+)$", 1))


def stem(path: Column | str) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def shown_extension(path: Column | str) -> Column:
    """Upper-case extension without the dot."""
    return F.upper(F.ltrim(extension(path), F.lit(".")))


def is_image(path: Column | str) -> Column:
    return extension(path).isin(*IMAGE_EXTENSIONS)


def is_video(path: Column | str) -> Column:
    return extension(path).isin(*VIDEO_EXTENSIONS)


def is_media(path: Column | str) -> Column:
    return extension(path).isin(*IMAGE_EXTENSIONS, *VIDEO_EXTENSIONS)


def is_model(path: Column | str) -> Column:
    return extension(path).isin(*MODEL_EXTENSIONS)


def media_type(path: Column | str, strict: bool = False) -> Column:
    """Image or Video by extension; another one is null, or an error if strict."""
    other = F.raise_error(F.concat(F.lit("unsupported media: "), _col(path))).cast("string") if strict else F.lit(None).cast("string")
    return F.when(is_image(path), "Image").when(is_video(path), "Video").otherwise(other)


def path_key(path: Column | str) -> Column:
    """What makes paths the same file: case does not count."""
    return F.lower(_col(path))


def _blank(name: Column) -> Column:
    return name.isNull() | name.rlike(rf"^{_SPACE}*\z")


def _trimmed(name: Column) -> Column:
    return F.regexp_replace(name, rf"^{_SPACE}+|{_SPACE}+\z", "")


def is_valid_name(name: Column | str) -> Column:
    """Whether a trimmed folder name is allowed; an error for a blank one."""
    name = _col(name)
    t = _trimmed(name)
    ok = (F.length(t) <= LONGEST_NAME) & ~t.rlike(_FORBIDDEN_CLASS) & ~t.rlike(_CONTROL) & ~t.rlike(r"[. ]$") & ~F.upper(t).isin(*RESERVED_NAMES)
    return F.when(_blank(name), F.raise_error(F.lit("a name is blank")).cast("boolean")).otherwise(ok)


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def sanitised_name(name: Column | str) -> Column:
    """The nearest allowed folder name, or null if nothing is left; an error for a blank name."""

    def cut(t: Column) -> Column:
        return F.when(F.length(t) > LONGEST_NAME, F.regexp_replace(F.substring(t, 1, LONGEST_NAME), r"[. ]+$", "")).otherwise(t)

    def unreserved(t: Column) -> Column:
        return F.when(F.upper(t).isin(*RESERVED_NAMES), F.concat(t, F.lit("_"))).otherwise(t)

    def clean(n: Column) -> Column:
        t = F.regexp_replace(F.regexp_replace(F.regexp_replace(_trimmed(n), _FORBIDDEN_CLASS, "_"), _CONTROL, ""), r"[. ]+$", "")
        return _let(_let(_let(t, unreserved), cut), lambda t: F.when(_blank(t), F.lit(None)).otherwise(t))

    return _let(_col(name), lambda n: F.when(_blank(n), F.raise_error(F.lit("a name is blank")).cast("string")).otherwise(clean(n)))


def renamed(old: Column | str, wanted: Column | str) -> Column:
    """The name after an edit: blank and unchanged edits are ignored, invalid ones sanitised, else the old one stays."""
    old, wanted = _col(old), _col(wanted)

    def edit(w: Column) -> Column:
        sound = F.when(_blank(w), F.lit("x")).otherwise(w)  # only for branches that are not taken
        return F.when(_blank(w) | (_trimmed(w) == old), old).when(is_valid_name(sound), _trimmed(w)).otherwise(F.coalesce(sanitised_name(sound), old))

    return _let(wanted, edit)
