"""Display formats and path helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Size units, base 1024.
SIZE_UNITS = ["B", "KB", "MB", "GB", "TB"]

# Extension classes (our mapping; the class names are given).
FILE_CLASSES = {
    "IMAGE": ["jpg", "jpeg", "png", "gif", "webp", "bmp"],
    "VIDEO": ["mp4", "mkv", "avi", "mov", "webm"],
    "AUDIO": ["mp3", "wav", "flac", "ogg", "m4a"],
    "DOCUMENT": ["pdf", "doc", "docx", "txt", "xls", "xlsx", "ppt", "pptx", "md"],
}


def format_bytes(size: Column) -> Column:
    """`1536` -> `1.5 KB`."""
    value = size.cast("double")
    out = None
    for power, unit in enumerate(SIZE_UNITS):
        text = F.format_string(f"%.1f {unit}", value / float(1024**power))
        if power == len(SIZE_UNITS) - 1:
            return out.otherwise(text)
        test = value < float(1024 ** (power + 1))
        out = F.when(test, text) if out is None else out.when(test, text)


def format_count(number: Column) -> Column:
    """`1500` -> `1.5K`, `2500000` -> `2.5M`."""
    return (
        F.when(number >= 1_000_000, F.format_string("%.1fM", number / 1_000_000.0))
        .when(number >= 1_000, F.format_string("%.1fK", number / 1_000.0))
        .otherwise(number.cast("string"))
    )


def _whole(value: Column, unit: int) -> Column:
    """Whole units in a non-negative count, as text."""
    return F.floor(value / unit).cast("bigint").cast("string")


def format_age(when: Column, as_of: Column) -> Column:
    """Age in m/h/d/w of an epoch-millisecond column; zero means never."""
    age = as_of - when
    return (
        F.when(when == 0, F.lit("Never"))
        .when(age < 60 * 60_000, F.concat(_whole(age, 60_000), F.lit("m ago")))
        .when(age < 24 * 3_600_000, F.concat(_whole(age, 3_600_000), F.lit("h ago")))
        .when(age < 7 * 86_400_000, F.concat(_whole(age, 86_400_000), F.lit("d ago")))
        .otherwise(F.concat(_whole(age, 7 * 86_400_000), F.lit("w ago")))
    )


def format_age_short(when: Column, as_of: Column) -> Column:
    """Variant with `Just now` and without weeks."""
    age = as_of - when
    return (
        F.when(age < 60_000, F.lit("Just now"))
        .when(age < 3_600_000, F.concat(_whole(age, 60_000), F.lit("m ago")))
        .when(age < 86_400_000, F.concat(_whole(age, 3_600_000), F.lit("h ago")))
        .otherwise(F.concat(_whole(age, 86_400_000), F.lit("d ago")))
    )


def format_uptime(seconds: Column) -> Column:
    """`93784` -> `1d 2h 3m`."""
    days, hours, minutes = (
        _whole(seconds, 86_400),
        _whole(seconds % 86_400, 3_600),
        _whole(seconds % 3_600, 60),
    )
    return (
        F.when(seconds >= 86_400, F.concat(days, F.lit("d "), hours, F.lit("h "), minutes, F.lit("m")))
        .when(seconds >= 3_600, F.concat(hours, F.lit("h "), minutes, F.lit("m")))
        .otherwise(F.concat(minutes, F.lit("m")))
    )


def title_service(name: Column) -> Column:
    """`backup-engine` -> `Backup Engine`; only first letters change."""
    words = F.transform(
        F.split(name, "[-_]"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))
    )
    return F.array_join(words, " ")


def parent_path(path: Column) -> Column:
    """`/a/b/c` -> `/a/b`; a root entry's parent is `/`."""
    parent = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(parent == "", F.lit("/")).otherwise(parent)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-case text after the last dot of the base name; empty when there is none."""
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def join_path(parent: Column, name: Column) -> Column:
    return F.when(parent == "", name).otherwise(F.concat_ws("/", parent, name))


def tenant_root(tenant: Column) -> Column:
    return F.concat(F.lit("/data/"), tenant.cast("string"))


def permission_text(readable: Column, writable: Column, executable: Column) -> Column:
    def flag(test: Column, mark: str) -> Column:
        return F.when(test, F.lit(mark)).otherwise(F.lit("-"))

    return F.concat(flag(readable, "r"), flag(writable, "w"), flag(executable, "x"))


def file_class(path: Column, is_directory: Column | None = None) -> Column:
    """FOLDER, IMAGE, VIDEO, AUDIO, DOCUMENT or OTHER."""
    ext = extension(path)
    out = F.when(is_directory if is_directory is not None else F.lit(False), F.lit("FOLDER"))
    for name, members in FILE_CLASSES.items():
        out = out.when(ext.isin(members), F.lit(name))
    return out.otherwise(F.lit("OTHER"))


def glob_pattern(glob: str) -> str:
    """A path glob as a regular expression; `*` matches any text, path separators too."""
    out = []
    for char in glob:
        if char == "*":
            out.append(".*")
        elif char == "?":
            out.append(".")
        elif char.isalnum() or char in "/_-":
            out.append(char)
        else:
            out.append("\\" + char)
    return "(^|/)" + "".join(out) + "$"
