"""Paths, globs, sizes and times as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_PATH = 65535
#: names that one system reserves (fixed values)
DEVICES = r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\.|$)"


def glob_regex(glob: str) -> str:
    """* ? [] [!] and backslash; * crosses slashes, and the whole name must match."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out += re.escape(glob[i])
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end]
            negate, body = body[:1] == "!", body.lstrip("!") if body[:1] == "!" else body
            out += "[" + ("^" if negate else "") + body.replace("\\", "\\\\").replace("^", "\\^") + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"^(?:{out})$"


def selected(name: Column, include: list[str], exclude: list[str]) -> Column:
    """An include match selects; otherwise selected unless there are includes or an exclude matches."""
    hit = lambda globs: F.coalesce(*[F.when(name.rlike("(?s)" + glob_regex(g)), True) for g in globs], F.lit(False)) if globs else F.lit(False)
    return hit(include) | (F.lit(not include) & ~hit(exclude))


def _component_status(p: Column) -> Column:
    """Why a component isn't valid, or null. Of control and reserved characters, the first one in it tells."""
    bad = F.regexp_extract(p, r'([\x00-\x1f<>:"|?*\\])', 1)
    return (
        F.when(p == "", "empty_component").when(p == ".", "dot").when(p == "..", "dot_dot")
        .when(bad != "", F.when(bad < " ", "control").otherwise("reserved_char"))
        .when(p.rlike("[. ]$"), "trailing_dot_space").when(p.rlike(DEVICES), "device")
    )


def path_status(name: Column) -> Column:
    """The first reason why a path isn't valid, or ok: what holds for the whole path, then the first component that has one."""
    parts = F.transform(F.split(name, "/", -1), _component_status)
    return (
        F.when(F.octet_length(name) == 0, "empty").when(F.octet_length(name) > MOST_PATH, "too_long").when(name.startswith("/"), "absolute")
        .when(name.rlike(r"^[\x00-\x7f]:"), "drive").when(name.startswith("\\\\"), "unc").when(name.endswith("/"), "trailing_slash")
        .otherwise(F.coalesce(F.get(F.filter(parts, lambda s: s.isNotNull()), F.lit(0)), F.lit("ok")))
    )


def path_parts(path: Column) -> tuple[Column, Column]:
    """Folder and base name; both slashes separate. A bare name's folder is a dot, and the root keeps its slash."""
    base = F.regexp_extract(path, r"(?s)([^/\\]*)$", 1)
    n = F.length(path) - F.length(base)
    return F.when(n == 0, ".").otherwise(F.substring(path, F.lit(1), F.greatest(n - 1, F.lit(1)))), base


def path_join(folder: Column, name: Column) -> Column:
    return F.when((folder == "") | folder.rlike(r"[/\\]$"), F.concat(folder, name)).otherwise(F.concat(folder, F.lit("/"), name))


def link_target_ok(target: Column) -> Column:
    return (F.octet_length(target) > 0) & (F.octet_length(target) <= MOST_PATH) & ~F.contains(target, F.lit("\x00"))


def size_bytes(text: Column) -> Column:
    """10, 4K, 1.5M (1024s) or 4KB (1000s); a fraction needs a unit; null where it is no size."""
    t = F.lower(F.trim(text))
    number, fraction, unit = (F.regexp_extract(t, r"^(\d+)(\.\d+)?([kmgt]?)(b?)$", i) for i in (1, 2, 3))
    bytes_ = F.regexp_extract(t, r"^(\d+)(\.\d+)?([kmgt]?)(b?)$", 4)
    step = F.when(bytes_ == "b", 1000).otherwise(1024)
    power = F.when(unit == "k", 1).when(unit == "m", 2).when(unit == "g", 3).when(unit == "t", 4).otherwise(0)
    scale = F.lit(1).cast("decimal(20,0)")
    for p in (1, 2, 3, 4):
        scale = F.when(power == p, F.when(bytes_ == "b", F.lit(1000**p)).otherwise(F.lit(1024**p)).cast("decimal(20,0)")).otherwise(scale)
    ok = (number != "") & ~((fraction != "") & (unit == ""))
    return F.when(ok, F.floor(F.concat(number, fraction).cast("decimal(18,6)") * scale).cast("long"))


UNITS = ("KiB", "MiB", "GiB", "TiB", "PiB")


def human_size(n: Column, largest: str = UNITS[-1]) -> Column:
    """Truncated to one decimal: 1536 is 1.5 KiB. Whatever is larger than `largest` is given in it."""
    n = n.cast("long")
    out = F.concat(n.cast("string"), F.lit(" B"))
    for i, unit in enumerate(UNITS[: UNITS.index(largest) + 1], 1):
        tenth = F.shiftright(n.bitwiseAND(F.lit(1024**i - 1)) * 10, 10 * i)
        shown = F.concat(F.shiftright(n, 10 * i).cast("string"), F.lit("."), tenth.cast("string"), F.lit(f" {unit}"))
        out = F.when(n >= 1024**i, shown).otherwise(out)
    return out


def grouped(n: Column) -> Column:
    """1234567 is 1,234,567."""
    return F.format_number(n, 0)


def exponent_form(n: Column) -> Column:
    """Three leading digits, cut off: 1234567 is 1.23e6; numbers below 100 as they are."""
    digits = n.cast("string")
    return F.when(n < 100, digits).otherwise(F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, 2, 2), F.lit("e"), (F.length(digits) - 1).cast("string")))


def iso_time(ns: Column) -> Column:
    """Epoch nanoseconds, rounded down to seconds; null is a dash."""
    return F.coalesce(F.date_format(F.timestamp_seconds(F.floor(ns / 1_000_000_000)), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("-"))


def mode_octal(mode: Column) -> Column:
    return F.lpad(F.conv(mode.bitwiseAND(F.lit(4095)).cast("string"), 10, 8), 4, "0")


def type_letter(kind: Column) -> Column:
    return F.when(kind == "directory", "d").when(kind == "symlink", "l").when(kind == "hardlink", "h").otherwise("f")


def attributes(mode: Column, raw_name: Column) -> Column:
    """Bits: 1 executable, 2 set-id, 4 name that isn't UTF-8."""
    return F.when(mode.bitwiseAND(F.lit(0o111)) != 0, 1).otherwise(0) + F.when(mode.bitwiseAND(F.lit(0o6000)) != 0, 2).otherwise(0) + F.when(raw_name, 4).otherwise(0)
