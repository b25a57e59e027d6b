"""File names, URL templates and the other text forms."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from .tiles import col, quadkey, shl, shr

#: File types and their extensions (fixed values). Files of the last two may hold several parts.
EXTENSIONS = {"mesh": "bin", "meta": "meta", "navtile": "nav", "mask": "mask", "atlas": "jpg", "ortho": "jpg"}
PARTED = ("atlas", "ortho")


def filename(lod, x, y, kind: str, part: Column | None = None) -> Column:
    """lod-x-y.ext, or lod-x-y-part.ext for file types of several parts."""
    bits = [col(lod).cast("string"), col(x).cast("string"), col(y).cast("string")]
    return F.concat(F.concat_ws("-", *bits, *([part.cast("string")] if part is not None else [])), F.lit("." + EXTENSIONS[kind]))


def padded_filename(lod, x, y, kind: str) -> Column:
    """lod-xxxxxxx-yyyyyyy.ext with seven digits each."""
    return F.concat(F.concat_ws("-", col(lod).cast("string"), F.lpad(col(x).cast("string"), 7, "0"), F.lpad(col(y).cast("string"), 7, "0")), F.lit("." + EXTENSIONS[kind]))


_NUMBER = "(0|[1-9][0-9]*)"
FILE_PATTERN = f"^{_NUMBER}-{_NUMBER}-{_NUMBER}(?:-{_NUMBER})?\\.([a-z]+)$"


def parsed_filename(name: Column) -> dict[str, Column]:
    """lod, x, y, part, ext; null for names that are no tile file: digits without leading zeros, a part for exactly the parted types."""
    got = [F.regexp_extract(name, FILE_PATTERN, i) for i in range(1, 6)]
    exts = sorted(set(EXTENSIONS.values()))
    parted = sorted({EXTENSIONS[k] for k in PARTED})
    fine = got[4].isin(exts) & (got[4].isin(parted) == (got[3] != ""))
    number = lambda c, t: F.when(fine, F.when(c != "", c.cast(t)))
    return {"lod": number(got[0], "int"), "x": number(got[1], "bigint"), "y": number(got[2], "bigint"), "part": number(got[3], "int"), "ext": F.when(fine, got[4])}


def id_hash(lod, x, y) -> Column:
    """A 32-bit mix of lod + x + y: two rounds of xor with the upper half and a product, then xor again."""
    mask, factor = 0xFFFFFFFF, 0x45D9F3B
    h = (col(lod).cast("bigint") + col(x) + col(y)).bitwiseAND(F.lit(mask).cast("bigint"))
    for _ in range(2):
        h = (F.shiftright(h, 16).bitwiseXOR(h) * F.lit(factor).cast("bigint")).bitwiseAND(F.lit(mask).cast("bigint"))
    return F.shiftright(h, 16).bitwiseXOR(h)


def alternative(lod, x, y, options: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (id_hash(lod, x, y) % len(options) + 1).cast("int"))


def hex7(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 7, "0")


def ppx(lod, x) -> Column:
    """x scaled to 28 bits, as seven hex digits."""
    return hex7(shl(x, F.greatest(F.lit(28) - col(lod), F.lit(0))))


def ppy(lod, y) -> Column:
    """(2^lod - 1 - y) scaled to 28 bits, as seven hex digits."""
    return hex7(shl(shl(1, lod) - 1 - col(y), F.greatest(F.lit(28) - col(lod), F.lit(0))))


def ms_digit(x, y) -> Column:
    return (col(y).bitwiseAND(3) * 2 + col(x).bitwiseAND(1)).cast("int")


def percent_encoded(text: Column) -> Column:
    """Percent encoding; a space is %20."""
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def template(text: str, tile: dict[str, Column], params: list[Column] = ()) -> Column:
    """Compiles a URL template once, on the driver, to a concatenation of columns.

    {lod} {x} {y} {loclod} {locx} {locy} {sub} {srs} {rf} and any other given variable; {alt(a,b,...)}; {ppx} {ppy}; {ms_digit};
    {quad} or {quad(loclod,locx,locy)}; {switch(var,k:v,...,*:default)}; {param(i)}, url-encoded. An unknown directive is put out
    without its braces.
    """
    lod, x, y = tile["lod"], tile["x"], tile["y"]
    fixed = {"ppx": lambda: ppx(lod, x), "ppy": lambda: ppy(lod, y), "ms_digit": lambda: ms_digit(x, y).cast("string"), "quad": lambda: quadkey(lod, x, y)}
    parts: list[Column] = []
    for bare, name, call, args in re.findall(r"([^{}]+)|\{(\w+)(\(([^{}]*)\))?\}", text):
        given = [a.strip() for a in args.split(",")] if call else []
        if bare:
            parts.append(F.lit(bare))
        elif name == "alt" and given:
            parts.append(alternative(lod, x, y, given))
        elif name == "quad" and len(given) == 3 and all(g in tile for g in given):
            parts.append(quadkey(*(tile[g] for g in given)))
        elif name in fixed and not call:
            parts.append(fixed[name]())
        elif name == "switch" and len(given) > 1 and given[0] in tile:
            parts.append(switch(tile[given[0]], dict(g.split(":", 1) for g in given[1:])))
        elif name == "param" and call and given[0].isdigit() and int(given[0]) < len(params):
            parts.append(percent_encoded(params[int(given[0])]))
        elif name in tile and not call:
            parts.append(tile[name].cast("string"))
        else:
            parts.append(F.lit(name + call))
    return F.concat(*parts) if parts else F.lit("")


def switch(value: Column, cases: dict[str, str]) -> Column:
    """The text of the case that equals the value; * is any other; without it, nothing."""
    out = None
    for k, v in cases.items():
        if k != "*":
            out = F.when(value.cast("string") == k, v) if out is None else out.when(value.cast("string") == k, v)
    default = F.lit(cases.get("*", ""))
    return default if out is None else out.otherwise(default)


def archive_dir(name: Column) -> Column:
    """Two hex digits: the top byte of the name's CRC-32."""
    return F.lpad(F.lower(F.hex(F.shiftright(F.crc32(name.cast("binary")), 24))), 2, "0")


def position_text(kind: Column, numbers: list[Column]) -> Column:
    return F.concat_ws(",", kind, *(n.cast("string") for n in numbers))


def parsed_credits(text: Column) -> Column:
    """Comma-separated ids, without blanks and empty entries, sorted, once each."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(text, ","), lambda c: F.trim(c)), lambda c: c != "")))


def location(text: Column) -> dict[str, Column]:
    """Where a layer goes: @TOP, @BOTTOM, -id below it, +id above it; null for anything else."""
    first = F.when(F.length(text) > 1, F.substring(text, 1, 1))
    return {
        "direction": F.when((text == "@TOP") | (first == "-"), "below").when((text == "@BOTTOM") | (first == "+"), "above"),
        "location": F.when(first.isin("-", "+"), F.substr(text, F.lit(2))).when(text.isin("@TOP", "@BOTTOM"), ""),
    }


def glue_path(ids: Column) -> Column:
    return F.array_join(ids, "_")


def version_id(base: Column, version: Column) -> Column:
    return F.concat(base, F.lit("@"), version.cast("string"))


def glob_pattern(glob: str) -> str:
    """A file-name pattern (*, ?, [..]) as a regular expression over the whole text."""
    import fnmatch

    return "^" + fnmatch.translate(glob)
