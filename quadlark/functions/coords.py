"""Coordinates: conversions between reference systems, extents and pixels, as columns.

There is no projection library here. A conversion is a pair of column functions, so others can be plugged in; identity, affine and spherical
Mercator come with the library.
"""

from __future__ import annotations

from collections.abc import Callable
from math import pi

from pyspark.sql import Column, functions as F

from .tiles import col, shl

Point = tuple[Column, Column]
Convert = Callable[[Column, Column], Point]
#: Radius of the sphere (fixed value).
RADIUS = 6378137.0


def identity(x: Column, y: Column) -> Point:
    return x, y


def affine(ax: float = 1, bx: float = 0, ay: float = 1, by: float = 0) -> Convert:
    return lambda x, y: (x * ax + bx, y * ay + by)


def mercator(x: Column, y: Column) -> Point:
    """Degrees to metres on the sphere."""
    return F.radians(x) * RADIUS, F.log(F.tan(F.lit(pi / 4) + F.radians(y) / 2)) * RADIUS


def geographic(x: Column, y: Column) -> Point:
    """Metres on the sphere to degrees."""
    return F.degrees(x / RADIUS), F.degrees(F.atan(F.exp(y / RADIUS)) * 2 - pi / 2)


#: Conversions by source and target; a system to itself is the identity.
CONVERSIONS: dict[tuple[str, str], Convert] = {("r", "a"): identity, ("r", "b"): identity, ("a", "r"): identity, ("b", "r"): identity, ("a", "b"): affine(bx=180.0), ("b", "a"): affine(bx=-180.0), ("r", "m"): mercator, ("m", "r"): geographic}


def convert(source: str, target: str, x: Column, y: Column) -> Point:
    """A point in another system; the same system costs nothing."""
    return (x, y) if source == target else CONVERSIONS[source, target](x, y)


def convert_extents(source: str, target: str, box: tuple) -> tuple[Column, ...]:
    """The box around the four converted corners."""
    corners = [convert(source, target, col(box[i]), col(box[j])) for i in (0, 2) for j in (1, 3)]
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    return F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)


def node_extents(lod, x, y, root_lod, box: tuple) -> tuple[Column, ...]:
    """A node's extents by halving those of the root of its subtree; rows run down from the upper edge. x and y are local to the root."""
    n = shl(1, col(lod) - col(root_lod)).cast("double")
    w, h = (col(box[2]) - col(box[0])) / n, (col(box[3]) - col(box[1])) / n
    return col(box[0]) + col(x) * w, col(box[3]) - (col(y) + 1) * h, col(box[0]) + (col(x) + 1) * w, col(box[3]) - col(y) * h


def normalized(box: tuple, outer: tuple) -> tuple[Column, ...]:
    """Extents as shares of outer extents."""
    w, h = col(outer[2]) - col(outer[0]), col(outer[3]) - col(outer[1])
    return (col(box[0]) - col(outer[0])) / w, (col(box[1]) - col(outer[1])) / h, (col(box[2]) - col(outer[0])) / w, (col(box[3]) - col(outer[1])) / h


def denormalized(box: tuple, outer: tuple) -> tuple[Column, ...]:
    w, h = col(outer[2]) - col(outer[0]), col(outer[3]) - col(outer[1])
    return col(outer[0]) + col(box[0]) * w, col(outer[1]) + col(box[1]) * h, col(outer[0]) + col(box[2]) * w, col(outer[1]) + col(box[3]) * h


def geo_to_mask(x, y, box: tuple, size: int = 256) -> Point:
    """A point to pixels of a raster over the box, the first row at the upper edge, pixel centres on whole numbers."""
    return (col(x) - col(box[0])) / (col(box[2]) - col(box[0])) * size - 0.5, (col(box[3]) - col(y)) / (col(box[3]) - col(box[1])) * size - 0.5


def mask_to_geo(px, py, box: tuple, size: int = 256) -> Point:
    return col(box[0]) + (col(px) + 0.5) * (col(box[2]) - col(box[0])) / size, col(box[3]) - (col(py) + 0.5) * (col(box[3]) - col(box[1])) / size


def external_texture(x, y, box: tuple) -> Point:
    """Texture coordinates of a point in its node: 0 to 1 from the lower left."""
    return (col(x) - col(box[0])) / (col(box[2]) - col(box[0])), (col(y) - col(box[1])) / (col(box[3]) - col(box[1]))
