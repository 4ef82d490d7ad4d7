"""Box and polygon predicates on lon/lat columns.

Tile footprints are axis-aligned boxes, so every exact test is box against
polygon. A polygon is array<struct<lon,lat>>; rings are closed on use.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from swathe.functions.numbers import as_col


def ordered_box(box) -> tuple[Column, Column, Column, Column]:
    """(west, south, east, north) from two opposite corners in any order."""
    x1, y1, x2, y2 = (as_col(v) for v in box)
    return F.least(x1, x2), F.least(y1, y2), F.greatest(x1, x2), F.greatest(y1, y2)


def point_in_box(lon: Column, lat: Column, box) -> Column:
    west, south, east, north = ordered_box(box)
    return (lon >= west) & (lon <= east) & (lat >= south) & (lat <= north)


def boxes_touch(a, b) -> Column:
    """Closed overlap: boxes that share only an edge or corner count."""
    aw, as_, ae, an = (as_col(v) for v in a)
    bw, bs, be, bn = ordered_box(b)
    return (aw <= be) & (ae >= bw) & (as_ <= bn) & (an >= bs)


def boxes_overlap(a, b) -> Column:
    """Open overlap: the shared area must be positive. NULL when a side is NULL."""
    aw, as_, ae, an = (as_col(v) for v in a)
    bw, bs, be, bn = (as_col(v) for v in b)
    across = (aw < be) & (bw < ae) & (aw < ae) & (bw < be)
    upward = (as_ < bn) & (bs < an) & (as_ < an) & (bs < bn)
    return across & upward


def box_iou(a, b) -> Column:
    """Intersection over union of two boxes; 0 when they do not overlap."""
    aw, as_, ae, an = (as_col(v) for v in a)
    bw, bs, be, bn = (as_col(v) for v in b)
    shared = (F.least(ae, be) - F.greatest(aw, bw)) * (F.least(an, bn) - F.greatest(as_, bs))
    union = (ae - aw) * (an - as_) + (be - bw) * (bn - bs) - shared
    return F.when(boxes_overlap(a, b) & (union > 0), shared / union).otherwise(F.lit(0.0))


def distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    return F.sqrt((lon1 - lon2) * (lon1 - lon2) + (lat1 - lat2) * (lat1 - lat2))


def ring_literal(points) -> Column:
    """A polygon column from [[lon, lat], ...]."""
    return F.array(*[
        F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in points
    ])


def ring_from_wkt(wkt: Column) -> Column:
    """Outer ring of POLYGON((x y, ...)) text as a polygon column; NULL if it is not one."""
    body = F.regexp_extract(wkt, r"(?i)^\s*POLYGON\s*\(\s*\(([^()]*)\)", 1)
    number = r"\s+"
    pairs = F.transform(F.split(F.trim(body), r"\s*,\s*"), lambda p: F.split(F.trim(p), number))
    ring = F.transform(pairs, lambda p: F.struct(
        F.try_element_at(p, F.lit(1)).try_cast("double").alias("lon"),
        F.try_element_at(p, F.lit(2)).try_cast("double").alias("lat")))
    return F.when(body != "", ring)


def close_ring(ring: Column) -> Column:
    """Repeat the first vertex at the end when the ring is open."""
    return F.when(F.element_at(ring, 1) == F.element_at(ring, -1), ring).otherwise(
        F.concat(ring, F.slice(ring, 1, 1)))


def is_polygon(ring: Column) -> Column:
    return ring.isNotNull() & (F.size(ring) >= 3)


def envelope(ring: Column) -> tuple[Column, Column, Column, Column]:
    lons = F.transform(ring, lambda p: p["lon"])
    lats = F.transform(ring, lambda p: p["lat"])
    return F.array_min(lons), F.array_min(lats), F.array_max(lons), F.array_max(lats)


def ring_edges(ring: Column) -> Column:
    closed = close_ring(ring)
    ends = F.slice(closed, 2, F.size(closed))
    return F.filter(
        F.arrays_zip(closed.alias("a"), ends.alias("b")), lambda e: e["b"].isNotNull())


def _side(edge: Column, x: Column, y: Column) -> Column:
    a, b = edge["a"], edge["b"]
    return (b["lon"] - a["lon"]) * (y - a["lat"]) - (b["lat"] - a["lat"]) * (x - a["lon"])


def _corner_sides(edge: Column, box) -> list[Column]:
    w, s, e, n = box
    return [_side(edge, x, y) for x, y in ((w, s), (e, s), (e, n), (w, n))]


def _edge_touches(edge: Column, box) -> Column:
    w, s, e, n = box
    a, b = edge["a"], edge["b"]
    sides = _corner_sides(edge, box)
    return (
        (F.least(a["lon"], b["lon"]) <= e) & (F.greatest(a["lon"], b["lon"]) >= w)
        & (F.least(a["lat"], b["lat"]) <= n) & (F.greatest(a["lat"], b["lat"]) >= s)
        & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)
    )


def _edge_cuts(edge: Column, box) -> Column:
    w, s, e, n = box
    a, b = edge["a"], edge["b"]
    sides = _corner_sides(edge, box)
    return (
        (F.least(a["lon"], b["lon"]) < e) & (F.greatest(a["lon"], b["lon"]) > w)
        & (F.least(a["lat"], b["lat"]) < n) & (F.greatest(a["lat"], b["lat"]) > s)
        & (F.least(*sides) < 0) & (F.greatest(*sides) > 0)
    )


def point_in_ring(x: Column, y: Column, edges: Column) -> Column:
    """Even-odd rule: count the edges a ray to the east crosses."""

    def crosses(edge: Column) -> Column:
        a, b = edge["a"], edge["b"]
        at = a["lon"] + (y - a["lat"]) * (b["lon"] - a["lon"]) / F.nullif(b["lat"] - a["lat"], F.lit(0.0))
        return ((a["lat"] > y) != (b["lat"] > y)) & (x < at)

    return F.size(F.filter(edges, crosses)) % 2 == 1


def box_intersects_ring(box, ring: Column) -> Column:
    """The closed box and the closed polygon share a point.

    Either an edge of the polygon touches the box, or the whole box lies inside.
    """
    box = tuple(as_col(v) for v in box)
    edges = ring_edges(ring)
    return F.exists(edges, lambda e: _edge_touches(e, box)) | point_in_ring(box[0], box[1], edges)


def box_within_ring(box, ring: Column) -> Column:
    """The box lies in the closed polygon: no edge cuts its inside, and its centre is in."""
    box = tuple(as_col(v) for v in box)
    edges = ring_edges(ring)
    middle = ((box[0] + box[2]) / 2, (box[1] + box[3]) / 2)
    return ~F.exists(edges, lambda e: _edge_cuts(e, box)) & point_in_ring(*middle, edges)


def box_wkt(west, south, east, north) -> Column:
    """POLYGON text of an envelope, counter-clockwise from the south-west corner."""
    w, s, e, n = (as_col(v).cast("string") for v in (west, south, east, north))
    corner = lambda x, y: F.concat(x, F.lit(" "), y)
    ring = F.concat_ws(", ", corner(w, s), corner(e, s), corner(e, n), corner(w, n), corner(w, s))
    return F.when(w.isNotNull(), F.concat(F.lit("POLYGON(("), ring, F.lit("))")))
