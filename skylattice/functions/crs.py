"""Projections as PROJJSON texts and back (the JSON form of ISO 19162)."""

from __future__ import annotations

import json

from .projection import Ellipsoid, Projection

#: Of each kind the method's name and id, and the parameters that carry our numbers
#: (fixed values of the EPSG registry).
METHODS = {
    "lcc": ("Lambert Conic Conformal (2SP)", 9802, {"Latitude of false origin": "lat_0", "Longitude of false origin": "lon_0", "Latitude of 1st standard parallel": "lat_1", "Latitude of 2nd standard parallel": "lat_2"}),
    "polar": ("Polar Stereographic (variant B)", 9829, {"Latitude of standard parallel": "lat_1", "Longitude of origin": "lon_0"}),
    "mercator": ("Mercator (variant B)", 9805, {"Latitude of 1st standard parallel": "lat_1", "Longitude of natural origin": "lon_0"}),
}


def to_projjson(p: Projection) -> str:
    body = {"name": "unknown", "semi_major_axis": p.ellipsoid.a}
    # A sphere has no flattening to invert.
    body |= {"inverse_flattening": p.ellipsoid.inverse_flattening} if p.ellipsoid.inverse_flattening else {"semi_minor_axis": p.ellipsoid.a}
    degrees = {"type": "GeographicCRS", "name": "unknown", "datum": {"type": "GeodeticReferenceFrame", "name": "unknown", "ellipsoid": body}, "coordinate_system": _axes("ellipsoidal", ("Longitude", "east", "degree"), ("Latitude", "north", "degree"))}
    if p.kind == "latlon":
        return json.dumps(degrees, sort_keys=True)
    name, code, parameters = METHODS[p.kind]
    values = {n: getattr(p, own) for n, own in parameters.items()}
    if p.kind == "polar":  # which pole is the sign of the standard parallel
        values["Latitude of standard parallel"] = abs(p.lat_1) * (1 if p.lat_0 > 0 else -1)
    given = [{"name": n, "value": v, "unit": "degree"} for n, v in values.items()] + [{"name": n, "value": 0, "unit": "metre"} for n in ("False easting", "False northing")]
    crs = {"type": "ProjectedCRS", "name": "unknown", "base_crs": degrees, "conversion": {"name": "unknown", "method": {"name": name, "id": {"authority": "EPSG", "code": code}}, "parameters": given}, "coordinate_system": _axes("Cartesian", ("Easting", "east", "metre"), ("Northing", "north", "metre"))}
    return json.dumps(crs, sort_keys=True)


def _axes(kind: str, *axes: tuple[str, str, str]) -> dict:
    return {"subtype": kind, "axis": [{"name": n, "abbreviation": "", "direction": d, "unit": u} for n, d, u in axes]}


def from_projjson(text: str) -> Projection:
    """The projection of a text; ValueError for methods and offsets that we don't have."""
    crs = json.loads(text)
    base = crs if crs["type"] == "GeographicCRS" else crs["base_crs"]
    body = base["datum"]["ellipsoid"]
    ellipsoid = Ellipsoid(float(body["semi_major_axis"]), float(body.get("inverse_flattening", 0.0)))
    if crs["type"] == "GeographicCRS":
        return Projection("latlon", ellipsoid=ellipsoid)
    method = crs["conversion"]["method"]
    kind = next((k for k, (name, code, _) in METHODS.items() if method["name"] == name or method.get("id", {}).get("code") == code), None)
    values = {p["name"]: float(p["value"]) for p in crs["conversion"]["parameters"]}
    if kind is None or values.pop("False easting", 0.0) or values.pop("False northing", 0.0):
        raise ValueError(f"unsupported conversion {method['name']!r}")
    own = {METHODS[kind][2][n]: v for n, v in values.items()}
    if kind == "polar":
        own["lat_0"] = 90.0 if own["lat_1"] > 0 else -90.0
    return Projection(kind, ellipsoid=ellipsoid, **own)
