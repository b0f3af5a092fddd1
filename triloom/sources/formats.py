"""Mesh files: STL, OBJ, OFF, PLY and 3MF, between bytes and arrays. Any trouble in reading is ``MeshIO.Unreadable``."""

from __future__ import annotations

import io
import re
import struct
import zipfile
from xml.etree import ElementTree

import numpy as np

from ..kernels import mesh as M
from ..kernels.batch import Failure

FORMATS = ("stl", "obj", "off", "ply", "3mf")
UNREADABLE, UNWRITABLE, UNSUPPORTED = "MeshIO.Unreadable", "MeshIO.Unwritable", "MeshIO.UnsupportedFormat"

_FACET = np.dtype([("n", "<f4", 3), ("p", "<f4", (3, 3)), ("a", "<u2")])
_SCALARS = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "<i2", "int16": "<i2", "ushort": "<u2", "uint16": "<u2", "int": "<i4", "int32": "<i4", "uint": "<u4", "uint32": "<u4", "float": "<f4", "float32": "<f4", "double": "<f8", "float64": "<f8"}
_CORE = "http://schemas.microsoft.com/3dmanufacturing/core/2015/02"


def _unit_normals(v: np.ndarray, t: np.ndarray) -> np.ndarray:
    n = M.face_vectors(v, t)
    size = np.linalg.norm(n, axis=1, keepdims=True)
    return np.where(size > 1e-300, n / np.maximum(size, 1e-300), [0.0, 0.0, 1.0])


def _welded(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t = M.weld(points, M.WELD)[np.arange(len(points)).reshape(-1, 3)]
    t = t[M.proper(t)]
    if not len(t):
        raise ValueError("no triangles")
    return M.compact(points, t)


def _indexed(v, faces) -> tuple[np.ndarray, np.ndarray]:
    t = np.array([(f[0], f[k], f[k + 1]) for f in faces for k in range(1, len(f) - 1)], np.int64).reshape(-1, 3)
    v = np.array(v, float).reshape(-1, 3)
    if not len(t) or t.min() < 0 or t.max() >= len(v) or not np.isfinite(v).all():
        raise ValueError("bad faces")
    return M.compact(v, t)


def read_stl(data: bytes):
    if len(data) >= 84 and 84 + 50 * struct.unpack_from("<I", data, 80)[0] == len(data):
        return _welded(np.frombuffer(data, _FACET, offset=84)["p"].reshape(-1, 3).astype(float))
    found = re.findall(r"vertex\s+(\S+)\s+(\S+)\s+(\S+)", data.decode("latin-1"), re.I)
    points = np.array(found[: len(found) // 3 * 3], float).reshape(-1, 3)
    if not len(points) or not np.isfinite(points).all():
        raise ValueError("no triangles")
    return _welded(points)


def write_stl(v, t, name="") -> bytes:
    rows = np.zeros(len(t), _FACET)
    rows["n"], rows["p"] = _unit_normals(v, t), v[t]
    return (name or "").encode("ascii", "replace")[:79].ljust(80, b"\0") + struct.pack("<I", len(t)) + rows.tobytes()


def read_obj(data: bytes):
    v, faces = [], []
    for line in data.decode("utf-8", "replace").splitlines():
        part = line.split()
        if part[:1] == ["v"]:
            v.append([float(x) for x in part[1:4]])
        elif part[:1] == ["f"]:
            at = [int(x.split("/")[0]) for x in part[1:]]
            faces.append([k - 1 if k >= 0 else len(v) + k for k in at])
    return _indexed(v, faces)


def write_obj(v, t, name="") -> bytes:
    return "".join([*(f"v {x!r} {y!r} {z!r}\n" for x, y, z in v.tolist()), *(f"f {a + 1} {b + 1} {c + 1}\n" for a, b, c in t.tolist())]).encode()


def read_off(data: bytes):
    words = [w for line in data.decode("utf-8", "replace").splitlines() for w in line.split("#")[0].split()]
    at = 1 if words[0] == "OFF" else 0
    n, m = int(words[at]), int(words[at + 1])
    at += 3
    v = np.array(words[at : at + 3 * n], float)
    at, faces = at + 3 * n, []
    for _ in range(m):
        k = int(words[at])
        faces.append([int(x) for x in words[at + 1 : at + 1 + k]])
        at += 1 + k
    return _indexed(v, faces)


def write_off(v, t, name="") -> bytes:
    return "".join([f"OFF\n{len(v)} {len(t)} 0\n", *(f"{x!r} {y!r} {z!r}\n" for x, y, z in v.tolist()), *(f"3 {a} {b} {c}\n" for a, b, c in t.tolist())]).encode()


def read_ply(data: bytes):
    end = data.index(b"end_header")
    header = data[:end].decode("ascii").split("\n")
    body = data[data.index(b"\n", end) + 1 :]
    if not header[0].startswith("ply"):
        raise ValueError("not ply")
    kind, elements = None, []
    for line in map(str.split, header):
        if line[:1] == ["format"]:
            kind = line[1]
        elif line[:1] == ["element"]:
            elements.append((line[1], int(line[2]), []))
        elif line[:1] == ["property"]:
            elements[-1][2].append(("list", line[4], line[2], line[3]) if line[1] == "list" else ("one", line[2], line[1]))
    if kind not in ("ascii", "binary_little_endian"):
        raise ValueError("unknown ply format")
    words, at = (iter(body.split()), 0) if kind == "ascii" else (None, 0)

    def take(scalar: str, n: int = 1):
        nonlocal at
        if words is not None:
            return [float(next(words)) for _ in range(n)]
        out = np.frombuffer(body, _SCALARS[scalar], n, at)
        at += out.nbytes
        return out.tolist()

    v, faces = [], []
    for name, count, properties in elements:
        names = [p[1] for p in properties]
        if kind != "ascii" and name == "vertex" and all(p[0] == "one" for p in properties):
            rows = np.frombuffer(body, np.dtype([(p[1], _SCALARS[p[2]]) for p in properties]), count, at)
            at += rows.nbytes
            v = np.stack([rows[k].astype(float) for k in "xyz"], axis=1)
            continue
        for _ in range(count):
            row, loop = {}, []
            for p in properties:
                if p[0] == "one":
                    row[p[1]] = take(p[2])[0]
                else:
                    loop += take(p[3], int(take(p[2])[0]))
            if name == "vertex":
                v.append([row[k] for k in "xyz"] if {"x", "y", "z"} <= set(names) else None)
            elif name == "face":
                faces.append([int(x) for x in loop])
    return _indexed(v, faces)


def write_ply(v, t, name="") -> bytes:
    head = f"ply\nformat binary_little_endian 1.0\nelement vertex {len(v)}\nproperty double x\nproperty double y\nproperty double z\nelement face {len(t)}\nproperty list uchar int vertex_indices\nend_header\n"
    rows = np.zeros(len(t), np.dtype([("n", "u1"), ("f", "<i4", 3)]))
    rows["n"], rows["f"] = 3, t
    return head.encode() + np.ascontiguousarray(v, "<f8").tobytes() + rows.tobytes()


def read_package(data: bytes, role: str | None = None) -> dict:
    """Model, optional reference and metadata of a 3MF package; the build transform moves the model only."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read(next(n for n in z.namelist() if n.lower().endswith(".model"))))
    tag = lambda e: e.tag.rsplit("}", 1)[-1]
    objects = {}
    for e in root.iter():
        if tag(e) == "object" and any(tag(m) == "mesh" for m in e):
            v = [[float(x.get(k)) for k in "xyz"] for x in e.iter() if tag(x) == "vertex"]
            t = [[int(x.get(k)) for k in ("v1", "v2", "v3")] for x in e.iter() if tag(x) == "triangle"]
            roles = {value for key, value in e.attrib.items() if key.startswith("{")}
            objects[e.get("id")] = (*_indexed(v, t), e.get("type") == "other" or (role is not None and role in roles), e.get("name"))
    reference = next((k for k, o in objects.items() if o[2]), None) if len(objects) > 1 else None  # a single object is the model, whatever its type
    model = next(k for k in objects if k != reference)
    v, t, _, name = objects[model]
    for item in root.iter():
        if tag(item) == "item" and item.get("objectid") == model and item.get("transform"):
            m = np.array(item.get("transform").split(), float).reshape(4, 3)
            v = v @ m[:3] + m[3]
    metadata = {e.get("name"): e.text or "" for e in root if tag(e) == "metadata"}
    return {"vertices": v, "triangles": t, "name": name, "metadata": metadata, "reference": objects[reference][:2] if reference else None}


def write_package(v, t, name="", reference=None, metadata: dict | None = None) -> bytes:
    ElementTree.register_namespace("", _CORE)
    q = lambda s: f"{{{_CORE}}}{s}"
    root = ElementTree.Element(q("model"), {"unit": "millimeter"})
    for key in sorted(metadata or {}):
        ElementTree.SubElement(root, q("metadata"), {"name": key}).text = metadata[key]
    resources, build = ElementTree.SubElement(root, q("resources")), ElementTree.SubElement(root, q("build"))
    for k, (pv, pt, kind) in enumerate([(v, t, "model"), *([(*reference, "other")] if reference else [])], 1):
        o = ElementTree.SubElement(resources, q("object"), {"id": str(k), "type": kind, **({"name": name} if name and k == 1 else {})})
        mesh = ElementTree.SubElement(o, q("mesh"))
        vertices, triangles = ElementTree.SubElement(mesh, q("vertices")), ElementTree.SubElement(mesh, q("triangles"))
        for x, y, z in np.asarray(pv).tolist():
            ElementTree.SubElement(vertices, q("vertex"), {"x": repr(x), "y": repr(y), "z": repr(z)})
        for a, b, c in np.asarray(pt).tolist():
            ElementTree.SubElement(triangles, q("triangle"), {"v1": str(a), "v2": str(b), "v3": str(c)})
        if k == 1:
            ElementTree.SubElement(build, q("item"), {"objectid": "1"})
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="model" ContentType="application/vnd.ms-package.3dmanufacturing-3dmodel+xml"/></Types>')
        z.writestr("_rels/.rels", '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Target="/3D/3dmodel.model" Id="rel0" Type="http://schemas.microsoft.com/3dmanufacturing/2013/01/3dmodel"/></Relationships>')
        z.writestr("3D/3dmodel.model", ElementTree.tostring(root, encoding="utf-8", xml_declaration=True))
    return out.getvalue()


def read(data: bytes, kind: str) -> dict:
    kind = (kind or "").lower().lstrip(".")
    if kind not in FORMATS:
        raise Failure(UNSUPPORTED)
    try:
        if kind == "3mf":
            found = read_package(data)
            return {"vertices": found["vertices"], "triangles": found["triangles"]}
        v, t = {"stl": read_stl, "obj": read_obj, "off": read_off, "ply": read_ply}[kind](data)
        return {"vertices": v, "triangles": t}
    except Exception:
        raise Failure(UNREADABLE) from None


def write(v, t, kind: str, name: str = "") -> bytes:
    kind = (kind or "").lower().lstrip(".")
    if kind not in FORMATS:
        raise Failure(UNSUPPORTED)
    if not len(t):
        raise Failure("Mesh.EmptyOperand")
    return {"stl": write_stl, "obj": write_obj, "off": write_off, "ply": write_ply, "3mf": write_package}[kind](v, t, name)
