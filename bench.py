"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], and kernels beside published times: one JSON line.

``queries`` has seconds a query: the better of two runs, or the only one of the slowest four. ``kernels`` has seconds for one mesh in one process (the best of three)
on generated spheres of about the published meshes' face counts, with the published times and our ratio to them; the
tool of each boolean is a sphere of 960 faces with 0.4 of the mesh's extent as radius, as in the published runs.
"""

from __future__ import annotations

import json
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ.setdefault("OMP_NUM_THREADS", "1")

#: Relational and expression operators, then kernels over every row.
HEADLINE = [
    "mesh_statistics", "mesh_statistics_by_face", "edge_audit", "topology_audit", "vertex_normals", "translate", "closest_points", "raycast", "mesh_slice", "repair",
    "subtract", "polygon_intersect", "spheres", "decimate",
]
#: These take longest and run once.
ONCE = {"subtract", "polygon_intersect", "spheres", "decimate"}

# Published milliseconds (native, and the other kernel where there is one) by operation and face count.
PUBLISHED = {
    ("union", 1154): (5.074, 211.754), ("subtract", 1154): (4.735, 187.131), ("intersect", 1154): (4.538, 127.354),
    ("union", 3216): (7.373, 493.763), ("subtract", 3216): (7.035, 499.154), ("intersect", 3216): (8.001, 410.381),
    ("union", 23552): (42.651, 6139.906), ("subtract", 23552): (42.476, 5653.240), ("intersect", 23552): (31.981, 5241.032),
    ("decimate", 1154): (2.6, None), ("decimate", 3216): (31.2, None), ("decimate", 23552): (63.5, None),
    ("offset", 1154): (170.0, None), ("offset", 3216): (270.0, None),
}


def ball(faces: int, radius: float = 1.0, center=(0.0, 0.0, 0.0)):
    """A sphere of about ``faces`` faces: poles, and rings half as many as segments."""
    import numpy as np

    n = max(4, 2 * round((math.sqrt(faces) + 1) / 2))
    rings = n // 2
    up, turn = np.meshgrid(np.arange(1, rings) * math.pi / rings, np.arange(n) * 2 * math.pi / n, indexing="ij")
    ring = np.stack([np.sin(up) * np.cos(turn), np.sin(up) * np.sin(turn), np.cos(up)], axis=-1).reshape(-1, 3)
    at = lambda i, s: 2 + (i - 1) * n + s % n
    t = [f for s in range(n) for f in ((0, at(1, s), at(1, s + 1)), (1, at(rings - 1, s + 1), at(rings - 1, s)))]
    t += [f for i in range(1, rings - 1) for s in range(n) for f in ((at(i, s), at(i + 1, s), at(i + 1, s + 1)), (at(i, s), at(i + 1, s + 1), at(i, s + 1)))]
    return np.concatenate([[[0, 0, 1], [0, 0, -1]], ring]) * radius + np.asarray(center), np.array(t)


def kernels() -> dict[str, dict]:
    from triloom.kernels import bvh, csg, field, mesh

    out = {}
    for (kind, faces), (native, other) in PUBLISHED.items():
        v, t = ball(faces)
        tool = ball(960, 0.8, (0.9, 0.3, 0.2))
        run = {"decimate": lambda: mesh.decimate(v, t, len(t) // 4), "offset": lambda: field.offset(v, t, 0.05)}.get(kind, lambda: csg.boolean(kind, v, t, *tool))  # noqa: B023
        times = []
        for _ in range(3 if faces < 10_000 else 1):
            bvh._trees.clear()
            began = time.perf_counter()
            run()
            times.append(time.perf_counter() - began)
        best = min(times)
        out[f"{kind}_{len(t)}"] = {"seconds": round(best, 4), "published_ms": native, "ratio": round(best * 1000 / native, 1)} | ({"published_other_ms": other, "ratio_other": round(best * 1000 / other, 2)} if other else {})
        print(kind, len(t), out[f"{kind}_{len(t)}"], file=sys.stderr)
    return out


def main() -> None:
    from pyspark.sql import SparkSession

    from triloom.plans.workload import QUERIES

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_CPUS", "8"))
    single = kernels()
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", str(cpus)).config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        runs = []
        for _ in range(1 if name in ONCE else 2):
            began = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        print(name, [round(r, 2) for r in runs], file=sys.stderr)
        times[name] = round(min(runs), 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline queries, sum of seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "kernels": single, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
