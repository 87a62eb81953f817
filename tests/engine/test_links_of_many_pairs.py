"""Passing pairs are marked where they are made, without a window, and only accepted ones meet their groups."""

from __future__ import annotations

from velograph.operators import link


def test_links_are_the_mutually_best_pairs(spark):
    point = "named_struct('t', {0}, 'x', double(hash(id, {1}) % 7), 'y', double(hash(id, {1}, 1) % 7))"
    ends = spark.sql(f"select concat('r', id % 2) run_id, id track_id, id % 9 first_frame, {point.format('double(id % 10) / 5', 1)} first, {point.format('double(id % 8) / 5 + 0.1', 2)} last, 1D vx, 1D vy, if(id % 3 = 0, id, null) vehicle_index from range(90)")
    limits = {"max_distance": 50.0, "max_lateral": 50.0, "max_speed": 5000.0}
    out = link.links(ends, **limits)
    columns = ["run_id", "a_track_id", "b_track_id", "gap", "dist", "lateral", "accepted"]
    rows = lambda df: sorted(map(tuple, df.select(columns).collect()))
    wanted = rows(link.accepted_links(link.link_pairs(ends, **limits)))
    assert rows(out) == wanted and sum(r[-1] for r in wanted) > 5 and not all(r[-1] for r in wanted)
    found = link.link_evidence(out, link.merged_vehicles(ends, out))
    assert "Window" not in found._jdf.queryExecution().toString()
    assert sorted((r.run_id, r.from_track_id, r.to_track_id, r.kind == "merged") for r in found.collect()) == sorted((*r[:3], r[-1]) for r in wanted)
