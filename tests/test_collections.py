"""Collections read in byte ranges against a JSON parser."""

import io
import json
import random

import numpy as np
import pytest

from cityloom.sources import collections as co, files


def in_ranges(raw: bytes, size: int, member: str = "features") -> list[str]:
    ranges = co.ranges_of([("one", len(raw))], size)
    told = [co.summary(np.frombuffer(raw[a:b], np.uint8), raw[max(0, a - co.LOOK_BEHIND) : a], member) for _, a, b in ranges]
    return [t.decode() for part in co.aligned(ranges, told) for t in co.features_in(io.BytesIO(raw), part)]


def random_value(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 4)
    if kind == 0:
        return rng.randint(-5, 10**6)
    if kind in (1, 2):
        return "".join(rng.choice(['"', "\\", "{", "}", "[", "]", "a", "é", "漢", "\n", '"features": [', ",", ":", "\\\\"]) for _ in range(rng.randint(0, 8)))
    if kind == 3:
        return rng.choice([None, True, 1.5])
    if kind == 4:
        return [random_value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {rng.choice(["a", "features", 'b"', "\\", "{"]): random_value(rng, depth + 1) for _ in range(rng.randint(0, 3))}


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 1 << 20])
def test_ranges_of_any_size_give_the_same_features(monkeypatch, size):
    monkeypatch.setattr(co, "READ_BYTES", 5)
    rng = random.Random(size)
    for k in range(25):
        features = [{"properties": random_value(rng), "geometry": {"coordinates": [[rng.random(), 1], random_value(rng)]}} for _ in range(rng.randint(0, 6))]
        whole = {rng.choice(["crs", "bbox", "\\"]): random_value(rng), "features": features, "tail": [{"features": [{"x": 1}]}, random_value(rng)]}
        raw = json.dumps(whole, ensure_ascii=k % 2 == 0, indent=rng.choice([None, None, 2])).encode()
        assert [json.loads(t) for t in in_ranges(raw, size)] == features


def test_files_that_are_no_collections():
    good = b'{"features": [{"a": 1}, {"a": 2}]}'
    for raw in (b"", b"plain text", b"[1, 2]", b'{"other": [{"a": 1}]}', b'{"x": {"features": [{"a": 1}]}}', good[:-1], good[:-3], b'{"features": {"a": 1}}', b'"features": [{}]', b'{"features": [{"a": "open}]}'):
        for size in (3, 1000):
            assert in_ranges(raw, size) == []
    assert in_ranges(good, 4) == ['{"a": 1}', '{"a": 2}']
    assert in_ranges(b'{"features": [1, "x", [{"a": 1}], {"b": 2}, null]}', 5) == ['{"b": 2}']
    assert in_ranges(b'{"features"' + b" " * 50 + b":" + b"\n" * 50 + b"[{}]}", 6) == ["{}"]


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    features = [{"properties": {"n": k, "name": '}{" é漢\\'}, "geometry": {"type": "Point", "coordinates": [k, 2]}} for k in range(3000)]
    (folder / "large.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}, ensure_ascii=False))
    (folder / "small.json").write_text(json.dumps({"features": features[:2]}))
    (folder / "none.json").write_text("not json")
    rows = co.read_features(spark, str(folder), "properties struct<n:long,name:string>, geometry struct<type:string,coordinates:string>", size=10_000)
    assert rows.rdd.getNumPartitions() > 20
    got = sorted((r["f"]["properties"]["n"], r["f"]["properties"]["name"], r["f"]["geometry"]["coordinates"]) for r in rows.collect())
    assert [g[0] for g in got] == sorted([*range(3000), 0, 1]) and {g[1] for g in got} == {'}{" é漢\\'} and json.loads(got[-1][2]) == [2999, 2]
    parsed = files.scan_geojson(spark, str(folder / "*.json"), "n long", True)
    assert parsed.count() == 3002 and parsed.agg({"px": "max"}).first()[0] == 2999.0
    assert files.scan_geojson(spark, str(folder / "missing.json"), "n long").count() == 0
    assert co.read_features(spark, str(folder / "none.json"), "properties struct<n:long>").count() == 0
