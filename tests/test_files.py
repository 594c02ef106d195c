"""Files as tables: strict lines, three list forms, reports, arrays in parts, hashes."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.sources import files


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_lines_are_numbered_in_their_files(spark, tmp_path):
    many = [f'{{"a": {i}}}' for i in range(5_000)]
    put(tmp_path / "in/one.jsonl", "\n".join(many) + "\n")
    put(tmp_path / "in/two.jsonl", '{"a": -1}\n\n  \n{"a": null, "b": "x"}')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = files.read_objects(spark, str(tmp_path / "in"), "a long, b string").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    of = lambda name: {r["line"]: (r["a"], r["b"]) for r in got if r["file"].endswith(name)}
    assert of("one.jsonl") == {i + 1: (i, None) for i in range(5_000)}
    assert of("two.jsonl") == {1: (-1, None), 4: (None, "x")}


@pytest.mark.parametrize("line, said", [("{bad", "line 3 is not JSON"), ("[1]", "line 3 must be a JSON object"), ("7", "line 3 must be a JSON object")])
def test_bad_lines_are_errors_with_their_number(spark, tmp_path, line, said):
    path = put(tmp_path / "m.jsonl", f'{{"a": 1}}\n\n{line}\n{{"a": 2}}\n')
    with pytest.raises(Exception, match=said):
        files.read_objects(spark, path, "a long").collect()


LISTS = {
    "lines": (" one \n\n two\nthree", ["one", "two", "three"]),
    "array": ('["b", "a"]', ["b", "a"]),
    "stale": ('{"stale": {"3d": ["x", "y"], "s3d": []}}', ["x", "y"]),
    "clips": ('{"clips": ["q", "p"]}', ["q", "p"]),
    "rows": ('{"clips": [{"clip": "m", "box": true}, {"clip": "n"}]}', ["m", "n"]),
    "keys": ('{"clips": {"z": 1, "k": {"a": 2}}}', ["k", "z"]),
    "empty": ("", []),
}


@pytest.mark.parametrize("form", sorted(LISTS))
def test_lists_in_any_form(spark, tmp_path, form):
    text, want = LISTS[form]
    got = files.read_list(spark, put(tmp_path / "list", text), "3d").orderBy("at").collect()
    assert [r["name"] for r in got] == want


@pytest.mark.parametrize("text, said", [('{"stale": {"s3d": ["x"]}}', "did not cover"), ('{"clips": [{"clip": "a"}, {"box": 1}]}', "without a clip"), ('{"other": 1}', "neither"), ("[1, ", "no list")])
def test_lists_that_cannot_be_told(spark, tmp_path, text, said):
    with pytest.raises(Exception, match=said):
        files.read_list(spark, put(tmp_path / "list", text), "3d").collect()


def test_numbers_at_dotted_paths(spark, tmp_path):
    put(tmp_path / "r/one.json", json.dumps({"a": {"b c": {"d": 1.5}, "n": 3, "t": "2", "flag": True, "none": None}}))
    r = files.read_reports(spark, str(tmp_path / "r"))
    row = r.select("stem", *[files.dig(F.col("report"), p).alias(str(i)) for i, p in enumerate(["a.b c.d", "a.n", "a.t", "a.x.y", "a", "a.none", "a.flag"])]).first()
    assert tuple(row) == ("one", 1.5, 3.0, None, None, None, None, None)
    put(tmp_path / "r/two.json", "[1]")
    with pytest.raises(Exception, match="no JSON object"):
        files.read_reports(spark, str(tmp_path / "r")).collect()


@pytest.mark.parametrize("part", [100, 1 << 20])
def test_arrays_are_read_in_parts(spark, tmp_path, part):
    rng = np.random.default_rng(0)
    given = {"f4": rng.normal(size=(50, 3)).astype("<f4"), "deep": rng.normal(size=(20, 2, 4)), "i2": rng.integers(-9, 9, (7, 5)).astype("<i2"), "flat": np.arange(40.0), "big": rng.normal(size=(9, 2)).astype(">f8"), "none": np.zeros((0, 4)), "flags": np.array([[True, False]])}
    for name, x in given.items():
        (tmp_path / "a" / name).parent.mkdir(exist_ok=True)
        np.save(tmp_path / "a" / f"{name}.npy", x)
    got = {}
    for r in files.read_arrays(spark, f"file://{tmp_path}/a", part).orderBy("row").collect():
        got.setdefault(r["stem"], []).append(r["values"])
    assert set(got) == set(given) - {"none"}
    for name, rows in got.items():
        assert np.array_equal(np.array(rows), given[name].reshape(len(given[name]), -1).astype(float))


def test_arrays_that_are_not_read(spark, tmp_path):
    for name, x in (("objects", np.array([[None]])), ("columns", np.asfortranarray(np.ones((3, 2))))):
        (tmp_path / name).mkdir()
        np.save(tmp_path / name / "x.npy", x, allow_pickle=True)
        with pytest.raises(Exception, match="only numbers by rows"):
            files.read_arrays(spark, f"file://{tmp_path}/{name}").collect()
    put(tmp_path / "cut/x.npy", "")
    np.save(tmp_path / "cut/x.npy", np.ones((9, 9)))
    data = (tmp_path / "cut/x.npy").read_bytes()
    (tmp_path / "cut/x.npy").write_bytes(data[:-8])
    with pytest.raises(Exception, match="ends before"):
        files.read_arrays(spark, f"file://{tmp_path}/cut").collect()


def test_written_arrays_come_back_and_a_folder_is_not_written_twice(spark, tmp_path):
    df = spark.createDataFrame([(s, i, [float(i), 2.0]) for s in ("a", "b") for i in range(25)], "s string, i long, v array<double>")
    path = f"file://{tmp_path}/new"
    files.write_arrays(df, "s", "i", "v", path, 10)
    assert sorted(p.name for p in (tmp_path / "new").iterdir()) == [f"{s}-0000{k}.npy" for s in "ab" for k in range(3)]
    assert np.load(tmp_path / "new/b-00002.npy").tolist() == [[float(i), 2.0] for i in range(20, 25)]
    assert files.read_arrays(spark, path).count() == 50
    with pytest.raises(ValueError, match="is there"):
        files.write_arrays(df, "s", "i", "v", path, 10)


def test_sides_must_have_the_same_stems_and_rows(spark):
    side = lambda stems: spark.createDataFrame([(s, i, [1.0]) for s, n in stems.items() for i in range(n)], "stem string, row long, values array<double>")
    both = files.aligned(x=side({"a": 3, "b": 2}), y=side({"a": 3, "b": 2}))
    assert both.count() == 5 and both.columns == ["stem", "row", "x", "y"]
    for other in ({"a": 3}, {"a": 3, "b": 2, "c": 1}, {"a": 3, "b": 1}):
        with pytest.raises(ValueError, match="sides differ"):
            files.aligned(x=side({"a": 3, "b": 2}), y=side(other), z=side({"a": 3, "b": 2}))


def test_hashes_of_whole_files_and_heads(spark, tmp_path):
    rng = np.random.default_rng(1)
    given = {"small": b"abc", "large": rng.bytes(3_000_001)}
    (tmp_path / "h").mkdir()
    for name, data in given.items():
        (tmp_path / "h" / name).write_bytes(data)
    (tmp_path / "h/empty").write_bytes(b"")  # not listed
    listed = files.listing(spark, f"file://{tmp_path}/h")
    sha = lambda d: hashlib.sha256(d).hexdigest()
    assert {r["stem"]: (r["sha256"], r["identity"]) for r in files.content_hashes(listed).collect()} == {n: (sha(d), f"{len(d)}:{sha(d)}") for n, d in given.items()}
    assert {r["stem"]: (r["sha256"], r["identity"]) for r in files.content_hashes(listed, 1 << 20).collect()} == {n: (None, f"{len(d)}:{sha(d[: 1 << 20])}") for n, d in given.items()}
