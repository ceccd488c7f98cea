"""Group export (E1-E10): names, validation, one CSV per group."""

import csv
import os

import pytest

from tessera.functions.text import is_safe_name_py
from tessera.sinks import export as E
from tessera.spec import EXPORT_COLUMNS

VALID = ["chill", "Late Night Mix", "mix-2024", "a.b", "ünïcødé", "x"]
INVALID = ["", "   ", "a/b", "a\\b", "a:b", "a*b", "a?b", 'a"b', "a<b", "a>b", "a|b", ".hidden", "trailing.", None, 5]


@pytest.mark.parametrize("name", VALID)
def test_valid_names(name):
    assert is_safe_name_py(name)


@pytest.mark.parametrize("name", INVALID)
def test_invalid_names(name):
    assert not is_safe_name_py(name)


def test_valid_names_column_matches_python(spark):
    from tessera.functions.text import is_safe_name

    rows = [(n,) for n in VALID + [x for x in INVALID if isinstance(x, str)]]
    df = spark.createDataFrame(rows, "name string")
    got = {r["name"]: r["ok"] for r in df.select("name", is_safe_name("name").alias("ok")).collect()}
    assert all(got[n] == is_safe_name_py(n) for n, in rows)


def test_resolve_names():
    assert E.resolve_name(3, None) == "cluster_3"
    assert E.resolve_name(1, {1: "one"}) == "one"
    assert E.resolve_name(2, {1: "one"}) == "cluster_2"
    assert E.resolve_name(1, {1: ""}) == "cluster_1"
    assert E.resolve_name(4, lambda c: f"g{c}") == "g4"
    assert E.unclassified_name(None) == "Unclassified"
    assert E.unclassified_name({-1: "misc"}) == "misc"
    with pytest.raises(TypeError):
        E.resolve_name(1, 42)


def test_name_problems_lists_all():
    probs = E.name_problems({0: "a/b", 1: "same", 2: "same ", 3: ".x"})
    assert len(probs) == 3
    with pytest.raises(ValueError, match="unique"):
        E.validate_names({0: "same", 1: "same"})


def _tracks(spark):
    rows = [(i, f"id{i}", f"t{i}", "A", c, f"s{c}") for i, c in enumerate([0, 0, 1, 1, 1, -1])]
    return spark.createDataFrame(rows, "row_id long, spotify_id string, title string, artist string, cluster int, cluster_summary string")


def test_write_one_csv_per_cluster(spark, tmp_path):
    out = str(tmp_path / "out")
    paths = E.write_cluster_csvs(_tracks(spark), out, {0: "first"}, include_unclassified=True, write_combined=True)
    names = sorted(f for f in os.listdir(out) if not f.startswith("."))
    assert names == ["Unclassified.csv", "cluster_1.csv", "first.csv", "playlists.csv"]
    with open(os.path.join(out, "first.csv"), newline="") as fh:
        rows = list(csv.reader(fh))
    assert tuple(rows[0]) == EXPORT_COLUMNS
    assert sorted(r[0] for r in rows[1:]) == ["spotify:track:id0", "spotify:track:id1"]
    with open(os.path.join(out, "playlists.csv"), newline="") as fh:
        assert len(list(csv.reader(fh))) == 7  # header + every row incl. -1
    assert set(paths) >= {0, 1}


def test_write_rejects_bad_names_before_writing(spark, tmp_path):
    out = str(tmp_path / "bad")
    with pytest.raises(ValueError):
        E.write_cluster_csvs(_tracks(spark), out, {0: "x", 1: "x"})
    assert not os.path.exists(out) or os.listdir(out) == []
    with pytest.raises(TypeError):
        E.write_cluster_csvs([1, 2], out)


def test_export_with_features_no_fanout(spark):
    feats = spark.createDataFrame([("id0", 0.5), ("id0", 0.5), ("id2", 0.1)], "spotify_id string, energy double")
    out = E.export_frame(_tracks(spark), feats, ["energy"]).collect()
    assert len(out) == 6
    by_uri = {r[EXPORT_COLUMNS[0]]: r["energy"] for r in out}
    assert by_uri["spotify:track:id0"] == 0.5 and by_uri["spotify:track:id1"] is None


def test_write_multi_part_layout(spark, tmp_path):
    out = str(tmp_path / "parts")
    paths = E.write_cluster_csvs(_tracks(spark), out, single_files=False, write_combined=True)
    back = spark.read.option("header", True).csv(paths[1])
    assert back.count() == 3
    assert spark.read.option("header", True).csv(paths[-(10 ** 9)]).count() == 6


@pytest.mark.parametrize("single_files", [True, False])
def test_written_files_read_back_unchanged(spark, tmp_path, single_files):
    texts = ['He said "hi", ok', "  edges  ", "a,b;c", "two\nlines", "", None, '"']
    rows = [(i, f"id{i}", t, "A", 0, "s") for i, t in enumerate(texts)]
    tracks = spark.createDataFrame(rows, "row_id long, spotify_id string, title string, artist string, cluster int, cluster_summary string")
    paths = E.write_cluster_csvs(tracks, str(tmp_path / "o"), single_files=single_files)
    back = spark.read.options(header=True, quote='"', escape='"', multiLine=True, nullValue="\\N").csv(paths[0])
    got = {r[0]: r[1] for r in back.collect()}
    assert got == {f"spotify:track:id{i}": t for i, t in enumerate(texts)}
    files = [paths[0]] if single_files else [os.path.join(paths[0], f) for f in os.listdir(paths[0]) if f.endswith(".csv")]
    raw = [r for f in files for r in csv.reader(open(f, newline="", encoding="utf-8")) if r[0].startswith("spotify")]
    assert {r[0]: r[1] for r in raw} == {f"spotify:track:id{i}": t or "" for i, t in enumerate(texts)}


def test_empty_result_writes_nothing(spark, tmp_path):
    assert E.write_cluster_csvs(_tracks(spark).limit(0), str(tmp_path / "none")) == {}
    assert os.listdir(tmp_path / "none") == []
