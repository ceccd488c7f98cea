"""Delimited track lists and JSON bodies."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import id_from_href
from tessera.sources.content import explode_content
from tessera.sources.delimited import TrackLibrary, preview, read_rejects

HEADER = ["Track URI", "Track Name", "Artist Name(s)", "Album Name"]


def write(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text, encoding="utf-8")
    return str(p)


def test_comma_file_with_semicolon_in_title(spark, tmp_path):
    path = write(tmp_path, "a.csv", ",".join(HEADER) + "\n"
                 "spotify:track:AAA,\"One; Two\",X,Al\n"
                 "spotify:track:BBB,\t Three  ,\"Y, Z\",Al\n")
    lib = TrackLibrary.load(spark, path)
    rows = sorted(lib.dataframe.collect(), key=lambda r: r["spotify_id"])
    assert [(r["spotify_id"], r["title"], r["artist"]) for r in rows] == [
        ("AAA", "One; Two", "X"), ("BBB", "Three", "Y, Z")]
    assert len(lib) == 2


def test_semicolon_fallback_and_dropped_rows(spark, tmp_path):
    path = write(tmp_path, "b.csv", ";".join(HEADER) + "\n"
                 "spotify:track:AAA;A;X;Al\n"
                 ";B;Y;Al\n"
                 "  ;C;Z;Al\n"
                 "spotify:local:xyz;D;W;Al\n")
    lib = TrackLibrary.load(spark, path)
    ids = sorted(r["spotify_id"] for r in lib.dataframe.collect())
    assert ids == ["AAA", "spotify:local:xyz"]  # other URIs pass through unchanged


def test_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        TrackLibrary.load(spark, str(tmp_path / "missing.csv"))
    bad = write(tmp_path, "c.csv", "Track URI,Title\nx,y\n")
    with pytest.raises(ValueError, match="Track Name"):
        TrackLibrary.load(spark, bad)
    empty = write(tmp_path, "d.csv", ",".join(HEADER) + "\n,A,B,C\n")
    with pytest.raises(ValueError, match="No tracks"):
        TrackLibrary.load(spark, empty)


def test_preview_head_and_tail(spark):
    df = spark.range(50).withColumnRenamed("id", "row_id")
    got = sorted((r["row_id"], r["part"]) for r in preview(df, 6).collect())
    assert got == [(0, "head"), (1, "head"), (2, "head"), (47, "tail"), (48, "tail"), (49, "tail")]
    small = sorted(r["row_id"] for r in preview(spark.range(4).withColumnRenamed("id", "row_id"), 6).collect())
    assert small == [0, 1, 2, 3]


@pytest.mark.parametrize("href,expected", [
    ("https://api.example.com/v1/track/abc", "abc"),
    ("https://api.example.com/v1/track/abc/", "abc"),
    ("https://api.example.com/v1/track/abc?x=1/2", "abc"),
    ("abc", "abc"),
    ("https://api.example.com/", "api.example.com"),
    ("", None),
    ("https://x/track/25#top", "25#top"),
])
def test_id_from_href(spark, href, expected):
    df = spark.createDataFrame([(href,)], "h string")
    assert df.select(id_from_href("h").alias("i")).first()["i"] == expected


def test_content_rows(spark):
    item = T.StructType([T.StructField("id", T.StringType()), T.StructField("href", T.StringType())])
    df = spark.createDataFrame([
        (1, '{"content": [{"id": "a", "href": "h/a"}, {"id": "b", "href": "h/b"}]}'),
        (2, '{"other": 1}'),
        (3, "not json"),
    ], "k int, body string")
    out = explode_content(df, "body", item, ["k"]).collect()
    assert sorted((r["k"], r["id"]) for r in out) == [(1, "a"), (1, "b")]


def test_line_breaks_rejects_and_print_all(spark, tmp_path):
    p = tmp_path / "list.csv"
    p.write_text('Track URI;Track Name;Artist Name(s)\nspotify:track:a;"two\nlines";A\nspotify:track:b;x;B;too many\nspotify:track:c;"He said ""hi""";C\n', encoding="utf-8")
    lib = TrackLibrary.load(spark, str(p), strict=False)
    assert {r["title"] for r in lib.dataframe.collect()} == {"two\nlines", 'He said "hi"'}
    assert len(lib) == 2 and "2 tracks" in repr(lib)
    assert [r.rejected for r in read_rejects(spark, str(p)).collect()] == ["spotify:track:b;x;B;too many"]
    assert lib.preview(None).count() == 2
    with pytest.raises(Exception):  # noqa: B017 -- strict loads stop at a malformed row
        TrackLibrary.load(spark, str(p))
