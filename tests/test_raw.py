"""Hand-written dirty rows."""

from __future__ import annotations

import pytest

from earshot.functions.schemas import columns, invalid, typed, valid
from earshot.operators import clean as C
from earshot.operators.edges import genres_by_name, genres_or_default
from earshot.sources import store
from earshot.sources.raw import genre_dictionary, genre_lines, read_genre_dictionary, read_genre_lines, read_raw, scan_clean, scan_raw

ARTISTS = [
    "7\tNick Cave",
    "x7\tName",
    "3.7\tName",
    "1e3\tName",
    " 12 \tName",
    "+5\tName",
    "8\t",
    "9\tNA",
    "10\tnull",
    "11\tnan",
    "21\tartist_name",
    '13\t"say ""hi"""',
    "14",
    "15\ta\tb\tc",
    "16\tA",
    "16\t",
]


def write(tmp_path, name, lines):
    path = tmp_path / name
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_scan_repairs_and_drops(spark, tmp_path):
    rows = {(r.artist_id, r.artist_name) for r in scan_raw(spark, write(tmp_path, "a.tsv", ARTISTS), "artist").collect()}
    assert (7, "Nick Cave") in rows and (12, "Name") in rows and (5, "Name") in rows and (13, 'say "hi"') in rows
    assert {r[0] for r in rows} == {5, 7, 8, 9, 10, 11, 12, 13, 16, 21}
    assert {r[1] for r in rows if r[0] in (8, 9, 10, 11)} == {None}


def test_unnamed_and_named(spark, tmp_path):
    artists = scan_raw(spark, write(tmp_path, "a.tsv", ARTISTS), "artist")
    assert {r[0] for r in C.unnamed_ids(artists, "artist_id", "artist_name").collect()} == {8, 9, 10, 11, 16, 21}
    assert {r[0] for r in C.named(artists, "artist_id", "artist_name").collect()} == {5, 7, 12, 13}


def test_invalid_is_the_rest(spark, tmp_path):
    raw = read_raw(spark, write(tmp_path, "a.tsv", ARTISTS), "artist")
    assert invalid(raw).count() + valid(typed(raw)).count() == raw.count()
    assert {r.artist_id for r in invalid(raw).collect()} == {"x7", "3.7", "1e3"}


def test_users_have_a_header(spark, tmp_path):
    lines = ["user_id\tcountry\tage\tgender\tplaycount\tregistered_unixtime", "1\tNA\t-1\tx\t8000\t5", "2\t\t20\tm\t8000\t5", "3\tJP\t20\tm\t8000\t5"]
    users = scan_raw(spark, write(tmp_path, "u.tsv", lines), "user")
    filled = {r.user_id: r.country for r in C.fill_attributes(users).collect()}
    assert filled == {1: "NA", 2: "NA", 3: "JP"}
    profile = {r.user_id: r for r in C.user_profile(users, ["US"], ["m", "f", "n"]).collect()}
    assert profile[3].country == "NA" and profile[1].age_key == "NA" and profile[1].gender == "n"


def test_bad_timestamp_drops_the_event(spark, tmp_path):
    events = scan_raw(spark, write(tmp_path, "e.tsv", ["1\t2\t3\t4\tsoon", "1\t2\t3\t4\t99"]), "le")
    assert [tuple(r) for r in events.collect()] == [(1, 2, 3, 4, 99)]


def test_strict_scan_raises(spark, tmp_path):
    path = write(tmp_path, "c.tsv", ["artist_id\tartist_name", "x\ty"])
    with pytest.raises(Exception):
        scan_clean(spark, path, "artist").collect()


def test_unknown_kind():
    with pytest.raises(ValueError):
        columns("song")


def test_genre_lines_and_defaults(spark, tmp_path):
    lines = read_genre_lines(spark, write(tmp_path, "g.txt", ["A\t3\t5", "B", "Unknown\t1", "Dup\t2"]))
    assert sorted(tuple(r) for r in lines.collect()) == [("A", 3), ("A", 5), ("Dup", 2), ("Unknown", 1)]
    artists = spark.createDataFrame([(1, "A"), (2, "B"), (30, "Dup"), (31, "Dup")], "artist_id long, artist_name string")
    genres = read_genre_dictionary(spark, write(tmp_path, "d.txt", ["rock", "pop"]))
    assert sorted(tuple(r) for r in genres.collect()) == [(0, "rock"), (1, "pop"), (20, "na")]
    pairs = genres_or_default(genres_by_name(lines, artists), artists, genres)
    assert sorted(tuple(r) for r in pairs.collect()) == [(1, 3), (1, 5), (2, 20), (30, 20), (31, 2)]


def test_empty_genre_lines(spark):
    assert genre_lines(spark.createDataFrame([], "value string")).count() == 0
    assert genre_dictionary(spark.createDataFrame([], "genre_id long, genre_name string")).count() == 1


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q"'), (2, None)], "artist_id long, artist_name string")
    store.write_table(df, str(tmp_path / "t"))
    assert sorted(spark.read.parquet(str(tmp_path / "t")).collect()) == sorted(df.collect())
    store.write_table(df, str(tmp_path / "x"), "tsv")
    assert sorted(tuple(r) for r in scan_clean(spark, str(tmp_path / "x"), "artist").collect())[0] == (1, 'a "q"')
    built = []
    make = lambda: built.append(1) or df
    store.built_once(spark, str(tmp_path / "b"), make)
    store.built_once(spark, str(tmp_path / "b"), make)
    assert len(built) == 1
    store.built_once(spark, str(tmp_path / "b"), make, overwrite=True)
    assert len(built) == 2


def test_dangling_and_closure(spark):
    artists = spark.createDataFrame([(1, "a"), (20, "b")], "artist_id long, artist_name string")
    albums = spark.createDataFrame([(5, "x", 1), (100, "T", 999), (6, "y", 20)], "album_id long, album_name string, artist_id long")
    tracks = spark.createDataFrame([(8, "z", 1)], "track_id long, track_name string, artist_id long")
    keys = artists.select("artist_id")
    assert [r[0] for r in C.dangling_ids(keys, [albums.select("artist_id"), tracks.select("artist_id")]).collect()] == [999]
    good = C.good_artist_ids(artists, albums, tracks)
    assert [r[0] for r in good.collect()] == [1]
    with pytest.raises(ValueError):
        C.require_closure(C.closure_check(artists, albums, tracks))
    kept = [C.keep_ids(d, good, "artist_id") for d in (artists, albums, tracks)]
    C.require_closure(C.closure_check(*kept))
