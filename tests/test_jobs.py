"""From a raw folder to a stored graph and back."""

from __future__ import annotations

import os

import pytest

from earshot.plans import jobs
from earshot.sources import staging, versions

USERS = ["user_id\tcountry\tage\tgender\tplaycount\tregistered_unixtime"] + [f"{i}\tUS\t20\tm\t9000\t5" for i in range(1, 5)]
TABLES = {
    "users": USERS,
    "artists": ["1\tOne", "2\tTwo", "3\tNo tracks", "4\t"],
    "albums": ["10\tA\t1", "20\tB\t2", "30\tC\t3"],
    "tracks": ["100\ta\t1", "200\tb\t2", "400\td\t4"],
    "les": ["1\t1\t10\t100\t5", "1\t2\t20\t200\t6", "2\t1\t10\t100\t7", "2\t1\t10\t100\t8", "3\t3\t30\t100\t9", "1\t1\t10\t400\t9"],
    "artist_genres": ["One\t0", "Two"],
    "genres": ["rock", "pop"],
}


def staged_files(spark):
    """What lies in the folder of staged tables: jobs leave nothing there."""
    folder = staging.staging_dir(spark).removeprefix("file:")
    return sorted(os.path.join(d, n) for d, _, names in os.walk(folder) for n in names)


def test_preprocess_build_and_load(spark, tmp_path):
    raw, clean, graph = (str(tmp_path / n) for n in ("raw", "clean", "graph"))
    (tmp_path / "raw").mkdir()
    for name, lines in TABLES.items():
        (tmp_path / "raw" / name).write_text("\n".join(lines) + "\n")
    before = staged_files(spark)
    tables = jobs.preprocess(spark, raw, clean)
    assert staged_files(spark) == before
    assert {k: t.count() for k, t in tables.items()} == {"artist": 2, "album": 2, "track": 2, "le": 4, "user": 2}
    built, feats = jobs.build(spark, clean, raw, graph, length=8, per_node=1, negatives=2, dim=4)
    assert {(r.relation, r.n) for r in built.edge_counts().collect()} >= {("listened_to_track", 4), ("preformed", 2), ("in_genre", 2)}
    assert {(r.node_type, r.n) for r in built.node_counts().collect()} == {("user", 2), ("artist", 2), ("album", 2), ("track", 2), ("genre", 3)}
    assert {(r.node_type, r.node_id): r.raw_id for r in jobs.raw_ids(built, ["album"]).collect()} == {("album", 0): 10, ("album", 1): 20}
    rows = feats.collect()
    assert staged_files(spark) == before
    assert len(rows) == 11 and all(len(r.feat) == 4 for r in rows)
    # what is stored is read and not built again, even with the raw folder gone
    (tmp_path / "raw" / "artist_genres").unlink()
    again, ids = jobs.build(spark, clean, raw, graph, embed=False)
    assert again.edge_counts().count() == 12 and all(r.feat == [float(r.node_id)] for r in ids.collect())
    assert jobs.preprocess(spark, "/nowhere", clean)["le"].count() == 4
    few = jobs.preprocess(spark, raw, str(tmp_path / "few"), n_users=1)
    assert few["user"].count() <= 1


def test_dropping_what_is_staged(spark):
    with staging.staged_within(spark):
        found = staging.staged_all({"a": spark.range(3), "b": spark.range(4)})
        assert found["b"].count() == 4 and staging.staged_once(found["a"], "again") is found["a"]
        assert staged_files(spark)
        staging.drop_staged(spark)
        assert not staged_files(spark)


def raw_folder(tmp_path, **changed):
    folder = tmp_path / f"raw{len(list(tmp_path.iterdir()))}"
    folder.mkdir()
    for name, lines in (TABLES | changed).items():
        (folder / name).write_text("\n".join(lines) + "\n")
    return str(folder)


def test_other_options_or_input_are_an_error(spark, tmp_path):
    raw, clean, graph = raw_folder(tmp_path), str(tmp_path / "clean"), str(tmp_path / "graph")
    jobs.preprocess(spark, raw, clean)
    first, _ = jobs.build(spark, clean, raw, graph, embed=False)
    assert "ts" in first.edges["listened_to_album"].columns
    with pytest.raises(ValueError, match="albums is True, asked is False.*weighted"):
        jobs.build(spark, clean, raw, graph, albums=False, weighted=True, embed=False)
    with pytest.raises(ValueError, match="n_users"):
        jobs.preprocess(spark, raw, clean, n_users=1)
    anew, _ = jobs.build(spark, clean, raw, graph, albums=False, weighted=True, embed=False, overwrite=True)
    assert "listened_to_album" not in anew.edges and "weight" in anew.edges["listened_to_track"].columns
    other = raw_folder(tmp_path, les=TABLES["les"][:2])
    with pytest.raises(ValueError, match="input"):
        jobs.preprocess(spark, other, clean)
    assert jobs.preprocess(spark, other, clean, overwrite=True)["le"].count() == 2
    with pytest.raises(ValueError, match="input"):  # the graph is that of the events before
        jobs.build(spark, clean, raw, graph, albums=False, weighted=True, embed=False)


def test_a_killed_build_leaves_the_old_graph(spark, tmp_path, monkeypatch):
    raw, clean, graph = raw_folder(tmp_path), str(tmp_path / "clean"), str(tmp_path / "graph")
    jobs.preprocess(spark, raw, clean)
    before, _ = jobs.build(spark, clean, raw, graph, embed=False)
    counts = sorted(map(tuple, before.edge_counts().collect()))

    def killed(built, path):
        built.nodes["user"].write.parquet(f"{path}/nodes/node_type=user")
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(jobs, "write_graph", killed)
        with pytest.raises(KeyboardInterrupt):
            jobs.build(spark, clean, raw, graph, tracks=False, embed=False, overwrite=True)
    again, _ = jobs.build(spark, clean, raw, graph, embed=False)
    assert sorted(map(tuple, again.edge_counts().collect())) == counts
    assert len(versions.drop_old(spark, f"{graph}/graph")) == 1
    assert sorted(map(tuple, jobs.build(spark, clean, raw, graph, embed=False)[0].edge_counts().collect())) == counts


def test_broken_closure_is_an_error_and_not_published(spark, tmp_path):
    twice = raw_folder(tmp_path, artists=["1\tOne", "1\tOne again", "2\tTwo"])
    with pytest.raises(ValueError, match="3 artist rows, 2 artists of albums, 2 of tracks"):
        jobs.preprocess(spark, twice, str(tmp_path / "clean"))
    assert versions.current(spark, str(tmp_path / "clean")) is None
    tables = jobs.preprocess(spark, raw_folder(tmp_path), str(tmp_path / "clean"))
    assert tables["artist"].count() == 2


def test_rejects_and_kept_rows_are_all_lines(spark, tmp_path):
    les = [*TABLES["les"], "1\t1\t10\t100", "1\t1\t10\t100\t5\t6", "x\t1\t10\t100\t5", "1\t1\t10\t100\tlate", "1\t1\t\t100\t5", "1\t1.0\t10\t100\t5"]
    users = [*USERS, "5\tUS\t20\tm\tmany\t5", "6"]
    raw = raw_folder(tmp_path, les=les, users=users)
    clean = str(tmp_path / "clean")
    jobs.preprocess(spark, raw, clean)
    found = jobs.clean_tables(spark, clean, ["le", jobs.REJECTS, jobs.LINES])
    counts = {r.kind: (r.n_lines, r.n_kept, r.n_rejected) for r in found["lines"].collect()}
    assert counts["le"] == (len(les), 6, 6) and counts["user"] == (len(users) - 1, 4, 2)
    rejects = [(r.kind, r.reason, r.row) for r in found["rejects"].collect()]
    assert sum(c[2] for c in counts.values()) == len(rejects) and found["le"].count() == 4
    assert ("le", "fields", "1\t1\t10\t100") in rejects and ("le", "type of timestamp", "1\t1\t10\t100\tlate") in rejects
    assert ("le", "type of album_id", "1\t1\t\t100\t5") in rejects and ("user", "type of playcount", "5\tUS\t20\tm\tmany\t5") in rejects
    assert all(r.file.endswith(("/les", "/users")) for r in found["rejects"].collect())
