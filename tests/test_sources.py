"""Tables in buckets, folders of files with different headers."""

import os

import pytest

from clinicweave.sources import buckets, many, tables


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(200).selectExpr("id as k", "id * 2 as v", "'x' as `a.b`", "cast(null as string) as s")
    buckets.write(rows, path, "k", 16)
    before = files(path)
    updates = spark.createDataFrame([(3, -1, "n"), (4, -2, None), (9999, 5, "no such row"), (None, 7, "no key")], "k long, v long, s string")
    assert buckets.merge(spark, path, updates, ["v", "s"]) in (1, 2)
    after = files(path)
    assert 14 <= len([f for f in before & after if "rows" in f]) < 16
    got = {r.k: (r.v, r["a.b"], r.s) for r in buckets.read(spark, path).collect()}
    assert got == {k: (2 * k, "x", None) for k in range(200)} | {3: (-1, "x", "n"), 4: (-2, "x", None)}
    held = files(path)
    assert buckets.merge(spark, path, updates.where("k = 9999"), ["v", "s"]) == 0 and files(path) == held


def test_repeated_updates(spark, tmp_path):
    path = str(tmp_path / "t")
    buckets.write(spark.range(10).selectExpr("id as k", "id as v"), path, "k", 4)
    updates = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (1, 7, None), (2, 8, 1), (2, 9, 1)], "k long, v long, at int")
    with pytest.raises(ValueError, match="more than once"):
        buckets.merge(spark, path, updates, ["v"])
    buckets.merge(spark, path, updates, ["v"], latest_by="at")
    assert {r.k: r.v for r in buckets.read(spark, path).collect()} == {k: k for k in range(10)} | {1: 6, 2: 9}


def test_files_with_different_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Name,State,Notes\n"A ""x"", clinic",Goa,"two\nlines"\nB,Bihar,\n')
    (tmp_path / "b.csv").write_text('description,facility_name,lat,pincode\nn2,C,1.5,800001.0\nn3,D,oops,\nbroken,row\n')
    (tmp_path / "c.csv").write_text('Name,State,Notes\nE,Kerala,n4\n')
    (tmp_path / "d.csv").write_text("")
    rows, broken = many.read_many(spark, str(tmp_path))
    got = sorted((r.hospital_name, r.state, r.notes, r.latitude, r.pin_code, os.path.basename(r.source_file)) for r in rows.collect())
    assert got == [('A "x", clinic', "Goa", "two\nlines", None, "", "a.csv"), ("B", "Bihar", "", None, "", "a.csv"), ("C", "", "n2", 1.5, "800001", "b.csv"), ("D", "", "n3", None, "", "b.csv"), ("E", "Kerala", "n4", None, "", "c.csv")]
    assert [(os.path.basename(r.source_file), r.record) for r in broken.collect()] == [("b.csv", "broken,row")]
    with pytest.raises(ValueError):
        many.read_many(spark, str(tmp_path / "d.csv"))


def test_staged_tables_go(spark, tmp_path):
    t = tables.stage(spark.range(3), "t")
    where = t._staged
    assert t.count() == 3 and tables.exists(spark, where)
    tables.drop(t)
    assert not tables.exists(spark, where)


def facility_table(spark, names):
    return tables.drop_empty_rows(tables.resolve_columns(tables.read_facilities(spark, names)))


def test_index_is_kept_up_to_date(spark, tmp_path):
    from clinicweave.operators import scoring
    from clinicweave.sources import upkeep

    source, path = tmp_path / "in", str(tmp_path / "index")
    source.mkdir()
    for k in range(5):
        (source / f"f{k}.csv").write_text(f"name,specialties\nA{k},icu\nB{k},dental\n")
    built = []

    def read(names):
        built.extend(os.path.basename(n) for n in names)
        return facility_table(spark, names)

    run = lambda mark="v1": upkeep.refresh(spark, str(source), path, read, scoring.tag_facilities, mark, parts=8)
    names = lambda: sorted(r.hospital_name for r in upkeep.kept(spark, path).collect())
    assert upkeep.kept(spark, path) is None
    run()
    assert sorted(built) == [f"f{k}.csv" for k in range(5)] and names() == sorted(f"{x}{k}" for x in "AB" for k in range(5))
    built.clear()
    assert run() == [] and built == []  # nothing is read again
    (source / "f1.csv").write_text("name,specialties\nC1,trauma care\n")
    (source / "f4.csv").unlink()
    run()
    assert "f1.csv" in built and len(built) < 5 and names() == sorted([*(f"{x}{k}" for x in "AB" for k in (0, 2, 3)), "C1"])
    built.clear()
    run("v2")
    assert len(built) == 4 and {r.specialty_tags[0] for r in upkeep.kept(spark, path).where("size(specialty_tags) > 0").collect()} == {"icu", "trauma"}
    # a part that the manifest forgot, as after a lost job, is not read, and is built again
    part = upkeep.manifest(spark, path).where("file like '%f1.csv'").first().part
    upkeep._write_manifest(upkeep.manifest(spark, path).where(f"part <> {part}"), path)
    assert "C1" not in names()
    assert run("v2") == [part] and "C1" in names()
    assert upkeep.fingerprint() == upkeep.fingerprint() != upkeep.fingerprint("other weights")
