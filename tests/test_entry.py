from pathlib import Path

import pytest

DATA = "/root/testdata/sf0.001"


def test_contract():
    import __spark_entry__ as entry

    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 50


@pytest.mark.skipif(not Path(DATA).exists(), reason="test tables are not here")
def test_flagship(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["node_id", "valid_from", "valid_to"] and df.count() > 0


@pytest.mark.skipif(not Path(DATA).exists(), reason="test tables are not here")
def test_full_build(spark):
    from normloom.plans.reference import full_build

    rows = full_build(spark, DATA).collect()
    assert rows and all(r["color"].startswith("#") and r["x"] == r["x"] for r in rows)


@pytest.mark.skipif(not Path(DATA).exists(), reason="test tables are not here")
def test_full_build_takes_all_norms(spark, monkeypatch):
    from normloom.plans import pipeline
    from normloom.plans.reference import full_build

    seen = {}

    def build(laws, *rest, **options):
        seen.update(laws=laws, options=options)
        raise InterruptedError

    monkeypatch.setattr(pipeline, "build", build)
    with pytest.raises(InterruptedError):
        full_build(spark, DATA)
    rows, known = seen["laws"].collect(), {r["slug"] for r in spark.read.parquet(f"{DATA}/laws_classified.parquet").collect()}
    last = spark.read.parquet(f"{DATA}/norm_snapshots.parquet").filter("snapshot_no = 4 and dok_nr is not null").collect()
    newest = {}
    for r in sorted(last, key=lambda r: r["loaded_at"]):
        newest[r["dok_nr"]] = r
    expected = {}
    for r in newest.values():
        if r["slug"] in known:
            expected.setdefault(r["slug"], []).append(r["text_xml"] or "")
    got = {r["slug"]: [n["text_xml"] or "" for n in r["norms"]] for r in rows}
    assert not seen["options"] and set(got) == known and max(map(len, expected.values())) > 1
    assert all(sorted(got[slug]) == sorted(texts) for slug, texts in expected.items())
    assert all(r["norm_count"] == len(r["norms"]) for r in rows) and all(len(got[slug]) == 1 for slug in known - set(expected))


def test_faults_of_the_subpackage_are_shown(monkeypatch):
    """Without the subpackage the rest works; a module missing inside it is an error."""
    import builtins
    import importlib
    import sys

    import __spark_entry__ as entry

    real = builtins.__import__

    def without(lost):
        def load(name, *args, **kwargs):
            if name.startswith(lost) or (lost == "normloom.llm" and args[2:] and args[2] and name == "normloom" and "llm" in args[2]):
                raise ModuleNotFoundError(f"No module named {lost!r}", name=lost)
            return real(name, *args, **kwargs)

        for name in [n for n in sys.modules if n.startswith("normloom.llm")]:
            monkeypatch.delitem(sys.modules, name)
        monkeypatch.setattr(builtins, "__import__", load)
        return importlib.reload(entry)

    try:
        found = without("normloom.llm")
        assert found.llm_catalog is None and "p2_found" in found.queries() and "p1_found" not in found.queries()
        if (Path(entry.__file__).parent / "normloom/llm").exists():
            with pytest.raises(ModuleNotFoundError, match="xxhash"):
                without("xxhash")
    finally:
        monkeypatch.undo()
        importlib.reload(entry)


@pytest.mark.skipif(not Path(DATA).exists(), reason="test tables are not here")
def test_bundle(spark, tmp_path):
    import json

    from pyspark.sql import functions as F

    from normloom.plans.pipeline import build, write_bundle

    norm = "array<struct<enbez:string,titel:string,text_xml:string>>"
    rows = [("a", "AG", "Gesetz über Alpha", [("§ 1", None, "<P>Nach § 3 BetaG und § 2 AG.</P>")]), ("b", "BetaG", "Gesetz über Beta", [("§ 1", None, "<P>Nichts.</P>")]), ("c", None, "Ohne Klasse", [])]
    laws = spark.createDataFrame(rows, f"slug string, jurabk string, langue string, norms {norm}").withColumns({"amtabk": F.lit(None).cast("string"), "ausfertigung_datum": F.lit("2001-01-01"), "norm_count": F.size("norms"), "parse_warnings": F.array().cast("array<string>")})
    toc = laws.select("slug", F.lit(1).alias("ord"), F.col("langue").alias("title"))
    entries = spark.createDataFrame([("1-1", "Gesetz über Alpha", 1), ("2-2", "Gesetz über Beta", 2)], "code string, block string, ord int")
    vectors = spark.createDataFrame([("a", [1.0, 0.0, 0.5]), ("b", [0.0, 1.0, 0.5]), ("c", [0.9, 0.1, 0.4])], "slug string, embedding array<float>")
    counts = write_bundle(build(laws, toc, entries, vectors, iterations=3), str(tmp_path))
    read = lambda name: json.loads((tmp_path / name).read_text())
    assert counts == {name: len(read(name)) for name in counts} and counts["nodes.json"] == 3 and counts["meta-taxonomy.json"] == 9
    places = read("layout.json")
    assert set(places) == {"de-bund/AG", "de-bund/BetaG", "de-bund/c"} and all(set(p) == {"x", "y", "z"} for p in places.values())
    z = [p["z"] for p in places.values()]
    assert abs(sum(z)) < 1e-3 and max(map(abs, z)) > 5_000
    assert {(e["source"], e["target"]) for e in read("edges.json") if e["type"] == "explicit"} == {("de-bund/AG", "de-bund/BetaG")} | {(e["source"], e["target"]) for e in read("edges.json") if e["source"] == e["target"]}
    assert "§ 3 betag" in read("reference-resolver.json") and {d["id"] for d in read("search-index.json")} == set(places)
